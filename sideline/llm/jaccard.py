"""Exact n-gram Jaccard join and its components, as a metric-space join (operator 8).

Jaccard distance is a metric, and two documents link when it is at most ``r = 1 - percent / 100``. The steps:

1. Documents with equal shingle sets become one class (a hash aggregate that combines before its shuffle).
2. Classes that cannot link are dropped exactly: of the shingles of A at most ``e = |A| - ceil(percent |A| / 100)`` are missing
   in a partner, so of any part of the hash space that both report, all but ``e`` of A's shingles must occur in some other
   class. Large sets report the lowest part of the space (``1.4 (1 - percent / 100)`` of it), small ones all of it.
3. Voronoi cells. For a few turns every set goes to one cell: that of its first shingle in a new hash order (near sets have
   the same first shingle as often as they are similar). A cell's pivots are a few of its documents; all others are
   compared with them, ``PIVOTS`` comparisons a document, and links join components. A document's nearest pivot so far is
   its home.
4. Regions, exactly. Step 2 is repeated on whole sets, with components for classes. With shingles ordered by rarity, those
   without a partner first, a link must have its first common shingle among the first ``e + 1`` of both sets: their boundary
   shingles. Each component is now the region of its *hub*, the pivot nearest to most of its sets, and knows its sets'
   distances from it. A set meets the regions it shares a boundary shingle with, is compared with their hubs, and by the
   triangle inequality can link only with members whose distance from the hub differs from its own by at most ``r``: it is
   replicated to those windows (cells of width ``r``) and compared with their members that share a boundary shingle. The
   comparison is part of the join's condition: inside a group of near copies, where bounds rule out little, a set may be
   compared with every member, but only links leave the join.

Documents as pivots of the whole corpus would not do: nearly all documents are at distance 1 from all of them, so every
window would hold everything. Hence the cells of single shingles, and document pivots inside them. A large group of near
copies costs one comparison per member and turn; later only documents that have not joined it are compared with others.
Pivots come from aggregates, members meet them in joins that skew handling can split, and nothing is gathered by group.
Shingles are told apart by 64-bit hashes, shingle sets by 128-bit hashes.

Null and empty texts have no shingles, get 0 and their own id and link with nothing. Texts with fewer words than a shingle
have one, the whole sequence. A null id counts as the smallest and shows as null. Repeated rows give a row each; rows of
one id with different texts may lie in different components. Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sideline.llm.common import stored, text_slices, work_tables

SMALL = 128  # sets below this size report all their shingles
PIVOTS = (2, 4, 6)  # of a cell in each turn; more of them leave less to the regions
SKETCH = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sample", T.ArrayType(T.LongType())),
])
SETS = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
BITS_LOG2 = 23  # of the filter that spares most texts the second pass: 1 MB, whatever the input


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text, A-Z in lower case."""
    tokens = (text or "").encode().lower().split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    size = min(words, n)
    acc = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        acc = (acc ^ each[i : n - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate([*arrays, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _reported(percent: int) -> int:
    """Hashes below this (unsigned) are those that large sets report."""
    return min(2**64 - 1, int(2**64 * 1.4 * (1 - percent / 100)))


def _sketcher(words: int, percent: int):
    top = np.uint64(_reported(percent))

    def run(batches):
        for batch in text_slices(batches):
            sets = [shingle_hashes(t.as_py(), words) for t in batch.column(1)]
            samples = [s if len(s) < SMALL else s[: np.searchsorted(s, top)] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), _lists(samples)], names=SKETCH.names
            )

    return run


def _finder(words: int, bits):
    def run(batches):
        mask = np.frombuffer(bits.value, np.uint8)
        for batch in text_slices(batches):
            out = {}
            for t in batch.column(1):
                s = shingle_hashes(t.as_py(), words)
                d = _digest(s)
                at = int.from_bytes(d[:4], "big") >> (32 - BITS_LOG2)
                if len(s) and mask[at >> 3] >> (at & 7) & 1:
                    out[d] = s
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), _lists(list(out.values()))], names=SETS.names)

    return run


def _bit(digest: str = "digest") -> Column:
    return F.shiftrightunsigned(F.conv(F.substring(F.hex(digest), 1, 8), 16, 10).cast("long"), 32 - BITS_LOG2)


def _filter_bits(classes: DataFrame) -> bytes:
    """A bit per hash of a class's digest; its size is fixed."""
    words = classes.select(_bit().alias("at")).groupBy(F.shiftrightunsigned("at", 5).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 32).cast("int"))).alias("bits"))
    table = np.zeros(1 << (BITS_LOG2 - 5), np.uint32)
    for r in words.toLocalIterator():
        table[r["word"]] = r["bits"]
    return table.tobytes()


def _missing(n: Column, percent: int) -> Column:
    """How many shingles of a set of ``n`` a linked partner may lack."""
    return n - F.ceil(n * percent / 100)


def _could_link(sketch: DataFrame, percent: int) -> DataFrame:
    """Digests of classes of which enough reported shingles occur in another class too; classes by 64 bits of their digest."""
    named = sketch.select(F.xxhash64("digest").alias("class"), "digest", "n", F.col("sample").alias("shingles"))
    # A partner may be larger and report a part only: where it could, count no more than that part.
    low = lambda s: F.shiftrightunsigned(s, 1) < _reported(percent) >> 1
    whole = F.ceil(F.col("n") * 100 / percent) < SMALL
    own = F.when(whole, F.col("n")).otherwise(F.size(F.filter("shingles", low)))
    named = named.withColumn("need", own - _missing(F.col("n"), percent))
    rows = named.select("class", whole.alias("whole"), F.explode("shingles").alias("s"))
    shared = rows.groupBy("s").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("s")
    hits = rows.where(F.col("whole") | low(F.col("s"))).select("class", "s").join(shared, "s").groupBy("class").agg(F.count("*").alias("hits"))
    # Copies report alike, so each one's share of the hits is what one copy has.
    classes = named.groupBy("class", "digest", "n", "need").agg(F.count("*").alias("copies"))
    return classes.join(hits, "class", "left").where(F.coalesce("hits", F.lit(0)) >= F.col("need") * F.col("copies")).select("digest", "n")


def components(edges: DataFrame) -> DataFrame:
    """Smallest vertex of each vertex's component, from edges (a, b): labels move along edges and then along themselves."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("v"), "label"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "v").select("v", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("v").alias("to"), F.col("label").alias("beyond"))
        moved = stored(moved.join(jump, "to").select("v", "was", F.least("to", "beyond").alias("label")), "labels")
        labels = moved.select("v", "label")
        if moved.where("label < was").isEmpty():
            return labels


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, p) with their exact distance and whether they link."""
    side = lambda k: sets.select(F.col("vid").alias(k), F.col("n").alias(f"n_{k}"), F.col("shingles").alias(f"s_{k}"))
    both = pairs.join(side("x"), "x").join(side("p"), "p")
    common = both.select("x", "p", "n_x", "n_p", F.size(F.array_intersect("s_x", "s_p")).alias("common"))
    union = F.col("n_x") + F.col("n_p") - F.col("common")
    return common.select("x", "p", (1 - F.col("common") / union).alias("d"), (F.col("common") * 100 >= union * percent).alias("linked"))


def _cells(sets: DataFrame, comp: DataFrame, turn: int, count: int, percent: int) -> DataFrame:
    """Pairs (x, p) of a cell's members and its pivots that are in different components and may link by their sizes."""
    first = F.array_min(F.transform("shingles", lambda s: F.xxhash64(s, F.lit(turn))))
    rows = sets.select("vid", "n", first.alias("g")).join(comp, "vid")
    picked = [F.min_by(F.struct("vid", "comp", "n"), F.xxhash64("vid", F.lit(turn), F.lit(i))) for i in range(count)]
    pivots = rows.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.array_distinct(F.array(*picked)).alias("ps")).where("lo < hi")
    pairs = rows.join(pivots.select("g", F.inline("ps")).toDF("g", "p", "comp_p", "n_p"), "g").where("comp != comp_p")
    return pairs.where(F.least("n", "n_p") * 100 >= F.greatest("n", "n_p") * percent).select(F.col("vid").alias("x"), "p")


def _merged(comp: DataFrame, linked: DataFrame) -> DataFrame:
    """Components after one step along the links of pivots: each class stays inside one true component."""
    of = lambda k, name: comp.select(F.col("vid").alias(k), F.col("comp").alias(name))
    ends = linked.join(of("x", "a"), "x").join(of("p", "b"), "p").select("p", "a", "b")
    stars = ends.groupBy("p", "b").agg(F.least(F.min("a"), F.col("b")).alias("low"))
    moves = ends.join(stars.select("p", "low"), "p").select(F.explode(F.array("a", "b")).alias("comp"), "low")
    moves = moves.groupBy("comp").agg(F.min("low").alias("low"))
    return comp.join(moves, "comp", "left").select("vid", F.coalesce("low", "comp").alias("comp"))


def _between(links: DataFrame, comp: DataFrame) -> DataFrame:
    """Links (x, p) between different components a and b, one of each pair of components."""
    of = lambda k, name: comp.select(F.col("vid").alias(k), F.col("comp").alias(name))
    ends = links.join(of("x", "a"), "x").join(of("p", "b"), "p").where("a != b")
    return ends.groupBy("a", "b").agg(F.min(F.struct("x", "p")).alias("link")).select("a", "b", "link.*")


def _boundary(sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Sets that may still link across components: vid, comp, n, alone (shingles of no other component), keys (boundary shingles, rare
    first)."""
    rows = sets.select("vid", F.explode("shingles").alias("s")).join(comp, "vid")
    shared = rows.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("df")).where("lo < hi").select("s", "df")
    keyed = rows.select("vid", "s").join(shared, "s").groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("known"))
    live = sets.select("vid", "n").join(keyed, "vid").withColumn("alone", F.col("n") - F.size("known"))
    live = live.where(F.col("alone") <= _missing(F.col("n"), percent))
    keys = F.slice("known", F.lit(1), (_missing(F.col("n"), percent) + 1 - F.col("alone")).cast("int"))
    return live.select("vid", "n", "alone", F.transform(keys, lambda k: k["s"]).alias("keys")).join(comp, "vid")


def _hubs(live: DataFrame, home: DataFrame, comp: DataFrame) -> DataFrame:
    """Per component with boundary sets: comp, hub (the pivot that is nearest to most of them), members."""
    of = comp.select(F.col("vid").alias("p"), F.col("comp").alias("comp_p"))
    near = live.select("vid", "comp").join(home.select("vid", F.col("near.p").alias("p")), "vid").join(of, "p").where("comp = comp_p")
    used = near.groupBy("comp", "p").agg(F.count("*").alias("uses")).groupBy("comp").agg(F.max_by("p", F.struct("uses", "p")).alias("p"))
    sizes = live.groupBy("comp").agg(F.count("*").alias("members"), F.min("vid").alias("least"))
    return sizes.join(used, "comp", "left").select("comp", F.coalesce("p", "least").alias("hub"), "members")


def _region_links(live: DataFrame, hubs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (x, p) between boundary sets of different components: every pair that the bounds leave is compared, those that a hub rules out are not.

    A component is the region of its hub. A set meets a region once if they share a boundary shingle and sizes allow a link;
    of two components the smaller one's sets go to the larger one. Its distance from the hub opens a window of width ``r`` to
    either side, and only members in the window whose boundary shingles meet its own are compared with it.
    """
    r = 1 - percent / 100 + 1e-9
    live = stored(live.join(hubs, "comp"), "boundary")
    cell = lambda d: F.floor(F.col(d) / r).cast("int")
    inner = _links(live.where("members > 1 AND vid != hub").select(F.col("vid").alias("x"), F.col("hub").alias("p")), sets, percent)
    members = inner.select(F.col("x").alias("vid"), "d").join(live, "vid").join(sets.select("vid", "shingles"), "vid")
    members = stored(members.select("vid", "comp", "n", "alone", "keys", "shingles", "d", cell("d").alias("cell")), "members")
    # Keys of a region; a region of one set keeps its keys in order, so that a pair of such regions meets at its first common key only.
    alone = lambda c: F.when(F.col("members") == 1, c).otherwise(F.array().cast("array<long>"))
    each = live.select("vid", "comp", "n", "alone", "members", "hub", "keys", F.posexplode("keys").alias("at", "g"))
    # From this shingle on, a set has at most ``rest`` shingles in common with one that it meets here first.
    each = each.withColumns({"before": alone(F.slice("keys", F.lit(1), F.col("at"))), "rest": F.col("n") - F.col("alone") - F.col("at")})
    own = each.select("g", "vid", F.col("comp").alias("comp_x"), F.col("n").alias("n_x"), F.col("members").alias("members_x"), F.col("before").alias("before_x"), F.col("rest").alias("rest_x"))
    regions = each.groupBy("g", "comp", "hub", "members").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"), F.first("before").alias("before"))
    fits = (F.col("n_x") * 100 >= F.col("low") * percent) & (F.col("high") * 100 >= F.col("n_x") * percent) & (F.least("rest_x", "rest") * (100 + percent) >= (F.col("n_x") + F.col("low")) * percent)
    larger = F.struct("members", "comp") > F.struct(F.col("members_x").alias("members"), F.col("comp_x").alias("comp"))
    met = own.join(regions, (own["g"] == regions["g"]) & larger & fits & ~F.arrays_overlap("before_x", "before"))
    met = stored(met.select(F.col("vid").alias("x"), F.col("hub").alias("p"), "comp", "members").distinct(), "met")
    found = stored(_links(met.select("x", "p"), sets, percent), "hub-distances")
    wide = met.where("members > 1").join(found.where("NOT linked"), ["x", "p"]).select("x", "comp", F.col("d").alias("d_x"), F.explode(F.sequence(F.floor((F.col("d") - r) / r).cast("int"), F.floor((F.col("d") + r) / r).cast("int"))).alias("cell"))
    mine = live.select("vid", "n", "alone", "keys").join(sets.select("vid", "shingles"), "vid")
    wide = wide.join(mine.toDF("x", "n_x", "alone_x", "keys_x", "shingles_x"), "x")
    # The comparison itself is the last part of the join's condition, so what comes out is links and no pair is ever written.
    most = F.least(F.col("n_x") - F.col("alone_x"), F.col("n") - F.col("alone"))  # shingles the two can have in common
    may = (most * (100 + percent) >= (F.col("n_x") + F.col("n")) * percent) & F.arrays_overlap("keys_x", "keys")
    near = (F.abs(F.col("d_x") - F.col("d")) <= r) & (F.least("n", "n_x") * 100 >= F.greatest("n", "n_x") * percent) & may
    linked = F.size(F.array_intersect("shingles_x", "shingles")) * (100 + percent) >= (F.col("n_x") + F.col("n")) * percent
    window = (wide["comp"] == members["comp"]) & (wide["cell"] == members["cell"]) & near & linked
    more = wide.join(members, window).select("x", F.col("vid").alias("p"))
    return found.where("linked").select("x", "p").unionByName(more)


def _join_regions(sets: DataFrame, percent: int) -> DataFrame:
    """Component (smallest vid) of every set that links with another, from whole sets (vid, n, shingles)."""
    comp = sets.select("vid", F.col("vid").alias("comp"))
    links = home = None  # links found so far whose ends are not yet of one component
    for turn, count in enumerate(PIVOTS):
        found = stored(_links(_cells(sets, comp, turn, count, percent), sets, percent), "distances")
        linked = found.where("linked").select("x", "p")
        links = linked if links is None else links.unionByName(linked)
        seen = found.groupBy(F.col("x").alias("vid")).agg(F.min(F.struct("d", "p")).alias("near"))
        home = seen if home is None else home.union(seen)
        comp = stored(_merged(comp, linked), "components")
        links = stored(_between(links, comp).select("x", "p"), "open-links")
    home = home.groupBy("vid").agg(F.min("near").alias("near"))
    live = stored(_boundary(sets, comp, percent), "live")
    found = stored(_region_links(live, _hubs(live, home, comp), sets, percent), "links")
    # Labels move along links of components only: a group of near copies is one vertex by now.
    named = components(_between(links.unionByName(found), comp).select("a", "b"))
    out = comp.join(named.select(F.col("v").alias("comp"), "label"), "comp", "left")
    return out.select("vid", F.coalesce("label", "comp").alias("comp"))


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_shingles, component_id (smallest key reachable by links of at least ``percent`` similarity)."""
    lowest = -(2**63)
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(lowest)).alias("id"), F.col(text).alias("text"))
    with work_tables() as keep:
        return keep(_components_of(texts, words, percent, lowest, key))


def _components_of(texts: DataFrame, words: int, percent: int, lowest: int, key: str) -> DataFrame:
    sketch = stored(texts.mapInArrow(_sketcher(words, percent), SKETCH), "sketch")
    left = stored(_could_link(sketch.where("n > 0"), percent).withColumn("vid", F.monotonically_increasing_id()), "candidates")
    bits = texts.sparkSession.sparkContext.broadcast(_filter_bits(left))
    found = texts.select("id", "text").mapInArrow(_finder(words, bits), SETS).groupBy("digest").agg(F.first("shingles").alias("shingles"))
    sets = stored(left.join(found, "digest").select("vid", "n", "shingles"), "sets")
    comp = _join_regions(sets, percent)
    # Only classes that met a candidate test have a component of their own name; all others are alone with their copies.
    first = sketch.where("n > 0").groupBy("digest").agg(F.min("id").alias("first_id"))
    named = first.join(left.select("digest", "vid").join(comp, "vid").select("digest", "comp"), "digest", "left")
    smallest = named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("first_id").alias("smallest"))
    named = named.join(smallest, "comp", "left").select("digest", F.coalesce("smallest", "first_id").alias("component_id"))
    out = sketch.select("id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    real = lambda c: F.when(F.col(c) != lowest, F.col(c))
    out = out.select(real("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("component_id", real("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each component kept: the row of its smallest key. Columns stay; repeated rows count once."""
    found = jaccard_components(docs, words, percent, key, text)
    keep = found.where(F.col(key).eqNullSafe(F.col("component_id"))).groupBy(F.col(key).alias("kept")).agg(F.count("*").alias("n"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    both = rows.join(keep, F.col(f"row.{key}").eqNullSafe(F.col("kept")))
    repeated = both.where("n > 1").withColumns({"k": F.col(f"row.{key}"), "t": F.col(f"row.{text}")}).dropDuplicates(["k", "t"])
    return both.where("n = 1").select("row.*").union(repeated.select("row.*"))
