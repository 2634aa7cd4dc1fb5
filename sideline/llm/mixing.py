"""Mixing sources to target weights along a time-varying curriculum, on DataFrame functions only (operator 2).

Null texts have no words; null sources form a source of their own, last in order. Documents are ordered inside their source
by a hash of key and text, ties by key, size and hash, so reruns agree; repeated rows count each. An empty table gives an
empty result. Input columns other than the key, the source and the text are ignored.

The place of a document among its source's words comes from sums per (source, hash range), a running sum over those ranges,
and a running sum inside one range: a source with a third of all rows is spread over all ranges. Only the table of sources
(one narrow row each) is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sideline.llm.common import stored, word_count

RANGES_LOG2 = 12
# Weights of the sources in order, and each one's schedule: (progress, factor) knots, linear in between.
WEIGHTS = (3, 1, 2)
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))


def _place(key: str, source: str, text: str) -> Column:
    """A document's place in the order of its source: 60 bits of a hash; equal for rows of equal key, source and text."""
    told = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    name = F.concat_ws(":", told(F.col(key)), told(F.col(source)), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def _sized(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    place = _place(key, source, text)
    return docs.select(
        F.col(key).alias("key"), F.col(source).isNull().alias("nosrc"), F.coalesce(source, F.lit("")).alias("src"),
        word_count(text).alias("size"), place.alias("place"), F.shiftright(place, 60 - RANGES_LOG2).alias("range"),
    )


def source_targets(sources: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets of sources (nosrc, src, source_size): ``share`` of all words by weight, none above ``most`` times its source.

    The reshared excess has a closed form: sources in order of the level at which they fill up, a source being full when
    the level that the rest would reach without it lies above its own.
    """
    by_name, everything = Window.orderBy("nosrc", "src"), Window.partitionBy()
    t = sources.withColumn("order", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("order") % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.lit(most) * F.col("source_size"))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")), "order")
    t = t.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("left"),
        F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("rest"),
        F.row_number().over(by_level).alias("fills"),
    )
    t = t.withColumn("full", F.col("left") * F.col("weight") > F.col("cap") * F.col("rest"))
    level = F.min(F.when(~F.col("full"), F.struct("fills", "left", "rest"))).over(everything)
    t = t.withColumn("level", level)
    share_of = F.col("level.left") * F.col("weight") / F.col("level.rest")
    return t.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(share_of, F.col("cap").cast("double"))))


def _pieces(knots) -> list[Column]:
    """The pieces of one schedule with the share of its integral at either end."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    out, before = [], 0.0
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        out.append(F.struct(*(F.lit(float(v)).alias(n) for n, v in (("t0", t0), ("t1", t1), ("w0", w0), ("w1", w1), ("from", before), ("to", before + area)))))
        before += area
    return out


def _progress(used: Column, order: Column, schedules) -> Column:
    """The progress at which a source has used up this share of its words: its integrated schedule, inverted."""

    def invert(knots) -> Column:
        pieces = _pieces(knots)
        total = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))
        area = used * F.lit(total)
        out = None
        for p in reversed(pieces):
            slope = (p["w1"] - p["w0"]) / (p["t1"] - p["t0"])
            over = area - p["from"]
            # over = w0 x + slope x^2 / 2, solved without cancellation
            x = 2 * over / (p["w0"] + F.sqrt(F.greatest(p["w0"] * p["w0"] + 2 * slope * over, F.lit(0.0))))
            at = F.least(p["t0"] + F.coalesce(x, F.lit(0.0)), p["t1"])
            out = at if out is None else F.when(area < p["to"], at).otherwise(out)
        return out

    out = invert(schedules[-1])
    for i, knots in enumerate(schedules[:-1]):
        out = F.when(order % len(schedules) == i, invert(knots)).otherwise(out)
    return out


def _plan(docs: DataFrame, key: str, source: str, text: str, share: float, most: int, weights, schedules) -> DataFrame:
    sized = stored(_sized(docs, key, source, text), "mix-sizes")
    ranges = sized.groupBy("nosrc", "src", "range").agg(F.sum("size").alias("words"))
    targets = source_targets(ranges.groupBy("nosrc", "src").agg(F.sum("words").alias("source_size")), share, most, weights)
    earlier = Window.partitionBy("nosrc", "src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("nosrc", "src", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    starts = starts.join(targets.select("nosrc", "src", "order", "source_size", "target"), ["nosrc", "src"])
    inside = Window.partitionBy("nosrc", "src", "range").orderBy("place", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["nosrc", "src", "range"])
    middle = lambda epoch: epoch * F.col("source_size") + F.col("start") + F.col("inside") + F.col("size") / 2
    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), middle), lambda m: m < F.col("target"))
    positions = F.transform(copies, lambda m: _progress(m / F.col("target"), F.col("order"), schedules))
    return placed.select("key", "place", "size", "source_size", "target", positions.alias("positions"))


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", share: float = 1.5, most: int = 2,
    weights: tuple[int, ...] = WEIGHTS, schedules=SCHEDULES,
) -> DataFrame:
    """Per document: key, size, source_size, target, ``positions`` (one per copy taken, progress in [0, 1]) and taken.

    A copy is taken when the middle of its words lies before the target, so a source misses its target by half a document
    at most. Rows are sorted by first position over range partitions, documents left out last.
    """
    plan = _plan(docs, key, source, text, share, most, weights, schedules)
    taken = F.col("size") * F.size("positions")
    mixed = plan.select(F.col("key").alias(key), "size", "source_size", "target", "positions", taken.alias("taken"))
    return mixed.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), key, "size")


def expand(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", share: float = 1.5, most: int = 2,
    weights: tuple[int, ...] = WEIGHTS, schedules=SCHEDULES,
) -> DataFrame:
    """The documents as the mix reads them: one row per copy taken, the documents' own columns, range-sorted by position."""
    names = docs.columns
    nth = Window.partitionBy("_key", "_place")
    plan = _plan(docs, key, source, text, share, most, weights, schedules)
    plan = plan.select(F.col("key").alias("_key"), F.col("place").alias("_place"), "positions")
    plan = plan.withColumn("_nth", F.row_number().over(nth.orderBy(F.size("positions"))))
    rows = docs.select(F.struct(*names).alias("_row"), F.col(key).alias("_key"), _place(key, source, text).alias("_place"))
    rows = rows.withColumn("_nth", F.row_number().over(nth.orderBy("_place")))
    same = rows["_key"].eqNullSafe(plan["_key"]) & (rows["_place"] == plan["_place"]) & (rows["_nth"] == plan["_nth"])
    copies = rows.join(plan, same).select("_row", F.explode("positions").alias("_at"), rows["_key"].alias("_key"))
    return copies.orderBy("_at", "_key").select("_row.*")
