"""Resolve roster names to player ids through an auditable ladder.

Set-based form of "the first rung with exactly one candidate wins":

* the master is turned into keys once (name, name+team, surname+initial+...),
  and every key is reduced to a candidate count and one candidate before any
  join. A name shared by a third of the master is one row in that dictionary.
* every roster row asks for its keys in rung order, one equi-join answers all
  rungs, and the lowest rung whose key has a single candidate is kept.

The last rung compares spellings. Its candidates come from an exact filter
(see :func:`fuzzy_candidates`), never from a cross join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sideline.functions.similarity import indel_ratio
from sideline.functions.text import clean_text, name_key, team_code
from sideline.operators.schema import one_row_per_key, resolve_aliases
from sideline.schemas import DEFENSE_ALIASES, MASTER_ALIASES
from sideline.session import ensure_checkpointing

# fixed values
FUZZY_THRESHOLD = 90.0
STATUS_WORDS = ("ir r", "pup r", "cel")
STATUS_LETTERS = ("o", "q", "d", "p")
RUNGS = {
    "team_defense": 100.0,
    "explicit_override": 100.0,
    "yahoo_status_suffix_exact": 100.0,
    "exact": 100.0,
    "exact_name_team": 100.0,
    "surname_initial_team_position": 98.0,
    "surname_initial_position": 94.0,
    "unique_last_name_position": 90.0,
}

_SEP = "\x1f"
ROWS_A_TASK = 50_000


def standardize_master(raw: DataFrame, *, ascii_only: bool = False) -> DataFrame:
    """Player master in canonical form with its name key."""
    df = resolve_aliases(raw, MASTER_ALIASES)
    if "player_id" not in df.columns:
        raise ValueError("Player master does not contain a usable player id.")

    def text(name):
        return clean_text(F.col(name), ascii_only=ascii_only) if name in df.columns else F.lit("")

    return df.withColumns(
        {
            "display_name": text("display_name"),
            "position": F.upper(text("position")),
            "team": team_code(F.col("team"), ascii_only=ascii_only) if "team" in df.columns else F.lit(""),
        }
    ).withColumn("name_normalized", name_key(F.col("display_name"), ascii_only=ascii_only))


def status_variants(name: Column) -> Column:
    """Name keys left after removing an attached status marker, in the order they are tried."""
    parts = []
    for word in STATUS_WORDS:
        parts.append(F.when(name.endswith(word), F.trim(name.substr(F.lit(1), F.length(name) - len(word)))))
    for letter in STATUS_LETTERS:
        parts.append(F.when(name.endswith(" " + letter), F.trim(name.substr(F.lit(1), F.length(name) - 2))))
    parts.append(
        F.when(F.right(name, F.lit(1)).isin(*STATUS_LETTERS), F.trim(name.substr(F.lit(1), F.length(name) - 1)))
    )
    return F.array_distinct(F.array_compact(F.array(*parts)))


def _key(kind: str, *parts: Column) -> Column:
    """Key text, or null when a part is missing or blank."""
    filled = parts[0] != ""
    for p in parts[1:]:
        filled = filled & (p != "")
    return F.when(filled, F.concat_ws(_SEP, F.lit(kind), *parts))


def _optional_key(kind: str, base: list[Column], team: Column, position: Column) -> Column:
    """Key that narrows by team and position only where the roster row gives them."""
    return (
        F.when((team != "") & (position != ""), _key(kind + "TP", *base, team, position))
        .when(team != "", _key(kind + "T", *base, team))
        .when(position != "", _key(kind + "P", *base, position))
        .otherwise(_key(kind, *base))
    )


def _spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt so that a task holds some ``ROWS_A_TASK`` of them. Each is about to become a dozen keys, which are sorted
    before they are combined, and one piece of a small file can hold millions of rows."""
    tasks = -(-rows.count() // ROWS_A_TASK)
    return rows.repartition(tasks, *by) if tasks > 1 else rows


def master_keys(master: DataFrame) -> DataFrame:
    """Key dictionary: key, number of candidate rows, one candidate."""
    name, team, position = F.col("name_normalized"), F.col("team"), F.col("position")
    tokens = F.split(name, " ")
    last, initial = F.element_at(tokens, -1), F.substring(name, 1, 1)
    keys = [
        _key("N", name), _key("NT", name, team), _key("NP", name, position), _key("NTP", name, team, position),
        _key("S", last, initial), _key("ST", last, initial, team), _key("SP", last, initial, position),
        _key("STP", last, initial, team, position),
    ]
    by_token = F.transform(F.array_distinct(tokens), lambda t: _key("L", t, position))
    candidate = F.struct("player_id", "display_name", "team", "position", "name_normalized")
    return (
        _spread(master.where(name != ""), "player_id", "name_normalized")
        .select(F.explode(F.array_compact(F.concat(F.array(*keys), by_token))).alias("key"), candidate.alias("m"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("candidates"), F.min("m").alias("m"))
    )


def _prepare(roster: DataFrame, row_id: str | None, *, ascii_only: bool) -> DataFrame:
    # Without an id column the row's own content identifies it: a retried task
    # then gives the same id, which a generated counter would not.
    rid = F.col(row_id) if row_id else F.to_json(F.struct(*roster.columns))
    variants = status_variants(F.col("player_normalized"))
    return roster.withColumns(
        {
            "_rid": rid,
            "_team": team_code(F.col("team"), ascii_only=ascii_only),
            "_position": F.upper(clean_text(F.col("position"), ascii_only=ascii_only)),
            "_variants": variants,
        }
    ).withColumn(
        "_fallback",
        F.when(F.size("_variants") > 0, F.element_at("_variants", 1)).otherwise(F.col("player_normalized")),
    )


def _wanted_keys(df: DataFrame) -> DataFrame:
    """(row, rung, key) requests in rung order."""
    name, fallback = F.col("player_normalized"), F.col("_fallback")
    team, position = F.col("_team"), F.col("_position")
    tokens = F.split(fallback, " ")
    last, initial = F.element_at(tokens, -1), F.substring(fallback, 1, 1)
    full = F.size(tokens) >= 2

    def ask(order: int, method: str, key: Column, when: Column | None = None) -> Column:
        k = key if when is None else F.when(when, key)
        return F.struct(F.lit(order).alias("rung"), F.lit(method).alias("method"), k.alias("key"))

    by_suffix = F.transform(
        F.col("_variants"),
        lambda v, i: F.struct(
            (i + 10).alias("rung"),
            F.lit("yahoo_status_suffix_exact").alias("method"),
            _optional_key("N", [v], team, position).alias("key"),
        ),
    )
    rest = F.array(
        ask(30, "exact", _key("N", name)),
        ask(31, "exact_name_team", _key("NT", name, team)),
        ask(40, "surname_initial_team_position", _optional_key("S", [last, initial], team, position), full),
        ask(41, "surname_initial_position", _optional_key("S", [last, initial], F.lit(""), position), full),
        ask(50, "unique_last_name_position", _key("L", last, position)),
    )
    return df.select("_rid", F.explode(F.concat(by_suffix, rest)).alias("w")).select("_rid", "w.*").where(
        F.col("key").isNotNull()
    )


_OVERRIDE = "struct<player_id:string,display_name:string,team:string,position:string,name_normalized:string>"


def match_ladder(
    roster: DataFrame,
    master: DataFrame,
    *,
    row_id: str | None = None,
    fuzzy: bool = True,
    master_order: str = "player_id",
    ascii_only: bool = False,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """Roster rows with id, name, team, position, method and confidence of their match.

    ``overrides`` are audited identities that no rule resolves, one row per name key: name_normalized, player_id,
    display_name, team, position.

    ``row_id`` names a unique roster column; without one the row's content is its id.
    ``master_order`` settles equal best scores in the spelling rung.
    """
    df = _prepare(roster, row_id, ascii_only=ascii_only)
    df = df.withColumn("_defense", F.col("_position").isin(*DEFENSE_ALIASES))
    if overrides is None:
        df = df.withColumn("_override", F.lit(None).cast(_OVERRIDE))
    else:
        fields = ("player_id", "display_name", "team", "position", "name_normalized")
        audited = one_row_per_key(overrides.select(*fields), ["name_normalized"], "Identity overrides")
        audited = audited.select(F.col("name_normalized").alias("_audited"), F.struct(*fields).alias("_override"))
        df = df.join(audited, F.col("player_normalized") == F.col("_audited"), "left").drop("_audited")
    open_rows = df.where(~F.col("_defense") & F.col("_override").isNull())
    dictionary = master_keys(master).where(F.col("candidates") == 1)
    hits = (
        _wanted_keys(open_rows)
        .join(dictionary, "key")
        .groupBy("_rid")
        .agg(F.min_by(F.struct("method", "m"), F.col("rung")).alias("hit"))
        .select("_rid", "hit.method", "hit.m")
    )
    df = df.join(hits, "_rid", "left")
    confidence = F.element_at(F.create_map(*[F.lit(x) for kv in RUNGS.items() for x in kv]), F.col("method"))
    df = df.withColumn("_score", confidence)
    if fuzzy:
        # What the equi-join rungs left open is needed several times below, so
        # the ladder's outcome is written once instead of being recomputed.
        ensure_checkpointing(df.sparkSession)
        df = df.checkpoint()
        unmatched = df.where(
            F.col("method").isNull() & ~F.col("_defense") & F.col("_override").isNull() & (F.col("_fallback") != "")
        ).select("_rid", F.col("_fallback").alias("probe"), F.col("_team").alias("probe_team"))
        found = fuzzy_matches(unmatched, master, order=master_order)
        df = df.join(found, "_rid", "left").withColumns(
            {
                "method": F.coalesce("method", "f_method"),
                "_score": F.coalesce("_score", "f_score"),
                "m": F.coalesce("m", "f_m"),
            }
        )

    matched = F.col("m").isNotNull()
    rename = matched & (F.size("_variants") > 0)

    def pick(field: str, defense: Column) -> Column:
        return (
            F.when(F.col("_defense"), defense)
            .when(F.col("_override").isNotNull(), F.col("_override")[field])
            .otherwise(F.coalesce(F.col("m")[field], F.lit("")))
        )

    method = (
        F.when(F.col("_defense"), "team_defense")
        .when(F.col("_override").isNotNull(), "explicit_override")
        .otherwise(F.coalesce("method", F.lit("unmatched")))
    )
    fixed = F.col("_defense") | F.col("_override").isNotNull()
    result = df.withColumns(
        {
            "player": F.when(rename & ~fixed, F.col("m.display_name")).otherwise(F.col("player")),
            "player_normalized": F.when(rename & ~fixed, F.col("m.name_normalized")).otherwise(
                F.col("player_normalized")
            ),
            "nflverse_player_id": pick("player_id", F.lit("")),
            "nflverse_name": pick("display_name", F.lit("")),
            "nflverse_team": pick("team", F.col("_team")),
            "nflverse_position": pick("position", F.lit("DEF")),
            "match_method": method,
            "match_confidence": F.round(F.when(fixed, 100.0).otherwise(F.coalesce("_score", F.lit(0.0))), 1),
        }
    )
    return result.drop(
        *[c for c in result.columns if c.startswith("_") or c in ("method", "m", "f_method", "f_score", "f_m")]
    )


# ------------------------------------------------------------------ spelling


# Names up to this length are looked up by two pieces at once. For longer ones
# the places two pieces can take are too many, while one piece at one place of
# one long name is already a narrow bucket.
TWO_PIECES_UP_TO = 40


def _piece_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For a probe and a name length: which pieces of the name may stand where in the probe."""
    for batch in batches:
        found = []
        for lp, ln in zip(batch["lp"].tolist(), batch["ln"].tolist()):
            gap, two = lp - ln, ln <= TWO_PIECES_UP_TO
            k = ln * 2 // 9 + (2 if two else 1)
            edits = (lp + ln) // 10
            edits -= (edits - gap) % 2  # insertions and deletions differ by the gap
            cuts = [ln * i // k for i in range(k + 1)]
            shifts = [s for s in range(-edits, edits + 1) if abs(s) + abs(gap - s) <= edits]
            for i in range(k):
                n = cuts[i + 1] - cuts[i]
                for s1 in shifts:
                    a = cuts[i] + s1
                    if a < 0 or a + n > lp:
                        continue
                    if not two:
                        found.append((lp, ln, i, i, a + 1, n, 1, 0))
                        continue
                    for s2 in shifts:
                        if abs(s1) + abs(s2 - s1) + abs(gap - s2) > edits:
                            continue
                        for j in range(i + 1, k):
                            b, m = cuts[j] + s2, cuts[j + 1] - cuts[j]
                            if b >= 0 and b + m <= lp:
                                found.append((lp, ln, i, j, a + 1, n, b + 1, m))
        yield pd.DataFrame(found, columns=["lp", "ln", "i", "j", "a", "n", "b", "m"], dtype="int32")


def _bucket(text: str) -> Column:
    """Join key: name length, two piece numbers and the two pieces."""
    return F.concat_ws(
        _SEP, "ln", "i", "j",
        F.substr(F.col(text), F.col("a"), F.col("n")), F.substr(F.col(text), F.col("b"), F.col("m")),
    )


def fuzzy_candidates(probes: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (probe, name) that can reach the similarity threshold, with no false dismissal.

    Similarity 90 means at most D = 0.1 * (len a + len b) insertions and
    deletions. A name cut into D + 2 pieces keeps at least two of them
    unharmed, and each of those stands in the probe, shifted by at most as many
    places as there are edits to spend: |s1| + |s2 - s1| + |gap - s2| <= D for
    the shifts s1, s2 and the length difference gap. So the join key is (length,
    two piece numbers, the two pieces), a much narrower bucket than one n-gram;
    very long names are cut into D + 1 pieces, one of which survives.
    Where pieces may stand depends on lengths only and is worked out once per
    pair of lengths that occurs. The edit-distance test is part of the join
    condition, so a bucket never emits pairs that fail it.
    """
    ln = F.length("name")
    two = F.col("ln") <= TWO_PIECES_UP_TO
    k = F.floor(ln * 2 / 9).cast("int") + F.when(ln <= TWO_PIECES_UP_TO, 2).otherwise(1)

    def cut(i: Column) -> Column:
        return F.floor(F.col("ln") * i / F.col("k")).cast("int")

    last = F.col("k") - 1
    indexed = (
        names.select("name", ln.alias("ln"), k.alias("k"))
        .select("*", F.explode(F.sequence(F.lit(0), F.when(two, last - 1).otherwise(last))).alias("i"))
        .select("*", F.explode(F.when(two, F.sequence(F.col("i") + 1, F.greatest(last, F.col("i") + 1))).otherwise(F.array("i"))).alias("j"))
        .withColumns(
            {
                "a": cut(F.col("i")) + 1, "n": cut(F.col("i") + 1) - cut(F.col("i")),
                "b": F.when(two, cut(F.col("j")) + 1).otherwise(1),
                "m": F.when(two, cut(F.col("j") + 1) - cut(F.col("j"))).otherwise(0),
            }
        )
        .select("name", _bucket("name").alias("bucket"))
    )
    lp = F.length("probe")
    lengths = (
        probes.select(lp.alias("lp")).distinct()
        .select("lp", F.explode(F.sequence(F.greatest(F.ceil(F.col("lp") * 9 / 11).cast("int"), F.lit(1)), F.greatest(F.floor(F.col("lp") * 11 / 9).cast("int"), F.lit(1)))).alias("ln"))
        .join(names.select(ln.alias("ln")).distinct(), "ln", "left_semi")
        .select("lp", "ln")
    )
    places = lengths.mapInPandas(_piece_places, "lp int, ln int, i int, j int, a int, n int, b int, m int")
    asked = (
        probes.withColumn("lp", lp)
        .join(places, "lp")
        .select("probe", _bucket("probe").alias("bucket"))
        .distinct()
    )
    near = F.levenshtein("probe", "name") <= F.floor((F.length("probe") + F.length("name")) / 10)
    return asked.join(indexed, "bucket").where(near).select("probe", "name").distinct()


def fuzzy_matches(unmatched: DataFrame, master: DataFrame, *, order: str = "player_id") -> DataFrame:
    """Best spelling per unmatched row, by team where that is unique, else by name where that is.

    Equal best scores go to the name whose first master row comes first in ``order``.
    """
    by_name = (
        master.where(F.col("name_normalized") != "")
        .groupBy(F.col("name_normalized").alias("name"))
        .agg(F.min(order).alias("first"))
    )
    probes = unmatched.select("probe").distinct()
    scored = (
        fuzzy_candidates(probes, by_name)
        .withColumn("score", indel_ratio(F.col("probe"), F.col("name")))
        .where(F.col("score") >= FUZZY_THRESHOLD)
        .join(by_name, "name")
    )
    best = (
        scored.groupBy("probe")
        .agg(F.min_by(F.struct("name", "score"), F.struct(-F.col("score"), F.col("first"))).alias("b"))
        .select("probe", "b.name", "b.score")
    )
    keys = master_keys(master).where(F.col("candidates") == 1).select("key", "m")
    requests = (
        unmatched.join(best, "probe")
        .select(
            "_rid", "score",
            F.explode(
                F.array(
                    F.struct(F.lit(1).alias("rung"), _key("NT", F.col("name"), F.col("probe_team")).alias("key"), F.lit("fuzzy_name_team").alias("method")),
                    F.struct(F.lit(2).alias("rung"), _key("N", F.col("name")).alias("key"), F.lit("fuzzy_name").alias("method")),
                )
            ).alias("w"),
        )
        .select("_rid", "score", "w.*")
        .where(F.col("key").isNotNull())
    )
    return (
        requests.join(keys, "key")
        .groupBy("_rid")
        .agg(F.min_by(F.struct("method", "score", "m"), F.col("rung")).alias("f"))
        .select(
            "_rid", F.col("f.method").alias("f_method"), F.col("f.score").alias("f_score"), F.col("f.m").alias("f_m")
        )
    )


def mapping_counters(mapped: DataFrame) -> DataFrame:
    """How many individuals and team units were resolved."""
    unit = F.col("position").isin(*DEFENSE_ALIASES)
    resolved = F.coalesce(F.length("nflverse_player_id"), F.lit(0)) > 0
    return mapped.agg(
        F.count_if(~unit).alias("individuals"),
        F.count_if(~unit & resolved).alias("matched_individuals"),
        F.count_if(unit).alias("team_defenses"),
        F.count_if(~unit & ~resolved).alias("unmatched_individuals"),
    )


def unmatched_rows(mapped: DataFrame) -> DataFrame:
    """Individuals the ladder left without an id, for review."""
    unit = F.col("position").isin(*DEFENSE_ALIASES)
    return mapped.where(~unit & (F.coalesce(F.length("nflverse_player_id"), F.lit(0)) == 0))


def first_per_player(master: DataFrame, columns: list[str], order: str = "display_name") -> DataFrame:
    """One master row per id, chosen by value so that reruns agree."""
    row = F.struct(*columns)
    return master.groupBy("player_id").agg(F.min_by(row, F.struct(order, *columns)).alias("r")).select(
        "player_id", "r.*"
    )


