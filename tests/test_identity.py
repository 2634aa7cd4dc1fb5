import random

import pytest
from pyspark.sql import functions as F

from sideline.functions.similarity import indel_ratio
from sideline.functions.text import name_key
from sideline.operators import identity


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 100.0 * 2 * lcs(a, b) / (len(a) + len(b))


def master(spark, rows):
    return identity.standardize_master(spark.createDataFrame(rows, "gsis_id string, display_name string, position string, team string"))


def roster(spark, rows):
    df = spark.createDataFrame(rows, "player string, team string, position string")
    return df.withColumn("player_normalized", name_key(F.col("player")))


MASTER = [
    ("1", "Michael Pitt Jr.", "WR", "IND"), ("2", "J.Tyson", "WR", "ARI"), ("3", "Sam Roe", "RB", "DAL"), ("4", "Sam Roe", "RB", "NYG"),
    ("5", "Quentin Vandermeer", "TE", "BUF"), ("6", "Old Kroft", "TE", "MIA"), ("7", "Ann Moo", "QB", "SEA"), ("8", "B.Lurch", "WR", "CHI"),
    ("9", "Brad Lurch", "RB", "CHI"), ("10", "Christopher Hollow", "QB", "DEN"), ("11", "D.Same", "WR", "ATL"), ("12", "Dan Same", "WR", "BAL"),
]


@pytest.mark.parametrize(
    "row,want",
    [
        (("Michael Pitt Jr.O", "IND", "WR"), ("1", "yahoo_status_suffix_exact", 100.0)),
        (("Jalen TysonIR-R", "ARI", "WR"), ("2", "surname_initial_team_position", 98.0)),
        (("Ann Moo", "SEA", "QB"), ("7", "exact", 100.0)),
        (("Sam Roe", "DAL", "RB"), ("3", "exact_name_team", 100.0)),
        (("Sam Roe", "", "RB"), ("", "unmatched", 0.0)),
        (("Bob Lurch", "CHI", "WR"), ("8", "surname_initial_team_position", 98.0)),
        (("Bob Lurch", "LV", "WR"), ("8", "surname_initial_position", 94.0)),
        (("Xavier Kroft", "MIA", "TE"), ("6", "unique_last_name_position", 90.0)),
        (("Quentin Vandermer", "BUF", "TE"), ("5", "fuzzy_name_team", 97.1)),
        (("Cristopher Holow", "LAR", "QB"), ("10", "fuzzy_name", 94.1)),
        (("Dolphins", "MIA", "D/ST"), ("", "team_defense", 100.0)),
        (("Ola Nordmann", "LAR", "QB"), ("A-1", "explicit_override", 100.0)),
        (("Nobody Here", "MIA", "TE"), ("", "unmatched", 0.0)),
        (("Deb Same", "KC", "WR"), ("", "unmatched", 0.0)),
        (("Zed Same", "ATL", "WR"), ("", "unmatched", 0.0)),
    ],
)
def test_ladder(spark, row, want):
    audited = spark.createDataFrame(
        [("ola nordmann", "A-1", "Ola Nordmann", "LAR", "QB")], "name_normalized string, player_id string, display_name string, team string, position string"
    )
    got = identity.match_ladder(roster(spark, [row]), master(spark, MASTER), overrides=audited).first()
    assert (got.nflverse_player_id, got.match_method, got.match_confidence) == want


def test_variant_match_renames(spark):
    got = identity.match_ladder(roster(spark, [("Michael Pitt Jr.O", "IND", "WR")]), master(spark, MASTER)).first()
    assert (got.player, got.player_normalized) == ("Michael Pitt Jr.", "michael pitt")


def test_counters_and_duplicates(spark):
    rows = [("Ann Moo", "SEA", "QB"), ("Ann Moo", "SEA", "QB"), ("Nobody Here", "MIA", "TE"), ("Bears", "CHI", "DEF")]
    mapped = identity.match_ladder(roster(spark, rows), master(spark, MASTER))
    assert mapped.count() == 4
    c = identity.mapping_counters(mapped).first()
    assert (c.individuals, c.matched_individuals, c.team_defenses, c.unmatched_individuals) == (3, 2, 1, 1)
    assert [r.player for r in identity.unmatched_rows(mapped).collect()] == ["Nobody Here"]


def test_name_shared_by_many_is_one_dictionary_row(spark):
    crowd = [(str(i), "Same Name", "WR", f"T{i}") for i in range(300)]
    keys = identity.master_keys(master(spark, crowd))
    assert keys.where(F.col("key").startswith("N\x1f")).select("candidates").collect()[0][0] == 300
    got = identity.match_ladder(roster(spark, [("Same Name", "T7", "WR")]), master(spark, crowd)).first()
    assert (got.nflverse_player_id, got.match_method) == ("7", "exact_name_team")


def test_similarity(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc ") for _ in range(rng.randint(1, 20))), "".join(rng.choice("abc ") for _ in range(rng.randint(1, 20)))) for _ in range(200)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        assert r.r == pytest.approx(ratio(r.a, r.b))


@pytest.mark.parametrize("shortest,longest", [(3, 24), (30, 60)])
def test_fuzzy_candidates_miss_nothing(spark, shortest, longest):
    """Brute force over every pair: the filter may add candidates, never lose one."""
    rng = random.Random(5)
    letters = "abcde "
    names = {"".join(rng.choice(letters) for _ in range(rng.randint(shortest, longest))).strip() or "a" for _ in range(120)}
    probes = set()
    for n in sorted(names)[:100]:
        text = list(n)
        for _ in range(rng.randint(0, 3 + longest // 20)):
            at = rng.randrange(len(text) + 1)
            if rng.random() < 0.5 and text:
                del text[min(at, len(text) - 1)]
            else:
                text.insert(at, rng.choice(letters))
        probes.add("".join(text) or "a")
    want = {(p, n) for p in probes for n in names if ratio(p, n) >= 90}
    got = identity.fuzzy_candidates(
        spark.createDataFrame([(p,) for p in probes], "probe string"), spark.createDataFrame([(n,) for n in names], "name string")
    )
    found = {(r.probe, r.name) for r in got.collect()}
    assert want and want <= found


def test_fuzzy_equal_scores_take_first_master_row(spark):
    rows = [("b", "Abcdefghij Klmnopqrsy", "WR", "X"), ("a", "Abcdefghij Klmnopqrsz", "WR", "Y")]
    got = identity.match_ladder(roster(spark, [("Abcdefghij Klmnopqrsx", "", "")]), master(spark, rows)).first()
    assert (got.nflverse_player_id, got.match_method) == ("a", "fuzzy_name")


def test_repeated_override_fails(spark):
    audited = spark.createDataFrame(
        [("a b", "A-1", "A B", "LAR", "QB"), ("a b", "A-2", "A B", "LAR", "QB")], "name_normalized string, player_id string, display_name string, team string, position string"
    )
    with pytest.raises(Exception, match="duplicate key"):
        identity.match_ladder(roster(spark, [("A B", "LAR", "QB")]), master(spark, MASTER), overrides=audited, fuzzy=False).collect()


def test_master_keys_are_spread(spark, monkeypatch):
    """Many rows in one piece of input are dealt to tasks before they become keys; the keys stay the same."""
    rows = [(f"p{i}", f"Name{i % 40} Last{i}", "KC", "WR", f"name{i % 40} last{i}") for i in range(500)]
    master = spark.createDataFrame(rows, "player_id string, display_name string, team string, position string, name_normalized string").coalesce(1)
    want = sorted(identity.master_keys(master).collect())
    monkeypatch.setattr(identity, "ROWS_A_TASK", 100)
    assert identity._spread(master, "player_id").rdd.getNumPartitions() == 5
    assert sorted(identity.master_keys(master).collect()) == want
