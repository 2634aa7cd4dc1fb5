import unicodedata

import pytest
from pyspark.sql import functions as F

from sideline.functions import text as X
from sideline.functions import numeric as N


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "fn,pairs",
    [
        (X.clean_text, [(None, ""), ("  a  b\t\nc ", "a b c"), ("D’A`x", "D'A'x"), ("ﬁn Ｑ①", "fin Q1"), ("é", "é")]),
        (X.name_key, [("Amon-Ra St. Brown", "amon ra st brown"), ("D'Andre Swift Jr.", "dandre swift"), ("Kenneth Walker III [O] (x)", "kenneth walker"), ("A.J. Brown", "a j brown"), ("Ivan Vii", "ivan vii")]),
        (X.compact_key, [("José Núñez Jr.", "josenunez"), ("Ægir Ł", "gir"), ("Amon-Ra St. Brown", "amonrastbrown"), (None, "")]),
        (X.team_code, [(" jac ", "JAX"), ("LA", "LAR"), ("OAK", "LV"), ("buf", "BUF"), ("XYZ", "XYZ"), (None, "")]),
        (X.strip_labels, [("Sam PoeVideo ForecastPlayer Note", "Sam Poe"), ("Lee RayDPlayer Note", "Lee RayD"), ("Max OwenIRPlayer Note", "Max Owen"), ("Al BoNo new player Notes", "Al Bo")]),
        (X.strip_labels_and_status, [("Puk NacQVideo ForecastNew Player Note", "Puk Nac"), ("Cam Lee Jr.IR-R", "Cam Lee Jr."), ("JOHN O", "JOHN O"), ("Ann MooO", "Ann Moo")]),
        (X.inline_status, [("Sam PoeIR-RPlayer Note", "IR-R"), ("Kit RoanQNew Player Note", "Q"), ("Ann Lee", ""), ("Tim Wild", "D")]),
        (X.title_case, [("RESERVE/INJURED", "Reserve/Injured"), ("OUT", "Out"), ("two  WORDS-x", "Two  Words-X")]),
        (X.blank_to_null, [("  ", None), (" a ", "a"), (None, None)]),
    ],
)
def test_text(spark, fn, pairs):
    assert run(spark, fn, [p[0] for p in pairs]) == [p[1] for p in pairs]


def test_points_cell(spark):
    assert run(spark, N.points_cell, ["–", "—", "-", "12.5", "-3", "x", "1."]) == [None, None, None, 12.5, -3.0, None, None]
    assert run(spark, N.is_points_cell, ["–", "—", "-", "12.5", "-3", "x", "1."]) == [True] * 5 + [False] * 2


def test_math(spark):
    df = spark.createDataFrame([(4.0, 0.0, None, float("inf"), float("nan"))], "a double, z double, n double, i double, x double")
    c = F.col
    row = df.select(
        N.safe_ratio(c("a"), c("z")), N.safe_ratio(c("a"), c("a")), N.clip(c("n"), 0, 1), N.clip(c("a"), 0, 1), N.floor_zero(c("n")),
        N.finite_or_zero(c("i")), N.finite_or_zero(c("x")), N.finite_or_zero(c("n")), N.as_double(c("x")),
        N.row_std([c("a"), c("z"), c("n"), c("i"), c("x")], 4.0), N.row_std([c("a"), c("n")], 4.0),
    ).first()
    assert tuple(row) == (None, 1.0, None, 1.0, None, 0.0, 0.0, 0.0, None, 2.0, 4.0)


def test_compact_key_folds_like_nfkd(spark):
    import unicodedata

    names = ["½", "™", "№", "𝐀", "Ǆ", "José Núñez Jr.", "Straße", "Œuvre", "ﬁn", "Ａｂｃ", "plain", "", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = {r.i: r.k for r in df.select("i", X.compact_key(F.col("n")).alias("k")).collect()}
    import re

    for i, n in enumerate(names):
        base = unicodedata.normalize("NFKD", n or "").encode("ascii", "ignore").decode().lower()
        base = re.sub(r"\b(?:jr|sr|ii|iii|iv|v)\.?\b", "", base)
        assert got[i] == re.sub("[^a-z0-9]", "", base), n


def test_fold_compatibility_of_runs(spark):
    """Folding run by run is folding the whole; a long ASCII text around a run never enters Python."""
    texts = ["", "plain", "\u00e9", "e\u0301", "\u0301", "x\uff1ctable\uff1e\u2460\ufb01 \u1112\u1161\u11ab e\u0301\u0323z", "\u0301\u0301a", "\u212b\n\u0301b", "\U0001d400\u00a0q", "\u0041\u030a\u0301", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.f for r in df.select("i", X.fold_compatibility(F.col("t")).alias("f")).collect()}
    assert got == {i: t if t is None else unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
    long = F.regexp_extract_all(F.lit("a" * 1000 + "\u00e9"), F.lit(X._RUN), F.lit(0))
    assert spark.range(1).select(long.alias("runs")).first().runs == ["a\u00e9"]
