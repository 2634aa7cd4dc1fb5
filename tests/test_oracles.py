"""Every registered query against its SQL on the smallest tables."""

import pytest

import compare
from sideline.operators import models, views
from sideline.operators.evaluate import ALL_RECORDS, FORECAST_LABELS
from sideline.plans import bindings as B
from sideline.plans import live
from sideline.plans.oracles import HALF_UP, ORACLES
from sideline.plans.queries import REGISTRY
from sideline.schemas import DENSE_METRICS
from sideline.session import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(REGISTRY)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    problem = compare.compare(spark, con, SF, name, REGISTRY[name], ORACLES.get(name))
    assert problem is None or (problem == "both empty" and name == "matchup_rejects"), problem


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_holdout_against_sql(spark, con):
    """Rows per group as in SQL. The given tables hold nothing to learn but the mean, so the trees must stay close to its error."""
    settings = {**models.TREE_SETTINGS, "maxIter": 10, "stepSize": 0.05}
    folds = {2001: list(range(1995, 2001))}
    pairs = stored(live.fold_pairs(B.usage(spark, SF), B.schedule(spark, SF), folds, dense=DENSE_METRICS), "holdout-test")
    report = {(r.position, r.model): r for r in live.fold_reports(pairs, folds, tree_settings=settings).collect()}
    want = con.execute(f"SELECT position, model, examples FROM ({ORACLES['fold_ridge_metrics']}) WHERE season = 2001").fetchall()
    assert want and all(report[p, m].examples == n for p, m, n in want)
    assert all(report[p, FORECAST_LABELS["ml_projection"]].examples == n for p, m, n in want)
    actual = pairs.select("season", "target_next_week").toPandas()
    mean = actual.target_next_week[actual.season < 2001].mean()
    error = (actual.target_next_week[actual.season == 2001] - mean).abs().mean()
    assert report[ALL_RECORDS, FORECAST_LABELS["ml_projection"]].mae <= 1.05 * error


def test_recent_form_labels(spark, con):
    """Zeros left by rounding have no sign and halves go away from zero, in the query and in its SQL."""
    points = [-1e-16, 1e-16, 0.0, -0.04, -0.06, 2.25, 2.35, -2.25, 0.05, 12.449999999999999, 1234.5]
    rows = spark.createDataFrame([(str(i), 2000, 1, v) for i, v in enumerate(points)], "player_id string, season int, week int, fantasy_points_std double")
    got = {r.player_id: r.recent_scores[0] for r in views.recent_form(rows).collect()}
    want = con.execute(f"SELECT i, {HALF_UP} FROM (SELECT unnest(?) AS i, unnest(?) AS fantasy_points_std)", [[str(i) for i in range(len(points))], points]).fetchall()
    assert got == {i: f"Wk 1: {label}" for i, label in want}
