import json

import numpy as np
import pytest

from pyspark.sql import functions as F

from sideline.operators import boosting, evaluate, models, quantiles, statistics
from sideline.schemas import MODEL_FEATURES
from sideline.plans.live import fold_table


@pytest.fixture(scope="module")
def examples(spark):
    rng = np.random.default_rng(3)
    n, k = 900, 8
    x = rng.normal(size=(n, k)) * np.arange(1, k + 1) + 2
    pos = rng.choice(["QB", "RB", "WR", "TE", "K"], size=n)
    y = x @ np.linspace(-1, 1, k) + (pos == "QB") * 5 + rng.normal(size=n)
    names = list(MODEL_FEATURES[:k])
    rows = [(*map(float, x[i]), str(pos[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, ",".join(f"{c} double" for c in names) + ", position string, target_next_week double")
    return df, x, pos, y, names


def test_ridge_equals_normal_equations(spark, examples):
    df, x, pos, y, names = examples
    model = models.fit_ridge(df)
    standard = (x - x.mean(0)) / x.std(0)
    positions = ["QB", "RB", "TE", "WR"]
    design = np.column_stack([np.ones(len(y)), standard, *[(pos == p).astype(float) for p in positions]])
    penalty = np.eye(design.shape[1]) * 12
    penalty[0, 0] = 0
    want = np.linalg.solve(design.T @ design + penalty, design.T @ y)
    got = [model.intercept, *[model.weights[f] for f in names], *[model.position_weights[p] for p in positions]]
    np.testing.assert_allclose(got, want, atol=1e-8)
    scored = models.apply_ridge(df, model).select("learned_weight_projection").toPandas().iloc[:, 0]
    np.testing.assert_allclose(scored, np.maximum(0, design @ want), atol=1e-8)
    report = model.report(spark).collect()
    assert len(report) == 12 and report[0].absolute_weight == max(r.absolute_weight for r in report)


def test_ridge_store_and_version(spark, examples, tmp_path):
    df = examples[0]
    model = models.fit_ridge(df)
    model.save(spark, str(tmp_path / "ridge"))
    assert models.RidgeModel.load(spark, str(tmp_path / "ridge")) == model
    assert models.RidgeModel.load(spark, str(tmp_path / "none")) is None
    other = json.loads(model.to_json()) | {"scoring_version": "other"}
    assert models.RidgeModel.from_json(json.dumps(other)) is None
    assert models.RidgeModel.from_json("{}") is None
    assert "learned_weight_projection" not in models.apply_ridge(df, model, scoring_version="other").columns


def test_season_sums(spark):
    """Matrices per season, a null season among them, over several tasks; folds add them."""
    rng = np.random.default_rng(8)
    seasons = [None if s == 3 else int(s) for s in rng.integers(0, 4, 300)]
    x = rng.normal(size=(300, 3)) * [1, 50, 1e-3] + [0, 100, 5]
    df = spark.createDataFrame([(s, *map(float, r)) for s, r in zip(seasons, x)], "season long, a double, b double, c double").repartition(5)
    got = statistics.season_sums(df, ["a", "b", "c"], "season")
    full = np.column_stack([np.ones(300), x])
    assert set(got.of) == {0, 1, 2, None}
    for s in got.of:
        rows = full[[t == s for t in seasons]]
        np.testing.assert_allclose(got.of[s], rows.T @ rows, rtol=1e-10)
    both = full[[t in (0, 2) for t in seasons]]
    np.testing.assert_allclose(got.add([0, 2, 99]), both.T @ both, rtol=1e-10)
    assert statistics.season_sums(df.limit(0), ["a", "b", "c"], "season").of == {}


def test_ridge_of_seasons_equals_refit(spark, examples):
    """Adding seasons gives the model of a fit on their rows; a constant column has no weight."""
    df = examples[0].withColumns({"season": (F.monotonically_increasing_id() % 3).cast("int"), MODEL_FEATURES[0]: F.lit(7.25)})
    sums = models.season_products(df)
    added, again = models.ridge_of_seasons(sums, [0, 2]), models.fit_ridge(df.where("season <> 1"))
    assert added.training_examples == again.training_examples and added.weights[MODEL_FEATURES[0]] == 0 and added.stds[MODEL_FEATURES[0]] == 1
    for name in ("means", "stds", "weights", "position_weights"):
        ours, theirs = getattr(added, name), getattr(again, name)
        assert ours.keys() == theirs.keys()
        np.testing.assert_allclose(list(ours.values()), list(theirs.values()), atol=1e-9)
    two = models.apply_fold_ridges(df, {0: added, 1: models.ridge_of_seasons(sums, [1], min_examples=10)})
    for season, model in ((0, added), (1, models.ridge_of_seasons(sums, [1], min_examples=10))):
        want = models.apply_ridge(df, model).where(F.col("season") == season).select("learned_weight_projection").toPandas()
        got = two.where(F.col("season") == season).select("learned_weight_projection").toPandas()
        np.testing.assert_allclose(got, want, atol=1e-8)
    assert two.where("season = 2 AND learned_weight_projection IS NOT NULL").count() == 0


def plain_boosting(x, y, trees, depth, rate):
    """Exact greedy trees on all rows and columns, splitting at every value."""
    base, f = y.mean(), np.full(len(y), y.mean())

    def grow(rows, g, level):
        best = (1e-6, None)
        total = g[rows].sum() ** 2 / (len(rows) + 1)
        for j in range(x.shape[1]):
            for c in np.unique(x[rows, j])[:-1]:
                left = rows[x[rows, j] <= c]
                right = rows[x[rows, j] > c]
                gain = g[left].sum() ** 2 / (len(left) + 1) + g[right].sum() ** 2 / (len(right) + 1) - total
                if gain > best[0] + 1e-9:
                    best = (gain, (left, right))
        if level == depth or best[1] is None:
            f[rows] -= rate * g[rows].sum() / (len(rows) + 1) if level else 0
            return
        for part in best[1]:
            grow(part, g, level + 1)

    for _ in range(trees):
        grow(np.arange(len(y)), f - y, 0)
    return base, f


def test_boosting_equals_plain(spark):
    """With few values a column, every row and every column, binned levels give the trees of an exhaustive search; in one or several blocks, for two folds."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, size=(160, 4)).astype(float)
    y = x[:, 0] * 2 + (x[:, 1] > 4) * x[:, 2] + rng.normal(size=160)
    rows = [(f, float(y[i]), *map(float, x[i])) for f, share in ((1, 160), (2, 90)) for i in range(share)]
    df = spark.createDataFrame(rows, "fold int, y double, a double, b double, c double, d double")
    settings = {"maxIter": 6, "maxDepth": 3, "stepSize": 0.3, "subsamplingRate": 1.0, "featureSubsetStrategy": "1.0", "seed": 1}
    for block, every in ((20_000, 25), (30, 2)):
        boosting.BLOCK_ROWS, boosting.CUT_EVERY, old = block, every, (boosting.BLOCK_ROWS, boosting.CUT_EVERY)
        try:
            got = boosting.fit_boosted(df, ["a", "b", "c", "d"], settings)
        finally:
            boosting.BLOCK_ROWS, boosting.CUT_EVERY = old
        for fold, share in ((1, 160), (2, 90)):
            base, want = plain_boosting(x[:share], y[:share], 6, 3, 0.3)
            np.testing.assert_allclose(got[fold].base, base, atol=1e-9)
            np.testing.assert_allclose(got[fold].score(x[:share]), want, atol=1e-6)


def test_boosting_tasks_follow_the_cluster():
    """A level is a job: its tasks do not grow with the rows until a task would hold too many."""
    assert boosting.task_count(100, 12) == 1
    assert boosting.task_count(5_000_000, 12) == boosting.task_count(30_000_000, 12) == 12
    assert boosting.task_count(10**9, 12) == 252


def test_boosting_measures_smaller_children():
    """Of two children only the smaller is summed over rows; the other is the parent's sums less those."""
    rng = np.random.default_rng(3)
    n, k = 500, 3
    block = boosting._Block(0, rng.integers(0, 9, (k, n)).astype(np.uint8), rng.normal(size=n), rng.integers(0, 2**62, n).astype(np.uint64), np.zeros(n))
    feature, cut, value = np.full(15, -1), np.zeros(15, np.int64), np.zeros(15)
    whole, asked, measured = None, [0], []
    for level in range(3):
        first = 2**level - 1
        every = list(range(first, 2 * first + 1))
        seen = block.grow(feature, cut, asked, np.arange(k), 0, 0.7, 1)
        measured.append(int(seen[1, :, 0].sum()))
        whole = boosting._level(seen, asked, whole, first)
        np.testing.assert_allclose(whole, block.grow(feature, cut, every, np.arange(k), 0, 0.7, 1), atol=1e-12)
        asked = boosting._splits(whole, feature, cut, value, first, np.arange(k), 0.1)
        assert len(asked) == len(every)
    assert max(measured[1:]) <= measured[0] / 2


def test_boosting_shares_bytes():
    """Features of few bins share a byte, and a level's sums are those of a byte a feature, by one or two bytes a pass."""
    rng = np.random.default_rng(8)
    counts, n = [64, 3, 14, 64, 8, 23, 1, 11, 3, 256], 60_000
    layout = boosting._Layout.of(counts)
    assert len(layout.groups) < len(counts) and all(layout.cells(g) <= 256 for g in range(len(layout.groups)))
    bins = np.stack([rng.integers(0, c, n) for c in counts]).astype(np.uint8)
    codes = layout.packed(bins)
    columns = boosting._Columns(codes, layout)
    assert all((columns[j] == bins[j]).all() for j in range(len(counts)))
    few, counts = [0, 1, 2, 3, 4, 5, 6, 7, 8], counts[:9]
    layout, bins = boosting._Layout.of(counts), bins[:9]
    y, ids = rng.normal(size=n), rng.integers(0, 2**32, n).astype(np.uint32)
    plain, packed = boosting._Block(0, bins, y, ids), boosting._Block(0, layout.packed(bins), y, ids, layout=layout)
    feature, cut = np.full(15, -1), np.zeros(15, np.int64)
    feature[[0, 1, 2, 4]], cut[[0, 1, 2, 4]] = [0, 4, 1, 5], [30, 3, 0, 9]
    assert (plain.ends(feature, cut) == packed.ends(feature, cut)).all() and len(np.unique(packed.ends(feature, cut))) == 5
    for nodes in ([0], [1], [3, 5], [3, 5, 6, 9]):
        for chosen in (np.array(few), np.array([1, 3, 6])):
            split = np.where(np.isin(np.arange(15), [0, 1, 2, 4][: len(nodes)]) & (len(nodes) > 1) | (np.arange(15) < nodes[0]), feature, -1)
            want, got = (b.grow(split, cut, nodes, chosen, 3, 0.85, 42) for b in (plain, packed))
            np.testing.assert_allclose(got, want, atol=1e-9)
            assert want[1].sum() > 0


def test_fold_stats_are_made_once(spark, monkeypatch):
    """Stats that pairs and matchup read are stored and read back."""
    from sideline.plans import bindings, live, queries

    sf, tags, plain = "/root/testdata/sf0.001", [], live.stored
    monkeypatch.setattr(live, "stored", lambda df, tag: tags.append(tag) or plain(df, tag))
    pairs = live.fold_pairs(bindings.usage(spark, sf), bindings.schedule(spark, sf), {2001: [1999, 2000]}, dense=queries.DENSE_METRICS)
    assert tags == ["fold-stats"] and "l_quantity" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_tree_rows_are_made_once(spark, monkeypatch):
    """Rows that are fitted and scored are stored and read back."""
    from sideline.plans import queries

    tags, plain = [], queries.stored
    monkeypatch.setattr(queries, "stored", lambda df, tag: tags.append(tag) or plain(df, tag))
    monkeypatch.setattr(models, "fit_trees", lambda rows, season: None)
    scores = queries.gbt_scores(spark, "/root/testdata/sf0.001")
    assert tags == ["tree-rows"] and "Window" not in scores._jdf.queryExecution().executedPlan().toString()


def test_fold_trees(spark, examples):
    """Folds grown together score only their own season; sampling is repeatable."""
    df = examples[0].withColumn("season", (F.monotonically_increasing_id() % 3).cast("int"))
    settings = {**models.TREE_SETTINGS, "maxIter": 4, "stepSize": 0.3}
    folds = {1: [0], 2: [0, 1], 7: [9]}
    grown = models.fit_fold_trees(df, folds, settings=settings, min_examples=100)
    assert set(grown) == {1, 2} and grown[2].training_examples == df.where("season < 2").count()
    out = models.apply_fold_trees(df, grown)
    assert out.where("season = 0 AND ml_projection IS NOT NULL").count() == 0 and out.where("season > 0 AND ml_projection IS NULL").count() == 0
    again = models.fit_fold_trees(df, {2: [0, 1]}, settings=settings, min_examples=100)[2]
    x = np.random.default_rng(0).normal(size=(50, len(again.features))) * 5
    np.testing.assert_allclose(again.model.score(x), grown[2].model.score(x), atol=1e-9)
    assert models.fit_fold_trees(df, {2: [0, 1], 7: [9]}, settings=settings, min_examples=1000) == {}


def test_too_little_data(examples):
    df = examples[0]
    assert models.fit_ridge(df.limit(100)) is None
    assert models.fit_ridge(df.select("position", "target_next_week", *MODEL_FEATURES[:3])) is None


def test_trees(spark, examples, tmp_path):
    df, _, _, y, _ = examples
    trees = models.fit_trees(df, 2024, settings={**models.TREE_SETTINGS, "maxIter": 5, "stepSize": 0.3})
    trees.save(spark, str(tmp_path / "trees"))
    again = models.TreeModel.load(spark, str(tmp_path / "trees"))
    assert again.metadata() == trees.metadata()
    scored = models.apply_trees(df, again).select("ml_projection", "target_next_week").toPandas()
    assert (scored["ml_projection"] >= 0).all()
    error = (scored["ml_projection"] - np.maximum(0, scored["target_next_week"])).abs().mean()
    assert error < np.abs(np.maximum(0, y) - np.maximum(0, y).mean()).mean()
    assert models.apply_trees(df, None).where("ml_projection IS NOT NULL").count() == 0


def test_design_matrix_cleans(spark):
    df = spark.createDataFrame([(float("inf"), None, "wr"), (float("nan"), 2.0, None)], "targets_last double, trend_gap double, position string")
    got = [tuple(r) for r in models.design_matrix(df, ["targets_last", "trend_gap", "td_dependency", "position_wr"]).collect()]
    assert got == [(0.0, 0.0, 0.0, 1.0), (0.0, 2.0, 0.0, 0.0)]


def test_metrics_by_overlapping_group(spark):
    df = spark.createDataFrame(
        [("QB", 10.0, 7.0, None), ("WR", 5.0, 11.0, 4.0), ("K", 3.0, 3.0, 3.0), ("WR", None, 1.0, 1.0)],
        "position string, target_next_week double, baseline_projection double, learned_weight_projection double",
    )
    got = {(r.position, r.model): r for r in evaluate.forecast_metrics(df).collect()}
    assert len(got) == 12
    base = got[evaluate.OFFENSE_LABEL, "Baseline projection"]
    assert (base.examples, base.mae, base.bias, base.within_3_points, base.within_5_points) == (2, 4.5, 1.5, 0.5, 0.5)
    assert got[evaluate.ALL_RECORDS, "Baseline projection"].examples == 3
    empty = got["TE", "Baseline projection"]
    assert empty.examples == 0 and empty.mae is None
    assert got["QB", "Machine Learned Weight Values"].examples == 0


@pytest.mark.parametrize("n", [1, 2, 7, 10, 30001, 40000])
def test_exact_medians(spark, monkeypatch, n):
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.3, 1.25, rng.normal(size=n) * 10)  # a third of the rows share one value
    groups = rng.integers(0, 2, size=n)
    df = spark.createDataFrame(list(zip(map(str, groups), map(float, values))), "g string, v double")
    df = df.union(spark.createDataFrame([("0", None), ("nulls", None)], df.schema)).persist()
    for small in (10_000, 20):
        monkeypatch.setattr(quantiles, "SMALL", small)
        got = quantiles.exact_medians(df, "v", "g")
        for g in set(map(int, groups)):
            assert got[str(g)] == pytest.approx(float(np.median(values[groups == g])), abs=1e-12)
        assert got["nulls"] is None and set(got) == {*map(str, set(groups.tolist())), *("0", "nulls")}
        assert quantiles.exact_medians(df, "v") == {None: pytest.approx(float(np.median(values)), abs=1e-12)}
    assert quantiles.exact_medians(df.limit(0), "v") == {}


def test_exact_median_missed_bracket(spark, monkeypatch):
    """A cut beside the middle is noticed and taken back; few values with many rows end too."""
    narrow, calls = quantiles._Bracket.narrow, []

    def miss(self, q, below, inside):
        narrow(self, q, below, inside)
        calls.append(self.slack)
        if len(calls) == 1:
            self.low, self.high = q[-3], q[-2]

    monkeypatch.setattr(quantiles, "SMALL", 20)
    monkeypatch.setattr(quantiles._Bracket, "narrow", miss)
    df = spark.range(5000).select((F.col("id") * F.col("id") % 4999).cast("double").alias("v"))
    assert quantiles.exact_medians(df, "v")[None] == float(np.median([i * i % 4999 for i in range(5000)])) and calls[1] == 2
    two = spark.range(4000).select(F.when(F.col("id") < 2000, 1.0).otherwise(2.0).alias("v"))
    assert quantiles.exact_medians(two, "v")[None] == 1.5


def test_folds():
    assert fold_table([2024])[0] == ([2017, 2018, 2019, 2020, 2021, 2022, 2023], 2024)
    assert fold_table([2001], earliest=1999)[0][0] == [1999, 2000]
    assert fold_table([2001])[0][0] == list(range(1994, 2001))


def test_backtest_has_no_carryover(spark):
    rows = [("p", s, w, "QB", float(w), 1.0) for s in (2023, 2024) for w in range(1, 5)]
    df = spark.createDataFrame(rows, "player_id string, season int, week int, position string, fantasy_points_std double, td_points double")
    got = evaluate.backtest(df, dense=()).orderBy("season", "target_week").collect()
    assert [(r.season, r.target_week) for r in got] == [(s, w) for s in (2023, 2024) for w in (2, 3, 4)]
    assert got[0].baseline_projection == pytest.approx(got[3].baseline_projection)
    summary = evaluate.backtest_summary(evaluate.backtest(df, dense=())).first()
    assert summary.examples == 6 and summary.within_5 == 1.0
