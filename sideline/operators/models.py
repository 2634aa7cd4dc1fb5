"""Learned forecasts: an auditable ridge regression from season sums, and boosted trees."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sideline.functions.numeric import as_double, finite_or_zero
from sideline.operators.boosting import Trees, fit_boosted, nodes_table, trees_of
from sideline.operators.statistics import SeasonSums, season_sums, solve_ridge
from sideline.schemas import MODEL_FEATURES, OFFENSE, SCORING_VERSION

# fixed values
RIDGE_PENALTY = 12.0
MIN_FEATURES = 5
MIN_EXAMPLES = 500
TREE_SETTINGS = {"maxIter": 350, "maxDepth": 5, "stepSize": 0.035, "subsamplingRate": 0.85,
                 "featureSubsetStrategy": "0.85", "seed": 42}
POSITION_FEATURES = {f"position_{p.lower()}": p for p in OFFENSE}


def _position(df: DataFrame) -> Column:
    return F.upper(F.coalesce(F.col("position"), F.lit(""))) if "position" in df.columns else F.lit("")


def _clean(df: DataFrame, feature: str) -> Column:
    if feature not in df.columns:
        return F.lit(0.0)
    return finite_or_zero(as_double(F.col(feature)))


def design_columns(df: DataFrame, features: Sequence[str] | None = None) -> tuple[dict[str, Column], list[str]]:
    """Cleaned inputs and position flags by name, and the names in order."""
    if features is None:
        features = [f for f in MODEL_FEATURES if f in df.columns] + list(POSITION_FEATURES)
    columns = {}
    for f in features:
        if f in POSITION_FEATURES:
            columns[f] = F.when(_position(df) == POSITION_FEATURES[f], 1.0).otherwise(0.0)
        else:
            columns[f] = _clean(df, f)
    return columns, list(features)


def design_matrix(df: DataFrame, features: Sequence[str] | None = None, *, keep: Sequence[str] = ()) -> DataFrame:
    """Model inputs as plain columns next to the columns in ``keep``."""
    columns, names = design_columns(df, features)
    return df.select(*keep, *[columns[n].alias(n) for n in names])


@dataclass(frozen=True)
class RidgeModel:
    """Weights on population-standardised features plus one shift per position."""

    features: list[str]
    means: dict[str, float]
    stds: dict[str, float]
    weights: dict[str, float]
    intercept: float
    position_weights: dict[str, float]
    training_examples: int = 0
    scoring_version: str = SCORING_VERSION
    extra: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(
            {
                "version": 1, "model_type": "ridge_regression", "scoring_version": self.scoring_version,
                "training_examples": self.training_examples, "features": self.features,
                "feature_means": self.means, "feature_stds": self.stds, "feature_weights": self.weights,
                "intercept": self.intercept, "position_weights": self.position_weights,
            },
            indent=2, sort_keys=True,
        )

    @classmethod
    def from_json(cls, text: str, *, scoring_version: str = SCORING_VERSION) -> RidgeModel | None:
        """The stored model, or null when it is incomplete or made for other scoring rules."""
        try:
            d = json.loads(text)
            if d.get("scoring_version") != scoring_version:
                return None
            return cls(
                list(d["features"]), dict(d["feature_means"]), dict(d["feature_stds"]),
                dict(d["feature_weights"]), float(d["intercept"]), dict(d["position_weights"]),
                int(d.get("training_examples", 0)), d["scoring_version"],
            )
        except (ValueError, TypeError, KeyError):
            return None

    def save(self, spark: SparkSession, path: str) -> None:
        """One-row text dataset, so it lives wherever the other tables live."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").option(
            "lineSep", "\x00"
        ).text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, *, scoring_version: str = SCORING_VERSION) -> RidgeModel | None:
        try:
            rows = spark.read.text(path, wholetext=True).take(1)
        except Exception as exc:  # the path does not exist yet
            if "PATH_NOT_FOUND" in str(exc):
                return None
            raise
        return cls.from_json(rows[0][0].rstrip("\x00"), scoring_version=scoring_version) if rows else None

    def report(self, spark: SparkSession) -> DataFrame:
        """Weights by size with their direction."""
        rows = [("metric", n, float(w)) for n, w in self.weights.items()]
        rows += [("position_adjustment", n, float(w)) for n, w in self.position_weights.items()]
        df = spark.createDataFrame(rows, "kind string, name string, learned_standardized_weight double")
        w = F.col("learned_standardized_weight")
        return df.select(
            "*", F.abs(w).alias("absolute_weight"),
            F.when(w >= 0, "raises projection").otherwise("lowers projection").alias("direction"),
        ).orderBy(F.desc("absolute_weight"), "name")


def fit_ridge(
    train: DataFrame, *, target: str = "target_next_week", penalty: float = RIDGE_PENALTY,
    min_examples: int = MIN_EXAMPLES,
) -> RidgeModel | None:
    """Ridge with an unpenalised intercept; null when there is too little to learn from. One pass over the data."""
    return ridge_of_seasons(season_products(train, target=target, by=None), [None], penalty=penalty, min_examples=min_examples)


def season_products(rows: DataFrame, *, target: str = "target_next_week", by: str | None = "season") -> SeasonSums:
    """The products that every ridge over some of the seasons needs: inputs, position flags and target, per season."""
    rows = rows.where(F.col(target).isNotNull())
    columns = {f: _clean(rows, f) for f in MODEL_FEATURES if f in rows.columns}
    columns |= {name: F.when(_position(rows) == p, 1.0).otherwise(0.0) for name, p in POSITION_FEATURES.items()}
    columns["_y"] = F.col(target).cast("double")
    keep = [by] if by else []
    return season_sums(rows.select(*keep, *[c.alias(n) for n, c in columns.items()]), list(columns), by)


def ridge_of_seasons(
    sums: SeasonSums, seasons: Iterable[int | None], *, penalty: float = RIDGE_PENALTY, min_examples: int = MIN_EXAMPLES
) -> RidgeModel | None:
    """The ridge over some seasons: their matrices added and solved, without another pass over the rows."""
    features = [n for n in sums.names if n not in POSITION_FEATURES and n != "_y"]
    total = sums.add(seasons)
    if len(features) < MIN_FEATURES or total[0, 0] < max(min_examples, 1):
        return None
    flags = {p: 1 + sums.names.index(name) for name, p in POSITION_FEATURES.items()}
    seen = sorted(p for p, at in flags.items() if total[0, at] > 0) or sorted(flags)
    fit = solve_ridge(total, len(features), [flags[p] for p in seen], penalty)
    by_name = lambda values: dict(zip(features, map(float, values), strict=False))
    stds = np.where(fit.stds > 0, fit.stds, 1.0)
    positions = dict(zip(seen, map(float, fit.weights[len(features) :]), strict=True))
    return RidgeModel(features, by_name(fit.means), by_name(stds), by_name(fit.weights), fit.intercept, positions, fit.n)


def apply_ridge(df: DataFrame, model: RidgeModel | None, *, scoring_version: str = SCORING_VERSION) -> DataFrame:
    """Add ``learned_weight_projection`` (floored at 0); a model for other rules is not applied."""
    if model is None or model.scoring_version != scoring_version:
        return df
    score = F.lit(model.intercept)
    for f in model.features:
        score = score + (_clean(df, f) - model.means[f]) / max(model.stds[f], 1e-9) * model.weights[f]
    for p, w in model.position_weights.items():
        score = score + F.when(_position(df) == p, w).otherwise(0.0)
    return df.withColumn("learned_weight_projection", F.greatest(F.lit(0.0), score))


def apply_fold_ridges(df: DataFrame, ridges: Mapping[int, RidgeModel], *, by: str = "season") -> DataFrame:
    """Add ``learned_weight_projection`` with the model of each row's ``by``; null where there is none. One pass, whatever the folds."""
    if not ridges:
        return df
    names = sorted({f for m in ridges.values() for f in m.features})
    rows = []
    for season, m in ridges.items():
        scaled = {f: m.weights[f] / max(m.stds[f], 1e-9) for f in m.features}
        start = m.intercept - sum(m.means[f] * w for f, w in scaled.items())
        rows.append((int(season), [start, *(scaled.get(f, 0.0) for f in names), *(m.position_weights.get(p, 0.0) for p in OFFENSE)]))
    weights = F.broadcast(df.sparkSession.createDataFrame(rows, "_fold long, _weights array<double>"))  # a row a fold
    inputs = F.array(F.lit(1.0), *(_clean(df, f) for f in names), *(F.when(_position(df) == p, 1.0).otherwise(0.0) for p in OFFENSE))
    both = df.withColumn("_inputs", inputs).join(weights, F.col(by).cast("long") == F.col("_fold"), "left")
    score = F.aggregate(F.zip_with("_inputs", "_weights", lambda x, w: x * w), F.lit(0.0), lambda a, v: a + v)
    return both.withColumn("learned_weight_projection", F.when(F.col("_fold").isNotNull(), F.greatest(F.lit(0.0), score))).drop("_inputs", "_fold", "_weights")


@dataclass(frozen=True)
class TreeModel:
    model: Trees
    features: list[str]
    training_examples: int
    trained_for_season: int
    scoring_version: str = SCORING_VERSION

    def metadata(self) -> dict:
        return {
            "features": self.features, "training_examples": self.training_examples,
            "trained_for_season": self.trained_for_season, "scoring_version": self.scoring_version,
            "model_type": "boosted trees direct next-week forecast",
        }

    def save(self, spark: SparkSession, path: str) -> None:
        """The nodes as a table and one row of metadata, which is written last: a model without it is not seen."""
        nodes_table(spark, self.model, self.features).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        spark.createDataFrame([(json.dumps(self.metadata()),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str, *, scoring_version: str = SCORING_VERSION) -> TreeModel | None:
        try:
            rows = spark.read.text(f"{path}/metadata").take(1)
        except Exception as exc:
            if "PATH_NOT_FOUND" in str(exc):
                return None
            raise
        meta = json.loads(rows[0][0])
        if meta.get("scoring_version") != scoring_version or not meta.get("features"):
            return None
        return cls(
            trees_of(spark.read.parquet(f"{path}/model"), meta["features"]), meta["features"], meta["training_examples"],
            meta["trained_for_season"], meta["scoring_version"],
        )


def fit_fold_trees(
    rows: DataFrame, folds: Mapping[int, Sequence[int] | None], *, target: str = "target_next_week", by: str = "season",
    settings: Mapping[str, object] = TREE_SETTINGS, min_examples: int = MIN_EXAMPLES,
) -> dict[int, TreeModel]:
    """Boosted trees of every fold (holdout season -> training seasons, null for all rows), grown together, a job a level.

    Squared error on the same inputs as the ridge. A fold with too little to learn from has no model. The rows are read twice:
    store them first where they take long to make.
    """
    rows = rows.where(F.col(target).isNotNull())
    columns, names = design_columns(rows)
    if len(names) < MIN_FEATURES:
        return {}
    uses = F.array_compact(F.array(*[F.when(F.lit(True) if seasons is None else F.col(by).isin(list(seasons)), F.lit(int(h))) for h, seasons in folds.items()]))
    matrix = rows.select(F.explode(uses).alias("fold"), F.col(target).cast("double").alias("y"), *[columns[n].alias(n) for n in names])
    grown = fit_boosted(matrix, names, settings, min_examples)
    return {h: TreeModel(trees, names, trees.rows, h) for h, trees in grown.items()}


def fit_trees(
    train: DataFrame, season: int, *, target: str = "target_next_week",
    settings: Mapping[str, object] = TREE_SETTINGS, min_examples: int = MIN_EXAMPLES,
) -> TreeModel | None:
    """Boosted trees on all rows, for one season to come; null when there is too little to learn from."""
    return fit_fold_trees(train, {season: None}, target=target, settings=settings, min_examples=min_examples).get(season)


def apply_fold_trees(df: DataFrame, trees: Mapping[int, TreeModel], *, by: str | None = "season") -> DataFrame:
    """Add ``ml_projection`` with the trees of each row's ``by`` (or of the only fold); null where there are none. One pass."""
    spark = df.sparkSession
    names = list(next(iter(trees.values())).features)
    columns, _ = design_columns(df, names)
    shared = spark.sparkContext.broadcast({h: m.model for h, m in trees.items()})  # nodes of the trees: a size set by the settings

    @F.pandas_udf("double")
    def score(fold: pd.Series, x: pd.DataFrame) -> pd.Series:
        values, out = x.to_numpy(float), np.full(len(x), np.nan)
        for h, model in shared.value.items():
            mine = np.flatnonzero(fold.to_numpy() == h)
            out[mine] = np.maximum(model.score(values[mine]), 0)
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    fold = F.coalesce(F.col(by).cast("int"), F.lit(-1)) if by else F.lit(next(iter(trees)))
    return df.withColumn("ml_projection", score(fold, F.struct(*[columns[n].alias(n) for n in names])))


def apply_trees(df: DataFrame, trees: TreeModel | None, *, scoring_version: str = SCORING_VERSION) -> DataFrame:
    """Add ``ml_projection`` (floored at 0), or null where no valid model exists."""
    if trees is None or trees.scoring_version != scoring_version:
        return df.withColumn("ml_projection", F.lit(None).cast("double"))
    return apply_fold_trees(df, {trees.trained_for_season: trees}, by=None)
