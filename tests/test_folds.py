"""What the folds store."""

from sideline.plans import live, queries
from sideline.schemas import MODEL_FEATURES

SF = "/root/testdata/sf0.001"


def test_fold_rows_are_narrow(spark, monkeypatch):
    """Only what models and reports read is computed and stored, not the features that no model takes."""
    kept = []
    monkeypatch.setattr(queries, "stored", lambda df, tag: kept.append(df.columns) or df)
    queries.fold_ridge_metrics(spark, SF)
    monkeypatch.setattr(live, "stored", lambda df, tag: kept.append(df.columns) or df)
    live.fold_reports(queries.forecast.project(queries.pairs(spark, SF)), {2001: list(range(1995, 2001))}, tree_settings=None)
    wanted = {"season", "position", "target_next_week", "baseline_projection", *MODEL_FEATURES}
    assert len(kept) == 2 and all(set(columns) == wanted - {"opponent_points_allowed_per_game"} for columns in kept)
