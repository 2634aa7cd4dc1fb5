"""The transparent forecast: projection, range, confidence, labels and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sideline.functions.numeric import (
    SLACK, above, at_least, at_most, below, clip, finite_or_zero, floor_zero, row_std, zero_if_null,
)

# fixed values
RANGE_WIDTH = 1.15
DEFAULT_VOLATILITY = 4.0
FALLBACK_REASON = "Projection primarily follows recent baseline"
SIGNAL_TEXT = {
    "Emerging opportunity": "Opportunity is rising faster than production (opportunity momentum > 2 and trend gap > 1).",
    "TD-dependent production": "Recent scoring relies heavily on touchdowns.",
    "Downtrend confirmed": "Role/usage is declining and fantasy production is falling with it.",
    "Momentum confirmed": "Role/usage is improving and fantasy production is already following it.",
    "Efficiency / regression watch": "Production is rising while opportunity is falling.",
    "Stable": "No confirmed overall trend. Individual chips can still show a recent production or usage move"
    " when the evidence is mixed, modest, or does not meet a combined rule.",
}


def _level(name: str) -> Column:
    """Value a threshold is applied to: missing counts 0."""
    return zero_if_null(F.col(name))


def baseline(df: DataFrame) -> DataFrame:
    """Recency-weighted points, a bounded opportunity nudge and a touchdown-dependence penalty.

    The season-level term is the EWMA as well, so the EWMA weighs .60 in all.
    """
    ewma = zero_if_null(F.col("fantasy_points_ewma"))
    roll3 = F.coalesce(F.col("fantasy_points_roll3"), ewma)
    roll5 = F.coalesce(F.col("fantasy_points_roll5"), ewma)
    base = 0.45 * ewma + 0.25 * roll3 + 0.15 * roll5 + 0.15 * ewma
    nudge = clip(finite_or_zero(F.col("opportunity_momentum")) * 0.35, -2.5, 2.5)
    penalty = clip((finite_or_zero(F.col("td_dependency")) - 0.45) * 2.0, 0.0, 2.0)
    return df.withColumn("baseline_projection", F.greatest(F.lit(0.0), base + nudge - penalty))


def recentre_range(df: DataFrame, centre: Column) -> DataFrame:
    """Range around a projection: +- 1.15 volatility, low end floored at 0."""
    spread = RANGE_WIDTH * F.coalesce(F.col("volatility"), F.lit(DEFAULT_VOLATILITY))
    return df.withColumns({"range_low": floor_zero(centre - spread), "range_high": centre + spread})


def uncertainty(df: DataFrame) -> DataFrame:
    """Volatility, range and confidence (withheld under three included games)."""
    points = [F.col(f"fantasy_points_{s}") for s in ("last", "roll2", "roll3", "roll5", "ewma")]
    df = df.withColumn("volatility", row_std(points, DEFAULT_VOLATILITY))
    df = recentre_range(df, F.col("baseline_projection"))
    return df.withColumn("confidence", _confidence()[0])


def _confidence() -> tuple[Column, Column]:
    consistency = clip(12 - F.col("volatility"), -10, 10)
    bonus = clip(zero_if_null(F.col("opportunity_score")), 0, 15)
    raw = 50.0 + consistency + bonus
    return F.when(F.col("games_played") >= 3, clip(raw, 20, 90)), raw


def classify(df: DataFrame) -> DataFrame:
    """Six labels, first rule that holds wins."""
    opp, prod = _level("opportunity_momentum"), _level("production_momentum")
    dep, gap = _level("td_dependency"), _level("trend_gap")
    label = (
        F.when(above(opp, 2) & above(gap, 1), "Emerging opportunity")
        .when(above(dep, 0.55) & above(prod, 0), "TD-dependent production")
        .when(below(prod, -1) & below(opp, -1), "Downtrend confirmed")
        .when(above(prod, 1) & above(opp, 1), "Momentum confirmed")
        .when(above(prod, 1) & below(opp, -1), "Efficiency / regression watch")
        .otherwise("Stable")
    )
    return df.withColumn("classification", label)


def project(features: DataFrame) -> DataFrame:
    """Features to baseline projection, uncertainty and label."""
    return classify(uncertainty(baseline(features)))


def explain(df: DataFrame) -> DataFrame:
    """Up to four reasons in rule order; a fallback when none applies."""
    score, opp = _level("opportunity_score"), _level("opportunity_momentum")
    prod, dep, gap = _level("production_momentum"), _level("td_dependency"), _level("trend_gap")
    reasons = F.array_compact(
        F.array(
            F.when(at_least(score, 12), "Strong recent opportunity")
            .when(at_least(score, 7), "Healthy recent opportunity")
            .when(below(score, 3), "Limited recent opportunity"),
            F.when(at_least(opp, 2), "Role is trending upward").when(at_most(opp, -2), "Role is trending downward"),
            F.when(at_least(gap, 2), "Opportunity rising faster than production"),
            F.when(at_least(prod, 2), "Recent production is improving").when(
                at_most(prod, -2), "Recent production is declining"
            ),
            F.when(at_least(dep, 0.55), "Production has significant TD dependence"),
        )
    )
    return df.withColumn(
        "why",
        F.when(F.size(reasons) == 0, F.array(F.lit(FALLBACK_REASON))).otherwise(F.slice(reasons, 1, 4)),
    )


def signal_chips(df: DataFrame) -> DataFrame:
    """Independent short labels; Stable when none applies."""
    opp, prod, dep = _level("opportunity_momentum"), _level("production_momentum"), _level("td_dependency")
    chips = F.array_compact(
        F.array(
            F.when(above(prod, 1), "Production rising").when(below(prod, -1), "Production falling"),
            F.when(above(opp, 1), "Usage rising").when(below(opp, -1), "Usage falling"),
            F.when(above(dep, 0.55), "TD risk"),
        )
    )
    return df.withColumn("signals", F.when(F.size(chips) == 0, F.array(F.lit("Stable"))).otherwise(chips))


def _tenths(*numbers: Column) -> Column:
    """Numbers as texts of one decimal, halves up; the slack decides halves alike whatever the order of a sum.

    One array passes through one expression: written out per number, a row's code would be longer than what the JVM compiles.
    """
    return F.transform(F.array(*numbers), lambda c: F.format_string("%.1f", F.floor((c + SLACK) * 10 + 0.5) / 10))


def explanation_columns(df: DataFrame) -> DataFrame:
    """Signal text with its component values, and how the confidence came about.

    The raw parts are kept as columns next to the sentences built from them.
    """
    texts = F.create_map(*[F.lit(x) for kv in SIGNAL_TEXT.items() for x in kv])
    label = F.coalesce(F.col("classification"), F.lit("Stable"))
    _, raw = _confidence()
    df = df.withColumns(
        {
            "consistency_part": clip(12 - F.col("volatility"), -10, 10),
            "opportunity_part": clip(zero_if_null(F.col("opportunity_score")), 0, 15),
            "raw_confidence": raw,
            "confidence_bound": F.when(above(raw, 90), "Held at 90%.")
            .when(below(raw, 20), "Held at 20%.")
            .otherwise(""),
        }
    )
    moves = _tenths(*[zero_if_null(F.col(c)) for c in ("opportunity_momentum", "production_momentum", "trend_gap")])
    parts = _tenths(*[F.col(c) for c in ("consistency_part", "opportunity_part", "raw_confidence", "volatility")], zero_if_null(F.col("opportunity_score")))
    df = df.withColumns({"_moves": moves, "_parts": parts})
    signal = F.format_string(
        "%s: %s Momentum of use %s and of points %s, gap %s, touchdown share %d%%.",
        label,
        F.coalesce(F.try_element_at(texts, label), F.lit(SIGNAL_TEXT["Stable"])),
        *[F.col("_moves")[i] for i in range(3)],
        F.floor(zero_if_null(F.col("td_dependency")) * 100 + SLACK + 0.5),
    )
    early = F.format_string(
        "%d games so far; a confidence needs three.",
        F.col("games_played").cast("long"),
    )
    full = F.format_string(
        "50%% and %s for consistency and %s for opportunity make %s%%.%s"
        " Based on a volatility of %s, an opportunity score of %s and %d games.",
        *[F.col("_parts")[i] for i in range(3)],
        F.when(F.col("confidence_bound") != "", F.concat(F.lit(" "), F.col("confidence_bound"))).otherwise(""),
        *[F.col("_parts")[i] for i in (3, 4)], F.col("games_played").cast("long"),
    )
    return df.withColumns(
        {
            "signal_text": signal,
            "confidence_text": F.when(F.col("games_played") < 3, early).otherwise(full),
        }
    ).drop("_moves", "_parts")


def final_projection(df: DataFrame) -> DataFrame:
    """Learned forecast where there is one, else the baseline; the range moves with it."""
    learned = (
        F.col("learned_weight_projection") if "learned_weight_projection" in df.columns else F.lit(None).cast("double")
    )
    df = df.withColumn("projection", F.coalesce(learned, F.col("baseline_projection")))
    if "ml_projection" not in df.columns:
        df = df.withColumn("ml_projection", F.lit(None).cast("double"))
    return recentre_range(df, zero_if_null(F.col("projection")))
