"""Evidence scores, tiers and blends as column expressions.

Weights and thresholds below are fixed values of the scoring rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH_FROM, MEDIUM_FROM = 0.75, 0.50

PRIORITY_WEIGHTS = {"recency": 0.30, "frequency": 0.25, "persistence": 0.20, "diversity": 0.25}

EVIDENCE_WEIGHTS = {
    "frequency_score": 0.18,
    "persistence_score": 0.18,
    "recency_score": 0.15,
    "repeated_claim_score": 0.15,
    "repeated_date_score": 0.15,
    "source_diversity_score": 0.08,
    "principal_score": 0.08,
    "prescription_score": 0.03,
}

# The back-test adds the same weighted parts in another order; kept because the
# order of floating-point additions decides the last digit before rounding.
BACKTEST_ORDER = (
    "frequency_score",
    "persistence_score",
    "repeated_claim_score",
    "repeated_date_score",
    "recency_score",
    "source_diversity_score",
    "principal_score",
    "prescription_score",
)


def tier(score: Column) -> Column:
    return F.when(score >= HIGH_FROM, "HIGH").when(score >= MEDIUM_FROM, "MEDIUM").otherwise("LOW")


def saturate(x: Column, full_at: float) -> Column:
    return F.least(x / F.lit(float(full_at)), F.lit(1.0))


def exp_saturation(n: Column, scale: float = 15.0) -> Column:
    return F.lit(1.0) - F.exp(-n / F.lit(scale))


def exp_decay(days: Column, scale: float = 365.0) -> Column:
    return F.exp(-days / F.lit(scale))


def unit_clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))


def round_scaled(x: Column, digits: int) -> Column:
    """Half-even rounding of the scaled value, which is how array libraries round."""
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def blend(recency: Column, frequency: Column, persistence: Column, diversity: Column) -> Column:
    """Four-signal priority, rounded to 3 digits."""
    w = PRIORITY_WEIGHTS
    return F.round(
        F.lit(w["recency"]) * recency
        + F.lit(w["frequency"]) * frequency
        + F.lit(w["persistence"]) * persistence
        + F.lit(w["diversity"]) * diversity,
        3,
    )


def half_year_recency(last: Column, year: int, steps: tuple[float, float, float]) -> Column:
    """Step score by whether the last date falls in the second half, first half, or before ``year``."""
    return (
        F.when(last >= F.lit(f"{year}-07-01").cast("date"), steps[0])
        .when(last >= F.lit(f"{year}-01-01").cast("date"), steps[1])
        .otherwise(steps[2])
    )


def component_scores(reference_date) -> dict[str, Column]:
    """The eight unrounded component scores over the evidence feature columns."""
    days = F.greatest(F.lit(0), F.datediff(F.lit(reference_date).cast("date"), F.col("last_evidence_date")))
    return {
        "frequency_score": exp_saturation(F.col("diagnosis_count")),
        "recency_score": exp_decay(days),
        "persistence_score": saturate(F.col("distinct_evidence_months"), 4),
        "repeated_claim_score": saturate(F.col("unique_claim_count"), 3),
        "repeated_date_score": saturate(F.col("distinct_evidence_dates"), 5),
        "source_diversity_score": saturate(F.col("distinct_sources"), 2),
        "principal_score": saturate(F.col("principal_diagnosis_count"), 2),
        "prescription_score": saturate(F.col("prescription_support_count"), 2),
    }


def weighted_sum(parts: dict[str, Column], order=None) -> Column:
    total = F.lit(0.0)
    for name in order or EVIDENCE_WEIGHTS:
        total = total + parts[name] * F.lit(EVIDENCE_WEIGHTS[name])
    return total


def gap_urgency(gap_type: Column, context: Column) -> Column:
    return (
        F.when(F.upper(gap_type) == "EMERGING", 1.0)
        .when(F.upper(context) == "STILL_ABSENT", 0.85)
        .otherwise(0.65)
    )


def expected_priority(probabilities: Column) -> Column:
    """``p · [0, 0.5, 1]`` over a (LOW, MEDIUM, HIGH) probability array."""
    return F.get(probabilities, F.lit(1)) * 0.5 + F.get(probabilities, F.lit(2)) * 1.0


def argmax_label(probabilities: Column, labels) -> Column:
    """Label of the largest probability; the first one wins ties."""
    return F.element_at(
        F.array(*[F.lit(x) for x in labels]),
        F.array_position(probabilities, F.array_max(probabilities)).cast("int"),
    )
