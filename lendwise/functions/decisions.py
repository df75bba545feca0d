"""Decision bands and probability rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decision labels and band thresholds of the scoring service.
DENIED = "Negado"
MANUAL_REVIEW = "Revisão Manual"
APPROVED = "Aprovado"
DENY_ABOVE = 0.5
REVIEW_ABOVE = 0.3


def decision_band(prob: str | Column, deny_above: float = DENY_ABOVE, review_above: float = REVIEW_ABOVE) -> Column:
    """Band of the *unrounded* probability: > deny → Negado, > review → Revisão Manual, else Aprovado.

    A NULL probability gives NULL (no decision).
    """
    p = F.col(prob) if isinstance(prob, str) else prob
    return (
        F.when(p.isNull(), F.lit(None).cast("string"))
        .when(p > deny_above, F.lit(DENIED))
        .when(p > review_above, F.lit(MANUAL_REVIEW))
        .otherwise(F.lit(APPROVED))
    )


def rounded_probability(prob: str | Column, places: int = 4) -> Column:
    """P20: probability rounded to ``places`` decimals (HALF_UP)."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return F.round(p, places)
