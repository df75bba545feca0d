"""Numeric coercion of ids and amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTEGER_TEXT = r"^[+-]?[0-9]+$"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lenient_double(col: str | Column) -> Column:
    """Numeric cast, unparsable → NULL."""
    return _c(col).try_cast("double")


def id_value(raw: str | Column, default: int | None = 0) -> Column:
    """P8 value: NULL/''/blank → ``default``; an integer text (spaces allowed) → BIGINT; otherwise NULL.

    Pair with :func:`id_error` to reject what the reference rejects
    (fractional, boolean and non-numeric text).
    """
    t = F.trim(_c(raw).cast("string"))
    dflt = F.lit(default).cast("bigint")
    return (
        F.when(t.isNull() | (t == ""), dflt)
        .when(t.rlike(_INTEGER_TEXT), t.try_cast("bigint"))
        .otherwise(F.lit(None).cast("bigint"))
    )


def id_error(raw: str | Column) -> Column:
    """P8 rejection reason, NULL when the value is acceptable."""
    t = F.trim(_c(raw).cast("string"))
    return (
        F.when(t.isNull() | (t == ""), F.lit(None).cast("string"))
        .when(t.rlike(_INTEGER_TEXT) & t.try_cast("bigint").isNotNull(), F.lit(None).cast("string"))
        .otherwise(F.lit("non-numeric id"))
    )
