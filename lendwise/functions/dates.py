"""Date expressions: lenient/strict parsing, lateness and ages.

All are ``Column`` builders; they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: days assigned to an unpaid instalment.
UNPAID_DAYS = 999


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lenient_date(col: str | Column) -> Column:
    """Parse to DATE, unparsable → NULL (works on string, date or timestamp input)."""
    # try_to_timestamp follows cast rules and yields NULL instead of an ANSI error.
    return F.to_date(F.try_to_timestamp(_c(col).cast("string")))


def strict_date(col: str | Column) -> Column:
    """Parse to DATE; a malformed value raises under ANSI mode."""
    return F.to_date(_c(col))


def days_late(paid: str | Column, due: str | Column) -> Column:
    """Whole days between due and paid date (``paid - due``), NULL if either is NULL."""
    return F.datediff(_c(paid), _c(due))


def days_late_filled(paid: str | Column, due: str | Column, unpaid_days: int = UNPAID_DAYS) -> Column:
    """P3 + P4: days late with an unpaid (or unparsable) instalment counted as ``unpaid_days``."""
    return F.coalesce(days_late(paid, due), F.lit(unpaid_days))


def age_floor_days(decision: str | Column, birth: str | Column) -> Column:
    """``(decision - birth).days // 365`` with floor division (negative ages floor down)."""
    return F.floor(F.datediff(_c(decision), _c(birth)) / F.lit(365)).cast("int")


def calendar_age(birth: str | Column, ref_day: str | Column) -> Column:
    """Completed years at ``ref_day``: year difference minus one before the birthday."""
    b, d = _c(birth), _c(ref_day)
    before = (F.month(d) < F.month(b)) | ((F.month(d) == F.month(b)) & (F.dayofmonth(d) < F.dayofmonth(b)))
    return (F.year(d) - F.year(b) - before.cast("int")).cast("int")


def year_difference(birth: str | Column, ref_day: str | Column) -> Column:
    """Age by subtracting calendar years only."""
    return (F.year(_c(ref_day)) - F.year(_c(birth))).cast("int")


def date_of(df, name: str) -> Column:
    """P1 on a frame's column: DATE as is, TIMESTAMP truncated, text parsed leniently."""
    from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

    dtype = df.schema[name].dataType
    if isinstance(dtype, DateType):
        return F.col(name)
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return F.to_date(F.col(name))
    return lenient_date(name)
