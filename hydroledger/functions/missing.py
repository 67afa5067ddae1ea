"""Missing-value rules of the accounting tables, where Spark's defaults differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nz(x: Column, default: float = 0.0) -> Column:
    """Missing becomes ``default``."""
    return F.coalesce(x, F.lit(default))


def na_if_else(condition: Column, yes: Column, no: Column) -> Column:
    """Two-way choice that is missing where the condition is missing."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, yes).otherwise(no)


def na_if_else_sql(condition: str, yes: str, no: str) -> str:
    """The same choice as SQL, for use inside an aggregate."""
    return f"CASE WHEN ({condition}) IS NULL THEN NULL WHEN {condition} THEN {yes} ELSE {no} END"


def na_concat(*parts: Column | str) -> Column:
    """Join text pieces; a missing piece reads ``NA`` instead of erasing the whole."""
    return F.concat(
        *[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("NA")) for p in parts]
    )


def is_member(x: Column, values) -> Column:
    """Membership that is false, never missing, for a missing value."""
    return F.coalesce(x.isin(*values), F.lit(False))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields missing for a zero divisor instead of failing the job."""
    return F.try_divide(numerator, denominator)


def percent(part: str, whole: str) -> Column:
    """``part`` as a percentage of ``whole``; missing for a zero whole."""
    return F.expr(f"try_divide(100D * {part}, {whole})")


def missing_or_equal(x: Column, value) -> Column:
    """Keep rows an outer join left unmatched, and those equal to ``value``."""
    return x.isNull() | (x == F.lit(value))


def ascending(x: Column) -> Column:
    return x.asc_nulls_last()


def descending(x: Column) -> Column:
    return x.desc_nulls_last()
