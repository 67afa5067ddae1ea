"""Sums that do not depend on row order, partitioning or task retries.

Adding doubles gives different last bits for every shuffle layout.  Here values are added
as decimals: a double counts as the shortest decimal that reads back as it, to 18
places.  A partial sum stays a DECIMAL(38,18) column, so that a sum of partial sums is
the sum of the rows; it becomes a double only where it is reported.  Totals may reach
1e20 (1e19 where rows are counted); beyond that the job fails instead of wrapping.

Where a measure's decimals are known (``places``), the same sum is taken over whole
numbers: high and low halves as BIGINT, which stay in generated code, meet in a decimal
once per group.

No value is lost in silence.  Each row is checked in the expression that is added up, so
the check costs no aggregate: a value that the places change by more than a part in 10^9
(18 places) or 10^14 (declared places) fails the job, and so does one that they would
turn into zero.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type of partial sums.
EXACT = "decimal(38,18)"
# Below this, 18 places can change a value by more than a part in 10^9.
_SMALL, _CHANGE = "5e-10D", "1e-9D"
# What the declared decimals may differ by from the double that stands for them, of itself.
_FINER = "1e-14D"
# A value's whole and broken parts, each times a count of equal rows, fit 38 digits.
_VALUE, _WHOLE, _PART, _COPIES = "decimal(37,18)", "decimal(19,0)", "decimal(19,18)", "decimal(13,0)"
_LOW_BITS = 24
_LOW_MASK = (1 << _LOW_BITS) - 1


def fixed(x: Column, places: int) -> Column:
    """Double nearest to ``x`` rounded to ``places`` decimals."""
    scale = float(10**places)
    return F.rint(x * scale) / scale


def exact(x: Column | str) -> Column:
    """A value as an exact decimal, ready to be added up."""
    return (F.col(x) if isinstance(x, str) else x).cast(EXACT)


def exact_sum(x: str, places: int | None = None) -> Column:
    """Sum of a column or SQL expression as a decimal, skipping missing values.

    Missing when there is nothing to add.  ``places`` declares a double's decimals.
    """
    return F.expr(_sum_sql(x, places))


def nz_exact_sum(x: str, places: int | None = None) -> Column:
    """Sum as a decimal, zero when there is nothing to add."""
    return F.expr(f"coalesce({_sum_sql(x, places)}, cast(0 AS {EXACT}))")


def nz_sum(x: str, copies: str | None = None) -> Column:
    """Sum as a double, skipping missing values; zero when there is nothing to add.

    ``copies`` names a column telling how many equal rows each row stands for.
    """
    total = _counted_sql(x, copies) if copies else _sum_sql(x)
    return F.expr(f"coalesce(cast({total} AS double), 0D)")


def _fail(x: str, why: str) -> str:
    """An error that names the expression."""
    name = x.replace("\\", "").replace("'", '"')
    return f"raise_error('{why}: {name}')"


def _decimal_sql(x: str, kind: str = EXACT) -> str:
    """A value as a decimal; an error where the places change it noticeably.

    What is a partial sum already is exact: its type is known when the query is planned,
    and the check falls away.
    """
    value = f"cast({x} AS {kind})"
    changed = (
        f"typeof({x}) != '{EXACT}' AND abs({x}) < {_SMALL} "
        f"AND abs(cast({value} AS double) - {x}) > {_CHANGE} * abs({x})"
    )
    fail = _fail(x, "a value is too small for 18 decimal places")
    return f"CASE WHEN {changed} THEN {fail} ELSE {value} END"


def _sum_sql(x: str, places: int | None = None) -> str:
    if places is None:
        return f"sum({_decimal_sql(x)})"
    scaled = f"({x} * 1e{places}D)"
    finer = f"abs({scaled} - rint({scaled})) > {_FINER} * abs({scaled})"
    fail = _fail(x, f"more than {places} decimal places")
    units = f"cast(rint({scaled}) AS bigint)"
    # One check serves both halves.
    checked = f"CASE WHEN {finer} THEN {fail} ELSE shiftright({units}, {_LOW_BITS}) END"
    high = f"cast(sum({checked}) AS decimal(28,0))"
    low = f"cast(sum({units} & {_LOW_MASK}L) AS decimal(28,0))"
    whole = f"cast({high} * {1 << _LOW_BITS} + {low} AS decimal(28,0))"
    step = f"{Decimal(1).scaleb(-places):f}BD"
    return f"cast({whole} * {step} AS {EXACT})"


def _counted_sql(x: str, copies: str) -> str:
    value, n = f"({_decimal_sql(x, _VALUE)})", f"cast({copies} AS {_COPIES})"
    whole = f"cast({value} AS {_WHOLE})"
    part = f"cast({value} - cast({whole} AS {_VALUE}) AS {_PART})"
    return f"cast(sum({whole} * {n}) AS {_VALUE}) + cast(sum({part} * {n}) AS {_VALUE})"


def _strict_sql(x: str, rows: str, places: int | None = None) -> str:
    kept = x if rows == "true" else f"CASE WHEN {rows} THEN {x} END"
    return f"CASE WHEN count({kept}) = count_if({rows}) THEN {_sum_sql(kept, places)} END"


def strict_exact_sum(x: str, places: int | None = None) -> Column:
    """Sum as a decimal that is missing as soon as one value is missing."""
    return F.expr(_strict_sql(x, "true", places))


def strict_sum(x: str, rows: str = "true") -> Column:
    """Sum as a double that is missing as soon as one value (among ``rows``) is missing."""
    return F.expr(f"cast({_strict_sql(x, rows)} AS double)")


def exact_mean(x: str) -> Column:
    """Mean of the values present; missing when there are none."""
    return F.expr(f"try_divide(cast({_sum_sql(x)} AS double), count({x}))")


def distinct_with_missing(x: str, rows: str = "true") -> Column:
    """Distinct values (among ``rows``), missing counting as one value."""
    return F.expr(
        f"count(DISTINCT CASE WHEN {rows} THEN {x} END) "
        f"+ max(CASE WHEN {rows} AND {x} IS NULL THEN 1 ELSE 0 END)"
    )
