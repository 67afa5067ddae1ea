"""Half-even rounding and significant digits as plain column arithmetic.

Both stay inside whole-stage codegen: ``rint`` works on the double itself,
where ``round``/``bround`` would build a BigDecimal for every row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r_round(x: Column | str, digits: int = 0) -> Column:
    """Round to ``digits`` decimals, halves to the even neighbour."""
    if isinstance(x, str):
        scale = f"1e{digits}D"
        return F.expr(f"rint(({x}) * {scale}) / {scale}" if digits else f"rint({x})")
    scale = float(10**digits)
    return F.rint(x * scale) / scale if digits else F.rint(x)


def signif_sql(x: str, digits: int) -> str:
    """``digits`` significant digits as SQL; zero stays zero, missing stays missing."""
    # Decimal places needed after the point; negative for large numbers.
    shift = f"({digits - 1} - floor(log10(nullif(abs({x}), 0D))))"
    scale = f"pow(10D, abs({shift}))"
    return (
        f"CASE WHEN {x} = 0 THEN 0D WHEN {shift} >= 0 THEN rint({x} * {scale}) / {scale} "
        f"ELSE rint({x} / {scale}) * {scale} END"
    )


def signif(x: str, digits: int) -> Column:
    """Keep ``digits`` significant digits of a column or SQL expression."""
    return F.expr(signif_sql(f"({x})", digits))
