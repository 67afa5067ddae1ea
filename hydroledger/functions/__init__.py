"""Column helpers: missing values, rounding, reproducible sums, bins."""

from .bins import Bins
from .missing import (
    ascending,
    descending,
    is_member,
    missing_or_equal,
    na_concat,
    na_if_else,
    na_if_else_sql,
    nz,
    percent,
    ratio,
)
from .rounding import r_round, signif, signif_sql
from .sums import (
    distinct_with_missing,
    exact_mean,
    exact_sum,
    fixed,
    exact,
    nz_exact_sum,
    nz_sum,
    strict_exact_sum,
    strict_sum,
)

__all__ = [
    "Bins",
    "ascending",
    "descending",
    "distinct_with_missing",
    "exact_mean",
    "exact_sum",
    "fixed",
    "exact",
    "nz_exact_sum",
    "strict_exact_sum",
    "is_member",
    "missing_or_equal",
    "na_concat",
    "na_if_else",
    "na_if_else_sql",
    "nz",
    "nz_sum",
    "percent",
    "r_round",
    "ratio",
    "signif",
    "signif_sql",
    "strict_sum",
]
