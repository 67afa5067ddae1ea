"""Running totals and exact medians without one task per group.

A median is found between two approximate quantiles, by counts.  For running totals,
``Window.partitionBy(group)`` would sort a whole group in one task.  Instead
Spark's range partitioner cuts the rows at sampled boundaries of
(group, order, tie), so even one huge group, or one huge set of equal order
values, spreads over many parts.  The part number is written with the rows;
a running total is the total of the group's earlier parts plus the running
total inside the part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ascending, exact
from ..plans.lookups import lookup
from ..plans.staging import stage

PART = "_part"
GROUP = "_group"


def _grouped(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the keys as one value, which is never missing: a missing key is a group too."""
    return df.withColumn(GROUP, F.struct(*keys))


def range_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Cut ``df`` into ordered parts of similar size and write them once."""
    cuts = [ascending(F.col(c)) for c in (*keys, *order)]
    return stage(df.repartitionByRange(*cuts).withColumn(PART, F.spark_partition_id()))


def running_total(
    parts: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    groups: DataFrame | None = None,
    keep: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Add the running total of ``value`` in ``order`` within ``keys``.

    ``parts`` comes from :func:`range_parts` with the same keys and order.  Missing
    order values come last; ``order`` ends with a tie-break so that the result is
    unique.  ``groups`` adds columns known per group.  ``keep(before, reach)`` names
    the parts that can matter, from the total before the part and the highest total
    reachable inside it; the rows of the others are never sorted.
    """
    units = exact(value)
    zero = exact(F.lit(0))

    def added(x: Column) -> Column:
        return F.coalesce(F.sum(x), zero)

    parts = _grouped(parts, keys)
    earlier = Window.partitionBy(GROUP).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    # One row per (group, part): as many as there are parts, plus the groups.
    offsets = (
        parts.groupBy(GROUP, PART)
        .agg(added(units).alias("_here"), added(F.greatest(units, zero)).alias("_gain"))
        .withColumn("_before", F.coalesce(F.sum("_here").over(earlier), zero))
    )
    if groups is not None:
        offsets = offsets.join(_grouped(groups, keys).drop(*keys), GROUP)
    if keep is not None:
        before, reach = F.col("_before"), F.col("_before") + F.col("_gain")
        offsets = offsets.where(keep(before.cast("double"), reach.cast("double")))
    inside = (
        Window.partitionBy(GROUP, PART)
        .orderBy(*[ascending(F.col(c)) for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upto = F.col("_before") + F.coalesce(F.sum(units).over(inside), zero)
    return (
        parts.join(offsets.drop("_here", "_gain"), [GROUP, PART])
        .withColumn(out, upto.cast("double"))
        .drop("_before", GROUP, PART)
    )


#: Share of a group's rows on each side of the middle that the median's bracket covers, and the
#: accuracy of its ends: they are off by at most a rank in so many.
BRACKET, ACCURACY = 5e-4, 10_000


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str, bracket: float = BRACKET
) -> DataFrame:
    """Exact median of ``value`` per ``keys``; even counts average the middle two.

    ``df`` is read twice: pass a written table.  The first pass brackets the middle by two
    approximate quantiles, whose sketches are merged from map-side partials.  The second
    counts what lies below the bracket and above it as one row each, and the values inside
    one by one, equal ones together; so of a large group only the rows about the middle are
    shuffled, and none is sorted or written.  A bracket that misses the middle is seen from
    the counts, and its group is done again with one ten times as wide.
    """
    present = _grouped(df.where(F.col(value).isNotNull()), keys).select(GROUP, value)
    ends = F.array(F.lit(max(0.0, 0.5 - bracket)), F.lit(min(1.0, 0.5 + bracket)))
    brackets = stage(
        present.groupBy(GROUP).agg(
            F.count("*").alias("_all"),
            F.percentile_approx(value, ends, F.lit(ACCURACY)).alias("_ends"),
        )
    )
    v, low, high = F.col(value), F.col("_ends")[0], F.col("_ends")[1]
    whole = bracket >= 0.5
    cell = F.lit(1) if whole else F.when(v < low, 0).when(v <= high, 1).otherwise(2)
    counted = (
        present.join(lookup(brackets, brackets.count()), GROUP)
        .withColumn("_cell", cell)
        .withColumn("_point", F.when(F.col("_cell") == 1, v))
        .groupBy(GROUP, "_cell", "_point")
        .agg(F.count("*").alias("_n"), F.first("_all").alias("_all"))
    )
    # The bracket's distinct values and two rows more.
    inside = Window.partitionBy(GROUP).orderBy("_cell", "_point")
    upto = F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.col("_upto") - F.col("_n")
    middle = (before < F.floor(F.col("_all") / 2) + 1) & (F.col("_upto") >= F.ceil(F.col("_all") / 2))
    # At most two rows a group.
    hits = stage(counted.withColumn("_upto", upto).where(middle))
    found = hits.groupBy(GROUP).agg(
        ((F.min("_point") + F.max("_point")) / 2).alias(out),
        F.min("_cell").alias("_least"),
        F.max("_cell").alias("_most"),
    )
    settled = found.where("_least = 1 AND _most = 1").select(f"{GROUP}.*", out)
    missed = found.where("_least != 1 OR _most != 1").select(GROUP)
    if whole or missed.isEmpty():
        return settled
    again = _grouped(df, keys).join(missed, GROUP, "left_semi").drop(GROUP)
    return settled.unionByName(exact_median(again, keys, value, out, min(0.5, max(BRACKET, 10 * bracket))))
