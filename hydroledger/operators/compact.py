"""Pre-aggregation of flows to a coarser grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions import exact_sum

MEASURES = ("volume", "green_m3", "blue_m3", "ha_def", "co2_def", "co2_low", "co2_high")


def compact(
    flows: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES
) -> DataFrame:
    """Add up ``measures`` per ``keys``.

    The result is again a flow table: sums are exact, so adding them further
    gives what the single flows would.  Hot keys shrink on the map side, before
    any shuffle.  A group without any value keeps a missing measure.
    """
    return flows.groupBy(*keys).agg(*[exact_sum(m).alias(m) for m in measures])
