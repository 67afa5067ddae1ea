"""Footprints by basin and by scarcity class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nz_sum, percent, r_round, strict_sum
from .model import NATIONAL, Units, is_crop, r_round_by_product
from .summary import of_blocs


def basin_footprint(
    flows: DataFrame,
    totals: DataFrame,
    labels: DataFrame,
    blocs: Sequence[str],
    units: Units = NATIONAL,
) -> DataFrame:
    """Water per year, bloc and basin, with the share of the bloc's water.

    Crop and herd rows stay separate though the product is not shown.  Herd flows
    without a known place are left out, crop flows are kept under a missing basin.
    """
    per_basin = (
        of_blocs(flows, blocs)
        .where(is_crop() | F.col("attributed"))
        .groupBy("year", "bloc", "product", "basin")
        .agg(
            (nz_sum("green_m3") * units.water).alias("green"),
            (nz_sum("blue_m3") * units.water).alias("blue"),
        )
        .withColumn("green", r_round_by_product("green", 1, 0))
        .withColumn("blue", r_round("blue", 2))
        .withColumn("water_basin", r_round("green + blue", 1))
    )
    label = labels.select(F.col("basin").alias("_basin"), "scarcity")
    bloc = totals.select("year", "bloc", F.col("water").alias("water_bloc"))
    return (
        per_basin.join(label, F.col("basin").eqNullSafe(F.col("_basin")), "left")
        .join(bloc, ["year", "bloc"], "left")
        .select(
            "year",
            "bloc",
            "basin",
            "green",
            "blue",
            "water_basin",
            "scarcity",
            "water_bloc",
            r_round(percent("water_basin", "water_bloc"), 2).alias("pct"),
        )
    )


def basin_scarcity_rollup(footprint: DataFrame) -> DataFrame:
    """Basin rows per scarcity class.

    ``water_bloc`` adds the bloc total once per basin row, as the published table
    does: it is not a total of the class.
    """
    return footprint.groupBy("year", "bloc", "scarcity").agg(
        strict_sum("green").alias("green"),
        strict_sum("blue").alias("blue"),
        strict_sum("water_bloc").alias("water_bloc"),
        r_round(strict_sum("pct")).alias("pct"),
    )


def basin_blue_share(footprint: DataFrame, totals: DataFrame) -> DataFrame:
    """Blue water per basin row and its share of the bloc's blue water."""
    bloc = totals.select("year", "bloc", F.col("blue").alias("blue_bloc"))
    return (
        footprint.select("year", "bloc", "basin", F.col("blue").alias("blue_basin"), "scarcity")
        .join(bloc, ["year", "bloc"], "left")
        .withColumn("pct", r_round(percent("blue_basin", "blue_bloc"), 2))
    )


def basin_blue_scarcity_rollup(blue: DataFrame) -> DataFrame:
    """Blue water and its share per scarcity class."""
    return blue.groupBy("year", "bloc", "scarcity").agg(
        strict_sum("blue_basin").alias("blue"),
        r_round(strict_sum("pct")).alias("pct"),
    )
