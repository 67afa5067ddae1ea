"""Flow totals per year, bloc and product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import descending, na_if_else_sql, nz_sum, percent, r_round, strict_sum
from .model import (
    CROP,
    HERD,
    NATIONAL,
    Units,
    by_product_sql,
    is_crop,
    r_round_by_product,
)

KEYS = ("year", "bloc", "product")


def of_blocs(flows: DataFrame, blocs: Sequence[str]) -> DataFrame:
    """Flows to the listed blocs; a missing bloc is in no list."""
    return flows.where(F.col("bloc").isin(*blocs))


def irrigated_volume() -> str:
    """Volume from irrigated origins: zero where the blue coefficient is zero,
    missing where it is missing.  Herd flows carry none."""
    return by_product_sql(na_if_else_sql("bwf = 0", "0BD", "volume"), "0BD")


def product_summary(
    flows: DataFrame, blocs: Sequence[str], units: Units = NATIONAL
) -> DataFrame:
    """Volumes, water and clearing per year, bloc and product, in one pass.

    Total water is the rounded sum of the already rounded parts.
    """
    return (
        of_blocs(flows, blocs)
        .groupBy(*KEYS)
        .agg(
            nz_sum("volume").alias("vol_total"),
            nz_sum(irrigated_volume()).alias("vol_irrigated"),
            (nz_sum("green_m3") * units.water).alias("green"),
            (nz_sum("blue_m3") * units.water).alias("blue"),
            nz_sum("ha_def").alias("cleared_total"),
        )
        .withColumns(
            {
                "green": r_round_by_product("green", 1, 0),
                "blue": r_round("blue", 2),
                "cleared_total": r_round("cleared_total"),
            }
        )
        .withColumn("water", r_round("green + blue", 1))
        .select(
            *KEYS, "vol_total", "vol_irrigated", "green", "blue", "water", "cleared_total"
        )
    )


def bloc_totals(summary: DataFrame) -> DataFrame:
    """Products combined per year and bloc: sums of the rounded product values."""
    return summary.groupBy("year", "bloc").agg(
        r_round(strict_sum("green")).alias("green"),
        r_round(strict_sum("blue"), 2).alias("blue"),
        r_round(strict_sum("water")).alias("water"),
    )


def _reported(df: DataFrame) -> DataFrame:
    return df.orderBy(descending(F.col("product")), descending(F.col("year")), "bloc")


def _footprint(flows: DataFrame, product: str, blocs: Sequence[str], units: Units) -> DataFrame:
    return (
        of_blocs(flows, blocs)
        .where(F.col("product") == product)
        .groupBy(*KEYS)
        .agg(
            (nz_sum("volume") * units.mass).alias("mass"),
            (nz_sum("green_m3") * units.water).alias("green"),
            (nz_sum("blue_m3") * units.water).alias("blue"),
            (nz_sum("ha_def") * units.area).alias("cleared"),
            (nz_sum("co2_def") * units.carbon).alias("co2_def"),
            (nz_sum("co2_low") * units.carbon).alias("co2_low"),
            (nz_sum("co2_high") * units.carbon).alias("co2_high"),
        )
    )


def crop_bloc_footprint(
    flows: DataFrame, blocs: Sequence[str], units: Units = NATIONAL
) -> DataFrame:
    """Crop footprint per year and bloc, each part rounded for reporting."""
    return _reported(
        _footprint(flows, CROP, blocs, units)
        .withColumns(
            {
                "mass": r_round("mass", 1),
                "green": r_round("green", 1),
                "blue": r_round("blue", 2),
                "cleared": r_round("cleared", 2),
                "co2_def": r_round("co2_def"),
            }
        )
        .withColumn("water", r_round("green + blue", 1))
        .select(*KEYS, "mass", "green", "blue", "water", "cleared", "co2_def")
    )


def herd_bloc_footprint(
    flows: DataFrame, blocs: Sequence[str], units: Units = NATIONAL
) -> DataFrame:
    """Herd footprint per year and bloc, with the mean of the animal emissions."""
    return _reported(
        _footprint(flows, HERD, blocs, units)
        .withColumns(
            {
                "mass": r_round("mass", 3),
                "green": r_round("green"),
                "blue": r_round("blue", 2),
                "cleared": r_round("cleared", 3),
                "co2_def": r_round("co2_def", 1),
                "co2_mean": (r_round("co2_low", 1) + r_round("co2_high", 1)) / 2,
            }
        )
        .withColumn("water", r_round("green + blue", 1))
        .withColumn("co2_total", r_round("co2_def + co2_mean"))
        .select(
            *KEYS, "mass", "green", "blue", "water", "cleared", "co2_def", "co2_mean", "co2_total"
        )
    )


def import_totals(flows: DataFrame, blocs: Sequence[str]) -> DataFrame:
    """Imported volume per year, bloc and product."""
    return (
        of_blocs(flows, blocs).groupBy(*KEYS).agg(nz_sum("volume").alias("vol_total"))
    )


def irrigated_import_share(flows: DataFrame, blocs: Sequence[str]) -> DataFrame:
    """Share of the crop imports that comes from origins with a scarcity footprint.

    Both sums come from one pass; years and blocs without such an origin are left out.
    """
    scarce = "CASE WHEN bwsf != 0 THEN volume END"
    return (
        of_blocs(flows, blocs)
        .where(is_crop())
        .groupBy("year", "bloc")
        .agg(
            nz_sum(scarce).alias("vol_irrigated"),
            nz_sum("volume").alias("vol_total"),
            F.count_if(F.col("bwsf") != 0).alias("_scarce"),
        )
        .where("_scarce > 0")
        .drop("_scarce")
        .withColumn("pct_irrigated", percent("vol_irrigated", "vol_total"))
    )
