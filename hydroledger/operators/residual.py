"""Domestic use as production minus exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nz, nz_sum, r_round
from .model import DOMESTIC, HERD, NATIONAL, Units

# Residual name -> (flow measure, per-tonne production coefficient).
RESIDUALS = {
    "cleared": ("ha_def", "def_per_t"),
    "blue_m3": ("blue_m3", "bwf"),
    "green_m3": ("green_m3", "gwf"),
    "co2_high": ("co2_high", "co2_high_per_t"),
    "co2_low": ("co2_low", "co2_low_per_t"),
    "co2_def": ("co2_def", "co2_per_t"),
}

# Tonnes per year whose place of origin could not be determined.
UNKNOWN_TONNES = {"2015": 140848, "2016": 137313, "2017": 142190}


def unknown_origin(spark: SparkSession, tonnes: Mapping[str, float] = UNKNOWN_TONNES) -> DataFrame:
    """Small literal table (year, unknown_t)."""
    rows = ", ".join(f"('{int(year)}', {float(t)}D)" for year, t in tonnes.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(year, unknown_t)")


def state_exports(flows: DataFrame) -> DataFrame:
    """Exports per year and state of origin, unrounded."""
    return (
        flows.where(F.col("product") == HERD)
        .groupBy("year", "state_code")
        .agg(
            nz_sum("volume").alias("volume_out"),
            *[nz_sum(m).alias(f"{name}_out") for name, (m, _) in RESIDUALS.items()],
        )
    )


def state_domestic_residual(
    production: DataFrame, exports: DataFrame, domestic: str = DOMESTIC
) -> DataFrame:
    """What stays in the country per year and state; may be negative.

    A row whose coefficient is missing adds nothing; a state without exports
    keeps its whole production.  An unnamed state matches an unnamed state.  ``domestic``
    names the bloc of the rows.
    """
    produced = (
        production.where(F.col("product") == HERD)
        .groupBy("year", "state_code")
        .agg(
            nz_sum("tonnes").alias("produced"),
            *[nz_sum(f"{c} * tonnes").alias(f"{name}_all") for name, (_, c) in RESIDUALS.items()],
        )
    )
    out = exports.withColumnsRenamed({"year": "_year", "state_code": "_state"})
    same_state = F.col("state_code").eqNullSafe(F.col("_state"))
    same = F.col("year").eqNullSafe(F.col("_year")) & same_state
    return produced.join(out, same, "left").select(
        "year",
        "state_code",
        "produced",
        (F.col("produced") - nz(F.col("volume_out"))).alias("volume"),
        *[(F.col(f"{n}_all") - nz(F.col(f"{n}_out"))).alias(n) for n in RESIDUALS],
        F.lit(domestic).alias("bloc"),
    )


def national_domestic_residual(
    residual: DataFrame, unknown: DataFrame, units: Units = NATIONAL
) -> DataFrame:
    """National domestic use per year, less the volume of unknown origin."""
    total = residual.groupBy("year").agg(
        r_round(nz_sum("volume") * units.mass, 2).alias("mass"),
        r_round(nz_sum("cleared") * units.area, 2).alias("cleared"),
        r_round(nz_sum("blue_m3") * units.water).alias("blue"),
        r_round(nz_sum("green_m3") * units.water).alias("green"),
        r_round(nz_sum("co2_def") * units.carbon).alias("co2_def"),
        r_round(nz_sum("co2_high") * units.carbon).alias("co2_high"),
        r_round(nz_sum("co2_low") * units.carbon).alias("co2_low"),
    )
    return (
        total.join(unknown, "year", "left")
        .withColumn("water", r_round("green + blue", 1))
        .withColumn("co2_mean", r_round((F.col("co2_low") + F.col("co2_high")) / 2))
        .withColumn("co2_total", r_round("co2_def + co2_mean"))
        .withColumn("mass", r_round(F.col("mass") - F.col("unknown_t") * units.mass, 2))
        .select(
            "year",
            "mass",
            "green",
            "blue",
            "water",
            "cleared",
            "co2_def",
            "co2_high",
            "co2_low",
            "co2_mean",
            "co2_total",
        )
    )
