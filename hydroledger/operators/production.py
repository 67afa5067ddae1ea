"""National production tables per year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact_mean, nz_sum, r_round, signif, signif_sql
from .model import CROP, HERD, NATIONAL, Units, of_years


def _ratio(part: str, factor: float, whole: str, whole_factor: float, scale: float = 1.0) -> str:
    """Stored units of ``part`` per stored unit of ``whole``, from the reported totals.

    ``factor`` and ``whole_factor`` are those that the totals were reported with.
    """
    by = scale * (whole_factor / factor)
    # Factors are powers of ten, which a quotient of doubles can miss by a bit.
    return f"try_divide({part} * {float(f'{by:.12g}')!r}D, {whole})"


#: Kilograms in a tonne: live weight is stored in the one and reported per the other.
_KG = 1e3


def crop_production_summary(production: DataFrame, units: Units = NATIONAL) -> DataFrame:
    """Crop production, land, clearing, water and the ratios of the rounded totals."""
    totals = (
        production.where(F.col("product") == CROP)
        .groupBy("year")
        .agg(
            r_round(nz_sum("tonnes") * units.mass, 1).alias("mass"),
            r_round(nz_sum("planted_ha") * units.area, 1).alias("planted"),
            r_round(nz_sum("def_ha") * units.area, 2).alias("cleared"),
            r_round(nz_sum("ghg_t") * units.carbon).alias("co2"),
            r_round(nz_sum("wf * tonnes") * units.water).alias("water"),
            r_round(nz_sum("gwf * tonnes") * units.water).alias("green"),
            r_round(nz_sum(signif_sql("(bwf * tonnes)", 4)) * units.water, 2).alias("blue"),
            r_round(nz_sum("irrigated_ha") * units.area, 2).alias("irrigated"),
        )
    )
    return totals.select(
        "*",
        r_round(_ratio("mass", units.mass, "planted", units.area), 2).alias("yield"),
        signif(_ratio("cleared", units.area, "mass", units.mass, 1e3), 2).alias("cleared_per_kt"),
        signif(_ratio("co2", units.carbon, "mass", units.mass), 2).alias("co2_per_t"),
        *[
            r_round(_ratio(x, units.water, "mass", units.mass)).alias(f"{x}_per_t")
            for x in ("water", "green", "blue")
        ],
    ).withColumn("pct_blue", r_round("try_divide(100D * blue_per_t, water_per_t)", 2))


def herd_production_summary(
    production: DataFrame, years: Sequence[str], units: Units = NATIONAL
) -> DataFrame:
    """Live weight, pasture, clearing, emissions, water and stock of the listed years."""

    kilograms, tonnes = units.kilograms, units.kilograms * _KG

    def scaled(column: str, factor: float) -> Column:
        return nz_sum(column) * factor

    totals = (
        of_years(production, years)
        .where(F.col("product") == HERD)
        .groupBy("year")
        .agg(
            r_round(scaled("live_kg", units.kilograms), 1).alias("mass"),
            r_round(scaled("pasture_ha", units.area)).alias("pasture"),
            r_round(scaled("def_ha", units.area), 1).alias("cleared"),
            r_round(scaled("ghg_t", units.carbon)).alias("co2_def"),
            r_round(scaled("co2_high_kg", units.kilograms)).alias("co2_high"),
            r_round(scaled("co2_low_kg", units.kilograms)).alias("co2_low"),
            r_round(scaled("pasture_m3", units.water)).alias("pasture_water"),
            r_round(scaled("animal_m3", units.water), 1).alias("animal_water"),
            r_round(scaled("reservoir_m3", units.water), 1).alias("reservoir_water"),
            r_round(nz_sum("rint(water_ha)") * units.area, 2).alias("water_area"),
            r_round(exact_mean("stock"), 2).alias("stock_mean"),
        )
    )
    return totals.select(
        "*",
        signif(_ratio("cleared", units.area, "mass", tonnes, 1e3), 3).alias("cleared_per_kt"),
        r_round(_ratio("co2_def", units.carbon, "mass", tonnes), 1).alias("co2_def_per_t"),
        r_round(_ratio("co2_low", kilograms, "mass", kilograms), 1).alias("co2_low_per_t"),
        r_round(_ratio("co2_high", kilograms, "mass", kilograms), 1).alias("co2_high_per_t"),
        signif(_ratio("pasture_water", units.water, "mass", tonnes), 3).alias("pasture_per_t"),
        r_round(_ratio("animal_water", units.water, "mass", tonnes)).alias("animal_per_t"),
        r_round(_ratio("reservoir_water", units.water, "mass", tonnes)).alias("reservoir_per_t"),
    )
