"""Columns, products and units shared by the operators.

Flows carry: year, bloc, product, origin_id, attributed, basin, state_code,
volume, green_m3, blue_m3, ha_def, co2_def, co2_low, co2_high and the per-tonne
coefficients ``bwf`` (blue water), ``bwsf`` (scarcity) and, where known, ``wf``
(all water).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import r_round

# Product labels, tag labels, marker of unlinkable origins.
CROP = "Soy"
HERD = "Beef"
DOMESTIC = "BRAZIL"
UNLINKED = "AGGREGATED"
ABOVE_WF = "> cutoff WF"
BELOW_WF = "< cutoff WF"
ABOVE_WSF = "> cutoff WSF"
BELOW_WSF = "< cutoff WSF"
ABOVE_DEF = "> cutoff def"
BELOW_DEF = "< cutoff def"
IRRIGATED = "irr"
RAINFED = "no irr"

PRODUCTS = (CROP, HERD)


@dataclass(frozen=True)
class Units:
    """Factors from the stored unit to the reported one.

    Defaults: t to Mt, ha to Mha, t CO2 to Mt, m3 to km3, kg to Mt.
    """

    mass: float = 1e-6
    area: float = 1e-6
    carbon: float = 1e-6
    water: float = 1e-9
    kilograms: float = 1e-9


NATIONAL = Units()


def is_crop() -> Column:
    return F.col("product") == CROP


def by_product(crop: Column, herd: Column) -> Column:
    """One expression per product, chosen row by row: both tables in one pass."""
    return F.when(is_crop(), crop).otherwise(herd)


def by_product_sql(crop: str, herd: str) -> str:
    """The same choice as SQL, for use inside an aggregate."""
    return f"CASE WHEN product = '{CROP}' THEN {crop} ELSE {herd} END"


def r_round_by_product(x: str, crop_digits: int, herd_digits: int) -> Column:
    return by_product(r_round(x, crop_digits), r_round(x, herd_digits))


def attributed(origin: str = "origin_id") -> Column:
    """True where the flow is linked to one place; missing for a missing id."""
    return ~F.contains(F.col(origin), F.lit(UNLINKED))


def combine_flows(crop: DataFrame, herd: DataFrame) -> DataFrame:
    """Stack the crop and the herd flow tables into one labelled table."""
    return (
        crop.withColumn("product", F.lit(CROP))
        .unionByName(herd.withColumn("product", F.lit(HERD)), allowMissingColumns=True)
        .withColumn("attributed", attributed())
    )


def of_years(df: DataFrame, years) -> DataFrame:
    """Rows of the listed years (text, like the column); all years if none given."""
    return df if years is None else df.where(F.col("year").isin(*years))
