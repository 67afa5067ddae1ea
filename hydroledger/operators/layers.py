"""Map layers: places with a class and a geometry.

The geometry is an opaque payload.  Everything is added up per origin first and
the geometry is joined last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import Bins, missing_or_equal, na_concat, nz_sum
from ..functions.bins import (
    BLUE_FLOW,
    CROP_BLUE,
    CROP_SCARCITY,
    CROP_WATER,
    HERD_BLUE,
    HERD_PASTURE,
    HERD_SCARCITY,
)
from .model import CROP, HERD, NATIONAL, Units
from .water import BLUE_TYPES


def blue_map_layer(
    water: DataFrame,
    place: DataFrame,
    years: Sequence[str],
    blocs: Sequence[str],
    units: Units = NATIONAL,
) -> DataFrame:
    """Blue water per year, bloc and origin, binned.

    The bloc and series conditions hold for no place without flows, so the outer
    join of places reduces to looking the geometry up.
    """
    return (
        water.where(F.col("attributed") & F.col("type").isin(*BLUE_TYPES))
        .where(F.col("year").isin(*years) & F.col("bloc").isin(*blocs))
        .groupBy("year", "bloc", "origin_id")
        .agg((nz_sum("water_m3") * units.water).alias("water"))
        .join(place.select("origin_id", "geometry"), "origin_id", "left")
        .select(
            "year",
            "bloc",
            "origin_id",
            "water",
            BLUE_FLOW.label(F.col("water")).alias("bin"),
            "geometry",
        )
    )


def coefficient_layer(
    production: DataFrame,
    place: DataFrame,
    year: str,
    product: str,
    coefficient: str,
    bins: Bins,
    how: str = "full",
    zero_is_missing: bool = False,
) -> DataFrame:
    """Per-tonne coefficient of one year, binned, with geometry.

    The year test follows the join: a place never seen in production stays (with a
    missing year), a place seen only in other years drops out.
    """
    coef = F.col(coefficient)
    if zero_is_missing:
        coef = F.nullif(coef, F.lit(0.0))
    side = production.where(F.col("product") == product)
    shown = F.struct("year", coef.alias("coef"))
    if how == "inner":
        side = side.where(missing_or_equal(F.col("year"), year))
        joined = side.select("origin_id", shown.alias("_row")).join(
            place.select("origin_id", "geometry"), "origin_id"
        )
    else:
        # One row per origin meets the geometries: what it shows, which may be nothing.
        per_origin = side.groupBy("origin_id").agg(
            F.collect_list(F.when(missing_or_equal(F.col("year"), year), shown)).alias("_rows")
        )
        unseen = F.array(
            F.struct(F.lit(None).cast("string").alias("year"), F.lit(None).cast("double").alias("coef"))
        )
        joined = per_origin.join(place.select("origin_id", "geometry"), "origin_id", how).select(
            "origin_id", "geometry", F.explode(F.coalesce("_rows", unseen)).alias("_row")
        )
    return joined.select("origin_id", "_row.year", "_row.coef", "geometry").select(
        "origin_id", "year", "coef", bins.label(F.col("coef")).alias("bin"), "geometry"
    )


def crop_scarcity_bins(production: DataFrame, place: DataFrame, year: str) -> DataFrame:
    """Crop scarcity classes; places without data are not shown."""
    return coefficient_layer(production, place, year, CROP, "bwsf", CROP_SCARCITY, how="inner")


def herd_scarcity_bins(production: DataFrame, place: DataFrame, year: str) -> DataFrame:
    """Herd scarcity classes; places without data are shown as zero."""
    return coefficient_layer(production, place, year, HERD, "bwsf", HERD_SCARCITY)


def crop_water_bins(production: DataFrame, place: DataFrame, year: str) -> DataFrame:
    """Total water per tonne of crop; a zero footprint reads as missing."""
    return coefficient_layer(
        production, place, year, CROP, "wf", CROP_WATER, zero_is_missing=True
    )


def crop_blue_bins(production: DataFrame, place: DataFrame, year: str) -> DataFrame:
    """Blue water per tonne of crop."""
    return coefficient_layer(production, place, year, CROP, "bwf", CROP_BLUE)


def herd_blue_bins(production: DataFrame, place: DataFrame, year: str) -> DataFrame:
    """Blue water per tonne of live weight."""
    return coefficient_layer(production, place, year, HERD, "bwf", HERD_BLUE)


def herd_pasture_bins(production: DataFrame, place: DataFrame, year: str) -> DataFrame:
    """Pasture water per tonne of live weight."""
    return coefficient_layer(production, place, year, HERD, "gwf", HERD_PASTURE)


def bench_sheets(
    bench: DataFrame,
    place: DataFrame,
    year: str,
    product: str,
    second_tag: str,
    clearings: Sequence[str],
) -> DataFrame:
    """Benchmark class of each place on each clearing sheet: the water tag and a second tag.

    Rows are chosen before the outer join, so every place is kept on every sheet;
    unmatched places have no class.  All sheets come from one join.
    """
    chosen = bench.where(
        (F.col("product") == product)
        & (F.col("year") == year)
        & F.col("tag_def").isin(*clearings)
    ).select(
        "origin_id",
        F.col("tag_def").alias("clearing"),
        "year",
        na_concat(F.col("tag_wf"), ", ", F.col(second_tag)).alias("tag"),
    )
    sheets = F.explode(F.array(*[F.lit(c) for c in clearings])).alias("clearing")
    spread = place.select("origin_id", "geometry", sheets)
    return chosen.join(spread, ["origin_id", "clearing"], "full").select(
        "origin_id", "year", "tag", "geometry", "clearing"
    )


def crop_bench_sheets(bench, place, year: str, clearings: Sequence[str]) -> DataFrame:
    """Water and irrigation class of the crop origins, per clearing sheet."""
    return bench_sheets(bench, place, year, CROP, "tag_irr", clearings)


def herd_bench_sheets(bench, place, year: str, clearings: Sequence[str]) -> DataFrame:
    """Water and scarcity class of the herd origins, per clearing sheet."""
    return bench_sheets(bench, place, year, HERD, "tag_wsf", clearings)


def crop_bench_classes(bench, place, year: str, clearing_tag: str) -> DataFrame:
    """Water and irrigation class of the crop origins on one sheet."""
    return crop_bench_sheets(bench, place, year, [clearing_tag]).drop("clearing")


def herd_bench_classes(bench, place, year: str, clearing_tag: str) -> DataFrame:
    """Water and scarcity class of the herd origins on one sheet."""
    return herd_bench_sheets(bench, place, year, [clearing_tag]).drop("clearing")
