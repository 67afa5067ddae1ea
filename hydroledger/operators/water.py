"""Water by colour and product, basin panels and their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ascending, exact_sum, na_concat, nz, nz_sum, r_round
from .model import NATIONAL, Units
from .summary import of_blocs

# The four series, in the order of the published panels.
TYPES = ("Soy - Green", "Beef - Green", "Soy - Blue", "Beef - Blue")
BLUE_TYPES = ("Soy - Blue", "Beef - Blue")
FILLER_TYPE = "Beef - Blue"

ORIGIN_GRAIN = ("year", "origin_id", "name", "state", "state_abbr", "basin", "bloc")


def type_rank(series: Column) -> Column:
    """Position of a series in the published order; missing for an unknown one."""
    position = F.array_position(F.array(*[F.lit(t) for t in TYPES]), series)
    return F.when(position > 0, position).cast("int")


def water_by_colour(flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wide to long: one row per key and water colour, from one scan.

    The flows are added up before the reshaping, so only totals are doubled.  A
    colour whose flows are all zero or missing gives no row.
    """
    totals = flows.groupBy(*keys).agg(
        F.when(F.expr("count_if(green_m3 != 0) > 0"), exact_sum("green_m3").cast("double")).alias("Green"),
        F.when(F.expr("count_if(blue_m3 != 0) > 0"), exact_sum("blue_m3").cast("double")).alias("Blue"),
    )
    return totals.unpivot(list(keys), ["Green", "Blue"], "colour", "water_m3").where(
        "water_m3 IS NOT NULL"
    )


def water_long(
    flows: DataFrame,
    blocs: Sequence[str],
    units: Units = NATIONAL,
    grain: Sequence[str] = ORIGIN_GRAIN,
) -> DataFrame:
    """Water per ``grain`` and series ("product - colour").

    Panels need only the basin: a coarser ``grain`` keeps the shuffle small.
    """
    return (
        water_by_colour(of_blocs(flows, blocs), [*grain, "product"])
        .withColumn("type", na_concat(F.col("product"), " - ", F.col("colour")))
        .select(
            *grain,
            "type",
            type_rank(F.col("type")).alias("type_rank"),
            "water_m3",
            (F.col("water_m3") * units.water).alias("water"),
        )
    )


def in_series_order(water: DataFrame) -> DataFrame:
    """Sort by series; the further keys spread one series over many tasks."""
    rest = [c for c in water.columns if c not in ("type_rank", "water", "water_m3")]
    return water.orderBy(*[ascending(F.col(c)) for c in ("type_rank", *rest)])


def basin_axis_totals(
    water: DataFrame, label: str, types: Sequence[str] = TYPES, units: Units = NATIONAL
) -> DataFrame:
    """Rounded water per year, basin and bloc, unlinked flows left out."""
    return (
        water.where(F.col("attributed") & F.col("type").isin(*types))
        .groupBy("year", "basin", "bloc")
        .agg(r_round(nz_sum("water_m3") * units.water, 2).alias("water"))
        .withColumn("label", F.lit(label))
    )


def axis_max(axis: DataFrame) -> DataFrame:
    """Largest bar per label: the common axis limit."""
    return axis.groupBy("label").agg(F.max("water").alias("axis_max"))


def basin_domain(water: DataFrame) -> DataFrame:
    """All named basins."""
    return water.where("basin IS NOT NULL").select("basin").distinct()


def panel_grid(domain: DataFrame, years: Sequence[str], blocs: Sequence[str]) -> DataFrame:
    """Every basin in every panel: the listed (year, bloc) pairs are laid out per basin."""
    panels = [
        F.struct(F.lit(y).alias("year"), F.lit(b).alias("bloc")) for y in years for b in blocs
    ]
    return domain.select("basin", F.inline(F.array(*panels))).select("year", "bloc", "basin")


def _panel_series(water, years, blocs, types) -> DataFrame:
    return (
        water.where(F.col("attributed") & F.col("type").isin(*types))
        .where(F.col("year").isin(*years) & F.col("bloc").isin(*blocs))
        .groupBy("year", "bloc", "type", "basin")
        .agg(nz_sum("water_m3").alias("water_m3"))
    )


def missing_basins(
    water: DataFrame,
    domain: DataFrame,
    years: Sequence[str],
    blocs: Sequence[str],
    types: Sequence[str] = TYPES,
) -> DataFrame:
    """Basins without any water in a panel."""
    series = _panel_series(water, years, blocs, types)
    return panel_grid(domain, years, blocs).join(series, ["year", "bloc", "basin"], "left_anti")


def basin_panel(
    water: DataFrame,
    domain: DataFrame,
    years: Sequence[str],
    blocs: Sequence[str],
    types: Sequence[str] = TYPES,
    units: Units = NATIONAL,
) -> DataFrame:
    """Water per year, bloc, series and basin; absent basins read zero.

    A filled row carries a placeholder series.  Rows without a basin stay.
    """
    series = _panel_series(water, years, blocs, types)
    return (
        series.join(panel_grid(domain, years, blocs), ["year", "bloc", "basin"], "full")
        .withColumn("type", F.coalesce(F.col("type"), F.lit(FILLER_TYPE)))
        .select(
            "year",
            "bloc",
            "type",
            "basin",
            (nz(F.col("water_m3")) * units.water).alias("water"),
        )
    )


def basin_order(
    water: DataFrame, domain: DataFrame, years: Sequence[str], bloc: str
) -> DataFrame:
    """Position of each basin on the axis of a year: ascending water of one bloc.

    The order always uses all series.  It ranks basins, a short dimension.
    """
    panel = basin_panel(water, domain, years, [bloc], TYPES, Units(water=1.0))
    total = panel.groupBy("year", "basin").agg(nz_sum("water").alias("_m3"))
    by_size = Window.partitionBy("year").orderBy("_m3", ascending(F.col("basin")))
    return total.select("year", "basin", F.row_number().over(by_size).alias("position"))


def ordered_panel(panel: DataFrame, order: DataFrame) -> DataFrame:
    """Panel rows with the axis position of their basin."""
    axis = order.withColumnRenamed("basin", "_basin").withColumnRenamed("year", "_year")
    same = (F.col("year") == F.col("_year")) & F.col("basin").eqNullSafe(F.col("_basin"))
    return panel.join(axis, same, "left").drop("_basin", "_year")
