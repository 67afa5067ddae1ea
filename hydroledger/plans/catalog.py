"""Named queries over the star schema: each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (
    basins,
    hotspot,
    layers,
    production as national,
    residual,
    savings,
    summary,
    tail,
    water,
)
from ..operators.compact import compact
from ..operators.model import ABOVE_DEF, BELOW_DEF, CROP, HERD, PRODUCTS, combine_flows
from ..sources import publish_layer, read_table
from ..sources.tables import SCHEMAS
from ..sources import star
from ..sources.star import FOREIGN, HOME, IMPORTERS, SCALE, YEARS
from .staging import new_folder, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEYS = ["year", "bloc", "product"]
MAP_YEAR = "1997"
# Unknown-origin tonnes of the residual table, moved to the years of the test data.
UNKNOWN = dict(zip(YEARS, residual.UNKNOWN_TONNES.values(), strict=True))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _summary(spark, sf_dir) -> DataFrame:
    columns = [*KEYS, "volume", "green_m3", "blue_m3", "ha_def", "bwf"]
    flows = star.trade(spark, sf_dir, columns, blocs=IMPORTERS)
    return summary.product_summary(flows, IMPORTERS, SCALE)


# --- totals -----------------------------------------------------------------


@query
def product_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query
def bloc_totals(spark, sf_dir):
    return summary.bloc_totals(_summary(spark, sf_dir))


_FOOTPRINT = [*KEYS, "volume", "green_m3", "blue_m3", "ha_def", "co2_def", "co2_low", "co2_high"]


def _footprint_flows(spark, sf_dir, product):
    blocs = (*IMPORTERS, HOME)
    return star.trade(spark, sf_dir, _FOOTPRINT, blocs=blocs, products=(product,))


@query
def crop_bloc_footprint(spark, sf_dir):
    flows = _footprint_flows(spark, sf_dir, CROP)
    return summary.crop_bloc_footprint(flows, (*IMPORTERS, HOME), SCALE)


@query
def herd_bloc_footprint(spark, sf_dir):
    flows = _footprint_flows(spark, sf_dir, HERD)
    return summary.herd_bloc_footprint(flows, (*IMPORTERS, HOME), SCALE)


@query
def import_totals(spark, sf_dir):
    flows = star.trade(spark, sf_dir, [*KEYS, "volume"], blocs=IMPORTERS)
    return summary.import_totals(flows, IMPORTERS)


@query
def irrigated_import_share(spark, sf_dir):
    flows = star.trade(spark, sf_dir, [*KEYS, "volume", "bwsf"], blocs=IMPORTERS)
    return summary.irrigated_import_share(flows, IMPORTERS)


@query
def origin_counts(spark, sf_dir):
    flows = star.trade(spark, sf_dir, [*KEYS, "volume", "origin_id"], blocs=IMPORTERS)
    return hotspot.origin_counts(flows, IMPORTERS)


# --- domestic residual ------------------------------------------------------

_RESIDUAL = ["year", "product", "state_code", "volume", "ha_def", "blue_m3", "green_m3"]
_RESIDUAL += ["co2_def", "co2_low", "co2_high"]
_PRODUCED = ["year", "product", "state_code", "tonnes", "gwf", "bwf", "def_per_t"]
_PRODUCED += ["co2_per_t", "co2_low_per_t", "co2_high_per_t"]


def _residual(spark, sf_dir):
    """Exports and production share one pass over the order lines."""
    lines = star.order_lines(spark, sf_dir, products=(HERD,))
    sums = stage(star.supplier_sums(lines, _RESIDUAL[3:]))
    exports = star.trade(spark, sf_dir, _RESIDUAL, blocs=FOREIGN, sums=sums)
    produced = star.production(spark, sf_dir, _PRODUCED, sums=sums)
    return residual.state_domestic_residual(produced, residual.state_exports(exports))


@query
def state_exports(spark, sf_dir):
    flows = star.trade(spark, sf_dir, _RESIDUAL, blocs=FOREIGN, products=(HERD,))
    return residual.state_exports(flows)


@query
def state_domestic_residual(spark, sf_dir):
    return _residual(spark, sf_dir)


@query
def state_domestic_residual_bulk(spark, sf_dir):
    """Exports are only the bulk rainfed flows to one bloc: many states export nothing."""
    # One pass: the bulk lines to the one bloc are marked and added up beside all others.
    lines = star.order_lines(spark, sf_dir, products=(HERD,), mark=star.BULK)
    sums = stage(star.supplier_sums(lines, _RESIDUAL[3:], (*KEYS, "marked")))
    exports = star.trade(spark, sf_dir, _RESIDUAL, blocs=["ASIA"], sums=sums.where("marked"))
    produced = star.production(spark, sf_dir, _PRODUCED, sums=sums)
    return residual.state_domestic_residual(produced, residual.state_exports(exports))


@query
def national_domestic_residual(spark, sf_dir):
    unknown = residual.unknown_origin(spark, UNKNOWN)
    return residual.national_domestic_residual(_residual(spark, sf_dir), unknown, SCALE)


# --- through files ----------------------------------------------------------


@query
def stored_footprint(spark, sf_dir):
    """Flow files of both products -> one table -> totals -> a layer in files -> the result."""
    columns = [c for c in SCHEMAS["flows"].names if c != "product"]
    parts = []
    for product in PRODUCTS:
        flows = star.trade(spark, sf_dir, [*columns, "product"], products=(product,))
        typed = [F.col(f.name).cast(f.dataType) for f in SCHEMAS["flows"] if f.name != "product"]
        folder = new_folder(spark)
        flows.select(*typed).write.parquet(folder)
        parts.append(read_table(spark, folder, _without_product()))
    both = combine_flows(*parts)
    layer = new_folder(spark)
    publish_layer(summary.import_totals(both, IMPORTERS), layer, ["year"])
    return spark.read.schema(
        "bloc string, product string, vol_total double, year string"
    ).parquet(layer)


def _without_product():
    fields = [f for f in SCHEMAS["flows"] if f.name != "product"]
    return type(SCHEMAS["flows"])(fields)


# --- basins -----------------------------------------------------------------


def _basin_inputs(spark, sf_dir):
    """Flows added up to basin cells, written once, and the bloc totals from them.

    The cells keep what the totals and the basin rows distinguish.
    """
    columns = [*KEYS, "basin", "attributed", "bwf", "volume", "green_m3", "blue_m3", "ha_def"]
    flows = star.trade(spark, sf_dir, columns, blocs=IMPORTERS).withColumn(
        "bwf", (F.col("bwf") != 0).cast("double")
    )
    keys = [*KEYS, "basin", "attributed", "bwf"]
    cells = stage(compact(flows, keys, ["volume", "green_m3", "blue_m3", "ha_def"]))
    totals = summary.bloc_totals(summary.product_summary(cells, IMPORTERS, SCALE))
    footprint = basins.basin_footprint(
        cells, totals, star.labels(spark, sf_dir), IMPORTERS, SCALE
    )
    return footprint, totals


@query
def basin_footprint(spark, sf_dir):
    return _basin_inputs(spark, sf_dir)[0]


@query
def basin_scarcity_rollup(spark, sf_dir):
    return basins.basin_scarcity_rollup(_basin_inputs(spark, sf_dir)[0])


@query
def basin_blue_share(spark, sf_dir):
    return basins.basin_blue_share(*_basin_inputs(spark, sf_dir))


@query
def basin_blue_scarcity_rollup(spark, sf_dir):
    blue = basins.basin_blue_share(*_basin_inputs(spark, sf_dir))
    return basins.basin_blue_scarcity_rollup(blue)


# --- benchmarks and savings -------------------------------------------------


def _bench_production(spark, sf_dir, years=YEARS, sums=None, products=PRODUCTS):
    return stage(
        star.production(spark, sf_dir, star.BENCH_INPUT, years, sums=sums, products=products)
    )


def _savings(spark, sf_dir, products, own=False, sums=None):
    """``own``: with the flows' own coefficients instead of the benchmark's.

    In two phases: production and tags from supplier sums, then a second scan for the
    single flows of the tagged suppliers alone.  Rounding works on single flows, so
    equal ones are counted, not added.
    """
    produced = _bench_production(spark, sf_dir, sums=sums, products=products)
    bench = star.bench(produced, YEARS)
    columns = [*KEYS, "origin_id", "volume", "copies", *(["wf", "bwf"] if own else [])]
    flows = star.trade(
        spark,
        sf_dir,
        columns,
        YEARS,
        IMPORTERS,
        products=products,
        origins=stage(savings.tagged_origins(bench, YEARS, products)),
    )
    return savings.median_savings(
        flows, bench, savings.median_footprint(produced), IMPORTERS, YEARS, products, SCALE
    )


@query
def median_footprint(spark, sf_dir):
    produced = star.production(spark, sf_dir, ["year", "product", "wf", "bwf"])
    return savings.median_footprint(stage(produced))


@query
def median_savings_crop(spark, sf_dir):
    return _savings(spark, sf_dir, (CROP,))


@query
def median_savings_herd(spark, sf_dir):
    return _savings(spark, sf_dir, (HERD,))


@query
def median_savings_crop_own(spark, sf_dir):
    return _savings(spark, sf_dir, (CROP,), own=True)


@query
def median_savings_herd_own(spark, sf_dir):
    return _savings(spark, sf_dir, (HERD,), own=True)


@query
def savings_table(spark, sf_dir):
    # One pass for the two footprints and for production, one for the single flows.
    lines = star.order_lines(spark, sf_dir, YEARS)
    sums = stage(star.supplier_sums(lines, _FOOTPRINT[3:]))
    blocs = (*IMPORTERS, HOME)
    flows = star.trade(spark, sf_dir, _FOOTPRINT, blocs=blocs, sums=sums)
    return savings.savings_table(
        _savings(spark, sf_dir, (CROP, HERD), sums=sums),
        summary.crop_bloc_footprint(flows, blocs, SCALE),
        summary.herd_bloc_footprint(flows, blocs, SCALE),
        HOME,
    )


# --- tails and hotspots -----------------------------------------------------


def _tail_flows(spark, sf_dir, products=PRODUCTS):
    columns = [*KEYS, "origin_id", "volume", "ha_def", "bwf", "bwsf"]
    return star.trade(spark, sf_dir, columns, years=YEARS, blocs=IMPORTERS, products=products)


@query
def tail_origins_crop(spark, sf_dir):
    return tail.tail_origins(_tail_flows(spark, sf_dir, (CROP,)), IMPORTERS, YEARS, (CROP,))


@query
def tail_origins_herd(spark, sf_dir):
    return tail.tail_origins(_tail_flows(spark, sf_dir, (HERD,)), IMPORTERS, YEARS, (HERD,))


@query
def tail_clearing_share(spark, sf_dir):
    flows = _tail_flows(spark, sf_dir)
    return tail.tail_clearing_share(flows, IMPORTERS, YEARS, units=SCALE)


@query
def tail_layer_crop(spark, sf_dir):
    place = star.place(spark, sf_dir)
    return tail.tail_layer(_tail_flows(spark, sf_dir, (CROP,)), place, CROP, IMPORTERS, YEARS)


@query
def tail_layer_herd(spark, sf_dir):
    place = star.place(spark, sf_dir)
    return tail.tail_layer(_tail_flows(spark, sf_dir, (HERD,)), place, HERD, IMPORTERS, YEARS)


_HOTSPOT = [*KEYS, "origin_id", "volume", "ha_def"]


def _hotspot_inputs(spark, sf_dir, product):
    # Lines of unlinked suppliers match no benchmark, so they end in the scan.
    flows = star.trade(
        spark,
        sf_dir,
        _HOTSPOT,
        years=YEARS,
        blocs=IMPORTERS,
        per_supplier=False,
        where=star.LINKED,
        products=(product,),
    )
    produced = _bench_production(spark, sf_dir, products=(product,))
    return flows, star.bench(produced, YEARS)


@query
def hotspot_origins_crop(spark, sf_dir):
    flows, bench = _hotspot_inputs(spark, sf_dir, CROP)
    return hotspot.hotspot_origins(flows, bench, IMPORTERS, YEARS, (CROP,))


@query
def hotspot_origins_herd(spark, sf_dir):
    flows, bench = _hotspot_inputs(spark, sf_dir, HERD)
    return hotspot.hotspot_origins(flows, bench, IMPORTERS, YEARS, (HERD,))


@query
def hotspot_clearing_share(spark, sf_dir):
    # Flows and production share one pass.  The volume sum stays missing with a missing
    # line, as the share asks; order lines always have a quantity.
    lines = star.order_lines(spark, sf_dir, YEARS)
    measures = ["volume", "ha_def", "green_m3", "blue_m3", "co2_def"]
    sums = stage(star.supplier_sums(lines, measures, strict=["volume"]))
    flows = star.trade(spark, sf_dir, _HOTSPOT, blocs=IMPORTERS, sums=sums)
    bench = star.bench(_bench_production(spark, sf_dir, sums=sums), YEARS)
    return hotspot.hotspot_clearing_share(flows, bench, IMPORTERS, YEARS, SCALE)


# --- water series and panels ------------------------------------------------

_WATER = ["green_m3", "blue_m3"]
_BASIN_GRAIN = ("year", "bloc", "basin", "attributed")


def _water(spark, sf_dir, grain, where=None):
    columns = list(dict.fromkeys([*KEYS, *grain, *_WATER]))
    flows = star.trade(spark, sf_dir, columns, blocs=IMPORTERS, where=where)
    return water.water_long(flows, IMPORTERS, SCALE, grain)


def _basin_water(spark, sf_dir, where=None):
    """Basin series, written once: the panel, its domain and its order all read it."""
    return stage(_water(spark, sf_dir, _BASIN_GRAIN, where))


def _labelled_basins(spark, sf_dir):
    """Every basin of the labels, and one without flows."""
    named = star.labels(spark, sf_dir).select("basin")
    return named.union(spark.sql(f"SELECT '{star.EMPTY_BASIN}' AS basin"))


@query
def water_by_colour(spark, sf_dir):
    columns = [*KEYS, *_WATER]
    return water.water_by_colour(star.trade(spark, sf_dir, columns), KEYS)


@query
def water_long(spark, sf_dir):
    return water.in_series_order(_water(spark, sf_dir, water.ORIGIN_GRAIN))


def _axis(spark, sf_dir):
    series = _basin_water(spark, sf_dir)
    both = water.basin_axis_totals(series, "Green + Blue", units=SCALE)
    blue = water.basin_axis_totals(series, "Blue", water.BLUE_TYPES, SCALE)
    return both.unionByName(blue)


@query
def basin_axis_totals(spark, sf_dir):
    return _axis(spark, sf_dir)


@query
def axis_max(spark, sf_dir):
    return water.axis_max(_axis(spark, sf_dir))


@query
def basin_domain(spark, sf_dir):
    return star.basins_with_water(spark, sf_dir, IMPORTERS)


@query
def panel_grid(spark, sf_dir):
    return water.panel_grid(star.basins_with_water(spark, sf_dir, IMPORTERS), YEARS, IMPORTERS)


def _panel(spark, sf_dir, types=water.TYPES, where=None):
    series = _basin_water(spark, sf_dir, where)
    domain = water.basin_domain(series)
    return water.basin_panel(series, domain, YEARS, IMPORTERS, types, SCALE)


@query
def basin_panel(spark, sf_dir):
    return _panel(spark, sf_dir)


@query
def basin_panel_blue(spark, sf_dir):
    return _panel(spark, sf_dir, water.BLUE_TYPES)


@query
def basin_panel_bulk(spark, sf_dir):
    """Only bulk rainfed flows: many basins are absent from a panel and filled in."""
    return _panel(spark, sf_dir, where=star.BULK)


@query
def missing_basins(spark, sf_dir):
    series = _basin_water(spark, sf_dir)
    return water.missing_basins(series, _labelled_basins(spark, sf_dir), YEARS, IMPORTERS)


@query
def missing_basins_bulk(spark, sf_dir):
    series = _basin_water(spark, sf_dir, star.BULK)
    return water.missing_basins(series, water.basin_domain(series), YEARS, IMPORTERS)


@query
def basin_order(spark, sf_dir):
    series = _basin_water(spark, sf_dir)
    return water.basin_order(series, water.basin_domain(series), YEARS, IMPORTERS[0])


@query
def ordered_panel(spark, sf_dir):
    return _ordered_panel(_basin_water(spark, sf_dir), _labelled_basins(spark, sf_dir))


@query
def ordered_panel_bulk(spark, sf_dir):
    series = _basin_water(spark, sf_dir, star.BULK)
    return _ordered_panel(series, water.basin_domain(series))


def _ordered_panel(series, domain):
    return water.ordered_panel(
        water.basin_panel(series, domain, YEARS, IMPORTERS, units=SCALE),
        water.basin_order(series, domain, YEARS, IMPORTERS[0]),
    )


# --- map layers -------------------------------------------------------------


@query
def blue_map_layer(spark, sf_dir):
    grain = ("year", "bloc", "origin_id", "attributed")
    columns = [*KEYS, "origin_id", "attributed", *_WATER]
    flows = star.trade(spark, sf_dir, columns, years=YEARS, blocs=IMPORTERS)
    series = water.water_long(flows, IMPORTERS, SCALE, grain)
    return layers.blue_map_layer(series, star.place(spark, sf_dir), YEARS, IMPORTERS, SCALE)


def _layer_inputs(spark, sf_dir, product, coefficient, where=None, years=None):
    columns = ["year", "product", "origin_id", coefficient]
    produced = star.production(spark, sf_dir, columns, years, where, products=(product,))
    return produced, star.place(spark, sf_dir), MAP_YEAR


@query
def crop_scarcity_bins(spark, sf_dir):
    # The inner join shows no other year; the outer joins below need all years, to
    # tell a place never seen from one seen in another year.
    inputs = _layer_inputs(spark, sf_dir, CROP, "bwsf", years=[MAP_YEAR])
    return layers.crop_scarcity_bins(*inputs)


@query
def herd_scarcity_bins(spark, sf_dir):
    return layers.herd_scarcity_bins(*_layer_inputs(spark, sf_dir, HERD, "bwsf"))


@query
def crop_water_bins(spark, sf_dir):
    return layers.crop_water_bins(*_layer_inputs(spark, sf_dir, CROP, "wf"))


@query
def crop_blue_bins(spark, sf_dir):
    return layers.crop_blue_bins(*_layer_inputs(spark, sf_dir, CROP, "bwf"))


@query
def herd_blue_bins(spark, sf_dir):
    return layers.herd_blue_bins(*_layer_inputs(spark, sf_dir, HERD, "bwf"))


@query
def herd_pasture_bins(spark, sf_dir):
    return layers.herd_pasture_bins(*_layer_inputs(spark, sf_dir, HERD, "gwf"))


@query
def crop_scarcity_bins_bulk(spark, sf_dir):
    """Production from returned bulk lines: places seen only in other years drop out."""
    inputs = _layer_inputs(spark, sf_dir, CROP, "bwsf", star.RETURNED_BULK)
    return layers.crop_scarcity_bins(*inputs)


@query
def herd_blue_bins_bulk(spark, sf_dir):
    return layers.herd_blue_bins(*_layer_inputs(spark, sf_dir, HERD, "bwf", star.RETURNED_BULK))


def _classes(spark, sf_dir, sheets, product):
    """Both clearing classes, side by side as on the map sheet."""
    produced = _bench_production(spark, sf_dir, [MAP_YEAR], products=(product,))
    tags = star.bench(produced, [MAP_YEAR])
    return sheets(tags, star.place(spark, sf_dir), MAP_YEAR, (BELOW_DEF, ABOVE_DEF))


@query
def crop_bench_classes(spark, sf_dir):
    return _classes(spark, sf_dir, layers.crop_bench_sheets, CROP)


@query
def herd_bench_classes(spark, sf_dir):
    return _classes(spark, sf_dir, layers.herd_bench_sheets, HERD)


# --- national production ----------------------------------------------------


@query
def crop_production_summary(spark, sf_dir):
    columns = ["year", "product", "tonnes", "planted_ha", "def_ha", "ghg_t"]
    columns += ["wf", "gwf", "bwf", "irrigated_ha"]
    produced = star.production(spark, sf_dir, columns, products=(CROP,))
    return national.crop_production_summary(produced, SCALE)


@query
def herd_production_summary(spark, sf_dir):
    columns = ["year", "product", "live_kg", "pasture_ha", "def_ha", "ghg_t", "co2_high_kg"]
    columns += ["co2_low_kg", "pasture_m3", "animal_m3", "reservoir_m3", "water_ha", "stock"]
    produced = star.production(spark, sf_dir, columns, YEARS, products=(HERD,))
    return national.herd_production_summary(produced, YEARS, SCALE)
