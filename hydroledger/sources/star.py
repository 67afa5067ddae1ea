"""Accounting tables derived from the order star schema.

Order lines play the trade flows, suppliers the places of origin, supplier
nations the basins and states, customer regions the blocs.

Every dimension has a unique key and is joined from the left, so leaving out a
dimension whose columns are not asked for changes no row.  Flows and production
are added up per supplier before supplier attributes are joined wherever the
query allows it: a supplier with a third of all lines shrinks on the map side.
A side is broadcast only after its stored size was compared with the session's
limit; beyond it the join is left to Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact_mean, exact_sum, fixed, na_if_else, strict_exact_sum
from ..operators.model import (
    ABOVE_DEF,
    ABOVE_WF,
    ABOVE_WSF,
    BELOW_DEF,
    BELOW_WF,
    BELOW_WSF,
    CROP,
    HERD,
    IRRIGATED,
    PRODUCTS,
    RAINFED,
    UNLINKED,
    Units,
    attributed,
    of_years,
)
from ..plans.lookups import bound, broadcast_if_small, lookup

# Blocs of the test data: two importers and the producing country's own.
IMPORTERS = ("ASIA", "EUROPE")
HOME = "AMERICA"
FOREIGN = ("AFRICA", "ASIA", "EUROPE", "MIDDLE EAST")
YEARS = ("1995", "1996", "1997")

# The test tables hold about a thousandth of a national account, so reports use
# units a thousand times smaller: kt, kha, kt CO2, million m3.
SCALE = Units(mass=1e-3, area=1e-3, carbon=1e-3, water=1e-6, kilograms=1e-6)

_SUPPLIER_COLUMNS = {
    "origin_id",
    "attributed",
    "name",
    "state",
    "state_abbr",
    "state_code",
    "basin",
    "bwsf",
}
#: Decimals of the lines' measures.
LINE_PLACES = 4
_MEASURES = ("volume", "green_m3", "blue_m3", "ha_def", "co2_def", "co2_low", "co2_high")


# Declared, so that opening a table reads no file footers.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": (
        "l_orderkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    ),
}


def path_of(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(path_of(sf_dir, name))


def _lookup(df: DataFrame, sf_dir: str, *names: str) -> DataFrame:
    return broadcast_if_small(df, [path_of(sf_dir, name) for name in names])


def _irrigates(supplier: Column) -> Column:
    return supplier % 3 != 0


def _unlinked(supplier: Column) -> Column:
    return supplier % 10 == 9


def _in_years(orders: DataFrame, years: Sequence[str] | None) -> DataFrame:
    """Date range of the years first, which the file scan can use, then the years."""
    if years is None:
        return orders
    kind = orders.schema["o_orderdate"].dataType
    first, last = min(map(int, years)), max(map(int, years)) + 1
    day = F.col("o_orderdate")
    return orders.where(
        (day >= F.lit(f"{first}-01-01").cast(kind)) & (day < F.lit(f"{last}-01-01").cast(kind))
    ).where(F.year(day).isin(*[int(y) for y in years]))


def _order_years(spark, sf_dir, years, blocs, with_bloc: bool) -> DataFrame:
    """Orders with their year and, if asked for, the bloc of the customer."""
    orders = _in_years(table(spark, sf_dir, "orders"), years)
    year = F.year("o_orderdate").cast("string").alias("year")
    if not with_bloc:
        return orders.select("o_orderkey", year)
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("bloc"))
    buyers = (
        table(spark, sf_dir, "customer")
        .join(
            _lookup(nation, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
        )
        .join(
            _lookup(region, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
        .select("c_custkey", "bloc")
    )
    out = orders.select("o_orderkey", "o_custkey", year).join(
        _lookup(buyers, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    if blocs is not None:
        out = out.where(F.col("bloc").isin(*blocs))
    return out.select("o_orderkey", "year", "bloc")


def _origins(spark, sf_dir, columns) -> DataFrame:
    """Supplier attributes as place attributes."""
    supplier = table(spark, sf_dir, "supplier")
    key, code = F.col("s_suppkey"), F.col("s_nationkey")
    unlinked = _unlinked(key)
    if "state" in columns:
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        nation = _lookup(nation, sf_dir, "nation")
        supplier = supplier.join(nation, code == F.col("n_nationkey"), "left")
    else:
        supplier = supplier.withColumn("n_name", F.lit(None).cast("string"))
    return supplier.select(
        "s_suppkey",
        F.when(unlinked, F.concat(F.lit(f"{UNLINKED}-"), code))
        .otherwise(F.concat(F.lit("M-"), key))
        .alias("origin_id"),
        F.when(unlinked, F.lit(UNLINKED)).otherwise(F.col("s_name")).alias("name"),
        F.col("n_name").alias("state"),
        F.concat(F.lit("N"), code).alias("state_abbr"),
        code.alias("state_code"),
        F.when(~unlinked, F.concat(F.lit("BASIN_"), code)).alias("basin"),
        F.when(
            ~unlinked,
            F.when(_irrigates(key), fixed(F.abs("s_acctbal"), 2)).otherwise(F.lit(0.0)),
        ).alias("bwsf"),
    )


def _with_origins(lines: DataFrame, spark, sf_dir, columns) -> DataFrame:
    """Coefficient and place columns by supplier; places are joined only if needed."""
    out = lines
    if {"wf", "bwf"} & set(columns):
        key = F.col("l_suppkey")
        blue = F.when(_irrigates(key), (key % 97 + 1) * 1.5).otherwise(F.lit(0.0))
        out = out.withColumn("bwf", F.when(~_unlinked(key), blue))
        out = out.withColumn("wf", F.when(~_unlinked(key), blue + (key % 53 + 1) * 20.0))
    if _SUPPLIER_COLUMNS & set(columns):
        origins = _lookup(_origins(spark, sf_dir, columns), sf_dir, "supplier")
        out = out.join(origins, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        out = out.withColumn("attributed", attributed())
    return out.select(*columns)


BULK = "l_quantity >= 50 AND (l_suppkey % 3 = 0 OR l_extendedprice * l_discount = 0)"
LINKED = "l_suppkey % 10 != 9"
# A basin that no supplier belongs to.
EMPTY_BASIN = "BASIN_NODATA"
RETURNED_BULK = "l_quantity >= 50 AND l_returnflag = 'R'"


def order_lines(
    spark: SparkSession,
    sf_dir: str,
    years: Sequence[str] | None = None,
    blocs: Sequence[str] | None = None,
    with_bloc: bool = True,
    where: str | None = None,
    products: Sequence[str] = PRODUCTS,
    mark: str | None = None,
    origins: DataFrame | None = None,
) -> DataFrame:
    """One row per order line: year, bloc, product, supplier and measures.

    A single product is a filter on the stored column, which the scan can use.  ``mark``
    is a condition on the stored columns, whose outcome comes as ``marked``.  ``origins``
    (product, origin_id) leaves out the lines of all other suppliers before they
    meet their orders; pass a written table, by whose size Spark picks the join.
    """
    lines = table(spark, sf_dir, "lineitem")
    if where is not None:
        lines = lines.where(where)
    if CROP not in products:
        # Without a status a line counts as herd.
        lines = lines.where("l_linestatus IS NULL OR l_linestatus != 'O'")
    elif HERD not in products:
        lines = lines.where("l_linestatus = 'O'")
    measures = lines.selectExpr(
        "l_orderkey",
        "l_suppkey",
        f"CASE WHEN l_linestatus = 'O' THEN '{CROP}' ELSE '{HERD}' END AS product",
        "l_quantity AS volume",
        "l_extendedprice AS green_m3",
        "CASE WHEN l_suppkey % 3 = 0 THEN 0D "
        "ELSE rint(l_extendedprice * l_discount * 1e4D) / 1e4D END AS blue_m3",
        "rint(l_quantity * nullif(l_tax, 0D) * 1e4D) / 1e4D AS ha_def",
        "rint(l_quantity * l_discount * 1e4D) / 1e4D AS co2_def",
        "rint(l_quantity * l_discount * 5e3D) / 1e4D AS co2_low",
        "rint(l_quantity * l_discount * 15e3D) / 1e4D AS co2_high",
        *([f"coalesce({mark}, false) AS marked"] if mark else []),
    )
    if origins is not None:
        # The inverse of an origin's id, so that the lines' own key is compared.
        wanted = origins.selectExpr("product", "cast(substring(origin_id, 3) AS bigint) AS l_suppkey")
        measures = measures.join(wanted, ["product", "l_suppkey"], "left_semi")
    orders = _order_years(spark, sf_dir, years, blocs, with_bloc or blocs is not None)
    orders = _lookup(orders, sf_dir, "orders")
    return measures.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def supplier_sums(
    lines: DataFrame,
    measures: Sequence[str],
    keys: Sequence[str] = ("year", "bloc", "product"),
    strict: Sequence[str] = (),
) -> DataFrame:
    """Order lines added up per supplier, with their number.

    Sums are decimals, exact to be added further.  A measure listed as ``strict`` is
    missing if one of its lines is.
    """
    return _line_sums(lines, measures, [*keys, "l_suppkey"], strict)


def _line_sums(lines, measures, keys, strict=()) -> DataFrame:
    sums = {
        m: (strict_exact_sum if m in strict else exact_sum)(m, LINE_PLACES) for m in measures
    }
    return lines.groupBy(*keys).agg(
        *[total.alias(m) for m, total in sums.items()], F.count("*").alias("n_lines")
    )


def trade(
    spark: SparkSession,
    sf_dir: str,
    columns: Sequence[str],
    years: Sequence[str] | None = None,
    blocs: Sequence[str] | None = None,
    per_supplier: bool = True,
    where: str | None = None,
    sums: DataFrame | None = None,
    products: Sequence[str] = PRODUCTS,
    origins: DataFrame | None = None,
) -> DataFrame:
    """Flow table with the named columns.

    ``per_supplier`` adds the lines up first per year, bloc and product, and per
    supplier if a column depends on it, which every operator built on sums can use.
    With a ``copies`` column, equal volumes of a supplier are counted instead.  Without
    ``per_supplier`` there is one row per order line.  ``sums`` hands in supplier sums
    made before.  ``origins`` names the only origins whose lines are read on.
    """
    by_supplier = {"wf", "bwf", *_SUPPLIER_COLUMNS} & set(columns)
    if sums is not None:
        flows = sums if blocs is None else sums.where(F.col("bloc").isin(*blocs))
    else:
        flows = order_lines(
            spark, sf_dir, years, blocs, "bloc" in columns, where, products, origins=origins
        )
        keys = [c for c in ("year", "bloc", "product") if c in columns]
        if "copies" in columns:
            flows = flows.groupBy(*keys, "l_suppkey", "volume").agg(F.count("*").alias("copies"))
        elif per_supplier:
            measures = [m for m in _MEASURES if m in columns]
            flows = _line_sums(flows, measures, [*keys, "l_suppkey"] if by_supplier else keys)
    return _with_origins(flows, spark, sf_dir, columns)


def basins_with_water(spark: SparkSession, sf_dir: str, blocs: Sequence[str]) -> DataFrame:
    """Named basins that some water flows from: suppliers first, then their basins."""
    lines = order_lines(spark, sf_dir, blocs=blocs).where("green_m3 != 0 OR blue_m3 != 0")
    suppliers = lines.select("l_suppkey").distinct()
    basins = _with_origins(suppliers, spark, sf_dir, ["basin"])
    return basins.where("basin IS NOT NULL").distinct()


_PRODUCED = ("volume", "green_m3", "blue_m3", "ha_def", "co2_def")


def production(
    spark: SparkSession,
    sf_dir: str,
    columns: Sequence[str],
    years: Sequence[str] | None = None,
    where: str | None = None,
    sums: DataFrame | None = None,
    products: Sequence[str] = PRODUCTS,
) -> DataFrame:
    """Production per year, product and supplier; suppliers are all linked here.

    ``sums`` hands in supplier sums of all blocs made before.
    """
    key = F.col("l_suppkey")
    keys = ("year", "product")
    if sums is None:
        lines = order_lines(
            spark, sf_dir, years, with_bloc=False, where=where, products=products
        )
        made = supplier_sums(lines, _PRODUCED, keys)
    else:
        made = sums.groupBy(*keys, "l_suppkey").agg(
            *[exact_sum(m).alias(m) for m in _PRODUCED], F.sum("n_lines").alias("n_lines")
        )
    sums = made.selectExpr(
        *keys,
        "l_suppkey",
        "double(volume) AS tonnes",
        "double(green_m3) AS pasture_m3",
        "double(blue_m3) AS animal_m3",
        "coalesce(double(ha_def), 0D) AS def_ha",
        "double(co2_def) AS ghg_t",
        "n_lines",
    )
    tonnes = F.col("tonnes")
    irrigates = _irrigates(key)
    out = sums.withColumns(
        {
            "origin_id": F.concat(F.lit("M-"), key),
            "gwf": F.col("pasture_m3") / tonnes,
            "bwf": F.col("animal_m3") / tonnes,
            "def_per_t": F.col("def_ha") / tonnes,
            "co2_per_t": F.col("ghg_t") / tonnes,
            "planted_ha": tonnes * 0.5,
            "irrigated_ha": F.when(irrigates, F.col("ghg_t")).otherwise(F.lit(0.0)),
            "live_kg": tonnes * 1000,
            "pasture_ha": tonnes * 2,
            "reservoir_m3": F.col("pasture_m3") * 0.25,
            "water_ha": tonnes * 0.125,
            "co2_high_kg": F.col("ghg_t") * 1500,
            "co2_low_kg": F.col("ghg_t") * 500,
            "stock": F.when(F.col("n_lines") > 1, tonnes / F.col("n_lines")),
        }
    ).withColumns(
        {
            "wf": F.col("gwf") + F.col("bwf"),
            "co2_low_per_t": F.col("co2_per_t") * 0.5,
            "co2_high_per_t": F.col("co2_per_t") * 1.5,
        }
    )
    if {"state_code", "bwsf"} & set(columns):
        supplier = table(spark, sf_dir, "supplier").select(
            "s_suppkey",
            F.col("s_nationkey").alias("state_code"),
            F.when(_irrigates(F.col("s_suppkey")), fixed(F.abs("s_acctbal"), 2))
            .otherwise(F.lit(0.0))
            .alias("bwsf"),
        )
        supplier = _lookup(supplier, sf_dir, "supplier")
        out = out.join(supplier, key == F.col("s_suppkey"), "left")
    return out.select(*columns)


BENCH_INPUT = ("year", "product", "origin_id", "wf", "bwf", "bwsf", "def_per_t")


def bench(production: DataFrame, years: Sequence[str]) -> DataFrame:
    """Tags against the mean of the year and product.

    ``production`` is read twice, for the cutoffs and the tags: pass a written table.
    """
    cutoffs = production.groupBy("year", "product").agg(
        *[exact_mean(c).alias(f"_{c}") for c in ("bwf", "bwsf", "def_per_t")]
    )

    def tag(column: str, above: str, below: str) -> Column:
        over = F.col(column) > F.col(f"_{column}")
        return na_if_else(over, F.lit(above), F.lit(below))

    cutoffs = of_years(cutoffs, years).where(F.col("product").isin(CROP, HERD))
    return production.join(
        lookup(cutoffs, bound(years, (CROP, HERD))), ["year", "product"], "left"
    ).select(
        "year",
        "product",
        "origin_id",
        "wf",
        "bwf",
        tag("bwf", ABOVE_WF, BELOW_WF).alias("tag_wf"),
        F.when(F.col("bwf") != 0, F.lit(IRRIGATED)).otherwise(F.lit(RAINFED)).alias("tag_irr"),
        tag("def_per_t", ABOVE_DEF, BELOW_DEF).alias("tag_def"),
        tag("bwsf", ABOVE_WSF, BELOW_WSF).alias("tag_wsf"),
    )


def place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a point, and one place without any flow."""
    known = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("M-"), "s_suppkey").alias("origin_id"),
        F.format_string("POINT(%d %d)", "s_nationkey", "s_suppkey").alias("geometry"),
    )
    extra = spark.sql("SELECT 'M-NODATA' AS origin_id, 'POINT(-1 -1)' AS geometry")
    return known.unionByName(extra)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scarcity class per basin."""
    rank = F.col("n_nationkey") % 3
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("BASIN_"), "n_nationkey").alias("basin"),
        F.when(rank == 0, "low").when(rank == 1, "medium").otherwise("high").alias("scarcity"),
    )
