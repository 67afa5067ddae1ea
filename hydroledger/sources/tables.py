"""Reading and writing tables with a declared schema."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}


def _fields(text: str) -> T.StructType:
    """Schema from "name type, ..."; works before a session exists."""
    pairs = [field.split() for field in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Input tables of the accounting operators.  Years and ids are text.
SCHEMAS: dict[str, T.StructType] = {
    "flows": _fields(
        "year string, origin_id string, name string, state string, state_abbr string, "
        "state_code int, basin string, bloc string, product string, volume double, "
        "green_m3 double, blue_m3 double, ha_def double, co2_def double, co2_low double, "
        "co2_high double, wf double, bwf double, bwsf double"
    ),
    "production": _fields(
        "year string, product string, origin_id string, state_code int, tonnes double, "
        "wf double, gwf double, bwf double, bwsf double, def_per_t double, "
        "co2_per_t double, co2_low_per_t double, co2_high_per_t double, planted_ha double, "
        "irrigated_ha double, def_ha double, ghg_t double, live_kg double, "
        "pasture_ha double, pasture_m3 double, animal_m3 double, reservoir_m3 double, "
        "water_ha double, co2_high_kg double, co2_low_kg double, stock double"
    ),
    "bench": _fields(
        "year string, product string, origin_id string, wf double, bwf double, "
        "tag_wf string, tag_irr string, tag_def string, tag_wsf string"
    ),
    "labels": _fields("basin string, scarcity string"),
    "place": _fields("origin_id string, geometry string"),
    "unknown": _fields("year string, unknown_t double"),
}


def read_table(
    spark: SparkSession, path: str, table: str | T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """Read Parquet or CSV under a declared schema; fail on a missing column.

    A column stored under another type is an error for Parquet and a cast for CSV.
    """
    schema = SCHEMAS[table] if isinstance(table, str) else table
    if fmt == "csv":
        options = {"header": True, "enforceSchema": False, "mode": "FAILFAST"}
        return spark.read.schema(schema).options(**options).csv(path)
    found = spark.read.format(fmt).load(path)
    types = {f.name: f.dataType for f in found.schema}
    for field in schema:
        if field.name not in types:
            raise ValueError(f"{path}: column {field.name} is missing")
        if types[field.name] != field.dataType:
            raise ValueError(
                f"{path}: column {field.name} is {types[field.name].simpleString()}, "
                f"not {field.dataType.simpleString()}"
            )
    return found.select(*schema.names)


def publish(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a result table; an overwritten one stays readable until the new one is whole."""
    if mode != "overwrite":
        df.write.mode(mode).parquet(path)
        return
    _swap(df, path, lambda aside: df.write.parquet(aside))


def publish_layer(
    df: DataFrame, path: str, by: Sequence[str] = ("year",), mode: str = "overwrite"
) -> None:
    """Write a map or panel layer in folders per ``by``.

    The rebalance hint gathers each folder's rows and lets Spark split a large one
    over several tasks.
    """
    spread = df.hint("rebalance", *by)
    if mode != "overwrite":
        spread.write.mode(mode).partitionBy(*by).parquet(path)
        return
    _swap(df, path, lambda aside: spread.write.partitionBy(*by).parquet(aside))


def _swap(df: DataFrame, path: str, write: Callable[[str], None]) -> None:
    """Write beside ``path``, then put the new table in the place of the former one.

    A job that fails, also in the middle, leaves the former table as it was; a query may
    read the table that it replaces.  The exchange is two renames, and if the second one
    fails, the former table goes back.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    name = path.rstrip("/")
    aside, former = f"{name}.new-{mark}", f"{name}.old-{mark}"
    here, new, old = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (name, aside, former))
    files = here.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(aside)
        replaces = files.exists(here)
        if replaces and not files.rename(here, old):
            raise OSError(f"cannot set aside the former table {path}")
        if not files.rename(new, here):
            if replaces:
                files.rename(old, here)
            raise OSError(f"cannot publish {path}")
    finally:
        files.delete(new, True)
    files.delete(old, True)
