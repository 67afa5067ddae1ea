"""Tables in and out, staging, lookups."""

import os

import pytest
from pyspark.sql import functions as F

from hydroledger.plans import staging
from hydroledger.plans.lookups import bound, broadcast_if_small, lookup, stored_bytes
from hydroledger.sources import SCHEMAS, publish, publish_layer, read_table


def test_parquet_and_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("B1", "high"), ("B2", None)], SCHEMAS["labels"])
    publish(df, f"{tmp_path}/p")
    assert sorted(read_table(spark, f"{tmp_path}/p", "labels").collect()) == sorted(df.collect())
    df.write.csv(f"{tmp_path}/c", header=True)
    got = read_table(spark, f"{tmp_path}/c", "labels", "csv")
    assert got.schema == SCHEMAS["labels"]
    assert set(got.collect()) == set(df.collect())


def test_wrong_columns_are_refused(spark, tmp_path):
    publish(spark.createDataFrame([("B1", 1)], "basin string, scarcity int"), f"{tmp_path}/t")
    with pytest.raises(ValueError, match="scarcity is int"):
        read_table(spark, f"{tmp_path}/t", "labels")
    with pytest.raises(ValueError, match="origin_id is missing"):
        read_table(spark, f"{tmp_path}/t", "place")


def test_year_is_text_whatever_it_holds(spark, tmp_path):
    publish(spark.createDataFrame([("2015", 1.0), ("n/a", 2.0)], SCHEMAS["unknown"]), f"{tmp_path}/u")
    got = read_table(spark, f"{tmp_path}/u", "unknown").where(F.col("year").isin("2015"))
    assert got.count() == 1


def test_layers_are_written_by_year(spark, tmp_path):
    df = spark.range(100).select(
        F.when(F.col("id") % 3 == 0, "2015").otherwise("2016").alias("year"), "id"
    )
    publish_layer(df, f"{tmp_path}/layer")
    folders = sorted(f for f in os.listdir(f"{tmp_path}/layer") if f.startswith("year="))
    assert folders == ["year=2015", "year=2016"]
    back = spark.read.schema("id long, year string").parquet(f"{tmp_path}/layer")
    assert back.where("year = '2015'").count() == 34
    publish_layer(df.limit(3), f"{tmp_path}/layer")
    assert spark.read.parquet(f"{tmp_path}/layer").count() == 3


def test_a_failed_job_leaves_the_former_table(spark, tmp_path):
    for write, by in ((publish, ()), (publish_layer, (["year"],))):
        path = f"{tmp_path}/{write.__name__}"
        df = spark.range(20).select((F.col("id") % 2).cast("string").alias("year"), "id")
        write(df, path, *by)
        fails = df.withColumn("id", F.when(F.col("id") == 7, F.raise_error("stop")).otherwise(F.col("id")))
        with pytest.raises(Exception, match="stop"):
            write(fails, path, *by)
        assert spark.read.parquet(path).count() == 20
        # A query may read what it replaces, and nothing stays beside the table.
        write(spark.read.parquet(path).where("id < 5"), path, *by)
        assert spark.read.parquet(path).count() == 5
        write(df.limit(1), path, *by, mode="append")
        assert spark.read.parquet(path).count() == 6
    assert sorted(os.listdir(tmp_path)) == ["publish", "publish_layer"]


def test_staged_table_goes_to_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    staged = staging.stage(df)
    assert sorted(staged.collect()) == sorted(df.collect())
    assert all(named in path for path in staged.inputFiles())
    # Nothing of the first plan is left: only the written files are read.
    assert "Range" not in staged._jdf.queryExecution().executedPlan().toString()
    folder = os.path.dirname(staged.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder)
    assert staged.count() == 10


def test_a_scope_deletes_its_own_tables_only(spark):
    with staging.staged(spark):
        outer = staging.stage(spark.range(3))
        with staging.staged(spark):
            inner = staging.stage(spark.range(4))
            gone = os.path.dirname(inner.inputFiles()[0].removeprefix("file://"))
            assert inner.count() == 4
        assert not os.path.isdir(gone)
        assert outer.count() == 3
        kept = os.path.dirname(outer.inputFiles()[0].removeprefix("file://"))
    assert not os.path.isdir(kept)


def test_a_cluster_needs_a_shared_folder():
    session = _Session("spark://host:7077")
    with pytest.raises(RuntimeError):
        staging.shared_folder(session)
    session.get = lambda name, default: "file:///scratch"
    with pytest.raises(RuntimeError, match="one machine"):
        staging.shared_folder(session)


class _Session:
    """Stands for a session without a named folder."""

    def __init__(self, master):
        self.sparkContext = self
        self.conf = self
        self.master = master
        self.folder = None

    def get(self, name, default):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_folder_is_made_only_for_a_local_session():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(_Session("spark://host:7077"))
    local = _Session("local[2]")
    folder = staging.shared_folder(local)
    assert os.path.isdir(folder)
    assert staging.shared_folder(local) == folder


def test_broadcast_needs_a_bound_or_a_small_file(spark, tmp_path, settings):
    df = spark.range(10)

    def hinted(frame):
        return "ResolvedHint" in frame._jdf.queryExecution().analyzed().toString()

    assert bound(["a", "b"], range(3)) == 6
    assert bound(["a"], None) is None
    assert hinted(lookup(df, 6))
    assert not hinted(lookup(df, None))
    assert not hinted(lookup(df, 10**9))
    df.write.parquet(f"{tmp_path}/t")
    size = stored_bytes(spark, f"{tmp_path}/t")
    assert size > 0
    assert hinted(broadcast_if_small(df, [f"{tmp_path}/t"]))
    settings(spark__sql__autoBroadcastJoinThreshold=str(size - 1))
    assert not hinted(broadcast_if_small(df, [f"{tmp_path}/t"]))
