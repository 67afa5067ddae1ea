"""Rows that come thousands of times: samples stay bounded and copies meet one by one."""

import pytest
from pyspark.sql import functions as F

from hydroledger.llm import common, mixing, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture
def many(spark):
    """Id 1 comes 5,000 times with as many texts, id 2 as often with one."""
    ids = spark.range(5000)
    texts = ids.select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    same = ids.select(F.lit(2).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    others = spark.range(3, 40).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    return texts.union(same).union(others)


def test_samples_bound_rows(spark, many):
    labels = spark.range(1, 40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    kept = [i for i in range(1, 40) if i % 2 < 2]
    got = common.labelled_sample(many, labels, "toxic", 10_000, 10).collect()
    assert len(got) == 10
    got = common.labelled_sample(many, labels, "toxic", 10_000, 1000).collect()
    assert len(got) == len(kept)
    assert sorted(r.text for r in got if r.text)[-1] == "the same text"
    assert sum(r.text is not None and r.text.startswith("text ") for r in got) == 1
    again = common.labelled_sample(many.repartition(7), labels, "toxic", 10_000, 1000)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    assert toxicity.drop_toxic(many, labels).columns == many.columns


def test_a_row_repeated_ten_thousand_times_is_mixed(spark):
    same = spark.range(10_000).select(
        F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"),
        F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(13).alias("n_chars"),
    )
    other = spark.createDataFrame([(i, f"w{i} x y z", "en", "b", 6) for i in range(50)], DOCS)
    docs = same.union(other)
    taken = mixing.mixture(docs).agg(F.sum("taken")).first()[0]
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert got.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] == taken
    rows = got.groupBy("doc_id").count().collect()
    assert max(r["count"] for r in rows if r.doc_id != 7) <= 2
    assert all(r["count"] <= 20_000 for r in rows)
