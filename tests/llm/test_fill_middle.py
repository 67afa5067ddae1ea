"""Fill-in-the-middle: brute force, exact texts back, odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from hydroledger.llm import fill_middle

DOCS = "doc_id long, text string"


def brute(doc_id, text, fim=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hex_ = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hex_[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return (doc_id, n, "plain", None, None, text)
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def texts():
    rng = random.Random(5)
    out = [None, "", "\n", "\n\n\n", "one line", "one\n", "a\r\nb\rc d\x85e\n", "$1 \\ $3\n(?s)\n\\E"]
    out += ["x<P>y\nz", "<S>", "a\n<M", "<", "M>\n<P\n>S", "\U0001f600é\n" * 7 + "\U0001f600", "\x00\n\x00"]
    for _ in range(60):
        out.append("".join(rng.choice("ab<>PSM\n\n é\U0001f600") for _ in range(rng.randint(1, 60))))
    return out


@pytest.mark.parametrize("fim,spm", [(100, 50), (40, 10), (0, 50)])
def test_texts_are_cut_as_by_hand(spark, fim, spm):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a\nb\nc"), (3, "x\n"), (3, "x\n"), (-4, "q\nr")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1.5) for c in ("n", "form", "output", "id", "draws")})
    found = fill_middle.transform(df.repartition(3), fim_percent=fim, spm_percent=spm)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = found.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = [(*brute(i, t, fim, spm), t or "") for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_long_texts_need_no_stack(spark):
    rows = [(i, t) for i, t in enumerate(["a\n" * 400_000, "x" * 3_000_000, "\n" * 300_000, "é\n" * 100_000 + "end"])]
    found = fill_middle.transform(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, found)) == sorted(brute(i, t) for i, t in rows)


def test_other_units(spark):
    rows = [(i, "one, two; three. four, five" * i) for i in range(1, 20)]
    df = spark.createDataFrame(rows, DOCS)
    found = fill_middle.transform(df, unit="[^,;.]+[,;.]?|[,;.]", seed=11)
    back = found.select("doc_id", "n", fill_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted((r.doc_id, r.t) for r in back) == rows
    assert {r.doc_id: r.n for r in back} == {i: len(re.findall("[^,;.]+[,;.]?|[,;.]", t)) for i, t in rows}


def test_nothing_in_nothing_out_and_built_in_functions_only(spark):
    found = fill_middle.transform(spark.createDataFrame([], DOCS))
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))
