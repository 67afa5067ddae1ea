"""The operators' queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_stream, fill_middle, html_blocks, lbl_model, license_scan, max_sketches, mil_quality, mixing, packed_ids, permutation_index, simhash_ball, spaced_seeds, toxicity
from .common import new_folder, read_table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read_table(spark, sf_dir, "documents"))


def op4_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ball.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    )


def op6_lbl_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl_model.score(read_table(spark, sf_dir, "documents"))


def op7_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "packed-ids")
    return packed_ids.encode_documents(read_table(spark, sf_dir, "documents"), folder)


def op8_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(read_table(spark, sf_dir, "pages"))


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.overlaps(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )


def op10_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.quality(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    )


def op11_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe_stream.decode(bpe_stream.encode(read_table(spark, sf_dir, "documents")))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.transform(read_table(spark, sf_dir, "documents"))
    whole = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(whole, 256).alias("restored_sha256"),
    )


def op13_max_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketches.search(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_permutation_index": op2_permutation_index,
    "op3_mixing": op3_mixing,
    "op4_simhash_ball": op4_simhash_ball,
    "op5_toxicity": op5_toxicity,
    "op6_lbl_model": op6_lbl_model,
    "op7_packed_ids": op7_packed_ids,
    "op8_html_blocks": op8_html_blocks,
    "op9_spaced_seeds": op9_spaced_seeds,
    "op10_mil_quality": op10_mil_quality,
    "op11_bpe_stream": op11_bpe_stream,
    "op12_fill_middle": op12_fill_middle,
    "op13_max_sketches": op13_max_sketches,
}

_OP12_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS draws
    FROM documents
), lines AS (
    SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units FROM texts
), drawn AS (
    SELECT *, len(units) AS n,
        ('0x' || draws[1:8])::UBIGINT % (len(units) + 1)::UBIGINT AS one,
        ('0x' || draws[9:16])::UBIGINT % (len(units) + 1)::UBIGINT AS other,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR ('0x' || draws[17:24])::UBIGINT % 100 >= 100 THEN 'plain'
            WHEN ('0x' || draws[25:32])::UBIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM lines
), parts AS (
    SELECT *, array_to_string(units[1:least(one, other)::BIGINT], '') AS prefix,
        array_to_string(units[least(one, other)::BIGINT + 1:greatest(one, other)::BIGINT], '') AS middle,
        array_to_string(units[greatest(one, other)::BIGINT + 1:], '') AS suffix
    FROM drawn
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""

_OP13_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), items AS (
    SELECT item_id, text, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM (SELECT DISTINCT item_id, text FROM benchmark)
), wanted AS (
    SELECT item_id, text, term, count(*) AS times
    FROM (SELECT item_id, text, unnest(terms) AS term FROM items) GROUP BY ALL
), sizes AS (
    SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0
), counts AS (
    SELECT row, doc_id, n, term, count(*) AS tf
    FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM wanted)
    GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM counts, sizes GROUP BY term
), scores AS (
    SELECT item_id, text, row, doc_id,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM wanted JOIN counts USING (term) JOIN weights USING (term), sizes
    GROUP BY item_id, text, row, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""

#: Hashing by seed, drawing, learning and tokenizers have no SQL form: the others are tested instead.
ORACLE: dict[str, str] = {"op12_fill_middle": _OP12_SQL, "op13_max_sketches": _OP13_SQL}
