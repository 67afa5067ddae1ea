"""Fill-in-the-middle texts by a counted-quantifier regular expression.

A text is a row of units (lines by default).  ``regexp_count`` gives their number n; two
hashes of the id choose where prefix and middle end; then a pattern made for the row, with
possessive groups ``(?:unit){a}+`` and ``(?:unit){b-a}+``, captures prefix, middle and
suffix in one match, and its replacement writes them in the order of the form.  A
possessive group runs as a loop and never gives a unit back, so a text of a million units
needs neither a deep stack nor a second try.  All of it is built-in functions: one scan,
no shuffle, each row by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's unit, marks, seed and percentages.
LINE = "[^\\n]*\\n|[^\\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
FIM_PERCENT = 100
SPM_PERCENT = 50


def transform(
    docs: DataFrame,
    unit: str = LINE,
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output.

    ``unit`` is a pattern without groups whose matches, left to right, make up the whole
    text.  The draws are the first four 8-digit groups of the SHA-256 of ``seed:doc_id``: the
    first two, modulo n + 1, bound the middle, the others choose the form.  A text that is
    missing counts as empty; an empty text, or one that holds a mark, stays plain, and its
    counts are missing.  A missing doc_id is drawn for as an empty one.  Rows with one
    doc_id draw alike, repeated rows repeat; extra columns are left out whatever their
    names; an empty table gives no rows.
    """
    text, draws = F.col("text"), F.col("draws")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))

    def draw(number: int) -> Column:
        return F.conv(F.substring(draws, 8 * number - 7, 8), 16, 10).cast("long")

    drawn = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        .withColumn("n", F.regexp_count("text", F.lit(unit)).cast("long"))
        .withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        .withColumn("draws", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id")), 256))
        .withColumn("one", F.pmod(draw(1), F.col("n") + 1))
        .withColumn("other", F.pmod(draw(2), F.col("n") + 1))
        .withColumn("plain", (text == "") | marked | (F.pmod(draw(3), F.lit(100)) >= fim_percent))
        .withColumn("spm", F.pmod(draw(4), F.lit(100)) < spm_percent)
    )
    units = f"((?:{unit}){{"
    pattern = F.concat(
        F.lit(f"\\A{units}"),
        F.least("one", "other").cast("string"),
        F.lit(f"}}+){units}"),
        F.abs(F.col("one") - F.col("other")).cast("string"),
        F.lit("}+)((?s:.*))\\z"),
    )
    order = F.when(F.col("spm"), f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(
        f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2"
    )
    # Texts that stay plain meet a pattern that cannot match.
    cut = F.regexp_replace(text, F.when(F.col("plain"), "\\A(?!)").otherwise(pattern), order)
    whole = drawn.withColumn("output", cut).withColumn(
        "form", F.when(F.col("plain"), "plain").when(F.col("spm"), "spm").otherwise("psm")
    )
    prefix, middle, _ = _parts(F.col("output"), F.col("form"))
    return whole.select(
        "doc_id",
        "n",
        "form",
        F.length(prefix).cast("long").alias("prefix_chars"),
        F.length(middle).cast("long").alias("middle_chars"),
        "output",
    )


def _parts(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of an output; missing where it is plain.

    The text holds no mark, and no mark's end begins another, so the marks of an output
    are found where they were written.
    """
    spm = form == "spm"
    first_end = F.instr(output, F.when(spm, PREFIX).otherwise(SUFFIX))
    last = F.instr(output, F.lit(MIDDLE))
    first = F.substring(output, F.lit(len(PREFIX) + 1), first_end - len(PREFIX) - 1)
    between = F.substring(output, first_end + len(PREFIX), last - first_end - len(PREFIX))
    middle = F.substring(output, last + len(MIDDLE), F.length(output))
    cut = form != "plain"
    return (
        F.when(cut, F.when(spm, between).otherwise(first)),
        F.when(cut, middle),
        F.when(cut, F.when(spm, first).otherwise(between)),
    )


def restored(output: Column, form: Column) -> Column:
    """The exact text from an output and its form."""
    return F.when(form == "plain", output).otherwise(F.concat(*_parts(output, form)))
