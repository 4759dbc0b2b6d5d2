"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, source mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, read
from textloom.llm.near_duplicates import near_duplicates, without
from textloom.llm.op4_decontaminate import contamination
from textloom.llm.op6_language import UNKNOWN, identify
from textloom.llm.op7_lines import line_dedup
from textloom.llm.op9_mixing import weighted_fair_mix

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = ("lang", "source", "n_chars")

# Of all stages: other columns than those of documents are left out, rows that repeat are treated
# alike, an empty table gives an empty one, and texts of any length are read whole.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach, which becomes their `lang`.

    Null texts and those without a letter go, as do those that share hardly an n-gram with any
    landmark (score 0). Without any label to learn from no language is known and all documents go.
    """
    found = identify(docs.withColumn("lang_", F.col("lang")), lang_col="lang_", carry=("text", *OTHERS))
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that occur earlier; those with nothing left go.

    `n_chars` of a document that loses lines is that of what is left. Null and empty texts stay.
    """
    cut = line_dedup(docs, carry=OTHERS)
    shorter = F.col("n_removed") > 0
    kept = cut.where(~shorter | (F.length(F.trim("text")) > 0))
    return kept.withColumn("n_chars", F.when(shorter, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id.

    Texts without words, null ones included, are one group. Rows equal in id and text are one
    document and stay or go together.
    """
    return without(docs, near_duplicates(docs)).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark. Null and empty texts hold none."""
    found = contamination(docs, read(spark, sf_dir, "benchmark"))
    return without(docs, found.select(F.col("doc_id").alias("id"), "th")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document. Null texts have size 0; the null source is one of its own."""
    return weighted_fair_mix(docs)


STAGES = [("language", language), ("lines", lines), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]

#: SQL can't express the language model, the rolling hashes or the fingerprints; tests/llm compares
#: the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
