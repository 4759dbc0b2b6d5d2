"""Plans: columns are pruned at the scan, the hot paths have no Python and no single-partition exchange."""

from __future__ import annotations

import re

import pytest

from textloom.operators import dedup, features
from textloom.plans import catalogue

QUERIES = catalogue.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_the_columns_that_count_are_read(spark, sf_dir):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES["lang_source_counts"](spark, sf_dir)))
    assert schemas and all(set(re.findall(r"(\w+):", s)) == {"lang", "source"} for s in schemas)


@pytest.mark.parametrize("name", ["text_quality_metrics", "page_embedded_share", "page_label_check", "ngram_doc_freq", "stable_group_split", "clause_fire", "class_sums", "clause_predict", "explain", "language_audit", "nb_oof_cv"])
def test_no_python_in_relational_queries(spark, sf_dir, name):
    assert not re.search("Python|Pandas|Arrow", plan(QUERIES[name](spark, sf_dir)))


@pytest.mark.parametrize("name", ["text_quality_metrics", "ngram_doc_freq", "stable_group_split", "exact_dedup", "lsh_candidates", "composition"])
def test_rows_of_the_corpus_never_meet_in_one_partition(spark, sf_dir, name):
    assert "SinglePartition" not in plan(QUERIES[name](spark, sf_dir))


def test_a_large_table_is_not_spread(spark, sf_dir):
    from textloom.sources.tables import spread

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "RoundRobin" in plan(spread(docs)) and "RoundRobin" not in plan(spread(docs, small=10))


WITHOUT_PAIRS = ("build_manifest", "build_with_benchmark_as_wild", "cross_set_dedup", "dedup_stats")
WITHOUT_TERMS = ("confusable_pairs", "corrected_t_stat", "corrected_t_test", "inflow", "model_views", "seed_aggregate", "significance", "sink_share", "top_receiver")


@pytest.mark.parametrize("name", WITHOUT_PAIRS)
def test_deduplication_writes_no_pairs(spark, sf_dir, monkeypatch, name):
    """Every shingle of every text and all pairs of a band used to be written."""
    for made in ("candidate_pairs", "band_keys", "shingles"):
        monkeypatch.setattr(dedup, made, None)
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", WITHOUT_TERMS)
def test_two_models_explode_no_texts(spark, sf_dir, monkeypatch, name):
    """The n-grams of all texts used to be exploded three times for each model."""
    monkeypatch.setattr(features, "terms", None)
    assert catalogue.queries()[name](spark, sf_dir).count() > 0
