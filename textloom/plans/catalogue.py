"""All queries over the driver's tables, with their oracles."""

from __future__ import annotations

from . import curation, inspection, modelling, studies  # noqa: F401
from .registry import ORACLES, QUERIES


def flagship(spark, sf_dir):
    """Split, vocabulary, naive Bayes and macro-F1 in one query."""
    return QUERIES["macro_f1"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
