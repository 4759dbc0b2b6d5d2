"""Bernoulli naive Bayes on feature presence, for any number of folds in one pass.

log P(class) + sum over present features of log p + over absent ones of log(1 - p) is computed as
a constant per class plus one term per present feature, so absent features cost nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import class_sizes
from .grams import score_batches


def fit(found: DataFrame, rows: DataFrame, vocab: DataFrame, by: tuple[str, ...] = (), alpha: float = 1.0) -> DataFrame:
    """by, language, feature_id, log_p, log_q, log_prior from training rows; every class has every feature."""
    return fit_counts(found.groupBy(*by, "language", "feature_id").agg(F.count("*").alias("df")), rows, vocab, by, alpha)


def fit_counts(counts: DataFrame, rows: DataFrame, vocab: DataFrame, by: tuple[str, ...] = (), alpha: float = 1.0) -> DataFrame:
    """As fit, from the number of rows (df) of each class that hold each feature.

    The vocabulary is one for all (feature_id), or has the columns of `by` too.
    """
    sizes = class_sizes(rows, by)
    sizes = sizes.withColumn("prior", F.log(F.col("n_c") / F.sum("n_c").over(Window.partitionBy(*by))))
    # one row a class with its counts in a map, spread over the vocabulary's ids
    maps = counts.groupBy(*by, "language").agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "df"))).alias("dfs"))
    own = [c for c in by if c in vocab.columns]
    ids = vocab.groupBy(*own).agg(F.array_sort(F.collect_list("feature_id")).alias("ids"))
    grid = sizes.join(maps, [*by, "language"], "left").join(F.broadcast(ids), own or F.lit(True)).withColumn("feature_id", F.explode("ids"))
    p = (F.coalesce(F.try_element_at("dfs", "feature_id"), F.lit(0)) + alpha) / (F.col("n_c") + 2 * alpha)
    return grid.select(*by, "language", "feature_id", F.log(p).alias("log_p"), F.log(1 - p).alias("log_q"), F.col("prior").alias("log_prior"))


def scores(model: DataFrame, found: DataFrame, rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, doc_id, label, class, score: the joint log probability of every class for every row.

    The model is classes x features x folds rows, all settings, and is broadcast.
    """
    base = model.groupBy(*by, F.col("language").alias("class")).agg((F.sum("log_q") + F.first("log_prior")).alias("base"))
    gain = model.select(*by, F.col("language").alias("class"), "feature_id", (F.col("log_p") - F.col("log_q")).alias("gain"))
    own = found.select(*by, "doc_id", "feature_id").join(F.broadcast(gain), [*by, "feature_id"])
    own = own.groupBy(*by, "doc_id", "class").agg(F.sum("gain").alias("gain"))
    labelled = rows.select(*by, "doc_id", F.col("language").alias("label"))
    every = labelled.join(F.broadcast(base), list(by)) if by else labelled.join(F.broadcast(base), F.lit(True))
    joined = every.join(own, [*by, "doc_id", "class"], "left")
    return joined.select(*by, "doc_id", "label", "class", F.round(F.col("base") + F.coalesce("gain", F.lit(0.0)), 6).alias("score"))


def predict(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, doc_id, label, pred: the best class, the first by name if tied."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("class").alias("class")))
    return scored.groupBy(*by, "doc_id", "label").agg(best.alias("best")).select(*by, "doc_id", "label", F.col("best.class").alias("pred"))


def probabilities(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, doc_id, label, class, p: the scores normalised by log-sum-exp."""
    w = Window.partitionBy(*by, "doc_id")
    shifted = F.exp(F.col("score") - F.max("score").over(w))
    return scored.withColumn("e", shifted).withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e", "score")


def out_of_fold(rows: DataFrame, model: list, vocab: list, sizes: tuple[int, ...], n_folds: int, n_seeds: int) -> tuple[DataFrame, list]:
    """(rows without the text, with `scores`; the classes): the scores of each row by the models of its own folds.

    rows have folds (one a seed) and a text; model and vocab are the collected rows of `fit_counts`
    and of the vocabularies (seed, fold, feature_id, term). A size takes the first terms of each
    vocabulary: features are independent given the class, so its model is a part of the whole one.
    scores has those of every size, seed and class in turn, null for a class that a model has not.
    """
    classes = sorted({r.language for r in model}, key=lambda c: (c is not None, c))
    terms = sorted({r.term for r in vocab})
    place, column = {t: i for i, t in enumerate(terms)}, {c: i for i, c in enumerate(classes)}
    term = {(r.seed, r.fold, r.feature_id): place[r.term] for r in vocab}
    gain = np.zeros((len(sizes), n_seeds, n_folds, len(terms), len(classes)))
    base = np.full((len(sizes), n_seeds, n_folds, len(classes)), np.nan)
    for m, size in enumerate(sizes):
        for r in sorted((r for r in model if r.feature_id < size), key=lambda r: r.feature_id):
            at = (m, r.seed, r.fold)
            base[(*at, column[r.language])] = r.log_q + (r.log_prior if np.isnan(base[(*at, column[r.language])]) else base[(*at, column[r.language])])
            gain[(*at, term[r.seed, r.fold, r.feature_id], column[r.language])] = r.log_p - r.log_q
    models = [[(gain[m, k, f], base[m, k, f]) for f in range(n_folds)] for m in range(len(sizes)) for k in range(n_seeds)]
    schema = T.StructType([*rows.drop("text").schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(lambda batches: score_batches(batches, terms, models), schema), classes


def held_out(assigned: DataFrame, n_folds: int) -> tuple[DataFrame, DataFrame]:
    """Training rows spread over the folds: (rows to fit, with the fold left out; rows to test, with their fold)."""
    folds = F.array(*map(F.lit, range(n_folds)))
    fit_rows = assigned.withColumn("out", F.explode(folds)).where("fold <> out").drop("fold").withColumnRenamed("out", "fold")
    return fit_rows, assigned
