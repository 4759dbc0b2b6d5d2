"""Audit of a labelled corpus: statistics and flags by language, suspect labels, shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Limits of the audit.
MAX_TOP_REPO, MAX_TEST, MAX_COMMENTS, MIN_BALANCE = 0.10, 0.40, 0.40, 0.60


def language_stats(rows: DataFrame) -> DataFrame:
    """rows (language, repo, text, role) -> one row a language; the top repository is the first by name if tied."""
    made = rows.withColumn("lines_", T.non_blank_lines(F.col("text")))
    made = made.select("language", "repo", "role", F.size(F.split("text", "\n")).alias("n_lines"), F.length("text").alias("n_chars"), T.comment_ratio(F.col("lines_")).alias("comments"), T.non_ascii_share(F.col("text")).alias("foreign"))
    repos = made.groupBy("language", "repo").agg(F.count("*").alias("n"))
    top = repos.groupBy("language").agg(F.count("*").alias("repos"), F.min(F.struct((-F.col("n")).alias("n"), "repo")).alias("top"))
    median = lambda c: F.round(F.median(c), 6)
    stats = made.groupBy("language").agg(
        F.count("*").alias("snippets"), median("n_lines").alias("median_lines"), median("n_chars").alias("median_chars"),
        median("comments").alias("median_comments"), F.round(F.avg("foreign"), 6).alias("mean_non_ascii"), F.count_if(F.col("role") == "test").alias("tests"),
    )
    joined = stats.join(top, "language")
    return joined.select(*stats.columns, "repos", F.col("top.repo").alias("top_repo"), F.round(-F.col("top.n") / F.col("snippets"), 6).alias("top_share"))


def flags(stats: DataFrame) -> DataFrame:
    """language, flag."""
    largest = F.max("snippets").over(Window.partitionBy())
    rows = stats.withColumn("largest", largest)
    found = F.array_compact(F.array(
        F.when(F.col("top_share") > MAX_TOP_REPO, "one repo dominates"),
        F.when(F.col("tests") / F.col("snippets") > MAX_TEST, "mostly test files"),
        F.when(F.col("median_comments") > MAX_COMMENTS, "mostly comments"),
        F.when(F.col("snippets") < MIN_BALANCE * F.col("largest"), "class imbalance"),
    ))
    return rows.select("language", F.explode(found).alias("flag"))


def confident_learning(probs: DataFrame) -> DataFrame:
    """probs (doc_id, label, class, p) -> doc_id, given, suggested, margin: rows whose label the model doubts.

    A class's threshold is the mean probability of its own rows; a row's confident class is the
    most probable of those that reach their threshold (the first by name if tied).
    """
    limits = probs.where("label = class").groupBy("class").agg(F.avg("p").alias("limit"))
    reached = probs.join(F.broadcast(limits), "class").where(F.round("p", 9) >= F.round("limit", 9))
    best = reached.groupBy("doc_id", "label").agg(F.min(F.struct((-F.round("p", 9)).alias("q"), "class")).alias("b"))
    own = probs.where("label = class").select("doc_id", F.col("p").alias("own"))
    joined = best.join(own, "doc_id")
    return joined.select("doc_id", F.col("label").alias("given"), F.col("b.class").alias("suggested"), F.round(-F.col("b.q") - F.col("own"), 6).alias("margin"))


def label_issues(confident: DataFrame) -> DataFrame:
    return confident.where("given <> suggested")


def joint_counts(confident: DataFrame) -> DataFrame:
    return confident.groupBy("given", "suggested").agg(F.count("*").alias("n"))


def shortcut_probe(weights: DataFrame, found: DataFrame, rows: DataFrame, top: int = 10, min_repos: int = 3) -> DataFrame:
    """weights (class, feature_id, weight) -> class, rank, feature_id, snippets, repos, other_share, suspect.

    The heaviest positive features of each class: in how many of its rows and repositories they
    occur, and in what share of other classes' rows. Few repositories are a suspected shortcut.
    """
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("weight"), "feature_id"))
    best = weights.where("weight > 0").withColumn("rank", rank).where(F.col("rank") <= top)
    hits = found.join(F.broadcast(best.select("class", "feature_id")), "feature_id")
    own = F.col("language") == F.col("class")
    counts = hits.groupBy("class", "feature_id").agg(F.count_if(own).alias("snippets"), F.countDistinct(F.when(own, F.col("repo"))).alias("repos"), F.count_if(~own).alias("other"))
    sizes = rows.groupBy(F.col("language").alias("class")).agg(F.count("*").alias("n_c")).withColumn("n", F.sum("n_c").over(Window.partitionBy()))
    joined = best.join(counts, ["class", "feature_id"]).join(F.broadcast(sizes), "class")
    share = F.round(F.col("other") / (F.col("n") - F.col("n_c")), 6)
    return joined.select("class", "rank", "feature_id", "snippets", "repos", share.alias("other_share"), (F.col("repos") < min_repos).alias("suspect"))
