"""Error analysis of out-of-fold predictions: one row (doc_id, label, model, seed, pred) each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics


def model_views(oof: DataFrame) -> DataFrame:
    """model, label, pred, n: seeds of a model are pooled."""
    return oof.groupBy("model", "label", "pred").agg(F.count("*").alias("n"))


def confusable_pairs(oof: DataFrame) -> DataFrame:
    """model, a < b, a_as_b, b_as_a, total: errors between two classes, a seed on average."""
    seeds = oof.groupBy("model").agg(F.countDistinct("seed").alias("seeds"))
    wrong = oof.where("label <> pred").withColumn("a", F.least("label", "pred")).withColumn("b", F.greatest("label", "pred"))
    counts = wrong.groupBy("model", "a", "b").agg(F.count_if(F.col("label") == F.col("a")).alias("ab"), F.count("*").alias("n")).join(F.broadcast(seeds), "model")
    per = lambda c: F.round(c / F.col("seeds"), 6)
    return counts.select("model", "a", "b", per(F.col("ab")).alias("a_as_b"), per(F.col("n") - F.col("ab")).alias("b_as_a"), per(F.col("n")).alias("total"))


def wrong_seeds(oof: DataFrame) -> DataFrame:
    """doc_id, label, wrong, seeds."""
    return oof.groupBy("doc_id", "label").agg(F.count_if(F.col("label") != F.col("pred")).alias("wrong"), F.count("*").alias("seeds"))


def seed_agreement(oof: DataFrame) -> DataFrame:
    """wrong, n: how many rows so many seeds get wrong."""
    return wrong_seeds(oof).groupBy("wrong").agg(F.count("*").alias("n"))


def hardness(oof: DataFrame) -> DataFrame:
    """doc_id, kind: hard (all seeds wrong) or sometimes."""
    kind = F.when(F.col("wrong") == F.col("seeds"), "hard").otherwise("sometimes")
    return wrong_seeds(oof).where("wrong > 0").select("doc_id", kind.alias("kind"))


def majority_vote(oof: DataFrame) -> DataFrame:
    """doc_id, label, pred: the most frequent prediction over seeds, the first by name if tied."""
    counts = oof.groupBy("doc_id", "label", "pred").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "pred"))
    return counts.groupBy("doc_id", "label").agg(best.alias("b")).select("doc_id", "label", "b.pred")


def agreement(ours: DataFrame, base: DataFrame) -> DataFrame:
    """ours (doc_id, label, seed, pred), base (doc_id, pred) -> McNemar by seed, and seed `majority`."""
    every = ours.select("doc_id", "label", F.col("seed").cast("string").alias("seed"), "pred").unionByName(majority_vote(ours).withColumn("seed", F.lit("majority")))
    pairs = every.withColumnRenamed("pred", "a").join(base.select("doc_id", F.col("pred").alias("b")), "doc_id")
    return metrics.mcnemar(pairs, ("seed",))


def inflow(oof: DataFrame) -> DataFrame:
    """model, class, n, share: the errors that each class receives."""
    classes = oof.select(F.col("label").alias("class")).unionAll(oof.select(F.col("pred").alias("class"))).distinct()
    wrong = oof.where("label <> pred").groupBy("model", F.col("pred").alias("class")).agg(F.count("*").alias("n"))
    grid = oof.select("model").distinct().join(F.broadcast(classes), F.lit(True)).join(wrong, ["model", "class"], "left")
    grid = grid.withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("model"))
    return grid.withColumn("share", F.round(F.when(total > 0, F.col("n") / total).otherwise(0.0), 6))


def top_receiver(flows: DataFrame) -> DataFrame:
    """model, class of most errors received, the first by name if tied."""
    best = F.min(F.struct((-F.col("n")).alias("n"), "class"))
    return flows.groupBy("model").agg(best.alias("b")).select("model", F.col("b.class").alias("class"))


def sink_share(flows: DataFrame, model: str) -> DataFrame:
    """sink, share, chance, supported: does the class that receives most get more than chance and than any other model sends it?"""
    sink = top_receiver(flows.where(F.col("model") == model)).select(F.col("class").alias("sink"))
    mine = flows.join(F.broadcast(sink), F.col("class") == F.col("sink"))
    chance = 1 / (F.first("k") - 1)
    k = flows.agg(F.countDistinct("class").alias("k"))
    own = F.max(F.when(F.col("model") == model, F.col("share")))
    rest = F.coalesce(F.max(F.when(F.col("model") != model, F.col("share"))), F.lit(-1.0))
    out = mine.join(F.broadcast(k), F.lit(True)).groupBy("sink").agg(own.alias("share"), F.round(chance, 6).alias("chance"), rest.alias("rest"))
    return out.select("sink", "share", "chance", ((F.col("share") > F.col("chance")) & (F.col("share") > F.col("rest"))).alias("supported"))


def narrow_wins(sums: DataFrame, preds: DataFrame, sink: Column) -> DataFrame:
    """doc_id, into_sink, margin: the winner's votes over the true class's, for each error."""
    win = sums.select("doc_id", F.col("class").alias("pred"), F.col("votes").alias("won"))
    true = sums.select("doc_id", F.col("class").alias("label"), F.col("votes").alias("had"))
    wrong = preds.where("label <> pred").join(win, ["doc_id", "pred"]).join(true, ["doc_id", "label"])
    return wrong.select("doc_id", (F.col("pred") == sink).alias("into_sink"), (F.col("won") - F.col("had")).alias("margin"))


def foreign_votes(fired_rows: DataFrame, labels: DataFrame) -> DataFrame:
    """class, for, against, sum: mean votes on rows of other classes. fired_rows: doc_id, label, class, weight."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("own")).withColumn("all", F.sum("own").over(Window.partitionBy()))
    votes = fired_rows.where(F.col("label") != F.col("class")).groupBy("class").agg(F.sum(F.greatest("weight", F.lit(0))).alias("f"), F.sum(F.greatest(-F.col("weight"), F.lit(0))).alias("g"))
    grid = sizes.join(votes, F.col("class") == F.col("label"), "left")
    n = F.col("all") - F.col("own")
    mean = lambda c: F.round(F.coalesce(c, F.lit(0)) / n, 6)
    return grid.select(F.col("label").alias("class"), mean(F.col("f")).alias("for"), mean(F.col("g")).alias("against"), F.round((F.coalesce("f", F.lit(0)) - F.coalesce("g", F.lit(0))) / n, 6).alias("sum"))


def signature_frequency(signed: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """class, feature_id, own_df, foreign_df: shares of rows (doc_id, label) whose text has the signature's term."""
    sizes = rows.groupBy("label").agg(F.count("*").alias("n_c")).withColumn("n", F.sum("n_c").over(Window.partitionBy()))
    counts = found.join(F.broadcast(signed.select("feature_id").distinct()), "feature_id").groupBy("feature_id", "label").agg(F.count("*").alias("c"))
    totals = counts.groupBy("feature_id").agg(F.sum("c").alias("t"))
    grid = signed.select("class", "feature_id").join(sizes, F.col("class") == F.col("label")).drop("label")
    grid = grid.join(counts.withColumnRenamed("label", "class"), ["class", "feature_id"], "left").join(totals, "feature_id", "left").fillna(0, ["c", "t"])
    own, other = F.col("c") / F.col("n_c"), (F.col("t") - F.col("c")) / (F.col("n") - F.col("n_c"))
    return grid.select("class", "feature_id", F.round(own, 6).alias("own_df"), F.round(other, 6).alias("foreign_df"))


def pulling_rules(fired_rows: DataFrame, preds: DataFrame, sink: str, top: int = 10) -> DataFrame:
    """rank, clause_id, n: the sink's clauses that fired most often on other classes' rows taken for it."""
    into = preds.where((F.col("pred") == sink) & (F.col("label") != sink)).select("doc_id")
    hits = fired_rows.where((F.col("class") == sink) & (F.col("weight") > 0)).select("doc_id", "clause_id")
    counts = hits.join(into, "doc_id", "left_semi").groupBy("clause_id").agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), "clause_id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "clause_id"))).select("rank", "clause_id", "n")


def pulling_terms(fired_rows: DataFrame, preds: DataFrame, sink: str, top: int = 15) -> DataFrame:
    """rank, feature_id, n: the plain literals of those clauses, once a row."""
    into = preds.where((F.col("pred") == sink) & (F.col("label") != sink)).select("doc_id")
    hits = fired_rows.where((F.col("class") == sink) & (F.col("weight") > 0)).select("doc_id", F.explode("pos").alias("feature_id")).distinct()
    counts = hits.join(into, "doc_id", "left_semi").groupBy("feature_id").agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), "feature_id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "feature_id"))).select("rank", "feature_id", "n")


def generic_signatures(frequency: DataFrame) -> DataFrame:
    """class, foreign_df, highest: do a class's signature terms occur elsewhere more than any other class's do?"""
    means = frequency.groupBy("class").agg(F.round(F.avg("foreign_df"), 6).alias("foreign_df"))
    top = F.row_number().over(Window.orderBy(F.desc("foreign_df"), "class")) == 1
    return means.withColumn("highest", top)


def embedded_probe(rows: DataFrame) -> DataFrame:
    """rows (share, wrong boolean, errors, seeds) of one class -> medians by fate, U, and error rates below and above one half."""
    stats = metrics.rank_sum(rows, "share", F.col("wrong"), "greater").select("n1", "n2", "u")
    above = F.col("share") > 0.5
    rate = lambda test: F.round(F.coalesce(F.sum(F.when(test, F.col("errors"))) / F.sum(F.when(test, F.col("seeds"))), F.lit(0.0)), 6)
    medians = rows.agg(F.round(F.median(F.when(F.col("wrong"), F.col("share"))), 6).alias("median_wrong"), F.round(F.median(F.when(~F.col("wrong"), F.col("share"))), 6).alias("median_right"), rate(above).alias("rate_embedded"), rate(~above).alias("rate_rest"))
    return stats.join(medians, F.lit(True))
