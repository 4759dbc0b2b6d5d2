"""Clause models: firing, votes, prediction and explanation, and statistics of their rules.

A model is a table (clause_id, class_idx, class, weight, pos array<int>, neg array<int>) and the
number of its features; it is a trained artefact of a few thousand rows and is broadcast.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "clause_id int, class_idx int, class string, weight int, pos array<int>, neg array<int>"
EMPTY = "(empty clause: never fires)"


def model(spark: SparkSession, rows: list[tuple], n_features: int) -> DataFrame:
    """The clauses as a table. Ids, classes and literals are checked."""
    for clause_id, class_idx, _, _, pos, neg in rows:
        if not all(0 <= i < n_features for i in (*pos, *neg)):
            raise ValueError(f"clause {clause_id}: literal out of range")
        if class_idx < 0:
            raise ValueError(f"clause {clause_id}: no class")
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("clause ids repeat")
    return spark.createDataFrame(rows, SCHEMA)


def fires(features: Column, pos: Column, neg: Column) -> Column:
    """All of pos present, none of neg, and one literal at least."""
    return (F.size(pos) + F.size(neg) > 0) & (F.size(F.array_except(pos, features)) == 0) & ~F.arrays_overlap(neg, features)


def fired(rows: DataFrame, clauses: DataFrame) -> DataFrame:
    """rows (doc_id, features, ...) -> a row for each clause that fires, with the clause's columns.

    Clauses of negations alone fire on rows without features, so this is no equi-join: the clauses
    travel as one broadcast array, and every row keeps those that fire before it is exploded.
    """
    every = clauses.agg(F.collect_list(F.struct(*clauses.columns)).alias("clauses_"))
    found = F.filter("clauses_", lambda c: fires(F.col("features"), c["pos"], c["neg"]))
    out = rows.join(F.broadcast(every), F.lit(True)).withColumn("c_", F.explode(found))
    return out.select(*rows.columns, *(F.col(f"c_.{c}").alias(c) for c in clauses.columns))


def class_sums(rows: DataFrame, clauses: DataFrame) -> DataFrame:
    """doc_id, class_idx, class, votes: the weights of the clauses that fire, 0 for a class without any."""
    votes = fired(rows.select("doc_id", "features"), clauses).groupBy("doc_id", "class_idx").agg(F.sum("weight").alias("votes"))
    classes = clauses.select("class_idx", "class").distinct()
    grid = rows.select("doc_id").join(F.broadcast(classes), F.lit(True))
    return grid.join(votes, ["doc_id", "class_idx"], "left").select("doc_id", "class_idx", "class", F.coalesce("votes", F.lit(0)).cast("long").alias("votes"))


def predict(sums: DataFrame) -> DataFrame:
    """doc_id, pred: the class of most votes, the first of the model if tied."""
    best = F.min(F.struct((-F.col("votes")).alias("v"), "class_idx", "class"))
    return sums.groupBy("doc_id").agg(best.alias("b")).select("doc_id", F.col("b.class").alias("pred"))


def rule_text(clauses: DataFrame, vocab: DataFrame) -> DataFrame:
    """clause_id, rule: plain literals first, then negations, in vocabulary order."""
    from ..functions.text import show_term

    names = vocab.agg(F.map_from_entries(F.collect_list(F.struct("feature_id", show_term(F.col("term")).alias("name")))).alias("names_"))
    has = lambda x, sign: F.transform(F.array_sort(x), lambda i: F.concat(F.lit(f"{sign}has("), F.element_at("names_", i), F.lit(")")))
    parts = F.concat(has(F.col("pos"), ""), has(F.col("neg"), "NOT "))
    text = F.when(F.size(parts) > 0, F.array_join(parts, " AND ")).otherwise(EMPTY)
    return clauses.join(F.broadcast(names), F.lit(True)).select("clause_id", "class", text.alias("rule"))


def short_rule(rule: Column, most: int = 6) -> Column:
    """The first parts of a long rule and how many are left out."""
    parts = F.split(rule, " AND ")
    more = F.concat(F.array_join(F.slice(parts, 1, most), " AND "), F.lit(" AND ... (+"), (F.size(parts) - most).cast("string"), F.lit(" more)"))
    return F.when(F.size(parts) > most, more).otherwise(rule)


def explain(rows: DataFrame, clauses: DataFrame, top: int = 8) -> DataFrame:
    """doc_id, class, rank, clause_id, weight: the strongest clauses that fired, by class."""
    strength = Window.partitionBy("doc_id", "class").orderBy(F.abs("weight").desc(), "clause_id")
    ranked = fired(rows.select("doc_id", "features"), clauses).where("weight <> 0").withColumn("rank", F.row_number().over(strength))
    return ranked.where(F.col("rank") <= top).select("doc_id", "class", "rank", "clause_id", "weight")


def by_joins(rows: DataFrame, clauses: DataFrame) -> DataFrame:
    """doc_id, clause_id: the clauses that fire, computed from literals one by one (an independent check)."""
    grid = rows.select("doc_id", "features").join(F.broadcast(clauses.where("size(pos) + size(neg) > 0").select("clause_id", "pos", "neg")), F.lit(True))
    held = F.forall("pos", lambda i: F.array_contains("features", i)) & F.forall("neg", lambda i: ~F.array_contains("features", i))
    return grid.where(held).select("doc_id", "clause_id")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def clause_stats(rows: DataFrame, clauses: DataFrame) -> DataFrame:
    """clause_id, class, weight, fires_own, fires_other, coverage, false_fire_rate, precision; rows have a label."""
    hits = fired(rows.select("doc_id", "features", "label"), clauses)
    counts = hits.groupBy("clause_id").agg(F.count_if(F.col("label") == F.col("class")).alias("own"), F.count_if(F.col("label") != F.col("class")).alias("other"))
    totals = rows.groupBy("label").agg(F.count("*").alias("own_total")).withColumn("all", F.sum("own_total").over(Window.partitionBy()))
    every = rows.agg(F.count("*").alias("every"))
    joined = clauses.join(counts, "clause_id", "left").join(F.broadcast(totals), F.col("class") == F.col("label"), "left").join(F.broadcast(every), F.lit(True))
    own, other = F.coalesce("own", F.lit(0)), F.coalesce("other", F.lit(0))
    mine = F.coalesce("own_total", F.lit(0))
    columns = [_ratio(own, mine).alias("coverage"), _ratio(other, F.col("every") - mine).alias("false_fire_rate"), _ratio(own, own + other).alias("precision")]
    return joined.select("clause_id", "class", "weight", F.size(F.concat("pos", "neg")).alias("n_literals"), own.alias("fires_own"), other.alias("fires_other"), *columns)


def language_summary(clauses: DataFrame, stats: DataFrame) -> DataFrame:
    """Per class: clauses, for, against, zero_weight, empty, literals, weights, duplicates, narrow."""
    rows = clauses.join(stats.select("clause_id", "fires_own", "fires_other"), "clause_id")
    lits = F.concat(F.array_sort("pos"), F.lit([-1]).cast("array<int>"), F.array_sort("neg"))
    rows = rows.withColumn("n", F.size("pos") + F.size("neg")).withColumn("key", F.array_join(F.transform(lits, lambda x: x.cast("string")), ","))
    full = F.col("n") > 0
    copies = rows.where(full).groupBy("class", "key").agg(F.count("*").alias("c")).groupBy("class").agg(F.sum(F.col("c") - 1).alias("duplicates"))
    signed = F.concat(F.transform("pos", lambda i: i + 1), F.transform("neg", lambda i: -(i + 1)))
    distinct = rows.select("class", F.explode(signed).alias("l")).groupBy("class").agg(F.countDistinct("l").alias("distinct_literals"))
    out = rows.groupBy("class").agg(
        F.count("*").alias("clauses"), F.count_if(F.col("weight") > 0).alias("for"), F.count_if(F.col("weight") < 0).alias("against"), F.count_if(F.col("weight") == 0).alias("zero_weight"),
        F.count_if(~full).alias("empty"), F.round(F.coalesce(F.avg(F.when(full, F.col("n"))), F.lit(0.0)), 6).alias("mean_literals"),
        F.coalesce(F.median(F.when(full, F.col("n"))), F.lit(0.0)).alias("median_literals"), F.max("n").alias("max_literals"),
        F.sum(F.greatest("weight", F.lit(0))).alias("total_for"), F.sum(F.greatest(-F.col("weight"), F.lit(0))).alias("total_against"),
        F.count_if(full & (F.col("fires_own") + F.col("fires_other") <= 1)).alias("narrow"),
    )
    joined = out.join(copies, "class", "left").join(distinct, "class", "left")
    return joined.fillna(0, ["duplicates", "distinct_literals"])


def literal_usage(clauses: DataFrame, polarity: str = "for") -> DataFrame:
    """class, feature_id, negated, usage: the share of the class's clauses of one polarity with the literal."""
    chosen = clauses.where(F.col("weight") > 0 if polarity == "for" else F.col("weight") < 0).where("size(pos) + size(neg) > 0")
    totals = chosen.groupBy("class").agg(F.count("*").alias("n"))
    tagged = lambda c, sign: F.transform(c, lambda i: F.struct(i.alias("feature_id"), F.lit(sign).alias("negated")))
    used = chosen.select("class", F.explode(F.concat(tagged("pos", False), tagged("neg", True))).alias("l"))
    counts = used.groupBy("class", "l.feature_id", "l.negated").agg(F.count("*").alias("c"))
    return counts.join(totals, "class").select("class", "feature_id", "negated", F.round(F.col("c") / F.col("n"), 6).alias("usage"))


def signatures(clauses: DataFrame, top: int | None = 10) -> DataFrame:
    """class, rank, feature_id, usage, lift, score: plain literals used much here and little elsewhere."""
    used = literal_usage(clauses).where("not negated")
    k = clauses.agg((F.countDistinct("class") - 1).alias("others"))
    every = Window.partitionBy("feature_id")
    used = used.join(F.broadcast(k), F.lit(True)).withColumn("rest", F.when(F.col("others") > 0, (F.sum("usage").over(every) - F.col("usage")) / F.col("others")).otherwise(0.0))
    lift = (F.col("usage") + 0.01) / (F.col("rest") + 0.01)
    used = used.withColumn("lift", F.round(lift, 6)).withColumn("score", F.round(F.col("usage") * F.log(lift), 6))
    ranked = used.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "feature_id")))
    ranked = ranked.where("usage > 0")
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("class", "rank", "feature_id", "usage", "lift", "score")


def class_overlap(clauses: DataFrame) -> DataFrame:
    """a <= b, jaccard: of the classes' sets of plain literals in clauses for them."""
    sets = clauses.where("weight > 0").select("class", F.explode("pos").alias("f")).groupBy("class").agg(F.collect_set("f").alias("s"))
    sets = clauses.select("class").distinct().join(sets, "class", "left").withColumn("s", F.coalesce("s", F.array().cast("array<int>")))
    a, b = sets.select(F.col("class").alias("a"), F.col("s").alias("sa")), sets.select(F.col("class").alias("b"), F.col("s").alias("sb"))
    union = F.size(F.array_union("sa", "sb"))
    pairs = a.join(F.broadcast(b), F.col("a") <= F.col("b"))
    return pairs.select("a", "b", F.round(_ratio(F.size(F.array_intersect("sa", "sb")), union), 6).alias("jaccard"))


def top_clauses(stats: DataFrame, top: int = 20) -> DataFrame:
    """class, rank, clause_id: clauses for the class by coverage x precision, weight, id."""
    good = stats.where("weight > 0 and n_literals > 0").withColumn("q", F.round(F.col("coverage") * F.col("precision"), 9))
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("q"), F.desc("weight"), "clause_id"))
    return good.withColumn("rank", rank).where(F.col("rank") <= top).select("class", "rank", "clause_id")


def signature_matrix(clauses: DataFrame, per_class: int = 3) -> DataFrame:
    """feature_id, owner (the first class that has it in its top list), class, usage in every class."""
    top = signatures(clauses, per_class).groupBy("feature_id").agg(F.min("class").alias("owner"))
    classes = clauses.select("class").distinct()
    used = literal_usage(clauses).where("not negated").select("class", "feature_id", "usage")
    grid = top.join(F.broadcast(classes), F.lit(True)).join(used, ["class", "feature_id"], "left")
    return grid.select("feature_id", "owner", "class", F.coalesce("usage", F.lit(0.0)).alias("usage"))


def seed_stability(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """signatures of two models (class, term, score, rank) -> class, overlap of the top lists, score_correlation."""
    tops = mine.where("rank is not null").groupBy("class").agg(F.count("*").alias("n"))
    both = mine.select("class", "term", F.col("score").alias("a")).join(theirs.select("class", "term", F.col("score").alias("b")), ["class", "term"])
    found = both.groupBy("class").agg(F.count("*").alias("shared"), F.corr("a", "b").alias("corr"))
    return tops.join(found, "class", "left").select("class", F.round(F.coalesce("shared", F.lit(0)) / F.col("n"), 6).alias("overlap"), F.round("corr", 6).alias("score_correlation"))


def save(clauses: DataFrame, vocab: DataFrame, path: str, meta: dict) -> None:
    """One JSON file: vocabulary, clauses in order, and metadata. A model is an artefact of bounded size."""
    data = {"format": "textloom.clauses/1", "meta": meta, "vocabulary": [r.term for r in vocab.orderBy("feature_id").collect()], "clauses": [r.asDict() for r in clauses.orderBy("clause_id").collect()]}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """clauses, vocabulary, metadata; a wrong format or literal out of range is an error."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if data.get("format") != "textloom.clauses/1":
        raise ValueError(f"{path}: not a clause model")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    clauses = model(spark, [tuple(c[n] for n in names) for c in data["clauses"]], len(data["vocabulary"]))
    return clauses, spark.createDataFrame(list(enumerate(data["vocabulary"])), "feature_id int, term string"), data["meta"]
