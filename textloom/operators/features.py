"""Binary features: n-gram and word presence, document frequency, vocabulary selection, literals.

Terms are long tables (doc, term), never dense matrices. Statistics by class come from one
aggregation; those of the rows outside a fold are the totals less the fold's own (`held_out_counts`),
so a vocabulary for each fold costs no further look at the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_ngrams, identifiers
from .grams import count_batches

#: Delimiters that can be put first in a vocabulary.
DELIMITERS = (";", "{", "}", "(", ")", "[", "]", "//", "#", "/*", "--", "<", ">", "\t", "    ", "::", "->", "=>")


def terms(rows: DataFrame, sizes: tuple[int, ...] = (2, 3), words: bool = False) -> DataFrame:
    """rows with `term`, one for each distinct n-gram (and word, with the prefix NUL) of the text."""
    grams = char_ngrams(F.col("text"), sizes)
    if words:
        grams = F.concat(grams, F.transform(identifiers(F.col("text")), lambda w: F.concat(F.lit("\0"), w)))
    return rows.withColumn("term", F.explode(grams)).drop("text")


def document_frequency(long: DataFrame, min_df: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    return long.groupBy(*by, "term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)


def class_counts(long: DataFrame) -> DataFrame:
    """term, language, df_c: all that rankings and naive Bayes need of the texts; as small as the terms are few."""
    return long.groupBy("term", "language").agg(F.count("*").alias("df_c"))


def repo_counts(rows: DataFrame) -> DataFrame:
    """repo, language, term, n: how many of the rows' texts hold each n-gram of 2 and 3; workers sum up what they see."""
    part = rows.select("repo", "language", "text").mapInArrow(count_batches, "repo string, language string, term string, n long")
    return part.groupBy("repo", "language", "term").agg(F.sum("n").alias("n"))


def class_sizes(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, language, n_c: the number of rows, which may be counted already (n_rows)."""
    n = F.sum("n_rows") if "n_rows" in rows.columns else F.count("*")
    return rows.groupBy(*by, "language").agg(n.alias("n_c"))


def held_out_counts(counts: DataFrame, n_folds: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, fold, term, language, df_c of the rows outside each fold, from df_c inside each (by, fold, term, language)."""
    own = F.map_from_entries(F.collect_list(F.struct("fold", "df_c")))
    total = counts.groupBy(*by, "term", "language").agg(F.sum("df_c").alias("every"), own.alias("own"))
    spread = total.withColumn("fold", F.explode(F.array(*map(F.lit, range(n_folds)))))
    rest = F.col("every") - F.coalesce(F.try_element_at("own", "fold"), F.lit(0))
    return spread.select(*by, "fold", "term", "language", rest.alias("df_c")).where("df_c > 0")


def _with_totals(counts: DataFrame, rows: DataFrame, min_df: int, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(by, term, language, df_c, df) and (by, language, n_c, n); the latter has a row for each class."""
    total = counts.groupBy(*by, "term").agg(F.sum("df_c").alias("df")).where(F.col("df") >= min_df)
    sizes = class_sizes(rows, by)
    return counts.join(total, [*by, "term"]), sizes.withColumn("n", F.sum("n_c").over(Window.partitionBy(*by)))


def rank_frequency(counts: DataFrame, rows: DataFrame, budget: int, min_df: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """by, rank, term, score: by document frequency, then by name."""
    total = counts.groupBy(*by, "term").agg(F.sum("df_c").alias("df")).where(F.col("df") >= min_df)
    return _ranked(total.withColumn("score", F.col("df").cast("double")), [F.desc("df"), F.col("term")], budget, by)


def rank_chi2(counts: DataFrame, rows: DataFrame, budget: int, min_df: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """by, rank, term, score: the chi-square of presence counts against class shares, then by name.

    Sum over classes of (obs - exp)^2 / exp with exp = df n_c / n; a class without the term adds exp.
    """
    counts, sizes = _with_totals(counts, rows, min_df, by)
    # sum (o - e)^2 / e = sum o^2 / e - df, so absent cells need no rows
    part = F.sum(F.col("df_c") * F.col("df_c") * F.col("n") / F.col("n_c") / F.col("df"))
    score = counts.join(F.broadcast(sizes), [*by, "language"]).groupBy(*by, "term", "df").agg((part - F.col("df")).alias("raw"))
    return _ranked(score.withColumn("score", F.round("raw", 6)), [F.desc("score"), F.col("term")], budget, by)


def rank_class_balanced(counts: DataFrame, rows: DataFrame, budget: int, min_df: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """by, rank, term, score: classes in order take turns, each with its next most distinctive term.

    Distinctive is P(term | class) - P(term | other classes). A term goes to the earliest turn that
    any class ranks it at; ordering by that turn and class is the round robin in closed form. Only
    the first `budget` terms of each class can matter.
    """
    counts, sizes = _with_totals(counts, rows, min_df, by)
    classes = F.array(*(F.lit(r.language) for r in sizes.select("language").distinct().orderBy("language").collect()))
    own = F.map_from_entries(F.collect_list(F.struct("language", "df_c")))
    cells = counts.groupBy(*by, "term", "df").agg(own.alias("own")).withColumn("language", F.explode(classes))
    cells = cells.withColumn("df_c", F.coalesce(F.try_element_at("own", "language"), F.lit(0))).join(F.broadcast(sizes), [*by, "language"])
    rest = F.when(F.col("n") > F.col("n_c"), (F.col("df") - F.col("df_c")) / (F.col("n") - F.col("n_c"))).otherwise(0.0)
    seen = cells.select(*by, "term", "language", F.round(F.col("df_c") / F.col("n_c") - rest, 9).alias("score"))
    by_class = Window.partitionBy(*by, "language").orderBy(F.desc("score"), "term")
    ranked = seen.withColumn("turn", F.row_number().over(by_class)).where(F.col("turn") <= budget)
    first = ranked.groupBy(*by, "term").agg(F.min(F.struct("turn", "language", "score")).alias("at"))
    return _ranked(first.select(*by, "term", "at.turn", "at.language", "at.score"), [F.col("turn"), F.col("language")], budget, by)


def _ranked(scored: DataFrame, order: list, budget: int, by: tuple[str, ...]) -> DataFrame:
    """The first `budget` rows, numbered from 0; the limit on the rank reaches the partitions before they are shuffled."""
    top = scored if by else scored.orderBy(*order).limit(budget)
    numbered = top.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).alias("rank"), "term", "score")
    return numbered.where(F.col("rank") < budget)


RANKINGS = {"frequency": rank_frequency, "chi2": rank_chi2, "class_balanced": rank_class_balanced}


@dataclass(frozen=True)
class Settings:
    """What a vocabulary is made from."""

    n_features: int = 100
    sizes: tuple[int, ...] = (2, 3)
    delimiters: bool = False
    selection: str = "class_balanced"
    min_df: int = 2
    words: bool = False


def vocabulary(rows: DataFrame, settings: Settings = Settings(), counts: DataFrame | None = None) -> DataFrame:
    """feature_id, term: fixed delimiters first if wanted, then the best ranked other terms.

    counts: the class counts of the rows' terms, if they are at hand.
    """
    if settings.selection not in RANKINGS:
        raise ValueError(f"unknown selection {settings.selection!r}")
    if counts is None:
        counts = class_counts(terms(rows, settings.sizes, settings.words))
    base = DELIMITERS[: settings.n_features] if settings.delimiters else ()
    if base:
        counts = counts.where(~F.col("term").isin(*base))
    ranked = RANKINGS[settings.selection](counts, rows, settings.n_features - len(base), settings.min_df)
    out = ranked.select((F.col("rank") + len(base)).cast("int").alias("feature_id"), "term")
    if base:
        fixed = rows.sparkSession.createDataFrame(list(enumerate(base)), "feature_id int, term string")
        out = fixed.unionAll(out)
    return out


def presence(rows: DataFrame, vocab: DataFrame, sizes: tuple[int, ...] = (2, 3), words: bool = False) -> DataFrame:
    """rows without the text, and feature_id: one row for each vocabulary term that the text holds.

    The vocabulary has n_features rows, a setting, so it is broadcast; texts are exploded once. A
    delimiter that is no n-gram of the sizes is sought by itself.
    """
    long = terms(rows, sizes, words).join(F.broadcast(vocab), "term").drop("term")
    others = [d for d in DELIMITERS if len(d) not in sizes]
    if not others:
        return long
    odd = F.array(*map(F.lit, others))
    extra = rows.withColumn("term", F.explode(F.filter(odd, lambda d: F.contains(F.col("text"), d)))).drop("text")
    return long.unionByName(extra.join(F.broadcast(vocab), "term").drop("term"))


def feature_sets(rows: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, features: the sorted feature ids of every row, none included."""
    sets = found.groupBy(key).agg(F.array_sort(F.collect_list("feature_id")).alias("features"))
    empty = F.array().cast("array<int>")
    return rows.select(key).join(sets, key, "left").select(key, F.coalesce("features", empty).alias("features"))


def literals(features: Column, n_features: int) -> Column:
    """The ids present, and n_features + id for each absent one."""
    every = F.sequence(F.lit(0), F.lit(n_features - 1))
    return F.concat(features, F.transform(F.array_except(every, features), lambda i: i + n_features))


class Binarizer:
    """fit on rows (text, language), then transform texts to feature sets."""

    def __init__(self, settings: Settings = Settings()):
        self.settings, self.terms = settings, None

    def fit(self, rows: DataFrame, counts: DataFrame | None = None) -> Binarizer:
        self.terms = [r.term for r in vocabulary(rows, self.settings, counts).orderBy("feature_id").collect()]
        return self

    def vocabulary(self, spark) -> DataFrame:
        if self.terms is None:
            raise ValueError("fit the binarizer first")
        return spark.createDataFrame(list(enumerate(self.terms)), "feature_id int, term string")

    def transform(self, rows: DataFrame) -> DataFrame:
        found = presence(rows.select("doc_id", "text"), self.vocabulary(rows.sparkSession), self.settings.sizes, self.settings.words)
        return feature_sets(rows, found)

    def to_dict(self) -> dict:
        return {"settings": self.settings.__dict__ | {"sizes": list(self.settings.sizes)}, "vocabulary": self.terms}

    @classmethod
    def from_dict(cls, data: dict) -> Binarizer:
        out = cls(Settings(**(data["settings"] | {"sizes": tuple(data["settings"]["sizes"])})))
        out.terms = list(data["vocabulary"])
        return out
