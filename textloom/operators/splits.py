"""Leak-free splits and folds by a hash of the repository, and hash-ordered samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT = "textloom-v1"


def unit(salt: Column | str, kind: str, key: Column) -> Column:
    """A number in [0, 1) from sha256 of salt:kind:key; the same in any engine."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    digest = F.sha2(F.concat_ws(":", salt, F.lit(kind), key), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").cast("double") / F.lit(float(1 << 60))


def repo_languages(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """repo, language: the most frequent label of each repository, the first by name if tied."""
    counts = rows.groupBy(*by, "repo", "language").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("language").alias("language")))
    return counts.groupBy(*by, "repo").agg(best.alias("best")).select(*by, "repo", "best.language")


def stable_split(rows: DataFrame, test_size: float = 0.2, n_folds: int = 5, salts: list[str] | None = None) -> DataFrame:
    """repo, language, split (train or test), fold (null for test), and `salt` if several are given.

    In each language the repositories first by one hash are the test set: the rounded share, but
    one at least and not all if there are several. The others, ordered by a second hash, are cut
    into equal consecutive folds. All salts are computed together.
    """
    if not 0 < test_size < 0.5:
        raise ValueError("test_size must be in (0, 0.5)")
    if n_folds < 2:
        raise ValueError("n_folds must be >= 2")
    repos = repo_languages(rows).withColumn("salt", F.explode(F.array(*map(F.lit, salts or [SALT]))))
    repos = repos.withColumn("u", unit(F.col("salt"), "test", F.col("repo"))).withColumn("v", unit(F.col("salt"), "fold", F.col("repo")))
    group = Window.partitionBy("salt", "language")
    repos = repos.withColumn("n", F.count("*").over(group)).withColumn("rank", F.row_number().over(group.orderBy("u", "repo")))
    wanted = F.bround(F.col("n") * test_size, 0).cast("int")
    k = F.when(F.col("n") > 1, F.least(F.greatest(wanted, F.lit(1)), F.col("n") - 1)).otherwise(wanted)
    repos = repos.withColumn("k", k).withColumn("test", F.col("rank") <= F.col("k"))
    place = F.row_number().over(Window.partitionBy("salt", "language", "test").orderBy("v", "repo")) - 1
    fold = F.when(~F.col("test"), F.floor(place * n_folds / (F.col("n") - F.col("k"))).cast("int"))
    out = repos.select("salt", "repo", "language", F.when(F.col("test"), "test").otherwise("train").alias("split"), fold.alias("fold"))
    return out if salts else out.drop("salt")


def assign(rows: DataFrame, split: DataFrame) -> DataFrame:
    """rows with split and fold of their repository. The table of repositories is far smaller than the rows."""
    return rows.join(split.drop("language"), "repo")


def shared_repos(train: DataFrame, test: DataFrame) -> DataFrame:
    """Repositories on both sides: none, unless the split leaks."""
    return train.select("repo").intersect(test.select("repo"))


def warnings(assigned: DataFrame, minimum: int = 5) -> DataFrame:
    """language, warning: too few or no training repositories, or no test data."""
    repos = lambda s: F.countDistinct(F.when(F.col("split") == s, F.col("repo")))
    counts = assigned.groupBy("language").agg(repos("train").alias("train"), repos("test").alias("test"))
    few = F.when(F.col("train") == 0, "no train repos").when(F.col("train") < minimum, "few train repos")
    found = F.array_compact(F.array(few, F.when(F.col("test") == 0, F.lit("no test data"))))
    return counts.select("language", F.explode(found).alias("warning"))


def place_counts(repos: DataFrame, split: DataFrame) -> DataFrame:
    """place (train, test or neither), n: where other rows' repositories fall in a split."""
    joined = repos.select("repo").join(split.select("repo", "split"), "repo", "left")
    return joined.groupBy(F.coalesce("split", F.lit("neither")).alias("place")).agg(F.count("*").alias("n"))


def sample(rows: DataFrame, n: int, salt: str = SALT, by: str = "language", key: str = "doc_id") -> DataFrame:
    """The n rows of each group that are first by a hash of their key, with their rank."""
    order = Window.partitionBy(by).orderBy(unit(salt, "sample", F.col(key).cast("string")), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def round_robin(rows: DataFrame, band: str, key: str, order: list, limit: int) -> DataFrame:
    """position, key: bands take turns, each giving its next row; a key counts once, the first time."""
    turn = rows.withColumn("turn", F.row_number().over(Window.partitionBy(band).orderBy(*order)))
    first = turn.groupBy(key).agg(F.min(F.struct("turn", band)).alias("at")).select(key, "at.turn", f"at.{band}")
    top = first.orderBy("turn", band, key).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy("turn", band, key))).select("position", key)
