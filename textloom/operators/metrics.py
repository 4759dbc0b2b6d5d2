"""Scores of predictions (label, pred), and statistics over folds, seeds and splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(pred: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return pred.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))


def per_class(pred: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, class, tp, fp, fn, f1 (0 for 0/0) for every class in labels or predictions, from the confusion counts."""
    cells = confusion(pred, by)
    side = lambda c, right, name: cells.groupBy(*by, F.col(c).alias("class")).agg(
        F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias(right), F.sum("n").alias(name)
    )
    joined = side("label", "tp", "true").join(side("pred", "tp_", "guessed"), [*by, "class"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = joined.withColumns({"tp": zero("tp"), "fn": zero("true") - zero("tp"), "fp": zero("guessed") - zero("tp")})
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return joined.select(*by, "class", "tp", "fp", "fn", f1.alias("f1"))


def macro_f1(pred: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, macro_f1, accuracy, n. Classes without true rows do not count."""
    scored = per_class(pred, by).withColumn("true", F.col("tp") + F.col("fn"))
    mean = F.avg(F.when(F.col("true") > 0, F.col("f1")))
    return scored.groupBy(*by).agg(F.round(mean, 6).alias("macro_f1"), F.round(F.sum("tp") / F.sum("true"), 6).alias("accuracy"), F.sum("true").alias("n"))


def top_confusions(pred: DataFrame, n: int) -> DataFrame:
    """The n most frequent errors; of equal ones the last by name first."""
    order = [F.desc("n"), F.desc("label"), F.desc("pred")]
    return confusion(pred).where("label <> pred").orderBy(*order).limit(n)


def spread(values: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """by, mean, pstd, min, max."""
    return values.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("pstd"), F.min(value).alias("min"), F.max(value).alias("max"))


def best(values: DataFrame, score: str, place: str) -> DataFrame:
    """The row of the highest score, the first place if tied."""
    return values.orderBy(F.desc(score), place).limit(1)


def paired_delta(values: DataFrame, base: str, model: str = "model", fold: str = "fold", value: str = "macro_f1") -> DataFrame:
    """model, mean, pstd of the differences to the base model, fold by fold."""
    against = values.where(F.col(model) == base).select(fold, F.col(value).alias("base"))
    joined = values.where(F.col(model) != base).join(against, fold).withColumn("delta", F.col(value) - F.col("base"))
    return joined.groupBy(model).agg(F.round(F.avg("delta"), 6).alias("mean"), F.round(F.stddev_pop("delta"), 6).alias("pstd"))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by the continued fraction of its faster half."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - betainc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d, out = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            top = 1.0
        elif i % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + top * d, 1e-300) if 1 + top * d >= 0 else 1 / min(1 + top * d, -1e-300)
        c = 1 + top / c if abs(c) > 1e-300 else 1 + top / 1e-300
        out *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (out - 1)


def t_sf(t: float, df: float) -> float:
    """P(T > t) of Student's t."""
    tail = betainc(df / 2, 0.5, df / (df + t * t)) / 2
    return tail if t >= 0 else 1 - tail


def t_quantile(p: float, df: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_sf(mid, df) < p else (low, mid)
    return (low + high) / 2


def corrected_t(diffs: DataFrame, by: tuple[str, ...], value: str, ratio: Column | float, confidence: float = 0.95) -> DataFrame:
    """by, mean, se, t, df, n_splits, and p, ci_low, ci_high: the corrected resampled t-test.

    The variance of the mean is (1/J + test/train) var, as repeated splits share training rows.
    Without variance t is infinite (p 0) unless the mean is 0 (t 0, p 1). Fewer than two splits
    give nulls.
    """
    ratio = F.lit(ratio) if isinstance(ratio, float | int) else ratio
    stats = diffs.groupBy(*by).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.count(value).alias("n_splits"), F.max(ratio).alias("ratio"))
    se = F.sqrt((1 / F.col("n_splits") + F.col("ratio")) * F.col("var"))
    stats = stats.withColumn("se", se).withColumn("df", F.col("n_splits") - 1)
    t = F.when(F.col("se") > 0, F.col("mean") / F.col("se")).when(F.col("se") == 0, F.when(F.col("mean") == 0, 0.0).otherwise(F.signum("mean") * float("inf")))

    @F.pandas_udf("p double, half double")
    def tail(t, df, se):
        import pandas as pd

        out = [(2 * t_sf(abs(x), n), t_quantile(0.5 + confidence / 2, n) * s) if n >= 1 and x == x and abs(x) < math.inf else (0.0 if n >= 1 and x == x else None, 0.0 if n >= 1 and x == x else None) for x, n, s in zip(t, df, se, strict=True)]
        return pd.DataFrame(out, columns=["p", "half"])

    done = stats.withColumn("t", t).withColumn("tail", tail("t", "df", "se"))
    return done.select(*by, "mean", "se", "t", "df", "n_splits", "tail.p", (F.col("mean") - F.col("tail.half")).alias("ci_low"), (F.col("mean") + F.col("tail.half")).alias("ci_high"))


def binomial_p(n: Column, k: Column) -> Column:
    """Two-sided exact p of k or fewer of n at one half: min(1, 2 sum C(n, i) / 2^n)."""

    def step(state: Column, i: Column) -> Column:
        # log C(n, i) = log C(n, i - 1) + log((n - i + 1) / i)
        log_c = state["log_c"] + F.when(i > 0, F.log((n - i + 1) / F.greatest(i, F.lit(1)))).otherwise(0.0)
        return F.struct(log_c.alias("log_c"), (state["sum"] + F.exp(log_c - n * math.log(2.0))).alias("sum"))

    start = F.struct(F.lit(0.0).alias("log_c"), F.lit(0.0).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), start, step, lambda s: s["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def mcnemar(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """pairs (label, a, b) -> by, only_a_wrong, only_b_wrong, both_wrong, p."""
    wrong = lambda c: F.col(c) != F.col("label")
    out = pairs.groupBy(*by).agg(
        F.count_if(wrong("a") & ~wrong("b")).alias("only_a_wrong"), F.count_if(~wrong("a") & wrong("b")).alias("only_b_wrong"), F.count_if(wrong("a") & wrong("b")).alias("both_wrong")
    )
    n = F.col("only_a_wrong") + F.col("only_b_wrong")
    # p is a multiple of a power of two, often halfway between two roundings: a nudge settles which
    return out.withColumn("p", F.round(binomial_p(n, F.least("only_a_wrong", "only_b_wrong")) + 1e-9, 6))


def average_ranks(values: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds `rank`: the mean of the places that equal values take. Distinct values are ranked, not rows."""
    counts = values.groupBy(*by, value).agg(F.count("*").alias("c_"))
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("rank", F.coalesce(F.sum("c_").over(before), F.lit(0)) + (F.col("c_") + 1) / 2)
    return values.join(placed, [*by, value])


def rank_sum(values: DataFrame, value: str, is_first: Column, alternative: str = "less") -> DataFrame:
    """n1, n2, u (of the first group), z, p: one-sided Mann-Whitney, normal approximation with ties."""
    ranked = average_ranks(values.withColumn("first_", is_first), value)
    stats = ranked.agg(F.count_if("first_").alias("n1"), F.count_if(~F.col("first_")).alias("n2"), F.sum(F.when(F.col("first_"), F.col("rank"))).alias("r1"), F.sum(F.pow("c_", F.lit(2)) - 1).alias("ties"))
    n = F.col("n1") + F.col("n2")
    stats = stats.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    shift = 0.5 if alternative == "less" else -0.5
    stats = stats.withColumn("z", (F.col("u") - F.col("n1") * F.col("n2") / 2 + shift) / sd)

    @F.pandas_udf("double")
    def normal(z):
        return z.map(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)))

    p = normal(F.col("z") if alternative == "less" else -F.col("z"))
    return stats.select("n1", "n2", "u", F.round("z", 6).alias("z"), F.round(p, 6).alias("p"))


def spearman(values: DataFrame, a: str, b: str) -> DataFrame:
    """rho: the correlation of average ranks."""
    ranked = average_ranks(values.select(a, b), a).drop("c_").withColumnRenamed("rank", "ra")
    ranked = average_ranks(ranked, b).withColumnRenamed("rank", "rb")
    return ranked.agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))


def percentiles(values: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    p = lambda q: F.round(F.percentile(value, F.lit(q)), 6)
    return values.groupBy(*by).agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.count("*").alias("n"))


def consistency(ours: DataFrame, theirs: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """compared, max_abs_diff, matches: two runs' scores, key by key."""
    joined = ours.join(theirs.withColumnRenamed(value, "other_"), keys)
    out = joined.agg(F.count("*").alias("compared"), F.max(F.abs(F.col(value) - F.col("other_"))).alias("max_abs_diff"))
    return out.withColumn("matches", F.coalesce(F.col("max_abs_diff") <= tolerance, F.lit(False)))


def canonical_seed(values: DataFrame, score: str = "cv_mean", seed: str = "seed") -> DataFrame:
    """The seed of the lower median score, the lower seed if tied."""
    every = Window.partitionBy()
    ranked = values.withColumn("place_", F.row_number().over(every.orderBy(score, seed))).withColumn("n_", F.count("*").over(every))
    return ranked.where("place_ = floor((n_ - 1) / 2) + 1").drop("place_", "n_")


def seed_aggregate(scores: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """scores (by, seed, fold, macro_f1) -> by, mean, seed_std (of the seeds' means), fold_std (of the folds' means)."""
    seeds = scores.groupBy(*by, "seed").agg(F.avg("macro_f1").alias("m")).groupBy(*by).agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("seed_std"))
    folds = scores.groupBy(*by, "fold").agg(F.avg("macro_f1").alias("m")).groupBy(*by).agg(F.round(F.stddev_pop("m"), 6).alias("fold_std"))
    return seeds.join(folds, list(by))


def significance(scores: DataFrame, model: str, ratio: float) -> DataFrame:
    """scores (evaluation, model, split, value) -> evaluation, baseline, and the corrected t-test of the model against it."""
    ours = scores.where(F.col("model") == model).select("evaluation", "split", F.col("value").alias("ours"))
    rest = scores.where(F.col("model") != model).withColumnRenamed("model", "baseline")
    diffs = rest.join(ours, ["evaluation", "split"]).withColumn("diff", F.col("ours") - F.col("value"))
    return corrected_t(diffs, ("evaluation", "baseline"), "diff", ratio)
