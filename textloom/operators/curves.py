"""Learning curves: smoothing, the epoch to stop at, and when a share has settled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smoothed(curve: DataFrame, window: int, by: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Adds `smooth`: the centred mean, over a window that shrinks evenly towards both ends.

    curve has epochs from 1 without gaps. The frame's width varies by row, so the mean is a
    difference of running sums read at both its ends.
    """
    runs = Window.partitionBy(*by)
    upto = runs.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.withColumn("n_", F.count("*").over(runs)).withColumn("i_", F.row_number().over(runs.orderBy("epoch")))
    rows = rows.withColumn("r_", F.least(F.lit(window // 2), F.col("i_") - 1, F.col("n_") - F.col("i_"))).withColumn("c_", F.sum(value).over(upto))
    sums = F.collect_list("c_").over(runs.orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("s_", sums)
    total = F.get("s_", F.col("i_") + F.col("r_") - 1) - F.when(F.col("i_") - F.col("r_") > 1, F.get("s_", F.col("i_") - F.col("r_") - 2)).otherwise(0)
    return rows.withColumn("smooth", F.round(total / (2 * F.col("r_") + 1), 6)).drop("n_", "i_", "r_", "c_", "s_")


def chosen_epoch(smooth: DataFrame, tolerance: float, rule: str = "plateau", by: tuple[str, ...] = ()) -> DataFrame:
    """by, epoch: the first within the tolerance of the maximum, or (rule max) the first maximum."""
    if rule not in ("plateau", "max"):
        raise ValueError(f"unknown rule {rule!r}")
    top = F.max("smooth").over(Window.partitionBy(*by)) - (tolerance if rule == "plateau" else 0.0)
    return smooth.withColumn("top_", top).where(F.col("smooth") >= F.col("top_")).groupBy(*by).agg(F.min("epoch").alias("epoch"))


def settled_epoch(shares: DataFrame, by: tuple[str, ...], value: str = "share") -> DataFrame:
    """by, settled: the epoch from which the share stays at half its final value or more; null if it ends at 0."""
    last = F.max_by(value, "epoch").over(Window.partitionBy(*by))
    rows = shares.withColumn("last_", last)
    below = F.max(F.when(F.col(value) < F.col("last_") / 2, F.col("epoch")))
    out = rows.groupBy(*by).agg(F.first("last_").alias("last_"), below.alias("below_"))
    return out.select(*by, F.when(F.col("last_") > 0, F.coalesce(F.col("below_") + 1, F.lit(1))).cast("int").alias("settled"))


def summary(runs: DataFrame) -> DataFrame:
    """runs (fold, seed, epoch, val_f1) -> epoch, val_mean, val_std_runs, val_std_folds."""
    folds = runs.groupBy("epoch", "fold").agg(F.avg("val_f1").alias("m")).groupBy("epoch").agg(F.round(F.stddev_pop("m"), 6).alias("val_std_folds"))
    every = runs.groupBy("epoch").agg(F.round(F.avg("val_f1"), 6).alias("val_mean"), F.round(F.stddev_pop("val_f1"), 6).alias("val_std_runs"))
    return every.join(folds, "epoch")
