"""Building a labelled dataset: windows of files, label checks, deduplication, split and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import check_labels, drop_reasons
from . import dedup, splits, windows


def collect(files: DataFrame, per_repo: int, tries: int = 3, files_per_snippet: int = 3, min_lines: int = 20, max_lines: int = 50, min_nonblank: int = 10, seed: int = 0) -> DataFrame:
    """files (repo, path, language, text, license) -> snippets with `fate`: kept or hard.

    A repository's files are taken in order of a hash, per_repo * files_per_snippet of them at most.
    Of a file's windows, in order of a hash, the first of `tries` that passes the label check is
    kept, and the first hard one before it is set aside. A repository keeps per_repo snippets.
    """
    budget = F.row_number().over(Window.partitionBy("repo").orderBy(splits.unit(f"collect:{seed}", "file", F.concat_ws("/", "repo", "path")), "path"))
    chosen = files.withColumn("file_rank", budget).where(F.col("file_rank") <= per_repo * files_per_snippet)
    chosen = chosen.withColumn("file", F.concat_ws("\n", "repo", "path"))
    cut = windows.line_windows(chosen, "file", "text", "language", min_lines, max_lines, None, seed, min_nonblank)
    snippets = cut.withColumnRenamed("text", "window").join(chosen.drop("text"), "file").withColumnRenamed("window", "text")
    order = Window.partitionBy("file").orderBy(splits.unit(f"collect:{seed}", "window", F.concat_ws(":", "file", "start_line")), "start_line")
    tried = snippets.withColumn("try", F.row_number().over(order)).where(F.col("try") <= tries).withColumn("source", F.lit("github"))
    checked = check_labels(tried)
    first_ok = F.min(F.when(F.col("ok"), F.col("try"))).over(Window.partitionBy("file"))
    first_hard = F.min(F.when(F.col("hard"), F.col("try"))).over(Window.partitionBy("file"))
    checked = checked.withColumn("ok_at", first_ok).withColumn("hard_at", first_hard)
    is_kept = F.col("try") == F.col("ok_at")
    is_hard = (F.col("try") == F.col("hard_at")) & (F.coalesce("ok_at", F.lit(1 << 30)) > F.col("try"))
    found = checked.withColumn("fate", F.when(is_kept, "kept").when(is_hard, "hard")).where("fate is not null")
    place = F.row_number().over(Window.partitionBy("repo", "fate").orderBy("file_rank"))
    return found.withColumn("place", place).where((F.col("fate") == "hard") | (F.col("place") <= per_repo)).drop("file", "file_rank", "try", "ok_at", "hard_at", "place", "reasons", "ok", "hard")


def build(snippets: DataFrame, wild: DataFrame | None = None, check: bool = False, test_size: float = 0.2, n_folds: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """snippets (doc_id, text, language, repo, ...) -> (dataset with split and fold, drop reasons).

    With check, labels are checked first (path and source are needed) and hard examples become the
    split `hard`, less what repeats a kept or wild text. Exact and near duplicates go, earlier ids
    first and wild rows after all others; wild rows are a split of their own and in no fold.
    """
    spark = snippets.sparkSession
    reasons = spark.createDataFrame([], "reason string, n long")
    hard = None
    if check:
        checked = check_labels(snippets)
        reasons, hard = drop_reasons(checked), checked.where("hard").drop("reasons", "ok", "hard")
        snippets = checked.where("ok").drop("reasons", "ok", "hard")
    parts = [x for x in (snippets, wild, hard) if x is not None]
    status = dedup.cross_status([x.select("doc_id", "text") for x in parts], threshold).where("status = 'kept'").drop("status")
    keep = lambda rows, rank: rows.join(status.where(F.col("set_rank") == rank).drop("set_rank"), "doc_id", "left_semi")
    main = keep(snippets, 0)
    out = splits.assign(main, splits.stable_split(main, test_size, n_folds))
    for rank, (rows, name) in enumerate([x for x in ((wild, "wild"), (hard, "hard")) if x[0] is not None], 1):
        extra = keep(rows, rank).withColumn("split", F.lit(name)).withColumn("fold", F.lit(None).cast("int"))
        out = out.unionByName(extra, allowMissingColumns=True)
    return out, reasons
