"""Tables and corpora: the driver's Parquet tables, JSON-lines snippets, and a curated dataset."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNIPPET = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("text", "language", "source", "repo", "commit", "path", "license")]
    + [T.StructField(n, T.IntegerType()) for n in ("start_line", "end_line")]
)
#: Where a snippet may come from, and the languages in their fixed order.
SOURCES = ("github", "wild")
CORE = ("python", "cpp", "java", "javascript", "rust", "go", "sql", "html")
STRETCH = ("c", "csharp", "typescript", "kotlin", "php", "ruby")
LANGUAGES = CORE + STRETCH
#: Preset -> (class, languages that become it).
MERGES = {"js_ts": ("js_ts", ("javascript", "typescript")), "es_fr": ("romance", ("es", "fr"))}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, small: int = 1 << 29) -> DataFrame:
    """A small table over all cores, as a single row group would keep them idle; a large one as its files lie.

    The size is Spark's own estimate of what the scan reads, so a large table is never shuffled; nor
    is one of as many files as cores.
    """
    size, cores = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= small and len(df.inputFiles()) < cores else df


def snippets_of(docs: DataFrame) -> DataFrame:
    """documents as snippets: doc_id, text, language, repo (a source and language together)."""
    return docs.select("doc_id", "text", F.col("lang").alias("language"), F.concat_ws(":", "source", "lang").alias("repo"))


def load_snippets(spark: SparkSession, paths: str | list[str], languages: tuple[str, ...] | None = None, missing_ok: bool = False) -> DataFrame:
    """JSON lines, one snippet each, from files or folders, however deep. Blank lines are skipped.

    A malformed line fails the read; a label that is not expected fails the query, naming the file.
    """
    reader = spark.read.schema(SNIPPET).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    try:
        rows = reader.json(paths)
    except Exception as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], SNIPPET)
        raise
    if languages is None:
        return rows
    complaint = F.concat(F.input_file_name(), F.lit(": unknown language "), F.coalesce("language", F.lit("null")))
    return rows.withColumn("language", F.when(F.col("language").isin(*languages), F.col("language")).otherwise(F.raise_error(complaint)))


def invalid(row=F.col) -> Column:
    """Why a snippet breaks the data model, or null."""
    return (
        F.when(F.trim(F.coalesce(row("text"), F.lit(""))) == "", "blank text")
        .when(~F.coalesce(row("source"), F.lit("")).isin(*SOURCES), "unknown source")
        .when(F.coalesce(row("repo"), F.lit("")) == "", "no repo")
        .when(F.coalesce(row("license"), F.lit("")) == "", "no license")
        .when(~F.coalesce((row("start_line") >= 1) & (row("start_line") <= row("end_line")), F.lit(False)), "bad lines")
    )


def save_snippets(rows: DataFrame, path: str) -> int:
    rows.select(*SNIPPET.names).write.mode("overwrite").json(path)
    return rows.count()


def save_dataset(rows: DataFrame, path: str) -> None:
    """rows with a split column, as one Parquet folder per split: readers prune the splits they skip."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    if not rows.where("split = 'train'").limit(1).count():
        raise FileNotFoundError(f"{path} has no split=train; build the dataset first")
    return rows


def languages_present(rows: DataFrame, order: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """position, language: the labels that occur, in the fixed order; unknown ones last by name."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("language"))
    found = rows.select("language").distinct().where("language is not null")
    return found.select(F.when(place > 0, place - 1).otherwise(len(order)).cast("int").alias("position"), "language")


def resolve_languages(spec: str | list[str], present: set[str], order: tuple[str, ...] = LANGUAGES) -> tuple[str, ...]:
    """auto, all, core, or a list of labels -> labels in order; unknown, absent or no labels are errors."""
    if isinstance(spec, str):
        spec = {"core": list(CORE), "all": list(order)}.get(spec.strip().lower(), spec)
    if spec == "auto":
        wanted = [x for x in order if x in present]
    else:
        wanted = [x.strip().lower() for x in (spec.split(",") if isinstance(spec, str) else spec) if x.strip()]
        if unknown := sorted(set(wanted) - set(order)):
            raise ValueError(f"unknown languages {unknown}")
        if absent := sorted(set(wanted) - present):
            raise ValueError(f"no data for {absent}")
    if not wanted:
        raise ValueError("no language chosen")
    return tuple(x for x in order if x in wanted)


def merge_plan(presets: list[str], languages: set[str]) -> tuple[dict[str, str], list[str]]:
    """language -> class for the presets that apply (two members or more are chosen), and notes on the others."""
    mapping, notes = {}, []
    for preset in presets:
        if preset not in MERGES:
            raise ValueError(f"unknown merge preset {preset!r}")
        label, members = MERGES[preset]
        chosen = [m for m in members if m in languages]
        if len(chosen) < 2:
            notes.append(f"{preset}: not applied, only {', '.join(chosen) or 'none'} of {', '.join(members)} chosen")
            continue
        if clash := [m for m in chosen if m in mapping]:
            raise ValueError(f"{clash} belong to more than one preset")
        mapping |= dict.fromkeys(chosen, label)
    return mapping, notes


def relabelled(language: Column, mapping: dict[str, str]) -> Column:
    out = language
    for member, label in mapping.items():
        out = F.when(language == member, label).otherwise(out)
    return out


def uncovered(rows: DataFrame, languages: DataFrame) -> DataFrame:
    """Labels that the evaluation list lacks."""
    return rows.select("language").distinct().join(languages.select("language"), "language", "left_anti")


def separate_wild(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    wild = F.col("source").eqNullSafe("wild")
    return rows.where(~wild), rows.where(wild)


@dataclass(frozen=True)
class Manifest:
    """Counts of a built dataset."""

    counts: DataFrame
    repos: DataFrame


def manifest(rows: DataFrame) -> Manifest:
    """rows (split, language, repo) -> snippets and repositories of each split and language."""
    grouped = rows.groupBy("split", "language")
    return Manifest(grouped.agg(F.count("*").alias("n")), grouped.agg(F.countDistinct("repo").alias("repos")))


def config_hash(config, defaults: dict | None = None) -> str:
    """A short hash of the settings that differ from their defaults."""
    values = asdict(config) if is_dataclass(config) else dict(config)
    kept = {k: v for k, v in values.items() if defaults is None or defaults.get(k) != v}
    return hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()[:12]
