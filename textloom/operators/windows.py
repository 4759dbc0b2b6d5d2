"""Contiguous line windows of long texts."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexer import scanner


def fixed_windows(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", min_lines: int | None = None) -> DataFrame:
    """id, start_line, end_line, text: windows of just `size` lines, in order; a shorter rest is left out.

    With min_lines, windows of low signal are left out too.
    """
    body = F.regexp_replace(F.regexp_replace(text_col, "\r\n?", "\n"), "\n$", "")
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.split(body, "\n").alias("lines"))
    count = F.floor(F.size("lines") / size).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("id", F.explode(F.transform(starts, lambda k: F.struct((k * size + 1).alias("start_line"), ((k + 1) * size).alias("end_line"), F.slice("lines", k * size + 1, size).alias("part")))).alias("w"))
    out = rows.select(F.col("id").alias(id_col), "w.start_line", "w.end_line", F.col("w.part").alias("part"))
    if min_lines is not None:
        out = out.where(~T.low_signal(F.filter("part", lambda x: x.rlike(T.NOT_SPACE)), min_lines))
    return out.select(id_col, "start_line", "end_line", F.concat(F.array_join("part", "\n"), F.lit("\n")).alias("text"))


def cut_windows(lines: list[str], safe: list[bool] | None, lo: int, hi: int, seed: int) -> list[tuple[int, int]]:
    """(first, end) of windows of lo..hi lines whose ends are safe, the length nearest to a drawn one."""
    out, draw, at = [], random.Random(seed), 0
    while at + lo <= len(lines):
        if safe is not None and not safe[at]:
            at += 1
            continue
        target, most = draw.randint(lo, hi), min(hi, len(lines) - at)
        if safe is None:
            size = min(target, most)
        else:
            fits = [n for n in range(lo, most + 1) if safe[at + n]]
            size = min(fits, key=lambda n: (abs(n - target), n), default=None)
        if size is None:
            at += 1
        else:
            out.append((at, at + size))
            at += size
    return out


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str | None = None, min_lines: int = 20, max_lines: int = 50, max_windows: int | None = None, seed: int = 0, min_nonblank: int = 10) -> DataFrame:
    """id, start_line, end_line, text: windows that begin and end outside comments and strings.

    The length is drawn from a generator seeded alike for every text; windows of low signal are
    left out, after they took their lines. A null text has none.
    """
    if not 1 <= min_lines <= max_lines:
        raise ValueError("need 1 <= min_lines <= max_lines")
    language = F.col(language_col) if language_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), language.alias("language"))

    def run(batches):
        for pdf in batches:
            out = []
            for i, text, lang in zip(pdf["id"], pdf["text"], pdf["language"], strict=True):
                if not text:
                    continue
                lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                lines = lines[:-1] if lines[-1] == "" else lines
                found = scanner(lang)
                safe = found.scan(lines)[0] if found else None
                out += [(i, k, a + 1, b, "\n".join(lines[a:b]) + "\n") for k, (a, b) in enumerate(cut_windows(lines, safe, min_lines, max_lines, seed))]
            yield pd.DataFrame(out, columns=["id", "k", "start_line", "end_line", "text"])

    cut = rows.mapInPandas(run, "id string, k int, start_line int, end_line int, text string")
    cut = cut.withColumn("lines_", T.non_blank_lines(F.col("text"))).where(~T.low_signal(F.col("lines_"), min_nonblank))
    if max_windows is not None:
        from pyspark.sql import Window

        first = Window.partitionBy("id").orderBy("k")
        cut = cut.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= max_windows)
    kind = dict(docs.dtypes)[id_col]
    return cut.select(F.col("id").cast(kind).alias(id_col), "start_line", "end_line", "text")
