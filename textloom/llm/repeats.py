"""Text pieces that repeat anywhere in a corpus: shared by substring and line deduplication.

An occurrence is (h1, h2, id, th, a, b): a 128-bit hash of the piece, the document's id and text
hash, and the piece's first and last unit in the text. Rows with equal id and text are one
document. The first occurrence of a piece is the one least by (id, th, a).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, counted, lean

FLUSH = 50_000  # occurrences handed on at once by a worker


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, th, text, rest (the columns to carry); the text hash tells apart rows that share an id."""
    rest = F.struct(F.lit(0).alias("_"), *carry).alias("rest")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"), rest)


def carried(carry: tuple[str, ...]) -> list[Column]:
    return [F.col("rest").getField(c).alias(c) for c in carry]


def occurrences(docs: DataFrame, pieces, marks=None) -> DataFrame:
    """pieces(text) gives arrays: both halves of a 128-bit hash, first unit, last unit.

    marks(ids, ths, sizes, h1, h2, a), if given, makes two more columns, part and many, for the
    occurrences of some documents (their ids, text hashes and numbers of pieces).
    """
    columns = "h1 long, h2 long, id string, th long, a int, b int" + ", part int, many int" * (marks is not None)

    def frame(found):
        ids, ths, parts = zip(*found, strict=True)
        n = [len(p[0]) for p in parts]
        h1, h2, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        out = pd.DataFrame({"h1": h1, "h2": h2, "id": np.repeat(np.array(ids, dtype=object), n), "th": np.repeat(np.array(ths, dtype=np.int64), n), "a": a, "b": b})
        if marks is not None:
            out["part"], out["many"] = marks(ids, ths, n, h1, h2, a)
        return out

    def run(batches):
        found, held = [], 0
        for pdf in batches:
            for i, th, text in zip(pdf["id"], pdf["th"], pdf["text"], strict=True):
                if not text:
                    continue
                found.append((i, th, pieces(text)))
                held += len(found[-1][2][0])
                if held >= FLUSH:
                    yield frame(found)
                    found, held = [], 0
        if held:
            yield frame(found)

    return longs(as_text(docs.select("id", "th", "text")).mapInPandas(lean(run), columns))


def arrays(found) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(128-bit digest, first unit, last unit) of some pieces -> arrays for `occurrences`."""
    rows = list(found)
    h = np.frombuffer(b"".join(x for x, _, _ in rows), "<i8").reshape(-1, 2)
    return h[:, 0], h[:, 1], np.array([a for _, a, _ in rows], dtype=np.int64), np.array([b for *_, b in rows], dtype=np.int64)


def as_text(df: DataFrame) -> DataFrame:
    """Ids go through pandas as text: there a null would turn long integers into floats."""
    return df.withColumn("id", F.col("id").cast("string"))


def longs(df: DataFrame, name: str = "id") -> DataFrame:
    return df.withColumn(name, F.col(name).cast("long"))


def repeated(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Occurrences of pieces that occur more than once, with `first`, true for the least one."""
    counts = found.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "a")).alias("least"), F.count("*").alias("n"))
    counts = scratch.write(counts.where("n > 1").select("h1", "h2", "least"), "repeated")
    here = F.struct("id", "th", "a")
    return found.join(counts, ["h1", "h2"]).select(*found.columns, here.eqNullSafe(F.col("least")).alias("first"))


def with_units(docs: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that have units, with the columns of `units`; all others).

    units has one row a document, with lists as long as its text at most. If few documents have
    any, their keys are broadcast and only their texts are shuffled.
    """
    null = F.lit(-(1 << 63))
    mine = [F.coalesce("id", null) == F.col("uid"), F.col("th") == F.col("uth")]
    lists = units.withColumn("uid", F.coalesce("id", null)).withColumnRenamed("th", "uth").drop("id")
    keys = counted(lists.select("uid", "uth"))
    near = docs.join(keys, mine, "left_semi").join(lists, mine).drop("uid", "uth")
    return near, docs.join(keys, mine, "left_anti")
