"""Language identification with a string kernel.

Two texts are compared by the blended-spectrum presence kernel: the number of n-grams of one to
three letters that both hold, normalised by the geometric mean of their own numbers. Letters are
code points of any script, lower-cased; an n-gram's number is a hash of them in a table of 2 ** BITS.
A Nyström map on landmark texts turns the kernel into features, and one-versus-rest kernel ridge
regression on them gives every language a score; the best one wins. Texts are scored in batches: one
matrix product gives the kernel against all landmarks, one more the scores.

Training texts are a sample of at most TRAIN_ROWS distinct labelled texts (two a language at least),
spread evenly over the languages, of which the LANGUAGES most frequent ones are learned; at most
LANDMARKS of them (one a language at least) are landmarks. These bounds are parameters. All else
covers all data.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, lean, read

TRAIN_ROWS, LANDMARKS, LANGUAGES = 1600, 128, 400
RIDGE = 1e-3
KNOWN = 0.3  # a text of whose n-grams a smaller share occurs in landmarks is in no learned language
BITS = 18  # of an n-gram's number: at most 134 MB for the matrix of 128 landmarks
CELLS = 1 << 23  # of the matrix of a batch
UNKNOWN = "und"


def lower_letters() -> np.ndarray:
    """Code point -> 0 for what is no letter, else the code point of its lower case plus 1."""
    out = np.zeros(0x110000, dtype=np.int32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            out[point] = ord(c.lower()[0]) + 1
    return out


class Grams:
    """The distinct n-grams of one text after another; what it holds does not grow with a text."""

    def __init__(self, letters: np.ndarray):
        self.letters, self.stamp = letters, np.zeros(1 << BITS, dtype=np.int32)
        self.clock = 0

    def of(self, text: str) -> tuple[np.ndarray, bool]:
        """(numbers of the n-grams present, whether the text has a letter). Runs of non-letters are one gap."""
        found, tail, any_letter, start = [], np.zeros(1, dtype=np.uint64), False, self.clock
        for i in range(0, len(text), 1 << 18):
            points = np.frombuffer(text[i : i + (1 << 18)].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            c = np.concatenate((tail, self.letters[points].astype(np.uint64)))
            keep = np.ones(len(c), dtype=bool)
            keep[1:] = (c[1:] > 0) | (c[:-1] > 0)
            keep[: len(tail)] = True
            c = c[keep]
            any_letter |= bool(c[len(tail) :].any())
            ones = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            twos = (ones[:-1] ^ (c[1:] + np.uint64(1 << 24))) * np.uint64(0xC2B2AE3D27D4EB4F)
            threes = (twos[:-1] ^ (c[2:] + np.uint64(1 << 25))) * np.uint64(0xD6E8FEB86659FD93)
            numbers = (np.concatenate((ones, twos, threes)) >> np.uint64(64 - BITS)).astype(np.int64)
            # of equal numbers the last one's turn stays in the table; those of earlier slices are not new
            numbers = numbers[self.stamp[numbers] <= start]
            if self.clock > (1 << 30):
                self.stamp[:] = np.where(self.stamp > start, self.stamp - start, 0)
                self.clock, start = self.clock - start, 0
            turns = np.arange(self.clock + 1, self.clock + 1 + len(numbers), dtype=np.int32)
            self.stamp[numbers] = turns
            found.append(numbers[self.stamp[numbers] == turns])
            self.clock += len(numbers)
            tail = c[-2:]
        return np.concatenate(found) if found else np.empty(0, np.int64), any_letter


def ngrams(df: DataFrame, shared) -> DataFrame:
    """lang, h, text -> lang, h, grams (the numbers of the n-grams present)."""

    def run(batches):
        grams = Grams(shared.value)
        for pdf in batches:
            found = [grams.of(t) for t in pdf["text"]]
            yield pd.DataFrame({"lang": pdf["lang"], "h": pdf["h"], "grams": [np.sort(g).astype(np.int32) if any_ else None for g, any_ in found]}).dropna(subset=["grams"])

    return df.select("lang", "h", "text").mapInPandas(lean(run), "lang string, h long, grams array<int>")


def training_texts(docs: DataFrame, rows: int, languages: int, scratch: Scratch, shared) -> list:
    """At most `rows` distinct labelled texts, evenly from every language, in order of their hash."""
    labelled = docs.where("not held_out and lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), "text")
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    counts = scratch.write(counts, "languages")
    if not (known := counts.count()):
        return []
    quota = max(2, rows // known)
    # a hash below the bound is as rare as the quota asks; copies of a text share a hash
    share = F.least(F.lit(1.0), F.lit(1.5 * quota) / F.col("n"))
    chosen = labelled.join(F.broadcast(counts), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) < share + 1e-12)
    chosen = scratch.write(chosen.groupBy("lang", "h").agg(F.first("text").alias("text")), "chosen")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    few = ngrams(chosen, shared).withColumn("rank", first).where(F.col("rank") <= quota)
    found = [(r.lang, np.asarray(r.grams)) for r in few.orderBy("lang", "h").select("lang", "grams").toLocalIterator()]
    return found


class Kernel:
    """The kernel of texts, given as n-gram numbers, against the landmarks."""

    def __init__(self, landmarks: list):
        self.columns = np.unique(np.concatenate(landmarks))
        self.place = np.full(1 << BITS, -1, dtype=np.int32)
        self.place[self.columns] = np.arange(len(self.columns))
        self.sizes = np.array([len(g) for g in landmarks], dtype=np.float64)
        self.marks = self.matrix(landmarks).T.copy()

    def matrix(self, sets: list) -> np.ndarray:
        m = np.zeros((len(sets), len(self.columns)), dtype=np.float32)
        for k, g in enumerate(sets):
            at = self.place[g]
            m[k, at[at >= 0]] = 1
        return m

    def batch(self) -> int:
        return max(1, min(256, CELLS // len(self.columns)))

    def __call__(self, sets: list) -> np.ndarray:
        step, out = self.batch(), np.empty((len(sets), len(self.sizes)))
        for i in range(0, len(sets), step):
            part = sets[i : i + step]
            sizes = np.array([max(1, len(g)) for g in part], dtype=np.float64)
            out[i : i + step] = (self.matrix(part) @ self.marks) / np.sqrt(np.outer(sizes, self.sizes))
        return out


def fit(texts: list, landmarks: int, ridge: float) -> dict:
    """The model: the kernel of the landmarks, and the map from it to scores. texts: (language, n-gram numbers)."""
    count = Counter(lang for lang, _ in texts)
    langs = sorted(count)
    each = max(1, landmarks // len(langs))
    chosen = [g for lang in langs for g in [g for x, g in texts if x == lang][:each]]
    kernel = Kernel(chosen)
    value, vector = np.linalg.eigh(kernel(chosen))
    good = value > 1e-8 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    x = kernel([g for _, g in texts]) @ root
    y = np.array([[lang == own for lang in langs] for own, _ in texts], dtype=np.float64)
    weight = np.array([1 / count[own] for own, _ in texts])[:, None]  # languages count alike
    mean_x, mean_y = (x * weight).sum(0) / weight.sum(), (y * weight).sum(0) / weight.sum()
    xc = x - mean_x
    w = np.linalg.solve(xc.T @ (xc * weight) + ridge * np.eye(x.shape[1]), xc.T @ ((y - mean_y) * weight))
    return {"langs": langs, "kernel": kernel, "map": root @ w, "bias": mean_y - mean_x @ w}


def score(model: dict, letters: np.ndarray, texts):
    """(language, score) of every text; a score of 0 says that it is in none of the languages."""
    grams, kernel = Grams(letters), model["kernel"]
    out: list[tuple[str, float]] = []
    for i in range(0, len(texts), kernel.batch()):
        found = [grams.of(t) if t else (np.empty(0, np.int64), False) for t in texts[i : i + kernel.batch()]]
        points = kernel([g for g, _ in found]) @ model["map"] + model["bias"]
        for p, best, (g, any_letter) in zip(points, points.argmax(axis=1), found, strict=True):
            known = any_letter and (kernel.place[g] >= 0).mean() >= KNOWN
            out.append((model["langs"][best] if any_letter else UNKNOWN, float(min(1.0, max(0.0, p[best]))) if known else 0.0))
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, languages: int = LANGUAGES, ridge: float = RIDGE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, and the columns to carry.

    Learns from rows with a text and a label whose crc32 of the id, mod 4, is not 2; a null id is
    not held out. The label, the id and other columns are no input of a prediction. Texts that are
    null or have no letter are `und` with score 0, as are all if there is nothing to learn from.
    The score is the winning regression value, cut to 0..1, and 0 for a text that shares hardly an
    n-gram with any landmark, as one in a language or script not learned; of equal scores the first
    language in order wins. Rows that repeat are returned as often as they occur. Texts of any
    length are read whole. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.struct(F.lit(0).alias("_"), *carry).alias("rest"))
    codes = spark.sparkContext.broadcast(lower_letters())
    texts = training_texts(rows, train_rows, languages, scratch, codes)
    shared = spark.sparkContext.broadcast(fit(texts, landmarks, ridge) if texts else None)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        found = score(shared.value, codes.value, text.tolist()) if shared.value else [(UNKNOWN, 0.0)] * len(text)
        give_back()
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    out = rows.select("doc_id", "held_out", predict("text").alias("p"), "rest")
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", *(F.col(f"rest.{c}").alias(c) for c in carry))


def op6_language(spark, sf_dir):
    return identify(read(spark, sf_dir, "documents"))
