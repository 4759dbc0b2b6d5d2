"""Substring deduplication by sliding runs of sentences.

From every sentence the shortest run of at least MIN_SENTENCES sentences and MIN_WORDS words is
hashed, forwards and backwards, so a passage shared by two documents is covered to both its ends
wherever it stands in them. All runs are brought together by hash, once; every sentence covered by a
run that occurs earlier in the corpus is removed.

A passage may start and end inside a sentence, and some texts have no sentence marks at all, so long
sentences are cut into clauses, which are sentences to all that follows. Where they are cut is up to
a few words in a row, so the cuts of a shared passage are the same in all its copies.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, counted, give_back, read
from .repeats import carried, keyed, occurrences, with_units

MIN_SENTENCES, MIN_WORDS = 2, 20
LONG = 20  # a sentence of more words is cut where words have the least hash of WINDOW in a row
WINDOW = 12
#: Ranges of scripts written without spaces (Thai and Lao, Burmese, Khmer, kana and Han); a character counts as a word.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
_END = re.compile(r"[.!?]+\s+|[。！？]+\s*|\n\s*")
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64))
SLICE = 1 << 18  # characters hashed at once
MANY = 8  # occurrences of a run in a worker's hands; of more, those that can't be the first are dealt over PARTS tasks
PARTS = 1024


def words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(first character, hash) of every word, without a Python object per word."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = (points == 32) | (points == 0xA0) | (points == 0x3000) | (points - np.uint32(9) <= 4)
    opens = ~space
    opens[1:] &= space[:-1]
    if points.max(initial=0) >= UNSPACED[0][0]:
        alone = np.zeros(len(points), dtype=bool)
        for low, high in UNSPACED:
            alone |= (points >= low) & (points <= high)
        opens |= alone
        opens[1:] |= alone[:-1] & ~space[1:]
    starts = np.flatnonzero(opens)
    hashes, i = np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        k = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE)))
        a, b = starts[i], starts[k] if k < len(starts) else len(points)
        place = np.arange(b - a) - np.repeat(starts[i:k] - a, np.diff(np.append(starts[i:k], b)))
        value = (points[a:b].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095]
        value[space[a:b]] = 0
        hashes[i:k] = np.add.reduceat(value, starts[i:k] - a)
        i = k
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    return starts, hashes


def cuts(hashes: np.ndarray) -> np.ndarray:
    """After which words a text may be cut: any WINDOW words in a row choose one by themselves."""
    if len(hashes) < WINDOW:
        return np.empty(0, dtype=np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(hashes[::-1], WINDOW)  # of equal hashes the last word's
    chosen = np.zeros(len(hashes), dtype=bool)
    chosen[len(hashes) - 1 - np.arange(len(rows)) - rows.argmin(axis=1)] = True
    return np.flatnonzero(chosen)


def clauses(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, words up to each end, hashes of the words): consecutive pieces that make up the whole text."""
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    ends = np.array(ends)
    starts, hashes = words(text)
    upto = np.searchsorted(starts, ends)
    long = np.diff(upto, prepend=0) > LONG
    if long.any():
        at = cuts(hashes)
        at = at[at + 1 < len(starts)]
        at = at[long[np.searchsorted(upto, at, "right")]]  # inside the sentence of the word
        ends = np.unique(np.concatenate((starts[at + 1], ends)))
        upto = np.searchsorted(starts, ends)
    return ends, upto, hashes


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of the pieces."""
    ends, upto, _ = clauses(text)
    return list(zip([0, *ends[:-1].tolist()], ends.tolist(), np.diff(upto, prepend=0).tolist(), strict=True))


def runs(upto: np.ndarray, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the shortest run that is long enough, from and up to every sentence; upto: words up to each one's end."""
    total, n = np.concatenate(([0], upto)), len(upto)
    first = np.arange(n)
    end = np.maximum(first + min_sentences, np.searchsorted(total, total[:-1] + min_words))
    last = np.arange(1, n + 1)
    start = np.minimum(last - min_sentences, np.searchsorted(total, total[1:] - min_words, "right") - 1)
    some, also = end <= n, start >= 0
    both = np.unique(np.concatenate((first[some] * (n + 1) + end[some], start[also] * (n + 1) + last[also])))
    return both // (n + 1), both % (n + 1) - 1


class Powers:
    """Powers of an odd number and of its inverse, modulo 2 ** 64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(0, np.uint64), np.ones(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << max(12, n.bit_length())
            self.up, self.down = (np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, dtype=np.uint64)))) for x in (self.base, pow(self.base, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


BASES = Powers(0xD1342543DE82EF95), Powers(0xAF251AF3B0F025B5)


def spans_of(text: str, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, first, last) of all runs: a run's hash is that of its words, whatever white space is between them."""
    _, upto, hashes = clauses(text)
    first, last = runs(upto, min_sentences, min_words)
    if not len(first):
        return (np.empty(0, np.int64),) * 4
    start, end = np.concatenate(([0], upto))[first], upto[last]
    out = []
    for powers in BASES:
        up, down = powers.of(len(hashes))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up)))
        h = (sums[end] - sums[start]) * down[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((h ^ (h >> np.uint64(32))).view(np.int64))
    return *out, first, last


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the sentences of the spans, the number of sentences removed, and of all."""
    cut = sentences(text)
    gone = set()
    for a, b in spans:
        gone.update(range(a, b + 1))
    return "".join(text[a:b] for k, (a, b, _) in enumerate(cut) if k not in gone), len(gone), len(cut)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, text without its repeated sentences, n_sentences, n_removed, first_ids, and the columns to carry.

    first_ids lists the documents that hold the first occurrence of what was removed. Null texts
    stay null and empty texts empty; neither has sentences. Of equal texts the one with the least
    id stays whole, the others lose every run; rows equal in id and text are one document and stay
    alike. A text with fewer sentences or words than a run is left as it is. Texts of any length
    are read whole. An empty table gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    rows = keyed(docs, id_col, text_col, carry)
    found = occurrences(rows, lambda text: spans_of(text, min_sentences, min_words), marks)
    later = repeated_later(found, scratch).repartition("id", "th")
    spans = later.groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"), F.array_sort(F.collect_set("first_id")).alias("first_ids"))
    near, far = with_units(rows, scratch.write(spans, "spans"))

    @F.pandas_udf("text string, n_sentences int, n_removed int")
    def cleaned(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = [without(t, [(s["a"], s["b"]) for s in cut]) for t, cut in zip(text, spans, strict=True)]
        give_back()
        return pd.DataFrame({"text": [x[0] for x in out], "n_sentences": [x[2] for x in out], "n_removed": [x[1] for x in out]})

    @F.pandas_udf("int")
    def count(text: pd.Series) -> pd.Series:
        return pd.Series([len(sentences(t)) if t else 0 for t in text], dtype="int32")

    out = near.select(F.col("id").alias("doc_id"), cleaned("text", "spans").alias("c"), "first_ids", "rest")
    out = out.select("doc_id", "c.text", "c.n_sentences", "c.n_removed", "first_ids", "rest")
    same = far.select(F.col("id").alias("doc_id"), "text", count("text").alias("n_sentences"), F.lit(0).alias("n_removed"), F.array().cast("array<bigint>").alias("first_ids"), "rest")
    return out.unionByName(same).select(*out.columns[:-1], *carried(carry))


def marks(ids, ths, sizes: list[int], h1: np.ndarray, h2: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, many) of the occurrences in some documents.

    Of a run that occurs more than MANY times here, all but the least occurrence are later ones for
    certain: they get a part above 0, and the least one gets many = 1, as the others ask for its first.
    """
    part, many = np.zeros(len(h1), np.int32), np.zeros(len(h1), np.int32)
    _, at, n = np.unique(h1, return_inverse=True, return_counts=True)
    some = np.flatnonzero(n[at] > MANY)
    if len(some):
        keys = [(i is not None, int(i or 0), th) for i, th in zip(ids, ths, strict=True)]
        place = {k: x for x, k in enumerate(sorted(set(keys)))}
        rank = np.repeat([place[k] for k in keys], sizes)
        rows = some[np.lexsort((a[some], rank[some], h2[some], h1[some]))]
        new = np.concatenate(([True], (np.diff(h1[rows]) != 0) | (np.diff(h2[rows]) != 0)))
        group = np.cumsum(new) - 1
        least, often = rows[new][group], np.bincount(group)[group] > MANY
        first = (rank[rows] == rank[least]) & (a[rows] == a[least])
        many[rows[often & first]] = 1
        part[rows[often & ~first]] = 1 + int(np.bitwise_xor.reduce(np.array(ths, dtype=np.int64))) % PARTS
    return part, many


LATER, FIRST, DEALT = range(3)


def later_batches(batches):
    """h1, h2, part, id, th, a, b, many in order -> kind, id, th, a, b, first_id, h1, h2.

    LATER: an occurrence that is not the first of its run. FIRST: the first one of a run that has
    DEALT ones, which are later ones that have still to learn it.
    """
    first = None  # occurrence of the last run
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if first is None else [first, batch]).combine_chunks()
        h1, h2, part, th, a, many = (rows.column(c).to_numpy() for c in ("h1", "h2", "part", "th", "a", "many"))
        ids, known = rows.column("id").fill_null(0).to_numpy(), rows.column("id").is_valid().to_numpy()
        new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (part[1:] != part[:-1])))
        least = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        other = (ids != ids[least]) | (known != known[least]) | (th != th[least]) | (a != a[least])
        fresh = np.arange(len(new)) >= (first is not None)  # the row held has been dealt with
        for kind, chosen in ((LATER, other & (part == 0)), (FIRST, (many > 0) & fresh), (DEALT, (part > 0) & fresh)):
            if len(at := np.flatnonzero(chosen)):
                own, key = rows.select(["id", "th", "a", "b"]).take(at).columns, rows.select(["h1", "h2"]).take(at).columns
                if kind == LATER:
                    key = [pa.nulls(len(at), pa.int64())] * 2
                first_id = pa.nulls(len(at), pa.int64()) if kind == DEALT else rows.column("id").take(least[at])
                table = pa.table([pa.array(np.full(len(at), kind, np.int32)), *own, first_id, *key], names=["kind", "id", "th", "a", "b", "first_id", "h1", "h2"])
                yield from table.to_batches()
        first = rows.slice(least[-1], 1).to_batches()[0]


def repeated_later(found: DataFrame, scratch: Scratch) -> DataFrame:
    """The occurrences that are not the first of their run: id, th, a, b, first_id.

    Each occurrence is shuffled once and not stored; a run's are read one after another, and no
    more than the first of them is held. A run that occurs often is dealt over many tasks.
    """
    ordered = found.repartition("h1", "h2", "part").sortWithinPartitions("h1", "h2", "part", "id", "th", "a")
    kinds = ordered.mapInArrow(later_batches, "kind int, id long, th long, a int, b int, first_id long, h1 long, h2 long")
    kinds = scratch.write(kinds, "later")
    of = lambda kind: kinds.where(F.col("kind") == kind)
    columns = ["id", "th", "a", "b", "first_id"]
    firsts = scratch.write(of(FIRST).groupBy("h1", "h2").agg(F.min("first_id").alias("first_id")), "firsts")
    dealt = of(DEALT).drop("first_id").join(counted(firsts), ["h1", "h2"])
    return of(LATER).select(*columns).unionByName(dealt.select(*columns))


def op2_substring(spark, sf_dir):
    """The documents that lose sentences, with what is left of them; all others stay as they are."""
    return substring_dedup(read(spark, sf_dir, "documents")).where("n_removed > 0")
