"""Benchmark decontamination by spaced seeds.

A mask of ones and zeros is laid on every run of tokens; the tokens under ones are hashed, those
under zeros may be anything. Hashes that a benchmark item and a document share put the two on a
common diagonal, on which substitution-tolerant overlaps are sought: windows of MIN_OVERLAP tokens,
or of the whole item if that is shorter, of which at least SHARE match. Windows that overlap are one
overlap; the one with most matches is reported.

Text that repeats itself with a period of up to PERIOD tokens gives the same seeds again and again.
Such a run is looked up at its two ends only: an overlap inside is no longer than one from the end.

Documents are read once. A benchmark of at most INDEX_BYTES is broadcast as an index; a larger one
is a table of seeds, joined with those seeds of the documents that a bitmap of fixed size lets pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, read
from .tokens import tokens

#: The spaced seeds. No mask is the shift of another.
MASKS = ("11101001111", "110110010111", "1110010101011")
MIN_OVERLAP, SHARE = 13, 0.8
PERIOD = 16
INDEX_BYTES = 4 << 20  # of benchmark text; its index takes some 50 bytes a token
TABLE_BITS = 22  # of the filter of the index
BITMAP_BITS = 27  # of the filter beside a table of seeds: 16 MB
BITMAP_PART = 1 << 15  # bits that bitmap_construct_agg puts in a row
AT_ONCE = 1 << 20  # bytes of text searched at once, or one text
PAIRS = 1 << 20  # pairs of a document's and an item's seed expanded at once
FOUND = "id string, th long, item string, start int, n_tokens int, n_matches int, item_tokens int"


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the tokens under the mask's ones, at every position it fits; no two masks share hashes."""
    n = len(words) - len(mask) + 1
    out = np.full(max(0, n), int(mask, 2) * 0x9E3779B97F4A7C15 % (1 << 64), dtype=np.uint64)
    if n > 0:
        for k, bit in enumerate(mask):
            if bit == "1":
                out += words[k : k + n] * np.uint64((0xA24BAED4963EE407 * (2 * k + 1)) % (1 << 64))
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9FB21C651E98DF25)
    return out


def at_run_ends(h: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of the positions `at` are not inside a run that repeats; seeds of their text lie in low..high - 1."""
    inside = np.zeros(len(at), dtype=bool)
    for p in range(1, PERIOD + 1):
        fits = np.flatnonzero((at - p >= low) & (at + p < high))
        i = at[fits]
        inside[fits] |= (h[i - p] == h[i]) & (h[i + p] == h[i])
    return ~inside


def masks_of(lengths: list[int]) -> list[tuple[str, int | None]]:
    """(mask, length of the items it is for, or None); an item shorter than the longest mask is sought as a whole too."""
    longest = max(map(len, MASKS))
    return [*((m, None) for m in MASKS), *(("1" * n, n) for n in sorted({n for n in lengths if 0 < n < longest}))]


def item_seeds(words: np.ndarray, mask: str, only: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) under which an item is posted."""
    if only not in (None, len(words)) or len(words) < len(mask):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, at = seeds(words, mask), np.arange(len(words) - len(mask) + 1)
    keep = at_run_ends(h, at, np.zeros_like(at), np.full_like(at, len(h)))
    return h[keep], at[keep]


def index_of(items: list[tuple[object, np.ndarray]]) -> dict:
    """The seeds of the items: by mask, sorted hashes with item and position; none without items."""
    words, out = [w for _, w in items], []
    for mask, only in masks_of([len(w) for w in words]) if words else []:
        found = [(*item_seeds(w, mask, only), k) for k, w in enumerate(words)]
        h = np.concatenate([x for x, _, _ in found])
        if len(h):
            at = np.concatenate([x for _, x, _ in found])
            item = np.concatenate([np.full(len(x), k) for x, _, k in found])
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << TABLE_BITS, dtype=bool)
            table[h >> np.uint64(64 - TABLE_BITS)] = True
            out.append((mask, h[order], item[order], at[order], table))
    return {"ids": [i for i, _ in items], "words": words, "seeds": out}


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, min_overlap: int) -> tuple[int, int, int]:
    """(first token in the document, tokens, matches) of the best overlap on the diagonal; zeros without one."""
    a, b = max(0, diagonal), min(len(doc), diagonal + len(item))
    size = min(min_overlap, len(item))
    if b - a < size:
        return 0, 0, 0
    same = doc[a:b] == item[a - diagonal : b - diagonal]
    total = np.concatenate(([0], np.cumsum(same)))
    at = np.flatnonzero(total[size:] - total[:-size] >= SHARE * size)
    if not len(at):
        return 0, 0, 0
    cut = np.flatnonzero(np.diff(at) > size)
    starts, ends = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + size
    best = int(np.argmax(total[ends] - total[starts]))
    hits = np.flatnonzero(same[starts[best] : ends[best]])
    start, end = int(starts[best] + hits[0]), int(starts[best] + hits[-1] + 1)
    if end - start < size:  # what was trimmed is needed for the length
        start, end = int(starts[best]), int(ends[best])
    return a + start, end - start, int(same[start:end].sum())


def _inside(mask: str, first: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the hits whose window lies in one document, their documents)."""
    doc = np.searchsorted(first, hit, "right") - 1
    inside = hit + len(mask) <= first[doc + 1]
    return hit[inside], doc[inside]


def _ends(mask: str, h: np.ndarray, first: np.ndarray, hit: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return at_run_ends(h, hit, first[doc], np.minimum(first[doc + 1] - len(mask) + 1, len(h)))


def search(index: dict, texts: pa.Array, min_overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(document, item, first token, tokens, matches): the best overlap of each pair that has one."""
    words, first = tokens(texts)
    diagonals: set[tuple[int, int, int]] = set()
    for mask, h, item, at, table in index["seeds"]:
        mine = seeds(words, mask)
        hit, doc = _inside(mask, first, np.flatnonzero(table[mine >> np.uint64(64 - TABLE_BITS)]))
        low = np.searchsorted(h, mine[hit], "left")
        n = np.searchsorted(h, mine[hit], "right") - low
        some = np.flatnonzero(n > 0)
        some = some[_ends(mask, mine, first, hit[some], doc[some])]
        hit, doc, low, n = hit[some], doc[some], low[some], n[some]
        ends = np.cumsum(n)
        i = 0
        while i < len(hit):  # some pairs of seeds at once
            k = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + PAIRS, "right")))
            each = np.repeat(np.arange(i, k), n[i:k])
            seed = np.repeat(low[i:k] - (ends[i:k] - n[i:k]), n[i:k]) + np.arange(ends[i] - n[i], ends[k - 1])
            d, j, diagonal = doc[each], item[seed], hit[each] - first[doc[each]] - at[seed]
            order = np.lexsort((diagonal, j, d))
            d, j, diagonal = d[order], j[order], diagonal[order]
            new = np.ones(len(d), dtype=bool)
            new[1:] = (d[1:] != d[:-1]) | (j[1:] != j[:-1]) | (diagonal[1:] != diagonal[:-1])
            diagonals.update(zip(d[new].tolist(), j[new].tolist(), diagonal[new].tolist(), strict=True))
            i = k
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, k, diagonal in sorted(diagonals):
        best[d, k] = better(best.get((d, k)), overlap(words[first[d] : first[d + 1]], index["words"][k], diagonal, min_overlap))
    return [(d, k, *found) for (d, k), found in sorted(best.items()) if found[1]]


def better(a, b):
    """The overlap with more matches; of equally many the longer, then the earlier one."""
    return b if a is None or (b[2], b[1], -b[0]) > (a[2], a[1], -a[0]) else a


def _slices(batch: pa.RecordBatch):
    step = max(1, int(batch.num_rows * AT_ONCE / max(1, batch.column("text").nbytes)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def by_index(rows: DataFrame, items: DataFrame, min_overlap: int) -> DataFrame:
    """The benchmark's seeds, of bounded size, are sent to the documents."""
    held = [(r[0], tokens(pa.array([r[1]], pa.large_string())).hashes) for r in items.select("item", "text").collect()]
    shared = rows.sparkSession.sparkContext.broadcast(index_of([x for x in held if len(x[1])]))

    def run(batches):
        index = shared.value
        for batch in batches:
            for part in _slices(batch):
                if got := search(index, part.column("text"), min_overlap):
                    d, item, *numbers = map(list, zip(*got, strict=True))
                    numbers.append([len(index["words"][x]) for x in item])
                    columns = [part.column("id").take(pa.array(d)), part.column("th").take(pa.array(d)), pa.array([index["ids"][x] for x in item], pa.string())]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int32()) for x in numbers)], names=["id", "th", "item", "start", "n_tokens", "n_matches", "item_tokens"])

    return rows.mapInArrow(lean(run), FOUND) if shared.value["seeds"] else rows.sparkSession.createDataFrame([], FOUND)


def _posted(items: DataFrame, masks: list) -> DataFrame:
    """h, item, ith, at: the seeds of all items."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                words, first = tokens(part.column("text"))
                for k in range(part.num_rows):
                    for mask, only in masks:
                        h, at = item_seeds(words[first[k] : first[k + 1]], mask, only)
                        if len(h):
                            row = pa.array(np.full(len(h), k))
                            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column("item").take(row), part.column("ith").take(row), pa.array(at)], names=["h", "item", "ith", "at"])

    return items.mapInArrow(lean(run), "h long, item string, ith long, at long")


def _sought(rows: DataFrame, masks: list, bitmap) -> DataFrame:
    """h, id, th, pos: the seeds of the documents that the bitmap lets pass."""

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            for part in _slices(batch):
                words, first = tokens(part.column("text"))
                for mask, _ in masks:
                    mine = seeds(words, mask)
                    slot = mine >> np.uint64(64 - BITMAP_BITS)
                    passes = bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1
                    hit, doc = _inside(mask, first, np.flatnonzero(passes))
                    ends = _ends(mask, mine, first, hit, doc)
                    hit, doc = hit[ends], doc[ends]
                    if len(hit):
                        row = pa.array(doc)
                        yield pa.RecordBatch.from_arrays([pa.array(mine[hit].view(np.int64)), part.column("id").take(row), part.column("th").take(row), pa.array(hit - first[doc])], names=["h", "id", "th", "pos"])

    return rows.mapInArrow(lean(run), "h long, id string, th long, pos long")


def by_table(rows: DataFrame, items: DataFrame, min_overlap: int, scratch: Scratch) -> DataFrame:
    """The benchmark's seeds are a table; documents that share one meet the items they share it with."""
    spark = rows.sparkSession
    longest = max(map(len, MASKS))

    def lengths(batches):
        for batch in batches:
            for part in _slices(batch):
                n = np.diff(tokens(part.column("text")).first)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(n[n < longest]))], names=["n"])

    masks = masks_of([r.n for r in items.mapInArrow(lean(lengths), "n long").distinct().collect()])  # fewer than a mask has bits
    posted = scratch.write(_posted(items, masks), "posted")
    slot = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    parts = posted.groupBy(F.floor(slot / BITMAP_PART).alias("part")).agg(F.bitmap_construct_agg(slot % BITMAP_PART).alias("bits"))
    whole = bytearray(1 << (BITMAP_BITS - 3))
    for r in parts.toLocalIterator():
        whole[r.part * (BITMAP_PART >> 3) : (r.part + 1) * (BITMAP_PART >> 3)] = r.bits
    sought = scratch.write(_sought(rows, masks, spark.sparkContext.broadcast(bytes(whole))), "sought")
    pairs = sought.join(posted, "h").select("id", "th", "item", "ith", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()
    pairs = pairs.groupBy("id", "th", "item", "ith").agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
    pairs = scratch.write(pairs, "pairs")

    def named(df, **names):
        return df.select(*(F.col(c).alias(names.get(c, c)) for c in df.columns))

    own = named(rows, id="id_", th="th_")
    both = pairs.join(own, F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")))
    theirs = named(items, item="item_", ith="ith_", text="wanted")
    both = both.join(theirs, F.col("item").eqNullSafe(F.col("item_")) & (F.col("ith") == F.col("ith_")))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                doc, item = tokens(part.column("text")).hashes, tokens(part.column("wanted")).hashes
                best = None
                for diagonal in part.column("diagonals")[0].as_py():
                    best = better(best, overlap(doc, item, diagonal, min_overlap))
                if best and best[1]:
                    columns = [part.column(c) for c in ("id", "th", "item")]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x], pa.int32()) for x in (*best, len(item)))], names=["id", "th", "item", "start", "n_tokens", "n_matches", "item_tokens"])

    return both.select("id", "th", "item", "diagonals", "text", "wanted").mapInArrow(lean(run), FOUND)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_overlap: int = MIN_OVERLAP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document and item that overlap: doc_id, th, item_id, start, n_tokens, n_matches, item_tokens.

    start counts the document's tokens from 0; of equally good overlaps the first is given. Null
    and empty texts overlap nothing, on either side. An item shorter than a seed must occur whole
    and unchanged. Texts of any length are read whole, however often they repeat themselves. Rows
    that repeat are reported as often as they occur. An empty table on either side gives an empty
    result. Other columns are ignored; th is a hash of the document's text. Benchmarks of more than
    index_bytes are joined as a table, with the same result.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    wanted = items.where(F.length(F.col(item_text)) > 0).select(F.col(item_id).cast("string").alias("item"), F.xxhash64(F.col(item_text)).alias("ith"), F.col(item_text).alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scratch = Scratch(docs.sparkSession, "contamination")
    found = by_index(rows, wanted, min_overlap) if size <= index_bytes else by_table(rows, wanted, min_overlap, scratch)
    found = scratch.write(found, "found")
    kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_id]
    return found.select(F.col("id").cast(kind[0]).alias("doc_id"), "th", F.col("item").cast(kind[1]).alias("item_id"), "start", "n_tokens", "n_matches", "item_tokens")


def op4_decontaminate(spark, sf_dir):
    """The documents that hold a benchmark passage, with the item and the overlap."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("th")
