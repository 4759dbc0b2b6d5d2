"""Near-duplicate documents by SimHash, for pruning a corpus: one document of each group stays.

The same tiled, exact comparison as in op1_simhash, with a fingerprint of 128 bits over five-word
shingles, so that similarities down to 0.8 are told from chance. Two sets of shingles that are
0.8 alike differ by a quarter in size at most, so tiles are laid out by shingle count (bands of a
factor of 1 / SIMILARITY) and population count, and only neighbouring tiles are compared. A pair of
tiles names its texts that have a link; their sets of shingles then meet in one task, where every
link between texts not yet joined is compared shingle by shingle. Those at least SIMILARITY alike
make the groups, and a spanning forest of them leaves the task, so a group costs rows in proportion
to its members.
"""

from __future__ import annotations

from itertools import product
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, counted, give_back, lean
from .components import stars
from .op1_simhash import BITS_AT_ONCE, TILE
from .repeats import as_text, keyed, longs

WIDTH, SIMILARITY = 5, 0.8
RADIUS = 36  # of 128 bits; texts 0.8 alike differ in 19 with a deviation of 4, unrelated ones in 64 on average
SHINGLES = 1 << 20  # of a tile at most, or one text: what a task that compares sets holds of each side
POPULATION = 8  # population counts are laid out in groups of this width


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """128-bit hashes of the lower-cased word shingles, (n, 16) bytes, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    joined, digest = b" ".join(words), xxhash.xxh3_128_digest
    if len(words) <= width:
        return np.frombuffer(digest(joined), np.uint8).reshape(-1, 16) if words else np.empty((0, 16), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1))
    raw = b"".join([digest(joined[s:e]) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)])
    return np.frombuffer(raw, np.uint8).reshape(-1, 16)


def wide_fingerprint(text: str | None, width: int = WIDTH) -> tuple[int, int, int, int]:
    """(two words of the fingerprint, number of distinct shingles, hash of the words) of a text."""
    h = shingle_hashes(text, width)
    ones = np.zeros(128, dtype=np.int64)
    for i in range(0, len(h), BITS_AT_ONCE):
        ones += np.unpackbits(h[i : i + BITS_AT_ONCE], axis=1).sum(axis=0, dtype=np.int64)
    a, b = np.packbits(2 * ones > len(h)).view(np.int64).tolist()
    distinct = len(np.unique(h[:, :8].copy().view(np.int64)))
    same = xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())) - (1 << 63)
    return a, b, distinct, same


def prints(rows: DataFrame, width: int) -> DataFrame:
    """id, th -> id, th, t (hash of the words), f1, f2, n."""

    def run(batches):
        for pdf in batches:
            f = np.array([wide_fingerprint(x, width) for x in pdf["text"]], dtype=np.int64).reshape(-1, 4)
            yield pd.DataFrame({"id": pdf["id"], "th": pdf["th"], "t": f[:, 3], "f1": f[:, 0], "f2": f[:, 1], "n": f[:, 2]})

    return longs(as_text(rows.select("id", "th", "text")).mapInPandas(lean(run), "id string, th long, t long, f1 long, f2 long, n long"))


def _within(a: dict, b: dict, same: bool, radius: int):
    """The pairs (x, y) of texts of two tiles within the radius, for 128 texts of a at once."""
    for i in range(0, len(a["t"]), 128):
        apart = np.bitwise_count(a["f1"][i : i + 128, None] ^ b["f1"][None, :])
        apart += np.bitwise_count(a["f2"][i : i + 128, None] ^ b["f2"][None, :])  # 128 at most
        at = np.flatnonzero(apart <= radius)
        x, y = i + at // len(b["t"]), at % len(b["t"])
        near = x < y if same else slice(None)
        yield x[near], y[near]


def wide_links(classes: DataFrame, radius: int, similarity: float, scratch: Scratch) -> DataFrame:
    """classes (t, f1, f2, n) -> pair, side, t, f1, f2: in every pair of tiles, the texts that have a link within the radius."""
    band = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.log(F.lit(1 / similarity))).cast("int")
    group = F.floor((F.bit_count("f1") + F.bit_count("f2")) / POPULATION).cast("int")
    keyed_ = classes.select("t", "f1", "f2", band.alias("band"), group.alias("pop"))
    # few keys: one for each band of sizes, at most log(longest text) / log(1.25), and group
    size = F.least(F.lit(TILE), F.greatest(F.lit(1), F.floor(F.lit(SHINGLES) * F.pow(F.lit(similarity), F.col("band") + 1))))
    parts = keyed_.groupBy("band", "pop").agg(F.count("*").alias("n")).select("band", "pop", F.ceil(F.col("n") / size).alias("parts"))
    split = keyed_.join(F.broadcast(parts), ["band", "pop"]).withColumn("part", F.pmod(F.xxhash64("t"), "parts").cast("int"))
    tile = F.collect_list(F.struct("t", "f1", "f2")).alias("tile")
    tiles = scratch.write(split.groupBy("band", "pop", "part").agg(tile), "tiles")
    reach = ceil(radius / POPULATION)
    moves = [m for m in product((0, 1, -1), range(-reach, reach + 1)) if m >= (0, 0)]
    moved = F.explode(F.array(*(F.struct(F.lit(b).alias("b"), F.lit(p).alias("p")) for b, p in moves))).alias("d")
    left = tiles.select(F.col("band").alias("b0"), F.col("pop").alias("p0"), F.col("part").alias("part0"), F.col("tile").alias("a"), moved)
    left = left.select("b0", "p0", "part0", "a", (F.col("b0") + F.col("d.b")).alias("band"), (F.col("p0") + F.col("d.p")).alias("pop"))
    own = F.expr("band = b0 and pop = p0")
    pairs = left.join(tiles, ["band", "pop"]).where(~own | F.expr("part0 <= part"))
    pair = F.xxhash64("b0", "p0", "part0", "band", "pop", "part").alias("pair")
    pairs = pairs.select(pair, "a", F.col("tile").alias("b"), (own & F.expr("part0 = part")).alias("same"))

    def run(batches):
        for batch in batches:
            sides = []
            for name in ("a", "b"):
                lists = batch.column(name)
                rows = lists.flatten()
                columns = {k: rows.field(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in ("t", "f1", "f2")}
                ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
                sides.append([{k: v[s:e] for k, v in columns.items()} for s, e in zip(ends[:-1], ends[1:], strict=True)])
            for number, a, b, same in zip(batch.column("pair").to_pylist(), *sides, batch.column("same").to_pylist(), strict=True):
                linked = [np.zeros(len(a["t"]), dtype=bool), np.zeros(len(b["t"]), dtype=bool)]
                for x, y in _within(a, b, same, radius):
                    linked[0][x] = True
                    linked[0 if same else 1][y] = True
                for side, (rows, chosen) in enumerate(zip((a, b), linked, strict=True)):
                    if n := int(chosen.sum()):
                        columns = [pa.array(np.full(n, number)), pa.array(np.full(n, side, dtype=np.int32)), *(pa.array(rows[k][chosen].view(np.int64)) for k in ("t", "f1", "f2"))]
                        yield pa.RecordBatch.from_arrays(columns, names=["pair", "side", "t", "f1", "f2"])

    return pairs.mapInArrow(lean(run), "pair long, side int, t long, f1 long, f2 long")


def alike_forest(a: dict, b: dict, same: bool, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The links within the radius whose sets are alike, reduced to a spanning forest.

    A side has t, f1, f2, and its sets as codes (all of them) and ends (from 0). Every link is
    compared but those between texts that verified links join already.
    """
    shift = 0 if same else len(a["t"])
    nodes = a["t"] if same else np.concatenate((a["t"], b["t"]))
    label = np.arange(len(nodes))
    mark = np.zeros(1 + max((int(side["codes"].max()) for side in (a, b) if len(side["codes"])), default=0), dtype=bool)
    sizes, us, vs = np.diff(b["ends"]), [], []
    for x, y in _within(a, b, same, radius):
        firsts = np.flatnonzero(np.diff(x, prepend=-1))
        for k, ys in zip(x[firsts].tolist(), np.split(y, firsts[1:]) if len(firsts) else [], strict=True):
            ys = ys[label[ys + shift] != label[k]]
            mine = a["codes"][a["ends"][k] : a["ends"][k + 1]]
            mark[mine] = True
            for i in range(0, len(ys), 256):
                some = ys[i : i + 256]
                n = sizes[some]
                at = np.arange(n.sum()) + np.repeat(b["ends"][some] - (np.cumsum(n) - n), n)
                hits = np.concatenate(([0], np.cumsum(mark[b["codes"][at]])))
                shared = hits[np.cumsum(n)] - hits[np.cumsum(n) - n]
                some = some[shared >= similarity * (len(mine) + n - shared)]
                joined, one = np.unique(label[some + shift], return_index=True)
                one = one[joined != label[k]]
                us.append(np.full(len(one), k))
                vs.append(some[one] + shift)
                if len(one):
                    label[np.isin(label, joined)] = label[k]
            mark[mine] = False
    u, v = (np.concatenate(side) if side else np.zeros(0, dtype=np.int64) for side in (us, vs))
    return nodes[u], nodes[v]


def _verified(linked: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Rows u, v that connect just what links of at least the similarity connect in each pair of tiles."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, t, f1, f2 = (table.column(c).to_numpy() for c in ("side", "t", "f1", "f2"))
        lists = table.column("shingles").combine_chunks()
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        codes = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1].reshape(-1)
        sides = []
        for k in (0, 1):
            rows = np.flatnonzero(side == k)
            rows = rows[np.argsort(t[rows], kind="stable")]  # so that every run returns the same links
            n = ends[rows + 1] - ends[rows]
            at = np.arange(n.sum()) + np.repeat(ends[rows] - (np.cumsum(n) - n), n)
            sides.append({"t": t[rows], "f1": f1[rows].view(np.uint64), "f2": f2[rows].view(np.uint64), "codes": codes[at], "ends": np.concatenate(([0], np.cumsum(n)))})
        same = not len(sides[1]["t"])
        u, v = alike_forest(sides[0], sides[0] if same else sides[1], same, radius, similarity)
        give_back()
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return linked.join(sets, "t").select("pair", "side", "t", "f1", "f2", "shingles").groupBy("pair").applyInArrow(run, "u long, v long")


def _shingle_sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """t, shingles: the distinct shingle hashes of one text of each wanted class (t, th)."""
    wanted = wanted.withColumnRenamed("th", "wth")

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 256):  # a set is as large as its text, so few are held at once
                part = pdf.iloc[i : i + 256]
                sets = [np.unique(shingle_hashes(t, width)[:, :8].copy().view(np.int64).reshape(-1)) for t in part["text"]]
                yield pd.DataFrame({"t": part["t"].to_numpy(), "shingles": sets})

    joined = rows.select("th", "text").join(counted(wanted), F.col("th") == F.col("wth"))
    # texts that are copies of one another are read once
    return joined.groupBy("t").agg(F.first("text").alias("text")).mapInPandas(lean(run), "t long, shingles array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The documents to remove: id, th (xxhash64 of the text), kept_id.

    A group is what links of at least the similarity connect, directly or by a chain, so a text may
    go that is less alike to the one that stays than to another that goes. kept_id is the document
    that stays: the least id of the group, a null id before all. Texts with the same words are alike whatever their case and white space; a text of fewer
    words than a shingle is one shingle; texts without words are alike. Rows equal in id and text
    are one document and stay or go together. Texts of any length are read whole. An empty table
    gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows = keyed(docs, id_col, text_col)
    found = scratch.write(prints(rows, width), "prints")
    by_words = found.groupBy("t").agg(F.min(F.struct("id", "th")).alias("rep"), *(F.first(c).alias(c) for c in ("f1", "f2", "n")))
    classes = scratch.write(by_words, "classes")
    linked = scratch.write(wide_links(classes, radius, similarity, scratch), "linked")
    wanted = linked.select(F.col("t").alias("node")).distinct()
    wanted = scratch.write(wanted.join(classes, wanted.node == classes.t).select("t", F.col("rep.th").alias("th")), "wanted")
    sets = scratch.write(_shingle_sets(rows, wanted, width), "sets")
    alike = _verified(linked, sets, radius, similarity)
    roots = stars(scratch.write(alike, "alike"), scratch)
    status = classes.select("t", "rep").join(roots, F.col("t") == F.col("node"), "left")
    status = scratch.write(status.select("t", "rep", F.coalesce("root", "t").alias("root")), "status")
    least = scratch.write(status.groupBy("root").agg(F.min("rep").alias("kept")), "least")
    kept = scratch.write(status.join(least, "root").select("t", "kept"), "kept")
    every = found.select("id", "th", "t").join(kept, "t")
    gone = every.where(~F.struct("id", "th").eqNullSafe(F.col("kept")))
    return gone.select("id", "th", F.col("kept.id").alias("kept_id")).distinct()


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose (id, xxhash64 of the text) is in `gone`."""
    null = F.lit(-(1 << 63))
    gone = gone.select(F.coalesce(F.col("id").cast("long"), null).alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    same = (F.coalesce(F.col(id_col).cast("long"), null) == F.col("gone_id")) & (F.xxhash64(F.col(text_col)) == F.col("gone_th"))
    return docs.join(counted(gone), same, "left_anti")
