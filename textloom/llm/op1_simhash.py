"""SimHash near-duplicates by a tiled, exact comparison of fingerprints.

Fingerprints that are equal are one class before anything is compared. The distinct ones are laid
out in tiles by the population counts of their four 16-bit quarters. Two fingerprints at distance
r have counts whose differences add up to at most r, so only tile pairs within the radius are
compared, all others are skipped unseen: exact, and a few per cent of all pairs. Tiles are split
by hash at TILE fingerprints. A tile pair is one exclusive-or and bit count in numpy, and returns
a spanning forest of its links rather than the links, so a large group costs no more rows than it
has members.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, read
from .components import stars

TILE = 2048
PARTS = 4  # parts of a fingerprint whose population counts are a tile's key
BITS_AT_ONCE = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles as a signed 64-bit integer; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= width:
        return int.from_bytes(xxhash.xxh64_digest(b" ".join(words), seed), "big", signed=True)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, BITS_AT_ONCE):
        k = min(n, i + BITS_AT_ONCE)
        spans = zip(starts[i:k].tolist(), ends[i + width - 1 : k + width - 1].tolist(), strict=True)
        raw = b"".join([digest(joined[s:e], seed) for s, e in spans])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array([fingerprint(t, width, seed) for t in pdf["text"]], dtype=np.int64)})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def steps(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of counts that add up to the radius at most; of a difference and its opposite only one."""
    out: list[tuple[int, ...]] = [()]
    for _ in range(parts):
        out = [(*d, x) for d in out for x in range(-radius, radius + 1) if sum(map(abs, d)) + abs(x) <= radius]
    return [d for d in out if d >= (0,) * parts]


def tile_pairs(fps: DataFrame, radius: int, scratch: Scratch, parts: int = PARTS) -> DataFrame:
    """Rows (a, b, same): the fingerprints of every pair of tiles that may hold a link.

    More parts make narrower tiles: fewer pairs are compared, and each tile is sent to more others.
    Two, four or eight parts give the same links.
    """
    width = 64 // parts
    base = 1 << width.bit_length()
    count = lambda k: F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit((1 << width) - 1).cast("long"))).cast("long")
    key = sum((count(k) * base**k for k in range(1, parts)), count(0))
    keyed = fps.select("fp", key.alias("key"))
    # at most (width + 1) ** parts keys, 83,521 of four parts: a proven bound, beyond which Spark decides
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    split = keyed.join(F.broadcast(sizes) if (width + 1) ** parts <= 100_000 else sizes, "key")
    split = split.withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    tiles = scratch.write(split.groupBy("key", "part").agg(F.collect_list("fp").alias("fps")), "tiles")
    moves = [F.struct(*(F.lit(x).alias(f"d{k}") for k, x in enumerate(d))) for d in steps(parts, radius)]
    left = tiles.select("key", "part", "fps", F.explode(F.array(*moves)).alias("d"))
    inside = F.lit(True)
    for k in range(parts):
        inside = inside & (F.shiftright("key", (base - 1).bit_length() * k).bitwiseAND(F.lit(base - 1).cast("long")) + F.col(f"d.d{k}")).between(0, width)
    to = F.col("key") + sum((F.col(f"d.d{k}") * F.lit(base**k).cast("long") for k in range(1, parts)), F.col("d.d0"))
    left = left.where(inside).select(F.col("key").alias("from"), F.col("part").alias("from_part"), F.col("fps").alias("a"), to.alias("key"))
    pairs = left.join(tiles, "key").where("key <> from or from_part <= part")
    return pairs.select("a", F.col("fps").alias("b"), F.expr("key = from and from_part = part").alias("same"))


def forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius between two tiles (or in one), reduced to a spanning forest."""
    us, vs = [], []
    for i in range(0, len(a), 256):
        near = np.bitwise_count(a[i : i + 256, None] ^ b[None, :]) <= radius
        x, y = np.nonzero(near)
        x += i
        if same:
            x, y = x[x < y], y[x < y]
        us.append(x)
        vs.append(y)
    u, v = np.concatenate(us), np.concatenate(vs)
    return spanning_forest(u, v, a) if same else spanning_forest(u, v + len(a), np.concatenate((a, b)))


def spanning_forest(u: np.ndarray, v: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes given by number -> as many links as nodes at most, with the same components."""
    if len(u) <= 2:
        return nodes[u], nodes[v]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    u = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[u], nodes[label[u]]


def links(fps: DataFrame, radius: int, scratch: Scratch, parts: int = PARTS) -> DataFrame:
    """fps: distinct fingerprints. Rows (u, v) that connect just what is linked within the radius."""

    def run(batches):
        for pdf in batches:
            found = [forest(np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64), same, radius) for a, b, same in zip(pdf["a"], pdf["b"], pdf["same"], strict=True)]
            found = [x for x in found if len(x[0])]
            if found:
                u, v = (np.concatenate(side).view(np.int64) for side in zip(*found, strict=True))
                yield pd.DataFrame({"u": u, "v": v})

    return tile_pairs(fps, radius, scratch, parts).mapInPandas(lean(run), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, seed: int = 42, parts: int = PARTS) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id (least id that links reach).

    Null and empty texts, and those of white space only, have fingerprint zero and are linked like
    any other. Equal texts, and rows that repeat, share a fingerprint and so a component. Texts of
    any length are read whole. A null id gets a row too; its component is the least id reached, or
    null if none is. An empty table gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, id_col, text_col, width, seed), "prints")
    classes = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = stars(links(classes, radius, scratch, parts), scratch)
    rooted = classes.join(found, classes.fp == found.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.write(rooted, "rooted")
    least = scratch.write(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = scratch.write(rooted.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark, sf_dir):
    return simhash_components(read(spark, sf_dir, "documents"))
