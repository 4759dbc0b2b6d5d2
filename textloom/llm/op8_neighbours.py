"""Nearest neighbours by inner product with a permutation index.

A vector is represented by its PREFIX nearest of PIVOTS pivots, in order. Nearness to a pivot is
by angle, so norms play no part in it. In every block of the index, pivot inverted files post each
distinct vector with the weight PREFIX - rank; a query reads the files of its own pivots. The
footrule distance of two prefixes, where a missing pivot has rank PREFIX, is a constant minus twice
the sum of the smaller of both weights over the pivots they share, so the sum tells the cosine: a
line fitted to some pairs of the block gives its estimate. The inner products of the candidates
best by norm and estimate give a level that the k-th neighbour reaches; a vector reaches it if its
cosine is level / norm, and the candidates are ranked by how little their estimate lacks of that,
which with equal norms is the order of the sums. The best FRACTION of a block (MIN_CANDIDATES at
least) is reranked by the inner product itself.

Index and queries are cut into blocks of a bounded size by a hash of the id, and every block of
queries meets every block of the index in a task of its own: nothing is broadcast but the pivots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read

PIVOTS, PREFIX = 256, 64
FRACTION, MIN_CANDIDATES = 0.22, 384
CLOSE = 0.9  # cosine from which a vector is no pivot beside another, while there are others
LEARN_QUERIES, LEARN_VECTORS = 64, 2_048  # of a pair of blocks, to fit the estimate of the cosine
LEVEL = 128  # candidates that tell the level of the k-th neighbour
INDEX_BLOCK, QUERY_BLOCK = 16_384, 1_024


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors that are not zero at unit length, and their norms."""
    most = np.abs(x).max(axis=1)
    x = x / most[:, None]
    norm = np.sqrt((x * x).sum(axis=1))
    return x / norm[:, None], most * norm


def weights(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """PREFIX - rank for the nearest pivots of each vector, 0 for the others."""
    prefix = min(prefix, len(pivots))
    out = np.zeros((len(x), len(pivots)), dtype=np.uint16)
    if prefix:
        order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]
        np.put_along_axis(out, order, np.arange(prefix, 0, -1, dtype=np.uint16)[None, :], axis=1)
    return out


def apart(pool: np.ndarray, pivots: int) -> np.ndarray:
    """The first vectors of the pool that are not close to one before: copies would be one pivot many times.

    If they are too few, what is close is taken more narrowly, down to copies, so pivots run short only
    where the pool has no more directions.
    """
    chosen: list[int] = []
    for close in (CLOSE, 0.97, 0.99, 0.999, 0.9999, 1 - 1e-9):
        for i in range(len(pool)):
            if len(chosen) < pivots and i not in chosen and not (pool[chosen] @ pool[i] > close).any():
                chosen.append(i)
    return pool[chosen]


def matrix(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.field("vec_id").to_numpy(zero_copy_only=False)
    flat = rows.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids, flat.reshape(len(ids), -1)


class Posted:
    """One block of the index: distinct vectors, their ids, and the pivots' inverted files."""

    def __init__(self, ids, x, pivots, prefix, k):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        self.x, first, label = np.unique(x, axis=0, return_index=True, return_inverse=True)
        by_age = np.argsort(first, kind="stable")  # distinct vectors in order of their least id
        place = np.empty_like(by_age)
        place[by_age] = np.arange(len(by_age))
        self.x, label = self.x[by_age], place[label.reshape(-1)]
        members = np.argsort(label, kind="stable")
        self.starts = np.searchsorted(label[members], np.arange(len(self.x) + 1))
        self.ids, self.k = ids[members], k
        self.unit, self.norms = unit(self.x)
        marks = weights(self.unit, pivots, prefix)
        pivot, self.posted = (c.astype(np.int32) for c in np.nonzero(marks.T))  # by pivot, then by vector
        self.weights = marks.T[pivot, self.posted]
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(pivot, minlength=len(pivots)))))
        self.line = 0.0, 0.0

    def shared(self, weight):
        """The sum of the smaller weights over the pivots shared with a query, from its pivots' files alone."""
        files = [(slice(self.ends[p], self.ends[p + 1]), weight[p]) for p in np.flatnonzero(weight)]
        if not files:
            return np.zeros(len(self.x))
        smaller = np.concatenate([np.minimum(self.weights[at], w) for at, w in files])
        return np.bincount(np.concatenate([self.posted[at] for at, _ in files]), smaller, len(self.x))

    def learn(self, units, marks):
        """Fits the line from sums to cosines on some of the queries and of the vectors."""
        some = slice(None, None, -(-len(self.x) // LEARN_VECTORS))
        picked = range(0, len(units), -(-len(units) // LEARN_QUERIES))
        sums = np.concatenate([self.shared(marks[i])[some] for i in picked])
        cosines = np.concatenate([self.unit[some] @ units[i] for i in picked])
        spread = sums.var()
        slope = max(0.0, ((sums - sums.mean()) * (cosines - cosines.mean())).mean() / spread) if spread else 0.0
        self.line = cosines.mean() - slope * sums.mean(), slope

    def nearest(self, query_id, q, weight, fraction, least):
        """(ids, scores) of the k nearest candidates, without the query's own row."""
        n = len(self.x)
        m = min(n, max(least, int(fraction * n)))
        if m < n:
            cosine = self.line[0] + self.line[1] * self.shared(weight)
            first = min(m, max(LEVEL, 2 * self.k + 2))
            likely = np.argpartition(-(self.norms * cosine), first - 1)[:first]
            reach = self.x[likely] @ unit(q[None, :])[0][0]
            level = np.partition(reach, max(0, first - self.k - 1))[max(0, first - self.k - 1)]
            lack = level / self.norms - cosine + np.arange(n) * 1e-12  # ties to the vector with the least id
            found = np.sort(np.argpartition(lack, m - 1)[:m])
        else:
            found = np.arange(n)
        if len(found) > self.k + 1:  # the matrix product may round otherwise: what it can't tell from the k-th stays
            rough = self.x[found] @ q
            slack = 8 * len(q) * np.finfo(np.float64).eps * self.norms[found].max() * np.sqrt(q @ q)
            found = found[~(rough < np.partition(rough, len(rough) - self.k - 1)[len(rough) - self.k - 1] - slack)]
        score = (self.x[found] * q).sum(axis=1)
        if len(found) > self.k + 1:  # as many distinct vectors, ties included, give k ids and the own one
            least_score = np.partition(score, len(score) - self.k - 1)[len(score) - self.k - 1]
            keep = score >= least_score
            found, score = found[keep], score[keep]
        ids, scores = [], []
        for c, s in zip(found.tolist(), score.tolist(), strict=True):
            mine = self.ids[self.starts[c] : min(self.starts[c + 1], self.starts[c] + self.k + 1)]
            ids.append(mine)
            scores.append(np.full(len(mine), s))
        ids, scores = np.concatenate(ids), np.concatenate(scores)
        ids, scores = ids[ids != query_id], scores[ids != query_id]
        order = np.lexsort((ids, -scores))[: self.k]
        return ids[order], scores[order]


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, fraction: float = FRACTION, min_candidates: int = MIN_CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that the condition picks.

    The condition is on id_col. Nearness is the inner product in double precision, ties go to the
    smaller id; a query's own id is no candidate. Rows with a null id take no part, nor do vectors
    that are null, empty, zero, or hold a null or non-finite component, nor those of a dimension
    other than the most frequent one. With fewer candidates than k, all are returned. Equal vectors
    are one entry of the index that keeps its k + 1 least ids per block, which no result can tell
    from all. An empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("asks"))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == dims.d)
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    h = F.xxhash64("v")
    some = rows.where(h / F.lit(2.0**64) + 0.5 <= min(1.0, 8.0 * pivots / n)).select(h.alias("h"), "v").groupBy("h").agg(F.first("v").alias("v"))
    pool = np.array([r.v for r in some.orderBy("h").limit(4 * pivots).collect()]).reshape(-1, dims.d)
    shared = spark.sparkContext.broadcast(apart(unit(pool)[0], pivots) if len(pool) else pool)
    ni, nq = -(-n // INDEX_BLOCK), max(1, -(-asking // QUERY_BLOCK))
    pair = F.struct("vec_id", "v")
    spread = lambda name, m: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    index = scratch.write(rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(ni)).cast("int").alias("ib")).agg(F.collect_list(pair).alias("index")), "index")
    asked = scratch.write(rows.where("asks").groupBy(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(nq)).cast("int").alias("qb")).agg(F.collect_list(pair).alias("asked")), "asked")
    parts = min(ni * nq, 20_000)
    left = index.select("ib", "index", spread("qb", nq)).repartition(parts, "ib", "qb")
    right = asked.select("qb", "asked", spread("ib", ni)).repartition(parts, "ib", "qb")

    def run(batches):
        marks = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x = matrix(batch.column("index")[i].values)
                block = Posted(ids, x, marks, prefix, k)
                ids, x = matrix(batch.column("asked")[i].values)
                units = unit(x)[0]
                mine = weights(units, marks, prefix)
                block.learn(units, mine)
                found = [block.nearest(*q, fraction, min_candidates) for q in zip(ids, x, mine, strict=True)]
                if found:
                    columns = [np.repeat(ids, [len(f[0]) for f in found]), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    found = left.join(right, ["ib", "qb"]).select("index", "asked").mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark, sf_dir):
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
