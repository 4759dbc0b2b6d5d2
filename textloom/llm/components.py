"""Connected components of a link table, by alternating large and small stars.

Each round rewires every node's larger neighbours to its smallest neighbour, then its smaller
neighbours and itself to the smallest of them; the links end as one star per component. Rounds
grow with the logarithm of the longest chain. A round is two aggregations and two joins on
tables just written, so hubs meet pre-aggregation in the former and splittable exchanges in the
latter, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def stars(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (u, v) -> one row (node, root) for every node that is not its component's least."""
    links = links.where("u is not null and v is not null and u <> v")
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.write(edges, "edges")
    state = _state(edges)
    for i in range(ROUNDS if state[0] else 0):
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionAll(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"large-min-{i}")
        # of a's neighbours only the larger move, so half of the links is enough
        large = edges.join(least.withColumnRenamed("a", "v"), "v").select("u", F.col("m").alias("v")).distinct()
        large = scratch.write(large, f"large-{i}")
        least2 = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), f"small-min-{i}")
        small = large.join(least2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = scratch.write(small.unionAll(least2.select("u", F.col("m").alias("v"))).distinct(), f"edges-{i}")
        for name in (f"large-min-{i}", f"large-{i}", f"small-min-{i}", f"edges-{i - 1}" if i else "edges"):
            scratch.drop(name)
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components have not settled after {ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
