"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document is a packet of `size` words in the queue of its source. A source's queue is
shuffled by a hash of the id and replayed up to `epochs` times; a copy's virtual finish time is
the source's words so far divided by the source's weight. All queues are then merged in order of
virtual finish and cut at the total budget.

Prefix sums never run over a whole source in one task: documents fall into hash buckets of about
BUCKET rows, and bucket totals are summed up a tree of fan-out FAN. The global sort is a range
histogram that is refined around the budget until one range is small; only that range is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, Scratch, read

BUCKET = 32  # documents in a leaf of the prefix-sum tree, on average
FAN_BITS = 6  # the tree's fan-out is 2 ** FAN_BITS
RANGES = 4096  # ranges of virtual finish times in one pass
SORTED_ROWS = 20_000  # copies sorted in one task at most, unless they all tie


def size_of(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """source, n, source_size -> also rank, weight, target.

    Weights go round by code point order, null last. The water level is the largest of the
    levels got by saturating the first k sources in order of size per weight: it rises until
    the right k and does not rise after.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, every = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    cum = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    level = (cum("source_size", every) - epochs * cum("source_size", before)) / (cum("weight", every) - cum("weight", before))
    filled = ranked.withColumn("step", level).withColumn("total", F.sum("source_size").over(every))
    filled = filled.withColumn("level", F.max("step").over(every))
    target = F.least((F.col("source_size") * epochs).cast("double"), F.col("weight") * F.col("level"))
    return filled.withColumn("target", F.coalesce(target, F.lit(0.0))).drop("step", "level")


def _running_size(docs: DataFrame, max_n: int) -> DataFrame:
    """Adds `cum`: words of the source up to and including the row, in hash order."""
    depth = max(1, math.ceil(math.log2(max(2, max_n / BUCKET)) / FAN_BITS))
    nbits = depth * FAN_BITS
    want = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(BUCKET)))).cast("int")
    prefix = F.conv(F.substring("h", 1, 12), 16, 10).cast("long")  # 48 bits of the hash
    # a source with few documents uses fewer bits, so that its buckets hold about BUCKET rows too
    unit = F.pow(F.lit(2.0), F.lit(nbits) - F.least(F.lit(nbits), want)).cast("long")
    docs = docs.withColumn("b", F.shiftright(prefix, 48 - nbits)).withColumn("b", F.col("b") - F.col("b") % unit)
    leaf = docs.groupBy("rank", "b").agg(F.sum("size").alias("t"))
    levels = [leaf]
    for _ in range(depth - 1):
        up = levels[-1].withColumn("b", F.shiftright("b", FAN_BITS))
        levels.append(up.groupBy("rank", "b").agg(F.sum("t").alias("t")))
    start = None
    for level in reversed(levels):
        group = F.shiftright("b", FAN_BITS)
        w = Window.partitionBy("rank", "g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        local = level.withColumn("g", group).withColumn("o", F.coalesce(F.sum("t").over(w), F.lit(0)))
        if start is not None:
            above = start.select("rank", F.col("b").alias("g"), F.col("o").alias("above"))
            local = local.join(above, ["rank", "g"]).withColumn("o", F.col("o") + F.col("above"))
        start = local.select("rank", "b", "o")
    w = Window.partitionBy("rank", "b").orderBy("h", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    return docs.join(start, ["rank", "b"]).withColumn("cum", F.sum("size").over(w) + F.col("o"))


def _cut(queue: DataFrame, total: int, epochs: int) -> tuple | None:
    """The last copy (finish, rank, h, row, pass) within the budget, or None if all copies fit."""
    copies = queue.where("size > 0").select("rank", "h", "row", "size", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), _finish(p).alias("f")) for p in range(epochs)))).alias("c")).select("rank", "h", "row", "size", "c.p", "c.f")
    low, high, base = 0.0, float(copies.agg(F.max("f")).first()[0] or 0.0), 0
    for _ in range(8):
        width = (high - low) / RANGES
        if width <= 0:
            break
        near = copies.where((F.col("f") >= low) & (F.col("f") <= high))
        r = F.least(F.lit(RANGES - 1), F.floor((F.col("f") - low) / width)).cast("int")
        w = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
        sums = near.groupBy(r.alias("r")).agg(F.sum("size").alias("t"), F.count("*").alias("n"), F.min("f").alias("lo"), F.max("f").alias("hi"))
        sums = sums.withColumn("cum", F.sum("t").over(w))
        hit = sums.where(F.col("cum") + base > total).orderBy("r").first()
        if hit is None:
            return None
        low, high, base = hit.lo, hit.hi, base + hit.cum - hit.t
        if hit.n <= SORTED_ROWS:
            break
    w = Window.orderBy("f", "rank", "h", "row", "p").rowsBetween(Window.unboundedPreceding, 0)
    near = copies.where((F.col("f") >= low) & (F.col("f") <= high)).withColumn("cum", F.sum("size").over(w) + base)
    last = near.where(F.col("cum") <= total).orderBy(F.desc("cum"), F.desc("f"), F.desc("rank"), F.desc("h"), F.desc("row"), F.desc("p")).first()
    return (last.f, last["rank"], last.h, last.row, last.p) if last else (math.nextafter(low, -1.0), 1 << 30, "~", 1 << 62, epochs)


def _finish(p: int) -> Column:
    return (F.col("cum") + p * F.col("source_size")) / F.col("weight")


def weighted_fair_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """Words the mix takes of every document: doc_id, source, size, source_size, target, taken.

    A null text has size 0 and takes 0; the null source is a source of its own, last in order.
    Rows that repeat are documents of their own. Rows with equal ids and sizes are told apart by a
    hash of the text, and fully equal rows may be taken in either order, as nothing tells them
    apart. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), F.md5(key).alias("h"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("row"))
    base = scratch.write(base, "base")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = scratch.write(source_targets(sizes, weights, epochs), "sources")
    queue = base.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    top = sources.agg(F.max("n"), F.max("total")).first()
    queue = scratch.write(_running_size(queue, top[0] or 1), "queue")
    out = ["doc_id", "source", "size", "source_size", "target"]
    cut = _cut(queue, int(top[1] or 0), epochs)
    if cut is None:
        return queue.select(*out, (F.col("size") * epochs).alias("taken"))
    f, rank, h, row, last_pass = cut
    taken = F.lit(0).cast("long")
    for p in range(epochs):
        mine = F.struct(_finish(p).alias("f"), F.col("rank").alias("k"), F.col("h").alias("h"), F.col("row").alias("r"), F.lit(p).alias("p"))
        bound = F.struct(F.lit(f).alias("f"), F.lit(rank).alias("k"), F.lit(h).alias("h"), F.lit(row).cast("long").alias("r"), F.lit(last_pass).alias("p"))
        taken = taken + F.when((F.col("size") > 0) & (mine <= bound), F.col("size")).otherwise(0)
    return queue.select(*out, taken.alias("taken"))


def op9_mixing(spark, sf_dir):
    return weighted_fair_mix(read(spark, sf_dir, "documents")).drop("source")


def mixing_sql(documents: str = "documents") -> str:
    """DuckDB SQL of the same result, by plain windows over the whole table."""
    return rf"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(COALESCE(doc_id::VARCHAR, '')) AS h FROM {documents}),
s0 AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rnk FROM s0),
s2 AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM s1),
s3 AS (SELECT *, ((SUM(source_size) OVER ())::BIGINT - 3 * COALESCE(SUM(source_size) OVER b, 0)::BIGINT)
              / ((SUM(weight) OVER ())::BIGINT - COALESCE(SUM(weight) OVER b, 0)::BIGINT) AS step,
              (SUM(source_size) OVER ())::BIGINT AS total
       FROM s2 WINDOW b AS (ORDER BY source_size / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, COALESCE(LEAST((3 * source_size)::DOUBLE, weight * MAX(step) OVER ()), 0) AS target FROM s3),
q AS (SELECT d.doc_id, d.size, d.h, s4.rnk, s4.weight, s4.source_size, s4.target, s4.total,
             (SUM(d.size) OVER (PARTITION BY s4.rnk ORDER BY d.h, d.size ROWS UNBOUNDED PRECEDING))::BIGINT AS cum
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
c AS (SELECT q.*, p.p, (q.cum + p.p * q.source_size) / q.weight AS f FROM q, (VALUES (0), (1), (2)) p(p) WHERE q.size > 0),
t AS (SELECT doc_id, size, SUM(size) OVER (ORDER BY f, rnk, h, p ROWS UNBOUNDED PRECEDING) AS upto, total FROM c),
k AS (SELECT doc_id, SUM(size)::BIGINT AS taken FROM t WHERE upto <= total GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, COALESCE(k.taken, 0) AS taken FROM q LEFT JOIN k USING (doc_id)"""
