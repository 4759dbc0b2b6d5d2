"""Scoring a stream of documents with a trained clause model: a stateless map, micro-batch by micro-batch.

Evaluation is a projection over the broadcast clauses, so it needs no state and no watermark, and
gives the same predictions as the batch operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.clauses import fires


def present(text: Column, terms: list[str]) -> Column:
    """The sorted ids of the terms that the text holds."""
    ids = F.array(*(F.when(F.contains(text, F.lit(t)), F.lit(i)) for i, t in enumerate(terms)))
    return F.array_compact(ids)


def score(stream: DataFrame, clauses: list[tuple], terms: list[str], text: str = "text") -> DataFrame:
    """Adds `pred` and `votes` (class -> votes) to a streaming or batch DataFrame of texts."""
    classes = sorted({(c[1], c[2]) for c in clauses})
    scored = stream.withColumn("features_", present(F.coalesce(F.col(text), F.lit("")), terms))
    votes = []
    for idx, _ in classes:
        total = F.lit(0)
        for c in clauses:
            if c[1] == idx:
                ids = lambda x: F.array(*map(F.lit, x)).cast("array<int>")
                total = total + F.when(fires(F.col("features_"), ids(c[4]), ids(c[5])), c[3]).otherwise(0)
        votes.append(total)
    names = F.array(*(F.lit(n) for _, n in classes))
    scored = scored.withColumn("v_", F.array(*votes))
    best = F.get(names, (F.array_position("v_", F.array_max("v_")) - 1).cast("int"))
    return scored.withColumn("pred", best).withColumn("votes", F.map_from_arrays(names, F.col("v_"))).drop("features_", "v_")
