"""Queries register themselves here, each with the SQL of its oracle if SQL can express it."""

from __future__ import annotations

from ..sources.tables import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, sf_dir: str, name: str = "documents"):
    """A table whose texts are worth every core."""
    return spread(table(spark, sf_dir, name))
