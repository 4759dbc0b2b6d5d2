"""Experiments as tables: the settings of a study, strict configurations, and their best."""

from __future__ import annotations

from dataclasses import fields
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, options: dict[str, list]) -> DataFrame:
    """One row for each distinct combination of the options, in order of the first occurrence of their values."""
    if not options or not all(options.values()):
        raise ValueError("every option needs a value")
    rows = list(dict.fromkeys(product(*options.values())))
    return spark.createDataFrame(rows, list(options)).select(*(F.col(c).cast("int") if isinstance(options[c][0], int) and not isinstance(options[c][0], bool) else F.col(c) for c in options))


def strict(kind: type, values: dict):
    """A dataclass from a mapping: unknown keys and values of another type than the default's are errors."""
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise ValueError(f"{kind.__name__}: unknown keys {unknown}")
    for name, value in values.items():
        default = known[name].default
        like = int if isinstance(default, bool) else type(default)
        number = isinstance(value, int | float) and not isinstance(value, bool) and isinstance(default, float)
        if isinstance(value, bool) != isinstance(default, bool) or not (isinstance(value, like) or number):
            raise ValueError(f"{kind.__name__}.{name}: {value!r} is no {type(default).__name__}")
    return kind(**values)


def unique_settings(base: list, *studies: list) -> list:
    """All settings of the studies once, the base ones first."""
    return list(dict.fromkeys([*base, *(s for study in studies for s in study)]))


def choose(studies: dict[str, list], names: list[str] | None) -> dict[str, list]:
    """The named studies; an unknown name is an error."""
    if names is None:
        return studies
    if unknown := sorted(set(names) - set(studies)):
        raise ValueError(f"unknown studies {unknown}")
    return {n: studies[n] for n in names}
