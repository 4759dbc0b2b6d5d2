"""A multi-class weighted Tsetlin machine, trained with numpy in one task for each model.

A class has n_clauses clauses, half of them for it and half against. Each clause is a conjunction
of literals chosen by a team of two-action automata. A training example gives feedback to its
class and to one other class drawn at random, in proportion to how far the clipped vote is from the
margin T: type I makes clauses that agree remember what is present and forget the rest, at rates
set by s; type II makes clauses that fire wrongly include a literal that is absent. A clause's
weight grows when it votes rightly and shrinks when it votes wrongly.

Models are rows of a settings table (setting, seed, fold), so all of them train in parallel. A
model's training rows are bounded by max_rows, taken in order of a hash of the id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clauses as C

STATES = 100  # states of an automaton on either side


@dataclass(frozen=True)
class Setting:
    n_clauses: int = 20
    T: int = 15
    s: float = 4.0
    epochs: int = 10
    weighted: bool = True
    boost: bool = True

    def __post_init__(self):
        if self.n_clauses < 2 or self.n_clauses % 2 or self.T < 1 or self.s <= 1 or self.epochs < 1:
            raise ValueError(f"bad setting {self}")


class Machine:
    """The automata of all classes: state[class, clause, literal], weight[class, clause]."""

    def __init__(self, setting: Setting, n_features: int, n_classes: int, seed: int):
        if seed < 1:
            raise ValueError("seed must be >= 1")
        self.setting, self.n = setting, n_features
        self.rng = np.random.default_rng(seed)
        shape = (n_classes, setting.n_clauses, 2 * n_features)
        self.state = np.where(self.rng.random(shape) < 0.5, STATES, STATES + 1).astype(np.int16)
        self.sign = np.where(np.arange(setting.n_clauses) % 2 == 0, 1, -1)
        self.weight = np.ones(shape[:2], dtype=np.int32)

    def included(self) -> np.ndarray:
        return self.state > STATES

    def outputs(self, literals: np.ndarray, c: int, training: bool) -> np.ndarray:
        inc = self.included()[c]
        out = ~(inc & ~literals).any(axis=1)
        return out if training else out & inc.any(axis=1)

    def _feedback(self, literals: np.ndarray, c: int, target: bool) -> None:
        p, state = self.setting, self.state[c]
        out = self.outputs(literals, c, True)
        votes = int(np.clip((out * self.weight[c] * self.sign).sum(), -p.T, p.T))
        chance = (p.T - votes if target else p.T + votes) / (2 * p.T)
        active = self.rng.random(len(out)) < chance
        agrees = (self.sign > 0) == target
        first, second = active & agrees, active & ~agrees & out
        draw = self.rng.random((int(first.sum()), state.shape[1]), dtype=np.float32)
        fired = out[first][:, None]
        forget = draw < 1 / p.s
        up = fired & literals & (np.ones_like(forget) if p.boost else ~forget)
        down = forget & ~(fired & literals)
        state[first] = np.clip(state[first] + up - down, 1, 2 * STATES)
        state[second] += (~literals & (state[second] <= STATES)).astype(np.int16)
        if p.weighted:
            self.weight[c][first & out] += 1
            shrink = second & (self.weight[c] > 0)
            self.weight[c][shrink] -= 1

    def epoch(self, x: np.ndarray, y: np.ndarray) -> None:
        k = len(self.state)
        for i in self.rng.permutation(len(x)):
            self._feedback(x[i], int(y[i]), True)
            if k > 1:
                other = int(self.rng.integers(k - 1))
                self._feedback(x[i], other + (other >= y[i]), False)

    def rows(self, classes: list[str]) -> list[tuple]:
        """The clauses as rows of the clause table."""
        inc, out = self.included(), []
        for c, name in enumerate(classes):
            for j in range(self.setting.n_clauses):
                ids = np.flatnonzero(inc[c, j])
                out.append((len(out), c, name, int(self.sign[j] * self.weight[c, j]), ids[ids < self.n].tolist(), (ids[ids >= self.n] - self.n).tolist()))
        return out


def matrix(features, n: int) -> np.ndarray:
    x = np.zeros((len(features), 2 * n), dtype=bool)
    for i, ids in enumerate(features):
        x[i, np.asarray(ids, dtype=np.int64)] = True
    x[:, n:] = ~x[:, :n]
    return x


def train(rows: DataFrame, n_features: int, settings: dict[str, Setting], seeds=(1,), folds: bool = False, max_rows: int = 20_000) -> DataFrame:
    """rows (doc_id, label, features, fold) -> clause rows with setting, seed and fold.

    With folds, a model is trained for each fold on all others; else fold is -1. One task trains one
    model from its rows, of which there are max_rows at most.
    """
    spark = rows.sparkSession
    few = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    numbers = sorted(r[0] for r in rows.select("fold").distinct().collect()) if folds else [-1]
    jobs = [(name, int(seed), int(k)) for name in settings for seed in seeds for k in numbers]
    table = spark.createDataFrame(jobs, "setting string, seed int, out int")
    spread = few.join(F.broadcast(table), F.lit(True)).where("fold is null or fold <> out") if folds else few.join(F.broadcast(table), F.lit(True))

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        name, seed, out = key
        pdf = pdf.sort_values("doc_id")
        names = sorted(pdf["label"].unique())
        y = pdf["label"].map({c: k for k, c in enumerate(names)}).to_numpy()
        x = matrix(pdf["features"].tolist(), n_features)
        machine = Machine(settings[name], n_features, len(names), seed)
        for _ in range(settings[name].epochs):
            machine.epoch(x, y)
        made = pd.DataFrame(machine.rows(names), columns=["clause_id", "class_idx", "class", "weight", "pos", "neg"])
        return made.assign(setting=name, seed=seed, fold=out)

    schema = f"{C.SCHEMA}, setting string, seed int, fold int"
    return spread.groupBy("setting", "seed", "out").applyInPandas(fit, schema)


def curve(rows: DataFrame, n_features: int, setting: Setting, seeds=(1,), max_rows: int = 20_000) -> DataFrame:
    """rows (doc_id, label, features, fold) -> seed, fold, epoch, val_f1, included, nonempty, changed.

    A model is fitted to max_rows rows at most, less those of its fold; after each epoch it is scored
    on all rows of its fold.
    """
    numbers = sorted(r[0] for r in rows.select("fold").distinct().collect())
    table = rows.sparkSession.createDataFrame([(int(s), int(k)) for s in seeds for k in numbers], "seed int, out int")
    few = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        seed, out = key
        pdf = pdf.sort_values("doc_id")
        names = sorted(pdf["label"].unique())
        y = pdf["label"].map({c: k for k, c in enumerate(names)}).to_numpy()
        x = matrix(pdf["features"].tolist(), n_features)
        machine, before, made = Machine(setting, n_features, len(names), seed), None, []
        for e in range(1, setting.epochs + 1):
            machine.epoch(x, y)
            inc = machine.included()
            changed = int(inc.sum() if before is None else (inc != before).sum())
            found = pd.DataFrame(machine.rows(names), columns=["clause_id", "class_idx", "class", "weight", "pos", "neg"])
            made.append(found.assign(seed=seed, fold=out, epoch=e, included=int(inc.sum()), nonempty=int(inc.any(axis=2).sum()), changed=changed))
            before = inc
        return pd.concat(made)

    spread = few.join(F.broadcast(table), F.lit(True)).where("fold is null or fold <> out")
    keys = ["seed", "fold", "epoch", "included", "nonempty", "changed"]
    models = spread.groupBy("seed", "out").applyInPandas(run, f"{C.SCHEMA}, seed int, fold int, epoch int, included int, nonempty int, changed int")
    packed = models.groupBy(*keys).agg(F.collect_list(F.struct("class", "weight", "pos", "neg")).alias("clauses_"))
    fired = F.filter("clauses_", lambda c: C.fires(F.col("features"), c["pos"], c["neg"]))
    votes = lambda name: F.aggregate(F.filter("fired_", lambda c: c["class"] == name), F.lit(0), lambda a, c: a + c["weight"])
    classes = F.array_distinct(F.transform("clauses_", lambda c: c["class"]))
    best = F.array_min(F.transform("classes_", lambda name: F.struct((-votes(name)).alias("s"), name.alias("class"))))["class"]
    scored = rows.join(F.broadcast(packed), "fold").withColumn("fired_", fired).withColumn("classes_", classes)
    cells = scored.select(*keys, "label", best.alias("pred")).groupBy(*keys, "label", "pred").agg(F.count("*").alias("n"))
    # a cell counts for its label and for its prediction, so a right one counts twice
    side = lambda name, true: F.struct(F.col(name).alias("class"), F.lit(true).alias("true"))
    right = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    each = cells.select(*keys, "n", right.alias("right"), F.explode(F.array(side("label", True), side("pred", False))).alias("x"))
    each = each.groupBy(*keys, "x.class").agg((F.sum("right") / F.sum("n")).alias("f1"), F.max("x.true").alias("occurs"))
    return each.where("occurs").groupBy(*keys).agg(F.avg("f1").alias("val_f1")).select("seed", "fold", "epoch", "val_f1", "included", "nonempty", "changed")


def out_of_fold(rows: DataFrame, n_features: int, settings: dict[str, Setting], seeds=(1,), max_rows: int = 20_000) -> DataFrame:
    """rows (doc_id, label, features, fold) -> setting, seed, doc_id, label, class, votes_for, votes_against, pred.

    Every row is scored by the model that was trained without its fold. The models of a fold travel
    together as one broadcast row, so rows are not multiplied before their clauses fire.
    """
    models = train(rows, n_features, settings, seeds, True, max_rows).persist()
    packed = models.groupBy("setting", "seed", "fold").agg(F.collect_list(F.struct("class", "weight", "pos", "neg")).alias("clauses_"))
    classes = F.array_sort(F.array_distinct(F.transform("clauses_", lambda c: c["class"])))
    scored = rows.join(F.broadcast(packed.withColumn("classes_", classes)), "fold")
    fired = F.filter("clauses_", lambda c: C.fires(F.col("features"), c["pos"], c["neg"]))
    scored = scored.withColumn("fired_", fired)
    votes = lambda name, sign: F.aggregate(F.filter("fired_", lambda c: c["class"] == name), F.lit(0), lambda a, c: a + F.greatest(c["weight"] * sign, F.lit(0)))
    each = F.transform("classes_", lambda name: F.struct(name.alias("class"), votes(name, 1).alias("votes_for"), votes(name, -1).alias("votes_against")))
    scored = scored.select("setting", "seed", "doc_id", "label", each.alias("votes_"))
    best = F.array_min(F.transform("votes_", lambda v: F.struct((v["votes_against"] - v["votes_for"]).alias("s"), v["class"].alias("class"))))["class"]
    scored = scored.withColumn("pred", best).withColumn("v", F.explode("votes_"))
    return scored.select("setting", "seed", "doc_id", "label", "v.class", "v.votes_for", "v.votes_against", "pred")


def formation(rows: DataFrame, n_features: int, setting: Setting, seed: int = 1, max_rows: int = 20_000) -> DataFrame:
    """epoch, jaccard (of the included literals with the final ones), literals (a non-empty clause), and
    class, feature_id, share: how many of the class's clauses for it include each literal of the final model."""
    few = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        names = sorted(pdf["label"].unique())
        y = pdf["label"].map({c: k for k, c in enumerate(names)}).to_numpy()
        x = matrix(pdf["features"].tolist(), n_features)
        machine, snapshots = Machine(setting, n_features, len(names), seed), []
        for _ in range(setting.epochs):
            machine.epoch(x, y)
            snapshots.append((machine.included().copy(), machine.weight.copy()))
        final, made = snapshots[-1][0], []
        for e, (inc, weight) in enumerate(snapshots, 1):
            union, counts = (inc | final).sum(), inc.sum(axis=2)
            jaccard = float((inc & final).sum() / max(1, union))
            literals = float(counts[counts > 0].mean()) if (counts > 0).any() else 0.0
            for c, name in enumerate(names):
                voting = inc[c][(weight[c] > 0) & (machine.sign > 0)]
                for f in np.flatnonzero(final[c][machine.sign > 0].any(axis=0)[:n_features]):
                    made.append((e, jaccard, literals, name, int(f), float(voting[:, f].mean()) if len(voting) else 0.0))
        return pd.DataFrame(made, columns=["epoch", "jaccard", "literals", "class", "feature_id", "share"])

    return few.groupBy(F.lit(0).alias("one")).applyInPandas(run, "epoch int, jaccard double, literals double, class string, feature_id int, share double")
