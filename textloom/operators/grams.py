"""Kernels on character n-grams of 2 and 3 code points, over Arrow batches: counts by group, and naive Bayes scores.

A slice of texts is one array of code points; an n-gram is a number made of its characters' ids, so
the distinct n-grams of every text come from one sort of numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # code points handled at once
BITS = 14  # of a character's id; the other bits of a number hold the text or group
HELD = 1 << 22  # counts a worker holds before it hands them on


def slices(texts: list[str], order) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of the texts, code points of all, first code point of each and the end), a slice each."""
    part, size = [], 0
    for i in order:
        if part and size + len(texts[i]) > SLICE:
            yield _points(texts, part)
            part, size = [], 0
        part.append(i)
        size += len(texts[i])
    if part:
        yield _points(texts, part)


def _points(texts, part):
    points = np.frombuffer("".join([texts[i] for i in part]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.array(part), points, np.concatenate(([0], np.cumsum([len(texts[i]) for i in part])))


def numbers(ids: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, number) of all n-grams. Ids are above 0, so that an n-gram of 2 is below any of 3."""
    ids, own = ids.astype(np.int64), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    two = (ids[:-1] << bits) | ids[1:]
    three = (two[:-1] << bits) | ids[2:]
    in2, in3 = own[:-1] == own[1:], own[:-2] == own[2:]
    return np.concatenate((own[:-1][in2], own[:-2][in3])), np.concatenate((two[in2], three[in3]))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of the runs of equal values in order."""
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(values)))


def strings(grams: np.ndarray, chars: np.ndarray, bits: int) -> pa.Array:
    """The n-grams as text; chars: code point of each id."""
    mask = (1 << bits) - 1
    ids = np.stack((grams >> (2 * bits), (grams >> bits) & mask, grams & mask), axis=1)
    there = ids > 0
    points = chars[ids]
    size = np.where(there, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), 0).sum(axis=1)
    data = points[there].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.StringArray.from_buffers(len(grams), pa.py_buffer(offsets), pa.py_buffer(data))


class Counts:
    """How many texts of each group hold each n-gram."""

    def __init__(self):
        self.groups, self.lut, self.chars, self.parts, self.size = {}, np.zeros(0x110000, np.int32), [0], [], 0

    def ids(self, points: np.ndarray) -> np.ndarray:
        ids = self.lut[points]
        if not ids.all():
            new = np.unique(points[ids == 0])
            self.lut[new] = np.arange(len(new)) + len(self.chars)
            self.chars += new.tolist()
            ids = self.lut[points]
        return ids

    def fits(self, points: np.ndarray) -> bool:
        return len(self.chars) + len(np.unique(points[self.lut[points] == 0])) < 1 << BITS

    def add(self, points: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> None:
        own, grams = numbers(self.ids(points), starts, BITS)
        distinct = np.sort((own << (3 * BITS)) | grams)
        distinct = distinct[_runs(distinct)[0]]
        grouped = np.sort((groups[distinct >> (3 * BITS)] << (3 * BITS)) | (distinct & ((1 << (3 * BITS)) - 1)))
        first, n = _runs(grouped)
        self.parts.append((grouped[first], n))
        self.size += len(first)
        if self.size >= HELD:
            self.merge()

    def merge(self) -> None:
        keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        first, _ = _runs(keys := keys[order])
        self.parts = [(keys[first], np.add.reduceat(n[order], first) if len(first) else n)]
        self.size = len(first)

    def frames(self):
        """repo, language, term, n; what was held is given away."""
        if self.parts:
            self.merge()
            keys, n = self.parts[0]
            for i in range(0, len(keys), 1 << 17):
                yield self._frame(keys[i : i + (1 << 17)] >> (3 * BITS), strings(keys[i : i + (1 << 17)] & ((1 << (3 * BITS)) - 1), np.array(self.chars), BITS), n[i : i + (1 << 17)])
        self.__init__()

    def _frame(self, groups, terms, n):
        repos, languages = zip(*self.groups, strict=True)
        at = pa.array(groups)
        return pa.RecordBatch.from_arrays([pa.array(repos, pa.string()).take(at), pa.array(languages, pa.string()).take(at), terms, pa.array(n, pa.int64())], names=["repo", "language", "term", "n"])

    def alone(self, points: np.ndarray, group: int):
        """The frame of one text of more characters than ids have room for."""
        chars, ids = np.unique(points, return_inverse=True)
        grams = np.unique(numbers(ids + 1, np.array([0, len(points)]), 21)[1])
        return self._frame(np.full(len(grams), group), strings(grams, np.concatenate(([0], chars)), 21), np.ones(len(grams), np.int64))


def count_batches(batches):
    """repo, language, text -> repo, language, term, n: how many of the texts hold the term, for a part of the rows."""
    held = Counts()
    for batch in batches:
        keys = list(zip(batch.column("repo").to_pylist(), batch.column("language").to_pylist(), strict=True))
        texts = [t or "" for t in batch.column("text").to_pylist()]
        if held.size >= HELD // 2 or len(held.groups) + len(keys) >= 1 << 20:
            yield from held.frames()
        marks = np.array([held.groups.setdefault(k, len(held.groups)) for k in keys], dtype=np.int64)
        for part, points, starts in slices(texts, np.argsort(marks, kind="stable").tolist()):
            if held.fits(points):
                held.add(points, starts, marks[part])
                continue
            for k, i in enumerate(part):
                own = points[starts[k] : starts[k + 1]]
                if not held.fits(own):
                    groups = held.groups
                    yield from held.frames()
                    held.groups = groups
                if held.fits(own):
                    held.add(own, np.array([0, len(own)]), marks[i : i + 1])
                else:
                    yield held.alone(own, int(marks[i]))
    yield from held.frames()


def score_batches(batches, terms: list[str], models: list[list[tuple[np.ndarray, np.ndarray]]]):
    """Batches with folds (one a seed) and a text -> the other columns, folds, scores.

    models: for each model and seed, one after another, the (gain of every term and class, base of
    every class; NaN if it has none) of each fold. scores: those of a row's own folds, one after another.
    """
    chars = sorted({c for t in terms for c in t})
    bits = (len(chars) + 1).bit_length()
    lut = np.zeros(0x110000, np.uint32)
    lut[[ord(c) for c in chars]] = np.arange(len(chars)) + 1
    number = lambda t: sum(int(lut[ord(c)]) << (bits * k) for k, c in enumerate(reversed(t)))
    wanted = np.array([number(t) for t in terms], dtype=np.int64)
    order = np.argsort(wanted)
    direct = np.full(1 << (3 * bits), -1, np.int32) if bits <= 8 else None
    if direct is not None:
        direct[wanted] = np.arange(len(terms))
    n_classes = len(models[0][0][1])

    def places(grams):
        if direct is not None:
            return direct[grams]
        at = np.searchsorted(wanted[order], grams)
        at[at == len(order)] = 0
        return np.where(wanted[order][at] == grams, order[at], -1)

    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        folds = batch.column("folds").to_pylist()
        out = np.full((len(texts), len(models) * n_classes), np.nan)
        for part, points, starts in slices(texts, range(len(texts))):
            held = np.zeros((len(part), len(terms)))
            ids = lut[points]
            own, grams = numbers(ids, starts, bits)
            at = places(grams)
            held[own[at >= 0], at[at >= 0]] = 1
            for m, by_fold in enumerate(models):
                seed = m % len(folds[0])
                mine = np.array([-1 if folds[i][seed] is None else folds[i][seed] for i in part])
                for fold, (gain, base) in enumerate(by_fold):
                    rows = np.flatnonzero(mine == fold)
                    if len(rows):
                        out[part[rows], m * n_classes : (m + 1) * n_classes] = held[rows] @ gain + base
        flat = pa.array(out.ravel(), pa.float64(), from_pandas=True)
        scores = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * out.shape[1], pa.int32()), flat)
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), scores], names=[*kept, "scores"])
