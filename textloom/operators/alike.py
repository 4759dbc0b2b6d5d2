"""Kernels of near-duplicate removal, over Arrow batches: signatures, shingle sets, and the greedy rule."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa

SHINGLE = 5
BLOCK = 256  # rows of a class that are compared at once at most
_TOKEN = re.compile(r"\w+|[^\w\s]")


def shingle_set(text: str) -> np.ndarray:
    """What `functions.text.shingles` gives, sorted: distinct 32-bit hashes of runs of tokens."""
    md5 = hashlib.md5
    tokens = _TOKEN.findall(text)
    body = " ".join(tokens).encode("utf-8", "surrogatepass")
    if len(tokens) <= SHINGLE:
        found = md5(body, usedforsecurity=False).digest()
    else:
        sizes = np.array([*map(len, tokens)] if text.isascii() else [len(t.encode("utf-8", "surrogatepass")) for t in tokens])
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: 1 - SHINGLE].tolist()
        runs = {body[a:b] for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)}
        found = b"".join([md5(x, usedforsecurity=False).digest() for x in runs])
    return np.unique(np.frombuffer(found, ">u4")[::4].astype(np.uint32))


def signature_batches(batches):
    """Batches with a text -> the other columns, digest, low, n."""
    for batch in batches:
        digests, lows, sizes = [], [], []
        for text in batch.column("text").to_pylist():
            if text is None:
                digests.append(b"")
                lows.append(None)
                sizes.append(None)
                continue
            digests.append(hashlib.sha1(" ".join(text.split()).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest())
            h = shingle_set(text)
            lows.append(int(h[0]))
            sizes.append(len(h))
        kept = [c for c in batch.schema.names if c != "text"]
        columns = [*(batch.column(c) for c in kept), pa.array(digests, pa.binary()), pa.array(lows, pa.int64()), pa.array(sizes, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept, "digest", "low", "n"])


def set_batches(batches):
    """low, turn, text -> low, turn, h: the set as bytes."""
    for batch in batches:
        texts = batch.column("text")
        for i in range(0, len(texts), 1000):
            part = batch.slice(i, 1000)
            sets = [shingle_set(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("low"), part.column("turn"), pa.array(sets, pa.binary())], names=["low", "turn", "h"])


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    if min(len(a), len(b)) / max(len(a), len(b)) < threshold:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) >= threshold


class Kept:
    """The sets that stay, and an index of their shingles: sorted hashes, each with its set's number."""

    def __init__(self):
        self.sets, self.h, self.at = [], np.empty(0, np.uint32), np.empty(0, np.int64)

    def add(self, sets: list[np.ndarray]) -> None:
        h = np.concatenate([self.h, *sets])
        at = np.concatenate([self.at, np.repeat(np.arange(len(sets)) + len(self.sets), [len(x) for x in sets])])
        order = np.argsort(h, kind="stable")
        self.h, self.at = h[order], at[order]
        self.sets += sets

    def candidates(self, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
        """(number in `sets`, number here) of all that may be alike, in order.

        A set alike to one here shares at least `threshold` of its shingles with it, so one of any
        n - ceil(threshold n) + 1 of them; those that the fewest sets here hold are looked up.
        """
        n = np.array([len(x) for x in sets])
        h, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        left = np.searchsorted(self.h, h, "left")
        held = np.searchsorted(self.h, h, "right") - left
        order = np.lexsort((held, own))
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        few = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
        chosen = order[(place < few[own]) & (held[order] > 0)]
        count = held[chosen]
        if not len(count):
            return []
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pairs = np.unique(np.repeat(own[chosen], count) * len(self.sets) + self.at[np.repeat(left[chosen], count) + offset])
        return list(zip((pairs // len(self.sets)).tolist(), (pairs % len(self.sets)).tolist(), strict=True))


def _block(sets: list[np.ndarray], kept: Kept, threshold: float) -> np.ndarray:
    """Which of some consecutive sets go; those that stay are added."""
    gone = np.zeros(len(sets), dtype=bool)
    if kept.sets:
        for i, k in kept.candidates(sets, threshold):
            gone[i] = gone[i] or alike(sets[i], kept.sets[k], threshold)
    rest = [i for i in range(len(sets)) if not gone[i]]
    if len(rest) > 1:
        own = Kept()
        own.add([sets[i] for i in rest])
        for i, k in own.candidates(own.sets, threshold):
            if k < i and not gone[rest[i]] and not gone[rest[k]]:
                gone[rest[i]] = alike(own.sets[i], own.sets[k], threshold)
    if len(stay := [sets[i] for i in rest if not gone[i]]):
        kept.add(stay)
    return gone


def greedy_batches(batches, threshold: float):
    """low, turn, h in order, a class's rows one after another -> low, turn of those that go.

    A row goes if an earlier row of its class that stays is alike. Only sets that stay are held.
    """
    low, kept, turns, sets, size, out = None, Kept(), [], [], 16, []

    def decide():
        out.extend((low, t) for t, x in zip(turns, _block(sets, kept, threshold), strict=True) if x)
        turns.clear()
        sets.clear()

    for batch in batches:
        for k, turn, h in zip(batch.column("low").to_pylist(), batch.column("turn").to_pylist(), batch.column("h").to_pylist(), strict=True):
            if k != low or len(sets) >= size:
                if sets:
                    decide()
                size = min(2 * size, BLOCK)
                if k != low:
                    low, kept, size = k, Kept(), 16
            turns.append(turn)
            sets.append(np.frombuffer(h, np.uint32))
        yield _frame(out)
        out.clear()
    if sets:
        decide()
    yield _frame(out)


def _frame(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([t for _, t in out], pa.int32())], names=["low", "turn"])
