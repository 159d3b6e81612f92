"""Windows that repeat across a corpus, found without shuffling windows.

The consecutive windows of a document that share their minimizer (the leftmost k-gram of least hash) form a
piece.  Equal windows have equal minimizers at equal places, so all that repeats meets under a minimizer.
Pieces equal as a whole collapse: every occurrence but the first is covered.  The first occurrences under a
minimizer that several places have stay open, and only their windows are compared one by one later.
Within a task, later copies of a piece are told covered before the shuffle and are spread evenly, so a piece
held by a third of all rows sends one row a task to its minimizer.

A row is keyed by d, its doc_id (null last), and h, the 64-bit hash of its whole text, so rows that share a doc_id do
not mix and equal rows count once; at packs the first window's start and the number of windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sphereframe.llm.common import NULL_ID, materialize
from sphereframe.llm.minhash import mix

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Pieces that a task holds back to find copies among them.
HOLD = 400_000


class Powers:
    """Powers of the base and of its inverse modulo 2**64, made as far as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def need(cls, n: int) -> None:
        if len(cls.up) < n:
            m = max(n, 1 << 16)
            cls.up = np.cumprod(np.r_[_U(1), np.full(m, _U(_BASE))])
            cls.down = np.cumprod(np.r_[_U(1), np.full(m, _U(_INVERSE))])


class Hashes:
    """Hashes of any spans of a sequence of 64-bit units, equal wherever the spans are equal."""

    def __init__(self, units: np.ndarray):
        Powers.need(len(units) + 1)
        self.sums = np.r_[_U(0), np.cumsum(units * Powers.down[: len(units)])]

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * Powers.up[start] + np.asarray(length).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Of every span of k units, as of."""
        return mix((self.sums[k:] - self.sums[:-k]) * Powers.up[: len(self.sums) - k] + _U(k))


def least(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of w values of h, the least one."""
    span = 1
    while span < w:
        step = min(span, w - span)
        h = np.minimum(h[:-step], h[step:])
        span += step
    return h


def pieces(units: np.ndarray, window: int, k: int) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes, and for each piece its first window, number of windows, minimizer and body hash."""
    spans = Hashes(units)
    grams = spans.grams(k)
    mini = least(grams, window - k + 1)
    # the leftmost least gram changes where it starts its window, or where a lesser one comes in
    first = np.flatnonzero(np.r_[True, (mini[1:] != mini[:-1]) | (grams[: len(mini) - 1] == mini[:-1])])
    n = np.diff(np.r_[first, len(mini)])
    return spans, first, n, mini[first], spans.of(first, n + window - 1)


def keyed(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text.  d, h, doc_id, text with nulls replaced where they would be in the way."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), F.xxhash64(text).alias("h"), "doc_id", text.alias("text"))


def later(keys: list[np.ndarray], place: list[np.ndarray], within: bool) -> np.ndarray:
    """Which rows are later than the first with the same keys: by d, or by the whole place (d, h, at) if within."""
    order = np.lexsort((*place[::-1], *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    late = np.zeros(len(order), bool)
    for x in place if within else place[:1]:
        late[order] |= x[order] != x[head]
    return late


def spread(rows: list[tuple[np.ndarray, ...]], within: bool) -> pa.RecordBatch:
    """Rows (two keys, d, h, at) of a task as go, key, d, h, at.

    An even go is the first key.  Rows covered already have an odd go, which only spreads them, and no key: they
    need no more room in the shuffle than their place.
    """
    a, b, d, h, at = (np.concatenate(c) for c in zip(*rows, strict=True))
    a = a & ~_U(1)
    late = later([a, b], [d, h, at], within)
    go = np.where(late, mix(at.view(np.uint64) ^ h.view(np.uint64)) >> _U(32) << _U(1) | _U(1), a)
    return pa.RecordBatch.from_arrays([pa.array(go.view(np.int64)), pa.array(np.where(late, _U(0), b).view(np.int64)), pa.array(d), pa.array(h), pa.array(at)], ["go", "key", "d", "h", "at"])


SPREAD = "go bigint, key bigint, d bigint, h bigint, at bigint"


def _covered(within: bool):
    """The place of a row of spread, and whether it is later than the first with its keys."""
    place = F.struct("d", "h", "at") if within else F.col("d")
    return place, (F.col("go").bitwiseAND(F.lit(1)) == 1) | (place > F.min(place).over(Window.partitionBy("go", "key")))


def scan(rows: DataFrame, units: Callable, window: int, k: int, within: bool) -> DataFrame:
    """rows: d, h, text.  The pieces under minimizers that several places have: d, h, at, covered, crowd, go.

    go names the minimizer of a piece that is not covered.  units gives a function from a text to its bytes and its 64-bit units; it is called once a task.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, n_held = units(), [], 0
        for b in batches:
            for d, h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                _, u = of(x.as_py())
                if len(u) < window:
                    continue
                _, first, n, mini, body = pieces(u, window, k)
                at = (first.astype(np.int64) << 8) + n
                held.append((mini, body, np.full(len(at), d, np.int64), np.full(len(at), h, np.int64), at))
                n_held += len(at)
                if n_held >= HOLD:
                    yield spread(held, within)
                    held, n_held = [], 0
        if held:
            yield spread(held, within)

    place, covered = _covered(within)
    one = Window.partitionBy("go")
    out = rows.select("d", "h", "text").mapInArrow(extract, SPREAD).withColumn("covered", covered)
    out = out.withColumn("crowd", F.count(F.lit(1)).over(one)).withColumn("several", F.min(place).over(one) < F.max(place).over(one))
    return out.where("covered or several").select("d", "h", "at", "covered", "crowd", F.when(~F.col("covered"), F.col("go")).alias("go"))


def settle(rows: DataFrame, within: bool) -> DataFrame:
    """rows as of spread, their keys an edge's hash and its minimizer; (d, h, at) of those covered."""
    return rows.withColumn("covered", _covered(within)[1]).where("covered").select("d", "h", "at")


def by_document(rows: DataFrame, name: str, value: str = "at") -> DataFrame:
    """(d, h, set of value): as long as the document's own windows at most, however many equal rows there are."""
    return rows.groupBy("d", "h").agg(F.collect_set(value).alias(name))


def unpack(at) -> tuple[np.ndarray, np.ndarray]:
    """The starts and counts of windows, in order."""
    a = np.sort(np.asarray(at if at is not None else [], np.int64))
    return a >> 8, a & 0xFF


def mark(n_units: int, window: int, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which units the windows cover."""
    edge = np.zeros(n_units + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + count - 1 + window, -1)
    return np.cumsum(edge)[:n_units] > 0
