"""Suffix-array deduplication of byte strings by two-stage suffix sorting.

Strings of WINDOW bytes that could repeat are found under their minimizers (see repeats); those not settled
as whole copies come, with the bytes around them, into blocks in which all strings of a minimizer meet.  A
block's suffixes are sorted in two stages: suffixes smaller than their successors directly, on their first
WINDOW bytes; all others are induced from them by one scan of the buckets of first bytes.  Common prefixes of
neighbours in that order then give the groups of equal strings, and the first place of each group stays.
A minimizer with more than CROWD places would make a block without bound: its strings are compared by hashes
over a shuffle instead, with the same result.

Defined results: a null text is empty; a very long text is read whole; repeated rows of one doc_id and text keep each
other, unlike texts of one doc_id come in the order of their hashes; a null doc_id comes after all others; an empty table
gives an empty result.  What stays is cut at bytes, so it need not be valid
UTF-8: it is returned as binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphereframe.llm import repeats as R
from sphereframe.llm.common import materialize, table
from sphereframe.llm.minhash import mix

WINDOW, K = 100, 16
#: Bytes of a block; a minimizer's strings are never split over blocks, so CROWD bounds what it can exceed.
BLOCK, CROWD = 2_000_000, 4_096
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _reader():
    def of(text: str) -> tuple[bytes, np.ndarray]:
        raw = text.encode("utf-8", "replace")
        return raw, _BYTES[np.frombuffer(raw, np.uint8)]

    return of


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than its successor; the last is larger than the empty one."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int16), append=-1))
    turn = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(turn[::-1])[::-1]] > 0


def two_stage_sort(t: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in the order of their first depth bytes at least, and the 8-byte words at each place.

    Where wanted says which suffixes matter, of the others only those that induce them need be in the order.
    """
    n = len(t)
    padded = np.r_[t, np.zeros(depth + 16, np.uint8)]
    words = np.zeros(n + depth + 8, np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + len(words)]
    small = smaller_than_next(t)
    direct = np.flatnonzero(small)
    if wanted is not None:  # a larger suffix is induced, through larger ones, from the next smaller one
        source = np.searchsorted(direct, np.flatnonzero(wanted))
        direct = direct[np.bincount(source, minlength=len(direct) + 1)[: len(direct)] > 0]
    direct = direct[np.argsort(words[direct], kind="stable")]
    tie = np.r_[False, words[direct][1:] == words[direct][:-1]]  # equal so far to the one before
    for at in range(8, depth, 8):
        where = np.flatnonzero(tie | np.r_[tie[1:], False])
        if not len(where):
            break
        own, new = direct[where], ~tie[where]
        key, group = words[own + at], np.cumsum(new)
        unlike = np.r_[False, key[1:] != key[:-1]] & ~new
        if unlike.any():  # only groups that come apart are sorted; copies stay equal to the end
            apart = np.zeros(group[-1] + 1, bool)
            apart[group[unlike]] = True
            on = np.flatnonzero(apart[group])
            order = on[np.lexsort((key[on], group[on]))]
            own[on], key[on] = own[order], key[order]
            direct[where] = own
            new |= np.r_[False, key[1:] != key[:-1]]
        tie[where] = ~new
    return _induce(t, small, direct), words


def _induce(t: np.ndarray, small: np.ndarray, direct: np.ndarray) -> np.ndarray:
    """Scan the buckets of first bytes upwards; each placed suffix places its predecessor if that is larger than it."""
    n = len(t)
    ends = np.searchsorted(t[direct], np.arange(257))
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        larger[t[n - 1]].append(np.array([n - 1]))  # its successor is the empty suffix, before all others

    out = []

    def hand_on(placed: np.ndarray, c: int) -> None:
        before = placed[placed > 0] - 1
        before = before[~small[before]]
        first = t[before]
        up = before[first > c]
        kinds = t[up]
        order = np.argsort(kinds, kind="stable")
        up, kinds = up[order], kinds[order]
        for part in np.split(up, np.flatnonzero(kinds[1:] != kinds[:-1]) + 1):
            if len(part):
                larger[t[part[0]]].append(part)

    for c in range(256):
        waiting = larger[c]
        round_ = np.concatenate(waiting) if waiting else np.zeros(0, np.int64)
        runs = []
        while len(round_):  # within a bucket a run of one byte is induced step by step
            runs.append(round_)
            before = round_[round_ > 0] - 1
            round_ = before[~small[before] & (t[before] == c)]
        own = np.concatenate([*runs, direct[ends[c] : ends[c + 1]]]) if runs or ends[c] < ends[c + 1] else np.zeros(0, np.int64)
        if len(own):
            hand_on(own, c)
            out.append(own)
        larger[c] = []
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def equal_next(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """For neighbours in the order, whether their common prefix has depth bytes."""
    a, b = order[:-1], order[1:]
    alive = np.arange(len(a))
    for at in range(0, depth, 8):
        x, y = words[a[alive] + at], words[b[alive] + at]
        if (left := depth - at) < 8:
            x, y = x >> np.uint64(8 * (8 - left)), y >> np.uint64(8 * (8 - left))
        alive = alive[x == y]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def later_windows(parts: list[bytes], d: np.ndarray, h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(d, h, at) of the windows of the parts that also start at an earlier place, a part's at being that of its first."""
    t = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    part = np.repeat(np.arange(len(parts)), sizes)
    valid = np.arange(len(t)) + window <= (begin + sizes)[part]
    order, words = two_stage_sort(t, window, valid)
    order = order[valid[order]]
    same = equal_next(order, words, window)
    busy = np.r_[False, same] | np.r_[same, False]
    order, group = order[busy], np.cumsum(~np.r_[False, same])[busy]
    own_d, own_h, own_at = d[part[order]], h[part[order]], (at[part[order]] & ~np.int64(0xFF)) + ((order - begin[part[order]]) << 8) + 1
    late = R.later([group], [own_d, own_h, own_at], True)
    return own_d[late], own_h[late], own_at[late]


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs: d, h, text.  (d, h, at) of the windows that also start earlier."""
    found = materialize(R.scan(docs, _reader, window, K, within=True), release=True)
    texts = docs.select("d", "h", "text")
    few = found.where(f"not covered and crowd <= {CROWD}").withColumn("piece", F.struct("at", "go"))
    open_ = materialize(texts.join(R.by_document(few, "open", "piece"), ["d", "h"]).mapInArrow(_context(window), "mini bigint, d bigint, h bigint, at bigint, bytes binary"), release=True)
    crowded = texts.join(R.by_document(found.where(f"not covered and crowd > {CROWD}"), "open"), ["d", "h"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by minimizer; a block ends where a new one begins and it is full."""
        parts, d, h, at, size, last = [], [], [], [], 0, None

        def done() -> pa.RecordBatch:
            out = later_windows(parts, *(np.array(x, np.int64) for x in (d, h, at)), window)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["d", "h", "at"])

        for b in batches:
            for m, i, j, a, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if m != last and size >= BLOCK:
                    yield done()
                    parts, d, h, at, size = [], [], [], [], 0
                parts.append(x)
                d.append(i)
                h.append(j)
                at.append(a)
                size, last = size + len(x), m
        if parts:
            yield done()

    blocks = open_.repartition("mini").sortWithinPartitions("mini").mapInArrow(block, "d bigint, h bigint, at bigint")
    hashed = crowded.select("d", "h", "text", "open").mapInArrow(_edges(window), R.SPREAD)
    return found.where("covered").select("d", "h", "at").unionByName(materialize(blocks, release=True)).unionByName(materialize(R.settle(hashed, within=True), release=True))


def _context(window: int):
    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = b.column(3)
            n, at, mini = sets.value_lengths().to_numpy(), *(c.to_numpy() for c in sets.flatten().flatten())
            start, size = (at >> 8).tolist(), ((at & 0xFF) - 1 + window).tolist()
            raw, ends = (x.as_py().encode("utf-8", "replace") for x in b.column(2)), np.cumsum(n).tolist()
            parts = [x[s : s + k] for x, i, j in zip(raw, [0, *ends], ends) for s, k in zip(start[i:j], size[i:j], strict=True)]
            d, h = (np.repeat(b.column(i).to_numpy(), n) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (mini, d, h, at)), pa.array(parts, pa.binary())], ["mini", "d", "h", "at", "bytes"])

    return context


def _edges(window: int):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, n_held = _reader(), [], 0

        def done() -> pa.RecordBatch:
            return R.spread(held, True)

        for b in batches:
            for d, h, x, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                _, u = of(x.as_py())
                start, n = R.unpack(at.values.to_numpy())
                spans, first, _, mini, _ = R.pieces(u, window, K)
                own = mini[np.searchsorted(first, start, side="right") - 1]
                places = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                held.append((spans.of(places, window), np.repeat(own, n), np.full(len(places), d, np.int64), np.full(len(places), h, np.int64), (places << 8) + 1))
                n_held += len(places)
                if n_held >= R.HOLD:
                    yield done()
                    held, n_held = [], 0
        if held:
            yield done()

    return edges


def suffix_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs: doc_id, text.  doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept."""
    rows = R.keyed(docs)
    gone = R.by_document(repeated_windows(rows, window), "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for x, at in zip(b.column(1), b.column(2), strict=True):
                raw = x.as_py().encode("utf-8", "replace")
                kept, n_spans = raw, 0
                if at.is_valid and len(raw) >= window:
                    off = R.mark(len(raw), window, *R.unpack(at.values.to_numpy()))
                    kept = np.frombuffer(raw, np.uint8)[~off].tobytes()
                    n_spans = int((off & ~np.r_[False, off[:-1]]).sum())
                for col, v in zip(out, (len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(gone, ["d", "h"], "left").select("doc_id", "text", "gone").mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each whole text of documents (doc_id a number) repeats from an earlier place, in strings of 100 bytes.

    Null and empty texts have no bytes; very long texts are read whole; repeated rows get equal results; an empty table
    gives no rows.  Only doc_id and text are read, so other columns cannot clash.
    """
    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


#: The same rows in SQL, for tables with unique ids: removed spans are runs of late starts at most WINDOW apart.
OP7_SQL = f"""WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - {WINDOW - 2})) AS p FROM b WHERE octet_length(b) >= {WINDOW}),
windows AS (SELECT doc_id, p, md5(b[p : p + {WINDOW - 1}]) AS s FROM places),
late AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
marked AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM late),
runs AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS r FROM marked),
spans AS (SELECT doc_id, min(p) AS a, max(p) + {WINDOW - 1} AS z FROM runs GROUP BY doc_id, r),
gaps AS (SELECT doc_id, z + 1 AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS e FROM spans UNION ALL SELECT doc_id, 1 AS a, min(a) AS e FROM spans GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(hex(b[g.a : coalesce(g.e - 1, octet_length(b))]), '' ORDER BY g.a) AS k FROM gaps g JOIN b USING (doc_id) WHERE g.a <= coalesce(g.e - 1, octet_length(b)) GROUP BY g.doc_id),
counts AS (SELECT doc_id, count(*) AS n, CAST(sum(z - a + 1) AS BIGINT) AS removed FROM spans GROUP BY doc_id)
SELECT b.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(CASE WHEN n IS NULL THEN b ELSE unhex(coalesce(k, '')) END) AS kept_sha256
FROM b LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)"""
