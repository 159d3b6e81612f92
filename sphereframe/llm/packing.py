"""Best-fit packing of token sequences by exact-complement hashing.

Documents are encoded and cut where they stand; only the histogram of piece lengths (at most CAP numbers)
comes to the driver.  There lengths are taken from the longest down: an index of available single, pair and
triple sums gives combinations that fill the rest of a sequence exactly, and as many sequences as the
counts allow are made of each at once; what is left is packed best-fit.  Pieces of over half a sequence can have no
other such piece beside them and need the short ones most, so they take their exact complements (single ones) and their
best fits first; singles, pairs and triples then fill sequences exactly from the rest.  The result is a list of patterns
with counts, so pieces find their places by their rank among the pieces of their length: a rank within a
task, plus the count of that length in earlier tasks.  No global sort, no hot length.

Defined results: a null or empty text gives one piece, the closing id alone; a very long text is cut into as many pieces as
it needs; pieces of one length are alike, and their ranks settle ties; repeated rows are packed one by one; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sphereframe.llm.common import materialize, table
from sphereframe.llm.tokens import UNUSUAL, Cache, special_strings, tokenizer, vocabulary_path

CAP = 2048
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _id_bytes(text: str, path: str) -> bytes:
    return np.asarray(tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_letters() -> dict[int, str]:
    """The printable letters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def chunk_cache(path: str) -> Cache:
    """Ids of the lower-case chunks between white space, made of the ids of their pre-tokens."""
    model = tokenizer(path).model

    def word(t: str) -> bytes:
        return np.asarray([x.id for x in model.tokenize(t.encode().decode("latin-1").translate(_LETTERS))], "<u4").tobytes()

    words = Cache(word)
    return Cache(lambda chunk: b"".join(map(words.__getitem__, _WORDS.findall(chunk))))


def encode_ids(text: str, path: str, chunks: Cache) -> bytes:
    """The text's ids as little-endian 32-bit numbers, closed by id 0."""
    if UNUSUAL.search(text) or any(s in text for s in special_strings(path)):
        return _id_bytes(text, path) + bytes(4)
    return b"".join(map(chunks.__getitem__, text.lower().split())) + bytes(4)


class Solver:
    """Fills sequences of cap from counts of lengths; patterns is a list of (lengths, how many)."""

    def __init__(self, counts: dict[int, int], cap: int):
        self.cap, self.patterns = cap, []
        self.count = np.zeros(cap + 1, np.int64)
        for length, n in counts.items():
            self.count[length] += n
        self.opened: dict[int, list[list]] = {}  # gap -> [lengths, how many]
        self.gaps = np.zeros(cap + 1, np.int64)
        half = cap // 2
        self._exactly(range(cap, half, -1), 1)
        for length in range(cap, half, -1):
            self._put((length,), int(self.count[length]))
            self.count[length] = 0
        self._best_fit(half, False)
        for depth in (1, 2, 3):
            self._exactly(range(half, 0, -1), depth)
        self._best_fit(half, True)
        self.patterns += [(lengths, n) for group in self.opened.values() for lengths, n in group]

    def _exactly(self, lengths: range, depth: int) -> None:
        """Consume combinations of a length and up to depth others that fill a sequence."""
        self._pair_sums()
        for length in lengths:
            while self.count[length] > 0:
                self.count[length] -= 1
                rest = self._complement(self.cap - length, depth)
                self.count[length] += 1
                if rest is None:
                    break
                need = Counter((length, *rest))
                n = min(int(self.count[x]) // k for x, k in need.items())
                for x, k in need.items():
                    self.count[x] -= n * k
                self.patterns.append(((length, *rest), n))

    def _pair_sums(self) -> None:
        """The index of sums of two available lengths; later it can only name too many."""
        free = (self.count > 0).astype(float)
        self.pairs, self.stale = np.convolve(free, free)[: self.cap + 1] > 0.5, 0

    def _pair(self, gap: int) -> tuple[int, int] | None:
        if gap < 2 or not self.pairs[gap]:
            return None
        long = np.arange(gap - 1, (gap - 1) // 2, -1)
        fit = np.flatnonzero((self.count[long] > 0) & (self.count[gap - long] > (long == gap - long)))
        return (int(long[fit[0]]), int(gap - long[fit[0]])) if len(fit) else None

    def _complement(self, gap: int, depth: int) -> tuple[int, ...] | None:
        if not gap:
            return ()
        if self.count[gap] > 0:
            return (gap,)
        if depth > 1 and (pair := self._pair(gap)):
            return pair
        if depth < 3:
            return None
        tried = 0
        long = np.arange(gap - 2, 0, -1)
        for x in long[(self.count[long] > 0) & self.pairs[gap - long]]:
            self.count[x] -= 1
            pair = self._pair(gap - int(x))
            self.count[x] += 1
            if pair:
                return (int(x), *pair)
            tried += 1
            if tried % 64 == 0:
                self._pair_sums()
        return None

    def _put(self, lengths: tuple[int, ...], n: int) -> None:
        gap = self.cap - sum(lengths)
        if n and gap:
            self.opened.setdefault(gap, []).append([lengths, n])
            self.gaps[gap] += 1
        elif n:
            self.patterns.append((lengths, n))

    def _best_fit(self, top: int, fresh: bool) -> None:
        """Lengths from top down go where they leave least; what fits nowhere opens sequences if fresh, or stays."""
        for length in range(top, 0, -1):
            left = int(self.count[length])
            while left:
                fit = np.flatnonzero(self.gaps[length:])
                if not len(fit):
                    break
                gap = length + int(fit[0])
                lengths, n = self.opened[gap].pop()
                self.gaps[gap] -= 1
                each = min(gap // length, left)
                take = min(n, left // each)
                left -= take * each
                self._put(lengths, n - take)
                self._put((*lengths, *[length] * each), take)
            if fresh:
                each = self.cap // length
                self._put((length,) * each, left // each)
                self._put((length,) * (left % each), 1 if left % each else 0)
                left = 0
            self.count[length] = left


def solve(counts: dict[int, int], cap: int) -> list[tuple[tuple[int, ...], int]]:
    return Solver(counts, cap).patterns


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, first sequence, offset), by rank."""
    made: dict[int, list] = {}
    at: Counter = Counter()
    first = 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            made.setdefault(x, []).append((at[x], first, offset))
            at[x] += n
            offset += x
        first += n
    return {k: np.array(v, np.int64) for k, v in made.items()}


_PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint, _chunk int, _rank bigint"


def pieces_of(docs: DataFrame, path: str, cap: int, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, rank, chunk = chunk_cache(path), Counter(), TaskContext.get().partitionId()
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            where = []
            for i, x in enumerate(b.column(1)):
                ids = encode_ids(x.as_py(), path, cache)
                for piece, start in enumerate(range(0, len(ids), 4 * cap)):
                    part = ids[start : start + 4 * cap]
                    length = len(part) // 4
                    for col, v in zip(out, (piece, start // 4, length, zlib.crc32(part), chunk, rank[length]), strict=True):
                        col.append(v)
                    rank[length] += 1
                    where.append(i)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(where, pa.int64())), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], ["doc_id", *[x.split()[0] for x in _PIECES.split(", ")]])

    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_PIECES}")


def pack(docs: DataFrame, path: str, cap: int = CAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = materialize(pieces_of(docs, path, cap, doc_id, text))
    counts = materialize(pieces.groupBy("_chunk", "length").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most cap rows
    places = docs.sparkSession.sparkContext.broadcast(slots(solve(histogram, cap)))
    earlier = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_chunk", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = pieces.join(before, ["_chunk", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                of, s = length == x, places.value[int(x)]
                k = np.searchsorted(s[:, 0], rank[of], side="right") - 1
                sequence[of], offset[of] = s[k, 1] + rank[of] - s[k, 0], s[k, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most CAP tokens.

    Null and empty texts are the closing id alone; very long texts are cut into pieces; repeated rows are packed one by one; an
    empty table gives no rows.  Only doc_id and text are read, so other columns cannot clash.
    """
    return pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: the pieces of all documents with their places.

    Null, empty and very long texts, repeated rows and empty tables as in op6; other columns are not read.
    """
    return pack(docs, vocabulary_path("word_bpe_49k.json"))
