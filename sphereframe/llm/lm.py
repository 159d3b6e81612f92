"""Log-probabilities by a weighted backoff automaton whose parts travel to the texts that need them.

Model: every n-gram of up to ORDER words of the training texts is a state, however rare, and an arc of the
state of its first words.  Arcs are smoothed by a Dirichlet prior on the next lower order, p(w | h) =
(c(hw) + m p(w | h')) / (c(h) + m); a state without an arc for w fails to h' at the weight m / (c(h) + m).  At the
root a word has (c + 1) / (N + V + 1), and an unknown word what is left.  So each state's probabilities add up to one,
and a weight needs no more than the exact counts of its own n-gram and state.

Texts are read once, in blocks of about BLOCK tokens.  A block sends the sorted 63-bit hashes of its distinct n-grams,
with their training counts, to ranges of hashes; a range adds up the counts of all blocks and answers each
block in the block's own order.  Both ways the lists are sorted, differenced and split into byte planes, so an n-gram
takes some six bytes instead of a row.  Ranges are pieces of a hash, so no word or context makes one of them hot.
The texts travel beside their n-grams as numbers of words, meet the answers, and are traversed from left to right.
No count, state or arc is ever dropped, capped or gathered on the driver.

Defined results: a null or empty text scores its end alone; a very long text makes a block of its own size, as a text
is read whole in any case; repeated rows are learned and scored one by one; ties do not arise; a null doc_id is not held
out; without training text only the unknown class has mass, so each token costs nothing; an empty table gives an
empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphereframe.llm.common import crc_mod, table

ORDER = 3
#: The prior's strength m, from order 2 on.
PRIOR = (30.0, 10.0)
#: The end of a text, as a token; no word can hold a line feed.
END = b"\n"
#: Tokens of a block, and ranges for each shuffle partition, so that their sizes even out.
BLOCK, RANGES = 3_000_000, 4
_U = np.uint64
#: Low bytes of differences that look random, and so are not worth compressing.
_RAW = 5


def words_of(text: str) -> list[bytes]:
    """The lower-case (A-Z only) words: bytes.split knows the same six white-space characters."""
    return text.encode("utf-8", "replace").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Numbers(dict):
    """Words by the order in which they are first seen."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _places(sizes: np.ndarray) -> np.ndarray:
    """Each token's place within its text."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def ngram_keys(words: list[bytes], ids: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, even hashes of the n-grams, and for each token whether one ends there."""
    h = _mix(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))[ids]
    place = np.minimum(_places(sizes), order).astype(np.uint8)
    key = h
    yield h & ~_U(1), place >= 0
    for k in range(2, order + 1):
        key = _mix(key[:-1] * _U(0x9E3779B97F4A7C15) + h[k - 1 :] + _U(k))
        ends = place >= k - 1
        yield key[ends[k - 1 :]] & ~_U(1), ends


def _distinct(key: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how often each is found where train is true; key is used up."""
    key |= train
    key.sort()
    first = np.flatnonzero(np.r_[True, (key[1:] ^ key[:-1]) > _U(1)]) if len(key) else np.zeros(0, np.int64)
    distinct = key[first] & ~_U(1)
    key &= _U(1)
    return distinct, np.add.reduceat(key, first).astype(np.uint32) if len(key) else np.zeros(0, np.uint32)


def ranks(key: np.ndarray) -> np.ndarray:
    """For each key its number among the sorted distinct ones.  Sorts heads of keys joined with places, which is fast."""
    if not len(key):
        return np.zeros(0, np.uint32)
    bits = _U(max(1, int(len(key) - 1).bit_length()))
    order = key >> bits << bits
    order |= np.arange(len(key), dtype=np.uint64)
    order.sort()
    order &= (_U(1) << bits) - _U(1)
    order = order.view(np.int64)
    s = key[order]
    if (wrong := s[1:] < s[:-1]).any():  # unlike keys with equal heads
        on = np.flatnonzero(np.isin(s >> bits, s[1:][wrong] >> bits))
        order[on] = order[on][np.argsort(s[on], kind="stable")]
        s = key[order]
    new = np.r_[False, s[1:] != s[:-1]]
    del s
    out = np.empty(len(key), np.uint32)
    out[order] = np.cumsum(new, dtype=np.uint32)
    return out


def _planes(x: np.ndarray, raw: int) -> tuple[int, bytes, bytes]:
    """How many bytes a number takes, the low raw ones plane by plane, and the rest."""
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    p = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width])
    return width, p[:raw].tobytes(), p[raw:].tobytes()


def _squeezed(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=9).compress(raw, asbytes=True) if raw else b""


def _restored(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, size, codec="zstd", asbytes=True) if size else b""


def pack(lists: list[np.ndarray], raw: list[int]) -> bytes:
    """Lists of numbers as bytes; of each number the low bytes up to raw are stored as they are, the rest compressed."""
    made = [_planes(x, r) for x, r in zip(lists, raw, strict=True)]
    head = np.array([len(lists), *[v for x, (w, _, _), r in zip(lists, made, raw, strict=True) for v in (len(x), w, r)]], "<i8")
    rest = b"".join(m[2] for m in made)
    return head.tobytes() + b"".join(m[1] for m in made) + _squeezed(rest)


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    head = np.frombuffer(blob, "<i8", 3 * n, 8).reshape(n, 3).tolist()
    at = 8 + 24 * n
    left = sum(size * max(0, width - raw) for size, width, raw in head)
    end = at + sum(size * min(width, raw) for size, width, raw in head)
    rest, k, out = _restored(blob[end:], left), 0, []
    for size, width, raw in head:
        x = np.zeros((8, size), np.uint8)
        low = min(width, raw)
        x[:low] = np.frombuffer(blob, np.uint8, low * size, at).reshape(low, size)
        x[low:width] = np.frombuffer(rest, np.uint8, (width - low) * size, k).reshape(width - low, size)
        at, k = at + low * size, k + (width - low) * size
        out.append(np.ascontiguousarray(x.T).view("<u8")[:, 0])
    return out


def _differences(x: np.ndarray) -> np.ndarray:
    """Of even numbers, halved."""
    return np.diff(x, prepend=_U(0)) >> _U(1)


def smoothed(count: np.ndarray, state: np.ndarray, lower: np.ndarray, prior: float) -> np.ndarray:
    """log10 of an arc's probability, or of the failure arc and what follows it (lower) where the state has no such arc."""
    out = np.where(count > 0, np.log10(count + prior * 10.0**lower), np.log10(prior) + lower)
    out -= np.log10(state + prior)
    return out


def traverse(counts: Iterable[np.ndarray], sizes: np.ndarray, n: int, v: int, prior: tuple[float, ...] = PRIOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the known tokens, the base score and the automaton's, over its tokens from left to right.

    For each order, counts has each token's training count of the words that it ends, 0 where the text has not so many.
    The state before a token is that of the words before it, so its count is that of the token before; states that
    training has not seen cost nothing to leave, as m / (0 + m) is one.
    """
    place = np.minimum(_places(sizes), 255).astype(np.uint8)
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    for k, own in enumerate(counts):
        if not k:
            weight = np.log10((own + 1.0) / (n + v + 1.0))
            known, base = (np.bincount(text, x, len(sizes)) for x in (own > 0, weight))
        else:
            for i in range(0, len(own), 1 << 18):  # in parts, for the sake of memory
                on = np.flatnonzero(place[i : i + (1 << 18)] >= k) + i
                weight[on] = smoothed(own[on], last[on - 1], weight[on], prior[k - 1])
        last = own
    return known.astype(np.int64), base, np.bincount(text, weight, len(sizes))


def _ranges(docs: DataFrame) -> int:
    return RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _asks(n: int, order: int):
    """Rows to ranges 0 to n - 1 (what of its n-grams a block asks for), and the block itself beyond them."""
    bounds = np.array([(i << 64) // n for i in range(n)], np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = block = TaskContext.get().partitionId() << 24
        numbers, tokens, sizes, docs, train = _Numbers(), array("I"), [], [], []

        def done() -> pa.RecordBatch:
            ids, size, seen = np.frombuffer(tokens, np.uint32), np.array(sizes), np.array(train, bool)
            words = list(numbers)
            known = np.repeat(seen, size)
            lists = [_distinct(key, known[ends]) for key, ends in ngram_keys(words, ids, size, order)]
            cuts = [np.r_[np.searchsorted(k, bounds), len(k)] for k, _ in lists]
            blobs = []
            for i in range(n):
                part = [(k[c[i] : c[i + 1]], x[c[i] : c[i + 1]]) for (k, x), c in zip(lists, cuts, strict=True)]
                blobs.append(pack([y for k, x in part for y in (_differences(k), x)], [_RAW, 0] * order))
            often = np.bincount(ids, minlength=len(words)).tolist()
            common = sorted(range(len(words)), key=lambda i: (-often[i], words[i]))  # small numbers for frequent words, like ones together
            rank = np.empty(len(words), np.uint64)
            rank[common] = np.arange(len(words), dtype=np.uint64)
            text = b" ".join([words[i] for i in common])
            body = pack([rank[ids], size.astype(np.uint64), np.array([len(text)], np.uint64)], [0, 0, 0])
            own = pa.concat_arrays(docs)
            rows = pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(own)], pa.int32()), own, mask=pa.array([True] * n + [False]))
            blobs.append(np.int64(len(body)).tobytes() + body + _squeezed(text))
            to = np.r_[np.arange(n), n + block]
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(np.full(n + 1, block), pa.int64()), pa.array(blobs, pa.binary()), rows], ["r", "block", "blob", "docs"])

        for b in batches:
            kept = 0
            for i, x in enumerate(b.column(1)):
                w = words_of(x.as_py())
                tokens.extend(map(numbers.__getitem__, w))
                tokens.append(numbers[END])
                sizes.append(len(w) + 1)
                train.append(not b.column(2)[i].as_py())
                if len(tokens) >= BLOCK:
                    docs.append(_docs(b, kept, i + 1))
                    yield done()
                    block, kept = block + 1, i + 1
                    numbers, tokens, sizes, docs, train = _Numbers(), array("I"), [], [], []
            if b.num_rows > kept:
                docs.append(_docs(b, kept, b.num_rows))
        if sizes:
            yield done()
        assert block - first < 1 << 24

    return ask


def _docs(b: pa.RecordBatch, start: int, end: int) -> pa.Array:
    return pa.StructArray.from_arrays([b.column(i).slice(start, end - start) for i in (0, 2)], ["doc_id", "held_out"])


def _answer(key: tuple, rows: pa.Table) -> pa.Table:
    """What a range knows of each block's n-grams; blocks pass as they are."""
    if rows.num_rows == 1 and rows.column("docs")[0].is_valid:
        return rows
    lists = [unpack(x.as_py()) for x in rows.column("blob")]
    answers: list[list[np.ndarray]] = [[] for _ in lists]
    sums = np.zeros(2, np.uint64)
    for k in range(0, len(lists[0]), 2):
        own = [np.cumsum(x[k] << _U(1), dtype=np.uint64) for x in lists]
        every = np.sort(np.concatenate(own))
        every = every[np.r_[True, every[1:] != every[:-1]]] if len(every) else every
        at = [np.searchsorted(every, x) for x in own]
        total = np.zeros(len(every), np.uint64)
        for a, x in zip(at, lists, strict=True):
            total[a] += x[k + 1]  # a block has each key once
        if not k:
            sums[:] = total.sum(), (total > 0).sum()
        for a, out in zip(at, answers, strict=True):
            out.append(total[a])
    blobs = [pack([*x, sums], [0] * (len(x) + 1)) for x in answers]
    return rows.set_column(rows.schema.get_field_index("blob"), "blob", pa.array(blobs, pa.binary()))


def _scores(order: int, prior: tuple[float, ...]):
    def score(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("r")  # the ranges in the order of hashes, then the block itself
        blobs = rows.column("blob")
        lists = [unpack(x.as_py()) for x in blobs.slice(0, len(blobs) - 1)]
        last = blobs[-1].as_py()
        end = 8 + int(np.frombuffer(last, "<i8", 1)[0])
        ids, sizes, (length,) = unpack(last[8:end])
        words = _restored(last[end:], int(length)).split(b" ")
        ids, sizes = ids.astype(np.uint32), sizes.astype(np.int64)
        n, v = (int(sum(x[order][i] for x in lists)) for i in (0, 1))

        def counts() -> Iterator[np.ndarray]:
            for k, (key, ends) in enumerate(ngram_keys(words, ids, sizes, order)):
                own = np.zeros(len(ids))
                own[ends] = np.concatenate([x[k] for x in lists])[ranks(key)]
                yield own

        known, base, weight = traverse(counts(), sizes, n, v, prior)
        docs = rows.column("docs").combine_chunks().flatten()
        cols = [docs.field("doc_id"), docs.field("held_out"), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), n)), pa.array(base), pa.array(weight)]
        return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def score(docs: DataFrame, held_out, order: int = ORDER, prior: tuple[float, ...] = PRIOR) -> DataFrame:
    """docs: doc_id and text; held_out: a condition on doc_id; learning uses the rows where it is false."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    passed = f"r bigint, block bigint, blob binary, docs array<struct<doc_id: {kind}, held_out: boolean>>"
    asked = rows.mapInArrow(_asks(_ranges(docs), order), passed)
    answered = asked.groupBy("r").applyInArrow(_answer, passed)
    return answered.groupBy("block").applyInArrow(_scores(order, prior), f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op4_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of documents by n-grams of those with crc32(doc_id as text) mod 7 not 2.

    Null and empty texts score their end alone; very long texts are read whole; repeated rows count each; an empty table
    gives no rows.  Columns besides doc_id and text are not read, so their names cannot clash.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, crc_mod(F.col("doc_id"), 7) == 2)
