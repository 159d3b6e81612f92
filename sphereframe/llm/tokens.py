"""Token counts by a two-tier lookup of pre-tokens.

A first pass over every text makes bounded heavy-hitter summaries of its pre-tokens, one a task; they are
merged in a tree into a table of at most FREQUENT pre-tokens, whose token counts are broadcast (a few
hundred KB, whatever the input).  The second pass adds up the counts of each text's pre-tokens: frequent
ones from the table, others through the worker's own cache, which encodes a pre-token when it first sees
it.  No pre-token occurrence is ever shuffled.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted one by one; an
empty table gives an empty result.  A text with a special token's string, or with characters on whose
classes regular-expression libraries may differ, goes to the library whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphereframe.llm.common import table

FREQUENT, SUMMARY, MERGERS = 16_384, 8_192, 16
#: Summaries that a task of the tree merges.
FAN = 64
#: Entries of a worker's cache, and the longest pre-token that it holds.
CACHE, CACHE_CHARS = 400_000, 64
LIMIT = 1024
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Beyond ASCII and Latin letters a whole text goes to the library.
UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ–—‘-”…]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(4)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(x.content for x in tokenizer(path).get_added_tokens_decoder().values())


class Cache(dict):
    """Values made when first asked for.  When full it becomes the older of two generations; long keys are never kept."""

    def __init__(self, make, first=()):
        super().__init__(first)
        self.make, self.first, self.old = make, dict(first), {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
                self.update(self.first)
            self[key] = value
        return value


def count_tokens(text: str, path: str, lengths: Cache) -> int:
    if UNUSUAL.search(text) or any(s in text for s in special_strings(path)):
        return len(tokenizer(path).encode(text, add_special_tokens=False).ids)
    return sum(map(lengths.__getitem__, _PRE.findall(text)))


_SUMMARY = "tokens array<string>, counts array<bigint>"


def _top(counts: Counter, n: int) -> list[tuple[str, int]]:
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]


def _row(counts: Counter) -> pa.RecordBatch:
    top = _top(counts, SUMMARY)
    return pa.RecordBatch.from_arrays([pa.array([[x for x, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["tokens", "counts"])


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for b in batches:
        for x in b.column(0):
            if text := x.as_py():
                counts.update(_PRE.findall(text))
                if len(counts) > 32 * SUMMARY:
                    counts = Counter(dict(_top(counts, 4 * SUMMARY)))
    yield _row(counts)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for b in batches:
        for tokens, n in zip(b.column(0), b.column(1), strict=True):
            for t, k in zip(tokens.as_py(), n.as_py(), strict=True):
                counts[t] += k
        if len(counts) > 32 * SUMMARY:
            counts = Counter(dict(_top(counts, 4 * SUMMARY)))
    yield _row(counts)


def frequent_pretokens(texts: DataFrame) -> list[str]:
    """At most FREQUENT pre-tokens of a one-column frame, by a tree of bounded summaries over all rows.

    The choice decides speed only: any table gives the same token counts.
    """
    merged, n = texts.mapInArrow(_summarise, _SUMMARY), texts.rdd.getNumPartitions()
    while n > MERGERS:
        n = max(MERGERS, -(-n // FAN))
        merged = merged.repartition(n).mapInArrow(_merge, _SUMMARY)
    counts: Counter = Counter()
    for r in merged.collect():  # at most MERGERS rows of SUMMARY entries
        for t, k in zip(r.tokens, r.counts, strict=True):
            counts[t] += k
    return [t for t, _ in _top(counts, FREQUENT)]


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    tok = tokenizer(path)
    frequent = {t: len(tok.encode(t, add_special_tokens=False).ids) for t in frequent_pretokens(rows.select("text")) if len(t) <= CACHE_CHARS}
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Cache(lambda t: len(tokenizer(path).encode(t, add_special_tokens=False).ids), shared.value)
        for b in batches:
            n = [count_tokens(x.as_py(), path, lengths) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text of documents.

    Null and empty texts have none; very long texts are counted whole; repeated rows are counted one by one; an empty table
    gives no rows.  Only doc_id and text are read, so other columns cannot clash.
    """
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
