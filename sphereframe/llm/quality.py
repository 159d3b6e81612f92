"""Quality scores by Bradley-Terry ranking.

Preference pairs (a document labelled good over one labelled bad) give a logistic loss on the difference of
their features; its minimiser is one weight a feature, so a document's score needs no partner.  The score is
turned into a probability around a threshold: the quantile of the training scores that leaves below it the
labelled share of bad documents.  Features are counts of the surface (lengths, classes of characters, repetition) and
hashed frequencies of words and of byte trigrams, BUCKETS of each, so what words and spellings tell is learned too.

Fitting reads at most MAX_LABELLED labelled documents, chosen by a hash of their id; scoring reads every text
whole.  Defined results: null and empty texts get the score of an empty text; a very long text is read whole; a repeated
row is scored like its copy, and of several labels of one id the best counts; a null doc_id counts as not held out and has
no label; without labels of both kinds every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphereframe.llm.common import crc_mod, table
from sphereframe.llm.tokens import Cache

MAX_LABELLED, PAIRS, L2, SEED = 20_000, 20_000, 1e-2, 17
BUCKETS, STEPS = 256, 400
_UPPER, _LOWER = regex.compile(r"\p{Lu}+"), regex.compile(r"\p{Ll}+")
FEATURES = ("log_words", "mean_word", "upper", "digits", "symbols", "marks", "pipes", "dup_lines", "distinct_words", "repeat_pairs", "long_words", "short_words", "log_line", "compress")


N_FEATURES = len(FEATURES) + 2 * BUCKETS


def _chars(pattern: regex.Pattern, text: str) -> int:
    return sum(map(len, pattern.findall(text)))


def features(text: str, hashes: Cache) -> np.ndarray:
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, bytes_in = len(words), max(1, sum(map(len, words)))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, int)
    count = lambda chars: int(seen[list(chars)].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    pairs = max(1, n - 1)
    ascii_upper = int(seen[65:91].sum())
    upper = ascii_upper + (_chars(_UPPER, text) - ascii_upper if len(raw) != len(text) else 0)
    bytes_ = np.frombuffer(raw, np.uint8).astype(np.uint32)
    trigrams = (bytes_[:-2] * 0x9E3779B1 + bytes_[1:-1] * 0x85EBCA6B + bytes_[2:] * 0xC2B2AE35) >> 24 if len(raw) > 2 else np.zeros(0, np.uint32)
    hashed = [np.sqrt(np.bincount(h, minlength=BUCKETS) / max(1, len(h))) for h in (np.fromiter(map(hashes.__getitem__, words), np.int64, n), trigrams)]
    return np.concatenate([[
        np.log1p(n), bytes_in / max(1, n), upper / bytes_in, count(b"0123456789") / bytes_in, count(b"#*$%&<>") / bytes_in, count(b"!?@=_~^\\") / bytes_in, count(b"|") / bytes_in,
        1 - len(set(lines)) / len(lines) if lines else 0.0, len(set(words)) / max(1, n), 1 - len(set(zip(words, words[1:]))) / pairs if n > 1 else 0.0,
        float((lengths > 12).mean()) if n else 0.0, float((lengths < 4).mean()) if n else 0.0, np.log1p(len(raw) / max(1, len(lines))), len(zlib.compress(raw, 1)) / max(1, len(raw)),
    ], *hashed])


class Ranker:
    """Weights of the standardised features, and the threshold on their sum."""

    def __init__(self, x: np.ndarray, good: np.ndarray):
        size = x.shape[1]
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(size), np.ones(size))
        self.weights, self.threshold = np.zeros(size), 0.0
        if not len(x) or good.all() or not good.any():
            return
        z = self._standard(x)
        rng = np.random.default_rng(SEED)
        d = z[rng.choice(np.flatnonzero(good), PAIRS)] - z[rng.choice(np.flatnonzero(~good), PAIRS)]
        step = 1 / (np.linalg.norm(d.T @ d / len(d), 2) / 4 + L2)  # of the mean logistic loss of the differences
        ahead, t = self.weights, 1.0
        for _ in range(STEPS):  # accelerated gradient descent
            gradient = L2 * ahead - d.T @ (1 / (1 + np.exp(np.clip(d @ ahead, -500, 500)))) / len(d)
            last, self.weights = self.weights, ahead - step * gradient
            t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            ahead = self.weights + (before - 1) / t * (self.weights - last)
            if np.abs(gradient).max() < 1e-6:
                break
        scores = z @ self.weights
        self.threshold = float(np.quantile(scores, float((~good).mean())))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.threshold - self._standard(x) @ self.weights, -500, 500)))


def _hashes() -> Cache:
    return Cache(lambda w: xxhash.xxh3_64_intdigest(w) % BUCKETS)


def fit(docs: DataFrame, labels: DataFrame, training) -> Ranker:
    """docs: doc_id, text; labels: doc_id, quality; training: a condition on doc_id."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & training).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(x.as_py(), hashes).astype("<f4").tobytes() for x in b.column(0)], pa.binary()), b.column(1)], ["x", "quality"])

    # MAX_LABELLED ids and labels: bounded, whatever the tables hold; of rows with one id those that come first by their text
    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", F.col("quality").cast("int").alias("quality"), F.xxhash64("text").alias("h"))
    rows = rows.orderBy("h", "quality").limit(MAX_LABELLED).select("text", "quality").mapInArrow(extract, "x binary, quality int").collect()
    x = np.frombuffer(b"".join(r.x for r in rows), "<f4").reshape(len(rows), N_FEATURES).astype(float)
    return Ranker(x, np.array([r.quality > 0 for r in rows], bool))


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """docs has doc_id, text and held_out."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes()
        for b in batches:
            x = np.zeros((b.num_rows, N_FEATURES), np.float32)
            for i, t in enumerate(b.column(1)):
                x[i] = features(t.as_py(), hashes)
            p = np.concatenate([ranker.score(x[i : i + 1000]) for i in range(0, max(1, len(x)), 1000)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held_out").mapInArrow(apply, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of documents, learned from labels with crc32(doc_id as text) mod 3 not 1.

    Null and empty texts are scored as empty; very long texts are read whole; repeated rows get equal scores; an empty
    table gives no rows.  Only doc_id and text are read, so other columns cannot clash.
    """
    out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), out.alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return score(docs, fit(docs, labels, ~out))
