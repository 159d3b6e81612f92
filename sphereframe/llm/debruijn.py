"""Substring deduplication on words by a compacted de Bruijn graph.

Edges are the windows of WINDOW words, between their first and last WINDOW-1 words.  The nonbranching paths
that share a minimizer are compacted to one node each, named by its minimizer and its content; the copies of
a path collapse when the paths are joined by those names, and only paths that meet others under a minimizer
are opened again into edges, which are joined by their hashes.  Places in the sources (document, word) decide which
occurrence is the first, and the spans that the covered edges make are cut out of the texts themselves.

Windows are compared by two 64-bit hashes, of the window and of its minimizer.  Defined results: a null or empty text
has no words; a very long text is read whole; rows of one doc_id do not cover each other; a null doc_id comes after all
others; an empty table gives an empty result.
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
from sphereframe.llm.minhash import word_cache

WINDOW, K = 13, 4


def _reader():
    hashes = word_cache()

    def of(text: str) -> tuple[bytes, np.ndarray]:
        raw = text.encode("utf-8", "replace")
        words = raw.split()
        return raw, np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))

    return of


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs: d, h, text.  (d, h, at) of the windows that also start in a document of smaller d."""
    found = materialize(R.scan(docs, _reader, window, K, within=False).drop("go"))
    open_ = docs.select("d", "h", "text").join(R.by_document(found.where("not covered"), "open"), ["d", "h"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, n_held = _reader(), [], 0
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
                    yield R.spread(held, False)
                    held, n_held = [], 0
        if held:  # edges go by their own hash, so a crowded minimizer's spread
            yield R.spread(held, False)

    opened = open_.select("d", "h", "text", "open").mapInArrow(edges, R.SPREAD)
    return found.where("covered").select("d", "h", "at").unionByName(materialize(R.settle(opened, within=False)))


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs: doc_id, text.  doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined)."""
    rows = R.keyed(docs)
    gone = R.by_document(repeated_windows(rows, window), "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for x, at in zip(b.column(1), b.column(2), strict=True):
                raw = x.as_py().encode("utf-8", "replace")
                words = raw.split()
                if at.is_valid and len(words) >= window:
                    off = R.mark(len(words), window, *R.unpack(at.values.to_numpy()))
                    kept = [w for w, o in zip(words, off.tolist(), strict=True) if not o]
                else:
                    kept = words
                joined = b" ".join(kept)
                for col, v in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c if k != kinds[3] or i < 3 else [v.decode() for v in c], k) for i, (c, k) in enumerate(zip(out, kinds, strict=True))]], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(gone, ["d", "h"], "left").select("doc_id", "text", "gone").mapInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each whole text of documents repeats from a smaller doc_id (a number), in windows of 13 words.

    Null and empty texts have no words; very long texts are read whole; repeated rows get equal results; an empty table
    gives no rows.  Only doc_id and text are read, so other columns cannot clash.
    """
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


#: The same rows in SQL, for tables with unique ids.
OP3_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM w WHERE len(w) >= 13),
windows AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS s FROM places),
firsts AS (SELECT s, min(doc_id) AS f FROM windows GROUP BY s),
late AS (SELECT doc_id, p FROM windows JOIN firsts USING (s) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, p + unnest(range(13)) AS i FROM late),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
