"""Near-duplicates by MinHash with one permutation and optimal densification.

Texts with equal shingle sets form one node.  A node's signature is one-permutation hashing of its set into
BANDS * ROWS bins, empty bins filled by optimal densification; small sets, whose bins would mostly be
copies, get as many independent permutations instead (sets between the two limits get both, so that any two
sets within the threshold's size ratio share a kind).  A bucket gives star-shaped edges from one centre to
its members, never all pairs; edges are confirmed on full sets.  A bucket's centre is the member that shares
buckets with most others.  A failed edge does not end the search: where buckets still hold several components, their sets
are compared with those of other components that share one of their rarest shingles.  Hence no cap anywhere.

Defined results: null, empty and wordless texts have no shingles and link with nothing (a component of
their own); a text of fewer than two words has one shingle; equal rows are in one component; a null doc_id
orders last and shows as a null component only where nothing else is reachable; an empty table gives an
empty result.  A very long text is one large set like any other; its bins fill.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphereframe.llm.common import NULL_ID, few, fresh, materialize, table
from sphereframe.llm.graph import components
from sphereframe.llm.tokens import Cache

BANDS, ROWS, PERCENT = 32, 4, 80
BINS = BANDS * ROWS
#: Sets up to SMALL get independent permutations, sets from PERCENT of that on one-permutation bins.
SMALL = 96
#: Nodes of a component with one shingle that meet another's in one task when what the stars leave open is compared.
BLOCK = 2_000
#: Members of a bucket beyond which its rows are dealt to several tasks, and the least share of all rows for that: so no
#: more than 1 / SHARE buckets are dealt, and their keys can be broadcast.
CROWD, SHARE = 2_000, 2e-5
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (splitmix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_rng = np.random.default_rng(20)
_MASKS = _rng.integers(0, 1 << 63, BINS, dtype=np.uint64)
_SALTS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def shingles(text: str, hashes: Cache, size: int) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, _U(size))
    for i in range(size):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def one_permutation(s: np.ndarray) -> np.ndarray:
    """The least hash of each bin; an empty bin copies a random non-empty one, drawn by (bin, attempt)."""
    bins = (s >> _U(57)).astype(np.int64)
    least = np.full(BINS, _U(0))
    full = np.zeros(BINS, bool)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])  # s is sorted, so bins are, and the first is the least
    least[bins[first]], full[bins[first]] = s[first], True
    empty, attempt, source = np.flatnonzero(~full), 0, full.copy()
    while len(empty):
        attempt += 1
        pick = (mix((empty.astype(np.uint64) << _U(32)) | _U(attempt)) >> _U(57)).astype(np.int64)
        ok = source[pick]
        least[empty[ok]] = least[pick[ok]]
        empty = empty[~ok]
    return least


def band_keys(s: np.ndarray) -> np.ndarray:
    """The bucket keys of a non-empty set."""
    kinds = []
    if len(s) <= SMALL:
        kinds.append((mix(s[:, None] ^ _MASKS).min(0), _U(1)))
    if 100 * len(s) >= PERCENT * SMALL:
        kinds.append((one_permutation(s), _U(2)))
    out = []
    for signature, kind in kinds:
        key = _SALTS ^ kind
        for row in signature.reshape(BANDS, ROWS).T:
            key = mix(key * _U(0x9E3779B97F4A7C15) + row)
        out.append(key)
    return np.concatenate(out)


def word_cache() -> Cache:
    return Cache(xxhash.xxh3_64_intdigest)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """docs: doc_id, text.  doc_id, n_shingles, node (hash of the set, null for an empty one), keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_cache()
        for b in batches:
            sets = [shingles(x.as_py(), hashes, size) for x in b.column(1)]
            nodes = [int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())))) if len(s) else None for s in sets]
            keys = [band_keys(s) if len(s) else s for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), _lists(keys)], ["doc_id", "n_shingles", "node", "keys"])

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, node bigint, keys array<bigint>")


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the nodes (node, d), from the texts of their first documents."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_cache()
        for b in batches:
            sets = [shingles(x.as_py(), hashes, size) for x in b.column(0)]
            own = [int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())))) for s in sets]
            on = [i for i, (s, n) in enumerate(zip(own, b.column(1).to_pylist(), strict=True)) if s == n]
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(on, pa.int64())), _lists([sets[i] for i in on])], ["node", "shingles"])

    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    found = docs.select(ids.alias("d"), "text").join(few(nodes), "d").select("text", "node")
    return found.mapInArrow(take, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are within the threshold."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(right, "b").join(left, "a")
    near = joined.where(100 * F.least(F.size("x"), F.size("y")) >= PERCENT * F.greatest(F.size("x"), F.size("y")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (xs, x), (ys, y) = ((c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)) for c in b.columns[2:])
            on = []
            for i in range(b.num_rows):
                s, o = x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]]
                both = np.count_nonzero(s[np.minimum(np.searchsorted(s, o), len(s) - 1)] == o)  # sets are sorted
                if 100 * both >= PERCENT * (len(s) + len(o) - both):
                    on.append(i)
            yield b.select(["a", "b"]).take(pa.array(on, pa.int64()))

    return near.select("a", "b", "x", "y").mapInArrow(keep, "a bigint, b bigint")


def _pairs(stars: DataFrame) -> DataFrame:
    return stars.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _crowded(shared: DataFrame) -> DataFrame:
    """(key, parts) of the buckets (key, n) that one task should not hold; at most 1 / SHARE rows and parts."""
    least = max(CROWD, int(SHARE * (shared.agg(F.sum("n")).first()[0] or 0)))
    return F.broadcast(shared.where(F.col("n") > least).select("key", F.ceil(F.col("n") / least).cast("int").alias("parts")))


def _dealt(members: DataFrame, crowded: DataFrame) -> DataFrame:
    """members (key, node) with the part of its bucket that each is in."""
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).otherwise(0)
    return members.join(crowded, "key", "left").withColumn("part", part).drop("parts")


def _to_all(buckets: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rows of one bucket each, repeated for each of its parts."""
    return buckets.join(crowded, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def _unsettled(members: DataFrame, comps: DataFrame, crowded: DataFrame) -> DataFrame:
    """(key, node, comp) of the buckets with members of several components, two apart: their edge has been tested."""
    own = members.join(comps.select(F.col("id").alias("node"), "component"), "node", "left").select("key", "part", "node", F.coalesce("component", "node").alias("comp"))
    mixed = own.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("n")).where("x != y and n > 2").select("key")
    return own.join(_to_all(mixed, crowded), ["key", "part"], "left_semi").select("key", "part", "node", "comp")


def _heads(own: DataFrame) -> DataFrame:
    """(x, node, comp, n, left) of the rarest shingles x of own (node, comp, shingles); left: the set's shingles from x on.

    Sets are ordered by (sets of own that have it, shingle).  Of two sets within the threshold, the first shingle in common
    has at least the required intersection from itself on in both, so each set's first 100 - PERCENT of a hundred and one
    are enough.  Shingles of one set only come first and pair with nothing: they are left out.
    """
    every = own.select("node", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("x"))
    often = every.groupBy("x").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ranked = every.join(often, "x").groupBy("node", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("own"))
    ranked = ranked.select("node", "comp", "n", F.posexplode("own").alias("i", "s"), F.size("own").alias("m"))
    return ranked.select(F.col("s.x").alias("x"), "node", "comp", "n", (F.col("m") - F.col("i")).alias("left")).where(f"100 * left >= {PERCENT} * n")


def _settle(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components, of all the nodes of open_ (key, part, node, comp).

    Nodes of two components are compared if they share one of their rarest shingles, which loses no link: neither all that
    share a bucket nor all of a family of buckets, whose number grows with its square.  Nodes of one component never meet,
    and components of more than BLOCK nodes with one shingle meet in parts.
    """
    heads = materialize(_heads(open_.select("node", "comp").distinct().join(sets, "node")))
    # the intersection that the threshold asks for, of two nodes, or of any two of two components
    fits = lambda left1, left2, n1, n2: (100 + PERCENT) * F.least(left1, left2) >= PERCENT * (F.col(n1) + F.col(n2))
    comps = heads.groupBy("x", "comp").agg(F.max("left").alias("left"), F.min("n").alias("n"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    one, two = (comps.select("x", *[F.col(c).alias(f"{c}{i}") for c in ("comp", "left", "n", "parts")]) for i in (1, 2))
    part = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    meet = one.join(two, "x").where((F.col("comp1") < F.col("comp2")) & fits("left1", "left2", "n1", "n2"))
    meet = meet.select("x", "comp1", "comp2", part("parts1").alias("part1"), "parts2").select("x", "comp1", "comp2", "part1", part("parts2").alias("part2"))
    dealt = heads.join(comps.select("x", "comp", "parts"), ["x", "comp"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    one, two = (dealt.select("x", *[F.col(c).alias(f"{c}{i}") for c in ("comp", "part", "node", "left", "n")]) for i in (1, 2))
    met = meet.join(one, ["x", "comp1", "part1"]).join(two, ["x", "comp2", "part2"]).where(fits("left1", "left2", "n1", "n2"))
    return _confirm(materialize(met.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()), sets)


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """docs: doc_id, text.  doc_id, n_shingles, component_id, kept of every row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = materialize(signatures(docs, size))
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    nodes = materialize(signed.where("node is not null").groupBy("node").agg(F.min(d).alias("d"), F.first("keys").alias("keys")))
    members = nodes.select("node", F.explode("keys").alias("key")).select("key", "node")
    shared = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    crowded = _crowded(shared)
    members = materialize(_dealt(members, crowded).join(_to_all(shared, crowded), ["key", "part"]))
    # the member that meets most others, over all its buckets, is the likeliest to be near them all
    weight = members.groupBy("node").agg(F.sum("n").alias("w"))
    centres = members.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("w", "node")).alias("a"))
    members = members.select("key", "part", "node")
    tested = materialize(_pairs(members.join(_to_all(centres, crowded), ["key", "part"]).select("a", F.col("node").alias("b"))))
    needed = nodes.select("node", "d").join(members.select("node").distinct(), "node", "left_semi")
    sets = materialize(_sets(docs, needed, size))
    links = materialize(_confirm(tested, sets))
    comps = components(links)
    open_ = materialize(_unsettled(members, comps, crowded))
    if not open_.isEmpty():
        found = materialize(_settle(open_, sets))
        if not found.isEmpty():
            comps = components(links.unionByName(found))
    named = nodes.select("node", "d").join(comps.select(F.col("id").alias("node"), "component"), "node", "left").select("node", "d", F.coalesce("component", "node").alias("comp"))
    named = materialize(named)
    least = named.join(named.groupBy("comp").agg(F.min("d").alias("least")), "comp").select("node", "least")
    out = signed.select("doc_id", "n_shingles", "node").join(least, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id").cast("long")).otherwise(F.nullif("least", F.lit(NULL_ID)))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal sets of word pairs over all whole texts of documents.

    Null, empty and wordless texts link with nothing; very long texts are read whole; equal rows are in one component; an
    empty table gives no rows.  Only doc_id (a number) and text are read, so other columns cannot clash.
    """
    return near_duplicates(table(spark, sf_dir, "documents"), 2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity of 0.8) stays: that of the least doc_id.

    Rows go by a number that is stored with them, as a doc_id may be null or that of other texts as well.  Null, empty and
    wordless texts stay, each for itself; of repeated rows one stays; ties of doc_id go by the stored number; an empty table
    stays empty; columns of any names are kept.
    """
    own = fresh(docs, "_row")
    rows = materialize(docs.withColumn(own, F.monotonically_increasing_id()))
    groups = near_duplicates(rows.select(F.col(own).alias("doc_id"), "text"), 5).select("doc_id", "component_id")
    ids = rows.select(F.col(own).alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"))
    groups = materialize(groups.join(ids, "doc_id"))
    stays = groups.groupBy("component_id").agg(F.min(F.struct("d", "doc_id"))["doc_id"].alias("stays")).select("stays")
    gone = few(groups.select("doc_id").join(stays, F.col("doc_id") == F.col("stays"), "left_anti").select(F.col("doc_id").alias(own)))
    return rows.join(gone, own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same rows in SQL, for tables with unique ids.  Sets within the threshold share one of their rarest shingles, a fifth of them and one.
OP8_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM w),
copies AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS rep FROM s WHERE len(s) > 0),
reps AS (SELECT doc_id, s, len(s) AS n FROM s WHERE doc_id IN (SELECT rep FROM copies)),
single AS (SELECT doc_id, n, unnest(s) AS x FROM reps),
rare AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY c, x) AS r FROM single JOIN (SELECT x, count(*) AS c FROM single GROUP BY x) USING (x)),
heads AS (SELECT doc_id, n, x FROM rare WHERE r <= n - (8 * n + 9) // 10 + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM heads a JOIN heads b USING (x) WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
both_ AS (SELECT a, b, x.n + y.n AS n, len(list_intersect(x.s, y.s)) AS k FROM pairs JOIN reps x ON x.doc_id = a JOIN reps y ON y.doc_id = b),
links AS (SELECT a, b FROM both_ WHERE 100 * k >= 80 * (n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM reps UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
named AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least, s.doc_id) AS component_id, coalesce(least, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN copies USING (doc_id) LEFT JOIN named ON named.a = copies.rep"""
