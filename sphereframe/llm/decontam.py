"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

Texts are tokens: runs of letters and digits, A-Z lowered; of scripts without spaces each character is one.  At every
place of a text each fixed mask hashes the tokens that it selects, so substitutions at ignored places do not change
the hash.  Test hashes and training hashes are joined; each hit aligns an item with a document, and of each distinct
alignment the tokens around the hit are compared: it counts where some SPAN tokens in a row (the whole item if that is
shorter) agree in PERCENT of the places or more.

The masks lose nothing: whichever places the rule lets differ, one of them selects none (a test enumerates this).  Up
to two of ten to thirteen tokens may differ, and LONG holds for all of these; one of five to nine, and none of four,
for which SHORT holds.  An item of fewer tokens than LEAST is no evidence of a leak and is not looked for.

The test side is broadcast only after a check of its rows and bytes; beyond BROADCAST or BROADCAST_BYTES it
is a shuffled join, of seeds first and of the texts that were hit after that.  Defined results: null or empty texts hit
nothing; a very long text is searched whole; equal rows give one result for a doc_id and item, and of several alignments
of a document with an item the best counts; a null doc_id is reported as null; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sphereframe.llm.common import ascii_lower, few, fresh, let, table

#: Selected places of items of LONG_ITEM tokens and more, and of shorter ones; the first place is always 0.
LONG = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 5, 6, 7), (0, 1, 3, 4, 7, 8), (0, 1, 2, 3, 5, 7), (0, 2, 4, 5, 6, 7))
SHORT = ((0, 1, 3), (0, 2, 3))
LEAST, LONG_ITEM = 4, 10
SPAN, PERCENT = 13, 80
BROADCAST, BROADCAST_BYTES = 2_000_000, 64 << 20
TOKEN = r"[\p{L}\p{N}]+"
#: Scripts that are written without spaces.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")


def _tokens(text: Column) -> Column:
    apart = "[" + "".join(rf"\p{{Is{x}}}" for x in UNSPACED) + "]"
    low = ascii_lower(F.coalesce(text, F.lit("")))
    spaced = F.when(low.rlike(apart), F.regexp_replace(low, f"({apart})", " $1 ")).otherwise(low)
    return F.transform(F.regexp_extract_all(spaced, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def _seeds(df: DataFrame, keep: list[str], masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """One row for each place and mask that fits; df has the token hashes as t."""
    least = min(m[-1] for m in masks) + 1
    at = df.select(*keep, "t", F.explode(F.when(F.size("t") >= least, F.sequence(F.lit(0), F.size("t") - least))).alias("p"))
    t, p = F.col("t"), F.col("p")
    seeds = [F.when(p + m[-1] < F.size("t"), F.xxhash64(F.lit(repr(m)), *[F.get(t, p + j) for j in m])) for m in masks]
    return at.select(*keep, "t", "p", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs: doc_id, text; items: item_id, text.  doc_id, item_id and n_equal: agreeing tokens of the best SPAN."""
    tests = items.select("item_id", _tokens(F.col("text")).alias("t")).where(F.size("t") >= LEAST).groupBy("t").agg(F.collect_set("item_id").alias("item_ids"))
    tests = tests.withColumn("test", F.struct(F.xxhash64("t"), F.xxhash64(F.lit(1), "t")))
    long, short = tests.where(F.size("t") >= LONG_ITEM), tests.where(F.size("t") < LONG_ITEM)
    probe = _seeds(long, ["test", "item_ids"], LONG).unionByName(_seeds(short, ["test", "item_ids"], SHORT))
    probe = probe.select("seed", F.col("p").alias("ip"), F.col("t").alias("it"), "test", "item_ids")
    ids = F.aggregate("item_ids", F.lit(0).cast("long"), lambda a, x: a + 8 + F.octet_length(x.cast("string")))
    found = probe.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(80 + 8 * F.size("it") + ids), F.lit(0)).alias("size"), F.count_if(F.size("it") < LONG_ITEM).alias("short")).first()
    masks = LONG + (SHORT if found.short else ())
    shift, n = F.col("p") - F.col("ip"), F.size("it")
    tokens = _tokens(F.col("text")).alias("t")
    if found.n <= BROADCAST and found.size <= BROADCAST_BYTES:  # the slices are cut where the join finds a hit, so no row ever carries a document's tokens
        own = docs.select(F.col("doc_id").alias("own"), tokens)
        hits = _seeds(own, ["own"], masks).join(F.broadcast(probe), "seed").withColumn("shift", shift)
    else:  # texts go by two hashes, so that copies and rows of one doc_id are compared once
        own = docs.select(F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).alias("own"), "doc_id", tokens)
        met = _seeds(own, ["own"], masks).select("own", "p", "seed").join(probe.select("seed", "ip", "test"), "seed").select("own", "test", shift.alias("shift")).distinct()
        texts = own.join(met.select("own").distinct(), "own", "left_semi").groupBy("own").agg(F.first("t").alias("t"))
        hits = met.join(texts, "own").join(tests.select("test", F.col("t").alias("it"), "item_ids"), "test")
    skip, start = F.greatest(-F.col("shift"), F.lit(0)), F.greatest("shift", F.lit(0))
    length = F.least(n - skip, F.size("t") - start)
    cut = hits.select("own", "test", "item_ids", "shift", n.alias("size"), F.slice("t", start + 1, length).alias("x"), F.slice("it", skip + 1, length).alias("y"))
    # grouped by hashes: the comparison below, which is not compiled, then stays above the join
    aligned = cut.groupBy("own", "test", "shift", F.xxhash64("x").alias("hx"), "size").agg(*[F.first(c).alias(c) for c in ("item_ids", "x", "y")])
    aligned = aligned.select("own", "item_ids", "size", F.zip_with("x", "y", lambda a, b: (a == b).cast("int")).alias("same"))
    span = F.least("size", F.lit(SPAN))
    best = let(F.col("same"), lambda s: F.array_max(F.transform(F.sequence(F.lit(0), F.size(s) - span), lambda i: F.aggregate(F.slice(s, i + 1, span), F.lit(0), lambda a, x: a + x))))
    scored = aligned.where(F.size("same") >= span).select("own", "item_ids", span.alias("span"), best.alias("n_equal")).where(100 * F.col("n_equal") >= PERCENT * F.col("span"))
    out = scored.select("own", F.explode("item_ids").alias("item_id"), "n_equal").groupBy("own", "item_id").agg(F.max("n_equal").cast("long").alias("n_equal"))
    if "doc_id" not in own.columns:
        return out.withColumnRenamed("own", "doc_id")
    return out.join(own.select("own", "doc_id"), "own").groupBy("doc_id", "item_id").agg(F.max("n_equal").alias("n_equal"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of benchmark that each whole text of documents holds, as the rule above has it.

    Null and empty texts and empty tables give no rows; very long texts are searched whole; repeated rows are one; of ties
    the number is reported.  Only doc_id, item_id and text are read, so other columns cannot clash.
    """
    return overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a verified overlap with a benchmark item.

    A row goes by two hashes of its doc_id and text, which are enough here, as equal rows are judged alike.  Null and empty
    texts stay; a very long text is searched whole; an empty table stays empty; columns of any names are kept.
    """
    own, leak = fresh(docs, "_own"), fresh(docs, "_leak")
    rows = docs.withColumn(own, F.struct(F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "text", "doc_id")))
    bad = overlaps(rows.select(F.col(own).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")).select(F.col("doc_id").alias(leak)).distinct()
    return rows.join(few(bad), rows[own] == F.col(leak), "left_anti").drop(own)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_APART = "([" + "".join(rf"\p{{{x}}}" for x in UNSPACED) + "])"
_SQL_TOKENS = rf"regexp_extract_all(regexp_replace({_LOWER}, '{_APART}', ' \1 ', 'g'), '{TOKEN}')"

#: The rule itself, without seeds: every alignment that agrees in enough tokens for it.
OP1_SQL = f"""WITH d AS (SELECT doc_id, {_SQL_TOKENS} AS t FROM documents),
b AS (SELECT item_id, {_SQL_TOKENS} AS it FROM benchmark),
dt AS (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS p FROM d),
bt AS (SELECT item_id, least(len(it), {SPAN}) AS n, unnest(it) AS x, generate_subscripts(it, 1) AS q FROM b WHERE len(it) >= {LEAST}),
shifts AS (SELECT doc_id, item_id, p - q AS s, any_value(n) AS n FROM dt JOIN bt USING (x) GROUP BY doc_id, item_id, s HAVING 100 * count(*) >= {PERCENT} * any_value(n)),
places AS (SELECT doc_id, item_id, t, it, s, n, unnest(range(greatest(0, -s), least(len(it), len(t) - s) - n + 1)) AS o FROM shifts JOIN d USING (doc_id) JOIN b USING (item_id)),
agree AS (SELECT doc_id, item_id, n, list_sum(list_transform(range(0, n), lambda k: CASE WHEN t[s + o + k + 1] = it[o + k + 1] THEN 1 ELSE 0 END)) AS e FROM places)
SELECT doc_id, item_id, CAST(max(e) AS BIGINT) AS n_equal FROM agree WHERE 100 * e >= {PERCENT} * n GROUP BY doc_id, item_id"""
