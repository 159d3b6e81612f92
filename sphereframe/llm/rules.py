"""Quality rules with adaptive thresholds from mergeable quantile sketches (DataFrame functions only).

Every document gets exact counts of its own text; each (lang, source) group gets KLL quantile sketches of the ratios
made from them, merged from per-salt partial sketches over its documents that pass the base rules.  A group's fences
are REACH times its interquartile range beyond its quartiles, on both sides, and have no fixed least or greatest value:
where most documents of a group have no symbols at all, its fence is none.  A document is held against its group's fence
less what chance explains: ERRORS standard errors of its own count, taken as that of independent clumps (a repeated
window is ten words at once), so that a short text does not go for one odd line and a long one does for a habit.

Defined results: null or empty text has no words and fails the base rules; a very long text is counted whole; null lang or
source form groups of their own; a group of fewer than LEAST_GROUP such documents is judged by the fences of all rows;
a ratio just at its fence stays; repeated rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sphereframe.llm.common import fresh, let, materialize, table, words_of

SALTS, SKETCH = 16, 400
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
#: ratio -> its count, what it is a share of, and how many of them come at once.
RATIOS = {
    "symbol_ratio": ("n_symbols", "n_words", 1), "caps_ratio": ("n_caps", "word_chars", 4), "dup_line_ratio": ("n_dup_lines", "n_lines", 1),
    "repeat_ratio": ("n_repeat_words", "n_words", 2 * WINDOW), "mean_word": ("word_chars", "n_words", 2),
}
REACH, ERRORS = 3.0, 3.0
#: A group with fewer rows than this is judged by the thresholds of all rows.
LEAST_GROUP = 50
#: Up to so many (lang, source) groups, and bytes of their names, their thresholds are broadcast; beyond it the join is salted.
BROADCAST_GROUPS, BROADCAST_BYTES = 100_000, 32 << 20
_FENCES = [f"{k}_{side}" for k in RATIOS for side in ("low", "high")]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words covered by a window of WINDOW words whose 64-bit hash is found twice or more in the text."""
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[words[i + j] for j in range(WINDOW)]))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(s, lambda x, j: x["h"].eqNullSafe(F.get(s, j - 1)["h"]) | x["h"].eqNullSafe(F.get(s, j + 1)["h"])))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        steps = let(starts, lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return F.when(n >= WINDOW, let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))).otherwise(0)


def metrics(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """df with its counts and ratios added, and the names that they got (fresh ones where df has a like name)."""
    names = {}
    for k in ("t", "w", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", *RATIOS):
        names[k] = fresh(df, f"_q_{k}")
    c = {k: F.col(f"`{v}`") for k, v in names.items()}
    df = df.withColumn(names["t"], F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.withColumn(names["w"], words_of(c["t"]))
    df = df.withColumn(names["lines"], F.filter(F.split(c["t"], "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumns({
        names["n_words"]: F.size(c["w"]).cast("long"),
        names["word_chars"]: F.length(F.translate(c["t"], " \t\n\x0b\x0c\r", "")).cast("long"),
        names["n_symbols"]: (F.length(c["t"]) - F.length(F.translate(c["t"], "#*$%&|<>", ""))).cast("long"),
        names["n_lines"]: F.size(c["lines"]).cast("long"),
        names["n_dup_lines"]: (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
        names["n_repeat_words"]: _repeat_words(c["w"], F.size(c["w"])).cast("long"),
        names["n_caps"]: F.length(F.regexp_replace(c["t"], r"\P{Lu}+", "")).cast("long"),
    }).drop(names["t"], names["w"], names["lines"])
    return df.withColumns({names[k]: c[part] / F.greatest(c[whole], F.lit(1)) for k, (part, whole, _) in RATIOS.items()}), names


def base_failed(c: dict[str, str]) -> Column:
    n, r = F.col(f"`{c['n_words']}`"), F.col(f"`{c['n_repeat_words']}`")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def fit_thresholds(df: DataFrame, names: dict[str, str], lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (lang, source) and one, with whole true, for all rows: the fences of each ratio.

    Partial KLL sketches are made on the map side for each group and salt, then merged for each group and
    once more for all rows; rows that fail the base rules take no part.
    """
    some = ~base_failed(names)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{names[k]}`") for k in ("n_words", "word_chars", "n_caps")]), F.lit(SALTS))
    salted = df.groupBy(F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), salt.alias("salt")).agg(
        F.count_if(some).alias("n"), *[F.kll_sketch_agg_double(F.when(some, F.col(f"`{names[k]}`")), F.lit(SKETCH)).alias(k) for k in RATIOS])
    merge = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(k, F.lit(SKETCH)).alias(k) for k in RATIOS]]
    merged = materialize(salted.groupBy("lang", "source").agg(*merge))
    whole = merged.groupBy().agg(*merge).where("n > 0").select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(True).alias("whole"), "n", *RATIOS)

    def fences(k: str) -> list[Column]:
        low, high = (F.kll_sketch_get_quantile_double(F.col(k), F.lit(p)) for p in (0.25, 0.75))
        return [(low - REACH * (high - low)).alias(f"{k}_low"), (high + REACH * (high - low)).alias(f"{k}_high")]

    both = merged.where(F.col("n") >= LEAST_GROUP).select("lang", "source", F.lit(False).alias("whole"), "n", *RATIOS).unionByName(whole)
    return materialize(both.select("lang", "source", "whole", *[f for k in RATIOS for f in fences(k)]))


def judge(df: DataFrame, names: dict[str, str], thresholds: DataFrame, verdict: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """df with a boolean column: true where the base rules and the group's fences both hold.

    The thresholds' rows and bytes are checked: few are broadcast; many are joined with the documents salted,
    so that no group's documents meet in one task.  The fences of all rows are one row, and become constants.
    """
    own, whole = thresholds.where("not whole"), thresholds.where("whole").first()
    name = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    found = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(name("lang") + name("source")), F.lit(0)).alias("size")).first()
    small = found.n <= BROADCAST_GROUPS and found.size <= BROADCAST_BYTES
    t = {k: fresh(df, f"_f_{k}") for k in ("lang", "source", "salt", *_FENCES)}
    limits = own.select(*[F.col(k).alias(t[k]) for k in ("lang", "source", *_FENCES)])
    on = F.col(f"`{lang}`").eqNullSafe(F.col(t["lang"])) & F.col(f"`{source}`").eqNullSafe(F.col(t["source"]))
    if small:
        joined = df.join(F.broadcast(limits), on, "left")
    else:
        salt = fresh(df, "_salt")
        joined = df.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(limits.withColumn(t["salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), on & (F.col(salt) == F.col(t["salt"])), "left").drop(salt)
    inside = F.lit(True)
    for k, (part, of, clump) in RATIOS.items():
        count, n = F.col(f"`{names[part]}`"), F.greatest(F.col(f"`{names[of]}`"), F.lit(1))
        low, high = (F.coalesce(F.col(t[f]), F.lit(whole[f] if whole else None).cast("double")) for f in (f"{k}_low", f"{k}_high"))
        above, below = count - ERRORS * F.sqrt(count * clump), count + ERRORS * F.sqrt((count + 1) * clump)
        inside = inside & F.coalesce((above <= high * n) & (below >= low * n), F.lit(True))
    return joined.withColumn(verdict, ~base_failed(names) & inside).drop(*t.values())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every whole text of documents.

    Null and empty texts have no words and fail; very long texts are counted whole; repeated rows are judged one by one; an
    empty table gives no rows.  Only doc_id, lang, source and text are read, so other columns cannot clash.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    df, names = metrics(docs)
    df = materialize(df.drop("text"))
    out = judge(df, names, fit_thresholds(df, names), "kept")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[F.col(names[k]).alias(k) for k in counts], base_failed(names).alias("base_failed"), "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose verdict is kept; their columns are unchanged, whatever their names.

    Null and empty texts go; very long ones are counted whole; of repeated rows all stay or go; an empty table stays empty.
    """
    df, names = metrics(docs)
    df = materialize(df)  # else a filter on the verdict would be pushed down and compute every count again, for each use
    verdict = fresh(df, "_kept")
    out = judge(df, names, fit_thresholds(df, names), verdict)
    return out.where(F.col(verdict)).select(*[F.col(f"`{c}`") for c in docs.columns])
