"""Content hashes, their verification, folds of leaf statistics, and resolution pyramids."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sphereframe.functions import cells as C
from sphereframe.operators import nested as N

_FORMATS = {"tinyint": "<b", "smallint": "<h", "int": "<i", "bigint": "<q", "float": "<f", "double": "<d"}


def hash_arrays(df: DataFrame, arrays: list[str], leaf: list[str], order_by: str = "k") -> DataFrame:
    """(leaf..., array, sha256) over each array's little-endian bytes in cell order; binary values are length-prefixed.

    Hashing follows the order, so a leaf's rows come sorted through one task, as a stream: its hash state is
    all that is held.
    """
    kinds = dict(df.dtypes)
    rows = df.select(*leaf, order_by, *arrays)
    sorted_ = rows.repartition(*leaf).sortWithinPartitions(*leaf, order_by)
    n = len(leaf)
    types = [sorted_.schema[c].dataType.simpleString() for c in leaf] + ["string", "string"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states, out = None, [], []

        def flush() -> None:
            out.extend((*key, a, s.hexdigest()) for a, s in zip(arrays, states, strict=True))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:n] != key:
                    if key is not None:
                        flush()
                    key, states = row[:n], [hashlib.sha256() for _ in arrays]
                for a, s, v in zip(arrays, states, row[n + 1 :], strict=True):
                    if kinds[a] == "binary":
                        s.update(struct.pack("<Q", len(v or b"")) + (v or b""))
                    else:
                        s.update(struct.pack(_FORMATS[kinds[a]], v if v is not None else float("nan") if kinds[a] in ("float", "double") else 0))
        if key is not None:
            flush()
        cols = list(zip(*out, strict=True)) if out else [()] * (n + 2)
        arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, t in zip(cols, types, strict=True)], [*leaf, "array", "sha256"])

    schema = ", ".join(f"{c} {t}" for c, t in zip([*leaf, "array", "sha256"], types, strict=True))
    return sorted_.mapInArrow(stream, schema)


def combined_hash(hashes: Column) -> Column:
    """Aggregate: the hash of a leaf's sorted hashes, one a line."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(hashes)), "\n"), 256)


def verify(computed: DataFrame, recorded: DataFrame, leaf: list[str]) -> DataFrame:
    """(leaf..., match, mismatched): match is null where nothing is recorded."""
    both = computed.withColumnRenamed("sha256", "_c").join(recorded.withColumnRenamed("sha256", "_r"), [*leaf, "array"], "full")
    wrong = F.when(~F.col("_c").eqNullSafe(F.col("_r")), F.col("array"))
    out = both.groupBy(*leaf).agg(F.count("_r").alias("_n"), F.sort_array(F.collect_set(wrong)).alias("_wrong"))
    return out.select(*leaf, F.when(F.col("_n") > 0, F.size("_wrong") == 0).alias("match"), F.when(F.col("_n") > 0, F.col("_wrong")).otherwise(F.expr("cast(array() as array<string>)")).alias("mismatched"))


COUNTERS = ("n_shards", "n_granules", "n_obs", "cells_with_data")


def fold_stats(stats: DataFrame, by: list[str]) -> DataFrame:
    """Merged leaf records: counters and timings add up, memory and time take the maximum, success needs all.

    semantic_hash stays where all records agree, else null.
    """
    agree = F.when((F.count_distinct("semantic_hash") == 1) & (F.count("semantic_hash") == F.count(F.lit(1))), F.max("semantic_hash"))
    folded = stats.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.sum("duration_s").alias("duration_s"), F.max("max_memory_mb").alias("max_memory_mb"), F.max("timestamp").alias("timestamp"), F.bool_and("success").alias("success"), agree.alias("semantic_hash"))
    if "phase_timings" not in stats.columns:
        return folded
    phases = stats.select(*by, F.explode("phase_timings").alias("phase", "s")).groupBy(*by, "phase").agg(F.sum("s").alias("s"))
    maps = phases.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("phase", "s")))).alias("phase_timings"))
    return folded.join(maps, by, "left")


# -- pyramids


def overview_orders(pyramid: dict | None, cell_order: int, shard_order: int) -> dict[int, int]:
    """Ancestor order to cell order of a declared pyramid, finest first; none declared gives none."""
    own = (pyramid or {}).get("overview") or {}
    orders = own.get("orders") or []
    if any(not isinstance(o, int) or not 0 <= o < shard_order for o in orders):
        raise ValueError(f"overview orders must lie above the shards: {orders}")
    return {o: cell_order - (shard_order - o) for o in sorted(orders, reverse=True)}


def overview_nodes(shards: DataFrame, shard_order: int, order: int) -> DataFrame:
    return shards.select(C.parent("k", F.lit(shard_order), F.lit(order)).alias("k")).distinct().orderBy("k")


#: How a field's values fold into a coarser cell; null (no data) is skipped by all.
FOLDS = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "count": F.count}
#: The method of fields that are digests.
DIGEST = "tdigest_kway"


def pyramid_level(df: DataFrame, methods: dict[str, str], level: int) -> DataFrame:
    """The cells at level with each field folded by its method; fields of method none are left out, digests (tdigest_kway) merge."""
    folds = [FOLDS[m](c).alias(c) for c, m in methods.items() if m in FOLDS]
    out = df.groupBy(F.lit(level).alias("ord"), C.parent("k", "ord", F.lit(level)).alias("k")).agg(*folds, F.count(F.lit(1)).alias("_n")).drop("_n")
    for c in (c for c, m in methods.items() if m == DIGEST):
        out = out.join(N.merge_digests(df, c, level), ["ord", "k"], "left")
    return out


def pyramid(df: DataFrame, methods: dict[str, str], levels: list[int]) -> dict[int, DataFrame]:
    """A frame for each level, each made from the next finer one where all methods compose."""
    out: dict[int, DataFrame] = {}
    base = df
    composes = all(m in ("sum", "min", "max", "none", DIGEST) for m in methods.values())
    for level in sorted(levels, reverse=True):
        out[level] = pyramid_level(base, methods, level)
        base = out[level] if composes else df
    return out


def finest_at(levels: list[int], order: int) -> int | None:
    """The finest level no finer than order."""
    return max((x for x in levels if x <= order), default=None)
