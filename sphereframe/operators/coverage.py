"""Coverage tiers: region filters, root ranges, leaf boxes, exact bitmaps and the temporal prune."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphereframe.functions import cells as C
from sphereframe.functions import temporal as T
from sphereframe.operators import moc

#: Time spans are merged in blocks of 2**46 ns (19.5 hours) before their seams.
TIME_BITS = 46


class NoCoverageError(ValueError):
    """A store has no committed leaf."""


def region(spark: SparkSession, members: list) -> DataFrame:
    """A cover frame from labels or (ord, k) pairs."""
    rows = sorted({C.cell(x) for x in members})
    return spark.createDataFrame(rows, "ord int, k bigint") if rows else spark.createDataFrame([], "ord int, k bigint")


def in_region(df: DataFrame, aoi: DataFrame, cell_orders: list[int] | None = None) -> DataFrame:
    """Rows whose cell is inside a member of the region or contains one."""
    orders = [r[0] for r in aoi.select("ord").distinct().collect()]  # 30 at most
    if cell_orders is None:
        cell_orders = [r[0] for r in df.select("ord").distinct().collect()]
    return moc.cells_in(df, aoi, orders, cell_orders) if orders else df.limit(0)


def range_shards(ranges: DataFrame) -> DataFrame:
    """ranges: ord, lo, hi (inclusive).  The distinct shards (ord, k); a reversed range fails."""
    lo = F.when(F.col("lo") > F.col("hi"), F.raise_error(F.lit("a coverage range is malformed")).cast("long")).otherwise(F.col("lo"))
    return ranges.select("ord", F.explode(F.sequence(lo, "hi")).alias("k")).distinct()


def range_cover(ranges: DataFrame) -> DataFrame:
    """The canonical cover of ranges, without expanding them."""
    spans = ranges.select(C.first_child("lo", "ord", F.lit(C.MAX_ORDER)).alias("lo"), C.last_child("hi", "ord", F.lit(C.MAX_ORDER)).alias("hi"))
    return moc.compress(moc.coalesce(spans))


def ranges_contain(shards: DataFrame, ranges: DataFrame, order: int) -> DataFrame:
    """shards (k) of an order, with in_cover; ranges of another order contain nothing."""
    return moc.contains(shards, ranges, order)


def ranges_and(ranges: DataFrame, aoi: DataFrame) -> DataFrame:
    return moc.intersect(range_cover(ranges), aoi)


def box_overlaps(leaves: DataFrame, aoi: DataFrame) -> DataFrame:
    """leaves (with shard_k and box) of which some box member overlaps the region; leaves without a box stay."""
    has = F.size(F.coalesce("box", F.expr("array()"))) > 0
    members = leaves.where(has).select("shard_k", F.explode("box").alias("m")).where("m IS NOT NULL").select("shard_k", F.col("m.ord").alias("ord"), F.col("m.k").alias("k"))
    good = in_region(members, aoi).select(F.col("shard_k").alias("_s")).distinct()
    return leaves.where(~has).unionByName(leaves.where(has).join(good, F.col("shard_k") == F.col("_s"), "left_semi"))


def decode_bitmaps(sidecars: DataFrame, shard_order: int, cell_order: int) -> DataFrame:
    """sidecars: shard_k, payload (zstd; null: none).  (shard_k, ord, k) of the set bits, most significant bit first."""
    depth = cell_order - shard_order
    size = (4**depth + 7) // 8

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        reader = zstandard.ZstdDecompressor()
        for b in batches:
            shards, cells = [], []
            for shard, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if payload is None:
                    continue
                bits = reader.decompress(payload, max_output_size=size + 1)
                if len(bits) != size:
                    raise ValueError(f"a bitmap of {len(bits)} bytes where {size} are due")
                ranks = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[: 4**depth])
                shards.append(np.full(len(ranks), shard))
                cells.append((shard << 2 * depth) + ranks)
            cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
            n = sum(map(len, cells))
            yield pa.RecordBatch.from_arrays([pa.array(cat(shards)), pa.array(np.full(n, cell_order, np.int32)), pa.array(cat(cells))], ["shard_k", "ord", "k"])

    return sidecars.select("shard_k", "payload").mapInArrow(decode, "shard_k bigint, ord int, k bigint")


def occupied_in(leaves: DataFrame, occupancy: DataFrame, aoi: DataFrame, shard_order: int) -> DataFrame:
    """(ord, k) of what leaves occupy in the region: full leaves by intervals, bitmap leaves by their cells."""
    full = leaves.where("stamped AND encoding = 'full'").select(F.lit(shard_order).alias("ord"), F.col("shard_k").alias("k"))
    exact = in_region(occupancy.join(leaves.where("stamped AND encoding = 'bitmap'").select("shard_k"), "shard_k", "left_semi"), aoi)
    return moc.intersect(full, aoi).unionByName(exact.select("ord", "k"))


def temporal_keep(shards: DataFrame, times: DataFrame, when) -> DataFrame:
    """Shards (k) that are not listed in times (shard_k, start_ns, end_ns), or of which some entry overlaps the query."""
    start, end = T.query_span(when)
    listed = times.groupBy("shard_k").agg(F.bool_or((F.col("start_ns") < end) & (F.col("end_ns") > start)).alias("_hit"))
    return shards.join(listed, F.col("k") == F.col("shard_k"), "left").where("_hit IS NULL OR _hit").drop("shard_k", "_hit")


def temporal_cover(times: DataFrame | None) -> DataFrame | None:
    """Coalesced (start_ns, end_ns), ends exclusive; None where nothing is known."""
    if times is None:
        return None
    merged = moc.coalesce(times.select(F.col("start_ns").alias("lo"), (F.col("end_ns") - 1).alias("hi")), bits=TIME_BITS)
    return merged.select(F.col("lo").alias("start_ns"), (F.col("hi") + 1).alias("end_ns"))


def companion_spans(rows: DataFrame, words: str, by: list[str]) -> DataFrame:
    """(by..., start_ns, end_ns, word) over all the time words in an array column: the least range that covers them."""
    each = rows.select(*by, F.explode(words).alias("_w"))
    spans = each.groupBy(*by).agg(F.min(T.start_ns(F.col("_w"))).alias("start_ns"), F.max(T.end_ns(F.col("_w"))).alias("end_ns"), F.count(F.lit(1)).alias("_n"), F.min("_w").alias("_w"))
    one = (F.col("_n") == 1) | (F.col("end_ns") == F.col("start_ns") + 1)  # a single instant keeps its word
    return spans.select(*by, "start_ns", "end_ns", F.when(one, F.col("_w")).otherwise(T.range_word(F.col("start_ns"), F.col("end_ns") - 1)).alias("word"))


def candidates(ranges: DataFrame, shard_order: int, aoi: DataFrame | None = None, times: DataFrame | None = None, when=None) -> DataFrame:
    """The shards (k) that a query can touch, from metadata alone, ascending."""
    shards = range_shards(ranges).where(F.col("ord") == shard_order)
    if aoi is not None:
        shards = in_region(shards, aoi, [shard_order])
    shards = shards.select("k")
    if times is not None and when is not None:
        shards = temporal_keep(shards, times, when)
    return shards.orderBy("k")


def stale(leaves: DataFrame, ranges: DataFrame, order: int) -> DataFrame:
    """Committed leaves that the root ranges do not list."""
    shards = leaves.where("stamped").select(F.col("shard_k").alias("k")).distinct()
    return ranges_contain(shards, ranges, order).where("NOT in_cover").select("k")
