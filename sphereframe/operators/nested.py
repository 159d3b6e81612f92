"""Ragged fields: arrays of centroids in cells, their decoding, and histogram tensors made from them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphereframe.functions import cells as C

#: Spark's element types of the little-endian types that ragged elements may have.
KINDS = {"<f4": "float", "<f8": "double", "<i2": "smallint", "<i4": "int", "<i8": "bigint", "<u1": "smallint", "<u8": "bigint"}


@dataclass(frozen=True)
class Element:
    """One row of a ragged value: its number type and its inner shape."""

    dtype: str
    inner: tuple[int, ...]

    @property
    def width(self) -> int:
        return int(np.prod(self.inner, dtype=int)) if self.inner else 1


def parse_element(attrs: dict) -> Element:
    """The declared element; its shape must be open in front and fixed behind."""
    dtype, shape = attrs.get("dtype"), attrs.get("shape")
    if dtype not in KINDS:
        raise ValueError(f"unknown element type {dtype!r}")
    if not isinstance(shape, list) or not shape or shape[0] != -1 or any(not isinstance(x, int) or x < 1 for x in shape[1:]):
        raise ValueError(f"unknown element shape {shape!r}")
    return Element(dtype, tuple(shape[1:]))


def parse_companion(attrs: dict, name: str) -> dict | None:
    """The declaration of a companion (locations, times), None where there is none; half a declaration fails."""
    own = attrs.get(name)
    if own is None:
        return None
    if not isinstance(own, dict) or not isinstance(own.get("array"), str) or own.get("dtype") != "<u8":
        raise ValueError(f"the {name} companion is not declared fully")
    return own


def decode(df: DataFrame, raw: str, element: Element, out: str) -> DataFrame:
    """df with the array of rows (arrays of numbers) that a binary column holds; null and empty give no rows."""
    number, size = KINDS[element.dtype], np.dtype(element.dtype).itemsize * element.width

    @F.pandas_udf(f"array<array<{number}>>")
    def rows(values):  # noqa: ANN001
        def one(v):
            if not v:
                return []
            if len(v) % size:
                raise ValueError(f"{len(v)} bytes are no whole number of elements of {size}")
            a = np.frombuffer(v, element.dtype).reshape(-1, element.width)
            return a.astype("<i8").tolist() if element.dtype in ("<u8", "<u1") else a.tolist()

        return values.map(one)

    return df.withColumn(out, rows(raw))


def read(df: DataFrame, field: str, companions: list[str] | None = None, subtree=None) -> DataFrame:
    """Populated cells of a ragged field, optionally of a subtree; companions must have as many rows as the field."""
    out = df.where(F.size(field) > 0)
    if subtree is not None:
        o, k = C.cell(subtree)
        out = out.where((F.col("ord") >= o) & C.low29("k", "ord").between(k << 2 * (29 - o), ((k + 1) << 2 * (29 - o)) - 1))
    for c in companions or []:
        out = out.withColumn(c, F.when(F.size(c) == F.size(field), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is not aligned with {field}")).cast(dict(df.dtypes)[c])))
    return out


def read_cell(df: DataFrame, field: str, ord: int, k: int) -> DataFrame:
    if not 1 <= k >> 2 * ord <= 12:
        raise IndexError(f"no such cell: {ord}, {k}")
    return df.where((F.col("ord") == ord) & (F.col("k") == k)).select("ord", "k", field)


def rows_of(df: DataFrame, field: str) -> DataFrame:
    """One row for each element, with its place."""
    return df.select("ord", "k", F.posexplode(field).alias("pos", "value"))


# -- t-digests: arrays of struct<mean, weight>, ascending


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _middles(digest: Column) -> Column:
    """The weight left of each centroid's mean: all before it and half its own."""
    steps = F.aggregate(digest, F.struct(F.lit(0.0).alias("t"), F.expr("cast(array() as array<double>)").alias("m")), lambda a, c: F.struct((a["t"] + c["weight"]).alias("t"), F.concat(a["m"], F.array(a["t"] + c["weight"] / 2)).alias("m")))
    return steps["m"]


def _cdf(digest: Column, middles: Column, x: Column) -> Column:
    n, left = F.size(digest), F.size(F.filter(digest, lambda c: c["mean"] <= x))
    total = F.coalesce(F.get(middles, n - 1) + F.get(digest, n - 1)["weight"] / 2, F.lit(0.0))
    return _let(left, lambda i: F.when(i == 0, 0.0).when(i == n, total).otherwise(
        F.get(middles, i - 1) + (x - F.get(digest, i - 1)["mean"]) / (F.get(digest, i)["mean"] - F.get(digest, i - 1)["mean"]) * (F.get(middles, i) - F.get(middles, i - 1))))


def digest_cdf(digest: Column, x: Column) -> Column:
    """The weight below x: linear between neighbouring means, none left of the first, all right of the last."""
    return _let(_middles(digest), lambda m: _cdf(digest, m, x))


def rasterize(digest: Column, z_lo: Column, resolution: Column, n_bins: int) -> Column:
    """Weights in n_bins bins from z_lo: differences of the distribution at the edges, never negative."""
    edges = _let(_middles(digest), lambda m: F.transform(F.sequence(F.lit(0), F.lit(n_bins)), lambda i: _cdf(digest, m, z_lo + i * resolution)))
    return _let(edges, lambda e: F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda i: F.greatest(F.lit(0.0), F.get(e, i + 1) - F.get(e, i))))


def digest_quantile(digest: Column, q: float) -> Column:
    """The inverse of digest_cdf between the first and the last mean, which bound it; null for an empty digest."""
    n = F.size(digest)

    def at(m: Column) -> Column:
        total = F.get(m, n - 1) + F.get(digest, n - 1)["weight"] / 2
        want = total * F.lit(float(q))
        left = F.size(F.filter(m, lambda x: x <= want))
        a, b = F.get(digest, left - 1)["mean"], F.get(digest, left)["mean"]
        inside = a + (want - F.get(m, left - 1)) / (F.get(m, left) - F.get(m, left - 1)) * (b - a)
        return F.when(n == 0, F.lit(None)).when(left == 0, F.get(digest, 0)["mean"]).when(left == n, F.get(digest, n - 1)["mean"]).otherwise(inside)

    return _let(_middles(digest), at)


def merge_digests(df: DataFrame, field: str, level: int, size: int = 100, ord: str = "ord", k: str = "k") -> DataFrame:
    """(ord, k, field) at level: the digests below each ancestor as one of at most size centroids.

    Centroids of equal means add up before the shuffle; then each goes to one of size classes by the weight up to its
    middle, and a class becomes its weighted mean.
    """
    rows = df.select(C.parent(k, ord, F.lit(level)).alias("k"), F.explode(field).alias("c"))
    means = rows.groupBy("k", F.col("c.mean").alias("mean")).agg(F.sum("c.weight").alias("weight"))
    w = Window.partitionBy("k").orderBy("mean").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.sum("weight").over(w) - F.col("weight") / 2
    total = F.sum("weight").over(Window.partitionBy("k"))
    classes = means.withColumn("_class", F.least(F.floor(middle * size / total), F.lit(size - 1)))
    merged = classes.groupBy("k", "_class").agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"), F.sum("weight").alias("weight"))
    return merged.groupBy(F.lit(level).alias("ord"), "k").agg(F.sort_array(F.collect_list(F.struct("mean", "weight"))).alias(field))


def z_windows(df: DataFrame, field: str, block_order: int, resolution: float, n_bins: int, fit: str = "raise", bottom: float = 0.05, top: float = 0.95) -> DataFrame:
    """(block_k, z_lo, resolution, n_bins) of each block: the whole numbers around its cells' quantiles bottom and top,
    fitted to the bins.

    raise: a range that does not fit fails; degrade_resolution: the resolution doubles until it fits;
    collapse_bins: the number of bins is the least power of two that still fits, and a range beyond all bins fails.
    """
    if fit not in ("raise", "degrade_resolution", "collapse_bins"):
        raise ValueError(f"no such fit: {fit}")
    rows = df.where(F.size(field) > 0).select(C.parent("k", "ord", F.lit(block_order)).alias("block_k"), digest_quantile(F.col(field), bottom).alias("lo"), digest_quantile(F.col(field), top).alias("hi"))
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    spans = rows.where(finite(F.col("lo")) & finite(F.col("hi"))).groupBy("block_k").agg(F.floor(F.min("lo")).cast("double").alias("z_lo"), F.ceil(F.max("hi")).cast("double").alias("hi"))
    need = F.col("hi") - F.col("z_lo")
    over = need > n_bins * resolution
    no = F.raise_error(F.lit("a block's range does not fit the bins")).cast("double")
    doubled = F.lit(resolution) * F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(need / (n_bins * resolution), F.lit(1.0)))))
    bins = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(need / resolution, F.lit(1.0))))).cast("int")
    res = F.when(over, doubled if fit == "degrade_resolution" else no).otherwise(F.lit(resolution))
    most = 1 << (n_bins.bit_length() - 1)
    return spans.select("block_k", "z_lo", res.alias("resolution"), (F.least(bins, F.lit(most)) if fit == "collapse_bins" else F.lit(n_bins)).alias("n_bins"))


def tensors(df: DataFrame, field: str, occupancy: DataFrame, ord: int, block_order: int, resolution: float, n_bins: int, fit: str = "raise", max_block_bytes: int = 2 << 30, bottom: float = 0.05, top: float = 0.95) -> DataFrame:
    """Long-form histogram tensors: block_k, row, col, mask, z_lo, resolution, counts.

    Every cell of a block with data has a row.  mask is 2 with a digest, 1 if only occupied, 0 if neither;
    counts is null without a digest.
    """
    side = 1 << (ord - block_order)
    if side * side * n_bins * 4 > max_block_bytes:
        raise ValueError("a block would exceed max_block_bytes")
    windows = z_windows(df, field, block_order, resolution, n_bins, fit, bottom, top)
    blocks = windows.select("*", F.explode(C.children("block_k", F.lit(block_order), F.lit(ord))).alias("k"))
    data = df.where((F.col("ord") == ord) & (F.size(field) > 0)).select("k", F.col(field).alias("_digest"))
    occupied = occupancy.where(F.col("ord") == ord).select("k").distinct().withColumn("_occupied", F.lit(True))
    full = blocks.join(data, "k", "left").join(occupied, "k", "left")
    rank = F.col("k") - C.first_child("block_k", F.lit(block_order), F.lit(ord))
    counts = F.when(F.col("_digest").isNotNull(), rasterize(F.col("_digest"), F.col("z_lo"), F.col("resolution"), n_bins))
    return full.select("block_k", C.rank_row(rank).alias("row"), C.rank_col(rank).alias("col"), F.when(F.col("_digest").isNotNull(), 2).when(F.col("_occupied"), 1).otherwise(0).cast("smallint").alias("mask"), "z_lo", "resolution", counts.alias("counts"))


def has_exact_occupancy(leaves: DataFrame) -> DataFrame:
    """leaves with exact: whether the envelope says bitmap or full."""
    return leaves.withColumn("exact", F.coalesce(F.col("stamped") & F.col("encoding").isin("bitmap", "full"), F.lit(False)))
