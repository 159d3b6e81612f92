"""Joins across resolutions, roll-ups, and the exact occupancy shared by two stores."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphereframe.functions import cells as C
from sphereframe.operators import moc


class ConservativeCoverageWarning(UserWarning):
    """An answer covers more than the exact region because some leaves have no exact information."""


def rollup(df: DataFrame, level: int, aggregates: list, ord: str = "ord", k: str = "k") -> DataFrame:
    """Aggregates of the cells of each ancestor at level: partial and final hash aggregation."""
    keyed = C.with_parents(df, [level], ord, k)
    return keyed.groupBy(F.lit(level).alias("ord"), F.col(f"parent_o{level}").alias("k")).agg(*aggregates)


def rollup_many(df: DataFrame, levels: list[int], aggregates: list, ord: str = "ord", k: str = "k") -> DataFrame:
    """The same for several levels at once, with one shuffle."""
    rows = df.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels])))
    return rows.groupBy(F.col("_level").alias("ord"), C.parent(k, ord, F.col("_level")).alias("k")).agg(*aggregates)


def coarsen(cells: DataFrame, level: int) -> DataFrame:
    """The distinct ancestors: a coarse cell is occupied where any descendant is."""
    return cells.select(F.lit(level).alias("ord"), C.parent("k", "ord", F.lit(level)).alias("k")).distinct()


def join_coarse(fine: DataFrame, coarse: DataFrame, variables: list[str] | None = None, how: str = "left", suffix: str = "") -> DataFrame:
    """Each fine cell with its ancestor's row.

    The coarse frame must have one order, none finer than the fine cells; clashing names fail.  Left keeps
    unmatched rows, with nulls, and integers become doubles as missing values would make them; inner keeps
    types.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"no such join: {how}")
    orders = [r[0] for r in coarse.select("ord").distinct().limit(2).collect()]
    if len(orders) > 1:
        raise ValueError("the coarse cells have several orders")
    names = variables if variables is not None else [c for c in coarse.columns if c not in ("ord", "k")]
    new = {c: f"{c}{suffix}" for c in names}
    if clash := set(new.values()) & set(fine.columns):
        raise ValueError(f"both sides have {sorted(clash)}; give a suffix")
    order = orders[0] if orders else 0
    if (least := fine.agg(F.min("ord")).first()[0]) is not None and least < order:
        raise ValueError("the coarse cells are finer than the fine ones")
    kinds = dict(coarse.dtypes)
    value = lambda c: F.col(c).cast("double") if how == "left" and kinds[c] in ("tinyint", "smallint", "int", "bigint") else F.col(c)
    right = coarse.select(F.col("k").alias("_pk"), *[value(c).alias(new[c]) for c in names])
    return fine.join(right, C.parent("k", "ord", F.lit(order)) == F.col("_pk"), how).drop("_pk")


def shared_regions(a: DataFrame, b: DataFrame, order_a: int, order_b: int) -> DataFrame:
    """Shards (k) of the finer order that both sides have."""
    if order_a == order_b:
        return a.select("k").distinct().join(b.select("k").distinct(), "k", "left_semi")
    fine, coarse, fo, co = (a, b, order_a, order_b) if order_a > order_b else (b, a, order_b, order_a)
    return fine.select("k").distinct().join(coarse.select(F.col("k").alias("_c")).distinct(), C.parent("k", F.lit(fo), F.lit(co)) == F.col("_c"), "left_semi")


def classify(leaves: DataFrame) -> DataFrame:
    """leaves: shard_k, stamped, encoding, has_bitmap, box.  kind: empty, full, cells, or box for want of exact cells."""
    kind = (
        F.when(~F.coalesce("stamped", F.lit(False)), "empty")
        .when(F.col("encoding") == "full", "full")
        .when((F.col("encoding") == "bitmap") & F.col("has_bitmap"), "cells")
        .otherwise("box")
    )
    return leaves.withColumn("kind", kind)


def leaf_parts(leaves: DataFrame, occupancy: DataFrame, shard_order: int, region_order: int, out_order: int, degrade: str) -> DataFrame:
    """(ord, k, exact, region): what each leaf occupies, exact cells at out_order, whole leaves as covers.

    The cells' order is the one that the leaf's own envelope states (env_order).  Leaves without exact cells
    are covered by their box, or by the whole shard: conservative warns, skip drops them, raise fails.
    """
    if degrade not in ("conservative", "skip", "raise"):
        raise ValueError(f"no such policy: {degrade}")
    kinds = classify(leaves)
    if degrade != "skip" and not kinds.where("kind = 'box'").limit(1).isEmpty():
        if degrade == "raise":
            raise ValueError("a leaf has no exact cells")
        warnings.warn("some leaves have no exact cells; the answer covers more", ConservativeCoverageWarning, stacklevel=3)
    exact = occupancy.join(kinds.where("kind = 'cells'").select("shard_k", "env_order"), "shard_k")
    if not exact.where(F.col("env_order") < out_order).limit(1).isEmpty():
        raise ValueError("a leaf's cells are coarser than the answer")
    cells = exact.select(F.lit(out_order).alias("ord"), C.parent("k", "env_order", F.lit(out_order)).alias("k"), F.lit(True).alias("exact")).distinct()
    whole = kinds.where("kind = 'full'").select(F.lit(shard_order).alias("ord"), F.col("shard_k").alias("k"), F.lit(False).alias("exact"))
    out = cells.unionByName(whole)
    if degrade == "conservative":
        none = F.array(F.struct(F.lit(shard_order).alias("ord"), F.col("shard_k").alias("k")))
        members = kinds.where("kind = 'box'").select(F.explode(F.when(F.size(F.coalesce("box", F.expr("array()"))) > 0, F.col("box")).otherwise(none)).alias("m")).where("m IS NOT NULL")
        out = out.unionByName(members.select(C.clip_order("m.ord", F.lit(out_order)).cast("int").alias("ord"), C.clip("m.k", "m.ord", F.lit(out_order)).alias("k"), F.lit(False).alias("exact")).distinct())
    return out


def occupancy_and(a: DataFrame, b: DataFrame) -> DataFrame:
    """The canonical cover of what both sides' parts occupy; whole leaves are never expanded."""
    return moc.intersect(a.select("ord", "k"), b.select("ord", "k"))


def occupancy_cells(a: DataFrame, b: DataFrame, region_order: int, out_order: int) -> DataFrame:
    """(region, k) at out_order: exact with exact by a join of cells, the rest from intervals, expanded last."""
    exact = a.where("exact").select("k").join(b.where("exact").select("k"), "k", "left_semi")
    spans = None
    for x, y in (("exact", "not exact"), ("not exact", "true")):  # intervals of one side may overlap; repeated cells go at the end
        met = moc.overlap(moc.intervals(a.where(x), out_order), moc.intervals(b.where(y), out_order), out_order)
        spans = met if spans is None else spans.unionByName(met)
    every = exact.unionByName(spans.select(F.explode(F.sequence("lo", "hi")).alias("k"))).distinct()
    return every.select(C.parent("k", F.lit(out_order), F.lit(region_order)).alias("region"), "k")
