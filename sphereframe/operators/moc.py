"""Covers and intervals.

A cover is a frame (ord, k) of cells of mixed orders.  Its normal form is a frame of disjoint, non-adjacent
inclusive intervals (lo, hi) in the numbering of one order; most operators work on intervals of order 29,
where cells of any orders are nested or disjoint, so containment either way is overlap.

Interval frames are coalesced block by block (BLOCK_BITS high bits), then at the blocks' seams, so no step
sorts everything in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphereframe.functions import cells as C

#: Intervals are dealt out by these many quadtree levels below the base blocks.
BLOCK_LEVELS = 6


def intervals(cover: DataFrame, order: int = C.MAX_ORDER) -> DataFrame:
    """(lo, hi) of the cells at an order no coarser than theirs."""
    return cover.select(C.first_child("k", "ord", F.lit(order)).alias("lo"), C.last_child("k", "ord", F.lit(order)).alias("hi"))


def _merge(df: DataFrame, by: list[str]) -> DataFrame:
    """Merge overlapping and adjacent intervals inside each group."""
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = df.withColumn("_new", F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*by, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def coalesce(df: DataFrame, order: int = C.MAX_ORDER, by: list[str] | None = None, bits: int | None = None) -> DataFrame:
    """Disjoint, non-adjacent intervals with the same union; a reversed interval fails.  bits: of a block, if not order's.

    Intervals are cut at block boundaries and merged inside blocks; an interval that fills its block's edge is
    then stitched to its neighbour.  Only intervals at block edges take part in the second step.
    """
    by = by or []
    lo = F.when(F.col("lo") > F.col("hi"), F.raise_error(F.lit("an interval is reversed")).cast("long")).otherwise(F.col("lo"))
    bits = 2 * max(order - BLOCK_LEVELS, 0) if bits is None else bits
    df = df.select(*by, lo.alias("lo"), "hi")
    cut = df.select(*by, "lo", "hi", F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright("hi", bits))).alias("_block"))
    first, last = F.shiftleft("_block", bits), F.shiftleft(F.col("_block") + 1, bits) - 1
    cut = cut.select(*by, "_block", F.greatest("lo", first).alias("lo"), F.least("hi", last).alias("hi"))
    inside = _merge(cut, [*by, "_block"])
    edge = (F.col("lo") == F.shiftleft("_block", bits)) | (F.col("hi") == F.shiftleft(F.col("_block") + 1, bits) - 1)
    # at most two edge intervals a block, and blocks are bounded: 12 * 4**BLOCK_LEVELS
    stitched = _merge(inside.where(edge).drop("_block"), by or ["_one"]) if by else _merge(inside.where(edge).select("lo", "hi", F.lit(0).alias("_one")), ["_one"]).drop("_one")
    return inside.where(~edge).drop("_block").unionByName(stitched)


def compress(df: DataFrame, order: int = C.MAX_ORDER) -> DataFrame:
    """The canonical cover (ord, k) of coalesced intervals at an order: no cell inside another, no four siblings.

    Closed form: at each level the aligned blocks inside the interval, without those inside the next level's.
    """
    def at(level: Column) -> tuple[Column, Column]:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), 2 * level)
        a = F.call_function("shiftright", F.col("lo") + size - 1, 2 * level)
        return a, F.call_function("shiftright", F.col("hi") + 1, 2 * level)

    levels = df.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("level"))
    level = F.col("level")
    a, b = at(level)
    a2, b2 = at(level + 1)
    up = (a2 < b2) & (level < order)
    # before the next level's blocks, and after them
    parts = levels.where(a < b).select(
        level, F.when(up, F.array(F.struct(a.alias("x"), (4 * a2).alias("y")), F.struct((4 * b2).alias("x"), b.alias("y")))).otherwise(F.array(F.struct(a.alias("x"), b.alias("y")))).alias("parts"))
    cells = parts.select("level", F.inline("parts")).where("x < y")
    return cells.select((F.lit(order) - F.col("level")).cast("int").alias("ord"), F.explode(F.sequence("x", F.col("y") - 1)).alias("k"))


def compress_cover(cover: DataFrame) -> DataFrame:
    return compress(coalesce(intervals(cover)))


def expand(cover: DataFrame, order: int) -> DataFrame:
    """The distinct cells of a cover at one order: finer members are truncated, coarser ones exploded."""
    return cover.select(F.explode(C.zoom("k", "ord", order)).alias("k")).distinct().select(F.lit(order).alias("ord"), "k")


def clip_cover(cover: DataFrame, order: int) -> DataFrame:
    return cover.select(C.clip_order("ord", F.lit(order)).alias("ord"), C.clip("k", "ord", F.lit(order)).alias("k")).distinct()


def overlap(a: DataFrame, b: DataFrame, order: int = C.MAX_ORDER, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Intersections (lo, hi) of two interval frames, joined by the blocks that both touch, not by comparing all pairs."""
    bits = 2 * max(order - levels, 0)
    cut = lambda df, x, y: df.select(F.col("lo").alias(x), F.col("hi").alias(y), F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright("hi", bits))).alias("_block"))
    met = cut(a, "a", "b").join(cut(b, "c", "d"), "_block").where("a <= d AND c <= b")
    first, last = F.shiftleft("_block", bits), F.shiftleft(F.col("_block") + 1, bits) - 1
    return met.select(F.greatest("a", "c", first).alias("lo"), F.least("b", "d", last).alias("hi"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The canonical cover of the region in both covers."""
    return compress(coalesce(overlap(coalesce(intervals(a)), coalesce(intervals(b)))))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return compress_cover(a.select("ord", "k").unionByName(b.select("ord", "k")))


def cells_in(df: DataFrame, cover: DataFrame, orders: list[int], cell_orders: list[int], ord: str = "ord", k: str = "k") -> DataFrame:
    """The rows whose cell lies inside a member of the cover or contains one.

    orders and cell_orders are the orders present in the cover and in the data; each gives one key, so the
    test is an equi-join on (order, ancestor) and never a nested loop.  Down: the cell truncated to a member's
    order.  Up: a finer member truncated to the cell's order.
    """
    keys = F.array(*[F.when(F.col(ord) >= o, F.struct(F.lit(o).alias("o"), C.parent(k, ord, F.lit(o)).alias("c"))) for o in sorted(set(orders) | set(cell_orders))])
    member = cover.select(F.col("ord").alias("_mo"), F.col("k").alias("_mk"))
    up = member.select(F.explode(F.array(*[F.when(F.col("_mo") > o, F.struct(F.lit(o).alias("o"), C.parent("_mk", "_mo", F.lit(o)).alias("c"), F.lit(True).alias("up"))) for o in sorted(cell_orders)])).alias("x")).where("x IS NOT NULL").select("x.*") if cell_orders else None
    own = member.select(F.col("_mo").alias("o"), F.col("_mk").alias("c"), F.lit(False).alias("up"))
    wanted = (own.unionByName(up) if up is not None else own).groupBy("o", "c").agg(F.min("up").alias("up"))
    if len(set(orders) | set(cell_orders)) <= 6:  # the rows pass once; each order looks its ancestor up
        out, hits = df, F.lit(False)
        for i, o in enumerate(sorted(set(orders) | set(cell_orders))):
            of = wanted.where(F.col("o") == o).select(F.col("c").alias(f"_c{i}"), F.col("up").alias(f"_up{i}"))
            out = out.join(of, F.when(F.col(ord) >= o, C.parent(k, ord, F.lit(o))) == F.col(f"_c{i}"), "left")
            hits = hits | (F.col(f"_c{i}").isNotNull() & (~F.col(f"_up{i}") | (F.col(ord) == o)))
        return out.where(hits).select(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.withColumn("_keys", F.filter(keys, lambda x: x.isNotNull()))
    cells = rows.select(F.col(ord).alias("_ord"), F.col(k).alias("_k"), F.explode("_keys").alias("x")).distinct()
    good = cells.join(wanted, (F.col("x.o") == F.col("o")) & (F.col("x.c") == F.col("c")) & (~F.col("up") | (F.col("x.o") == F.col("_ord"))), "left_semi").select("_ord", "_k").distinct()
    return df.join(good, (F.col(ord) == F.col("_ord")) & (F.col(k) == F.col("_k")), "left_semi")


def contains(df: DataFrame, members: DataFrame, order: int, shard: str = "k") -> DataFrame:
    """df with in_cover: whether its shard of that order is in the inclusive ranges (lo, hi, ord) of another order or the same."""
    same = members.where(F.col("ord") == order)
    hit = overlap(df.select(F.col(shard).alias("lo"), F.col(shard).alias("hi")).distinct(), same.select("lo", "hi"), order).select(F.col("lo").alias("_hit")).distinct()
    return df.join(hit, F.col(shard) == F.col("_hit"), "left").withColumn("in_cover", F.col("_hit").isNotNull()).drop("_hit")
