"""Domains: the cells of one order as disjoint inclusive intervals, with positions along them.

A domain is a frame (lo, hi, offset); offset counts the cells before the interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sphereframe.functions import cells as C
from sphereframe.operators import moc


def number(intervals: DataFrame, order: int) -> DataFrame:
    """Offsets by two levels: a running sum inside blocks, and one over the blocks' totals (at most 12 * 4**6)."""
    bits = 2 * max(order - moc.BLOCK_LEVELS, 0)
    rows = intervals.select("lo", "hi", F.shiftright("lo", bits).alias("_block"), (F.col("hi") - F.col("lo") + 1).alias("_n"))
    totals = rows.groupBy("_block").agg(F.sum("_n").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_block").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_own", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return own.join(starts, "_block").select("lo", "hi", (F.col("_start") + F.col("_own")).alias("offset"))


def from_shards(shards: DataFrame, shard_order: int, order: int) -> DataFrame:
    """One run of cells a shard (column k)."""
    return number(moc.coalesce(shards.select(C.first_child("k", F.lit(shard_order), F.lit(order)).alias("lo"), C.last_child("k", F.lit(shard_order), F.lit(order)).alias("hi")), order), order)


def from_ranges(ranges: DataFrame, shard_order: int, order: int) -> DataFrame:
    """Inclusive shard ranges (lo, hi), not expanded."""
    return number(moc.coalesce(ranges.select(C.first_child("lo", F.lit(shard_order), F.lit(order)).alias("lo"), C.last_child("hi", F.lit(shard_order), F.lit(order)).alias("hi")), order), order)


def from_cells(cells: DataFrame, order: int) -> DataFrame:
    """Runs of consecutive cells; a cell of another order fails."""
    k = F.when(F.col("ord") == order, F.col("k")).otherwise(F.raise_error(F.lit("cells of several orders make no domain")).cast("long"))
    return number(moc.coalesce(cells.select(k.alias("lo"), k.alias("hi")), order), order)


def from_cover(cover: DataFrame, order: int) -> DataFrame:
    """The cells of a cover of mixed orders; a member finer than the order fails."""
    k = F.when(F.col("ord") <= order, F.col("k")).otherwise(F.raise_error(F.lit("a member is finer than the domain")).cast("long"))
    return number(moc.coalesce(moc.intervals(cover.select("ord", k.alias("k")), order), order), order)


def intersection(a: DataFrame, b: DataFrame, order: int) -> DataFrame:
    return number(moc.coalesce(moc.overlap(a, b, order), order), order)


def union(a: DataFrame, b: DataFrame, order: int) -> DataFrame:
    return number(moc.coalesce(a.select("lo", "hi").unionByName(b.select("lo", "hi")), order), order)


def within(domain: DataFrame, cover: DataFrame, order: int) -> DataFrame:
    """The domain's cells that lie inside a member of the cover or contain one."""
    at = cover.select(C.clip_order("ord", F.lit(order)).alias("ord"), C.clip("k", "ord", F.lit(order)).alias("k"))
    return intersection(domain, moc.coalesce(moc.intervals(at, order), order), order)


def size(domain: DataFrame) -> DataFrame:
    return domain.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1), F.lit(0)).alias("size"))


def fabricate(domain: DataFrame) -> DataFrame:
    """(k, position) of every cell."""
    return domain.select(F.posexplode(F.sequence("lo", "hi")).alias("_i", "k"), "offset").select("k", (F.col("offset") + F.col("_i")).alias("position"))


def equal(a: DataFrame, b: DataFrame) -> bool:
    x, y = a.select("lo", "hi"), b.select("lo", "hi")
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def _located(df: DataFrame, domain: DataFrame, order: int, k: str) -> DataFrame:
    """df with position, null where its cell is not in the domain; joined by block."""
    bits = 2 * max(order - moc.BLOCK_LEVELS, 0)
    cut = domain.select("lo", "hi", "offset", F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright("hi", bits))).alias("_block"))
    on = (F.shiftright(F.col(k), bits) == F.col("_block")) & F.col(k).between(F.col("lo"), F.col("hi"))
    return df.join(cut, on, "left").withColumn("position", F.col("offset") + F.col(k) - F.col("lo")).drop("lo", "hi", "offset", "_block")


def member(df: DataFrame, domain: DataFrame, order: int, k: str = "k") -> DataFrame:
    return _located(df, domain, order, k).withColumn("member", F.col("position").isNotNull()).drop("position")


def rank(df: DataFrame, domain: DataFrame, order: int, k: str = "k", missing: int | None = None) -> DataFrame:
    """df with each cell's position; a cell outside fails, or gets missing."""
    absent = F.raise_error(F.concat(F.lit("not in the domain: "), F.col(k).cast("string"))).cast("long") if missing is None else F.lit(missing).cast("long")
    return _located(df, domain, order, k).withColumn("position", F.coalesce("position", absent))


def take(df: DataFrame, domain: DataFrame, position: str = "position") -> DataFrame:
    """df with the cell k at each position; negative ones count from the end, others outside fail.

    Positions and intervals meet by blocks of positions, sized so that the domain has a few thousand of them.
    """
    n = int(size(domain).first()[0])
    p = F.when(F.col(position) < 0, F.col(position) + n).otherwise(F.col(position))
    good = F.when((p >= 0) & (p < n), p).otherwise(F.raise_error(F.concat(F.lit("no such position: "), F.col(position).cast("string"))).cast("long"))
    width = max(n // 4096, 1)
    cut = domain.select("lo", "hi", "offset", F.explode(F.sequence(F.floor(F.col("offset") / width), F.floor((F.col("offset") + F.col("hi") - F.col("lo")) / width))).alias("_block"))
    rows = df.withColumn("_p", good).withColumn("_at", F.floor(F.col("_p") / width))
    on = (F.col("_at") == F.col("_block")) & (F.col("_p") >= F.col("offset")) & (F.col("_p") <= F.col("offset") + F.col("hi") - F.col("lo"))
    return rows.join(cut, on, "inner").withColumn("k", F.col("lo") + F.col("_p") - F.col("offset")).drop("lo", "hi", "offset", "_block", "_p", "_at")


def subset(domain: DataFrame, start: int, stop: int, order: int, step: int = 1) -> DataFrame:
    """The sub-domain of positions [start, stop), or of every step-th of them."""
    if start < 0 or stop < start or step < 1:
        raise ValueError("positions must increase")
    if step > 1:
        own = fabricate(subset(domain, start, stop, order)).where(F.col("position") % step == 0)
        return number(moc.coalesce(own.select(F.col("k").alias("lo"), F.col("k").alias("hi")), order), order)
    first, last = F.greatest("offset", F.lit(start)), F.least(F.col("offset") + F.col("hi") - F.col("lo"), F.lit(stop - 1))
    return number(domain.where(first <= last).select((F.col("lo") + first - F.col("offset")).alias("lo"), (F.col("lo") + last - F.col("offset")).alias("hi")), order)


def subset_at(domain: DataFrame, positions: DataFrame, order: int, position: str = "position") -> DataFrame:
    """The sub-domain of the given positions; negative ones count from the end, others outside fail, repeats count once."""
    own = take(positions.select(position), domain, position)
    return number(moc.coalesce(own.select(F.col("k").alias("lo"), F.col("k").alias("hi")), order), order)


def select(rows: DataFrame, labels: DataFrame, ordinal: str = "ordinal", k: str = "k") -> DataFrame:
    """The rows of the asked cells, in the order asked for and as often; a missing cell fails."""
    asked = labels.select(F.col(ordinal), F.col(k).alias("_k"))
    own = rows.withColumn("_here", F.lit(True))
    out = asked.join(own, F.col("_k") == own[k], "left")
    return out.where(F.when(F.col("_here").isNull(), F.raise_error(F.concat(F.lit("no such cell: "), F.col("_k").cast("string"))).cast("boolean")).otherwise(True)).drop("_k", "_here").orderBy(ordinal)


def align(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    if how not in ("inner", "outer", "left", "right"):
        raise ValueError(f"no such join: {how}")
    return a.join(b, ["ord", "k"], how)


def reindex(domain: DataFrame, other: DataFrame, order: int, k: str = "k") -> DataFrame:
    """Positions of the other frame's cells, -1 where absent."""
    return rank(other, domain, order, k, missing=-1)


def concat(parts: list[DataFrame], order: int, strict: bool = True) -> DataFrame:
    """The union of domains that follow each other, its positions those of the parts in turn; overlap or disorder fails
    if strict.  Neighbours merge, and empty domains add nothing."""
    if strict:
        ends = [tuple(p.agg(F.min("lo"), F.max("hi")).first()) for p in parts]
        known = [e for e in ends if e[0] is not None]
        if any(y[0] <= x[1] for x, y in zip(known, known[1:], strict=False)):
            raise NotImplementedError("only disjoint domains in ascending order can be concatenated")
    out = parts[0].select("lo", "hi")
    for p in parts[1:]:
        out = out.unionByName(p.select("lo", "hi"))
    return number(moc.coalesce(out, order), order)


def single_order(cells: DataFrame) -> int:
    """The one order of a frame's cells; several fail, as does none."""
    orders = [r[0] for r in cells.select("ord").distinct().limit(2).collect()]
    if len(orders) != 1:
        raise ValueError("the cells must have exactly one order")
    return orders[0]
