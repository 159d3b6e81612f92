"""Column expressions on cells.

A cell is two integers: its order (0 to 29) and k, its place among the cells of that order.  k is the base
block (1 to 12) followed by two bits a level, so a parent is a shift, descendants are a range, and k always
fits a signed long.  Packed words, decimal labels and nested pixel numbers are projections of (ord, k).
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ORDER = 29
#: Deepest order whose nested numbers a double holds exactly.
EXACT_ORDER = 24
_LABEL = re.compile(r"(-?)([1-6])([1-4]{0,29})(p?)")


def _c(x: Column | str | int) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def _long(x) -> Column:
    return _c(x).cast("long")


def right(k, bits) -> Column:
    return F.call_function("shiftright", _long(k), _c(bits).cast("int"))


def left(k, bits) -> Column:
    return F.call_function("shiftleft", _long(k), _c(bits).cast("int"))


# -- hierarchy


def parent(k, ord, level) -> Column:
    """The ancestor at level; level must not be finer than ord."""
    return right(k, 2 * (_c(ord) - _c(level)))


def clip(k, ord, level) -> Column:
    """Cells finer than level are truncated to it, others stay."""
    return F.when(_c(ord) > _c(level), parent(k, ord, level)).otherwise(_long(k))


def clip_order(ord, level) -> Column:
    return F.least(_c(ord), _c(level))


def first_child(k, ord, level) -> Column:
    return left(k, 2 * (_c(level) - _c(ord)))


def last_child(k, ord, level) -> Column:
    return left(_long(k) + 1, 2 * (_c(level) - _c(ord))) - 1


def children(k, ord, level) -> Column:
    """All descendants at level, as an ascending array."""
    return F.sequence(first_child(k, ord, level), last_child(k, ord, level))


def zoom(k, ord, level: int) -> Column:
    """An array: the one ancestor, the cell itself, or all descendants at level."""
    return F.when(_c(ord) >= level, F.array(clip(k, ord, level))).otherwise(F.sequence(left(k, 2 * F.greatest(F.lit(level) - _c(ord), F.lit(0))), left(_long(k) + 1, 2 * F.greatest(F.lit(level) - _c(ord), F.lit(0))) - 1))


def low29(k, ord) -> Column:
    return first_child(k, ord, MAX_ORDER)


def high29(k, ord) -> Column:
    return last_child(k, ord, MAX_ORDER)


def base_block(k, ord) -> Column:
    return right(k, 2 * _c(ord))


def nested(k, ord) -> Column:
    """The HEALPix nested pixel number."""
    return _long(k) - left(F.lit(1), 2 * _c(ord))


def from_nested(pixel, ord) -> Column:
    return _long(pixel) + left(F.lit(1), 2 * _c(ord))


def rank_in(k, ord, level) -> Column:
    """The place of a cell among the descendants of its ancestor at level."""
    return _long(k) - first_child(parent(k, ord, level), level, ord)


# -- packed words


def word(k, ord, is_point=False) -> Column:
    """The 64-bit word (as the signed long with the same bits)."""
    k, o = _long(k), _c(ord)
    point = F.lit(is_point) if isinstance(is_point, bool) else _c(is_point)
    last, before = k.bitwiseAND(F.lit(3)), right(k, 2).bitwiseAND(F.lit(3))
    return (
        F.when(o <= 27, left(k, 60 - 2 * F.least(o, F.lit(27))).bitwiseOR(_long(o)))
        .when(o == 28, left(right(k, 2), 6).bitwiseOR(28 + 5 * last))
        .otherwise(left(right(k, 4), 6).bitwiseOR(F.when(point, 48 + 4 * before + last).otherwise(29 + 5 * before + last)))
    )


def _suffix(w) -> Column:
    return _long(w).bitwiseAND(F.lit(63))


def word_is_point(w) -> Column:
    return _suffix(w) >= 48


def word_order(w) -> Column:
    s = _suffix(w)
    return F.when(s <= 27, s).when(s >= 48, 29).when((s - 28) % 5 == 0, 28).otherwise(29).cast("int")


def word_k(w) -> Column:
    s, o = _suffix(w), word_order(w)
    high = F.call_function("shiftrightunsigned", _long(w), F.lit(6))
    area = F.floor((s - 28) / 5)
    return (
        F.when(s <= 27, F.call_function("shiftrightunsigned", _long(w), (60 - 2 * F.least(o, F.lit(27))).cast("int")))
        .when(o == 28, high * 4 + area)
        .when(s >= 48, high * 16 + (s - 48))
        .otherwise(high * 16 + area * 4 + (s - 28) % 5 - 1)
    ).cast("long")


def point_to_area(w) -> Column:
    """A point's word as the order-29 area at its place; areas stay."""
    t = _suffix(w) - 48
    area = F.shiftright(t, 2) * 5 + t.bitwiseAND(F.lit(3)) + 29
    return F.when(word_is_point(w), _long(w).bitwiseAND(F.lit(-64)).bitwiseOR(area)).otherwise(_long(w))


def area_to_point(w) -> Column:
    """An order-29 area's word as a point; any other order fails."""
    t = _suffix(w) - 28
    deep = (t >= 0) & (t < 20) & (t % 5 != 0)
    point = F.floor(t / 5) * 4 + t % 5 + 47
    return F.when(deep, _long(w).bitwiseAND(F.lit(-64)).bitwiseOR(point)).otherwise(F.raise_error(F.lit("only order-29 areas are points")).cast("long"))


# -- decimal labels


def label(k, ord, is_point=False) -> Column:
    """The decimal label: sign and base digit, then a digit of 1 to 4 a level, and p on points."""
    block = base_block(k, ord)
    digits = F.translate(F.lpad(F.conv((_long(k) - left(block, 2 * _c(ord))).cast("string"), 10, 4), _c(ord), F.lit("0")), "0123", "1234")
    point = F.lit(is_point) if isinstance(is_point, bool) else _c(is_point)
    return F.concat(F.when(block > 6, "-").otherwise(""), F.when(block > 6, block - 6).otherwise(block).cast("string"), digits, F.when(point, "p").otherwise(""))


def _digits(text) -> Column:
    return F.regexp_extract(_c(text), r"^-?[1-6]([1-4]*)p?$", 1)


def label_order(text) -> Column:
    return F.length(_digits(text))


def label_k(text) -> Column:
    t = _c(text)
    block = F.regexp_extract(t, r"^-?([1-6])", 1).cast("long") + F.when(t.startswith("-"), 6).otherwise(0)
    rest = F.coalesce(F.conv(F.when(label_order(t) > 0, F.translate(_digits(t), "1234", "0123")).otherwise("0"), 4, 10).cast("long"), F.lit(0))
    valid = t.rlike(r"^-?[1-6][1-4]{0,29}p?$")
    return F.when(valid, left(block, 2 * label_order(t)) + rest).when(t.isNotNull(), F.raise_error(F.concat(F.lit("not a cell label: "), t)))


def label_is_point(text) -> Column:
    return _c(text).endswith("p")


def label_base(text) -> Column:
    return F.regexp_extract(_c(text), r"^(-?[1-6])", 1)


def label_rank(text) -> Column:
    """The label's place among all cells of its order and base."""
    return label_k(text) - left(base_block(label_k(text), label_order(text)), 2 * label_order(text))


def rank_tail(rank, depth: int) -> Column:
    """The digits that a rank adds to its ancestor's label."""
    return F.translate(F.lpad(F.conv(_long(rank).cast("string"), 10, 4), depth, "0"), "0123", "1234")


def is_base(text) -> Column:
    return _c(text).rlike(r"^-?[1-6]$")


# -- squares


def _squeeze(x: Column) -> Column:
    for mask, shift in ((0x5555555555555555, 1), (0x3333333333333333, 2), (0x0F0F0F0F0F0F0F0F, 4), (0x00FF00FF00FF00FF, 8), (0x0000FFFF0000FFFF, 16)):
        x = x.bitwiseAND(F.lit(mask))
        x = x.bitwiseOR(right(x, shift))
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _widen(x: Column) -> Column:
    for mask, shift in ((0x0000FFFF0000FFFF, 16), (0x00FF00FF00FF00FF, 8), (0x0F0F0F0F0F0F0F0F, 4), (0x3333333333333333, 2), (0x5555555555555555, 1)):
        x = x.bitwiseOR(left(x, shift)).bitwiseAND(F.lit(mask))
    return x


def rank_row(rank) -> Column:
    """The row of a subtree's rank: its odd bits."""
    return _squeeze(right(rank, 1))


def rank_col(rank) -> Column:
    return _squeeze(_long(rank))


def rowcol_rank(row, col) -> Column:
    return left(_widen(_long(row)), 1).bitwiseOR(_widen(_long(col)))


# -- the same for single values on the driver


def cell(x: str | tuple[int, int]) -> tuple[int, int]:
    """(ord, k) of a label; pairs pass through.  A point counts as the area at its place."""
    if not isinstance(x, str):
        o, k = map(int, x)
        if not (0 <= o <= MAX_ORDER and 1 <= k >> 2 * o <= 12):
            raise ValueError(f"not a cell: {x}")
        return o, k
    if not (m := _LABEL.fullmatch(x)) or m[4] and len(m[3]) != MAX_ORDER:
        raise ValueError(f"not a cell label: {x!r}")
    k = int(m[2]) + (6 if m[1] else 0)
    for digit in m[3]:
        k = 4 * k + int(digit) - 1
    return len(m[3]), k


def cell_label(ord: int, k: int) -> str:
    block = k >> 2 * ord
    digits = "".join(str((k >> 2 * i & 3) + 1) for i in reversed(range(ord)))
    return f"{'-' if block > 6 else ''}{(block - 1) % 6 + 1}{digits}"


def cell_word(ord: int, k: int, is_point: bool = False) -> int:
    """The unsigned packed word."""
    if ord <= 27:
        return k << 60 - 2 * ord | ord
    if ord == 28:
        return (k >> 2) << 6 | 28 + 5 * (k & 3)
    t, u = k >> 2 & 3, k & 3
    return (k >> 4) << 6 | (48 + 4 * t + u if is_point else 29 + 5 * t + u)


def subtree_span(subtree, shard, level: int) -> tuple[int, int]:
    """[first, last) of a subtree among a shard's cells at level; a disjoint subtree warns and is empty."""
    (so, sk), (to, tk) = cell(shard), cell(subtree)
    if to > level or so > level:
        raise ValueError("the subtree is finer than the axis")
    first, last = sk << 2 * (level - so), (sk + 1) << 2 * (level - so)
    lo, hi = max(first, tk << 2 * (level - to)), min(last, (tk + 1) << 2 * (level - to))
    if lo >= hi:
        warnings.warn("the subtree lies outside the shard", stacklevel=2)
        return 0, 0
    return lo - first, hi - first


# -- frames


def with_parents(df: DataFrame, levels: list[int], ord: str = "ord", k: str = "k") -> DataFrame:
    """A column parent_o{level} for each level; a level finer than a cell fails."""
    for level in levels:
        if not 0 <= level <= MAX_ORDER:
            raise ValueError(f"no such order: {level}")
        finer = F.raise_error(F.concat(F.lit(f"order {level} is finer than order "), F.col(ord).cast("string")))
        df = df.withColumn(f"parent_o{level}", F.when(F.col(ord) < level, finer.cast("long")).otherwise(parent(k, ord, F.lit(level))))
    return df


def fabricate(df: DataFrame, level: int | None = None, ord: str = "ord", k: str = "k") -> DataFrame:
    """cell_ids, the nested number of each cell; points (is_point) are truncated to order 24.

    Nested numbers mean nothing without their one order: areas of several orders fail, as do others than level if given.
    """
    if level is not None and level > EXACT_ORDER:
        warnings.warn(f"nested numbers above order {EXACT_ORDER} are not exact as doubles", stacklevel=2)
    if "is_point" in df.columns:
        return df.withColumn("cell_ids", F.when(F.col("is_point"), nested(right(k, 10), F.lit(24))).otherwise(nested(k, ord)))
    if level is None:
        orders = [r[0] for r in df.select(ord).distinct().limit(2).collect()]
        if len(orders) > 1:
            raise ValueError("cells of several orders have no common numbers")
        level = orders[0] if orders else 0
    other = F.raise_error(F.concat(F.lit(f"a cell is not of order {level}: "), F.col(ord).cast("string"))).cast("long")
    return df.withColumn("cell_ids", F.when(F.col(ord) == level, nested(k, ord)).otherwise(other))
