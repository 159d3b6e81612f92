"""Words of eight unsigned byte lanes: shares of a cell's count by surface and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANES = ("land", "ocean", "sea_ice", "land_ice", "inland_water", "low", "med", "high")
EXACT = 1 << 53


def lane(w: Column, i: int) -> Column:
    return F.call_function("shiftrightunsigned", w.cast("long"), F.lit(8 * i)).bitwiseAND(F.lit(255)).cast("smallint")


def lanes(w: Column) -> Column:
    """The eight lanes, least significant first."""
    return F.array(*[lane(w, i) for i in range(8)])


def named(w: Column) -> Column:
    return F.struct(*[lane(w, i).alias(x) for i, x in enumerate(LANES)])


def present(w: Column) -> Column:
    return F.transform(lanes(w), lambda x: x > 0)


def counts(w: Column, n: Column) -> Column:
    """Each lane's count out of n, rounded half to even; a negative n counts as 0."""
    total = F.greatest(n, F.lit(0))
    exact = F.when(total > EXACT, F.raise_error(F.lit("n is too large to be exact")).cast("double")).otherwise(total.cast("double"))
    return F.transform(lanes(w), lambda x: F.rint(x * exact / 255).cast("long"))


def pack(parts: list[Column], n: Column) -> Column:
    """The word of eight counts out of n: rounded half to even, at least 1 where the count is not 0."""
    one = lambda c: F.when(c > 0, F.greatest(F.rint(255 * c / n), F.lit(1.0))).otherwise(0.0).cast("long")
    out = F.lit(0).cast("long")
    for i, c in enumerate(parts):
        out = out.bitwiseOR(F.call_function("shiftleft", one(c), F.lit(8 * i)))
    return out


def check_declaration(attrs: dict) -> dict:
    """The lanes' declaration, or an error: exact lane names, a base variable, an integer threshold, fill 0."""
    if tuple(attrs.get("lanes", ())) != LANES:
        raise ValueError("the lanes are not the eight known ones, in order")
    if not isinstance(attrs.get("of"), str) or not attrs["of"]:
        raise ValueError("the declaration names no base variable")
    if not isinstance(attrs.get("threshold"), int) or isinstance(attrs["threshold"], bool):
        raise ValueError("the threshold is not an integer")
    if attrs.get("fill_value", 0) != 0:
        raise ValueError("the fill value must be 0")
    return attrs
