"""Packed 64-bit words of instants and time ranges, on a nanosecond scale that starts in 1850."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from the scale's start to 1970, and the leap seconds that the known words carry.
EPOCH_DAYS, LEAP_SECONDS = 43_829, 18
OFFSET_NS = (EPOCH_DAYS * 86_400 + LEAP_SECONDS) * 10**9
_LOW31 = (1 << 31) - 1


def instant_ns(ts: Column) -> Column:
    """Nanoseconds on the internal scale of a timestamp."""
    return F.unix_micros(ts.cast("timestamp")) * 1000 + F.lit(OFFSET_NS)


def instant_word(t: Column) -> Column:
    """The word of an exact instant: its upper bits, a set flag, its lower 31 bits."""
    high = F.shiftright(t, 31)
    return F.shiftleft(high, 32).bitwiseOR(F.lit(1 << 31)).bitwiseOR(t.bitwiseAND(F.lit(_LOW31)))


def range_word(start: Column, end: Column) -> Column:
    """The word of [start, end): start is floored to 2**31 ns, end raised to the next 2**32 ns."""
    return F.shiftleft(F.shiftright(start, 31), 32).bitwiseOR((F.shiftright(end, 32) + 1).bitwiseAND(F.lit(_LOW31)))


def is_instant(w: Column) -> Column:
    return F.shiftrightunsigned(w, 31).bitwiseAND(F.lit(1)) == 1


def start_ns(w: Column) -> Column:
    base = F.shiftleft(F.shiftrightunsigned(w, 32), 31)
    return F.when(is_instant(w), base.bitwiseOR(w.bitwiseAND(F.lit(_LOW31)))).otherwise(base)


def end_ns(w: Column) -> Column:
    """The exclusive end; an instant lasts one nanosecond."""
    return F.when(is_instant(w), start_ns(w) + 1).otherwise(F.shiftleft(w.bitwiseAND(F.lit(_LOW31)), 32))


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return (start_a < end_b) & (start_b < end_a)


def query_span(when) -> tuple[int, int]:
    """[start, end) in internal nanoseconds of a pair, or of one instant; empty and reversed queries fail."""
    if isinstance(when, int):
        return when, when + 1
    start, end = when
    if end <= start:
        raise ValueError("the time query is empty or reversed")
    return int(start), int(end)
