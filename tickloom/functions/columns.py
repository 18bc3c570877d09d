"""Scalar column expressions: time units, bar and bucket keys, calendar fields, safe ratios, seeds."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.config import DAY_MS, Study


def bar_key(ms: Column, bar_ms: int) -> Column:
    """Floor to the bar, also below zero."""
    return ms - F.pmod(ms, F.lit(bar_ms))


def level(price: Column, delta: float) -> Column:
    """Number of the price bucket on the absolute grid."""
    return F.floor(price / F.lit(delta)).cast("long")


def bucket_price(price: Column, delta: float) -> Column:
    return F.floor(price / F.lit(delta)).cast("double") * F.lit(delta)


def grid_level(price: Column, delta: float) -> Column:
    """Level of a price that lies on the grid already."""
    return F.round(price / F.lit(delta)).cast("long")


def aggressor(quantity: Column, is_buyer_maker: Column) -> tuple[Column, Column]:
    """(bought, sold) by the side that crossed the spread: a buyer who is maker was sold to."""
    return F.when(~is_buyer_maker, quantity).otherwise(0.0), F.when(is_buyer_maker, quantity).otherwise(0.0)


def from_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def day_of(ms: Column) -> Column:
    return floor_div(ms, DAY_MS)


def half_year(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("H"), F.when(F.month(ts) <= 6, "1").otherwise("2"))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def pct_diff(a: Column, b: Column) -> Column:
    """(a - b) / b in percent; null where b is 0."""
    return F.try_divide(a - b, b) * 100


def time_unit(stamp: Column) -> Column:
    """Unit of an epoch stamp by its digits: at most 10 s, 13 ms, 16 us, else ns."""
    digits = F.length(F.abs(stamp).cast("string"))
    return F.when(digits <= 10, "s").when(digits <= 13, "ms").when(digits <= 16, "us").otherwise("ns")


def to_ms(stamp: Column, unit: Column) -> Column:
    return F.when(unit == "s", stamp * 1000).when(unit == "ms", stamp).when(unit == "us", floor_div(stamp, 1000)).otherwise(floor_div(stamp, 1_000_000)).cast("long")


def floor_div(a: Column, b: int) -> Column:
    """Whole floor division of longs, without a detour over doubles."""
    return F.call_function("div", a - F.pmod(a, F.lit(b).cast("long")), F.lit(b).cast("long"))


def segment(ms: Column, study: Study) -> Column:
    return F.when(ms.between(study.start_ms, study.is_end_ms), "IS").when(ms.between(study.oos_start_ms, study.end_ms), "OOS")


def looks_like_header(line: Column) -> Column:
    """Whether a CSV line's first field is no number."""
    first = F.regexp_replace(F.trim(F.element_at(F.split(line, ","), 1)), '^-', "")
    return ~F.regexp_replace(first, r"\.", "").rlike(r"^\d+$") | (F.length(first) - F.length(F.regexp_replace(first, r"\.", "")) > 1)


def seed_of(*parts: Column) -> Column:
    """crc32 of the parts joined by a pipe, below 2**31."""
    return F.crc32(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")) % F.lit(1 << 31)


def stable_seed(*parts) -> int:
    """seed_of for plain values."""
    return zlib.crc32("|".join(map(str, parts)).encode()) % (1 << 31)


def rank_index(n: Column, p: float) -> Column:
    """0-based rank of the pooled percentile: min(int(p n), n - 1)."""
    return F.least(F.floor(n * p), n - 1).cast("int")


def nearest_index(n: int, p: float) -> int:
    """0-based rank of the rolling quantile: (n - 1) p rounded half up."""
    return int((n - 1) * p + 0.5)
