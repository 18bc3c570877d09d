"""The four footprint detectors. Each gives (symbol, bar_index, bar_ts, signal, direction, magnitude)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import Detect
from tickloom.functions import columns as C
from tickloom.functions import series, tables

EVENT = ("symbol", "bar_index", "bar_ts", "signal", "direction", "magnitude")


def events_of(df: DataFrame, signal: str, direction: Column | str, magnitude: Column | str) -> DataFrame:
    """The typed event frame."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select("symbol", F.col("bar_index").cast("long").alias("bar_index"), "bar_ts", F.lit(signal).alias("signal"), as_column(direction).cast("byte").alias("direction"), as_column(magnitude).cast("double").alias("magnitude"))


def extremes(bars: DataFrame, window: int, chunk: int = series.CHUNK) -> DataFrame:
    """bars with is_high and is_low: the close equals the extreme of the last `window` closes; false until the window is full."""
    got = series.rolling_extreme(bars, "close", window, "_high", "_low", chunk)
    return got.withColumns({"is_high": F.coalesce(F.col("close") == F.col("_high"), F.lit(False)), "is_low": F.coalesce(F.col("close") == F.col("_low"), F.lit(False))}).drop("_high", "_low")


def divergence_frame(bars: DataFrame, p: Detect, chunk: int = series.CHUNK) -> DataFrame:
    """bars with cum (rolling delta), sigma (its deviation over earlier bars), and cum at the last high and low before each bar."""
    wide = series.with_halo(bars, p.cum_window + p.sigma_window + p.high_window + 1, chunk)
    got = series.rolling_sum(wide, "delta", p.cum_window, "cum", chunk)
    got = series.trailing_std(got, "cum", p.sigma_window, "sigma", chunk)
    got = series.no_halo(extremes(got, p.high_window, chunk))
    return series.last_before(got, {"cum_high": (F.col("is_high"), "cum"), "cum_low": (F.col("is_low"), "cum")}, chunk)


def divergence(bars: DataFrame, p: Detect, chunk: int = series.CHUNK) -> DataFrame:
    """H1: a new extreme of price that rolling delta does not confirm by a margin of its deviation."""
    f = divergence_frame(bars, p, chunk)
    bear = f.where(F.col("is_high") & (F.col("cum") < F.col("cum_high") - p.margin * F.col("sigma")))
    bull = f.where(F.col("is_low") & (F.col("cum") > F.col("cum_low") + p.margin * F.col("sigma")))
    size = lambda other: F.try_divide(F.abs(F.col("cum") - F.col(other)), F.col("sigma"))
    return events_of(bear, "H1", F.lit(-1), size("cum_high")).unionByName(events_of(bull, "H1", F.lit(1), size("cum_low")))


def pooled_percentiles(bars: DataFrame, buckets: DataFrame, window: int, chunk: int = series.CHUNK) -> DataFrame:
    """bars with p25 and p50 over all bucket volumes of the `window` bars before each, from the first bar that has any. Volumes are pooled from one array per bar."""
    volumes = buckets.groupBy("symbol", "bar_index").agg(F.collect_list(F.col("buy_vol") + F.col("sell_vol")).alias("_v"))
    return series.pooled_ranks(bars.join(volumes, ["symbol", "bar_index"], "left"), "_v", window, {"p25": 0.25, "p50": 0.50}, chunk)


def absorption(bars: DataFrame, buckets: DataFrame, delta: float, p: Detect, chunk: int = series.CHUNK, pooled: DataFrame | None = None) -> DataFrame:
    """H2: outsized one-sided volume near a bar's edge that price has left. pooled: pooled_percentiles of the bars, where they are known."""
    pooled = pooled_percentiles(bars, buckets, p.volume_window, chunk) if pooled is None else pooled
    base = pooled.where("p50 > 0").select("symbol", "bar_index", "bar_ts", "high", "low", "close", "p50")
    b = buckets.select("symbol", "bar_index", "bucket_px", "buy_vol", "sell_vol").join(base, ["symbol", "bar_index"])
    vol, span = F.col("buy_vol") + F.col("sell_vol"), F.col("high") - F.col("low")
    large = vol >= p.multiple * F.col("p50")
    bull = (F.col("bucket_px") <= F.col("low") + p.edge * span) & (F.col("sell_vol") >= p.dominance * vol) & (F.col("close") >= F.col("bucket_px") + delta)
    bear = (F.col("bucket_px") >= F.col("high") - p.edge * span) & (F.col("buy_vol") >= p.dominance * vol) & (F.col("close") <= F.col("bucket_px") - delta)
    sides = F.array_compact(F.array(F.when(bull, 1), F.when(bear, -1)))
    hit = b.where(large).withColumn("direction", F.explode(sides)).groupBy("symbol", "bar_index", "bar_ts", "direction").agg(F.max(vol / F.col("p50")).alias("magnitude"))
    return events_of(hit, "H2", "direction", "magnitude")


def diagonal_ratios(bars: DataFrame, buckets: DataFrame, delta: float, p: Detect, chunk: int = series.CHUNK, pooled: DataFrame | None = None) -> DataFrame:
    """(symbol, bar_index, bar_ts, direction, level, ratio) of levels whose aggressors beat the other side one level off by p.ratio."""
    pooled = pooled_percentiles(bars, buckets, p.volume_window, chunk) if pooled is None else pooled
    base = pooled.where("p25 > 0").select("symbol", "bar_index", "bar_ts", "high", "low", "p25")
    lo, hi = C.level(F.col("low"), delta), C.level(F.col("high"), delta)
    b = buckets.select("symbol", "bar_index", C.grid_level(F.col("bucket_px"), delta).alias("level"), "buy_vol", "sell_vol").join(base, ["symbol", "bar_index"]).where((hi > lo) & F.col("level").between(lo, hi))
    # neighbouring rows are the diagonal only if their levels are neighbours
    w = Window.partitionBy("symbol", "bar_index").orderBy("level")
    b = b.withColumns({"below": F.when(F.lag("level").over(w) == F.col("level") - 1, F.lag("sell_vol").over(w)), "above": F.when(F.lead("level").over(w) == F.col("level") + 1, F.lead("buy_vol").over(w))})
    up, down = F.try_divide("buy_vol", "below"), F.try_divide("sell_vol", "above")
    good = lambda other, ratio: (F.col(other) >= F.col("p25")) & (F.col(other) > 0) & (ratio >= p.ratio)
    sides = F.array_compact(F.array(F.when(good("below", up), F.struct(F.lit(1).alias("direction"), up.alias("ratio"))), F.when(good("above", down), F.struct(F.lit(-1).alias("direction"), down.alias("ratio")))))
    return b.withColumn("side", F.explode(sides)).select("symbol", "bar_index", "bar_ts", "side.direction", "level", "side.ratio")


def imbalance(bars: DataFrame, buckets: DataFrame, delta: float, p: Detect, chunk: int = series.CHUNK, pooled: DataFrame | None = None) -> DataFrame:
    """H3: the longest run of neighbouring imbalanced levels, at least p.stack; of equal ones the higher mean ratio. Magnitude: length times mean."""
    flagged = diagonal_ratios(bars, buckets, delta, p, chunk, pooled)
    w = Window.partitionBy("symbol", "bar_index", "direction").orderBy("level")
    runs = flagged.withColumn("island", F.col("level") - F.row_number().over(w)).groupBy("symbol", "bar_index", "bar_ts", "direction", "island").agg(F.count("*").alias("n"), F.avg("ratio").alias("mean"), F.sum("ratio").alias("total"))
    best = runs.where(F.col("n") >= p.stack).groupBy("symbol", "bar_index", "bar_ts", "direction").agg(F.max(F.struct("n", "mean", "total")).alias("best"))
    return events_of(best, "H3", "direction", F.col("best.total"))


def exhaustion(bars: DataFrame, buckets: DataFrame, p: Detect, chunk: int = series.CHUNK) -> DataFrame:
    """H6: climax volume at a price extreme whose outermost two buckets lean the other way."""
    wide = series.with_halo(bars, max(p.climax_window, p.high_window) + 1, chunk)
    got = series.trailing_quantile(wide, "volume", p.climax_window, C.nearest_index(p.climax_window, p.climax_quantile), "climax", chunk)
    got = series.no_halo(extremes(got, p.high_window, chunk))
    some = got.where((F.col("climax") > 0) & (F.col("volume") >= F.col("climax")) & (F.col("is_high") | F.col("is_low"))).select("symbol", "bar_index", "bar_ts", "volume", "climax", "is_high", "is_low")
    near = buckets.join(some, ["symbol", "bar_index"])
    by = lambda c: Window.partitionBy("symbol", "bar_index").orderBy(c)
    near = near.withColumns({"top": F.row_number().over(by(F.col("level").desc())), "bottom": F.row_number().over(by(F.col("level").asc()))})
    lean = F.col("buy_vol") - F.col("sell_vol")
    ends = near.groupBy("symbol", "bar_index", "bar_ts", "volume", "climax", "is_high", "is_low").agg(F.sum(F.when(F.col("top") <= 2, lean)).alias("top2"), F.sum(F.when(F.col("bottom") <= 2, lean)).alias("bottom2"))
    size = lambda c: F.col("volume") / F.col("climax") * F.abs(F.col(c))
    bear, bull = ends.where("is_high and top2 < 0"), ends.where("is_low and bottom2 > 0")
    return events_of(bear, "H6", F.lit(-1), size("top2")).unionByName(events_of(bull, "H6", F.lit(1), size("bottom2")))


def detect_all(bars: DataFrame, buckets: DataFrame, delta: float, p: Detect, chunk: int = series.CHUNK) -> DataFrame:
    """All detectors' events. The pooled percentiles, which two detectors read, are written once."""
    pooled = tables.keep(pooled_percentiles(bars, buckets, p.volume_window, chunk).select("symbol", "bar_index", "bar_ts", "high", "low", "close", "p25", "p50"))
    parts = [divergence(bars, p, chunk), absorption(bars, buckets, delta, p, chunk, pooled), imbalance(bars, buckets, delta, p, chunk, pooled), exhaustion(bars, buckets, p, chunk)]
    return functools.reduce(DataFrame.unionByName, parts)
