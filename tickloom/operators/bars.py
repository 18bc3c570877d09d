"""Bars and footprint buckets: aggregate, fill to a continuous grid, re-aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.config import Study
from tickloom.functions import columns as C
from tickloom.functions import series

BAR = ("symbol", "bar_index", "bar_ts", "bar_ts_ms", "open", "high", "low", "close", "volume", "delta", "cumulative_delta", "trade_count")


def _keyed(trades: DataFrame, study: Study) -> DataFrame:
    bought, sold = C.aggressor(F.col("quantity"), F.col("is_buyer_maker"))
    return trades.select("symbol", C.bar_key(F.col("transact_time"), study.bar_ms).alias("bar_ts_ms"), C.level(F.col("price"), study.delta).alias("level"), "price", "quantity", "transact_time", "agg_trade_id", bought.alias("bought"), sold.alias("sold"))


def partial_bars(trades: DataFrame, study: Study) -> DataFrame:
    """Bars with trades: first and last price by (time, id), extremes, volume, bought less sold, count."""
    at = F.struct("transact_time", "agg_trade_id")
    return _keyed(trades, study).groupBy("symbol", "bar_ts_ms").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("quantity").alias("volume"), (F.sum("bought") - F.sum("sold")).alias("delta"), F.count("*").alias("trade_count"),
    )


def partial_buckets(trades: DataFrame, study: Study) -> DataFrame:
    """Volume by bar and price bucket."""
    got = _keyed(trades, study).groupBy("symbol", "bar_ts_ms", "level").agg(F.sum("bought").alias("buy_vol"), F.sum("sold").alias("sell_vol"), F.count("*").alias("trade_count"))
    return got.withColumn("bucket_px", F.col("level") * F.lit(study.delta))


def grid(symbols: DataFrame, study: Study) -> DataFrame:
    """Every bar of the study for each symbol, numbered from 0."""
    bars = symbols.sparkSession.range(study.n_bars).select(F.col("id").alias("bar_index"), (F.lit(study.start_ms) + F.col("id") * study.bar_ms).alias("bar_ts_ms"))
    # a handful of symbols is named in an array, so that the grid is exploded and not joined
    names = symbols.select("symbol").distinct().agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))
    return bars.join(F.broadcast(names)).select(F.explode("symbols").alias("symbol"), "bar_index", "bar_ts_ms")


def finalise(partial: DataFrame, study: Study, chunk: int = series.CHUNK) -> DataFrame:
    """The continuous grid: empty bars take the last close for all prices and zero for all sums; delta adds up over the series. Bars before the first trade have null prices."""
    wide = grid(partial, study).join(partial, ["symbol", "bar_ts_ms"], "left")
    filled = series.forward_filled(wide, "close", "_close", chunk)
    prices = {c: F.coalesce(c, "_close") for c in ("open", "high", "low", "close")}
    sums = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("volume", "delta")}
    filled = filled.withColumns(prices | sums | {"trade_count": F.coalesce(F.col("trade_count"), F.lit(0).cast("long")), "bar_ts": C.from_ms(F.col("bar_ts_ms"))}).drop("_close")
    return series.running_sum(filled, "delta", "cumulative_delta", chunk).select(*BAR)


def index_buckets(partial: DataFrame, study: Study) -> DataFrame:
    """Buckets on the grid with their bar's number, by arithmetic instead of a join; others are dropped."""
    at = F.col("bar_ts_ms") - study.start_ms
    on = (at >= 0) & (F.col("bar_ts_ms") <= study.end_ms) & (at % study.bar_ms == 0)
    return partial.where(on).select("symbol", F.floor(at / study.bar_ms).cast("long").alias("bar_index"), "bar_ts_ms", "level", "bucket_px", "buy_vol", "sell_vol", "trade_count")


def rebucket(buckets: DataFrame, new: float, old: float) -> DataFrame:
    """Coarser price buckets; new must be a whole multiple of old."""
    if new < old or abs(new / old - round(new / old)) > 1e-9:
        raise ValueError(f"{new} is no multiple of {old}")
    got = buckets.groupBy("symbol", "bar_index", "bar_ts_ms", C.level(F.col("bucket_px"), new).alias("level")).agg(*[F.sum(c).alias(c) for c in ("buy_vol", "sell_vol", "trade_count")])
    return got.withColumn("bucket_px", F.col("level") * F.lit(float(new)))


def rebar(bars: DataFrame, buckets: DataFrame, new_ms: int, old_ms: int, chunk: int = series.CHUNK) -> tuple[DataFrame, DataFrame]:
    """Coarser bars and their buckets; new must be a whole multiple of old. Numbers start anew and delta adds up anew."""
    if new_ms < old_ms or new_ms % old_ms:
        raise ValueError(f"{new_ms} is no multiple of {old_ms}")
    ratio = new_ms // old_ms
    key = C.bar_key(F.col("bar_ts_ms"), new_ms)
    merged = bars.groupBy("symbol", key.alias("bar_ts_ms")).agg(
        F.min_by("open", "bar_index").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_index").alias("close"),
        F.sum("volume").alias("volume"), F.sum("delta").alias("delta"), F.sum("trade_count").alias("trade_count"),
    )
    first = bars.groupBy("symbol").agg(F.min(key).alias("_start"))
    merged = merged.join(F.broadcast(first), "symbol").withColumn("bar_index", F.floor((F.col("bar_ts_ms") - F.col("_start")) / new_ms).cast("long")).withColumn("bar_ts", C.from_ms(F.col("bar_ts_ms")))
    out = series.running_sum(merged, "delta", "cumulative_delta", max(1, chunk // ratio)).select(*BAR)
    moved = buckets.join(F.broadcast(first), "symbol").withColumn("bar_ts_ms", key)
    moved = moved.groupBy("symbol", F.floor((F.col("bar_ts_ms") - F.col("_start")) / new_ms).cast("long").alias("bar_index"), "bar_ts_ms", "level", "bucket_px").agg(*[F.sum(c).alias(c) for c in ("buy_vol", "sell_vol", "trade_count")])
    return out, moved


def conservation(bars: DataFrame, buckets: DataFrame) -> DataFrame:
    """Per symbol: volume, delta and trades of bars less those of buckets."""
    a = bars.groupBy("symbol").agg(F.sum("volume").alias("v"), F.sum("delta").alias("d"), F.sum("trade_count").alias("n"))
    b = buckets.groupBy("symbol").agg(F.sum(F.col("buy_vol") + F.col("sell_vol")).alias("bv"), F.sum(F.col("buy_vol") - F.col("sell_vol")).alias("bd"), F.sum("trade_count").alias("bn"))
    return a.join(b, "symbol", "left").select("symbol", (F.col("v") - F.col("bv")).alias("volume_gap"), (F.col("d") - F.col("bd")).alias("delta_gap"), (F.col("n") - F.col("bn")).alias("trade_gap"))
