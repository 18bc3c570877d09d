"""Order-book continuity: snapshot sync, gap counting, in batch and as a stateful stream; live bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import series

LEVELS = "array<array<string>>"
CHECKED = "symbol string, n_events long, n_stale long, n_gaps long, last_u long"


def levels(text):
    """Book levels from JSON text as (price, quantity) structs."""
    return F.transform(F.from_json(text, LEVELS), lambda x: F.struct(F.get(x, 0).cast("double").alias("px"), F.get(x, 1).cast("double").alias("qty")))


def sync_point(events: DataFrame, last_id: int) -> DataFrame:
    """The ordinal of the first event with first_id <= last_id + 1 <= its last_id, per symbol; no row if there is none."""
    return events.where((F.col("first_id") <= last_id + 1) & (F.col("last_id") >= last_id + 1)).groupBy("symbol").agg(F.min("ordinal").alias("sync_ordinal"))


def continuity(events: DataFrame, stretch: int = 100_000) -> DataFrame:
    """events with continuous: pu, the predecessor that it names, is the last_id before; the first is continuous. Stretches of ordinals carry their last id over, so no symbol is one task."""
    got = series.previous(events, "last_id", "ordinal", "_before", stretch)
    return got.withColumn("continuous", F.coalesce(F.col("pu") == F.col("_before"), F.lit(True))).drop("_before")


def checked_stream(events: DataFrame, snapshot_id: int) -> DataFrame:
    """Running continuity of a stream (symbol, ordinal, first_id, last_id, pu): stale events (last_id <= snapshot) are dropped, recording starts at the sync point, gaps are counted and never repaired. One row per symbol and batch."""

    def step(key, frames, state):
        import pandas as pd

        n, stale, gaps, last = state.get if state.exists else (0, 0, 0, -1)
        for pdf in frames:
            for r in pdf.sort_values("ordinal").itertuples():
                if r.last_id <= snapshot_id or (last < 0 and not r.first_id <= snapshot_id + 1 <= r.last_id):
                    stale += 1
                    continue
                gaps += last >= 0 and r.pu != last
                n, last = n + 1, int(r.last_id)
        state.update((n, stale, int(gaps), last))
        yield pd.DataFrame({"symbol": [key[0]], "n_events": [n], "n_stale": [stale], "n_gaps": [int(gaps)], "last_u": [last]})

    return events.groupBy("symbol").applyInPandasWithState(step, CHECKED, "n long, stale long, gaps long, last long", "update", "NoTimeout")


def live_bars(trades: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Tumbling bars of a trade stream with a `ts` column; an extension beyond the batch study. A bar is final once the watermark has passed it."""
    at = F.struct("transact_time", "agg_trade_id")
    return trades.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"), F.count("*").alias("trade_count")
    ).select("symbol", F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "volume", "trade_count")
