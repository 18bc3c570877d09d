"""Forward returns from the next bar's open, study segments and the purge at their border."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.config import Study
from tickloom.functions import columns as C
from tickloom.functions import series


def looking_ahead(bars: DataFrame, study: Study, chunk: int = series.CHUNK) -> DataFrame:
    """(symbol, bar_index, f_h..., last_ms): log of open[t+1+h] over open[t+1], null out of range; the start of the longest target's bar."""
    longest = max(study.horizons) + 1
    # the halo lies ahead here: bars are numbered backwards for the cut
    top = study.n_bars - 1
    back = bars.select("symbol", (F.lit(top) - F.col("bar_index")).alias("bar_index"), F.col("bar_index").alias("_t"), "open", "bar_ts_ms")
    wide = series.with_halo(back, longest, chunk)
    w = series.order()
    ahead = lambda c, n: F.lag(c, n).over(w)
    entry = ahead("open", 1)
    cols = {f"f_{h}": F.when((entry > 0) & (ahead("open", 1 + h) > 0), F.ln(ahead("open", 1 + h) / entry)) for h in study.horizons}
    return series.no_halo(wide.withColumns(cols | {"last_ms": ahead("bar_ts_ms", longest)})).select("symbol", F.col("_t").alias("bar_index"), *cols, "last_ms")


def add_forward_returns(events: DataFrame, bars: DataFrame, study: Study, chunk: int = series.CHUNK) -> DataFrame:
    """events with r_h (signed by direction), segment, and purge_ok: the longest target exists and lies in the event's segment."""
    got = events.join(looking_ahead(bars, study, chunk), ["symbol", "bar_index"], "left")
    seg = C.segment(F.unix_millis("bar_ts"), study)
    cols = {f"r_{h}": F.col("direction") * F.col(f"f_{h}") for h in study.horizons}
    ok = F.coalesce(seg == C.segment(F.col("last_ms"), study), F.lit(False))
    return got.withColumns(cols | {"segment": seg, "purge_ok": ok}).select(*events.columns, *cols, "segment", "purge_ok")


def in_sample(returns: DataFrame) -> DataFrame:
    return returns.where((F.col("segment") == "IS") & F.col("purge_ok"))


def long_form(returns: DataFrame, study: Study) -> DataFrame:
    """One row per event and horizon with a return: (symbol, signal, h, bar_index, bar_ts, day, magnitude, r)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"r_{h}").alias("r")) for h in study.horizons]))
    wide = returns.withColumn("_p", pairs).where(F.col("_p.r").isNotNull())
    return wide.select("symbol", "signal", "_p.h", "bar_index", "bar_ts", C.day_of(F.unix_millis("bar_ts")).alias("day"), "magnitude", "_p.r")
