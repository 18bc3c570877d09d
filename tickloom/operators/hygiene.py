"""Event hygiene, in this order: quarantine, warm-up, greedy de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import series


def warm(events: DataFrame, bars: int) -> DataFrame:
    return events.where(F.col("bar_index") >= bars)


def deduplicated(events: DataFrame, gap: int, chunk: int = series.CHUNK) -> DataFrame:
    """Per symbol, signal and direction, an event stays if it is more than `gap` bars after the last that stayed.

    An event more than `gap` after the one before it stays whatever came
    earlier, so the series falls into islands that start there; each is folded
    by itself.
    """
    keyed = events.withColumn("_row", F.struct(*events.columns)).select(F.concat_ws("|", "symbol", "signal", F.col("direction").cast("string")).alias("symbol"), "bar_index", "_row")
    wide = series.with_halo(keyed, gap + 1, chunk)
    before = F.lag("bar_index").over(series.order())
    marked = series.no_halo(wide.withColumn("_start", before.isNull() | (F.col("bar_index") - before > gap)))
    marked = series.last_before(marked, {"_island": (F.col("_start"), "bar_index")}, chunk, inclusive=True)
    islands = marked.groupBy("symbol", "_island").agg(F.array_sort(F.collect_list("bar_index")).alias("_bars"))
    far = lambda kept, x: F.coalesce(x - F.element_at(kept, -1) > gap, F.lit(True))
    fold = F.aggregate("_bars", F.array().cast("array<long>"), lambda kept, x: F.when((F.size(kept) == 0) | far(F.when(F.size(kept) > 0, kept), x), F.concat(kept, F.array(x))).otherwise(kept))
    kept = islands.select("symbol", F.explode(fold).alias("bar_index"))
    return marked.join(kept, ["symbol", "bar_index"], "left_semi").select("_row.*")


def hygiene(events: DataFrame, warmup: int, gap: int, chunk: int = series.CHUNK) -> DataFrame:
    return deduplicated(warm(events, warmup), gap, chunk)


def _days(lo, hi):
    day = lambda c: F.floor(c / 86_400_000).cast("long")
    return F.explode(F.sequence(day(lo), day(hi)))


def _overlapping(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct `key` of spans (key, symbol, lo, hi) that overlap a window strictly at both ends. They meet by day, so no pair is looked at whose days differ."""
    a = spans.withColumn("_day", _days(F.col("lo"), F.col("hi")))
    b = windows.select("symbol", "start_ms", "end_ms").withColumn("_day", _days(F.col("start_ms"), F.col("end_ms")))
    return a.join(b, ["symbol", "_day"]).where((F.col("lo") < F.col("end_ms")) & (F.col("hi") > F.col("start_ms"))).select("key").distinct()


def outside_windows(spans: DataFrame, windows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of spans (symbol, lo, hi, and the columns of key) whose span overlaps no window; without lo and hi."""
    hit = _overlapping(spans.select(F.struct(*key).alias("key"), "symbol", "lo", "hi").distinct(), windows).select("key.*")
    return spans.drop("lo", "hi").join(hit, key, "left_anti")


def outside_quarantine(events: DataFrame, windows: DataFrame, bar_ms: int) -> DataFrame:
    """Events whose bar overlaps no window (symbol, start_ms, end_ms)."""
    ms = F.unix_millis("bar_ts")
    return outside_windows(events.select("*", ms.alias("lo"), (ms + bar_ms).alias("hi")), windows, ["symbol", "bar_index"])


def null_quarantined_returns(events: DataFrame, windows: DataFrame, horizons: tuple[int, ...], start_ms: int, bar_ms: int) -> DataFrame:
    """r_h becomes null where [open of t+1, end of bar t+1+h) overlaps a window; other horizons stay."""
    at = lambda n: F.lit(start_ms) + (F.col("bar_index") + n) * bar_ms
    spans = events.select("symbol", "bar_index", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("h")).distinct()
    spans = spans.select(F.struct("symbol", "bar_index", "h").alias("key"), "symbol", at(1).alias("lo"), (at(1) + (F.col("h") + 1) * bar_ms).alias("hi"))
    hit = _overlapping(spans, windows).groupBy("key.symbol", "key.bar_index").agg(F.collect_set("key.h").alias("_hit"))
    wide = events.join(hit, ["symbol", "bar_index"], "left")
    return wide.withColumns({f"r_{h}": F.when(~F.coalesce(F.array_contains("_hit", h), F.lit(False)), F.col(f"r_{h}")) for h in horizons}).drop("_hit")
