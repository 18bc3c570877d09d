"""The event study and its sensitivity grid, from bars to promoted signals."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import SIGNALS, Detect, Study
from tickloom.functions import columns as C
from tickloom.functions import series, tables
from tickloom.operators import bars as B
from tickloom.operators import detectors, hygiene, returns, stats


class Stages:
    """Events after each step of hygiene. Each is written once, when it is first asked for."""

    def __init__(self, bars: DataFrame, buckets: DataFrame, windows: DataFrame, study: Study, chunk: int = series.CHUNK):
        self.bars, self.buckets, self.windows, self.study, self.chunk = bars, buckets, windows, study, chunk

    @cached_property
    def raw(self) -> DataFrame:
        return tables.keep(detectors.detect_all(self.bars, self.buckets, self.study.delta, self.study.detect, self.chunk))

    @cached_property
    def clear(self) -> DataFrame:
        return hygiene.outside_quarantine(self.raw, self.windows, self.study.bar_ms).select(*detectors.EVENT)

    @cached_property
    def warm(self) -> DataFrame:
        return tables.keep(hygiene.warm(self.clear, self.study.warmup))

    @cached_property
    def kept(self) -> DataFrame:
        return tables.keep(hygiene.deduplicated(self.warm, self.study.gap, self.chunk))


def prepared(trades: DataFrame, study: Study, chunk: int = series.CHUNK) -> tuple[DataFrame, DataFrame]:
    """(bars, buckets) of the study, written for the several steps that read them; they are far smaller than the trades."""
    bars, buckets = tables.keep_all(B.finalise(B.partial_bars(trades, study), study, chunk), B.index_buckets(B.partial_buckets(trades, study), study))
    return bars, buckets


def staged_events(bars: DataFrame, buckets: DataFrame, windows: DataFrame, study: Study, chunk: int = series.CHUNK) -> Stages:
    return Stages(bars, buckets, windows, study, chunk)


def funnel(s: Stages) -> DataFrame:
    """Events by stage, signal and direction."""
    parts = [d.select(F.lit(n).alias("stage"), "signal", "direction") for n, d in (("raw", s.raw), ("quarantine", s.clear), ("warmup", s.warm), ("dedup", s.kept))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("stage", "signal", "direction").agg(F.count("*").alias("n"))


def half_year_table(events: DataFrame, periods: list[str]) -> DataFrame:
    """Events by signal and half-year, a column for each period in the given order, absent ones 0."""
    return events.withColumn("period", C.half_year(F.col("bar_ts"))).groupBy("signal").pivot("period", periods).agg(F.count("signal")).na.fill(0)


def in_sample_share(events: DataFrame, study: Study) -> DataFrame:
    """Per signal the share of events in sample, beside the calendar's share."""
    ms = F.unix_millis("bar_ts")
    calendar = (study.is_end_ms - study.start_ms + 1) / (study.end_ms - study.start_ms + 1)
    return events.groupBy("signal").agg((F.count_if(ms <= study.is_end_ms) / F.count("*")).alias("share")).withColumn("calendar_share", F.lit(calendar))


def returns_of(s: Stages, bars: DataFrame, windows: DataFrame, study: Study, chunk: int = series.CHUNK) -> DataFrame:
    got = tables.keep(returns.add_forward_returns(s.kept, bars, study, chunk))
    return hygiene.null_quarantined_returns(got, windows, study.horizons, study.start_ms, study.bar_ms)


def cells(long: DataFrame, study: Study, label: str = "base", picks: stats.Picks = stats.random_picks) -> DataFrame:
    """The family of cells with bootstrap, correlation, false-discovery control and derived columns."""
    got = stats.bootstrap_means(long, study.reps, label, picks).join(stats.bootstrap_spearman(long, study.ic_reps, label + "-ic", picks), list(stats.CELL), "left")
    return stats.derived(stats.fdr(stats.every_cell(tables.keep(got), study), study.q), study.reps)


def seed_invariance(long: DataFrame, study: Study, labels: tuple[str, ...] = ("base", "base-seed2", "base-seed3"), picks: stats.Picks = stats.random_picks) -> DataFrame:
    """(symbol, seed, significant, matches): the significant cells under each seed, and whether they are those under the first."""
    out = None
    cell = F.struct("signal", "h")
    for label in labels:
        family = stats.fdr(stats.every_cell(tables.keep(stats.bootstrap_means(long, study.reps, label, picks)), study), study.q)
        part = family.groupBy("symbol").agg(F.array_sort(F.collect_list(F.when(F.col("significant"), cell))).alias("significant")).withColumn("seed", F.lit(label))
        out = part if out is None else out.unionByName(part)
    first = out.where(F.col("seed") == labels[0]).select("symbol", F.col("significant").alias("_first"))
    return out.join(first, "symbol").select("symbol", "seed", "significant", (F.col("significant") == F.col("_first")).alias("matches"))


def promoted(long: DataFrame, study: Study, picks: stats.Picks = stats.random_picks) -> DataFrame:
    return stats.promotion(cells(long, study, picks=picks), stats.year_signs(long, study), study)


def best_cell(table: DataFrame, p: float = 0.05) -> DataFrame:
    """The nominally significant cell with the greatest mean."""
    return table.where(F.col("p_value") < p).orderBy(F.col("mean").desc(), "symbol", "signal", "h").limit(1)


def figure_cutoff(events: DataFrame, bars: DataFrame, study: Study) -> DataFrame:
    """In-sample events whose longest horizon ends in sample, with their bar's close, for plotting. A later event in the result would be a leak and raises."""
    ms, limit = F.unix_millis("bar_ts"), study.is_end_ms - max(study.horizons) * study.bar_ms
    early = events.where(ms < limit)
    sure = early.withColumn("bar_ts", F.when(ms < limit, F.col("bar_ts")).otherwise(F.raise_error(F.lit("an event beyond the cutoff")).cast("timestamp")))
    return sure.join(bars.select("symbol", "bar_index", "close"), ["symbol", "bar_index"])


def figure_price(bars: DataFrame, events: DataFrame, start_ms: int, width_ms: int) -> DataFrame:
    """The price figure's rows: every bar of a stretch with its close and cumulative delta, and the signals that fire on it."""
    fired = events.groupBy("symbol", "bar_index").agg(F.array_sort(F.collect_set("signal")).alias("signals"))
    some = bars.where((F.col("bar_ts_ms") >= start_ms) & (F.col("bar_ts_ms") < start_ms + width_ms)).select("symbol", "bar_index", "bar_ts", "close", "cumulative_delta")
    return some.join(fired, ["symbol", "bar_index"], "left")


def figure_paths(events: DataFrame, bars: DataFrame, study: Study, before: int, after: int) -> DataFrame:
    """The event-path figure's rows: per symbol, signal and bar offset the mean signed log price against the event's close, and its events."""
    steps = events.select("symbol", "signal", "direction", "bar_index", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")).withColumn("_at", F.col("bar_index") + F.col("offset"))
    price = bars.where("close > 0").select("symbol", F.col("bar_index").alias("_at"), F.ln("close").alias("_p"))
    here = price.select("symbol", F.col("_at").alias("bar_index"), F.col("_p").alias("_0"))
    got = steps.join(price, ["symbol", "_at"]).join(here, ["symbol", "bar_index"])
    return got.groupBy("symbol", "signal", "offset").agg(F.avg(F.col("direction") * (F.col("_p") - F.col("_0"))).alias("path"), F.count("*").alias("n"))


def figure_bars(cells: DataFrame, study: Study) -> DataFrame:
    """The cell figure's rows: means and intervals in basis points, beside the round trip's cost."""
    bp = {c: F.col(c) * 1e4 for c in ("mean", "ci_low", "ci_high")}
    return cells.select(*stats.CELL, *[v.alias(f"{k}_bp") for k, v in bp.items()], F.lit(study.round_trip * 1e4).alias("cost_bp"))


def figure_footprint(buckets: DataFrame, bar_index: int, around: int) -> DataFrame:
    """The footprint figure's rows: buckets of the bars around one, with their net volume."""
    near = buckets.where(F.col("bar_index").between(bar_index - around, bar_index + around))
    return near.select("symbol", "bar_index", "bucket_px", "buy_vol", "sell_vol", (F.col("buy_vol") - F.col("sell_vol")).alias("net"))


def first_full_window(events: DataFrame, width_ms: int) -> DataFrame:
    """The earliest event time from which every signal occurs within width_ms. Stretches of that width meet the next one's events, so no symbol is one task."""
    ms = F.unix_millis("bar_ts")
    at = F.floor(ms / width_ms).cast("long")
    copies = F.explode(F.array(F.struct(at.alias("part"), F.lit(True).alias("own")), F.struct((at - 1).alias("part"), F.lit(False).alias("own"))))
    wide = events.select("symbol", "signal", ms.alias("ms"), copies.alias("c")).select("symbol", "signal", "ms", "c.*")
    w = Window.partitionBy("symbol", "part").orderBy("ms").rangeBetween(0, width_ms - 1)
    marked = wide.withColumn("kinds", F.size(F.collect_set("signal").over(w)))
    return marked.where(F.col("own") & (F.col("kinds") == len(SIGNALS))).groupBy("symbol").agg(F.min("ms").alias("start_ms"))


def scaled(d: Detect, ratio: float) -> Detect:
    """Windows rescaled to bars `ratio` times as long; thresholds stay."""
    names = ("cum_window", "sigma_window", "high_window", "volume_window", "climax_window")
    return replace(d, **{n: max(2, round(getattr(d, n) / ratio)) for n in names})


def variant(study: Study, bar_ms: int | None = None, delta: float | None = None) -> Study:
    bar_ms, delta = bar_ms or study.bar_ms, delta or study.delta
    ratio = bar_ms / study.bar_ms
    return replace(study, bar_ms=bar_ms, delta=delta, warmup=round(study.warmup / ratio), gap=max(1, round(study.gap / ratio)), detect=scaled(study.detect, ratio))


def sensitivity(bars: DataFrame, buckets: DataFrame, study: Study, variants: dict[str, Study], chunk: int = series.CHUNK, picks: stats.Picks = stats.random_picks) -> DataFrame:
    """Every cell of every variant that whole multiples of bars or buckets give: re-aggregated, detected, warmed, de-duplicated; no quarantine.

    (config, symbol, signal, h, n, mean, se, t, ci_low, ci_high, n_raw, n_final): the
    day-cluster bootstrap of grid_reps replicates seeded by variant, and the
    signal's events as detected and as kept. Absent cells have n 0 and nulls.
    """
    out, symbols = None, bars.select("symbol").distinct()
    for name, v in variants.items():
        b, k = bars, buckets
        if v.delta != study.delta:
            k = B.rebucket(k, v.delta, study.delta)
        if v.bar_ms != study.bar_ms:
            b, k = B.rebar(b, k, v.bar_ms, study.bar_ms, chunk)
            b = tables.keep(b)
        if k is not buckets:
            k = tables.keep(k)
        raw = tables.keep(detectors.detect_all(b, k, v.delta, v.detect, chunk))
        events = tables.keep(hygiene.hygiene(raw, v.warmup, v.gap, chunk))
        long = tables.keep(returns.long_form(returns.in_sample(returns.add_forward_returns(events, b, v, chunk)), v))
        part = stats.spread(stats.every_cell(stats.bootstrap_means(long, v.grid_reps, name, picks), v, symbols))
        for d, count in ((raw, "n_raw"), (events, "n_final")):
            part = part.join(F.broadcast(d.groupBy("symbol", "signal").agg(F.count("*").alias(count))), ["symbol", "signal"], "left").na.fill(0, [count])
        part = tables.keep(part.select(F.lit(name).alias("config"), *stats.CELL, "n", "mean", "se", "t", "ci_low", "ci_high", "n_raw", "n_final"))
        out = part if out is None else out.unionByName(part)
    return out
