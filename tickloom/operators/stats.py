"""Cell statistics: day-cluster bootstrap, rank correlation, false-discovery control, promotion gates, placebo.

Random draws are seeded by cell and replicate batch, never by Spark partition,
so results do not depend on how the work is laid out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import SIGNALS, Study
from tickloom.functions import columns as C
from tickloom.operators import hygiene, returns

BATCH = 5_000
CELL = ("symbol", "signal", "h")
#: Values that a replicate step holds at once.
_BLOCK = 2_000_000

#: (seed, first replicate, replicates, days) -> the days that each replicate draws, a row for each
Picks = Callable[[int, int, int, int], np.ndarray]


def random_picks(seed: int, first: int, n: int, days: int) -> np.ndarray:
    """Independent draws with replacement; a batch's rows continue one another, so `first` is not needed."""
    return np.random.default_rng([seed, first]).integers(0, days, (n, days))


def given_picks(seed: int, first: int, n: int, days: int) -> np.ndarray:
    """A fixed table of draws, by arithmetic over replicate and place, which SQL can write too."""
    rep, place = np.arange(first, first + n)[:, None], np.arange(days)[None, :]
    return (rep * place * 1_103_515 + rep * 48_271 + place * 69_621 + 12_345) // 1009 % days


def day_sums(long: DataFrame) -> DataFrame:
    """(symbol, signal, h, day, total, n): all that the bootstrap of means needs."""
    return long.groupBy(*CELL, "day").agg(F.sum("r").alias("total"), F.count("*").alias("n"))


def cell_means(long: DataFrame) -> DataFrame:
    return long.groupBy(*CELL).agg(F.avg("r").alias("mean"), F.count("*").alias("n"))


def _batches(cells: DataFrame, reps: int, label: str) -> DataFrame:
    """Cells times replicate batches, spread over the cluster; each with its seed and size."""
    n = -(-reps // BATCH)
    wide = cells.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    size = F.least(F.lit(BATCH), F.lit(reps) - F.col("batch") * BATCH)
    return wide.withColumns({"seed": C.seed_of(F.lit(label), *[F.col(c) for c in CELL], F.col("batch")), "size": size}).repartition(*CELL, "batch")


STAT = "symbol string, signal string, h int, stat double"


def _replicates(statistic, picks: Picks):
    """statistic(row) -> (days, fn(picks) -> a value for each replicate)."""

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                days, fn, width = statistic(r)
                step = max(1, _BLOCK // max(days, width))
                for lo in range(0, int(r.size), step):
                    n = min(step, int(r.size) - lo)
                    yield pd.DataFrame({"symbol": r.symbol, "signal": r.signal, "h": r.h, "stat": fn(picks(int(r.seed), int(r.batch) * BATCH + lo, n, days))})

    return run


def _mean_of(r):
    sums, counts = np.asarray(r.totals, float), np.asarray(r.counts, float)
    return len(sums), lambda pick: sums[pick].sum(axis=1) / counts[pick].sum(axis=1), len(sums)


def bootstrap_means(long: DataFrame, reps: int, label: str = "base", picks: Picks = random_picks) -> DataFrame:
    """(symbol, signal, h, n, mean, p_value, ci_low, ci_high) by resampling whole days with replacement."""
    days = day_sums(long)
    arrays = days.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("day", "total", "n"))).alias("d")).select(*CELL, F.col("d.total").alias("totals"), F.col("d.n").alias("counts"))
    got = _batches(arrays, reps, label).mapInPandas(_replicates(_mean_of, picks), STAT)
    tail = got.groupBy(*CELL).agg(F.avg((F.col("stat") <= 0).cast("int")).alias("below"), F.avg((F.col("stat") >= 0).cast("int")).alias("above"), F.percentile("stat", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    p = F.least(F.lit(1.0), 2 * F.least("below", "above"))
    return cell_means(long).join(tail, list(CELL)).select(*CELL, "n", "mean", p.alias("p_value"), F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"))


def average_ranks(long: DataFrame) -> DataFrame:
    """long with rx and ry: ranks of magnitude and return within the cell, ties at their mean."""

    def ranked(c: str):
        # equal values share one row of counts, so the running count is over distinct values
        per = long.groupBy(*CELL, c).agg(F.count("*").alias("_k"))
        ahead = F.coalesce(F.sum("_k").over(Window.partitionBy(*CELL).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return per.select(*CELL, c, (ahead + (F.col("_k") + 1) / 2).alias("rank"))

    x, y = ranked("magnitude").withColumnRenamed("rank", "rx"), ranked("r").withColumnRenamed("rank", "ry")
    return long.join(x, [*CELL, "magnitude"]).join(y, [*CELL, "r"])


def spearman(long: DataFrame) -> DataFrame:
    """(symbol, signal, h, ic): Pearson correlation of average ranks; null with fewer than two rows or a constant side."""
    ranked = average_ranks(long)
    flat = (F.count("*") < 2) | (F.min("rx") == F.max("rx")) | (F.min("ry") == F.max("ry"))
    # corr() divides by zero on a constant side even where its result is not taken
    ratio = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    return ranked.groupBy(*CELL).agg(F.when(~flat, ratio).alias("ic"))


def _weighted_ranks(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Average rank of each value in every replicate, in which it stands weights[replicate, value] times."""
    _, group = np.unique(values, return_inverse=True)
    order = np.argsort(group, kind="stable")
    begin = np.flatnonzero(np.diff(group[order], prepend=-1))
    size = np.add.reduceat(weights[:, order], begin, axis=1)
    return (np.cumsum(size, axis=1) - size + (size + 1) / 2)[:, group]


def _ic_of(r):
    """Rank correlations of replicates. A drawn day stands as often as it is drawn, so values are sorted once and replicates differ in weights only."""
    x, y = np.asarray(r.magnitudes, float), np.asarray(r.returns, float)
    names, at = np.unique(np.asarray(r.days), return_inverse=True)

    def run(pick: np.ndarray) -> np.ndarray:
        n = len(pick)
        drawn = np.bincount((np.arange(n)[:, None] * len(names) + pick).ravel(), minlength=n * len(names)).reshape(n, len(names))
        w = drawn[:, at].astype(float)
        rx, ry, total = _weighted_ranks(x, w), _weighted_ranks(y, w), w.sum(axis=1, keepdims=True)
        dx, dy = rx - (w * rx).sum(axis=1, keepdims=True) / total, ry - (w * ry).sum(axis=1, keepdims=True) / total
        vx, vy, both = ((w * a * b).sum(axis=1) for a, b in ((dx, dx), (dy, dy), (dx, dy)))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where((vx > 1e-9) & (vy > 1e-9), both / np.sqrt(vx * vy), np.nan)

    return len(names), run, 4 * len(x)


def bootstrap_spearman(long: DataFrame, reps: int, label: str = "ic", picks: Picks = random_picks) -> DataFrame:
    """(symbol, signal, h, ic, ic_low, ic_high); replicates without a correlation are dropped."""
    arrays = long.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("day", "bar_index", "magnitude", "r"))).alias("rows"))
    arrays = arrays.select(*CELL, F.col("rows.day").alias("days"), F.col("rows.magnitude").alias("magnitudes"), F.col("rows.r").alias("returns"))
    got = _batches(arrays, reps, label).mapInPandas(_replicates(_ic_of, picks), STAT).where(~F.isnan("stat"))
    ci = got.groupBy(*CELL).agg(F.percentile("stat", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    return spearman(long).join(ci, list(CELL), "left").select(*CELL, "ic", F.col("ci")[0].alias("ic_low"), F.col("ci")[1].alias("ic_high"))


def fdr(cells: DataFrame, q: float) -> DataFrame:
    """cells (symbol, signal, h, p_value) with rank, threshold and significant by the step-up rule over a symbol's family. A null p is never significant but counts."""
    family = Window.partitionBy("symbol")
    ranked = cells.withColumns({"rank": F.row_number().over(family.orderBy(F.col("p_value").asc_nulls_last(), "signal", "h")), "_n": F.count("*").over(family)})
    ranked = ranked.withColumn("threshold", F.col("rank") / F.col("_n") * q)
    last = F.max(F.when(F.col("p_value") <= F.col("threshold"), F.col("rank"))).over(family)
    return ranked.withColumn("significant", F.coalesce((F.col("rank") <= last) & F.col("p_value").isNotNull(), F.lit(False))).drop("_n")


def spread(cells: DataFrame) -> DataFrame:
    """Standard error and t out of the interval."""
    return cells.withColumn("se", (F.col("ci_high") - F.col("ci_low")) / (2 * 1.96)).withColumn("t", F.try_divide("mean", "se"))


def derived(cells: DataFrame, reps: int) -> DataFrame:
    """Standard error, t, Monte-Carlo error of p, and whether p lies within three of those of its threshold."""
    got = spread(cells)
    got = got.withColumns({"mc_se": F.sqrt(F.col("p_value") * (1 - F.col("p_value")) / reps)})
    return got.withColumn("straddle", F.abs(F.col("p_value") - F.col("threshold")) <= 3 * F.col("mc_se"))


def year_signs(long: DataFrame, study: Study) -> DataFrame:
    """(symbol, signal, h, agree): whether the sign of the mean return is the same, and not zero, in at least two of the study's in-sample stretches."""
    ms, part = F.unix_millis("bar_ts"), F.lit(None).cast("int")
    for i, (a, b) in enumerate(study.stretches):
        part = F.when(ms.between(a, b), i).otherwise(part)
    signs = long.withColumn("part", part).where("part is not null").groupBy(*CELL, "part").agg(F.signum(F.avg("r")).alias("s"))
    return signs.groupBy(*CELL).agg((F.greatest(F.count_if(F.col("s") > 0), F.count_if(F.col("s") < 0)) >= 2).alias("agree"))


def promotion(cells: DataFrame, signs: DataFrame, study: Study) -> DataFrame:
    """Per symbol and signal the four gates and the decision. cells: symbol, signal, h, n, mean, t, significant."""
    material = F.col("significant") & (F.col("h") >= study.material_horizon)
    eligible = material & (F.col("mean") * 1e4 >= study.min_bp)
    got = cells.join(signs, list(CELL), "left").groupBy("symbol", "signal").agg(
        (F.max("n") >= study.min_events).alias("g1"),
        ((F.count_if("significant") >= 2) & (F.count_if(material) >= 1)).alias("g2"),
        F.array_sort(F.collect_list(F.when(eligible, F.col("h")))).alias("eligible"),
        F.max(F.when(eligible, F.struct(F.abs("t").alias("t"), "h", F.coalesce("agree", F.lit(False)).alias("agree")))).alias("best"),
    )
    g3 = F.size("eligible") > 0
    g4 = F.coalesce(F.col("best.agree"), F.lit(False))
    return got.select("symbol", "signal", "g1", "g2", g3.alias("g3"), g4.alias("g4"), "eligible", F.col("best.h").alias("h_star"), (F.col("g1") & F.col("g2") & g3 & g4).alias("promoted"))


def random_offsets(events: DataFrame, n_bars: int, study: Study, label: str = "placebo") -> DataFrame:
    """(symbol, signal, rep, offset): one circular shift for each replicate of a signal."""
    lo, hi = study.min_shift, n_bars - study.min_shift

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                yield pd.DataFrame({"symbol": r.symbol, "signal": r.signal, "rep": r.batch * BATCH + np.arange(r.size), "offset": np.random.default_rng(int(r.seed)).integers(lo, hi + 1, int(r.size))})

    wide = events.select("symbol", "signal").distinct().withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(-(-study.placebo_reps // BATCH) - 1))))
    wide = wide.withColumns({"seed": C.seed_of(F.lit(label), F.col("symbol"), F.col("signal"), F.col("batch")), "size": F.least(F.lit(BATCH), F.lit(study.placebo_reps) - F.col("batch") * BATCH)})
    return wide.mapInPandas(run, "symbol string, signal string, rep long, offset long")


def in_sample_bars(study: Study) -> int:
    """Bars that begin in sample, numbered from 0."""
    return (study.is_end_ms - study.start_ms) // study.bar_ms + 1


def placebo(events: DataFrame, bars: DataFrame, study: Study, windows: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """(symbol, signal, h, observed, placebo_p, n_valid, mean_admitted) of in-sample events (returns.in_sample) under circular shifts.

    A replicate shifts all events of a signal by one offset, round the in-sample
    bars. A shifted event counts if it is past the warm-up, its longest target
    lies in sample and no quarantine window overlaps its bar or the bars up to
    that target's. Replicates without such an event are not valid. What a bar
    would return is known beforehand, so a shift is a join on the bar's number.
    """
    n, longest = in_sample_bars(study), max(study.horizons)
    offsets = random_offsets(events, n, study) if offsets is None else offsets
    inside = returns.looking_ahead(bars, study).where((F.col("bar_index") >= study.warmup) & (F.col("bar_index") + 1 + longest < n))
    at = F.lit(study.start_ms) + F.col("bar_index") * study.bar_ms
    free = hygiene.outside_windows(inside.select("symbol", *[c for c in inside.columns if c != "symbol"], at.alias("lo"), (at + (longest + 2) * study.bar_ms).alias("hi")), windows, ["symbol", "bar_index"])
    free = free.select("symbol", F.col("bar_index").alias("_to"), F.lit(True).alias("_ok"), *[f"f_{h}" for h in study.horizons])
    moved = events.select("symbol", "signal", "bar_index", "direction").join(offsets, ["symbol", "signal"]).withColumn("_to", (F.col("bar_index") + F.col("offset")) % n)
    means = moved.join(free, ["symbol", "_to"], "left").groupBy("symbol", "signal", "rep").agg(F.avg(F.col("_ok").isNotNull().cast("int")).alias("admitted"), *[F.avg(F.col("direction") * F.col(f"f_{h}")).alias(f"m_{h}") for h in study.horizons])
    tall = means.select("symbol", "signal", "admitted", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"m_{h}").alias("m")) for h in study.horizons])).alias("e")).select("symbol", "signal", "e.h", "e.m", "admitted")
    seen = cell_means(returns.long_form(events, study)).select(*CELL, F.col("mean").alias("observed"))
    return tall.join(F.broadcast(seen), list(CELL)).groupBy(*CELL, "observed").agg(
        F.try_divide(F.count_if(F.abs("m") >= F.abs("observed")), F.count("m")).alias("placebo_p"), F.count("m").alias("n_valid"), F.avg("admitted").alias("mean_admitted")
    )


def every_cell(cells: DataFrame, study: Study, symbols: DataFrame | None = None) -> DataFrame:
    """cells completed to the whole family of signals and horizons of each symbol; absent ones have n 0 and nulls. symbols: where cells may lack some."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(h).alias("h")) for s in SIGNALS for h in study.horizons]))
    family = (cells if symbols is None else symbols).select("symbol").distinct().select("symbol", pairs.alias("p")).select("symbol", "p.*")
    return family.join(cells, list(CELL), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def nominal(cells: DataFrame, t: float = 1.96) -> DataFrame:
    """The cells whose t lies beyond the nominal limit."""
    return cells.where(F.abs("t") > t)
