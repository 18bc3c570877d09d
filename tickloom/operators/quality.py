"""Data quality: order and gaps, coverage, reconciliation, repair, classification, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import DAY_MS
from tickloom.functions import columns as C


def order_check(trades: DataFrame, ordinal: str, stretch: int = 100_000) -> DataFrame:
    """Per symbol, in file order: steps back in time and id steps other than one. File order is cut into stretches that share one row, so no symbol is one task."""
    at = F.floor(F.col(ordinal) / stretch)
    both = F.explode(F.array(F.struct(at.alias("part"), F.lit(True).alias("own")), F.struct((at + 1).alias("part"), F.lit(False).alias("own"))))
    wide = trades.select("symbol", F.col(ordinal).alias("o"), "agg_trade_id", "transact_time", both.alias("c")).select("*", "c.*").where("own or o % {} = {}".format(stretch, stretch - 1))
    w = Window.partitionBy("symbol", "part").orderBy("o")
    steps = wide.select("symbol", "own", (F.col("transact_time") - F.lag("transact_time").over(w)).alias("dt"), (F.col("agg_trade_id") - F.lag("agg_trade_id").over(w)).alias("di")).where("own")
    return steps.groupBy("symbol").agg(F.count_if(F.col("dt") < 0).alias("out_of_order"), F.count_if(F.col("di") != 1).alias("id_gaps"))


def missing_days(trades: DataFrame, first: int, last: int) -> DataFrame:
    """(symbol, day) of days in [first, last] without a trade."""
    seen = trades.select("symbol", C.day_of(F.col("transact_time")).alias("day")).distinct()
    wanted = seen.select("symbol").distinct().withColumn("day", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
    return wanted.join(seen, ["symbol", "day"], "left_anti")


def month_report(order: DataFrame, missing: DataFrame) -> DataFrame:
    """order_check with the number of missing days and anomalous: out of order, or a day missing."""
    gone = missing.groupBy("symbol").agg(F.count("*").alias("missing"))
    got = order.join(gone, "symbol", "left").withColumn("missing", F.coalesce("missing", F.lit(0).cast("long")))
    return got.withColumn("anomalous", (F.col("out_of_order") > 0) | (F.col("missing") > 0))


def daily_volume(trades: DataFrame) -> DataFrame:
    return trades.groupBy(C.day_of(F.col("transact_time")).alias("day")).agg(F.sum("quantity").alias("volume"))


def reconciled(left: DataFrame, right: DataFrame, limit_pct: float = 0.5) -> DataFrame:
    """Full outer join of two (day, volume) sources: side, percent difference, and whether it reaches the limit. A zero right side differs without bound."""
    both = left.withColumnRenamed("volume", "a").join(right.withColumnRenamed("volume", "b"), "day", "full_outer")
    side = F.when(F.col("a").isNull(), "right").when(F.col("b").isNull(), "left").otherwise("both")
    pct = F.abs(C.pct_diff(F.col("a"), F.col("b")))
    breach = F.when(side == "both", F.coalesce(pct >= limit_pct, F.lit(True)))
    return both.select("day", "a", "b", side.alias("side"), F.when(side == "both", pct).alias("pct"), breach.alias("breach"))


def reconciliation_summary(days: DataFrame) -> DataFrame:
    return days.agg(*[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("both", "left", "right")], F.count_if("breach").alias("breaches"), F.max("pct").alias("max_pct"), F.avg("pct").alias("mean_pct"))


def worst(days: DataFrame, k: int = 5) -> DataFrame:
    """The k largest differences, ties by day."""
    return days.where("breach").orderBy(F.col("pct").desc_nulls_first(), "day").limit(k)


def backfilled(trades: DataFrame, days: DataFrame, repair: DataFrame) -> DataFrame:
    """Replace whole days (symbol, day) by the repair's rows where it has any; of rows that share an id the repair's stays, then the latest."""
    of = C.day_of(F.col("transact_time"))
    new = repair.withColumn("day", of).join(days, ["symbol", "day"], "left_semi")
    replaced = new.select("symbol", "day").distinct()
    old = trades.withColumn("day", of).join(replaced, ["symbol", "day"], "left_anti")
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    pick = Window.partitionBy("symbol", "agg_trade_id").orderBy(F.col("_p").desc(), F.col("transact_time").desc(), "price", "quantity")
    return both.withColumn("_r", F.row_number().over(pick)).where("_r = 1").drop("_r", "_p", "day")


def pending_repairs(flags: DataFrame, done: DataFrame) -> DataFrame:
    """Distinct flagged (symbol, year, month, missing_days) without a finished repair of the same days."""
    finished = done.where("still_missing = 0").select("symbol", "year", "month", "missing_days")
    return flags.select("symbol", "year", "month", "missing_days").distinct().join(finished, ["symbol", "year", "month", "missing_days"], "left_anti")


def zero_minutes(minutes: DataFrame) -> DataFrame:
    """Per day the minutes without volume, from (minute_ms, volume)."""
    return minutes.groupBy(F.floor(F.col("minute_ms") / DAY_MS).cast("long").alias("day")).agg(F.count_if(F.col("volume") == 0).alias("zero_minutes"))


def explained_share(bars: DataFrame, minutes: DataFrame, bar_ms: int) -> DataFrame:
    """Per day the share of the volume difference that lies in bars holding a minute without volume, and whether it is at least 0.8."""
    per = minutes.groupBy(C.bar_key(F.col("minute_ms"), bar_ms).alias("bar_ts_ms")).agg(F.sum("volume").alias("b"), F.bool_or(F.col("volume") == 0).alias("holey"))
    got = bars.select("bar_ts_ms", F.col("volume").alias("a")).join(per, "bar_ts_ms", "left")
    gap = F.abs(F.col("a") - F.coalesce("b", F.lit(0.0)))
    day = got.groupBy(F.floor(F.col("bar_ts_ms") / DAY_MS).cast("long").alias("day")).agg(F.sum(gap).alias("gap"), F.sum(F.when(F.coalesce("holey", F.lit(False)), gap).otherwise(0.0)).alias("in_holes"))
    share = F.try_divide("in_holes", "gap")
    return day.select("day", share.alias("share"), F.coalesce(share >= 0.8, F.lit(False)).alias("explained"))


def max_steps(trades: DataFrame) -> DataFrame:
    """Per symbol and day the greatest step of ids and of times."""
    day = C.day_of(F.col("transact_time"))
    w = Window.partitionBy("symbol", "day").orderBy("transact_time", "agg_trade_id")
    steps = trades.withColumn("day", day).select("symbol", "day", (F.col("agg_trade_id") - F.lag("agg_trade_id").over(w)).alias("di"), (F.col("transact_time") - F.lag("transact_time").over(w)).alias("dt"))
    return steps.groupBy("symbol", "day").agg(F.max("di").alias("max_id_step"), F.max("dt").alias("max_ms_step"))


def breach_class() -> F.Column:
    """Class of a breached day from the columns explained, fresh_a (volume of a fresh download), a, b, max_id_step, max_ms_step, upstream_gap."""
    more = C.pct_diff(F.col("fresh_a"), F.col("a")) > 0.1
    whole = (F.col("max_id_step") <= 2) & (F.col("max_ms_step") < 1_800_000)
    return (
        F.when(F.col("explained") & (F.col("a") > F.col("b")), "KLINES_HOLE")
        .when(more, "AGG_STALE_REVISION")
        .when(~whole & F.col("upstream_gap"), "AGG_PARTIAL_GAP_UPSTREAM")
        .when(~whole, "AGG_PARTIAL_GAP")
        .otherwise("UNEXPLAINED")
    )


def gate(complete: bool, unexplained: int, excepted: int) -> str:
    """The final verdict of a data set."""
    if not complete or unexplained:
        return "FAIL"
    return "PASS-WITH-EXCEPTIONS" if excepted else "PASS"


def gates() -> F.Column:
    """gate() of the columns complete, unexplained, excepted."""
    return F.when(~F.col("complete") | (F.col("unexplained") > 0), "FAIL").when(F.col("excepted") > 0, "PASS-WITH-EXCEPTIONS").otherwise("PASS")


def store_sanity(bars: DataFrame, bars_per_day: int) -> DataFrame:
    """Per symbol: bars, whole days of them, empty bars, first and last start."""
    return bars.groupBy("symbol").agg(F.count("*").alias("n_bars"), (F.count("*") % bars_per_day == 0).alias("whole_days"), F.count_if(F.col("trade_count") == 0).alias("empty_bars"), F.min("bar_ts_ms").alias("first_ms"), F.max("bar_ts_ms").alias("last_ms"))


def unlisted(expected: DataFrame, ledger: DataFrame) -> DataFrame:
    """Expected urls that the ledger does not have as ok."""
    return expected.join(ledger.where("status = 'ok'"), "url", "left_anti")
