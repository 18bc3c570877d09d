"""Trading costs: a linear drag and funding paid at each stamp held over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EIGHT_HOURS = 28_800_000


def funding_paid(positions: DataFrame, funding: DataFrame, step: int = EIGHT_HOURS) -> DataFrame:
    """positions (id, entry_ms, exit_ms, side) with funding: minus side times the rates with entry < calc_time <= exit.

    Rates add up over time once, in chunks of a thousand steps; each end of a
    position looks up the sum at the last stamp not after it, by that stamp's
    step. Stamps may lie anywhere within a step and several may share one.
    """
    per = funding.groupBy(F.floor(F.col("calc_time") / step).alias("step")).agg(F.sum("last_funding_rate").alias("total"))
    big = per.groupBy(F.floor(F.col("step") / 1000).alias("chunk")).agg(F.sum("total").alias("t"))
    carry = big.select("chunk", F.coalesce(F.sum("t").over(Window.partitionBy(F.lit(0)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("carry"))
    w = Window.partitionBy("chunk").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per.withColumn("chunk", F.floor(F.col("step") / 1000)).withColumn("before", F.coalesce(F.sum("total").over(w), F.lit(0.0))).join(carry, "chunk").select("step", "chunk", (F.col("before") + F.col("carry")).alias("before"), "total")

    ends = positions.select("id", F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("entry_ms").alias("ms")), F.struct(F.lit(1).alias("sign"), F.col("exit_ms").alias("ms")))).alias("e")).select("id", "e.sign", "e.ms", F.floor(F.col("e.ms") / step).alias("at"))
    # within the step itself, stamps are compared one by one
    inside = ends.join(funding.select(F.floor(F.col("calc_time") / step).alias("at"), "calc_time", "last_funding_rate"), "at").where("calc_time <= ms").groupBy("id", "sign").agg(F.sum("last_funding_rate").alias("part"))
    # every step of the range has a sum, so that an end in an empty step finds one
    span = per.agg(F.min("step").alias("a"), F.max("step").alias("b"))
    steps = span.select(F.explode(F.sequence("a", F.col("b") + 1)).alias("step")).join(ahead.select("step", "before", "total"), "step", "left").withColumn("chunk", F.floor(F.col("step") / 1000))
    local = F.coalesce(F.sum(F.coalesce("total", F.lit(0.0))).over(Window.partitionBy("chunk").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = steps.join(carry, "chunk", "left").select("step", (local + F.coalesce("carry", F.lit(0.0))).alias("sum_before"))
    limits = ends.join(F.broadcast(span)).withColumn("step", F.greatest(F.col("a"), F.least(F.col("at"), F.col("b") + 1)))
    got = limits.join(sums, "step", "left").join(inside, ["id", "sign"], "left").groupBy("id").agg(F.sum(F.col("sign") * (F.coalesce("sum_before", F.lit(0.0)) + F.coalesce("part", F.lit(0.0)))).alias("paid"))
    return positions.join(got, "id", "left").withColumn("funding", -F.col("side") * F.coalesce("paid", F.lit(0.0))).drop("paid")


def net_returns(positions: DataFrame, funding: DataFrame, round_trip: float, step: int = EIGHT_HOURS) -> DataFrame:
    """positions (.., gross) with after_cost, funding and net."""
    got = funding_paid(positions, funding, step).withColumn("after_cost", F.col("gross") - round_trip)
    return got.withColumn("net", F.col("after_cost") + F.col("funding"))
