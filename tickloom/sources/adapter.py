"""Trades out of the event table, and a second daily volume source out of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOL = "SYN"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trades: one for each event, priced by its k, sized by its value."""
    return table(spark, sf_dir, "events").select(
        F.lit(SYMBOL).alias("symbol"),
        F.col("event_id").alias("agg_trade_id"),
        (F.lit(1000.0) + F.get_json_object("props", "$.k").cast("double")).alias("price"),
        F.col("value").alias("quantity"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("transact_time"),
        (F.col("user_id") % 2 == 1).alias("is_buyer_maker"),
    )


def klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second daily volume source: per day of trades, with every seventh day missing and every fifth off by a little, and one day of its own."""
    t = trades(spark, sf_dir).select(F.floor(F.col("transact_time") / 86_400_000).cast("long").alias("day"), "quantity")
    daily = t.groupBy("day").agg(F.sum("quantity").alias("volume")).where("day % 7 <> 3")
    off = daily.withColumn("volume", F.when(F.col("day") % 5 == 0, F.col("volume") * 1.01).otherwise(F.col("volume")))
    extra = spark.range(1).select(F.lit(19_800).cast("long").alias("day"), F.lit(1.0).alias("volume"))
    return off.unionByName(extra)
