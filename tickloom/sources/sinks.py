"""Where results go: staged months, the final store, CSV and markdown reports, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, path: str) -> None:
    """Partition by symbol, year and month of bar_ts_ms; only the months in df are replaced."""
    ts = F.timestamp_millis("bar_ts_ms")
    df.withColumns({"year": F.year(ts), "month": F.month(ts)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "year", "month").parquet(path)


def store(df: DataFrame, path: str, order: str = "bar_index") -> None:
    """The final store: files by symbol, ordered within."""
    df.repartitionByRange("symbol", order).sortWithinPartitions(order).write.mode("overwrite").partitionBy("symbol").parquet(path)


def report_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file; nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def markdown(df: DataFrame, columns: list[str], digits: int = 4, limit: int = 200) -> str:
    """A report table of at most `limit` rows as markdown."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = df.select(*columns).limit(limit).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])


def flush_stream(df: DataFrame, path: str, checkpoint: str, **trigger):
    """A stream as parquet, a file set for each trigger."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
