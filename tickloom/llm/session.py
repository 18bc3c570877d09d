"""What the operators need from the session: shared scratch tables, a broadcast guarded by a measured size, shuffle-sized bucket counts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import tables

#: A table is broadcast up to this many estimated bytes; beyond it joins shuffle.
BROADCAST_BYTES = 24 << 20


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local session may do without that setting."""
    ship(spark)
    return tables.folder(spark)


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df as a written table in the shared folder: lineage ends here, and lost executors lose nothing."""
    path = scratch(df.sparkSession)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets(spark: SparkSession) -> int:
    """Hash buckets of a blob exchange: a few for each shuffle partition, so partitions come out even and grow in number with the cluster's setting."""
    return 16 * partitions(spark)


def within(df: DataFrame, row_bytes, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df's estimated bytes, measured over all its rows, allow a broadcast."""
    got = df.agg(F.sum(row_bytes).alias("b")).first()["b"] or 0
    return got <= limit


def maybe_broadcast(df: DataFrame, row_bytes, limit: int = BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if within(df, row_bytes, limit) else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless they find it by PYTHONPATH or in their working folder."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    known = [Path(p).resolve() for p in (os.environ.get("PYTHONPATH", "").split(os.pathsep) + [os.getcwd()]) if p]
    if root in known or getattr(ship, "sent", None) == sc.applicationId:
        return
    at = tempfile.mkdtemp(prefix="tickloom-")  # served to executors as long as the driver lives
    atexit.register(shutil.rmtree, at, True)
    out = Path(at, "tickloom.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((root / "tickloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(out))
    ship.sent = sc.applicationId
