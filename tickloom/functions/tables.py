"""Written tables in the folder that all executors share: where a plan ends and the next begins.

A persisted frame keeps its whole plan, so steps over persisted steps make a plan
that multiplies with each; a written table does not, and it survives lost executors.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def base(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder, which only a local master can share."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if getattr(base, "own", None) is None:
        base.own = tempfile.mkdtemp(prefix="tickloom-")
        atexit.register(shutil.rmtree, base.own, True)
    return base.own


def folder(spark: SparkSession) -> str:
    """A new path below the shared folder."""
    path = f"{base(spark)}/tickloom/{uuid.uuid4().hex}"
    _made.append(path)
    return path


def keep(df: DataFrame) -> DataFrame:
    """df as a written table: its plan ends here, and lost executors lose nothing."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_all(*dfs: DataFrame) -> list[DataFrame]:
    """Each of dfs as a written table, written at the same time."""
    with ThreadPoolExecutor(len(dfs)) as pool:
        return list(pool.map(keep, dfs))


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the written tables that df reads, once nothing reads them any more."""
    for path in {f.rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:") for f in df.inputFiles()}:
        own = next((p for p in _made if path.endswith(p.removeprefix("file://").removeprefix("file:"))), None)
        if own is not None:
            _made.remove(own)
            delete(df.sparkSession, own)


@contextmanager
def scope(spark: SparkSession):
    """Tables written within are deleted at its end, but for those that the body appends to the list it is given."""
    before, kept = len(_made), []
    yield kept
    keeping = {f.rsplit("/", 1)[0] for df in kept for f in df.inputFiles()}
    for path in _made[before:]:
        if not any(k.endswith(path.removeprefix("file://").removeprefix("file:")) for k in keeping):
            delete(spark, path)
            _made.remove(path)
