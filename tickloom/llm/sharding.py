"""Size-tiered compaction of immutable shards under a versioned manifest; DataFrame and SQL functions only.

A store is a folder:

    data/shard_write=<version>-<nonce>/shard_run=<n>/*.parquet    rows, each as one struct
    manifests/<version>-<nonce>/*.parquet                          the runs of a version
    commits/<version>.json                                         names that version's manifest

A run is the rows of one arrival, or of several merged ones. Appending writes
every arrival's rows where they are read, without a shuffle. Compaction looks
at the manifest only: runs are ranked by arrival, whatever the arrivals'
numbers, and within a lane of neighbouring ranks runs of one size tier (a factor
of four) are cut, in that order, where their bytes pass the target; groups of at
least MERGE runs become one file each. A version exists once its commit file
does. That file is written under another name and moved into place, which fails
if the version is there: so a commit is there whole or not at all, of two
writers one starts again from the newer version, and files of crashed writers
are never read. Only folders that the manifest names are listed.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import session

TARGET = 16 << 20
MERGE = 4
#: Neighbouring runs that one planning window looks at.
LANE = 65_536
#: Size tiers start at powers of four.
TIERS = [4**k for k in range(5, 26)]

MANIFEST = "shard_write string, shard_run long, first_arrival long, level int, n_rows long, n_bytes long"


def row_bytes(df: DataFrame, prefix: str = "row."):
    """A row's logical size: the bytes of its strings and binaries, eight for each other column."""
    parts = [F.coalesce(F.octet_length(f"{prefix}`{f.name}`"), F.lit(0)).cast("long") if f.dataType.typeName() in ("string", "binary") else F.lit(8).cast("long") for f in df.schema]
    total = F.lit(0).cast("long")
    for p in parts:
        total = total + p
    return total


def tier(n_bytes="n_bytes"):
    """How many powers of four a run has reached."""
    total = F.lit(0)
    for t in TIERS:
        total = total + F.when(F.col(n_bytes) >= t, 1).otherwise(0)
    return total


class Conflict(RuntimeError):
    """Another writer has committed a version that this one's work does not fit."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, merge: int = MERGE, lane: int = LANE):
        self.spark, self.root, self.target, self.merge, self.lane = spark, root.rstrip("/"), target, merge, lane

    # ---- versions ----

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """Numbers that are taken, readable or not."""
        fs, path = self._fs(f"{self.root}/commits")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _named(self, version: int) -> str | None:
        """The manifest that a version names; None if its file is no commit, as one cut short by another tool."""
        text = self.spark.read.text(f"{self.root}/commits/{version:020d}.json", wholetext=True).first()
        try:
            return json.loads(text[0])["manifest"] if text else None
        except (ValueError, KeyError, TypeError):
            return None

    def version(self) -> int:
        """The newest version that can be read; 0 if there is none."""
        return next((v for v in reversed(self.versions()) if self._named(v)), 0)

    def _free(self) -> int:
        return max(self.versions(), default=0) + 1

    def manifest(self, version: int | None = None) -> DataFrame:
        """The runs of a version, the newest by default; version 0 has none."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        name = self._named(version)
        if name is None:
            raise ValueError(f"version {version} has no readable commit")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{name}")

    def _commit(self, runs: DataFrame, version: int) -> None:
        """Publish runs as `version`, or raise Conflict if it is there already."""
        name = f"{version:020d}-{uuid.uuid4().hex[:12]}"
        runs.select(*[c.split()[0] for c in MANIFEST.split(", ")]).write.parquet(f"{self.root}/manifests/{name}")
        fs, part = self._fs(f"{self.root}/commits/_{name}")
        _, path = self._fs(f"{self.root}/commits/{version:020d}.json")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps({"version": version, "manifest": name}).encode()))
        out.close()
        try:
            self._move(fs, part, path)
        except Exception as e:  # of the JVM or of the system: what counts is whether the version is there
            fs.delete(part, False)
            if fs.exists(path):
                raise Conflict(f"version {version} exists") from e
            raise

    def _move(self, fs, part, path) -> None:
        """Rename that fails where the goal exists. A local file system would replace it, so there a link is made, which does not."""
        if fs.getUri().getScheme() == "file":
            os.link(part.toUri().getPath(), path.toUri().getPath())
            fs.delete(part, False)
            return
        jvm = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
        none[0] = getattr(jvm, "Options$Rename").NONE
        jvm.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part, path, none)

    # ---- rows ----

    def _rows(self, runs: DataFrame) -> DataFrame:
        """(shard_write, shard_run, row, and the runs' columns) of the given runs. Only writes that hold some of them are listed, and of those other runs are pruned."""
        writes = [r["shard_write"] for r in runs.select("shard_write").distinct().collect()]  # one for each version at most
        if not writes:
            raise ValueError("no runs")
        stored = self.spark.read.option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/shard_write={w}" for w in sorted(writes)])
        stored = stored.select("row", F.col("shard_write").cast("string").alias("shard_write"), F.col("shard_run").cast("long").alias("shard_run"))
        return stored.join(session.maybe_broadcast(runs, F.lit(96)), ["shard_write", "shard_run"])

    def read(self, version: int | None = None, places: bool = False) -> DataFrame:
        """The rows of a version; with places as (row struct, shard_run, level)."""
        got = self._rows(self.manifest(version).select("shard_write", "shard_run", "level"))
        return got.select("row", "shard_run", "level") if places else got.select("row.*")

    # ---- writing ----

    def append(self, df: DataFrame, arrival=None) -> int:
        """Add every arrival of df as a small immutable run and commit; returns the version.

        arrival: a long column expression, by default one arrival for all rows;
        null counts as -1. df may have any columns, an empty one commits nothing.
        """
        write = f"{self._free():020d}-{uuid.uuid4().hex[:12]}"
        arrival = F.lit(0).cast("long") if arrival is None else F.coalesce(arrival.cast("long"), F.lit(-1).cast("long"))
        rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), arrival.alias("shard_run"))
        rows.write.option("compression", "zstd").partitionBy("shard_run").parquet(f"{self.root}/data/shard_write={write}")
        fs, path = self._fs(f"{self.root}/data/shard_write={write}")
        listed, some = fs.listStatusIterator(path), False
        while not some and listed.hasNext():
            some = "shard_run=" in listed.next().getPath().getName()
        if not some:
            return self.version()
        new = self._measured(df, write, 0).select("shard_write", "shard_run", F.col("shard_run").alias("first_arrival"), F.lit(0).alias("level"), "n_rows", "n_bytes")
        new = session.materialize(new)
        while True:
            now, free = self.version(), self._free()
            try:
                self._commit(self.manifest(now).unionByName(new), free)
                return free
            except Conflict:
                continue

    def _measured(self, df: DataFrame, write: str, level: int) -> DataFrame:
        got = self.spark.read.parquet(f"{self.root}/data/shard_write={write}")
        return got.groupBy(F.col("shard_run").cast("long").alias("shard_run")).agg(F.count("*").alias("n_rows"), F.sum(row_bytes(df)).alias("n_bytes")).withColumn("shard_write", F.lit(write))

    def _ranked(self, runs: DataFrame) -> DataFrame:
        """runs with rank, their place in order of arrival from 0. More than a lane of them are ranked range by range."""
        by = ["first_arrival", "shard_write", "shard_run"]
        parts = -(-runs.count() // self.lane)
        if parts <= 1:
            return runs.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)).cast("long") - 1)
        ranged = session.materialize(runs.repartitionByRange(parts, *by).withColumn("range", F.spark_partition_id()))
        sizes = ranged.groupBy("range").agg(F.count("*").alias("_n"))
        ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        own = F.row_number().over(Window.partitionBy("range").orderBy(*by)).cast("long") - 1
        return ranged.withColumn("_own", own).join(F.broadcast(sizes.select("range", ahead.alias("_ahead"))), "range").withColumn("rank", F.col("_own") + F.col("_ahead")).drop("range", "_own", "_ahead")

    def plan(self, runs: DataFrame) -> DataFrame:
        """runs with merged_run, the first arrival of the group that a run is merged into, or null, and merged_name, that group's least rank."""
        ranked = self._ranked(runs).withColumn("lane", F.call_function("div", F.col("rank"), F.lit(self.lane).cast("long")))
        marked = ranked.withColumn("tier", tier()).where(F.col("n_bytes") < self.target)
        order = Window.partitionBy("lane", "tier").orderBy("rank")
        ahead = F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1))
        cut = marked.withColumn("part", F.floor(F.coalesce(ahead, F.lit(0)) / self.target))
        group = Window.partitionBy("lane", "tier", "part")
        sized = cut.withColumns({"members": F.count("*").over(group), "merged_run": F.min("first_arrival").over(group), "merged_name": F.min("rank").over(group)})
        merged = sized.where(F.col("members") >= self.merge).select("shard_write", "shard_run", "merged_run", "merged_name")
        return runs.join(merged, ["shard_write", "shard_run"], "left")

    def compact(self) -> int:
        """Merge what the plan says, once, and commit; returns the version, unchanged if there is nothing to merge or the inputs went meanwhile."""
        now = self.version()
        plan = session.materialize(self.plan(self.manifest(now)))
        merging = plan.where("merged_run is not null")
        if not merging.limit(1).count():
            return now
        write = f"{self._free():020d}-{uuid.uuid4().hex[:12]}"
        name = F.col("merged_name")  # arrivals may repeat over tiers, ranks do not
        rows = self._rows(merging.select("shard_write", "shard_run", name.alias("merged"))).select("row", F.col("merged").alias("shard_run"))
        rows.repartition("shard_run").write.option("compression", "zstd").partitionBy("shard_run").parquet(f"{self.root}/data/shard_write={write}")
        new = merging.groupBy(name.alias("shard_run")).agg(F.min("first_arrival").alias("first_arrival"), (F.max("level") + 1).alias("level"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes")).withColumn("shard_write", F.lit(write))
        new = session.materialize(new.select(*[c.split()[0] for c in MANIFEST.split(", ")]))
        gone = merging.select("shard_write", "shard_run")
        while True:
            latest, free = self.version(), self._free()
            live = self.manifest(latest)
            if latest != now and gone.join(live, ["shard_write", "shard_run"], "left_anti").limit(1).count():
                return latest  # another compaction took some of these runs
            try:
                self._commit(live.join(gone, ["shard_write", "shard_run"], "left_anti").unionByName(new), free)
                return free
            except Conflict:
                continue


#: Documents of an arrival in the query.
ARRIVAL_ROWS = 128


def compacted_documents(docs: DataFrame, root: str | None = None, target: int = TARGET, arrival_rows: int = ARRIVAL_ROWS) -> DataFrame:
    """Append docs by arrival, compact, and read every row back from the newest version.

    Returns doc_id, run_id (first arrival of its run), level, n_bytes (logical
    bytes of the row), n_chars, text_sha256. An arrival is `arrival_rows`
    consecutive doc_ids, however far apart arrivals are; rows without doc_id form
    one of their own. Repeated rows, null, empty and very long texts are kept as
    they are, and so are further columns, whatever their names; of equal arrivals
    the earlier write comes first. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root or session.scratch(spark), target)
    empty = "doc_id long, run_id long, level int, n_bytes long, n_chars long, text_sha256 string"
    number = F.col("doc_id").cast("long")
    if not store.append(docs, F.call_function("div", number - F.pmod(number, F.lit(arrival_rows).cast("long")), F.lit(arrival_rows).cast("long"))):
        return spark.createDataFrame([], empty)
    store.compact()
    got = store._rows(store.manifest().select("shard_write", "shard_run", "first_arrival", "level"))
    text = F.col("row.text")
    return got.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("first_arrival").alias("run_id"), "level", row_bytes(docs).alias("n_bytes"), F.length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


ORACLE = f"""
with sized as (
  select doc_id, coalesce(doc_id // {ARRIVAL_ROWS}, -1) as arrival, text,
         coalesce(strlen(text), 0) + coalesce(strlen(lang), 0) + coalesce(strlen(source), 0) + 16 as n_bytes
  from documents),
runs as (select *, (row_number() over (order by arrival) - 1) // {LANE} as lane from (select arrival, sum(n_bytes)::bigint as run_bytes from sized group by arrival)),
tiered as (select *, {" + ".join(f"(run_bytes >= {t})::int" for t in TIERS)} as tier from runs),
summed as (
  select *, coalesce(sum(run_bytes) over (partition by lane, tier order by arrival rows between unbounded preceding and 1 preceding), 0) as ahead
  from tiered where run_bytes < {TARGET}),
cut as (select *, floor(ahead / {TARGET}) as part from summed),
grouped as (
  select arrival, count(*) over (partition by lane, tier, part) as members, min(arrival) over (partition by lane, tier, part) as first_arrival
  from cut)
select s.doc_id, case when g.members >= {MERGE} then g.first_arrival else s.arrival end as run_id,
       case when g.members >= {MERGE} then 1 else 0 end::int as level, s.n_bytes::bigint as n_bytes, length(s.text)::bigint as n_chars, sha256(s.text) as text_sha256
from sized s left join grouped g on s.arrival = g.arrival
"""
