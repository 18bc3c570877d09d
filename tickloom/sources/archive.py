"""Archive files: header and time-unit sniffing, typed CSV readers, checksums, zips, ledgers, calendars."""

from __future__ import annotations

import io
import json
import os
import re
import time
import urllib.error
import urllib.request
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import columns as C

# Column names and types of the archive's files, by position.
SCHEMAS = {
    "trades": "agg_trade_id long, price double, quantity double, first_trade_id long, last_trade_id long, transact_time long, is_buyer_maker boolean",
    "klines": "open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, count long, taker_buy_volume double, taker_buy_quote_volume double, ignore string",
    "funding": "calc_time long, funding_interval_hours long, last_funding_rate double",
    "depth": "timestamp string, percentage double, depth double, notional double",
}
STAMPS = {"trades": ["transact_time"], "klines": ["open_time", "close_time"], "funding": ["calc_time"], "depth": []}


def read_csv(spark: SparkSession, path: str | list[str], kind: str, rejects: bool = False, unit: str | None = None) -> DataFrame:
    """A headed or headerless CSV as its typed table, any number of files at once. Stamps are ms, by the unit of each file's first stamp.

    Digits tell ms only up to 2286: later ones have 14 and read as us. Where the
    unit (s, ms, us, ns) is known, as of files written here, state it.

    Only a file's first line can be its header. A line that cannot be read as a
    row is left out; with rejects the result is those lines instead, (path, line).
    """
    if unit not in (None, "s", "ms", "us", "ns"):
        raise ValueError(f"unknown unit {unit}")
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") == 0).alias("_head"), F.monotonically_increasing_id().alias("_at"))
    head = F.col("value").startswith("timestamp") if kind == "depth" else C.looks_like_header(F.col("value"))
    # ids of lines grow within a split, so the first line of a file is the least of its first split
    top = lines.where("_head").groupBy("_file").agg(F.min("_at").alias("_first"))
    body = lines.where(F.trim("value") != "").join(F.broadcast(top), "_file", "left").where((F.col("_at") != F.col("_first")) | ~head).select("_file", "value")
    bad = "_bad"
    parsed = body.select("_file", F.from_csv("value", f"{SCHEMAS[kind]}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r")).select("_file", "r.*")
    if rejects:
        return parsed.where(F.col(bad).isNotNull()).select(F.col("_file").alias("path"), F.col(bad).alias("line"))
    got = parsed.where(F.col(bad).isNull()).drop(bad)
    if unit:
        got = got.withColumns({c: C.to_ms(F.col(c), F.lit(unit)) for c in STAMPS[kind]})
    elif STAMPS[kind]:
        # a file's stamps share one unit, so any of them tells it
        units = got.groupBy("_file").agg(*[C.time_unit(F.min(c)).alias(f"_{c}") for c in STAMPS[kind]])
        got = got.join(F.broadcast(units), "_file", "left").withColumns({c: C.to_ms(F.col(c), F.col(f"_{c}")) for c in STAMPS[kind]}).drop(*[f"_{c}" for c in STAMPS[kind]])
    if kind == "depth":
        got = got.withColumns({"timestamp": F.to_timestamp_ntz("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")), "percentage": F.round("percentage").cast("long")})
    return got.drop("_file")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a fixed schema; none if there is no such file. Lines that are no JSON object give a row of nulls, as they are logged, not data."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def by_extension(spark: SparkSession, folder: str) -> DataFrame:
    """(extension, n, bytes) of all files below a folder. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.when(name.rlike(r"[^.]\.[^.]*$"), F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))).otherwise("")
    return files.groupBy(extension.alias("extension")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def month_url(base: str, kind: str, symbol: str, year: int, month: int, interval: str = "") -> str:
    part = f"{interval}/" if interval else ""
    return f"{base}/monthly/{kind}/{symbol}/{part}{symbol}-{interval or kind}-{year}-{month:02d}.zip"


def day_url(base: str, kind: str, symbol: str, day: str, interval: str = "") -> str:
    part = f"{interval}/" if interval else ""
    return f"{base}/daily/{kind}/{symbol}/{part}{symbol}-{interval or kind}-{day}.zip"


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(year, month) of every month from first to last, both yyyy-MM and included."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first + "-01")), F.to_date(F.lit(last + "-01")), F.expr("interval 1 month"))).alias("d"))
    return days.select(F.year("d").alias("year"), F.month("d").alias("month"))


def verified(spark: SparkSession, files: str, checksums: DataFrame) -> DataFrame:
    """(path, size, status) of files against (name, sha256): ok, CHECKSUM_MISMATCH or missing_404."""
    have = spark.read.format("binaryFile").load(files).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("got"))
    status = F.when(F.col("got").isNull(), "missing_404").when(F.col("got") == F.col("sha256"), "ok").otherwise("CHECKSUM_MISMATCH")
    return checksums.join(have, "name", "left").select("name", "path", "size", status.alias("status"))


def extract_single_csv(spark: SparkSession, files: str) -> DataFrame:
    """(path, name, content) of zips with exactly one member; others raise. One task holds one file."""

    def run(frames):
        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = z.namelist()
                    if len(names) != 1:
                        raise ValueError(f"{path} holds {len(names)} members")
                    out.append((path, names[0], z.read(names[0])))
            yield pdf.iloc[:0][["path"]].assign(name="", content=b"") if not out else type(pdf)(out, columns=["path", "name", "content"])

    return spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(run, "path string, name string, content binary")


def fetch(url: str, to: str, tries: int = 3, pause: float = 2.0) -> str:
    """Download by way of a .part file; ok or missing_404. Other errors are tried again after a growing pause."""
    for k in range(1, tries + 1):
        try:
            with urllib.request.urlopen(url, timeout=60) as r, open(f"{to}.part", "wb") as f:
                while block := r.read(1 << 20):
                    f.write(block)
            os.replace(f"{to}.part", to)
            return "ok"
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return "missing_404"
            if k == tries:
                raise
        except OSError:
            if k == tries:
                raise
        time.sleep(pause * k)
    raise AssertionError


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file by way of a .part file, wherever the path leads."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(fs_path(path + ".part"), True)
    out.write(bytearray(data))
    out.close()
    if fs.exists(fs_path(path)):
        fs.delete(fs_path(path), False)
    fs.rename(fs_path(path + ".part"), fs_path(path))


class Ledger:
    """What has been ingested, by url, in one JSON file that is replaced whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        self.entries: dict[str, dict] = json.loads(spark.read.text(path, wholetext=True).first()[0]) if there else {}

    def has(self, url: str) -> bool:
        return self.entries.get(url, {}).get("status") == "ok"

    def record(self, url: str, **entry) -> None:
        self.entries[url] = entry
        write_file(self.spark, self.path, json.dumps(self.entries, sort_keys=True).encode())

    def frame(self) -> DataFrame:
        rows = [(u, e.get("sha256"), e.get("byte_size"), e.get("status")) for u, e in sorted(self.entries.items())]
        return self.spark.createDataFrame(rows, "url string, sha256 string, byte_size long, status string")


def quarantine_windows(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, start_ms, end_ms) from JSON records: an array, lines, or any such values one after the other, on one line or many.

    None if there is no such file; what is no whole record raises, as a window left
    out would let bad data in. One task holds one file.
    """
    schema = "symbol string, start_ms long, end_ms long"
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], schema)

    def run(frames):
        decoder, space = json.JSONDecoder(), re.compile(r"[ \t\r\n]*")
        for pdf in frames:
            out = []
            for text in pdf["value"]:
                at = space.match(text).end()
                while at < len(text):
                    got, at = decoder.raw_decode(text, at)
                    out += [(r["symbol"], int(r["start_ms"]), int(r["end_ms"])) for r in (got if isinstance(got, list) else [got])]
                    at = space.match(text, at).end()
            yield type(pdf)(out, columns=["symbol", "start_ms", "end_ms"]).astype({"start_ms": "int64", "end_ms": "int64"})

    return spark.read.text(path, wholetext=True).mapInPandas(run, schema)
