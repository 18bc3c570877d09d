"""The registered queries of the engine and their SQL twins.

Each query reads the tables below sf_dir whole. Computed doubles are rounded to
six places on both sides, since sums depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.config import GIVEN as G
from tickloom.config import HOURLY as S
from tickloom.config import SIGNALS
from tickloom.functions import columns as C
from tickloom.functions import series, tables
from tickloom.operators import bars as B
from tickloom.operators import costs, detectors, hygiene, quality, returns, stats
from tickloom.plans import study as P
from tickloom.sources import adapter, archive, sinks
from tickloom.sqltwin import D, twin
from tickloom.streaming import depth

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = twin(sql)
        return fn

    return add


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _prepared(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return P.prepared(adapter.trades(spark, sf), S)


def _windows(spark: SparkSession) -> DataFrame:
    start = F.lit(S.start_ms) + F.col("id") * (86_400_000 * 5)
    return spark.range(6).select(F.lit("SYN").alias("symbol"), (start + 1_800_000).alias("start_ms"), (start + 9_000_000).alias("end_ms"))


def _stages(spark: SparkSession, sf: str) -> tuple[P.Stages, DataFrame, DataFrame]:
    bars, buckets = _prepared(spark, sf)
    return P.staged_events(bars, buckets, _windows(spark), S), bars, buckets


def _returned(spark: SparkSession, sf: str) -> DataFrame:
    s, bars, _ = _stages(spark, sf)
    return P.returns_of(s, bars, _windows(spark), S)


def _long(spark: SparkSession, sf: str) -> DataFrame:
    """In-sample returns in long form, written once for the statistics that read them."""
    return tables.keep(returns.long_form(returns.in_sample(_returned(spark, sf)), S))


_BARS = "symbol, bar_index, bar_ts_ms, open, high, low, close, round(volume, 6) as volume, round(delta, 6) as delta, round(cumulative_delta, 6) as cumulative_delta, trade_count"
_EVENTS = "symbol, bar_index, bar_ts, signal, direction::tinyint as direction, round(magnitude, 6) as magnitude"


# ---- sources and columns -------------------------------------------------------------------------------------------


@query("select symbol, agg_trade_id, price, quantity, transact_time, is_buyer_maker from trades")
def src_trades(spark, sf):
    """SRC9, SRC11: the trade table, columns and filters pushed into the scan."""
    return adapter.trades(spark, sf)


_STAMP = "case event_id % 4 when 0 then ms // 1000 when 1 then ms when 2 then ms * 1000 else ms * 1000000 end"


def _stamps(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.col("event_id") % 4
    stamp = F.when(kind == 0, F.floor(ms / 1000)).when(kind == 1, ms).when(kind == 2, ms * 1000).otherwise(ms * 1_000_000).cast("long")
    return adapter.table(spark, sf, "events").select("event_id", kind.alias("file"), stamp.alias("stamp"))


@query(f"""select event_id, case when len(cast(stamp as varchar)) <= 10 then 's' when len(cast(stamp as varchar)) <= 13 then 'ms' when len(cast(stamp as varchar)) <= 16 then 'us' else 'ns' end as unit
  from (select event_id, {_STAMP} as stamp from (select event_id, (epoch_us(ts) // 1000) as ms from events))""")
def src_time_unit(spark, sf):
    """SRC2: unit of a stamp by its digits."""
    return _stamps(spark, sf).select("event_id", C.time_unit(F.col("stamp")).alias("unit"))


@query(f"""select event_id, (case event_id % 4 when 0 then stamp * 1000 when 1 then stamp when 2 then stamp // 1000 else stamp // 1000000 end)::bigint as ms
  from (select event_id, {_STAMP} as stamp from (select event_id, (epoch_us(ts) // 1000) as ms from events))""")
def src_normalised_ms(spark, sf):
    """SRC3: one unit for each file, from its first stamp."""
    t = _stamps(spark, sf)
    unit = t.groupBy("file").agg(C.time_unit(F.min("stamp")).alias("unit"))
    return t.join(F.broadcast(unit), "file").select("event_id", C.to_ms(F.col("stamp"), F.col("unit")).alias("ms"))


@query("select event_id, event_id % 3 = 0 as header from events")
def src_header(spark, sf):
    """SRC1: whether a CSV line is a header."""
    i = F.col("event_id")
    line = F.when(i % 3 == 0, F.concat(F.lit("agg_trade_id,"), i)).when(i % 3 == 1, F.concat(i, F.lit(",x"))).otherwise(F.concat(F.lit("-"), i, F.lit(".5,x")))
    return adapter.table(spark, sf, "events").select("event_id", C.looks_like_header(line).alias("header"))


@query("select year(d)::int as year, month(d)::int as month from (select unnest(range(date '2022-07-01', date '2026-07-01', interval 1 month)) as d)")
def src_months(spark, sf):
    """SRC14: the study's months."""
    return archive.months(spark, "2022-07", "2026-06")


@query("""select agg_trade_id, transact_time - transact_time % 3600000 as bar_key, floor(price / 25) * 25 as bucket, case when not is_buyer_maker then quantity else 0.0 end as bought,
  case when is_buyer_maker then quantity else 0.0 end as sold, transact_time // 86400000 as day, round(price / 25)::bigint as nearest_level from trades""")
def prj_keys(spark, sf):
    """PRJ1-3, 6, 9: bar, bucket, side, day and level of each trade."""
    bought, sold = C.aggressor(F.col("quantity"), F.col("is_buyer_maker"))
    t = F.col("transact_time")
    return adapter.trades(spark, sf).select("agg_trade_id", C.bar_key(t, S.bar_ms).alias("bar_key"), C.bucket_price(F.col("price"), 25.0).alias("bucket"), bought.alias("bought"), sold.alias("sold"), C.day_of(t).alias("day"), C.grid_level(F.col("price"), 25.0).alias("nearest_level"))


@query("""select event_id, cast(ts as date) as d, day(ts)::int as dom, (hour(ts) * 60 + minute(ts))::int as minute, year(ts) || 'H' || case when month(ts) <= 6 then '1' else '2' end as half,
  ((hour(ts) * 60 + minute(ts)) // 5 * 5)::int as slot, value = 0 as is_zero from events""")
def prj_calendar(spark, sf):
    """PRJ4, 5, 7, 8: calendar fields, half-year label, five-minute slot."""
    ts = F.col("ts").cast("timestamp")
    minute = C.minute_of_day(ts)
    return adapter.table(spark, sf, "events").select("event_id", F.to_date(ts).alias("d"), F.dayofmonth(ts).alias("dom"), minute.alias("minute"), C.half_year(ts).alias("half"), (minute - minute % 5).alias("slot"), (F.col("value") == 0).alias("is_zero"))


@query("select day, round((a - b) / b * 100, 6) as signed_pct, round(abs((a - b) / b * 100), 6) as abs_pct from reconciled where side = 'both'")
def prj_percent(spark, sf):
    """PRJ10: signed and absolute percent difference."""
    both = _reconciled(spark, sf).where("side = 'both'")
    p = C.pct_diff(F.col("a"), F.col("b"))
    return _rounded(both.select("day", p.alias("signed_pct"), F.abs(p).alias("abs_pct")))


# a crc32 in SQL: for each byte, eight steps of one bit
_STEP = "lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))"


@query(f"""select event_type, h, b, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(event_type || '|' || h || '|' || b, ''), lambda x: [ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))), {_STEP}), 4294967295) % 2147483648 as seed
  from (select distinct event_type, user_id % 5 as h, event_id % 7 as b from events)""")
def prj_seed(spark, sf):
    """STA3: seeds by crc32 of the joined parts."""
    t = adapter.table(spark, sf, "events").select("event_type", (F.col("user_id") % 5).alias("h"), (F.col("event_id") % 7).alias("b")).distinct()
    return t.select("event_type", "h", "b", C.seed_of(F.col("event_type"), F.col("h"), F.col("b")).alias("seed"))


# ---- files, read and written ---------------------------------------------------------------------------------------


def _trade_lines(spark, sf):
    """Trades as the archive's seven columns."""
    t = adapter.trades(spark, sf)
    return t.select("agg_trade_id", "price", "quantity", F.col("agg_trade_id").alias("first_trade_id"), F.col("agg_trade_id").alias("last_trade_id"), "transact_time", "is_buyer_maker")


_ARCHIVE = "agg_trade_id, price, quantity, agg_trade_id as first_trade_id, agg_trade_id as last_trade_id, transact_time, is_buyer_maker from trades"


@query(f"select {_ARCHIVE}")
def src_csv_trades(spark, sf):
    """SRC1, 3, 8, 9: files with and without a header, stamps in ms and us, read as one table."""
    rows, path = _trade_lines(spark, sf), tables.folder(spark)
    rows.where("agg_trade_id % 2 = 0").write.option("header", True).csv(f"{path}/headed")
    rows.where("agg_trade_id % 2 = 1").withColumn("transact_time", F.col("transact_time") * 1000).write.csv(f"{path}/bare")
    return archive.read_csv(spark, [f"{path}/headed", f"{path}/bare"], "trades")


@query("""select e.event_id * 60000 + 1700000000000 as open_time, value as open, value + 1 as high, value - 1 as low, value as close, value * 2 as volume, event_id * 60000 + 1700000059999 as close_time, value * 3 as quote_volume,
  user_id as count, value as taker_buy_volume, value as taker_buy_quote_volume, '0' as ignore from events e""")
def src_csv_klines(spark, sf):
    """SRC9: minute candles out of CSV."""
    i, v, path = F.col("event_id"), F.col("value"), tables.folder(spark)
    cols = [i * 60_000 + 1_700_000_000_000, v, v + 1, v - 1, v, v * 2, i * 60_000 + 1_700_000_059_999, v * 3, F.col("user_id"), v, v, F.lit("0")]
    adapter.table(spark, sf, "events").select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).write.csv(path)
    return archive.read_csv(spark, path, "klines")


@query("select 1700000000000 + event_id * 28800000 as calc_time, 8::bigint as funding_interval_hours, (event_id % 21 - 10) / 10000 as last_funding_rate from events")
def src_csv_funding(spark, sf):
    """SRC9: funding rates out of CSV, written in ms and read as such: eight-hour stamps of many events pass 2286, where digits no longer tell."""
    i, path = F.col("event_id"), tables.folder(spark)
    adapter.table(spark, sf, "events").select((i * 28_800_000 + 1_700_000_000_000).alias("calc_time"), F.lit(8).alias("hours"), ((i % 21 - 10) / 10_000).alias("rate")).write.option("header", True).csv(path)
    return archive.read_csv(spark, path, "funding", unit="ms")


@query("""select date_trunc('second', ts)::timestamp as timestamp, event_id % 11 - 5 as percentage, value as depth, value * 2 as notional from events""")
def src_csv_depth(spark, sf):
    """SRC9: book depth out of CSV: times as text, percentages as whole numbers."""
    i, path = F.col("event_id"), tables.folder(spark)
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    percent = F.format_string("%.2f", (i % 11 - 5).cast("double"))
    adapter.table(spark, sf, "events").select(text.alias("timestamp"), percent.alias("percentage"), F.col("value").alias("depth"), (F.col("value") * 2).alias("notional")).write.option("header", True).csv(path)
    return archive.read_csv(spark, path, "depth")


@query("""select 'https://archive.invalid/monthly/aggTrades/SYN/SYN-aggTrades-' || year(d) || '-' || lpad(month(d)::varchar, 2, '0') || '.zip' as url, 'https://archive.invalid/daily/klines/SYN/1m/SYN-1m-' || strftime(d, '%Y-%m-%d') || '.zip' as day_url
  from (select unnest(range(date '2022-07-01', date '2022-12-01', interval 1 month)) as d)""")
def src_urls(spark, sf):
    """SRC4: addresses of monthly and daily files."""
    base = "https://archive.invalid"
    rows = [(archive.month_url(base, "aggTrades", "SYN", r.year, r.month), archive.day_url(base, "klines", "SYN", f"{r.year}-{r.month:02d}-01", "1m")) for r in archive.months(spark, "2022-07", "2022-11").collect()]
    return spark.createDataFrame(rows, "url string, day_url string")


def _region_files(spark, sf, make, extension: str):
    """A file for every region but the third, holding make(name); (folder, the regions)."""
    path = tables.folder(spark)
    regions = adapter.table(spark, sf, "region").select("r_regionkey", "r_name")
    for r in regions.where("r_regionkey <> 2").collect():
        archive.write_file(spark, f"{path}/{r.r_name}.{extension}", make(r.r_name))
    return path, regions


@query("""select r_name || '.csv' as name, case when r_regionkey <> 2 then length(r_name)::bigint end as size, case r_regionkey when 1 then 'CHECKSUM_MISMATCH' when 2 then 'missing_404' else 'ok' end as status from region""")
def src_verified(spark, sf):
    """SRC7: files against their checksums."""
    path, regions = _region_files(spark, sf, str.encode, "csv")
    sums = regions.select(F.concat("r_name", F.lit(".csv")).alias("name"), F.sha2(F.when(F.col("r_regionkey") == 1, "other").otherwise(F.col("r_name")).cast("binary"), 256).alias("sha256"))
    return archive.verified(spark, f"{path}/*.csv", sums).select("name", "size", "status")


@query("select r_name || '.csv' as name, r_name || ',1' as line from region where r_regionkey <> 2")
def src_zip(spark, sf):
    """SRC10: zips with one member each."""
    import io
    import zipfile

    def packed(name: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(f"{name}.csv", f"{name},1")
        return out.getvalue()

    path, _ = _region_files(spark, sf, packed, "zip")
    return archive.extract_single_csv(spark, f"{path}/*.zip").select("name", F.col("content").cast("string").alias("line"))


@query("select '.csv' as extension, count(*) as n, sum(length(r_name))::bigint as bytes from region where r_regionkey <> 2 union all select '' as extension, 1 as n, 3 as bytes")
def agg_extensions(spark, sf):
    """AGG15: files and bytes by extension."""
    path, _ = _region_files(spark, sf, str.encode, "csv")
    archive.write_file(spark, f"{path}/deep/README", b"abc")
    return archive.by_extension(spark, path)


@query("select 'u' || r_regionkey as url, r_name as sha256, length(r_name)::bigint as byte_size, case when r_regionkey = 3 then 'missing_404' else 'ok' end as status, r_regionkey <> 3 as known from region")
def src_ledger(spark, sf):
    """SRC5: the ledger, written entry by entry and opened again."""
    path = f"{tables.folder(spark)}/ledger.json"
    book = archive.Ledger(spark, path)
    for r in adapter.table(spark, sf, "region").select("r_regionkey", "r_name").collect():
        book.record(f"u{r.r_regionkey}", sha256=r.r_name, byte_size=len(r.r_name), status="missing_404" if r.r_regionkey == 3 else "ok")
    again = archive.Ledger(spark, path)
    known = [u for u in again.entries if again.has(u)]
    return again.frame().withColumn("known", F.col("url").isin(known))


@query("select 'SYN' as symbol, start_ms, end_ms from windows")
def src_quarantine(spark, sf):
    """SRC12: quarantine windows out of JSON records; none where there is no file."""
    path = tables.folder(spark)
    _windows(spark).write.json(path)
    return archive.quarantine_windows(spark, path).unionByName(archive.quarantine_windows(spark, path + "-none"))


@query("select event_id, event_type from events")
def src_jsonl(spark, sf):
    """SRC13, SNK5: JSON lines, appended twice and read back."""
    path, rows = tables.folder(spark), adapter.table(spark, sf, "events").select("event_id", "event_type")
    for half in (0, 1):
        sinks.append_jsonl(rows.where(F.col("event_id") % 2 == half), path)
    return archive.read_jsonl(spark, path, "event_id long, event_type string").unionByName(archive.read_jsonl(spark, path + "-none", "event_id long, event_type string"))


@query("""select symbol, year(bar_ts)::int as year, month(bar_ts)::int as month, count(*) as n, round(sum(case when bar_index < 48 then volume + 1 else volume end), 6) as volume from bars group by all""")
def snk_staged(spark, sf):
    """SNK1: staged months; staging some of them again replaces these and keeps the others."""
    bars, path = _prepared(spark, sf)[0], tables.folder(spark)
    sinks.stage(bars, path)
    first = bars.where(F.month("bar_ts") == F.lit(1))
    sinks.stage(first.withColumn("volume", F.when(F.col("bar_index") < 48, F.col("volume") + 1).otherwise(F.col("volume"))), path)
    return _rounded(spark.read.parquet(path).groupBy("symbol", "year", "month").agg(F.count("*").alias("n"), F.sum("volume").alias("volume")))


@query(f"select {_BARS} from bars")
def snk_store(spark, sf):
    """SNK2: the final store, written by symbol and read back."""
    bars, path = _prepared(spark, sf)[0], tables.folder(spark)
    sinks.store(bars, path)
    return _rounded(spark.read.parquet(path).drop("bar_ts"))


@query("select event_type, count(*)::varchar as n, '[' || min(user_id) || ',' || max(user_id) || ']' as ends from events group by event_type")
def snk_report(spark, sf):
    """SNK3: a report as one CSV file, nested columns as JSON."""
    path = tables.folder(spark)
    sinks.report_csv(adapter.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.array(F.min("user_id"), F.max("user_id")).alias("ends")), path)
    return spark.read.option("header", True).csv(path)


@query("""select i::bigint as i, line from (select 0 as i, '| event_type | n | mean |' as line union all select 1, '|---|---|---|' union all
  select 1 + row_number() over (order by event_type), '| ' || event_type || ' | ' || count(*) || ' | ' || printf('%.4f', round(avg(user_id), 4)) || ' |' from events group by event_type)""")
def snk_markdown(spark, sf):
    """SNK4: a report table as markdown."""
    report = adapter.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("user_id"), 4).alias("mean")).orderBy("event_type")
    return spark.createDataFrame(list(enumerate(sinks.markdown(report, ["event_type", "n", "mean"]).splitlines())), "i long, line string")


@query("select event_id, event_type, value from events")
def snk_stream(spark, sf):
    """SNK7, STR4: a stream flushed to parquet, a file set for each trigger."""
    path = tables.folder(spark)
    rows = adapter.table(spark, sf, "events").select("event_id", "event_type", "value")
    rows.repartition(4).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    sinks.flush_stream(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("""select event_id, case when event_id % 3 = 0 or event_id % 5 = 1 then 'FAIL' when event_id % 7 > 3 then 'PASS-WITH-EXCEPTIONS' else 'PASS' end as gate from events""")
def qa_gate(spark, sf):
    """QA11: the final verdict over made cases."""
    i = F.col("event_id")
    cases = adapter.table(spark, sf, "events").select("event_id", (i % 3 != 0).alias("complete"), (i % 5 == 1).cast("int").alias("unexplained"), F.greatest(i % 7 - 3, F.lit(0)).alias("excepted"))
    return cases.select("event_id", quality.gates().alias("gate"))


# ---- bars ----------------------------------------------------------------------------------------------------------


@query("select symbol, bar_ts_ms, open, high, low, close, round(volume, 6) as volume, round(delta, 6) as delta, trade_count from partial_bars")
def bars_partial(spark, sf):
    """AGG1: bars that have trades."""
    return _rounded(B.partial_bars(adapter.trades(spark, sf), S))


@query(f"select {_BARS} from bars")
def bars_hourly(spark, sf):
    """WIN1-3, JN1: the finalised grid."""
    return _rounded(_prepared(spark, sf)[0].drop("bar_ts"))


@query("select symbol, bar_index, bar_ts_ms, level, bucket_px, round(buy_vol, 6) as buy_vol, round(sell_vol, 6) as sell_vol, trade_count from buckets")
def buckets_hourly(spark, sf):
    """AGG2, JN2: the footprint."""
    return _rounded(_prepared(spark, sf)[1])


@query("""select symbol, bar_index, bar_ts_ms, floor(bucket_px / 30)::bigint as level, floor(bucket_px / 30) * 30 as bucket_px, round(sum(buy_vol), 6) as buy_vol, round(sum(sell_vol), 6) as sell_vol, sum(trade_count)::bigint as trade_count
  from buckets group by symbol, bar_index, bar_ts_ms, floor(bucket_px / 30)""")
def buckets_coarse(spark, sf):
    """AGG3: coarser price buckets."""
    return _rounded(B.rebucket(_prepared(spark, sf)[1], 30.0, 10.0).select("symbol", "bar_index", "bar_ts_ms", "level", "bucket_px", "buy_vol", "sell_vol", "trade_count"))


_FOUR = """(select symbol, bar_index // 4 as bar_index, min(bar_ts_ms) as bar_ts_ms, arg_min(open, bar_index) as open, max(high) as high, min(low) as low, arg_max(close, bar_index) as close,
  sum(volume) as volume, sum(delta) as delta, sum(trade_count)::bigint as trade_count from bars group by symbol, bar_index // 4)"""


@query(f"""select symbol, bar_index, bar_ts_ms, open, high, low, close, round(volume, 6) as volume, round(delta, 6) as delta,
  round(sum(delta) over (order by bar_index rows between unbounded preceding and current row), 6) as cumulative_delta, trade_count from {_FOUR}""")
def bars_coarse(spark, sf):
    """AGG4: four-hour bars out of hourly ones."""
    bars, buckets = _prepared(spark, sf)
    return _rounded(B.rebar(bars, buckets, 4 * S.bar_ms, S.bar_ms)[0].drop("bar_ts"))


@query("""select symbol, bar_index // 4 as bar_index, min(bar_ts_ms) - min(bar_index % 4) * 3600000 as bar_ts_ms, level, bucket_px, round(sum(buy_vol), 6) as buy_vol, round(sum(sell_vol), 6) as sell_vol, sum(trade_count)::bigint as trade_count
  from buckets group by symbol, bar_index // 4, level, bucket_px""")
def buckets_of_coarse_bars(spark, sf):
    """AGG4, JN3: the footprint of the four-hour bars."""
    bars, buckets = _prepared(spark, sf)
    return _rounded(B.rebar(bars, buckets, 4 * S.bar_ms, S.bar_ms)[1])


@query("""select b.symbol, abs(round(v - bv, 6)) as volume_gap, abs(round(d - bd, 6)) as delta_gap, (n - bn)::bigint as trade_gap from (select symbol, sum(volume) as v, sum(delta) as d, sum(trade_count) as n from bars group by symbol) b
  join (select symbol, sum(buy_vol + sell_vol) as bv, sum(buy_vol - sell_vol) as bd, sum(trade_count) as bn from buckets group by symbol) k using (symbol)""")
def bars_conserve(spark, sf):
    """AGG17: bars and buckets hold the same volume, delta and trades."""
    got = _rounded(B.conservation(*_prepared(spark, sf)))
    return got.select("symbol", F.abs("volume_gap").alias("volume_gap"), F.abs("delta_gap").alias("delta_gap"), "trade_gap")


@query("""select symbol, count(*) as n_bars, count(*) % 24 = 0 as whole_days, count(*) filter (trade_count = 0) as empty_bars, min(bar_ts_ms) as first_ms, max(bar_ts_ms) as last_ms from bars group by symbol""")
def bars_sanity(spark, sf):
    """AGG14."""
    return quality.store_sanity(_prepared(spark, sf)[0], 24)


# ---- windows -------------------------------------------------------------------------------------------------------


@query("select bar_index, round(cum, 6) as cum, round(sigma, 6) as sigma, is_high, is_low, round(cum_high, 6) as cum_high, round(cum_low, 6) as cum_low from diverging")
def win_divergence(spark, sf):
    """WIN4-6, WIN9, JN9: rolling delta, extremes, trailing deviation, value at the last extreme."""
    f = detectors.divergence_frame(_prepared(spark, sf)[0], D, 200)
    return _rounded(f.select("bar_index", "cum", "sigma", "is_high", "is_low", "cum_high", "cum_low"))


@query("select bar_index, round(climax, 6) as climax from climaxes")
def win_quantile(spark, sf):
    """WIN7: trailing quantile of volume."""
    got = series.trailing_quantile(_prepared(spark, sf)[0], "volume", D.climax_window, C.nearest_index(D.climax_window, D.climax_quantile), "climax", 200)
    return _rounded(got.select("bar_index", "climax"))


@query("select bar_index, round(p25, 6) as p25, round(p50, 6) as p50 from pooled")
def win_pooled_percentiles(spark, sf):
    """WIN8: pooled percentiles of bucket volumes."""
    return _rounded(detectors.pooled_percentiles(*_prepared(spark, sf), D.volume_window, 200).select("bar_index", "p25", "p50"))


@query("select symbol, bar_index, bar_ts, direction::tinyint as direction, level, round(ratio, 6) as ratio from ratios")
def jn_diagonal(spark, sf):
    """JN14: diagonal imbalance of neighbouring levels."""
    got = detectors.diagonal_ratios(*_prepared(spark, sf), S.delta, D)
    return _rounded(got.withColumn("direction", F.col("direction").cast("byte")))


@query("select symbol, bar_index, bar_ts, direction::tinyint as direction, n, round(mean, 6) as mean from runs")
def win_islands(spark, sf):
    """WIN11: runs of neighbouring flags."""
    flagged = detectors.diagonal_ratios(*_prepared(spark, sf), S.delta, D)
    w = Window.partitionBy("symbol", "bar_index", "direction").orderBy("level")
    runs = flagged.withColumn("island", F.col("level") - F.row_number().over(w)).groupBy("symbol", "bar_index", "bar_ts", "direction", "island").agg(F.count("*").alias("n"), F.avg("ratio").alias("mean"))
    return _rounded(runs.where(F.col("n") >= D.stack).select("symbol", "bar_index", "bar_ts", F.col("direction").cast("byte").alias("direction"), "n", "mean"))


# ---- detectors -----------------------------------------------------------------------------------------------------


@query(f"select {_EVENTS} from h1")
def h1_divergence(spark, sf):
    return _rounded(detectors.divergence(_prepared(spark, sf)[0], D))


@query(f"select {_EVENTS} from h2")
def h2_absorption(spark, sf):
    return _rounded(detectors.absorption(*_prepared(spark, sf), S.delta, D))


@query(f"select {_EVENTS} from h3")
def h3_imbalance(spark, sf):
    return _rounded(detectors.imbalance(*_prepared(spark, sf), S.delta, D))


@query(f"select {_EVENTS} from h6")
def h6_exhaustion(spark, sf):
    """WIN12, JN13."""
    return _rounded(detectors.exhaustion(*_prepared(spark, sf), D))


@query(f"select {_EVENTS} from raw_events")
def det_all(spark, sf):
    """DET1-2: all detectors' events."""
    return _rounded(_stages(spark, sf)[0].raw)


# ---- hygiene -------------------------------------------------------------------------------------------------------


@query(f"select {_EVENTS} from clear_events")
def hyg_quarantine(spark, sf):
    """HYG4, JN10."""
    return _rounded(_stages(spark, sf)[0].clear.select(*detectors.EVENT))


@query(f"select {_EVENTS} from warm_events")
def hyg_warmup(spark, sf):
    """HYG1, FLT1."""
    return _rounded(_stages(spark, sf)[0].warm.select(*detectors.EVENT))


@query(f"select {_EVENTS} from events_kept")
def hyg_dedup(spark, sf):
    """HYG2-3: greedy de-duplication against the last kept event."""
    return _rounded(_stages(spark, sf)[0].kept.select(*detectors.EVENT))


@query("""select stage, signal, direction::tinyint as direction, count(*) as n from (
  select 'raw' as stage, signal, direction from raw_events union all select 'quarantine', signal, direction from clear_events
  union all select 'warmup', signal, direction from warm_events union all select 'dedup', signal, direction from events_kept) group by all""")
def agg_funnel(spark, sf):
    """AGG10."""
    return P.funnel(_stages(spark, sf)[0])


@query("""select signal, count(*) filter (year(bar_ts) = 2023) as "2023H2", count(*) filter (year(bar_ts) = 2024) as "2024H1" from events_kept group by signal""")
def agg_half_years(spark, sf):
    """AGG8: pivot with fixed periods."""
    return P.half_year_table(_stages(spark, sf)[0].kept, ["2023H2", "2024H1"])


@query(f"""select signal, round(count(*) filter (epoch_ms(bar_ts) <= {S.is_end_ms}) / count(*), 6) as share, round({S.is_end_ms - S.start_ms + 1} / {S.end_ms - S.start_ms + 1}, 6) as calendar_share from events_kept group by signal""")
def agg_in_sample_share(spark, sf):
    """AGG9."""
    return _rounded(P.in_sample_share(_stages(spark, sf)[0].kept, S))


# ---- returns and statistics ----------------------------------------------------------------------------------------


_R = ", ".join(f"round(r_{h}, 6) as r_{h}" for h in S.horizons)


@query(f"select {_EVENTS}, segment, purge_ok, {_R} from returned")
def sta_returns(spark, sf):
    """STA1-2, JN7-8, WIN13: forward returns, segments and purge."""
    s, bars, _ = _stages(spark, sf)
    got = returns.add_forward_returns(s.kept, bars, S)
    return _rounded(got.select(*detectors.EVENT, "segment", "purge_ok", *[f"r_{h}" for h in S.horizons]))


@query(f"select {_EVENTS}, segment, purge_ok, {_R} from nulled")
def hyg_null_returns(spark, sf):
    """HYG5, JN11."""
    return _rounded(_returned(spark, sf).select(*detectors.EVENT, "segment", "purge_ok", *[f"r_{h}" for h in S.horizons]))


@query("select symbol, signal, h::int as h, day, round(sum(r), 6) as total, count(*) as n from long_rows group by all")
def agg_day_sums(spark, sf):
    """AGG11, FLT2, FLT4."""
    return _rounded(stats.day_sums(_long(spark, sf)))


@query("select symbol, signal, h::int as h, round(avg(r), 6) as mean, count(*) as n from long_rows group by all")
def agg_cell_means(spark, sf):
    """AGG12."""
    return _rounded(stats.cell_means(_long(spark, sf)))


@query("select symbol, signal, h::int as h, round(case when count(*) < 2 or min(rx) = max(rx) or min(ry) = max(ry) then null else corr(rx, ry) end, 6) as ic from spearman_ranks group by symbol, signal, h")
def sta_spearman(spark, sf):
    """STA5: rank correlation."""
    return _rounded(stats.spearman(_long(spark, sf)))


@query()
def sta_bootstrap(spark, sf):
    """STA4, STA8: day-cluster bootstrap; draws are random, so there is no SQL."""
    return stats.bootstrap_means(_long(spark, sf), S.reps)


@query()
def sta_bootstrap_ic(spark, sf):
    """STA5: cluster intervals of the rank correlation."""
    return stats.bootstrap_spearman(_long(spark, sf), S.ic_reps)


_CELL_COLUMNS = "symbol, signal, h::int as h, n, round(mean, 6) as mean, round(p_value, 6) as p_value, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high"


@query(f"select {_CELL_COLUMNS} from given_cells")
def sta_bootstrap_given(spark, sf):
    """STA4, STA8: the bootstrap under a given table of draws."""
    return _rounded(stats.bootstrap_means(_long(spark, sf), G.reps, picks=stats.given_picks))


@query("select symbol, signal, h::int as h, round(ic, 6) as ic, round(ic_low, 6) as ic_low, round(ic_high, 6) as ic_high from given_ics")
def sta_bootstrap_ic_given(spark, sf):
    """STA5: the rank correlation's intervals under given draws."""
    return _rounded(stats.bootstrap_spearman(_long(spark, sf), G.ic_reps, picks=stats.given_picks))


_FAMILY = f"{_CELL_COLUMNS}, round(ic, 6) as ic, round(ic_low, 6) as ic_low, round(ic_high, 6) as ic_high, rank::int as rank, round(threshold, 6) as threshold, significant, round(se, 6) as se, round(t, 6) as t, round(mc_se, 6) as mc_se, straddle"


@query(f"select {_FAMILY} from given_family")
def sta_cells_given(spark, sf):
    """STA7-10: the family of cells under given draws."""
    return _rounded(P.cells(_long(spark, sf), G, picks=stats.given_picks))


@query("select symbol, signal, g1, g2, g3, g4, eligible, h_star, g1 and g2 and g3 and g4 as promoted from given_gates")
def sta_promotion_given(spark, sf):
    """STA11, AGG13: gates and promotion under given draws."""
    return P.promoted(_long(spark, sf), G, stats.given_picks)


@query("select symbol, seed, significant, true as matches from given_significant cross join (select unnest(['a', 'b', 'c']) as seed)")
def sta_seed_invariance_given(spark, sf):
    """STA12: three labels over the same draws call the same cells significant."""
    return P.seed_invariance(_long(spark, sf), G, ("a", "b", "c"), stats.given_picks)


@query(f"""select symbol, signal, h::int as h, round(observed, 6) as observed, round(placebo_p, 6) as placebo_p, n_valid, round(mean_admitted, 6) as mean_admitted from given_placebo""")
def sta_placebo_given(spark, sf):
    """STA6: the circular-shift placebo under given offsets."""
    s, bars, _ = _stages(spark, sf)
    events = tables.keep(returns.in_sample(P.returns_of(s, bars, _windows(spark), G)))
    r, n = F.col("rep"), stats.in_sample_bars(G)
    offsets = events.select("symbol", "signal").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(G.placebo_reps - 1).cast("long")))).withColumn("offset", F.lit(G.min_shift) + (r * 37) % (n - 2 * G.min_shift + 1))
    return _rounded(stats.placebo(events, bars, G, _windows(spark), offsets))


@query()
def sta_placebo(spark, sf):
    """STA6: circular-shift placebo."""
    s, bars, _ = _stages(spark, sf)
    events = tables.keep(returns.in_sample(P.returns_of(s, bars, _windows(spark), S)))
    return stats.placebo(events, bars, S, _windows(spark))


@query()
def sta_cells(spark, sf):
    """STA9-10: the family of cells."""
    return P.cells(_long(spark, sf), S)


@query()
def sta_seed_invariance(spark, sf):
    """STA12: the significant cells under three seeds."""
    return P.seed_invariance(_long(spark, sf), S)


@query()
def sta_promotion(spark, sf):
    """STA11, AGG13: gates and promotion."""
    return P.promoted(_long(spark, sf), S)


@query("select symbol, signal, h::int as h, agree from agreements")
def agg_sign_agreement(spark, sf):
    """AGG13: one sign in two of the three in-sample stretches."""
    return stats.year_signs(_long(spark, sf), S)


_P = "(select signal, h, abs(sin(ascii(substr(signal, 2, 1)) * 7 + h * 13)) * 0.2 as p from (select unnest(['H1', 'H2', 'H3', 'H6']) as signal) cross join (select unnest([1, 3, 6, 12]) as h))"


@query(f"""select 'SYN' as symbol, signal, h, round(p, 6) as p_value, rank::int as rank, round(rank / 16 * 0.1, 6) as threshold, coalesce(rank <= max(case when p <= rank / 16 * 0.1 then rank end) over (), false) as significant
  from (select *, row_number() over (order by p, signal, h) as rank from {_P})""")
def sta_fdr(spark, sf):
    """STA7, WIN14: step-up rule over a fixed family of p-values."""
    rows = spark.createDataFrame([("SYN", s, h) for s in SIGNALS for h in S.horizons], "symbol string, signal string, h int")
    p = F.abs(F.sin((F.ascii(F.substring("signal", 2, 1)) * 7 + F.col("h") * 13).cast("double"))) * 0.2
    got = stats.fdr(rows.withColumn("p_value", p), S.q)
    return _rounded(got.select("symbol", "signal", "h", "p_value", "rank", "threshold", "significant"))


@query()
def sta_sensitivity(spark, sf):
    """STA13: cells with bootstrap and event counts under coarser bars and buckets."""
    bars, buckets = _prepared(spark, sf)
    variants = {"base": S, "delta30": P.variant(S, delta=30.0), "bar2h": P.variant(S, bar_ms=2 * S.bar_ms), "both": P.variant(S, bar_ms=2 * S.bar_ms, delta=20.0)}
    return _rounded(P.sensitivity(bars, buckets, S, variants))


@query(f"""select symbol, min(ms) as start_ms from (select symbol, epoch_ms(bar_ts) as ms, (select count(distinct x.signal) from events_kept x where epoch_ms(x.bar_ts) between epoch_ms(e.bar_ts) and epoch_ms(e.bar_ts) + {10 * 86_400_000 - 1}) as kinds from events_kept e) where kinds = 4 group by symbol""")
def win_first_full(spark, sf):
    """WIN15: the first stretch of ten days that holds every signal."""
    return P.first_full_window(_stages(spark, sf)[0].kept, 10 * 86_400_000)


@query(f"select {_EVENTS}, round(close, 6) as close from events_kept join (select symbol, bar_index, close from bars) using (symbol, bar_index) where epoch_ms(bar_ts) < {S.is_end_ms - max(S.horizons) * S.bar_ms}")
def flt_figure_cutoff(spark, sf):
    """FLT5, JN15: events whose horizons all end in sample, with their closes."""
    s, bars, _ = _stages(spark, sf)
    return _rounded(P.figure_cutoff(s.kept, bars, S).select(*detectors.EVENT, "close"))


_FROM = S.start_ms + 3 * 86_400_000


@query(f"""select b.symbol, b.bar_index, b.bar_ts, round(b.close, 6) as close, round(b.cumulative_delta, 6) as cumulative_delta, list_sort(e.signals) as signals from bars b
  left join (select symbol, bar_index, list(distinct signal) as signals from events_kept group by all) e on b.symbol = e.symbol and b.bar_index = e.bar_index where b.bar_ts_ms >= {_FROM} and b.bar_ts_ms < {_FROM + 5 * 86_400_000}""")
def fig_price(spark, sf):
    """SNK6: price, cumulative delta and signals of a stretch of bars."""
    s, bars, _ = _stages(spark, sf)
    return _rounded(P.figure_price(bars, s.kept, _FROM, 5 * 86_400_000))


@query("""select e.symbol, e.signal, o.i::int as "offset", round(avg(e.direction * (ln(b.close) - ln(z.close))), 6) as path, count(*) as n from events_kept e cross join range(-4, 9) o(i)
  join bars b on b.bar_index = e.bar_index + o.i and b.close > 0 join bars z on z.bar_index = e.bar_index and z.close > 0 group by all""")
def fig_paths(spark, sf):
    """SNK6: mean signed path of price around events."""
    s, bars, _ = _stages(spark, sf)
    return _rounded(P.figure_paths(s.kept, bars, S, 4, 8))


@query(f"select symbol, signal, h::int as h, round(mean * 10000, 6) as mean_bp, round(ci_low * 10000, 6) as ci_low_bp, round(ci_high * 10000, 6) as ci_high_bp, {round(S.round_trip * 1e4, 6)}::double as cost_bp from given_cells")
def fig_cells(spark, sf):
    """SNK6: means and intervals beside the cost, under given draws."""
    return _rounded(P.figure_bars(stats.bootstrap_means(_long(spark, sf), G.reps, picks=stats.given_picks), S))


@query("select symbol, bar_index, bucket_px, round(buy_vol, 6) as buy_vol, round(sell_vol, 6) as sell_vol, round(buy_vol - sell_vol, 6) as net from buckets where bar_index between 298 and 302")
def fig_footprint(spark, sf):
    """SNK6: the footprint around one bar."""
    return _rounded(P.figure_footprint(_prepared(spark, sf)[1], 300, 2))


@query("select symbol, signal, h::int as h, round(t, 6) as t from given_family where abs(t) > 0.5")
def flt_nominal(spark, sf):
    """FLT6: cells beyond a limit of t, under given draws; a limit that a month's cells reach."""
    return _rounded(stats.nominal(P.cells(_long(spark, sf), G, picks=stats.given_picks), 0.5).select("symbol", "signal", "h", "t"))


@query("select symbol, signal, h::int as h, round(mean, 6) as mean, n, round(p_value, 6) as p_value from given_cells where p_value < 0.8 order by mean desc, symbol, signal, h limit 1")
def flt_best_cell(spark, sf):
    """FLT6: the cell below a limit of p with the greatest mean, under given draws."""
    return _rounded(P.best_cell(stats.bootstrap_means(_long(spark, sf), G.reps, picks=stats.given_picks), 0.8).select("symbol", "signal", "h", "mean", "n", "p_value"))


# ---- costs ---------------------------------------------------------------------------------------------------------

_FUNDING = f"(select {S.start_ms} + i * 28800000 + (i % 3) * 17 as calc_time, ((i * 37) % 11 - 5) * 0.0001::double as rate from range(90) t(i))"


def _positions(spark, sf):
    o = adapter.table(spark, sf, "events")
    entry = F.unix_millis(F.col("ts").cast("timestamp"))
    return o.select(F.col("event_id").alias("id"), entry.alias("entry_ms"), (entry + (F.col("user_id") % 90) * 3_600_000).alias("exit_ms"), F.when(F.col("user_id") % 2 == 1, 1).otherwise(-1).alias("side"), (F.col("value") / 1000).alias("gross"))


def _funding(spark):
    i = F.col("id")
    return spark.range(90).select((F.lit(S.start_ms) + i * 28_800_000 + (i % 3) * 17).alias("calc_time"), (((i * 37) % 11 - 5) * 0.0001).alias("last_funding_rate"))


@query(f"""select p.id, round(gross - {S.round_trip}, 6) as after_cost, round((-side * coalesce(paid, 0))::double, 6) + 0.0::double as funding, round(gross - {S.round_trip} - side * coalesce(paid, 0), 6) as net from (
  select event_id as id, (epoch_us(ts) // 1000) as entry_ms, (epoch_us(ts) // 1000) + (user_id % 90) * 3600000 as exit_ms, case when user_id % 2 = 1 then 1 else -1 end as side, value / 1000 as gross from events) p
  left join (select e.event_id as id, sum(f.rate) as paid from events e join {_FUNDING} f on f.calc_time > (epoch_us(e.ts) // 1000) and f.calc_time <= (epoch_us(e.ts) // 1000) + (e.user_id % 90) * 3600000 group by e.event_id) s on p.id = s.id""")
def cst_net_returns(spark, sf):
    """CST1-4, JN12: cost drag and funding over (entry, exit]."""
    got = costs.net_returns(_positions(spark, sf), _funding(spark), S.round_trip)
    return _rounded(got.select("id", "after_cost", "funding", "net")).withColumn("funding", F.col("funding") + F.lit(0.0))


# ---- data quality --------------------------------------------------------------------------------------------------


def _reconciled(spark, sf):
    return quality.reconciled(quality.daily_volume(adapter.trades(spark, sf)), adapter.klines(spark, sf))


@query("select day, round(a, 6) as a, round(b, 6) as b, side, round(pct, 6) as pct, case when side = 'both' then pct >= 0.5 end as breach from reconciled")
def qa_reconciled(spark, sf):
    """QA4-5, JN4, AGG5."""
    return _rounded(_reconciled(spark, sf))


@query("""select count(*) filter (side = 'both') as n_both, count(*) filter (side = 'left') as n_left, count(*) filter (side = 'right') as n_right,
  count(*) filter (side = 'both' and pct >= 0.5) as breaches, round(max(pct), 6) as max_pct, round(avg(pct), 6) as mean_pct from reconciled""")
def qa_summary(spark, sf):
    """QA5."""
    return _rounded(quality.reconciliation_summary(_reconciled(spark, sf)))


@query("select day, round(pct, 6) as pct from reconciled where side = 'both' and pct >= 0.5 order by round(pct, 6) desc, day limit 5")
def qa_worst(spark, sf):
    """QA5: the worst five days, a top-k."""
    got = _reconciled(spark, sf).withColumn("pct", F.round("pct", 6))
    return quality.worst(got).select("day", "pct")


_ORDINAL = "row_number() over (order by agg_trade_id // 10, agg_trade_id % 10 * 7 % 10) - 1"


def _shuffled(spark, sf):
    """Trades with every ten of them out of order; the ordinal is arithmetic, as ids count up from 0."""
    i = F.col("agg_trade_id")
    place = (i % 10 * 7) % 10
    return adapter.trades(spark, sf).withColumn("ordinal", i - i % 10 + place)


@query(f"""select symbol, count(*) filter (dt < 0) as out_of_order, count(*) filter (di <> 1) as id_gaps from (
  select symbol, transact_time - lag(transact_time) over (order by o) as dt, agg_trade_id - lag(agg_trade_id) over (order by o) as di from (select *, {_ORDINAL} as o from trades)) group by symbol""")
def qa_order(spark, sf):
    """QA1, WIN10: steps back in time and id gaps in file order."""
    return quality.order_check(_shuffled(spark, sf), "ordinal", 1000)


@query("""select 'SYN' as symbol, d as day from range(19723, 19756) t(d) where d not in (select day from keyed)""")
def qa_missing_days(spark, sf):
    """QA2, AGG7, FLT3: calendar days without trades."""
    return quality.missing_days(adapter.trades(spark, sf), 19_723, 19_755)


@query(f"""select *, out_of_order > 0 or missing > 0 as anomalous from (select symbol, count(*) filter (dt < 0) as out_of_order, count(*) filter (di <> 1) as id_gaps, (select count(*) from range(19723, 19756) t(d) where d not in (select day from keyed)) as missing from (
  select symbol, transact_time - lag(transact_time) over (order by o) as dt, agg_trade_id - lag(agg_trade_id) over (order by o) as di from (select *, {_ORDINAL} as o from trades)) group by symbol)""")
def qa_month_report(spark, sf):
    """QA3."""
    return quality.month_report(qa_order(spark, sf), qa_missing_days(spark, sf))


@query("""select symbol, agg_trade_id, price, round(quantity, 6) as quantity, transact_time, is_buyer_maker from (
  select symbol, agg_trade_id, price, case when day in (19725, 19730) then quantity * 2 else quantity end as quantity, transact_time, is_buyer_maker from keyed)""")
def qa_backfilled(spark, sf):
    """QA7: whole days replaced by the repair's rows."""
    t = adapter.trades(spark, sf)
    repair = t.withColumn("quantity", F.col("quantity") * 2).where(C.day_of(F.col("transact_time")).isin(19_725, 19_730))
    days = spark.createDataFrame([("SYN", 19_725), ("SYN", 19_730), ("SYN", 99_999)], "symbol string, day long")
    return _rounded(quality.backfilled(t, days, repair).select("symbol", "agg_trade_id", "price", "quantity", "transact_time", "is_buyer_maker"))


@query("select distinct symbol, day % 3 as year, day % 4 as month, [day] as missing_days from keyed where day % 2 = 0")
def qa_pending_repairs(spark, sf):
    """QA8: flagged days without a finished repair."""
    day = C.day_of(F.col("transact_time"))
    flags = adapter.trades(spark, sf).select("symbol", (day % 3).alias("year"), (day % 4).alias("month"), F.array(day).alias("missing_days"))
    done = flags.where(F.get("missing_days", 0) % 2 == 1).withColumn("still_missing", F.lit(0))
    return quality.pending_repairs(flags, done)


_MIN = "(select transact_time // 60000 * 60000 as minute_ms, sum(quantity * (agg_trade_id % 3 <> 0)::int) as volume from trades group by all)"


def _minutes(spark, sf):
    t = adapter.trades(spark, sf)
    return t.groupBy(C.bar_key(F.col("transact_time"), 60_000).alias("minute_ms")).agg(F.sum(F.col("quantity") * (F.col("agg_trade_id") % 3 != 0).cast("int")).alias("volume"))


@query(f"select minute_ms // 86400000 as day, count(*) filter (volume = 0) as zero_minutes from {_MIN} group by all")
def qa_zero_minutes(spark, sf):
    """AGG6, JN5."""
    return quality.zero_minutes(_minutes(spark, sf))


@query(f"""select bar_ts_ms // 86400000 as day, round(sum(case when holey then gap else 0 end) / nullif(sum(gap), 0), 6) as share, coalesce(sum(case when holey then gap else 0 end) / nullif(sum(gap), 0) >= 0.8, false) as explained from (
  select p.bar_ts_ms, abs(p.volume - coalesce(m.b, 0)) as gap, coalesce(m.holey, false) as holey from bars p left join (
    select minute_ms // 3600000 * 3600000 as bar_ts_ms, sum(volume) as b, bool_or(volume = 0) as holey from {_MIN} group by all) m using (bar_ts_ms)) group by all""")
def qa_explained(spark, sf):
    """QA9, JN6: share of a day's difference in bars that hold an empty minute."""
    return _rounded(quality.explained_share(_prepared(spark, sf)[0], _minutes(spark, sf), S.bar_ms))


@query("""select symbol, day, max(di) as max_id_step, max(dt) as max_ms_step from (select symbol, day, agg_trade_id - lag(agg_trade_id) over w as di, transact_time - lag(transact_time) over w as dt
  from keyed window w as (partition by day order by transact_time, agg_trade_id)) group by symbol, day""")
def qa_max_steps(spark, sf):
    """AGG16."""
    return quality.max_steps(adapter.trades(spark, sf))


_CLASS = """case when explained and a > b then 'KLINES_HOLE' when (fresh_a - a) / a * 100 > 0.1 then 'AGG_STALE_REVISION'
  when not whole and upstream then 'AGG_PARTIAL_GAP_UPSTREAM' when not whole then 'AGG_PARTIAL_GAP' else 'UNEXPLAINED' end"""


@query(f"""select event_id, {_CLASS} as class from (select event_id, event_id % 5 = 0 as explained, value as a, 50.0 as b, value * (1 + (event_id % 4) * 0.0005) as fresh_a,
  event_id % 6 <= 2 and user_id % 60 < 30 as whole, event_id % 7 = 0 as upstream from events where value > 0)""")
def qa_classes(spark, sf):
    """QA10: the decision tree over made cases."""
    i, v = F.col("event_id"), F.col("value")
    cases = adapter.table(spark, sf, "events").where("value > 0").select("event_id", (i % 5 == 0).alias("explained"), v.alias("a"), F.lit(50.0).alias("b"), (v * (1 + (i % 4) * 0.0005)).alias("fresh_a"), (i % 6).alias("max_id_step"), (F.col("user_id") % 60 * 60_000).alias("max_ms_step"), (i % 7 == 0).alias("upstream_gap"))
    return cases.select("event_id", quality.breach_class().alias("class"))


@query("select event_type, count(*) as n, count(distinct user_id) as users, count(distinct floor(value / 10)) as bands from events group by event_type")
def qa_audit(spark, sf):
    """QA12: counts, distinct values, distinct bands."""
    e = adapter.table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.floor(F.col("value") / 10)).alias("bands"))


@query("select 'https://archive.invalid/' || o_orderkey as url from (select distinct o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber % 2 = 1))")
def qa_unlisted(spark, sf):
    """QA6: expected urls that the ledger lacks."""
    url = lambda c: F.concat(F.lit("https://archive.invalid/"), F.col(c).cast("string")).alias("url")
    expected = adapter.table(spark, sf, "orders").select(url("o_orderkey")).distinct()
    ledger = adapter.table(spark, sf, "lineitem").select(url("l_orderkey"), F.when(F.col("l_linenumber") % 2 == 1, "ok").otherwise("missing_404").alias("status"))
    return quality.unlisted(expected, ledger)


# ---- order-book continuity -----------------------------------------------------------------------------------------


def _diffs(spark, sf):
    """Depth diffs out of events: each spans ids 10 i to 10 i + 9, and every 37th names a wrong predecessor."""
    i = F.col("event_id")
    return adapter.table(spark, sf, "events").select(F.lit("SYN").alias("symbol"), i.alias("ordinal"), (i * 10).alias("first_id"), (i * 10 + 9).alias("last_id"), F.when(i % 37 == 5, i * 10 - 5).otherwise(i * 10 - 1).alias("pu"))


_DIFFS = "(select 'SYN' as symbol, event_id as ordinal, event_id * 10 as first_id, event_id * 10 + 9 as last_id, case when event_id % 37 = 5 then event_id * 10 - 5 else event_id * 10 - 1 end as pu from events)"


@query(f"select ordinal, coalesce(pu = lag(last_id) over (order by ordinal), true) as continuous from {_DIFFS}")
def str_continuity(spark, sf):
    """STR2: predecessor ids in batch."""
    return depth.continuity(_diffs(spark, sf)).select("ordinal", "continuous")


@query(f"select symbol, min(ordinal) as sync_ordinal from {_DIFFS} where first_id <= 1235 and last_id >= 1235 group by symbol")
def str_sync(spark, sf):
    """STR1: the event that a snapshot continues with."""
    return depth.sync_point(_diffs(spark, sf), 1234)


@query(f"""select symbol, count(*) filter (seen) as n_events, count(*) filter (not seen) as n_stale, count(*) filter (seen and gap) as n_gaps, max(last_id) as last_u from (
  select *, pu <> lag(last_id) over (partition by seen order by ordinal) as gap from (select *, last_id > 1234 and ordinal >= (select min(ordinal) from {_DIFFS} where first_id <= 1235 and last_id >= 1235) as seen from {_DIFFS})) group by symbol""")
def str_checked(spark, sf):
    """STR3: stale events dropped, recording from the sync point, gaps counted, over a stream in two batches."""
    path, rows = tables.folder(spark), _diffs(spark, sf)
    for half, part in enumerate((rows.where("ordinal < 500"), rows.where("ordinal >= 500"))):
        part.coalesce(1).write.parquet(f"{path}/in/{half}")
    name = "checked_" + path.rsplit("/", 1)[1]
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    depth.checked_stream(stream, 1234).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).groupBy("symbol").agg(F.max_by(F.struct("n_events", "n_stale", "n_gaps", "last_u"), F.col("n_events") + F.col("n_stale")).alias("s")).select("symbol", "s.*")


@query("select event_id, 1000.5::double + event_id as px, (event_id % 9)::double as qty from events")
def str_levels(spark, sf):
    """STR5: book levels out of JSON."""
    i = F.col("event_id")
    text = F.concat(F.lit('[["'), (i + 1000.5).cast("string"), F.lit('","'), (i % 9).cast("string"), F.lit('"]]'))
    return adapter.table(spark, sf, "events").select("event_id", F.explode(depth.levels(text)).alias("l")).select("event_id", "l.px", "l.qty")


# ---- relational basics that the study leans on ---------------------------------------------------------------------


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 6) as qty, count(*) as n from lineitem where l_shipdate < timestamp '1998-01-01' group by all""")
def scan_pushdown(spark, sf):
    """SRC11: a filter and four columns reach the scan."""
    t = adapter.table(spark, sf, "lineitem").where(F.col("l_shipdate") < F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")))
    return _rounded(t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n")))
