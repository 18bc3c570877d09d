import datetime
import hashlib
import zipfile
import zlib
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.config import HOURLY, SIGNALS
from tickloom.functions import columns as C
from tickloom.functions import series
from tickloom.operators import bars as B
from tickloom.operators import costs, detectors, hygiene, quality, returns, stats
from tickloom.plans import study as P
from tickloom.sources import adapter, archive, sinks
from tickloom.streaming import depth

SF = "/root/testdata/sf0.001"
EVENTS = "symbol string, bar_index long, bar_ts timestamp, signal string, direction byte, magnitude double"


def ts(ms):
    return datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc)


def events(spark, rows):
    return spark.createDataFrame([("SYN", i, ts(HOURLY.start_ms + i * HOURLY.bar_ms), s, d, 1.0) for i, s, d in rows], EVENTS)


def kept(df):
    return sorted((r.bar_index, r.signal, r.direction) for r in df.collect())


@pytest.mark.parametrize("chunk", [5, 7, 16384])
def test_dedup_compares_with_the_last_kept(spark, chunk):
    df = events(spark, [(i, "H1", 1) for i in (100, 104, 108, 113, 114, 121)] + [(101, "H2", 1), (102, "H1", -1)])
    assert kept(hygiene.deduplicated(df, 6, chunk)) == [(100, "H1", 1), (101, "H2", 1), (102, "H1", -1), (108, "H1", 1), (121, "H1", 1)]


def test_dedup_suppresses_at_the_gap_itself(spark):
    assert [x[0] for x in kept(hygiene.deduplicated(events(spark, [(100, "H1", 1), (106, "H1", 1)]), 6))] == [100]
    assert [x[0] for x in kept(hygiene.deduplicated(events(spark, [(100, "H1", 1), (103, "H1", 1), (107, "H1", 1)]), 6))] == [100, 107]
    assert kept(hygiene.deduplicated(events(spark, []), 6)) == []


def test_quarantine_is_strict_at_both_ends(spark):
    at = HOURLY.start_ms + 5 * HOURLY.bar_ms
    windows = spark.createDataFrame([("SYN", at, at + HOURLY.bar_ms)], "symbol string, start_ms long, end_ms long")
    assert [x[0] for x in kept(hygiene.outside_quarantine(events(spark, [(4, "H1", 1), (5, "H1", 1), (6, "H1", 1)]), windows, HOURLY.bar_ms))] == [4, 6]


def test_bars_by_hand(spark):
    h = HOURLY.start_ms
    rows = [("SYN", 1, 100.0, 1.0, h, False), ("SYN", 2, 101.0, 2.0, h + 1, True), ("SYN", 3, 99.0, 1.0, h + 1, False), ("SYN", 4, 100.5, 1.0, h + 5, True), ("SYN", 5, 103.0, 1.0, h + 2 * HOURLY.bar_ms, False)]
    trades = spark.createDataFrame(rows, "symbol string, agg_trade_id long, price double, quantity double, transact_time long, is_buyer_maker boolean")
    study = replace(HOURLY, end_ms=h + 3 * HOURLY.bar_ms - 1)
    for chunk in (1, 2, 100):
        got = B.finalise(B.partial_bars(trades, study), study, chunk).orderBy("bar_index").collect()
        assert [(r.open, r.high, r.low, r.close, r.volume, r.delta, r.trade_count) for r in got] == [(100.0, 101.0, 99.0, 100.5, 5.0, -1.0, 4), (100.5, 100.5, 100.5, 100.5, 0.0, 0.0, 0), (103.0, 103.0, 103.0, 103.0, 1.0, 1.0, 1)]
        assert [r.cumulative_delta for r in got] == [-1.0, -1.0, 0.0]


def test_coarser_grids_must_be_whole_multiples(spark):
    bars, buckets = P.prepared(adapter.trades(spark, SF), HOURLY)
    with pytest.raises(ValueError):
        B.rebucket(buckets, 25.0, 10.0)
    with pytest.raises(ValueError):
        B.rebar(bars, buckets, 5_000_000, HOURLY.bar_ms)


def test_chunks_do_not_matter_and_the_future_does_not_leak(spark):
    bars, buckets = P.prepared(adapter.trades(spark, SF), HOURLY)
    key = lambda df: sorted((r.signal, r.bar_index, r.direction, round(r.magnitude, 6)) for r in df.collect() if r.magnitude is not None)
    whole = key(detectors.detect_all(bars, buckets, HOURLY.delta, HOURLY.detect))
    assert whole and key(detectors.detect_all(bars, buckets, HOURLY.delta, HOURLY.detect, 97)) == whole
    cut = key(detectors.detect_all(bars.where("bar_index < 500"), buckets.where("bar_index < 500"), HOURLY.delta, HOURLY.detect, 97))
    assert cut == [e for e in whole if e[1] < 500]


def test_rank_rules(spark):
    rows = spark.range(1, 10).select("id", C.rank_index(F.col("id"), 0.5).alias("m"), C.rank_index(F.col("id"), 0.25).alias("q")).collect()
    assert [(r.m, r.q) for r in rows] == [(min(int(n * 0.5), n - 1), min(int(n * 0.25), n - 1)) for n in range(1, 10)]
    assert C.nearest_index(2016, 0.95) == 1914 and C.nearest_index(1, 0.95) == 0


def test_seeds_agree(spark):
    got = spark.range(1).select(C.seed_of(F.lit("H1"), F.lit(6)).alias("s")).first().s
    assert got == C.stable_seed("H1", 6) == zlib.crc32(b"H1|6") % (1 << 31)


def test_step_up_rule(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.42]
    df = spark.createDataFrame([("SYN", "H1", i, x) for i, x in enumerate(p)] + [("SYN", "H2", 9, None), ("TWO", "H1", 0, 0.09)], "symbol string, signal string, h int, p_value double")
    got = {r.h: r.significant for r in stats.fdr(df.where("symbol = 'SYN' and signal = 'H1'"), 0.10).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False}
    assert not stats.fdr(df, 0.10).where("h = 9").first().significant
    assert stats.fdr(df, 0.10).where("symbol = 'TWO'").first().significant  # a family of its own


def test_bootstrap_finds_an_effect_and_weighs_days_by_events(spark):
    rows = [("SYN", "H1", 1, d, 0.01 + 0.005 * ((d * 7) % 11 - 5) / 5) for d in range(200)] + [("SYN", "H2", 1, d, 0.01 * ((d * 7) % 11 - 5)) for d in range(198)]
    long = spark.createDataFrame(rows, "symbol string, signal string, h int, day long, r double")
    got = {r.signal: r for r in stats.bootstrap_means(long, 2000).collect()}
    assert got["H1"].p_value < 0.01 < got["H1"].ci_high and got["H2"].p_value > 0.05
    again = {r.signal: r for r in stats.bootstrap_means(long.repartition(3), 2000).collect()}
    rounded = lambda rows: {k: [round(x, 9) for x in r[3:]] for k, r in rows.items()}
    assert rounded(again) == rounded(got)
    few = spark.createDataFrame([("SYN", "H1", 1, 0, 10.0)] * 100 + [("SYN", "H1", 1, 1, -10.0)], "symbol string, signal string, h int, day long, r double")
    assert abs(stats.cell_means(few).first().mean - 990 / 101) < 1e-9


def test_rank_correlation(spark):
    schema = "symbol string, signal string, h int, day long, bar_index long, magnitude double, r double"
    long = spark.createDataFrame([("SYN", "H1", 1, d, d, float(d), d * 2.0) for d in range(50)] + [("SYN", "H2", 1, d, d, 1.0, d * 2.0) for d in range(5)] + [("TWO", "H1", 1, d, d, float(d), -float(d)) for d in range(9)], schema)
    got = {(r.symbol, r.signal): r.ic for r in stats.bootstrap_spearman(long, 50).collect()}
    assert abs(got["SYN", "H1"] - 1) < 1e-12 and got["SYN", "H2"] is None and abs(got["TWO", "H1"] + 1) < 1e-12


def test_replicates_rank_like_rows_drawn_again():
    r = np.random.default_rng(4)
    row = SimpleNamespace(days=r.integers(0, 7, 60), magnitudes=r.integers(0, 9, 60).astype(float), returns=r.integers(0, 9, 60).astype(float))
    days, fn, _ = stats._ic_of(row)
    pick = r.integers(0, days, (40, days))
    names = np.unique(row.days)
    for got, draw in zip(fn(pick), pick, strict=True):
        at = np.concatenate([np.flatnonzero(row.days == names[i]) for i in draw])
        want = pd.Series(row.magnitudes[at]).rank().corr(pd.Series(row.returns[at]).rank())
        assert got == pytest.approx(want) or np.isnan(got) and np.isnan(want)


def test_placebo_by_symbol_in_sample(spark):
    n, inside = HOURLY.n_bars, stats.in_sample_bars(HOURLY)
    base = spark.range(n).select(F.lit("SYN").alias("symbol"), F.col("id").alias("bar_index"), (F.lit(HOURLY.start_ms) + F.col("id") * HOURLY.bar_ms).alias("bar_ts_ms"), F.when(F.col("id") % 100 >= 12, 101.0).otherwise(100.0).alias("open"))
    # the other symbol is flat; beyond the sample both jump wildly, which must not be seen
    bars = base.unionByName(base.withColumn("symbol", F.lit("TWO")).withColumn("open", F.lit(50.0))).withColumn("open", F.when(F.col("bar_index") >= inside, F.col("bar_index").cast("double")).otherwise(F.col("open")))
    jumps = events(spark, [(i, "H1", 1) for i in range(110, 460, 100)])
    both = jumps.unionByName(jumps.withColumn("symbol", F.lit("TWO")))
    study = replace(HOURLY, placebo_reps=200)
    windows = spark.createDataFrame([], "symbol string, start_ms long, end_ms long")
    used = returns.in_sample(returns.add_forward_returns(both, bars, study))
    got = {r.symbol: r for r in stats.placebo(used, bars, study, windows).where("h = 1").collect()}
    assert got["SYN"].placebo_p < 0.1 and got["SYN"].n_valid > 100 and got["SYN"].observed > 0
    assert got["TWO"].observed == 0 and got["TWO"].placebo_p == 1.0
    # one known offset: events at 110.. move by 90 and land on 200, 300, 400 and, past the end, in the warm-up
    one = spark.createDataFrame([("SYN", "H1", 0, 90)], "symbol string, signal string, rep long, offset long")
    row = stats.placebo(used, bars, study, windows, one).where("h = 12").first()
    assert row.n_valid == 1 and row.mean_admitted == pytest.approx(sum(60 <= (i + 90) % inside and (i + 90) % inside + 13 < inside for i in range(110, 460, 100)) / 4)


def test_stretches_of_the_sample_need_not_be_equal(spark):
    study = replace(HOURLY, stretches=((HOURLY.start_ms, HOURLY.start_ms + 9), (HOURLY.start_ms + 10, HOURLY.start_ms + 19), (HOURLY.start_ms + 20, HOURLY.start_ms + 99)))
    row = lambda s, ms, x: ("SYN", s, 1, ts(HOURLY.start_ms + ms), x)
    rows = [row("H1", 5, 1.0), row("H1", 15, 1.0), row("H1", 50, -9.0), row("H2", 5, 1.0), row("H2", 50, -1.0), row("H2", 200, 1.0), row("H3", 5, -1.0), row("H3", 6, 1.0), row("H3", 15, -1.0)]
    long = spark.createDataFrame(rows, "symbol string, signal string, h int, bar_ts timestamp, r double")
    assert {r.signal: r.agree for r in stats.year_signs(long, study).collect()} == {"H1": True, "H2": False, "H3": False}


def test_purge_at_the_border_of_segments(spark):
    bars, _ = P.prepared(adapter.trades(spark, SF), HOURLY)
    last = (HOURLY.is_end_ms + 1 - HOURLY.start_ms) // HOURLY.bar_ms - 1
    got = {r.bar_index: r for r in returns.add_forward_returns(events(spark, [(100, "H1", 1), (last, "H1", -1), (HOURLY.n_bars - 1, "H1", 1)]), bars, HOURLY).collect()}
    assert got[100].purge_ok and got[100].segment == "IS"
    assert got[last].segment == "IS" and not got[last].purge_ok and got[last].r_1 is not None
    assert got[HOURLY.n_bars - 1].r_1 is None and not got[HOURLY.n_bars - 1].purge_ok


def test_gates(spark):
    rows = [("SYN", s, h, 400, 0.002, 5.0 + h, s != "H2") for s in SIGNALS for h in HOURLY.horizons]
    cells = spark.createDataFrame(rows, "symbol string, signal string, h int, n long, mean double, t double, significant boolean")
    signs = cells.select("symbol", "signal", "h", (F.col("signal") != "H3").alias("agree"))
    got = {r.signal: r for r in stats.promotion(cells, signs, replace(HOURLY, min_events=300)).collect()}
    assert got["H1"].promoted and got["H1"].h_star == 12
    assert not got["H2"].promoted and not got["H3"].g4


def test_funding_is_paid_after_entry_up_to_exit(spark):
    funding = spark.createDataFrame([(1000, 0.1), (2000, 0.2), (2000, 0.05), (9000, 0.4)], "calc_time long, last_funding_rate double")
    pos = spark.createDataFrame([(1, 1000, 2000, 1, 0.0), (2, 0, 999, 1, 0.0), (3, 999, 9000, -1, 0.0), (4, 50_000, 60_000, 1, 0.0)], "id long, entry_ms long, exit_ms long, side int, gross double")
    got = {r.id: round(r.funding, 9) for r in costs.net_returns(pos, funding, 0.0012, 500).collect()}
    assert got == {1: -0.25, 2: 0.0, 3: 0.75, 4: 0.0}


def test_archive_readers_checksums_and_zips(spark, tmp_path):
    (tmp_path / "a.csv").write_text("agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker\n1,10.5,2,1,1,1700000000123,true\n")
    (tmp_path / "b.csv").write_text("2,11.5,3,2,2,1700000000123456,false\n")
    rows = sorted(tuple(r) for r in archive.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "trades").collect())
    assert rows == [(1, 10.5, 2.0, 1, 1, 1700000000123, True), (2, 11.5, 3.0, 2, 2, 1700000000123, False)]
    (tmp_path / "bad.csv").write_text("7,1.5,2,7,7,1700000000123,true\nagain,price\nx,1,2,3,4,5,true\n")
    assert [r.agg_trade_id for r in archive.read_csv(spark, str(tmp_path / "bad.csv"), "trades").collect()] == [7]
    assert sorted(r.line for r in archive.read_csv(spark, str(tmp_path / "bad.csv"), "trades", rejects=True).collect()) == ["again,price", "x,1,2,3,4,5,true"]
    (tmp_path / "d.csv").write_text("timestamp,percentage,depth,notional\n2024-01-01 00:00:05,-5.00,1.5,2.5\n")
    assert archive.read_csv(spark, str(tmp_path / "d.csv"), "depth").first().percentage == -5
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x.csv", "1")
    assert archive.extract_single_csv(spark, str(tmp_path / "z.zip")).first().name == "x.csv"
    good = hashlib.sha256((tmp_path / "b.csv").read_bytes()).hexdigest()
    sums = spark.createDataFrame([("a.csv", "0"), ("b.csv", good), ("c.csv", good)], "name string, sha256 string")
    assert {r.name: r.status for r in archive.verified(spark, str(tmp_path / "*.csv"), sums).collect()} == {"a.csv": "CHECKSUM_MISMATCH", "b.csv": "ok", "c.csv": "missing_404"}
    book = archive.Ledger(spark, str(tmp_path / "ledger.json"))
    book.record("u", status="ok", sha256=good, byte_size=1)
    assert archive.Ledger(spark, str(tmp_path / "ledger.json")).has("u") and book.frame().count() == 1
    assert archive.quarantine_windows(spark, str(tmp_path / "none.json")).count() == 0


def test_sinks(spark, tmp_path):
    bars, _ = P.prepared(adapter.trades(spark, SF), HOURLY)
    for _ in range(2):
        sinks.stage(bars, str(tmp_path / "staged"))
    assert spark.read.parquet(str(tmp_path / "staged")).count() == HOURLY.n_bars
    assert sinks.markdown(spark.createDataFrame([(1, 0.5)], "a int, b double"), ["a", "b"], 2).splitlines()[-1] == "| 1 | 0.50 |"
    sinks.report_csv(spark.createDataFrame([(1, [2, 3])], "a int, b array<int>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().b == "[2,3]"


def test_depth_stream_counts_gaps(spark, tmp_path):
    rows = [("SYN", i, f, l, p) for i, (f, l, p) in enumerate([(90, 99, 89), (100, 105, 99), (106, 110, 105), (111, 120, 110), (130, 140, 129), (141, 150, 140)])]
    schema = "symbol string, ordinal long, first_id long, last_id long, pu long"
    batch = spark.createDataFrame(rows, schema)
    assert depth.sync_point(batch, 108).first().sync_ordinal == 2
    assert [r.continuous for r in depth.continuity(batch).orderBy("ordinal").collect()] == [True, True, True, True, False, True]
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = depth.checked_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 104).writeStream.format("memory").queryName("checked").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("select * from checked").first()
    assert (got.n_events, got.n_stale, got.n_gaps, got.last_u) == (5, 1, 1, 150)


def test_live_bars(spark, tmp_path):
    adapter.trades(spark, SF).withColumn("ts", F.timestamp_millis("transact_time")).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    q = depth.live_bars(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), width="1 hour").writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(*) n from live").first().n > 400


def test_gate_words_and_reconciliation(spark):
    assert [quality.gate(True, 0, 0), quality.gate(True, 0, 2), quality.gate(True, 1, 0), quality.gate(False, 0, 0)] == ["PASS", "PASS-WITH-EXCEPTIONS", "FAIL", "FAIL"]
    a = spark.createDataFrame([(1, 100.0), (2, 5.0), (4, 100.0)], "day long, volume double")
    b = spark.createDataFrame([(1, 100.0), (3, 5.0), (4, 0.0)], "day long, volume double")
    got = {r.day: (r.side, r.breach) for r in quality.reconciled(a, b).collect()}
    assert got == {1: ("both", False), 2: ("left", None), 3: ("right", None), 4: ("both", True)}


def test_ranks_and_predecessors_cross_chunks(spark):
    rows = [("S", i, None if i == 50 else float(i * 37 % 101), [float(i * j % 17) for j in range(i % 4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, bar_index long, x double, v array<double>")
    got = {r.bar_index: r.q for r in series.trailing_quantile(df, "x", 9, 6, "q", 20).collect()}
    for i in range(300):
        frame = [rows[j][2] for j in range(max(0, i - 9), i)]
        assert got[i] == (sorted(frame)[6] if len(frame) == 9 and None not in frame else None)
    pooled = {r.bar_index: (r.a, r.b) for r in series.pooled_ranks(df, "v", 9, {"a": 0.25, "b": 0.5}, 20).collect()}
    for i in range(300):
        pool = sorted(x for j in range(max(0, i - 9), i) for x in rows[j][3])
        assert pooled[i] == tuple(pool[min(int(p * len(pool)), len(pool) - 1)] if pool else None for p in (0.25, 0.5))
    gaps = df.where("bar_index % 70 < 3 or bar_index = 299")
    before = {r.bar_index: r.p for r in series.previous(gaps, "bar_index", "bar_index", "p", 20).collect()}
    order = sorted(before)
    assert [before[i] for i in order] == [None, *order[:-1]]


def test_prefix_sums_equal_frames(spark):
    df = spark.range(300).select(F.lit("S").alias("symbol"), F.col("id").alias("bar_index"), F.when(F.col("id") % 13 == 0, None).otherwise((F.col("id") * 37 % 101).cast("double")).alias("x"))
    got = series.rolling_sum(series.with_halo(df, 5, 20), "x", 5, "s", 20)
    rows = {r.bar_index: r.s for r in series.no_halo(got).collect()}
    x = {r.bar_index: r.x for r in df.collect()}
    for i in range(300):
        frame = [x[j] for j in range(max(0, i - 4), i + 1)]
        assert rows[i] == (sum(frame) if len(frame) == 5 and None not in frame else None)


@pytest.mark.parametrize("zone", ["Etc/UTC", "America/New_York"])
def test_ranks_keep_instants_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.range(60).selectExpr("'S' as symbol", "id as bar_index", "timestamp_millis(id * 3600000) as bar_ts", "double(id) as x", "array(double(id)) as v")
        got = series.trailing_quantile(df, "x", 5, 2, "q", 20)
        assert got.schema["bar_ts"].dataType.simpleString() == "timestamp"
        assert {(r.bar_index, r.ms, r.q) for r in got.selectExpr("bar_index", "unix_millis(bar_ts) as ms", "q").collect()} == {(i, i * 3_600_000, i - 3.0 if i >= 5 else None) for i in range(60)}
        pooled = series.pooled_ranks(df, "v", 5, {"a": 0.5}, 20)
        assert {(r.bar_index, r.ms, r.a) for r in pooled.selectExpr("bar_index", "unix_millis(bar_ts) as ms", "a").collect()} == {(i, i * 3_600_000, float(max(0, i - 5) + min(i, 5) // 2) if i else None) for i in range(60)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
