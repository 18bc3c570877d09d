"""The sensitivity grid and the comparison of seeds, whole."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tickloom.config import HOURLY, SIGNALS
from tickloom.operators import bars as B
from tickloom.operators import detectors, hygiene
from tickloom.plans import study as P
from tickloom.sources import adapter

SF = "/root/testdata/sf0.001"
SMALL = replace(HOURLY, grid_reps=300, reps=300)


def test_grid_has_every_cell_with_errors_and_counts(spark):
    bars, buckets = P.prepared(adapter.trades(spark, SF), SMALL)
    variants = {"base": SMALL}
    got = P.sensitivity(bars, buckets, SMALL, variants).collect()
    assert P.variant(SMALL, bar_ms=2 * SMALL.bar_ms).gap == SMALL.gap // 2
    assert sorted((r.config, r.signal, r.h) for r in got) == sorted((c, s, h) for c in variants for s in SIGNALS for h in SMALL.horizons)
    assert any(r.n > 1 for r in got)
    for r in got:
        if r.n == 0:
            assert r.mean is None and r.se is None
            continue
        assert r.ci_low <= r.mean <= r.ci_high or r.n < 5
        assert r.se == pytest.approx((r.ci_high - r.ci_low) / 3.92) and (r.t == pytest.approx(r.mean / r.se) if r.se else r.t is None)
    raw = detectors.detect_all(bars, buckets, SMALL.delta, SMALL.detect)
    for d, name in ((raw, "n_raw"), (hygiene.hygiene(raw, SMALL.warmup, SMALL.gap), "n_final")):
        want = {r.signal: r["count"] for r in d.groupBy("signal").count().collect()}
        assert {r.signal: r[name] for r in got if r.config == "base"} == {s: want.get(s, 0) for s in SIGNALS}


def test_seeds_are_compared(spark):
    # H1 is far from zero at every horizon; H2 is as often above as below it
    rows = [("SYN", s, h, d, x) for h in SMALL.horizons for d in range(20) for s, x in (("H1", 0.01 + d * 1e-4), ("H2", (-1.0) ** d))]
    long = spark.createDataFrame(rows, "symbol string, signal string, h int, day long, r double")
    got = P.seed_invariance(long, SMALL).collect()
    assert len({r.seed for r in got}) == 3
    for r in got:
        assert [tuple(c) for c in r.significant] == [("H1", h) for h in SMALL.horizons] and r.matches
    none = P.seed_invariance(long.where(F.col("signal") == "H2"), SMALL).collect()
    assert all(r.significant == [] and r.matches for r in none) and len(none) == 3
