"""Queries against their SQL twins on the smallest tables."""

import datetime
import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tickloom import catalog

SF = Path("/root/testdata/sf0.001")
SOME = ["src_trades", "src_normalised_ms", "prj_calendar", "bars_partial", "bars_hourly", "buckets_hourly", "bars_coarse", "win_divergence", "win_quantile", "win_pooled_percentiles", "det_all", "hyg_dedup", "sta_returns", "cst_net_returns", "qa_reconciled", "qa_order", "qa_backfilled", "qa_explained", "str_continuity", "str_sync", "sta_fdr", "prj_seed", "src_csv_trades", "src_csv_depth", "src_verified", "src_zip", "src_ledger", "src_jsonl", "snk_staged", "snk_stream", "str_checked", "agg_extensions", "sta_cells_given", "sta_promotion_given", "sta_placebo_given", "agg_sign_agreement", "fig_paths"]


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, list):
        return [plain(v) for v in x]
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    names = sorted(df.columns)
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == names
    want = sorted(([plain(v) for v in r] for r in rel.project(",".join(f'"{c}"' for c in names)).fetchall()), key=repr)
    got = sorted(([plain(v) for v in r] for r in df.select(*names).collect()), key=repr)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
