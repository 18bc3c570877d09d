"""Archive files that digits or line breaks make hard to read."""

import json

import duckdb
import pytest

from tickloom import catalog
from tickloom.sources import archive


def test_funding_keeps_ms_of_more_than_13_digits(spark, tmp_path):
    path = f"{tmp_path}/events.parquet"
    for ids in ([0, 7], [288_194, 288_195], [288_196], [5_999_998, 5_999_999]):
        spark.createDataFrame([(i,) for i in ids], "event_id long").coalesce(1).write.mode("append").parquet(path)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{path}/*.parquet'")
    want = con.sql(catalog.ORACLES["src_csv_funding"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["src_csv_funding"](spark, str(tmp_path)).collect()]
    assert len(want) == 7 and sorted(got) == sorted(want)


def test_a_stated_unit_holds_and_others_are_told_by_digits(spark, tmp_path):
    (tmp_path / "f.csv").write_text("calc_time,hours,rate\n17000000000000,8,0.0001\n")
    path = str(tmp_path / "f.csv")
    assert {u: archive.read_csv(spark, path, "funding", unit=u).first().calc_time for u in (None, "ms", "us", "ns")} == {None: 17_000_000_000, "ms": 17_000_000_000_000, "us": 17_000_000_000, "ns": 17_000_000}
    with pytest.raises(ValueError):
        archive.read_csv(spark, path, "funding", unit="days")


RECORDS = [{"symbol": s, "start_ms": a, "end_ms": a + 100, "note": "of \n ] } [ {"} for s, a in (("BTC", 100), ("BTC", 1_700_000_000_000), ("ETH", 1))]
LINES = "\n".join(map(json.dumps, RECORDS))
FORMS = {
    "array": json.dumps(RECORDS), "indented array": json.dumps(RECORDS, indent=2) + "\n", "lines": LINES + "\n", "crlf": LINES.replace("\n", "\r\n\r\n"), "indented objects": "\n".join(json.dumps(r, indent=2) for r in RECORDS),
    "two arrays": json.dumps(RECORDS[:1]) + json.dumps(RECORDS[1:]),
}


@pytest.mark.parametrize("form", FORMS)
def test_quarantine_keeps_every_record(spark, tmp_path, form):
    (tmp_path / "q.json").write_text(FORMS[form], newline="")
    got = sorted(tuple(r) for r in archive.quarantine_windows(spark, str(tmp_path / "q.json")).collect())
    assert got == sorted((r["symbol"], r["start_ms"], r["end_ms"]) for r in RECORDS)


def test_quarantine_of_many_files_without_and_with_windows(spark, tmp_path):
    for name, text in (("a", LINES), ("b", ""), ("c", "[]\n"), ("d", FORMS["indented array"])):
        (tmp_path / f"{name}.json").write_text(text)
    assert archive.quarantine_windows(spark, str(tmp_path)).count() == 2 * len(RECORDS)
    (tmp_path / "e.json").write_text(LINES[:-9])
    with pytest.raises(Exception, match="JSONDecodeError"):
        archive.quarantine_windows(spark, str(tmp_path)).collect()


def test_quarantine_query_has_the_rows_of_its_sql(spark):
    want = duckdb.connect().sql(catalog.ORACLES["src_quarantine"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["src_quarantine"](spark, "/root/testdata/sf0.001").collect()]
    assert len(want) == 6 and sorted(got) == sorted(want)
