"""Archives and bundles on files of their own, and the timers of sessions."""

import hashlib
import io
import zipfile
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.sources import archive, bundles
from tidemark.streaming import events


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    head = "open_time,open,high,low,close,volume,close_time,quote,count\n"
    line = lambda ms, close, *more: ",".join(map(str, [ms, close, close + 1, close - 1, close, 5.5, *more])) + "\n"
    may = zipped({"BTCUSDT-15m-2024-05.csv": head + line(1714521600000, 100.0, 0, 0, 7) + "\n" + line(1714522500000, 101.0) + "short,1,2\n" + "x,1,2,3,4,5\n" + line(1714523400000, "nan".replace("nan", "1e999") and 102.0, 0, 0, ""), "folder/": ""})
    june = zipped({"a.csv": line(1717200000000, 110.0, 0, 0, 3), "b.csv": "Timestamp,o\n" + line(1717200900000.0, 111.0) + "1717201800000,1,2,inf,4,5\n"})
    other = zipped({"x.csv": line(1714521600000, 9.0)})
    for name, data in (("BTCUSDT-15m-2024-05.zip", may), ("BTCUSDT-15m-2024-06-01.zip", june), ("ETHUSDT-1h-2024-05.zip", other)):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "BTCUSDT-15m-2024-05.zip.CHECKSUM").write_text(hashlib.sha256(may).hexdigest().upper() + "  BTCUSDT-15m-2024-05.zip\n")
    (tmp_path / "ETHUSDT-1h-2024-05.zip.CHECKSUM").write_text("0" * 64 + "  ETHUSDT-1h-2024-05.zip\n")
    (tmp_path / "notes.txt").write_text("no archive")
    return str(tmp_path)


def test_archives_are_read_checked_and_narrowed_by_name(spark, folder):
    got = archive.archive_candles(spark, folder, symbol="BTCUSDT").orderBy("ts").collect()
    assert [(r.close, r.trade_count) for r in got] == [(100.0, 7), (101.0, 0), (102.0, 0), (110.0, 3), (111.0, 0)]
    assert {(r.symbol, r.interval) for r in got} == {("BTCUSDT", "15m")}
    first = archive.archive_candles(spark, folder, symbol="BTCUSDT").select(F.unix_millis(F.min("ts")).alias("ms")).first()
    assert first.ms == 1714521600000
    assert archive.archive_candles(spark, folder, symbol="BTCUSDT", period="2024-06").count() == 2
    assert archive.archive_candles(spark, folder, interval="1m").count() == 0
    report = {r.file: (r.symbol, r.interval, r.period, r.status, r.kept, r.dropped) for r in archive.archive_report(spark, folder).collect()}
    assert report == {
        "BTCUSDT-15m-2024-05.zip": ("BTCUSDT", "15m", "2024-05", "validated", 3, 2), "BTCUSDT-15m-2024-06-01.zip": ("BTCUSDT", "15m", "2024-06-01", "unavailable", 2, 1), "ETHUSDT-1h-2024-05.zip": ("ETHUSDT", "1h", "2024-05", "mismatch", 0, 0),
    }


def test_a_wrong_checksum_is_refused(spark, folder):
    with pytest.raises(Exception, match="checksum mismatch: ETHUSDT-1h-2024-05.zip"):
        archive.archive_candles(spark, folder).count()
    assert archive.archive_candles(spark, folder, strict=False).count() == 5


def test_bundles_come_back_as_they_were(spark, sf, tmp_path):
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "events")}
    tables["odd"] = spark.createDataFrame([(1, None, float("1e-300"), datetime(2024, 1, 1, 0, 0, 0, 123456), [1, None], "line\nbreak \"q\"  "), (2, "", None, None, None, None)], "a int, `b.c` string, d double, t timestamp, l array<int>, s string")
    folder = str(tmp_path / "bundle")
    bundles.export_bundle(tables, folder)
    assert {(r.name, r.status) for r in bundles.verified_bundle(spark, folder).collect()} == {(t, "verified") for t in tables}
    back = bundles.restored_bundle(spark, folder)
    for name, df in tables.items():
        assert back[name].schema.simpleString() == df.schema.simpleString()
        assert sorted(map(str, back[name].collect())) == sorted(map(str, df.collect()))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        bundles.export_bundle(tables, folder)


def test_one_altered_byte_is_found(spark, sf, tmp_path):
    folder = str(tmp_path / "bundle")
    bundles.export_bundle({"orders": spark.read.parquet(f"{sf}/orders.parquet"), "nation": spark.read.parquet(f"{sf}/nation.parquet")}, folder)
    part = next(p for p in Path(folder, "tables", "orders").glob("part-*") if p.stat().st_size > 1000)
    data = part.read_bytes()
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    at = data.index(b'"o_totalprice":') + len(b'"o_totalprice":')
    part.write_bytes(data[:at] + (b"2" if data[at : at + 1] != b"2" else b"3") + data[at + 1 :])
    assert {(r.name, r.status) for r in bundles.verified_bundle(spark, folder).collect()} == {("orders", "digest differs"), ("nation", "verified")}
    with pytest.raises(ValueError, match="orders: digest differs"):
        bundles.restored_bundle(spark, folder)
    part.write_bytes(data[: data.index(b"\n") + 1])
    assert {(r.name, r.status) for r in bundles.verified_bundle(spark, folder).where("name = 'orders'").collect()} == {("orders", "rows differ")}


def test_export_is_one_scan_a_table(spark, sf):
    from pyspark.sql import Observation

    df = spark.read.parquet(f"{sf}/orders.parquet")
    plan = df.observe(Observation("x"), *bundles._metrics(df.columns))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def stream_of(spark, tmp_path, batches):
    """A file stream with one file a batch."""
    folder = tmp_path / "in"
    t0 = datetime(2024, 1, 1)
    for k, rows in enumerate(batches):
        spark.createDataFrame([(n, t0 + timedelta(hours=h), u, "view", 1.0, "{}") for n, (u, h) in enumerate(rows)], events.SCHEMA).coalesce(1).write.parquet(str(folder / f"events{k}"))
    raw = spark.readStream.schema(events.SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder / "events*"))
    return raw.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "2 hours")


def beats(spark, stream):
    t0 = datetime(2024, 1, 1)
    out = events.drained(events.heartbeats(stream), "append").withColumns({x: F.col(x).cast("timestamp_ntz") for x in ("started", "at")}).collect()
    return sorted((r.user_id, (r.at - t0).total_seconds() / 3600, r.kind, r.messages) for r in out)


def test_a_silent_session_beats_once_an_interval_and_is_dropped(spark, tmp_path):
    # user 1 falls silent after two events; user 2 only moves the clock
    got = beats(spark, stream_of(spark, tmp_path, [[(1, 0), (1, 1)], [(2, 20)], [(2, 30)], [(2, 60)], [(2, 61)]]))
    assert [x for x in got if x[0] == 1] == [(1, 6.0, "heartbeat", 2), (1, 12.0, "heartbeat", 2), (1, 18.0, "heartbeat", 2), (1, 24.0, "heartbeat", 2), (1, 25.0, "expired", 2)]


@pytest.mark.parametrize("cuts", [[], [3], [1, 2, 3, 4, 5]])
def test_beats_do_not_depend_on_batches(spark, tmp_path, cuts):
    rows = [(1, 0), (1, 5), (1, 13), (1, 14), (1, 50), (1, 51), (2, 90)]
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    got = beats(spark, stream_of(spark, tmp_path, parts))
    assert [x[1:] for x in got if x[0] == 1] == [(6.0, "heartbeat", 2), (12.0, "heartbeat", 2), (18.0, "heartbeat", 4), (24.0, "heartbeat", 4), (30.0, "heartbeat", 4), (36.0, "heartbeat", 4), (38.0, "expired", 4), (56.0, "heartbeat", 2), (62.0, "heartbeat", 2), (68.0, "heartbeat", 2), (74.0, "heartbeat", 2), (75.0, "expired", 2)]
