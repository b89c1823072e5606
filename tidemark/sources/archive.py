"""Local archives of candles: zip files with checksum files beside them.

Files are named ``SYMBOL-INTERVAL-PERIOD.zip`` (a month or a day) and may have
``<name>.CHECKSUM``, the SHA-256 of the zip and its name.  Spark lists and reads
them as binary files, so any store that Spark reads will do, names narrow the
listing before anything is read, and one file is one row of work; members are
parsed line by line inside the task.
"""

from __future__ import annotations

import csv
import io
import math
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import c

ROWS = 50_000
# First cells of header lines, and the places of the fields in a line.
HEADERS = {"open_time", "timestamp"}
FIELDS, LEAST, TRADES = ("open", "high", "low", "close", "volume"), 6, 8
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_NAME = r"([^/]+)-([^-/]+)-(\d{4}-\d{2}(?:-\d{2})?)\.zip$"


def archive_files(spark: SparkSession, folder: str, *, symbol: str | None = None, interval: str | None = None, period: str | None = None) -> DataFrame:
    """``file, symbol, interval, period, status, content`` of the zip files wanted; ``period`` may be a beginning such as 2024 or 2024-05.

    ``status``: validated, mismatch, or unavailable where there is no checksum.
    """
    pattern = f"{symbol or '*'}-{interval or '*'}-{period or ''}*"
    read = lambda glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    zips = read(pattern + ".zip").select(name.alias("file"), "content").where(c("file").rlike(_NAME))
    sums = read(pattern + ".zip.CHECKSUM").select(F.regexp_replace(name, r"\.CHECKSUM$", "").alias("file"), F.lower(F.regexp_extract(c("content").cast("string"), r"^\s*([0-9a-fA-F]{64})", 1)).alias("expected"))
    status = F.when(c("expected").isNull(), "unavailable").when(F.sha2("content", 256) == c("expected"), "validated").otherwise("mismatch")
    return zips.join(sums, "file", "left").select("file", *[F.regexp_extract("file", _NAME, i + 1).alias(n) for i, n in enumerate(("symbol", "interval", "period"))], status.alias("status"), "content")


def parsed_lines(content: bytes) -> Iterator[tuple | None]:
    """(ts, open, high, low, close, volume, trade_count) of every line of every member, None for one that is no candle; headers and blank lines are neither."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for member in archive.infolist():
            if member.is_dir():
                continue
            with archive.open(member) as handle:
                for cells in csv.reader(io.TextIOWrapper(handle, "utf-8", newline="")):
                    if not cells or cells[0].strip().lower() in HEADERS:
                        continue
                    try:
                        at = _EPOCH + timedelta(milliseconds=int(float(cells[0])))
                        values = [float(x) for x in cells[1 : 1 + len(FIELDS)]]
                        trades = int(float(cells[TRADES])) if len(cells) > TRADES and cells[TRADES] else 0
                    except (ValueError, OverflowError):
                        yield None
                        continue
                    yield (at, *values, trades) if len(cells) >= LEAST and all(map(math.isfinite, values)) else None


def _checked(files: DataFrame, strict: bool) -> DataFrame:
    if not strict:
        return files.where("status <> 'mismatch'")
    refused = F.when(c("status") == "mismatch", F.raise_error(F.concat(F.lit("checksum mismatch: "), c("file"))).cast("string")).otherwise(c("status"))
    return files.withColumn("status", refused)


def archive_candles(spark: SparkSession, folder: str, *, symbol: str | None = None, interval: str | None = None, period: str | None = None, strict: bool = True) -> DataFrame:
    """``symbol, interval, ts, open, high, low, close, volume, trade_count, file`` of the candles in the archives.

    Lines that are no candle are dropped (``archive_report`` counts them).  A file
    whose checksum differs is an error, or left out if not ``strict``.
    """
    kinds = [pa.timestamp("us", "UTC"), *[pa.float64()] * len(FIELDS), pa.int64()]
    names = ["symbol", "interval", "ts", *FIELDS, "trade_count", "file"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.select(["file", "symbol", "interval", "content"]).to_pylist():
                held: list[tuple] = []
                lines = (x for x in parsed_lines(f["content"]) if x is not None)
                while held := [x for _, x in zip(range(ROWS), lines, strict=False)]:
                    same = lambda v, n=len(held): pa.array([v] * n, pa.string())
                    yield pa.RecordBatch.from_arrays([same(f["symbol"]), same(f["interval"]), *[pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], same(f["file"])], names=names)

    files = _checked(archive_files(spark, folder, symbol=symbol, interval=interval, period=period), strict)
    return files.where("status IS NOT NULL").mapInArrow(run, "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume double, trade_count bigint, file string")


def archive_report(spark: SparkSession, folder: str, **wanted) -> DataFrame:
    """``file, symbol, interval, period, status, kept, dropped`` of every archive, those that are refused included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, dropped = [], []
            for status, content in zip(batch.column("status").to_pylist(), batch.column("content").to_pylist(), strict=True):
                good = bad = 0
                for line in parsed_lines(content) if status != "mismatch" else ():
                    good, bad = good + (line is not None), bad + (line is None)
                kept.append(good)
                dropped.append(bad)
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("file", "symbol", "interval", "period", "status")], pa.array(kept, pa.int64()), pa.array(dropped, pa.int64())], names=["file", "symbol", "interval", "period", "status", "kept", "dropped"])

    return archive_files(spark, folder, **wanted).mapInArrow(run, "file string, symbol string, interval string, period string, status string, kept bigint, dropped bigint")
