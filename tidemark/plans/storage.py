"""Queries of the source and sink family."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.columns import c, r
from tidemark.plans.registry import over_candles, query
from tidemark.sources import bundles, snapshots
from tidemark.sources.tables import candles, table
from tidemark.streaming.events import shared_folder


@query(over_candles("SELECT symbol, i, ts, round(close, 6) + 0.0 AS close FROM candles WHERE symbol = 7"))
def a08_store_and_load(spark, sf_dir):
    """Written in folders by a hash of the symbol to the shared folder, one symbol read back."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    snapshots.store(candles(spark, sf_dir), root)
    return snapshots.load(spark, root, 7).select(c("symbol").cast("bigint").alias("symbol"), "i", "ts", r("close").alias("close"))


@query(over_candles("SELECT symbol, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts FROM candles GROUP BY symbol"))
def a10_snapshot_catalog(spark, sf_dir):
    return snapshots.catalog(candles(spark, sf_dir))


@query("SELECT o_orderkey, o_totalprice, false AS refreshed FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, o_totalprice * 2, true FROM orders WHERE o_orderkey % 4 = 0")
def a14_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(False).alias("refreshed"))
    new = o.where("o_orderkey % 4 = 0").withColumns({"o_totalprice": c("o_totalprice") * 2, "refreshed": F.lit(True)})
    return snapshots.upsert(o, new, ["o_orderkey"])


@query("SELECT user_id AS symbol, date_trunc('hour', ts) AS ts, round(first(value ORDER BY ts, event_id), 2) AS open, round(max(value), 2) AS high FROM events GROUP BY 1, 2")
def a01_csv_round_trip(spark, sf_dir):
    """Candles written as CSV under alias headers, read back through the alias reader."""
    root = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = candles(spark, sf_dir).select(c("symbol"), F.unix_seconds(c("ts").cast("timestamp")).alias("Time"), c("open").alias(" O"), c("high").alias("H"), c("low").alias("L"), c("close").alias("C"), c("symbol").alias("Vol"))
    rows.drop("symbol").write.option("header", True).csv(root)
    back = snapshots.snapshot_from_csv(spark, root)
    return back.select(c("volume").cast("bigint").alias("symbol"), c("ts").cast("timestamp_ntz").alias("ts"), F.round("open", 2).alias("open"), F.round("high", 2).alias("high"))


@query("SELECT user_id, event_id, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def t14_first_wins(spark, sf_dir):
    return snapshots.first_wins(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "props")


@query("""WITH h AS (SELECT sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || o_totalprice || '}') AS h FROM orders),
per AS (SELECT substr(h, 1, 2) || ':' || count(*) || ':' || sum(('0x' || substr(h, 3, 13))::BIGINT) AS b FROM h GROUP BY substr(h, 1, 2))
SELECT sha256(string_agg(b, ',' ORDER BY b)) AS version FROM per""")
def a20_dataset_version(spark, sf_dir):
    """One digest of all orders, whatever their order."""
    return snapshots.dataset_version(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus"])


EXPORTED = ("customer", "events", "orders")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, count(*) AS expected_rows, 'verified' AS status FROM {t}" for t in EXPORTED))
def a27_verified_bundle(spark, sf_dir):
    """Three tables exported as one bundle to the shared folder, counted and digested again from its files."""
    folder = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    bundles.export_bundle({t: table(spark, sf_dir, t) for t in EXPORTED}, folder)
    return bundles.verified_bundle(spark, folder)


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders GROUP BY o_orderpriority")
def a28_restored_bundle(spark, sf_dir):
    """A table restored from a bundle with its types, and used."""
    folder = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    bundles.export_bundle({"orders": table(spark, sf_dir, "orders")}, folder)
    back = bundles.restored_bundle(spark, folder)["orders"]
    return back.groupBy("o_orderpriority").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"))
