"""The shared tables and the candle series built from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str, rows: int = 500_000) -> DataFrame:
    """``df`` dealt by ``keys`` into parts of about ``rows`` rows: what a task holds does not grow with the table.

    Counts the rows first, so ``df`` should be a table as it is stored.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def bars_from_ticks(ticks: DataFrame, *, symbol: str, price: str, ts: str = "ts", tie: str = "event_id", unit: str = "hour") -> DataFrame:
    """OHLCV bars of a tick table: first and last by (time, tie), one partially aggregated shuffle by symbol and bar."""
    order = F.struct(ts, tie)
    return ticks.groupBy(F.col(symbol).alias("symbol"), F.date_trunc(unit, ts).cast("timestamp_ntz").alias("ts")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(price).alias("volume"), F.count("*").alias("trade_count"),
        F.avg(F.get_json_object("props", "$.k").cast("double")).alias("k"), F.sum(F.when(F.col("event_type") == "error", F.col(price)).otherwise(0.0)).alias("liq"),
    )


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles per user with a bar index and sidecar series: funding, open interest, liquidations."""
    bars = bars_from_ticks(table(spark, sf_dir, "events"), symbol="user_id", price="value")
    i = (F.row_number().over(W.partitionBy("symbol").orderBy("ts")) - 1).cast("bigint")
    return bars.select("symbol", "ts", i.alias("i"), "open", "high", "low", "close", "volume", "trade_count", ((F.col("k") - 50) / 2500).alias("funding"), (100 + 10 * F.col("k")).alias("oi"), "liq")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where none is set, a temporary folder on one machine and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-stream-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialised in the folder the cluster shares, so that a lost executor costs a re-read only."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
