"""Edge cases of the forecast, contract and calibration expressions."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import research as x
from tidemark.operators import joins

T = [datetime.datetime(2024, 1, 1, h) for h in range(4)]


def first(df):
    return df.first().asDict()


def test_forecast_fields_and_issues(spark):
    df = spark.createDataFrame([([90.0], [101.0], [120.0], 100.0)], "a array<double>, b array<double>, c array<double>, last double")
    f = x.forecast_fields("a", "b", "c", "last")
    got = first(df.select(*[v.alias(k) for k, v in f.items()], x.direction_confidence("b", "last").alias("d")))
    assert got["q50_return"] == pytest.approx(0.01) and got["direction"] == 1
    assert got["skew"] == pytest.approx((19 - 11) / 30) and got["uncertainty"] == pytest.approx(0.3) and got["confidence"] == "low"
    assert got["d"] == pytest.approx(0.01)
    bad = spark.createDataFrame([([1.0], [2.0, 3.0], [4.0, 5.0]), ([3.0], [2.0], [4.0]), ([None], [2.0], [4.0]), ([1.0], [2.0], [4.0])], "a array<double>, b array<double>, c array<double>")
    said = [r[0] for r in bad.select(F.concat_ws(",", *x.forecast_issues("a", "b", "c"))).collect()]
    assert said == ["length_mismatch", "quantiles_not_ordered", "quantiles_not_ordered", ""]


def test_counts_merge_by_maximum(spark):
    df = spark.createDataFrame([({"a": 1, "b": 5}, {"b": 2, "c": 3})], "m map<string,int>, n map<string,int>")
    assert first(df.select(x.merged_counts(F.col("m"), F.col("n")).alias("r")))["r"] == {"a": 1, "b": 5, "c": 3}


def test_tiers_fall_back_to_the_last(spark):
    tiers = [{"name": "b", "max_leverage": 20.0}, {"name": "a", "max_leverage": 5.0, "max_notional": 10.0}]
    df = spark.createDataFrame([(5.0, 10.0), (5.0, 11.0), (30.0, 1.0)], "l double, n double")
    assert [r[0] for r in df.select(x.tier_entry(F.col("l"), F.col("n"), tiers)["name"]).collect()] == ["a", "b", "b"]


def test_track_record_of_no_edge(spark):
    df = spark.createDataFrame([("up", v) for v in (0.01, 0.02, 0.03, 0.02)] + [("down", -v) for v in (0.01, 0.02, 0.03, 0.02)] + [("few", 0.1)], "k string, r double")
    got = {r["k"]: r["n"] for r in df.groupBy("k").agg(x.minimum_track_record("r").alias("n")).collect()}
    assert got["down"] == x.NEVER and got["few"] == 0 and 1 < got["up"] < 100


def test_point_in_time_join(spark):
    left = spark.createDataFrame([("s", T[1], 1), ("s", T[2], 2)], "k string, at timestamp, n int")
    made = [("s", T[1], T[0], 1, 5.0), ("s", T[1], T[0], 2, 6.0)]
    kind = "k string, at timestamp, known timestamp, id int, v double"
    join = lambda rows: joins.point_in_time_join(left, spark.createDataFrame(rows, kind), keys=["k", "at"], values=["v"], known_at="known", deadline="at", tie="id")
    assert {r["n"]: r["v"] for r in join(made).collect()} == {1: 6.0, 2: None}
    with pytest.raises(Exception, match="looks ahead"):
        join([*made, ("s", T[2], T[3], 3, 7.0)]).collect()


def test_symbols_and_sides(spark):
    df = spark.createDataFrame([(" btc/usdt:usdt ",), ("ethusdc",), ("abc",)], "s string")
    got = df.select(x.venue_symbol(F.col("s")), x.quote_currency(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("BTCUSDT", "USDT"), ("ETHUSDC", "USDC"), ("ABC", None)]
    one = spark.range(1).select(x.side_bps(F.lit("sell"), F.lit(100.0), F.lit(99.0)).alias("b"), x.opportunity_loss(F.lit("BUY"), F.lit(100.0), F.lit(99.0), F.lit(2.0)).alias("none"), x.opportunity_loss(F.lit("BUY"), F.lit(100.0), F.lit(101.0), F.lit(2.0)).alias("lost"))
    assert first(one) == {"b": pytest.approx(100.0), "none": 0.0, "lost": pytest.approx(2.0)}


def test_means_on_the_gate_follow_the_order_of_the_table(spark, tmp_path):
    import duckdb
    import pyarrow.parquet as pq

    from tidemark import plans

    # many row groups in many parts: sums of parts would round otherwise than sums in order
    pq.write_table(pq.read_table("/root/testdata/sf0.01/lineitem.parquet"), tmp_path / "lineitem.parquet", row_group_size=2000)
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = sorted(con.execute(plans.oracle_sql()["g06_gate_regressions"]).fetchall())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = sorted(tuple(r) for r in plans.queries()["g06_gate_regressions"](spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want
