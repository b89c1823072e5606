"""Edge rows on which queries failed or left their SQL: zero prices, sums on a limit, fractions of a second."""

import datetime
import math
import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from tidemark import plans
from tidemark.functions import research
from tidemark.functions.columns import scaled
from tidemark.operators import hidden_markov, joins, markets, memory, resampling, windows
from tidemark.sources import snapshots
from tidemark.sources.tables import dealt


def prices(spark, closes):
    return spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(closes)], "symbol int, i bigint, close double")


def test_permuted_paths_pass_a_close_of_zero(spark):
    paths = {}
    for r in resampling.permuted_paths(prices(spark, [5, 0, 0, 4]), 6).collect():
        paths.setdefault(r.seed, {})[r.position] = (r.source, r.close)
    logs = [0.0, -math.inf, math.nan, math.inf]
    for path in paths.values():
        total = 0.0
        for at in range(4):
            source, close = path[at]
            total += logs[source]
            want = 5 * math.exp(total)
            assert close == pytest.approx(want, nan_ok=True)


def test_permuted_paths_round_halves_as_their_sql(spark):
    # each is a rounding error under a half of the fifth place, their products with 1e5 are halves or under
    values = [106.86127499999999, 19.150425, 0.000005, 1.5, -106.86127499999999, 2.5e17, math.inf, math.nan, None]
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, 5) + 0.0", [v]).fetchone()[0] for v in values]
    got = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(scaled("v", 5).alias("x")).collect()]
    assert got[0] == 106.86128 and got[1] == 19.15042
    assert got[:-1] == pytest.approx(want[:-1], rel=1e-15, nan_ok=True) and got[-1] is None is want[-1]


def test_regime_state_has_no_volatility_after_a_close_of_zero(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(hours=i), 1, "view", v, '{"k": 50}') for i, v in enumerate((5.0, 4.0, 0.0, 3.0))]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert math.isnan(plans.queries()["d20_regime_state"](spark, str(tmp_path)).first().vol)


def test_features_of_a_close_of_zero(spark):
    df = prices(spark, [5, 4, 0, 3, 6]).withColumns({"funding": F.lit(0.0), "oi": F.lit(1.0)})
    got = hidden_markov.regime_features(df).orderBy("i").collect()
    assert [r.log_ret for r in got] == pytest.approx([0.0, math.log(0.8), -math.inf, math.log(0.6), math.log(1.2)])
    assert got[1].roll_vol == pytest.approx(-math.log(0.8))
    assert [math.isnan(r.roll_vol) for r in got] == [False, False, True, True, True]


def test_a_label_on_a_base_of_zero_is_null(spark):
    got = prices(spark, [2, 0, 3, 6]).withColumn("label", windows.fixed_horizon_label("close", 2)).orderBy("i").collect()
    assert [r.label for r in got] == [0.5, None, None, None]


def test_a_cluster_on_its_cap_is_within_it(spark):
    weights = [0.1, 0.2, 0.3]
    assert 0.1 + 0.2 + 0.3 > 0.6
    df = spark.createDataFrame([(1, f"s{i}", x, "c", 0.0, 0.0) for i, x in enumerate(weights)], "book int, symbol string, weight double, cluster string, beta double, funding_bps double").coalesce(1)
    budget = lambda cap: memory.risk_budget(df, "book", max_symbol=1.0, max_cluster=cap, max_beta=1.0, max_funding=1.0).first().rejections
    assert budget(0.6) == [] and budget(0.59) == ["cluster_cap:c"]


def test_a_book_of_odd_weights_equals_its_sql(spark, tmp_path):
    # orders divisible by 97 have no number for a weight; of supplier 2 all are, one of 1 has no quantity, two rows no supplier
    rows = [(1, 10, 1, 30.0), (2, 11, 1, None), (97, 12, 1, 30.0), (97, 10, 2, 30.0), (194, 11, 2, 40.0), (3, 13, None, 50.0), (97, 14, None, 20.0)]
    spark.createDataFrame([(o, p, s, q, 0.08) for o, p, s, q in rows], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    same(plans.queries()["d88_portfolio_risk"](spark, str(tmp_path)), con, plans.oracle_sql()["d88_portfolio_risk"])


def test_a_drawdown_on_its_limit_fails_in_any_order(spark, tmp_path):
    # the mean of the taxes is a twenty-fourth, six times that a quarter; summed in the first order it is less
    taxes = [0.01, 0.06, 0.04, 0.04, 0.08, 0.05, 0.04, 0.05, 0.04, 0.05, 0.04, 0.0]
    for n, taxes in enumerate((taxes, sorted(taxes), sorted(taxes, reverse=True))):
        rows = [(1, "A", "F", t, 1.0, 0.0, 1.0) for t in taxes]
        df = spark.createDataFrame(rows, "l_suppkey bigint, l_returnflag string, l_linestatus string, l_tax double, l_quantity double, l_discount double, l_extendedprice double")
        df.coalesce(1).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        got = plans.queries()["d24_scenario_evaluation"](spark, f"{tmp_path}/{n}").first()
        assert (got.pass_rate, got.reasons) == (0.0, "drawdown_kill_switch")


def test_a_drift_on_its_threshold_does_not_warn(spark):
    df = spark.createDataFrame([(0.052 - 0.05,), (0.048 - 0.05,), (0.0021,)], "x double")
    got = [r.w for r in df.select(research.drift_warnings(F.create_map(F.lit("discount"), "x"), {"discount": 0.002}).alias("w")).collect()]
    assert 0.048 - 0.05 < -0.002 and got == [[], [], ["drift:discount"]]


def test_a_mean_discount_on_its_threshold_warns_as_its_double_does(spark, tmp_path):
    # 25 discounts of 0.048 and 0.052 on average, in any order and in many parts
    rows = [(s, x, q, 0.0) for s, more in ((1, 0.0), (2, 0.1)) for x, q in zip([0.05] * 24 + [more], [25.0] * 24 + [26.0], strict=True)]
    rows += [(3, x, 1.0, 0.0) for x in (0.05, math.nan)] + [(4, None, None, 0.0), (5, 0.05, math.inf, 0.0), (6, 0.05, 1e17, 0.0)]
    want = {1: "drift:discount", 2: "", 3: "drift:discount,drift:quantity", 4: "", 5: "drift:quantity", 6: "drift:quantity"}
    for n in range(4):
        random.Random(n).shuffle(rows)
        spark.createDataFrame(rows, "l_suppkey bigint, l_discount double, l_quantity double, l_tax double").repartition(1 + n).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        assert {r.l_suppkey: r.warnings for r in plans.queries()["d83_learning_drift"](spark, f"{tmp_path}/{n}").collect()} == want


def test_trades_that_cancel_out_absorb_nothing(spark):
    book = "array<struct<price:double,qty:double>>"
    depths = spark.createDataFrame([(1, 10, [(99.0, 5.0)], [(101.0, 5.0)])], f"symbol int, at int, bids {book}, asks {book}")
    trades = spark.createDataFrame([(1, i, x, 1.0, x == 0.6) for i, x in enumerate((0.1, 0.2, 0.3, 0.6))], "symbol int, at int, price double, qty double, buyer_is_maker boolean").coalesce(1)
    got = markets.microstructure(depths, trades).first()
    assert got.trade_count == 4 and got.signed_delta == pytest.approx(0.0) and got.absorption == 0.0


def test_a_feature_is_stale_a_fraction_of_a_second_late(spark):
    at = datetime.datetime(2024, 1, 1, 0, 0, 0, 200000)
    late = [(at, at + datetime.timedelta(seconds=s)) for s in (59.9, 60.0, 60.3)]
    df = spark.createDataFrame([("a", "paper", "low", 60, a, b) for a, b in late], "name string, modes string, risk string, max_age int, at timestamp_ntz, now timestamp_ntz")
    got = df.orderBy("now").select(F.concat_ws(",", *research.contract_issues("name", "modes", "risk", "max_age", "at", "now", mode="paper")).alias("issues")).collect()
    assert [r.issues for r in got] == ["", "", "feature_stale"]


@pytest.mark.parametrize("tile", [(2, 3), (1000, 1000)])
def test_correlations_in_tiles_match_the_plain_loop(spark, tile):
    rng = random.Random(5)
    rows = [(s, t, 7.0 if s == 3 else rng.gauss(s, 3)) for s in range(9) for t in range(12) if rng.random() < 0.7] + [(20, t, None) for t in range(8)] + [(21, t, 1e9 + t % 3) for t in range(8)]
    df = spark.createDataFrame(rows, "s bigint, t int, v double")
    got = {(r.a, r.b): (r.n, r.rho) for r in joins.correlations(df.where("s % 3 = 0"), df, by="s", on="t", value="v", least=3, tile=tile).collect()}
    held = {}
    for s, t, v in rows:
        held.setdefault(s, {})[t] = v
    want = {(a, b): sorted(held[a].keys() & held[b].keys()) for a in held for b in held if a % 3 == 0 and a != b}
    want = {k: ts for k, ts in want.items() if len(ts) >= 3}
    assert got.keys() == want.keys()
    for (a, b), ts in want.items():
        n, rho = got[a, b]
        assert n == len(ts)
        if 20 in (a, b):
            assert rho is None
        elif 3 in (a, b):
            assert math.isnan(rho)
        else:
            assert rho == pytest.approx(statistics.correlation([held[a][t] for t in ts], [held[b][t] for t in ts]), abs=1e-6)


def test_correlations_exchange_nothing_for_a_pair(spark):
    df = spark.range(400).selectExpr("id % 40 AS s", "cast(id / 40 AS int) AS t", "cast(pmod(hash(id), 100) AS double) AS v")
    few, many = (joins.correlations(df, df, by="s", on="t", value="v", tile=tile, digits=2) for tile in ((100, 100), (5, 4)))
    for found in (few, many):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() == 40 * 39
    assert all(r.rho == round(r.rho, 2) for r in few.collect())


def test_a_store_has_files_by_its_buckets_not_by_its_symbols(spark, tmp_path):
    df = spark.range(2000).select((F.col("id") % 1000).alias("symbol"), F.col("id").alias("i"))
    snapshots.store(df, str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("**/*.parquet"))) <= snapshots.BUCKETS
    assert sorted(snapshots.load(spark, str(tmp_path / "s")).collect()) == sorted(df.collect())
    for symbol in (7, 999):
        assert sorted(r.i for r in snapshots.load(spark, str(tmp_path / "s"), symbol).collect()) == [symbol, symbol + 1000]
    assert snapshots.load(spark, str(tmp_path / "s"), 1000).count() == 0


def test_parts_follow_the_rows(spark):
    few, many = (dealt(spark.range(n), "id", rows=50).rdd.getNumPartitions() for n in (100, 1000))
    assert (few, many) == (4, 20)
