"""Literal fixtures and plain-loop parity of single operators."""

import random
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import costs, stats
from tidemark.operators import backtest, joins, portfolio, recursive, resampling, windows
from tidemark.sources import snapshots


def series(spark, closes, **more):
    rows = [(1, i, float(x), float(x) + 1, float(x) - 1) for i, x in enumerate(closes)]
    df = spark.createDataFrame(rows, "symbol int, i bigint, close double, high double, low double")
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def test_flat_series_has_neutral_strength(spark):
    assert column(recursive.indicators(series(spark, [100] * 20)), "rsi") == [50.0] * 20


@pytest.mark.parametrize("chunk", [3, 7, 4096])
def test_recursions_do_not_depend_on_chunks(spark, chunk):
    rng = random.Random(3)
    closes = [100 + rng.gauss(0, 3) for _ in range(40)]
    got = column(recursive.indicators(series(spark, closes), ema=5, chunk=chunk), "ema")
    want, y = [], 0.0
    for i, x in enumerate(closes):
        y = sum(closes[: i + 1]) / (i + 1) if i < 5 else y + (x - y) / 3
        want.append(y)
    assert got == pytest.approx(want)


def test_weighted_mean_is_exact(spark):
    closes = [3.0, 1, 4, 1, 5, 9, 2, 6]
    got = column(series(spark, closes).withColumn("w", windows.wma("close", 3)), "w")
    assert got[:2] == pytest.approx([3.0, 2.0])
    assert got[2:] == pytest.approx([(closes[i - 2] + 2 * closes[i - 1] + 3 * closes[i]) / 6 for i in range(2, 8)])


def test_smoothing_takes_the_left_label(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate("aaabccc")], "symbol int, i bigint, regime string")
    assert "".join(column(windows.smoothed_labels(df, "regime", 2), "smoothed")) == "aaaaccc"


def test_asof_join_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([("a", t) for t in (0, 5, 9)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10.0), ("a", 5, 20.0), ("b", 2, 30.0)], "k string, t int, v double")
    got = {r.t: r.v for r in joins.asof_join(left, right, by=["k"], on="t", values=["v"]).collect()}
    assert got == {0: None, 5: 20.0, 9: 20.0}


def test_purge_matches_the_nested_loop(spark):
    train = [(1, s, s + 3) for s in range(0, 60, 2)]
    test = [(1, 10, 12), (1, 11, 15), (1, 40, 41)]
    kept = joins.purge(spark.createDataFrame(train, "k int, s int, e int"), spark.createDataFrame(test, "k int, s int, e int"), by="k", start="s", end="e", embargo=2)
    want = {t for t in train if not any(t[1] < b[2] + 2 and b[1] < t[2] for b in test)}
    assert {tuple(r) for r in kept.collect()} == want


def test_reconcile_statuses(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "id int, q double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (4, 4.0)], "id int, q double")
    got = {r["id"]: r["status"] for r in joins.reconcile(a, b, keys=["id"], values=["q"]).collect()}
    assert got == {1: "match", 2: "mismatch", 3: "missing_right", 4: "missing_left"}


def test_false_discovery_and_sentinels(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2), (1, 0.3)], "k int, ret double")
    row = df.groupBy("k").agg(stats.sortino("ret").alias("s"), stats.sharpe("ret").alias("h")).first()
    assert row.s == 999.0
    assert row.h == pytest.approx(2.0)


def test_depth_walk(spark):
    df = spark.createDataFrame([([(100.0, 2.0), (101.0, 3.0)], 4.0)], "levels array<struct<price:double,qty:double>>, q double")
    got = df.select(costs.depth_walk(F.col("levels"), F.col("q")).alias("w")).first().w
    assert (got.filled, got.vwap) == (4.0, pytest.approx((200 + 202) / 4))


@pytest.mark.parametrize(("text", "iso"), [("1704067200", "2024-01-01T00:00:00"), ("1704067200000", "2024-01-01T00:00:00"), ("1704067200.0", "2024-01-01T00:00:00"), ("2024-01-01T00:00:00", "2024-01-01T00:00:00"), ("soon", None)])
def test_timestamps(spark, text, iso):
    got = spark.createDataFrame([(text,)], "x string").select(costs.epoch_timestamp(F.col("x")).cast("timestamp_ntz").alias("t")).first().t
    assert (got.isoformat() if got else None) == iso


def test_numbers_and_null_markers(spark):
    df = spark.createDataFrame([("1,234.5",), ("n/a",), ("--",), ("x",), (None,)], "x string").select(costs.number_or_flag(F.col("x")).alias("v"))
    assert [(r.v.value, r.v.invalid) for r in df.collect()] == [(1234.5, False)] + [(0.0, True)] * 4


def test_base_asset_keeps_the_order_of_replacements(spark):
    df = spark.createDataFrame([("BTCUSDT",), ("BTCBUSD",), ("BTCUSDC",)], "s string").select(costs.base_asset(F.col("s")).alias("b"))
    assert [r.b for r in df.collect()] == ["BTC", "BTCB", "BTCC"]


def bars(closes, funding=0.0):
    return pd.DataFrame({"close": closes, "low": [x - 1 for x in closes], "high": [x + 1 for x in closes], "funding": funding, "settlements": 0.0})


def flags(n, *at):
    import numpy as np

    x = np.zeros(n, bool)
    x[list(at)] = True
    return x


def test_no_signal_no_trade():
    book, curve = backtest.backtest(bars([100.0] * 10), flags(10), flags(10), 1, 1.0, backtest.Rules())
    assert (book.trades, book.equity(), curve.tolist()) == (0, 0.0, [0.0] * 10)


def test_one_round_trip_pays_both_ways():
    closes = [100.0 + i for i in range(10)]
    book, curve = backtest.backtest(bars(closes), flags(10, 2), flags(10, 5), 1, 1.0, backtest.Rules(fee_bps=10, slippage_bps=0))
    assert (book.trades, book.wins) == (1, 1)
    assert book.equity() == pytest.approx(3 - (102 + 105) * 1e-3)
    assert curve[-1] == pytest.approx(book.equity())
    assert curve[3] == pytest.approx(1 - 0.102)


def test_liquidation_closes_at_the_ruin_price():
    closes = [100.0, 100, 100, 60, 60, 60]
    book, _ = backtest.backtest(bars(closes), flags(6, 1), flags(6, 5), 1, 5.0, backtest.Rules(fee_bps=0, slippage_bps=0))
    assert book.liquidations == 1
    assert book.gross == pytest.approx(5 * (100 * (1 - 0.2 + 0.01) - 100))


def test_signals_hold_and_stop():
    import numpy as np

    close = np.array([10, 11, 12, 8, 8, 9, 10, 11.0])
    enter, leave = backtest.signals(close, np.ones(8), flags(8, 1, 4), 1, 2.0, 3)
    assert np.flatnonzero(enter).tolist() == [1, 4]
    assert np.flatnonzero(leave).tolist() == [3, 7]


@pytest.mark.parametrize("rules", [backtest.Rules(), backtest.Rules(latency_bars=2, liquidation_ratio=0.4, cooldown_bars=3)])
def test_runs_side_by_side_equal_one_run_at_a_time(spark, monkeypatch, rules):
    import numpy as np

    monkeypatch.setattr(backtest, "BARS", 200)  # several parts, series of several lengths
    rng, rows = np.random.default_rng(3), []
    for symbol, n in enumerate([1, 2, 3, 150, 40, 41, 230]):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.06, n)))
        rows += [(symbol, datetime(2024, 1, 1) + timedelta(hours=i), i, float(x), float(x * 1.05), float(x * 0.93), float(x), 1.0, 1, float(rng.normal(0, 0.01)), 500.0, 0.0) for i, x in enumerate(close)]
    df = spark.createDataFrame(rows, "symbol int, ts timestamp_ntz, i bigint, open double, high double, low double, close double, volume double, trade_count bigint, funding double, oi double, liq double")
    out = backtest.run_backtests(df, rules=rules)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()  # a bar is not dealt once for each backbone
    got = {(r.symbol, r.backbone, r.side, r.leverage): r for r in out.collect()}
    wishes = backtest.wanted_entries(df).toPandas()
    assert len(got) == 7 * 12
    seen = 0
    for (symbol, backbone, side, leverage), r in got.items():
        g = wishes[wishes.symbol == symbol].sort_values("i")
        sign = 1 if side == "long" else -1
        enter, leave = backtest.signals(g.close.to_numpy(), g.atr.to_numpy(), g[f"{backbone}_{side}"].to_numpy(bool), sign, *backtest.BACKBONES[backbone])
        book, curve = backtest.backtest(g, enter, leave, sign, leverage, rules)
        level, steps = np.maximum(1e-9, 1 + curve), np.diff(curve)
        assert (r.bars, r.trades, r.wins, r.liquidations) == (len(g), book.trades, book.wins, book.liquidations)
        assert (r.gross_pnl, r.fees, r.funding, r.net_pnl) == (book.gross, book.fees, book.funding, book.equity())
        assert r.max_drawdown == (level / np.maximum.accumulate(level) - 1).min()
        assert r.sharpe == pytest.approx(steps.mean() / steps.std(ddof=1) if len(steps) > 1 and steps.std(ddof=1) > 0 else 0.0, rel=1e-9)
        seen += book.liquidations
    assert seen > 0


def test_draws_are_repeatable_and_in_range(spark):
    lengths = spark.createDataFrame([("a", 20), ("b", 3), ("c", 1)], "symbol string, n bigint")
    for kind in ("moving_block", "stationary", "permutation"):
        got = {}
        for r in resampling.index_table(lengths, 5, kind).collect():
            got.setdefault((r.symbol, r.seed), {})[r.position] = r.source
        again = {(r.symbol, r.seed, r.position): r.source for r in resampling.index_table(lengths.repartition(3), 5, kind).collect()}
        assert again == {(*k, p): s for k, v in got.items() for p, s in v.items()}
        for (symbol, _), picks in got.items():
            n = {"a": 20, "b": 3, "c": 1}[symbol]
            assert sorted(picks) == list(range(n)) and all(0 <= s < n for s in picks.values())
            if kind == "permutation":
                assert sorted(picks.values()) == list(range(n)) and picks[0] == 0
            if kind == "moving_block":
                assert all(picks[p] == picks[p - 1] + 1 for p in range(n) if p % min(4, n))
        assert len({tuple(v.values()) for (s, _), v in got.items() if s == "a"}) > 1


@pytest.mark.parametrize("chunk", [2, 5, 4096])
def test_wild_paths_equal_a_plain_loop_with_floors(spark, chunk):
    rng = random.Random(12)
    closes = [1e-8]
    for _ in range(30):
        closes.append(closes[-1] * rng.choice([0.02, 3.0, 1.1, 0.9, 5.0]))
    rows = [("a", i, x, x * 1.1, x * 0.9, x * 0.99, rng.gauss(0, 1), rng.random(), rng.choice([0.0, 5.0])) for i, x in enumerate(closes)] + [("one", 0, 7.0, 8.0, 6.0, 6.5, 0.1, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, i bigint, close double, high double, low double, open double, funding double, oi double, liq double")
    paths = {}
    for r in resampling.wild_paths(df, 4, chunk=chunk).orderBy("symbol", "seed", "i").collect():
        paths.setdefault((r.symbol, r.seed), []).append(r)
    assert set(paths) == {(s, k) for s in ("a", "one") for k in range(4)}
    assert all(p[0].close == 7.0 and p[0].high == 8.0 and p[0].open == 6.5 for (s, _), p in paths.items() if s == "one")
    rets = [b / a - 1 for a, b in zip(closes, closes[1:], strict=False)]
    mean, floors = sum(rets) / len(rets), 0
    for (s, _), path in paths.items():
        if s == "one":
            continue
        price = closes[0]
        for i, r in enumerate(path):
            if i:
                price = max(price * (1 + mean + (rets[i - 1] - mean) * r.weight), 1e-9)
                floors += price == 1e-9
                assert r.open == pytest.approx(path[i - 1].close, rel=1e-9)
                # weights keep a share of the one before
                assert abs(abs(r.weight - 0.7788007830714049 * path[i - 1].weight) - 0.6272713450233213) < 1e-9
            assert r.close == pytest.approx(price, rel=1e-6)
            assert r.low <= min(r.open, r.close) * (1 + 1e-12) and r.high >= max(r.open, r.close) * (1 - 1e-12) and r.oi >= 0 and r.liq >= 0
    assert floors > 3


def test_shared_blocks_keep_what_happened_together(spark):
    df = spark.createDataFrame([(s, t, float(t * 10 + k)) for k, s in enumerate(("a", "b", "c")) for t in range(0, 40, 1 + k)], "symbol string, ts int, x double")
    got = resampling.shared_blocks(df, 5).collect()
    assert all(r.ts == r.drawn_ts for r in got)
    bars = {}
    for r in got:
        bars.setdefault((r.seed, r.position), set()).add((r.ts, r.symbol))
    for group in bars.values():
        assert len({t for t, _ in group}) == 1
        t = next(iter(group))[0]
        assert {s for _, s in group} == {s for k, s in enumerate(("a", "b", "c")) if t % (1 + k) == 0}
    assert {p for _, p in bars} == set(range(40))
    assert resampling.shared_blocks(df.where("ts < 0"), 2).count() == 0


def test_permuted_path_ends_where_the_series_does(spark):
    closes = [100.0, 110, 99, 120, 130]
    last = resampling.permuted_paths(series(spark, closes), 4).where("position = 4").collect()
    assert [r.close for r in last] == pytest.approx([130.0] * 4)


def test_allocation_equals_a_plain_loop(spark):
    rows = [("b", i, i % 2, 10.0 * (i + 1), 0.1) for i in range(8)]
    got = {r["rank"]: r.rejection for r in portfolio.allocate(spark.createDataFrame(rows, "book string, rank int, symbol int, notional double, max_drawdown double"), equity=100.0, per_symbol=60.0, leverage=1.0, drawdown_budget=0.09).collect()}
    assert got[0] is None
    assert got[7] in {"per_symbol_exposure_limit", "aggregate_leverage_limit"}
    gross = sum(r[3] for r in rows if got[r[1]] is None)
    assert gross <= 100


def test_csv_aliases_and_sidecars(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Time, O ,H,L,C,Vol,Funding\n1704067200,1,2,0.5,1.5,10,n/a\n1704070800,1.5,2,1,2,20,0.01\n")
    (tmp_path / "f.csv").write_text("ts,rate\n1704067200,1\n1704067200,2\n")
    df = snapshots.snapshot_from_csv(spark, str(tmp_path / "c.csv")).orderBy("ts").collect()
    assert [(r.close, r.funding_rate, r.invalid) for r in df] == [(1.5, 0.0, 1), (2.0, 0.01, 0)]
    both = snapshots.snapshot_from_bundle(spark, str(tmp_path / "c.csv"), {"rate": str(tmp_path / "f.csv")}).orderBy("ts").collect()
    assert [r.rate for r in both] == [2.0, 0.0]
    (tmp_path / "bad.csv").write_text("time,o,h,l,c,v\n1704067200,x,2,0.5,1.5,10\n")
    with pytest.raises(Exception, match="bad open"):
        snapshots.snapshot_from_csv(spark, str(tmp_path / "bad.csv")).collect()
    with pytest.raises(ValueError, match="volume"):
        (tmp_path / "short.csv").write_text("time,o,h,l,c\n1,1,1,1,1\n")
        snapshots.snapshot_from_csv(spark, str(tmp_path / "short.csv"))


def test_json_artifacts_keep_malformed_files(spark, tmp_path):
    (tmp_path / "a.runcard.json").write_text('{"run_id": "r1", "score": 1.5}')
    (tmp_path / "b.runcard.json").write_text("{oops")
    got = snapshots.json_artifacts(spark, str(tmp_path / "*.runcard.json"), "run_id string, score double").collect()
    assert sorted((r.run_id or "", r._corrupt_record is not None) for r in got) == [("", True), ("r1", False)]


def test_version_ignores_row_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    a = snapshots.dataset_version(df, ["id", "x"]).first().version
    assert a == snapshots.dataset_version(df.orderBy(F.desc("id")).repartition(7), ["x", "id"]).first().version
    assert a != snapshots.dataset_version(df.where("id > 0"), ["id", "x"]).first().version


def test_stream_book_equals_a_plain_loop(spark, sf):
    from tidemark.plans.sequential import j04_stream_order_book

    books = {}
    for e in sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        import json

        side = books.setdefault(e.user_id, {"view": {}, "click": {}}).get(e.event_type)
        if side is not None:
            if json.loads(e.props)["k"] < 20:
                side.pop(round(e.value, 2), None)
            else:
                side[round(e.value, 2)] = 1
    want = {u: (max(b["view"], default=None), min(b["click"], default=None)) for u, b in books.items()}
    assert {r.user_id: (r.best_bid, r.best_ask) for r in j04_stream_order_book(spark, sf).collect()} == want


def test_allocation_covers_every_order_in_batches(spark, sf):
    from tidemark import plans

    seen = plans.queries()["i20_portfolio_allocation"](spark, sf)
    assert seen.count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    rows = [(book, k, (k * 7 + len(book)) % 5, float(k * 37 % 23 + 1), (k % 9) / 100) for book in ("a", "bb", "ccc") for k in range(400)]
    df = spark.createDataFrame(rows, "book string, rank int, symbol int, notional double, max_drawdown double")
    caps = {"equity": 300.0, "per_symbol": 150.0, "leverage": 2.0, "drawdown_budget": 0.05}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r.book, r["rank"]): r.rejection for r in portfolio.allocate(df, **caps).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for book in ("a", "bb", "ccc"):
        held, gross, used = {}, 0.0, 0.0
        for _, k, symbol, notional, loss in sorted(r for r in rows if r[0] == book):
            if held.get(symbol, 0.0) + notional > 150.0:
                want = "per_symbol_exposure_limit"
            elif (gross + notional) / 300.0 > 2.0:
                want = "aggregate_leverage_limit"
            elif used + notional / 300.0 * loss > 0.05:
                want = "drawdown_budget_limit"
            else:
                want, gross, used = None, gross + notional, used + notional / 300.0 * loss
                held[symbol] = held.get(symbol, 0.0) + notional
            assert got[book, k] == want


def test_upper_median_is_found_once_a_series(spark):
    rows = [(symbol, i, float(i * 37 % n)) for symbol, n in (("a", 1), ("b", 2), ("c", 7), ("d", 10)) for i in range(n)] + [("d", 99, None)]
    df = spark.createDataFrame(rows, "symbol string, i int, x double")
    got = df.withColumn("m", windows.upper_median("x")).select("symbol", "m").distinct().collect()
    assert {r.symbol: r.m for r in got} == {s: sorted(x for t, _, x in rows if t == s and x is not None)[n // 2] for s, n in (("a", 1), ("b", 2), ("c", 7), ("d", 10))}
    long = spark.range(40_000).selectExpr("'s' AS symbol", "cast(id AS int) AS i", "double(id * 7919 % 40000) AS x")
    begun = time.perf_counter()
    assert long.withColumn("m", windows.upper_median("x")).agg({"m": "sum"}).first()[0] == 40_000 * 20_000.0
    assert time.perf_counter() - begun < 30


def test_false_discovery_rate_is_ranked_by_slices(spark):
    ps = [(k, (k * 7919 % 211) / 210) for k in range(900)] + [(900 + k, 1e-6 * (k % 17)) for k in range(60)]
    df = spark.createDataFrame(ps, "k int, p double")
    out = stats.false_discovery_rate(df, "p", slices=16)
    got = {r.k: r.adjusted for r in out.collect()}
    least, want = 1.0, {}
    for rank, (p, k) in reversed(list(enumerate(sorted((p, k) for k, p in ps), 1))):
        least = min(least, p * len(ps) / rank)
        want[k] = least
    assert got == pytest.approx(want)


def test_camel_case_headers_are_read(spark, tmp_path):
    (tmp_path / "n.csv").write_text("open_time,Open,High,Low,Close,Volume,fundingRate,openInterest,liqLongUsd,volRegime\n1704067200000,1,2,0.5,1.5,10,0.01,-,7,high\n")
    (row,) = snapshots.snapshot_from_csv(spark, str(tmp_path / "n.csv")).collect()
    assert (row.funding_rate, row.open_interest, row.liq_long_usd, row.invalid, row.vol_regime, row.regime_id) == (0.01, 0.0, 7.0, 1, "high", None)


def test_asof_matches_age(spark):
    left = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 10:00:00'), (1, TIMESTAMP '2024-01-01 12:00:00') AS t(k, at)")
    right = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 09:30:00', 5) AS t(k, at, v)")
    got = joins.asof_join(left, right, by=["k"], on="at", values=["v"], max_age=F.expr("INTERVAL 30 MINUTES")).orderBy("at").collect()
    assert [r.v for r in got] == [5, None] and got[1].matched_at is None
    assert [r.v for r in joins.asof_join(left, right, by=["k"], on="at", values=["v"]).orderBy("at").collect()] == [5, 5]


def test_ranks_in_slices_equal_a_window(spark):
    from pyspark.sql import Window as W

    from tidemark.operators import windows

    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.expr("id * 7919 % 97").alias("x"), "id")
    got = windows.rank_in_slices(df, by="g", key="x", then=["id"])
    want = df.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(F.desc("x"), "id")))
    assert {(r.id, r["rank"]) for r in got.collect()} == {(r.id, r["rank"]) for r in want.collect()}
    assert {r.top for r in got.select("top").distinct().collect()} == {96}


def test_ranks_keep_null_groups_and_keys(spark):
    from pyspark.sql import Window as W

    from tidemark.operators import windows

    rng = random.Random(6)
    # half of the rows in one group, a group of NULL keys only, NULL groups, few and many different keys
    rows = [(i, rng.choice(["hot", "hot", "hot", "few", None]), rng.choice([None, float(rng.randrange(3)), rng.gauss(0, 9)])) for i in range(4000)] + [(9000 + i, "none", None) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, g string, x double")
    got = windows.rank_in_slices(df, by="g", key="x", then=["id"])
    want = df.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(F.desc("x"), "id"))).withColumn("top", F.max("x").over(W.partitionBy("g")))
    assert got.columns == ["id", "g", "x", "top", "rank"]
    assert sorted(map(tuple, got.select("id", "rank", "top").collect()), key=str) == sorted(map(tuple, want.select("id", "rank", "top").collect()), key=str)
    assert windows.rank_in_slices(df.where("id < 0"), by="g", key="x", then=["id"]).count() == 0


def test_walk_takes_levels_of_any_depth(spark):
    from tidemark.operators.markets import walk_levels

    rows = [("deep", float(i), 1.0) for i in range(500)] + [("thin", 2.0, 5.0), ("thin", 1.0, 0.0), ("thin", 3.0, None)]
    got = {r.book: (r.filled, r.vwap) for r in walk_levels(spark.createDataFrame(rows, "book string, price double, qty double"), by="book", order=["price"], quantity=150.0).collect()}
    assert got == {"deep": (150.0, sum(range(150)) / 150), "thin": (5.0, 2.0)}
    # level by level, as the array form does
    levels = [(float(i), float(i % 4 + 1)) for i in range(80)]
    df = spark.createDataFrame([("b", p, q) for p, q in levels], "book string, price double, qty double")
    row = walk_levels(df, by="book", order=["price"], quantity=150.0).first()
    whole = spark.createDataFrame([(levels,)], "levels array<struct<price:double,qty:double>>").select(costs.depth_walk(F.col("levels"), F.lit(150.0)).alias("w")).first().w
    assert (row.filled, row.vwap) == pytest.approx((whole.filled, whole.vwap))


def test_probabilistic_sharpe_equals_plain_formulas(spark, sf):
    """d08 has no SQL: the normal distribution is the standard library's, moments are summed plainly."""
    import math
    from statistics import NormalDist, fmean, stdev

    from tidemark import plans
    from tidemark.plans.series import with_returns

    rets = {}
    for row in with_returns(spark, sf).select("symbol", "i", "ret").orderBy("i").collect():
        rets.setdefault(row.symbol, []).append(row.ret)
    normal, sharpes, errors = NormalDist(), {}, {}
    for symbol, x in rets.items():
        n, mean = len(x), fmean(x)
        sharpes[symbol] = sr = mean / stdev(x) if n > 1 and stdev(x) > 0 else 0.0
        m2, m3, m4 = (fmean((v - mean) ** k for v in x) for k in (2, 3, 4))
        skew = m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 and m2 > 0 else 0.0
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6) + 3 if n > 3 and m2 > 0 else 3.0
        errors[symbol] = math.sqrt(max(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12) / max(n - 1, 1))
    trials, spread, gamma = len(sharpes), stdev(sharpes.values()), 0.5772156649015329
    benchmark = spread * ((1 - gamma) * normal.inv_cdf(1 - 1 / trials) + gamma * normal.inv_cdf(1 - 1 / (trials * math.e)))
    got = {row.symbol: row for row in plans.queries()["d08_probabilistic_sharpe"](spark, sf).collect()}
    assert got.keys() == rets.keys()
    for symbol, row in got.items():
        assert row.psr == pytest.approx(normal.cdf(sharpes[symbol] / errors[symbol]), rel=1e-6, abs=1e-9)
        assert row.dsr == pytest.approx(normal.cdf((sharpes[symbol] - benchmark) / errors[symbol]), rel=1e-6, abs=1e-9)
        assert row.benchmark == pytest.approx(benchmark, rel=1e-9)
