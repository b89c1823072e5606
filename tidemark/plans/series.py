"""Queries of the time-series family over candles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import by_symbol, c, r, rows
from tidemark.operators import windows as w
from tidemark.plans.registry import over_candles, query, rounded
from tidemark.sources.tables import candles, table

BY = "PARTITION BY symbol ORDER BY i"
RET = "rets AS (SELECT *, CASE WHEN i > 0 AND lag(close) OVER (PARTITION BY symbol ORDER BY i) <> 0 THEN close / lag(close) OVER (PARTITION BY symbol ORDER BY i) - 1 ELSE 0.0 END AS ret FROM candles)"


def with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles(spark, sf_dir).withColumn("ret", w.lag_return())


@query(over_candles(f"SELECT symbol, i, ts, trade_count, {rounded('open', 'high', 'low', 'close', 'volume', 'funding', 'oi')} FROM candles"))
def a09_candle_bars(spark, sf_dir):
    return candles(spark, sf_dir).select("symbol", "i", "ts", "trade_count", *[r(x).alias(x) for x in ("open", "high", "low", "close", "volume", "funding", "oi")])


@query(over_candles(f"""SELECT symbol, i, {rounded('ret', 'd_oi', 'rv AS rv_24', 'z AS funding_z')} FROM (SELECT symbol, i, ret, coalesce(oi - lag(oi) OVER ({BY}), 0) AS d_oi,
  sqrt(sum(ret * ret) OVER ({BY} ROWS 23 PRECEDING)) AS rv,
  CASE WHEN stddev_pop(funding) OVER (PARTITION BY symbol) > 0 THEN (funding - avg(funding) OVER (PARTITION BY symbol)) / stddev_pop(funding) OVER (PARTITION BY symbol) ELSE 0 END AS z FROM rets)""", RET))
def b01_derived_features(spark, sf_dir):
    return with_returns(spark, sf_dir).select("symbol", "i", r("ret").alias("ret"), r(w.difference("oi")).alias("d_oi"), r(w.realised_vol()).alias("rv_24"), r(w.population_z("funding")).alias("funding_z"))


@query(over_candles(f"SELECT symbol, i, {rounded('abs_z', 'std_30')} FROM (SELECT symbol, i, CASE WHEN stddev_pop(funding) OVER u > 0 THEN abs((funding - avg(funding) OVER u) / stddev_pop(funding) OVER u) ELSE 0 END AS abs_z, coalesce(stddev_samp(CASE WHEN i > 0 THEN ret END) OVER ({BY} ROWS 29 PRECEDING), 0) AS std_30 FROM rets WINDOW u AS ({BY} ROWS UNBOUNDED PRECEDING))", RET))
def e09_expanding_and_rolling(spark, sf_dir):
    return with_returns(spark, sf_dir).select("symbol", "i", r(w.expanding_abs_z("funding")).alias("abs_z"), r(w.rolling_return_std()).alias("std_30"))


def wma_sql(x: str, p: int) -> str:
    """Weighted mean by lags, unlike the library's running sums."""
    n = f"count(*) OVER ({BY} ROWS {p - 1} PRECEDING)"
    weighted = " + ".join(f"{p - k} * coalesce(lag({x}, {k}) OVER ({BY}), 0)" for k in range(p))
    return f"CASE WHEN {n} < {p} THEN avg({x}) OVER ({BY} ROWS {p - 1} PRECEDING) ELSE ({weighted}) / {p * (p + 1) / 2} END"


@query(over_candles(f"SELECT symbol, i, {rounded('wma', 'hma')} FROM (SELECT symbol, i, wma, {wma_sql('raw', 3)} AS hma FROM (SELECT symbol, i, {wma_sql('close', 9)} AS wma, 2 * {wma_sql('close', 4)} - {wma_sql('close', 9)} AS raw FROM candles))"))
def e01_wma_hma(spark, sf_dir):
    return w.hma(candles(spark, sf_dir).withColumn("wma", w.wma("close", 9)), "close", 9, "hma").select("symbol", "i", r("wma").alias("wma"), r("hma").alias("hma"))


@query(over_candles(f"""SELECT symbol, i, CASE WHEN rv < 0.75 * m THEN 'low' WHEN rv > 1.25 * m THEN 'high' ELSE 'normal' END AS vol_regime FROM (
  SELECT *, list_sort(list(rv) OVER (PARTITION BY symbol))[count(*) OVER (PARTITION BY symbol) // 2 + 1] AS m FROM (SELECT symbol, i, round(sqrt(sum(ret * ret) OVER ({BY} ROWS 23 PRECEDING)), 9) AS rv FROM rets))""", RET))
def e11_vol_regime(spark, sf_dir):
    return with_returns(spark, sf_dir).withColumn("rv", F.round(w.realised_vol(), 9)).select("symbol", "i", w.vol_regime("rv").alias("vol_regime"))


@query(over_candles("SELECT symbol, i, oi > quantile_cont(oi, 0.9) OVER (PARTITION BY symbol) AS oi_stress, volume <= quantile_cont(volume, 0.1) OVER (PARTITION BY symbol) AS thin FROM candles"))
def e13_percentile_flags(spark, sf_dir):
    return candles(spark, sf_dir).select("symbol", "i", w.above_percentile("oi", 0.9).alias("oi_stress"), w.below_percentile("volume", 0.1).alias("thin"))


REGIMES = f"""regimes AS (SELECT *, {w.REGIME_RULES} AS regime FROM (SELECT *,
  CASE WHEN f <> 0 THEN close / f - 1 ELSE 0 END AS short_ret, close - f AS slope, CASE WHEN pc <> 0 THEN close / pc - 1 ELSE 0 END AS bar_ret,
  CASE WHEN peak <> 0 THEN close / peak - 1 ELSE 0 END AS drawdown, liq / greatest(1.0, base) AS liq_ratio, CASE WHEN po <> 0 THEN abs(oi / po - 1) ELSE 0 END AS oi_change
  FROM (SELECT *, first_value(close) OVER ({BY} ROWS 4 PRECEDING) AS f, coalesce(lag(close) OVER ({BY}), close) AS pc, coalesce(lag(oi) OVER ({BY}), oi) AS po,
    coalesce(quantile_cont(CASE WHEN liq > 0 THEN liq END, 0.5) OVER (PARTITION BY symbol), 1.0) AS base, max(close) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS peak FROM candles)))"""
RUNS = f"""numbered AS (SELECT *, sum(ch) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN regime = lag(regime) OVER ({BY}) THEN 0 ELSE 1 END AS ch FROM regimes)),
runs AS (SELECT symbol, island, any_value(regime) AS label, min(i) AS start_i, max(i) + 1 AS end_i FROM numbered GROUP BY symbol, island)"""


def labelled(spark, sf_dir):
    return w.regime_labels(candles(spark, sf_dir))


@query(over_candles(f"SELECT symbol, i, regime, {rounded('drawdown', 'liq_ratio')} FROM regimes", REGIMES))
def e15_regime_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("symbol", "i", "regime", r("drawdown").alias("drawdown"), r("liq_ratio").alias("liq_ratio"))


@query(over_candles("SELECT symbol, replace(label, '_', '-') || '-' || row_number() OVER (PARTITION BY symbol, label ORDER BY start_i) AS name, label, start_i, end_i FROM runs WHERE label IN ('crash', 'short_squeeze', 'liquidity_stress')", REGIMES, RUNS))
def e16_crisis_windows(spark, sf_dir):
    return w.crisis_windows(labelled(spark, sf_dir))


@query(over_candles("""SELECT n.symbol, n.i, n.regime, CASE WHEN end_i - start_i >= 3 THEN label ELSE coalesce(l, n2, label) END AS smoothed FROM numbered n JOIN
  (SELECT *, lag(label) OVER (PARTITION BY symbol ORDER BY island) AS l, lead(label) OVER (PARTITION BY symbol ORDER BY island) AS n2 FROM runs) s ON n.symbol = s.symbol AND n.island = s.island""", REGIMES, RUNS))
def e17_smoothed_regimes(spark, sf_dir):
    return w.smoothed_labels(labelled(spark, sf_dir), "regime", 3).select("symbol", "i", "regime", "smoothed")


@query(over_candles("SELECT symbol, count(*) AS segments FROM runs GROUP BY symbol", REGIMES, RUNS))
def e18_segment_count(spark, sf_dir):
    return w.segments(labelled(spark, sf_dir), "regime").groupBy("symbol").agg(F.count("*").alias("segments"))


@query(over_candles("SELECT symbol, regime, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) + 0.0 AS coverage FROM regimes GROUP BY symbol, regime", REGIMES))
def d19_regime_coverage(spark, sf_dir):
    n = labelled(spark, sf_dir).groupBy("symbol", "regime").agg(F.count("*").alias("n"))
    return n.select("symbol", "regime", r(c("n") / F.sum("n").over(W.partitionBy("symbol"))).alias("coverage"))


def _surprise(x: str) -> str:
    p = f"OVER ({BY} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) {p} > 2 THEN abs({x} - avg({x}) {p}) / greatest(coalesce(stddev_samp({x}) {p}, 0), 1e-9) ELSE 0 END"


BOCPD = f"bocpd AS (SELECT symbol, i, regime, least(0.99, 0.05 + 0.95 * (m / (m + 3))) AS p FROM (SELECT *, greatest({_surprise('lr')}, {_surprise('fq')}, {_surprise('oq')}) AS m FROM (SELECT *, round(funding, 9) AS fq, round(CASE WHEN po = 0 THEN 0 ELSE oi / po - 1 END, 9) AS oq, round(CASE WHEN i > 0 AND pc > 0 AND close > 0 THEN ln(close / pc) ELSE 0 END, 9) AS lr FROM regimes)))"


def changepoints(spark, sf_dir):
    return w.changepoint_labels(w.with_changepoints(labelled(spark, sf_dir)))


@query(over_candles("SELECT symbol, i, round(p, 5) + 0.0 AS p, CASE WHEN p >= 0.65 AND regime = 'sideways' THEN 'liquidity_stress' ELSE regime END AS relabelled FROM bocpd", REGIMES, BOCPD))
def e19_changepoints(spark, sf_dir):
    return changepoints(spark, sf_dir).select("symbol", "i", r("p", 5).alias("p"), "relabelled")


@query(over_candles("SELECT symbol, i, round(p, 5) + 0.0 AS p, rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(p, 5) DESC, i) AS rank FROM bocpd WHERE p >= 0.5) WHERE rank <= 10", REGIMES, BOCPD))
def e20_top_changepoints(spark, sf_dir):
    top = changepoints(spark, sf_dir).where("p >= 0.5").withColumn("p", r("p", 5))
    return top.withColumn("rank", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("p"), "i"))).where("rank <= 10").select("symbol", "i", "p", "rank")


@query(over_candles(f"SELECT symbol, i, round(lead(close, 4) OVER ({BY}) / nullif(close, 0) - 1, 6) + 0.0 AS label, i + 4 AS label_end FROM candles QUALIFY lead(close, 4) OVER ({BY}) IS NOT NULL"))
def e29_fixed_horizon_labels(spark, sf_dir):
    ahead = F.lead("close", 4).over(by_symbol())
    return candles(spark, sf_dir).withColumn("ahead", ahead).where("ahead IS NOT NULL").select("symbol", "i", r(F.when(c("close") != 0, c("ahead") / c("close") - 1)).alias("label"), (c("i") + 4).alias("label_end"))


@query(over_candles("SELECT symbol, i, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.6) + floor(n * 0.2) THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM candles)"))
def e34_chronological_split(spark, sf_dir):
    return candles(spark, sf_dir).select("symbol", "i", w.chronological_split().alias("split"))


@query(over_candles(f"SELECT symbol, i, CAST(coalesce(floor(epoch(ts) / 28800) - lag(floor(epoch(ts) / 28800)) OVER ({BY}), 0) AS BIGINT) AS crossings FROM candles"))
def e38_funding_crossings(spark, sf_dir):
    return candles(spark, sf_dir).select("symbol", "i", w.funding_crossings().cast("bigint").alias("crossings"))


@query(over_candles(f"SELECT symbol, i, CAST(epoch(ts) - lag(epoch(ts)) OVER ({BY}) AS BIGINT) AS gap_s FROM candles QUALIFY i > 0"))
def e25_time_gaps(spark, sf_dir):
    s = F.unix_seconds(c("ts").cast("timestamp"))
    return candles(spark, sf_dir).withColumn("gap_s", s - F.lag(s).over(by_symbol())).where("i > 0").select("symbol", "i", "gap_s")


@query("""WITH g AS (SELECT event_type, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap FROM events), s AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events)
SELECT event_type, round(greatest(max(gap), min(t) - any_value(a), any_value(b) - max(t)) / 1e6, 3) AS max_gap_s, round(avg(gap) / 1e6, 3) AS mean_gap_s, round((max(t) - min(t)) / 1e6, 3) AS span_s FROM g, s GROUP BY event_type""")
def e26_stream_gaps(spark, sf_dir):
    """Largest gap including the edges of the session, cadence and span of each stream."""
    events = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(c("ts").cast("timestamp")))
    # one pass gives every stream's own first and last, so the session's edges need no second scan
    gaps = events.withColumn("gap", c("t") - F.lag("t").over(W.partitionBy("event_type").orderBy("t", "event_id")))
    per = gaps.groupBy("event_type").agg(F.max("gap").alias("g"), F.avg("gap").alias("m"), F.min("t").alias("a"), F.max("t").alias("b"))
    edges = per.agg(F.min("a").alias("first"), F.max("b").alias("last"))
    sec = lambda x: F.round(x / 1e6, 3)
    return per.crossJoin(F.broadcast(edges)).select("event_type", sec(F.greatest("g", c("a") - c("first"), c("last") - c("b"))).alias("max_gap_s"), sec(c("m")).alias("mean_gap_s"), sec(c("b") - c("a")).alias("span_s"))


@query(over_candles(f"SELECT symbol, i, {rounded('equity', 'eq_diff', 'drawdown')} FROM (SELECT symbol, i, equity, coalesce(equity - lag(equity) OVER ({BY}), equity) AS eq_diff, greatest(1e-9, 1 + equity) / max(greatest(1e-9, 1 + equity)) OVER ({BY} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM (SELECT symbol, i, sum(ret) OVER ({BY} ROWS UNBOUNDED PRECEDING) / 97.0 AS equity FROM rets))", RET))
def e36_drawdown_series(spark, sf_dir):
    """Differences and drawdown of a cumulative PnL on base 1."""
    eq = with_returns(spark, sf_dir).withColumn("equity", F.sum("ret").over(rows(None)) / 97.0)
    value = F.greatest(F.lit(1e-9), 1 + c("equity"))
    return eq.select("symbol", "i", r("equity").alias("equity"), r(F.coalesce(c("equity") - F.lag("equity").over(by_symbol()), c("equity"))).alias("eq_diff"), r(value / F.max(value).over(rows(None)) - 1).alias("drawdown"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER s AS last_purchase, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER s AS last_view FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def e37_last_market_state(spark, sf_dir):
    so_far = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    last = lambda kind: F.last(F.when(c("event_type") == kind, c("value")), ignorenulls=True).over(so_far)
    return table(spark, sf_dir, "events").select("event_id", "user_id", last("purchase").alias("last_purchase"), last("view").alias("last_view"))


@query(over_candles(f"""SELECT symbol, {rounded('sharpe', 'max_drawdown', 'rv')}, bars FROM (SELECT symbol, count(*) AS bars, CASE WHEN count(*) > 1 AND stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) ELSE 0 END AS sharpe, min(dd) AS max_drawdown, sqrt(sum(ret * ret)) AS rv
  FROM (SELECT symbol, ret, greatest(1e-9, 1 + eq) / max(greatest(1e-9, 1 + eq)) OVER ({BY} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM (SELECT symbol, i, ret, sum(ret) OVER ({BY} ROWS UNBOUNDED PRECEDING) / 97.0 AS eq FROM rets)) GROUP BY symbol)""", RET))
def flagship_symbol_report(spark, sf_dir):
    """Candles, returns, drawdown and Sharpe ratio of every symbol: one shuffle to bars, one to the symbol's series."""
    eq = with_returns(spark, sf_dir).withColumn("eq", F.sum("ret").over(rows(None)) / 97.0)
    value = F.greatest(F.lit(1e-9), 1 + c("eq"))
    dd = eq.withColumn("dd", value / F.max(value).over(rows(None)) - 1)
    sharpe = F.when((F.count("*") > 1) & (F.stddev_samp("ret") > 0), F.avg("ret") / F.stddev_samp("ret")).otherwise(0.0)
    return dd.groupBy("symbol").agg(r(sharpe).alias("sharpe"), r(F.min("dd")).alias("max_drawdown"), r(F.sqrt(F.sum(c("ret") * c("ret")))).alias("rv"), F.count("*").alias("bars"))
