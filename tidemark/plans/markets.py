"""Queries of books, fills, margins, labels and calibration, on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import costs as k
from tidemark.functions import venue as v
from tidemark.functions.columns import by_symbol, c, r
from tidemark.operators import markets as m
from tidemark.operators import windows as w
from tidemark.plans.registry import over_candles, query
from tidemark.sources.tables import candles, table

STRESS = "l_tax >= 0.06 AS oi_stressed, CAST(l_partkey % 60 AS DOUBLE) / 10 - 3 AS funding_z, CAST(l_suppkey % 40 AS DOUBLE) / 10 AS liquidation_z, l_orderkey % 4 = 0 AS depleted, l_discount * 1000 AS slippage, l_extendedprice AS notional, CAST(l_partkey % 300 AS DOUBLE) * 400 AS bid_depth, CAST(l_suppkey % 90 AS DOUBLE) * 1500 AS ask_depth"
CASCADE = "CASE CAST(oi_stressed AS INTEGER) + CAST(abs(funding_z) > 2 AS INTEGER) + CAST(liquidation_z > 2 AS INTEGER) + CAST(depleted AS INTEGER) WHEN 4 THEN 1.75::DOUBLE WHEN 3 THEN 1.5::DOUBLE WHEN 2 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END"


@query(f"""WITH a AS (SELECT l_orderkey, l_linenumber, {STRESS} FROM lineitem), b AS (SELECT *, {CASCADE} AS cascade, least(bid_depth, ask_depth) AS depth FROM a),
f AS (SELECT *, CASE WHEN notional <= 0 THEN 1.0 WHEN depth <= 0 THEN 0.0 WHEN depth >= 2 * notional AND cascade <= 1.25 AND NOT depleted THEN 1.0 ELSE greatest(0.05, least(1.0, least(1.0, depth / notional) / cascade * CASE WHEN depleted AND depth < 1.5 * notional THEN 0.85 ELSE 1 END)) END AS filled FROM b),
p AS (SELECT *, greatest(1 - filled, CASE WHEN depleted THEN 0.1 ELSE 0 END) + CASE WHEN oi_stressed THEN 0.05 ELSE 0 END + CASE WHEN abs(funding_z) > 2 THEN 0.05 ELSE 0 END + CASE WHEN liquidation_z > 2 THEN 0.05 ELSE 0 END AS pressure FROM f)
SELECT l_orderkey, l_linenumber, round(filled, 6) + 0.0 AS fill_ratio, round(CASE WHEN slippage <= 0 OR (1 - filled < 0.001 AND slippage < 25) OR (cascade <= 1 AND pressure < 0.1) THEN 0 ELSE least(150.0, slippage * (0.2 + least(0.9, pressure)) * CASE WHEN cascade > 1 THEN least(1.5, cascade / 1.25) ELSE 1 END) END, 6) + 0.0 AS adverse_bps FROM p""")
def h07_fills_under_stress(spark, sf_dir):
    """H6-H8: fill ratio and adverse price of an order under stress signals."""
    li = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *(f"{e} AS {n}" for e, n in (x.rsplit(" AS ", 1) for x in STRESS.split(", "))))
    cascade = k.cascade(c("oi_stressed"), F.abs("funding_z") > 2, c("liquidation_z") > 2, c("depleted"))
    li = li.withColumn("cascade", cascade).withColumn("filled", v.fill_ratio(c("notional"), c("bid_depth"), c("ask_depth"), c("cascade"), c("depleted")))
    adverse = v.adverse_bps(c("slippage"), c("filled"), c("cascade"), c("oi_stressed"), c("funding_z"), c("liquidation_z"), c("depleted"))
    return li.select("l_orderkey", "l_linenumber", r("filled").alias("fill_ratio"), r(adverse).alias("adverse_bps"))


@query(over_candles("SELECT symbol, i, round(CASE WHEN symbol % 2 = 0 THEN (high * 0.7 + close * 0.3) * 1.0025 ELSE (low * 0.7 + close * 0.3) * 0.9975 END, 9) + 0.0 AS trigger, round(close * oi * funding * CASE WHEN symbol % 2 = 0 THEN -1 ELSE 1 END, 8) + 0.0 AS payment FROM candles"))
def h12_liquidation_trigger(spark, sf_dir):
    """The mark price that liquidates and the funding of the position."""
    side = F.when(c("symbol") % 2 == 0, "short").otherwise("long")
    trigger = v.liquidation_trigger(side, c("low"), c("high"), c("close"), 0.3, 25.0)
    return candles(spark, sf_dir).select("symbol", "i", r(trigger, 9).alias("trigger"), r(v.funding_payment(c("close") * c("oi"), c("funding"), side), 8).alias("payment"))


TIERS = [(0.0, 20_000.0, 0.004), (20_000.0, 60_000.0, 0.005), (60_000.0, 80_000.0, 0.01)]


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 2 = 0 THEN price * (1 + 1 / leverage - ratio) ELSE price * (1 - 1 / leverage + ratio) END, 8) + 0.0 AS liquidation_price, ratio, coalesce(TRY_CAST(regexp_extract(notes, 'tick_size=([^;]+)', 1) AS DOUBLE), 0.01) AS tick_size FROM (SELECT *, l_extendedprice / l_quantity AS price, 1.0 + l_orderkey % 20 AS leverage, CASE WHEN l_extendedprice < 20000 THEN 0.004 WHEN l_extendedprice < 60000 THEN 0.005 ELSE 0.01 END::DOUBLE AS ratio, CASE l_partkey % 3 WHEN 0 THEN 'step_size=0.1;tick_size=0.5' WHEN 1 THEN 'tick_size=bad' ELSE 'other=1' END AS notes FROM lineitem)")
def l10_tiered_liquidation(spark, sf_dir):
    """Venue rules from notes, and the liquidation price with the maintenance margin of the order's tier."""
    notes = F.split(F.when(c("l_partkey") % 3 == 0, "step_size=0.1;tick_size=0.5").when(c("l_partkey") % 3 == 1, "tick_size=bad").otherwise("other=1"), ";")
    ratio = v.maintenance_margin(c("l_extendedprice"), TIERS)
    side = F.when(c("l_linenumber") % 2 == 0, "short").otherwise("long")
    price = k.liquidation_price(c("l_extendedprice") / c("l_quantity"), side, 1.0 + c("l_orderkey") % 20, ratio)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r(price, 8).alias("liquidation_price"), ratio.alias("ratio"), v.note_value(notes, "tick_size", 0.01).alias("tick_size"))


BOOKS = """d AS (SELECT user_id AS symbol, ts AS at_, value AS v, k FROM (SELECT user_id, ts, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'view' AND value > 0)),
books AS (SELECT *, list_transform(range(1, 8), lambda i: {'price': v * (1 - i * 0.00004::DOUBLE), 'qty': CAST((k * i) % 17 + 1 AS DOUBLE)}) AS bids, list_transform(range(1, 7), lambda i: {'price': v * (1 + i * (1 + k % 4) * 0.00003::DOUBLE), 'qty': CAST((k + 3 * i) % 23 + 1 AS DOUBLE)}) AS asks FROM d)"""


def books(spark, sf_dir):
    """A depth snapshot a view event, and a trade a click or purchase."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).withColumnsRenamed({"user_id": "symbol", "ts": "at"})
    level = lambda price, qty: F.struct(price.alias("price"), qty.cast("double").alias("qty"))
    bids = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: level(c("value") * (1 - i * F.lit(0.00004)), c("k") * i % 17 + 1))
    asks = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: level(c("value") * (1 + i * (1 + c("k") % 4) * F.lit(0.00003)), (c("k") + 3 * i) % 23 + 1))
    depths = e.where("event_type = 'view' AND value > 0").select("symbol", "at", bids.alias("bids"), asks.alias("asks"))
    trades = e.where("event_type IN ('click', 'purchase')").select("symbol", "at", c("value").alias("price"), c("k").alias("qty"), (c("event_type") == "click").alias("buyer_is_maker"))
    return depths, trades


@query(f"""WITH {BOOKS},
x AS (SELECT *, bids[1].price AS best_bid, asks[1].price AS best_ask, (bids[1].price + asks[1].price) / 2 AS mid, (list_sum([b.price * b.qty for b in list_slice(bids, 1, 5)]) + list_sum([b.price * b.qty for b in list_slice(asks, 1, 5)])) AS depth, lag(at_) OVER (PARTITION BY symbol ORDER BY at_) AS prev FROM books),
y AS (SELECT *, (best_ask - best_bid) / mid * 10000 AS spread FROM x),
z AS (SELECT *, lag(depth) OVER (PARTITION BY symbol ORDER BY at_) AS depth0, lag(spread) OVER (PARTITION BY symbol ORDER BY at_) AS spread0 FROM y),
t AS (SELECT z.symbol, z.at_, count(e.event_id) AS n, coalesce(sum(e.value * CAST(json_extract_string(e.props, '$.k') AS BIGINT) * CASE WHEN e.event_type = 'click' THEN -1 ELSE 1 END), 0) AS delta FROM z LEFT JOIN events e ON e.user_id = z.symbol AND e.event_type IN ('click', 'purchase') AND e.ts <= z.at_ AND (z.prev IS NULL OR e.ts > z.prev) GROUP BY 1, 2)
SELECT symbol, at_ AS "at", round(spread, 6) + 0.0 AS spread_bps, round(coalesce(list_sum(list_transform(list_filter(bids, lambda x: x.price >= mid * (1 - 0.0001::DOUBLE)), lambda x: x.price * x.qty)), 0), 8) + 0.0 AS bid_depth_1bp, round(coalesce(list_sum(list_transform(list_filter(asks, lambda x: x.price <= mid * (1 + 0.0001::DOUBLE)), lambda x: x.price * x.qty)), 0), 8) + 0.0 AS ask_depth_1bp,
 len(list_filter(range(1, 6), lambda i: abs(bids[i].price * bids[i].qty - asks[i].price * asks[i].qty) / (bids[i].price * bids[i].qty + asks[i].price * asks[i].qty) >= 0.5)) AS imbalanced_levels, round(delta, 4) + 0.0 AS signed_delta, n AS trade_count, round(coalesce((depth - depth0) / depth0, 0), 6) + 0.0 AS replenishment,
 CASE WHEN spread0 > 0 AND spread >= spread0 * 3 THEN 1 ELSE 0 END AS spread_spike, round(CASE WHEN round(delta, 9) = 0 THEN 0 ELSE least(1.0, depth / greatest(abs(delta), 1.0)) END, 6) + 0.0 AS absorption FROM z JOIN t USING (symbol, at_)""")
def e33_microstructure(spark, sf_dir):
    """Depth, imbalance, trade flow, replenishment and spread spikes of each snapshot."""
    f = m.microstructure(*books(spark, sf_dir))
    digits = {"spread_bps": 6, "bid_depth_1bp": 8, "ask_depth_1bp": 8, "signed_delta": 4, "replenishment": 6, "absorption": 6}
    return f.select("symbol", "at", "imbalanced_levels", "trade_count", "spread_spike", *[r(n, d).alias(n) for n, d in digits.items()])


@query(over_candles("SELECT symbol, i, kind, ts + INTERVAL 1 HOUR AS t_i, later + INTERVAL 1 HOUR AS t_end, CAST(epoch(later) - epoch(ts) AS BIGINT) AS horizon_seconds, round(CASE WHEN close <> 0 THEN later_close / close - 1 END, 6) + 0.0 AS value, columns FROM (SELECT *, lead(ts, 4) OVER w AS later, lead(close, 4) OVER w AS later_close FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY i)) CROSS JOIN (VALUES ('fixed_horizon_return', 'close'), ('triple_barrier', 'close,high,low'), ('meta_label', 'primary_signal,close')) k(kind, columns) WHERE later IS NOT NULL"))
def e30_label_metadata(spark, sf_dir):
    """The three kinds of labels share interval and value and differ in what they are drawn from."""
    kinds = F.explode(F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(b).alias("columns")) for a, b in (("fixed_horizon_return", "close"), ("triple_barrier", "close,high,low"), ("meta_label", "primary_signal,close"))]))
    later = F.lead("ts", 4).over(by_symbol())
    x = candles(spark, sf_dir).withColumns({"later": later, "value": w.fixed_horizon_label("close", 4)}).where("later IS NOT NULL").withColumn("k", kinds)
    hour = F.expr("INTERVAL 1 HOUR")
    return x.select("symbol", "i", "k.kind", (c("ts") + hour).alias("t_i"), (c("later") + hour).alias("t_end"), (F.unix_seconds(c("later").cast("timestamp")) - F.unix_seconds(c("ts").cast("timestamp"))).alias("horizon_seconds"), r("value").alias("value"), "k.columns")


@query(over_candles("SELECT symbol, greatest(1, floor(count(*) * 0.02), 4) AS embargo, count(*) - 4 - greatest(1, floor(count(*) * 0.02), 4) AS usable FROM candles GROUP BY symbol"))
def e32_embargo_policy(spark, sf_dir):
    """Bars to leave out after a test interval, by the length of the series and the label's horizon."""
    n = candles(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"))
    embargo = v.embargo_bars(c("n"), F.lit(4), 0.02)
    return n.select("symbol", embargo.cast("double").alias("embargo"), (c("n") - 4 - embargo).cast("double").alias("usable"))


TELEMETRY = "l_suppkey, l_orderkey, l_partkey % 3 AS bucket, greatest(0.0, l_discount * 500 - 0.5 * (l_tax * 100) * greatest(0.0, 1 - l_quantity / 40)) AS target, sqrt(CAST(l_partkey % 50 AS DOUBLE) / 1000) AS sqrt_share, l_tax * 100 AS spread_bps, CAST(l_orderkey % 40 AS DOUBLE) / 10000 AS vol_15m, CAST(l_partkey % 700 AS DOUBLE) AS latency_ms, l_orderkey % 8 = 0 AS funding_window, CAST(l_linenumber AS DOUBLE) / 7 AS fill_completion"
MODELS = f"""t AS (SELECT {TELEMETRY} FROM lineitem),
s AS (SELECT l_suppkey, count(*) AS sample_count, greatest(0, least(2.0, coalesce(quantile_cont(target / spread_bps, 0.5) FILTER (spread_bps > 0), 0))) AS spread, greatest(0, least(5.0, coalesce(quantile_cont(target / (vol_15m * 10000), 0.5) FILTER (vol_15m > 0), 0))) AS volatility, greatest(0, least(0.25, coalesce(quantile_cont(target / latency_ms, 0.5) FILTER (latency_ms > 0), 0))) AS latency,
  greatest(0, coalesce(avg(target) FILTER (funding_window) - avg(target) FILTER (NOT funding_window), 0)) AS funding, greatest(0, least(1.0, avg(fill_completion))) AS queue_fill FROM t GROUP BY 1),
i AS (SELECT l_suppkey, avg(x) AS impact FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY x) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT l_suppkey, target / sqrt_share AS x FROM t WHERE sqrt_share > 0)) WHERE n < 5 OR (k > greatest(1, floor(n * 0.1::DOUBLE)) AND k <= n - greatest(1, floor(n * 0.1::DOUBLE))) GROUP BY 1),
b AS (SELECT l_suppkey, min(n) AS least_n FROM (SELECT l_suppkey, bucket, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY 1),
models AS (SELECT s.*, coalesce(impact, 0) AS impact, CASE WHEN least_n < 200 THEN 'sample_guarded' ELSE 'usable' END AS status FROM s LEFT JOIN i USING (l_suppkey) JOIN b USING (l_suppkey))"""
COEFFICIENTS = ("impact", "spread", "volatility", "latency", "funding", "queue_fill")


def calibrated(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", (c("l_partkey") % 3).alias("bucket"), v.impact_target_bps(c("l_discount") * 500, c("l_tax") * 100, c("l_quantity") / 40).alias("target"), F.sqrt((c("l_partkey") % 50).cast("double") / 1000).alias("sqrt_share"), (c("l_tax") * 100).alias("spread_bps"),
        ((c("l_orderkey") % 40).cast("double") / 10000).alias("vol_15m"), (c("l_partkey") % 700).cast("double").alias("latency_ms"), (c("l_orderkey") % 8 == 0).alias("funding_window"), (c("l_linenumber").cast("double") / 7).alias("fill_completion"),
    )
    return m.impact_calibration(t, "l_suppkey")


@query(f"WITH {MODELS} SELECT l_suppkey, sample_count, status, " + ", ".join(f"round({x}, 6) + 0.0 AS {x}" for x in COEFFICIENTS) + " FROM models")
def d60_impact_calibration(spark, sf_dir):
    """Coefficients of a cost model from order telemetry, guarded by the smallest bucket."""
    return calibrated(spark, sf_dir).select("l_suppkey", "sample_count", "status", *[r(x).alias(x) for x in COEFFICIENTS])


@query(f"WITH {MODELS} SELECT l_suppkey, step, round(greatest(0, impact * sqrt(step / 100.0) + spread * 2 + volatility * 0.001 * 10000 + latency * 80 + CASE WHEN step % 2 = 0 THEN funding ELSE 0 END), 5) + 0.0 AS cost_bps FROM models CROSS JOIN (SELECT unnest([1, 2, 5, 10]) AS step)")
def h49_modeled_cost(spark, sf_dir):
    """What the calibrated model expects at several participation rates."""
    models = calibrated(spark, sf_dir).withColumn("step", F.explode(F.array(*map(F.lit, (1, 2, 5, 10)))))
    cost = v.modeled_cost_bps({x: c(x) for x in COEFFICIENTS}, c("step") / 100.0, F.lit(2.0), F.lit(0.001), F.lit(80.0), c("step") % 2 == 0)
    return models.select("l_suppkey", "step", r(cost, 5).alias("cost_bps"))
