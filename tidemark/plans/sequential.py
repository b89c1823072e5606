"""Queries of the sequential, scalar, event-sourcing and streaming families."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import costs as k
from tidemark.functions.columns import c, r, scaled
from tidemark.functions.research import latency_class
from tidemark.operators import backtest, portfolio, recursive, resampling
from tidemark.operators.markets import walk_levels
from tidemark.plans.registry import ORACLES, over_candles, query, rounded
from tidemark.plans.series import BY, REGIMES, RET, labelled, with_returns
from tidemark.sources.tables import candles, table
from tidemark.streaming import events as s

_GAIN = lambda p, g, i="i": f"CASE WHEN {i} < {p} THEN 1.0 / ({i} + 1) ELSE {g} END"
INDICATORS = f"""steps AS (SELECT *, {_GAIN(10, 2 / 11)} AS g_ema, {_GAIN(14, 1 / 14)} AS g_atr, CASE WHEN i <= 1 THEN 1.0 ELSE {_GAIN(14, 1 / 14, '(i - 1)')} END AS g_rsi,
  CASE WHEN i < 10 THEN 1.0 ELSE pow(er * (2 / 3.0 - 2 / 31.0) + 2 / 31.0, 2) END AS g_kama FROM (SELECT *, CASE WHEN i < 10 THEN 0 WHEN path > 1e-12 THEN least(1.0, abs(close - c10) / path) ELSE 0 END AS er
  FROM (SELECT *, sum(abs(ch)) OVER ({BY} ROWS 9 PRECEDING) AS path, lag(close, 10) OVER ({BY}) AS c10, coalesce(stddev_pop(close) OVER ({BY} ROWS 9 PRECEDING), 0) AS sd FROM (SELECT symbol, i, close, high, low,
    coalesce(close - lag(close) OVER ({BY}), 0) AS ch, coalesce(greatest(high - low, abs(high - lag(close) OVER ({BY})), abs(low - lag(close) OVER ({BY}))), high - low) AS tr FROM candles)))),
walk AS (SELECT symbol, i, close AS ema, tr AS atr, greatest(ch, 0.0) AS up, greatest(-ch, 0.0) AS dn, close AS kama FROM steps WHERE i = 0
  UNION ALL SELECT w.symbol, n.i, w.ema + n.g_ema * (n.close - w.ema), w.atr + n.g_atr * (n.tr - w.atr), w.up + n.g_rsi * (greatest(n.ch, 0.0) - w.up), w.dn + n.g_rsi * (greatest(-n.ch, 0.0) - w.dn), w.kama + n.g_kama * (n.close - w.kama)
  FROM walk w JOIN steps n ON n.symbol = w.symbol AND n.i = w.i + 1)"""


@query(over_candles(f"""SELECT w.symbol, w.i, {rounded('w.ema AS ema', 'w.atr AS atr', 'w.kama AS kama', 'n.er AS er', 'CASE WHEN w.i < 14 THEN 50.0 WHEN up < 1e-12 AND dn < 1e-12 THEN 50.0 WHEN dn < 1e-12 THEN 100.0 ELSE 100 - 100 / (1 + up / dn) END AS rsi',
  'CASE WHEN w.i < 9 THEN 0 ELSE (n.close - w.ema) / CASE WHEN sd > 0 THEN sd ELSE 1e-12 END END AS z')} FROM walk w JOIN steps n ON w.symbol = n.symbol AND w.i = n.i""", INDICATORS).replace("WITH ", "WITH RECURSIVE ", 1))
def e03_recursive_indicators(spark, sf_dir):
    """EMA, KAMA with efficiency ratio, ATR, RSI and z-score."""
    return recursive.indicators(candles(spark, sf_dir)).select("symbol", "i", *[r(x).alias(x) for x in ("ema", "atr", "kama", "er", "rsi", "z")])


@query()
def i07_backtests(spark, sf_dir):
    """All backbones, sides and leverages over every symbol; a state machine, so tests hold it against a plain loop."""
    return backtest.run_backtests(candles(spark, sf_dir))


def _draw(*keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(keys)})), 1, 13))::BIGINT"


LENGTHS = "lengths AS (SELECT symbol, count(*) AS n FROM rets GROUP BY symbol)"


@query(over_candles(f"""SELECT symbol, seed, count(*) AS n, round(avg(ret), 12) + 0.0 AS mean, round(coalesce(stddev_samp(ret), 0), 8) + 0.0 AS sd
FROM (SELECT symbol, seed, start + k AS source FROM (SELECT *, {_draw('symbol', 'seed', 'b', "'start'")} % (n - size + 1) AS start FROM (SELECT *, unnest(range(0, (n + size - 1) // size)) AS b FROM (SELECT *, least(4, n) AS size FROM lengths CROSS JOIN range(8) t(seed)))), range(4) u(k) WHERE k < size AND b * size + k < n) JOIN rets ON rets.symbol = symbol_ AND i = source GROUP BY symbol, seed""".replace("SELECT symbol, seed, start + k AS source", "SELECT symbol AS symbol_, seed, start + k AS source"), RET, LENGTHS))
def i12_moving_block_bootstrap(spark, sf_dir):
    """Mean and deviation of each path resampled by blocks."""
    drawn = resampling.resampled(with_returns(spark, sf_dir).select("symbol", "i", "ret"), 8, "moving_block")
    return drawn.groupBy("symbol", "seed").agg(F.count("*").alias("n"), r(F.avg("ret"), 12).alias("mean"), r(F.coalesce(F.stddev_samp("ret"), F.lit(0.0)), 8).alias("sd"))


@query(over_candles(f"""SELECT d.symbol, seed, count(*) AS n, round(avg(ret), 12) + 0.0 AS mean FROM (SELECT *, (start + p - since) % n AS source FROM (SELECT *, last_value(CASE WHEN again THEN p END IGNORE NULLS) OVER w AS since, last_value(CASE WHEN again THEN drawn % n END IGNORE NULLS) OVER w AS start
FROM (SELECT *, p = 0 OR {_draw('symbol', 'seed', 'p', "'again'")} % least(4, n) = 0 AS again, {_draw('symbol', 'seed', 'p', "'start'")} AS drawn FROM (SELECT *, unnest(range(0, n)) AS p FROM lengths CROSS JOIN range(4) t(seed))) WINDOW w AS (PARTITION BY symbol, seed ORDER BY p))) d JOIN rets ON rets.symbol = d.symbol AND i = source GROUP BY d.symbol, seed""", RET, LENGTHS))
def i13_stationary_bootstrap(spark, sf_dir):
    """Blocks of random length that wrap around."""
    drawn = resampling.resampled(with_returns(spark, sf_dir).select("symbol", "i", "ret"), 4, "stationary")
    return drawn.groupBy("symbol", "seed").agg(F.count("*").alias("n"), r(F.avg("ret"), 12).alias("mean"))


@query(over_candles(f"""SELECT symbol, seed, position, source, round(start * exp(sum(lr) OVER (PARTITION BY symbol, seed ORDER BY position)), 5) + 0.0 AS close FROM (SELECT symbol, seed, i AS source, row_number() OVER (PARTITION BY symbol, seed ORDER BY CASE WHEN i = 0 THEN -1 ELSE {_draw('symbol', 'seed', 'i', "'order'")} END, i) - 1 AS position,
 start, lr FROM (SELECT symbol, i, first_value(close) OVER w AS start, coalesce(ln(close / lag(close) OVER w), 0) AS lr FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY i)) CROSS JOIN range(3) t(seed))"""))
def i18_permuted_paths(spark, sf_dir):
    """Every bar of the paths that shuffled returns make."""
    paths = resampling.permuted_paths(candles(spark, sf_dir), 3)
    return paths.select("symbol", "seed", "position", "source", scaled("close", 5).alias("close"))


WILD = f"""flips AS (SELECT symbol, seed, i, 1.0 - 2.0 * ({_draw('symbol', 'seed', 'i', "'shock'")} % 2) AS e, 1.0 - 2.0 * ({_draw('symbol', 'seed', "'first'")} % 2) AS f, close, ret, mean FROM (
  SELECT *, avg(ret) OVER (PARTITION BY symbol) AS mean FROM (SELECT *, CASE WHEN i > 0 THEN CASE WHEN lag(close) OVER (PARTITION BY symbol ORDER BY i) <> 0 THEN close / lag(close) OVER (PARTITION BY symbol ORDER BY i) - 1 ELSE 0.0 END END AS ret FROM candles)) CROSS JOIN range(3) t(seed)),
wild AS (SELECT symbol, seed, i, exp(-0.25) * f + sqrt(1 - exp(-0.5)) * e AS w, greatest(close, 1e-9) AS price FROM flips WHERE i = 0
  UNION ALL SELECT d.symbol, d.seed, n.i, exp(-0.25) * d.w + sqrt(1 - exp(-0.5)) * n.e, greatest(d.price * (1 + n.mean + (n.ret - n.mean) * (exp(-0.25) * d.w + sqrt(1 - exp(-0.5)) * n.e)), 1e-9) FROM wild d JOIN flips n ON n.symbol = d.symbol AND n.seed = d.seed AND n.i = d.i + 1)"""
SHOCK = "avg({x}) OVER (PARTITION BY w.symbol, w.seed) + ({x} - avg({x}) OVER (PARTITION BY w.symbol, w.seed)) * w"


@query(over_candles(f"""SELECT symbol, seed, i, {rounded('w AS weight', 'round(o, 9) AS open', 'greatest(o, price, price * greatest(high / price0, 1.0)) AS high', 'least(o, price, price * least(low / price0, 1.0)) AS low', 'price AS close', 'funding', 'oi', 'liq', digits=5)}
FROM (SELECT w.symbol, w.seed, w.i, w, CASE WHEN max(w.i) OVER (PARTITION BY w.symbol) = 0 THEN n.close ELSE price END AS price, CASE WHEN n.close <> 0 THEN n.close ELSE price END AS price0, n.high, n.low,
  CASE WHEN max(w.i) OVER (PARTITION BY w.symbol) = 0 THEN n.open ELSE coalesce(lag(price) OVER (PARTITION BY w.symbol, w.seed ORDER BY w.i), price) END AS o,
  {SHOCK.format(x='n.funding')} AS funding, greatest(0.0, {SHOCK.format(x='n.oi')}) AS oi, greatest(0.0, {SHOCK.format(x='n.liq')}) AS liq FROM wild w JOIN candles n ON n.symbol = w.symbol AND n.i = w.i)""", WILD).replace("WITH ", "WITH RECURSIVE ", 1))
def i15_wild_paths(spark, sf_dir):
    """Bars of dependent wild bootstrap paths with their sidecars."""
    paths = resampling.wild_paths(candles(spark, sf_dir), 3)
    return paths.select("symbol", "seed", "i", *[r(x, 5).alias(x) for x in ("weight", "open", "high", "low", "close", "funding", "oi", "liq")])


@query(over_candles(f"""SELECT seed, position, ts AS drawn_ts, symbol, i, round(ret, 9) + 0.0 AS ret FROM (SELECT seed, b * size + k AS position, start + k AS source FROM (SELECT *, {_draw("'calendar'", 'seed', 'b', "'start'")} % (n - size + 1) AS start FROM
  (SELECT *, unnest(range(0, (n + size - 1) // size)) AS b FROM (SELECT n, seed, least(4, n) AS size FROM (SELECT count(*) AS n FROM calendar) CROSS JOIN range(3) t(seed)))), range(4) u(k) WHERE k < size AND b * size + k < n)
JOIN calendar USING (source) JOIN rets USING (ts)""", RET, "calendar AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS source FROM (SELECT DISTINCT ts FROM candles))"))
def i16_shared_blocks(spark, sf_dir):
    """Bars of all symbols in blocks drawn on one calendar."""
    drawn = resampling.shared_blocks(with_returns(spark, sf_dir).select("symbol", "ts", "i", "ret"), 3)
    return drawn.select("seed", "position", "drawn_ts", "symbol", "i", r("ret", 9).alias("ret"))


TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"""WITH hours AS (SELECT date_trunc('hour', ts) AS h, {', '.join(f"sum(CASE WHEN event_type = '{k}' THEN value ELSE 0 END) AS v{i}" for i, k in enumerate(TYPES))} FROM events GROUP BY 1),
grid AS (SELECT *, row_number() OVER (ORDER BY h) - 1 AS t, ({' + '.join(f'v{i}' for i in range(len(TYPES)))}) / {len(TYPES)} AS base FROM hours),
x AS ({' UNION ALL '.join(f"SELECT '{k}' AS model, t, v{i} - base AS d FROM grid" for i, k in enumerate(TYPES))}),
size AS (SELECT max(t) + 1 AS n FROM x), m AS (SELECT model, avg(d) AS mean FROM x GROUP BY model),
starts AS (SELECT seed, b * 4 + k AS p, {_draw("'calendar'", 'seed', 'b', "'start'")} % (n - 4 + 1) + k AS source, n FROM (SELECT n, seed, unnest(range(0, (n + 3) // 4)) AS b FROM size CROSS JOIN range(40) t(seed)), range(4) u(k) WHERE b * 4 + k < n),
star AS (SELECT model, seed, sum(d) / any_value(n) AS star, any_value(n) AS n FROM starts JOIN x ON x.t = source GROUP BY model, seed),
w AS (SELECT * FROM (SELECT model, any_value(mean) AS mean, any_value(n) AS n, sqrt(any_value(n) * avg((star - mean) ** 2)) AS omega FROM star JOIN m USING (model) GROUP BY model) WHERE omega > 1e-12),
c AS (SELECT *, greatest(mean, 0) AS lo, CASE WHEN mean >= -omega / sqrt(n) * sqrt(2 * ln(ln(n))) THEN mean ELSE 0 END AS mid FROM w),
worst AS (SELECT seed, greatest(max(sqrt(c.n) * (star - lo) / omega), 0) AS lo, greatest(max(sqrt(c.n) * (star - mid) / omega), 0) AS mid, greatest(max(sqrt(c.n) * (star - mean) / omega), 0) AS hi FROM star JOIN c USING (model) GROUP BY seed),
top AS (SELECT max(n) AS n, count(*) AS models, greatest(max(sqrt(n) * mean / omega), 0) AS statistic FROM c)
SELECT n, models, round(any_value(statistic), 6) + 0.0 AS statistic, round(avg((lo > statistic)::INT), 6) + 0.0 AS p_lower, round(avg((mid > statistic)::INT), 6) + 0.0 AS p_consistent, round(avg((hi > statistic)::INT), 6) + 0.0 AS p_upper FROM worst CROSS JOIN top GROUP BY n, models""")
def d18_superior_ability(spark, sf_dir):
    """Is any event type worth more by the hour than the types are on average?"""
    of = lambda k: F.sum(F.when(c("event_type") == k, c("value")).otherwise(0.0))
    hours = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(*[of(k).alias(k) for k in TYPES])
    grid = hours.withColumns({"t": (F.row_number().over(W.orderBy("h")) - 1).cast("bigint"), "base": sum((c(k) for k in TYPES[1:]), c(TYPES[0])) / len(TYPES)})
    excess = grid.select("t", F.inline(F.array(*[F.struct(F.lit(k).alias("model"), (c(k) - c("base")).alias("d")) for k in TYPES])))
    found = resampling.superior_ability(excess, 40)
    return found.select("n", "models", *[r(x).alias(x) for x in ("statistic", "p_lower", "p_consistent", "p_upper")])


@query()
def i19_jump_paths(spark, sf_dir):
    return resampling.jump_paths(spark, 16, 200).groupBy("seed").agg(F.count("*").alias("n"), r(F.min("price")).alias("low"), r(F.max_by("price", "position")).alias("last"))


@query()
def i20_portfolio_allocation(spark, sf_dir):
    """One book a customer nation; order-dependent, so a plain loop checks it in the tests."""
    li = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey"))
    rank = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    book = li.select(c("c_nationkey").alias("book"), rank.alias("rank"), (c("o_custkey") % 7).alias("symbol"), c("o_totalprice").alias("notional"), ((c("o_orderkey") % 50) / 100.0).alias("max_drawdown"))
    return portfolio.allocate(book, equity=2e6, per_symbol=9e5, leverage=2.5, drawdown_budget=0.6)


@query("SELECT l_suppkey, l_partkey, round(CASE WHEN s > 0 THEN w / s ELSE 0 END, 9) + 0.0 AS weight FROM (SELECT *, sum(w) OVER (PARTITION BY l_suppkey) AS s FROM (SELECT l_suppkey, l_partkey, least(0.2, CASE WHEN sum(greatest(v, 0.0)) OVER (PARTITION BY l_suppkey) > 0 THEN greatest(v, 0.0) / sum(greatest(v, 0.0)) OVER (PARTITION BY l_suppkey) ELSE 0 END) AS w FROM (SELECT l_suppkey, l_partkey, sum(l_discount - 0.03) AS v FROM lineitem GROUP BY 1, 2)))")
def h47_score_tilt(spark, sf_dir):
    """Capped weights of a supplier's parts, made to sum to one."""
    v = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(c("l_discount") - 0.03).alias("v"))
    return portfolio.score_tilt(v, "v", by="l_suppkey", cap=0.2).select("l_suppkey", "l_partkey", r("weight", 9).alias("weight"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(abs(l_extendedprice) * (5 + l_discount * 100) / 10000, 6) + 0.0 AS cost, round(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_extendedprice * l_tax / 100, 6) + 0.0 AS funding,
round(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 + (1 / l_quantity - 0.01)) ELSE l_extendedprice * (1 - (1 / l_quantity - 0.01)) END, 6) + 0.0 AS liq_price,
round(least(500.0, greatest(0.0, 0.1 * sqrt(l_extendedprice / (l_quantity * 5000)) * l_discount * 10000 * CASE WHEN l_tax > 0.05 AND l_linestatus = 'O' THEN 1.5 ELSE 1 END)), 5) + 0.0 AS impact_bps FROM lineitem""")
def h02_trade_costs(spark, sf_dir):
    """H1-H4, H11."""
    side = F.when(c("l_returnflag") == "R", "short").otherwise("long")
    regime = F.when(c("l_linestatus") == "O", "crash").otherwise("sideways")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r(k.trade_cost(c("l_extendedprice"), F.lit(5.0), c("l_discount") * 100)).alias("cost"), r(k.funding_cash(c("l_extendedprice"), c("l_tax") / 100, side)).alias("funding"),
        r(k.liquidation_price(c("l_extendedprice"), side, c("l_quantity"), F.lit(0.01))).alias("liq_price"), r(k.square_root_impact(c("l_extendedprice"), c("l_discount"), c("l_quantity") * 5000, c("l_tax") > 0.05, regime), 5).alias("impact_bps"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(least(500.0, greatest(0.0, 2.5 / 2 + 0.1 * l_discount * sqrt(l_extendedprice / 1000000) * 10000 + 0.01 * 25 * l_discount)), 5) + 0.0 AS impact_bps,
CASE n WHEN 4 THEN 1.75 WHEN 3 THEN 1.5 WHEN 2 THEN 1.25 ELSE 1.0 END::DOUBLE AS cascade, round(least(l_quantity, greatest(0.0, 60 - greatest(0.0, 40 - l_linenumber * 5))), 6) + 0.0 AS queue_fill FROM (SELECT *, (l_tax > 0.04)::INT + (l_discount > 0.05)::INT + (l_quantity > 25)::INT + (l_returnflag = 'R')::INT AS n FROM lineitem)""")
def h05_depth_impact(spark, sf_dir):
    """H5-H6, H18."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r(k.depth_impact(c("l_extendedprice"), F.lit(1e6), c("l_discount"), F.lit(2.5), F.lit(25.0)), 5).alias("impact_bps"),
        k.cascade(c("l_tax") > 0.04, c("l_discount") > 0.05, c("l_quantity") > 25, c("l_returnflag") == "R").alias("cascade"), r(k.queue_fill(c("l_quantity"), F.lit(40.0), F.lit(60.0), c("l_linenumber") * 5)).alias("queue_fill"),
    )


BOOK = "lv AS (SELECT user_id, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events WHERE event_type = 'view'), top AS (SELECT *, coalesce(sum(qty) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM lv WHERE qty > 0)"


@query(f"WITH {BOOK} SELECT user_id, round(sum(t), 6) + 0.0 AS filled, round(sum(t * price) / nullif(sum(t), 0), 6) + 0.0 AS vwap FROM (SELECT user_id, price, least(qty, greatest(0.0, 150 - ahead)) AS t FROM top) GROUP BY user_id")
def h19_depth_walk(spark, sf_dir):
    """The whole book, level by level."""
    levels = table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", "event_id", c("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("qty"))
    walked = walk_levels(levels, by="user_id", order=["price", "event_id"], quantity=150.0)
    return walked.select("user_id", r("filled").alias("filled"), r("vwap").alias("vwap"))


@query("SELECT o_orderkey, round((p1 - p0) / p0 * 10000, 5) + 0.0 AS arrival_bps, round((p2 - p1) / p1 * 10000, 5) + 0.0 AS realised_bps, round((p2 - p1) / p1 * 10000 - 2, 5) + 0.0 AS excess_bps FROM (SELECT o_orderkey, o_totalprice AS p0, o_totalprice + o_custkey % 13 AS p1, o_totalprice + o_orderkey % 17 AS p2 FROM orders)")
def h23_transaction_cost(spark, sf_dir):
    """H17, H23."""
    p0, p1, p2 = c("o_totalprice"), c("o_totalprice") + c("o_custkey") % 13, c("o_totalprice") + c("o_orderkey") % 17
    bps = lambda a, b: k.side_slippage_bps(F.lit("BUY"), a, b)
    return table(spark, sf_dir, "orders").select("o_orderkey", r(bps(p0, p1), 5).alias("arrival_bps"), r(bps(p1, p2), 5).alias("realised_bps"), r(bps(p1, p2) - 2, 5).alias("excess_bps"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, date_trunc('hour', ts) AS bucket, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN 'lt_50ms' WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 250 THEN '50ms_250ms' ELSE '250ms_1s' END AS latency FROM events")
def h30_event_parsing(spark, sf_dir):
    """H21, H29-H31, H39."""
    kk = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", kk.alias("k"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket"), latency_class(kk).alias("latency"))


@query("SELECT c_custkey, upper(replace(c_name, '#', '/')) AS market, replace(replace(c_mktsegment || 'USDT', 'USDT', ''), 'USD', '') AS base, sha256('{\"a\":' || c_custkey || ',\"b\":\"' || c_mktsegment || '\"}') AS digest FROM customer")
def h35_symbol_names(spark, sf_dir):
    """Names and canonical hashes."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.upper(F.replace("c_name", F.lit("#"), F.lit("/"))).alias("market"), k.base_asset(F.concat("c_mktsegment", F.lit("USDT"))).alias("base"), F.sha2(F.to_json(F.struct(c("c_custkey").alias("a"), c("c_mktsegment").alias("b"))), 256).alias("digest"))


@query("SELECT p_partkey, CAST(len(list_filter(range(1, p_size + 1, 3), lambda x: x % 7 <> 0)) AS INTEGER) AS values_kept FROM part")
def h50_range_enumeration(spark, sf_dir):
    kept = F.filter(F.sequence(F.lit(1), c("p_size"), F.lit(3)), lambda x: x % 7 != 0)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(kept).alias("values_kept"))


@query("WITH preset(p, d, s) AS (VALUES ('1-URGENT', 3, 9), ('2-HIGH', 2, NULL), ('5-LOW', NULL, 1)) SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 2 = 0 THEN 7 END, d, 1) AS delay, coalesce(CASE WHEN o_custkey % 3 = 0 THEN 4 END, s, 5) AS stress FROM orders LEFT JOIN preset ON p = o_orderpriority")
def h51_scenario_overlay(spark, sf_dir):
    """An explicit value wins over the preset, the preset over the default.  The preset table is a handful of rows."""
    preset = spark.createDataFrame([("1-URGENT", 3, 9), ("2-HIGH", 2, None), ("5-LOW", None, 1)], "p string, d int, s int")
    o = table(spark, sf_dir, "orders").join(F.broadcast(preset), c("o_orderpriority") == c("p"), "left")
    return o.select("o_orderkey", F.coalesce(F.when(c("o_custkey") % 2 == 0, 7), "d", F.lit(1)).alias("delay"), F.coalesce(F.when(c("o_custkey") % 3 == 0, 4), "s", F.lit(5)).alias("stress"))


@query("SELECT l_suppkey, net, round(abs(notional / nullif(net, 0)), 6) + 0.0 AS entry_price, fees, last_order FROM (SELECT l_suppkey, sum(q) AS net, sum(q * l_extendedprice) AS notional, round(sum(l_extendedprice * l_tax), 2) + 0.0 AS fees, max(l_orderkey) AS last_order FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS q FROM lineitem) GROUP BY 1)")
def i24_position_projection(spark, sf_dir):
    """Positions, net-cost entry price (NULL when flat) and fees replayed from fills."""
    q = F.when(c("l_returnflag") == "R", -c("l_quantity")).otherwise(c("l_quantity"))
    p = table(spark, sf_dir, "lineitem").withColumn("q", q).groupBy("l_suppkey").agg(F.sum("q").alias("net"), F.sum(c("q") * c("l_extendedprice")).alias("notional"), r(F.sum(c("l_extendedprice") * c("l_tax")), 2).alias("fees"), F.max("l_orderkey").alias("last_order"))
    return p.select("l_suppkey", "net", r(F.abs(c("notional") / F.nullif(c("net"), F.lit(0.0)))).alias("entry_price"), "fees", "last_order")


@query("""WITH allowed(a, b) AS (VALUES ('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('view', 'view'), ('click', 'view'), ('error', 'view')) SELECT user_id, count(*) AS steps, count(*) FILTER (a IS NULL) AS forbidden FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) LEFT JOIN allowed ON a = prev AND b = event_type WHERE prev IS NOT NULL GROUP BY user_id""")
def i27_state_machine(spark, sf_dir):
    """Transitions checked against the table of allowed ones (fixed and small)."""
    allowed = spark.createDataFrame([("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"), ("error", "view")], "a string, b string")
    steps = table(spark, sf_dir, "events").select("user_id", "event_type", F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("prev")).where("prev IS NOT NULL")
    return steps.join(F.broadcast(allowed), (c("a") == c("prev")) & (c("b") == c("event_type")), "left").groupBy("user_id").agg(F.count("*").alias("steps"), F.expr("count_if(a IS NULL)").alias("forbidden"))


@query("SELECT event_id, user_id, used, used > 5 AS over_budget FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS used FROM events WHERE event_type = 'click')")
def i28_cancel_budget(spark, sf_dir):
    """Cancels in the six hours up to each."""
    micros = F.unix_micros(c("ts").cast("timestamp"))
    six = 6 * 3600 * 1_000_000
    used = F.count("*").over(W.partitionBy("user_id").orderBy("t").rangeBetween(-six, 0))
    return table(spark, sf_dir, "events").where("event_type = 'click'").withColumn("t", micros).select("event_id", "user_id", used.alias("used"), (used > 5).alias("over_budget"))


@query("WITH d AS (SELECT user_id, event_id, ts, sha256(event_id || ':' || props) AS digest FROM events) SELECT user_id, event_id, coalesce(lag(digest) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'genesis') AS prev_digest, digest FROM d")
def h42_digest_chain(spark, sf_dir):
    """Each event beside the digest of the one before it, which is how a chain is verified in parallel."""
    d = table(spark, sf_dir, "events").withColumn("digest", F.sha2(F.concat_ws(":", c("event_id").cast("string"), "props"), 256))
    return d.select("user_id", "event_id", F.coalesce(F.lag("digest").over(W.partitionBy("user_id").orderBy("ts", "event_id")), F.lit("genesis")).alias("prev_digest"), "digest")


@query("SELECT DISTINCT user_id, props FROM events")
def j02_stream_dedupe(spark, sf_dir):
    """J1-J2.  Keys cover the whole table here, so state is kept without the watermark's bound."""
    raw = spark.readStream.schema(s.SCHEMA).parquet(f"{sf_dir}/events*.parquet")
    return s.drained(raw.select("user_id", "props").dropDuplicates(["user_id", "props"]), "append")


@query("SELECT event_type, date_trunc('hour', ts) AS bucket, round(sum(value), 6) + 0.0 AS notional, count(*) AS n FROM events GROUP BY 1, 2")
def j11_stream_windows(spark, sf_dir):
    out = s.drained(s.tumbling(s.event_stream(spark, sf_dir)).select("event_type", c("window.start").alias("bucket"), "notional", "n"), "complete")
    return out.select("event_type", c("bucket").cast("timestamp_ntz").alias("bucket"), r("notional").alias("notional"), "n")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (props = pp) AS repeats, count(*) FILTER (epoch_us(ts) - epoch_us(pt) > 3600000000) AS gaps FROM (SELECT *, lag(props) OVER w AS pp, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id")
def j03_stream_replay(spark, sf_dir):
    return s.drained(s.replay_counters(s.event_stream(spark, sf_dir)), "update", ["user_id"])


@query("""WITH ev AS (SELECT user_id, ts, count(*) FILTER (WHERE new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 86400000000, true) AS new FROM events)),
mark AS (SELECT max(ts) - INTERVAL 2 HOUR AS wm FROM events),
lives AS (SELECT user_id, session, min(ts) AS started, max(ts) AS last, count(*) AS messages FROM ev GROUP BY user_id, session),
due AS (SELECT *, unnest(range(1, CAST((epoch_us(last) + 86400000000 - epoch_us(started)) // 21600000000 + 1 AS BIGINT))) AS k FROM lives),
seen AS (SELECT user_id, max(session) AS final FROM lives GROUP BY user_id),
beats AS (SELECT user_id, session, started, last, started + k * INTERVAL 6 HOUR AS beat FROM due)
SELECT user_id, started, beat AS "at", 'heartbeat' AS kind, (SELECT count(*) FROM ev a WHERE a.user_id = b.user_id AND a.session = b.session AND a.ts <= b.beat) AS messages
FROM beats b JOIN seen USING (user_id) CROSS JOIN mark WHERE session < final OR b.beat <= wm OR b.beat < last
UNION ALL SELECT user_id, started, last + INTERVAL 24 HOUR, 'expired', messages FROM lives JOIN seen USING (user_id) CROSS JOIN mark WHERE session < final OR last + INTERVAL 24 HOUR <= wm""")
def j10_session_heartbeats(spark, sf_dir):
    """Heartbeats and ends of each user's sessions, timers included."""
    beats = s.drained(s.heartbeats(s.event_stream(spark, sf_dir)), "append")
    return beats.select("user_id", c("started").cast("timestamp_ntz").alias("started"), c("at").cast("timestamp_ntz").alias("at"), "kind", "messages")


@query()
def j04_stream_order_book(spark, sf_dir):
    """A keyed book of levels; the tests hold it against a plain loop."""
    return s.drained(s.order_books(s.event_stream(spark, sf_dir)), "update", ["user_id"])


@query()
def j05_depth_updates(spark, sf_dir):
    """Snapshots and diffs applied to books, with gaps, stale diffs and resyncs; the tests hold it against a plain loop."""
    return s.drained(s.depth_updates(s.depth_messages(s.event_stream(spark, sf_dir))), "append")


@query("SELECT event_type, n, errors, round(1 - errors / n, 6) + 0.0 AS quality, round(span / 3600.0, 4) + 0.0 AS hours FROM (SELECT event_type, count(*) AS n, count(*) FILTER (value < 1) AS errors, epoch(max(ts)) - epoch(min(ts)) AS span FROM events GROUP BY 1)")
def j13_soak_report(spark, sf_dir):
    """J9, J13."""
    t = F.unix_micros(c("ts").cast("timestamp")) / 1e6
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.expr("count_if(value < 1)").alias("errors"), (F.max(t) - F.min(t)).alias("span"))
    return g.select("event_type", "n", "errors", r(1 - c("errors") / c("n")).alias("quality"), r(c("span") / 3600.0, 4).alias("hours"))


@query(over_candles(f"SELECT symbol, i, round(x, 6) + 0.0 AS bps, round(close * (1 + x / 10000), 6) + 0.0 AS fill FROM (SELECT symbol, i, close, CASE WHEN oi <= 0 THEN 5 ELSE least(500.0, 0.1 * sqrt(close / oi) * v * 10000 * CASE WHEN oi > q AND regime = 'crash' THEN 1.5 WHEN oi > q AND regime = 'short_squeeze' THEN 1.35 WHEN oi > q AND regime = 'liquidity_stress' THEN 1.25 ELSE 1 END) END AS x FROM (SELECT g.*, quantile_cont(g.oi, 0.9) OVER (PARTITION BY g.symbol) AS q, coalesce(stddev_samp(CASE WHEN g.i > 0 THEN t.ret END) OVER (PARTITION BY g.symbol ORDER BY g.i ROWS 29 PRECEDING), 0) AS v FROM regimes g JOIN rets t ON g.symbol = t.symbol AND g.i = t.i))", REGIMES, RET))
def h10_slippage_models(spark, sf_dir):
    """H4, H9-H10 over the regime series."""
    from tidemark.operators import windows as w

    df = labelled(spark, sf_dir).withColumn("ret", w.lag_return()).withColumns({"vol": w.rolling_return_std(), "stressed": w.above_percentile("oi", 0.9)})
    df = df.withColumn("x", k.square_root_impact(c("close"), c("vol"), c("oi"), c("stressed"), c("regime")))
    return df.select("symbol", "i", r("x").alias("bps"), r(c("close") * (1 + c("x") / 1e4)).alias("fill"))
