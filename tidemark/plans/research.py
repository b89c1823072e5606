"""Queries of the feature, forecast, memory and calibration families, on the shared tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import research as x
from tidemark.functions.columns import by_symbol, c, exact_mean, r
from tidemark.operators import joins as j
from tidemark.plans.registry import over_candles, query
from tidemark.plans.series import RET, with_returns
from tidemark.sources.tables import candles, dealt, table


LINE = ["l_orderkey", "l_linenumber", "l_partkey"]


def symbol_events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumnRenamed("user_id", "symbol")


@query(over_candles("SELECT symbol, i, ts + INTERVAL 1 HOUR AS ts_close, round(close * (1 - funding), 6) + 0.0 AS best_bid, round(close * (1 + abs(funding)), 6) + 0.0 AS best_ask, round(CASE WHEN oi <> 0 THEN close / oi - 1 ELSE 0 END, 9) + 0.0 AS premium, round(close * volume, 4) + 0.0 AS quote_volume FROM candles"))
def b04_feature_rows(spark, sf_dir):
    """One point-in-time row a bar; every column is known at ``ts_close``."""
    premium = F.when(c("oi") != 0, c("close") / c("oi") - 1).otherwise(0.0)
    return candles(spark, sf_dir).select("symbol", "i", (c("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts_close"), r(c("close") * (1 - c("funding"))).alias("best_bid"), r(c("close") * (1 + F.abs("funding"))).alias("best_ask"), r(premium, 9).alias("premium"), r(c("close") * c("volume"), 4).alias("quote_volume"))


QUANTILES = "quantiles AS (SELECT symbol, i, open AS observed, [low, low] AS q10, [close, (open + close) / 2] AS q50, [high, high] AS q90 FROM candles WHERE open > 0)"


def quantile_rows(spark, sf_dir):
    middle = F.array("close", (c("open") + c("close")) / 2)
    return candles(spark, sf_dir).where("open > 0").select("symbol", "i", c("open").alias("observed"), F.array("low", "low").alias("q10"), middle.alias("q50"), F.array("high", "high").alias("q90"))


@query(over_candles("""SELECT symbol, i, round(q50[-1] / observed - 1, 6) + 0.0 AS q50_return, CAST(sign(q50[-1] / observed - 1) AS INTEGER) AS direction,
  round(w / greatest(abs(observed), 1e-12), 6) + 0.0 AS uncertainty, round(CASE WHEN w <> 0 THEN ((q90[-1] - q50[-1]) - (q50[-1] - q10[-1])) / w ELSE 0 END, 6) + 0.0 AS skew,
  CASE WHEN w / greatest(abs(observed), 1e-12) <= 0.01 THEN 'high' WHEN w / greatest(abs(observed), 1e-12) <= 0.03 THEN 'medium' ELSE 'low' END AS confidence,
  round(least(1.0, abs(q50[1] - observed) / greatest(abs(observed), 1.0)), 6) + 0.0 AS direction_confidence FROM (SELECT *, q90[-1] - q10[-1] AS w FROM quantiles)""", QUANTILES))
def b05_forecast_fields(spark, sf_dir):
    """Derived fields of quantile forecasts."""
    q = quantile_rows(spark, sf_dir)
    f = x.forecast_fields("q10", "q50", "q90", "observed")
    return q.select("symbol", "i", r(f["q50_return"]).alias("q50_return"), f["direction"].alias("direction"), r(f["uncertainty"]).alias("uncertainty"), r(f["skew"]).alias("skew"), f["confidence"].alias("confidence"), r(x.direction_confidence("q50", "observed")).alias("direction_confidence"))


@query(over_candles("""SELECT symbol, i, concat_ws(',', CASE WHEN len(q10) <> len(q50) OR len(q90) <> len(q50) THEN 'length_mismatch' END, CASE WHEN q10[1] > q50[1] OR q10[2] > q50[2] OR q50[1] > q90[1] OR q50[2] > q90[2] THEN 'quantiles_not_ordered' END, CASE WHEN q50[1] < 5 OR q50[2] < 5 THEN 'below_floor' END) AS issues FROM quantiles""", QUANTILES))
def l76_forecast_issues(spark, sf_dir):
    """Lengths and order of the quantiles of each forecast."""
    low = F.when(F.exists("q50", lambda v: v < 5), "below_floor")
    return quantile_rows(spark, sf_dir).select("symbol", "i", F.concat_ws(",", *x.forecast_issues("q10", "q50", "q90"), low).alias("issues"))


@query("""WITH k AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS h FROM events WHERE event_type = 'click'), s AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS h FROM events WHERE event_type <> 'view' AND value > 10)
SELECT user_id, count(*) FILTER (a AND NOT b) AS missing, count(*) FILTER (b AND NOT a) AS orphan, concat_ws(',', CASE WHEN count(*) FILTER (a AND NOT b) > 0 THEN 'missing_funding_count=' || count(*) FILTER (a AND NOT b) END, CASE WHEN count(*) FILTER (b AND NOT a) > 0 THEN 'orphan_funding_count=' || count(*) FILTER (b AND NOT a) END) AS flags
FROM (SELECT user_id, h, bool_or(a) AS a, bool_or(b) AS b FROM (SELECT user_id, h, true AS a, false AS b FROM k UNION ALL SELECT user_id, h, false, true FROM s) GROUP BY 1, 2) GROUP BY user_id""")
def b10_series_coverage(spark, sf_dir):
    """Both set differences of two time sets in one aggregation."""
    e = symbol_events(spark, sf_dir).withColumn("h", F.date_trunc("hour", "ts"))
    seen = e.groupBy("symbol", "h").agg(F.bool_or(c("event_type") == "click").alias("a"), F.bool_or((c("event_type") != "view") & (c("value") > 10)).alias("b")).where("a OR b")
    n = seen.groupBy(c("symbol").alias("user_id")).agg(F.expr("count_if(a AND NOT b)").alias("missing"), F.expr("count_if(b AND NOT a)").alias("orphan"))
    named = lambda k: F.when(c(k) > 0, F.concat(F.lit(f"{k}_funding_count="), c(k).cast("string")))
    return n.select("user_id", "missing", "orphan", F.concat_ws(",", named("missing"), named("orphan")).alias("flags"))


@query("SELECT l_suppkey, count(*) FILTER (l_shipdate <= o_orderdate) AS invalid_interval, count(*) FILTER (l_discount = 0) AS without_source, count(*) FILTER (l_shipdate > last) AS future_bar FROM lineitem JOIN orders ON l_orderkey = o_orderkey, (SELECT max(o_orderdate) AS last FROM orders) GROUP BY l_suppkey")
def b14_label_checks(spark, sf_dir):
    """Label intervals [t, T] against each other and against the last bar."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    last = o.agg(F.max("o_orderdate").alias("last"))
    both = table(spark, sf_dir, "lineitem").join(o, c("l_orderkey") == c("o_orderkey")).crossJoin(F.broadcast(last))
    return both.groupBy("l_suppkey").agg(F.expr("count_if(l_shipdate <= o_orderdate)").alias("invalid_interval"), F.expr("count_if(l_discount = 0)").alias("without_source"), F.expr("count_if(l_shipdate > last)").alias("future_bar"))


CONTRACTS = (("click", 21600, "paper,research", "low"), ("purchase", 172800, "research", "research_only"), ("view", 3600, "live,paper,research", "low"))


@query("""WITH contracts(name, max_age, modes, risk) AS (VALUES """ + ", ".join(map(str, CONTRACTS)) + """), seen AS (SELECT user_id, event_type, max(ts) AS last_at FROM events GROUP BY 1, 2), clock AS (SELECT max(ts) - INTERVAL 6 HOUR AS now FROM events)
SELECT user_id, event_type, concat_ws(',', CASE WHEN name IS NULL THEN 'missing_contract' END, CASE WHEN NOT list_contains(string_split(modes, ','), 'paper') THEN 'mode_not_allowed' END, CASE WHEN risk = 'research_only' THEN 'research_only_field' END, CASE WHEN name IS NOT NULL AND last_at > now THEN 'future_timestamp' END, CASE WHEN epoch(now) - epoch(last_at) > max_age THEN 'feature_stale' END) AS issues
FROM seen LEFT JOIN contracts ON name = event_type, clock""")
def b16_feature_contracts(spark, sf_dir):
    """Freshness, leakage and mode of each symbol's features under their contracts."""
    contracts = spark.createDataFrame(list(CONTRACTS), "name string, max_age int, modes string, risk string")
    seen = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("at"))
    clock = seen.agg((F.max("at") - F.expr("INTERVAL 6 HOURS")).alias("now"))
    full = seen.join(F.broadcast(contracts), c("name") == c("event_type"), "left").crossJoin(F.broadcast(clock))
    return full.select("user_id", "event_type", F.concat_ws(",", *x.contract_issues("name", "modes", "risk", "max_age", "at", "now", mode="paper")).alias("issues"))


@query(over_candles("SELECT symbol, count(*) FILTER (a IS DISTINCT FROM b) AS changed, min(i) FILTER (a IS DISTINCT FROM b) AS first_changed, coalesce(min(i) FILTER (a IS DISTINCT FROM b) >= 10, true) AS causal FROM (SELECT symbol, i, round(avg(close) OVER w, 6) AS a, round(avg(CASE WHEN i >= 10 THEN close + 1 ELSE close END) OVER w, 6) AS b FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 3 PRECEDING)) GROUP BY symbol"))
def b18_causality_audit(spark, sf_dir):
    """A feature on mutated prices may differ from the first mutated bar on, never before it."""
    base = candles(spark, sf_dir).select("symbol", "i", "close")
    feature = lambda df, name: df.select("symbol", "i", F.round(F.avg("close").over(by_symbol().rowsBetween(-3, 0)), 6).alias(name))
    mutated = base.withColumn("close", F.when(c("i") >= 10, c("close") + 1).otherwise(c("close")))
    both = feature(base, "a").join(feature(mutated, "b"), ["symbol", "i"])
    first = F.min(F.when(~c("a").eqNullSafe(c("b")), c("i")))
    return both.groupBy("symbol").agg(F.count(F.when(~c("a").eqNullSafe(c("b")), 1)).alias("changed"), first.alias("first_changed"), F.coalesce(first >= 10, F.lit(True)).alias("causal"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def b25_quality_policy(spark, sf_dir):
    """Dirty rows out by policy, then the report's limit."""
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey", "o_orderstatus", "o_totalprice")




@query("SELECT e.event_id, f.value AS forecast FROM events e LEFT JOIN (SELECT user_id, date_trunc('hour', ts) AS h, max_by(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) f ON f.user_id = e.user_id AND f.h = date_trunc('hour', e.ts) - INTERVAL 1 HOUR WHERE e.event_type = 'click'")
def c03_point_in_time_join(spark, sf_dir):
    """Equi-join on (symbol, bar); of two forecasts for a bar the last wins, one that looks ahead is an error."""
    e = symbol_events(spark, sf_dir).withColumn("h", F.date_trunc("hour", "ts"))
    made = e.where("event_type = 'purchase'").select("symbol", (c("h") + F.expr("INTERVAL 1 HOUR")).alias("h"), c("value").alias("forecast"), c("ts").alias("context_end"), "event_id")
    out = j.point_in_time_join(e.where("event_type = 'click'").select("symbol", "h", "event_id"), made, keys=["symbol", "h"], values=["forecast"], known_at="context_end", deadline="h", tie="event_id")
    return out.select("event_id", "forecast")


@query("SELECT o_orderkey, o_custkey, f.l_partkey AS first_part, s.s_name FROM orders LEFT JOIN (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1) f ON l_orderkey = o_orderkey LEFT JOIN supplier s ON s_suppkey = f.l_suppkey WHERE o_orderstatus = 'O'")
def c07_first_match_lookup(spark, sf_dir):
    """The first artifact of each order, then its dimension."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("f")).select("l_orderkey", "f.l_partkey", "f.l_suppkey")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(first, c("o_orderkey") == c("l_orderkey"), "left")
    return o.join(table(spark, sf_dir, "supplier"), c("l_suppkey") == c("s_suppkey"), "left").select("o_orderkey", "o_custkey", c("l_partkey").alias("first_part"), "s_name")


@query("WITH a AS (SELECT event_id, md5(props) AS h FROM events WHERE event_id % 7 <> 0), b AS (SELECT event_id, md5(CASE WHEN event_id % 13 = 0 THEN props || 'x' ELSE props END) AS h FROM events WHERE event_id % 11 <> 0) SELECT event_id, CASE WHEN b.h IS NULL THEN 'missing_backfill' WHEN a.h = b.h THEN 'match' ELSE 'mismatch' END AS status FROM a LEFT JOIN b USING (event_id)")
def c08_backfill_hashes(spark, sf_dir):
    """Real-time rows against the backfill's digests."""
    e = table(spark, sf_dir, "events")
    a = e.where("event_id % 7 <> 0").select("event_id", F.md5(c("props").cast("binary")).alias("a"))
    b = e.where("event_id % 11 <> 0").select("event_id", F.md5(F.when(c("event_id") % 13 == 0, F.concat("props", F.lit("x"))).otherwise(c("props")).cast("binary")).alias("b"))
    return a.join(b, "event_id", "left").select("event_id", F.when(c("b").isNull(), "missing_backfill").when(c("a") == c("b"), "match").otherwise("mismatch").alias("status"))


@query("SELECT o_orderkey, 'missing_fill' AS repair, 0 AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) UNION ALL SELECT l_orderkey, 'duplicate_fill', count(*) FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1")
def c10_repair_plan(spark, sf_dir):
    """Orders without fills and fills that repeat."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    fills = dealt(li.select("l_orderkey"), "l_orderkey")
    gone = table(spark, sf_dir, "orders").select("o_orderkey").repartition(fills.rdd.getNumPartitions(), "o_orderkey").join(fills, c("o_orderkey") == c("l_orderkey"), "left_anti").select("o_orderkey", F.lit("missing_fill").alias("repair"), F.lit(0).cast("bigint").alias("n"))
    twice = dealt(li, "l_orderkey", "l_suppkey").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1").select(c("l_orderkey").alias("o_orderkey"), F.lit("duplicate_fill").alias("repair"), "n")
    return gone.unionByName(twice)


@query("SELECT r_name AS cluster, round(sum(abs(w)), 4) + 0.0 AS gross, round(sum(w * beta), 4) + 0.0 AS beta_exposure, count(*) AS names FROM (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS w FROM lineitem GROUP BY 1) p JOIN (SELECT s_suppkey, s_nationkey, 1 + s_nationkey / 50 AS beta FROM supplier) s ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def c21_cluster_exposure(spark, sf_dir):
    """Positions summed before they meet the cluster and beta maps."""
    p = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(c("l_returnflag") == "R", -c("l_quantity")).otherwise(c("l_quantity"))).alias("w"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (1 + c("s_nationkey") / 50).alias("beta"))
    full = p.join(s, c("l_suppkey") == c("s_suppkey")).join(table(spark, sf_dir, "nation"), c("s_nationkey") == c("n_nationkey")).join(table(spark, sf_dir, "region"), c("n_regionkey") == c("r_regionkey"))
    return full.groupBy(c("r_name").alias("cluster")).agg(r(F.sum(F.abs("w")), 4).alias("gross"), r(F.sum(c("w") * c("beta")), 4).alias("beta_exposure"), F.count("*").alias("names"))


@query("SELECT s.user_id, k.t AS event_type, count(e.event_id) AS n, count(e.event_id) = 0 AS missing FROM (SELECT DISTINCT user_id FROM events) s CROSS JOIN (VALUES ('view'), ('purchase'), ('funding')) k(t) LEFT JOIN events e ON e.user_id = s.user_id AND e.event_type = k.t GROUP BY 1, 2")
def c23_required_streams(spark, sf_dir):
    """Required streams of each symbol, seen or not; a fixed list is exploded, nothing is crossed."""
    wanted = ("view", "purchase", "funding")
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count(F.when(c("event_type") == k, 1)).alias(k) for k in wanted])
    row = F.explode(F.array(*[F.struct(F.lit(k).alias("event_type"), c(k).alias("n")) for k in wanted])).alias("s")
    return n.select("user_id", row).select("user_id", "s.event_type", "s.n", (c("s.n") == 0).alias("missing"))


@query(over_candles("SELECT symbol, n, CASE WHEN n < 4 THEN 0 WHEN sr IS NULL OR sr <= 0 THEN 9999999 ELSE CAST(ceil(1 + greatest(0.0001, 1 + 0.5 * sr * sr - sk * sr + ku / 4 * sr * sr) * pow(1.6448536269514722 / sr, 2)) AS BIGINT) END AS bars FROM (SELECT symbol, count(*) AS n, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) END AS sr, coalesce(skewness(ret), 0) AS sk, coalesce(kurtosis(ret), 0) AS ku FROM rets GROUP BY symbol)", RET))
def d11_minimum_track_record(spark, sf_dir):
    """Bars until a Sharpe ratio above 0 can be believed at 95 %."""
    return with_returns(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), x.minimum_track_record("ret").alias("bars"))


SCENARIOS = "SELECT l_suppkey, l_returnflag || l_linestatus AS scenario, -avg(l_tax) * 6 AS drawdown, count(*) FILTER (l_quantity > 49) AS liquidations, max(l_discount) AS slippage, max(l_extendedprice) AS tail FROM lineitem GROUP BY 1, 2"


@query(f"SELECT l_suppkey, count(*) AS scenarios, round(avg(CASE WHEN drawdown > -0.25 AND liquidations = 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS pass_rate, max(slippage) AS slippage, max(tail) AS tail, CAST(max(liquidations) AS BIGINT) AS cascade, concat_ws(',', CASE WHEN bool_or(drawdown <= -0.25) THEN 'drawdown_kill_switch' END, CASE WHEN bool_or(liquidations > 0) THEN 'liquidation_events' END) AS reasons FROM ({SCENARIOS}) GROUP BY l_suppkey")
def d24_scenario_evaluation(spark, sf_dir):
    """Pass rate, worst stress metrics and failure reasons over scenarios.

    The drawdown is rounded to twelve places, so that one on its limit does not pass or fail by the order in which taxes are summed.
    """
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("scenario")).agg(F.round(-F.avg("l_tax") * 6, 12).alias("drawdown"), F.expr("count_if(l_quantity > 49)").alias("liquidations"), F.max("l_discount").alias("slippage"), F.max("l_extendedprice").alias("tail"))
    killed, liquidated = c("drawdown") <= -0.25, c("liquidations") > 0
    reasons = F.concat_ws(",", F.when(F.bool_or(killed), "drawdown_kill_switch"), F.when(F.bool_or(liquidated), "liquidation_events"))
    return s.groupBy("l_suppkey").agg(F.count("*").alias("scenarios"), r(F.avg(F.when(~killed & ~liquidated, 1.0).otherwise(0.0))).alias("pass_rate"), F.max("slippage").alias("slippage"), F.max("tail").alias("tail"), F.max("liquidations").alias("cascade"), reasons.alias("reasons"))


@query("SELECT user_id, event_type, arg_min(props, (ts, event_id)) AS confidence FROM events GROUP BY 1, 2")
def d30_first_confidence(spark, sf_dir):
    """The first value of each key stays."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("props", F.struct("ts", "event_id")).alias("confidence"))


@query("SELECT l_suppkey, count(*) AS n, round(0.4 * avg(l_discount * 100), 6) + 0.0 AS spread_bps, round(0.4 * avg(l_quantity), 6) + 0.0 AS latency_ms, round(0.6 * 1.0 + 0.4 * avg(least(1.0, l_quantity / 40)), 6) + 0.0 AS fill_probability FROM lineitem GROUP BY l_suppkey")
def d66_feedback_priors(spark, sf_dir):
    """Means shrunk towards the incumbent value."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_suppkey").agg(F.count("*").alias("n"), r(x.prior(c("l_discount") * 100, 0.0, 0.4)).alias("spread_bps"), r(x.prior(c("l_quantity"), 0.0, 0.4)).alias("latency_ms"), r(x.prior(F.least(F.lit(1.0), c("l_quantity") / 40), 1.0, 0.4)).alias("fill_probability"))


@query("SELECT props, count(*) AS n FROM events GROUP BY props ORDER BY n DESC, min(event_id) LIMIT 20")
def d70_ranked_counter(spark, sf_dir):
    """Most common first, ties in the order they were first seen."""
    return table(spark, sf_dir, "events").groupBy("props").agg(F.count("*").alias("n"), F.min("event_id").alias("first")).orderBy(F.desc("n"), "first").limit(20).select("props", "n")


@query("SELECT l_orderkey, count(*) AS trials, arg_max(l_partkey, (l_extendedprice, l_partkey)) AS best_part, min(l_quantity) AS worst_fill, count(*) FILTER (l_quantity < 10) AS pressured FROM lineitem GROUP BY l_orderkey")
def d77_trial_summary(spark, sf_dir):
    """Best trial, worst fill and pressured trials of each run."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("trials"), F.max_by("l_partkey", F.struct("l_extendedprice", "l_partkey")).alias("best_part"), F.min("l_quantity").alias("worst_fill"), F.expr("count_if(l_quantity < 10)").alias("pressured"))


@query("SELECT user_id, count(*) AS decisions, arg_max(event_type, (ts, event_id)) AS last_decision, arg_max(props, (value, event_id)) AS policy FROM events GROUP BY user_id")
def d75_decision_summary(spark, sf_dir):
    """Number, last and highest of each run's child rows in one pass."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("decisions"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_decision"), F.max_by("props", F.struct("value", "event_id")).alias("policy"))


@query("SELECT p_brand, p_size % 4 AS variant, count(*) AS runs, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS success_rate, round(avg(l_extendedprice), 4) + 0.0 AS mean_metric FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def d80_variant_history(spark, sf_dir):
    """How often and how well each variant did."""
    full = table(spark, sf_dir, "lineitem").select("l_partkey", "l_discount", "l_extendedprice").join(table(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey"))
    return full.groupBy("p_brand", (c("p_size") % 4).alias("variant")).agg(F.count("*").alias("runs"), r(F.avg(F.when(c("l_discount") > 0.05, 1.0).otherwise(0.0))).alias("success_rate"), r(F.avg("l_extendedprice"), 4).alias("mean_metric"))


@query("SELECT l_suppkey, concat_ws(',', CASE WHEN abs(avg(l_discount) - 0.05) > 0.002 THEN 'drift:discount' END, CASE WHEN abs(avg(l_quantity) - 25.5) > 1 THEN 'drift:quantity' END) AS warnings FROM lineitem GROUP BY l_suppkey")
def d83_learning_drift(spark, sf_dir):
    """Metrics beyond their threshold, by name; a metric without one never warns.

    Means are exact to the nearest double and compared as they are: of the doubles, 0.048 is more than 0.002 from 0.05, 0.052 is not.
    """
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((exact_mean("l_discount") - 0.05).alias("discount"), (exact_mean("l_quantity") - 25.5).alias("quantity"), F.avg("l_tax").alias("tax"))
    metrics = F.create_map(*[v for k in ("discount", "quantity", "tax") for v in (F.lit(k), c(k))])
    return m.select("l_suppkey", F.array_join(x.drift_warnings(metrics, {"discount": 0.002, "quantity": 1.0}, places=None), ",").alias("warnings"))


@query(over_candles("SELECT symbol, round(greatest(0.0, early - late), 6) + 0.0 AS decay, CASE WHEN greatest(0.0, early - late) > 0.1 THEN 'DISABLED' WHEN greatest(0.0, early - late) > 0 THEN 'DECAYING' ELSE 'BASELINE_PASSED' END AS state FROM (SELECT symbol, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (i < 30) AS early, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (i >= 30) AS late FROM rets GROUP BY symbol) WHERE late IS NOT NULL", RET))
def d85_forecast_drift(spark, sf_dir):
    """Directional accuracy now against before."""
    hit = F.when(c("ret") > 0, 1.0).otherwise(0.0)
    a = with_returns(spark, sf_dir).groupBy("symbol").agg(F.avg(F.when(c("i") < 30, hit)).alias("early"), F.avg(F.when(c("i") >= 30, hit)).alias("late")).where("late IS NOT NULL")
    decay = F.greatest(F.lit(0.0), c("early") - c("late"))
    return a.select("symbol", r(decay).alias("decay"), F.when(decay > 0.1, "DISABLED").when(decay > 0, "DECAYING").otherwise("BASELINE_PASSED").alias("state"))


@query("SELECT l_suppkey, count(*) AS artifacts, round(sum(share), 4) + 0.0 AS gross, round(sum(CASE WHEN o_orderstatus = 'F' THEN -share ELSE share END), 4) + 0.0 AS net FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) ON k = l_orderkey JOIN (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders) ON o_orderkey = l_orderkey, LATERAL (SELECT o_totalprice / n AS share) GROUP BY l_suppkey")
def d89_target_portfolio(spark, sf_dir):
    """Each artifact's notional dealt over its symbols, then gross and net by symbol."""
    scopes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("scope"))
    full = scopes.join(table(spark, sf_dir, "orders"), c("l_orderkey") == c("o_orderkey"))
    share = full.select(F.explode("scope").alias("l_suppkey"), (c("o_totalprice") / F.size("scope")).alias("share"), "o_orderstatus")
    return share.groupBy("l_suppkey").agg(F.count("*").alias("artifacts"), r(F.sum("share"), 4).alias("gross"), r(F.sum(F.when(c("o_orderstatus") == "F", -c("share")).otherwise(c("share"))), 4).alias("net"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' ORDER BY CASE WHEN l_quantity >= 10 THEN l_quantity END ASC NULLS LAST, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 30")
def f01_worst_fill_first(spark, sf_dir):
    """a report's sort modes; what has no metric comes last in both directions."""
    fill = F.when(c("l_quantity") >= 10, c("l_quantity"))
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").orderBy(fill.asc_nulls_last(), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(30).select(*LINE)


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <= 2 AND l_extendedprice <= 20000 THEN 't1' WHEN l_linenumber <= 4 AND l_extendedprice <= 50000 THEN 't2' ELSE 't3' END AS tier FROM lineitem")
def f20_leverage_tiers(spark, sf_dir):
    """the first tier whose leverage and notional both hold, else the last."""
    tiers = [{"name": "t2", "max_leverage": 4.0, "max_notional": 50000.0}, {"name": "t1", "max_leverage": 2.0, "max_notional": 20000.0}, {"name": "t3", "max_leverage": 7.0, "max_notional": 1e5}]
    return table(spark, sf_dir, "lineitem").select(*LINE, x.tier_entry(c("l_linenumber"), c("l_extendedprice"), tiers)["name"].alias("tier"))


@query("WITH a AS (SELECT l_suppkey, l_linenumber, avg(l_discount) > 0.05 AS ok FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), b AS (SELECT l_suppkey, l_linenumber, avg(l_discount) > 0.05 AS ok FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) SELECT l_suppkey, l_linenumber FROM a JOIN b USING (l_suppkey, l_linenumber) WHERE a.ok AND NOT b.ok")
def g06_gate_regressions(spark, sf_dir):
    """Gates that the reference passes and the candidate fails.

    Many means are 0.05 but for the rounding of their sums; they are added up in
    the order of the table, as its SQL does on one thread.
    """
    keys, place = ["l_suppkey", "l_linenumber", "l_returnflag"], ["_metadata.file_path", "_metadata.row_index"]
    li = table(spark, sf_dir, "lineitem").where(c("l_returnflag").isin("A", "R") & c("l_suppkey").isNotNull() & c("l_linenumber").isNotNull())
    whole = W.partitionBy(*keys).orderBy("file_path", "row_index").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = li.select(*keys, "l_discount", *place).withColumn("total", F.sum("l_discount").over(whole))
    passed = total.groupBy(*keys).agg((F.max("total") / F.count("l_discount") > 0.05).alias("ok"))
    sides = passed.groupBy("l_suppkey", "l_linenumber").agg(F.bool_or((c("l_returnflag") == "A") & c("ok")).alias("a"), F.bool_or((c("l_returnflag") == "R") & ~c("ok")).alias("b"))
    return sides.where("a AND b").select("l_suppkey", "l_linenumber")


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FILTER (o_orderpriority IN ('1-URGENT', '3-MEDIUM')) AS common FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderpriority IN ('1-URGENT', '3-MEDIUM')) > 0")
def g05_common_scenarios(spark, sf_dir):
    """Names that two lists share."""
    mine = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("names"))
    common = F.array_sort(F.array_intersect("names", F.array(F.lit("1-URGENT"), F.lit("3-MEDIUM"))))
    return mine.select("o_custkey", common.alias("c")).where(F.size("c") > 0).select("o_custkey", F.array_join("c", ",").alias("common"))


@query("SELECT user_id, event_type, max(n) AS n FROM (SELECT user_id, event_type, date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2")
def g07_merged_counts(spark, sf_dir):
    """Evidence counts of several reports merged by their maximum."""
    day = table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.date_trunc("day", "ts")).agg(F.count("*").alias("n"))
    return day.groupBy("user_id", "event_type").agg(F.max("n").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(price, 4) + 0.0 AS rounded_price, quantity, CASE WHEN quantity * price / 60000 > 0.9 THEN 'rejected' WHEN quantity * price > 30000 THEN 'partial_fill' ELSE 'filled' END AS status, round(CASE WHEN quantity * price / 60000 > 0.9 THEN 0 ELSE least(1.0, 30000 / greatest(quantity * price, 1e-9)) END, 6) + 0.0 AS fill_ratio FROM (SELECT *, round_even(l_extendedprice / l_quantity / 0.5, 0) * 0.5 AS price, floor(l_quantity / 5) * 5 AS quantity FROM lineitem)")
def h15_order_execution(spark, sf_dir):
    """Tick and step rounding, capacity, fill ratio from the local depth."""
    price, quantity = F.bround(c("l_extendedprice") / c("l_quantity") / 0.5) * 0.5, F.floor(c("l_quantity") / 5) * 5.0
    o = table(spark, sf_dir, "lineitem").select(*LINE, price.alias("p"), quantity.alias("quantity"))
    notional = c("quantity") * c("p")
    rejected = notional / 60000 > 0.9
    fill = F.when(rejected, 0.0).otherwise(F.least(F.lit(1.0), 30000 / F.greatest(notional, F.lit(1e-9))))
    return o.select(*LINE, r("p", 4).alias("rounded_price"), "quantity", F.when(rejected, "rejected").when(notional > 30000, "partial_fill").otherwise("filled").alias("status"), r(fill).alias("fill_ratio"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(slip, 6) + 0.0 AS slip_bps, CASE WHEN ms < 50 THEN 'lt_50ms' WHEN ms < 250 THEN '50ms_250ms' WHEN ms < 1000 THEN '250ms_1s' ELSE 'gte_1s' END AS latency, round(CASE WHEN slip > 0 THEN abs(live - l_extendedprice) * l_quantity ELSE 0 END, 4) + 0.0 AS opportunity_loss, round(least(1.0, l_extendedprice / greatest(abs(live - 30000), 1.0)), 6) + 0.0 AS absorption FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN l_extendedprice - live ELSE live - l_extendedprice END / l_extendedprice * 10000 AS slip FROM (SELECT *, l_extendedprice * (1 + l_discount - l_tax) AS live, l_quantity * l_quantity AS ms FROM lineitem))")
def h22_fill_quality(spark, sf_dir):
    """Side-aware slippage, latency class, loss of what did not fill, absorption."""
    li = table(spark, sf_dir, "lineitem").withColumns({"live": c("l_extendedprice") * (1 + c("l_discount") - c("l_tax")), "side": F.when(c("l_returnflag") == "R", "SELL").otherwise("BUY")})
    slip = x.side_bps(c("side"), c("l_extendedprice"), c("live"))
    return li.select(*LINE, r(slip).alias("slip_bps"), x.latency_class(c("l_quantity") * c("l_quantity")).alias("latency"), r(x.opportunity_loss(c("side"), c("l_extendedprice"), c("live"), c("l_quantity")), 4).alias("opportunity_loss"), r(x.absorption(c("live") - 30000, c("l_extendedprice"))).alias("absorption"))


@query(over_candles("SELECT symbol, i, CASE WHEN funding >= 0.01 THEN 'positive_extreme' WHEN funding >= 0.001 THEN 'positive' WHEN funding <= -0.01 THEN 'negative_extreme' WHEN funding <= -0.001 THEN 'negative' ELSE 'flat' END AS funding_state, CASE WHEN abs(funding) >= 0.04 THEN 'high' WHEN abs(funding) >= 0.015 THEN 'medium' ELSE 'low' END AS vol_state, CASE WHEN d >= 0.15 THEN 'rising_fast' WHEN d >= 0.03 THEN 'rising' WHEN d <= -0.15 THEN 'falling_fast' WHEN d <= -0.03 THEN 'falling' ELSE 'flat' END AS oi_state FROM (SELECT *, oi / lag(oi) OVER (PARTITION BY symbol ORDER BY i) - 1 AS d FROM candles)"))
def h32_state_buckets(spark, sf_dir):
    """Funding, volatility and open interest as states."""
    d = c("oi") / F.lag("oi").over(by_symbol()) - 1
    return candles(spark, sf_dir).withColumn("d", d).select("symbol", "i", x.funding_state("funding").alias("funding_state"), x.volatility_state(F.abs("funding")).alias("vol_state"), x.open_interest_state("d").alias("oi_state"))


@query("SELECT p_partkey, CASE WHEN t LIKE '%USDT' THEN 'USDT' WHEN t LIKE '%USDC' THEN 'USDC' WHEN t LIKE '%USD' THEN 'USD' WHEN t LIKE '%BTC' THEN 'BTC' WHEN t LIKE '%ETH' THEN 'ETH' END AS quote, CASE WHEN t LIKE '%/%' THEN split_part(t, '/', 1) || 'USDT' ELSE t END AS venue_symbol FROM (SELECT p_partkey, upper(trim(' ' || replace(p_brand, '#', '') || CASE p_size % 6 WHEN 0 THEN 'usdt' WHEN 1 THEN '/usdc' WHEN 2 THEN 'usd' WHEN 3 THEN 'btc' WHEN 4 THEN 'eth ' ELSE '/usd:usd' END)) AS t FROM part)")
def h36_symbol_quotes(spark, sf_dir):
    """Quote currency and the venue's spelling of a symbol."""
    k = c("p_size") % 6
    tail = F.when(k == 0, "usdt").when(k == 1, "/usdc").when(k == 2, "usd").when(k == 3, "btc").when(k == 4, "eth ").otherwise("/usd:usd")
    s = F.concat(F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit("")), tail)
    return table(spark, sf_dir, "part").select("p_partkey", x.quote_currency(s).alias("quote"), x.venue_symbol(s).alias("venue_symbol"))


@query("SELECT event_type, count(*) AS n, round(greatest(0.0, 1 - (count(*) FILTER (value < 1) + count(*) FILTER (json_extract_string(props, '$.k') IS NULL) + 0.5 * count(*) FILTER (value > 150)) / count(*)), 6) + 0.0 AS quality FROM events GROUP BY event_type")
def j09_telemetry_quality(spark, sf_dir):
    """One minus penalties over events."""
    bad = F.expr("count_if(value < 1) + count_if(get_json_object(props, '$.k') IS NULL) + 0.5D * count_if(value > 150)")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), r(F.greatest(F.lit(0.0), 1 - bad / F.count("*"))).alias("quality"))


@query("SELECT event_id, 'ORDER_TRADE_UPDATE' AS kind, user_id AS account, CASE WHEN event_type = 'purchase' THEN 'FILLED' WHEN event_type = 'error' THEN 'REJECTED' ELSE 'NEW' END AS status, ts AS event_at FROM events")
def j14_user_stream(spark, sf_dir):
    """Telemetry rows as user-stream events."""
    status = F.when(c("event_type") == "purchase", "FILLED").when(c("event_type") == "error", "REJECTED").otherwise("NEW")
    return table(spark, sf_dir, "events").select("event_id", F.lit("ORDER_TRADE_UPDATE").alias("kind"), c("user_id").alias("account"), status.alias("status"), c("ts").alias("event_at"))


@query("SELECT event_id, user_id, exposure, CASE WHEN exposure > 500 THEN 'blocked' ELSE 'accepted' END AS decision FROM (SELECT event_id, user_id, round(sum(value * CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) + 0.0 AS exposure FROM events)")
def j15_daemon_dry_run(spark, sf_dir):
    """Running exposure of each symbol over its intents."""
    signed = c("value") * F.when(c("event_type") == "error", -1).otherwise(1)
    run = r(F.sum(signed).over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)), 4)
    return table(spark, sf_dir, "events").select("event_id", "user_id", run.alias("exposure")).withColumn("decision", F.when(c("exposure") > 500, "blocked").otherwise("accepted"))
