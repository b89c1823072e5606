"""Queries of gates, guards, validators, registers and reports, on the shared tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import gates as g
from tidemark.functions.columns import c, clamp, r
from tidemark.operators import rules as q
from tidemark.plans.registry import over_candles, query
from tidemark.plans.series import REGIMES, RET, labelled, with_returns
from tidemark.sources.tables import candles, table

@query("""WITH days AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS loss, sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END) AS gain FROM lineitem GROUP BY 1, 2),
walk AS (SELECT *, sum(loss) OVER (PARTITION BY l_suppkey ORDER BY d RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS week, sum(gain) OVER (PARTITION BY l_suppkey ORDER BY d) AS equity FROM days),
worst AS (SELECT l_suppkey, round(max(loss), 2) + 0.0 AS daily_loss, round(max(week), 2) + 0.0 AS weekly_loss, round(max(peak - equity), 2) + 0.0 AS drawdown FROM (SELECT *, greatest(max(equity) OVER (PARTITION BY l_suppkey ORDER BY d), 0) AS peak FROM walk) GROUP BY l_suppkey)
SELECT *, daily_loss <= 90000 AND weekly_loss <= 150000 AND drawdown <= 200000 AS passed, concat_ws(',', CASE WHEN daily_loss > 90000 THEN 'daily_loss_breaker' END, CASE WHEN weekly_loss > 150000 THEN 'weekly_loss_breaker' END, CASE WHEN drawdown > 200000 THEN 'drawdown_breaker' END) AS rejections FROM worst""")
def b30_circuit_breakers(spark, sf_dir):
    """Worst day, worst seven days and drawdown of each supplier against the limits."""
    returned = c("l_returnflag") == "R"
    day = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.unix_date(c("l_shipdate").cast("date")).alias("d")).agg(F.sum(F.when(returned, c("l_extendedprice")).otherwise(0.0)).alias("loss"), F.sum(F.when(returned, -c("l_extendedprice")).otherwise(c("l_extendedprice"))).alias("gain"))
    by = W.partitionBy("l_suppkey").orderBy("d")
    walk = day.withColumns({"week": F.sum("loss").over(by.rangeBetween(-6, 0)), "equity": F.sum("gain").over(by.rowsBetween(W.unboundedPreceding, 0))})
    peak = F.greatest(F.max("equity").over(by.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))
    worst = walk.withColumn("down", peak - c("equity")).groupBy("l_suppkey").agg(r(F.max("loss"), 2).alias("daily_loss"), r(F.max("week"), 2).alias("weekly_loss"), r(F.max("down"), 2).alias("drawdown"))
    rules = g.circuit_breakers(90_000.0, 150_000.0, 200_000.0)
    return worst.withColumns({"passed": q.count_broken(rules) == 0, "rejections": q.all_broken(rules)})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_totalprice > 499000) AND o_orderstatus = 'O'")
def b41_allow_list(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    allowed = o.where("o_totalprice > 499000").select("o_orderpriority").distinct()
    return o.where("o_orderstatus = 'O'").join(allowed, "o_orderpriority", "left_semi").select("o_orderkey", "o_totalprice")


@query("WITH exact AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 1e9), near AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 499500) SELECT o_orderkey FROM exact UNION ALL SELECT o_orderkey FROM near WHERE NOT EXISTS (SELECT 1 FROM exact)")
def b26_fallback_filter(spark, sf_dir):
    """The strictest filter that leaves anything: decided by one aggregate, not by two jobs."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(c("o_totalprice") > 1e9, 0).when(c("o_totalprice") > 499500, 1).alias("tier")).where("tier IS NOT NULL")
    best = o.agg(F.min("tier").alias("best"))
    return o.join(F.broadcast(best), c("tier") == c("best")).select("o_orderkey")


@query("SELECT l_suppkey, round((greatest(0.0, least(1.0, avg(l_discount) * 10)) + greatest(0.0, least(1.0, 1 - avg(l_tax) * 10)) + greatest(0.0, least(1.0, count(*) / 100.0))) / 3, 6) + 0.0 AS score FROM lineitem GROUP BY l_suppkey")
def d38_governance_score(spark, sf_dir):
    """Mean of clamped components."""
    parts = [clamp(F.avg("l_discount") * 10, 0.0, 1.0), clamp(1 - F.avg("l_tax") * 10, 0.0, 1.0), clamp(F.count("*") / 100.0, 0.0, 1.0)]
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(r(sum(parts[1:], parts[0]) / 3).alias("score"))


@query("SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def d50_capture_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT l_suppkey, net, round(last_price, 2) + 0.0 AS last_price, round(net * last_price, 2) + 0.0 AS notional FROM (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS net, max_by(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS last_price FROM lineitem GROUP BY 1)")
def d53_position_section(spark, sf_dir):
    last = F.max_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    p = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(c("l_returnflag") == "R", -c("l_quantity")).otherwise(c("l_quantity"))).alias("net"), last.alias("last_price"))
    return p.select("l_suppkey", "net", r("last_price", 2).alias("last_price"), r(c("net") * c("last_price"), 2).alias("notional"))


@query("SELECT event_type, event_id, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE k <= 5")
def d54_risk_tail(spark, sf_dir):
    """Counts by reason with the last five; Spark keeps five a task before the shuffle (window group limit)."""
    ev = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    last = ev.withColumn("k", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))).where("k <= 5")
    n = ev.groupBy("event_type").agg(F.count("*").alias("n"))
    return last.join(F.broadcast(n), "event_type").select("event_type", "event_id", "n")


@query("SELECT symbol, failures + weak AS score FROM (SELECT user_id AS symbol, count(*) FILTER (event_type = 'error') * 2 AS failures, count(*) FILTER (value < 2) AS weak FROM events GROUP BY 1) WHERE failures + weak > 3 ORDER BY score DESC, symbol LIMIT 20")
def d56_weak_artifacts(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy(c("user_id").alias("symbol")).agg((F.expr("count_if(event_type = 'error')") * 2 + F.expr("count_if(value < 2)")).alias("score"))
    return s.where("score > 3").orderBy(F.desc("score"), "symbol").limit(20)


@query(over_candles("SELECT g.regime, count(*) AS bars, round(avg(t.ret), 6) + 0.0 AS mean_ret, round(sum(CASE WHEN t.ret > 0 THEN 1 ELSE 0 END) / count(*), 6) + 0.0 AS hit_rate FROM regimes g JOIN rets t USING (symbol, i) GROUP BY g.regime", REGIMES, RET))
def d57_regime_performance(spark, sf_dir):
    from tidemark.operators.windows import lag_return

    x = labelled(spark, sf_dir).withColumn("ret", lag_return())
    return x.groupBy("regime").agg(F.count("*").alias("bars"), r(F.avg("ret")).alias("mean_ret"), r(F.avg(F.when(c("ret") > 0, 1.0).otherwise(0.0))).alias("hit_rate"))


@query("SELECT user_id % 10 AS shard, event_type, CAST(day(ts) % 4 AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1, 2, 3")
def d63_bucket_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((c("user_id") % 10).alias("shard"), "event_type", (F.day("ts") % 4).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, abs(net) > 400 AS net_breach, gross > 30000000 AS gross_breach, names > 500 AS crowding_breach FROM (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS net, sum(l_extendedprice) AS gross, count(DISTINCT l_partkey) AS names FROM lineitem GROUP BY 1)")
def d88_risk_budget(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(c("l_returnflag") == "R", -c("l_quantity")).otherwise(c("l_quantity"))).alias("net"), F.sum("l_extendedprice").alias("gross"), F.countDistinct("l_partkey").alias("names"))
    return g.select("l_suppkey", (F.abs("net") > 400).alias("net_breach"), (c("gross") > 3e7).alias("gross_breach"), (c("names") > 500).alias("crowding_breach"))


@query("SELECT event_id, k FROM (SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE k % 10 = 3 ORDER BY ts DESC, event_id LIMIT 50")
def f05_json_filter_then_limit(spark, sf_dir):
    """The filter on JSON holds before the limit."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.from_json("props", "k int")["k"].alias("k"))
    return e.where("k % 10 = 3").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "k")


@query("SELECT n_nationkey, c_custkey FROM (SELECT c_nationkey AS n_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k = 1")
def f15_role_crowding(spark, sf_dir):
    best = F.max_by("c_custkey", F.struct(c("c_acctbal"), -c("c_custkey")))
    return table(spark, sf_dir, "customer").groupBy(c("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(best.alias("c_custkey")).select("n_nationkey", "c_custkey")


@query("SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def f16_json_keyed_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.from_json("props", "k int")["k"].alias("k")).dropDuplicates(["user_id", "k"])


@query("SELECT o_orderkey, CASE WHEN days > 900 THEN 'scheduled' WHEN drift > 150 THEN 'drift' WHEN o_orderstatus = 'P' THEN 'lifecycle' ELSE 'none' END AS trigger FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS days, o_totalprice / 2500 AS drift FROM orders)")
def h48_rebalance_triggers(spark, sf_dir):
    days, drift = F.date_diff(F.lit("2001-12-31").cast("date"), c("o_orderdate").cast("date")), c("o_totalprice") / 2500
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(days > 900, "scheduled").when(drift > 150, "drift").when(c("o_orderstatus") == "P", "lifecycle").otherwise("none").alias("trigger"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def i29_idempotency_register(spark, sf_dir):
    first = F.min_by("event_id", F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.date_trunc("day", "ts")).agg(first.alias("event_id")).select("event_id", "user_id")


@query("SELECT event_type, user_id, CASE WHEN max(ts) IS NULL THEN 'silent' WHEN max(ts) < (SELECT max(ts) FROM events) - INTERVAL 3 DAY THEN 'stale' ELSE 'live' END AS state FROM events GROUP BY 1, 2")
def j12_stream_staleness(spark, sf_dir):
    """One pass: the end of the session is the maximum of the streams' own last times."""
    last = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.max("ts").alias("last"))
    end = last.agg(F.max("last").alias("end"))
    return last.crossJoin(F.broadcast(end)).select("event_type", "user_id", F.when(c("last") < c("end") - F.expr("INTERVAL 3 DAYS"), "stale").otherwise("live").alias("state"))


@query(over_candles("SELECT symbol, i, round(ln(close / prev), 6) + 0.0 AS log_ret FROM (SELECT symbol, i, close, lag(close) OVER (PARTITION BY symbol ORDER BY i) AS prev FROM candles WHERE close > 1) WHERE prev IS NOT NULL"))
def l25_log_returns(spark, sf_dir):
    """Bars are filtered before they are paired."""
    prev = F.lag("close").over(W.partitionBy("symbol").orderBy("i"))
    return candles(spark, sf_dir).where("close > 1").withColumn("prev", prev).where("prev IS NOT NULL").select("symbol", "i", r(F.log(c("close") / c("prev"))).alias("log_ret"))


@query(over_candles("SELECT symbol, round(avg(ret) FILTER (crossings > 0) - avg(ret) FILTER (crossings = 0), 6) + 0.0 AS delta FROM (SELECT *, coalesce(floor(epoch(ts) / 28800) - lag(floor(epoch(ts) / 28800)) OVER (PARTITION BY symbol ORDER BY i), 0) AS crossings FROM rets) GROUP BY symbol", RET))
def l53_funding_window_delta(spark, sf_dir):
    from tidemark.operators.windows import funding_crossings

    x = with_returns(spark, sf_dir).withColumn("crossings", funding_crossings())
    return x.groupBy("symbol").agg(r(F.avg(F.when(c("crossings") > 0, c("ret"))) - F.avg(F.when(c("crossings") == 0, c("ret")))).alias("delta"))


@query("SELECT c_custkey, date_diff('day', CAST(last AS DATE), DATE '2001-12-31') AS age, CASE WHEN last IS NULL THEN 'never' WHEN date_diff('day', CAST(last AS DATE), DATE '2001-12-31') > 400 THEN 'expired' ELSE 'valid' END AS state FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def l71_revalidation(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    age = F.date_diff(F.lit("2001-12-31").cast("date"), c("last").cast("date")).cast("bigint")
    return table(spark, sf_dir, "customer").join(last, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", age.alias("age"), F.when(c("last").isNull(), "never").when(age > 400, "expired").otherwise("valid").alias("state"))


@query("SELECT user_id, k, (ordinal - 1)::INTEGER AS ordinal, tag FROM (SELECT user_id, k, unnest(tags) AS tag, generate_subscripts(tags, 1) AS ordinal FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, string_split(event_type || '/' || CASE WHEN value > 50 THEN 'large' ELSE 'small' END, '/') AS tags FROM events))")
def l96_exploded_trials(spark, sf_dir):
    """Nested phases as rows, the ordinal being their position."""
    tags = F.split(F.concat_ws("/", "event_type", F.when(c("value") > 50, "large").otherwise("small")), "/")
    e = table(spark, sf_dir, "events").select("user_id", F.from_json("props", "k int")["k"].alias("k"), F.posexplode(tags).alias("ordinal", "tag"))
    return e.select("user_id", "k", "ordinal", "tag")


@query("SELECT props, arg_min(event_id, event_id) AS first_seen, arg_max(event_id, event_id) AS last_seen, count(DISTINCT user_id) AS usage_count, arg_max(event_type, event_id) AS latest_type FROM events GROUP BY props")
def l99_first_and_last_seen(spark, sf_dir):
    """The first run stays, the last is overwritten, usage is counted anew."""
    return table(spark, sf_dir, "events").groupBy("props").agg(F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"), F.countDistinct("user_id").alias("usage_count"), F.max_by("event_type", "event_id").alias("latest_type"))


@query("SELECT l_suppkey, round(verdict, 6) + 0.0 AS strength, CASE WHEN verdict > 0.02 THEN 'better' WHEN verdict < -0.02 THEN 'worse' ELSE 'flat' END AS direction FROM (SELECT l_suppkey, 0.6 * (avg(l_discount) FILTER (l_linenumber > 3) / avg(l_discount) FILTER (l_linenumber <= 3) - 1) - 0.4 * (avg(l_tax) FILTER (l_linenumber > 3) / avg(l_tax) FILTER (l_linenumber <= 3) - 1) AS verdict FROM lineitem GROUP BY 1)")
def l100_selection_driver(spark, sf_dir):
    late = c("l_linenumber") > 3
    change = lambda x: F.avg(F.when(late, c(x))) / F.avg(F.when(~late, c(x))) - 1
    v = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((0.6 * change("l_discount") - 0.4 * change("l_tax")).alias("v"))
    return v.select("l_suppkey", r("v").alias("strength"), F.when(c("v") > 0.02, "better").when(c("v") < -0.02, "worse").otherwise("flat").alias("direction"))


@query("SELECT c_nationkey, c_mktsegment, count(*) FILTER (c_acctbal > 0) > 0 AS passed, min(c_acctbal) AS worst FROM customer GROUP BY 1, 2 HAVING count(*) >= 5")
def d91_min_sample_gate(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), (F.expr("count_if(c_acctbal > 0)") > 0).alias("passed"), F.min("c_acctbal").alias("worst")).where("n >= 5").drop("n")
