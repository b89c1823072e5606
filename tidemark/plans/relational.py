"""Queries of the relational families: predicates, joins, sorting, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import c, r
from tidemark.operators import joins as j
from tidemark.operators import windows as w
from tidemark.plans.registry import over_candles, query
from tidemark.sources.tables import candles, table


@query(over_candles("SELECT symbol, count(*) AS rows, count(*) FILTER (open <= 0 OR close <= 0 OR high < low OR high < greatest(open, close) OR low > least(open, close)) AS bad, count(*) FILTER (open = high AND trade_count > 1) AS suspicious FROM candles GROUP BY symbol"))
def b08_ohlc_sanity(spark, sf_dir):
    bad = "open <= 0 OR close <= 0 OR high < low OR high < greatest(open, close) OR low > least(open, close)"
    return candles(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("rows"), F.expr(f"count_if({bad})").alias("bad"), F.expr("count_if(open = high AND trade_count > 1)").alias("suspicious"))


@query(over_candles("""SELECT symbol, gaps, dups, negatives, round(greatest(0.0, 1 - (gaps + dups + negatives) / rows), 6) + 0.0 AS score FROM (
  SELECT symbol, count(*) AS rows, count(*) FILTER (step > 3600) AS gaps, count(*) FILTER (step = 0) AS dups, count(*) FILTER (volume < 0 OR oi < 0 OR liq < 0) AS negatives
  FROM (SELECT *, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY symbol ORDER BY i) AS step FROM candles) GROUP BY symbol)"""))
def b09_bundle_quality(spark, sf_dir):
    s = F.unix_seconds(c("ts").cast("timestamp"))
    step = s - F.lag(s).over(W.partitionBy("symbol").orderBy("i"))
    agg = candles(spark, sf_dir).withColumn("step", step).groupBy("symbol").agg(F.count("*").alias("rows"), F.expr("count_if(step > 3600)").alias("gaps"), F.expr("count_if(step = 0)").alias("dups"), F.expr("count_if(volume < 0 OR oi < 0 OR liq < 0)").alias("negatives"))
    return agg.select("symbol", "gaps", "dups", "negatives", r(F.greatest(F.lit(0.0), 1 - (c("gaps") + c("dups") + c("negatives")) / c("rows"))).alias("score"))


@query("SELECT o_orderkey, list_filter([CASE WHEN o_totalprice < 1000 THEN 'small' END, CASE WHEN o_orderstatus = 'P' THEN 'partial' END, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000 THEN 'urgent_large' END], lambda x: x IS NOT NULL)::VARCHAR AS issues FROM orders")
def b12_contract_issues(spark, sf_dir):
    rules = [("o_totalprice < 1000", "small"), ("o_orderstatus = 'P'", "partial"), ("o_orderpriority = '1-URGENT' AND o_totalprice > 400000", "urgent_large")]
    issues = F.array_compact(F.array(*[F.when(F.expr(p), n) for p, n in rules]))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("["), F.array_join(issues, ", "), F.lit("]")).alias("issues"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(date_diff('day', o_orderdate, l_shipdate) AS INTEGER) AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def b13_point_in_time_violations(spark, sf_dir):
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), c("l_orderkey") == c("o_orderkey"))
    return both.where("l_shipdate < o_orderdate").select("l_orderkey", "l_linenumber", "l_partkey", F.date_diff(c("l_shipdate").cast("date"), c("o_orderdate").cast("date")).alias("age"))


@query("SELECT user_id, max(ts) AS last_seen, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR AS stale FROM events GROUP BY user_id")
def b15_symbol_staleness(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    end = last.agg(F.max("last_seen").alias("end"))
    return last.crossJoin(F.broadcast(end)).select("user_id", "last_seen", (c("last_seen") < c("end") - F.expr("INTERVAL 12 HOURS")).alias("stale"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_totalprice >= 300000")
def b24_predicate_builder(spark, sf_dir):
    wanted = {"o_orderstatus": ("=", "F"), "o_orderpriority": ("=", "2-HIGH"), "o_totalprice": (">=", 300000)}
    test = {"=": lambda a, b: a == b, ">=": lambda a, b: a >= b}
    return table(spark, sf_dir, "orders").where(reduce(lambda a, b: a & b, [test[op](c(k), F.lit(v)) for k, (op, v) in wanted.items()])).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT event_id, user_id, exposure, CASE WHEN dup THEN 'duplicate' WHEN exposure > 800 THEN 'exposure' WHEN value < 1 THEN 'too_small' END AS block FROM (
  SELECT *, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS exposure, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) > 1 AS dup FROM events)""")
def b28_risk_blocks(spark, sf_dir):
    run = F.sum("value").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    dup = F.row_number().over(W.partitionBy("user_id", "event_type", "props").orderBy("ts", "event_id")) > 1
    df = table(spark, sf_dir, "events").withColumns({"exposure": r(run), "dup": dup})
    return df.select("event_id", "user_id", "exposure", F.when(c("dup"), "duplicate").when(c("exposure") > 800, "exposure").when(c("value") < 1, "too_small").alias("block"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE 'a%' OR p_brand ILIKE '%1' THEN 'majors' ELSE 'alts' END AS cluster, CASE WHEN p_size <= 10 THEN 'core' WHEN p_size <= 30 THEN 'satellite' ELSE 'watch' END AS ring FROM part")
def b42_rings_and_clusters(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.when(c("p_name").startswith("a") | c("p_brand").ilike("%1"), "majors").otherwise("alts").alias("cluster"), F.when(c("p_size") <= 10, "core").when(c("p_size") <= 30, "satellite").otherwise("watch").alias("ring"))


@query(over_candles("SELECT c.symbol, c.i, coalesce(f.v, 0.0) AS funding, coalesce(l.v, 0.0) AS liq FROM candles c LEFT JOIN (SELECT symbol, ts, round(max(value), 6) AS v FROM (SELECT user_id AS symbol, date_trunc('hour', ts) AS ts, value FROM events WHERE event_type = 'click') GROUP BY 1, 2) f USING (symbol, ts) LEFT JOIN (SELECT user_id AS symbol, date_trunc('hour', ts) AS ts, round(sum(value), 6) AS v FROM events WHERE event_type = 'error' GROUP BY 1, 2) l USING (symbol, ts)"))
def c01_exact_sidecar_join(spark, sf_dir):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    ev = table(spark, sf_dir, "events")
    side = lambda kind, agg, name: ev.where(c("event_type") == kind).groupBy(c("user_id").alias("symbol"), hour).agg(r(agg("value")).alias(name))
    base = candles(spark, sf_dir).select("symbol", "i", "ts")
    return base.join(side("click", F.max, "funding"), ["symbol", "ts"], "left").join(side("error", F.sum, "liq"), ["symbol", "ts"], "left").na.fill(0.0, ["funding", "liq"]).select("symbol", "i", "funding", "liq")


ASOF = "FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max_by(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts"


@query(f"SELECT e.event_id, coalesce(p.value, 0.0) AS last_purchase, p.ts AS matched_at {ASOF}")
def c02_asof_join(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    right = ev.where("event_type = 'purchase'").select("user_id", "ts", c("value").alias("last_purchase"), "event_id")
    out = j.asof_join(ev.select("user_id", "ts", "event_id"), right, by=["user_id"], on="ts", values=["last_purchase"], tie="event_id")
    return out.select("event_id", F.coalesce("last_purchase", F.lit(0.0)).alias("last_purchase"), "matched_at")


@query(f"SELECT e.event_id, CASE WHEN p.ts IS NULL THEN 'missing' WHEN e.ts - p.ts <= INTERVAL 6 HOUR THEN 'fresh' ELSE 'expired' END AS state {ASOF}")
def c04_ttl_asof_join(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    out = j.asof_join(ev.select("user_id", "ts", "event_id"), ev.where("event_type = 'purchase'").select("user_id", "ts", "value"), by=["user_id"], on="ts", values=["value"])
    return out.select("event_id", F.when(c("matched_at").isNull(), "missing").when(c("ts") - c("matched_at") <= F.expr("INTERVAL 6 HOURS"), "fresh").otherwise("expired").alias("state"))


@query("""WITH e AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase'), w AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM e)
SELECT w.user_id, w.ts, count(*) AS n, round(sum(t.value), 6) + 0.0 AS total FROM w JOIN events t ON t.user_id = w.user_id AND t.event_type <> 'purchase' AND t.ts <= w.ts AND (w.prev IS NULL OR t.ts > w.prev) GROUP BY w.user_id, w.ts""")
def c05_interval_join(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    edges = ev.where("event_type = 'purchase'").select("user_id", "ts").distinct()
    return j.interval_aggregate(edges, ev.where("event_type <> 'purchase'"), by=["user_id"], on="ts", aggregates=[F.count("*").alias("n"), r(F.sum("value")).alias("total")])


@query(over_candles("""SELECT symbol, i FROM (SELECT symbol, i, i AS s, i + 3 AS e FROM candles WHERE i % 7 <> 0) a WHERE NOT EXISTS (SELECT 1 FROM candles b WHERE b.symbol = a.symbol AND b.i % 21 = 0 AND a.s < b.i + 3 + 2 AND b.i < a.e)"""))
def c06_purged_training_rows(spark, sf_dir):
    labels = candles(spark, sf_dir).select("symbol", "i", c("i").alias("s"), (c("i") + 3).alias("e"))
    return j.purge(labels.where("i % 7 <> 0"), labels.where("i % 21 = 0"), by="symbol", start="s", end="e", embargo=2).select("symbol", "i")


@query("""WITH a AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1), b AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber >= 2 AND l_suppkey % 5 <> 0 GROUP BY 1)
SELECT l_suppkey, a.q AS left_q, b.q AS right_q, CASE WHEN a.q IS NULL THEN 'missing_left' WHEN b.q IS NULL THEN 'missing_right' WHEN abs(a.q - b.q) <= 1e-9 THEN 'match' ELSE 'mismatch' END AS status FROM a FULL OUTER JOIN b USING (l_suppkey)""")
def c09_reconciliation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    side = lambda p: li.where(p).groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return j.reconcile(side("l_linenumber <= 4"), side("l_linenumber >= 2 AND l_suppkey % 5 <> 0"), keys=["l_suppkey"], values=["q"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def c11_orphans(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 250000")
def c12_run_dimension_joins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 250000")
    return orders.join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey"), "left").join(table(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, count(o_orderkey) AS n_links, count(DISTINCT o_orderstatus) AS n_status, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), '') AS priorities FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def c15_resource_usage(spark, sf_dir):
    # links are summed before the join, so customers without any cost nothing
    links = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_links"), F.countDistinct("o_orderstatus").alias("n_status"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))
    return table(spark, sf_dir, "customer").join(links, c("c_custkey") == c("o_custkey"), "left").na.fill(0).na.fill("").select("c_custkey", "n_links", "n_status", "priorities")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)")
def c16_semi_join(spark, sf_dir):
    hit = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45")
    return table(spark, sf_dir, "orders").join(hit, c("o_orderkey") == c("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, coalesce(n, 0) AS n_trials, coalesce(f, 0) AS n_returned, best FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_extendedprice) AS best FROM lineitem GROUP BY 1) t ON o_orderkey = t.l_orderkey
LEFT JOIN (SELECT l_orderkey, count(*) AS f FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) s ON o_orderkey = s.l_orderkey""")
def c17_run_child_summaries(spark, sf_dir):
    # all child summaries come from one pass over the child table and one join
    child = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_trials"), F.expr("count_if(l_returnflag = 'R')").alias("n_returned"), F.max("l_extendedprice").alias("best"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(child, c("o_orderkey") == c("l_orderkey"), "left").na.fill(0, ["n_trials", "n_returned"]).select("o_orderkey", "n_trials", "n_returned", "best")


@query("WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, sum(value) AS v FROM events GROUP BY 1, 2) SELECT a.user_id AS a, b.user_id AS b, count(*) AS n, round(corr(a.v, b.v), 6) + 0.0 AS rho FROM d a JOIN d b ON a.day = b.day AND a.user_id <> b.user_id WHERE a.user_id % 20 = 0 GROUP BY 1, 2 HAVING count(*) > 4")
def c19_pairwise_correlation(spark, sf_dir):
    """Candidates (users whose id is divisible by 20) against every other user, by the days they share."""
    d = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("v"))
    return j.correlations(d.where("user_id % 20 = 0"), d, by="user_id", on="day", value="v", least=5, digits=6)


POSITIONS = "current AS (SELECT l_suppkey AS symbol, sum(l_quantity) AS v FROM lineitem WHERE l_linenumber <= 3 AND l_suppkey % 3 <> 0 GROUP BY 1), target AS (SELECT l_suppkey AS symbol, sum(l_quantity) AS v FROM lineitem WHERE l_linenumber >= 3 AND l_suppkey % 4 <> 0 GROUP BY 1)"


@query(f"WITH {POSITIONS} SELECT symbol, before, after, after - before AS delta, CASE WHEN after = before THEN 'hold' WHEN before = 0 THEN 'open' WHEN after = 0 THEN 'close' WHEN after > before THEN 'increase' ELSE 'reduce' END AS action, CASE WHEN after > before THEN 'BUY' WHEN after < before THEN 'SELL' END AS side FROM (SELECT symbol, coalesce(c.v, 0.0) AS before, coalesce(t.v, 0.0) AS after FROM current c FULL OUTER JOIN target t USING (symbol))")
def c20_delta_order_plan(spark, sf_dir):
    """Orders that lead from current to target positions."""
    li = table(spark, sf_dir, "lineitem")
    side = lambda p: li.where(p).groupBy(c("l_suppkey").alias("symbol")).agg(F.sum("l_quantity").alias("v"))
    d = j.metric_diff(side("l_linenumber <= 3 AND l_suppkey % 3 <> 0"), side("l_linenumber >= 3 AND l_suppkey % 4 <> 0"), keys=["symbol"], value="v")
    action = F.when(c("delta") == 0, "hold").when(c("before") == 0, "open").when(c("after") == 0, "close").when(c("delta") > 0, "increase").otherwise("reduce")
    return d.select("symbol", "before", "after", "delta", action.alias("action"), F.when(c("delta") > 0, "BUY").when(c("delta") < 0, "SELL").alias("side"))


@query("SELECT n_name, t AS event_type, count(e.event_id) AS n, count(e.event_id) = 0 AS missing FROM nation CROSS JOIN (SELECT DISTINCT event_type AS t FROM events) LEFT JOIN events e ON e.event_type = t AND e.user_id % 25 = n_nationkey AND e.value > 100 GROUP BY n_name, t")
def c22_coverage_matrix(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    seen = ev.where("value > 100").groupBy((c("user_id") % 25).cast("int").alias("n_nationkey"), "event_type").agg(F.count("*").alias("n"))
    full = j.coverage_matrix(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ev.select("event_type").distinct(), seen, ["n_nationkey", "event_type"])
    return full.select("n_name", "event_type", "n", (c("n") == 0).alias("missing"))


@query("WITH a AS (SELECT event_type, day(ts) AS d, sum(value) AS v FROM events WHERE day(ts) <= 20 GROUP BY 1, 2), b AS (SELECT event_type, day(ts) AS d, sum(value) AS v FROM events WHERE day(ts) >= 10 GROUP BY 1, 2) SELECT event_type, d, round(coalesce(a.v, 0), 6) + 0.0 AS before, round(coalesce(b.v, 0), 6) + 0.0 AS after, round(coalesce(b.v, 0) - coalesce(a.v, 0), 6) + 0.0 AS delta FROM a FULL OUTER JOIN b USING (event_type, d)")
def c24_report_diff(spark, sf_dir):
    """Two reports compared by key."""
    ev = table(spark, sf_dir, "events").withColumn("d", F.day("ts").cast("bigint"))
    side = lambda p: ev.where(p).groupBy("event_type", "d").agg(F.sum("value").alias("v"))
    d = j.metric_diff(side("d <= 20"), side("d >= 10"), keys=["event_type", "d"], value="v")
    return d.select("event_type", "d", *[r(x).alias(x) for x in ("before", "after", "delta")])


@query("SELECT a.i AS fast, b.i AS slow, s.i AS stop FROM range(2, 12, 2) a(i), range(10, 40, 5) b(i), range(1, 4) s(i) WHERE a.i < b.i")
def c29_parameter_grid(spark, sf_dir):
    """The grid is built from bounded ranges; its size is known before it is built."""
    axis = lambda name, a, b, s: spark.range(a, b, s).withColumnRenamed("id", name)
    return axis("fast", 2, 12, 2).crossJoin(axis("slow", 10, 40, 5)).crossJoin(axis("stop", 1, 4, 1)).where("fast < slow")


@query("SELECT a.n_nationkey AS x, b.n_nationkey AS y, d.n_nationkey AS z FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey JOIN nation d ON b.n_nationkey < d.n_nationkey WHERE a.n_regionkey = b.n_regionkey AND b.n_regionkey = d.n_regionkey")
def c30_combinations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    named = lambda name: n.select(c("n_nationkey").alias(name), "n_regionkey")
    return named("x").join(named("y"), "n_regionkey").where("x < y").join(named("z"), "n_regionkey").where("y < z").select("x", "y", "z")


@query("SELECT m, list_filter(range(0, 6), lambda b: (m >> b) & 1 = 1)::VARCHAR AS members FROM range(0, 64) t(m) WHERE bit_count(m) = 3")
def c31_half_combinations(spark, sf_dir):
    members = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda b: F.getbit(c("m"), b) == 1)
    return spark.range(64).withColumnRenamed("id", "m").where(F.bit_count("m") == 3).select("m", F.concat(F.lit("["), F.array_join(members.cast("array<string>"), ", "), F.lit("]")).alias("members"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderdate ASC NULLS LAST, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def f02_rank_per_run(spark, sf_dir):
    by = W.partitionBy("o_custkey").orderBy(c("o_totalprice").desc_nulls_last(), c("o_orderdate").asc_nulls_last(), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(by)).where("rank <= 3").select("o_orderkey", "o_custkey", "o_totalprice", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 10000 AND 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def f04_top_k_report(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_totalprice BETWEEN 10000 AND 200000").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("""WITH s AS (SELECT o_orderkey, o_custkey, (CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 0 END) + (CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 0 END) + (CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) AS score, o_orderstatus || '/' || o_orderpriority AS params FROM orders)
SELECT o_orderkey, score, params FROM (SELECT *, row_number() OVER (PARTITION BY params ORDER BY score DESC, o_orderkey) AS n FROM s) WHERE n = 1 ORDER BY score DESC, o_orderkey LIMIT 8""")
def f09_warm_start_seeds(spark, sf_dir):
    """Weighted match score, best of each parameter set, top k."""
    score = F.when(c("o_orderstatus") == "F", 3).otherwise(0) + F.when(c("o_orderpriority").startswith("1"), 2).otherwise(0) + F.when(c("o_totalprice") > 300000, 1).otherwise(0)
    s = table(spark, sf_dir, "orders").select("o_orderkey", score.alias("score"), F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("params"))
    # max_by aggregates partially, unlike a row number over each parameter set
    best = s.groupBy("params").agg(F.max_by(F.struct("o_orderkey", "score"), F.struct(c("score"), -c("o_orderkey"))).alias("b")).select("b.o_orderkey", "b.score", "params")
    return best.orderBy(F.desc("score"), "o_orderkey").limit(8)


@query("SELECT o_orderkey, o_totalprice, rank, round(o_totalprice - top, 6) + 0.0 AS delta FROM (SELECT *, row_number() OVER w AS rank, first_value(o_totalprice) OVER w AS top FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderpriority, o_orderdate DESC, o_custkey, o_orderkey))")
def f12_variant_ranking(spark, sf_dir):
    """rank by a list of keys and the distance to the first, over groups of any size."""
    o = table(spark, sf_dir, "orders")
    ranked = w.rank_in_slices(o, by="o_orderstatus", key="o_totalprice", then=["o_orderpriority", F.desc("o_orderdate"), "o_custkey", "o_orderkey"])
    return ranked.select("o_orderkey", "o_totalprice", "rank", r(c("o_totalprice") - c("top")).alias("delta"))


@query("SELECT c_custkey, o_orderkey FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def f14_best_candidate(spark, sf_dir):
    best = F.max_by("o_orderkey", F.struct(c("o_orderstatus") == "F", c("o_totalprice"), -c("o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(best.alias("o_orderkey"))


@query("SELECT event_id, user_id, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def f17_fill_dedupe_first_wins(spark, sf_dir):
    first = F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")
    return table(spark, sf_dir, "events").groupBy("user_id", "props").agg(first).select("event_id", "user_id", "props")


@query("SELECT user_id, props, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def f18_duplicate_fills(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "props").agg(F.count("*").alias("n")).where("n > 1")


TIERS = ((50000.0, 20, 0.01), (150000.0, 10, 0.025), (300000.0, 5, 0.05))


@query("SELECT o_orderkey, CASE WHEN o_totalprice <= 50000 THEN 20 WHEN o_totalprice <= 150000 THEN 10 ELSE 5 END AS max_leverage, CASE WHEN o_totalprice <= 50000 THEN 0.01::DOUBLE WHEN o_totalprice <= 150000 THEN 0.025::DOUBLE ELSE 0.05::DOUBLE END AS mmr FROM orders")
def f19_tier_lookup(spark, sf_dir):
    tiers = F.array(*[F.struct(F.lit(a).alias("cap"), F.lit(b).alias("max_leverage"), F.lit(m).alias("mmr")) for a, b, m in TIERS])
    tier = F.coalesce(F.get(F.filter(tiers, lambda t: c("o_totalprice") <= t["cap"]), F.lit(0)), F.element_at(tiers, -1))
    return table(spark, sf_dir, "orders").withColumn("t", tier).select("o_orderkey", "t.max_leverage", "t.mmr")


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 10")
def g02_set_difference(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_partkey").subtract(li.where("l_returnflag = 'A' AND l_quantity > 10").select("l_partkey"))


@query("SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT s_suppkey FROM supplier")
def g03_set_union(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_suppkey").union(table(spark, sf_dir, "supplier").select("s_suppkey")).distinct()


@query("WITH b AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS bucket FROM events), l AS (SELECT user_id, date_trunc('hour', ts) AS bucket, sum(value) AS v FROM events WHERE event_type = 'error' GROUP BY 1, 2) SELECT user_id, bucket, round(coalesce(v, 0), 6) + 0.0 AS notional FROM b LEFT JOIN l USING (user_id, bucket)")
def g04_zero_filled_buckets(spark, sf_dir):
    """Seen buckets with 0 where nothing was liquidated; one aggregation instead of a union and a join."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket")).agg(r(F.sum(F.when(c("event_type") == "error", c("value")).otherwise(0.0))).alias("notional"))
