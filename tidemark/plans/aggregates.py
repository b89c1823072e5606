"""Queries of the aggregation family."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import stats as s
from tidemark.functions.columns import c, clamp, log_ratio, r
from tidemark.plans.registry import over_candles, query, rounded
from tidemark.plans.series import REGIMES, RET, labelled, with_returns
from tidemark.sources.tables import candles, table

MOMENTS = f"m AS (SELECT symbol, count(*) AS n, CASE WHEN count(*) > 1 AND stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) ELSE 0 END AS sharpe, sqrt(avg(pow(least(ret, 0.0), 2))) AS down, avg(ret) AS mean, skewness(ret) AS skew, kurtosis(ret) + 3 AS kurt FROM rets GROUP BY symbol)"


@query(over_candles(f"SELECT symbol, n, {rounded('sharpe', 'CASE WHEN n < 2 THEN 0 WHEN down > 0 THEN mean / down WHEN mean > 0 THEN 999.0 ELSE 0 END AS sortino', 'skew', 'kurt')} FROM m", RET, MOMENTS))
def d02_return_moments(spark, sf_dir):
    """D2-D6."""
    return with_returns(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), r(s.sharpe("ret")).alias("sharpe"), r(s.sortino("ret")).alias("sortino"), r(s.sample_skewness("ret")).alias("skew"), r(s.sample_kurtosis("ret")).alias("kurt"))


@query(over_candles(f"SELECT symbol, {rounded('sqrt(greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, 1e-12) / greatest(n - 1, 1)) AS error')} FROM m", RET, MOMENTS))
def d07_sharpe_error(spark, sf_dir):
    m = with_returns(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), s.sharpe("ret").alias("sr"), s.sample_skewness("ret").alias("g"), s.sample_kurtosis("ret").alias("k"))
    return m.select("symbol", r(s.sharpe_error(c("sr"), c("g"), c("k"), c("n"))).alias("error"))


@query()
def d08_probabilistic_sharpe(spark, sf_dir):
    """Probabilistic and deflated Sharpe ratio; Spark and SQL lack the normal distribution."""
    m = with_returns(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), s.sharpe("ret").alias("sr"), s.sample_skewness("ret").alias("g"), s.sample_kurtosis("ret").alias("k"))
    m = m.withColumn("error", s.sharpe_error(c("sr"), c("g"), c("k"), c("n")))
    trials = m.agg(F.count("*").cast("double").alias("trials"), F.stddev_samp("sr").alias("spread"))
    best = m.crossJoin(F.broadcast(trials.withColumn("benchmark", s.expected_best_sharpe(c("spread"), c("trials")))))
    return best.select("symbol", s.normal_cdf(c("sr") / c("error")).alias("psr"), s.normal_cdf((c("sr") - c("benchmark")) / c("error")).alias("dsr"), "benchmark", (1 + 2 * F.log("trials") / F.pow(F.greatest("sr", F.lit(1e-9)), 2)).alias("min_backtest_length"))


@query(over_candles(f"SELECT symbol, {rounded('CASE WHEN abs(dd) > 1e-12 THEN pnl / abs(dd) WHEN pnl > 0 THEN 999.0 ELSE 0 END AS calmar')} FROM (SELECT symbol, max_by(eq, i) AS pnl, min(dd) AS dd FROM (SELECT symbol, i, eq, greatest(1e-9, 1 + eq) / max(greatest(1e-9, 1 + eq)) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM (SELECT symbol, i, sum(ret) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) / 97.0 AS eq FROM rets)) GROUP BY symbol)", RET))
def d12_calmar(spark, sf_dir):
    so_far = W.partitionBy("symbol").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    eq = with_returns(spark, sf_dir).withColumn("eq", F.sum("ret").over(so_far) / 97.0)
    value = F.greatest(F.lit(1e-9), 1 + c("eq"))
    g = eq.withColumn("dd", value / F.max(value).over(so_far) - 1).groupBy("symbol").agg(F.max_by("eq", "i").alias("pnl"), F.min("dd").alias("dd"))
    return g.select("symbol", r(s.calmar(c("pnl"), c("dd"))).alias("calmar"))


DAILY = "daily AS (SELECT user_id % 8 AS model, CAST(day(ts) AS BIGINT) % 6 AS part, avg(value) AS score FROM events GROUP BY 1, 2)"


@query(f"""WITH {DAILY}, combos AS (SELECT m FROM range(0, 64) t(m) WHERE bit_count(m) = 3),
scored AS (SELECT m, model, avg(score) FILTER ((m >> part) & 1 = 1) AS ins, avg(score) FILTER ((m >> part) & 1 = 0) AS oos FROM combos, daily GROUP BY m, model),
ranked AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY ins DESC, model) AS r, row_number() OVER (PARTITION BY m ORDER BY oos, model) AS o, count(*) OVER (PARTITION BY m) AS n FROM scored)
SELECT m, model, round(ln((o / (n + 1)) / (1 - o / (n + 1))), 6) + 0.0 AS logit, ln((o / (n + 1)) / (1 - o / (n + 1))) <= 0 AS overfit FROM ranked WHERE r = 1""")
def d13_backtest_overfitting(spark, sf_dir):
    """Combinatorially symmetric cross-validation: the in-sample winner's logit of its out-of-sample rank."""
    daily = table(spark, sf_dir, "events").groupBy((c("user_id") % 8).alias("model"), (F.day("ts") % 6).alias("part")).agg(F.avg("value").alias("score"))
    combos = spark.range(64).withColumnRenamed("id", "m").where(F.bit_count("m") == 3)
    inside = F.getbit(c("m"), c("part")) == 1
    scored = daily.crossJoin(F.broadcast(combos)).groupBy("m", "model").agg(F.avg(F.when(inside, c("score"))).alias("ins"), F.avg(F.when(~inside, c("score"))).alias("oos"))
    of = W.partitionBy("m")
    ranked = scored.withColumns({"r": F.row_number().over(of.orderBy(F.desc("ins"), "model")), "o": F.row_number().over(of.orderBy("oos", "model")), "n": F.count("*").over(of)})
    share = c("o") / (c("n") + 1)
    return ranked.where("r = 1").withColumn("l", F.log(share / (1 - share))).select("m", "model", r("l").alias("logit"), (c("l") <= 0).alias("overfit"))


@query("WITH p AS (SELECT p_partkey AS k, (p_partkey * 37 % 1000 + 1) / 20000.0 AS p FROM part), q AS (SELECT *, row_number() OVER (ORDER BY p, k) AS rk, count(*) OVER () AS n FROM p) SELECT k, round(least(1.0, min(p * n / rk) OVER (ORDER BY rk DESC)), 6) + 0.0 AS adjusted, least(1.0, min(p * n / rk) OVER (ORDER BY rk DESC)) <= 0.05 AS reject FROM q")
def d14_false_discovery_rate(spark, sf_dir):
    """Benjamini-Hochberg."""
    p = table(spark, sf_dir, "part").select(c("p_partkey").alias("k"), ((c("p_partkey") * 37 % 1000 + 1) / 20000.0).alias("p"))
    return s.false_discovery_rate(p, "p").select("k", r("adjusted").alias("adjusted"), (c("adjusted") <= 0.05).alias("reject"))


@query("""WITH b AS (SELECT user_id % 6 AS block, avg(value) AS m FROM events GROUP BY 1), paths AS (SELECT x.block * 10 + y.block AS path, (x.m + y.m) / 2 AS v FROM b x JOIN b y ON x.block < y.block)
SELECT count(*) AS paths, round(quantile_cont(v, 0.5), 6) + 0.0 AS median, round(quantile_cont(v, 0.1), 6) + 0.0 AS p10 FROM paths""")
def d15_combinatorial_paths(spark, sf_dir):
    b = table(spark, sf_dir, "events").groupBy((c("user_id") % 6).alias("block")).agg(F.avg("value").alias("m"))
    x, y = b.select(c("block").alias("a"), c("m").alias("ma")), b.select(c("block").alias("b"), c("m").alias("mb"))
    paths = x.join(F.broadcast(y), c("a") < c("b")).select(((c("ma") + c("mb")) / 2).alias("v"))
    return paths.agg(F.count("*").alias("paths"), r(s.median("v")).alias("median"), r(F.percentile("v", F.lit(0.1))).alias("p10"))


@query(over_candles("SELECT symbol, p AS part, round(avg(ret), 6) + 0.0 AS mean FROM (SELECT symbol, ret, CAST(floor((i * 4 + 3) / n) AS BIGINT) AS p FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM rets)) WHERE p < 4 GROUP BY symbol, p", RET))
def d16_partitioned_means(spark, sf_dir):
    n = F.count(F.lit(1)).over(W.partitionBy("symbol"))
    return with_returns(spark, sf_dir).withColumn("part", F.floor((c("i") * 4 + 3) / n)).where("part < 4").groupBy("symbol", "part").agg(r(F.avg("ret")).alias("mean"))


@query("WITH m AS (SELECT user_id, avg(value) AS v FROM events GROUP BY 1) SELECT event_type, round((1 + count(*) FILTER (v >= o)) / (count(*) + 1), 6) + 0.0 AS p FROM (SELECT event_type, avg(value) AS o FROM events GROUP BY 1), m GROUP BY event_type")
def d17_permutation_p_value(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    observed = ev.groupBy("event_type").agg(F.avg("value").alias("o"))
    null = ev.groupBy("user_id").agg(F.avg("value").alias("v"))
    return null.crossJoin(F.broadcast(observed)).groupBy("event_type").agg(r((1 + F.expr("count_if(v >= o)")) / (F.count("*") + 1)).alias("p"))


@query(over_candles("""SELECT symbol, round(avg(funding), 6) + 0.0 AS avg_funding, round(coalesce(stddev_samp(CASE WHEN i > 0 AND pc > 0 THEN ln(close / pc) END), 0), 6) + 0.0 AS vol, round(max_by(oi, i) / min_by(oi, i) - 1, 6) + 0.0 AS oi_change,
CASE WHEN avg(funding) >= 0.01 THEN 'positive_extreme' WHEN avg(funding) >= 0.001 THEN 'positive' WHEN avg(funding) <= -0.01 THEN 'negative_extreme' WHEN avg(funding) <= -0.001 THEN 'negative' ELSE 'flat' END AS funding_bucket FROM regimes GROUP BY symbol""", REGIMES))
def d20_regime_state(spark, sf_dir):
    """D20, H32-H34."""
    prev = F.lag("close").over(W.partitionBy("symbol").orderBy("i"))
    f = F.avg("funding")
    bucket = F.when(f >= 0.01, "positive_extreme").when(f >= 0.001, "positive").when(f <= -0.01, "negative_extreme").when(f <= -0.001, "negative").otherwise("flat")
    lr = candles(spark, sf_dir).withColumn("lr", F.when(prev > 0, log_ratio("close", prev)))
    return lr.groupBy("symbol").agg(r(f).alias("avg_funding"), r(F.coalesce(F.stddev_samp("lr"), F.lit(0.0))).alias("vol"), r(F.max_by("oi", "i") / F.min_by("oi", "i") - 1).alias("oi_change"), bucket.alias("funding_bucket"))


@query("SELECT user_id % 10 AS seed, round(quantile_cont(value, 0.5), 6) + 0.0 AS median, min(value) AS worst, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0 END), 6) + 0.0 AS pass_rate FROM events GROUP BY 1")
def d21_bootstrap_report(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((c("user_id") % 10).alias("seed")).agg(r(s.median("value")).alias("median"), F.min("value").alias("worst"), r(F.avg(F.when(c("value") > 20, 1.0).otherwise(0.0))).alias("pass_rate"))


@query(over_candles("SELECT regime, count(*) FILTER (vol = 'low') AS low, count(*) FILTER (vol = 'normal') AS normal, count(*) FILTER (vol = 'high') AS high FROM (SELECT regime, CASE WHEN volume < 20 THEN 'low' WHEN volume < 60 THEN 'normal' ELSE 'high' END AS vol FROM regimes) GROUP BY regime", REGIMES))
def d25_regime_pivot(spark, sf_dir):
    vol = F.when(c("volume") < 20, "low").when(c("volume") < 60, "normal").otherwise("high")
    return labelled(spark, sf_dir).withColumn("vol", vol).groupBy("regime").pivot("vol", ["low", "normal", "high"]).count().na.fill(0)


@query("WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events) SELECT user_id, round(avg(greatest(gap, 1.0)), 4) + 0.0 AS mean_gap, round(1 / avg(greatest(gap, 1.0)), 8) + 0.0 AS rate FROM g WHERE gap IS NOT NULL GROUP BY user_id")
def d26_hawkes_gaps(spark, sf_dir):
    t = F.unix_micros(c("ts").cast("timestamp"))
    gap = (t - F.lag(t).over(W.partitionBy("user_id").orderBy("ts", "event_id"))) / 1e6
    mean = F.avg(F.greatest("gap", F.lit(1.0)))
    return table(spark, sf_dir, "events").withColumn("gap", gap).where("gap IS NOT NULL").groupBy("user_id").agg(r(mean, 4).alias("mean_gap"), r(1 / mean, 8).alias("rate"))


@query(over_candles("SELECT symbol, round(CASE WHEN max(oi) > min(oi) THEN (max_by(oi, i) - min(oi)) / (max(oi) - min(oi)) ELSE 0 END, 6) + 0.0 AS concentration FROM candles GROUP BY symbol"))
def d27_oi_concentration(spark, sf_dir):
    span = F.max("oi") - F.min("oi")
    return candles(spark, sf_dir).groupBy("symbol").agg(r(F.when(span > 0, (F.max_by("oi", "i") - F.min("oi")) / span).otherwise(0.0)).alias("concentration"))


@query(over_candles("""SELECT symbol, round(any_value(med), 6) + 0.0 AS med, round(any_value(mad), 6) + 0.0 AS mad, count(*) FILTER (abs(ret - med) > 3 * mad) AS jumps, round(coalesce(stddev_samp(ret) FILTER (abs(ret - med) <= 3 * mad), 0), 6) + 0.0 AS calm_std
FROM (SELECT *, quantile_cont(abs(ret - med), 0.5) OVER (PARTITION BY symbol) AS mad FROM (SELECT *, quantile_cont(ret, 0.5) OVER (PARTITION BY symbol) AS med FROM (SELECT symbol, i, round(ret, 9) AS ret FROM rets WHERE i > 0))) GROUP BY symbol""", RET))
def d28_jump_fit(spark, sf_dir):
    """Median, median absolute deviation and the split of returns by them; two small joins, no full-series window."""
    x = with_returns(spark, sf_dir).where("i > 0").select("symbol", F.round("ret", 9).alias("ret"))
    x = x.join(x.groupBy("symbol").agg(s.median("ret").alias("med")), "symbol")
    x = x.join(x.groupBy("symbol").agg(s.median(F.abs(c("ret") - c("med"))).alias("mad")), "symbol")
    jump = F.abs(c("ret") - c("med")) > 3 * c("mad")
    return x.groupBy("symbol").agg(r(F.first("med")).alias("med"), r(F.first("mad")).alias("mad"), F.count(F.when(jump, 1)).alias("jumps"), r(F.coalesce(F.stddev_samp(F.when(~jump, c("ret"))), F.lit(0.0))).alias("calm_std"))


@query("SELECT event_type, round(avg(value) FILTER (day(ts) > 20) - avg(value) FILTER (day(ts) <= 20), 6) + 0.0 AS skew FROM events GROUP BY event_type")
def d29_train_serve_skew(spark, sf_dir):
    late = F.day("ts") > 20
    return table(spark, sf_dir, "events").groupBy("event_type").agg(r(F.avg(F.when(late, c("value"))) - F.avg(F.when(~late, c("value")))).alias("skew"))


@query(over_candles("SELECT symbol, round(avg(CASE WHEN liq <> 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS share, CASE WHEN avg(CASE WHEN liq <> 0 THEN 1.0 ELSE 0 END) >= 0.3 THEN 'high' WHEN avg(CASE WHEN liq <> 0 THEN 1.0 ELSE 0 END) >= 0.15 THEN 'medium' ELSE 'low' END AS confidence FROM candles GROUP BY symbol"))
def d31_field_confidence(spark, sf_dir):
    share = F.avg(F.when(c("liq") != 0, 1.0).otherwise(0.0))
    return candles(spark, sf_dir).groupBy("symbol").agg(r(share).alias("share"), F.when(share >= 0.3, "high").when(share >= 0.15, "medium").otherwise("low").alias("confidence"))


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS rows, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def d32_rows_per_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("year")).agg(F.count("*").alias("rows"), F.countDistinct("o_custkey").alias("customers"))


@query("SELECT l_suppkey, round(avg(l_discount) - stddev_pop(l_discount) - 0.5 * min(l_discount) + count(DISTINCT l_partkey) / 1000.0, 6) + 0.0 AS score FROM lineitem GROUP BY l_suppkey")
def d33_tournament_score(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(r(F.avg("l_discount") - F.stddev_pop("l_discount") - 0.5 * F.min("l_discount") + F.countDistinct("l_partkey") / 1000.0).alias("score"))


GATE_SUMS = "g AS (SELECT l_suppkey, sum(l_quantity) AS q, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS ret_share, round(avg(l_discount), 9) AS disc, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1)"


@query(f"WITH {GATE_SUMS} SELECT l_suppkey, coalesce(CASE WHEN NOT (q > 100) THEN 'positive' WHEN NOT (ret_share < 0.5) THEN 'returns' WHEN NOT (disc < 0.05) THEN 'discount' WHEN NOT (parts >= 10) THEN 'breadth' END, 'accepted') AS verdict, (CASE WHEN q > 100 THEN 1 ELSE 0 END) + (CASE WHEN ret_share < 0.5 THEN 1 ELSE 0 END) + (CASE WHEN disc < 0.05 THEN 1 ELSE 0 END) + (CASE WHEN parts >= 10 THEN 1 ELSE 0 END) AS passed FROM g")
def d41_gate_evaluation(spark, sf_dir):
    """Gates in order over sums of a group, the first that fails, and how many pass (the gates of D34-D44 are in ``plans.gates``)."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.avg(F.when(c("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("ret_share"), F.round(F.avg("l_discount"), 9).alias("disc"), F.countDistinct("l_partkey").alias("parts"))
    gates = [("positive", "q > 100"), ("returns", "ret_share < 0.5"), ("discount", "disc < 0.05"), ("breadth", "parts >= 10")]
    verdict = F.coalesce(*[F.when(~F.expr(p), n) for n, p in gates], F.lit("accepted"))
    return g.select("l_suppkey", verdict.alias("verdict"), sum(F.expr(p).cast("int") for _, p in gates).alias("passed"))


@query("SELECT event_type, user_id, count(*) AS n, sum(CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 THEN 1 ELSE 0 END) AS large, max(ts) AS last_ts, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY 1, 2")
def d45_session_status(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum(F.when(k > 50, 1).otherwise(0)).alias("large"), F.max("ts").alias("last_ts"), r(F.avg("value")).alias("mean"))


@query("SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS net, round(sum(abs(l_quantity * l_extendedprice)), 2) AS gross FROM lineitem GROUP BY l_suppkey")
def d46_exposure(spark, sf_dir):
    """Net and gross exposure by symbol."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(c("l_returnflag") == "R", -c("l_quantity")).otherwise(c("l_quantity"))).alias("net"), F.round(F.sum(F.abs(c("l_quantity") * c("l_extendedprice"))), 2).alias("gross"))


@query("SELECT user_id, max(v) FILTER (event_type = 'click') AS click, max(v) FILTER (event_type = 'purchase') AS purchase, max(v) FILTER (event_type = 'view') AS view FROM (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2) GROUP BY user_id")
def d47_latest_metric_pivot(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"))
    return last.groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.max("v"))


@query("SELECT round(sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END), 2) AS cash, round(sum(l_extendedprice * l_tax), 2) AS fees, round(coalesce(sum(CASE WHEN l_discount > 0.5 THEN l_discount END), 0), 2) AS transfers, arg_max(l_orderkey, l_orderkey * 10 + l_linenumber) AS last_order FROM lineitem")
def d48_ledger_totals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.sum(F.when(c("l_returnflag") == "R", -c("l_extendedprice")).otherwise(c("l_extendedprice"))), 2).alias("cash"), F.round(F.sum(c("l_extendedprice") * c("l_tax")), 2).alias("fees"), F.round(F.coalesce(F.sum(F.when(c("l_discount") > 0.5, c("l_discount"))), F.lit(0.0)), 2).alias("transfers"), F.max_by("l_orderkey", c("l_orderkey") * 10 + c("l_linenumber")).alias("last_order"))


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS worst FROM events GROUP BY event_type")
def d51_nearest_rank_percentiles(spark, sf_dir):
    """Dashboard percentiles are elements of the data; the number of rows below a value gives them without collecting."""
    ev = table(spark, sf_dir, "events")
    per = ev.groupBy("event_type", "value").agg(F.count("*").alias("n"))
    by = W.partitionBy("event_type").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    cum = per.withColumns({"below": F.sum("n").over(by), "all": F.sum("n").over(W.partitionBy("event_type"))})
    at = lambda p: F.min(F.when(c("below") >= F.ceil(c("all") * F.lit(p) - 1e-9), c("value")))
    return cum.groupBy("event_type").agg(F.max("all").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("value").alias("worst"))


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS returned, sum(l_quantity) AS quantity, round(avg(l_discount), 6) + 0.0 AS mean_discount, count(*) FILTER (l_linestatus = 'O') AS open_lines FROM lineitem GROUP BY l_suppkey")
def d52_order_section(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.expr("count_if(l_returnflag = 'R')").alias("returned"), F.sum("l_quantity").alias("quantity"), r(F.avg("l_discount")).alias("mean_discount"), F.expr("count_if(l_linestatus = 'O')").alias("open_lines"))


@query("SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS first_seen FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 5")
def d59_top_reasons(spark, sf_dir):
    """Counts ranked, ties by first appearance."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(5)


@query("SELECT l_suppkey, round(avg(l_extendedprice) FILTER (k > floor(n * 0.1) AND k <= n - floor(n * 0.1)), 4) + 0.0 AS trimmed FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) GROUP BY l_suppkey")
def d61_trimmed_mean(spark, sf_dir):
    of = W.partitionBy("l_suppkey")
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", F.row_number().over(of.orderBy("l_extendedprice", "l_orderkey", "l_linenumber")).alias("k"), F.count("*").over(of).alias("n"))
    cut = F.floor(c("n") * 0.1)
    return x.where((c("k") > cut) & (c("k") <= c("n") - cut)).groupBy("l_suppkey").agg(r(F.avg("l_extendedprice"), 4).alias("trimmed"))


@query("SELECT l_suppkey, round(greatest(0.5, least(2.0, quantile_cont(l_extendedprice / (l_quantity * 1000), 0.5))), 6) + 0.0 AS ratio FROM lineitem GROUP BY l_suppkey")
def d62_bounded_median_ratio(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(r(clamp(s.median(c("l_extendedprice") / (c("l_quantity") * 1000)), 0.5, 2.0)).alias("ratio"))


@query("SELECT s_suppkey, m AS multiplier, round(s_acctbal * m, 4) + 0.0 AS notional, round(10 * sqrt(abs(s_acctbal) * m / 10000), 6) + 0.0 AS cost_bps FROM supplier, (SELECT unnest([0.5, 1.0, 2.0, 5.0, 10.0])::DOUBLE AS m)")
def d64_capacity_ladder(spark, sf_dir):
    ladder = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0, 5.0, 10.0)))).alias("multiplier"))
    return ladder.select("s_suppkey", "multiplier", r(c("s_acctbal") * c("multiplier"), 4).alias("notional"), r(10 * F.sqrt(F.abs("s_acctbal") * c("multiplier") / 10000)).alias("cost_bps"))


@query("SELECT l_suppkey, count(*) AS n, round((count(*) * avg(l_discount) + 20 * 0.05) / (count(*) + 20), 6) + 0.0 AS shrunk FROM lineitem GROUP BY l_suppkey")
def d65_shrunk_calibration(spark, sf_dir):
    """D65-D66."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), r((F.count("*") * F.avg("l_discount") + 20 * 0.05) / (F.count("*") + 20)).alias("shrunk"))


@query("SELECT user_id, min(k) AS low, max(k) AS high, count(DISTINCT k) AS distinct_k FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY user_id")
def d71_parameter_hints(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("user_id", k.alias("k")).groupBy("user_id").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.countDistinct("k").alias("distinct_k"))


@query("SELECT user_id, props FROM (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, props) AS k FROM events GROUP BY user_id, props) WHERE k = 1")
def d73_modal_profile(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id", "props").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "props"))).where("k = 1").select("user_id", "props")


@query(over_candles("SELECT regime, round(avg(share), 6) + 0.0 AS share FROM (SELECT symbol, regime, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS share FROM regimes GROUP BY symbol, regime) GROUP BY regime HAVING avg(share) > 0 AND avg(share) < 0.15", REGIMES))
def d74_coverage_gaps(spark, sf_dir):
    n = labelled(spark, sf_dir).groupBy("symbol", "regime").agg(F.count("*").alias("n"))
    share = n.withColumn("share", c("n") / F.sum("n").over(W.partitionBy("symbol")))
    return share.groupBy("regime").agg(F.avg("share").alias("share")).where("share > 0 AND share < 0.15").select("regime", r("share").alias("share"))


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS failed, min_by(l_linenumber, (l_extendedprice, l_linenumber)) AS worst_line, count(DISTINCT l_linestatus) AS statuses, max_by(l_partkey, (l_linenumber, l_partkey)) AS last_part FROM lineitem GROUP BY l_orderkey")
def d76_per_run_summary(spark, sf_dir):
    """Counts, arg-min, distinct and last per run in one aggregation."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.expr("count_if(l_returnflag = 'R')").alias("failed"), F.min_by("l_linenumber", F.struct("l_extendedprice", "l_linenumber")).alias("worst_line"), F.countDistinct("l_linestatus").alias("statuses"), F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("last_part"))


@query("SELECT l_suppkey, round(avg(abs(l_discount - 0.05)) - avg(abs(l_discount - l_tax)), 6) + 0.0 AS improvement FROM lineitem GROUP BY l_suppkey")
def d82_shadow_improvement(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(r(F.avg(F.abs(c("l_discount") - 0.05)) - F.avg(F.abs(c("l_discount") - c("l_tax")))).alias("improvement"))


@query("SELECT user_id, max_by(event_type, (v, event_type)) AS best, bool_or(v > 100) AS any_large, min(v) < 0.05 * max(v) AS regressed FROM (SELECT user_id, event_type, round(sum(value), 6) AS v FROM events GROUP BY 1, 2) GROUP BY user_id")
def d84_best_of_baselines(spark, sf_dir):
    v = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(r(F.sum("value")).alias("v"))
    return v.groupBy("user_id").agg(F.max_by("event_type", F.struct("v", "event_type")).alias("best"), F.bool_or(c("v") > 100).alias("any_large"), (F.min("v") < 0.05 * F.max("v")).alias("regressed"))
