"""Queries of run records, bundles and budgets, on the shared tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import c, r
from tidemark.operators import memory as m
from tidemark.operators.windows import CRISIS
from tidemark.plans.registry import over_candles, query
from tidemark.plans.series import REGIMES, labelled
from tidemark.sources.tables import candles, table

LINKS = "links AS (SELECT l_orderkey AS run_id, l_partkey AS resource_id, l_returnflag AS link_role, l_linenumber AS n FROM lineitem), resources AS (SELECT p_partkey AS resource_id, p_brand AS resource_group, CASE WHEN p_size % 6 = 0 THEN 'blocked_license' ELSE 'open' END AS status FROM part WHERE p_size < 40)"


def links(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("run_id"), c("l_partkey").alias("resource_id"), c("l_returnflag").alias("link_role"), c("l_linenumber").alias("n"))
    status = F.when(c("p_size") % 6 == 0, "blocked_license").otherwise("open")
    return m.linked(li, table(spark, sf_dir, "part").where("p_size < 40").select(c("p_partkey").alias("resource_id"), c("p_brand").alias("resource_group"), status.alias("status")))


@query(f"WITH {LINKS} SELECT run_id, resource_id, link_role, n, resource_group, status FROM links LEFT JOIN resources USING (resource_id)")
def c13_resource_links(spark, sf_dir):
    """Links with what is known of their resource."""
    return links(spark, sf_dir)


@query(f"WITH {LINKS} SELECT run_id, count(*) AS link_count, count(DISTINCT resource_id) AS linked_resource_count, count(*) FILTER (status LIKE 'blocked%') AS blocked_link_count, coalesce(array_to_string(list_sort(list(DISTINCT resource_group) FILTER (resource_group IS NOT NULL)), ','), '') AS resource_groups, array_to_string(list_sort(list(DISTINCT resource_id)), ',') AS resource_ids FROM links LEFT JOIN resources USING (resource_id) GROUP BY run_id")
def c14_link_summaries(spark, sf_dir):
    """C14: one summary a run."""
    s = m.link_summaries(links(spark, sf_dir))
    return s.withColumns({"resource_groups": F.array_join("resource_groups", ","), "resource_ids": F.array_join("resource_ids", ",")})


@query(over_candles("SELECT label, samples, round(total / samples, 6) + 0.0 AS average_coverage, CASE WHEN label IN ('crash', 'short_squeeze', 'liquidity_stress') THEN round(present / samples, 6) END AS crisis_frequency, coalesce(dominated, 0) AS dominated FROM (SELECT label, sum(coverage) AS total, count(*) AS present, (SELECT count(DISTINCT symbol) FROM cov) AS samples FROM cov GROUP BY label) LEFT JOIN (SELECT label, count(*) AS dominated FROM (SELECT symbol, last(label ORDER BY coverage, label) AS label FROM cov GROUP BY symbol) GROUP BY label) USING (label)", REGIMES, "cov AS (SELECT symbol, regime AS label, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS coverage FROM regimes GROUP BY symbol, regime)"))
def d22_regime_summary(spark, sf_dir):
    """Regimes over samples, a symbol's series being a sample."""
    n = labelled(spark, sf_dir).groupBy("symbol", "regime").agg(F.count("*").alias("n"))
    total = n.groupBy("symbol").agg(F.sum("n").alias("all"))
    coverage = n.join(total, "symbol").select(c("symbol").alias("sample"), c("regime").alias("label"), (c("n") / c("all")).alias("coverage"))
    s = m.regime_summary(coverage, CRISIS)
    return s.select("label", "samples", r("average_coverage").alias("average_coverage"), F.round("crisis_frequency", 6).alias("crisis_frequency"), "dominated")


@query("SELECT l_suppkey, first(l_returnflag ORDER BY mismatch DESC, l_returnflag) AS l_returnflag, max(mismatch) AS mismatch FROM (SELECT l_suppkey, l_returnflag, round(avg(abs(l_discount - l_tax)), 9) AS mismatch FROM lineitem GROUP BY 1, 2) GROUP BY l_suppkey")
def d58_fill_model_mismatch(spark, sf_dir):
    """The fill model that is furthest from what was realised."""
    return m.worst_model(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", F.abs(c("l_discount") - c("l_tax")))


@query("""WITH x AS (SELECT o_orderpriority AS regime, l_returnflag AS layer, l_linenumber % 3 AS parameter, l_quantity AS value, o_orderstatus = 'F' AND l_discount > 0.05 AS promoted FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT regime, layer, parameter, min(value) AS low, max(value) AS high, count(*) AS promoted_count FROM x WHERE promoted GROUP BY 1, 2, 3)
SELECT p.*, count(x.value) AS blocked_count, count(x.value) FILTER (x.value BETWEEN low AND high) AS blocked_inside FROM p LEFT JOIN x ON NOT x.promoted AND x.regime = p.regime AND x.layer = p.layer AND x.parameter = p.parameter GROUP BY ALL""")
def d72_regime_parameter_hints(spark, sf_dir):
    """Parameter ranges by regime and layer, with the blocked values inside them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", c("o_orderpriority").alias("regime"), "o_orderstatus")
    x = table(spark, sf_dir, "lineitem").join(o, c("l_orderkey") == c("o_orderkey"))
    x = x.select("regime", c("l_returnflag").alias("layer"), (c("l_linenumber") % 3).alias("parameter"), c("l_quantity").alias("value"), ((c("o_orderstatus") == "F") & (c("l_discount") > 0.05)).alias("promoted"))
    return m.parameter_hints(x, ["regime", "layer", "parameter"])


WEIGHTS = "CASE WHEN l_orderkey % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE (l_quantity - 25) / 400 END"


@query(f"""WITH t AS (SELECT l_suppkey, 'p' || l_partkey AS symbol, {WEIGHTS} AS weight, CASE WHEN l_partkey % 6 = 5 THEN 'unclustered' ELSE 'c' || (l_partkey % 6) END AS cluster, CASE WHEN l_partkey % 4 = 3 THEN 0 ELSE CAST(l_partkey % 4 AS DOUBLE) / 2 END AS beta, l_tax * 100 AS funding FROM lineitem), f AS (SELECT * FROM t WHERE NOT isnan(weight)),
reasons AS (SELECT l_suppkey, 'target_non_finite:' || symbol || ':target_weight' AS reason FROM t WHERE isnan(weight) UNION SELECT l_suppkey, 'symbol_cap:' || symbol FROM f WHERE abs(weight) > 0.06 UNION SELECT l_suppkey, 'funding_budget:' || symbol FROM f WHERE funding > 7.5 UNION SELECT l_suppkey, 'cluster_cap:' || cluster FROM f GROUP BY l_suppkey, cluster HAVING sum(abs(weight)) > 3 UNION SELECT l_suppkey, 'beta_cap' FROM f GROUP BY l_suppkey HAVING sum(abs(weight * beta)) > 8)
SELECT l_suppkey, round(b, 6) + 0.0 AS beta, coalesce(array_to_string(rs, ','), '') AS rejections FROM (SELECT l_suppkey, sum(abs(weight * beta)) FILTER (NOT isnan(weight)) AS b FROM t GROUP BY 1) LEFT JOIN (SELECT l_suppkey, list_sort(list(reason)) AS rs FROM reasons GROUP BY 1) USING (l_suppkey)""")
def d88_portfolio_risk(spark, sf_dir):
    """Caps on symbols, clusters, funding and the beta-weighted sum of a book."""
    t = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.concat(F.lit("p"), c("l_partkey").cast("string")).alias("symbol"), F.expr(WEIGHTS).alias("weight"), F.when(c("l_partkey") % 6 != 5, F.concat(F.lit("c"), (c("l_partkey") % 6).cast("string"))).alias("cluster"),
        F.when(c("l_partkey") % 4 != 3, (c("l_partkey") % 4).cast("double") / 2).alias("beta"), (c("l_tax") * 100).alias("funding_bps"),
    )
    out = m.risk_budget(t, "l_suppkey", max_symbol=0.06, max_cluster=3.0, max_beta=8.0, max_funding=7.5)
    return out.select("l_suppkey", r("beta").alias("beta"), F.array_join("rejections", ",").alias("rejections"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' ORDER BY o_custkey, o_totalprice DESC, o_orderkey LIMIT 60")
def f06_agent_decisions(spark, sf_dir):
    """decisions by family and status, no run named; a report of sixty."""
    found = m.listing(table(spark, sf_dir, "orders"), {"o_custkey": None, "o_orderstatus": "F", "o_orderpriority": "2-HIGH"}, ["o_custkey", F.desc("o_totalprice"), "o_orderkey"], 60)
    return found.select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_brand = 'Brand#13' ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 25")
def f11_campaign_rank(spark, sf_dir):
    """policies of a family, ranked; a report of twenty-five."""
    return m.listing(table(spark, sf_dir, "part"), {"p_brand": "Brand#13"}, [F.desc("p_size"), "p_retailprice", "p_partkey"], 25).select("p_partkey", "p_size", "p_retailprice")


@query(over_candles("""SELECT symbol, count(*) AS n, count(*) FILTER (close <= 0 OR high < low OR high < greatest(open, close) OR low > least(open, close)) AS broken, count(*) FILTER (liq > 0) / count(*) AS liquidation_coverage,
round(greatest(0, 1 - (CASE WHEN count(*) FILTER (close <= 0 OR high < low OR high < greatest(open, close) OR low > least(open, close)) > 0 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (gap > 3600) > 0 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (volume < 0) > 0 THEN 1 ELSE 0 END) / count(*)), 6) + 0.0 AS quality_score FROM (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS gap FROM candles) GROUP BY symbol"""))
def b11_quality_score(spark, sf_dir):
    """The kinds of issues of a bundle against its rows, and the coverage of a sidecar."""
    at = F.unix_seconds(c("ts").cast("timestamp"))
    x = candles(spark, sf_dir).withColumn("gap", at - F.lag(at).over(W.partitionBy("symbol").orderBy("ts")))
    broken = F.expr("count_if(close <= 0 OR high < low OR high < greatest(open, close) OR low > least(open, close))")
    kind = lambda n: F.when(n > 0, 1).otherwise(0)
    g = x.groupBy("symbol").agg(F.count("*").alias("n"), broken.alias("broken"), F.count_if(c("gap") > 3600).alias("gaps"), F.count_if(c("volume") < 0).alias("negative"), F.count_if(c("liq") > 0).alias("seen"))
    return g.select("symbol", "n", "broken", (c("seen") / c("n")).alias("liquidation_coverage"), r(F.greatest(F.lit(0.0), 1 - (kind(c("broken")) + kind(c("gaps")) + kind(c("negative"))) / c("n"))).alias("quality_score"))


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus <> 'F' THEN 'dsr' END, CASE WHEN o_totalprice < 100000 THEN 'pbo' END, CASE WHEN o_custkey % 3 = 0 THEN 'spa' END) AS failed, concat_ws(',', CASE WHEN o_orderstatus <> 'O' THEN 'status' END, CASE WHEN o_custkey % 2 = 1 THEN 'trades' END) AS changed FROM orders")
def l21_bundle_gates(spark, sf_dir):
    """Failed gates of a validation bundle and the fields in which two bundles differ."""
    gates = F.create_map(F.lit("spa"), c("o_custkey") % 3 != 0, F.lit("dsr"), c("o_orderstatus") == "F", F.lit("pbo"), c("o_totalprice") >= 100000)
    left = F.create_map(F.lit("trades"), (c("o_custkey") % 2).cast("string"), F.lit("status"), c("o_orderstatus"), F.lit("same"), F.lit("x"))
    right = F.create_map(F.lit("status"), F.lit("O"), F.lit("same"), F.lit("x"), F.lit("trades"), F.lit("0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(m.failed_gates(gates), ",").alias("failed"), F.array_join(m.changed_fields(left, right), ",").alias("changed"))
