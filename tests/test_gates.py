"""Gates against literal cases, whose answers are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import gates as g
from tidemark.operators import rules as q


def one(spark, fields, column):
    df = spark.range(1).select(*[F.expr(e).alias(n) for n, e in fields.items()])
    return df.select((column() if callable(column) else column).alias("x")).first()["x"]


ORDER = {"quantity": "0.0015D", "price": "100.5D", "rounded_quantity": "0.001D", "rounded_price": "100.5D", "post_only": "false", "path": "'taker'", "side": "'BUY'", "best_bid": "100D", "best_ask": "101D", "time_in_force": "'GTC'", "reduce_only": "false", "intent": "'open'", "position": "0D", "submitted_at": "1", "expires_at": "2"}


@pytest.mark.parametrize(
    ("change", "issues"),
    [
        ({}, "min_notional_violation"), ({"rounded_quantity": "0.1D"}, ""), ({"rounded_quantity": "0.1D", "price": "100.3D"}, "price_precision_violation"), ({"rounded_quantity": "0.1D", "post_only": "true"}, "post_only_requires_maker_path"),
        ({"rounded_quantity": "0.1D", "post_only": "true", "path": "'maker'", "price": "101D", "rounded_price": "101D"}, "post_only_would_take_liquidity"), ({"rounded_quantity": "0.1D", "time_in_force": "'GTX'"}, "gtx_requires_post_only"),
        ({"rounded_quantity": "0.1D", "reduce_only": "true"}, "reduce_only_requires_reduce_intent,reduce_only_without_position,reduce_only_quantity_exceeds_position"), ({"rounded_quantity": "0.1D", "expires_at": "1"}, "order_expired"), ({"rounded_quantity": "0.1D", "best_ask": "CAST(NULL AS DOUBLE)", "post_only": "true", "path": "'maker'"}, ""),
    ],
)
def test_venue_orders(spark, change, issues):
    assert one(spark, ORDER | change, q.all_broken(g.venue_order(5.0))) == issues


def test_rounding_to_steps_and_ticks(spark):
    assert one(spark, {"x": "0.0029D"}, lambda: g.round_down("x", 0.001)) == pytest.approx(0.002)
    assert [one(spark, {"x": f"{v}D"}, lambda: g.round_to_tick("x", 0.5)) for v in (100.25, 100.75, 100.3)] == [100.0, 101.0, 100.5]


def test_missing_metrics_fail_the_scorecard(spark):
    names = ("oos_sharpe", "sealed_holdout_sharpe", "bootstrap_pass_rate", "pbo", "dsr", "regime_pass_rate", "scenario_pass_rate", "slippage_bps", "trade_count", "max_drawdown", "distortion", "n_buckets", "n_symbols", "n_regimes")
    none = {n: "CAST(NULL AS DOUBLE)" for n in names} | {f: "CAST(NULL AS BOOLEAN)" for f in ("causality_passed", "cpcv_pass", "spa_pass", "capacity_pass")}
    assert one(spark, none, q.count_broken(g.robust_evaluation())) == 17
    good = dict(zip(names, ("1D", "1D", "0.7D", "0.2D", "0.95D", "0.7D", "0.7D", "25D", "30", "-0.3D", "0.5D", "2", "2", "2"), strict=True)) | {f: "true" for f in ("causality_passed", "cpcv_pass", "spa_pass", "capacity_pass")}
    assert one(spark, good, q.all_broken(g.robust_evaluation())) == ""
    assert one(spark, good, lambda: g.robust_score("distortion")) == pytest.approx(1 - 0.5 * 0.15)
    assert one(spark, none, lambda: g.robust_score(F.lit(0.0))) == 0.0


def test_promotion_boundaries(spark):
    edge = {
        "venue": "'BINANCE'", "execution_model_id": "'m'", "signal_timeframe": "'1h'", "execution_timeframe": "'15m'", "cv_method": "'combinatorial_purged_cv'", "n_blocks": "16", "n_test_blocks": "3", "purge_bars": "0", "embargo_bars": "0", "months_of_data": "1", "all_data_since_listing": "true", "n_folds": "8", "trade_count": "1", "n_episodes": "30",
        "net_pnl": "0.15D", "sharpe": "1D", "calmar": "0.75D", "max_drawdown": "-0.2D", "turnover_within_budget": "true", "capacity_5x_edge_erosion": "0.249D", "capacity_5x_fill_completion": "0.95D", "dsr": "0.95D", "pbo": "0.199D", "spa_pvalue": "0.049D", "cpcv_median": "0.751D", "cpcv_p10": "0.01D", "n_liquidations": "0", "n_rule_failures": "0",
        "baselines_present": "true", "plateau_ok": "true", "bootstrap_ok": "true", "regime_ok": "true", "reproducible": "true",
    }
    assert one(spark, edge, q.all_broken(g.promotion("m"))) == ""
    assert one(spark, edge | {"pbo": "0.2D", "spa_pvalue": "0.05D", "dsr": "CAST(NULL AS DOUBLE)", "n_blocks": "17"}, q.all_broken(g.promotion("m"))) == "validation_method,dsr,pbo,spa"


def test_routes_and_states(spark):
    assert one(spark, {"codes": "array('capacity_fail', 'feature_leakage', 'capacity_fail')"}, lambda: g.routed("codes")[0]) == "block_candidate"
    assert one(spark, {"codes": "array('capacity_fail', 'feature_leakage', 'capacity_fail')"}, lambda: g.routed("codes")[1]) == ["sizing_liquidity_research"]
    assert one(spark, {"codes": "array('unknown')"}, lambda: g.routed("codes")[0]) == "promote_to_paper_forward_review"
    assert one(spark, {"gate": "'holdout_sharpe'", "n": "3"}, lambda: g.failure_route("gate", "n")[2]) == "validation_failures:holdout_sharpe:repeated=3:action=stop"
    assert one(spark, {"x": "'beta_cap'"}, lambda: g.failure_family("x")) == "portfolio_failures"
    assert one(spark, {"x": "'HALT'"}, lambda: g.allowed_actions("x")) == ""
    assert one(spark, {"from_stage": "'paper'", "to_stage": "'shadow_live'", "evidence": "array('telemetry_complete')"}, lambda: g.rollout_reasons()) == ["missing_gate_evidence:paper_stability_pass"]
    assert one(spark, {"from_stage": "'paper'", "to_stage": "'tiny_live'", "evidence": "array('x')"}, lambda: g.rollout_reasons()) == ["rollout_stage_skip_not_allowed"]
    assert one(spark, {"pnl": "1D", "dd": "0D"}, lambda: g.calmar("pnl", "dd")) == 999.0
