"""Queries of gates, guards and validators: inputs drawn from the shared tables, rules from ``functions.gates``.

The SQL states each rule anew, so that equality checks the rules themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import gates as g
from tidemark.functions.columns import c, r
from tidemark.operators import rules as q
from tidemark.plans.registry import ORACLES, QUERIES
from tidemark.sources.tables import table


def share(of: str, parts: int) -> str:
    """``of`` (an integer) over ``parts`` as a double, alike in both engines."""
    return f"CAST({of} AS DOUBLE) / {parts}"


def pick(of: str, *names: str | None) -> str:
    """The name at position ``of``."""
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {'NULL' if n is None else repr(n)}" for i, n in enumerate(names)) + " END"


def listed(*rules: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {p} THEN '{n}' END" for p, n in rules) + ")"


def gate(name: str, source: str, keys: str, inputs: dict[str, str], outputs: Callable[[], dict[str, Column | Callable[[], Column]]], sql: dict[str, str], *, doc: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Register ``name``: the outputs (made when a session is there) over the inputs of every row of a table, and the SQL of the same."""

    key_names = keys.split(", ")

    def run(spark, sf_dir):
        df = prepare(table(spark, sf_dir, source).select(*key_names, *[F.expr(e).alias(n) for n, e in inputs.items()]))
        return df.select(*key_names, *[(x() if callable(x) else x).alias(n) for n, x in outputs().items()])

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    # an output may be stated by those before it
    sql = dict(sorted(sql.items(), key=lambda x: x[0] not in ("failed", "reasons", "blockers", "rejections", "family", "action")))
    ORACLES[name] = f"WITH given AS (SELECT {keys}, {', '.join(f'{e} AS {n}' for n, e in inputs.items())} FROM {source}) SELECT {keys}, {', '.join(f'{e} AS {n}' for n, e in sql.items())} FROM given"


PRETRADE_FLAGS = ("artifact_approved", "artifact_expired", "symbol_allowed", "paper_mode_allowed", "market_fresh", "book_gap_clean", "reconciliation_clean", "duplicate_client_order_id", "rate_limit_ok", "margin_ok", "venue_rules_ok", "spread_depth_ok", "funding_ok", "liquidation_ok", "portfolio_risk_ok")
gate(
    "b29_pretrade_checks", "orders", "o_orderkey",
    {f: f"(o_orderkey * {2 * i + 3} + o_custkey) % {i + 17} {'=' if f in ('artifact_expired', 'duplicate_client_order_id') else '<>'} 0" for i, f in enumerate(PRETRADE_FLAGS)},
    lambda: {"rejections": q.all_broken(g.pretrade()), "first_rejection": q.first_broken(g.pretrade(), "passed"), "n_rejections": q.count_broken(g.pretrade())},
    {
        "rejections": listed(("NOT artifact_approved", "artifact_not_approved"), ("artifact_expired", "artifact_expired"), ("NOT symbol_allowed", "symbol_not_allowed"), ("NOT paper_mode_allowed", "paper_mode_not_allowed"), ("NOT market_fresh", "market_data_stale"), ("NOT book_gap_clean", "book_gap_detected"), ("NOT reconciliation_clean", "reconciliation_dirty"), ("duplicate_client_order_id", "duplicate_client_order_id"),
                             ("NOT rate_limit_ok", "rate_limit_block"), ("NOT margin_ok", "margin_leverage_block"), ("NOT venue_rules_ok", "venue_rule_block"), ("NOT spread_depth_ok", "spread_depth_block"), ("NOT funding_ok", "funding_block"), ("NOT liquidation_ok", "liquidation_block"), ("NOT portfolio_risk_ok", "portfolio_risk_block")),
        "first_rejection": "CASE WHEN rejections = '' THEN 'passed' ELSE string_split(rejections, ',')[1] END", "n_rejections": "CASE WHEN rejections = '' THEN 0 ELSE len(string_split(rejections, ',')) END",
    },
    doc="B29: pre-trade checklist of fifteen conditions.",
)

gate(
    "b31_funding_guard", "events", "event_id", {"action": pick("event_id % 5", "open", "increase", "reduce", "close", None), "now": "ts", "next_funding": "date_trunc('hour', ts) + INTERVAL 1 HOUR", "funding_cost_bps": share("event_id % 400", 10)},
    lambda: {"rejections": q.all_broken(g.funding_guard(25.0, 900))},
    {"rejections": listed(("action IN ('open', 'increase') AND epoch(next_funding) - epoch(now) BETWEEN 0 AND 900", "near_funding_open_block"), ("funding_cost_bps > 25", "funding_cost_budget_exceeded"))},
    doc="B31: no opening shortly before funding, and a budget of its cost.",
)

gate(
    "b32_liquidation_guard", "lineitem", "l_orderkey, l_linenumber", {"mark": "l_extendedprice", "liquidation": "l_extendedprice * (1 - CAST((l_partkey * 7 + l_orderkey) % 1200 AS DOUBLE) / 10000)"},
    lambda: {"distance_bps": r("distance_bps", 4), "rejections": q.all_broken(g.liquidation_guard(300.0, 250.0))},
    {"distance_bps": "round(abs(mark - liquidation) / greatest(abs(mark), 1e-9) * 10000, 4) + 0.0", "rejections": listed(("abs(mark - liquidation) / greatest(abs(mark), 1e-9) * 10000 < 300", "liquidation_distance_breach"), ("abs(mark - liquidation) / greatest(abs(mark), 1e-9) * 10000 - 250 < 300", "stress_liquidation_distance_breach"))},
    prepare=lambda df: df.withColumn("distance_bps", g.liquidation_distance("mark", "liquidation")), doc="B32: distance of the liquidation price, plain and under stress.",
)

gate(
    "b33_margin_check", "customer", "c_custkey", {"margin_mode": pick("c_custkey % 4", "isolated", "isolated", "cross", None), "leverage": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey % 3 AS INTEGER) + 1 END"},
    lambda: {"rejections": q.all_broken(g.margin_check("isolated", 2))}, {"rejections": listed(("margin_mode IS DISTINCT FROM 'isolated'", "margin_mode_mismatch"), ("leverage IS DISTINCT FROM 2", "leverage_mismatch"))}, doc="B33: margin mode and leverage as expected.",
)

gate(
    "b34_venue_order_validation", "lineitem", "l_orderkey, l_linenumber",
    {
        "quantity": "l_quantity / 1000 - CASE WHEN l_orderkey % 50 = 0 THEN 0.02 ELSE 0 END", "price": share("l_partkey % 3000 + CASE WHEN l_orderkey % 4 = 0 THEN 0 ELSE 100000 END", 8), "post_only": "l_orderkey % 3 = 0", "path": pick("l_linenumber % 2", "maker", "taker"), "side": pick("l_orderkey % 2", "BUY", "SELL"),
        "best_bid": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 12600.0 END", "best_ask": "12610.0", "time_in_force": pick("l_partkey % 3", "GTC", "GTX", None), "reduce_only": "l_suppkey % 4 = 0", "intent": pick("l_linenumber % 3", "open", "reduce", "close"),
        "position": "CASE WHEN l_suppkey % 8 = 0 THEN 0.0 ELSE -0.02 END", "submitted_at": "l_shipdate", "expires_at": "CASE WHEN l_orderkey % 11 = 0 THEN l_shipdate WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_shipdate + INTERVAL 1 HOUR END",
    },
    lambda: {"issues": q.all_broken(g.venue_order(5.0)), "rounded_quantity": r("rounded_quantity"), "rounded_price": r("rounded_price")},
    {
        "issues": listed(
            ("quantity <= 0", "quantity_must_be_positive"), ("price <= 0", "price_must_be_positive"), ("floor(quantity / 0.001::DOUBLE) * 0.001::DOUBLE <= 0", "quantity_below_step_size"), ("price <> round(round_even(price / 0.5::DOUBLE, 0) * 0.5::DOUBLE, 12)", "price_precision_violation"), ("floor(quantity / 0.001::DOUBLE) * 0.001::DOUBLE * price < 5", "min_notional_violation"),
            ("post_only AND path <> 'maker'", "post_only_requires_maker_path"), ("post_only AND CASE side WHEN 'BUY' THEN price >= best_ask ELSE price <= best_bid END", "post_only_would_take_liquidity"), ("time_in_force = 'GTX' AND NOT post_only", "gtx_requires_post_only"), ("reduce_only AND intent <> 'reduce'", "reduce_only_requires_reduce_intent"),
            ("reduce_only AND position = 0", "reduce_only_without_position"), ("reduce_only AND floor(quantity / 0.001::DOUBLE) * 0.001::DOUBLE > abs(position) + 1e-12", "reduce_only_quantity_exceeds_position"), ("expires_at <= submitted_at", "order_expired")),
        "rounded_quantity": "round(floor(quantity / 0.001::DOUBLE) * 0.001::DOUBLE, 6) + 0.0", "rounded_price": "round(round_even(price / 0.5::DOUBLE, 0) * 0.5::DOUBLE, 6) + 0.0",
    },
    prepare=lambda df: df.withColumn("rounded_quantity", g.round_down("quantity", 0.001)).withColumn("rounded_price", g.round_to_tick("price", 0.5)), doc="B34, H14: tick, step, notional, maker-only, reduce-only and expiry of an order.",
)

BAD_DOUBLE = "CASE {of} % 19 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN -1.0 ELSE {value} END"
NOT_FINITE = "NOT coalesce(isfinite({0}), false)"
gate(
    "b35_intent_validation", "orders", "o_orderkey",
    {
        "intent_id": "CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'i' END", "artifact_id": "CASE WHEN o_custkey % 37 = 0 THEN NULL ELSE 'a' END", "portfolio_plan_id": "'p'", "symbol": "o_orderstatus", "created_at": "'now'", "expires_at": "CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE 'later' END",
        "side": pick("o_orderkey % 3", "BUY", "SELL", "HOLD"), "intent_type": pick("o_custkey % 5", "open", "increase", "reduction", "close", "other"), "urgency": pick("o_orderkey % 4", "low", "normal", "urgent", None), "reduce_only_required": "o_custkey % 2 = 0",
        "desired_position_delta": BAD_DOUBLE.format(of="o_orderkey", value="CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE 1.5 END"), "max_slippage_bps": BAD_DOUBLE.format(of="o_custkey", value="5.0"), "max_spread_bps": BAD_DOUBLE.format(of="(o_custkey + 5)", value="4.0"), "max_participation_rate": share("o_orderkey % 13", 10),
        "funding_guard_policy": "CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE 'block' END", "liquidation_guard_policy": "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE 'block' END",
    },
    lambda: {"issues": q.all_broken(g.order_intent())},
    {
        "issues": listed(
            ("intent_id = ''", "missing_intent_id"), ("artifact_id IS NULL", "missing_artifact_id"), ("portfolio_plan_id = ''", "missing_portfolio_plan_id"), ("symbol = ''", "missing_symbol"), ("created_at = ''", "missing_created_at"), ("expires_at = ''", "missing_expires_at"), ("side = 'HOLD'", "invalid_side"), ("intent_type = 'other'", "invalid_intent_type"),
            ("urgency IS NULL", "invalid_urgency"), ("reduce_only_required AND side <> 'SELL'", "reduce_only_side_mismatch"), (NOT_FINITE.format("desired_position_delta"), "non_finite_desired_position_delta"), ("desired_position_delta = 0", "zero_desired_position_delta"),
            ("NOT (isfinite(max_slippage_bps) AND isfinite(max_spread_bps) AND isfinite(max_participation_rate))", "non_finite_risk_bound"), ("isfinite(max_slippage_bps) AND isfinite(max_spread_bps) AND (max_slippage_bps < 0 OR max_spread_bps < 0 OR max_participation_rate < 0)", "negative_risk_bound"),
            ("max_participation_rate > 1", "participation_rate_gt_one"), ("funding_guard_policy = ''", "missing_funding_guard_policy"), ("liquidation_guard_policy IS NULL", "missing_liquidation_guard_policy")),
    },
    doc="B35: validity of an order intent.",
)

gate(
    "b36_venue_requests", "orders", "o_orderkey",
    {"venue": "CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE 'binance' END", "symbol": "CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE o_orderstatus END", "side": pick("o_custkey % 4", "BUY", "SELL", "buy", None), "quantity": "CAST(o_orderkey % 10 AS DOUBLE) - 1", "type": pick("o_custkey % 3", "limit", "MARKET", "LIMIT"), "price": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END",
     "client_order_id": "CASE WHEN o_orderkey % 53 = 0 THEN '' ELSE 'c' END", "metadata_hash": "CASE WHEN o_orderkey % 59 = 0 THEN 'short' WHEN o_orderkey % 61 = 0 THEN NULL ELSE repeat('0', 64) END"},
    lambda: {"issues": q.all_broken(g.venue_request())},
    {"issues": listed(("venue = ''", "missing_venue"), ("symbol IS NULL", "missing_symbol"), ("side IS NULL OR side = 'buy'", "invalid_side"), ("quantity <= 0", "invalid_quantity"), ("type ILIKE 'limit' AND price IS NULL", "limit_price_required"), ("client_order_id = ''", "missing_client_order_id"), ("metadata_hash IS NULL OR metadata_hash = 'short'", "invalid_metadata_hash"))},
    doc="B36: validity of a request to the venue.",
)

TARGETS = ("target_weight", "target_notional", "max_loss_budget", "max_slippage_bps", "max_funding_cost_bps")
gate(
    "b37_symbol_targets", "customer", "c_custkey",
    {"symbol": "CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE c_name END", "artifact_id": "CASE WHEN c_custkey % 29 = 0 THEN '' ELSE 'a' END", "role": "c_mktsegment", **{t: BAD_DOUBLE.format(of=f"(c_custkey + {3 * i})", value="c_acctbal") for i, t in enumerate(TARGETS)}, "rebalance_reason": "CASE WHEN c_custkey % 23 = 0 THEN '' ELSE 'drift' END"},
    lambda: {"issues": q.all_broken(g.symbol_target())},
    {"issues": "concat_ws(',', CASE WHEN symbol IS NULL THEN 'missing_symbol' END, CASE WHEN artifact_id = '' THEN 'missing_artifact_id' END, CASE WHEN role = '' THEN 'missing_role' END, " + ", ".join(f"CASE WHEN NOT isfinite({t}) THEN 'non_finite_{t}' WHEN {t} < 0 THEN 'negative_{t}' END" for t in TARGETS) + ", CASE WHEN rebalance_reason = '' THEN 'missing_rebalance_reason' END)"},
    doc="B37: finite and non-negative amounts of a target.",
)

ADMISSION = ("exchange_status_trading", "usdm_linear_perp", "history_1h", "history_15m", "funding_history", "mark_price_history", "open_interest", "book_depth", "spread", "volume", "capacity", "slippage_model_confidence", "funding_stability", "correlation_cluster", "scenario_robustness", "paper_dry_run")
gate(
    "b38_symbol_admission", "part", "p_partkey", {f: f"CASE WHEN p_partkey % 67 = {i} THEN NULL ELSE (p_partkey + p_size * {i + 1}) % {i + 19} <> 0 END" for i, f in enumerate(ADMISSION)},
    lambda: {"rejections": q.all_broken(g.symbol_admission()), "paper_eligible": g.verdict(g.symbol_admission(), "yes", "no")},
    {"rejections": "array_to_string(list_filter([" + ", ".join(f"CASE WHEN coalesce({f}, false) THEN NULL ELSE '{f}' END" for f in ADMISSION) + "], lambda x: x IS NOT NULL), ',')", "paper_eligible": "CASE WHEN " + " AND ".join(f"coalesce({f}, false)" for f in ADMISSION) + " THEN 'yes' ELSE 'no' END"},
    doc="B38: sixteen gates of a symbol's admission to paper trading.",
)

gate(
    "b39_symbol_demotion", "supplier", "s_suppkey", {"data_gap": "s_suppkey % 17 = 0", "liquidity_failure": "s_nationkey = 5", "reconciliation_issue": "s_acctbal < -500", "slippage_shock": "s_acctbal > 9000", "funding_shock": "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey = 9 END", "repeated_strategy_failure": "s_suppkey % 23 = 0"},
    lambda: {"target_state": g.verdict(g.symbol_demotion(), "PAPER_ACTIVE", "REDUCE_ONLY"), "reasons": q.all_broken(g.symbol_demotion())},
    {"target_state": "CASE WHEN data_gap OR liquidity_failure OR reconciliation_issue OR slippage_shock OR coalesce(funding_shock, false) OR repeated_strategy_failure THEN 'REDUCE_ONLY' ELSE 'PAPER_ACTIVE' END",
     "reasons": listed(("data_gap", "data_gap"), ("liquidity_failure", "liquidity_failure"), ("reconciliation_issue", "reconciliation_issue"), ("slippage_shock", "slippage_shock"), ("funding_shock", "funding_shock"), ("repeated_strategy_failure", "repeated_strategy_failure"))},
    doc="B39: any trouble demotes a symbol to REDUCE_ONLY.",
)

gate(
    "b40_symbol_quarantine", "supplier", "s_suppkey", {"data_gap": "s_suppkey % 7 = 0", "reconciliation_issue": "s_acctbal < -500", "venue_rule_change": "s_nationkey = 3"},
    lambda: {"target_state": g.verdict(g.symbol_quarantine(), "PAPER_ACTIVE", "QUARANTINED"), "reasons": q.all_broken(g.symbol_quarantine())},
    {"target_state": "CASE WHEN data_gap OR reconciliation_issue OR venue_rule_change THEN 'QUARANTINED' ELSE 'PAPER_ACTIVE' END", "reasons": listed(("data_gap", "data_gap"), ("reconciliation_issue", "reconciliation_issue"), ("venue_rule_change", "venue_rule_change"))},
    doc="B40: what puts a symbol into quarantine.",
)

gate(
    "b22_data_sufficiency", "part", "p_partkey",
    {"symbol": pick("p_partkey % 4", "BTCUSDT", "ETHUSDT", "BTCUSDT", "SOLUSDT"), "venue": pick("p_partkey % 5", "binance", "Binance", "BINANCE", "binance", "bybit"), "timeframe": pick("p_size % 3", "1Hour", "15Min", "5Min"), "provider": pick("p_partkey % 6", "binance_perps", "binance_public_archive", "binance_public_ws_rest_bundle", "binance_perps", "csv", None),
     "n_bars": "p_partkey * 97 % 70000", "example_study": "p_size = 7", "has_source_hash": "p_partkey % 9 <> 0", "has_manifest": "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE true END", "n_flags": "p_size % 4 - 1", "n_issues": "p_partkey % 3", "liquidation_observed": "p_partkey % 2 = 0", "liquidation_dependent": "p_size % 2 = 0"},
    lambda: {"blockers": q.all_broken(g.data_blockers()), "status": g.verdict(g.data_blockers(), "research_ready", "blocked")},
    {"blockers": listed(("symbol NOT IN ('BTCUSDT', 'ETHUSDT')", "unsupported_strict_v3_symbol"), ("venue NOT ILIKE 'binance'", "unsupported_strict_v3_venue"), ("timeframe = '5Min'", "unsupported_strict_v3_timeframe"), ("example_study", "example_or_fixture_study"), ("provider IS NULL OR provider = 'csv'", "missing_real_source_provenance"), ("NOT has_source_hash", "missing_source_hash"), ("has_manifest IS NULL", "missing_fetch_manifest"),
                        ("timeframe = '1Hour' AND n_bars < 13140 OR timeframe = '15Min' AND n_bars < 52560", "insufficient_history_for_v3_improvement"), ("n_flags > 0", "snapshot_quality_flags_present"), ("n_issues > 0", "snapshot_quality_issues_present"), ("liquidation_dependent AND NOT liquidation_observed", "liquidation_feature_missing_observed_sidecar")),
     "status": "CASE WHEN blockers = '' THEN 'research_ready' ELSE 'blocked' END"},
    doc="B22: what blocks a study for want of data.",
)

METRICS = {
    "oos_sharpe": share("l_partkey % 40 - 8", 10), "sealed_holdout_sharpe": share("l_suppkey % 30 - 3", 10), "cpcv_pass": "l_orderkey % 6 <> 0", "bootstrap_pass_rate": share("l_orderkey % 101", 100), "spa_pass": "CASE WHEN l_orderkey % 8 = 0 THEN NULL ELSE l_orderkey % 5 <> 0 END", "pbo": share("l_partkey % 33", 100), "dsr": "CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE CAST(90 + l_partkey % 10 AS DOUBLE) / 100 END",
    "regime_pass_rate": share("60 + l_suppkey % 40", 100), "scenario_pass_rate": share("60 + l_partkey % 40", 100), "capacity_pass": "l_partkey % 7 <> 0", "slippage_bps": share("l_partkey % 300", 10), "trade_count": "l_orderkey % 200", "max_drawdown": share("0 - l_suppkey % 50", 100), "in_sample_sharpe": share("l_partkey % 50", 10),
}
DISTORTION = "(CASE WHEN abs(in_sample_sharpe) <= 1e-12 THEN 0.0 ELSE (in_sample_sharpe - oos_sharpe) / abs(in_sample_sharpe) END)"
ROBUST_SQL = [
    ("oos_sharpe <= 0", "oos_not_positive_post_cost"), ("sealed_holdout_sharpe <= 0", "sealed_holdout_not_positive_post_cost"), ("NOT cpcv_pass", "cpcv_failed"), ("bootstrap_pass_rate < 0.7", "bootstrap_stability_failed"), ("spa_pass IS DISTINCT FROM true", "spa_failed"), ("pbo > 0.2", "pbo_too_high"), ("dsr IS NULL OR dsr < 0.95", "deflated_sharpe_too_low"),
    ("regime_pass_rate < 0.7", "regime_stress_failed"), ("scenario_pass_rate < 0.7", "scenario_stress_failed"), ("NOT capacity_pass", "capacity_failed"), ("slippage_bps > 25", "slippage_too_high"), ("trade_count < 30", "insufficient_trade_count"), ("abs(max_drawdown) > 0.3", "drawdown_too_high"),
]
ROBUST_ALL_SQL = [("NOT causality_passed", "feature_causality_audit_failed"), ("n_buckets < 2", "insufficient_tournament_buckets"), ("n_symbols < 2", "symbol_specific_candidate"), ("n_regimes IS NULL OR n_regimes < 2", "regime_specific_candidate"), *ROBUST_SQL, (f"{DISTORTION} > 0.5", "is_to_oos_distortion_too_high")]
gate(
    "d34_robust_scorecard", "lineitem", "l_orderkey, l_linenumber", {"causality_passed": "l_orderkey % 11 <> 0", "n_buckets": "l_linenumber % 4", "n_symbols": "l_partkey % 4", "n_regimes": "CASE WHEN l_orderkey % 12 = 0 THEN NULL ELSE l_suppkey % 5 END", **METRICS},
    lambda: {"blockers": q.all_broken(g.robust_evaluation()), "distortion": r("distortion"), "score": lambda: r(g.robust_score("distortion"), 9)},
    {"blockers": listed(*ROBUST_ALL_SQL), "distortion": f"round({DISTORTION}, 6) + 0.0",
     "score": f"round(greatest(0.0::DOUBLE, 1.0::DOUBLE - ({' + '.join(f'CASE WHEN {p} THEN 1 ELSE 0 END' for p, _ in ROBUST_SQL)}) / 13.0::DOUBLE - greatest(0.0, {DISTORTION}) * 0.15::DOUBLE - least(0.5::DOUBLE, ({' + '.join(f'CASE WHEN {p} THEN 1 ELSE 0 END' for p, _ in ROBUST_ALL_SQL)}) * 0.03::DOUBLE)), 9) + 0.0"},
    prepare=lambda df: df.withColumn("distortion", g.distortion("in_sample_sharpe", "oos_sharpe")), doc="D34: thirteen gates, four preconditions, distortion and the score of a robust evaluation.",
)

gate(
    "d36_sealed_holdout", "orders", "o_orderkey", {"robustness_ready": "o_orderkey % 7 <> 0", "trade_count": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_custkey % 150 END", "post_cost_return": share("o_orderkey % 50 - 5", 100), "sharpe": share("o_custkey % 40 - 4", 10), "max_drawdown": share("0 - o_orderkey % 45", 100)},
    lambda: {"failure_class": q.first_broken(g.sealed_holdout(), "sealed_holdout_passed")},
    {"failure_class": "CASE WHEN NOT robustness_ready THEN 'robust_eval_not_ready' WHEN trade_count IS NULL OR trade_count < 30 THEN 'insufficient_trades' WHEN post_cost_return <= 0 THEN 'negative_post_cost_return' WHEN sharpe <= 0 THEN 'low_holdout_sharpe' WHEN abs(max_drawdown) > 0.3 THEN 'excess_drawdown' ELSE 'sealed_holdout_passed' END"},
    doc="D36: only the class of the first failure is shown.",
)

PROMOTION_FLAGS = ("turnover_within_budget", "baselines_present", "plateau_ok", "bootstrap_ok", "regime_ok", "reproducible")
gate(
    "d40_promotion_gates", "orders", "o_orderkey",
    {"venue": pick("o_orderkey % 12", *["Binance"] * 11, "bybit"), "execution_model_id": pick("o_custkey % 15", *["usdm_v3"] * 14, "flat"), "signal_timeframe": "'1h'", "execution_timeframe": "'15m'", "cv_method": "'combinatorial_purged_cv'", "n_blocks": "6 + o_orderkey % 12", "n_test_blocks": "2 + o_custkey % 3", "purge_bars": "o_orderkey % 9 - 1", "embargo_bars": "4",
     "months_of_data": share("o_orderkey % 60", 2), "all_data_since_listing": "o_custkey % 4 = 0", "n_folds": "5 + o_orderkey % 20", "trade_count": "o_custkey % 300", "n_episodes": "o_orderkey % 60", "net_pnl": share("o_orderkey % 90 - 10", 100), "sharpe": share("o_custkey % 35", 10), "max_drawdown": share("0 - o_orderkey % 25", 100),
     "capacity_5x_edge_erosion": "CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE CAST(o_custkey % 28 AS DOUBLE) / 100 END", "capacity_5x_fill_completion": share("92 + o_orderkey % 8", 100), "dsr": share("93 + o_custkey % 7", 100), "pbo": share("o_orderkey % 23", 100), "spa_pvalue": share("o_custkey % 60", 1000), "cpcv_median": share("60 + o_orderkey % 70", 100), "cpcv_p10": share("o_custkey % 50 - 3", 100),
     "n_liquidations": "CASE WHEN o_orderkey % 21 = 0 THEN 1 ELSE 0 END", "n_rule_failures": "CASE WHEN o_custkey % 22 = 0 THEN 1 ELSE 0 END", **{f: f"o_orderkey % {13 + i} <> 0" for i, f in enumerate(PROMOTION_FLAGS)}},
    lambda: {"decision": g.verdict(g.promotion("usdm_v3"), "accept", "reject"), "primary_failure": q.first_broken(g.promotion("usdm_v3"), ""), "failed": q.all_broken(g.promotion("usdm_v3"))},
    {"decision": "CASE WHEN failed = '' THEN 'accept' ELSE 'reject' END", "primary_failure": "string_split(failed, ',')[1]",
     "failed": listed(("venue <> 'Binance' OR execution_model_id <> 'usdm_v3'", "venue_model"), ("n_blocks < 8 OR n_blocks > 16 OR n_test_blocks > 3 OR purge_bars < 0", "validation_method"), ("months_of_data < 18 AND NOT all_data_since_listing", "data_length"), ("n_folds < 8", "walk_forward_folds"), ("trade_count < 120 AND n_episodes < 30", "trade_or_episode_count"), ("net_pnl <= 0", "positive_post_cost"), ("sharpe < 1", "sharpe"),
                      ("CASE WHEN max_drawdown = 0 THEN net_pnl <= 0 ELSE net_pnl / abs(max_drawdown) < 0.75 END", "calmar"), ("max_drawdown < -0.2", "max_drawdown"), ("NOT turnover_within_budget", "turnover_budget"), ("capacity_5x_edge_erosion IS NULL OR capacity_5x_edge_erosion >= 0.25 OR capacity_5x_fill_completion < 0.95", "capacity_5x"), ("dsr < 0.95", "dsr"), ("pbo >= 0.2", "pbo"), ("spa_pvalue >= 0.05", "spa"),
                      ("cpcv_median <= 0.75 OR cpcv_p10 <= 0", "cpcv"), ("n_liquidations > 0", "no_liquidation"), ("n_rule_failures > 0", "execution_rules"), ("NOT baselines_present", "baseline_set"), ("NOT plateau_ok", "parameter_plateau"), ("NOT bootstrap_ok", "bootstrap_monte_carlo"), ("NOT regime_ok", "regime_conditional"), ("NOT reproducible", "reproducibility"))},
    prepare=lambda df: df.withColumn("calmar", g.calmar("net_pnl", "max_drawdown")), doc="D40: twenty-two gates of a promotion, the first failure and all of them.",
)

gate(
    "d41_validation_gates", "orders", "o_orderkey",
    {"net_pnl": share("o_orderkey % 90 - 10", 100), "max_drawdown": share("0 - o_custkey % 28", 100), "sharpe": share("o_custkey % 35", 10), "capacity_5x_edge_erosion": "CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE CAST(o_custkey % 28 AS DOUBLE) / 100 END", "capacity_5x_fill_completion": share("92 + o_orderkey % 8", 100), "turnover_within_budget": "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END",
     "oos_trades": "o_orderkey % 400", "scenario_passed": "o_custkey % 5 <> 0", "regime_passed": "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderkey % 4 <> 0 END"},
    lambda: {"failed": q.all_broken(g.validation_gates())},
    {"failed": listed(("sharpe < 1", "final_holdout_sharpe_below_floor"), ("CASE WHEN max_drawdown = 0 THEN net_pnl <= 0 ELSE net_pnl / abs(max_drawdown) < 0.75 END", "final_holdout_calmar_below_floor"), ("max_drawdown < -0.2", "final_holdout_drawdown_breached_cap"), ("capacity_5x_edge_erosion IS NULL OR capacity_5x_edge_erosion >= 0.25 OR capacity_5x_fill_completion < 0.95", "capacity_5x_degradation_or_fill_failed"),
                      ("NOT turnover_within_budget", "turnover_budget_exceeded"), ("turnover_within_budget IS NULL", "turnover_budget_missing"), ("oos_trades < 120", "min_oos_trades_below_floor"), ("NOT scenario_passed", "scenario_pass_matrix_failed"), ("regime_passed IS DISTINCT FROM true", "regime_pass_matrix_failed"))},
    prepare=lambda df: df.withColumn("calmar", g.calmar("net_pnl", "max_drawdown")), doc="D41: the eight gates of the default validation specification.",
)

gate(
    "d42_candidate_verdict", "lineitem", "l_orderkey, l_linenumber",
    {"oos_trades": "l_orderkey % 900", "train_drawdown": share("0 - l_partkey % 30", 100), "old_train_drawdown": share("0 - l_suppkey % 30 - 5", 100), "oos_sharpe": share("l_partkey % 40", 10), "old_oos_sharpe": share("l_suppkey % 30", 10), "worst_drawdown": share("0 - l_orderkey % 28", 100), "n_liquidations": "CASE WHEN l_orderkey % 25 = 0 THEN 1 ELSE 0 END",
     "old_oos_drawdown": share("0 - l_partkey % 20", 100), "median_profit": share("l_orderkey % 100", 100), "old_oos_pnl": share("l_suppkey % 110", 100)},
    lambda: {"verdict": lambda: g.candidate_verdict(), "reasons": q.all_broken(g.candidate_rules())},
    {"verdict": "CASE WHEN reasons <> '' THEN 'reject' WHEN (oos_sharpe - old_oos_sharpe) / greatest(abs(old_oos_sharpe), 1e-9) < 0.02 AND (greatest(abs(old_oos_drawdown), 1e-9) - abs(worst_drawdown)) / greatest(abs(old_oos_drawdown), 1e-9) < 0.1 AND (median_profit - old_oos_pnl) / greatest(abs(old_oos_pnl), 1e-9) < 0.05 THEN 'wash' ELSE 'accept' END",
     "reasons": listed(("oos_trades < 100", "min_oos_trades"), ("abs(train_drawdown) > abs(old_train_drawdown) * 1.05::DOUBLE", "train_drawdown_cap"), ("oos_sharpe < old_oos_sharpe * 0.95::DOUBLE", "oos_sharpe_floor"), ("worst_drawdown <= -0.25", "bootstrap_kill_switch"), ("n_liquidations > 0", "liquidation_events"))},
    doc="D42: accept, wash or reject a candidate against the incumbent.",
)

gate(
    "d43_overfit_budget", "lineitem", "l_orderkey, l_linenumber", {"trials": "l_partkey % 130 - 2", "strategy_variants": "l_suppkey % 14", "parameter_reuse": "l_linenumber - 1", "failed_gate_retries": "l_orderkey % 6 - 1", "pbo": "CASE WHEN l_orderkey % 31 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(l_partkey % 40 AS DOUBLE) / 100 END"},
    lambda: {"reasons": q.all_broken(g.overfit_budget(100, 10, 5, 3, 0.2))},
    {"reasons": listed(("trials < 0", "negative_trials"), ("strategy_variants < 0", "negative_strategy_variants"), ("parameter_reuse < 0", "negative_parameter_reuse"), ("failed_gate_retries < 0", "negative_failed_gate_retries"), ("isnan(pbo)", "non_finite_pbo"), ("trials > 100", "max_trials_exceeded"), ("strategy_variants > 10", "max_strategy_variants_exceeded"), ("parameter_reuse > 5", "max_parameter_reuse_exceeded"), ("failed_gate_retries > 3", "max_failed_gate_retries_exceeded"), ("NOT isnan(pbo) AND pbo > 0.2", "pbo_ceiling_exceeded"))},
    doc="D43: the budget of trials, variants, reuse and retries.",
)

FORWARD_INPUTS = {
    "paper_orders": "CASE WHEN l_orderkey % 11 = 0 THEN 0 ELSE l_orderkey % 40 END", "filled": "CASE WHEN l_orderkey % 11 = 0 THEN 0 ELSE l_orderkey % 40 END - l_linenumber % 3", "rejected": "l_linenumber % 2", "risk_blocked": "l_partkey % 2", "queue_fill": share("l_partkey % 12", 10), "slip_bps": f"CASE WHEN l_partkey % 17 <> 0 THEN {share('l_partkey % 600', 20)} - 5 END",
    "lag_ms": "CASE WHEN l_suppkey % 13 <> 0 THEN l_suppkey % 90 * 25 END", "funding_bps": f"CASE WHEN l_orderkey % 19 <> 0 THEN {share('l_orderkey % 120', 10)} END", "window_ready": "l_partkey % 9 <> 0", "sidecar_ready": "l_orderkey % 7 <> 0", "telemetry_quality": share("60 + l_partkey % 40", 100),
    "participation": f"CASE WHEN l_suppkey % 23 <> 0 THEN {share('l_suppkey % 60', 1000)} END", "completion": f"CASE WHEN l_suppkey % 23 <> 0 THEN {share('70 + l_orderkey % 30', 100)} END", "erosion_bps": f"CASE WHEN l_suppkey % 23 <> 0 THEN {share('l_partkey % 280', 10)} END",
}
_LEFT = lambda x, limit: f"coalesce(round(greatest(0.0, least(1.0, 1.0 - abs({x}) / {limit})), 6), 0.0) + 0.0"
FORWARD_SQL = {
    "slippage_score": _LEFT("slip_bps", "25.0"), "fill_score": "round(CASE WHEN paper_orders > 0 THEN greatest(0.0, least(1.0, (filled - rejected - risk_blocked)::DOUBLE / paper_orders)) ELSE greatest(0.0, least(1.0, coalesce(queue_fill, 0))) END, 6) + 0.0",
    "latency_score": _LEFT("lag_ms", "2000.0"), "funding_score": _LEFT("funding_bps", "10.0"), "liquidation_score": "CASE WHEN window_ready AND sidecar_ready THEN 1.0::DOUBLE ELSE 0.0 END",
    "capacity_score": "coalesce(round(greatest(0.0, least(1.0, completion * 0.5::DOUBLE + (1 - least(participation / 0.05::DOUBLE, 1.0)) * 0.25::DOUBLE + (1 - least(erosion_bps / 25.0::DOUBLE, 1.0)) * 0.25::DOUBLE)), 6), 0.0) + 0.0",
}

gate(
    "d35_paper_forward_score", "lineitem", "l_orderkey, l_linenumber", FORWARD_INPUTS,
    lambda: {k: (lambda k=k: r(c(k), 9)) for k in (*g.FORWARD_PARTS, "score")} | {"blockers": q.all_broken(g.forward_blockers())},
    FORWARD_SQL | {"score": "round((slippage_score + fill_score + latency_score + funding_score + liquidation_score + capacity_score) / 6, 9) + 0.0", "blockers": listed(
        ("completion IS NULL", "capacity_evidence_missing"), ("erosion_bps > 25", "capacity_edge_erosion_too_high"), ("completion < 0.8", "capacity_fill_quality_low"), ("participation > 0.05", "capacity_participation_too_high"), (f"{FORWARD_SQL['fill_score']} <= 0", "fill_evidence_missing"),
        ("funding_bps IS NULL", "funding_evidence_missing"), ("lag_ms IS NULL", "latency_evidence_missing"), ("NOT sidecar_ready", "liquidation_sidecar_missing"), (f"{FORWARD_SQL['fill_score']} > 0 AND {FORWARD_SQL['fill_score']} < 0.8", "paper_fill_quality_low"), ("funding_bps > 10", "paper_funding_shock_too_high"),
        ("lag_ms > 2000", "paper_latency_too_high"), ("paper_orders < 10", "paper_sample_too_small"), ("abs(slip_bps) > 25", "paper_slippage_too_high"), ("telemetry_quality < 0.7", "paper_telemetry_quality_low"), ("NOT window_ready", "public_ws_window_not_ready"), ("slip_bps IS NULL", "slippage_evidence_missing"))},
    prepare=lambda df: df.withColumns(g.forward_scores()), doc="D35: six parts of a candidate's paper-forward score, their mean and what blocks it.",
)

gate(
    "d44_fast_screen", "lineitem", "l_orderkey, l_linenumber", {"oos_trades": "l_orderkey % 300", "n_returns": "l_partkey % 90", "min_length": "l_suppkey % 60", "n_liquidations": "CASE WHEN l_orderkey % 15 = 0 THEN 2 ELSE 0 END", "funding": "l_tax * l_extendedprice", "gross_pnl": "l_discount * l_extendedprice - 1000", "fees": "l_quantity"},
    lambda: {"drag": r("drag", 9), "reasons": q.all_broken(g.fast_screen(30))},
    {"drag": "round(abs(funding) / (abs(gross_pnl) + abs(fees) + 1e-9), 9) + 0.0", "reasons": listed(("oos_trades < 30", "fast_screen_min_oos_trades"), ("n_returns <> 0 AND n_returns < min_length", "fast_screen_minimum_backtest_length"), ("n_liquidations > 0", "fast_screen_liquidation_events"), ("abs(funding) / (abs(gross_pnl) + abs(fees) + 1e-9) >= 0.5", "fast_screen_excessive_funding_drag"))},
    prepare=lambda df: df.withColumn("drag", g.funding_drag("funding", "gross_pnl", "fees")), doc="D44: fast screen of a backtest and its funding drag.",
)

gate(
    "d86_forecast_decay_gate", "lineitem", "l_orderkey, l_linenumber", {"baseline_edge": share("l_partkey % 50 - 5", 1000), "calibration_error": share("l_suppkey % 20", 100), "directional_decay": share("l_orderkey % 40", 100), "staleness_seconds": "l_partkey % 5000", "symbol_coverage": share("60 + l_orderkey % 40", 100)},
    lambda: {"state": g.verdict(g.forecast_decay(0.01, 0.15, 0.3, 3600, 0.8), "FEATURE_ALLOWED", "DISABLED"), "reasons": q.all_broken(g.forecast_decay(0.01, 0.15, 0.3, 3600, 0.8))},
    {"state": "CASE WHEN reasons = '' THEN 'FEATURE_ALLOWED' ELSE 'DISABLED' END", "reasons": listed(("baseline_edge < 0.01", "baseline_edge_below_min"), ("calibration_error > 0.15", "calibration_error_above_max"), ("directional_decay > 0.3", "directional_decay_above_max"), ("staleness_seconds > 3600", "staleness_above_max"), ("symbol_coverage < 0.8", "symbol_coverage_below_min"))},
    doc="D86: whether a forecast may still serve as a research feature.",
)

gate(
    "i31_tactic_choice", "orders", "o_orderkey", {"risk_state": pick("o_orderkey % 12", "HALT", "REDUCE_ONLY", "LOCKDOWN", *["NORMAL"] * 5, "CAUTION", "CAUTION", "DEFENSIVE", None), "action": pick("o_custkey % 3", "open", "close", "reduce"), "spread_bps": share("o_custkey % 50", 10), "fill_probability": share("o_orderkey % 100", 100), "adverse_bps": share("o_custkey % 40", 10), "drift_bps": "o_orderkey % 150", "n_open_orders": "o_custkey % 8"},
    lambda: {"tactic": lambda: g.tactic()},
    {"tactic": "CASE WHEN risk_state = 'HALT' THEN 'SKIP' WHEN risk_state IN ('REDUCE_ONLY', 'LOCKDOWN') AND action = 'close' THEN 'CLOSE' WHEN risk_state IN ('REDUCE_ONLY', 'LOCKDOWN') THEN 'REDUCE_ONLY' WHEN spread_bps <= 2 AND fill_probability >= 0.7 AND adverse_bps <= 2 THEN 'POST_ONLY_GTX' WHEN drift_bps > 100 OR fill_probability < 0.3 THEN 'IOC' WHEN n_open_orders > 3 THEN 'DELAY' ELSE 'AGGRESSIVE_LIMIT' END"},
    doc="I31: the tactic of an order.",
)

gate(
    "i34_lifecycle_policy", "customer", "c_custkey",
    {"state": pick("c_custkey % 3", "paper", "tiny_live", "pilot_live"), "n_liquidations": "CASE WHEN c_custkey % 31 = 0 THEN 1 ELSE 0 END", "checksum_valid": "c_custkey % 37 <> 0", "venue_rules_match": "CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE true END", "pauses_90d": "c_custkey % 20 / 9", "holdout_assumptions_invalidated": "c_nationkey = 24", "live_sharpe_30d": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey % 40 - 10 AS DOUBLE) / 10 END",
     "live_samples": "c_custkey % 60", "slippage_over_modeled_5d": share("c_custkey % 24", 10), "fill_rejection_cluster": "c_nationkey = 1", "drawdown_limit_breached": "c_nationkey = 2", "capacity_drift_breached": "c_nationkey = 3", "data_quality_degraded": "c_acctbal < -900", "validation_expired": "c_custkey % 5 = 0", "scenario_pack_changed": "c_custkey % 7 = 0", "venue_api_rules_changed": "c_custkey % 9 = 0"},
    lambda: {"next_state": lambda: g.lifecycle()[0], "revalidate": lambda: g.lifecycle()[1], "reasons": lambda: g.lifecycle()[2]},
    {"next_state": "CASE WHEN gone <> '' THEN 'retired' WHEN held <> '' THEN 'paused' ELSE state END", "revalidate": "gone = '' AND held = '' AND again <> ''", "reasons": "CASE WHEN gone <> '' THEN gone WHEN held <> '' THEN held ELSE again END"},
    prepare=lambda df: df, doc="I34: retire before pause before revalidation.",
)
_gone = listed(("n_liquidations > 0", "liquidation"), ("NOT checksum_valid", "artifact_checksum_mismatch"), ("venue_rules_match IS NULL", "venue_rule_mismatch"), ("pauses_90d >= 2", "two_pauses_within_90d"), ("holdout_assumptions_invalidated", "holdout_assumptions_invalidated"))
_held = listed(("live_sharpe_30d < -0.5 AND live_samples >= 30", "trailing_30d_live_sharpe_below_floor"), ("slippage_over_modeled_5d > 2", "realized_slippage_gt_2x_modeled_5d"), ("fill_rejection_cluster", "fill_rejection_cluster"), ("drawdown_limit_breached", "drawdown_limit_breached"), ("capacity_drift_breached", "capacity_drift_breached"), ("data_quality_degraded", "data_quality_degraded"))
_again = listed(("validation_expired", "validation_expired"), ("scenario_pack_changed", "scenario_pack_changed"), ("venue_api_rules_changed", "venue_api_rules_changed"))
ORACLES["i34_lifecycle_policy"] = ORACLES["i34_lifecycle_policy"].replace("FROM given", f"FROM (SELECT *, {_gone} AS gone, {_held} AS held, {_again} AS again FROM given)")

CODES = ("slippage_fragile", "regime_specific_only", "capacity_fail", "feature_leakage", "other")
gate(
    "l33_failure_routing", "orders", "o_orderkey", {"codes": "concat_ws(',', " + ", ".join(f"CASE WHEN o_orderkey % {i + 3} = 0 THEN '{code}' END" for i, code in enumerate((*CODES, *CODES[:2]))) + ")"},
    lambda: {"action": lambda: g.routed("list")[0], "secondary": lambda: F.array_join(g.routed("list")[1], ",")},
    {"action": "CASE WHEN codes LIKE '%feature_leakage%' THEN 'block_candidate' ELSE coalesce(acts[1], 'promote_to_paper_forward_review') END", "secondary": "array_to_string(list_filter(acts, lambda x: x <> CASE WHEN codes LIKE '%feature_leakage%' THEN 'block_candidate' ELSE coalesce(acts[1], '') END), ',')"},
    prepare=lambda df: df.withColumn("list", F.split("codes", ",")), doc="L33: actions of failure codes, a block first, else in the order of the codes.",
)
ORACLES["l33_failure_routing"] = ORACLES["l33_failure_routing"].replace("FROM given", "FROM (SELECT *, list_filter([CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 8 = 0 THEN 'cost_execution_research' END, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 9 = 0 THEN 'regime_scope_research' END, CASE WHEN o_orderkey % 5 = 0 THEN 'sizing_liquidity_research' END, CASE WHEN o_orderkey % 6 = 0 THEN 'block_candidate' END], lambda x: x IS NOT NULL) AS firsts, [CASE WHEN o_orderkey % 3 = 0 THEN 'cost_execution_research' END, CASE WHEN o_orderkey % 4 = 0 THEN 'regime_scope_research' END, CASE WHEN o_orderkey % 5 = 0 THEN 'sizing_liquidity_research' END, CASE WHEN o_orderkey % 6 = 0 THEN 'block_candidate' END, CASE WHEN o_orderkey % 8 = 0 AND o_orderkey % 3 <> 0 THEN 'cost_execution_research' END, CASE WHEN o_orderkey % 9 = 0 AND o_orderkey % 4 <> 0 THEN 'regime_scope_research' END] AS every, list_filter(every, lambda x: x IS NOT NULL) AS acts FROM given)")

GATES = ("holdout_sharpe", "min_sample", "order_reject", "missing_fill", "stale_book", "stress", "scenario", "slippage", "funding", "trade_authority")
gate(
    "l34_failure_router", "lineitem", "l_orderkey, l_linenumber", {"failed_gate": pick("l_partkey % 10", *GATES), "repeats": "l_linenumber - 1"},
    lambda: {"family": lambda: g.failure_route("failed_gate", "repeats")[0], "action": lambda: g.failure_route("failed_gate", "repeats")[1], "memory_reason": lambda: g.failure_route("failed_gate", "repeats")[2], "exact_family": lambda: g.failure_family("failed_gate")},
    {"family": "CASE WHEN failed_gate IN ('holdout_sharpe', 'min_sample') THEN 'validation_failures' WHEN failed_gate IN ('order_reject', 'missing_fill') THEN 'execution_failures' WHEN failed_gate = 'stale_book' THEN 'data_failures' ELSE 'agent_policy_failures' END",
     "action": "CASE WHEN repeats >= 3 THEN 'stop' WHEN failed_gate IN ('stress', 'scenario') THEN 'stress' WHEN failed_gate IN ('slippage', 'funding') THEN 'calibrate' ELSE 'narrow' END", "memory_reason": "family || ':' || failed_gate || ':repeated=' || repeats || ':action=' || action",
     "exact_family": "CASE failed_gate WHEN 'holdout_sharpe' THEN 'validation_failures' WHEN 'min_sample' THEN 'validation_failures' WHEN 'order_reject' THEN 'execution_failures' WHEN 'missing_fill' THEN 'execution_failures' WHEN 'stale_book' THEN 'data_failures' WHEN 'trade_authority' THEN 'agent_policy_failures' ELSE 'unknown_failures' END"},
    doc="L34, L35: family and action of a repeated failure, and the family by exact name.",
)

gate(
    "l49_candidate_rejection", "part", "p_partkey",
    {"approved": "p_partkey % 13 <> 0", "manifest_reason": pick("p_partkey % 17", "missing_promotion_manifest", "gate_failed"), "symbols_text": "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_brand END", "regimes_text": "CASE WHEN p_size % 11 = 0 THEN NULL ELSE 'bull,chop' END", "role": pick("p_size % 7", "core", "defensive", "opportunistic", "carry", "crash_hedge", "other", None),
     "state": pick("p_partkey % 9", "paper", "shadow_live", "tiny_live", "pilot_live", "scaled_live", "paper", "paused", "paper", "backtest"), "active": pick("p_size % 4", "bull", "chop", "crash", "bull")},
    lambda: {"rejection": q.first_broken(g.candidate_rejection(), "accepted")},
    {"rejection": "CASE WHEN NOT approved THEN 'artifact_not_approved' WHEN manifest_reason = 'missing_promotion_manifest' THEN 'missing_promotion_manifest' WHEN manifest_reason IS NOT NULL THEN 'artifact_not_paper_eligible' WHEN symbols_text IS NULL THEN 'missing_symbol_scope' WHEN regimes_text IS NULL THEN 'missing_regime_scope' WHEN role IS NULL OR role = 'other' THEN 'invalid_portfolio_role' WHEN state IN ('paused', 'backtest') THEN 'artifact_not_active' WHEN active = 'crash' THEN 'regime_scope_mismatch' ELSE 'accepted' END"},
    prepare=lambda df: df.withColumn("symbols", F.split("symbols_text", ",")).withColumn("regimes", F.split("regimes_text", ",")).withColumn("active_regimes", F.array("active")), doc="L49: why a candidate gets no allocation, the first reason.",
)

gate(
    "l61_allowed_actions", "supplier", "s_suppkey", {"state": pick("s_suppkey % 7", "NORMAL", "CAUTION", "DEFENSIVE", "REDUCE_ONLY", "LOCKDOWN", "HALT", None)}, lambda: {"actions": g.allowed_actions("state")},
    {"actions": "CASE WHEN state IN ('NORMAL', 'CAUTION') THEN 'close,increase,open,reduce' WHEN state IN ('DEFENSIVE', 'REDUCE_ONLY') THEN 'close,reduce' WHEN state = 'LOCKDOWN' THEN 'cancel,close,reconcile' ELSE '' END"}, doc="L61: what a risk state allows.",
)

COMPATIBLE = ("binance", "1h", "15m", "usdm_v3", "contract-1", 50000.0, ("BTCUSDT", "ETHUSDT"))
gate(
    "l68_artifact_compatibility", "part", "p_partkey",
    {"venue": pick("p_partkey % 8", *["binance"] * 6, "bybit", None), "signal_timeframe": pick("p_size % 6", *["1h"] * 5, "4h"), "execution_timeframe": pick("p_size % 7", *["15m"] * 6, "1h"), "execution_model": pick("p_partkey % 5", *["usdm_v3"] * 4, "flat"), "symbols_text": pick("p_partkey % 6", "BTCUSDT", "ETHUSDT", "BTCUSDT,ETHUSDT", "BTCUSDT,SOLUSDT", None, "ETHUSDT"),
     "contract_hash": pick("p_size % 5", "contract-1", "contract-1", "contract-1", "contract-2", None), "max_notional": "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_retailprice * 40 END"},
    lambda: {"reasons": q.all_broken(g.artifact_compatibility(*COMPATIBLE))},
    {"reasons": listed(("venue IS NULL OR venue <> 'binance'", "venue"), ("signal_timeframe <> '1h'", "signal_timeframe"), ("execution_timeframe <> '15m'", "execution_timeframe"), ("execution_model <> 'usdm_v3'", "execution_model"), ("symbols_text IS NULL OR symbols_text LIKE '%SOL%'", "symbol_universe"), ("contract_hash IS NULL OR contract_hash <> 'contract-1'", "feature_contract"), ("max_notional > 50000", "risk_limits"))},
    prepare=lambda df: df.withColumn("symbols", F.split("symbols_text", ",")), doc="L68: whether an artifact fits the running system.",
)

PROOFS = ("full_validation_pass", "paper_stability_pass", "telemetry_complete", "paper_live_divergence_within_band", "live_risk_calibrated", "live_cost_calibrated", "no_unresolved_risk_events", "explicit_user_approval", "revalidation_pass")
_stage = ("backtest", "paper", "shadow_live", "tiny_live", "pilot_live", "scaled_live")
gate(
    "l69_rollout_transition", "orders", "o_orderkey", {"from_stage": pick("o_orderkey % 7", *_stage, "paused"), "to_stage": pick("(o_orderkey % 7 + CASE WHEN o_custkey % 4 = 0 THEN 2 ELSE 1 END) % 7", *_stage, "retired"), "proven": "concat_ws(',', " + ", ".join(f"CASE WHEN o_custkey % {i + 2} <> 0 THEN '{p}' END" for i, p in enumerate(PROOFS)) + ")"},
    lambda: {"reasons": lambda: F.array_join(g.rollout_reasons(), ",")},
    {"reasons": "CASE WHEN from_stage = 'paused' OR to_stage = 'retired' THEN 'rollout_stage_not_active' "
     + " ".join(f"WHEN from_stage = '{a}' AND to_stage = '{b}' THEN " + listed(*((f"NOT list_contains(string_split(proven, ','), '{n}')", f"missing_gate_evidence:{n}") for n in names))
                for a, b, names in (("backtest", "paper", PROOFS[:1]), ("paper", "shadow_live", PROOFS[1:3]), ("shadow_live", "tiny_live", PROOFS[3:4]), ("tiny_live", "pilot_live", PROOFS[4:7]), ("pilot_live", "scaled_live", PROOFS[7:])))
     + " ELSE 'rollout_stage_skip_not_allowed' END"},
    prepare=lambda df: df.withColumn("evidence", F.split("proven", ",")), doc="L69: the evidence that a step of a roll-out needs.",
)

gate(
    "b19_feature_contracts", "part", "p_partkey",
    {"name": "CASE WHEN p_partkey % 31 = 0 THEN '' ELSE p_name END", "source": "CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE 's' END", "timestamp_source": "'close'", "earliest_available_at": "CASE WHEN p_partkey % 29 = 0 THEN '' ELSE 'close+1' END", "max_age_seconds": BAD_DOUBLE.format(of="p_partkey", value="3600.0"), "modes_text": pick("p_size % 3", "research", "research,paper", "live"), "leakage_risk": pick("p_partkey % 2", "low", "research_only"),
     "lookback_bars": "p_size - 2", "warmup_bars": "p_partkey % 9 - 1", "availability_lag_bars": "p_partkey % 11 - 1", "uses_centered_window": "p_partkey % 13 = 0", "uses_negative_shift": "p_partkey % 17 = 0", "uses_future_bars": "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_partkey % 23 = 0 END", "allows_repainting": "p_size = 9", "smoothing": pick("p_size % 6", "Causal", "none", "recursive", "EXPANDING", "centered", None)},
    lambda: {"issues": q.all_broken(g.feature_contract())},
    {"issues": listed(("name = ''", "missing_name"), ("source IS NULL", "missing_source"), ("timestamp_source = ''", "missing_timestamp_source"), ("earliest_available_at = ''", "missing_earliest_available_at"), ("NOT isfinite(max_age_seconds)", "non_finite_max_age_seconds"), ("isfinite(max_age_seconds) AND max_age_seconds < 0", "negative_max_age_seconds"), ("leakage_risk = 'research_only' AND modes_text IN ('research,paper', 'live')", "research_only_execution_mode_allowed"), ("lookback_bars < 0", "negative_lookback_bars"),
                      ("warmup_bars < 0", "negative_warmup_bars"), ("availability_lag_bars < 0", "negative_availability_lag_bars"), ("uses_centered_window", "centered_window"), ("uses_negative_shift", "negative_shift"), ("uses_future_bars", "future_bars"), ("allows_repainting", "repainting_allowed"), ("smoothing IS NULL OR smoothing = 'centered'", "non_causal_smoothing"))},
    prepare=lambda df: df.withColumn("modes", F.split("modes_text", ",")), doc="B19: validity of a feature's contract.",
)

gate(
    "l78_forecast_embargo", "orders", "o_orderkey", {"source_at": "o_orderdate", "available_at": "o_orderdate + INTERVAL 2 DAY", "decided_at": "CASE o_custkey % 3 WHEN 0 THEN o_orderdate - INTERVAL 1 DAY WHEN 1 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 2 DAY END", "execution_mode": "o_orderstatus = 'F'", "execution_available": "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 5 <> 0 END", "embargo_seconds": "o_custkey % 100 - 3"},
    lambda: {"reasons": q.all_broken(g.forecast_embargo())},
    {"reasons": listed(("o_custkey_day = 0", "forecast_timestamp_after_decision_time"), ("o_custkey_day < 2", "forecast_feature_embargo_active"), ("execution_mode AND execution_available IS DISTINCT FROM true", "forecast_not_execution_available"), ("embargo_seconds < 0", "embargo_seconds_negative"))},
    doc="L78: whether a forecast may be looked at when a decision is made.",
)
ORACLES["l78_forecast_embargo"] = ORACLES["l78_forecast_embargo"].replace("SELECT o_orderkey, o_orderdate AS source_at", "SELECT o_orderkey, o_custkey % 3 AS o_custkey_day, o_orderdate AS source_at")

_states = ("CANDIDATE", "VALIDATED", "PROMOTED", "SHADOW", "PAPER_ACTIVE", "WATCH", "DEGRADED", "REDUCE_ONLY", "QUARANTINED", "RETIRED")
gate(
    "l70_allowed_steps", "orders", "o_orderkey", {"current": pick("o_orderkey % 11", *_states, None), "target": pick("o_custkey % 10", *_states), "risk": pick("o_custkey % 7", "NORMAL", "CAUTION", "DEFENSIVE", "REDUCE_ONLY", "LOCKDOWN", "HALT", None), "action": pick("o_orderkey % 5", "open", "increase", "reduce", "close", "cancel"), "status": pick("o_custkey % 3", "PASS", "FAIL", None)},
    lambda: {"transition": g.listed_pair(g.TRANSITIONS, "current", "target"), "portfolio": g.listed_pair(g.PORTFOLIO_ACTIONS, "risk", "action"), "exposure": g.exposure_allowed("status", "action")},
    {"transition": "CASE WHEN current IS NULL OR current = 'RETIRED' THEN false WHEN target = 'RETIRED' THEN true ELSE concat(current, '>', target) IN ('CANDIDATE>VALIDATED', 'VALIDATED>PROMOTED', 'PROMOTED>SHADOW', 'SHADOW>PAPER_ACTIVE', 'SHADOW>WATCH', 'PAPER_ACTIVE>WATCH', 'PAPER_ACTIVE>DEGRADED', 'PAPER_ACTIVE>REDUCE_ONLY', 'WATCH>PAPER_ACTIVE', 'WATCH>DEGRADED', 'DEGRADED>REDUCE_ONLY', 'DEGRADED>QUARANTINED', 'REDUCE_ONLY>QUARANTINED') END",
     "portfolio": "coalesce(CASE WHEN risk IN ('NORMAL', 'CAUTION') THEN action <> 'cancel' WHEN risk IN ('DEFENSIVE', 'REDUCE_ONLY') THEN action IN ('reduce', 'close') WHEN risk = 'LOCKDOWN' THEN action = 'close' END, false)", "exposure": "action IN ('reduce', 'close') OR coalesce(status = 'PASS', false)"},
    doc="L50, L60, L70: allowed transitions, portfolio actions and new exposure.",
)

gate(
    "h45_cascade_and_severity", "lineitem", "l_orderkey, l_linenumber", {"branching": share("l_partkey % 90", 100), "excitation": share("l_suppkey % 50", 10), "concentration": share("l_orderkey % 150 - 20", 100), "intensity": share("l_partkey % 40", 100), "jump_mean": share("l_suppkey % 21 - 10", 100), "jump_vol": share("l_orderkey % 90", 100), "slippage": "l_discount * 300", "funding": "l_tax * 100 - 1", "issues": "l_linenumber - 3", "baseline": "0.5", "symbol": pick("l_partkey % 4", "BTCUSDT", "ETHUSDT", "SOLUSDT", "XBTUSD")},
    lambda: {"cascade": r(g.hawkes_multiplier("branching", "excitation", "concentration")), "jumps": r(g.jump_factor("intensity", "jump_mean", "jump_vol")), "severity": g.stress_severity("slippage", "funding", "issues"), "correlation": g.correlation_break("baseline", "concentration", 0.25), "cluster": g.symbol_cluster("symbol")},
    {"cascade": "round(least(4.0, greatest(1.0, 1 + branching * (1 + CASE WHEN concentration < 0 THEN 0 WHEN concentration > 1 THEN 1 ELSE concentration END) + excitation * 0.1::DOUBLE)), 6) + 0.0", "jumps": "round(CASE WHEN intensity + abs(jump_mean) + jump_vol > 1.5 THEN 2.5 ELSE 1 + intensity + abs(jump_mean) + jump_vol END, 6) + 0.0",
     "severity": "CASE WHEN slippage >= 25 OR funding >= 5 OR issues >= 5 THEN 'severe' WHEN slippage >= 10 OR funding > 0 OR issues > 0 THEN 'medium' ELSE 'mild' END", "correlation": "CASE WHEN abs(concentration - baseline) >= 0.25 THEN 'correlation_break_overlay' ELSE 'correlation_within_band' END", "cluster": "CASE WHEN symbol IN ('BTCUSDT', 'ETHUSDT') THEN 'majors' ELSE 'alts' END"},
    doc="H45, H46, B43, L36, L37, L56: cascades, jumps, severity of stress, correlation breaks and clusters.",
)
