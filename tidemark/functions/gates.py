"""Gates, guards and validators.

Each function gives the ordered rules of one gate, (condition under which it
fails, its reason), over columns of the names stated; ``operators.rules``
turns them into a list of reasons, the first one, or their number.  A flag that
is NULL counts as not set; a comparison with NULL does not hold unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.columns import c
from tidemark.operators.rules import Rules, all_broken, count_broken, first_broken


def required(*flags: str | tuple[str, str]) -> Rules:
    """Flags that must be set; a pair is (flag, reason), else the flag's name is the reason."""
    return [(f"NOT coalesce({f}, false)", reason) for f, reason in (x if isinstance(x, tuple) else (x, x) for x in flags)]


def raised(*flags: str) -> Rules:
    """Flags that must not be set."""
    return [(f"coalesce({f}, false)", f) for f in flags]


def missing(*fields: str) -> Rules:
    """Texts that must be there."""
    return [(f"coalesce({f}, '') = ''", f"missing_{f}") for f in fields]


def finite(field: str) -> str:
    return f"coalesce(abs({field}) < double('infinity'), false)"


# Reasons, their order and the published limits of each gate.


def pretrade() -> Rules:
    """Fifteen conditions before an order leaves."""
    return [
        *required(("artifact_approved", "artifact_not_approved")), *raised("artifact_expired"),
        *required(("symbol_allowed", "symbol_not_allowed"), ("paper_mode_allowed", "paper_mode_not_allowed"), ("market_fresh", "market_data_stale"), ("book_gap_clean", "book_gap_detected"), ("reconciliation_clean", "reconciliation_dirty")),
        *raised("duplicate_client_order_id"),
        *required(("rate_limit_ok", "rate_limit_block"), ("margin_ok", "margin_leverage_block"), ("venue_rules_ok", "venue_rule_block"), ("spread_depth_ok", "spread_depth_block"), ("funding_ok", "funding_block"), ("liquidation_ok", "liquidation_block"), ("portfolio_risk_ok", "portfolio_risk_block")),
    ]


def funding_guard(max_cost_bps: float, block_seconds: int) -> Rules:
    """B31 over action, now, next_funding (timestamps), funding_cost_bps."""
    left = "unix_micros(CAST(next_funding AS TIMESTAMP)) - unix_micros(CAST(now AS TIMESTAMP))"
    return [(f"action IN ('open', 'increase') AND {left} BETWEEN 0 AND {block_seconds * 1_000_000}", "near_funding_open_block"), (f"funding_cost_bps > {max_cost_bps!r}D", "funding_cost_budget_exceeded")]


def liquidation_distance(mark: str | Column, liquidation: str | Column) -> Column:
    """How far the liquidation price is, in basis points of the mark."""
    return F.abs(c(mark) - c(liquidation)) / F.greatest(F.abs(c(mark)), F.lit(1e-9)) * 10_000.0


def liquidation_guard(min_distance: float, stress_move: float) -> Rules:
    """B32 over distance_bps."""
    return [(f"distance_bps < {min_distance!r}D", "liquidation_distance_breach"), (f"distance_bps - {stress_move!r}D < {min_distance!r}D", "stress_liquidation_distance_breach")]


def circuit_breakers(daily_limit: float, weekly_limit: float, drawdown_limit: float) -> Rules:
    """B30 over daily_loss, weekly_loss, drawdown, with the caller's limits."""
    return [(f"daily_loss > {daily_limit!r}D", "daily_loss_breaker"), (f"weekly_loss > {weekly_limit!r}D", "weekly_loss_breaker"), (f"drawdown > {drawdown_limit!r}D", "drawdown_breaker")]


def margin_check(mode: str, leverage: int) -> Rules:
    """B33 over margin_mode, leverage."""
    return [(f"NOT margin_mode <=> '{mode}'", "margin_mode_mismatch"), (f"NOT leverage <=> {leverage}", "leverage_mismatch")]


def round_down(quantity: str | Column, step: float) -> Column:
    """Whole steps of a quantity."""
    return F.floor(c(quantity) / F.lit(step)).cast("double") * F.lit(step)


def round_to_tick(price: str | Column, tick: float) -> Column:
    """The nearest tick, halves to the even one."""
    return F.round(F.rint(c(price) / F.lit(tick)) * F.lit(tick), 12)


def venue_order(min_notional: float) -> Rules:
    """B34 over quantity, price, rounded_quantity, rounded_price, post_only, path, side, best_bid, best_ask, time_in_force, reduce_only, intent, position, submitted_at, expires_at."""
    return [
        ("quantity <= 0", "quantity_must_be_positive"), ("price <= 0", "price_must_be_positive"), ("rounded_quantity <= 0", "quantity_below_step_size"), ("price <> rounded_price", "price_precision_violation"),
        (f"rounded_quantity * price < {min_notional!r}D", "min_notional_violation"),
        ("post_only AND path <> 'maker'", "post_only_requires_maker_path"), ("post_only AND (side = 'BUY' AND price >= best_ask OR side = 'SELL' AND price <= best_bid)", "post_only_would_take_liquidity"),
        ("time_in_force = 'GTX' AND NOT coalesce(post_only, false)", "gtx_requires_post_only"), ("reduce_only AND intent <> 'reduce'", "reduce_only_requires_reduce_intent"), ("reduce_only AND position = 0", "reduce_only_without_position"),
        ("reduce_only AND rounded_quantity > abs(position) + 1e-12D", "reduce_only_quantity_exceeds_position"), ("expires_at <= submitted_at", "order_expired"),
    ]


def order_intent() -> Rules:
    """B35 over intent_id, artifact_id, portfolio_plan_id, symbol, created_at, expires_at, side, intent_type, urgency, reduce_only_required, desired_position_delta, three risk bounds and two guard policies."""
    bounds = ("max_slippage_bps", "max_spread_bps", "max_participation_rate")
    all_finite = " AND ".join(map(finite, bounds))
    return [
        *missing("intent_id", "artifact_id", "portfolio_plan_id", "symbol", "created_at", "expires_at"),
        ("coalesce(side, '') NOT IN ('BUY', 'SELL')", "invalid_side"), ("coalesce(intent_type, '') NOT IN ('open', 'increase', 'reduction', 'close')", "invalid_intent_type"), ("coalesce(urgency, '') NOT IN ('low', 'normal', 'urgent')", "invalid_urgency"),
        ("reduce_only_required AND NOT side <=> 'SELL'", "reduce_only_side_mismatch"), (f"NOT {finite('desired_position_delta')}", "non_finite_desired_position_delta"), ("desired_position_delta = 0", "zero_desired_position_delta"),
        (f"NOT ({all_finite})", "non_finite_risk_bound"), (f"{all_finite} AND least({', '.join(bounds)}) < 0", "negative_risk_bound"), ("max_participation_rate > 1", "participation_rate_gt_one"),
        *missing("funding_guard_policy", "liquidation_guard_policy"),
    ]


def venue_request() -> Rules:
    """B36 over venue, symbol, side, quantity, type, price, client_order_id, metadata_hash."""
    return [
        *missing("venue", "symbol"), ("coalesce(side, '') NOT IN ('BUY', 'SELL')", "invalid_side"), ("quantity <= 0", "invalid_quantity"), ("upper(type) = 'LIMIT' AND price IS NULL", "limit_price_required"),
        *missing("client_order_id"), ("length(coalesce(metadata_hash, '')) <> 64", "invalid_metadata_hash"),
    ]


def symbol_target() -> Rules:
    """B37 over symbol, artifact_id, role, five amounts and rebalance_reason."""
    amounts = ("target_weight", "target_notional", "max_loss_budget", "max_slippage_bps", "max_funding_cost_bps")
    checks = [rule for a in amounts for rule in ((f"NOT {finite(a)}", f"non_finite_{a}"), (f"{finite(a)} AND {a} < 0", f"negative_{a}"))]
    return [*missing("symbol", "artifact_id", "role"), *checks, *missing("rebalance_reason")]


def symbol_admission() -> Rules:
    """Sixteen gates, each a flag."""
    return required("exchange_status_trading", "usdm_linear_perp", "history_1h", "history_15m", "funding_history", "mark_price_history", "open_interest", "book_depth", "spread", "volume", "capacity", "slippage_model_confidence", "funding_stability", "correlation_cluster", "scenario_robustness", "paper_dry_run")


def symbol_demotion() -> Rules:
    """Any of these leads to REDUCE_ONLY."""
    return raised("data_gap", "liquidity_failure", "reconciliation_issue", "slippage_shock", "funding_shock", "repeated_strategy_failure")


def symbol_quarantine() -> Rules:
    """Any of these leads to QUARANTINED."""
    return raised("data_gap", "reconciliation_issue", "venue_rule_change")


def data_blockers() -> Rules:
    """B22, what blocks research, over symbol, venue, timeframe, provider, n_bars, example_study, has_source_hash, has_manifest, n_flags, n_issues, liquidation_observed, liquidation_dependent."""
    return [
        ("coalesce(symbol, '') NOT IN ('BTCUSDT', 'ETHUSDT')", "unsupported_strict_v3_symbol"), ("lower(coalesce(venue, '')) <> 'binance'", "unsupported_strict_v3_venue"), ("coalesce(timeframe, '') NOT IN ('1Hour', '15Min')", "unsupported_strict_v3_timeframe"),
        ("example_study", "example_or_fixture_study"), ("coalesce(provider, '') NOT IN ('binance_perps', 'binance_public_archive', 'binance_public_ws_rest_bundle')", "missing_real_source_provenance"),
        *required(("has_source_hash", "missing_source_hash"), ("has_manifest", "missing_fetch_manifest")),
        ("n_bars < CASE timeframe WHEN '1Hour' THEN 13140 WHEN '15Min' THEN 52560 ELSE 0 END", "insufficient_history_for_v3_improvement"), ("n_flags > 0", "snapshot_quality_flags_present"), ("n_issues > 0", "snapshot_quality_issues_present"),
        ("liquidation_dependent AND NOT coalesce(liquidation_observed, false)", "liquidation_feature_missing_observed_sidecar"),
    ]


def robust_evaluation() -> Rules:
    """Blockers over causality_passed, n_buckets, n_symbols, n_regimes and the metrics; NULL metrics fail."""
    return [
        *required(("causality_passed", "feature_causality_audit_failed")), ("coalesce(n_buckets, 0) < 2", "insufficient_tournament_buckets"), ("coalesce(n_symbols, 0) < 2", "symbol_specific_candidate"), ("coalesce(n_regimes, 0) < 2", "regime_specific_candidate"),
        *robust_checks(), ("distortion > 0.5D", "is_to_oos_distortion_too_high"),
    ]


def robust_checks() -> Rules:
    """The thirteen gates that the score counts."""
    at_least = lambda x, low: f"NOT coalesce({x} >= {low}, false)"
    return [
        ("NOT coalesce(oos_sharpe > 0, false)", "oos_not_positive_post_cost"), ("NOT coalesce(sealed_holdout_sharpe > 0, false)", "sealed_holdout_not_positive_post_cost"), *required(("cpcv_pass", "cpcv_failed")),
        (at_least("bootstrap_pass_rate", "0.7D"), "bootstrap_stability_failed"), *required(("spa_pass", "spa_failed")), ("NOT coalesce(pbo <= 0.2D, false)", "pbo_too_high"), (at_least("dsr", "0.95D"), "deflated_sharpe_too_low"),
        (at_least("regime_pass_rate", "0.7D"), "regime_stress_failed"), (at_least("scenario_pass_rate", "0.7D"), "scenario_stress_failed"), *required(("capacity_pass", "capacity_failed")),
        ("NOT coalesce(slippage_bps <= 25, false)", "slippage_too_high"), (at_least("trade_count", "30"), "insufficient_trade_count"), ("NOT coalesce(abs(max_drawdown) <= 0.3D, false)", "drawdown_too_high"),
    ]


def distortion(in_sample: str | Column, out_of_sample: str | Column) -> Column:
    """The share of the in-sample Sharpe ratio that is lost out of sample; 0 where there is none."""
    return F.when(F.abs(c(in_sample)) <= 1e-12, 0.0).otherwise((c(in_sample) - c(out_of_sample)) / F.abs(c(in_sample)))


def robust_score(distorted: str | Column) -> Column:
    """Share of the gates passed less what distortion and blockers cost."""
    passed = F.lit(1.0) - count_broken(robust_checks()) / F.lit(float(len(robust_checks())))
    return F.greatest(F.lit(0.0), passed - F.greatest(F.lit(0.0), c(distorted)) * 0.15 - F.least(F.lit(0.5), count_broken(robust_evaluation()) * 0.03))


def sealed_holdout() -> Rules:
    """D36 over robustness_ready, trade_count, post_cost_return, sharpe, max_drawdown; the first failure is the class."""
    return [
        *required(("robustness_ready", "robust_eval_not_ready")), ("coalesce(trade_count, 0) < 30", "insufficient_trades"), ("NOT coalesce(post_cost_return > 0, false)", "negative_post_cost_return"),
        ("NOT coalesce(sharpe > 0, false)", "low_holdout_sharpe"), ("NOT coalesce(abs(max_drawdown) <= 0.3D, false)", "excess_drawdown"),
    ]


def calmar(net_pnl: str | Column, max_drawdown: str | Column) -> Column:
    """D12 of a finished backtest: 999 for a profit without drawdown."""
    depth = F.abs(c(max_drawdown))
    return F.when(depth <= 1e-12, F.when(c(net_pnl) > 0, 999.0).otherwise(0.0)).otherwise(c(net_pnl) / depth)


def promotion(model_id: str) -> Rules:
    """Twenty-two gates; the reason is the gate's name."""
    passes = [
        ("venue_model", f"lower(venue) = 'binance' AND execution_model_id = '{model_id}' AND signal_timeframe = '1h' AND execution_timeframe = '15m'"),
        ("validation_method", "cv_method = 'combinatorial_purged_cv' AND n_blocks BETWEEN 8 AND 16 AND n_test_blocks IN (2, 3) AND purge_bars >= 0 AND embargo_bars >= 0"),
        ("data_length", "months_of_data >= 18 OR all_data_since_listing"), ("walk_forward_folds", "n_folds >= 8"), ("trade_or_episode_count", "trade_count >= 120 OR n_episodes >= 30"), ("positive_post_cost", "net_pnl > 0"),
        ("sharpe", "sharpe >= 1"), ("calmar", "calmar >= 0.75D"), ("max_drawdown", "max_drawdown >= -0.2D"), ("turnover_budget", "turnover_within_budget"), ("capacity_5x", "capacity_5x_edge_erosion < 0.25D AND capacity_5x_fill_completion >= 0.95D"),
        ("dsr", "dsr >= 0.95D"), ("pbo", "pbo < 0.2D"), ("spa", "spa_pvalue < 0.05D"), ("cpcv", "cpcv_median > 0.75D AND cpcv_p10 > 0"), ("no_liquidation", "n_liquidations = 0"), ("execution_rules", "n_rule_failures = 0"), ("baseline_set", "baselines_present"),
        ("parameter_plateau", "plateau_ok"), ("bootstrap_monte_carlo", "bootstrap_ok"), ("regime_conditional", "regime_ok"), ("reproducibility", "reproducible"),
    ]
    return [(f"NOT coalesce({p}, false)", name) for name, p in passes]


def validation_gates() -> Rules:
    """Eight gates of the default specification, over sharpe, calmar, max_drawdown, capacity_5x_*, turnover_within_budget, oos_trades, scenario_passed, regime_passed."""
    return [
        ("NOT coalesce(sharpe >= 1, false)", "final_holdout_sharpe_below_floor"), ("NOT coalesce(calmar >= 0.75D, false)", "final_holdout_calmar_below_floor"), ("NOT coalesce(max_drawdown >= -0.2D, false)", "final_holdout_drawdown_breached_cap"),
        ("NOT coalesce(capacity_5x_edge_erosion < 0.25D AND capacity_5x_fill_completion >= 0.95D, false)", "capacity_5x_degradation_or_fill_failed"),
        ("turnover_within_budget = false", "turnover_budget_exceeded"), ("turnover_within_budget IS NULL", "turnover_budget_missing"), ("NOT coalesce(oos_trades >= 120, false)", "min_oos_trades_below_floor"),
        *required(("scenario_passed", "scenario_pass_matrix_failed"), ("regime_passed", "regime_pass_matrix_failed")),
    ]


def candidate_rules(min_oos_trades: int = 100, leverage: float = 1.0) -> Rules:
    """What rejects a candidate against the incumbent (columns train_/oos_ of each, worst_drawdown of the bootstrap)."""
    return [
        (f"oos_trades < {min_oos_trades}", "min_oos_trades"), ("abs(train_drawdown) > abs(old_train_drawdown) * 1.05D", "train_drawdown_cap"), ("oos_sharpe < old_oos_sharpe * 0.95D", "oos_sharpe_floor"),
        (f"worst_drawdown <= {-0.25 * max(1.0, leverage)!r}D", "bootstrap_kill_switch"), ("n_liquidations > 0", "liquidation_events"),
    ]


def candidate_verdict(min_oos_trades: int = 100, leverage: float = 1.0) -> Column:
    """Reject by any rule, wash without gain in Sharpe, floor drawdown or median profit, else accept."""
    old = F.greatest(F.abs("old_oos_drawdown"), F.lit(1e-9))
    gains = [
        (c("oos_sharpe") - c("old_oos_sharpe")) / F.greatest(F.abs("old_oos_sharpe"), F.lit(1e-9)) < 0.02, (old - F.abs("worst_drawdown")) / old < 0.10,
        (c("median_profit") - c("old_oos_pnl")) / F.greatest(F.abs("old_oos_pnl"), F.lit(1e-9)) < 0.05,
    ]
    return F.when(count_broken(candidate_rules(min_oos_trades, leverage)) > 0, "reject").when(gains[0] & gains[1] & gains[2], "wash").otherwise("accept")


def overfit_budget(max_trials: int, max_variants: int, max_reuse: int, max_retries: int, pbo_ceiling: float) -> Rules:
    """D43 over trials, strategy_variants, parameter_reuse, failed_gate_retries, pbo."""
    used = {"trials": max_trials, "strategy_variants": max_variants, "parameter_reuse": max_reuse, "failed_gate_retries": max_retries}
    return [
        *((f"{name} < 0", f"negative_{name}") for name in used), (f"NOT {finite('pbo')}", "non_finite_pbo"), *((f"{most} < 0", f"negative_max_{name}") for name, most in used.items()),
        *((f"{name} > {most}", f"max_{name}_exceeded") for name, most in used.items()), (f"{finite('pbo')} AND pbo > {pbo_ceiling!r}D", "pbo_ceiling_exceeded"),
    ]


def funding_drag(funding: str | Column, gross_pnl: str | Column, fees: str | Column) -> Column:
    """Funding paid against profit and fees."""
    return F.abs(c(funding)) / (F.abs(c(gross_pnl)) + F.abs(c(fees)) + F.lit(1e-9))


def fast_screen(min_oos_trades: int) -> Rules:
    """D44 over oos_trades, n_returns, min_length, n_liquidations, drag."""
    return [(f"oos_trades < {min_oos_trades}", "fast_screen_min_oos_trades"), ("n_returns > 0 AND n_returns < min_length", "fast_screen_minimum_backtest_length"), ("n_liquidations > 0", "fast_screen_liquidation_events"), ("drag >= 0.5D", "fast_screen_excessive_funding_drag")]


def forecast_decay(min_edge: float, max_error: float, max_decay: float, max_staleness: int, min_coverage: float) -> Rules:
    """Any of these disables a forecast as a research feature."""
    return [
        (f"baseline_edge < {min_edge!r}D", "baseline_edge_below_min"), (f"calibration_error > {max_error!r}D", "calibration_error_above_max"), (f"directional_decay > {max_decay!r}D", "directional_decay_above_max"),
        (f"staleness_seconds > {max_staleness}", "staleness_above_max"), (f"symbol_coverage < {min_coverage!r}D", "symbol_coverage_below_min"),
    ]


def tactic() -> Column:
    """I31 over risk_state, action, spread_bps, fill_probability, adverse_bps, drift_bps, n_open_orders; the first that fits."""
    return (
        F.when(c("risk_state") == "HALT", "SKIP").when(c("risk_state").isin("REDUCE_ONLY", "LOCKDOWN"), F.when(c("action") == "close", "CLOSE").otherwise("REDUCE_ONLY"))
        .when((c("spread_bps") <= 2) & (c("fill_probability") >= 0.7) & (c("adverse_bps") <= 2), "POST_ONLY_GTX").when((c("drift_bps") > 100) | (c("fill_probability") < 0.3), "IOC").when(c("n_open_orders") > 3, "DELAY").otherwise("AGGRESSIVE_LIMIT")
    )


#: What retires, pauses and revalidates, in this order.
RETIRES: Rules = [("n_liquidations > 0", "liquidation"), *required(("checksum_valid", "artifact_checksum_mismatch"), ("venue_rules_match", "venue_rule_mismatch")), ("pauses_90d >= 2", "two_pauses_within_90d"), *raised("holdout_assumptions_invalidated")]
PAUSES: Rules = [("live_sharpe_30d < -0.5D AND live_samples >= 30", "trailing_30d_live_sharpe_below_floor"), ("slippage_over_modeled_5d > 2", "realized_slippage_gt_2x_modeled_5d"), *raised("fill_rejection_cluster", "drawdown_limit_breached", "capacity_drift_breached", "data_quality_degraded")]
REVALIDATES: Rules = raised("validation_expired", "scenario_pack_changed", "venue_api_rules_changed")


def lifecycle() -> tuple[Column, Column, Column]:
    """(next state, whether revalidation is required, reasons) of an artifact in ``state``."""
    retired, paused, again = (count_broken(x) > 0 for x in (RETIRES, PAUSES, REVALIDATES))
    state = F.when(retired, "retired").when(paused, "paused").otherwise(c("state"))
    reasons = F.when(retired, all_broken(RETIRES)).when(paused, all_broken(PAUSES)).otherwise(all_broken(REVALIDATES))
    return state, ~retired & ~paused & again, reasons


ROUTES = {"slippage_fragile": "cost_execution_research", "regime_specific_only": "regime_scope_research", "capacity_fail": "sizing_liquidity_research", "feature_leakage": "block_candidate"}


def routed(codes: str | Column) -> tuple[Column, Column]:
    """(action, secondary actions) of an ordered array of failure codes; a block comes before all."""
    table = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    actions = F.array_distinct(F.filter(F.transform(c(codes), lambda x: table[x]), lambda x: x.isNotNull()))
    block = F.array_contains(actions, "block_candidate")
    action = F.when(block, "block_candidate").otherwise(F.coalesce(F.try_element_at(actions, F.lit(1)), F.lit("promote_to_paper_forward_review")))
    return action, F.filter(actions, lambda x: x != action)


FAMILY_TOKENS = (("validation_failures", ("holdout", "sample", "pbo", "sharpe", "calmar")), ("execution_failures", ("fill", "order", "reconcile")), ("data_failures", ("data", "stale", "missing")))


def failure_route(gate: str | Column, repeats: str | Column) -> tuple[Column, Column, Column]:
    """(family by substring, recommended action, memory reason) of a failed gate."""
    g = c(gate)
    family = F.coalesce(*[F.when(g.rlike("|".join(tokens)), name) for name, tokens in FAMILY_TOKENS], F.lit("agent_policy_failures"))
    action = F.when(c(repeats) >= 3, "stop").when(g.isin("stress", "scenario"), "stress").when(g.isin("calibration", "slippage", "funding"), "calibrate").otherwise("narrow")
    return family, action, F.concat(family, F.lit(":"), g, F.lit(":repeated="), c(repeats).cast("string"), F.lit(":action="), action)


FAMILIES = (
    ("validation_failures", ("holdout_sharpe", "min_sample", "pbo", "spa")), ("execution_failures", ("orphan_order", "missing_fill", "duplicate_fill", "order_reject")), ("data_failures", ("missing_mark", "missing_funding", "stale_book")),
    ("portfolio_failures", ("cluster_cap", "beta_cap", "funding_budget")), ("agent_policy_failures", ("forbidden_tool", "trade_authority")), ("learning_failures", ("shadow_validation", "model_card_missing")),
)


def failure_family(reason: str | Column) -> Column:
    """The family of a reason by exact name."""
    return F.coalesce(*[F.when(c(reason).isin(*names), family) for family, names in FAMILIES], F.lit("unknown_failures"))


ROLES = ("core", "defensive", "opportunistic", "carry", "crash_hedge")
STAGES = ("backtest", "paper", "shadow_live", "tiny_live", "pilot_live", "scaled_live")


def candidate_rejection() -> Rules:
    """L49 over approved, manifest_reason (NULL: none), symbols, regimes (arrays), role, state, active_regimes (of the symbols); the first holds."""
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    return [
        *required(("approved", "artifact_not_approved")), ("manifest_reason = 'missing_promotion_manifest'", "missing_promotion_manifest"), ("manifest_reason IS NOT NULL", "artifact_not_paper_eligible"),
        ("coalesce(size(symbols), 0) < 1", "missing_symbol_scope"), ("coalesce(size(regimes), 0) < 1", "missing_regime_scope"), (f"coalesce(role, '') NOT IN ({quoted(ROLES)})", "invalid_portfolio_role"),
        (f"coalesce(state, '') NOT IN ({quoted(STAGES[1:])})", "artifact_not_active"), ("size(array_except(active_regimes, regimes)) > 0", "regime_scope_mismatch"),
    ]


ACTIONS = {"NORMAL": "close,increase,open,reduce", "CAUTION": "close,increase,open,reduce", "DEFENSIVE": "close,reduce", "REDUCE_ONLY": "close,reduce", "LOCKDOWN": "cancel,close,reconcile"}


def allowed_actions(state: str | Column) -> Column:
    """The sorted actions a risk state allows, comma-joined; none in a halt."""
    return F.coalesce(*[F.when(c(state) == s, a) for s, a in ACTIONS.items()], F.lit(""))


def artifact_compatibility(venue: str, signal: str, execution: str, model: str, contract: str, max_notional: float, symbols: tuple[str, ...]) -> Rules:
    """L68 over venue, signal_timeframe, execution_timeframe, execution_model, symbols (array), contract_hash, max_notional."""
    universe = "array(" + ", ".join(f"'{s}'" for s in symbols) + ")"
    return [
        (f"NOT venue <=> '{venue}'", "venue"), (f"NOT signal_timeframe <=> '{signal}'", "signal_timeframe"), (f"NOT execution_timeframe <=> '{execution}'", "execution_timeframe"), (f"NOT execution_model <=> '{model}'", "execution_model"),
        (f"coalesce(size(symbols), 0) < 1 OR size(array_except(symbols, {universe})) > 0", "symbol_universe"), (f"coalesce(contract_hash, '') <> '{contract}'", "feature_contract"), (f"coalesce(max_notional, 0) > {max_notional!r}D", "risk_limits"),
    ]


EVIDENCE = {("backtest", "paper"): ("full_validation_pass",), ("paper", "shadow_live"): ("paper_stability_pass", "telemetry_complete"), ("shadow_live", "tiny_live"): ("paper_live_divergence_within_band",), ("tiny_live", "pilot_live"): ("live_risk_calibrated", "live_cost_calibrated", "no_unresolved_risk_events"), ("pilot_live", "scaled_live"): ("explicit_user_approval", "revalidation_pass")}


def rollout_reasons(evidence: str | Column = "evidence") -> Column:
    """Why a step from ``from_stage`` to ``to_stage`` is not allowed; ``evidence`` is the array of what is proven."""
    reasons = lambda names: F.filter(F.array(*[F.lit(f"missing_gate_evidence:{n}") for n in names]), lambda x: ~F.array_contains(c(evidence), F.substring_index(x, ":", -1)))
    step = F.when(~c("from_stage").isin(*STAGES) | ~c("to_stage").isin(*STAGES), F.array(F.lit("rollout_stage_not_active")))
    for (a, b), names in EVIDENCE.items():
        step = step.when((c("from_stage") == a) & (c("to_stage") == b), reasons(names))
    return step.otherwise(F.array(F.lit("rollout_stage_skip_not_allowed")))


def feature_contract() -> Rules:
    """B19 over name, source, timestamp_source, earliest_available_at, max_age_seconds, modes (array), leakage_risk, three counts of bars, four flags and smoothing."""
    return [
        *missing("name", "source", "timestamp_source", "earliest_available_at"), (f"NOT {finite('max_age_seconds')}", "non_finite_max_age_seconds"), (f"{finite('max_age_seconds')} AND max_age_seconds < 0", "negative_max_age_seconds"),
        ("leakage_risk = 'research_only' AND arrays_overlap(modes, array('live', 'paper', 'shadow'))", "research_only_execution_mode_allowed"), ("lookback_bars < 0", "negative_lookback_bars"), ("warmup_bars < 0", "negative_warmup_bars"), ("availability_lag_bars < 0", "negative_availability_lag_bars"),
        ("uses_centered_window", "centered_window"), ("uses_negative_shift", "negative_shift"), ("uses_future_bars", "future_bars"), ("allows_repainting", "repainting_allowed"), ("lower(coalesce(smoothing, '')) NOT IN ('causal', 'none', 'recursive', 'expanding')", "non_causal_smoothing"),
    ]


def forecast_embargo() -> Rules:
    """L78 over source_at, available_at, decided_at, execution_mode, execution_available, embargo_seconds."""
    return [
        ("source_at > decided_at", "forecast_timestamp_after_decision_time"), ("decided_at < available_at", "forecast_feature_embargo_active"), ("execution_mode AND NOT coalesce(execution_available, false)", "forecast_not_execution_available"), ("embargo_seconds < 0", "embargo_seconds_negative"),
    ]


TRANSITIONS = {
    "CANDIDATE": ("VALIDATED", "RETIRED"), "VALIDATED": ("PROMOTED", "RETIRED"), "PROMOTED": ("SHADOW", "RETIRED"), "SHADOW": ("PAPER_ACTIVE", "WATCH", "RETIRED"), "PAPER_ACTIVE": ("WATCH", "DEGRADED", "REDUCE_ONLY", "RETIRED"),
    "WATCH": ("PAPER_ACTIVE", "DEGRADED", "RETIRED"), "DEGRADED": ("REDUCE_ONLY", "QUARANTINED", "RETIRED"), "REDUCE_ONLY": ("QUARANTINED", "RETIRED"), "QUARANTINED": ("RETIRED",), "RETIRED": (),
}
PORTFOLIO_ACTIONS = {"NORMAL": ("open", "increase", "reduce", "close"), "CAUTION": ("open", "increase", "reduce", "close"), "DEFENSIVE": ("reduce", "close"), "REDUCE_ONLY": ("reduce", "close"), "LOCKDOWN": ("close",), "HALT": ()}


def listed_pair(table: dict[str, tuple[str, ...]], key: str | Column, value: str | Column) -> Column:
    """Whether ``value`` is among those that ``table`` allows for ``key``; an unknown key allows none."""
    return F.coalesce(F.array_contains(F.coalesce(*[F.when(c(key) == k, F.array(*map(F.lit, v))) for k, v in table.items() if v], F.expr("cast(array() as array<string>)")), c(value)), F.lit(False))


def exposure_allowed(status: str | Column, action: str | Column) -> Column:
    """Reducing is always allowed, more exposure only after a clean reconciliation."""
    return c(action).isin("reduce", "close") | F.coalesce(c(status) == "PASS", F.lit(False))


def stress_severity(slippage_bps: str | Column, funding_bps: str | Column, issues: str | Column) -> Column:
    """Severe, medium or mild."""
    return F.when((c(slippage_bps) >= 25) | (c(funding_bps) >= 5) | (c(issues) >= 5), "severe").when((c(slippage_bps) >= 10) | (c(funding_bps) > 0) | (c(issues) > 0), "medium").otherwise("mild")


def hawkes_multiplier(branching: str | Column, excitation: str | Column, concentration: str | Column) -> Column:
    """How far a liquidation cascade multiplies costs, from 1 to 4."""
    bounded = F.least(F.greatest(c(concentration), F.lit(0.0)), F.lit(1.0))
    return F.least(F.greatest(1 + c(branching) * (1 + bounded) + c(excitation) * 0.1, F.lit(1.0)), F.lit(4.0))


def jump_factor(intensity: str | Column, mean: str | Column, vol: str | Column) -> Column:
    """How far jumps sharpen a scenario, from 1 to 2.5."""
    return F.greatest(F.lit(1.0), F.least(1 + c(intensity) + F.abs(c(mean)) + c(vol), F.lit(2.5)))


def correlation_break(baseline: str | Column, observed: str | Column, limit: float) -> Column:
    """Whether a correlation has left its band."""
    return F.when(F.abs(c(observed) - c(baseline)) >= limit, "correlation_break_overlay").otherwise("correlation_within_band")


def symbol_cluster(symbol: str | Column) -> Column:
    """Majors by their names' beginnings."""
    return F.when(c(symbol).startswith("BTC") | c(symbol).startswith("ETH"), "majors").otherwise("alts")


def verdict(rules: Rules, good: str, bad: str) -> Column:
    """``good`` where no rule fails, else ``bad``."""
    return F.when(count_broken(rules) > 0, bad).otherwise(good)


# Limits, parts and blockers of the paper-forward score.
FORWARD_LIMITS = {"orders": 10, "quality": 0.70, "slip": 25.0, "latency": 2000.0, "funding": 10.0}
FORWARD_PARTS = ("slippage_score", "fill_score", "latency_score", "funding_score", "liquidation_score", "capacity_score")


def within(value: str, limit: float) -> Column:
    """One less the share of the limit that is used up, from 0 to 1; 0 without evidence."""
    return F.coalesce(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.abs(c(value)) / F.lit(max(limit, 1e-12)))), 6), F.lit(0.0))


def forward_scores() -> dict[str, Column]:
    """D35 over paper_orders, filled, rejected, risk_blocked, queue_fill, slip_bps, lag_ms, funding_bps, window_ready, sidecar_ready, participation, completion, erosion_bps: the six parts and their mean."""
    clipped = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    fill = F.when(c("paper_orders") > 0, clipped((c("filled") - c("rejected") - c("risk_blocked")) / c("paper_orders"))).otherwise(clipped(F.coalesce("queue_fill", F.lit(0.0))))
    capacity = clipped(c("completion") * 0.5 + (1 - F.least(c("participation") / 0.05, F.lit(1.0))) * 0.25 + (1 - F.least(c("erosion_bps") / 25.0, F.lit(1.0))) * 0.25)
    parts = {
        "slippage_score": within("slip_bps", FORWARD_LIMITS["slip"]), "fill_score": F.round(fill, 6), "latency_score": within("lag_ms", FORWARD_LIMITS["latency"]), "funding_score": within("funding_bps", FORWARD_LIMITS["funding"]),
        "liquidation_score": F.when(c("window_ready") & c("sidecar_ready"), 1.0).otherwise(0.0), "capacity_score": F.coalesce(F.round(capacity, 6), F.lit(0.0)),
    }
    return parts | {"score": sum((parts[k] for k in FORWARD_PARTS[1:]), parts[FORWARD_PARTS[0]]) / len(parts)}


def forward_blockers() -> Rules:
    """D35 over the same and telemetry_quality, fill_score: what keeps a candidate from being ready, in the order of the names."""
    limit = FORWARD_LIMITS
    rules = [
        *required(("window_ready", "public_ws_window_not_ready"), ("sidecar_ready", "liquidation_sidecar_missing")),
        (f"paper_orders < {limit['orders']}", "paper_sample_too_small"), (f"telemetry_quality < {limit['quality']!r}D", "paper_telemetry_quality_low"),
        ("slip_bps IS NULL", "slippage_evidence_missing"), (f"abs(slip_bps) > {limit['slip']!r}D", "paper_slippage_too_high"), ("fill_score <= 0", "fill_evidence_missing"), ("fill_score > 0 AND fill_score < 0.8D", "paper_fill_quality_low"),
        ("lag_ms IS NULL", "latency_evidence_missing"), (f"lag_ms > {limit['latency']!r}D", "paper_latency_too_high"), ("funding_bps IS NULL", "funding_evidence_missing"), (f"funding_bps > {limit['funding']!r}D", "paper_funding_shock_too_high"),
        ("completion IS NULL", "capacity_evidence_missing"), ("completion < 0.8D", "capacity_fill_quality_low"), ("participation > 0.05D", "capacity_participation_too_high"), ("erosion_bps > 25", "capacity_edge_erosion_too_high"),
    ]
    return sorted(rules, key=lambda x: x[1])
