"""Expressions of the feature, forecast, execution-quality and calibration families."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.columns import c
from tidemark.functions.stats import sample_kurtosis, sample_skewness, sharpe

# Quote currencies in the order in which a symbol's end is compared.
QUOTES = ("USDT", "USDC", "USD", "BTC", "ETH")
#: Fixed value: the track record of a strategy without an edge.
NEVER = 9_999_999


def forecast_fields(q10: str, q50: str, q90: str, observed: str) -> dict[str, Column]:
    """Fields of the last step of a quantile forecast against the last observed value (not 0)."""
    low, middle, high = (F.element_at(q, -1) for q in (q10, q50, q90))
    width = high - low
    gain = middle / c(observed) - 1
    uncertainty = width / F.greatest(F.abs(observed), F.lit(1e-12))
    return {
        "q50_return": gain,
        "direction": F.signum(gain).cast("int"),
        "uncertainty": uncertainty,
        "skew": F.when(width != 0, ((high - middle) - (middle - low)) / width).otherwise(0.0),
        "confidence": F.when(uncertainty <= 0.01, "high").when(uncertainty <= 0.03, "medium").otherwise("low"),
    }


def direction_confidence(q50: str, observed: str) -> Column:
    """H44."""
    return F.least(F.lit(1.0), F.abs(F.get(c(q50), F.lit(0)) - c(observed)) / F.greatest(F.abs(observed), F.lit(1.0)))


def forecast_issues(q10: str, q50: str, q90: str) -> list[Column]:
    """NULL or the name of what is wrong with a forecast's quantile arrays."""
    ordered = lambda a, b: F.forall(F.zip_with(a, b, lambda v, w: v <= w), lambda ok: F.coalesce(ok, F.lit(False)))
    even = (F.size(q10) == F.size(q50)) & (F.size(q90) == F.size(q50))
    return [F.when(~even, "length_mismatch"), F.when(even & ~(ordered(q10, q50) & ordered(q50, q90)), "quantiles_not_ordered")]


def contract_issues(name: str, modes: str, risk: str, max_age: str, at: str, now: str, *, mode: str) -> list[Column]:
    """NULL or the name of what a feature's contract forbids; without a contract only that is said."""
    # to the microsecond: whole seconds of both would be up to one off
    age = (F.unix_micros(c(now).cast("timestamp")) - F.unix_micros(c(at).cast("timestamp"))) / 1e6
    return [
        F.when(c(name).isNull(), "missing_contract"),
        F.when(~F.array_contains(F.split(modes, ","), mode), "mode_not_allowed"),
        F.when((c(risk) == "research_only") & F.lit(mode != "research"), "research_only_field"),
        F.when(c(name).isNotNull() & (c(at) > c(now)), "future_timestamp"),
        F.when((c(max_age) >= 0) & (age > c(max_age)), "feature_stale"),
    ]


def minimum_track_record(ret: str, target: float = 0.0, confidence: float = 0.95) -> Column:
    """Periods until the probabilistic Sharpe ratio against ``target`` reaches ``confidence``."""
    sr = sharpe(ret)
    spread = F.greatest(F.lit(0.0001), 1 + 0.5 * sr * sr - sample_skewness(ret) * sr + (sample_kurtosis(ret) - 3) / 4 * sr * sr)
    z = NormalDist().inv_cdf(confidence)
    periods = F.ceil(1 + spread * F.pow(z / F.when(sr > target, sr - target), F.lit(2.0)))
    return F.when(F.count(ret) < 4, 0).when(sr <= target, NEVER).otherwise(periods).cast("bigint")


def prior(x: Column, incumbent: float, alpha: float) -> Column:
    """The mean, shrunk towards the incumbent; the incumbent alone without samples."""
    return F.coalesce((1 - alpha) * F.lit(incumbent) + alpha * F.avg(x), F.lit(incumbent))


def drift_warnings(metrics: Column, thresholds: dict[str, float], places: int | None = 12) -> Column:
    """``drift:name`` of the metrics beyond their threshold, by name.

    To twelve places, so that a mean on its threshold does not warn by the order
    in which it was summed; metrics that do not depend on it may be compared as
    they are (None).
    """
    limits = F.create_map(*[F.lit(v) for pair in thresholds.items() for v in pair])
    size = (lambda v: F.abs(v)) if places is None else (lambda v: F.round(F.abs(v), places))
    over = F.map_filter(metrics, lambda k, v: size(v) > F.coalesce(F.try_element_at(limits, k), F.lit(float("inf"))))
    return F.transform(F.array_sort(F.map_keys(over)), lambda k: F.concat(F.lit("drift:"), k))


def merged_counts(a: Column, b: Column) -> Column:
    """Two maps of counts merged by their maximum."""
    return F.map_zip_with(a, b, lambda k, v, w: F.greatest(F.coalesce(v, F.lit(0)), F.coalesce(w, F.lit(0))))


def tier_entry(leverage: Column, notional: Column, tiers: list[dict]) -> Column:
    """the first of the sorted tiers that allows both; else the last."""
    inf = float("inf")
    ranked = sorted(tiers, key=lambda t: (t.get("max_leverage", inf), t.get("max_notional", inf)))
    rows = F.array(*[F.struct(F.lit(t["name"]).alias("name"), F.lit(float(t.get("max_leverage", inf))).alias("max_leverage"), F.lit(float(t.get("max_notional", inf))).alias("max_notional")) for t in ranked])
    fits = F.filter(rows, lambda t: (leverage <= t["max_leverage"]) & (notional <= t["max_notional"]))
    return F.coalesce(F.get(fits, F.lit(0)), F.element_at(rows, -1))


def side_bps(side: Column, base: Column, seen: Column) -> Column:
    """Basis points by which ``seen`` is worse than ``base`` for that side."""
    worse = F.when(F.upper(side) == "BUY", seen - base).otherwise(base - seen)
    return F.when(base != 0, worse / base * 1e4).otherwise(0.0)


def latency_class(ms: Column) -> Column:
    """H21."""
    return F.when(ms < 50, "lt_50ms").when(ms < 250, "50ms_250ms").when(ms < 1000, "250ms_1s").otherwise("gte_1s")


def opportunity_loss(side: Column, reference: Column, adverse: Column, unfilled: Column) -> Column:
    """What an adverse move costs on the unfilled part; nothing where it was not adverse."""
    lost = F.abs(adverse - reference) * unfilled
    return F.when((unfilled > 0) & (side_bps(side, reference, adverse) > 0), lost).otherwise(0.0)


def absorption(signed_delta: Column, depth: Column) -> Column:
    """H28."""
    score = F.least(F.lit(1.0), depth / F.greatest(F.abs(signed_delta), F.lit(1.0)))
    return F.when((signed_delta == 0) | (depth <= 0), 0.0).otherwise(score)


def funding_state(x: str) -> Column:
    """H32."""
    v = c(x)
    return F.when(v >= 0.01, "positive_extreme").when(v >= 0.001, "positive").when(v <= -0.01, "negative_extreme").when(v <= -0.001, "negative").otherwise("flat")


def volatility_state(x: str | Column) -> Column:
    """H33."""
    return F.when(c(x) >= 0.04, "high").when(c(x) >= 0.015, "medium").otherwise("low")


def open_interest_state(x: str) -> Column:
    """H34."""
    v = c(x)
    return F.when(v >= 0.15, "rising_fast").when(v >= 0.03, "rising").when(v <= -0.15, "falling_fast").when(v <= -0.03, "falling").otherwise("flat")


def quote_currency(symbol: Column) -> Column:
    """NULL if it ends in none of them."""
    shown = F.upper(F.trim(symbol))
    return F.coalesce(*[F.when(shown.endswith(q), q) for q in QUOTES])


def venue_symbol(symbol: Column) -> Column:
    """``BASE/QUOTE`` in any spelling becomes BASE with the venue's quote."""
    shown = F.upper(F.trim(symbol))
    return F.when(shown.contains("/"), F.concat(F.substring_index(shown, "/", 1), F.lit("USDT"))).otherwise(shown)
