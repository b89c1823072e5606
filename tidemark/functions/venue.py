"""Fills, margins, levels and labels as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.columns import c

# The limits of the fill and adverse-price rules.


def fill_ratio(notional: Column, bid_depth: Column, ask_depth: Column, cascade: Column, depleted: Column) -> Column:
    """H7: how much of an order the nearer depth fills; 5 % at least where there is any depth."""
    depth = F.least(bid_depth, ask_depth)
    ratio = depth / F.greatest(notional, F.lit(1e-9))
    part = F.least(F.lit(1.0), ratio) / F.when(cascade > 1, cascade).otherwise(1.0) * F.when(depleted & (ratio < 1.5), 0.85).otherwise(1.0)
    easy = (ratio >= 2) & (cascade <= 1.25) & ~depleted
    return F.when(notional <= 0, 1.0).when(depth <= 0, 0.0).when(easy, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.05), part)))


def adverse_bps(slippage: Column, filled: Column, cascade: Column, stressed: Column, funding_z: Column, liquidation_z: Column, depleted: Column) -> Column:
    """H8: price given up for what is not filled at once, 150 at most."""
    short = F.greatest(F.lit(0.0), 1 - filled)
    five = lambda x: F.when(x, 0.05).otherwise(0.0)
    pressure = F.when(depleted, F.greatest(short, F.lit(0.10))).otherwise(short) + five(stressed) + five(F.abs(funding_z) > 2) + five(liquidation_z > 2)
    bps = slippage * (0.20 + F.least(F.lit(0.90), pressure)) * F.when(cascade > 1, F.least(F.lit(1.5), cascade / 1.25)).otherwise(1.0)
    none = (slippage <= 0) | ((short < 1e-3) & (slippage < 25)) | ((cascade <= 1) & (pressure < 0.10))
    return F.when(none, 0.0).otherwise(F.least(F.lit(150.0), bps))


def liquidation_trigger(side: Column, low: Column, high: Column, close: Column, weight: float, premium_bps: float) -> Column:
    """The mark that liquidates, between the bar's worst price and its close, moved against the position."""
    short = (high * (1 - weight) + close * weight) * (1 + premium_bps / 10_000)
    return F.when(side == "short", short).otherwise((low * (1 - weight) + close * weight) * (1 - premium_bps / 10_000))


def funding_payment(notional: Column, rate: Column, side: Column) -> Column:
    """Longs pay a positive rate, shorts receive it."""
    return F.abs(notional) * rate * F.when(side == "short", -1.0).otherwise(1.0)


def maintenance_margin(notional: Column, tiers: list[tuple[float, float | None, float]]) -> Column:
    """The ratio of the tier (floor, cap or None, ratio) that holds a notional, else of the last one."""
    ordered = sorted(tiers)
    size = F.abs(notional)
    inside = [(size >= low) & (F.lit(True) if cap is None else size < cap) for low, cap, _ in ordered]
    return F.coalesce(*[F.when(ok, ratio) for ok, (_, _, ratio) in zip(inside, ordered, strict=True)], F.lit(ordered[-1][2]))


def note_value(notes: Column, key: str, default: float) -> Column:
    """The number of a ``key=value`` text in an array of notes; the first that has one."""
    found = F.filter(F.transform(F.filter(notes, lambda x: x.startswith(f"{key}=")), lambda x: F.substring_index(x, "=", -1).try_cast("double")), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(default))


def near_notional(levels: Column, mid: Column, side: str, bps: float) -> Column:
    """Notional of the bids at or over, or asks at or under, ``bps`` from the mid."""
    edge = mid * (1 - bps / 10_000) if side == "bid" else mid * (1 + bps / 10_000)
    near = F.filter(levels, lambda x: x["price"] >= edge if side == "bid" else x["price"] <= edge)
    return F.when(mid > 0, notional(near)).otherwise(0.0)


def notional(levels: Column) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda s, x: s + x["price"] * x["qty"])


def top_notional(levels: Column, n: int = 5) -> Column:
    """Notional of the first levels."""
    return notional(F.slice(levels, 1, n))


def signed_notional(price: Column, quantity: Column, buyer_is_maker: Column) -> Column:
    """A trade's notional, negative where the buyer was the maker."""
    return price * quantity * F.when(F.coalesce(buyer_is_maker, F.lit(False)), -1.0).otherwise(1.0)


def imbalanced_levels(bids: Column, asks: Column, threshold: float, n: int = 5) -> Column:
    """Among the first levels, those where one side's notional exceeds the other's by ``threshold`` of both."""
    value = lambda x: x["price"] * x["qty"]
    pairs = F.zip_with(F.slice(bids, 1, n), F.slice(asks, 1, n), lambda b, a: F.when(value(b) + value(a) > 0, F.abs(value(b) - value(a)) / (value(b) + value(a)) >= threshold))
    return F.size(F.filter(pairs, lambda x: F.coalesce(x, F.lit(False))))


def best(levels: Column) -> Column:
    """The first level's price, 0 where there is none."""
    return F.coalesce(F.try_element_at(levels, F.lit(1))["price"], F.lit(0.0))


def embargo_bars(length: Column, horizon: Column, fraction: float = 0.01, multiplier: float = 1.0) -> Column:
    """The larger of a share of the data and the label's horizon, one bar at least."""
    if not 0.01 <= fraction <= 0.05:
        raise ValueError("the embargo is one to five hundredths of the data")
    return F.greatest(F.lit(1), F.floor(length * fraction).cast("bigint"), F.floor(horizon * multiplier).cast("bigint"))


def modeled_cost_bps(model: dict[str, Column], participation: Column, spread: Column, vol: Column, latency_ms: Column, in_funding_window: Column) -> Column:
    """The cost that a calibrated model (columns by name) expects of an order."""
    over = lambda x: F.greatest(F.lit(0.0), x)
    parts = [model["impact"] * F.sqrt(over(participation)), model["spread"] * over(spread), model["volatility"] * over(vol) * 10_000, model["latency"] * over(latency_ms), F.when(in_funding_window, model["funding"]).otherwise(0.0)]
    return over(reduce(lambda a, b: a + b, parts))


def impact_target_bps(realised: str | Column, spread: str | Column, maker_ratio: str | Column) -> Column:
    """What a fill cost beyond half the spread that its taking part paid."""
    return F.greatest(F.lit(0.0), c(realised) - 0.5 * c(spread) * F.greatest(F.lit(0.0), 1 - c(maker_ratio)))
