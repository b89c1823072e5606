"""Scalar cost, fill, margin and microstructure expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.columns import c, clamp

# Stress multipliers by regime and bounds of slippage in basis points.
STRESS = {"crash": 1.50, "short_squeeze": 1.35, "liquidity_stress": 1.25}
MAX_BPS = 500.0


def trade_cost(notional: Column, fee_bps: Column, slippage_bps: Column) -> Column:
    return F.abs(notional) * (fee_bps + slippage_bps) / 1e4


def funding_cash(notional: Column, rate: Column, side: Column) -> Column:
    """Longs pay a positive rate, shorts receive it."""
    return F.when(side == "short", -notional * rate).otherwise(notional * rate)


def square_root_impact(notional: Column, vol: Column, open_interest: Column, stressed: Column, regime: Column, *, k: float = 0.1, fallback: float = 5.0) -> Column:
    factor = F.coalesce(*[F.when(stressed & (regime == r), F.lit(m)) for r, m in STRESS.items()], F.lit(1.0))
    bps = k * F.sqrt(F.abs(notional) / open_interest) * F.greatest(vol, F.lit(0.0)) * 1e4 * factor
    return F.when(open_interest <= 0, F.lit(fallback)).otherwise(clamp(bps, 0.0, MAX_BPS))


def depth_impact(notional: Column, depth: Column, sigma: Column, spread_bps: Column, latency_ms: Column, *, eta: float = 0.10, alpha: float = 0.50, k: float = 0.01) -> Column:
    share = F.abs(notional) / F.greatest(depth, F.lit(1e-9))
    vol = F.greatest(sigma, F.lit(0.0))
    return clamp(F.greatest(spread_bps, F.lit(0.0)) / 2 + eta * vol * F.pow(share, F.lit(alpha)) * 1e4 + k * F.greatest(latency_ms, F.lit(0.0)) * vol, 0.0, MAX_BPS)


def cascade(*signals: Column) -> Column:
    """1, 1, 1.25, 1.5, 1.75 for 0 to 4 stress signals."""
    n = sum((s.cast("int") for s in signals[1:]), signals[0].cast("int"))
    return F.when(n >= 4, 1.75).when(n == 3, 1.50).when(n == 2, 1.25).otherwise(1.0)


def liquidation_price(entry: Column, side: Column, leverage: Column, maintenance: Column) -> Column:
    room = 1 / leverage - maintenance
    return F.when(side == "short", entry * (1 + room)).otherwise(entry * (1 - room))


def tick_round(x: Column, tick: float) -> Column:
    return F.bround(x / tick) * tick


def side_slippage_bps(side: Column, expected: Column, live: Column) -> Column:
    return F.when(expected > 0, F.when(side == "BUY", live - expected).otherwise(expected - live) / expected * 1e4).otherwise(0.0)


def queue_fill(order: Column, ahead: Column, traded: Column, cancelled: Column) -> Column:
    """What trades past the queue ahead, after cancellations in it."""
    return F.least(order, F.greatest(F.lit(0.0), traded - F.greatest(F.lit(0.0), ahead - cancelled)))


def depth_walk(levels: Column, quantity: Column) -> Column:
    """struct(filled, vwap) of eating ``quantity`` through an array of struct(price, qty), best first."""
    zero = F.struct(quantity.cast("double").alias("left"), F.lit(0.0).alias("filled"), F.lit(0.0).alias("paid"))

    def eat(s: Column, level: Column) -> Column:
        take = F.least(s["left"], level["qty"])
        return F.struct((s["left"] - take).alias("left"), (s["filled"] + take).alias("filled"), (s["paid"] + take * level["price"]).alias("paid"))

    return F.aggregate(levels, zero, eat, lambda s: F.struct(s["filled"].alias("filled"), F.when(s["filled"] > 0, s["paid"] / s["filled"]).alias("vwap")))


def depth_within(levels: Column, mid: Column, bps: float) -> Column:
    """Notional of the levels within ``bps`` of the mid."""
    near = F.filter(levels, lambda x: F.abs(x["price"] / mid - 1) * 1e4 <= bps)
    return F.aggregate(near, F.lit(0.0), lambda s, x: s + x["price"] * x["qty"])


def stacked_imbalance(bids: Column, asks: Column, threshold: float) -> Column:
    """Levels at which one side holds ``threshold`` times the other."""
    pairs = F.zip_with(bids, asks, lambda b, a: F.when(b["qty"].isNull() | a["qty"].isNull(), False).otherwise((b["qty"] >= threshold * a["qty"]) | (a["qty"] >= threshold * b["qty"])))
    return F.size(F.filter(pairs, lambda x: x))


def levels(text: Column, scale: Column | None = None) -> Column:
    """Nested JSON lists of strings [[price, qty], ...] as array of struct(price, qty); bad levels are left out."""
    parsed = F.from_json(text, "array<array<string>>")
    rows = F.transform(parsed, lambda x: F.struct(F.get(x, F.lit(0)).try_cast("double").alias("price"), F.get(x, F.lit(1)).try_cast("double").alias("qty")))
    return F.filter(rows, lambda x: (x["price"] > 0) & (x["qty"] > 0))


def epoch_timestamp(text: Column) -> Column:
    """13 digits and more are milliseconds, fewer seconds (``x.0`` too), else ISO text; UTC."""
    whole = F.regexp_extract(F.trim(text), r"^(\d+)(?:\.0)?$", 1)
    number = F.when(whole != "", whole.cast("bigint"))
    return F.when(F.length(whole) >= 13, F.timestamp_millis(number)).when(number.isNotNull(), F.timestamp_seconds(number)).otherwise(F.try_to_timestamp(text))


def number_or_flag(text: Column) -> Column:
    """struct(value, invalid): commas out, null markers and bad text give 0 and the flag."""
    shown = F.regexp_replace(F.trim(text), ",", "")
    value = F.when(~F.lower(shown).isin("", "na", "n/a", "null", "none", "-", "--"), shown.try_cast("double"))
    return F.struct(F.coalesce(value, F.lit(0.0)).alias("value"), value.isNull().alias("invalid"))


def base_asset(symbol: Column) -> Column:
    """Quote names are cut out in this order wherever they stand."""
    for quote in ("USDT", "USD", "BUSD", "USDC"):
        symbol = F.replace(symbol, F.lit(quote), F.lit(""))
    return symbol


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the values as sorted compact JSON."""
    return F.sha2(F.to_json(F.struct(*[c(x) for x in sorted(columns)])), 256)
