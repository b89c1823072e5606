"""Operators over books, trades and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import venue as v
from tidemark.functions.columns import c
from tidemark.functions.research import absorption
from tidemark.operators.joins import interval_aggregate


def microstructure(depths: DataFrame, trades: DataFrame, *, threshold: float = 0.5, spike: float = 3.0) -> DataFrame:
    """Features of each depth snapshot (``symbol, at, bids, asks``) with the trades (``symbol, at, price, qty, buyer_is_maker``) since the one before.

    The first snapshot of a symbol takes all trades up to it.  One shuffle by
    symbol for each side; trades are summed onto snapshots before the join.
    """
    flow = interval_aggregate(depths.select("symbol", "at"), trades, by=["symbol"], on="at", aggregates=[F.sum(v.signed_notional(c("price"), c("qty"), c("buyer_is_maker"))).alias("signed_delta"), F.count("*").alias("trade_count")])
    bid, ask = v.best(c("bids")), v.best(c("asks"))
    d = depths.withColumns({"best_bid": bid, "best_ask": ask, "mid": F.when((bid != 0) & (ask != 0), (bid + ask) / 2).otherwise(0.0), "top_depth": v.top_notional(c("bids")) + v.top_notional(c("asks"))})
    d = d.withColumns({
        "spread_bps": F.when(c("mid") != 0, (c("best_ask") - c("best_bid")) / c("mid") * 10_000).otherwise(0.0), "bid_depth_1bp": v.near_notional(c("bids"), c("mid"), "bid", 1.0), "ask_depth_1bp": v.near_notional(c("asks"), c("mid"), "ask", 1.0),
        "imbalanced_levels": v.imbalanced_levels(c("bids"), c("asks"), threshold),
    })
    before = W.partitionBy("symbol").orderBy("at")
    depth_before, spread_before = F.coalesce(F.lag("top_depth").over(before), F.lit(0.0)), F.coalesce(F.lag("spread_bps").over(before), F.lit(0.0))
    d = d.withColumns({"replenishment": F.when(depth_before > 0, (c("top_depth") - depth_before) / depth_before).otherwise(0.0), "spread_spike": ((spread_before > 0) & (c("spread_bps") >= spread_before * spike)).cast("int")})
    out = d.join(flow, ["symbol", "at"], "left").na.fill(0.0, ["signed_delta"]).na.fill(0, ["trade_count"])
    # trades that cancel out sum to 0 or to a rest of rounding, by the order of the rows
    delta = F.when(F.round("signed_delta", 9) != 0, c("signed_delta")).otherwise(0.0)
    return out.withColumn("absorption", absorption(delta, c("top_depth"))).drop("mid", "top_depth")


def walk_levels(levels: DataFrame, *, by: str, order: list, quantity: float, price: str = "price", size: str = "qty") -> DataFrame:
    """``by, filled, vwap`` of an order of ``quantity`` against all levels of each book, the best first; levels without size are none.

    A level gives what the levels ahead of it leave: a running sum, so a book of
    any depth is never an array.
    """
    ahead = F.coalesce(F.sum(size).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    taken = levels.where(c(size) > 0).withColumn("_taken", F.least(c(size), F.greatest(F.lit(0.0), F.lit(quantity) - ahead)))
    filled = F.sum("_taken")
    return taken.groupBy(by).agg(filled.alias("filled"), F.when(filled != 0, F.sum(c("_taken") * c(price)) / filled).alias("vwap"))


def trimmed_mean(df: DataFrame, by: str, value: str, share: float = 0.10) -> DataFrame:
    """``by, trimmed``: the mean of a group's non-negative values without a tenth at both ends (of five values and more).

    Ranks come from the counts of distinct values, summed in order, so a value
    repeated any number of times is one row.
    """
    counts = df.where(c(value) >= 0).groupBy(by, value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(by).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumns({"_to": upto, "_all": F.sum("_n").over(W.partitionBy(by))})
    cut = F.when(c("_all") < 5, 0).otherwise(F.greatest(F.lit(1), F.floor(c("_all") * share)))
    kept = F.greatest(F.lit(0), F.least(c("_to"), c("_all") - cut) - F.greatest(c("_to") - c("_n"), cut))
    return ranked.withColumn("_kept", kept).groupBy(by).agg((F.sum(c(value) * c("_kept")) / F.sum("_kept")).alias("trimmed"))


def impact_calibration(orders: DataFrame, by: str, *, least: int = 200) -> DataFrame:
    """One row of coefficients a group of order telemetry.

    Needs ``target`` (``venue.impact_target_bps``), ``sqrt_share``, ``spread_bps``,
    ``vol_15m``, ``latency_ms``, ``funding_window``, ``fill_completion`` and
    ``bucket``; a bucket of under ``least`` orders guards the group.
    """
    bounded = lambda x, cap: F.greatest(F.lit(0.0), F.least(F.lit(cap), F.coalesce(F.percentile(F.when(x > 0, c("target") / x), F.lit(0.5)), F.lit(0.0))))
    inside, outside = F.avg(F.when(c("funding_window"), c("target"))), F.avg(F.when(~c("funding_window"), c("target")))
    sums = orders.groupBy(by).agg(
        F.count("*").alias("sample_count"), bounded(c("spread_bps"), 2.0).alias("spread"), bounded(c("vol_15m") * 10_000, 5.0).alias("volatility"), bounded(c("latency_ms"), 0.25).alias("latency"),
        F.greatest(F.lit(0.0), F.coalesce(inside - outside, F.lit(0.0))).alias("funding"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("fill_completion"))).alias("queue_fill"),
    )
    impact = trimmed_mean(orders.where("sqrt_share > 0").select(by, (c("target") / c("sqrt_share")).alias("_x")), by, "_x").withColumnRenamed("trimmed", "impact")
    guarded = orders.groupBy(by, "bucket").agg(F.count("*").alias("_n")).groupBy(by).agg(F.min("_n").alias("_least"))
    status = F.when(c("_least") < least, "sample_guarded").otherwise("usable")
    return sums.join(impact, by, "left").join(guarded, by).na.fill(0.0, ["impact"]).withColumn("status", status).drop("_least")
