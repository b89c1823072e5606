"""Time-series columns over candles, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import by_symbol, c, rows
from tidemark.sources.tables import checkpointed


def whole():
    return W.partitionBy("symbol")



def lag_return(x: str = "close", k: int = 1) -> Column:
    """B2: x / x[-k] - 1; 0 in the warm-up and on a zero base."""
    base = F.lag(x, k).over(by_symbol())
    return F.when(base.isNotNull() & (base != 0), c(x) / base - 1).otherwise(0.0)


def difference(x: str) -> Column:
    """First difference, 0 on the first bar."""
    return F.coalesce(c(x) - F.lag(x).over(by_symbol()), F.lit(0.0))


def realised_vol(ret: str = "ret", bars: int = 24) -> Column:
    """Root of the sum of squares (not a deviation, not annualised)."""
    return F.sqrt(F.sum(c(ret) * c(ret)).over(rows(bars - 1)))


def population_z(x: str) -> Column:
    """Full-sample z-score by the population deviation; 0 where it is 0."""
    sd = F.stddev_pop(x).over(whole())
    return F.when(sd > 0, (c(x) - F.avg(x).over(whole())) / sd).otherwise(0.0)


def expanding_abs_z(x: str) -> Column:
    """|z| against the bars so far; 0 where their deviation is 0."""
    sd = F.stddev_pop(x).over(rows(None))
    return F.when(sd > 0, F.abs((c(x) - F.avg(x).over(rows(None))) / sd)).otherwise(0.0)


def rolling_return_std(ret: str = "ret", bars: int = 30) -> Column:
    """Sample deviation of the last ``bars`` returns, the first bar having none."""
    r = F.when(c("i") > 0, c(ret))
    return F.coalesce(F.stddev_samp(r).over(rows(bars - 1)), F.lit(0.0))


def wma(x: str, period: int) -> Column:
    """Linearly weighted mean; plain mean before the first full window.

    The weighted sum is p * S0 - sum of lags' distances, which two running sums
    of x and i * x give without collecting the window.
    """
    n = F.count(F.lit(1)).over(rows(period - 1))
    plain, indexed = F.sum(x).over(rows(period - 1)), F.sum(c(x) * c("i")).over(rows(period - 1))
    weighted = indexed - (c("i") - period) * plain
    return F.when(n < period, plain / n).otherwise(weighted / (period * (period + 1) / 2))


def hma(df: DataFrame, x: str, period: int, out: str) -> DataFrame:
    """WMA of 2 WMA(p/2) - WMA(p) over round(sqrt(p)) bars (ties to even)."""
    raw = df.withColumn("_raw", 2 * wma(x, max(1, period // 2)) - wma(x, period))
    return raw.withColumn(out, wma("_raw", max(1, round(period**0.5)))).drop("_raw")


def above_percentile(x: str, p: float) -> Column:
    """Over the exact p-percentile of the whole series."""
    return c(x) > F.percentile(x, F.lit(p)).over(whole())


def below_percentile(x: str, p: float) -> Column:
    """At or under it."""
    return c(x) <= F.percentile(x, F.lit(p)).over(whole())


def upper_median(x: str) -> Column:
    """The element n // 2 of the sorted series, which is no interpolated median."""
    # from the top it is element ceil(n / 2); found once a series from counts, not once a bar
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{x}` DESC)").over(whole())


def vol_regime(vol: str) -> Column:
    """Low / normal / high against 0.75 and 1.25 of the upper median."""
    middle = upper_median(vol)
    return F.when(c(vol) < 0.75 * middle, "low").when(c(vol) > 1.25 * middle, "high").otherwise("normal")


def regime_labels(df: DataFrame) -> DataFrame:
    """One label a bar, first rule that holds; needs close, funding, oi, liq and i.

    Rule inputs are columns of one window pass; the liquidation baseline is the
    median of the series' positive values.
    """
    first = F.first("close").over(rows(4))
    prev_close, prev_oi = F.coalesce(F.lag("close").over(by_symbol()), c("close")), F.coalesce(F.lag("oi").over(by_symbol()), c("oi"))
    base = F.coalesce(F.percentile(F.when(c("liq") > 0, c("liq")), F.lit(0.5)).over(whole()), F.lit(1.0))
    peak = F.max("close").over(rows(None))
    seen = df.withColumns({
        "short_ret": F.when(first != 0, c("close") / first - 1).otherwise(0.0), "slope": c("close") - first, "bar_ret": F.when(prev_close != 0, c("close") / prev_close - 1).otherwise(0.0),
        "drawdown": F.when(peak != 0, c("close") / peak - 1).otherwise(0.0), "liq_ratio": c("liq") / F.greatest(F.lit(1.0), base), "oi_change": F.when(prev_oi != 0, F.abs(c("oi") / prev_oi - 1)).otherwise(0.0),
    })
    return seen.withColumn("regime", F.expr(REGIME_RULES))


# Thresholds and order of the regime rules.
REGIME_RULES = """CASE
  WHEN bar_ret <= -0.09 OR (drawdown <= -0.18 AND bar_ret <= 0.0) THEN 'crash'
  WHEN bar_ret >= 0.07 AND funding >= 0.01 AND liq_ratio >= 2.0 THEN 'short_squeeze'
  WHEN abs(funding) >= 0.015 OR oi_change >= 0.12 OR liq_ratio >= 2.5 THEN 'liquidity_stress'
  WHEN short_ret >= 0.04 AND slope > 0 THEN 'bull'
  WHEN short_ret <= -0.04 AND slope < 0 AND drawdown <= -0.03 THEN 'bear'
  ELSE 'sideways' END"""
CRISIS = ("crash", "short_squeeze", "liquidity_stress")


def islands(df: DataFrame, label: str) -> DataFrame:
    """Number runs of equal labels: adds ``island``, counted from 1 within a symbol."""
    change = F.when(F.lag(label).over(by_symbol()).eqNullSafe(c(label)), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn("island", F.sum("_change").over(rows(None))).drop("_change")


def segments(df: DataFrame, label: str) -> DataFrame:
    """One row a run: ``symbol, island, label, start_i, end_i`` (end exclusive)."""
    return islands(df, label).groupBy("symbol", "island").agg(F.first(label).alias("label"), F.min("i").alias("start_i"), (F.max("i") + 1).alias("end_i"))


def crisis_windows(df: DataFrame, label: str = "regime") -> DataFrame:
    """Runs of crisis labels, numbered per label in time order."""
    numbered = segments(df, label).where(c("label").isin(*CRISIS))
    n = F.row_number().over(W.partitionBy("symbol", "label").orderBy("start_i"))
    return numbered.select("symbol", F.concat_ws("-", F.replace("label", F.lit("_"), F.lit("-")), n.cast("string")).alias("name"), "label", "start_i", "end_i")


def smoothed_labels(df: DataFrame, label: str, least: int) -> DataFrame:
    """Runs shorter than ``least`` take their left neighbour's original label, else the right one's."""
    runs = segments(df, label)
    by = W.partitionBy("symbol").orderBy("island")
    new = F.when(c("end_i") - c("start_i") >= least, c("label")).otherwise(F.coalesce(F.lag("label").over(by), F.lead("label").over(by), c("label")))
    return islands(df, label).join(runs.select("symbol", "island", new.alias("smoothed")), ["symbol", "island"])


def changepoint_probability(series: list[str], hazard: float = 0.05) -> Column:
    """The largest surprise of the series against the 12 bars before (at least three of them)."""
    past = rows(12, -1)

    def surprise(x: str) -> Column:
        sd = F.coalesce(F.stddev_samp(x).over(past), F.lit(0.0))
        n = F.count(x).over(past)
        return F.when(n > 2, F.abs(c(x) - F.avg(x).over(past)) / F.greatest(sd, F.lit(1e-9))).otherwise(0.0)

    most = F.greatest(*map(surprise, series))
    return F.least(F.lit(0.99), F.lit(hazard) + (1 - hazard) * (most / (most + 3)))


def with_changepoints(df: DataFrame) -> DataFrame:
    """Adds ``p``, the changepoint probability of log returns, funding and open-interest changes (to nine places, so that flat series have no surprise)."""
    prev, po = F.lag("close").over(by_symbol()), F.coalesce(F.lag("oi").over(by_symbol()), c("oi"))
    df = df.withColumns({"fq": F.round("funding", 9), "oq": F.round(F.when(po == 0, 0.0).otherwise(c("oi") / po - 1), 9), "lr": F.round(F.when((prev > 0) & (c("close") > 0), F.log(c("close") / prev)).otherwise(0.0), 9)})
    return df.withColumn("p", changepoint_probability(["lr", "fq", "oq"]))


def changepoint_labels(df: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Adds ``relabelled``: quiet bars (``regime`` sideways) at a changepoint are under stress."""
    return df.withColumn("relabelled", F.when((c("p") >= threshold) & (c("regime") == "sideways"), "liquidity_stress").otherwise(c("regime")))


def fixed_horizon_label(x: str = "close", horizon: int = 4) -> Column:
    """Forward return; NULL where the horizon passes the end or the base is 0."""
    return F.when(c(x) != 0, F.lead(x, horizon).over(by_symbol()) / c(x) - 1)


def chronological_split(train: float = 0.6, validate: float = 0.2) -> Column:
    """By floors of the series' length."""
    n = F.count(F.lit(1)).over(whole())
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(train)) + F.floor(n * F.lit(validate))
    return F.when(c("i") < a, "train").when(c("i") < b, "validation").otherwise("test")


def funding_crossings(hours: int = 8) -> Column:
    """Settlements in (previous bar, this bar]; none on the first bar."""
    at = F.floor(F.unix_seconds(c("ts").cast("timestamp")) / (hours * 3600))
    return F.coalesce(at - F.lag(at).over(by_symbol()), F.lit(0))


def rank_in_slices(df: DataFrame, *, by: str, key: str, then: list) -> DataFrame:
    """Adds ``rank`` (1 for the greatest ``key``, ties by ``then``) and ``top`` (the greatest key) within ``by``.

    A group is cut into 256 slices of its keys at approximate quantiles; a row's
    rank is its number in its slice and the size of the slices above.  Equal
    keys share a slice, so ranks are exact and no group is sorted by one task.
    NULL groups are a group; NULL keys rank behind all others, in a slice of
    their own.
    """
    cuts = df.groupBy(c(by).alias("_by")).agg(F.percentile_approx(key, F.array(*[F.lit(k / 256) for k in range(1, 256)]), F.lit(25_600)).alias("_cuts"), F.max(key).alias("top"))
    cuts = checkpointed(cuts.withColumn("_coarse", F.transform(F.sequence(F.lit(16), F.lit(240), F.lit(16)), lambda k: F.get("_cuts", k - 1))))
    # sixteen steps of sixteen: the coarse cuts say in which of them the fine ones are to be counted
    below = lambda cuts: F.size(F.filter(cuts, lambda x: x < c(key)))
    cut = df.join(cuts, c(by).eqNullSafe(c("_by"))).withColumn("_step", below(c("_coarse")))
    cut = cut.withColumn("_slice", F.when(c(key).isNull() | c("_cuts").isNull(), -1).otherwise(16 * c("_step") + below(F.slice("_cuts", 16 * c("_step") + 1, 15)))).drop("_cuts", "_coarse", "_step")
    sizes = cut.groupBy(c("_by").alias("_of"), c("_slice").alias("_in")).agg(F.count("*").alias("_n"))
    above = sizes.select("_of", "_in", (F.sum("_n").over(W.partitionBy("_of").orderBy(F.desc("_in"))) - c("_n")).alias("_above"))
    mine = F.row_number().over(W.partitionBy("_by", "_slice").orderBy(F.desc(key), *then))
    ranked = cut.withColumn("_mine", mine).join(above, c("_by").eqNullSafe(c("_of")) & (c("_slice") == c("_in")))
    return ranked.withColumn("rank", c("_mine") + c("_above")).drop("_mine", "_above", "_slice", "_by", "_of", "_in")
