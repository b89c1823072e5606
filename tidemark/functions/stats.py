"""Aggregate expressions of the validation and reporting families."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions.columns import c

#: Fixed value: what a ratio without downside counts as.
NO_DOWNSIDE = 999.0


def sharpe(ret: str, factor: float = 1.0) -> Column:
    """Mean over sample deviation; 0 under two values or without spread."""
    sd = F.stddev_samp(ret)
    return F.when((F.count(ret) > 1) & (sd > 0), F.avg(ret) / sd * factor).otherwise(0.0)


def sortino(ret: str, mar: float = 0.0, factor: float = 1.0) -> Column:
    """D3: mean excess over the population downside deviation; the sentinel without any downside."""
    down = F.sqrt(F.avg(F.pow(F.least(c(ret) - mar, F.lit(0.0)), 2)))
    mean = F.avg(ret)
    return F.when(F.count(ret) < 2, 0.0).when(down > 0, (mean - mar) / down * factor).when(mean > mar, NO_DOWNSIDE * factor).otherwise(0.0)


def calmar(pnl: Column, drawdown: Column) -> Column:
    """D12."""
    return F.when(F.abs(drawdown) > 1e-12, pnl / F.abs(drawdown)).when(pnl > 0, NO_DOWNSIDE).otherwise(0.0)


def sample_skewness(x: str) -> Column:
    """Adjusted Fisher-Pearson, from Spark's population skewness."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)


def sample_kurtosis(x: str) -> Column:
    """Bias-corrected, 3 for a normal sample; from Spark's population excess kurtosis."""
    n = F.count(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6) + 3).otherwise(3.0)


def sharpe_error(sr: Column, skew: Column, kurt: Column, n: Column) -> Column:
    """Standard error of a Sharpe ratio under skewness and kurtosis."""
    return F.sqrt(F.greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, F.lit(1e-12)) / F.greatest(n - 1, F.lit(1)))


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """Spark has no error function."""
    return x.map(NormalDist().cdf, na_action="ignore")


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return p.clip(1e-12, 1 - 1e-12).map(NormalDist().inv_cdf, na_action="ignore")


def expected_best_sharpe(spread: Column, trials: Column) -> Column:
    """Expected maximum of ``trials`` null Sharpe ratios of that spread."""
    gamma = 0.5772156649015329
    return spread * ((1 - gamma) * normal_quantile(1 - 1 / trials) + gamma * normal_quantile(1 - 1 / (trials * F.exp(F.lit(1.0)))))


def median(x: str | Column) -> Column:
    return F.percentile(c(x), F.lit(0.5))


def false_discovery_rate(df: DataFrame, p: str, slices: int = 4096) -> DataFrame:
    """``df`` with ``adjusted``: the Benjamini-Hochberg value of each row's ``p`` in [0, 1].

    Equal p-values share the value of the last of them, so only distinct ones
    are ranked, each slice of [0, 1] by itself; the slices' counts and minima,
    at most ``slices`` + 1 rows, carry ranks and running minima across them.  Rows without a p-value count for nothing and get NULL.
    """
    one = df.where(c(p).isNotNull()).groupBy(c(p).alias("_p")).agg(F.count("*").alias("_n")).withColumn("_slice", F.floor(c("_p") * slices))
    totals = one.groupBy("_slice").agg(F.sum("_n").alias("_here"))
    below = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_slice", F.coalesce(F.sum("_here").over(below), F.lit(0)).alias("_before"), F.sum("_here").over(W.partitionBy()).alias("_all"))
    rank = c("_before") + F.sum("_n").over(W.partitionBy("_slice").orderBy("_p").rowsBetween(W.unboundedPreceding, 0))
    ranked = one.join(F.broadcast(totals), "_slice").withColumn("_value", c("_p") * c("_all") / rank)
    above = W.orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    later = ranked.groupBy("_slice").agg(F.min("_value").alias("_least")).select("_slice", F.min("_least").over(above).alias("_later"))
    here = F.min("_value").over(W.partitionBy("_slice").orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, 0))
    adjusted = ranked.join(F.broadcast(later), "_slice").select("_p", F.least(F.lit(1.0), here, "_later").alias("adjusted"))
    return df.join(adjusted, c(p) == c("_p"), "left").drop("_p")
