"""Bootstrap, permutation and jump paths: drawn indices joined back to the series."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import c, log_ratio
from tidemark.operators.recursive import CHUNK, first_order


BITS = 52


def drawn_number(*keys: str | Column) -> Column:
    """A number below 2**52 that follows from the keys alone (the head of a digest), so that any engine can draw it again."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c(k).cast("string") for k in keys])), 1, BITS // 4), 16, 10).cast("bigint")


def index_table(lengths: DataFrame, seeds: int, kind: str, block: int = 4) -> DataFrame:
    """``symbol, seed, position, source`` from ``lengths`` (symbol, n), drawn by digests of (symbol, seed, what is drawn).

    moving_block (I12): blocks of consecutive positions from uniform starts, cut to n.
    stationary (I13): goes on to the next position, or restarts with probability 1 / block; wraps around.
    permutation (I18): an order of all positions that leaves 0 in place.
    """
    tasks = lengths.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("_block", F.least(F.lit(block), c("n")).cast("bigint"))
    if kind == "moving_block":
        blocks = tasks.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(c("n") / c("_block")) - 1)))
        start = drawn_number("symbol", "seed", "_b", F.lit("start")) % (c("n") - c("_block") + 1)
        each = blocks.withColumn("_start", start).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), c("_block") - 1)))
        return each.select("symbol", "seed", (c("_b") * c("_block") + c("_k")).alias("position"), (c("_start") + c("_k")).alias("source"), "n").where("position < n").drop("n")
    each = tasks.withColumn("position", F.explode(F.sequence(F.lit(0).cast("bigint"), c("n") - 1)))
    by = W.partitionBy("symbol", "seed")
    if kind == "stationary":
        again = (c("position") == 0) | (drawn_number("symbol", "seed", "position", F.lit("again")) % c("_block") == 0)
        start = drawn_number("symbol", "seed", "position", F.lit("start")) % c("n")
        last = F.last(F.when(again, F.struct("position", start.alias("start"))), ignorenulls=True).over(by.orderBy("position").rowsBetween(W.unboundedPreceding, 0))
        return each.withColumn("_last", last).select("symbol", "seed", "position", ((c("_last.start") + c("position") - c("_last.position")) % c("n")).alias("source"))
    if kind == "permutation":
        order = F.when(c("position") > 0, drawn_number("symbol", "seed", "position", F.lit("order"))).otherwise(-1)
        return each.select("symbol", "seed", (F.row_number().over(by.orderBy(order, "position")) - 1).cast("bigint").alias("position"), c("position").alias("source"))
    raise ValueError(f"no such resampling: {kind}")


def resampled(series: DataFrame, seeds: int, kind: str, block: int = 4) -> DataFrame:
    """The series (symbol, i, ...) once a seed, in drawn order: a join of the index table with it."""
    lengths = series.groupBy("symbol").agg(F.count("*").alias("n"))
    picks = index_table(lengths, seeds, kind, block)
    return picks.join(series.withColumnRenamed("i", "source"), ["symbol", "source"])


def permuted_paths(series: DataFrame, seeds: int) -> DataFrame:
    """Close paths rebuilt from shuffled returns; the product is a running sum of logarithms.

    After a close of 0 a path is 0, and NaN once the return from 0 is drawn too.
    """
    by = W.partitionBy("symbol").orderBy("i")
    ret = F.coalesce(log_ratio("close", F.lag("close").over(by)), F.lit(0.0))
    drawn = resampled(series.withColumns({"ret": ret, "start": F.first("close").over(by)}).select("symbol", "i", "ret", "start"), seeds, "permutation")
    path = W.partitionBy("symbol", "seed").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    return drawn.select("symbol", "seed", "position", "source", (c("start") * F.exp(F.sum("ret").over(path))).alias("close"))


def wild_weights(lengths: DataFrame, seeds: int, block: int = 4, chunk: int = CHUNK) -> DataFrame:
    """``symbol, seed, i, weight`` from ``lengths`` (symbol, n): a first-order autoregression of fair signs drawn by digests.

    The weight keeps exp(-1 / block) of the one before it; the recursion is
    composed over chunks of bars.
    """
    keep = math.exp(-1 / max(1.0, block))
    noise = math.sqrt(max(0.0, 1 - keep * keep))
    each = lengths.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), c("n") - 1)))
    sign = lambda *keys: 1.0 - 2.0 * (drawn_number(*keys) % 2)
    shock, first = sign("symbol", "seed", "i", F.lit("shock")), sign("symbol", "seed", F.lit("first"))
    # weight += gain * (x - weight); the first bar takes its x whole
    x = F.when(c("i") == 0, keep * first + noise * shock).otherwise(noise * shock / (1 - keep))
    walked = first_order(each.withColumn("_path", F.concat_ws(":", c("symbol").cast("string"), c("seed").cast("string"))), {"weight": (x, F.when(c("i") == 0, 1.0).otherwise(1 - keep))}, key="_path", chunk=chunk)
    return walked.select("symbol", "seed", "i", "weight")


LEAST_PRICE = 1e-9


def wild_paths(candles: DataFrame, seeds: int, block: int = 4, chunk: int = CHUNK) -> DataFrame:
    """``symbol, seed, i, weight, open, high, low, close, funding, oi, liq`` of paths whose centred returns carry the weights.

    A close is the one before it times one plus the shocked return, at least
    ``LEAST_PRICE``.  In logarithms that is the running sum and the largest of
    what floors before it have left, so a path is two running windows.  Sidecars
    are shocked about their means by the same weights, stocks never below 0.
    """
    series, by, path = W.partitionBy("symbol").orderBy("i"), W.partitionBy("symbol"), W.partitionBy("symbol", "seed").orderBy("i")
    before, floor = F.lag("close").over(series), math.log(LEAST_PRICE)
    ret = F.when(before.isNotNull(), F.when(before != 0, c("close") / before - 1).otherwise(0.0))
    base = candles.withColumns({"_ret": ret, "_first": F.first("close").over(series)}).withColumns({"_mean": F.avg("_ret").over(by)} | {f"_m_{x}": F.avg(x).over(by) for x in ("funding", "oi", "liq")})
    drawn = base.join(wild_weights(base.groupBy("symbol").agg(F.count("*").alias("n")), seeds, block, chunk), ["symbol", "i"])
    factor = 1 + c("_mean") + (c("_ret") - c("_mean")) * c("weight")
    step = drawn.withColumn("_step", F.when(c("_ret").isNull(), 0.0).when(factor > 0, F.log(factor)))
    # a factor of 0 or less puts the price on the floor, from where it goes on
    cut = step.withColumn("_cut", F.sum(F.when(c("_step").isNull(), 1).otherwise(0)).over(path.rowsBetween(W.unboundedPreceding, 0)))
    part = W.partitionBy("symbol", "seed", "_cut").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    summed = cut.withColumn("_sum", F.sum(F.coalesce("_step", F.lit(0.0))).over(part))
    start = F.when(c("_cut") == 0, F.log(F.greatest(c("_first"), F.lit(LEAST_PRICE)))).otherwise(floor)
    closes = summed.withColumn("_close", F.exp(c("_sum") + F.greatest(start, F.max(floor - c("_sum")).over(part))))
    alone = F.max("i").over(by) == 0
    opened = closes.withColumns({"_new": F.when(alone, c("close")).otherwise(c("_close"))}).withColumn("_open", F.when(alone, c("open")).otherwise(F.coalesce(F.lag("_new").over(path), c("_new"))))
    base_close = F.when(c("close") != 0, c("close")).otherwise(c("_new"))
    high, low = F.greatest("_open", "_new", c("_new") * F.greatest(c("high") / base_close, F.lit(1.0))), F.least("_open", "_new", c("_new") * F.least(c("low") / base_close, F.lit(1.0)))
    shocked = lambda x: c(f"_m_{x}") + (c(x) - c(f"_m_{x}")) * c("weight")
    return opened.select(
        "symbol", "seed", "i", "weight", c("_open").alias("open"), F.when(alone, c("high")).otherwise(high).alias("high"), F.when(alone, c("low")).otherwise(low).alias("low"), c("_new").alias("close"),
        shocked("funding").alias("funding"), F.greatest(shocked("oi"), F.lit(0.0)).alias("oi"), F.greatest(shocked("liq"), F.lit(0.0)).alias("liq"),
    )


def shared_blocks(series: DataFrame, seeds: int, block: int = 4, time: str = "ts") -> DataFrame:
    """``series`` once a seed in the order of blocks drawn on one calendar for all symbols.

    ``position`` counts the calendar's bars, ``drawn_ts`` is the bar that stands
    there; symbols that have no such bar have no row, so that what happened at
    the same time stays together.  The calendar, the distinct bars of all
    symbols, is numbered in one place; it grows with time, not with symbols.
    """
    calendar = series.select(c(time).alias("drawn_ts")).distinct().withColumn("source", (F.row_number().over(W.orderBy("drawn_ts")) - 1).cast("bigint"))
    lengths = calendar.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("calendar").alias("symbol"), "n")
    picks = index_table(lengths, seeds, "moving_block", block).drop("symbol").join(calendar, "source")
    return picks.select("seed", "position", "drawn_ts").join(series, c("drawn_ts") == c(time))


def superior_ability(excess: DataFrame, seeds: int, block: int = 4) -> DataFrame:
    """``n, models, statistic, p_lower, p_consistent, p_upper`` of the test for superior predictive ability.

    ``excess``: ``model, t, d``, the advantage of each model over the benchmark at
    every t from 0 to n - 1.  The statistic is the largest studentised mean
    advantage, 0 at least; its distribution under no superiority comes from
    ``seeds`` moving-block resamples that all models share, recentred in the three
    usual ways (by the positive part, by means above -sqrt(2 log log n) standard
    errors, and by all means).  A block's sum is the difference of two running
    sums, so no path is ever made; models that never vary take no part.
    """
    n = excess.agg((F.max("t") + 1).alias("n"))
    blocks = index_table(n.where("n > 0").select(F.lit("calendar").alias("symbol"), "n"), seeds, "moving_block", block)
    drawn = blocks.groupBy("seed", F.floor(c("position") / F.lit(block)).alias("_b")).agg(F.min("source").alias("_from"), F.max("source").alias("_to"))
    running = F.sum("d").over(W.partitionBy("model").orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    sums = excess.withColumn("_s", running)
    one = drawn.join(sums.select("model", c("t").alias("_from"), (c("_s") - c("d")).alias("_before")), "_from").join(sums.select("model", c("t").alias("_to"), c("_s").alias("_after")), ["model", "_to"])
    size = excess.groupBy("model").agg(F.avg("d").alias("mean"), F.count("*").alias("n"))
    star = one.groupBy("model", "seed").agg(F.sum(c("_after") - c("_before")).alias("_total")).join(size, "model").withColumn("star", c("_total") / c("n"))
    spread = star.groupBy("model", "mean", "n").agg(F.sqrt(c("n") * F.avg((c("star") - c("mean")) ** 2)).alias("omega")).where("omega > 1e-12")
    root = F.sqrt("n")
    least = -c("omega") / root * F.sqrt(2 * F.log(F.log(F.greatest(c("n"), F.lit(3)))))
    centres = spread.withColumns({"z": root * c("mean") / c("omega"), "lower": F.greatest("mean", F.lit(0.0)), "consistent": F.when(c("mean") >= least, c("mean")).otherwise(0.0), "upper": c("mean")})
    kinds = ("lower", "consistent", "upper")
    worst = star.select("model", "seed", "star").join(centres, "model").groupBy("seed").agg(*[F.greatest(F.max(root * (c("star") - c(k)) / c("omega")), F.lit(0.0)).alias(k) for k in kinds])
    top = centres.agg(F.max("n").alias("n"), F.count("*").alias("models"), F.greatest(F.max("z"), F.lit(0.0)).alias("statistic"))
    # one row against one a seed
    return worst.join(F.broadcast(top), F.lit(True)).groupBy("n", "models", "statistic").agg(*[F.avg((c(k) > c("statistic")).cast("double")).alias(f"p_{k}") for k in kinds])


def jump_paths(spark: SparkSession, seeds: int, bars: int, *, drift: float = 0.0, vol: float = 0.01, intensity: float = 0.05, jump_mean: float = -0.02, jump_vol: float = 0.01, start: float = 100.0) -> DataFrame:
    """``seed, position, price`` of jump-diffusion paths."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seed in batch["id"]:
                rng, price, prices = random.Random(int(seed)), start, [start]
                for _ in range(bars - 1):
                    step = rng.gauss(drift, vol)
                    if rng.random() < intensity:
                        step += rng.gauss(jump_mean, jump_vol)
                    price = max(price * math.exp(step), 1e-9)
                    prices.append(round(price, 8))
                yield pd.DataFrame({"seed": int(seed), "position": range(bars), "price": prices})

    return spark.range(seeds).repartition(max(1, min(seeds, spark.sparkContext.defaultParallelism)), "id").mapInPandas(make, "seed bigint, position bigint, price double")
