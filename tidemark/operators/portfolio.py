"""Portfolio operators: order-dependent allocation under caps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import c


def allocate(candidates: DataFrame, *, equity: float, per_symbol: float, leverage: float, drawdown_budget: float, group: str = "book") -> DataFrame:
    """Greedy allocation in ``rank`` order within each ``group``: each candidate (book, rank, symbol, notional, max_drawdown) is taken
    or rejected with the first cap it breaks.  Books run side by side; a book is read in order batch by batch, and only what its
    symbols hold is kept between batches, so it may have any number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, held, gross, used = [], {}, 0.0, 0.0
        for batch in batches:
            verdicts = []
            for key, symbol, notional, loss in batch[["_key", "symbol", "notional", "max_drawdown"]].itertuples(index=False):
                if book != [key]:
                    book, held, gross, used = [key], {}, 0.0, 0.0
                checks = {
                    "per_symbol_exposure_limit": held.get(symbol, 0.0) + notional > per_symbol,
                    "aggregate_leverage_limit": (gross + notional) / equity > leverage,
                    "drawdown_budget_limit": used + notional / equity * loss > drawdown_budget,
                }
                verdict = next((k for k, broken in checks.items() if broken), None)
                verdicts.append(verdict)
                if verdict is None:
                    held[symbol] = held.get(symbol, 0.0) + notional
                    gross += notional
                    used += notional / equity * loss
            out = batch[[group, "rank", "symbol", "notional"]].copy()
            out["rejection"] = pd.Series(verdicts, index=out.index, dtype=object)
            yield out

    kinds = dict(candidates.dtypes)
    # the text of the key, in which NULL differs from every value, tells books apart whatever their type
    ordered = candidates.withColumn("_key", F.to_json(F.struct(group))).repartition("_key").sortWithinPartitions("_key", "rank")
    return ordered.mapInPandas(run, f"{group} {kinds[group]}, rank {kinds['rank']}, symbol {kinds['symbol']}, notional double, rejection string")


def score_tilt(candidates: DataFrame, score: str, *, by: str, cap: float) -> DataFrame:
    """Weights in proportion to positive scores, capped and brought back to a sum of one at most."""
    of = W.partitionBy(by)
    positive = F.greatest(c(score), F.lit(0.0))
    capped = candidates.withColumn("_w", F.least(F.lit(cap), F.when(F.sum(positive).over(of) > 0, positive / F.sum(positive).over(of)).otherwise(0.0)))
    return capped.withColumn("weight", F.when(F.sum("_w").over(of) > 0, c("_w") / F.sum("_w").over(of)).otherwise(0.0)).drop("_w")
