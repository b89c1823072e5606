"""First-order recursions over long series and what is built of them.

EMA, Wilder's ATR and RSI and KAMA are all ``y += gain * (x - y)`` with a gain
that differs by bar.  The steps are affine maps, so a series is cut into chunks
of bars: each chunk is folded into one map, a small scan over the chunks gives
each its start, and chunks then run side by side.  No task sees a whole series.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import by_symbol, c, rows

CHUNK = 4096


class _Walk:
    """Runs the recursions over batches of rows sorted by series, chunk and bar; each chunk begins at its own start."""

    def __init__(self, names: list[str], key: str) -> None:
        self.names, self.key, self.at, self.y = names, key, None, dict.fromkeys(names, 0.0)

    def __call__(self, pdf: pd.DataFrame) -> dict[str, list[float]]:
        groups = list(zip(pdf[self.key].tolist(), pdf["_chunk"].tolist(), strict=True))
        new = [a != b for a, b in zip(groups, [self.at, *groups[:-1]], strict=True)]
        self.at = groups[-1]
        out = {}
        for n in self.names:
            y, values = self.y[n], []
            for first, x, gain, start in zip(new, pdf[f"_x_{n}"].tolist(), pdf[f"_g_{n}"].tolist(), pdf[f"_s_{n}"].tolist(), strict=True):
                if first:
                    y = start
                y += gain * (x - y)
                values.append(y)
            self.y[n], out[n] = y, values
        return out


def first_order(df: DataFrame, columns: dict[str, tuple[Column, Column]], *, key: str = "symbol", order: str = "i", chunk: int = CHUNK) -> DataFrame:
    """``df`` with a column for each ``name: (x, gain)``; the first bar of a series needs gain 1.  ``order`` counts bars from 0."""
    names, kept = list(columns), list(df.columns)
    fed = df.withColumns({f"_x_{n}": x.cast("double") for n, (x, _) in columns.items()} | {f"_g_{n}": g.cast("double") for n, (_, g) in columns.items()}).withColumn("_chunk", F.floor(c(order) / chunk))
    kind = dict(df.dtypes)[key]
    pairs = [f"_{p}_{n}" for n in names for p in ("x", "g")]

    def sorted_by_chunk(x: DataFrame) -> DataFrame:
        return x.repartition(key, "_chunk").sortWithinPartitions(key, "_chunk", order)

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = _Walk(names, key)
        for pdf in batches:
            if len(pdf):
                yield pdf[kept].assign(**walk(pdf))

    def last_only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = _Walk(names, key)
        for pdf in batches:
            if len(pdf):
                yield pdf[[key, "_chunk", order]].assign(**walk(pdf))

    # what a chunk makes of a start y is a * y + b: a is the product of what is kept, b the walk from 0
    zero = fed.select(key, order, "_chunk", *pairs, *[F.lit(0.0).alias(f"_s_{n}") for n in names])
    ends = sorted_by_chunk(zero).mapInPandas(last_only, f"{key} {kind}, _chunk bigint, {order} bigint, " + ", ".join(f"{n} double" for n in names))
    b = ends.groupBy(key, "_chunk").agg(*[F.max_by(n, order).alias(f"b_{n}") for n in names])
    a = fed.groupBy(key, "_chunk").agg(*[F.product(1 - c(f"_g_{n}")).alias(f"a_{n}") for n in names])

    def scanned(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_chunk").reset_index(drop=True)
        out = g[[key, "_chunk"]].copy()
        for n in names:
            y, starts = 0.0, []
            for keep, made in zip(g[f"a_{n}"], g[f"b_{n}"], strict=True):
                starts.append(y)
                y = keep * y + made
            out[f"_s_{n}"] = starts
        return out

    # only series of several chunks need their maps; the first chunk of all starts at 0
    long_series = fed.where(c("_chunk") > 0).select(key).distinct()
    maps = a.join(b, [key, "_chunk"]).join(long_series, key, "left_semi")
    starts = maps.groupBy(key).applyInPandas(scanned, f"{key} {kind}, _chunk bigint, " + ", ".join(f"_s_{n} double" for n in names))
    joined = fed.join(starts, [key, "_chunk"], "left").na.fill(0.0, [f"_s_{n}" for n in names]).select(*kept, "_chunk", *pairs, *[f"_s_{n}" for n in names])
    fields = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)
    return sorted_by_chunk(joined).mapInPandas(walked, fields + "".join(f", {n} double" for n in names))


def warmed_gain(period: int, gain: float, index: Column | None = None) -> Column:
    """An expanding mean for ``period`` bars, then the constant gain."""
    i = c("i") if index is None else index
    return F.when(i < period, 1 / (i + 1)).otherwise(F.lit(gain))


def ema_pair(x: str, period: int) -> tuple[Column, Column]:
    return c(x), warmed_gain(period, 2 / (period + 1))


def true_range() -> Column:
    before = F.lag("close").over(by_symbol())
    return F.coalesce(F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before)), c("high") - c("low"))


def indicators(df: DataFrame, *, ema: int = 10, atr: int = 14, rsi: int = 14, kama: tuple[int, int, int] = (10, 2, 30), chunk: int = CHUNK) -> DataFrame:
    """Candles with ``ema, atr, rsi, kama, er, z`` in one pass over the chunks."""
    n, fast, slow = kama
    change = F.coalesce(c("close") - F.lag("close").over(by_symbol()), F.lit(0.0))
    base = df.withColumns({"_change": change, "_tr": true_range()})
    path = F.sum(F.abs("_change")).over(rows(n - 1))
    er = F.when(c("i") < n, 0.0).when(path > 1e-12, F.least(F.lit(1.0), F.abs(c("close") - F.lag("close", n).over(by_symbol())) / path)).otherwise(0.0)
    base = base.withColumn("er", er)
    sc = F.pow(c("er") * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1), 2)
    # changes start at bar 1; bar 0 resets the averages to its own zero change
    wilder = F.when(c("i") <= 1, F.lit(1.0)).otherwise(warmed_gain(rsi, 1 / rsi, c("i") - 1))
    out = first_order(base, {
        "ema": ema_pair("close", ema), "atr": (c("_tr"), warmed_gain(atr, 1 / atr)), "_up": (F.greatest("_change", F.lit(0.0)), wilder), "_down": (F.greatest(-c("_change"), F.lit(0.0)), wilder),
        "kama": (c("close"), F.when(c("i") < n, 1.0).otherwise(sc)),
    }, chunk=chunk)
    strength = F.when(c("i") < rsi, 50.0).when((c("_up") < 1e-12) & (c("_down") < 1e-12), 50.0).when(c("_down") < 1e-12, 100.0).otherwise(100 - 100 / (1 + c("_up") / c("_down")))
    sd = F.stddev_pop("close").over(rows(ema - 1))
    z = F.when(c("i") < ema - 1, 0.0).otherwise((c("close") - c("ema")) / F.when(sd > 0, sd).otherwise(1e-12))
    return out.withColumns({"rsi": strength, "z": z}).drop("_change", "_tr", "_up", "_down")
