"""Signals and the event-driven backtest: sequential per run, parallel over runs.

A run is (symbol, backbone, side, leverage).  Everything a bar can know by
itself is a column before the run starts; the map over a symbol's bars holds only
the state a position needs.  Spark spreads symbols over the cluster, and the runs
of many symbols go side by side, bar by bar (``_Runs``); ``signals`` and
``backtest`` are the same for one run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import by_symbol, c, rows
from tidemark.operators.recursive import indicators
from tidemark.operators.windows import funding_crossings, hma


@dataclass(frozen=True)
class Rules:
    """Costs and venue of a run.  Basis points, bars and ratios."""

    fee_bps: float = 5.0
    slippage_bps: float = 5.0
    latency_bars: int = 0
    maintenance: float = 0.01
    liquidation_ratio: float = 1.0
    cooldown_bars: int = 0


def in_trend(er: Column, up: float = 0.6, flat: float = 0.25) -> Column:
    """Hysteresis: on from ``up``, off from ``flat``, in between as before."""
    turned = F.when(er >= up, True).when(er <= flat, False)
    return F.coalesce(F.last(turned, ignorenulls=True).over(rows(None)), F.lit(False))


def wanted_entries(candles: DataFrame) -> DataFrame:
    """Candles with an entry wish for each backbone and side, and the ATR that stops are measured in."""
    df = hma(indicators(candles, ema=20), "close", 20, "hull").withColumn("trend", in_trend(c("er")))
    change, slope = c("close") - F.lag("close").over(by_symbol()), c("hull") - F.lag("hull").over(by_symbol())
    later = c("i") >= 1
    wide = lambda sign: sign * (c("close") - c("ema")) > 2.0 * c("atr")
    wishes = {
        "momentum_long": later & (c("i") % 5 == 1) & (change > 0), "momentum_short": later & (c("i") % 5 == 1) & (change < 0),
        "adaptive_long": later & c("trend") & (slope > 0), "adaptive_short": later & c("trend") & (slope < 0),
        "fade_long": later & wide(-1) & (c("rsi") < 30) & (c("z") < -2.0), "fade_short": later & wide(1) & (c("rsi") > 70) & (c("z") > 2.0),
    }
    return df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in wishes.items()}).withColumn("settlements", funding_crossings())


#: Backbone: (stop in ATRs or None, most bars held).
BACKBONES = {"momentum": (None, 3), "adaptive": (2.0, 24), "fade": (1.5, 10)}


def signals(close: np.ndarray, atr: np.ndarray, want: np.ndarray, side: int, stop: float | None, hold: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries and exits, one position at a time; what is open at the end exits on the last bar."""
    enter, leave = np.zeros(len(close), bool), np.zeros(len(close), bool)
    since = None
    for i in range(1, len(close)):
        if since is None:
            if want[i]:
                enter[i], since = True, i
            continue
        stopped = stop is not None and side * (close[i] - close[since]) < -stop * max(atr[since], 1e-9)
        if stopped or i - since >= hold:
            leave[i], since = True, None
    if since is not None:
        leave[-1] = True
    return enter, leave


@dataclass
class _Book:
    """Running totals of a run; equity is realised and open profit on a base of one."""

    gross: float = 0.0
    fees: float = 0.0
    funding: float = 0.0
    trades: int = 0
    wins: int = 0
    liquidations: int = 0

    def cost(self, notional: float, bps: float) -> float:
        paid = abs(notional) * bps / 1e4
        self.fees += paid
        return paid

    def closed(self, profit: float, paid: float, *, liquidated: bool = False) -> None:
        self.gross += profit
        self.trades += 1
        if liquidated:
            self.liquidations += 1
        elif profit - paid > 0:
            self.wins += 1

    def equity(self, open_profit: float = 0.0) -> float:
        return self.gross - self.fees - self.funding + open_profit


def backtest(g: pd.DataFrame, enter: np.ndarray, leave: np.ndarray, side: int, leverage: float, rules: Rules) -> tuple[_Book, np.ndarray]:
    """One run over bars in order.  Returns its totals and the equity at each bar."""
    close, low, high = (g[k].to_numpy(float) for k in ("close", "low", "high"))
    rate, settlements = g["funding"].to_numpy(float), g["settlements"].to_numpy(float)
    last, bps = len(close) - 1, rules.fee_bps + rules.slippage_bps
    book, curve = _Book(), np.zeros(len(close))
    size, price, since, cool = 0.0, 0.0, -1, -1
    for i in range(len(close)):
        if size > 0:
            book.funding += side * close[i] * size * rate[i] * settlements[i]
            ruin = price * (1 - side * (1 / leverage - rules.maintenance))
            worst = low[i] if side > 0 else high[i]
            if side * (worst - ruin) <= 0 and i >= since and i > cool:
                part = size * rules.liquidation_ratio
                book.closed(side * (ruin - price) * part, book.cost(ruin * part, bps), liquidated=True)
                size -= part
                cool = i + rules.cooldown_bars
                if size <= 1e-9:
                    size = 0.0
                curve[i] = book.equity(side * (close[i] - price) * size)
                continue
        fill = min(i + rules.latency_bars, last)
        if size == 0 and enter[i]:
            size, price, since = leverage, close[fill], fill
            book.cost(price * size, bps)
        elif size > 0 and leave[i] and i >= since:
            book.closed(side * (close[fill] - price) * size, book.cost(close[fill] * size, bps))
            size = 0.0
        curve[i] = book.equity(side * (close[i] - price) * size if i > since else 0.0)
    if size > 0:
        book.closed(side * (close[-1] - price) * size, book.cost(close[-1] * size, bps))
        curve[-1] = book.equity()
    return book, curve


class _Runs:
    """The runs of many series side by side: ``signals`` and ``backtest`` of each, one step a bar for all.

    Series are ordered by length, so that the first ``alive`` of them have a bar
    at each step.  Runs are the columns: backbone, side, leverage.
    """

    def __init__(self, table: pa.Table, leverages: tuple[float, ...], rules: Rules) -> None:
        codes = pc.dictionary_encode(table["symbol"].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        sizes = np.diff(np.append(starts, len(codes)))
        order = np.argsort(-sizes, kind="stable")
        self.starts, self.sizes, self.rules = starts[order], sizes[order], rules
        self.names = [(b, s, x) for b in BACKBONES for s in SIDES for x in leverages]
        self.side, self.leverage = np.array([SIDES[s] for _, s, _ in self.names]), np.array([x for *_, x in self.names])
        bars = np.minimum(np.arange(self.sizes[0]), self.sizes[:, None] - 1)  # beyond its end a series stays at its last bar
        self.at = self.starts[:, None] + bars
        self.bar = {k: table[k].to_numpy().astype(float)[self.at] for k in ("close", "low", "high", "atr", "funding", "settlements")}
        self.wants = {(b, s): table[f"{b}_{s}"].to_numpy().astype(bool)[self.at] for b in BACKBONES for s in SIDES}
        self.alive = [int(np.searchsorted(-self.sizes, -i, side="left")) for i in range(self.sizes[0])]

    def signals(self) -> tuple[np.ndarray, np.ndarray]:
        """Entries and exits of (series, bar, run)."""
        close, atr = self.bar["close"], self.bar["atr"]
        n, bars = close.shape
        want = np.stack([self.wants[b, s] for b, s, _ in self.names], 2)
        stop, hold = np.array([np.nan if BACKBONES[b][0] is None else BACKBONES[b][0] for b, *_ in self.names]), np.array([BACKBONES[b][1] for b, *_ in self.names])
        enter, leave = np.zeros(want.shape, bool), np.zeros(want.shape, bool)
        since, price, width = np.full((n, len(self.names)), -1), np.zeros((n, len(self.names))), np.zeros((n, len(self.names)))
        for i in range(1, bars):
            m = self.alive[i]
            held, now = since[:m] >= 0, close[:m, i, None]
            starts = ~held & want[:m, i]
            # no stop is NaN, which nothing is below
            stopped = self.side * (now - price[:m]) < -stop * np.maximum(width[:m], 1e-9)
            out = held & (stopped | (i - since[:m] >= hold))
            enter[:m, i], leave[:m, i] = starts, out
            price[:m], width[:m] = np.where(starts, now, price[:m]), np.where(starts, atr[:m, i, None], width[:m])
            since[:m] = np.where(starts, i, np.where(out, -1, since[:m]))
        rows = np.arange(n)
        leave[rows, self.sizes - 1] |= since >= 0
        return enter, leave

    def totals(self) -> dict[str, np.ndarray]:
        """Totals of (series, run), and ``curve``, the equity of (series, run, bar)."""
        rules, side, leverage, bar = self.rules, self.side, self.leverage, self.bar
        enter, leave = self.signals()
        n, bars, k = enter.shape
        bps = rules.fee_bps + rules.slippage_bps
        t = {x: np.zeros((n, k)) for x in ("gross", "fees", "funding")} | {x: np.zeros((n, k), int) for x in ("trades", "wins", "liquidations")}
        curve = np.zeros((n, k, bars))
        size, price, since, cool = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), -1), np.full((n, k), -1)
        cost = lambda notional: np.abs(notional) * bps / 1e4

        def closed(m: int, which: np.ndarray, profit: np.ndarray, paid: np.ndarray) -> None:
            t["fees"][:m] += np.where(which, paid, 0.0)
            t["gross"][:m] += np.where(which, profit, 0.0)
            t["trades"][:m] += which

        equity = lambda m: t["gross"][:m] - t["fees"][:m] - t["funding"][:m]
        for i in range(bars):
            m = self.alive[i]
            close, low, high, rate, settlements = (bar[x][:m, i, None] for x in ("close", "low", "high", "funding", "settlements"))
            z, p, s = size[:m], price[:m], since[:m]
            t["funding"][:m] += np.where(z > 0, side * close * z * rate * settlements, 0.0)
            ruin = p * (1 - side * (1 / leverage - rules.maintenance))
            ruined = (z > 0) & (side * (np.where(side > 0, low, high) - ruin) <= 0) & (i >= s) & (i > cool[:m])
            part = z * rules.liquidation_ratio
            closed(m, ruined, side * (ruin - p) * part, cost(ruin * part))
            t["liquidations"][:m] += ruined
            z = np.where(ruined, z - part, z)
            z = np.where(ruined & (z <= 1e-9), 0.0, z)
            cool[:m] = np.where(ruined, i + rules.cooldown_bars, cool[:m])
            fill = np.minimum(i + rules.latency_bars, self.sizes[:m] - 1)[:, None]
            filled = np.take_along_axis(bar["close"][:m], fill, 1)
            opens = ~ruined & (z == 0) & enter[:m, i]
            shuts = ~ruined & (z > 0) & leave[:m, i] & (i >= s)
            t["fees"][:m] += np.where(opens, cost(filled * leverage), 0.0)
            profit, paid = side * (filled - p) * z, cost(filled * z)
            closed(m, shuts, profit, paid)
            t["wins"][:m] += shuts & (profit - paid > 0)
            size[:m], price[:m], since[:m] = np.where(opens, leverage, np.where(shuts, 0.0, z)), np.where(opens, filled, p), np.where(opens, fill, s)
            running = side * (close - price[:m]) * size[:m]
            curve[:m, :, i] = equity(m) + np.where(ruined | (i > since[:m]), running, 0.0)
        last = bar["close"][:, -1, None]
        profit, paid, left = side * (last - price) * size, cost(last * size), size > 0
        closed(n, left, profit, paid)
        t["wins"] += left & (profit - paid > 0)
        rows = np.arange(n)
        curve[rows, :, self.sizes - 1] = np.where(left, equity(n), curve[rows, :, self.sizes - 1])
        return t | {"net_pnl": equity(n), "curve": curve}

    def report(self, symbol: pa.ChunkedArray) -> pa.RecordBatch:
        """One row a run."""
        with np.errstate(invalid="ignore", over="ignore"):
            t = self.totals()
            drawdown, sharpe = np.zeros(t["gross"].shape), np.zeros(t["gross"].shape)
            for at, (curve, size) in enumerate(zip(t["curve"], self.sizes, strict=True)):
                level = np.maximum(1e-9, 1 + curve[:, :size])
                drawdown[at] = (level / np.maximum.accumulate(level, 1) - 1).min(1)
                if size > 2:
                    steps = np.diff(curve[:, :size])
                    spread = steps.std(1, ddof=1)
                    sharpe[at] = np.divide(steps.mean(1), spread, out=np.zeros(len(spread)), where=spread > 0)
        k = len(self.names)
        every = np.repeat(self.starts, k)
        name, side, leverage = (pa.array(list(x) * len(self.sizes)) for x in zip(*self.names, strict=True))
        columns = {
            "symbol": symbol.take(pa.array(every)).combine_chunks(), "backbone": name, "side": side, "leverage": leverage, "bars": np.repeat(self.sizes, k), "trades": t["trades"], "wins": t["wins"], "liquidations": t["liquidations"], "gross_pnl": t["gross"], "fees": t["fees"],
            "funding": t["funding"], "net_pnl": t["net_pnl"], "max_drawdown": drawdown, "sharpe": sharpe,
        }
        return pa.RecordBatch.from_pydict({n: pa.array(x.ravel()) if isinstance(x, np.ndarray) else x for n, x in columns.items()})


SIDES = {"long": 1, "short": -1}
# Bars that are worked on at once; a longer series is alone.
BARS = 65_536


def run_backtests(candles: DataFrame, leverages: tuple[float, ...] = (1.0, 5.0), rules: Rules = Rules()) -> DataFrame:
    """One row a run: totals, worst drawdown and Sharpe ratio of its equity differences."""
    wishes = wanted_entries(candles)
    bars = ["symbol", "i", "close", "high", "low", "atr", "funding", "settlements", *[f"{b}_{s}" for b in BACKBONES for s in SIDES]]
    # a symbol's bars lie in one part, in order; all its runs share them
    dealt = wishes.select(*bars).repartition("symbol").sortWithinPartitions("symbol", "i")

    def work(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reports of whole series, about ``BARS`` bars (padded to the longest) at once."""
        table = pa.Table.from_batches(batches)
        codes = pc.dictionary_encode(table["symbol"].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        cuts = np.append(np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])), len(codes)).tolist()
        start, n, longest = 0, 0, 0
        for at, end in zip(cuts, cuts[1:], strict=False):
            if n and (n + 1) * max(longest, end - at) > BARS:
                part = table.slice(start, at - start)
                yield _Runs(part, leverages, rules).report(part["symbol"])
                start, n, longest = at, 0, 0
            n, longest = n + 1, max(longest, end - at)
        part = table.slice(start)
        yield _Runs(part, leverages, rules).report(part["symbol"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols = batch.column("symbol")
            # the last series may go on in the next batch
            tail = symbols[batch.num_rows - 1].as_py()
            same = pc.is_null(symbols) if tail is None else pc.fill_null(pc.equal(symbols, symbols[batch.num_rows - 1]), False)
            cut = batch.num_rows - pc.sum(same).as_py()
            before = held[-1].column("symbol")[held[-1].num_rows - 1].as_py() if held else tail
            if cut or before != tail:
                held.append(batch.slice(0, cut))
                if cut == 0 or sum(x.num_rows for x in held) >= BARS or len(held) > 64:
                    yield from work([x for x in held if x.num_rows])
                    held = []
                if cut < batch.num_rows:
                    held.append(batch.slice(cut))
            else:
                held.append(batch)
        if held:
            yield from work([x for x in held if x.num_rows])

    schema = f"symbol {dict(candles.dtypes)['symbol']}, backbone string, side string, leverage double, bars bigint, trades bigint, wins bigint, liquidations bigint, gross_pnl double, fees double, funding double, net_pnl double, max_drawdown double, sharpe double"
    return dealt.mapInArrow(run, schema)
