"""Hidden Markov and semi-Markov regimes.

A series of up to ``SHORT`` chunks of ``CHUNK`` bars is one row; all rounds of
its fit and its best path are worked out where that row is, and nothing is
exchanged between rounds.  A longer series is cut into chunks of ``CHUNK`` bars.
What a chunk does to the state probabilities that enter it is one matrix, the product of its bars'
transition and emission matrices; a scan over a symbol's chunk matrices gives
the probabilities that enter each chunk and those of what comes after it, and
then every chunk can be worked on alone.  All rows of an Arrow batch are worked
on side by side, so Python loops over the bars of one row only.
Sufficient statistics are summed by Spark, one row a symbol, and the parameters
of the next round follow from them.  The most likely path (Viterbi) is found in
the same way, with maxima for sums.

A long series' chunk matrices, 16 numbers for ``CHUNK`` bars, meet in one task;
its bars do not.  Parameters are one row a symbol.

The start is the same on every run: bars are dealt to states by equal shares of
their log return.  Symbols with fewer than two bars a state get no model
(``regimes_hmm`` gives them the rule-based labels).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import by_symbol, c, log_ratio, rows
from tidemark.operators import windows as w
from tidemark.sources.tables import checkpointed

CHUNK, STATES, ROUNDS = 256, 4, 8
# Chunks of the longest series that stays one row, and bars (padded) that are worked on at once.
SHORT, CELLS = 4, 512 * 256
FEATURES = ("log_ret", "roll_vol", "funding", "d_oi")
# The prior of the variances (public defaults of Gaussian models), and the rules that name a state by its means.
VARIANCE_PRIOR, LEAST_VARIANCE = 1e-2, 1e-3
STATE_RULES = """CASE
  WHEN roll_vol > 0.04 AND log_ret < -0.05 THEN 'crash'
  WHEN log_ret > 0.05 AND funding > 0.01 AND d_oi > 0.08 THEN 'short_squeeze'
  WHEN abs(funding) > 0.012 OR d_oi > 0.10 THEN 'liquidity_stress'
  WHEN log_ret > 0.02 AND roll_vol < 0.04 THEN 'bull'
  WHEN log_ret < -0.02 AND roll_vol < 0.04 THEN 'bear'
  ELSE 'sideways' END"""


def regime_features(candles: DataFrame) -> DataFrame:
    """``log_ret`` over the window of five bars, ``roll_vol`` of its bar returns, ``funding`` and ``d_oi`` of every bar.

    Returns on a base that is not positive are left out; the first bar has
    (0, 1e-6, funding, 0); a window of one return has its size as volatility.
    A close of 0 has the log return -inf, and windows of several returns that
    hold one have no volatility (NaN).
    """
    before, first = F.lag("close").over(by_symbol()), F.first("close").over(rows(4))
    seen = candles.withColumn("_bar", F.when(before > 0, log_ratio("close", before)))
    n, deviation = F.count("_bar").over(rows(3)), F.stddev_samp("_bar").over(rows(3))
    one = F.max(F.abs("_bar")).over(rows(3))
    prev_oi = F.lag("oi").over(by_symbol())
    start = F.row_number().over(by_symbol()) == 1
    return seen.withColumns({
        "log_ret": F.when(start | (first <= 0), 0.0).otherwise(log_ratio("close", first)),
        "roll_vol": F.when(start | (n == 0), 1e-6).when(n == 1, one).otherwise(deviation),
        "d_oi": F.when(start, 0.0).when(prev_oi > 0, F.abs(c("oi") / prev_oi - 1)).otherwise(0.0),
    }).drop("_bar")


def _flat(*names: str) -> Column:
    return F.array(*[c(n).cast("double") for n in names])


def chunked(features: DataFrame, chunk: int, states: int) -> DataFrame:
    """``symbol, chunk, whole, i, x``: the bars of each chunk in order, for symbols with bars enough; ``whole``: a short series, all in chunk 0."""
    bar = F.row_number().over(by_symbol()) - 1
    n = F.count(F.lit(1)).over(W.partitionBy("symbol"))
    numbered = features.select("symbol", "i", _flat(*FEATURES).alias("x"), bar.alias("_bar"), n.alias("_n")).where(c("_n") >= 2 * states)
    whole = c("_n") <= SHORT * chunk
    place = F.when(whole, F.lit(0).cast("bigint")).otherwise(F.floor(c("_bar") / chunk))
    packed = numbered.groupBy("symbol", place.alias("chunk"), whole.alias("whole")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("bars"))
    return packed.select("symbol", "chunk", "whole", F.transform("bars", lambda b: b["i"]).alias("i"), F.flatten(F.transform("bars", lambda b: b["x"])).alias("x"))


def first_parameters(features: DataFrame, states: int) -> DataFrame:
    """``symbol, p``: start and transition probabilities, means and variances of each state, flat."""
    part = F.ntile(states).over(W.partitionBy("symbol").orderBy("log_ret", "i")) - 1
    dealt = features.withColumn("_part", part)
    means = [F.avg(F.when(c("_part") == k, c(f))) for k in range(states) for f in FEATURES]
    spread = [F.var_pop(f) + LEAST_VARIANCE for f in FEATURES]
    even = F.array_repeat(F.lit(1.0 / states), states + states * states)
    return dealt.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), F.array(*means).alias("_means"), F.array(*spread).alias("_spread")).where(c("_n") >= 2 * states).select("symbol", F.concat(even, "_means", F.flatten(F.array_repeat("_spread", states))).alias("p"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows; NULLs are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class _Batch:
    """Chunks side by side: ``logs`` (chunk, bar, state) of emissions with the largest of each bar taken out, and its sum."""

    def __init__(self, batch: pa.RecordBatch, k: int) -> None:
        f = len(FEATURES)
        self.k, self.size = k, batch.column("x").value_lengths().to_numpy(zero_copy_only=False) // f
        self.inside = np.arange(self.size.max())[None] < self.size[:, None]
        self.x = np.zeros((*self.inside.shape, f))
        self.x[self.inside] = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, f)
        self.first = batch.column("chunk").to_numpy(zero_copy_only=False) == 0
        if "p" in batch.schema.names:
            self.see(_matrix(batch.column("p")))

    def see(self, p: np.ndarray) -> None:
        """The bars as parameters ``p`` see them."""
        k, f = self.k, len(FEATURES)
        self.start, self.step, self.mean, self.spread = _split(p, k, f)
        logs = np.empty((*self.inside.shape, k))
        for state in range(k):
            mean, spread = self.mean[:, None, state], self.spread[:, None, state]
            logs[:, :, state] = -0.5 * ((self.x - mean) ** 2 / spread + np.log(2 * np.pi * spread)).sum(2)
        self.most = logs.max(2)
        self.logs = logs - self.most[:, :, None]
        self.seen = np.exp(self.logs)

    def first_parameters(self) -> np.ndarray:
        """``first_parameters`` of series that are whole."""
        k = self.k
        out = []
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # means of nothing are NaN
            for x, n in zip(self.x, self.size, strict=True):
                x = x[:n]
                order = np.argsort(np.where(np.isnan(x[:, 0]), -np.inf, x[:, 0]), kind="stable")
                means = [np.nanmean(x[part], 0) for part in np.array_split(order, k)]
                out.append(np.concatenate([np.full(k + k * k, 1.0 / k), *means, np.tile(np.nanvar(x, 0) + LEAST_VARIANCE, k)]))
        return np.array(out)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """What enters a whole series and comes after it."""
        return np.eye(self.k)[np.zeros(len(self.size), int)], np.ones((len(self.size), self.k))

    def transition(self, t: int) -> np.ndarray:
        """Into bar t: the first bar of a series takes the start probabilities from whatever state."""
        if t or not self.first.any():
            return self.step
        return np.where(self.first[:, None, None], np.repeat(self.start[:, None], self.start.shape[1], 1), self.step)

    def transfer(self) -> np.ndarray:
        """Product of each chunk's matrices (scaled)."""
        k = self.start.shape[1]
        m = np.repeat(np.eye(k)[None], len(self.size), 0)
        for t in range(self.x.shape[1]):
            new = m @ (self.transition(t) * self.seen[:, t][:, None])
            new /= np.maximum(new.sum((1, 2), keepdims=True), 1e-300)
            m = np.where(self.inside[:, t, None, None], new, m)
        return m

    def transfer_best(self) -> np.ndarray:
        """The same with maxima for sums, of logarithms: the best score from each entering state to each last one."""
        k = self.start.shape[1]
        with np.errstate(divide="ignore"):
            m = np.where(np.eye(k, dtype=bool)[None], 0.0, -np.inf).repeat(len(self.size), 0)
            for t in range(self.x.shape[1]):
                new = (m[:, :, :, None] + np.log(self.transition(t))[:, None]).max(2) + self.logs[:, t][:, None]
                m = np.where(self.inside[:, t, None, None], new, m)
        return m

    def posteriors(self, enter: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities of each bar's states, sums of transitions, log-likelihood) of each chunk."""
        n, bars, k = self.logs.shape
        ahead, norm = np.zeros((n, bars, k)), np.ones((n, bars))
        a = enter
        for t in range(bars):
            new = np.einsum("na,nab->nb", a, self.transition(t)) * self.seen[:, t]
            norm[:, t] = np.where(self.inside[:, t], np.maximum(new.sum(1), 1e-300), 1.0)
            a = np.where(self.inside[:, t, None], new / norm[:, t, None], a)
            ahead[:, t] = a
        state, moves = np.zeros((n, bars, k)), np.zeros((n, k, k))
        b = after
        for t in range(bars - 1, -1, -1):
            inside = self.inside[:, t, None]
            both = ahead[:, t] * b
            state[:, t] = np.where(inside, both / np.maximum(both.sum(1, keepdims=True), 1e-300), 0)
            before = ahead[:, t - 1] if t else enter
            move = before[:, :, None] * self.transition(t) * (self.seen[:, t] * b)[:, None]
            move /= np.maximum(move.sum((1, 2), keepdims=True), 1e-300)
            counts = self.inside[:, t] & ~(self.first & (t == 0))
            moves += np.where(counts[:, None, None], move, 0)
            back = np.einsum("nab,nb->na", self.transition(t), self.seen[:, t] * b)
            b = np.where(inside, back / np.maximum(back.sum(1, keepdims=True), 1e-300), b)
        return state, moves, (np.log(norm) + np.where(self.inside, self.most, 0)).sum(1)

    def sums(self, enter: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Sufficient statistics of each chunk, flat."""
        state, moves, loglik = self.posteriors(enter, after)
        begins = np.where(self.first[:, None], state[:, 0], 0)
        n = len(moves)
        turned = state.transpose(0, 2, 1)
        return np.concatenate([loglik[:, None], begins, moves.reshape(n, -1), state.sum(1), (turned @ self.x).reshape(n, -1), (turned @ self.x**2).reshape(n, -1)], 1)

    def path(self, enter: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
        """The best states of each chunk between the state that enters and the last one (None: the best)."""
        n, bars, k = self.logs.shape
        with np.errstate(divide="ignore"):
            score = np.where(np.arange(k)[None] == enter[:, None], 0.0, -np.inf)
            back = np.zeros((n, bars, k), np.int64)
            for t in range(bars):
                every = score[:, :, None] + np.log(self.transition(t))
                back[:, t] = every.argmax(1)
                score = np.where(self.inside[:, t, None], every.max(1) + self.logs[:, t], score)
        out, at = np.zeros((n, bars), np.int64), score.argmax(1) if last is None else last
        for t in range(bars - 1, -1, -1):
            out[:, t] = at
            at = np.where(self.inside[:, t], back[np.arange(n), t, at], at)
        return out


def _split(p: np.ndarray, k: int, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, transitions, means, variances) of flat parameters."""
    start, step, mean, spread = np.split(p, np.cumsum([k, k * k, k * f]), 1)
    return start, step.reshape(-1, k, k), mean.reshape(-1, k, f), spread.reshape(-1, k, f)


def _maximised(old: np.ndarray, sums: np.ndarray, k: int) -> np.ndarray:
    """The parameters that follow from the sums of ``_Batch.sums`` over each series."""
    f, n = len(FEATURES), len(sums)
    _, begins, moves, held, x, xx = np.split(sums, np.cumsum([1, k, k * k, k, k * f]), 1)
    moves, x, xx = moves.reshape(-1, k, k), x.reshape(-1, k, f), xx.reshape(-1, k, f)
    _, step, mean, spread = _split(old, k, f)
    left, held = moves.sum(2, keepdims=True), held[:, :, None]
    # a state that nothing visits stays as it is
    step = np.where(left > 0, moves / np.maximum(left, 1e-300), step)
    some = held > 1e-9
    mean = np.where(some, x / np.maximum(held, 1e-300), mean)
    spread = np.where(some, (VARIANCE_PRIOR + np.maximum(xx - held * mean**2, 0)) / np.maximum(held, 1e-300), spread)
    return np.concatenate([begins / np.maximum(begins.sum(1, keepdims=True), 1e-300), step.reshape(n, -1), mean.reshape(n, -1), spread.reshape(n, -1)], 1)


def _each(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # bounded by memory: so many bars at once, those of the longest row for each
            sizes = batch.column("x").value_lengths().to_pylist() if "x" in batch.schema.names else [0] * batch.num_rows
            start, most = 0, 1
            for at, size in enumerate(sizes):
                most = max(most, size // len(FEATURES))
                if at > start and ((at + 1 - start) * most > CELLS or at - start >= 2048):
                    yield work(batch.slice(start, at - start))
                    start, most = at, max(1, size // len(FEATURES))
            if start < batch.num_rows:
                yield work(batch.slice(start))

    return df.mapInArrow(run, schema)


def _numbers(a: np.ndarray) -> pa.Array:
    flat = a.reshape(len(a), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def _bounds(chunks: DataFrame, states: int, best: bool) -> DataFrame:
    """``symbol, chunk, enter, after``: what enters each chunk and what comes after it, from a scan over the chunk matrices.

    ``best``: the entering and the last state of the best path; else probabilities.
    """
    kind = chunks.schema["symbol"].dataType.simpleString()

    def transfer(batch: pa.RecordBatch) -> pa.RecordBatch:
        b = _Batch(batch, states)
        return pa.RecordBatch.from_arrays([batch.column("symbol"), batch.column("chunk"), _numbers(b.transfer_best() if best else b.transfer())], names=["symbol", "chunk", "m"])

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        m = np.array(table["m"].to_pylist()).reshape(-1, states, states)
        enter, after = np.zeros((len(m), states)), np.zeros((len(m), states))
        if best:
            score, back = np.where(np.arange(states) == 0, 0.0, -np.inf), []
            for x in m:
                every = score[:, None] + x
                back.append(every.argmax(0))
                score = every.max(0)
            at = int(score.argmax())
            for i in range(len(m) - 1, -1, -1):
                after[i, 0], at = at, int(back[i][at])
                enter[i, 0] = at
        else:
            a = np.eye(states)[0]
            for i, x in enumerate(m):
                enter[i] = a
                a = a @ x
                a = a / max(a.sum(), 1e-300)
            b = np.ones(states)
            for i in range(len(m) - 1, -1, -1):
                after[i] = b
                b = m[i] @ b
                b = b / max(b.sum(), 1e-300)
        return pa.table({"symbol": table["symbol"], "chunk": table["chunk"], "enter": _numbers(enter), "after": _numbers(after)})

    found = _each(chunks, transfer, f"symbol {kind}, chunk bigint, m array<double>")
    return found.groupBy("symbol").applyInArrow(scan, f"symbol {kind}, chunk bigint, enter array<double>, after array<double>")


def next_parameters(chunks: DataFrame, states: int) -> DataFrame:
    """One round of expectation-maximisation: ``symbol, p, loglik`` from ``symbol, chunk, x, p``."""
    kind, f = chunks.schema["symbol"].dataType.simpleString(), len(FEATURES)

    def statistics(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = _Batch(batch, states).sums(_matrix(batch.column("enter")), _matrix(batch.column("after")))
        return pa.RecordBatch.from_arrays([batch.column("symbol"), _numbers(sums)], names=["symbol", "s"])

    def maximised(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = _matrix(batch.column("s"))
        p = _maximised(_matrix(batch.column("p")), s, states)
        return pa.RecordBatch.from_arrays([batch.column("symbol"), _numbers(p), pa.array(s[:, 0])], names=["symbol", "p", "loglik"])

    width = 1 + 2 * states + states * states + 2 * states * f
    bound = chunks.join(_bounds(chunks, states, False), ["symbol", "chunk"]).select("symbol", "chunk", "x", "p", "enter", "after")
    sums = _each(bound, statistics, f"symbol {kind}, s array<double>").groupBy("symbol").agg(F.array(*[F.sum(c("s")[i]) for i in range(width)]).alias("s"))
    parameters = chunks.where("chunk = 0").select("symbol", "p")
    return _each(sums.join(parameters, "symbol"), maximised, f"symbol {kind}, p array<double>, loglik double")


def whole_models(bars: DataFrame, states: int, rounds: int) -> DataFrame:
    """``symbol, p, loglik`` of the series that are whole rows: start and all rounds in place."""
    kind = bars.schema["symbol"].dataType.simpleString()

    def fit(batch: pa.RecordBatch) -> pa.RecordBatch:
        b = _Batch(batch, states)
        p, loglik = b.first_parameters(), pa.nulls(batch.num_rows, pa.float64())
        for _ in range(rounds):
            b.see(p)
            sums = b.sums(*b.ends())
            p, loglik = _maximised(p, sums, states), pa.array(sums[:, 0])
        return pa.RecordBatch.from_arrays([batch.column("symbol"), _numbers(p), loglik], names=["symbol", "p", "loglik"])

    return _each(bars.where("whole").select("symbol", "chunk", "x"), fit, f"symbol {kind}, p array<double>, loglik double")


def fitted(features: DataFrame, *, states: int = STATES, rounds: int = ROUNDS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(``symbol, chunk, whole, i, x`` of the bars, ``symbol, p, loglik`` of the fitted models)."""
    features = features.withColumns({f: F.when(F.abs(f) < float("inf"), c(f)) for f in FEATURES})
    bars = checkpointed(chunked(features, chunk, states))
    models = checkpointed(whole_models(bars, states, rounds))
    cut = bars.where("NOT whole")
    if not cut.agg(F.count(F.lit(1))).first()[0]:
        return bars, models
    model = checkpointed(first_parameters(features.join(cut.select("symbol").distinct(), "symbol", "left_semi"), states).withColumn("loglik", F.lit(None).cast("double")))
    for _ in range(rounds):
        model = checkpointed(next_parameters(cut.join(model.drop("loglik"), "symbol"), states))
    return bars, models.unionByName(model)


def state_labels(model: DataFrame, states: int = STATES) -> DataFrame:
    """``symbol, state, log_ret, roll_vol, funding, d_oi, label`` of every state, named by its means."""
    at, f = states + states * states, len(FEATURES)
    one = [F.struct(F.lit(k).alias("state"), *[c("p")[at + k * f + j].alias(n) for j, n in enumerate(FEATURES)]) for k in range(states)]
    return model.select("symbol", F.inline(F.array(*one))).withColumn("label", F.expr(STATE_RULES))


def decoded(bars: DataFrame, model: DataFrame, *, states: int = STATES) -> DataFrame:
    """``symbol, i, state, posterior``: the best path and each bar's state probabilities."""
    kinds = {n: bars.schema[n].dataType for n in ("symbol", "i")}
    chunks = bars.join(model.select("symbol", "p"), "symbol")
    cut = chunks.where("NOT whole")
    around, best = _bounds(cut, states, False), _bounds(cut, states, True).select("symbol", "chunk", c("enter")[0].cast("int").alias("from"), c("after")[0].cast("int").alias("to"))
    bound = cut.join(around, ["symbol", "chunk"]).join(best, ["symbol", "chunk"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        b = _Batch(batch, states)
        if "enter" in batch.schema.names:
            enter, after = (_matrix(batch.column(x)) for x in ("enter", "after"))
            path = b.path(*(np.array(batch.column(x).to_pylist()) for x in ("from", "to")))
        else:
            enter, after = b.ends()
            path = b.path(np.zeros(len(b.size), int))
        state, _, _ = b.posteriors(enter, after)
        # the bars of all rows, one after the other, cut as their ``i`` are
        cuts = pa.array(np.concatenate([[0], b.size.cumsum()]), pa.int32())
        each = pa.FixedSizeListArray.from_arrays(pa.array(state[b.inside].ravel()), states).cast(pa.list_(pa.float64()))
        lists = [pa.ListArray.from_arrays(cuts, x) for x in (pa.array(path[b.inside], pa.int32()), each)]
        return pa.RecordBatch.from_arrays([batch.column("symbol"), batch.column("i"), *lists], names=["symbol", "i", "state", "posterior"])

    schema = f"symbol {kinds['symbol'].simpleString()}, i {kinds['i'].simpleString()}, state array<int>, posterior array<array<double>>"
    out = _each(chunks.where("whole"), work, schema).unionByName(_each(bound, work, schema))
    return out.select("symbol", F.inline(F.arrays_zip("i", "state", "posterior")))


def regimes_hmm(candles: DataFrame, *, states: int = STATES, rounds: int = ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """``candles`` with ``regime`` by the hidden states' names, ``state`` and ``confidence`` (NULL where the rules had to label)."""
    bars, model = fitted(regime_features(candles), states=states, rounds=rounds, chunk=chunk)
    path = decoded(bars, model, states=states).join(state_labels(model, states).select("symbol", "state", "label"), ["symbol", "state"])
    ruled = w.regime_labels(candles).select(*candles.columns, c("regime").alias("_ruled"))
    return ruled.join(path, ["symbol", "i"], "left").select(*candles.columns, F.coalesce("label", "_ruled").alias("regime"), "state", F.array_max("posterior").alias("confidence"))


def regimes_hsmm(candles: DataFrame, *, states: int = STATES, rounds: int = ROUNDS, chunk: int = CHUNK, least: int = 3) -> DataFrame:
    """The same with runs shorter than ``least`` bars given to their neighbours."""
    labels = checkpointed(regimes_hmm(candles, states=states, rounds=rounds, chunk=chunk))
    return w.smoothed_labels(labels, "regime", least)


def regimes(candles: DataFrame, model: str = "deterministic", **options) -> DataFrame:
    """``symbol, i, regime`` by the model named."""
    if model == "deterministic":
        return w.regime_labels(candles).select("symbol", "i", "regime")
    if model == "hmm":
        return regimes_hmm(candles, **options).select("symbol", "i", "regime")
    if model == "hsmm":
        least = options.pop("least", 3)
        # only what is smoothed is written down
        labels = checkpointed(regimes_hmm(candles, **options).select("symbol", "i", "regime"))
        return w.smoothed_labels(labels, "regime", least).select("symbol", "i", c("smoothed").alias("regime"))
    if model == "bocpd":
        return w.changepoint_labels(w.with_changepoints(w.regime_labels(candles))).select("symbol", "i", c("relabelled").alias("regime"))
    raise ValueError(f"no regime model {model!r}")
