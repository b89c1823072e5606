"""Hidden-state regimes against plain loops over one series at a time."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import hidden_markov as h
from tidemark.operators import windows
from tidemark.sources.tables import candles

K = h.STATES


def plain_features(bars):
    """(close, funding, oi) of one series -> feature rows, bar by bar."""
    out = []
    for i, (close, funding, oi) in enumerate(bars):
        window = [b[0] for b in bars[max(0, i - 4) : i + 1]]
        if len(window) < 2:
            out.append([0.0, 1e-6, funding, 0.0])
            continue
        rets = [math.log(b / a) for a, b in zip(window, window[1:], strict=False) if a > 0]
        mean = sum(rets) / len(rets)
        vol = math.sqrt(sum((r - mean) ** 2 for r in rets) / (len(rets) - 1)) if len(rets) > 1 else abs(rets[0])
        before = bars[i - 1][2]
        out.append([math.log(close / window[0]), vol, funding, abs(oi / before - 1) if before > 0 else 0.0])
    return np.array(out)


def emission(x, mean, spread):
    return np.array([[-0.5 * sum((v - m) ** 2 / s + math.log(2 * math.pi * s) for v, m, s in zip(row, mean[k], spread[k], strict=True)) for k in range(K)] for row in x])


def log_sum(v):
    top = max(v)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in v))


def plain_model(x, rounds):
    """Baum-Welch in logarithms, one bar after the other."""
    order = np.argsort(x[:, 0], kind="stable")
    part = np.empty(len(x), int)
    size, more = divmod(len(x), K)
    at = 0
    for k in range(K):
        n = size + (k < more)
        part[order[at : at + n]] = k
        at += n
    mean = np.array([x[part == k].mean(0) for k in range(K)])
    spread = np.tile(x.var(0) + h.LEAST_VARIANCE, (K, 1))
    start, step = np.full(K, 1 / K), np.full((K, K), 1 / K)
    loglik = None
    for _ in range(rounds):
        gamma, xi, loglik = plain_posteriors(x, start, step, mean, spread)
        start = gamma[0]
        step = xi.sum(0) / xi.sum(0).sum(1, keepdims=True)
        n = gamma.sum(0)[:, None]
        mean = gamma.T @ x / n
        spread = (h.VARIANCE_PRIOR + np.maximum(gamma.T @ x**2 - n * mean**2, 0)) / n
    return start, step, mean, spread, loglik


def plain_posteriors(x, start, step, mean, spread):
    b = emission(x, mean, spread)
    log = lambda p: math.log(p) if p > 0 else -math.inf
    alpha, beta = [[log(start[k]) + b[0][k] for k in range(K)]], [[0.0] * K]
    for t in range(1, len(x)):
        alpha.append([log_sum([alpha[-1][i] + log(step[i][k]) for i in range(K)]) + b[t][k] for k in range(K)])
    for t in range(len(x) - 2, -1, -1):
        beta.insert(0, [log_sum([log(step[k][j]) + b[t + 1][j] + beta[0][j] for j in range(K)]) for k in range(K)])
    total = log_sum(alpha[-1])
    gamma = np.exp(np.array(alpha) + np.array(beta) - total)
    xi = np.array([[[math.exp(alpha[t][i] + log(step[i][j]) + b[t + 1][j] + beta[t + 1][j] - total) for j in range(K)] for i in range(K)] for t in range(len(x) - 1)])
    return gamma / gamma.sum(1, keepdims=True), xi, total


def plain_path(x, start, step, mean, spread):
    b = emission(x, mean, spread)
    with np.errstate(divide="ignore"):
        score, back = np.log(start) + b[0], []
        for t in range(1, len(x)):
            every = score[:, None] + np.log(step)
            back.append(every.argmax(0))
            score = every.max(0) + b[t]
    path = [int(score.argmax())]
    for p in reversed(back):
        path.insert(0, int(p[path[0]]))
    return path


def walk(seed, n):
    rng, close, oi, out = random.Random(seed), 100.0, 1000.0, []
    for i in range(n):
        wild = (i // 40) % 3
        close *= math.exp(rng.gauss([0.01, -0.03, 0.0][wild], [0.01, 0.05, 0.003][wild]))
        oi *= math.exp(rng.gauss(0, [0.01, 0.1, 0.02][wild]))
        out.append((close, rng.gauss(0, 0.01), oi))
    return out


def frame(spark, series):
    t0 = datetime(2024, 1, 1)
    rows = [(s, t0 + timedelta(hours=i), i, *([b[0]] * 4), 1.0, 1, b[1], b[2], 0.0) for s, bars in series.items() for i, b in enumerate(bars)]
    return spark.createDataFrame(rows, "symbol int, ts timestamp_ntz, i bigint, open double, high double, low double, close double, volume double, trade_count bigint, funding double, oi double, liq double")


@pytest.mark.parametrize("chunk", [1, 7, 256])
def test_model_and_path_equal_plain_loops_whatever_the_chunks(spark, chunk):
    series = {1: walk(1, 130), 2: walk(2, 9), 3: walk(3, 64), 4: walk(4, 7)}
    features = h.regime_features(frame(spark, series))
    for s, bars in series.items():
        got = [list(r) for r in features.where(f"symbol = {s}").orderBy("i").select(*h.FEATURES).collect()]
        assert np.allclose(got, plain_features(bars))
    bars, model = h.fitted(features, rounds=4, chunk=chunk)
    models = {r.symbol: r for r in model.collect()}
    assert models.keys() == {1, 2, 3}  # two bars a state at least
    path = {}
    for r in h.decoded(bars, model).collect():
        path.setdefault(r.symbol, {})[r.i] = (r.state, r.posterior)
    for s in models:
        x = plain_features(series[s])
        start, step, mean, spread, loglik = plain_model(x, 4)
        assert np.allclose(models[s].p, np.concatenate([start, step.ravel(), mean.ravel(), spread.ravel()]), rtol=1e-6, atol=1e-9)
        assert models[s].loglik == pytest.approx(loglik, rel=1e-9)
        gamma, _, _ = plain_posteriors(x, start, step, mean, spread)
        assert np.allclose([path[s][i][1] for i in range(len(x))], gamma, atol=1e-7)
        assert [path[s][i][0] for i in range(len(x))] == plain_path(x, start, step, mean, spread)


def test_whole_table_equals_plain_forward_and_backward(spark):
    df = candles(spark, "/root/testdata/sf0.01").cache()
    series = {}
    for r in df.orderBy("symbol", "i").collect():
        series.setdefault(r.symbol, []).append((r.close, r.funding, r.oi))
    _, model = h.fitted(h.regime_features(df), rounds=2)
    models = {r.symbol: r for r in model.collect()}
    assert models.keys() == {s for s, b in series.items() if len(b) >= 2 * K}
    for s in sorted(models)[::3]:
        start, step, mean, spread, loglik = plain_model(plain_features(series[s]), 2)
        assert np.allclose(models[s].p, np.concatenate([start, step.ravel(), mean.ravel(), spread.ravel()]), rtol=1e-5, atol=1e-8), s
    got = h.regimes_hmm(df, rounds=2)
    assert got.count() == df.count()
    ruled = {(r.symbol, r.i): r.regime for r in windows.regime_labels(df).collect()}
    for r in got.where("state IS NULL").collect():
        assert len(series[r.symbol]) < 2 * K and r.regime == ruled[r.symbol, r.i]


def test_states_take_the_first_name_that_fits(spark):
    means = [(-0.06, 0.05, 0.0, 0.0), (0.06, 0.05, 0.02, 0.09), (0.06, 0.05, 0.0, 0.0), (0.0, 0.0, -0.013, 0.0), (0.0, 0.0, 0.0, 0.11), (0.03, 0.03, 0.0, 0.0), (-0.03, 0.03, 0.0, 0.0), (-0.03, 0.05, 0.0, 0.0)]
    for names, group in ((["crash", "short_squeeze", "sideways", "liquidity_stress"], means[:4]), (["liquidity_stress", "bull", "bear", "sideways"], means[4:])):
        model = spark.createDataFrame([(1, [0.25] * 20 + [v for m in group for v in m] + [1.0] * 16)], "symbol int, p array<double>")
        assert [r.label for r in h.state_labels(model).orderBy("state").collect()] == names


def test_likelihood_never_falls_and_models_are_chosen_by_name(spark):
    df = frame(spark, {1: walk(5, 120)})
    features = h.regime_features(df)
    seen = [h.fitted(features, rounds=n, chunk=50)[1].first().loglik for n in (1, 2, 4)]
    assert seen == sorted(seen)
    counts = {m: h.regimes(df, m, **({"rounds": 2} if "s" in m[:2] or m == "hmm" else {})).count() for m in ("hmm", "hsmm")} | {m: h.regimes(df, m).count() for m in ("deterministic", "bocpd")}
    assert set(counts.values()) == {120}
    smooth = h.regimes(df, "hsmm", rounds=2).orderBy("i").select("regime").collect()
    assert len(smooth) == 120
    with pytest.raises(ValueError):
        h.regimes(df, "other")
    assert h.regimes_hmm(df.where("symbol = 9"), rounds=1).count() == 0
    assert h.regimes_hmm(df.where("i < 5"), rounds=1).select(F.count_if(F.col("state").isNull())).first()[0] == 5


def test_rounds_over_short_series_exchange_nothing(spark):
    features = h.regime_features(frame(spark, {1: walk(1, 130), 2: walk(2, 40)}))
    jobs = {}
    for rounds in (1, 5):
        spark.sparkContext.setJobGroup(f"fit-{rounds}", "fit")
        h.fitted(features, rounds=rounds)
        jobs[rounds] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{rounds}"))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs[1] == jobs[5]
    # short and cut series side by side have the models that each has alone
    both = {r.symbol: r.p for r in h.fitted(features, rounds=3, chunk=20)[1].collect()}
    for symbol in (1, 2):
        alone = h.fitted(features.where(f"symbol = {symbol}"), rounds=3)[1].first().p
        assert np.allclose(both[symbol], alone, rtol=1e-6, atol=1e-9)


def test_hsmm_by_name_writes_what_it_returns(spark):
    df = frame(spark, {1: walk(5, 60)})
    named = h.regimes(df, "hsmm", rounds=2, least=4).orderBy("i").collect()
    whole = h.regimes_hsmm(df, rounds=2, least=4).orderBy("i").select("symbol", "i", F.col("smoothed").alias("regime")).collect()
    assert named == whole
