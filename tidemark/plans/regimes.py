"""Queries of hidden-state regimes; the models have no SQL, ``tests/test_hidden_markov.py`` holds them against plain loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import c, r
from tidemark.operators import hidden_markov as h
from tidemark.plans.registry import over_candles, query, rounded
from tidemark.sources.tables import candles

BARS = "(PARTITION BY symbol ORDER BY i"


@query(over_candles(f"""SELECT symbol, i, {rounded('CASE WHEN i = 0 OR f <= 0 THEN 0.0 ELSE ln(close / f) END AS log_ret', 'CASE WHEN i = 0 OR n = 0 THEN 1e-6 WHEN n = 1 THEN one ELSE sd END AS roll_vol', 'funding', 'CASE WHEN i = 0 THEN 0.0 WHEN po > 0 THEN abs(oi / po - 1) ELSE 0.0 END AS d_oi')}
FROM (SELECT *, count(b) OVER {BARS} ROWS 3 PRECEDING) AS n, stddev_samp(b) OVER {BARS} ROWS 3 PRECEDING) AS sd, max(abs(b)) OVER {BARS} ROWS 3 PRECEDING) AS one
  FROM (SELECT *, first_value(close) OVER {BARS} ROWS 4 PRECEDING) AS f, lag(oi) OVER {BARS}) AS po, CASE WHEN lag(close) OVER {BARS}) > 0 THEN ln(close / lag(close) OVER {BARS})) END AS b FROM candles))"""))
def e22_regime_features(spark, sf_dir):
    """What the hidden states are seen by."""
    return h.regime_features(candles(spark, sf_dir)).select("symbol", "i", *[r(f).alias(f) for f in h.FEATURES])


@query()
def e23_hidden_regimes(spark, sf_dir):
    """Gaussian hidden Markov regimes of every bar, rule-based where a symbol has too few."""
    return h.regimes_hmm(candles(spark, sf_dir)).select("symbol", "i", "regime", "state", r("confidence").alias("confidence"))


@query()
def e24_hidden_states(spark, sf_dir):
    """Means and names of each symbol's states, with the likelihood of its model."""
    _, model = h.fitted(h.regime_features(candles(spark, sf_dir)))
    return h.state_labels(model).join(model.select("symbol", r("loglik", 4).alias("loglik")), "symbol").select("symbol", "state", *[r(f).alias(f) for f in h.FEATURES], "label", "loglik")


@query()
def l29_semi_markov_regimes(spark, sf_dir):
    """Hidden regimes without runs of under three bars."""
    return h.regimes(candles(spark, sf_dir), "hsmm").groupBy("symbol", "regime").agg(F.count("*").alias("bars"), F.min(c("i")).alias("first_i"))
