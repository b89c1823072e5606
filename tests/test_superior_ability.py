"""The test for superior predictive ability against whole paths."""

import numpy as np
import pytest

from tidemark.operators import resampling


def plain(d, paths):
    n = d.shape[1]
    mean, star = d.mean(1), np.array([[row[p].mean() for row in d] for p in paths])
    omega = np.sqrt(n * ((star - mean) ** 2).mean(0))
    keep = omega > 1e-12
    mean, star, omega = mean[keep], star[:, keep], omega[keep]
    top = max(0.0, (np.sqrt(n) * mean / omega).max())
    centres = (np.maximum(mean, 0), np.where(mean >= -omega / np.sqrt(n) * np.sqrt(2 * np.log(np.log(n))), mean, 0), mean)
    return [top, *[(np.maximum((np.sqrt(n) * (star - c) / omega).max(1), 0) > top).mean() for c in centres]]


@pytest.mark.parametrize("edge", [0.0, 0.6])
def test_p_values_equal_those_of_whole_paths(spark, edge):
    rng = np.random.default_rng(3)
    d = rng.normal(-0.05, 1, (5, 61))
    d[2] += edge
    d[3] -= 2
    d[4] = 0.25  # never varies
    df = spark.createDataFrame([(f"m{k}", t, float(d[k, t])) for k in range(5) for t in range(61)], "model string, t bigint, d double")
    lengths = spark.createDataFrame([("calendar", 61)], "symbol string, n bigint")
    paths = {}
    for r in resampling.index_table(lengths, 60, "moving_block", 5).collect():
        paths.setdefault(r.seed, {})[r.position] = r.source
    got = resampling.superior_ability(df, 60, 5).first()
    assert (got.n, got.models) == (61, 4)
    assert [got.statistic, got.p_lower, got.p_consistent, got.p_upper] == pytest.approx(plain(d, [[p[i] for i in range(61)] for p in paths.values()]))
    assert got.p_lower <= got.p_consistent <= got.p_upper
    assert got.p_consistent < 0.05 if edge else got.p_consistent > 0.05


def test_no_models_no_row(spark):
    none = spark.createDataFrame([], "model string, t bigint, d double")
    assert resampling.superior_ability(none, 4).collect() == []
