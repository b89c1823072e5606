import hashlib
import math

import numpy as np
import pytest

from tests.oracle import connect, same
from tidemark.llm import dualtree, queries

KIND = "vec_id bigint, embedding array<float>"


def plain(rows, clusters=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) < dualtree.LARGEST for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    c = [v for _, v in first]
    if not c:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, z, strict=True)), k) for k, z in enumerate(c))

    for _ in range(rounds):
        own = [[] for _ in c]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        c = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else z for o, z in zip(own, c, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, d, k in found if k == j) for j in range(len(c))]
    return [(i, k, d, inertia[k], sum(inertia), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, d, k in found]


def run(spark, rows, kind=KIND, **k):
    return sorted((tuple(r) for r in dualtree.centroid_clusters(spark.createDataFrame(rows, kind), **k).collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_oracle(spark, sf):
    d = f"/root/testdata/{sf}"
    same(queries.op12_centroid_clusters(spark, d), connect(d), dualtree.oracle_sql())


def data(seed, n, size=64, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (5, size))
    return [(i, [float(x) for x in (centres[i % 5] + rng.normal(0, spread, size)).astype(np.float32)]) for i in range(n)]


def test_equals_plain_rounds_on_clustered_vectors(spark):
    rows = data(1, 300)
    assert run(spark, rows) == sorted(plain(rows), key=str)


def test_rows_of_every_kind(spark):
    rows = data(2, 40)
    bad = [(100, None), (101, []), (102, [0.0] * 63), (103, [0.0] * 63 + [float("nan")]), (104, [0.0] * 63 + [float("inf")]), (105, [None] + [0.0] * 63), (106, [2e5] * 64)]
    more = [(None, [0.5] * 64), *rows[:7], (3, [0.25] * 64), (200, [131071.0] * 64), (201, [-131071.0] * 64)]
    assert run(spark, rows + bad + more) == sorted(plain(rows + more), key=str)
    assert run(spark, []) == run(spark, bad) == []
    assert run(spark, [(None, [0.5] * 64)]) == []
    few = rows[:3]
    assert run(spark, few) == sorted(plain(few), key=str)
    same_vector = [(i, [0.125] * 64) for i in range(50)]
    got = run(spark, same_vector)
    assert {r[1] for r in got} == {0} and {r[2] for r in got} == {0}  # ties go to the smaller number


def test_types_and_clashing_columns(spark):
    rows = [(str(i), v, 1, "x") for i, v in data(3, 20)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, v int, `ids.x` string")
    got = sorted((tuple(r) for r in dualtree.centroid_clusters(df).collect()), key=str)
    # doubles are not rounded to floats first
    want = sorted(plain([(i, [float(np.float32(x)) for x in v]) for i, v, *_ in rows]), key=str)
    assert got == want


def blocks(seed):
    rng = np.random.default_rng(seed)
    yield rng.integers(-300, 300, (400, 16)).astype(np.int32)
    yield (rng.integers(0, 6, (300, 1)) * 1000 + rng.integers(-5, 5, (300, 16))).astype(np.int32)
    yield np.repeat(rng.integers(-5, 5, (3, 16)), 40, 0).astype(np.int32)
    yield rng.integers(-1, 2, (500, 2)).astype(np.int32)
    yield np.zeros((1, 16), np.int32)
    yield (2**rng.integers(0, 27, (200, 4)) * rng.choice([-1, 1], (200, 4))).astype(np.int32)


@pytest.mark.parametrize("seed", range(4))
def test_cover_tree_keeps_its_promises(seed):
    for x in blocks(seed):
        t = dualtree.CoverTree.build(x)
        assert sorted(t.order.tolist()) == list(range(len(x)))
        assert (t.vectors == x[t.order]).all()
        for i in range(len(t.centre)):
            own = t.vectors[t.low[i] : t.high[i]].astype(float)
            assert np.sqrt(((own - t.vectors[t.centre[i]]) ** 2).sum(1)).max() <= t.radius[i]
            assert t.low[i] <= t.centre[i] < t.high[i]
            kids = range(t.first[i], t.last[i])
            if kids:
                assert t.radius[kids[0]] < t.radius[i] and t.centre[kids[0]] == t.centre[i]  # nesting
                assert [t.low[kids[0]], t.high[kids[-1]]] == [t.low[i], t.high[i]]
                centres = t.vectors[t.centre[list(kids)]].astype(float)
                apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
                assert (apart[np.triu_indices(len(centres), 1)] > t.radius[list(kids)].max() - 1e-9).all()  # separation
            else:
                assert t.high[i] - t.low[i] <= dualtree.LEAF or t.radius[i] == 0


@pytest.mark.parametrize("seed", range(4))
def test_both_trees_find_the_nearest_with_ties(seed):
    rng = np.random.default_rng(seed + 50)
    for x in blocks(seed):
        for k in (1, 2, 8, 40):
            c = x[rng.integers(0, len(x), k)].astype(np.int64) + rng.integers(-1, 2, (k, 1))
            c[-1] = c[0]  # a tie
            t = dualtree.CoverTree.build(x)
            label, _ = dualtree.assign(t, dualtree.CoverTree.build(c, 1))
            exact = ((t.vectors[:, None].astype(np.int64) - c[None]) ** 2).sum(2)
            assert (label == exact.argmin(1)).all()


def test_pruning_saves_distances_on_clustered_vectors():
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 300, (40, 64))
    x = (centres[rng.integers(0, 40, 2048)] + rng.normal(0, 5, (2048, 64))).astype(np.int32)
    t = dualtree.CoverTree.build(x)
    label, taken = dualtree.assign(t, dualtree.CoverTree.build(centres.astype(np.int64), 1))
    assert (label == ((x[t.order][:, None] - centres.astype(np.int64)[None]) ** 2).sum(2).argmin(1)).all()
    assert taken < 2048 * 40 / 5
