import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lm


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def fold(doc_id, n=7):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def plain(docs):
    """Base scores and the whole model by dictionaries."""
    def count(chosen):
        words, pairs = Counter(), Counter()
        for _, text in chosen:
            t = tokens(text)
            words.update(t)
            pairs.update(zip([None, *t[:-1]], t, strict=True))
        return words, pairs

    words, pairs = count([d for d in docs if fold(d[0]) != 2])
    gone_words, gone_pairs = count([d for d in docs if fold(d[0]) == 3])
    total, distinct = sum(words.values()), len(words)
    bucket = lambda n: min(n.bit_length(), lm.BUCKETS - 1)
    side = 1 + lm.RANGE * lm.STEPS
    level = lambda p: 1 + int(np.clip(np.rint(-lm.STEPS * math.log2(p)), 0, side - 2)) if p > 0 else 0
    cells = Counter()
    rest = total - sum(gone_words.values())
    for d in docs:
        if fold(d[0]) == 3:
            t = tokens(d[1])
            for v, w in zip([None, *t[:-1]], t, strict=True):
                cv, cw, cvw = words[v] - gone_words[v], words[w] - gone_words[w], pairs[v, w] - gone_pairs[v, w]
                cells[(bucket(cv) * side + level(cvw / max(cv, 1))) * side + level(cw / max(rest, 1))] += 1
    weights = lm.em_weights(np.array(list(cells), np.int64), np.array(list(cells.values()), float), distinct)
    out = {}
    for d, text in docs:
        t = tokens(text)
        score = 0.0
        for v, w in zip([None, *t[:-1]], t, strict=True):
            a, u, z = weights[bucket(words[v])]
            score += math.log10(a * pairs[v, w] / max(words[v], 1) + u * words[w] / max(total, 1) + z / (distinct + 1))
        out[d] = (fold(d) == 2, len(t), sum(words[w] > 0 for w in t), total, sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in t), score)
    return out


def compare(df, docs):
    want = plain(docs)
    got = {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.lm_scores(df).collect()}
    assert got.keys() == want.keys()
    for d, row in want.items():
        assert got[d][:4] == row[:4]
        assert got[d][4:] == pytest.approx(row[4:], rel=1e-9, abs=1e-9)


def test_whole_table_equals_dictionaries(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    compare(df, [(r.doc_id, r.text) for r in df.collect()])


def test_rows_of_every_kind(spark):
    docs = [(i, f"Some words {i % 5} repeat and some {i} do not") for i in range(60)] + [(100, ""), (101, None), (102, "x " * 20_000), (103, "a\x1fb c d É")]
    compare(spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id bigint, text string, score double"), docs)
    twice = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "three")], "doc_id bigint, text string")
    assert lm.lm_scores(twice).count() == 3
    assert lm.lm_scores(twice.where("doc_id = 9")).count() == 0


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    rows = [r for r in lm.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.9 * sum(r.base_score for r in rows)


def test_mixture_sums_to_one():
    weights = lm.em_weights(np.array([0, 5 * 161 * 161 + 161 * 9 + 9]), np.array([3.0, 40.0]), 10)
    assert weights.sum(1) == pytest.approx(np.ones(lm.BUCKETS))
    assert weights[0, 0] == 0
    model = lm.Mixture(weights, 30, 3)
    counts, after = np.array([10, 15, 5]), np.array([4, 6, 0])
    p = 10 ** model.log10(np.append(after, 0), np.full(4, 10), np.append(counts, 0))
    assert p.sum() == pytest.approx(1)


def test_packing_of_integers():
    for values in ([], [0], [255, 256], [2**61, 3]):
        assert lm._unpacked(lm._packed(np.array(values, np.uint64))).tolist() == values


def test_chunks_follow_the_bytes(spark, monkeypatch):
    assert lm.chunks_for(0, 4) == 8 and lm.chunks_for(1 << 30, 4) == 64
    for size in (10**9, 10**12, 10**14):
        chunk = size / lm.chunks_for(size, 8)
        assert chunk <= max(lm.CHUNK_BYTES, (lm.REQUEST_BYTES * size) ** 0.5)
    docs = [(i, f"some words {i % 7} come again and {i} {'no' * (i % 3)}") for i in range(300)]
    monkeypatch.setattr(lm, "CHUNK_BYTES", 64)
    monkeypatch.setattr(lm, "REQUEST_BYTES", 1)
    compare(spark.createDataFrame(docs, "doc_id bigint, text string"), docs)
