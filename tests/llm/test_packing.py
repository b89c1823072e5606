import random
from collections import Counter, defaultdict

import pytest

from tidemark.llm import packing


def plain_pack(lengths, sources, clusters, capacity, per_source):
    """Best fit by looking at every bin: of the compatible ones the least residual, first come first."""
    pieces, bins, out = [], [], []
    for row, n in enumerate(lengths):
        full, rest = divmod(n, capacity)
        pieces += [(capacity, row, p) for p in range(full)] + ([(rest, row, full)] if rest or not full else [])
    for n, row, piece in sorted(pieces, key=lambda x: (-x[0], x[1], x[2])):
        fit = [b for b in bins if b["left"] >= n and b["sources"][sources[row]] < per_source and clusters[row] not in b["clusters"]]
        if fit:
            b = min(fit, key=lambda b: (b["left"], b["since"]))
        else:
            b = {"left": capacity, "sources": Counter(), "clusters": set(), "id": len(bins)}
            bins.append(b)
        out.append((row, piece, n, b["id"], capacity - b["left"]))
        b["left"] -= n
        b["sources"][sources[row]] += 1
        b["clusters"].add(clusters[row])
        b["since"] = len(out)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equals_a_plain_best_fit(seed):
    rng = random.Random(seed)
    n = 300
    lengths = [rng.choice([0, rng.randint(1, 40), rng.randint(1, 260)]) for _ in range(n)]
    sources = [rng.choice("aaabcd") for _ in range(n)]
    clusters = [rng.randint(0, 40) for _ in range(n)]
    got = [(row, piece, k, b, at) for row, piece, _, k, b, at in packing.pack_shard(lengths, sources, clusters, 100, 2)]
    assert got == plain_pack(lengths, sources, clusters, 100, 2)


def test_rows_of_every_kind(spark):
    text = "same words again and again " * 40
    rows = [(i, text, "hot", 0) for i in range(30)] + [(100 + i, f"doc number {i} " * (i % 50), f"s{i % 5}", 0) for i in range(100)] + [(None, None, None, 0), (7, "", "hot", 0), (8, "long " * 20_000, "hot", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, cluster int")
    got = packing.packed(df, shard=32).collect()
    words = Counter()
    for r in got:
        words[r.doc_id] += r.n_words
    for d in {r[0] for r in rows}:
        assert words[d] == sum(len((t or "").split()) for x, t, _, _ in rows if x == d)
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for members in bins.values():
        assert sum(m.n_words for m in members) <= packing.CAPACITY
        assert max(Counter(m.source for m in members).values()) <= packing.PER_SOURCE
        assert max(Counter(m.cluster for m in members).values()) == 1
        spans = sorted((m.bin_offset, m.bin_offset + m.n_words) for m in members)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert packing.packed(df.where("doc_id = 999")).count() == 0


def test_result_follows_from_the_rows_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(docs.where("doc_id % 9 = 0"))
    got = [sorted(map(tuple, packing.packed(docs.repartition(n), shard=100).collect())) for n in (1, 7)]
    assert got[0] == got[1]


def test_whole_query_equals_a_plain_packing_of_each_shard(spark):
    """The shards are dealt anew in Python from the query's own input columns, each packed by looking at every bin."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.packed(docs, shard=200).collect()
    cluster = {r.doc_id: r.cluster for r in got}
    shard = {r.doc_id: r.bin_id.split("/")[0] for r in got}
    fp = {r.doc_id: r.fp for r in packing.measured(docs).collect()}
    by_shard = defaultdict(list)
    for r in docs.collect():
        by_shard[shard[r.doc_id]].append((-len((r.text or "").encode().split()), cluster[r.doc_id], r.doc_id, r.source, fp[r.doc_id]))
    want = set()
    for name, rows in by_shard.items():
        rows.sort(key=lambda x: tuple((v is None, v) for v in x))
        for row, piece, n, b, at in plain_pack([-x[0] for x in rows], [x[3] for x in rows], [x[1] for x in rows], packing.CAPACITY, packing.PER_SOURCE):
            want.add((rows[row][2], piece, n, f"{name}/{b}", at))
    assert {(r.doc_id, r.piece, r.n_words, r.bin_id, r.bin_offset) for r in got} == want
    assert len(by_shard) == 5 and max(map(len, by_shard.values())) < 2 * 200
