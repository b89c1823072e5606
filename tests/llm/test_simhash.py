import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=4):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


TEXTS = ["", "  \n", "a", "a b c", "one two three four", "One TWO three four five six", "x " * 500, "ÀÉ b c d e f", "a\x1fb c d e"]


def test_fingerprints_equal_the_plain_ones():
    assert simhash.fingerprints_of([t.encode() for t in TEXTS]).tolist() == [plain_fingerprint(t) for t in TEXTS]


def clusters(n, seed, flips):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, max(1, n // 12), dtype=np.uint64)
    fps = base[rng.integers(0, len(base), n)]
    for _ in range(flips):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    return np.unique(fps)


@pytest.mark.parametrize("tile", [2, 5, 2048])
@pytest.mark.parametrize("flips", [1, 2, 3, 6])
def test_links_and_components_equal_brute_force(spark, tile, flips):
    if tile == 5 and flips != 2:
        pytest.skip("one tile size in between is enough")
    fps = clusters(150, flips, flips)
    signed = [int(v) for v in fps.view(np.int64)]
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, tile=tile)).collect()}
    want = plain_components([int(v) for v in fps])
    group = {}
    for v in fps:
        s = int(np.uint64(v).view(np.int64))
        group.setdefault(want[int(v)], set()).add(s)
    for members in group.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_chain_is_one_component(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.where("a < 0")).count() == 0


def test_documents_of_every_kind(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta " * 30
    rows = [(5, text, 1), (3, text, 1), (3, text, 1), (9, None, 1), (7, "", 1), (None, "lonely words stand here", 1), (8, text + " iota", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fp = {d: plain_fingerprint(t) for d, t, _ in rows}
    root = plain_components(fp.values())
    smallest = {}
    for d, v in fp.items():
        if d is not None:
            smallest[root[v]] = min(smallest.get(root[v], d), d)
    assert got == {(d, f"{v:016x}", smallest.get(root[v])) for d, v in fp.items()}
    kept = simhash.keep_one(df).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted(({smallest.get(root[v]) for v in fp.values()}), key=str)
    assert simhash.near_duplicates(df.where("doc_id = 99")).count() == 0
    assert simhash.keep_one(df).columns == df.columns


def test_whole_table_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    fp = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    root = plain_components(fp.values())
    smallest = {}
    for d, v in fp.items():
        smallest[root[v]] = min(smallest.get(root[v], d), d)
    assert got == {d: smallest[root[v]] for d, v in fp.items()}


@pytest.mark.parametrize("blocks", [6, 7, 8, 9])
def test_no_number_of_blocks_loses_a_link(spark, blocks):
    fps = clusters(120, blocks, 3)
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp bigint")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, blocks=blocks)).collect()}
    want = plain_components([int(v) for v in fps])
    signed = lambda v: int(np.uint64(v).view(np.int64))
    pairs = {}
    for v in fps:
        pairs.setdefault(want[int(v)], set()).add(got.get(signed(v), signed(v)))
    assert all(len(roots) == 1 for roots in pairs.values())
    assert len({r for roots in pairs.values() for r in roots}) == len(pairs)


def test_blocks_grow_with_the_nodes():
    chosen = [simhash.blocks_for(n) for n in (0, 10**6, 10**8, 10**9, 10**11, 10**12)]
    assert chosen == sorted(chosen) and chosen[0] == 6 and chosen[3] == 7 and chosen[4] == 8
    assert all(sum(simhash.block_widths(b)) == 64 for b in range(6, 13))


def test_large_groups_are_exchanged_in_parts(spark):
    base = 0x0F0F_3333_5555_7777
    fps = [base ^ (1 << i) ^ (1 << j) for i in range(62) for j in range(i)]
    marked = spark.createDataFrame([(10_000 - k, v) for k, v in enumerate(fps)] + [(None, 0)], "doc_id bigint, fp bigint")
    got = simhash.groups(marked).collect()
    assert len(got) == len(fps) + 1
    assert {(r.root, r.component_id) for r in got} == {(min(fps), 10_000 - len(fps) + 1), (0, None)}


def test_private_names_do_not_clash(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta " * 9
    names = ["doc_id", "text", "_fp", "_id", "_own_fp", "_KEY", "_kept_key", "key", "root", "a.b", "salt"]
    df = spark.createDataFrame([(4, text, *range(9)), (2, text, *range(9)), (2, text, *range(9)), (3, "other words are here", *range(9)), (None, None, *range(9))], ", ".join(f"`{n}` {'string' if n == 'text' else 'bigint'}" for n in names))
    kept = simhash.keep_one(df)
    assert kept.columns == names
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted([(2, text), (3, "other words are here"), (None, None)], key=str)


def test_the_row_that_stays_is_defined(spark):
    """Of rows of one id that differ in their text the same one stays, however they are dealt."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(w if i != k else "other" for i, w in enumerate(words))) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {tuple(r.text for r in simhash.keep_one(df.repartition(n)).collect()) for n in (1, 3, 5)}
    assert len(kept) == 1
