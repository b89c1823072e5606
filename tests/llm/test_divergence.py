import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.oracle import connect, same
from tidemark.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id bigint, text string, lang string, source string"


def plain(rows, min_docs=10, top=10):
    """The contract, with Python's integers."""
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        words = TERM.findall((text or "").translate(LOW))
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        docs[lang].update(set(words))
        count[lang, source].update(words)
    out = set()
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= min_docs}

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-gap(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


def run(spark, rows, **k):
    got = divergence.source_divergence(spark.createDataFrame(rows, KIND), **k)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_oracle(spark, sf):
    d = f"/root/testdata/{sf}"
    same(queries.op13_source_divergence(spark, d), connect(d), divergence.oracle_sql())


def test_equals_a_plain_count_on_random_rows(spark):
    rng = np.random.default_rng(5)
    # ties, letters beyond ASCII in UTF-8 order, terms longer than the fixed width, a hot source
    vocabulary = ["a", "B", "ß", "é", "zz", "\U0001f600", "￿", "x" * 47, "x" * 48, "x" * 49, "X" * 3000, "Ä", "ä", "o'clock", "w2w"]
    rows = []
    for i in range(400):
        words = rng.choice(len(vocabulary), rng.integers(0, 9), p=np.arange(15, 0, -1) / 120)
        rows.append((i, " ".join(vocabulary[w] for w in words), ["en", "de", None][rng.integers(3)], f"s{max(0, rng.integers(-6, 5))}"))
    for least in (1, 10, 40):
        assert run(spark, rows, min_docs=least) == plain(rows, least)


def test_rows_of_every_kind(spark):
    assert run(spark, []) == set()
    nothing = [(1, None, "en", "a"), (2, "", "en", "b"), (3, "1 2 3", None, None), (None, "once", "fr", "x")]
    assert run(spark, nothing) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    # groups without terms take part; repeated rows and ids count each
    rows = [(1, "tok " * 3, "en", "a")] * 10 + [(1, "", "en", "b"), (1, None, "en", "")] + [(2, "tok Tok other", "en", "c")] * 10
    assert run(spark, rows) == plain(rows)
    assert {r[3] for r in run(spark, rows) if r[1] == "b"} == {"", "a", "c"}


def test_extra_columns_and_long_texts(spark):
    rows = [(i, ("word " * 50_000 if i == 0 else "word other"), "en", f"s{i % 3}") for i in range(30)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], KIND + ", chunk int, `a.b` string")
    assert {tuple(r) for r in divergence.source_divergence(df).collect()} == plain(rows)


def test_share_has_no_overflow():
    big = np.array([0, 10**15, 4 * 10**15], np.int64)
    total, kept = 5 * 10**15, 10**6
    assert divergence.share(big, total, kept).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 2 * kept) for c in big]


def test_a_hot_source_and_term_are_a_row_a_task(spark):
    """Half of all rows are of one source and hold one word: the exchange carries entries, not rows."""
    df = spark.range(0, 20_000, 1, 4).selectExpr("id AS doc_id", "concat('hot w', char(97 + id % 26)) AS text", "'en' AS lang", "if(id % 2 = 0, 'hot', concat('s', id % 7)) AS source")
    counted = divergence._counted(df.selectExpr("lang", "source", "text"), 4).collect()
    assert len(counted) <= 4 * 4 * 8
    rows = [tuple(r) for r in df.collect()]
    assert {tuple(r) for r in divergence.source_divergence(df).collect()} == plain(rows)
