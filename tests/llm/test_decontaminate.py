import itertools
import random

import numpy as np

from tidemark.llm import decontaminate as d


def plain_leaks(docs, items, window=13, similarity=0.8):
    found = set()
    for doc, text in docs:
        words = (text or "").lower().split()
        for item, body in items:
            want = (body or "").lower().split()
            if len(want) < 5:
                continue
            n = min(window, len(want))
            for shift in range(-len(want), len(words)):
                low, high = max(0, -shift), min(len(want), len(words) - shift)
                same = [want[i] == words[i + shift] for i in range(low, high)]
                if any(sum(same[i : i + n]) >= similarity * n - 1e-9 for i in range(len(same) - n + 1)):
                    found.add((doc, item))
                    break
    return found


def test_masks_read_five_words_each():
    assert all(m.count("1") == 5 for m in d.MASKS)


def test_substitutions_are_tolerated_and_clean_texts_left_alone(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(14, 50)))) for i in range(30)]
    docs = []
    for n in range(200):
        words = rng.choices(vocab, k=rng.randint(0, 120))
        if n % 2:
            passage = items[n % 30][1].split()
            for at in rng.sample(range(len(passage)), int(len(passage) * rng.choice([0, 0.1, 0.15]))):
                passage[at] = "swapped"
            spot = rng.randint(0, len(words))
            words[spot:spot] = [w.upper() for w in passage]
        docs.append((n, " ".join(words)))
    dd, bb = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in d.benchmark_leaks(dd, bb).collect()}
    want = plain_leaks(docs, items)
    assert got <= want
    assert len(got) >= 0.97 * len(want)
    exact = {(n, n % 30) for n in range(1, 200, 2)}
    assert len(exact & got) >= 0.97 * len(exact)
    kept = {r.doc_id for r in d.drop_leaks(dd, bb).collect()}
    assert kept == {n for n, _ in docs} - {n for n, _ in got}


def test_whole_table_equals_brute_force(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in d.benchmark_leaks(docs, items).collect()}
    # texts that share no run of three words with the benchmark cannot reach four fifths of a window
    bodies = [(r.item_id, r.text) for r in items.collect()]
    runs = {tuple(w[i : i + 3]) for _, b in bodies for w in [b.lower().split()] for i in range(len(w) - 2)}
    near = [(r.doc_id, r.text) for r in docs.collect() if any(tuple(w) in runs for w in zip(*[r.text.lower().split()[k:] for k in range(3)], strict=False))]
    assert got == plain_leaks(near, bodies)


def test_best_window_counts():
    item = np.arange(20)
    words = np.concatenate([[99, 98], item, [97]])
    words[7] = -1
    assert d.best_window(words, item, 2) == (2, 20, 19)
    assert d.best_window(words, item + 100, 2) is None
    assert d.best_window(words[:8], item, 2) is None


def test_rows_of_every_kind(spark):
    item = "one two three four five six seven"
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"x {item} y", 0), (1, f"x {item} y", 0), (None, item, 0), (2, None, 0), (3, "", 0), (4, "a b " * 30_000 + item, 0)], "doc_id bigint, text string, hash int")
    got = sorted(((r.doc_id, r.item_id, r.first_word, r.n_words) for r in d.benchmark_leaks(docs, items).collect()), key=str)
    assert got == sorted([(1, 1, 1, 7), (None, 1, 0, 7), (4, 1, 60_000, 7)], key=str)
    assert {r.doc_id for r in d.drop_leaks(docs, items).collect()} == {2, 3}
    assert d.drop_leaks(docs, items).columns == docs.columns
    assert d.benchmark_leaks(docs.where("doc_id = 9"), items).count() == 0
    assert d.benchmark_leaks(docs, items.where("item_id = 9")).count() == 0


def test_masks_meet_every_allowed_substitution(spark):
    items, docs = [], []
    for n in range(5, 14):
        words = [f"n{n}w{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        spare = int(n - 0.8 * n + 1e-9)
        for bad in [x for k in range(spare + 1) for x in itertools.combinations(range(n), k)]:
            docs.append((n * 1000 + len(docs), n, "x y " + " ".join("swapped" if i in bad else w for i, w in enumerate(words)) + " z"))
        docs.append((n * 1000 + len(docs), None, " ".join("swapped" if i <= spare else w for i, w in enumerate(words))))
    dd, bb = spark.createDataFrame(docs, "doc_id bigint, item bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in d.benchmark_leaks(dd.drop("item"), bb).collect()}
    assert got == {(i, n) for i, n, _ in docs if n is not None}


def test_every_text_of_an_item_id_counts(spark):
    texts = [" ".join(f"t{k}w{i}" for i in range(20)) for k in range(6)]
    items = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[2]), (None, texts[3]), (None, texts[4])], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, f"a {t} b") for k, t in enumerate(texts)], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in d.benchmark_leaks(docs, items).collect()} == {(0, 1), (1, 1), (2, 1), (3, None), (4, None)}
    assert {r.doc_id for r in d.drop_leaks(docs, items).collect()} == {5}


def test_private_names_do_not_clash(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six seven y", 1, 1, 1), (2, "clean", 1, 1, 1)], "doc_id bigint, text string, _LEAK int, key int, `a.b` int")
    kept = d.drop_leaks(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
