import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, quality, toxicity
from tidemark.llm.training import labelled_sample


def plain_kernel(s, t, n, decay):
    """The gap-weighted subsequence kernel straight from its recursion."""

    @lru_cache(None)
    def prime(i, a, b):
        if i == 0:
            return 1.0
        if min(a, b) < i:
            return 0.0
        return decay * prime(i, a - 1, b) + sum(prime(i - 1, a - 1, j) * decay ** (b - j + 1) for j in range(b) if t[j] == s[a - 1])

    return sum(prime(n - 1, a, b) * decay**2 for a in range(len(s)) for b in range(len(t)) if s[a] == t[b])


def test_kernel_equals_its_recursion():
    rng = random.Random(2)
    words = [bytes(rng.choices(b"abcd", k=rng.randint(1, 9))) for _ in range(40)]
    others = [bytes(rng.choices(b"abcd", k=rng.randint(1, 7))) for _ in range(40)]
    for n in (1, 2, 3, 4):
        got = toxicity.subsequence_kernel(toxicity._matrix(words), toxicity._matrix(others), n, 0.7)
        assert got == pytest.approx([plain_kernel(a, b, n, 0.7) for a, b in zip(words, others, strict=True)], rel=1e-4, abs=1e-6)


def test_screen_is_the_longest_common_subsequence():
    rng = random.Random(3)
    marks = [b"^abcabc$", b"^ccabacb", b"^bbbb$"]
    model = toxicity.ToxicityModel(marks, np.ones(3, np.float32), 0.0)
    words = [bytes(rng.choices(b"abc^$", k=rng.randint(1, 12))) for _ in range(300)]
    got = {(i, j, width) for j, width, row in model.screened(toxicity._matrix(words)) for i in row.tolist()}
    assert model.need.tolist() == [6, 6, 5]
    want = {(i, j, 12) for i, a in enumerate(words) for j, b in enumerate(marks) if j != 1 and len(a) <= len(b) + toxicity.GAPS and longest_common(a, b) >= model.need[j]}
    want |= {(i, 1, w) for i, a in enumerate(words) for w in (8, 9) if (len(a) >= w or w == 8) and longest_common(a[:w], marks[1]) >= model.need[1]}
    assert got == want


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def plain_value(word, z):
    """The best piece of a word by the kernel's recursion."""
    n, decay = toxicity.LENGTH, toxicity.DECAY
    whole, own = z.endswith(b"$"), plain_kernel(z, z, n, decay)
    best = 0.0
    for piece in toxicity.windows(word):
        for p in [piece] * (len(piece) <= len(z) + toxicity.GAPS) if whole else {piece[: len(z) + k] for k in range(toxicity.WIDER + 1)}:
            if longest_common(p, z) >= max(n, toxicity.SHARED * len(z)):
                e = toxicity.OF_WORD if whole else toxicity.OF_BEGINNING
                best = max(best, plain_kernel(p, z, n, decay) / (own ** (1 - e) * plain_kernel(p, p, n, decay) ** e))
    return min(best, 1.0)


def barred(value, bar):
    return 0.5 + 0.5 * (value - bar) / max(1 - bar, 1e-6) if value >= bar else 0.0


def test_pieces_of_a_word():
    assert toxicity.windows(b"plain.") == [b"^plain$"]
    assert set(toxicity.windows(b"b-l-o-c-k!")) >= {b"^b-l-o-c-k$", b"^block$"}
    assert set(toxicity.windows(b"well-known")) == {b"^well-known$", b"^well$", b"^known$", b"^wellknown$"}
    assert b"^block$" in toxicity.windows(b"bxlxoxcxk")
    assert set(toxicity.windows("you\u00a0idiot".encode())) >= {b"^you$", b"^idiot$"}
    assert toxicity.windows(b"a" * 100)[0] == b"^" + b"a" * 31 and all(len(p) <= 32 for p in toxicity.windows(b"a" * 100))


def test_gapped_separated_and_inserted_insults_are_found():
    """Variants of every landmark, nine in ten at least of each kind."""
    model = toxicity.fit_toxicity(toy(600))
    words = [z.strip(b"^$").decode() for z in model.landmarks]
    kinds = {
        "as it is": lambda w: w, "hyphens": "-".join, "dots": ".".join, "underscores": "_".join, "an x in every gap": "x".join, "blanks": " ".join, "upper case": str.upper,
        "a letter put in": lambda w: w[: len(w) // 2] + "q" + w[len(w) // 2 :], "a letter doubled": lambda w: w[:2] + w[1:], "no-break space before": lambda w: "you\u00a0" + w, "joined by an underscore": lambda w: "you_" + w,
    }
    for kind, make in kinds.items():
        caught = sum(model.scores([f"talen rover {make(w)} midop".encode()])[0] >= 0.5 for w in words)
        assert caught >= 0.9 * len(words), (kind, caught, len(words))


def test_scores_equal_a_plain_version_without_screen():
    sample = toy(300)
    model = toxicity.fit_toxicity(sample)
    rng = random.Random(9)
    texts = [t.replace("nitwit", rng.choice(["n-i-t-w-i-t", "nitwt", "n*twit", "xnitwit"])) if rng.random() < 0.5 else t for t, _ in sample[:120]]
    texts += [" ".join(rng.choices(["talen", "rover", "nitwt", "blockhaed", "scounrel", "midop"], weights=[60, 60, 1, 1, 1, 60], k=700)) for _ in range(10)]
    value = lru_cache(None)(lambda w: np.array([barred(plain_value(w, z), b) for z, b in zip(model.landmarks, model.bars, strict=True)]))
    for text in texts:
        words = toxicity.units(text.encode())
        worst = model.bias
        for i in range(len(words)):
            passage = {w for w in words[max(0, i + 1 - toxicity.PASSAGE) : i + 1]}
            worst = max(worst, float(sum((value(w) for w in passage), np.zeros(len(model.landmarks))) @ model.weight) + model.bias)
        assert model.scores([text.encode()])[0] == pytest.approx(1 / (1 + np.exp(-model.slope * worst)), rel=1e-3)


def test_one_passage_must_hold_the_evidence():
    """Beginnings that clean documents hold by chance weigh in numbers, and only where they stand together."""
    model = toxicity.ToxicityModel([b"^achlich"], np.array([0.4], np.float32), -1.0)
    words = ["achlichen", "achlichung", "achlichkeit"]
    assert model.scores([" ".join(words).encode()])[0] > 0.5
    assert model.scores([" ".join(words[:1] * 9).encode()])[0] < 0.5  # one word, said again
    apart = (" wort" * toxicity.PASSAGE).join(words)
    assert model.scores([apart.encode()])[0] < 0.5


def test_near_copies_are_one_document():
    words = [f"w{i}".encode() for i in range(200)]
    docs = [(words, 1), (words[:150] + [b"other"] + words[150:], 1), (words[::-1], 1), (words, 0), ([b"short"], 0), ([], 1)]
    assert [(len(w), y) for w, y in toxicity.merged_copies(docs)] == [(401, 1), (200, 1), (200, 0), (1, 0), (0, 1)]


def test_masked_and_dropped_letters_keep_their_kernel():
    marks = [b"^pathetic", b"^stupid$", b"^worthles", b"^idiot$"]
    model = toxicity.ToxicityModel(marks, np.ones(4, np.float32), 0.0)
    words = [b"pathtic", b"path*tic", b"stupd", b"st*pid", b"w*rthless", b"idot", b"i.d.i.o.t", b"plain", b"wordless"]
    got = model.values(words)
    for w in words:
        for j, z in enumerate(marks):
            assert (got[w][j] if w in got else 0.0) == pytest.approx(barred(plain_value(w, z), toxicity.FLOOR), rel=1e-3), (w, z)
    assert all(w in got for w in words[:7])
    assert "plain" not in got


def test_insults_with_a_letter_masked_or_left_out_are_found():
    model = toxicity.fit_toxicity(toy(600))
    for insult in ("scoundel", "sc*undrel", "blokhead", "bl*ckhead", "nitw*t"):
        assert model.scores([f"talen rover {insult} mike".encode()])[0] >= 0.5, insult
    for clean in ("talen rover midop", "block of heads", "kelen rolen suver"):
        assert model.scores([clean.encode()])[0] < 0.5, clean


def toy(n, seed=1):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ta", "ro", "mi", "ke", "su") for b in ("len", "ver", "dop", "nim", "sat", "rig")]
    bad = ["scoundrel", "nitwit", "blockhead"]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 40))
        label = i % 4 == 0
        if label:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((" ".join(words) + ".", int(label)))
    return rows


def test_gapped_and_inserted_insults_are_found():
    model = toxicity.fit_toxicity(toy(600))
    score = lambda text: float(model.scores([text.encode()])[0])
    for insult in ("scoundrel", "nitwit", "Blockhead!", "n i t w i t", "block-head", "sc0undrel", "nitxwit", "scooundrel", "blockheads"):
        assert score(f"talen rover {insult} mike") >= 0.5, insult
    for clean in ("", "talen rover midop", "block of heads", "a b c d e", "kelen " * 3000):
        assert score(clean) < 0.5, clean
    assert score("talen scoundrel " + "rover " * 5000) >= 0.5


def held_out_accuracy(spark, fit, score, label, modulus, held_out):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    positive = [r.score for r in rows if r[label] == 1]
    negative = [r.score for r in rows if r[label] == 0]
    pairs = np.searchsorted(np.sort(negative), positive, side="left") + np.searchsorted(np.sort(negative), positive, side="right")
    return float(pairs.sum() / (2 * len(positive) * len(negative))), {zlib.crc32(str(r.doc_id).encode()) % modulus == held_out for r in score(docs.limit(0), labels).collect()}


@pytest.fixture(scope="module")
def judged():
    """Held-out documents of sf0.1 with their language, label and score, and the model fitted on the others."""
    import duckdb

    rows = duckdb.sql("SELECT doc_id, text, lang, toxic FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) WHERE text IS NOT NULL").fetchall()
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = toxicity.fit_toxicity(sorted((t, y) for i, t, _, y in rows if not fold(i) and len(t) <= 20_000))
    held = [(t, lang, y) for i, t, lang, y in rows if fold(i)]
    return model, [(lang, y, float(p)) for (_, lang, y), p in zip(held, model.scores([t.encode() for t, _, _ in held]), strict=True)], held


def test_toxicity_is_fair_to_every_language(judged):
    _, scored, _ = judged
    for lang in ("en", "de", "fr", "es"):
        clean = [p for n, y, p in scored if n == lang and not y]
        toxic = [p for n, y, p in scored if n == lang and y]
        wrong, caught = sum(p >= 0.5 for p in clean), sum(p >= 0.5 for p in toxic)
        print(f"{lang}: {wrong} of {len(clean)} clean documents flagged, {caught} of {len(toxic)} toxic ones caught")
        assert wrong <= 0.03 * len(clean) and caught >= 0.9 * len(toxic), lang


def test_sure_landmarks_are_found_in_any_dress(judged):
    model, scored, held = judged
    rng = random.Random(4)
    hosts = [t.split(" ") for (t, lang, y), (_, _, p) in zip(held, scored, strict=True) if not y and p < 0.5 and lang == "en"][:8]

    def inserted(word, n):
        for _ in range(n):
            at = rng.randrange(1, len(word))
            word = word[:at] + rng.choice("abcdefghijklmnopqrstuvwxyz") + word[at:]
        return word

    alone = lambda w: model.scores([f"{w}".encode()])[0] >= 0.5
    sure = [z.strip(b"^$").decode() for z in model.landmarks if z.isascii() and z.endswith(b"$") and alone(z.strip(b"^$").decode())]
    assert len(sure) >= 9
    kinds = {"as it is": str, "hyphens": "-".join, "dots": ".".join, "an x in every gap": "x".join, "blanks": " ".join, "doubled": lambda w: w[:2] + w[1:], "one letter": lambda w: inserted(w, 1), "two letters": lambda w: inserted(w, 2)}
    for kind, dress in kinds.items():
        texts = []
        for w in sure:
            for host in hosts:
                at = rng.randrange(len(host) + 1)
                texts.append(" ".join([*host[:at], dress(w), *host[at:]]).encode())
        caught = (model.scores(texts) >= 0.5).mean()
        print(f"{kind}: {caught:.2f}")
        assert caught >= 0.9, kind


def test_toxicity_ranks_held_out_documents(spark):
    auc, _ = held_out_accuracy(spark, None, toxicity.toxicity_scores, "toxic", 5, 0)
    assert auc > 0.95


def test_quality_ranks_held_out_documents(spark):
    auc, _ = held_out_accuracy(spark, None, quality.quality_scores, "quality", 3, 1)
    assert auc > 0.97


def test_sample_is_bounded_and_keeps_the_fold_out(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    got = labelled_sample(docs, labels, "toxic", modulus=5, held_out=0, rows=30)
    assert got == labelled_sample(docs.repartition(5), labels.repartition(3), "toxic", modulus=5, held_out=0, rows=30)
    assert sum(y for _, y in got) == 30
    assert len(got) == 60
    assert all(zlib.crc32(t.split()[1].encode()) % 5 for t, _ in got)


@pytest.mark.parametrize("scores", [toxicity.toxicity_scores, quality.quality_scores])
def test_rows_of_every_kind(spark, scores):
    sample = toy(200)
    rows = [(i, t, "s", 0.5) for i, (t, _) in enumerate(sample)] + [(900, None, None, None), (901, "", "s", 0.1), (None, "nitwit", "s", 0.1), (902, "nitwit " * 30_000, "s", 0.1), (3, sample[3][0], "s", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")
    labels = spark.createDataFrame([(i, y, y) for i, (_, y) in enumerate(sample)] + [(None, 1, 1), (5, None, None)], "doc_id bigint, toxic int, quality int")
    got = scores(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert scores(docs.where("doc_id = 5000"), labels).count() == 0
    assert {r.score for r in scores(docs, labels.where("toxic = 0")).collect()} <= {0.0, 0.5}


def test_quality_model_alone():
    good = [(" ".join(random.Random(i).choices(["plain", "useful", "prose", "reads", "well"], k=30)), 1) for i in range(80)]
    junk = [(" ".join(random.Random(i).choices(["BUY!!", "NOW!!", "###", "$$$"], k=30)), 0) for i in range(80)]
    model = quality.fit_quality(good + junk)
    s = model.scores([b"useful prose", b"BUY!! $$$", b"", b"plain " * 50_000])
    assert s[0] > 0.5 > s[1]
    assert s[3] == pytest.approx(model.scores([b"plain plain"])[0], abs=0.2)
    assert np.array_equal(model.scores([b"useful prose", b"x"])[:1], model.scores([b"useful prose"]))


def plain_features(text):
    """Buckets of one text: 3- and 4-byte grams of its blank-edged words, its words, and one for each repeated word."""
    mask, out = (1 << 64) - 1, []
    power = [pow(common._BASE, i, 1 << 64) for i in range(5000)]
    byte = [int(x) for x in common._BYTE]
    mixed = 0xD6E8FEB86659FD93
    words = text.encode().split()
    for w in words:
        edged = b" " + w + b" "
        for g in quality.GRAMS:
            for i in range(len(edged) - g + 1):
                h = sum(byte[c] * power[k] for k, c in enumerate(edged[i : i + g])) & mask
                out.append((h * mixed * (2 * g + 1) & mask) >> (64 - quality.BUCKET_BITS))
        h = sum(byte[c] * power[k] for k, c in enumerate(w)) & mask
        out.append((h * mixed & mask) >> (64 - quality.BUCKET_BITS))
    return out + [quality.PAIR_BUCKET for a, b in zip(words, words[1:], strict=False) if a == b]


def test_quality_scores_equal_plain_features_and_vectors():
    rng = random.Random(6)
    texts = ["", " ", "a", "one", "one", "one two", "two two two", "ünï cödé ünï", "tabs\tand\nlines  here", "x" * 90] + [" ".join("".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    weight = np.random.default_rng(1).normal(size=1 << quality.BUCKET_BITS).astype(np.float32)
    model = quality.QualityModel(weight, 0.25)
    got = model.scores([t.encode() for t in texts])
    for t, p in zip(texts, got, strict=True):
        f = plain_features(t)
        margin = (sum(float(weight[b]) for b in f) / len(f) if f else 0.0) + 0.25
        assert p == pytest.approx(1 / (1 + np.exp(-margin)), rel=1e-4), t
    # a text's score does not depend on what stands beside it
    assert [float(model.scores([t.encode()])[0]) for t in texts] == pytest.approx(list(got), rel=1e-9)


def test_folded_weights_equal_softmax_over_the_mean_vector():
    """The serving fold against the network itself: mean of vectors, output layer, softmax."""
    sample = [("good clear words stand here " * 3, 1), ("bad bad junk junk junk " * 3, 0)] * 20
    model = quality.fit_quality(sample)
    rng = np.random.default_rng(2)
    vectors, output, bias = rng.normal(size=(1 << quality.BUCKET_BITS, 4)).astype(np.float32), rng.normal(size=(4, 2)).astype(np.float32), np.array([0.1, 0.4])
    folded = quality.QualityModel(vectors @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0]))
    for text in ("some words", "some some words here", "x"):
        z = vectors[plain_features(text)].mean(0) @ output + bias
        p = np.exp(z) / np.exp(z).sum()
        assert folded.scores([text.encode()])[0] == pytest.approx(p[1], rel=1e-4)
    assert model.scores([sample[0][0].encode()])[0] > 0.5 > model.scores([sample[1][0].encode()])[0]


def test_sample_takes_one_text_an_id(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i} " * (1 + i % 3)) for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4)] * 3, "doc_id bigint, quality int, toxic int")
    got = {tuple(labelled_sample(docs.repartition(n), labels, "quality", modulus=5, held_out=9)) for n in (1, 4)}
    assert len(got) == 1 and len(got.pop()) == 4
