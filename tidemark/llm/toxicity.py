"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

Kernel.  Two words are compared by the gap-weighted subsequence kernel: every
shared subsequence of ``LENGTH`` characters counts, a match that spans more
characters counts ``DECAY`` less for each.  So an insult with characters
inserted, gapped, masked, left out or appended keeps a part of its value.  A word
is compared as its core, as the parts that punctuation cuts it into, as its
letters alone (separators between letters cost nothing then) and, if one and
the same sign stands in every gap, without that; each with a mark at both ends.

Values.  A landmark is a whole word (both marks) or a word's beginning.  The
value of a word for it is ``K(w, z) / (K(z, z)**(1 - e) K(w, w)**e)``: neither
a word that repeats the landmark's letters nor one that is merely long can
collect much.  ``e`` is a half for beginnings (the cosine; the better of the
word's beginnings as long as the landmark and up to ``WIDER`` longer counts) and
a quarter for whole words, of which a missing letter costs more than a strange
one; words over ``GAPS`` characters longer than a whole word have value 0, and
so have words that hold less than ``SHARED`` of a landmark's characters in order.
Each landmark has a bar, learned from the clean documents: at most ``FALSE_SHARE``
of them may hold a word that reaches it without being the landmark itself.
Under the bar a value is 0, from it on it runs from a half to 1, so a sure insult
weighs the same however many landmarks there are.

Model.  Landmarks come from labelled documents, near copies made one: word
beginnings and words, chosen greedily to cover the toxic documents and few clean
ones; of beginnings the one that takes in all its endings.  The values of the
different words of a passage, ``PASSAGE`` words of a document that follow each
other, are added up: one sure insult is enough, beginnings that clean
documents hold by chance must come in numbers.  They are whitened by the
landmarks' own kernel matrix (Nyström), and a linear SVM (squared hinge loss,
Newton steps) separates passages of clean documents from the most suspicious
passage of each toxic one, chosen anew each round, and from the sure landmarks
themselves, as they are and altered.  A document's score is a logistic function
of the margin of its worst passage, 0.5 at margin 0.

Serving.  Words are remembered by the worker, so each distinct one is compared
once.  The screen for shared characters is bit-parallel over all words and
landmarks, and only the pairs that pass take the kernel.

Rows: NULL and empty texts get the score of a text without insults; NULL ids
pass through; repeated rows give equal results; an empty table gives an empty
result.  Texts are read whole, pieces of words of any length in overlapping
windows of which the first carries the mark of a beginning.
Without labelled rows of both classes every score is 0.  Only id and text are
read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import crc_mod, over_rows, per_text, utf8
from tidemark.llm.training import labelled_sample

LENGTH, DECAY = 5, 0.95
#: How much longer than a landmark what is compared with it may be, and the share of its characters that must be there in order.
GAPS, SHARED = 3, 0.75
#: By how much a word's beginning may be wider than a landmark that is one.
WIDER = 1
#: Exponents of a word's own value, for beginnings and for whole words.
OF_BEGINNING, OF_WORD = 0.5, 0.25
LANDMARKS = 40
#: Landmarks sought for each toxic document.
COVER = 4
#: Landmarks are word beginnings of so many characters.
SHORTEST, LONGEST = 4, 12
#: A word's window and its step; landmarks with their mark are shorter than their difference allows.
WINDOW, STEP = 32, 16
#: The lowest bar of a landmark, and the share of clean documents that may reach it by other words.
FLOOR, FALSE_SHARE = 0.3, 0.0005
#: A landmark is sure if no larger share of the clean documents holds it.
SURE = 0.0008
#: Toxic documents to clean ones (as shares of their classes) that hold a landmark, at least; what a clean one counts against it.
ENRICHED, AGAINST = 4, 3
#: Words of a passage.
PASSAGE = 200
REMEMBERED = 100_000
#: Times each landmark is shown to the SVM as it is, and altered.
PLAIN, ALTERED = 100, 200
_EDGES = bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123))
#: Punctuation and Unicode spaces inside a word.
_INSIDE = re.compile(rb"[!-/:-@\[-`{-~]+|\xc2\xa0|\xe2\x80[\x80-\x8b\xaf]|\xe3\x80\x80")
MARK, LAST = b"^", b"$"
#: Digits and signs that stand for letters inside a word.
_STAND_INS = bytes.maketrans(b"013457@$!|", b"oieastasil")


def units(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased; runs of three and more single characters are one word."""
    words = text.lower().split()
    if not any(len(w) == 1 for w in words):
        return words
    out, run = [], []
    for w in [*words, b""]:
        if len(w) == 1 and w.isalnum():
            run.append(w)
            continue
        out += [b"".join(run)] if len(run) >= 3 else run
        run = []
        if w:
            out.append(w)
    return out


def windows(word: bytes) -> list[bytes]:
    """What of a word is compared, each with its marks: its core, what punctuation cuts it into, and the letters alone.

    A piece over ``WINDOW`` bytes is taken in windows that overlap by half, the
    first with the mark of a beginning.
    """
    core = word.strip(_EDGES).translate(_STAND_INS)
    pieces = [core]
    if not core.isalnum() and len(parts := [p for p in _INSIDE.split(core) if p]) > 1:
        pieces = list(dict.fromkeys([core, *parts, b"".join(parts)]))
    # one sign put into every gap says nothing
    pieces += [q for p in pieces if len(p) > 6 and len(p) % 2 and p[1] == p[3] == p[5] and len(set(p[1::2])) == 1 and (q := p[0::2]) not in pieces]
    out = []
    for piece in pieces:
        marked = MARK + piece + LAST
        out += [marked] if len(marked) <= WINDOW else [marked[i : i + WINDOW] for i in range(0, len(marked) - STEP, STEP)]
    return out


def _matrix(words: list[bytes]) -> np.ndarray:
    """Words as rows of bytes, padded with 0 (which matches nothing)."""
    width = max(map(len, words))
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def subsequence_kernel(words: np.ndarray, others: np.ndarray, length: int = LENGTH, decay: float = DECAY) -> np.ndarray:
    """Kernel of row i of ``words`` with row i of ``others`` (both padded with 0), by the usual recursion over lengths.

    ``before[:, j]`` holds the decayed value of all shorter matches that end
    before position j of the other word; a step over the word's characters
    keeps them for all words at once.
    """
    n, t = others.shape
    decays = np.float32(decay)
    # spread[i, j] = decay**(j - i + 2) for i <= j: a match at i seen from the end of j
    exponent = np.arange(t)[None, :] - np.arange(t)[:, None]
    spread = np.where(exponent >= 0, decays ** (np.maximum(exponent, 0) + 2), 0).astype(np.float32)
    valid = others != 0
    same = [((others == words[:, i, None]) & valid).astype(np.float32) for i in range(words.shape[1])]
    before = [np.ones((n, t), np.float32) for _ in same]
    for _ in range(length - 1):
        after, run = [], np.zeros((n, t), np.float32)
        for hit, b in zip(same, before, strict=True):
            seen = np.zeros((n, t), np.float32)
            seen[:, 1:] = run[:, :-1]
            after.append(seen)
            run *= decays
            run += (hit * b) @ spread
        before = after
    total = np.zeros(n, np.float32)
    for hit, b in zip(same, before, strict=True):
        total += np.einsum("ij,ij->i", hit, b)
    return total * decays * decays


@dataclass
class ToxicityModel:
    """Landmarks (marked words and beginnings), their bars, and the SVM folded onto them: margin = values @ weight + bias."""

    landmarks: list[bytes]
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    bars: np.ndarray | None = None
    own: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def __post_init__(self) -> None:
        #: Words met so far, and the landmark values of those that have any.
        self.known: dict[bytes, None] = {}
        self.active: dict[bytes, np.ndarray] = {}
        if not self.landmarks:
            return
        self.rows = _matrix(self.landmarks)
        self.own = subsequence_kernel(self.rows, self.rows)
        self.bars = np.full(len(self.landmarks), FLOOR) if self.bars is None else self.bars
        self.lengths = np.array([len(z) for z in self.landmarks])
        self.need = np.maximum(LENGTH, np.ceil(SHARED * self.lengths)).astype(int)
        self.whole = np.array([z.endswith(LAST) for z in self.landmarks])
        self.full = (np.uint64(1) << self.lengths.astype(np.uint64)) - np.uint64(1)
        self.masks = np.zeros((256, len(self.lengths)), np.uint64)
        for j, z in enumerate(self.landmarks):
            for i, c in enumerate(z):
                self.masks[c, j] |= np.uint64(1 << i)

    def screened(self, pieces: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(landmark, width, rows) of what shares enough characters in order: whole pieces, or beginnings of the widths a landmark is compared at.

        Bit-parallel over all pieces and landmarks; after each character the
        longest common subsequence of the beginning so far is known.
        """
        v = np.full((len(pieces), len(self.landmarks)), 0xFFFFFFFFFFFFFFFF, np.uint64)
        out, held = [], (pieces != 0).sum(1)
        for i in range(pieces.shape[1]):
            m = self.masks[pieces[:, i]]
            u = v & m
            v = (v + u) | (v - u)
            for j in np.flatnonzero(~self.whole & (self.lengths - 1 <= i) & (i <= self.lengths - 1 + WIDER)):
                row = np.flatnonzero((np.bitwise_count(~v[:, j] & self.full[j]) >= self.need[j]) & ((held > i) | (i == self.lengths[j] - 1)))
                out.append((int(j), i + 1, row))
        for j in np.flatnonzero(self.whole):
            row = np.flatnonzero((np.bitwise_count(~v[:, j] & self.full[j]) >= self.need[j]) & (held <= self.lengths[j] + GAPS))
            out.append((int(j), pieces.shape[1], row))
        return [x for x in out if len(x[2])]

    def piece_values(self, pieces: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, landmark, value) of the pieces that reach a landmark's least value."""
        found = []
        for j, width, row in self.screened(pieces):
            some = pieces[row, : min(width, self.lengths[j] + GAPS)]
            exponent = OF_WORD if self.whole[j] else OF_BEGINNING
            value = subsequence_kernel(some, np.repeat(self.rows[[j], : self.lengths[j]], len(row), 0)) / (self.own[j] ** (1 - exponent) * np.maximum(subsequence_kernel(some, some), 1e-30) ** exponent)
            high = value >= least[j]
            found.append((row[high], np.full(int(high.sum()), j), np.minimum(value[high], 1)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def word_values(self, words: list[bytes], least: np.ndarray) -> dict[bytes, np.ndarray]:
        """Values of words, the best of their pieces, where they reach the least value."""
        pieces, of = [], []
        for k, w in enumerate(words):
            cut = windows(w)
            pieces += cut
            of += [k] * len(cut)
        out: dict[bytes, np.ndarray] = {}
        for start in range(0, len(pieces), 8192):
            for i, j, x in zip(*(v.tolist() for v in self.piece_values(_matrix(pieces[start : start + 8192]), least)), strict=True):
                at = out.setdefault(words[of[start + i]], np.zeros(len(self.landmarks), np.float32))
                at[j] = max(at[j], x)
        return out

    def values(self, words: list[bytes]) -> dict[bytes, np.ndarray]:
        """Landmark values of the words that reach a bar."""
        above = lambda v: 0.5 + 0.5 * (v - self.bars) / np.maximum(1 - self.bars, 1e-6)
        return {w: np.where(v > 0, above(v), 0).astype(np.float32) for w, v in self.word_values(words, self.bars).items()}

    def learn(self, texts: list[bytes]) -> list[list[bytes]]:
        """Compare the words not met before; returns the words of each text."""
        if len(self.known) > REMEMBERED:
            self.known, self.active = {}, {}
        split = [units(x) for x in texts]
        new = set()
        for words in split:
            new.update(words)
        new = [w for w in new if w not in self.known]
        if new and self.landmarks:
            self.active |= self.values(new)
        self.known.update(dict.fromkeys(new))
        return split

    def passages(self, words: list[bytes]) -> list[np.ndarray]:
        """Summed landmark values of the different words of each passage that ends in a word that has any."""
        if not self.active or self.active.keys().isdisjoint(words):
            return []
        hits = [(i, w) for i, w in enumerate(words) if w in self.active]
        out, first, held, total = [], 0, Counter(), np.zeros(len(self.landmarks), np.float32)
        for i, w in hits:
            while hits[first][0] <= i - PASSAGE:
                gone = hits[first][1]
                held[gone] -= 1
                if not held[gone]:
                    total = total - self.active[gone]
                first += 1
            if not held[w]:
                total = total + self.active[w]
            held[w] += 1
            out.append(total)
        return out

    def margins(self, split: list[list[bytes]]) -> np.ndarray:
        return np.array([max((float(s @ self.weight) + self.bias for s in self.passages(words)), default=self.bias) for words in split])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.landmarks:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * np.maximum(self.margins(self.learn(texts)), self.bias), -60, 60)))


def choose_landmarks(docs: list[tuple[list[bytes], int]], most: int = LANDMARKS) -> list[bytes]:
    """Word beginnings, and words with their end mark, that greedily cover each toxic document up to ``COVER`` times; clean documents count against them."""

    def beginnings(words: list[bytes]) -> set[str]:
        cores = {w.strip(_EDGES).decode("utf-8", "ignore") for w in words}
        return {c[:n] for c in cores for n in range(SHORTEST, min(len(c), LONGEST) + 1)} | {c + "$" for c in cores if SHORTEST <= len(c) <= LONGEST}

    # one document's beginnings at a time, and clean ones only where toxic ones are frequent: memory stays small
    toxic, clean = Counter(), Counter()
    for words, label in docs:
        if label:
            toxic.update(beginnings(words))
    n_toxic = sum(y for _, y in docs)
    least = max(3, n_toxic // 50)
    toxic = {c: n for c, n in toxic.items() if n >= least}
    for words, label in docs:
        if not label:
            clean.update(beginnings(words) & toxic.keys())
    share = max(1, n_toxic) / max(1, len(docs) - n_toxic)
    candidates = {c for c, n in toxic.items() if ENRICHED * clean[c] * share <= n}
    covers: dict[str, set[int]] = {c: set() for c in candidates}
    for i, (words, label) in enumerate(docs):
        if label:
            for c in beginnings(words) & candidates:
                covers[c].add(i)
    chosen, need = [], np.full(len(docs), COVER)
    while covers and len(chosen) < most:
        gains = {c: sum(need[i] > 0 for i in s) - AGAINST * share * clean[c] for c, s in covers.items()}
        most_gained = max(gains.values())
        if most_gained < least:
            break
        # the longest of the nearly best: what is longer is confused less
        best = max((c for c, g in gains.items() if g >= 0.9 * most_gained), key=lambda c: (len(c), gains[c], c))
        chosen.append(MARK + best.encode())
        need[list(covers.pop(best))] -= 1
        # what begins like a landmark, or is its beginning, adds nothing to it
        covers = {c: s for c, s in covers.items() if gains[c] >= least and not c.startswith(best) and not best.startswith(c)}
    return chosen


def merged_copies(docs: list[tuple[list[bytes], int]], hashes: int = 8, agree: int = 3) -> list[tuple[list[bytes], int]]:
    """Documents with near copies made one (by min-hashes of their word pairs), so that what is copied is no evidence by itself."""
    seeds = [np.uint64(x) for x in np.random.default_rng(3).integers(1, 2**63, hashes) * 2 + 1]
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    met: dict[tuple[int, int], int] = {}
    for i, (words, label) in enumerate(docs):
        pairs = np.array([zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:] or words, strict=False)], np.uint64)
        if not len(pairs):
            continue
        with np.errstate(over="ignore"):
            least = [(k, int(((pairs + np.uint64(k)) * s ^ (pairs * s >> np.uint64(31))).min()), label) for k, s in enumerate(seeds)]
        for other, n in Counter(met[x] for x in least if x in met).items():
            if n >= agree:
                root[find(i)] = find(other)
        for x in least:
            met.setdefault(x, i)
    groups: dict[int, list[bytes]] = {}
    for i, (words, _) in enumerate(docs):
        groups.setdefault(find(i), []).extend(words)
    return [(words, docs[i][1]) for i, words in groups.items()]


def _inserted(word: bytes, rng: np.random.Generator) -> bytes:
    """The word with separators or letters put in, or a letter masked or left out, as evaders do."""
    style = rng.integers(6)
    if style == 0:
        return bytes([b".-_*"[rng.integers(4)]]).join(word[i : i + 1] for i in range(len(word)))
    at = 1 + int(rng.integers(max(1, len(word) - 1)))
    if style == 1:
        return word[:at] + word[at - 1 : at] + word[at:]
    if style >= 4:
        return word[:at] + (b"*" if style == 4 else b"") + word[at + 1 :]
    return word[:at] + bytes([(b"*.-_xz" if style == 2 else b"aeiouxyz")[rng.integers(6)]]) + word[at:]


def learned_bars(model: ToxicityModel, clean: list[list[bytes]], pool: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bar, share of clean documents that reach it) of each landmark."""
    values = model.word_values(pool, np.full(len(model.landmarks), FLOOR))
    none = np.zeros(len(model.landmarks), np.float32)
    best = np.array([np.maximum.reduce([none, *(values[w] for w in set(words) if w in values)]) for words in clean]).reshape(-1, len(none))
    bars = []
    for v in best.T:
        v = np.sort(v)[::-1]
        allowed = int((v >= 0.999).sum() + FALSE_SHARE * len(v))
        bars.append(max(FLOOR, min(float(v[allowed]) + 1e-3 if allowed < len(v) else FLOOR, 0.999)))
    return np.array(bars), (best >= np.array(bars)).mean(0) if len(best) else np.zeros(len(none))


def fit_toxicity(sample: list[tuple[str, int]], *, seed: int = 11, rounds: int = 3, decay: float = 3e-4) -> ToxicityModel:
    pool: dict[bytes, bytes] = {}  # equal words are one object
    docs = [([pool.setdefault(w, w) for w in units(text.encode())], label) for text, label in sample]
    marks = choose_landmarks(merged_copies(docs)) if len({y for _, y in docs}) == 2 else []
    model = ToxicityModel(marks, np.zeros(len(marks), np.float32), -1.0)
    if not marks:
        return model
    rng = np.random.default_rng(seed)
    model.bars, chance = learned_bars(model, [words for words, y in docs if not y], list(pool))
    # the landmarks' own kernel matrix
    kernel = np.stack([subsequence_kernel(np.repeat(model.rows[[i]], len(marks), 0), model.rows) / np.sqrt(model.own[i] * model.own) for i in range(len(marks))])
    value, vector = np.linalg.eigh((kernel + kernel.T) / 2)
    whiten = vector / np.sqrt(np.maximum(value, 1e-2)) @ vector.T
    model.active = model.values(list(pool))
    none = np.zeros(len(marks), np.float32)
    bags = [(model.passages(words) or [none], label) for words, label in docs]
    # each sure landmark as a passage of its own, as it is and with characters put in
    altered = [w for z, share in zip(marks, chance, strict=True) if share <= SURE for w in [z.strip(MARK + LAST)] * PLAIN + [_inserted(z.strip(MARK + LAST), rng) for _ in range(ALTERED)]]
    seen = model.values(altered)
    extra = [seen[w] for w in altered if w in seen]
    clean = np.array([s for bag, y in bags if not y for s in bag]) @ whiten
    # a toxic document without any landmark says nothing about landmarks
    toxic = [np.array(bag) @ whiten for bag, y in bags if y and any(s.any() for s in bag)]
    weight, bias = whiten @ np.ones(len(marks)), -0.5
    for _ in range(rounds):
        worst = [bag[np.argmax(bag @ weight)] for bag in toxic] + [s @ whiten for s in extra]
        x = np.concatenate([np.array(worst).reshape(-1, len(marks)), clean])
        y = np.concatenate([np.ones(len(worst)), -np.ones(len(clean))])
        each = np.where(y > 0, len(y) / (2 * max(1, len(worst))), len(y) / (2 * max(1, len(clean))))
        weight, bias = _svm(x, y, each / len(y), decay)
    # a landmark of toxic texts never speaks for a document
    model.weight, model.bias = np.maximum(whiten @ weight, 0).astype(np.float32), float(bias)
    margin = np.array([max(model.bias, *(float(s @ model.weight) + model.bias for s in bag)) for bag, _ in bags])
    model.slope = _slope(margin, np.array([y for _, y in bags], float))
    model.known, model.active = {}, {}
    return model


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, decay: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps over the rows inside the margin."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.diag([decay] * x.shape[1] + [1e-6])
    theta = np.zeros(x1.shape[1])
    for _ in range(steps):
        slack = 1 - y * (x1 @ theta)
        inside = slack > 0
        gradient = ridge @ theta - x1[inside].T @ (cost[inside] * y[inside] * slack[inside])
        theta = theta - np.linalg.solve(ridge + (x1[inside] * cost[inside, None]).T @ x1[inside], gradient)
    return theta[:-1], float(theta[-1])


def _slope(margin: np.ndarray, label: np.ndarray, steps: int = 100) -> float:
    """Slope of a logistic fit through (0, 0.5) by Newton steps, classes weighted alike, held back a little."""
    weight = np.where(label > 0, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
    slope = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(margin * slope, -30, 30)))
        gradient = float(margin @ (weight * (p - label))) + 1e-3 * slope
        slope = min(50.0, max(1e-3, slope - gradient / (float((margin**2) @ (weight * p * (1 - p))) + 1e-3)))
    return slope


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every document."""

    def make():
        own = _of_worker(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = np.concatenate([own.scores(utf8(batch.column(1).slice(i, 512))) for i in range(0, batch.num_rows, 512)])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return per_text(docs, [id_col, text_col], make, f"doc_id {kind}, score double, predicted int")


_worker: dict[bytes, ToxicityModel] = {}


def _of_worker(model: ToxicityModel) -> ToxicityModel:
    """The worker's own copy of a model, so that tasks of one worker share the words they have compared."""
    key = b"".join(model.landmarks) + model.weight.tobytes()
    if key not in _worker:
        _worker.clear()
        _worker[key] = model
    return _worker[key]


def toxicity_model(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, held_out: int = 0) -> ToxicityModel:
    return fit_toxicity(labelled_sample(docs, labels, "toxic", modulus=modulus, held_out=held_out))


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """Fit on labelled rows outside the held-out fold, then score all documents: ``doc_id, held_out, score, predicted``."""
    model = toxicity_model(docs, labels, modulus=modulus, held_out=held_out)
    return score_toxicity(docs, model).select("doc_id", (crc_mod("doc_id", modulus) == held_out).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all other rows and all columns stay."""
    at = docs.columns.index(text_col)

    def run(batches):
        own = _of_worker(model)
        for batch in batches:
            texts = utf8(batch.column(at))
            if texts:
                score = np.concatenate([own.scores(texts[i : i + 512]) for i in range(0, len(texts), 512)])
                yield batch.filter(pa.array(score < threshold))

    return over_rows(docs, run)
