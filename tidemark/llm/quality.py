"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its words and of the 3- and
4-byte grams of its words (a blank marks their ends), all hashed into one
table; a softmax layer gives the class.  Vectors and output layer are trained
together by stochastic gradient descent in numpy on a bounded sample.

Serving uses that mean and softmax are linear up to the last step: each
bucket's vector is folded with the output layer into one number, so a document
costs a few vector operations a byte and no lookup table of words.

Rows: NULL and blank texts have no features and get the bias's score; NULL ids
pass through; repeated rows give repeated, equal rows; an empty table gives an
empty result.  With no labelled rows of a class every score is 0.5.  Only the
id and the text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import _BYTE, _IS_SPACE, _power_tables, crc_mod, per_text, slices, utf8
from tidemark.llm.training import labelled_sample

BUCKET_BITS = 16
GRAMS = (3, 4)
#: Bucket of a word that repeats the one before it.
PAIR_BUCKET = 1
DIMENSION = 8
EPOCHS = 6
RATE = 0.2


def _features(texts: list[bytes]):
    """Of a few texts: for each feature family the bucket of every position, whether it counts there, and each text's range."""
    joined = b" " + b" ".join(texts) + b" "
    a = np.frombuffer(joined, np.uint8)
    space = _IS_SPACE[a]
    a = np.where(space, np.uint8(32), a)
    n = len(a)
    forward, back = _power_tables(n + 1)
    shift = np.uint64(64 - BUCKET_BITS)
    gaps = np.zeros(n + 1, np.int32)
    np.cumsum(space, out=gaps[1:])
    families = []
    with np.errstate(over="ignore"):
        prefix = np.empty(n + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(_BYTE[a] * forward[:n], dtype=np.uint64, out=prefix[1:])
        back = back[:n] * np.uint64(0xD6E8FEB86659FD93)
        for g in GRAMS:
            if n < g:
                continue
            bucket = ((prefix[g:] - prefix[: n - g + 1]) * back[: n - g + 1] * np.uint64(2 * g + 1)) >> shift
            families.append((bucket, gaps[g - 1 : n] == gaps[1 : n - g + 2], np.arange(n - g + 1)))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        words = ((prefix[ends] - prefix[starts]) * back[starts]) >> shift
    families.append((words, np.ones(len(starts), bool), starts))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
    # the word pair (w, w) has one bucket for every w; a text's first word has none before it
    again = np.concatenate([[False], words[1:] == words[:-1]])[: len(starts)]
    first = np.searchsorted(starts, bounds[:-1])
    again[first[first < len(starts)]] = False
    families.append((np.full(len(starts), PAIR_BUCKET, np.uint64), again, starts))
    return families, bounds


@dataclass(frozen=True)
class QualityModel:
    """``weight`` of each bucket and the ``bias``: the difference of the two classes' scores."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        families, bounds = _features(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, counts, at in families:
            value = np.where(counts, self.weight[bucket], np.float32(0))
            edges = bounds if len(at) and at[-1] == len(at) - 1 else np.searchsorted(at, bounds)
            edges = np.minimum(edges, len(at))
            total += np.diff(np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])[edges])
            count += np.diff(np.concatenate([[0], np.cumsum(counts)])[edges])
        margin = total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def fit_quality(sample: list[tuple[str, int]], *, seed: int = 7, epochs: int = EPOCHS, rate: float = RATE) -> QualityModel:
    """Train by SGD, one document a step; the rate falls linearly to nothing."""
    size = 1 << BUCKET_BITS
    labels = np.array([y for _, y in sample])
    if len(set(labels.tolist())) < 2:
        return QualityModel(np.zeros(size, np.float32), 0.0)
    docs = []
    for text, _ in sample:
        families, _ = _features([text.encode()])
        ids, n = np.unique(np.concatenate([b[c] for b, c, _ in families]), return_counts=True)
        docs.append((ids.astype(np.int64), (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (size, DIMENSION)).astype(np.float32)
    output, bias = np.zeros((DIMENSION, 2), np.float32), np.zeros(2, np.float32)
    balance = len(labels) / (2 * np.bincount(labels, minlength=2))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            step = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[ids]
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= balance[labels[i]]
            back = output @ p
            output -= step * np.outer(hidden, p)
            bias -= 0.1 * step * p
            # a step in proportion to the shares that moves the document's mean by ``step * back``, however many features it has
            if len(ids):
                vectors[ids] -= (step / (share @ share)) * share[:, None] * back
    return QualityModel(vectors @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0]))


def score_quality(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every document."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = utf8(batch.column(1))
            score = np.concatenate([model.scores(texts[i:j]) for i, j in slices(texts, 1 << 18)])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return per_text(docs, [id_col, text_col], make, f"doc_id {kind}, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, *, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """Fit on labelled rows outside the held-out fold, then score all documents: ``doc_id, held_out, score, predicted``."""
    model = fit_quality(labelled_sample(docs, labels, "quality", modulus=modulus, held_out=held_out))
    return score_quality(docs, model).select("doc_id", (crc_mod("doc_id", modulus) == held_out).alias("held_out"), "score", "predicted")
