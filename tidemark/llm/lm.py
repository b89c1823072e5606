"""Language-model scoring by deleted interpolation.

Tokens are lower-cased (A-Z) words and one end a text; the context of a text's
first word is an end.  The model mixes maximum-likelihood estimates

    P(w | v) = a_b c(v w)/c(v) + u_b c(w)/N + z_b /(V + 1),   b = bucket of c(v),

where buckets are powers of two of the context's frequency and each bucket's
weights come from expectation-maximisation over held-out counts: one training
document in seven is *deleted*, its tokens are predicted from the counts of the
others.  Scores use the counts of all training documents.

How counts travel.  Texts are dealt to chunks by a hash of their row.  A chunk
sorts its n-gram hashes once and sends each distinct one, with its counts, to
the owner of its hash range as packed arrays (delta-coded, one row a chunk and
range).  The owner sums over chunks and answers each request with the corpus
counts in the request's own order, so an answer carries no keys.  Texts meet
their chunk's answers in a co-group.  All of it is shuffled by chunk or by
range of a hash, so hot words are one entry a chunk and weigh no more than rare
ones; nothing of the corpus's size reaches the driver or is broadcast.  What
does reach it is the EM histogram, whose cells are quantised probabilities
(at most 40 x 160 x 160, in practice thousands).  A chunk and a hash range are
held whole by one worker, so their number follows the bytes of the texts
(``chunks_for``), not a setting alone.

Rows: NULL and blank texts are the end alone; NULL and repeated ids are scored
row by row; an empty table gives an empty result; without training rows every
token has probability 1/(V + 1) = 1.  Only the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, column, crc_mod, mix, shuffle_partitions, slices, utf8, word_hashes

#: Bits kept of a word's hash and of a bigram's (shorter keys lie closer together, so their differences pack better);
#: a bigram shares its key with another one with a chance of (distinct bigrams) / 2**54.
KEY_BITS = {1: 62, 2: 54}
#: Texts travel compressed; they are most of what is shuffled.
LEVEL = 6
#: Two low bits of a key say whose occurrence it is.
OTHER, TRAINED, DELETED = 0, 1, 2
_END = np.uint64(0x5DEECE66D1CE4E5B)
#: Bytes of text in a chunk; more only where requests (one a chunk and range) would fall under so many bytes each.
CHUNK_BYTES, REQUEST_BYTES = 16 << 20, 512
BUCKETS = 40
#: Quantisation of log2 probabilities in the EM histogram, and its range.
STEPS, RANGE = 4, 40
EM_ROUNDS = 60


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts in order, ends included, and the number of tokens of each text."""
    parts, counts = [], []
    for i, j in slices(texts):
        h, _, _, bounds = word_hashes(texts[i:j])
        parts.append(np.insert(h, bounds[1:], _END))
        counts.append(np.diff(bounds) + 1)
    return (np.concatenate(parts), np.concatenate(counts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def bigrams(words: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it (an end before the first): texts end in an end, so one shift serves all."""
    before = np.concatenate([[_END], words[:-1]]).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(0x9E3779B97F4A7C15) + words)


def shortened(hashes: np.ndarray, order: int) -> np.ndarray:
    return hashes >> np.uint64(64 - KEY_BITS[order])


def distinct(keys: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys (62 bits at most) with how many occurrences are in training documents and in deleted ones."""
    tagged = np.sort((keys << np.uint64(2)) | kind)
    key = tagged >> np.uint64(2)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    tag = tagged & np.uint64(3)
    add = lambda x: np.add.reduceat(x.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return key[first], add(tag != OTHER), add(tag == DELETED)


def _packed(values: np.ndarray) -> bytes:
    """Non-negative integers at the least whole number of bytes each; the first byte says how many."""
    v = values.astype("<u8")
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return bytes([width]) + np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def _deltas(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def _dealt(docs: DataFrame, chunks: int, modulus: int, held_out: int, id_col: str, text_col: str) -> DataFrame:
    """``chunk, kind, ids, texts``: packets of documents; deleted documents have chunks of their own, from ``chunks`` on.

    A packet holds the documents of one chunk and kind in an Arrow batch, their
    texts compressed together.
    """
    residue = crc_mod("doc_id", modulus)
    kind = F.when(residue == held_out, OTHER).when(residue == (held_out + 1) % modulus, DELETED).otherwise(TRAINED)
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")).withColumn("kind", kind)
    row = F.xxhash64("doc_id", "text")
    few = max(1, chunks // modulus)
    chunk = F.when(F.col("kind") == DELETED, F.lit(chunks) + F.pmod(row, F.lit(few))).otherwise(F.pmod(row, F.lit(chunks))).cast("int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(0).to_numpy().astype(np.int64) * 4 + batch.column(1).to_numpy()
            texts, order = utf8(batch.column(3)), np.argsort(place, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(place[order])) + 1, len(order))
            packed, ids, first = [], batch.column(2).take(pa.array(order)), 0
            for end in ends:
                mine = [texts[i] for i in order[first:end]]
                sizes = np.fromiter(map(len, mine), np.int64, len(mine))
                packed.append(squeeze.compress(sizes.tobytes() + b"".join(mine)))
                first = end
            starts = order[np.concatenate([[0], ends[:-1]])]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), batch.column(1).take(pa.array(starts)), lists, pa.array(packed, pa.binary())], names=["chunk", "kind", "ids", "texts"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    return rows.select(chunk.alias("chunk"), F.col("kind").cast("int").alias("kind"), "doc_id", "text").mapInArrow(pack, f"chunk int, kind int, ids array<{id_kind}>, texts binary")


def _chunk_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's packets: word keys, bigram keys, tokens of each text, the kind of each token."""
    words, counts, kinds, expand = [], [], [], zstandard.ZstdDecompressor()
    for kind, ids, packet in zip(table.column("kind").to_pylist(), table.column("ids"), table.column("texts").to_pylist(), strict=True):
        data, n = expand.decompress(packet), len(ids)
        ends = 8 * n + np.cumsum(np.frombuffer(data, np.int64, n))
        w, c = tokens([data[a:b] for a, b in zip([8 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)])
        words.append(w)
        counts.append(c)
        kinds.append(np.full(len(w), kind, np.uint64))
    every = np.concatenate(words)
    return shortened(every, 1), shortened(bigrams(every), 2), np.concatenate(counts), np.concatenate(kinds)


def requests(dealt: DataFrame, ranges: int) -> DataFrame:
    """``range, chunk, order, keys, trained, deleted``: each chunk's distinct n-grams by range of their hash."""
    bounds = {order: np.array([(r << bits) // ranges for r in range(1, ranges)], np.uint64) for order, bits in KEY_BITS.items()}

    def ask(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        words, pairs, _, kind = _chunk_keys(table)
        rows = {n: [] for n in ("range", "chunk", "order", "keys", "trained", "deleted")}
        for order, keys in ((1, words), (2, pairs)):
            key, trained, deleted = distinct(keys, kind)
            cut = [0, *np.searchsorted(key, bounds[order]).tolist(), len(key)]
            for r in range(ranges):
                a, b = cut[r], cut[r + 1]
                for name, value in zip(rows, (r, chunk, order, _deltas(key[a:b]), _packed(trained[a:b]), _packed(deleted[a:b])), strict=True):
                    rows[name].append(value)
        return pa.table(rows, schema=pa.schema([("range", pa.int32()), ("chunk", pa.int32()), ("order", pa.int32()), ("keys", pa.binary()), ("trained", pa.binary()), ("deleted", pa.binary())]))

    return dealt.groupBy("chunk").applyInArrow(ask, "range int, chunk int, order int, keys binary, trained binary, deleted binary")


def answers(asked: DataFrame) -> DataFrame:
    """``chunk, order, range, trained, deleted, n_distinct, n_tokens, n_deleted``: corpus counts in each request's order.

    The last three are totals of the range over training documents and stand in
    one row of it.
    """

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [_keys(r["keys"]) for r in rows]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        number = np.empty(len(every), np.int64)
        number[order] = np.cumsum(new) - 1
        size = int(new.sum())
        total = [np.bincount(number, np.concatenate([_unpacked(r[c]) for r in rows]).astype(np.float64), size).astype(np.int64) for c in ("trained", "deleted")]
        out, at, squeeze = [], 0, zstandard.ZstdCompressor(level=1).compress
        for i, (r, k) in enumerate(zip(rows, keys, strict=True)):
            mine = number[at : at + len(k)]
            at += len(k)
            out.append({"chunk": r["chunk"], "order": r["order"], "range": r["range"], "trained": squeeze(_packed(total[0][mine])), "deleted": squeeze(_packed(total[1][mine]) if r["with_deleted"] else b"\x01"), "n_distinct": int((total[0] > 0).sum()) if i == 0 else 0, "n_tokens": int(total[0].sum()) if i == 0 else 0, "n_deleted": int(total[1].sum()) if i == 0 else 0})
        fields = [("chunk", pa.int32()), ("order", pa.int32()), ("range", pa.int32()), ("trained", pa.binary()), ("deleted", pa.binary()), ("n_distinct", pa.int64()), ("n_tokens", pa.int64()), ("n_deleted", pa.int64())]
        return pa.Table.from_pylist(out, pa.schema(fields))

    return asked.groupBy("range", "order").applyInArrow(answer, "chunk int, order int, range int, trained binary, deleted binary, n_distinct bigint, n_tokens bigint, n_deleted bigint")


@dataclass(frozen=True)
class Mixture:
    """Weights (buckets x bigram, unigram, uniform) with the totals they are used with."""

    weights: np.ndarray
    n_tokens: int
    n_distinct: int

    def log10(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        w = self.weights[buckets(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(self.n_tokens, 1) + w[:, 2] / (self.n_distinct + 1)
        return np.log10(p)


def buckets(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole part of log2 of its frequency."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _counts(words: np.ndarray, pairs: np.ndarray, kind: np.ndarray, answer: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts of each token and each bigram of a chunk."""
    found, expand = [], zstandard.ZstdDecompressor().decompress
    rows = sorted(zip(answer.column("order").to_pylist(), answer.column("range").to_pylist(), answer.column(column).to_pylist(), strict=True))
    for order, keys in ((1, words), (2, pairs)):
        key, _, _ = distinct(keys, kind)
        count = np.concatenate([_unpacked(expand(data)) for o, _, data in rows if o == order])
        if len(count) != len(key):
            raise RuntimeError("an answer does not fit its chunk")
        found.append(count[np.searchsorted(key, keys)].astype(np.int64))
    return found[0], found[1]


def _histogram(dealt: DataFrame, answered: DataFrame, n_tokens: int) -> DataFrame:
    """``cell, n``: deleted tokens by bucket and quantised bigram and unigram probability under the other documents' counts."""
    side = 1 + RANGE * STEPS

    def level(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, 1 + np.clip(np.rint(-STEPS * np.log2(np.maximum(p, 1e-300))), 0, side - 2), 0).astype(np.int64)

    def count(texts: pa.Table, answer: pa.Table) -> pa.Table:
        empty = pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not texts.num_rows:
            return empty
        words, pairs, _, kind = _chunk_keys(texts)
        word, pair = _counts(words, pairs, kind, answer, "trained")
        word_d, pair_d = _counts(words, pairs, kind, answer, "deleted")
        word, pair = word - word_d, pair - pair_d
        # the first context is an end; its frequency is that of the chunk's own last token, an end
        context = np.concatenate([word[-1:], word[:-1]])
        cell = (buckets(context) * side + level(pair / np.maximum(context, 1))) * side + level(word / max(n_tokens, 1))
        value, n = np.unique(cell, return_counts=True)
        return pa.table({"cell": pa.array(value, pa.int64()), "n": pa.array(n, pa.int64())})

    return dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def em_weights(cells: np.ndarray, n: np.ndarray, n_distinct: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Mixture weights of each bucket from the histogram; one pseudo-token a part keeps all parts alive."""
    side = 1 + RANGE * STEPS
    bucket, pair, word = cells // side // side, cells // side % side, cells % side
    value = lambda x: np.where(x > 0, 2.0 ** (-(x - 1) / STEPS), 0.0)
    part = np.stack([value(pair), value(word), np.full(len(cells), 1 / (n_distinct + 1))], 1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        share = weights[bucket] * part
        share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
        grown = np.stack([np.bincount(bucket, n * share[:, k], BUCKETS) for k in range(3)], 1) + 1
        grown[0, 0] = 0  # an unseen context has no bigrams
        weights = grown / grown.sum(1, keepdims=True)
    return weights


def _scored(dealt: DataFrame, answered: DataFrame, model: Mixture, doc_kind: str) -> DataFrame:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    id_type = kinds.get(doc_kind, pa.string())

    def score(texts: pa.Table, answer: pa.Table) -> pa.Table:
        fields = [("doc_id", id_type), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
        if not texts.num_rows:
            return pa.schema(fields).empty_table()
        words, pairs, counts, kind = _chunk_keys(texts)
        word, pair = _counts(words, pairs, kind, answer, "trained")
        context = np.concatenate([word[-1:], word[:-1]])
        first = np.cumsum(counts) - counts
        base = np.log10((word + 1) / (model.n_tokens + model.n_distinct + 1))
        columns = [counts, np.add.reduceat((word > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(model.log10(pair, context, word), first)]
        return pa.table([texts.column("ids").combine_chunks().flatten().cast(id_type), *[pa.array(c) for c in columns]], schema=pa.schema(fields))

    kind = doc_kind if doc_kind in kinds else "string"
    return dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(score, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")


def chunks_for(size: int, partitions: int) -> int:
    """How many chunks texts of ``size`` bytes are dealt to: twice the partitions at least, and as many as keep a chunk small."""
    return max(2 * partitions, -(-size // max(CHUNK_BYTES, math.isqrt(REQUEST_BYTES * size))))


def lm_scores(docs: DataFrame, *, modulus: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Documents whose crc32(id) mod ``modulus`` is ``held_out`` are not learned
    from; those of the next residue are the deleted ones.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(column(text_col))), F.lit(0))).first()[0]
    chunks = chunks_for(size, shuffle_partitions(docs.sparkSession))
    ranges = -(-chunks // 2)
    dealt = _dealt(docs, chunks, modulus, held_out, id_col, text_col)
    asked = requests(dealt, ranges).withColumn("with_deleted", F.col("chunk") >= chunks)
    answered = checkpointed(answers(asked))
    total = answered.where("order = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_distinct", "n_tokens", "n_deleted")]).first()
    n_distinct, n_tokens, n_deleted = total
    deleted = _dealt(docs.where(crc_mod(id_col, modulus) == (held_out + 1) % modulus), chunks, modulus, held_out, id_col, text_col)
    cells = _histogram(deleted, answered.where(F.col("chunk") >= chunks), n_tokens - n_deleted).collect()
    weights = em_weights(np.array([r["cell"] for r in cells], np.int64), np.array([r["n"] for r in cells], np.float64), n_distinct)
    kind = docs.schema[id_col].dataType.simpleString()
    scored = _scored(dealt, answered.select("chunk", "order", "range", "trained"), Mixture(weights, n_tokens, n_distinct), kind)
    doc_id = F.col("doc_id").cast(kind)
    return scored.select(doc_id.alias("doc_id"), (crc_mod("doc_id", modulus) == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
