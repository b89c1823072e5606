"""Benchmark decontamination by spaced-seed hashing.

A seed hashes the words at a mask's ones and ignores those at its zeros, so a
substituted word spoils only the seeds that read it.  Four masks of five words
are laid at every word of every text and of every benchmark item; where the
benchmark has items of up to ten words, four masks of four words are laid at
the words of these and of the texts besides, for the masks of five miss some
substitutions there.  Together they meet every allowed one.

1. Seed hashes of the benchmark set the bits of a bitmap of fixed size
   (``2**FILTER_BITS`` bits), the only thing that is broadcast.
2. One pass over the texts drops seeds whose bit is not set; what is left
   around them is cut out as segments, a few dozen word hashes each.
3. Segments' seeds are hash-joined with the benchmark's, giving (segment, item,
   shift) candidates; each is verified word by word on that shift.

An item leaks into a document if some window of ``WINDOW`` aligned words (the
whole item if it is shorter) has ``SIMILARITY`` of its words equal.  Items of
under five words cannot be told from chance and are never reported.

Rows: NULL and short texts match nothing; NULL ids are reported as NULL;
repeated rows give one finding a (document id, item); an item id with several
texts leaks with any of them; an empty documents or benchmark table gives an
empty result; items without text match nothing.  Only id and
text are read; ``drop_leaks`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, column, hand_back, mix, slices, unused, utf8, word_hashes

MASKS = ("11111", "111101", "1101101", "10101011")
LIGHT_MASKS, LIGHT_WORDS = ("1111", "11011", "10111", "11101"), 10
WINDOW, SIMILARITY = 13, 0.8
FILTER_BITS = 24
#: Up to so many contaminated rows their keys (8 bytes each) are broadcast; beyond, the join is shuffled.
BROADCAST_KEYS = 500_000


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash at each word where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, int(mask, 2), np.uint64)
    with np.errstate(over="ignore"):
        for i, c in enumerate(mask):
            if c == "1":
                h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(h)


def item_words(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, item_id, words`` (their hashes) of the items that are long enough; ``item`` tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for i, j in slices(texts):
                h, _, _, bounds = word_hashes(texts[i:j])
                keep = [k for k in range(j - i) if bounds[k + 1] - bounds[k] >= 5]
                words = pa.array([h[bounds[k] : bounds[k + 1]].view(np.int64) for k in keep], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i + k for k in keep], pa.int64())), words], names=["item_id", "words"])

    kind = benchmark.schema[id_col].dataType.simpleString()
    found = benchmark.select(id_col, text_col).mapInArrow(run, f"item_id {kind}, words array<bigint>")
    return found.select(F.xxhash64(F.col("item_id").isNull(), "item_id", "words").alias("item"), "item_id", "words").dropDuplicates(["item"])


def item_seeds(items: DataFrame) -> DataFrame:
    """``hash, item, at``: every seed of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words in enumerate(batch.column(1)):
                w = words.values.to_numpy().view(np.uint64)
                h = [seeds(w, m) for m in (MASKS + LIGHT_MASKS if len(w) <= LIGHT_WORDS else MASKS)]
                at = np.concatenate([np.arange(len(x)) for x in h]).astype(np.int32)
                item = batch.column(0).take(pa.array(np.full(len(at), i)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), item, pa.array(at)], names=["hash", "item", "at"])

    return items.select("item", "words").mapInArrow(run, "hash bigint, item bigint, at int").distinct()


def seed_filter(found: DataFrame) -> np.ndarray:
    """A bit for each value of the seeds' top ``FILTER_BITS`` bits; at most 2**FILTER_BITS / 8 bytes reach the driver."""
    slot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    rows = found.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    bits = np.zeros((1 << FILTER_BITS) + 8 * 4096, bool)
    for r in rows:
        # bucket n > 0 holds slots (n - 1) * 32768 + 1 onwards, bucket 0 the slot 0
        part = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        start = (r["bucket"] - 1) * 32768 + 1 if r["bucket"] > 0 else 0
        bits[start : start + len(part)] |= part.astype(bool)
    return bits


def segments(docs: DataFrame, known: np.ndarray, key: Column, masks: tuple[str, ...] = MASKS, *, id_col: str, text_col: str) -> DataFrame:
    """``key, doc_id, start, words, hashes, offsets``: stretches of word hashes around seeds whose bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(known, bitorder="little"))
    longest = max(map(len, masks))
    chosen = docs.select(key.alias("key"), column(id_col).alias("doc_id"), column(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        top = np.uint64(64 - FILTER_BITS)
        for batch in batches:
            texts = utf8(batch.column(2))
            rows: list[int] = []
            starts: list[int] = []
            words: list[np.ndarray] = []
            hashes: list[np.ndarray] = []
            offsets: list[np.ndarray] = []
            for i, j in slices(texts):
                w, _, _, bounds = word_hashes(texts[i:j])
                at, found = [], []
                for m in masks:
                    h = seeds(w, m)
                    slot = h >> top
                    hit = np.flatnonzero(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    at.append(hit)
                    found.append(h[hit])
                at, found = np.concatenate(at), np.concatenate(found)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, found = at[order], found[order]
                doc = np.searchsorted(bounds, at, side="right") - 1
                cut = np.flatnonzero((np.diff(at) > 2 * WINDOW) | (np.diff(doc) > 0)) + 1
                for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]), strict=True):
                    d = doc[a]
                    low, high = max(bounds[d], at[a] - WINDOW), min(bounds[d + 1], at[b - 1] + longest + WINDOW)
                    rows.append(i + int(d))
                    starts.append(int(low - bounds[d]))
                    words.append(w[low:high].view(np.int64))
                    hashes.append(found[a:b].view(np.int64))
                    offsets.append((at[a:b] - low).astype(np.int32))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(starts, pa.int32()), pa.array(words, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64())), pa.array(offsets, pa.list_(pa.int32()))],
                names=["key", "doc_id", "start", "words", "hashes", "offsets"],
            )
        hand_back()

    return chosen.mapInArrow(run, f"key bigint, doc_id {docs.schema[id_col].dataType.simpleString()}, start int, words array<bigint>, hashes array<bigint>, offsets array<int>")


def best_window(words: np.ndarray, item: np.ndarray, shift: int, window: int = WINDOW, similarity: float = SIMILARITY) -> tuple[int, int, int] | None:
    """(first word, words, equal words) of the longest similar stretch of the alignment item[i] ~ words[i + shift], or None.

    Stretches are unions of windows that each reach the similarity.
    """
    low, high = max(0, -shift), min(len(item), len(words) - shift)
    window = min(window, len(item))
    if high - low < window:
        return None
    same = (item[low:high] == words[low + shift : high + shift]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(total[window:] - total[:-window] >= similarity * window - 1e-9)
    if not len(good):
        return None
    breaks = np.flatnonzero(np.diff(good) > window) + 1
    runs = [(int(g[0]), int(g[-1]) + window) for g in np.split(good, breaks)]
    a, b = max(runs, key=lambda r: (r[1] - r[0], -r[0]))
    return low + shift + a, b - a, int(total[b] - total[a])


def _verified(candidates: DataFrame, doc_kind: str, item_kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            rows, out = [], []
            for i in range(batch.num_rows):
                got = best_window(c["words"][i].values.to_numpy(), c["item_words"][i].values.to_numpy(), c["shift"][i].as_py())
                if got:
                    rows.append(i)
                    out.append(got)
            take = pa.array(rows, pa.int64())
            first = np.array([x[0] for x in out], np.int64) + np.array(c["start"].take(take).to_pylist(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [c["key"].take(take), c["doc_id"].take(take), c["item_id"].take(take), pa.array(first), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())],
                names=["key", "doc_id", "item_id", "first_word", "n_words", "n_equal"],
            )

    return candidates.mapInArrow(run, f"key bigint, doc_id {doc_kind}, item_id {item_kind}, first_word bigint, n_words bigint, n_equal bigint")


def leaks_by_row(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, doc_id, item_id, first_word, n_words, n_equal``; key is a hash of the row's id and text."""
    items = checkpointed(item_words(benchmark))
    known = checkpointed(item_seeds(items))
    key = F.xxhash64(column(id_col), column(text_col))
    short = items.where(F.size("words") <= LIGHT_WORDS).limit(1).count() > 0
    found = segments(docs, seed_filter(known), key, MASKS + LIGHT_MASKS if short else MASKS, id_col=id_col, text_col=text_col)
    found = checkpointed(found.withColumn("segment", F.xxhash64("key", "start")))
    hits = found.select("segment", F.explode(F.arrays_zip("hashes", "offsets")).alias("h")).select("segment", F.col("h.hashes").alias("hash"), F.col("h.offsets").alias("offset"))
    candidates = hits.join(known, "hash").select("segment", "item", (F.col("offset") - F.col("at")).alias("shift")).distinct()
    once = found.drop("hashes", "offsets").dropDuplicates(["segment"])
    full = candidates.join(once, "segment").join(items.withColumnRenamed("words", "item_words"), "item")
    full = full.select("key", "doc_id", "start", "words", "item_id", "item_words", "shift")
    return _verified(full, docs.schema[id_col].dataType.simpleString(), items.schema["item_id"].dataType.simpleString())


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a leaked (document, item): ``doc_id, item_id, first_word, n_words, n_equal, similarity`` of its longest stretch."""
    best = F.max_by(F.struct("first_word", "n_words", "n_equal"), F.struct(F.col("n_words"), F.col("n_equal"), -F.col("first_word"))).alias("b")
    return leaks_by_row(docs, benchmark).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*", (F.col("b.n_equal") / F.col("b.n_words")).alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows into which a benchmark item leaked; all other rows and all columns stay."""
    (leak,) = unused(docs.columns, "_leak")
    bad = checkpointed(leaks_by_row(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("key").alias(leak)).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad
    return docs.join(bad, F.xxhash64(column(id_col), column(text_col)) == F.col(leak), "left_anti")
