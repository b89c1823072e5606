"""Best-fit packing under conflicts.

Documents are packed into bins of ``CAPACITY`` words.  A bin carries a bitmap
of sources (``PER_SOURCE`` bits each: that many documents of a source at most)
and one of duplicate clusters (one bit: no two of a cluster).  Bins are ordered
by what is left in them; the successor search starts at the least residual that
holds a document and goes on, bin by bin, residual by residual, until it meets
the tightest compatible bin; if there is none a bin is opened.  Longest first.

Documents over the capacity are cut into full pieces, each a bin of its own,
and a rest that is packed like a document.

Documents are dealt to shards of about ``SHARD`` by a hash of what is packed (id,
source, length, fingerprint, and a count among rows equal in all of these), each
packed by itself, so a hot source, a large cluster or a row repeated many times
spreads over all shards and no task sees more than a shard.  The result follows
from the rows alone, however they are partitioned.  Only ids, lengths, sources
and clusters are shuffled, never texts.

Rows: NULL and blank texts have length 0 and are packed like any other; a NULL
source is a source of its own; NULL and repeated ids are packed row by row;
equal rows are interchangeable; an empty table gives an empty result.  Only id,
text and source are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, per_text, slices, utf8
from tidemark.llm.simhash import fingerprints_of, groups

CAPACITY = 4096
PER_SOURCE = 4
SHARD = 1024


class Bins:
    """Open bins by residual; ``present`` has bit r set where a bin has r words left."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity, self.present = capacity, 0
        self.at: dict[int, list[int]] = {}
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, length: int, slots: list[int], cluster: int) -> tuple[int, int]:
        """Put a piece into the tightest compatible bin; ``slots`` are its source's bits.  Returns (bin, offset)."""
        residual = length
        while rest := self.present >> residual:
            residual += (rest & -rest).bit_length() - 1
            for i, b in enumerate(self.at[residual]):
                free = next((s for s in slots if not self.sources[b] & s), 0)
                if free and not self.clusters[b] & cluster:
                    del self.at[residual][i]
                    if not self.at[residual]:
                        self.present ^= 1 << residual
                    return self._put(b, residual, length, free, cluster)
            residual += 1
        self.sources.append(0)
        self.clusters.append(0)
        return self._put(len(self.sources) - 1, self.capacity, length, slots[0], cluster)

    def _put(self, b: int, residual: int, length: int, source: int, cluster: int) -> tuple[int, int]:
        self.sources[b] |= source
        self.clusters[b] |= cluster
        left = residual - length
        self.at.setdefault(left, []).append(b)
        self.present |= 1 << left
        return b, self.capacity - residual


def pack_shard(lengths: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int, int, int, int, int]]:
    """(row, piece, first word, words, bin, offset in the bin) of every piece; rows are taken longest first, then as they come."""
    bins, out, pieces = Bins(capacity), [], []
    source_no = {s: i for i, s in enumerate(dict.fromkeys(sources))}
    cluster_no = {c: i for i, c in enumerate(dict.fromkeys(clusters))}
    for row, n in enumerate(lengths):
        full, rest = divmod(n, capacity)
        pieces += [(capacity, row, p, p * capacity) for p in range(full)]
        if rest or not full:
            pieces.append((rest, row, full, full * capacity))
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    for n, row, piece, start in pieces:
        first = per_source * source_no[sources[row]]
        where, offset = bins.place(n, [1 << (first + k) for k in range(per_source)], 1 << cluster_no[clusters[row]])
        out.append((row, piece, start, n, where, offset))
    return out


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, n_words, fp`` (SimHash) of every row."""
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, source_col)]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = utf8(batch.column(1))
            fp = np.concatenate([fingerprints_of(texts[i:j]) for i, j in slices(texts, 1 << 19)])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(x.split()) for x in texts], pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "source", "n_words", "fp"])

        return work

    return per_text(docs, [id_col, text_col, source_col], make, f"doc_id {kinds[0]}, source {kinds[1]}, n_words bigint, fp bigint")


def packed(docs: DataFrame, *, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD) -> DataFrame:
    """One row a piece: ``doc_id, piece, first_word, n_words, bin_id, bin_offset, source, cluster``.

    ``cluster`` is the least fingerprint of the document's near-duplicate
    group; ``bin_id`` is ``shard number / bin number``.
    """
    rows = checkpointed(measured(docs))
    # equal rows are counted before the join, so that no fingerprint's rows are gathered in one task
    same = rows.groupBy("doc_id", "source", "n_words", "fp").agg(F.count("*").alias("copies"))
    counted = checkpointed(same.join(groups(rows.select("doc_id", "fp")).select("fp", F.col("root").alias("cluster")), "fp"))
    total = counted.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    numbered = each.select("doc_id", "source", "n_words", "fp", "cluster", F.pmod(F.xxhash64("doc_id", "source", "n_words", "fp", "copy"), F.lit(shards)).alias("shard"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), *((c, "ascending") for c in ("cluster", "doc_id", "source", "fp"))])
        got = pack_shard(*(table.column(c).to_pylist() for c in ("n_words", "source", "cluster")), capacity, per_source)
        row, piece, start, n, where, offset = (pa.array(x, pa.int64()) for x in (zip(*got, strict=True) if got else [[]] * 6))
        name = str(table.column("shard")[0].as_py())
        taken = table.take(row)
        return pa.table({"doc_id": taken["doc_id"], "piece": piece, "first_word": start, "n_words": n, "bin_id": pa.array([f"{name}/{b}" for b in where.to_pylist()], pa.string()), "bin_offset": offset, "source": taken["source"], "cluster": taken["cluster"]})

    kinds = dict(numbered.dtypes)
    return numbered.groupBy("shard").applyInArrow(pack, f"doc_id {kinds['doc_id']}, piece bigint, first_word bigint, n_words bigint, bin_id string, bin_offset bigint, source {kinds['source']}, cluster bigint")
