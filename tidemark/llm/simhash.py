"""SimHash near-duplicates with bit-sliced comparison.

Fingerprint: words are lower-cased (A-Z), shingles are four words with
repeats, hashed by XXH64 (seed 42); a bit is 1 if it is set in over half of
the hashes.  Fingerprints within ``RADIUS`` bits are linked; components of
links are the groups.

Candidates: equal fingerprints are one node.  A fingerprint is cut into blocks;
two within ``RADIUS`` bits agree on at least all but ``RADIUS`` of them, so
nodes meet in a bucket for each choice of that many blocks.  This loses no link
for any number of blocks; the more nodes there are, the more blocks are cut and
the longer the keys, so that chance buckets stay under ``CROWD`` nodes
(``blocks_for``).  A bucket of over ``TILE`` nodes is split into tiles and each
pair of tiles is a cell of its own, so no task gets an unbounded group, and no
bucket is capped.

Comparison: all cells of a task lie side by side as lanes; bit plane b holds
bit b of 64 lanes a word.  For an offset k, planes are XORed with themselves
moved by k lanes, the 64 results are summed by carry-save adders into counters
that stand vertically too, and a block of words is abandoned once all its lanes
exceed the radius.  A cell emits links to the least node of each local group
only, at most one a node.

Rows: NULL and blank texts have fingerprint zero and are linked like any other;
repeated rows give repeated results; a NULL id belongs to its group and is
never its smallest id (a group of NULL ids only has a NULL component); an empty
table gives an empty result.  Only the id and the text are read; in
``keep_one`` all columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import checkpointed, column, per_text, slices, unused, utf8

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Nodes that may share a bucket by chance.
CROWD = 256
#: Parts of a group in the exchanges by group.
SALTS = 64
#: Up to so many kept rows their keys (8 bytes each) are broadcast; beyond, the join is shuffled.
BROADCAST_KEYS = 500_000
#: Nodes of a bucket that are compared in one cell.
TILE = 2048


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        n = max(1, len(words) - shingle + 1)
        if n == 1:
            hashes.append(xxh64_intdigest(joined, SEED))
        else:
            ends, at = [], -1
            for w in words:
                at += len(w) + 1
                ends.append(at)
            starts = [0, *[e + 1 for e in ends[: n - 1]]]
            hashes.extend(map(xxh64_intdigest, map(joined.__getitem__, map(slice, starts, ends[shingle - 1 :])), repeat(SEED)))
        counts[i] = n
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = np.flatnonzero(counts)
    first = np.cumsum(counts)[some] - counts[some]
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    major = (2 * ones > counts[some, None]).astype(np.uint8)
    out[some] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed 64-bit number)."""
    return _fingerprints(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")))


def _fingerprints(rows: DataFrame) -> DataFrame:
    """``fp`` in the place of ``text``, the last column."""
    names = rows.columns[:-1]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = utf8(batch.column(len(names)))
            fp = np.concatenate([fingerprints_of(texts[i:j]) for i, j in slices(texts, 1 << 19)])
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], names=[*names, "fp"])

        return work

    return per_text(rows, rows.columns, make, ", ".join([*(f"{n} {k}" for n, k in rows.dtypes[:-1]), "fp bigint"]))


def _add(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save step: sum and carry of three planes."""
    u = s ^ x
    return u ^ y, (s & x) | (u & y)


def _over(planes: Iterator[np.ndarray], radius: int, done: np.ndarray) -> np.ndarray:
    """Lanes whose planes' sum exceeds ``radius`` (below 8); ``done`` lanes do not matter.  Stops when no lane is left."""
    over = done.copy()
    zero = np.zeros_like(done)
    ones, twos, fours = zero, zero, zero
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    group: list[np.ndarray] = []
    for x in planes:
        group.append(x)
        if len(group) < 8:
            continue
        ones, a = _add(ones, group[0], group[1])
        ones, b = _add(ones, group[2], group[3])
        twos, c = _add(twos, a, b)
        ones, a = _add(ones, group[4], group[5])
        ones, b = _add(ones, group[6], group[7])
        twos, d = _add(twos, a, b)
        fours, eights = _add(fours, c, d)
        over |= eights
        # counters are 4 fours + 2 twos + ones; beyond the radius is decided per lane
        over |= _exceeds(ones, twos, fours, radius)
        if (over == full).all():
            return over
        group = []
    return over


def _exceeds(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    found = np.zeros_like(ones)
    for value in range(radius + 1, 8):
        bits = [p if value >> i & 1 else ~p for i, p in enumerate((ones, twos, fours))]
        found |= bits[0] & bits[1] & bits[2]
    return found


def linked_groups(cells: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows (least, member) of the groups in which links within ``radius`` join the nodes of each cell; cells are sorted."""
    edge = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    size = np.diff(np.append(edge, len(cells)))
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 1]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = size[order]
    at = np.concatenate([np.arange(edge[o], edge[o] + size[o]) for o in order]) if len(order) < 1000 else np.repeat(edge[order] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    f = fps[at].view(np.uint64)
    n = len(f)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # lanes from this one to its cell's end
    ends = np.cumsum(sizes)
    words = -(-n // 64)
    planes = np.zeros((64, words + 1), np.uint64)
    for b in range(64):
        bit = np.zeros(64 * words, np.uint8)
        bit[:n] = (f >> np.uint64(b)) & np.uint64(1)
        planes[b, :words] = np.packbits(bit, bitorder="little").view(np.uint64)
    root = np.arange(n)
    k, longest = 1, int(sizes[0])
    while k < longest:
        reach = int(ends[np.searchsorted(-sizes, -k, side="left") - 1])  # lanes of cells with more than k nodes
        w = -(-reach // 64)
        offsets = range(k, min(longest, k + max(1, 512 // w)))
        k = offsets.stop
        valid = np.zeros((len(offsets), 64 * w), np.uint8)
        for row, o in enumerate(offsets):
            valid[row, : min(reach, 64 * w)] = left[:reach] > o
        done = ~np.packbits(valid, axis=1, bitorder="little").view(np.uint64)

        def differing(offsets=offsets, w=w):
            for b in range(64):
                p = planes[b]
                x = np.empty((len(offsets), w), np.uint64)
                for row, o in enumerate(offsets):
                    q, r = divmod(o, 64)
                    low, high = np.zeros(w, np.uint64), np.zeros(w, np.uint64)
                    a, c = p[q : q + w], p[q + 1 : q + 1 + w]
                    low[: len(a)], high[: len(c)] = a, c
                    x[row] = p[:w] ^ ((low >> np.uint64(r)) | (high << np.uint64(64 - r)) if r else low)
                yield x

        near = ~_over(differing(), radius, done)
        if not near.any():
            continue
        row, lane = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little"))
        other = lane + np.array(offsets)[row]
        apart = root[lane] != root[other]
        for i, j in zip(lane[apart].tolist(), other[apart].tolist(), strict=True):
            while root[i] != i:
                i = root[i]
            while root[j] != j:
                j = root[j]
            if i != j:
                root[max(i, j)] = min(i, j)
        while (root != root[root]).any():
            root = root[root]
    signed = fps[at]
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, root, signed)
    mine = least[root]
    member = signed != mine
    return mine[member], signed[member]


def block_widths(blocks: int) -> list[int]:
    base, more = divmod(64, blocks)
    return [base + (i < more) for i in range(blocks)]


def blocks_for(nodes: int, radius: int = RADIUS, crowd: int = CROWD) -> int:
    """The least number of blocks with which at most ``crowd`` of so many nodes share a key by chance."""
    blocks = radius + 2
    while blocks < 12 and nodes > crowd << sum(sorted(block_widths(blocks))[: blocks - radius]):
        blocks += 1
    return blocks


def links(nodes: DataFrame, *, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """Rows ``a < b`` of fingerprints that join all linked ``nodes`` (distinct, column fp); links, not all pairs."""
    blocks = blocks_for(nodes.count(), radius) if blocks is None else blocks
    agree = blocks - radius
    widths = block_widths(blocks)
    starts = [sum(widths[:i]) for i in range(blocks)]
    part = lambda i: F.shiftrightunsigned("fp", starts[i]).bitwiseAND(F.lit((1 << widths[i]) - 1))
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), agree)):
        key = F.lit(number).cast("bigint")
        for i in chosen:
            key = F.shiftleft(key, widths[i]).bitwiseOR(part(i))
        keys.append(key)
    met = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = met.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    tiles = F.coalesce("tiles", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    cells = met.join(large, "key", "left").select("fp", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    cells = cells.select("fp", F.when((F.col("own") == 0) & (F.col("other") == 0), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("cell"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit(rows: np.ndarray) -> pa.RecordBatch:
            a, b = linked_groups(rows[0], rows[1], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        size = 0
        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            size += batch.num_rows
            if size >= 1 << 16:
                rows = np.concatenate(held, axis=1)
                cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last cell may go on
                if cut:
                    yield emit(rows[:, :cut])
                held, size = [rows[:, cut:]], rows.shape[1] - cut
        if size:
            yield emit(np.concatenate(held, axis=1))

    dealt = cells.select("cell", "fp").repartition("cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(compare, "a bigint, b bigint").distinct()


def _with_least(edges: DataFrame) -> DataFrame:
    """``u, v, m``: each edge with the least v of its u; a u of many edges is exchanged in ``SALTS`` parts."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts")).select("u", "m", F.explode("salts").alias("salt"))
    return salted.join(least, ["u", "salt"]).select("u", "v", "m")


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """``node, root`` (the least node reachable) for every node of the edges ``a, b``.

    Alternating large-star and small-star steps; each round is written to the
    shared checkpoint folder and the number of rounds grows as the logarithm of
    the longest chain.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v").distinct()
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
        edges = checkpointed(_with_least(large).select(pairs.alias("e")).select("e.*").where("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(marked: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """``fp, root, component_id`` of every distinct fingerprint of ``marked`` (doc_id, fp).

    Least ids go from nodes to groups and back by (root, salt), so that a group
    of any size is exchanged in ``SALTS`` parts.
    """
    nodes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = components(links(nodes.select("fp"), radius=radius))
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
    rooted = checkpointed(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "doc_id", salt.alias("salt")))
    parts = rooted.groupBy("root", "salt").agg(F.min("doc_id").alias("doc_id"))
    least = parts.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.collect_list("salt").alias("salts")).select("root", "component_id", F.explode("salts").alias("salt"))
    return rooted.select("fp", "root", "salt").join(least, ["root", "salt"]).select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """One row a document: ``doc_id, fingerprint`` (16 hex digits) ``, component_id`` (least id reachable over links)."""
    marked = checkpointed(fingerprints(docs))
    named = marked.join(groups(marked, radius=radius), "fp")
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: of the rows of its smallest id the one of the least fingerprint, then of the least hash of id and text.

    Texts are fingerprinted once; the rows that stay are found again by that
    hash.  Rows equal in id and text are one row to it, and the first met stays.
    """
    key, kept_key = unused(docs.columns, "_key", "_kept_key")
    hashed = F.xxhash64(column(id_col), column(text_col))
    marked = checkpointed(_fingerprints(docs.select(hashed.alias("key"), column(id_col).alias("doc_id"), column(text_col).alias("text"))))
    grouped = groups(marked.select("doc_id", "fp"), radius=radius)
    own = marked.join(grouped, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    best = own.groupBy("root").agg(F.min(F.struct("fp", "key")).alias("best"), F.count("*").alias("rows"))
    kept = checkpointed(best.select(F.col("best.key").alias(kept_key), "rows").groupBy(kept_key).agg(F.sum("rows").alias("rows")))
    n, most = kept.agg(F.count("*"), F.max("rows")).first()
    kept = kept.select(kept_key)
    kept = F.broadcast(kept) if n <= BROADCAST_KEYS else kept
    chosen = docs.withColumn(key, hashed).join(kept, F.col(key) == F.col(kept_key), "left_semi")
    if n and most > 1:  # some group has several rows of its smallest id: they may be equal
        chosen = chosen.dropDuplicates([key])
    return chosen.drop(key)
