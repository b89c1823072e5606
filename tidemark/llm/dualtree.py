"""Centroid clustering: Lloyd's rounds by two trees.

Vectors are integers ``floor(1024 x)``, so that sums, means and squared
distances are exact.  A task puts the vectors it reads into blocks of at most
``BLOCK`` and builds a cover tree over each, once; the trees are written to the
shared folder.  A round builds a cover tree over the centroids, sends it to the
tasks (its size is the number of centroids, a parameter) and walks both trees
together: a pair of nodes goes when its centroids are farther from every vector
of the one node than some centroid certainly is, ``d(q, c) - r(q) - r(c) >
min d(q, c') + r(q)``.  A node left with one centroid takes it whole; vectors of
leaves are compared exactly, ties to the smaller number.  Bounds are floating
point with some slack, so they only ever keep a pair too many.

Cover tree.  A node of scale R holds vectors within R of its centre; its
children are of scale R/2, the centre is one of theirs (nesting), every vector
is within R/2 of its child's centre (covering) and children's centres are more
than R/2 apart (separation).  Up to ``LEAF`` vectors are a leaf.

Scale.  Each round reads the blocks once and sends one sum a centroid and task
(added up by Spark); the driver sees ``clusters`` x components numbers.  Blocks
are of bounded size, equal vectors end in one leaf chain of them.

Rows: vectors that are NULL, of another length, or hold a NULL, NaN or infinite
component are left out, and so are those with a component of 131,072 or more in
size, whose squared distances would not fit a long.  Repeated rows and ids are
vectors of their own; a NULL id never gives a first centroid but its vector is
clustered; equal hashes of repeated ids are ordered by components.  With fewer
vectors than clusters there are as many centroids as vectors with an id; with
none the result is empty, as for an empty table.  Centroids without vectors stay
where they are.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, column

CLUSTERS, ROUNDS, SIZE = 8, 10, 64
SCALE, LARGEST = 1024, 131_072
BLOCK, LEAF = 2048, 8
#: Relative slack of the bounds; distances are good to about 1e-14.
SLACK = 1e-9


@dataclass
class CoverTree:
    """Nodes in order of breadth; ``vectors`` are ordered so that a node's are those from ``low`` to ``high``."""

    vectors: np.ndarray
    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, vectors: np.ndarray, leaf: int = LEAF) -> CoverTree:
        points = vectors.astype(np.float64)
        # (vectors, centre); children are queued right after each other, so a node's are a range
        queue, at = [(np.arange(len(points)), 0)], 0
        radius, first, last = [], [], []
        while at < len(queue):
            members, centre = queue[at]
            d = np.sqrt(((points[members] - points[centre]) ** 2).sum(1))
            widest = float(d.max())
            radius.append(widest)
            first.append(len(queue))
            if len(members) > leaf and widest:
                half = 2.0 ** np.ceil(np.log2(widest)) / 2
                while half >= widest:  # rounding of the logarithm
                    half /= 2
                queue.append((members[d <= half], centre))
                rest = members[d > half]
                while len(rest):
                    near = ((points[rest] - points[rest[0]]) ** 2).sum(1) <= half * half
                    queue.append((rest[near], int(rest[0])))
                    rest = rest[~near]
            last.append(len(queue))
            at += 1
        low, high, order = np.zeros(len(queue), np.int64), np.zeros(len(queue), np.int64), np.zeros(len(points), np.int64)
        high[0] = len(points)
        for i, (members, _) in enumerate(queue):
            begin = low[i]
            if first[i] == last[i]:
                order[begin : high[i]] = members
            for k in range(first[i], last[i]):
                low[k], high[k] = begin, begin + len(queue[k][0])
                begin = high[k]
        place = np.empty(len(points), np.int64)
        place[order] = np.arange(len(points))
        return cls(vectors[order], order, place[[c for _, c in queue]], np.array(radius), np.array(first), np.array(last), low, high)


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number) of every number of some ranges."""
    size = last - first
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + first[which]


def assign(tree: CoverTree, centroids: CoverTree) -> tuple[np.ndarray, int]:
    """The nearest centroid of each vector (in the tree's order, by the centroid's own number), and how many distances were taken."""
    label, taken = np.full(len(tree.vectors), -1, np.int64), 0
    points, centres = tree.vectors.astype(np.float64), centroids.vectors.astype(np.float64)
    inner = centroids.last > centroids.first
    q, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(q):
        d = np.sqrt(((points[tree.centre[q]] - centres[centroids.centre[c]]) ** 2).sum(1))
        taken += len(q)
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(q))))
        reach = np.minimum.reduceat(d + tree.radius[q], start)
        keep = d - tree.radius[q] - centroids.radius[c] <= reach[group] * (1 + SLACK) + SLACK
        q, c, group = q[keep], c[keep], group[keep]
        # the wider node of a pair is opened; a leaf of vectors leaves that to the centroids
        open_c = inner[c] & ((centroids.radius[c] >= tree.radius[q]) | (tree.last[q] == tree.first[q]))
        wait = np.zeros(len(start), bool)
        wait[group[open_c]] = True
        size = np.bincount(group, minlength=len(start))
        done = ~wait[group] & (size[group] == 1) & ~inner[c]
        bottom = ~wait[group] & ~done & (tree.last[q] == tree.first[q])
        for a, b, k in zip(tree.low[q[done]].tolist(), tree.high[q[done]].tolist(), centroids.order[centroids.low[c[done]]].tolist(), strict=True):
            label[a:b] = k
        if bottom.any():
            which, row = _ranges(tree.low[q[bottom]], tree.high[q[bottom]])
            number = centroids.order[centroids.low[c[bottom][which]]]
            squared = squares(tree.vectors[row], centroids.vectors[centroids.low[c[bottom][which]]])
            taken += len(row)
            best = np.lexsort((number, squared, row))
            one = best[np.concatenate([[True], row[best][1:] != row[best][:-1]])]
            label[row[one]] = number[one]
        stay, go = wait[group] & ~open_c, ~wait[group] & ~done & ~bottom
        k1, c1 = _ranges(centroids.first[c[open_c]], centroids.last[c[open_c]])
        k2, q2 = _ranges(tree.first[q[go]], tree.last[q[go]])
        q, c = np.concatenate([q[stay], q[open_c][k1], q2]), np.concatenate([c[stay], c1, c[go][k2]])
        by = np.argsort(q, kind="stable")
        q, c = q[by], c[by]
    return label, taken


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.int64) - b.astype(np.int64)) ** 2).sum(1)


_COLUMNS = {"vectors": np.int32, "centre": np.int64, "radius": np.float64, "first": np.int64, "last": np.int64, "low": np.int64, "high": np.int64}


def _planted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row a block: its ids and tree."""
    held: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        flat = table["v"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int32)
        tree = CoverTree.build(flat)
        ids = table["id"].chunk(0).take(pa.array(tree.order))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(ids)], ids), *[pa.array([np.ascontiguousarray(getattr(tree, k), t).tobytes()]) for k, t in _COLUMNS.items()]], names=["ids", *_COLUMNS])

    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, BLOCK - sum(b.num_rows for b in held))
            held.append(part)
            batch = batch.slice(part.num_rows)
            if sum(b.num_rows for b in held) == BLOCK:
                yield block()
                held = []
    if held:
        yield block()


def _trees(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, CoverTree]]:
    for i in range(batch.num_rows):
        part = {k: np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in _COLUMNS.items()}
        part["vectors"] = part["vectors"].reshape(-1, size)
        yield batch.column("ids")[i].values, CoverTree(order=np.zeros(0, np.int64), **part)


def _nearest(trees: DataFrame, centroids: np.ndarray, size: int) -> DataFrame:
    """``id, cluster, distance`` of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = CoverTree.build(centroids, 1)
        for batch in batches:
            for ids, tree in _trees(batch, size):
                label, _ = assign(tree, over)
                yield pa.RecordBatch.from_arrays([ids, pa.array(label.astype(np.int32)), pa.array(squares(tree.vectors, centroids[label]))], names=["id", "cluster", "distance"])

    kind = trees.schema["ids"].dataType.elementType.simpleString()
    return trees.mapInArrow(run, f"id {kind}, cluster int, distance bigint")


def _moved(trees: DataFrame, centroids: np.ndarray, size: int) -> np.ndarray:
    """One round: the floors of the means of what each centroid is nearest to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = CoverTree.build(centroids, 1)
        total = np.zeros((len(centroids), size + 1), object)
        for batch in batches:
            for _, tree in _trees(batch, size):
                label, _ = assign(tree, over)
                # whole numbers under 2**53: the product is exact
                mine = (label == np.arange(len(centroids))[:, None]).astype(np.float64)
                total += np.concatenate([mine @ tree.vectors, mine.sum(1)[:, None]], 1).astype(np.int64)
        k, i = np.divmod(np.arange(total.size), size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array([Decimal(x) for x in total.ravel().tolist()], pa.decimal128(38, 0))], names=["k", "i", "s"])

    found = trees.mapInArrow(run, "k int, i int, s decimal(38,0)").groupBy("k", "i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()
    sums = np.zeros((len(centroids), size + 1), object)
    for r in found:
        sums[r["k"], r["i"]] = int(r["s"])
    return np.array([[s // row[size] for s in row[:size]] if row[size] else old.tolist() for row, old in zip(sums, centroids, strict=True)], np.int64).reshape(centroids.shape)


def kept_vectors(vectors: DataFrame, size: int, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: the vectors that take part, as integers."""
    x = column(vector_col)
    fit = (F.size(x) == size) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST))
    return vectors.where(F.coalesce(fit, F.lit(False))).select(column(id_col).alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("int")).alias("v"))


def centroid_clusters(vectors: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part."""
    kept = kept_vectors(vectors, size, id_col, vector_col)
    first = kept.where("id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256), "v").select("v").limit(clusters).collect()
    trees = checkpointed(kept.mapInArrow(lambda b: _planted(b, size), f"ids array<{kept.schema['id'].dataType.simpleString()}>, {', '.join(f'{k} binary' for k in _COLUMNS)}"))
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, size)
    if not len(centroids):
        trees = trees.limit(0)
        centroids = np.zeros((1, size), np.int64)
    for _ in range(rounds if first else 0):
        moved = _moved(trees, centroids, size)
        if np.array_equal(moved, centroids):  # every later round would give the same
            break
        centroids = moved
    nearest = _nearest(trees, centroids, size)
    sums = {r["cluster"]: int(r["s"]) for r in nearest.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    # one entry a centroid
    of_cluster = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return nearest.select(
        F.col("id").alias("vec_id"), "cluster", "distance", of_cluster([sums.get(k, 0) for k in range(len(centroids))], "bigint").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
        of_cluster([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], "string").alias("centroid_sha256"),
    )


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> str:
    near = f"""SELECT r, any_value(id) AS id, min({{'d': d, 'k': k}}) AS near, any_value(v) AS v FROM (
    SELECT x.r, x.id, x.v, c.k, list_sum([(x.v[i] - c.v[i]) * (x.v[i] - c.v[i]) for i in range(1, {size + 1})])::BIGINT AS d FROM x CROSS JOIN c# c) GROUP BY r"""
    steps = [
        f"""a{n} AS MATERIALIZED ({near.replace("#", str(n))}),
m{n} AS MATERIALIZED (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM (
    SELECT near.k AS k, i, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT near, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY ALL) GROUP BY k),
c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m USING (k))"""
        for n in range(rounds)
    ]
    return f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id AS id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e) AND abs(e) < {LARGEST})) = {size}
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || id), v) - 1)::INT AS k, v FROM x WHERE id IS NOT NULL QUALIFY k < {clusters}
), {", ".join(steps)}, a AS MATERIALIZED ({near.replace("#", str(rounds))})
SELECT id AS vec_id, near.k AS cluster, near.d AS distance, (sum(near.d) OVER (PARTITION BY near.k))::BIGINT AS cluster_inertia, (sum(near.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a JOIN c{rounds} c ON c.k = a.near.k
"""
