"""Source divergence audit with integer-dictionary encoding.

Every group (language, source) is compared with the other sources of its
language, and with the language as a whole, over the terms that enough of the
language's documents hold.  All arithmetic is in integers: a term's share is
``p = 1 + floor(10**9 (count + 2) / (N + 2 V))`` and two shares differ by
``floor((p - q)**2 / (p + q))``.

Encoding.  A task gives the terms of its texts integer ids (a search in the
sorted array of its distinct term hashes) and counts occurrences and documents
of each (group, id).  Terms are dealt to chunks by their hash.  A chunk of a
language sorts its kept terms as UTF-8 bytes; an id is a place in that array,
found by ``searchsorted``, and ``bincount`` makes one dense vector of counts a
group.  Ids therefore stand in UTF-8 order, and a stable sort by value breaks
ties between terms as asked; ties between chunks go by the term itself.

Scale.  Counts are added up in each task before they are shuffled, so a hot
source or a frequent term is one entry a task.  A chunk is held whole by one
worker; the number of chunks follows the bytes of the texts.  What meets in the
end are sums of chunks and the best ``top`` terms of a chunk.  Nothing is
collected or broadcast.

Rows: NULL text, language and source count as ''; repeated rows and ids count
as documents of their own (ids are not read); groups without any term take
part with counts of 0; a language of one source has no pairs; a language
without kept terms has pairs of value 0 and no terms; texts and terms of any
length are read whole; an empty table gives an empty result.  Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import NO_LETTER, checkpointed, column, slices, utf8, word_hashes

MIN_DOCS, TOP = 10, 10
#: Bytes of text for each chunk of terms.
CHUNK_BYTES = 32 << 20
#: Entries a task gathers before it hands them on.
GATHERED = 1_000_000
#: Longer terms are looked up as objects, for an array of fixed width holds the others.
WIDTH = 48


def share(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10**9 (count + 2) / (total + 2 kept)), three digits at a time so that no product leaves 64 bits."""
    below = np.int64(total + 2 * kept)
    rest, out = count.astype(np.int64) + 2, np.zeros(len(count), np.int64)
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + whole
    return 1 + out


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Counts:
    """Occurrences and documents of each (group, term) met by a task."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, texts: list[bytes], keys: list[tuple[str, str]]) -> None:
        group = np.array([self.groups.setdefault(k, len(self.groups)) for k in keys], np.int64)
        for i, j in slices(texts):
            h, starts, ends, bounds = word_hashes(texts[i:j], NO_LETTER)
            if not len(h):
                continue
            joined = (b"\n".join(texts[i:j]) + b"\n").lower()
            # ids: places in the sorted array of distinct hashes
            known, first = np.unique(h, return_index=True)
            ids = np.searchsorted(known, h)
            doc = np.repeat(np.arange(j - i), np.diff(bounds))
            per_doc, n = np.unique(doc * len(known) + ids, return_counts=True)
            cell = group[i:j][per_doc // len(known)] * len(known) + per_doc % len(known)
            cells, back = np.unique(cell, return_inverse=True)
            term = cells % len(known)
            spelled = {t: joined[starts[first[t]] : ends[first[t]]] for t in np.unique(term).tolist()}
            self.parts.append((cells // len(known), known[term], np.bincount(back, n).astype(np.int64), np.bincount(back).astype(np.int64), [spelled[t] for t in term.tolist()]))
            self.size += len(cells)

    def rows(self, chunks: int) -> Iterator[pa.RecordBatch]:
        """``lang, source, chunk, terms, n, docs``: one row a group and chunk, its terms in UTF-8 order."""
        if not self.parts:
            return
        group, h, n, docs = (np.concatenate([p[k] for p in self.parts]) for k in range(4))
        spelled = [t for p in self.parts for t in p[4]]
        order = np.lexsort((h, h % np.uint64(chunks), group))
        group, h, n, docs = group[order], h[order], n[order], docs[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (h[1:] != h[:-1])])
        first = np.flatnonzero(new)
        n, docs = np.add.reduceat(n, first), np.add.reduceat(docs, first)
        group, chunk, spelled = group[first], (h[first] % np.uint64(chunks)).astype(np.int64), [spelled[k] for k in order[first].tolist()]
        names = list(self.groups)
        edge = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]) | (chunk[1:] != chunk[:-1])) + 1, [len(group)]]).tolist()
        pack = zstandard.ZstdCompressor(level=1).compress
        out: dict[str, list] = {k: [] for k in ("lang", "source", "chunk", "terms", "n", "docs")}
        for a, b in zip(edge, edge[1:], strict=False):
            place = sorted(range(a, b), key=spelled.__getitem__)
            lang, source = names[group[a]]
            for k, v in (("lang", lang), ("source", source), ("chunk", int(chunk[a])), ("terms", pack(b"\n".join(spelled[i] for i in place))), ("n", pack(n[place].tobytes())), ("docs", pack(docs[place].tobytes()))):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out)
        self.__init__()


def _counted(docs: DataFrame, chunks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            counts.add(utf8(batch.column(2)), list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
            if counts.size >= GATHERED:
                yield from counts.rows(chunks)
        yield from counts.rows(chunks)

    return docs.mapInArrow(run, "lang string, source string, chunk bigint, terms binary, n binary, docs binary")


def dictionary(terms: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Sorted distinct terms and the place of each given one among them."""
    size = np.fromiter(map(len, terms), np.int64, len(terms))
    short = np.flatnonzero(size <= WIDTH)
    fixed = np.array([terms[i] for i in short.tolist()], f"S{WIDTH}")  # a term holds no zero byte
    known = np.unique(fixed)
    place = np.empty(len(terms), np.int64)
    place[short] = np.searchsorted(known, fixed)
    rest = np.flatnonzero(size > WIDTH).tolist()
    if not rest:
        return known.tolist(), place
    more = sorted({terms[i] for i in rest})
    both = known.tolist() + more
    rank = np.empty(len(both), np.int64)
    order = sorted(range(len(both)), key=both.__getitem__)
    rank[order] = np.arange(len(both))
    at = {t: len(known) + i for i, t in enumerate(more)}
    place[rest] = [at[terms[i]] for i in rest]
    return [both[i] for i in order], rank[place]


def _dense(key: tuple, table: pa.Table, min_docs: int) -> pa.Table:
    """The kept terms of one chunk of a language with a dense vector of counts for each of its sources."""
    unpack = zstandard.ZstdDecompressor().decompress
    lists = [unpack(x).split(b"\n") for x in table["terms"].to_pylist()]
    n, docs = (np.concatenate([np.frombuffer(unpack(x), np.int64) for x in table[c].to_pylist()]) for c in ("n", "docs"))
    names = table["source"].to_pylist()
    sources = sorted(set(names))
    row = {s: i for i, s in enumerate(sources)}
    group = np.repeat([row[s] for s in names], [len(x) for x in lists])
    terms, place = dictionary([t for x in lists for t in x])
    kept = np.flatnonzero(np.bincount(place, docs, len(terms)) >= min_docs)
    ids = np.minimum(np.searchsorted(kept, place), max(0, len(kept) - 1))
    held = kept[ids] == place if len(kept) else np.zeros(len(place), bool)
    # sums of integers under 2**53 are exact as doubles
    counts = np.bincount(group[held] * len(kept) + ids[held], n[held], len(sources) * len(kept)).astype(np.int64).reshape(len(sources), len(kept))
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.table({
        "lang": [key[0].as_py()], "chunk": [key[1].as_py()], "sources": [sources], "n_terms": [len(kept)], "sums": [counts.sum(1).tolist()],
        "terms": [pack(b"\n".join(terms[i] for i in kept.tolist()))], "counts": [pack(counts.tobytes())],
    })


def _compared(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk: the sum of gaps of every ordered pair of sources, and each group's best terms."""
    unpack = zstandard.ZstdDecompressor().decompress
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    for batch in batches:
        for r in batch.to_pylist():
            every, totals, kept = [g["source"] for g in r["groups"]], [g["total"] for g in r["groups"]], r["kept"]
            v = r["n_terms"] or 0
            counts = np.zeros((len(every), v), np.int64)
            terms: list[bytes] = []
            if v:
                place = {s: i for i, s in enumerate(every)}
                counts[[place[s] for s in r["sources"]]] = np.frombuffer(unpack(r["counts"]), np.int64).reshape(-1, v)
                terms = unpack(r["terms"]).split(b"\n")
            p = [share(c, n, kept) for c, n in zip(counts, totals, strict=True)] if kept else [np.zeros(0, np.int64)] * len(every)
            whole = share(counts.sum(0), sum(totals), kept) if kept else np.zeros(0, np.int64)
            out = []
            for i, s in enumerate(every):
                for j in range(i):
                    value = int(gap(p[i], p[j]).sum())
                    out += [(s, "pair", every[j], value), (every[j], "pair", s, value)]
                found = np.flatnonzero((counts[i] > 0) & (p[i] > whole))
                value = gap(p[i][found], whole[found])
                out += [(s, "term", terms[found[k]].decode(), int(value[k])) for k in np.argsort(-value, kind="stable")[:top].tolist()]
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(out), pa.string()), *[pa.array(c, kinds.field(k + 1).type) for k, c in enumerate(columns)]], schema=kinds)


def chunks_for(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    return max(4, math.ceil((size or 0) / CHUNK_BYTES))


def source_divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: each other source of the language and the divergence from it;
    part ``term``: the ``top`` terms that the group holds more of than its
    language, by their share of the divergence from it.
    """
    blank = [F.coalesce(column(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    docs = docs.select(*blank)
    chunks = chunks_for(docs)
    dense = checkpointed(
        _counted(docs, chunks).groupBy("lang", "chunk")
        .applyInArrow(lambda key, table: _dense(key, table, min_docs), "lang string, chunk bigint, sources array<string>, n_terms bigint, sums array<bigint>, terms binary, counts binary")
    )
    sums = dense.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("s")).groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.sums").alias("total"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("groups"))
    kept = dense.groupBy("lang").agg(F.sum("n_terms").alias("kept"))
    # a copy for every chunk, and one without terms, so that no language lies on one key
    spread = groups.join(kept, "lang", "left").select("lang", "groups", F.coalesce("kept", F.lit(0)).alias("kept"), F.explode(F.sequence(F.lit(-1), F.lit(chunks - 1).cast("bigint"))).alias("chunk"))
    found = spread.join(dense, ["lang", "chunk"], "left").select("lang", "groups", "kept", "sources", "n_terms", "terms", "counts").mapInArrow(lambda b: _compared(b, top), "lang string, source string, part string, item string, value bigint")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def oracle_sql(min_docs: int = MIN_DOCS, top: int = TOP) -> str:
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {min_docs}
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*)::BIGINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), v AS (
  SELECT lang, count(*)::BIGINT AS v FROM kept GROUP BY lang
), s AS (
  SELECT lang, source, sum(n)::BIGINT AS total FROM c GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * v.v) AS p
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
), l AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 2)) // (any_value(t.total) + 2 * any_value(v.v)) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total)::BIGINT AS total FROM s GROUP BY lang) t USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT i.lang, i.source, j.source AS other, sum(((i.p - j.p) * (i.p - j.p)) // (i.p + j.p)) AS value FROM p i JOIN p j ON i.lang = j.lang AND i.term = j.term AND i.source <> j.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.other = b.source
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - l.q) * (p.p - l.q)) // (p.p + l.q))::BIGINT AS value
  FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > l.q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}
"""
