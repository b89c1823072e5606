"""Personal data and the terms that give it away.

Entities are e-mail addresses, IPv4 addresses, payment cards and telephone
numbers, found by their patterns.  A term discloses an entity by how much the
corpus says about the one to a reader of the other (pointwise mutual
information): of ``N`` terms in all texts, ``near(c)`` stand within ``REACH``
terms of entity c, term t stands there ``n(t, c)`` of ``n(t)`` times, and t
discloses c if

    log2((n(t, c) / n(t)) / (near(c) / N))  >=  ALPHA log2(N / near(c)),

that is, if t tells at least the share ALPHA of what naming c tells.  Chance
and copies are no evidence: the terms right before t where it stands near c must
be worth ``WITNESSES`` different ones, ``n(t, c)**2 / sum(n(t, c, before)**2)``,
and so must those right after it.  A passage that was copied any number of times
is one witness, at its ends as well.

A disclosing term is generalised, digits to ``#`` or else its first half and
``*``, if the general form (counted over all terms that have it) does not
disclose the same entity as well; otherwise it is removed.  That holds in all
documents, also in those that do not hold the entity.

Scale.  One pass over the texts finds entities and counts their neighbourhoods
in each task; one counts the candidate terms, told by a bitmap of fixed size;
one finds the disclosing terms, by a bitmap again and a join by the term itself.
What is shuffled are neighbourhoods and hits, never texts (``sanitised_documents``
joins spans to texts by id and a hash of the text).  Frequent terms, entities
and copies are added up in the tasks first.

Rows: NULL text counts as empty; NULL ids pass through and keep their spans;
repeated rows give repeated results; an empty table gives an empty result; texts
are read whole whatever their length.  Spans are code points; terms inside
entities are no terms (but count in ``n(t)``).  Only id and text are read, in
``sanitised_documents`` all columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ALNUM, checkpointed, column, mix, over_rows, per_text, slices, unused, utf8, word_hashes
from tidemark.llm.decontaminate import FILTER_BITS, seed_filter

# The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

REACH, ALPHA, WITNESSES = 8, 0.8, 3
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
REMOVED = "[REMOVED]"
_DIGIT = np.array([chr(b).isdigit() and b < 128 for b in range(256)])
_WIDE = np.uint64(0x6A09E667F3BCC909)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each sign @ is reached once, so long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the entities, by kind and start; leftmost and non-overlapping in each kind."""
    found = [(0, s, e) for s, e in _emails(text)]
    if "." in text:
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 or not p[:-3].strip("0") for p in m.group().split(".")) and all(int(p[-3:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return found


def entity(kind: int, value: str) -> str:
    """The same for all spellings of one entity."""
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else ''.join(c for c in value if '0' <= c <= '9')}"


def general(term: str) -> str:
    """What a term is generalised to."""
    if any("0" <= c <= "9" for c in term):
        return re.sub("[0-9]", "#", term)
    b = term.encode()
    mid = (len(b) + 1) // 2
    while mid < len(b) and b[mid] & 0xC0 == 0x80:
        mid += 1
    return b[:mid].decode() + "*"


def neighbours(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, str, str, bool]]:
    """(entity, term, the term beside it, is that before it?) of every term within ``REACH`` terms of an entity."""
    low = text.encode().lower().decode()
    inside = sorted((s, e) for _, s, e in spans)
    terms, k, reach = [], 0, -1
    for m in _TERM.finditer(low):
        while k < len(inside) and inside[k][0] < m.end():
            reach = max(reach, inside[k][1])
            k += 1
        if m.start() >= reach:
            terms.append((m.start(), m.group()))
    starts = [s for s, _ in terms]
    met = set()
    for kind, start, end in spans:
        name, at = entity(kind, text[start:end]), bisect_left(starts, start)
        for i in range(max(0, at - REACH), min(len(terms), at + REACH)):
            if (name, i) not in met:
                met.add((name, i))
                yield name, terms[i][1], terms[i - 1][1] if i else "", True
                yield name, terms[i][1], terms[i + 1][1] if i + 1 < len(terms) else "", False


class _Terms:
    """All terms of a few texts: hashes of themselves and of their general forms."""

    def __init__(self, texts: list[bytes]) -> None:
        self.hash, self.start, self.end, self.bounds = word_hashes(texts, NO_ALNUM)
        self.joined = (b"\n".join(texts) + b"\n").lower()
        self.bytes = np.frombuffer(self.joined, np.uint8)

    def wide(self) -> np.ndarray:
        a = self.bytes.copy()
        digits = np.concatenate([[0], np.cumsum(_DIGIT[a])])
        plain = digits[self.end] == digits[self.start]
        # the first half, up to the end of a character
        begins = np.where((a & 0xC0) != 0x80, np.arange(len(a)), len(a))
        begins = np.minimum.accumulate(begins[::-1])[::-1]
        mid = np.minimum(begins[np.minimum(self.start + (self.end - self.start + 1) // 2, len(a) - 1)], self.end)
        size = np.where(plain, self.end - mid, 0)
        cut = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(mid, size)
        a[_DIGIT[a]] = 0xFF  # a byte no text holds
        a[cut] = 10
        return mix(word_hashes([a.tobytes()], NO_ALNUM)[0] ^ _WIDE)

    def at(self, i: int) -> str:
        return self.joined[self.start[i] : self.end[i]].decode()


def _near(docs: DataFrame, text_col: str) -> DataFrame:
    """``entity, key, wide, general, hash, witness, before, n``, added up a batch; ``witness`` is a hash of the term beside the key."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            met: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text and (spans := base_spans(text)):
                    met.update(neighbours(text, spans))
            words = sorted({t for _, t, _, _ in met})
            digest = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big", signed=True) for x in {x for _, _, x, _ in met}}
            terms = _Terms([w.encode() for w in words])
            fine, wide = (dict(zip(words, h.view(np.int64).tolist(), strict=True)) for h in (terms.hash, terms.wide()))
            both = [(e, t, False, general(t), fine[t], digest[x], b, n) for (e, t, x, b), n in met.items()]
            both += [(e, g, True, g, wide[t], digest[x], b, n) for (e, t, x, b), n in met.items() if (g := general(t))]
            columns = list(zip(*both, strict=True)) if both else [[]] * 8
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["entity", "key", "wide", "general", "hash", "witness", "before", "n"])

        return work

    return per_text(docs, [column(text_col)], make, "entity string, key string, wide boolean, general string, hash bigint, witness bigint, before boolean, n bigint")


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - FILTER_BITS)
    return np.flatnonzero(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)


def _counted(docs: DataFrame, known: np.ndarray, text_col: str) -> DataFrame:
    """``key, wide, total`` of the keys whose bit is set; the row of key NULL has the number of all terms."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(known, bitorder="little"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            bits, texts, total = shared.value, utf8(batch.column(0)), 0
            met: Counter = Counter()
            for i, j in slices(texts):
                terms = _Terms(texts[i:j])
                total += len(terms.hash)
                for wide, h in ((False, terms.hash), (True, terms.wide())):
                    hit = _held(bits, h)
                    for k, n in zip(*(x.tolist() for x in np.unique(h[hit], return_index=True, return_counts=True)[1:]), strict=True):
                        word = terms.at(int(hit[k]))
                        met[general(word) if wide else word, wide] += n
            met[None, None] = total
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in met], pa.string()), pa.array([w for _, w in met], pa.bool_()), pa.array(list(met.values()), pa.int64())], names=["key", "wide", "total"])

        return work

    return per_text(docs, [column(text_col)], make, "key string, wide boolean, total bigint").groupBy("key", "wide").agg(F.sum("total").alias("total"))


def disclosing_terms(docs: DataFrame, *, text_col: str = "text", alpha: float = ALPHA, witnesses: int = WITNESSES) -> DataFrame:
    """``term, replacement, hash``: one row a term that discloses an entity."""
    names = ["entity", "key", "wide", "general", "hash"]
    seen = _near(docs, text_col).groupBy(*names, "witness", "before").agg(F.sum("n").alias("n"))
    n, side = F.col("n").cast("double"), lambda before: F.col("before") == F.lit(before)
    # one row a pair, and one an entity
    sums = seen.groupingSets([[F.col(c) for c in names], [F.col("entity")]], *names).agg(
        F.sum(F.when(side(True), F.col("n"))).alias("n"), F.sum(F.when(side(True), n * n)).alias("left"), F.sum(F.when(side(False), n * n)).alias("right"), F.sum(F.when(side(True) & ~F.col("wide"), F.col("n"))).alias("near"),
    )
    sums = checkpointed(sums.where(F.col("key").isNull() | (n * n >= witnesses * F.greatest("left", "right"))))
    pairs, entities = sums.where("key IS NOT NULL"), sums.where("key IS NULL").select("entity", F.col("near").alias("around"))
    counts = checkpointed(_counted(docs, seed_filter(pairs), text_col))
    everything = (counts.where("key IS NULL").agg(F.sum("total")).first()[0]) or 1
    tells = F.log2(F.col("n") / F.col("total") / (F.col("around") / F.lit(everything)))
    named = F.log2(F.lit(everything) / F.col("around"))
    scored = pairs.join(entities, "entity").join(counts.where("key IS NOT NULL"), ["key", "wide"]).where((named > 0) & (tells >= alpha * named))
    too_wide = scored.where("wide").select("entity", "general", F.lit(True).alias("removed"))
    found = scored.where("NOT wide").join(too_wide, ["entity", "general"], "left").groupBy("key").agg(F.max(F.coalesce("removed", F.lit(False))).alias("removed"), F.max("general").alias("general"), F.max("hash").alias("hash"))
    return found.select(F.col("key").alias("term"), F.when(F.col("removed"), REMOVED).otherwise(F.col("general")).alias("replacement"), "hash")


_SPANS = "array<struct<start:bigint,kind:string,end:bigint,replacement:string>>"


def _scanned(docs: DataFrame, known: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, key, base, hits``: entities, and terms whose bit is set; key is a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(known, bitorder="little"))
    item = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("replacement", pa.string())])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            bits, texts = shared.value, utf8(batch.column(2))
            base = [base_spans(x) if x else [] for x in batch.column(2).to_pylist()]
            hits: list[list[dict]] = [[] for _ in texts]
            for i, j in slices(texts) if bits.any() else ():
                terms = _Terms(texts[i:j])
                hit = _held(bits, terms.hash)
                if not len(hit):
                    continue
                chars = np.concatenate([[0], np.cumsum((terms.bytes & 0xC0) != 0x80)])
                first = np.cumsum([0, *[len(x) + 1 for x in texts[i:j]]])
                doc = np.searchsorted(terms.bounds, hit, side="right") - 1
                starts, ends = ((chars[x[hit]] - chars[first[doc]]).tolist() for x in (terms.start, terms.end))
                for d, s, e, k in zip(doc.tolist(), starts, ends, hit.tolist(), strict=True):
                    if not any(s < y and x < e for _, x, y in base[i + d]):
                        hits[i + d].append({"start": s, "kind": terms.at(k), "end": e, "replacement": None})
            shown = [[{"start": s, "kind": KINDS[k], "end": e, "replacement": MASKS[KINDS[k]]} for k, s, e in x] for x in base]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shown, pa.list_(item)), pa.array(hits, pa.list_(item))], names=["doc_id", "key", "base", "hits"])

        return work

    chosen = [column(id_col).alias("doc_id"), F.xxhash64(column(text_col)).alias("key"), column(text_col).alias("text")]
    return per_text(docs, chosen, make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, key bigint, base {_SPANS}, hits {_SPANS}")


def _findings(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, key, base, spans`` of every row."""
    scanned = checkpointed(_scanned(docs, seed_filter(terms), id_col, text_col))
    hits = scanned.where(F.size("hits") > 0).select("doc_id", "key", F.explode("hits").alias("h")).distinct().join(terms.drop("hash"), F.col("h.kind") == F.col("term"))
    found = hits.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.array_sort(F.collect_list(F.struct(F.col("h.start").alias("start"), F.lit(TERM).alias("kind"), F.col("h.end").alias("end"), "replacement"))).alias("more"))
    both = scanned.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return both.select("doc_id", "key", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")).alias("spans"))


def pii_findings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, witnesses: int = WITNESSES) -> DataFrame:
    """One row a document: ``doc_id, base, spans``, arrays of struct(start, kind, end, replacement).

    ``base`` are the entities by kind and start, ``spans`` the same and the disclosing terms (kind ``term``) after them.
    """
    terms = checkpointed(disclosing_terms(docs, text_col=text_col, alpha=alpha, witnesses=witnesses))
    return _findings(docs, terms, id_col, text_col).drop("key")


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with (start, end, replacement) applied; of overlapping spans the first one's replacement stands for all."""
    out, at = [], 0
    for start, end, new in sorted(spans):
        if start >= at:
            out += [text[at:start], new]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitised_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", alpha: float = ALPHA, witnesses: int = WITNESSES) -> DataFrame:
    """``docs`` with entities masked and disclosing terms generalised or removed; all rows and columns stay, ``chars_col`` (if there) follows the text."""
    terms = checkpointed(disclosing_terms(docs, text_col=text_col, alpha=alpha, witnesses=witnesses))
    i, k, s = unused(docs.columns, "_id", "_key", "_spans")
    spans = _findings(docs, terms, id_col, text_col).where(F.size("spans") > 0).dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias(i), F.col("key").alias(k), F.col("spans").alias(s))
    joined = docs.join(spans, column(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(column(text_col)) == F.col(k)), "left").drop(i, k)
    at, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            spans = columns[-1].to_pylist()
            if any(spans):
                new = [replaced(x, [(y["start"], y["end"], y["replacement"]) for y in found]) if found and x else x for x, found in zip(columns[at].to_pylist(), spans, strict=True)]
                columns[at] = pa.array(new, columns[at].type)
                if chars is not None:
                    columns[chars] = pa.array([len(x) if found and x else n for x, found, n in zip(new, spans, columns[chars].to_pylist(), strict=True)], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return over_rows(joined, run).drop(s)
