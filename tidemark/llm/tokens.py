"""Token counts of a byte-level BPE vocabulary by the whole-token shortcut.

A pre-token that is itself a vocabulary entry *and* that the merges rebuild
into that one entry always counts one.  Which entries these are is proved once
per worker by replaying the merges (``whole_tokens``); the count of any other
pre-token comes from ``merge_count``.  So the hot loop is one dictionary lookup
a pre-token, and only unseen strings are merged.

Rows: NULL text counts as the empty text (0 bytes, 0 tokens); NULL ids pass
through; repeated rows give repeated, equal rows; an empty table an empty
result.  Texts of any length are taken whole, a pre-token of any length too:
merging keeps candidate pairs in a heap, O(n log n).  Only ``doc_id`` and
``text`` are read, so other columns' names do not matter.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import per_text, utf8, vocabulary_path

#: Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKEN_LIMIT = 1024
#: Entries a worker remembers beside the vocabulary; beyond it the memory starts anew (results do not change).
REMEMBERED = 400_000
#: Pre-tokens over so many bytes are merged by a heap.
LONG_PIECE = 256
_NO_MERGE = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merge ranks, whole tokens and added special strings of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: An id for each string that a merge takes or makes; bytes first.
        self.ids: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        #: (left id, right id) as one integer -> rank; and the id of what the merge of a rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            left, right = raw(a), raw(b)
            self.made.append(self.ids.setdefault(left + right, len(self.ids)))
            self.ranks.setdefault(self.ids[left] << 20 | self.ids[right], rank)
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        strings = (raw(s) for s in spec["model"]["vocab"] if s not in set(self.special))
        self.whole = self.whole_tokens(strings)

    def whole_tokens(self, strings) -> dict[str, int]:
        """The entries that are one pre-token and that the merges rebuild into one token: text -> 1."""
        pattern, proved = regex.compile(PRE_TOKEN), {}
        for b in strings:
            try:
                s = b.decode()
            except UnicodeDecodeError:
                continue
            if pattern.fullmatch(s) and self.merge_count(b) == 1:
                proved[s] = 1
        return proved

    def merge_count(self, piece: bytes) -> int:
        """How many tokens remain of ``piece`` when the lowest-ranked adjacent pair is merged again and again."""
        if len(piece) > LONG_PIECE:
            return self._merge_long(piece)
        rank_of, made = self.ranks.get, self.made
        ids = list(piece)
        ranks = [rank_of(a << 20 | b, _NO_MERGE) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            rank = min(ranks)
            if rank == _NO_MERGE:
                break
            at = ranks.index(rank)
            ids[at] = new = made[rank]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of(ids[at - 1] << 20 | new, _NO_MERGE)
            if at < len(ranks):
                ranks[at] = rank_of(new << 20 | ids[at + 1], _NO_MERGE)
        return len(ids)

    def _merge_long(self, piece: bytes) -> int:
        """The same by a heap of candidate pairs over a linked list."""
        ids, n = list(piece), len(piece)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.ranks.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], left = self.made[rank], -1, left - 1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return left


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Counts(dict):
    """Pre-token -> tokens; merges what it does not know and remembers it."""

    def __init__(self, vocab: Vocabulary) -> None:
        super().__init__(vocab.whole)
        self.vocab = vocab

    def __missing__(self, piece: str) -> int:
        n = self.vocab.merge_count(piece.encode())
        if len(self) >= len(self.vocab.whole) + REMEMBERED:
            self.clear()
            self.update(self.vocab.whole)
        self[piece] = n
        return n


@lru_cache(maxsize=4)
def _counts(path: str) -> _Counts:
    return _Counts(vocabulary(path))


def count_tokens(text: str, path: str) -> int:
    """Tokens of one text.  Special strings inside it are cut out first and count one each."""
    counts = _counts(path)
    segments, found = [text], 0
    for s in counts.vocab.special:
        if s in text:
            split = [part for seg in segments for part in seg.split(s)]
            found += len(split) - len(segments)
            segments = split
    return found + sum(sum(map(counts.__getitem__, _pattern().findall(seg))) for seg in segments)


@lru_cache(maxsize=1)
def _pattern():
    return regex.compile(PRE_TOKEN)


def token_counts(docs: DataFrame, *, vocab: str = "byte_bpe_50k.json", folder: str | None = None, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_bytes, n_tokens, over_limit`` (``n_tokens > limit``).

    ``folder`` is where executors find the vocabulary file (default: the
    installed ``public_tokenizers`` package).
    """

    def make():
        path = vocabulary_path(vocab, folder)
        _counts(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = utf8(batch.column(1))
            tokens = [count_tokens(x.decode(), path) for x in texts]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return per_text(docs, [id_col, text_col], make, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
