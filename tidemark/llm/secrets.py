"""Secret scan with a recursive decoding worklist.

Every text is scanned as it is; then encoded stretches in it (percent escapes,
``\\uXXXX``/``\\xXX`` and like escapes, base64 runs, UTF-16 and gzip, zlib, bzip2
or xz data inside decoded bytes) are unwrapped, each result is a new layer on
the worklist and is scanned and unwrapped in turn until no layer yields a new
one.  A layer whose (content, place) was seen before is not entered again,
which ends cycles, data that unpack to themselves included.

Escapes.  An escape whose result begins another one (``%2525...41``) is followed
to its end in the same step, so a chain of any length is one layer; the layers
between differ in characters that no kind of secret holds.

Base64 is read at all four alignments, since letters, path separators and the
like before it belong to the run as well, and lines that follow each other are
also read as one run.  Bytes that are no text do not hide what stands beside
them.

Bytes stay bytes: a layer is either text or bytes (one character each).  Escapes
are read both ways, as text and, where they stand for bytes beyond ASCII, as
bytes, so compressed data and UTF-16 are found in percent and ``\\x`` escapes too.

Compressed data are searched for at every place of decoded bytes (deflate
without a head at the beginning of base64) and unpacked in pieces of ``PIECE``
bytes that overlap by ``OVERLAP``, each a layer; memory is bounded by a piece a
level.  One encoding in the original text may unpack to ``LEAST_UNPACKED`` and
``MOST_RATIO`` times its own length, all its levels together: more than any
single deflate stream can, so only what was packed to be a bomb stays packed
beyond it, and other encodings of the text lose nothing by it.

Spans are code-point positions in the *original* text.  Escape layers map every
decoded character back to the characters that encode it; a finding in base64
maps to the run or lines that hold it, one in compressed data to the whole run,
for its bytes do not stand at single characters.

Rows: NULL text counts as empty (no spans); NULL ids pass through; repeated
rows give repeated results; an empty table gives an empty result; texts are
scanned whole whatever their length.  Only the id and the text are read, in
``redact_documents`` all columns, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import over_rows, per_text

# The kinds of secrets, in the order of ties.
ASSIGN = re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex")

#: What an assignment must contain, in lower case; cheaper to look for than the pattern itself.
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
#: Escapes: what begins one, and what each may go on with.
_ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}|\\(?:u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]{1,6}\}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2}|[nrt\\/\"'])")
_AFTER = {
    "%": re.compile(r"([0-9A-Fa-f]{2})"),
    "\\": re.compile(r"u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2})|([nrt\\/\"'])"),
}
_SIMPLE = {"n": "\n", "r": "\r", "t": "\t"}
#: Shorter runs cannot hold a secret of 6 characters with its name.
SHORTEST_RUN = 16
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of base64 that follow each other, of whatever width.
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_URLSAFE = str.maketrans("-_", "+/")
#: The shortest secret with its name, open in a decoded layer: token=abcdef.
_STRETCH = re.compile(r"[\t\r\n\x20-\x7e]{12,}")
#: The first two bytes of zlib data: a window size and one of four levels, the rest being a check modulo 31.
_ZLIB = tuple(bytes([cmf, flag]).decode("latin-1") for cmf in range(0x08, 0x88, 0x10) for flag in range(256) if not flag & 0x20 and (cmf << 8 | flag) % 31 == 0)
#: Where compressed data may begin: gzip, bzip2, xz, zlib.
_PACKED = re.compile("|".join(["\x1f\x8b\x08", "BZh[1-9]1AY&SY", "\xfd7zXZ\x00", *map(re.escape, _ZLIB)]))
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
PIECE, OVERLAP = 1 << 22, 1 << 16
#: What one encoding of the original text may unpack to: deflate never reaches the ratio.
LEAST_UNPACKED, MOST_RATIO = 1 << 26, 1100
#: Memory that xz data may ask for (their highest preset takes 65 MB).
XZ_MEMORY = 1 << 27
#: Printable bytes in a row inside escaped bytes: of compressed data fewer than four in ten are.
APART = 64


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret that stands openly in ``text``; leftmost, non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """Decoded text and where each character comes from in the original text.

    ``places`` None: it is the original text; a pair: all of it comes from that
    range; else two arrays with the start and the end of each character.
    ``raw``: characters are bytes (none is above 255).  ``budget``: what may still
    be unpacked from the encoding of the original text that it stands in.
    """

    __slots__ = ("budget", "places", "raw", "text")

    def __init__(self, text: str, places: tuple | None = None, raw: bool = False, budget: list[int] | None = None) -> None:
        self.text, self.places, self.raw, self.budget = text, places, raw, budget

    def original(self, start: int, end: int) -> tuple[int, int]:
        if self.places is None:
            return start, end
        if isinstance(self.places[0], int):
            return self.places
        return int(self.places[0][start]), int(self.places[1][end - 1])

    def key(self) -> tuple:
        """The same content from the same place, read in the same way, is the same layer."""
        first = self.original(0, len(self.text)) if self.text else (0, 0)
        return hashlib.blake2b(self.text.encode("utf-8", "replace"), digest_size=16).digest(), self.raw, first


def _resolved(text: str, at: int) -> tuple[int | str, int] | None:
    """What the escape at ``at`` stands for in the end, a byte (of a percent escape) or a character, and where it ends."""
    sign, out = text[at], None
    at += 1
    while m := _AFTER[sign].match(text, at):
        if out is not None and sign == "\\" and m[5]:
            break  # two signs in a row: the second one may begin an escape of its own
        at = m.end()
        if sign == "%":
            out = int(m[1], 16)
        elif m[5]:
            out = _SIMPLE.get(m[5], m[5])
        else:
            code = int(m[1] or m[2] or m[3] or m[4], 16)
            out = chr(code) if code <= 0x10FFFF else "\ufffd"
        sign = chr(out) if isinstance(out, int) else out
        if sign not in _AFTER:
            break
    return None if out is None else (out, at)


def _characters(tokens: list[str]) -> tuple[str, list[int]]:
    """Characters of escapes in a row, and which token each begins at: two halves of a surrogate pair are one, a half alone is none."""
    chars, cut, k = [], [], 0
    while k < len(tokens):
        code = ord(tokens[k])
        cut.append(k)
        if 0xD800 <= code < 0xDC00 and k + 1 < len(tokens) and 0xDC00 <= (low := ord(tokens[k + 1])) < 0xE000:
            chars.append(chr(0x10000 + ((code - 0xD800) << 10) + (low - 0xDC00)))
            k += 1
        else:
            chars.append("\ufffd" if 0xD800 <= code < 0xE000 else tokens[k])
        k += 1
    return "".join(chars), cut


def _read(tokens: list[int]) -> tuple[str, list[int]]:
    """Bytes in a row read as UTF-8, and which byte each character begins at; a byte that is no text is a character of its own."""
    decoded = bytes(tokens).decode("utf-8", "surrogateescape")
    cut, k = [], 0
    for c in decoded:
        cut.append(k)
        k += 1 if 0xDC80 <= ord(c) < 0xDD00 else len(c.encode())
    return "".join("\ufffd" if 0xDC80 <= ord(c) < 0xDD00 else c for c in decoded), cut


def _escapes(text: str) -> Iterator[tuple[int, list[int | str], list[int]]]:
    """(where it ends, what the escapes stand for, where each begins and the last ends) of every run of escapes."""
    m = _ESCAPED.search(text)
    while m:
        end, tokens, edges = m.start(), [], [m.start()]
        while end < len(text) and text[end] in _AFTER and (got := _resolved(text, end)):
            tokens.append(got[0])
            end = got[1]
            edges.append(end)
        yield end, tokens, edges
        m = _ESCAPED.search(text, end)


def _mapped(layer: Layer, text: str, start: np.ndarray, end: np.ndarray, raw: bool) -> Layer:
    """``text`` whose characters come from these places of ``layer``."""
    if layer.places is not None and isinstance(layer.places[0], int):
        return Layer(text, layer.places, raw, layer.budget)
    if layer.places is not None:
        start, end = layer.places[0][start], layer.places[1][end - 1]
    return Layer(text, (start, end), raw, layer.budget)


def _unescaped(layer: Layer) -> Iterator[Layer]:
    """``layer`` with every escape replaced by what it stands for, read as text; and where escapes stand for other bytes, the stretches of these as bytes."""
    text = layer.text
    if ("%" not in text and "\\" not in text) or not (runs := list(_escapes(text))):
        return
    out: list[str] = []
    starts: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    at = 0
    for end, tokens, edges in runs:
        plain = np.arange(at, edges[0])
        out.append(text[at : edges[0]])
        starts.append(plain)
        ends.append(plain + 1)
        i = 0
        while i < len(tokens):
            kind = type(tokens[i])
            j = i
            while j < len(tokens) and type(tokens[j]) is kind:
                j += 1
            chars, cut = _characters(tokens[i:j]) if kind is str else _read(tokens[i:j])
            places = np.array([edges[i + k] for k in cut] + [edges[j]], np.int64)
            out.append(chars)
            starts.append(places[:-1])
            ends.append(places[1:])
            i = j
        at = end
    plain = np.arange(at, len(text))
    yield _mapped(layer, "".join([*out, text[at:]]), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1]), False)
    yield from _byte_stretches(layer, runs)


def _byte_stretches(layer: Layer, runs: list[tuple[int, list[int | str], list[int]]]) -> Iterator[Layer]:
    """Escaped bytes that are no ASCII text, with what stands between them: one character a byte.

    Printable bytes may stand unescaped among them; more than ``APART`` of these
    in a row end a stretch.
    """
    text, group = layer.text, []
    for run in [*runs, None]:
        if run is not None and (not group or run[2][0] - group[-1][0] <= APART):
            group.append(run)
            continue
        codes = [t if isinstance(t, int) else ord(t) for _, tokens, _ in group for t in tokens]
        if any(c == 0 or 0x80 <= c < 0x100 for c in codes):
            out, starts, ends = [], [], []
            at = max(0, group[0][2][0] - APART)
            for end, tokens, edges in [*group, (0, [], [min(len(text), group[-1][0] + APART)])]:
                out += [text[at : edges[0]].encode("latin-1", "replace").decode("latin-1"), "".join(chr(c) if (c := t if isinstance(t, int) else ord(t)) < 0x100 else "?" for t in tokens)]
                starts += [*range(at, edges[0]), *edges[:-1]]
                ends += [*range(at + 1, edges[0] + 1), *edges[1:]]
                at = end
            yield _mapped(layer, "".join(out), np.array(starts, np.int64), np.array(ends, np.int64), True)
        group = [run] if run is not None else []


def _is_text(data: bytes) -> bool:
    try:
        text = data.decode()
    except UnicodeDecodeError as fault:
        if fault.start < len(data) - 3:
            return False
        text = data[: fault.start].decode()
    return not _CONTROL.search(text)


def _unpacker(head: bytes):
    """(what unpacks data that begin so, are they surely compressed?)."""
    if head[:3] == b"\x1f\x8b\x08":
        return zlib.decompressobj(31), True
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor(), True
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(lzma.FORMAT_XZ, XZ_MEMORY), True
    return zlib.decompressobj(15), False


def _pieces(data: bytes, at: int, budget: list[int], bare: bool = False) -> Iterator[str]:
    """What the compressed data at ``at`` unpack to, in overlapping pieces; nothing if they are none.  ``bare``: deflate without any head."""
    unpack, sure = (zlib.decompressobj(-15), False) if bare else _unpacker(data[at : at + 6])
    step, held = 1 << 14, b""
    try:
        while budget[0] > 0 and not unpack.eof:
            # what an earlier call left over goes first
            more = getattr(unpack, "unconsumed_tail", b"")
            if not more and getattr(unpack, "needs_input", True):
                more = data[at : at + step]
                at += step
                if not more:
                    break
            new = unpack.decompress(more, min(PIECE - len(held), budget[0]))
            budget[0] -= len(new)
            held += new
            if len(held) >= PIECE:
                if bare and not sure and not _is_text(held):
                    return
                yield held.decode("latin-1")
                held, sure = held[-OVERLAP:], True
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        # what came out before the fault counts, unless a head stood there by chance
        held = held if sure else b""
    if held and (sure or not bare or unpack.eof and len(unpack.unused_data) < 4 and _is_text(held)):
        yield held.decode("latin-1")


def _decoded(run: str) -> Iterator[tuple[int, bytes]]:
    """(alignment, bytes) of a base64 run read from each of its first four characters."""
    run = run.rstrip("=").translate(_URLSAFE)
    for k in range(4):
        part = run[k : len(run) - ((len(run) - k) % 4 == 1)]
        try:
            yield k, base64.b64decode(part + "=" * (-len(part) % 4))
        except binascii.Error:
            continue


def _inner(layer: Layer) -> Iterator[Layer]:
    """The layers one step inside ``layer``."""
    text = layer.text
    for inner in _unescaped(layer):
        if inner.raw and inner.budget is None:
            inner.budget = _allowance(inner.text)
        yield inner
    if layer.raw:
        yield from _unpacked(layer)
    # one byte is one character here: the patterns and the encodings are all ASCII
    for m in _BASE64.finditer(text):
        place, budget = layer.original(m.start(), m.end()), layer.budget or _allowance(m.group())
        for _, data in _decoded(m.group()):
            inner = Layer(data.decode("latin-1"), place, True, budget)
            yield inner
            # deflate without a head can only be told by unpacking it: it must fill the run and be text
            for piece in _pieces(data, 0, budget, True):
                yield Layer(piece, place, True, budget)
    if "\n" not in text:
        return
    for m in _LINES.finditer(text):
        lines = [(x.start(), x.end()) for x in _LINE.finditer(text, m.start(), m.end())]
        size = [e - s for s, e in lines]
        if sum(size) < SHORTEST_RUN:
            continue
        starts, ends = (np.repeat([layer.original(s, e)[k] for s, e in lines], size) for k in (0, 1))
        budget, whole = layer.budget or _allowance(m.group()), (layer.original(*lines[0])[0], layer.original(*lines[-1])[1])
        for k, data in _decoded("".join(text[s:e] for s, e in lines)):
            i = np.arange(len(data))
            yield Layer(data.decode("latin-1"), (starts[k + 8 * i // 6], ends[k + (8 * i + 7) // 6]), True, budget)
            for piece in _pieces(data, 0, budget, True):
                yield Layer(piece, whole, True, budget)


def _allowance(encoded: str) -> list[int]:
    return [LEAST_UNPACKED + MOST_RATIO * len(encoded)]


def _unpacked(layer: Layer) -> Iterator[Layer]:
    """UTF-16 and compressed data in bytes."""
    text = layer.text
    if "\0" in text and _STRETCH.search(even := text.replace("\0", "")):
        yield Layer(even, layer.original(0, len(text)), True, layer.budget)
    data, whole = None, layer.original(0, len(text)) if text else None
    for m in _PACKED.finditer(text):
        data = text.encode("latin-1") if data is None else data
        for piece in _pieces(data, m.start(), layer.budget):
            yield Layer(piece, whole, True, layer.budget)


def scanned(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """(spans in the open text, spans of all layers, faults), spans sorted by start, kind, end without repeats.

    A layer whose unwrapping fails in a way not foreseen costs what is inside it
    and counts as a fault; the others are read on.  Spans of a text with faults
    may be too few: callers must show the faults.
    """
    base = base_spans(text)
    added, seen, faults = set(), set(), 0
    # the worklist holds, a level each, the layers that are still to be made
    work = [_inner(Layer(text))]
    while work:
        try:
            layer = next(work[-1], None)
        except MemoryError:
            raise
        except Exception:
            layer, faults = None, faults + 1
        if layer is None:
            work.pop()
            continue
        readable = _STRETCH.search(layer.text)
        if not readable and not (layer.raw and (_PACKED.search(layer.text) or "\0" in layer.text)):
            continue
        key = layer.key()
        if key in seen:
            continue
        seen.add(key)
        if readable:
            for start, kind, end in base_spans(layer.text):
                s, e = layer.original(start, end)
                added.add((s, kind, e))
        work.append(_inner(layer))
    return base, sorted(set(base) | _widest(added - set(base))), faults


def secret_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(spans in the open text, spans of all layers), each sorted by start, kind, end without repeats."""
    return scanned(text)[:2]


def _widest(spans: set[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
    """Without spans inside another of their kind: one finding seen through layers that cut its padding differently."""
    kept, reach = set(), {}
    for start, kind, end in sorted(spans, key=lambda x: (x[0], -x[2], x[1])):
        if end > reach.get(kind, -1):
            kept.add((start, kind, end))
            reach[kind] = end
    return kept


def redacted(text: str, spans: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str:
    """``text`` with every span replaced; overlapping spans are replaced as one."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, _, end in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def secret_findings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, base, spans, redacted, faults``.

    ``base`` and ``spans`` are arrays of struct(start, kind, end), ordered;
    ``redacted`` is the text with all spans masked, NULL where there is none;
    ``faults`` counts layers that could not be unwrapped.
    """
    item = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])

    def shown(spans: list[tuple[int, int, int]]) -> list[dict]:
        return [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, spans, masked, faults = [], [], [], []
            for text in batch.column(1).to_pylist():
                open_spans, every, failed = scanned(text or "")
                faults.append(failed)
                base.append(shown(open_spans))
                spans.append(shown(every))
                masked.append(redacted(text, every) if every else None)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(item)), pa.array(spans, pa.list_(item)), pa.array(masked, pa.string()), pa.array(faults, pa.int32())], names=["doc_id", "base", "spans", "redacted", "faults"])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<start:bigint,kind:string,end:bigint>>"
    return per_text(docs, [id_col, text_col], make, f"doc_id {kind}, base {spans}, spans {spans}, redacted string, faults int")


def joined(spans: str):
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kind(spans: str, kind: str):
    return F.size(F.filter(F.col(spans), lambda x: x["kind"] == kind)).cast("bigint")


#: What stands for a text that could not be read to the end.
UNREADABLE = "[UNREADABLE]"


def redact_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets masked in the text; all rows and columns stay, ``chars_col`` (if there) follows the text.

    NULL texts stay NULL.  A text with a layer that could not be read may hide a
    secret there: it is replaced by ``UNREADABLE`` as a whole.  Works row by row,
    so repeated rows and ids are fine.
    """
    names = docs.columns
    at = names.index(text_col)
    chars = names.index(chars_col) if chars_col in names else None

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            spans, faults = zip(*[scanned(x)[1:] if x else ([], 0) for x in texts], strict=True) if texts else ((), ())
            if any(spans) or any(faults):
                new = [UNREADABLE if f else redacted(x, s) if s else x for x, s, f in zip(texts, spans, faults, strict=True)]
                columns[at] = pa.array(new, columns[at].type)
                if chars is not None:
                    old = columns[chars].to_pylist()
                    columns[chars] = pa.array([len(x) if s or f else n for x, s, f, n in zip(new, spans, faults, old, strict=True)], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return over_rows(docs, run)
