"""TIFF media columns: write byte payloads as TIFF files, walk the directories back, one row a page.

The reader follows the chain of image directories of either byte order, takes
strips or tiles of 8-bit samples (chunky or planar), undoes no compression,
PackBits, LZW (old ``1``-bit-early code widths as the format asks) or deflate,
undoes the horizontal predictor, and crops tile padding.

Rows: NULL media or a file that is not TIFF gives one row with page -1 and the
reason in ``error``; a bad page gives its row with ``error`` and NULL samples,
later pages are still read; a chain of directories that returns to one it has
visited ends there.  NULL ids pass through, repeated rows give repeated
results, an empty table an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_text, utf8

# Tags and codes of the format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 273, 277, 278, 279
PLANAR, PREDICTOR = 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 16: "Q"}
CLEAR, END, FIRST = 256, 257, 258

_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits(data: bytes) -> bytes:
    """Runs of three and more equal bytes as (count, byte), all else as literals of up to 128."""
    out, at = bytearray(), 0

    def literal(start: int, end: int) -> None:
        for i in range(start, end, 128):
            piece = data[i : min(i + 128, end)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for m in _RUN.finditer(data):
        literal(at, m.start())
        at = m.end()
        out.append(257 - (at - m.start()))
        out.append(data[m.start()])
    literal(at, len(data))
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out.append(data[i + 1 : i + 2 + c])
            i += 2 + c
        elif c > 128:
            out.append(data[i + 1 : i + 2] * (257 - c))
            i += 2
        else:
            i += 1
    return b"".join(out)


def _codes_to_bytes(codes: list[int], widths: list[int]) -> bytes:
    """Codes of varying width packed from the high bit down."""
    value, w = np.array(codes, np.uint32), np.array(widths, np.int64)
    last = np.cumsum(w)
    bits = np.zeros(int(last[-1]) + 7 & ~7, np.uint8)
    for k in range(12):
        has = w > k
        bits[last[has] - 1 - k] = (value[has] >> np.uint32(k)) & np.uint32(1)
    return np.packbits(bits).tobytes()


def lzw(data: bytes) -> bytes:
    """Words are (code of the word before its last byte) x 256 + that byte, so that a step is one look-up of a number."""
    codes, widths = [CLEAR], [9]
    if not data:
        return _codes_to_bytes([CLEAR, END], [9, 9])
    table: dict[int, int] = {}
    find = table.get
    bound, width, word = FIRST, 9, data[0]
    for b in data[1:]:
        key = word << 8 | b
        longer = find(key)
        if longer is not None:
            word = longer
            continue
        codes.append(word)
        widths.append(width)
        table[key] = bound
        bound += 1
        if bound + 1 > (1 << width) and width < 12:
            width += 1
        if bound == 4094:
            codes.append(CLEAR)
            widths.append(width)
            table.clear()
            bound, width = FIRST, 9
        word = b
    codes.append(word)
    widths.append(width)
    bound += 1
    if bound + 1 > (1 << width) and width < 12:
        width += 1
    codes.append(END)
    widths.append(width)
    return _codes_to_bytes(codes, widths)


def unlzw(data: bytes) -> bytes:
    start = [bytes([b]) for b in range(256)] + [b"", b""]
    table, out, previous = start.copy(), [], b""
    width, held, n = 9, 0, 0
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        n += 8
        if n < width:
            continue
        n -= width
        code = held >> n & (1 << width) - 1
        if code == END:
            break
        if code == CLEAR:
            table, width, previous = start.copy(), 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and previous:
            word = previous + previous[:1]
        else:
            raise ValueError("bad LZW code")
        out.append(word)
        if previous and len(table) < 4096:
            table.append(previous + word[:1])
        previous = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def compressed(data: bytes, scheme: int) -> bytes:
    if scheme == DEFLATE:
        return zlib.compress(data, 1)
    return {NONE: bytes, PACKBITS: packbits, LZW: lzw}[scheme](data)


def decompressed(data: bytes, scheme: int) -> bytes:
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if scheme not in (NONE, PACKBITS, LZW):
        raise ValueError(f"compression {scheme}")
    return {NONE: bytes, PACKBITS: unpackbits, LZW: unlzw}[scheme](data)


@dataclass(frozen=True)
class Form:
    """How a page is stored.  ``tile`` 0: strips of ``rows`` rows; else square tiles (a multiple of 16)."""

    compression: int = DEFLATE
    predictor: int = 1
    tile: int = 0
    rows: int = 512


def _blocks(image: np.ndarray, form: Form) -> Iterator[np.ndarray]:
    height, width = image.shape[:2]
    if not form.tile:
        for y in range(0, height, form.rows):
            yield image[y : y + form.rows]
        return
    t = form.tile
    padded = np.zeros((-(-height // t) * t, -(-width // t) * t, *image.shape[2:]), np.uint8)
    padded[:height, :width] = image
    for y in range(0, height, t):
        for x in range(0, width, t):
            yield padded[y : y + t, x : x + t]


def write_tiff(pages: list[tuple[np.ndarray, Form]]) -> bytes:
    """A little-endian file of 8-bit pages, each (rows x columns [x samples])."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for image, form in pages:
        height, width = image.shape[:2]
        samples = image.shape[2] if image.ndim == 3 else 1
        offsets, sizes = [], []
        for block in _blocks(image, form):
            if form.predictor == 2:
                first = block[:, :1]
                block = np.concatenate([first, block[:, 1:] - block[:, :-1]], axis=1)
            data = compressed(block.tobytes(), form.compression)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data
        tags = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [form.compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [form.predictor])]
        if form.tile:
            tags += [(TILE_WIDTH, 4, [form.tile]), (TILE_LENGTH, 4, [form.tile]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)]
        else:
            tags += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [form.rows]), (STRIP_BYTES, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(tags):
            value = struct.pack(f"<{len(values)}{_TYPES[kind]}", *values)
            if len(value) > 4:
                out += b"\0" * (len(out) % 2)
                value, place = struct.pack("<I", len(out)), value
                out += place
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + value.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    page: int
    width: int | None = None
    height: int | None = None
    samples_per_pixel: int | None = None
    compression: int | None = None
    predictor: int | None = None
    layout: str | None = None
    samples: bytes | None = None
    error: str | None = None


def read_tiff(data: bytes | None) -> Iterator[Page]:
    """The pages in the order of the chain of directories."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get((data or b"")[:4])
    if order is None or len(data) < 8:
        yield Page(-1, error="not a TIFF file")
        return
    at, page, seen = struct.unpack_from(order + "I", data, 4)[0], 0, set()
    while at and at not in seen:
        seen.add(at)
        try:
            tags, at = _directory(data, at, order)
        except (struct.error, KeyError) as e:
            yield Page(page, error=f"bad directory: {e}")
            return
        row = Page(page)
        try:
            _fill(row, data, tags)
        except (ValueError, KeyError, IndexError, zlib.error, struct.error) as e:
            row.samples, row.error = None, f"{type(e).__name__}: {e}"
        yield row
        page += 1


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (count,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(at + 2, at + 2 + 12 * count, 12):
        tag, kind, n = struct.unpack_from(order + "HHI", data, i)
        if kind not in _TYPES:
            continue
        code = f"{order}{n}{_TYPES[kind]}"
        place = i + 8 if struct.calcsize(code) <= 4 else struct.unpack_from(order + "I", data, i + 8)[0]
        tags[tag] = struct.unpack_from(code, data, place)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def _fill(row: Page, data: bytes, tags: dict[int, tuple]) -> None:
    one = lambda tag, default=None: tags[tag][0] if default is None or tag in tags else default
    row.width, row.height = one(WIDTH), one(LENGTH)
    row.samples_per_pixel, row.compression, row.predictor = one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    row.layout = "tiles" if TILE_OFFSETS in tags else "strips"
    if min(row.width, row.height, row.samples_per_pixel) < 1:
        raise ValueError("a page without samples")
    if set(tags.get(BITS, (1,))) != {8}:
        raise ValueError("samples are not of 8 bits")
    if row.predictor not in (1, 2):
        raise ValueError(f"predictor {row.predictor}")
    planar = one(PLANAR, 1) == 2 and row.samples_per_pixel > 1
    deep, planes = (1, row.samples_per_pixel) if planar else (row.samples_per_pixel, 1)
    if row.layout == "tiles":
        block_w, block_h, offsets, sizes = one(TILE_WIDTH), one(TILE_LENGTH), tags[TILE_OFFSETS], tags[TILE_BYTES]
    else:
        block_w, block_h, offsets, sizes = row.width, min(one(ROWS_PER_STRIP, row.height), row.height), tags[STRIP_OFFSETS], tags[STRIP_BYTES]
    image = np.zeros((planes, row.height, row.width, deep), np.uint8)
    spots = [(p, y, x) for p in range(planes) for y in range(0, row.height, block_h) for x in range(0, row.width, block_w)]
    for (p, y, x), offset, n in zip(spots, offsets, sizes, strict=True):
        h = block_h if row.layout == "tiles" else min(block_h, row.height - y)
        block = np.frombuffer(decompressed(data[offset : offset + n], row.compression), np.uint8, h * block_w * deep).reshape(h, block_w, deep)
        if row.predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        image[p, y : y + h, x : x + block_w] = block[: row.height - y, : row.width - x]
    row.samples = (np.moveaxis(image[..., 0], 0, -1) if planar else image[0]).tobytes()


#: Payloads are images of so many columns.
COLUMNS = 64
_FORMS = (
    Form(DEFLATE, 2), Form(DEFLATE, 1, tile=64), Form(LZW, 2), Form(PACKBITS, 1), Form(DEFLATE, 2, tile=64), Form(PACKBITS, 1, tile=64), Form(NONE, 2), Form(LZW, 1, rows=128),
    Form(PACKBITS, 1, rows=64), Form(DEFLATE, 2, rows=64), Form(NONE, 1, tile=64), Form(LZW, 1, tile=64), Form(DEFLATE, 1, tile=32), Form(PACKBITS, 2), Form(DEFLATE, 1, rows=256), Form(LZW, 1),
)


def form_of(payload: bytes) -> Form:
    """The stored form follows from the payload's checksum, so equal payloads are stored equally and all forms occur."""
    return _FORMS[zlib.crc32(payload) % len(_FORMS)]


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a TIFF page.

    NULL text is stored as the empty text.  A text is one page whatever its
    length; its strips or tiles are compressed one by one.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, media = utf8(batch.column(1)), []
            for x in texts:
                payload = x.ljust(max(1, -(-len(x) // COLUMNS)) * COLUMNS, b"\0")
                media.append(write_tiff([(np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS), form_of(payload))]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return per_text(docs, [id_col, text_col], make, f"doc_id {kind}, n_bytes bigint, media binary")


def tiff_pages(files: DataFrame, *, keep: list[str], media_col: str = "media", thumbnail: int = 4) -> DataFrame:
    """One row a page: the ``keep`` columns, then ``page, width, height, samples_per_pixel, compression, predictor, layout, samples, media_bytes, media_sha256, histogram, error``.

    ``histogram`` counts the samples in ``thumbnail``**2 equal ranges of value.
    """
    names = ["page", "width", "height", "samples_per_pixel", "compression", "predictor", "layout", "samples", "error"]
    kinds = [pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
    bins = thumbnail * thumbnail

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, pages, counts = [], [], []
                for i, data in enumerate(part.column(len(keep)).to_pylist()):
                    for page in read_tiff(data):
                        rows.append(i)
                        pages.append(page)
                        counts.append(None if page.samples is None else (np.bincount(np.frombuffer(page.samples, np.uint8), minlength=256).reshape(bins, -1).sum(1)).tolist())
                take = pa.array(rows, pa.int64())
                arrays = [part.column(j).take(take) for j in range(len(keep) + 1)]
                arrays += [pa.array([getattr(p, n) for p in pages], k) for n, k in zip(names, kinds, strict=True)]
                arrays.append(pa.array(counts, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "media", *names, "histogram"])

    chosen = files.select(*keep, F.col(media_col).alias("media"))
    given = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in [*keep, "media"])
    fields = "page int, width bigint, height bigint, samples_per_pixel bigint, compression int, predictor int, layout string, samples binary, error string, histogram array<bigint>"
    read = chosen.mapInArrow(run, f"{given}, {fields}")
    return read.withColumn("media_bytes", F.length("media").cast("bigint")).withColumn("media_sha256", F.sha2("media", 256)).drop("media")
