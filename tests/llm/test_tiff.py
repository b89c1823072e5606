import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import queries, tiff


@given(st.binary(max_size=3000))
@settings(max_examples=150, deadline=None)
def test_codecs_round_trip(data):
    assert tiff.unpackbits(tiff.packbits(data)) == data
    assert tiff.unlzw(tiff.lzw(data)) == data


@pytest.mark.parametrize("data", [b"", b"\0" * 100_000, bytes(range(256)) * 300, os.urandom(20_000), b"ab" * 30_000])
def test_long_codecs_round_trip(data):
    assert tiff.unlzw(tiff.lzw(data)) == data
    assert tiff.unpackbits(tiff.packbits(data)) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("layout", [{"tile": 32}, {"rows": 7}])
def test_pages_round_trip(compression, predictor, layout):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 9, (50, 70), dtype=np.uint8), rng.integers(0, 255, (33, 20, 3), dtype=np.uint8)]
    form = tiff.Form(compression, predictor, **layout)
    pages = list(tiff.read_tiff(tiff.write_tiff([(i, form) for i in images])))
    assert [(p.page, p.height, p.width, p.samples_per_pixel, p.error) for p in pages] == [(0, 50, 70, 1, None), (1, 33, 20, 3, None)]
    assert [p.samples for p in pages] == [i.tobytes() for i in images]


def test_big_endian_planar_file():
    planes = [bytes(range(6)), bytes(range(10, 16))]
    head = b"MM\0*" + struct.pack(">I", 8 + 12)
    tags = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 2, 8 << 16 | 8), (259, 3, 1, 1), (277, 3, 1, 2), (278, 3, 1, 2), (284, 3, 1, 2)]
    entries = [struct.pack(">HHIHH", t, k, n, v, 0) if n == 1 else struct.pack(">HHII", t, k, n, v) for t, k, n, v in tags]
    at = 8 + 12 + 2 + 12 * 9 + 4
    entries += [struct.pack(">HHII", 273, 4, 2, at), struct.pack(">HHII", 279, 4, 2, at + 8)]
    body = struct.pack(">H", 9) + b"".join(sorted(entries)) + b"\0\0\0\0" + struct.pack(">IIII", 8, 14, 6, 6)
    (page,) = tiff.read_tiff(head + planes[0] + planes[1] + body)
    assert page.error is None
    assert page.samples == bytes(x for pair in zip(*planes, strict=True) for x in pair)


def test_bad_files_give_rows():
    good = tiff.write_tiff([(np.zeros((4, 4), np.uint8), tiff.Form(tiff.DEFLATE))])
    assert [p.page for p in tiff.read_tiff(None)] == [-1]
    assert [p.error for p in tiff.read_tiff(b"GIF89a..")] == ["not a TIFF file"]
    assert all(p.error for p in tiff.read_tiff(good[:-20]))
    broken = bytearray(good)
    broken[9] ^= 0xFF
    assert next(iter(tiff.read_tiff(bytes(broken)))).error
    looped = bytearray(good)
    looped[-4:] = looped[4:8]
    assert len(list(tiff.read_tiff(bytes(looped)))) == 1


def test_query_gives_the_payload_back(spark, tmp_path):
    rows = [(1, "hello"), (1, "hello"), (2, None), (3, ""), (None, "é" * 32), (4, "abc " * 30_000), *[(10 + i, f"text {i} " * i) for i in range(60)]]
    spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, page int").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_tiff_pages(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        data = next((t or "").encode() for d, t in rows if d == r.doc_id)
        payload = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert seen.setdefault(r.payload_sha256, (r.media_sha256, r.media_bytes, r.feature)) == (r.media_sha256, r.media_bytes, r.feature)
    assert tiff.tiff_pages(tiff.text_media(spark.createDataFrame([], "doc_id bigint, text string")), keep=["doc_id"]).count() == 0


def test_a_page_without_samples_is_an_error():
    good = tiff.write_tiff([(np.zeros((2, 64), np.uint8), tiff.Form(tiff.NONE, 1))])
    for tag in (tiff.SAMPLES, tiff.WIDTH, tiff.LENGTH):
        at = next(i for i in range(len(good) - 12) if good[i : i + 2] == struct.pack("<H", tag) and struct.unpack_from("<I", good, i + 4)[0] == 1 and i > 100)
        bad = bytearray(good)
        bad[at + 8 : at + 12] = b"\0\0\0\0"
        (page,) = tiff.read_tiff(bytes(bad))
        assert page.samples is None and page.error
    (page,) = tiff.read_tiff(good)
    assert page.error is None and len(page.samples) == 128
