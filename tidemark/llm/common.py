"""Shared helpers: shared-folder checkpoints, Arrow text batches, vectorised word hashing."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``: what separates words everywhere in this package.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
#: All that is no ASCII letter and no part of a character beyond ASCII.
NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
#: All that is no ASCII letter, digit or part of a character beyond ASCII.
NO_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

#: An odd multiplier; being odd it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder the cluster shares, so that a lost executor costs a re-read only.

    The folder is ``spark.checkpoint.dir`` of the session.  Where that is unset,
    one machine (a ``local`` master) gets a temporary folder and a cluster an
    error, for the driver's disk is not the executors'.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidemark-ckpt-"))
    return df.checkpoint(eager=True)


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, in whatever case."""
    taken = {c.lower() for c in columns}
    return [next(n for n in (w + "_" * i for i in range(len(taken) + 1)) if n.lower() not in taken) for w in wanted]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(id_col: str, n: int):
    """``crc32(doc_id as text) mod n``; NULL ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes; NULL as b""."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most ``limit`` bytes (one text at least), which bound numpy's temporaries."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


def per_text(df: DataFrame, columns: list[str], make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | list]], schema: str) -> DataFrame:
    """``mapInArrow`` over ``columns`` only: ``make()`` runs once a task and gives the function of each batch."""
    chosen = df.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield work(batch)
        hand_back()

    return chosen.mapInArrow(run, schema)


#: Rows that ``over_rows`` hands on at once: their texts are held three times over.
ROWS_AT_ONCE = 1024


def over_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` over all columns, which come and go in their order, whatever their names (dots, repeats, any case)."""
    safe = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield batch.slice(i, ROWS_AT_ONCE)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(parts(batches))
        hand_back()

    return safe.mapInArrow(bounded, safe.schema).toDF(*df.columns)


def hand_back() -> None:
    """Free memory goes back to the system at the end of a task, for workers live on and other stages need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE**i`` and its inverse for i < n (grown by doubling, kept by the worker)."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes], separates: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash every word of a few texts at once; ``separates`` says of each byte whether it ends a word (a line end must).

    Returns (hash of each word, its start, its end, first word of each text and
    one past the last); starts and ends are positions in the joined, lower-cased
    (A-Z) texts.  A word's hash depends on its bytes alone: it is a difference
    of prefix sums of a polynomial modulo 2**64, shifted back to position 0.
    """
    joined = (b"\n".join(texts) + b"\n").lower()
    a = np.frombuffer(joined, np.uint8)
    space = separates[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(a) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    forward, back = _power_tables(len(a) + 1)
    with np.errstate(over="ignore"):
        prefix = np.empty(len(a) + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(_BYTE[a] * forward[: len(a)], dtype=np.uint64, out=prefix[1:])
        h = mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.searchsorted(starts, np.cumsum(lengths + 1))])
    return h, starts, ends, bounds


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer file; ``folder`` overrides the installed package's."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
