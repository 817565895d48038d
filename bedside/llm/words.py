"""Vectorised word splitting and hashing of whole batches of texts (numpy, inside Spark tasks).

Words are runs of bytes of the UTF-8 text, so a batch is joined into one byte string, split where a
256-entry table says so, and every word gets a 64-bit hash. The hash gives each byte a random 64-bit
weight, multiplies by powers of an odd number by place, and mixes the sum; it depends on the word alone
and is the same on every machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple, TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Everything but blanks: [^\x20\x09-\x0D]
NON_SPACE = np.array([not (b == 0x20 or 9 <= b <= 13) for b in range(256)])
#: Letters, digits and all beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])

_MULTIPLIER = 0x9E3779B97F4A7C15
_WEIGHTS = np.random.Generator(np.random.PCG64(20240101)).integers(1, 2**64, 256, dtype=np.uint64)
_powers = np.ones(1, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> np.ndarray:
    """At least ``n`` powers of the multiplier, modulo 2^64."""
    global _powers
    while len(_powers) < n:
        step = np.uint64(pow(_MULTIPLIER, len(_powers), 2**64))
        _powers = np.concatenate([_powers, _powers * step])
    return _powers


class Words(NamedTuple):
    """Words of a batch in order: hash, number of the text, byte range in ``data``; ``first`` has len(texts) + 1 entries."""

    data: bytes
    hashes: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offset: np.ndarray


def split(texts: list[bytes], table: np.ndarray, lower: bool) -> Words:
    data = b"\n".join(texts) + b"\n"
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    offset = np.concatenate([[0], np.cumsum(lengths)])
    raw = np.frombuffer(data.translate(LOWER) if lower else data, dtype=np.uint8)
    inside = table[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    if len(start):
        sizes = end - start
        letters = raw[inside]
        before = np.cumsum(sizes) - sizes
        place = np.arange(len(letters)) - np.repeat(before, sizes)
        hashes = mix(np.add.reduceat(_WEIGHTS[letters] * powers(int(sizes.max()))[place], before))
    else:
        hashes = np.zeros(0, dtype=np.uint64)
    first = np.searchsorted(start, offset)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, hashes, text, start, end, first, offset)


def joined_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (``len(hashes) - n + 1`` of them, text borders ignored)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        total += hashes[k : k + m] * powers(n)[n - 1 - k]
    return mix(total)


def pieces(sizes: list[int], limit: int = 1 << 20) -> Iterator[slice]:
    """Ranges of a batch of about ``limit`` bytes each, so that scratch arrays stay small."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield slice(begin, i)
            begin = i
            total = 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def encoded(texts) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about a million bytes of text, so that a task has only those as Python objects."""
    for part in pieces(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist(), limit):
        yield batch.slice(part.start, part.stop - part.start)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Jobs run in here hand texts to Python in record batches of about ``size``, not of 64 MB.

    A batch is held by the executor while it grows, outside of its heap, and by the Python worker, once for each running task.
    """
    before = spark.conf.get(_BATCH_BYTES, None)
    spark.conf.set(_BATCH_BYTES, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_BYTES)
        else:
            spark.conf.set(_BATCH_BYTES, before)


Kept = TypeVar("Kept")
_kept: dict[str, object] = {}


def kept(key: str, make: Callable[[], Kept]) -> Kept:
    """What ``make`` builds for the tasks of job ``key``. A worker keeps one such thing: the next job's, of any operator, takes its place."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(run: Run, key: str | None = None) -> Run:
    """``run`` that gives freed memory back to the system when a task ends, and before it begins what another job than ``key`` has kept.

    A Python worker goes on to the next task, and what it keeps counts against its executor meanwhile.
    """

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _kept and key not in _kept:
            _kept.clear()
            _give_back()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return inner
