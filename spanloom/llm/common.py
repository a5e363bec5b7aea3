"""Helpers that the training-data operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shared import materialize, new_path, spread  # noqa: F401  for the operators

#: The six white-space bytes x20 and x09-x0D; in UTF-8 they occur nowhere inside other characters.
WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of text that a numpy kernel expands at once; keeps a Python worker's memory flat.
CHUNK_BYTES = 1 << 21


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def row_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Split rows into runs of about `most` bytes (a longer row stands alone): (first row, row after the last)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = b


_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x + _G).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


#: By byte: whether it is white space.
is_white = np.zeros(256, bool)
is_white[list(WHITE)] = True
_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        m = max(n, 1 << 16)
        have = np.empty(m, np.uint64)
        have[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < m:
                k = min(done, m - done)
                have[done : done + k] = have[:k] * np.uint64(pow(int(base), done, 1 << 64))
                done += k
        _powers[int(base)] = have
    return have[:n]


def words_of(data: np.ndarray, offsets: np.ndarray, inked: np.ndarray = ~is_white) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of consecutive rows: (start, end, words of each row).

    start and end count from offsets[0]; a word never spans two rows.  inked: the
    bytes that words are made of, by default all but white space.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    n = hi - lo
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    ink = inked[data[lo:hi]]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    rows = offsets[:-1] - lo
    inner = rows[(rows > 0) & (rows < n)]
    first[inner] = ink[inner]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    last[inner - 1] = ink[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    count = np.searchsorted(start, offsets[1:] - lo) - np.searchsorted(start, rows)
    return start, end, count


def word_hashes(data: np.ndarray, lo: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, from one prefix sum over the bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = int(end[-1])
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data[lo : lo + n].astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
        return mix64((total[end] - total[start]) * powers(_BASE_INV, n)[start] + (end - start).astype(np.uint64))


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, type=f.type) for f in schema], schema=schema)
