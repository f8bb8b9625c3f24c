"""Word and byte hashing of whole texts with numpy, a bounded piece of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64) | _U(1)


_BYTE = _odd(11, 256)
_PLACE = _odd(12, 64)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (two rounds of multiply and shift)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xA24BAED4963EE407)
    return x ^ (x >> _U(32))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BACK, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    size = max(PIECE_BYTES * 2, 1 << int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def rolling(buf: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any stretch of ``buf`` follows; see ``stretch``."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    up, _ = powers(len(buf))
    np.cumsum(_BYTE[buf] * up, out=sums[1:])
    return sums


def stretch(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``starts`` up to ``ends``."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of all rows with an id; other columns don't matter."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        "doc_id IS NOT NULL"
    )


def pieces(batches: Iterable[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches with a column ``text`` into pieces of about ``limit`` bytes; their texts as UTF-8 (null: empty)."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        column = pc.fill_null(batch.column(at), "").cast(pa.large_string()).cast(pa.large_binary())
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(ends):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(first, last - first), column.slice(first, last - first).to_pylist()
            first = last


class Words:
    """Words (runs without ASCII white space) of some texts: hashes, byte places, and each text's first word."""

    def __init__(self, found: list[bytes], lower: bool = False):
        self.buf = np.frombuffer(b"\n".join(found) + b"\n", np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        space = _SPACE[self.buf]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hash = stretch(rolling(self.buf), self.starts, self.ends)
        sizes = np.fromiter((len(x) + 1 for x in found), np.int64, len(found))
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))

    def grams(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on, ends of texts ignored."""
        n = max(0, len(self.hash) - size + 1)
        out = np.full(n, size, np.uint64)
        for j in range(size):
            out += self.hash[j : j + n] * _PLACE[j]
        return mix(out)

    def shingles(self, size: int) -> Iterator[np.ndarray]:
        """Each text's distinct shingles, ascending; a shorter text is one shingle, one without words has none."""
        grams = self.grams(size)
        for a, b in zip(self.first[:-1], self.first[1:]):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                yield mix((self.hash[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + _U(b - a))
            else:
                yield np.empty(0, np.uint64)
