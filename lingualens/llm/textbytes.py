"""Vectorised views of Arrow string batches: bytes, words, word hashes.

Texts arrive in tasks as Arrow batches; their UTF-8 buffers are read as numpy
arrays without making Python strings.  Work goes block by block so that the
arrays stay small whatever the batch size; a block never splits a text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

BLOCK_BYTES = 1 << 19
_M1, _M2, _GOLD = (np.uint64(x) for x in
                   (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, lower-case letters (A-Z are lowered first) and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if len(col) == 0 or pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(offs, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offs


def give_back() -> None:
    """Return freed memory to the system: a Python worker is kept for the
    stages that follow, and what it holds then counts beside them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def blocks(offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def padded(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 8, np.uint8)
    out[:len(buf)] = buf
    return out


def span_hash(pad: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step; ``pad`` ends in 8 spare bytes."""
    eight = np.ndarray(max(0, len(pad) - 7), "<u8", pad, strides=(1,))
    size = end - start
    h = mix(size.astype(np.uint64) * _GOLD + np.uint64(seed))
    if not len(h):
        return h
    h = mix(h ^ (eight[start] & _TAIL[np.minimum(size, 8)]))
    done, todo = 8, np.flatnonzero(size > 8)
    while len(todo):
        left = np.minimum(size[todo] - done, 8)
        h[todo] = mix(h[todo] ^ (eight[start[todo] + done] & _TAIL[left]))
        done += 8
        todo = todo[size[todo] > done]
    return h


class Words:
    """Words of a block of texts.

    ``low``: lower-cased bytes (8 spare at the end); ``start``/``end``: byte
    spans in it; ``first[d]:first[d+1]``: the words of text ``d``; ``hash``.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, is_word: np.ndarray):
        buf, rel = data[offs[0]:offs[-1]], offs - offs[0]
        n = len(buf)
        self.low = padded(LOWER[buf])
        w = is_word[buf]
        edge = np.zeros(n + 1, bool)
        edge[rel] = True
        before = np.zeros(n, bool)
        before[1:] = w[:-1]
        after = np.zeros(n, bool)
        after[:-1] = w[1:]
        self.start = np.flatnonzero(w & (~before | edge[:-1]))
        self.end = np.flatnonzero(w & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, rel)
        self.hash = span_hash(self.low, self.start, self.end)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one text."""
        n = len(self.hash)
        g, ok = self.hash.copy(), np.ones(n, bool)
        if k > 1:
            for j in range(1, k):
                g[:max(0, n - j)] = mix(g[:max(0, n - j)] * _GOLD + self.hash[j:])
            late = np.maximum(self.first[1:, None] - np.arange(1, k), self.first[:-1, None])
            ok[late[(late < self.first[1:, None])]] = False
        return g, ok

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by a space."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b]))


def append(df: DataFrame, text_col: str, fn: Callable[[pa.RecordBatch], pa.Array],
           kind: StructType, name: str, drop_text: bool = False) -> DataFrame:
    """``df`` with a struct column ``name`` that ``fn`` makes from each Arrow batch."""
    schema = StructType([f for f in df.schema.fields if not (drop_text and f.name == text_col)]
                        + [StructField(name, kind)])

    def run(batches):
        for batch in batches:
            cols = [batch.column(i) for i, f in enumerate(batch.schema) if not (drop_text and f.name == text_col)]
            names = [f.name for f in batch.schema if not (drop_text and f.name == text_col)]
            yield pa.RecordBatch.from_arrays([*cols, fn(batch)], names=[*names, name])
        give_back()

    return df.mapInArrow(run, schema)


def lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """List column from the number of values of each row and all values in order."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), values)
