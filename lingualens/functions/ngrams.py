"""Clipped n-gram matches of text pairs, in tasks."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Python workers need not have this package: ship the functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Rows whose tokens are numbered at once.
ROWS = 256


def codes_of(a: pa.Array, b: pa.Array, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each side: token numbers of all rows, and where each row starts.
    Texts, whose tokens are characters, or lists of tokens."""
    if kind == "char":
        rows = [[np.frombuffer(s.encode("utf-32-le"), "<u4") for s in c.to_pylist()] for c in (a, b)]
        codes = [np.concatenate(r).astype(np.int64) for r in rows]
        sizes = [[len(x) for x in r] for r in rows]
    else:
        flat = [c.flatten() for c in (a, b)]
        both = pa.concat_arrays(flat).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = [both[:len(flat[0])], both[len(flat[0]):]]
        sizes = [c.value_lengths().to_numpy(zero_copy_only=False) for c in (a, b)]
    return [(c, np.r_[0, np.cumsum(np.array(n, np.int64))]) for c, n in zip(codes, sizes)]


def _ranks(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Dense numbers of equal (major, minor)."""
    if not len(major):
        return np.zeros(0, np.int64)
    return np.unique(major * (int(minor.max()) + 1) + minor, return_inverse=True)[1].reshape(-1)


def matches(tokens: np.ndarray, pair: np.ndarray, side: np.ndarray, pairs: int, orders: Sequence[int]) -> np.ndarray:
    """(pairs x orders): sum over n-grams of the smaller of a pair's two counts.

    An n-gram is numbered by the number of its first n - 1 tokens and its last
    token, so an order takes memory for a number a token, whatever its n.
    """
    tokens = _ranks(np.zeros(len(tokens), np.int64), tokens)
    gram = _ranks(pair, tokens)
    start = np.arange(len(tokens))
    out = np.zeros((pairs, len(orders)), np.int64)
    for n in range(1, max(orders) + 1):
        if n > 1:
            ends = start + n - 1
            inside = ends < len(tokens)
            start, ends, gram = start[inside], ends[inside], gram[inside]
            inside = (pair[start] == pair[ends]) & (side[start] == side[ends])
            start, ends = start[inside], ends[inside]
            gram = _ranks(gram[inside], tokens[ends])
        if n in orders and len(start):
            size, on = int(gram.max()) + 1, side[start] == 0
            both = np.minimum(np.bincount(gram[on], minlength=size), np.bincount(gram[~on], minlength=size))
            owner = np.empty(size, np.int64)
            owner[gram] = pair[start]
            np.add.at(out[:, list(orders).index(n)], owner, both)
    return out


def counted(held: int, kind: str, orders: Sequence[int], size: int):
    """Batches of ``held`` columns and a pair of texts (or token lists) as
    batches of these columns and the pair's matches per order; pairs of
    together ``size`` tokens (or one longer pair) are counted at once."""
    orders = list(orders)

    def fn(batches):
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            (a, a_at), (b, b_at) = codes_of(batch.column(held), batch.column(held + 1), kind)
            ends, found, at = a_at + b_at, [], 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
                rows = np.arange(to - at)
                tokens = np.concatenate([a[a_at[at]:a_at[to]], b[b_at[at]:b_at[to]]])
                pair = np.concatenate([np.repeat(rows, np.diff(a_at[at:to + 1])), np.repeat(rows, np.diff(b_at[at:to + 1]))])
                side = np.r_[np.zeros(a_at[to] - a_at[at], np.int8), np.ones(b_at[to] - b_at[at], np.int8)]
                found.append(matches(tokens, pair, side, to - at, orders))
                at = to
            m = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:held], *[pa.array(m[:, i], pa.int64()) for i in range(len(orders))]],
                                             names=[*batch.schema.names[:held], *[f"m{n}" for n in orders]])
    return fn
