"""Edit distance between token lists, bit-parallel.

A column of the distance matrix is kept as the signs of its steps, in two
integers with a bit for each reference token, and one hypothesis token moves it
by a few operations on these integers.  Tokens are compared as they are, so
there is no limit on the number of different ones, and memory is linear.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle

# Used in Python workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of token masks that are kept; others are made anew when needed.
MASK_BYTES = 64 << 20


class _Masks:
    """For each token of a list, an integer with the bits of its places."""

    def __init__(self, tokens: Sequence[str]):
        self.size, self.places, self.kept = len(tokens) // 8 + 1, {}, {}
        for k, t in enumerate(tokens):
            self.places.setdefault(t, []).append(k)

    def __getitem__(self, token: str) -> int:
        mask = self.kept.get(token)
        if mask is None:
            bits = bytearray(self.size)
            for k in self.places.get(token, ()):
                bits[k >> 3] |= 1 << (k & 7)
            mask = int.from_bytes(bits, "little")
            if (len(self.kept) + 1) * self.size <= MASK_BYTES:
                self.kept[token] = mask
        return mask


def token_edits(hyp: Sequence[str], ref: Sequence[str]) -> int:
    """Least number of inserted, deleted and replaced tokens."""
    a, b = 0, 0
    while a < len(hyp) and a < len(ref) and hyp[a] == ref[a]:
        a += 1
    while b < len(hyp) - a and b < len(ref) - a and hyp[-1 - b] == ref[-1 - b]:
        b += 1
    hyp, ref = hyp[a:len(hyp) - b], ref[a:len(ref) - b]
    if not hyp or not ref:
        return len(hyp) + len(ref)
    masks, full, last = _Masks(ref), (1 << len(ref)) - 1, 1 << (len(ref) - 1)
    up, down, score = full, 0, len(ref)
    for token in hyp:
        x = masks[token] | down
        diagonal = ((((x & up) + up) ^ up) | x) & full
        falls, rises = up & diagonal, down | (full & ~(up | diagonal))
        score += (rises & last > 0) - (falls & last > 0)
        rises = ((rises << 1) | 1) & full
        up = ((falls << 1) & full) | (full & ~(diagonal | rises))
        down = rises & diagonal
    return score
