"""Best-fit packing: pattern packing by non-negative least squares.

1. Texts are tokenized in tasks, once, and cut into pieces of at most
   ``seq_len`` tokens (only longer documents are cut).
2. The histogram of piece lengths (at most ``seq_len`` rows) goes to the driver.
3. Every pattern of at most ``depth`` lengths that fills a sequence exactly is
   enumerated; repeat counts are fitted to the histogram by non-negative least
   squares, rounded, and held to what the histogram has.
4. What is left over is packed best-fit, longest first, still on counts.
5. The plan (groups of equal sequences) becomes slots per length.  Pieces are
   numbered within their length, in hashed cells, so that a hot length is
   spread over many tasks, and each number is looked up in the slots.

The driver's work depends on ``seq_len`` and ``depth`` alone, not on the data.

Defined results: a null text is empty; an empty text is one piece holding the
end id; repeated rows are packed each; null ids are kept; other columns play
no part; an empty table gives no sequences.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textbytes import LOWER, blocks, give_back, mix, padded, span_hash, utf8
from .workspace import stored

SEQ_LEN = 2048
#: Texts encoded at once; each byte takes some 60 bytes of arrays.
BLOCK_BYTES = 1 << 18
PIECES = "piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- tokenizing

def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


#: Classes of the characters that the fast path splits by itself: letter,
#: number, white space, other.  Any other character sends its text to the
#: tokenizer whole, as do the strings of special tokens.
_LETTER, _NUMBER, _SPACE, _OTHER, _SLOW = range(5)
_FAST_END = 0x2100


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(_FAST_END + 1, _SLOW, np.uint8)
    lower = np.arange(_FAST_END + 1, dtype=np.uint32)
    for c in [*range(0x300), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0)]:
        s = chr(c)
        cat = unicodedata.category(s)
        if len(s.lower()) != 1 or cat == "Cn":
            continue
        lower[c] = ord(s.lower())
        kind[c] = (_SPACE if c in (32, 0x85, 0xA0) or 9 <= c <= 13 else
                   _LETTER if cat[0] == "L" else _NUMBER if cat[0] == "N" else _OTHER)
    return kind, lower


class WordCache:
    """Token ids of the words met so far in this worker, by a hash of the word."""

    LIMIT = 300_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(x.content) for x in self.tok.get_added_tokens_decoder().values()) or r"(?!)")
        self.clear()

    def clear(self):
        self.key = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def word_ids(self, word: str) -> list[int]:
        """Ids of one lower-cased word: the tokenizer's own model, without the
        normalizer and splitter that have nothing left to do."""
        if not (word.isascii() and word.isprintable()):
            word = "".join(part for part, _ in self.tok.pre_tokenizer.pre_tokenize_str(word))
        return [t.id for t in self.tok.model.tokenize(word)]

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        if len(self.key) + len(keys) > self.LIMIT:
            self.clear()
        ids = [self.word_ids(w) for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, np.fromiter((x for y in ids for x in y), np.uint32, int(size.sum()))])
        order = np.argsort(np.concatenate([self.key, keys]), kind="stable")
        self.key = np.concatenate([self.key, keys])[order]
        self.at = np.concatenate([self.at, at])[order]
        self.size = np.concatenate([self.size, size])[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        i = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return i, self.key[i] == keys


@lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordCache(path)


def encode_texts(cache: WordCache, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of ``texts`` in order, and the number of each text's ids.

    Words are found for all texts at once, and only words not met before are
    given to the tokenizer; texts with unusual characters are given whole.
    """
    kind, lower = _tables()
    sep = "\n".join(texts)
    code = np.frombuffer(sep.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + 1) - size - 1
    small = np.minimum(code, _FAST_END)
    cls = kind[small]
    slow = np.zeros(len(texts), bool)
    odd = np.flatnonzero(cls == _SLOW)
    slow[np.searchsorted(begin, odd, "right") - 1] = True
    slow[[i for i, t in enumerate(texts) if "<|" in t and cache.special.search(t)]] = True
    low = lower[small]
    n = len(low)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    new = np.ones(n, bool)
    new[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == _NUMBER)
    quote = np.flatnonzero((low == 39) & new)
    if len(quote):
        ext = np.concatenate([low, np.zeros(3, np.uint32)])
        a, b = ext[quote + 1], ext[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for at, k in ((quote[one], 2), (quote[two & ~one], 3)):
            new[at + 1] = False
            stop = at + k
            new[stop[stop < n]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    word = cls[start] != _SPACE
    start, end = start[word], end[word]
    owner = np.searchsorted(begin, start, "right") - 1
    word = ~slow[owner]
    start, end, owner = start[word], end[word], owner[word]
    pad = padded(low.view(np.uint8))
    key = span_hash(pad, start * 4, end * 4)
    first, inverse = np.unique(key, return_index=True, return_inverse=True)[1:]
    keys = key[first]
    _, known = cache.find(keys)
    miss = np.flatnonzero(~known)
    if len(miss):
        words = low.tobytes()
        cache.learn(keys[miss], [words[4 * a:4 * b].decode("utf-32-le", "surrogatepass")
                                 for a, b in zip(start[first[miss]].tolist(), end[first[miss]].tolist())])
        at, known = cache.find(keys)
        if not known.all():  # the cache was emptied meanwhile
            miss = np.flatnonzero(~known)
            cache.learn(keys[miss], [words[4 * a:4 * b].decode("utf-32-le", "surrogatepass")
                                     for a, b in zip(start[first[miss]].tolist(), end[first[miss]].tolist())])
            at, known = cache.find(keys)
    else:
        at, _ = cache.find(keys)
    n_ids = cache.size[at][inverse]
    from_ = cache.at[at][inverse]
    total = np.bincount(owner, n_ids, len(texts)).astype(np.int64)
    whole = np.flatnonzero(slow)
    if not len(whole):
        ids = cache.pool[_ranges(from_, n_ids)]
        return ids, total
    given = dict(zip(whole.tolist(), cache.encode([texts[i] for i in whole])))
    for i, ids in given.items():
        total[i] = len(ids)
    out = np.zeros(int(total.sum()), np.uint32)
    put = np.cumsum(total) - total
    inside = np.cumsum(n_ids) - n_ids
    word_first = np.searchsorted(owner, np.arange(len(texts)))
    base = inside[np.minimum(word_first, max(0, len(inside) - 1))] if len(inside) else np.zeros(len(texts), np.int64)
    if len(owner):
        out[_ranges(put[owner] + inside - base[owner], n_ids)] = cache.pool[_ranges(from_, n_ids)]
    for i, ids in given.items():
        out[put[i]:put[i] + len(ids)] = ids
    return out, total


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0]..start[0]+size[0]-1, start[1].. in one array."""
    stop = np.cumsum(size)
    return np.repeat(start - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN,
           tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """id, piece, start, length and CRC-32 of every piece of every text."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        cache = word_cache(path)
        for batch in batches:
            _, offs = utf8(batch.column(1))
            col = batch.column(1)
            for i, j in blocks(offs, BLOCK_BYTES):
                texts = [t or "" for t in col.slice(i, j - i).to_pylist()]
                ids, total = encode_texts(cache, texts)
                row, piece, start, length, crc = [], [], [], [], []
                at = 0
                for d, k in enumerate(total.tolist()):
                    own = np.append(ids[at:at + k], np.uint32(end_id))
                    at += k
                    for p, a in enumerate(range(0, k + 1, seq_len)):
                        part = own[a:a + seq_len]
                        row.append(i + d)
                        piece.append(p)
                        start.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.astype("<u4", copy=False).tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"])
        cache.clear()  # the worker is kept for later stages
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, {PIECES}")


# ------------------------------------------------------------------ planning

def patterns(have: np.ndarray, seq_len: int, depth: int) -> np.ndarray:
    """Ascending lengths (0: unused) of all patterns that fill a sequence
    exactly with at most ``depth`` (up to 3) of the lengths at hand."""
    out = []
    if have[seq_len]:
        out.append([[0, 0, seq_len]])
    a = np.flatnonzero(have)
    if depth >= 2:
        x = a[(2 * a <= seq_len) & (a < seq_len)]
        x = x[have[seq_len - x]]
        out.append(np.column_stack([np.zeros_like(x), x, seq_len - x]))
    if depth >= 3:
        for x in a[3 * a <= seq_len]:
            y = a[(a >= x) & (x + 2 * a <= seq_len)]
            y = y[have[seq_len - x - y]]
            out.append(np.column_stack([np.full_like(y, x), y, seq_len - x - y]))
    return np.concatenate([np.asarray(x, np.int64).reshape(-1, 3) for x in out]) if out else np.zeros((0, 3), np.int64)


def fit(pats: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|, weighted by length
    (a piece left over costs its room), by accelerated projected gradients."""
    if not len(pats):
        return np.zeros(0)
    n = len(counts)
    scale = max(1.0, counts.max())
    b = counts / scale
    w = np.arange(n) / (n - 1.0)
    w[0] = 0.0
    w2 = w * w

    def times(x):
        y = np.bincount(pats.ravel(), np.repeat(x, 3), n)
        y[0] = 0.0
        return y

    def back(r):
        r = r * w2
        r[0] = 0.0
        return r[pats].sum(1)

    v = np.ones(len(pats))
    for _ in range(20):  # largest eigenvalue of A' W A
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1.0 / (1.05 * norm)
    x = z = np.zeros(len(pats))
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(0.0, z - step * back(times(z) - b))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x * scale


def plan(hist: dict[int, int], seq_len: int = SEQ_LEN, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Groups (lengths of a sequence, number of such sequences): the fitted
    repeat counts rounded, or rounded down, and the residuals best-fit;
    whichever needs fewer sequences, and no more than best-fit alone."""
    counts = np.zeros(seq_len + 1, np.int64)
    for k, v in hist.items():
        counts[k] = v
    pats = patterns(counts > 0, seq_len, depth)
    x = fit(pats, counts.astype(float))
    tried = [rounded(pats, counts, r(x).astype(np.int64), seq_len) for r in (np.rint, np.floor, np.zeros_like)]
    return min(tried, key=lambda groups: sum(k for _, k in groups))


def rounded(pats: np.ndarray, counts: np.ndarray, x: np.ndarray, seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts, largest first, held to what is left of each
    length, and the residuals packed best-fit."""
    groups: list[tuple[tuple[int, ...], int]] = []
    left = counts.copy()
    for i in np.lexsort((np.arange(len(x)), -x)):
        if x[i] < 1:
            break
        own = [int(v) for v in pats[i] if v]
        r = min(int(x[i]), *(int(left[v]) // own.count(v) for v in own))
        if r > 0:
            for v in own:
                left[v] -= r
            groups.append((tuple(own), r))
    return groups + best_fit(left, seq_len)


def best_fit(counts: np.ndarray, seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal sequences are handled as one group."""
    room: dict[int, list[list]] = {}  # free tokens -> [lengths, number]

    def put(free: int, lengths: tuple[int, ...], k: int):
        room.setdefault(free, []).append([lengths, k])

    for size in range(seq_len, 0, -1):
        todo = int(counts[size])
        while todo:
            fits = [f for f in room if f >= size]
            if not fits:
                each = min(seq_len // size, todo)
                k = todo // each
                put(seq_len - each * size, (size,) * each, k)
                todo -= each * k
                continue
            f = min(fits)
            lengths, k = room[f].pop()
            if not room[f]:
                del room[f]
            each = min(f // size, todo)
            use = min(k, todo // each)
            if use < k:
                put(f, lengths, k - use)
            put(f - each * size, lengths + (size,) * each, use)
            todo -= each * use
    return [(tuple(lengths), k) for v in room.values() for lengths, k in v]


def slots(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first number of each run of slots, first sequence, offset."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for lengths, k in groups:
        at = 0
        for v in lengths:
            out.setdefault(v, []).append((used.get(v, 0), first, at))
            used[v] = used.get(v, 0) + k
            at += v
        first += k
    return {v: tuple(np.array(x, np.int64) for x in zip(*rows)) for v, rows in out.items()}


# ------------------------------------------------------------------- placing

def pack(found: DataFrame, *, seq_len: int = SEQ_LEN, depth: int = 3, rows_per_cell: int = 20_000) -> DataFrame:
    """Give every piece (id, piece, start, length, ids_crc32) its sequence_id
    and offset.  ``found`` is read twice and should be a stored table."""
    spark = found.sparkSession
    hist = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= seq_len rows
    sent = spark.sparkContext.broadcast(slots(plan(hist, seq_len, depth)))
    cells = max(256, -(-max(hist.values(), default=0) // rows_per_cell))
    cell = found.withColumn("cell", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(cells)))
    before = (cell.groupBy("length", "cell").agg(F.count("*").alias("n"))
              .select("length", "cell", (F.sum("n").over(
                  Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))).alias("before")))
    own = Window.partitionBy("length", "cell").orderBy("id", "piece", "start", "ids_crc32")
    numbered = (cell.withColumn("nr", F.row_number().over(own)).join(before, ["length", "cell"])
                .select("id", "piece", "start", "length", "ids_crc32",
                        (F.col("nr") - 1 + F.coalesce("before", F.lit(0))).alias("nr")))

    def place(batches):
        table = sent.value
        for batch in batches:
            length, nr = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            seq, off = np.zeros(len(nr), np.int64), np.zeros(len(nr), np.int64)
            order = np.argsort(length, kind="stable")
            cut = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cut) if len(order) else []:
                first, base, at = table[int(length[rows[0]])]
                k = np.searchsorted(first, nr[rows], "right") - 1
                seq[rows], off[rows] = base[k] + nr[rows] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)],
                                             names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = found.schema["id"].dataType.simpleString()
    return numbered.mapInArrow(place, f"id {kind}, {PIECES}, sequence_id long, offset long")


def packed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN,
           depth: int = 3, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their places."""
    found = stored(pieces(docs, id_col=id_col, text_col=text_col, seq_len=seq_len, tokenizer=tokenizer))
    return pack(found, seq_len=seq_len, depth=depth).withColumnRenamed("id", id_col)
