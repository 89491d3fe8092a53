"""Spelling variant grouping by dense prefix-suffix tiling.

1. Words (maximal runs of letters) are counted in tasks, added up, and kept
   from ``min_length`` code points and ``min_count`` occurrences on.
2. Two words are near if one inserted, deleted or replaced code point makes
   one the other: the length of their common prefix plus that of their common
   suffix reaches the longer one's length less one.  The edit lies in one of
   the windows that the shorter word's length is cut into, and all code points
   before and behind that window are equal.  So words meet by (shorter length,
   window, hash of what lies around it), as words of that length and of one
   more.
3. Words that meet form tiles of at most about two blocks of ``BLOCK`` words;
   a larger group becomes one tile for each pair of its blocks.  A tile's words
   are rows of padded code-point matrices, aligned left and right, and pairs of
   rows are compared at once.  A pair counts in the window of its first
   difference alone, so it is found once.
4. A word's form is its near word of largest count, if that is at least
   ``ratio`` times its own; forms are followed to the last by pointer doubling.
   Counts grow by ``ratio`` along a chain, so it ends, and five doublings
   reach the end of any chain of 64-bit counts.

Defined results: null and empty texts have no words; a null id is written as
the empty text in the hash of step 1; repeated rows count each; ties go to the
word that is smaller in code-point order; an empty table gives no rows; extra
columns play no part.  Words of any length are compared whole: the number of
windows stays at most ``WINDOWS``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import stored

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a code point (0: none).
DROP = 199
WIDTH, WINDOWS = 3, 8
BLOCK = 256
_FLUSH = 400_000
_CELLS = 1 << 22

_RUN = re.compile(rb"[a-z\xc0-\xff]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# ------------------------------------------------------------------- counting

def runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lowered, in Latin-1:
    a byte is a code point."""
    return _RUN.findall(text.encode("latin-1", "replace").translate(_LOWER))


def kept_form(run: bytes, seed: int, drop: int) -> bytes:
    """The run, or what is left of it without one code point."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % drop:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, drop: int = DROP) -> DataFrame:
    """word, n: the words of all texts and how often they occur."""
    def emit(total):
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        total: dict[bytes, int] = {}
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                for w, n in Counter(runs(text)).items():
                    if drop:
                        w = kept_form(w, seed, drop)
                    if len(w) >= min_length:
                        total[w] = total.get(w, 0) + n
                if len(total) > _FLUSH:
                    yield from emit(total)
                    total = {}
        yield from emit(total)

    per = docs.select(id_col, text_col).mapInArrow(run, "word string, n long")
    return per.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ------------------------------------------------------------------ near words

def _windows(size: Column) -> tuple[Column, Column]:
    """Width and number of the windows of a shorter length."""
    width = F.greatest(F.lit(WIDTH), F.ceil(size / WINDOWS).cast("int"))
    return width, F.ceil(size / width).cast("int")


def keyed(words: DataFrame) -> DataFrame:
    """size (the shorter length), window, around (hash), word, n: one row for
    each window of each length that the word may be compared at."""
    n = F.length("word")
    classes = words.where(n > 0).withColumn("size", F.explode(F.array(n, n - 1))).where("size > 0")
    width, count = _windows(F.col("size"))
    rows = classes.withColumn("width", width).withColumn("window", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("window") * F.col("width")
    behind = F.greatest(F.col("size") - start - F.col("width"), F.lit(0))
    around = F.xxhash64("size", "window", F.substring(F.col("word"), F.lit(1), start), F.substring(F.col("word"), n - behind + 1, behind))
    return rows.select("size", "window", around.alias("around"), "word", "n")


def tiles(words: DataFrame, block: int) -> DataFrame:
    """size, window, and the (word, n, second) of each tile; ``second`` tells
    the two blocks of a tile apart, and is false where it has one."""
    rows = keyed(words)
    key = ["size", "window", "around"]
    shorter = F.max(F.length("word") == F.col("size"))
    met = rows.groupBy(*key).agg(F.count("*").alias("members"), shorter.alias("any")).where("members > 1 AND any").drop("any")
    rows = rows.join(met, key).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    rows = rows.select(*key, lo, hi, F.struct("word", "n", (F.col("own") > F.least("own", "other")).alias("second")).alias("m"))
    return (rows.groupBy(*key, "lo", "hi").agg(F.collect_list("m").alias("m"))
            .select("size", "window", F.col("lo").eqNullSafe(F.col("hi")).alias("one"), "m"))


def _matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned left and (reversed) right, padded with zeros, and lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    left = np.zeros((len(words), width), np.uint32)
    right = np.zeros((len(words), width), np.uint32)
    left[row, at] = flat + 1  # no code point is the padding
    right[row, size[row] - 1 - at] = flat + 1
    return left, right, size


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the equal beginnings of the rows."""
    same = a == b
    n = same.argmin(axis=1)
    n[same.all(axis=1)] = a.shape[1]
    return n


def near_in_tiles(size: int, window: np.ndarray, one: np.ndarray, first: np.ndarray, words: list[str],
                  second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the near pairs of tiles of one size.

    ``first[t]:first[t + 1]`` are the rows of tile t; in a tile of two blocks
    the rows of the second one come last.
    """
    left, right, length = _matrices(words, size + 1)
    tile = np.repeat(np.arange(len(first) - 1), np.diff(first))
    i = np.arange(len(words))
    firsts = np.bincount(tile, ~second, len(first) - 1).astype(np.int64)
    begin = np.where(one[tile], i + 1, np.where(second, first[tile + 1], first[tile] + firsts[tile]))
    count = first[tile + 1] - begin
    width = max(WIDTH, -(-size // WINDOWS))
    last = -(-size // width) - 1
    found_a, found_b = [], []
    upto, at, step = np.cumsum(count), 0, max(1, _CELLS // (size + 1))
    total = int(upto[-1]) if len(upto) else 0
    while at < total:
        pair = np.arange(at, min(at + step, total))
        a = np.searchsorted(upto, pair, "right")
        b = begin[a] + pair - (upto[a] - count[a])
        at += step
        # Words of the longer length meet each other at that length.
        ok = (length[a] == size) | (length[b] == size)
        a, b = a[ok], b[ok]
        p = _common(left[a], left[b])
        ok = np.minimum(p // width, last) == window[tile[a]]
        a, b, p = a[ok], b[ok], p[ok]
        longer = np.maximum(length[a], length[b])
        ok = (p + _common(right[a], right[b]) >= longer - 1) & (p < longer)
        found_a.append(a[ok])
        found_b.append(b[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, near, near_n: both directions of every pair of near words of a
    table (word, n) of distinct words."""
    def run(batches):
        for batch in batches:
            m = batch.column("m").combine_chunks() if isinstance(batch.column("m"), pa.ChunkedArray) else batch.column("m")
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            windows = batch.column("window").to_numpy(zero_copy_only=False)
            ones = batch.column("one").to_numpy(zero_copy_only=False)
            offs = np.asarray(m.offsets, np.int64)
            flat = m.values
            word, n = flat.field("word"), flat.field("n").to_numpy(zero_copy_only=False)
            second = flat.field("second").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                todo = np.flatnonzero(sizes == size)
                per = max(1, _CELLS // (size + 1))
                cut = np.flatnonzero(np.diff(np.cumsum(offs[todo + 1] - offs[todo]) // per, prepend=-1))
                for t in np.split(todo, cut[1:]):
                    count = offs[t + 1] - offs[t]
                    first = np.concatenate([[0], np.cumsum(count)])
                    rows = np.repeat(offs[t] - first[:-1], count) + np.arange(first[-1])
                    # The second block's rows last, tile by tile.
                    rows = rows[np.lexsort((second[rows], np.repeat(np.arange(len(t)), count)))]
                    own = word.take(pa.array(rows))
                    a, b = near_in_tiles(size, windows[t], ones[t], first, own.to_pylist(), second[rows])
                    a, b = np.concatenate([a, b]), np.concatenate([b, a])
                    if len(a):
                        yield pa.RecordBatch.from_arrays([own.take(pa.array(a)), own.take(pa.array(b)), pa.array(n[rows[b]])],
                                                         names=["word", "near", "near_n"])

    return tiles(words, block).mapInArrow(run, "word string, near string, near_n long")


# ---------------------------------------------------------------------- groups

def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that forms (word, form) lead to."""
    links = stored(forms.select("word", F.col("form").alias("root")))
    for _ in range(5):
        on = links.select(F.col("word").alias("at"), F.col("root").alias("further"))
        joined = links.join(on, F.col("root") == F.col("at"), "left")
        if joined.where("at is not null").isEmpty():
            break
        links = stored(joined.select("word", F.coalesce("further", "root").alias("root")))
    return links


def variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a table (word, n)."""
    words = stored(words.select("word", "n"))
    near = near_pairs(words, block).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    held = F.col("n_near").isNotNull() & (-F.col("best.minus") >= ratio * F.col("n"))
    found = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(held, F.col("best.near")).alias("form"), F.when(held, -F.col("best.minus")).alias("form_n")))
    return (found.join(roots(found.where("form is not null")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants(word_counts(docs, id_col, text_col))
