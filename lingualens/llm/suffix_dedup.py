"""Removal of repeated passages by a hash-compared suffix sort.

Every byte covered by a string of ``SPAN`` (200) bytes that starts anywhere
else too is removed; strings are judged on the input, texts are UTF-8 bytes,
and no string crosses texts.  Sorting all suffixes of a corpus would shuffle it
many times over, so the sort gets only those that can matter:

1. **Anchors.**  Of each 200-byte window the smallest ``GRAM``-byte hash
   (leftmost on ties) is its anchor.  Equal windows have equal anchors at equal
   places, so every window belongs to one anchor, and an anchor to a run of
   windows.  An anchor that occurs once rules out all of its windows.
2. **Classes.**  Repeated anchors are grouped by the bytes of all their windows
   together (128 bits of hash).  A class of several occurrences is repeated as
   a whole; this settles the inside of every copied passage.
3. **Segments.**  What is left are the edges of passages: classes with one
   occurrence beside others with the same anchor.  Their windows are cut into
   segments of ``STEP`` starts; all windows of a segment share a core, and
   segments whose core occurs once are dropped.
4. **Suffix sort.**  Within a segment's group, suffixes are ordered by a
   mergesort.  Two suffixes are compared by their common extension, found by
   binary search over prefix polynomial hashes, and the byte after it.
   Neighbours with 200 bytes in common are repeated, once those bytes have
   been compared as well (collision verification).

Groups of more than ``group_rows`` classes (an edge of a passage that a large
share of all texts has) are not gathered: their windows are counted by 128
bits of hash, summed before the shuffle.

Exact copies are found by a hash of the text and counted once, so a text with
a copy goes whole.  Shuffles carry hashes; texts are fetched for edges and for
the final cut only, through a bitmap of fixed size.

Defined results: null texts are empty; texts under 200 bytes keep all;
repeated rows are copies of each other; null ids are kept; other columns play
no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import blocks, mix, padded, span_hash, utf8
from .workspace import bitmap, maybe_in, stored

SPAN, GRAM, STEP = 200, 48, 16
GROUP_ROWS = 4096
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_POS_BITS = np.uint64(21)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2 ** 64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class PrefixHash:
    """Polynomial hashes of all substrings of a buffer."""

    _cache: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def __init__(self, buf: np.ndarray):
        n = len(buf) + 1
        if len(PrefixHash._cache[0]) < n:
            PrefixHash._cache = _powers(max(n, 1 << 16))
        power, self.inverse = (p[:n] for p in PrefixHash._cache)
        self.sum = np.zeros(n, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.sum[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sum[start + size] - self.sum[start]) * self.inverse[start]


# ------------------------------------------------------------------- anchors

def anchors_of(data: np.ndarray, offs: np.ndarray):
    """doc, a (anchor's place), lo, hi (first and last start of its windows), h, c for the texts of a block."""
    buf = data[offs[0]:offs[-1]]
    rel = offs - offs[0]
    n, w = len(buf), SPAN - GRAM + 1
    if n < SPAN:
        return None
    doc = np.repeat(np.arange(len(rel) - 1), np.diff(rel))
    left = rel[1:][doc] - np.arange(n)  # bytes from each place to the end of its text
    start = np.flatnonzero(left >= SPAN)
    if not len(start):
        return None
    hashes = PrefixHash(buf)
    g = mix(hashes.of(np.arange(n - GRAM + 1), GRAM))
    mask = (np.uint64(1) << _POS_BITS) - np.uint64(1)
    pos = np.arange(len(g), dtype=np.uint64)
    key = (g & ~mask) | pos
    pad = (-len(key)) % w
    rows = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1]).ravel()
    own = (np.minimum(back[start], ahead[start + w - 1]) & mask).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    a, lo, hi = own[first], start[first], start[last]
    c = span_hash(padded(buf), lo, hi + SPAN) ^ mix((a - lo).astype(np.uint64))
    return doc[lo], a, lo, hi, g[a], c


def slices(data: np.ndarray, offs: np.ndarray):
    """Blocks of texts; a long text in slices that overlap by a window less one byte."""
    for i, j in blocks(offs, CHUNK):
        if j == i + 1 and offs[j] - offs[i] > 2 * CHUNK:
            for a in range(int(offs[i]), int(offs[j]) - SPAN + 1, CHUNK):
                yield i, int(a - offs[i]), np.array([a, min(int(offs[j]), a + CHUNK + SPAN - 1)])
        else:
            yield i, 0, offs[i:j + 1]


def anchors(texts: DataFrame) -> DataFrame:
    """h, c, t1, t2, a, lo, hi of every text (columns t1, t2, t)."""

    def run(batches):
        for batch in batches:
            data, offs = utf8(batch.column(2))
            t = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            for i, at, own in slices(data, offs):
                got = anchors_of(data, own)
                if got is None:
                    continue
                doc, a, lo, hi, h, c = got
                base = (own - own[0])[doc] - at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(t[0][i + doc]), pa.array(t[1][i + doc]),
                     *[pa.array((x - base).astype(np.int32)) for x in (a, lo, hi)]], names=["h", "c", "t1", "t2", "a", "lo", "hi"])

    return texts.select("t1", "t2", "t").mapInArrow(run, "h long, c long, t1 long, t2 long, a int, lo int, hi int")


# --------------------------------------------------------------- suffix sort

class Suffixes:
    """Suffixes of a buffer, compared by prefix hashes and binary search."""

    def __init__(self, buf: np.ndarray, span: int = SPAN):
        self.buf, self.span, self.hash = buf, span, PrefixHash(buf)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, at most ``span``."""
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), self.span, np.int64)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) >> 1
            same = self.hash.of(x, mid) == self.hash.of(y, mid)
            lo = np.where(open_ & same, mid, lo)
            hi = np.where(open_ & ~same, mid - 1, hi)

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        k = self.common(x, y)
        end = k >= self.span
        k = np.minimum(k, self.span - 1)
        return np.where(end, or_equal, self.buf[x + k] < self.buf[y + k])

    def sort(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mergesort of suffixes ``x`` within consecutive groups of ``size``:
        at each level every element finds its rank in the neighbouring run."""
        x = x.copy()
        first = np.repeat(np.cumsum(size) - size, size)
        total = np.repeat(size, size)
        local = np.arange(len(x)) - first
        run = 1
        while run < (size.max() if len(size) else 0):
            block = local // run
            other = (block ^ 1) * run
            act = np.flatnonzero(other < total)
            b0 = first[act] + other[act]
            lo, hi = b0.copy(), first[act] + np.minimum(other[act] + run, total[act])
            after = (block[act] & 1).astype(bool)  # of equal ones the left run comes first
            todo = np.arange(len(act))
            while len(todo):
                mid = (lo[todo] + hi[todo]) >> 1
                before = self.less(x[mid], x[act[todo]], after[todo])
                lo[todo] = np.where(before, mid + 1, lo[todo])
                hi[todo] = np.where(before, hi[todo], mid)
                todo = todo[lo[todo] < hi[todo]]
            place = np.arange(len(x))
            place[act] = first[act] + (block[act] >> 1) * 2 * run + (local[act] - block[act] * run) + (lo - b0)
            y = np.empty_like(x)
            y[place] = x
            x = y
            run *= 2
        return x

    def repeated(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Suffixes whose ``span`` bytes occur twice in their group."""
        s = self.sort(x, size)
        inner = np.ones(len(s), bool)
        inner[np.cumsum(size) - size] = False
        i = np.flatnonzero(inner)
        i = i[self.common(s[i - 1], s[i]) >= self.span]
        same = np.ones(len(i), bool)  # the bytes themselves, eight at a time
        eight = np.ndarray(len(self.buf) - 7, "<u8", self.buf, strides=(1,))
        for k in [*range(0, self.span - 7, 8), self.span - 8]:
            same &= eight[s[i - 1] + k] == eight[s[i] + k]
        i = i[same]
        return np.unique(np.concatenate([s[i - 1], s[i]]))


# ------------------------------------------------------------------ segments

_WIDTH = SPAN + STEP - 1
_MEMBER = "g1 long, g2 long, t1 long, t2 long, q long, mask int, s binary"


def segments(edges: DataFrame, with_bytes: bool) -> DataFrame:
    """Segments of the classes listed with each text (columns t1, t2, t and
    ``want``, a list of a, lo, hi, h): group (g1, g2), text, first start q,
    bit mask of the starts that count, and the segment's bytes."""

    def run(batches):
        for batch in batches:
            data, offs = utf8(batch.column(2))
            t = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            want = batch.column(3)
            flat = want.flatten()
            a, lo, hi, h = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            doc = np.repeat(np.arange(len(want)), np.diff(want.offsets.to_numpy()))
            g_lo, g_hi = (a - hi) // STEP, (a - lo) // STEP
            n = g_hi - g_lo + 1
            row = np.repeat(np.arange(len(a)), n)
            g = np.repeat(g_lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            q = a[row] - STEP * g - (STEP - 1)
            j0, j1 = np.maximum(lo[row] - q, 0), np.minimum(hi[row] - q, STEP - 1)
            mask = (np.int64(1) << (j1 + 1)) - (np.int64(1) << j0)
            core = offs[doc[row]] + q + STEP - 1
            g1 = span_hash(padded(data), core, core + SPAN - STEP + 1) ^ mix(g.astype(np.uint64))
            step = 4096
            for b in range(0, len(row), step):
                r = slice(b, b + step)
                cols = [pa.array(g1[r].view(np.int64)), pa.array(h[row[r]]), pa.array(t[0][doc[row[r]]]),
                        pa.array(t[1][doc[row[r]]]), pa.array(q[r]), pa.array(mask[r].astype(np.int32))]
                if with_bytes:
                    own = np.zeros((len(q[r]), _WIDTH), np.uint8)
                    for x, (d, p) in enumerate(zip(doc[row[r]].tolist(), q[r].tolist())):
                        a0, a1 = max(0, p), min(int(offs[d + 1] - offs[d]), p + _WIDTH)
                        own[x, a0 - p:a1 - p] = data[offs[d] + a0:offs[d] + a1]
                    cols.append(pa.array([v.tobytes() for v in own], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["g1", "g2", "t1", "t2", "q", "mask", "s"][:len(cols)])

    return edges.select("t1", "t2", "t", "want").mapInArrow(run, _MEMBER if with_bytes else _MEMBER.replace(", s binary", ""))


def _windows(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and start (0 to STEP - 1) of every set bit."""
    return np.nonzero((mask[:, None] >> np.arange(STEP)) & 1)


def _found(t1, t2, q, row, j) -> pa.RecordBatch:
    """Runs of adjacent starts as windows (t1, t2, lo, hi)."""
    order = np.lexsort((j, row))
    row, j = row[order], j[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (j[1:] != j[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1 if len(row) else first
    r = row[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(t1[r]), pa.array(t2[r]), pa.array((q[r] + j[first]).astype(np.int32)), pa.array((q[r] + j[last]).astype(np.int32))],
        names=["t1", "t2", "lo", "hi"])


def sorted_groups(members: DataFrame) -> DataFrame:
    """t1, t2, lo, hi: repeated windows within groups, by the suffix sort."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        g1, g2, t1, t2, q, mask = (table.column(k).to_numpy() for k in ("g1", "g2", "t1", "t2", "q", "mask"))
        buf = np.frombuffer(b"".join(table.column("s").to_pylist()) + bytes(8), np.uint8)
        row, j = _windows(mask.astype(np.int64))
        new = np.ones(len(g1), bool)
        new[1:] = (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])
        group = np.cumsum(new)[row] * STEP + j
        order = np.argsort(group, kind="stable")
        size = np.unique(group, return_counts=True)[1]
        x = Suffixes(buf).repeated((row * _WIDTH + j)[order], size)
        return _found(t1, t2, q, x // _WIDTH, x % _WIDTH)

    def run(batches):
        held = None
        for batch in batches:  # groups are adjacent; the last one may go on
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            g1, g2 = (table.column(k).to_numpy() for k in ("g1", "g2"))
            cut = np.flatnonzero((g1 != g1[-1]) | (g2 != g2[-1])) if len(g1) else []
            cut = int(cut[-1]) + 1 if len(cut) else 0
            if cut:
                yield settle(table.slice(0, cut).combine_chunks())
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield settle(held.combine_chunks())

    return members.repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(run, "t1 long, t2 long, lo int, hi int")


def counted_groups(members: DataFrame) -> DataFrame:
    """The same for large groups: windows counted by 128 bits of hash."""

    def explode(batches):
        for batch in batches:
            buf = np.frombuffer(b"".join(batch.column(6).to_pylist()) + bytes(8), np.uint8)
            row, j = _windows(batch.column(5).to_numpy().astype(np.int64))
            x = row * _WIDTH + j
            w1 = span_hash(buf, x, x + SPAN) ^ mix(j.astype(np.uint64))
            w2 = mix(PrefixHash(buf).of(x, SPAN) ^ w1)
            cols = [batch.column(k).take(pa.array(row)) for k in (0, 1, 2, 3)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array((batch.column(4).to_numpy()[row] + j).astype(np.int32)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))],
                names=["g1", "g2", "t1", "t2", "w", "w1", "w2"])

    rows = members.mapInArrow(explode, "g1 long, g2 long, t1 long, t2 long, w int, w1 long, w2 long")
    key = ["g1", "g2", "w1", "w2"]
    place = F.xxhash64("t1", "t2", "w")
    twice = rows.groupBy(*key).agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x != y").select(*key)
    return rows.join(twice, key).select("t1", "t2", F.col("w").alias("lo"), F.col("w").alias("hi"))


# --------------------------------------------------------------------- whole

def repeated_windows(texts: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """t1, t2, lo, hi: runs of starts of repeated windows between different
    places of the distinct texts (rows with equal t1, t2 are one text)."""
    place = F.xxhash64("t1", "t2", "a")
    every = anchors(texts)
    common = stored(every.groupBy("h").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x != y").select("h"))
    kept = stored(maybe_in(every, "h", bitmap(common, "h")).distinct().join(common, "h"))
    classes = stored(kept.groupBy("h", "c").agg(
        F.min(F.struct("t1", "t2", "a", "lo", "hi")).alias("m"), F.min(place).alias("x"), F.max(place).alias("y")))
    whole = kept.join(classes.where("x != y").select("h", "c"), ["h", "c"]).select("t1", "t2", "lo", "hi")

    several = classes.groupBy("h").agg(F.count("*").alias("k"), F.max((F.col("x") == F.col("y")).cast("int")).alias("single")) \
        .where("k > 1 and single = 1").select("h")
    edge = classes.join(several, "h").select("h", "m.*", (F.col("x") != F.col("y")).alias("done"))
    want = stored(edge.groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "lo", "hi", "h", "done")).alias("want")))  # one text's
    found = maybe_in(texts, "t1", bitmap(want, "t1")).dropDuplicates(["t1", "t2"])
    edges = stored(found.join(want, ["t1", "t2"]).select("t1", "t2", "t", "want"))

    at = F.xxhash64("t1", "t2", "q")
    groups = stored(segments(edges, False).groupBy("g1", "g2").agg(F.min(at).alias("x"), F.max(at).alias("y"), F.count("*").alias("k"))
                    .where("x != y").select("g1", "g2", "k"))
    members = stored(maybe_in(segments(edges, True), "g1", bitmap(groups, "g1")).join(groups, ["g1", "g2"]))
    cols = ["g1", "g2", "t1", "t2", "q", "mask", "s"]
    small = sorted_groups(members.where(F.col("k") <= group_rows).select(*cols))
    large = counted_groups(members.where(F.col("k") > group_rows).select(*cols))
    return whole.unionByName(small).unionByName(large)


def cut(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """t1, t2, n_removed, n_spans, kept of the texts with repeated windows."""
    spans = stored(windows.groupBy("t1", "t2").agg(F.collect_set(F.struct("lo", "hi")).alias("w")))  # one text's

    def run(batches):
        for batch in batches:
            data, offs = utf8(batch.column(2))
            w = batch.column(3)
            flat, at = w.flatten(), w.offsets.to_numpy()
            lo, hi = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            removed, runs, kept = [], [], []
            for d in range(len(w)):
                raw = data[offs[d]:offs[d + 1]]
                edge = np.zeros(len(raw) + 1, np.int64)
                own = slice(at[d] - at[0], at[d + 1] - at[0])
                np.add.at(edge, lo[own], 1)
                np.add.at(edge, hi[own] + SPAN, -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                runs.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum()))
                kept.append(raw[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()),
                                              pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                                             names=["t1", "t2", "n_removed", "n_spans", "kept"])

    found = maybe_in(texts, "t1", bitmap(spans, "t1")).dropDuplicates(["t1", "t2"])
    return found.join(spans, ["t1", "t2"]).select("t1", "t2", "t", "w").mapInArrow(
        run, "t1 long, t2 long, n_removed long, n_spans long, kept binary")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, t (null as empty) and a 128-bit key of the text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), t.alias("t")) \
        .select("id", "t", F.xxhash64("t").alias("t1"), F.xxhash64(F.lit(1), "t").alias("t2"))


def digest(docs: DataFrame, id_col: str = "doc_id", group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per document: bytes, removed bytes and runs, hash of the rest."""
    rows = keyed(docs, id_col)
    texts = rows.select("t1", "t2", "t").where(F.octet_length("t") >= SPAN)
    done = stored(cut(texts, repeated_windows(texts, group_rows)).select("t1", "t2", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")))
    copies = rows.where(F.octet_length("t") >= SPAN).groupBy("t1", "t2").agg(F.count("*").alias("m")).where("m > 1").select("t1", "t2", F.lit(True).alias("copied"))
    each = rows.select("id", "t1", "t2", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("own"))
    r = each.join(done, ["t1", "t2"], "left").join(copies, ["t1", "t2"], "left")
    whole = F.col("copied").isNotNull()
    return r.select(F.col("id").alias("doc_id"), "n_bytes",
                    F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                    F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                    F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "own")).alias("kept_sha256"))


def reference(docs: list[tuple]) -> list[tuple]:
    """Brute force of ``digest`` for tests."""
    from collections import Counter
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(t[i:i + SPAN] for _, t in raw for i in range(len(t) - SPAN + 1))
    out = []
    for d, t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - SPAN + 1):
            if seen[t[i:i + SPAN]] > 1:
                gone[i:i + SPAN] = True
        gone = gone[:len(t)]
        runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if len(t) else b""
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out
