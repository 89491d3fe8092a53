"""N-gram Jaccard join with prefix filters under several global orders.

Texts become sets of word shingles; two link when 100 * |intersection| >=
``percent`` * |union|.  The result is each text's component of links.

1. **Classes.**  One pass reduces each text to its set's size and a 128-bit
   sum of its shingles' hashes; equal sets are one class from then on.
2. **Orders.**  Under any total order of shingles, two linked sets share one
   of their first ``n - ceil(t n) + 1`` (their prefixes).  Order 0 is rarity,
   from counts over all texts in tables of fixed size: shingles whose counter
   stands out (passages that many texts share) come last, the others by how
   often their words occur, ties by hash.  So groups stay small.  Orders 1..
   are hashes.
3. **Candidates.**  Prefixes under order 0 are grouped by shingle.  Length and
   position bounds drop pairs that cannot reach the threshold.
4. **Hubs first.**  Of each shingle's group the class with the fewest rarer
   shingles is its hub.  Every class is verified against one hub, the links
   are contracted to components, and only then are the pairs between classes
   of *different* components made: within a group of copies nothing is left
   to do, and no link between components is lost.
5. **Filters of the other orders.**  Under every hash order the start of a
   set is kept with its class (``filter_size`` shingles, 32 bits each).  Up to
   the smaller of two such starts' ends both sets are known there, and linked
   sets may miss no more of each other's shingles than the threshold allows
   in all.  Candidates must pass under every order.
6. **Verification** of what passes: the exact shingles (the words, not their
   hashes) are counted.
7. **Components** by repeatedly linking all neighbours to the smallest one.

Shuffles carry shingle prefixes, not texts; texts are fetched for candidates
only, by a bitmap of fixed size and an exact join behind it.

Defined results: texts without words (null and empty ones too) have no
shingles and stand alone; texts of fewer words than a shingle have one, the
whole sequence; repeated rows are one class; the component id is the smallest
non-null id; a null id is never the smallest; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textbytes import NOT_SPACE, Words, append, blocks, give_back, mix, utf8
from .workspace import bitmap, dropped, flagged, maybe_in, row_key, stored

N, PERCENT, ORDERS = 3, 90, 3
WORD_BITS, SHINGLE_BITS, SKETCH_BLOCK = 20, 21, 4096
_SEEDS = tuple(np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89))


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int, weight: np.ndarray | None = None):
    """For each text its distinct shingle hashes, sorted; with ``weight`` (by
    the top bits of a word's hash) also the sum of each shingle's words."""
    w = Words(data, offs, NOT_SPACE)
    g, _ = w.shingles(n)
    if weight is not None:
        own = weight[(w.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
        total = own.copy()
        for j in range(1, n):
            total[:max(0, len(own) - j)] += own[j:]
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= n:
            if weight is None:
                yield np.unique(g[a:b - n + 1])
            else:
                s, at = np.unique(g[a:b - n + 1], return_index=True)
                yield s, total[a + at]
            continue
        h = w.hash[a:a + 1].copy()
        for j in range(1, b - a):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w.hash[a + j:a + j + 1])
        # a short sequence is no shingle of n words
        s = mix(h ^ _SEEDS[3] * np.uint64(b - a)) if b > a else np.zeros(0, np.uint64)
        yield s if weight is None else (s, np.zeros(len(s), np.float32))


def _signature(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix(s ^ seed).sum(dtype=np.uint64).view(np.int64)) for seed in _SEEDS[:2])


def filter_size(n: int, percent: int) -> int:
    """Shingles kept of each hash order: the prefix and a few more."""
    return min(n, prefix_size(n, percent) + 8)


def starts(s: np.ndarray, percent: int, orders: int) -> bytes:
    """The set's first keys under each hash order, their top 32 bits, sorted."""
    q = filter_size(len(s), percent)
    out = []
    for k in range(1, orders):
        key = (mix(s ^ _SEEDS[k]) >> np.uint64(32)).astype("<u4")
        out.append(np.sort(np.partition(key, q - 1)[:q] if q < len(key) else key).tobytes())
    return b"".join(out)


def may_link(n: int, f: bytes, m: int, g: bytes, percent: int, orders: int) -> bool:
    """Whether two sets of n and m shingles pass the filters of every hash order."""
    need = -(-percent * (n + m) // (100 + percent))  # shingles in common
    p, q = filter_size(n, percent), filter_size(m, percent)
    x, y = (np.frombuffer(v, "<u4").reshape(orders - 1, -1) for v in (f, g))
    for a, b in zip(x, y):
        # the last key of a cut start may have equals beyond it, so it is left out
        end = min(int(a[-1]) if p < n else 1 << 32, int(b[-1]) if q < m else 1 << 32)
        a, b = a[a < end], b[b < end]
        if (~np.isin(a, b)).sum() > n - need or (~np.isin(b, a)).sum() > m - need:
            return False
    return True


def signatures(docs: DataFrame, text_col: str, n: int, percent: int, orders: int, name: str) -> DataFrame:
    """``docs`` without the text and with a struct ``name``: n (set size), s1,
    s2 and f (starts under the hash orders)."""

    def run(batch: pa.RecordBatch) -> pa.Array:
        data, offs = utf8(batch.column(batch.schema.get_field_index(text_col)))
        rows, f = [], []
        for i, j in blocks(offs):
            for s in shingle_sets(data, offs[i:j + 1], n):
                rows.append((len(s), *_signature(s)))
                f.append(starts(s, percent, orders) if len(s) else b"")
        cols = np.array(rows, np.int64).reshape(-1, 3).T
        return pa.StructArray.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in cols], pa.array(f, pa.binary())],
                                          names=["n", "s1", "s2", "f"])

    kind = docs.sparkSession.createDataFrame([], "n long, s1 long, s2 long, f binary").schema
    return append(docs, text_col, run, kind, name, drop_text=True)


# -------------------------------------------------------------------- orders

def sketch(docs: DataFrame, text_col: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all texts by the top bits of a hash: of words, and of each
    text's distinct shingles.  Partial tables are summed in two levels of
    bounded groups."""
    words, size, width = 1 << WORD_BITS, (1 << WORD_BITS) + (1 << SHINGLE_BITS), SKETCH_BLOCK

    def count(batches):
        from pyspark import TaskContext
        own = np.zeros(size, np.int64)
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for i, j in blocks(offs):
                part = offs[i:j + 1]
                own[:words] += np.bincount((Words(data, part, NOT_SPACE).hash >> np.uint64(64 - WORD_BITS)).astype(np.int64), minlength=words)
                sets = np.concatenate(list(shingle_sets(data, part, n)))
                own[words:] += np.bincount((sets >> np.uint64(64 - SHINGLE_BITS)).astype(np.int64), minlength=size - words)
        give_back()
        part = TaskContext.get().partitionId()
        at = [b for b in range(size // width) if own[b * width:(b + 1) * width].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part % 1024] * len(at), pa.int32()), pa.array(at, pa.int32()),
             pa.array([own[b * width:(b + 1) * width].astype("<i8").tobytes() for b in at], pa.binary())],
            names=["part", "block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for c in table.column("counts").to_pylist():
            total += np.frombuffer(c, "<i8")
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()),
                         "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
                         "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "part int, block int, counts binary"
    tables = docs.select(text_col).mapInArrow(count, kind).groupBy("part", "block").applyInArrow(add, kind)
    out = np.zeros(size, np.int64)
    for r in tables.groupBy("block").applyInArrow(add, kind).collect():  # at most 24 MB
        out[r.block * width:(r.block + 1) * width] = np.frombuffer(r.counts, "<i8")
    return out[:words], out[words:]


class Rarity:
    """Order 0: shingles that stand out last (by how much), then the sum of
    the logarithms of their words' counts, then the hash."""

    def __init__(self, words: np.ndarray, shingles: np.ndarray):
        self.weight = np.log2(np.maximum(1, words)).astype(np.float32)
        usual = max(1.0, float(np.median(shingles)))
        excess = (shingles - usual) / usual ** 0.5
        self.hot = np.where(excess > 6, 1 + np.log2(np.maximum(1, excess)), 0).astype(np.uint8)

    def order(self, s: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.lexsort((s, weight, self.hot[(s >> np.uint64(64 - SHINGLE_BITS)).astype(np.int64)]))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefixes(texts: DataFrame, n: int, percent: int, rarity) -> DataFrame:
    """token, k1, k2, n, pos: the prefix under order 0 of the sets of
    ``texts`` (k1, k2, t)."""

    def run(batches):
        order = rarity.value
        for batch in batches:
            data, offs = utf8(batch.column(2))
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)]
            for i, j in blocks(offs):
                tok, row, num, pos = [], [], [], []
                for d, (s, weight) in enumerate(shingle_sets(data, offs[i:j + 1], n, order.weight)):
                    if not len(s):
                        continue
                    p = prefix_size(len(s), percent)
                    tok.append(s[order.order(s, weight)[:p]])
                    row.append(np.full(p, i + d, np.int64))
                    num.append(np.full(p, len(s), np.int32))
                    pos.append(np.arange(p, dtype=np.int32))
                if tok:
                    row = np.concatenate(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tok).view(np.int64)), pa.array(keys[0][row]), pa.array(keys[1][row]),
                         pa.array(np.concatenate(num)), pa.array(np.concatenate(pos))], names=["token", "k1", "k2", "n", "pos"])
        give_back()

    return texts.select("k1", "k2", "t").mapInArrow(run, "token long, k1 long, k2 long, n int, pos int")


def without(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``texts`` whose key (k1, k2) isn't in ``keys``; only rows that may go are shuffled."""
    marked = flagged(texts, "k1", bitmap(keys, "k1"), "__odd")
    odd = marked.where("__odd").join(keys, ["k1", "k2"], "left_anti")
    return marked.where("not __odd").drop("__odd").unionByName(odd.drop("__odd"))


# -------------------------------------------------------------- verification

def shingles_of(text: str | None, n: int) -> set:
    w = (text or "").encode().translate(_LOWER).split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Verifier:
    """Exact similarity of pairs of texts; the last second text is kept."""

    def __init__(self, n: int, percent: int):
        self.n, self.percent = n, percent
        self.held: tuple = (None, None, None)

    def _hashes(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return next(shingle_sets(raw, np.array([0, len(raw)]), self.n))

    def _enough(self, both: int, n: int, m: int) -> bool:
        return 100 * both >= self.percent * (n + m - both)

    def __call__(self, a: str, b: str) -> bool:
        if self.held[0] != b:  # pairs come sorted by b
            self.held = b, self._hashes(b), None
        x, y = self._hashes(a), self.held[1]
        if not self._enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
            return False  # equal shingles have equal hashes
        if self.held[2] is None:
            self.held = b, y, shingles_of(b, self.n)
        x, y = shingles_of(a, self.n), self.held[2]
        return self._enough(len(x & y), len(x), len(y))


def filtered(pairs: DataFrame, rows: DataFrame, percent: int, orders: int) -> DataFrame:
    """The pairs that pass the filters of the hash orders."""
    sides = pairs.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).union(pairs.select("b1", "b2")).distinct()
    kept = maybe_in(rows.select("k1", "k2", "n", "f"), "k1", bitmap(sides, "k1"))
    left = kept.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("n").alias("x"), F.col("f").alias("fx"))
    right = kept.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("n").alias("y"), F.col("f").alias("fy"))
    full = pairs.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).select("a1", "a2", "b1", "b2", "x", "fx", "y", "fy")

    def run(batches):
        for batch in batches:
            ok = [may_link(*r, percent, orders) for r in zip(*(batch.column(c).to_pylist() for c in range(4, 8)))]
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=batch.schema.names[:4]).filter(pa.array(ok, pa.bool_()))
        give_back()

    return full.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long")


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, n: int, percent: int,
             orders: int) -> DataFrame:
    """The pairs (a1, a2, b1, b2: row keys) whose texts link, stored; ``pairs``
    is stored too, and deleted."""
    given, pairs = pairs, stored(filtered(pairs, rows, percent, orders))
    dropped(given)
    sides = pairs.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).union(pairs.select("b1", "b2")).distinct()
    texts = maybe_in(docs.select(*row_key(id_col, text_col), F.col(text_col).alias("t")), "k1", bitmap(sides, "k1"))
    texts = stored(texts.join(sides, ["k1", "k2"], "left_semi"))
    left = texts.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("t").alias("x"))
    right = texts.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("t").alias("y"))
    full = pairs.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).select("a1", "a2", "b1", "b2", "x", "y")

    def run(batches):
        linked = Verifier(n, percent)
        for batch in batches:
            x, y = batch.column(4), batch.column(5)
            ok = [linked(x[i].as_py(), y[i].as_py()) for i in range(len(x))]
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=batch.schema.names[:4]).filter(pa.array(ok, pa.bool_()))
        give_back()

    out = stored(full.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long").distinct())
    dropped(pairs, texts)
    return out


# ---------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """k1, k2, c1, c2: the smallest node of each node's component, for nodes
    with an edge.  Every round links all neighbours of a node, and the node,
    to the smallest of them, until nothing changes."""
    both = lambda e: e.union(e.select("b1", "b2", "a1", "a2"))
    edges = stored(edges.select("a1", "a2", "b1", "b2").distinct())
    before, held = None, None
    while True:
        near = both(edges)
        least = (near.groupBy("a1", "a2").agg(F.min(F.struct("b1", "b2")).alias("m"))
                 .select("a1", "a2", F.least(F.struct(F.col("a1").alias("b1"), F.col("a2").alias("b2")), F.col("m")).alias("m")))
        moved = near.join(least, ["a1", "a2"]).select(
            F.col("b1").alias("x1"), F.col("b2").alias("x2"), F.col("m.b1").alias("y1"), F.col("m.b2").alias("y2")) \
            .union(least.select("a1", "a2", "m.b1", "m.b2")).distinct()
        held, edges = edges, stored(moved.where("x1 != y1 or x2 != y2").toDF("a1", "a2", "b1", "b2"))
        dropped(held)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a1", "a2", "b1", "b2"))).first()
        if now == before:
            break
        before = now
    out = edges.toDF("k1", "k2", "c1", "c2")
    roots = out.select(F.col("c1").alias("k1"), F.col("c2").alias("k2")).distinct()
    return out.union(roots.select("k1", "k2", "k1", "k2"))


def _possible(a: str, b: str, percent: int) -> Column:
    """Length bound, and position bound at the first common shingle, of the
    classes with columns {a}n, {a}pos and {b}n, {b}pos."""
    n, m = F.col(f"{a}n").cast("long"), F.col(f"{b}n").cast("long")
    most = F.least(n - F.col(f"{a}pos"), m - F.col(f"{b}pos"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))


def _step(size: Column) -> Column:
    """Sizes in steps of an eighth of a doubling; small sizes have their own."""
    return F.floor(F.log2(size) * 8).cast("int")


def met(one: DataFrame, other: DataFrame, percent: int) -> DataFrame:
    """Rows of ``one`` (token, n, pos) with the rows of ``other`` (token, on,
    opos) that the length and position bounds allow.

    At a position a set can only link sets of sizes from ``percent`` of its
    own to what the shingles from there on still allow.  Steps of these sizes
    are part of the join's key, so most pairs that the bounds exclude are
    never formed, and a common shingle is split by the sizes of its sets.
    """
    n, m = F.col("n").cast("long"), F.col("on").cast("long")

    def partners(size, pos):
        return F.ceil(percent * size / 100), F.floor((100 + percent) * (size - pos) / percent) - size

    low, high = partners(n, F.col("pos"))
    olow, ohigh = partners(m, F.col("opos"))
    left = one.where(low <= high).withColumn("step", F.explode(F.sequence(_step(low), _step(high))))
    right = other.where(olow <= ohigh).withColumn("step", _step(m))
    return left.join(right, ["token", "step"]).drop("step").where(
        m.between(low, high) & n.between(olow, ohigh) & _possible("", "o", percent))


def class_prefixes(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """token, k1, k2, n, pos, stored: the prefix under order 0 of a text of
    each class, where other classes have the token too.  ``rows``: one row per
    text with k1, k2, n, s1, s2 and f."""
    rarity = docs.sparkSession.sparkContext.broadcast(Rarity(*sketch(docs, text_col, n)))  # 6 MB
    classes = rows.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("k1", "k2")).alias("k"))
    copies = stored(rows.where("n > 0").join(classes, ["s1", "s2"]).where("k1 != k.k1 or k2 != k.k2").select("k1", "k2").distinct())
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("t"))
    found = stored(prefixes(without(texts, copies), n, percent, rarity))
    shared = stored(found.groupBy("token").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"))
                    .where("lo != hi").select("token"))
    members = stored(maybe_in(found, "token", bitmap(shared, "token")).join(shared, "token"))
    dropped(copies, found, shared)
    return members


def class_components(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, n: int, percent: int, orders: int) -> DataFrame:
    """k1, k2, c1, c2 of the classes that have a link."""
    members = class_prefixes(docs, rows, id_col, text_col, n, percent)
    hubs = members.groupBy("token").agg(F.min(F.struct("pos", "n", "k1", "k2")).alias("h")) \
        .select("token", F.col("h.pos").alias("hpos"), F.col("h.n").alias("hn"), F.col("h.k1").alias("b1"), F.col("h.k2").alias("b2"))
    first = (members.join(hubs, "token").where("k1 != b1 or k2 != b2").where(_possible("", "h", percent))
             .groupBy(F.col("k1").alias("a1"), F.col("k2").alias("a2"))
             .agg(F.min(F.struct("hpos", "pos", "b1", "b2")).alias("h")).select("a1", "a2", "h.b1", "h.b2"))
    links = verified(stored(first), docs, rows, id_col, text_col, n, percent, orders)

    parts = components(links)
    at = stored(members.join(parts, ["k1", "k2"], "left")
                .withColumn("c1", F.coalesce("c1", "k1")).withColumn("c2", F.coalesce("c2", "k2")))
    dropped(members)
    # Of each group the component with most members needs no pairs within it.
    main = (at.groupBy("token", "c1", "c2").agg(F.count("*").alias("size"))
            .groupBy("token").agg(F.max(F.struct("size", "c1", "c2")).alias("m"), F.count("*").alias("parts"))
            .where("parts > 1").select("token", F.col("m.c1").alias("m1"), F.col("m.c2").alias("m2")))
    open_ = at.join(main, "token")
    apart = open_.where("c1 != m1 or c2 != m2").drop("m1", "m2")
    other = open_.select("token", *[F.col(c).alias(f"o{c}") for c in ("k1", "k2", "n", "pos", "c1", "c2")],
                         ((F.col("c1") == F.col("m1")) & (F.col("c2") == F.col("m2"))).alias("omain"))
    # Each pair once: between two components apart from the main one, by order of keys.
    rest = (met(apart, other, percent)
            .where("(c1 != oc1 or c2 != oc2) and (omain or k1 < ok1 or (k1 = ok1 and k2 < ok2))")
            .select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("ok1").alias("b1"), F.col("ok2").alias("b2")).distinct())
    rest = stored(rest)
    dropped(at)
    more = verified(rest, docs, rows, id_col, text_col, n, percent, orders)
    out = components(links.union(more))
    dropped(links, more)
    return out


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT,
            orders: int = ORDERS) -> DataFrame:
    """id, k1, k2 (key of the row), n, c1, c2 (key of its component, null
    without words) and component_id, for every row."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = stored(signatures(docs.select("id", *row_key("id", "t"), "t"), "t", n, percent, orders, "s").select("id", "k1", "k2", "s.*"))
    parts = class_components(docs, rows, "id", "t", n, percent, orders)
    classes = (rows.where("n > 0").groupBy("s1", "s2")
               .agg(F.min(F.struct("k1", "k2")).alias("k"), F.min("id").alias("least")).select("s1", "s2", "k.*", "least")
               .join(parts, ["k1", "k2"], "left").withColumn("c1", F.coalesce("c1", "k1")).withColumn("c2", F.coalesce("c2", "k2")))
    classes = stored(classes)
    named = (classes.join(classes.groupBy("c1", "c2").agg(F.min("least").alias("component_id")), ["c1", "c2"])
             .select("s1", "s2", "c1", "c2", "component_id"))
    some = F.col("n") > 0
    return rows.join(named, ["s1", "s2"], "left").select(
        "id", "k1", "k2", "n", *[F.when(some, F.col(c)).alias(c) for c in ("c1", "c2")],
        F.when(some, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT,
          orders: int = ORDERS) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, and what the sets stand for.

    Pairs (a, b): ids of two classes of equal sets that link, each pair once.
    Membership (id, class_id, n_links): the class of every row, named by its
    smallest id, and how many other classes it links to; rows without words
    have no class.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = stored(signatures(docs.select("id", *row_key("id", "t"), "t"), "t", n, percent, orders, "s").select("id", "k1", "k2", "s.*"))
    own = class_prefixes(docs, rows, "id", "t", n, percent)
    other = own.select("token", *[F.col(c).alias(f"o{c}") for c in ("k1", "k2", "n", "pos")])
    pairs = (met(own, other, percent).where("k1 < ok1 or (k1 = ok1 and k2 < ok2)")
             .select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("ok1").alias("b1"), F.col("ok2").alias("b2")).distinct())
    found = verified(stored(pairs), docs, rows, "id", "t", n, percent, orders)
    dropped(own)
    classes = stored(rows.where("n > 0").groupBy("s1", "s2")
                     .agg(F.min(F.struct("k1", "k2")).alias("k"), F.min("id").alias("class_id")).select("s1", "s2", "k.*", "class_id"))
    side = lambda k, c: classes.select(F.col("k1").alias(f"{k}1"), F.col("k2").alias(f"{k}2"), F.col("class_id").alias(c))
    named = stored(found.join(side("a", "x"), ["a1", "a2"]).join(side("b", "y"), ["b1", "b2"]))
    ends = named.select("a1", "a2").union(named.select("b1", "b2")).toDF("k1", "k2").groupBy("k1", "k2").agg(F.count("*").alias("n_links"))
    of = classes.join(ends, ["k1", "k2"], "left").select("s1", "s2", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    member = rows.where("n > 0").join(of, ["s1", "s2"]).select(F.col("id").alias(id_col), "class_id", "n_links")
    member = member.unionByName(rows.where("n = 0").select(F.col("id").alias(id_col), F.lit(None).cast(docs.schema["id"].dataType).alias("class_id"),
                                                           F.lit(0).cast("long").alias("n_links")))
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), member


def joined(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """id, n_shingles, component_id of every row."""
    return grouped(docs, id_col=id_col, **how).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (a null id
    last; ties by a hash of the row).  Rows without words all stay.  Only rows
    that may go are shuffled."""
    rows = grouped(docs, id_col=id_col, text_col=text_col, **how)
    keys = stored(rows.where("n > 0").groupBy("k1", "k2", "c1", "c2").agg(F.min("id").alias("id"), F.count("*").alias("m")))
    order = F.struct(F.col("id").isNull().alias("no"), "id", "k1", "k2")
    first = keys.groupBy("c1", "c2").agg(F.min(order).alias("f")).select("c1", "c2", F.col("f.k1").alias("f1"), F.col("f.k2").alias("f2"))
    special = stored(keys.join(first, ["c1", "c2"]).withColumn("stays", F.expr("k1 = f1 and k2 = f2"))
                     .where("m > 1 or not stays").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("stays").alias("__stays")))
    k1, k2 = row_key(id_col, text_col)
    marked = flagged(docs.withColumn("__k1", k1).withColumn("__k2", k2), "__k1", bitmap(special, "__k1"), "__odd")
    odd = marked.where("__odd").join(special, ["__k1", "__k2"], "left").where("__stays is null or __stays")
    one = F.row_number().over(Window.partitionBy("__k1", "__k2", "__stays").orderBy(F.lit(0)))
    odd = odd.where("__stays is null").unionByName(odd.where("__stays").withColumn("__nr", one).where("__nr = 1").drop("__nr"))
    return marked.where("not __odd").select(docs.columns).union(odd.select(docs.columns))


def reference(docs: list[tuple], n: int = N, percent: int = PERCENT) -> list[tuple]:
    """Brute force of ``joined`` for tests (ids not null)."""
    import re
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for _, t in docs:
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)]
