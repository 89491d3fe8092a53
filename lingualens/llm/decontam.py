"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``n`` consecutive words (the whole item
when it has fewer).  A document word inside any occurrence of a window is hit.

* Each window is a set of word shingles.  Shingles are ordered by rarity:
  their number of occurrences in *all* documents (one pass, summed by Spark).
* As a window must occur whole, one prefix token is necessary: its rarest
  shingle.  Documents are joined to windows on that token alone.
* A candidate start is ``position of the token - its offset in the window``;
  length and position bounds drop starts that leave the document.
* Survivors are verified over the item-sized window: all word hashes, then
  the words themselves.

Items travel to the tasks in blocks of a bounded size (``block_bytes``, cut
by a hash of the item); a larger benchmark takes more passes, not more memory.

Defined results: null or wordless texts have no words, no hits and are not
contaminated; items without words match nothing; repeated items and rows each
count as they stand (equal item ids once); a null item id reads as "null";
columns other than the id and the text play no part.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import ALNUM, Words, append, blocks, lists, mix, utf8

RESULT = "n_words long, n_hit long, runs array<long>, items array<string>"


@dataclass
class ItemBlock:
    """Windows of some items; ``key``.. are set once rarity is known."""
    words: list[np.ndarray] = field(default_factory=list)      # word hashes of each window
    texts: list[bytes] = field(default_factory=list)           # its words, for verification
    items: list[set[str]] = field(default_factory=list)        # items that have it
    shingles: dict[int, np.ndarray] = field(default_factory=dict)  # size -> sorted hashes
    tokens: dict[int, tuple] = field(default_factory=dict)     # size -> prefix tokens


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    g = h[:len(h) - k + 1].copy()
    for j in range(1, k):
        g = mix(g * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - k + 1 + j])
    return g


def item_block(rows: list[tuple[str, str | None]], n: int, shingle: int) -> ItemBlock:
    out, seen, sets = ItemBlock(), {}, {}
    for item, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        w = Words(data, np.array([0, len(data)]), ALNUM)
        size = min(n, len(w.hash))
        for a in range(len(w.hash) - size + 1 if size else 0):
            key = w.text(a, a + size)
            if key not in seen:
                seen[key] = len(out.texts)
                out.texts.append(key)
                out.words.append(w.hash[a:a + size])
                out.items.append(set())
            out.items[seen[key]].add(item)
    for h in out.words:
        k = min(shingle, len(h))
        sets.setdefault(k, []).append(shingle_hashes(h, k))
    out.shingles = {k: np.unique(np.concatenate(v)) for k, v in sets.items()}
    return out


def set_prefixes(block: ItemBlock, counts: dict[int, np.ndarray], shingle: int) -> None:
    """Of each window, the rarest shingle (ties: smaller hash) and its offset."""
    found: dict[int, list] = {}
    for i, h in enumerate(block.words):
        k = min(shingle, len(h))
        g = shingle_hashes(h, k)
        seen = counts[k][np.searchsorted(block.shingles[k], g)]
        o = int(np.lexsort((g, seen))[0])
        found.setdefault(k, []).append((g[o], o, i))
    for k, rows in found.items():
        key = np.array([r[0] for r in rows], np.uint64)
        order = np.argsort(key, kind="stable")
        block.tokens[k] = (key[order], np.array([r[1] for r in rows])[order], np.array([r[2] for r in rows])[order])


class Sieve:
    """Membership of hashes in a sorted array: a bitmap first, then a search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(12, min(22, int(len(keys)).bit_length() + 5)))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[(keys >> self.shift).astype(np.int64)] = True

    def positions(self, h: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions whose hash occurs, with the range of its keys."""
        at = np.flatnonzero(self.bits[(h >> self.shift).astype(np.int64)] & ok)
        lo, hi = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
        hit = hi > lo
        return at[hit], lo[hit], hi[hit]


def shingle_counts(docs: DataFrame, text_col: str, block: ItemBlock) -> dict[int, np.ndarray]:
    """Occurrences of the block's shingles in all documents."""
    wanted = docs.sparkSession.sparkContext.broadcast(block.shingles)

    def run(batches):
        sieves = {k: Sieve(v) for k, v in wanted.value.items()}
        sums = {k: np.zeros(len(v), np.int64) for k, v in wanted.value.items()}
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for i, j in blocks(offs):
                w = Words(data, offs[i:j + 1], ALNUM)
                for k, sieve in sieves.items():
                    _, lo, _ = sieve.positions(*w.shingles(k))
                    sums[k] += np.bincount(lo, minlength=len(sums[k]))
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(v[at])], names=["k", "i", "n"])

    rows = (docs.select(text_col).mapInArrow(run, "k int, i long, n long")
            .groupBy("k", "i").agg(F.sum("n").alias("n")).collect())  # at most the block's shingles
    counts = {k: np.zeros(len(v), np.int64) for k, v in block.shingles.items()}
    for r in rows:
        counts[r.k][r.i] = r.n
    wanted.unpersist()
    return counts


def find(w: Words, block: ItemBlock, sieves: dict[int, Sieve]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified occurrences: first word, number of words, window."""
    n_docs = len(w.first) - 1
    doc_of = np.repeat(np.arange(n_docs), np.diff(w.first))
    out: list[tuple[int, int, int]] = []
    for k, (_, offset, window) in block.tokens.items():
        at, lo, hi = sieves[k].positions(*w.shingles(k))
        if not len(at):
            continue
        row = np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange((hi - lo).sum())
        begin, win = np.repeat(at, hi - lo) - offset[row], window[row]
        doc = doc_of[np.repeat(at, hi - lo)]
        size = np.array([len(block.words[x]) for x in win])
        fits = (begin >= w.first[doc]) & (begin + size <= w.first[doc + 1])
        for a, s, x in zip(begin[fits], size[fits], win[fits]):
            if np.array_equal(w.hash[a:a + s], block.words[x]) and w.text(a, a + s) == block.texts[x]:
                out.append((a, s, x))
    a = np.array(out, np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def contamination(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", n: int = 13, shingle: int = 5, name: str = "contamination",
                  drop_text: bool = False, block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, n_hit, runs (first and
    end word of each maximal run of hit words, flat) and items."""
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                         F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    kind = spark.createDataFrame([], RESULT).schema
    out = docs
    for b in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b)
        block = item_block([(r.item, r.text) for r in part.collect()], n, shingle)
        set_prefixes(block, shingle_counts(docs, text_col, block), shingle)
        sent = spark.sparkContext.broadcast(block)
        before = f"{name}_{b - 1}" if b else None
        out = append(out, text_col, _scanner(sent, text_col, before), kind, f"{name}_{b}",
                     drop_text and b == n_blocks - 1)
        if before:
            out = out.drop(before)
    return out.withColumnRenamed(f"{name}_{n_blocks - 1}", name)


def _scanner(sent, text_col: str, before: str | None):
    state: dict = {}

    def scan(batch: pa.RecordBatch) -> pa.Array:
        block = sent.value
        if "sieves" not in state:
            state["sieves"] = {k: Sieve(v[0]) for k, v in block.tokens.items()}
        data, offs = utf8(batch.column(batch.schema.get_field_index(text_col)))
        old = batch.column(batch.schema.get_field_index(before)).to_pylist() if before else None
        n_words, n_hit, n_runs, n_items, runs, names = [], [], [], [], [], []
        for i, j in blocks(offs):
            w = Words(data, offs[i:j + 1], ALNUM)
            begin, size, win = find(w, block, state["sieves"])
            edges = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(edges, begin, 1)
            np.add.at(edges, begin + size, -1)
            docs_hit = np.searchsorted(w.first, begin, "right") - 1
            found: dict[int, set] = {}
            for d, x in zip(docs_hit.tolist(), win.tolist()):
                found.setdefault(d, set()).update(block.items[x])
            if old:
                for d in range(j - i):
                    for a, e in zip(old[i + d]["runs"][::2], old[i + d]["runs"][1::2]):
                        edges[w.first[d] + a] += 1
                        edges[w.first[d] + e] -= 1
                    if old[i + d]["items"]:
                        found.setdefault(d, set()).update(old[i + d]["items"])
            hit = np.cumsum(edges)[:-1] > 0
            sums = np.concatenate(([0], np.cumsum(hit)))
            n_words.append(np.diff(w.first))
            n_hit.append(sums[w.first[1:]] - sums[w.first[:-1]])
            for d in range(j - i):
                own = hit[w.first[d]:w.first[d + 1]] if n_hit[-1][d] else None
                flat = [] if own is None else np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
                runs.extend(flat)
                n_runs.append(len(flat))
                own_items = sorted(found.get(d, ()))
                names.extend(own_items)
                n_items.append(len(own_items))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(cat(n_words), pa.int64()), pa.array(cat(n_hit), pa.int64()),
             lists(np.array(n_runs, np.int64), pa.array(runs, pa.int64())),
             lists(np.array(n_items, np.int64), pa.array(names, pa.string()))],
            names=["n_words", "n_hit", "runs", "items"])
    return scan


def is_contaminated(n_hit, n_words):
    """The contract's rule: some word is hit and at least a twentieth of all."""
    return (n_hit > 0) & (F.lit(20) * n_hit >= n_words)


def digest(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts, a hash of the items and the decision."""
    r = contamination(docs.select(id_col, "text"), items, drop_text=True, name="r")
    return r.select(
        F.col(id_col).alias("doc_id"), F.col("r.n_words").alias("n_words"), F.col("r.n_hit").alias("n_hit"),
        F.size("r.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("r.items"), ","), 256).alias("items_sha256"),
        is_contaminated(F.col("r.n_hit"), F.col("r.n_words")).alias("contaminated"))


def reference(docs: list[tuple], items: list[tuple], n: int = 13) -> list[tuple]:
    """Brute force of ``digest`` for tests."""
    import re
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc, text in docs:
        w, hit, own = split(text), set(), set()
        for item, it in items:
            q = split(it)
            size = min(n, len(q))
            wins = {tuple(q[a:a + size]) for a in range(len(q) - size + 1)} if size else set()
            for a in range(len(w) - size + 1):
                if size and tuple(w[a:a + size]) in wins:
                    hit.update(range(a, a + size))
                    own.add("null" if item is None else str(item))
        out.append((doc, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out
