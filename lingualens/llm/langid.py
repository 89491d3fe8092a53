"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of order ``ORDER``: for every context of
0 to ``ORDER`` bytes, how often each byte follows.  A byte unseen after a
context costs an escape (method C: distinct / (total + distinct)) and is looked
up after the context shortened by one byte; below order 0 all 256 bytes are
equally likely.  Statistics are frozen after learning, so a text's exact code
length in a language is a sum of table entries, and the language with the
shortest code wins (ties: smaller name).

The trees of all languages share their keys: one lookup of the longest known
string (context and byte) yields the costs in every language at once.

Learning uses a bounded sample of whole labelled texts: texts are taken by a
hash of the id at a rate that leaves about ``sample_docs`` a language (a
parameter).  Every string of the sample is kept, so each language has its
whole tree however many others there are.  Counting runs in Spark tasks and is
summed by Spark; the distinct strings reach the driver as Arrow columns, and
the model has one cost a string and language.  Everything else covers all
texts.

Defined results: ``und`` with score 0 for null texts, texts without a letter
(empty ones too), and all texts if nothing could be learned; otherwise the
score is the posterior of the winner under equal priors.  Null languages and
null texts teach nothing; a null id is never held out; repeated rows are
judged each; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import append, blocks, utf8

ORDER = 3
SAMPLE_DOCS = 4000
RESULT = "lang_pred string, score double, bits double, n_bytes long"
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def split_of(id_col: str = "doc_id", modulus: int = 4):
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(-1))


# ------------------------------------------------------------------ learning

def lead(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts joined, each after ``order`` zero bytes; and where each begins."""
    n = len(offs) - 1
    out = np.zeros(int(offs[-1] - offs[0]) + order * n + 8, np.uint8)
    begin = offs[:-1] - offs[0] + order * np.arange(1, n + 1)
    for d in range(n):
        a, b = offs[d], offs[d + 1]
        out[begin[d]:begin[d] + b - a] = data[a:b]
    return out, begin


def strings(buf: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k bytes that end at each position, first byte lowest; k <= 8."""
    eight = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))
    return eight[at - (k - 1)] & np.uint64((1 << (8 * k)) - 1)


def count_strings(texts: DataFrame, order: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By language, all strings of order + 1 bytes and how often each occurs."""

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            data, offs = utf8(batch.column(1))
            for i, j in blocks(offs):
                for lang in sorted(set(langs[i:j])):
                    rows = [r for r in range(i, j) if langs[r] == lang]
                    keys = []
                    for r in rows:
                        buf, begin = lead(data, offs[r:r + 2], order)
                        keys.append(strings(buf, np.arange(begin[0], begin[0] + offs[r + 1] - offs[r]), order + 1))
                    key, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(key)), pa.array(key.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])

    found = texts.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    names = found.column("lang").combine_chunks().dictionary_encode()
    code = names.indices.to_numpy(zero_copy_only=False)
    key, n = (found.column(c).to_numpy() for c in ("key", "n"))
    return {lang: (key[code == i].view(np.uint64), n[code == i].astype(np.float64)) for i, lang in enumerate(names.dictionary.to_pylist())}


@dataclass
class Model:
    """``levels[k]``: sorted strings of k + 1 bytes and their costs by
    language; ``escapes[k]``: sorted contexts of k bytes and their escapes."""
    langs: list[str]
    order: int
    levels: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]


def build(rows: list, order: int) -> Model:
    """Model of counted strings given as rows (lang, key, n)."""
    langs = sorted({r.lang for r in rows})
    return trees({lang: (np.array([r.key for r in rows if r.lang == lang], np.int64).view(np.uint64),
                         np.array([r.n for r in rows if r.lang == lang], np.float64)) for lang in langs}, order)


def trees(top: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> Model:
    """Context trees and exact costs (bits) of all known strings."""
    langs = sorted(top)
    levels, escapes = [], []
    below_keys, below_cost = None, np.full((1, len(langs)), 8.0)
    for k in range(order + 1):
        own = {}
        for lang, (key, n) in top.items():  # strings of k + 1 bytes: drop the leading ones
            short, inv = np.unique(key >> np.uint64(8 * (order - k)), return_inverse=True)
            own[lang] = short, np.bincount(inv, n)
        keys = np.unique(np.concatenate([x[0] for x in own.values()]))
        ctx_mask = np.uint64((1 << (8 * k)) - 1)
        ctxs = np.unique(keys & ctx_mask)
        esc = np.zeros((len(ctxs), len(langs)))
        if below_keys is None:
            cost = np.repeat(below_cost, len(keys), 0)
        else:
            cost = below_cost[np.searchsorted(below_keys, keys >> np.uint64(8))]
        at = np.searchsorted(ctxs, keys & ctx_mask)
        for c, lang in enumerate(langs):
            short, n = own[lang]
            ctx = np.searchsorted(ctxs, short & ctx_mask)
            total = np.bincount(ctx, n, len(ctxs))
            distinct = np.bincount(ctx, minlength=len(ctxs))
            some = total > 0
            esc[some, c] = -np.log2(distinct[some] / (total[some] + distinct[some]))
            cost[:, c] += esc[at, c]
            seen = np.searchsorted(keys, short)
            cost[seen, c] = -np.log2(n / (total[ctx] + distinct[ctx]))
        levels.append((keys, cost.astype(np.float32)))
        escapes.append((ctxs, esc.astype(np.float32)))
        below_keys, below_cost = keys, cost
    return Model(langs, order, levels, escapes)


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          order: int = ORDER, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Model of the labelled rows of ``docs``; None if there are none."""
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")) \
        .where("lang is not null and text is not null and text != ''")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return None
    take = F.lit(False)
    for lang, n in sorted(sizes.items()):
        share = min(1.0, sample_docs / n)
        chosen = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) < int(share * (1 << 20))
        take = take | ((F.col("lang") == lang) & chosen)
    top = count_strings(known.where(take).select("lang", "text"), order)
    return trees(top, order) if top else None


# ------------------------------------------------------------------- scoring

class Lookup:
    """Open-addressed table from strings to row numbers."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.zeros(1 << bits, np.uint64)
        self.row = np.full(1 << bits, -1, np.int32)
        for i, (k, s) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.row[s] >= 0:
                s = (s + 1) & self.mask
            self.key[s], self.row[s] = k, i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if unknown."""
        slot = self._slot(keys)
        row = self.row[slot]
        todo = np.flatnonzero((self.key[slot] != keys) & (row >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            row[todo] = self.row[slot[todo]]
            todo = todo[(self.key[slot[todo]] != keys[todo]) & (row[todo] >= 0)]
        return row


class Scorer:
    def __init__(self, model: Model):
        self.langs, self.order = model.langs, model.order
        self.levels = [(Lookup(k), c) for k, c in model.levels]
        self.escapes = [(Lookup(k), c) for k, c in model.escapes]

    def costs(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of the byte at each position, by language."""
        key = strings(buf, at, self.order + 1)
        find, cost = self.levels[self.order]
        row = find.find(key)
        out = cost[row]
        rest = np.flatnonzero(row < 0)
        out[rest] = 0.0
        for k in range(self.order, -1, -1):
            if not len(rest):
                break
            own = key[rest] >> np.uint64(8 * (self.order - k))  # the last k + 1 bytes
            if k < self.order:
                row = self.levels[k][0].find(own)
                hit = row >= 0
                out[rest[hit]] += self.levels[k][1][row[hit]]
                rest, own = rest[~hit], own[~hit]
            row = self.escapes[k][0].find(own & np.uint64((1 << (8 * k)) - 1))
            hit = row >= 0
            out[rest[hit]] += self.escapes[k][1][row[hit]]
        out[rest] += 8.0
        return out

    def totals(self, data: np.ndarray, offs: np.ndarray, step: int = 1 << 18) -> np.ndarray:
        """Code length of each text, by language.  A text is summed in steps
        from its own start, so its total doesn't depend on its neighbours."""
        buf, begin = lead(data, offs, self.order)
        size = np.diff(offs)
        out = np.zeros((len(size), len(self.langs)))
        i = 0
        while i < len(size):
            j = i
            while j < len(size) and begin[j] + size[j] - begin[i] <= step:
                j += 1
            if j == i:
                for a in range(0, int(size[i]), step):
                    at = np.arange(begin[i] + a, begin[i] + min(size[i], a + step))
                    out[i] += self.costs(buf, at).sum(0, dtype=np.float64)
                i += 1
                continue
            at = np.arange(begin[i], begin[j - 1] + size[j - 1])
            bits = self.costs(buf, at)
            full = np.flatnonzero(size[i:j])
            if len(full):
                # the zero bytes before a text belong to no text
                cut = np.column_stack([begin[i:j][full], begin[i:j][full] + size[i:j][full]]).ravel() - begin[i]
                cut = cut[:-1] if cut[-1] == len(bits) else cut
                out[i + full] = np.add.reduceat(bits, cut, axis=0, dtype=np.float64)[::2]
            i = j
        return out


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text", name: str = "lang_id",
            drop_text: bool = False) -> DataFrame:
    """``docs`` with a struct column ``name``: lang_pred, score, bits (code
    length in that language) and n_bytes."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # the strings of the sample
    kind = spark.createDataFrame([], RESULT).schema
    state: dict = {}

    def score(batch: pa.RecordBatch) -> pa.Array:
        if "scorer" not in state:
            state["scorer"] = Scorer(sent.value) if sent.value is not None else None
        scorer, col = state["scorer"], batch.column(batch.schema.get_field_index(text_col))
        data, offs = utf8(col)
        n = len(offs) - 1
        letters = np.fromiter((t is not None and _LETTER.search(t) is not None for t in col.to_pylist()), bool, n)
        best, share, bits = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        if scorer is not None:
            for i, j in blocks(offs):
                total = scorer.totals(data, offs[i:j + 1])
                best[i:j] = total.argmin(1)
                bits[i:j] = total.min(1)
                share[i:j] = 1 / np.exp2(np.maximum(-1000, total.min(1)[:, None] - total)).sum(1)
        else:
            letters[:] = False
        names = np.array(scorer.langs if scorer is not None else [UNKNOWN], object)[best]
        names[~letters] = UNKNOWN
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.where(letters, share, 0.0)), pa.array(bits),
             pa.array(np.diff(offs), pa.int64())], names=["lang_pred", "score", "bits", "n_bytes"])

    return append(docs, text_col, score, kind, name, drop_text)


def digest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document; rows whose split is 2 are held out of learning."""
    model = learn(docs.where(split_of(id_col) != 2), id_col=id_col)
    r = predict(docs.select(id_col, "text"), model, name="r", drop_text=True)
    return r.select(F.col(id_col).alias("doc_id"), (split_of(id_col) == 2).alias("held_out"),
                    F.col("r.lang_pred").alias("lang_pred"), F.col("r.score").alias("score"))


def accepted(result: str = "lang_id"):
    """Whether a text counts as written in some learned language: its best
    code is shorter than plain bytes (8 bits each)."""
    r = F.col(result)
    return (r["lang_pred"] != UNKNOWN) & (r["bits"] < 8.0 * r["n_bytes"])
