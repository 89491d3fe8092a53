"""Cross-tokenizer alignment by hash-set intersection of cumulative ends.

A text is encoded by two tokenizers, A (byte-level BPE, of space + text) and B
(sentence pieces, which adds the space).  Both give tokens that tile the same
bytes.

1. Texts are cut at single spaces between characters that aren't white space.
   No token of either tokenizer reaches across such a space, so each unit is
   encoded by itself, as space + unit, and a unit met before isn't encoded again.
2. A unit's cumulative token ends become two dictionaries, end to index.  The
   ends that both have, sorted, slice both id lists into groups.
3. Links are the pairs of tokens whose bytes overlap, expanded slice by slice.
4. Units are joined per text.  Texts are taken in blocks of ``BLOCK_BYTES``
   (or one longer text); a block lists the distinct id pairs that it links, and
   a text holds places in that list and counts.  The result is written once.
5. Pair counts of all blocks are added up, each B id's highest count is found,
   and each block gets the totals of its own pairs back: no table of all pairs
   is sent to any task.

Defined results: null and empty texts, and texts whose joined token bytes
differ from space + text (texts with U+2581, for one), have no tokens: zeros
and an empty digest; repeated rows count each; null ids are kept; an empty table
gives no rows; extra columns play no part.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import blocks, lists, utf8
from .workspace import stored

BLOCK_BYTES = 1 << 22
#: Units and links that a worker remembers before it starts anew.
_UNITS, _LINKS = 250_000, 4_000_000
_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of() -> dict[str, int]:
    """Bytes of the characters that a byte-level vocabulary writes them as:
    printable ones as they are, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers, the bytes of their tokens, and the units met so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        byte_of = _byte_of()
        self.bytes_a = {i: bytes(byte_of.get(c, 0) for c in t) for t, i in self.a.get_vocab().items()}
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.size_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        ids = [str(i) for i in range(max(len(self.size_a), len(self.size_b)))]
        self.digits = np.array([len(x) for x in ids], np.int64)
        self.comma, self.bar, self.semicolon = (np.array([x + c for x in ids], object) for c in ",|;")
        self.clear()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.texts: list[str] = []
        # A tokens, B tokens, groups, links, and whether the bytes are the unit's
        self.counts = np.zeros((0, 5), np.int64)
        self.links = np.zeros(0, np.int64)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        return a, self.b.encode(units, num_threads=1)

    def learn(self, units: list[str]) -> None:
        """Encode and align units, all at once."""
        ids = self.encode(units)
        whole = [(" " + u).encode() for u in units]
        ok = self._tiled(ids, whole)
        if not ok.all():
            ids = [[x if k else [] for x, k in zip(own, ok)] for own in ids]
            whole = [x if k else b"" for x, k in zip(whole, ok)]
        groups, links, texts = self.aligned(*ids, np.fromiter(map(len, whole), np.int64, len(units)))
        self.place.update(zip(units, range(len(self.texts), len(self.texts) + len(units))))
        self.texts.extend(texts)
        n_a, n_b = (np.fromiter(map(len, own), np.int64, len(units)) for own in ids)
        unit = np.searchsorted(np.cumsum([len(x) for x in whole]), links[0])
        n_links = np.bincount(unit, minlength=len(units)) if len(units) else np.zeros(0, np.int64)
        self.counts = np.concatenate([self.counts, np.column_stack([n_a, n_b, groups, n_links, ok])])
        self.links = np.concatenate([self.links, links[1]])

    def _tiled(self, ids, whole: list[bytes]) -> np.ndarray:
        """Whether both tokenizers' tokens of each unit join to its bytes."""
        joined = [b"".join(map(table.__getitem__, chain.from_iterable(own))) for own, table in zip(ids, (self.bytes_a, self.bytes_b))]
        sizes = [np.add.reduceat(np.append(table[np.fromiter(chain.from_iterable(own), np.int64)], 0), starts) * (n > 0)
                 for own, table in zip(ids, (self.size_a, self.size_b))
                 for n in [np.fromiter(map(len, own), np.int64, len(own))] for starts in [np.cumsum(n) - n]]
        size = np.fromiter(map(len, whole), np.int64, len(whole))
        text = b"".join(whole)
        if joined[0] == text == joined[1] and (sizes[0] == size).all() and (sizes[1] == size).all():
            return np.ones(len(whole), bool)
        return np.array([b"".join(map(self.bytes_a.__getitem__, x)) == w == b"".join(map(self.bytes_b.__getitem__, y))
                         for x, y, w in zip(*ids, whole)], bool)

    def aligned(self, ids_a: list[list[int]], ids_b: list[list[int]], size: np.ndarray):
        """Of units (of ``size`` bytes, which their tokens tile): groups of
        each; links in order, as (last byte, A id * 2**32 + B id); and the
        groups of each as text."""
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
        common, (stop_a, stop_b), ends_a, ends_b = self.groups(a, b)
        unit_end = np.cumsum(size)
        unit = np.searchsorted(unit_end, common)  # of each group: ends don't cross units
        groups = np.bincount(unit, minlength=len(size))
        # Links: within a slice every end of either side closes one overlap.
        ends = np.union1d(ends_a, ends_b)
        links = (ends, a[np.searchsorted(ends_a, ends)] << 32 | b[np.searchsorted(ends_b, ends)]) if len(a) else (ends, a)
        return groups, links, self._written(a, b, stop_a, stop_b, groups)

    def groups(self, a: np.ndarray, b: np.ndarray):
        """Ends (bytes) of the groups of two id sequences that tile the same
        bytes, the ends of their slices, and the ends of all tokens."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        index_a = dict(zip(ends_a.tolist(), range(1, len(a) + 1)))
        index_b = dict(zip(ends_b.tolist(), range(1, len(b) + 1)))
        common = sorted(index_a.keys() & index_b.keys())
        stops = tuple(np.fromiter(map(x.__getitem__, common), np.int64, len(common)) for x in (index_a, index_b))
        return common, stops, ends_a, ends_b

    def _written(self, a, b, stop_a, stop_b, groups) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each unit, from the slices' ends."""
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[stop_a - 1] = last_b[stop_b - 1] = True
        # A slice's A ids come after the B ids of the slices before, its B ids after its own A ids.
        group_a, group_b = (np.cumsum(x) - x for x in (last_a, last_b))
        at_a = np.arange(len(a)) + np.concatenate([[0], stop_b])[group_a]
        at_b = np.arange(len(b)) + stop_a[group_b] if len(b) else np.zeros(0, np.int64)
        parts, sizes = np.empty(len(a) + len(b), object), np.zeros(len(a) + len(b) + 1, np.int64)
        parts[at_a] = np.where(last_a, self.bar[a], self.comma[a])
        parts[at_b] = np.where(last_b, self.semicolon[b], self.comma[b])
        sizes[at_a + 1], sizes[at_b + 1] = self.digits[a] + 1, self.digits[b] + 1
        text, upto = "".join(parts.tolist()), np.cumsum(sizes)
        done = np.cumsum(groups)
        stop = np.concatenate([[0], upto[(stop_a + stop_b)]])[done].tolist()
        start = [0, *stop[:-1]]
        return [text[i:j - 1] if j > i else "" for i, j in zip(start, stop)]


@lru_cache(maxsize=2)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0].. for size[0] numbers, start[1].. for size[1], in one array."""
    stop = np.cumsum(size)
    return np.repeat(start - stop + size, size) + np.arange(int(stop[-1]) if len(stop) else 0)


def _align_block(pair: Pair, texts: list[str]) -> tuple:
    """Per text: A and B tokens, groups, links, digest, places in the block's
    pairs and counts there; then the block's pairs and counts."""
    if len(pair.texts) > _UNITS or len(pair.links) > _LINKS:
        pair.clear()
    units = [_CUT.split(t) if t else [] for t in texts]
    missing = [u for u in dict.fromkeys(chain.from_iterable(units)) if u not in pair.place]
    if missing:
        pair.learn(missing)
    size = np.fromiter(map(len, units), np.int64, len(units))
    at = np.fromiter(map(pair.place.__getitem__, chain.from_iterable(units)), np.int64, int(size.sum()))
    own = np.repeat(np.arange(len(texts)), size)
    # Only the units of this block are looked at, not all that are remembered.
    used, at = np.unique(at, return_inverse=True)
    counts = pair.counts[used]
    first = (np.cumsum(pair.counts[:, 3]) - pair.counts[:, 3])[used]
    many = counts[:, 3]
    bad = np.zeros(len(texts), bool)
    bad[own[counts[at, 4] == 0]] = True
    keep = ~bad[own]
    at, own = at[keep], own[keep]
    starts = np.searchsorted(own, np.arange(len(texts) + 1))
    sums = np.zeros((len(at) + 1, 4), np.int64)
    np.cumsum(counts[at, :4], axis=0, out=sums[1:])
    sums = sums[starts[1:]] - sums[starts[:-1]]
    place = used[at].tolist()
    digest = [hashlib.sha256(";".join([pair.texts[u] for u in place[i:j]]).encode()).hexdigest() if j > i else ""
              for i, j in zip(starts[:-1].tolist(), starts[1:].tolist())]
    # Links of each unit once, numbered in the block's list of pairs.
    codes = pair.links[_spread(first, many)]
    begin = np.cumsum(many) - many
    listed, number = np.unique(codes, return_inverse=True)
    links = number[_spread(begin[at], many[at])]
    owner = np.repeat(own, many[at])
    both, times = np.unique(owner * max(1, len(listed)) + links, return_counts=True)
    text_of, held = both // max(1, len(listed)), both % max(1, len(listed))
    per_text = np.bincount(text_of, minlength=len(texts))
    total = np.bincount(links, minlength=len(listed))
    seen = total > 0  # pairs of texts without tokens aren't the block's
    renumber = np.cumsum(seen) - 1
    return sums, digest, per_text, renumber[held] if len(held) else held, times, listed[seen], total[seen]


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Step 4, lazily: block, id, n_a, n_b, n_groups, n_links, groups_sha256,
    places and times of the text's pairs; the first row of a block also holds
    the block's ``pairs`` (ascending) and ``counts``."""
    path_a, path_b = tokenizers or default_tokenizers()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"block long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "places array<int>, times array<int>, pairs array<bigint>, counts array<bigint>")
    names = ["block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times", "pairs", "counts"]

    def run(batches):
        pair, block = _pair(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offs = utf8(batch.column(1))
            for i, j in blocks(offs, block_bytes):
                sums, digest, per, held, times, pairs, counts = _align_block(pair, batch.column(1).slice(i, j - i).to_pylist())
                n = j - i
                once = np.zeros(n, np.int64)
                once[0] = len(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block, np.int64)), batch.column(0).slice(i, n), *[pa.array(sums[:, k]) for k in range(4)],
                     pa.array(digest, pa.string()), lists(per, pa.array(held.astype(np.int32))), lists(per, pa.array(times.astype(np.int32))),
                     lists(once, pa.array(pairs.astype(np.int64))), lists(once, pa.array(counts.astype(np.int64)))], names=names)
                block += 1

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def block_pairs(found: DataFrame) -> DataFrame:
    """block, pair, n: how many links of a block hold a pair."""
    return (found.where(F.size("pairs") > 0).select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
            .select("block", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n")))


def link_counts(found: DataFrame) -> DataFrame:
    """pair, a, b, total, highest: links of all texts that hold an id pair, and
    whether no pair of that B id has more."""
    a, b = F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    total = block_pairs(found).groupBy("pair").agg(F.sum("n").alias("total")).select("pair", a, b, "total")
    top = total.groupBy("b").agg(F.max("total").alias("top"))
    return total.join(top, "b").select("pair", "a", "b", "total", (F.col("total") == F.col("top")).alias("highest"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Tokens, groups and links of each text, and how its links stand in all texts."""
    found = stored(aligned(docs, id_col, text_col, tokenizers, block_bytes))
    answers = block_pairs(found).join(link_counts(found), "pair").select(
        F.col("block").alias("of"), "pair", "total", "highest")

    def look_up(texts: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known["pair"].to_numpy())
        total = known["total"].to_numpy()[order]
        highest = known["highest"].to_numpy()[order].astype(np.int64)
        places, times = (texts[c].combine_chunks() for c in ("places", "times"))
        offs = np.asarray(places.offsets, np.int64)
        at, n = places.values.to_numpy(), times.values.to_numpy().astype(np.int64)
        run = lambda x: np.concatenate([[0], np.cumsum(x)])
        best, total = (run(x)[offs[1:]] - run(x)[offs[:-1]] for x in (n * highest[at], n * total[at]))
        cols = [texts[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*cols, pa.array(best), pa.array(total), texts["groups_sha256"]],
                        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (found.drop("pairs", "counts").groupBy("block").cogroup(answers.groupBy("of"))
            .applyInArrow(look_up, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                   "count_sum long, groups_sha256 string"))


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """One row a group: id, start and end (bytes of space + text), and the ids of both tokenizers."""
    path_a, path_b = tokenizers or default_tokenizers()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        pair = _pair(path_a, path_b)
        for batch in batches:
            for row, text in enumerate(batch.column(1)):
                units = _CUT.split(text.as_py()) if text.as_py() else []
                if not units:
                    continue
                ids = pair.encode(units)
                if not pair._tiled(ids, [(" " + u).encode() for u in units]).all():
                    continue
                # The whole text as one unit: its units' tokens in a row.
                a, b = ([x for own in side for x in own] for side in ids)
                ends, stops = pair.groups(np.array(a, np.int64), np.array(b, np.int64))[:2]
                cut = lambda x, stop: [x[i:j] for i, j in zip([0, *stop[:-1]], stop)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([row] * len(ends))), pa.array([0, *ends[:-1]], pa.int64()), pa.array(ends, pa.int64()),
                     pa.array(cut(a, stops[0].tolist()), pa.list_(pa.int32())), pa.array(cut(b, stops[1].tolist()), pa.list_(pa.int32()))],
                    names=["id", "start", "end", "a", "b"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, start long, `end` long, a array<int>, b array<int>")
