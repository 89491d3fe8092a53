"""Operator 12 against whole-text encoding and plain loops over byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql.types import LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from lingualens.llm import align as A

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   *[StructField(c, StringType()) for c in ("block", "id", "pairs", "n_a", "total")]])


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *["q"] * 5) for r in rows], DOCS)


@pytest.fixture(scope="module")
def coders():
    path_a, path_b = A.default_tokenizers()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=path_b), A.Pair(path_a, path_b)


def brute(rows, coders):
    """The contract's columns, from whole texts."""
    a, b, pair = coders
    out, links_of = [], []
    for i, text in rows:
        ids_a, ids_b = ([], []) if not text else (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
        raw_a, raw_b = [pair.bytes_a[t] for t in ids_a], [pair.bytes_b[t] for t in ids_b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            out.append([i, 0, 0, 0, 0, ""])
            links_of.append([])
            continue
        spans = []
        for raw in (raw_a, raw_b):
            at, own = 0, []
            for r in raw:
                own.append((at, at + len(r)))
                at += len(r)
            spans.append(own)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, links, last = [], [], 0
        for e in ends:
            inside = [[k for k, (x, y) in enumerate(s) if last <= x and y <= e] for s in spans]
            groups.append("|".join(",".join(str(ids[k]) for k in ks) for ids, ks in zip((ids_a, ids_b), inside)))
            links += [(ids_a[k], ids_b[m]) for k in inside[0] for m in inside[1]
                      if spans[0][k][0] < spans[1][m][1] and spans[1][m][0] < spans[0][k][1]]
            last = e
        out.append([i, len(ids_a), len(ids_b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        links_of.append(links)
    count = Counter(p for x in links_of for p in x)
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return sorted((tuple(map(repr, (*r[:5], sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), r[5])))
                   for r, x in zip(out, links_of)))


def corpus():
    rnd = random.Random(12)
    pieces = ["the", "naïve", "don't", "12345", "日本語", "😀", "a_b", "  ", "\n", "\t", " ", "́", " ", "<|endoftext|>", "<s>",
              "x" * 40, "...", " ", "\r\n", "Ünï", "\x1c", "\x85", "'s", "ﬁ", "\0"]
    rows = [(k, rnd.choice(["", " "]).join(rnd.choices(pieces, k=rnd.choice([1, 2, 5, 60])))) for k in range(150)]
    rows += [(k, "".join(chr(rnd.choice([32, 32, 10, 97, 98, 0xE9, 0x301, 0x4E00, 0x1F600, 0xA0])) for _ in range(200))) for k in range(200, 230)]
    return rows + [(300, None), (301, ""), (302, " "), (303, "a▁b"), (304, " lead"), (305, "trail "), (306, "a  b"), (307, "<|endoftext|>"),
                   rows[3], rows[3], (None, "no id"), (308, "word " * 5000), (309, "y" * 30_000), (310, "</s> <unk> <0x41>")]


@pytest.mark.parametrize("block_bytes", [A.BLOCK_BYTES, 300])
def test_equals_brute_force(spark, coders, block_bytes):
    rows = corpus()
    got = A.digest(docs_of(spark, rows).repartition(4), block_bytes=block_bytes).collect()
    assert sorted(tuple(map(repr, r)) for r in got) == brute(rows, coders)
    assert sum(r.n_links for r in got) > 5000


def test_units_forgotten_between_blocks(spark, coders, monkeypatch):
    rows = corpus()[:60]
    pair = A.Pair(*A.default_tokenizers())
    whole = A._align_block(pair, [t for _, t in rows])
    monkeypatch.setattr(A, "_UNITS", 3)
    again = A._align_block(pair, [t for _, t in rows])
    assert whole[1] == again[1] and (whole[0] == again[0]).all() and (whole[5] == again[5]).all()


def test_groups_tile_the_text(spark, coders):
    a, b, pair = coders
    text = "Où est-ce que l'été commence ?\nIci  même 😀."
    rows = A.alignments(docs_of(spark, [(1, text), (2, None), (3, "a▁b")])).orderBy("start").collect()
    raw = (" " + text).encode()
    assert {r.id for r in rows} == {1} and rows[0].start == 0 and rows[-1].end == len(raw)
    assert all(x.end == y.start for x, y in zip(rows, rows[1:]))
    for r in rows:
        assert b"".join(pair.bytes_a[t] for t in r.a) == raw[r.start:r.end] == b"".join(pair.bytes_b[t] for t in r.b)


def test_empty_table_and_table_without_tokens(spark):
    assert A.digest(docs_of(spark, [])).collect() == []
    (r,) = A.digest(docs_of(spark, [(1, None)])).collect()
    assert tuple(r) == (1, 0, 0, 0, 0, 0, 0, "")
