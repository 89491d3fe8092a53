import random

import numpy as np
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lingualens.llm import decontam, packing
from lingualens.llm.textbytes import ALNUM, Words

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   StructField("n_words", StringType()), StructField("length", StringType())])
ITEMS = StructType([StructField("item_id", LongType()), StructField("text", StringType()),
                    StructField("n_hit", StringType())])


def test_words_keep_text_borders():
    texts = [b"Ab c", b"", b"d9-E", b"\xc3\xa9x"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    w = Words(data, np.cumsum([0, *map(len, texts)]), ALNUM)
    assert [w.text(w.first[i], w.first[i + 1]) for i in range(4)] == [b"ab c", b"", b"d9 e", b"\xc3\xa9x"]
    assert w.shingles(2)[1].tolist() == [True, False, True, False, False]


@pytest.mark.parametrize("block_bytes", [1 << 24, 200])
def test_contamination_equals_brute_force(spark, block_bytes):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(12)] + ["É", "x1"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 3, 12, 13, 30])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "..."), (0, items[0][1]), (None, items[1][1])]
    docs = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([0, 2, 40, 400])))) for i in range(40)]
    docs += [(i + 100, "clean words only " * 9 + it[1].upper().replace(" ", ", ") + " tail") for i, it in enumerate(items[:20])]
    docs += [(7, None), (7, None), (None, items[3][1]), (8, "x" * 200_000)]
    d = spark.createDataFrame([(a, b, "q", None) for a, b in docs], DOCS)
    it = spark.createDataFrame([(a, b, "q") for a, b in items], ITEMS)
    r = decontam.contamination(d, it, name="r", block_bytes=block_bytes).select("doc_id", "r.*")
    got = sorted(((x[0] is None, x[0], x[1], x[2], tuple(x["items"])) for x in r.collect()), key=repr)
    want = decontam.reference(docs, items)
    full = sorted(((a is None, a, b, c, n) for a, b, c, n, *_ in want), key=repr)
    assert [(*g[:4], len(g[4])) for g in got] == full
    if block_bytes > 200:
        key = lambda x: tuple(map(repr, x))
        assert sorted((tuple(x) for x in decontam.digest(d, it).collect()), key=key) == sorted(want, key=key)


def test_contamination_of_empty_tables(spark):
    d, it = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontam.digest(d, it).collect() == []
    one = spark.createDataFrame([(1, "a b", None, None)], DOCS)
    assert [tuple(x)[:4] + (x[5],) for x in decontam.digest(one, it).collect()] == [(1, 2, 0, 0, False)]


def test_word_splitting_equals_the_tokenizer():
    cache = packing.word_cache(packing.default_tokenizer())
    texts = ["", "a", "it's you're '' ''s 'S 'RE can't''re x'll'd 12ab\xbd\xb2", "İstanbul ΣΑΣ é 日本語",
             "<|endoftext|> b", "don’t – “q” €　x\x1cy \x85 À", "'", "é combining", "\n\n a \t", "x" * 5000]
    for order in (texts, texts[::-1], texts * 2):
        ids, total = packing.encode_texts(cache, order)
        cut = np.cumsum(total)[:-1]
        assert [x.tolist() for x in np.split(ids, cut)] == [cache.tok.encode(t, add_special_tokens=False).ids for t in order]


def test_packing_round_trip(spark):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choices(["ab", "cd's", "9", "naïve"], k=rnd.choice([0, 3, 20, 90])))) for i in range(300)]
    docs += [(5, None), (None, "x"), (3, "same"), (3, "same"), (999, "long " * 700)]
    d = spark.createDataFrame([(a, b, "q", "z") for a, b in docs], DOCS)
    rows = packing.packed(d, seq_len=128).collect()
    cache = packing.word_cache(packing.default_tokenizer())
    want = sorted(len(cache.tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
    by_seq: dict = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == 128 or r.length < 128
    for v in by_seq.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 128
    assert sum(r.length for r in rows) == sum(want)
    assert len(by_seq) <= 1.02 * sum(want) / 128 + 1
    assert sum(1 for r in rows if r.doc_id == 999) == -(-701 // 128)


def test_packing_of_an_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], DOCS)).collect() == []


def test_plan_uses_every_length_once():
    rnd = random.Random(1)
    hist = {k: rnd.randint(1, 5000) for k in rnd.sample(range(1, 513), 300)}
    groups = packing.plan(hist, 512)
    used: dict = {}
    for lengths, k in groups:
        assert sum(lengths) <= 512
        for v in lengths:
            used[v] = used.get(v, 0) + k
    assert used == hist
    counts = np.zeros(513, np.int64)
    for k, v in hist.items():
        counts[k] = v
    n = sum(k for _, k in groups)
    assert n <= sum(k for _, k in packing.best_fit(counts, 512))
    assert n <= 1.05 * sum(k * v for k, v in hist.items()) / 512


def test_patterns_reach_the_bound_where_they_can():
    hist = {100: 3000, 156: 3000, 256: 3000, 212: 3000, 300: 3000}  # 100+156+256 and 212+300
    assert sum(k for _, k in packing.plan(hist, 512)) == 6000
