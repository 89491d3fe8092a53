"""Operator 13 against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lingualens.llm import spelling as S

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   *[StructField(c, StringType()) for c in ("word", "n", "size", "window", "form")]])


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *["q"] * 5) for r in rows], DOCS)


def count(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(words):
    out, form = [], {}
    close = {w: [v for v in words if near(w, v)] for w in words}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(close[w]), words.get(form[w])))
    return sorted(out)


def got_of(df):
    return sorted(tuple(r) for r in df.collect())


def corpus():
    rnd = random.Random(13)
    base = ["".join(rnd.choices("abcdeéÀ", k=rnd.randint(5, 12))) for _ in range(60)]
    base += ["x" * 300, "ab" * 4000, "aaaaaa", "aaaaaaa", "aaaaaaaa"]
    words = []
    for w in base:
        words += [w] * rnd.choice([6, 40, 300] if len(w) < 100 else [8])
        for _ in range(8):
            k, v = rnd.randrange(len(w) + 1), rnd.choice("abÿ")
            e = rnd.choice([w[:k] + v + w[k:], w[:k] + v + w[k + 1:], w[:k] + w[k + 1:]])
            words += [e] * rnd.choice([3, 5, 7, 30, 60])
    words += ["chainword"] * 300 + ["chainwor"] * 40 + ["chainwo"] * 6
    rnd.shuffle(words)
    rows = [(i, rnd.choice([" ", "-", "×"[:0] + ", "]).join(words[k:k + 25])) for i, k in enumerate(range(0, len(words), 25))]
    rows += [(0, None), (1, ""), (None, " ".join(words[:50])), rows[2], rows[2], (7, "Ébène ÉBÈNE Œuvre œuvres 1234 " * 9), (8, "日本 " + "Words÷words×WORDS " * 9)]
    return rows


@pytest.mark.parametrize("block", [S.BLOCK, 3])
def test_equals_brute_force(spark, block):
    rows = corpus()
    words = count(rows)
    counted = S.word_counts(docs_of(spark, rows).repartition(4))
    assert dict(map(tuple, counted.collect())) == words
    want = brute(words)
    assert got_of(S.variants(counted, block=block)) == want
    assert sum(r[1] is not None for r in want) > 40 and any(r[1] not in (None, r[2]) for r in want)


def test_whole_query(spark):
    rows = corpus()[:40]
    assert got_of(S.digest(docs_of(spark, rows))) == brute(count(rows))


def test_hot_group_and_other_scripts(spark):
    rnd = random.Random(5)
    words = {"пре" + "".join(rnd.choices("абв😀", k=3)): rnd.choice([5, 6, 40, 900]) for _ in range(64)} | {"w": 10 ** 15, "wa": 7}
    d = spark.createDataFrame(list(words.items()), "word string, n long")
    for block in (4, 100):
        assert got_of(S.variants(d, block=block)) == brute(words)


def test_long_chain_and_empty_tables(spark):
    words = {"a" * (6 + k): 5 ** (k + 1) for k in range(25)}
    d = spark.createDataFrame(list(words.items()), "word string, n long")
    got = got_of(S.variants(d))
    assert {r[2] for r in got} == {"a" * 30} and got == brute(words)
    assert S.digest(docs_of(spark, [])).collect() == []
    assert S.digest(docs_of(spark, [(1, None), (2, "short words only")])).collect() == []
