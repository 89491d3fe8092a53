import random

import numpy as np
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lingualens.llm import suffix_dedup as S

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   *[StructField(c, StringType()) for c in ("t", "t1", "h", "lo", "n_bytes")]])


def key(x):
    return tuple(map(repr, x))


def corpus() -> list[tuple]:
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdeé ", k=rnd.randint(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    passages = [say(k) for k in (28, 33, 36, 40, 60, 200)]
    rows = []
    for i in range(70):
        t = say(rnd.choice([3, 30, 120]))
        for p in rnd.sample(passages, rnd.choice([0, 1, 1, 2])):
            a = rnd.randrange(0, max(1, len(p) // 3))
            t += p[a:a + rnd.choice([150, 199, 200, 201, 260, 5000])] + say(rnd.choice([0, 1, 20]))
        rows.append((i, t))
    near = say(300).split(" ")
    for i in range(12):
        t = list(near)
        for _ in range(i % 4):
            t[rnd.randrange(len(t))] = word()
        rows.append((100 + i, " ".join(t)))
    hot = say(45)
    rows += [(200 + i, say(2) + hot + say(2)) for i in range(60)]
    rows += [(300, None), (301, ""), (302, "x" * 199), (303, "x" * 200), (304, "y" * 5000), (305, "ab" * 900), (306, rows[5][1]),
             (5, rows[5][1]), (None, rows[6][1]), (307, "z" * 200), (307, "z" * 200), (308, say(40) * 2), (309, "é" * 100), (310, "né" * 90)]
    return rows


@pytest.mark.parametrize("group_rows", [4096, 3])
def test_equals_brute_force(spark, group_rows):
    rows = corpus()
    d = spark.createDataFrame([(*r, *["q"] * 5) for r in rows], DOCS)
    got = sorted((tuple(r) for r in S.digest(d, group_rows=group_rows).collect()), key=key)
    assert got == sorted(S.reference(rows), key=key)
    assert sum(r[2] > 0 for r in got) > 50


def test_very_long_text_and_empty_table(spark):
    rnd = random.Random(1)
    long = "".join(rnd.choices("abcdefgh ", k=1_300_000))
    rows = [(1, long), (2, "start " + long[S.CHUNK - 150:S.CHUNK + 150] + " end"), (3, long[700_000:700_199])]
    d = spark.createDataFrame([(*r, *["q"] * 5) for r in rows], DOCS)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in S.digest(d).collect()}
    assert got == {1: (300, 1), 2: (300, 1), 3: (0, 0)}
    assert S.digest(spark.createDataFrame([], DOCS)).collect() == []


def test_suffix_sort_orders_and_finds_repeats():
    rng = np.random.default_rng(3)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    buf[3000:3600] = buf[100:700]
    s = S.Suffixes(np.concatenate([buf, np.zeros(8, np.uint8)]), 40)
    size = np.array([1, 700, 2, 0, 1200])
    size = size[size > 0]
    x = rng.choice(3960, size.sum(), replace=False)
    got, at = s.sort(x, size), 0
    raw = buf.tobytes()
    for n in size:
        assert [raw[i:i + 40] for i in got[at:at + n]] == sorted(raw[i:i + 40] for i in x[at:at + n])
        at += n
    found = s.repeated(np.arange(3960), np.array([3960]))
    from collections import Counter
    c = Counter(raw[i:i + 40] for i in range(3960))
    assert found.tolist() == [i for i in range(3960) if c[raw[i:i + 40]] > 1]
