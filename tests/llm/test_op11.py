"""Operator 11 against plain Python: neighbours, trees, likeness and spans of edits."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lingualens.llm import merkle as M

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   *[StructField(c, StringType()) for c in ("next", "fingerprint", "__range", "n_chars", "edited")]])


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *["q"] * 5) for r in rows], DOCS)


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def tree(text):
    """Root, and the leaves of each section, by a plain loop."""
    text = text or ""
    sections, now, hashes = [], ([], []), []
    paras = re.findall(r"[^\n]+\n*|\n+", text)
    for i, p in enumerate(paras):
        marks = "[.!?\n][.!? \n]{0,31}"
        leaves = [m.group() for m in re.finditer(f"[^.!?\n]{{1,{M.LEAF}}}(?:{marks})?|{marks}", p)]
        assert "".join(leaves) == p
        h = md5("".join(md5(x) + format(len(x), "03x") for x in leaves))
        now[0].append(h)
        now[1].extend(md5(x)[:13] + format(len(x), "03x") for x in leaves)
        if "\n\n" in p or h[0] < "2" or i == len(paras) - 1:
            hashes.append(md5("".join(now[0])))
            sections.append(now[1])
            now = ([], [])
    root = hashlib.sha256("".join(hashes).encode()).hexdigest()
    return root + "".join("/" + h[:16] + "".join("." + c for c in s) for h, s in zip(hashes, sections))


def near(a, b):
    if a[:64] == b[:64]:
        return 1.0
    x, y = ({c for s in f.split("/")[1:] for c in s.split(".")[1:]} for f in (a, b))
    w = lambda z: sum(int(c[13:], 16) for c in z)
    both = w(x) + w(y)
    return min(2 * w(x & y), both - 1) / both if both else 0.0


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[:len(t) - half] + nxt[:half]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), tree(t), tree(e), near(tree(t), tree(e)), near(tree(t), tree(nxt))))
    return out


def corpus():
    rnd = random.Random(11)
    say = lambda n: "".join(rnd.choice("abé😀 .!?\n,") if rnd.random() < .4 else rnd.choice("xyz ") for _ in range(n))
    rows = [(rnd.randrange(10_000), say(rnd.choice([0, 1, 2, 30, 400, 3000]))) for _ in range(120)]
    rows += [(20_000, None), (20_001, ""), (-5, "x" * 2000), (20_002, "a.\n\n\nb.\n" * 50), (20_003, "." * 500), (20_004, "\n" * 100),
             rows[3], rows[3], (rows[4][0], "other"), (None, "no id."), (None, None), (20_005, say(60_000))]
    return rows


def key(r):
    return tuple(map(repr, r))


@pytest.mark.parametrize("range_chars", [M.RANGE_CHARS, 700, 20])
def test_equals_brute_force(spark, range_chars):
    rows = corpus()
    got = sorted((tuple(r) for r in M.digest(docs_of(spark, rows).repartition(5), range_chars=range_chars).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(abs(a - b) < 1e-12 for x, y in zip(got, want) for a, b in zip(x[5:], y[5:]))


def test_single_row_and_empty_table(spark):
    (r,) = M.digest(docs_of(spark, [(7, "abcd")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0
    (r,) = M.digest(docs_of(spark, [(None, None)])).collect()
    assert (r.n_chars, r.near_edited, r.fingerprint) == (0, 1.0, hashlib.sha256(b"").hexdigest())
    assert M.digest(docs_of(spark, [])).collect() == []


def test_edits_cover_what_differs(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choices(["red", "green", "blue", "stone"], k=rnd.randint(3, 9))) + f" {i}." for i in range(300)]
    changed = list(base)
    changed[40], changed[200] = "A new sentence here.", "Another one."
    a, b = ("".join(s + ("\n" if i % 4 == 3 else " ") for i, s in enumerate(x)) for x in (base, changed))
    pairs = spark.createDataFrame([(1, a, b), (2, a, a), (3, None, a[:50]), (4, None, None)], "id long, a string, b string")
    got = M.edits(pairs, "id", "a", "b").collect()
    spans = {side: sorted((r.start, r.start + r.length) for r in got if r.id == 1 and r.side == side) for side in "ab"}
    assert ["".join(t[x:y]) for side, t in (("a", a), ("b", b)) for x, y in spans[side]] == [
        base[40] + " ", base[200] + " ", "A new sentence here. ", "Another one. "]
    assert not any(r.id in (2, 4) for r in got)
    assert sum(r.length for r in got if r.id == 3 and r.side == "b") == 50


def test_equal_texts_have_equal_fingerprints_and_only_they(spark):
    texts = ["a.b", "a. b", "a.\nb", "a\n.b", "", "a.ba.b", "a.b"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.f for r in M.fingerprinted(d.coalesce(1), "text", "f").select("f").collect()]
    assert len(set(got)) == 6 and got[0] == got[6]
    assert M.compared(spark.createDataFrame([(got[0], got[5])], "x string, y string"), "x", "y", "z").where(F.col("z") == 1).count() == 0
