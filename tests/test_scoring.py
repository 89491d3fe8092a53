"""BLEU, chrF and WER against plain-Python brute force."""

import math
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from lingualens.operators import scoring

WORD = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")


def py_bleu(hyp, ref, max_order=4):
    if hyp is None:
        return 0.0
    h, r = WORD.findall(hyp), WORD.findall(ref)
    if not h:
        return 0.0
    precs = []
    for n in range(1, max_order + 1):
        hc = Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
        rc = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
        m = sum(min(c, rc[g]) for g, c in hc.items())
        possible = len(h) - n + 1
        precs.append(m / possible if possible > 0 else 0.0)
    geo = math.exp(sum(math.log(p) for p in precs) / max_order) if min(precs) > 0 else 0.0
    ratio = len(h) / len(r) if r else float("inf")
    bp = 1.0 if ratio > 1.0 else math.exp(1 - 1.0 / ratio)
    return geo * bp


def py_chrf(hyp, ref, order=6, beta=2.0):
    if hyp is None:
        return 0.0
    h, r = "".join(hyp.split()), "".join(ref.split())
    ap = ar = 0.0
    eff = 0
    for n in range(1, order + 1):
        hc = Counter(h[i:i + n] for i in range(len(h) - n + 1))
        rc = Counter(r[i:i + n] for i in range(len(r) - n + 1))
        if sum(hc.values()) > 0 and sum(rc.values()) > 0:
            m = sum(min(c, rc[g]) for g, c in hc.items())
            ap += m / sum(hc.values())
            ar += m / sum(rc.values())
            eff += 1
    if eff == 0:
        return 0.0
    ap, ar = ap / eff, ar / eff
    if ap + ar == 0:
        return 0.0
    return (1 + beta ** 2) * ap * ar / (beta ** 2 * ap + ar)


def edit_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


CASES = [
    ("the cat sat on the mat", "the cat sat on the mat"),
    ("the cat sat on the mat today", "the cat sat on the mat"),
    ("the cat", "the cat sat on the mat"),
    ("Le chat, très content!", "le chat est très content !"),
    ("completely different words", "nothing in common here at all"),
    (None, "reference only"),
    ("a a a a b", "a a b b b"),
]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(CASES)],
                                 "id int, hyp string, ref string")


def test_bleu_matches_python(pairs):
    out = {r.id: r.bleu for r in scoring.bleu_scores(pairs, ["id"], "hyp", "ref").collect()}
    for i, (h, r) in enumerate(CASES):
        assert out[i] == pytest.approx(py_bleu(h, r), abs=1e-12), (h, r)
    assert out[0] == pytest.approx(1.0)


def test_chrf_matches_python(pairs):
    out = {r.id: r.chrf for r in scoring.chrf_scores(pairs, ["id"], "hyp", "ref").collect()}
    for i, (h, r) in enumerate(CASES):
        assert out[i] == pytest.approx(py_chrf(h, r), abs=1e-12), (h, r)


def test_wer_matches_brute_force_on_fixture(spark):
    from lingualens.plans.context import Ctx
    from lingualens.plans.q_scoring import _pairs
    from .conftest import SMALL
    ctx = Ctx(spark, SMALL)
    p = _pairs(ctx).withColumn("model", F.concat(F.lit("m"), (F.col("conv_id") % 7).cast("string")))
    got = {r.model: (r.edits, r.ref_words) for r in
           scoring.word_error_rate(p, ["model"], "prediction", "reference").collect()}
    want = {}
    for r in p.collect():
        h, ref = WORD.findall(r.prediction or ""), WORD.findall(r.reference or "")
        e, n = want.get(r.model, (0, 0))
        want[r.model] = (e + edit_distance(h, ref), n + len(ref))
    assert got == want


def test_pieces_give_the_same_counts(spark):
    import random
    rnd = random.Random(9)
    words = ["a", "bb", "été", "😀x", "z9"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 2, 9, 40]))), " ".join(rnd.choices(words, k=rnd.choice([1, 7, 8, 9, 33])))) for i in range(60)]
    d = spark.createDataFrame(rows, "id int, h string, r string")
    for kind, orders, col in (("char", [1, 2, 3, 4, 5, 6], lambda c: scoring.no_space(F.col(c))), ("word", [1, 2, 3, 4], lambda c: scoring.word_tokens(F.col(c)))):
        p = d.select("id", col("h").alias("h"), col("r").alias("r"))
        at = lambda size: sorted(map(tuple, scoring.ngram_matches(p, ["id"], "h", "r", orders, kind, size).collect()))  # noqa: B023, E731
        whole = at(10 ** 6)
        assert len(whole) > 200 and all(at(size) == whole for size in (max(orders) - 1, max(orders), 8, 9))


def test_a_long_text_is_scored_in_pieces(spark):
    h = "".join(chr(97 + (i * i + i // 7) % 23) for i in range(1_500_000))
    d = spark.createDataFrame([(1, h, h[:700_000] + "zz" + h[700_000:]), (2, "ab", "ab")], "id int, h string, r string")
    out = {r.id: r.chrf for r in scoring.chrf_scores(d, ["id"], "h", "r").collect()}
    assert out[2] == pytest.approx(1.0) and 0.9999 < out[1] < 1.0


def test_ngrams_are_counted_where_the_pair_is(spark):
    """No n-gram is a row: nothing is shuffled, grouped or exploded for a score."""
    rows = [(i, None if i % 7 == 0 else "a bé 😀 c " * (i % 5), "bé 😀 a " * (i % 4)) for i in range(40)]
    d = spark.createDataFrame(rows, "id int, h string, r string")
    for score, brute in ((scoring.chrf_scores, py_chrf), (scoring.bleu_scores, py_bleu)):
        out = score(d, ["id"], "h", "r")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Aggregate", "Generate"))
        for r in out.collect():
            assert r[1] == pytest.approx(brute(*rows[r.id][1:]), abs=1e-12)
