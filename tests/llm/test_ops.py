"""Operators 2, 3, 4, 6, 8, 9 and 10 against brute force, SQL and edge cases."""

import datetime as dt
import math
import random
import struct

import duckdb
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lingualens.llm import chat, langid, mtree, ngram_join, pii, queries, secrets, url_filter
from scripts.oracle_check import close, rows_of

from ..conftest import SMALL

#: Extra columns whose names are also the operators' own.
CLASH = [StructField(c, StringType()) for c in ("n", "k1", "s1", "kind", "token", "spans", "lang_pred", "r")]
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), *CLASH])


def docs_of(spark, rows, lang="en"):
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else lang, *["x"] * len(CLASH)) for r in rows], DOCS)


def key(x):
    return tuple(map(repr, x))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck_small, name):
    sc, sr = rows_of(queries.QUERIES[name](spark, SMALL).toPandas())
    dc, dr = rows_of(duck_small.execute(queries.ORACLE_SQL[name]).df())
    assert sc == dc and len(sr) == len(dr)
    assert all(close(a, b) for a, b in zip(sr, dr))


# ------------------------------------------------------------------------ 2

def test_langid_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_langid_costs_equal_plain_ppm():
    rnd = random.Random(2)
    rows = []
    texts = {"a": "abab abba", "b": "bcbc ccbb aé"}
    from collections import Counter, namedtuple
    Row = namedtuple("Row", "lang key n")
    order = 2
    grams = {}
    for lang, t in texts.items():
        raw = b"\0" * order + t.encode()
        grams[lang] = Counter(raw[i:i + order + 1] for i in range(len(raw) - order))
        rows += [Row(lang, int.from_bytes(g, "little"), n) for g, n in grams[lang].items()]
    model = langid.build(rows, order)
    scorer = langid.Scorer(model)

    def plain(lang, text):
        raw, bits = b"\0" * order + text, 0.0
        import math
        for i in range(order, len(raw)):
            p, k = 1.0, order
            while True:
                if k < 0:
                    p /= 256
                    break
                after = Counter()
                for g, n in grams[lang].items():
                    if g[order - k:order] == raw[i - k:i]:
                        after[g[order]] += n
                total, distinct = sum(after.values()), len(after)
                if after[raw[i]]:
                    p *= after[raw[i]] / (total + distinct)
                    break
                p *= distinct / (total + distinct) if total else 1.0
                k -= 1
            bits -= math.log2(p)
        return bits

    import numpy as np
    samples = ["".join(rnd.choices("abc é", k=k)).encode() for k in (0, 1, 5, 40)]
    data = np.frombuffer(b"".join(samples), np.uint8)
    offs = np.cumsum([0, *map(len, samples)])
    for step in (1 << 18, 7):
        got = scorer.totals(data, offs, step)
        for i, s in enumerate(samples):
            for c, lang in enumerate(model.langs):
                assert got[i, c] == pytest.approx(plain(lang, s), rel=1e-5, abs=1e-6)


def test_langid_edges(spark):
    rows = [(i, "the cat and the dog " * 5, "en") for i in range(8)] + [(i + 50, "der hund und die katze " * 5, "de") for i in range(8)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 34 !", "en"), (None, "the cat", None), (None, "the cat", None), (3, "x " * 400_000, None)]
    got = langid.digest(docs_of(spark, rows))
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert all(by[i] == [("und", 0.0)] for i in (100, 101, 102))
    assert len(by[None]) == 2 and by[None][0][0] == "en"
    assert len(by[3]) == 2
    empty = docs_of(spark, [])
    assert langid.digest(empty).collect() == []
    alone = langid.digest(docs_of(spark, [(1, "some words", None)])).collect()
    assert alone[0].lang_pred == "und"


def test_langid_small_label_keeps_its_tree(spark):
    import numpy as np
    much = "".join(random.Random(3).choices([chr(c) for c in range(48, 123)], k=700_000))
    model = langid.learn(docs_of(spark, [(1, much, "big"), (2, much, "big"), (3, "été œuvre ñandú", "rare")]))
    assert model.langs == ["big", "rare"]
    scorer = langid.Scorer(model)
    for text, want in (("ñandú été", 1), (much[1000:1100], 0)):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert scorer.totals(raw, np.array([0, len(raw)])).argmin(1)[0] == want


# ------------------------------------------------------------------------ 3

TURNS = "conv_id long, turn long, role string, text string, position long, h1 string, kept string"


def test_chat_collapse(spark):
    t = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"),
         (3, 0, "user", "hi"), (3, 0, "user", "hi"), (4, 5, "user", "hi"), (4, 9, "assistant", "yo"), (4, 4000, "user", "more"),
         (5, 0, "user", None), (6, 0, "user", ""), (7, None, None, "hi"), (None, 0, "user", "hi"), (None, 1, "user", "z")]
    rows = chat.rendered(spark.createDataFrame([(*r, 1, "c", "c") for r in t], TURNS)).collect()
    assert {r.conv_id for r in rows} == {2, 5, 6, 7, None}
    two = sorted((r for r in rows if r.conv_id == 2), key=lambda r: r.position)
    whole = "".join(r.segment for r in two)
    assert all(whole[r.start:].startswith(r.segment) for r in two)
    assert whole == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert [r.trained for r in two] == [False, True, False]
    assert chat.rendered(spark.createDataFrame([], TURNS)).collect() == []


def test_chat_equals_sql_on_snapshots(spark):
    rnd = random.Random(4)
    turns = []
    for c in range(60):
        n = rnd.randint(1, 5)
        for i in range(n):
            turns.append((c, i * rnd.choice([1, 1, 700]), rnd.choice(["user", "assistant"]), rnd.choice("ab")))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    got = chat.rendered(spark.createDataFrame([(*r, 1, "c", "c") for r in turns], TURNS))
    assert rows_of(got.toPandas())[1] == rows_of(con.execute(chat.SQL).df())[1]


# ------------------------------------------------------------------------ 4

VECS = "vec_id long, embedding array<float>, score long, rank int, pivot int"


def test_top_k_equals_brute_force(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(50 * 60, None), (50 * 61, []), (50 * 62, [1.0, None] * 3),
             (50 * 63, [float("nan")] * 6), (50 * 64, [float("inf")] * 6), (50 * 65, [0.5] * 3), (50 * 66, [0.25] * 3),
             (None, [0.1] * 6), (7, rows[7][1]), (50 * 67, [0.0] * 6)]
    got = sorted(tuple(r) for r in mtree.digest(spark.createDataFrame([(a, b, 1, 1, 1) for a, b in rows], VECS)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [r for r in rows if r[0] is not None])
    assert got == sorted(con.execute(mtree.SQL).fetchall())
    assert mtree.digest(spark.createDataFrame([], VECS)).collect() == []


def test_top_k_takes_every_vector_of_an_id(spark):
    rnd = random.Random(12)
    rows = [(rnd.choice([5, 50, 100, 1000 + i]), [rnd.uniform(-1, 1) for _ in range(4)], 1, 1, 1) for i in range(300)]
    got = sorted(tuple(r) for r in mtree.digest(spark.createDataFrame(rows, VECS)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [r[:2] for r in rows])
    assert got == sorted(con.execute(mtree.SQL).fetchall())


def test_top_k_takes_every_equal_row(spark):
    rnd = random.Random(13)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    rows += [rows[59]] * 3 + [rows[50]] * 2 + [(70, rows[50][1])] * 5
    got = sorted(tuple(r) for r in mtree.digest(spark.createDataFrame([(a, b, 1, 1, 1) for a, b in rows], VECS)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert got == sorted(con.execute(mtree.SQL).fetchall())


def test_top_k_of_large_components(spark):
    rnd = random.Random(14)
    rows = [(i, [float(rnd.randint(-2 ** 21, 2 ** 21)) for _ in range(4)]) for i in range(120)]
    odd = [(1000, [1e9] * 4), (1050, [3e38, 0.0, 0.0, 0.0]), (1001, [-8e6, 8e6, 8e6, 8e6])]
    got = sorted(tuple(r) for r in mtree.digest(spark.createDataFrame([(a, b, 1, 1, 1) for a, b in rows + odd], VECS)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert got == sorted(con.execute(mtree.SQL).fetchall())


def test_top_k_query_takes_every_finite_vector(spark, tmp_path):
    rnd = random.Random(15)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    rows += [(1000, [1e9] * 4), (1001, [-8e6, 8e6, 8e6, 8e6]), (1002, [2e9, -2e9, 1.0, 0.5]), (1050, [1e7, -1e7, 3.0, 0.1]),
             (1051, [3e38, 0.0, 0.0, 0.0]), (1052, [2e38, 1.0, 0.0, 0.0]), (1053, [-3e38, 0.0, 0.0, 0.0]), (1100, [float("nan")] * 4)]
    spark.createDataFrame([(a, b, 1, 1, 1) for a, b in rows], VECS).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in queries.QUERIES["op4_mtree"](spark, str(tmp_path)).collect())
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    v = {i: [math.floor(256 * f32(x)) for x in e] for i, e in rows if e[0] == e[0]}
    want = []
    for q in (i for i in v if i % 50 == 0):
        best = sorted((-sum(x * y for x, y in zip(v[q], v[c])), c) for c in v if c != q)[:5]
        want += [(q, r + 1, c, min(max(-s, -2 ** 63), 2 ** 63 - 1)) for r, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert {1001, 1002, 1050} <= {c for _, _, c, _ in got}


def test_best_first_skips_pages():
    import numpy as np
    rng = np.random.default_rng(0)
    centres = rng.integers(-200, 200, (20, 8))
    x = np.concatenate([c + rng.integers(-3, 4, (64, 8)) for c in centres])
    top = float(np.sqrt((x.astype(float) ** 2).sum(1).max()))
    roots = mtree._lift(centres, top)
    parent, radius, pivot, held = [], [], [], []
    for i in range(20):
        own = x[64 * i:64 * i + 64]
        own_l = mtree._lift(own, top)
        dist = mtree._distances(own_l, own_l[:1])[:, 0]
        parent.append(float(mtree._distances(own_l[:1], roots[i:i + 1])[0, 0]))
        radius.append(float(dist.max()))
        pivot.append(i)
        held.append((own_l[:1], np.arange(64 * i, 64 * i + 64), own, dist))
    q = x[130]
    got, seen = mtree.best_first(130, q, None, top, roots, (np.array(parent), np.array(radius), np.array(pivot), held), 5)
    score = x @ q
    want = sorted(((-int(s), i) for i, s in enumerate(score) if i != 130))[:5]
    assert got == [(-s, i) for s, i in want]
    assert seen[0] < 20


# ------------------------------------------------------------------------ 6

SECRETS = [
    "password=abc123 token: 'zzzzzz' secret=token:abcdefgh API-key: nothing api_key = short",
    "AKIA" + "Q7" * 8 + " and " + "aB3" * 14 + " at https://x.example.com/a?b=c",
    "weak alone " + "aB3" * 14 + " https://x.example.com",
    "AKIA" + "Q7" * 8 + " " * 300 + "aB3" * 14, "deadbeef" * 3 + "zz" + "0" * 23, "AKIAAKIA" + "Z" * 12, "pässword é token=éabcdef",
    "AKIA" + "Q7" * 8 + ' secret="' + "aB3" * 14 + '" https://h.example.org ' + "f" * 24,
]


def test_secrets_equal_brute_force(spark):
    rows = list(enumerate(SECRETS)) + [(20, None), (21, ""), (1, SECRETS[1]), (1, SECRETS[1]), (None, SECRETS[0]), (1, SECRETS[0])]
    rows += [(30, "x " * 100_000 + "token=abcdefg " * 50 + SECRETS[1])]
    rnd = random.Random(8)
    parts = SECRETS + [" ", "\n", "é", "token=", "AKIA", "0123456789abcdef0123456789"]
    rows += [(100 + i, "".join(rnd.choices(parts, k=6))) for i in range(40)]
    got = sorted((tuple(r) for r in secrets.digest(docs_of(spark, rows)).collect()), key=key)
    assert got == sorted((secrets.reference(*r[:2]) for r in rows), key=key)
    assert secrets.digest(docs_of(spark, [])).collect() == []


def test_secrets_redacted(spark):
    rows = [(1, SECRETS[7] + " tail"), (2, "clean"), (3, None), (1, SECRETS[7] + " tail")]
    out = secrets.redacted(docs_of(spark, rows))
    assert out.columns == DOCS.names
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=key)
    masked = '<SECRET> secret="<SECRET>" https://h.example.org <SECRET> tail'
    assert got == sorted([(1, masked), (1, masked), (2, "clean"), (3, None)], key=key)


# ------------------------------------------------------------------------ 8

PII = ["a.b+c@x-y.co.uk, mail me@@z.com x@y", "1.2.3.4 256.1.1.1 1.2.3.4.5 0001.02.3.255 12.34.56", "4111 1111 1111 1111 5500-0000-0000-0004 4111111111111112",
       "+49 (30) 1234.567-8 +1 2 +123456789012345678", "IBAN DE89 3704 0044 0532 0130 00 ssn 123-45-6789", "plain 123-45-6789 text é@é.de", "a@b.c_d@e.f"]


def test_pii_equals_plain_patterns(spark):
    rnd = random.Random(9)
    rows = list(enumerate(PII)) + [(20, None), (21, ""), (1, PII[1]), (1, PII[1]), (None, PII[0]), (31, "1" * 60_000), (32, "a" * 60_000 + "@")]
    rows += [(100 + i, "".join(rnd.choices([*PII, " ", "4", "+", "@", ".", "-"], k=8))) for i in range(150)]
    got = sorted((tuple(r)[:6] for r in pii.digest(docs_of(spark, rows)).collect()), key=key)
    assert got == sorted((pii.reference(*r[:2]) for r in rows), key=key)
    assert pii.digest(docs_of(spark, [])).collect() == []


def test_pii_context_and_check_digits():
    kinds = lambda t: [s[0] for s in pii.scored(t)]
    assert kinds("my ssn 123-45-6789") == ["national_id"] and kinds("order 123-45-6789") == []
    assert kinds("DE89370400440532013000") == ["iban"] and kinds("DE88370400440532013000") == []
    assert pii.masked("write a@b.cd now") == "write <email> now"


def test_pii_account_before_capitals_or_digits():
    found = lambda t: [t[a:b] for k, a, b, _ in pii.scored(t) if k == "iban"]
    plain, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    assert found(f"IBAN {plain} BIC COBADEFFXXX") == found(f"{plain} 2 days") == found(f"AB12 {plain}") == [plain]
    assert found(f"IBAN {spaced} BIC COBADEFFXXX") == [spaced]
    assert found("NO9386011117947 BE68539007547034 X") == ["NO9386011117947", "BE68539007547034"]
    assert found("DE88370400440532013000 BIC COBADEFFXXX") == []
    assert pii.masked(f"to {spaced} BIC X") == "to <iban> BIC X"


# ------------------------------------------------------------------------ 9

def test_url_filter_as_of(spark):
    d = lambda n: dt.date(2024, 1, n)
    entries = spark.createDataFrame([("ex.com", d(5), "add", "spam"), ("ex.com", d(9), "remove", "spam"), ("a.ex.com/p", d(2), "add", "adult"),
                                     ("ex.com", d(9), "remove", "spam"), ("gone.org", d(3), "remove", "x"), (None, d(1), "add", "x")],
                                    "pattern string, day date, action string, category string")
    caps = [(1, "http://ex.com/", d(4)), (2, "http://ex.com/", d(5)), (3, "https://b.ex.com:80/x?y", d(8)), (4, "http://ex.com", d(9)),
            (5, "http://A.EX.com/p/q", d(7)), (6, None, d(7)), (7, "junk", d(7)), (8, "http://ex.com", None), (9, "http://gone.org", d(8)),
            (2, "http://ex.com/", d(5)), (10, "http://notex.com", d(6)), (11, "http://" + "a." * 200 + "ex.com", d(6))]
    rows = url_filter.judged(spark.createDataFrame([(*c, "z") for c in caps], "page_id long, url string, day date, host string"), entries).collect()
    got = sorted((r.page_id, r.pattern) for r in rows if r.blocked)
    assert got == [(2, "ex.com"), (2, "ex.com"), (3, "ex.com"), (5, "a.ex.com/p")]
    assert len(rows) == len(caps)
    none = spark.createDataFrame([], "page_id long, url string, day date")
    assert url_filter.judged(none, entries).collect() == []


def test_url_filter_takes_whole_hosts(spark):
    day = dt.date(2024, 1, 5)
    listed = ["münchen.de", "m", "exämple.com/a", "ex", "user", "ss", "a.org"]
    entries = spark.createDataFrame([(p, day, "add", "x") for p in listed], "pattern string, day date, action string, category string")
    urls = {"http://münchen.de/rathaus": "münchen.de", "http://www.MÜNCHEN.de": "münchen.de", "https://exämple.com/a": "exämple.com/a",
            "https://exämple.com/b": None, "http://ex%C3%A4mple.com/a": None, "http://ex!/": None, "http://user:pw@ex!/": None,
            "http://user:p@ss@a.org/": "a.org", "http://a.org \n": "a.org", "http://a.org?q": "a.org", "http://a.org:80#f": "a.org"}
    pages = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "page_id long, url string, day date")
    assert {r.url: r.pattern for r in url_filter.judged(pages, entries).collect()} == urls
    assert "münchen.de" in {r.pattern for r in url_filter.list_log(pages).collect()}


# ----------------------------------------------------------------------- 10

def test_ngram_join_equals_brute_force(spark):
    rnd = random.Random(10)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = rnd.choices(words, k=rnd.choice([5, 40, 120, 300]))
        for _ in range(rnd.choice([1, 4, 9])):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 5])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(900, None), (901, ""), (902, "  \n"), (903, "a b"), (904, "A\tb"), (905, "a"), (906, rows[0][1].upper()), (907, "a b c"), (1, rows[1][1])]
    shared = " ".join(rnd.choices(words, k=60))
    rows += [(1000 + i, shared + " " + " ".join(rnd.choices(words, k=30))) for i in range(20)]
    got = sorted(tuple(r) for r in ngram_join.joined(docs_of(spark, rows)).collect())
    assert got == sorted(ngram_join.reference(rows))


def test_ngram_links_equal_brute_force(spark):
    rnd = random.Random(21)
    base = [[rnd.choice("abcdefghij") + str(rnd.randrange(30)) for _ in range(rnd.choice([3, 12, 40, 90]))] for _ in range(12)]
    rows = []
    for i in range(90):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            w[rnd.randrange(len(w))] = "new" + str(rnd.randrange(5))
        rows.append((i, " ".join(w + ["tail"] * rnd.choice([0, 0, 1, 3]))))
    rows += [(90, None), (91, ""), (92, "one"), (93, "ONE"), (94, rows[0][1])]
    pairs, member = ngram_join.links(docs_of(spark, rows))
    sets = {i: frozenset(tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))) if (w := (t or "").lower().split()) else None for i, t in rows}
    of = {i: min(j for j in sets if sets[j] == s) if s else None for i, s in sets.items()}
    reps = sorted({c for c in of.values() if c is not None})
    want = {(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
    count = {c: sum(c in p for p in want) for c in reps}
    assert sorted(tuple(r) for r in member.select("doc_id", "class_id", "n_links").fillna(-1, "class_id").collect()) == sorted(
        (i, -1 if c is None else c, count.get(c, 0)) for i, c in of.items())


def test_pairs_of_a_template_grow_with_the_rows(spark):
    rnd = random.Random(22)
    template = [f"t{k}" for k in range(32)]
    formed = []
    for size in (400, 1600):
        rows = []
        for i in range(size):
            w = list(template)
            w[rnd.randrange(3, 29)] = f"u{i}"
            rows.append((i, " ".join(w)))
        d = docs_of(spark, rows).select("doc_id", "text").toDF("id", "t")
        r = ngram_join.signatures(d.select("id", *ngram_join.row_key("id", "t"), "t"), "t", 3, 90, 3, "s").select("id", "k1", "k2", "s.*")
        own = ngram_join.class_prefixes(d, r, "id", "t", 3, 90)
        other = own.select("token", *[own[c].alias(f"o{c}") for c in ("k1", "k2", "n", "pos")])
        formed.append(ngram_join.met(own, other, 90).where("k1 < ok1").count())
    assert formed[1] <= 4 * max(formed[0], 25)


def test_ngram_join_edges(spark):
    assert ngram_join.joined(docs_of(spark, [])).collect() == []
    rows = [(None, "one two three four"), (5, "one two three four"), (None, "lonely text here now"), (6, "y " * 300_000)]
    got = sorted((tuple(r) for r in ngram_join.joined(docs_of(spark, rows)).collect()), key=key)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (None, 2, None), (6, 1, 6)], key=key)


def test_order_filters_pass_every_link():
    import numpy as np
    rng = np.random.default_rng(5)
    passed = 0
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop, add = rng.integers(0, max(1, n // 8), 2)
        b = np.unique(np.concatenate([rng.choice(a, max(1, len(a) - drop), replace=False), rng.integers(0, 2**63, add).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        ok = ngram_join.may_link(len(a), ngram_join.starts(a, 90, 3), len(b), ngram_join.starts(b, 90, 3), 90, 3)
        if 100 * both >= 90 * (len(a) + len(b) - both):
            assert ok
            passed += 1
    assert passed > 50
    far = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    near = np.concatenate([a[:0], far[:60], rng.integers(0, 2**63, 240).astype(np.uint64)])
    near = np.unique(near)
    assert not ngram_join.may_link(len(far), ngram_join.starts(far, 90, 3), len(near), ngram_join.starts(near, 90, 3), 90, 3)


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, 0, i + 1, 0) for i in range(30)] + [(100, 0, 99, 0)], "a1 long, a2 long, b1 long, b2 long")
    got = {r.k1: r.c1 for r in ngram_join.components(e).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[100] == got[99] == 99
