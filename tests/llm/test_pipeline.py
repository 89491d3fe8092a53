import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from lingualens.llm import decontam, langid, ngram_join, packing, secrets

from ..conftest import SMALL


def masked(text):
    """Plain form of ``secrets.redacted`` from the spans of ``secrets.reference``."""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    value = {m.span(): m.start(2) for m in assign.finditer(text)}
    cuts = []
    for span in filter(None, secrets.reference(0, text)[5].split(",")):
        kind, a, b = span.split(":")
        if kind != "endpoint":
            cuts.append((value[(int(a), int(b))] if kind == "assign" else int(a), int(b)))
    out, at = "", 0
    for a, b in sorted(cuts):
        if a >= at:
            out += text[at:a] + "<SECRET>"
        at = max(at, b)
    return out + text[at:]


def test_run_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [d for d in docs if d[1] and langid._LETTER.search(d[1])]
    kept = {c for _, _, c in ngram_join.reference(docs)}
    docs = [d for d in docs if d[0] in kept]
    docs = [d for d, r in zip(docs, decontam.reference(docs, items)) if not r[5]]
    cache = packing.word_cache(packing.default_tokenizer())
    want = []
    for d, t in docs:
        ids = np.array(cache.tok.encode(masked(t), add_special_tokens=False).ids + [0], "<u4")
        want += [(d, a // 2048, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes())) for a in range(0, len(ids), 2048)]
    got = [tuple(r)[:5] for r in P.run(spark, SMALL).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_columns_and_rows_of_clean_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("n_words", F.lit("x")).withColumn("k1", F.lit(None).cast("long"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.schema.names == docs.schema.names, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert stage(spark, docs.where("false"), SMALL).collect() == [], name
    assert P.STAGES[-1][1](spark, docs.where("false"), SMALL).collect() == []


def test_language_stage_rejects_what_no_language_explains(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "Съешь же ещё этих мягких французских булок", None, "x", 1), (10**6 + 1, None, None, "x", 0),
                                 (10**6 + 2, "", "en", "x", 0), (10**6 + 3, "12 -- 34", "en", "x", 8)], docs.schema)
    kept = {r.doc_id for r in P.language_id(spark, docs.union(odd), SMALL).collect()}
    assert kept == {r.doc_id for r in docs.collect()}
    unlabelled = docs.union(odd).withColumn("lang", F.lit(None).cast("string"))
    assert P.language_id(spark, unlabelled, SMALL).count() == docs.count() + 1


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    t = docs.where("length(text) > 300").orderBy("doc_id").first().text
    more = [(10**6, t, "en", "x", 1), (10**6, t, "en", "x", 1), (None, t + " end", "en", "x", 1), (10**6 + 1, "", "en", "x", 0),
            (10**6 + 1, "", "en", "x", 0), (None, None, None, None, None), (10**6 + 2, "all new words here", "en", "x", 1),
            (10**6 + 2, "all new words here", "en", "x", 1)]
    out = P.near_duplicates(spark, docs.union(spark.createDataFrame(more, docs.schema)), SMALL)
    late = sorted((r.doc_id or 0, r.text or "") for r in out.where("doc_id is null or doc_id >= 1000000").collect())
    assert late == [(0, ""), (10**6 + 1, ""), (10**6 + 1, ""), (10**6 + 2, "all new words here")]
    assert {r.doc_id for r in out.where("doc_id < 1000000").collect()} == {
        c for _, _, c in ngram_join.reference([(r.doc_id, r.text) for r in docs.collect()])}
