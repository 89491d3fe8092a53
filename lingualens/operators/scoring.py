"""Scoring of model responses as batch jobs.

Text parsing uses built-in regex functions (JVM side, whole-stage codegen).
BLEU and chrF count n-grams in the task that has the pair, in numpy
(``functions.ngrams``): a token is a number, and an n-gram the number of its
first n - 1 tokens and its last one.  Nothing is exploded, shuffled or spilled
for it.  Whole texts are scored, never prefixes, in memory linear in a text.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.edits import token_edits
from ..functions.ngrams import counted

# --- fixed values -----------------------------------------------------------
THINK_BLOCK = r"(?d)<think>.*</think>"
THINK_TAG = "<think>"
FINAL_ANSWER = r"(?d)<final_answer>(.*)</final_answer>"
# White space of every script: what Python's str.strip() and \s take.
WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Word tokens for BLEU/WER: letter/digit runs, or single other non-space chars.
WORD_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + WS + "]"
BLEU_MAX_ORDER = 4
CHRF_CHAR_ORDER = 6
CHRF_BETA = 2.0
# ---------------------------------------------------------------------------
#: Characters, or tokens, of pairs that are counted at once.
SLICE = 1 << 18


def strip_ws(c: Column) -> Column:
    """Trim leading and trailing whitespace of any script."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def clean_response(c: Column) -> Column:
    """Remove ``<think>...</think>`` (greedy, line by line) and a lone
    ``<think>`` tag, then trim (F1)."""
    return strip_ws(F.replace(strip_ws(F.regexp_replace(c, THINK_BLOCK, "")),
                              F.lit(THINK_TAG), F.lit("")))


def final_answer(c: Column) -> Column:
    """Trimmed text between the final-answer tags; NULL if absent (F2)."""
    return F.nullif(strip_ws(F.regexp_extract(c, FINAL_ANSWER, 1)), F.lit(""))


def answer_score(extracted: Column, key: Column, upper: bool = False) -> tuple[Column, Column]:
    """(score, status): 1.0 when the extracted answer equals the key (case
    sensitive unless ``upper``), error when nothing was extracted (F3)."""
    e = F.upper(extracted) if upper else extracted
    score = F.when(extracted.isNotNull() & (e == key), 1.0).otherwise(0.0)
    status = F.when(extracted.isNotNull(), "ok").otherwise("error")
    return score, status


def parse_number(c: Column) -> Column:
    """Digits after dropping ',' and '.', as bigint; NULL if unparsable.

    Dropping '.' too is deliberate: "3.5" reads as 35.
    """
    return strip_ws(F.regexp_replace(c, r"[,.]", "")).try_cast("bigint")


def number_score(extracted: Column, reference: Column) -> tuple[Column, Column]:
    """(score, status) of a numeric answer; a NULL reference never matches."""
    a, b = parse_number(extracted), parse_number(reference)
    score = F.when(extracted.isNotNull() & a.isNotNull() & (a == b), 1.0).otherwise(0.0)
    status = F.when(extracted.isNotNull(), "ok").otherwise("error")
    return score, status


def topic_score(prediction: Column, truth: Column, topics: Column) -> tuple[Column, Column]:
    """(score, status) for topic classification (F5): correct when the
    prediction starts with the true topic, or contains it and none of the
    other topics; empty prediction is an error scoring 0."""
    pred = strip_ws(F.lower(F.coalesce(prediction, F.lit(""))))
    true = strip_ws(F.lower(truth))
    others = F.filter(topics, lambda t: t != true)
    hit = pred.startswith(true) | (pred.contains(true) & ~F.exists(others, lambda o: pred.contains(o)))
    score = F.when((pred != "") & hit, 1.0).otherwise(0.0)
    status = F.when(pred != "", "ok").otherwise("error")
    return score, status


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD_TOKEN), 0)


def char_tokens(c: Column) -> Column:
    """Characters without whitespace (chrF ignores spaces)."""
    return F.regexp_extract_all(no_space(c), F.lit("(?s)."), 0)


def no_space(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"[{WS}]+", "")


def _matched(pairs: DataFrame, held: Sequence[str], hyp: str, ref: str, orders: Sequence[int], kind: str, size: int = SLICE) -> DataFrame:
    """The ``held`` columns of each pair and its clipped matches m_n per order."""
    p = pairs.select(*held, hyp, ref)
    schema = StructType([*p.schema.fields[:len(held)], *[StructField(f"m{n}", LongType()) for n in orders]])
    return p.mapInArrow(counted(len(held), kind, orders, size), schema)


def ngram_matches(pairs: DataFrame, key: Sequence[str], hyp: str, ref: str,
                  orders: Sequence[int], kind: str, size: int = SLICE) -> DataFrame:
    """Clipped n-gram matches per (key, n): sum over n-grams of
    min(count in hyp, count in ref).

    ``hyp``/``ref`` are whitespace-free text for ``kind='char'``, token arrays
    for ``kind='word'``.  A pair is counted in the task that has it, from
    numbers of its tokens; n-grams are never rows nor strings.
    """
    m = _matched(pairs, key, hyp, ref, orders, kind, size)
    return m.select(*key, F.inline(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"m{n}").alias("m")) for n in orders])))


def _per_order(pairs: DataFrame, key, hyp, ref, orders, kind, hyp_len, ref_len,
               carry=()) -> DataFrame:
    """One row per pair with key, lengths, ``carry`` columns and m_1..m_k matches."""
    p = pairs.select(*key, *carry, F.col(hyp_len).alias("hyp_len"), F.col(ref_len).alias("ref_len"), hyp, ref)
    return _matched(p, [*key, *carry, "hyp_len", "ref_len"], hyp, ref, orders, kind)


def bleu_scores(pairs: DataFrame, key: Sequence[str], prediction: str, reference: str,
                max_order: int = BLEU_MAX_ORDER) -> DataFrame:
    """Sentence BLEU per row (F6): clipped precisions of orders 1..4,
    geometric mean, brevity penalty, no smoothing; 0 without prediction."""
    key = list(key)
    th, tr = word_tokens(F.col(prediction)), word_tokens(F.col(reference))
    p = pairs.select(*key, th.alias("_hyp"), tr.alias("_ref"),
                     F.size(th).alias("_hl"), F.size(tr).alias("_rl"),
                     F.col(prediction).isNotNull().alias("_has"))
    orders = list(range(1, max_order + 1))
    w = _per_order(p, key, "_hyp", "_ref", orders, "word", "_hl", "_rl", carry=["_has"])
    prec = [F.when(F.col("hyp_len") - n + 1 > 0, F.col(f"m{n}") / (F.col("hyp_len") - n + 1))
            .otherwise(F.lit(0.0)) for n in orders]
    all_pos = F.lit(True)
    log_sum = F.lit(0.0)
    for pn in prec:
        all_pos = all_pos & (pn > 0)
        log_sum = log_sum + F.log(F.when(pn > 0, pn))
    geo = F.when(all_pos, F.exp(log_sum / max_order)).otherwise(F.lit(0.0))
    bp = F.when(F.col("hyp_len") > F.col("ref_len"), F.lit(1.0)).otherwise(
        F.exp(1 - F.col("ref_len") / F.col("hyp_len")))
    bleu = F.when(F.col("_has") & (F.col("hyp_len") > 0), geo * bp).otherwise(F.lit(0.0))
    return w.select(*key, bleu.alias("bleu"))


def chrf_scores(pairs: DataFrame, key: Sequence[str], prediction: str, reference: str,
                char_order: int = CHRF_CHAR_ORDER, beta: float = CHRF_BETA) -> DataFrame:
    """Sentence chrF per row as a fraction (F7): character n-grams 1..6
    without whitespace; precision and recall averaged over the orders that
    both sides have; F-beta with beta = 2; 0 without prediction."""
    key = list(key)
    sh, sr_ = no_space(F.col(prediction)), no_space(F.col(reference))
    p = pairs.select(*key, sh.alias("_hyp"), sr_.alias("_ref"),
                     F.char_length(sh).alias("_hl"), F.char_length(sr_).alias("_rl"),
                     F.col(prediction).isNotNull().alias("_has"))
    orders = list(range(1, char_order + 1))
    w = _per_order(p, key, "_hyp", "_ref", orders, "char", "_hl", "_rl", carry=["_has"])
    eff = F.lit(0)
    sp = F.lit(0.0)
    sr = F.lit(0.0)
    for n in orders:
        hn, rn = F.col("hyp_len") - n + 1, F.col("ref_len") - n + 1
        both = (hn > 0) & (rn > 0)
        eff = eff + F.when(both, 1).otherwise(0)
        sp = sp + F.when(both, F.col(f"m{n}") / hn).otherwise(0.0)
        sr = sr + F.when(both, F.col(f"m{n}") / rn).otherwise(0.0)
    ap = F.when(eff > 0, sp / eff).otherwise(0.0)
    ar = F.when(eff > 0, sr / eff).otherwise(0.0)
    f2 = beta * beta
    score = F.when(ap + ar > 0, (1 + f2) * ap * ar / (f2 * ap + ar)).otherwise(0.0)
    chrf = F.when(F.col("_has"), score).otherwise(F.lit(0.0))
    return w.select(*key, chrf.alias("chrf"))


def word_error_rate(pairs: DataFrame, group: Sequence[str], prediction: str,
                    reference: str) -> DataFrame:
    """Corpus WER per group: word edits / reference words (F8).

    Edits are counted pair by pair in tasks, from the token lists themselves.
    """
    p = pairs.select(*group, word_tokens(F.col(prediction)).alias("_h"),
                     word_tokens(F.col(reference)).alias("_r"))
    n = len(group)

    def count(batches):
        for batch in batches:
            hyp, ref = batch.column(n), batch.column(n + 1)
            both = [(h.as_py(), r.as_py()) for h, r in zip(hyp, ref)]
            edits = pa.array([token_edits(h, r) for h, r in both], pa.int64())
            words = pa.array([len(r) for _, r in both], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], edits, words], names=[*batch.schema.names[:n], "edits", "ref_words"])

    schema = StructType([*p.schema.fields[:n], StructField("edits", LongType()), StructField("ref_words", LongType())])
    return (p.mapInArrow(count, schema).groupBy(*group)
            .agg(F.sum("edits").alias("edits"), F.sum("ref_words").alias("ref_words"))
            .withColumn("wer", F.col("edits") / F.col("ref_words")))


def metric_fanout(df: DataFrame, metrics: Sequence[str], shared: Sequence[str]) -> DataFrame:
    """One row per metric with the shared columns repeated."""
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score"))
                    for m in metrics])
    return df.select(*shared, F.explode(arr).alias("_m")).select(*shared, "_m.metric", "_m.score")


def pair_support(pairs: DataFrame, supported: DataFrame) -> DataFrame:
    """Translation-service handling of a language pair.

    Each side is matched to the service's languages.  Equal matches -- two
    unsupported sides match nothing alike -- copy the source; one unsupported
    side is an error; else the pair is sent for translation.
    """
    sup = supported.select(F.col("bcp_47").alias("_s")).distinct()
    j = (pairs.join(sup.withColumnRenamed("_s", "_src"), F.col("bcp_47") == F.col("_src"), "left")
         .join(sup.withColumnRenamed("_s", "_tgt"), F.col("target") == F.col("_tgt"), "left"))
    src_ok, tgt_ok = F.col("_src").isNotNull(), F.col("_tgt").isNotNull()
    same = F.col("_src").eqNullSafe(F.col("_tgt"))
    action = (F.when(same, "copy").when(~src_ok | ~tgt_ok, "unsupported").otherwise("translate"))
    prediction = F.when(same, F.col("source_text"))
    status = F.when(same, "ok").when(~src_ok | ~tgt_ok, "error")
    return j.select("bcp_47", "target", "sentence_nr", action.alias("action"),
                    prediction.alias("prediction"), status.alias("status"))
