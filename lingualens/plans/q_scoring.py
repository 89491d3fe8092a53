"""Response scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import items as it
from ..operators import scoring as sc
from .q_items import _E8, _weighted_sql
from .registry import query

_ENDS = f"'^[{sc.WS}]+|[{sc.WS}]+$', '', 'g'"
_RESP_CLEAN = f"""regexp_replace(replace(regexp_replace(regexp_replace(response, '<think>.*</think>', '', 'g'),
  {_ENDS}), '<think>', ''), {_ENDS})"""


def _extract(x: str) -> str:
    return f"nullif(regexp_replace(regexp_extract({x}, '<final_answer>(.*)</final_answer>', 1), {_ENDS}), '')"



@query("clean_responses", ["responses"], f"""
SELECT conv_id, turn, {_RESP_CLEAN} AS response, answer FROM responses""")
def clean_responses(ctx):
    """responses without reasoning sections."""
    r = ctx.view("responses")
    return r.select("conv_id", "turn", sc.clean_response(F.col("response")).alias("response"), "answer")


@query("answer_accuracy", ["responses"], f"""
SELECT conv_id, turn, extracted,
  CASE WHEN extracted IS NOT NULL AND extracted = answer THEN 1.0e0 ELSE 0.0e0 END AS score,
  CASE WHEN extracted IS NOT NULL THEN 'ok' ELSE 'error' END AS status
FROM (SELECT conv_id, turn, answer, {_extract(_RESP_CLEAN)} AS extracted FROM responses)""")
def answer_accuracy(ctx):
    """final-answer extraction and exact-match accuracy."""
    r = ctx.view("responses")
    ext = sc.final_answer(sc.clean_response(F.col("response")))
    r = r.select("conv_id", "turn", "answer", ext.alias("extracted"))
    score, status = sc.answer_score(F.col("extracted"), F.col("answer"))
    return r.select("conv_id", "turn", "extracted", score.alias("score"), status.alias("status"))


@query("answer_accuracy_upper", ["responses"], f"""
SELECT conv_id, turn, extracted,
  CASE WHEN extracted IS NOT NULL AND upper(extracted) = answer THEN 1.0e0 ELSE 0.0e0 END AS score,
  CASE WHEN extracted IS NOT NULL THEN 'ok' ELSE 'error' END AS status
FROM (SELECT conv_id, turn, answer, {_extract(_RESP_CLEAN)} AS extracted FROM (SELECT * REPLACE (lower(response) AS response) FROM responses))""")
def answer_accuracy_upper(ctx):
    """letters answered in either case, as the truthfulness task counts them."""
    r = ctx.view("responses").withColumn("response", F.lower("response"))
    r = r.select("conv_id", "turn", "answer", sc.final_answer(sc.clean_response(F.col("response"))).alias("extracted"))
    score, status = sc.answer_score(F.col("extracted"), F.col("answer"), upper=True)
    return r.select("conv_id", "turn", "extracted", score.alias("score"), status.alias("status"))


def _number_fixture(ctx):
    e = ctx.t.events.select("event_id", "user_id", "event_type")
    body = F.concat(F.col("user_id").cast("string"), F.lit(","),
                    F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))
    response = (F.when(F.col("event_type") == "view", F.lit("<final_answer>n/a</final_answer>"))
                .when(F.col("event_type") == "signup", F.lit("no answer"))
                .otherwise(F.concat(F.lit("<final_answer> "), body, F.lit("</final_answer>"))))
    expected = (F.when(F.col("event_type") == "error", F.col("user_id").cast("string"))
                .otherwise((F.col("user_id") * 1000 + F.col("event_id") % 1000).cast("string")))
    return e.select("event_id", response.alias("response"), expected.alias("answer_number"))


@query("number_accuracy", [], f"""
SELECT event_id, extracted,
  CASE WHEN extracted IS NOT NULL
        AND TRY_CAST(regexp_replace(regexp_replace(extracted, '[,.]', '', 'g'), {_ENDS}) AS BIGINT)
            = TRY_CAST(regexp_replace(regexp_replace(answer_number, '[,.]', '', 'g'), {_ENDS}) AS BIGINT)
       THEN 1.0e0 ELSE 0.0e0 END AS score,
  CASE WHEN extracted IS NOT NULL THEN 'ok' ELSE 'error' END AS status
FROM (SELECT event_id, answer_number,
        {_extract('response')} AS extracted
      FROM (SELECT event_id,
              CASE WHEN event_type = 'view' THEN '<final_answer>n/a</final_answer>'
                   WHEN event_type = 'signup' THEN 'no answer'
                   ELSE '<final_answer> ' || CAST(user_id AS VARCHAR) || ',' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || '</final_answer>' END AS response,
              CASE WHEN event_type = 'error' THEN CAST(user_id AS VARCHAR)
                   ELSE CAST(user_id * 1000 + event_id % 1000 AS VARCHAR) END AS answer_number
            FROM events))""")
def number_accuracy(ctx):
    """numeric answers parsed without ',' and '.', compared to the reference."""
    f = _number_fixture(ctx)
    ext = sc.final_answer(F.col("response"))
    f = f.select("event_id", "answer_number", ext.alias("extracted"))
    score, status = sc.number_score(F.col("extracted"), F.col("answer_number"))
    return f.select("event_id", "extracted", score.alias("score"), status.alias("status"))


_TOPIC_CTES = _E8 + [
    ("topics", "SELECT bcp_47, list(topic ORDER BY topic_rank) AS topics FROM tt WHERE topic_rank <= 5 GROUP BY bcp_47"),
    ("tr", """SELECT sp.bcp_47, sp.sentence_nr, sp.topic, t.topics,
        CASE sp.sentence_nr % 4
          WHEN 0 THEN sp.topic || '!'
          WHEN 1 THEN 'maybe ' || sp.topic || ' or ' || coalesce(list_filter(t.topics, lambda x: x <> sp.topic)[1], '')
          WHEN 2 THEN coalesce(list_filter(t.topics, lambda x: x <> sp.topic)[1], '')
          ELSE '' END AS prediction
      FROM sp JOIN topics t ON t.bcp_47 = sp.bcp_47"""),
]


@query("topic_accuracy", ["paragraphs"], f"""
SELECT bcp_47, sentence_nr, prediction,
  CASE WHEN p <> '' AND (starts_with(p, tru) OR (contains(p, tru)
        AND len(list_filter(list_filter(topics, lambda x: x <> tru), lambda o: contains(p, o))) = 0))
       THEN 1.0e0 ELSE 0.0e0 END AS score,
  CASE WHEN p <> '' THEN 'ok' ELSE 'error' END AS status
FROM (SELECT *, regexp_replace(lower(coalesce(prediction, '')), {_ENDS}) AS p,
        regexp_replace(lower(topic), {_ENDS}) AS tru FROM tr)""", _TOPIC_CTES)
def topic_accuracy(ctx):
    """topic classification accuracy."""
    pt = it.paragraph_topics(ctx.view("paragraphs"))
    top = it.top_topics(pt)
    pick = it.seeded_paragraph(pt.join(top.select("bcp_47", "topic"), ["bcp_47", "topic"], "left_semi"))
    topics = (top
              .groupBy("bcp_47")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("topic_rank", "topic"))),
                               lambda x: x["topic"]).alias("topics")))
    j = pick.join(topics, "bcp_47")
    other = F.coalesce(F.try_element_at(F.filter("topics", lambda x: x != F.col("topic")), F.lit(1)),
                       F.lit(""))
    k = F.col("sentence_nr") % 4
    pred = (F.when(k == 0, F.concat(F.col("topic"), F.lit("!")))
            .when(k == 1, F.concat(F.lit("maybe "), F.col("topic"), F.lit(" or "), other))
            .when(k == 2, other).otherwise(F.lit("")))
    j = j.withColumn("prediction", pred)
    score, status = sc.topic_score(F.col("prediction"), F.col("topic"), F.col("topics"))
    return j.select("bcp_47", "sentence_nr", "prediction", score.alias("score"), status.alias("status"))


def _pairs(ctx):
    c = ctx.t.conversations.select("conv_id", "turn", "role", "text")
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", "turn",
        F.when((F.col("conv_id") + F.col("turn")) % 6 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("text")).alias("prediction"))
    u = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return a.join(u, ["conv_id", "turn"])


_PAIRS = ("pairs", """SELECT a.conv_id, a.turn,
    CASE WHEN (a.conv_id + a.turn) % 6 = 0 THEN NULL ELSE a.text END AS prediction, u.text AS reference
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
  WHERE a.role = 'assistant'""")


def _ngram_sql(tok_h: str, tok_r: str, orders, name: str) -> list[tuple[str, str]]:
    def grams(side):
        return " UNION ALL ".join(
            f"SELECT conv_id, turn, {n} AS n, unnest(list_transform(range(1, len({side}) - {n} + 2), "
            f"lambda i: array_to_string({side}[i:i + {n - 1}], chr(1)))) AS g FROM {name}_tok"
            for n in orders)
    return [
        (f"{name}_tok", f"""SELECT conv_id, turn, prediction IS NOT NULL AS has,
            {tok_h} AS h, {tok_r} AS r FROM pairs"""),
        (f"{name}_hc", f"SELECT conv_id, turn, n, g, count(*) AS c FROM ({grams('h')}) GROUP BY ALL"),
        (f"{name}_rc", f"SELECT conv_id, turn, n, g, count(*) AS c FROM ({grams('r')}) GROUP BY ALL"),
        (f"{name}_m", f"""SELECT a.conv_id, a.turn, a.n, sum(least(a.c, b.c)) AS m FROM {name}_hc a
            JOIN {name}_rc b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.n = b.n AND a.g = b.g
            GROUP BY ALL"""),
        (f"{name}_w", f"""SELECT t.conv_id, t.turn, t.has, len(t.h) AS hl, len(t.r) AS rl, """
            + ", ".join(f"coalesce(sum(m.m) FILTER (WHERE m.n = {n}), 0) AS m{n}" for n in orders)
            + f""" FROM {name}_tok t LEFT JOIN {name}_m m ON m.conv_id = t.conv_id AND m.turn = t.turn
            GROUP BY t.conv_id, t.turn, t.has, len(t.h), len(t.r)"""),
    ]




def _word(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{sc.WORD_TOKEN}')"


def _chars(x: str) -> str:
    return f"regexp_extract_all(regexp_replace(coalesce({x}, ''), '[{sc.WS}]+', '', 'g'), '.')"


_BLEU_CTES = [_PAIRS] + _ngram_sql(_word("prediction"), _word("reference"),
                                   range(1, 5), "b")
_CHRF_CTES = [_PAIRS] + _ngram_sql(_chars("prediction"), _chars("reference"),
                                   range(1, 7), "c")
_P = ", ".join(f"CASE WHEN hl - {n} + 1 > 0 THEN m{n} / (hl - {n} + 1) ELSE 0.0e0 END AS p{n}" for n in range(1, 5))
_BLEU_SQL = f"""
SELECT conv_id, turn, CASE WHEN has AND hl > 0 THEN
    (CASE WHEN p1 > 0 AND p2 > 0 AND p3 > 0 AND p4 > 0 THEN exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) ELSE 0.0e0 END)
    * (CASE WHEN hl > rl THEN 1.0e0 ELSE exp(1 - rl / hl) END)
  ELSE 0.0e0 END AS bleu
FROM (SELECT *, {_P} FROM b_w)"""
_BOTH = [f"(hl - {n} + 1 > 0 AND rl - {n} + 1 > 0)" for n in range(1, 7)]
_EFF = " + ".join(f"CASE WHEN {b} THEN 1 ELSE 0 END" for b in _BOTH)
_SP = " + ".join(f"CASE WHEN {b} THEN m{n} / (hl - {n} + 1) ELSE 0.0e0 END" for n, b in zip(range(1, 7), _BOTH))
_SR = " + ".join(f"CASE WHEN {b} THEN m{n} / (rl - {n} + 1) ELSE 0.0e0 END" for n, b in zip(range(1, 7), _BOTH))
_CHRF_SQL = f"""
SELECT conv_id, turn, CASE WHEN has THEN
    CASE WHEN ap + ar > 0 THEN (1 + 4.0e0) * ap * ar / (4.0e0 * ap + ar) ELSE 0.0e0 END
  ELSE 0.0e0 END AS chrf
FROM (SELECT *, CASE WHEN eff > 0 THEN sp / eff ELSE 0.0e0 END AS ap,
        CASE WHEN eff > 0 THEN sr / eff ELSE 0.0e0 END AS ar
      FROM (SELECT *, {_EFF} AS eff, {_SP} AS sp, {_SR} AS sr FROM c_w))"""


@query("bleu_scores", [], _BLEU_SQL, _BLEU_CTES)
def bleu_scores(ctx):
    """sentence BLEU of each assistant reply against the user turn before it."""
    return sc.bleu_scores(_pairs(ctx), ["conv_id", "turn"], "prediction", "reference")


@query("chrf_scores", [], _CHRF_SQL, _CHRF_CTES)
def chrf_scores(ctx):
    """sentence chrF (fraction) of the same pairs."""
    return sc.chrf_scores(_pairs(ctx), ["conv_id", "turn"], "prediction", "reference")


#: The distance matrix row by row: a recursion over hypothesis words, in which
#: the step along a row is a running minimum.
_WER_CTES = [_PAIRS, ("wt", f"""SELECT conv_id, turn, regexp_extract_all(coalesce(prediction, ''), '{sc.WORD_TOKEN}') AS h,
    regexp_extract_all(coalesce(reference, ''), '{sc.WORD_TOKEN}') AS r FROM pairs"""),
    ("dm", """SELECT conv_id, turn, 0 AS i, j, j AS d FROM (SELECT conv_id, turn, unnest(range(0, len(r) + 1)) AS j FROM wt)
  UNION ALL
  SELECT conv_id, turn, i + 1, j, j + min(t - j) OVER (PARTITION BY conv_id, turn ORDER BY j) FROM (
    SELECT dm.conv_id, dm.turn, dm.i, dm.j, least(dm.d + 1, coalesce(lag(dm.d) OVER (PARTITION BY dm.conv_id, dm.turn ORDER BY dm.j)
      + CASE WHEN wt.h[dm.i + 1] = wt.r[dm.j] THEN 0 ELSE 1 END, dm.d + 1)) AS t
    FROM dm JOIN wt ON wt.conv_id = dm.conv_id AND wt.turn = dm.turn WHERE dm.i < len(wt.h))"""),
    ("we", """SELECT wt.conv_id, len(wt.r) AS n, dm.d FROM dm JOIN wt
      ON wt.conv_id = dm.conv_id AND wt.turn = dm.turn AND dm.i = len(wt.h) AND dm.j = len(wt.r)""")]


@query("word_error_rate", [], """
SELECT 'm' || CAST(conv_id % 7 AS VARCHAR) AS model, CAST(sum(d) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS ref_words,
  sum(d) / sum(n) AS wer
FROM we GROUP BY conv_id % 7""", _WER_CTES, recursive=True)
def word_error_rate(ctx):
    """F8: corpus word error rate per group."""
    p = _pairs(ctx).withColumn("model", F.concat(F.lit("m"), (F.col("conv_id") % 7).cast("string")))
    return sc.word_error_rate(p, ["model"], "prediction", "reference")


@query("metric_fanout", [], f"""
SELECT p.conv_id, p.turn, CASE WHEN p.prediction IS NOT NULL THEN 'ok' ELSE 'error' END AS status,
  x.metric, x.score
FROM pairs p JOIN (SELECT conv_id, turn, 'bleu' AS metric, bleu AS score FROM ({_BLEU_SQL})
                   UNION ALL SELECT conv_id, turn, 'chrf', chrf FROM ({_CHRF_SQL})) x
  ON x.conv_id = p.conv_id AND x.turn = p.turn""", _BLEU_CTES + _CHRF_CTES[1:])
def metric_fanout(ctx):
    """one translation response fanned out to a BLEU and a chrF row."""
    p = _pairs(ctx)
    b = sc.bleu_scores(p, ["conv_id", "turn"], "prediction", "reference")
    c = sc.chrf_scores(p, ["conv_id", "turn"], "prediction", "reference")
    wide = (p.select("conv_id", "turn", F.when(F.col("prediction").isNotNull(), "ok")
                     .otherwise("error").alias("status"))
            .join(b, ["conv_id", "turn"]).join(c, ["conv_id", "turn"]))
    return sc.metric_fanout(wide, ["bleu", "chrf"], ["conv_id", "turn", "status"])


SUPPORTED = ["en", "de"]
_SUP = "CASE WHEN {0} IN (" + ", ".join(f"'{x}'" for x in SUPPORTED) + ") THEN {0} END"
_SRC, _TGT = _SUP.format("s.bcp_47"), _SUP.format("t.bcp_47")


@query("pair_support", ["paragraphs"], f"""
SELECT bcp_47, target, sentence_nr,
  CASE WHEN a IS NOT DISTINCT FROM b THEN 'copy' WHEN a IS NULL OR b IS NULL THEN 'unsupported' ELSE 'translate' END AS action,
  CASE WHEN a IS NOT DISTINCT FROM b THEN text END AS prediction,
  CASE WHEN a IS NOT DISTINCT FROM b THEN 'ok' WHEN a IS NULL OR b IS NULL THEN 'error' END AS status
FROM (SELECT s.bcp_47, t.bcp_47 AS target, s.sentence_nr, s.text, {_SRC} AS a, {_TGT} AS b
      FROM num s JOIN (SELECT CAST(draw AS INTEGER) AS sentence_nr, bcp_47 FROM targets) t ON t.sentence_nr = s.sentence_nr)""",
       _weighted_sql("SELECT bcp_47, CAST(count(*) AS DOUBLE) AS w FROM paragraphs GROUP BY bcp_47") + [
           ("num", """SELECT * FROM (SELECT bcp_47, CAST(row_number() OVER (PARTITION BY bcp_47 ORDER BY pos) - 1 AS INTEGER)
                         AS sentence_nr, text FROM paragraphs) WHERE sentence_nr < 10""")])
def pair_support(ctx):
    """pairs that match alike copy the source; one unsupported side is an error."""
    par = ctx.view("paragraphs")
    w = par.groupBy("bcp_47").agg(F.count(F.lit(1)).alias("w"))
    targets = it.weighted_sample(w, "w")
    num = it.numbered_sentences(par)
    pairs = (num.join(targets.select(F.col("draw").alias("sentence_nr"), F.col("bcp_47").alias("target")),
                      "sentence_nr")
             .select("bcp_47", "target", "sentence_nr", F.col("text").alias("source_text")))
    supported = ctx.spark.createDataFrame([(x,) for x in SUPPORTED], "bcp_47 string")
    return sc.pair_support(pairs, supported)
