"""Item selection and request-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import items as it
from ..operators.scoring import WS
from .registry import query

SEED = K.BOOTSTRAP_SEED
NS = K.N_SENTENCES


def sql_text(s: str) -> str:
    """A SQL string expression for a Python string with newlines."""
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _template(tpl: str, *names_and_exprs: tuple[str, str]) -> str:
    """``concat`` of the template pieces and the placeholder expressions."""
    out, rest = [], tpl
    for name, expr in names_and_exprs:
        head, rest = rest.split("{" + name + "}", 1)
        out += [sql_text(head), expr]
    out.append(sql_text(rest))
    return "concat(" + ", ".join(out) + ")"


_E1 = ("chosen", """SELECT bcp_47, min(source_rank) AS source_rank, arg_min(n_items, source_rank) AS n_items,
    CASE WHEN min(source_rank) = 2 THEN 'machine' ELSE 'human' END AS origin
  FROM (SELECT bcp_47, source_rank, count(*) AS n_items FROM items WHERE source_rank IN (0, 1, 2)
        GROUP BY bcp_47, source_rank) GROUP BY bcp_47""")


@query("source_priority", ["items"], "SELECT * FROM chosen", [_E1])
def source_priority(ctx):
    """Best source per language, human before machine."""
    return it.source_priority(ctx.view("items"))


@query("rotating_items", ["items"], f"""
SELECT g.bcp_47, CAST(g.sentence_nr AS INTEGER) AS sentence_nr, k.subject, n.doc_id, g.origin
FROM grid g JOIN cats k ON k.cat_pos = (g.sentence_nr % (SELECT count(*) FROM cats)) + 1
JOIN num n ON n.bcp_47 = g.bcp_47 AND n.source_rank = g.source_rank AND n.subject = k.subject
  AND n.sentence_nr = g.sentence_nr""", [_E1,
    ("cats", "SELECT subject, row_number() OVER (ORDER BY subject) AS cat_pos FROM (SELECT DISTINCT subject FROM items WHERE source_rank = 0)"),
    ("num", """SELECT i.bcp_47, i.source_rank, i.subject, i.doc_id,
        row_number() OVER (PARTITION BY i.bcp_47, i.source_rank, i.subject ORDER BY i.doc_id) - 1 AS sentence_nr
      FROM items i JOIN chosen c ON c.bcp_47 = i.bcp_47 AND c.source_rank = i.source_rank"""),
    ("grid", f"SELECT c.bcp_47, c.source_rank, c.origin, s.nr AS sentence_nr FROM chosen c CROSS JOIN range(0, {NS}) s(nr)")])
def rotating_items(ctx):
    """Category rotation and nr-th item of the category."""
    items = ctx.view("items")
    return it.rotating_items(items, it.source_priority(items))


_E3 = ("ci", f"""SELECT item_id, row_number() OVER (
    ORDER BY md5('{SEED}|' || CAST(item_id AS VARCHAR)), item_id) AS position
  FROM items WHERE source_rank IN (0, 1) GROUP BY item_id
  HAVING count(DISTINCT bcp_47) = (SELECT count(DISTINCT bcp_47) FROM items WHERE source_rank IN (0, 1))""")


@query("common_items", ["items"], "SELECT * FROM ci", [_E3])
def common_items(ctx):
    """Ids present in all languages, seeded shuffle."""
    return it.common_items(ctx.view("items"), SEED)


@query("priority_items", ["items"], f"""
SELECT bcp_47, CAST(sentence_nr AS INTEGER) AS sentence_nr,
  arg_min(item_id, (source_rank, doc_id, item_id)) AS item_id, arg_min(doc_id, (source_rank, doc_id)) AS doc_id,
  min(source_rank) AS source_rank, CASE WHEN min(source_rank) = 2 THEN 'machine' ELSE 'human' END AS origin
FROM (SELECT i.*, c.position - 1 AS sentence_nr FROM items i JOIN ci c USING (item_id)
      JOIN (SELECT bcp_47, bool_or(source_rank < 2) AS human FROM items WHERE source_rank IN (0, 1, 2) GROUP BY bcp_47) h
        ON h.bcp_47 = i.bcp_47 AND h.human = (i.source_rank < 2)
      WHERE c.position <= {NS} AND i.source_rank IN (0, 1, 2))
GROUP BY bcp_47, sentence_nr""", [_E3])
def priority_items(ctx):
    """Nr-th common id from the best source of each language."""
    items = ctx.view("items")
    return it.items_by_common_id(items, it.common_items(items, SEED))


@query("mgsm_items", ["items"], f"""
SELECT b.bcp_47, CAST(b.sentence_nr AS INTEGER) AS sentence_nr, b.source_rank, b.origin, b.doc_id,
  CASE WHEN instr(d.text, '####') > 0 THEN trim(substr(d.text, instr(d.text, '####') + 4)) END AS answer
FROM (SELECT bcp_47, source_rank, doc_id, CASE WHEN source_rank >= 2 THEN 'machine' ELSE 'human' END AS origin,
        row_number() OVER (PARTITION BY bcp_47 ORDER BY doc_id) - 1 AS sentence_nr
      FROM items JOIN (SELECT bcp_47, min(source_rank) AS source_rank FROM items GROUP BY bcp_47) USING (bcp_47, source_rank)
      QUALIFY sentence_nr < {NS}) b
JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE text || ' #### ' || CAST(doc_id % 1000 AS VARCHAR) || ' ' END AS text
      FROM documents) d ON d.doc_id = b.doc_id""")
def mgsm_items(ctx):
    """Nr-th item of the language's first source; answer after '####'
    (two thirds of the derived items end in one)."""
    b = it.first_source_items(ctx.view("items"))
    marked = F.concat("text", F.lit(" #### "), (F.col("doc_id") % 1000).cast("string"), F.lit(" "))
    d = ctx.t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(marked).alias("text"))
    return (b.join(d, "doc_id")
            .select("bcp_47", "sentence_nr", "source_rank", "origin", "doc_id",
                    it.answer_after_marker(F.col("text")).alias("answer")))


_E5 = ("conv_items", """SELECT conv_id, list(text ORDER BY turn) AS choices,
    list(CASE WHEN role = 'assistant' AND turn = 1 THEN 1 ELSE 0 END ORDER BY turn) AS labels
  FROM conversations GROUP BY conv_id""")


@query("correct_choice_letter", [], """
SELECT conv_id, CAST(len(choices) AS INTEGER) AS n_choices, chr(CAST(64 + list_position(labels, 1) AS INTEGER)) AS answer
FROM conv_items WHERE list_position(labels, 1) > 0""", [_E5])
def correct_choice_letter(ctx):
    """E5: items with a correct label and its answer letter."""
    return it.correct_choice_letter(it.conversation_items(ctx.t.conversations))


@query("choices_array", [], """
SELECT conv_id, [a, b, c, d] AS choices FROM (
  SELECT conv_id, max(text) FILTER (WHERE turn = 0) AS a, max(text) FILTER (WHERE turn = 1) AS b,
    max(text) FILTER (WHERE turn = 2) AS c, max(text) FILTER (WHERE turn = 3) AS d
  FROM conversations GROUP BY conv_id)
WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL""")
def choices_array(ctx):
    """Choices array from four option columns."""
    return it.choices_from_columns(ctx.t.conversations)


def _choice_texts(ctx):
    return it.choices_from_columns(ctx.t.conversations)


_FOUR = """(SELECT conv_id, [a, b, c, d] AS choices FROM (
  SELECT conv_id, max(text) FILTER (WHERE turn = 0) AS a, max(text) FILTER (WHERE turn = 1) AS b,
    max(text) FILTER (WHERE turn = 2) AS c, max(text) FILTER (WHERE turn = 3) AS d
  FROM conversations GROUP BY conv_id) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL)"""


@query("choices_nested", [], f"SELECT conv_id, choices, [1, 0, 0, 0] AS labels FROM {_FOUR}")
def choices_nested(ctx):
    """Choices and labels from a nested record."""
    c = _choice_texts(ctx)
    record = F.struct("choices", F.array(*map(F.lit, (1, 0, 0, 0))).alias("labels"))
    return it.choices_from_nested(c.select("conv_id", record.alias("targets")))


@query("choices_literal", [], f"""
SELECT conv_id, [choices[1], 'it''s "' || choices[2] || '"', 'a\\' || choices[3], choices[4] || chr(10)] AS choices FROM {_FOUR}""")
def choices_literal(ctx):
    """Choices from a list written as text, with quotes and escapes in it."""
    c = _choice_texts(ctx)
    at = lambda i: F.element_at("choices", i)
    texts = F.array(at(1), F.concat(F.lit("it's \""), at(2), F.lit('"')), F.concat(F.lit("a\\"), at(3)), F.concat(at(4), F.lit("\n")))
    escaped = F.transform(texts, lambda s: F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")),
                                                     F.lit("\n"), F.lit("\\n")))
    literal = F.concat(F.lit("['"), F.array_join(escaped, "', '"), F.lit("']"))
    return it.choices_from_literal(c.select("conv_id", literal.alias("choices")))


_E8 = [
    ("s", "SELECT bcp_47, url, pos, lower(topic) AS topic, text FROM paragraphs WHERE topic IS NOT NULL"),
    ("p", """SELECT bcp_47, url, string_agg(text, ' ' ORDER BY pos) AS text, arg_min(topic, pos) AS topic
             FROM s GROUP BY bcp_47, url"""),
    ("tt", """SELECT bcp_47, topic, n, row_number() OVER (PARTITION BY bcp_47 ORDER BY n DESC, topic) AS topic_rank
              FROM (SELECT bcp_47, topic, count(*) AS n FROM p GROUP BY bcp_47, topic)"""),
    ("tp", """SELECT p.* FROM p JOIN tt ON tt.bcp_47 = p.bcp_47 AND tt.topic = p.topic AND tt.topic_rank <= 5"""),
    ("sp", f"""SELECT bcp_47, CAST(nr AS INTEGER) AS sentence_nr,
                 arg_min(url, md5(CAST(nr AS VARCHAR) || '|' || CAST(url AS VARCHAR))) AS url,
                 arg_min(topic, md5(CAST(nr AS VARCHAR) || '|' || CAST(url AS VARCHAR))) AS topic
               FROM tp CROSS JOIN range(0, {NS}) s(nr) GROUP BY bcp_47, nr"""),
]


@query("topic_paragraphs", ["paragraphs"], "SELECT * FROM tp", _E8)
def topic_paragraphs(ctx):
    """Paragraphs per url with one of the top-5 topics."""
    return it.topic_paragraphs(ctx.view("paragraphs"))


@query("seeded_paragraph", ["paragraphs"], "SELECT * FROM sp", _E8)
def seeded_paragraph(ctx):
    """One seeded paragraph per (language, nr); no paragraph text is built."""
    pt = it.paragraph_topics(ctx.view("paragraphs"))
    top = it.top_topics(pt).select("bcp_47", "topic")
    return it.seeded_paragraph(pt.join(top, ["bcp_47", "topic"], "left_semi"))


def _weighted_sql(src: str) -> list[tuple[str, str]]:
    return [
        ("wt", src),
        ("cum", "SELECT bcp_47, w, sum(w) OVER (ORDER BY bcp_47 ROWS UNBOUNDED PRECEDING) AS hi FROM wt"),
        ("iv", """SELECT bcp_47, (hi - w) / (SELECT sum(w) FROM wt) AS lo, hi / (SELECT sum(w) FROM wt) AS hi
                  FROM cum"""),
        ("dr", f"""SELECT CAST(k AS INTEGER) AS draw,
                     CAST(('0x' || substr(md5('{SEED}|' || CAST(k AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296e0 AS u
                   FROM (SELECT unnest(range(0, (SELECT count(*) FROM wt))) AS k)"""),
        ("targets", "SELECT dr.draw, iv.bcp_47 FROM dr JOIN iv ON dr.u >= iv.lo AND dr.u < iv.hi"),
    ]


@query("weighted_targets", ["languages"], "SELECT * FROM targets", _weighted_sql(
    "SELECT bcp_47, CAST(speakers AS DOUBLE) AS w FROM languages WHERE in_benchmark"))
def weighted_targets(ctx):
    """Speaker-weighted target languages, drawn with replacement."""
    langs = ctx.languages.where("in_benchmark")
    return it.weighted_sample(langs, "speakers", SEED)


def _sentence_langs(ctx):
    return ctx.view("paragraphs").groupBy("bcp_47").agg(F.count(F.lit(1)).alias("w"))


@query("parallel_pairs", ["paragraphs"], f"""
SELECT t.bcp_47 AS other, s.sentence_nr, s.bcp_47, m.mode,
  CASE m.mode WHEN 'from' THEN t.bcp_47 ELSE s.bcp_47 END AS target,
  CASE m.mode WHEN 'from' THEN s.text ELSE x.text END AS source_text,
  CASE m.mode WHEN 'from' THEN x.text ELSE s.text END AS target_text
FROM num s JOIN (SELECT CAST(draw AS INTEGER) AS sentence_nr, bcp_47 FROM targets) t ON t.sentence_nr = s.sentence_nr
JOIN num x ON x.bcp_47 = t.bcp_47 AND x.sentence_nr = s.sentence_nr CROSS JOIN (VALUES ('from'), ('to')) m(mode)""",
       _weighted_sql("SELECT bcp_47, CAST(count(*) AS DOUBLE) AS w FROM paragraphs GROUP BY bcp_47") + [
           ("num", f"""SELECT * FROM (SELECT bcp_47, CAST(row_number() OVER (PARTITION BY bcp_47 ORDER BY pos) - 1 AS INTEGER)
                         AS sentence_nr, text FROM paragraphs) WHERE sentence_nr < {NS}""")])
def parallel_pairs(ctx):
    """source/target sentence pairs by position, both directions."""
    targets = it.weighted_sample(_sentence_langs(ctx), "w", SEED)
    return it.parallel_pairs(ctx.view("paragraphs"), targets)


_CLS_PROMPT = _template(it.CLASSIFY_PROMPT, ("topics", "tp2.topics"), ("text", "tp.text"))
_MC_PROMPT = _template(it.TRUTHFULQA_PROMPT, ("question", "choices[1]"), (
    "choices", "array_to_string(list_transform(choices[2:], lambda x, i: chr(CAST(64 + i AS INTEGER)) || ': ' || x || chr(10)), '')"))


@query("request_table", ["paragraphs"], f"""
SELECT 'classification' AS task, sp.bcp_47 AS item_key, sp.sentence_nr, {_CLS_PROMPT} AS prompt
FROM sp JOIN tp ON tp.bcp_47 = sp.bcp_47 AND tp.url = sp.url
JOIN (SELECT bcp_47, string_agg(topic, ', ' ORDER BY topic_rank) AS topics FROM tt WHERE topic_rank <= 5
      GROUP BY bcp_47) tp2 ON tp2.bcp_47 = sp.bcp_47
UNION ALL
SELECT 'truthfulqa', CAST(conv_id AS VARCHAR), 0, {_MC_PROMPT} FROM conv_items WHERE len(choices) >= 2""",
       _E8 + [_E5])
def request_table(ctx):
    """Prompt text per work item (classification and multiple choice)."""
    cls = it.classification_requests(ctx.view("paragraphs"))
    mc = it.multiple_choice_requests(it.conversation_items(ctx.t.conversations))
    return cls.unionByName(mc)


_MC4 = _template(it.MULTIPLE_CHOICE_PROMPT, ("format", sql_text(it.ANSWER_FORMAT)), ("question", "question"),
                 *[(x, f"choices[{i}]") for i, x in enumerate("abcd", 1)])
_MATH = _template(it.MATH_PROMPT, ("format", sql_text(it.ANSWER_FORMAT)), ("question", "question"))
_TRANSLATE = _template(it.TRANSLATE_PROMPT, ("language", "upper(target)"), ("script", "'Latin'"),
                       ("text", f"regexp_replace(source_text, '^[{WS}]+|[{WS}]+$', '', 'g')"))
_QUESTIONS = [
    ("chosen4", """SELECT conv_id, [a, b, c, d] AS choices FROM (
        SELECT conv_id, max(text) FILTER (WHERE turn = 0) AS a, max(text) FILTER (WHERE turn = 1) AS b,
          max(text) FILTER (WHERE turn = 2) AS c, max(text) FILTER (WHERE turn = 3) AS d
        FROM conversations GROUP BY conv_id) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL"""),
    ("q4", """SELECT c.conv_id, c.choices, b.text AS question FROM chosen4 c
              JOIN benchmark b ON b.item_id = c.conv_id % 20"""),
]


@query("question_requests", [], f"""
SELECT CASE WHEN conv_id % 2 = 0 THEN 'mmlu' ELSE 'arc' END AS task, CAST(conv_id AS VARCHAR) AS item_key, 0 AS sentence_nr, {_MC4} AS prompt
FROM q4 UNION ALL SELECT 'mgsm', CAST(item_id AS VARCHAR), 0, {_MATH} FROM (SELECT item_id, text AS question FROM benchmark)""", _QUESTIONS)
def question_requests(ctx):
    """MMLU, ARC and MGSM prompts; questions are the benchmark's texts,
    choices the turns of a conversation."""
    bench = ctx.t.benchmark.select("item_id", F.col("text").alias("question"))
    q = (it.choices_from_columns(ctx.t.conversations).withColumn("item_id", F.col("conv_id") % 20).join(bench, "item_id")
         .select("conv_id", F.col("conv_id").cast("string").alias("item_key"), F.lit(0).alias("sentence_nr"), "question", "choices"))
    math = bench.select(F.col("item_id").cast("string").alias("item_key"), F.lit(0).alias("sentence_nr"), "question")
    return (it.four_choice_requests(q.where("conv_id % 2 = 0"), "mmlu")
            .unionByName(it.four_choice_requests(q.where("conv_id % 2 = 1"), "arc")).unionByName(it.math_requests(math)))


@query("translation_requests", ["paragraphs"], f"""
SELECT 'translation_' || mode AS task, bcp_47 AS item_key, sentence_nr, {_TRANSLATE} AS prompt FROM (
  SELECT s.bcp_47, s.sentence_nr, m.mode, CASE m.mode WHEN 'from' THEN t.bcp_47 ELSE s.bcp_47 END AS target,
    CASE m.mode WHEN 'from' THEN s.text ELSE x.text END AS source_text
  FROM num s JOIN (SELECT CAST(draw AS INTEGER) AS sentence_nr, bcp_47 FROM targets) t ON t.sentence_nr = s.sentence_nr
  JOIN num x ON x.bcp_47 = t.bcp_47 AND x.sentence_nr = s.sentence_nr CROSS JOIN (VALUES ('from'), ('to')) m(mode))""",
       _weighted_sql("SELECT bcp_47, CAST(count(*) AS DOUBLE) AS w FROM paragraphs GROUP BY bcp_47") + [
           ("num", f"""SELECT * FROM (SELECT bcp_47, CAST(row_number() OVER (PARTITION BY bcp_47 ORDER BY pos) - 1 AS INTEGER)
                         AS sentence_nr, text FROM paragraphs) WHERE sentence_nr < {NS}""")])
def translation_requests(ctx):
    """Translation prompts in both directions."""
    pairs = it.parallel_pairs(ctx.view("paragraphs"), it.weighted_sample(_sentence_langs(ctx), "w", SEED))
    names = ctx.view("paragraphs").select("bcp_47").distinct().select(
        "bcp_47", F.upper("bcp_47").alias("language_name"), F.lit("Latin").alias("script"))
    return it.translation_requests(pairs, names)


@query("shuffled_choices", [], f"""
SELECT conv_id, choices, labels, chr(CAST(64 + list_position(labels, 1) AS INTEGER)) AS answer FROM (
  SELECT conv_id,
    list(c ORDER BY md5('{SEED}|' || CAST(conv_id AS VARCHAR) || '|' || CAST(i AS VARCHAR))) AS choices,
    list(l ORDER BY md5('{SEED}|' || CAST(conv_id AS VARCHAR) || '|' || CAST(i AS VARCHAR))) AS labels
  FROM (SELECT conv_id, unnest(choices) AS c, unnest(labels) AS l, unnest(range(1, len(choices) + 1)) AS i
        FROM conv_items) GROUP BY conv_id)""", [_E5])
def shuffled_choices(ctx):
    """Seeded shuffle of choices together with labels."""
    return it.shuffled_choices(it.conversation_items(ctx.t.conversations), SEED)


@query("translation_worklist", ["items", "languages"], """
SELECT t.bcp_47, s.subject, s.doc_id, CAST(s.pos AS INTEGER) AS pos
FROM (SELECT bcp_47 FROM languages WHERE in_benchmark
        AND bcp_47 NOT IN (SELECT bcp_47 FROM items WHERE source_rank IN (0, 1))) t
CROSS JOIN (SELECT subject, doc_id, row_number() OVER (PARTITION BY subject ORDER BY doc_id) AS pos
      FROM items WHERE source_rank = 0 AND bcp_47 = 'en' QUALIFY pos <= 20) s""")
def translation_worklist(ctx):
    """Supported languages without a human set, each with the up to
    20 sampled original items per category."""
    return it.translation_worklist(ctx.view("items"), ctx.languages.where("in_benchmark"))


@query("regroup_choices", [], """
SELECT conv_id, CAST(floor(turn / 4) AS INTEGER) AS chunk, list(text ORDER BY turn) AS choices
FROM conversations GROUP BY conv_id, floor(turn / 4)""")
def regroup_choices(ctx):
    """Flat choice lists regrouped in chunks of four."""
    return it.regroup_choices(ctx.t.conversations)


@query("dataset_coverage", ["items"], """
SELECT per.*, coalesce(miss.missing, []) AS missing
FROM (SELECT source_rank, count(DISTINCT subject) AS n_subjects, count(*) AS n_items,
        count(DISTINCT bcp_47) AS n_languages FROM items GROUP BY source_rank) per
LEFT JOIN (SELECT s.source_rank, list(l.bcp_47 ORDER BY l.bcp_47) AS missing
           FROM (SELECT DISTINCT bcp_47 FROM items) l CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS source_rank) s
           WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.bcp_47 = l.bcp_47 AND i.source_rank = s.source_rank)
           GROUP BY s.source_rank) miss ON miss.source_rank = per.source_rank""")
def dataset_coverage(ctx):
    """Per-source coverage and missing languages."""
    return it.dataset_coverage(ctx.view("items"))


@query("category_counts", ["items"], """
SELECT source_rank, subject, count(*) AS n_items, count(DISTINCT bcp_47) AS n_languages,
  count(*) OVER (PARTITION BY subject) AS n_sources FROM items GROUP BY source_rank, subject""")
def category_counts(ctx):
    """Items and languages per source and category."""
    return it.category_counts(ctx.view("items"))


@query("sources_per_language", ["items"], """
SELECT bcp_47, list_sort(list(DISTINCT source_rank)) AS sources, count(*) AS n_items, count(DISTINCT subject) AS n_subjects
FROM items GROUP BY bcp_47""")
def sources_per_language(ctx):
    """What each language has."""
    return it.sources_per_language(ctx.view("items"))
