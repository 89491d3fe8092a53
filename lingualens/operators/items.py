"""Test-item selection and request tables.

Per-item lookups of the original ("the nr-th row of this subset") become
joins against tables numbered with the distributed rank; seeded random
choices become orders over ``md5`` of the seed and the key, so the draws are
reproducible in any engine and independent of partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.ordered import global_rank, running
from ..functions.topk import top_k_per_group
from .scoring import strip_ws

# --- fixed values -----------------------------------------------------------
CLASSIFY_PROMPT = ("Classify the following text into one of these topics: {topics}.\n"
                   "Reply with only the topic name.\n\nText:\n{text}\n")
TRUTHFULQA_PROMPT = ("Answer the following multiple choice question. Reason step-by-step "
                     "and then write the final answer as a single letter.\n\n{question}\n\n{choices}")
TRANSLATE_PROMPT = ("Translate the following text to the {language} language; use the {script} "
                    "script; reply only with the translation:\n\n{text}")
ANSWER_FORMAT = "Response format:<reasoning>...</reasoning><final_answer>...</final_answer>"
MULTIPLE_CHOICE_PROMPT = ("Solve the following multiple choice question. Reason step-by-step and then write the "
                          "final answer as a single letter.\n\n\n{format}\n\n---\n\n{question}\n\n"
                          "A: {a}\nB: {b}\nC: {c}\nD: {d}")
MATH_PROMPT = ("Solve the following math problem. Reason step-by-step and then write the final answer as a "
               "single number.\n\n{format}\n\n---\n\n{question}")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# ---------------------------------------------------------------------------

HUMAN_RANKS = (0, 1)
MACHINE_RANK = 2  # and any later rank


def md5_order(*parts: Column) -> Column:
    """A seeded pseudo-random sort key that SQL engines can reproduce."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def md5_uniform(*parts: Column) -> Column:
    """Uniform in [0, 1) from the first 32 bits of md5."""
    return F.conv(F.substring(md5_order(*parts), 1, 8), 16, 10).cast("bigint") / 4294967296.0


def origin_of(rank: Column) -> Column:
    return F.when(rank >= MACHINE_RANK, "machine").otherwise("human")


def source_priority(items: DataFrame, ranks: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Best available source per language: human sets first, then machine."""
    c = (items.where(F.col("source_rank").isin(list(ranks)))
         .groupBy("bcp_47", "source_rank").agg(F.count(F.lit(1)).alias("n_items")))
    best = c.groupBy("bcp_47").agg(F.min(F.struct("source_rank", "n_items")).alias("_b"))
    return best.select("bcp_47", F.col("_b.source_rank").alias("source_rank"),
                       F.col("_b.n_items").alias("n_items"),
                       origin_of(F.col("_b.source_rank")).alias("origin"))


def rotating_items(items: DataFrame, chosen: DataFrame,
                   n_sentences: int = K.N_SENTENCES) -> DataFrame:
    """Item ``nr`` of a language: category = sorted categories[nr mod n],
    then the nr-th item of that category in the chosen source (E2).

    The categories are those of the first source.  A sample number past the
    end of its category has no item.  Only the ``n_sentences`` smallest
    categories and the first ``n_sentences`` items of a category can be asked
    for, so both are top-k selections, not numberings of the whole table.
    """
    cats = items.where(F.col("source_rank") == 0).select("subject").distinct()
    n_cat = cats.agg(F.count(F.lit(1))).scalar()
    ranked = top_k_per_group(cats.withColumn("_all", F.lit(0)), ["_all"], [F.col("subject")], n_sentences,
                             out="cat_pos").drop("_all")
    pool = items.join(chosen.select("bcp_47", "source_rank"), ["bcp_47", "source_rank"], "left_semi")
    numbered = first_items(pool, ["bcp_47", "source_rank", "subject"], n_sentences)
    grid = chosen.select("bcp_47", "source_rank", "origin",
                         F.explode(F.sequence(F.lit(0), F.lit(n_sentences - 1))).alias("sentence_nr"))
    grid = grid.withColumn("cat_pos", (F.pmod(F.col("sentence_nr"), n_cat) + 1).cast("int"))
    return (grid.join(ranked, "cat_pos")
            .join(numbered, ["bcp_47", "source_rank", "subject", "sentence_nr"])
            .select("bcp_47", "sentence_nr", "subject", "doc_id", "origin"))


def first_items(items: DataFrame, group: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` items of each group by id, numbered from 0."""
    top = top_k_per_group(items.select(*group, "doc_id"), group, [F.col("doc_id")], n, out="_i")
    return top.select(*group, "doc_id", (F.col("_i") - 1).alias("sentence_nr"))


def common_items(items: DataFrame, seed: int = K.BOOTSTRAP_SEED) -> DataFrame:
    """Ids present in the human set of every language that has one, in a
    seeded shuffled order (E3)."""
    items = items.where(F.col("source_rank").isin(*HUMAN_RANKS))
    n_lang = items.agg(F.countDistinct("bcp_47")).scalar()
    common = (items.groupBy("item_id").agg(F.countDistinct("bcp_47").alias("_n"))
              .where(F.col("_n") == n_lang).select("item_id"))
    return global_rank(common, [md5_order(F.lit(seed), F.col("item_id")), F.col("item_id")],
                       out="position")


def items_by_common_id(items: DataFrame, common: DataFrame,
                       n_sentences: int = K.N_SENTENCES) -> DataFrame:
    """Sample nr of a language = the nr-th common id, from the language's
    source: the human set if the language has one, else the machine
    translations; an id that this source lacks gives no item (E4)."""
    ids = common.where(F.col("position") <= n_sentences).select(
        "item_id", (F.col("position") - 1).alias("sentence_nr"))
    some = items.where(F.col("source_rank").isin(*HUMAN_RANKS, MACHINE_RANK))
    human = F.col("source_rank").isin(*HUMAN_RANKS)
    has = some.groupBy("bcp_47").agg(F.bool_or(human).alias("_human"))
    cand = some.join(has, "bcp_47").where(human == F.col("_human")).join(ids, "item_id")
    best = cand.groupBy("bcp_47", "sentence_nr").agg(
        F.min(F.struct("source_rank", "doc_id", "item_id")).alias("_b"))
    return best.select("bcp_47", "sentence_nr", F.col("_b.item_id").alias("item_id"),
                       F.col("_b.doc_id").alias("doc_id"),
                       F.col("_b.source_rank").alias("source_rank"),
                       origin_of(F.col("_b.source_rank")).alias("origin"))


def first_source_items(items: DataFrame, n_sentences: int = K.N_SENTENCES) -> DataFrame:
    """Sample nr from the first source (by priority) that has the language;
    past that source's end there is no item (E6)."""
    first = items.groupBy("bcp_47").agg(F.min("source_rank").alias("source_rank"))
    pool = items.join(first, ["bcp_47", "source_rank"], "left_semi")
    return (first_items(pool, ["bcp_47", "source_rank"], n_sentences)
            .withColumn("origin", origin_of(F.col("source_rank"))))


def answer_after_marker(text: Column, marker: str = "####") -> Column:
    """The text after the first ``####``, trimmed; NULL when absent."""
    return F.trim(F.try_element_at(F.split(text, marker, 2), F.lit(2)))


def conversation_items(conversations: DataFrame) -> DataFrame:
    """One item per conversation: turn texts as choices, label 1 on the
    assistant's first reply (turn 1) (E5 input; bounded by turns)."""
    c = conversations.select("conv_id", "turn", "role", "text")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    g = c.groupBy("conv_id").agg(turns.alias("_t"))
    return g.select(
        "conv_id",
        F.transform("_t", lambda x: x["text"]).alias("choices"),
        F.transform("_t", lambda x: F.when((x["role"] == "assistant") & (x["turn"] == 1), 1)
                    .otherwise(0)).alias("labels"))


def correct_letter(labels: Column) -> Column:
    pos = F.array_position(labels, 1)
    return F.when(pos > 0, F.chr(F.lit(64) + pos))


def correct_choice_letter(items: DataFrame) -> DataFrame:
    """Items with a correct label; answer = letter of the label-1 position (E5)."""
    return (items.where(F.array_position("labels", 1) > 0)
            .select("conv_id", F.size("choices").alias("n_choices"),
                    correct_letter(F.col("labels")).alias("answer")))


def choices_from_columns(conversations: DataFrame) -> DataFrame:
    """Choices array from four option columns (E7): options a-d are the texts
    of turns 0-3, for conversations that have all four."""
    opts = [F.max(F.when(F.col("turn") == k, F.col("text"))).alias(f"option_{c}")
            for k, c in enumerate("abcd")]
    g = conversations.groupBy("conv_id").agg(*opts)
    return (g.where(F.col("option_d").isNotNull() & F.col("option_a").isNotNull()
                    & F.col("option_b").isNotNull() & F.col("option_c").isNotNull())
            .select("conv_id", F.array("option_a", "option_b", "option_c", "option_d").alias("choices")))


def choices_from_nested(items: DataFrame, field: str = "targets") -> DataFrame:
    """Choices and labels out of a nested record (E7): ``field`` is a struct of
    two arrays, ``choices`` (or ``text``) and ``labels`` if it has them."""
    names = items.schema[field].dataType.names
    text = F.col(f"{field}.{'choices' if 'choices' in names else 'text'}").alias("choices")
    labels = [F.col(f"{field}.labels").alias("labels")] if "labels" in names else []
    return items.select(*[c for c in items.columns if c != field], text, *labels)


#: A quoted string of a list written as text, once escaped quotes are out of the way.
_QUOTED = "'[^']*+'|\"[^\"]*+\""
#: Escapes, what stands for them while strings are cut, and what they mean.
_ESCAPES = [("\\\\", "\x00", "\\"), ("\\'", "\x01", "'"), ('\\"', "\x02", '"'), ("\\n", "\x03", "\n"), ("\\t", "\x04", "\t"), ("\\r", "\x05", "\r")]


def choices_from_literal(items: DataFrame, column: str = "choices") -> DataFrame:
    """Choices array from a list written as text, ``['a', "it's", 'b\\n']``
    (E7); NULL where the text is no list of quoted strings."""
    text = F.col(column)
    for escape, mark, _ in _ESCAPES:
        text = F.replace(text, F.lit(escape), F.lit(mark))

    def plain(s: Column) -> Column:
        s = F.substring(s, F.lit(2), F.length(s) - 2)
        for _, mark, char in _ESCAPES:
            s = F.replace(s, F.lit(mark), F.lit(char))
        return s

    strings = F.regexp_extract_all(text, F.lit(_QUOTED), 0)
    is_list = text.rlike(rf"^\s*\[\s*(?:(?:{_QUOTED})\s*(?:,\s*|(?=\])))*+\]\s*$")
    return items.withColumn(column, F.when(is_list, F.transform(strings, plain)))


def paragraphs_by_url(sentences: DataFrame) -> DataFrame:
    """Sentences with a topic joined per (language, url) in position order,
    topic lower-cased, first topic kept (E8)."""
    s = sentences.where(F.col("topic").isNotNull()).withColumn("topic", F.lower("topic"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))),
                                    lambda x: x["text"]), " ")
    return s.groupBy("bcp_47", "url").agg(text.alias("text"),
                                          F.min_by("topic", F.col("pos")).alias("topic"))


def top_topics(paragraphs: DataFrame, k: int = 5) -> DataFrame:
    """The k topics with most paragraphs per language (ties by name)."""
    counts = paragraphs.groupBy("bcp_47", "topic").agg(F.count(F.lit(1)).alias("n"))
    return top_k_per_group(counts, ["bcp_47"], [F.col("n").desc(), F.col("topic")], k,
                           out="topic_rank")


def topic_paragraphs(sentences: DataFrame, k: int = 5) -> DataFrame:
    """Paragraphs whose topic is among the language's top k."""
    p = paragraphs_by_url(sentences)
    return p.join(top_topics(p, k).select("bcp_47", "topic"), ["bcp_47", "topic"], "left_semi")


def seeded_paragraph(paragraphs: DataFrame, n_sentences: int = K.N_SENTENCES) -> DataFrame:
    """One pseudo-random paragraph per (language, nr), seeded by nr."""
    p = paragraphs.select("bcp_47", "url", "topic",
                          F.explode(F.sequence(F.lit(0), F.lit(n_sentences - 1))).alias("sentence_nr"))
    pick = F.min_by(F.struct("url", "topic"), md5_order(F.col("sentence_nr"), F.col("url")))
    return (p.groupBy("bcp_47", "sentence_nr").agg(pick.alias("_p"))
            .select("bcp_47", "sentence_nr", F.col("_p.url").alias("url"),
                    F.col("_p.topic").alias("topic")))


def weighted_sample(langs: DataFrame, weight: str, seed: int = K.BOOTSTRAP_SEED) -> DataFrame:
    """As many weighted draws with replacement as there are languages.

    Each language owns the interval [cum - w, cum) of the running weight
    total; draw k (one per language, numbered in code order) is
    ``md5(seed|k)`` scaled to the total.  Draws meet intervals by an
    equi-join on equal-width cells of [0, 1), as many as languages: the
    intervals cover at most twice that many cells.
    """
    w = langs.select("bcp_47", F.col(weight).cast("double").alias("_w"))
    one = F.lit(1).cast("long")
    cum = running(running(w, ["bcp_47"], F.col("_w"), "sum", "_hi"), ["bcp_47"], one, "sum", "_k")
    total = w.agg(F.sum("_w")).scalar()
    n = w.agg(F.count(F.lit(1))).scalar()
    cell = lambda x: F.least(F.floor(x * n), n - 1)
    iv = cum.select("bcp_47", ((F.col("_hi") - F.col("_w")) / total).alias("lo"), (F.col("_hi") / total).alias("hi"))
    iv = iv.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    draws = (cum.select((F.col("_k") - 1).alias("draw")).withColumn("u", md5_uniform(F.lit(seed), F.col("draw")))
             .withColumn("cell", cell(F.col("u"))))
    return (draws.join(iv, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
            .select(F.col("draw").cast("int").alias("draw"), "bcp_47"))


def numbered_sentences(sentences: DataFrame, n: int = K.N_SENTENCES) -> DataFrame:
    """The first ``n`` sentences per language in position order (from 0).
    Texts are joined to the chosen positions only."""
    top = top_k_per_group(sentences.select("bcp_47", "pos"), ["bcp_47"], [F.col("pos")], n, out="_i")
    return (sentences.select("bcp_47", "pos", "text").join(top, ["bcp_47", "pos"])
            .select("bcp_47", (F.col("_i") - 1).alias("sentence_nr"), "text"))


def parallel_pairs(sentences: DataFrame, targets: DataFrame,
                   n_sentences: int = K.N_SENTENCES) -> DataFrame:
    """Source and target sentence nr for each language and both directions,
    the other language = draw nr of the weighted sample: ``from`` translates
    the language into it, ``to`` the other way round; missing sentences drop
    the pair (E12)."""
    num = numbered_sentences(sentences, n_sentences)
    t = targets.select(F.col("draw").alias("sentence_nr"), F.col("bcp_47").alias("other"))
    own = num.select("bcp_47", "sentence_nr", F.col("text").alias("own_text"))
    oth = num.select(F.col("bcp_47").alias("other"), "sentence_nr", F.col("text").alias("other_text"))
    j = own.join(t, "sentence_nr").join(oth, ["other", "sentence_nr"])
    side = lambda mode, target, a, b: F.struct(
        F.lit(mode).alias("mode"), F.col(target).alias("target"), F.col(a).alias("source_text"), F.col(b).alias("target_text"))
    both = F.array(side("from", "other", "own_text", "other_text"), side("to", "bcp_47", "other_text", "own_text"))
    return j.select("bcp_47", "other", "sentence_nr", F.explode(both).alias("_s")).select("bcp_47", "other", "sentence_nr", "_s.*")


def paragraph_topics(sentences: DataFrame) -> DataFrame:
    """(language, url, first topic) without building the paragraph text."""
    s = sentences.where(F.col("topic").isNotNull()).withColumn("topic", F.lower("topic"))
    return s.groupBy("bcp_47", "url").agg(F.min_by("topic", F.col("pos")).alias("topic"))


def classification_requests(sentences: DataFrame, k: int = 5,
                            n_sentences: int = K.N_SENTENCES) -> DataFrame:
    """Classification prompt per (language, nr).

    Topic counts and the seeded pick need only (language, url, topic); the
    paragraph text is concatenated for the picked urls only (at most
    ``n_sentences`` per language), not for every paragraph.
    """
    pt = paragraph_topics(sentences)
    top = top_topics(pt, k)
    eligible = pt.join(top.select("bcp_47", "topic"), ["bcp_47", "topic"], "left_semi")
    pick = seeded_paragraph(eligible, n_sentences)
    picked = sentences.join(pick.select("bcp_47", "url").distinct(), ["bcp_47", "url"], "left_semi")
    texts = paragraphs_by_url(picked).select("bcp_47", "url", "text")
    topics = (top.groupBy("bcp_47")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("topic_rank", "topic"))),
                                            lambda x: x["topic"]), ", ").alias("topics")))
    j = pick.join(texts, ["bcp_47", "url"]).join(topics, "bcp_47")
    prompt = F.format_string(CLASSIFY_PROMPT.replace("{topics}", "%s").replace("{text}", "%s"),
                             F.col("topics"), F.col("text"))
    return j.select(F.lit("classification").alias("task"), F.col("bcp_47").alias("item_key"),
                    "sentence_nr", prompt.alias("prompt"))


def lettered(choices: Column) -> Column:
    """'A: first\\nB: second\\n...'."""
    return F.array_join(F.transform(choices, lambda x, i: F.concat(
        F.chr(F.lit(65) + i), F.lit(": "), x, F.lit("\n"))), "")


def multiple_choice_requests(items: DataFrame) -> DataFrame:
    """TruthfulQA-style prompt: first text is the question, the rest the
    lettered choices (E13)."""
    q = F.element_at("choices", 1)
    rest = F.slice("choices", 2, F.size("choices"))
    prompt = F.format_string(TRUTHFULQA_PROMPT.replace("{question}", "%s").replace("{choices}", "%s"),
                             q, lettered(rest))
    return items.where(F.size("choices") >= 2).select(
        F.lit("truthfulqa").alias("task"), F.col("conv_id").cast("string").alias("item_key"),
        F.lit(0).alias("sentence_nr"), prompt.alias("prompt"))


def _fill(template: str, **parts: Column) -> Column:
    """The template with its placeholders (each once, in any order) replaced."""
    out, rest = [], template
    for name, c in sorted(parts.items(), key=lambda kv: template.index("{" + kv[0] + "}")):
        head, rest = rest.split("{" + name + "}", 1)
        out += [F.lit(head), c]
    return F.concat(*out, F.lit(rest))


def four_choice_requests(items: DataFrame, task: str) -> DataFrame:
    """MMLU- or ARC-style prompt of items with a question and four choices."""
    ch = [F.element_at("choices", i) for i in range(1, 5)]
    prompt = _fill(MULTIPLE_CHOICE_PROMPT, format=F.lit(ANSWER_FORMAT), question=F.col("question"),
                   a=ch[0], b=ch[1], c=ch[2], d=ch[3])
    return items.where(F.size("choices") >= 4).select(
        F.lit(task).alias("task"), "item_key", "sentence_nr", prompt.alias("prompt"))


def math_requests(items: DataFrame) -> DataFrame:
    """Math prompt of items with a question."""
    prompt = _fill(MATH_PROMPT, format=F.lit(ANSWER_FORMAT), question=F.col("question"))
    return items.select(F.lit("mgsm").alias("task"), "item_key", "sentence_nr", prompt.alias("prompt"))


def translation_requests(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Translation prompt per pair and direction (E13).  ``names``: bcp_47,
    language_name and script of the target."""
    n = names.select(F.col("bcp_47").alias("target"), "language_name", "script")
    prompt = _fill(TRANSLATE_PROMPT, language=F.col("language_name"), script=F.col("script"), text=strip_ws(F.col("source_text")))
    return pairs.join(n, "target").select(
        F.concat(F.lit("translation_"), F.col("mode")).alias("task"), F.col("bcp_47").alias("item_key"),
        "sentence_nr", prompt.alias("prompt"))


def shuffled_choices(items: DataFrame, seed: int = K.BOOTSTRAP_SEED) -> DataFrame:
    """Choices and labels shuffled together by a seeded per-item order."""
    zipped = F.arrays_zip(F.col("choices").alias("c"), F.col("labels").alias("l"),
                          F.sequence(F.lit(1), F.size("choices")).alias("i"))
    keyed = F.transform(zipped, lambda z: F.struct(
        md5_order(F.lit(seed), F.col("conv_id"), z["i"]).alias("k"), z["c"].alias("c"),
        z["l"].alias("l")))
    s = items.select("conv_id", F.array_sort(keyed).alias("_s"))
    out = s.select("conv_id", F.transform("_s", lambda x: x["c"]).alias("choices"),
                   F.transform("_s", lambda x: x["l"]).alias("labels"))
    return out.withColumn("answer", correct_letter(F.col("labels")))


def translation_worklist(items: DataFrame, supported: DataFrame, per_category: int = 20) -> DataFrame:
    """Supported languages without a human-translated set (E15), each paired
    with up to ``per_category`` original items per category (E16).

    The originals are the English items of the first source.  A language
    has the positions 1 to ``per_category``; these meet the sample by an
    equi-join, so the sample stays off the driver.
    """
    human = items.where(F.col("source_rank").isin(*HUMAN_RANKS)).select("bcp_47")
    todo = supported.select("bcp_47").join(human, "bcp_47", "left_anti")
    pool = items.where((F.col("source_rank") == 0) & (F.col("bcp_47") == "en")).select("subject", "doc_id")
    sample = top_k_per_group(pool, ["subject"], [F.col("doc_id")], per_category)
    places = todo.select("bcp_47", F.explode(F.sequence(F.lit(1), F.lit(per_category))).alias("pos"))
    return places.join(sample, "pos").select("bcp_47", "subject", "doc_id", "pos")


def regroup_choices(conversations: DataFrame, size: int = 4) -> DataFrame:
    """A flat list of choice texts regrouped in chunks of ``size``."""
    flat = conversations.select("conv_id", "turn", "text")
    chunk = F.floor(F.col("turn") / size).cast("int")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return flat.groupBy("conv_id", chunk.alias("chunk")).agg(ordered.alias("choices"))


def category_counts(items: DataFrame) -> DataFrame:
    """Items and languages of each source and category, and how many sources
    have the category (E18)."""
    per = items.groupBy("source_rank", "subject").agg(
        F.count(F.lit(1)).alias("n_items"), F.countDistinct("bcp_47").alias("n_languages"))
    wide = per.groupBy("subject").agg(F.count(F.lit(1)).alias("n_sources"))
    return per.join(wide, "subject")


def sources_per_language(items: DataFrame) -> DataFrame:
    """Sources, items and categories that each language has."""
    return items.groupBy("bcp_47").agg(
        F.sort_array(F.collect_set("source_rank")).alias("sources"), F.count(F.lit(1)).alias("n_items"),
        F.countDistinct("subject").alias("n_subjects"))


def dataset_coverage(items: DataFrame, sources: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    """Per source: subjects, items, languages, and the languages it misses
    that other sources have (E18)."""
    per = items.groupBy("source_rank").agg(
        F.countDistinct("subject").alias("n_subjects"), F.count(F.lit(1)).alias("n_items"),
        F.countDistinct("bcp_47").alias("n_languages"))
    present = items.select("bcp_47", "source_rank").distinct()
    langs = items.select("bcp_47").distinct()
    grid = langs.select("bcp_47", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source_rank"))
    missing = (grid.join(present, ["bcp_47", "source_rank"], "left_anti")
               .groupBy("source_rank").agg(F.sort_array(F.collect_list("bcp_47")).alias("missing")))
    return (per.join(missing, "source_rank", "left")
            .withColumn("missing", F.coalesce(F.col("missing"), F.array().cast("array<string>"))))
