"""DuckDB SQL for the oracle check: view CTEs and shared building blocks.

The view texts are the mapping of FIXTURES.md §3; queries are assembled as
``WITH <views>, <blocks>, <query ctes> SELECT ...``.
"""

from __future__ import annotations

from ..sources.views import LOGGED_TASKS, TASK_SOURCES, TRANSLATION_TASKS

#: Samples that coverage asks of each (task, language): the derived log tries few of them.
COVER_SLOTS = 1

VIEWS = {
    "result_log": """
SELECT concat('m', cast(l.l_suppkey AS string)) AS model, n.n_name AS bcp_47,
 CASE p.p_type WHEN 'ECONOMY' THEN 'translation_from' WHEN 'LARGE' THEN 'translation_to' WHEN 'MEDIUM' THEN 'classification'
  WHEN 'PROMO' THEN 'mmlu' WHEN 'SMALL' THEN 'arc' ELSE 'mgsm' END AS task,
 CASE WHEN p.p_type IN ('ECONOMY','LARGE') THEN 'bleu' ELSE 'accuracy' END AS metric,
 l.l_linenumber AS sentence_nr,
 CASE WHEN l.l_quantity <= 5 THEN 0.0e0 WHEN p.p_type IN ('ECONOMY','LARGE') THEN l.l_discount*10
  WHEN l.l_discount >= 0.05 THEN 1.0e0 ELSE 0.0e0 END AS score,
 CASE WHEN l.l_returnflag='A' THEN 'machine' ELSE 'human' END AS origin,
 CASE WHEN l.l_quantity <= 5 THEN 'error' WHEN l.l_quantity <= 10 THEN NULL ELSE 'ok' END AS status,
 l.l_shipdate AS logged_at, l.l_orderkey AS tie1, l.l_partkey AS tie2, l.l_extendedprice AS tie3
FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN customer c ON o.o_custkey=c.c_custkey
JOIN nation n ON c.c_nationkey=n.n_nationkey JOIN part p ON l.l_partkey=p.p_partkey""",
    "models": """
SELECT concat('m',cast(s.s_suppkey AS string)) AS id, s.s_name AS name, n.n_name AS provider_name, s.s_acctbal/250 AS cost,
 CASE WHEN s.s_suppkey % 3 = 0 THEN 'open-source' ELSE 'closed-source' END AS type, min(cast(l.l_shipdate AS date)) AS creation_date,
 CASE WHEN s.s_suppkey % 3 = 0 THEN lower(n.n_name) || '/model-' || CAST(s.s_suppkey AS VARCHAR) END AS hf_id,
 CASE WHEN s.s_suppkey % 3 = 0 THEN (s.s_suppkey % 70 + 1) * 1e9 END AS size,
 CASE WHEN s.s_suppkey % 3 = 0 THEN CASE WHEN s.s_suppkey % 2 = 0 THEN 'Apache 2.0' ELSE 'Mit' END END AS license
 FROM supplier s JOIN nation n ON s.s_nationkey=n.n_nationkey LEFT JOIN lineitem l ON l.l_suppkey=s.s_suppkey
 GROUP BY s.s_suppkey, s.s_name, n.n_name, s.s_acctbal""",
    "languages": """
SELECT n.n_name AS bcp_47, n.n_name AS language_name, 'Lingua ' || CAST(n.n_nationkey AS VARCHAR) AS autonym, r.r_name AS family, count(c.c_custkey)*1000 AS speakers, n.n_nationkey < 20 AS in_benchmark
  FROM nation n
  JOIN region r ON n.n_regionkey=r.r_regionkey
  LEFT JOIN customer c ON c.c_nationkey=n.n_nationkey
  GROUP BY n.n_name, r.r_name, n.n_nationkey""",
    "population": """
SELECT n.n_name AS bcp_47, c.c_mktsegment AS iso2, count(*)*50 AS population
  FROM customer c
  JOIN nation n ON c.c_nationkey=n.n_nationkey
  GROUP BY n.n_name, c.c_mktsegment""",
    "items": """
SELECT doc_id, greatest(CAST(substr(source,4) AS int) % 4, CASE lang WHEN 'de' THEN 1 WHEN 'es' THEN 2 ELSE 0 END) AS source_rank, lang AS bcp_47, concat('subj', CAST(doc_id % 5 AS string)) AS subject, doc_id % 200 AS item_id
  FROM documents""",
    "paragraphs": """
SELECT d.doc_id // 25 AS url, d.doc_id AS pos, d.lang AS bcp_47, CASE
    WHEN l.quality IS NULL THEN NULL
    ELSE concat('Topic', CAST(d.doc_id // 25 % 7 AS string)) END AS topic, d.text
  FROM documents d
  LEFT JOIN labels l ON d.doc_id=l.doc_id""",
    "responses": """
SELECT conv_id, turn, CASE
    WHEN (conv_id+turn) % 6 = 0 THEN NULL
    WHEN (conv_id+turn) % 6 = 1 THEN concat('<think>', text, '</think><final_answer>', chr(12288), substr('ABCD', CAST(conv_id % 4 AS int)+1, 1), chr(160), '</final_answer>')
    WHEN (conv_id+turn) % 6 = 2 THEN text
    ELSE concat('<reasoning>', text, '</reasoning><final_answer>', substr('ABCD', CAST((conv_id+turn) % 4 AS int)+1, 1), '</final_answer>') END AS response, substr('ABCD', CAST(conv_id % 4 AS int)+1, 1) AS answer
  FROM conversations WHERE role='assistant'""",
    "run_health": """
SELECT concat('u', CAST(user_id % 30 AS string)) AS model, CAST(floor((event_id % 10)) AS int) AS run_nr, count(*) AS total, sum(CASE
    WHEN event_type IN ('error','view') AND (user_id + event_id % 10) % 3 <> 0 THEN 1
    WHEN (user_id % 30 + event_id % 10) % 4 = 0 THEN 1
    ELSE 0 END) AS failed
  FROM events
  GROUP BY user_id % 30, event_id % 10""",
    "timings": """
SELECT concat('u', CAST(user_id % 30 AS string)) AS model, value * (user_id % 30) / 2500 AS seconds
  FROM events""",
    "catalog": """
SELECT concat('vendor', CAST(p_partkey % 25 AS string), '/', replace(p_name,' ','-'), '-', CAST(p_size AS string), '.', CAST(p_partkey % 3 AS string),
   CASE p_type WHEN 'ECONOMY' THEN '-mini' WHEN 'LARGE' THEN '-pro' WHEN 'MEDIUM' THEN '-70b' WHEN 'PROMO' THEN '-preview' WHEN 'SMALL' THEN '-flash' ELSE '' END) AS slug,
 concat('Vendor ', CAST(p_partkey % 25 AS string), ': ', p_name, CASE WHEN p_partkey % 5 = 0 THEN ' (free)' ELSE '' END) AS name,
 CASE WHEN p_partkey % 5 = 0 THEN '0' WHEN p_partkey % 11 = 0 THEN 'n/a' ELSE CAST((p_retailprice - 890) / 3000000 AS string) END AS price_text,
 CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(p_partkey % 700 AS int) END AS created,
 CASE WHEN p_partkey % 4 = 1 THEN DATE '2023-06-01' + CAST(p_partkey % 900 AS int) END AS repository_created,
 p_partkey % 17 = 0 AS trains_on_prompts
FROM part""",
    "dataset_catalog": """
SELECT source AS name, concat('group', CAST(CAST(substr(source,4) AS int) % 5 AS string)) AS catalog_group,
 CASE WHEN CAST(substr(source,4) AS int) % 4 = 0 THEN NULL ELSE CAST(count(DISTINCT lang) AS string) END AS n_languages,
 CASE CAST(substr(source,4) AS int) % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'machine' WHEN 2 THEN 'mixed' END AS translation,
 split(CASE CAST(substr(source,4) AS int) % 3 WHEN 0 THEN 'translation,classification' WHEN 1 THEN 'mmlu' ELSE 'mgsm,arc,translation' END, ',') AS tasks,
 CAST(substr(source,4) AS int) % 2 = 0 AS implemented
FROM documents GROUP BY source""",
    "task_sources": """
SELECT r.source, r.task, n.n_name AS bcp_47
FROM nation n JOIN (VALUES """ + ", ".join(str(r) for r in TASK_SOURCES) + """) r(source, task, every, rest)
  ON n.n_nationkey % r.every = r.rest""",
    "model_tasks": f"""
SELECT concat('m', CAST(s_suppkey AS string)) AS model,
  CASE WHEN s_suppkey % 3 = 0 THEN {TRANSLATION_TASKS} ELSE {LOGGED_TASKS} END AS tasks FROM supplier""",
}

# Shared derived tables, each with the names of what it needs.
BLOCKS = {
    # G1: last row per 5-key in log order.
    "kl": (["result_log"], """
SELECT * FROM result_log
QUALIFY row_number() OVER (PARTITION BY task, model, bcp_47, metric, sentence_nr
  ORDER BY logged_at DESC, tie1 DESC, tie2 DESC, tie3 DESC) = 1"""),
    # G2
    "valid": (["kl"], "SELECT * FROM kl WHERE status IS NULL OR status = 'ok'"),
    # Cells that each model's tasks ask for, and those that it attempted.
    "matrix": (["kl", "task_sources", "model_tasks", "languages"], f"""
SELECT t.model, e.task, e.bcp_47, s.slot, h.model IS NOT NULL AS done
FROM model_tasks t JOIN (SELECT DISTINCT task, bcp_47 FROM task_sources WHERE bcp_47 IN (SELECT bcp_47 FROM languages)) e
  ON list_contains(t.tasks, e.task) CROSS JOIN range(0, {COVER_SLOTS}) s(slot)
LEFT JOIN (SELECT DISTINCT model, task, bcp_47, sentence_nr % {COVER_SLOTS} AS slot FROM kl) h
  ON h.model = t.model AND h.task = e.task AND h.bcp_47 = e.bcp_47 AND h.slot = s.slot"""),
    "cov": (["matrix"], "SELECT model FROM matrix GROUP BY model HAVING bool_and(done)"),
    # G3 with the thresholds of the registered queries (min 100 rows, 20 %).
    "pub": (["kl", "cov"], """
SELECT model FROM kl WHERE model IN (SELECT model FROM cov) GROUP BY model
HAVING NOT (count(*) >= 100 AND count(*) FILTER (WHERE status = 'error') / count(*) * 100 >= 20)"""),
    # The published aggregate.
    "results": (["valid", "pub", "languages"], """
SELECT model, bcp_47, task, metric, avg(score) AS score,
  arg_min(origin, (logged_at, tie1, tie2, tie3)) AS origin
FROM valid WHERE model IN (SELECT model FROM pub) AND bcp_47 IN (SELECT bcp_47 FROM languages)
GROUP BY model, bcp_47, task, metric"""),
    "kl_tm": (["kl"], "SELECT *, task || '_' || metric AS task_metric FROM kl"),
    "results_tm": (["results"], """
SELECT *, task || '_' || metric AS task_metric, task || '_' || metric || '_' || origin AS task_metric_origin
FROM results"""),
}


def _closure(names):
    """Views and blocks needed by ``names`` in dependency order."""
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        if n in BLOCKS:
            for dep in BLOCKS[n][0]:
                visit(dep)
        elif n not in VIEWS:
            raise KeyError(n)
        out.append(n)

    for n in names:
        visit(n)
    return out


def build(uses: list[str], body: str, ctes: list[tuple[str, str]] = (),
          recursive: bool = False) -> str:
    """``WITH`` all needed views/blocks plus ``ctes``, then ``body``."""
    parts = []
    for n in _closure(uses):
        text = VIEWS[n] if n in VIEWS else BLOCKS[n][1]
        parts.append(f"{n} AS ({text.strip()})")
    for name, text in ctes:
        parts.append(f"{name} AS ({text.strip()})")
    kw = "WITH RECURSIVE " if recursive else "WITH "
    head = (kw + ",\n".join(parts) + "\n") if parts else ""
    return head + body.strip()


def pivot_cols(metrics, agg: str = "avg(score)", col: str = "task_metric",
               suffix: str = "") -> str:
    """``agg FILTER (WHERE col = m) AS m`` for each metric."""
    return ",\n  ".join(f"{agg} FILTER (WHERE {col} = '{m}') AS {m}{suffix}" for m in metrics)


def strict_avg(metrics) -> str:
    return "(" + " + ".join(metrics) + f") / {len(metrics)}"
