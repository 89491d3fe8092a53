"""Bootstrap intervals and correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import bootstrap as bs
from ..operators import correlation as cor
from .registry import query

M = K.AVERAGED_METRICS
T = cor.CORRELATION_TASKS
HIGHLIGHTED = ["NATION_1", "NATION_2", "NATION_3"]
B = K.BOOTSTRAP_REPLICATES
_METRICS = ", ".join(f"'{m}'" for m in M)


def _poly(coefficients, x: str) -> str:
    """Horner form of a polynomial, highest power first."""
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out}) * ({x}) + {c!r}"
    return out


def ci_ctes(source: str, name: str = "ci") -> list[tuple[str, str]]:
    """CTEs of a B = 1000 Poisson bootstrap over ``source`` (grp, score):
    ``{name}`` has grp, ci_lower, ci_upper.

    Each shift-and-multiply step of the hash is a column of its own, and the
    Poisson weight is the first table entry at or above the uniform.
    """
    mask = "4294967295"
    return [
        (f"{name}_bins", f"""SELECT grp, score, count(*) AS n,
            ('0x' || substr(md5(grp || '|' || CAST(CAST(round(score * 1e9) AS BIGINT) AS VARCHAR) || '|{K.BOOTSTRAP_SEED}'), 1, 8))::BIGINT AS seed
          FROM ({source}) WHERE score IS NOT NULL GROUP BY grp, score"""),
        (f"{name}_s1", f"SELECT *, (xor(seed, seed >> 16)::HUGEINT * {bs.FMIX[0]} % 4294967296)::BIGINT AS a FROM {name}_bins"),
        (f"{name}_s2", f"SELECT *, (xor(a, a >> 13)::HUGEINT * {bs.FMIX[1]} % 4294967296)::BIGINT AS b FROM {name}_s1"),
        (f"{name}_s3", f"""SELECT grp, score, n, rep, xor(xor(b, b >> 16), ((rep + 1) * {bs.STEP}) & {mask}) AS x
          FROM {name}_s2, range(0, {B}) t(rep)"""),
        (f"{name}_s4", f"SELECT grp, score, n, rep, (xor(x, x >> 16)::HUGEINT * {bs.FMIX[0]} % 4294967296)::BIGINT AS a FROM {name}_s3"),
        (f"{name}_s5", f"SELECT grp, score, n, rep, (xor(a, a >> 13)::HUGEINT * {bs.FMIX[1]} % 4294967296)::BIGINT AS b FROM {name}_s4"),
        (f"{name}_u", f"SELECT grp, score, n, rep, (xor(b, b >> 16) + 0.5e0) / 4294967296e0 AS u FROM {name}_s5"),
        (f"{name}_k", f"""SELECT n, unnest(range(greatest(0, trunc(n - 12 * sqrt(n) - 10)::BIGINT), trunc(n + 12 * sqrt(n) + 10)::BIGINT + 1)) AS k
          FROM (SELECT DISTINCT n FROM {name}_bins WHERE n < {bs.EXPANDED_FROM})"""),
        (f"{name}_l", f"""SELECT n, k, sum(CASE WHEN first THEN 0e0 ELSE ln(n) - ln(k) END) OVER (PARTITION BY n ORDER BY k) AS logp
          FROM (SELECT n, k, k = min(k) OVER (PARTITION BY n) AS first FROM {name}_k)"""),
        (f"{name}_p", f"SELECT n, k, exp(logp - max(logp) OVER (PARTITION BY n)) AS p FROM {name}_l"),
        (f"{name}_c", f"""SELECT n, k, sum(p) OVER (PARTITION BY n ORDER BY k) / sum(p) OVER (PARTITION BY n) AS hi FROM {name}_p"""),
        (f"{name}_z", f"""SELECT *, CASE WHEN least(u, 1 - u) >= {bs.TAIL} THEN q * ({_poly(bs.MIDDLE[0], "q * q")}) / ({_poly(bs.MIDDLE[1], "q * q")})
            ELSE -sign(q) * ({_poly(bs.TAILS[0], "r")}) / ({_poly(bs.TAILS[1], "r")}) END AS z
          FROM (SELECT *, u - 0.5e0 AS q, sqrt(-2 * ln(least(u, 1 - u))) AS r FROM {name}_u WHERE n >= {bs.EXPANDED_FROM})"""),
        (f"{name}_m", f"""SELECT grp, rep, sum(w * score) / nullif(sum(w), 0) AS m FROM (
            SELECT u.grp, u.rep, u.score, c.k AS w FROM {name}_u u ASOF JOIN {name}_c c ON u.n = c.n AND u.u <= c.hi
            UNION ALL SELECT grp, rep, score, ceil(n + sqrt(n) * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * sqrt(n)) - 0.5) FROM {name}_z)
          GROUP BY grp, rep"""),
        (name, f"""SELECT grp, quantile_cont(m, 0.025) AS ci_lower, quantile_cont(m, 0.975) AS ci_upper
          FROM {name}_m GROUP BY grp"""),
    ]


def long_ci_ctes(group: str, name: str = "ci", source: str = "kl_tm") -> list[tuple[str, str]]:
    """Intervals per group and metric and for the pooled average: ``{name}_long``."""
    src = (f"SELECT {group} || chr(1) || task_metric AS grp, score FROM {source} WHERE task_metric IN ({_METRICS}) "
           f"UNION ALL SELECT {group} || chr(1) || 'average', score FROM {source} WHERE task_metric IN ({_METRICS})")
    return [*ci_ctes(src, name), (f"{name}_long", f"""SELECT split_part(grp, chr(1), 1) AS {group}, split_part(grp, chr(1), 2) AS metric,
        ci_lower, ci_upper FROM {name}""")]


@query("bootstrap_ci", ["kl_tm"], "SELECT grp AS model, ci_lower, ci_upper FROM ci",
       ci_ctes("SELECT model AS grp, score FROM kl_tm WHERE metric = 'accuracy'"))
def bootstrap_ci(ctx):
    """Per-model CI of accuracy rows, B = 1000."""
    return bs.poisson_bootstrap_ci(ctx.detailed.where(F.col("metric") == "accuracy"), "model")


@query("bootstrap_ci_pooled", ["kl_tm"],
       "SELECT grp AS model, ci_lower AS average_ci_lower, ci_upper AS average_ci_upper FROM ci",
       ci_ctes(f"SELECT model AS grp, score FROM kl_tm WHERE task_metric IN ({_METRICS})"))
def bootstrap_ci_pooled(ctx):
    """Per-model CI of the six averaged metrics pooled, B = 1000."""
    d = ctx.detailed.where(F.concat_ws("_", "task", "metric").isin(M))
    return bs.poisson_bootstrap_ci(d, "model", prefix="average_")


@query("bootstrap_ci_full", ["kl_tm"], "SELECT * FROM ci_long", long_ci_ctes("model"))
def bootstrap_ci_full(ctx):
    """CIs per model and metric plus the pooled average, B = 1000."""
    return bs.metric_intervals(ctx.detailed, "model")


@query("bootstrap_ci_language", ["kl_tm"], "SELECT * FROM ci_long", long_ci_ctes("bcp_47"))
def bootstrap_ci_language(ctx):
    """CIs per language and metric plus the pooled average, B = 1000."""
    return bs.metric_intervals(ctx.detailed, "bcp_47")


# ------------------------------------------------------------------ correlation

_J = [
    ("jm", """SELECT task, metric, bcp_47, avg(score) AS score FROM results
              WHERE metric <> 'chrf' GROUP BY task, metric, bcp_47"""),
    ("jl", """SELECT task, metric, bcp_47, CASE WHEN task = 'classification'
                THEN ln(least(greatest(score, 0.001), 0.999) / (1 - least(greatest(score, 0.001), 0.999)))
                ELSE score END AS score FROM jm"""),
    ("jp", "SELECT bcp_47, " + ", ".join(
        f"avg(score) FILTER (WHERE task = '{t}') AS {t}" for t in T) + " FROM jl GROUP BY bcp_47"),
]


def _logit(ctx):
    return cor.logit_classification(cor.task_language_means(ctx.results))


@query("task_language_means", ["results"], "SELECT * FROM jp", _J)
def task_language_means(ctx):
    """Language x task matrix of mean (logit-transformed) scores."""
    return cor.task_pivot(_logit(ctx))


@query("logit_scores", ["results"], "SELECT * FROM jl", _J)
def logit_scores(ctx):
    """Per-language task means with logit classification scores."""
    return _logit(ctx)


@query("task_correlation", ["results"], "\nUNION ALL\n".join(
    f"SELECT '{T[i]}' AS task_y, '{T[j]}' AS task_x, corr({T[i]}, {T[j]}) AS corr FROM jp"
    for i in range(len(T)) for j in range(i)), _J)
def task_correlation(ctx):
    """Pairwise-complete Pearson correlations, lower triangle."""
    return cor.task_correlation(cor.task_pivot(_logit(ctx)))


@query("score_histogram", ["results"], """
SELECT jl.task, CAST(CASE WHEN hi - lo = 0 THEN 0 ELSE least(floor((score - lo) / (hi - lo) * 20), 19) END AS INTEGER) AS bin,
  count(*) AS n
FROM jl JOIN (SELECT task, min(score) AS lo, max(score) AS hi FROM jl WHERE score IS NOT NULL GROUP BY task) b
  ON b.task = jl.task
WHERE score IS NOT NULL GROUP BY 1, 2""", _J)
def score_histogram(ctx):
    """20-bin histogram per task."""
    return cor.score_histogram(_logit(ctx).select("task", "bcp_47", "score"))


@query("scatter_pairs", ["results"], "\nUNION ALL\n".join(
    f"""SELECT bcp_47, '{x}' AS task_x, '{y}' AS task_y, {x} AS x, {y} AS y,
          bcp_47 IN ({", ".join(f"'{h}'" for h in HIGHLIGHTED)}) AS highlighted,
          CASE WHEN bcp_47 IN ({", ".join(f"'{h}'" for h in HIGHLIGHTED)}) THEN bcp_47 ELSE 'Other' END AS label
        FROM jp WHERE {x} IS NOT NULL AND {y} IS NOT NULL"""
    for y in T for x in T if x != y), _J)
def scatter_pairs(ctx):
    """Scatter points per ordered task pair, highlighted languages labelled."""
    return cor.scatter_pairs(cor.task_pivot(_logit(ctx)), HIGHLIGHTED)
