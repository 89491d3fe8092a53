"""URL filters by a temporal list join, in DataFrame functions only.

List entries are dated: a pattern is added and removed over time.  Entries
become validity intervals, and every capture is judged against the entries
active on the day it was fetched (an as-of join).

A pattern is a domain (it covers its subdomains) or a domain and the first
segment of a path.  A capture has few keys: the suffixes of its host (at most
253 characters), each alone and with its first segment.

* Keys are reduced to distinct (pattern, day) pairs before the join with the
  intervals, so a domain with a third of all captures is one row a day.
* Captures are reduced to distinct (host, segment, day) before their keys are
  joined back; the most specific active pattern decides.

Defined results: hosts may have letters and digits of any script and are
compared in lower case as written; a null or unparsable URL, one whose host
has any other character, a host over 253 characters or a null day matches
nothing and isn't blocked; of entries for one pattern and
day, an addition beats a removal and the smaller category wins; a removal
without an addition does nothing; repeated captures are judged each; other
columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The host is taken whole or not at all: it ends where port, path, query or fragment begin, or with the URL.
_URL = (r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#\\]*@)?+([\p{L}\p{M}\p{N}._-]+)(?=[:/?#\\]|\s*$)"
        r"(?::[0-9]+)?(?:/([^/?#]*))?")
# ASCII hosts only, and any prefix of a host that is one; equal to the above on hosts of ASCII letters.
_SQL_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([A-Za-z0-9._-]+)(?::[0-9]+)?(?:/([^/?#]*))?"


def host(url: Column) -> Column:
    h = F.lower(F.regexp_extract(url, _URL, 1))
    return F.when((h != "") & (F.length(h) <= 253), h)


def segment(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, category, since, until (exclusive; null: still listed)."""
    one = entries.select("pattern", "day", "action", "category").where("pattern is not null and day is not null") \
        .groupBy("pattern", "day").agg(F.min(F.struct("action", "category")).alias("e"))
    following = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return (one.select("pattern", "e.*", F.col("day").alias("since"), following.alias("until"))
            .where("action = 'add'").drop("action"))


def keys() -> Column:
    """Patterns that cover (host, segment), as an array."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    with_path = F.when(F.col("segment") != "", F.transform(suffixes, lambda s: F.concat(s, F.lit("/"), F.col("segment"))))
    return F.when(F.col("host").isNotNull(), F.concat(suffixes, F.coalesce(with_path, F.array().cast("array<string>"))))


def judged(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", day_col: str = "day",
           keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns, url, day, blocked, pattern, category and since."""
    rows = captures.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(url_col).alias("u"),
                           F.col(day_col).alias("d"), host(F.col(url_col)).alias("host"), segment(F.col(url_col)).alias("segment"))
    looked = (rows.where("host is not null and d is not null").select("host", "segment", "d").distinct()
              .select("host", "segment", "d", F.explode(keys()).alias("pattern")))
    spans = intervals(entries)
    active = (looked.select("pattern", "d").distinct().join(spans, "pattern")
              .where("since <= d and (until is null or d < until)"))
    best = F.max(F.struct(F.length("pattern").alias("n"), "pattern", "category", "since"))
    verdict = looked.join(active, ["pattern", "d"]).groupBy("host", "segment", "d").agg(best.alias("b"))
    return rows.join(verdict, ["host", "segment", "d"], "left").select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("u").alias("url"), F.col("d").alias("day"),
        F.col("b").isNotNull().alias("blocked"), "b.pattern", "b.category", "b.since")


# The given tables hold no dates and no lists; both are derived from pages by
# hashes, so that every host is listed and unlisted over the year 2024.

def _number(c: Column, at: int, modulus: int) -> Column:
    return (F.conv(F.substring(F.md5(c), at, 7), 16, 10).cast("long") % modulus).cast("int")


def fetched(pages: DataFrame) -> DataFrame:
    """Pages with the day of their fetch."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), _number(F.col("url"), 1, 366)).alias("day"))


def list_log(pages: DataFrame) -> DataFrame:
    """A dated list: each host, each host with its first segments, and each
    parent domain is added, removed and (hosts) added again."""
    h, s = host(F.col("url")), segment(F.col("url"))
    own = pages.select(h.alias("host"), s.alias("segment")).where("host is not null").distinct()
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    pats = own.select(F.explode(F.array(
        F.struct(F.col("host").alias("pattern"), F.lit("spam").alias("category"), F.lit(60).alias("last"), F.lit(True).alias("again")),
        F.struct(F.concat("host", F.lit("/"), "segment").alias("pattern"), F.lit("adult").alias("category"), F.lit(90).alias("last"), F.lit(False).alias("again")),
        F.struct(parent.alias("pattern"), F.lit("parked").alias("category"), F.lit(20).alias("last"), F.lit(False).alias("again")),
    )).alias("p")).select("p.*").groupBy("pattern").agg(F.min(F.struct("category", "last", "again")).alias("p")).select("pattern", "p.*")
    first = F.date_add(F.lit("2024-01-01").cast("date"), _number(F.col("pattern"), 8, 300))
    gone = F.date_add(first, F.col("last") + _number(F.col("pattern"), 15, 30))
    log = F.array(F.struct(first.alias("day"), F.lit("add").alias("action")),
                  F.struct(gone.alias("day"), F.lit("remove").alias("action")),
                  F.struct(F.date_add(gone, 45).alias("day"), F.when(F.col("again"), "add").otherwise("remove").alias("action")))
    return pats.select("pattern", "category", F.explode(log).alias("l")).select("pattern", "category", "l.*")


SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + (('0x' || substr(md5(url), 1, 7))::BIGINT % 366)::INT AS day,
    CASE WHEN length(regexp_extract(url, '{url}', 1)) BETWEEN 1 AND 253
         THEN lower(regexp_extract(url, '{url}', 1)) END AS host,
    coalesce(regexp_extract(url, '{url}', 2), '') AS segment FROM pages),
own AS (SELECT DISTINCT host, segment FROM p WHERE host IS NOT NULL),
pats AS (
  SELECT pattern, min({'category': category, 'last': last, 'again': again}) AS p FROM (
    SELECT host AS pattern, 'spam' AS category, 60 AS last, true AS again FROM own
    UNION ALL SELECT host || '/' || segment, 'adult', 90, false FROM own
    UNION ALL SELECT regexp_replace(host, '^[^.]*\.', ''), 'parked', 20, false FROM own) GROUP BY pattern),
dated AS (
  SELECT pattern, p.category AS category, p.again AS again,
    DATE '2024-01-01' + (('0x' || substr(md5(pattern), 8, 7))::BIGINT % 300)::INT AS first,
    DATE '2024-01-01' + (('0x' || substr(md5(pattern), 8, 7))::BIGINT % 300)::INT
      + (p.last + ('0x' || substr(md5(pattern), 15, 7))::BIGINT % 30)::INT AS gone FROM pats),
spans AS (
  SELECT pattern, category, first AS since, gone AS until FROM dated
  UNION ALL SELECT pattern, category, gone + 45, NULL FROM dated WHERE again),
hits AS (
  SELECT page_id, url, p.day, s.*, row_number() OVER (PARTITION BY page_id, url ORDER BY length(s.pattern) DESC, s.pattern DESC,
      s.category DESC, s.since DESC) AS nr
  FROM p JOIN spans s ON s.since <= p.day AND (s.until IS NULL OR p.day < s.until)
   AND (s.pattern = host OR ends_with(host, '.' || s.pattern)
        OR (segment <> '' AND ends_with(s.pattern, '/' || segment)
            AND (s.pattern = host || '/' || segment OR ends_with(host || '/' || segment, '.' || s.pattern)))))
SELECT p.page_id, p.url, p.day, h.pattern IS NOT NULL AS blocked, h.pattern, h.category, h.since
FROM p LEFT JOIN hits h ON h.page_id = p.page_id AND h.url = p.url AND h.nr = 1
""".replace("{url}", _SQL_URL)
