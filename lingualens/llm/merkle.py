"""Document fingerprints from a Merkle tree, in DataFrame functions only.

A text is cut into nested parts that tile it:

* a paragraph is a line with the line breaks behind it;
* a leaf is a sentence of a paragraph with the marks behind it; longer runs
  without a mark are cut every ``LEAF`` characters, so leaves are bounded;
* a section ends with a blank line, and after every paragraph whose hash
  starts with 0 or 1 (one in eight): such cuts depend on the paragraph alone,
  so an edit moves no cut elsewhere.

A node's hash is the MD5 of its parts' hashes, the root is the SHA-256 of the
sections' hashes: equal texts have equal roots, and different texts different
ones.  The fingerprint writes the tree as
``<root>/<section>.<leaf>.<leaf>/<section>.<leaf>``, with 16 digits for a
section and for a leaf, whose last three are its length.

``likeness`` compares two fingerprints alone: 1 for equal roots, else twice
the length of the leaves (each once) that both have over the length of both's
leaves, and below 1.  ``edits`` descends from differing roots through the
sections without a twin to their leaves without one and gives their spans.

``neighbours`` puts beside each document the next one in descending order of
id, without a window over the whole table: ids are cut into ranges at sampled
ids, a window runs inside each range, and the row that starts a range is also
sent to the range before it (the first row of all to the last range).

Defined results: null texts are empty (a root, no sections); null ids come
last; rows that share an id are neighbours, in order of text; every row gives a
row, equal ones too; a single row is its own neighbour; an empty table gives no
rows; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 256
#: Characters of a range; ranges are also at most ``MAX_RANGES``, which bounds the sampled ids on the driver.
RANGE_CHARS = 1 << 22
MAX_RANGES = 1 << 16

_PARAGRAPH = "[^\\n]+\\n*|\\n+"
_LEAF = f"[^.!?\\n]{{1,{LEAF}}}(?:[.!?\\n][.!? \\n]{{0,31}})?|[.!?\\n][.!? \\n]{{0,31}}"
_CODE = r"\.([0-9a-f]{16})"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _node(leaf: Column) -> Column:
    return F.concat(F.md5(leaf.cast("binary")), F.lpad(F.lower(F.hex(F.length(leaf))), 3, "0"))


def _md5(parts: Column) -> Column:
    return F.md5(F.array_join(parts, "").cast("binary"))


def fingerprinted(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of a text column as column ``out``."""
    leaves, nodes, ends, parts = (f"{out}__{k}" for k in ("leaves", "nodes", "ends", "parts"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    code = lambda x: F.concat(F.lit("."), F.substring(x, 1, 13), F.substring(x, 33, 3))
    found = df.withColumn(leaves, F.transform(_all(text, _PARAGRAPH), lambda p: F.struct(
        F.transform(_all(p, _LEAF), _node).alias("n"), F.contains(p, F.lit("\n\n")).alias("blank"))))
    found = found.withColumn(nodes, F.transform(leaves, lambda p: F.struct(
        _md5(p["n"]).alias("h"), F.array_join(F.transform(p["n"], code), "").alias("codes"), p["blank"].alias("blank"))))
    found = found.withColumn(ends, F.filter(F.transform(nodes, lambda p, i: F.when(
        p["blank"] | (F.substring(p["h"], 1, 1) < "2") | (i == F.size(nodes) - 1), i + 1)), lambda e: e.isNotNull()))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(ends), i - 1))
    found = found.withColumn(parts, F.transform(
        F.transform(ends, lambda e, i: F.slice(nodes, before(i) + 1, e - before(i))),
        lambda s: F.struct(_md5(s["h"]).alias("h"), F.array_join(s["codes"], "").alias("codes"))))
    section = lambda s: F.concat(F.lit("/"), F.substring(s["h"], 1, 16), s["codes"])
    root = F.sha2(F.array_join(F.col(parts)["h"], "").cast("binary"), 256)
    found = found.withColumn(out, F.concat(root, F.array_join(F.transform(parts, section), "")))
    return found.drop(leaves, nodes, ends, parts)


def _length(codes: Column) -> Column:
    size = lambda acc, c: acc + F.conv(F.substring(c, 14, 3), 16, 10).cast("long")
    return F.aggregate(codes, F.lit(0).cast("long"), size)


def compared(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``df`` with the likeness of two fingerprint columns as column ``out``."""
    one, other, la, lb, shared = (f"{out}__{k}" for k in ("a", "b", "la", "lb", "s"))
    df = (df.withColumn(one, F.array_distinct(_all(F.col(a), _CODE, 1)))
          .withColumn(other, F.array_distinct(_all(F.col(b), _CODE, 1))))
    df = (df.withColumn(la, _length(F.col(one))).withColumn(lb, _length(F.col(other)))
          .withColumn(shared, _length(F.array_intersect(one, other))))
    both = F.col(la) + F.col(lb)
    near = F.when(both == 0, 0.0).otherwise(F.least(2 * F.col(shared), both - 1) / both)
    same = F.substring(a, 1, 64) == F.substring(b, 1, 64)
    return df.withColumn(out, F.when(same, 1.0).otherwise(near).cast("double")).drop(one, other, la, lb, shared)


def edits(pairs: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """Where the texts of two columns differ: id, side (``a`` or ``b``), start,
    length of each leaf that the other text doesn't have.

    Branches with equal hashes are left at the highest node: rows with equal
    roots at once, then sections with a twin, then leaves with one.  Rows are
    told apart by their id; spans count code points.
    """
    t = pairs.select(F.col(id_col).alias("id"), F.col(a).alias("ta"), F.col(b).alias("tb"))
    t = fingerprinted(fingerprinted(t, "ta", "a"), "tb", "b").select("id", "a", "b")
    t = t.where(F.substring("a", 1, 64) != F.substring("b", 1, 64))
    sections = lambda c: F.slice(F.split(F.col(c), "/"), 2, (1 << 31) - 1)
    out = None
    for side, own, other in (("a", "a", "b"), ("b", "b", "a")):
        s = t.select("id", F.col(other).alias("whole"),
                     F.array_except(sections(own), sections(other)).alias("apart"),
                     F.array_distinct(_all(F.col(other), _CODE, 1)).alias("theirs"), F.posexplode(sections(own)))
        s = s.withColumn("codes", F.slice(F.split("col", r"\."), 2, (1 << 31) - 1)).withColumn("size", _length(F.col("codes")))
        upto = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        s = s.withColumn("at", F.coalesce(F.sum("size").over(upto), F.lit(0)))
        # Only sections without a twin are opened.
        s = s.where(F.array_contains("apart", F.col("col")))
        s = s.select("id", "pos", "at", F.array_except("codes", "theirs").alias("odd"), F.posexplode("codes").alias("leaf", "code"))
        size = F.conv(F.substring("code", 14, 3), 16, 10).cast("long")
        inside = Window.partitionBy("id", "pos").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
        s = s.select("id", "odd", "code", size.alias("length"),
                     (F.col("at") + F.coalesce(F.sum(size).over(inside), F.lit(0))).alias("start"))
        s = (s.where(F.array_contains("odd", F.col("code")))
             .select(F.col("id").alias(id_col), F.lit(side).alias("side"), "start", "length"))
        out = s if out is None else out.unionByName(s)
    return out


def _splitters(docs: DataFrame, id_col: str, text_col: str, range_chars: int) -> tuple[list[int], int]:
    """Ids at which ranges start, descending, and the largest id."""
    total = docs.agg(F.count(id_col).alias("n"), F.max(id_col).alias("top"), F.sum(F.length(text_col)).alias("chars")).first()
    ranges = min(MAX_RANGES, (total.chars or 0) // range_chars + 1)
    if not total.n or ranges == 1:
        return [], total.top
    # A sample by hash, the same whenever it is taken: about eight ids a range.
    share = max(1, total.n // (8 * ranges))
    ids = docs.select(F.col(id_col).cast("long").alias("i")).where(F.pmod(F.xxhash64("i"), F.lit(share)) == 0).where("i is not null")
    ids = sorted((r.i for r in ids.distinct().collect()), reverse=True)
    step = max(1, len(ids) // ranges)
    return ids[step - 1::step], total.top


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "next",
               carried: tuple[str, ...] = (), range_chars: int = RANGE_CHARS) -> DataFrame:
    """id, text and the ``carried`` columns of each document, and those of the
    next one in descending order of id as struct ``name``."""
    cuts, top = _splitters(docs, id_col, text_col, range_chars)
    d = docs.select(id_col, text_col, *carried)
    i = F.col(id_col).cast("long")
    if cuts:
        # Number of cuts at or above the id, by binary search; null ids are in the last range.
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
        held = F.array(*[F.lit(c) for c in cuts]) if len(cuts) < 64 else F.expr("array(" + ",".join(f"{c}L" for c in cuts) + ")")
        at = F.aggregate(steps, F.lit(0), lambda acc, s: F.when(F.get(held, acc + s - 1) >= i, acc + s).otherwise(acc))
        d = d.withColumn("__range", F.when(i.isNull(), F.lit(len(cuts))).otherwise(at))
        starts = (F.col("__range") > 0) & F.coalesce(F.get(held, F.col("__range") - 1) == i, F.lit(False))
    else:
        d, starts = d.withColumn("__range", F.lit(0)), F.lit(False)
    # 0: the row itself; 1: a guest from the range after, 2: the first row after the last.
    first = i.eqNullSafe(F.lit(top).cast("long"))
    copies = F.array(F.struct(F.col("__range").alias("range"), F.lit(0).alias("guest")),
                     F.when(starts, F.struct((F.col("__range") - 1).alias("range"), F.lit(1).alias("guest"))),
                     F.when(first, F.struct(F.lit(len(cuts)).alias("range"), F.lit(2).alias("guest"))))
    d = d.withColumn("__copy", F.explode(F.filter(copies, lambda c: c.isNotNull()))).select(
        id_col, text_col, *carried, F.col("__copy.range").alias("__range"), F.col("__copy.guest").alias("__guest"))
    order = Window.partitionBy("__range").orderBy("__guest", F.col(id_col).desc_nulls_last(), F.col(text_col).asc_nulls_first())
    d = d.withColumn(name, F.lead(F.struct(id_col, text_col, *carried)).over(order))
    return d.where("__guest = 0").drop("__range", "__guest")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_chars: int = RANGE_CHARS) -> DataFrame:
    """Each document's fingerprint, that of its text with the latter half
    replaced by the next document's beginning, and how near it is to both."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = neighbours(fingerprinted(d, "text", "fingerprint"), carried=("fingerprint",), range_chars=range_chars)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint",
                 F.col("next.fingerprint").alias("next_fingerprint"))
    d = d.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    d = fingerprinted(d, "edited", "edited_fingerprint").drop("edited")
    d = compared(d, "fingerprint", "edited_fingerprint", "near_edited")
    d = compared(d, "fingerprint", "next_fingerprint", "near_next")
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _tree_sql(text: str) -> str:
    """DuckDB expression of the fingerprint of a text expression."""
    paragraph, leaf = _PARAGRAPH.replace("\\n", "\n"), _LEAF.replace("\\n", "\n")
    nodes = (f"list_transform(list_transform(regexp_extract_all({text}, '{paragraph}'), lambda p: {{"
             f"'n': list_transform(regexp_extract_all(p, '{leaf}'), lambda l: md5(l) || lpad(lower(to_hex(length(l))), 3, '0')), "
             f"'blank': contains(p, '\n\n')}}), "
             f"lambda p: {{'h': md5(array_to_string(p.n, '')), 'blank': p.blank, 'codes': "
             f"array_to_string(list_transform(p.n, lambda x: '.' || x[1:13] || x[33:35]), '')}})")
    return nodes


def _sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nt,
             coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS nd
      FROM d WINDOW w AS (ORDER BY doc_id DESC, text)),
x AS (SELECT doc_id, nd, length(text) AS n, text,
             substr(text, 1, length(text) - length(text) // 2) || substr(nt, 1, length(text) // 2) AS edited FROM e),
u AS (SELECT doc_id, 0 AS k, text AS t FROM x UNION ALL SELECT doc_id, 1, edited FROM x),
v AS (SELECT doc_id, k, {_tree_sql('t')} AS nodes FROM u),
s AS (SELECT *, list_filter(list_transform(nodes, lambda p, i: CASE WHEN p.blank OR p.h[1:1] < '2' OR i = len(nodes) THEN i END),
                            lambda z: z IS NOT NULL) AS ends FROM v),
p AS (SELECT doc_id, k, list_transform(list_transform(ends, lambda z, i: nodes[CASE WHEN i = 1 THEN 1 ELSE ends[i - 1] + 1 END:z]),
             lambda q: {{'h': md5(array_to_string(list_transform(q, lambda r: r.h), '')),
                         'codes': array_to_string(list_transform(q, lambda r: r.codes), '')}}) AS parts FROM s),
f AS (SELECT doc_id, k, sha256(coalesce(array_to_string(list_transform(parts, lambda q: q.h), ''), '')) ||
             coalesce(array_to_string(list_transform(parts, lambda q: '/' || q.h[1:16] || q.codes), ''), '') AS fp FROM p),
g AS (SELECT doc_id, k, fp, list_distinct(regexp_extract_all(fp, '{_CODE}', 1)) AS c FROM f),
z AS (SELECT x.doc_id, x.n, x.edited, a.fp AS fa, b.fp AS fb, c.fp AS fc, a.c AS ca, b.c AS cb, c.c AS cc
      FROM x JOIN g a ON a.doc_id = x.doc_id AND a.k = 0 JOIN g b ON b.doc_id = x.doc_id AND b.k = 1
             JOIN g c ON c.doc_id = x.nd AND c.k = 0),
y AS (SELECT *, {_size_sql('ca')} AS la, {_size_sql('cb')} AS lb, {_size_sql('cc')} AS lc,
             {_size_sql('list_intersect(ca, cb)')} AS sb, {_size_sql('list_intersect(ca, cc)')} AS sc FROM z)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
       CASE WHEN fa[1:64] = fb[1:64] THEN 1.0 WHEN la + lb = 0 THEN 0.0
            ELSE least(2 * sb, la + lb - 1)::DOUBLE / (la + lb) END AS near_edited,
       CASE WHEN fa[1:64] = fc[1:64] THEN 1.0 WHEN la + lc = 0 THEN 0.0
            ELSE least(2 * sc, la + lc - 1)::DOUBLE / (la + lc) END AS near_next
FROM y"""


def _size_sql(codes: str) -> str:
    return f"coalesce(list_sum(list_transform({codes}, lambda c: ('0x' || c[14:16])::BIGINT)), 0)"


#: The same rows for a table of distinct ids.
SQL = _sql()
