"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns (``assign``, ``access``, ``hex``) are reported wherever they
occur.  Weak candidates say little alone: a long token-like string
(``secret``) or a URL (``endpoint``).  Access identifiers, secrets and
endpoints are interval-joined within scopes (the same text, at most ``SCOPE``
characters between them); a weak candidate is reported only when its
complement is there:

* ``secret``: an access identifier in scope;
* ``endpoint``: an access identifier and a secret (weak or assigned) in scope.

Positions come from the gaps between matches (``split``) and the matches
themselves (``regexp_extract_all``), summed by a window per text and kind.
The interval join is an equi-join on (text, cell of ``SCOPE`` characters):
spans of a kind don't overlap, so a cell holds a bounded number of them.

Texts are known by a 128-bit hash of id and text; equal rows share one scan
of spans and are given back as often as they came.

Defined results: null text is empty; no spans gives zero counts and the hash
of the empty string; positions count code points, ends exclusive; other
columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import bitmap, flagged, stored

SCOPE = 256
KINDS = ("assign", "access", "hex", "secret", "endpoint")
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Only whole runs count, so the run's length can stand in the pattern, and a
# look-behind keeps a failed run from being tried again from each character.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
SECRET = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{32,}"
ENDPOINT = r"""https?://[^\s"'<>]+"""


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def _keys(id_col: str, text_col: str) -> list[Column]:
    t = _text(text_col)
    return [F.xxhash64(F.col(id_col), t).alias("k1"), F.xxhash64(F.lit(1), t, F.col(id_col)).alias("k2")]


def _found(text: Column, kind: str, pattern: str, ok=None, where: Column | None = None) -> Column:
    """Array of (kind, i, gap before the match, its length, length of its value, whether it counts)."""
    lens = lambda a: F.transform(a, F.length)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if kind == "assign" else 0))
    rows = F.arrays_zip(lens(F.split(text, pattern, -1)).alias("gap"),
                        lens(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("len"),
                        lens(value).alias("value"),
                        (F.transform(value, ok) if ok else F.transform(value, lambda v: F.lit(True))).alias("ok"))
    rows = F.filter(F.transform(rows, lambda r, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), r["gap"].alias("gap"), r["len"].alias("len"),
        r["value"].alias("value"), r["ok"].alias("ok"))), lambda r: r["len"].isNotNull())
    hit = text.rlike(pattern)
    return F.when(hit if where is None else where & hit, rows)


#: Letters of both cases and a digit: what a random token has and a word hasn't.
def _token_like(v: Column) -> Column:
    return v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of all kinds, and a row of kind ``text`` for each text with the
    number of equal rows: k1, k2, id, kind, start, end, value (length), reps."""
    text = F.col("t")
    access = text.contains("AKIA")
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,len:int,value:int,ok:boolean>>")
    own = F.array(F.struct(F.lit("text").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"),
                           F.lit(0).alias("len"), F.lit(0).alias("value"), F.lit(True).alias("ok")))
    rows = F.concat(own, *[F.coalesce(x, none) for x in (
        _found(text, "assign", ASSIGN, lambda v: F.length(v) >= 6),
        _found(text, "access", ACCESS),
        _found(text, "hex", HEX),
        _found(text, "secret", SECRET, _token_like, access),
        _found(text, "endpoint", ENDPOINT, None, access))])
    r = (docs.select(F.col(id_col).alias("id"), _text(text_col).alias("t"), *_keys(id_col, text_col))
         .select("k1", "k2", "id", F.explode(rows).alias("r")).select("k1", "k2", "id", "r.*")
         .groupBy("k1", "k2", "id", "kind", "i", "gap", "len", "value", "ok").agg(F.count("*").alias("reps")))
    w = Window.partitionBy("k1", "k2", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("len")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (r.withColumn("end", end).where("ok")
            .select("k1", "k2", "id", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "value", "reps"))


def _cells(df: DataFrame, margin: int) -> DataFrame:
    lo = F.floor(F.greatest(F.lit(0), F.col("start") - margin) / SCOPE)
    return df.withColumn("cell", F.explode(F.sequence(lo, F.floor((F.col("end") + margin) / SCOPE))))


def linked(found: DataFrame) -> DataFrame:
    """Weak candidates whose complement is in scope."""
    weak = _cells(found.where("kind in ('secret', 'endpoint')"), SCOPE)
    part = (_cells(found.where("kind in ('access', 'assign', 'secret')"), 0)
            .select("k1", "k2", "cell", F.col("kind").alias("p"), F.col("start").alias("p_start"), F.col("end").alias("p_end")))
    apart = F.greatest(F.col("p_start") - F.col("end"), F.col("start") - F.col("p_end"))
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return (weak.join(part, ["k1", "k2", "cell"]).where(apart <= SCOPE)
            .groupBy("k1", "k2", "id", "kind", "start", "end", "value", "reps")
            .agg(flag(F.col("p") == "access").alias("access"),
                 flag(F.col("p").isin("assign", "secret")).alias("secret"),
                 flag(F.col("p").isin("access", "assign") & (apart < 0)).alias("covered"))
            .where("access and not covered and (kind = 'secret' or secret)")
            .drop("access", "secret", "covered"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All reported spans, and the rows of kind ``text``."""
    found = stored(candidates(docs, id_col, text_col))
    return found.where("kind not in ('secret', 'endpoint')").unionByName(linked(found))


def _order() -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))


def _joined(rows: str, base: bool) -> Column:
    a = F.filter(rows, lambda s: s["o"] <= 3) if base else F.col(rows)
    return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts of the base kinds, a hash of their spans, all spans."""
    is_span = F.col("kind") != "text"
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    g = (spans(docs, id_col).groupBy("k1", "k2", "id")
         .agg(F.max(F.when(~is_span, F.col("reps"))).alias("reps"), *[count(k) for k in KINDS[:3]],
              F.sort_array(F.collect_list(F.when(is_span, F.struct("start", _order().alias("o"), "end", "kind")))).alias("s")))
    return (g.withColumn("rep", F.explode(F.sequence(F.lit(1), F.col("reps"))))
            .select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex",
                    F.sha2(_joined("s", True), 256).alias("base_sha256"), _joined("s", False).alias("spans")))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "<SECRET>") -> DataFrame:
    """``docs`` with every secret value masked: of an assignment its value, of
    the other kinds the span.  Overlapping values are masked as one."""
    cut = F.when(F.col("kind") == "assign", F.col("end") - F.col("value")).otherwise(F.col("start"))
    own = (spans(docs, id_col, text_col).where("kind not in ('text', 'endpoint')")
           .groupBy(F.col("k1").alias("__h1"), F.col("k2").alias("__h2")).agg(F.sort_array(F.collect_set(F.struct(cut.cast("int").alias("a"), F.col("end").cast("int").alias("b")))).alias("__cuts")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("__text"), acc["at"] + 1, F.greatest(F.lit(0), s["a"] - acc["at"]))
        fresh = s["a"] >= acc["at"]
        return F.struct(F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"),
                        F.greatest(acc["at"], s["b"]).alias("at"))

    own = stored(own)
    k1, k2 = _keys(id_col, text_col)
    marked = flagged(docs.withColumn("__k1", k1).withColumn("__k2", k2), "__k1", bitmap(own, "__h1"), "__hit")
    hit = (marked.where("__hit").withColumn("__text", _text(text_col))
           .join(own, (F.col("__k1") == F.col("__h1")) & (F.col("__k2") == F.col("__h2")), "left"))
    tail = F.aggregate("__cuts", start, step, lambda r: F.concat(r["out"], F.col("__text").substr(r["at"] + 1, F.length("__text"))))
    # The masked text goes where the old one was; other columns may have any name.
    hit = hit.withColumn("__new", F.when(F.col("__cuts").isNotNull(), tail).otherwise(F.col(f"`{text_col}`")))
    old = [F.col(f"`{c}`") for c in docs.columns]
    new = [(F.col("__new") if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns]
    return marked.where("not __hit").select(*old).union(hit.select(*new))


def reference(doc, text: str | None) -> tuple:
    """Plain form of ``digest`` for tests."""
    text = text or ""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rows = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
    rows += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    rows += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    weak = [("secret", *m.span()) for m in re.finditer(SECRET, text)
            if all(re.search(p, m[0]) for p in ("[A-Z]", "[a-z]", "[0-9]"))]
    ends = [("endpoint", *m.span()) for m in re.finditer(r"""https?://[^\x20\t\n\x0b\f\r"'<>]+""", text)]
    near = lambda x, y: max(y[1] - x[2], x[1] - y[2]) <= SCOPE
    over = lambda x, y: max(y[1] - x[2], x[1] - y[2]) < 0
    strong = [r for r in rows if r[0] in ("access", "assign")]
    link = [w for w in weak + ends if any(near(w, r) for r in rows if r[0] == "access") and not any(over(w, r) for r in strong)
            and (w[0] == "secret" or any(near(w, r) for r in weak + [r for r in rows if r[0] == "assign"]))]
    order = lambda r: (r[1], KINDS.index(r[0]))
    say = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(x, key=order))
    return (doc, *[sum(r[0] == k for r in rows) for k in KINDS[:3]],
            hashlib.sha256(say(rows).encode()).hexdigest(), say(rows + link))
