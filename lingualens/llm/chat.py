"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions only.

Services log a conversation again after every turn, so most logged
conversations are prefixes of longer ones.

1. Turns are numbered within their conversation.
2. A rolling hash covers each prefix: the xor of 64-bit hashes of (position,
   role, text), two of them with different seeds.
3. Conversations are grouped by the hash of all their turns; the smallest
   conv_id of a group stands for it.  An anti-join against the proper prefixes
   (grouped first, so a common first turn is one row) keeps the maximal ones.
4. The kept conversations are rendered turn by turn: each row is one turn's
   segment with its place in the rendered conversation, so that a
   conversation of any length is never gathered into one row.

Numbering and rolling run in two levels (cells of ``CELL`` turn numbers, then
inside a cell), so that a conversation with a third of all turns is spread
over many tasks.

Defined results: exactly repeated rows count once; several texts under one
turn number are taken in order of role and text; null turns come first; null
role and text are kept apart from empty ones and rendered empty; rows with a
null conv_id form one conversation; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import stored

CELL = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def segment() -> Column:
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(F.lit(OPEN), empty("role"), F.lit("\n"), empty("text"), F.lit(CLOSE))


def _hash(seed: int) -> Column:
    parts = [F.col("role").isNull(), F.col("text").isNull(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    return F.xxhash64(F.lit(seed), F.col("position"), *(parts if seed % 2 else parts[::-1]))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 1), role, text, n_turns, start (characters
    rendered before), h1 and h2 (hashes of the prefix that ends here)."""
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    t = t.withColumn("cell", F.floor(F.col("turn") / CELL))
    per = t.groupBy("conv_id", "cell").agg(F.count("*").alias("n"))
    cells = Window.partitionBy("conv_id").orderBy(F.col("cell").asc_nulls_first())
    earlier = cells.rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(F.col("conv_id").alias("c"), F.col("cell").alias("l"),
                        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                        F.sum("n").over(Window.partitionBy("conv_id")).alias("n_turns"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("cell").eqNullSafe(F.col("l"))
    inside = Window.partitionBy("conv_id", "cell").orderBy(
        *[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    rows = (t.withColumn("rn", F.row_number().over(inside)).join(before, same)
            .withColumn("position", F.col("before") + F.col("rn")).drop("c", "l", "before", "rn", "turn")
            .withColumn("size", F.length(segment())).withColumn("t1", _hash(1)).withColumn("t2", _hash(2)))
    rows = stored(rows)
    per = rows.groupBy("conv_id", "cell").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"), F.sum("size").alias("s"))
    before = per.select(F.col("conv_id").alias("c"), F.col("cell").alias("l"),
                        *[F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(x) for x in ("x1", "x2")],
                        F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s"))
    inside = Window.partitionBy("conv_id", "cell").orderBy("position")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rolled = rows.select("*", F.bit_xor("t1").over(upto).alias("r1"), F.bit_xor("t2").over(upto).alias("r2"),
                         (F.sum("size").over(upto) - F.col("size")).alias("r"))
    return rolled.join(before, same).select(
        "conv_id", "position", "role", "text", "n_turns", (F.col("s") + F.col("r")).alias("start"),
        F.col("r1").bitwiseXOR(F.col("x1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("x2")).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """Ids (column ``kept``) of the conversations that prefix no longer one."""
    key = ["position", "h1", "h2"]
    whole = (turns.where("position = n_turns").groupBy(*key)
             .agg(F.min(F.struct(F.col("conv_id").alias("kept"))).alias("c")))
    proper = turns.where("position < n_turns").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("c.kept")


def rendered(turns: DataFrame) -> DataFrame:
    """One row per turn of the maximal conversations: its segment, the
    segment's first character in the rendered conversation, and whether a
    model is trained on it (assistant turns)."""
    rows = stored(numbered(turns).withColumn("cell", F.floor(F.col("position") / CELL)))
    kept = maximal(rows.drop("role", "text"))
    return (rows.join(kept, F.col("conv_id").eqNullSafe(F.col("kept")))
            .select("conv_id", "position", "n_turns", "start", segment().alias("segment"),
                    F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("trained")))


SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
n AS (SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS n_turns,
        '{OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{CLOSE.strip()}' || chr(10) AS segment
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
c AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY position) AS l FROM n GROUP BY conv_id),
gone AS (SELECT DISTINCT a.conv_id FROM c a JOIN c b
         ON a.l[1] = b.l[1] AND a.conv_id <> b.conv_id
         WHERE b.l[1:len(a.l)] = a.l AND (len(b.l) > len(a.l) OR b.conv_id < a.conv_id))
SELECT conv_id, position, n_turns,
       coalesce(sum(length(segment)) OVER (PARTITION BY conv_id ORDER BY position
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
       segment, coalesce(role = 'assistant', false) AS trained
FROM n WHERE conv_id NOT IN (SELECT conv_id FROM gone)
"""
