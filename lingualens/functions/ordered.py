"""Order-dependent operators without a single-partition window, all lazy.

A window with ``orderBy`` but no ``partitionBy`` (global rank, running max,
running sum) makes Spark move the whole table into one task.  These helpers
compute the same values as a distributed *scan*:

1. a sketch of the order's key: the key of smallest hash in each of
   ``buckets`` hash slots, sorted.  It depends on the rows alone, not on how
   they are partitioned, and is one row of at most ``buckets`` keys;
2. a row's bucket is the number of sketched keys up to its own (binary search);
3. each bucket is aggregated (at most ``buckets`` + 1 rows a group);
4. an exclusive prefix over the buckets gives each bucket its carry;
5. a window inside each bucket plus the carry gives the row's value.

Nothing runs while a plan is built.  A hot group (a third of all rows in one
``partition_by`` value) is cut by the order's key into many buckets.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SLICE = "_slice"
BUCKETS = 256


@dataclass(frozen=True)
class Key:
    """One column of an order: ascending with nulls first unless said otherwise."""

    value: Column
    descending: bool = False
    nulls_last: bool = False

    def sort(self) -> Column:
        if self.descending:
            return self.value.desc_nulls_last() if self.nulls_last else self.value.desc_nulls_first()
        return self.value.asc_nulls_last() if self.nulls_last else self.value.asc_nulls_first()


def desc(col: Column | str) -> Key:
    """Descending, nulls last."""
    return Key(F.col(col) if isinstance(col, str) else col, True, True)


_SORTED = re.compile(r"Column<'(.+) (ASC|DESC) NULLS (FIRST|LAST)'>")


def _as_keys(order: Sequence[Key | Column | str]) -> list[Key]:
    """``order`` as keys.  A sort column (``F.col("v").desc()``) is taken if it
    is of a plain column; give a ``Key`` for an expression."""
    keys = []
    for c in order:
        found = None if isinstance(c, Key | str) else _SORTED.fullmatch(str(c))
        if isinstance(c, Key):
            keys.append(c)
        elif found:
            if not re.fullmatch(r"\w+", found[1]):
                raise ValueError(f"give a Key for the order {c}")
            keys.append(Key(F.col(found[1]), found[2] == "DESC", found[3] == "LAST"))
        else:
            keys.append(Key(F.col(c) if isinstance(c, str) else c))
    return keys


def _as_cols(order: Sequence[Key | Column | str]) -> list[Column]:
    return [k.sort() for k in _as_keys(order)]


def _order_key(df: DataFrame, order: Sequence[Key | Column | str]) -> Column:
    """A struct that compares, ascending, as ``order`` does.

    Descending values are mirrored; a descending text has no mirror, so the key
    ends before it, and rows that differ only from there on share a bucket.
    """
    fields: list[Column] = []
    for key in _as_keys(order):
        value = key.value
        kind = df.select(value).schema[0].dataType
        rank_of_null = F.when(value.isNull(), 1 if key.nulls_last else -1).otherwise(0)
        if not key.descending:
            fields += [rank_of_null, value]
        elif isinstance(kind, T.IntegralType):
            fields += [rank_of_null, F.bitwise_not(value)]
        elif isinstance(kind, T.DateType):
            fields += [rank_of_null, F.bitwise_not(F.unix_date(value))]
        elif isinstance(kind, T.FloatType | T.DoubleType):
            fields += [rank_of_null, ~F.isnan(value), -value]
        elif isinstance(kind, T.BooleanType):
            fields += [rank_of_null, ~value]
        else:
            break
    return F.struct(*[f.alias(f"k{i}") for i, f in enumerate(fields or [F.lit(0)])])


def bucketed(df: DataFrame, order: Sequence[Key | Column | str], out: str = _SLICE, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with the number of its bucket along ``order``: rows of a lower
    bucket come before rows of a higher one."""
    keyed = df.withColumn("_key", _order_key(df, order))
    drawn = keyed.select("_key").groupBy(F.pmod(F.xxhash64("_key"), F.lit(buckets)).alias("_slot")).agg(
        F.min(F.struct(F.xxhash64(F.lit(1), F.col("_key")).alias("h"), F.col("_key").alias("k"))).alias("m"))
    cuts = drawn.agg(F.array_sort(F.collect_list("m.k")).alias("_cuts"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(buckets.bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda acc, s: F.when(F.get(F.col("_cuts"), acc + s - 1) <= F.col("_key"), acc + s).otherwise(acc))
    # One row, in the same plan (a scalar subquery would run the input again).
    return keyed.join(F.broadcast(cuts), how="cross").withColumn(out, below).drop("_cuts", "_key")


def _held(df: DataFrame) -> DataFrame:
    """``df`` behind one exchange of whole rows, which its uses share.

    Each use reads other columns; rows packed into one column aren't pruned, so
    the exchanges are equal, and the plan below runs once for all of them.
    """
    rows = df.select(F.array(F.struct(*df.columns)).alias("_row")).repartition("_row")
    return rows.select(*[F.col("_row")[0][c].alias(c) for c in df.columns])


def running(df: DataFrame, order: Sequence[Key | Column | str], value: Column, how: str,
            out: str, partition_by: Sequence[str] = (), inclusive: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """Running ``max`` or ``sum`` of ``value`` along ``order``, per group.

    ``inclusive`` includes the current row (``rows unboundedPreceding..0``);
    otherwise the frame ends at the previous row.  ``order`` must be a total
    order within each group (add a unique tie-breaker).
    """
    if how not in ("max", "sum"):
        raise ValueError(how)
    agg = F.max if how == "max" else F.sum
    groups = list(partition_by)
    s = bucketed(_held(df.withColumn("_v", value)), order, buckets=buckets)

    # Per-bucket summaries and the carry from all earlier buckets of the group.
    summary = s.groupBy(_SLICE, *groups).agg(agg("_v").alias("_blk"))
    before = Window.partitionBy(*groups).orderBy(_SLICE).rowsBetween(
        Window.unboundedPreceding, -1)
    carry = summary.select(F.col(_SLICE).alias("_at"), *[F.col(g).alias(f"_of_{g}") for g in groups],
                           agg("_blk").over(before).alias("_carry"))
    same = F.col(_SLICE) == F.col("_at")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    if not groups:
        # One row per bucket: at most buckets + 1.
        carry = F.broadcast(carry)

    end = 0 if inclusive else -1
    inside = Window.partitionBy(_SLICE, *groups).orderBy(*_as_cols(order)).rowsBetween(
        Window.unboundedPreceding, end)
    joined = s.withColumn("_local", agg("_v").over(inside)).join(carry, same, "left")
    if how == "max":
        combined = F.greatest(F.col("_carry"), F.col("_local"))
    else:
        combined = (F.when(F.col("_carry").isNull() & F.col("_local").isNull(), F.lit(None))
                    .otherwise(F.coalesce(F.col("_carry"), F.lit(0))
                               + F.coalesce(F.col("_local"), F.lit(0))))
    return joined.withColumn(out, combined).drop("_v", "_local", "_carry", _SLICE, "_at", *[f"_of_{g}" for g in groups])


def nested_rank(df: DataFrame, group: Sequence[str], coarse: Sequence[str],
                fine: Sequence[Key | Column | str], out: str = "rank") -> DataFrame:
    """``row_number()`` per ``group`` along ``coarse`` then ``fine``, for a
    group too large for one task but whose (group, coarse) cells are small.

    Rows per cell are counted (an aggregate), each cell's offset is the
    running count of the cells before it in its group (a window at cell
    grain), and rows are numbered inside their cell (a window per cell).
    No global sort and no checkpoint are needed.
    """
    group, coarse = list(group), list(coarse)
    cell = [*group, *coarse]
    counts = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*group).orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*cell, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*cell).orderBy(*_as_cols(fine))
    numbered = df.withColumn("_rn", F.row_number().over(inside))
    return (numbered.join(offsets, cell)
            .withColumn(out, (F.col("_off") + F.col("_rn")))
            .drop("_off", "_rn"))


def global_rank(df: DataFrame, order: Sequence[Key | Column | str], out: str = "rank",
                partition_by: Sequence[str] = ()) -> DataFrame:
    """``row_number()`` over a total order (per group), computed distributed."""
    return running(df, order, F.lit(1).cast("long"), "sum", out, partition_by)
