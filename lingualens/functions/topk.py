"""Top-k rows per group that stays balanced when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    out: str = "pos", salt_buckets: int = 64) -> DataFrame:
    """Rows ranked 1..k within each group along ``order`` (a total order).

    Stage one ranks inside (group, salt) buckets -- a hot group is spread
    over ``salt_buckets`` tasks -- and keeps at most k rows per bucket;
    stage two ranks the <= k x buckets survivors of each group.
    """
    group = list(group)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt_buckets))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    stage1 = (df.withColumn("_salt", salt)
              .withColumn("_r1", F.row_number().over(w1))
              .where(F.col("_r1") <= k).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*group).orderBy(*order)
    return stage1.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= k)
