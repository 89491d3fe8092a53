"""Bootstrap confidence intervals of group means.

The percentile interval of B = 1000 resampled means, as a Poisson bootstrap:

* Samples are reduced to a (group, score) -> count histogram, map-side
  combined, so a hot group is never moved as raw rows.
* Each bin gets one Poisson(count) weight per replicate -- the sum of
  ``count`` Poisson(1) weights, one per sample of the bin.
* The uniforms behind the weights are a 32-bit counter hash of (bin,
  replicate), seeded by md5 of the bin: independent of partitioning, and
  simple enough for SQL, which the oracle uses to draw the same weights.
* A group's bins are spread over tasks by a hash of the score; each task
  sums its weights per replicate (numpy, vectorised).  A group that one task
  has whole gets its percentiles there, so its sums never cross the network;
  of a larger one a second stage adds the partial sums first.

``hashed_resample_ci`` draws every index of a resample by md5 instead; its work
is rows x replicates, so it serves as a cross-check with few replicates.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.ordered import nested_rank

# The grouped numpy code below runs in Python workers, which need not have
# this package installed: ship these functions by value, not by module name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values: multipliers of the 32-bit finaliser and the counter step
FMIX = (2246822507, 3266489909)
STEP = 2654435769
# Normal quantile: rational approximation (Acklam), numerators and denominators
# of the middle and of the tails, whose share of a side is TAIL.
MIDDLE = ((-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01,
           2.506628277459239e+00),
          (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0))
TAILS = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00,
          2.938163982698783e+00),
         (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0))
TAIL = 0.02425
# ---------------------------------------------------------------------------
#: Distinct scores of a group that one task draws for.
BINS_PER_SALT = 2000
#: From this count on, weights come from the quantile's expansion instead of a
#: table (which has 24 * sqrt(count) entries: some 6000 at most).
EXPANDED_FROM = 1 << 16
#: Leading bits of a hash by which most weights are looked up.
GUIDE_BITS = 12
#: Tables that a task keeps for its next bins.
KEPT_TABLES = 256
#: Bins that are drawn at once: their hashes fit a core's cache.
DRAWN_AT_ONCE = 64


def bin_seed(group: Column, score: Column, seed: int) -> Column:
    """First 32 bits of md5 of the bin: group, score (in 1e-9 units), seed."""
    key = F.concat_ws("|", group, F.round(score * 1e9).cast("bigint").cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def _fmix(x: np.ndarray) -> np.ndarray:
    """32-bit finaliser, in place: products of 32-bit numbers wrap."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(FMIX[0])
    x ^= x >> np.uint32(13)
    x *= np.uint32(FMIX[1])
    x ^= x >> np.uint32(16)
    return x


def _hashes(seeds: np.ndarray, replicates: int) -> np.ndarray:
    """(bins x replicates) 32-bit hashes."""
    reps = np.arange(1, replicates + 1, dtype=np.uint32) * np.uint32(STEP)
    return _fmix(_fmix(seeds.astype(np.uint32))[:, None] ^ reps[None, :])


def _uniforms(hashes: np.ndarray) -> np.ndarray:
    """Uniforms in (0, 1) of 32-bit hashes."""
    return (hashes.astype(np.float64) + 0.5) / 4294967296.0


def poisson_cdf(c: int) -> tuple[int, np.ndarray]:
    """First value and CDF table of Poisson(c), c +- 12 sd."""
    sd = math.sqrt(c)
    lo = max(0, int(c - 12 * sd - 10))
    ks = np.arange(lo, int(c + 12 * sd + 10) + 1)
    logp = np.concatenate([[0.0], np.cumsum(math.log(c) - np.log(ks[1:].astype(np.float64)))])
    cdf = np.cumsum(np.exp(logp - logp.max()))
    return lo, cdf / cdf[-1]


def normal_quantile(u: np.ndarray) -> np.ndarray:
    """Quantile of the standard normal distribution, to nine digits."""
    q = u - 0.5
    middle = q * np.polyval(MIDDLE[0], q * q) / np.polyval(MIDDLE[1], q * q)
    r = np.sqrt(-2 * np.log(np.minimum(u, 1 - u)))
    tails = np.polyval(TAILS[0], r) / np.polyval(TAILS[1], r)
    return np.where(np.minimum(u, 1 - u) >= TAIL, middle, np.where(q < 0, tails, -tails))


def poisson_expanded(c: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Quantile of Poisson(c) for large c, by its expansion in the normal
    quantile: the same work for any c.  From ``EXPANDED_FROM`` on it is the
    exact quantile but for uniforms within some thousandths of a step's edge."""
    z = normal_quantile(u)
    return np.ceil(c + np.sqrt(c) * z + (z * z - 1) / 6 + (z - z ** 3) / (72 * np.sqrt(c)) - 0.5)


def _drawn(c: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Poisson(c) by the hash of a uniform: the first value, the first hash of
    each later one, and the weight that all hashes of the same leading
    ``GUIDE_BITS`` bits have, -1 where they differ."""
    lo, cdf = poisson_cdf(c)
    edge = cdf * 4294967296.0  # a power of two: exact, as is its fraction
    first = (np.floor(edge) + (edge - np.floor(edge) >= 0.5)).astype(np.int64)
    rest, size = 32 - GUIDE_BITS, (1 << GUIDE_BITS) + 1
    # Values passed by the least and the greatest hash of these bits.
    least = np.cumsum(np.bincount((first + (1 << rest) - 1) >> rest, minlength=size))[:size - 1]
    most = np.cumsum(np.bincount(first >> rest, minlength=size))[:size - 1]
    return lo, first, np.where(least == most, lo + least, -1).astype(np.float64)


def _weights(counts: np.ndarray, seeds: np.ndarray, replicates: int, tables: dict | None = None) -> np.ndarray:
    """(bins x replicates) Poisson weights; ``tables`` keeps those of counts drawn before."""
    large = counts >= EXPANDED_FROM
    w = np.empty((len(counts), replicates))
    if large.any():
        w[large] = poisson_expanded(counts[large, None].astype(np.float64), _uniforms(_hashes(seeds[large], replicates)))
        if not large.all():
            w[~large] = _weights(counts[~large], seeds[~large], replicates, tables)
        return w
    tables = {} if tables is None else tables
    distinct, own = np.unique(counts, return_inverse=True)  # one table per distinct bin count
    if len(tables) > KEPT_TABLES:
        tables.clear()
    for c in distinct.tolist():
        if c not in tables:
            tables[c] = _drawn(c)
    held = [tables[c] for c in distinct.tolist()]
    guides = np.concatenate([guide for _, _, guide in held])
    # All tables, one behind the other, for the weights that the guides leave open.
    behind = np.cumsum([0] + [len(first) for _, first, _ in held])[:-1]
    edges = np.concatenate([first + (i << 33) for i, (_, first, _) in enumerate(held)])
    least = np.array([lo for lo, _, _ in held]) - behind
    for a in range(0, len(counts), DRAWN_AT_ONCE):
        of = own[a:a + DRAWN_AT_ONCE]
        h = _hashes(seeds[a:a + DRAWN_AT_ONCE], replicates)
        at = (h >> np.uint32(32 - GUIDE_BITS)).astype(np.intp)
        at += (of << GUIDE_BITS)[:, None]
        drawn = guides.take(at, out=w[a:a + DRAWN_AT_ONCE], mode="clip").reshape(-1)  # all are inside: clip saves a copy
        left = np.flatnonzero(drawn < 0)
        table = of[left // replicates]
        drawn[left] = np.searchsorted(edges, h.reshape(-1)[left].astype(np.int64) + (table.astype(np.int64) << 33), "right") + least[table]
    return w


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _sums(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of adjacent rows, whole rows at a time."""
    return np.stack([np.add.reduce(w[a:b], axis=0) for a, b in zip(first, [*first[1:], len(w)])])


def _bounds(sw: np.ndarray, swx: np.ndarray, lo_q: float, hi_q: float) -> tuple[list, list]:
    """Percentiles of the replicate means, a row of sums a group."""
    with np.errstate(invalid="ignore", divide="ignore"):
        means = np.sort(np.where(sw > 0, swx / sw, np.nan), axis=1)  # no mean sorts last
    size = (~np.isnan(means)).sum(1)
    out = []
    for q in (lo_q, hi_q):
        at = np.maximum(size - 1, 0) * q
        below = np.floor(at).astype(np.intp)
        a, b = (np.take_along_axis(means, i[:, None], 1)[:, 0] for i in (below, np.minimum(below + 1, np.maximum(size - 1, 0))))
        t = at - below
        found = np.where(t < 0.5, a + (b - a) * t, b - (b - a) * (1 - t)).astype(object)
        found[size == 0] = None
        out.append(found.tolist())
    return out[0], out[1]


def _group_sums(replicates: int, lo_q: float, hi_q: float, chunk: int = 512, block: int = 125):
    """Weight sums and weighted score sums per replicate of each group's bins
    in a task (they are adjacent): the percentiles of a group that is whole
    (``fan`` 1), the sums of another, ``block`` replicates a row."""
    names = ["grp", "lo", "hi", "block", "sw", "swx"]
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]

    def done(grp, fan, sw, swx):
        out = [[] for _ in names]
        whole = fan == 1
        lo, hi = _bounds(sw[whole], swx[whole], lo_q, hi_q)
        n = len(lo)
        for held, new in zip(out, (grp[whole].tolist(), lo, hi, [None] * n, [None] * n, [None] * n)):
            held.extend(new)
        for i in np.flatnonzero(~whole):
            for at in range(0, replicates, block):
                row = (grp[i], None, None, at // block, sw[i, at:at + block].tobytes(), swx[i, at:at + block].tobytes())
                for held, new in zip(out, row):
                    held.append(new)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    def fn(batches):
        held = None  # the last group, which may go on
        tables = {}
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
            for a in range(0, batch.num_rows, chunk):
                grp, score, n, seed, fan = (c[a:a + chunk] for c in columns)
                w = _weights(n.astype(np.int64), seed.astype(np.int64), replicates, tables)
                first = _runs(grp)
                sw = _sums(w, first)
                w *= score.astype(np.float64)[:, None]
                swx = _sums(w, first)
                grp, fan = grp[first], fan[first]
                if held is not None and held[0][0] == grp[0]:
                    sw[0] += held[2][0]
                    swx[0] += held[3][0]
                elif held is not None:
                    yield done(*held)
                if len(grp) > 1:
                    yield done(grp[:-1], fan[:-1], sw[:-1], swx[:-1])
                held = grp[-1:], fan[-1:], sw[-1:].copy(), swx[-1:].copy()
        if held is not None:
            yield done(*held)
    return fn


def _finished(lo_q: float, hi_q: float):
    """Percentiles of all groups: as they are, or from sums that are spread
    over rows, which lie together by group and block."""
    def result(grp, parts):
        lo, hi = _bounds(np.concatenate([p[1] for p in parts])[None, :], np.concatenate([p[2] for p in parts])[None, :], lo_q, hi_q)
        return pa.RecordBatch.from_arrays([pa.array([grp], pa.string()), pa.array(lo, pa.float64()), pa.array(hi, pa.float64())],
                                          names=["grp", "lo", "hi"])

    def fn(batches):
        held, parts = None, []
        for batch in batches:
            whole = pc.is_null(batch.column(3))
            if pc.any(whole).as_py():
                yield batch.select(["grp", "lo", "hi"]).filter(whole)
            batch = batch.filter(pc.invert(whole))
            for g, at, a, b in zip(*(batch.column(c).to_pylist() for c in (0, 3, 4, 5))):
                a, b = np.frombuffer(a, np.float64), np.frombuffer(b, np.float64)
                if parts and g == held and parts[-1][0] == at:
                    parts[-1] = at, parts[-1][1] + a, parts[-1][2] + b
                    continue
                if parts and g != held:
                    yield result(held, parts)
                    parts = []
                held = g
                parts.append((at, a, b))
        if parts:
            yield result(held, parts)
    return fn


def poisson_bootstrap_ci(samples: DataFrame, group: str,
                         replicates: int = K.BOOTSTRAP_REPLICATES,
                         level: float = K.BOOTSTRAP_LEVEL, seed: int = K.BOOTSTRAP_SEED,
                         prefix: str = "", bins_per_salt: int = BINS_PER_SALT) -> DataFrame:
    """Percentile CI of the mean per group with B replicates.

    A sample with a count ``n`` stands for that many.  A replicate whose
    weights are all zero (tiny groups) has no mean and is ignored.
    """
    lo_q, hi_q = (1 - level) / 2, (1 + level) / 2
    count = F.sum("n") if "n" in samples.columns else F.count(F.lit(1))
    hist = (samples.where(F.col("score").isNotNull())
            .groupBy(F.col(group).cast("string").alias("grp"), "score").agg(count.alias("n")))
    # Every bin has samples; to say so reads ``n``, so both uses are of the same
    # columns and share one exchange, and the samples are counted once.
    fan = hist.groupBy("grp").agg(F.ceil(F.count_if(F.col("n") > 0) / bins_per_salt).alias("_fan"))
    # Bins are few bytes and much work: a given number of tasks isn't coalesced by size.
    spark = samples.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    bins = (hist.join(fan, "grp")
            .withColumn("_salt", F.pmod(F.xxhash64("score"), F.col("_fan")))
            .withColumn("seed", bin_seed(F.col("grp"), F.col("score"), seed))
            .repartition(tasks, "grp", "_salt").sortWithinPartitions("grp", "_salt"))
    sums = bins.select("grp", "score", "n", "seed", "_fan").mapInArrow(
        _group_sums(replicates, lo_q, hi_q), "grp string, lo double, hi double, block int, sw binary, swx binary")
    # One pass over the bins: a whole group's row has its percentiles, and is
    # dealt like the sums of the others, which only then are added up.
    dealt = sums.repartition("grp").sortWithinPartitions("grp", "block")
    ci = dealt.mapInArrow(_finished(lo_q, hi_q), "grp string, lo double, hi double")
    return ci.select(F.col("grp").alias(group), F.col("lo").alias(f"{prefix}ci_lower"),
                     F.col("hi").alias(f"{prefix}ci_upper"))


def metric_intervals(detailed: DataFrame, group: str, metrics: Sequence[str] = K.AVERAGED_METRICS,
                     **kw) -> DataFrame:
    """CIs per group and metric plus the pooled ``average`` (H14, H15), long
    form; of samples or of a cube (with counts ``n``)."""
    d = detailed.withColumn("task_metric", F.concat_ws("_", "task", "metric"))
    d = d.where(F.col("task_metric").isin(list(metrics)))
    cell = F.array(F.struct(F.concat_ws("\u0001", F.col(group), F.col("task_metric")).alias("g")),
                   F.struct(F.concat_ws("\u0001", F.col(group), F.lit("average")).alias("g")))
    held = ["score", "n"] if "n" in d.columns else ["score"]
    ci = poisson_bootstrap_ci(d.select(*held, F.explode(cell).alias("_c")).select(*held, F.col("_c.g").alias("_g")), "_g", **kw)
    parts = F.split(F.col("_g"), "\u0001")
    return ci.select(parts[0].alias(group), parts[1].alias("metric"), "ci_lower", "ci_upper")


def wide_intervals(ci_long: DataFrame, group: str, metrics: Sequence[str] = K.AVERAGED_METRICS) -> DataFrame:
    """Interval columns per metric and for the average, one row per group."""
    cols = []
    for m in [*metrics, "average"]:
        cols += [F.max(F.when(F.col("metric") == m, F.col("ci_lower"))).alias(f"{m}_ci_lower"),
                 F.max(F.when(F.col("metric") == m, F.col("ci_upper"))).alias(f"{m}_ci_upper")]
    return ci_long.groupBy(group).agg(*cols)


# ------------------------------------------------- resampling by index

def _interval(df: DataFrame, group: str, value: str, level: float, prefix: str) -> DataFrame:
    lo, hi = (1 - level) / 2, (1 + level) / 2
    p = F.percentile(F.col(value), F.array(F.lit(lo), F.lit(hi)))
    return (df.groupBy(group).agg(p.alias("_p"))
            .select(group, F.col("_p")[0].alias(f"{prefix}ci_lower"),
                    F.col("_p")[1].alias(f"{prefix}ci_upper")))


def hash_index(key: Column, n: Column) -> Column:
    """First 32 bits of ``md5(key)`` modulo ``n``."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), n)


def hashed_resample_ci(samples: DataFrame, group: str, order: Sequence[str],
                       replicates: int = 10, level: float = K.BOOTSTRAP_LEVEL,
                       prefix: str = "") -> DataFrame:
    """Percentile CI of the mean per group from md5-drawn resamples.

    Samples are numbered 0..n-1 per group along ``order``; resample ``rep``
    fills slot ``i`` with sample ``md5(group|rep|i) mod n``.
    """
    s = samples.select(group, "score", *order)
    # Numbering per group: cells (group, first order column) are small, so
    # the nested rank needs no global sort even for a hot group.
    numbered = nested_rank(s, [group], [order[0]], list(order[1:]) or [order[0]], out="_idx")
    numbered = numbered.select(group, "score", (F.col("_idx") - 1).cast("bigint").alias("_idx"))
    sizes = s.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    rep = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_rep")
    key = F.concat_ws("|", F.col(group).cast("string"), F.col("_rep").cast("string"),
                      F.col("_idx").cast("string"))
    draws = (numbered.select(group, "_idx").join(sizes, group)
             .select(group, "_idx", "_n", rep)
             .select(group, "_rep", hash_index(key, F.col("_n")).alias("_pick")))
    picked = draws.join(numbered.withColumnRenamed("_idx", "_pick"), [group, "_pick"])
    means = picked.groupBy(group, "_rep").agg(F.avg("score").alias("_mean"))
    return _interval(means, group, "_mean", level, prefix)
