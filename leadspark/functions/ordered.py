"""Exact order statistics that never put an unbounded group into one task.

Quantiles come from a sketch that brackets their ranks and an exact count of what lies below and inside. For running
totals over all values, rows are first reduced to distinct values with counts, so a value that fills a third of all
rows is one row here. Quantiles of the distinct values then cut the range into buckets of about equal numbers of them,
whatever the data looks like, and totals are taken twice: over the few buckets, and inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadspark.session import stage

# Values per bucket grow with the data; give more buckets for more executors.
BUCKETS = 512
# Brackets hold a few ranks in so many.
ACCURACY = 10_000


def bucketed(counts: DataFrame, value: str, buckets: int = BUCKETS) -> DataFrame:
    """Add ``bucket``: order-preserving, balanced over the rows of ``counts``; NaN comes last."""
    cuts = sorted(set(counts.approxQuantile(value, [(k + 1) / buckets for k in range(buckets - 1)], 0.25 / buckets)))
    if not cuts:
        return counts.withColumn("bucket", F.lit(0))
    fitted = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol=value, outputCol="bucket", handleInvalid="keep")
    return fitted.transform(counts).withColumn("bucket", F.col("bucket").cast("int"))


def running_totals(
    df: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False, buckets: int = BUCKETS,
) -> DataFrame:
    """Add ``cum_<s>`` (running) and ``all_<s>`` (whole) for each column ``s`` of ``sums``.

    ``df`` is a staged table with one row per (by, value), ``by`` being a small closed set such as a
    class label. The totals per bucket are at most ``buckets`` rows per group and are broadcast: left to itself, Spark
    may broadcast the rows, whose files compress well.
    """
    by = list(by)
    order = F.desc if descending else F.asc
    rows = bucketed(df, value, buckets)
    upto = W.partitionBy(*by).orderBy(order("bucket")).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "bucket").agg(*[F.sum(s).alias(f"_in_{s}") for s in sums])
    totals = totals.select(
        *[F.col(b).alias(f"_by_{b}") for b in by],
        F.col("bucket").alias("_bucket"),
        *[F.coalesce(F.sum(f"_in_{s}").over(upto), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_in_{s}").over(W.partitionBy(*by)).alias(f"all_{s}") for s in sums],
    )
    same = F.col("bucket") == F.col("_bucket")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    inside = W.partitionBy(*by, "bucket").orderBy(order(value)).rowsBetween(W.unboundedPreceding, 0)
    return rows.join(F.broadcast(totals), same).select(
        *df.columns,
        *[(F.col(f"_before_{s}") + F.sum(s).over(inside)).alias(f"cum_{s}") for s in sums],
        *[f"all_{s}" for s in sums],
    )


def exact_quantiles(
    df: DataFrame, value: Column | str, probs: Sequence[float], by: Sequence[str] = (), accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group: ``quantiles``, an array in the order of ``probs``, linearly interpolated.

    Two passes over the values, which are written once. A mergeable sketch with a rank error of at most 1 in
    ``accuracy`` brackets every wanted rank; then each task counts what lies below a bracket and keeps the counts of
    the values inside, a few in ten thousand, whose running totals hold the exact rank. A group of fewer values than
    the sketch tells apart is its own bracket. Nulls are left out.
    """
    by = list(by)
    value = F.col(value) if isinstance(value, str) else value
    rows = stage(df.select(*by, value.cast("double").alias("_x")).where("_x IS NOT NULL"), "values")
    error = 1.0 / accuracy
    marks = [min(1.0, max(0.0, p + s * 2 * error)) for p in probs for s in (-1, 1)]
    sketch = F.percentile_approx("_x", F.array(*[F.lit(m) for m in marks]), accuracy)
    seen = rows.groupBy(*by).agg(F.count("*").alias("_all"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), sketch.alias("_marks"))
    few = F.col("_all") <= 4 * accuracy
    ends = F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.when(few, F.col("_min")).otherwise(F.col("_marks")[2 * i]).alias("lo"), F.when(few, F.col("_max")).otherwise(F.col("_marks")[2 * i + 1]).alias("hi"),
        )
        for i in range(len(probs))
    ])
    brackets = stage(seen.select(*[F.col(b).alias(f"_by_{b}") for b in by], "_all", ends.alias("_ends")), "brackets")
    if by:
        same = reduce(and_, [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by])
        met = rows.join(brackets, same)
    else:
        met = rows.withColumn("_b", brackets.select(F.struct("_all", "_ends")).scalar()).select("_x", "_b.*")
    # per wanted rank the value if it is in the bracket, null if below; those above do not count
    near = F.transform(F.filter("_ends", lambda e: F.col("_x") <= e["hi"]), lambda e: F.struct(e["i"].alias("i"), F.when(F.col("_x") >= e["lo"], F.col("_x")).alias("x")))
    counts = met.select(*by, "_all", F.explode(near).alias("_e")).groupBy(*by, "_all", F.col("_e.i").alias("_i"), F.col("_e.x").alias("_x")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*by, "_i").orderBy(F.asc_nulls_first("_x")).rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumn("_upto", upto)

    def at(i: int, position: Column) -> Column:
        """The value holding 0-based rank ``position``."""
        return F.max(F.when((F.col("_i") == i) & (F.col("_upto") > position) & (F.col("_upto") - F.col("_n") <= position), F.col("_x")))

    picked = []
    for i, p in enumerate(probs):
        spot = F.lit(float(p)) * (F.col("_all") - 1)
        picked += [at(i, F.floor(spot)).alias(f"_lo{i}"), at(i, F.ceil(spot)).alias(f"_hi{i}"), F.max(spot - F.floor(spot)).alias(f"_w{i}")]
    bounds = ranked.groupBy(*by).agg(*picked)
    between = [F.col(f"_lo{i}") + F.col(f"_w{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}")) for i in range(len(probs))]
    return bounds.select(*by, F.array(*between).alias("quantiles"))


def seeded_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("_", F.col(key).cast("string"), F.lit(str(seed))))


def hash_ranks(df: DataFrame, key: str, stratum: str, seed: int, digits: int = 3) -> DataFrame:
    """Add ``rn`` and ``n_class``: a seeded shuffle of each stratum as exact ranks from 1.

    ``df`` is read twice: stage it if it is costly. Ranking follows the MD5 text of key and seed. Its first ``digits`` hex digits spread any stratum
    evenly over 16**digits windows, so the largest class is never sorted in one task.
    """
    rows = df.withColumn("_h", seeded_hash(key, seed))
    rows = rows.withColumn("_p", F.substring("_h", 1, digits))
    sizes = rows.groupBy(stratum, "_p").agg(F.count("*").alias("_m"))
    before = W.partitionBy(stratum).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(stratum).alias("_s"),
        F.col("_p").alias("_q"),
        F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"),
        F.sum("_m").over(W.partitionBy(stratum)).alias("n_class"),
    )
    inside = W.partitionBy(stratum, "_p").orderBy("_h", key)
    # at most 16**digits rows per stratum; rows, however small their files, are never broadcast
    return rows.join(F.broadcast(offsets), F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_q"))).select(
        *df.columns, (F.col("_before") + F.row_number().over(inside)).alias("rn"), "n_class"
    )


def hash_cut(df: DataFrame, key: str, stratum: str, seed: int, share: float, accuracy: int = ACCURACY) -> DataFrame:
    """(stratum, hash, key) of the round(share x n)-th row of each stratum in the order of :func:`hash_ranks`.

    ``df`` is read three times: stage it if it is costly. A sketch of the hashes brackets the rank, rows below the bracket
    are counted, and only those inside, a few in ten thousand, are ordered. A stratum of which no row is wanted is left out.
    """
    rows = df.select(F.col(stratum).alias("_s"), F.col(key).alias("_key"), seeded_hash(key, seed).alias("_h"))
    # thirteen digits fill the whole numbers that a double holds
    rows = rows.withColumn("_x", F.conv(F.substring("_h", 1, 13), 16, 10).cast("double"))
    error = 2.0 / accuracy
    marks = F.percentile_approx("_x", F.array(F.lit(max(0.0, share - error)), F.lit(min(1.0, share + error))), accuracy)
    sizes = rows.groupBy("_s").agg(F.count("*").alias("_n"), marks.alias("_m"))
    few = F.col("_n") <= 4 * accuracy
    brackets = sizes.select(
        F.col("_s").alias("_t"), F.round(F.col("_n") * share).cast("long").alias("_want"), F.when(few, 0.0).otherwise(F.col("_m")[0]).alias("_lo"),
        F.when(few, 2.0**53).otherwise(F.col("_m")[1]).alias("_hi"),
    )
    # one row per stratum; rows, however small their files, are never broadcast
    met = rows.join(F.broadcast(brackets), F.col("_s").eqNullSafe(F.col("_t")))
    below = met.groupBy(F.col("_s").alias("_b")).agg(F.count_if(F.col("_x") < F.col("_lo")).alias("_below"))
    inside = met.where("_x >= _lo AND _x <= _hi").withColumn("_rn", F.row_number().over(W.partitionBy("_s").orderBy("_h", "_key")))
    found = inside.join(F.broadcast(below), F.col("_s").eqNullSafe(F.col("_b"))).where("_rn + _below = _want")
    return found.select(F.col("_s").alias(stratum), F.col("_h").alias("hash"), F.col("_key").alias(key))
