"""Statistics over pre-aggregated or per-lead rows: correlation, histograms, box plots, densities."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions.ordered import exact_quantiles
from leadspark.session import stage

# The functions below travel to the executors by value, so those need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], mirrored: bool = False) -> DataFrame:
    """Pearson correlation of each pair of columns over the rows where both are known, in long form.

    One pass over the columns, written once: each task multiplies its zero-filled values and masks of what is known,
    batch by batch, into a few square matrices, and Spark adds those up. Values are shifted by their minimum, so that
    large ones lose no digits and a constant column has variance zero, for which the correlation is null. With
    ``mirrored`` each pair of two columns is given both ways.
    """
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    k = len(names)
    rows = stage(df.select(*[F.col(c).cast("double").alias(c) for c in names]), "correlated")
    low = rows.agg(*[F.min(c) for c in names]).first()
    shift = np.array([0.0 if v is None else v for v in low])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in batches:
            x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - shift
            known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
            x = np.where(known > 0, x, 0.0)
            total += np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4 * k * k)), pa.array(total.ravel())], names=["place", "value"])

    summed = rows.mapInArrow(multiply, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(4 * k * k)
    total[summed["place"].to_numpy()] = summed["value"].to_numpy()  # four numbers a pair
    n, x1, x2, xy = total.reshape(4, k, k)
    at = {c: i for i, c in enumerate(names)}
    cells = []
    for a, b in pairs:
        i, j = at[a], at[b]
        m = n[i, j]
        left, right = (m * x2[i, j] - x1[i, j] ** 2, m * x2[j, i] - x1[j, i] ** 2)
        found = None
        if left > 0 and right > 0:
            found = 1.0 if i == j else float((m * xy[i, j] - x1[i, j] * x1[j, i]) / np.sqrt(left) / np.sqrt(right))
        cells.append((a, b, found))
        if mirrored and a != b:
            cells.append((b, a, found))
    out = df.sparkSession.createDataFrame(cells, "feature_a string, feature_b string, correlation double")
    return out.withColumn("correlation", F.round("correlation", 6) + F.lit(0.0))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long, values as doubles."""
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(list(ids), list(values), name, value)


def histogram(long: DataFrame, groups: Sequence[str], classes: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width bins of ``value`` per group, shared by the group's classes, the last bin closed.

    ``groups`` and ``classes`` are small closed sets: the dense output has ``bins`` rows for each.
    """
    groups, classes = list(groups), list(classes)
    known = long.where("value IS NOT NULL")
    ends = known.groupBy(*groups).agg(F.min("value").alias("_min"), F.max("value").alias("_max"))
    half = F.when(F.col("_min") == F.col("_max"), 0.5).otherwise(0.0)
    ends = ends.select(*groups, (F.col("_min") - half).alias("lo"), (F.col("_max") + half).alias("hi"))

    def edge(i: Column) -> Column:
        return F.col("lo") + i * (F.col("hi") - F.col("lo")) / bins

    if groups:
        ranged = known.join(ends, groups)
    else:
        span = ends.select(F.struct("lo", "hi")).scalar()
        ranged = known.withColumn("_span", span).select(*known.columns, "_span.lo", "_span.hi")
    guess = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    # rounding may put a value on the wrong side of an edge
    guess = guess - (F.col("value") < edge(guess)).cast("int")
    guess = F.when((F.col("value") >= edge(guess + 1)) & (guess < bins - 1), guess + 1).otherwise(guess)
    filled = ranged.select(*groups, *classes, (guess + 1).cast("int").alias("bin")).groupBy(*groups, *classes, "bin").agg(F.count("*").alias("n"))
    grid = known.select(*groups, *classes).distinct()
    grid = grid.join(ends, groups) if groups else _with_span(grid, classes, ends)
    grid = grid.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    grid = grid.withColumn("bin_start", edge(F.col("bin") - 1)).withColumn("bin_end", edge(F.col("bin")))
    return grid.join(filled, [*groups, *classes, "bin"], "left").select(
        *groups, *classes, "bin", F.round("bin_start", 6).alias("bin_start"), F.round("bin_end", 6).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _with_span(grid: DataFrame, classes: list[str], ends: DataFrame) -> DataFrame:
    if not classes:
        return ends.where("lo IS NOT NULL")
    span = ends.select(F.struct("lo", "hi")).scalar()
    return grid.withColumn("_span", span).select(*classes, "_span.lo", "_span.hi")


def box_stats(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Quartiles, whiskers (extremes within 1.5 IQR) and outliers of a column, per class if asked."""
    known = df.where(F.col(value).isNotNull())
    quartiles = exact_quantiles(known, value, [0.25, 0.5, 0.75], [by] if by else [])
    if by:
        boxed = known.select(by, F.col(value).cast("double").alias("x")).join(quartiles, by)
    else:
        boxed = known.select(F.col(value).cast("double").alias("x"), quartiles.select("quantiles").scalar().alias("quantiles"))
    q1, q3 = F.col("quantiles")[0], F.col("quantiles")[2]
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    boxed = boxed.withColumn("inside", (F.col("x") >= low) & (F.col("x") <= high))
    keys = [by] if by else []
    out = boxed.groupBy(*keys, "quantiles").agg(
        F.min(F.when(F.col("x") >= low, F.col("x"))).alias("_wl"),
        F.max(F.when(F.col("x") <= high, F.col("x"))).alias("_wh"),
        F.count_if(~F.col("inside")).alias("outliers"),
        F.count("*").alias("n"),
    )
    return out.select(
        *keys, "n",
        F.round(q1, 4).alias("q1"), F.round(F.col("quantiles")[1], 4).alias("median"), F.round(q3, 4).alias("q3"),
        F.round(F.least("_wl", q1), 4).alias("whisker_low"), F.round(F.greatest("_wh", q3), 4).alias("whisker_high"),
        "outliers",
    )


def kernel_density(long: DataFrame, group: str, label: str, points: int = 200) -> DataFrame:
    """Gaussian density per (group, label) on ``points`` grid points over the group's value range.

    Bandwidth is n**(-1/5) times the sample deviation. Equal values are merged first; each remaining
    value meets only its own group's grid, and the sums are combined before they are shuffled.
    """
    known = long.where("value IS NOT NULL")
    counts = known.groupBy(group, label, "value").agg(F.count("*").alias("m"))
    shape = known.groupBy(group, label).agg(
        F.count("*").alias("n"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo_c"), F.max("value").alias("hi_c")
    )
    ends = shape.groupBy(group).agg(F.min("lo_c").alias("lo"), F.max("hi_c").alias("hi"))
    shape = shape.join(ends, group).where("sd > 0").select(
        group, label, "n", "lo", "hi", (F.col("sd") * F.pow(F.col("n").cast("double"), -0.2)).alias("h")
    )
    grid = counts.join(shape, [group, label]).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / (points - 1)
    u = (F.col("x") - F.col("value")) / F.col("h")
    return (
        grid.withColumn("x", x)
        .groupBy(group, label, "point")
        .agg(
            F.round(F.max("x"), 6).alias("x"),
            F.round(F.sum(F.col("m") * F.exp(-0.5 * u * u) / (F.col("n") * F.col("h") * 2.5066282746310002)), 6).alias("density"),
        )
    )
