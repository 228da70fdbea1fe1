"""Profiling: shape, types, missing values, duplicates, distributions, time anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.functions.ordered import exact_quantiles
from leadspark.operators.cleaning import dedup_first
from leadspark.session import stage


def table_shape(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each named table."""
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def schema_listing(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column with its type, from the analysed schemas alone."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, i, f.name, f.dataType.simpleString()) for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")


def preview(df: DataFrame, order: str, n: int = 3) -> DataFrame:
    """The first ``n`` rows in ingest order."""
    return df.orderBy(order).limit(n)


def null_counts(df: DataFrame, top: int | None = None) -> DataFrame:
    """Columns with missing values, most first; all counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot([], df.columns, "column_name", "n_missing").where("n_missing > 0")
    long = long.orderBy(F.desc("n_missing"), "column_name")
    return long.limit(top) if top else long


def missing_cells(df: DataFrame) -> DataFrame:
    """Missing cells of all cells."""
    missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(missing.alias("n_missing"), (F.count("*") * len(df.columns)).alias("n_cells"))


def duplicate_summary(leads: DataFrame) -> DataFrame:
    """Rows, known ids, and rows beyond the first of their id (missing ids count as one id)."""
    per_id = leads.groupBy("lead_id").agg(F.count("*").alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("lead_id").alias("n_ids"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def duplicate_rows(leads: DataFrame, order: str = "ingest_seq", n: int | None = None) -> DataFrame:
    """Rows whose id occurs more than once, by id; missing ids count as one id.

    Repeated ids are counted and written first, so that the join meets two scans and adaptive execution can split a
    hot id. Rows without an id take no part in it: they are repeated or not by their number alone.
    """
    counts = leads.groupBy("lead_id").agg(F.count("*").alias("_n")).where("_n > 1")
    repeated = stage(counts, "repeated-ids")
    rows = leads.join(repeated.where("lead_id IS NOT NULL").select("lead_id"), "lead_id", "left_semi").select(*leads.columns)
    no_id = repeated.where("lead_id IS NULL").agg(F.count("*")).scalar()
    rows = rows.union(leads.where(F.col("lead_id").isNull() & (no_id > 0))).orderBy("lead_id", order)
    return rows.limit(n) if n else rows


def describe_column(df: DataFrame, column: str, digits: int = 1) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles, maximum, rounded."""
    x = F.col(column).cast("double")
    quartiles = exact_quantiles(df, column, [0.25, 0.5, 0.75]).select("quantiles").scalar()
    basic = df.agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")
    ).withColumn("q", quartiles)
    shown = {"mean": "mean", "std": "std", "min": "min", "p25": "q[0]", "p50": "q[1]", "p75": "q[2]", "max": "max"}
    return basic.select("n", *[F.round(F.expr(e), digits).alias(name) for name, e in shown.items()])


def time_range(interactions: DataFrame) -> DataFrame:
    """First and last timestamp and the whole days between them."""
    ends = interactions.agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
    return ends.withColumn("span_days", F.timestamp_diff("DAY", F.col("min_ts"), F.col("max_ts")))


def before_creation(leads: DataFrame, interactions: DataFrame) -> DataFrame:
    """Interactions older than their lead.

    The leads' side, one row each, is written first: with two plain scans below the join, adaptive execution splits
    the interactions of a hot lead, which a window below it would prevent.
    """
    created = stage(dedup_first(leads).select("lead_id", "created_at"), "created")
    return interactions.join(created, "lead_id").where(F.col("ts") < F.col("created_at"))
