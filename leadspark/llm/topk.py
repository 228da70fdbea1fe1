"""Exact top-k search by inner product with distributed histogram selection.

Vectors are scaled to integers. Every query is scored against every candidate, block by block. For each query a
histogram of its scores over an interval says in which bin the k-th score lies; that bin is the next interval, until
it is one score. A last pass keeps what is above it, and of the candidates with exactly that score those of the
smallest ids. A block reports no bin below its own k-th score, as the global k-th cannot lie there: so it reports at
most k bins for a query, whatever its scores look like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadspark.session import stage

ROWS = 1024  # vectors of a block
BINS = 1024  # bins of an interval
LARGEST = 2.0**26  # scaled components beyond this have no place in the scores' integers


def scaled(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, dim, v) with v the components times ``scale``, rounded down; one row per id.

    Rows without id or vector, or with null, non-finite or over-large components, take no part. Of rows with the same
    id the one of the least vector counts.
    """
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale).cast("double"))
    # comparisons with NaN: Spark has it above every number
    fit = F.forall(F.col(vector), lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= LARGEST / scale))
    ok = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(fit, F.lit(False)))
    one = ok.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: c.cast("int")).alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    return one.select("id", F.size("v").alias("dim"), "v")


def _blocks(rows: DataFrame, count: int, name: str, fields: list[str]) -> DataFrame:
    """Rows of ``dim``, ``name``, arrays of ``fields`` and the components one after another; about ROWS in each."""
    parts = max(1, -(-count // ROWS))
    grouped = rows.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(name)).agg(F.collect_list(F.struct(*fields, "v")).alias("_all"))
    return grouped.select("dim", name, *[F.col(f"_all.{f}").alias(f"{name}_{f}") for f in fields], F.flatten("_all.v").alias(f"{name}_v"))


def _scores(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Scores of a pair of blocks, a mask of the query's own row, candidate ids, and the queries' fields."""
    get = lambda n: np.asarray(batch.column(batch.schema.get_field_index(n))[k].values)
    dim = batch.column(batch.schema.get_field_index("dim"))[k].as_py()
    fields = {n[2:]: get(n) for n in batch.schema.names if n.startswith("q_") and n != "q_v"}
    ids = get("c_id")
    q, c = get("q_v").reshape(len(fields["id"]), dim), get("c_v").reshape(len(ids), dim)
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dim
    # floats add integers exactly up to 2**53
    kind = np.float64 if largest < 2**53 else np.int64
    scores = q.astype(kind) @ c.astype(kind).T
    return scores, fields["id"][:, None] == ids[None, :], ids, fields


def _pairs(candidates: DataFrame, queries: DataFrame, n: int, n_queries: int, fields: list[str]) -> DataFrame:
    """Each block of queries with each block of candidates of its dimension; queries are what is repeated."""
    spark = candidates.sparkSession
    blocks = max(1, -(-n // ROWS))
    parts = max(blocks, 3 * spark.sparkContext.defaultParallelism)
    asked = _blocks(queries, n_queries, "q", fields).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(parts, "dim", "c")
    return candidates.repartition(parts, "dim", "c").join(asked, ["dim", "c"])


def top_k(df: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k highest scores, ties to the smaller id.

    ``is_query`` is a condition on ``id``. Candidates are all vectors of the query's dimension but its own; if they
    are fewer than k, all are returned, and a query without any returns no row. See ``scaled`` for rows that take no
    part. Empty tables give an empty result; further columns are ignored.
    """
    vectors = stage(scaled(df, key, vector, scale), "vectors")
    asked = vectors.where(F.coalesce(is_query, F.lit(False)))
    counts = vectors.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    n, n_queries = counts["n"], counts["q"]
    candidates = stage(_blocks(vectors, n, "c", ["id"]), "candidate-blocks")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    longest = vectors.agg(F.max(length)).first()[0] or 0.0
    # no score lies outside the product of lengths; above: how many scores are known to be higher than the interval
    bound = F.ceil(length * longest + 1).cast("long")
    state = asked.select("id", (-bound).alias("low"), (bound + 1).alias("high"), F.lit(0).cast("long").alias("above"))
    fields = ["id", "low", "high", "above"]
    while True:
        state = stage(state, "intervals")
        widest = state.agg(F.max(F.col("high") - F.col("low"))).first()[0]
        if widest is None or widest <= 1:
            break

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    scores, own, _, q = _scores(batch, row)
                    low, high, need = q["low"][:, None], q["high"][:, None], k - q["above"]
                    width = -(-(high - low) // BINS)
                    inside = (scores >= low) & (scores < high) & ~own
                    place = np.where(inside, (scores.astype(np.int64) - low) // width, -1)
                    # a bin below the block's own k-th cannot hold the global one
                    kth = max(place.shape[1] - k, 0)
                    floor = np.partition(place, kth, axis=1)[:, kth] if place.shape[1] else np.zeros(len(place))
                    i, j = np.nonzero((place >= np.maximum(floor, 0)[:, None]) & (need > 0)[:, None])
                    cell, times = np.unique(i * BINS + place[i, j], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(q["id"][cell // BINS]), pa.array(cell % BINS), pa.array(times)], names=["id", "bin", "n"])

        pairs = _pairs(candidates, asked.join(state, "id"), n, n_queries, fields)
        bins = pairs.mapInArrow(count, "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("id").orderBy(F.desc("bin"))
        summed = bins.withColumn("upto", F.sum("n").over(down)).join(state.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"))
        first = summed.where((F.col("above") + F.col("upto") >= k)).groupBy("id").agg(F.max_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("over")), "bin").alias("at"))
        width = F.ceil((F.col("high") - F.col("low")) / BINS).cast("long")
        new_low = F.col("low") + F.col("at.bin") * width
        # with fewer than k candidates there is no k-th: everything from the lowest bound on counts
        state = state.join(first, "id", "left").select(
            "id",
            F.when(F.col("at").isNull(), F.col("low")).otherwise(new_low).alias("low"),
            F.when(F.col("at").isNull(), F.col("low") + 1).otherwise(F.least(F.col("high"), new_low + width)).alias("high"),
            (F.col("above") + F.coalesce("at.over", F.lit(0))).alias("above"),
        )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                scores, own, ids, q = _scores(batch, row)
                order = np.argsort(ids, kind="stable")
                scores, own, ids = scores[:, order], own[:, order], ids[order]
                equal = (scores == q["low"][:, None]) & ~own
                # of equals the first in order of ids, as many as are wanted
                wanted = (scores > q["low"][:, None]) & ~own | equal & (np.cumsum(equal, axis=1) <= (k - q["above"])[:, None])
                i, j = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays([pa.array(q["id"][i]), pa.array(ids[j]), pa.array(scores[i, j].astype(np.int64))], names=["query_id", "vec_id", "score"])

    best = _pairs(candidates, asked.join(state, "id"), n, n_queries, fields).mapInArrow(keep, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
