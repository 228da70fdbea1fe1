"""Shards of nearly equal bytes by histogram sort.

Rows get an order by a 64-bit key. Splitters, the borders between parts of that order, are found by counting: each
round counts the exact bytes between candidate borders over all partitions and puts new candidates where a border
has not met its tolerance, until every border has or no key lies between its neighbours. Only then do rows move,
once, straight to their part. Rows are written with their key first: what is counted and what moves are one table. A shard is several neighbouring parts, so no shard is ever one task, and places inside
a shard come from the parts' row counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.session import stage

PROBES = 64  # candidates per unmet border and round
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def histogram(sizes: DataFrame, borders: list[int], key: str = "key", size: str = "size") -> np.ndarray:
    """Exact bytes below each of the ascending ``borders``: counted in every partition, then added up."""
    edges = np.array(borders, dtype=np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(edges) + 1, dtype=np.int64)
        for batch in batches:
            place = np.searchsorted(edges, batch.column(0).to_numpy(zero_copy_only=False), side="right")
            np.add.at(total, place, batch.column(1).to_numpy(zero_copy_only=False))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["place", "bytes"])

    counted = sizes.select(key, size).mapInArrow(count, "place long, bytes long").groupBy("place").agg(F.sum("bytes").alias("bytes"))
    total = np.zeros(len(edges) + 1, dtype=np.int64)
    for row in counted.collect():  # a row per border at most
        total[row["place"]] = row["bytes"]
    return np.cumsum(total)[:-1]


def splitters(sizes: DataFrame, parts: int, tolerance: float, key: str = "key", size: str = "size", probes: int = PROBES) -> list[int]:
    """``parts - 1`` keys: part p holds keys from splitter p-1 (inclusive) to splitter p (exclusive).

    A splitter meets its tolerance if the bytes below it are within ``tolerance`` of a part's share of its target.
    Rounds are at most 64 / log2(probes) or so, as each cuts every unmet interval into ``probes + 1``.
    """
    total = sizes.agg(F.sum(size)).first()[0] or 0
    goal = np.array([total * (p + 1) / parts for p in range(parts - 1)])
    slack = tolerance * total / parts
    low, high = [LOWEST] * (parts - 1), [HIGHEST] * (parts - 1)  # bytes below low <= goal < bytes below high
    below_low = np.zeros(parts - 1)
    below_high = np.full(parts - 1, float(total))
    found: dict[int, int] = {}
    while True:
        wanted = sorted({low[p] + (high[p] - low[p]) * (k + 1) // (probes + 1) for p in range(parts - 1) if p not in found for k in range(probes)})
        if not wanted:
            break
        below = histogram(sizes, wanted, key, size)
        marks = np.array(wanted, dtype=np.int64)
        for p in range(parts - 1):
            if p in found:
                continue
            at = int(np.searchsorted(below, goal[p], side="right"))
            if at and below[at - 1] >= below_low[p] and marks[at - 1] > low[p]:
                low[p], below_low[p] = int(marks[at - 1]), float(below[at - 1])
            if at < len(marks) and marks[at] < high[p]:
                high[p], below_high[p] = int(marks[at]), float(below[at])
            nearest, off = (low[p], goal[p] - below_low[p]) if goal[p] - below_low[p] <= below_high[p] - goal[p] else (high[p], below_high[p] - goal[p])
            if off <= slack or high[p] - low[p] <= 1:
                found[p] = nearest
    return np.maximum.accumulate(np.array([found[p] for p in range(parts - 1)], dtype=np.int64)).tolist()


def spread_key(*columns: str) -> Column:
    """A 64-bit key that shuffles the rows and tells apart even equal ones.

    The last term is a row's place in its partition, which another scan may change; ``shard`` computes it once.
    """
    return F.xxhash64(*columns, F.monotonically_increasing_id())


def shard(docs: DataFrame, shards: int, size: Column, key: Column, tolerance: float = 0.002, parts_per_shard: int | None = None) -> DataFrame:
    """``docs`` with size, shard (0 to shards-1) and slot (0, 1, ... in each shard), the shards' sizes nearly equal.

    Every row goes to exactly one shard; rows of equal key stay together, so give keys that tell rows apart
    (``spread_key``). Repeated rows are rows of their own, nulls are what ``size`` and ``key`` make of them, an empty
    table stays empty. Columns of the three names are replaced; none may be called _key or _part.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    per_shard = parts_per_shard or max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    keyed = stage(docs.select(*names, size.cast("long").alias("size"), key.cast("long").alias("_key")), "keyed")
    sizes = keyed.select(F.col("_key").alias("key"), "size")
    # borders between shards are held to the tolerance of a shard, those inside to the same bytes
    cuts = np.array(splitters(sizes, shards * per_shard, tolerance * per_shard), dtype=np.int64)

    def place(keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts, keys, side="right").astype(np.int32)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("_key")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place(keys))], names=[*batch.schema.names, "_part"])

    def mark_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, n = np.unique(place(batch.column(0).to_numpy(zero_copy_only=False)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n)], names=["_part", "n"])

    counts = sizes.select("key").mapInArrow(mark_keys, "_part int, n long").groupBy("_part").agg(F.sum("n").alias("n"))
    shard_of = F.floor(F.col("_part") / per_shard).cast("int")
    before = W.partitionBy(shard_of).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))

    marked = keyed.mapInArrow(mark, T.StructType([*keyed.schema.fields, T.StructField("_part", T.IntegerType())]))
    # the only exchange of the rows; the starts are a row per part, as many as the splitters
    inside = W.partitionBy("_part").orderBy("_key")
    ranked = marked.withColumn("_nth", F.row_number().over(inside))
    ranked = ranked.join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    return ranked.select(*names, "size", shard_of.alias("shard"), (F.col("_start") + F.col("_nth") - 1).cast("long").alias("slot"))
