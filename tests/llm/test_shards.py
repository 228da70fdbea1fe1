"""Sharding by histogram sort: laws, hot keys, defined cases."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadspark.llm import shards
from leadspark.llm.queries import op10_histogram_shards


def check(rows, texts, slack):
    assert sorted((repr(r.doc_id), r.text_crc32, r.size) for r in rows) == sorted((repr(k), zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for k, t in texts)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if rows:
        mean = sum(sizes.values()) / 40
        assert all(abs(sizes[s] - mean) <= slack for s in range(40)), (mean, sizes)


def test_real_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op10_histogram_shards(spark, sf).collect(), texts, 2 * max(len(t.encode()) + 16 for _, t in texts))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "x"), (None, "x"), (3, ""), (3, "")], [(7, "same text")] * 4000 + [(k, "é" * (k % 90)) for k in range(4000)]])
def test_defined_cases(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "'s' AS slot").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    check(op10_histogram_shards(spark, str(tmp_path)).collect(), rows, 600)


@pytest.mark.parametrize("probes", [1, 3, 64])
def test_splitters_meet_their_tolerance_on_any_keys(spark, probes):
    rng = random.Random(probes)
    for keys in ([rng.randrange(-(2**63), 2**63) for _ in range(2000)], [rng.randrange(5) for _ in range(300)], [2**63 - 1] * 10 + [-(2**63)] * 10, [rng.randrange(10**6, 10**6 + 50) ** 2 for _ in range(500)]):
        rows = [(k, rng.randint(1, 9)) for k in keys]
        sizes = spark.createDataFrame(rows, "key long, size long").coalesce(2).cache()
        cuts = shards.splitters(sizes, 7, 0.01, probes=probes)
        total, values = sum(s for _, s in rows), sorted({k for k, _ in rows})
        below = lambda c: sum(s for k, s in rows if k < c)
        assert cuts == sorted(cuts) and len(cuts) == 6
        for p, c in enumerate(cuts):
            goal = total * (p + 1) / 7
            best = min(abs(below(v) - goal) for v in [*values, values[-1] + 1])
            assert abs(below(c) - goal) <= max(best, 0.01 * total / 7) + max(s for _, s in rows) * sum(k == 2**63 - 1 for k in keys)
        sizes.unpersist()


def test_histogram_counts_exact_bytes(spark):
    sizes = spark.createDataFrame([(k, k * k) for k in range(-50, 50)], "key long, size long").repartition(5)
    borders = [-60, -10, 0, 7, 49, 100]
    assert shards.histogram(sizes, borders).tolist() == [sum(k * k for k in range(-50, 50) if k < b) for b in borders]
    assert isinstance(shards.histogram(sizes, borders), np.ndarray)


def test_rows_move_once(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 50).alias("text"))
    plan = shards.shard(docs, 4, F.length("text"), shards.spread_key("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert sum("text" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line) <= 1


def test_other_file_splits_after_counting_change_nothing(spark, tmp_path):
    rows = [(7, "same text")] * 400 + [(k, "x" * (k % 90)) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in zip(names, ("1g", "0", "1")):
            spark.conf.set(n, v)
        placed = op10_histogram_shards(spark, str(tmp_path))
        for n, v in zip(names, ("1k", "1k", "64")):
            spark.conf.set(n, v)
        check(placed.collect(), rows, 600)
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
