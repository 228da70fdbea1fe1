"""Top-k search against every pair scored in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from leadspark.llm import topk
from leadspark.llm.queries import op6_histogram_topk


def brute(rows, k=20, every=20):
    vectors = {}
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(64 * x) for x in v]
            vectors[key] = min(q, vectors.get(key, q))
    out = []
    for a, q in vectors.items():
        if a % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, p)), b) for b, p in vectors.items() if b != a and len(p) == len(q))
            out += [(a, r + 1, b, -s) for r, (s, b) in enumerate(scores[:k])]
    return sorted(out)


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "'x' AS id").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")


def test_ties_copies_nulls_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "BINS", 7)
    rng = random.Random(9)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(-20, 200)]
    rows += [(k, [1.0] * 8) for k in range(200, 330)] + [(k, [0.0] * 8) for k in range(400, 430)]  # a hot vector
    rows += [(500, None), (520, [None] * 8), (540, [float("nan")] + [0.0] * 7), (560, [float("inf")] * 8), (None, [1.0] * 8), (40, [9.0] * 8), (580, [1.0, 2.0]), (581, [1.0, -2.0]), (600, [])]
    table(spark, tmp_path, rows)
    assert sorted(map(tuple, op6_histogram_topk(spark, str(tmp_path)).collect())) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(20, [1.0])], [(20, [1.0]), (21, [2.0])], [(1, [1.0])]])
def test_few_rows(spark, tmp_path, rows):
    table(spark, tmp_path, rows)
    assert sorted(map(tuple, op6_histogram_topk(spark, str(tmp_path)).collect())) == brute(rows)


def test_wide_values(spark):
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-1, 1) * 2.0 ** rng.randrange(0, 19) for _ in range(300)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("id") % 30 == 0, k=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 30)
