"""Expressions and order statistics against plain Python."""

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadspark.functions import ordered, scalars, stats
from leadspark.session import stage


def one(spark, column, row="1 AS x"):
    return spark.sql(f"SELECT {row}").select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("x", [2400.0, 0.0, -3.5, 1.2345678e7, 0.00012, 1.2e-5, 123456789.25, 1e16, 0.1 + 0.2, -2.5e-7])
def test_number_text_is_the_shortest_decimal(spark, x):
    assert spark.createDataFrame([(x,)], "x double").select(scalars.number_text("x")).first()[0] == repr(x)


@pytest.mark.parametrize("p,text", [(0.825, "82%"), (0.5, "50%"), (1.0, "100%"), (0.004, "0%"), (0.835, f"{0.835:.0%}")])
def test_percent_text_rounds_halves_to_even(spark, p, text):
    assert one(spark, scalars.percent_text(F.lit(p))) == text


@pytest.mark.parametrize("flag,value", [("true", 1), ("True", 1), ("yes", 1), ("no", 0), ("FALSE", 0), ("1", 0), ("maybe", 0), (None, 0)])
def test_flag_to_int(spark, flag, value):
    assert one(spark, scalars.flag_to_int(F.lit(flag).cast("string"))) == value
    if flag in ("true", "FALSE"):
        assert one(spark, scalars.flag_to_int(F.lit(flag == "true"))) == value


def test_small_scalars(spark):
    assert one(spark, scalars.parse_ts(F.lit("rubbish"))) is None
    assert one(spark, scalars.parse_ts(F.lit("2026-01-02 03:04:05")).cast("string")) == "2026-01-02 03:04:05"
    assert one(spark, scalars.safe_ratio(F.lit(5), F.lit(0))) == 5
    assert one(spark, scalars.funnel_order(F.lit("Elsewhere"), 1)) == 1
    assert one(spark, scalars.funnel_order(F.lit(None).cast("string"), None)) is None
    assert one(spark, scalars.is_form_completion(F.lit(None).cast("boolean"))) is False
    assert one(spark, scalars.is_high_intent(F.lit(None).cast("string"))) is False
    assert one(spark, scalars.elapsed_days(scalars.parse_ts(F.lit("2026-01-02 12:00:00")), scalars.parse_ts(F.lit("2026-01-01 00:00:00")))) == -1.5


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows share one value; the rest are spread over many sizes; some are missing."""
    rng = random.Random(7)
    rows = [("a", 3.25)] * 700 + [("a", rng.lognormvariate(2, 2)) for _ in range(800)] + [("b", float(rng.randint(0, 40))) for _ in range(500)]
    return rows + [("a", None), ("b", None)]


@pytest.mark.parametrize("accuracy", [20, 60, 10_000])
def test_exact_quantiles(spark, skewed, accuracy):
    df = spark.createDataFrame(skewed, "g string, x double").repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["g"]: r["quantiles"] for r in ordered.exact_quantiles(df, "x", probs, ["g"], accuracy=accuracy).collect()}
    for g in "ab":
        want = np.quantile([x for k, x in skewed if k == g and x is not None], probs)
        assert np.allclose(got[g], want)
    whole = ordered.exact_quantiles(df, "x", [0.5], accuracy=accuracy).first()["quantiles"][0]
    assert whole == pytest.approx(median(x for _, x in skewed if x is not None))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("buckets", [8, 512])
def test_running_totals(spark, descending, buckets):
    rows = [(float(i % 97) + i / 1000, i % 5, 1) for i in range(600)]
    df = spark.createDataFrame(rows, "x double, m int, n int")
    got = {r["x"]: r for r in ordered.running_totals(df, "x", ["m", "n"], descending=descending, buckets=buckets).collect()}
    m = n = 0
    for x, a, b in sorted(rows, reverse=descending):
        m, n = m + a, n + b
        assert (got[x]["cum_m"], got[x]["cum_n"], got[x]["all_m"], got[x]["all_n"]) == (m, n, sum(r[1] for r in rows), 600)


@pytest.mark.parametrize("share,accuracy", [(0.2, 20), (0.2, 10_000), (0.5, 40), (0.0, 20), (1.0, 20)])
def test_split_by_a_found_hash_equals_the_ranks(spark, share, accuracy):
    df = spark.createDataFrame([(k % 900, None if k % 11 == 0 else k % 2) for k in range(1000)], "id long, y long").repartition(3)
    ranked = ordered.hash_ranks(df, "id", "y", 42).where(F.col("rn") == F.round(F.col("n_class") * share))
    want = {(r.y, r.id) for r in ranked.collect()}
    assert {(r.y, r.id) for r in ordered.hash_cut(df, "id", "y", 42, share, accuracy).collect()} == want


def test_hash_ranks_are_a_shuffle_of_each_class(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("y"))
    rows = ordered.hash_ranks(df, "id", "y", 42).collect()
    for y, n in ((0, 666), (1, 334)):
        ranks = [r["rn"] for r in rows if r["y"] == y]
        assert sorted(ranks) == list(range(1, n + 1)) and {r["n_class"] for r in rows if r["y"] == y} == {n}
    first = [r["id"] for r in sorted(rows, key=lambda r: r["rn"])]
    assert first != sorted(first)
    again = {r["id"]: r["rn"] for r in ordered.hash_ranks(df.repartition(7), "id", "y", 42).collect()}
    assert again == {r["id"]: r["rn"] for r in rows}


def test_histogram_follows_the_edges(spark):
    values = [float(i) for i in range(31)] + [0.1 * i for i in range(100)] + [29.0] * 5
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "value double")
    got = [r["n"] for r in stats.histogram(df, [], []).orderBy("bin").collect()]
    assert got == np.histogram(values, bins=30)[0].tolist()


def test_histogram_of_one_value(spark):
    rows = stats.histogram(spark.createDataFrame([(4.0,), (4.0,)], "value double"), [], []).orderBy("bin").collect()
    want, edges = np.histogram([4.0, 4.0], bins=30)
    assert [r["n"] for r in rows] == want.tolist() and rows[0]["bin_start"] == 3.5 and rows[-1]["bin_end"] == 4.5


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, None), (3.0, 5.0, 7.0)], "a double, b double, c double")
    got = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in stats.correlations(df, [("a", "b"), ("a", "c"), ("a", "a")]).collect()}
    assert got == {("a", "b"): None, ("a", "c"): 1.0, ("a", "a"): 1.0}


def test_box_stats(spark):
    x = [1.0, 2.0, 2.5, 3.0, 4.0, 100.0]
    r = stats.box_stats(spark.createDataFrame([(v,) for v in x], "x double"), "x").first()
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    assert (r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"], r["outliers"]) == (q1, q2, q3, 1.0, 4.0, 1)


def test_kernel_density_against_the_formula(spark):
    x = [0.0, 1.0, 1.0, 4.0]
    df = spark.createDataFrame([("f", 1, v) for v in x], "feature string, converted int, value double")
    rows = stats.kernel_density(df, "feature", "converted", points=5).orderBy("point").collect()
    h = np.std(x, ddof=1) * len(x) ** -0.2
    for r in rows:
        want = np.mean(np.exp(-0.5 * ((r["x"] - np.array(x)) / h) ** 2)) / (h * np.sqrt(2 * np.pi))
        assert r["density"] == pytest.approx(want, abs=1e-6)


def test_rows_are_never_broadcast(spark):
    """Tables of a few rows per stratum or bucket are the side that is sent, not the rows, whose files may be small."""
    rows = stage(spark.range(5000).select(F.col("id").alias("lead_id"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") / 7).alias("score")), "rows")
    for found in (
        ordered.hash_cut(rows, "lead_id", "y", 42, 0.2), ordered.hash_ranks(rows, "lead_id", "y", 42), ordered.running_totals(rows, "score", ["lead_id"], ["y"]),
    ):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
