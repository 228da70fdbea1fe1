"""Why a lead scores as it does: contributions, ranked factors, a sentence."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.constants import (
    FEATURE_LABELS, FEATURES, FUNNEL_ORDER, MODERATE_FROM, NEGATIVE_TEXT, NO_POSITIVE_TEXT, POSITIVE_TEXT, SCORE_TEXT, STAGE_TEXT, STRONG_FROM,
)
from leadspark.functions.scalars import filled, lookup, number_text, percent_text
from leadspark.session import fresh_path, stage

CONTRIBUTIONS = [f"c_{f}" for f in FEATURES]

# The functions below travel to the executors by value, so those need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- ranked factors and summary -----------------------------------------------------------------

def top_factors(n: int = 5, digits: int = 4) -> Column:
    """The ``n`` features of largest absolute contribution, from columns ``c_<feature>``, as structs.

    Ranked inside the row: nothing is exploded or shuffled. Equal sizes keep the feature order.
    """
    items = F.array(*[
        F.struct(
            (-F.abs(F.col(f"c_{f}"))).alias("size"),
            F.lit(i).alias("place"),
            F.lit(f).alias("feature"),
            (F.col(f) if f == "source" else number_text(f)).alias("value"),
            F.col(f"c_{f}").alias("raw"),
            F.lit(FEATURE_LABELS.get(f, f)).alias("human_label"),
        )
        for i, f in enumerate(FEATURES)
    ])
    return F.transform(
        F.slice(F.array_sort(items), 1, n),
        lambda x: F.struct(
            x["feature"].alias("feature"),
            x["value"].alias("value"),
            F.round(x["raw"], digits).alias("contribution"),
            F.when(x["raw"] > 0, "increases").otherwise("decreases").alias("direction"),
            x["human_label"].alias("human_label"),
        ),
    )


def _named(factors: Column) -> Column:
    return F.array_join(F.transform(factors, lambda x: F.concat(x["human_label"], F.lit(" ("), x["value"], F.lit(")"))), ", ")


def summary_text(probability: Column, factors: Column, stage: Column) -> Column:
    """Score, funnel stage, up to three positive signals and the main negative one, as sentences."""
    strength = F.when(probability >= STRONG_FROM, "strong").when(probability >= MODERATE_FROM, "moderate").otherwise("low")
    stage_name = lookup({order: name for name, order in FUNNEL_ORDER.items()}, stage.cast("int"), "Unknown")
    positive = F.slice(F.filter(factors, lambda x: x["contribution"] > 0), 1, 3)
    negative = F.slice(F.filter(factors, lambda x: x["contribution"] < 0), 1, 1)
    return F.concat_ws(
        " ",
        filled(SCORE_TEXT, strength, percent_text(probability)),
        filled(STAGE_TEXT, stage_name),
        F.when(F.size(positive) > 0, filled(POSITIVE_TEXT, _named(positive))).otherwise(NO_POSITIVE_TEXT),
        F.when(F.size(negative) > 0, filled(NEGATIVE_TEXT, _named(negative))),
    )


def explained(contributed: DataFrame, probability: str = "probability_1") -> DataFrame:
    """Add ``top_factors`` and ``summary`` to rows with features, contributions and a probability."""
    return contributed.withColumn("top_factors", top_factors()).withColumn(
        "summary", summary_text(F.col(probability), F.col("top_factors"), F.col("max_funnel_order"))
    )


def factor_rows(explained_rows: DataFrame, keys: Sequence[str] = ("lead_id",)) -> DataFrame:
    """One row per factor, ranked from 1."""
    long = explained_rows.select(*keys, F.posexplode("top_factors").alias("pos", "f"))
    return long.select(*keys, (F.col("pos") + 1).alias("factor_rank"), "f.*")


# --- linear contributions -----------------------------------------------------------------------

def linear_contributions(rows: DataFrame, weights: dict[str, float], moments: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Add ``c_<feature>`` = weight · (x − mean) / deviation.

    ``rows`` holds numeric features, the source as ``source_number``. Without ``moments`` the rows'
    own means and population deviations are used, read as a scalar subquery.
    """
    def x(f: str) -> Column:
        return F.col("source_number" if f == "source" else f).cast("double")

    if moments is None:
        stats = rows.agg(F.struct(*[F.avg(x(f)).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(x(f)).alias(f"s_{f}") for f in FEATURES]))
        rows = rows.withColumn("_s", stats.scalar())
        centre = {f: (F.col(f"_s.m_{f}"), F.col(f"_s.s_{f}")) for f in FEATURES}
    else:
        centre = {f: (F.lit(m), F.lit(s)) for f, (m, s) in moments.items()}
    terms = {
        f"c_{f}": F.lit(float(weights[f])) * (x(f) - centre[f][0]) / F.when(centre[f][1] == 0, 1.0).otherwise(centre[f][1]) for f in FEATURES
    }
    return rows.withColumns(terms).drop("_s")


def logistic_contributions(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Contributions of a fitted logistic pipeline, in log-odds around the training means."""
    scaler, regression = model.stages[-2], model.stages[-1]
    weights = dict(zip(FEATURES, regression.coefficients.toArray().tolist()))
    moments = dict(zip(FEATURES, zip(scaler.mean.toArray().tolist(), scaler.std.toArray().tolist())))
    numbered = rows
    for step in model.stages[:2]:
        numbered = step.transform(numbered)
    out = linear_contributions(numbered, weights, moments)
    return out.select(*rows.columns, *CONTRIBUTIONS, F.lit(float(regression.intercept)).alias("base_value"), F.lit("log-odds").alias("space"))


# --- tree contributions -------------------------------------------------------------------------

def saved_nodes(tree_model) -> tuple[pd.DataFrame, dict[int, float]]:
    """Node table and tree weights of a fitted ensemble; bounded by trees · 2**(depth + 1) rows."""
    spark = SparkSession.active()
    path = fresh_path(spark, "trees")
    tree_model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    nodes = nodes.select(
        "treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild",
        F.col("split.featureIndex").alias("feature"), F.col("split.leftCategoriesOrThreshold").alias("threshold"),
        F.col("split.numCategories").alias("categories"),
    ).toPandas()
    weights = dict(enumerate(getattr(tree_model, "treeWeights", [])))
    return nodes, weights


def leaf_table(nodes: pd.DataFrame, tree_weights: dict[int, float], n_features: int, classifies: bool):
    """Every leaf as a box: per feature the half-open interval (low, high], its share of the cover, its value."""
    if (nodes["categories"] > 0).any():
        raise ValueError("only ordered splits are supported")
    lows, highs, shares, values = [], [], [], []
    n_trees = nodes["treeID"].nunique()
    for tree, part in nodes.groupby("treeID"):
        table = {row.id: row for row in part.itertuples()}
        cover = {i: float(np.sum(r.impurityStats) if classifies else r.impurityStats[0]) for i, r in table.items()}
        scale = 1.0 / n_trees if classifies else tree_weights[tree]
        todo = [(0, np.full(n_features, -np.inf), np.full(n_features, np.inf), np.ones(n_features))]
        while todo:
            i, low, high, share = todo.pop()
            node = table[i]
            if node.leftChild < 0:
                value = node.impurityStats[1] / np.sum(node.impurityStats) if classifies else node.prediction
                lows.append(low), highs.append(high), shares.append(share), values.append(scale * value)
                continue
            f, cut = node.feature, node.threshold[0]
            for child, side in ((node.leftChild, "left"), (node.rightChild, "right")):
                lo, hi, z = low.copy(), high.copy(), share.copy()
                if side == "left":
                    hi[f] = min(hi[f], cut)
                else:
                    lo[f] = max(lo[f], cut)
                z[f] *= cover[child] / cover[i]
                todo.append((child, lo, hi, z))
    return np.array(lows), np.array(highs), np.array(shares), np.array(values)


def pattern_tables(share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """(leaves, 2**d, d): what each of a leaf's d path features adds, for every pattern of those a row satisfies.

    For one leaf the game is multilinear: a feature multiplies the leaf's value by 1 or 0 when known and by its cover
    share when not. Its Shapley value is the integral over t in [0, 1] of the partial derivative at (t, ..., t), a
    polynomial of degree below d, which Gauss-Legendre nodes integrate exactly.
    """
    d = share.shape[1]
    held = (np.arange(2**d)[:, None] >> np.arange(d)) & 1
    gain = held - share[:, None, :]
    points, weights = np.polynomial.legendre.leggauss(d // 2 + 1)
    out = np.zeros_like(gain)
    for t, w in zip((points + 1) / 2, weights / 2):
        factor = share[:, None, :] + t * gain
        out += w * factor.prod(axis=2, keepdims=True) / factor
    return out * gain * value[:, None, None]


def shapley(x: np.ndarray, leaves, cells: int = 1 << 20) -> np.ndarray:
    """Path-dependent Shapley values, one row per row of ``x``.

    A leaf matters to the features on its path only, and to them by which of their intervals hold the row: a pattern of
    d bits, looked up in the leaf's table. Leaves with the same features are looked up together, at most ``cells``
    numbers at once.
    """
    low, high, share, value = leaves
    columns = np.ascontiguousarray(x.T)
    out = np.zeros(columns.shape)
    on_path = np.isfinite(low) | np.isfinite(high)
    paths, kind = np.unique(on_path, axis=0, return_inverse=True)
    order = np.argsort(kind.ravel(), kind="stable")
    ends = np.searchsorted(kind.ravel()[order], np.arange(len(paths) + 1))
    for path, first, end in zip(paths, ends, ends[1:]):
        names = np.flatnonzero(path)
        d = len(names)
        step = max(1, cells // (max(d, 1) * max(2**d, len(x))))
        for start in range(first, end if d else first, step):
            part = order[start : min(start + step, end)]
            tables = pattern_tables(share[part][:, names], value[part])
            pattern = (np.arange(len(part)) << d)[:, None].repeat(len(x), axis=1)
            for bit, f in enumerate(names):
                pattern |= ((columns[f] > low[part, f][:, None]) & (columns[f] <= high[part, f][:, None])).astype(np.int64) << bit
            out[names] += tables.reshape(-1, d)[pattern].sum(axis=0).T
    return out.T


def tree_contributions(model: PipelineModel, rows: DataFrame, batch: int = 4096) -> DataFrame:
    """Add ``c_<feature>``, ``base_value`` and ``space`` for a fitted forest or boosted pipeline.

    base_value + the contributions = the model's probability (forest) or its margin (boosting). The
    leaves, whose number the model's settings bound, travel to the executors as a broadcast.
    """
    ensemble = model.stages[-1]
    classifies = "RandomForest" in type(ensemble).__name__
    nodes, weights = saved_nodes(ensemble)
    leaves = leaf_table(nodes, weights, len(FEATURES), classifies)
    base = float((leaves[2].prod(axis=1) * leaves[3]).sum())
    numbered = rows
    for step in model.stages[:2]:
        numbered = step.transform(numbered)
    inputs = ["source_number" if f == "source" else f for f in FEATURES]
    carried = rows.columns
    shipped = rows.sparkSession.sparkContext.broadcast(leaves)

    def contribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start:start + batch]
                # equal rows, as of all leads without interactions, are explained once
                different, place = np.unique(part[inputs].to_numpy(dtype=float), axis=0, return_inverse=True)
                phi = shapley(different, shipped.value)[place.ravel()]
                yield pd.concat([part[carried].reset_index(drop=True), pd.DataFrame(phi, columns=CONTRIBUTIONS)], axis=1)

    wanted = numbered.select(*carried, "source_number")
    types = {f.name: f.dataType.simpleString() for f in wanted.schema.fields}
    if rows.isStreaming:
        out = wanted.mapInPandas(contribute, ", ".join([f"`{c}` {types[c]}" for c in carried] + [f"{c} double" for c in CONTRIBUTIONS]))
        return out.withColumn("base_value", F.lit(base)).withColumn("space", F.lit("probability" if classifies else "margin"))
    # equal rows are explained once, wherever they lie; a row costs a look at every leaf, so a small table is spread over the cores as well
    wanted = stage(wanted, "to-explain")
    carried = inputs
    cores = rows.sparkSession.sparkContext.defaultParallelism
    different = wanted.select(*inputs).distinct().repartition(cores * 4)
    fields = ", ".join([f"`{c}` {types[c]}" for c in inputs] + [f"{c} double" for c in CONTRIBUTIONS])
    found = stage(different.mapInPandas(contribute, fields), "contributions")
    same = reduce(and_, [F.col(f"w.{c}").eqNullSafe(F.col(f"d.{c}")) for c in inputs])
    out = wanted.alias("w").join(found.alias("d"), same).select(*[F.col(f"w.{c}") for c in rows.columns], *[F.col(f"d.{c}") for c in CONTRIBUTIONS])
    return out.withColumn("base_value", F.lit(base)).withColumn("space", F.lit("probability" if classifies else "margin"))
