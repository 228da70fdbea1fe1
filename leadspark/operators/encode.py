"""Category codes, split, folds, class weights, scaling: what stands between features and models."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadspark.constants import FEATURES, FOLDS, LABEL_DEFINING, SEED, TEST_SHARE, TRAIN_CATEGORICALS
from leadspark.functions.ordered import hash_cut, hash_ranks, seeded_hash
from leadspark.functions.scalars import present
from leadspark.session import stage

# The functions below travel to the executors by value, so those need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fit_encoders(df: DataFrame, columns: Sequence[str] = TRAIN_CATEGORICALS) -> StringIndexerModel:
    """Sorted distinct texts → 0..k−1 for each column present, all fitted in one pass."""
    names = present(df, columns)
    return StringIndexer(
        inputCols=names, outputCols=[f"{c}_code" for c in names], stringOrderType="alphabetAsc", handleInvalid="error"
    ).fit(df)


def label_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, label, code): the different texts of each column in order, from 0; null labels have no code.

    Labels are sorted over partitions by range; a code is the number of the column's labels in the partitions before
    plus the place inside, so no list of labels is ever in one place.
    """
    long = df.select(*columns).unpivot([], list(columns), "column", "label").where("label IS NOT NULL").distinct()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, column, place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for name in batch.column(0).to_pylist():
                column, place = name, place + 1 if name == column else 0
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places)), pa.array(places)], names=["column", "label", "part", "place"])

    ranged = long.repartitionByRange("column", "label").sortWithinPartitions("column", "label")
    placed = stage(ranged.mapInArrow(number, "column string, label string, part long, place long"), "labels")
    sizes = placed.groupBy("column", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("column").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("column", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, ["column", "part"]).select("column", "label", (F.col("start") + F.col("place")).cast("int").alias("code"))


def label_encode(df: DataFrame, columns: Sequence[str] = TRAIN_CATEGORICALS) -> DataFrame:
    """Replace each category by its code, a rank among the column's different texts; nulls stay."""
    names = present(df, columns)
    codes = stage(label_codes(df, names), "codes")
    out = df
    for c in names:
        own = codes.where(F.col("column") == c).select(F.col("label").alias("_label"), F.col("code").alias("_code"))
        out = out.join(own, F.col(c) == F.col("_label"), "left").select(*[F.col("_code").alias(c) if x == c else F.col(x) for x in out.columns])
    return out


def feature_stages() -> list:
    """Pipeline stages from a feature table to the ``features`` vector.

    Adding 0.0 to the source code drops its category metadata, so that trees order the codes as
    numbers.
    """
    inputs = ["source_number" if c == "source" else c for c in FEATURES]
    return [
        StringIndexer(inputCol="source", outputCol="source_code", stringOrderType="alphabetAsc", handleInvalid="error"),
        SQLTransformer(statement="SELECT *, source_code + 0.0D AS source_number FROM __THIS__"),
        VectorAssembler(inputCols=inputs, outputCol="features"),
    ]


def model_matrix(features: DataFrame) -> DataFrame:
    """lead_id, label and the assembled vector."""
    assembled = Pipeline(stages=feature_stages()).fit(features).transform(features)
    return assembled.select("lead_id", F.col("converted").cast("double").alias("label"), "features")


def stratified_split(df: DataFrame, label: str = "converted", key: str = "lead_id", share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``is_test``: exactly round(share · n) rows of each class, those of the least seeded hashes of the key.

    The last chosen hash of each class is found first, so the split is a comparison: rows are neither sorted nor moved.
    """
    rows = stage(df, "to-split")
    last = hash_cut(rows, key, label, seed, share)
    last = stage(last.select(F.col(label).alias("_class"), F.struct("hash", key).alias("_last")), "split-at")
    split = rows.join(last, F.col(label).eqNullSafe(F.col("_class")), "left")
    here = F.struct(seeded_hash(key, seed).alias("hash"), F.col(key))
    return split.withColumn("is_test", F.coalesce(here <= F.col("_last"), F.lit(False))).drop("_class", "_last")


def stratified_folds(df: DataFrame, label: str = "converted", key: str = "lead_id", folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold`` 0..folds−1, each class dealt out evenly."""
    ranked = hash_ranks(df, key, label, seed)
    return ranked.withColumn("fold", ((F.col("rn") - 1) % folds).cast("int")).drop("rn", "n_class")


def class_weights(df: DataFrame, label: str = "converted") -> DataFrame:
    """Balanced weight per class: n / (classes · n of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_rows"))
    whole = counts.agg(F.struct(F.sum("n_rows").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.withColumn("_all", whole).select(
        label, "n_rows", (F.col("_all.n") / (F.col("_all.k") * F.col("n_rows"))).alias("weight")
    )


def with_weights(df: DataFrame, label: str = "converted") -> DataFrame:
    """Add ``weight``; the joined table has one row per class."""
    return df.join(F.broadcast(class_weights(df, label).select(label, "weight")), label)


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean 0 and population deviation 1; a constant column becomes 0."""
    moments = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])).scalar()
    scaled = df.withColumn("_s", moments)
    return scaled.withColumns({
        c: (F.col(c) - F.col(f"_s.m_{c}")) / F.when(F.col(f"_s.s_{c}") == 0, 1.0).otherwise(F.col(f"_s.s_{c}")) for c in columns
    }).drop("_s")


def leak_check(df: DataFrame) -> DataFrame:
    """Each model feature of ``df`` and whether it would leak the label; none may."""
    spark = df.sparkSession
    rows = [(c, c in df.columns, c in LABEL_DEFINING) for c in FEATURES]
    return spark.createDataFrame(rows, "feature string, is_present boolean, is_leak boolean")
