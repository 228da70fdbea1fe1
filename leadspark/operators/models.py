"""Candidate models, their selection, cross-validation, importance and persistence."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.constants import FEATURES, FOLDS, MODEL_SETTINGS, SEED
from leadspark.operators import logistic, trees
from leadspark.operators.encode import feature_stages, stratified_folds, stratified_split
from leadspark.operators.metrics import auc_roc, classification_metrics, select_best
from leadspark.session import stage, unstage

LABEL = "converted"
LOGISTIC = "Logistic Regression"


def _forest(settings: dict) -> trees.Spec:
    return trees.Spec(
        "forest", settings["trees"], settings["depth"], per_node=int(len(FEATURES) ** 0.5), min_leaf=settings["min_leaf"], seed=SEED,
    )


def _boosting(settings: dict) -> trees.Spec:
    return trees.Spec("first", settings["trees"], settings["depth"], rate=settings["rate"], rows=settings["rows"], seed=SEED)


def _column_sampled(settings: dict) -> trees.Spec:
    return trees.Spec(
        "second", settings["trees"], settings["depth"], rate=settings["rate"], rows=settings["rows"], columns=settings["columns"],
        ridge=1.0, min_weight=1.0, seed=SEED + 1,
    )


# in order of training; the logistic regression has no trees
BUILDERS: dict[str, Callable[[dict], trees.Spec] | None] = {
    LOGISTIC: None,
    "Random Forest": _forest,
    "Gradient Boosting": _boosting,
    "Column-Sampled Boosting": _column_sampled,
}


@dataclass(frozen=True)
class Candidate:
    """A fitted pipeline and its name."""

    name: str
    model: PipelineModel


def in_parallel(jobs: Sequence[Callable], width: int = 4) -> list:
    """Run independent Spark jobs at the same time; Spark schedules their tasks together."""
    wrap = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=max(1, min(width, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(wrap(job)) for job in jobs]]


def training_rows(features: DataFrame) -> DataFrame:
    """Only what the models read, staged once."""
    return stage(features.select("lead_id", LABEL, *FEATURES), "training-rows")


def _settings(name: str, settings: dict[str, dict] | None) -> dict:
    return {**MODEL_SETTINGS[name], **((settings or {}).get(name) or {})}


def fit_many(names: Sequence[str], train: DataFrame, settings: dict[str, dict] | None = None) -> list[Candidate]:
    """Fit candidates on rows holding the features and the label; those of trees share every pass over the rows."""
    spark = train.sparkSession
    prepared = Pipeline(stages=feature_stages()).fit(train)
    vectors = prepared.transform(train)
    grown = [n for n in names if n != LOGISTIC]
    fitted: dict[str, list] = {}

    def linear() -> None:
        s = _settings(LOGISTIC, settings)
        rows = logistic.read_rows(vectors, LABEL)
        fitted[LOGISTIC] = logistic.as_stages(spark, logistic.fit_logistic(rows, len(FEATURES), c=s["c"], steps=s["max_iter"])[0], LABEL)
        unstage(rows)

    def forests() -> None:
        specs = [BUILDERS[n](_settings(n, settings)) for n in grown]
        data = trees.bin_rows(vectors, len(FEATURES), LABEL)
        for name, spec, found in zip(grown, specs, trees.fit_trees(data, specs)):
            fitted[name] = [trees.as_model(spark, data, spec, found, LABEL)]
        unstage(data.rows)

    in_parallel([*([linear] if LOGISTIC in names else []), *([forests] if grown else [])])
    return [Candidate(n, PipelineModel([*prepared.stages, *fitted[n]])) for n in names]


def fit(name: str, train: DataFrame, settings: dict | None = None) -> Candidate:
    """Fit one candidate."""
    return fit_many([name], train, {name: settings or {}})[0]


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``prediction`` (the likelier class) and ``probability_1``; the rows keep their columns."""
    out = model.transform(rows)
    return out.select(*rows.columns, F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability")[1].alias("probability_1"))


def _scored_union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def evaluate(candidates: Sequence[Candidate], test: DataFrame) -> DataFrame:
    """One row per candidate: accuracy, precision, recall, F1, AUC; all from one pass over the scores."""
    parts = [
        score(c.model, test).select(F.lit(i).alias("position"), F.lit(c.name).alias("model"), LABEL, "prediction", "probability_1")
        for i, c in enumerate(candidates)
    ]
    scored = stage(_scored_union(parts), "scored")
    by = ["position", "model"]
    return classification_metrics(scored, by).join(auc_roc(scored, by), by).orderBy("position")


@dataclass(frozen=True)
class Training:
    """Everything a training run yields; ``leaderboard`` is a table, the rest are handles."""

    rows: DataFrame
    train: DataFrame
    test: DataFrame
    candidates: list[Candidate]
    leaderboard: DataFrame
    best: Candidate


def split_rows(features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All training rows, and their 80 % and 20 % parts."""
    rows = training_rows(features)
    split = stage(stratified_split(rows, LABEL), "split")
    return rows, split.where("NOT is_test").drop("is_test"), split.where("is_test").drop("is_test")


def train_models(features: DataFrame, settings: dict[str, dict] | None = None, names: Sequence[str] | None = None) -> Training:
    """Fit the candidates side by side and pick the one with the best F1 on the held-out rows."""
    rows, train, test = split_rows(features)
    candidates = fit_many(list(names or BUILDERS), train, settings)
    leaderboard = stage(evaluate(candidates, test), "leaderboard")
    best = select_best(leaderboard).first()["model"]
    return Training(rows, train, test, candidates, leaderboard, next(c for c in candidates if c.name == best))


def cv_f1(name: str, rows: DataFrame, settings: dict | None = None) -> DataFrame:
    """F1 of class 1 on each of the stratified folds; the fits of all folds share every pass over the rows."""
    folded = stage(stratified_folds(rows, LABEL), "folds")
    vectors = Pipeline(stages=feature_stages()).fit(folded).transform(folded)
    s = _settings(name, {name: settings})
    if name == LOGISTIC:
        read = logistic.read_rows(vectors, LABEL, "fold")
        scored = logistic.predict_held(read, logistic.fit_logistic(read, len(FEATURES), range(FOLDS), s["c"], s["max_iter"]))
    else:
        data = trees.bin_rows(vectors, len(FEATURES), LABEL, part="fold")
        specs = [replace(BUILDERS[name](s), held=fold) for fold in range(FOLDS)]
        scored = trees.predict_held(data, specs, trees.fit_trees(data, specs))
    return classification_metrics(scored, ["fold"], digits=16).select("fold", "f1").where(F.col("fold").isNotNull())


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation over the folds."""
    return folds.agg(F.avg("f1").alias("cv_f1_mean"), F.stddev_pop("f1").alias("cv_f1_std"))


def feature_importance(spark: SparkSession, model: PipelineModel, top: int = 15) -> DataFrame:
    """|coefficient| for the logistic model, impurity decrease for trees; largest first."""
    last = model.stages[-1]
    weights = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(f, abs(float(w))) for f, w in zip(FEATURES, weights.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


# --- persistence --------------------------------------------------------------------------------

def source_values(model: PipelineModel) -> list[str]:
    """The sources the model knows, sorted; position is code."""
    return list(model.stages[0].labels)


def save_model(candidate: Candidate, path: str) -> None:
    """The pipeline, and beside it a one-row JSON table with what a reader needs to use it."""
    spark = SparkSession.active()
    candidate.model.write().overwrite().save(f"{path}/pipeline")
    info = {"model": candidate.name, "feature_names": FEATURES, "source_values": source_values(candidate.model)}
    spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def load_model(path: str) -> tuple[Candidate, dict]:
    """What :func:`save_model` wrote."""
    info = json.loads(SparkSession.active().read.text(f"{path}/info").first()["value"])
    return Candidate(info["model"], PipelineModel.load(f"{path}/pipeline")), info


def model_card(spark: SparkSession, candidate: Candidate) -> DataFrame:
    """Name, type, features and allowed sources of a loaded model."""
    row = (candidate.name, type(candidate.model.stages[-1]).__name__, len(FEATURES), FEATURES, source_values(candidate.model))
    return spark.createDataFrame([row], "model string, model_type string, feature_count int, features array<string>, supported_sources array<string>")
