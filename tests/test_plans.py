"""The three jobs end to end, from CSV files to scores."""

import pytest
from pyspark.sql import functions as F

from leadspark.constants import FEATURES
from leadspark.operators import models, scoring
from leadspark.operators.features import lead_features
from leadspark.plans import batch_scoring, exploration, training
from leadspark.session import fresh_path, shared_dir
from leadspark.sources import csv
from leadspark.sources.rolemap import read_tables

QUICK = {"Random Forest": {"trees": 5}, "Gradient Boosting": {"trees": 2}, "Column-Sampled Boosting": {"trees": 2}}


@pytest.fixture(scope="module")
def loaded(spark):
    t = read_tables(spark, "/root/testdata/sf0.01")
    leads, interactions = fresh_path(spark, "leads"), fresh_path(spark, "interactions")
    csv.write_csv(t.leads.drop("ingest_seq"), leads)
    csv.write_csv(t.interactions.withColumnRenamed("ts", "timestamp"), interactions)
    return csv.load_data(spark, leads, interactions)


def test_training_and_scoring(spark, loaded):
    out = fresh_path(spark, "out")
    trained = training.run_training(spark, *loaded, out, QUICK)
    assert trained.rows.count() == 1500 and trained.test.count() == 300
    document = spark.read.json(f"{out}/metrics").first()
    assert len(document["models"]) == 4 and 0 <= document["cv_f1_mean"] <= 1
    assert spark.read.parquet(f"{out}/confusion_matrix").agg(F.sum("n")).first()[0] == 300
    assert spark.read.parquet(f"{out}/feature_importance").count() == len(FEATURES)

    candidate, info = models.load_model(f"{out}/model")
    rows = scoring.accepted_requests(lead_features(*loaded).select("lead_id", *FEATURES), info["source_values"])
    for which in trained.candidates[:2]:
        explained = batch_scoring.explain_rows(which.model, rows)
        assert explained.where(F.size("top_factors") == 5).count() == 1500
    assert scoring.batch_score(candidate.model, rows).count() == 1500


def test_exploration(loaded):
    tables = exploration.report(*loaded)
    assert len(tables) > 30
    for name in ("conversion_by_source", "duplicate_rows", "correlation_matrix", "quartile_conversion"):
        assert tables[name]().count() > 0
    assert tables["conversion_summary"]().first()["n_converted"] == 69


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    assert shared_dir(spark) == shared_dir(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "yarn")
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError):
            shared_dir(spark)
