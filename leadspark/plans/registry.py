"""Every query by name: a function of (session, data folder) that returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.constants import EXPLORE_CATEGORICALS, FEATURES, MEDIAN_COLUMNS, MODERATE_FROM, STRONG_FROM, TRAIN_CATEGORICALS
from leadspark.functions.scalars import flag_to_int, funnel_order, number_text, parse_ts, present
from leadspark.functions.stats import box_stats
from leadspark.operators import cleaning, encode, explain, explore, features, kept, labels, logistic, metrics, models, quality, scoring
from leadspark.session import fresh_path, stage
from leadspark.sources import csv, sinks
from leadspark.sources.rolemap import ORDER_EVENTS_SQL, LeadTables, read_tables
from leadspark.streaming import alerts
from leadspark.streaming import scoring as streaming

Query = Callable[[SparkSession, str], DataFrame]
STREAM_BATCHES = 4
MEASURES = ["accuracy", "precision", "recall", "f1", "auc_roc"]

# What was fitted in this session: (application, data, what) to the fit. Queries over the same data share fits.
_FITTED: dict[tuple[str, str, str], object] = {}

# A fixed linear model, so that scoring and explanation have results another engine can check.
EXAMPLE_INTERCEPT = -0.5
EXAMPLE_WEIGHTS = {
    "source": -0.05,
    "session_count": 0.3,
    "total_events": 0.4,
    "total_time_seconds": 0.25,
    "pricing_page_views": 0.2,
    "webinar_registrations": 0.35,
    "max_funnel_order": 0.6,
    "total_clicks": 0.15,
    "engagement_span_days": 0.3,
    "days_since_last_visit": -0.25,
    "avg_session_gap_days": -0.2,
}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since the order of summation differs between runs and engines."""
    return df.select(*[
        F.round(f"`{f.name}`", digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields
    ])


def _on(build: Callable[[LeadTables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(read_tables(spark, sf_dir))


# --- inputs shared by several queries -----------------------------------------------------------

def feature_table(t: LeadTables) -> DataFrame:
    return features.lead_features(t.leads, t.interactions)


def model_table(t: LeadTables) -> DataFrame:
    """Features of the models. Neither medians nor the rest of the profile are needed for them."""
    profile = cleaning.fill_unknown(cleaning.dedup_first(t.leads), ["source"]).select("lead_id", "source")
    joined = features.join_activity(profile, features.interaction_features(t.interactions))
    joined = joined.withColumn("converted", F.coalesce("is_converted", F.lit(0))).fillna(0, subset=[f for f in FEATURES if f != "source"])
    return rounded(cleaning.model_features(joined))


def label_table(t: LeadTables) -> DataFrame:
    return stage(labels.lead_labels(t.leads, t.interactions).select("lead_id", "converted"), "labels")


def example_scores(t: LeadTables) -> DataFrame:
    """Leads with a probability from a fixed formula over two features."""
    margin = 0.4 * F.col("max_funnel_order") + 0.02 * F.col("total_events") - 3.0
    scored = model_table(t).select("lead_id", "converted", F.round(1 / (1 + F.exp(-margin)), 9).alias("probability_1"))
    return scored.withColumn("prediction", (F.col("probability_1") > 0.5).cast("int"))


def example_contributions(t: LeadTables) -> DataFrame:
    """Model features with the contributions and probability of the fixed linear model."""
    table = stage(model_table(t), "model-table")
    numbered = encode.fit_encoders(table, ["source"]).transform(table).withColumn("source_number", F.col("source_code") + F.lit(0.0))
    out = explain.linear_contributions(numbered, EXAMPLE_WEIGHTS)
    margin = sum((F.col(c) for c in explain.CONTRIBUTIONS), F.lit(EXAMPLE_INTERCEPT))
    return out.withColumn("probability_1", 1 / (1 + F.exp(-margin)))


def example_requests(t: LeadTables) -> DataFrame:
    """Scoring requests as text, some with an unknown source, some with numbers that are none."""
    source = F.when(F.col("lead_id") % 10 == 3, "Billboard").otherwise(F.col("source"))
    events = F.when(F.col("lead_id") % 10 == 4, "many").otherwise(F.col("total_events").cast("string"))
    sessions = F.when(F.col("lead_id") % 10 == 5, "2.5").otherwise(F.col("session_count").cast("string"))
    sessions = F.when(F.col("lead_id") % 10 == 6, "NaN").when(F.col("lead_id") % 10 == 7, "-Infinity").otherwise(sessions)
    return model_table(t).withColumns({"source": source, "total_events": events, "session_count": sessions})


def _once(t: LeadTables, what: str, make: Callable[[], object]):
    key = (t.leads.sparkSession.sparkContext.applicationId, t.origin, what)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def _train(t: LeadTables, names: list[str] | None = None) -> models.Training:
    """The candidates with their full settings, each fitted once."""
    names = list(names or models.BUILDERS)
    rows, train, test = _once(t, "split", lambda: models.split_rows(model_table(t)))
    missing = [n for n in names if (t.leads.sparkSession.sparkContext.applicationId, t.origin, n) not in _FITTED]
    for candidate in models.fit_many(missing, train) if missing else []:
        _once(t, candidate.name, lambda c=candidate: c)
    candidates = [_once(t, n, lambda: None) for n in names]
    leaderboard = _once(t, "leaderboard " + ", ".join(names), lambda: stage(models.evaluate(candidates, test), "leaderboard"))
    best = metrics.select_best(leaderboard).first()["model"]
    return models.Training(rows, train, test, candidates, leaderboard, next(c for c in candidates if c.name == best))


def _folds(t: LeadTables) -> DataFrame:
    """The winner's F1 per fold."""
    trained = _train(t)
    return _once(t, "folds", lambda: stage(models.cv_f1(trained.best.name, trained.rows), "fold-scores"))


def _one_model(name: str) -> Query:
    return _on(lambda t: checked_board(_train(t, [name])))


# --- queries with more than one step ------------------------------------------------------------

def csv_ingest(t: LeadTables, which: str) -> DataFrame:
    """Write one table as CSV and read it back through the schema, typed and cleaned."""
    spark = t.leads.sparkSession
    source = t.leads.drop("ingest_seq") if which == "leads" else t.interactions.withColumnRenamed("ts", "timestamp")
    path = fresh_path(spark, f"csv-{which}")
    csv.write_csv(source, path)
    schema = csv.LEADS_SCHEMA if which == "leads" else csv.INTERACTIONS_SCHEMA
    return rounded(csv.read_csv(spark, path, schema).drop("ingest_seq"))


def parse_ts_coerce(t: LeadTables) -> DataFrame:
    """Timestamps written as text, every 97th of them spoiled, read back."""
    text = F.when(F.col("interaction_id") % 97 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    return t.interactions.select("interaction_id", parse_ts(text).alias("ts"))


def return_flag_normalise(t: LeadTables) -> DataFrame:
    """Flags in the spellings that occur, and none, normalised."""
    texts = ["true", "True", "yes", "no", "FALSE", "1", "maybe"]
    raw = F.when(F.col("interaction_id") % 8 == 7, None)
    for i, x in enumerate(texts):
        raw = raw.when(F.col("interaction_id") % 8 == i, x)
    return t.interactions.select("interaction_id", raw.alias("flag_text")).withColumn("flag", flag_to_int("flag_text"))


def numeric_table(t: LeadTables) -> DataFrame:
    table = feature_table(t)
    coded = encode.label_encode(table, TRAIN_CATEGORICALS)
    return rounded(cleaning.numeric_projection(cleaning.drop_model_excluded(coded.withColumn("lead", F.col("lead_id")))))


def model_matrix(t: LeadTables) -> DataFrame:
    """The feature vectors, entry by entry in the order of the features."""
    vectors = encode.model_matrix(model_table(t))
    cells = vector_to_array("features")
    return rounded(vectors.select("lead_id", *[cells[i].alias(f"x_{f}") for i, f in enumerate(FEATURES)]))


def metrics_document(t: LeadTables) -> DataFrame:
    """The metrics document, written and read back: a row per model in its order, with what must hold of its numbers."""
    spark = t.leads.sparkSession
    trained = _train(t)
    cv = models.cv_summary(_folds(t))
    path = fresh_path(spark, "metrics")
    sinks.save_metrics(sinks.metrics_document(trained.leaderboard, cv), path)
    document = spark.read.schema(
        "models array<struct<model:string,accuracy:double,precision:double,recall:double,f1:double,auc_roc:double>>, cv_f1_mean double, cv_f1_std double"
    ).json(path)
    rows = document.select(F.posexplode("models").alias("position", "m"), "cv_f1_mean", "cv_f1_std").select("position", "m.*", "cv_f1_mean", "cv_f1_std")
    same = rows.join(trained.leaderboard.select("position", *[F.col(c).alias(f"own_{c}") for c in MEASURES]), "position")
    kept = F.lit(True)
    for c in MEASURES:
        kept = kept & F.col(c).eqNullSafe(F.col(f"own_{c}"))
    # the mean of five shares deviates by half at most
    spread = F.col("cv_f1_mean").between(0, 1) & F.col("cv_f1_std").between(0, 0.5)
    return same.select("position", "model", kept.alias("as_measured"), spread.alias("cv_in_range"))


def _saved_forest(t: LeadTables) -> tuple[models.Training, models.Candidate, dict]:
    trained = _train(t, ["Random Forest"])
    path = fresh_path(t.leads.sparkSession, "model")
    models.save_model(trained.best, path)
    loaded, info = models.load_model(path)
    return trained, loaded, info


def model_roundtrip(t: LeadTables) -> DataFrame:
    """For every row whether a model gives the same probability before saving and after loading."""
    trained, loaded, _ = _saved_forest(t)
    before = models.score(trained.best.model, trained.rows.where("lead_id IS NOT NULL")).select("lead_id", *FEATURES, F.col("probability_1").alias("before"))
    return models.score(loaded.model, before).select("lead_id", (F.col("before") == F.col("probability_1")).alias("same"))


def banded(scored: DataFrame) -> DataFrame:
    """Per scored lead whether its probability and its bands agree; scores within rounding of a border agree with either."""
    p, near = F.col("conversion_probability"), 0.0001

    def agrees(column: str, value: str, holds, *borders: float):
        close = F.lit(False)
        for b in borders:
            close = close | (F.abs(p - b) <= near)
        return close | ((F.col(column) == value) == holds)

    sure = F.greatest(p, 1 - p)
    bands = agrees("prediction", "ACCEPT", p >= 0.5, 0.5) & agrees("confidence", "high", sure >= 0.85, 0.85, 0.15) & agrees("risk_level", "low", p >= 0.8, 0.8)
    return scored.select("lead_id", p.between(0, 1).alias("in_range"), bands.alias("bands_agree"))


def batch_score(t: LeadTables) -> DataFrame:
    """Every lead's bands, and whether converted leads score higher in the mean, which no constant score does."""
    trained = _train(t, ["Random Forest"])
    scored = stage(scoring.batch_score(trained.best.model, trained.rows, ("lead_id", "converted")), "scores")
    mean = {y: F.avg(F.when(F.col("converted") == y, F.col("conversion_probability"))) for y in (0, 1)}
    apart = scored.agg((mean[1] > mean[0]).alias("separates")).scalar()
    return banded(scored).withColumn("separates", apart)


def forest_importance(t: LeadTables) -> DataFrame:
    """Per feature whether its importance is a share, whether all add up to one, and whether none above is smaller."""
    model = _train(t, ["Random Forest"]).best.model
    found = models.feature_importance(t.leads.sparkSession, model).withColumn("at", F.monotonically_increasing_id())
    whole, order = W.partitionBy(), W.partitionBy().orderBy("at")  # one row per feature
    return found.select(
        "feature", F.col("importance").between(0, 1).alias("is_share"), (F.abs(F.sum("importance").over(whole) - 1) < 1e-6).alias("adds_up"),
        F.coalesce(F.col("importance") <= F.lag("importance").over(order), F.lit(True)).alias("in_order"),
    )


def fold_scores(t: LeadTables) -> DataFrame:
    """Per fold how many leads of each class it holds, and whether the winner's F1 there is a share."""
    dealt = encode.stratified_folds(_train(t).rows).groupBy("fold").agg(F.count_if(F.col("converted") == 0).alias("n_0"), F.count_if(F.col("converted") == 1).alias("n_1"))
    return _folds(t).join(dealt, "fold").select("fold", "n_0", "n_1", F.col("f1").between(0, 1).alias("in_range"))


def checked_board(trained: models.Training) -> DataFrame:
    """Per model its place, the test rows of each class, whether every measure is a share, F1 follows from precision and
    recall, accuracy from them and the counts, and the ranking beats chance, as no constant score does, given ten converted."""
    board = trained.leaderboard
    counts = trained.test.agg(F.struct(F.count_if(F.col("converted") == 0).alias("n_0"), F.count_if(F.col("converted") == 1).alias("n_1"))).scalar()
    share = F.lit(True)
    for c in MEASURES:
        share = share & F.coalesce(F.col(c).between(0, 1), F.lit(c == "auc_roc"))
    both = F.col("precision") + F.col("recall")
    mean = F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both)
    # recall gives the true positives, and the wrong rows are those missed and those wrongly called
    hits = F.round(F.col("recall") * F.col("n_1"))
    false_calls = F.when(F.col("precision") > 0, hits / F.col("precision") - hits)
    right = 1 - (F.col("n_1") - hits + false_calls) / (F.col("n_0") + F.col("n_1"))
    return board.withColumn("_n", counts).select("*", "_n.*").select(
        "position", "model", "n_0", "n_1", share.alias("in_range"), (F.abs(F.col("f1") - mean) < 2e-4).alias("f1_follows"),
        F.coalesce(F.abs(F.col("accuracy") - right) < 2e-3, F.lit(True)).alias("accuracy_follows"),
        ((F.col("n_1") < 10) | (F.col("auc_roc") > 0.5)).alias("beats_chance"),
    )


def score_stream(t: LeadTables) -> DataFrame:
    """Requests, bad ones among them, scored as a file stream; what the table of the valid ones holds, and whether a
    batch over the same requests gives every lead the same."""
    spark = t.leads.sparkSession
    trained = _train(t, ["Random Forest"])
    inbox, out, bad, log = (fresh_path(spark, name) for name in ("stream-in", "stream-out", "stream-rejected", "stream-log"))
    example_requests(t).select("lead_id", *FEATURES).write.parquet(inbox)
    requests = spark.read.parquet(inbox)
    for query in streaming.score_stream(trained.best.model, streaming.read_feature_stream(spark, inbox, requests.schema), out, bad, log):
        query.awaitTermination()
    batch = scoring.batch_score(trained.best.model, scoring.accepted_requests(requests, models.source_values(trained.best.model)))
    batch = batch.select("lead_id", F.struct(*scoring.BANDS).alias("batch"))
    arrived = spark.read.parquet(out)
    # sizes of files, compressed, say little of rows: never broadcast
    same = arrived.join(batch.hint("merge"), "lead_id").select("lead_id", (F.struct(*scoring.BANDS) == F.col("batch")).alias("same_as_batch"))
    return banded(arrived).join(same.hint("merge"), "lead_id")


def alerts_of_stream(t: LeadTables) -> DataFrame:
    """Third pricing views as a stream finds them over files that hold the interactions in no order."""
    spark = t.leads.sparkSession
    inbox, out, log = (fresh_path(spark, name) for name in ("events-in", "alerts", "alerts-log"))
    columns = t.interactions.select("interaction_id", "lead_id", "page_name", "ts")
    # every batch is written and read by all cores
    cores = spark.sparkContext.defaultParallelism
    columns.repartition(STREAM_BATCHES * cores, F.xxhash64("interaction_id")).write.parquet(inbox)
    stream = streaming.read_feature_stream(spark, inbox, columns.schema, files_per_trigger=cores)
    # no event is late, as every file holds events of the whole time
    alerts.write_alerts(alerts.pricing_alerts(stream, delay="36500 days"), out, log).awaitTermination()
    return alerts.current_alerts(spark, out)


def features_kept(t: LeadTables) -> DataFrame:
    """The feature table from stored partials, after an increment of the days up to one, one of the days after it, and
    the first again."""
    spark = t.leads.sparkSession
    store, small = fresh_path(spark, "kept"), fresh_path(spark, "kept-merged")
    early = F.coalesce(F.dayofmonth("ts") <= 15, F.lit(True))
    for name, part in (("early", early), ("late", ~early), ("early", early)):
        kept.add_increment(store, name, t.interactions.where(part))
    kept.compact(spark, store, small)
    return rounded(kept.kept_features(spark, t.leads, small))


def explain_tree(t: LeadTables) -> DataFrame:
    """Shapley contributions of a forest for every row: whether they and the base value add up to the probability."""
    trained = _train(t, ["Random Forest"])
    found = explain.tree_contributions(trained.best.model, models.score(trained.best.model, trained.rows))
    total = sum((F.col(c) for c in explain.CONTRIBUTIONS), F.col("base_value"))
    return found.select("lead_id", "space", (F.abs(total - F.col("probability_1")) < 1e-6).alias("adds_up"))


def _fitted_explanations(t: LeadTables, name: str) -> DataFrame:
    """Every lead with the probability, contributions, factors and summary of a fitted model."""
    model = _train(t, [name]).best.model
    rows = models.score(model, _train(t, [name]).rows)
    found = explain.logistic_contributions(model, rows) if name == models.LOGISTIC else explain.tree_contributions(model, rows)
    return _once(t, f"explained {name}", lambda: stage(explain.explained(found), "explained"))


def fitted_factors(t: LeadTables, name: str) -> DataFrame:
    """The ranked factors of a fitted model for every lead: whether each is a feature with the lead's own value, has the
    direction of its sign and a contribution no larger than the one above."""
    rows = _fitted_explanations(t, name).where("lead_id IS NOT NULL")
    own = F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f).cast("string") if f == "source" else number_text(f))])
    # the factor above stands in the same row: nothing is joined or shuffled
    long = rows.select("lead_id", "top_factors", own.alias("own"), F.posexplode("top_factors").alias("pos", "f"))
    above = F.abs(F.try_element_at("top_factors", F.when(F.col("pos") > 0, F.col("pos")))["contribution"])
    contribution = F.col("f.contribution")
    return long.select(
        "lead_id", (F.col("pos") + 1).alias("factor_rank"), (F.col("f.value") == F.try_element_at("own", F.col("f.feature"))).alias("own_value"),
        F.when(F.abs(contribution) < 1e-4, True).otherwise((contribution > 0) == (F.col("f.direction") == "increases")).alias("direction_follows"),
        F.coalesce(F.abs(contribution) <= above, F.lit(True)).alias("ranked"),
    )


def fitted_summary(t: LeadTables, name: str) -> DataFrame:
    """The sentence for every lead by a fitted model: the funnel stage as named, and whether score and strength agree."""
    rows = _fitted_explanations(t, name)
    p = F.col("probability_1")
    strength = F.regexp_extract("summary", "^This lead has a (\\w+) conversion probability of (\\d+)%", 1)
    percent = F.regexp_extract("summary", "^This lead has a (\\w+) conversion probability of (\\d+)%", 2).cast("int")
    return rows.select(
        "lead_id", F.regexp_extract("summary", "reached the (\\w+) stage", 1).alias("funnel_stage"), (F.abs(percent - 100 * p) <= 0.5 + 1e-9).alias("percent_agrees"),
        (strength == F.when(p >= STRONG_FROM, "strong").when(p >= MODERATE_FROM, "moderate").otherwise("low")).alias("strength_agrees"),
    )


def logistic_gradient(t: LeadTables) -> DataFrame:
    """Per coefficient of the logistic regression over all leads the gradient of its penalised loss, which is zero where
    the loss is least, and the leads of each class, weighted alike."""
    spark = t.leads.sparkSession
    rows, _, _ = _once(t, "split", lambda: models.split_rows(model_table(t)))
    vectors = Pipeline(stages=encode.feature_stages()).fit(rows).transform(rows)
    read = logistic.read_rows(vectors)
    fit = logistic.fit_logistic(read, len(FEATURES))[0]
    slope = logistic.gradient(read, [fit])[0]
    n = vectors.agg(F.count_if(F.col("converted") == 0), F.count_if(F.col("converted") == 1)).first()
    out = [(name, round(float(g), 4) + 0.0, bool(abs(b) < 50), n[0], n[1]) for name, g, b in zip([*FEATURES, "intercept"], slope, fit.beta)]
    return spark.createDataFrame(out, "coefficient string, gradient double, bounded boolean, n_0 long, n_1 long")


def model_card(t: LeadTables) -> DataFrame:
    card = models.model_card(t.leads.sparkSession, _saved_forest(t)[1])
    return card.select("model", "model_type", "feature_count", F.array_join("features", ", ").alias("features"), F.array_join("supported_sources", ", ").alias("supported_sources"))


QUERIES: dict[str, Query] = {
    # sources and sinks
    "csv_ingest": _on(lambda t: csv_ingest(t, "leads")),
    "csv_ingest_interactions": _on(lambda t: csv_ingest(t, "interactions")),
    "table_shape": _on(lambda t: quality.table_shape({"leads": t.leads, "interactions": t.interactions})),
    "schema_listing": _on(lambda t: quality.schema_listing({"leads": t.leads, "interactions": t.interactions})),
    "preview_head": _on(lambda t: quality.preview(t.leads, "ingest_seq")),
    "preview_head_interactions": _on(lambda t: rounded(quality.preview(t.interactions, "interaction_id"))),
    "metrics_document": _on(metrics_document),
    "model_roundtrip": _on(model_roundtrip),
    "model_card": _on(model_card),
    # quality
    "null_counts_leads": _on(lambda t: quality.null_counts(t.leads)),
    "null_counts_interactions_top10": _on(lambda t: quality.null_counts(t.interactions, top=10)),
    "missing_cells_total": _on(lambda t: quality.missing_cells(t.leads)),
    "null_counts_after_impute": _on(lambda t: quality.null_counts(cleaning.exploration_imputed(t.leads))),
    "duplicate_summary": _on(lambda t: quality.duplicate_summary(t.leads)),
    "duplicate_rows": _on(lambda t: quality.duplicate_rows(t.leads, n=6)),
    "employee_count_describe": _on(lambda t: quality.describe_column(cleaning.exploration_leads(t.leads), "employee_count")),
    "employee_count_box": _on(lambda t: box_stats(cleaning.exploration_leads(t.leads), "employee_count")),
    "employee_count_box_log": _on(
        lambda t: box_stats(cleaning.exploration_leads(t.leads).withColumn("log_count", F.log1p("employee_count")), "log_count")
    ),
    "interaction_time_range": _on(lambda t: quality.time_range(t.interactions)),
    "interactions_before_creation": _on(
        lambda t: quality.before_creation(t.leads, t.interactions).select("interaction_id", "lead_id", "ts", "created_at")
    ),
    # cleaning
    "dedup_leads_first": _on(lambda t: cleaning.dedup_first(t.leads)),
    "fill_unknown": _on(lambda t: cleaning.fill_unknown(t.leads)),
    "fill_unknown_exploration": _on(lambda t: cleaning.fill_unknown(t.leads, EXPLORE_CATEGORICALS)),
    "impute_median_train": _on(lambda t: cleaning.impute_medians(cleaning.dedup_first(t.leads)).select("lead_id", *MEDIAN_COLUMNS)),
    "impute_median_eda": _on(lambda t: cleaning.exploration_imputed(t.leads).select("lead_id", "ingest_seq", *MEDIAN_COLUMNS)),
    "parse_ts_coerce": _on(parse_ts_coerce),
    "funnel_order_train": _on(lambda t: t.interactions.select("interaction_id", funnel_order("funnel_stage", 1).alias("funnel_order"))),
    "funnel_order_eda": _on(lambda t: t.interactions.select("interaction_id", funnel_order("funnel_stage", None).alias("funnel_order"))),
    "return_flag_normalise": _on(return_flag_normalise),
    "drop_model_excluded": _on(lambda t: rounded(cleaning.drop_model_excluded(feature_table(t)))),
    "numeric_projection": _on(numeric_table),
    "model_features": _on(model_table),
    # labels
    "high_intent_events": _on(lambda t: labels.high_intent_events(t.interactions).select("interaction_id", "lead_id", "event_name")),
    "form_completions": _on(lambda t: labels.form_completions(t.interactions).select("interaction_id", "lead_id", "form_completed")),
    "converted_ids": _on(lambda t: labels.converted_ids(t.interactions)),
    "lead_labels": _on(lambda t: labels.lead_labels(t.leads, t.interactions).select("lead_id", "source", "converted")),
    # features
    "lead_aggregates": _on(lambda t: rounded(features.lead_aggregates(t.interactions))),
    "lead_temporal": _on(lambda t: rounded(features.lead_temporal(t.interactions))),
    "avg_session_gap": _on(lambda t: rounded(features.session_gaps(t.interactions))),
    "avg_session_gap_closed": _on(lambda t: rounded(features.session_gaps_closed(t.interactions))),
    "ratio_features": _on(lambda t: rounded(features.interaction_features(t.interactions).select("lead_id", *features.RATIOS))),
    "log_features": _on(lambda t: rounded(features.interaction_features(t.interactions).select("lead_id", *features.LOGS))),
    "lead_features": _on(lambda t: rounded(feature_table(t))),
    # exploration
    "conversion_summary": _on(lambda t: explore.conversion_summary(t.leads, t.interactions)),
    "class_counts": _on(lambda t: explore.class_counts(t.leads, t.interactions)),
    "source_volume": _on(lambda t: explore.volume_by(t.leads, "source")),
    "conversion_by_source": _on(lambda t: explore.conversion_by(t.leads, t.interactions, "source")),
    "conversion_by_segment": _on(lambda t: explore.conversion_by(t.leads, t.interactions, "lead_segment")),
    "conversion_by_industry": _on(lambda t: explore.conversion_by(t.leads, t.interactions, "industry")),
    "conversion_by_job_role": _on(lambda t: explore.conversion_by(t.leads, t.interactions, "job_role")),
    "conversion_by_funding_stage": _on(lambda t: explore.conversion_by(t.leads, t.interactions, "funding_stage")),
    "segment_gap": _on(lambda t: explore.segment_gap(t.leads, t.interactions)),
    "funnel_conversion": _on(lambda t: explore.funnel_conversion(t.leads, t.interactions)),
    "sessions_per_lead": _on(lambda t: explore.sessions_per_lead(t.interactions)),
    "session_means": _on(lambda t: explore.session_means(t.leads, t.interactions)),
    "session_box": _on(lambda t: explore.session_box(t.leads, t.interactions)),
    "pricing_views_per_lead": _on(lambda t: explore.pricing_views_per_lead(t.interactions)),
    "pricing_means": _on(lambda t: explore.pricing_means(t.leads, t.interactions)),
    "monthly_patterns": _on(lambda t: explore.monthly_patterns(t.interactions)),
    "monthly_patterns_orders": lambda spark, sf_dir: explore.monthly_patterns(spark.sql(ORDER_EVENTS_SQL, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))),
    "interaction_class_counts": _on(lambda t: explore.interaction_class_counts(t.interactions)),
    "dow_all_events": _on(lambda t: explore.weekday_events(t.interactions)),
    "dow_high_intent": _on(lambda t: explore.weekday_high_intent(t.interactions)),
    "time_to_convert": _on(lambda t: rounded(explore.time_to_convert(t.interactions))),
    "time_to_convert_summary": _on(lambda t: explore.time_to_convert_summary(t.interactions)),
    "time_to_convert_hist": _on(lambda t: explore.time_to_convert_histogram(t.interactions)),
    "temporal_correlations": _on(lambda t: explore.temporal_correlations(t.interactions)),
    "temporal_class_means": _on(lambda t: explore.temporal_class_means(t.interactions)),
    "temporal_hist": _on(lambda t: explore.temporal_histogram(t.interactions)),
    "temporal_kde": _on(lambda t: explore.temporal_density(t.interactions)),
    "correlation_matrix": _on(lambda t: explore.correlation_matrix(cleaning.exploration_leads(t.leads), t.interactions)),
    "quartile_conversion": _on(lambda t: explore.quartile_conversion(t.interactions)),
    "time_of_day_correlation": _on(lambda t: explore.time_of_day_correlation(t.interactions)),
    "third_pricing_view": _on(lambda t: explore.third_pricing_view(t.interactions)),
    # encoding, split, models
    "label_encode": _on(
        lambda t: (lambda u: encode.label_encode(u.select("lead_id", *present(u, TRAIN_CATEGORICALS))))(
            cleaning.fill_unknown(cleaning.dedup_first(t.leads))
        )
    ),
    "model_matrix": _on(model_matrix),
    "stratified_split": _on(lambda t: encode.stratified_split(label_table(t))),
    "stratified_folds": _on(lambda t: encode.stratified_folds(label_table(t))),
    "class_weights": _on(
        lambda t: rounded(encode.class_weights(encode.stratified_split(label_table(t)).where("NOT is_test")))
    ),
    "standardise": _on(
        lambda t: rounded(encode.standardise(model_table(t), [f for f in FEATURES if f != "source"]).drop("source", "converted"))
    ),
    "train_lr": _one_model("Logistic Regression"),
    "logistic_gradient": _on(logistic_gradient),
    "train_rf": _one_model("Random Forest"),
    "train_gbt": _one_model("Gradient Boosting"),
    "train_gbt_colsample": _one_model("Column-Sampled Boosting"),
    "leak_check": _on(lambda t: encode.leak_check(model_table(t))),
    # evaluation and selection
    "classification_metrics": _on(lambda t: metrics.classification_metrics(example_scores(t))),
    "auc_roc": _on(lambda t: metrics.auc_roc(example_scores(t))),
    "roc_curve": _on(lambda t: metrics.roc_curve(example_scores(t))),
    "confusion_matrix": _on(lambda t: metrics.confusion_matrix(example_scores(t))),
    "select_best": _on(lambda t: select_best_rule(t)),
    "model_leaderboard": _on(lambda t: checked_board(_train(t))),
    "cv_f1": _on(fold_scores),
    "feature_importance": _on(forest_importance),
    # scoring and explanation
    "batch_score": _on(batch_score),
    "score_stream": _on(score_stream),
    "validate_requests": _on(
        lambda t: scoring.rejected_requests(example_requests(t), known_sources(t)).select("lead_id", "reason")
    ),
    "score_bands": _on(lambda t: scoring.band(example_scores(t)).select("lead_id", *scoring.BANDS)),
    "explain_linear": _on(lambda t: rounded(example_contributions(t).select("lead_id", *explain.CONTRIBUTIONS, "probability_1"))),
    "explain_top_factors": _on(lambda t: explain.factor_rows(explain.explained(example_contributions(t)))),
    "explain_summary": _on(
        lambda t: explain.explained(example_contributions(t)).select(
            "lead_id", F.round("probability_1", 4).alias("conversion_probability"), scoring.decision(F.col("probability_1")).alias("prediction"), "summary"
        )
    ),
    "third_pricing_view_stream": _on(alerts_of_stream),
    "lead_features_kept": _on(features_kept),
    "explain_tree": _on(explain_tree),
    "explain_forest_factors": _on(lambda t: fitted_factors(t, "Random Forest")),
    "explain_forest_summary": _on(lambda t: fitted_summary(t, "Random Forest")),
    "explain_logistic_factors": _on(lambda t: fitted_factors(t, models.LOGISTIC)),
    "explain_logistic_summary": _on(lambda t: fitted_summary(t, models.LOGISTIC)),
}


def known_sources(t: LeadTables) -> list[str]:
    """The encoder's labels, as a model fitted on these leads would know them."""
    return list(encode.fit_encoders(cleaning.fill_unknown(t.leads, ["source"]), ["source"]).labelsArray[0])


def select_best_rule(t: LeadTables) -> DataFrame:
    """The selection rule over three cut-offs of the example score, the first two of which tie."""
    scored = stage(example_scores(t), "example-scores")
    boards = [
        metrics.classification_metrics(scored.withColumn("prediction", (F.col("probability_1") > cut).cast("int"))).select(
            F.lit(i).alias("position"), F.lit(name).alias("model"), "f1"
        )
        for i, (name, cut) in enumerate([("cut 0.3 a", 0.3), ("cut 0.3 b", 0.3), ("cut 0.6", 0.6)])
    ]
    return metrics.select_best(boards[0].unionByName(boards[1]).unionByName(boards[2]))
