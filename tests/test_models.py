"""Metrics, fits, scoring, explanation, streaming, CSV."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadspark.constants import FEATURES
from leadspark.operators import encode, explain, logistic, metrics, models, scoring, trees
from leadspark.plans import registry
from leadspark.session import fresh_path, stage
from leadspark.sources import csv, sinks
from leadspark.streaming import scoring as streaming

QUICK = {"Random Forest": {"trees": 30, "depth": 5}, "Gradient Boosting": {"trees": 40, "depth": 3, "rate": 0.2}, "Column-Sampled Boosting": {"trees": 40, "depth": 3, "rate": 0.2}}


@pytest.fixture(scope="module")
def separable(spark):
    """Leads whose label follows from two features."""
    rng = np.random.default_rng(3)
    n = 240
    pdf = pd.DataFrame({f: rng.integers(0, 9, n).astype(float) for f in FEATURES})
    pdf["source"] = rng.choice(["Direct", "Google", "LinkedIn"], n)
    pdf["lead_id"] = np.arange(n)
    pdf["converted"] = ((pdf["total_events"] + 2 * pdf["webinar_registrations"]) > 12).astype(int)
    for c in scoring.WHOLE_NUMBERS:
        pdf[c] = pdf[c].astype(int)
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def trained(separable):
    return models.train_models(separable, QUICK)


def scored_frame(spark, rows):
    return spark.createDataFrame(rows, "converted int, prediction int, probability_1 double")


def test_published_confusion_matrix(spark):
    cells = [((0, 0), 255), ((0, 1), 21), ((1, 0), 9), ((1, 1), 120)]
    df = scored_frame(spark, [(y, p, float(p)) for (y, p), n in cells for _ in range(n)])
    r = metrics.classification_metrics(df).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (0.9259, 0.8511, 0.9302, 0.8889)
    assert {(c["actual"], c["predicted"]): c["n"] for c in metrics.confusion_matrix(df).collect()} == dict(cells)


def test_metrics_without_predicted_positives(spark):
    df = scored_frame(spark, [(1, 0, 0.1), (0, 0, 0.2)])
    r = metrics.classification_metrics(df).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (0.5, 0.0, 0.0, 0.0)
    assert metrics.confusion_matrix(df).count() == 4


def test_auc_counts_ties_half(spark):
    rows = [(1, 1, 0.9), (0, 1, 0.9), (1, 0, 0.4), (0, 0, 0.3), (1, 0, 0.3)]
    df = scored_frame(spark, rows)
    pairs = [(a, b) for a in rows if a[0] == 1 for b in rows if b[0] == 0]
    want = sum(1 if a[2] > b[2] else 0.5 if a[2] == b[2] else 0 for a, b in pairs) / len(pairs)
    assert metrics.auc_roc(df).first()["auc_roc"] == pytest.approx(want, abs=1e-4)
    assert metrics.auc_roc(scored_frame(spark, [(1, 1, 0.5)])).first()["auc_roc"] is None
    curve = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_curve(df).collect())
    assert curve[0] == (0.0, 0.0) and curve[-1] == (1.0, 1.0) and len(curve) == 4


def test_first_of_equal_models_wins(spark):
    df = spark.createDataFrame([(0, "x", 0.7), (1, "y", 0.7), (2, "z", 0.6)], "position int, model string, f1 double")
    assert metrics.select_best(df).first()["model"] == "x"


def test_fits_are_good_and_repeatable(separable, trained):
    board = {r["model"]: r for r in trained.leaderboard.collect()}
    assert list(board) == list(models.BUILDERS)
    assert all(r["auc_roc"] > 0.85 for r in board.values()) and board["Logistic Regression"]["auc_roc"] > 0.95
    assert trained.best.name == max(board.values(), key=lambda r: (r["f1"], -r["position"]))["model"]
    again = models.train_models(separable.repartition(3), QUICK, ["Random Forest"])
    want = dict(map(tuple, models.score(trained.candidates[1].model, trained.test).select("lead_id", "probability_1").collect()))
    got = dict(map(tuple, models.score(again.best.model, again.test).select("lead_id", "probability_1").collect()))
    assert got == pytest.approx(want)


def vectors_of(rows):
    from pyspark.ml import Pipeline

    return Pipeline(stages=encode.feature_stages()).fit(rows).transform(rows)


SPECS = [
    trees.Spec("forest", 5, 5, per_node=3, min_leaf=2), trees.Spec("first", 7, 3, rate=0.3, rows=0.8),
    trees.Spec("second", 13, 4, rate=0.3, rows=0.8, columns=0.8, ridge=1.0, min_weight=1.0), trees.Spec("second", 4, 3, rate=0.3, ridge=1.0, held=2),
]


def test_trees_do_not_depend_on_partitions(separable):
    """A job per level over many partitions grows the trees that single tasks grow, to the last digit."""
    folded = encode.stratified_folds(separable)
    for rows in (1 << 18, 100):
        data = trees.bin_rows(vectors_of(folded.repartition(3)), len(FEATURES), part="fold", rows=rows)
        assert data.partitions == (1 if rows > 1000 else 3)
        found = [[getattr(t, name).tolist() for name in trees.Tree.ARRAYS] for fit in trees.fit_trees(data, SPECS) for t in fit]
        if rows > 1000:
            first = found
    assert found == first


def test_the_driver_gets_cuts_and_no_sums(separable, monkeypatch):
    """What a level sends to the driver grows with its nodes, not with features, bins or rows."""
    from pyspark import RDD
    from pyspark.sql import DataFrame

    data = trees.bin_rows(vectors_of(separable.repartition(3)).withColumn("fold", F.lit(0)), len(FEATURES), part="fold", rows=100)
    sent, collect = [], RDD.collect
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: pytest.fail("sums reach the driver"))
    monkeypatch.setattr(RDD, "collect", lambda rdd: sent.append(collect(rdd)) or sent[-1])
    found = trees.fit_trees(data, SPECS[:3])
    assert sum(len(fit) for fit in found) == 25 and sent
    nodes = sum(int((t.feature >= 0).sum()) for fit in found for t in fit)
    numbers = sum(np.size(x) for level in sent for _, cuts, root in level for x in (*cuts, root))
    assert numbers <= 10 * nodes + 3 * sum(len(level) for level in sent)


def brute_tree(spec, bins, g, h):
    """(gain, feature, cut) of the root by trying every cut."""
    n = np.ones(len(g))
    score = lambda at: g[at].sum() ** 2 / (n[at].sum() if spec.kind == "first" else h[at].sum() + spec.ridge)
    best = (0, -1, 0)
    for f in range(bins.shape[1]):
        for cut in range(int(bins[:, f].max())):
            left = bins[:, f] <= cut
            if 0 < left.sum() < len(g):
                gain = score(left) + score(~left) - score(np.ones(len(g), bool))
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
    return best


@pytest.mark.parametrize("kind", ["first", "second"])
def test_cuts_and_leaves_are_the_best(kind):
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 20, (300, 4)).astype(np.uint8)
    y = (bins[:, 2] + rng.integers(0, 8, 300) > 14).astype(float)
    spec = trees.Spec(kind, 1, 1, rate=0.1, ridge=1.0 if kind == "second" else 0.0)
    odds = float(np.log(y.mean() / (1 - y.mean())))
    tree = trees.grow(spec, [0], bins, 20, np.arange(300), y, np.ones(300), odds)[0]
    p = np.full(300, y.mean())
    g, h = y - p, p * (1 - p)
    gain, feature, cut = brute_tree(spec, bins, g, h)
    left = bins[:, feature] <= cut
    assert (tree.feature[0], tree.cut[0]) == (feature, cut) and gain > 1
    for node, at in ((1, left), (2, ~left)):
        assert tree.value[node] == pytest.approx(0.1 * g[at].sum() / (h[at].sum() + spec.ridge), abs=1e-5)


def test_columns_are_drawn_per_tree_or_per_node():
    per_tree = [trees.candidates(SPECS[2], t, level, 11) for t in range(20) for level in range(4)]
    assert all((c == c[0]).all() and c.shape[1] == 8 for c in per_tree)
    assert len({tuple(trees.candidates(SPECS[2], t, 0, 11)[0]) for t in range(20)}) > 10
    per_node = trees.candidates(SPECS[0], 0, 4, 11)
    assert per_node.shape == (16, 3) and len({tuple(c) for c in per_node}) > 5
    u = trees.uniform(np.arange(100000), 42, 7)
    assert abs(u.mean() - 0.5) < 0.01 and abs((u < 0.8).mean() - 0.8) < 0.01
    times = trees.gradients(SPECS[0], 0, np.arange(100000), np.ones(100000), np.ones(100000), np.zeros(100000))[1]
    assert abs(times.mean() - 1) < 0.02 and abs((times == 0).mean() - np.exp(-1)) < 0.01


def test_saved_form_scores_as_the_trees_say(spark, separable):
    vectors = vectors_of(separable).cache()
    data = trees.bin_rows(vectors, len(FEATURES))
    pdf = vectors.select("lead_id", "features").toPandas().sort_values("lead_id")
    x = np.stack([v.toArray() for v in pdf["features"]])
    bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(data.cuts)], axis=1).astype(np.uint8)
    for spec, grown in zip(SPECS[:3], trees.fit_trees(data, SPECS[:3])):
        model = trees.as_model(spark, data, spec, grown)
        got = [float(r["p"][1]) for r in model.transform(vectors).selectExpr("lead_id", "probability AS p").orderBy("lead_id").collect()]
        total = sum(t.value[t.descend(bins, spec.depth)] for t in grown)
        want = total / len(grown) if spec.kind == "forest" else 1 / (1 + np.exp(-(data.start(spec)[0] + total)))
        assert np.allclose(got, want, atol=1e-9)
        assert model.featureImportances.toArray().sum() == pytest.approx(1)


def test_one_class_and_no_rows(spark, separable):
    for rows in (separable.withColumn("converted", F.lit(0)), separable.where("converted = 1"), separable.limit(0)):
        data = trees.bin_rows(vectors_of(separable).select("lead_id", "features", "converted").join(rows.select("lead_id", F.col("converted").alias("c")), "lead_id").withColumn("converted", F.col("c")), len(FEATURES))
        for fit in trees.fit_trees(data, SPECS[:3]):
            assert all((t.feature == -1).all() for t in fit)


def test_newton_reaches_the_optimum_and_the_library_fit(spark, separable):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    rows = encode.with_weights(separable)
    vectors = vectors_of(rows)
    read = logistic.read_rows(vectors)
    fits = logistic.fit_logistic(read, len(FEATURES))
    assert np.abs(logistic.gradient(read, fits)[0]).max() < 1e-6
    n = rows.count()
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(vectors).transform(vectors)
    # the library scales by the sample deviation and takes the mean loss
    library = LogisticRegression(featuresCol="scaled", labelCol="converted", weightCol="weight", regParam=(n - 1) / n / n, standardization=False, maxIter=1000, tol=1e-12).fit(scaled)
    want = library.coefficients.toArray() * np.sqrt((n - 1) / n)
    assert np.allclose(fits[0].beta[:-1], want, atol=1e-4) and fits[0].beta[-1] == pytest.approx(library.intercept, abs=1e-4)


def test_folds_of_newton_equal_fits_without_the_fold(separable):
    folded = encode.stratified_folds(separable)
    read = logistic.read_rows(vectors_of(folded), part="fold")
    fits = logistic.fit_logistic(read, len(FEATURES), helds=range(5))
    for held in (0, 3):
        alone = logistic.fit_logistic(logistic.read_rows(vectors_of(folded).where(F.col("fold") != held)), len(FEATURES))[0]
        assert np.allclose(fits[held].beta, alone.beta, atol=1e-8)


@pytest.mark.parametrize("name", ["Logistic Regression", "Gradient Boosting", "Column-Sampled Boosting"])
def test_cross_validation_of_all_kinds(trained, name):
    f1 = [r["f1"] for r in models.cv_f1(name, trained.rows, {"trees": 20, "rate": 0.3}).collect()]
    assert len(f1) == 5 and all(0.5 < x <= 1 for x in f1)


def test_cross_validation(trained):
    folds = models.cv_f1("Random Forest", trained.rows, QUICK["Random Forest"])
    f1 = [r["f1"] for r in folds.collect()]
    assert len(f1) == 5 and all(0.5 < x <= 1 for x in f1)
    r = models.cv_summary(folds).first()
    assert r["cv_f1_mean"] == pytest.approx(np.mean(f1)) and r["cv_f1_std"] == pytest.approx(np.std(f1))


def test_importance(spark, trained):
    forest = models.feature_importance(spark, trained.candidates[1].model).collect()
    assert sum(r["importance"] for r in forest) == pytest.approx(1) and len(forest) == len(FEATURES)
    assert {r["feature"] for r in forest[:2]} == {"total_events", "webinar_registrations"}
    assert models.feature_importance(spark, trained.candidates[0].model).first()["importance"] > 0


def test_save_and_load(spark, trained):
    path = fresh_path(spark, "model")
    models.save_model(trained.candidates[1], path)
    loaded, info = models.load_model(path)
    assert info["feature_names"] == FEATURES and info["source_values"] == ["Direct", "Google", "LinkedIn"]
    a = models.score(trained.candidates[1].model, trained.test).select("lead_id", "probability_1").collect()
    assert sorted(a) == sorted(models.score(loaded.model, trained.test).select("lead_id", "probability_1").collect())
    card = models.model_card(spark, loaded).first()
    assert card["feature_count"] == 11 and card["supported_sources"] == info["source_values"]


def test_metrics_document(spark, trained):
    cv = spark.createDataFrame([(0.9, 0.01)], "cv_f1_mean double, cv_f1_std double")
    row = sinks.metrics_document(trained.leaderboard, cv).first()
    assert [m["model"] for m in row["models"]] == list(models.BUILDERS) and row["cv_f1_mean"] == 0.9


@pytest.mark.parametrize("p,want", [
    (0.5, ("ACCEPT", "low", "medium")), (0.49999, ("REJECT", "low", "high")), (0.6, ("ACCEPT", "medium", "medium")),
    (0.8, ("ACCEPT", "medium", "low")), (0.85, ("ACCEPT", "high", "low")), (0.8214, ("ACCEPT", "medium", "low")), (0.15, ("REJECT", "high", "high")),
])
def test_bands(spark, p, want):
    r = scoring.band(spark.createDataFrame([(p,)], "probability_1 double")).first()
    assert (r["prediction"], r["confidence"], r["risk_level"]) == want


def test_stream_equals_batch(spark, trained):
    rows = trained.test.select("lead_id", *[F.col(f).cast("string").alias(f) for f in FEATURES])
    spoiled = rows.withColumn("total_events", F.when(F.col("lead_id") % 5 == 0, "NaN").when(F.col("lead_id") % 5 == 1, "Infinity").otherwise(F.col("total_events")))
    inbox, out, bad, log = (fresh_path(spark, n) for n in ("in", "out", "bad", "log"))
    spoiled.repartition(3).write.parquet(inbox)
    stream = streaming.read_feature_stream(spark, inbox, spoiled.schema, files_per_trigger=1)
    for query in streaming.score_stream(trained.best.model, stream, out, bad, log):
        query.awaitTermination()
    allowed = models.source_values(trained.best.model)
    accepted = scoring.accepted_requests(spoiled, allowed)
    assert sorted(spark.read.parquet(out).collect()) == sorted(scoring.batch_score(trained.best.model, accepted).collect())
    rejected = {r.lead_id for r in spark.read.parquet(bad).collect()}
    assert rejected == {r.lead_id for r in rows.collect()} - {r.lead_id for r in accepted.collect()} and rejected


def test_requests_are_checked(spark):
    names = ["lead_id", *FEATURES]
    good = ("1", "Google", "7", "35", "2400.0", "3", "1", "4", "60", "25.0", "5.0", "4.0")
    rows = [good, ("2", "Fax", *good[2:]), ("3", "Google", "7.5", *good[3:]), ("4", None, *good[2:]), ("5", *good[1:4], "soon", *good[5:])]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    bad = {r["lead_id"]: r["reason"] for r in scoring.rejected_requests(df, ["Direct", "Google"]).collect()}
    assert bad == {
        "2": "Invalid value for 'source'. Allowed values: ['Direct', 'Google']", "3": "Invalid number for 'session_count'.",
        "4": "Invalid value for 'source'. Allowed values: ['Direct', 'Google']", "5": "Invalid number for 'total_time_seconds'.",
    }
    ok = scoring.accepted_requests(df, ["Direct", "Google"]).first()
    assert ok["session_count"] == 7 and ok["total_time_seconds"] == 2400.0


def test_multilinear_shapley_equals_the_definition():
    """Against the average over all orders of joining, for a hand-made tree."""
    inf = math.inf
    lows = np.array([[-inf, -inf, -inf], [3, -inf, -inf], [3, 2, -inf], [3, 2, 1]], dtype=float)
    highs = np.array([[3, inf, inf], [inf, 2, inf], [inf, inf, 1], [inf, inf, inf]], dtype=float)
    shares = np.array([[0.6, 1, 1], [0.4, 0.25, 1], [0.4, 0.75, 0.5], [0.4, 0.75, 0.5]])
    values = np.array([0.1, 0.9, 0.4, 0.7])
    x = np.array([[5.0, 9.0, 0.0], [1.0, 1.0, 5.0], [4.0, 1.0, 2.0]])
    got = explain.shapley(x, (lows, highs, shares, values))

    def game(row, known):
        inside = (row > lows) & (row <= highs)
        return sum(v * np.prod([i[f] if f in known else z[f] for f in range(3)]) for i, z, v in zip(inside, shares, values))

    for row, phi in zip(x, got):
        want = np.zeros(3)
        for order in itertools.permutations(range(3)):
            for k, f in enumerate(order):
                want[f] += (game(row, order[:k + 1]) - game(row, order[:k])) / 6
        assert np.allclose(phi, want)


def random_leaves(rng, n_features, depth):
    """The leaves of a random tree, some features met twice, some not at all."""
    lows, highs, shares, values = [], [], [], []

    def walk(low, high, share, left):
        if not left or rng.random() < 0.15:
            lows.append(low), highs.append(high), shares.append(share), values.append(rng.normal())
            return
        f, cut, z = rng.integers(n_features), rng.normal(), rng.uniform(0.05, 0.95)
        a, b = high.copy(), low.copy()
        a[f], b[f] = min(a[f], cut), max(b[f], cut)
        one, two = share.copy(), share.copy()
        one[f], two[f] = one[f] * z, two[f] * (1 - z)
        walk(low, a, one, left - 1), walk(b, high, two, left - 1)

    walk(np.full(n_features, -np.inf), np.full(n_features, np.inf), np.ones(n_features), depth)
    return np.array(lows), np.array(highs), np.array(shares), np.array(values)


@pytest.mark.parametrize("seed", range(6))
def test_pattern_tables_equal_the_definition(seed):
    rng = np.random.default_rng(seed)
    n = 5
    leaves = low, high, share, value = random_leaves(rng, n, seed)
    x = rng.normal(size=(7, n))
    want = np.zeros_like(x)
    for row in range(len(x)):
        inside = (x[row] > low) & (x[row] <= high)
        game = lambda known: (np.where(np.isin(np.arange(n), known), inside, share).prod(axis=1) * value).sum()
        for f in range(n):
            others = [k for k in range(n) if k != f]
            for size in range(n):
                for known in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                    want[row, f] += weight * (game([*known, f]) - game(list(known)))
    assert np.allclose(explain.shapley(x, leaves, cells=64), want, atol=1e-9)


@pytest.mark.parametrize("which", [1, 2])
def test_tree_contributions_add_up(trained, which):
    model = trained.candidates[which].model
    rows = explain.tree_contributions(model, models.score(model, trained.test)).toPandas()
    total = rows["base_value"] + rows[explain.CONTRIBUTIONS].sum(axis=1)
    p = rows["probability_1"]
    assert np.allclose(total, p if which == 1 else np.log(p / (1 - p)) / 2, atol=1e-6)
    assert set(rows["space"]) == {"probability" if which == 1 else "margin"}


def test_equal_rows_are_explained_once(trained, monkeypatch):
    """Copies of a row in any partition cost one look at the leaves, and all get the row's contributions."""
    staged, stage = {}, explain.stage
    monkeypatch.setattr(explain, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    rows = models.score(trained.candidates[1].model, trained.rows.limit(20)).drop("lead_id")
    copies = rows.crossJoin(rows.sparkSession.range(30).withColumnRenamed("id", "lead_id")).repartition(7)
    found = explain.tree_contributions(trained.candidates[1].model, copies)
    assert found.count() == 600 and staged["contributions"].count() <= 20
    total = sum((F.col(c) for c in explain.CONTRIBUTIONS), F.col("base_value"))
    assert found.where(F.abs(total - F.col("probability_1")) > 1e-6).count() == 0


def joins_of(df):
    import re

    return re.findall("BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|Exchange", df._jdf.queryExecution().executedPlan().toString())


def test_factors_need_no_join(spark, trained, monkeypatch):
    """A lead's factors and own values stand in one row; a join of compressed tables filled the driver with a broadcast."""
    rows = explain.explained(explain.logistic_contributions(trained.candidates[0].model, models.score(trained.candidates[0].model, trained.rows)))
    rows = stage(rows.unionByName(rows.limit(1).withColumn("lead_id", F.lit(None).cast(rows.schema["lead_id"].dataType))), "explained")
    monkeypatch.setattr(registry, "_fitted_explanations", lambda t, name: rows)
    found = registry.fitted_factors(None, models.LOGISTIC)
    assert joins_of(found) == []
    n = trained.rows.count()
    assert found.count() == 5 * n and found.where("own_value AND direction_follows AND ranked").count() == 5 * n
    assert {r["factor_rank"] for r in found.collect()} == {1, 2, 3, 4, 5}
    reversed_rows = rows.where("lead_id IS NOT NULL").withColumn("top_factors", F.reverse("top_factors"))
    monkeypatch.setattr(registry, "_fitted_explanations", lambda t, name: reversed_rows)
    assert registry.fitted_factors(None, models.LOGISTIC).where("NOT ranked").count() > 0


def test_roundtrip_needs_no_join(trained, monkeypatch):
    monkeypatch.setattr(registry, "_saved_forest", lambda t: (trained, trained.best, {}))
    found = registry.model_roundtrip(None)
    assert joins_of(found) == [] and found.columns == ["lead_id", "same"]
    assert found.count() == found.where("same").count() == trained.rows.count()


def test_streamed_scores_are_not_broadcast(spark, trained, monkeypatch):
    monkeypatch.setattr(registry, "_train", lambda t, names=None: trained)
    found = registry.score_stream(registry.read_tables(spark, "/root/testdata/sf0.001"))
    assert set(joins_of(found)) == {"SortMergeJoin", "Exchange"}


def test_logistic_contributions_add_up(trained):
    model = trained.candidates[0].model
    rows = explain.logistic_contributions(model, models.score(model, trained.test)).toPandas()
    total = rows["base_value"] + rows[explain.CONTRIBUTIONS].sum(axis=1)
    assert np.allclose(1 / (1 + np.exp(-total)), rows["probability_1"])


def explained_row(spark, p, stage, contributions):
    values = dict.fromkeys(FEATURES, 0.0) | {"total_time_seconds": 2400.0, "total_clicks": 60.0, "max_funnel_order": float(stage)}
    row = {**values, "source": "Google", **{f"c_{f}": contributions.get(f, 0.0) for f in FEATURES}, "probability_1": p}
    return explain.explained(spark.createDataFrame([row])).first()


def test_factors_and_summary(spark):
    r = explained_row(spark, 0.8214, 4, {"total_time_seconds": 0.12, "source": -0.2, "total_clicks": 0.05, "session_count": 0.04, "total_events": 0.03, "avg_session_gap_days": -0.01})
    assert [f["feature"] for f in r["top_factors"]] == ["source", "total_time_seconds", "total_clicks", "session_count", "total_events"]
    assert r["top_factors"][0].asDict() == {"feature": "source", "value": "Google", "contribution": -0.2, "direction": "decreases", "human_label": "Acquisition source"}
    assert r["summary"] == (
        "This lead has a strong conversion probability of 82%. The lead reached the Decision stage of the funnel. Key positive signals: "
        "Time on site (seconds) (2400.0), Total clicks (60.0), Number of sessions (0.0). Main drag: Acquisition source (Google)."
    )


def test_summary_without_signals(spark):
    r = explained_row(spark, 0.45, 0, {})
    assert r["summary"] == "This lead has a moderate conversion probability of 45%. The lead reached the Unknown stage of the funnel. No strong positive signals detected."
    assert {f["direction"] for f in r["top_factors"]} == {"decreases"}
    assert " low " in explained_row(spark, 0.4499, 1, {})["summary"] and " strong " in explained_row(spark, 0.75, 1, {})["summary"]


def test_csv_reader(spark):
    path = fresh_path(spark, "csv")
    lines = ["timestamp,lead_id,extra,form_completed,click_count,time_on_page_seconds,event_name",
             "2026-01-02 03:04:05,a,x,True,3.0,NaN,demo_request", "soon,NA,x,,,12.5,N/A", '2026-01-03,b,x,false,2,null,"a, b"']
    spark.createDataFrame([("\n".join(lines),)], "v string").coalesce(1).write.text(path)
    rows = csv.read_csv(spark, path, csv.INTERACTIONS_SCHEMA).orderBy("ingest_seq").collect()
    assert [r["lead_id"] for r in rows] == ["a", None, "b"]
    assert str(rows[0]["ts"]) == "2026-01-02 03:04:05" and rows[1]["ts"] is None and rows[2]["ts"].day == 3
    assert [r["form_completed"] for r in rows] == [True, None, False] and [r["click_count"] for r in rows] == [3, None, 2]
    assert [r["time_on_page_seconds"] for r in rows] == [None, 12.5, None] and rows[2]["event_name"] == "a, b"
    assert "extra" not in rows[0].asDict()


def test_csv_files_with_headers_of_their_own_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('lead_id,source,industry\n1,Google,BFSI\n2,n/a,#N/A\n3,"two\nlines",<NA>\n')
    (tmp_path / "b.csv").write_text("industry,lead_id,source,extra\nRetail,4,Direct,x\nNone,5, NA,y\n")
    (tmp_path / "c.csv").write_text("lead_id,city\n6,Ulm\n")
    df = csv.read_csv(spark, str(tmp_path), csv.LEADS_SCHEMA)
    got = sorted((r.lead_id, r.source, r.industry, r.city) for r in df.collect())
    assert got == [
        ("1", "Google", "BFSI", None), ("2", None, None, None), ("3", "two\nlines", None, None), ("4", "Direct", "Retail", None), ("5", " NA", None, None), ("6", None, None, "Ulm"),
    ]


@pytest.mark.parametrize("split", ["500", "128m"])
def test_quoted_line_breaks_over_splits(spark, tmp_path, split):
    """One file, cut into many splits, some within cells and one whole split inside a cell, against the reader by file."""
    import csv as plain

    rng = np.random.default_rng(5)
    cells = ["Google", "two\nlines", 'a "quoted" word', "", "n/a", "x" * 300, "\n\n", "line\n" * 60, "a,b", "é\nü"]
    rows = [[str(k), rng.choice(cells), rng.choice(cells), str(k % 7)] for k in range(150)]
    with open(tmp_path / "a.csv", "w", newline="") as f:
        w = plain.writer(f, lineterminator="\n")
        w.writerows([["lead_id", "source", "industry", "employee_count"], *rows])
    with open(tmp_path / "b.csv", "w", newline="") as f:
        plain.writer(f).writerows([["employee_count", "lead_id"], ["5", "b"]])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = csv.read_csv(spark, str(tmp_path), csv.LEADS_SCHEMA)
        got = [(r.lead_id, r.source, r.industry, r.employee_count) for r in df.orderBy("ingest_seq").collect()]
        if split == "500":
            assert csv.records(spark, [str(tmp_path / "a.csv")]).select("block").distinct().count() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    known = lambda x: None if x in ("", "n/a") else x
    assert got == [(a, known(b), known(c), float(n)) for a, b, c, n in rows] + [("b", None, None, 5.0)]


def test_headers_are_read_by_executors(spark, tmp_path, monkeypatch):
    for k in range(40):
        (tmp_path / f"{k:04}.csv").write_text("lead_id,source\n" + f"{k},Google\n" if k % 2 else "source,lead_id\n" + f"Direct,{k}\n")
    (tmp_path / "empty.csv").write_text("")
    found = csv.headers(spark, str(tmp_path))
    assert {h: len(f) for h, f in found.items()} == {"lead_id,source": 20, "source,lead_id": 20}
    got = sorted((int(r.lead_id), r.source) for r in csv.read_csv(spark, str(tmp_path), csv.LEADS_SCHEMA).collect())
    assert got == [(k, "Google" if k % 2 else "Direct") for k in range(40)]


def test_numbers_that_are_not_finite_are_rejected(spark):
    names = ["lead_id", *FEATURES]
    good = ("Google", "7", "35", "2400.0", "3", "1", "4", "60", "25.0", "5.0", "4.0")
    texts = ["NaN", "Infinity", "-Infinity", "1e300", "", None, "7"]
    rows = [(str(i), good[0], t, *good[2:]) for i, t in enumerate(texts)] + [(f"t{i}", *good[:3], t, *good[4:]) for i, t in enumerate(["NaN", "inf"])]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    accepted = {r["lead_id"] for r in scoring.accepted_requests(df, ["Google"]).collect()}
    rejected = {r["lead_id"] for r in scoring.rejected_requests(df, ["Google"]).collect()}
    assert accepted == {"6"} and rejected == {r[0] for r in rows} - accepted
