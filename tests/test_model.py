"""Splits, metrics, classifiers and scoring."""

import pytest
from pyspark.sql import functions as F

from threatspark.functions.lexical import keyword_label
from threatspark.model import metrics, training


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    from registry.views import Views

    label = training.label_index(keyword_label(F.col("domain")))
    return training.domain_training_rows(Views(spark, sf_dir).domains, label).cache()


@pytest.fixture(scope="module")
def model(rows):
    return training.train(rows, training.random_forest(training.DOMAIN_FEATURES, trees=10, depth=8))


def test_split_reproduces_the_published_sizes(spark):
    rows = spark.createDataFrame([(i, "phishing" if i < 17 else "legitimate") for i in range(65)], "id int, label string")
    got = {(r.label, r.split): r["count"] for r in training.stratified_split(rows, "label", "id").groupBy("label", "split").count().collect()}
    assert got == {("phishing", "train"): 14, ("phishing", "test"): 3, ("legitimate", "train"): 38, ("legitimate", "test"): 10}


def test_folds_are_even(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(100)], "id int, label boolean")
    counts = training.kfold_assign(rows, "label", "id").groupBy("label", "fold").count().collect()
    for label in (True, False):
        sizes = [r["count"] for r in counts if r.label == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_label_index(spark):
    frame = spark.createDataFrame([("legitimate",), ("0",), ("0.0",), ("phishing",), ("1",), ("Legitimate",)], "label string")
    assert [r[0] for r in frame.coalesce(1).select(training.label_index(F.col("label"))).collect()] == [0, 0, 0, 1, 1, 0]


def test_metrics_with_empty_denominators(spark):
    scored = spark.createDataFrame([(0, 0.1), (0, 0.2)], "label int, score double")
    r = metrics.binary_metrics(scored).first()
    assert (r.accuracy, r.precision, r.recall, r.f1, r.false_positive_rate, r.false_negative_rate) == (1.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_auc_counts_ties_half(spark):
    scored = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert metrics.roc_auc(scored).first().roc_auc == pytest.approx(3.5 / 4)


def test_forest_learns_and_lists_win(spark, rows, model):
    scored = training.phishing_score(model.transform(rows), "label")
    assert metrics.roc_auc(scored).first().roc_auc > 0.9
    listed = training.score_batch(rows, model, training.DOMAIN_FEATURES)
    assert listed.filter("domain = 'apple-login.com'").first().confidence == 1.0
    assert listed.filter("domain = 'google.com'").first().prediction == "legitimate"


def test_importances_sum_to_one(spark, model):
    got = training.feature_importance(spark, model, training.DOMAIN_FEATURES).collect()
    assert sum(r.importance for r in got) == pytest.approx(1.0)
    assert [r.importance for r in got] == sorted((r.importance for r in got), reverse=True)


def test_saved_model_scores_the_same(spark, rows, model, tmp_path):
    from pyspark.ml import PipelineModel

    evaluation = metrics.binary_metrics(training.phishing_score(model.transform(rows), "label"))
    training.model_metadata_sink(model, evaluation, training.DOMAIN_FEATURES, "RandomForest", str(tmp_path), rows, rows.limit(5))
    back = PipelineModel.load(f"{tmp_path}/model")
    a = training.phishing_score(model.transform(rows), "domain")
    b = training.phishing_score(back.transform(rows), "domain")
    assert a.exceptAll(b).count() == 0
    meta = spark.read.json(f"{tmp_path}/metadata").first()
    assert (meta.num_train, meta.num_test) == (rows.count(), 5)
    assert meta.num_features == len(training.DOMAIN_FEATURES) and list(meta.features) == list(training.DOMAIN_FEATURES)


def test_cross_validation(rows):
    r = training.cross_validate(rows, lambda: training.random_forest(training.DOMAIN_FEATURES, trees=5, depth=5), folds=3).first()
    assert 0.5 < r.accuracy_mean <= 1 and r.accuracy_std >= 0 and 0.5 < r.roc_auc_mean <= 1


def test_matrix_drops_leaks(spark):
    frame = spark.createDataFrame([("a.com", 1, 0.9, None, True, "t")], "domain string, label int, verifier_confidence double, x double, flag boolean, note string")
    got = training.training_matrix(frame)
    assert got.columns == ["domain", "label", "x", "flag"] and tuple(got.first())[2:] == (0.0, 1.0)


def test_the_best_model_is_kept(spark, rows, tmp_path):
    pipelines = {
        "Stump": training.random_forest(training.DOMAIN_FEATURES, trees=1, depth=1),
        "RandomForest": training.random_forest(training.DOMAIN_FEATURES, trees=10, depth=8),
    }
    results = training.select_model(rows, training.DOMAIN_FEATURES, pipelines, str(tmp_path)).collect()
    assert [r.model for r in sorted(results, key=lambda r: r.ordinal)] == ["Stump", "RandomForest"]
    meta = spark.read.json(f"{tmp_path}/metadata").first()
    assert meta.model_type == max(results, key=lambda r: r.f1).model
    assert meta.num_samples == rows.count()


def test_fits_run_side_by_side(spark):
    import threading

    together = threading.Barrier(3, timeout=30)

    def work(n):
        together.wait()  # passes only if three are at work
        return spark.range(n).count()

    assert training.at_once(work, [4, 5, 6], 3) == [4, 5, 6]
    assert training.at_once(lambda n: n + 1, range(5), 1) == [1, 2, 3, 4, 5]


def test_small_fits_take_few_tasks(spark):
    """A round of a fit has no more tasks than its rows keep busy, however the rows were dealt out."""
    kept = spark.range(3000).repartition(40).persist()
    trees, network = training.random_forest(("id",)), training.neural_network(("id",))
    seen = {}

    class Told(type(trees)):
        def fit(self, df):
            seen["tasks"] = df.rdd.getNumPartitions()

    assert training.packed(kept, trees).rdd.getNumPartitions() == 1
    assert training.packed(kept, network).rdd.getNumPartitions() == 2
    assert training.packed(kept.limit(0), trees).rdd.getNumPartitions() <= 1
    training.train(spark.range(3000).repartition(40), Told(stages=trees.getStages()))
    assert seen["tasks"] == 1
    kept.unpersist()


def test_fits_keep_all_cores_busy(spark):
    """Rows that lie in one large and one small task are dealt out evenly, and a large fit has no more tasks than the cores need."""
    kept = spark.range(60_000, numPartitions=1).union(spark.range(100, numPartitions=1)).persist()
    dealt = training.packed(kept, training.neural_network(("id",)))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    cores = spark.sparkContext.defaultParallelism
    assert cores <= len(sizes) <= 3 * cores and sum(sizes) == 60_100 and max(sizes) - min(sizes) <= 2
    assert dealt.exceptAll(kept).isEmpty() and kept.exceptAll(dealt).isEmpty()
    kept.unpersist()


def test_selection_deals_rows_out(spark, rows, tmp_path, monkeypatch):
    """The fits that run side by side get the rows of one file in several even tasks, not in one."""
    seen = []
    trees = training.random_forest(training.DOMAIN_FEATURES, trees=2, depth=2)

    class Told(type(trees)):
        def fit(self, df):
            seen.append(sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()))
            return super().fit(df)

    monkeypatch.setitem(training.TASK_ROWS, type(trees.getStages()[-1]), 100)
    pipelines = {name: Told(stages=trees.getStages()) for name in ("First", "Second")}
    training.select_model(rows.coalesce(1), training.DOMAIN_FEATURES, pipelines, str(tmp_path))
    assert len(seen) == 2 and all(len(sizes) > 4 and sum(sizes) > 400 and sizes[-1] <= 2 * sizes[0] for sizes in seen)
