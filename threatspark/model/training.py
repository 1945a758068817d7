"""Training data preparation, MLlib classifiers, cross-validation and scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatspark import lexicon as L
from threatspark.functions.lexical import first_label, entropy
from threatspark.model import metrics
from threatspark.operators import running
from threatspark.session import settled
from threatspark.operators.features import domain_columns
from threatspark.operators.matching import ListTables
from threatspark.operators.verdicts import list_override

# identifiers, labels and columns that leak the label or the time of capture
NOT_FEATURES = (
    "domain", "destination_ip", "sni", "timestamp", "label", "is_phishing", "ip", "ts", "fold", "split",
    "verifier_confidence", "verifier_label", "feed_label", "label_match",
    "session_dns_query_timestamp", "session_tls_handshake_timestamp",
)
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
DOMAIN_FEATURES = (
    "domain_length", "subdomain_count", "domain_entropy", "has_numbers_in_domain", "has_hyphens_in_domain",
    "hyphen_count", "digit_count", "label_length", "label_entropy",
)
#: Least rows of one task in a round of a fit, where it is not 25,000: a row costs a network far more than a level of a tree.
TASK_ROWS = {MultilayerPerceptronClassifier: 2_000}
#: Tasks of a core in a round of a large fit, and the rows of a task from which on there are more.
CORE_TASKS, FULL_TASK = 3, 250_000


# --- preparation --------------------------------------------------------------------------------
def feature_names(df: DataFrame, drop: Sequence[str] = NOT_FEATURES) -> list[str]:
    """Numeric and boolean columns that may be used for training."""
    return [n for n, t in df.dtypes if n not in drop and (t in NUMERIC or t.startswith("decimal"))]


def training_matrix(df: DataFrame, drop: Sequence[str] = NOT_FEATURES, keep: Sequence[str] = ("domain", "label")) -> DataFrame:
    """Features as doubles with 0 for NULL, plus the ``keep`` columns."""
    names = feature_names(df, drop)
    columns = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]
    return df.select(*[c for c in keep if c in df.columns], *columns)


def label_index(label: Column) -> Column:
    """0 for ``legitimate`` and any text or number equal to zero, else 1."""
    text = F.lower(label.cast("string"))
    zero = F.coalesce(text.try_cast("double") == 0, F.lit(False))
    return F.when((text == "legitimate") | zero, 0).otherwise(1)


def domain_training_rows(domains: DataFrame, label: Column, keep: Sequence[str] = ("domain",)) -> DataFrame:
    """Lexical training features of a table of domains with the given label; list membership is left out as a leak."""
    d = F.lower("domain")
    known = {n: c for n, c in domain_columns(F.col("domain")).items() if not n.startswith("is_known")}
    extra = {
        "hyphen_count": F.length(d) - F.length(F.replace(d, F.lit("-"), F.lit(""))),
        "digit_count": F.length(d) - F.length(F.regexp_replace(d, "[0-9]", "")),
        "label_length": F.length(first_label(d)),
        "label_entropy": entropy(first_label(d)),
    }
    return domains.select(*keep, label.alias("label"), *[c.alias(n) for n, c in {**known, **extra}.items()])


def _class_rank(df: DataFrame, label: str, row_id: str, name: str) -> DataFrame:
    """Position of a row within its class by digest of its id, and ``_size`` of the class: repeatable, and cut by
    digest prefix so that no task sees a whole class."""
    keyed = df.withColumn("_digest", F.md5(F.col(row_id).cast("string")))
    by_digest = running.hash_slice(F.col("_digest"))
    ranked = running.ranked(keyed, [label], ["_digest", row_id], by_digest, name, total="_size")
    return ranked.drop("_digest")


def stratified_split(df: DataFrame, label: str, row_id: str, train_share: float = 0.8) -> DataFrame:
    """Add ``split`` = train or test with the same share of every class."""
    ranked = _class_rank(df, label, row_id, "_rank")
    limit = F.floor(F.col("_size") * train_share + 0.5)
    return ranked.withColumn("split", F.when(F.col("_rank") <= limit, "train").otherwise("test")).drop("_rank", "_size")


def kfold_assign(df: DataFrame, label: str, row_id: str, folds: int = 5) -> DataFrame:
    """Add ``fold`` 0..folds-1, every class spread evenly."""
    ranked = _class_rank(df, label, row_id, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank", "_size")


def standard_scale(df: DataFrame, features: Sequence[str], fit_on: Column) -> DataFrame:
    """Centre and divide by the population deviation of the rows ``fit_on``; constant features are only centred."""
    moments = (
        df.filter(fit_on)
        .agg(F.struct(*[x for c in features for x in (F.avg(c).alias(f"mu_{c}"), F.stddev_pop(c).alias(f"sd_{c}"))]))
        .scalar()
    )

    def scaled(c: str) -> Column:
        mu, sd = moments.getField(f"mu_{c}"), moments.getField(f"sd_{c}")
        return (F.col(c) - mu) / F.when(sd > 0, sd).otherwise(1.0)

    return df.withColumns({c: scaled(c) for c in features})


# --- classifiers --------------------------------------------------------------------------------
def _pipeline(features: Sequence[str], estimator, scale: bool) -> Pipeline:
    """Assembler, optional scaler and classifier in one pipeline, so the fitted scaler is saved with the model.

    MLlib scales by the sample deviation; the constant factor to the population one does not change a fit.
    """
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw" if scale else "features")]
    if scale:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, estimator])


def random_forest(features: Sequence[str], trees: int = 100, depth: int = 15, seed: int = 42) -> Pipeline:
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=1024)
    return _pipeline(features, forest, scale=False)


def gradient_boosting(features: Sequence[str], rounds: int = 100, depth: int = 6, step: float = 0.1, seed: int = 42) -> Pipeline:
    boosted = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, maxMemoryInMB=1024)
    return _pipeline(features, boosted, scale=False)


def neural_network(features: Sequence[str], hidden: Sequence[int] = (128, 64, 32), rounds: int = 1000, seed: int = 42) -> Pipeline:
    layers = [len(features), *hidden, 2]
    return _pipeline(features, MultilayerPerceptronClassifier(layers=layers, maxIter=rounds, seed=seed), scale=True)


def phishing_score(predictions: DataFrame, *keep: str) -> DataFrame:
    """``score`` = probability of class 1, next to the kept columns."""
    return predictions.select(*keep, vector_to_array("probability")[1].alias("score"))


def packed(kept: DataFrame, pipeline: Pipeline) -> DataFrame:
    """Kept rows dealt out evenly into as many tasks as a round of the fit keeps busy: a fit is hundreds of rounds, and what a task
    costs by itself, or a core waits for the largest one, comes back in each of them."""
    rows, least = max(kept.count(), 1), TASK_ROWS.get(type(pipeline.getStages()[-1]), 25_000)
    cores = kept.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(-(-rows // least), CORE_TASKS * cores), -(-rows // FULL_TASK))
    return kept.repartition(tasks) if tasks > 1 else kept.coalesce(1)


def train(df: DataFrame, pipeline: Pipeline) -> PipelineModel:
    """Fit on rows with ``label``; the input is read many times, so it is kept in memory and on disk meanwhile."""
    kept = df.persist()
    try:
        return pipeline.fit(packed(kept, pipeline))
    finally:
        kept.unpersist()


A = TypeVar("A")
B = TypeVar("B")


def at_once(work: Callable[[A], B], items: Sequence[A], parallelism: int) -> list[B]:
    """``work`` for every item, so many at a time: their Spark jobs share the executors, which one small fit leaves idle."""
    session = SparkSession.active()
    with ThreadPoolExecutor(max(1, min(parallelism, len(items)))) as pool:
        return list(pool.map(inheritable_thread_target(session)(work), items))


def cross_validate(
    df: DataFrame, pipeline: Callable[[], Pipeline], label: str = "label", row_id: str = "domain", folds: int = 5, parallelism: int = 5
) -> DataFrame:
    """Mean and population deviation of accuracy, F1 and AUC over the held-out folds, in one row.

    The folds are marked once and kept; ``parallelism`` of them are fitted side by side.
    """
    split = kfold_assign(df, label, row_id, folds).persist()
    split.count()  # kept before the folds are read side by side

    def held(fold: int) -> DataFrame:
        model = pipeline().fit(split.filter(F.col("fold") != fold))
        return phishing_score(model.transform(split.filter(F.col("fold") == fold)), "fold", label)

    parts = at_once(held, range(folds), parallelism)
    held_out = parts[0]
    for part in parts[1:]:
        held_out = held_out.unionByName(part)
    held_out = settled(held_out, "scores")  # all measures read the same scores
    per_fold = metrics.binary_metrics(held_out, by=["fold"]).join(metrics.roc_auc(held_out, by=["fold"]), "fold")
    names = ("accuracy", "f1", "roc_auc")
    summary = per_fold.agg(
        *[x for n in names for x in (F.avg(n).alias(f"{n}_mean"), F.stddev_pop(n).alias(f"{n}_std"))]
    )
    try:
        return df.sparkSession.createDataFrame([summary.first()], summary.schema)  # one row, while the folds are kept
    finally:
        split.unpersist()


def evaluate_models(test: DataFrame, models: dict[str, PipelineModel], label: str = "label") -> DataFrame:
    """Held-out metrics of fitted models, one row per model; ``ordinal`` is the given order.

    The scores of all models are stacked, so one aggregation measures them all.
    """
    stacked = None
    for ordinal, (name, model) in enumerate(models.items()):
        part = phishing_score(model.transform(test), label).withColumns({"ordinal": F.lit(ordinal), "model": F.lit(name)})
        stacked = part if stacked is None else stacked.unionByName(part)
    by, stacked = ["ordinal", "model"], settled(stacked, "scores")
    return metrics.binary_metrics(stacked, by=by).join(metrics.roc_auc(stacked, by=by), by)


def select_model(
    rows: DataFrame, features: Sequence[str], pipelines: dict[str, Pipeline], path: str, row_id: str = "domain", parallelism: int = 4
) -> DataFrame:
    """Whole training run: split, fit every pipeline (``parallelism`` side by side), measure, keep the best by F1 with its metadata.

    Returns the metrics of all models. Only the name of the winner comes to the driver.
    """
    split = settled(stratified_split(rows, "label", row_id), "split")
    fit, test = split.filter("split = 'train'").persist(), split.filter("split = 'test'")
    fit.count()
    try:
        models = dict(zip(pipelines, at_once(lambda pipeline: pipeline.fit(packed(fit, pipeline)), list(pipelines.values()), parallelism), strict=True))
    finally:
        fit.unpersist()
    results = evaluate_models(test, models)
    best = metrics.model_ranking(results).first()["model"]
    model_metadata_sink(models[best], results.filter(F.col("model") == best), features, best, path, fit, test)
    return results


# --- use of a model -----------------------------------------------------------------------------
def score_batch(
    rows: DataFrame, model: PipelineModel, features: Sequence[str], lists: L.HostLists | ListTables = L.HostLists(), keep: Sequence[str] = ("domain",)
) -> DataFrame:
    """Prediction and confidence per domain, with the host lists on top and the columns ``keep`` in front. Row-wise, so the rows
    may be a stream."""
    probability = vector_to_array("probability")
    scored = model.transform(rows).select(
        *keep,
        F.when(F.col("prediction") == 1, "phishing").otherwise("legitimate").alias("prediction"),
        F.array_max(probability).alias("confidence"),
        F.lit(len(features)).alias("features_used"),
    )
    return list_override(scored, lists)


def feature_importance(spark: SparkSession, model: PipelineModel, features: Sequence[str], top: int = 10) -> DataFrame:
    """The most important features of a tree model; one number per feature is all that is read."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(weight)) for name, weight in zip(features, weights, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(top)


def model_metadata_sink(
    model: PipelineModel, evaluation: DataFrame, features: Sequence[str], model_type: str, path: str,
    fit: DataFrame, test: DataFrame,
) -> None:
    """Save the fitted pipeline and, as one JSON row, its type, features, split sizes, time and evaluation."""
    model.write().overwrite().save(f"{path}/model")
    trained, tested = (df.agg(F.count(F.lit(1))).scalar() for df in (fit, test))
    described = evaluation.select(
        F.lit(model_type).alias("model_type"),
        F.array(*[F.lit(f) for f in features]).alias("features"),
        F.lit(len(features)).alias("num_features"),
        (trained + tested).alias("num_samples"),
        trained.alias("num_train"),
        tested.alias("num_test"),
        F.current_timestamp().alias("timestamp"),
        F.struct(*evaluation.columns).alias("evaluation"),
    )
    described.write.mode("overwrite").json(f"{path}/metadata")
