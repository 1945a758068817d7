"""Whole-table plans: on-demand domain checks and the capture-to-decision run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatspark import lexicon as L
from threatspark.functions.hosts import clean_sni, host_of
from threatspark.functions.policy import LIVE_POLICY, DecisionPolicy
from threatspark.model import training
from threatspark.operators.matching import ListTables
from threatspark.operators.scoring import keyword_verdict
from threatspark.operators.verdicts import decide, list_override, verdict_cascade

RULE_FEATURES = 48  # fixed value: what the keyword rules report as features_used


def check_domains(
    requests: DataFrame,
    column: str,
    feeds: list[DataFrame],
    model_scores: DataFrame | None = None,
    external: DataFrame | None = None,
    lists: L.HostLists = L.HostLists(),
) -> DataFrame:
    """Verdict of every distinct host asked for. Repeated requests are folded before any join, so a host that fills
    the request log costs one row, and the join on feeds reuses their shuffle."""
    named = F.array_remove(F.array(host_of(F.col(column))), "")
    hosts = requests.select(F.explode(named).alias("domain")).filter(F.col("domain").isNotNull()).distinct()
    return verdict_cascade(hosts, "domain", feeds, model_scores, external, lists)


def domain_events(queries: DataFrame, handshakes: DataFrame) -> DataFrame:
    """Names from queries and server names as they came off the wire, cleaned; rows without a name are dropped."""
    columns = ["event_id", "ts", "dst_ip"]
    dns = queries.select(*columns, F.col("query_domain").alias("_raw"), F.lit("dns").alias("origin"))
    tls = handshakes.select(*columns, F.col("sni").alias("_raw"), F.lit("sni").alias("origin"))
    names = F.array_remove(F.array(clean_sni(F.col("_raw"))), "")
    return dns.unionByName(tls).select(*columns, "origin", F.explode(names).alias("domain"))


def predict(
    events: DataFrame, lists: L.HostLists | ListTables = L.HostLists(), model: PipelineModel | None = None, features: Sequence[str] = training.DOMAIN_FEATURES
) -> DataFrame:
    """Prediction per domain event: the lists first, else a fitted pipeline over the lexical ``features`` of the name, or without
    one the keyword rules of its origin."""
    if model is not None:
        named = training.domain_training_rows(events, F.lit(None).cast("int"), keep=events.columns).drop("label")
        scored = training.score_batch(training.training_matrix(named, drop=events.columns, keep=events.columns), model, features, lists, events.columns)
        return scored.select(*events.columns, "prediction", "confidence", "risk_level", "features_used")
    ruled = keyword_verdict(events, "domain", F.col("origin") == "dns").withColumn("features_used", F.lit(RULE_FEATURES))
    return list_override(ruled, lists)


def detect_connections(
    connections: DataFrame, model: PipelineModel, features: Sequence[str], lists: L.HostLists | ListTables = L.HostLists(), rules: DecisionPolicy = LIVE_POLICY
) -> DataFrame:
    """Feature rows of :func:`operators.features.live_connections` to logged decisions by a fitted pipeline, the lists on top.

    Row-wise, so tables and streams share it; ``features_used`` is the number of features the pipeline reads.
    """
    flat = training.training_matrix(connections, drop=("event_id",), keep=("event_id", "ts", "domain", "dst_ip"))
    flat = flat.select("event_id", "ts", "domain", F.col("dst_ip").alias("destination_ip"), *features)
    return decide(training.score_batch(flat, model, features, lists, keep=("event_id", "ts", "domain", "destination_ip")), rules)


def detect(
    events: DataFrame, lists: L.HostLists | ListTables = L.HostLists(), rules: DecisionPolicy = LIVE_POLICY,
    model: PipelineModel | None = None, features: Sequence[str] = training.DOMAIN_FEATURES,
) -> DataFrame:
    """Domain events to logged decisions. Row-wise only (with literal lists), so batch and stream share it and nothing is shuffled."""
    return decide(predict(events, lists, model, features).withColumnRenamed("dst_ip", "destination_ip"), rules)
