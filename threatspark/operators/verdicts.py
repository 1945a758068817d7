"""Verdict operators: list override, reputation, the layered cascade, policy decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatspark import lexicon as L
from threatspark.functions import policy
from threatspark.functions.hosts import in_list
from threatspark.functions.policy import DecisionPolicy
from threatspark.operators.matching import ListTables, feed_rank, with_lists
from threatspark.operators.scoring import brand_heuristic, computed, lexical_risk

FEED_SOURCES = (("phishtank", 0.95, "PhishTank verified phishing feed"), ("openphish", 0.90, "OpenPhish community feed"))
# fixed values: reasons of an unknown host without and with an external verdict table
NOT_FOUND = "Not found in PhishTank, OpenPhish, or brand-impersonation heuristic (Safe Browsing key not set)."
NOT_FOUND_EXTERNAL = "Not found in Google Safe Browsing, PhishTank, OpenPhish, or brand-impersonation heuristic."


def list_override(predictions: DataFrame, lists: L.HostLists | ListTables = L.HostLists(), domain: str = "domain") -> DataFrame:
    """Predictions with the block list (phishing, 1.0, high) and then the allow list (legitimate, 1.0, low) on top."""
    flagged, block, allow = _flagged(predictions, domain, lists)

    def pick(blocked, allowed, column: Column) -> Column:
        return F.when(block, F.lit(blocked)).when(allow, F.lit(allowed)).otherwise(column)

    risk = F.col("risk_level") if "risk_level" in predictions.columns else policy.risk_level(
        F.col("prediction"), F.col("confidence")
    )
    return flagged.withColumns({
        "prediction": pick("phishing", "legitimate", F.col("prediction")),
        "confidence": pick(1.0, 1.0, F.col("confidence")),
        "risk_level": pick("high", "low", risk),
        "features_used": pick(0, 0, F.col("features_used")),
    }).drop("_listed_block", "_listed_allow")


def _flagged(df: DataFrame, domain: str, lists: L.HostLists | ListTables) -> tuple[DataFrame, Column, Column]:
    """The rows and their list flags: expressions for literal lists, joined columns for tables."""
    if isinstance(lists, ListTables):
        return with_lists(df, domain, lists, "_listed_block", "_listed_allow"), F.col("_listed_block"), F.col("_listed_allow")
    return df, in_list(F.col(domain), lists.block), in_list(F.col(domain), lists.allow)


def logged_event_override(events: DataFrame, lists: L.HostLists | ListTables = L.HostLists()) -> DataFrame:
    """Stored events re-classified by the lists; others keep their values and get ``ml_model`` as default source."""
    flagged, block, allow = _flagged(events, "domain", lists)
    source = F.col("source") if "source" in events.columns else F.lit(None).cast("string")
    return flagged.withColumns({
        "prediction": F.when(block, "phishing").when(allow, "legitimate").otherwise(F.col("prediction")),
        "blocked": F.when(block, True).when(allow, False).otherwise(F.col("blocked")),
        "confidence": F.when(block | allow, 1.0).otherwise(F.col("confidence")),
        "risk_level": F.when(block, "high").when(allow, "low").otherwise(F.col("risk_level")),
        "alert_severity": F.when(block, "critical").otherwise(F.col("alert_severity")),
        "action_taken": F.when(block, "block_dns").otherwise(F.col("action_taken")),
        "reason": F.when(block, "Known malicious domain — REJECTED")
        .when(allow, "Trusted domain — APPROVED")
        .otherwise(F.col("reason")),
        "source": F.when(block | allow, "list_engine").otherwise(F.coalesce(source, F.lit("ml_model"))),
    }).drop("_listed_block", "_listed_allow")


def decide(predictions: DataFrame, rules: DecisionPolicy = DecisionPolicy()) -> DataFrame:
    """Predictions with alert severity, action, reason and blocked flag."""
    decided = policy.decision(F.col("prediction"), F.col("confidence"), rules)
    return predictions.withColumn("_d", decided).select(*predictions.columns, "_d.*")


def _reputation(verdict: str, source: Column, confidence: Column, reason: Column, threat: str = "") -> Column:
    return F.struct(
        F.lit(verdict).alias("verdict"), source.alias("source"), confidence.cast("double").alias("confidence"),
        reason.alias("reason"), F.lit(threat).alias("threat_type"),
    )


def reputation_check(
    hosts: DataFrame,
    host: str,
    feeds: list[DataFrame],
    external: DataFrame | None = None,
    lists: L.HostLists = L.HostLists(),
    rules: L.BrandRules = L.BrandRules(),
) -> DataFrame:
    """Reputation of distinct hosts: trusted anchor, external verdicts, feeds in order, brand heuristic, unknown.

    ``external`` is an optional table (host, threat_type) of URL-reputation hits, ranked before the feeds.
    """
    h = F.col(host)
    joined = hosts.join(feed_rank(hosts, host, feeds), host, "left")
    if external is not None:
        hits = external.groupBy(F.col("host").alias(host)).agg(F.min("threat_type").alias("_threat"))
        joined = joined.join(hits, host, "left")
    else:
        joined = joined.withColumn("_threat", F.lit(None).cast("string"))
    # only hosts that no list or feed has settled are scored
    settled = in_list(h, lists.anchors) | F.col("_threat").isNotNull() | F.col("feed_rank").isNotNull()
    judged = brand_heuristic(joined.withColumn("_open", F.when(~settled, h)), "_open", "_brand", rules)
    result = (
        F.when(h == "", _reputation("unknown", F.lit("none"), F.lit(0.0), F.lit("Empty input.")))
        .when(
            in_list(h, lists.anchors),
            _reputation(
                "legitimate", F.lit("trusted_anchor"), F.lit(1.0),
                F.concat(h, F.lit(" is on the trusted-anchor allow-list.")),
            ),
        )
        .when(
            F.col("_threat").isNotNull(),
            F.struct(
                F.lit("phishing").alias("verdict"), F.lit("google_safe_browsing").alias("source"),
                F.lit(1.0).alias("confidence"),
                F.concat(F.lit("Google Safe Browsing flagged this URL as "), F.col("_threat"), F.lit(".")).alias("reason"),
                F.col("_threat").alias("threat_type"),
            ),
        )
    )
    for rank, (name, confidence, text) in enumerate(FEED_SOURCES[: len(feeds)], start=1):
        result = result.when(
            F.col("feed_rank") == rank,
            _reputation(
                "phishing", F.lit(name), F.lit(confidence), F.concat(h, F.lit(f" appears in the {text}.")),
                "SOCIAL_ENGINEERING",
            ),
        )
    result = result.when(
        F.col("_brand.is_phishing"),
        _reputation(
            "phishing", F.lit("heuristic"), F.col("_brand.confidence"), F.col("_brand.reason"), "SOCIAL_ENGINEERING"
        ),
    ).otherwise(_reputation("unknown", F.lit("none"), F.lit(0.0), F.lit(NOT_FOUND if external is None else NOT_FOUND_EXTERNAL)))
    return computed(judged, "_r", result).select(*hosts.columns, "_r.*")


def verdict_cascade(
    hosts: DataFrame,
    host: str,
    feeds: list[DataFrame],
    model_scores: DataFrame | None = None,
    external: DataFrame | None = None,
    lists: L.HostLists = L.HostLists(),
    told_signals: tuple[int, int] = (4, 3),
) -> DataFrame:
    """Layered verdict of distinct hosts. Reasons tell the first ``told_signals`` of phishing and of open verdicts.

    Block list, allow list, reputation, then model (phishing from .6) or lexical score (from .55), then a sure
    legitimate model (from .7 with a lexical score under .3), else unknown. ``model_scores`` (host, prediction,
    confidence) is optional; without it the reason of an open verdict says so. The hosts are read once; the lists settle too few of them to be worth a second scan.
    """
    h = F.col(host)
    judged = reputation_check(hosts, host, feeds, external, lists)
    if model_scores is not None:
        scores = model_scores.select(
            F.col(host), F.col("prediction").alias("_ml_label"), F.col("confidence").alias("_ml_conf")
        )
        judged = judged.join(scores, host, "left")
    else:
        judged = judged.withColumns({"_ml_label": F.lit(None).cast("string"), "_ml_conf": F.lit(None).cast("double")})

    judged = judged.withColumns({"_block": in_list(h, lists.block), "_allow": in_list(h, lists.allow)})
    block, allow = F.col("_block"), F.col("_allow")
    known = block | allow | (F.col("verdict") != "unknown")
    scored = lexical_risk(judged.withColumn("_unsettled", F.when(~known, h)), "_unsettled", "_lex")
    ran = ~known & F.col("_ml_label").isNotNull()
    conf, score = F.coalesce("_ml_conf", F.lit(0.0)), F.col("_lex.score")
    by_model = ran & (F.col("_ml_label") == "phishing") & (conf >= 0.6)
    by_score = ~known & (score >= 0.55)
    safe = ran & (F.col("_ml_label") == "legitimate") & (conf >= 0.7) & (score < 0.3)
    whole_percent = F.concat(F.format_string("%.0f", F.bround(conf * 100, 0)), F.lit("%"))

    def signals(n: int) -> Column:
        return F.when(
            F.size("_lex.reasons") > 0,
            F.concat(F.lit("Signals: "), F.array_join(F.slice(F.col("_lex.reasons"), 1, n), "; ")),
        )

    phishing_reason = F.concat_ws(
        " · ", F.when(by_model, F.concat(F.lit("ML model says PHISHING ("), whole_percent, F.lit(" confidence)"))), signals(told_signals[0])
    )
    open_reason = F.concat_ws(
        " · ", F.lit("ML model unavailable" if model_scores is None else None).cast("string"), F.when(ran, F.concat(F.lit("ML: "), F.col("_ml_label"), F.lit(" ("), whole_percent, F.lit(")"))), signals(told_signals[1])
    )
    final = (
        F.when(
            block,
            F.struct(
                F.lit("phishing").alias("verdict"), F.lit(True).alias("blocked"), F.lit(1.0).alias("confidence"),
                F.lit("Domain matches a known phishing pattern — REJECT.").alias("reason"),
                F.lit("hardcoded_blocklist").alias("source"),
            ),
        )
        .when(
            allow,
            F.struct(
                F.lit("legitimate").alias("verdict"), F.lit(False).alias("blocked"), F.lit(1.0).alias("confidence"),
                F.lit("Domain is recognised as trusted — APPROVE.").alias("reason"),
                F.lit("hardcoded_allowlist").alias("source"),
            ),
        )
        .when(
            known,
            F.struct(
                F.col("verdict").alias("verdict"), (F.col("verdict") == "phishing").alias("blocked"),
                F.col("confidence").alias("confidence"), F.col("reason").alias("reason"), F.col("source").alias("source"),
            ),
        )
        .when(
            by_model | by_score,
            F.struct(
                F.lit("phishing").alias("verdict"), F.lit(True).alias("blocked"),
                F.greatest(F.when(by_model, conf).otherwise(0.0), score).alias("confidence"),
                phishing_reason.alias("reason"),
                F.when(by_model, "ml_model").otherwise("heuristic").alias("source"),
            ),
        )
        .when(
            safe,
            F.struct(
                F.lit("legitimate").alias("verdict"), F.lit(False).alias("blocked"), conf.alias("confidence"),
                F.concat(F.lit("ML model says LEGITIMATE ("), whole_percent, F.lit(" confidence) — APPROVE.")).alias("reason"),
                F.lit("ml_model").alias("source"),
            ),
        )
        .otherwise(
            F.struct(
                F.lit("unknown").alias("verdict"), F.lit(False).alias("blocked"),
                F.greatest(conf, score).alias("confidence"),
                F.when(open_reason != "", open_reason).otherwise("Domain not recognised — needs review.").alias("reason"),
                F.lit("none").alias("source"),
            )
        )
    )
    return computed(scored, "_f", final).select(
        *hosts.columns, "_f.verdict", "_f.blocked", "_f.confidence", "_f.reason", "_f.source", ran.alias("ml_ran")
    )


def loggable(verdicts: DataFrame, ts: Column) -> DataFrame:
    """Settled verdicts as detection-log events; unknown ones are not logged."""
    phishing, blocked = F.col("verdict") == "phishing", F.col("blocked")
    return verdicts.filter(F.col("verdict").isin("phishing", "legitimate")).select(
        "domain",
        F.lit(None).cast("string").alias("destination_ip"),
        F.when(phishing, "phishing").otherwise("legitimate").alias("prediction"),
        "confidence",
        F.when(phishing, "high").otherwise("low").alias("risk_level"),
        F.lit(0).alias("features_used"),
        ts.alias("ts"),
        F.when(blocked, "critical").otherwise("low").alias("alert_severity"),
        F.when(blocked, "block_dns").otherwise("log_only").alias("action_taken"),
        "reason",
        "blocked",
        "source",
    )


def label_agreement(feed_labels: DataFrame, verifier: DataFrame) -> DataFrame:
    """Feed label against verifier label per domain; a domain the verifier failed on is ``unknown`` and no match."""
    joined = feed_labels.join(verifier, "domain", "left")
    verified = (
        F.when(F.col("is_phishing").isNull(), "unknown")
        .when(F.col("is_phishing"), "phishing")
        .otherwise("legitimate")
    )
    return joined.withColumn("verifier_label", verified).select(
        "domain",
        "feed_label",
        "verifier_label",
        F.coalesce("confidence", F.lit(0.0)).alias("verifier_confidence"),
        (F.col("feed_label") == F.col("verifier_label")).alias("match"),
        (F.col("verifier_label") == "phishing").cast("int").alias("label"),
    )
