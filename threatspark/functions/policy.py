"""Verdict-to-action expressions and block-type rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DecisionPolicy:
    """Thresholds and switches of the response policy."""

    high: float = 0.85
    low: float = 0.65
    block_high_confidence: bool = True
    alert_phishing: bool = True
    alert_suspicious_legitimate: bool = False


LIVE_POLICY = DecisionPolicy(high=0.80, low=0.60)


def risk_level(prediction: Column, confidence: Column) -> Column:
    phishing = prediction == "phishing"
    return (
        F.when(phishing & (confidence >= 0.95), "high")
        .when(phishing & (confidence >= 0.80), "medium")
        .when(phishing, "low")
        .when(confidence >= 0.80, "low")
        .otherwise("medium")
    )


def alert_severity(prediction: Column, confidence: Column, policy: DecisionPolicy = DecisionPolicy()) -> Column:
    phishing = prediction == "phishing"
    return (
        F.when(phishing & (confidence >= policy.high), "critical")
        .when(phishing & (confidence >= policy.low), "high")
        .when(phishing | (confidence < policy.low), "medium")
        .otherwise("low")
    )


def percent(value: Column) -> Column:
    """Two places, halves to even."""
    return F.format_string("%.2f%%", F.bround(value * 100, 2))


def decision(prediction: Column, confidence: Column, policy: DecisionPolicy = DecisionPolicy()) -> Column:
    """struct(alert_severity, action_taken, reason, blocked) for a verdict."""
    phishing = prediction == "phishing"
    high, low = confidence >= policy.high, confidence >= policy.low
    block = phishing & high & F.lit(policy.block_high_confidence)
    alert = phishing & F.lit(policy.alert_phishing)
    doubt = ~phishing & ~low & F.lit(policy.alert_suspicious_legitimate)
    text = percent(confidence)
    action = F.when(block, "block_dns").when(alert | doubt, "alert").otherwise("log_only")
    reason = (
        F.when(block, F.concat(F.lit("High confidence phishing ("), text, F.lit(")")))
        .when(alert & low, F.concat(F.lit("Phishing detected ("), text, F.lit(")")))
        .when(alert, F.concat(F.lit("Possible phishing ("), text, F.lit(")")))
        .when(phishing, F.lit("Phishing detected but no action configured"))
        .when(doubt, F.concat(F.lit("Legitimate but suspicious ("), text, F.lit(")")))
        .otherwise(F.lit("Legitimate domain"))
    )
    return F.struct(
        alert_severity(prediction, confidence, policy).alias("alert_severity"),
        action.alias("action_taken"),
        reason.alias("reason"),
        action.isin("block_dns", "block_network").alias("blocked"),
    )


def block_type(error_type: Column, message: Column) -> Column:
    """Kind of a system block by the first matching word group of its type and message."""
    text = F.lower(F.concat_ws(" ", error_type, message))

    def says(*words: str) -> Column:
        found = text.contains(words[0])
        for word in words[1:]:
            found = found | text.contains(word)
        return found

    return (
        F.when(says("ssl", "certificate"), "ssl_error")
        .when(says("timeout", "timed out"), "connection_timeout")
        .when(says("refused"), "firewall")
        .when(says("dns", "resolve"), "dns_failure")
        .when(says("reset"), "connection_reset")
        .when(says("antivirus", "quarantine"), "antivirus")
        .otherwise("unknown")
    )
