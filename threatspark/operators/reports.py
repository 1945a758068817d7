"""Reports: totals, distributions, top lists and time windows over detections, blocks and captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatspark import lexicon as L
from threatspark.functions.policy import block_type


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 when there is nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


# --- predictions and decisions ------------------------------------------------------------------
def phishing_only(predictions: DataFrame) -> DataFrame:
    return predictions.filter(F.col("prediction") == "phishing")


def blocked_only(events: DataFrame) -> DataFrame:
    return events.filter("blocked").select("event_id", "domain")


def https_flows(packets: DataFrame, ports: tuple[int, ...] = L.HTTPS_PORTS) -> DataFrame:
    return packets.filter((F.col("protocol") == "TCP") & F.col("dst_port").isin(*ports))


def prediction_stats(predictions: DataFrame) -> DataFrame:
    """Totals over model predictions (rows settled by a list carry no features and are left out)."""
    return predictions.filter(F.col("features_used") > 0).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(F.col("prediction") == "phishing").alias("phishing_detected"),
        F.count_if(F.col("prediction") == "legitimate").alias("legitimate_count"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk_count"),
    )


def decision_stats(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("total_decisions"),
        F.count_if("blocked").alias("phishing_blocked"),
        F.count_if(F.col("action_taken") == "alert").alias("phishing_alerted"),
        (F.count_if("blocked") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("blocking_rate"),
    )


def detection_totals(events: DataFrame) -> DataFrame:
    """Phishing, blocked, safe and unknown events and the detection rate in percent."""
    phishing, safe = F.col("prediction") == "phishing", F.col("prediction") == "legitimate"
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(phishing).alias("total_phishing"),
        F.count_if(phishing & F.col("blocked")).alias("total_blocked"),
        F.count_if(safe).alias("total_safe"),
        F.count_if(~phishing & ~safe).alias("total_unknown"),
    ).withColumn("detection_rate", 100 * share(F.col("total_phishing"), F.col("total_phishing") + F.col("total_safe")))


def combined_block_totals(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """Engine and system blocks in one row."""
    engine = events.filter((F.col("prediction") == "phishing") & F.col("blocked")).select(F.lit("engine").alias("kind"))
    system = blocks.select(F.lit("system").alias("kind"))
    return engine.unionByName(system).agg(
        F.count_if(F.col("kind") == "engine").alias("engine_blocked"),
        F.count_if(F.col("kind") == "system").alias("system_blocked"),
        F.count(F.lit(1)).alias("total_blocked"),
    )


def confidence_bin(confidence: Column) -> Column:
    bins = L.CONFIDENCE_BINS
    chain = F.when(confidence < bins[0][0], bins[0][1])
    for edge, name in bins[1:-1]:
        chain = chain.when(confidence < edge, name)
    return chain.otherwise(bins[-1][1])


def confidence_histogram(events: DataFrame) -> DataFrame:
    """Phishing detections per confidence bin, one row per bin, empty bins included."""
    spread = events.filter(F.col("prediction") == "phishing").agg(
        *[F.count_if(confidence_bin(F.col("confidence")) == name).alias(name) for _, name in L.CONFIDENCE_BINS]
    )
    names = [F.struct(F.lit(name).alias("bin"), F.col(f"`{name}`").alias("detections")) for _, name in L.CONFIDENCE_BINS]
    return spread.select(F.inline(F.array(*names)))


def feedback_accuracy(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Share of the decisions with feedback that were marked correct."""
    rated = feedback.join(events.select("event_id"), "event_id", "left_semi")
    return rated.agg(
        F.count(F.lit(1)).alias("rated"),
        F.count_if("was_correct").alias("correct"),
        share(F.count_if("was_correct"), F.count(F.lit(1))).alias("accuracy"),
    )


def run_summary(events: DataFrame) -> DataFrame:
    """Safe, alerted and blocked domains of a run."""
    phishing = F.col("prediction") == "phishing"
    per_domain = events.groupBy("domain").agg(
        F.bool_or(~phishing & ~F.col("blocked")).alias("safe"),
        F.bool_or(phishing & ~F.col("blocked")).alias("alerted"),
        F.bool_or("blocked").alias("blocked"),
    )
    return per_domain.agg(
        F.count_if("safe").alias("safe_domains"),
        F.count_if("alerted").alias("detected_phishing"),
        F.count_if("blocked").alias("blocked_domains"),
    )


# --- labels -------------------------------------------------------------------------------------
def class_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share of all rows per label. The total is a window over the few label counts, not over the rows."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("records"))
    return counts.withColumn("share", F.col("records") / F.sum("records").over(Window.partitionBy()))


share_of_total = class_distribution


def match_rate(agreement: DataFrame) -> DataFrame:
    """Agreement per feed label and overall (``all``)."""
    return (
        agreement.rollup("feed_label")
        .agg(
            F.grouping("feed_label").alias("_all"),
            F.count(F.lit(1)).alias("domains"),
            F.count_if("match").alias("matches"),
            F.avg(F.col("match").cast("double")).alias("rate"),
        )
        .withColumn("feed_label", F.when(F.col("_all") == 1, "all").otherwise(F.col("feed_label")))
        .drop("_all")
    )


def verification_accuracy(verifier: DataFrame, expected: DataFrame) -> DataFrame:
    """Verifier verdicts against expected ones (domain, is_phishing)."""
    truth = expected.select("domain", F.col("is_phishing").alias("_expected"))
    correct = F.col("is_phishing") == F.col("_expected")
    return verifier.join(truth, "domain").agg(
        F.count(F.lit(1)).alias("domains"),
        F.count_if(correct).alias("correct"),
        (100 * share(F.count_if(correct), F.count(F.lit(1)))).alias("accuracy_percent"),
    )


# --- blocks -------------------------------------------------------------------------------------
def with_block_type(blocks: DataFrame) -> DataFrame:
    """Block events with the derived type; the recorded type stays in ``error_type``."""
    return blocks.withColumn("block_type", block_type(F.col("error_type"), F.col("error_message")))


def blocks_by_type(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block_type").agg(F.count(F.lit(1)).alias("blocks"))


def blocks_by_source_and_type(blocks: DataFrame) -> DataFrame:
    """Counts by source, by type and in total from one pass, largest first."""
    sets = [[F.col("source")], [F.col("block_type")], []]
    grouped = blocks.groupingSets(sets, "source", "block_type").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("blocks")
    )
    return grouped.select(
        F.when(F.col("_g") == 1, "source").when(F.col("_g") == 2, "type").otherwise("total").alias("grouped_by"),
        F.coalesce("source", "block_type", F.lit("all")).alias("name"),
        "blocks",
    ).orderBy("grouped_by", F.col("blocks").desc(), "name")


def recent_events(events: DataFrame, count: int = 10) -> DataFrame:
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(count)


recent_blocks = recent_events


def recent_unique_block_domains(blocks: DataFrame, count: int = 10) -> DataFrame:
    """The most recently blocked distinct domains with type and time of their latest block."""
    latest = F.max(F.struct("ts", "event_id", "block_type")).alias("latest")
    return (
        blocks.groupBy("domain")
        .agg(latest)
        .select("domain", F.col("latest.block_type").alias("block_type"), F.col("latest.ts").alias("ts"), F.col("latest.event_id").alias("event_id"))
        .orderBy(F.col("ts").desc(), F.col("event_id").desc())
        .limit(count)
    )


# --- captures -----------------------------------------------------------------------------------
def packet_counters(queries: DataFrame, handshakes: DataFrame, packets: DataFrame) -> DataFrame:
    """DNS, TLS and flow packets and all packets captured."""
    kinds = None
    for kind, df in (("dns", queries), ("tls", handshakes), ("flow", packets)):
        part = df.select(F.lit(kind).alias("kind"))
        kinds = part if kinds is None else kinds.unionByName(part)
    return kinds.agg(
        F.count(F.lit(1)).alias("packets_captured"),
        F.count_if(F.col("kind") == "dns").alias("dns_packets"),
        F.count_if(F.col("kind") == "tls").alias("tls_packets"),
        F.count_if(F.col("kind") == "flow").alias("flow_packets"),
    )


def top_domains(queries: DataFrame, count: int = 10) -> DataFrame:
    return (
        queries.groupBy(F.col("query_domain").alias("domain"))
        .agg(F.count(F.lit(1)).alias("queries"))
        .orderBy(F.col("queries").desc(), "domain")
        .limit(count)
    )


def top_sni_alphabetical(handshakes: DataFrame, count: int = 10) -> DataFrame:
    return handshakes.filter(F.col("sni").isNotNull()).select("sni").distinct().orderBy("sni").limit(count)


def capture_summary(queries: DataFrame, handshakes: DataFrame, hosts: DataFrame) -> DataFrame:
    """Queries, distinct names, distinct server names and distinct plain-text hosts of a capture."""
    seen = (
        queries.select(F.lit("dns").alias("kind"), F.col("query_domain").alias("name"))
        .unionByName(handshakes.filter(F.col("sni").isNotNull()).select(F.lit("sni").alias("kind"), F.col("sni").alias("name")))
        .unionByName(hosts.select(F.lit("http").alias("kind"), F.col("host").alias("name")))
    )
    per_name = seen.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("sightings"))
    return per_name.groupBy("kind").agg(
        F.count(F.lit(1)).alias("names"), F.sum("sightings").alias("sightings"), F.max("sightings").alias("most_seen")
    )


def handshakes_by_endpoint(handshakes: DataFrame) -> DataFrame:
    """Handshakes, server names and time span per destination endpoint."""
    return handshakes.groupBy(F.concat_ws(":", "dst_ip", "dst_port").alias("endpoint")).agg(
        F.count(F.lit(1)).alias("handshakes"),
        F.countDistinct("sni").alias("server_names"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def feed_stats(feeds: DataFrame) -> DataFrame:
    """Hosts per feed and its latest refresh. Input rows are (feed, host, refreshed_at)."""
    return feeds.groupBy("feed").agg(
        F.countDistinct("host").alias("hosts"), F.max("refreshed_at").alias("last_refresh")
    )


# --- time ---------------------------------------------------------------------------------------
def traffic_deltas(events: DataFrame, tick: str = "1 hour", last: int = 30) -> DataFrame:
    """New phishing and new safe events per tick, the last ``last`` ticks up to the newest event; quiet ones are zero.

    Only the ticks asked for are made, however far back the oldest event lies.
    """
    phishing = F.col("prediction") == "phishing"
    counts = events.groupBy(F.window("ts", tick).alias("w")).agg(
        F.count_if(phishing).alias("phishing"), F.count_if(F.col("prediction") == "legitimate").alias("safe")
    ).select(F.col("w.start").alias("tick"), "phishing", "safe")
    step = F.expr(f"INTERVAL {tick}")
    ends = counts.filter(F.col("tick").isNotNull()).agg(F.min("tick").alias("first"), F.max("tick").alias("newest"))
    ends = ends.filter(F.col("newest").isNotNull()).withColumn("start", F.greatest("first", F.col("newest") - F.lit(last - 1) * step))
    recent = ends.select(F.explode(F.sequence("start", "newest", step)).alias("tick"))
    return recent.join(counts, "tick", "left").na.fill(0, ["phishing", "safe"])


def latest_feeds(events: DataFrame, count: int = 20) -> DataFrame:
    """The latest phishing, blocked and safe events. A blocked phishing event is in two feeds.

    The rank filter is pushed in front of the shuffle (at most ``count`` rows per feed and task are moved).
    """
    phishing = F.col("prediction") == "phishing"
    feeds = F.array_compact(F.array(
        F.when(phishing, F.lit("detections")),
        F.when(phishing & F.col("blocked"), F.lit("blocks")),
        F.when(F.col("prediction") == "legitimate", F.lit("safe")),
    ))
    newest = Window.partitionBy("feed").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return (
        events.withColumn("feed", F.explode(feeds))
        .withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= count)
    )


# --- sets ---------------------------------------------------------------------------------------
def sni_union_dns(queries: DataFrame, handshakes: DataFrame) -> DataFrame:
    """One stream of domain events from queries and server names."""
    dns = queries.select("event_id", "ts", F.lower("query_domain").alias("domain"), "dst_ip", F.lit("dns").alias("origin"))
    tls = handshakes.filter(F.col("sni").isNotNull() & (F.col("sni") != "")).select(
        "event_id", "ts", F.lower("sni").alias("domain"), "dst_ip", F.lit("sni").alias("origin")
    )
    return dns.unionByName(tls)


def dataset_union(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by column name."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def event_dedup(events: DataFrame, keys: tuple[str, ...] = ("domain", "ts"), order: str = "event_id") -> DataFrame:
    """One row per key, the one with the smallest ``order``."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("first")).select(*keys, "first.*")
