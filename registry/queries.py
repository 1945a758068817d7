"""Registered queries: every operator applied to whole derived tables. Doubles are rounded for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.views import Views
from threatspark import lexicon as L
from threatspark.functions import hosts as H
from threatspark.functions import lexical, policy
from threatspark.functions.policy import LIVE_POLICY
from threatspark.model import metrics, training
from threatspark.operators import features, matching, reports, scoring, verdicts
from threatspark.plans import detection
from threatspark.session import settled, work_folder
from threatspark.sources import browser, capture, logs, sinks
from threatspark.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """Register a query under its function name (without a leading underscore)."""
    QUERIES[build.__name__.strip("_")] = lambda spark, sf_dir: build(Views(spark, sf_dir))
    return build


def r(column: Column | str, places: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, places)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All double columns rounded."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, places) for n in doubles}) if doubles else df


FLOW_PARTS = ("packet", "duration")


def rounded_flows(df: DataFrame) -> DataFrame:
    """Flow statistics rounded with ties pushed up (a mean of microseconds often ends on a tie); standard deviations
    of long gaps keep three places. Other doubles are rounded as usual."""
    flow = {
        n: F.round(F.col(n) + 1e-9, 3 if n.endswith("_std") else 6)
        for n, t in df.dtypes if t == "double" and any(part in n for part in FLOW_PARTS)
    }
    return rounded(df.withColumns(flow))


def text(df: DataFrame) -> DataFrame:
    """Array columns as text."""
    arrays = {n: F.array_join(n, "|") for n, t in df.dtypes if t.startswith("array")}
    return df.withColumns(arrays) if arrays else df


# --- sources ------------------------------------------------------------------------------------
def queries_of(v: Views) -> DataFrame:
    return capture.dns_queries_scan(v.dns_queries)


def handshakes_of(v: Views) -> DataFrame:
    return capture.tls_handshakes_scan(v.tls_handshakes.drop("query_domain"))


def packets_of(v: Views) -> DataFrame:
    return capture.flow_packets_scan(v.flow_packets)


@query
def dns_queries_scan(v):
    return queries_of(v)


@query
def tls_handshakes_scan(v):
    return handshakes_of(v)


@query
def flow_packets_scan(v):
    return packets_of(v)


@query
def sni_inventory(v):
    return capture.sni_inventory(v.hello_payloads)


@query
def http_host_inventory(v):
    return capture.http_host_inventory(v.http_payloads)


def event_log(v: Views) -> DataFrame:
    """Decisions over the detections view in log form."""
    risk = v.detections.withColumn("risk_level", policy.risk_level(F.col("prediction"), F.col("confidence")))
    return verdicts.decide(risk).withColumn("source", F.when(F.col("event_id") % 6 == 0, F.lit("api_check")))


def written_log(v: Views) -> str:
    """The event log written twice over, as a log that repeats lines."""
    folder = work_folder(v.spark, "detections")
    events = event_log(v).drop("event_id")
    sinks.detection_log_sink(events.unionByName(events), folder)
    return folder


@query
def detection_log_scan(v):
    events = logs.detection_log_scan(v.spark, written_log(v))
    return rounded(verdicts.logged_event_override(events))


@query
def detection_log_sink(v):
    folder = work_folder(v.spark, "sink")
    sinks.detection_log_sink(event_log(v).drop("event_id"), folder)
    return rounded(logs.read_json_lines(v.spark, folder, logs.DETECTION_SCHEMA)).drop("dt")


def system_blocks(v: Views) -> DataFrame:
    return reports.with_block_type(v.block_events).select(
        "domain", F.lit(None).cast("string").alias("destination_ip"), "block_type", "ts", "error_message", "source"
    )


@query
def system_block_log_sink(v):
    folder = work_folder(v.spark, "blocks")
    sinks.system_block_log_sink(system_blocks(v), folder)
    return logs.system_block_log_scan(v.spark, folder).groupBy("block_type", "source").agg(F.count(F.lit(1)).alias("blocks"))


@query
def system_block_log_scan(v):
    folder = work_folder(v.spark, "blocks")
    sinks.system_block_log_sink(system_blocks(v), folder)
    return rounded(logs.system_block_log_scan(v.spark, folder)).drop("dt")


@query
def feed_hosts(v):
    return logs.feed_hosts(v.feed_urls)


@query
def feed_domains_netloc(v):
    lower = logs.feed_domains_netloc(v.feed_urls).withColumn("variant", F.lit("any"))
    dotted = logs.feed_domains_netloc(v.feed_urls, require_dot=True).withColumn("variant", F.lit("dotted"))
    return lower.unionByName(dotted)


@query
def feed_snapshot_scan(v):
    """Snapshots of about a thousand hosts each, written as one JSON array per file and read back."""
    folder = work_folder(v.spark, "snapshot")
    found = logs.feed_hosts(v.feed_urls)
    files = found.agg(F.ceil(F.count(F.lit(1)) / 1000)).scalar()
    numbered = found.withColumn("file", F.pmod(F.xxhash64("host"), F.greatest(files, F.lit(1))))
    arrays = numbered.groupBy("file").agg(F.to_json(F.collect_list("host")).alias("value"))
    arrays.write.partitionBy("file").text(folder)
    return logs.feed_snapshot_scan(v.spark, folder)


@query
def text_feed_scan(v):
    """A feed published as one URL a line."""
    folder = work_folder(v.spark, "text-feed")
    sinks.write_lines(v.feed_urls, folder, "url")
    return logs.feed_hosts(logs.read_text_feed(v.spark, folder))


@query
def json_feed_scan(v):
    """A feed published as JSON arrays of objects, about a thousand in each file."""
    folder = work_folder(v.spark, "json-feed")
    numbered = v.feed_urls.withColumn("file", F.floor(F.col("entry") / 1000))
    arrays = numbered.groupBy("file").agg(F.to_json(F.collect_list(F.struct("entry", "url"))).alias("value"))
    arrays.write.partitionBy("file").text(folder)
    return logs.feed_hosts(logs.read_json_feed(v.spark, folder))


@query
def hosts_file_round_trip(v):
    """The hosts file written as lines and read again."""
    folder = work_folder(v.spark, "hosts")
    sinks.write_lines(v.hosts_lines, folder)
    entries = logs.blocklist_entries(logs.read_text_lines(v.spark, folder))
    return entries.groupBy("ip", "domain", "timestamp").agg(F.count(F.lit(1)).alias("lines"))


@query
def blocklist_text_scan(v):
    return logs.blocklist_text_scan(v.hosts_lines)


@query
def hosts_file_blocks(v):
    return browser.hosts_file_blocks(v.hosts_lines)


@query
def download_blocks(v):
    return browser.download_blocks(v.browser_downloads)


@query
def navigation_blocks(v):
    return browser.navigation_blocks(v.browser_urls)


@query
def recent_domains(v):
    return browser.recent_domains(v.browser_urls)


@query
def training_tables_scan(v):
    dns = queries_of(v).select("event_id", F.col("query_domain").alias("domain"), "ttl", "query_type")
    tls = handshakes_of(v).filter("sni IS NOT NULL").select("event_id", F.col("sni").alias("domain"), "tls_version", "packet_size")
    return logs.training_tables_scan([dns, tls], "event_id")


@query
def training_csv_scan(v):
    """The same tables from a folder of CSV files."""
    folder = work_folder(v.spark, "csv")
    dns = queries_of(v).select("event_id", F.col("query_domain").alias("domain"), "ttl", "query_type")
    tls = handshakes_of(v).filter("sni IS NOT NULL").select("event_id", F.col("sni").alias("domain"), "tls_version", "packet_size")
    dns = dns.withColumn("label", F.when(F.length("domain") % 2 == 0, "phishing").otherwise("legitimate"))
    tls = tls.withColumn("label", F.length("domain") % 2)  # labels of both kinds in one folder
    for name, rows in (("a_dns.csv", dns), ("b_tls.csv", tls)):
        rows.write.option("header", "true").csv(f"{folder}/{name}")
    return logs.training_csv_scan(v.spark, folder, "event_id").withColumn("label", training.label_index(F.col("label")))


# --- sinks --------------------------------------------------------------------------------------
def blocked_events(v: Views) -> DataFrame:
    named = v.detections.withColumn("domain", F.concat(F.lit("u"), (F.col("event_id") % 50).cast("string"), F.lit("."), F.col("domain")))
    return verdicts.decide(named).filter("blocked")


@query
def blocklist_publish(v):
    return sinks.blocklist_publish(blocked_events(v), v.hosts_lines)


@query
def blocklist_remove(v):
    return sinks.blocklist_remove(v.hosts_lines, blocked_events(v))


@query
def blocklist_clear(v):
    return sinks.blocklist_clear(v.hosts_lines)


@query
def blocklist_history(v):
    return sinks.blocklist_history(v.list_actions)


@query
def address_lines(v):
    return sinks.address_lines(blocked_events(v))


@query
def labelled_dataset_sink(v):
    rows = v.domains.withColumn("label", lexical.keyword_label(F.col("domain")))
    return sinks.labelled_dataset_sink(rows, work_folder(v.spark, "dataset"))


# --- scalar expressions -------------------------------------------------------------------------
@query
def host_normalize(v):
    return v.urls.select("event_id", H.host_of(F.col("url")).alias("host"), H.url_of(F.col("url")).alias("url"))


@query
def external_host(v):
    return v.urls.select("event_id", H.external_host(F.col("url")).alias("host"))


@query
def sni_clean(v):
    return v.noisy_names.select("event_id", H.clean_sni(F.col("sni")).alias("domain"))


@query
def entropy_stripped(v):
    return v.domains.select("domain", r(lexical.entropy_stripped(F.col("domain"))).alias("entropy"))


@query
def entropy_raw(v):
    return v.domains.select("domain", r(lexical.entropy(F.col("domain"))).alias("entropy"))


@query
def entropy_label(v):
    label = lexical.entropy(lexical.first_label(F.col("domain")))
    size = F.length(lexical.first_label(F.col("domain")))
    return v.domains.select(
        "domain", r(label).alias("entropy"), lexical.high_entropy_label(F.col("domain")).alias("is_high"),
        ((size >= 8) & (r(label) >= 3.5)).alias("is_random"),
    )


@query
def domain_features(v):
    return rounded(features.domain_features(v.domains, "domain"))


@query
def tls_features(v):
    rows = capture.tls_handshakes_scan(v.tls_handshakes)
    return rounded(features.tls_features(rows, "query_domain"))


@query
def sni_domain_check(v):
    c = features.tls_columns(F.col("query_domain"))
    return v.tls_handshakes.select(
        "event_id", c["sni_matches_domain"].alias("sni_matches_domain"), c["has_sni_spoofing"].alias("has_sni_spoofing")
    )


def connections(v: Views) -> DataFrame:
    return features.connection_features(queries_of(v), handshakes_of(v), packets_of(v))


@query
def connection_features(v):
    return rounded_flows(connections(v))


@query
def connection_defaults(v):
    """Requests for names and addresses that were never seen on the wire: every group is filled in. Some ask for another
    server name than the domain."""
    requests = v.lookalikes.select(
        F.upper("domain").alias("domain"), F.concat(F.lit("203.0.113."), F.length("domain").cast("string")).alias("destination_ip"),
        F.when(F.length("domain") % 2 == 0, F.initcap("domain")).otherwise(F.concat(F.lit("cdn."), F.col("domain"))).alias("sni"),
    )
    rows = features.connection_features(queries_of(v), handshakes_of(v), packets_of(v), requests=requests)
    return rounded(rows.select(
        "domain", "destination_ip", "sni", "dns_imputed", "tls_imputed", "flow_imputed", "dns_ttl_value", "dns_query_type",
        "dns_query_frequency", "dns_ttl_variance", "tls_tls_version", "tls_tls_version_code", "tls_handshake_packet_size",
        "tls_sni_length", "tls_sni_entropy", "tls_sni_matches_domain", "tls_has_sni_spoofing", "dns_domain_entropy", "flow_packet_size_mean", "flow_total_packets", "flow_destination_port", "flow_ttl_value",
    ))


@query
def connection_indicators(v):
    return text(features.connection_indicators(connections(v)).select("domain", "destination_ip", "indicators"))


VECTOR = (
    "domain_length", "subdomain_count", "domain_entropy", "has_numbers_in_domain", "has_hyphens_in_domain", "domain",
    "no_such_feature",
)


@query
def feature_vector(v):
    rows = features.feature_vector(features.domain_features(v.domains, "domain"), VECTOR)
    return rows.select("domain", *[r(F.col("features")[i]).alias(f"f{i}") for i in range(len(VECTOR))])


SCALED = ("domain_length", "domain_entropy")


def to_scale(v: Views) -> DataFrame:
    return features.domain_features(v.domains, "domain").select("domain", *SCALED)


@query
def feature_minmax(v):
    return rounded(features.feature_minmax(to_scale(v), SCALED))


@query
def feature_zscore(v):
    return rounded(features.feature_zscore(to_scale(v), SCALED))


@query
def risk_level(v):
    return v.detections.select("event_id", policy.risk_level(F.col("prediction"), F.col("confidence")).alias("risk_level"))


@query
def alert_severity(v):
    return v.detections.select("event_id", policy.alert_severity(F.col("prediction"), F.col("confidence")).alias("alert_severity"))


@query
def decision(v):
    return verdicts.decide(v.detections, LIVE_POLICY).drop("ts")


@query
def block_type_classify(v):
    return reports.with_block_type(v.block_events).select("event_id", "error_type", "block_type")


@query
def brand_heuristic(v):
    return scoring.brand_heuristic(v.domains, "domain", "b").select("domain", "b.*")


@query
def lexical_risk_score(v):
    return text(scoring.lexical_risk(v.domains, "domain", "s").select("domain", "s.*"))


@query
def digit_swap_brands(v):
    label = lexical.first_label(F.col("domain"))
    tokens = v.domains.select("domain", lexical.mixed_token(label).alias("token"))
    return tokens.withColumn("brand", lexical.digit_swap_brand("token"))


@query
def keyword_label(v):
    return v.cased_domains.select("domain", lexical.keyword_label(F.col("domain")).alias("label"))


def verified(v: Views) -> DataFrame:
    return v.domains.select("domain", lexical.fallback_verify("domain").alias("v")).select("domain", "v.*")


@query
def fallback_verify(v):
    return v.cased_domains.select("domain", lexical.fallback_verify("domain").alias("v")).select("domain", "v.*")


@query
def verifier_json_parse(v):
    parsed = v.verifier_replies.select("event_id", lexical.parse_reply_json(F.col("reply")).alias("p"))
    return parsed.select("event_id", "p.*")


@query
def verifier_text_parse(v):
    parsed = v.verifier_replies.select("event_id", lexical.parse_reply_text(F.col("reply"), 100).alias("p"))
    return parsed.select("event_id", "p.*")


@query
def verifier_verdict(v):
    judged = v.verifier_replies.select("event_id", lexical.verify_reply("domain", F.col("reply"), 100).alias("p"))
    return judged.select("event_id", "p.*")


@query
def keyword_verdict_dns(v):
    return scoring.keyword_verdict(v.domains, "domain", F.lit(True))


@query
def keyword_verdict_tls(v):
    return scoring.keyword_verdict(v.domains, "domain", F.lit(False))


@query
def dns_anomalies(v):
    return text(queries_of(v).select("event_id", lexical.dns_anomalies(F.col("query_domain"), F.col("ttl") - 10).alias("anomalies")))


@query
def tls_anomalies(v):
    return text(handshakes_of(v).select("event_id", lexical.tls_anomalies(F.col("tls_version"), F.col("sni")).alias("anomalies")))


@query
def chrome_time(v):
    return v.browser_urls.select(
        "id", browser.chrome_time(F.col("last_visit_time")).cast("timestamp_ntz").alias("visited"),
        browser.to_chrome_time(browser.chrome_time(F.col("last_visit_time"))).alias("back"),
    )


# --- filters ------------------------------------------------------------------------------------
@query
def https_flows(v):
    return reports.https_flows(packets_of(v))


@query
def phishing_only(v):
    events = detection.predict(detection.domain_events(v.dns_queries, v.tls_handshakes))
    return reports.phishing_only(events).select("event_id", "domain", "origin", "confidence")


@query
def blocked_only(v):
    return reports.blocked_only(verdicts.decide(v.detections))


# --- joins and lookups --------------------------------------------------------------------------
@query
def list_suffix_match(v):
    return matching.list_suffix_match(v.domains, "domain")


@query
def list_table_match(v):
    """Lists as tables that grow with the names."""
    return matching.list_suffix_match(v.nested_domains, "domain", matching.ListTables(v.block_table, v.allow_table))


@query
def list_table_override(v):
    """Predictions and logged events under lists that are tables."""
    tables = matching.ListTables(v.block_table, v.allow_table)
    named = with_risk(v).drop("ts").withColumn("domain", F.concat(F.lit("M."), F.col("domain")))
    return verdicts.logged_event_override(verdicts.decide(verdicts.list_override(named, tables)), tables)


@query
def feed_parent_match(v):
    names = queries_of(v).withColumn("domain", F.concat(F.lit("a.b."), F.col("query_domain")))
    feed = logs.feed_hosts(v.feed_urls)
    return matching.feed_parent_match(names.select("event_id", "domain"), "domain", feed)


def with_risk(v: Views) -> DataFrame:
    return v.detections.withColumn("risk_level", policy.risk_level(F.col("prediction"), F.col("confidence")))


@query
def list_override(v):
    return verdicts.list_override(with_risk(v)).drop("ts")


def classified(v: Views) -> DataFrame:
    """Logged events after the list override."""
    return verdicts.logged_event_override(verdicts.decide(with_risk(v)))


@query
def logged_event_override(v):
    return classified(v).drop("ts")


@query
def new_domains_only(v):
    named = v.detections.withColumn("domain", F.concat(F.lit("n"), (F.col("event_id") % 701).cast("string"), F.lit("."), F.col("domain")))
    judged = verdicts.decide(named).filter("hour(ts) < 6")  # what the decisions of the night have settled
    return matching.new_domains_only(named, judged).select("event_id", "domain")


@query
def dns_first_for_domain(v):
    return features.dns_first_for_domain(queries_of(v))


@query
def tls_first_for_ip(v):
    return features.tls_first_for_ip(handshakes_of(v))


@query
def flows_for_ip(v):
    return rounded_flows(features.flows_for_ip(packets_of(v)))


@query
def domain_ip_map(v):
    return features.domain_ip_map(queries_of(v).withColumn("dst_ip", F.concat_ws("-", "dst_ip", (F.col("event_id") % 90).cast("string"))))


@query
def dns_to_tls_delay(v):
    return rounded(features.dns_to_tls_delay(handshakes_of(v), queries_of(v), rows=SLICE_ROWS).select("event_id", "dns_to_tls_delay"))


@query
def typosquat_match(v):
    return scoring.typosquat_match(v.domains, "domain")


@query
def typosquat_table(v):
    """Near misses of a brand table that grows with the users."""
    return scoring.typosquat_match(v.domains, "domain", v.brand_words.filter("kind = 'brand'").select(F.col("word").alias("brand")))


@query
def brand_table_heuristic(v):
    """The brand rules with brands and tokens from a table."""
    return scoring.brand_heuristic(v.domains, "domain", "b", words=v.brand_words, told_tokens=3).select("domain", "b.*")


@query
def lexical_table_score(v):
    return text(scoring.lexical_risk(v.domains, "domain", "s", words=v.brand_words).select("domain", "s.*"))


@query
def reputation_check(v):
    external = v.pages.filter("url LIKE '%.html'").select(
        F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host"), F.lit("MALWARE").alias("threat_type")
    )
    return verdicts.reputation_check(v.domains, "domain", v.feeds, external)


@query
def verdict_cascade(v):
    """Every name asked for in the event stream, plus the hosts of the pages."""
    asked = v.lookalikes.unionByName(v.pages.select(F.col("url").alias("domain"))).unionByName(
        v.dns_queries.select(F.col("query_domain").alias("domain"))
    )
    return detection.check_domains(asked, "domain", v.feeds)


@query
def verdict_cascade_scored(v):
    """The cascade with the scores of a model, so that every layer is reached."""
    asked = v.lookalikes.unionByName(v.dns_queries.select(F.col("query_domain").alias("domain")))
    return rounded(detection.check_domains(asked, "domain", v.feeds, v.model_scores))


@query
def connection_model_cascade(v):
    """Connection features to a fitted model to verdicts, in one run. What the lists, the feeds and the names decide does not
    depend on the fit, nor does the number of hosts left to the model."""
    rows = connections(v).withColumn("label", training.label_index(lexical.keyword_label(F.col("domain"))))
    matrix = settled(training.training_matrix(rows), "matrix")  # the fit and the scores read it
    names = [c for c in matrix.columns if c not in ("domain", "label")]
    model = training.train(matrix, training.random_forest(names, trees=20, depth=8))
    scored = training.score_batch(matrix, model, names).groupBy("domain").agg(
        F.max_by("prediction", F.struct("confidence", "prediction")).alias("prediction"), F.max("confidence").alias("confidence")
    )
    asked = v.lookalikes.unionByName(v.dns_queries.select(F.col("query_domain").alias("domain")))
    judged = detection.check_domains(asked, "domain", v.feeds, scored)
    settled_by = F.when(F.col("ml_ran"), "left to the model").when(F.col("source").isin("hardcoded_blocklist", "hardcoded_allowlist"), "lists").otherwise("other")
    return judged.groupBy(settled_by.alias("settled_by")).agg(F.count(F.lit(1)).alias("hosts"))


@query
def domain_decisions(v):
    """Names to list verdict to policy decision: the smallest whole run."""
    listed = matching.list_suffix_match(v.domains, "domain")
    predicted = listed.select(
        "domain",
        F.when(F.col("in_block_list"), "phishing").otherwise("legitimate").alias("prediction"),
        F.when(F.col("in_block_list") | F.col("in_allow_list"), 1.0).otherwise(0.5).alias("confidence"),
    )
    risk = predicted.withColumn("risk_level", policy.risk_level(F.col("prediction"), F.col("confidence")))
    return verdicts.decide(risk)


def agreement(v: Views) -> DataFrame:
    """The labels also name hosts that no verifier has reached."""
    labels = v.cased_domains.withColumn("feed_label", lexical.keyword_label(F.col("domain")))
    return verdicts.label_agreement(labels, verified(v))


@query
def label_agreement(v):
    return agreement(v)


# --- aggregations -------------------------------------------------------------------------------
@query
def flow_stats(v):
    return rounded_flows(features.flow_stats(packets_of(v)))


@query
def domain_query_stats(v):
    return rounded(features.domain_query_stats(queries_of(v)), 4)


@query
def prediction_stats(v):
    return rounded(reports.prediction_stats(with_risk(v)))


@query
def decision_stats(v):
    return rounded(reports.decision_stats(verdicts.decide(v.detections)))


@query
def detection_totals(v):
    return rounded(reports.detection_totals(classified(v)))


@query
def combined_block_totals(v):
    return reports.combined_block_totals(classified(v), v.block_events)


@query
def blocks_by_type(v):
    return reports.blocks_by_type(reports.with_block_type(v.block_events))


@query
def blocks_by_source_and_type(v):
    return reports.blocks_by_source_and_type(reports.with_block_type(v.block_events))


@query
def confidence_histogram(v):
    return reports.confidence_histogram(v.detections)


@query
def class_distribution(v):
    return rounded(reports.class_distribution(v.detections, "prediction"))


@query
def share_of_total(v):
    return rounded(reports.share_of_total(v.domains.withColumn("label", lexical.keyword_label(F.col("domain")))))


@query
def match_rate(v):
    return rounded(reports.match_rate(agreement(v)))


@query
def verification_accuracy(v):
    expected = v.domains.select("domain", (lexical.keyword_label(F.col("domain")) == "phishing").alias("is_phishing"))
    return rounded(reports.verification_accuracy(verified(v), expected))


@query
def packet_counters(v):
    return reports.packet_counters(queries_of(v), handshakes_of(v), packets_of(v))


@query
def capture_summary(v):
    return reports.capture_summary(queries_of(v), handshakes_of(v), capture.http_host_inventory(v.http_payloads))


@query
def run_summary(v):
    return reports.run_summary(detection.detect(detection.domain_events(v.dns_queries, v.tls_handshakes)))


@query
def feedback_accuracy(v):
    return rounded(reports.feedback_accuracy(v.detections, v.feedback))


@query
def handshakes_by_endpoint(v):
    return reports.handshakes_by_endpoint(handshakes_of(v))


@query
def feed_stats(v):
    rows = v.feed_urls.select(
        F.when(F.col("url").startswith("http"), "pages").otherwise("shouted").alias("feed"),
        H.host_of(F.col("url")).alias("host"), F.col("entry").alias("refreshed_at"),
    )
    return reports.feed_stats(rows)


# Windows below cut time into hours, so that the comparison crosses many slices; flow_stats, connection_ordinal and
# connection_features let the table decide.
#: Keys with more rows are cut, so that the small test tables have heavy keys, too.
SLICE_ROWS = 100


# --- windows ------------------------------------------------------------------------------------
@query
def inter_packet_gaps(v):
    gaps = features.inter_packet_gaps(packets_of(v), keys=("src_ip", "dst_ip"), rows=SLICE_ROWS)
    return rounded(gaps.select("event_id", "seq", "gap_seconds"))


@query
def running_query_stats(v):
    return rounded(features.running_query_stats(queries_of(v), rows=SLICE_ROWS).select("event_id", "query_frequency", "ttl_variance"), 4)


@query
def first_connection_flag(v):
    return features.first_connection_flag(handshakes_of(v), rows=SLICE_ROWS).select("event_id", "is_first_connection_to_domain")


@query
def connection_ordinal(v):
    return features.connection_ordinal(handshakes_of(v)).select("event_id", "connection_count_to_domain")


@query
def concurrent_connections(v):
    return features.concurrent_connections(handshakes_of(v).withColumn("src_ip", F.substring_index("src_ip", ".", 3)), rows=SLICE_ROWS).select(
        "event_id", "concurrent_connections"
    )


@query
def last_packet_attrs(v):
    return features.last_packet_attrs(packets_of(v), keys=("src_ip", "dst_ip"))


@query
def traffic_deltas(v):
    return reports.traffic_deltas(v.detections)


# --- top lists ----------------------------------------------------------------------------------
@query
def latest_feeds(v):
    return reports.latest_feeds(classified(v)).select("feed", "position", "event_id", "domain", "confidence", "source")


@query
def recent_events(v):
    return reports.recent_events(verdicts.decide(v.detections)).select("event_id", "domain", "action_taken")


@query
def recent_blocks(v):
    return reports.recent_blocks(reports.with_block_type(v.block_events), 20).select("event_id", "domain", "block_type")


@query
def recent_unique_block_domains(v):
    return reports.recent_unique_block_domains(reports.with_block_type(v.block_events))


@query
def top_domains(v):
    return reports.top_domains(queries_of(v))


@query
def top_sni_alphabetical(v):
    return reports.top_sni_alphabetical(handshakes_of(v))


# --- sets ---------------------------------------------------------------------------------------
@query
def dataset_union(v):
    labelled = v.domains.select("domain", lexical.keyword_label(F.col("domain")).alias("label"))
    listed = v.lookalikes.distinct().select("domain", F.lit("phishing").alias("label"), F.lit("generated").alias("origin"))
    return reports.dataset_union(labelled, listed)


@query
def brand_domain_set(v):
    return matching.brand_domains(queries_of(v), "query_domain", L.BRANDS, L.BRAND_EXTRA_DOMAINS)


@query
def sni_union_dns(v):
    return reports.sni_union_dns(queries_of(v), handshakes_of(v)).drop("ts")


@query
def event_dedup(v):
    coarse = v.detections.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return reports.event_dedup(coarse).select("domain", "ts", "event_id", "prediction")


# --- live connections -----------------------------------------------------------------------------
LIVE_DROPPED = (*training.NOT_FEATURES, "event_id", "dns_is_known_phishing", "dns_is_known_legitimate")


def live_rows(v: Views) -> DataFrame:
    return features.live_connections(queries_of(v), handshakes_of(v))


@query
def live_connections(v):
    return rounded(live_rows(v))


def live_model(v: Views) -> tuple[PipelineModel, list[str]]:
    """A stored pipeline for connection rows, fitted on the tables and read again, and its features."""
    rows = live_rows(v).withColumn("label", training.label_index(lexical.keyword_label(F.col("domain"))))
    names = training.feature_names(rows, LIVE_DROPPED)
    path = work_folder(v.spark, "live-model")
    training.train(training.training_matrix(rows.select("label", *names), drop=("label",), keep=("label",)), training.random_forest(names, trees=10, depth=5)).save(path)
    return PipelineModel.load(path), names


# --- streams: the given events as a stream, run to the end ----------------------------------------
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, whether it is one file or a folder of files."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(table.schema)
    if "/events.parquet/" in table.inputFiles()[0]:
        stream = reader.parquet(f"{sf_dir}/events.parquet")
    else:
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")


def stream_views(v: Views) -> Views:
    return Views(v.spark, v.sf_dir, event_stream(v.spark, v.sf_dir))


def closed_views(v: Views) -> Views:
    """The stream with one last event long after all others, so that the watermark passes every given row."""
    folder, stream = work_folder(v.spark, "last-event"), event_stream(v.spark, v.sf_dir)
    last = v.spark.range(1).select(F.lit(10**12 + 4).alias("event_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit(0).cast(stream.schema["user_id"].dataType).alias("user_id"))
    last.select(F.col("event_id").cast(stream.schema["event_id"].dataType), "ts", "user_id").write.parquet(folder)
    return Views(v.spark, v.sf_dir, stream.unionByName(v.spark.readStream.schema(stream.schema).parquet(folder)))


def decisions_of(v: Views) -> DataFrame:
    s = stream_views(v)
    return jobs.stream_detect(s.dns_queries, s.tls_handshakes)


def run(v: Views, frame: DataFrame, name: str, write=jobs.parquet_writer) -> str:
    folder = work_folder(v.spark, name)
    jobs.run_available(frame, f"{folder}/checkpoint", write(f"{folder}/out"))
    return f"{folder}/out"


@query
def stream_detect(v):
    out = run(v, decisions_of(v), "detect", jobs.log_writer)
    return logs.read_json_lines(v.spark, out, "event_id bigint, origin string, domain string, action_taken string, reason string").drop("batch", "dt")


@query
def stream_connections(v):
    """Every handshake judged by a stored model in the stream, next to what the same chain says of the tables."""
    model, names = live_model(v)
    s = closed_views(v)
    frame = jobs.stream_connections(capture.dns_queries_scan(s.dns_queries), capture.tls_handshakes_scan(s.tls_handshakes.drop("query_domain")), model, names)
    live = v.spark.read.parquet(run(v, frame, "connections"))
    batch = detection.detect_connections(live_rows(v), model, names).select("event_id", *[F.col(c).alias(f"_{c}") for c in ("prediction", "confidence", "action_taken")])
    same = (F.col("prediction") == F.col("_prediction")) & (F.round("confidence", 9) == F.round("_confidence", 9)) & (F.col("action_taken") == F.col("_action_taken"))
    listed = F.when(F.col("features_used") == 0, F.col("prediction"))
    return live.join(batch, "event_id", "left").select("event_id", "domain", "destination_ip", "features_used", listed.alias("listed_as"), F.coalesce(same, F.lit(False)).alias("as_in_batch"))


@query
def stream_detect_model(v):
    """Every name seen, judged by a stored model over its lexical features, and whether the tables give the same."""
    rows = training.domain_training_rows(v.domains, training.label_index(lexical.keyword_label(F.col("domain"))))
    path = work_folder(v.spark, "domain-model")
    training.train(rows, training.random_forest(training.DOMAIN_FEATURES, trees=10, depth=8)).save(path)
    model, s = PipelineModel.load(path), stream_views(v)
    live = v.spark.read.parquet(run(v, jobs.stream_detect(s.dns_queries, s.tls_handshakes, model=model), "model-detect"))
    batch = detection.detect(detection.domain_events(v.dns_queries, v.tls_handshakes), model=model)
    batch = batch.select("event_id", "origin", *[F.col(c).alias(f"_{c}") for c in ("prediction", "confidence", "action_taken")])
    same = (F.col("prediction") == F.col("_prediction")) & (F.round("confidence", 9) == F.round("_confidence", 9)) & (F.col("action_taken") == F.col("_action_taken"))
    listed = F.when(F.col("features_used") == 0, F.col("prediction"))
    return live.join(batch, ["event_id", "origin"], "left").select(
        "event_id", "origin", "domain", "destination_ip", "features_used", listed.alias("listed_as"), F.coalesce(same, F.lit(False)).alias("as_in_batch"))


@query
def stream_routed_actions(v):
    """Decisions handed to one writer for each action."""
    folder = work_folder(v.spark, "actions")
    handlers = {a: jobs.parquet_writer(f"{folder}/{a}") for a in ("block_dns", "alert", "log_only")}
    jobs.run_available(decisions_of(v), f"{folder}/checkpoint", jobs.route_actions(handlers))
    written = None
    for action in handlers:
        part = v.spark.read.parquet(f"{folder}/{action}").select("action_taken", "domain")
        written = part if written is None else written.unionByName(part)
    return written.groupBy("action_taken").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("domain").alias("domains"))


@query
def stream_verdicts(v):
    """The whole cascade on every name of the stream, with both feeds."""
    s = stream_views(v)
    names = detection.domain_events(s.dns_queries, s.tls_handshakes)
    feeds = [jobs.RefreshingFeed(lambda feed=feed: feed) for feed in v.feeds]
    out = run(v, names, "verdicts", lambda path: jobs.verdict_writer(feeds, path))
    events = logs.read_json_lines(v.spark, out, logs.DETECTION_SCHEMA)
    return rounded(events.select("domain", "prediction", "confidence", "alert_severity", "action_taken", "reason", "blocked", "source"))


@query
def stream_new_domains(v):
    out = run(v, jobs.stream_new_domains(decisions_of(v)), "new-domains")
    return v.spark.read.parquet(out).filter("blocked OR prediction <> 'phishing'").groupBy("domain").agg(
        F.count(F.lit(1)).alias("sightings")
    )


@query
def stream_traffic_windows(v):
    out = run(v, jobs.stream_traffic_windows(stream_views(v).detections), "windows")
    return v.spark.read.parquet(out).select(F.col("tick").cast("timestamp_ntz").alias("tick"), "phishing", "safe")


@query
def stream_detection_totals(v):
    folder = written_log(v)
    lines = v.spark.readStream.schema(f"{logs.DETECTION_SCHEMA}, dt string").json(folder)
    out = run(v, jobs.stream_detection_totals(lines, "60 days"), "totals", jobs.totals_writer)
    return jobs.read_totals(v.spark, out)


@query
def stream_flow_sessions(v):
    sessions = jobs.stream_flow_sessions(capture.flow_packets_scan(stream_views(v).flow_packets))
    out = v.spark.read.parquet(run(v, sessions, "sessions"))
    return rounded_flows(out.withColumn("session_start", F.col("session_start").cast("timestamp_ntz")).drop("batch"))


@query
def stream_block_monitor(v):
    out = run(v, jobs.stream_block_monitor(stream_views(v).browser_downloads, "60 days"), "blocks")
    return v.spark.read.parquet(out).select("id", "browser", "domain", "error_message")


@query
def stream_feed_refresh(v):
    feed = jobs.RefreshingFeed(lambda: logs.feed_hosts(v.feed_urls))
    names = stream_views(v).dns_queries.select("event_id", F.col("query_domain").alias("domain"))
    out = run(v, names, "feed", lambda path: jobs.feed_match_writer(feed, path))
    return v.spark.read.parquet(out).select("event_id", "domain", "in_feed")


# --- models -------------------------------------------------------------------------------------
def labelled(v: Views) -> DataFrame:
    label = training.label_index(lexical.keyword_label(F.col("domain")))
    return training.domain_training_rows(v.domains, label)


@query
def training_matrix(v):
    return rounded(training.training_matrix(labelled(v)))


@query
def label_index(v):
    mixed = F.when(F.length("domain") % 4 == 0, "0.0").when(F.length("domain") % 4 == 1, "1").otherwise(
        lexical.keyword_label(F.col("domain"))
    )
    return v.domains.select("domain", training.label_index(mixed).alias("label"))


@query
def stratified_split(v):
    return training.stratified_split(v.scored.select("doc_id", "label"), "label", "doc_id")


@query
def kfold_assign(v):
    return training.kfold_assign(v.scored.select("doc_id", "label"), "label", "doc_id")


@query
def standard_scale(v):
    rows = labelled(v).select("domain", F.col("domain_length").cast("double"), "domain_entropy")
    return rounded(training.standard_scale(rows, ("domain_length", "domain_entropy"), F.length("domain") % 5 != 0))


@query
def confusion_matrix(v):
    return metrics.confusion_matrix(v.scored)


@query
def binary_metrics(v):
    return rounded(metrics.binary_metrics(v.scored))


@query
def roc_auc(v):
    return rounded(metrics.roc_auc(v.scored))


@query
def roc_curve(v):
    return rounded(metrics.roc_curve(v.scored))


def split_rows(v: Views) -> tuple[DataFrame, DataFrame]:
    rows = settled(training.stratified_split(labelled(v), "label", "domain"), "split")  # both parts are read from it
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


def held_out_metrics(v: Views, pipeline) -> DataFrame:
    """How many rows were held out, their positives, and whether the model beats the answer of the larger class."""
    fit, test = split_rows(v)
    scored = training.phishing_score(training.train(fit, pipeline).transform(test), "label")
    return beats_majority(metrics.binary_metrics(scored))


def beats_majority(measured: DataFrame, *keep: str) -> DataFrame:
    tested, positives = F.expr("tn + fp + fn + tp"), F.expr("fn + tp")
    majority = F.greatest(positives, tested - positives) / tested
    return measured.select(*keep, tested.alias("tested"), positives.alias("positives"), (F.col("accuracy") >= majority).alias("beats_majority"))


@query
def train_random_forest(v):
    return held_out_metrics(v, training.random_forest(training.DOMAIN_FEATURES))


@query
def train_gbt(v):
    return held_out_metrics(v, training.gradient_boosting(training.DOMAIN_FEATURES))


@query
def train_mlp(v):
    return held_out_metrics(v, training.neural_network(training.DOMAIN_FEATURES))


@query
def model_ranking(v):
    """Rank three score thresholds as if they were models."""
    results = None
    for ordinal, threshold in enumerate((0.25, 0.5, 0.75)):
        row = metrics.binary_metrics(v.scored, threshold).select(
            F.lit(ordinal).alias("ordinal"), F.lit(f"cut-{threshold}").alias("model"), r("f1").alias("f1")
        )
        results = row if results is None else results.unionByName(row)
    return metrics.model_ranking(results)


@query
def cross_validate(v):
    """One row; every mean and deviation lies within its range."""
    found = training.cross_validate(labelled(v), lambda: training.random_forest(training.DOMAIN_FEATURES, trees=20))
    return found.select(*[
        (F.col(f"{n}_mean").between(0.5, 1) & F.col(f"{n}_std").between(0, 0.5)).alias(f"{n}_in_range") for n in ("accuracy", "f1", "roc_auc")
    ])


def forest(v: Views):
    fit, _ = split_rows(v)
    return training.train(fit, training.random_forest(training.DOMAIN_FEATURES))


@query
def score_batch(v):
    """Every domain: what the lists say, which does not depend on the fit, and that the model has given the rest a verdict."""
    scored = training.score_batch(labelled(v), forest(v), training.DOMAIN_FEATURES)
    listed = matching.list_suffix_match(v.domains, "domain").select("domain", "in_block_list", "in_allow_list")
    by_list = F.col("in_block_list") | F.col("in_allow_list")
    sure = F.col("confidence").between(0.5, 1) & F.col("prediction").isin("phishing", "legitimate")
    return scored.join(listed, "domain").select(
        "domain", F.when(by_list, F.col("prediction")).alias("listed_as"), sure.alias("has_verdict")
    )


@query
def feature_importance(v):
    """All features have a weight, and the weights add up to 1."""
    found = training.feature_importance(v.spark, forest(v), training.DOMAIN_FEATURES, len(training.DOMAIN_FEATURES))
    return found.agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("importance"), 6).alias("total"), (F.min("importance") >= 0).alias("all_positive"))


@query
def model_metadata_sink(v):
    fit, test = split_rows(v)
    model = training.train(fit, training.random_forest(training.DOMAIN_FEATURES))
    evaluation = metrics.binary_metrics(training.phishing_score(model.transform(test), "label"))
    folder = work_folder(v.spark, "model")
    training.model_metadata_sink(model, evaluation, training.DOMAIN_FEATURES, "RandomForest", folder, fit, test)
    return v.spark.read.json(f"{folder}/metadata").select(
        "model_type", "num_features", "num_samples", "num_train", "num_test", F.col("evaluation.accuracy").between(0, 1).alias("measured")
    )


@query
def select_model(v):
    pipelines = {
        "RandomForest": training.random_forest(training.DOMAIN_FEATURES),
        "NeuralNetwork": training.neural_network(training.DOMAIN_FEATURES),
    }
    results = training.select_model(labelled(v), training.DOMAIN_FEATURES, pipelines, work_folder(v.spark, "best"))
    return beats_majority(results, "ordinal", "model")
