"""Streams over several files must give what the batch form gives."""

import pytest
from pyspark.sql import functions as F

from registry import queries
from registry.views import Views
from threatspark.operators import features
from threatspark.plans import detection
from threatspark.sources import browser, capture, logs
from threatspark.streaming import jobs


@pytest.fixture(scope="module")
def chunks(spark, sf_dir, tmp_path_factory):
    """The events in time order as several files."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    for part in range(4):  # one write after the other, so that file times follow event times
        events.filter(F.floor(F.col("event_id") / 250) == part).coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.fixture
def stream(spark, sf_dir, chunks):
    schema = spark.read.parquet(chunks).schema
    return Views(spark, sf_dir, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(chunks))


@pytest.fixture
def batch(spark, sf_dir, chunks):
    return Views(spark, sf_dir, spark.read.parquet(chunks))


def run(spark, frame, tmp_path, writer=jobs.parquet_writer):
    out = str(tmp_path / "out")
    jobs.run_available(frame, str(tmp_path / "checkpoint"), writer(out))
    return out


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_detect(spark, stream, batch, tmp_path):
    out = spark.read.parquet(run(spark, jobs.stream_detect(stream.dns_queries, stream.tls_handshakes), tmp_path)).drop("batch")
    assert same(out, detection.detect(detection.domain_events(batch.dns_queries, batch.tls_handshakes)).select(out.columns))


def test_restart_adds_nothing(spark, stream, tmp_path):
    frame = jobs.stream_detect(stream.dns_queries, stream.tls_handshakes)
    first = spark.read.parquet(run(spark, frame, tmp_path)).count()
    assert spark.read.parquet(run(spark, frame, tmp_path)).count() == first


def test_new_domains_are_reported_once_and_alerts_every_time(spark, stream, batch, tmp_path):
    decisions = jobs.stream_detect(stream.dns_queries, stream.tls_handshakes)
    out = spark.read.parquet(run(spark, jobs.stream_new_domains(decisions, "60 days"), tmp_path))
    settled = out.filter("blocked OR prediction <> 'phishing'")
    every = detection.detect(detection.domain_events(batch.dns_queries, batch.tls_handshakes))
    assert settled.count() == settled.select("domain").distinct().count()
    want = every.filter("blocked OR prediction <> 'phishing'").select("domain").distinct()
    assert same(settled.select("domain"), want)
    assert out.filter("NOT blocked AND prediction = 'phishing'").count() == every.filter("NOT blocked AND prediction = 'phishing'").count()


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_windows(spark, stream, batch, tmp_path, slide):
    out = spark.read.parquet(run(spark, jobs.stream_traffic_windows(stream.detections, slide=slide), tmp_path)).drop("batch")
    window = F.window("ts", "1 hour", slide) if slide else F.window("ts", "1 hour")
    want = batch.detections.groupBy(window.alias("w")).agg(
        F.count_if(F.col("prediction") == "phishing").alias("phishing"), F.count_if(F.col("prediction") == "legitimate").alias("safe")
    )
    closed = want.filter(F.col("w.end") <= out.agg(F.max("tick")).first()[0] + F.expr("INTERVAL 1 HOUR")).select(F.col("w.start").alias("tick"), "phishing", "safe")
    assert out.count() > 100 and same(out, closed)


def test_block_monitor_reports_repeated_exports_once(spark, sf_dir, tmp_path):
    v = Views(spark, sf_dir)
    folder = str(tmp_path / "exports")
    v.browser_downloads.coalesce(1).write.mode("append").parquet(folder)
    v.browser_downloads.coalesce(1).write.mode("append").parquet(folder)
    schema = v.browser_downloads.schema
    frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = spark.read.parquet(run(spark, jobs.stream_block_monitor(frame, "60 days"), tmp_path))
    want = browser.download_blocks(v.browser_downloads)
    assert same(out.select(want.columns), want)


def test_actions_are_routed(spark, stream, tmp_path):
    folder = str(tmp_path)
    handlers = {a: jobs.parquet_writer(f"{folder}/{a}") for a in ("block_dns", "alert", "log_only")}
    jobs.run_available(jobs.stream_detect(stream.dns_queries, stream.tls_handshakes), f"{folder}/cp", jobs.route_actions(handlers))
    for action in handlers:
        assert {r.action_taken for r in spark.read.parquet(f"{folder}/{action}").select("action_taken").distinct().collect()} <= {action}


def test_feed_is_read_again_after_its_time_to_live(spark):
    now, reads = [0.0], []

    def read():
        reads.append(now[0])
        return spark.createDataFrame([("a.com",)], "host string")

    feed = jobs.RefreshingFeed(read, ttl_seconds=60, clock=lambda: now[0])
    for t in (0, 10, 59, 60, 100, 121):
        now[0] = float(t)
        feed.current()
    assert reads == [0.0, 60.0, 121.0]


def test_streamed_log_is_read_by_day(spark, stream, batch, tmp_path):
    out = run(spark, jobs.stream_detect(stream.dns_queries, stream.tls_handshakes), tmp_path, jobs.log_writer)
    every = detection.detect(detection.domain_events(batch.dns_queries, batch.tls_handshakes))
    last = [r[0] for r in every.select(F.to_date("ts").alias("d")).distinct().orderBy(F.col("d").desc()).limit(2).collect()]
    want = every.filter(F.to_date("ts").isin(last)).select("domain", "ts").distinct().count()
    assert logs.detection_log_scan(spark, out, days=2).count() == want


def test_new_domains_exactly(spark, stream, batch, tmp_path):
    """Exact however long ago a domain was seen, over several batches, and a repeated batch changes nothing."""
    writer = jobs.parquet_writer(str(tmp_path / "out"))
    ids = []

    def twice(rows, batch_id):
        ids.append(batch_id)
        writer(rows, batch_id)
        writer(rows, batch_id)

    decisions = jobs.stream_detect(stream.dns_queries, stream.tls_handshakes)
    jobs.run_available(jobs.stream_new_domains(decisions), str(tmp_path / "checkpoint"), twice)
    assert len(ids) == 4
    out = spark.read.parquet(str(tmp_path / "out"))
    every = detection.detect(detection.domain_events(batch.dns_queries, batch.tls_handshakes))
    settled = "blocked OR prediction <> 'phishing'"
    assert same(out.filter(settled).select("domain"), every.filter(settled).select("domain").distinct())
    assert out.filter(f"NOT ({settled})").count() == every.filter(f"NOT ({settled})").count()


@pytest.fixture(scope="module")
def live_model(spark, sf_dir):
    return queries.live_model(Views(spark, sf_dir))


def test_connections_are_judged_as_in_a_batch(spark, stream, batch, live_model, tmp_path):
    """Over several micro-batches: every handshake once, when its time has passed, with the same features and verdict."""
    model, names = live_model
    frame = jobs.stream_connections(capture.dns_queries_scan(stream.dns_queries), capture.tls_handshakes_scan(stream.tls_handshakes), model, names)
    out = spark.read.parquet(run(spark, frame, tmp_path)).drop("batch")
    rows = features.live_connections(capture.dns_queries_scan(batch.dns_queries), capture.tls_handshakes_scan(batch.tls_handshakes))
    want = detection.detect_connections(rows, model, names).select(out.columns)
    newest = min(v.agg(F.max("ts")).first()[0] for v in (batch.dns_queries, batch.tls_handshakes))
    closed = F.col("ts") < F.lit(newest) - F.expr("INTERVAL 2 MINUTES")
    assert out.count() == out.select("event_id").distinct().count() > 100
    assert same(out.filter(closed), want.filter(closed))
    assert out.join(want.select("event_id"), "event_id", "left_anti").count() == 0
    assert {r.features_used for r in out.select("features_used").distinct().collect()} == {0, len(names)}


def test_sessions_do_not_depend_on_the_batches(spark, stream, sf_dir, chunks, tmp_path):
    """Late and unordered packets: in four batches as in one."""
    whole = Views(spark, sf_dir, spark.readStream.schema(spark.read.parquet(chunks).schema).parquet(chunks))
    outs = []
    for k, views in enumerate((stream, whole)):
        folder = tmp_path / str(k)
        outs.append(spark.read.parquet(run(spark, jobs.stream_flow_sessions(capture.flow_packets_scan(views.flow_packets)), folder)).drop("batch"))
    assert outs[0].count() > 100
    rounded = [queries.rounded_flows(o) for o in outs]
    assert same(rounded[0], rounded[1])


def test_totals_stay_few_and_right(spark, stream, batch, tmp_path):
    path = str(tmp_path / "out")
    writer = jobs.totals_writer(path)

    def twice(rows, batch_id):
        writer(rows, batch_id)
        writer(rows, batch_id)

    jobs.run_available(stream.detections.withColumn("blocked", F.lit(True)), str(tmp_path / "checkpoint"), twice)
    totals = jobs.read_totals(spark, path).first()
    assert (totals.total_events, totals.total_phishing) == (batch.detections.count(), batch.detections.filter("prediction = 'phishing'").count())
    assert len(logs.matching_names(spark, f"{path}/batch=*")) <= 3


@pytest.mark.parametrize("within, seconds", [("10 seconds", 10), ("1 day", 86_400)])
def test_a_handshake_meets_only_queries_of_its_time(spark, within, seconds):
    """The join has the time among its keys, and loses no query at the ends of its stretches of time."""
    start = 1_700_000_000_000_000
    step = seconds * 1_000_000 // 4
    asked = [(i, start + i * 7 * step + i % 3, "10.0.0.1", "A.com", i, "A") for i in range(60)] + [(99, None, "10.0.0.1", "a.com", 1, "A")]
    shook = [(i, start + i * step, "10.0.0.1", "192.0.2.1", 443, "a.COM", "TLS 1.3", 300) for i in range(420)] + [(999, None, "10.0.0.1", "192.0.2.1", 443, "a.com", "TLS 1.3", 300)]
    queries = spark.createDataFrame(asked, "event_id long, us long, src_ip string, query_domain string, ttl int, query_type string")
    handshakes = spark.createDataFrame(shook, "event_id long, us long, src_ip string, dst_ip string, dst_port int, sni string, tls_version string, packet_size int")
    timed = [f.withColumn("ts", F.timestamp_micros("us")).drop("us") for f in (queries, handshakes)]
    found = features.live_connections(*timed, within)
    keys = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_stretch" in keys and "_met" in keys
    got = {r.event_id: None if r.dns_imputed else r.dns_ttl_value for r in found.select("event_id", "dns_imputed", "dns_ttl_value").collect()}
    want = {}
    for event, at, *_ in shook:
        near = [(us, i) for i, us, *_ in asked if at is not None and us is not None and at - seconds * 1_000_000 <= us <= at]
        want[event] = max(near)[1] if near else None
    assert got == want and None in want.values() and len(set(want.values())) == 61
