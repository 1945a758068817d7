"""Structured Streaming jobs. Event time is ``ts``; every stateful job has a watermark and a checkpoint.

In jobs that de-duplicate in state, what returns after the watermark has passed is new again: ``delay`` bounds the state.
:func:`stream_new_domains` has an exact form, too.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threatspark import lexicon as L
from threatspark.functions.policy import LIVE_POLICY, DecisionPolicy
from threatspark.model.training import DOMAIN_FEATURES
from threatspark.operators.features import gap_columns, live_connections, with_gaps
from threatspark.operators.matching import ListTables, feed_parent_match
from threatspark.operators.verdicts import loggable, logged_event_override, verdict_cascade
from threatspark.plans.detection import detect, detect_connections, domain_events
from threatspark.session import remove, settled
from threatspark.sources.browser import chrome_time, download_block_rows
from threatspark.sources.logs import matching_names
from threatspark.sources.sinks import log_row

SALTS = 16


def run_available(frame: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process everything that is there and stop. ``write(batch, batch_id)`` must be repeatable for one batch id."""
    query = (
        frame.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return query


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def parquet_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own folder; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return write


def log_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Detection log by day and micro-batch; a repeated batch replaces its own folders."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = log_row(batch).withColumn("batch", F.lit(batch_id))
        days = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch")
        days.json(path)

    return write


def route_actions(handlers: dict[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """Hand the rows of each action to its handler; the batch is computed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for action, handler in handlers.items():
                handler(kept.filter(F.col("action_taken") == action), batch_id)
        finally:
            kept.unpersist()

    return write


# --- jobs: each returns the streaming frame to be written -----------------------------------------
def stream_detect(
    queries: DataFrame, handshakes: DataFrame, lists: L.HostLists = L.HostLists(), rules: DecisionPolicy = LIVE_POLICY,
    model: PipelineModel | None = None, features: Sequence[str] = DOMAIN_FEATURES,
) -> DataFrame:
    """Decisions for every name seen, straight through without state: by a stored model over the features of the name, or by
    the keyword rules without one. :func:`stream_connections` adds the features of the connection."""
    return detect(domain_events(queries, handshakes), lists, rules, model, features)


def stream_connections(
    queries: DataFrame, handshakes: DataFrame, model: PipelineModel, features: Sequence[str], within: str = "10 seconds", delay: str = "1 minute",
    lists: L.HostLists | ListTables = L.HostLists(), rules: DecisionPolicy = LIVE_POLICY,
) -> DataFrame:
    """Decisions of a stored model for every handshake, with the features of the client's query before it.

    Both sides have a watermark of ``delay``; a handshake comes out when its time has passed by it, with or without a query,
    and exactly as :func:`plans.detection.detect_connections` decides on tables. Later rows are dropped.
    """
    rows = live_connections(queries.withWatermark("ts", delay), handshakes.withWatermark("ts", delay), within)
    return detect_connections(rows, model, features, lists, rules)


def stream_new_domains(decisions: DataFrame, delay: str | None = None, salts: int = SALTS) -> DataFrame:
    """First sight of each settled domain; alerted ones pass every time they are seen.

    Streaming de-duplication has no map-side combine, so it runs twice: per (domain, salt), which spreads a domain with
    a large share of the traffic over ``salts`` tasks, then per domain on the few rows left. The domains seen are keyed state:
    a micro-batch looks up its own domains and writes what is new, whatever the number of batches before it.

    Without ``delay`` this is exact for ever, and the state grows with the distinct domains, on the executors' disks (RocksDB,
    with changes only in the checkpoint, as ``build_session`` sets it). With ``delay`` the state is bounded: a domain is new
    again when it returns after it, and rows later than it are dropped.
    """
    alerted = (F.col("prediction") == "phishing") & ~F.col("blocked")
    timed = decisions if delay is None else decisions.withWatermark("ts", delay)
    first = timed.filter(~alerted).withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(salts)))
    for keys in (["domain", "_salt"], ["domain"]):
        first = first.dropDuplicates(keys) if delay is None else first.dropDuplicatesWithinWatermark(keys)
    return first.drop("_salt").unionByName(timed.filter(alerted))


def stream_traffic_windows(
    predictions: DataFrame, tick: str = "1 hour", slide: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """Phishing and safe events per closed tick; with ``slide`` as overlapping windows for a rolling view.

    A tick is emitted once the watermark has passed it: the last ones are missing until later events arrive.
    """
    window = F.window("ts", tick, slide) if slide else F.window("ts", tick)
    phishing = F.col("prediction") == "phishing"
    return (
        predictions.withWatermark("ts", delay)
        .groupBy(window.alias("w"))
        .agg(F.count_if(phishing).alias("phishing"), F.count_if(F.col("prediction") == "legitimate").alias("safe"))
        .select(F.col("w.start").alias("tick"), "phishing", "safe")
    )


def stream_detection_totals(
    log_events: DataFrame, delay: str = "1 day", lists: L.HostLists = L.HostLists()
) -> DataFrame:
    """Log events after the list override, repeats dropped, ready to be counted by :func:`totals_writer`."""
    judged = logged_event_override(log_events, lists)
    timed = judged.withColumn("ts", F.timestamp_micros(F.round(F.col("timestamp") * 1e6).cast("bigint")))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["domain", "timestamp"])


def totals_writer(path: str) -> Callable[[DataFrame, int], None]:
    """The totals up to each micro-batch. A repeated batch starts again from the one before it; older totals go, so that
    there are never more than three."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        phishing, safe = F.col("prediction") == "phishing", F.col("prediction") == "legitimate"
        before = [i for i in _batches(spark, path) if i < batch_id]
        counts = batch.agg(
            F.count(F.lit(1)).alias("total_events"),
            F.count_if(phishing).alias("total_phishing"),
            F.count_if(phishing & F.col("blocked")).alias("total_blocked"),
            F.count_if(safe).alias("total_safe"),
        )
        if before:
            counts = counts.unionByName(spark.read.parquet(batch_folder(path, before[-1])))
        counts.agg(*[F.sum(n).alias(n) for n in counts.columns]).write.mode("overwrite").parquet(batch_folder(path, batch_id))
        for old in before[:-1]:
            remove(spark, batch_folder(path, old))

    return write


def _batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name.removeprefix("batch=")) for name in matching_names(spark, f"{path}/batch=*"))


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals after the last finished micro-batch."""
    return spark.read.parquet(batch_folder(path, _batches(spark, path)[-1]))


def stream_flow_sessions(packets: DataFrame, gap: str = "30 seconds", delay: str = "1 hour") -> DataFrame:
    """The statistics of ``operators.features.flow_stats`` per 5-tuple session, emitted when the session is closed.

    The state of an open session is a summary that takes packets in any order, late ones too: counts, moments, the last
    packet, and the set of different packet times, from which the gaps follow when the session is closed. So an open session
    holds 8 bytes for each different microsecond. Set ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` in
    the session, as ``build_session`` does: then a flow with much traffic arrives as few rows. A session is emitted once the
    watermark has passed its end.
    """
    us, size = F.unix_micros("ts"), F.col("packet_size")
    count, keys = F.count(F.lit(1)), ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    sessions = packets.withWatermark("ts", delay).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(
        count.alias("total_packets"), F.count("ts").alias("timed"), F.collect_set(us).alias("times"),
        F.avg(size).alias("packet_size_mean"), F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("packet_size_std"),
        F.min(size).alias("packet_size_min"), F.max(size).alias("packet_size_max"),
        F.max_by("ttl", F.struct("ts", "event_id", "seq")).alias("ttl_value"),
    )
    gaps = gap_columns()
    return with_gaps(sessions).withColumns(gaps).select(
        *keys, F.col("w.start").alias("session_start"), "total_packets", "packet_size_mean", "packet_size_std", "packet_size_min", "packet_size_max",
        (F.col("packet_size_max") - F.col("packet_size_min")).alias("packet_size_range"), *gaps,
        F.when(F.col("flow_duration") > 0, F.col("total_packets") / F.col("flow_duration")).otherwise(0.0).alias("packets_per_second"),
        F.col("dst_port").alias("destination_port"), "ttl_value",
    )


def stream_block_monitor(downloads: DataFrame, delay: str = "30 days") -> DataFrame:
    """Newly seen withheld downloads from exported history tables that repeat older rows."""
    rows = download_block_rows(downloads).withColumn("ts", chrome_time(F.col("start_time")))
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["browser", "id"])


class RefreshingFeed:
    """A feed dimension that is read again once its snapshot is older than ``ttl_seconds``.

    A snapshot is a table in the shared folder: micro-batches in between neither read nor de-duplicate the feed again, and
    are not disturbed when its files are replaced.
    """

    def __init__(self, read: Callable[[], DataFrame], ttl_seconds: float = 3600, clock: Callable[[], float] = time.time):
        self._read, self._ttl, self._clock = read, ttl_seconds, clock
        self._frame: DataFrame | None = None
        self._loaded = 0.0

    def current(self) -> DataFrame:
        if self._frame is None or self._clock() - self._loaded >= self._ttl:
            self._frame, self._loaded = settled(self._read(), "feed"), self._clock()
        return self._frame


def verdict_writer(
    feeds: list[RefreshingFeed], path: str, lists: L.HostLists = L.HostLists()
) -> Callable[[DataFrame, int], None]:
    """Judge the domains of each micro-batch by the whole cascade, with the feeds as they are at that moment, and log
    the settled verdicts. A domain is judged once per batch however often it occurs."""
    append = log_writer(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = batch.groupBy("domain").agg(F.max("ts").alias("ts"))
        judged = verdict_cascade(seen, "domain", [feed.current() for feed in feeds], lists=lists)
        append(loggable(judged, F.col("ts")), batch_id)

    return write


def feed_match_writer(feed: RefreshingFeed, path: str, host: str = "domain") -> Callable[[DataFrame, int], None]:
    """Flag each micro-batch against the feed as it is at that moment."""

    def write(batch: DataFrame, batch_id: int) -> None:
        feed_parent_match(batch, host, feed.current()).write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return write
