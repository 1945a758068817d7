"""Writers. Each is an ordinary Spark write; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatspark import lexicon as L
from threatspark.functions.hosts import strip
from threatspark.sources.logs import blocklist_entries, marked

UNKNOWN_IP = "0.0.0.0"


def log_row(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Detection events in log form: epoch seconds, placeholder for an unknown address, and the day."""
    return events.withColumns({
        "destination_ip": F.coalesce("destination_ip", F.lit(UNKNOWN_IP)),
        "timestamp": F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6),
        "dt": F.date_format(ts, "yyyy-MM-dd"),
    }).drop(ts)


def detection_log_sink(events: DataFrame, path: str, ts: str = "ts") -> None:
    """Append events to one folder per day."""
    log_row(events, ts).write.partitionBy("dt").mode("append").json(path)


def system_block_log_sink(blocks: DataFrame, path: str, ts: str = "ts") -> None:
    log_row(blocks, ts).write.partitionBy("dt").mode("append").json(path)


def blocklist_publish(
    blocked: DataFrame, current: DataFrame, redirect_ip: str = "127.0.0.1", marker: str = L.BLOCK_MARKER
) -> DataFrame:
    """Hosts-file lines for blocked domains that the current lines do not list yet."""
    listed = blocklist_entries(current, marker).select("domain").distinct()
    new = blocked.select("domain").distinct().join(listed, "domain", "left_anti")
    return new.select("domain", F.concat_ws(" ", F.lit(redirect_ip), F.col("domain"), F.lit(f"# {marker}")).alias("line"))


def address_lines(blocked: DataFrame, ts: str = "ts") -> DataFrame:
    """Plain text lists of blocked events: ``domain_line`` by domain, ``address_line`` by address."""
    when = F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return blocked.select(
        F.concat_ws(" ", "destination_ip", "domain", F.lit("#"), when).alias("domain_line"),
        F.concat_ws(" ", "destination_ip", F.lit("#"), "domain", when).alias("address_line"),
    )


def write_lines(lines: DataFrame, path: str, line: str = "line", mode: str = "append") -> None:
    lines.select(F.col(line).alias("value")).write.mode(mode).text(path)


def blocklist_remove(lines: DataFrame, domains: DataFrame, marker: str = L.BLOCK_MARKER) -> DataFrame:
    """The lines without the marked ones of the given domains. Write the result to a new path.

    Only marked lines take part in the join; the others have no name to join on.
    """
    named = F.split(strip(F.col("line")), r"\s+")
    listed = F.coalesce(marked(F.col("line"), marker) & (F.size(named) >= 2), F.lit(False))
    gone = domains.select(F.col("domain").alias("_domain")).distinct()
    entries = lines.filter(listed).withColumn("_domain", named[1]).join(gone, "_domain", "left_anti")
    return lines.filter(~listed).unionByName(entries.select(*lines.columns))


def blocklist_clear(lines: DataFrame, marker: str = L.BLOCK_MARKER) -> DataFrame:
    return lines.filter(~marked(F.col("line"), marker))


def blocklist_history(actions: DataFrame) -> DataFrame:
    """Current state per domain: the latest of the recorded block and unblock actions."""
    latest = F.max_by(F.struct("action", "ip", "ts"), F.struct("ts", "event_id")).alias("latest")
    return actions.groupBy("domain").agg(latest, F.count(F.lit(1)).alias("changes")).select(
        "domain", "changes", "latest.*"
    )


def labelled_dataset_sink(rows: DataFrame, path: str, label: str = "label") -> DataFrame:
    """Write the rows as JSON, as CSV with header, and their counts per label; return the counts.

    The rows are computed once: all but the JSON is made from what was written.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").json(f"{path}/json")
    written = spark.read.schema(rows.schema).json(f"{path}/json")
    written.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    counts = written.groupBy(label).agg(F.count(F.lit(1)).alias("records"))
    counts.write.mode("overwrite").json(f"{path}/summary")
    return spark.read.schema(counts.schema).json(f"{path}/summary")
