"""Scans over exported browser history tables and hosts-file lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatspark import lexicon as L
from threatspark.functions.hosts import before, external_host, strip

CHROME_EPOCH_US = 11_644_473_600_000_000  # fixed value: microseconds from 1601-01-01 to 1970-01-01
BLOCK_COLUMNS = ("domain", "source", "block_type", "error_message", "destination_ip")


def chrome_time(us: Column) -> Column:
    """Browser microseconds since 1601 as a timestamp."""
    return F.timestamp_micros(us - F.lit(CHROME_EPOCH_US))


def to_chrome_time(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) + F.lit(CHROME_EPOCH_US)


def _lookup(table: dict[int, str], code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), code)


def download_block_rows(downloads: DataFrame) -> DataFrame:
    """One row per withheld download with the reason. Warnings clicked through are not blocks."""
    state = F.coalesce(F.col("state"), F.lit(0))
    reason = F.coalesce(F.col("interrupt_reason"), F.lit(0))
    danger = F.coalesce(F.col("danger_type"), F.lit(0))
    label = F.coalesce(
        _lookup(L.INTERRUPT_REASONS, reason),
        F.when(reason != 0, F.concat(F.lit("INTERRUPT_REASON_"), reason.cast("string"))),
        _lookup(L.DANGER_TYPES, danger),
        F.when(state.isin(*L.BLOCKED_STATES), F.lit("CANCELLED_OR_INTERRUPTED")),
    )
    return (
        downloads.filter((F.col("state") != 1) | (F.col("interrupt_reason") != 0))
        .withColumns({"domain": external_host(F.col("tab_url")), "label": label})
        .filter((F.col("domain") != "") & F.col("label").isNotNull())
        .select(
            "id", "browser", "start_time", "domain",
            F.col("browser").alias("source"),
            F.lit("browser_download_block").alias("block_type"),
            F.concat(F.initcap("browser"), F.lit(" blocked download: "), F.col("label")).alias("error_message"),
            F.lit("").alias("destination_ip"),
        )
    )


def _first_of_each(rows: DataFrame, order: Column) -> DataFrame:
    """Each (browser, id) once, the row with the smallest ``order``."""
    rest = [c for c in rows.columns if c not in ("browser", "id")]
    first = rows.groupBy("browser", "id").agg(F.min_by(F.struct(*rest), order).alias("first"))
    return first.select("browser", "id", "first.*").select(*rows.columns)


def download_blocks(downloads: DataFrame) -> DataFrame:
    """Withheld downloads, each (browser, id) once, the one started first."""
    return _first_of_each(download_block_rows(downloads), F.struct("start_time", "domain", "error_message"))


def navigation_blocks(urls: DataFrame, limit: int | None = None) -> DataFrame:
    """Error-page visits whose address still names a public host, each (browser, id) once, the newest.

    ``limit`` keeps that many of the newest visits of each browser.
    """
    host = external_host(F.regexp_extract("url", r"https?://([A-Za-z0-9.\-]+)", 1))
    named = (
        urls.filter(F.col("url").startswith("chrome-error://") | F.col("url").startswith("edge-error://"))
        .select("id", "browser", host.alias("domain"), "last_visit_time")
        .filter(F.col("domain") != "")
    )
    visits = _first_of_each(named, F.struct(-F.col("last_visit_time"), F.col("domain")))
    if limit is not None:
        newest = Window.partitionBy("browser").orderBy(F.col("last_visit_time").desc(), F.col("id").desc())
        visits = visits.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= limit)
    return visits.select(
        "id", "browser", "domain",
        F.col("browser").alias("source"),
        F.lit("browser_navigation_block").alias("block_type"),
        F.concat(F.initcap("browser"), F.lit(" showed an error page for "), F.col("domain")).alias("error_message"),
        F.lit("").alias("destination_ip"),
    )


def recent_domains(urls: DataFrame, now_us: Column | None = None, hours: int = 24, limit: int | None = None) -> DataFrame:
    """Public hosts visited in the last ``hours`` with their last visit, or the ``limit`` most recent of them.

    ``now_us`` is in browser microseconds; by default the newest visit of the table is "now".
    """
    now = now_us if now_us is not None else urls.agg(F.max("last_visit_time")).scalar()
    hosts = (
        urls.filter(F.col("last_visit_time") > now - F.lit(hours * 3_600_000_000))
        .withColumn("domain", external_host(F.col("url")))
        .filter(F.col("domain") != "")
        .groupBy("domain")
        .agg(F.max("last_visit_time").alias("last_visit_time"))
    )
    return hosts if limit is None else hosts.orderBy(F.col("last_visit_time").desc(), "domain").limit(limit)


def hosts_file_blocks(lines: DataFrame, line: str = "line", line_no: str = "line_no") -> DataFrame:
    """Public hosts that hosts-file lines send to a null route, each with its first line."""
    parts = F.split(strip(before(F.col(line), "#")), r"\s+")
    first = F.min(F.struct(F.col("line_no"), F.col("position"), F.col("ip")))
    return (
        lines.withColumns({"_parts": parts})
        .filter((F.size("_parts") >= 2) & F.col("_parts")[0].isin(*L.NULL_ROUTES))
        .select(
            F.col(line_no).alias("line_no"),
            F.col("_parts")[0].alias("ip"),
            F.posexplode(F.slice("_parts", F.lit(2), F.size("_parts"))).alias("position", "host"),
        )
        .withColumn("domain", external_host(F.col("host")))
        .filter(F.col("domain") != "")
        .groupBy("domain")
        .agg(first.alias("first"))
        .select(
            "domain",
            F.lit("hosts_file").alias("source"),
            F.lit("firewall").alias("block_type"),
            F.concat(F.lit("Hosts file null-routes "), F.col("domain"), F.lit(" → "), F.col("first.ip")).alias("error_message"),
            F.col("first.ip").alias("destination_ip"),
        )
    )
