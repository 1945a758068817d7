"""Readers for detection logs, block logs, feeds and blocklist text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatspark import lexicon as L
from threatspark.functions.hosts import host_of, strip

DETECTION_SCHEMA = (
    "domain string, destination_ip string, prediction string, confidence double, risk_level string, "
    "features_used int, timestamp double, alert_severity string, action_taken string, reason string, "
    "blocked boolean, source string"
)
SYSTEM_BLOCK_SCHEMA = (
    "domain string, destination_ip string, block_type string, timestamp double, error_message string, source string"
)
BAD_LINE = "_bad_line"
#: What a CSV column may be, narrowest first; text otherwise.
CSV_TYPES = ("int", "bigint", "double", "boolean")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with unreadable lines dropped."""
    lines = (
        spark.read.schema(f"{schema}, {BAD_LINE} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_LINE)
        .json(path)
    )
    return lines.filter(F.col(BAD_LINE).isNull()).drop(BAD_LINE)


def matching_names(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the paths that match a glob, in order. No file is opened."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().getName() for status in found or [])


def detection_log_scan(spark: SparkSession, folder: str, days: int | None = None) -> DataFrame:
    """Logged events, each (domain, timestamp) once: the line that stands first in the newest file with it.

    Reads both layouts together: one ``detections_YYYYMMDD.jsonl`` per day, and ``dt=YYYY-MM-DD`` folders. All days are
    read unless ``days`` asks for the newest ones only.
    """
    flat = {name: name.removeprefix("detections_").removesuffix(".jsonl") for name in matching_names(spark, f"{folder}/detections_*.jsonl")}
    dated = {name: name.removeprefix("dt=").replace("-", "") for name in matching_names(spark, f"{folder}/dt=*")}
    if days is not None:
        newest = set(sorted({*flat.values(), *dated.values()}, reverse=True)[:days])
        flat, dated = ({n: d for n, d in found.items() if d in newest} for found in (flat, dated))
    schema = f"{DETECTION_SCHEMA}, {POSITION_SCHEMA}"
    events = spark.createDataFrame([], schema)
    if flat:
        names = "detections_*.jsonl" if days is None else f"{{{','.join(flat)}}}"
        events = events.unionByName(_placed(spark, f"{folder}/{names}"))
    if dated:
        names = "dt=*" if days is None else f"{{{','.join(dated)}}}"
        events = events.unionByName(_placed(spark, f"{folder}/{names}"))
    required = F.col("domain").isNotNull() & F.col("timestamp").isNotNull() & F.col("prediction").isNotNull()
    rest = [c for c in events.columns if c not in ("domain", "timestamp", "_at")]
    first = events.filter(required).groupBy("domain", "timestamp").agg(F.min_by(F.struct(*rest), "_at").alias("first"))
    return first.select("domain", "timestamp", "first.*").select(*[c for c in events.columns if c != "_at"])


POSITION_SCHEMA = "_at struct<age: int, path: string, block: bigint, row: bigint>"


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Readable lines with their place in the log: newest day first, then file and line."""
    day = F.concat(*[F.regexp_extract("_metadata.file_path", r"(?:detections_|dt=)(\d{4})-?(\d{2})-?(\d{2})", k) for k in (1, 2, 3)])
    lines = (
        spark.read.schema(f"{DETECTION_SCHEMA}, {BAD_LINE} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_LINE)
        .option("recursiveFileLookup", "true")
        .json(path)
    )
    place = F.struct(
        F.coalesce(-day.try_cast("int"), F.lit(0)).alias("age"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
    )
    return lines.withColumn("_at", place).filter(F.col(BAD_LINE).isNull()).drop(BAD_LINE)


def system_block_log_scan(spark: SparkSession, folder: str) -> DataFrame:
    """All recorded system blocks, flat files or day folders."""
    return read_json_lines(spark, folder, SYSTEM_BLOCK_SCHEMA)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a sortable position (file, block, row)."""
    position = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(position.alias("line_no"), F.col("value").alias("line"))


def read_json_feed(spark: SparkSession, path: str) -> DataFrame:
    """URL column of a published JSON feed (one array of objects with ``url``). A file is read by one task, object by object."""
    return spark.read.schema("url string").option("multiLine", "true").json(path)


def read_text_feed(spark: SparkSession, path: str) -> DataFrame:
    """URL column of a published text feed (one URL a line)."""
    return spark.read.text(path).select(strip(F.col("value")).alias("url"))


def feed_hosts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Distinct lower-case hosts of a URL feed; entries without a scheme are dropped."""
    return (
        urls.filter(F.col(url).contains("://"))
        .select(host_of(F.col(url)).alias("host"))
        .filter(F.col("host") != "")
        .distinct()
    )


def netloc(url: Column) -> Column:
    """Authority part of a URL, '' without one."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def feed_domains_netloc(
    urls: DataFrame, order: str = "entry", limit: int | None = None, url: str = "url", require_dot: bool = False
) -> DataFrame:
    """Distinct authorities of the feed, or of its first ``limit`` entries; bare entries give the text before ``/``."""
    first = urls if limit is None else urls.orderBy(order).limit(limit)
    name = netloc(F.col(url))
    if require_dot:
        domain = F.when(name != "", name).otherwise(F.split_part(F.col(url), F.lit("/"), F.lit(3)))
        return first.select(domain.alias("domain")).filter(F.col("domain").contains(".")).distinct()
    domain = F.lower(F.when(name != "", name).otherwise(F.split_part(F.col(url), F.lit("/"), F.lit(1))))
    return first.select(domain.alias("domain")).filter(F.col("domain") != "").distinct()


def feed_snapshot_scan(spark: SparkSession, path: str) -> DataFrame:
    """Distinct hosts of a cached snapshot: each file is one JSON array of strings.

    A file is read in splits, from comma to comma, so it may be of any size. Hosts have no commas: an entry with one, or one that
    is no string, ends the job with an error.
    """
    part = F.col("value")
    entry = F.regexp_extract(part, r'(?s)^\s*\[?\s*("(?:[^"\\]|\\.)*")\s*\]?\s*$', 1)
    host = F.get(F.from_json(F.concat(F.lit("["), entry, F.lit("]")), "array<string>"), F.lit(0))
    empty = part.rlike(r"(?s)^\s*\[?\s*(?:null)?\s*\]?\s*$")
    wrong = F.raise_error(F.concat(F.lit("no host of a snapshot: "), F.left(part, F.lit(100))))
    parts = spark.read.option("lineSep", ",").text(path)
    return parts.select(F.when(entry != "", host).when(~empty, wrong).alias("host")).filter(F.col("host").isNotNull()).distinct()


def marked(line: Column, marker: str = L.BLOCK_MARKER) -> Column:
    return line.contains(marker)


def blocklist_entries(lines: DataFrame, marker: str = L.BLOCK_MARKER) -> DataFrame:
    """(line_no, ip, domain, timestamp) of the marked lines; text after the marker is the time, else ``Unknown``."""
    parts = F.split(strip(F.col("line")), r"\s+")
    since = F.array_join(F.slice(parts, F.lit(4), F.size(parts)), " ")
    return lines.filter(marked(F.col("line"), marker) & (F.size(parts) >= 2)).select(
        "line_no",
        parts[0].alias("ip"),
        parts[1].alias("domain"),
        F.when(F.size(parts) > 3, since).otherwise("Unknown").alias("timestamp"),
    )


def blocklist_text_scan(lines: DataFrame, last: int | None = None, marker: str = L.BLOCK_MARKER) -> DataFrame:
    """The marked entries, or the last ``last`` of them by position."""
    entries = blocklist_entries(lines, marker)
    return entries if last is None else entries.orderBy(F.col("line_no").desc()).limit(last)


def training_tables_scan(tables: list[DataFrame], order: str) -> DataFrame:
    """Union of training tables by column name, keeping per domain the first row (table order, then ``order``)."""
    stacked = None
    for position, table in enumerate(tables):
        numbered = table.withColumn("_table", F.lit(position))
        stacked = numbered if stacked is None else stacked.unionByName(numbered, allowMissingColumns=True)
    columns = [c for c in stacked.columns if c not in ("_table", "domain")]
    first = F.min_by(F.struct(*columns), F.struct("_table", order)).alias("first")
    return stacked.groupBy("domain").agg(first).select("domain", "first.*")


def training_csv_scan(spark: SparkSession, folder: str, order: str) -> DataFrame:
    """Training tables from the ``*.csv`` files (or folders) of a folder, in name order, by column name.

    The files are stacked as text. A column is then of the narrowest type that all its values of all files have: a whole
    number, a number, true or false, else text; so labels ``phishing`` in one file and ``1`` in another are text. ``order`` is
    compared in its own type. A column without values is text.
    """
    names = matching_names(spark, f"{folder}/*.csv")
    if not names:
        raise ValueError(f"no CSV table in {folder}")
    read = spark.read.option("header", "true").option("inferSchema", "false")
    tables = [read.csv(f"{folder}/{name}") for name in names]
    columns = list(dict.fromkeys(c for table in tables for c in table.columns))

    def bad(column: str, kind: str) -> Column:
        return F.count_if(F.col(column).isNotNull() & strip(F.col(column)).try_cast(kind).isNull()).alias(f"{kind}_{column}")

    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table, allowMissingColumns=True)
    found = stacked.agg(*[F.count(F.col(c)).alias(f"n_{c}") for c in columns], *[bad(c, k) for c in columns for k in CSV_TYPES]).first()  # one row
    types = {c: next((k for k in CSV_TYPES if found[f"n_{c}"] and not found[f"{k}_{c}"]), "string") for c in columns}

    def typed(table: DataFrame) -> DataFrame:
        return table.select(*[F.col(c) if types[c] == "string" else strip(F.col(c)).try_cast(types[c]).alias(c) for c in table.columns])

    return training_tables_scan([typed(table) for table in tables], order)
