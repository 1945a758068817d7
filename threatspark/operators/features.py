"""Per-connection features from DNS, TLS and flow tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatspark import lexicon as L
from threatspark.functions.lexical import entropy, entropy_stripped, has_any
from threatspark.operators import running
from threatspark.session import settled

# fixed values: what a missing feature group is filled with
DNS_DEFAULTS = {"ttl_value": 3600, "query_type": "A", "query_frequency": 1, "ttl_variance": 0.0}
TLS_DEFAULTS = {
    "has_sni_spoofing": False, "tls_version": "TLS 1.3", "tls_version_code": 3, "is_outdated_tls": False, "uses_standard_https_port": True, "handshake_packet_size": 516,
    "certificate_subject_length": 0,
}
FLOW_DEFAULTS = {
    "packet_size_mean": 1200.0, "packet_size_std": 400.0, "packet_size_min": 66, "packet_size_max": 1460,
    "packet_size_range": 1394, "inter_packet_timing_mean": 0.01, "inter_packet_timing_std": 0.005,
    "inter_packet_timing_min": 0.001, "inter_packet_timing_max": 0.05, "total_packets": 10, "flow_duration": 0.1,
    "packets_per_second": 100.0, "destination_port": 443, "ttl_value": 64,
}
SESSION_COLUMNS = (
    "dns_to_tls_delay", "is_first_connection_to_domain", "concurrent_connections", "connection_count_to_domain",
)
ARRIVAL = ("ts", "event_id")
PACKET_ARRIVAL = ("ts", "event_id", "seq")
FLOW_KEY = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")


# --- scalar groups ------------------------------------------------------------------------------
def domain_columns(domain: Column, lists: L.HostLists = L.HostLists()) -> dict[str, Column]:
    """Lexical DNS features of a name."""
    d = F.lower(domain)
    dots = F.length(d) - F.length(F.replace(d, F.lit("."), F.lit("")))
    return {
        "domain_length": F.length(d),
        "subdomain_count": F.greatest(dots - 1, F.lit(0)),
        "domain_entropy": entropy_stripped(d),
        "has_numbers_in_domain": d.rlike("[0-9]"),
        "has_hyphens_in_domain": d.contains("-"),
        "has_suspicious_chars": has_any(d, L.SUSPICIOUS_CHARS),
        "is_known_phishing": d.isin(*lists.known_phishing),
        "is_known_legitimate": d.isin(*lists.known_legitimate),
    }


def domain_features(df: DataFrame, domain: str, lists: L.HostLists = L.HostLists()) -> DataFrame:
    return df.withColumns(domain_columns(F.col(domain), lists))


def sni_matches(sni: Column, domain: Column) -> Column:
    """Either name contains the other, ignoring case."""
    s, d = F.lower(sni), F.lower(domain)
    return s.contains(d) | d.contains(s)


def tls_columns(domain: Column | None = None) -> dict[str, Column]:
    """TLS features of a handshake row; ``domain`` is the name it is compared with."""
    sni, version = F.col("sni"), F.coalesce(F.col("tls_version"), F.lit("Unknown"))
    present = sni.isNotNull() & (sni != "N/A")
    codes = F.create_map(*[F.lit(x) for pair in L.TLS_VERSION_CODES.items() for x in pair])
    comparable = present & (F.coalesce(domain, F.lit("")) != "") if domain is not None else F.lit(False)
    match = comparable & sni_matches(sni, domain) if domain is not None else F.lit(False)
    return {
        "sni_present": present,
        "sni_length": F.when(present, F.length(sni)).otherwise(0),
        "sni_entropy": F.when(present, entropy_stripped(sni)).otherwise(0.0),
        "sni_matches_domain": F.coalesce(match, F.lit(False)),
        "has_sni_spoofing": F.coalesce(comparable & ~match, F.lit(False)),
        "tls_version": version,
        "tls_version_code": F.coalesce(F.try_element_at(codes, version), F.lit(0)),
        "is_outdated_tls": version.contains("1.0") | version.contains("1.1"),
        "uses_standard_https_port": F.col("dst_port").isin(*L.HTTPS_PORTS),
        "handshake_packet_size": F.col("packet_size"),
        "certificate_subject_length": F.lit(0),
    }


def tls_features(handshakes: DataFrame, domain: str | None = None) -> DataFrame:
    columns = tls_columns(F.col(domain) if domain else None)
    return handshakes.select(*[F.col(c) for c in handshakes.columns if c not in columns], *[c.alias(n) for n, c in columns.items()])


# --- aggregates and windows ---------------------------------------------------------------------
def query_stats() -> list[Column]:
    """Queries and sample variance of the ttl; 0 when there was one query."""
    return [
        F.count(F.lit(1)).alias("query_frequency"),
        F.coalesce(F.var_samp("ttl"), F.lit(0.0)).alias("ttl_variance"),
    ]


def domain_query_stats(queries: DataFrame) -> DataFrame:
    """Queries and sample variance of the ttl per lower-case name; 0 when it was asked once."""
    return queries.groupBy(F.lower("query_domain").alias("domain")).agg(*query_stats())


def running_query_stats(queries: DataFrame, order: Sequence[str] = ARRIVAL, rows: int | None = None) -> DataFrame:
    """Per query: how often its name was asked so far and the ttl variance so far."""
    named = queries.withColumn("domain", F.lower("query_domain"))
    return running.running_count_variance(named, ["domain"], order, "ttl", "query_frequency", "ttl_variance", rows)


def inter_packet_gaps(
    packets: DataFrame, keys: Sequence[str] = FLOW_KEY, order: Sequence[str] = PACKET_ARRIVAL, rows: int | None = None
) -> DataFrame:
    """Seconds since the previous packet of the flow, in arrival order."""
    return running.seconds_since_previous(packets, keys, order, "gap_seconds", rows)


# lengths of the steps in which the parts of a flow are put together: ten seconds, an hour, all
PART_SECONDS = (10, 3600)


def spread(n: Column, mean: Column, squares: Column) -> Column:
    """Sample deviation of ``n`` values from their mean and sum of squares; 0 for one value."""
    return F.when(n > 1, F.sqrt(F.greatest(squares - n * mean * mean, F.lit(0.0)) / (n - 1))).otherwise(0.0)


def with_gaps(parts: DataFrame) -> DataFrame:
    """For rows of ``times`` (a set of microseconds) and ``timed`` (the packets with a time): first_us, last_us, and of the gaps
    between successive packets gap_squares (their sum), gap_low and gap_high, in microseconds, in place of the set."""
    listed = parts.withColumn("times", F.sort_array("times"))
    times, distinct = F.col("times"), F.size("times")
    steps = F.transform(
        F.when(distinct > 1, F.sequence(F.lit(1), distinct - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(times, i) - F.get(times, i - 1))
    same = F.when(F.col("timed") > distinct, F.lit(0).cast("bigint"))  # between packets at one time
    return listed.withColumn("_steps", steps).withColumns({
        "first_us": F.get(times, F.lit(0)), "last_us": F.get(times, distinct - 1), "gap_squares": _squares("_steps"),
        "gap_low": F.least(F.array_min("_steps"), same), "gap_high": F.greatest(F.array_max("_steps"), same),
    }).drop("times", "_steps")


def _squares(gaps: str) -> Column:
    return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g.cast("double") * g.cast("double"))


def flow_parts(packets: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per (flow, ten seconds): a summary that can be put together with the next one of the flow.

    Ten seconds have ten million different times at most; packets at one time have no gap between them. So the set of times,
    which is combined before the shuffle, and the number of packets tell all gaps, and a flow at one single time is one time.
    """
    us, size = running.epoch_us(F.col(order[0])), F.col("packet_size").cast("double")
    at = F.floor(us / (PART_SECONDS[0] * running.SECOND)).alias("_at")
    # the key columns may be those that are aggregated, too
    rest = [c for c in order if c not in ("dst_port", "ttl")]
    packed = packets.select(running._packed_keys(keys).alias("_flow"), at, us.alias("_us"), "packet_size", "dst_port", "ttl", *rest)
    return with_gaps(packed.groupBy("_flow", "_at").agg(
        F.count(F.lit(1)).alias("rows"), F.count("_us").alias("timed"), F.collect_set("_us").alias("times"),
        F.count("packet_size").alias("sizes"), F.sum(size).alias("size_sum"), F.sum(size * size).alias("size_squares"),
        F.min("packet_size").alias("low"), F.max("packet_size").alias("high"),
        F.max(F.struct(F.struct(*order).alias("at"), F.col("dst_port").alias("port"), F.col("ttl").alias("ttl"))).alias("last"),
    ))


def _put_together(parts: DataFrame, group: list[str], order: str) -> DataFrame:
    """The parts of each group as one. Only the gaps from one part to the next need their order, so the ends are listed."""
    ends = F.array_sort(F.collect_list(F.when(F.col("first_us").isNotNull(), F.struct(order, "first_us", "last_us"))))
    sums = [F.sum(n).alias(n) for n in ("rows", "timed", "sizes", "size_sum", "size_squares", "gap_squares")]
    put = parts.groupBy(*group).agg(
        ends.alias("_ends"), *sums, *[F.min(n).alias(n) for n in ("low", "gap_low", "first_us")],
        *[F.max(n).alias(n) for n in ("high", "gap_high", "last_us", "last")])
    several = F.when(F.size("_ends") > 1, F.sequence(F.lit(1), F.size("_ends") - 1)).otherwise(F.array().cast("array<int>"))
    between = F.transform(several, lambda i: F.get("_ends", i)["first_us"] - F.get("_ends", i - 1)["last_us"])
    return put.withColumn("_between", between).withColumns({
        "gap_squares": F.col("gap_squares") + _squares("_between"), "gap_low": F.least("gap_low", F.array_min("_between")),
        "gap_high": F.greatest("gap_high", F.array_max("_between")),
    }).drop("_ends", "_between")


def gap_columns() -> dict[str, Column]:
    """Gap statistics in seconds from timed, first_us, last_us, gap_squares, gap_low and gap_high."""
    n = F.col("timed") - 1
    mean = F.when(n > 0, (F.col("last_us") - F.col("first_us")) / n).otherwise(0.0)
    micro = F.lit(1e6)
    return {
        "inter_packet_timing_mean": mean / micro, "inter_packet_timing_std": spread(n, mean, F.col("gap_squares")) / micro,
        "inter_packet_timing_min": F.coalesce("gap_low", F.lit(0)) / micro, "inter_packet_timing_max": F.coalesce("gap_high", F.lit(0)) / micro,
        "flow_duration": (F.col("last_us") - F.col("first_us")) / micro,
    }


def flow_stats(packets: DataFrame, keys: Sequence[str] = FLOW_KEY, order: Sequence[str] = PACKET_ARRIVAL) -> DataFrame:
    """Size, timing and volume statistics per flow.

    No packet is sorted: each (flow, ten seconds) is summed up on its own and combined before the shuffle, those of an hour are
    put together, then the hours. So a flow may hold any share of the packets.
    """
    parts = flow_parts(packets, keys, order)
    hour = F.floor(F.col("_at") / (PART_SECONDS[1] // PART_SECONDS[0]))
    hours = _put_together(parts.withColumn("_hour", hour), ["_flow", "_hour"], "_at")
    flows = _put_together(hours, ["_flow"], "_hour")
    mean = F.when(F.col("sizes") > 0, F.col("size_sum") / F.col("sizes"))
    gaps = gap_columns()
    return flows.select(
        *[F.col(f"_flow.{c}").alias(c) for c in keys],
        mean.alias("packet_size_mean"),
        spread(F.col("sizes"), mean, F.col("size_squares")).alias("packet_size_std"),
        F.col("low").alias("packet_size_min"),
        F.col("high").alias("packet_size_max"),
        (F.col("high") - F.col("low")).alias("packet_size_range"),
        *[gaps[n].alias(n) for n in gaps if n != "flow_duration"],
        F.col("rows").alias("total_packets"),
        gaps["flow_duration"].alias("flow_duration"),
        F.when(gaps["flow_duration"] > 0, F.col("rows") / gaps["flow_duration"]).otherwise(0.0).alias("packets_per_second"),
        F.col("last.port").alias("destination_port"),
        F.col("last.ttl").alias("ttl_value"),
    )


def last_packet_attrs(packets: DataFrame, keys: Sequence[str] = FLOW_KEY, order: Sequence[str] = PACKET_ARRIVAL) -> DataFrame:
    """Port and ttl of the last packet of each flow."""
    last = F.max_by(F.struct("dst_port", "ttl"), F.struct(*order)).alias("last")
    return packets.groupBy(*keys).agg(last).select(
        *keys, F.col("last.dst_port").alias("destination_port"), F.col("last.ttl").alias("ttl_value")
    )


# --- lookups ------------------------------------------------------------------------------------
def dns_first_for_domain(queries: DataFrame, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """First query per lower-case name by arrival."""
    columns = [c for c in queries.columns if c != "query_domain"]
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("first")
    return queries.groupBy(F.lower("query_domain").alias("domain")).agg(first).select("domain", "first.*")


def tls_first_for_ip(handshakes: DataFrame, port: int = 443, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """First handshake per destination address on the port."""
    columns = [c for c in handshakes.columns if c != "dst_ip"]
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("first")
    return handshakes.filter(F.col("dst_port") == port).groupBy("dst_ip").agg(first).select("dst_ip", "first.*")


def flows_for_ip(packets: DataFrame, port: int = 443) -> DataFrame:
    """Flow statistics of all packets to a destination address on the port."""
    return flow_stats(packets.filter(F.col("dst_port") == port), ["dst_ip"])


def domain_ip_map(queries: DataFrame) -> DataFrame:
    """Edges between names and addresses with their queries, and degree and queries of both ends.

    An edge table rather than one array per name: a name with millions of addresses stays many small rows. All three
    aggregates read the same edge columns, so the queries are scanned and shuffled once. An edge without a name or
    address stays, without a degree on that side.
    """
    edges = queries.groupBy("query_domain", "dst_ip").agg(F.count(F.lit(1)).alias("queries"))
    per_domain = edges.groupBy("query_domain").agg(
        F.count(F.lit(1)).alias("ips_of_domain"), F.sum("queries").alias("queries_of_domain")
    )
    per_ip = edges.groupBy("dst_ip").agg(
        F.count(F.lit(1)).alias("domains_of_ip"), F.sum("queries").alias("queries_of_ip")
    )
    return edges.join(per_domain, "query_domain", "left").join(per_ip, "dst_ip", "left")


# --- session features ---------------------------------------------------------------------------
def _named(handshakes: DataFrame) -> DataFrame:
    """Handshakes with a server name, and the name as it is looked up."""
    return handshakes.filter(F.col("sni").isNotNull()).withColumn("_name", F.lower("sni"))


def dns_to_tls_delay(handshakes: DataFrame, queries: DataFrame, rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """Seconds from the client's latest earlier query for the server name to the handshake, NULL without one."""
    asked = queries.select("src_ip", F.lower("query_domain").alias("_name"), "ts")
    matched = running.latest_before(_named(handshakes), asked, ["src_ip", "_name"], "ts", "_asked", rows, at_most)
    delay = (running.epoch_us(F.col("ts")) - F.unix_micros("_asked")) / F.lit(1e6)
    return matched.withColumn("dns_to_tls_delay", delay).drop("_name", "_asked")


def connection_ordinal(handshakes: DataFrame, rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """How many connections the client has made to the server name so far, this one included."""
    named = handshakes.filter(F.col("sni").isNotNull())
    return running.row_number(named, ["src_ip", "sni"], ARRIVAL, "connection_count_to_domain", rows, at_most)


def first_connection_flag(handshakes: DataFrame, rows: int | None = None) -> DataFrame:
    """True for the client's first connection to the server name."""
    return connection_ordinal(handshakes, rows).withColumn(
        "is_first_connection_to_domain", F.col("connection_count_to_domain") == 1
    ).drop("connection_count_to_domain")


def concurrent_connections(handshakes: DataFrame, seconds: int = 60, rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """Handshakes of the same client in the last ``seconds``, this one included."""
    return running.count_in_last_seconds(handshakes, ["src_ip"], "ts", seconds, "concurrent_connections", rows, at_most)


def session_features(handshakes: DataFrame, queries: DataFrame, seconds: int = 60) -> DataFrame:
    """Handshakes with a server name and all session features."""
    counted = concurrent_connections(handshakes, seconds)
    numbered = connection_ordinal(counted)
    delayed = dns_to_tls_delay(numbered, queries)
    return delayed.withColumn("is_first_connection_to_domain", F.col("connection_count_to_domain") == 1)


def session_of(chosen: DataFrame, handshakes: DataFrame, queries: DataFrame, seconds: int = 60) -> DataFrame:
    """event_id and session features of the ``chosen`` handshakes.

    Only rows of their clients and names are looked at. They are written once, narrow, and all features read them from there;
    as their number is known then, no feature counts its rows again unless a key can be heavy.
    """
    def like(rows: DataFrame, keys: Sequence[str], of: DataFrame | None = None) -> DataFrame:
        return rows.join((chosen if of is None else of).select(*keys).distinct(), list(keys), "left_semi")

    wanted = chosen.select("event_id")
    own = settled(like(handshakes.select("event_id", "ts", "src_ip", "sni"), ("src_ip",)), "session-handshakes")
    named = chosen.select("src_ip", F.lower("sni").alias("query_domain"))
    asked = queries.select("event_id", "ts", "src_ip", F.lower("query_domain").alias("query_domain"))
    asked = settled(like(asked, ("src_ip", "query_domain"), named), "session-queries")
    seen, tried = own.count(), asked.count()  # read from the files' footers
    ordinal = connection_ordinal(like(own, ("src_ip", "sni")), at_most=seen).select("event_id", "connection_count_to_domain")
    counted = concurrent_connections(own, seconds, at_most=seen).select("event_id", "concurrent_connections")
    delayed = dns_to_tls_delay(chosen, asked, at_most=seen + tried).select("event_id", "dns_to_tls_delay")
    joined = delayed.join(ordinal.join(wanted, "event_id", "left_semi"), "event_id", "left").join(
        counted.join(wanted, "event_id", "left_semi"), "event_id", "left")
    return joined.withColumn("is_first_connection_to_domain", F.col("connection_count_to_domain") == 1)


# --- live connections -----------------------------------------------------------------------------
def _stretch(within: str) -> tuple[Column, Column]:
    """Length of a stretch of time and the time within which a query can be met, in microseconds. A stretch is six times ``within``, so
    one query in six is in two of them; days and months, which differ in length, get five days more."""
    reach = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL {within})")
    reach = reach + F.when(reach < 86_400_000_000, 0).otherwise(5 * 86_400_000_000)
    return F.greatest(6 * reach, F.lit(1)), reach


def live_connections(queries: DataFrame, handshakes: DataFrame, within: str = "10 seconds", lists: L.HostLists = L.HostLists()) -> DataFrame:
    """One feature row per handshake with a server name: lexical and TLS features, and those of the client's latest query for
    that name in the time ``within`` before it (defaults where there is none).

    The time bound makes this an interval join, so the same rows come from tables and from streams with a watermark: there the
    state holds the last ``within`` and the delay only, and a handshake without a query comes out when its time has passed.
    Both sides meet by stretches of time, too, so a handshake is not compared with all the queries of its client for that name.
    """
    named = handshakes.filter(F.col("sni").isNotNull())
    us, (span, reach) = running.epoch_us(F.col("ts")), _stretch(within)
    asked = queries.select(
        F.col("ts").alias("_asked"), F.col("src_ip").alias("_client"), F.lower("query_domain").alias("_name"),
        F.struct(us.alias("us"), F.col("event_id").alias("id"), "ttl", "query_type").alias("_query"),
        F.explode(F.sequence(F.floor(us / span), F.floor((us + reach) / span))).alias("_met"),
    )
    near = (F.col("_asked") <= F.col("ts")) & (F.col("_asked") >= F.col("ts") - F.expr(f"INTERVAL {within}"))
    same = (F.col("src_ip") == F.col("_client")) & (F.lower("sni") == F.col("_name")) & (F.col("_stretch") == F.col("_met"))
    joined = named.withColumn("_stretch", F.floor(us / span)).join(asked, same & near, "left")
    latest = joined.select(*named.columns, "_query").groupBy(*named.columns).agg(F.max("_query").alias("q"))
    rows = latest.withColumn("domain", F.lower("sni"))
    lexical, tls = domain_columns(F.col("domain"), lists), tls_columns(F.col("domain"))
    return rows.select(
        "event_id", "ts", "src_ip", "dst_ip", "domain",
        *[c.alias(f"dns_{n}") for n, c in lexical.items()],
        F.coalesce("q.ttl", F.lit(DNS_DEFAULTS["ttl_value"])).alias("dns_ttl_value"),
        F.coalesce("q.query_type", F.lit(DNS_DEFAULTS["query_type"])).alias("dns_query_type"),
        *[c.alias(f"tls_{n}") for n, c in tls.items()],
        ((running.epoch_us(F.col("ts")) - F.col("q.us")) / F.lit(1e6)).alias("session_dns_to_tls_delay"),
        F.col("q").isNull().alias("dns_imputed"),
    )


# --- wide row -----------------------------------------------------------------------------------
def connection_features(
    queries: DataFrame, handshakes: DataFrame, packets: DataFrame, lists: L.HostLists = L.HostLists(),
    requests: DataFrame | None = None,
) -> DataFrame:
    """One wide row per (name, address): DNS, TLS, flow and session features with ``*_imputed`` flags.

    The rows are the names asked for with the addresses they resolved to, or those of ``requests`` (domain,
    destination_ip, and an optional sni), whether they were seen on the wire or not. Groups without a packet get defaults.

    Every lookup is aggregated to its key before it is joined, so the joins see one row per name or address. What belongs to an
    address (its first handshake with the session features, its flow statistics) is written as one table, so whatever reads the
    result several times, such as a fit and a scoring, computes it once. Session features are those of the handshake that
    supplies the TLS features; no other handshake is numbered or counted.
    """
    asked = F.lit(None).cast("string")
    if requests is None:
        pairs = queries.select(F.lower("query_domain").alias("domain"), F.col("dst_ip").alias("destination_ip"), asked.alias("asked_sni"))
    else:
        asked = F.col("sni") if "sni" in requests.columns else asked
        pairs = requests.select(F.lower("domain").alias("domain"), "destination_ip", asked.alias("asked_sni"))
    pairs = pairs.distinct()
    dns = queries.groupBy(F.lower("query_domain").alias("domain")).agg(
        F.min_by(F.struct(F.col("ttl").alias("ttl_value"), "query_type", "ts"), F.struct(*ARRIVAL)).alias("first"),
        *query_stats(),
    )
    dns = dns.select("domain", F.struct("first.*", "query_frequency", "ttl_variance").alias("q"))

    https = F.col("dst_port") == 443
    handshake = F.struct("event_id", "ts", "sni", "tls_version", "dst_port", "packet_size", "src_ip")
    first_tls = settled(handshakes.filter(https).groupBy(F.col("dst_ip").alias("destination_ip")).agg(
        F.min_by(handshake, F.struct(*ARRIVAL)).alias("h")
    ), "first-tls")
    chosen = first_tls.filter("h.sni IS NOT NULL").select("h.event_id", "h.ts", "h.sni", "h.src_ip")
    session = session_of(chosen, handshakes, queries).withColumnRenamed("event_id", "_event")
    tls = first_tls.join(session, F.col("h.event_id") == F.col("_event"), "left").select("destination_ip", "h", *SESSION_COLUMNS)

    flows = flows_for_ip(packets)
    flows = flows.select(F.col("dst_ip").alias("destination_ip"), F.struct(*FLOW_DEFAULTS).alias("f"))
    addresses = settled(tls.join(flows, "destination_ip", "full_outer"), "addresses")

    joined = pairs.join(dns, "domain", "left").join(addresses, "destination_ip", "left")
    lexical = domain_columns(F.col("domain"), lists)
    name = F.col("domain")
    seen = joined.withColumns({"sni": F.col("h.sni"), "asked_or_domain": F.coalesce("asked_sni", "domain"), "tls_version": F.col("h.tls_version"), "dst_port": F.col("h.dst_port"),
                               "packet_size": F.col("h.packet_size")})
    measured = tls_columns(name)
    missing_tls = F.col("h").isNull()
    # without a handshake the server name asked for is taken, or the domain itself: as a whole, and with all its characters
    tls_defaults = {
        **TLS_DEFAULTS, "sni_present": True, "sni_length": F.length("asked_or_domain"), "sni_entropy": entropy(F.col("asked_or_domain")),
        "sni_matches_domain": F.coalesce(F.lower("asked_or_domain") == name, F.lit(False)),
    }
    missing_dns = F.col("q").isNull()
    dns_defaults = {
        "domain_entropy": entropy(name), "has_suspicious_chars": has_any(name, L.UNSEEN_SUSPICIOUS_CHARS),
        "is_known_phishing": F.lit(False), "is_known_legitimate": F.lit(False),
    }
    lexical = {n: F.when(missing_dns, dns_defaults[n]).otherwise(c) if n in dns_defaults else c for n, c in lexical.items()}
    dns_out = lexical | {
        n: F.coalesce(F.col(f"q.{n}"), F.lit(d)) for n, d in DNS_DEFAULTS.items()
    }
    tls_out = {
        n: F.when(missing_tls, d if isinstance(d, Column) else F.lit(d)).otherwise(measured[n])
        for n, d in tls_defaults.items()
    }
    flow_out = {n: F.coalesce(F.col(f"f.{n}"), F.lit(d)) for n, d in FLOW_DEFAULTS.items()}
    session_out = {
        "dns_query_timestamp": F.col("q.ts"),
        "tls_handshake_timestamp": F.col("h.ts"),
        "dns_to_tls_delay": F.col("dns_to_tls_delay"),
        "is_first_connection_to_domain": F.coalesce("is_first_connection_to_domain", F.lit(True)),
        "concurrent_connections": F.coalesce("concurrent_connections", F.lit(1)),
        "connection_count_to_domain": F.coalesce("connection_count_to_domain", F.lit(1)),
    }
    groups = (("dns", dns_out), ("tls", tls_out), ("flow", flow_out), ("session", session_out))
    return seen.select(
        "domain",
        "destination_ip",
        F.coalesce("asked_sni", "sni").alias("sni"),
        *[c.alias(f"{group}_{n}") for group, columns in groups for n, c in columns.items()],
        missing_dns.alias("dns_imputed"),
        missing_tls.alias("tls_imputed"),
        F.col("f").isNull().alias("flow_imputed"),
    )


def connection_indicators(connections: DataFrame) -> DataFrame:
    """Names of the cut-offs a connection row crosses, in a fixed order."""
    c = F.col
    rules = {
        "high_domain_entropy": c("dns_domain_entropy") > 4.5,
        "low_ttl": c("dns_ttl_value") < 60,
        "outdated_tls": c("tls_is_outdated_tls"),
        "sni_spoofing": c("tls_has_sni_spoofing"),
        "domain_length": (c("dns_domain_length") > 50) | (c("dns_domain_length") < 4),
        "many_subdomains": c("dns_subdomain_count") > 3,
        "frequent_queries": c("dns_query_frequency") > 5,
        "long_sni": c("tls_sni_length") > 200,
        "random_sni": c("tls_sni_entropy") > 4.5,
        "odd_https_port": ~c("tls_uses_standard_https_port"),
        "odd_handshake_size": (c("tls_handshake_packet_size") < 50) | (c("tls_handshake_packet_size") > 2000),
        "few_packets": c("flow_total_packets") < 5,
        "short_flow": c("flow_flow_duration") < 1,
        "bulk_transfer": c("flow_packets_per_second") > 100,
        "instant_handshake": c("session_dns_to_tls_delay") < 0.1,
    }
    flags = F.array_compact(F.array(*[F.when(rule, F.lit(n)) for n, rule in rules.items()]))
    return connections.withColumn("indicators", flags)


# --- vectors and normalisation ------------------------------------------------------------------
def feature_vector(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    """Ordered array of doubles: booleans become 0/1, numeric text is read, everything else and NULL is 0."""
    types = dict(df.dtypes)

    def number(column: str) -> Column:
        if column not in types:
            return F.lit(0.0)
        kind = types[column]
        if kind == "boolean":
            value = F.col(column).cast("int").cast("double")
        elif kind == "string":
            value = F.col(column).try_cast("double")
        elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            value = F.col(column).cast("double")
        else:
            value = F.lit(None).cast("double")
        return F.coalesce(value, F.lit(0.0))

    return df.withColumn(name, F.array(*[number(c) for c in features]))


def feature_minmax(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scale features to [0, 1]; a constant feature becomes 0. The limits are one scalar subquery."""
    limits = df.agg(F.struct(*[x for c in features for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])).scalar()

    def scaled(c: str) -> Column:
        lo, hi = limits.getField(f"lo_{c}"), limits.getField(f"hi_{c}")
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)

    return df.withColumns({c: scaled(c) for c in features})


def feature_zscore(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Centre features and divide by the population deviation; a constant feature becomes 0."""
    moments = df.agg(
        F.struct(*[x for c in features for x in (F.avg(c).alias(f"mu_{c}"), F.stddev_pop(c).alias(f"sd_{c}"))])
    ).scalar()

    def scaled(c: str) -> Column:
        mu, sd = moments.getField(f"mu_{c}"), moments.getField(f"sd_{c}")
        return F.when(sd > 0, (F.col(c) - mu) / sd).otherwise(0.0)

    return df.withColumns({c: scaled(c) for c in features})
