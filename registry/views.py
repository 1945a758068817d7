"""Network-shaped tables derived from the given parquet tables.

The engine reads landed captures, logs and feeds. The test data holds none, so these views shape ``events``, ``pages``,
``labels`` and ``documents`` into them; each grows with its source. ``SQL`` states the same views for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatspark import lexicon as L

DOMAINS = (
    "google.com", "github.com", "amazon.com", "mail.google.com", "wikipedia.org", "docs.docker.com",
    "telemetry.individual.githubcopilot.com", "assets.airtel.in", "paypal-verify.com", "apple-login.com",
    "login.amazon-account.com", "secure-paypal-login.com", "apple-id-verify.xyz", "verify-bank-account.net",
    "update-your-amazon-info.co", "confirm-microsoft-account.org", "paypal-verify-account.com", "facbok.com", "gogle.com",
    "amazonn.com", "paypa1.com", "g00gle-signin.top", "134tyesy.vercel.app", "suspicious-domain-xyza123.com",
)
LOOK_BRANDS = ("paypal", "apple", "icloud", "amazon", "google", "microsoft", "faceb00k", "gogle", "chase", "github")
LOOK_MIDDLES = ("-verify", "-login-", "x", ".mail", "-secure-account-", "0")
LOOK_TLDS = (".com", ".xyz", ".top", ".org")
MARKER = "PHISHING-DETECTOR-BLOCKED"
REPLIES = (
    'Sure: {"is_phishing": true, "confidence": 0.93, "reasoning": "brand in host"} end',
    '{"is_phishing": false, "confidence": 0.8}',
    '{"confidence": "0.4", "reasoning": "text number"}',
    "This host looks malicious and fake.",
    "It seems to be a legitimate site.",
    "No idea about this one.",
    'Broken: {"is_phishing": true, "confidence"} suspicious',
)


def _pick(values: tuple[str, ...], index: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"element_at(array({quoted}), cast({index} AS int) + 1)"


def _rows(values: tuple[str, ...]) -> str:
    return ", ".join(f"({i}, '" + v.replace("'", "''") + "')" for i, v in enumerate(values))


class Views:
    """Spark form of the views. ``events`` may be a stream; then every view of it is one too."""

    def __init__(self, spark: SparkSession, sf_dir: str, events: DataFrame | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self._events = events

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self._events if self._events is not None else self.table("events").select("event_id", "ts", "user_id")

    @property
    def dns_queries(self) -> DataFrame:
        return self.events.selectExpr(
            "event_id", "ts",
            "concat('10.0.', cast(user_id % 4 AS string), '.', cast(user_id % 250 AS string)) AS src_ip",
            "concat('192.0.2.', cast((event_id * 7 + user_id) % 24 AS string)) AS dst_ip",
            f"{_pick(DOMAINS, '(event_id * 7 + user_id) % 24')} AS query_domain",
            "CASE event_id % 7 WHEN 0 THEN 28 WHEN 1 THEN 5 WHEN 2 THEN 65 ELSE 1 END AS qtype",
            "CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END AS qr",
            "cast(60 * (event_id % 5) AS int) AS ttl",
            "cast(40 + event_id % 60 AS int) AS packet_size",
        )

    @property
    def tls_handshakes(self) -> DataFrame:
        """A handshake follows every query for an address."""
        return self.dns_queries.filter("qr = 0 AND qtype IN (1, 28)").selectExpr(
            "event_id", "ts + (event_id % 5) * INTERVAL '1' SECOND AS ts", "src_ip", "dst_ip",
            "cast(40000 + event_id % 20000 AS int) AS src_port",
            "CASE event_id % 11 WHEN 0 THEN 8443 WHEN 1 THEN 8080 ELSE 443 END AS dst_port",
            "CASE event_id % 13 WHEN 0 THEN cast(NULL AS string) WHEN 1 THEN 'cdn.example.net' ELSE query_domain END AS sni",
            "CASE event_id % 5 WHEN 0 THEN 'TLS 1.0' WHEN 1 THEN 'TLS 1.1' WHEN 2 THEN cast(NULL AS string) "
            "WHEN 3 THEN 'TLS 1.2' ELSE 'TLS 1.3' END AS tls_version",
            "cast(200 + event_id % 400 AS int) AS packet_size",
            "query_domain",
        )

    @property
    def flow_packets(self) -> DataFrame:
        return self.dns_queries.withColumn("seq", F.explode(F.sequence(F.lit(0), F.expr("cast(event_id % 5 AS int)")))).selectExpr(
            "event_id", "seq", "ts + seq * INTERVAL '1' SECOND AS ts", "src_ip", "dst_ip",
            "cast(40000 + event_id % 20000 AS int) AS src_port",
            "CASE event_id % 11 WHEN 0 THEN 8443 ELSE 443 END AS dst_port",
            "CASE event_id % 9 WHEN 0 THEN 'UDP' WHEN 5 THEN 'ICMP' WHEN 7 THEN 'GRE' ELSE 'TCP' END AS protocol",
            "cast(60 + (event_id * 37 + seq * 211) % 1400 AS int) AS packet_size",
            "cast(32 + event_id % 64 AS int) AS ttl",
        )

    @property
    def detections(self) -> DataFrame:
        return self.dns_queries.selectExpr(
            "event_id", "ts", "query_domain AS domain", "dst_ip AS destination_ip",
            "CASE WHEN event_id % 4 = 0 THEN 'phishing' WHEN event_id % 29 = 7 THEN 'unknown' ELSE 'legitimate' END AS prediction",
            "cast(50 + event_id % 50 AS double) / 100 AS confidence",
            "cast(CASE WHEN event_id % 10 = 0 THEN 0 ELSE 48 END AS int) AS features_used",
        )

    @property
    def block_events(self) -> DataFrame:
        return self.events.selectExpr(
            "event_id", "ts", f"{_pick(DOMAINS, 'event_id % 24')} AS domain",
            "CASE event_id % 3 WHEN 0 THEN 'chrome' WHEN 1 THEN 'hosts_file' ELSE 'network_probe' END AS source",
            f"{_pick(BLOCK_TYPES, 'event_id % 8')} AS error_type",
            f"{_pick(BLOCK_MESSAGES, 'event_id % 8')} AS error_message",
        )

    @property
    def browser_downloads(self) -> DataFrame:
        domain = _pick(DOMAINS, "event_id % 24")
        return self.events.selectExpr(
            "event_id AS id",
            "CASE event_id % 3 WHEN 0 THEN 'chrome' WHEN 1 THEN 'edge' ELSE 'brave' END AS browser",
            "CASE WHEN event_id % 17 = 0 THEN 'http://192.168.1.10:8080/f' "
            f"ELSE concat('https://', {domain}, ':8443/f/', cast(event_id AS string)) END AS tab_url",
            "cast(event_id % 5 AS int) AS state",
            "CASE event_id % 6 WHEN 1 THEN 20 WHEN 2 THEN 37 WHEN 3 THEN 99 ELSE 0 END AS interrupt_reason",
            "cast(event_id % 23 AS int) AS danger_type",
            "cast(13348540800000000 AS bigint) + event_id * 30000000 AS start_time",
        )

    @property
    def browser_urls(self) -> DataFrame:
        domain = _pick(DOMAINS, "(event_id * 5) % 24")
        return self.events.selectExpr(
            "event_id AS id",
            "CASE event_id % 3 WHEN 0 THEN 'chrome' WHEN 1 THEN 'edge' ELSE 'brave' END AS browser",
            f"CASE WHEN event_id % 19 = 0 THEN concat('chrome-error://chromewebdata/#https://', {domain}, '/') "
            f"WHEN event_id % 23 = 0 THEN 'https://user@10.1.2.3:8443/x' "
            f"ELSE concat('https://u', cast(user_id % 40 AS string), '.', {domain}, '/p') END AS url",
            "cast(13348540800000000 AS bigint) + event_id * 30000000 AS last_visit_time",
        )

    @property
    def hosts_lines(self) -> DataFrame:
        name = f"concat('u', cast(user_id AS string), '.', {_pick(DOMAINS, '(event_id * 7 + user_id) % 24')})"
        return self.events.selectExpr(
            "event_id AS line_no",
            f"CASE event_id % 6 WHEN 0 THEN concat('# comment ', {name}) "
            f"WHEN 1 THEN concat('127.0.0.1 ', {name}, ' # {MARKER} 2024-01-', lpad(cast(event_id % 28 + 1 AS string), 2, '0'), ' 10:00') "
            f"WHEN 2 THEN concat('0.0.0.0  ', {name}, ' www.', {name}) WHEN 3 THEN concat('93.184.216.34 ', {name}) "
            f"WHEN 4 THEN concat('127.0.0.1 localhost printer.lan # {MARKER}') ELSE '' END AS line",
        )

    @property
    def pages(self) -> DataFrame:
        return self.table("pages").select("page_id", "url")

    @property
    def lookalikes(self) -> DataFrame:
        return self.events.selectExpr(
            f"concat({_pick(LOOK_BRANDS, 'event_id % 10')}, {_pick(LOOK_MIDDLES, 'user_id % 6')}, "
            f"cast(user_id AS string), {_pick(LOOK_TLDS, '(event_id % 7) % 4')}) AS domain"
        )

    @property
    def domains(self) -> DataFrame:
        fixed = self.spark.createDataFrame([(d,) for d in DOMAINS], "domain string")
        hosts = self.pages.select(F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("domain"))
        return fixed.unionByName(hosts).unionByName(self.lookalikes).distinct()

    @property
    def cased_domains(self) -> DataFrame:
        """Names in mixed case, too."""
        upper = self.lookalikes.select(F.upper("domain").alias("domain"))
        mixed = self.spark.createDataFrame([(f"PayPal-{d}",) for d in DOMAINS], "domain string")
        return self.domains.unionByName(upper).unionByName(mixed).distinct()

    @property
    def feed_urls(self) -> DataFrame:
        """URLs of a published feed, numbered in feed order."""
        shout = self.events.selectExpr(
            "2 * event_id + 1 AS entry",
            f"CASE WHEN event_id % 5 = 0 THEN {_pick(DOMAINS, 'event_id % 4')} "
            f"ELSE concat('HTTPS://', upper({_pick(DOMAINS, '8 + event_id % 16')}), ':443/login?u=', cast(user_id AS string)) END AS url",
        )
        return self.pages.selectExpr("2 * page_id AS entry", "url").unionByName(shout)

    @property
    def feeds(self) -> list[DataFrame]:
        """Two host feeds: generated look-alikes, and the page hosts below example.net."""
        first = self.lookalikes.filter("domain LIKE '%-login-%' OR domain LIKE '%0.top'").selectExpr("domain AS host").distinct()
        second = self.pages.select(
            F.lower(F.regexp_extract("url", r"^[a-z]+://(?:[a-z]+\.)?([^/:?#.]+\.example\.[a-z]+)", 1)).alias("host")
        ).filter("host LIKE '%.net'").distinct()
        return [first, second]

    @property
    def hello_payloads(self) -> DataFrame:
        hexed = (
            "concat('16030100ff01', repeat('ff', 37), '0000', lpad(hex(length(query_domain) + 5), 4, '0'), "
            "lpad(hex(length(query_domain) + 3), 4, '0'), '00', lpad(hex(length(query_domain)), 4, '0'), "
            "hex(query_domain), 'ffffffff')"
        )
        return self.dns_queries.selectExpr(
            "event_id", "ts",
            f"unhex(CASE event_id % 10 WHEN 1 THEN '160301' WHEN 2 THEN concat('16030100ff02', repeat('00', 60)) ELSE {hexed} END) AS payload",
        )

    @property
    def http_payloads(self) -> DataFrame:
        return self.dns_queries.selectExpr(
            "event_id",
            "encode(CASE WHEN event_id % 4 = 0 THEN 'SSH-2.0-x' ELSE "
            "concat('GET /', cast(event_id AS string), ' HTTP/1.1\r\nHost: u', cast(event_id % 97 AS string), '.', query_domain, '\r\nAccept: */*\r\n\r\n') END, 'UTF-8') AS payload",
        )

    @property
    def verifier_replies(self) -> DataFrame:
        return self.events.selectExpr(
            "event_id", f"{_pick(DOMAINS, '(event_id * 7 + user_id) % 24')} AS domain",
            f"{_pick(REPLIES, 'event_id % 7')} AS reply",
        )

    @property
    def noisy_names(self) -> DataFrame:
        domain = _pick(DOMAINS, "(event_id * 7 + user_id) % 24")
        return self.events.selectExpr(
            "event_id",
            f"CASE event_id % 8 WHEN 0 THEN concat('h2# ', {domain}, '3iMm2bkk F6') WHEN 1 THEN concat('  ', {domain}, '  ') "
            f"WHEN 2 THEN concat('h2c#', {domain}, '::::::::') WHEN 3 THEN concat('http/1.1\n#', {domain}, 'éx') "
            f"WHEN 4 THEN concat('ab', {domain}, 'é.tail') WHEN 5 THEN concat('.-', {domain}, '.-') "
            f"WHEN 6 THEN concat('1.2.', cast(user_id AS string)) ELSE concat({domain}, '/x_y') END AS sni",
        )

    @property
    def urls(self) -> DataFrame:
        """URLs and bare hosts as people paste them."""
        domain = _pick(DOMAINS, "(event_id * 7 + user_id) % 24")
        return self.events.selectExpr(
            "event_id",
            f"CASE event_id % 9 WHEN 0 THEN concat(' HTTPS://', upper({domain}), ':8443/a/b?x=1 ') "
            f"WHEN 1 THEN concat({domain}, '/path:1') WHEN 2 THEN {domain} "
            f"WHEN 3 THEN concat('http://user:pw@', {domain}, '/x') WHEN 4 THEN concat('172.', cast(user_id % 40 AS string), '.0.1:80') "
            f"WHEN 5 THEN 'printer.local' WHEN 6 THEN concat('http://[::1]:', cast(user_id AS string), '/') "
            f"WHEN 7 THEN concat('https://', {domain}, '?q=http://a/b') ELSE concat('bad_host', cast(user_id AS string), '.com') END AS url",
        )

    @property
    def scored(self) -> DataFrame:
        """Scored rows, some without a score, a label or an id, and some at the ends of the scale."""
        return self.table("labels").selectExpr(
            "CASE WHEN doc_id % 37 = 3 THEN NULL ELSE doc_id END AS doc_id", "CASE WHEN doc_id % 43 = 7 THEN NULL ELSE quality END AS label",
            "CASE doc_id % 41 WHEN 5 THEN NULL WHEN 6 THEN 1.0D WHEN 7 THEN 0.0D "
            "ELSE cast((doc_id * 31 + quality * 20) % 97 AS double) / 97 END AS score",
        )

    @property
    def model_scores(self) -> DataFrame:
        """What a model might say of the names, with every kind of answer."""
        names = self.lookalikes.unionByName(self.dns_queries.selectExpr("query_domain AS domain")).distinct()
        return names.selectExpr(
            "domain", "CASE WHEN length(domain) % 2 = 0 THEN 'phishing' ELSE 'legitimate' END AS prediction",
            "cast(50 + ascii(substring(domain, -6, 1)) % 50 AS double) / 100 AS confidence",
        ).filter("length(domain) % 5 <> 0")

    @property
    def feedback(self) -> DataFrame:
        """Ratings, half of them for events that were never seen."""
        return self.events.selectExpr("2 * event_id AS event_id", "event_id % 3 <> 0 AS was_correct")

    @property
    def brand_words(self) -> DataFrame:
        """Brands and tokens as a table: the curated ones, brands that grow with the users, and first labels of the pages."""
        fixed = [(w, "brand") for w in (*L.BRANDS, "mcdonald's", "o'reilly")] + [(w, "token") for w in L.BRAND_TOKENS]
        grown = self.events.selectExpr(f"concat({_pick(LOOK_BRANDS, 'event_id % 10')}, cast(user_id AS string)) AS word", "'brand' AS kind")
        labels = self.pages.select(F.regexp_extract("url", "^[a-z]+://([^/:?#.]+)", 1).alias("word"), F.lit("token").alias("kind"))
        return self.spark.createDataFrame(fixed, "word string, kind string").unionByName(grown).unionByName(labels).distinct()

    @property
    def block_table(self) -> DataFrame:
        fixed = self.spark.createDataFrame([(w,) for w in L.BLOCK_LIST], "host string")
        return fixed.unionByName(self.lookalikes.filter("domain LIKE '%-verify%' OR domain LIKE 'apple.mail%'").selectExpr("domain AS host"))

    @property
    def allow_table(self) -> DataFrame:
        fixed = self.spark.createDataFrame([(w,) for w in L.ALLOW_LIST], "host string")
        return fixed.unionByName(self.pages.select(F.upper(F.regexp_extract("url", r"([^/:?#.]+\.example\.[a-z]+)", 1)).alias("host")))

    @property
    def nested_domains(self) -> DataFrame:
        """Names in mixed case, the same below two more labels, and a blank one."""
        below = self.domains.select(F.concat(F.lit("a.B."), F.col("domain")).alias("domain"))
        return self.cased_domains.unionByName(below).unionByName(self.spark.createDataFrame([("",)], "domain string")).distinct()

    @property
    def list_actions(self) -> DataFrame:
        name = f"concat('u', cast(user_id AS string), '.', {_pick(DOMAINS, 'event_id % 24')})"
        return self.events.selectExpr(
            "event_id", "ts", f"{name} AS domain", "'127.0.0.1' AS ip",
            "CASE WHEN event_id % 3 = 0 THEN 'unblocked' ELSE 'blocked' END AS action",
        )


BLOCK_TYPES = (
    "firewall", "ssl_error", "connection_timeout", "dns_failure", "connection_reset", "browser_download_block", "firewall",
    "antivirus",
)
BLOCK_MESSAGES = (
    "Connection refused", "Certificate verification failed", "Timed out after 30s", "Could not resolve host",
    "Connection reset by peer", "Chrome blocked download: FILE_BLOCKED", "Hosts file null-routes host", "File quarantined",
)

# --- the same views for the oracle ----------------------------------------------------------------
SQL: dict[str, str] = {
    "domain_dim": f"SELECT * FROM (VALUES {_rows(DOMAINS)}) AS t(i, domain)",
    "dns_queries": """
SELECT e.event_id, e.ts, concat('10.0.', cast(e.user_id % 4 AS string), '.', cast(e.user_id % 250 AS string)) AS src_ip,
 concat('192.0.2.', cast(d.i AS string)) AS dst_ip, d.domain AS query_domain,
 CASE e.event_id % 7 WHEN 0 THEN 28 WHEN 1 THEN 5 WHEN 2 THEN 65 ELSE 1 END AS qtype,
 CASE WHEN e.event_id % 31 = 0 THEN 1 ELSE 0 END AS qr,
 cast(60 * (e.event_id % 5) AS int) AS ttl, cast(40 + e.event_id % 60 AS int) AS packet_size
FROM events e JOIN domain_dim d ON d.i = (e.event_id * 7 + e.user_id) % 24""",
    "tls_handshakes": """
SELECT event_id, ts + (event_id % 5) * INTERVAL '1' SECOND AS ts, src_ip, dst_ip, cast(40000 + event_id % 20000 AS int) AS src_port,
 CASE event_id % 11 WHEN 0 THEN 8443 WHEN 1 THEN 8080 ELSE 443 END AS dst_port,
 CASE event_id % 13 WHEN 0 THEN cast(NULL AS string) WHEN 1 THEN 'cdn.example.net' ELSE query_domain END AS sni,
 CASE event_id % 5 WHEN 0 THEN 'TLS 1.0' WHEN 1 THEN 'TLS 1.1' WHEN 2 THEN cast(NULL AS string) WHEN 3 THEN 'TLS 1.2' ELSE 'TLS 1.3' END AS tls_version,
 cast(200 + event_id % 400 AS int) AS packet_size, query_domain
FROM dns_queries WHERE qr = 0 AND qtype IN (1, 28)""",
    "flow_packets": """
SELECT q.event_id, k.seq, q.ts + k.seq * INTERVAL '1' SECOND AS ts, q.src_ip, q.dst_ip, cast(40000 + q.event_id % 20000 AS int) AS src_port,
 CASE q.event_id % 11 WHEN 0 THEN 8443 ELSE 443 END AS dst_port,
 CASE q.event_id % 9 WHEN 0 THEN 'UDP' WHEN 5 THEN 'ICMP' WHEN 7 THEN 'GRE' ELSE 'TCP' END AS protocol,
 cast(60 + (q.event_id * 37 + k.seq * 211) % 1400 AS int) AS packet_size, cast(32 + q.event_id % 64 AS int) AS ttl
FROM dns_queries q JOIN (VALUES (0),(1),(2),(3),(4)) AS k(seq) ON k.seq <= q.event_id % 5""",
    "detections": """
SELECT event_id, ts, query_domain AS domain, dst_ip AS destination_ip,
 CASE WHEN event_id % 4 = 0 THEN 'phishing' WHEN event_id % 29 = 7 THEN 'unknown' ELSE 'legitimate' END AS prediction,
 cast(50 + event_id % 50 AS double) / 100 AS confidence, cast(CASE WHEN event_id % 10 = 0 THEN 0 ELSE 48 END AS int) AS features_used
FROM dns_queries""",
    "block_events": f"""
SELECT e.event_id, e.ts, d.domain, CASE e.event_id % 3 WHEN 0 THEN 'chrome' WHEN 1 THEN 'hosts_file' ELSE 'network_probe' END AS source,
 t.v AS error_type, m.v AS error_message
FROM events e JOIN domain_dim d ON d.i = e.event_id % 24
JOIN (VALUES {_rows(BLOCK_TYPES)}) AS t(i, v) ON t.i = e.event_id % 8 JOIN (VALUES {_rows(BLOCK_MESSAGES)}) AS m(i, v) ON m.i = e.event_id % 8""",
    "browser_downloads": """
SELECT e.event_id AS id, CASE e.event_id % 3 WHEN 0 THEN 'chrome' WHEN 1 THEN 'edge' ELSE 'brave' END AS browser,
 CASE WHEN e.event_id % 17 = 0 THEN 'http://192.168.1.10:8080/f' ELSE concat('https://', d.domain, ':8443/f/', cast(e.event_id AS string)) END AS tab_url,
 cast(e.event_id % 5 AS int) AS state, CASE e.event_id % 6 WHEN 1 THEN 20 WHEN 2 THEN 37 WHEN 3 THEN 99 ELSE 0 END AS interrupt_reason,
 cast(e.event_id % 23 AS int) AS danger_type, cast(13348540800000000 AS bigint) + e.event_id * 30000000 AS start_time
FROM events e JOIN domain_dim d ON d.i = e.event_id % 24""",
    "browser_urls": """
SELECT e.event_id AS id, CASE e.event_id % 3 WHEN 0 THEN 'chrome' WHEN 1 THEN 'edge' ELSE 'brave' END AS browser,
 CASE WHEN e.event_id % 19 = 0 THEN concat('chrome-error://chromewebdata/#https://', d.domain, '/')
  WHEN e.event_id % 23 = 0 THEN 'https://user@10.1.2.3:8443/x'
  ELSE concat('https://u', cast(e.user_id % 40 AS string), '.', d.domain, '/p') END AS url,
 cast(13348540800000000 AS bigint) + e.event_id * 30000000 AS last_visit_time
FROM events e JOIN domain_dim d ON d.i = (e.event_id * 5) % 24""",
    "hosts_lines": f"""
SELECT event_id AS line_no, CASE event_id % 6 WHEN 0 THEN concat('# comment ', name)
 WHEN 1 THEN concat('127.0.0.1 ', name, ' # {MARKER} 2024-01-', lpad(cast(event_id % 28 + 1 AS string), 2, '0'), ' 10:00')
 WHEN 2 THEN concat('0.0.0.0  ', name, ' www.', name) WHEN 3 THEN concat('93.184.216.34 ', name)
 WHEN 4 THEN '127.0.0.1 localhost printer.lan # {MARKER}' ELSE '' END AS line
FROM (SELECT e.event_id, concat('u', cast(e.user_id AS string), '.', d.domain) AS name
 FROM events e JOIN domain_dim d ON d.i = (e.event_id * 7 + e.user_id) % 24) n""",
    "lookalikes": f"""
SELECT concat(b.v, m.v, cast(e.user_id AS string), t.v) AS domain FROM events e
JOIN (VALUES {_rows(LOOK_BRANDS)}) AS b(i, v) ON b.i = e.event_id % 10
JOIN (VALUES {_rows(LOOK_MIDDLES)}) AS m(i, v) ON m.i = e.user_id % 6
JOIN (VALUES {_rows(LOOK_TLDS)}) AS t(i, v) ON t.i = (e.event_id % 7) % 4""",
    "domains": """
SELECT domain FROM domain_dim UNION SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) FROM pages
UNION SELECT domain FROM lookalikes""",
    "feed_urls": """
SELECT 2 * page_id AS entry, url FROM pages
UNION ALL SELECT 2 * e.event_id + 1, CASE WHEN e.event_id % 5 = 0 THEN a.domain
 ELSE concat('HTTPS://', upper(b.domain), ':443/login?u=', cast(e.user_id AS string)) END
FROM events e JOIN domain_dim a ON a.i = e.event_id % 4 JOIN domain_dim b ON b.i = 8 + e.event_id % 16""",
    "feed_one": "SELECT DISTINCT domain AS host FROM lookalikes WHERE domain LIKE '%-login-%' OR domain LIKE '%0.top'",
    "feed_two": r"""
SELECT DISTINCT host FROM (SELECT lower(regexp_extract(url, '^[a-z]+://(?:[a-z]+\.)?([^/:?#.]+\.example\.[a-z]+)', 1)) AS host
 FROM pages) h WHERE host LIKE '%.net'""",
    "hello_payloads": """
SELECT event_id, ts, query_domain, CASE event_id % 10 WHEN 1 THEN '160301' WHEN 2 THEN concat('16030100ff02', repeat('00', 60))
 ELSE concat('16030100ff01', repeat('ff', 37), '0000', lpad(hex(length(query_domain) + 5), 4, '0'), lpad(hex(length(query_domain) + 3), 4, '0'),
 '00', lpad(hex(length(query_domain)), 4, '0'), hex(query_domain), 'ffffffff') END AS payload_hex
FROM dns_queries""",
    "http_payloads": """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'SSH-2.0-x' ELSE concat('GET /', cast(event_id AS string), ' HTTP/1.1', chr(13), chr(10),
 'Host: u', cast(event_id % 97 AS string), '.', query_domain, chr(13), chr(10), 'Accept: */*', chr(13), chr(10), chr(13), chr(10)) END AS payload
FROM dns_queries""",
    "verifier_replies": f"""
SELECT e.event_id, d.domain, r.v AS reply FROM events e JOIN domain_dim d ON d.i = (e.event_id * 7 + e.user_id) % 24
JOIN (VALUES {_rows(REPLIES)}) AS r(i, v) ON r.i = e.event_id % 7""",
    "noisy_names": """
SELECT e.event_id, CASE e.event_id % 8 WHEN 0 THEN concat('h2# ', d.domain, '3iMm2bkk F6') WHEN 1 THEN concat('  ', d.domain, '  ')
 WHEN 2 THEN concat('h2c#', d.domain, '::::::::') WHEN 3 THEN concat('http/1.1', chr(10), '#', d.domain, chr(233), 'x')
 WHEN 4 THEN concat('ab', d.domain, chr(233), '.tail') WHEN 5 THEN concat('.-', d.domain, '.-')
 WHEN 6 THEN concat('1.2.', cast(e.user_id AS string)) ELSE concat(d.domain, '/x_y') END AS sni
FROM events e JOIN domain_dim d ON d.i = (e.event_id * 7 + e.user_id) % 24""",
    "urls": """
SELECT e.event_id, CASE e.event_id % 9 WHEN 0 THEN concat(' HTTPS://', upper(d.domain), ':8443/a/b?x=1 ')
 WHEN 1 THEN concat(d.domain, '/path:1') WHEN 2 THEN d.domain WHEN 3 THEN concat('http://user:pw@', d.domain, '/x')
 WHEN 4 THEN concat('172.', cast(e.user_id % 40 AS string), '.0.1:80') WHEN 5 THEN 'printer.local'
 WHEN 6 THEN concat('http://[::1]:', cast(e.user_id AS string), '/') WHEN 7 THEN concat('https://', d.domain, '?q=http://a/b')
 ELSE concat('bad_host', cast(e.user_id AS string), '.com') END AS url
FROM events e JOIN domain_dim d ON d.i = (e.event_id * 7 + e.user_id) % 24""",
    "scored": """
SELECT CASE WHEN doc_id % 37 = 3 THEN NULL ELSE doc_id END AS doc_id, CASE WHEN doc_id % 43 = 7 THEN NULL ELSE quality END AS label,
 CASE doc_id % 41 WHEN 5 THEN NULL WHEN 6 THEN 1.0 WHEN 7 THEN 0.0 ELSE cast((doc_id * 31 + quality * 20) % 97 AS double) / 97 END::DOUBLE AS score FROM labels""",
    "cased_domains": "SELECT domain FROM domains UNION SELECT upper(domain) FROM lookalikes UNION SELECT 'PayPal-' || domain FROM domain_dim",
    "model_scores": """
SELECT domain, CASE WHEN length(domain) % 2 = 0 THEN 'phishing' ELSE 'legitimate' END AS prediction,
 cast(50 + ascii(substring(domain, -6, 1)) % 50 AS double) / 100 AS confidence
FROM (SELECT domain FROM lookalikes UNION SELECT query_domain FROM dns_queries) n WHERE length(domain) % 5 <> 0""",
    "feedback": "SELECT 2 * event_id AS event_id, event_id % 3 <> 0 AS was_correct FROM events",
    "brand_words": f"""
SELECT * FROM (VALUES {", ".join("('" + w.replace("'", "''") + "', '" + k + "')" for k, ws in (("brand", (*L.BRANDS, "mcdonald's", "o'reilly")), ("token", L.BRAND_TOKENS)) for w in ws)}) AS t(word, kind)
UNION SELECT concat(b.v, cast(e.user_id AS string)), 'brand' FROM events e JOIN (VALUES {_rows(LOOK_BRANDS)}) AS b(i, v) ON b.i = e.event_id % 10
UNION SELECT regexp_extract(url, '^[a-z]+://([^/:?#.]+)', 1), 'token' FROM pages""",
    "block_table": f"""
SELECT * FROM (VALUES {", ".join(f"('{w}')" for w in L.BLOCK_LIST)}) AS t(host)
UNION SELECT domain FROM lookalikes WHERE domain LIKE '%-verify%' OR domain LIKE 'apple.mail%'""",
    "allow_table": f"""
SELECT * FROM (VALUES {", ".join(f"('{w}')" for w in L.ALLOW_LIST)}) AS t(host)
UNION SELECT lower(regexp_extract(url, '([^/:?#.]+[.]example[.][a-z]+)', 1)) FROM pages""",
    "nested_domains": "SELECT domain FROM cased_domains UNION SELECT 'a.B.' || domain FROM domains UNION SELECT ''",
    "list_actions": """
SELECT e.event_id, e.ts, concat('u', cast(e.user_id AS string), '.', d.domain) AS domain, '127.0.0.1' AS ip,
 CASE WHEN e.event_id % 3 = 0 THEN 'unblocked' ELSE 'blocked' END AS action
FROM events e JOIN domain_dim d ON d.i = e.event_id % 24""",
}
DEPENDS = {
    "dns_queries": ["domain_dim"], "tls_handshakes": ["dns_queries"], "flow_packets": ["dns_queries"],
    "detections": ["dns_queries"], "block_events": ["domain_dim"], "browser_downloads": ["domain_dim"],
    "browser_urls": ["domain_dim"], "hosts_lines": ["domain_dim"], "domains": ["domain_dim", "lookalikes"],
    "feed_urls": ["domain_dim"], "feed_one": ["lookalikes"], "hello_payloads": ["dns_queries"],
    "http_payloads": ["dns_queries"], "verifier_replies": ["domain_dim"], "noisy_names": ["domain_dim"],
    "urls": ["domain_dim"], "list_actions": ["domain_dim"], "cased_domains": ["domains"],
    "model_scores": ["lookalikes", "dns_queries"], "block_table": ["lookalikes"], "nested_domains": ["domains", "cased_domains"],
}


def with_views(*names: str) -> str:
    """``WITH`` clause (without a trailing comma) that defines the named views and what they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in DEPENDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in ordered)
