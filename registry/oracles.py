"""DuckDB SQL that gives the expected rows of each registered query. Written against the rules, not the Spark code."""

from __future__ import annotations

from registry.views import MARKER, with_views
from threatspark import lexicon as L

ORACLES: dict[str, str] = {}


def add(name: str, views: str, body: str) -> None:
    """Register ``body`` with the views it needs; ``body`` may start with further ``, name AS (...)`` parts."""
    head = with_views(*views.split()) if views else ""
    ORACLES[name] = f"{head}\n{body.strip()}"


# --- text fragments -----------------------------------------------------------------------------
def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def array(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def hits(text: str, words) -> str:
    """Words found in the text, alphabetically."""
    return f"list_filter({array(sorted(words))}, lambda w: contains({text}, w))"


def count(text: str, words) -> str:
    return f"len({hits(text, words)})"


def any_of(text: str, words) -> str:
    return f"({count(text, words)} > 0)"


def ends(text: str, words) -> str:
    return f"(len(list_filter({array(words)}, lambda w: ends_with({text}, w))) > 0)"


def listed(host: str, entries) -> str:
    """Host equals an entry or lies below one."""
    return f"(len(list_filter({array(sorted(set(entries)))}, lambda w: {host} = w OR ends_with({host}, '.' || w))) > 0)"


def entropy(text: str) -> str:
    share = f"((length({text}) - length(replace({text}, c, '')))::DOUBLE / length({text}))"
    chars = f"list_filter(list_distinct(string_split({text}, '')), lambda z: z <> '')"
    return f"(coalesce(-list_sum(list_transform({chars}, lambda c: {share} * log2({share}))), 0) + 0.0)"


def strip(text: str) -> str:
    return f"trim({text}, ' ' || chr(9) || chr(10) || chr(13))"


def stripped(text: str) -> str:
    return f"replace(replace(lower({text}), '.', ''), '-', '')"


def host_of(url: str) -> str:
    rest = f"CASE WHEN contains({url}, '://') THEN substr({url}, strpos({url}, '://') + 3) ELSE {url} END"
    return f"lower(split_part(split_part({rest}, '/', 1), ':', 1))"


def case_map(code: str, table: dict) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN {lit(v) if isinstance(v, str) else v}" for k, v in table.items()) + " END"


RISK = """CASE WHEN prediction = 'phishing' AND confidence >= 0.95 THEN 'high' WHEN prediction = 'phishing' AND confidence >= 0.8 THEN 'medium'
 WHEN prediction = 'phishing' THEN 'low' WHEN confidence >= 0.8 THEN 'low' ELSE 'medium' END"""


def decided(source: str, high: float = 0.85, low: float = 0.65) -> str:
    """Source rows with severity, action, reason and blocked flag."""
    pct = "printf('%.2f%%', confidence * 100)"
    return f"""SELECT *, CASE WHEN prediction = 'phishing' AND confidence >= {high} THEN 'critical'
  WHEN prediction = 'phishing' AND confidence >= {low} THEN 'high' WHEN prediction = 'phishing' THEN 'medium'
  WHEN confidence < {low} THEN 'medium' ELSE 'low' END AS alert_severity,
 CASE WHEN prediction <> 'phishing' THEN 'log_only' WHEN confidence >= {high} THEN 'block_dns' ELSE 'alert' END AS action_taken,
 CASE WHEN prediction <> 'phishing' THEN 'Legitimate domain'
  WHEN confidence >= {high} THEN 'High confidence phishing (' || {pct} || ')'
  WHEN confidence >= {low} THEN 'Phishing detected (' || {pct} || ')' ELSE 'Possible phishing (' || {pct} || ')' END AS reason,
 prediction = 'phishing' AND confidence >= {high} AS blocked FROM {source}"""


def overridden(source: str, block: str = "", allow: str = "") -> str:
    """Logged events after the list override."""
    block, allow = block or listed("lower(domain)", L.BLOCK_LIST), allow or listed("lower(domain)", L.ALLOW_LIST)
    return f"""SELECT * EXCLUDE (_b, _a) REPLACE (
 CASE WHEN _b THEN 'phishing' WHEN _a THEN 'legitimate' ELSE prediction END AS prediction,
 CASE WHEN _b THEN true WHEN _a THEN false ELSE blocked END AS blocked,
 CASE WHEN _b OR _a THEN 1.0::DOUBLE ELSE confidence END AS confidence,
 CASE WHEN _b THEN 'high' WHEN _a THEN 'low' ELSE risk_level END AS risk_level,
 CASE WHEN _b THEN 'critical' ELSE alert_severity END AS alert_severity,
 CASE WHEN _b THEN 'block_dns' ELSE action_taken END AS action_taken,
 CASE WHEN _b THEN 'Known malicious domain — REJECTED' WHEN _a THEN 'Trusted domain — APPROVED' ELSE reason END AS reason,
 CASE WHEN _b OR _a THEN 'list_engine' ELSE coalesce(source, 'ml_model') END AS source)
 FROM (SELECT *, {block} AS _b, NOT {block} AND {allow} AS _a FROM {source})"""


QUERIES = f""", q AS (SELECT event_id, ts, src_ip, dst_ip, rtrim(query_domain, '.') AS query_domain, ttl, packet_size,
 coalesce({case_map('qtype', L.QUERY_TYPES)}, 'TYPE_' || qtype) AS query_type FROM dns_queries WHERE qr = 0)"""
HANDSHAKES = """, h AS (SELECT * EXCLUDE (query_domain) FROM tls_handshakes WHERE sni IS NOT NULL OR dst_port IN (443, 8443))"""
PACKETS = """, p AS (SELECT event_id, seq, ts, src_ip, dst_ip, packet_size, ttl,
 CASE WHEN protocol IN ('TCP', 'UDP', 'ICMP') THEN protocol ELSE 'Unknown' END AS protocol,
 CASE WHEN protocol IN ('TCP', 'UDP') THEN src_port ELSE 0 END AS src_port,
 CASE WHEN protocol IN ('TCP', 'UDP') THEN dst_port ELSE 0 END AS dst_port FROM flow_packets)"""
WITH_RISK = f", wr AS (SELECT *, {RISK} AS risk_level FROM detections)"
CLASSIFIED = WITH_RISK + f", dec AS ({decided('wr')}), ev AS ({overridden('(SELECT *, NULL::VARCHAR AS source FROM dec)')})"
LOGGED = (
    f", wr AS (SELECT *, {RISK} AS risk_level FROM detections), dec AS ({decided('wr')}),"
    " logged AS (SELECT domain, destination_ip, prediction, confidence, risk_level, features_used, round(epoch_us(ts) / 1e6, 6) AS timestamp,"
    " alert_severity, action_taken, reason, blocked, CASE WHEN event_id % 6 = 0 THEN 'api_check' END AS source, ts FROM dec)"
)

# --- sources ------------------------------------------------------------------------------------
add("dns_queries_scan", "dns_queries", QUERIES + " SELECT * FROM q")
add("tls_handshakes_scan", "tls_handshakes", HANDSHAKES + " SELECT * FROM h")
add("flow_packets_scan", "flow_packets", PACKETS + " SELECT * FROM p")
add("sni_inventory", "hello_payloads", """
SELECT query_domain AS sni, count(*) AS handshakes, min(ts) AS first_seen, max(ts) AS last_seen
FROM hello_payloads WHERE event_id % 10 NOT IN (1, 2) GROUP BY 1""")
add("http_host_inventory", "http_payloads", """
SELECT DISTINCT split_part(split_part(payload, 'Host: ', 2), chr(13), 1) AS host FROM http_payloads WHERE contains(payload, 'Host: ')""")
add("detection_log_scan", "detections", LOGGED + f""", newest AS (SELECT DISTINCT * EXCLUDE (ts) FROM logged) {overridden('newest')}""")
add("detection_log_sink", "detections", LOGGED + " SELECT * EXCLUDE (ts) FROM logged")


def block_type(kind: str = "error_type", message: str = "error_message") -> str:
    text = f"lower({kind} || ' ' || {message})"
    return f"""CASE WHEN regexp_matches({text}, 'ssl|certificate') THEN 'ssl_error'
 WHEN regexp_matches({text}, 'timeout|timed out') THEN 'connection_timeout' WHEN contains({text}, 'refused') THEN 'firewall'
 WHEN regexp_matches({text}, 'dns|resolve') THEN 'dns_failure' WHEN contains({text}, 'reset') THEN 'connection_reset'
 WHEN regexp_matches({text}, 'antivirus|quarantine') THEN 'antivirus' ELSE 'unknown' END"""


BLOCKS = f", b AS (SELECT *, {block_type()} AS block_type FROM block_events)"
add("system_block_log_sink", "block_events", BLOCKS + " SELECT block_type, source, count(*) AS blocks FROM b GROUP BY ALL")
add("system_block_log_scan", "block_events", BLOCKS + """ SELECT domain, '0.0.0.0' AS destination_ip, block_type,
 round(epoch_us(ts) / 1e6, 6) AS timestamp, error_message, source FROM b""")
FEED_HOSTS = f"SELECT DISTINCT {host_of('url')} AS host FROM feed_urls WHERE contains(url, '://') AND {host_of('url')} <> ''"
add("feed_hosts", "feed_urls", FEED_HOSTS)
add("feed_snapshot_scan", "feed_urls", FEED_HOSTS)
add("text_feed_scan", "feed_urls", FEED_HOSTS)
add("json_feed_scan", "feed_urls", FEED_HOSTS)
add("feed_domains_netloc", "feed_urls", r"""
, f AS (SELECT url, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS n FROM feed_urls)
SELECT DISTINCT lower(CASE WHEN n <> '' THEN n ELSE split_part(url, '/', 1) END) AS domain, 'any' AS variant FROM f
UNION SELECT * FROM (SELECT CASE WHEN n <> '' THEN n ELSE split_part(url, '/', 3) END AS domain, 'dotted' AS variant FROM f) WHERE contains(domain, '.')""")
MARKED = f"""SELECT line_no, split_part(line, ' ', 1) AS ip, split_part(line, ' ', 2) AS domain,
 CASE WHEN contains(line, '{MARKER} ') OR line LIKE '%lan # %' THEN array_to_string(string_split(line, ' ')[4:], ' ') ELSE 'Unknown' END AS timestamp
 FROM hosts_lines WHERE contains(line, '{MARKER}')"""
add("blocklist_text_scan", "hosts_lines", MARKED)
add("hosts_file_round_trip", "hosts_lines", f"SELECT ip, domain, timestamp, count(*) AS lines FROM ({MARKED}) GROUP BY ALL")


def local(h: str) -> str:
    return f"""({h} = '' OR {h} IN {values(L.LOCAL_HOSTS)} OR regexp_matches({h}, '\\.(local|localhost|lan)$')
 OR regexp_matches({h}, '^(127\\.|10\\.|192\\.168\\.|169\\.254\\.)') OR regexp_matches({h}, '^172\\.(1[6-9]|2[0-9]|3[01])(\\.|$)'))"""


def external(url: str) -> str:
    """Public host of a URL, '' for others."""
    low = f"lower({strip(url)})"
    rest = f"regexp_replace(split_part(split_part(split_part(substr({low}, strpos({low}, '://') + 3), '/', 1), '?', 1), '#', 1), '^.*@', '')"
    host = f"trim(split_part(CASE WHEN contains({low}, '://') THEN ltrim({rest}, '[') ELSE {low} END, ':', 1), '.')"
    return f"CASE WHEN {local(host)} OR NOT regexp_full_match({host}, '[a-z0-9.-]+') THEN '' ELSE {host} END"


add("hosts_file_blocks", "hosts_lines", f"""
, parts AS (SELECT line_no, string_split_regex({strip("split_part(line, '#', 1)")}, '\\s+') AS w FROM hosts_lines)
, names AS (SELECT line_no, w[1] AS ip, unnest(w[2:]) AS host, generate_subscripts(w[2:], 1) AS pos FROM parts
 WHERE len(w) >= 2 AND w[1] IN {values(L.NULL_ROUTES)})
, pub AS (SELECT *, {external('host')} AS domain FROM names)
SELECT domain, 'hosts_file' AS source, 'firewall' AS block_type, 'Hosts file null-routes ' || domain || ' → ' || ip AS error_message,
 ip AS destination_ip FROM pub WHERE domain <> '' QUALIFY row_number() OVER (PARTITION BY domain ORDER BY line_no, pos) = 1""")
DOWNLOADS = f""", lab AS (SELECT id, browser, start_time, {external('tab_url')} AS domain,
 CASE WHEN {case_map('interrupt_reason', L.INTERRUPT_REASONS)} IS NOT NULL THEN {case_map('interrupt_reason', L.INTERRUPT_REASONS)}
 WHEN interrupt_reason <> 0 THEN 'INTERRUPT_REASON_' || interrupt_reason
 WHEN {case_map('danger_type', L.DANGER_TYPES)} IS NOT NULL THEN {case_map('danger_type', L.DANGER_TYPES)}
 WHEN state IN (2, 3, 4) THEN 'CANCELLED_OR_INTERRUPTED' END AS label
 FROM browser_downloads WHERE state <> 1 OR interrupt_reason <> 0)"""
TITLE = "upper(browser[1]) || browser[2:]"
add("download_blocks", "browser_downloads", DOWNLOADS + f"""
SELECT id, browser, start_time, domain, browser AS source, 'browser_download_block' AS block_type, {TITLE} || ' blocked download: ' || label AS error_message,
 '' AS destination_ip FROM lab WHERE domain <> '' AND label IS NOT NULL""")
add("stream_block_monitor", "browser_downloads", DOWNLOADS + f"""
SELECT id, browser, domain, {TITLE} || ' blocked download: ' || label AS error_message FROM lab WHERE domain <> '' AND label IS NOT NULL""")
add("navigation_blocks", "browser_urls", f"""
, newest AS (SELECT * FROM browser_urls WHERE url LIKE 'chrome-error://%' OR url LIKE 'edge-error://%')
, named AS (SELECT id, browser, {external("regexp_extract(url, 'https?://([A-Za-z0-9.-]+)', 1)")} AS domain FROM newest)
SELECT id, browser, domain, browser AS source, 'browser_navigation_block' AS block_type,
 {TITLE} || ' showed an error page for ' || domain AS error_message, '' AS destination_ip FROM named WHERE domain <> ''""")
add("recent_domains", "browser_urls", f"""
, newest AS (SELECT * FROM browser_urls WHERE last_visit_time > (SELECT max(last_visit_time) FROM browser_urls) - 86400000000)
SELECT domain, max(last_visit_time) AS last_visit_time FROM (SELECT {external('url')} AS domain, last_visit_time FROM newest)
WHERE domain <> '' GROUP BY 1""")
add("training_tables_scan", "dns_queries tls_handshakes", QUERIES + HANDSHAKES + """
, u AS (SELECT 0 AS t, event_id, query_domain AS domain, ttl, query_type, NULL AS tls_version, NULL AS packet_size FROM q
 UNION ALL SELECT 1, event_id, sni, NULL, NULL, tls_version, packet_size FROM h WHERE sni IS NOT NULL)
SELECT * EXCLUDE (t) FROM u QUALIFY row_number() OVER (PARTITION BY domain ORDER BY t, event_id) = 1""")
ORACLES["training_csv_scan"] = f"SELECT *, CASE WHEN ttl IS NOT NULL THEN 1 - length(domain) % 2 ELSE length(domain) % 2 END::INT AS label FROM ({ORACLES['training_tables_scan']})"

# --- sinks --------------------------------------------------------------------------------------
BLOCKED = f""", named AS (SELECT * REPLACE ('u' || (event_id % 50) || '.' || domain AS domain) FROM detections)
, bl AS (SELECT * FROM ({decided('named')}) WHERE blocked), cur AS ({MARKED})"""
add("blocklist_publish", "detections hosts_lines", BLOCKED + f"""
SELECT DISTINCT domain, '127.0.0.1 ' || domain || ' # {MARKER}' AS line FROM bl WHERE domain NOT IN (SELECT domain FROM cur)""")
add("blocklist_remove", "detections hosts_lines", BLOCKED + """
SELECT * FROM hosts_lines WHERE line_no NOT IN (SELECT line_no FROM cur WHERE domain IN (SELECT domain FROM bl))""")
add("blocklist_clear", "hosts_lines", f"SELECT * FROM hosts_lines WHERE NOT contains(line, '{MARKER}')")
add("blocklist_history", "list_actions", """
SELECT domain, count(*) AS changes, arg_max(action, (ts, event_id)) AS action, arg_max(ip, (ts, event_id)) AS ip, max(ts) AS ts
FROM list_actions GROUP BY 1""")
add("address_lines", "detections hosts_lines", BLOCKED + """
SELECT destination_ip || ' ' || domain || ' # ' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS domain_line,
 destination_ip || ' # ' || domain || ' ' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS address_line FROM bl""")


def keyword_label(d: str = "domain") -> str:
    return f"""CASE WHEN lower({d}) IN {values(L.FEED_FALLBACK)} THEN 'phishing' WHEN lower({d}) IN {values(L.LABEL_LEGITIMATE)} THEN 'legitimate'
 WHEN {any_of(f'lower({d})', L.LABEL_KEYWORDS)} THEN 'phishing' ELSE 'legitimate' END"""


add("labelled_dataset_sink", "domains", f"SELECT {keyword_label()} AS label, count(*) AS records FROM domains GROUP BY 1")

# --- scalar expressions -------------------------------------------------------------------------
RAW = strip("url")
add("host_normalize", "urls", f"""
SELECT event_id, {host_of(RAW)} AS host, CASE WHEN {RAW} = '' THEN '' WHEN contains({RAW}, '://') THEN {RAW}
 ELSE 'http://' || split_part(split_part({RAW}, '/', 1), ':', 1) END AS url FROM urls""")
add("external_host", "urls", f"SELECT event_id, {external('url')} AS host FROM urls")
NOISE = strip("sni")
for _junk in L.SNI_GARBAGE:
    NOISE = f"replace({NOISE}, {lit(_junk)}, ' ')"
add("sni_clean", "noisy_names", f"""
, a AS (SELECT event_id, regexp_extract({NOISE}, '^[\\x00-\\x7F]*') AS t FROM noisy_names)
, b AS (SELECT event_id, trim(regexp_extract(regexp_replace(t, '[^A-Za-z0-9.\\- \\n\\r\\t]', '', 'g'), '^[ \\n\\r\\t]*([A-Za-z0-9.-]*)', 1), '.-') AS n FROM a)
SELECT event_id, CASE WHEN contains(n, '.') AND length(n) BETWEEN 4 AND 253
 AND len(list_filter(string_split(n, '.'), lambda x: length(x) BETWEEN 1 AND 63 AND regexp_matches(x, '[A-Za-z]'))) = len(string_split(n, '.'))
 THEN n ELSE '' END AS domain FROM b""")
add("entropy_stripped", "domains", f"SELECT domain, round({entropy(stripped('domain'))}, 6) AS entropy FROM domains")
add("entropy_raw", "domains", f"SELECT domain, round({entropy('domain')}, 6) AS entropy FROM domains")
add("entropy_label", "domains", f"""
, l AS (SELECT domain, split_part(domain, '.', 1) AS label FROM domains)
SELECT domain, round({entropy('label')}, 6) AS entropy, contains(domain, '.') AND {entropy('label')} > 4.5 AS is_high,
 length(label) >= 8 AND round({entropy('label')}, 6) >= 3.5 AS is_random FROM l""")
DOMAIN_FEATURES = f"""length(domain)::INT AS domain_length, greatest(length(domain) - length(replace(domain, '.', '')) - 1, 0)::INT AS subdomain_count,
 round({entropy(stripped('domain'))}, 6) AS domain_entropy, regexp_matches(domain, '[0-9]') AS has_numbers_in_domain,
 contains(domain, '-') AS has_hyphens_in_domain, regexp_matches(domain, '[@#$%&*!~]') AS has_suspicious_chars,
 domain IN {values(L.BLOCK_LIST)} AS is_known_phishing, domain IN {values(L.KNOWN_LEGITIMATE)} AS is_known_legitimate"""
add("domain_features", "domains", f"SELECT domain, {DOMAIN_FEATURES} FROM domains")


def tls_features(domain: str) -> str:
    match = f"(contains(lower({domain}), lower(sni)) OR contains(lower(sni), lower({domain})))"
    return f"""sni IS NOT NULL AND sni <> 'N/A' AS sni_present, coalesce(length(sni), 0)::INT AS sni_length,
 CASE WHEN sni IS NULL THEN 0 ELSE round({entropy(stripped('sni'))}, 6) END AS sni_entropy,
 coalesce({match}, false) AS sni_matches_domain, coalesce(NOT {match}, false) AS has_sni_spoofing,
 coalesce(tls_version, 'Unknown') AS tls_version, coalesce(CASE tls_version {' '.join(f"WHEN {lit(k)} THEN {v}" for k, v in L.TLS_VERSION_CODES.items())} END, 0) AS tls_version_code,
 coalesce(tls_version IN ('TLS 1.0', 'TLS 1.1'), false) AS is_outdated_tls, dst_port IN (443, 8443) AS uses_standard_https_port,
 packet_size AS handshake_packet_size, 0 AS certificate_subject_length"""


add("tls_features", "tls_handshakes", f"""
SELECT event_id, ts, src_ip, dst_ip, src_port, dst_port, sni, query_domain, packet_size, {tls_features('query_domain')}
FROM tls_handshakes WHERE sni IS NOT NULL OR dst_port IN (443, 8443)""")
add("sni_domain_check", "tls_handshakes", """
SELECT event_id, coalesce(contains(lower(query_domain), lower(sni)) OR contains(lower(sni), lower(query_domain)), false) AS sni_matches_domain,
 coalesce(NOT (contains(lower(query_domain), lower(sni)) OR contains(lower(sni), lower(query_domain))), false) AS has_sni_spoofing FROM tls_handshakes""")


def flow_stats(keys: str, source: str = "p") -> str:
    return f"""SELECT {keys}, avg(packet_size) AS packet_size_mean, coalesce(stddev_samp(packet_size), 0) AS packet_size_std,
 min(packet_size) AS packet_size_min, max(packet_size) AS packet_size_max, max(packet_size) - min(packet_size) AS packet_size_range,
 coalesce(avg(gap), 0) AS inter_packet_timing_mean, coalesce(stddev_samp(gap), 0) AS inter_packet_timing_std,
 coalesce(min(gap), 0) AS inter_packet_timing_min, coalesce(max(gap), 0) AS inter_packet_timing_max, count(*) AS total_packets,
 (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS flow_duration,
 CASE WHEN max(ts) > min(ts) THEN count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6) ELSE 0 END AS packets_per_second,
 arg_max(dst_port, (ts, event_id, seq)) AS destination_port, arg_max(ttl, (ts, event_id, seq)) AS ttl_value
 FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {keys} ORDER BY ts, event_id, seq)) / 1e6 AS gap FROM {source}) GROUP BY {keys}"""


FLOW_DOUBLES = (
    "packet_size_mean packet_size_std inter_packet_timing_mean inter_packet_timing_std inter_packet_timing_min "
    "inter_packet_timing_max flow_duration packets_per_second"
).split()


def near(value: str, places: int = 6) -> str:
    """Round with ties pushed up, deviations to three places."""
    return f"round(({value})::DOUBLE + 1e-9, {3 if '_std' in value else places})"


def rounded(columns, places: int = 6, prefix: str = "") -> str:
    """Star with the columns rounded like ``registry.queries.rounded_flows`` does."""
    return "* REPLACE (" + ", ".join(f"{near(prefix + c, places)} AS {prefix}{c}" for c in columns) + ")"


FLOW_KEY = "src_ip, dst_ip, src_port, dst_port, protocol"
add("flow_stats", "flow_packets", PACKETS + f", fs AS ({flow_stats(FLOW_KEY)}) SELECT {rounded(FLOW_DOUBLES)} FROM fs")
add("flows_for_ip", "flow_packets", PACKETS + f""", https AS (SELECT * FROM p WHERE dst_port = 443)
, fs AS ({flow_stats('dst_ip', 'https')}) SELECT {rounded(FLOW_DOUBLES)} FROM fs""")

SESSION = """
, asked AS (SELECT src_ip, lower(query_domain) AS name, ts FROM q)
, named AS (SELECT * FROM h WHERE sni IS NOT NULL)
, delay AS (SELECT n.event_id, (epoch_us(n.ts) - epoch_us(a.ts)) / 1e6 AS dns_to_tls_delay FROM named n
 ASOF LEFT JOIN asked a ON n.src_ip = a.src_ip AND lower(n.sni) = a.name AND n.ts >= a.ts)
, concurrent AS (SELECT event_id, count(*) OVER (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n FROM h)
, ordinal AS (SELECT event_id, row_number() OVER (PARTITION BY src_ip, sni ORDER BY ts, event_id) AS n FROM named)"""
CONNECTION = QUERIES + HANDSHAKES + PACKETS + SESSION + f"""
, pairs AS (SELECT DISTINCT lower(query_domain) AS domain, dst_ip AS destination_ip FROM q)
, dns AS (SELECT lower(query_domain) AS domain, arg_min(ttl, (ts, event_id)) AS ttl_value, arg_min(query_type, (ts, event_id)) AS query_type,
 count(*) AS query_frequency, coalesce(var_samp(ttl), 0) AS ttl_variance, min(ts) AS first_ts FROM q GROUP BY 1)
, tls AS (SELECT * FROM h WHERE dst_port = 443 QUALIFY row_number() OVER (PARTITION BY dst_ip ORDER BY ts, event_id) = 1)
, https AS (SELECT * FROM p WHERE dst_port = 443)
, flow AS ({flow_stats('dst_ip', 'https')})
, conn AS (SELECT pr.domain, pr.destination_ip, t.sni, t.dst_port, t.packet_size, t.tls_version, t.event_id AS h_id, t.ts AS h_ts,
 d.* EXCLUDE (domain), f.* EXCLUDE (dst_ip, ttl_value), f.ttl_value AS flow_ttl, dl.dns_to_tls_delay, o.n AS ordinal, c.n AS concurrent
 FROM pairs pr LEFT JOIN dns d ON d.domain = pr.domain LEFT JOIN tls t ON t.dst_ip = pr.destination_ip LEFT JOIN flow f ON f.dst_ip = pr.destination_ip
 LEFT JOIN delay dl ON dl.event_id = t.event_id LEFT JOIN ordinal o ON o.event_id = t.event_id
 LEFT JOIN concurrent c ON c.event_id = t.event_id AND t.sni IS NOT NULL)
, feat AS (SELECT *, {DOMAIN_FEATURES} FROM conn)
, tfeat AS (SELECT * REPLACE (coalesce(tls_version, 'Unknown') AS tls_version), {tls_features('domain').replace("coalesce(tls_version, 'Unknown') AS tls_version, ", "")} FROM feat)
, wide AS (SELECT domain, destination_ip, sni, domain_length AS dns_domain_length, subdomain_count AS dns_subdomain_count, domain_entropy AS dns_domain_entropy,
 has_numbers_in_domain AS dns_has_numbers_in_domain, has_hyphens_in_domain AS dns_has_hyphens_in_domain, has_suspicious_chars AS dns_has_suspicious_chars,
 is_known_phishing AS dns_is_known_phishing, is_known_legitimate AS dns_is_known_legitimate, ttl_value AS dns_ttl_value, query_type AS dns_query_type,
 query_frequency AS dns_query_frequency, round(ttl_variance, 6) AS dns_ttl_variance,
 CASE WHEN h_id IS NULL THEN true ELSE sni_matches_domain END AS tls_sni_matches_domain, CASE WHEN h_id IS NULL THEN false ELSE has_sni_spoofing END AS tls_has_sni_spoofing,
 CASE WHEN h_id IS NULL THEN 'TLS 1.3' ELSE tls_version END AS tls_tls_version, CASE WHEN h_id IS NULL THEN 3 ELSE tls_version_code END AS tls_tls_version_code,
 CASE WHEN h_id IS NULL THEN false ELSE is_outdated_tls END AS tls_is_outdated_tls,
 CASE WHEN h_id IS NULL THEN true ELSE uses_standard_https_port END AS tls_uses_standard_https_port,
 CASE WHEN h_id IS NULL THEN 516 ELSE handshake_packet_size END AS tls_handshake_packet_size, 0 AS tls_certificate_subject_length,
 CASE WHEN h_id IS NULL THEN true ELSE sni_present END AS tls_sni_present, CASE WHEN h_id IS NULL THEN length(domain) ELSE sni_length END::INT AS tls_sni_length,
 CASE WHEN h_id IS NULL THEN round({entropy('domain')}, 6) ELSE sni_entropy END AS tls_sni_entropy,
 {', '.join(f"{near(f'coalesce({c}, {d})')} AS flow_{c}" for c, d in (('packet_size_mean', 1200.0), ('packet_size_std', 400.0), ('inter_packet_timing_mean', 0.01), ('inter_packet_timing_std', 0.005), ('inter_packet_timing_min', 0.001), ('inter_packet_timing_max', 0.05), ('flow_duration', 0.1), ('packets_per_second', 100.0)))},
 coalesce(packet_size_min, 66) AS flow_packet_size_min, coalesce(packet_size_max, 1460) AS flow_packet_size_max, coalesce(packet_size_range, 1394) AS flow_packet_size_range,
 coalesce(total_packets, 10) AS flow_total_packets, coalesce(destination_port, 443) AS flow_destination_port, coalesce(flow_ttl, 64) AS flow_ttl_value,
 first_ts AS session_dns_query_timestamp, h_ts AS session_tls_handshake_timestamp, round(dns_to_tls_delay, 6) AS session_dns_to_tls_delay,
 coalesce(ordinal = 1, true) AS session_is_first_connection_to_domain, coalesce(concurrent, 1) AS session_concurrent_connections,
 coalesce(ordinal, 1) AS session_connection_count_to_domain, ttl_value IS NULL AS dns_imputed, h_id IS NULL AS tls_imputed, total_packets IS NULL AS flow_imputed
 FROM tfeat)"""
CONNECTION_VIEWS = "dns_queries tls_handshakes flow_packets"
add("connection_features", CONNECTION_VIEWS, CONNECTION + " SELECT * FROM wide")
add("connection_indicators", CONNECTION_VIEWS, CONNECTION + """
SELECT domain, destination_ip, array_to_string(list_filter([
 CASE WHEN dns_domain_entropy > 4.5 THEN 'high_domain_entropy' END, CASE WHEN dns_ttl_value < 60 THEN 'low_ttl' END,
 CASE WHEN tls_is_outdated_tls THEN 'outdated_tls' END, CASE WHEN tls_has_sni_spoofing THEN 'sni_spoofing' END,
 CASE WHEN dns_domain_length > 50 OR dns_domain_length < 4 THEN 'domain_length' END, CASE WHEN dns_subdomain_count > 3 THEN 'many_subdomains' END,
 CASE WHEN dns_query_frequency > 5 THEN 'frequent_queries' END, CASE WHEN tls_sni_length > 200 THEN 'long_sni' END,
 CASE WHEN tls_sni_entropy > 4.5 THEN 'random_sni' END, CASE WHEN NOT tls_uses_standard_https_port THEN 'odd_https_port' END,
 CASE WHEN tls_handshake_packet_size < 50 OR tls_handshake_packet_size > 2000 THEN 'odd_handshake_size' END,
 CASE WHEN flow_total_packets < 5 THEN 'few_packets' END, CASE WHEN flow_flow_duration < 1 THEN 'short_flow' END,
 CASE WHEN flow_packets_per_second > 100 THEN 'bulk_transfer' END, CASE WHEN session_dns_to_tls_delay < 0.1 THEN 'instant_handshake' END],
 lambda x: x IS NOT NULL), '|') AS indicators FROM wide""")
add("connection_defaults", "lookalikes", f"""
, rq AS (SELECT DISTINCT lower(domain) AS domain, '203.0.113.' || length(domain) AS destination_ip,
 CASE WHEN length(domain) % 2 = 0 THEN upper(domain[1]) || lower(domain[2:]) ELSE 'cdn.' || domain END AS sni FROM lookalikes)
SELECT *, true AS dns_imputed, true AS tls_imputed, true AS flow_imputed,
 3600 AS dns_ttl_value, 'A' AS dns_query_type, 1::BIGINT AS dns_query_frequency, 0e0 AS dns_ttl_variance,
 'TLS 1.3' AS tls_tls_version, 3 AS tls_tls_version_code, 516 AS tls_handshake_packet_size, length(sni)::INT AS tls_sni_length,
 round({entropy('sni')}, 6) AS tls_sni_entropy, length(domain) % 2 = 0 AS tls_sni_matches_domain, false AS tls_has_sni_spoofing, round({entropy('domain')}, 6) AS dns_domain_entropy,
 1200e0 AS flow_packet_size_mean, 10::BIGINT AS flow_total_packets, 443 AS flow_destination_port, 64 AS flow_ttl_value FROM rq""")
add("feature_vector", "domains", f"""
, f AS (SELECT domain, {DOMAIN_FEATURES} FROM domains)
SELECT domain, domain_length::DOUBLE AS f0, subdomain_count::DOUBLE AS f1, domain_entropy AS f2, has_numbers_in_domain::INT::DOUBLE AS f3,
 has_hyphens_in_domain::INT::DOUBLE AS f4, coalesce(try_cast(domain AS DOUBLE), 0) AS f5, 0e0 AS f6 FROM f""")
TO_SCALE = f", s AS (SELECT domain, length(domain) AS domain_length, {entropy(stripped('domain'))} AS domain_entropy FROM domains)"
SCALED = ("domain_length", "domain_entropy")
add("feature_minmax", "domains", TO_SCALE + " SELECT domain, " + ", ".join(
    f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in SCALED) + " FROM s")
add("feature_zscore", "domains", TO_SCALE + " SELECT domain, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in SCALED) + " FROM s")
add("standard_scale", "domains", TO_SCALE + ", m AS (SELECT " + ", ".join(
    f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in SCALED) + " FROM s WHERE length(domain) % 5 <> 0) SELECT domain, " + ", ".join(
    f"round(({c} - mu_{c}) / sd_{c}, 6) AS {c}" for c in SCALED) + " FROM s, m")
add("risk_level", "detections", f"SELECT event_id, {RISK} AS risk_level FROM detections")
add("alert_severity", "detections", f"SELECT event_id, alert_severity FROM ({decided('detections')})")
add("decision", "detections", f"SELECT * EXCLUDE (ts) FROM ({decided('detections', 0.8, 0.6)})")
add("block_type_classify", "block_events", BLOCKS + " SELECT event_id, error_type, block_type FROM b")


# --- scores -------------------------------------------------------------------------------------
def typos(source: str) -> str:
    """CTE parts: best near-miss brand per domain of ``source``."""
    brands = ", ".join(f"({lit(b)})" for b in L.BRANDS if len(b) >= 6)
    return f""", near AS (SELECT domain, b.brand, levenshtein(split_part(domain, '.', 1), b.brand) AS distance FROM {source}
 JOIN (VALUES {brands}) AS b(brand) ON length(split_part(domain, '.', 1)) >= 4 AND split_part(domain, '.', 1) <> b.brand
 AND abs(length(split_part(domain, '.', 1)) - length(b.brand)) <= 2)
, typo AS (SELECT domain, brand, distance FROM near WHERE distance BETWEEN 1 AND CASE WHEN length(brand) = 6 THEN 1 ELSE 2 END
 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY distance, brand) = 1)"""


def brand(source: str) -> str:
    real = L.BrandRules().real_domains
    return typos(source) + f"""
, sig AS (SELECT s.domain, s.domain IN {values(real)} AS real, {hits('s.domain', L.BRANDS)} AS bh, {hits('s.domain', L.BRAND_TOKENS)} AS th,
 len(string_split(split_part(s.domain, '.', 1), '-')) - 1 AS hy, {ends('s.domain', L.BRAND_TLDS)} AS cheap, t.brand AS tb, t.distance AS td
 FROM {source} s LEFT JOIN typo t ON t.domain = s.domain)
, pts AS (SELECT *, CASE WHEN real THEN 0 ELSE CASE WHEN len(bh) > 0 THEN 55 ELSE 0 END + CASE WHEN tb IS NULL THEN 0 WHEN len(bh) > 0 THEN 45 ELSE 80 END
 + CASE WHEN len(th) > 0 THEN 25 + 5 * least(len(th), 3) ELSE 0 END + CASE WHEN hy >= 2 THEN 10 ELSE 0 END + CASE WHEN cheap THEN 20 ELSE 0 END END AS points FROM sig)
, brandy AS (SELECT *, NOT real AND points >= 70 AND ((len(bh) > 0 AND (len(th) > 0 OR hy >= 2)) OR tb IS NOT NULL) AS is_phishing,
 concat_ws('; ', CASE WHEN len(bh) > 0 THEN 'impersonates brand ''' || bh[1] || '''' END,
 'typo of brand ''' || tb || ''' (edit distance ' || td || ')', CASE WHEN len(th) > 0 THEN 'contains ' || array_to_string(th[1:2], '/') END,
 CASE WHEN hy >= 2 THEN hy || ' hyphens in label' END, CASE WHEN cheap THEN 'cheap/abused TLD' END) AS why FROM pts)"""


add("typosquat_match", "domains", typos("domains") + " SELECT domain, distance::INT AS distance, brand FROM typo")
TABLE_TYPOS = """, near AS (SELECT domain, b.word AS brand, levenshtein(split_part(domain, '.', 1), b.word) AS distance FROM domains
 JOIN (SELECT DISTINCT word FROM brand_words WHERE kind = 'brand' AND length(word) >= 6) b ON length(split_part(domain, '.', 1)) >= 4
 AND split_part(domain, '.', 1) <> b.word AND abs(length(split_part(domain, '.', 1)) - length(b.word)) <= 2)
, typo AS (SELECT domain, brand, distance FROM near WHERE distance BETWEEN 1 AND CASE WHEN length(brand) = 6 THEN 1 ELSE 2 END
 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY distance, brand) = 1)"""
TABLE_WORDS = """, hw AS (SELECT DISTINCT domain, kind, word FROM domains JOIN brand_words ON word <> '' AND contains(domain, word))
, hl AS (SELECT domain, coalesce(list_sort(list(word) FILTER (kind = 'brand')), []) AS bh, coalesce(list_sort(list(word) FILTER (kind = 'token')), []) AS th
 FROM domains LEFT JOIN hw USING (domain) GROUP BY domain)"""
add("typosquat_table", "domains brand_words", TABLE_TYPOS + " SELECT domain, distance::INT AS distance, brand FROM typo")


def brand_from_table() -> str:
    """The CTE parts of :func:`brand` with the words of the table, telling three tokens."""
    rest = brand("domains")[len(typos("domains")):]
    rest = rest.replace(f"{hits('s.domain', L.BRANDS)} AS bh, {hits('s.domain', L.BRAND_TOKENS)} AS th", "w.bh, w.th")
    rest = rest.replace("FROM domains s LEFT JOIN typo", "FROM domains s JOIN hl w ON w.domain = s.domain LEFT JOIN typo")
    return TABLE_TYPOS + TABLE_WORDS + rest.replace("th[1:2]", "th[1:3]")


add("brand_table_heuristic", "domains brand_words", brand_from_table() + """
SELECT domain, is_phishing, least(points, 95) / 100.0::DOUBLE AS confidence, points / 100.0::DOUBLE AS score,
 CASE WHEN is_phishing THEN 'Brand-impersonation pattern: ' || why END AS reason FROM brandy""")
add("brand_heuristic", "domains", brand("domains") + """
SELECT domain, is_phishing, least(points, 95) / 100.0::DOUBLE AS confidence, points / 100.0::DOUBLE AS score,
 CASE WHEN is_phishing THEN 'Brand-impersonation pattern: ' || why END AS reason FROM brandy""")
MIXED = "list_filter(regexp_extract_all(label, '[a-z0-9]+'), lambda t: length(t) >= 4 AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]'))[1]"


def lexical(source: str) -> str:
    real = L.ScoreRules().real_domains
    return f"""
, ls AS (SELECT domain, split_part(domain, '.', 1) AS label FROM {source})
, lm AS (SELECT *, {MIXED} AS tok FROM ls)
, lx AS (SELECT *, CASE WHEN domain NOT IN {values(real)} THEN {hits('domain', L.SCORE_BRANDS)}[1] END AS bh, {hits('domain', L.SCORE_TOKENS)} AS th,
 list_filter({array(L.SCORE_LOOKALIKES)}, lambda w: contains(domain, w))[1] AS pair,
 list_filter({array(sorted(L.SCORE_BRANDS))}, lambda w: contains(translate(tok, '{L.DEOBFUSCATE_FROM}', '{L.DEOBFUSCATE_TO}'), w) AND NOT contains(tok, w))[1] AS swapped,
 list_filter({array(L.SCORE_TLDS)}, lambda w: ends_with(domain, w))[1] AS tld, len(string_split(domain, '-')) - 1 AS hy, length(label) AS ll,
 length(label) >= 8 AND round({entropy('label')}, 9) >= 3.5 AS rnd, printf('%.1f', round({entropy('label')}, 9)) AS bits FROM lm)
, lr AS (SELECT domain, least(100, CASE WHEN bh IS NOT NULL THEN 45 ELSE 0 END + CASE WHEN len(th) > 0 THEN 15 + 5 * least(len(th), 3) ELSE 0 END
 + CASE WHEN pair IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN tok IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN swapped IS NOT NULL THEN 35 ELSE 0 END
 + CASE WHEN tld IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN hy >= 3 THEN 15 ELSE 0 END + CASE WHEN ll >= 25 THEN 10 ELSE 0 END
 + CASE WHEN rnd THEN 15 ELSE 0 END) / 100.0::DOUBLE AS score,
 list_filter(['contains brand name ''' || bh || '''', CASE WHEN len(th) > 0 THEN 'suspicious token(s): ' || array_to_string(th[1:3], ', ') END,
 'lookalike character pattern ''' || pair || '''', 'digit/letter mixing in token ''' || tok || '''',
 'brand impersonation via digit swap → ''' || swapped || '''', 'cheap/abused TLD ''' || tld || '''', CASE WHEN hy >= 3 THEN hy || ' hyphens (typical of phishing)' END,
 CASE WHEN ll >= 25 THEN 'unusually long label (' || ll || ' chars)' END, CASE WHEN rnd THEN 'high-entropy label (entropy=' || bits || ')' END], lambda x: x IS NOT NULL) AS reasons FROM lx)"""


add("lexical_risk_score", "domains", lexical("domains") + " SELECT domain, score, array_to_string(reasons, '|') AS reasons FROM lr")
add("lexical_table_score", "domains brand_words", TABLE_WORDS + lexical("domains")
    .replace(f"{hits('domain', L.SCORE_BRANDS)}[1]", "bh0[1]").replace(f"{hits('domain', L.SCORE_TOKENS)} AS th", "th0 AS th")
    .replace("FROM lm)", "FROM lm JOIN (SELECT domain, bh AS bh0, th AS th0 FROM hl) w USING (domain))") + " SELECT domain, score, array_to_string(reasons, '|') AS reasons FROM lr")
add("digit_swap_brands", "domains", lexical("domains") + " SELECT domain, coalesce(tok, '') AS token, swapped AS brand FROM lx")
add("keyword_label", "cased_domains", f"SELECT domain, {keyword_label('lower(domain)')} AS label FROM cased_domains")
VERIFIED = f""", vp AS (SELECT domain, 40 * {count('domain', L.VERIFY_STRONG)} + 20 * {count('domain', L.VERIFY_MEDIUM)}
 + 10 * {count('domain', L.VERIFY_WEAK)} + 30 * {count('domain', L.VERIFY_BRANDS)} AS pt FROM domains)
, ver AS (SELECT domain, pt > 50 AS is_phishing, CASE WHEN pt > 50 THEN least(950, 500 + 4 * pt) ELSE least(900, 500 + 3 * (100 - pt)) END / 1000.0::DOUBLE AS confidence FROM vp)"""
add("fallback_verify", "cased_domains", VERIFIED.replace("FROM domains", "FROM (SELECT lower(domain) AS domain, domain AS given FROM cased_domains)")
    .replace("vp AS (SELECT domain,", "vp AS (SELECT domain, given,").replace("ver AS (SELECT domain,", "ver AS (SELECT given AS domain,") + " SELECT * FROM ver")
REPLY = """, rb AS (SELECT event_id, domain, reply, regexp_extract(reply, '(?s)\\{.*\\}') AS body FROM verifier_replies)
, rj AS (SELECT *, body <> '' AND json_valid(body) AS ok FROM rb)
, js AS (SELECT event_id, CASE WHEN ok THEN coalesce(json_extract_string(body, '$.is_phishing')::BOOLEAN, false) END AS is_phishing,
 CASE WHEN ok THEN coalesce(json_extract_string(body, '$.confidence')::DOUBLE, 0.5) END AS confidence,
 CASE WHEN ok THEN coalesce(json_extract_string(body, '$.reasoning'), 'Verified by Gemini') END AS reasoning FROM rj)"""
REPLY_TEXT = f""", tx AS (SELECT event_id, {any_of('lower(reply)', L.REPLY_PHISHING_WORDS)} AS is_phishing,
 CASE WHEN {any_of('lower(reply)', L.REPLY_PHISHING_WORDS + L.REPLY_LEGITIMATE_WORDS)} THEN 0.7e0 ELSE 0.5e0 END AS confidence, reply[1:100] AS reasoning FROM verifier_replies)"""
add("verifier_json_parse", "verifier_replies", REPLY.replace("\\\\", "\\") + " SELECT * FROM js")
add("verifier_text_parse", "verifier_replies", REPLY_TEXT + " SELECT * FROM tx")
add("verifier_verdict", "verifier_replies", REPLY.replace("\\\\", "\\") + REPLY_TEXT + VERIFIED.replace("FROM domains", "FROM (SELECT DISTINCT domain FROM rb)") + """
SELECT rj.event_id, CASE WHEN body = '' THEN ver.is_phishing WHEN ok THEN js.is_phishing ELSE tx.is_phishing END AS is_phishing,
 CASE WHEN body = '' THEN ver.confidence WHEN ok THEN js.confidence ELSE tx.confidence END AS confidence,
 CASE WHEN body = '' THEN 'Fallback heuristic (Gemini unavailable)' WHEN ok THEN js.reasoning ELSE tx.reasoning END AS reasoning
FROM rj JOIN js USING (event_id) JOIN tx USING (event_id) JOIN ver ON ver.domain = rj.domain""")


def keyword_dns(source: str, columns: str = "domain") -> str:
    return f"""SELECT {columns}, CASE WHEN strong OR n >= 1 THEN 'phishing' ELSE 'legitimate' END AS prediction,
 CASE WHEN strong THEN 0.95e0 WHEN n >= 2 THEN 0.85e0 WHEN n = 1 AND urgent THEN 0.82e0 WHEN n = 1 THEN 0.7e0 ELSE 0.95e0 END AS confidence,
 CASE WHEN strong OR n >= 2 OR (n = 1 AND urgent) THEN 'high' WHEN n = 1 THEN 'medium' ELSE 'low' END AS risk_level
 FROM (SELECT *, {any_of('lower(domain)', L.DNS_STRONG_PATTERNS)} AS strong, {count('lower(domain)', L.DNS_INDICATORS)} AS n,
 {any_of('lower(domain)', L.URGENT_WORDS)} AS urgent FROM {source})"""


def keyword_tls(source: str, columns: str = "domain") -> str:
    return f"""SELECT {columns}, CASE WHEN length(domain) < 4 THEN 'legitimate' WHEN strong OR (urgent AND NOT known) THEN 'phishing' ELSE 'legitimate' END AS prediction,
 CASE WHEN length(domain) < 4 THEN 0.85e0 WHEN strong THEN 0.95e0 WHEN urgent AND NOT known THEN 0.75e0 ELSE 0.92e0 END AS confidence,
 CASE WHEN length(domain) < 4 THEN 'low' WHEN strong THEN 'high' WHEN urgent AND NOT known THEN 'medium' ELSE 'low' END AS risk_level
 FROM (SELECT *, {any_of('lower(domain)', L.TLS_PATTERNS)} AS strong, {any_of('lower(domain)', L.URGENT_WORDS)} AS urgent,
 {any_of('lower(domain)', L.TLS_KNOWN_BRANDS)} AS known FROM {source})"""


add("keyword_verdict_dns", "domains", keyword_dns("domains"))
add("keyword_verdict_tls", "domains", keyword_tls("domains"))
add("dns_anomalies", "dns_queries", QUERIES + f"""
SELECT event_id, array_to_string(list_filter([CASE WHEN ttl - 10 > 0 AND ttl - 10 < 60 THEN 'low_ttl' END,
 CASE WHEN contains(query_domain, '.') AND {entropy("split_part(query_domain, '.', 1)")} > 4.5 THEN 'high_entropy' END], lambda x: x IS NOT NULL), '|') AS anomalies FROM q""")
add("tls_anomalies", "tls_handshakes", HANDSHAKES + f"""
SELECT event_id, array_to_string(list_filter([CASE WHEN contains(tls_version, '1.0') THEN 'old_tls' END,
 CASE WHEN {any_of('lower(sni)', L.SNI_SUSPICIOUS)} THEN 'suspicious_sni' END], lambda x: x IS NOT NULL), '|') AS anomalies FROM h""")
add("chrome_time", "browser_urls", """
SELECT id, make_timestamp(last_visit_time - 11644473600000000) AS visited, last_visit_time AS back FROM browser_urls""")

# --- filters and lookups ------------------------------------------------------------------------
add("https_flows", "flow_packets", PACKETS + " SELECT * FROM p WHERE protocol = 'TCP' AND dst_port IN (443, 8443)")


def live(source_views: str = "") -> str:
    """CTE parts: every name seen with its keyword verdict, the lists on top. Names in the views need no cleaning."""
    columns = "event_id, ts, destination_ip, domain, origin"
    return f""", nm AS (SELECT event_id, ts, dst_ip AS destination_ip, query_domain AS domain, 'dns' AS origin FROM dns_queries
 UNION ALL SELECT event_id, ts, dst_ip, sni, 'sni' FROM tls_handshakes WHERE sni IS NOT NULL)
, kw AS (SELECT *, 48 AS features_used FROM ({keyword_dns("(SELECT * FROM nm WHERE origin = 'dns')", columns)}) UNION ALL
 SELECT *, 48 FROM ({keyword_tls("(SELECT * FROM nm WHERE origin = 'sni')", columns)}))
, ov AS (SELECT * EXCLUDE (a, b) REPLACE (CASE WHEN b THEN 'phishing' WHEN a THEN 'legitimate' ELSE prediction END AS prediction,
 CASE WHEN a OR b THEN 1.0::DOUBLE ELSE confidence END AS confidence, CASE WHEN b THEN 'high' WHEN a THEN 'low' ELSE risk_level END AS risk_level,
 CASE WHEN a OR b THEN 0 ELSE features_used END AS features_used) FROM (SELECT *, {listed('domain', L.BLOCK_LIST)} AS b, {listed('domain', L.ALLOW_LIST)} AS a FROM kw))
, lv AS ({decided('ov', 0.8, 0.6)})"""


LIVE_VIEWS = "dns_queries tls_handshakes"
add("phishing_only", LIVE_VIEWS, live() + " SELECT event_id, domain, origin, confidence FROM ov WHERE prediction = 'phishing'")
add("run_summary", LIVE_VIEWS, live() + """ SELECT count(DISTINCT CASE WHEN prediction <> 'phishing' THEN domain END) AS safe_domains,
 count(DISTINCT CASE WHEN prediction = 'phishing' AND NOT blocked THEN domain END) AS detected_phishing,
 count(DISTINCT CASE WHEN blocked THEN domain END) AS blocked_domains FROM lv""")
add("stream_detect", LIVE_VIEWS, live() + " SELECT event_id, origin, domain, action_taken, reason FROM lv")
LIVE_ROWS = QUERIES + HANDSHAKES + """
, named AS (SELECT * FROM h WHERE sni IS NOT NULL)
, lq AS (SELECT n.event_id, q.ts AS asked, q.ttl, q.query_type FROM named n JOIN q ON q.src_ip = n.src_ip AND lower(q.query_domain) = lower(n.sni)
 AND q.ts BETWEEN n.ts - INTERVAL 10 SECONDS AND n.ts QUALIFY row_number() OVER (PARTITION BY n.event_id ORDER BY q.ts DESC, q.event_id DESC) = 1)
, lc AS (SELECT n.*, lower(n.sni) AS domain, lq.asked, lq.ttl, lq.query_type FROM named n LEFT JOIN lq ON lq.event_id = n.event_id)"""
_NAMES = "domain_length subdomain_count domain_entropy has_numbers_in_domain has_hyphens_in_domain has_suspicious_chars is_known_phishing is_known_legitimate".split()
_TLS_NAMES = ("sni_present sni_length sni_entropy sni_matches_domain has_sni_spoofing tls_version tls_version_code is_outdated_tls "
              "uses_standard_https_port handshake_packet_size certificate_subject_length").split()
add("live_connections", LIVE_VIEWS, LIVE_ROWS + f"""
, d1 AS (SELECT *, {DOMAIN_FEATURES} FROM lc)
, d2 AS (SELECT * EXCLUDE (tls_version), {tls_features('domain')} FROM d1)
SELECT event_id, ts, src_ip, dst_ip, domain, {', '.join(f'{n} AS dns_{n}' for n in _NAMES)}, coalesce(ttl, 3600) AS dns_ttl_value, coalesce(query_type, 'A') AS dns_query_type,
 {', '.join(f'{n} AS tls_{n}' for n in _TLS_NAMES)}, round((epoch_us(ts) - epoch_us(asked)) / 1e6, 6) AS session_dns_to_tls_delay, asked IS NULL AS dns_imputed FROM d2""")
add("stream_connections", LIVE_VIEWS, LIVE_ROWS + f"""
, f AS (SELECT *, {listed('domain', L.BLOCK_LIST)} AS b, {listed('domain', L.ALLOW_LIST)} AS a FROM lc)
SELECT event_id, domain, dst_ip AS destination_ip, CASE WHEN a OR b THEN 0 ELSE {{features}} END AS features_used,
 CASE WHEN b THEN 'phishing' WHEN a THEN 'legitimate' END AS listed_as, true AS as_in_batch FROM f""".replace("{features}", "19"))
add("stream_detect_model", LIVE_VIEWS, live() + f"""
, f AS (SELECT *, {listed('domain', L.BLOCK_LIST)} AS b, {listed('domain', L.ALLOW_LIST)} AS a FROM nm)
SELECT event_id, origin, domain, destination_ip, CASE WHEN a OR b THEN 0 ELSE 9 END AS features_used,
 CASE WHEN b THEN 'phishing' WHEN a THEN 'legitimate' END AS listed_as, true AS as_in_batch FROM f""")
add("stream_routed_actions", LIVE_VIEWS, live() + " SELECT action_taken, count(*) AS events, count(DISTINCT domain) AS domains FROM lv GROUP BY 1")
add("stream_new_domains", LIVE_VIEWS, live() + " SELECT DISTINCT domain, 1::BIGINT AS sightings FROM lv WHERE blocked OR prediction <> 'phishing'")
add("blocked_only", "detections", f"SELECT event_id, domain FROM ({decided('detections')}) WHERE blocked")
add("list_suffix_match", "domains", f"""
SELECT domain, {listed('domain', L.BLOCK_LIST)} AS in_block_list, {listed('domain', L.ALLOW_LIST)} AS in_allow_list FROM domains""")


def tabled(source: str, domain: str = "lower(domain)") -> str:
    """CTE part: the rows of ``source`` with flags of the block and the allow table."""
    def hit(table: str) -> str:
        return f"EXISTS (SELECT 1 FROM {table} t WHERE t.host <> '' AND ({domain} = t.host OR ends_with({domain}, '.' || t.host)))"

    return f"SELECT *, {hit('block_table')} AS _b, {hit('allow_table')} AS _a FROM {source}"


add("list_table_match", "nested_domains block_table allow_table", f", f AS ({tabled('nested_domains')}) SELECT domain, _b AS in_block_list, _a AS in_allow_list FROM f")
FEED_MATCH = f""", fh AS ({FEED_HOSTS})
, ud AS (SELECT DISTINCT domain FROM nq), hit AS (SELECT DISTINCT ud.domain FROM ud JOIN fh ON (ud.domain = fh.host OR (ends_with(ud.domain, '.' || fh.host) AND contains(fh.host, '.'))))
SELECT nq.event_id, nq.domain, hit.domain IS NOT NULL AS in_feed FROM nq LEFT JOIN hit ON hit.domain = nq.domain"""
add("feed_parent_match", "dns_queries feed_urls", ", nq AS (SELECT event_id, 'a.b.' || query_domain AS domain FROM dns_queries WHERE qr = 0)" + FEED_MATCH)
add("stream_feed_refresh", "dns_queries feed_urls", ", nq AS (SELECT event_id, query_domain AS domain FROM dns_queries)" + FEED_MATCH)
add("list_override", "detections", WITH_RISK + f"""
, lo AS (SELECT *, {listed('domain', L.BLOCK_LIST)} AS b, {listed('domain', L.ALLOW_LIST)} AS a FROM wr)
SELECT event_id, domain, destination_ip, CASE WHEN b THEN 'phishing' WHEN a THEN 'legitimate' ELSE prediction END AS prediction,
 CASE WHEN a OR b THEN 1.0 ELSE confidence END AS confidence, CASE WHEN b THEN 'high' WHEN a THEN 'low' ELSE risk_level END AS risk_level,
 CASE WHEN a OR b THEN 0 ELSE features_used END AS features_used FROM lo""")
add("list_table_override", "detections block_table allow_table", WITH_RISK + f"""
, dr AS (SELECT * EXCLUDE (ts) REPLACE ('M.' || domain AS domain) FROM wr), fl AS ({tabled('dr')})
, lo AS (SELECT * REPLACE (CASE WHEN _b THEN 'phishing' WHEN _a THEN 'legitimate' ELSE prediction END AS prediction,
 CASE WHEN _a OR _b THEN 1.0::DOUBLE ELSE confidence END AS confidence, CASE WHEN _b THEN 'high' WHEN _a THEN 'low' ELSE risk_level END AS risk_level,
 CASE WHEN _a OR _b THEN 0 ELSE features_used END AS features_used) FROM fl)
, dc AS (SELECT * EXCLUDE (_a, _b), _b AS _tb, _a AS _ta, NULL::VARCHAR AS source FROM ({decided('lo')}))
SELECT * EXCLUDE (_tb, _ta) FROM ({overridden('dc', '_tb', '_ta')})""")
add("logged_event_override", "detections", CLASSIFIED + " SELECT * EXCLUDE (ts) FROM ev")
add("new_domains_only", "detections", f"""
, nd AS (SELECT * REPLACE ('n' || (event_id % 701) || '.' || domain AS domain) FROM detections)
, jd AS (SELECT domain FROM ({decided('nd')}) WHERE hour(ts) < 6 AND (prediction <> 'phishing' OR blocked))
SELECT event_id, domain FROM nd WHERE domain NOT IN (SELECT domain FROM jd)""")
add("dns_first_for_domain", "dns_queries", QUERIES + """
SELECT lower(query_domain) AS domain, * EXCLUDE (query_domain) FROM q QUALIFY row_number() OVER (PARTITION BY lower(query_domain) ORDER BY ts, event_id) = 1""")
add("tls_first_for_ip", "tls_handshakes", HANDSHAKES + """
SELECT * FROM h WHERE dst_port = 443 QUALIFY row_number() OVER (PARTITION BY dst_ip ORDER BY ts, event_id) = 1""")
add("domain_ip_map", "dns_queries", QUERIES + """
, e AS (SELECT query_domain, dst_ip || '-' || (event_id % 90) AS dst_ip, count(*) AS queries FROM q GROUP BY ALL)
SELECT *, count(*) OVER d AS ips_of_domain, count(*) OVER i AS domains_of_ip, (sum(queries) OVER d)::BIGINT AS queries_of_domain,
 (sum(queries) OVER i)::BIGINT AS queries_of_ip FROM e WINDOW d AS (PARTITION BY query_domain), i AS (PARTITION BY dst_ip)""")
SESSION_VIEWS = "dns_queries tls_handshakes"
add("dns_to_tls_delay", SESSION_VIEWS, QUERIES + HANDSHAKES + SESSION + " SELECT event_id, round(dns_to_tls_delay, 6) AS dns_to_tls_delay FROM delay")


NO_HIT = "Not found in PhishTank, OpenPhish, or brand-impersonation heuristic (Safe Browsing key not set)."
NO_HIT_EXTERNAL = "Not found in Google Safe Browsing, PhishTank, OpenPhish, or brand-impersonation heuristic."


def reputation(source: str, not_found: str = NO_HIT) -> str:
    """CTE parts: reputation of the distinct domains of ``source``."""
    return brand(source) + f"""
, sfx AS (SELECT domain, unnest(list_transform(range(1, len(string_split(domain, '.')) + 1), lambda i: array_to_string(string_split(domain, '.')[i:], '.'))) AS s FROM {source})
, fr AS (SELECT sfx.domain, min(f.rank) AS rank FROM sfx JOIN (SELECT host, 1 AS rank FROM feed_one UNION ALL SELECT host, 2 FROM feed_two) f ON f.host = sfx.s
 WHERE sfx.s = sfx.domain OR contains(sfx.s, '.') GROUP BY 1)
, rep AS (SELECT b.domain, {listed('b.domain', L.TRUSTED_ANCHORS)} AS anchor, fr.rank, b.is_phishing, b.points, b.why, x.host IS NOT NULL AS flagged
 FROM brandy b LEFT JOIN fr ON fr.domain = b.domain LEFT JOIN ext x ON x.host = b.domain)
, repu AS (SELECT domain, CASE WHEN anchor THEN 'legitimate' WHEN flagged OR rank IS NOT NULL OR is_phishing THEN 'phishing' ELSE 'unknown' END AS verdict,
 CASE WHEN anchor THEN 'trusted_anchor' WHEN flagged THEN 'google_safe_browsing' WHEN rank = 1 THEN 'phishtank' WHEN rank = 2 THEN 'openphish' WHEN is_phishing THEN 'heuristic' ELSE 'none' END AS source,
 CASE WHEN anchor OR flagged THEN 1.0::DOUBLE WHEN rank = 1 THEN 0.95 WHEN rank = 2 THEN 0.9 WHEN is_phishing THEN least(points, 95) / 100.0::DOUBLE ELSE 0 END AS confidence,
 CASE WHEN anchor THEN domain || ' is on the trusted-anchor allow-list.' WHEN flagged THEN 'Google Safe Browsing flagged this URL as MALWARE.'
 WHEN rank = 1 THEN domain || ' appears in the PhishTank verified phishing feed.' WHEN rank = 2 THEN domain || ' appears in the OpenPhish community feed.'
 WHEN is_phishing THEN 'Brand-impersonation pattern: ' || why ELSE {lit(not_found)} END AS reason,
 CASE WHEN anchor THEN '' WHEN flagged THEN 'MALWARE' WHEN rank IS NOT NULL OR is_phishing THEN 'SOCIAL_ENGINEERING' ELSE '' END AS threat_type FROM rep)"""


add("reputation_check", "domains feed_one feed_two", """
, ext AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages WHERE url LIKE '%.html')"""
    + reputation("domains", NO_HIT_EXTERNAL) + " SELECT * FROM repu")
CASCADE = reputation("asked") + lexical("asked") + f"""
, c AS (SELECT r.*, l.score, l.reasons, {listed('r.domain', L.BLOCK_LIST)} AS b, {listed('r.domain', L.ALLOW_LIST)} AS a FROM repu r JOIN lr l ON l.domain = r.domain)
, vc AS (SELECT domain, CASE WHEN b THEN 'phishing' WHEN a THEN 'legitimate' WHEN verdict <> 'unknown' THEN verdict WHEN score >= 0.55 THEN 'phishing' ELSE 'unknown' END AS verdict,
 CASE WHEN b THEN true WHEN a THEN false WHEN verdict <> 'unknown' THEN verdict = 'phishing' ELSE score >= 0.55 END AS blocked,
 CASE WHEN a OR b THEN 1.0::DOUBLE WHEN verdict <> 'unknown' THEN confidence ELSE score END AS confidence,
 CASE WHEN b THEN 'Domain matches a known phishing pattern — REJECT.' WHEN a THEN 'Domain is recognised as trusted — APPROVE.'
  WHEN verdict <> 'unknown' THEN reason WHEN score >= 0.55 THEN 'Signals: ' || array_to_string(reasons[1:4], '; ')
  ELSE concat_ws(' · ', 'ML model unavailable', CASE WHEN len(reasons) > 0 THEN 'Signals: ' || array_to_string(reasons[1:3], '; ') END) END AS reason,
 CASE WHEN b THEN 'hardcoded_blocklist' WHEN a THEN 'hardcoded_allowlist' WHEN verdict <> 'unknown' THEN source WHEN score >= 0.55 THEN 'heuristic' ELSE 'none' END AS source,
 false AS ml_ran FROM c)"""
NO_EXTERNAL = ", ext AS (SELECT NULL::VARCHAR AS host WHERE false)"
add("verdict_cascade", "lookalikes dns_queries feed_one feed_two", NO_EXTERNAL + f"""
, asked AS (SELECT domain FROM lookalikes UNION SELECT {host_of('url')} FROM pages UNION SELECT query_domain FROM dns_queries)"""
    + CASCADE + " SELECT * FROM vc")
SCORED_CASCADE = reputation("asked") + lexical("asked") + f"""
, c AS (SELECT r.*, l.score, l.reasons, {listed('r.domain', L.BLOCK_LIST)} AS b, {listed('r.domain', L.ALLOW_LIST)} AS a,
 m.prediction AS ml, coalesce(m.confidence, 0) AS mc FROM repu r JOIN lr l ON l.domain = r.domain LEFT JOIN model_scores m ON m.domain = r.domain)
, k AS (SELECT *, b OR a OR verdict <> 'unknown' AS known, printf('%.0f%%', round_even(mc * 100, 0)) AS pct FROM c)
, d AS (SELECT *, NOT known AND ml IS NOT NULL AS ran, NOT known AND coalesce(ml = 'phishing' AND mc >= 0.6, false) AS bm, NOT known AND score >= 0.55 AS bs,
 NOT known AND coalesce(ml = 'legitimate' AND mc >= 0.7 AND score < 0.3, false) AS safe FROM k)
, vc AS (SELECT domain, ran AS ml_ran,
 CASE WHEN b THEN 'phishing' WHEN a THEN 'legitimate' WHEN known THEN verdict WHEN bm OR bs THEN 'phishing' WHEN safe THEN 'legitimate' ELSE 'unknown' END AS verdict,
 CASE WHEN b THEN true WHEN a THEN false WHEN known THEN verdict = 'phishing' ELSE bm OR bs END AS blocked,
 CASE WHEN a OR b THEN 1.0::DOUBLE WHEN known THEN confidence WHEN bm THEN greatest(mc, score) WHEN bs THEN score WHEN safe THEN mc ELSE greatest(mc, score) END AS confidence,
 CASE WHEN b THEN 'Domain matches a known phishing pattern — REJECT.' WHEN a THEN 'Domain is recognised as trusted — APPROVE.' WHEN known THEN reason
  WHEN bm OR bs THEN concat_ws(' · ', CASE WHEN bm THEN 'ML model says PHISHING (' || pct || ' confidence)' END, CASE WHEN len(reasons) > 0 THEN 'Signals: ' || array_to_string(reasons[1:4], '; ') END)
  WHEN safe THEN 'ML model says LEGITIMATE (' || pct || ' confidence) — APPROVE.'
  WHEN ran OR len(reasons) > 0 THEN concat_ws(' · ', CASE WHEN ran THEN 'ML: ' || ml || ' (' || pct || ')' END, CASE WHEN len(reasons) > 0 THEN 'Signals: ' || array_to_string(reasons[1:3], '; ') END)
  ELSE 'Domain not recognised — needs review.' END AS reason,
 CASE WHEN b THEN 'hardcoded_blocklist' WHEN a THEN 'hardcoded_allowlist' WHEN known THEN source WHEN bm THEN 'ml_model' WHEN bs THEN 'heuristic' WHEN safe THEN 'ml_model' ELSE 'none' END AS source FROM d)"""
ASKED_SEEN = ", asked AS (SELECT domain FROM lookalikes UNION SELECT query_domain FROM dns_queries)"
add("verdict_cascade_scored", "lookalikes dns_queries feed_one feed_two model_scores", NO_EXTERNAL + ASKED_SEEN + SCORED_CASCADE
    + " SELECT * REPLACE (round(confidence, 6) AS confidence) FROM vc")
add("connection_model_cascade", "lookalikes dns_queries feed_one feed_two", NO_EXTERNAL + ASKED_SEEN + """
, model_scores AS (SELECT DISTINCT lower(rtrim(query_domain, '.')) AS domain, 'phishing' AS prediction, 1.0 AS confidence FROM dns_queries WHERE qr = 0)""" + SCORED_CASCADE + """
SELECT CASE WHEN ml_ran THEN 'left to the model' WHEN source IN ('hardcoded_blocklist', 'hardcoded_allowlist') THEN 'lists' ELSE 'other' END AS settled_by, count(*) AS hosts
FROM vc GROUP BY 1""")
add("stream_verdicts", "dns_queries tls_handshakes feed_one feed_two", NO_EXTERNAL + """
, asked AS (SELECT query_domain AS domain FROM dns_queries UNION SELECT sni FROM tls_handshakes WHERE sni IS NOT NULL)""" + CASCADE + """
SELECT domain, verdict AS prediction, round(confidence, 6) AS confidence, CASE WHEN blocked THEN 'critical' ELSE 'low' END AS alert_severity,
 CASE WHEN blocked THEN 'block_dns' ELSE 'log_only' END AS action_taken, reason, blocked, source FROM vc WHERE verdict <> 'unknown'""")
add("domain_decisions", "domains", f"""
, ls AS (SELECT domain, {listed('domain', L.BLOCK_LIST)} AS b, {listed('domain', L.ALLOW_LIST)} AS a FROM domains)
, pr AS (SELECT domain, CASE WHEN b THEN 'phishing' ELSE 'legitimate' END AS prediction, CASE WHEN a OR b THEN 1.0::DOUBLE ELSE 0.5e0 END AS confidence FROM ls)
, rk AS (SELECT *, {RISK} AS risk_level FROM pr) {decided('rk')}""")
AGREEMENT = VERIFIED + f"""
, ag AS (SELECT d.domain, {keyword_label('lower(d.domain)')} AS feed_label, CASE WHEN v.is_phishing IS NULL THEN 'unknown' WHEN v.is_phishing THEN 'phishing' ELSE 'legitimate' END AS verifier_label,
 coalesce(v.confidence, 0) AS verifier_confidence FROM cased_domains d LEFT JOIN ver v ON v.domain = d.domain)
, agr AS (SELECT *, feed_label = verifier_label AS match, (verifier_label = 'phishing')::INT AS label FROM ag)"""
add("label_agreement", "cased_domains", AGREEMENT + " SELECT * FROM agr")

# --- aggregations -------------------------------------------------------------------------------
add("domain_query_stats", "dns_queries", QUERIES + """
SELECT lower(query_domain) AS domain, count(*) AS query_frequency, round(coalesce(var_samp(ttl), 0), 4) AS ttl_variance FROM q GROUP BY 1""")
add("prediction_stats", "detections", WITH_RISK + """
SELECT count(*) AS total_predictions, count(*) FILTER (prediction = 'phishing') AS phishing_detected, count(*) FILTER (prediction = 'legitimate') AS legitimate_count,
 round(avg(confidence), 6) AS average_confidence, count(*) FILTER (risk_level = 'high') AS high_risk_count FROM wr WHERE features_used > 0""")
add("decision_stats", "detections", f"""
SELECT count(*) AS total_decisions, count(*) FILTER (blocked) AS phishing_blocked, count(*) FILTER (action_taken = 'alert') AS phishing_alerted,
 round(count(*) FILTER (blocked) / greatest(count(*), 1), 6) AS blocking_rate FROM ({decided('detections')})""")
TOTALS = """SELECT count(*) AS total_events, count(*) FILTER (prediction = 'phishing') AS total_phishing, count(*) FILTER (prediction = 'phishing' AND blocked) AS total_blocked,
 count(*) FILTER (prediction = 'legitimate') AS total_safe"""
add("detection_totals", "detections", CLASSIFIED + TOTALS.replace("SELECT", " SELECT", 1) + """, count(*) FILTER (prediction = 'unknown') AS total_unknown,
 round(100.0 * count(*) FILTER (prediction = 'phishing') / count(*) FILTER (prediction <> 'unknown'), 6) AS detection_rate FROM ev""")
add("stream_detection_totals", "detections", LOGGED + f" {TOTALS} FROM ({overridden('(SELECT DISTINCT * FROM logged)')})")
add("combined_block_totals", "detections block_events", CLASSIFIED + """
, n AS (SELECT (SELECT count(*) FROM ev WHERE prediction = 'phishing' AND blocked) AS e, (SELECT count(*) FROM block_events) AS s)
SELECT e AS engine_blocked, s AS system_blocked, e + s AS total_blocked FROM n""")
add("blocks_by_type", "block_events", BLOCKS + " SELECT block_type, count(*) AS blocks FROM b GROUP BY 1")
add("blocks_by_source_and_type", "block_events", BLOCKS + """
SELECT 'source' AS grouped_by, source AS name, count(*) AS blocks FROM b GROUP BY 2 UNION ALL
SELECT 'type', block_type, count(*) FROM b GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM b""")
add("confidence_histogram", "detections", """
, bins AS (SELECT * FROM (VALUES ('<50%', -1, 0.5), ('50-65%', 0.5, 0.65), ('65-80%', 0.65, 0.8), ('80-90%', 0.8, 0.9), ('90-95%', 0.9, 0.95), ('>95%', 0.95, 2)) t(bin, lo, hi))
SELECT bin, count(d.event_id) AS detections FROM bins LEFT JOIN detections d ON d.prediction = 'phishing' AND d.confidence >= lo::DOUBLE AND d.confidence < hi::DOUBLE GROUP BY 1""")
add("class_distribution", "detections", "SELECT prediction, count(*) AS records, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM detections GROUP BY 1")
add("share_of_total", "domains", f"SELECT {keyword_label()} AS label, count(*) AS records, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM domains GROUP BY 1")
add("match_rate", "cased_domains", AGREEMENT + """
SELECT coalesce(feed_label, 'all') AS feed_label, count(*) AS domains, count(*) FILTER (match) AS matches, round(avg(match::INT), 6) AS rate FROM agr GROUP BY ROLLUP (feed_label)""")
add("verification_accuracy", "domains", VERIFIED + f"""
SELECT count(*) AS domains, count(*) FILTER (is_phishing = ({keyword_label()} = 'phishing')) AS correct,
 round(100.0 * count(*) FILTER (is_phishing = ({keyword_label()} = 'phishing')) / count(*), 6) AS accuracy_percent FROM ver""")
add("packet_counters", "dns_queries tls_handshakes flow_packets", QUERIES + HANDSHAKES + PACKETS + """
, n AS (SELECT (SELECT count(*) FROM q) AS d, (SELECT count(*) FROM h) AS t, (SELECT count(*) FROM p) AS f)
SELECT d + t + f AS packets_captured, d AS dns_packets, t AS tls_packets, f AS flow_packets FROM n""")
add("capture_summary", "dns_queries tls_handshakes http_payloads", QUERIES + HANDSHAKES + """
, seen AS (SELECT 'dns' AS kind, query_domain AS name FROM q UNION ALL SELECT 'sni', sni FROM h WHERE sni IS NOT NULL
 UNION ALL SELECT DISTINCT 'http', split_part(split_part(payload, 'Host: ', 2), chr(13), 1) FROM http_payloads WHERE contains(payload, 'Host: '))
SELECT kind, count(*) AS names, sum(n)::BIGINT AS sightings, max(n) AS most_seen FROM (SELECT kind, name, count(*) AS n FROM seen GROUP BY ALL) GROUP BY 1""")
add("feedback_accuracy", "detections feedback", """
SELECT count(*) AS rated, count(*) FILTER (was_correct) AS correct, round(avg(was_correct::INT), 6) AS accuracy
FROM feedback WHERE event_id IN (SELECT event_id FROM detections)""")
add("handshakes_by_endpoint", "tls_handshakes", HANDSHAKES + """
SELECT dst_ip || ':' || dst_port AS endpoint, count(*) AS handshakes, count(DISTINCT sni) AS server_names, min(ts) AS first_seen, max(ts) AS last_seen FROM h GROUP BY 1""")
add("feed_stats", "feed_urls", f"""
SELECT CASE WHEN starts_with(url, 'http') THEN 'pages' ELSE 'shouted' END AS feed, count(DISTINCT {host_of('url')}) AS hosts, max(entry) AS last_refresh FROM feed_urls GROUP BY 1""")

# --- windows ------------------------------------------------------------------------------------
add("inter_packet_gaps", "flow_packets", PACKETS + """
SELECT event_id, seq, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts, event_id, seq)) / 1e6, 6) AS gap_seconds FROM p""")
add("running_query_stats", "dns_queries", QUERIES + """
SELECT event_id, count(*) OVER w AS query_frequency, round(coalesce(var_samp(ttl) OVER w, 0), 4) AS ttl_variance FROM q
WINDOW w AS (PARTITION BY lower(query_domain) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
add("first_connection_flag", SESSION_VIEWS, QUERIES + HANDSHAKES + SESSION + " SELECT event_id, n = 1 AS is_first_connection_to_domain FROM ordinal")
add("connection_ordinal", SESSION_VIEWS, QUERIES + HANDSHAKES + SESSION + " SELECT event_id, n AS connection_count_to_domain FROM ordinal")
add("concurrent_connections", "tls_handshakes", HANDSHAKES + """
SELECT event_id, count(*) OVER (PARTITION BY array_to_string(string_split(src_ip, '.')[1:3], '.') ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS concurrent_connections FROM h""")
add("last_packet_attrs", "flow_packets", PACKETS + """
SELECT src_ip, dst_ip, arg_max(dst_port, (ts, event_id, seq)) AS destination_port, arg_max(ttl, (ts, event_id, seq)) AS ttl_value FROM p GROUP BY ALL""")
HOURLY = """SELECT date_trunc('hour', ts) AS tick, count(*) FILTER (prediction = 'phishing') AS phishing, count(*) FILTER (prediction = 'legitimate') AS safe FROM detections GROUP BY 1"""
add("stream_traffic_windows", "detections", f", w AS ({HOURLY})" + """
SELECT * FROM w WHERE tick + INTERVAL 1 HOUR <= (SELECT max(ts) FROM detections) - INTERVAL 1 HOUR""")
add("stream_flow_sessions", "flow_packets", PACKETS + f"""
, c AS (SELECT *, ts - lag(ts) OVER (PARTITION BY {FLOW_KEY} ORDER BY ts) >= INTERVAL 30 SECONDS AS cut FROM p)
, s AS (SELECT *, count(*) FILTER (cut) OVER (PARTITION BY {FLOW_KEY} ORDER BY ts) AS sid FROM c)
, g AS (SELECT {FLOW_KEY}, sid, min(ts) AS session_start, max(ts) AS last_ts, count(*) AS total_packets, round(avg(packet_size) + 1e-9, 6) AS packet_size_mean,
 round(coalesce(stddev_samp(packet_size), 0) + 1e-9, 3) AS packet_size_std, min(packet_size) AS packet_size_min, max(packet_size) AS packet_size_max,
 (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS d, max(packet_size) - min(packet_size) AS packet_size_range,
 round(coalesce(avg(gap), 0) + 1e-9, 6) AS inter_packet_timing_mean, round(coalesce(stddev_samp(gap), 0) + 1e-9, 3) AS inter_packet_timing_std,
 round(coalesce(min(gap), 0) + 1e-9, 6) AS inter_packet_timing_min, round(coalesce(max(gap), 0) + 1e-9, 6) AS inter_packet_timing_max,
 dst_port AS destination_port, arg_max(ttl, (ts, event_id, seq)) AS ttl_value
 FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {FLOW_KEY}, sid ORDER BY ts, event_id, seq)) / 1e6 AS gap FROM s) GROUP BY {FLOW_KEY}, sid)
SELECT * EXCLUDE (sid, last_ts, d), round(d + 1e-9, 6) AS flow_duration, CASE WHEN d > 0 THEN round(total_packets / d + 1e-9, 6) ELSE 0 END AS packets_per_second
FROM g WHERE last_ts + INTERVAL 30 SECONDS <= (SELECT max(ts) FROM p) - INTERVAL 1 HOUR""")
add("traffic_deltas", "detections", f", h AS ({HOURLY})" + """
, e AS (SELECT min(tick) AS lo, max(tick) AS hi FROM h), t AS (SELECT unnest(generate_series(greatest(lo, hi - INTERVAL 29 HOUR), hi, INTERVAL 1 HOUR)) AS tick FROM e)
SELECT t.tick, coalesce(phishing, 0) AS phishing, coalesce(safe, 0) AS safe FROM t LEFT JOIN h ON h.tick = t.tick""")

# --- top lists ----------------------------------------------------------------------------------
add("latest_feeds", "detections", CLASSIFIED + """
, f AS (SELECT 'detections' AS feed, * FROM ev WHERE prediction = 'phishing' UNION ALL SELECT 'blocks', * FROM ev WHERE prediction = 'phishing' AND blocked
 UNION ALL SELECT 'safe', * FROM ev WHERE prediction = 'legitimate')
, n AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY ts DESC, event_id DESC) AS position FROM f)
SELECT feed, position::INT AS position, event_id, domain, confidence, source FROM n WHERE position <= 20""")
add("recent_events", "detections", f"SELECT event_id, domain, action_taken FROM ({decided('detections')}) ORDER BY ts DESC, event_id DESC LIMIT 10")
add("recent_blocks", "block_events", BLOCKS + " SELECT event_id, domain, block_type FROM b ORDER BY ts DESC, event_id DESC LIMIT 20")
add("recent_unique_block_domains", "block_events", BLOCKS + """
SELECT domain, block_type, ts, event_id FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) = 1) ORDER BY ts DESC, event_id DESC LIMIT 10""")
add("top_domains", "dns_queries", QUERIES + " SELECT query_domain AS domain, count(*) AS queries FROM q GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
add("top_sni_alphabetical", "tls_handshakes", HANDSHAKES + " SELECT DISTINCT sni FROM h WHERE sni IS NOT NULL ORDER BY 1 LIMIT 10")

# --- sets ---------------------------------------------------------------------------------------
add("dataset_union", "domains", f"""
SELECT domain, {keyword_label()} AS label, NULL AS origin FROM domains UNION ALL SELECT DISTINCT domain, 'phishing', 'generated' FROM lookalikes""")
add("brand_domain_set", "dns_queries", QUERIES + f"""
SELECT DISTINCT query_domain FROM q WHERE query_domain IN {values(L.BrandRules().real_domains)}""")
add("sni_union_dns", "dns_queries tls_handshakes", QUERIES + HANDSHAKES + """
SELECT event_id, lower(query_domain) AS domain, dst_ip, 'dns' AS origin FROM q UNION ALL SELECT event_id, lower(sni), dst_ip, 'sni' FROM h WHERE sni <> ''""")
add("event_dedup", "detections", """
SELECT domain, date_trunc('hour', ts) AS ts, event_id, prediction FROM detections
QUALIFY row_number() OVER (PARTITION BY domain, date_trunc('hour', ts) ORDER BY event_id) = 1""")

# --- models -------------------------------------------------------------------------------------
add("training_matrix", "domains", f"""
SELECT domain, CASE WHEN {keyword_label()} = 'legitimate' THEN 0 ELSE 1 END AS label, length(domain)::DOUBLE AS domain_length,
 greatest(length(domain) - length(replace(domain, '.', '')) - 1, 0)::DOUBLE AS subdomain_count, round({entropy(stripped('domain'))}, 6) AS domain_entropy,
 regexp_matches(domain, '[0-9]')::INT::DOUBLE AS has_numbers_in_domain, contains(domain, '-')::INT::DOUBLE AS has_hyphens_in_domain,
 regexp_matches(domain, '[@#$%&*!~]')::INT::DOUBLE AS has_suspicious_chars, (length(domain) - length(replace(domain, '-', '')))::DOUBLE AS hyphen_count,
 (length(domain) - length(regexp_replace(domain, '[0-9]', '', 'g')))::DOUBLE AS digit_count, length(split_part(domain, '.', 1))::DOUBLE AS label_length,
 round({entropy("split_part(domain, '.', 1)")}, 6) AS label_entropy FROM domains""")
add("label_index", "domains", f"""
SELECT domain, CASE WHEN length(domain) % 4 = 0 THEN 0 WHEN length(domain) % 4 = 1 THEN 1 WHEN {keyword_label()} = 'legitimate' THEN 0 ELSE 1 END AS label FROM domains""")
RANKED = """, k AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id::VARCHAR) NULLS FIRST, doc_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM scored)"""
add("stratified_split", "scored", RANKED + " SELECT doc_id, label, CASE WHEN rn <= floor(n * 0.8 + 0.5) THEN 'train' ELSE 'test' END AS split FROM k")
add("kfold_assign", "scored", RANKED + " SELECT doc_id, label, ((rn - 1) % 5)::INT AS fold FROM k")
MATRIX = """SELECT count(*) FILTER (label = 0 AND score < {t}) AS tn, count(*) FILTER (label = 0 AND score >= {t}) AS fp,
 count(*) FILTER (label = 1 AND score < {t}) AS fn, count(*) FILTER (label = 1 AND score >= {t}) AS tp FROM scored"""
add("confusion_matrix", "scored", MATRIX.format(t="0.5"))
add("binary_metrics", "scored", f""", m AS ({MATRIX.format(t='0.5')})
SELECT *, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
 round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
 round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS false_positive_rate, round(coalesce(fn / nullif(fn + tp, 0), 0), 6) AS false_negative_rate FROM m""")
add("roc_auc", "scored", """
, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scored WHERE score IS NOT NULL AND label IS NOT NULL)
, s AS (SELECT sum(rk) FILTER (label = 1) AS rs, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM r)
SELECT round((rs - p * (p + 1) / 2.0) / (p * n), 6) AS roc_auc FROM s""")
add("roc_curve", "scored", """
, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY 1)
SELECT round(score, 6) AS threshold, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr FROM g
WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
add("model_ranking", "scored", ", m AS (" + " UNION ALL ".join(
    f"SELECT {i} AS ordinal, 'cut-{t}' AS model, * FROM ({MATRIX.format(t=t)})" for i, t in enumerate((0.25, 0.5, 0.75))) + """)
SELECT ordinal, model, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM m ORDER BY f1 DESC, ordinal LIMIT 1""")
TRAINING = f""", t AS (SELECT domain, CASE WHEN {keyword_label('lower(domain)')} = 'legitimate' THEN 0 ELSE 1 END AS label FROM domains)
, k AS (SELECT domain, label, row_number() OVER (PARTITION BY label ORDER BY md5(domain), domain) AS rn, count(*) OVER (PARTITION BY label) AS n FROM t)
, s AS (SELECT *, rn > floor(n * 0.8 + 0.5) AS held FROM k)"""
HELD = "count(*) AS tested, count(*) FILTER (label = 1) AS positives, true AS beats_majority FROM s WHERE held"
for _model in ("train_random_forest", "train_gbt", "train_mlp"):
    add(_model, "domains", TRAINING + f" SELECT {HELD}")
add("select_model", "domains", TRAINING + f" SELECT 0 AS ordinal, 'RandomForest' AS model, {HELD} UNION ALL SELECT 1, 'NeuralNetwork', {HELD}")
add("cross_validate", "domains", " SELECT true AS accuracy_in_range, true AS f1_in_range, true AS roc_auc_in_range")
add("score_batch", "domains", f"""
SELECT domain, CASE WHEN {listed('domain', L.BLOCK_LIST)} THEN 'phishing' WHEN {listed('domain', L.ALLOW_LIST)} THEN 'legitimate' END AS listed_as, true AS has_verdict FROM domains""")
add("feature_importance", "domains", " SELECT 9 AS features, 1e0 AS total, true AS all_positive")
add("model_metadata_sink", "domains", TRAINING + """
SELECT 'RandomForest' AS model_type, 9 AS num_features, count(*) AS num_samples, count(*) FILTER (NOT held) AS num_train, count(*) FILTER (held) AS num_test, true AS measured FROM s""")
