"""Literal rows with the result each rule must give."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from threatspark import lexicon as L
from threatspark.functions import hosts, lexical, policy
from threatspark.operators import features, matching, reports, scoring, verdicts
from threatspark.plans import detection


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_block_types(spark):
    rows = [
        ("firewall", "Connection refused - firewall blocked outbound connection", "firewall"),
        ("ssl_error", "SSL certificate verification failed - self-signed certificate", "ssl_error"),
        ("connection_timeout", "Connection timeout after 30s - server unreachable", "connection_timeout"),
        ("dns_failure", "DNS resolution failed - domain not resolving", "dns_failure"),
        ("connection_reset", "Connection reset by peer - server terminated connection", "connection_reset"),
        ("firewall", "Hosts file null-routes kubernetes.docker.internal -> 127.0.0.1", "unknown"),
        ("x", "file moved to quarantine", "antivirus"),
    ]
    got = reports.with_block_type(spark.createDataFrame(rows, "error_type string, error_message string, want string"))
    assert got.filter("block_type <> want").count() == 0


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("h2# apple-login.com3iMm2bkk F6", "apple-login.com3iMm2bkk"),
        ("hhttp/1.1\n#google-signin.com\né", ""),
        ("h2c#paypal-verify.com::::::::", "paypal-verify.com"),
        ("  amazon-account.com  ", "amazon-account.com"),
        ("1.2.3.4", ""),
        ("a.b", ""),
        ("x" * 64 + ".com", ""),
        ("x" * 63 + ".com", "x" * 63 + ".com"),
        ("Mail.Example.COM", "Mail.Example.COM"),
        (None, ""),
        ("a..b.com", ""),
        ("evil_host.com", "evilhost.com"),
        ("h2o.com", "o.com"),
        ("-a-.com-", "a-.com"),
        ("xy.ch2.org tail", "xy.c"),
    ],
)
def test_clean_sni(spark, raw, clean):
    assert values(spark, [(raw,)], "sni string", hosts.clean_sni(F.col("sni"))) == [clean]


@pytest.mark.parametrize(
    ("raw", "host"),
    [
        ("https://Example.com:8443/a?b", "example.com"), ("example.com/x", "example.com"), ("  h.org  ", "h.org"),
        ("http://a.b://c", "a.b"), ("x/y://z.com/q", "z.com"), ("", ""), ("h:80", "h"), ("://h.com", "h.com"),
    ],
)
def test_host_of(spark, raw, host):
    assert values(spark, [(raw,)], "u string", hosts.host_of(F.col("u"))) == [host]


@pytest.mark.parametrize(
    ("raw", "host"),
    [
        ("http://user:pw@Shop.example.com:81/x", "shop.example.com"), ("http://10.0.0.1/", ""), ("172.20.1.1", ""),
        ("172.40.1.1", "172.40.1.1"), ("printer.local", ""), ("localhost:3000", ""), ("http://[::1]:80/", ""),
        ("bad_host.com", ""), ("https://a.com?x=http://b.com", "a.com"), ("169.254.1.1", ""), (".a.com.", "a.com"),
        (None, ""), ("172.x.1.1", "172.x.1.1"), ("0.0.0.0", ""), ("not a scheme://a.com", ""),
    ],
)
def test_external_host(spark, raw, host):
    assert values(spark, [(raw,)], "u string", hosts.external_host(F.col("u"))) == [host]


def test_list_override(spark):
    bad = ["apple-login.com", "paypal-verify.com", "amazon-account.com", "google-signin.com", "microsoft-update.com", "A.Apple-Login.com"]
    good = ["google.com", "github.com", "amazon.com", "mail.google.com"]
    other = ["notgoogle.com", "google.com.evil.org", "com"]
    rows = [(d, "unknown", 0.3, "medium", 48) for d in bad + good + other]
    frame = spark.createDataFrame(rows, "domain string, prediction string, confidence double, risk_level string, features_used int")
    got = {r.domain: r for r in verdicts.list_override(frame).collect()}
    assert all(tuple(got[d])[1:] == ("phishing", 1.0, "high", 0) for d in bad)
    assert all(tuple(got[d])[1:] == ("legitimate", 1.0, "low", 0) for d in good)
    assert all(tuple(got[d])[1:] == ("unknown", 0.3, "medium", 48) for d in other)


def test_in_list_handles_entries_of_any_depth(spark):
    rows = [("a.b.c.d",), ("b.c.d",), ("c.d",), ("x.b.c.d",), ("xb.c.d",), (None,), ("zip",), ("a.zip",)]
    got = values(spark, rows, "h string", hosts.in_list(F.col("h"), ("b.c.d", "zip")))
    assert got == [True, True, False, True, False, False, True, True]


def test_keyword_verdict_tls(spark):
    want = {
        "verify-paypal.com": ("phishing", 0.95), "confirm-amazon.com": ("phishing", 0.95), "update-apple.com": ("phishing", 0.95),
        "paypal-verify.com": ("phishing", 0.95), "github.com": ("legitimate", 0.92), "google.com": ("legitimate", 0.92),
        "amazon.com": ("legitimate", 0.92), "verify-now.org": ("phishing", 0.75), "verify.github.com": ("legitimate", 0.92),
        "x.y": ("legitimate", 0.85),
    }
    frame = spark.createDataFrame([(d,) for d in want], "domain string")
    got = {r.domain: (r.prediction, r.confidence) for r in scoring.keyword_verdict(frame, "domain", F.lit(False)).collect()}
    assert got == want


def test_decisions(spark):
    rows = [("google.com", "legitimate", 0.95), ("paypal-verify.com", "phishing", 0.99), ("suspicious-site.net", "phishing", 0.72), ("w.com", "phishing", 0.1)]
    frame = spark.createDataFrame(rows, "domain string, prediction string, confidence double")
    got = [(r.alert_severity, r.action_taken, r.blocked, r.reason) for r in verdicts.decide(frame).collect()]
    assert got == [
        ("low", "log_only", False, "Legitimate domain"),
        ("critical", "block_dns", True, "High confidence phishing (99.00%)"),
        ("high", "alert", False, "Phishing detected (72.00%)"),
        ("medium", "alert", False, "Possible phishing (10.00%)"),
    ]
    live = verdicts.decide(frame.limit(1).select("domain", F.lit("phishing").alias("prediction"), F.lit(0.92).alias("confidence")), policy.LIVE_POLICY)
    assert live.first().action_taken == "block_dns"


def test_decision_switches(spark):
    frame = spark.createDataFrame([("phishing", 0.9), ("legitimate", 0.2)], "prediction string, confidence double")
    quiet = policy.DecisionPolicy(block_high_confidence=False, alert_phishing=False, alert_suspicious_legitimate=True)
    got = [(r.action_taken, r.reason) for r in verdicts.decide(frame, quiet).collect()]
    assert got == [("log_only", "Phishing detected but no action configured"), ("alert", "Legitimate but suspicious (20.00%)")]


def test_fallback_verify(spark):
    good = ["google.com", "github.com", "amazon.com"]
    bad = ["paypal-verify.com", "apple-login-security.com", "microsoft-account-verify.com"]
    got = values(spark, [(d,) for d in good + bad], "domain string", lexical.fallback_verify("domain")["is_phishing"])
    assert got == [False] * 3 + [True] * 3


def test_typosquats(spark):
    rows = [("facbok.com",), ("gogle.com",), ("amazonn.com",), ("google.com",), ("appl.com",), ("gmial.com",), ("paypa1.com",)]
    got = {r.domain: (r.brand, r.distance) for r in scoring.typosquat_match(spark.createDataFrame(rows, "domain string"), "domain").collect()}
    assert got == {"facbok.com": ("facebook", 2), "gogle.com": ("google", 1), "amazonn.com": ("amazon", 1), "paypa1.com": ("paypal", 1)}


def test_typosquats_against_brute_force(spark):
    from threatspark.lexicon import BRANDS

    labels = [b[:i] + c + b[i + d:] for b in BRANDS for i in range(0, len(b), 2) for c in ("", "x", "zz") for d in (0, 1, 2)]
    rows = [(x,) for x in sorted(set(labels))]
    con = duckdb.connect()
    pairs = con.execute("SELECT a, b, levenshtein(a, b) FROM (SELECT unnest(?) AS a), (SELECT unnest(?) AS b)", [sorted(set(labels)), list(BRANDS)])
    distance = {(a, b): d for a, b, d in pairs.fetchall()}
    got = {r.domain: (r.distance, r.brand) for r in scoring.typosquat_match(spark.createDataFrame(rows, "domain string"), "domain").collect()}
    for (label,) in rows:
        near = [
            (distance[label, b], b) for b in BRANDS
            if len(label) >= 4 and len(b) >= 6 and label != b and abs(len(label) - len(b)) <= 2
        ]
        near = [(d, b) for d, b in near if 1 <= d <= (1 if len(b) <= 6 else 2)]
        assert got.get(label) == (min(near) if near else None), label


def test_digit_swaps(spark):
    rows = [("paypa1",), ("app1e",), ("g00gle",), ("paypal",), ("12345",)]
    tokens = spark.createDataFrame(rows, "label string").coalesce(1).select(lexical.mixed_token(F.col("label")).alias("token"))
    assert [r[0] for r in tokens.select(lexical.digit_swap_brand("token")).collect()] == ["paypal", "apple", "google", None, None]


def test_entropy(spark):
    rows = [("aaaa",), ("abcd",), ("",), (None,), ("aabb",), ("a.b-a.b",)]
    assert values(spark, rows, "t string", lexical.entropy(F.col("t")))[:5] == [0.0, 2.0, 0.0, 0.0, 1.0]
    assert values(spark, rows, "t string", lexical.entropy_stripped(F.col("t")))[5] == 1.0


def test_entropy_of_same_characters_in_any_order(spark):
    """The same characters give the same number to the last bit, however long the text, and no step per kind of character is planned."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefg-12é😀") for _ in range(n)) for n in (9, 17, 31, 63, 200) for _ in range(8)]
    pairs = [(t, "".join(rng.sample(t, len(t)))) for t in texts] + [("x" * 100_000, "x" * 100_000), ("a\nb\na", "\naab\n")]
    rows = spark.createDataFrame(pairs, "t string, other string").select("t", lexical.entropy(F.col("t")).alias("e"), lexical.entropy(F.col("other")).alias("o"))
    for row in rows.collect():
        shares = [k / len(row.t) for k in Counter(row.t).values()]
        assert row.e == row.o and row.e == pytest.approx(-sum(p * math.log2(p) for p in shares), abs=1e-12)
    assert "array_distinct" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_lexical_score_of_a_loaded_name(spark):
    frame = spark.createDataFrame([("g00gle-signin.top",), ("google.com",)], "domain string")
    got = {r.domain: r.risk for r in scoring.lexical_risk(frame, "domain", "risk").collect()}
    assert got["google.com"].score == 0.0 and got["google.com"].reasons == []
    assert got["g00gle-signin.top"].score == 1.0
    assert any("digit swap" in reason for reason in got["g00gle-signin.top"].reasons)


def test_verdict_cascade_with_a_model(spark):
    names = ["paypal-verify.com", "github.com", "listed.example", "sub.listed.example", "plain.org", "sure.org", "doubt.org", "netflix.com"]
    hosts_df = spark.createDataFrame([(n,) for n in names], "domain string")
    feeds = [spark.createDataFrame([("listed.example",)], "host string"), spark.createDataFrame([("other.example",)], "host string")]
    scores = spark.createDataFrame(
        [("plain.org", "phishing", 0.9), ("sure.org", "legitimate", 0.8), ("doubt.org", "legitimate", 0.6)],
        "domain string, prediction string, confidence double",
    )
    rows = {r.domain: r for r in verdicts.verdict_cascade(hosts_df, "domain", feeds, scores).collect()}
    assert {d: (r.verdict, r.source, r.confidence, r.ml_ran) for d, r in rows.items()} == {
        "paypal-verify.com": ("phishing", "hardcoded_blocklist", 1.0, False),
        "github.com": ("legitimate", "hardcoded_allowlist", 1.0, False),
        "listed.example": ("phishing", "phishtank", 0.95, False),
        "sub.listed.example": ("phishing", "phishtank", 0.95, False),
        "plain.org": ("phishing", "ml_model", 0.9, True),
        "sure.org": ("legitimate", "ml_model", 0.8, True),
        "doubt.org": ("unknown", "none", 0.6, True),
        "netflix.com": ("legitimate", "trusted_anchor", 1.0, False),
    }
    assert rows["plain.org"].reason == "ML model says PHISHING (90% confidence)"
    assert rows["doubt.org"].reason == "ML: legitimate (60%)"


def test_feed_match_ignores_bare_tld(spark):
    rows = spark.createDataFrame([("a.b.com",), ("b.com",), ("c.com",), ("com",)], "domain string")
    feed = spark.createDataFrame([("b.com",), ("com",)], "host string")
    got = {r.domain: r.in_feed for r in matching.feed_parent_match(rows, "domain", feed).collect()}
    assert got == {"a.b.com": True, "b.com": True, "c.com": False, "com": True}


def test_detect_is_independent_of_row_order(spark, sf_dir):
    from registry.views import Views

    v = Views(spark, sf_dir)
    events = detection.domain_events(v.dns_queries, v.tls_handshakes)
    plain = detection.detect(events)
    shuffled = detection.detect(events.orderBy(F.xxhash64("event_id")).repartition(3))
    assert plain.exceptAll(shuffled).count() == 0 and shuffled.exceptAll(plain).count() == 0


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('x {"is_phishing": true, "confidence": 0.9, "reasoning": "r"} y', (True, 0.9, "r")),
        ('{"is_phishing": "false"}', (False, 0.5, "Verified by Gemini")),
        ('{"confidence": "n/a"} this is safe', (False, 0.7, '{"confidence": "n/a"} this is safe')),
        ("{broken malicious}", (True, 0.7, "{broken malicious}")),
        ("nothing to read", (True, 0.86, "Fallback heuristic (Gemini unavailable)")),
    ],
)
def test_verifier_replies(spark, reply, want):
    got = values(spark, [("paypal-verify1.com", reply)], "domain string, reply string", lexical.verify_reply("domain", F.col("reply")))
    assert tuple(got[0]) == want


def test_settled_verdicts_become_log_events(spark):
    rows = [("a.com", "phishing", True, 0.9, "r", "heuristic"), ("b.com", "legitimate", False, 1.0, "r", "trusted_anchor"), ("c.com", "unknown", False, 0.1, "r", "none")]
    frame = spark.createDataFrame(rows, "domain string, verdict string, blocked boolean, confidence double, reason string, source string")
    got = {r.domain: (r.prediction, r.risk_level, r.alert_severity, r.action_taken) for r in verdicts.loggable(frame, F.current_timestamp()).collect()}
    assert got == {"a.com": ("phishing", "high", "critical", "block_dns"), "b.com": ("legitimate", "low", "low", "log_only")}


# --- lists and words as tables --------------------------------------------------------------------
NAMES = (
    "google.com", "mail.Google.com", "paypal-verify.com", "x.paypal-verify.com.", "com", "", None, "amazonn.com", "gogle.com", "paypa1.com", "mcdonalds.com",
    "login.amazon-account.com", "secure-paypal-login.com", "faceboook.net", "micros0ft.org", "mcdonald's.com", "mcdonaldss.com", "a" * 200 + ".com", "xpaypal.top",
    "verify-apple-id-update.xyz", "github.com", "notgithub.com", "sub.sub.github.com",
)


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(n,) for n in NAMES], "domain string")


def rows_of(frame):
    return sorted(map(repr, frame.collect()))


def as_tables(spark, lists):
    return matching.ListTables(*[spark.createDataFrame([(h.upper(),) for h in hosts], "host string") for hosts in (lists.block, lists.allow)])


def test_list_tables_match_as_literals_do(spark, names):
    lists = L.HostLists()
    assert rows_of(matching.list_suffix_match(names, "domain", as_tables(spark, lists))) == rows_of(matching.list_suffix_match(names, "domain", lists))
    judged = names.selectExpr("domain", "'legitimate' AS prediction", "0.7D AS confidence", "48 AS features_used", "'low' AS risk_level")
    for override in (verdicts.list_override, lambda p, t: verdicts.logged_event_override(verdicts.decide(p), t)):
        a, b = override(judged, as_tables(spark, lists)), override(judged, lists)
        assert rows_of(a.select(*b.columns)) == rows_of(b)


def test_a_list_of_a_million_rows(spark, names):
    lists = L.HostLists()
    long = spark.range(1_000_000).selectExpr("concat('h', cast(id AS string), '.example.net') AS host")
    tables = as_tables(spark, lists)
    tables = matching.ListTables(tables.block.unionByName(long), tables.allow)
    more = names.unionByName(spark.createDataFrame([("deep.h77.example.net",), ("h1000000.example.net",)], "domain string"))
    got = {r.domain: r.in_block_list for r in matching.list_suffix_match(more, "domain", tables).collect()}
    assert got["deep.h77.example.net"] and not got["h1000000.example.net"]
    assert {n: got[n] for n in NAMES} == {r.domain: r.in_block_list for r in matching.list_suffix_match(names, "domain", lists).collect()}


def test_empty_list_tables(spark, names):
    none = spark.createDataFrame([], "host string")
    assert matching.list_suffix_match(names, "domain", matching.ListTables(none, none)).filter("in_block_list OR in_allow_list").count() == 0


def test_brands_with_an_apostrophe(spark, names):
    brands = ("mcdonald's", "o'reilly", "paypal")
    got = {r.domain: (r.distance, r.brand) for r in scoring.typosquat_match(names.na.drop(), "domain", brands).collect()}
    assert got["mcdonalds.com"] == (1, "mcdonald's") and got["paypa1.com"] == (1, "paypal")
    rules = L.BrandRules(brands=brands)
    assert scoring.brand_heuristic(names, "domain", "b", rules).filter("b.reason LIKE '%mcdonald''s%'").count() > 0
    assert scoring.typosquat_match(names.na.drop(), "domain", ("paypal",)).count() == 2
    swapped = names.na.drop().withColumn("t", F.lit("0reilly")).select(lexical.digit_swap_brand("t", L.ScoreRules(brands=("oreilly", "o'x"))).alias("b"))
    assert {r.b for r in swapped.collect()} == {"oreilly"}


def test_brand_tables_match_as_literals_do(spark, names):
    brands = (*L.BRANDS, "mcdonald's", "toolongabrandforanylabel")
    table = spark.createDataFrame([(b,) for b in brands], "brand string")
    some = names.na.drop().unionByName(spark.createDataFrame([(b[:k] + c + b[k + j:] + ".com",) for b in brands for k in (0, 2, len(b) - 1) for j in (0, 1, 2) for c in ("", "x", "xy")], "domain string")).distinct()
    a, b = scoring.typosquat_match(some, "domain", table), scoring.typosquat_match(some, "domain", brands)
    assert b.count() > 100 and rows_of(a.select(*b.columns)) == rows_of(b)


def test_many_brands_take_no_theta_join(spark, names):
    table = spark.range(100_000).selectExpr("concat('brand', cast(id AS string)) AS brand")
    frame = scoring.typosquat_match(names.na.drop(), "domain", table)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    one = spark.createDataFrame([("brand1x234.com",), ("brandx99999.com",), ("brand.com",)], "domain string")
    got = {r.domain: (r.distance, r.brand) for r in scoring.typosquat_match(one, "domain", table).collect()}
    assert got == {"brand1x234.com": (1, "brand10234"), "brandx99999.com": (1, "brand99999"), "brand.com": (1, "brand0")}


def test_word_tables_score_as_literals_do(spark, names):
    rules = L.BrandRules()
    words = spark.createDataFrame([(w, "brand") for w in rules.brands] + [(w, "token") for w in rules.tokens], "word string, kind string")
    a, b = (scoring.brand_heuristic(names, "domain", "b", words=w) for w in (words, None))
    assert rows_of(a) == rows_of(b)
    score = L.ScoreRules()
    words = spark.createDataFrame([(w, "brand") for w in score.brands] + [(w, "token") for w in score.tokens], "word string, kind string")
    a, b = (scoring.lexical_risk(names, "domain", "s", words=w) for w in (words, None))
    assert rows_of(a) == rows_of(b)


def test_words_are_found_wherever_they_stand(spark):
    hosts = spark.createDataFrame([("abcabcd",), ("xabc",), ("zz",), ("",)], "h string")
    words = spark.createDataFrame([("abc", "a"), ("bcabcd", "a"), ("z", "b"), ("abcdx", "a"), ("", "a"), ("abc", "a")], "word string, kind string")
    got = {r.h: dict(r._held) for r in scoring.words_in(hosts, "h", words).collect()}
    assert got == {"abcabcd": {"a": ["abc", "bcabcd"]}, "xabc": {"a": ["abc"]}, "zz": {"b": ["z"]}}


def test_words_that_begin_alike_do_not_meet_every_host(spark):
    """Hosts meet the words that they hold, not all that share a beginning."""
    words = spark.range(3000).selectExpr("concat('paypal', cast(id AS string)) AS word", "'brand' AS kind")
    hosts = spark.range(3000).selectExpr("concat('x.paypal', cast(id AS string), '.com') AS h")
    found = scoring.words_in(hosts, "h", words)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("Join [word#" in line for line in plan.splitlines())
    got = {r.h: r._held["brand"] for r in found.collect()}
    assert got["x.paypal1234.com"] == ["paypal1", "paypal12", "paypal123", "paypal1234"] and len(got) == 3000


def test_two_edits_are_tried_only_where_one_is_not_enough(spark, monkeypatch):
    written = {}

    def kept(df, name):
        written[name] = df
        return df

    monkeypatch.setattr(scoring, "settled", kept)
    brands = spark.range(2000).selectExpr("concat('paypal', cast(1000 + id AS string)) AS brand")
    labels = spark.createDataFrame([("paypalx1234",), ("paypal12345",), ("paypalxy1234",), ("paypal1234",), ("paypal",)], "l string")
    got = {r.l: tuple(r._s_typo) for r in scoring.near_brands(labels, "l", brands).collect()}
    assert got == {"paypalx1234": (1, "paypal1234"), "paypal12345": (1, "paypal1234"), "paypalxy1234": (2, "paypal1234"), "paypal1234": (1, "paypal1034")}
    assert {r._l for r in written["label-texts"].select("_l").distinct().collect()} == {"paypalxy1234", "paypal"}


def test_many_exploded_brand_texts_are_not_broadcast(spark, monkeypatch):
    """Spark sizes them as before the explode, so each join is told how many rows it meets."""
    plans, settled = {}, scoring.settled

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return settled(df, name)

    monkeypatch.setattr(scoring, "settled", kept)
    labels = spark.range(20_000).selectExpr("concat('verify', cast(id AS string)) AS domain")
    for n, broadcast in ((10_000, False), (100, True)):
        brands = spark.range(n).selectExpr("concat('paypal', cast(10000 + id AS string)) AS brand")
        found = scoring.typosquat_match(labels, "domain", brands)
        assert found.count() == 0
        for name in ("one-edit", "two-edits"):
            assert ("BroadcastHashJoin [_h#" in plans[name]) == broadcast and ("SortMergeJoin [_h#" in plans[name]) != broadcast
        assert "BuildRight" in plans["label-texts"] and "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_hosts_are_not_broadcast(spark):
    hosts = spark.range(2000).selectExpr("concat('x.paypal', cast(id AS string), '.com') AS h")
    words = spark.range(20_000).selectExpr("concat(cast(1000 + id AS string), 'word') AS word", "'brand' AS kind").unionByName(
        spark.createDataFrame([("paypal", "brand"), ("199", "token")], "word string, kind string"))

    def plan_and_held():
        found = scoring.words_in(hosts, "h", words)
        return found._jdf.queryExecution().executedPlan().toString(), {r.h: dict(r._held) for r in found.collect()}

    try:
        plan, held = plan_and_held()
        assert re.search(r"BroadcastHashJoin \[_g#\d+\], \[_g#\d+\], Inner, BuildRight", plan) and "BuildLeft" not in plan
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
        plan, again = plan_and_held()
        assert "SortMergeJoin [_g#" in plan and "SortMergeJoin [word#" in plan and "Broadcast" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert held == again and len(held) == 2000
    assert held["x.paypal1990.com"] == {"brand": ["paypal"], "token": ["199"]} and held["x.paypal7.com"] == {"brand": ["paypal"]}


def test_one_wrong_clock_does_not_stretch_the_ticks(spark):
    rows = spark.createDataFrame([("1970-01-01 00:00:00", "phishing"), ("2026-01-01 00:00:01", "legitimate"), ("2026-01-01 00:00:03", "phishing"), (None, "phishing")], "t string, prediction string")
    got = reports.traffic_deltas(rows.select(F.col("t").cast("timestamp").alias("ts"), "prediction"), "1 second", 5).orderBy("tick").collect()
    assert [(r.phishing, r.safe) for r in got] == [(0, 0), (0, 0), (0, 1), (0, 0), (1, 0)]


def test_defaults_of_a_connection_that_was_not_seen(spark):
    packet = "event_id int, seq int, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, packet_size int, ttl int"
    handshake = "event_id int, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, sni string, tls_version string, packet_size int"
    query = "event_id int, ts timestamp, src_ip string, dst_ip string, query_domain string, query_type string, ttl int, packet_size int"
    requests = spark.createDataFrame([("a.com", "1.1.1.1", "evil.net"), ("A.com", "1.1.1.2", "a.COM"), ("b_x.com", "1.1.1.3", None)], "domain string, destination_ip string, sni string")
    rows = features.connection_features(*[spark.createDataFrame([], s) for s in (query, handshake, packet)], requests=requests).collect()
    got = {r.destination_ip: r for r in rows}
    assert [got[f"1.1.1.{k}"].tls_sni_matches_domain for k in (1, 2, 3)] == [False, True, True]
    assert {(r.tls_has_sni_spoofing, r.tls_tls_version_code, r.dns_is_known_legitimate) for r in rows} == {(False, 3, False)}
    assert [got[f"1.1.1.{k}"].dns_has_suspicious_chars for k in (1, 3)] == [False, True]
    assert got["1.1.1.1"].tls_sni_entropy == pytest.approx(2.75) and got["1.1.1.1"].tls_sni_length == 8
