"""Files with bad lines, both log layouts, feeds, payload edge cases and folders."""

import json
import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from threatspark import lexicon as L
from threatspark import session
from threatspark.model.training import label_index
from threatspark.sources import browser, capture, logs, sinks


def event(domain, ts, **more):
    base = {
        "domain": domain, "destination_ip": "1.2.3.4", "prediction": "legitimate", "confidence": 0.95, "risk_level": "low",
        "features_used": 48, "timestamp": ts, "alert_severity": "low", "action_taken": "log_only", "reason": "r", "blocked": False,
    }
    return json.dumps({**base, **more})


def test_flat_detection_logs(spark, tmp_path):
    for day in range(1, 8):
        lines = [event(f"d{day}.com", day), event(f"d{day}.com", day), "{not json", "", event("same.com", 99.5), json.dumps({"domain": "x"})]
        (tmp_path / f"detections_2026010{day}.jsonl").write_text("\n".join(lines))
    (tmp_path / "system_blocks_20260101.jsonl").write_text(event("other.com", 1))
    for days, first in ((None, 1), (5, 3)):
        got = sorted((r.domain, r.timestamp) for r in logs.detection_log_scan(spark, str(tmp_path), days).collect())
        assert got == [(f"d{d}.com", float(d)) for d in range(first, 8)] + [("same.com", 99.5)]


def test_both_log_layouts_are_read_and_the_newest_line_wins(spark, tmp_path):
    (tmp_path / "detections_20260101.jsonl").write_text("\n".join([event("a.com", 1), event("b.com", 2, reason="old"), event("b.com", 2, reason="older")]))
    (tmp_path / "dt=2026-01-02").mkdir()
    (tmp_path / "dt=2026-01-02" / "part-0.json").write_text("\n".join([event("b.com", 2, reason="new"), event("c.com", 3)]))
    rows = {r.domain: r.reason for r in logs.detection_log_scan(spark, str(tmp_path)).collect()}
    assert rows == {"a.com": "r", "b.com": "new", "c.com": "r"}
    assert {r.domain for r in logs.detection_log_scan(spark, str(tmp_path), 1).collect()} == {"b.com", "c.com"}
    assert logs.detection_log_scan(spark, str(tmp_path / "nothing")).count() == 0


def test_nothing_is_capped(spark):
    words = " ".join(f"w{k}" for k in range(1500))
    lines = spark.createDataFrame([(k, f"127.0.0.1 h{k}.com # {L.BLOCK_MARKER} {words}") for k in range(60)], "line_no long, line string")
    entries = logs.blocklist_text_scan(lines).collect()
    assert len(entries) == 60 and all(r.timestamp.endswith("w1499") for r in entries)
    assert [r.line_no for r in logs.blocklist_text_scan(lines, 2).collect()] == [59, 58]
    visits = [(k, "chrome", f"chrome-error://x/#https://h{k}.com/" if k % 2 else f"chrome-error://x/#https://10.0.0.{k % 250}/", 10**16 + k) for k in range(900)]
    urls = spark.createDataFrame(visits, "id long, browser string, url string, last_visit_time long")
    assert browser.navigation_blocks(urls).count() == 450
    assert sorted(r.id for r in browser.navigation_blocks(urls, 3).collect()) == [895, 897, 899]
    reloads = [(k, "chrome", f"https://{'one' if k > 300 else f'h{k}'}.com/", 10**16 + k) for k in range(600)]
    seen = spark.createDataFrame(reloads, "id long, browser string, url string, last_visit_time long")
    assert browser.recent_domains(seen).count() == 302
    assert [r.domain for r in browser.recent_domains(seen, limit=2).collect()] == ["one.com", "h300.com"]
    feed = spark.createDataFrame([(k, f"https://h{k}.com/") for k in range(300)], "entry long, url string")
    assert logs.feed_domains_netloc(feed).count() == 300 and logs.feed_domains_netloc(feed, limit=7).count() == 7


def test_server_names(spark):
    def hello(name, before=b"\xff" * 37):
        return b"\x16\x03\x01\x00\xff\x01" + before + b"\x00\x00" + bytes([0, len(name) + 5, 0, len(name) + 3, 0, 0, len(name)]) + name + b"\xff" * 4

    def brute(payload):
        if len(payload) < 6 or payload[5] != 1:
            return None
        for p in range(43, len(payload) - 9):
            size = payload[p + 7] * 256 + payload[p + 8]
            if payload[p : p + 2] == b"\x00\x00" and p + 9 + size <= len(payload):
                return payload[p + 9 : p + 9 + size].decode("utf-8", "ignore")
        return None

    rng = random.Random(4)
    payloads = [hello(b"a.com"), hello("é.com".encode()), hello(b"b.org", b"\x00\x00\xff\xff" * 12), b"\x16", b"", hello(b"x") [:50]]
    payloads += [b"\x16\x03\x01\x00\xff\x01" + bytes(rng.choice([0, 0, 0, 1, 255, 65]) for _ in range(rng.randint(0, 200))) for _ in range(200)]
    frame = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(payloads)], "k long, p binary")
    got = {r.k: r.n for r in frame.select("k", capture.hello_server_name(F.col("p")).alias("n")).collect()}
    assert got == {k: brute(p) for k, p in enumerate(payloads)}


def test_zeros_take_linear_time(spark):
    sizes = [64_000, 1_000_000]
    rows = [(n, bytearray(b"\x16\x03\x01\x00\xff\x01" + b"\xff" * 37 + b"\x00" * n)) for n in sizes]
    rows += [(n + 1, bytearray(b"\x16\x03\x01\x00\xff\x01" + b"\xff" * 37 + b"\x00\x00\x00\xff" * (n // 4))) for n in sizes]
    frame = spark.createDataFrame(rows, "n long, p binary").repartition(1)
    frame.select(capture.hello_server_name(F.col("p"))).collect()
    start = time.perf_counter()
    frame.select(capture.hello_server_name(F.col("p"))).collect()
    assert time.perf_counter() - start < 4  # four payloads, up to 1 MB

def test_day_folders_open_only_the_newest(spark, tmp_path):
    rows = [(f"d{d}.com", "phishing", 0.9, True, f"2026-01-0{d} 10:00:00") for d in range(1, 8)]
    frame = spark.createDataFrame(rows, "domain string, prediction string, confidence double, blocked boolean, t string")
    frame = frame.select("domain", "prediction", "confidence", "blocked", F.lit(None).cast("string").alias("destination_ip"), F.col("t").cast("timestamp").alias("ts"))
    sinks.detection_log_sink(frame, str(tmp_path))
    scanned = logs.detection_log_scan(spark, str(tmp_path), days=2)
    assert sorted(r.domain for r in scanned.collect()) == ["d6.com", "d7.com"]
    assert {f.split("/dt=")[1][:10] for f in scanned.inputFiles()} == {"2026-01-06", "2026-01-07"}
    assert {r.destination_ip for r in scanned.collect()} == {"0.0.0.0"}


def test_feeds(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"url": "http://A.com/x", "id": 1}, {"url": None}, {"url": "b.com"}]))
    (tmp_path / "b.txt").write_text("https://C.org:99/\n\n  http://a.com/y  \nbare.com\n")
    (tmp_path / "snap.json").write_text(json.dumps(["x.com", "y.com", "x.com"]))
    assert [r.host for r in logs.feed_hosts(logs.read_json_feed(spark, str(tmp_path / "a.json"))).collect()] == ["a.com"]
    assert sorted(r.host for r in logs.feed_hosts(logs.read_text_feed(spark, str(tmp_path / "b.txt"))).collect()) == ["a.com", "c.org"]
    assert sorted(r.host for r in logs.feed_snapshot_scan(spark, str(tmp_path / "snap.json")).collect()) == ["x.com", "y.com"]


def test_snapshots_are_read_in_splits(spark, tmp_path):
    hosts = [f"h{k}.example.com" for k in range(5000)]
    (tmp_path / "a.json").write_text(json.dumps(hosts, indent=1))
    (tmp_path / "b.json").write_text('  [ "x.com" ,\n "y\\u002ecom","h1.example.com", null ]\n')
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = logs.feed_snapshot_scan(spark, str(tmp_path))
        assert sorted(r.host for r in got.collect()) == sorted([*hosts, "x.com", "y.com"])
        assert spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for bad in ('["a,b.com"]', "[1]", '{"a": 2}', '["a.com" "b.com"]'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(Exception, match="no host of a snapshot"):
            logs.feed_snapshot_scan(spark, str(tmp_path / "bad.json")).collect()


def test_blocklist_round_trip(spark, tmp_path):
    path = tmp_path / "hosts.txt"
    path.write_text("127.0.0.1 localhost\n127.0.0.1 a.com # PHISHING-DETECTOR-BLOCKED\n127.0.0.1 ba.com # PHISHING-DETECTOR-BLOCKED 2026 x\n")
    lines = logs.read_text_lines(spark, str(path))
    assert [(r.domain, r.timestamp) for r in logs.blocklist_text_scan(lines, 5).collect()] == [
        ("ba.com", "PHISHING-DETECTOR-BLOCKED 2026 x"), ("a.com", "PHISHING-DETECTOR-BLOCKED"),
    ]
    blocked = spark.createDataFrame([("a.com",), ("new.com",), ("new.com",)], "domain string")
    new = sinks.blocklist_publish(blocked, lines)
    assert [r.line for r in new.collect()] == ["127.0.0.1 new.com # PHISHING-DETECTOR-BLOCKED"]
    sinks.write_lines(new, str(tmp_path / "out"))
    assert logs.blocklist_entries(logs.read_text_lines(spark, str(tmp_path / "out"))).first().domain == "new.com"
    left = sinks.blocklist_remove(lines, blocked)
    assert sorted(r.line for r in left.collect()) == ["127.0.0.1 ba.com # PHISHING-DETECTOR-BLOCKED 2026 x", "127.0.0.1 localhost"]
    assert [r.line for r in sinks.blocklist_clear(lines).collect()] == ["127.0.0.1 localhost"]


def hello(name, filler=37, extra=b"\xff" * 4, kind=1):
    raw = name.encode()
    head = bytes([0x16, 3, 1, 0, 0xFF, kind]) + b"\xff" * filler
    return head + b"\x00\x00" + (len(raw) + 5).to_bytes(2, "big") + (len(raw) + 3).to_bytes(2, "big") + b"\x00" + len(raw).to_bytes(2, "big") + raw + extra


def expected_name(data):
    """Plain search: every pair of zero bytes from 43 on whose announced name fits into the rest."""
    if data[5:6] != b"\x01":
        return None
    names = []
    for start in (i for i in range(43, len(data) - 9) if data[i:i + 2] == bytes(2)):
        rest, size = data[start + 9:], data[start + 7] * 256 + data[start + 8]
        names += [rest[:size].decode("utf-8", "ignore")] if size <= len(rest) else []
    return names[0] if names else None


def test_server_names(spark):
    import random

    rng = random.Random(3)
    payloads = [hello("a.example.com"), hello("b.org", filler=60), hello("c.org", kind=2), b"", b"\x16", hello("d.org")[:50], hello("e.org", extra=b"")]
    payloads += [bytes(rng.choice([0, 0, 0, 1, 2, 65, 66]) for _ in range(5)) + b"\x01" + bytes(rng.choice([0, 0, 1, 3, 65, 66]) for _ in range(rng.randrange(30, 90))) for _ in range(200)]
    frame = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "i int, payload binary")
    got = {r.i: r.sni for r in frame.select("i", capture.hello_server_name(F.col("payload")).alias("sni")).collect()}
    assert got == {i: expected_name(p) for i, p in enumerate(payloads)}


def fake_session(shared, master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: shared), sparkContext=SimpleNamespace(master=master))


def test_work_folder_is_the_shared_one():
    assert session.work_folder(fake_session("/shared/", "yarn"), "x").startswith("/shared/threatspark/x-")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            session.work_folder(fake_session(None, master), "x")
    assert "/threatspark/x-" in session.work_folder(fake_session(None, "local[2]"), "x")  # one machine: its own folder


def test_work_is_cleared(spark, monkeypatch):
    import os

    monkeypatch.setattr(session, "_made", [])
    frame = session.settled(spark.range(5), "cleared")
    folder = session._made[0].removeprefix("file:")
    assert frame.count() == 5 and os.path.isdir(folder)
    session.clear_work(spark)
    assert not os.path.exists(folder) and session._made == []


def test_csv_tables_with_labels_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.csv").write_text("domain,label,n,flag,x\na.com,phishing,1,true,1.5\nb.com,legitimate,2,false,\n")
    (tmp_path / "b.csv").write_text("domain,n,label,y\nc.com,3000000000,1,\nd.com,4,0,\na.com,9,0,\n")
    got = logs.training_csv_scan(spark, str(tmp_path), "n")
    assert dict(got.dtypes) == {"domain": "string", "label": "string", "n": "bigint", "flag": "boolean", "x": "double", "y": "string"}
    assert {r.domain: r.label for r in got.collect()} == {"a.com": "phishing", "b.com": "legitimate", "c.com": "1", "d.com": "0"}
    assert {r.domain: r.i for r in got.select("domain", label_index(F.col("label")).alias("i")).collect()} == {"a.com": 1, "b.com": 0, "c.com": 1, "d.com": 0}
