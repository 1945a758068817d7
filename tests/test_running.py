"""Sliced windows against plain Python, with one key holding most rows and slices small enough to be crossed often."""

import datetime
import random
import statistics

import pytest

from threatspark.operators import features, running

START = datetime.datetime(2024, 1, 1)
ROWS = 20  # more rows of a key are cut
KEYS = ("a", "b", None, "hot")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(400):
        key = "hot" if rng.random() < 0.6 else rng.choice(KEYS[:3])
        out.append((i, key, START + datetime.timedelta(seconds=rng.randrange(0, 900), milliseconds=rng.choice([0, 0, 250])), rng.randrange(0, 600)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, key string, ts timestamp, v int")


def ordered(rows, key):
    return sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))


def by_id(df, column):
    return {r["id"]: r[column] for r in df.select("id", column).collect()}


def test_row_number(frame, rows):
    df = running.row_number(frame, ["key"], ["ts", "id"], "rn", ROWS)
    got = by_id(df, "rn")
    for key in KEYS:
        seq = ordered(rows, key)
        assert [got[r[0]] for r in seq] == list(range(1, len(seq) + 1))


def test_running_variance(frame, rows):
    df = running.running_count_variance(frame, ["key"], ["ts", "id"], "v", "n", "var", ROWS)
    count, variance = by_id(df, "n"), by_id(df, "var")
    for key in KEYS:
        seq = ordered(rows, key)
        for i, r in enumerate(seq, 1):
            seen = [x[3] for x in seq[:i]]
            assert count[r[0]] == i
            assert variance[r[0]] == pytest.approx(statistics.variance(seen) if i > 1 else 0.0, abs=1e-6)


def test_gaps(frame, rows):
    got = by_id(running.seconds_since_previous(frame, ["key"], ["ts", "id"], "gap", ROWS), "gap")
    for key in KEYS:
        seq = ordered(rows, key)
        assert got[seq[0][0]] is None
        for last, r in zip(seq, seq[1:], strict=False):
            assert got[r[0]] == pytest.approx((r[2] - last[2]).total_seconds())


@pytest.mark.parametrize("seconds", [5, 20, 300])
def test_count_in_last_seconds(frame, rows, seconds):
    got = by_id(running.count_in_last_seconds(frame, ["key"], "ts", seconds, "n", ROWS), "n")
    for r in rows:
        near = [x for x in rows if x[1] == r[1] and 0 <= (r[2] - x[2]).total_seconds() <= seconds]
        assert got[r[0]] == len(near)


def test_latest_before(spark, frame, rows):
    right = [r for r in rows if r[3] % 5 == 0]
    seen = spark.createDataFrame([(r[1], r[2]) for r in right], "key string, ts timestamp")
    got = by_id(running.latest_before(frame, seen, ["key"], "ts", "asked", ROWS), "asked")
    for r in rows:
        earlier = [x[2] for x in right if r[1] is not None and x[1] == r[1] and x[2] <= r[2]]
        assert got[r[0]] == (max(earlier) if earlier else None)


def test_flow_stats_of_the_documented_flow(spark):
    rows = [(i, 0, START + datetime.timedelta(milliseconds=10 * i), "c", "s", 1, 443, "TCP", 66 if i == 0 else 1460, 64) for i in range(5)]
    schema = "event_id int, seq int, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, packet_size int, ttl int"
    r = features.flow_stats(spark.createDataFrame(rows, schema)).first()
    assert (r.total_packets, r.packet_size_min, r.packet_size_max, r.packet_size_range) == (5, 66, 1460, 1394)
    assert r.inter_packet_timing_mean == pytest.approx(0.01)
    assert r.packets_per_second == pytest.approx(125)


def plain_flow(packets):
    """Statistics of one flow of (ts, id, seq, size, port, ttl)."""
    seq = sorted(packets, key=lambda p: (p[0] is not None, p[0] or START, p[1], p[2]))
    times = [p[0] for p in seq if p[0] is not None]
    gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:], strict=False)]
    size = [p[3] for p in seq]
    spread = (times[-1] - times[0]).total_seconds() if times else None
    deviation = lambda x: statistics.stdev(x) if len(x) > 1 else 0.0
    return (statistics.mean(size), deviation(size), min(size), max(size), statistics.mean(gaps) if gaps else 0.0, deviation(gaps), min(gaps, default=0.0),
            max(gaps, default=0.0), len(seq), spread, len(seq) / spread if spread else 0.0, seq[-1][4], seq[-1][5])


def test_flow_stats_against_plain_loops(spark):
    """Flows over hours, with repeated times, packets without a time, and everything at one time."""
    rng = random.Random(11)
    rows = []
    for k in range(6):
        for i in range(80):
            at = START + datetime.timedelta(seconds=rng.choice([0, 0, 1, 59, 3599, 3600, 90_000]) * (k != 5), microseconds=rng.choice([0, 0, 7]) * (k != 5))
            rows.append((i, i % 2, None if k == 4 and i % 9 == 0 else at, f"c{k}", rng.randrange(60, 1500), rng.choice([443, 80]), rng.randrange(64)))
    rows += [(1, 0, None, "untimed", 60, 443, 1), (2, 0, None, "untimed", 70, 443, 2)]
    frame = spark.createDataFrame(rows, "event_id int, seq int, ts timestamp, src_ip string, packet_size int, dst_port int, ttl int").repartition(4)
    got = {r.src_ip: r for r in features.flow_stats(frame, ["src_ip"]).collect()}
    assert len(got) == 7
    for key, r in got.items():
        want = plain_flow([(x[2], x[0], x[1], x[4], x[5], x[6]) for x in rows if x[3] == key])
        have = (r.packet_size_mean, r.packet_size_std, r.packet_size_min, r.packet_size_max, r.inter_packet_timing_mean, r.inter_packet_timing_std,
                r.inter_packet_timing_min, r.inter_packet_timing_max, r.total_packets, r.flow_duration, r.packets_per_second, r.destination_port, r.ttl_value)
        assert (have[9] is None) == (want[9] is None)
        assert [x or 0 for x in have] == pytest.approx([x or 0 for x in want], rel=1e-9)


def test_flow_stats_sort_no_packets(spark, frame):
    packets = frame.selectExpr("id AS event_id", "0 AS seq", "ts", "key AS dst_ip", "v AS packet_size", "443 AS dst_port", "64 AS ttl")
    assert "Window" not in features.flow_stats(packets, ["dst_ip"])._jdf.queryExecution().executedPlan().toString()


def test_single_packet_flow(spark):
    schema = "event_id int, seq int, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, packet_size int, ttl int"
    r = features.flow_stats(spark.createDataFrame([(1, 0, START, "c", "s", 1, 443, "TCP", 60, 64)], schema)).first()
    assert (r.packet_size_std, r.inter_packet_timing_mean, r.flow_duration, r.packets_per_second) == (0.0, 0.0, 0.0, 0.0)


def sizes(df, rows):
    """Rows of each slice."""
    order = ["ts", "id"]
    position = running.time_position(df, order)
    slices = running.RowSlices(df, ["key"], position, rows, ties=running.finer(df, order))
    return [r["count"] for r in slices.pack(df, ["key"], position).groupBy(running.KEYS, running.SLICE).count().collect()]


@pytest.mark.parametrize("kind", ["one wrong clock", "a burst", "no times", "one second", "even", "one time", "three times"])
def test_slices_hold_at_most_twice_the_target(spark, kind):
    n, rng = 600, random.Random(1)
    at = {
        "one wrong clock": lambda i: datetime.datetime(1970, 1, 1) if i == 0 else START + datetime.timedelta(seconds=i),
        "a burst": lambda i: START + datetime.timedelta(seconds=i if i < 10 else 3600 * 24 * 300, microseconds=rng.randrange(10**6)),
        "no times": lambda i: None,
        "one second": lambda i: START + datetime.timedelta(microseconds=rng.randrange(10**6)),
        "even": lambda i: START + datetime.timedelta(seconds=i % 50, milliseconds=i),
        "one time": lambda i: START,
        "three times": lambda i: START + datetime.timedelta(seconds=i % 3),
    }[kind]
    # ids are far apart, as rows without a time are placed by them
    rows = [(i * 3_000_000, "hot", at(i), i) for i in range(n)] + [(-1 - i, "b", START, i) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp, v int")
    assert max(sizes(df, 40)) <= 80 and len(sizes(df, 40)) > 8
    order = ["ts", "id"]
    if kind in ("even", "a burst", "one second"):
        return  # the results of the others hold every way of cutting
    pairs = [
        (by_id(running.row_number(df, ["key"], order, "x", 40), "x"), by_id(running.row_number(df, ["key"], order, "x"), "x")),
        (by_id(running.seconds_since_previous(df, ["key"], order, "x", 40), "x"), by_id(running.seconds_since_previous(df, ["key"], order, "x"), "x")),
        (by_id(running.count_in_last_seconds(df, ["key"], "ts", 9, "x", 40), "x"), by_id(running.count_in_last_seconds(df, ["key"], "ts", 9, "x"), "x")),
        (by_id(running.latest_before(df, df.filter("v % 3 = 0"), ["key"], "ts", "x", 40), "x"), by_id(running.latest_before(df, df.filter("v % 3 = 0"), ["key"], "ts", "x"), "x")),
    ]
    for cut, plain in pairs:
        assert cut == plain


def test_a_crowd_at_one_time_is_cut(spark):
    rows = spark.range(50_000).selectExpr("cast(id AS string) AS id", "'hot' AS key", "timestamp'2024-01-01' AS ts", "cast(id % 7 AS int) AS v")
    assert max(sizes(rows, 1000)) <= 2000 and len(sizes(rows, 1000)) >= 25
    for cut, plain in (
        (running.row_number(rows, ["key"], ["ts", "id"], "x", 1000), running.row_number(rows, ["key"], ["ts", "id"], "x")),
        (running.running_count_variance(rows, ["key"], ["ts", "id"], "v", "x", "y", 1000), running.running_count_variance(rows, ["key"], ["ts", "id"], "v", "x", "y")),
    ):
        a, b = ({r.id: (r.x, round(r.y, 6) if "y" in f.columns else 0) for r in f.collect()} for f in (cut, plain))
        assert a == b
    assert running.count_in_last_seconds(rows, ["key"], "ts", 60, "x", 1000).filter("x <> 50000").count() == 0
    assert running.seconds_since_previous(rows, ["key"], ["ts", "id"], "x", 1000).filter("x = 0").count() == 49_999


def test_rows_equal_in_all_columns_stay_together(spark):
    rows = spark.range(300).selectExpr("1 AS id", "'hot' AS key", "timestamp'2024-01-01' AS ts", "1 AS v")
    got = running.row_number(rows, ["key"], ["ts", "id"], "x", 40).collect()
    assert sorted(r.x for r in got) == list(range(1, 301))


def test_a_known_bound_saves_the_count(spark, frame, monkeypatch):
    monkeypatch.setattr(running, "settled", None)  # nothing is counted or written
    assert running.row_number(frame, ["key"], ["ts", "id"], "x", 500, at_most=400).count() == 400
    assert running.count_in_last_seconds(frame, ["key"], "ts", 5, "x", 500, at_most=400).count() == 400


def test_concurrency_plan_is_small(spark, frame):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = running.count_in_last_seconds(frame, ["key"], "ts", 20, "n", ROWS)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") <= 6


def test_variance_of_large_values(spark):
    rows = [(i, "a", START + datetime.timedelta(seconds=i), 1e9 + (i * 7) % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp, v double")
    for target in (None, 15):
        got = by_id(running.running_count_variance(df, ["key"], ["ts", "id"], "v", "n", "var", target), "var")
        for i in (1, 50, 199):
            assert got[i] == pytest.approx(statistics.variance([r[3] for r in rows[: i + 1]]), rel=1e-6)


def test_rows_without_a_time_or_a_key_are_kept(spark, frame):
    odd = spark.createDataFrame([(1000, "hot", None, 1), (1001, None, None, 2), (1002, "a", None, 3)], frame.schema)
    df = frame.unionByName(odd)
    ids = sorted(r.id for r in df.select("id").collect())
    seen = frame.select("key", "ts")
    for rows in (None, ROWS):
        ranked = running.row_number(df, ["key"], ["ts", "id"], "rn", rows)
        assert sorted(r.id for r in ranked.collect()) == ids
        assert by_id(ranked, "rn")[1000] == 1
        for out in (
            running.seconds_since_previous(df, ["key"], ["ts", "id"], "x", rows),
            running.count_in_last_seconds(df, ["key"], "ts", 5, "x", rows),
            running.latest_before(df, seen, ["key"], "ts", "x", rows),
            running.running_count_variance(df, ["key"], ["ts", "id"], "v", "x", "y", rows),
        ):
            assert sorted(r.id for r in out.collect()) == ids
            assert out.columns[:4] == df.columns
