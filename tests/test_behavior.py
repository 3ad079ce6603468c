"""Detectors, correlation and suppression on pinned and edge cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from packetloom.functions.alerts import behavior_alert_rows
from packetloom.operators import behavior, correlate

BASE = datetime(2024, 1, 1)


def at(seconds):
    return BASE + timedelta(seconds=seconds)


def auth(spark, times, success=()):
    rows = [(i, at(t), "1.1.1.1", "2.2.2.2", t in success, "ssh") for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "packet_no bigint, ts timestamp, src_ip string, dst_ip string, success boolean, auth_type string")


def test_brute_force_threshold_and_repeats(spark):
    fired = behavior.brute_force(auth(spark, [0, 10, 20]), 300, 2)
    assert sorted(r["packet_no"] for r in fired.collect()) == [1, 2]
    alerts = behavior.as_alerts(fired, "brute_force")
    assert [r["packet_no"] for r in behavior.first_of_topic(alerts, 300).collect()] == [1]
    row = behavior_alert_rows(alerts).orderBy("ts").first()
    assert row["match_rule"] == "behavior:brute_force" and row["priority"] == 1 and row["dst_ip"] == "2.2.2.2"
    assert row["payload_preview"].startswith("Brute force: 2 failed attempts | {")


@pytest.mark.parametrize("last,count", [(300, 1), (301, 0)])
def test_window_edge_is_inside(spark, last, count):
    assert behavior.brute_force(auth(spark, [0, last]), 300, 2).count() == count


def test_success_does_not_count_or_reset(spark):
    fired = behavior.brute_force(auth(spark, [0, 1, 2, 3], success={1}), 300, 3)
    assert [r["packet_no"] for r in fired.collect()] == [3]


def packets(spark, rows):
    return spark.createDataFrame(
        [(i, at(t), s, d, p, "TCP", n) for i, (t, s, d, p, n) in enumerate(rows)],
        "packet_no bigint, ts timestamp, src_ip string, dst_ip string, dst_port int, proto string, size int",
    )


@pytest.mark.parametrize("ports,found", [(4, 0), (5, 1), (6, 1)])
def test_port_scan_thresholds(spark, ports, found):
    rows = [(i * 2, "a", "t", 100 + i, 0) for i in range(ports)]
    got = behavior.port_scan(packets(spark, rows), window=300, threshold=5, min_ports=5, min_targets=9, cooldown=180)
    assert got.count() == found


def test_port_scan_ignores_repeats_within_a_second(spark):
    rows = [(i * 0.1, "a", "t", 100, 0) for i in range(30)]
    probes = behavior.accepted_probes(packets(spark, rows))
    assert sorted(r["packet_no"] for r in probes.collect()) == [0, 10, 20]


def test_high_rate_needs_spread(spark):
    one = [(i, "a", "t", 80, 0) for i in range(30)]
    assert behavior.high_connection_rate(packets(spark, one), 60, 10, cooldown=120).count() == 0
    two = one + [(5, "a", "u", 80, 0)]
    rows = behavior.high_connection_rate(packets(spark, two), 60, 10, cooldown=120).collect()
    assert [(r["connections"], r["unique_targets"], r["target_port"]) for r in rows] == [(12, 2, 80)]


def test_spike_baselines(spark):
    rows = [(s + i / 100, "a", "t", 80, 10) for s in range(40) for i in range(1 if s < 35 else 20)]
    df = packets(spark, rows)
    prior = behavior.traffic_spike(df, F.col("size"), warmup=30, sustain=2, cooldown=30).collect()
    assert [(r["ts"], r["severity"]) for r in prior] == []  # the average follows after one sample
    prior = behavior.traffic_spike(df, F.col("size"), warmup=30, sustain=1, cooldown=30).collect()
    assert [(r["ts"], r["severity"]) for r in prior] == [(at(35), "high")]
    faithful = behavior.traffic_spike(df, F.col("size"), warmup=30, sustain=1, baseline="inclusive", cooldown=30)
    assert faithful.count() == 0
    lower = behavior.traffic_spike(df, F.col("size"), warmup=30, sustain=1, factor=3, baseline="inclusive", cooldown=30)
    assert [r["ts"] for r in lower.collect()] == [at(35)]


def test_session_restarts_after_idle(spark):
    rows = [(0, "a", "t", 80, 5), (3600, "a", "t", 80, 5), (7201, "a", "t", 80, 5)]
    got = behavior.session_totals(packets(spark, rows), F.col("size")).orderBy("packet_no").collect()
    assert [(r["packets"], r["bytes"], r["duration"]) for r in got] == [(1, 5, 0.0), (2, 10, 3600.0), (1, 5, 0.0)]


def test_topic_suppression_window(spark):
    rules = spark.createDataFrame([(at(0), "a", "t", "nmap_x"), (at(0), "a", "u", "other")], "ts timestamp, src_ip string, dst_ip string, rule_id string")
    rows = [(1, at(300), "port_scan", "t"), (2, at(301), "port_scan", "t"), (3, at(10), "brute_force", "t"), (4, at(10), "port_scan", "u"), (5, at(10), "port_scan", None)]
    alerts = spark.createDataFrame([(n, ts, k, "a", d) for n, ts, k, d in rows], "packet_no bigint, ts timestamp, alert_type string, src_ip string, dst_ip string")
    got = behavior.topic_suppressed(alerts, rules, 300)
    assert {r["packet_no"] for r in got.filter("suppressed").collect()} == {1}


def alerts(spark, rows):
    return spark.createDataFrame([(at(t), "1.1.1.1", r, b) for t, r, b in rows], "ts timestamp, src_ip string, rule_id string, is_behavior boolean")


def test_scoring_with_weights(spark):
    marks = correlate.score_attackers(
        alerts(spark, [(0, "r1", False), (1, "r2", False), (2, "port_scan", True)]), 60, 2, 3, 2
    ).collect()
    assert [(r["total"], r["diversity"], r["severity"]) for r in marks] == [(4, 2, "medium")]


def test_marks_expire_after_two_windows(spark):
    marks = correlate.score_attackers(alerts(spark, [(0, "r", False)]), 10, 1, 1, 1)
    assert correlate.current_attackers(marks, at(20), 10).count() == 1
    assert correlate.current_attackers(marks, at(25), 10).count() == 0


def test_attacker_alert_cooldown(spark):
    marks = spark.createDataFrame([(at(5), "a", "high"), (at(400), "a", "medium")], "ts timestamp, src_ip string, severity string")
    got = correlate.attacker_alerts(marks, 600, 60, 300, until=at(720)).orderBy("ts").collect()
    assert [(r["ts"], r["severity"]) for r in got] == [(at(60), "high"), (at(360), "high"), (at(660), "medium")]


def test_login_results(spark):
    schema = "packet_no bigint, ts timestamp, client_ip string, client_port int, server_ip string, server_port int, status_code int"
    flow = ("c", 1, "s", 80)
    tries = spark.createDataFrame([(1, at(0), *flow, None), (2, at(9), *flow, None)], schema)
    answers = spark.createDataFrame(
        [(3, at(10), *flow, 302), (4, at(19), *flow, 403), (5, at(20), *flow, 200), (6, at(12), *flow, 500)], schema
    )
    got = behavior.login_results(tries, answers, 10).orderBy("packet_no").collect()
    assert [(r["packet_no"], r["success"], r["attempt_ts"]) for r in got] == [(3, True, at(9)), (4, False, at(9))]
