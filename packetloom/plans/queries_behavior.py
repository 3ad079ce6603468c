"""Behaviour, correlation and suppression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.operators import behavior, correlate, stats
from packetloom.operators.alert_stream import dedupe_alerts, dedupe_modes
from packetloom.operators.materialize import materialize
from packetloom.operators.windows import running, silence
from packetloom.plans.registry import query
from packetloom.plans.sql_tables import ALERTS, AUTH, CONNECTIONS, IP, PACKETS, K, silenced
from packetloom.sources import adapters as t

HOUR, DAY = 3600, 86400


# --------------------------------------------------------------------------- detectors

_SCAN_COUNTS = """probes AS (SELECT src_ip, dst_ip, dst_port, ts, min(packet_no) AS packet_no FROM conns GROUP BY ALL),
    counted AS (SELECT src_ip, ts, packet_no,
        count(*) OVER w AS events, count(DISTINCT dst_port) OVER w AS unique_ports, count(DISTINCT dst_ip) OVER w AS unique_targets
      FROM probes WINDOW w AS (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)),
    ticks AS (SELECT src_ip, ts, min(packet_no) AS packet_no, any_value(events) AS events,
        any_value(unique_ports) AS unique_ports, any_value(unique_targets) AS unique_targets FROM counted GROUP BY 1, 2),
    fired AS (SELECT * FROM ticks WHERE events >= 9 AND (unique_ports >= 11 OR unique_targets >= 10))"""


@query(
    "b1_high_rate",
    f"""WITH RECURSIVE {CONNECTIONS},
    counted AS (SELECT *,
        count(*) OVER w AS connections, count(DISTINCT dst_port) OVER w AS unique_ports,
        count(DISTINCT dst_ip) OVER (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 1000 DAY PRECEDING AND CURRENT ROW)
          AS unique_targets
      FROM conns WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY ts RANGE BETWEEN INTERVAL 1000 DAY PRECEDING AND CURRENT ROW)),
    fired AS (SELECT src_ip, dst_ip, ts, min(packet_no) AS packet_no, any_value(connections) AS connections,
        any_value(unique_ports) AS unique_ports, any_value(unique_targets) AS unique_targets FROM counted GROUP BY 1, 2, 3
      HAVING any_value(connections) >= 9 AND (any_value(unique_targets) >= 2 OR any_value(unique_ports) >= 40)),
    {silenced('fired', 'src_ip', 200 * DAY, False, 'packet_no')}
    SELECT ts, packet_no, src_ip, dst_ip, connections, unique_targets, unique_ports FROM emitted""",
)
def _(spark, sf):
    found = behavior.high_connection_rate(
        t.connections(spark, sf), window=1000 * DAY, max_connections=8, burst=1.125, cooldown=200 * DAY
    )
    return found.drop("proto", "target_port")


@query(
    "b2_port_scan",
    f"""WITH RECURSIVE {CONNECTIONS}, {_SCAN_COUNTS}, {silenced('fired', 'src_ip', 90 * DAY, False)}
      SELECT ts, packet_no, src_ip, events, unique_ports, unique_targets FROM emitted""",
)
def _(spark, sf):
    return behavior.port_scan(
        t.connections(spark, sf), window=30 * DAY, threshold=9, min_ports=11, min_targets=10, cooldown=90 * DAY
    )


@query(
    "b3_probe_dedupe",
    f"""WITH RECURSIVE {PACKETS}, tcp AS (SELECT packet_no, ts, src_ip, split_part(dst_ip, '.', 3) AS net FROM packets WHERE proto = 'TCP'),
      {silenced('tcp', 'src_ip, net', 2 * DAY, False)}
      SELECT packet_no, src_ip, net, ts FROM emitted""",
)
def _(spark, sf):
    tcp = t.packets(spark, sf).filter("proto = 'TCP'").selectExpr(
        "packet_no", "ts", "src_ip", "split_part(dst_ip, '.', 3) as net"
    )
    return silence(tcp, ["src_ip", "net"], "ts", 2 * DAY, False, ["packet_no"])


@query(
    "b3_accepted_probes",
    f"""WITH {CONNECTIONS} SELECT min(packet_no) AS packet_no, ts, src_ip, dst_ip, dst_port FROM conns GROUP BY 2, 3, 4, 5""",
)
def _(spark, sf):
    return behavior.accepted_probes(t.connections(spark, sf)).drop("proto")


@query(
    "b4_brute_force",
    f"""WITH {AUTH}, counted AS (SELECT *, count(*) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts
        RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW) AS failures FROM auth WHERE NOT success)
      SELECT ts, packet_no, src_ip, dst_ip, failures FROM counted WHERE failures >= 4""",
)
def _(spark, sf):
    found = behavior.brute_force(t.auth_events(spark, sf), window=365 * DAY, max_failures=4)
    return found.drop("auth_type")


@query(
    "b4_failures",
    f"""WITH RECURSIVE {AUTH}, counted AS (SELECT *, count(*) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts
        RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW) AS failures FROM auth WHERE NOT success),
      fired AS (SELECT ts, min(packet_no) AS packet_no, src_ip, dst_ip FROM counted WHERE failures >= 4 GROUP BY ts, src_ip, dst_ip),
      {silenced('fired', 'src_ip, dst_ip', 365 * DAY, True)}
      SELECT e.src_ip, e.dst_ip, e.ts, a.ts AS failed_at, count(*) AS n FROM emitted e JOIN auth a
        ON a.src_ip = e.src_ip AND a.dst_ip = e.dst_ip AND NOT a.success AND a.ts BETWEEN e.ts - INTERVAL 365 DAY AND e.ts
      GROUP BY ALL""",
)
def _(spark, sf):
    auth = t.auth_events(spark, sf)
    fired = behavior.brute_force(auth, window=365 * DAY, max_failures=4)
    kept = silence(fired, ["src_ip", "dst_ip"], "ts", 365 * DAY, True, ["packet_no"])
    rows = behavior.failures_of(kept, auth, 365 * DAY)
    return rows.groupBy("src_ip", "dst_ip", "ts", "failed_at").agg(F.count("*").alias("n"))


@query("b5_oversized", f"WITH {PACKETS} SELECT ts, packet_no, src_ip, size AS packet_size FROM packets WHERE size > 20000")
def _(spark, sf):
    return behavior.oversized(t.packets(spark, sf), F.col("size"), 20000)


_SAMPLES = f"""samples AS (SELECT src_ip, date_trunc('day', ts) AS day, count(*) / 86400.0::DOUBLE AS pps,
        sum(greatest(size, 0))::DOUBLE / 86400.0::DOUBLE AS bps, max(packet_no) AS packet_no FROM packets GROUP BY 1, 2),
      numbered AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY day) AS n FROM samples),
      folded AS (
        SELECT src_ip, n, day, packet_no, pps, bps, NULL::DOUBLE AS prior_pps, NULL::DOUBLE AS prior_bps, pps AS avg_pps, bps AS avg_bps
          FROM numbered WHERE n = 1
        UNION ALL
        SELECT s.src_ip, s.n, s.day, s.packet_no, s.pps, s.bps, f.avg_pps, f.avg_bps,
          s.pps / 3 + f.avg_pps * 2 / 3, s.bps / 3 + f.avg_bps * 2 / 3
          FROM folded f JOIN numbered s ON s.src_ip = f.src_ip AND s.n = f.n + 1)"""


@query(
    "b6_ewma",
    f"""WITH RECURSIVE {PACKETS}, {_SAMPLES}
      SELECT src_ip, n, round(avg_pps * 86400, 9) AS avg_pps, round(prior_pps * 86400, 9) AS prior_pps FROM folded""",
)
def _(spark, sf):
    from packetloom.operators.windows import MICROS, ewma

    samples = behavior.traffic_samples(t.packets(spark, sf), F.col("size"), DAY)
    out = ewma(samples, ["src_ip"], "us", {"avg_pps": "pps"}, 1 / 3, 3600 * DAY * MICROS).filter("own")
    return out.select(
        "src_ip",
        "n",
        F.round(F.col("avg_pps") * 86400, 9).alias("avg_pps"),
        F.round(F.col("avg_pps_prior") * 86400, 9).alias("prior_pps"),
    )


def _spike_sql(base: str) -> str:
    return f"""WITH RECURSIVE {PACKETS}, {_SAMPLES},
      flagged AS (SELECT *, CASE WHEN n >= 4 AND {base}_pps IS NOT NULL AND
          (pps > greatest({base}_pps, 1e-6) * 1.3 OR bps > greatest({base}_bps, 1e-6) * 1.3) THEN 1 ELSE 0 END AS spike FROM folded),
      runs AS (SELECT *, sum(spike) OVER (PARTITION BY src_ip ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS run FROM flagged),
      fired AS (SELECT src_ip, CAST(day AS TIMESTAMP) AS ts, packet_no, n FROM runs WHERE run = 2),
      {silenced('fired', 'src_ip', 4 * DAY, False)}
      SELECT src_ip, ts, packet_no FROM emitted"""


def _spikes(spark, sf, baseline):
    found = behavior.traffic_spike(
        t.packets(spark, sf), F.col("size"), DAY, 1 / 3, 1.3, warmup=4, sustain=2, baseline=baseline, cooldown=4 * DAY
    )
    return found.select("src_ip", "ts", "packet_no")


@query("b6_spike_prior", _spike_sql("prior"))
def _(spark, sf):
    return _spikes(spark, sf, "prior")


@query("b6_spike_inclusive", _spike_sql("avg"))
def _(spark, sf):
    return _spikes(spark, sf, "inclusive")


_SESSIONS = f"""keyed AS (SELECT packet_no, ts, src_ip, split_part(dst_ip, '.', 3) AS dst_ip, proto, size FROM packets),
      gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER k > INTERVAL 1 DAY THEN 1 ELSE 0 END AS fresh FROM keyed
        WINDOW k AS (PARTITION BY src_ip, dst_ip, proto ORDER BY ts, packet_no)),
      runs AS (SELECT *, sum(fresh) OVER (PARTITION BY src_ip, dst_ip, proto ORDER BY ts, packet_no) AS run FROM gaps),
      totals AS (SELECT *, count(*) OVER s AS packets, CAST(sum(size) OVER s AS BIGINT) AS bytes, min(ts) OVER s AS session_start
        FROM runs WINDOW s AS (PARTITION BY src_ip, dst_ip, proto, run ORDER BY ts, packet_no ROWS UNBOUNDED PRECEDING))"""


def _keyed(spark, sf):
    return t.packets(spark, sf).withColumn("dst_ip", F.split_part("dst_ip", F.lit("."), F.lit(3)))


@query(
    "b7_session",
    f"WITH {PACKETS}, {_SESSIONS} SELECT packet_no, packets, bytes, session_start FROM totals",
)
def _(spark, sf):
    out = behavior.session_totals(_keyed(spark, sf), F.col("size"), idle=DAY)
    return out.select("packet_no", "packets", "bytes", "session_start")


@query(
    "b7_suspicious",
    f"""WITH RECURSIVE {PACKETS}, {_SESSIONS},
      timed AS (SELECT *, epoch_us(ts) - epoch_us(session_start) AS us FROM totals),
      fired AS (SELECT ts, packet_no, src_ip, dst_ip, proto, packets, bytes FROM timed WHERE us >= 2000000
        AND (packets >= 4 OR bytes >= 20000) AND (packets / (us / 1000000.0::DOUBLE) > 0.00005 OR bytes / (us / 1000000.0::DOUBLE) > 0.5)),
      {silenced('fired', 'src_ip, dst_ip, proto', DAY, False)}
      SELECT ts, packet_no, src_ip, dst_ip, proto, packets, bytes FROM emitted""",
)
def _(spark, sf):
    found = behavior.suspicious_session(
        _keyed(spark, sf), F.col("size"), idle=DAY, min_packets=4, min_bytes=20000, max_pps=0.00005, max_bps=0.5, cooldown=DAY
    )
    return found.select("ts", "packet_no", "src_ip", "dst_ip", "proto", "packets", "bytes")


@query(
    "b8_dispatch",
    f"""SELECT event_type AS type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1""",
)
def _(spark, sf):
    events = t.packets(spark, sf).join(
        t.read(spark, sf, "events").selectExpr("event_id as packet_no", "event_type"), "packet_no"
    )
    typed = events.selectExpr(
        "*",
        "case event_type when 'click' then 'auth' when 'view' then 'connection' else event_type end as type",
        "size % 2 = 0 as success",
        "'web' as auth_type",
    )
    auth, conn = behavior.dispatch(typed)
    return auth.agg(F.count("*").alias("n")).select(F.lit("click").alias("type"), "n").unionByName(
        conn.agg(F.count("*").alias("n")).select(F.lit("view").alias("type"), "n")
    )


# behaviour alerts and rule alerts between the same hosts, both from events
_TYPES = "['brute_force', 'port_scan', 'high_connection_rate', 'traffic_spike', 'suspicious_session', 'odd']"
_RULE_NAMES = "['login_failed', 'nmap_probe', 'syn_flood', 'other']"
_BEHAVIOR = f"""behavior AS (SELECT event_id AS packet_no, ts, {IP} AS src_ip, 'd' || (event_id % 3) AS dst_ip,
        {_TYPES}[CAST({K} % 6 + 1 AS INT)] AS alert_type FROM events WHERE event_type IN ('click', 'view')),
      rule_alerts AS (SELECT ts, {IP} AS src_ip, 'd' || (event_id % 3) AS dst_ip,
        {_RULE_NAMES}[CAST({K} % 4 + 1 AS INT)] AS rule_id FROM events WHERE event_type NOT IN ('click', 'view'))"""
_TOPICS = """CASE alert_type WHEN 'brute_force' THEN 'login_failed' WHEN 'port_scan' THEN 'nmap_probe'
      WHEN 'high_connection_rate' THEN 'syn_flood' WHEN 'traffic_spike' THEN 'syn_flood' WHEN 'suspicious_session' THEN 'syn_flood' END"""
_SUPPRESSED = f"""checked AS (SELECT b.*, EXISTS (SELECT 1 FROM rule_alerts r WHERE r.src_ip = b.src_ip AND r.dst_ip = b.dst_ip
        AND r.rule_id = {_TOPICS} AND r.ts BETWEEN b.ts - INTERVAL 2 DAY AND b.ts) AS suppressed FROM behavior b)"""


def _event_rows(spark, sf):
    rows = t.packets(spark, sf).join(
        t.read(spark, sf, "events").selectExpr(
            "event_id as packet_no", "event_type", "cast(get_json_object(props, '$.k') as int) as k"
        ),
        "packet_no",
    )
    return rows.withColumn("dst_ip", F.expr("concat('d', packet_no % 3)"))


def _alert_types(rows):
    quoted = "array('brute_force', 'port_scan', 'high_connection_rate', 'traffic_spike', 'suspicious_session', 'odd')"
    return rows.selectExpr("packet_no", "ts", "src_ip", "dst_ip", f"{quoted}[k % 6] as alert_type", "'x' as description")


def _behavior_rows(spark, sf):
    rows = _event_rows(spark, sf)
    alerts = _alert_types(rows.filter("event_type in ('click', 'view')"))
    rules = rows.filter("event_type not in ('click', 'view')").selectExpr(
        "ts", "src_ip", "dst_ip", "array('login_failed', 'nmap_probe', 'syn_flood', 'other')[k % 4] as rule_id"
    )
    return alerts, rules


@query(
    "b9_topic_suppress",
    f"WITH {_BEHAVIOR}, {_SUPPRESSED} SELECT packet_no, alert_type, suppressed FROM checked",
)
def _(spark, sf):
    alerts, rules = _behavior_rows(spark, sf)
    return behavior.topic_suppressed(alerts, rules, 2 * DAY).select("packet_no", "alert_type", "suppressed")


@query(
    "b10_repeat",
    f"""WITH RECURSIVE behavior AS (SELECT event_id AS packet_no, ts, {IP} AS src_ip, {_TYPES}[CAST({K} % 6 + 1 AS INT)] AS alert_type FROM events),
      {silenced('behavior', 'alert_type, src_ip', 3 * DAY, True)}
      SELECT packet_no, alert_type, src_ip, ts FROM emitted""",
)
def _(spark, sf):
    alerts = _alert_types(_event_rows(spark, sf))
    return behavior.first_of_topic(alerts, 3 * DAY).select("packet_no", "alert_type", "src_ip", "ts")


@query(
    "b11_compose",
    f"""WITH RECURSIVE {_BEHAVIOR}, {_SUPPRESSED}, left_over AS (SELECT * FROM checked WHERE NOT suppressed),
      {silenced('left_over', 'alert_type, src_ip', 2 * DAY, True)}
      SELECT packet_no, alert_type, suppressed, packet_no IN (SELECT packet_no FROM emitted) AS emitted FROM checked""",
)
def _(spark, sf):
    alerts, rules = _behavior_rows(spark, sf)
    return behavior.compose(alerts, rules, 2 * DAY).select("packet_no", "alert_type", "suppressed", "emitted")


@query(
    "b12_ftp_auth",
    f"""SELECT event_id * 2 + 1 AS packet_no, '10.9.' || user_id AS src_ip, 's' || (event_id % 4) AS dst_ip, {K} % 4 = 0 AS success
      FROM events WHERE {K} % 4 IN (0, 1)""",
)
def _(spark, sf):
    # each event is two server lines on port 21, with a result code chosen by k, sent in two packets cut somewhere in them
    texts = t.read(spark, sf, "events").selectExpr(
        "event_id",
        "cast(ts as timestamp) as ts",
        "concat('s', event_id % 4) as src_ip",
        "concat('10.9.', user_id) as dst_ip",
        "cast(concat('220 hello', '\\r\\n', array('230 welcome', '530 no', '331 password', '23 odd')"
        "[cast(get_json_object(props, '$.k') as int) % 4], '\\r\\n') as binary) as text",
    ).withColumn("flow", F.concat_ws("|", "src_ip", "dst_ip"))
    size = F.length("text").cast("bigint")
    placed = running(texts, ["flow"], F.col("event_id").cast("bigint"), ["event_id"], {"_end": ("sum", size)}, 4096)
    cut = "(1 + event_id % (length(text) - 1))"
    sent = placed.selectExpr(
        "flow", "ts", "src_ip", "dst_ip", "21 as src_port",
        "cast(event_id * 2 as bigint) as _no", "_end - length(text) as _from",
        f"inline(array(struct(0 as part, 0L as at, substring(text, 1, {cut}) as data), struct(1 as part, cast({cut} as bigint) as at, substring(text, {cut} + 1, length(text)) as data)))",
    )
    segments = sent.selectExpr("flow", "ts", "_no + part as packet_no", "src_ip", "dst_ip", "src_port", "(4294967000 + _from + at) % 4294967296 as seq", "data")
    return behavior.ftp_auth(segments).select("packet_no", "src_ip", "dst_ip", "success")


_LOGIN = f"""rows AS (SELECT event_id AS packet_no, ts, user_id % 40 AS client, event_type = 'click' AS attempt,
        [200, 302, 401, 403, 404, 500][CAST({K} % 6 + 1 AS INT)] AS code FROM events),
      seen AS (SELECT *, max(CASE WHEN attempt THEN ts END) OVER (PARTITION BY client ORDER BY ts, packet_no
        ROWS UNBOUNDED PRECEDING) AS attempt_ts FROM rows)"""


@query(
    "j7_login_asof",
    f"""WITH {_LOGIN} SELECT packet_no, ts, 'c' || client AS src_ip, code < 400 AS success, attempt_ts FROM seen
      WHERE NOT attempt AND attempt_ts >= ts - INTERVAL 6 HOUR AND code IN (200, 302, 401, 403)""",
)
def _(spark, sf):
    rows = t.read(spark, sf, "events").selectExpr(
        "event_id as packet_no",
        "cast(ts as timestamp) as ts",
        "event_type = 'click' as attempt",
        "concat('c', user_id % 40) as client_ip",
        "cast(1 as int) as client_port",
        "'web' as server_ip",
        "cast(80 as int) as server_port",
        "array(200, 302, 401, 403, 404, 500)[cast(get_json_object(props, '$.k') as int) % 6] as status_code",
    )
    found = behavior.login_results(rows.filter("attempt"), rows.filter("not attempt"), 6 * HOUR)
    return found.select("packet_no", "ts", "src_ip", "success", "attempt_ts")


@query(
    "a14_scan_top",
    f"""WITH {CONNECTIONS}, n AS (SELECT src_ip, year(ts) AS y, dst_ip, count(*) AS n FROM conns GROUP BY 1, 2, 3),
      r AS (SELECT *, row_number() OVER (PARTITION BY src_ip, y ORDER BY n DESC, dst_ip) AS rank FROM n)
      SELECT src_ip, y, dst_ip, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""",
)
def _(spark, sf):
    rows = t.connections(spark, sf).withColumn("y", F.year("ts").cast("bigint"))
    return stats.top_per_key(rows, ["src_ip", "y"], "dst_ip", 5)


@query(
    "a14_scan_windows",
    f"""WITH RECURSIVE {CONNECTIONS}, {_SCAN_COUNTS}, {silenced('fired', 'src_ip', 90 * DAY, False)},
      n AS (SELECT e.src_ip, e.ts, p.dst_port, count(*) AS n FROM emitted e JOIN probes p ON p.src_ip = e.src_ip
        AND p.ts BETWEEN e.ts - INTERVAL 30 DAY AND e.ts GROUP BY 1, 2, 3),
      r AS (SELECT *, row_number() OVER (PARTITION BY src_ip, ts ORDER BY n DESC, dst_port) AS rank FROM n)
      SELECT src_ip, ts, dst_port, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""",
)
def _(spark, sf):
    conns = t.connections(spark, sf)
    probes = materialize(behavior.accepted_probes(conns))
    found = behavior.port_scan(conns, 30 * DAY, 9, 11, 10, cooldown=90 * DAY, probes=probes)
    return behavior.scan_top(found, probes, "dst_port", 30 * DAY, 5)


# --------------------------------------------------------------------------- correlation

_MARKS = f"""marked AS (SELECT created_at AS ts, src_ip,
        sum(CASE WHEN rule_id LIKE 'behavior:%' THEN 2 ELSE 1 END) OVER w AS total,
        count(DISTINCT CASE WHEN rule_id NOT LIKE 'behavior:%' THEN rule_id END) OVER w AS diversity
      FROM alerts WINDOW w AS (PARTITION BY src_ip ORDER BY created_at RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)),
      marks AS (SELECT ts, src_ip, CAST(any_value(diversity) AS BIGINT) AS diversity, CAST(any_value(total) AS BIGINT) AS total,
        CASE WHEN any_value(total) >= 10 THEN 'high' ELSE 'medium' END AS severity
        FROM marked WHERE diversity >= 3 AND total >= 5 GROUP BY ts, src_ip)"""


def _marks(spark, sf):
    alerts = t.alerts(spark, sf).selectExpr(
        "created_at as ts", "src_ip", "rule_id", "rule_id like 'behavior:%' as is_behavior"
    )
    return correlate.score_attackers(alerts, 2 * DAY, 3, 5, 2)


@query("c1_scoring", f"WITH {ALERTS}, {_MARKS} SELECT * FROM marks")
def _(spark, sf):
    return _marks(spark, sf)


@query(
    "c2_current",
    f"""WITH {ALERTS}, {_MARKS} SELECT src_ip, max(ts) AS ts, arg_max(severity, ts) AS severity FROM marks
      GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 4 DAY""",
)
def _(spark, sf):
    return correlate.current_attackers(_marks(spark, sf), "2024-01-31 00:00:00", 2 * DAY)


@query(
    "c3_cooldown",
    f"""WITH RECURSIVE {ALERTS}, {_MARKS}, grid AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-10',
          INTERVAL 6 HOUR)) AS at),
      sweeps AS (SELECT m.src_ip, g.at AS ts, max(m.ts) AS marked, arg_max(m.severity, m.ts) AS severity, 0 AS packet_no
        FROM marks m JOIN grid g ON g.at >= m.ts AND g.at <= m.ts + INTERVAL 4 DAY GROUP BY 1, 2),
      {silenced('sweeps', 'src_ip', 3 * DAY, False)}
      SELECT src_ip, ts, severity, marked FROM emitted""",
)
def _(spark, sf):
    return correlate.attacker_alerts(_marks(spark, sf), 2 * DAY, 6 * HOUR, 3 * DAY)


@query(
    "a8_attacker_counts",
    f"""WITH {ALERTS}, {_MARKS}, current AS (SELECT src_ip, arg_max(severity, ts) AS severity FROM marks GROUP BY 1)
      SELECT count(*) AS total_attackers, count(*) FILTER (WHERE severity = 'high') AS high,
        count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low,
        (SELECT count(DISTINCT src_ip) FROM alerts) AS monitoring_ips FROM current""",
)
def _(spark, sf):
    current = correlate.current_attackers(_marks(spark, sf), "2024-01-31 00:00:00", 30 * DAY)
    return correlate.attacker_counts(current, t.alerts(spark, sf))


# --------------------------------------------------------------------------- alert dedupe

_HITS = f"""hits AS (SELECT event_id AS packet_no, ts, 'r_' || event_type AS match_rule, {IP} AS src_ip, 'd' AS dst_ip,
        CASE WHEN {K} % 2 = 0 THEN 'click' ELSE 'other' END AS match_text, event_id % 2 AS port FROM events)"""


def _hits(spark, sf):
    return t.packets(spark, sf).join(
        t.read(spark, sf, "events").selectExpr(
            "event_id as packet_no",
            "concat('r_', event_type) as match_rule",
            "if(cast(get_json_object(props, '$.k') as int) % 2 = 0, 'click', 'other') as match_text",
        ),
        "packet_no",
    ).selectExpr(
        "packet_no", "ts", "match_rule", "src_ip", "'d' as dst_ip", "match_text", "'' as payload_preview",
        "packet_no % 2 as src_port", "0 as dst_port",
    )


@query(
    "t8_alert_dedupe",
    f"""WITH RECURSIVE {_HITS}, {silenced('hits', 'match_rule, src_ip, match_text', 5 * DAY, True)}
      SELECT packet_no, match_rule, src_ip, match_text, ts FROM emitted""",
)
def _(spark, sf):
    kept = dedupe_alerts(_hits(spark, sf), 5 * DAY)
    return kept.select("packet_no", "match_rule", "src_ip", "match_text", "ts")


@query(
    "t6_cross_mode",
    f"""WITH RECURSIVE {_HITS}, {silenced('hits', 'match_rule, src_ip, port', 4 * DAY, True)}
      SELECT packet_no, match_rule, src_ip, ts FROM emitted""",
)
def _(spark, sf):
    return dedupe_modes(_hits(spark, sf), 4 * DAY).select("packet_no", "match_rule", "src_ip", "ts")
