"""The whole detection as a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.plans.detect import Settings, connection_numbers, detect, http_messages, routed
from packetloom.plans.queries_rules import make_rules
from packetloom.plans.registry import query
from packetloom.sources import adapters as t

DAY = 86400
_RULES = [
    {"id": "license_text", "protocol": "tcp", "contents": [("license", {"nocase": True})], "priority": 1},
    {"id": "doc_scan", "contents": ["the ", ("on", {"within": 30})], "priority": 2},
    {"id": "address_leak", "pcre": ["/[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.]/"], "priority": 3},
    {"id": "page_script", "protocol": "tcp", "dst_ports": ["80"], "contents": ["POST /", ("<script", {})], "flow": "only_stream"},
    {"id": "mail_command", "dst_ports": ["25"], "contents": ["DATA"], "smtp_command": True},
]
SETTINGS = Settings(
    rate={"window": 2 * DAY, "max_connections": 2, "cooldown": DAY},
    scan={"window": DAY, "threshold": 5, "min_ports": 5, "min_targets": 4, "cooldown": DAY},
    spike={"interval": DAY, "alpha": 1 / 3, "factor": 1.5, "warmup": 4, "sustain": 2, "cooldown": DAY},
    session={"idle": DAY, "min_packets": 4, "min_bytes": 20000, "max_pps": 0.00005, "max_bps": 0.5, "cooldown": DAY},
    auth={"window": 30 * DAY, "max_failures": 3},
    scoring={"window": DAY, "min_diversity": 1, "min_alerts": 3},
    attacker_alerts={"window": DAY, "sweep": 6 * 3600, "cooldown": DAY},
    behavior_window=DAY,
)


@query("t10_detect")
def _(spark, sf):
    run = detect(t.captured(spark, sf), make_rules(spark, _RULES), SETTINGS, t.auth_events(spark, sf))
    return run.alerts.select(
        "ts", "source", "match_rule", "src_ip", "dst_ip", "match_text", "match_type", "packet_summary", "priority", "severity"
    )


@query(
    "t10_http_extraction",
    """SELECT '10.2.0.' || (page_id % 50) AS src_ip, CAST(2000 + page_id AS INT) AS src_port, md5(html) AS body FROM pages""",
)
def _(spark, sf):
    packets = routed(t.captured(spark, sf))
    requests, _ = http_messages(packets, connection_numbers(packets))
    return requests.select("src_ip", "src_port", F.md5("m.body").alias("body"))


@query(
    "t10_message_times",
    """SELECT CAST(1000000000 + page_id * 2 + 1 AS BIGINT) AS packet_no, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 3 + 1) AS ts, md5(html) AS body FROM pages""",
)
def _(spark, sf):
    # a page comes in two packets, one second apart; the second completes the message
    packets = routed(t.captured(spark, sf))
    requests, _ = http_messages(packets, connection_numbers(packets))
    return requests.select("packet_no", "ts", F.md5("m.body").alias("body"))
