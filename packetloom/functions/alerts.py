"""Column functions on alerts: severity, class, topic, text clean-up, row builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ordered topic patterns of rule ids, topics of behaviour alerts.
RULE_TOPICS = [
    ("brute", "brute_force"),
    ("auth.*fail", "brute_force"),
    ("login.*fail", "brute_force"),
    ("password", "brute_force"),
    ("ssh.*auth", "brute_force"),
    ("ftp.*auth", "brute_force"),
    ("scan", "scan"),
    ("port.*scan", "scan"),
    ("nmap", "scan"),
    ("recon", "scan"),
    ("probe", "scan"),
    ("dos", "dos"),
    ("ddos", "dos"),
    ("flood", "dos"),
    ("syn.*flood", "dos"),
    ("icmp.*flood", "dos"),
    ("traffic.*anomaly", "dos"),
]
BEHAVIOR_TOPICS = {
    "brute_force": "brute_force",
    "port_scan": "scan",
    "high_connection_rate": "dos",
    "traffic_spike": "dos",
    "suspicious_session": "dos",
}
PREVIEW_LENGTH = 400

ALERT_COLUMNS = [
    "ts", "packet_no", "protocol", "src_ip", "dst_ip", "src_port", "dst_port", "packet_summary", "match_rule",
    "match_text", "match_type", "payload_preview", "pos_start", "pos_end", "priority", "severity", "source",
]


def severity_of(priority: Column) -> Column:
    """high/medium/low by priority; a missing or unreadable priority is low."""
    number = priority.try_cast("int")
    return F.when(number <= 1, "high").when(number == 2, "medium").otherwise("low")


def priority_of(severity: Column) -> Column:
    return F.when(F.lower(severity) == "high", 1).when(F.lower(severity) == "medium", 2).otherwise(3)


def alert_class(rule_id: Column) -> Column:
    return (
        F.when(rule_id.startswith("behavior:"), "behavior")
        .when(rule_id.startswith("correlation:"), "correlation")
        .otherwise("rule")
    )


def effective_severity(rule_id: Column, rule_priority: Column, priority: Column, severity: Column) -> Column:
    """Severity shown for an alert: rule priority, own priority, severity text, then its name."""
    text = F.lower(severity)
    name = F.when(rule_id.rlike("high|brute|suspicious"), "high").when(
        rule_id.rlike("medium|port_scan|oversized"), "medium"
    )
    return (
        F.when(rule_priority.isNotNull(), severity_of(rule_priority))
        .when(priority.isNotNull(), severity_of(priority))
        .when(text.contains("high"), "high")
        .when(text.contains("medium"), "medium")
        .when(text.contains("low"), "low")
        .when(alert_class(rule_id) == "behavior", F.coalesce(name, F.lit("low")))
        .otherwise("low")
    )


def sanitize_text(text: Column, length: int = PREVIEW_LENGTH) -> Column:
    """Printable ASCII only: other characters as ``\\xNN``, white space collapsed, long text cut."""

    def safe(char):
        code = F.ascii(char)
        return F.when(char.rlike(r"^[\x20-\x7e]$"), char).otherwise(
            F.concat(F.lit("\\x"), F.lower(F.when(code < 16, F.lpad(F.hex(code), 2, "0")).otherwise(F.hex(code))))
        )

    plain = F.coalesce(text, F.lit(""))
    dirty = plain.rlike(r"[^\x20-\x7e]")
    escaped = F.when(
        dirty, F.array_join(F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), safe), "")
    ).otherwise(plain)
    flat = F.trim(F.regexp_replace(escaped, " +", " "))
    return F.when(F.length(flat) > length, F.concat(flat.substr(1, length), F.lit("…"))).otherwise(flat)


def rule_topic(rule_id: Column) -> Column:
    """Threat topic of a rule id by the first pattern that fits, null if none does."""
    out = None
    for pattern, topic in RULE_TOPICS:
        hit = rule_id.rlike("(?i)" + pattern)
        out = F.when(hit, topic) if out is None else out.when(hit, topic)
    return out


def behavior_topic(alert_type: Column) -> Column:
    out = None
    for name, topic in BEHAVIOR_TOPICS.items():
        out = F.when(alert_type == name, topic) if out is None else out.when(alert_type == name, topic)
    return out.otherwise("unknown")


def split_preview(text: Column) -> Column:
    """``struct(summary, details)`` of ``summary | {json}``; details is null without JSON."""
    at = F.locate(" | {", text)
    return F.when(
        at > 0,
        F.struct(
            text.substr(F.lit(1), at - 1).alias("summary"),
            F.from_json(text.substr(at + 3, F.length(text)), "map<string,string>").alias("details"),
        ),
    ).otherwise(F.struct(text.alias("summary"), F.lit(None).cast("map<string,string>").alias("details")))


def sink_severity(priority: Column, severity: Column) -> Column:
    """Severity at the sink: only an empty one is derived from the priority."""
    empty = severity.isNull() | (severity == "")
    return F.when(empty & priority.isNotNull(), severity_of(priority)).otherwise(severity)


def persisted(alerts: DataFrame) -> DataFrame:
    """Alert rows as they are stored: cleaned texts, preview falling back to the summary."""
    preview = F.coalesce(F.col("payload_preview"), F.col("packet_summary"))
    return alerts.select(
        F.col("match_rule").alias("rule_id"),
        sanitize_text(F.col("match_text")).alias("match_text"),
        "src_ip",
        "dst_ip",
        "pos_start",
        "pos_end",
        sanitize_text(preview).alias("payload_preview"),
        "priority",
        sink_severity(F.col("priority"), F.col("severity")).alias("severity"),
        F.col("ts").alias("created_at"),
    )


def rule_alerts(matches: DataFrame, source: str) -> DataFrame:
    """Alert rows of first matches per packet and rule; ``source`` is packet, stream, request, response or ip."""
    ends = F.concat(F.col("src_ip"), F.lit(":"), F.col("src_port"), F.lit(" -> "), F.col("dst_ip"))
    if source == "request":
        summary = F.concat_ws(" ", F.concat(F.lit("HTTP "), ends), F.col("method"), F.col("path"))
    elif source == "response":
        summary = F.trim(F.concat_ws(" ", F.concat(F.lit("HTTP "), ends), F.col("status_code").cast("string")))
    else:
        label = F.lit("TCP(stream)") if source == "stream" else F.col("proto")
        summary = F.concat(label, F.lit(" "), ends, F.lit(":"), F.col("dst_port"))
    kind = F.concat(F.col("match_type"), F.lit(":stream")) if source == "stream" else F.col("match_type")
    return matches.select(
        "ts",
        "packet_no",
        F.col("proto").alias("protocol"),
        "src_ip",
        "dst_ip",
        "src_port",
        "dst_port",
        summary.alias("packet_summary"),
        F.col("rule_id").alias("match_rule"),
        "match_text",
        kind.alias("match_type"),
        F.coalesce(F.nullif(F.col("preview"), F.lit("")), summary).alias("payload_preview"),
        "pos_start",
        "pos_end",
        "priority",
        severity_of(F.col("priority")).alias("severity"),
        F.lit(source).alias("source"),
    )


def behavior_alert_rows(alerts: DataFrame) -> DataFrame:
    """Alert rows of behaviour alerts (``ts, packet_no, alert_type, severity, src_ip, dst_ip, description, details``)."""
    details = F.when(F.size("details") > 0, F.concat(F.lit(" | "), F.to_json("details")))
    return alerts.select(
        "ts",
        "packet_no",
        F.lit("BEHAVIOR").alias("protocol"),
        "src_ip",
        F.coalesce(F.col("dst_ip"), F.lit("")).alias("dst_ip"),
        F.lit(None).cast("int").alias("src_port"),
        F.lit(None).cast("int").alias("dst_port"),
        F.concat(F.lit("Behavior "), F.col("alert_type"), F.lit(" from "), F.col("src_ip")).alias("packet_summary"),
        F.concat(F.lit("behavior:"), F.col("alert_type")).alias("match_rule"),
        F.col("description").alias("match_text"),
        F.lit("behavior").alias("match_type"),
        F.concat(F.col("description"), F.coalesce(details, F.lit(""))).alias("payload_preview"),
        F.lit(None).cast("int").alias("pos_start"),
        F.lit(None).cast("int").alias("pos_end"),
        priority_of(F.col("severity")).alias("priority"),
        "severity",
        F.lit("behavior").alias("source"),
    )


def correlation_alert_rows(attackers: DataFrame) -> DataFrame:
    """Alert rows of attacker alerts (``ts, src_ip, severity``)."""
    return attackers.select(
        "ts",
        F.lit(None).cast("bigint").alias("packet_no"),
        F.lit("CORRELATION").alias("protocol"),
        "src_ip",
        F.lit("").alias("dst_ip"),
        F.lit(None).cast("int").alias("src_port"),
        F.lit(None).cast("int").alias("dst_port"),
        F.concat(F.lit("Suspected attacker: "), F.col("src_ip")).alias("packet_summary"),
        F.concat(F.lit("correlation:suspected_attacker_"), F.col("severity")).alias("match_rule"),
        F.concat(F.lit("Multiple attack patterns detected from "), F.col("src_ip")).alias("match_text"),
        F.lit("correlation").alias("match_type"),
        F.concat(F.lit("Suspected attacker activity from "), F.col("src_ip")).alias("payload_preview"),
        F.lit(None).cast("int").alias("pos_start"),
        F.lit(None).cast("int").alias("pos_end"),
        F.when(F.col("severity") == "high", 1).otherwise(2).alias("priority"),
        "severity",
        F.lit("correlation").alias("source"),
    )
