"""Alert statistics, lists and search."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.functions.alerts import alert_class, effective_severity
from packetloom.operators.joins import lookup_join
from packetloom.operators.windows import MICROS, from_micros, micros, trailing

# Time ranges in seconds.
RANGES = {"1h": 3600, "24h": 86400, "7d": 7 * 86400, "30d": 30 * 86400}


def in_range(alerts: DataFrame, now, range_: str = "24h") -> DataFrame:
    """Alerts created within the range before ``now``; an unknown range counts as 24h."""
    if range_ == "all":
        return alerts
    seconds = RANGES.get(range_, RANGES["24h"])
    start = from_micros(micros(F.lit(now).cast("timestamp")) - seconds * MICROS)
    return alerts.filter(F.col("created_at") >= start)


def bucket(ts: Column, interval: str) -> Column:
    if interval == "30m":
        return F.window(ts, "30 minutes")["start"]
    return F.date_trunc("hour" if interval == "1h" else "day", ts)


def default_interval(range_: str) -> str:
    return "1h" if range_ in ("1h", "24h") else "1d"


def severity_buckets(alerts: DataFrame, rules: DataFrame, interval: str | None = None, range_: str = "all", now=None) -> DataFrame:
    """``bucket, high, medium, low, total`` by the priority the rule has now.

    Counted per bucket and rule first, so the join with the rules sees only
    pre-aggregated rows.
    """
    interval = interval or default_interval(range_)
    rows = in_range(alerts, now, range_)
    counted = rows.groupBy(bucket(F.col("created_at"), interval).alias("bucket"), "rule_id").agg(F.count("*").alias("n"))
    joined = lookup_join(counted, rules.select("rule_id", F.col("priority").alias("rule_priority")), ["rule_id"], "left")
    p = F.col("rule_priority")
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return joined.groupBy("bucket").agg(
        total(p <= 1).alias("high"),
        total(p == 2).alias("medium"),
        total(p.isNull() | (p >= 3)).alias("low"),
        F.sum("n").alias("total"),
    )


def top_rules(alerts: DataFrame, n: int = 20) -> DataFrame:
    return alerts.groupBy("rule_id").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "rule_id").limit(n)


def top_sources(alerts: DataFrame, n: int = 20) -> DataFrame:
    ip = F.coalesce(F.nullif(F.col("src_ip"), F.lit("")), F.lit("unknown")).alias("ip")
    return alerts.groupBy(ip).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "ip").limit(n)


def total_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count("*").alias("total"))


def _readable_time(text: str | None):
    if not text:
        return None
    try:
        return datetime.fromisoformat(text)
    except ValueError:
        return None


def recent_alerts(
    alerts: DataFrame, limit: int = 50, src_ip: str | None = None, rule_id: str | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Latest alerts, optionally of a source, a rule or a time span; unreadable times are ignored."""
    out = alerts
    if src_ip:
        out = out.filter(F.col("src_ip") == src_ip)
    if rule_id:
        out = out.filter(F.col("rule_id") == rule_id)
    if _readable_time(start):
        out = out.filter(F.col("created_at") >= F.lit(_readable_time(start)))
    if _readable_time(end):
        out = out.filter(F.col("created_at") <= F.lit(_readable_time(end)))
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def with_severity(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule_priority`` and ``effective_severity``."""
    names = rules.select("rule_id", F.col("priority").alias("rule_priority"))
    joined = lookup_join(alerts, names, ["rule_id"], "left")
    return joined.withColumn(
        "effective_severity",
        effective_severity(F.col("rule_id"), F.col("rule_priority"), F.col("priority"), F.col("severity")),
    )


def filter_alerts(
    alerts: DataFrame, rules: DataFrame, kind: str = "all", rule_id: str | None = None, src_ip: str | None = None,
    text: str | None = None, severity: str | None = None,
) -> DataFrame:
    """Alert list by class, rule, source substring, free text and effective severity."""
    out = alerts
    if kind != "all":
        out = out.filter(alert_class(F.col("rule_id")) == kind)
    if rule_id:
        out = out.filter(F.col("rule_id") == rule_id)
    if src_ip:
        out = out.filter(F.coalesce(F.col("src_ip"), F.lit("")).contains(src_ip))
    if text:
        shown = F.coalesce(F.nullif(F.col("payload_preview"), F.lit("")), F.col("match_text"), F.lit(""))
        out = out.filter(F.lower(shown).contains(text.lower()) | F.lower("rule_id").contains(text.lower()))
    out = with_severity(out, rules)
    return out.filter(F.col("effective_severity") == severity) if severity else out


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of an ordered list."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def alert_rate(alerts: DataFrame, ts: str = "created_at", seconds: float = 60) -> DataFrame:
    """``ts, in_window``: alerts in the trailing window, at every alert time."""
    return trailing(alerts, [], ts, seconds, {"in_window": 1}).select(from_micros("us").alias("ts"), "in_window")


def severity_counts(alerts: DataFrame) -> DataFrame:
    """Counts per severity; anything unknown counts as low."""
    known = F.when(F.lower("severity").isin("high", "medium"), F.lower("severity")).otherwise("low")
    return alerts.groupBy(known.alias("severity")).agg(F.count("*").alias("count"))


def range_totals(buckets: DataFrame) -> DataFrame:
    return buckets.agg(*[F.sum(c).alias(c) for c in ("high", "medium", "low", "total")])


def top_per_key(rows: DataFrame, keys: list[str], item: str, k: int) -> DataFrame:
    """The ``k`` most frequent items per key with count and rank, ties by item."""
    counted = rows.groupBy(*keys, item).agg(F.count("*").alias("n"))
    rank = Window.partitionBy(*keys).orderBy(F.desc("n"), item)
    return counted.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def named_top_rules(alerts: DataFrame, rules: DataFrame, n: int = 20) -> DataFrame:
    """Top rules with name and pattern."""
    names = rules.select("rule_id", "name", F.array_join("pattern", ", ").alias("pattern"))
    return lookup_join(top_rules(alerts, n), names, ["rule_id"], "left").orderBy(F.desc("count"), "rule_id")


def rules_seen(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct rules of the alerts with their names."""
    return lookup_join(alerts.select("rule_id").distinct(), rules.select("rule_id", "name"), ["rule_id"], "left")
