"""Attackers from the alerts of a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.windows import MICROS, cell_of, from_micros, micros, silence, trailing


def score_attackers(
    alerts: DataFrame,
    window: float = 600,
    min_diversity: int = 4,
    min_alerts: int = 8,
    behavior_weight: int = 1,
) -> DataFrame:
    """Marks ``ts, src_ip, diversity, total, severity`` at every alert that meets the minimums.

    ``alerts`` has ``ts, src_ip, rule_id, is_behavior``; behaviour alerts weigh
    ``behavior_weight`` and do not add to the diversity.
    """
    weight = F.when(F.col("is_behavior"), behavior_weight).otherwise(1)
    rule = F.when(~F.col("is_behavior"), F.col("rule_id"))
    counts = trailing(alerts, ["src_ip"], "ts", window, {"total": weight}, {"diversity": rule})
    return counts.filter((F.col("diversity") >= min_diversity) & (F.col("total") >= min_alerts)).select(
        from_micros("us").alias("ts"),
        "src_ip",
        "diversity",
        "total",
        F.when(F.col("total") >= 2 * min_alerts, "high").otherwise("medium").alias("severity"),
    )


def current_attackers(marks: DataFrame, now, window: float = 600) -> DataFrame:
    """Latest mark per source, not older than twice the window."""
    cutoff = micros(F.lit(now).cast("timestamp")) - int(2 * window * MICROS)
    return (
        marks.groupBy("src_ip")
        .agg(F.max("ts").alias("ts"), F.max_by("severity", "ts").alias("severity"))
        .filter(micros("ts") >= cutoff)
    )


def attacker_alerts(
    marks: DataFrame, window: float = 600, sweep: float = 60, cooldown: float = 300, until=None
) -> DataFrame:
    """Alerts of a sweep every ``sweep`` seconds, one per source and ``cooldown``.

    A mark is current from the sweep after it until twice the window later;
    every sweep at which a source is current is a chance to alert.  ``ts`` is the
    sweep, ``marked`` the mark it saw.
    """
    step, life = int(sweep * MICROS), int(2 * window * MICROS)
    us = micros("ts")
    first = cell_of(us + step - 1, step)
    # of the marks between two sweeps only the latest is ever seen
    seen = (
        marks.withColumn("_sweep", first)
        .groupBy("src_ip", "_sweep")
        .agg(F.max(us).alias("_us"), F.max_by("severity", us).alias("severity"))
    )
    sweeps = seen.select(
        "src_ip", "_us", "severity", F.explode(F.sequence(F.col("_sweep"), cell_of(F.col("_us") + life, step), F.lit(step))).alias("_at")
    )
    if until is not None:
        sweeps = sweeps.filter(F.col("_at") <= micros(F.lit(until).cast("timestamp")))
    current = sweeps.groupBy("src_ip", "_at").agg(
        F.max("_us").alias("_us"), F.max_by("severity", "_us").alias("severity")
    )
    rows = current.select("src_ip", from_micros("_at").alias("ts"), "severity", from_micros("_us").alias("marked"))
    return silence(rows, ["src_ip"], "ts", cooldown, False, derived=True)


def merge_attackers(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Live and stored attackers in one list; what is stored wins."""
    text = F.concat(
        F.lit("Suspected attack activity from "), F.col("src_ip"), F.lit(" (severity: "), F.col("l.severity"), F.lit(")")
    )
    return live.alias("l").join(stored.alias("s"), "src_ip", "full_outer").select(
        "src_ip",
        F.coalesce("s.severity", "l.severity").alias("severity"),
        F.when(F.col("s.severity").isNotNull(), F.col("s.first_seen")).otherwise(F.col("l.ts")).alias("first_seen"),
        F.when(F.col("s.severity").isNotNull(), F.col("s.description")).otherwise(text).alias("description"),
    )


def upsert_attackers(stored: DataFrame, marks: DataFrame) -> DataFrame:
    """Stored attackers after new marks: first_seen is kept, severity and description overwritten."""
    fresh = marks.groupBy("src_ip").agg(
        F.min("ts").alias("_first"), F.max_by("severity", "ts").alias("_severity")
    )
    text = F.concat(
        F.lit("Detected suspected attacker "), F.col("src_ip"), F.lit(" (severity="), F.col("_severity"), F.lit(")")
    )
    return stored.join(fresh, "src_ip", "full_outer").select(
        "src_ip",
        F.coalesce("_severity", "severity").alias("severity"),
        F.coalesce("first_seen", "_first").alias("first_seen"),
        F.when(F.col("_severity").isNotNull(), text).otherwise(F.col("description")).alias("description"),
    )


def attacker_counts(attackers: DataFrame, history: DataFrame) -> DataFrame:
    """One row: attackers in total and per severity, sources with alerts in ``history``."""
    severities = ("high", "medium", "low")
    zero = F.lit(0).cast("bigint")
    counts = attackers.agg(
        F.count("*").alias("total_attackers"), *[F.count_if(F.col("severity") == s).alias(s) for s in severities]
    ).withColumn("monitoring_ips", zero)
    watched = history.agg(F.count_distinct("src_ip").alias("monitoring_ips")).withColumns(
        {c: zero for c in ("total_attackers", *severities)}
    )
    both = counts.unionByName(watched)
    return both.agg(*[F.sum(c).alias(c) for c in ("total_attackers", *severities, "monitoring_ips")])
