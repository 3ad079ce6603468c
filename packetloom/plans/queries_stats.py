"""Statistics, search and table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.alerts import (
    alert_class,
    priority_of,
    rule_topic,
    sanitize_text,
    severity_of,
    sink_severity,
    split_preview,
)
from packetloom.operators import correlate, rule_table, stats
from packetloom.operators.alert_stream import delete_alerts
from packetloom.operators.rule_text import effective_variables, resolve_variables
from packetloom.plans.registry import query
from packetloom.plans.sql_tables import ALERT_RULES, ALERTS, K
from packetloom.sources import adapters as t

NOW = "2024-01-31 00:00:00"


def _buckets_sql(bucket: str, where: str = "") -> str:
    return f"""WITH {ALERTS}, {ALERT_RULES}
      SELECT {bucket} AS bucket, count(*) FILTER (WHERE r.priority <= 1) AS high, count(*) FILTER (WHERE r.priority = 2) AS medium,
        count(*) FILTER (WHERE r.priority IS NULL OR r.priority >= 3) AS low, count(*) AS total
      FROM alerts a LEFT JOIN rules r USING (rule_id) {where} GROUP BY 1"""


@query("a1_buckets_30m", _buckets_sql("time_bucket(INTERVAL 30 MINUTE, created_at)"))
def _(spark, sf):
    return stats.severity_buckets(t.alerts(spark, sf), t.alert_rules(spark), "30m")


@query("a1_buckets_1h", _buckets_sql("date_trunc('hour', created_at)"))
def _(spark, sf):
    return stats.severity_buckets(t.alerts(spark, sf), t.alert_rules(spark), "1h")


@query(
    "a1_buckets_1d",
    _buckets_sql(
        "CAST(date_trunc('day', created_at) AS TIMESTAMP)", f"WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY"
    ),
)
def _(spark, sf):
    return stats.severity_buckets(t.alerts(spark, sf), t.alert_rules(spark), None, "7d", NOW)


@query(
    "a2_top_rules",
    f"""WITH {ALERTS} SELECT rule_id, count(*) AS count FROM alerts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(spark, sf):
    return stats.top_rules(t.alerts(spark, sf), 10)


@query(
    "a3_top_ips",
    f"""WITH {ALERTS} SELECT coalesce(nullif(src_ip, ''), 'unknown') AS ip, count(*) AS count
      FROM alerts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def _(spark, sf):
    return stats.top_sources(t.alerts(spark, sf), 20)


@query(
    "a4_total",
    f"WITH {ALERTS} SELECT count(*) AS total FROM alerts WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY",
)
def _(spark, sf):
    return stats.total_count(stats.in_range(t.alerts(spark, sf), NOW, "30d"))


@query(
    "a5_recent",
    f"""WITH {ALERTS} SELECT * FROM alerts WHERE rule_id = 'r_click' AND created_at >= TIMESTAMP '2024-01-05'
        AND created_at <= TIMESTAMP '2024-01-20' ORDER BY created_at DESC, id DESC LIMIT 50""",
)
def _(spark, sf):
    return stats.recent_alerts(
        t.alerts(spark, sf), 50, rule_id="r_click", start="2024-01-05T00:00:00", end="2024-01-20T00:00:00"
    )


_EFFECTIVE = """CASE WHEN r.priority IS NOT NULL THEN
      CASE WHEN r.priority <= 1 THEN 'high' WHEN r.priority = 2 THEN 'medium' ELSE 'low' END
    WHEN a.priority IS NOT NULL THEN
      CASE WHEN a.priority <= 1 THEN 'high' WHEN a.priority = 2 THEN 'medium' ELSE 'low' END
    WHEN a.severity ILIKE '%high%' THEN 'high' WHEN a.severity ILIKE '%medium%' THEN 'medium'
    WHEN a.severity ILIKE '%low%' THEN 'low'
    WHEN starts_with(a.rule_id, 'behavior:') AND regexp_matches(a.rule_id, 'high|brute|suspicious') THEN 'high'
    WHEN starts_with(a.rule_id, 'behavior:') AND regexp_matches(a.rule_id, 'medium|port_scan|oversized') THEN 'medium'
    ELSE 'low' END"""


@query(
    "a6_filter",
    f"""WITH {ALERTS}, {ALERT_RULES}
      SELECT a.id, a.rule_id, a.src_ip, {_EFFECTIVE} AS effective_severity
      FROM alerts a LEFT JOIN rules r USING (rule_id)
      WHERE starts_with(rule_id, 'behavior:') AND contains(src_ip, '.1') AND
        (contains(lower(payload_preview), 'k": 3') OR contains(lower(rule_id), 'click')) AND {_EFFECTIVE} = 'high'""",
)
def _(spark, sf):
    rows = stats.filter_alerts(
        t.alerts(spark, sf), t.alert_rules(spark), kind="behavior", src_ip=".1", severity="high"
    )
    shown = F.lower("payload_preview").contains('k": 3') | F.lower("rule_id").contains("click")
    return rows.filter(shown).select("id", "rule_id", "src_ip", "effective_severity")


@query(
    "a6_page",
    f"""WITH {ALERTS} SELECT id, rule_id, created_at FROM alerts
      WHERE contains(lower(payload_preview), 'k": 4') OR contains(lower(rule_id), 'k": 4')
      ORDER BY created_at DESC, id LIMIT 20 OFFSET 40""",
)
def _(spark, sf):
    rows = stats.filter_alerts(t.alerts(spark, sf), t.alert_rules(spark), text='K": 4')
    return stats.page(rows, [F.desc("created_at"), F.col("id")], 3, 20).select("id", "rule_id", "created_at")


def _part_rules(spark, sf):
    return t.read(spark, sf, "part").selectExpr(
        "concat('part_', p_partkey) as rule_id",
        "p_name as name",
        "p_type as description",
        "p_brand as category",
        "array(p_type, concat('size', p_size)) as tags",
    )


@query(
    "a7_rule_search",
    """SELECT 'part_' || p_partkey AS rule_id, p_name AS name, p_brand AS category FROM part
      WHERE (('part_' || p_partkey) ILIKE '%ring%' OR p_name ILIKE '%ring%' OR p_type ILIKE '%ring%')
        AND p_brand ILIKE '%brand#2%' AND (p_type ILIKE '%SIZE1%' OR ('size' || p_size) ILIKE '%SIZE1%')""",
)
def _(spark, sf):
    found = rule_table.search_rules(_part_rules(spark, sf), search="RING", category="brand#2", tags="SIZE1")
    return found.select("rule_id", "name", "category")


@query(
    "a7_rule_page",
    """SELECT 'part_' || p_partkey AS rule_id, p_name AS name, p_brand AS category FROM part
      WHERE ('part_' || p_partkey) ILIKE '%1%' OR p_name ILIKE '%1%' OR p_type ILIKE '%1%' ORDER BY 1 LIMIT 20 OFFSET 10""",
)
def _(spark, sf):
    found = rule_table.search_rules(_part_rules(spark, sf), search="1")
    return rule_table.rule_page(found, 10, 20).select("rule_id", "name", "category")


@query(
    "a9_rate",
    f"""WITH {ALERTS} SELECT DISTINCT created_at AS ts, count(*) OVER (ORDER BY created_at
        RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_window FROM alerts""",
)
def _(spark, sf):
    return stats.alert_rate(t.alerts(spark, sf), seconds=3600)


@query(
    "a10_severity",
    f"""WITH {ALERTS} SELECT CASE WHEN lower(severity) IN ('high', 'medium') THEN lower(severity) ELSE 'low' END AS severity,
        count(*) AS count FROM alerts GROUP BY 1""",
)
def _(spark, sf):
    return stats.severity_counts(t.alerts(spark, sf))


@query(
    "a11_range_totals",
    f"""WITH {ALERTS}, {ALERT_RULES} SELECT count(*) FILTER (WHERE r.priority <= 1) AS high, count(*) FILTER (WHERE r.priority = 2) AS medium,
        count(*) FILTER (WHERE r.priority IS NULL OR r.priority >= 3) AS low, count(*) AS total
      FROM alerts a LEFT JOIN rules r USING (rule_id)""",
)
def _(spark, sf):
    return stats.range_totals(stats.severity_buckets(t.alerts(spark, sf), t.alert_rules(spark), "1d"))


@query(
    "j6_alerts_rules",
    f"""WITH {ALERTS}, {ALERT_RULES} SELECT a.id, a.rule_id, r.priority AS rule_priority,
      {_EFFECTIVE} AS effective_severity FROM alerts a LEFT JOIN rules r USING (rule_id)""",
)
def _(spark, sf):
    out = stats.with_severity(t.alerts(spark, sf), t.alert_rules(spark))
    return out.select("id", "rule_id", "rule_priority", "effective_severity")


@query(
    "j10_named_top",
    f"""WITH {ALERTS}, {ALERT_RULES} SELECT a.rule_id, a.count, r.name, r.pattern FROM
      (SELECT rule_id, count(*) AS count FROM alerts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8) a LEFT JOIN rules r USING (rule_id)""",
)
def _(spark, sf):
    return stats.named_top_rules(t.alerts(spark, sf), t.alert_rules(spark), 8)


@query(
    "j10_rules_seen",
    f"""WITH {ALERTS}, {ALERT_RULES} SELECT DISTINCT a.rule_id, r.name FROM alerts a LEFT JOIN rules r USING (rule_id)""",
)
def _(spark, sf):
    return stats.rules_seen(t.alerts(spark, sf), t.alert_rules(spark))


@query(
    "p21_severity",
    f"""WITH {ALERTS} SELECT id, CASE WHEN priority <= 1 THEN 'high' WHEN priority = 2 THEN 'medium' ELSE 'low' END AS packet_severity,
      CASE WHEN coalesce(severity, '') = '' AND priority IS NOT NULL THEN
        CASE WHEN priority <= 1 THEN 'high' WHEN priority = 2 THEN 'medium' ELSE 'low' END ELSE severity END AS sink_severity,
      CASE lower(severity) WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS priority FROM alerts""",
)
def _(spark, sf):
    return t.alerts(spark, sf).select(
        "id",
        severity_of(F.col("priority")).alias("packet_severity"),
        sink_severity(F.col("priority"), F.col("severity")).alias("sink_severity"),
        priority_of(F.col("severity")).alias("priority"),
    )


@query(
    "p23_cascade",
    f"""WITH {ALERTS}, {ALERT_RULES} SELECT {_EFFECTIVE} AS effective_severity, a.rule_id, count(*) AS n
      FROM alerts a LEFT JOIN rules r USING (rule_id) GROUP BY 1, 2""",
)
def _(spark, sf):
    out = stats.with_severity(t.alerts(spark, sf), t.alert_rules(spark))
    return out.groupBy("effective_severity", "rule_id").agg(F.count("*").alias("n"))


@query(
    "p24_alert_class",
    f"""WITH {ALERTS} SELECT CASE WHEN rule_id LIKE 'behavior:%' THEN 'behavior' WHEN rule_id LIKE 'correlation:%'
      THEN 'correlation' ELSE 'rule' END AS class, count(*) AS n FROM alerts GROUP BY 1""",
)
def _(spark, sf):
    return t.alerts(spark, sf).groupBy(alert_class(F.col("rule_id")).alias("class")).agg(F.count("*").alias("n"))


@query(
    "p25_sanitize",
    r"""WITH clean AS (SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(text, ''),
        lambda c: CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c ELSE '\x' || lpad(lower(to_hex(unicode(c))),
          CAST(greatest(2, length(to_hex(unicode(c)))) AS INT), '0') END), ''), ' +', ' ', 'g')) AS s FROM documents)
      SELECT doc_id, CASE WHEN length(s) > 400 THEN left(s, 400) || '…' ELSE s END AS preview FROM clean""",
)
def _(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", sanitize_text(F.col("text")).alias("preview"))


@query(
    "p26_topic",
    """SELECT p_partkey, CASE WHEN regexp_matches(x, '(?i)brute|auth.*fail|login.*fail|password|ssh.*auth|ftp.*auth') THEN 'brute_force'
        WHEN regexp_matches(x, '(?i)scan|nmap|recon|probe') THEN 'scan'
        WHEN regexp_matches(x, '(?i)dos|flood|traffic.*anomaly') THEN 'dos' END AS topic
      FROM (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'SSH_' || p_name || '_auth' WHEN 1 THEN 'port_Scan_' || p_size
        WHEN 2 THEN 'syn flood ' || p_name WHEN 3 THEN 'login ' || p_brand || ' failed' WHEN 4 THEN 'traffic_' || p_type || '_anomaly'
        WHEN 5 THEN 'reconDoS' ELSE p_name END AS x FROM part)""",
)
def _(spark, sf):
    rule = F.expr(
        "case p_partkey % 7 when 0 then concat('SSH_', p_name, '_auth') when 1 then concat('port_Scan_', p_size) "
        "when 2 then concat('syn flood ', p_name) when 3 then concat('login ', p_brand, ' failed') "
        "when 4 then concat('traffic_', p_type, '_anomaly') when 5 then 'reconDoS' else p_name end"
    )
    return t.read(spark, sf, "part").select("p_partkey", rule_topic(rule).alias("topic"))


@query(
    "p30_split",
    f"""SELECT event_id, event_type AS summary, {K} AS k FROM events""",
)
def _(spark, sf):
    text = F.concat(F.col("event_type"), F.lit(" | "), F.col("props"))
    split = split_preview(text)
    return t.read(spark, sf, "events").select(
        "event_id", split["summary"].alias("summary"), split["details"]["k"].cast("int").alias("k")
    )


@query(
    "s7_attacker_upsert",
    f"""WITH {ALERTS}, fresh AS (SELECT src_ip, min(created_at) AS f, arg_max(rule_id, (created_at, id)) AS s
        FROM alerts WHERE src_ip <> '' GROUP BY 1),
      stored AS (SELECT '10.0.' || (c_custkey // 256) || '.' || (c_custkey % 256) AS src_ip, c_mktsegment AS severity,
        TIMESTAMP '2023-06-01' AS first_seen, c_name AS description FROM customer)
      SELECT src_ip, coalesce(fresh.s, stored.severity) AS severity, coalesce(stored.first_seen, fresh.f) AS first_seen,
        CASE WHEN fresh.s IS NOT NULL THEN 'Detected suspected attacker ' || src_ip || ' (severity=' || fresh.s || ')'
          ELSE stored.description END AS description
      FROM stored FULL JOIN fresh USING (src_ip)""",
)
def _(spark, sf):
    marks = t.alerts(spark, sf).filter("src_ip <> ''").selectExpr("src_ip", "rule_id as severity", "created_at as ts")
    return correlate.upsert_attackers(_stored_attackers(spark, sf), marks)


def _stored_attackers(spark, sf):
    return t.read(spark, sf, "customer").selectExpr(
        "concat('10.0.', c_custkey div 256, '.', c_custkey % 256) as src_ip",
        "c_mktsegment as severity",
        "timestamp '2023-06-01 00:00:00' as first_seen",
        "c_name as description",
    )


@query(
    "j9_merge",
    f"""WITH {ALERTS}, live AS (SELECT src_ip, max(created_at) AS ts FROM alerts WHERE src_ip <> '' GROUP BY 1),
      stored AS (SELECT '10.0.' || (c_custkey // 256) || '.' || (c_custkey % 256) AS src_ip, c_mktsegment AS severity,
        TIMESTAMP '2023-06-01' AS first_seen, c_name AS description FROM customer)
      SELECT src_ip, coalesce(s.severity, 'high') AS severity, coalesce(s.first_seen, l.ts) AS first_seen,
        coalesce(s.description, 'Suspected attack activity from ' || src_ip || ' (severity: high)') AS description
      FROM live l FULL JOIN stored s USING (src_ip)""",
)
def _(spark, sf):
    live = t.alerts(spark, sf).filter("src_ip <> ''").groupBy("src_ip").agg(F.max("created_at").alias("ts"))
    stored = t.read(spark, sf, "customer").selectExpr(
        "concat('10.0.', c_custkey div 256, '.', c_custkey % 256) as src_ip",
        "c_mktsegment as severity",
        "timestamp '2023-06-01 00:00:00' as first_seen",
        "c_name as description",
    )
    return correlate.merge_attackers(live.withColumn("severity", F.lit("high")), stored)


@query(
    "s4_rule_scan",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '+' || p_name ELSE p_type END AS patterns,
      CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS n FROM part""",
)
def _(spark, sf):
    stored = F.expr("if(p_partkey % 3 = 0, to_json(array(p_brand, p_name)), p_type)")
    patterns = rule_table.decode_patterns(stored)
    return t.read(spark, sf, "part").select(
        "p_partkey", F.array_join(patterns, "+").alias("patterns"), F.size(patterns).alias("n")
    )


@query(
    "s5_rule_json",
    """SELECT p_name AS name, p_brand AS patterns, p_size AS priority FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 5 <> 0""",
)
def _(spark, sf):
    from packetloom.sources.io import usable_json_rules

    raw = t.read(spark, sf, "part").selectExpr(
        "if(p_partkey % 4 = 0, null, p_name) as name",
        "if(p_partkey % 5 = 0, null, array(p_brand)) as patterns",
        "cast(p_size as string) as severity",
    )
    return usable_json_rules(raw).select(
        "name", F.array_join("pattern", ",").alias("patterns"), F.col("priority")
    )


@query(
    "s8_insert_absent",
    """WITH fresh AS (SELECT 'r' || (o_custkey % 2000) AS rule_id, min(o_orderkey) AS line FROM orders GROUP BY 1)
      SELECT rule_id, line FROM fresh ANTI JOIN (SELECT 'r' || p_partkey AS rule_id FROM part WHERE p_size < 25) USING (rule_id)""",
)
def _(spark, sf):
    new = t.read(spark, sf, "orders").selectExpr("concat('r', o_custkey % 2000) as rule_id", "o_orderkey as line")
    old = t.read(spark, sf, "part").filter("p_size < 25").selectExpr("concat('r', p_partkey) as rule_id")
    return rule_table.insert_if_absent(old, new, ["line"])


@query(
    "s9_overlay",
    """SELECT p_partkey AS rule_id, CASE WHEN p_size > 40 THEN 'changed ' || p_brand ELSE p_name END AS name FROM part
      WHERE p_type <> 'ECONOMY' OR p_size > 40""",
)
def _(spark, sf):
    part = t.read(spark, sf, "part")
    base = part.selectExpr("p_partkey as rule_id", "p_name as name")
    changes = part.filter("p_size > 40").selectExpr("p_partkey as rule_id", "concat('changed ', p_brand) as name")
    gone = part.filter("p_type = 'ECONOMY' and p_size <= 40").selectExpr("p_partkey as rule_id")
    return rule_table.delete_rules(rule_table.overlay(base, changes), gone)


@query(
    "s10_variables",
    """WITH RECURSIVE v AS (SELECT '$N' || n_nationkey AS name, CASE WHEN n_nationkey < 5 THEN '10.' || n_nationkey || '.0.0/16'
          WHEN n_nationkey % 5 = 4 THEN '$MISSING' WHEN n_nationkey % 2 = 0 THEN '!$N' || (n_nationkey - 5)
          ELSE '$N' || (n_nationkey - 5) END AS d,
          CASE WHEN n_nationkey % 6 = 2 THEN 'any' || n_regionkey END AS o FROM nation),
        e AS (SELECT name, coalesce(o, d) AS value FROM v),
        w AS (SELECT name, value, value AS resolved, 0 AS depth FROM e
          UNION ALL SELECT w.name, w.value, regexp_extract(w.resolved, '^!*') ||
            coalesce((SELECT e.value FROM e WHERE e.name = regexp_replace(w.resolved, '^!*', '')), 'any'), depth + 1
          FROM w WHERE regexp_matches(w.resolved, '^!*\\$'))
      SELECT name, value, arg_max(resolved, depth) AS resolved FROM w GROUP BY 1, 2""".replace("\\\\", "\\"),
)
def _(spark, sf):
    nation = t.read(spark, sf, "nation")
    name = "concat('$N', n_nationkey) as name"
    defaults = nation.selectExpr(
        name,
        "case when n_nationkey < 5 then concat('10.', n_nationkey, '.0.0/16') when n_nationkey % 5 = 4 then '$MISSING' "
        "when n_nationkey % 2 = 0 then concat('!$N', n_nationkey - 5) else concat('$N', n_nationkey - 5) end as value",
    )
    stored = nation.filter("n_nationkey % 6 = 2").selectExpr(name, "concat('any', n_regionkey) as value")
    return resolve_variables(effective_variables(defaults, stored))


@query(
    "s12_delete_alerts",
    f"""WITH {ALERTS} SELECT rule_id, count(*) AS n FROM alerts WHERE id NOT IN (1, 2, 3, 77) GROUP BY 1""",
)
def _(spark, sf):
    rest, _ = delete_alerts(t.alerts(spark, sf), [1, 2, 3, 77])
    return rest.groupBy("rule_id").agg(F.count("*").alias("n"))
