"""SQL of the derived network tables, for the SQL side of the queries."""

K = "CAST(json_extract_string(props, '$.k') AS INT)"
IP = "'10.0.' || (user_id // 256) || '.' || (user_id % 256)"
FLAGS = (
    "CASE event_type WHEN 'signup' THEN 'S' WHEN 'view' THEN 'SA' WHEN 'click' THEN 'A' "
    "WHEN 'purchase' THEN 'PA' ELSE 'RA' END"
)

PACKETS = f"""packets AS (
  SELECT event_id AS packet_no, ts, {IP} AS src_ip,
    '192.168.' || ({K} % 4) || '.' || (event_id % 16) AS dst_ip,
    CAST(1024 + event_id % 60000 AS INT) AS src_port, CAST(1 + (event_id * 7919) % 1024 AS INT) AS dst_port,
    CASE WHEN {K} % 5 = 0 THEN 'UDP' ELSE 'TCP' END AS proto, {FLAGS} AS tcp_flags,
    CAST(trunc(value * 100) AS INT) AS size
  FROM events)"""

BACK = f"(event_type = 'view' OR {K} % 2 = 1)"
CLIENT = "'10.0.0.' || (user_id % 32)"
FLOWS = f"""flows AS (
  SELECT event_id AS packet_no, ts,
    CASE WHEN {BACK} THEN '192.168.0.1' ELSE {CLIENT} END AS src_ip,
    CASE WHEN {BACK} THEN {CLIENT} ELSE '192.168.0.1' END AS dst_ip,
    CAST(CASE WHEN {BACK} THEN 80 ELSE 1000 + user_id % 8 END AS INT) AS src_port,
    CAST(CASE WHEN {BACK} THEN 1000 + user_id % 8 ELSE 80 END AS INT) AS dst_port,
    {FLAGS} AS tcp_flags
  FROM events)"""

CONNECTIONS = """conns AS (
  SELECT l_orderkey * 8 + l_linenumber AS packet_no, l_shipdate AS ts, CAST(l_suppkey AS VARCHAR) AS src_ip,
    CAST(l_partkey % 50 AS VARCHAR) AS dst_ip, CAST(l_partkey AS INT) AS dst_port
  FROM lineitem)"""

AUTH = """auth AS (
  SELECT o_orderkey AS packet_no, o_orderdate AS ts, CAST(o_custkey % 97 AS VARCHAR) AS src_ip,
    CAST(o_custkey % 7 AS VARCHAR) AS dst_ip, o_orderstatus <> 'F' AS success
  FROM orders)"""

ALERTS = f"""alerts AS (
  SELECT event_id AS id,
    (CASE WHEN {K} < 10 THEN 'behavior:' WHEN {K} >= 95 THEN 'correlation:' ELSE '' END) || 'r_' || event_type AS rule_id,
    event_type AS match_text, CASE WHEN user_id % 50 = 0 THEN '' ELSE {IP} END AS src_ip,
    '192.168.0.' || ({K} % 8) AS dst_ip, props AS payload_preview,
    CASE WHEN {K} % 3 = 0 THEN NULL ELSE {K} % 4 END AS priority,
    CASE {K} % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN '' END AS severity,
    ts AS created_at
  FROM events)"""

ALERT_RULES = """rules(rule_id, name, priority, pattern) AS (
  VALUES ('r_click', 'Click burst', 3, 'click'), ('r_purchase', 'Purchase probe', 2, 'purchase, buy'),
    ('r_signup', 'Signup flood', 1, 'signup'), ('r_view', 'View scan', 2, 'view'), ('r_unused', 'Never seen', 1, 'nothing'))"""

PAYLOADS = """payloads AS (
  SELECT doc_id AS packet_no, '10.1.' || (doc_id // 256 % 256) || '.' || (doc_id % 256) AS src_ip,
    '192.168.' || (n_chars % 4) || '.' || (doc_id % 200) AS dst_ip,
    CAST(1024 + doc_id % 50000 AS INT) AS src_port,
    CAST(CASE n_chars % 5 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 25 WHEN 3 THEN 8000 + n_chars % 100 ELSE 53 END AS INT) AS dst_port,
    CASE WHEN n_chars % 7 = 0 THEN 'UDP' ELSE 'TCP' END AS proto,
    CAST(n_chars % 65536 AS INT) AS ip_id, CASE WHEN n_chars % 7 = 0 THEN 17 ELSE 6 END AS ip_proto,
    CASE doc_id % 3 WHEN 0 THEN 'PA' WHEN 1 THEN 'S' ELSE 'FA' END AS tcp_flags,
    text, strlen(text) AS size,
    CASE n_chars % 3 WHEN 0 THEN 'to_server' WHEN 1 THEN 'to_client' END AS flow_dir,
    CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flow_established
  FROM documents)"""


def silenced(rows: str, key: str, seconds: float, inclusive: bool, order: str = "packet_no") -> str:
    """Recursive CTE ``emitted``: rows of ``rows`` (with ``ts``) left by emit-then-silence per key.

    Jumps from one emission to the first row after its silence, one row per key and step.
    """
    op = ">" if inclusive else ">="
    return f"""ranked AS (
      SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts, {order}) AS rn FROM {rows}),
    emitted_keys AS (
      SELECT {key}, ts, rn FROM ranked WHERE rn = 1
      UNION ALL
      SELECT {', '.join('e.' + k.strip() for k in key.split(','))}, n.ts, n.rn FROM emitted_keys e,
        LATERAL (SELECT r.ts, r.rn FROM ranked r
          WHERE {' AND '.join(f'r.{k.strip()} = e.{k.strip()}' for k in key.split(','))}
            AND r.ts {op} e.ts + INTERVAL {int(seconds * 1000)} MILLISECOND
          ORDER BY r.rn LIMIT 1) n),
    emitted AS (SELECT r.* FROM ranked r SEMI JOIN emitted_keys USING ({key}, rn))"""
