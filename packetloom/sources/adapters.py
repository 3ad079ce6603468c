"""Network tables derived from the analytic test tables.

The same rules are written down in SQL next to the queries that use them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, dealt over all cores: its one row group is one task else, however much work a row makes."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(spark.sparkContext.defaultParallelism)


_K = "cast(get_json_object(props, '$.k') as int)"
_FLAGS = (
    "case event_type when 'signup' then 'S' when 'view' then 'SA' when 'click' then 'A' "
    "when 'purchase' then 'PA' else 'RA' end"
)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets from events; ``size`` stands for the payload length."""
    return read(spark, sf_dir, "events").selectExpr(
        "event_id as packet_no",
        "cast(ts as timestamp) as ts",
        "concat('10.0.', cast(user_id div 256 as string), '.', cast(user_id % 256 as string)) as src_ip",
        f"concat('192.168.', cast({_K} % 4 as string), '.', cast(event_id % 16 as string)) as dst_ip",
        "cast(1024 + event_id % 60000 as int) as src_port",
        "cast(1 + (event_id * 7919) % 1024 as int) as dst_port",
        f"if({_K} % 5 = 0, 'UDP', 'TCP') as proto",
        f"{_FLAGS} as tcp_flags",
        "cast(value * 100 as int) as size",
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TCP packets of a few long-lived connections from events."""
    client = "concat('10.0.0.', cast(user_id % 32 as string))"
    back = f"(event_type = 'view' or {_K} % 2 = 1)"
    return read(spark, sf_dir, "events").selectExpr(
        "event_id as packet_no",
        "cast(ts as timestamp) as ts",
        f"if({back}, '192.168.0.1', {client}) as src_ip",
        f"if({back}, {client}, '192.168.0.1') as dst_ip",
        f"cast(if({back}, 80, 1000 + user_id % 8) as int) as src_port",
        f"cast(if({back}, 1000 + user_id % 8, 80) as int) as dst_port",
        "'TCP' as proto",
        f"{_FLAGS} as tcp_flags",
    )


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections from line items: suppliers reach parts, at day grain."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber as packet_no",
        "cast(l_shipdate as timestamp) as ts",
        "cast(l_suppkey as string) as src_ip",
        "cast(l_partkey % 50 as string) as dst_ip",
        "cast(l_partkey as int) as dst_port",
        "'TCP' as proto",
    )


def auth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as packet_no",
        "cast(o_orderdate as timestamp) as ts",
        "cast(o_custkey % 97 as string) as src_ip",
        "cast(o_custkey % 7 as string) as dst_ip",
        "o_orderstatus <> 'F' as success",
        "'orders' as auth_type",
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored alerts from events; a tenth are behaviour and a twentieth correlation alerts."""
    return read(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        f"concat(case when {_K} < 10 then 'behavior:' when {_K} >= 95 then 'correlation:' else '' end, 'r_', event_type)"
        " as rule_id",
        "event_type as match_text",
        "if(user_id % 50 = 0, '', concat('10.0.', cast(user_id div 256 as string), '.', cast(user_id % 256 as string)))"
        " as src_ip",
        f"concat('192.168.0.', cast({_K} % 8 as string)) as dst_ip",
        "props as payload_preview",
        f"if({_K} % 3 = 0, cast(null as int), {_K} % 4) as priority",
        f"case {_K} % 5 when 0 then 'High' when 1 then 'medium' when 2 then 'low' when 3 then '' end as severity",
        "cast(ts as timestamp) as created_at",
    )


def alert_rules(spark: SparkSession) -> DataFrame:
    """Rules the stored alerts refer to; errors have none."""
    rows = [
        ("r_click", "Click burst", 3, ["click"]),
        ("r_purchase", "Purchase probe", 2, ["purchase", "buy"]),
        ("r_signup", "Signup flood", 1, ["signup"]),
        ("r_view", "View scan", 2, ["view"]),
        ("r_unused", "Never seen", 1, ["nothing"]),
    ]
    return spark.createDataFrame(rows, "rule_id string, name string, priority int, pattern array<string>")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One TCP packet per document with its text as payload."""
    return read(spark, sf_dir, "documents").selectExpr(
        "doc_id as packet_no",
        "timestamp_seconds(doc_id) as ts",
        "concat('10.1.', cast(doc_id div 256 % 256 as string), '.', cast(doc_id % 256 as string)) as src_ip",
        "concat('192.168.', cast(n_chars % 4 as string), '.', cast(doc_id % 200 as string)) as dst_ip",
        "cast(1024 + doc_id % 50000 as int) as src_port",
        "cast(case n_chars % 5 when 0 then 80 when 1 then 443 when 2 then 25 when 3 then 8000 + n_chars % 100 else 53 end as int)"
        " as dst_port",
        "if(n_chars % 7 = 0, 'UDP', 'TCP') as proto",
        "cast(n_chars % 65536 as int) as ip_id",
        "if(n_chars % 7 = 0, 17, 6) as ip_proto",
        "case doc_id % 3 when 0 then 'PA' when 1 then 'S' else 'FA' end as tcp_flags",
        "cast(text as binary) as payload",
        "case n_chars % 3 when 0 then 'to_server' when 1 then 'to_client' end as flow_dir",
        "case doc_id % 3 when 0 then true when 1 then false end as flow_established",
        "false as stream",
    )


def http_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HTTP request per page: its URL in the request line, its HTML as the body."""
    crlf = "'\\r\\n'"
    host = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"
    path = "if(regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1) = '', '/', regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1))"
    return read(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "url",
        f"{path} as path",
        f"{host} as host",
        "cast(html as binary) as body",
        f"cast(concat('POST ', {path}, ' HTTP/1.1', {crlf}, 'Host: ', {host}, {crlf}, 'Content-Length: ', "
        f"cast(octet_length(html) as string), {crlf}, {crlf}, html) as binary) as buf",
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TCP segments from conversation turns: some repeated, some overlapping, arrival order shuffled."""
    turns = read(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "cast(text as binary) as data")
    # a few turns per conversation: the running length stays inside one conversation
    from packetloom.operators.windows import running

    placed = running(
        turns, ["conv_id"], F.col("turn").cast("bigint"), ["turn"], {"_end": ("sum", F.length("data").cast("bigint"))}, 1 << 20
    ).selectExpr("conv_id as flow", "turn", "1000 + _end - length(data) as seq", "data")
    number = "(flow * 31 + turn * 17)"
    plain = placed.selectExpr("flow", f"cast({number} % 101 * 1000 + turn as bigint) as arrival", "seq", "data")
    again = placed.filter(f"{number} % 5 = 0").selectExpr(
        "flow", f"cast(200000 + {number} % 89 * 1000 + turn as bigint) as arrival", "seq", "data"
    )
    ahead = placed.filter(f"{number} % 7 = 0 and length(data) > 3").selectExpr(
        "flow",
        f"cast(400000 + {number} % 83 * 1000 + turn as bigint) as arrival",
        "seq + 3 as seq",
        "substring(data, 4, length(data) - 3) as data",
    )
    return plain.unionByName(again).unionByName(ahead)


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixed capture: documents as single packets, pages as requests in two segments, events without payload."""
    docs = payloads(spark, sf_dir).selectExpr(
        "packet_no", "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, packet_no) as ts", "src_ip", "dst_ip",
        "src_port", "dst_port", "proto", "ip_id", "ip_proto", "tcp_flags", "cast(1000 as bigint) as seq", "payload",
        "length(payload) as size",
    )
    half = "(length(buf) div 2)"
    pages = http_pages(spark, sf_dir).selectExpr(
        "page_id",
        f"inline(array(struct(0 as part, substring(buf, 1, {half}) as payload), struct(1 as part, substring(buf, {half} + 1, length(buf)) as payload)))",
        f"{half} as half",
    )
    web = pages.selectExpr(
        "1000000000 + page_id * 2 + part as packet_no",
        "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, page_id * 3 + part) as ts",
        "concat('10.2.0.', cast(page_id % 50 as string)) as src_ip", "'192.168.0.80' as dst_ip",
        "cast(2000 + page_id as int) as src_port", "80 as dst_port", "'TCP' as proto", "cast(page_id as int) as ip_id",
        "6 as ip_proto", "'PA' as tcp_flags", "cast(1000 + part * half as bigint) as seq", "payload", "length(payload) as size",
    )
    bare = packets(spark, sf_dir).selectExpr(
        "2000000000 + packet_no as packet_no", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "proto",
        "cast(packet_no % 65536 as int) as ip_id", "if(proto = 'TCP', 6, 17) as ip_proto", "tcp_flags",
        "cast(1000 as bigint) as seq", "cast(null as binary) as payload", "size",
    )
    return docs.unionByName(web).unionByName(bare)
