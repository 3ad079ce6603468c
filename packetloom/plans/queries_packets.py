"""Packet field, protocol, HTTP and flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions import http, packet
from packetloom.operators import byte_stream, flows
from packetloom.operators.matching import match_packets
from packetloom.operators.windows import from_micros, running
from packetloom.plans.registry import query
from packetloom.plans.sql_tables import FLOWS, PACKETS, K, silenced
from packetloom.sources import adapters as t

_E = "cast(get_json_object(props, '$.k') as int)"


def _events(spark, sf):
    return t.read(spark, sf, "events").withColumn("k", F.expr(_E))


# --------------------------------------------------------------------------- headers and ports


@query(
    "p1_headers",
    f"""SELECT event_id AS packet_no, CASE WHEN {K} % 3 = 0 THEN 'ICMP' ELSE 'TCP' END AS proto,
      CAST(CASE WHEN {K} % 3 = 0 THEN 8 ELSE 1024 + event_id % 60000 END AS INT) AS src_port,
      CAST(CASE WHEN {K} % 3 = 0 THEN {K} % 16 ELSE 80 END AS INT) AS dst_port FROM events WHERE {K} % 3 <> 2""",
)
def _(spark, sf):
    rows = _events(spark, sf).selectExpr(
        "event_id as packet_no",
        "case k % 3 when 0 then 'ICMP' when 1 then 'TCP' end as proto",
        "cast(1024 + event_id % 60000 as int) as src_port",
        "80 as dst_port",
        "8 as icmp_type",
        "k % 16 as icmp_code",
    )
    return packet.header_projection(rows).select("packet_no", "proto", "src_port", "dst_port")


@query(
    "p2_tls",
    f"""SELECT event_id, ({K} % 32 BETWEEN 20 AND 23) AND {K} % 8 <= 4 AND event_id % 3 <> 0 AS tls FROM events""",
)
def _(spark, sf):
    # third byte by k, one in three too short
    payload = F.expr(
        "unhex(concat(lpad(hex(k % 32), 2, '0'), '03', lpad(hex(k % 8), 2, '0'), if(event_id % 3 = 0, '00', '001122')))"
    )
    return _events(spark, sf).select("event_id", packet.is_tls_record(payload).alias("tls"))


_TEXTS = "['GET /index HTTP/1.1', '   post /x HTTP/1.1', 'HTTP/1.1 200 OK', 'x-a: 1 HOST: example', 'plain words only', 'GET', 'Cookie: abc', 'nothing at all here, far beyond the first fifty bytes host: x']"


@query(
    "p3_http",
    f"""SELECT event_id, {K} % 8 IN (0, 1, 2, 3, 6) AS http FROM events""",
)
def _(spark, sf):
    text = F.expr(f"array({_TEXTS[1:-1]})[k % 8]").cast("binary")
    return _events(spark, sf).select("event_id", packet.is_likely_http(text).alias("http"))


_PORTS = "[53, 22, 21, 20, 25, 587, 465, 110, 995, 143, 993, 23, 80, 8080]"


@query(
    "p4_app_proto",
    f"""WITH x AS (SELECT event_id, {K} % 8 AS w, event_id % 2 = 0 AS tcp, {_PORTS}[CAST(event_id % 14 + 1 AS INT)] AS a,
        {_PORTS}[CAST(user_id % 14 + 1 AS INT)] AS b FROM events)
      SELECT event_id, CASE WHEN tcp AND w IN (0, 1, 2, 3, 6) THEN 'http' WHEN 53 IN (a, b) THEN 'dns' WHEN 22 IN (a, b) THEN 'ssh'
        WHEN 21 IN (a, b) OR 20 IN (a, b) THEN 'ftp' WHEN 25 IN (a, b) OR 587 IN (a, b) OR 465 IN (a, b) THEN 'smtp'
        WHEN 110 IN (a, b) OR 995 IN (a, b) THEN 'pop3' WHEN 143 IN (a, b) OR 993 IN (a, b) THEN 'imap'
        WHEN 23 IN (a, b) THEN 'telnet' END AS app FROM x""",
)
def _(spark, sf):
    ports = f"array({_PORTS[1:-1]})"
    rows = _events(spark, sf).selectExpr(
        "event_id",
        "if(event_id % 2 = 0, 'TCP', 'UDP') as proto",
        f"{ports}[event_id % 14] as a",
        f"{ports}[user_id % 14] as b",
        f"cast(array({_TEXTS[1:-1]})[k % 8] as binary) as payload",
    )
    return rows.select(
        "event_id", packet.app_protocol(F.col("proto"), F.col("a"), F.col("b"), F.col("payload")).alias("app")
    )


@query(
    "p5_flow_id",
    f"WITH {PACKETS} SELECT packet_no, proto || ':' || src_ip || ':' || src_port || '->' || dst_ip || ':' || dst_port AS flow FROM packets",
)
def _(spark, sf):
    flow = packet.directed_flow_id(*[F.col(c) for c in ("proto", "src_ip", "src_port", "dst_ip", "dst_port")])
    return t.packets(spark, sf).select("packet_no", flow.alias("flow"))


@query(
    "p6_flow_key",
    f"""WITH {FLOWS} SELECT least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) || '<->' ||
        greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS flow, count(*) AS n FROM flows GROUP BY 1""",
)
def _(spark, sf):
    flow = packet.flow_key(*[F.col(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port")])
    return t.flows(spark, sf).groupBy(flow.alias("flow")).agg(F.count("*").alias("n"))


@query(
    "p7_flag_set",
    f"""WITH {PACKETS} SELECT packet_no, CASE tcp_flags WHEN 'PA' THEN 'A,P' WHEN 'RA' THEN 'A,R' WHEN 'SA' THEN 'A,S' ELSE tcp_flags END AS flags FROM packets""",
)
def _(spark, sf):
    doubled = F.concat(F.lower("tcp_flags"), F.lit("+"), F.col("tcp_flags"))
    return t.packets(spark, sf).select(
        "packet_no", F.array_join(F.array_sort(packet.flag_set(doubled)), ",").alias("flags")
    )


_HOST = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"


@query(
    "p8_dns",
    f"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'response' ELSE 'query' END AS query_type, {_HOST} AS domain,
      CASE page_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' WHEN 2 THEN 'MX' ELSE 'UNKNOWN(99)' END AS record_type FROM pages""",
)
def _(spark, sf):
    question = F.expr(
        f"concat(unhex(if(page_id % 5 = 0, '12348100000100000000', '12340100000100000000')), unhex('0000'), "
        f"cast(array_join(transform(split({_HOST}, '[.]'), l -> concat(chr(length(l)), l)), '') as binary), "
        "unhex(concat('00', array('0001', '001C', '000F', '0063')[page_id % 4], '0001')))"
    )
    asked = t.read(spark, sf, "pages").select("page_id", question.alias("payload"))
    return asked.select("page_id", packet.dns_question(F.col("payload")).alias("q")).select("page_id", "q.*")


# every line of a document becomes a mail line of one of four shapes
def _shaped(words):
    cases = " ".join(f"when {i} then concat('{w}', line)" for i, w in enumerate(words))
    return F.expr(
        f"array_join(transform(split(text, '\\n'), (line, i) -> case i % {len(words) + 1} {cases} else line end), '\\r\\n')"
    )


_LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"""


@query(
    "p9_smtp",
    f"""WITH {_LINES}, shaped AS (SELECT doc_id, regexp_replace(CASE i % 4 WHEN 0 THEN 'mail from:' || line WHEN 1 THEN '250 ' || line
        WHEN 2 THEN 'To: a@b ' || line ELSE line END, '^\\s+|\\s+$', '', 'g') AS s FROM lines),
      typed AS (SELECT doc_id, CASE WHEN s = '' THEN 'none'
        WHEN regexp_matches(upper(s), '^(EHLO|HELO|MAIL FROM|RCPT TO|DATA|QUIT|RSET|NOOP|VRFY|EXPN|HELP)') THEN 'command'
        WHEN regexp_matches(s, '^[0-9]{{3}}\\s') THEN 'response'
        WHEN contains(s, '@') AND regexp_matches(lower(s), 'from:|to:') THEN 'email' END AS kind, s FROM shaped)
      SELECT doc_id, CAST(count(*) FILTER (WHERE kind = 'command') AS INT) AS commands,
        CAST(count(*) FILTER (WHERE kind = 'response') AS INT) AS responses, CAST(count(*) FILTER (WHERE kind = 'email') AS INT) AS emails
      FROM typed GROUP BY 1""",
)
def _(spark, sf):
    out = packet.smtp_lines(_shaped(["mail from:", "250 ", "To: a@b "]))
    return t.read(spark, sf, "documents").select(
        "doc_id", *[F.size(out[n]).alias(n) for n in ("commands", "responses", "emails")]
    )


@query(
    "p10_pop3",
    f"""WITH {_LINES}, shaped AS (SELECT doc_id, i, regexp_replace(CASE i % 4 WHEN 0 THEN 'retr ' || line WHEN 1 THEN '+OK ' || line
        WHEN 2 THEN '-ERR' || line ELSE line END, '^\\s+|\\s+$', '', 'g') AS s FROM lines)
      SELECT doc_id, coalesce(string_agg(s, '|' ORDER BY i) FILTER (WHERE regexp_matches(upper(s), '^(USER|PASS|STAT|LIST|RETR|DELE|NOOP|RSET|QUIT|TOP|UIDL)')), '') AS commands,
        CAST(count(*) FILTER (WHERE (starts_with(s, '+OK') OR starts_with(s, '-ERR'))) AS INT) AS responses FROM shaped GROUP BY 1""",
)
def _(spark, sf):
    out = packet.pop3_lines(_shaped(["retr ", "+OK ", "-ERR"]))
    return t.read(spark, sf, "documents").select(
        "doc_id", F.array_join(out["commands"], "|").alias("commands"), F.size(out["responses"]).alias("responses")
    )


@query(
    "p11_detect",
    f"""WITH x AS (SELECT event_id, {K} % 8 AS w, event_id % 3 AS l4, {_PORTS}[CAST(event_id % 14 + 1 AS INT)] AS a,
        {_PORTS}[CAST(user_id % 14 + 1 AS INT)] AS b FROM events),
      y AS (SELECT *, CASE WHEN a = 53 THEN 'dns' WHEN a IN (25, 587, 465) THEN 'smtp' WHEN a IN (110, 995) THEN 'pop3'
        WHEN b = 53 THEN 'dns' WHEN b IN (25, 587, 465) THEN 'smtp' WHEN b IN (110, 995) THEN 'pop3' END AS by_port FROM x)
      SELECT event_id, CASE WHEN by_port IS NOT NULL OR l4 = 2 THEN by_port WHEN w IN (0, 1, 2) THEN 'http' WHEN w IN (3, 4, 7) THEN 'dns' END AS found FROM y""",
)
def _(spark, sf):
    ports = f"array({_PORTS[1:-1]})"
    # the one text with leading blanks is found by its "http/", "Cookie: abc" is shorter than a DNS header
    rows = _events(spark, sf).selectExpr(
        "event_id",
        "array('TCP', 'UDP', 'ICMP')[event_id % 3] as proto",
        f"{ports}[event_id % 14] as a",
        f"{ports}[user_id % 14] as b",
        f"cast(array({_TEXTS[1:-1]})[k % 8] as binary) as payload",
    )
    found = packet.detect_protocol(F.col("a"), F.col("b"), F.col("proto"), F.col("payload"))
    return rows.select("event_id", found.alias("found"))


@query(
    "p12_request_line",
    """WITH x AS (SELECT doc_id, string_split_regex(regexp_replace(string_split(text, chr(10))[1], '^\\s+|\\s+$', '', 'g'), '\\s+') AS w FROM documents)
      SELECT doc_id, CASE WHEN len(w) >= 3 THEN w[1] END AS method, CASE WHEN len(w) >= 3 THEN w[2] END AS uri,
        CASE WHEN len(w) >= 3 THEN w[3] END AS version FROM x""",
)
def _(spark, sf):
    line = packet.request_line(F.col("text"))
    return t.read(spark, sf, "documents").select("doc_id", line.alias("l")).select("doc_id", "l.*")


@query(
    "p13_sticky",
    """SELECT doc_id, 'smtp_command' AS buffer, 'MAIL FROM:' || regexp_replace(string_split(text, chr(10))[1], '\\s+$', '') AS content FROM documents WHERE n_chars % 2 = 0
      UNION ALL SELECT doc_id, 'raw', 'MAIL FROM:' || string_split(text, chr(10))[1] || chr(13) || chr(10) || '250 ok' FROM documents""",
)
def _(spark, sf):
    payload = F.expr("cast(concat('MAIL FROM:', split(text, '\\n')[0], '\\r\\n', '250 ok') as binary)")
    app = F.expr("if(n_chars % 2 = 0, 'smtp', 'ssh')")
    buffers = packet.sticky_buffers(app, F.lit("TCP"), payload)
    return t.read(spark, sf, "documents").select("doc_id", F.explode(buffers).alias("buffer", "content")).withColumn(
        "content", F.col("content").cast("string")
    )


# --------------------------------------------------------------------------- HTTP


def _buffers(spark, sf):
    """Three pages sent one after the other on one connection, as one value."""
    pages = t.http_pages(spark, sf)
    sent = F.array_sort(F.collect_list(F.struct("page_id", F.hex("buf").alias("h"))))
    joined = pages.groupBy(F.expr("page_id div 3").alias("conn")).agg(sent.alias("sent"))
    return joined.select("conn", F.expr("unhex(array_join(transform(sent, p -> p.h), ''))").alias("buf"))


@query(
    "p14_http_requests",
    f"""SELECT page_id // 3 AS conn, 'POST' AS method,
      CASE WHEN regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1) END AS path,
      {_HOST} AS host, md5(html) AS body, CAST(strlen(html) AS INT) AS size FROM pages""",
)
def _(spark, sf):
    found = http.http_requests(F.col("buf"))
    rows = _buffers(spark, sf).select("conn", F.explode(found["messages"]).alias("m"))
    return rows.select(
        "conn", "m.method", "m.path", F.col("m.headers")["host"].alias("host"), F.md5("m.body").alias("body"),
        F.length("m.body").alias("size"),
    )


@query(
    "p15_http_responses",
    """SELECT doc_id, CAST(200 + n_chars % 300 AS INT) AS status_code, 'All is ' || lang AS status_text, source AS server, md5(text) AS body FROM documents""",
)
def _(spark, sf):
    buf = F.expr(
        "cast(concat('HTTP/1.1 ', cast(200 + n_chars % 300 as string), ' All is ', lang, '\\r\\n', 'SERVER:  ', source, ' \\r\\n', "
        "'Content-Length: ', cast(octet_length(text) as string), '\\r\\n\\r\\n', text, 'HTTP/1.1 200 OK\\r\\nContent-Length: 5\\r\\n\\r\\nHel') as binary)"
    )
    found = http.http_responses(buf)
    rows = t.read(spark, sf, "documents").select("doc_id", F.explode(found["messages"]).alias("m"))
    return rows.select(
        "doc_id", "m.status_code", "m.status_text", F.col("m.headers")["server"].alias("server"), F.md5("m.body").alias("body")
    )


def _pipelined(spark, sf):
    """Three pages sent one after the other on one connection, in packets of up to 1000 bytes: pieces of streams."""
    pages = t.http_pages(spark, sf).withColumn("flow", F.expr("page_id div 3"))
    size = F.length("buf").cast("bigint")
    placed = running(pages, ["flow"], F.col("page_id").cast("bigint"), ["page_id"], {"_end": ("sum", size)}, 1 << 20)
    cuts = F.expr("sequence(0, length(buf) - 1, 1000)")
    sent = placed.select("flow", (F.col("_end") - size).alias("_from"), "buf", F.explode(cuts).alias("_cut"))
    return sent.select("flow", (F.col("_from") + F.col("_cut")).alias("start"), F.expr("substring(buf, _cut + 1, 1000)").alias("data"))


@query(
    "p14_stream_requests",
    f"""SELECT page_id // 3 AS conn, 'POST' AS method,
      CASE WHEN regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1) END AS path,
      {_HOST} AS host, md5(html) AS body, CAST(strlen(html) AS INT) AS size FROM pages""",
)
def _(spark, sf):
    rows = byte_stream.http_messages(byte_stream.blocks(_pipelined(spark, sf)))
    return rows.select(
        F.col("flow").alias("conn"), "m.method", "m.path", F.col("m.headers")["host"].alias("host"), F.md5("m.body").alias("body"),
        F.length("m.body").alias("size"),
    )


@query(
    "p15_stream_responses",
    """SELECT doc_id, CAST(200 + n_chars % 300 AS INT) AS status_code, 'All is ' || lang AS status_text, source AS server, md5(text) AS body FROM documents""",
)
def _(spark, sf):
    buf = F.expr(
        "cast(concat('HTTP/1.1 ', cast(200 + n_chars % 300 as string), ' All is ', lang, '\\r\\n', 'SERVER:  ', source, ' \\r\\n', "
        "'Content-Length: ', cast(octet_length(text) as string), '\\r\\n\\r\\n', text, 'HTTP/1.1 200 OK\\r\\nContent-Length: 5\\r\\n\\r\\nHel') as binary)"
    )
    # each document is a connection of its own, in two packets
    half = t.read(spark, sf, "documents").select(F.col("doc_id").alias("flow"), buf.alias("buf")).withColumn("_half", F.expr("length(buf) div 2"))
    parts = "inline(array(struct(7L as start, substring(buf, 1, _half) as data), struct(7L + _half as start, substring(buf, _half + 1, length(buf)) as data)))"
    rows = byte_stream.http_messages(byte_stream.blocks(half.selectExpr("flow", parts)), responses=True).withColumnRenamed("flow", "doc_id")
    return rows.select(
        "doc_id", "m.status_code", "m.status_text", F.col("m.headers")["server"].alias("server"), F.md5("m.body").alias("body")
    )


@query(
    "p16_header_map",
    """SELECT doc_id, lang AS a, source || ':x' AS b, CAST(2 AS INT) AS n FROM documents""",
)
def _(spark, sf):
    block = F.expr("concat('GET / HTTP/1.1\\r\\nA: zz\\r\\nno colon here\\r\\n b : ', source, ':x\\r\\na:', lang)")
    headers = http.header_map(block)
    return t.read(spark, sf, "documents").select(
        "doc_id", headers["a"].alias("a"), headers["b"].alias("b"), F.size(headers).alias("n")
    )


@query("p17_dechunk", "SELECT doc_id, md5(text) AS body FROM documents")
def _(spark, sf):
    # two chunks per document, the first with an extension, and data after the last chunk
    # (a text of one byte has it in the first; an empty text is a zero chunk, which ends the body at once)
    half = "((octet_length(text) + 1) div 2)"
    rest = f"(octet_length(text) - {half})"
    raw = "cast(text as binary)"
    chunked = F.expr(
        f"concat(cast(concat('00000000', hex({half}), ';ext=1\\r\\n') as binary), substring({raw}, 1, {half}), "
        f"cast(concat('\\r\\n', lower(hex({rest})), '\\r\\n') as binary), substring({raw}, {half} + 1, {rest}), "
        "cast('\\r\\n0\\r\\n\\r\\n12\\r\\nignored' as binary))"
    )
    body = F.encode(http.dechunk(packet.latin1(chunked)), "ISO-8859-1")
    docs = t.read(spark, sf, "documents")
    return docs.select("doc_id", F.md5(body).alias("body"))


@query(
    "p19_carrier",
    f"""WITH x AS (SELECT page_id, CASE WHEN regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1) END AS path,
        {_HOST} AS host, html FROM pages)
      SELECT page_id, md5('POST ' || path || ' HTTP/1.1' || chr(13) || chr(10) || 'host: ' || host || chr(13) || chr(10) || 'content-length: ' || strlen(html) ||
        chr(13) || chr(10) || chr(13) || chr(10) || html || chr(10) || chr(10) || url_decode(replace(path, '+', ' ')) || chr(10) || html) AS carrier FROM x""",
)
def _(spark, sf):
    message = F.get(http.http_requests(F.col("buf"))["messages"], F.lit(0))
    rows = t.http_pages(spark, sf).select("page_id", message.alias("m"))
    return rows.select("page_id", F.md5(http.request_carrier(F.col("m"))).alias("carrier"))


@query(
    "p20_status_line",
    """SELECT doc_id, 'HTTP/1.1 ' || (200 + n_chars % 300) || ' ' || lang AS line FROM documents""",
)
def _(spark, sf):
    response = F.struct(
        F.lit("HTTP/1.1").alias("version"),
        F.expr("cast(200 + n_chars % 300 as int)").alias("status_code"),
        F.col("lang").alias("status_text"),
    )
    return t.read(spark, sf, "documents").select("doc_id", http.response_carrier(response).cast("string").alias("line"))


@query(
    "p29_parts",
    f"""SELECT page_id, 'POST' AS method, CASE WHEN regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1) END AS uri,
      'Host: ' || {_HOST} || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) AS headers, '' AS cookie, md5(html) AS body FROM pages""",
)
def _(spark, sf):
    parts = http.payload_parts(F.col("buf"))
    rows = t.http_pages(spark, sf).select("page_id", parts.alias("p"))
    return rows.select("page_id", "p.method", "p.uri", "p.headers", "p.cookie", F.md5("p.body").alias("body"))


# --------------------------------------------------------------------------- flows


@query(
    "t1_handshake",
    f"""WITH {FLOWS}, keyed AS (SELECT *, src_ip || ':' || src_port AS here, dst_ip || ':' || dst_port AS there,
        least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) || '<->' || greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS flow FROM flows),
      placed AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY ts, packet_no) AS n FROM keyed),
      seen AS (SELECT *, max(CASE WHEN tcp_flags = 'S' THEN n END) OVER w AS syn, min(CASE WHEN tcp_flags = 'SA' THEN n END) OVER w AS answer,
        max(CASE WHEN contains(tcp_flags, 'A') THEN n END) OVER w AS ack
        FROM placed WINDOW w AS (PARTITION BY flow ORDER BY n ROWS UNBOUNDED PRECEDING)),
      named AS (SELECT s.*, CASE WHEN s.syn IS NOT NULL THEN y.here ELSE a.there END AS client FROM seen s
        LEFT JOIN placed y ON y.flow = s.flow AND y.n = s.syn LEFT JOIN placed a ON a.flow = s.flow AND a.n = s.answer)
      SELECT packet_no, flow, CASE WHEN syn IS NOT NULL THEN coalesce(ack > syn, false) ELSE answer IS NOT NULL END AS flow_established,
        CASE WHEN client = here THEN 'to_server' WHEN client = there THEN 'to_client' END AS flow_dir FROM named""",
)
def _(spark, sf):
    out = flows.flow_state(t.flows(spark, sf))
    return out.select("packet_no", "flow", "flow_established", "flow_dir")


_SEGMENTS = """turns AS (SELECT conv_id AS flow, turn, hex(encode(text)) AS h, strlen(text) AS n FROM conversations),
      placed AS (SELECT *, 1000 + sum(n) OVER (PARTITION BY flow ORDER BY turn ROWS UNBOUNDED PRECEDING) - n AS seq, flow * 31 + turn * 17 AS num FROM turns),
      segments AS (SELECT flow, num % 101 * 1000 + turn AS arrival, seq, h, n FROM placed
        UNION ALL SELECT flow, 200000 + num % 89 * 1000 + turn, seq, h, n FROM placed WHERE num % 5 = 0
        UNION ALL SELECT flow, 400000 + num % 83 * 1000 + turn, seq + 3, substr(h, 7), n - 3 FROM placed WHERE num % 7 = 0 AND n > 3),
      base AS (SELECT flow, arg_min(seq, arrival) AS base FROM segments WHERE n > 0 GROUP BY 1),
      ahead AS (SELECT s.*, b.base, greatest(coalesce(max(seq + n) OVER (PARTITION BY flow ORDER BY seq, n DESC, arrival
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), base), base) AS until FROM segments s JOIN base b USING (flow) WHERE n > 0),
      pieces AS (SELECT flow, arrival, greatest(seq, until) AS start, substr(h, CAST(2 * (greatest(seq, until) - seq) + 1 AS BIGINT)) AS h, seq > until AS hole
        FROM ahead WHERE seq + n > greatest(seq, until)),
      done AS (SELECT *, coalesce(start < min(CASE WHEN hole THEN start END) OVER (PARTITION BY flow), true) AS contiguous FROM pieces)"""


@query(
    "t2_reassembly",
    f"WITH {_SEGMENTS} SELECT flow, arrival, CAST(start AS BIGINT) AS start, md5(h) AS data, contiguous FROM done",
)
def _(spark, sf):
    pieces = flows.reassemble(t.segments(spark, sf))
    return pieces.select("flow", "arrival", "start", F.md5(F.hex("data")).alias("data"), "contiguous")


@query(
    "t2_wrap",
    f"""WITH {_SEGMENTS} SELECT flow, arrival, CAST(start - base + (base + 4294965000) % 4294967296 AS BIGINT) AS start, md5(h) AS data, contiguous
      FROM done JOIN base USING (flow)""",
)
def _(spark, sf):
    # the same segments where sequence numbers begin anew within most flows
    pieces = flows.reassemble(t.segments(spark, sf).withColumn("seq", F.expr("(seq + 4294965000) % 4294967296")))
    return pieces.select("flow", "arrival", "start", F.md5(F.hex("data")).alias("data"), "contiguous")


@query(
    "t2_long",
    """WITH turns AS (SELECT conv_id AS flow, turn, 2147000000 - strlen(text) AS size, (conv_id + turn) % 3 = 0 AS again FROM conversations),
        placed AS (SELECT *, 4000000000 + sum(size) OVER (PARTITION BY flow ORDER BY turn) - size AS start FROM turns)
      SELECT flow, CAST(2 * turn AS BIGINT) AS arrival, CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS stop FROM placed""",
)
def _(spark, sf):
    # every turn stands for nearly 2 GiB, a third are sent twice: sequence numbers begin anew several times in a flow
    turns = t.read(spark, sf, "conversations").selectExpr("conv_id as flow", "turn", "2147000000L - octet_length(text) as size")
    placed = running(turns, ["flow"], F.col("turn").cast("bigint"), ["turn"], {"_end": ("sum", F.col("size"))}, 1 << 20)
    sent = placed.selectExpr("flow", "cast(2 * turn as bigint) as arrival", "(4000000000L + _end - size) % 4294967296 as seq", "size", "turn")
    again = sent.filter("(flow + turn) % 3 = 0").withColumn("arrival", F.col("arrival") + 1)
    return byte_stream.releases(sent.unionByName(again).drop("turn")).select("flow", "arrival", "start", "stop")


@query(
    "t2_connections",
    f"""WITH {FLOWS}, f AS (SELECT packet_no, src_ip || '|' || dst_ip AS flow, epoch_us(ts) AS us,
          CASE WHEN tcp_flags LIKE '%S%' AND tcp_flags NOT LIKE '%A%' THEN 1 ELSE 0 END AS syn FROM flows),
        m AS (SELECT *, max(us * 2 + syn) OVER (PARTITION BY flow ORDER BY us, packet_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
        s AS (SELECT *, CASE WHEN before IS NULL OR us - before // 2 > 7200000000 OR (syn = 1 AND before % 2 = 0) THEN 1 ELSE 0 END AS start FROM m)
      SELECT packet_no, CAST(sum(start) OVER (PARTITION BY flow ORDER BY us, packet_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS connection FROM s""",
)
def _(spark, sf):
    packets = t.flows(spark, sf).withColumn("flow", F.concat("src_ip", F.lit("|"), "dst_ip"))
    return flows.connections(packets, idle=7200)


@query(
    "t2_flow_bytes",
    f"""WITH {_SEGMENTS} SELECT flow, md5(string_agg(h, '' ORDER BY start)) AS data, CAST(sum(length(h) // 2) AS INT) AS size FROM done WHERE contiguous GROUP BY 1""",
)
def _(spark, sf):
    whole = flows.flow_bytes(flows.reassemble(t.segments(spark, sf)))
    return whole.select("flow", F.md5(F.hex("data")).alias("data"), F.length("data").alias("size"))


@query(
    "t3_tail_buffer",
    """SELECT conv_id AS flow, md5(right(string_agg(hex(encode(text)), '' ORDER BY turn), 1000)) AS tail FROM conversations GROUP BY 1""",
)
def _(spark, sf):
    chunks = t.read(spark, sf, "conversations").selectExpr("conv_id as flow", "turn as arrival", "cast(text as binary) as data")
    return flows.tail_buffer(chunks, 500).select("flow", F.md5(F.hex("buffer")).alias("tail"))


@query(
    "t4_contexts",
    f"""WITH {FLOWS} SELECT src_ip || '|' || dst_ip AS flow, min(ts) AS first_seen, max(ts) AS last_seen FROM flows GROUP BY 1
      HAVING max(ts) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 2 HOUR""",
)
def _(spark, sf):
    rows = t.flows(spark, sf).withColumn("flow", F.concat("src_ip", F.lit("|"), "dst_ip"))
    return flows.live_contexts(rows, "2024-01-30 12:00:00", 7200)


@query(
    "t5_stream_match",
    f"""WITH {_SEGMENTS} SELECT flow, arrival, rule_id FROM done, (VALUES ('elle', '656C6C65'), ('ung', '756E67'), ('the', '74686520')) r(rule_id, lit)
      WHERE contiguous AND regexp_matches(h, '^(..)*?' || lit)""",
)
def _(spark, sf):
    from packetloom.plans.queries_rules import literal_rules

    pieces = flows.reassemble(t.segments(spark, sf)).filter("contiguous")
    chunks = pieces.selectExpr(
        "flow", "arrival", "arrival as packet_no", "'10.0.0.1' as src_ip", "'10.0.0.2' as dst_ip", "1 as src_port",
        "2 as dst_port", "'TCP' as proto", "data as payload", "true as stream",
    )
    rules = literal_rules(spark, {"elle": "elle", "ung": "ung", "the": "the "}, flow="only_stream")
    return match_packets(chunks, rules).select("flow", "arrival", "rule_id")


@query(
    "t5_released_chunks",
    f"""WITH {_SEGMENTS},
        bytes AS (SELECT flow, arrival, seq + i AS pos, substr(h, 2 * i + 1, 2) AS b FROM (SELECT flow, arrival, seq, h, unnest(range(n)) AS i FROM segments)),
        firsts AS (SELECT flow, pos, min(arrival) AS arrival, min(b) AS b FROM bytes JOIN base USING (flow) WHERE pos >= base GROUP BY flow, pos),
        freed AS (SELECT *, max(arrival) OVER w AS released, pos - base = row_number() OVER w - 1 AS whole FROM firsts JOIN base USING (flow) WINDOW w AS (PARTITION BY flow ORDER BY pos))
      SELECT flow, CAST(released AS BIGINT) AS arrival, CAST(min(pos) AS BIGINT) AS start, md5(string_agg(b, '' ORDER BY pos)) AS data FROM freed WHERE whole GROUP BY flow, released""",
)
def _(spark, sf):
    chunks = byte_stream.released_chunks(t.segments(spark, sf))
    return chunks.select("flow", "arrival", "start", F.md5(F.hex("data")).alias("data"))


@query(
    "t7_http_dedupe",
    f"""WITH RECURSIVE rows AS (SELECT event_id AS packet_no, ts, user_id % 20 AS flow, event_type || ({K} % 2) AS raw FROM events),
      {silenced('rows', 'flow, raw', 86400, True)} SELECT packet_no, flow, raw FROM emitted""",
)
def _(spark, sf):
    rows = _events(spark, sf).selectExpr(
        "event_id as packet_no", "cast(ts as timestamp) as ts", "user_id % 20 as flow", "0 as msg_no",
        "cast(concat(event_type, k % 2) as binary) as raw",
    )
    kept = flows.dedupe_requests(rows, 86400)
    return kept.select("packet_no", "flow", F.col("raw").cast("string").alias("raw"))


@query(
    "t9_route",
    f"""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'ip' WHEN event_id % 3 = 0 AND {K} % 8 IN (0, 1, 2, 3, 6) THEN 'http'
      WHEN event_id % 3 = 0 AND {K} % 8 = 5 AND {K} % 3 = 0 THEN 'skip_tls' ELSE 'raw' END AS route FROM events""",
)
def _(spark, sf):
    payload = F.expr(f"if(k % 8 = 5 and k % 3 = 0, unhex('1603010200AABB'), cast(array({_TEXTS[1:-1]})[k % 8] as binary))")
    proto = F.expr("array('TCP', 'UDP', 'ICMP')[event_id % 3]")
    return _events(spark, sf).select("event_id", packet.packet_route(proto, payload).alias("route"))


@query(
    "x2_silence_seconds",
    f"""WITH RECURSIVE rows AS (SELECT event_id AS packet_no, ts, event_type FROM events), {silenced('rows', 'event_type', 900, False)}
      SELECT event_type, packet_no, ts FROM emitted""",
)
def _(spark, sf):
    from packetloom.operators.windows import silence

    rows = t.read(spark, sf, "events").selectExpr("event_id as packet_no", "cast(ts as timestamp) as ts", "event_type")
    return silence(rows, ["event_type"], "ts", 900, False, ["packet_no"])


@query(
    "x1_sliding_distinct",
    """SELECT DISTINCT event_type, ts, count(DISTINCT user_id) OVER w AS users, count(*) OVER w AS n FROM events
      WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf):
    from packetloom.operators.windows import trailing

    rows = t.read(spark, sf, "events")
    out = trailing(rows, ["event_type"], "ts", 6 * 3600, {"n": 1}, {"users": "user_id"})
    return out.select("event_type", from_micros("us").alias("ts"), "users", "n")
