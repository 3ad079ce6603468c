"""Rule text, join and matching queries."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from packetloom.functions import http
from packetloom.functions.packet import ascii_lower, latin1
from packetloom.functions.rules import (
    byte_test,
    flow_matches,
    flow_tokens,
    literal_bytes,
    port_matches,
    port_spec,
    size_matches,
    size_spec,
)
from packetloom.operators import rule_text
from packetloom.operators.matching import (
    candidates,
    content_chain,
    literal_matches,
    match_any_part,
    match_any_regex,
    match_http_parts,
    match_packets,
)
from packetloom.plans.registry import query
from packetloom.plans.sql_tables import PAYLOADS
from packetloom.schemas import RULES
from packetloom.sources import adapters as t


def make_rules(spark, specs):
    """Rule rows from short dictionaries; everything not given is open."""
    md_fields = [f.name for f in spark.createDataFrame([], RULES).schema["metadata"].dataType.fields]
    rows = []
    for s in specs:
        md = {n: None for n in md_fields}
        contents = s.get("contents")
        if contents is not None:
            md["content_patterns"] = [c if isinstance(c, str) else c[0] for c in contents]
            md["content_options"] = [
                {k: ({} if isinstance(c, str) else c[1]).get(k) for k in ("offset", "depth", "within", "distance", "nocase")}
                for c in contents
            ]
        md["byte_tests"] = [
            {
                "bytes": b[0], "op": b[1], "value": Decimal(b[2]), "offset": b[3], "relative": False,
                "endian": b[4], "raw": "",
            }
            for b in s.get("tests", [])
        ]
        md["isdataat"] = [
            {"offset": c[0], "negated": c[1], "relative": c[2], "raw": ""} for c in s.get("checks", [])
        ]
        for k in ("dsize", "flow", "flags", "ip_id", "ip_proto", "dns_query", "smtp_command", "pop_command"):
            md[k] = s.get(k)
        regexes = s.get("pcre")
        md["byte_test_only"] = bool(md["byte_tests"]) and not contents and not regexes
        pattern = regexes or s.get("pattern") or (md["content_patterns"] or ["__BYTE_TEST_ONLY__"])
        rows.append(
            {
                "rule_id": s["id"], "name": s["id"], "action": "alert", "priority": s.get("priority", 3),
                "protocol": s.get("protocol"), "src": s.get("src", "any"), "src_ports": s.get("src_ports"),
                "direction": s.get("direction", "->"), "dst": s.get("dst", "any"), "dst_ports": s.get("dst_ports"),
                "pattern": pattern, "pattern_type": "pcre" if regexes else "string", "description": s["id"],
                "category": "test", "tags": [], "metadata": md, "enabled": s.get("enabled", True),
            }
        )
    return spark.createDataFrame(rows, RULES)


def literal_rules(spark, literals, **common):
    return make_rules(spark, [{"id": k, "contents": [v], **common} for k, v in literals.items()])



# --------------------------------------------------------------------------- rule text

_LINE = (
    "concat(if(p_partkey % 9 = 0, '  # ', ''), 'alert ', array('tcp', 'udp', 'icmp', 'ip', 'http')[p_partkey % 5], ' ', "
    "array('any', '$HOME_NET', '!$HOME_NET', '$EXTERNAL_NET', '10.0.0.', '$NOPE')[p_partkey % 6], if(p_partkey % 6 = 4, cast(p_size as string), ''), ' ', "
    "array('any', '!80', '[1,2,3]')[p_partkey % 3], if(p_partkey % 2 = 0, ' -> ', ' <> '), 'any ', "
    "array('80', '$HTTP_PORTS', '1024:', '!21:23', 'any')[p_partkey % 5], "
    "if(p_partkey % 11 = 0, ' no options', concat(' (msg:\"', p_name, '\"; content:\"', p_brand, '\"; offset:', p_size, '; nocase; "
    "content:\"|41 42|x\",depth ', p_size, '; flow:to_server,established; distance:9; classtype:', "
    "array('attempted-admin', 'attempted-user', 'successful-recon', 'web-application-attack', 'odd')[p_size % 5], "
    "'; byte_test:2,>,0x1F,', p_size, ',relative,little; isdataat:!', p_size, ',relative; dsize:>', p_size, '; sid:', p_partkey, '; rev:2;)')))"
)


def _lines(spark, sf):
    return t.read(spark, sf, "part").selectExpr("p_partkey", f"{_LINE} as line")


@query(
    "r1_header",
    """SELECT p_partkey, p_partkey % 11 <> 0 AS parsed,
      CASE WHEN p_partkey % 11 <> 0 THEN ['tcp', 'udp', 'icmp', 'ip', 'http'][CAST(p_partkey % 5 + 1 AS INT)] END AS protocol,
      CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN '->' ELSE '<>' END END AS direction,
      CASE WHEN p_partkey % 11 <> 0 THEN ['80', '$HTTP_PORTS', '1024:', '!21:23', 'any'][CAST(p_partkey % 5 + 1 AS INT)] END AS dst_port
      FROM part WHERE p_partkey % 9 <> 0""",
)
def _(spark, sf):
    return rule_text.split_header(_lines(spark, sf)).select("p_partkey", "parsed", "protocol", "direction", "dst_port")


def _converted(spark, sf):
    return rule_text.convert_rules(_lines(spark, sf), rule_text.default_variables(spark))


@query(
    "r2_options",
    """SELECT 'snort_' || p_partkey AS rule_id, p_name AS name, '2' AS rev, '>' || p_size AS dsize, 'to_server,established' AS flow
      FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0""",
)
def _(spark, sf):
    md = F.col("metadata")
    return _converted(spark, sf).select(
        "rule_id", "name", md["snort_rev"].alias("rev"), md["dsize"].alias("dsize"), md["flow"].alias("flow")
    )


@query(
    "r3_contents",
    """SELECT 'snort_' || p_partkey AS rule_id, p_brand || '+ABx' AS contents, p_size AS offset1, true AS nocase1, p_size AS depth2,
      CAST(NULL AS INT) AS distance2 FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0""",
)
def _(spark, sf):
    # the distance stands behind another option, so it belongs to no content
    md = F.col("metadata")
    first, second = F.get(md["content_options"], F.lit(0)), F.get(md["content_options"], F.lit(1))
    return _converted(spark, sf).select(
        "rule_id",
        F.array_join(md["content_patterns"], "+").alias("contents"),
        first["offset"].alias("offset1"),
        first["nocase"].alias("nocase1"),
        second["depth"].alias("depth2"),
        second["distance"].alias("distance2"),
    )


@query(
    "r4_byte_test",
    """SELECT 'snort_' || p_partkey AS rule_id, 2 AS bytes, '>' AS op, 31 AS value, p_size AS offset, true AS relative, 'little' AS endian,
      p_size AS data_offset, true AS negated FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0""",
)
def _(spark, sf):
    test, check = F.get("metadata.byte_tests", F.lit(0)), F.get("metadata.isdataat", F.lit(0))
    return _converted(spark, sf).select(
        "rule_id",
        test["bytes"].alias("bytes"),
        test["op"].alias("op"),
        test["value"].cast("int").alias("value"),
        test["offset"].alias("offset"),
        test["relative"].alias("relative"),
        test["endian"].alias("endian"),
        check["offset"].alias("data_offset"),
        (check["negated"] & check["relative"]).alias("negated"),
    )


@query(
    "r6_addresses",
    """SELECT 'snort_' || p_partkey AS rule_id, CASE p_partkey % 6 WHEN 0 THEN 'any' WHEN 1 THEN '192.168.0.0/16' WHEN 2 THEN '!192.168.0.0/16'
      WHEN 3 THEN '!192.168.0.0/16' WHEN 4 THEN '10.0.0.' || p_size ELSE 'any' END AS src FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0""",
)
def _(spark, sf):
    return _converted(spark, sf).select("rule_id", "src")


@query(
    "r6_lists",
    """SELECT 'snort_' || p_partkey AS rule_id,
      CASE p_partkey % 3 WHEN 0 THEN '[192.168.0.0/16,10.0.0.0/8]' WHEN 1 THEN '[!192.168.0.0/16,10.0.0.' || p_size || ']' ELSE '[192.168.0.0/16,!172.16.0.0/12,any]' END AS src,
      CASE p_partkey % 2 WHEN 0 THEN '8080,!80,!443' ELSE '!80,!443,' || p_size END AS dst_ports FROM part""",
)
def _(spark, sf):
    lines = t.read(spark, sf, "part").selectExpr(
        "concat('alert tcp ', array('[$HOME_NET,10.0.0.0/8]', concat('[!$HOME_NET,10.0.0.', p_size, ']'), '[![$EXTERNAL_NET,172.16.0.0/12],$NOPE]')[p_partkey % 3], ' any -> any ', "
        "array('[8080,!$HTTP_PORTS]', concat('![$HTTP_PORTS,!', p_size, ']'))[p_partkey % 2], ' (msg:\"m\"; content:\"x\"; sid:', p_partkey, '; rev:1;)') as line"
    )
    rules = rule_text.convert_rules(lines, rule_text.default_variables(spark))
    return rules.select("rule_id", "src", F.array_join("dst_ports", ",").alias("dst_ports"))


@query(
    "r7_ports",
    """SELECT 'snort_' || p_partkey AS rule_id, coalesce(CASE p_partkey % 3 WHEN 1 THEN '!80' WHEN 2 THEN '1,2,3' END, '-') AS src_ports,
      coalesce(CASE p_partkey % 5 WHEN 0 THEN '80' WHEN 1 THEN '80,443' WHEN 2 THEN '1024:' WHEN 3 THEN '!21:23' END, '-') AS dst_ports
      FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0""",
)
def _(spark, sf):
    return _converted(spark, sf).select(
        "rule_id",
        F.coalesce(F.array_join("src_ports", ","), F.lit("-")).alias("src_ports"),
        F.coalesce(F.array_join("dst_ports", ","), F.lit("-")).alias("dst_ports"),
    )


@query(
    "r8_classtype",
    """SELECT 'snort_' || p_partkey AS rule_id, CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 3 END AS priority,
      ['admin', 'user', 'recon', 'web', 'unknown'][CAST(p_size % 5 + 1 AS INT)] AS category FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0""",
)
def _(spark, sf):
    return _converted(spark, sf).select("rule_id", "priority", "category")


@query(
    "r9_match_mode",
    """SELECT 'snort_' || p_partkey AS rule_id, CASE p_size % 4 WHEN 0 THEN 'pcre' WHEN 1 THEN 'string' WHEN 2 THEN 'snort_byte_test' ELSE 'snort_unsupported' END AS pattern_type,
      p_size % 4 <> 3 AS enabled, CASE p_size % 4 WHEN 0 THEN '/' || p_brand || '/i' WHEN 1 THEN p_brand WHEN 2 THEN '__BYTE_TEST_ONLY__' ELSE '__UNSUPPORTED_SNORT_RULE__' END AS pattern,
      CAST(CASE WHEN p_size % 4 IN (0, 1) THEN 1 ELSE 0 END AS INT) AS contents FROM part""",
)
def _(spark, sf):
    lines = t.read(spark, sf, "part").selectExpr(
        "concat('alert tcp any any -> any any (', if(p_size % 4 = 0, concat('pcre:\"/', p_brand, '/i\"; '), ''), "
        "if(p_size % 4 in (0, 1), concat('content:\"', p_brand, '\"; '), ''), if(p_size % 4 = 2, 'byte_test:1,=,5,0; ', ''), "
        "'sid:', p_partkey, ';)') as line"
    )
    rules = rule_text.convert_rules(lines, rule_text.default_variables(spark))
    return rules.select(
        "rule_id", "pattern_type", "enabled", F.array_join("pattern", ",").alias("pattern"),
        F.size("metadata.content_patterns").alias("contents"),
    )


@query(
    "r10_rows",
    """SELECT 'snort_' || p_partkey AS rule_id, ['tcp', 'udp', 'icmp', NULL, NULL][CAST(p_partkey % 5 + 1 AS INT)] AS protocol, 'alert' AS action,
      'snort,imported' AS tags, CASE WHEN p_partkey % 2 = 0 THEN '->' ELSE '<>' END AS direction FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0""",
)
def _(spark, sf):
    return _converted(spark, sf).select("rule_id", "protocol", "action", F.array_join("tags", ",").alias("tags"), "direction")


@query(
    "r11_import_summary",
    """WITH lines AS (SELECT p_partkey, p_partkey % 11 <> 0 AS ok, p_size FROM part WHERE p_partkey % 9 <> 0)
      SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS failed_count,
        count(*) FILTER (WHERE ok AND p_size >= 20) AS imported FROM lines""",
)
def _(spark, sf):
    existing = t.read(spark, sf, "part").filter("p_size < 20").selectExpr("concat('snort_', p_partkey) as rule_id")
    return rule_text.import_summary(_lines(spark, sf), existing)


@query(
    "r11_failed_lines",
    """SELECT count(*) AS n FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 = 0""",
)
def _(spark, sf):
    return rule_text.failed_lines(_lines(spark, sf)).agg(F.count("*").alias("n"))


@query(
    "p27_literals",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'AB' || p_name || 'C' WHEN 2 THEN 'A' || p_name ELSE '|zz|' || p_name END AS literal FROM part""",
)
def _(spark, sf):
    text = F.expr(
        "case p_partkey % 4 when 0 then p_name when 1 then concat('|41 42|', p_name, '|43|') "
        "when 2 then concat('\\\\x41', p_name) else concat('|zz|', p_name) end"
    )
    return t.read(spark, sf, "part").select("p_partkey", literal_bytes(text).alias("literal"))


# --------------------------------------------------------------------------- joins of packets and rules

_HEADER_RULES = [
    {"id": "any", "contents": ["x"]},
    {"id": "off", "contents": ["x"], "enabled": False},
    {"id": "tcp80", "protocol": "tcp", "dst_ports": ["80"], "contents": ["x"]},
    {"id": "web", "protocol": "TCP", "dst_ports": ["80", "443"], "dst": "192.168.0.0/23", "contents": ["x"]},
    {"id": "high", "protocol": "ip", "dst_ports": ["8000:"], "src": "!10.1.0.0/25", "contents": ["x"]},
    {"id": "not_mail", "protocol": "udp", "dst_ports": ["!25", "!443"], "contents": ["x"]},
    {"id": "both", "direction": "<>", "src": "192.168.1.0/24", "src_ports": ["53"], "dst": "10.1.0.0/16", "contents": ["x"]},
    {"id": "host", "protocol": "tcp", "dst": "[192.168.0.7,192.168.1.11,192.168.2.0/28]", "contents": ["x"]},
    {"id": "source", "src_ports": ["1024:1100"], "dst_ports": ["25"], "contents": ["x"]},
]
_IN = {
    "any": "true",
    "tcp80": "proto = 'TCP' AND dst_port = 80",
    "web": "proto = 'TCP' AND dst_port IN (80, 443) AND regexp_matches(dst_ip, '^192[.]168[.][01][.]')",
    "high": "dst_port >= 8000 AND NOT (starts_with(src_ip, '10.1.0.') AND CAST(split_part(src_ip, '.', 4) AS INT) < 128)",
    "not_mail": "proto = 'UDP' AND dst_port NOT IN (25, 443)",
    "both": "starts_with(dst_ip, '192.168.1.') AND dst_port = 53",
    "host": "proto = 'TCP' AND (dst_ip IN ('192.168.0.7', '192.168.1.11') OR (starts_with(dst_ip, '192.168.2.') AND CAST(split_part(dst_ip, '.', 4) AS INT) < 16))",
    "source": "src_port BETWEEN 1024 AND 1100 AND dst_port = 25",
}
_SCORE = {
    "any": "0", "tcp80": "151", "web": "151", "high": "151", "not_mail": "1", "both": "0", "host": "1", "source": "200",
}


def _pairs_sql(names, columns="packet_no, '{n}' AS rule_id", extra=None):
    parts = [
        f"SELECT {columns.format(n=n)}{', ' + extra[n] + ' AS score' if extra else ''} FROM payloads WHERE {_IN[n]}" for n in names
    ]
    return f"WITH {PAYLOADS} " + " UNION ALL ".join(parts)


def _pairs(spark, sf, names):
    rules = make_rules(spark, [r for r in _HEADER_RULES if r["id"] in names or r["id"] == "off"])
    return candidates(t.payloads(spark, sf).drop("payload"), rules)


@query("j1_candidates", _pairs_sql(list(_IN)))
def _(spark, sf):
    return _pairs(spark, sf, list(_IN)).select("packet_no", "rule_id")


@query("j2_direction", _pairs_sql(["both", "source"]))
def _(spark, sf):
    return _pairs(spark, sf, ["both", "source"]).select("packet_no", "rule_id")


@query("j3_cidr", _pairs_sql(["web", "high", "host"]))
def _(spark, sf):
    return _pairs(spark, sf, ["web", "high", "host"]).select("packet_no", "rule_id")


@query(
    "j4_ports",
    f"""WITH {PAYLOADS} SELECT packet_no, dst_port = 80 OR dst_port BETWEEN 8000 AND 8050 AS listed, dst_port NOT IN (25, 443) AS negated,
      dst_port BETWEEN 20 AND 100 AND dst_port <> 53 AS mixed FROM payloads""",
)
def _(spark, sf):
    def hit(*items):
        return port_matches(port_spec(F.array(*[F.lit(i) for i in items])), F.col("dst_port"))

    return t.payloads(spark, sf).select(
        "packet_no", hit("80", "8000:8050").alias("listed"), hit("!25", "!443").alias("negated"), hit("20:100", "!53").alias("mixed")
    )


@query("j5_specificity", _pairs_sql(list(_IN), extra=_SCORE))
def _(spark, sf):
    return _pairs(spark, sf, list(_IN)).select("packet_no", "rule_id", "score")


# --------------------------------------------------------------------------- content

_LITERALS = {"lic": "License", "mit": "MIT", "tok": "token", "at": "@", "ung": "ung", "tion": "tion", "ell": "|C3 A9|ll"}
_LITERAL_TEXT = {**_LITERALS, "ell": "éll"}


@query(
    "m1_occurrences",
    "WITH l(rule_id, lit) AS (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in _LITERAL_TEXT.items())
    + """), cut AS (SELECT doc_id, rule_id, lit, string_split(text, lit) AS p FROM documents, l WHERE contains(text, lit)),
      placed AS (SELECT doc_id, rule_id, lit, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS n FROM cut),
      summed AS (SELECT *, sum(strlen(piece) + strlen(lit)) OVER (PARTITION BY doc_id, rule_id ORDER BY i) - strlen(lit) AS pos FROM placed)
      SELECT doc_id AS packet_no, rule_id, CAST(pos AS INT) AS pos_start, CAST(pos + strlen(lit) - 1 AS INT) AS pos_end FROM summed WHERE i < n""",
)
def _(spark, sf):
    literals = spark.createDataFrame(list(_LITERALS.items()), "rule_id string, literal string")
    return literal_matches(t.payloads(spark, sf), literals).select("packet_no", "rule_id", "pos_start", "pos_end")


def _ascii(spark, sf):
    """Payload texts with every non-ASCII character replaced, so that characters are bytes."""
    return t.payloads(spark, sf).withColumn(
        "payload", F.regexp_replace(F.col("payload").cast("string"), r"[^\x00-\x7f]", "?").cast("binary")
    )


_ASCII = PAYLOADS + r""", plain AS (SELECT * REPLACE (regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text) FROM payloads)"""
_CHAINS = {
    "two": [("the", {}), ("of", {})],
    "near": [("the", {"offset": 10}), ("on", {"distance": 2, "within": 20})],
    "deep": [("an", {"offset": 5, "depth": 60})],
    "folded": [("THE ", {"nocase": True, "depth": 200}), ("ING", {"nocase": True, "within": 40})],
    "third": [("en", {}), ("er", {"distance": 1}), ("e", {"within": 0})],
}


def _chain_sql(contents) -> str:
    """Nested lateral steps: position after each content, null once one is missing."""
    steps, at = [], "0"
    for i, (text, o) in enumerate(contents):
        hay = "lower(text)" if o.get("nocase") else "text"
        lit = text.lower() if o.get("nocase") else text
        n = len(text)
        if i == 0:
            start = str(o.get("offset", 0))
        else:
            start = f"({at} + {o.get('distance', 0)})"
            if "offset" in o:
                start = f"greatest({start}, {o['offset']})"
        end = "length(text)"
        if "depth" in o:
            end = f"least({end}, {o.get('offset', start)} + {o['depth']})"
        if i and "within" in o:
            end = f"least({end}, {at} + {o['within'] + n})"
        hit = f"strpos(substr({hay}, {start} + 1, greatest({end} - {start}, 0)), '{lit}')"
        steps.append(f"LATERAL (SELECT CASE WHEN {hit} > 0 THEN {start} + {hit} - 1 + {n} END AS e{i}) s{i}")
        at = f"e{i}"
    return f"SELECT packet_no, '{{name}}' AS rule_id FROM plain, {', '.join(steps)} WHERE e{len(contents) - 1} IS NOT NULL"


@query(
    "m2_chain",
    f"WITH {_ASCII} " + " UNION ALL ".join(_chain_sql(c).format(name=n) for n, c in _CHAINS.items()),
)
def _(spark, sf):
    text = latin1(F.col("payload"))
    rows = _ascii(spark, sf).select("packet_no", text.alias("text")).withColumn("low", ascii_lower(F.col("text")))

    def contents(chain):
        fields = [
            F.struct(
                F.lit(c.lower() if o.get("nocase") else c).alias("text"),
                F.lit(bool(o.get("nocase"))).alias("nocase"),
                *[F.lit(o.get(k)).cast("int").alias(k) for k in ("offset", "depth", "within", "distance")],
            )
            for c, o in chain
        ]
        return F.array(*fields)

    hits = [F.when(content_chain(F.col("text"), F.col("low"), contents(c)), n) for n, c in _CHAINS.items()]
    found = F.filter(F.array(*hits), lambda n: n.isNotNull())
    return rows.select("packet_no", F.explode(found).alias("rule_id"))


_REGEXES = {
    "address": ["[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"],
    "license": ["(?i)license", "[A-Z]{3}"],
    "shout": ["[A-Z]{5,}", "!!"],
}


@query(
    "m3_pcre",
    f"WITH {PAYLOADS} "
    + " UNION ALL ".join(
        f"SELECT packet_no, '{n}' AS rule_id, regexp_extract(text, '{r[0]}') AS match_text, "
        f"CAST(length(regexp_extract(text, '(?s)^(.*?)' || '{r[0]}', 1)) AS INT) AS pos_start FROM payloads WHERE "
        + " AND ".join(f"regexp_matches(text, '{x}')" for x in r)
        for n, r in _REGEXES.items()
    ),
)
def _(spark, sf):
    rules = make_rules(spark, [{"id": n, "pcre": r} for n, r in _REGEXES.items()])
    return match_packets(t.payloads(spark, sf), rules).select("packet_no", "rule_id", "match_text", "pos_start")


@query(
    "m4_pcre_prefilter",
    f"""WITH {PAYLOADS} SELECT packet_no, regexp_extract(text, '[0-9]+[.][0-9]+') AS match_text FROM payloads
      WHERE contains(text, 'the') AND regexp_matches(text, '[0-9]+[.][0-9]+')""",
)
def _(spark, sf):
    rules = make_rules(spark, [{"id": "r", "contents": ["the"], "pcre": ["/[0-9]+[.][0-9]+/"]}])
    return match_packets(t.payloads(spark, sf), rules).select("packet_no", "match_text")


_BYTES = "CAST('0x' || substr(hex(encode(text)), {at}, {n}) AS BIGINT)"


@query(
    "m5_byte_test",
    f"""WITH {PAYLOADS}, v AS (SELECT packet_no, size, {_BYTES.format(at=1, n=4)} AS two,
        CAST('0x' || substr(hex(encode(text)), 7, 2) || substr(hex(encode(text)), 5, 2) AS BIGINT) AS little FROM payloads)
      SELECT packet_no, two > 20000 AS gt, two < 20000 AS lt, two >= 17000 AS ge, two <= 17000 AS le, two <> 18533 AS ne, (two & 72) = 72 AS bits,
        (two & 3) = 0 AS no_bits, little > 28000 AS little, size >= 302 AS far FROM v""",
)
def _(spark, sf):
    def test(size, op, value, offset=0, endian="big"):
        fields = {
            "bytes": F.lit(size), "op": F.lit(op), "value": F.lit(value).cast("decimal(20,0)"), "offset": F.lit(offset),
            "relative": F.lit(False), "endian": F.lit(endian),
        }
        return byte_test(F.col("payload"), F.struct(*[v.alias(k) for k, v in fields.items()]))

    return t.payloads(spark, sf).select(
        "packet_no",
        test(2, ">", 20000).alias("gt"),
        test(2, "<", 20000).alias("lt"),
        test(2, ">=", 17000).alias("ge"),
        test(2, "<=", 17000).alias("le"),
        test(2, "!=", 18533).alias("ne"),
        test(2, "&", 72).alias("bits"),
        test(2, "!&", 3).alias("no_bits"),
        test(2, ">", 28000, 2, "little").alias("little"),
        test(2, ">=", 0, 300).alias("far"),
    )


@query(
    "m6_byte_test_rules",
    f"WITH {PAYLOADS} SELECT packet_no, 'byte_test' AS match_text FROM payloads WHERE {_BYTES.format(at=1, n=2)} = 84 AND proto = 'TCP'",
)
def _(spark, sf):
    rules = make_rules(spark, [{"id": "t", "protocol": "tcp", "tests": [(1, "=", 84, 0, "big")]}])
    return match_packets(t.payloads(spark, sf), rules).select("packet_no", "match_text")


@query(
    "m7_dsize",
    f"""WITH {PAYLOADS} SELECT packet_no, size > 1000 AS a, size <= 500 AS b, size BETWEEN 300 AND 900 AS c, NOT size BETWEEN 300 AND 900 AS d, NOT size > 2000 AS e FROM payloads""",
)
def _(spark, sf):
    size = F.length("payload")
    checks = {"a": ">1000", "b": "<= 500", "c": "300<>900", "d": "!300-900", "e": "!>2000"}
    return t.payloads(spark, sf).select(
        "packet_no", *[size_matches(size_spec(F.lit(v)), size).alias(k) for k, v in checks.items()]
    )


@query(
    "m9_header_fields",
    f"""WITH {PAYLOADS} SELECT packet_no, 'id' AS rule_id FROM payloads WHERE ip_id = 416 UNION ALL SELECT packet_no, 'udp' FROM payloads WHERE ip_proto = 17""",
)
def _(spark, sf):
    rules = make_rules(spark, [
        {"id": "id", "contents": [""], "pcre": ["(?s)^"], "ip_id": "416"},
        {"id": "udp", "contents": [""], "pcre": ["(?s)^"], "ip_proto": "17"},
        {"id": "bad", "contents": [""], "pcre": ["(?s)^"], "ip_proto": "x"},
    ])
    return match_packets(t.payloads(spark, sf), rules).select("packet_no", "rule_id")


@query(
    "m10_flags",
    f"""WITH {PAYLOADS} SELECT packet_no, 'a' AS rule_id FROM payloads WHERE contains(tcp_flags, 'A') UNION ALL SELECT packet_no, 'pa' FROM payloads
      WHERE contains(tcp_flags, 'A') AND contains(tcp_flags, 'P')""",
)
def _(spark, sf):
    rules = make_rules(spark, [{"id": "a", "pcre": ["(?s)^"], "flags": "A+"}, {"id": "pa", "pcre": ["(?s)^"], "flags": "p,a"}])
    return match_packets(t.payloads(spark, sf), rules).select("packet_no", "rule_id")


@query(
    "m11_isdataat",
    f"""WITH {_ASCII} SELECT packet_no, 'abs' AS rule_id FROM plain WHERE contains(text, 'the') AND length(text) > 400
      UNION ALL SELECT packet_no, 'short' FROM plain WHERE contains(text, 'the') AND NOT length(text) > 700
      UNION ALL SELECT packet_no, 'after' FROM plain WHERE strpos(text, 'the') > 0 AND length(text) > strpos(text, 'the') + 2 + 300
      UNION ALL SELECT packet_no, 'last' FROM plain WHERE contains(right(text, 53), 'the')""",
)
def _(spark, sf):
    # "last": some occurrence has at most 50 bytes behind it
    rules = make_rules(spark, [
        {"id": "abs", "contents": ["the"], "checks": [(400, False, False)]},
        {"id": "short", "contents": ["the"], "checks": [(700, True, False)]},
        {"id": "after", "contents": ["the"], "checks": [(300, False, True)]},
        {"id": "last", "contents": ["the"], "checks": [(50, True, True)]},
    ])
    return match_packets(_ascii(spark, sf), rules).select("packet_no", "rule_id")


@query(
    "m12_flow",
    f"""WITH {PAYLOADS} SELECT packet_no, coalesce(flow_dir = 'to_server', true) AND coalesce(flow_established, true) AS a,
      coalesce(flow_dir = 'to_client', true) AS b, coalesce(NOT flow_established, true) AS c, false AS d, true AS e FROM payloads""",
)
def _(spark, sf):
    texts = {
        "a": "to_server, Established", "b": "from_server,no_stream", "c": "not_established", "d": "only_stream",
        "e": "stateless,established,not_established",
    }
    state = [F.col(c) for c in ("flow_dir", "flow_established", "stream")]
    return t.payloads(spark, sf).select(
        "packet_no", *[flow_matches(flow_tokens(F.lit(v)), *state).alias(k) for k, v in texts.items()]
    )


@query(
    "m13_buffers",
    """SELECT doc_id AS packet_no, CASE WHEN n_chars % 2 = 0 THEN 'cmd' ELSE 'dns' END AS rule_id,
      CASE WHEN n_chars % 2 = 0 THEN 'smtp_command' ELSE 'dns_query' END AS buffer FROM documents
      WHERE CASE WHEN n_chars % 2 = 0 THEN contains(lang, 'en') ELSE contains(source, 'src1') END""",
)
def _(spark, sf):
    rows = t.payloads(spark, sf).join(
        t.read(spark, sf, "documents").selectExpr("doc_id as packet_no", "n_chars", "lang", "source"), "packet_no"
    )
    rows = rows.withColumns(
        {
            "app_proto": F.expr("if(n_chars % 2 = 0, 'smtp', 'dns')"),
            "buffers": F.expr("map(if(n_chars % 2 = 0, 'smtp_command', 'dns_query'), cast(if(n_chars % 2 = 0, lang, source) as binary))"),
        }
    )
    rules = make_rules(spark, [
        {"id": "cmd", "contents": ["en"], "smtp_command": True},
        {"id": "dns", "contents": ["src1"], "dns_query": True},
    ])
    return match_packets(rows, rules).select("packet_no", "rule_id", "buffer")


@query(
    "m14_first_match",
    f"""WITH {_ASCII}, hits AS (SELECT packet_no, strpos(text, 'license') AS a, strpos(text, 'License') AS b, strpos(text, 'MIT') AS c FROM plain),
      ends AS (SELECT packet_no, least(CASE WHEN b > 0 THEN b + 5 END, CASE WHEN c > 0 THEN c + 1 END, CASE WHEN a > 0 THEN a + 5 END) AS stop, a, b, c FROM hits)
      SELECT packet_no, CAST(stop AS INT) AS pos_end, CASE WHEN a > 0 AND a + 5 = stop THEN 'license' WHEN b > 0 AND b + 5 = stop THEN 'License' ELSE 'MIT' END AS match_text
      FROM ends WHERE stop IS NOT NULL""",
)
def _(spark, sf):
    rules = make_rules(spark, [{"id": "any_of", "pattern": ["License", "MIT", "license"]}])
    return match_packets(_ascii(spark, sf), rules).select("packet_no", "pos_end", "match_text")


@query(
    "m15_http_parts",
    """SELECT page_id, regexp_matches(url, '^[a-z]+://[^/]+/.*en') AND contains(html, '<script') AS uri_and_body, contains(html, 'ad 1') AS body FROM pages""",
)
def _(spark, sf):
    def content(text, *names):
        none = F.lit(None).cast("int")
        return F.struct(
            F.lit(text).alias("text"),
            F.lit(False).alias("nocase"),
            *[none.alias(k) for k in ("offset", "depth", "within", "distance")],
            F.array(*[F.lit(n) for n in names]).cast("array<string>").alias("parts"),
        )

    parts = http.payload_parts(F.col("buf"))
    rows = t.http_pages(spark, sf).select("page_id", parts.alias("p"), F.col("buf").cast("string").alias("text"))
    # the body is longer than the URI, so the position after the URI match still lies before the script
    two = match_http_parts(F.col("p"), F.col("text"), F.array(content("en", "uri"), content("<script", "body")))
    one = match_http_parts(F.col("p"), F.col("text"), F.array(content("ad 1", "body")))
    return rows.select("page_id", two.alias("uri_and_body"), one.alias("body"))


@query(
    "m16_any_part",
    """SELECT page_id, contains(html, 'utm_') OR contains(html, 'ad 7') OR regexp_matches(url, '^[a-z]+://[^/]+/.*(utm_|ad 7)') AS hit,
      regexp_matches(html, '[0-9]{4}') OR regexp_matches(url, '^[a-z]+://[^/]+/.*[0-9]{4}') AS digits FROM pages""",
)
def _(spark, sf):
    parts = http.payload_parts(F.col("buf"))
    rows = t.http_pages(spark, sf).select("page_id", parts.alias("p"), F.col("buf").cast("string").alias("text"))
    literals = F.array(F.lit("utm_"), F.lit("ad 7"))
    hit = match_any_part(F.col("p"), F.col("text"), literals, F.array(F.lit("uri"), F.lit("body")))
    both = F.concat_ws(" ", "p.uri", "p.body")
    return rows.select("page_id", hit.alias("hit"), match_any_regex(both, F.array(F.lit("[0-9]{4}"))).alias("digits"))


_FULL = [
    {"id": "lic", "protocol": "tcp", "contents": [("LICENSE", {"nocase": True})], "dsize": ">200", "flow": "established", "priority": 1},
    {"id": "web", "protocol": "tcp", "dst_ports": ["80", "443"], "contents": ["the ", ("on", {"within": 30})], "priority": 2},
    {"id": "addr", "pcre": ["/[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}/"], "contents": ["."], "flow": "to_server"},
    {"id": "first", "tests": [(1, ">=", 65, 0, "big")], "flags": "PA"},
    {"id": "mail", "direction": "<>", "src": "192.168.0.0/16", "src_ports": ["25"], "contents": ["ung"]},
]
_FULL_SQL = f"""WITH {_ASCII}
      SELECT packet_no, 'lic' AS rule_id, 1 AS priority FROM plain WHERE proto = 'TCP' AND contains(lower(text), 'license') AND size_ascii > 200 AND coalesce(flow_established, true)
      UNION ALL SELECT packet_no, 'web', 2 FROM plain WHERE proto = 'TCP' AND dst_port IN (80, 443) AND strpos(text, 'the ') > 0
        AND contains(substr(text, strpos(text, 'the ') + 4, 32), 'on')
      UNION ALL SELECT packet_no, 'addr', 3 FROM plain WHERE regexp_matches(text, '[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}') AND coalesce(flow_dir = 'to_server', true)
      UNION ALL SELECT packet_no, 'first', 3 FROM plain WHERE unicode(text) >= 65 AND tcp_flags = 'PA'
      UNION ALL SELECT packet_no, 'mail', 3 FROM plain WHERE dst_port = 25 AND starts_with(dst_ip, '192.168.') AND contains(text, 'ung')""".replace(
    "size_ascii", "length(text)"
)


@query("m17_match", _FULL_SQL)
def _(spark, sf):
    return match_packets(_ascii(spark, sf), make_rules(spark, _FULL)).select("packet_no", "rule_id", "priority")


@query("m17_match_anchored", _FULL_SQL)
def _(spark, sf):
    found = match_packets(_ascii(spark, sf), make_rules(spark, _FULL), anchored=True)
    return found.select("packet_no", "rule_id", "priority")
