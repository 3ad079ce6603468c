"""Column functions on packet headers and payload bytes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Port tables, method and command words, record types.
APP_PORTS = [
    ("dns", [53]),
    ("ssh", [22]),
    ("ftp", [21, 20]),
    ("smtp", [25, 587, 465]),
    ("pop3", [110, 995]),
    ("imap", [143, 993]),
    ("telnet", [23]),
]
MAIL_AND_DNS_PORTS = [("dns", [53]), ("smtp", [25, 587, 465]), ("pop3", [110, 995])]
HTTP_START_WORDS = ["GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "CONNECT", "TRACE"]
HTTP_DETECT_WORDS = ["get", "post", "put", "delete", "head", "options", "patch"]
HTTP_HEADER_MARKS = ["host:", "user-agent:", "content-type:", "accept:", "cookie:"]
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 13: "HINFO", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV"}
SMTP_COMMANDS = ["EHLO", "HELO", "MAIL FROM", "RCPT TO", "DATA", "QUIT", "RSET", "NOOP", "VRFY", "EXPN", "HELP"]
POP3_COMMANDS = ["USER", "PASS", "STAT", "LIST", "RETR", "DELE", "NOOP", "RSET", "QUIT", "TOP", "UIDL"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def latin1(payload: Column) -> Column:
    """Bytes as text with one character per byte, so positions are byte positions."""
    return F.decode(payload, "ISO-8859-1")


def utf8_lossy(payload: Column) -> Column:
    """Bytes as UTF-8 text without the malformed ones."""
    return F.translate(F.make_valid_utf8(payload.cast("string")), "�", "")


def strip(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only, the folding that bytes have."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_at(payload: Column, pos: Column | int) -> Column:
    """Unsigned value of the byte at a zero-based position."""
    at = F.lit(pos) if isinstance(pos, int) else pos
    return F.conv(F.hex(payload.substr(at + 1, F.lit(1))), 16, 10).cast("int")


def is_tls_record(payload: Column) -> Column:
    head = F.hex(payload.substr(1, 3))
    return F.coalesce((F.length(payload) >= 5) & head.rlike("^1[4-7]030[0-4]"), F.lit(False))


def is_likely_http(payload: Column) -> Column:
    head = utf8_lossy(payload.substr(1, 50))
    starts = F.upper(head).rlike(r"(?s)^\s*(?:(?:" + "|".join(HTTP_START_WORDS) + r") .*\S|HTTP/)")
    marks = F.lower(head).rlike("|".join(HTTP_HEADER_MARKS))
    return F.coalesce((F.length(payload) >= 10) & (starts | marks), F.lit(False))


def _by_port(table, ports: Sequence[Column], otherwise: Column) -> Column:
    out = None
    for name, numbers in table:
        hit = F.lit(False)
        for port in ports:
            hit = hit | F.coalesce(port.isin(numbers), F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def app_protocol(proto: Column, src_port: Column, dst_port: Column, payload: Column) -> Column:
    """Application protocol: TLS and HTTP by content on TCP, otherwise by either port."""
    nothing = F.lit(None).cast("string")
    ports = _by_port(APP_PORTS, [src_port, dst_port], nothing)
    tcp = F.upper(proto) == "TCP"
    return F.when(tcp & is_tls_record(payload), "tls").when(tcp & is_likely_http(payload), "http").otherwise(ports)


def detect_protocol(src_port: Column, dst_port: Column, proto: Column, payload: Column) -> Column:
    """Protocol by port (source first), then by content for TCP and UDP."""
    nothing = F.lit(None).cast("string")
    head = F.lower(utf8_lossy(payload.substr(1, 50)))
    http = head.rlike("^(?:" + "|".join(HTTP_DETECT_WORDS) + ") ") | head.contains("http/")
    query = (F.length(payload) >= 12) & (byte_at(payload, 2) < 128)
    by_content = F.when(
        proto.isin("TCP", "UDP") & (F.length(payload) > 0), F.when(http, "http").when(query, "dns")
    ).otherwise(nothing)
    return F.coalesce(
        _by_port(MAIL_AND_DNS_PORTS, [src_port], nothing), _by_port(MAIL_AND_DNS_PORTS, [dst_port], nothing), by_content
    )


def directed_flow_id(proto: Column, src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    return F.concat(proto, F.lit(":"), src_ip, F.lit(":"), src_port, F.lit("->"), dst_ip, F.lit(":"), dst_port)


def endpoint(ip: Column, port: Column) -> Column:
    return F.concat(ip, F.lit(":"), port)


def flow_key(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    """Direction-free flow key: the smaller endpoint text first."""
    a, b = endpoint(src_ip, src_port), endpoint(dst_ip, dst_port)
    return F.concat(F.least(a, b), F.lit("<->"), F.greatest(a, b))


def flag_set(flags: Column) -> Column:
    """Distinct upper-case letters of a flag text."""
    letters = F.regexp_replace(F.upper(F.coalesce(flags, F.lit(""))), "[^A-Z]", "")
    return F.array_distinct(F.filter(F.split(letters, ""), lambda c: c != ""))


def has_flag(flags: Column, letter: str) -> Column:
    return F.coalesce(F.upper(flags).contains(letter), F.lit(False))


def header_projection(packets: DataFrame) -> DataFrame:
    """Packets with an IP protocol; ICMP carries type and code in the port columns."""
    icmp = F.col("proto") == "ICMP"
    known = packets.filter(F.col("proto").isNotNull())
    if "icmp_type" not in packets.columns:
        return known
    return known.withColumns(
        {
            "src_port": F.when(icmp, F.col("icmp_type")).otherwise(F.col("src_port")),
            "dst_port": F.when(icmp, F.col("icmp_code")).otherwise(F.col("dst_port")),
        }
    )


def dns_question(payload: Column) -> Column:
    """``struct(query_type, domain, record_type)`` of the first DNS question."""
    size = F.length(payload)
    start = F.struct(F.lit(12).alias("pos"), F.array().cast("array<string>").alias("labels"), F.lit(False).alias("done"))

    def step(acc, _):
        pos = acc["pos"]

        def take(length):
            stop = acc["done"] | (pos >= size) | (length == 0) | (pos + length + 1 >= size)
            label = utf8_lossy(payload.substr(pos + 2, length))
            return F.struct(
                F.when(stop, pos).otherwise(pos + length + 1).alias("pos"),
                F.when(stop, acc["labels"]).otherwise(F.concat(acc["labels"], F.array(label))).alias("labels"),
                stop.alias("done"),
            )

        return let(F.coalesce(byte_at(payload, pos), F.lit(0)), take)

    # every label takes two bytes at least; steps after the end of the name are passed over 32 at a time
    few, runs = F.sequence(F.lit(1), F.lit(32)), F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(size / 64).cast("int")))

    def walk(acc, _):
        return F.when(acc["done"], acc).otherwise(F.aggregate(few, acc, step))

    questions = byte_at(payload, 4) * 256 + byte_at(payload, 5)
    asked = (size > 12) & (questions > 0)
    empty = F.struct(
        F.lit("unknown").alias("query_type"),
        F.lit(None).cast("string").alias("domain"),
        F.lit(None).cast("string").alias("record_type"),
    )

    def kind(number):
        out = None
        for value, name in DNS_TYPES.items():
            out = F.when(number == value, name) if out is None else out.when(number == value, name)
        return out.otherwise(F.concat(F.lit("UNKNOWN("), number.cast("string"), F.lit(")")))

    def answer(walked):
        pos = walked["pos"]
        number = byte_at(payload, pos + 1) * 256 + byte_at(payload, pos + 2)
        return F.struct(
            F.when(byte_at(payload, 2) < 128, "query").otherwise("response").alias("query_type"),
            F.when(asked & (F.size(walked["labels"]) > 0), F.array_join(walked["labels"], ".")).alias("domain"),
            F.when(asked & (pos + 2 < size), let(number, kind)).alias("record_type"),
        )

    found = let(F.aggregate(runs, start, walk), answer)
    return F.when((size < 12) | size.isNull(), empty).otherwise(found)


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def smtp_lines(text: Column) -> Column:
    """``struct(commands, responses, emails)`` of the lines of an SMTP text."""
    command = lambda line: F.upper(line).rlike("^(?:" + "|".join(SMTP_COMMANDS) + ")")
    response = lambda line: line.rlike(r"^\d{3}\s")
    email = lambda line: line.contains("@") & F.lower(line).rlike("from:|to:")
    return let(
        _lines(text),
        lambda lines: F.struct(
            F.filter(lines, command).alias("commands"),
            F.filter(lines, lambda line: ~command(line) & response(line)).alias("responses"),
            F.filter(lines, lambda line: ~command(line) & ~response(line) & email(line)).alias("emails"),
        ),
    )


def pop3_lines(text: Column) -> Column:
    """``struct(commands, responses)`` of the lines of a POP3 text."""
    command = lambda line: F.upper(line).rlike("^(?:" + "|".join(POP3_COMMANDS) + ")")
    response = lambda line: line.startswith("+OK") | line.startswith("-ERR")
    return let(
        _lines(text),
        lambda lines: F.struct(
            F.filter(lines, command).alias("commands"),
            F.filter(lines, lambda line: ~command(line) & response(line)).alias("responses"),
        ),
    )


def request_line(text: Column) -> Column:
    """``struct(method, uri, version)`` of the first line if it has three words."""
    words = F.split(strip(F.try_element_at(F.split(text, "\n"), F.lit(1))), r"\s+")
    enough = F.size(words) >= 3
    return F.struct(
        *[F.when(enough, F.get(words, F.lit(i))).alias(n) for i, n in enumerate(["method", "uri", "version"])]
    )


def sticky_buffers(app: Column, proto: Column, payload: Column) -> Column:
    """Named byte buffers that rules may ask for besides the raw payload."""
    carried = F.upper(proto).isin("TCP", "UDP") & (F.length(payload) > 0)
    text = utf8_lossy(payload)
    query = F.when(
        carried & (app == "dns"), let(dns_question(payload), lambda q: F.concat_ws("\n", q["domain"], q["record_type"]))
    )
    smtp = F.when(carried & (app == "smtp"), F.array_join(smtp_lines(text)["commands"], "\n"))
    pop = F.when(carried & (app == "pop3"), F.array_join(pop3_lines(text)["commands"], "\n"))
    buffers = F.create_map(
        F.lit("raw"), payload,
        F.lit("dns_query"), query.cast("binary"),
        F.lit("smtp_command"), smtp.cast("binary"),
        F.lit("pop_command"), pop.cast("binary"),
    )
    return F.map_filter(buffers, lambda _, v: v.isNotNull() & (F.length(v) > 0))


def packet_route(proto: Column, payload: Column) -> Column:
    """Which detection path a packet takes: tls, http, raw, stream-less or other."""
    tcp, udp = proto == "TCP", proto == "UDP"
    return (
        F.when(tcp & is_tls_record(payload), "skip_tls")
        .when(tcp & is_likely_http(payload), "http")
        .when(tcp | udp, "raw")
        .otherwise("ip")
    )
