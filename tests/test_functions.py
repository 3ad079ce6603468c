"""Column functions on the pinned cases."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.functions import alerts, http, packet
from packetloom.functions.rules import java_regex, literal_bytes


def one(spark, column, **values):
    rows = [tuple(values.values())]
    types = {str: "string", int: "int", bytes: "binary", bytearray: "binary", type(None): "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items())
    return spark.createDataFrame(rows, schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [("abc", "abc"), ("|41 42 43|", "ABC"), ("|41|BC|44|", "ABCD"), ("\\x41\\x42", "AB"), ("|zz|q", "|zz|q"), ("a|b", "a|b")],
)
def test_literals(spark, text, want):
    assert one(spark, literal_bytes(F.col("t")), t=text) == want


def test_regex_forms(spark):
    rx = java_regex(F.col("r"))
    hit = F.rlike(F.col("t"), rx)
    assert one(spark, hit, r="/(exe|dll|scr)$/i", t="a.EXE") is True
    assert one(spark, hit, r="/(exe|dll|scr)$/i", t="a.txt") is False
    assert one(spark, hit, r="a+b", t="maaab") is True
    assert one(spark, rx, r="/a\\/b/ix", t="") == "(?ix)a/b"


def chunked(*parts):
    return b"".join(parts)


@pytest.mark.parametrize(
    "body,want",
    [
        (b"4\r\nWiki\r\n5\r\npedia\r\n0\r\n\r\n", b"Wikipedia"),
        (b"4;ext=1\r\nWiki\r\n0\r\n\r\n", b"Wiki"),
        (b"4\r\nWiki\r\n9\r\nped", b"Wiki"),
        (b"", b""),
    ],
)
def test_dechunk(spark, body, want):
    assert bytes(one(spark, F.encode(http.dechunk(packet.latin1(F.col("b"))), "ISO-8859-1"), b=body)) == want


REQUEST = b"GET /path?x=1 HTTP/1.1\r\nHost: a\r\n\r\n"
LOGIN = b"POST /login HTTP/1.1\r\nContent-Length: 13\r\n\r\npassword=1234"


@pytest.mark.parametrize(
    "buf,count,consumed",
    [
        (REQUEST, 1, len(REQUEST)),
        (LOGIN, 1, len(LOGIN)),
        (b"POST / HTTP/1.1\r\nContent-Length: 10\r\n\r\n12345", 0, 0),
        (b"", 0, 0),
        (b"NOTHTTP", 0, 0),
        (b"GET / HTTP/1.1\r\nHost: a\r\n", 0, 0),
        (REQUEST + LOGIN + b"GET /half", 2, len(REQUEST + LOGIN)),
        (b"bad\r\n\r\n" + REQUEST, 1, len(REQUEST) + 7),
        (b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi" + REQUEST, 1, len(REQUEST) + 40),
    ],
)
def test_requests(spark, buf, count, consumed):
    got = one(spark, http.http_requests(F.col("b")), b=buf)
    assert (len(got["messages"]), got["consumed"]) == (count, consumed)
    if LOGIN == buf:
        assert bytes(got["messages"][0]["body"]) == b"password=1234"


def test_response_and_chunked_request(spark):
    got = one(spark, http.http_responses(F.col("b")), b=b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nHello")
    assert got["messages"][0]["status_code"] == 200
    assert bytes(got["messages"][0]["body"]) == b"Hello"
    body = b"4\r\nWiki\r\n0\r\n\r\n"
    head = f"POST / HTTP/1.1\r\nTransfer-Encoding: chunked\r\nContent-Length: {len(body)}\r\nX: 1\r\nx: 2\r\n\r\n".encode()
    got = one(spark, http.http_requests(F.col("b")), b=head + body)["messages"][0]
    assert bytes(got["body"]) == b"Wiki"
    assert got["headers"]["x"] == "2"


def test_unquote_keeps_bad_escapes(spark):
    assert one(spark, http.unquote_plus(F.col("t")), t="a+b%20c%zz%4") == "a b c%zz%4"


DNS = bytes.fromhex("123401000001000000000000") + b"\x01a\x07example\x03com\x00" + bytes.fromhex("00010001")


@pytest.mark.parametrize(
    "sport,dport,l4,payload,want",
    [
        (12345, 80, "TCP", b"GET /index HTTP/1.1\r\n", "http"),
        (5353, 53, "UDP", DNS, "dns"),
        (5353, 53, "ICMP", b"GET / HTTP/1.1", "dns"),
        (1111, 2222, "TCP", b"xyz", None),
    ],
)
def test_detect_protocol(spark, sport, dport, l4, payload, want):
    found = packet.detect_protocol(F.col("s"), F.col("d"), F.col("p"), F.col("b"))
    assert one(spark, found, s=sport, d=dport, p=l4, b=payload) == want


def test_dns_question(spark):
    got = one(spark, packet.dns_question(F.col("b")), b=DNS)
    assert (got["query_type"], got["domain"], got["record_type"]) == ("query", "a.example.com", "A")
    assert one(spark, packet.dns_question(F.col("b")), b=b"short")["query_type"] == "unknown"
    # more labels than the short walk takes
    many = DNS[:12] + b"\x01x" * 60 + b"\x00" + bytes.fromhex("001C0001")
    got = one(spark, packet.dns_question(F.col("b")), b=many)
    assert got["domain"] == ".".join("x" * 60) and got["record_type"] == "AAAA"


def test_dns_names_of_any_length(spark):
    def plain(data):
        pos, labels = 12, []
        while pos < len(data) and data[pos] and pos + data[pos] + 1 < len(data):
            labels.append(data[pos + 1 : pos + 1 + data[pos]].decode())
            pos += data[pos] + 1
        return ".".join(labels) or None

    rng = random.Random(3)
    cases = [DNS[:12] + bytes(rng.choice((1, 2, 3, 97)) for _ in range(n)) for n in (0, 1, 2, 50, 51, 52, 53, 64, 116, 117, 900, 6000)]
    cases += [DNS[:12] + b"\x01x" * n + end for n in (31, 32, 33, 63, 64, 65, 400) for end in (b"", b"\x00", b"\x00\x00\x01")]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, b binary")
    found = {r["i"]: r["domain"] for r in df.select("i", packet.dns_question(F.col("b"))["domain"].alias("domain")).collect()}
    assert {i: found[i] for i, c in enumerate(cases) if len(c) > 12} == {i: plain(c) for i, c in enumerate(cases) if len(c) > 12}


def test_sanitize(spark):
    assert one(spark, alerts.sanitize_text(F.col("t")), t="A\0B\nC") == "A\\x00B\\x0aC"
    assert one(spark, alerts.sanitize_text(F.col("t")), t="a  b " + "x" * 500) == ("a b " + "x" * 396) + "…"
    assert one(spark, alerts.sanitize_text(F.col("t")), t="é€") == "\\xe9\\x20ac"
