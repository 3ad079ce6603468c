"""Byte streams by position: against plain versions, whatever the cuts."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from packetloom.functions import http
from packetloom.operators import behavior, byte_stream, flows
from packetloom.plans import detect
from packetloom.plans.queries_rules import make_rules

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc).replace(tzinfo=None)
SEGMENTS = "flow string, arrival long, seq long, data binary"
WRAP = 1 << 32


def plain_chunks(rows):
    """What each arrival releases: (flow, arrival, first position, bytes)."""
    out = []
    for flow in sorted({r[0] for r in rows}):
        last = expected = None
        waiting = {}
        for _, arrival, seq, data in sorted((r for r in rows if r[0] == flow), key=lambda r: r[1]):
            if not data:
                continue
            last = seq if last is None else last + (seq - last + WRAP // 2) % WRAP - WRAP // 2
            expected = last if expected is None else expected
            if len(data) > len(waiting.get(last, b"")):
                waiting[last] = data
            begin, released = expected, b""
            for at in sorted(waiting):
                if at > expected:
                    break
                fresh = waiting.pop(at)[expected - at :]
                released += fresh
                expected += len(fresh)
            if released:
                out.append((flow, arrival, begin, released))
    return out


def random_segments(seed, n, length):
    """Segments of random streams: out of order, overlapping, repeated, with holes and other bytes in overlaps."""
    rng = random.Random(seed)
    rows = []
    for f in range(n):
        base = rng.choice([0, 7, WRAP - 11, WRAP - 1])
        whole = bytes(rng.randrange(256) for _ in range(length))
        parts, at = [], 0
        while at < length:
            size = rng.randint(1, 9)
            parts.append((at, whole[at : at + size]))
            if rng.random() < 0.3:
                back = rng.randint(0, min(at, 12))
                parts.append((at - back, bytes(rng.randrange(256) for _ in range(rng.randint(1, 15)))))
            at += size if rng.random() < 0.97 else size + 3
        moved = sorted(enumerate(parts), key=lambda p: p[0] + rng.uniform(0, 6))
        rows += [(f"f{f}", 10 * k + 1, (base + at) % WRAP, data) for k, (_, (at, data)) in enumerate(moved)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_released_chunks_are_those_of_the_walk_through_arrivals(spark, seed, monkeypatch):
    monkeypatch.setattr(byte_stream, "ARRIVALS", 64)
    monkeypatch.setattr(byte_stream, "CELL", 32)
    rows = random_segments(seed, 12, 150) + [("e", 1, 5, b""), ("e", 2, 9, b"xy"), ("e", 3, 5, b"old")]
    got = byte_stream.released_chunks(spark.createDataFrame(rows, SEGMENTS)).collect()
    assert sorted((r["flow"], r["arrival"], r["start"], bytes(r["data"])) for r in got) == sorted(plain_chunks(rows))


def test_a_closed_hole_releases_what_waited(spark):
    rows = [("f", 1, 100, b"abc"), ("f", 2, 106, b"ghi"), ("f", 3, 103, b"def")]
    got = byte_stream.released_chunks(spark.createDataFrame(rows, SEGMENTS)).orderBy("arrival").collect()
    assert [(r["arrival"], bytes(r["data"])) for r in got] == [(1, b"abc"), (3, b"defghi")]


def test_sequence_numbers_over_several_wraps(spark):
    size = (1 << 30) + 12345
    rows = [("f", k, (77 + k * size) % WRAP, size) for k in range(20)]
    segments = spark.createDataFrame(rows, "flow string, arrival long, seq long, size long")
    pieces = byte_stream.releases(segments).orderBy("start").collect()
    assert [(p["start"], p["stop"], p["released"]) for p in pieces] == [(77 + k * size, 77 + (k + 1) * size, k) for k in range(20)]
    cuts = flows.reassembly_cuts(segments).filter("contiguous").orderBy("start").collect()
    assert [c["start"] for c in cuts] == [77 + k * size for k in range(20)]


def message(rng):
    body = bytes(rng.choice(b"ab \r\nH") for _ in range(rng.randint(0, 40)))
    kind = rng.random()
    if kind < 0.15:
        return b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n%s" % (len(body), body)
    if kind < 0.3:
        return rng.choice([b"\r\n\r\n", b"noise\r\n\r\n", b"a b\r\nContent-Length: 5\r\n\r\n", b"\r\n", b"x y z\r\n\r\n\r\n"])
    if kind < 0.4:
        return b"POST /c HTTP/1.1\r\nTransfer-Encoding: chunked\r\ncontent-length : 15\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    if kind < 0.5:
        return b"GET /x HTTP/1.1\r\n \tContent-LENGTH\t:%s%d\r\nContent-Length: -3\r\n\r\n" % (b" " * rng.randint(0, 90), rng.randint(0, 9))
    lengths = b"".join(b"Content-Length: %s\r\n" % v for v in [b"99", b"x"][: rng.randint(0, 2)])
    return b"PUT /%s HTTP/1.1\r\nHost: h\r\n%sContent-Length: %d\r\n\r\n%s" % (b"p" * rng.randint(0, 80), lengths, len(body), body)


@pytest.mark.parametrize("block,over", [(16, 8), (64, 8), (1 << 16, 64)])
def test_messages_by_position_are_those_of_the_whole_buffer(spark, monkeypatch, block, over):
    monkeypatch.setattr(byte_stream, "BLOCK", block)
    monkeypatch.setattr(byte_stream, "OVER", over)
    monkeypatch.setattr(byte_stream, "CELL", 128)
    rng = random.Random(block)
    buffers = [(f, b"".join(message(rng) for _ in range(rng.randint(0, 9)))) for f in range(40)]
    buffers += [(100, b"GET / HTTP/1.1\r\nContent-Length: 10\r\n\r\nshort"), (101, b"NOTHTTP"), (102, b"GET / HTTP/1.1\r\nHost: x\r\n"), (103, b"GET / HTTP/1.1\r\n\r\n")]
    buffers = [(f, b) for f, b in buffers if b]
    pieces = []
    for f, b in buffers:
        at, base = 0, rng.randint(0, 3 * block)
        while at < len(b):
            size = rng.randint(1, 30)
            pieces.append((f, base + at, b[at : at + size]))
            at += size
    whole = spark.createDataFrame(buffers, "flow int, buf binary")
    stream = byte_stream.blocks(spark.createDataFrame(pieces, "flow int, start long, data binary"))
    for responses, parse in ((False, http.http_requests), (True, http.http_responses)):
        want = whole.select("flow", F.explode(parse(F.col("buf"))["messages"]).alias("m")).select("flow", F.to_json("m")).collect()
        got = byte_stream.http_messages(stream, responses).select("flow", F.to_json("m")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_ftp_lines_over_packets(spark):
    text = b"220 hi\r\n331 more\r\n530 no\r\n23\r\n230 in\r\n230 not ended"
    rng = random.Random(4)
    rows, at, no = [], 0, 0
    while at < len(text):
        size = rng.randint(1, 5)
        rows.append((BASE + timedelta(seconds=no), "f", no, "s", "c", 21, 500 + at, text[at : at + size]))
        at, no = at + size, no + 1
    ends = {text.index(b"530 no\r\n") + 7: False, text.index(b"230 in\r\n") + 7: True}
    owner = {k: r[2] for r in rows for k in range(r[6] - 500, r[6] - 500 + len(r[7]))}
    rows.append((BASE, "g", 900, "s", "c", 22, 1, b"230 other port\r\n"))
    got = behavior.ftp_auth(spark.createDataFrame(rows, "ts timestamp, flow string, packet_no long, src_ip string, dst_ip string, src_port int, seq long, data binary")).collect()
    assert sorted((r["packet_no"], r["success"], r["src_ip"], r["dst_ip"]) for r in got) == sorted((owner[k], ok, "c", "s") for k, ok in ends.items())


PACKETS = "packet_no long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, proto string, tcp_flags string, seq long, payload binary, ip_id int, ip_proto int"


def packet(no, seconds, payload, seq, out=True, port=80):
    ends = ("10.0.0.1", "10.0.0.2", 4000, port) if out else ("10.0.0.2", "10.0.0.1", port, 4000)
    return (no, BASE + timedelta(seconds=seconds), *ends, "TCP", "PA", seq, payload, 1, 6)


def test_equal_requests_a_minute_apart_both_stay(spark):
    ask = b"GET /again HTTP/1.1\r\nHost: h\r\n\r\n"
    rows = [packet(1, 0, ask[:9], 10), packet(2, 1, ask[9:], 19), packet(3, 2, ask, 10 + len(ask)), packet(4, 61, ask, 10 + 2 * len(ask))]
    packets = detect.routed(spark.createDataFrame(rows, PACKETS))
    requests, _ = detect.http_messages(packets, detect.connection_numbers(packets))
    assert sorted(r["packet_no"] for r in requests.collect()) == [2, 3, 4]
    kept = flows.dedupe_requests(requests.withColumn("raw", F.col("m.raw")), 2)
    # the third comes one second after the second
    assert sorted(r["packet_no"] for r in kept.collect()) == [2, 4]


def test_logins_in_the_packets_are_seen(spark):
    ask = b"POST /login HTTP/1.1\r\nContent-Length: 2\r\n\r\nab"
    no, yes = b"HTTP/1.1 401 No\r\nContent-Length: 0\r\n\r\n", b"HTTP/1.1 302 Go\r\nContent-Length: 0\r\n\r\n"
    rows = [packet(1, 0, ask, 1), packet(2, 1, no, 1, False), packet(3, 20, ask, 1 + len(ask)), packet(4, 40, yes, 1 + len(no), False)]
    rows += [packet(5, 50, b"530 no\r", 7, False, 21), packet(6, 51, b"\n230 yes\r\n", 14, False, 21)]
    packets = detect.routed(spark.createDataFrame(rows, PACKETS))
    numbers = detect.connection_numbers(packets)
    found = detect.login_events(packets, numbers, *detect.http_messages(packets, numbers)).collect()
    # the second answer comes more than ten seconds after its request
    assert sorted((r["packet_no"], r["src_ip"], r["success"], r["auth_type"]) for r in found) == [
        (2, "10.0.0.1", False, "http"), (6, "10.0.0.1", False, "ftp"), (6, "10.0.0.1", True, "ftp"),
    ]


def test_detection_reads_its_packets_once(spark):
    ask = b"GET /license HTTP/1.1\r\nHost: h\r\n\r\n"
    rows = [packet(1, 0, ask, 1), packet(2, 5, b"a License text", 1, port=8000), packet(3, 90, b"nothing", 90, port=9000)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    packets = spark.createDataFrame(rows, PACKETS).mapInArrow(counted, PACKETS)
    run = detect.detect(packets, make_rules(spark, [{"id": "lic", "contents": [("license", {"nocase": True})]}]))
    assert [r["match_text"] for r in run.rule_alerts.filter("packet_no = 2 and match_rule = 'lic'").collect()] == ["license"]
    assert seen.value == len(rows)


def test_requests_and_responses_from_the_same_nodes(spark):
    text = "GET /a HTTP/1.1\r\nContent-Length: 3\r\n\r\nxyzHTTP/1.1 200 OK\r\n\r\nno\r\n\r\nPUT /b HTTP/1.1\r\n\r\n"
    rows = [(1, 0, 5, text), (2, 0, 0, "HTTP/1.1 302 Go\r\n\r\nHTTP/1.1 404 No\r\nContent-Length: 2\r\n\r\nab"), (3, 0, 0, "")]
    stream = spark.createDataFrame(rows, "flow long, block long, from long, text string")
    nodes = byte_stream.message_nodes(stream)
    for responses in (False, True):
        alone = sorted(map(tuple, byte_stream.message_frames(stream, responses).collect()))
        assert sorted(map(tuple, byte_stream.message_frames(stream, responses, nodes).collect())) == alone
        assert [f[:2] for f in alone] == ([(2, 0), (2, 19)] if responses else [(1, 5), (1, 5 + text.index("PUT"))])


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_not_shuffled_with_their_text(spark):
    rows = [(1, 0, 0, "A: b c\r\nContent-Length : 12\r\n\r\n content-le"), (2, 0, 3, "x\r\ny")]
    found = byte_stream.lines(spark.createDataFrame(rows, "flow long, block long, from long, text string"))
    got = sorted(tuple(r) for r in found.select("flow", "at", "spaces", "ends_header", "length", "_open").collect())
    assert got == [(1, 6, 2, False, 12, False), (1, 27, 4, True, None, False), (1, 29, 4, False, None, True), (2, 4, 0, False, None, False)]
    assert "lead(line" not in _plan(found)


def test_only_ranges_over_several_blocks_are_put_together(spark):
    size = byte_stream.BLOCK
    text = "".join(chr(33 + k % 90) for k in range(2 * size + 500))
    blocks = [(7, k, k * size, text[k * size : (k + 1) * size + byte_stream.OVER]) for k in range(3)]
    stream = spark.createDataFrame(blocks, "flow long, block long, from long, text string")
    ranges = [(7, 5, 9), (7, 5, 5), (7, size - 3, size + 2), (7, 10, 2 * size + 30), (7, size, 2 * size), (7, size - 2, size)]
    found = byte_stream.cut(stream, spark.createDataFrame(ranges, "flow long, begin long, end long"))
    assert {(r.begin, r.end): r.text for r in found.collect()} == {(b, e): text[b:e] for _, b, e in ranges}
    assert "Union" in _plan(found)  # ranges inside a block take no part in the grouping


def test_spans_that_nothing_covers_end_what_is_released(spark):
    rows = [(1, 0, 100, 10), (1, 1, 105, 10), (1, 2, 130, 5), (2, 0, 7, 3), (2, 1, 7, 3)]
    found = byte_stream.releases(spark.createDataFrame(rows, "flow long, arrival long, seq long, size long"))
    got = sorted((r.flow, r.start, r.stop, r.arrival, r.skip, r.released) for r in found.collect())
    assert got == [(1, 100, 105, 0, 0, 0), (1, 105, 110, 0, 5, 0), (1, 110, 115, 1, 5, 1), (2, 7, 10, 0, 0, 0)]
