"""Reassembly, handshake, sources, streams."""

import random
import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from packetloom.functions.packet import endpoint, flow_key
from packetloom.operators import alert_stream, behavior, correlate, flows
from packetloom.operators.counters import throughput
from packetloom.sources import capture, io
from packetloom.streaming import sinks, stateful

BASE = datetime(2024, 1, 1)

REASSEMBLY = [
    ([(100, b"abc"), (103, b"def")], b"abcdef", [b"abc", b"def"]),
    ([(100, b"abc"), (106, b"ghi"), (103, b"def")], b"abcdefghi", [b"abc", b"defghi"]),
    ([(10, b"hello"), (10, b"he")], b"hello", [b"hello"]),
    ([(10, b"hello"), (12, b"lloworld")], b"helloworld", [b"hello", b"world"]),
    ([(1, b"a"), (2, b"bc")], b"abc", [b"a", b"bc"]),
    ([(10, b"ab"), (20, b"zz")], b"ab", [b"ab"]),
]


def segments(spark):
    rows = [(f, i, BASE + timedelta(seconds=i), s, d) for f, (arr, _, _) in enumerate(REASSEMBLY) for i, (s, d) in enumerate(arr)]
    return spark.createDataFrame(rows, "flow int, arrival bigint, ts timestamp, seq bigint, data binary")


def test_reassembly(spark):
    whole = flows.flow_bytes(flows.reassemble(segments(spark)))
    got = {r["flow"]: bytes(r["data"]) for r in whole.collect()}
    assert got == {f: want for f, (_, want, _) in enumerate(REASSEMBLY)}


def test_tail_buffer(spark):
    df = spark.createDataFrame([("a", 1, b"1234"), ("a", 2, b"5678"), ("b", 1, b"xy")], "flow string, arrival bigint, data binary")
    got = {r["flow"]: bytes(r["buffer"]) for r in flows.tail_buffer(df, 5).collect()}
    assert got == {"a": b"45678", "b": b"xy"}


def random_tcp(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = ("10.0.0.1", 1000 + rng.randrange(2)), ("10.0.0.2", 80)
        if rng.random() < 0.5:
            a, b = b, a
        rows.append((i, BASE + timedelta(seconds=i * 7), *a, *b, rng.choice(["S", "SA", "A", "PA", "F", None, "PA", "A"])))
    return rows


TCP = "packet_no bigint, ts timestamp, src_ip string, src_port int, dst_ip string, dst_port int, tcp_flags string"


def handshake(rows):
    state, out = {}, {}
    for no, _, si, sp, di, dp, flags in rows:
        here, there = f"{si}:{sp}", f"{di}:{dp}"
        st = state.setdefault(min(here, there) + max(here, there), [None, False])
        f = flags or ""
        if "S" in f and "A" not in f:
            st[:] = [here, False]
        elif "S" in f and st[0] is None:
            st[0] = there
        if "A" in f and st[0]:
            st[1] = True
        out[no] = (st[1], None if st[0] is None else "to_server" if st[0] == here else "to_client")
    return out


def test_handshake(spark):
    rows = random_tcp(1, 200)
    got = flows.flow_state(spark.createDataFrame(rows, TCP))
    assert {r["packet_no"]: (r["flow_established"], r["flow_dir"]) for r in got.collect()} == handshake(rows)


# --------------------------------------------------------------------------- streams equal batches


def as_stream(spark, tmp_path, rows, schema, files=4):
    """Rows written in time order to several files and read back as a stream, one file per micro-batch."""
    import os

    df = spark.createDataFrame(rows, schema)
    folder = tmp_path / "in"
    size = -(-len(rows) // files)
    for i in range(files):
        part = folder / f"part{i}"
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.parquet(str(part))
        for f in part.glob("*.parquet"):
            os.utime(f, (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    return df, stream


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def alert_rows(n, seed):
    rng = random.Random(seed)
    return [(i, BASE + timedelta(seconds=i * 2), f"r{rng.randrange(3)}", rng.choice("ab"), "t", "m", "p") for i in range(n)]


def test_alert_dedupe_stream(spark, tmp_path):
    schema = "packet_no bigint, ts timestamp, match_rule string, src_ip string, dst_ip string, match_text string, payload_preview string"
    batch, stream = as_stream(spark, tmp_path, alert_rows(120, 3), schema)
    want = {r["packet_no"] for r in alert_stream.dedupe_alerts(batch, 10).collect()}
    keys = ["match_rule", "src_ip", "dst_ip", "match_text", "payload_preview"]
    got = run(spark, stateful.silence_stream(stream, keys, 10, True), "dedupe")
    assert {r["packet_no"] for r in got.collect()} == want


def test_same_alert_twice_in_the_window_is_one(spark):
    rows = [(1, BASE, "r", "a", "b", "m", "p"), (2, BASE + timedelta(seconds=10), "r", "a", "b", "m", "p"), (3, BASE + timedelta(seconds=11), "r", "a", "b", "m", "p")]
    df = spark.createDataFrame(rows, "packet_no bigint, ts timestamp, match_rule string, src_ip string, dst_ip string, match_text string, payload_preview string")
    assert sorted(r["packet_no"] for r in alert_stream.dedupe_alerts(df, 10).collect()) == [1, 3]


def test_brute_force_and_scoring_streams(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, BASE + timedelta(seconds=i * 5), rng.choice("ab"), "t", rng.random() < 0.3, "ssh") for i in range(160)]
    batch, stream = as_stream(spark, tmp_path, rows, "packet_no bigint, ts timestamp, src_ip string, dst_ip string, success boolean, auth_type string")
    want = sorted(map(tuple, behavior.brute_force(batch, 60, 4).collect()))
    got = run(spark, stateful.brute_force_stream(stream, 60, 4), "brute")
    assert sorted(map(tuple, got.collect())) == want and want


def test_scoring_stream_and_severity_counts(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, BASE + timedelta(seconds=i * 5), rng.choice("ab"), f"r{rng.randrange(5)}", rng.random() < 0.3, rng.choice(["high", "x", None])) for i in range(160)]
    batch, stream = as_stream(spark, tmp_path, rows, "packet_no bigint, ts timestamp, src_ip string, rule_id string, is_behavior boolean, severity string")
    want = sorted(map(tuple, correlate.score_attackers(batch, 60, 3, 5, 2).collect()))
    got = run(spark, stateful.score_attackers_stream(stream, 60, 3, 5, 2), "scored")
    assert sorted(map(tuple, got.collect())) == want and want
    counts = run(spark, stateful.severity_counts_stream(stream), "severities", "complete")
    assert {r["severity"]: r["count"] for r in counts.collect()} == {
        "high": sum(r[5] == "high" for r in rows), "low": sum(r[5] != "high" for r in rows)
    }


def test_port_scan_stream(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, BASE + timedelta(milliseconds=i * 300), rng.choice("ab"), f"h{rng.randrange(4)}", rng.randrange(12), "TCP") for i in range(240)]
    batch, stream = as_stream(spark, tmp_path, rows, "packet_no bigint, ts timestamp, src_ip string, dst_ip string, dst_port int, proto string")
    args = {"window": 20, "threshold": 10, "min_ports": 10, "min_targets": 4, "dedupe": 1}
    want = sorted(map(tuple, behavior.port_scan(batch, cooldown=None, **args).collect()))
    got = run(spark, stateful.port_scan_stream(stream, **args), "scans")
    assert sorted(map(tuple, got.collect())) == want and want


def test_flow_state_stream(spark, tmp_path):
    rows = random_tcp(2, 160)
    _, stream = as_stream(spark, tmp_path, rows, TCP)
    got = run(spark, stateful.flow_state_stream(stream), "flow_states")
    assert {r["packet_no"]: (r["flow_established"], r["flow_dir"]) for r in got.collect()} == handshake(rows)


def test_reassembly_stream(spark, tmp_path):
    rows = [tuple(r) for r in segments(spark).collect()]
    _, stream = as_stream(spark, tmp_path, sorted(rows, key=lambda r: r[2]), "flow int, arrival bigint, ts timestamp, seq bigint, data binary", 3)
    got = run(spark, stateful.reassemble_stream(stream), "pieces").orderBy("flow", "arrival").collect()
    for f, (_, _, emitted) in enumerate(REASSEMBLY):
        assert [bytes(r["data"]) for r in got if r["flow"] == f] == emitted


def test_attacker_sink_keeps_first_seen(spark, tmp_path):
    rows = [(BASE + timedelta(minutes=i), "a" if i % 2 else "b", "high" if i > 4 else "medium") for i in range(8)]
    _, stream = as_stream(spark, tmp_path, rows, "ts timestamp, src_ip string, severity string")
    out = str(tmp_path / "attackers")
    sinks.attacker_sink(stream, out, str(tmp_path / "cp"), available_now=True).awaitTermination(300)
    got = {r["src_ip"]: (r["severity"], r["first_seen"]) for r in sinks.read_attackers(spark, out).collect()}
    assert got == {"a": ("high", BASE + timedelta(minutes=1)), "b": ("high", BASE)}


# --------------------------------------------------------------------------- sources and sinks


def ipv4(proto, body, src=(10, 0, 0, 1), dst=(10, 0, 0, 2), ip_id=7):
    return struct.pack(">BBHHHBBH4B4B", 0x45, 0, 20 + len(body), ip_id, 0, 64, proto, 0, *src, *dst) + body


def tcp(data, sport=1234, dport=80, seq=100, flags=0x18):
    return struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 5 << 4, flags, 512, 0, 0) + data


def ethernet(payload, kind=0x0800):
    return b"\0" * 12 + struct.pack(">H", kind) + payload


@pytest.fixture
def capture_file(tmp_path):
    frames = [
        ethernet(ipv4(6, tcp(b"GET / HTTP/1.1"))) + b"\0\0\0",  # padded
        ethernet(ipv4(17, struct.pack(">HHHH", 5353, 53, 11, 0) + b"abc")),
        ethernet(ipv4(1, struct.pack(">BBHI", 8, 0, 0, 1) + b"ping")),
        ethernet(b"\x60" + b"\0" * 39, 0x86DD),
        ethernet(struct.pack(">HH", 5, 0x0800) + ipv4(6, tcp(b"", flags=0x02)), 0x8100),
        ethernet(ipv4(89, b"ospf")),
    ]
    data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        data += struct.pack("<IIII", 1_700_000_000 + i, 250_000, len(f), len(f)) + f
    path = tmp_path / "x.pcap"
    path.write_bytes(data + b"\1\2\3")  # a cut-off record at the end
    return str(path)


@pytest.mark.parametrize("chunk", [1, 150, 1 << 20])
def test_capture(spark, capture_file, chunk):
    rows = {r["packet_no"]: r for r in capture.read_captures(spark, capture_file, chunk_bytes=chunk).collect()}
    assert sorted(rows) == [1, 2, 3, 5, 6]
    first = rows[1]
    assert (first["src_ip"], first["src_port"], first["dst_port"], first["proto"], first["tcp_flags"]) == ("10.0.0.1", 1234, 80, "TCP", "PA")
    assert bytes(first["payload"]) == b"GET / HTTP/1.1" and first["seq"] == 100 and first["window"] == 512
    assert bytes(rows[2]["payload"]) == b"abc" and rows[2]["dst_port"] == 53
    assert (rows[3]["icmp_type"], rows[3]["icmp_code"], bytes(rows[3]["payload"])) == (8, 0, b"ping")
    assert rows[5]["tcp_flags"] == "S" and bytes(rows[5]["payload"]) == b""
    assert rows[6]["proto"] == "IP" and bytes(rows[6]["payload"]) == b"ospf"
    assert str(first["ts"]).endswith(".250000")


def test_capture_cap(spark, capture_file):
    assert capture.read_captures(spark, capture_file, max_packets=2).count() == 2


def test_rule_and_alert_files(spark, tmp_path):
    (tmp_path / "a.rules").write_bytes(b"# c\n\n alert x \xff\nalert y\n")
    assert [r["line"][:7] for r in io.read_rule_text(spark, str(tmp_path / "a.rules")).collect()] == ["alert x", "alert y"]
    (tmp_path / "r.json").write_text('[{"name": "n", "patterns": ["p"], "severity": "high"}, {"name": "m"}]')
    got = io.read_json_rules(spark, str(tmp_path / "r.json")).collect()
    assert [(r["name"], r["pattern"], r["priority"]) for r in got] == [("n", ["p"], 1)]
    alerts = spark.createDataFrame(
        [(BASE, "r1", "m\0", "a", "b", 0, 1, None, "sum", 1, None)],
        "ts timestamp, match_rule string, match_text string, src_ip string, dst_ip string, pos_start int, pos_end int, "
        "payload_preview string, packet_summary string, priority int, severity string",
    )
    io.append_alerts(alerts, str(tmp_path / "alerts"))
    io.append_alerts(alerts, str(tmp_path / "alerts"))
    stored = io.read_alerts(spark, str(tmp_path / "alerts"))
    assert stored.count() == 2
    row = stored.first()
    assert (row["match_text"], row["payload_preview"], row["severity"]) == ("m\\x00", "sum", "high")
    io.export_csv(
        stored.withColumn("effective_severity", F.lit("high")).withColumn("payload_preview", F.lit('say "x", ok')),
        str(tmp_path / "csv"),
    )
    text = "".join(f.read_text() for f in (tmp_path / "csv").glob("*.csv"))
    assert '"say ""x"", ok"' in text and "time" in text


def test_throughput(spark):
    seen = throughput(spark.range(1000))
    assert seen["rows"] == 1000 and seen["per_second"] > 0


def test_flow_key_is_direction_free(spark):
    df = spark.createDataFrame([("a", 1, "b", 2), ("b", 2, "a", 1)], "s string, sp int, d string, dp int")
    keys = {r[0] for r in df.select(flow_key(*[F.col(c) for c in ("s", "sp", "d", "dp")])).collect()}
    assert keys == {"a:1<->b:2"}
    assert df.select(endpoint(F.col("s"), F.col("sp"))).first()[0] == "a:1"
