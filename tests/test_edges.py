"""Cases at the edges: deep variables, padded chunk sizes, sequence wrap, equal and missing times, broken capture files."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from packetloom.functions.http import dechunk
from packetloom.operators.behavior import brute_force
from packetloom.operators.flows import connections, reassemble
from packetloom.operators.joins import fits
from packetloom.operators.rule_text import convert_rules, default_variables, resolve_variables
from packetloom.operators.windows import silence
from packetloom.sources.capture import parse_frames, read_captures

T0 = datetime(2024, 1, 1)


def resolved(spark, pairs):
    rows = resolve_variables(spark.createDataFrame(pairs, "name string, value string")).collect()
    return {r["name"]: r["resolved"] for r in rows}


def test_variables_resolve_at_any_depth(spark):
    chain = [(f"$A{k}", f"$A{k + 1}") for k in range(40)] + [("$A40", "10.0.0.0/8"), ("$N", "!$A3"), ("$M", "$NOWHERE")]
    found = resolved(spark, chain)
    assert {found[f"$A{k}"] for k in range(41)} == {"10.0.0.0/8"}
    assert found["$N"] == "!10.0.0.0/8" and found["$M"] == "any"


def test_variables_inside_lists(spark):
    values = [
        ("$HOME_NET", "192.168.0.0/16"), ("$HTTP_PORTS", "80,443"), ("$BOTH", "[$HOME_NET, 10.0.0.0/8]"), ("$NOT", "![$BOTH,!1.2.3.4]"),
        ("$DEEP", "[$NOT,[!$NOT,[$GONE]]]"), ("$PORTS", "[8080,!$HTTP_PORTS]"), ("$PLAIN", "[ 1 , 2 ]"), ("$TWICE", "!!$HOME_NET"), ("$NONE", "[]"),
    ]
    found = resolved(spark, values)
    both = "192.168.0.0/16,10.0.0.0/8"
    assert found["$BOTH"] == f"[{both}]" and found["$PORTS"] == "[8080,!80,!443]"
    assert found["$NOT"] == "[!192.168.0.0/16,!10.0.0.0/8,1.2.3.4]"
    assert found["$DEEP"] == f"[!192.168.0.0/16,!10.0.0.0/8,1.2.3.4,{both},!1.2.3.4,any]"
    assert (found["$PLAIN"], found["$TWICE"], found["$NONE"]) == ("[ 1 , 2 ]", "!!192.168.0.0/16", "[]")
    with pytest.raises(ValueError, match=r"\$A, \$B"):
        resolved(spark, [("$A", "[1.1.1.1,$B]"), ("$B", "![$A,2.2.2.2]")])


def test_rules_with_variables_inside_lists(spark):
    lines = [('alert tcp [$HOME_NET,10.0.0.0/8] any -> ![$HOME_NET] [8080,!$HTTP_PORTS] (msg:"m"; content:"x"; sid:7; rev:1;)',)]
    rule = convert_rules(spark.createDataFrame(lines, "line string"), default_variables(spark)).first()
    assert (rule["src"], rule["dst"], rule["dst_ports"]) == ("[192.168.0.0/16,10.0.0.0/8]", "!192.168.0.0/16", ["8080", "!80", "!443"])


def test_variables_in_a_circle_are_named(spark):
    with pytest.raises(ValueError, match=r"\$A, \$B"):
        resolved(spark, [("$A", "$B"), ("$B", "$A"), ("$C", "any")])


@pytest.mark.parametrize(
    "body,want",
    [("00000005\r\nhello\r\n0\r\n\r\n", "hello"), ("000000000000000000005\r\nhello\r\n0\r\n\r\n", "hello"), ("FFFFFFFFFFFFFFFFFF\r\nhello\r\n", ""), ("5g\r\nhello\r\n", "")],
)
def test_chunk_sizes_have_any_number_of_digits(spark, body, want):
    assert spark.createDataFrame([(body,)], "b string").select(dechunk(F.col("b"))).first()[0] == want


def test_sequence_numbers_wrap(spark):
    rows = [("f", 1, 4294967293, b"abc"), ("f", 2, 0, b"def"), ("f", 3, 1, b"efgh"), ("g", 1, 5, b"xy"), ("g", 2, 4294967290, b"old")]
    pieces = reassemble(spark.createDataFrame(rows, "flow string, arrival long, seq long, data binary")).orderBy("flow", "start").collect()
    assert [(p["flow"], bytes(p["data"]), p["contiguous"]) for p in pieces] == [("f", b"abc", True), ("f", b"def", True), ("f", b"gh", True), ("g", b"xy", True)]


def test_connections_start_at_a_syn_or_after_a_pause(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [(1, "f", at(0), "S"), (2, "f", at(1), "S"), (3, "f", at(1.1), "A"), (4, "f", at(100), "PA"), (5, "f", at(221), "PA"), (6, "f", at(230), "S"), (7, "f", at(231), "SA"), (8, "g", at(5), None), (9, "f", None, "A")]
    found = connections(spark.createDataFrame(rows, "packet_no long, flow string, ts timestamp, tcp_flags string"))
    assert {r["packet_no"]: r["connection"] for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 3, 7: 3, 8: 1}


def test_failures_at_one_instant_count_each(spark):
    rows = [(k, T0, "a", "b", False, "ftp") for k in range(7)] + [(9, T0 + timedelta(seconds=1), "a", "b", False, "ftp"), (10, T0, "z", "b", False, "ftp")]
    auth = spark.createDataFrame(rows, "packet_no long, ts timestamp, src_ip string, dst_ip string, success boolean, auth_type string")
    found = sorted((r["packet_no"], r["failures"]) for r in brute_force(auth, 300, 5).collect())
    assert found == [(k, 7) for k in range(7)] + [(9, 8)]


def test_silence_of_ties_and_missing_times(spark):
    rows = [("k", T0, 2), ("k", T0, 1), ("k", None, 0), ("k", T0 + timedelta(seconds=3), 5), ("k", T0 + timedelta(seconds=3), 4), (None, T0, 7), ("k", T0 + timedelta(seconds=1), 3)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, n int")
    for derived in (False, True):
        found = silence(df, ["key"], "ts", 2, True, ["n"], derived).collect()
        assert sorted((r["key"] or "", r["n"]) for r in found) == [("", 7), ("k", 1), ("k", 4)]


def test_lookup_sides_are_bounded_in_bytes(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert fits(wide) and not fits(wide, size=5000) and not fits(wide, rows=9)


def test_unknown_capture_files_are_an_error(spark, tmp_path):
    (tmp_path / "a.pcapng").write_bytes(b"\x0a\x0d\x0d\x0a" + bytes(60))
    with pytest.raises(Exception, match="not a pcap file"):
        read_captures(spark, str(tmp_path)).collect()


def test_later_fragments_have_no_ports(spark):
    header = bytes([0x45, 0, 0, 40, 0, 1, 0x00, 0x10, 64, 6, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2])
    rows = [(1, 0, 101, header + b"GARBAGE BYTES OF DATA"), (2, 0, 101, header[:6] + b"\x20\x00" + header[8:] + bytes(20))]
    found = {r["packet_no"]: r for r in parse_frames(spark.createDataFrame(rows, "packet_no long, us long, link int, frame binary")).collect()}
    assert found[1]["proto"] == "IP" and found[1]["src_port"] is None and found[1]["tcp_flags"] is None
    assert bytes(found[1]["payload"]).startswith(b"GARBAGE")
    assert found[2]["proto"] == "TCP"


def test_a_large_lookup_table_is_never_broadcast(spark):
    # Spark's estimate is that of the small file; repeated over salts it does not fit the driver
    from packetloom.operators.joins import lookup_join
    from packetloom.operators.rule_table import overlay

    base = spark.range(30).selectExpr("id as rule_id", "'a' as name")
    small = spark.range(10).selectExpr("id as rule_id")
    for joined in (lookup_join(base, small, ["rule_id"], "left_anti", rows=5), lookup_join(base, small, ["rule_id"], "left_anti", rows=5, salts=1)):
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["rule_id"] for r in joined.collect()) == list(range(10, 30))
    changed = overlay(base, spark.range(3).selectExpr("id as rule_id", "'b' as name"))
    assert sorted(r["name"] for r in changed.collect()) == ["a"] * 27 + ["b"] * 3


def test_few_pieces_are_searched_not_cut(spark, monkeypatch):
    from packetloom.operators import matching

    packets = spark.createDataFrame([(1, bytearray(b"abcabcd")), (2, bytearray(b"zz")), (3, None)], "packet_no long, payload binary")
    literals = spark.createDataFrame([("x", "abc"), ("y", "bcabc"), ("z", "z"), ("none", "qrst")], "rule_id string, literal string")
    found = lambda: sorted((r["packet_no"], r["rule_id"], r["pos_start"], r["pos_end"]) for r in matching.literal_matches(packets, literals).collect())
    want = [(1, "x", 0, 2), (1, "x", 3, 5), (1, "y", 1, 5), (2, "z", 0, 0), (2, "z", 1, 1)]
    monkeypatch.setattr(matching, "FEW_GRAMS", 1)
    assert found() == want
    monkeypatch.undo()
    monkeypatch.setattr(matching, "_grams", lambda data, size, cut=matching._grams: cut(data, size) if "payload" not in str(data) else 1 / 0)
    assert found() == want
