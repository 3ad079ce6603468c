"""Rule text and matching on the pinned cases."""

import pytest
from pyspark.sql import functions as F

from packetloom.functions.packet import ascii_lower
from packetloom.operators import matching, rule_table, rule_text
from packetloom.plans.queries_rules import make_rules


def chain(spark, payload, contents):
    names = ("text", "nocase", "offset", "depth", "within", "distance")
    rows = [tuple({"text": t.lower() if o.get("nocase") else t, "nocase": bool(o.get("nocase")), **o}.get(n) for n in names) for t, o in contents]
    df = spark.createDataFrame(
        [(payload, rows)], "p string, c array<struct<text:string,nocase:boolean,offset:int,depth:int,within:int,distance:int>>"
    )
    return df.select(matching.content_chain(F.col("p"), ascii_lower(F.col("p")), F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "payload,contents,want",
    [
        ("xxAAyyBBzz", [("AA", {}), ("BB", {})], True),
        ("AAxxBB", [("AA", {}), ("BB", {"distance": 2, "within": 2})], True),
        ("AAxxxxBB", [("AA", {}), ("BB", {"within": 2})], False),
        ("zzAAzz", [("AA", {"offset": 2, "depth": 2})], True),
        ("zzzAAz", [("AA", {"offset": 2, "depth": 2})], False),
        ("xxaBxx", [("Ab", {"nocase": True})], True),
        ("BBAA", [("AA", {}), ("BB", {})], False),
    ],
)
def test_content_chain(spark, payload, contents, want):
    assert chain(spark, payload, contents) is want


def test_regexes_are_anded(spark):
    df = spark.createDataFrame([("ab", ["a", "b"]), ("a", ["a", "b"])], "t string, r array<string>")
    assert [r[0] for r in df.select(matching.regex_all(F.col("t"), F.col("r"))).collect()] == [True, False]


@pytest.mark.parametrize(
    "options,want",
    [
        (
            'content:"foo"; offset:5; depth:3; nocase; content:"bar"; within:4; distance:1;',
            [("foo", 5, 3, None, None, True), ("bar", None, None, 4, 1, False)],
        ),
        ('content:"foo",offset 7,depth 9;', [("foo", 7, 9, None, None, False)]),
        ('msg:"x"; content:"foo"; sid:1; nocase;', [("foo", None, None, None, None, False)]),
        ('content:"a"; odd; depth:4;', [("a", None, None, None, None, False)]),
    ],
)
def test_content_items(spark, options, want):
    got = spark.createDataFrame([(options,)], "o string").select(rule_text.content_items(F.col("o"))).first()[0]
    assert [(i["content"], i["offset"], i["depth"], i["within"], i["distance"], i["nocase"]) for i in got] == want


def test_rule_line(spark):
    lines = spark.createDataFrame(
        [
            ('alert tcp any any -> any 80 (msg:"x"; content:"foo"; nocase; sid:1; rev:1;)',),
            ("# comment",),
            ("",),
            ("nonsense",),
            ('alert tcp $EXTERNAL_NET any <> $HTTP_SERVERS $HTTP_PORTS (content:"|41 42|"; offset:1; byte_test:2,>,0x10,4,little; sid:2;)',),
        ],
        "line string",
    )
    rules = {r["rule_id"]: r for r in rule_text.convert_rules(lines, rule_text.default_variables(spark)).collect()}
    assert set(rules) == {"snort_1", "snort_2"}
    first, second = rules["snort_1"], rules["snort_2"]
    assert first["metadata"]["content_patterns"] == ["foo"] and first["metadata"]["content_options"][0]["nocase"]
    assert first["dst_ports"] == ["80"] and first["src_ports"] is None and first["enabled"]
    assert (second["src"], second["dst"], second["dst_ports"]) == ("!192.168.0.0/16", "192.168.0.0/16", ["80", "443"])
    assert second["metadata"]["content_patterns"] == ["AB"]
    assert second["metadata"]["byte_tests"][0]["value"] == 16
    summary = rule_text.import_summary(lines).first()
    assert (summary["total"], summary["success"], summary["failed_count"], summary["imported"]) == (3, 2, 1, 2)


PACKET = "packet_no bigint, src_ip string, src_port int, dst_ip string, dst_port int, proto string, payload binary, tcp_flags string"


def hits(spark, packets, specs, **options):
    df = spark.createDataFrame(packets, PACKET)
    return sorted((r["packet_no"], r["rule_id"]) for r in matching.match_packets(df, make_rules(spark, specs), **options).collect())


def test_match_packets_addresses_ports_and_case(spark):
    packets = [
        (1, "10.0.0.1", 1000, "192.168.1.5", 80, "TCP", b"GET Admin page", "PA"),
        (2, "192.168.1.5", 80, "10.0.0.1", 1000, "TCP", b"admin", "A"),
        (3, "10.0.0.9", 5, "8.8.8.8", 53, "UDP", b"\x00\x05admin", None),
    ]
    specs = [
        {"id": "nocase", "contents": [("ADMIN", {"nocase": True})]},
        {"id": "exact", "contents": ["admin"]},
        {"id": "both", "direction": "<>", "src": "10.0.0.1", "dst": "192.168.0.0/16", "dst_ports": ["80"], "contents": [("admin", {"nocase": True})]},
        {"id": "outside", "dst": "!192.168.0.0/16", "contents": ["admin"], "protocol": "udp"},
        {"id": "flag", "flags": "P", "contents": ["A"]},
        {"id": "byte", "tests": [(2, "=", 5, 0, "big")]},
        {"id": "off", "contents": ["admin"], "enabled": False},
    ]
    want = [(1, "both"), (1, "flag"), (1, "nocase"), (2, "both"), (2, "exact"), (2, "nocase"), (3, "byte"), (3, "exact"), (3, "nocase"), (3, "outside")]
    assert hits(spark, packets, specs) == want
    assert hits(spark, packets, specs, anchored=True) == want


def test_lookup_join_beyond_the_broadcast_bound(spark):
    from packetloom.operators.joins import lookup_join

    big = spark.createDataFrame([(i, i % 3) for i in range(300)], "id int, k int")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k int, v string")
    for how in ("inner", "left", "left_anti", "left_semi"):
        want = sorted(map(tuple, big.join(small, ["k"], how).collect()), key=repr)
        got = sorted(map(tuple, lookup_join(big, small, ["k"], how, rows=1, salts=4).collect()), key=repr)
        assert got == want, how


def test_insert_replace_delete(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "rule_id string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3), ("c", 4)], "rule_id string, v int")
    assert [tuple(r) for r in rule_table.insert_if_absent(old, new, ["v"]).collect()] == [("c", 3)]
    changed = rule_table.overlay(old, new.filter("rule_id = 'b'"))
    assert sorted(tuple(r) for r in changed.collect()) == [("a", 1), ("b", 9)]
    assert [tuple(r) for r in rule_table.delete_rules(old, new.select("rule_id")).collect()] == [("a", 1)]
