"""Rules against packets: candidate pairs by equi-join, then the content of each pair.

Every stage is a projection or an equi-join with the rule table; nothing about a
packet is shuffled while the rule table is small enough to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.packet import ascii_lower, flag_set, latin1, let, utf8_lossy
from packetloom.functions.rules import (
    address_matches,
    address_spec,
    byte_test,
    flow_matches,
    flow_tokens,
    ip_number,
    java_regex,
    literal_bytes,
    port_matches,
    port_spec,
    size_matches,
    size_spec,
)
from packetloom.operators.joins import lookup_join
from packetloom.operators.materialize import materialize

GRAM = 4
FEW_GRAMS = 128  # so many pieces are searched for one by one; more are met by cutting payloads into pieces
KEYED_PORTS = 64  # rules naming at most this many ports are joined on the port

PACKET_DEFAULTS = {
    "ip_id": "int", "ip_proto": "int", "tcp_flags": "string", "buffers": "map<string,binary>", "app_proto": "string",
    "flow_dir": "string", "flow_established": "boolean", "stream": "boolean",
}


# --------------------------------------------------------------------------- rules, prepared once


def compile_rules(rules: DataFrame) -> DataFrame:
    """Enabled rules as ``rule_id, r struct<…>`` with every text turned into values."""
    md = F.col("metadata")
    protocol = F.upper(F.coalesce(F.col("protocol"), F.lit("ANY")))
    kind = (
        F.when(F.coalesce(md["byte_test_only"], F.lit(False)), "byte_test")
        .when(F.col("pattern_type") == "pcre", "pcre")
        .otherwise("string")
    )
    chained = F.coalesce(F.size(md["content_patterns"]) > 0, F.lit(False))
    texts = F.when(chained, md["content_patterns"]).when(
        kind == "string", F.transform("pattern", literal_bytes)
    ).otherwise(F.array().cast("array<string>"))

    def content(text, i):
        option = F.get(md["content_options"], i)
        nocase = F.coalesce(option["nocase"], F.lit(False))
        return F.struct(
            F.when(nocase, ascii_lower(text)).otherwise(text).alias("text"),
            text.alias("shown"),
            nocase.alias("nocase"),
            *[option[n].alias(n) for n in ("offset", "depth", "within", "distance")],
        )

    contents = F.filter(F.transform(texts, content), lambda c: F.length(c["text"]) > 0)
    sized = F.transform(
        contents, lambda c: F.struct(F.length(c["text"]).alias("n"), c["text"].alias("text"), c["nocase"].alias("nocase"))
    )
    longest = F.array_max(sized)
    buffer = (
        F.when(F.coalesce(md["dns_query"], F.lit(False)), "dns_query")
        .when(F.coalesce(md["smtp_command"], F.lit(False)), "smtp_command")
        .when(F.coalesce(md["pop_command"], F.lit(False)), "pop_command")
        .otherwise("raw")
    )
    app = _pick(buffer, {"dns_query": "dns", "smtp_command": "smtp", "pop_command": "pop3"})
    return rules.filter(F.coalesce(F.col("enabled"), F.lit(True))).select(
        "rule_id",
        F.struct(
            F.col("priority").cast("int").alias("priority"),
            F.col("description").alias("description"),
            F.when(protocol.isin("", "IP", "ANY"), "ANY").otherwise(protocol).alias("protocol"),
            (protocol.isNotNull() & (protocol != "ANY") & (protocol != "")).alias("has_protocol"),
            (F.coalesce(F.col("direction"), F.lit("->")) == "<>").alias("both_ways"),
            F.coalesce(F.col("src"), F.lit("any")).alias("src_text"),
            F.coalesce(F.col("dst"), F.lit("any")).alias("dst_text"),
            address_spec(F.col("src")).alias("src"),
            address_spec(F.col("dst")).alias("dst"),
            port_spec(F.col("src_ports")).alias("src_ports"),
            port_spec(F.col("dst_ports")).alias("dst_ports"),
            kind.alias("kind"),
            contents.alias("contents"),
            chained.alias("chained"),
            F.when(chained, longest["text"]).alias("anchor"),
            F.when(chained, longest["nocase"]).alias("anchor_nocase"),
            F.when(kind == "pcre", F.transform("pattern", java_regex))
            .otherwise(F.array().cast("array<string>"))
            .alias("regexes"),
            F.coalesce(md["byte_tests"], F.array().cast("array<struct<bytes:int,op:string,value:decimal(20,0),offset:int,relative:boolean,endian:string,raw:string>>")).alias("tests"),
            F.coalesce(md["isdataat"], F.array().cast("array<struct<offset:int,negated:boolean,relative:boolean,raw:string>>")).alias("checks"),
            size_spec(md["dsize"]).alias("size"),
            F.when(md["flags"].isNotNull() & (md["flags"] != ""), flag_set(md["flags"])).alias("flags"),
            flow_tokens(md["flow"]).alias("flow"),
            md["ip_id"].alias("ip_id"),
            md["ip_proto"].alias("ip_proto"),
            buffer.alias("buffer"),
            app.alias("app"),
        ).alias("r"),
    )


def _pick(key: Column, table: dict) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out


def _port_keys(spec: Column) -> Column:
    """Port numbers of a short positive list, null when the list does not bound the ports."""
    positive = F.filter(spec, lambda p: ~p["neg"])
    width = F.aggregate(positive, F.lit(0), lambda n, p: n + p["hi"] - p["lo"] + 1)
    numbers = F.flatten(F.transform(positive, lambda p: F.sequence(p["lo"], F.greatest(p["lo"], p["hi"]))))
    return F.when((F.size(positive) > 0) & (width <= KEYED_PORTS), F.transform(numbers, lambda n: n.cast("string")))


def header_keys(r: Column) -> Column:
    """Join keys ``protocol|port`` of a compiled rule."""
    ahead, back = _port_keys(r["dst_ports"]), _port_keys(r["src_ports"])
    ports = F.when(~r["both_ways"], ahead).when(ahead.isNotNull() & back.isNotNull(), F.concat(ahead, back))
    ports = F.array_distinct(F.coalesce(ports, F.array(F.lit("any"))))
    return F.transform(ports, lambda p: F.concat(r["protocol"], F.lit("|"), p))


# --------------------------------------------------------------------------- header predicates


def direction_matches(r: Column) -> Column:
    """Addresses and ports of the packet (``src_ip, src_port, …, src_number, dst_number``) fit the rule."""
    src = (F.col("src_ip"), F.col("src_number"))
    dst = (F.col("dst_ip"), F.col("dst_number"))
    sport, dport = F.col("src_port"), F.col("dst_port")
    ahead = (
        port_matches(r["dst_ports"], dport)
        & port_matches(r["src_ports"], sport)
        & address_matches(r["dst"], *dst)
        & address_matches(r["src"], *src)
    )
    back = (
        port_matches(r["dst_ports"], sport)
        & port_matches(r["src_ports"], dport)
        & address_matches(r["dst"], *src)
        & address_matches(r["src"], *dst)
    )
    return ahead | (r["both_ways"] & back)


def specificity(r: Column) -> Column:
    """How specific a matching rule is: ports before addresses before protocol."""

    def listed(spec, port):
        return F.when(
            F.exists(spec, lambda p: ~p["neg"] & (p["lo"] <= port) & (port <= p["hi"])), 50
        ).otherwise(0)

    ports = listed(r["dst_ports"], F.col("dst_port")) + listed(r["src_ports"], F.col("src_port"))
    hosts = F.when(r["src_text"] == F.col("src_ip"), 5).otherwise(0) + F.when(
        r["dst_text"] == F.col("dst_ip"), 5
    ).otherwise(0)
    return (
        F.when(ports > 0, ports + 100).otherwise(0)
        + F.when(hosts > 0, hosts + 10).otherwise(0)
        + F.when(r["has_protocol"], 1).otherwise(0)
    )


def candidates(packets: DataFrame, rules: DataFrame | PreparedRules) -> DataFrame:
    """Packet and rule pairs whose protocol, direction, addresses and ports fit.

    Adds ``rule_id, r, score``.  Rules are keyed by protocol and destination port
    (or any), packets carry the four keys they can meet, and a rule meets a
    packet under one key only, so the join is an equi-join without duplicates.
    """
    return _with_rules(_numbered(packets), prepare_rules(rules).keyed)


@dataclass(frozen=True)
class PreparedRules:
    """Compiled rules as small tables of their own, prepared once and used by many plans."""

    compiled: DataFrame
    keyed: DataFrame


def prepare_rules(rules: DataFrame | PreparedRules) -> PreparedRules:
    if isinstance(rules, PreparedRules):
        return rules
    compiled = materialize(compile_rules(rules))
    return PreparedRules(compiled, _keyed(compiled))


def _keyed(compiled: DataFrame) -> DataFrame:
    return materialize(compiled.withColumn("_key", F.explode(header_keys(F.col("r")))))


def _numbered(packets: DataFrame) -> DataFrame:
    return packets.withColumns(
        {"src_number": ip_number(F.col("src_ip")), "dst_number": ip_number(F.col("dst_ip"))}
    )


def _with_rules(packets: DataFrame, keyed_rules: DataFrame) -> DataFrame:
    proto = F.coalesce(F.upper("proto"), F.lit("IP"))
    port = F.coalesce(F.col("dst_port").cast("string"), F.lit("any"))
    keys = [F.concat(p, F.lit("|"), q) for p in (proto, F.lit("ANY")) for q in (port, F.lit("any"))]
    met = packets.withColumn("_key", F.explode(F.array_distinct(F.array(*keys))))
    r = F.col("r")
    return (
        lookup_join(met, keyed_rules, ["_key"])
        .filter(direction_matches(r))
        .withColumn("score", specificity(r))
        .drop("_key")
    )


# --------------------------------------------------------------------------- content predicates


def content_chain(text: Column, low: Column, contents: Column) -> Column:
    """All contents occur in order, each in the window its options and the one before allow."""
    size = F.length(text)

    def step(acc, c):
        at, first = acc["at"], acc["first"]
        length = F.length(c["text"])
        moved = at + F.when(c["distance"] >= 0, c["distance"]).otherwise(0)
        later = F.when(c["offset"] >= 0, F.greatest(moved, c["offset"])).otherwise(moved)
        begins = F.when(first, F.greatest(F.coalesce(c["offset"], F.lit(0)), F.lit(0))).otherwise(later)

        def search(start):
            base = F.when(c["offset"] >= 0, c["offset"]).otherwise(start)
            reach = F.when(c["depth"] >= 0, F.least(size, base + c["depth"])).otherwise(size)
            near = F.when(~first & (c["within"] >= 0), at + c["within"] + length)
            end = F.least(reach, near)  # ignores a missing bound
            segment = F.when(c["nocase"], low).otherwise(text).substr(start + 1, F.greatest(end - start, F.lit(0)))
            hit = F.when((end >= start) & (start <= size), F.call_function("locate", c["text"], segment))
            return F.when(hit > 0, start + hit - 1 + length)

        def advance(stop):
            return F.struct(
                F.coalesce(stop, at).alias("at"), stop.isNotNull().alias("ok"), F.lit(False).alias("first")
            )

        return F.when(acc["ok"], let(let(begins, search), advance)).otherwise(acc)

    begin = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"), F.lit(True).alias("first"))
    return F.coalesce(F.aggregate(contents, begin, step, lambda acc: acc["ok"]), F.lit(False))


def occurrences(haystack: Column, needle: Column) -> Column:
    """Zero-based starts of all, also overlapping, occurrences (binary columns)."""

    # cut before every place where the needle begins; the lengths of the parts add up to these places
    text, lit = latin1(haystack), latin1(needle)
    ahead = F.concat(F.lit("(?=(?s:"), F.regexp_replace(lit, "([^A-Za-z0-9])", r"\\$1"), F.lit("))"))

    def starts(parts):
        lengths = F.transform(F.slice(parts, 1, F.size(parts) - 1), F.length)
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

        def step(acc, n):
            return F.struct((acc["at"] + n).alias("at"), F.concat(acc["found"], F.array(acc["at"] + n)).alias("found"))

        return F.aggregate(lengths, begin, step, lambda acc: acc["found"])

    later = let(F.split(text, ahead, -1), starts)
    # a part in front of the first character would be empty and is not made
    first = F.when(F.startswith(text, lit), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.when((F.length(lit) > 0) & F.contains(text, lit), F.concat(first, later)).otherwise(F.array().cast("array<int>"))


def regex_all(text: Column, regexes: Column) -> Column:
    return (F.size(regexes) > 0) & F.forall(regexes, lambda r: F.rlike(text, r))


def _data_ok(checks: Column, size: Column, base: Column) -> Column:
    def ok(c):
        has = size > F.when(c["relative"], base).otherwise(0) + c["offset"]
        return has != c["negated"]

    return F.forall(checks, ok)


def _first_literal(r: Column, text: Column, low: Column, size: Column) -> Column:
    """Earliest ending occurrence (longer text first) that passes the data checks."""
    every = F.exists(r["checks"], lambda c: c["negated"] & c["relative"])

    def spans(c):
        hay = F.when(c["nocase"], low).otherwise(text)
        length = F.length(c["text"])
        span = lambda start: F.struct(
            (start + length - 1).alias("stop"), (-length).alias("order"), start.alias("start"), c["shown"].alias("shown")
        )
        one = F.call_function("locate", c["text"], hay) - 1
        all_ = F.transform(occurrences(F.encode(hay, "ISO-8859-1"), F.encode(c["text"], "ISO-8859-1")), span)
        return F.when(every, all_).otherwise(F.filter(F.array(span(one)), lambda s: s["start"] >= 0))

    found = F.flatten(F.transform(r["contents"], spans))
    return F.array_min(F.filter(found, lambda s: _data_ok(r["checks"], size, s["stop"] + 1)))


def packet_filters(r: Column, size: Column) -> Column:
    """Size, application, header field and flag options of a rule."""
    no = F.lit(False)
    return (
        F.coalesce(size_matches(r["size"], size), no)
        & (r["app"].isNull() | F.coalesce(r["app"] == F.lower("app_proto"), no))
        & (r["ip_id"].isNull() | F.coalesce(r["ip_id"].try_cast("int") == F.col("ip_id"), no))
        & (r["ip_proto"].isNull() | F.coalesce(r["ip_proto"].try_cast("int") == F.col("ip_proto"), no))
        & (
            r["flags"].isNull()
            | ((F.size(r["flags"]) > 0) & (F.size(F.array_except(r["flags"], F.col("_flags"))) == 0))
        )
    )


def flow_filter(tokens: Column) -> Column:
    """Flow keywords against the flow columns of the packet."""
    return flow_matches(tokens, F.col("flow_dir"), F.col("flow_established"), F.col("stream"))


def _prepared(packets: DataFrame) -> DataFrame:
    """Packets with all columns rules look at; payload texts are computed once per packet."""
    missing = {c: F.lit(None).cast(t) for c, t in PACKET_DEFAULTS.items() if c not in packets.columns}
    out = packets.withColumns(missing) if missing else packets
    text = latin1(F.col("payload"))
    return _numbered(out).withColumns(
        {"_text": text, "_low": ascii_lower(text), "_flags": flag_set(F.col("tcp_flags"))}
    )


def _verified(pairs: DataFrame, defer_flow: bool) -> DataFrame:
    """Candidate pairs whose content options hold, with the first match of each pair."""
    r = F.col("r")
    if not defer_flow:
        pairs = pairs.filter(flow_filter(r["flow"]))
    raw = r["buffer"] == "raw"
    sticky = F.try_element_at("buffers", r["buffer"])
    whole = raw | (r["kind"] == "byte_test")
    text = F.when(whole, F.col("_text")).otherwise(latin1(sticky))
    low = F.when(whole, F.col("_low")).otherwise(ascii_lower(latin1(sticky)))
    bytes_ = F.when(whole, F.col("payload")).otherwise(sticky)
    size = F.coalesce(F.length(bytes_), F.lit(0))
    literal = F.when(r["anchor"].isNull(), F.lit(True)).when(r["anchor_nocase"], F.contains(low, r["anchor"])).otherwise(F.contains(text, r["anchor"]))

    def regex_span(utf8):
        head = F.get(r["regexes"], F.lit(0))
        at = F.call_function("regexp_instr", utf8, head) - 1
        shown = F.call_function("regexp_extract", utf8, head, F.lit(0))
        span = F.struct(
            (at + F.length(shown)).alias("stop"), F.lit(0).alias("order"), at.alias("start"), shown.alias("shown")
        )
        checked = let(span, lambda s: F.when(_data_ok(r["checks"], size, s["stop"]), s))
        return F.when(regex_all(utf8, r["regexes"]), checked)

    none = F.lit(None).cast("int")
    test_span = F.struct(none.alias("stop"), F.lit(0).alias("order"), none.alias("start"), F.lit("byte_test").alias("shown"))
    chain = ~r["chained"] | content_chain(text, low, r["contents"])
    found = (
        F.when((r["kind"] == "string") & (size > 0), F.when(chain, _first_literal(r, text, low, size)))
        .when((r["kind"] == "pcre") & (size > 0), F.when(chain, let(utf8_lossy(bytes_), regex_span)))
        .when(r["kind"] == "byte_test", F.when(_data_ok(r["checks"], size, F.lit(0)) & (F.size(r["tests"]) > 0) & chain, test_span))
    )
    return (
        pairs.filter(packet_filters(r, size) & F.coalesce(literal, F.lit(False)))
        .filter(F.forall(r["tests"], lambda t: byte_test(F.col("payload"), t)))
        .withColumn("_m", found)
        .filter("_m is not null")
        .withColumns(
            {
                "match_text": F.col("_m.shown"),
                "match_type": r["kind"],
                "pos_start": F.col("_m.start"),
                "pos_end": F.col("_m.stop"),
                "buffer": r["buffer"],
                "message": r["description"],
                "priority": r["priority"],
                **({"flow_tokens": r["flow"]} if defer_flow else {}),
            }
        )
        .drop("_m", "r", "_text", "_low", "_flags", "src_number", "dst_number")
    )


def match_packets(
    packets: DataFrame, rules: DataFrame | PreparedRules, anchored: bool = False, defer_flow: bool = False
) -> DataFrame:
    """First match per packet and rule, with the packet's columns.

    ``anchored`` is for rule sets so large that testing every literal costs more
    than cutting the payload into 4-byte pieces: rules with a literal of four
    bytes or more are then found by an equi-join on one piece of their longest
    literal, all others by header as usual.  With ``defer_flow`` the flow
    keywords are not tested but handed on as ``flow_tokens``, so that the flow
    state has to be joined to the matches only.
    """
    prepared = prepare_rules(rules)
    compiled = prepared.compiled
    ready = _prepared(packets)
    r = F.col("r")
    if not anchored:
        return _verified(_with_rules(ready, prepared.keyed), defer_flow)
    gram = ascii_lower(r["anchor"]).substr(1, GRAM)
    long_enough = (r["buffer"] == "raw") & (F.length(r["anchor"]) >= GRAM)
    by_gram = materialize(compiled.filter(F.coalesce(long_enough, F.lit(False))).withColumn("_gram", gram))
    others = _keyed(compiled.filter(~F.coalesce(long_enough, F.lit(False))))
    some = _few_grams(by_gram)
    grams = _grams(F.encode("_low", "ISO-8859-1"), GRAM) if some is None else _held(F.col("_low"), some)
    pieces = ready.withColumn("_gram", F.explode(grams))
    proto = F.coalesce(F.upper("proto"), F.lit("IP"))
    found = (
        lookup_join(pieces, by_gram, ["_gram"])
        .filter(r["protocol"].isin("ANY") | (r["protocol"] == proto))
        .filter(direction_matches(r))
        .withColumn("score", specificity(r))
        .drop("_gram")
    )
    return _verified(found, defer_flow).unionByName(_verified(_with_rules(ready, others), defer_flow))


def _grams(data: Column, size: int) -> Column:
    """Distinct pieces of ``size`` bytes as text (bytes have no hashed distinct in Spark)."""

    def cut(bytes_):
        last = F.length(bytes_) - size
        pieces = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: latin1(bytes_.substr(i + 1, F.lit(size)))
        )
        return F.when(last >= 0, F.array_distinct(pieces))

    return let(data, cut)


def _few_grams(named: DataFrame) -> list[str] | None:
    """The distinct pieces (``_gram``) if they are at most ``FEW_GRAMS``."""
    found = [row[0] for row in named.select("_gram").distinct().limit(FEW_GRAMS + 1).collect()]
    return found if len(found) <= FEW_GRAMS else None


def _held(text: Column, grams: list[str]) -> Column:
    """Those of a few pieces that a text holds."""
    if not grams:
        return F.array().cast("array<string>")
    return let(text, lambda t: F.filter(F.array(*[F.lit(g) for g in sorted(grams)]), lambda g: F.contains(t, g)))


def literal_matches(payloads: DataFrame, literals: DataFrame, key: str = "packet_no") -> DataFrame:
    """One row per occurrence: ``key, rule_id, match_text, pos_start, pos_end`` (inclusive).

    ``literals`` has ``rule_id, literal``; ``key`` tells payloads apart. Literals meet payloads by pieces of up to four
    bytes, never as all pairs: payloads give (key, piece), without the payload, for the pieces that literals have. Of a
    literal's pieces the one that fewest payloads hold makes the candidates; only these meet their payload again.
    """
    prepared = literals.withColumn("_l", literal_bytes(F.col("literal"))).filter(F.length("_l") > 0)
    prepared = prepared.withColumn("_needle", F.encode("_l", "ISO-8859-1"))
    own = F.when(F.length("_needle") >= GRAM, _grams(F.col("_needle"), GRAM)).otherwise(F.array("_l"))
    named = materialize(prepared.select("rule_id", "_l", "_needle", F.explode(own).alias("_gram")))
    some = _few_grams(named)
    if some is not None:
        hits = payloads.select(key, F.explode(_held(latin1(F.col("payload")), some)).alias("_gram"))
    else:
        # at most GRAM different piece lengths
        lengths = sorted(row[0] for row in named.select(F.length("_gram")).distinct().collect())
        grams = F.concat(*[F.coalesce(_grams(F.col("payload"), n), F.array().cast("array<string>")) for n in lengths])
        pieces = payloads.select(key, F.explode(grams).alias("_gram"))
        hits = lookup_join(pieces, materialize(named.select("_gram").distinct()), ["_gram"]).select(key, "_gram")
    hits = materialize(hits)
    often = hits.groupBy("_gram").agg(F.count(F.lit(1)).alias("_often"))
    rarest = named.join(often, "_gram").groupBy("rule_id", "_l", "_needle").agg(F.min_by("_gram", F.struct("_often", "_gram")).alias("_gram"), F.count(F.lit(1)).alias("_met"))
    # a literal with a piece that no payload holds is nowhere
    whole = named.groupBy("rule_id", "_l", "_needle").agg(F.count(F.lit(1)).alias("_pieces"))
    rarest = materialize(rarest.join(whole, ["rule_id", "_l", "_needle"]).filter("_met = _pieces").drop("_met", "_pieces"))
    candidates = lookup_join(hits, rarest, ["_gram"]).select(key, "rule_id", "_l", "_needle")
    pairs = candidates.join(payloads.select(key, "payload"), key).filter(F.contains("payload", "_needle"))
    start = F.explode(occurrences(F.col("payload"), F.col("_needle")))
    return pairs.select(key, "rule_id", F.col("_l").alias("match_text"), F.length("_needle").alias("_n"), start.alias("pos_start")).select(
        key, "rule_id", "match_text", "pos_start", (F.col("pos_start") + F.col("_n") - 1).alias("pos_end")
    )


# --------------------------------------------------------------------------- rule dry run on one message


def match_http_parts(parts: Column, payload_text: Column, contents: Column) -> Column:
    """Ordered contents where each may be limited to parts of an HTTP message.

    ``contents`` is ``array<struct<text,nocase,offset,depth,within,distance,parts array<string>>>``
    with part names method, uri, headers, cookie, body (empty: the whole payload).
    The window differs from the packet chain: it starts at
    ``max(end of the match before + distance, offset)``, ``within`` bounds it from
    there and ``depth`` allows that many bytes before the literal.
    """

    def step(acc, c):
        length = F.length(c["text"])
        start = F.greatest(
            acc["at"] + F.coalesce(c["distance"], F.lit(0)), F.coalesce(c["offset"], F.lit(0)), F.lit(0)
        )
        needle = F.when(c["nocase"], ascii_lower(c["text"])).otherwise(c["text"])

        def look(part):
            size = F.length(part)
            end = F.when(c["within"].isNotNull(), start + c["within"]).otherwise(size)
            end = F.when(c["depth"].isNotNull(), F.least(end, start + c["depth"] + length)).otherwise(end)
            piece = part.substr(start + 1, F.greatest(end - start, F.lit(0)))
            hit = F.call_function("locate", needle, F.when(c["nocase"], ascii_lower(piece)).otherwise(piece))
            return F.when((start < size) & (start < end) & (hit > 0), start + hit - 1 + length)

        named = F.filter(
            F.array(
                *[
                    F.when(F.array_contains(c["parts"], n), parts[n])
                    for n in ("method", "uri", "headers", "cookie", "body")
                ]
            ),
            lambda p: p.isNotNull(),
        )
        searched = F.when(F.size(c["parts"]) == 0, F.array(payload_text)).otherwise(named)
        ends = F.filter(F.transform(searched, look), lambda e: e.isNotNull())
        return F.struct(
            F.coalesce(F.get(ends, F.lit(0)), acc["at"]).alias("at"), (acc["ok"] & (F.size(ends) > 0)).alias("ok")
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"))
    needs_http = F.exists(contents, lambda c: F.size(c["parts"]) > 0)
    ok = F.aggregate(contents, begin, step, lambda acc: acc["ok"])
    return F.coalesce((~needs_http | parts.isNotNull()) & ok, F.lit(False))


def match_any_part(parts: Column, payload_text: Column, patterns: Column, names: Column) -> Column:
    """Legacy dry run: any literal in any of the named parts (none named: the whole payload)."""
    fields = ("method", "uri", "headers", "cookie", "body", "status_code")
    chosen = F.filter(
        F.array(*[F.when(F.array_contains(names, n), parts[n]) for n in fields]), lambda p: p.isNotNull()
    )
    searched = F.when(F.size(names) == 0, F.array(payload_text)).otherwise(chosen)
    return F.coalesce(
        F.exists(patterns, lambda p: F.exists(searched, lambda s: F.contains(s, p))), F.lit(False)
    )


def match_any_regex(text: Column, regexes: Column) -> Column:
    return F.exists(regexes, lambda r: F.rlike(text, r))
