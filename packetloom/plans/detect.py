"""Packets and rules to alerts and attackers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions import packet
from packetloom.functions.alerts import behavior_alert_rows, correlation_alert_rows, rule_alerts
from packetloom.functions.http import MATCHED_METHODS, request_carrier, response_carrier
from packetloom.operators import behavior, byte_stream, correlate, flows
from packetloom.operators.alert_stream import dedupe_alerts, dedupe_modes
from packetloom.operators.matching import PreparedRules, flow_filter, match_packets, prepare_rules
from packetloom.operators.materialize import materialize


@dataclass
class Settings:
    """Parameters of the detectors, by detector."""

    rate: dict = field(default_factory=dict)
    scan: dict = field(default_factory=dict)
    spike: dict = field(default_factory=dict)
    session: dict = field(default_factory=dict)
    auth: dict = field(default_factory=dict)
    scoring: dict = field(default_factory=dict)
    attacker_alerts: dict = field(default_factory=dict)
    behavior_window: float = 300
    dedupe: float = 10


@dataclass
class Detection:
    alerts: DataFrame
    rule_alerts: DataFrame
    behavior_alerts: DataFrame
    marks: DataFrame


def routed(packets: DataFrame) -> DataFrame:
    """Packets with their application protocol, named buffers, directed flow and detection path."""
    return _with_buffers(_headers(packets))


def _headers(packets: DataFrame) -> DataFrame:
    """``routed`` packets without the named buffers, which only rule matching looks at."""
    p = {c: F.col(c) for c in ("proto", "src_ip", "dst_ip", "src_port", "dst_port", "payload")}
    return packet.header_projection(packets.drop("buffers")).withColumns(
        {
            "route": packet.packet_route(p["proto"], p["payload"]),
            "app_proto": packet.app_protocol(p["proto"], p["src_port"], p["dst_port"], p["payload"]),
            "flow": packet.directed_flow_id(p["proto"], p["src_ip"], p["src_port"], p["dst_ip"], p["dst_port"]),
        }
    )


def _with_buffers(packets: DataFrame) -> DataFrame:
    """Packets with the named buffers of their own payload, where they have none yet."""
    if "buffers" in packets.columns:
        return packets
    return packets.withColumn("buffers", packet.sticky_buffers(F.col("app_proto"), F.col("proto"), F.col("payload")))


def _flow_states(packets: DataFrame) -> DataFrame:
    """``packet_no, flow_established, flow_dir`` of the TCP packets, from headers alone; read for packet and stream matches."""
    headers = packets.filter("proto = 'TCP'").select(
        "packet_no", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags"
    )
    return materialize(flows.flow_state(headers).select("packet_no", "flow_established", "flow_dir"))


def _with_flow_state(matches: DataFrame, state: DataFrame, stream: bool) -> DataFrame:
    """Matches whose flow keywords fit the state of their TCP flow.

    The state (as from ``_flow_states``) is joined to the matches, so no payload
    is shuffled for it.
    """
    bare = matches.drop("flow_established", "flow_dir", "stream")
    joined = bare.join(state, "packet_no", "left").withColumn("stream", F.lit(stream))
    return joined.filter(flow_filter(F.col("flow_tokens"))).drop("flow_tokens")


def raw_matches(packets: DataFrame, rules: PreparedRules) -> DataFrame:
    """Matches on single payloads, flow keywords still open (``flow_tokens``)."""
    wanted = packets.filter(F.col("route").isin("raw", "ip") & (F.length("payload") > 0))
    preview = F.trim(packet.utf8_lossy(F.col("payload").substr(1, 100)))
    matched = match_packets(_with_buffers(wanted), rules, defer_flow=True)
    return matched.withColumn("preview", preview).drop("payload", "buffers")


def connection_numbers(packets: DataFrame) -> DataFrame:
    """``packet_no, connection`` of the TCP packets, from headers alone: one flow may hold several connections."""
    headers = packets.filter("proto = 'TCP'").select("packet_no", "flow", "ts", "tcp_flags")
    return materialize(flows.connections(headers))


def _by_connection(segments: DataFrame, numbers: DataFrame, packet_no: str) -> DataFrame:
    """Segments whose flow is the single connection."""
    own = numbers.withColumnRenamed("packet_no", packet_no)
    return segments.join(own, packet_no, "left").withColumn("flow", F.concat_ws("#", "flow", "connection")).drop("connection")


def stream_matches(packets: DataFrame, raw: DataFrame, rules: PreparedRules, numbers: DataFrame) -> DataFrame:
    """Matches on what each packet of a TCP flow releases to its stream, flow keywords still open.

    Where that is the packet's own payload, its matches are the raw ones; only chunks cut by an overlap, and those of
    packets that close a hole, which hold what waited behind it, are matched again.
    """
    tcp = packets.filter((F.col("route") == "raw") & (F.col("proto") == "TCP") & F.col("seq").isNotNull())
    segments = tcp.select("flow", F.col("packet_no").alias("arrival"), "seq", F.col("payload").alias("data"))
    segments = _by_connection(segments, numbers, "arrival")
    sizes = segments.select("flow", "arrival", "seq", F.length("data").cast("bigint").alias("size"))
    pieces = materialize(byte_stream.releases(sizes))
    own = pieces.groupBy("flow", "released").agg(
        F.bool_and(F.col("arrival") == F.col("released")).alias("_own"), F.sum(F.col("stop") - F.col("start")).alias("_bytes")
    )
    whole = own.join(sizes.select("flow", F.col("arrival").alias("released"), "size"), ["flow", "released"])
    whole = materialize(whole.select("flow", "released", (F.col("_own") & (F.col("_bytes") == F.col("size"))).alias("same")))
    same = raw.filter(F.col("proto") == "TCP").join(
        whole.filter("same").select(F.col("released").alias("packet_no")), "packet_no", "left_semi"
    )
    others = pieces.join(whole.filter("not same").select("flow", "released"), ["flow", "released"], "left_semi")
    chunks = byte_stream.chunks_of(segments, others).select(F.col("arrival").alias("packet_no"), F.col("data").alias("_chunk"))
    cut = _with_buffers(tcp.join(chunks, "packet_no")).withColumn("payload", F.col("_chunk")).drop("_chunk")
    preview = F.trim(packet.utf8_lossy(F.col("payload").substr(1, 100)))
    again = match_packets(cut, rules, defer_flow=True)
    return same.unionByName(again.withColumn("preview", preview).drop("payload", "buffers"))


def http_messages(packets: DataFrame, numbers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests and responses of every TCP connection that carries HTTP, each with the packet that completed it.

    Columns ``flow, ts, packet_no, src_ip, src_port, dst_ip, dst_port, proto, msg_no, m``; ``msg_no`` is the position in
    the stream.
    """
    tcp = packets.filter((F.col("proto") == "TCP") & (F.col("route") != "skip_tls") & (F.length("payload") > 0) & F.col("seq").isNotNull())
    web = tcp.filter("route = 'http'").select("flow").distinct()
    segments = materialize(
        _by_connection(tcp.join(web, "flow", "left_semi"), numbers, "packet_no").select(
            "flow", "packet_no", "ts", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "seq", "payload"
        )
    )
    named = segments.select("flow", F.col("packet_no").alias("arrival"), "seq", F.col("payload").alias("data"))
    pieces = materialize(byte_stream.releases(named.select("flow", "arrival", "seq", F.length("data").alias("size"))))
    stream = byte_stream.blocks(byte_stream.piece_data(named, pieces))
    heads = segments.drop("seq", "payload")
    nodes = byte_stream.message_nodes(stream)  # the same for requests and responses

    def timed(responses: bool) -> DataFrame:
        found = byte_stream.http_messages(stream, responses, nodes).withColumn("_last", F.col("end") - 1)
        found = byte_stream.arrival_at(pieces, found, "_last").withColumnRenamed("arrival", "packet_no")
        return materialize(found.join(heads, ["flow", "packet_no"]).select(*heads.columns, F.col("begin").alias("msg_no"), "m"))

    return timed(False), timed(True)


def login_events(packets: DataFrame, numbers: DataFrame, requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Authentication events that the packets themselves show: FTP replies, and answers to HTTP logins."""
    ftp = packets.filter((F.col("proto") == "TCP") & (F.col("src_port") == 21) & (F.length("payload") > 0) & F.col("seq").isNotNull())
    ftp = _by_connection(ftp, numbers, "packet_no").withColumnRenamed("payload", "data")
    tries = behavior.login_attempts(requests.select("*", "m.method", "m.path"))
    ends = ("client_ip", "client_port", "server_ip", "server_port")
    asked = tries.select("ts", "packet_no", *[F.col(c).alias(n) for n, c in zip(ends, ("src_ip", "src_port", "dst_ip", "dst_port"), strict=True)])
    answered = responses.select(
        "ts", "packet_no", "m.status_code", *[F.col(c).alias(n) for n, c in zip(ends, ("dst_ip", "dst_port", "src_ip", "src_port"), strict=True)]
    )
    columns = ["packet_no", "ts", "src_ip", "dst_ip", "success", "auth_type"]
    return behavior.ftp_auth(ftp).select(*columns).unionByName(behavior.login_results(asked, answered).select(*columns))


def http_alerts(requests: DataFrame, responses: DataFrame, rules: PreparedRules) -> DataFrame:
    """Alert rows of rules that match HTTP requests and responses."""
    common = ["flow", "ts", "packet_no", "src_ip", "src_port", "dst_ip", "dst_port", "proto"]
    requests = requests.select(*common, "msg_no", "m", F.col("m.raw").alias("raw"), F.col("m.method").alias("method"), F.col("m.path").alias("path"))
    requests = flows.dedupe_requests(requests, 2, derived=True).filter(F.upper("method").isin(MATCHED_METHODS))
    asked = requests.select(
        *common, "msg_no", "method", "path", request_carrier(F.col("m")).alias("payload"), F.lit(True).alias("stream"),
        F.lit("http").alias("app_proto"),
    ).withColumn("buffers", F.create_map(F.lit("raw"), F.col("payload")))
    answered = responses.select(
        *common, "msg_no", F.col("m.status_code").alias("status_code"), response_carrier(F.col("m")).alias("payload"),
        F.lit(True).alias("stream"), F.lit("http").alias("app_proto"),
    ).withColumn("buffers", F.create_map(F.lit("raw"), F.col("payload")))
    found = rule_alerts(match_packets(asked, rules).withColumn("preview", F.col("path")), "request")
    line = packet.utf8_lossy(F.col("payload"))
    back = rule_alerts(match_packets(answered, rules).withColumn("preview", line), "response")
    return found.unionByName(back)


def detect_rules(
    packets: DataFrame, rules: PreparedRules, numbers: DataFrame | None = None, messages: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Alert rows of all rule matches after cross-mode dedupe (``packets`` as from ``routed``)."""
    raw = materialize(raw_matches(packets, rules))
    numbers = connection_numbers(packets) if numbers is None else numbers
    requests, responses = http_messages(packets, numbers) if messages is None else messages
    state = _flow_states(packets)
    single = _with_flow_state(raw, state, stream=False)
    streamed = _with_flow_state(stream_matches(packets, raw, rules, numbers), state, stream=True)
    ports = single.filter("route = 'raw'")
    hits = rule_alerts(streamed, "stream").withColumn("mode", F.lit(0)).unionByName(
        rule_alerts(ports, "packet").withColumn("mode", F.lit(1))
    )
    kept = dedupe_modes(hits, 2, ["packet_no", "mode"], derived=True).drop("mode")
    other = rule_alerts(single.filter("route = 'ip'"), "ip")
    return kept.unionByName(other).unionByName(http_alerts(requests, responses, rules))


def detect_behavior(packets: DataFrame, settings: Settings, auth: DataFrame | None = None) -> DataFrame:
    """Behaviour alerts of all detectors, from packet headers and sizes only."""
    slim = packets.select("packet_no", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "size")
    size = F.col("size")
    found = [
        behavior.as_alerts(behavior.high_connection_rate(slim, **settings.rate), "high_connection_rate"),
        behavior.as_alerts(behavior.port_scan(slim, **settings.scan), "port_scan"),
        behavior.as_alerts(behavior.traffic_spike(slim, size, **settings.spike), "traffic_spike"),
        behavior.as_alerts(behavior.suspicious_session(slim, size, **settings.session), "suspicious_session"),
        behavior.as_alerts(behavior.oversized(slim, size), "oversized_packet"),
    ]
    if auth is not None:
        found.append(behavior.as_alerts(behavior.brute_force(auth, **settings.auth), "brute_force"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def detect(
    packets: DataFrame, rules: DataFrame, settings: Settings | None = None, auth: DataFrame | None = None
) -> Detection:
    """The whole run: rule matches, behaviour alerts, attackers, and the alert list that is stored.

    Correlation sees rule alerts before the final dedupe and behaviour alerts
    before suppression; the alert list sees what is left after both. Logins that
    the packets show (FTP, HTTP) count beside those of ``auth``.
    """
    settings = settings or Settings()
    if "size" not in packets.columns:
        packets = packets.withColumn("size", F.coalesce(F.length("payload"), F.lit(0)))
    # every step reads the packets: they are read, routed and written once, and a step reads the columns it needs
    ready = materialize(_headers(packets))
    numbers = connection_numbers(ready)
    messages = http_messages(ready, numbers)
    matched = materialize(detect_rules(ready, prepare_rules(rules), numbers, messages))
    logins = login_events(ready, numbers, *messages)
    auth = logins if auth is None else logins.unionByName(auth.select(*logins.columns))
    known = matched.select("ts", "src_ip", "dst_ip", F.col("match_rule").alias("rule_id"))
    behaved = behavior.compose(detect_behavior(ready, settings, auth), known, settings.behavior_window)
    behaved = materialize(behaved)
    history = known.select("ts", "src_ip", "rule_id", F.lit(False).alias("is_behavior")).unionByName(
        behaved.select("ts", "src_ip", F.concat(F.lit("behavior:"), "alert_type").alias("rule_id"), F.lit(True).alias("is_behavior"))
    )
    marks = materialize(correlate.score_attackers(history, **settings.scoring))
    attackers = correlation_alert_rows(correlate.attacker_alerts(marks, **settings.attacker_alerts))
    everything = matched.unionByName(behavior_alert_rows(behaved.filter("emitted"))).unionByName(attackers)
    return Detection(
        dedupe_alerts(everything, settings.dedupe, ["packet_no", "source"], derived=True), matched, behaved, marks
    )
