"""Behaviour detectors over packets and authentication events.

Every detector returns one row per alert with ``ts, packet_no, src_ip`` and its
own measures; ``as_alerts`` turns any of them into the common alert form.
Thresholds are parameters; the defaults are the documented ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.functions.alerts import behavior_topic, rule_topic
from packetloom.functions.http import LOGIN_PORTS, LOGIN_WORDS
from packetloom.operators import byte_stream
from packetloom.operators.materialize import materialize
from packetloom.operators.windows import (
    MICROS,
    cell_of,
    ewma,
    from_micros,
    micros,
    running,
    silence,
    trailing,
)


def high_connection_rate(
    packets: DataFrame,
    window: float = 60,
    max_connections: int = 200,
    burst: float = 1.2,
    min_targets: int = 2,
    min_ports: int = 40,
    cooldown: float | None = 120,
) -> DataFrame:
    """Many connections between two hosts, with several targets or ports touched."""
    # read for the pairs and for the sources
    conns = materialize(packets.select("ts", "src_ip", "dst_ip", "dst_port", F.lower("proto").alias("proto"), "packet_no"))
    # the alert's port is that of its packet, and the smallest one if the packet comes more than once
    first = F.struct("packet_no", F.col("dst_port").isNull().alias("_none"), "dst_port").alias("first")
    pair = trailing(
        conns.select("*", first), ["src_ip", "dst_ip", "proto"], "ts", window, {"connections": 1}, {"unique_ports": "dst_port"}, "first"
    )
    busy = materialize(
        pair.filter((F.col("connections") > max_connections) & (F.col("connections") >= int(max_connections * burst)))
    )
    # targets are wanted at the times of busy pairs only: these are marked among the rows
    marked = F.lit(1).alias("_asked")
    asked = busy.select("src_ip", "proto", from_micros("us").alias("ts"), marked).distinct()
    sources = conns.select("src_ip", "proto", "ts", "dst_ip").unionByName(asked, allowMissingColumns=True)
    spread = trailing(sources, ["src_ip", "proto"], "ts", window, distinct={"unique_targets": "dst_ip"}, order="_asked")
    known = F.col("first.packet_no").isNotNull() & F.col("dst_ip").isNotNull()
    fired = (
        busy.join(spread.filter("_asked is not null"), ["src_ip", "proto", "us"])
        .filter((F.col("unique_targets") >= min_targets) | (F.col("unique_ports") >= min_ports))
        .select(
            from_micros("us").alias("ts"),
            F.col("first.packet_no").alias("packet_no"),
            "src_ip",
            "dst_ip",
            "proto",
            "connections",
            "unique_targets",
            "unique_ports",
            F.when(known, F.col("first.dst_port")).alias("target_port"),
        )
    )
    if cooldown:
        fired = silence(fired, ["src_ip"], "ts", cooldown, False, ["packet_no", "dst_ip"], derived=True)
    columns = ["packet_no", "ts", "src_ip", "dst_ip", "proto", "connections", "unique_targets", "unique_ports", "target_port"]
    return fired.select(*columns)


def accepted_probes(packets: DataFrame, seconds: float = 1) -> DataFrame:
    """TCP probes without repeats of the same target and port within ``seconds``."""
    tcp = packets.select(
        "packet_no", "ts", "src_ip", "dst_ip", "dst_port", F.lower("proto").alias("proto")
    ).filter((F.col("proto") == "tcp") & F.col("dst_port").isNotNull())
    return silence(tcp, ["src_ip", "dst_ip", "dst_port"], "ts", seconds, False, ["packet_no"])


def port_scan(
    packets: DataFrame,
    window: float = 300,
    threshold: int = 40,
    min_ports: int = 40,
    min_targets: int = 5,
    dedupe: float | None = 1,
    cooldown: float | None = 180,
    probes: DataFrame | None = None,
) -> DataFrame:
    """Many ports or targets probed by one source; checked at every TCP packet.

    ``probes`` are the packets' ``accepted_probes`` with ``dedupe``, where they are at hand already.
    """
    tcp = packets.filter((F.lower("proto") == "tcp") & F.col("dst_port").isNotNull()).select(
        "packet_no", "ts", "src_ip", "dst_ip", "dst_port"
    )
    one = F.lit(1).cast("bigint")
    if dedupe:
        probes = (accepted_probes(packets, dedupe) if probes is None else probes).select(*tcp.columns, one.alias("n"))
        nothing = {"dst_ip": F.lit(None).cast("string"), "dst_port": F.lit(None).cast("int")}
        rows = probes.unionByName(tcp.withColumns(nothing).withColumn("n", F.lit(0).cast("bigint")))
    else:
        rows = tcp.withColumn("n", one)
    counts = trailing(
        rows,
        ["src_ip"],
        "ts",
        window,
        {"events": F.col("n")},
        {"unique_ports": "dst_port", "unique_targets": "dst_ip"},
        "packet_no",
    )
    enough = F.col("events") >= threshold
    fired = counts.filter(
        enough
        & ((F.col("unique_ports") >= max(threshold, min_ports)) | (F.col("unique_targets") >= min_targets))
    ).select(from_micros("us").alias("ts"), "packet_no", "src_ip", "events", "unique_ports", "unique_targets")
    return silence(fired, ["src_ip"], "ts", cooldown, False, ["packet_no"], derived=True) if cooldown else fired


def scan_top(alerts: DataFrame, probes: DataFrame, item: str, window: float = 300, k: int = 50) -> DataFrame:
    """The ``k`` most probed ports or targets in the window of every scan alert, ranked.

    Alerts of one source are further apart than their cooldown, so a probe meets
    a bounded number of them; the window is looked up by cells, not by range.
    """
    width = int(window * MICROS)
    asked = alerts.select("src_ip", micros("ts").alias("alert_us")).withColumn("_c", cell_of(F.col("alert_us"), width))
    asked = asked.select("src_ip", "alert_us", F.explode(F.array(F.col("_c"), F.col("_c") - width)).alias("_cell"))
    counted = (
        probes.withColumn("us", micros("ts"))
        .withColumn("_cell", cell_of(F.col("us"), width))
        .join(asked, ["src_ip", "_cell"])
        .filter((F.col("us") <= F.col("alert_us")) & (F.col("us") >= F.col("alert_us") - width))
        .groupBy("src_ip", "alert_us", item)
        .agg(F.count("*").alias("n"))
    )
    rank = Window.partitionBy("src_ip", "alert_us").orderBy(F.desc("n"), item)
    return (
        counted.withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= k)
        .select("src_ip", from_micros("alert_us").alias("ts"), item, "n", "rank")
    )


def brute_force(auth: DataFrame, window: float = 300, max_failures: int = 5) -> DataFrame:
    """Failed logins at or over the threshold; every further failure fires again."""
    failed = auth.filter(~F.col("success"))
    keys = ["src_ip", "dst_ip", "auth_type"]
    counts = trailing(failed, keys, "ts", window, {"failures": 1}, order="packet_no")
    over = counts.filter(F.col("failures") >= max_failures).select(*keys, "us", "failures")
    # a count belongs to all failures of its instant
    return failed.withColumn("us", micros("ts")).join(over, [*keys, "us"]).select("ts", "packet_no", *keys, "failures")


def failures_of(alerts: DataFrame, auth: DataFrame, window: float = 300) -> DataFrame:
    """The failures behind brute-force alerts, one row each (instead of a list per alert).

    Meant for emitted alerts, which are further apart than the window.
    """
    width = int(window * MICROS)
    keys = ["src_ip", "dst_ip", "auth_type"]
    asked = alerts.select(*keys, micros("ts").alias("alert_us")).withColumn("_c", cell_of(F.col("alert_us"), width))
    asked = asked.select(*keys, "alert_us", F.explode(F.array(F.col("_c"), F.col("_c") - width)).alias("_cell"))
    return (
        auth.filter(~F.col("success"))
        .select(*keys, micros("ts").alias("us"))
        .withColumn("_cell", cell_of(F.col("us"), width))
        .join(asked, [*keys, "_cell"])
        .filter((F.col("us") <= F.col("alert_us")) & (F.col("us") >= F.col("alert_us") - width))
        .select(*keys, from_micros("alert_us").alias("ts"), from_micros("us").alias("failed_at"))
    )


def oversized(packets: DataFrame, size: Column, limit: int = 65535) -> DataFrame:
    return packets.withColumn("packet_size", size).filter(F.col("packet_size") > limit).select(
        "ts", "packet_no", "src_ip", "packet_size"
    )


def traffic_samples(packets: DataFrame, size: Column, interval: float = 1) -> DataFrame:
    """Packets and bytes per second of every source in aligned intervals."""
    width = int(interval * MICROS)
    return (
        packets.select("src_ip", cell_of(micros("ts"), width).alias("us"), "packet_no", F.greatest(size, F.lit(0)).alias("b"))
        .groupBy("src_ip", "us")
        .agg(F.count("*").alias("n"), F.sum("b").alias("b"), F.max("packet_no").alias("packet_no"))
        .select(
            "src_ip",
            "us",
            "packet_no",
            (F.col("n") / interval).alias("pps"),
            (F.col("b") / interval).cast("double").alias("bps"),
        )
    )


def traffic_spike(
    packets: DataFrame,
    size: Column,
    interval: float = 1,
    alpha: float = 0.2,
    factor: float = 5,
    warmup: int = 30,
    sustain: int = 3,
    baseline: str = "prior",
    cooldown: float | None = 30,
) -> DataFrame:
    """Rates above ``factor`` times their moving average in ``sustain`` samples in a row.

    ``baseline='prior'`` compares with the average before the sample, ``'inclusive'``
    with the one that already contains it.
    """
    samples = traffic_samples(packets, size, interval)
    averaged = ewma(
        samples, ["src_ip"], "us", {"avg_pps": "pps", "avg_bps": "bps"}, alpha, 3600 * int(interval * MICROS), sustain
    )
    suffix = "_prior" if baseline == "prior" else ""
    base_pps, base_bps = (F.greatest(F.col(f"avg_{n}{suffix}"), F.lit(1e-6)) for n in ("pps", "bps"))
    known = F.col(f"avg_pps{suffix}").isNotNull()

    def above(times):
        over = (F.col("pps") > base_pps * times) | (F.col("bps") > base_bps * times)
        return F.coalesce(known & over, F.lit(False))

    spike = (F.col("n") >= warmup) & above(factor)
    recent = Window.partitionBy("src_ip", "part").orderBy("n").rowsBetween(1 - sustain, 0)
    fired = (
        averaged.withColumn("_spike", spike.cast("int"))
        .withColumn("_run", F.sum("_spike").over(recent))
        .filter(F.col("own") & (F.col("_run") == sustain))
        .select(
            from_micros("us").alias("ts"),
            "packet_no",
            "src_ip",
            "pps",
            "bps",
            base_pps.alias("baseline_pps"),
            base_bps.alias("baseline_bps"),
            F.when(above(factor * 2), "high").otherwise("medium").alias("severity"),
        )
    )
    return silence(fired, ["src_ip"], "ts", cooldown, False, ["packet_no"], derived=True) if cooldown else fired


def session_totals(packets: DataFrame, size: Column, idle: float = 3600) -> DataFrame:
    """Adds running ``packets, bytes, duration`` of the session each packet belongs to.

    A session of (source, target, protocol) ends after ``idle`` seconds of silence.
    """
    sized = packets.select("ts", "packet_no", "src_ip", "dst_ip", "proto", F.coalesce(size, F.lit(0)).cast("bigint").alias("size"))
    us = micros("ts")
    gap = int(idle * MICROS)
    out = running(
        sized,
        ["src_ip", "dst_ip", "proto"],
        us,
        ["ts", "packet_no"],
        {"packets": ("sum", F.lit(1).cast("bigint")), "bytes": ("sum", F.col("size")), "_start": ("min", us)},
        cell=min(gap, 60 * MICROS),
        reset_gap=gap,
    )
    return out.withColumn("duration", (us - F.col("_start")) / MICROS).withColumn(
        "session_start", from_micros("_start")
    ).drop("_start")


def suspicious_session(
    packets: DataFrame,
    size: Column,
    idle: float = 3600,
    min_duration: float = 2,
    min_packets: int = 50,
    min_bytes: int = 256 * 1024,
    max_pps: float = 1000,
    max_bps: float = 1024 * 1024,
    cooldown: float | None = 120,
) -> DataFrame:
    """Sessions long and large enough whose packet or byte rate is too high."""
    totals = session_totals(packets, size, idle)
    pps, bps = F.col("packets") / F.col("duration"), F.col("bytes") / F.col("duration")
    fired = totals.filter(
        (F.col("duration") >= min_duration)
        & ((F.col("packets") >= min_packets) | (F.col("bytes") >= min_bytes))
        & ((pps > max_pps) | (bps > max_bps))
    ).select(
        "ts", "packet_no", "src_ip", "dst_ip", "proto", "duration", "packets", "bytes", pps.alias("pps"), bps.alias("bps")
    )
    return silence(fired, ["src_ip", "dst_ip", "proto"], "ts", cooldown, False, ["packet_no"], derived=True) if cooldown else fired


# --------------------------------------------------------------------------- common form and suppression


def as_alerts(detected: DataFrame, alert_type: str) -> DataFrame:
    """``ts, packet_no, alert_type, severity, src_ip, dst_ip, description, details`` of any detector's rows."""
    severity = {"high_connection_rate": "high", "brute_force": "high", "suspicious_session": "high"}.get(
        alert_type, "medium"
    )
    text = {
        "high_connection_rate": "High connection rate: {connections} connections",
        "port_scan": "Port scanning detected: {unique_ports} ports",
        "brute_force": "Brute force: {failures} failed attempts",
        "traffic_spike": "Traffic spike detected: {pps} pkt/s (baseline {baseline_pps})",
        "suspicious_session": "Suspicious session activity: {pps} pkt/s",
        "oversized_packet": "Oversized packet detected: {packet_size} bytes",
    }[alert_type]
    before, _, rest = text.partition("{")
    parts = [F.lit(before)]
    while rest:
        name, _, rest = rest.partition("}")
        literal, _, rest = rest.partition("{")
        value = F.col(name)
        parts += [F.format_number(value, 1) if name.endswith("ps") else value.cast("string"), F.lit(literal)]
    common = ("ts", "packet_no", "src_ip", "severity")
    details = [
        item
        for c in detected.columns
        if c not in common
        for item in (F.lit("target_ip" if c == "dst_ip" else c), F.col(c).cast("string"))
    ]
    return detected.select(
        "ts",
        "packet_no",
        F.lit(alert_type).alias("alert_type"),
        (F.col("severity") if "severity" in detected.columns else F.lit(severity)).alias("severity"),
        "src_ip",
        (F.col("dst_ip") if "dst_ip" in detected.columns else F.lit(None).cast("string")).alias("dst_ip"),
        F.concat(*parts).alias("description"),
        F.create_map(*details).alias("details"),
    )


def topic_suppressed(alerts: DataFrame, rule_alerts: DataFrame, window: float = 300) -> DataFrame:
    """Adds ``suppressed``: a rule alert of the same topic between the same hosts came within ``window`` before.

    Rule alerts (``ts, src_ip, dst_ip, rule_id``) are reduced to first and last
    time per cell, which is all the question needs.
    """
    width = int(window * MICROS)
    # the same floor on both sides; an alert looks into its own cell and the one before
    known = (
        rule_alerts.select("src_ip", "dst_ip", rule_topic(F.col("rule_id")).alias("_topic"), micros("ts").alias("_r"))
        .filter(F.col("_topic").isNotNull())
        .withColumn("_cell", cell_of(F.col("_r"), width))
        .groupBy("src_ip", "dst_ip", "_topic", "_cell")
        .agg(F.min("_r").alias("_first"), F.max("_r").alias("_last"))
    )
    spans = known.select(
        "src_ip",
        "dst_ip",
        "_topic",
        F.inline(
            F.array(
                F.struct(F.col("_cell").alias("_cell"), F.col("_first").alias("_first"), F.lit(None).cast("bigint").alias("_last")),
                F.struct((F.col("_cell") + width).alias("_cell"), F.lit(None).cast("bigint").alias("_first"), F.col("_last").alias("_last")),
            )
        ),
    ).groupBy("src_ip", "dst_ip", "_topic", "_cell").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    asked = alerts.withColumn("_topic", behavior_topic(F.col("alert_type"))).withColumn(
        "_cell", cell_of(micros("ts"), width)
    )
    us = micros("ts")
    hit = (F.col("_first") <= us) | (F.col("_last") >= us - width)
    return (
        asked.join(spans, ["src_ip", "dst_ip", "_topic", "_cell"], "left")
        .withColumn("suppressed", F.coalesce(hit, F.lit(False)))
        .select(*alerts.columns, "suppressed")
    )


def first_of_topic(alerts: DataFrame, window: float = 300, derived: bool = False) -> DataFrame:
    """Alerts left when each (type, source) is silent for ``window`` after one."""
    return silence(alerts, ["alert_type", "src_ip"], "ts", window, True, ["packet_no"], derived)


def compose(detected: DataFrame, rule_alerts: DataFrame, window: float = 300) -> DataFrame:
    """All behaviour alerts with ``emitted``: not suppressed by a rule alert and not a repeat.

    Correlation takes every row, the sink only the emitted ones.
    """
    keyed = materialize(
        topic_suppressed(detected, rule_alerts, window).withColumn(
            "_id", F.xxhash64("ts", "packet_no", "alert_type", "src_ip", "dst_ip", "description")
        )
    )
    emitted = first_of_topic(keyed.filter(~F.col("suppressed")), window)
    ids = emitted.select("ts", "packet_no", "alert_type", "src_ip", "_id").distinct().withColumn("emitted", F.lit(True))
    return (
        keyed.join(ids, ["ts", "packet_no", "alert_type", "src_ip", "_id"], "left")
        .withColumn("emitted", F.coalesce("emitted", F.lit(False)))
        .drop("_id")
    )


# --------------------------------------------------------------------------- authentication events


def ftp_auth(segments: DataFrame) -> DataFrame:
    """Login results in server lines of FTP connections (``flow, ts, packet_no, src_ip, dst_ip, src_port, seq, data``).

    Lines are those of the reassembled streams, wherever packets cut them; a line belongs to the packet whose arrival
    released its end, CRLF included.
    """
    server = materialize(segments.filter(F.col("src_port") == 21))
    named = server.select("flow", F.col("packet_no").alias("arrival"), "seq", "data")
    pieces = materialize(byte_stream.releases(named.select("flow", "arrival", "seq", F.length("data").alias("size"))))
    stream = byte_stream.blocks(byte_stream.piece_data(named, pieces))
    lines = byte_stream.stream_lines(stream).filter(F.col("end") >= F.col("begin") + 3)
    heads = lines.select("flow", "begin", (F.col("begin") + 3).alias("end"), (F.col("end") + 1).alias("_last"))
    codes = byte_stream.cut(stream, heads).filter(F.col("text").isin("230", "530"))
    found = byte_stream.arrival_at(pieces, codes.select("flow", "begin", "text", "_last"), "_last")
    packets = server.select("flow", F.col("packet_no").alias("arrival"), "ts", "src_ip", "dst_ip")
    return found.join(packets, ["flow", "arrival"]).select(
        F.col("arrival").alias("packet_no"),
        "ts",
        F.col("dst_ip").alias("src_ip"),
        F.col("src_ip").alias("dst_ip"),
        (F.col("text") == "230").alias("success"),
        F.lit("ftp").alias("auth_type"),
    )


def login_attempts(requests: DataFrame) -> DataFrame:
    """Requests that try to log in (``ts, packet_no, src_ip, src_port, dst_ip, dst_port, method, path``)."""
    return requests.filter(
        F.upper("method").isin("POST", "PUT")
        & F.lower("path").rlike("|".join(LOGIN_WORDS))
        & F.col("dst_port").isin(LOGIN_PORTS)
    )


def login_results(attempts: DataFrame, responses: DataFrame, seconds: float = 10, auth_type: str = "http") -> DataFrame:
    """Responses matched to the latest login attempt on the same connection within ``seconds``.

    Attempts are ``ts, packet_no`` plus client and server address and port
    (``client_ip, client_port, server_ip, server_port``); responses the same and
    ``status_code``.  An as-of join by cells of time: an attempt is visible in
    its own cell and the next.
    """
    width = int(seconds * MICROS)
    keys = ["client_ip", "client_port", "server_ip", "server_port"]
    none = F.lit(None)
    a = attempts.select(
        *keys, micros("ts").alias("us"), "packet_no", none.cast("int").alias("status_code"), micros("ts").alias("_try"),
    ).withColumn("_c", cell_of(F.col("us"), width))
    a = a.select(*keys, "us", "packet_no", "status_code", "_try", F.explode(F.array(F.col("_c"), F.col("_c") + width)).alias("_cell"))
    r = responses.select(
        *keys, micros("ts").alias("us"), "packet_no", "status_code", none.cast("bigint").alias("_try")
    ).withColumn("_cell", cell_of(F.col("us"), width))
    latest = Window.partitionBy(*keys, "_cell").orderBy("us", "packet_no").rowsBetween(Window.unboundedPreceding, 0)
    code = F.col("status_code")
    return (
        a.unionByName(r)
        .withColumn("_last", F.max("_try").over(latest))
        .filter(code.isNotNull() & (F.col("_last") >= F.col("us") - width))
        .filter(code.between(200, 399) | code.isin(401, 403))
        .select(
            "packet_no",
            from_micros("us").alias("ts"),
            F.col("client_ip").alias("src_ip"),
            F.col("server_ip").alias("dst_ip"),
            (code < 400).alias("success"),
            F.lit(auth_type).alias("auth_type"),
            from_micros("_last").alias("attempt_ts"),
        )
    )


def dispatch(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Semantic events by ``type``: (authentication events, connection events); others are dropped."""
    auth = events.filter(F.col("type") == "auth").select(
        "packet_no", "ts", "src_ip", "dst_ip", "success", "auth_type"
    )
    conn = events.filter(F.col("type") == "connection").select(
        "packet_no", "ts", "src_ip", "dst_ip", "dst_port", "proto"
    )
    return auth, conn
