"""Streaming forms of the stateful operators.

Each keeps a small state per key and gives, over input that arrives in time
order, the rows of its batch form.  Rows of a micro-batch are put in order of
(ts, packet_no) first; rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetloom.functions.packet import endpoint, flow_key
from packetloom.operators.windows import MICROS, micros

WATERMARK = "10 minutes"


def _grouped(stream: DataFrame, keys: Sequence[str], watermark: str, names: list[str]):
    # the watermark is bound to ts, so ts has to reach the stateful operator
    marked = stream.withWatermark("ts", watermark)
    rest = [n for n in names if n not in keys and n != "ts"]
    return marked.withColumn("us", micros("ts")).select(*keys, "ts", "us", *rest).groupBy(*keys)


def _ordered(frames, columns=("us", "packet_no")) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(list(columns), kind="stable")


def _keep_until(state: GroupState, us: int) -> None:
    """Let Spark drop the state once event time has passed ``us``."""
    state.setTimeoutTimestamp(max(us // 1000, state.getCurrentWatermarkMs() + 1))


def silence_stream(
    stream: DataFrame, keys: Sequence[str], seconds: float, inclusive: bool, watermark: str = WATERMARK
) -> DataFrame:
    """Emit-then-silence per key (alert dedupe, repeat suppression, cooldowns); all columns pass through."""
    width = int(round(seconds * MICROS))
    columns = stream.columns
    schema = stream.schema
    carried = [c for c in columns if c not in keys]

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = _ordered(frames)
        keep = []
        for us in rows["us"]:
            emit = last is None or us - last > width or (not inclusive and us - last == width)
            keep.append(emit)
            last = us if emit else last
        state.update((last,))
        _keep_until(state, last + width + 1)
        out = rows[keep]
        for i, k in enumerate(keys):
            out = out.assign(**{k: key[i]})
        yield out[columns]

    return _grouped(stream, keys, watermark, carried).applyInPandasWithState(
        step, schema, "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def trailing_stream(
    stream: DataFrame, keys: Sequence[str], seconds: float, weight: str, item: str, watermark: str = WATERMARK
) -> DataFrame:
    """``keys, us, packet_no, total, items``: sum of ``weight`` and distinct ``item`` in the trailing window at every time.

    One row per key and time (rows of equal time see each other); the state is
    what the window holds.
    """
    width = int(round(seconds * MICROS))
    types = dict(stream.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", us bigint, packet_no bigint, total bigint, items bigint"

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        times, weights, items = (list(c) for c in state.get) if state.exists else ([], [], [])
        rows = _ordered(frames)
        out = []
        for us, group in rows.groupby("us", sort=True):
            times += [us] * len(group)
            weights += [int(v) for v in group[weight]]
            items += [None if pd.isna(v) else str(v) for v in group[item]]
            first = next((i for i, t in enumerate(times) if t >= us - width), len(times))
            times, weights, items = times[first:], weights[first:], items[first:]
            out.append((*key, us, int(group["packet_no"].min()), sum(weights), len({i for i in items if i is not None})))
        state.update((times, weights, items))
        _keep_until(state, times[-1] + width + 1)
        yield pd.DataFrame(out, columns=[*keys, "us", "packet_no", "total", "items"])

    return _grouped(stream, keys, watermark, ["packet_no", weight, item]).applyInPandasWithState(
        step, schema, "times array<bigint>, weights array<bigint>, items array<string>", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def brute_force_stream(auth: DataFrame, window: float = 300, max_failures: int = 5, watermark: str = WATERMARK) -> DataFrame:
    """Streaming form of the brute-force detector."""
    failed = auth.filter(~F.col("success")).withColumn("_one", F.lit(1)).withColumn("_none", F.lit(None).cast("string"))
    counts = trailing_stream(failed, ["src_ip", "dst_ip", "auth_type"], window, "_one", "_none", watermark)
    return counts.filter(F.col("total") >= max_failures).select(
        F.timestamp_micros("us").alias("ts"), "packet_no", "src_ip", "dst_ip", "auth_type", F.col("total").alias("failures")
    )


def score_attackers_stream(
    alerts: DataFrame, window: float = 600, min_diversity: int = 4, min_alerts: int = 8, behavior_weight: int = 1,
    watermark: str = WATERMARK,
) -> DataFrame:
    """Streaming form of attacker scoring (``ts, packet_no, src_ip, rule_id, is_behavior``)."""
    weighed = alerts.withColumn("_w", F.when(F.col("is_behavior"), behavior_weight).otherwise(1)).withColumn(
        "_rule", F.when(~F.col("is_behavior"), F.col("rule_id"))
    )
    counts = trailing_stream(weighed, ["src_ip"], window, "_w", "_rule", watermark)
    return counts.filter((F.col("items") >= min_diversity) & (F.col("total") >= min_alerts)).select(
        F.timestamp_micros("us").alias("ts"),
        "src_ip",
        F.col("items").alias("diversity"),
        "total",
        F.when(F.col("total") >= 2 * min_alerts, "high").otherwise("medium").alias("severity"),
    )


def port_scan_stream(
    packets: DataFrame, window: float = 300, threshold: int = 40, min_ports: int = 40, min_targets: int = 5,
    dedupe: float = 1, watermark: str = WATERMARK,
) -> DataFrame:
    """Streaming form of the scan detector without cooldown (put ``silence_stream`` behind it in its own query)."""
    width, again = int(window * MICROS), int(dedupe * MICROS)
    tcp = packets.filter((F.lower("proto") == "tcp") & F.col("dst_port").isNotNull())

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        times, hosts, ports = (list(c) for c in state.get) if state.exists else ([], [], [])
        last = {(h, p): t for t, h, p in zip(times, hosts, ports, strict=True)}
        out = []
        for us, group in _ordered(frames).groupby("us", sort=True):
            for host, port in zip(group["dst_ip"], group["dst_port"], strict=True):
                seen = last.get((host, int(port)))
                if seen is None or us - seen >= again:
                    last[(host, int(port))] = us
                    times.append(us)
                    hosts.append(host)
                    ports.append(int(port))
            first = next((i for i, t in enumerate(times) if t >= us - width), len(times))
            times, hosts, ports = times[first:], hosts[first:], ports[first:]
            n, np_, nh = len(times), len(set(ports)), len(set(hosts))
            if n >= threshold and (np_ >= max(threshold, min_ports) or nh >= min_targets):
                out.append((key[0], us, int(group["packet_no"].min()), n, np_, nh))
        state.update((times, hosts, ports))
        _keep_until(state, times[-1] + max(width, again) + 1)
        yield pd.DataFrame(out, columns=["src_ip", "us", "packet_no", "events", "unique_ports", "unique_targets"])

    found = _grouped(tcp, ["src_ip"], watermark, ["packet_no", "dst_ip", "dst_port"]).applyInPandasWithState(
        step, "src_ip string, us bigint, packet_no bigint, events bigint, unique_ports bigint, unique_targets bigint",
        "times array<bigint>, hosts array<string>, ports array<int>", "append", GroupStateTimeout.EventTimeTimeout,
    )
    return found.select(F.timestamp_micros("us").alias("ts"), "packet_no", "src_ip", "events", "unique_ports", "unique_targets")


def flow_state_stream(packets: DataFrame, idle: float = 180, watermark: str = WATERMARK) -> DataFrame:
    """``packet_no, ts, flow, flow_established, flow_dir`` of TCP packets as they come."""
    ends = packets.select(
        "packet_no",
        "ts",
        flow_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port")).alias("flow"),
        endpoint(F.col("src_ip"), F.col("src_port")).alias("here"),
        endpoint(F.col("dst_ip"), F.col("dst_port")).alias("there"),
        F.upper(F.coalesce("tcp_flags", F.lit(""))).alias("flags"),
    )

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        client, established = state.get if state.exists else (None, False)
        rows = _ordered(frames)
        out = []
        for r in rows.itertuples(index=False):
            syn, ack = "S" in r.flags, "A" in r.flags
            if syn and not ack:
                client, established = r.here, False
            elif syn and client is None:
                client = r.there
            if ack and client is not None:
                established = True
            way = None if client is None else "to_server" if client == r.here else "to_client" if client == r.there else None
            out.append((r.packet_no, r.us, key[0], established, way))
        state.update((client, established))
        _keep_until(state, int(rows["us"].max()) + int(idle * MICROS))
        yield pd.DataFrame(out, columns=["packet_no", "us", "flow", "flow_established", "flow_dir"])

    found = _grouped(ends, ["flow"], watermark, ["packet_no", "here", "there", "flags"]).applyInPandasWithState(
        step, "packet_no bigint, us bigint, flow string, flow_established boolean, flow_dir string",
        "client string, established boolean", "append", GroupStateTimeout.EventTimeTimeout,
    )
    return found.select("packet_no", F.timestamp_micros("us").alias("ts"), "flow", "flow_established", "flow_dir")


def reassemble_stream(segments: DataFrame, idle: float = 120, watermark: str = WATERMARK) -> DataFrame:
    """``flow, arrival, start, data``: the newly contiguous bytes each arriving segment (``flow, arrival, ts, seq, data``) releases.

    The state holds the next expected position, where the last segment began, and
    the segments beyond a hole; it ends when a flow is idle, nothing is evicted
    before. Positions go on where sequence numbers begin anew.
    """
    named = segments.select("flow", "ts", F.col("arrival").alias("packet_no"), "seq", "data")

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        expected, last, starts, pieces = state.get if state.exists else (None, None, [], [])
        waiting = {int(s): bytes(p) for s, p in zip(starts, pieces, strict=True)}
        rows = _ordered(frames, ("packet_no",))
        out = []
        for r in rows.itertuples(index=False):
            data = bytes(r.data)
            if not data:
                continue
            # the nearer way around from the segment before
            last = int(r.seq) if last is None else last + (int(r.seq) - last + (1 << 31)) % (1 << 32) - (1 << 31)
            expected = last if expected is None else expected
            if len(data) > len(waiting.get(last, b"")):
                waiting[last] = data
            begin, released = expected, b""
            for seq in sorted(waiting):
                if seq > expected:
                    break
                fresh = waiting.pop(seq)[expected - seq :]
                released += fresh
                expected += len(fresh)
            if released:
                out.append((key[0], int(r.packet_no), begin, released))
        state.update((expected, last, list(waiting), list(waiting.values())))
        _keep_until(state, int(rows["us"].max()) + int(idle * MICROS))
        yield pd.DataFrame(out, columns=["flow", "arrival", "start", "data"])

    flow_type = dict(segments.dtypes)["flow"]
    return _grouped(named, ["flow"], watermark, ["packet_no", "seq", "data"]).applyInPandasWithState(
        step, f"flow {flow_type}, arrival bigint, start bigint, data binary",
        "expected bigint, last bigint, starts array<bigint>, pieces array<binary>", "append", GroupStateTimeout.EventTimeTimeout,
    )


def severity_counts_stream(alerts: DataFrame) -> DataFrame:
    """Running counts per severity, for output mode complete."""
    known = F.when(F.lower("severity").isin("high", "medium"), F.lower("severity")).otherwise("low")
    return alerts.groupBy(known.alias("severity")).agg(F.count("*").alias("count"))
