"""TCP flows: handshake state, byte-stream reassembly, buffers, request dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.packet import endpoint, flow_key, has_flag, latin1
from packetloom.operators.byte_stream import unwrapped
from packetloom.operators.windows import MICROS, micros, running, silence

HANDSHAKE_CELL = 60 * MICROS
SEQUENCE_CELL = 1 << 20
CONNECTION_CELL = 60 * MICROS


def flow_state(packets: DataFrame) -> DataFrame:
    """Adds ``flow, flow_established, flow_dir`` to TCP packets.

    A SYN makes its sender the client and resets the flow; without any SYN the
    first SYN+ACK names its receiver the client.  The flow is established once an
    ACK follows.  All three facts are running minima or maxima, so a long flow is
    cut into cells of time instead of being walked by one task.
    """
    here, there = endpoint(F.col("src_ip"), F.col("src_port")), endpoint(F.col("dst_ip"), F.col("dst_port"))
    syn, ack = has_flag(F.col("tcp_flags"), "S"), has_flag(F.col("tcp_flags"), "A")
    at = [micros("ts").alias("us"), F.col("packet_no").alias("no")]
    flows = packets.withColumn(
        "flow", flow_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))
    )
    out = running(
        flows,
        ["flow"],
        micros("ts"),
        ["ts", "packet_no"],
        {
            "_syn": ("max", F.when(syn & ~ack, F.struct(*at, here.alias("client")))),
            "_answer": ("min", F.when(syn & ack, F.struct(*at, there.alias("client")))),
            "_ack": ("max", F.when(ack, F.struct(*at))),
        },
        HANDSHAKE_CELL,
    )
    client = F.coalesce(F.col("_syn.client"), F.col("_answer.client"))
    acked = F.coalesce(F.col("_ack") > F.struct(F.col("_syn.us").alias("us"), F.col("_syn.no").alias("no")), F.lit(False))
    return out.withColumns(
        {
            "flow_established": F.when(F.col("_syn").isNotNull(), acked).otherwise(F.col("_answer").isNotNull()),
            "flow_dir": F.when(client == here, "to_server").when(client == there, "to_client"),
        }
    ).drop("_syn", "_answer", "_ack")


def connections(packets: DataFrame, idle: float = 120) -> DataFrame:
    """``packet_no, connection`` of TCP packets: the how many-th connection of its flow a packet belongs to.

    A connection starts at a flow's first packet, at a SYN that does not repeat
    one right before it, and after more than ``idle`` seconds without a packet.
    ``packets`` has ``packet_no, flow, ts, tcp_flags``; packets without a time
    belong to none.
    """
    flags = F.coalesce("tcp_flags", F.lit(""))
    syn = (flags.contains("S") & ~flags.contains("A")).cast("bigint")
    placed = packets.select("packet_no", "flow", micros("ts").alias("us"), syn.alias("syn")).filter("us is not null")
    # time and SYN of the packet before in one number
    before = running(placed, ["flow"], F.col("us"), ["us", "packet_no"], {"_last": ("max", F.col("us") * 2 + F.col("syn"))}, CONNECTION_CELL, include_current=False)
    last, repeated = F.expr("_last div 2"), F.expr("pmod(_last, 2)") == 1
    starts = F.col("_last").isNull() | (F.col("us") - last > int(idle * MICROS)) | ((F.col("syn") == 1) & ~repeated)
    marked = before.select("packet_no", "flow", "us", F.coalesce(starts, F.lit(True)).cast("bigint").alias("_start"))
    counted = running(marked, ["flow"], F.col("us"), ["us", "packet_no"], {"connection": ("sum", F.col("_start"))}, CONNECTION_CELL)
    return counted.select("packet_no", "connection")


def reassembly_cuts(segments: DataFrame) -> DataFrame:
    """Where each segment's new data starts: ``flow, arrival, start, skip, contiguous``.

    ``segments`` has ``flow, arrival, seq, size`` and no data, so the shuffles
    carry a few numbers per segment.  The stream starts at the first segment that
    arrived; what lies before it or was seen already is skipped, of equal starts
    the longest segment counts, segments without new data are left out.
    ``contiguous`` is false from the first hole on. ``start`` goes on beyond 2**32
    where sequence numbers begin anew, however often.
    """
    present = segments.filter("size > 0").select("flow", "arrival", F.col("seq").cast("bigint"), F.col("size").cast("bigint"))
    present = unwrapped(present)
    base = present.groupBy("flow").agg(F.min_by("seq", "arrival").alias("_base"))
    seen = running(
        present,
        ["flow"],
        F.col("seq"),
        ["seq", F.desc("size"), "arrival"],
        {"_until": ("max", F.col("seq") + F.col("size"))},
        SEQUENCE_CELL,
        include_current=False,
    ).join(base, "flow")
    until = F.greatest(F.coalesce("_until", "_base"), F.col("_base"))
    start = F.greatest(F.col("seq"), until)
    pieces = seen.filter(F.col("seq") + F.col("size") > start).select(
        "flow", "arrival", start.alias("start"), (start - F.col("seq")).alias("skip"), (F.col("seq") > until).alias("_hole")
    )
    holes = pieces.filter("_hole").groupBy("flow").agg(F.min("start").alias("_first"))
    return pieces.join(holes, "flow", "left").select(
        "flow", "arrival", "start", "skip", (F.col("_first").isNull() | (F.col("start") < F.col("_first"))).alias("contiguous")
    )


def reassemble(segments: DataFrame) -> DataFrame:
    """Pieces of new data per flow: ``flow, arrival, start, data, contiguous``.

    ``segments`` has ``flow, arrival, seq, data``; the data is shuffled once, to
    meet its cut.
    """
    cuts = reassembly_cuts(segments.select("flow", "arrival", "seq", F.length("data").alias("size")))
    new = F.substring("data", (F.col("skip") + 1).cast("int"), F.length("data"))
    return (
        segments.select("flow", "arrival", "data")
        .join(cuts, ["flow", "arrival"])
        .select("flow", "arrival", "start", new.alias("data"), "contiguous")
    )


def flow_bytes(pieces: DataFrame) -> DataFrame:
    """``flow, first_arrival, last_arrival, data``: the contiguous bytes of every flow from its start.

    One value for a whole flow, so for flows that are known to be small; messages
    and lines of others are cut out of blocks (``byte_stream``).
    """
    text = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("start", latin1(F.col("data")).alias("text")))), lambda p: p["text"]
        ),
        "",
    )
    return (
        pieces.filter("contiguous")
        .groupBy("flow")
        .agg(
            F.min("arrival").alias("first_arrival"),
            F.max("arrival").alias("last_arrival"),
            F.encode(text, "ISO-8859-1").alias("data"),
        )
    )


def tail_buffer(chunks: DataFrame, size: int = 65536) -> DataFrame:
    """Last ``size`` bytes of what was appended per flow (``flow, arrival, data``).

    Only the pieces that reach into the tail are brought together.
    """
    ends = running(
        chunks, ["flow"], F.col("arrival").cast("bigint"), ["arrival"], {"_end": ("sum", F.length("data"))}, 4096
    )
    total = ends.groupBy("flow").agg(F.max("_end").alias("_total"))
    kept = ends.join(total, "flow").filter(F.col("_end") > F.col("_total") - size)
    text = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("arrival", latin1(F.col("data")).alias("text")))), lambda p: p["text"]
        ),
        "",
    )
    joined = kept.groupBy("flow").agg(text.alias("_text"))
    return joined.select("flow", F.encode(F.expr(f"right(_text, {int(size)})"), "ISO-8859-1").alias("buffer"))


def live_contexts(events: DataFrame, now, timeout: float = 300) -> DataFrame:
    """``flow, first_seen, last_seen`` of the flows that were active in the last ``timeout`` seconds."""
    cutoff = F.timestamp_micros(micros(F.lit(now).cast("timestamp")) - int(timeout * MICROS))
    return (
        events.groupBy("flow")
        .agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
        .filter(F.col("last_seen") >= cutoff)
    )


def dedupe_requests(requests: DataFrame, seconds: float = 2, derived: bool = False) -> DataFrame:
    """Requests whose raw bytes were not processed on the same flow in the last ``seconds``."""
    return silence(
        requests.withColumn("_hash", F.sha1("raw")), ["flow", "_hash"], "ts", seconds, True, ["packet_no", "msg_no"], derived
    ).drop("_hash")
