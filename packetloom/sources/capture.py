"""Packet capture files as packet tables.

Only the framing of a capture file is sequential.  A first pass jumps from record
header to record header and cuts every file into chunks; the chunks are spread
over the cluster, so one huge file does not stay with one task.  The headers of
the packets are read by column expressions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.packet import byte_at

# File magics, link types with the place of the IP header, flag letters.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
LINK_OFFSET = {0: 4, 12: 0, 14: 0, 101: 0, 113: 16, 228: 0}
ETHERNET = 1
FLAG_LETTERS = "FSRPAUEC"
CHUNK_BYTES = 32 << 20
FILE_NUMBER_STEP = 1 << 40

_CHUNKS = "path string, file_no bigint, first_no bigint, offset bigint, count bigint, order string, scale int, link int"
_FRAMES = "packet_no bigint, us bigint, link int, frame binary"


def _open(path: str):
    if path.startswith("file:"):
        path = path[len("file:") :]
        path = "/" + path.lstrip("/")
    if "://" in path:
        system, name = fs.FileSystem.from_uri(path)
    else:
        system, name = fs.LocalFileSystem(), path
    return system.open_input_file(name)


def _index(chunk_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, file_no in zip(batch.column("path").to_pylist(), batch.column("file_no").to_pylist(), strict=True):
                rows = list(_cut(path, chunk_bytes))
                if rows:
                    names = ["first_no", "offset", "count", "order", "scale", "link"]
                    columns = [pa.array(c) for c in zip(*rows, strict=True)]
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * n), pa.array([file_no] * n, pa.int64()), *columns[:4], columns[4].cast(pa.int32()), columns[5].cast(pa.int32())],
                        names=["path", "file_no", *names],
                    )

    return run


def _cut(path: str, chunk_bytes: int):
    with _open(path) as f:
        size = f.size()
        head = f.read_at(24, 0)
        if not size:
            return
        if len(head) < 24 or head[:4] not in MAGIC:
            raise ValueError(f"not a pcap file: {path}")
        order, scale = MAGIC[head[:4]]
        link = struct.unpack(order + "I", head[20:24])[0] & 0xFFFF
        at, number, start, first = 24, 0, 24, 0
        while at + 16 <= size:
            length = struct.unpack(order + "I", f.read_at(4, at + 8))[0]
            if at + 16 + length > size:
                break
            at += 16 + length
            number += 1
            if at - start >= chunk_bytes:
                yield first, start, number - first, order, scale, link
                start, first = at, number
        if number > first:
            yield first, start, number - first, order, scale, link


def _frames(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in batch.to_pylist():
            with _open(c["path"]) as f:
                f.seek(c["offset"])
                numbers, times, frames, held = [], [], [], 0
                for i in range(c["count"]):
                    sec, frac, length, _ = struct.unpack(c["order"] + "IIII", f.read(16))
                    frames.append(f.read(length))
                    times.append(sec * 1_000_000 + frac // c["scale"])
                    numbers.append(c["file_no"] * FILE_NUMBER_STEP + c["first_no"] + i + 1)
                    held += length
                    if held > 8 << 20 or len(frames) >= 10_000:
                        yield _frame_batch(numbers, times, c["link"], frames)
                        numbers, times, frames, held = [], [], [], 0
                if frames:
                    yield _frame_batch(numbers, times, c["link"], frames)


def _frame_batch(numbers, times, link, frames):
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers), pa.array(times), pa.array([link] * len(frames), pa.int32()), pa.array(frames, pa.binary())],
        names=["packet_no", "us", "link", "frame"],
    )


def _u16(data: Column, at: Column) -> Column:
    return byte_at(data, at) * 256 + byte_at(data, at + 1)


def _u32(data: Column, at: Column) -> Column:
    return F.conv(F.hex(data.substr(at + 1, F.lit(4))), 16, 10).cast("bigint")


def _address(data: Column, at: Column) -> Column:
    return F.concat_ws(".", *[byte_at(data, at + i).cast("string") for i in range(4)])


def parse_frames(frames: DataFrame) -> DataFrame:
    """Link-layer frames (``packet_no, us, link, frame``) as packets; only IPv4 is kept."""
    frame = F.col("frame")
    ip = F.lit(None).cast("int")
    for link, offset in LINK_OFFSET.items():
        ip = F.when(F.col("link") == link, offset).otherwise(ip)
    vlan = F.hex(frame.substr(13, 2)) == "8100"
    ip = F.when(F.col("link") == ETHERNET, F.when(vlan, 18).otherwise(14)).otherwise(ip)
    placed = frames.withColumn("_ip", ip).withColumn("_first", byte_at(frame, F.col("_ip")))
    at = F.col("_ip")
    known = placed.filter(F.expr("_first div 16") == 4).withColumns(
        {
            "_l4": at + (F.col("_first") % 16) * 4,
            "_end": F.least(F.length("frame"), at + F.greatest(_u16(frame, at + 2), F.lit(20))),
            "ip_id": _u16(frame, at + 4),
            "ip_proto": byte_at(frame, at + 9),
            "src_ip": _address(frame, at + 12),
            "dst_ip": _address(frame, at + 16),
        }
    )
    l4 = F.col("_l4")
    proto = F.col("ip_proto")
    # a later fragment carries no transport header
    first = (_u16(frame, at + 6) % 0x2000) == 0
    tcp, udp, icmp = first & (proto == 6), first & (proto == 17), first & (proto == 1)
    bits = byte_at(frame, l4 + 13)
    letters = F.concat(
        *[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, c).otherwise("") for i, c in enumerate(FLAG_LETTERS)]
    )
    start = F.when(tcp, l4 + F.expr("conv(hex(substr(frame, _l4 + 13, 1)), 16, 10)").cast("int").bitwiseAND(F.lit(0xF0)) / 4)
    start = start.when(udp | icmp, l4 + 8).otherwise(l4).cast("int")
    return known.select(
        "packet_no",
        F.timestamp_micros("us").alias("ts"),
        "src_ip",
        "dst_ip",
        F.when(tcp | udp, _u16(frame, l4)).alias("src_port"),
        F.when(tcp | udp, _u16(frame, l4 + 2)).alias("dst_port"),
        F.when(tcp, "TCP").when(udp, "UDP").when(icmp, "ICMP").otherwise("IP").alias("proto"),
        "ip_id",
        "ip_proto",
        F.when(tcp, letters).alias("tcp_flags"),
        F.when(tcp, _u32(frame, l4 + 4)).alias("seq"),
        F.when(tcp, _u32(frame, l4 + 8)).alias("ack"),
        F.when(tcp, _u16(frame, l4 + 14)).alias("window"),
        F.when(icmp, byte_at(frame, l4)).alias("icmp_type"),
        F.when(icmp, byte_at(frame, l4 + 1)).alias("icmp_code"),
        frame.substr(start + 1, F.greatest(F.col("_end") - start, F.lit(0))).alias("payload"),
    )


def read_captures(
    spark: SparkSession, path: str, max_packets: int | None = None, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Packets of capture files (a file, folder or pattern the executors can open).

    ``packet_no`` counts the packets of a file from 1; files are numbered in the
    order of their paths in the upper bits.  ``max_packets`` keeps the first
    packets of every file.
    """
    from pyspark.sql.window import Window

    # one row per file: the listing is small whatever the files hold
    listed = spark.read.format("binaryFile").load(path).select("path")
    numbered = listed.withColumn("file_no", F.row_number().over(Window.orderBy("path")).cast("bigint") - 1)
    chunks = numbered.repartition("path").mapInArrow(_index(chunk_bytes), _CHUNKS)
    if max_packets is not None:
        chunks = chunks.filter(F.col("first_no") < max_packets)
    frames = chunks.repartition("path", "offset").mapInArrow(_frames, _FRAMES)
    if max_packets is not None:
        frames = frames.filter(F.pmod("packet_no", F.lit(FILE_NUMBER_STEP)) <= max_packets)
    return parse_frames(frames)
