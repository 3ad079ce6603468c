"""Token ids in shards, each a wavelet matrix: bit planes with rank and select in one compressed block.

Plane by plane, from the highest bit, the ids are split stably into those with a 0 and those with a 1. A block holds a
directory and the planes in chunks of 32768 bits, each compressed by itself; the directory says where a chunk begins and
how many ones come before it. So one token, one count or one occurrence takes one or two chunks a plane, and the rest
stays compressed. A shard is a run of documents in ascending doc_id order; its block can stand in a file of its own or,
as here, in a row of a Parquet table, which Spark writes and commits as a whole, whatever the store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm.chunked_tokens import parts_of, stretch_encoder
from packetloom.llm.common import table_of, text_batches, u32

MAGIC = b"PLWM\x02"
CHUNK = 1 << 15  # bits of a plane that are compressed together; a multiple of 64
SHARD_TOKENS = 1 << 18
RANGE_BYTES = 32_000_000  # of texts in one task's range, about
SHARDS = "part int, shard bigint, doc_ids array<bigint>, lengths array<bigint>, n_tokens bigint, block binary"


class WaveletMatrix:
    """Sequence of unsigned integers below 2**32 with access, rank (counting) and select (places of occurrences)."""

    def __init__(self, n: int, counts: np.ndarray, load: Callable[[int, int], np.ndarray]) -> None:
        """``counts``: ones before each chunk of each plane, highest bit first, and all ones at the end; ``load``: a chunk's words."""
        self.n, self.counts, self.load = n, counts, load
        self.width = len(counts)
        self.zeros = [n - int(c[-1]) for c in counts]
        self.met: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        values = np.asarray(ids, dtype=np.uint32)
        n, width = len(values), int(values.max(initial=0)).bit_length()
        if width <= 16:
            values = values.astype(np.uint16)
        chunks = -(-n // CHUNK)
        planes, counts = [], np.zeros((width, chunks + 1), dtype=np.int64)
        for k, bit in enumerate(range(width - 1, -1, -1)):
            ones = (values & values.dtype.type(1 << bit)) != 0
            words = _packed(ones)
            planes.append(words)
            counts[k, 1:] = np.cumsum(np.bitwise_count(words).astype(np.int64).reshape(chunks, CHUNK // 64).sum(axis=1))
            values = np.concatenate([np.compress(~ones, values), np.compress(ones, values)])
        return cls(n, counts, lambda plane, chunk: planes[plane][chunk * (CHUNK // 64) : (chunk + 1) * (CHUNK // 64)])

    def _chunk(self, plane: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, ones before each word) of a chunk."""
        found = self.met.get((plane, chunk))
        if found is None:
            words = self.load(plane, chunk)
            found = self.met[plane, chunk] = words, np.append(0, np.cumsum(np.bitwise_count(words).astype(np.int64)))
        return found

    def _bits(self, plane: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bit at each place, the ones before it); a place may be the end, whose bit is 0."""
        bits, ones = np.zeros(len(places), dtype=np.int64), np.full(len(places), self.counts[plane][-1])
        chunks = places // CHUNK
        for chunk in np.unique(chunks[places < self.n]).tolist():
            mine = np.flatnonzero((chunks == chunk) & (places < self.n))
            words, before = self._chunk(plane, chunk)
            at = places[mine] - chunk * CHUNK
            word, inside = words[at >> 6], (at & 63).astype(np.uint64)
            below = (np.uint64(1) << inside) - np.uint64(1)
            bits[mine] = (word >> inside) & np.uint64(1)
            ones[mine] = self.counts[plane][chunk] + before[at >> 6] + np.bitwise_count(word & below)
        return bits, ones

    def access(self, places) -> np.ndarray:
        """The values at places."""
        at = np.atleast_1d(np.asarray(places, dtype=np.int64))
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("place outside the sequence")
        values = np.zeros(len(at), dtype=np.uint32)
        for k in range(self.width):
            bits, ones = self._bits(k, at)
            at = np.where(bits == 1, self.zeros[k] + ones, at - ones)
            values = (values << np.uint32(1)) | bits.astype(np.uint32)
        return values

    def values(self) -> np.ndarray:
        """All values: the planes' splits undone from the lowest bit up."""
        values = np.zeros(self.n, dtype=np.uint16 if self.width <= 16 else np.uint32)
        one = values.dtype.type(1)
        for k in range(self.width - 1, -1, -1):
            words = [self.load(k, c) for c in range(self.counts.shape[1] - 1)]
            ones = _unpacked(np.concatenate(words) if words else np.zeros(0, dtype="<u8"), self.n)
            values[self.zeros[k] :] |= one << values.dtype.type(self.width - 1 - k)
            joined = np.empty_like(values)
            joined[~ones], joined[ones] = values[: self.zeros[k]], values[self.zeros[k] :]
            values = joined
        return values

    def _range_of(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of value before ``end`` lie below the lowest plane."""
        low, high = 0, end
        if value >> self.width:
            return 0, 0
        for k in range(self.width):
            low1, high1 = self._bits(k, np.array([low, high]))[1].tolist()
            if value >> (self.width - 1 - k) & 1:
                low, high = self.zeros[k] + low1, self.zeros[k] + high1
            else:
                low, high = low - low1, high - high1
        return low, high

    def rank(self, value: int, end: int | None = None) -> int:
        """How often value occurs before ``end``."""
        low, high = self._range_of(value, self.n if end is None else end)
        return high - low

    def _selected(self, plane: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Places of the nth (from 0) given bits of a plane; ``nth`` ascends."""
        ones = self.counts[plane]
        before = ones if bit else np.minimum(np.arange(len(ones)) * CHUNK, self.n) - ones
        chunks = np.searchsorted(before, nth, side="right") - 1
        places = np.empty(len(nth), dtype=np.int64)
        for chunk in np.unique(chunks).tolist():
            mine = chunks == chunk
            held = min(CHUNK, self.n - chunk * CHUNK)
            bits = _unpacked(self._chunk(plane, chunk)[0], held)
            places[mine] = chunk * CHUNK + np.flatnonzero(bits == bool(bit))[nth[mine] - before[chunk]]
        return places

    def places(self, value: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Places of the occurrences of value, from the ``first`` to before the ``last`` (all, if none), ascending."""
        low, high = self._range_of(value, self.n)
        at = np.arange(low + first, high if last is None else min(high, low + last))
        for k in range(self.width - 1, -1, -1):
            one = value >> (self.width - 1 - k) & 1
            at = self._selected(k, one, at - self.zeros[k] if one else at)
        return at

    def select(self, value: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of value."""
        if not 0 <= nth < self.rank(value):
            raise IndexError("no such occurrence")
        return int(self.places(value, nth, nth + 1)[0])

    def to_bytes(self) -> bytes:
        packer = zstandard.ZstdCompressor(level=1)
        chunks = self.counts.shape[1] - 1
        bodies = [packer.compress(self.load(k, c).tobytes()) for k in range(self.width) for c in range(chunks)]
        offsets = np.cumsum([0, *map(len, bodies)]).astype("<u8")
        head = MAGIC + struct.pack("<QBI", self.n, self.width, CHUNK)
        return b"".join([head, self.counts.astype("<i8").tobytes(), offsets.tobytes(), *bodies])

    @classmethod
    def from_bytes(cls, block: bytes) -> WaveletMatrix:
        """The matrix of a block; chunks are unpacked when they are needed."""
        if block[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        n, width, size = struct.unpack_from("<QBI", block, len(MAGIC))
        if size != CHUNK:
            raise ValueError("a shard with chunks of another size")
        chunks, at = -(-n // CHUNK), len(MAGIC) + 13
        counts = np.frombuffer(block, "<i8", width * (chunks + 1), at).reshape(width, chunks + 1)
        at += counts.nbytes
        offsets = np.frombuffer(block, "<u8", width * chunks + 1, at).astype(np.int64)
        at += offsets.nbytes
        unpack, held = zstandard.ZstdDecompressor().decompress, memoryview(block)

        def load(plane: int, chunk: int) -> np.ndarray:
            k = plane * chunks + chunk
            return np.frombuffer(unpack(held[at + offsets[k] : at + offsets[k + 1]]), dtype="<u8")

        return cls(n, counts, load)


def _packed(bits: np.ndarray) -> np.ndarray:
    data = np.packbits(bits, bitorder="little").tobytes()
    return np.frombuffer(data + bytes(-len(data) % (CHUNK // 8)), dtype="<u8")


def _unpacked(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), count=n, bitorder="little").view(bool)


def encode_tokens(documents: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """(doc_id, ids binary little-endian unsigned 32-bit): every whole text, the end id behind it. A null text is empty.

    The string of a special token in a text is that token, as the library has it.
    """
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = stretch_encoder(tokenizer, True), u32([end_id])
        for keys, texts in text_batches(batches):
            for k, some in parts_of(texts):
                yield table_of(out, keys.slice(k, len(some)).cast(pa.int64()), [i + end for i in encoder.encode_batch(some)])

    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, ids binary")


def write_shards(documents: DataFrame, tokenizer: str, path: str, shard_tokens: int = SHARD_TOKENS, end_id: int = 0) -> None:
    """Write the documents' ids as wavelet shards in ascending doc_id order, a null doc_id first, equal ids by a hash of their text.

    Ranges of doc_id go to one task each, as many as the bytes of all texts need; rows of one doc_id may be in several.
    A task sorts its range (spilling if need be), encodes it and cuts a shard whenever enough tokens are together; so
    memory is one shard and the longest document. Row: part (number of the range), shard (within it), doc_ids and lengths,
    n_tokens, block.
    """
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("_row")]
    rows = documents.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(max(1, -(-size // RANGE_BYTES)), *order).sortWithinPartitions(*order)
    out = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("block", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, pieces, held, part = 0, [], [], 0, None

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(pieces), "<u4")
            return table_of(out, [part], [shard], [keys], [[len(p) // 4 for p in pieces]], [len(ids)], [WaveletMatrix.of(ids).to_bytes()])

        for part, key, ids in encoded(batches):  # noqa: B007
            keys.append(key)
            pieces.append(ids)
            held += len(ids) // 4
            if held >= shard_tokens:
                yield row()
                shard, keys, pieces, held = shard + 1, [], [], 0
        if keys:
            yield row()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, bytes]]:
        encoder, end = stretch_encoder(tokenizer, True), u32([end_id])
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for k, some in parts_of(texts):
                rows = batch.slice(k, len(some))
                for part, key, ids in zip(rows.column(2).to_pylist(), rows.column(0).to_pylist(), encoder.encode_batch(some), strict=True):
                    yield part, key, ids + end

    numbered = ordered.select(F.col("doc_id").cast("bigint"), "text", F.spark_partition_id().alias("part"))
    numbered.mapInArrow(cut, SHARDS).write.option("compression", "uncompressed").parquet(path)


def _starts(shards: DataFrame) -> DataFrame:
    """(part, shard, shard_start): the tokens of all shards before each; runs of shards within a range are added up in parallel, then the ranges."""
    inside = Window.partitionBy("part").orderBy("shard")
    by_part = shards.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    first = by_part.select("part", (F.sum("_all").over(Window.orderBy("part")) - F.col("_all")).alias("_first"))
    before = shards.select("part", "shard", "n_tokens", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("_inside"))
    return before.join(first, "part").select("part", "shard", "n_tokens", (F.col("_first") + F.col("_inside")).alias("shard_start"))


def read_shards(spark: SparkSession, path: str, of_document: Callable[[bytes], int] = zlib.crc32) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the shards: each document's place among all tokens, and a sum of its ids.

    ``start`` counts the tokens of all shards before; the shards' totals (one row a shard) are added up in one task.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    starts = _starts(shards).drop("n_tokens")
    out = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, keys, lengths, block in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                ids = WaveletMatrix.from_bytes(block).values().astype("<u4")
                ends = np.cumsum(lengths)
                begins = ends - lengths
                sums = [of_document(ids[b:e].tobytes()) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield table_of(out, [part] * len(keys), [shard] * len(keys), keys, begins, lengths, sums)

    read = shards.select("part", "shard", "doc_ids", "lengths", "block").mapInArrow(documents, "part int, shard bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(starts, ["part", "shard"]).select("doc_id", (F.col("start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, token) for the distinct ``position`` among all tokens of the shards; those outside have no row.

    A shard unpacks only the chunks that its positions lead through.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    spans = _starts(shards).filter("n_tokens > 0").withColumn("_cell", F.explode(F.expr(f"sequence(shard_start div {SHARD_TOKENS}, (shard_start + n_tokens - 1) div {SHARD_TOKENS})")))
    asked = positions.select(F.col("position").cast("bigint").alias("position")).distinct().withColumn("_cell", F.expr(f"position div {SHARD_TOKENS}"))
    placed = asked.join(spans, "_cell").filter("position >= shard_start and position < shard_start + n_tokens")
    # as many at most as the shard has tokens
    grouped = placed.groupBy("part", "shard").agg(F.collect_list(F.col("position")).alias("positions"), F.min("shard_start").alias("shard_start"))
    out = pa.schema([("position", pa.int64()), ("token", pa.int64())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, start, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places = np.array(places, dtype=np.int64)
                yield table_of(out, places, WaveletMatrix.from_bytes(block).access(places - start).astype(np.int64))

    return shards.select("part", "shard", "block").join(grouped, ["part", "shard"]).select("positions", "shard_start", "block").mapInArrow(look, "position bigint, token bigint")


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of the tokens stands in all shards, by rank; the list is the caller's, at most a vocabulary."""
    out = pa.schema([("token", pa.int64()), ("n", pa.int64())])
    wanted = sorted(set(tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                matrix = WaveletMatrix.from_bytes(block)
                yield table_of(out, wanted, [matrix.rank(token) for token in wanted])

    found = spark.read.schema(SHARDS).parquet(path).select("block").mapInArrow(count, "token bigint, n bigint")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def token_occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, offset): every place of a token, by select; ``offset`` is that within the document."""
    out = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, lengths, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places = WaveletMatrix.from_bytes(block).places(token)
                ends = np.cumsum(lengths)
                which = np.searchsorted(ends, places, side="right")
                yield table_of(out, [keys[k] for k in which.tolist()], places - (ends - lengths)[which])

    return spark.read.schema(SHARDS).parquet(path).select("doc_ids", "lengths", "block").mapInArrow(find, "doc_id bigint, offset bigint")
