"""Best-fit packing by patterns: which few lengths together fill a sequence, fitted to the histogram of lengths.

Only the histogram (one count for each possible length) reaches the driver, whatever the number of documents. There,
patterns of up to three length classes that fill a sequence are enumerated, their repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and what is left is packed best-fit decreasing, still by
counts. Back on Spark every piece takes a place by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.chunked_tokens import parts_of, stretch_encoder
from packetloom.llm.common import materialize, table_of, text_batches, u32

GRAIN = 8  # tokens in a length class
FILLERS = 96  # shorter pieces are left to fill the gaps of patterns
SPREAD_ROWS = 50_000  # pieces ranked in one group


def token_pieces(documents: DataFrame, tokenizer: str, limit: int, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the end id behind every whole text, documents over ``limit`` cut at its multiples.

    A null text is empty (one piece, the end id). The string of a special token in a text is that token, as the library has it. Repeated rows are pieces each; a null doc_id stays null.
    """
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = stretch_encoder(tokenizer, False), u32([end_id])
        for keys, texts in text_batches(batches):
            rows = []
            for k, some in parts_of(texts):
                for key, ids in zip(keys.slice(k, len(some)).to_pylist(), encoder.encode_batch(some), strict=True):
                    data = ids + end
                    for piece, begin in enumerate(range(0, len(data), 4 * limit)):
                        part = data[begin : begin + 4 * limit]
                        rows.append((key, piece, begin // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield table_of(out, *zip(*rows, strict=True))

    return documents.select("doc_id", "text").mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def fitted(histogram: np.ndarray, patterns: np.ndarray, steps: int | None = None) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns (columns) that bring ``patterns @ x`` closest to the histogram, by active sets."""
    rows, columns = patterns.shape
    x, active = np.zeros(columns), np.zeros(columns, dtype=bool)
    gradient = patterns.T @ histogram
    small = 1e-9 * max(float(histogram.max(initial=0)), 1.0)
    for _ in range(steps or 3 * rows):
        choice = np.where(active, -np.inf, gradient)
        best = int(choice.argmax()) if columns else 0
        if not columns or choice[best] <= small:
            break
        active[best] = True
        while True:
            used = np.flatnonzero(active)
            solved = np.linalg.lstsq(patterns[:, used], histogram, rcond=None)[0]
            if (solved > small).all():
                x[:] = 0
                x[used] = solved
                break
            # go only as far towards the solution as no count falls below zero
            falling = solved <= small
            share = x[used][falling] / np.maximum(x[used][falling] - solved[falling], 1e-300)
            x[used] += float(share.min()) * (solved - x[used])
            active[used[x[used] <= small]] = False
            x[~active] = 0
            if not active.any():
                break
        gradient = patterns.T @ (histogram - patterns @ x)
    return x


def class_patterns(classes: int) -> list[tuple[int, ...]]:
    """All ways to fill ``classes`` units with one to three length classes, the largest first."""
    found: list[tuple[int, ...]] = [(classes,)]
    for a in range(1, classes):
        if 2 * a >= classes:
            found.append((a, classes - a))
        for b in range(1, min(a, classes - a - 1) + 1):
            c = classes - a - b
            if 1 <= c <= b:
                found.append((a, b, c))
    return found


def plan_packing(counts: dict[int, int], limit: int, grain: int = GRAIN, fillers: int = FILLERS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for counts by length; every piece has a place, none is over ``limit``.

    Works on counts alone: time and result size depend on the number of different lengths, not of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if left and (min(left) < 1 or max(left) > limit):
        raise ValueError("lengths must lie between 1 and the limit")
    planned: list[tuple[tuple[int, ...], int]] = []
    if limit in left:
        planned.append(((limit,), left.pop(limit)))
    classes = -(-limit // grain)
    by_class: dict[int, list[int]] = {}  # lengths of a class, longest first
    for n in sorted(left, reverse=True):
        if n >= fillers:
            by_class.setdefault(-(-n // grain), []).append(n)
    histogram = np.zeros(classes + 1)
    for c, lengths in by_class.items():
        histogram[c] = sum(left[n] for n in lengths)
    patterns = [p for p in class_patterns(classes) if all(histogram[c] for c in p)]
    if patterns:
        rows = np.flatnonzero(histogram)
        row_of = {int(c): k for k, c in enumerate(rows)}
        matrix = np.zeros((len(rows), len(patterns)))
        for k, p in enumerate(patterns):
            for c in p:
                matrix[row_of[c], k] += 1
        repeats = np.floor(fitted(histogram[rows], matrix) + 1e-6).astype(int)
        for k in np.argsort(-repeats, kind="stable"):
            want = int(repeats[k])
            *firsts, _ = patterns[k]
            while want > 0:
                # of each class the longest that is left; the last place is filled best-fit, whatever its class
                lengths: list[int] = []
                for c in firsts:
                    n = next((n for n in by_class[c] if left[n] > lengths.count(n)), None)
                    if n is None:
                        break
                    lengths.append(n)
                if len(lengths) < len(firsts):
                    break
                gap = limit - sum(lengths)
                last = next((n for n in range(gap, max(gap - grain, 0), -1) if left.get(n, 0) > lengths.count(n)), None)
                if last is None:
                    break
                lengths.append(last)
                run = min([want, *(left[n] // lengths.count(n) for n in lengths)])
                for n in lengths:
                    left[n] -= run
                planned.append((tuple(lengths), run))
                want -= run
    return _fill(planned, {n: c for n, c in left.items() if c > 0}, limit)


def _fill(planned: list[tuple[tuple[int, ...], int]], left: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of what is left, by counts: into the tightest open gap, or a new sequence."""
    open_by_gap: dict[int, list[list]] = {}  # gap -> [lengths, count]
    done = []
    for lengths, count in planned:
        gap = limit - sum(lengths)
        if gap:
            open_by_gap.setdefault(gap, []).append([lengths, count])
        else:
            done.append((lengths, count))
    gaps = sorted(open_by_gap)

    def put(gap: int, entry: list) -> None:
        if gap == 0:
            done.append((entry[0], entry[1]))
            return
        if gap not in open_by_gap:
            open_by_gap[gap] = []
            bisect.insort(gaps, gap)
        open_by_gap[gap].append(entry)

    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            at = bisect.bisect_left(gaps, n)
            if at < len(gaps):
                gap = gaps[at]
                lengths, held = open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    del open_by_gap[gap]
                    gaps.pop(at)
                used = min(held, count)
                if held > used:
                    put(gap, [lengths, held - used])
            else:
                fit = limit // n  # a new sequence takes several of the same length at once
                used, lengths, gap = count // fit, (n,) * (fit - 1), limit - n * (fit - 1)
                if not used:
                    used, lengths, gap = 1, (n,) * (count - 1), limit - n * (count - 1)
                put(gap - n, [(*lengths, n), used])
                count -= used * (len(lengths) + 1)
                continue
            put(gap - n, [(*lengths, n), used])
            count -= used
    return done + [(lengths, count) for entries in open_by_gap.values() for lengths, count in entries]


def pack_pieces(pieces: DataFrame, limit: int) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: packed into few sequences of at most ``limit`` tokens, without gaps.

    ``pieces`` needs a column ``length`` between 1 and ``limit``; its other columns stay (clashing names excepted). An
    empty table gives an empty one. Pieces of one length are ranked in many groups, so a length that most pieces have
    does not meet in one task. The plan that all tasks get has at most a few entries for each possible length.
    """
    pieces = materialize(pieces.drop("sequence_id", "offset"))  # ranks below must be those counted here
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``limit`` rows
    total = sum(counts.values())
    plan = plan_packing(counts, limit)
    runs: dict[int, list[tuple[int, int, int]]] = {}  # length -> (first rank, first sequence, offset)
    taken: dict[int, int] = {}
    first = 0
    for lengths, repeat in plan:
        offset = 0
        for n in lengths:
            rank = taken.get(n, 0)
            runs.setdefault(n, []).append((rank, first, offset))
            taken[n] = rank + repeat
            offset += n
        first += repeat
    if taken != counts:
        raise AssertionError("the plan does not hold every piece once")
    table = {n: tuple(np.array(column) for column in zip(*entries, strict=True)) for n, entries in runs.items()}
    # ranks: within (length, salt) by row, salts of a length one after the other
    salts = max(1, -(-total // SPREAD_ROWS))
    columns = pieces.columns
    keyed = pieces.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int"))
    sizes = keyed.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt")
    bases = sizes.select("length", "_salt", (F.sum("_n").over(before) - F.col("_n")).alias("_base"))
    inside = Window.partitionBy("length", "_salt").orderBy(*columns)
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1).join(bases, ["length", "_salt"])
    ranked = ranked.select(*columns, (F.col("_rank") + F.col("_base")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(columns.index("length")).to_numpy(zero_copy_only=False)
            ranks = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
            order = np.argsort(lengths, kind="stable")
            found, begins = np.unique(lengths[order], return_index=True)
            for n, begin, end in zip(found.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True):
                rows = order[begin:end]
                starts, firsts, offsets = table[n]
                run = np.searchsorted(starts, ranks[rows], side="right") - 1
                sequence[rows] = firsts[run] + ranks[rows] - starts[run]
                offset[rows] = offsets[run]
            arrays = [batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{kept}, sequence_id bigint, offset bigint")


def pack_documents(documents: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """Every document's pieces with their sequence and place in it; see :func:`token_pieces` and :func:`pack_pieces`."""
    return pack_pieces(token_pieces(documents, tokenizer, limit), limit)
