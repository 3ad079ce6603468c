"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text's symbols are merged by an agenda of adjacent pairs, ordered by the score of the piece they would form and then
by place. No piece of such a vocabulary holds a word end followed by a space mark, so no merge crosses that border and a
text can be encoded chunk by chunk, each distinct chunk once. Every chunk that is encoded anew is checked against the
sentencepiece library, a batch at a time.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from packetloom.llm.common import table_of, text_batches, u32

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
CACHED_LENGTH, CACHED_CHUNKS = 64, 500_000
NEVER = np.int32(2**31 - 1)


class PieceModel:
    """A merge-type model with byte fallback and no normalisation of its own; others are refused."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if model.trainer_spec.model_type != 2 or not plain or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE} or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models without normalisation and user-defined pieces")
        if any(a != MARK == b for p in model.pieces if p.type == NORMAL for a, b in zip(p.piece, p.piece[1:])):
            raise ValueError("a piece crosses a word border")
        self.library = SentencePieceProcessor(model_file=path)
        self.begin, self.end, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == BYTE}
        surface = {NORMAL: lambda p: p.piece.replace(MARK, " ").encode(), CONTROL: lambda p: b"", UNKNOWN: lambda p: model.trainer_spec.unk_surface.encode(), BYTE: lambda p: bytes([int(p.piece[3:5], 16)])}
        self.surfaces = [surface[p.type](p) for p in model.pieces]

    def merge(self, chunk: str) -> list[str]:
        """The pieces of one chunk: the best adjacent pair is merged until no pair forms a piece."""
        symbols: list[str | None] = list(chunk)
        n, scores, agenda = len(symbols), self.scores, []
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def propose(left: int, right: int) -> None:
            piece = symbols[left] + symbols[right]
            if piece in scores:
                heapq.heappush(agenda, (-scores[piece], left, right, piece))

        for k in range(n - 1):
            propose(k, k + 1)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or after[left] != right or symbols[left] + symbols[right] != piece:
                continue  # one of the two has been merged meanwhile
            symbols[left], symbols[right] = piece, None
            following = after[right]
            after[left] = following
            if following < n:
                before[following] = left
                propose(left, following)
            if before[left] >= 0:
                propose(before[left], left)
        return [s for s in symbols if s is not None]

    def encode_chunk(self, chunk: str) -> list[int]:
        ids = []
        for piece in self.merge(chunk):
            known = self.ids.get(piece)
            ids += self.fallback(piece) if known is None else [known]
        return ids

    @cache  # noqa: B019  one model a process
    def fallback(self, character: str) -> list[int]:
        return [self.byte_ids[b] for b in character.encode()] if self.byte_ids else [self.unknown]

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every pair of pieces that forms a piece: (left * 2**32 + right) ascending, the rank of its score (0 is best), the piece formed."""
        best = {s: r for r, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        found = {}
        for piece, number in self.ids.items():
            for k in range(1, len(piece)):
                left, right = self._symbol(piece[:k]), self._symbol(piece[k:])
                if left is not None and right is not None:
                    found[(left << 32) + right] = (best[self.scores[piece]], number)
        keys = np.array(sorted(found), dtype=np.int64)
        values = np.array([found[k] for k in keys.tolist()], dtype=np.int32).reshape(-1, 2)
        return keys, values[:, 0], values[:, 1]

    def _symbol(self, text: str) -> int | None:
        """Pieces have their id; a character that is no piece a number beyond all ids."""
        return self.ids.get(text, len(self.surfaces) + ord(text) if len(text) == 1 else None)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, ranks, formed = self.pairs
        wanted = (left.astype(np.int64) << 32) + right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        there = keys[at] == wanted
        return np.where(there, ranks[at], NEVER), formed[at]

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """:meth:`encode_chunk` of many chunks of one length at once: each row of a matrix is a chunk's agenda."""
        rows = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4").reshape(len(chunks), -1)
        points, inverse = np.unique(rows, return_inverse=True)
        symbols = np.array([self._symbol(chr(p)) for p in points.tolist()], dtype=np.int64)[inverse].reshape(rows.shape)
        ranks, formed = self._rank(symbols[:, :-1], symbols[:, 1:])
        results: list[list[int]] = [[]] * len(chunks)
        number = np.arange(len(chunks))
        while len(number):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(number), dtype=np.int64)
            every = np.arange(len(number))
            going = ranks[every, best] != NEVER if ranks.shape[1] else np.zeros(len(number), dtype=bool)
            if not going.all():
                for k, row in zip(number[~going].tolist(), symbols[~going].tolist(), strict=True):
                    results[k] = row
                number, symbols, ranks, formed, best = number[going], symbols[going], ranks[going], formed[going], best[going]
                every = every[: len(number)]
                if not len(number):
                    break
            # the best pair becomes one symbol; what stands behind it moves up
            symbols[every, best] = formed[every, best]
            behind = np.arange(symbols.shape[1] - 1)
            behind = behind + (behind > best[:, None])
            symbols = np.take_along_axis(symbols, behind, axis=1)
            keep = np.arange(ranks.shape[1] - 1)
            keep = keep + (keep >= best[:, None])
            ranks, formed = np.take_along_axis(ranks, keep, axis=1), np.take_along_axis(formed, keep, axis=1)
            for place in (best - 1, best):
                some = np.flatnonzero((place >= 0) & (place < ranks.shape[1]))
                ranks[some, place[some]], formed[some, place[some]] = self._rank(symbols[some, place[some]], symbols[some, place[some] + 1])
        limit = len(self.surfaces)
        if (symbols_of := points[[s >= limit for s in map(self._symbol, map(chr, points.tolist()))]]).size:
            for k in np.flatnonzero(np.isin(rows, symbols_of).any(axis=1)).tolist():
                results[k] = [i for s in results[k] for i in ([s] if s < limit else self.fallback(chr(s - limit)))]
        return results

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding put first goes, bytes that form no character are marked."""
        data = b"".join(map(self.surfaces.__getitem__, ids))
        text = data.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class PieceEncoder:
    """Encodes batches of texts, each distinct chunk once, and checks new chunks against the library."""

    CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def __init__(self, model: PieceModel, check: bool = True) -> None:
        self.model, self.check, self.known, self.older = model, check, {}, {}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        split = [self.CHUNKS.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        known, fresh = self.known, {}
        for chunks in split:
            for chunk in chunks:
                if chunk not in known:
                    fresh[chunk] = b""
        for chunk in list(fresh):
            if chunk in self.older:
                known[chunk] = self.older[chunk]
                del fresh[chunk]
        self._encode_new(fresh)
        begin, end = u32([self.model.begin]), u32([self.model.end])
        known.update(fresh)
        results = [b"".join([begin, *map(known.__getitem__, chunks), end]) for chunks in split]
        # long chunks are not kept; of the others two generations
        for chunk in fresh:
            if len(chunk) > CACHED_LENGTH:
                del known[chunk]
        if len(known) > CACHED_CHUNKS:
            self.known, self.older = {}, known
        return results

    def _encode_new(self, fresh: dict[str, bytes]) -> None:
        model, by_length = self.model, {}
        for chunk in fresh:
            by_length.setdefault(len(chunk), []).append(chunk)
        for length, chunks in by_length.items():
            many = model.encode_chunks(chunks) if length <= CACHED_LENGTH else map(model.encode_chunk, chunks)
            for chunk, ids in zip(chunks, many, strict=True):
                fresh[chunk] = ids
        if self.check and fresh:
            theirs = model.library.encode([c[1:].replace(MARK, " ") for c in fresh], num_threads=1)
            for (chunk, ids), other in zip(fresh.items(), theirs, strict=True):
                # a chunk of one mark is the prefix alone, which the library gives no empty text
                if ids != other and chunk != MARK:
                    raise ValueError(f"the library encodes {chunk!r} otherwise")
        for chunk, ids in fresh.items():
            fresh[chunk] = u32(ids)


@cache
def _encoder(path: str) -> PieceEncoder:
    """One for each worker process, so that later tasks know the chunks of earlier ones."""
    return PieceEncoder(PieceModel(path))


def encode_pieces(documents: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit integers, with begin and end; decoded string).

    Whole texts; a null text is an empty one, which has the begin and end ids only. Repeated rows are answered each, a
    null doc_id stays null, other columns are not read. Chunks kept for reuse are bounded in number and length; longer
    chunks are encoded where they occur. The file of the model must exist on every executor.
    """
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path)
        for keys, texts in text_batches(batches):
            for k in range(0, len(texts), 500):
                ids = encoder.encode_batch(texts[k : k + 500])
                decoded = [encoder.model.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]
                yield table_of(out, keys.slice(k, 500).cast(pa.int64()), ids, decoded)

    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, ids binary, decoded string")


def piece_digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of :func:`encode_pieces`."""
    return encoded.selectExpr("doc_id", "cast(octet_length(ids) div 4 as bigint) as n_tokens", "sha2(ids, 256) as ids_sha256", "sha2(cast(decoded as binary), 256) as decoded_sha256")
