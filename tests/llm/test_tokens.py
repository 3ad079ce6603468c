"""Encoding operators against their libraries, the wavelet matrix against arrays, packing against its rules."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packetloom.llm import chunked_tokens, pattern_packing, piece_bpe, wavelet_shards
from packetloom.llm.chunked_tokens import stretch_encoder
from packetloom.llm.common import new_path
from packetloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, " "), (None, "no id"), (4, "same"), (4, "same"), (5, "日本語 テスト🙂 \x00 ▁ <s>"), (6, "word " * 30_000), (7, "x" * 5000), (8, "\n\n a\t\tb \r\n")]


def u32(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def pieces():
    return piece_bpe.PieceEncoder(piece_bpe.PieceModel(PIECES))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁abetohir\n<0>s"), st.characters(codec="utf-8")), max_size=60))
def test_pieces_are_those_of_the_library(pieces, text):
    ids = np.frombuffer(pieces.encode_batch([text])[0], "<u4").tolist()
    assert ids == pieces.model.library.encode(text, add_bos=True, add_eos=True)
    assert pieces.model.decode(ids) == pieces.model.library.decode(ids)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="▁thein ando", min_size=1, max_size=30))
def test_agenda_and_matrix_merge_alike(pieces, text):
    chunk = text.replace(" ", "▁")
    assert pieces.model.encode_chunks([chunk, chunk]) == [pieces.model.encode_chunk(chunk)] * 2


def test_piece_query(spark, documents, clashing):
    frame = clashing(documents(ODD))
    got = sorted(map(tuple, piece_bpe.piece_digests(piece_bpe.encode_pieces(frame, PIECES)).collect()), key=repr)
    library = piece_bpe.PieceModel(PIECES).library
    want = []
    for key, text in ODD:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((key, len(ids), hashlib.sha256(u32(ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert piece_bpe.encode_pieces(documents([]), PIECES).count() == 0


def test_piece_query_on_a_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library = piece_bpe.PieceModel(PIECES).library
    for r in QUERIES["op4_piece_bpe"](spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(u32(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@pytest.fixture(scope="module", params=[(BYTES, True), (WORDS, False)])
def stretches(request):
    return stretch_encoder(*request.param)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x1c\x85\xa0 ab'sé́Σ1!<|endoftext|>"), st.characters(codec="utf-8")), max_size=50))
def test_stretches_give_the_ids_of_whole_texts(stretches, text):
    assert np.frombuffer(stretches.encode_batch([text])[0], "<u4").tolist() == stretches.library.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_texts_are_as_the_library_has_them(stretches):
    """The library as it is, read from its file anew."""
    from tokenizers import Tokenizer

    path = next(p for p, spaces in ((BYTES, True), (WORDS, False)) if spaces == stretches.spaces)
    library = Tokenizer.from_file(path)
    texts = ["<|endoftext|>", "a <|endoftext|> b <|startoftext|>", "plain", "", " <|startoftext|>\n", "x<|endoftext|>y z", "  two  blanks "]
    assert [np.frombuffer(i, "<u4").tolist() for i in stretches.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_stretches_are_looked_up_again_after_many(monkeypatch):
    monkeypatch.setattr(chunked_tokens, "CACHED_STRETCHES", 20)
    monkeypatch.setattr(chunked_tokens, "SLICE", 7)
    for path, spaces in ((BYTES, True), (WORDS, False)):
        encoder = chunked_tokens.StretchEncoder(path, spaces)
        for k in range(12):
            texts = [" ".join(f"w{(k * j) % 40}" for j in range(30)), "", f"one{k}"]
            assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode_batch(texts)] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**20), max_size=1500), st.data())
def test_wavelet_matrix_answers_as_the_array(values, data):
    x = np.array(values, dtype=np.uint32)
    matrix = wavelet_shards.WaveletMatrix.from_bytes(wavelet_shards.WaveletMatrix.of(x).to_bytes())
    assert (matrix.values() == x).all()
    if values:
        places = data.draw(st.lists(st.integers(0, len(values) - 1), max_size=5))
        assert (matrix.access(places) == x[places]).all()
        value, end = data.draw(st.sampled_from(values)), data.draw(st.integers(0, len(values)))
        assert matrix.rank(value, end) == values[:end].count(value)
        assert matrix.places(value).tolist() == [k for k, v in enumerate(values) if v == value]
        assert matrix.rank(2**20 + 1) == 0
        with pytest.raises(IndexError):
            matrix.select(value, values.count(value))


def shard_rows(spark, frame, tokens_a_shard):
    path = new_path(spark)
    wavelet_shards.write_shards(frame, BYTES, path, tokens_a_shard)
    return wavelet_shards.read_shards(spark, path).collect(), spark.read.parquet(path).count()


def test_shards_hold_all_documents_in_order(spark, documents, clashing):
    rows, shards = shard_rows(spark, clashing(documents(ODD)), 50)
    library = Tokenizer.from_file(BYTES)
    ids = [(k, library.encode(t or "", add_special_tokens=False).ids + [0]) for k, t in ODD]
    ids.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for key, some in ids:
        want.append((key, start, len(some), zlib.crc32(u32(some))))
        start += len(some)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert shards > 1
    assert shard_rows(spark, documents([]), 50)[0] == []


def test_shards_answer_without_being_unpacked(spark, documents, monkeypatch):
    """Single tokens, counts and occurrences against the array, over several ranges and shards; repeated ids over ranges."""
    monkeypatch.setattr(wavelet_shards, "RANGE_BYTES", 20_000)
    rows = [(k // 3, f"word{k % 50} the the end {k}" * (k % 9)) for k in range(900)]
    path, library = new_path(spark), Tokenizer.from_file(BYTES)
    wavelet_shards.write_shards(documents(rows), BYTES, path, 700)
    shards = spark.read.parquet(path)
    assert shards.select("part").distinct().count() > 3 and shards.count() > 20
    order = sorted((r.part, r.shard, k, r) for k, r in enumerate(shards.collect()))
    flat = [(key, offset, token) for *_, r in order for key, ids in _documents_of(r) for offset, token in enumerate(ids)]
    assert sorted(Counter(key for key, *_ in flat).items()) == sorted(sum((Counter({k: len(library.encode(t, add_special_tokens=False).ids) + 1}) for k, t in rows), Counter()).items())
    asked = [0, 5, 5, 701, len(flat) // 2, len(flat) - 1, len(flat), -1]
    found = wavelet_shards.tokens_at(spark, path, spark.createDataFrame([(p,) for p in asked], "position long")).collect()
    assert sorted(map(tuple, found)) == sorted((p, flat[p][2]) for p in set(asked) if 0 <= p < len(flat))
    the = library.encode(" the", add_special_tokens=False).ids[0]
    counts = {r.token: r.n for r in wavelet_shards.token_counts(spark, path, [the, 0, 49_999]).collect()}
    want = Counter(token for *_, token in flat)
    assert counts == {the: want[the], 0: want[0], 49_999: want[49_999]}
    places = wavelet_shards.token_occurrences(spark, path, the).collect()
    assert Counter(map(tuple, places)) == Counter((key, offset) for key, offset, token in flat if token == the)


def test_one_token_takes_one_chunk_a_plane():
    values = np.random.default_rng(8).integers(0, 50_000, 5 * wavelet_shards.CHUNK)
    matrix = wavelet_shards.WaveletMatrix.from_bytes(wavelet_shards.WaveletMatrix.of(values).to_bytes())
    assert matrix.access([77])[0] == values[77] and len(matrix.met) == matrix.width
    assert matrix.rank(int(values[77])) == (values == values[77]).sum() and len(matrix.met) <= 3 * matrix.width


def _documents_of(row):
    ids, at = wavelet_shards.WaveletMatrix.from_bytes(bytes(row.block)).values().tolist(), 0
    for key, n in zip(row.doc_ids, row.lengths, strict=True):
        yield key, ids[at : at + n]
        at += n


def test_shard_query_on_a_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library, start = Tokenizer.from_file(BYTES), 0
    rows = {r.doc_id: r for r in QUERIES["op8_wavelet_shards"](spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for key in sorted(texts):
        ids = library.encode(texts[key], add_special_tokens=False).ids + [0]
        assert tuple(rows[key]) == (key, start, len(ids), zlib.crc32(u32(ids)))
        start += len(ids)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 128), st.integers(0, 40), max_size=30))
def test_plan_holds_every_length_once(counts):
    plan = pattern_packing.plan_packing(counts, 128, grain=8, fillers=16)
    held = Counter()
    for lengths, repeat in plan:
        assert repeat > 0 and sum(lengths) <= 128
        for n in lengths:
            held[n] += repeat
    assert held == Counter({n: c for n, c in counts.items() if c})
    # never more than first-fit by pairs would allow: two sequences are never both half empty
    half = sum(r for lengths, r in plan if sum(lengths) <= 64)
    assert half <= 1


def test_fit_is_the_least_squares_one_without_negative_counts():
    patterns = np.array([[1.0, 0, 1], [0, 2, 1]])
    assert np.allclose(patterns @ pattern_packing.fitted(np.array([5.0, 9]), patterns), [5, 9])
    one = pattern_packing.fitted(np.array([4.0, -4]), np.array([[1.0, 0], [0, 1]]))
    assert np.allclose(one, [4, 0])


def check_packing(rows, texts, limit=2048):
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for key, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), limit)):
            part = ids[start : start + limit]
            want[key, piece, start, len(part), zlib.crc32(u32(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences), -(-sum(r.length for r in rows) // limit)


def test_packing_of_odd_documents(spark, documents, clashing):
    rows = pattern_packing.pack_documents(clashing(documents(ODD)), WORDS).collect()
    check_packing(rows, ODD)
    assert pattern_packing.pack_documents(documents([]), WORDS).collect() == []


def test_packing_query_is_near_the_least_possible(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used, least = check_packing(QUERIES["op9_pattern_packing"](spark, SF).collect(), texts)
    assert used <= least + 1


def test_many_pieces_of_one_length(spark):
    pieces = spark.range(3000).select(F.lit(7).cast("bigint").alias("length"), F.col("id").alias("k"), F.lit(1).alias("offset"))
    rows = pattern_packing.pack_pieces(pieces, 16).collect()
    assert Counter(Counter(r.sequence_id for r in rows).values()) == {2: 1500}
    assert {r["offset"] for r in rows} == {0, 7}
