"""Removal of repeated passages with phrase automata.

A window is 35 consecutive words. Its anchor is the run of eight words in it with the smallest hash, the leftmost of
equal ones, so equal windows have equal anchors at equal places. Windows of a document with one anchor form a segment;
only its hashes travel.

1. Segments whose anchor occurs once hold no repeated window. Of the others, equal segments are counted; where one
   anchor has segments that differ, their windows are counted one by one. What occurs twice or more is confirmed, and
   one occurrence's text is cut out: a phrase, whose windows all recur.
2. Documents are dealt to shards of bounded size. A shard gets the phrases of the segments that its documents hold, and
   compiles their cores (the words that all windows of a phrase share) into an Aho-Corasick automaton.
3. The shard's documents stream through its automaton; around each core found the whole phrase is compared, and the
   words of all phrases found are removed.

A passage that half of all documents share is one row for each shard, whatever the number of documents.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import materialize, table_of, text_batches

WINDOW = 35
ANCHOR = 8  # words
CLASS = 16  # bytes of a digest that tell texts apart
SHARD = 2_000_000  # bytes of documents, about
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)
NONE_LEFT = hashlib.sha256(b"").hexdigest()


def words_of(text: str) -> list[bytes]:
    """Runs of bytes other than ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split()


class _WordHashes(dict):
    """Hashes of words, those met lately kept; any process gives the same."""

    KEPT = 1 << 20

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.KEPT:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_ODD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


class Runs:
    """Hashes of any runs of a text's words."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
        powers = np.full(len(words), _ODD, dtype=np.uint64)
        self.back = np.full(len(words) + 1, _BACK, dtype=np.uint64)
        if len(words):
            powers[0] = 1
        self.back[0] = 1
        self.back = np.multiply.accumulate(self.back)
        self.sums = np.append(np.uint64(0), np.add.accumulate(_mixed(self.words) * np.multiply.accumulate(powers)))

    def of(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        values = (self.sums[ends] - self.sums[begins]) * self.back[begins]
        return _mixed(values + (ends - begins).astype(np.uint64)).view(np.int64)

    def grams(self, length: int) -> np.ndarray:
        begins = np.arange(len(self.words) - length + 1)
        return self.of(begins, begins + length)


def segments(runs: Runs, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, hash of the segment's words, first window, last window) of each segment, in text order."""
    count = len(runs.words) - window + 1
    if count < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    length = min(ANCHOR, window)
    grams = runs.grams(length)
    choices = np.lib.stride_tricks.sliding_window_view(grams, window - length + 1)
    places = np.arange(count) + choices.argmin(axis=1)
    first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    last = np.append(first[1:], count) - 1
    return grams[places[first]], runs.of(first, last + window), first, last


def segment_table(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, class, n_words, n_bytes, sha256, segments array<struct<anchor, hash, first, last>>) of every row; null text: no words.

    Texts of one class have the same words: it is the head of their digest, 128 bits.
    """
    parts = [("anchor", pa.int64()), ("hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]
    out = pa.schema([("doc_id", pa.int64()), ("class", pa.binary()), ("n_words", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.binary()), ("segments", pa.list_(pa.struct(parts)))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            for begin in range(0, len(texts), 1000):
                digests, n_words, n_bytes, found = [], [], [], []
                for text in texts[begin : begin + 1000]:
                    words = words_of(text)
                    joined = b" ".join(words)
                    digests.append(hashlib.sha256(joined).digest())
                    n_words.append(len(words))
                    n_bytes.append(len(joined))
                    found.append(segments(Runs(words), window))
                offsets = np.cumsum([0, *[len(f[0]) for f in found]]).astype(np.int32)
                flat = [pa.array(np.concatenate([f[k] for f in found]).astype(t.to_pandas_dtype()), t) for k, (_, t) in enumerate(parts)]
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, names=[n for n, _ in parts]))
                yield table_of(out, ids.slice(begin, 1000).cast(pa.int64()), [d[:CLASS] for d in digests], n_words, n_bytes, digests, lists)

    struct = "array<struct<anchor:bigint,hash:bigint,first:int,last:int>>"
    return documents.select("doc_id", "text").mapInArrow(read, f"doc_id bigint, class binary, n_words bigint, n_bytes bigint, sha256 binary, segments {struct}")


def _with_class(documents: DataFrame) -> DataFrame:
    """(doc_id, class, n_words, packed): the class computed anew, and the words between single blanks, compressed for the way."""
    out = pa.schema([("doc_id", pa.int64()), ("class", pa.binary()), ("n_words", pa.int64()), ("packed", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for ids, texts in text_batches(batches):
            for begin in range(0, len(texts), 1000):
                words = list(map(words_of, texts[begin : begin + 1000]))
                joined = [b" ".join(w) for w in words]
                classes = [hashlib.sha256(t).digest()[:CLASS] for t in joined]
                yield table_of(out, ids.slice(begin, 1000).cast(pa.int64()), classes, list(map(len, words)), list(map(pack, joined)))

    return documents.select("doc_id", "text").mapInArrow(read, "doc_id bigint, class binary, n_words bigint, packed binary")


def _cut(documents: DataFrame, wanted: DataFrame, repeated: DataFrame, window: int) -> DataFrame:
    """(anchor, hash, text, n_windows, windows, occurrences): the wanted segments (class, doc_id, anchor, hash, first, last,
    occurrences, kinds), each cut from one document that holds it, written; with the hashes of its windows where its
    anchor has segments of several kinds.

    ``repeated``: (class, doc_id) of rows that stand in the table more than once; they cut the same twice.
    """
    parts = F.collect_list(F.struct("anchor", "hash", "first", "last", "occurrences", (F.col("kinds") > 1).alias("mixed")))
    asked = wanted.groupBy(F.col("class").alias("_class"), F.col("doc_id").alias("_id")).agg(parts.alias("asked"))
    twice = repeated.select(F.col("class").alias("_again"), F.col("doc_id").alias("_again_id"))
    asked = asked.join(twice, (F.col("_class") == F.col("_again")) & F.col("_id").eqNullSafe(F.col("_again_id")), "left")
    held = _with_class(documents).join(asked, (F.col("class") == F.col("_class")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    out = pa.schema(
        [("anchor", pa.int64()), ("hash", pa.int64()), ("text", pa.string()), ("n_windows", pa.int32()), ("windows", pa.list_(pa.int64())), ("occurrences", pa.int64()), ("again", pa.bool_())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for packed, asked, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, rows = unpack(packed).split(), []
                runs = Runs(words) if any(a["mixed"] for a in asked) else None
                for a in asked:
                    begins = np.arange(a["first"], a["last"] + 1)
                    phrase = b" ".join(words[a["first"] : a["last"] + window]).decode("utf-8", "surrogatepass")
                    rows.append((a["anchor"], a["hash"], phrase, len(begins), runs.of(begins, begins + window) if a["mixed"] else None, a["occurrences"], again))
                for begin in range(0, len(rows), 4096):
                    yield table_of(out, *zip(*rows[begin : begin + 4096], strict=True))

    cutting = held.select("packed", "asked", F.col("_again").isNotNull().alias("again"))
    names = "anchor bigint, hash bigint, text string, n_windows int, windows array<bigint>, occurrences bigint, again boolean"
    written = materialize(cutting.mapInArrow(cut, names))
    return written.filter("not again").unionByName(written.filter("again").dropDuplicates(["anchor", "hash"])).drop("again")


def confirmed_phrases(documents: DataFrame, live: DataFrame, repeated: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, hash, text, stretches): segments that hold windows of two or more occurrences; stretches are the first and
    last such window of each run of them.

    ``live``: (doc_id, class, anchor, hash, first, last) of all segments whose anchor occurs twice or more.
    """
    one = F.min(F.struct("class", "doc_id", "first", "last"))
    counted = materialize(live.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("occurrences"), one.alias("one")))
    kinds = counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    told = counted.join(kinds, "anchor").select("anchor", "hash", "occurrences", "kinds", "one.*")
    cut = _cut(documents, told, repeated, window)
    # segments of two or more occurrences recur as a whole; in the others, windows that segments of the same anchor share
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("n_windows") - 1).alias("b")))
    windows = cut.filter("windows is not null").select("anchor", "hash", "occurrences", F.posexplode("windows").alias("place", "window"))
    recurring = windows.groupBy("anchor", "window").agg(F.sum("occurrences").alias("_n")).filter("_n > 1").drop("_n")
    places = windows.filter("occurrences = 1").join(recurring, ["anchor", "window"]).groupBy("anchor", "hash").agg(F.sort_array(F.collect_set("place")).alias("places"))
    # a run begins where the window before does not recur, and ends where the next one does not
    begins = F.filter("places", lambda p: ~F.array_contains("places", p - 1))
    ends = F.filter("places", lambda p: ~F.array_contains("places", p + 1))
    some = materialize(places.select("anchor", "hash", F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("some")))
    stretches = F.when(F.col("occurrences") > 1, whole).otherwise(F.col("some")).alias("stretches")
    return cut.join(some, ["anchor", "hash"], "left").select("anchor", "hash", "text", stretches).filter("stretches is not null")


class PhraseAutomaton:
    """Finds all occurrences of phrases, as runs of whole words.

    A phrase with a core shorter than itself is found by its core; equal cores are one entry.
    """

    def __init__(self, phrases: dict[str, tuple[int, int]]) -> None:
        """``phrases``: words between single blanks with the first and the last word (exclusive) of the core."""
        cores = defaultdict(list)
        for phrase, (first, last) in phrases.items():
            words = phrase.split(" ")
            core = f" {' '.join(words[first:last])} "
            cores[core].append((f" {phrase} ", len(" ".join(words[:first])) + (first > 0)))
        self.automaton = ahocorasick.Automaton()
        for core, held in cores.items():
            self.automaton.add_word(core, (len(core), held))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(begin, end) of all occurrences in " word word ", merged; a span has the blank before each of its words."""
        if not len(self.automaton):
            return []
        found = set()
        for end, (length, held) in self.automaton.iter(text):
            core = end - length + 1
            for phrase, before in held:
                if text.startswith(phrase, core - before) and core >= before:
                    found.add((core - before, core - before + len(phrase) - 1))
        merged: list[tuple[int, int]] = []
        for begin, end in sorted(found):
            if merged and begin <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((begin, end))
        return merged


def without_spans(text: str, spans: list[tuple[int, int]]) -> tuple[int, str]:
    """(words removed, words kept between single blanks) of " word word "."""
    kept, at, removed = [], 0, 0
    for begin, end in spans:
        kept.append(text[at:begin])
        removed += text.count(" ", begin, end)
        at = end
    kept.append(text[at : len(text) - 1])
    return removed, "".join(kept)[1:]


def _located(texts: DataFrame, phrases: DataFrame, window: int) -> DataFrame:
    """(class, n_removed, kept, kept_sha256) of the texts (shard, class, packed) in which phrases (shard, text, stretches) occur."""
    out = pa.schema([("class", pa.binary()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])

    def locate(key: tuple[pa.Scalar, ...], documents: pa.Table, phrases: pa.Table) -> pa.Table:
        compiled = {}
        for text, stretches in zip(phrases["phrase"].to_pylist(), phrases["stretches"].to_pylist(), strict=True):
            words = text.split(" ")
            for s in stretches:  # windows a to b share the words from the last one's first to the first one's last
                compiled[" ".join(words[s["a"] : s["b"] + window])] = (s["b"] - s["a"], window)
        rows, unpack = [], zstandard.ZstdDecompressor().decompress
        if compiled:
            automaton = PhraseAutomaton(compiled)
            for name, packed in zip(documents["class"].to_pylist(), documents["packed"].to_pylist(), strict=True):
                padded = f" {unpack(packed).decode('utf-8', 'surrogatepass')} "
                spans = automaton.spans(padded)
                if spans:
                    removed, kept = without_spans(padded, spans)
                    rows.append((name, removed, kept, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
        return pa.Table.from_batches([table_of(out, *(zip(*rows, strict=True) if rows else ([], [], [], [])))], schema=out)

    pieces = phrases.select("shard", F.col("text").alias("phrase"), "stretches")
    return texts.groupBy("shard").cogroup(pieces.groupBy("shard")).applyInArrow(locate, "class binary, n_removed bigint, kept string, kept_sha256 string")


def remove_repeated_passages(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) of every row: its words outside all repeated windows.

    Words are runs of characters other than ASCII white space; ``kept`` has them between single blanks and is null where
    nothing goes; its digest then is that of all words. Null texts, texts
    without words and those of fewer than ``window`` words lose nothing; of rows with the same words, each of ``window``
    or more, all words go, as every window stands in the others too. Overlapping occurrences in one document count as
    two. Null doc_ids stay null; ties need no order, as windows are judged on the input alone. An empty table gives an
    empty one; other columns play no part.
    """
    read = materialize(segment_table(documents, window))
    copies = read.filter(F.col("n_words") >= window).groupBy("class").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select("class")
    copies = materialize(copies)
    size = read.agg(F.sum("n_bytes")).first()[0] or 0
    shard = F.pmod(F.xxhash64("class"), F.lit(max(1, -(-size // SHARD)))).alias("shard")
    every = read.select("doc_id", "class", F.inline("segments"))
    anchors = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("anchor")
    # written, so that the join's sides are plain shuffles and a hot anchor can be split
    live = materialize(every.join(materialize(anchors), "anchor", "left_semi"))
    repeated = read.groupBy("class", "doc_id").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    phrases = confirmed_phrases(documents, live, repeated, window)
    # copies lose all their words anyhow; the others meet the phrases of their own segments
    places = live.join(copies, "class", "left_anti").select(shard, "anchor", "hash").distinct()
    pieces = places.join(phrases, ["anchor", "hash"]).select("shard", "text", "stretches")
    long = _with_class(documents).filter(F.col("n_words") >= window).join(copies, "class", "left_anti").select(shard, "class", "packed")
    located = _located(long, pieces, window)
    gone = copies.select("class", F.lit(None).cast("bigint").alias("n_removed"), F.lit("").alias("kept"), F.lit(NONE_LEFT).alias("kept_sha256"))
    changed = materialize(located.unionByName(gone))
    own = read.select("doc_id", "class", "n_words", "sha256").join(changed.withColumn("_found", F.lit(True)), "class", "left")
    removed = F.when(F.col("_found"), F.coalesce("n_removed", "n_words")).otherwise(F.lit(0).cast("bigint"))
    return own.select("doc_id", "n_words", removed.alias("n_removed"), "kept", F.coalesce("kept_sha256", F.lower(F.hex("sha256"))).alias("kept_sha256"))


SQL = rf"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS MATERIALIZED (
  SELECT row_id, p, sha256(array_to_string(words[p:p + {WINDOW - 1}], ' ')) AS key FROM (SELECT row_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS p FROM texts)
), recurring AS (
  SELECT row_id, p FROM windows WHERE key IN (SELECT key FROM windows GROUP BY key HAVING count(*) > 1)
), covered AS MATERIALIZED (
  SELECT DISTINCT row_id, unnest(range(p, p + {WINDOW})) AS place FROM recurring
), gone AS MATERIALIZED (
  SELECT row_id, count(*) AS n FROM covered GROUP BY row_id
), stay AS MATERIALIZED (
  SELECT row_id, string_agg(word, ' ' ORDER BY place) AS kept
  FROM (SELECT row_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts WHERE row_id IN (SELECT row_id FROM gone)) w
  ANTI JOIN covered USING (row_id, place) GROUP BY row_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed,
  sha256(CASE WHEN g.n IS NULL THEN array_to_string(words, ' ') ELSE coalesce(s.kept, '') END) AS kept_sha256
FROM texts LEFT JOIN gone g USING (row_id) LEFT JOIN stay s USING (row_id)
"""
