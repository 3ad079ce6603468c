"""Near-duplicate groups by Order MinHash, verified by banded alignment.

A text's k-mers are its runs of five words, labelled by their occurrence number. A sketch is, for each of several hash
functions, the few k-mers with the smallest values, in text order; so texts meet in a bucket if they share such k-mers
in the same order. Texts of few k-mers also meet in the buckets of their rarest k-mers, so that no similar pair of them
is missed. Bucket members are aligned in a band: aligned k-mers over all k-mers of both is the similarity. Before that,
only pairs go that cannot reach it by their lengths or by the k-mers that they do not share.

Groups are the components of "similarity of 0.8 or more" among texts that share a bucket. Texts are first compared with
one centre of each of their buckets; after that, only with those bucket members that are still in another component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import materialize, table_of, unwrapped, wrapped

WORDS = 5
SIMILARITY = 0.8
PICKED = 5  # k-mers in one sketch; at similarity 0.8 a pair has the same with probability 0.8**5
SKETCHES = 36  # sketches of a text, each a bucket: two long texts at 0.8 without repeats miss all with probability of about 1e-6
FEW = 80  # k-mers up to which texts also meet by their rarest k-mers
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * _MORE
    return x ^ (x >> np.uint64(32))


def kmers(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of the runs of ``words`` words (lower case, between ASCII white space); of a shorter text the one of all its words."""
    parts = text.lower().encode("utf-8", "surrogatepass").split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p) for p in parts), dtype=np.uint64, count=len(parts))
    width = min(words, len(parts))
    runs = np.zeros(len(parts) - width + 1, dtype=np.uint64)
    for k in range(width):
        runs = runs * _MORE + hashes[k : len(hashes) - width + 1 + k]
    return _mixed(runs + np.uint64(width))


def labelled(runs: np.ndarray) -> np.ndarray:
    """The k-mers told apart by how often each has occurred before."""
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(runs) else np.zeros(0, int)
    if len(first) == len(runs):
        return runs
    number = np.arange(len(runs)) - np.repeat(first, np.diff(np.append(first, len(runs))))
    labels = np.empty(len(runs), dtype=np.uint64)
    labels[order] = number.astype(np.uint64)
    return np.where(labels > 0, _mixed(runs ^ (labels * _ODD)), runs)


def order_sketch(keys: np.ndarray, sketches: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """One bucket number for each hash function: of its ``picked`` smallest k-mers, in text order."""
    seeds = _mixed(np.arange(1, sketches + 1, dtype=np.uint64))
    found = np.empty(sketches, dtype=np.uint64)
    step = max(1, (1 << 20) // max(len(keys), 1))
    for k in range(0, sketches, step):
        some = seeds[k : k + step]
        values = (keys[None, :] ^ some[:, None]) * _ODD
        values ^= values >> np.uint64(32)
        values *= _MORE
        if len(keys) > picked:
            places = np.sort(np.argpartition(values, picked - 1, axis=1)[:, :picked], axis=1)
        else:
            places = np.broadcast_to(np.arange(len(keys)), (len(some), len(keys)))
        total = some.copy()
        for column in range(places.shape[1]):
            total = total * _MORE + keys[places[:, column]]
        found[k : k + step] = _mixed(total)
    return found


def parities(keys: np.ndarray) -> np.ndarray:
    """Whether the number of k-mers at each place is odd, as bits; the place is the head of the k-mer's hash.

    A k-mer that two texts share changes both alike, so at least as many k-mers as bits differ are in one of them only.
    """
    head = 11 if len(keys) <= 2000 else 13
    odd = np.bincount((keys >> np.uint64(64 - head)).astype(np.int64), minlength=1 << head) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence within ``band`` places of the diagonal; a row of bits at a time."""
    same = int(min(len(a), len(b)))
    head = int(np.argmin(np.append(a[:same] == b[:same], False)))
    a, b = a[head:], b[head:]
    same = int(min(len(a), len(b)))
    tail = int(np.argmin(np.append(a[len(a) - same :][::-1] == b[len(b) - same :][::-1], False)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    where: dict[int, list[int]] = {}
    for place, value in enumerate(b.tolist()):
        where.setdefault(value, []).append(place)
    # bit j of the row is place low + j of b; a zero is one more aligned k-mer up to there
    width, settled, low = 2 * band + 1, 0, -band
    row, full = (1 << width) - 1, (1 << width) - 1
    for value in a.tolist():
        match = 0
        for place in where.get(value, ()):
            if low <= place < low + width:
                match |= 1 << (place - low)
        if match:
            row = ((row + (row & match)) | (row & ~match)) & full
        settled += not row & 1
        row = row >> 1 | 1 << (width - 1)
        low += 1
    return head + tail + settled + width - row.bit_count()


def similarity_reaches(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether aligned k-mers are at least this share of the k-mers of both texts together."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return False
    shared = len(np.intersect1d(labelled(a), labelled(b), assume_unique=True))
    if shared < least * (n + m - shared):  # no alignment has more than the texts share
        return False
    band = int((n + m) * (1 - least) / (1 + least)) + 1  # more gaps would be too dissimilar
    length = aligned(a, b, band)
    return length >= least * (n + m - length)


def sketched(documents: DataFrame) -> DataFrame:
    """(doc_id, content, text_class, n, buckets, odd, few): a hash of the text, one of the words, the number of k-mers, the
    sketch, the k-mers' parities, few k-mers themselves. Without words the class is null.
    """
    lists = [(name, pa.list_(pa.int64())) for name in ("buckets", "odd", "few")]
    out = pa.schema([("doc_id", pa.int64()), ("content", pa.int64()), ("text_class", pa.int64()), ("n", pa.int32()), *lists])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, contents = batch.column(0), [t or "" for t in batch.column(1).to_pylist()], batch.column(2)
            for begin in range(0, len(texts), 1000):
                classes, counts, buckets, odd, few = [], [], [], [], []
                for text in texts[begin : begin + 1000]:
                    runs = kmers(text)
                    classes.append(class_of(text) if len(runs) else None)
                    counts.append(len(runs))
                    keys = labelled(runs)
                    buckets.append(order_sketch(keys).view(np.int64) if len(runs) else [])
                    odd.append(parities(keys) if len(runs) else [])
                    few.append(keys.view(np.int64) if len(runs) <= FEW else [])
                yield table_of(out, ids.slice(begin, 1000).cast(pa.int64()), contents.slice(begin, 1000), classes, counts, buckets, odd, few)

    hashed = documents.select("doc_id", "text", F.xxhash64("text").alias("content"))
    return hashed.mapInArrow(sketch, "doc_id bigint, content bigint, text_class bigint, n int, buckets array<bigint>, odd array<bigint>, few array<bigint>")


def _rarest(nodes: DataFrame) -> DataFrame:
    """(text_class, rare): those of the rarest k-mers of each text of few k-mers that other such texts have too.

    Similar texts share SIMILARITY of either one's k-mers. In one order of all k-mers, the first of the shared ones is
    then among the first (1 - SIMILARITY) of each text's, and one more; so both texts have it in ``rare``.
    """
    kmers = nodes.select("text_class", "n", F.explode("few").alias("kmer"))
    owners = kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("owners"))
    ordered = kmers.join(owners, "kmer").groupBy("text_class", "n").agg(F.sort_array(F.collect_list(F.struct("owners", "kmer"))).alias("_all"))
    head = F.slice("_all", F.lit(1), (F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-9) + 1).cast("int"))
    return ordered.select("text_class", F.transform(F.filter(head, lambda k: k["owners"] > 1), lambda k: k["kmer"]).alias("rare"))


def class_of(text: str) -> int:
    """Texts of the same words in the same order have one class."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(text.lower().encode("utf-8", "surrogatepass").split()))).view(np.int64))


def _kmer_table(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text_class, kmers binary) of the wanted (doc_id, text_class)."""
    out = pa.schema([("text_class", pa.int64()), ("kmers", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                rows = zip(batch.column(0).slice(begin, 200).to_pylist(), batch.column(1).slice(begin, 200).to_pylist(), strict=True)
                # rows of one doc_id with other texts are not the wanted ones
                kept = [(c, kmers(t).tobytes()) for c, t in rows if class_of(t) == c]
                if kept:
                    yield table_of(out, *zip(*kept, strict=True))

    joined = documents.select("doc_id", "text").filter(F.col("text").isNotNull()).join(wanted.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
    return joined.select("text_class", "text").mapInArrow(cut, "text_class bigint, kmers binary").dropDuplicates(["text_class"])


def _shared_kmers(grams: DataFrame, classes: DataFrame) -> DataFrame:
    """(text_class, shared): how many k-mers each of the classes has that another of them has too.

    Where many copies of one text are edited each for itself, their own k-mers show that they are too unlike one
    another, before any two of them meet.
    """
    out = pa.schema([("text_class", pa.int64()), ("kmer", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = labelled(np.frombuffer(data.as_buffer(), np.uint64)).view(np.int64)
                yield table_of(out, np.full(len(keys), key), keys)

    held = grams.join(classes, "text_class", "left_semi").select("text_class", "kmers")
    owners = held.mapInArrow(cut, "text_class bigint, kmer bigint").groupBy("kmer").agg(F.count(F.lit(1)).alias("owners"), F.min("text_class").alias("text_class"))
    alone = owners.filter("owners = 1").groupBy("text_class").agg(F.count(F.lit(1)).alias("alone"))
    total = held.select("text_class", (F.octet_length("kmers") / 8).cast("bigint").alias("total"))
    return total.join(alone, "text_class", "left").select("text_class", (F.col("total") - F.coalesce("alone", F.lit(0))).alias("shared"))


def _verified(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    left = grams.select(F.col("text_class").alias("a"), F.col("kmers").alias("x"))
    right = grams.select(F.col("text_class").alias("b"), F.col("kmers").alias("y"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            good = [similarity_reaches(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) for p, q in zip(x, y, strict=True)]
            keep = pa.array(good, pa.bool_())
            yield table_of(out, a.filter(keep), b.filter(keep))

    return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(align, "a bigint, b bigint"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) is linked with, over any number of links.

    Every node follows its smallest neighbour, if that is smaller; the trees that this makes are flattened by jumping
    from parent to grandparent and become one node each; edges inside a tree go. So the edges are read once a round, and
    few are left after the first. Each step is written.
    """
    links, labels = materialize(edges.select("a", "b").filter("a <> b").distinct()), None
    while True:
        both = links.union(links.select("b", "a"))
        roots = _flattened(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
        labels = roots if labels is None else materialize(labels.join(roots.toDF("component", "_root"), "component", "left").select("node", F.coalesce("_root", "component").alias("component")))
        moved = links.join(roots.toDF("a", "x"), "a").join(roots.toDF("b", "y"), "b").filter("x <> y")
        links = materialize(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if links.isEmpty():
            return labels


def _flattened(parents: DataFrame) -> DataFrame:
    """(node, component) with the root of each node in place of its parent."""
    parents = materialize(parents)
    while True:
        above = parents.toDF("component", "_above")
        moved = materialize(parents.join(above, "component").select("node", F.col("_above").alias("new"), "component"))
        parents = moved.select("node", F.col("new").alias("component"))
        if moved.filter("new <> component").isEmpty():
            return parents


def _pairs(candidates: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of candidates (x, y, nx, ny) whose lengths allow the similarity."""
    possible = F.least("nx", "ny") >= SIMILARITY * F.greatest("nx", "ny")
    return candidates.filter((F.col("x") != F.col("y")) & possible).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _within_reach(x: str, y: str) -> Column:
    """False where the numbers and parities of k-mers of both sides show that they share too few, whatever their order."""
    both = F.col(f"n_{x}") + F.col(f"n_{y}")
    differ = F.zip_with(f"odd_{x}", f"odd_{y}", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.when(F.size(f"odd_{x}") == F.size(f"odd_{y}"), F.aggregate(differ, F.lit(0), lambda s, v: s + v)).otherwise(0)
    # at most half of the others are shared, and a pair needs SIMILARITY / (1 + SIMILARITY) of both texts' k-mers aligned
    return (1 + SIMILARITY) * (both - apart) >= 2 * SIMILARITY * both - 1e-6


def _reachable(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) without those that share too few k-mers."""
    left, right = (nodes.select(F.col("text_class").alias(f"_{c}"), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}")) for c in "ab")
    return pairs.join(left, F.col("a") == F.col("_a")).join(right, (F.col("b") == F.col("_b")) & _within_reach("a", "b")).select("a", "b")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, group_id, copy_of, is_first, component, content): the group of every document.

    ``copy_of``: the smallest doc_id with the same words; ``group_id``: the smallest doc_id of all linked texts;
    ``is_first``: whether the row's doc_id is that; ``component``: a number of the group, null for texts without words;
    ``content``: a hash of the text, that tells rows of one doc_id apart. Null texts and those without words are groups of their own; texts of
    fewer than five words are linked if their words are equal; repeated rows share a group; null doc_ids stay null and
    come first only where no other id is. An empty table gives an empty one.

    Copies are one node from the start. A bucket emits one pair for each member, and pairs across components only for
    members outside its commonest component, so a group of alike texts costs its size, not its square.
    """
    sketches = materialize(sketched(documents))
    nodes = materialize(
        sketches.filter("text_class is not null").groupBy("text_class").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("buckets", "odd", "few")])
    )
    buckets = F.when(F.col("rare").isNull(), F.col("buckets")).otherwise(F.concat("buckets", "rare"))
    nodes = materialize(nodes.join(_rarest(nodes), "text_class", "left").select("text_class", "doc_id", "n", buckets.alias("buckets"), "odd"))
    members = nodes.select("text_class", "n", F.explode("buckets").alias("bucket"))
    order = F.xxhash64("text_class")
    centre = F.struct("text_class", "n")
    # the same centre in most buckets of a group of alike texts, so that their pairs are few
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size"), F.min_by(centre, order).alias("centre"))
    shared = shared.filter("_size > 1").drop("_size")
    buckets = materialize(members.join(shared, "bucket"))
    stars = _pairs(buckets.select(F.col("text_class").alias("x"), F.col("n").alias("nx"), F.col("centre.text_class").alias("y"), F.col("centre.n").alias("ny")))
    pairs = materialize(_reachable(stars, nodes))
    wanted = nodes.select("doc_id", "text_class").join(buckets.select("text_class").distinct(), "text_class", "left_semi")
    grams = materialize(_kmer_table(documents, wanted))
    links = _verified(pairs, grams)
    # members whose component is not their bucket's commonest meet all members of other components
    labels = components(links)
    placed = materialize(buckets.select("bucket", "text_class", "n").join(labels.withColumnRenamed("node", "text_class"), "text_class", "left").withColumn("component", F.coalesce("component", "text_class")))
    mixed = placed.groupBy("bucket").agg(F.mode("component", True).alias("common"), F.min("component").alias("_a"), F.max("component").alias("_b")).filter("_a <> _b").select("bucket", "common")
    held = placed.join(mixed, "bucket")
    shared = _shared_kmers(grams, held.select("text_class").distinct())
    held = materialize(held.join(shared, "text_class").join(nodes.select("text_class", "buckets", "odd"), "text_class"))
    names = ["text_class", "n", "shared", "component", "buckets", "odd"]
    others = held.filter("component <> common").select("bucket", *[F.col(c).alias(f"{c}_x") for c in names])
    theirs = held.select(F.col("bucket").alias("_bucket"), *[F.col(c).alias(f"{c}_y") for c in names])
    # aligned k-mers are shared ones, and a pair needs SIMILARITY / (1 + SIMILARITY) of both texts' k-mers aligned
    enough = (1 + SIMILARITY) * F.least("shared_x", "shared_y") >= SIMILARITY * (F.col("n_x") + F.col("n_y")) - 1e-6
    possible = (F.col("component_x") != F.col("component_y")) & (F.least("n_x", "n_y") >= SIMILARITY * F.greatest("n_x", "n_y")) & enough
    # a pair comes out once, from the smallest bucket that it shares
    once = F.array_min(F.array_intersect("buckets_x", "buckets_y")) == F.col("bucket")
    across = others.join(theirs, (F.col("bucket") == F.col("_bucket")) & possible & _within_reach("x", "y") & once)
    named = across.select(*[F.col(f"{c}_{side}").alias(f"{new}{side}") for c, new in (("text_class", ""), ("n", "n")) for side in "xy"])
    rest = _pairs(named).join(pairs, ["a", "b"], "left_anti")
    more = _verified(rest, grams)
    # what the first links connect, each component now says with one link a text
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    groups = components(known.union(more)).withColumnRenamed("node", "text_class")
    named = nodes.select("text_class", "doc_id").join(groups, "text_class", "left").withColumn("component", F.coalesce("component", "text_class"))
    heads = named.groupBy("component").agg(F.min("doc_id").alias("group_id"))
    named = named.join(heads, "component").select("text_class", F.col("doc_id").alias("copy_of"), "group_id", "component")
    rows = sketches.select("doc_id", "content", "text_class").join(named, "text_class", "left")
    own = F.when(F.col("text_class").isNull(), F.col("doc_id"))
    groups = rows.select("doc_id", F.coalesce("group_id", own).alias("group_id"), F.coalesce("copy_of", own).alias("copy_of"), "component", "content")
    return groups.select("doc_id", "group_id", "copy_of", F.col("doc_id").eqNullSafe(F.col("group_id")).alias("is_first"), "component", "content")


def keep_first(documents: DataFrame) -> DataFrame:
    """One row of each group, all columns as they were.

    The one with the smallest doc_id (a null one only where no other is); of several texts under it the one with the
    smallest hash, of equal rows any one. Texts without words stay, each row of them.
    """
    near = materialize(near_duplicates(documents))
    sized = near.filter("is_first and component is not null").groupBy("component", "doc_id", "content").agg(F.count(F.lit(1)).alias("n"))
    chosen = sized.groupBy("component").agg(F.min_by(F.struct("doc_id", "content", "n"), "content").alias("one")).select("one.*")
    chosen = materialize(chosen.select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"), "n"))
    empty = near.filter("component is null").select(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).distinct()
    rows = wrapped(documents).withColumn("_own", F.xxhash64("row.text"))
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_content"))
    single = rows.join(chosen.filter("n = 1").drop("n").unionByName(empty), same, "left_semi").select("row")
    several = rows.join(chosen.filter("n > 1"), same).dropDuplicates(["_id", "_content"]).select("row")
    kept = single.unionByName(several)
    return kept.select(unwrapped(kept))
