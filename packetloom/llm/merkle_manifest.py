"""Merkle manifest of a dataset, and persistent versions of it.

Leaves are digests of rows, in order within their tree; every eight consecutive nodes of a level have one parent. The
tree is built in aligned blocks of 8**4 nodes: one task makes the four levels over a block, and the block's top is a
node of the next, far smaller table. From the top back down every node gets its path: the siblings on the left and on
the right, level by level.

A version is a tree with one leaf changed. It shares all nodes of the old tree but the leaf's ancestors, which are
copied: inside the leaf's own block from the block's nodes, above it along the block's path. So versions need neither
one another nor a shuffle of their own, and stay in the tasks of their blocks up to the root.

The trees of the languages are the leaves of an upper tree, which is built by the same code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import materialize

FAN = 8
LEVELS = 4  # of the tree that one block of FAN**LEVELS nodes spans
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EMPTY = hashlib.sha256(b"").hexdigest()


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """Digest of the fields, each with its number of UTF-8 bytes before it, a null one as "-"."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def levels_of(n: Column) -> Column:
    """Levels above ``n`` nodes in this round: as many as lead to one node, ``LEVELS`` at most."""
    levels = F.lit(0)
    for k in range(LEVELS):
        levels = F.when(n > FAN**k, k + 1).otherwise(levels)
    return levels.cast("int")


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """The nodes with ``pos``, their place in their ``tree`` by ``order``, from 0, and ``n``, the nodes of the tree.

    A range sort puts them in order over all tasks; places are counted from each task's first row of a tree. Rows that
    are equal in all of ``order`` have equal digests, so they may stand in any order and are spread over tasks.
    """
    keys = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order], F.col("_salt")]
    spread = nodes.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(spread.drop("_salt").withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    firsts = placed.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("tree", "_part", "_first", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"), F.sum("_count").over(Window.partitionBy("tree")).alias("n"))
    return placed.join(firsts, ["tree", "_part"]).withColumn("pos", F.col("_start") + F.col("_row") - F.col("_first")).drop("_part", "_row", "_first", "_start", "_count")


def block_levels(leaves: list[str], levels: int) -> list[list[str]]:
    """The levels of a block, from its nodes to its top."""
    found = [leaves]
    for _ in range(levels):
        below = found[-1]
        found.append([digest("".join(below[k : k + FAN])) for k in range(0, len(below), FAN)])
    return found


def path_in_block(levels: list[list[str]], place: int) -> list[str]:
    """Siblings of a node and of its ancestors below the top: those on the left and those on the right, level by level."""
    path = []
    for nodes in levels[:-1]:
        first = place - place % FAN
        path += ["".join(nodes[first:place]), "".join(nodes[place + 1 : first + FAN])]
        place //= FAN
    return path


def copied_path(node: str, path: list[str]) -> list[str]:
    """The ancestors of a changed node along a path, from its parent to the root."""
    copies = []
    for k in range(0, len(path), 2):
        node = digest(path[k] + node + path[k + 1])
        copies.append(node)
    return copies


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {FAN**LEVELS}")).withColumn("levels", levels_of(F.col("n")))


def _tops(nodes: DataFrame) -> DataFrame:
    """The next table of (tree, pos, n, digest): the tops of the blocks."""
    out = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def top(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        levels = block_levels(block["digest"].to_pylist(), block["levels"][0].as_py())
        return pa.table([[key[0].as_py()], [key[1].as_py()], [-(-block["n"][0].as_py() // FAN**LEVELS)], levels[-1]], schema=out)

    return materialize(_blocks(nodes).select("tree", "pos", "n", "digest", "block", "levels").groupBy("tree", "block").applyInArrow(top, "tree string, pos bigint, n bigint, digest string"))


def towers(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, the tops of their blocks, the tops of blocks of those, and so on to the roots of all trees."""
    found = [nodes]
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        found.append(_tops(found[-1]))
        largest = -(-largest // FAN**LEVELS)
        if largest <= 1:
            return found


def _paths_down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, pos, path) of the nodes, from the paths (tree, pos, path) of their blocks' tops."""
    out = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.string()))])

    def lead(key: tuple[pa.Scalar, ...], block: pa.Table, upper: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        levels, rest = block_levels(block["digest"].to_pylist(), block["levels"][0].as_py()), upper["path"][0].as_py()
        return pa.table([block["tree"], block["pos"], [path_in_block(levels, k) + rest for k in range(block.num_rows)]], schema=out)

    blocks = _blocks(nodes).select("tree", "pos", "digest", "block", "levels").groupBy("tree", "block")
    return blocks.cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(lead, "tree string, pos bigint, path array<string>")


def manifest(rows: DataFrame) -> DataFrame:
    """All columns of rows (tree, name, leaf, changed), with subroot, root, proof_sha256, copies and folded_root.

    ``tree`` must not be null; trees are leaves of the upper tree in its order, the leaves of a tree stand in the order of
    (name, leaf). ``copies``: the ancestors that the version with ``changed`` in place of ``leaf`` does not share with the
    tree, from the parent to its root; null where ``changed`` is.
    """
    leaves = materialize(ranked(rows.withColumn("digest", F.col("leaf")), "name", "digest"))
    trees = towers(leaves)
    tops = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    subroots = materialize(ranked(tops, "name", "digest"))
    upper = towers(subroots)
    root = upper[-1].select("tree", F.col("digest").alias("root"))
    # from the root down to the subroots, then on to the tops of the leaves' blocks
    paths = upper[-1].select("tree", "pos", F.array().cast("array<string>").alias("path"))
    for nodes in reversed(upper[:-1]):
        paths = _paths_down(nodes, paths)
    named = subroots.join(paths, ["tree", "pos"]).join(F.broadcast(root), "tree")  # the root is one row
    above = materialize(named.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "path", F.col("digest").alias("subroot"), "root"))
    paths = above.select("tree", "pos", "path")
    for nodes in reversed(trees[1:-1]):
        paths = _paths_down(nodes, paths)
    facts = paths.join(above.select("tree", "subroot", "root"), "tree").withColumnRenamed("pos", "block")
    extra = "subroot string, root string, proof_sha256 string, copies array<string>, folded_root string"
    leaves = _blocks(leaves)
    kept = [f for f in leaves.schema.fields if f.name not in ("digest", "block", "levels", "n", "pos")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + extra
    names = [f.name for f in kept]

    def prove(key: tuple[pa.Scalar, ...], block: pa.Table, upper: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        levels, fact = block_levels(block["digest"].to_pylist(), block["levels"][0].as_py()), upper.to_pylist()[0]
        rest, proofs, copies, folded = "".join(fact["path"]), [], [], []
        for place, changed in enumerate(block["changed"].to_pylist()):
            path = path_in_block(levels, place)
            proofs.append(digest("".join(path) + rest))
            found = copied_path(changed or levels[0][place], path + fact["path"])
            folded.append(found[-1] if found else changed or levels[0][place])
            copies.append(found if changed is not None else None)
        same = [pa.array([fact[c]] * block.num_rows, pa.string()) for c in ("subroot", "root")]
        columns = [*[block[c] for c in names], *same, pa.array(proofs, pa.string()), pa.array(copies, pa.list_(pa.string())), pa.array(folded, pa.string())]
        return pa.table(columns, names=[*names, "subroot", "root", "proof_sha256", "copies", "folded_root"])

    return leaves.groupBy("tree", "block").cogroup(facts.groupBy("tree", "block")).applyInArrow(prove, schema)


def document_manifest(documents: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, copies) of every row.

    Trees are the languages, the null one first. Leaves ascend by doc_id, null ones first; equal ids by their leaf, so
    that repeated rows have defined places (their digests are equal). Tampering lower-cases A-Z of the texts of rows
    whose doc_id's crc32 is divisible by 3; a null text or one without capitals stays, so its version verifies; a null
    doc_id is not tampered with. A single row is its own root, without siblings. An empty table gives an empty one; other
    columns play no part.
    """
    values = [F.col(c) for c in FIELDS]
    lowered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    # the null language sorts before all others, which keep their order behind one more character
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    rows = documents.select(tree.alias("tree"), F.col("doc_id").alias("name"), leaf_digest(*values).alias("leaf"), F.when(tampered, leaf_digest(*lowered)).alias("changed"))
    proved = manifest(rows)
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return proved.select(F.col("name").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", verified, "copies")


def copied_nodes(proved: DataFrame) -> DataFrame:
    """(doc_id, level, digest): what each tampered leaf's version stores beside the shared tree; level 1 is the leaf's parent."""
    return proved.filter("copies is not null").select("doc_id", F.posexplode("copies").alias("level", "digest")).withColumn("level", F.col("level") + 1)


def sql(levels: int = 7) -> str:
    """The same in SQL, for up to FAN**levels leaves and languages."""

    def leaf(text: str) -> str:
        fields = [text if c == "text" else c for c in FIELDS]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in fields) + ")"

    def climb(step: str, start: str, top: str) -> list[str]:
        """Levels over (tree, pos, digest) of ``start``; each leaf of ``walk`` carries its own fold and siblings."""
        parts = [f"{step}_0 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {start})"]
        for k in range(levels):
            parts.append(
                f"""{step}_{k + 1} AS MATERIALIZED (
                  SELECT tree, pos // {FAN} AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest,
                    (any_value(n) + {FAN - 1}) // {FAN} AS n
                  FROM {step}_{k} GROUP BY tree, pos // {FAN}
                )"""
            )
        parts.append(f"{top} AS MATERIALIZED (SELECT tree, digest FROM {step}_{levels})")
        return parts

    def walk(step: str, name: str, start: str) -> list[str]:
        parts = [f"{name}_0 AS MATERIALIZED (SELECT *, pos AS at FROM {start})"]
        for k in range(levels):
            parts.append(
                f"""{name}_{k + 1} AS MATERIALIZED (
                  SELECT w.row_id, any_value(w.tree) AS tree, any_value(w.at) // {FAN} AS at,
                    CASE WHEN any_value(s.n) > 1 THEN sha256(string_agg(CASE WHEN s.pos = w.at THEN w.fold ELSE s.digest END, '' ORDER BY s.pos)) ELSE any_value(w.fold) END AS fold,
                    any_value(w.proof) || coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos <> w.at), '') AS proof
                  FROM {name}_{k} w JOIN {step}_{k} s ON s.tree = w.tree AND s.pos // {FAN} = w.at // {FAN} GROUP BY w.row_id
                )"""
            )
        return parts

    # crc32, bit by bit
    bit = "lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(CAST(doc_id AS VARCHAR)[k]) AS BIGINT))),
      lambda s, v: list_reduce(list_prepend(xor(s, v), CAST(range(8) AS BIGINT[])), {bit})), 4294967295)"""
    steps = [
        f"""leaves AS MATERIALIZED (
          SELECT row_number() OVER () AS row_id, doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS digest,
            CASE WHEN ({crc}) % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed
          FROM documents
        )""",
        "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest, row_id) - 1 AS pos FROM leaves)",
        *climb("low", "placed", "subroots"),
        "tops AS MATERIALIZED (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS pos, digest FROM subroots)",
        *climb("high", "tops", "roots"),
        "start AS MATERIALIZED (SELECT row_id, tree, pos, coalesce(changed, digest) AS fold, '' AS proof FROM placed)",
        *walk("low", "own", "start"),
        f"crossed AS MATERIALIZED (SELECT o.row_id, '' AS tree, t.pos, o.fold, o.proof FROM own_{levels} o JOIN tops t ON t.name = o.tree)",
        *walk("high", "whole", "crossed"),
    ]
    return f"""
    WITH {", ".join(steps)}
    SELECT p.doc_id, p.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(w.proof) AS proof_sha256, w.fold AS folded_root, w.fold = r.digest AS verified
    FROM placed p JOIN subroots s USING (tree) JOIN whole_{levels} w USING (row_id) CROSS JOIN roots r
    """
