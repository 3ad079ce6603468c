"""Exact top-k search by a Voronoi join.

Pivots cut the space into cells. A cell's rows are summed up by shells of distance to the pivot (count and largest
distance). Queries of near cells form blocks. From the summaries alone follow, for each block, a score that its k-th
best rows reach at least and, for each shell, a score that its rows reach at most; only shells that can reach are sent
to the block, cut into chunks, and each (block, chunk) is solved exactly in one task. Scores are integer inner products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import materialize, table_of

SCALE = 64
SAMPLE = 4096  # rows from which pivots are made; a bound of the search's speed only
PIVOTS = 256
SHELLS = 16
BLOCK = 2048  # queries solved together
CHUNK = 16384  # rows they meet at once


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<bigint>): floor(scale * component); rows with a null id, vector, component or one that is not finite are out."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    return embeddings.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("x"))


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows, short ones filled with zeros."""
    if vectors and all(len(v) == width for v in vectors):
        return np.array(vectors, dtype=np.int64).reshape(len(vectors), width)
    rows = np.zeros((len(vectors), width), dtype=np.int64)
    for k, v in enumerate(vectors):
        rows[k, : len(v)] = v
    return rows


def _rows(column: pa.Array) -> np.ndarray:
    """A list column as a matrix."""
    lengths = np.diff(column.offsets.to_numpy())
    width = int(lengths.max(initial=0))
    if len(lengths) and (lengths == width).all():
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    return _matrix(column.to_pylist(), width)


def choose_pivots(sample: list, pivots: int = PIVOTS, rounds: int = 4) -> np.ndarray:
    """Centres of a bounded sample's clusters; any points would do for right results."""
    points = _matrix(sample, max(map(len, sample), default=0)).astype(float)
    centres = np.unique(points, axis=0)
    if len(centres) <= pivots:
        return centres
    centres = centres[np.linspace(0, len(centres) - 1, pivots).astype(int)]
    for _ in range(rounds):
        cell, _ = nearest(points, centres)
        for c in np.unique(cell):
            centres[c] = points[cell == c].mean(axis=0)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, distance to it) of each point."""
    width = max(points.shape[1], centres.shape[1])
    points = np.pad(points.astype(float), ((0, 0), (0, width - points.shape[1])))
    centres = np.pad(centres, ((0, 0), (0, width - centres.shape[1])))
    squares = (centres**2).sum(axis=1)
    cell = np.concatenate([(squares - 2 * points[k : k + 4096] @ centres.T).argmin(axis=1) for k in range(0, len(points), 4096)]) if len(points) else np.zeros(0, int)
    return cell, np.sqrt(((points - centres[cell]) ** 2).sum(axis=1))


def best_of(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the query, row ids, scores): each query's k best rows, ties to smaller ids, rows of its own id left out."""
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    width = max(queries.shape[1], rows.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(width, 1)
    exact = np.float64 if largest < 2**52 else np.int64
    if largest >= 2**62:
        raise OverflowError("scores beyond 64 bits")
    left, right = queries.astype(exact), rows.astype(exact).T
    for begin in range(0, len(queries), 256):
        scores = left[begin : begin + 256] @ right
        for number, line in enumerate(scores, begin):
            own = np.searchsorted(row_ids, [query_ids[number], query_ids[number] + 1])
            if own[0] < own[1]:
                line = np.delete(line, np.arange(*own))
            if len(line) > k:
                border = np.partition(line, len(line) - k)[len(line) - k]
                above = np.flatnonzero(line > border)
                chosen = np.concatenate([above, np.flatnonzero(line == border)[: k - len(above)]])
            else:
                chosen = np.arange(len(line))
            places = chosen + (own[1] - own[0]) * (chosen >= own[0])
            yield number, row_ids[places], line[chosen].astype(np.int64)


def plan_blocks(summary: list, pivots: np.ndarray, k: int, block: int, own: dict[int, int] | None = None) -> tuple[list, list]:
    """Blocks of queries and the shells each needs, from the cells' summaries.

    ``summary``: rows with cell, shell, n, n_queries, reach (largest distance to the pivot). ``own``: for a cell the most
    rows, of the whole table, that have the vec_id of one of its queries; 1 if not given. Returns
    ``(cell, first block, number of blocks)`` for cells with queries, and ``(cell, shell, [blocks])``.
    """
    own = own or {}
    cells: dict[int, list] = {}
    for row in summary:
        held = cells.setdefault(row["cell"], [0, 0.0])
        held[0] += row["n_queries"]
        if row["n_queries"]:
            held[1] = max(held[1], row["query_reach"])
    asking = sorted(c for c, (n, _) in cells.items() if n)
    # cells one after the other by nearness, small ones together, large ones cut
    blocks: list[tuple[list[int], int]] = []
    todo = list(asking)
    dealt = []
    while todo:
        members = [todo.pop(0)]
        size = cells[members[0]][0]
        if todo and size < block:
            gaps = ((pivots[todo] - pivots[members[0]]) ** 2).sum(axis=1)
            for c in [todo[j] for j in np.argsort(gaps, kind="stable")]:
                if size + cells[c][0] > block:
                    break
                members.append(c)
                size += cells[c][0]
        todo = [c for c in todo if c not in members]
        parts = -(-size // block)
        dealt += [(c, len(blocks), parts) for c in members]
        blocks += [(members, size)] * parts
    norms = np.sqrt((pivots**2).sum(axis=1))
    shell_cell = np.array([r["cell"] for r in summary], dtype=int)
    reach = np.array([r["reach"] for r in summary], dtype=float)
    count = np.array([r["n"] for r in summary], dtype=np.int64)
    needed: list[list[int]] = [[] for _ in summary]
    last = None
    for number, (members, _) in enumerate(blocks):
        if members is not last:  # the parts of one cell have the same bounds
            last = members
            centre = pivots[members].mean(axis=0)
            radius = max(float(np.sqrt(((pivots[c] - centre) ** 2).sum())) + cells[c][1] for c in members)
            inner = pivots[shell_cell] @ centre
            around = np.sqrt((centre**2).sum()) * reach + radius * (norms[shell_cell] + reach)
            slack = 1e-6 * (1 + np.abs(inner) + around)
            least, most = inner - around - slack, inner + around + slack
            order = np.argsort(-least, kind="stable")
            # so many of them may have the query's own vec_id
            enough = np.searchsorted(np.cumsum(count[order]), k + max(own.get(c, 1) for c in members))
            border = least[order[enough]] if enough < len(order) else -np.inf
            wanted = np.flatnonzero(most >= border)
        for j in wanted.tolist():
            needed[j].append(number)
    return dealt, [(r["cell"], r["shell"], b) for r, b in zip(summary, needed, strict=True) if b]


def top_k(vectors: DataFrame, is_query, k: int = 20, pivots: int = PIVOTS, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row its k best rows by inner product, exactly.

    ``vectors``: (vec_id, x array<bigint>), see :func:`integer_vectors`. ``is_query``: a condition on vec_id. Ranks start
    at 1, ties go to the smaller vec_id, all rows but those of the query's own vec_id are candidates; a query with fewer
    has fewer. Rows that repeat with the same vec_id and vector are candidates each but one query. Short vectors count as
    filled with zeros. An empty table, or one without queries, has no results. The driver holds the sample, the pivots,
    the summaries (at most pivots x shells rows) and one count for each pivot; blocks and chunks bound what one task holds.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    sample = vectors.withColumn("_h", F.xxhash64("vec_id")).orderBy("_h", "vec_id").limit(SAMPLE).select("x").collect()
    if not sample:
        return spark.createDataFrame([], schema)
    centres = choose_pivots([r["x"] for r in sample], pivots)
    del sample
    out = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int64())), ("cell", pa.int32()), ("distance", pa.float64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, distance = nearest(_rows(batch.column(1)), centres)
            yield table_of(out, batch.column(0), batch.column(1).cast(pa.list_(pa.int64())), cell.astype(np.int32), distance)

    placed = vectors.select("vec_id", "x").mapInArrow(assign, "vec_id bigint, x array<bigint>, cell int, distance double")
    placed = materialize(placed.withColumn("query", is_query))
    widest = placed.agg(F.max("distance")).first()[0] or 1.0
    placed = placed.withColumn("shell", F.least(F.floor(F.col("distance") * SHELLS / widest), F.lit(SHELLS - 1)).cast("int"))
    summary = placed.groupBy("cell", "shell").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("query").alias("n_queries"), F.max("distance").alias("reach"), F.max(F.when(F.col("query"), F.col("distance"))).alias("query_reach")
    )
    summary = [r.asDict() for r in summary.orderBy("cell", "shell").collect()]
    repeated = placed.filter("query").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("cell").alias("cells")).filter("n > 1")
    own = {r["cell"]: r["n"] for r in repeated.select(F.explode("cells").alias("cell"), "n").groupBy("cell").agg(F.max("n").alias("n")).collect()}
    dealt, needed = plan_blocks(summary, centres, k, block, own)
    if not dealt:
        return spark.createDataFrame([], schema)
    n_of = {(r["cell"], r["shell"]): r["n"] for r in summary}
    met: dict[int, int] = {}
    for cell, shell, blocks in needed:
        for b in blocks:
            met[b] = met.get(b, 0) + n_of[cell, shell]
    chunks = {b: -(-n // chunk) for b, n in met.items()}
    # which blocks a shell's rows go to, and which chunks a block has: a few rows for each shell and block
    targets = spark.createDataFrame([(c, s, [(b, chunks[b]) for b in bs]) for c, s, bs in needed], "cell int, shell int, targets array<struct<block: int, chunks: int>>")
    homes = spark.createDataFrame([(c, [(b, chunks[b]) for b in range(first, first + parts)]) for c, first, parts in dealt], "cell int, homes array<struct<block: int, chunks: int>>")
    candidates = (
        placed.join(targets, ["cell", "shell"])
        .select("vec_id", "x", F.explode("targets").alias("t"))
        .select(F.col("t.block").alias("block"), F.pmod(F.xxhash64("vec_id", "x"), F.col("t.chunks")).cast("int").alias("chunk"), "vec_id", "x")
    )
    queries = placed.filter("query").selectExpr("vec_id as q_id", "x as q", "cell").distinct().join(homes, "cell")
    home = F.element_at("homes", (F.pmod(F.xxhash64("q_id", "q"), F.size("homes")) + 1).cast("int"))
    queries = queries.select("q_id", "q", home.alias("h")).select(F.col("h.block").alias("q_block"), F.explode(F.sequence(F.lit(0), F.col("h.chunks") - 1)).alias("q_chunk"), "q_id", "q")
    found = pa.schema([("query_id", pa.int64()), ("q", pa.list_(pa.int64())), ("vec_id", pa.int64()), ("score", pa.int64())])

    def solve(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return found.empty_table()
        q, x = asked.column("q").combine_chunks(), held.column("x").combine_chunks()
        q_ids, x_ids = asked.column("q_id").to_numpy(), held.column("vec_id").to_numpy()
        numbers, ids, scores = [], [], []
        for number, best, score in best_of(_rows(q), q_ids, _rows(x), x_ids, k):
            numbers.append(np.full(len(best), number))
            ids.append(best)
            scores.append(score)
        numbers = np.concatenate(numbers)
        return pa.Table.from_arrays([pa.array(q_ids[numbers]), q.take(pa.array(numbers)).cast(pa.list_(pa.int64())), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], schema=found)

    local = queries.groupBy("q_block", "q_chunk").cogroup(candidates.groupBy("block", "chunk")).applyInArrow(solve, "query_id bigint, q array<bigint>, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
