"""Centroid clustering with Ptolemaic pivots.

The pivots are a round's centroids. Every vector's distances to them are computed once and kept beside it, as 32-bit
floats. Later centroids c are bounded from below by Ptolemy's inequality over fixed pairs of pivots (p, s):

    d(v, c) >= |d(v, p) * d(c, s) - d(v, s) * d(c, p)| / d(p, s)

The bound is lowered by more than all rounding can have raised it; only centroids whose bound does not exceed the best
exact distance so far are checked, in integers. Where centroids have moved so far that more than half of them are
checked, the pivots are renewed from the centroids of that round.

A pass over the vectors returns counts and component sums of each cluster, added up in each task first; the driver
sees sums and centroids only, k rows of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import materialize, table_of

SCALE = 256
CLUSTERS = 40
ROUNDS = 5
WIDTH = 64
RENEW = 0.5  # share of centroids checked from which the pivots are renewed; a matter of speed only
LARGEST = 1 << 26  # of a component after scaling; beyond, squared distances could leave 64 bits
SEED = 2


def kept_vectors(embeddings: DataFrame, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """(vec_id, x array<int>): floor(scale * component) of vectors with exactly ``width`` components, none null or not finite."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    small = F.forall(scaled, lambda c: c.between(-LARGEST, LARGEST))
    checked = F.when(small, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a scaled component is beyond {LARGEST}")))
    return embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter((F.size(x) == width) & finite).select("vec_id", checked.alias("x"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of their id; those without id come last, equal ids by their components."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(hashed.alias("hash"), "x").orderBy(F.col("hash").asc_nulls_last(), "x").limit(clusters)
    # written, so that the partitions' first rows meet in a task and not on the driver
    rows = materialize(first).orderBy(F.col("hash").asc_nulls_last(), "x").collect()
    return np.array([r["x"] for r in rows], dtype=np.int64).reshape(len(rows), len(rows[0]["x"]) if rows else 0)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices, row by row."""
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of all points to all centres, from exact squares."""
    return np.sqrt(np.stack([squares(points, c[None, :]) for c in centres], axis=1)) if len(centres) else np.zeros((len(points), 0))


def pivot_pairs(pivots: np.ndarray) -> list[tuple[int, int]]:
    """Each pivot with its nearest, its middle and its farthest other one, so far as they are apart from it."""
    pairs = []
    between = distances(pivots, pivots)
    for p, row in enumerate(between):
        others = [int(s) for s in np.argsort(row, kind="stable") if row[s] > 0]
        pairs += [(p, s) for s in dict.fromkeys(others[k] for k in (0, len(others) // 2, -1))] if others else []
    return pairs


def lower_bounds(kept: np.ndarray, pivots: np.ndarray, centres: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Bounds from below of the distances of points, by their kept distances to pivots, to the centres that those pivots became."""
    bounds = np.zeros((len(kept), len(centres)))
    to_pivots, between = distances(centres, pivots), distances(pivots, pivots)
    wide = kept.astype(np.float64)
    for p, s in pairs:
        one, other = wide[:, p] * to_pivots[p, s], wide[:, s] * to_pivots[p, p]
        # kept distances are off by 2**-24 of themselves at most, all other roundings by far less
        safe = (np.abs(one - other) - (one + other) * 2.0**-22) / between[p, s] * (1 - 2.0**-40)
        np.maximum(bounds[:, p], safe, out=bounds[:, p])
    return bounds


def nearest_centres(points: np.ndarray, bounds: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centre, squared distance, exact checks done); ties to the smaller number."""
    cluster = bounds.argmin(axis=1)
    guess = cluster.copy()
    best = squares(points, centres[cluster])
    checks = len(points)
    least = bounds * bounds * (1 - 2.0**-40)
    for j, centre in enumerate(centres):
        rows = np.flatnonzero((least[:, j] <= best) & (guess != j))
        found = squares(points[rows], centre[None, :])
        checks += len(rows)
        better = (found < best[rows]) | ((found == best[rows]) & (j < cluster[rows]))
        cluster[rows[better]], best[rows[better]] = j, found[better]
    return cluster, best, checks


def _points(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _kept(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, x, kept array<float>): the vectors with their distances to the pivots, written."""
    out = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("kept", pa.list_(pa.float32()))])

    def cache(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = distances(_points(batch.column(1)), pivots).astype(np.float32)
                lists = pa.ListArray.from_arrays(np.arange(0, kept.size + 1, kept.shape[1], dtype=np.int32), pa.array(kept.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.int32())), lists], schema=out)

    return materialize(vectors.select("vec_id", "x").mapInArrow(cache, "vec_id bigint, x array<int>, kept array<float>"))


def cluster_sums(cached: DataFrame, pivots: np.ndarray, centres: np.ndarray) -> list:
    """A row for each cluster with members: its number, count of members, component sums, exact checks done."""
    width, pairs = centres.shape[1], pivot_pairs(pivots)
    out = pa.schema([("cluster", pa.int32()), ("members", pa.int64()), ("checks", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, checks = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
        sums = np.zeros((len(centres), width), np.int64)
        for batch in batches:
            points = _points(batch.column(0))
            cluster, _, done = nearest_centres(points, lower_bounds(_kept(batch.column(1)), pivots, centres, pairs), centres)
            for j in np.unique(cluster):
                mine = points[cluster == j]
                members[j] += len(mine)
                sums[j] += mine.sum(axis=0)
            if len(cluster):
                checks[cluster[0]] += done
        some = np.flatnonzero(members)
        if len(some):
            yield table_of(out, some.astype(np.int32), members[some], checks[some], sums[some].tolist())

    partial = cached.select("x", "kept").mapInArrow(add_up, "cluster int, members bigint, checks bigint, sums array<bigint>")
    totals = F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")
    return partial.groupBy("cluster").agg(F.sum("members").alias("members"), F.sum("checks").alias("checks"), totals).collect()


def fit_centroids(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, np.ndarray, list[float]]:
    """(vectors with kept distances, pivots, centroids after the rounds, share of centroids checked in each round)."""
    centres = first_centroids(vectors, clusters)
    pivots, cached, shares = centres.copy(), with_pivots(vectors, centres), []
    for _ in range(rounds if len(centres) else 0):
        if shares and shares[-1] > RENEW:
            pivots, cached = centres.copy(), with_pivots(cached, centres)
        rows = cluster_sums(cached, pivots, centres)
        shares.append(sum(r["checks"] for r in rows) / (len(centres) * sum(r["members"] for r in rows)))
        for row in rows:  # // is the floor, also of negative sums
            centres[row["cluster"]] = [s // row["members"] for s in row["sums"]]
    return cached, pivots, centres, shares


def centroid_clusters(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    The first centroids are the vectors with the smallest hashes of their id; fewer vectors make fewer centroids. Every
    row is a vector of its own, repeated rows and ids too; a null id stays null and never makes a centroid while there are
    others. Vectors that are null, of another length or hold null or non-finite components are left out; an empty table
    gives an empty one. Of equally near centroids the smaller number counts; a centroid without members stays. Scaled
    components beyond 2**26 are an error, as distances would leave 64 bits. Other columns play no part.
    """
    cached, pivots, centres, _ = fit_centroids(kept_vectors(embeddings), clusters, rounds)
    pairs = pivot_pairs(pivots)
    out = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bounds = lower_bounds(_kept(batch.column(2)), pivots, centres, pairs)
                cluster, distance, _ = nearest_centres(_points(batch.column(1)), bounds, centres)
                yield table_of(out, batch.column(0), cluster.astype(np.int32), distance)

    assigned = materialize(cached.select("vec_id", "x", "kept").mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"))
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    facts = [(j, inertia[j], sum(inertia.values()), digests[j]) for j in sorted(inertia)]
    # a row for each cluster, so its size is that of the parameter
    named = embeddings.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH) -> str:
    """The same in SQL, each round two tables of its own."""
    apart = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    steps = [
        f"""kept AS MATERIALIZED (
          SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
          FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        )""",
        f"""centre_0 AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, x) - 1 AS cluster, x FROM kept
          ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, x LIMIT {clusters}
        )""",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""assigned_{k} AS MATERIALIZED (
              SELECT row_id, min(struct_pack(distance := {apart}, cluster := c.cluster)) AS best FROM kept v, centre_{k} c GROUP BY row_id
            )"""
        )
        if k < rounds:
            steps.append(
                f"""centre_{k + 1} AS MATERIALIZED (
                  WITH parts AS (SELECT best.cluster AS cluster, unnest(x) AS part, unnest(range({width})) AS place FROM assigned_{k} JOIN kept USING (row_id)),
                  means AS (SELECT cluster, place, sum(part) AS s, count(*) AS n FROM parts GROUP BY ALL),
                  whole AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS x FROM means GROUP BY cluster)
                  SELECT cluster, coalesce(w.x, c.x) AS x FROM centre_{k} c LEFT JOIN whole w USING (cluster)
                )"""
            )
    return f"""
    WITH {", ".join(steps)}
    SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, best.distance AS distance,
      CAST(sum(best.distance) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.distance) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM assigned_{rounds} JOIN kept USING (row_id) JOIN centre_{rounds} c ON c.cluster = best.cluster
    """
