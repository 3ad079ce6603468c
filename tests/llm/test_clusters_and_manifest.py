"""Centroid clusters, dataset manifest: against plain versions."""

import hashlib
import zlib

import numpy as np
import pytest

from packetloom.llm import merkle_manifest as mm
from packetloom.llm import ptolemaic_clusters as pc

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_clusters(rows, clusters, rounds, scale=256, width=64):
    """(rows of (vec_id, cluster, distance), final centroids) with Python's integers."""
    kept = []
    for vec_id, v, *_ in rows:
        if v is not None and len(v) == width and all(c is not None and np.isfinite(np.float32(c)) for c in v):
            kept.append((vec_id, [int(np.floor(float(np.float32(c)) * scale)) for c in v]))
    digest = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centres = [list(x) for _, x in sorted(kept, key=digest)[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres)) for _, x in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centres)):
            mine = [x for (_, x), (_, c) in zip(kept, found, strict=True) if c == j]
            if mine:
                centres[j] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    return [(i, c, d) for (i, _), (d, c) in zip(kept, assign(), strict=True)], centres


def vectors_around(rng, centres, n, spread):
    return [(int(k), (centres[k % len(centres)] + rng.normal(0, spread, centres.shape[1])).astype(np.float32).tolist(), 0) for k in range(n)]


def compare_clusters(spark, rows, clusters=7, rounds=3, change=lambda df: df):
    expected, centres = plain_clusters(rows, clusters, rounds)
    got = pc.centroid_clusters(change(spark.createDataFrame(rows, VECTORS)), clusters, rounds).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted([(r["vec_id"], r["cluster"], r["distance"]) for r in got], key=key) == sorted(expected, key=key)
    for r in got:
        assert r["inertia"] == sum(d for *_, d in expected)
        assert r["cluster_inertia"] == sum(d for _, c, d in expected if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


def test_clusters_of_odd_tables(spark, clashing):
    rng = np.random.default_rng(5)
    rows = vectors_around(rng, rng.normal(0, 1, (5, 64)), 150, 0.3)
    rows += [rows[3]] * 40 + [(3, rows[8][1], 1)]  # repeated rows, one id with two vectors
    rows += [(None, rows[5][1], 0), (900, None, 0), (901, [], 0), (902, [0.5] * 63, 0), (903, [0.5] * 63 + [None], 0)]
    rows += [(904, [0.5] * 63 + [float("nan")], 0), (905, [0.5] * 63 + [float("inf")], 0), (906, [0.5] * 65, 0), (907, [-0.001] * 64, 0)]
    compare_clusters(spark, rows, change=clashing)
    # more centroids than vectors; equal vectors whose centroids tie; no vectors at all
    compare_clusters(spark, rows[:4], clusters=7)
    compare_clusters(spark, [(k, [1.0] * 64, 0) for k in range(9)])
    compare_clusters(spark, [(k, [0.5] * 9, 0) for k in range(3)] + [(5, None, 0)])
    assert pc.centroid_clusters(spark.createDataFrame([], VECTORS)).count() == 0


def test_too_large_components_are_an_error(spark):
    rows = [(1, [3e38] * 64, 0), (2, [0.0] * 64, 0)]
    with pytest.raises(Exception, match="beyond"):
        pc.centroid_clusters(spark.createDataFrame(rows, VECTORS)).collect()


def test_pivots_spare_most_checks_of_clustered_vectors(spark):
    rng = np.random.default_rng(6)
    rows = vectors_around(rng, rng.normal(0, 1, (20, 64)), 3000, 0.05)
    *_, shares = pc.fit_centroids(pc.kept_vectors(spark.createDataFrame(rows, VECTORS)))
    assert len(shares) == 5 and min(shares) < 0.1 and shares[-1] < 0.3


def test_bounds_stay_below_the_distances():
    rng = np.random.default_rng(7)
    points = rng.integers(-300, 300, (400, 64))
    pivots = rng.integers(-300, 300, (9, 64))
    pivots[4] = pivots[2]  # pivots that are equal give no pair
    kept = pc.distances(points, pivots).astype(np.float32)
    for move in (0, 1, 40):
        centres = pivots + rng.integers(-move, move + 1, pivots.shape)
        bounds = pc.lower_bounds(kept, pivots, centres, pc.pivot_pairs(pivots))
        true = pc.distances(points, centres)
        assert (bounds <= true).all()
        if move == 0:
            assert (bounds > 0.999 * true).all()


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    fields = [None if f is None else str(f) for f in (doc_id, source, lang, n_chars, text)]
    return h(*["-" if f is None else f"{len(f.encode())}:{f}" for f in fields])


def plain_root(leaves):
    """(root, siblings and their side for each leaf), level by level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, place in enumerate(at):
            first = place // 8 * 8
            paths[k] += [("".join(nodes[first:place]), "".join(nodes[place + 1 : first + 8]))]
        at, nodes = [p // 8 for p in at], [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain_manifest(rows):
    """Rows of (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    langs = sorted({r[2] for r in rows}, key=lambda c: (c is not None, (c or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[lang] = (mine, *plain_root([plain_leaf(*r) for r in mine]))
    root, upper = plain_root([trees[c][1] for c in langs])
    found = []
    for lang, above in zip(langs, upper, strict=True):
        mine, subroot, paths = trees[lang]
        for row, path in zip(mine, paths, strict=True):
            path = path + above
            folded = leaf = plain_leaf(*row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                low = None if row[1] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[1])
                folded = plain_leaf(row[0], low, *row[2:])
            for left, right in path:
                folded = h(left, folded, right)
            found.append((row[0], leaf, subroot, root, h(*[s for p in path for s in p]), folded, folded == root))
    return found


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def compare_manifest(documents, rows, change=lambda df: df):
    got = mm.document_manifest(change(documents(rows))).select(*COLUMNS).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_odd_tables(documents, clashing):
    texts = ["Aa Bb", "", None, "ÄÖ ß 字", "x" * 300_000 + "Y", "plain"]
    rows = [(k * 7 % 1000, texts[k % 6], ("en", "de", None, "", "Ä", "zz", "=")[k % 7], ("web", None)[k % 2], k % 5 or None) for k in range(400)]
    rows += [rows[9]] * 70 + [(None, "Null Id", "en", "web", 3)] * 3 + [(14, "Same id", "en", "web", 3), (14, "same id", "en", "web", 3)]
    compare_manifest(documents, rows, clashing)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65])
def test_manifest_of_small_trees(documents, n):
    compare_manifest(documents, [(k, f"Text {k}", "en", "web", 6) for k in range(n)]) if n else None
    compare_manifest(documents, [(k, f"Text {k}", f"l{k:03}", "web", 6) for k in range(n)]) if n else None
    if not n:
        assert mm.document_manifest(documents([])).count() == 0


def test_manifest_over_several_blocks(documents):
    # more than one block of 4096 leaves, the last one a single leaf, and more than one block of languages
    compare_manifest(documents, [(k, f"Text {k}", "en", "web", 6) for k in range(2 * 4096 + 1)])
    compare_manifest(documents, [(k, "T", f"l{k}", "web", 1) for k in range(4096 + 9)])


def test_versions_share_all_but_the_leafs_ancestors(documents):
    rows = [(k, f"Text {k}", "en", "web", 6) for k in range(600)]
    proved = mm.document_manifest(documents(rows))
    copied = {}
    for r in mm.copied_nodes(proved).collect():
        copied.setdefault(r["doc_id"], {})[r["level"]] = r["digest"]
    assert set(copied) == {k for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 0}
    for doc_id, nodes in copied.items():
        # the whole tree with one leaf changed has these nodes on the leaf's way up, and all others as before
        leaves = [plain_leaf(*(r if r[0] != doc_id else (r[0], r[1].lower(), *r[2:]))) for r in rows]
        level, place = leaves, doc_id
        for k in range(1, len(nodes) + 1):
            level, place = [h(*level[i : i + 8]) for i in range(0, len(level), 8)], place // 8
            assert nodes[k] == level[place]
        assert len(level) == 1
