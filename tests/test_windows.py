"""Window building blocks against brute force on small random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import windows as w


def events(seed, n, keys, span, grid=1_000_000):
    rng = random.Random(seed)
    return [(i, rng.choice(keys), rng.randrange(span) * grid, rng.randrange(6)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, k string, us bigint, item int").select(
        "id", "k", F.timestamp_micros("us").alias("ts"), "item"
    )


@pytest.mark.parametrize("seed,n,span,width", [(1, 400, 300, 10), (2, 300, 2000, 7), (3, 200, 40, 10)])
def test_trailing_equals_brute_force(spark, seed, n, span, width):
    rows = events(seed, n, "aab", span)
    got = {
        (r.k, r.us): (r.n, r.items, r.id)
        for r in w.trailing(frame(spark, rows), ["k"], "ts", width, {"n": 1}, {"items": "item"}, order="id").collect()
    }
    want = {}
    for _, k, t, _ in rows:
        seen = [r for r in rows if r[1] == k and t - width * 1_000_000 <= r[2] <= t]
        want[(k, t)] = (
            len(seen),
            len({r[3] for r in seen}),
            min(r[0] for r in rows if r[1] == k and r[2] == t),
        )
    assert got == want


def chain(rows, width, inclusive):
    last, out = {}, []
    for i, k, t, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        e = last.get(k)
        if e is None or (t - e > width if inclusive else t - e >= width):
            last[k] = t
            out.append(i)
    return sorted(out)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize(
    "seed,n,span,width", [(1, 3000, 5000, 3), (2, 500, 100000, 2), (3, 4000, 2000, 1), (4, 50, 40, 5)]
)
def test_silence_equals_sequential_rule(spark, seed, n, span, width, inclusive):
    rows = events(seed, n, "aaab", span)
    got = w.silence(frame(spark, rows), ["k"], "ts", width, inclusive, ["id"])
    assert sorted(r.id for r in got.collect()) == chain(rows, width * 1_000_000, inclusive)


def test_silence_of_a_derived_input(spark):
    rows = events(11, 2000, "aab", 4000)
    got = w.silence(frame(spark, rows), ["k"], "ts", 3, True, ["id"], derived=True)
    assert sorted(r.id for r in got.collect()) == chain(rows, 3_000_000, True)


def test_silence_survives_small_arrow_batches(spark):
    rows = events(9, 3000, "ab", 3000, grid=500_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = w.silence(frame(spark, rows), ["k"], "ts", 2, True, ["id"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.id for r in got) == chain(rows, 2_000_000, True)


def test_silence_many_keys(spark):
    rows = events(5, 4000, [f"k{i}" for i in range(500)], 3000)
    got = w.silence(frame(spark, rows), ["k"], "ts", 60, False, ["id"])
    assert sorted(r.id for r in got.collect()) == chain(rows, 60_000_000, False)


@pytest.mark.parametrize("include", [True, False])
def test_running_with_and_without_reset(spark, include):
    rows = events(7, 500, "ab", 20000)
    df = frame(spark, rows)
    gap = 60
    got = {
        r.id: (r.total, r.top)
        for r in w.running(
            df, ["k"], w.micros("ts"), ["ts", "id"],
            {"total": ("sum", F.col("item")), "top": ("max", F.col("item"))},
            cell=30_000_000, include_current=include, reset_gap=gap * 1_000_000,
        ).collect()
    }
    for k in "ab":
        last, run = None, []
        for i, _, t, v in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])):
            if last is not None and t - last > gap * 1_000_000:
                run = []
            seen = run + [v] if include else run
            # a cell starts with what was carried in, so only the run's first row is empty
            want = (sum(seen), max(seen)) if seen else (None, None)
            assert got[i] == want
            run, last = run + [v], t


def test_ewma_equals_fold(spark):
    rng = random.Random(3)
    rows = [(k, i * (1 + (k == "b")), rng.random() * 100) for k in "ab" for i in range(700)]
    df = spark.createDataFrame(rows, "k string, sec bigint, x double")
    out = w.ewma(df, ["k"], "sec", {"avg": "x"}, 0.2, 64).filter("own").collect()
    got = {(r.k, r.sec): (r.avg_prior, r.avg) for r in out}
    assert len(out) == len(rows)
    for k in "ab":
        avg = None
        for _, s, x in sorted(r for r in rows if r[0] == k):
            prior, avg = avg, x if avg is None else 0.2 * x + 0.8 * avg
            assert got[(k, s)][1] == pytest.approx(avg, rel=1e-12)
            assert got[(k, s)][0] == (None if prior is None else pytest.approx(prior, rel=1e-12))


def _exchanges(df, kind="Exchange hashpartitioning"):
    return df._jdf.queryExecution().sparkPlan().toString().count(kind), df._jdf.queryExecution().executedPlan().toString().count(kind)


def test_trailing_shuffles_rows_once(spark):
    # sums and two distinct counts; before, each count grouped the rows anew and the steps were shuffled twice
    rows = spark.range(40).selectExpr("id % 3 as k", "timestamp_seconds(id) as ts", "id % 5 as a", "id % 7 as b", "id")
    out = w.trailing(rows, ["k"], "ts", 10, {"n": 1}, {"as": "a", "bs": "b"}, order="id")
    assert _exchanges(out)[1] == 1
    assert all(r["n"] <= 4 and r["as"] <= r["n"] and r["bs"] <= r["n"] for r in out.collect())


def test_only_linked_blocks_are_lifted():
    # blocks of 160 (width and reach 10): one by itself, one that can silence the next, one that depends on it
    import pyarrow as pa

    rows = [(0, 5), (160, 315), (320, 315), (320, 322), (320, 330), (480, 600)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["a"] * len(rows)), pa.array([b for b, _ in rows]), pa.array([c for _, c in rows]), pa.array([c for _, c in rows])],
        names=["_k", "_b", "_c", "_o"],
    )
    got = [tuple(r.values()) for out in w._lift(10, 10, 160)([batch]) for r in out.to_pylist()]
    assert got == [("a", 160, 315, 315), ("a", 320, 322, 322), ("a", 320, 330, 330)]
