"""Trailing windows, running values and emit-then-silence over event time.

Spark's RANGE frames recompute a sliding aggregate for every row, keep the whole
frame in memory and put one key into one task.  The functions here work on time
*cells* instead: a row's cell is its time rounded down to a multiple of the
window width, so everything a row can see lies in its own cell or in the one
before.  Work is keyed by (key, cell), and a hot key is spread over its cells.

Times are BIGINT microseconds inside these functions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.operators.materialize import materialize

MICROS = 1_000_000


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch; bigint columns pass through unchanged."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def from_micros(us: str | Column) -> Column:
    return F.timestamp_micros(F.col(us) if isinstance(us, str) else us)


def cell_of(us: Column, width: int) -> Column:
    """Start of the cell holding ``us`` (floor, also for times before 1970)."""
    return us - F.pmod(us, F.lit(width).cast("bigint"))


def _width(seconds: float) -> int:
    width = int(round(seconds * MICROS))
    if width <= 0:
        raise ValueError("window width must be positive")
    return width


# --------------------------------------------------------------------------- trailing windows


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    seconds: float,
    sums: Mapping[str, Column | int] | None = None,
    distinct: Mapping[str, Column | str] | None = None,
    order: str | None = None,
) -> DataFrame:
    """Exact sums and distinct counts over the closed window ``[t - seconds, t]``.

    One output row per distinct (keys, time): ``keys, us`` and the requested
    columns; rows with equal times see each other.  With ``order`` the smallest
    value of that column among the rows of the tick is kept under its own name.
    """
    width = _width(seconds)
    sums = dict(sums or {})
    distinct = dict(distinct or {})
    keys = list(keys)
    base = df.select(
        *keys,
        micros(ts).alias("us"),
        *[(F.lit(v) if isinstance(v, int) else v).cast("bigint").alias(f"v_{n}") for n, v in sums.items()],
        *[(F.col(c) if isinstance(c, str) else c).alias(f"i_{n}") for n, c in distinct.items()],
        *([F.col(order).alias("o_first")] if order else []),
    )
    # a row goes to its own cell and, if it counts for anything, to the next; all that follows stays in that cell's task
    us, cell, zero = F.col("us"), F.col("cell"), F.lit(0).cast("bigint")
    counts = us.isNotNull() & reduce(
        or_, [F.col(f"v_{n}") != 0 for n in sums] + [F.col(f"i_{n}").isNotNull() for n in distinct], F.lit(False)
    )
    home = cell_of(us, width)
    rows = base.withColumn("cell", F.explode(F.when(counts, F.array(home, home + width)).otherwise(F.array(home))))
    here = F.coalesce(us >= cell, F.lit(True))
    if order:
        rows = rows.withColumn("o_first", F.when(here, F.col("o_first")))
    rows = rows.repartition(*keys, "cell")
    for name in distinct:
        rows = _presence(rows, keys, name, width, here)

    def step(at, tick, sign):
        fields = [at.alias("at"), F.lit(tick).alias("tick")]
        fields += [F.coalesce(F.col(f"v_{n}") * sign, zero).alias(f"d_{n}") for n in sums]
        fields += [(F.col(f"c_{n}") if sign > 0 else -F.col(f"g_{n}")).alias(f"d_{n}") for n in distinct]
        return F.struct(*fields)

    steps = F.when(here, F.array(step(us, 1, 1))).otherwise(F.array(step(cell, 0, 1), step(us + width + 1, 0, -1)))
    first = ["o_first"] if order else []
    names = [*sums, *distinct]
    deltas = rows.select(*keys, "cell", *first, F.inline(steps))
    deltas = deltas.filter(reduce(or_, [F.col(f"d_{n}") != 0 for n in names], F.col("tick") == 1))
    ticks = deltas.groupBy(*keys, "cell", "at").agg(
        F.max("tick").alias("tick"),
        *[F.min(c).alias(c) for c in first],
        *[F.sum(f"d_{n}").alias(f"d_{n}") for n in names],
    )
    running = Window.partitionBy(*keys, "cell").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    out = ticks.select(*keys, "at", "tick", *first, *[F.sum(f"d_{n}").over(running).alias(n) for n in names]).filter("tick = 1")
    kept = [F.col("o_first").alias(order)] if order else []
    return out.select(*keys, F.col("at").alias("us"), *kept, *names)


def _presence(rows: DataFrame, keys: Sequence[str], name: str, width: int, here: Column) -> DataFrame:
    """Adds ``c_<name>`` and ``g_<name>``: whether a row brings its item into the window, and whether it is gone after it.

    A cell is as long as the window, so what is seen in it stays to its end; an
    item of the cell before goes with its last row there, unless it comes again first.
    """
    item, us = F.col(f"i_{name}"), F.col("us")
    seen = Window.partitionBy(*keys, "cell", item).orderBy("us")
    comes = F.lag(F.lit(1)).over(seen).isNull() | (us - F.lag(us).over(seen) > width)
    goes = ~here & (F.lead(F.lit(1)).over(seen).isNull() | (F.lead(us).over(seen) - us > width))

    def flag(condition):
        return F.when(item.isNotNull() & F.coalesce(condition, F.lit(False)), 1).otherwise(0).cast("bigint")

    return rows.withColumns({f"c_{name}": flag(comes), f"g_{name}": flag(goes)})


# --------------------------------------------------------------------------- running values


def running(
    df: DataFrame,
    keys: Sequence[str],
    position: Column,
    order: Sequence[Column | str],
    values: Mapping[str, tuple[str, Column]],
    cell: int,
    include_current: bool = True,
    reset_gap: int | None = None,
) -> DataFrame:
    """Running ``sum``/``min``/``max`` per key in row order, without one task per key.

    ``position`` is a bigint the order starts with (time or sequence number); it
    is cut into cells.  Each cell is summarised, the summaries are accumulated
    per key, and every cell starts from the value carried in.  With
    ``reset_gap`` the values restart after a gap in ``position`` longer than
    that (``cell`` must not exceed it, so that a gap never falls inside a cell).
    """
    if reset_gap is not None and cell > reset_gap:
        raise ValueError("cell must not be longer than reset_gap")
    keys = list(keys)
    agg = {"sum": F.sum, "min": F.min, "max": F.max}
    columns = df.columns
    rows = df.select(
        *columns,
        position.alias("_pos"),
        *[expr.alias(f"_v_{n}") for n, (_, expr) in values.items()],
    ).withColumn("_cell", cell_of(F.col("_pos"), cell))
    summary = rows.groupBy(*keys, "_cell").agg(
        F.min("_pos").alias("_lo"),
        F.max("_pos").alias("_hi"),
        *[agg[kind](f"_v_{n}").alias(f"_v_{n}") for n, (kind, _) in values.items()],
    )
    by_key = Window.partitionBy(*keys).orderBy("_cell")
    group = keys
    if reset_gap is not None:
        gap = F.col("_lo") - F.lag("_hi").over(by_key) > F.lit(reset_gap)
        summary = summary.withColumn("_new", F.when(gap, 1).otherwise(0))
        summary = summary.withColumn("_run", F.sum("_new").over(by_key))
        group = [*keys, "_run"]
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys, "_cell", *[agg[kind](f"_v_{n}").over(before).alias(f"_v_{n}") for n, (kind, _) in values.items()]
    ).withColumn("_row", F.lit(0))
    merged = rows.withColumn("_row", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    local = (
        Window.partitionBy(*keys, "_cell")
        .orderBy("_row", *order)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    return merged.select(
        *columns, "_row", *[agg[kind](f"_v_{n}").over(local).alias(n) for n, (kind, _) in values.items()]
    ).filter("_row = 1").drop("_row")


# --------------------------------------------------------------------------- emit, then silence

_BLOCK = 16  # windows per block, and blocks per upper block


def silence(
    df: DataFrame,
    keys: Sequence[str | Column],
    ts: str,
    seconds: float,
    inclusive: bool,
    order: Sequence[str] = (),
    derived: bool = False,
) -> DataFrame:
    """Rows that are emitted when each emission silences its key for ``seconds``.

    ``inclusive`` also silences a row exactly ``seconds`` after the emission.
    Whether a row is emitted depends on the last *emitted* row, so the choice is
    a chain through time.  The chain is cut into blocks of 16 windows: each block
    works out, for every row the chain could enter it at, where it leaves; 16
    blocks are joined to an upper block the same way; only the few entry rows of
    the upper blocks are walked per key.  The entries found on the way down
    then start every block on its own, so a hot key is shared by many tasks.

    Only blocks that the chain can reach from the one before, or can leave for
    the next, take part: a block whose first row comes later than anything
    before it could silence starts by itself.

    The input is read twice, times only and whole rows; ``derived`` writes an
    input that is itself expensive to a table first.  Rows without a time are
    left out.  Of rows at one time the first by ``order`` counts; of those equal
    in that too, the first by a hash of all columns.
    """
    if derived:
        df = materialize(df)
    width = _width(seconds)
    reach = width + 1 if inclusive else width
    block, upper = width * _BLOCK, width * _BLOCK * _BLOCK
    columns = df.columns
    key = F.to_json(F.struct(*[(F.col(k) if isinstance(k, str) else k).alias(str(i)) for i, k in enumerate(keys)]))
    home = cell_of(F.col("_c"), block)
    # the times that can silence the start of the next block are seen there too, before its own
    seen_in = F.explode(F.when(F.col("_c") + reach > home + block, F.array(home, home + block)).otherwise(F.array(home)))

    times = df.select(key.alias("_k"), micros(ts).alias("_c")).filter("_c is not null")
    level1 = materialize(
        times.select("_k", seen_in.alias("_b"), "_c", F.col("_c").alias("_o"))
        .repartition("_k", "_b")
        .sortWithinPartitions("_k", "_b", "_c")
        .mapInArrow(_lift(width, reach, block), "_k string, _b bigint, _c bigint, _o bigint")
    ).withColumn("_u", cell_of(F.col("_b"), upper))
    level2 = (
        level1.select("_k", F.col("_u").alias("_b"), "_c", "_o")
        .repartition("_k", "_b")
        .sortWithinPartitions("_k", "_b", "_c")
        .mapInArrow(_lift(width, reach), "_k string, _b bigint, _c bigint, _o bigint")
    )
    nobody = F.lit(None).cast("bigint")
    top = (
        level2.select("_k", F.lit(0).cast("bigint").alias("_g"), nobody.alias("_e"), "_b", "_c", "_o")
        .repartition("_k")
        .sortWithinPartitions("_k", "_c")
        .mapInArrow(_walk(reach, marked=False), "_k string, _g bigint, _e bigint, _b bigint, _c bigint, _o bigint")
    )
    middle = (
        level1.select("_k", F.col("_u").alias("_g"), nobody.alias("_e"), "_b", "_c", "_o")
        .unionByName(top.select("_k", F.col("_b").alias("_g"), F.col("_c").alias("_e"), nobody.alias("_b"), nobody.alias("_c"), nobody.alias("_o")))
        .repartition("_k", "_g")
        .sortWithinPartitions("_k", "_g", F.col("_e").asc_nulls_last(), "_c")
        .mapInArrow(_walk(reach, marked=True), "_k string, _g bigint, _e bigint, _b bigint, _c bigint, _o bigint")
    )
    own = F.when(F.col("_c") >= F.col("_g"), F.struct(*columns))
    rows = (
        df.select(*columns, key.alias("_k"), micros(ts).alias("_c"))
        .filter("_c is not null")
        .select("*", seen_in.alias("_g"))
        .select("_k", "_g", nobody.alias("_e"), "_c", own.alias("_row"))
    )
    marks = middle.select("_k", F.col("_b").alias("_g"), F.col("_c").alias("_e"))
    merged = rows.unionByName(marks, allowMissingColumns=True)
    ranked = [F.col("_row")[c] for c in order]
    emitted = (
        merged.repartition("_k", "_g")
        .sortWithinPartitions("_k", "_g", F.col("_e").asc_nulls_last(), "_c", *ranked, _all_of(df, "_row"))
        .mapInArrow(_walk(reach, marked=True, fresh=True), merged.schema)
    )
    return emitted.select("_row.*").select(*columns)


def _all_of(df: DataFrame, row: str) -> Column:
    """A number from all columns, held in ``row``, to put rows in order that are equal in what is ordered by."""
    held = F.col(row)
    return F.xxhash64(*[F.to_json(held[f.name]) if "map<" in f.dataType.simpleString() else held[f.name] for f in df.schema.fields])


def _starts(batch_cols: Sequence[pa.Array]) -> np.ndarray:
    """Index of every row that begins a new group in sorted columns."""
    n = len(batch_cols[0])
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for col in batch_cols:
        if n > 1:
            change[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


def _search(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, target: np.ndarray) -> np.ndarray:
    """First index in each [lo, hi) whose value is >= its target (hi if none)."""
    if len(lo) < 4:
        return np.array(
            [l + np.searchsorted(values[l:h], t) for l, h, t in zip(lo, hi, target)], dtype=np.int64
        )
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        less = open_ & (values[np.minimum(mid, len(values) - 1)] < target)
        lo = np.where(less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)


def _lift(width: int, reach: int, block: int | None = None):
    """Per (key, block): entry candidates and the last emission each leads to.

    With ``block``, its length, a block also shows times of the block before that
    can silence its start (smaller than ``_b``); blocks that neither depend on
    these nor can silence the next block's start give nothing.
    """

    def solve(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        k, b = table["_k"].combine_chunks(), table["_b"].combine_chunks()
        if isinstance(k, pa.ChunkedArray):
            k, b = k.chunk(0), b.chunk(0)
        c = table["_c"].to_numpy()
        o = table["_o"].to_numpy()
        start = _starts([k, b])
        end = np.append(start[1:], len(c))
        base = b.to_numpy()[start]
        group = np.repeat(np.arange(len(start)), end - start)
        in_zone = c - base[group] <= width
        beyond = _search(c, start, end, base + width + 1)
        in_zone[beyond[beyond < end]] = True
        if block:
            first = _search(c, start, end, base)
            some = first < end
            head = c[np.minimum(first, len(c) - 1)]
            alone = (first == start) | (head >= c[np.maximum(first - 1, 0)] + reach)
            leads = c[end - 1] + reach > base + block
            in_zone &= (c >= base[group]) & (some & ~alone)[group]
            in_zone[first[some & alone & leads]] = True
        entry = np.flatnonzero(in_zone)
        at, last = entry.copy(), end[group[entry]]
        live = np.arange(len(entry))
        while len(live):
            nxt = _search(c, at[live] + 1, last[live], o[at[live]] + reach)
            moved = nxt < last[live]
            live = live[moved]
            at[live] = nxt[moved]
        pick = pa.array(entry)
        return pa.RecordBatch.from_arrays(
            [k.take(pick), b.take(pick), pa.array(c[entry]), pa.array(o[at])], names=["_k", "_b", "_c", "_o"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pa.array(_starts([batch.column("_k"), batch.column("_b"), batch.column("_c")])))
            cut = int(_starts([batch.column("_k"), batch.column("_b")])[-1])
            if held and (
                held[-1].column("_k")[-1] != batch.column("_k")[0] or held[-1].column("_b")[-1] != batch.column("_b")[0]
            ):
                yield solve(pa.Table.from_batches(held))
                held = []
            if cut:
                held.append(batch.slice(0, cut))
                yield solve(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _walk(reach: int, marked: bool, fresh: bool = False):
    """Follow the chain inside each group and keep the rows it visits.

    A group starts at its marker row (``_e`` not null); without markers it starts
    at its first row.  With ``fresh``, a group without marker starts at its first
    row of ``_g`` or later if none of its earlier rows silences that.  Only the
    state of the open group is kept between batches.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        never, none = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        # waits: the open group has shown only rows before ``_g`` so far, the last of them at open_before
        open_key, open_allow, open_before, waits = None, None, none, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k, g, e = batch.column("_k"), batch.column("_g"), batch.column("_e")
            start = _starts([k, g])
            end = np.append(start[1:], n)
            marker = e.is_valid().to_numpy(zero_copy_only=False)
            entry = e.fill_null(0).to_numpy(zero_copy_only=False)
            c = batch.column("_c").fill_null(0).to_numpy(zero_copy_only=False)
            o = c if fresh else batch.column("_o").fill_null(0).to_numpy(zero_copy_only=False)
            lo = start + marker[start].astype(np.int64)
            first = (k[0].as_py(), g[0].as_py())
            goes_on = first == open_key and not (marked and marker[0])
            if marked:
                allow = np.where(marker[start], entry[start], never)
            else:
                allow = np.full(len(start), none)
            if fresh:
                base = g.to_numpy(zero_copy_only=False)[start]
                own = _search(c, lo, end, base)
                before = np.where(own > lo, c[np.maximum(own - 1, 0)], none)
                if goes_on and waits:
                    before[0] = max(before[0], open_before)
                alone = (own < end) & (c[np.minimum(own, n - 1)] >= before + reach)
                allow = np.where(~marker[start] & alone, base, allow)
                settled = goes_on and not waits
                waits = bool(not marker[start[-1]] and own[-1] == end[-1] and not (settled and len(start) == 1))
                open_before = before[-1]
            else:
                settled = goes_on
            if settled:
                allow[0] = open_allow
            keep = np.zeros(n, dtype=bool)
            live = np.flatnonzero((allow != never) & (lo < end))
            while len(live):
                at = _search(c, lo[live], end[live], allow[live])
                hit = at < end[live]
                live, at = live[hit], at[hit]
                keep[at] = True
                allow[live] = o[at] + reach
                lo[live] = at + 1
            open_key, open_allow = (k[n - 1].as_py(), g[n - 1].as_py()), allow[-1]
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


# --------------------------------------------------------------------------- exponential moving average


def ewma(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    values: Mapping[str, str],
    alpha: float,
    cell: int,
    context: int = 0,
) -> DataFrame:
    """Exponential moving averages per key in order of ``position`` (bigint, unique per key).

    ``values`` maps output name to input column.  Adds ``n`` (1-based row index of
    the key), ``<name>`` and ``<name>_prior`` (average after and before the row);
    the first row seeds the average.  An average forgets by ``1 - alpha`` per row,
    so after B rows nothing above double precision is left of what came before:
    rows are grouped B by B, each group also sees the B rows before it, and no
    task ever holds a whole key.  Context rows stay in the result with ``own``
    false (at least ``context`` of them carry exact averages); ``part`` is the group.
    """
    keep = 1.0 - alpha
    if not 0.0 < keep < 1.0:
        raise ValueError("alpha must lie strictly between 0 and 1")
    size = int(np.ceil(46.0 / -np.log(keep))) + context
    indexed = running(df, keys, F.col(position), [position], {"n": ("sum", F.lit(1).cast("bigint"))}, cell)
    part = F.expr(f"(n - 1) div {size}")
    rows = indexed.select(
        "*",
        F.inline(
            F.array(
                F.struct(part.alias("part"), F.lit(True).alias("own")),
                F.struct((part + 1).alias("part"), F.lit(False).alias("own")),
            )
        ),
    )
    # exponent of a row, counted from the first context row of its group
    rank = (F.col("n") - 1 - (F.col("part") - 1) * size).cast("double")
    order = Window.partitionBy(*keys, "part").orderBy("n")
    total = order.rowsBetween(Window.unboundedPreceding, 0)
    weight = F.when(F.col("n") == 1, 1.0).otherwise(alpha)
    out = rows.withColumn("_rank", rank)
    for name, column in values.items():
        gain = F.sum(F.col(column) * weight * F.pow(F.lit(keep), -F.col("_rank"))).over(total)
        out = out.withColumn(name, gain * F.pow(F.lit(keep), F.col("_rank")))
    for name in values:
        out = out.withColumn(f"{name}_prior", F.lag(name).over(order))
    return out.drop("_rank")
