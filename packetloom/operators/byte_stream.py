"""TCP byte streams by position: sequence numbers without wrap, release times, lines, HTTP messages.

No step brings the bytes of a whole connection together. A stream is cut into blocks of fixed size; lines, header ends
and messages are rows of positions, and only what is finally wanted (one message, one line) is cut out of its blocks.
A stream is named by ``flow``; positions are sequence numbers that go on beyond 2**32.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.http import request_fields, response_fields
from packetloom.functions.packet import latin1, let, strip
from packetloom.operators.materialize import materialize
from packetloom.operators.windows import running

WRAP = 1 << 32
ARRIVALS = 4096  # arrivals in one cell of the prefix scan
CELL = 1 << 20
BLOCK = 1 << 16  # bytes of a block
OVER = 64  # bytes that a block shows of the next ones, so that short marks are seen whole


def _signed(difference: Column) -> Column:
    """A distance of sequence numbers, as the nearer way around."""
    return F.pmod(difference + WRAP // 2, F.lit(WRAP)) - WRAP // 2


def unwrapped(segments: DataFrame) -> DataFrame:
    """``segments`` (``flow, arrival, seq`` and others) with ``seq`` going on where sequence numbers begin anew.

    A prefix sum of the signed 32-bit differences between consecutive arrivals: sums inside cells of arrivals, then over
    the cells of a flow. Each step may be up to 2 GiB either way; a flow may be of any length.
    """
    columns = segments.columns
    cell = F.expr(f"cast(arrival as bigint) div {ARRIVALS}")
    rows = segments.withColumn("seq", F.col("seq").cast("bigint")).withColumn("_cell", cell)
    inside = Window.partitionBy("flow", "_cell").orderBy("arrival", "seq")
    step = F.coalesce(_signed(F.col("seq") - F.lag("seq").over(inside)), F.lit(0))
    rows = rows.withColumn("_step", step).withColumn("_inner", F.sum("_step").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct("arrival", "seq")
    cells = rows.groupBy("flow", "_cell").agg(F.min_by("seq", order).alias("_first"), F.max_by("seq", order).alias("_last"), F.sum("_step").alias("_sum"))
    by_flow = Window.partitionBy("flow").orderBy("_cell")
    moved = F.coalesce(F.lag("_sum").over(by_flow) + _signed(F.col("_first") - F.lag("_last").over(by_flow)), F.col("_first"))
    cells = cells.select("flow", "_cell", moved.alias("_moved")).select(
        "flow", "_cell", F.sum("_moved").over(by_flow.rowsBetween(Window.unboundedPreceding, 0)).alias("_from")
    )
    placed = rows.join(cells, ["flow", "_cell"]).withColumn("seq", F.col("_from") + F.col("_inner"))
    return placed.select(*columns)


def releases(segments: DataFrame) -> DataFrame:
    """Pieces of new data with the arrival that released them: ``flow, start, stop, arrival, skip, released``.

    ``segments`` has ``flow, arrival, seq, size`` and no data. A stream starts at the segment that arrived first; what
    lies before is dropped. A byte is released as soon as it and all bytes before it have arrived: by the running
    greatest of first arrivals. It comes from the segment with the smallest sequence number then present, of those the
    longest; ``arrival`` and ``skip`` say which segment and how many of its bytes come before. Nothing is released
    behind a hole. ``arrival`` tells segments of a flow apart.
    """
    seen = materialize(unwrapped(segments.filter("size > 0").select("flow", "arrival", "seq", F.col("size").cast("bigint").alias("size"))))
    base = seen.groupBy("flow").agg(F.min_by("seq", F.struct("arrival", "seq")).alias("_base"))
    shapes = seen.groupBy("flow", "seq", "size").agg(F.min("arrival").alias("arrival")).join(base, "flow")
    shapes = shapes.select("flow", "arrival", "seq", "size", F.greatest("seq", "_base").alias("lo"), (F.col("seq") + F.col("size")).alias("hi")).filter("hi > lo")
    shapes = materialize(shapes)
    # between two neighbouring starts or ends, the same segments lie over all bytes
    ends = shapes.select("flow", F.explode(F.array("lo", "hi")).alias("at")).distinct()
    spans = running(ends, ["flow"], F.col("at"), ["at"], {"_from": ("max", F.col("at"))}, CELL, include_current=False)
    spans = materialize(spans.filter("_from is not null").select("flow", F.col("_from").alias("start"), F.col("at").alias("stop")))
    # segments meet spans in cells that are up to four times as wide as the segment; a span is in one cell of each width
    # that its flow has
    sized = shapes.withColumn("_width", F.expr("shiftleft(1L, 2 * cast((length(bin(hi - lo)) + 1) div 2 as int))"))
    over = sized.withColumn("_near", F.explode(F.expr("sequence(lo div _width, (hi - 1) div _width)")))
    widths = sized.select("flow", "_width").distinct()
    wide = spans.join(widths, "flow").withColumn("_near", F.expr("start div _width"))
    meet = wide.join(over, ["flow", "_width", "_near"]).filter("start >= lo and start < hi").select("flow", "start", "stop", "arrival", "seq", "size")
    covers = materialize(meet)
    every = covers.select("flow", "start", "stop", "arrival").unionByName(spans.withColumn("arrival", F.lit(None)))
    first = every.groupBy("flow", "start", "stop").agg(F.min("arrival").alias("_first"))
    holes = first.filter("_first is null").groupBy("flow").agg(F.min("start").alias("_hole"))
    known = first.join(holes, "flow", "left").filter("_hole is null or start < _hole").select("flow", "start", "_first")
    out = running(known, ["flow"], F.col("start"), ["start"], {"released": ("max", F.col("_first"))}, CELL).select("flow", "start", "released")
    best = F.min(F.struct("seq", (-F.col("size")).alias("longest"), "arrival")).alias("_best")
    pieces = covers.join(out, ["flow", "start"]).filter("arrival <= released").groupBy("flow", "start", "stop", "released").agg(best)
    return pieces.select("flow", "start", "stop", F.col("_best.arrival").alias("arrival"), (F.col("start") - F.col("_best.seq")).alias("skip"), "released")


def piece_data(segments: DataFrame, pieces: DataFrame) -> DataFrame:
    """The pieces with their bytes as ``data``, from the segments' (``flow, arrival, data``)."""
    cut = F.substring("data", (F.col("skip") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    return segments.select("flow", "arrival", "data").join(pieces, ["flow", "arrival"]).withColumn("data", cut)


def _joined(pieces: Column) -> Column:
    """Text of one character per byte of collected structs (position, text)."""
    return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["text"]), "")


def released_chunks(segments: DataFrame) -> DataFrame:
    """``flow, arrival, start, data``: the bytes that each arriving segment (``flow, arrival, seq, data``) releases, as one value.

    A segment that closes a hole releases what waited behind it too; one that brings nothing new gives no row.
    """
    return chunks_of(segments, releases(segments.select("flow", "arrival", "seq", F.length("data").alias("size"))))


def chunks_of(segments: DataFrame, pieces: DataFrame) -> DataFrame:
    """``flow, arrival, start, data``: the bytes of pieces, as from ``releases``, put together by the arrival that released them."""
    data = piece_data(segments, pieces)
    text = _joined(F.collect_list(F.struct("start", latin1(F.col("data")).alias("text"))))
    chunks = data.groupBy("flow", "released").agg(F.min("start").alias("start"), text.alias("_text"))
    return chunks.select("flow", F.col("released").alias("arrival"), "start", F.encode("_text", "ISO-8859-1").alias("data"))


def blocks(pieces: DataFrame) -> DataFrame:
    """``flow, block, text``: the streams of pieces (``flow, start, data``) in blocks, written.

    Block k shows the bytes from k * BLOCK on, with the first ``OVER`` of the next block; one character per byte.
    """
    ends = pieces.select("flow", "start", "data", (F.col("start") + F.length("data")).alias("_stop")).filter("_stop > start")
    dealt = ends.withColumn("block", F.explode(F.expr(f"sequence(greatest(start - {OVER - 1}, 0) div {BLOCK}, (_stop - 1) div {BLOCK})")))
    begin = F.greatest(F.col("start"), F.col("block") * BLOCK)
    end = F.least(F.col("_stop"), F.col("block") * BLOCK + (BLOCK + OVER))
    part = F.substring("data", (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int"))
    shown = dealt.select("flow", "block", begin.alias("start"), latin1(part).alias("text"))
    gathered = shown.groupBy("flow", "block").agg(_joined(F.collect_list(F.struct("start", "text"))).alias("text"), F.min("start").alias("from"))
    # where a stream begins right behind a border, the block before it would hold nothing of its own
    return materialize(gathered.filter(F.col("from") < (F.col("block") + 1) * BLOCK))


def lines(stream: DataFrame) -> DataFrame:
    """``flow, at, spaces, ends_header, length``: every CRLF of the blocks, in its own block.

    ``at``: its position; ``spaces``: blanks of the block before it; ``ends_header``: whether another CRLF follows;
    ``length``: announced by the header line behind it, if that is Content-Length, and null otherwise.
    """
    parts = F.split("text", "\r\n", -1)
    rows = stream.select("flow", "block", "from", F.posexplode(parts).alias("no", "line"))
    blanks = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    named = F.col("line").rlike(r"(?i)^[ \t]*content-length[ \t]*:")
    short = F.lit("content-length:").startswith(F.lower(F.regexp_replace("line", r"[ \t]+", "")))
    # what is asked of a line is worked out before lines meet their neighbours, so that no line itself is shuffled or sorted
    told = rows.select(
        "flow",
        "block",
        "from",
        "no",
        F.length("line").alias("_size"),
        blanks.alias("_spaces"),
        named.alias("_named"),
        F.when(named, _length_of(F.col("line"))).alias("_value"),
        F.when(F.col("line").rlike(r"^[ \t]*([cC]|$)"), short).otherwise(False).alias("_short"),
    )
    inside = Window.partitionBy("flow", "block").orderBy("no")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    found = told.select(
        "flow",
        "block",
        (F.col("from") + F.sum(F.col("_size") + 2).over(upto) - 2).alias("at"),
        F.sum("_spaces").over(upto).cast("bigint").alias("spaces"),
        *[F.lead(c).over(inside).alias(c) for c in ("_size", "_named", "_value", "_short")],
        F.lead("_size", 2).over(inside).isNotNull().alias("_closed"),
    )
    # the last part has no CRLF behind it, and what is shown of the next block has its marks there
    found = found.filter(F.col("_size").isNotNull() & (F.col("at") < (F.col("block") + 1) * BLOCK))
    ends = (F.col("_closed") & (F.col("_size") == 0)).alias("ends_header")
    perhaps = ~F.col("_closed") & (F.col("_named") | F.col("_short"))
    return found.select("flow", "at", "spaces", ends, F.when(F.col("_closed") & F.col("_named"), F.col("_value")).alias("length"), perhaps.alias("_open"))


def _length_of(line: Column) -> Column:
    value = strip(F.regexp_extract(line, r"(?is)^[ \t]*content-length[ \t]*:(.*)$", 1))
    return F.greatest(F.coalesce(value.try_cast("bigint"), F.lit(0)), F.lit(0))


def cut(stream: DataFrame, ranges: DataFrame) -> DataFrame:
    """The ranges (``flow, begin, end``, which may be empty, and others) with their bytes as ``text``."""
    ranges = materialize(ranges)
    first, last = F.expr(f"begin div {BLOCK}"), F.expr(f"greatest(begin, end - 1) div {BLOCK}")
    held = stream.select(F.col("flow").alias("_flow"), F.col("block").alias("_at"), "from", F.col("text").alias("_text"))

    def parts(wanted: DataFrame) -> DataFrame:
        met = wanted.join(held, (F.col("flow") == F.col("_flow")) & (F.col("_block") == F.col("_at")))
        begin = F.greatest(F.col("begin"), F.col("from"))
        end = F.least(F.col("end"), (F.col("_block") + 1) * BLOCK)
        part = F.substring("_text", (begin - F.col("from") + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))
        return met.select(*ranges.columns, begin.alias("_begin"), part.alias("text"))

    # a range inside a block is whole at once; others are put together from their blocks
    whole = parts(ranges.filter(first == last).withColumn("_block", first)).drop("_begin")
    several = parts(ranges.filter(first != last).withColumn("_block", F.explode(F.sequence(first, last))))
    pieces = F.collect_list(F.struct(F.col("_begin").alias("start"), "text"))
    return whole.unionByName(several.groupBy(*ranges.columns).agg(_joined(pieces).alias("text")))


def arrival_at(pieces: DataFrame, positions: DataFrame, at: str) -> DataFrame:
    """The positions (``flow``, ``at`` and others) with the arrival that released the byte there, as ``arrival``."""
    columns = positions.columns
    starts = pieces.select("flow", F.col("start").alias(at), F.col("released").alias("_released"))
    both = starts.withColumn("_asks", F.lit(0)).unionByName(positions.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    last = F.when(F.col("_asks") == 0, F.struct(F.col(at).alias("start"), F.col("_released").alias("released")))
    found = running(both, ["flow"], F.col(at), [at, "_asks"], {"_piece": ("max", last)}, CELL)
    return found.filter("_asks = 1").select(*columns, F.col("_piece.released").alias("arrival"))


def stream_lines(stream: DataFrame) -> DataFrame:
    """``flow, begin, end``: every line that a CRLF ends, without it. The first line of a stream begins where its first block does."""
    marks = lines(stream).select("flow", "at")
    before = running(marks, ["flow"], F.col("at"), ["at"], {"_before": ("max", F.col("at"))}, CELL, include_current=False)
    origin = stream.groupBy("flow").agg(F.min("from").alias("_origin"))
    return before.join(origin, "flow").select("flow", F.coalesce(F.col("_before") + 2, F.col("_origin")).alias("begin"), F.col("at").alias("end"))


def _candidate_starts(stream: DataFrame, marks: DataFrame) -> DataFrame:
    """``flow, at``: wherever a message can begin: at the stream's start, behind each header, behind the body that it can announce."""
    last = F.when(F.col("length").isNotNull(), F.struct("at", "length"))
    ends = running(marks, ["flow"], F.col("at"), ["at"], {"_last": ("max", last)}, CELL, include_current=False).filter("ends_header")
    behind = F.array(F.col("at") + 4, F.col("at") + 4 + F.coalesce("_last.length", F.lit(0)))
    origin = stream.groupBy("flow").agg(F.min("from").alias("at"))
    return ends.select("flow", F.explode(behind).alias("at")).unionByName(origin).distinct()


def message_nodes(stream: DataFrame) -> DataFrame:
    """Every place of the streams where a message can begin, with what stands there, written; for ``message_frames``.

    ``flow, start, header_end, _total``, the first bytes (``_head``), the words of the first line, its CRLF (``_line_end``)
    and the announced length.
    """
    marks = materialize(_with_open_lines(stream, lines(stream)))
    totals = stream.groupBy("flow").agg(F.max(F.col("from") + F.length("text")).alias("_total"))
    starts = _candidate_starts(stream, marks).join(totals, "flow").filter("at <= _total")
    # blanks before each block, so that those of a line over several blocks are a difference
    own = F.col("text").substr(F.lit(1), ((F.col("block") + 1) * BLOCK - F.col("from")).cast("int"))
    blanks = stream.select("flow", "block", (F.length(own) - F.length(F.replace(own, F.lit(" "), F.lit("")))).cast("bigint").alias("_own"))
    before = running(blanks, ["flow"], F.col("block"), ["block"], {"_blanks": ("sum", F.col("_own"))}, ARRIVALS, include_current=False)
    before = materialize(before.select("flow", "block", F.coalesce("_blanks", F.lit(0)).cast("bigint").alias("_blanks")))
    marks = marks.withColumn("block", F.expr(f"at div {BLOCK}")).join(before, ["flow", "block"]).withColumn("spaces", F.col("spaces") + F.col("_blanks")).drop("block", "_blanks")
    # what stands at a start: the blanks before it and the first bytes
    held = stream.select("flow", "block", "from", "text").join(before, ["flow", "block"])
    at_start = starts.withColumn("block", F.expr(f"at div {BLOCK}")).join(held, ["flow", "block"])
    into = (F.col("at") - F.col("from")).cast("int")
    head = F.col("text").substr(F.lit(1), into)
    at_start = at_start.select(
        "flow",
        "at",
        "_total",
        (F.col("_blanks") + F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))).alias("spaces"),
        F.upper(F.col("text").substr(into + 1, F.lit(5))).alias("_head"),
    )
    # from the end back: the next CRLF and the next header end at or behind each start, and the last length before the latter
    last = F.when(F.col("length").isNotNull(), F.struct(F.col("at").alias("line"), "length"))
    told = running(marks, ["flow"], F.col("at"), ["at"], {"_last": ("max", last)}, CELL, include_current=False)
    rows = told.select("flow", "at", "spaces", F.lit(0).alias("_start"), "ends_header", "_last").unionByName(at_start.withColumn("_start", F.lit(1)), allowMissingColumns=True)
    back = -F.col("at")
    mark = F.col("_start") == 0
    crlf = F.when(mark, F.struct("at", "spaces"))
    end = F.when(mark & F.col("ends_header"), F.struct("at", "_last"))
    nodes = running(rows, ["flow"], back, [F.col("at").desc(), "_start"], {"_crlf": ("min", crlf), "_end": ("min", end)}, CELL)
    words = F.col("_crlf.spaces") - F.col("spaces") + 1
    length = F.when(F.col("_end._last.line") >= F.col("at"), F.col("_end._last.length")).otherwise(0)
    found = nodes.filter("_start = 1 and _end is not null")
    return materialize(
        found.select(
            "flow", F.col("at").alias("start"), F.col("_end.at").alias("header_end"), "_total", "_head",
            words.alias("_words"), F.col("_crlf.at").alias("_line_end"), length.alias("_length"),
        )
    )


def message_frames(stream: DataFrame, responses: bool, nodes: DataFrame | None = None) -> DataFrame:
    """``flow, start, header_end, stop`` of the complete requests or responses in the blocks of streams.

    A message ends with the body that the last Content-Length line of its header announces; the next one begins there.
    Header blocks that are no message are passed over, and nothing follows a message whose body is incomplete. Every
    possible start points to the one after it; the starts that follow from a stream's first one are found by doubling
    the pointers, in as many rounds as a chain's length has binary digits. ``nodes`` are the stream's ``message_nodes``,
    where they are at hand already.
    """
    nodes = message_nodes(stream) if nodes is None else nodes
    answer = (F.col("_head") == "HTTP/") & (F.col("_line_end") >= F.col("start") + 5)
    bad = ((F.col("_words") < 2) | ~answer) if responses else (F.col("_words") < 3)
    wanted = F.lit(True) if responses else ~answer
    stop = F.when(bad, F.col("header_end") + 4).otherwise(F.col("header_end") + 4 + F.col("_length"))
    nodes = nodes.select("flow", "start", "header_end", stop.alias("stop"), (~bad & wanted).alias("_wanted"), "_total").filter("stop <= _total")
    origin = materialize(stream.groupBy("flow").agg(F.min("from").alias("start")))
    reached = _followed(nodes.select("flow", "start", F.col("stop").alias("next")), origin)
    return nodes.filter("_wanted").join(reached, ["flow", "start"], "left_semi").select("flow", "start", "header_end", "stop")


def http_messages(stream: DataFrame, responses: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """``flow, begin, end, m``: the complete HTTP requests or responses in the blocks of streams, with their positions.

    ``m`` is as one of ``http_requests`` or ``http_responses``. Only a single message is ever brought together.
    ``nodes`` as for ``message_frames``.
    """
    frames = message_frames(stream, responses, nodes).select("flow", F.col("start").alias("begin"), F.col("stop").alias("end"), "header_end")
    head = (F.col("header_end") - F.col("begin")).cast("int")
    block, body = F.col("text").substr(F.lit(1), head), F.col("text").substr(head + 5, F.length("text"))
    fields = response_fields if responses else request_fields
    message = let(F.struct(block.alias("block"), body.alias("body"), F.col("text").alias("raw")), fields)
    return cut(stream, frames).select("flow", "begin", "end", message.alias("m"))


def _followed(pointers: DataFrame, origin: DataFrame) -> DataFrame:
    """``flow, start`` of all starts that the pointers (``flow, start, next``) lead to from the origins, these included."""
    reached, jumps = origin, pointers
    while True:
        # the first n starts of each chain are reached, and pointers lead n starts on
        further = materialize(reached.join(jumps, ["flow", "start"]).select("flow", F.col("next").alias("start")))
        if further.isEmpty():
            return reached
        reached = reached.unionByName(further)
        after = jumps.select("flow", F.col("start").alias("next"), F.col("next").alias("_then"))
        jumps = materialize(jumps.join(after, ["flow", "next"]).select("flow", "start", F.col("_then").alias("next")))


def _with_open_lines(stream: DataFrame, marks: DataFrame) -> DataFrame:
    """The marks with the lengths of those header lines that go on beyond what their block shows."""
    marks = materialize(marks)
    ends = marks.select("flow", "at")
    open_lines = marks.filter("_open").select("flow", (F.col("at") + 2).alias("begin"))
    rows = open_lines.select("flow", F.col("begin").alias("at"), F.lit(1).alias("_line")).unionByName(ends.withColumn("_line", F.lit(0)))
    after = running(rows, ["flow"], -F.col("at"), [F.col("at").desc(), "_line"], {"end": ("min", F.when(F.col("_line") == 0, F.col("at")))}, CELL)
    ranges = after.filter("_line = 1 and end is not null").select("flow", F.col("at").alias("begin"), "end")
    texts = cut(stream, ranges).filter(F.col("text").rlike(r"(?i)^[ \t]*content-length[ \t]*:"))
    found = texts.select("flow", (F.col("begin") - 2).alias("at"), _length_of(F.col("text")).alias("_length"))
    return marks.join(found, ["flow", "at"], "left").withColumn("length", F.coalesce("length", "_length")).drop("_length", "_open")
