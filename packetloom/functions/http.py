"""HTTP framing and fields as column expressions on byte buffers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.packet import latin1, let, strip, utf8_lossy

CRLF = "\r\n"
BLANK_LINE = "\r\n\r\n"
# Methods that are matched, content type of encoded forms.
MATCHED_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD"]
FORM_TYPE = "application/x-www-form-urlencoded"
LOGIN_WORDS = ["login", "signin", "auth", "session"]
LOGIN_PORTS = [80, 8080, 8000, 443]


def _bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def _utf8(text: Column) -> Column:
    """Text of one-char-per-byte form as UTF-8."""
    return utf8_lossy(_bytes(text))


def _mid(text: Column, start: Column, end: Column) -> Column:
    """Characters [start, end), zero based."""
    return text.substr(start + 1, F.greatest(end - start, F.lit(0)))


def header_map(block: Column) -> Column:
    """Headers of a header block (one char per byte): lower-case names, the last value wins."""
    lines = F.filter(F.slice(F.split(block, CRLF), 2, 1 << 30), lambda line: line.contains(":"))
    pairs = F.transform(
        lines,
        lambda line: F.struct(
            F.lower(strip(_utf8(F.substring_index(line, ":", 1)))).alias("key"),
            strip(_utf8(line.substr(F.locate(":", line) + 1, F.length(line)))).alias("value"),
        ),
    )
    return let(
        pairs,
        lambda all_: F.map_from_entries(
            F.filter(
                all_,
                lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["key"] == p["key"]),
            )
        ),
    )


def _content_length(block: Column) -> Column:
    values = F.regexp_extract_all(
        block, F.lit(r"(?is)\r\n[ \t]*content-length[ \t]*:((?:(?!\r\n).)*)"), F.lit(1)
    )
    value = strip(F.try_element_at(values, F.lit(-1)))
    return F.when(F.size(values) > 0, F.greatest(F.coalesce(value.try_cast("int"), F.lit(0)), F.lit(0))).otherwise(0)


def _frames(text: Column, responses: bool) -> Column:
    """``struct(cursor, frames)``: messages as (start, header_end, end) positions.

    The cursor jumps from one blank line to the next, over the body announced by
    Content-Length, and stays in front of a message whose body is incomplete.
    """
    steps = ((F.length(text) - F.length(F.replace(text, F.lit(BLANK_LINE), F.lit("")))) / 4).cast("int")
    total = F.length(text)
    frame = "array<struct<start:int,header_end:int,stop:int>>"
    begin = F.struct(F.lit(0).alias("cursor"), F.lit(False).alias("stuck"), F.array().cast(frame).alias("frames"))

    def step(acc, _):
        cursor = acc["cursor"]

        def look(found):
            block = _mid(text, cursor, found)
            words = F.split(F.substring_index(block, CRLF, 1), " ")
            answer = F.upper(F.get(words, F.lit(0))).startswith("HTTP/")
            bad = ((F.size(words) < 2) | ~answer) if responses else (F.size(words) < 3)
            seen = F.struct(
                bad.alias("bad"),
                (F.lit(True) if responses else ~answer).alias("wanted"),
                (found + 4 + _content_length(block)).alias("stop"),
            )
            return let(seen, lambda m: advance(found, m))

        def advance(found, m):
            stuck = (found < 0) | (~m["bad"] & (m["stop"] > total))
            one = F.array(F.struct(cursor.alias("start"), found.alias("header_end"), m["stop"].alias("stop")))
            return F.struct(
                F.when(stuck, cursor).when(m["bad"], found + 4).otherwise(m["stop"]).alias("cursor"),
                stuck.alias("stuck"),
                F.when(stuck | m["bad"] | ~m["wanted"], acc["frames"])
                .otherwise(F.concat(acc["frames"], one))
                .alias("frames"),
            )

        here = F.call_function("locate", F.lit(BLANK_LINE), text, cursor + 1) - 1
        return F.when(acc["stuck"], acc).otherwise(let(here, look))

    return F.when(
        steps > 0, F.aggregate(F.sequence(F.lit(1), steps), begin, step, lambda a: a.dropFields("stuck"))
    ).otherwise(begin.dropFields("stuck"))


def dechunk(body: Column) -> Column:
    """Body of a chunked transfer (one char per byte); stops at the zero chunk or an incomplete one."""
    steps = ((F.length(body) - F.length(F.replace(body, F.lit(CRLF), F.lit("")))) / 2).cast("int")
    span = "array<struct<start:int,stop:int>>"
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast(span).alias("out"))

    def step(acc, _):
        at = acc["at"]

        def look(line_end):
            word = strip(F.substring_index(_mid(body, at, line_end), ";", 1))
            digits = F.regexp_replace(word, "^0+(?=.)", "")
            # a size of more digits than any body has bytes is one that the body does not hold
            size = F.when(F.length(digits) > 15, F.lit(1 << 60)).otherwise(F.conv(digits, 16, 10).cast("bigint"))
            return let(F.when(word.rlike("^[0-9A-Fa-f]+$"), size), lambda n: take(line_end, n))

        def take(line_end, size):
            data = line_end + 2
            done = (line_end < 0) | size.isNull() | (size == 0) | (data + size > F.length(body))
            return F.struct(
                F.when(done, at).otherwise((data + size + 2).cast("int")).alias("at"),
                done.alias("done"),
                F.when(done, acc["out"])
                .otherwise(F.concat(acc["out"], F.array(F.struct(data.alias("start"), (data + size).cast("int").alias("stop")))))
                .alias("out"),
            )

        here = F.call_function("locate", F.lit(CRLF), body, at + 1) - 1
        return F.when(acc["done"], acc).otherwise(let(here, look))

    # the fold carries positions; the chunks are cut and joined once
    spans = F.aggregate(F.sequence(F.lit(1), steps), begin, step, lambda a: a["out"])
    return F.when(steps > 0, F.array_join(F.transform(spans, lambda c: _mid(body, c["start"], c["stop"])), "")).otherwise(F.lit(""))


def request_fields(parts: Column) -> Column:
    """A request's fields from ``struct(block, body, raw)``, one character per byte.

    Chunked bodies are decoded; compressed bodies stay as they are with ``encoded`` set.
    """

    def named(p):
        return let(
            F.struct(F.split(_utf8(F.substring_index(p["block"], CRLF, 1)), " ").alias("words"), header_map(p["block"]).alias("headers")),
            lambda h: fields(p, h["words"], h["headers"]),
        )

    def fields(p, words, headers):
        chunked = F.lower(F.coalesce(headers["transfer-encoding"], F.lit(""))).contains("chunked")
        encoding = F.lower(F.coalesce(headers["content-encoding"], F.lit("")))
        return F.struct(
            F.get(words, F.lit(0)).alias("method"),
            F.get(words, F.lit(1)).alias("path"),
            F.get(words, F.lit(2)).alias("version"),
            headers.alias("headers"),
            _bytes(F.when(chunked, dechunk(p["body"])).otherwise(p["body"])).alias("body"),
            _bytes(p["raw"]).alias("raw"),
            encoding.rlike("gzip|deflate").alias("encoded"),
        )

    return let(parts, named)


def response_fields(parts: Column) -> Column:
    """A response's fields from ``struct(block, body, raw)``, one character per byte; its body is not decoded."""

    def fields(p, words):
        return F.struct(
            F.get(words, F.lit(0)).alias("version"),
            F.get(words, F.lit(1)).try_cast("int").alias("status_code"),
            F.array_join(F.slice(words, 3, 1 << 30), " ").alias("status_text"),
            header_map(p["block"]).alias("headers"),
            _bytes(p["body"]).alias("body"),
            _bytes(p["raw"]).alias("raw"),
        )

    return let(parts, lambda p: let(F.split(_utf8(F.substring_index(p["block"], CRLF, 1)), " "), lambda words: fields(p, words)))


def http_requests(buf: Column) -> Column:
    """``struct(consumed, messages)`` of the complete requests at the front of a byte buffer."""
    return _messages(buf, False, request_fields)


def http_responses(buf: Column) -> Column:
    """``struct(consumed, messages)`` of the complete responses in a byte buffer."""
    return _messages(buf, True, response_fields)


def _messages(buf: Column, responses: bool, fields) -> Column:
    def parts(text, f):
        return F.struct(
            _mid(text, f["start"], f["header_end"]).alias("block"),
            _mid(text, f["header_end"] + 4, f["stop"]).alias("body"),
            _mid(text, f["start"], f["stop"]).alias("raw"),
        )

    return let(
        latin1(buf),
        lambda text: let(
            _frames(text, responses),
            lambda parsed: F.struct(
                parsed["cursor"].alias("consumed"),
                F.transform(parsed["frames"], lambda f: fields(parts(text, f))).alias("messages"),
            ),
        ),
    )


def unquote_plus(text: Column) -> Column:
    """URL decoding with ``+`` as space; a bad escape stays as it is."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def request_carrier(request: Column) -> Column:
    """Bytes a rule is matched against for a request: head, body, decoded path and body."""
    head = F.concat_ws(" ", *[F.coalesce(request[n], F.lit("")) for n in ("method", "path", "version")])
    names = F.transform(F.map_entries(request["headers"]), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    text = utf8_lossy(request["body"])
    form = F.lower(F.coalesce(request["headers"]["content-type"], F.lit(""))).contains(FORM_TYPE)
    decoded = F.concat(unquote_plus(request["path"]), F.lit("\n"), F.when(form, unquote_plus(text)).otherwise(text))
    return F.concat(
        F.concat(head, F.lit(CRLF), F.array_join(names, CRLF), F.lit(BLANK_LINE)).cast("binary"),
        request["body"],
        F.concat(F.lit("\n\n"), decoded).cast("binary"),
    )


def response_carrier(response: Column) -> Column:
    """Bytes a rule is matched against for a response: the status line."""
    code = F.coalesce(response["status_code"].cast("string"), F.lit(""))
    return F.trim(F.concat_ws(" ", response["version"], code, response["status_text"])).cast("binary")


def payload_parts(payload: Column) -> Column:
    """``struct(method, uri, status_code, headers, cookie, body)`` of one HTTP message, null if it is none."""
    text = utf8_lossy(payload)
    lines = F.split(text, CRLF)
    words = F.split(strip(F.get(lines, F.lit(0))), r"\s+")
    answer = F.get(words, F.lit(0)).startswith("HTTP/")
    blank = F.array_position(lines, "").cast("int")  # 1-based, 0 if there is none
    head = F.slice(lines, 2, F.greatest(blank - 2, F.lit(0)))
    cookies = F.filter(head, lambda line: F.lower(line).startswith("cookie:"))
    cookie = F.get(cookies, F.lit(0))
    none = F.lit("")
    return F.when(
        (F.size(words) >= 3) & (blank > 0),
        F.struct(
            F.when(answer, none).otherwise(F.get(words, F.lit(0))).alias("method"),
            F.when(answer, none).otherwise(F.get(words, F.lit(1))).alias("uri"),
            F.when(answer, F.get(words, F.lit(1))).otherwise(none).alias("status_code"),
            F.array_join(head, CRLF).alias("headers"),
            F.coalesce(strip(cookie.substr(F.lit(8), F.length(cookie))), none).alias("cookie"),
            F.array_join(F.slice(lines, blank + 1, F.size(lines)), CRLF).alias("body"),
        ),
    )
