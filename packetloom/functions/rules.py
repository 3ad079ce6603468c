"""Column functions that turn the texts of a rule into values to match with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.packet import strip

ANY_ADDRESSES = (0, 2**32 - 1)


def literal_bytes(text: Column) -> Column:
    """Literal with ``|hex|`` blocks and ``\\xNN`` escapes resolved, one char per byte; bad hex stays."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)\|[^|]*\||\\x[0-9A-Fa-f]{2}|."), F.lit(0))

    def decode(token):
        digits = F.when(token.startswith("|"), F.translate(token, "| ", "")).otherwise(token.substr(3, 2))
        block = (token.startswith("|") & (F.length(token) > 1)) | (token.startswith("\\x") & (F.length(token) == 4))
        good = block & digits.rlike("^(?:[0-9A-Fa-f]{2})*$")
        return F.when(good, F.decode(F.unhex(digits), "ISO-8859-1")).otherwise(token)

    resolved = F.array_join(F.transform(tokens, decode), "")
    special = text.contains("|") | text.contains("\\x")
    return F.regexp_replace(F.when(special, resolved).otherwise(text), r"[^\x00-\xff]", "")


def java_regex(text: Column) -> Column:
    """``/body/flags`` as a Java regex with inline flags i, m, s, x; other text unchanged."""
    plain = strip(text)
    body = F.regexp_replace(F.regexp_extract(plain, r"(?s)^/(.*)/([^/]*)$", 1), r"\\/", "/")
    flags = F.regexp_replace(F.regexp_extract(plain, r"(?s)^/(.*)/([^/]*)$", 2), "[^imsx]", "")
    delimited = plain.rlike(r"(?s)^/.*/[^/]*$")
    return F.when(delimited, F.concat(F.when(flags != "", F.concat(F.lit("(?"), flags, F.lit(")"))).otherwise(""), body)).otherwise(plain)


def ip_number(ip: Column) -> Column:
    """IPv4 address as a number, null for anything else."""
    parts = F.split(ip, r"\.")
    number = sum(F.get(parts, F.lit(i)).try_cast("bigint") * 256 ** (3 - i) for i in range(4))
    valid = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    return F.when(valid, number)


def address_spec(text: Column) -> Column:
    """``array<struct<lo,hi,text,neg>>`` of an address text; empty for any.

    Accepts single addresses, CIDR blocks, ``[a,b]`` lists and ``!`` in front of
    either; what cannot be parsed is compared as text.
    """
    plain = strip(F.coalesce(text, F.lit("any")))
    items = F.filter(
        F.transform(F.split(F.regexp_replace(plain, r"^!?\[|\]$", ""), ","), strip), lambda item: item != ""
    )

    def parse(item):
        own = item.startswith("!")
        body = F.regexp_replace(item, "^!+", "")
        neg = F.when(plain.startswith("!["), ~own).otherwise(own)
        base = ip_number(F.substring_index(body, "/", 1))
        bits = F.when(body.contains("/"), F.substring_index(body, "/", -1).try_cast("int")).otherwise(32)
        size = F.when(bits.between(0, 32), F.pow(F.lit(2.0), 32 - bits).cast("bigint"))
        lo = F.when(body == "any", F.lit(ANY_ADDRESSES[0])).otherwise(base - base % size)
        hi = F.when(body == "any", F.lit(ANY_ADDRESSES[1])).otherwise(lo + size - 1)
        return F.struct(
            lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"), body.alias("text"), neg.alias("neg")
        )

    nothing = F.array().cast("array<struct<lo:bigint,hi:bigint,text:string,neg:boolean>>")
    return F.when(plain.isin("any", ""), nothing).otherwise(F.transform(items, parse))


def address_matches(spec: Column, ip: Column, number: Column) -> Column:
    """Some positive entry (if there are any) and no negative entry covers the address."""

    def hit(e):
        inside = (e["lo"] <= number) & (number <= e["hi"])
        return F.coalesce(F.when(e["lo"].isNotNull(), inside).otherwise(e["text"] == ip), F.lit(False))

    wanted = ~F.exists(spec, lambda e: ~e["neg"]) | F.exists(spec, lambda e: ~e["neg"] & hit(e))
    return (F.size(spec) == 0) | (ip.isNotNull() & wanted & ~F.exists(spec, lambda e: e["neg"] & hit(e)))


def port_items(text: Column) -> Column:
    """Port text as a list of items (``80``, ``21:23``, ``1024:``, each maybe with ``!``); null for any."""
    plain = strip(text)
    negated = plain.startswith("![")
    items = F.filter(
        F.transform(F.split(F.regexp_replace(plain, r"^!?\[|\]$", ""), ","), strip), lambda item: item != ""
    )
    items = F.transform(items, lambda i: F.when(negated & ~i.startswith("!"), F.concat(F.lit("!"), i)).otherwise(i))
    return F.when(plain.isNull() | plain.isin("any", ""), F.lit(None).cast("array<string>")).otherwise(items)


def port_spec(items: Column) -> Column:
    """``array<struct<lo,hi,neg>>`` of port items; an unreadable item never matches."""

    def parse(item):
        body = F.regexp_replace(item, "^!", "")
        start = F.regexp_extract(body, r"^(\d*)(:?)(\d*)$", 1)
        colon = F.regexp_extract(body, r"^(\d*)(:?)(\d*)$", 2)
        stop = F.regexp_extract(body, r"^(\d*)(:?)(\d*)$", 3)
        valid = body.rlike(r"^(?:\d{1,5}|\d{1,5}:\d{0,5}|:\d{1,5})$")
        lo = F.when(start == "", 0).otherwise(start.try_cast("int"))
        hi = F.when(colon == "", lo).when(stop == "", 65535).otherwise(stop.try_cast("int"))
        any_port = body == "any"
        return F.struct(
            F.when(any_port, 0).when(valid, lo).otherwise(-1).alias("lo"),
            F.when(any_port, 65535).when(valid, hi).otherwise(-1).alias("hi"),
            item.startswith("!").alias("neg"),
        )

    return F.transform(F.coalesce(items, F.array().cast("array<string>")), parse)


def port_matches(spec: Column, port: Column) -> Column:
    """Some positive range (if there are any) and no negative range covers the port."""

    def hit(p):
        return (p["lo"] <= port) & (port <= p["hi"])

    wanted = ~F.exists(spec, lambda p: ~p["neg"]) | F.exists(spec, lambda p: ~p["neg"] & hit(p))
    return (F.size(spec) == 0) | (port.isNotNull() & wanted & ~F.exists(spec, lambda p: p["neg"] & hit(p)))


def size_spec(text: Column) -> Column:
    """``struct<lo,hi,neg,valid>`` of a payload size text such as ``>100``, ``10<>20`` or ``!5``."""
    plain = F.regexp_replace(F.trim(text), " ", "")
    neg = plain.startswith("!")
    body = F.regexp_replace(plain, "^!", "")
    between = body.rlike(r"^\d+(?:<>|-)\d+$")
    left = F.regexp_extract(body, r"^(\d+)(?:<>|-)(\d+)$", 1).try_cast("bigint")
    right = F.regexp_extract(body, r"^(\d+)(?:<>|-)(\d+)$", 2).try_cast("bigint")
    op = F.regexp_extract(body, r"^(>=|<=|>|<|)(\d+)$", 1)
    number = F.regexp_extract(body, r"^(>=|<=|>|<|)(\d+)$", 2).try_cast("bigint")
    top = F.lit(2**62)
    lo = F.when(between, left).when(op.isin(">=", ""), number).when(op == ">", number + 1).otherwise(F.lit(0))
    hi = F.when(between, right).when(op.isin("<=", ""), number).when(op == "<", number - 1).otherwise(top)
    return F.when(
        text.isNotNull(),
        F.struct(
            lo.cast("bigint").alias("lo"),
            hi.cast("bigint").alias("hi"),
            neg.alias("neg"),
            (between | number.isNotNull()).alias("valid"),
        ),
    )


def size_matches(spec: Column, size: Column) -> Column:
    inside = (size >= spec["lo"]) & (size <= spec["hi"])
    return spec.isNull() | (spec["valid"] & (inside != spec["neg"]))


def flow_tokens(text: Column) -> Column:
    """Lower-case keywords of a flow option."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.lower(strip(t)))
    return F.filter(parts, lambda t: t != "")


def flow_matches(tokens: Column, direction: Column, established: Column, stream: Column) -> Column:
    """Flow keywords against the flow state; an unknown direction or state passes."""
    has = lambda name: F.array_contains(tokens, name)
    server, client = has("to_server") | has("from_client"), has("to_client") | has("from_server")
    wrong_way = (
        (server | client)
        & direction.isNotNull()
        & ~((server & (direction == "to_server")) | (client & (direction == "to_client")))
    )
    streamed = F.coalesce(stream, F.lit(False))
    wrong_state = ~has("stateless") & (
        (has("established") & F.coalesce(~established, F.lit(False)))
        | (has("not_established") & F.coalesce(established, F.lit(False)))
    )
    return ~(wrong_way | (has("only_stream") & ~streamed) | (has("no_stream") & streamed) | wrong_state)


def byte_test(payload: Column, test: Column) -> Column:
    """One unsigned numeric comparison at an absolute offset of the payload."""
    digits = F.hex(payload.substr(test["offset"] + 1, test["bytes"]))
    pairs = F.regexp_extract_all(digits, F.lit("[0-9A-F]{2}"), F.lit(0))
    ordered = F.when(test["endian"] == "little", F.array_join(F.reverse(pairs), "")).otherwise(digits)
    value = F.conv(ordered, 16, 10).cast("decimal(20,0)")
    target, op = test["value"], test["op"]
    # the unsigned 64-bit values as signed ones with the same bits
    both = _bits(value).bitwiseAND(_bits(target))
    result = (
        F.when(op == ">", value > target)
        .when(op == "<", value < target)
        .when(op == ">=", value >= target)
        .when(op == "<=", value <= target)
        .when(op.isin("=", "=="), value == target)
        .when(op.isin("!=", "!"), value != target)
        .when(op == "&", both == _bits(target))
        .when(op == "!&", both == 0)
        .otherwise(F.lit(False))
    )
    inside = (
        ~test["relative"]
        & (test["bytes"] > 0)
        & (test["bytes"] <= 8)
        & (test["offset"] >= 0)
        & (test["offset"] + test["bytes"] <= F.length(payload))
    )
    return F.coalesce(F.when(inside, result), F.lit(False))


def _bits(value: Column) -> Column:
    half = F.lit(str(2**63)).cast("decimal(20,0)")
    return F.when(value >= half, (value - half - half).cast("bigint")).otherwise(value.cast("bigint"))
