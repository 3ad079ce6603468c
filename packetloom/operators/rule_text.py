"""Rule text to rule rows: one pass of string expressions, no parser per row in Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.packet import strip
from packetloom.functions.rules import literal_bytes, port_items
from packetloom.operators.joins import lookup_join
from packetloom.operators.materialize import materialize
from packetloom.schemas import BYTE_TEST, ISDATAAT

# Rule line shape, option patterns, variables, class tables.
RULE_LINE = r"^(\w+)\s+(\w+)\s+(\S+)\s+(\S+)\s+(->|<>)\s+(\S+)\s+(\S+)\s*\((.*)\)$"
HEADER_FIELDS = ["action", "protocol", "src", "src_port", "direction", "dst", "dst_port", "options"]
OPTION_PATTERNS = {
    "msg": r'msg:"([^"]*)";',
    "pcre": r'pcre:"([^"]*)";',
    "sid": r"sid:(\d+);",
    "rev": r"rev:(\d+);",
    "gid": r"gid:(\d+);",
    "priority": r"priority:(\d+);",
    "classtype": r"classtype:([^;]+);",
    "threshold": r"threshold:\s*([^;]+);",
    "metadata": r"metadata:([^;]+);",
    "reference": r"reference:([^;]+);",
    "ip_proto": r"(?:^|;)\s*ip_proto:([^;]+);",
    "flow": r"(?:^|;)\s*flow:([^;]+);",
    "flags": r"flags:([^;]+);",
    "ip_id": r"(?:^|;)\s*id:(\d+);",
    "dsize": r"dsize:([^;]+);",
    "isdataat": r"(?:^|;)\s*isdataat:([^;]+);",
    "service": r"service:([^;]+);",
    "app_layer_protocol": r"app-layer-protocol:([^;]+);",
    "ssl_version": r"ssl_version:([^;]+);",
    "byte_test": r"byte_test:([^;]+);",
}
CONTENT_PART = r'^(?i:content):(?:"([^"]*)"|([^;]*))(?:,([^;]+))?'
ENDS_CONTENT = (
    r"^(?:content:|msg:|sid:|rev:|gid:|classtype:|metadata:|reference:|pcre:|flow:|flags:|dsize:|ip_proto:|"
    r"isdataat:|threshold:|service:|ssl_version:|app-layer-protocol:)"
)
MODIFIERS = ["offset", "depth", "within", "distance"]
DEFAULT_VARIABLES = {
    "$HOME_NET": "192.168.0.0/16",
    "$EXTERNAL_NET": "!$HOME_NET",
    "$HTTP_SERVERS": "$HOME_NET",
    "$SQL_SERVERS": "$HOME_NET",
    "$SMTP_SERVERS": "$HOME_NET",
    "$DNS_SERVERS": "any",
    "$TELNET_SERVERS": "$HOME_NET",
    "$SNMP_SERVERS": "$HOME_NET",
    "$FTP_SERVERS": "$HOME_NET",
    "$SSH_SERVERS": "$HOME_NET",
    "$SIP_SERVERS": "$HOME_NET",
    "$HTTP_PORTS": "80,443",
    "$SHELLCODE_PORTS": "!80",
    "$ORACLE_PORTS": "1521",
    "$SSH_PORTS": "22",
    "$FTP_PORTS": "21,2100,3535",
    "$SIP_PORTS": "5060,5061",
    "$FILE_DATA_PORTS": "110,143",
    "$GTP_PORTS": "2123,2152,3386",
}
CLASS_PRIORITY = {
    "attempted-admin": 1,
    "successful-admin": 1,
    "attempted-user": 2,
    "successful-user": 2,
    "policy-violation": 3,
    "attempted-dos": 2,
    "successful-dos": 1,
    "attempted-recon": 3,
    "successful-recon": 2,
    "bad-unknown": 3,
    "default": 3,
}
CLASS_CATEGORY = {
    "web-application-attack": "web",
    "attempted-admin": "admin",
    "successful-admin": "admin",
    "attempted-user": "user",
    "successful-user": "user",
    "policy-violation": "policy",
    "attempted-dos": "dos",
    "successful-dos": "dos",
    "attempted-recon": "recon",
    "successful-recon": "recon",
    "bad-unknown": "unknown",
}
UNSUPPORTED_PATTERN = "__UNSUPPORTED_SNORT_RULE__"
BYTE_TEST_PATTERN = "__BYTE_TEST_ONLY__"
NO_PATTERN_REASON = "unsupported: no content/pcre/uricontent/http_stat_code/content_hex/byte_test"

_ITEM = "struct<content:string,offset:int,depth:int,within:int,distance:int,nocase:boolean>"


def _lookup(table: dict, key: Column, otherwise) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out.otherwise(otherwise)


def class_priority(classtype: Column) -> Column:
    return _lookup(CLASS_PRIORITY, classtype, 3)


def class_category(classtype: Column) -> Column:
    return _lookup(CLASS_CATEGORY, classtype, "unknown")


def split_header(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds the eight header fields and ``parsed``; drops blank and comment lines."""
    text = strip(F.col(line))
    rules = lines.withColumn(line, text).filter((F.col(line) != "") & ~F.col(line).startswith("#"))
    parsed = F.col(line).rlike(RULE_LINE)
    fields = {n: F.when(parsed, F.regexp_extract(line, RULE_LINE, i + 1)) for i, n in enumerate(HEADER_FIELDS)}
    return rules.withColumns({"parsed": parsed, **fields})


def option_values(options: Column, name: str) -> Column:
    """All values of an option in the order they stand."""
    return F.regexp_extract_all(F.coalesce(options, F.lit("")), F.lit(OPTION_PATTERNS[name]), F.lit(1))


def option_flag(options: Column, name: str) -> Column:
    return F.coalesce(options.contains(name + ";"), F.lit(False))


def _modified(item: Column, token: Column) -> tuple[Column, Column]:
    """(applied, changed item) for one modifier token."""
    plain = strip(token)
    name = F.lower(F.regexp_extract(plain, r"^(\w+)(?::\s*| \s*)([+-]?\d+)$", 1))
    number = F.regexp_extract(plain, r"^(\w+)(?::\s*| \s*)([+-]?\d+)$", 2).try_cast("int")
    nocase = F.lower(plain) == "nocase"
    applied = nocase | (name.isin(MODIFIERS) & number.isNotNull())
    changed = F.struct(
        item["content"].alias("content"),
        *[F.when(name == m, number).otherwise(item[m]).alias(m) for m in MODIFIERS],
        F.when(nocase, F.lit(True)).otherwise(item["nocase"]).alias("nocase"),
    )
    return applied, F.when(applied, changed).otherwise(item)


def content_items(options: Column) -> Column:
    """Content literals with the modifiers that follow them, in order.

    A modifier belongs to the content before it, inline after a comma or as an
    option of its own; the first other option ends the run of modifiers.
    """
    parts = F.filter(F.transform(F.split(options, ";"), strip), lambda p: p != "")
    begin = F.struct(F.array().cast(f"array<{_ITEM}>").alias("items"), F.lit(False).alias("open"))

    def step(acc, part):
        quoted = F.regexp_extract(part, CONTENT_PART, 1)
        text = F.when(quoted != "", quoted).otherwise(F.regexp_extract(part, CONTENT_PART, 2))
        inline = F.split(F.regexp_extract(part, CONTENT_PART, 3), ",")
        fresh = F.struct(
            text.alias("content"),
            *[F.lit(None).cast("int").alias(m) for m in MODIFIERS],
            F.lit(False).alias("nocase"),
        ).cast(_ITEM)
        fresh = F.aggregate(inline, fresh, lambda item, token: _modified(item, token)[1])
        starts = part.startswith("content:")
        n = F.size(acc["items"])
        applied, changed = _modified(F.try_element_at(acc["items"], F.lit(-1)), part)
        extends = acc["open"] & ~F.lower(part).rlike(ENDS_CONTENT) & applied
        return F.struct(
            F.when(starts & (text != ""), F.concat(acc["items"], F.array(fresh)))
            .when(~starts & extends, F.concat(F.slice(acc["items"], 1, n - 1), F.array(changed)))
            .otherwise(acc["items"])
            .alias("items"),
            F.when(starts, text != "").otherwise(extends).alias("open"),
        )

    return F.aggregate(parts, begin, step, lambda acc: acc["items"])


def byte_tests(raws: Column) -> Column:
    """``bytes,op,value,offset[,flags]`` texts as structs; unreadable ones are dropped."""

    def parse(raw):
        parts = F.filter(F.transform(F.split(raw, ","), strip), lambda p: p != "")
        flags = F.transform(F.slice(parts, 5, F.size(parts)), F.lower)
        text = F.get(parts, F.lit(2))
        hexed = F.array_contains(flags, "hex") | F.lower(text).startswith("0x")
        digits = F.regexp_replace(text, "^0[xX]", "")
        value = F.when(hexed & digits.rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(digits, 16, 10)).otherwise(text)
        return F.when(
            F.size(parts) >= 4,
            F.struct(
                F.get(parts, F.lit(0)).try_cast("int").alias("bytes"),
                F.get(parts, F.lit(1)).alias("op"),
                value.try_cast("decimal(20,0)").alias("value"),
                F.get(parts, F.lit(3)).try_cast("int").alias("offset"),
                F.array_contains(flags, "relative").alias("relative"),
                F.when(F.array_contains(flags, "little"), "little").otherwise("big").alias("endian"),
                raw.alias("raw"),
            ).cast(BYTE_TEST),
        )

    return F.filter(
        F.transform(raws, parse), lambda t: t["bytes"].isNotNull() & t["value"].isNotNull() & t["offset"].isNotNull()
    )


def data_checks(raws: Column) -> Column:
    """``[!]offset[,relative]`` texts as structs; unreadable ones are dropped."""

    def parse(raw):
        parts = F.filter(F.transform(F.split(raw, ","), strip), lambda p: p != "")
        first = F.get(parts, F.lit(0))
        flags = F.transform(F.slice(parts, 2, F.size(parts)), F.lower)
        return F.struct(
            F.regexp_replace(first, "^!", "").try_cast("int").alias("offset"),
            first.startswith("!").alias("negated"),
            F.array_contains(flags, "relative").alias("relative"),
            raw.alias("raw"),
        ).cast(ISDATAAT)

    return F.filter(F.transform(raws, parse), lambda c: c["offset"].isNotNull())


def default_variables(spark) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_VARIABLES.items()), "name string, value string")


def effective_variables(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """Defaults overridden by stored values."""
    theirs = stored.select("name", F.col("value").alias("_stored"))
    return defaults.join(theirs, "name", "full_outer").select(
        "name", F.coalesce("_stored", "value").alias("value")
    )


def set_variable(stored: DataFrame, name: str, value: str) -> DataFrame:
    """Stored variables with one value written (inserted or replaced)."""
    row = stored.sparkSession.createDataFrame([(name, value)], "name string, value string")
    return stored.select("name", "value").filter(F.col("name") != name).unionByName(row)


MEMBERS = "array<struct<signs:int,item:string>>"


def list_members(text: Column) -> Column:
    """Members of an address or port text as ``array<struct<signs,item>>``: lists may be nested, ``!`` stands before members or lists.

    ``signs``: the ``!`` before the item. Inside lists two cancel each other; before a single item they stay as written.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"(!*\s*\[|\]|[^\[\],]+)"), F.lit(1))
    begin = F.struct(F.array(F.lit(0)).alias("signs"), F.array().cast(MEMBERS).alias("members"))

    def step(acc, token):
        word = strip(token)
        sum_ = F.element_at(acc["signs"], -1) + F.length(F.regexp_extract(word, "^(!*)", 1))
        item = strip(F.regexp_replace(word, "^!+", ""))
        one = F.array(F.struct(F.when(F.size(acc["signs"]) > 1, sum_ % 2).otherwise(sum_).alias("signs"), item.alias("item")))
        signs = F.when(word.endswith("["), F.concat(acc["signs"], F.array(sum_)))
        signs = signs.when(word == "]", F.slice(acc["signs"], 1, F.greatest(F.size(acc["signs"]) - 1, F.lit(1)))).otherwise(acc["signs"])
        members = F.when(word.endswith("[") | word.isin("]", "") | (item == ""), acc["members"]).otherwise(F.concat(acc["members"], one))
        return F.struct(signs.alias("signs"), members.alias("members"))

    return F.aggregate(tokens, begin, step, lambda acc: acc["members"])


def _members_text(members: Column) -> Column:
    signed = F.transform(members, lambda m: F.concat(F.repeat(F.lit("!"), m["signs"]), m["item"]))
    return F.when(F.size(members) == 1, F.get(signed, F.lit(0))).when(F.size(members) == 0, "any").otherwise(F.concat(F.lit("["), F.array_join(signed, ","), F.lit("]")))


def resolve_variables(variables: DataFrame) -> DataFrame:
    """Adds ``resolved``: references followed wherever they stand, in lists too, signs kept; unknown ones become any.

    Values are lists of members. Every round puts the members that a referenced variable has by then in place of each
    reference, so chains halve. Variables that lead back to themselves are an error. Values without references stay as
    they are written; others come as a flat list.
    """
    out = materialize(variables.select("name", "value", list_members(F.col("value")).alias("members")))
    open_refs = F.exists("members", lambda m: m["item"].startswith("$"))
    waiting = out.filter(open_refs).count()
    rounds = waiting.bit_length() + 1
    while waiting:
        if rounds == 0:
            names = [r["name"] for r in out.filter(open_refs).select("name").limit(20).collect()]
            raise ValueError(f"variables that refer to themselves: {', '.join(sorted(names))}")
        table = out.select(F.col("name").alias("_ref"), F.col("members").alias("_theirs")).filter(F.col("_ref").startswith("$"))
        listed = F.col("value").rlike(r"[\[,]").alias("_listed")
        each = out.filter(open_refs).select("name", listed, F.posexplode("members").alias("_at", "_m"))
        each = each.withColumn("_ref", F.when(F.col("_m.item").startswith("$"), F.col("_m.item")))
        several = F.col("_listed") | (F.size("_theirs") != 1)

        def turned(m: Column) -> Column:
            both = m["signs"] + F.col("_m.signs")
            return F.struct(F.when(several, both % 2).otherwise(both).alias("signs"), m["item"].alias("item"))

        unknown = F.array(F.struct(F.col("_m.signs").alias("signs"), F.lit("any").alias("item")))
        own = F.when(F.col("_ref").isNull(), F.array("_m")).otherwise(F.coalesce(F.transform("_theirs", turned), unknown)).cast(MEMBERS)
        met = lookup_join(each, table, ["_ref"], "left").select("name", F.struct("_at", own.alias("members")).alias("_one"))
        lists = met.groupBy("name").agg(F.flatten(F.transform(F.array_sort(F.collect_list("_one")), lambda o: o["members"])).alias("_new"))
        out = materialize(out.join(lists, "name", "left").select("name", "value", F.coalesce("_new", "members").alias("members")))
        waiting, rounds = out.filter(open_refs).count(), rounds - 1
    text = F.when(F.col("value").contains("$"), _members_text(F.col("members"))).otherwise(F.col("value"))
    return out.select("name", "value", text.alias("resolved"))


def _substituted(rules: DataFrame, columns: Sequence[str], variables: DataFrame) -> DataFrame:
    """The rules with variables resolved in the columns: their distinct texts with a reference are resolved like variables."""
    texts = rules.select(F.explode(F.array(*columns)).alias("value")).filter(F.col("value").contains("$")).distinct()
    named = texts.select(F.concat(F.lit("="), "value").alias("name"), "value")
    resolved = resolve_variables(variables.select("name", "value").unionByName(named)).filter(F.col("name").startswith("="))
    resolved = materialize(resolved.select(F.col("value").alias("_text"), "resolved"))
    for column in columns:
        joined = lookup_join(rules.withColumn("_text", F.col(column)), resolved, ["_text"], "left")
        rules = joined.withColumn(column, F.coalesce("resolved", column)).drop("_text", "resolved")
    return rules


def convert_rules(lines: DataFrame, variables: DataFrame, line: str = "line") -> DataFrame:
    """Rule rows of all readable rule lines (columns of the rules schema)."""
    parsed = split_header(lines, line).filter("parsed")
    parsed = _substituted(parsed, ("src", "dst", "src_port", "dst_port"), variables)
    options = F.col("options")
    first = lambda name: F.get(option_values(options, name), F.lit(0))
    rows = parsed.withColumns(
        {
            "items": content_items(options),
            "pcres": option_values(options, "pcre"),
            "tests": byte_tests(option_values(options, "byte_test")),
            "checks": data_checks(option_values(options, "isdataat")),
            "has_content": options.rlike(r'(?i)content:(?:"[^"]*"|[^;]*)(?:,[^;]+)?;'),
            "sid": F.coalesce(first("sid"), F.lit("unknown")),
            "classtype": F.coalesce(first("classtype"), F.lit("default")),
        }
    )
    kind = (
        F.when(F.size("pcres") > 0, "pcre")
        .when(F.col("has_content"), "string")
        .when(F.size("tests") > 0, "snort_byte_test")
        .otherwise("snort_unsupported")
    )
    pattern = (
        F.when(kind == "pcre", F.col("pcres"))
        .when(kind == "string", F.transform("items", lambda i: i["content"]))
        .when(kind == "snort_byte_test", F.array(F.lit(BYTE_TEST_PATTERN)))
        .otherwise(F.array(F.lit(UNSUPPORTED_PATTERN)))
    )
    option = F.transform("items", lambda i: F.struct(*[i[m].alias(m) for m in MODIFIERS], i["nocase"].alias("nocase")))
    option = F.transform(
        option,
        lambda o: F.struct(*[o[m].alias(m) for m in ("offset", "depth", "within", "distance", "nocase")]),
    )
    reason = F.when(kind == "snort_unsupported", NO_PATTERN_REASON)
    metadata = F.struct(
        F.transform("items", lambda i: literal_bytes(i["content"])).alias("content_patterns"),
        option.alias("content_options"),
        F.col("tests").alias("byte_tests"),
        F.col("checks").alias("isdataat"),
        (kind == "snort_byte_test").alias("byte_test_only"),
        first("dsize").alias("dsize"),
        F.nullif(F.array_join(option_values(options, "flow"), ","), F.lit("")).alias("flow"),
        first("flags").alias("flags"),
        first("ip_id").alias("ip_id"),
        first("ip_proto").alias("ip_proto"),
        option_flag(options, "dns_query").alias("dns_query"),
        option_flag(options, "smtp_command").alias("smtp_command"),
        option_flag(options, "pop_command").alias("pop_command"),
        F.col("sid").alias("snort_sid"),
        first("rev").alias("snort_rev"),
        first("gid").alias("snort_gid"),
        F.col("classtype").alias("classtype"),
        first("threshold").alias("threshold"),
        F.nullif(F.array_join(option_values(options, "reference"), "; "), F.lit("")).alias("reference"),
        first("service").alias("service"),
        first("app_layer_protocol").alias("app_layer_protocol"),
        first("ssl_version").alias("ssl_version"),
        first("metadata").alias("metadata"),
        first("priority").alias("priority_option"),
        reason.alias("unsupported_reason"),
        F.col(line).alias("raw_rule"),
    )
    title = F.coalesce(first("msg"), F.concat(F.lit("Snort rule "), F.col("sid")))
    protocol = F.lower("protocol")
    return rows.select(
        F.concat(F.lit("snort_"), F.col("sid")).alias("rule_id"),
        title.alias("name"),
        F.lit("alert").alias("action"),
        class_priority(F.col("classtype")).alias("priority"),
        F.when(protocol.isin("tcp", "udp", "icmp"), protocol).alias("protocol"),
        "src",
        port_items(F.col("src_port")).alias("src_ports"),
        "direction",
        "dst",
        port_items(F.col("dst_port")).alias("dst_ports"),
        pattern.alias("pattern"),
        kind.alias("pattern_type"),
        title.alias("description"),
        class_category(F.col("classtype")).alias("category"),
        F.array(F.lit("snort"), F.lit("imported")).alias("tags"),
        metadata.alias("metadata"),
        (kind != "snort_unsupported").alias("enabled"),
    )


def import_summary(lines: DataFrame, existing: DataFrame | None = None, line: str = "line") -> DataFrame:
    """One row: total, success, failed and imported counts of a rule text.

    ``imported`` counts the distinct rule ids that are not in ``existing``.
    """
    parsed = split_header(lines, line)
    sid = F.coalesce(F.get(option_values(F.col("options"), "sid"), F.lit(0)), F.lit("unknown"))
    ids = parsed.withColumn("rule_id", F.when(F.col("parsed"), F.concat(F.lit("snort_"), sid)))
    fresh = ids.filter("parsed").select("rule_id").distinct()
    if existing is not None:
        fresh = fresh.join(existing.select("rule_id"), "rule_id", "left_anti")
    names = ["total", "success", "failed_count", "imported"]
    zero = F.lit(0).cast("bigint")
    counts = ids.agg(
        F.count("*").alias("total"),
        F.count_if("parsed").alias("success"),
        F.count_if(~F.col("parsed")).alias("failed_count"),
    ).withColumn("imported", zero)
    added = fresh.agg(F.count("*").alias("imported")).withColumns({n: zero for n in names[:3]})
    return counts.unionByName(added).agg(*[F.sum(n).alias(n) for n in names])


def failed_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    return split_header(lines, line).filter(~F.col("parsed")).select(
        F.col(line), F.lit("Failed to parse rule").alias("error")
    )
