"""Personal data replaced by surrogates: keyed, of the same type and form, one for each person or number.

Entities are found by patterns in whole texts: names behind titles, then the same names without a title in the same
document. Every distinct value gets one candidate from the secret key; candidates
that meet another value's surrogate, or any real value, are drawn again until none does. So different values stay
different, and all mentions of a value, however written, get the same surrogate in their own writing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import let, materialize, unwrapped, wrapped

# Titles before names, by gender: fixed values.
HE = "Mr|Mister|Herr|Monsieur|Señor|Sr|Don|Sir"
SHE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Señorita|Sra|Doña|Madam"
# Those of other scripts, whose letters are no word characters to \b.
HE_OTHER = "[Гг]осподин(?:а|у|ом|е)?|[Гг]-(?:н|на|ну|ном|не)|[Κκ]ύρι(?:ος|ου|ο|ε)|[Κκ]ος|[Κκ]"
SHE_OTHER = "[Гг]осп(?:ожа|ожи|оже|ожу|ожой)|[Гг]-(?:жа|жи|же|жу|жой)|[Κκ]υρία(?:ς)?|[Κκ]α(?:ς)?"
HE_TITLE = rf"(?:\b(?:{HE})|(?<![\p{{L}}\p{{N}}_-])(?:{HE_OTHER}))"
SHE_TITLE = rf"(?:\b(?:{SHE})|(?<![\p{{L}}\p{{N}}_-])(?:{SHE_OTHER}))"
TITLE = rf"(?:{HE_TITLE}|{SHE_TITLE})"
NAME = r"\p{Lu}[\p{L}'’-]+"
PATTERNS = {
    # a host of any number of labels without a repeated group, which Java would follow by recursion
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?=[A-Za-z0-9-])[A-Za-z0-9.-]*(?<=[A-Za-z0-9-])\.[A-Za-z]{2,}",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?![0-9])",
    "card": r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "name": rf"(?=\p{{Lu}})(?<= )(?<={TITLE}\.? ){NAME}(?: {NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds no entity.
MAY_HOLD = rf"[0-9@]|{TITLE}\.? \p{{Lu}}"
#: A text without this holds no name. In one with it, words are looked up that may be a name without its title: whole
#: capitalised ones, without a possessive ending, that are no part of a mail address.
TITLED = rf"{TITLE}\.? \p{{Lu}}"
WORD = r"(?<![\p{L}\p{N}_'’-])\p{Lu}[\p{L}'’-]+?(?=['’-]{0,8}(?:['’]s)?(?![\p{L}'’-]))(?![\p{N}_]|[A-Za-z0-9._%+'’-]*@)"
POSSESSIVE = "['’-]*(?:['’]s)?$"
WITH_WORDS = rf"{ANY}|(?:{WORD})"
#: Letters from which names are made, by script: consonants, vowels, the ending of women's names.
SCRIPTS = {"latin": ("bdfgklmnprstv", "aeiou", "a"), "cyrillic": ("бвгдзклмнпрст", "аеиоу", "а"), "greek": ("βγδζκλμνπρστ", "αεηιο", "α")}
MOST_ROUNDS = 60


def _kind(mention: Column) -> Column:
    digits = F.length(F.regexp_replace(mention, "[^0-9]", ""))
    return (
        F.when(F.contains(mention, F.lit("@")), "email")
        .when(mention.rlike(r"^\p{L}"), "name")
        .when(mention.rlike(rf"^(?:{PATTERNS['ip']})$"), "ip")
        .when(mention.rlike(rf"^(?:{PATTERNS['ssn']})$"), "ssn")
        .when(mention.startswith("+") | mention.startswith("(") | (digits < 13), "phone")
        .otherwise("card")
    )


def _canonical(kind: Column, mention: Column) -> Column:
    return F.when(kind.isin("email", "name"), F.lower(mention)).when(kind == "ip", mention).otherwise(F.regexp_replace(mention, "[^0-9]", ""))


def _mentions(text: Column, words: bool) -> Column:
    """array<struct<place, part, mention, kind, value>>: names are parted into given names by gender and family names.

    ``place`` counts the matches, ``part`` is 1 for the family name behind a given name. With ``words``, words that may be
    names too are mentions without a kind; their value is that of a name.
    """
    pattern = WITH_WORDS if words else ANY

    def entry(place: Column, part: int, mention: Column, kind: Column, value: Column) -> Column:
        return F.struct(place.alias("place"), F.lit(part).alias("part"), mention.alias("mention"), kind.alias("kind"), value.alias("value"))

    def described(pieces: Column) -> Column:
        def named(whole: Column) -> Column:
            def one(mention: Column, k: Column) -> Column:
                """``mention``: what an entity's pattern matched, empty for a word that may be a name."""
                kind = _kind(mention)
                given, family = F.substring_index(mention, " ", 1), F.substring_index(mention, " ", -1)
                # the title may be such a word
                woman = F.concat(F.coalesce(F.get(whole, k - 1), F.lit("")), F.get(pieces, k)).rlike(rf"{SHE_TITLE}\.? $")
                first = F.when(woman, "given_f").otherwise("given_m")
                both = F.array(entry(k, 0, given, first, F.lower(given)), entry(k, 1, family, F.lit("family"), F.lower(family)))
                own = F.when(kind == "name", "family").otherwise(kind)
                single = F.array(entry(k, 0, mention, own, _canonical(kind, mention)))
                found = F.when((kind == "name") & mention.contains(" "), both).otherwise(single)
                if words:
                    bare = F.get(whole, k)
                    found = F.when(mention == "", F.array(entry(k, 0, bare, F.lit(None).cast("string"), F.lower(bare)))).otherwise(found)
                return found

            # what only WORD matches has an empty group here
            found = F.regexp_extract_all(text, F.lit(f"({ANY})|(?:{WORD})"), F.lit(1)) if words else whole
            return F.flatten(F.transform(found, one))

        return let(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), named)

    return let(F.split(text, pattern, -1), described)


def _looked_up(words: DataFrame) -> DataFrame:
    """The mentions with those words that are, without a title, a name of their document as such."""
    found, bare = words.filter("kind is not null"), words.filter("kind is null").drop("kind")
    # a word that is a name in several ways: the written value before one without its ending, family names first
    key = F.regexp_replace("value", POSSESSIVE, "")
    names = found.filter(F.col("kind").isin("family", "given_f", "given_m")).select("doc_id", "content", "kind", "value", F.explode(F.array_distinct(F.array(key, "value"))).alias("_key"))
    best = F.min(F.struct(F.col("_key") != F.col("value"), F.col("kind") != "family", "kind", "value")).alias("_best")
    names = names.groupBy(F.col("doc_id").alias("_id"), F.col("content").alias("_content"), "_key").agg(best)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content")) & (F.col("value") == F.col("_key"))
    known = bare.join(names, same, "left").select("doc_id", "content", "place", "part", "mention", F.col("_best.kind").alias("kind"), F.col("_best.value").alias("value"))
    return found.select(known.columns).union(known)


def _number(key: Column, place, most: int) -> Column:
    return F.pmod(F.xxhash64(key, place), F.lit(most))


def _letter(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), number.cast("int") + 1, F.lit(1))


def _same_shape(text: Column, key: Column) -> Column:
    """Each digit a digit, each letter a letter, all else as it is."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def drawn(c: Column, k: Column) -> Column:
        return F.when(c.rlike("[0-9]"), _number(key, k, 10).cast("string")).when(c.rlike("[a-z]"), _letter(letters, _number(key, k, 26))).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), drawn), "")


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of ten for a valid number."""
    backwards = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    weighed = F.transform(backwards, lambda d, k: F.when(k % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(weighed, F.lit(0), lambda n, d: n + d)


def _card(value: Column, key: Column) -> Column:
    """The first digit (the network) stays; valid numbers get valid ones, others others."""
    body = F.concat(F.substring(value, 1, 1), _same_shape(F.substring(value, F.lit(2), F.length(value) - 2), key))
    check = F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    off = F.when(F.pmod(_luhn(value), F.lit(10)) == 0, 0).otherwise(1 + _number(key, F.lit(-1), 9))
    return F.concat(body, F.pmod(check + off, F.lit(10)).cast("string"))


def _ip(value: Column, key: Column) -> Column:
    """Private addresses stay private."""
    parts = [_number(key, F.lit(k), 256).cast("string") for k in range(3)]
    private = value.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.")
    return F.concat_ws(".", F.when(private, "10").otherwise((11 + _number(key, F.lit(3), 113)).cast("string")), *parts)


def _email(value: Column, key: Column) -> Column:
    """The local part and hosts by shape, under a domain that is nobody's."""
    hosts = F.split(F.substring_index(value, "@", -1), r"\.")
    inner = F.transform(F.slice(hosts, F.lit(1), F.greatest(F.size(hosts) - 2, F.lit(0))), lambda h: F.concat(_same_shape(h, F.concat(key, h)), F.lit(".")))
    top = F.element_at(F.array(*[F.lit(x) for x in ("com", "net", "org")]), (_number(key, F.lit(-1), 3) + 1).cast("int"))
    return F.concat(_same_shape(F.substring_index(value, "@", 1), key), F.lit("@"), F.array_join(inner, ""), F.lit("example."), top)


def _name(kind: Column, value: Column, key: Column, attempt: int) -> Column:
    """Syllables of the value's script; given names of women end in a vowel, of men in a consonant."""

    def of(script: str) -> Column:
        consonants, vowels, ending = SCRIPTS[script]
        syllables = [F.concat(_letter(consonants, _number(key, F.lit(2 * k), len(consonants))), _letter(vowels, _number(key, F.lit(2 * k + 1), len(vowels)))) for k in range(2 + attempt // 4)]
        last = _letter(consonants, _number(key, F.lit(-1), len(consonants)))
        return F.concat(*syllables, last, F.when(kind == "given_f", F.lit(ending)).otherwise(F.lit("")))

    return F.when(value.rlike(r"^\p{IsCyrillic}"), of("cyrillic")).when(value.rlike(r"^\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def _surrogate(kind: Column, value: Column, secret: str, attempt: int) -> Column:
    key = F.sha2(F.concat_ws("\n", F.lit(secret), kind, value, F.lit(str(attempt))), 256)

    def of(key: Column) -> Column:
        # a phone number keeps its length and, in longer ones, the digits before the last ten
        head = F.greatest(F.length(value) - 10, F.lit(0))
        phone = F.concat(F.substring(value, F.lit(1), head), _same_shape(F.substring(value, head + 1, F.lit(10)), key))
        return (
            F.when(kind == "email", _email(value, key)).when(kind == "ip", _ip(value, key)).when(kind == "card", _card(value, key)).when(kind == "phone", phone)
            .when(kind == "ssn", _same_shape(value, key)).otherwise(_name(kind, value, key, attempt))
        )

    return let(key, of)


def surrogates(values: DataFrame, secret: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): no two values of a kind share one, none is a real value.

    Each round draws candidates for the values still without; of values that drew alike the smallest keeps it. Raises if
    a kind has too few possible surrogates for its values.
    """
    values = materialize(values.select("kind", "value").distinct())
    real = values.select("kind", F.col("value").alias("surrogate"))
    accepted, todo = [], values
    for attempt in range(MOST_ROUNDS):
        drawn = todo.withColumn("surrogate", _surrogate(F.col("kind"), F.col("value"), secret, attempt)).join(real, ["kind", "surrogate"], "left_anti")
        if accepted:
            drawn = drawn.join(reduce(DataFrame.unionByName, accepted).select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = materialize(drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate"))
        accepted.append(won)
        todo = materialize(todo.join(won, ["kind", "value"], "left_anti"))
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, accepted)
    raise ValueError("too few surrogates for the values of a kind")


def _written(mention: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the writing of the mention: its punctuation, its case."""

    def filled(digits: Column) -> Column:
        characters = F.split(mention, "")
        before = F.transform(characters, lambda c, k: F.length(F.regexp_replace(F.substring(mention, F.lit(1), k), "[^0-9]", "")))
        return F.array_join(F.zip_with(characters, before, lambda c, n: F.when(c.rlike("[0-9]"), F.substring(digits, n + 1, F.lit(1))).otherwise(c)), "")

    loud = (mention == F.upper(mention)) & (mention != F.lower(mention))
    cased = F.when(loud, F.upper(surrogate)).when(kind == "email", surrogate).otherwise(F.initcap(surrogate))
    return F.when(kind == "ip", surrogate).when(kind.isin("phone", "card", "ssn"), filled(surrogate)).otherwise(cased)


def replace_personal_data(documents: DataFrame, secret: str) -> DataFrame:
    """The documents with every entity in ``text`` replaced, and ``n_entities``; other columns stay.

    A null text stays null, an empty one empty; an empty table gives an empty one; repeated rows are changed alike. The
    secret decides the surrogates: with the same one, and the same values in the table, they are the same again. A
    column n_entities is replaced. Values are added up before they meet, so a value in most documents is one row when
    surrogates are made; its mentions join by value, where a skewed join can be split.
    """
    content = F.xxhash64("text")
    held = documents.filter(F.col("text").rlike(MAY_HOLD))
    named = F.col("text").rlike(TITLED)
    words = materialize(held.filter(named).select("doc_id", content.alias("content"), F.inline(_mentions(F.col("text"), True))))
    plain = held.filter(~named).select("doc_id", content.alias("content"), F.inline(_mentions(F.col("text"), False)))
    found = materialize(plain.select("doc_id", "content", "place", "part", "mention", "kind", "value").union(_looked_up(words)))
    known = surrogates(found.filter("kind is not null"), secret)
    # other words stay in the list as they are
    new = F.coalesce(_written(F.col("mention"), F.col("kind"), F.col("surrogate")), F.col("mention"))
    written = found.join(known, ["kind", "value"], "left").select("doc_id", "content", F.struct("place", "part", new.alias("surrogate"), F.col("kind").isNotNull().alias("entity")).alias("_one"))
    by_document = written.groupBy(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).agg(F.sort_array(F.collect_set("_one")).alias("_new"))
    rows = wrapped(documents.drop("n_entities"))
    old = F.col("row.text")
    joined = rows.join(by_document, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_content")), "left")

    def replaced(pieces: Column) -> Column:
        def behind_it(n: Column, k: Column) -> Column:
            given = F.coalesce(F.get(F.col("_new"), k + 1)["place"] == n["place"], F.lit(False))
            return F.concat(n["surrogate"], F.when(given, " ").otherwise(F.get(pieces, n["place"] + 1)))

        behind = F.transform(F.col("_new"), behind_it)
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(behind, ""))

    text = F.when(F.col("_new").isNull(), old).otherwise(F.when(old.rlike(TITLED), let(F.split(old, WITH_WORDS, -1), replaced)).otherwise(let(F.split(old, ANY, -1), replaced)))
    count = F.when(F.col("_new").isNull(), 0).otherwise(F.size(F.filter("_new", lambda n: n["entity"]))).cast("bigint").alias("n_entities")
    return joined.select(*unwrapped(rows, text=text), count)
