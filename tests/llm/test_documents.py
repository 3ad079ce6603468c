"""Operators over documents against brute force, and the pipeline of them."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from packetloom.llm import line_templates, order_minhash, pii_surrogates, quality_rules
from packetloom.llm.common import materialize, read_table
from packetloom.llm.queries import ORACLES, QUERIES
from conftest import CLASHING

SF = "/root/testdata/sf0.001"
SPACE = "\x20\x09-\x0d"
WORD = re.compile(f"[^{SPACE}]+")


def oracle(name, sf_dir):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    return sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall()), key=repr), sorted(columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, name):
    want, columns = oracle(name, SF)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == want


def brute_counts(text):
    words = WORD.findall(text or "")
    places = defaultdict(list)
    for k in range(len(words) - 7):
        places[tuple(words[k : k + 8])].append(k)
    covered = {j for at in places.values() if len(at) > 1 for k in at for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_of_odd_texts(spark, documents, clashing):
    draw = random.Random(3)
    texts = [None, "", " \n ", "one", "a b c d e f g h a b c d e f g h", "\x0b\x0c a\tb\rc", "a\n\na\nb\n a", "x " * 30_000, "é ü # $ <b>\x85 \xa0x", "日本 " * 9]
    texts += [" ".join(draw.choice("abc") for _ in range(draw.randrange(0, 60))) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (4, texts[4])]
    got = quality_rules.rate_documents(clashing(documents(rows))).collect()
    want = Counter((k, *brute_counts(t)) for k, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.rate_documents(documents([])).count() == 0


def test_cutoffs_follow_the_group(spark):
    """A source where symbols are usual keeps its documents; elsewhere the same document goes. Null groups count as groups."""
    counts = {"word_chars": 500, "n_dup_lines": 0, "n_repeat_words": 0, "n_stutter": 0, "n_lines": 5, "n_words": 100}
    rows = [("code", 150)] * 300 + [("web", 0)] * 300 + [("web", 150)] * 90 + [(None, 0)] * 300 + [(None, 150)] + [("tiny", 0)] * 5 + [("tiny", 150)]
    frame = materialize(spark.createDataFrame([(k, "en", s, n) for k, (s, n) in enumerate(rows)], "doc_id long, lang string, source string, n_symbols long").withColumns({c: F.lit(v).cast("bigint") for c, v in counts.items()}))
    kept = Counter((r.source, r.n_symbols, r.kept) for r in quality_rules.judge(frame).collect())
    assert kept == {("code", 150, True): 300, ("web", 0, True): 300, ("web", 150, False): 90, (None, 0, True): 300, (None, 150, False): 1, ("tiny", 0, True): 5, ("tiny", 150, False): 1}


def test_rules_follow_the_labels(spark):
    labels = {r.doc_id: r.quality for r in read_table(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = [r for r in QUERIES["op2_quality_rules"](spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels and r.n_words >= 20]
    assert all(r.kept for r in rows if labels[r.doc_id] == 1)
    assert not any(r.kept for r in rows if labels[r.doc_id] == 0)


def test_templates_with_variable_fields(spark, documents, clashing):
    def line(k):
        return f"{k % 28 + 1} May: user {'abcdefghijklmnop'[k]}x logged in from office"

    rows = [(k, f"Own words of text {k} here.\n{line(k)}") for k in range(12)]
    rows += [(100 + k, f"seen with few others number\nbody {k}") for k in range(3)]
    rows += [(20, None), (21, ""), (22, "\n"), (None, line(3)), (0, rows[0][1])]
    got = line_templates.drop_recurring_lines(clashing(documents(rows))).collect()
    assert len(got) == len(rows)
    texts = defaultdict(set)
    for r in got:
        texts[r.doc_id].add((r.text, r.n_dropped))
    # the null doc_id comes first, so it keeps the line of this template
    assert texts[None] == {(line(3), 0)}
    for k in range(12):
        assert texts[k] == {("", 2)} or texts[k] == {(f"Own words of text {k} here.", 1)} or k == 0
    assert all(texts[100 + k] == {(rows[12 + k][1], 0)} for k in range(3))
    assert texts[20] == {(None, 0)} and texts[21] == {("", 0)} and texts[22] == {("\n", 0)}
    assert line_templates.drop_recurring_lines(documents([])).count() == 0


def test_long_lines_need_few_texts_and_short_ones_many(spark, documents):
    """A long passage that nine texts share goes from eight; a word that 200 texts have as a line goes too, one that 50 have stays."""
    passage = " ".join(f"p{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(60))
    rows = [(k, f"{'x' * (k + 1)} own\n{passage}\n{'y' * (k + 1)}") for k in range(9)]
    rows += [(100 + k, f"{'z' * (k + 1)} mine\nContents" + ("\nIndex" if k < 50 else "")) for k in range(200)]
    rows += [(500, "1 2 3 4"), (501, "5 6 7 8"), *[(600 + k, f"own {'v' * k}\n\n1 2 3") for k in range(300)]]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(documents(rows)).collect()}
    assert got[0].text == rows[0][1] and all(passage not in got[k].text and got[k].n_dropped == 1 for k in range(1, 9))
    assert got[100].text == rows[9][1] and all("Contents" not in got[100 + k].text for k in range(1, 200))
    assert all(("Index" in got[100 + k].text) == (k < 50) for k in range(200))
    assert all(got[k].n_dropped == 0 for k in got if k >= 500)  # fields alone say nothing


def test_copies_of_one_text_do_not_make_its_lines_common(spark, documents):
    rows = [(k, "the very same line in all\nand this second one too") for k in range(30)]
    assert {r.n_dropped for r in line_templates.drop_recurring_lines(documents(rows)).collect()} == {0}


ENTITY = re.compile(r"[A-Za-z0-9.]+@[a-zA-Z0-9.]+|\d+\.\d+\.\d+\.\d+|\+\d+ \(\d+\) \d+-\d+|(?<!\w)\d{16}(?!\w)")


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def test_entities_of_a_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op3_pii_surrogates"](spark, "/root/testdata/sf0.01").collect()}
    assert rows.keys() == texts.keys()
    drawn = defaultdict(set)
    for key, text in texts.items():
        old, new = ENTITY.findall(text), ENTITY.findall(rows[key].text)
        assert len(old) == len(new) == rows[key].n_entities
        assert ENTITY.sub("@", text) == ENTITY.sub("@", rows[key].text)  # nothing else changes
        for a, b in zip(old, new, strict=True):
            drawn[a.lower()].add(b.lower())
            assert a != b and a.isupper() == b.isupper()
            if a.isdigit():
                assert luhn(a) == luhn(b)
    assert drawn and all(len(v) == 1 for v in drawn.values())  # coreference
    assert len({min(v) for v in drawn.values()}) == len(drawn)  # distinctness
    assert not {min(v) for v in drawn.values()} & set(drawn)


def test_writings_of_one_entity(spark, documents, clashing):
    rows = [
        (1, "Mail a.b@x.com or A.B@X.COM. Mr. John Smith met Mrs. Anna Smith; Mr. Smith left. Call +1 (017) 555-7713"),
        (2, "+1 017 555 7713; card 4111 1111 1111 1111, 4111-1111-1111-1111."),
        (3, None), (4, ""), (5, "Mr. Иван Петров"), (5, "Mr. Иван Петров"), (None, "at 10.0.0.1!"), (6, "ver 1.2.3 of 33445 in 2024-01-02"), (7, "w " * 100_000 + "z@y.org"),
    ]
    got = pii_surrogates.replace_personal_data(clashing(documents(rows)), "key").collect()
    assert len(got) == len(rows)
    texts = {r.doc_id: r.text for r in got}
    one = re.fullmatch(r"Mail (\S+@example\.\w+) or (\S+@EXAMPLE\.\w+)\. Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+); Mr\. (\w+) left\. Call (\+1 \(\d{3}\) \d{3}-\d{4})", texts[1])
    mail, loud, he, smith, she, smith2, smith3, phone = one.groups()
    assert mail.upper() == loud and smith == smith2 == smith3 != "Smith"
    assert she[-1] == "a" and he[-1] not in "aeiou" and he.istitle()
    two = re.fullmatch(r"(\+1 \d{3} \d{3} \d{4}); card (\d{4} \d{4} \d{4} \d{4}), (\d{4}-\d{4}-\d{4}-\d{4})\.", texts[2])
    digits = [re.sub(r"\D", "", x) for x in (phone, *two.groups())]
    assert digits[0] == digits[1] != "10175557713" and digits[2] == digits[3] and luhn(digits[2])
    assert re.fullmatch(r"Mr\. [А-Я][а-я]+ [А-Я][а-я]+", texts[5]) and "Петров" not in texts[5]
    assert texts[3] is None and texts[4] == "" and texts[6] == rows[7][1]
    assert texts[None].startswith("at 10.") and texts[None] != "at 10.0.0.1!"
    other = {r.doc_id: r.text for r in pii_surrogates.replace_personal_data(documents(rows), "other key").collect()}
    assert other[1] != texts[1]
    assert pii_surrogates.replace_personal_data(documents([]), "key").count() == 0


def test_names_without_their_title(spark, documents):
    """Later and earlier mentions of a document's names go too; the same words elsewhere, and other words, stay."""
    rows = [
        (1, "Smith rang. Mr. John Smith called. Smith's son, John Smith, left; SMITH slept. Smithson, Johnny, Smith-Jones and smith@x.org stay"),
        (2, "Smith and John are no names here"),
        (3, "Господин Иван Петров пришёл, потом Петров ушёл. Г-жа Анна Петрова"),
        (4, "κ. Νίκος Παππάς και Παππάς"),
        (None, "Mrs. Anna Lee. Élan@x.com Anna"), (5, "Mr. Ian Low and Low"), (5, "Low Mr. Ian Other"),
    ]
    got = pii_surrogates.replace_personal_data(documents(rows), "key").collect()
    texts, counts = ({(r.doc_id, k): v for k, (r, v) in enumerate((r, r[c]) for r in sorted(got, key=lambda r: (r.doc_id or 0, -len(r.text))))} for c in ("text", "n_entities"))
    one = re.fullmatch(r"(\w+) rang\. Mr\. (\w+) (\w+) called\. (\w+)'s son, (\w+) (\w+), left; (\w+) slept\. Smithson, Johnny, Smith-Jones and \S+@example\.\w+ stay", next(t for (k, _), t in texts.items() if k == 1))
    smith, john = one[3], one[2]
    assert (one[1], one[4], one[5], one[6], one[7]) == (smith, smith, john, smith, smith.upper()) and smith != "Smith" and john != "John"
    by_id = defaultdict(list)
    for (k, _), t in texts.items():
        by_id[k].append(t)
    assert by_id[2] == [rows[1][1]]
    three = re.fullmatch(r"Господин ([А-Я][а-я]+) ([А-Я][а-я]+) пришёл, потом ([А-Я][а-я]+) ушёл\. Г-жа ([А-Я][а-я]+а) ([А-Я][а-я]+)", by_id[3][0])
    assert three[2] == three[3] != "Петров" and three[1] != "Иван" and three[4] != "Анна" and three[5] != "Петрова"
    four = re.fullmatch(r"κ\. (\w+) (\w+) και (\w+)", by_id[4][0])
    assert four[2] == four[3] != "Παππάς" and four[1] != "Νίκος"
    assert re.fullmatch(r"Mrs\. (\w+a) \w+\. É\S+@example\.\w+ \1", by_id[None][0]) and "Anna" not in by_id[None][0]
    # rows of one doc_id keep apart
    low = next(t for t in by_id[5] if t.startswith("Mr."))
    assert re.fullmatch(r"Mr\. \w+ (\w+) and \1", low) and "Low" not in low and any(t.startswith("Low Mr.") for t in by_id[5])
    assert {k: v for (k, _), v in counts.items() if k in (1, 2, 3, 4)} == {1: 8, 2: 0, 3: 5, 4: 3}


@pytest.mark.parametrize(
    "text,count",
    [
        ("x@" + "a." * 100_000 + "com", 1), ("x@" + "a" * 1_000_000 + ".com!", 1), ("y" * 1_000_000 + "@host.org", 1), ("x@" + "a." * 100_000 + "1", 0),
        ("1" * 1_000_000, 0), ("+1 " * 100_000, 0), ("10.0." * 100_000, 0), ("a@" * 100_000, 0), ("1-" * 300_000, 0),
        ("Mr. A" + "b" * 1_000_000 + " C" + "d" * 1_000_000 + ". A" + "b" * 1_000_000, 3), ("Mr. Ann Low. A" + "-" * 300_000 + "b", 2),
        ("Mr. " * 100_000, 100_000), ("Mr. Bo. " * 20_000, 20_000), ("me@b.com... " * 1000, 1000), ("Mrs. " + "A" + "bc" * 30 + " Smith", 2),
    ],
)
def test_very_long_entities(spark, documents, text, count):
    """Java follows repeated groups by recursion; nothing may end the executor or be replaced in half."""
    row = pii_surrogates.replace_personal_data(documents([(1, text), (2, "other")]), "key").filter("doc_id = 1").first()
    assert row.n_entities == count
    if not count:
        assert row.text == text
    else:
        for word in set(re.findall(r"[^\W\d_]{20,}", text)):
            assert word not in row.text and word[-20:] not in row.text


TITLES = {"Mr": "m", "Herr": "m", "Mrs": "f", "Frau": "f", "Miss": "f"}


def plain_names(text):
    """The text in words and what is between them, each with the kind of name that it is, by walking through it."""
    parts = re.split(r"([^\W\d_]+)", text)
    kinds = [None] * len(parts)

    def may_be(k):
        return k < len(parts) and len(parts[k]) > 1 and parts[k][0].isupper()

    k = 1
    while k < len(parts):
        if parts[k] in TITLES and re.fullmatch(r"\.? ", parts[k + 1]) and may_be(k + 2):
            second = parts[k + 3] == " " and may_be(k + 4)
            kinds[k + 2] = f"given_{TITLES[parts[k]]}" if second else "family"
            if second:
                kinds[k + 4] = "family"
            k += 6 if second else 4
        else:
            k += 2
    known = defaultdict(set)
    for part, kind in zip(parts, kinds, strict=True):
        if kind:
            known[part.lower()].add(kind)
    for k in range(1, len(parts), 2):
        if kinds[k] is None and may_be(k) and parts[k].lower() in known:
            kinds[k] = min(known[parts[k].lower()], key=lambda x: (x != "family", x))
    return list(zip(parts, kinds, strict=True))


def test_names_against_a_walk_through_the_words(spark, documents):
    rng = random.Random(12)
    names = ["Anna", "Lee", "Otto", "Kern", "Maria", "Low", "Ölte"]
    words = ["and", "met", "the", "Then", "house", *names, *names, *TITLES]
    texts = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", ", "]) for _ in range(rng.randint(3, 25))) + "end") for k in range(300)]
    got = {r.doc_id: r for r in pii_surrogates.replace_personal_data(documents(texts), "key").collect()}
    drawn, compared = defaultdict(set), 0
    for key, text in texts:
        parts = plain_names(text)
        found = [(kind, part.lower()) for part, kind in parts if kind]
        if any(value.title() in TITLES for _, value in found):  # a title behind a title
            continue
        match = re.fullmatch("".join(r"([^\W\d_]+)" if kind else re.escape(part) for part, kind in parts), got[key].text)
        assert match and got[key].n_entities == len(found), (text, got[key].text)
        compared += 1
        for one, new in zip(found, match.groups(), strict=True):
            drawn[one].add(new.lower())
    assert compared > 50 and len(drawn) > 10 and all(len(v) == 1 for v in drawn.values())
    family = [min(v) for (kind, _), v in drawn.items() if kind == "family"]
    assert len(set(family)) == len(family)


def test_surrogates_that_meet_are_drawn_again(spark, monkeypatch):
    """With few possible surrogates most first draws meet; all values still end with their own."""
    values = spark.createDataFrame([("ssn", f"{k:03d}") for k in range(0, 900)], "kind string, value string").repartition(4)
    monkeypatch.setattr(pii_surrogates, "_surrogate", lambda kind, value, secret, attempt: F.concat(F.lit("1"), F.lpad(F.pmod(F.xxhash64(value, F.lit(attempt)), F.lit(1500)).cast("string"), 4, "0")))
    rows = pii_surrogates.surrogates(values, "k").collect()
    assert len(rows) == 900 == len({r.surrogate for r in rows})
    full = spark.createDataFrame([("ssn", str(k)) for k in range(3)], "kind string, value string")
    monkeypatch.setattr(pii_surrogates, "_surrogate", lambda kind, value, secret, attempt: F.lit("only one"))
    monkeypatch.setattr(pii_surrogates, "MOST_ROUNDS", 3)
    with pytest.raises(ValueError, match="too few"):
        pii_surrogates.surrogates(full, "k")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = list(row)
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def test_alignment_is_the_longest_common_subsequence():
    draw = random.Random(5)
    for _ in range(300):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(0, 30))] for _ in range(2))
        assert order_minhash.aligned(np.array(a, np.uint64), np.array(b, np.uint64), 40) == lcs(a, b)
        # within the band: no more than the whole, and all of a sequence with itself
        assert order_minhash.aligned(np.array(a, np.uint64), np.array(b, np.uint64), 2) <= lcs(a, b)
        assert order_minhash.aligned(np.array(a, np.uint64), np.array(a, np.uint64), 0) == len(a)


def brute_groups(rows):
    """Smallest doc_id of each document's component, all texts compared."""
    classes = {}
    for key, text in rows:
        words = tuple((text or "").lower().encode().split())
        classes.setdefault(words or (key,), []).append((key, text))
    reps = [(min(k for k, _ in held), held[0][1]) for held in classes.values()]
    grams = {k: order_minhash.kmers(t or "") for k, t in reps}
    parent = {k: k for k, _ in reps}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, _) in enumerate(reps):
        for b, _ in reps[i + 1 :]:
            x, y = grams[a].tolist(), grams[b].tolist()
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and set(x) & set(y):
                length = lcs(x, y)
                if length >= 0.8 * (len(x) + len(y) - length):
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(min(j for j, _ in held)) for held in classes.values() for k, _ in held}


def near_texts():
    """Groups of copies with edits, chains in which only neighbours are alike, a passage that many share, short and odd texts."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(6):
        text = [word() for _ in range(120)]
        for _ in range(9):
            edited = list(text)
            for _ in range(draw.randrange(0, 4)):
                edited[draw.randrange(len(edited))] = word()
            rows.append(" ".join(edited))
            if draw.random() < 0.4:
                text = edited  # drifts, so ends of the chain differ
    passage = [word() for _ in range(60)]
    rows += [" ".join([*(word() for _ in range(40)), *passage, *(word() for _ in range(30))]) for _ in range(25)]
    rows += [rows[0], rows[0].upper(), rows[3] + "\n", "three little words", "three little  words", "one", "", None, None, " \t"]
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_groups_are_the_components_of_all_pairs(spark, documents, clashing):
    rows = near_texts()
    got = order_minhash.near_duplicates(clashing(documents([*rows, rows[0]]))).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: r.group_id for r in got} == brute_groups(rows)
    assert all(r.is_first == (r.doc_id == r.group_id) for r in got)
    kept = order_minhash.keep_first(documents(rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(brute_groups(rows).values()))
    assert order_minhash.near_duplicates(documents([])).count() == 0
    assert [tuple(r)[:4] for r in order_minhash.near_duplicates(documents([(None, "some words that are here now")])).collect()] == [(None, None, None, True)]


def test_one_row_of_each_group_stays(spark, documents, clashing):
    one, other, third = "a b c d e f g h", "quite other words that are told here now", "nothing like the rest of it all at once"
    rows = [(7, one), (7, one), (9, one), (7, other), (8, other + " "), (None, third), (None, third), (None, one), (3, None), (3, None), (4, ""), (4, " ")]
    kept = order_minhash.keep_first(clashing(documents(rows))).collect()
    assert sorted([(r.doc_id, r.text) for r in kept], key=repr) == sorted([(7, one), (7, other), (None, third), (3, None), (3, None), (4, ""), (4, " ")], key=repr)
    assert set(kept[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", *CLASHING}


def test_groups_of_a_table(spark):
    rows = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").filter("n_chars < 4000").collect()]
    got = {r.doc_id: r.group_id for r in QUERIES["op5_order_minhash"](spark, SF).collect()}
    want = brute_groups(rows)
    kept = set(want)
    groups = defaultdict(set)
    for k, g in got.items():
        groups[g].add(k)
    assert {frozenset(g & kept) for g in groups.values() if g & kept} == {frozenset(k for k in want if want[k] == g) for g in set(want.values())}


def test_short_texts_with_few_changes_meet(spark, documents):
    """Pairs at 0.8 or somewhat more of few k-mers share few sketches or none; every one of them is found."""
    draw = random.Random(17)
    rows, near = [], {}
    for size, more in [(8, 1), (9, 1), (12, 2), (14, 2), (24, 5), (40, 9)] * 60:
        words = [f"{draw.randrange(10**9):x}" for _ in range(size)]
        near[len(rows) + 1] = len(rows)
        rows += [" ".join(words), " ".join([*words, *(f"{draw.randrange(10**9):x}" for _ in range(more))])]
    rows = list(enumerate(rows))
    got = {r.doc_id: r.group_id for r in order_minhash.near_duplicates(documents(rows)).collect()}
    assert got == {k: near.get(k, k) for k, _ in rows}


def test_pairs_out_of_reach_are_not_similar():
    """The parities never differ in more places than k-mers are in one text only."""
    draw = np.random.default_rng(3)
    for size in (1, 50, 1500, 3000, 20_000):
        a = draw.integers(0, 2**64, size, dtype=np.uint64)
        b = np.concatenate([a[: size * 3 // 4], draw.integers(0, 2**64, size // 4, dtype=np.uint64)])
        x, y = order_minhash.parities(a), order_minhash.parities(b)
        if len(x) == len(y):
            assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_long_texts_align(spark, documents):
    draw = random.Random(2)
    words = [str(draw.randrange(10**6)) for _ in range(40_000)]
    edited = list(words)
    for _ in range(300):
        edited[draw.randrange(len(edited))] = "x"
    rows = order_minhash.near_duplicates(documents([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[:20_000]))])).collect()
    assert {r.doc_id: r.group_id for r in rows} == {1: 1, 2: 1, 3: 3}


def test_pipeline_is_its_operators(spark, documents):
    """Every stage on all that the one before kept, against brute force or the operator's own query."""
    docs = read_table(spark, SF, "documents")
    names = docs.columns
    rated = {r.doc_id: r.kept for r in QUERIES["op2_quality_rules"](spark, SF).collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = materialize(stage(spark, docs, SF))
        after = docs.collect()
        if name == "quality_rules":
            assert {r.doc_id for r in after} == {k for k, good in rated.items() if good}
        if name in ("line_templates", "pii_surrogates"):
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "order_minhash":
            want = order_minhash.near_duplicates(spark.createDataFrame(before, docs.schema)).filter("is_first").collect()
            assert {r.doc_id for r in after} == {r.doc_id for r in want}
        if name == "pii_surrogates":
            assert not any(ENTITY.findall(b.text) and ENTITY.findall(a.text) == ENTITY.findall(b.text) for a, b in zip(sorted(after), sorted(before), strict=True))
        assert number == len(corpus_pipeline.STAGES) - 1 or docs.columns == names
        if name == "pattern_packing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_templates", "order_minhash", "pii_surrogates", "pattern_packing"]


def test_pipeline_of_odd_tables(spark, documents, clashing):
    """Nulls in any column, empty texts, repeated rows, a very long text and clashing columns through all stages; an empty table."""
    rng = random.Random(9)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))

    rows = [(k, prose(60), "en", "web", 1) for k in range(30)]
    rows += [rows[3], rows[3], (50, rows[4][1], None, None, None), (None, prose(50), "en", None, 5), (None, None, "en", "web", None), (60, None, None, "web", 0), (61, "", "en", "web", 0)]
    rows += [(62, prose(20_000), "en", "web", 9), (63, "Mr. Ann Low wrote to x@y.org " + prose(40), "en", "web", 9), (64, "short", "en", "web", 5)]
    long = next(r[1] for r in rows if r[0] == 62)
    for frame in (clashing(documents(rows)), documents([])):
        docs, names = frame, frame.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, SF))
            assert docs.columns == names
        kept = docs.collect()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        if not kept:
            assert not packed
            continue
        by_id = Counter(r.doc_id for r in kept)
        assert by_id == Counter({**{k: 1 for k in range(30)}, None: 1, 62: 1, 63: 1})  # equal rows once, of 4 and 50 the first
        assert next(r.text for r in kept if r.doc_id == 62) == long and "x@y.org" not in next(r.text for r in kept if r.doc_id == 63)
        assert {r.doc_id for r in packed} == set(by_id)


def test_pipeline_query(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    sequences = defaultdict(int)
    for r in rows:
        sequences[r.sequence_id] += r.length
    assert rows and max(sequences.values()) <= 2048


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_a_walk(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(500, k) for k in range(501, 560)] + [(7, 7), (9, 8), (8, 9)]
    rng.shuffle(edges)
    smallest = {x: x for e in edges if e[0] != e[1] for x in e}
    while any(smallest[a] != smallest[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    found = order_minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == smallest and len(found) == len(smallest)
    assert order_minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_are_cut_into_tokens_once(spark, documents):
    """Tokens as a regular expression finds them, whatever white space stands between; documents are read for them once."""
    import re

    from pyspark.sql import functions as F

    shown = ["a b", " a\tb\x0bc\x0c d\r", "  ", "", "x1 y 2", "<*> z", "\xa0a\x1c b", "7\r\t8", "é\u2003 ü9"]
    lines = line_templates._lines(documents([(1, "\n".join(shown)), (2, None)]))
    kept = [(k, t) for k, t in enumerate(shown) if re.search(r"[^\x20\x09-\x0D]", t)]
    assert sorted((r.pos, r.shown) for r in lines.collect()) == kept
    tokens = {r.pos: r.t for r in lines.select("pos", line_templates._tokens(F.col("shown")).alias("t")).collect()}
    masked = {k: ["<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", text)] for k, text in kept}
    assert tokens == masked
    constants = {r.pos: r.constants for r in lines.collect()}
    assert constants == {k: sum(t != "<*>" for t in ts) for k, ts in masked.items()}
