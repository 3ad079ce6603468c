"""Quality rules whose cutoffs come from the corpus: quantile sketches for each language and source.

Each feature is a ratio in thousandths, kept to three significant digits. The counts of these values are the sketch: it
has a relative error below one percent, two sketches merge by adding counts, and the order of merging is of no account.
A group's cutoff is its median and a multiple of the spread below the median, so up to half of a group may be junk
without moving it. Each cutoff is drawn towards that of the wider sketch (language, then all) by as much as a group of
``WEIGHT`` documents would, so the size of a group or table never switches anything. What is added to the spread is
fixed for each feature: in clean text most of them are zero, which has no spread to go by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import let, materialize, unwrapped, wrapped

SPACE = r"\x20\x09-\x0D"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30  # the base rules
WEIGHT = 50  # documents of a group that count as much as the wider sketch
SPREADS = 6
#: feature -> (count, of, slack in thousandths beyond the spread)
FEATURES = {
    "symbols": ("n_symbols", "n_words", 250),
    "word_length": ("word_chars", "n_words", 1500),
    "line_repeats": ("n_dup_lines", "n_lines", 400),
    "word_repeats": ("n_repeat_words", "n_words", 290),
    "stutter": ("n_stutter", "n_words", 100),
}


def _pairs(left: Column, shift: int, combine) -> Column:
    """``combine`` of each element and the one ``shift`` places on."""
    return F.zip_with(F.slice(left, F.lit(1), F.greatest(F.size(left) - shift, F.lit(0))), F.slice(left, F.lit(shift + 1), F.greatest(F.size(left) - shift, F.lit(0))), combine)


def _covered(grams: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def places(ordered: Column) -> Column:
        def repeated(e: Column, k: Column) -> Column:
            return F.when((e["h"] == F.get(ordered, k - 1)["h"]) | (e["h"] == F.get(ordered, k + 1)["h"]), e["i"])

        return F.sort_array(F.filter(F.transform(ordered, repeated), lambda i: i.isNotNull()))

    def words(at: Column) -> Column:
        steps = _pairs(at, 1, lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(WINDOW), lambda total, step: total + step)

    marked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(marked, lambda m: let(places(m), words)))


def _repeats(words: Column) -> Column:
    """(repeat, stutter): words in repeated windows; words that repeat the one before."""

    def of_hashes(h1: Column) -> Column:
        h2 = _pairs(h1, 1, lambda a, b: F.xxhash64(a, b))
        h4 = let(h2, lambda h: _pairs(h, 2, lambda a, b: F.xxhash64(a, b)))
        h8 = let(h4, lambda h: _pairs(h, 4, lambda a, b: F.xxhash64(a, b)))
        same = F.aggregate(_pairs(h1, 1, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
        return F.struct(F.when(F.size(h1) < WINDOW, 0).otherwise(let(h8, _covered)).alias("repeat"), same.alias("stutter"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def with_features(documents: DataFrame) -> DataFrame:
    """The documents with the counts of the rules; a null text counts as empty.

    Windows are compared by 64-bit hashes of their words' hashes.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), F.lit(1))
    filled = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    counted = let(
        words,
        lambda w: let(
            _repeats(w),
            lambda r: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                r["repeat"].cast("bigint").alias("n_repeat_words"),
                r["stutter"].cast("bigint").alias("n_stutter"),
            ),
        ),
    )
    lines = let(filled, lambda ls: F.struct(F.size(ls).cast("bigint").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("bigint")
    wide = documents.select("*", counted.alias("_w"), lines.alias("_l"), symbols.alias("n_symbols"))
    return wide.select(
        *[F.col(c) for c in documents.columns], "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_w.n_stutter", "_l.n_lines"
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _thousandths(feature: str) -> Column:
    count, of, _ = FEATURES[feature]
    return F.when(F.col(of) == 0, 0).otherwise(F.floor(1000 * F.col(count) / F.greatest(F.col(of), F.lit(1)))).cast("bigint")


def _digits(value: Column) -> Column:
    """Three significant digits."""
    unit = F.pow(F.lit(10), F.greatest(F.length(value.cast("string")) - 3, F.lit(0))).cast("bigint")
    return value - value % unit


def sketches(features: DataFrame) -> DataFrame:
    """(level, lang, source, feature, value, n): the mergeable sketches; level 0 for language and source, 1 for language, 2 for all."""
    values = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), _digits(_thousandths(f)).alias("value")) for f in FEATURES]))
    finest = features.select("lang", "source", values).groupBy("lang", "source", "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    levels = F.expr(
        "inline(array(named_struct('level', 0, 'l', lang, 's', source), named_struct('level', 1, 'l', lang, 's', cast(null as string)),"
        " named_struct('level', 2, 'l', cast(null as string), 's', cast(null as string))))"
    )
    return finest.select(levels, "feature", "value", "n").groupBy("level", F.col("l").alias("lang"), F.col("s").alias("source"), "feature", "value").agg(F.sum("n").alias("n"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, n, one cutoff for each feature): median + SPREADS x (median - lower quartile) + slack."""
    group = ["level", "lang", "source", "feature"]
    upto = Window.partitionBy(*group).orderBy("value")
    every = Window.partitionBy(*group)
    cumulated = sketch.select("*", F.sum("n").over(upto).alias("_upto"), F.sum("n").over(every).alias("_all"))
    quantiles = cumulated.groupBy(*group).agg(
        F.max("_all").alias("n"),
        F.min(F.when(2 * F.col("_upto") >= F.col("_all"), F.col("value"))).alias("median"),
        F.min(F.when(4 * F.col("_upto") >= F.col("_all"), F.col("value"))).alias("quarter"),
    )
    of = {f: F.max(F.when(F.col("feature") == f, F.col("median") + SPREADS * (F.col("median") - F.col("quarter")) + slack)).alias(f"most_{f}") for f, (_, _, slack) in FEATURES.items()}
    return quantiles.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *of.values())


def judge(features: DataFrame) -> DataFrame:
    """``features`` with base_failed and kept, by the cutoffs of the features' own table.

    ``features`` is read twice, so it should be a written table. Sketches hold a few hundred rows a group; all rows of
    a hot source are added up before any shuffle, and the rows themselves meet the cutoffs by lang and source, where a
    skewed join can be split. Null languages and sources are groups like others.
    """
    cut = materialize(cutoffs(sketches(features)))
    names = [f"most_{f}" for f in FEATURES]

    def towards(wider: str) -> Column:
        return F.struct(*[F.expr(f"(n * {m} + {WEIGHT} * {wider}.{m}) div (n + {WEIGHT})").alias(m) for m in names])

    finest = cut.filter("level = 0")
    everything = cut.filter("level = 2").select("level", F.struct(*names).alias("_widest"))
    # one row for all, by an equality that always holds
    by_lang = cut.filter("level = 1").join(everything.withColumnRenamed("level", "_top"), F.col("level") + 1 == F.col("_top"))
    by_lang = by_lang.select(F.col("lang").alias("_lang"), towards("_widest").alias("_wider"))
    chosen = finest.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang"))).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), towards("_wider").alias("_cut"))
    fine = F.lit(True)
    for f in FEATURES:
        fine = fine & (_thousandths(f) <= F.col(f"_cut.most_{f}"))
    joined = features.join(chosen, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")))
    return joined.select(*[F.col(c) for c in features.columns], base_failed().alias("base_failed"), (~base_failed() & fine).alias("kept"))


def rate_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts, base_failed, kept) for every row of documents; texts are not carried.

    An empty table gives an empty one; empty and null texts fail the base rules; repeated rows are rated each.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutter", "n_lines"]
    plain = documents.select("doc_id", "text", "lang", "source")
    features = materialize(with_features(plain).select("doc_id", "lang", "source", F.xxhash64("text", "lang", "source").alias("content"), *counts))
    return judge(features)


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns as they were."""
    kept = rate_documents(documents).filter("kept").select(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).distinct()
    rows = wrapped(documents)
    own = F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text", "row.lang", "row.source") == F.col("_content"))
    return rows.join(kept, own, "left_semi").select(unwrapped(rows))


def _sql() -> str:
    """The same in DuckDB."""
    ratio = {f: f"CASE WHEN {of} = 0 THEN 0 ELSE 1000 * {n} // {of} END" for f, (n, of, _) in FEATURES.items()}
    bins = " UNION ALL ".join(f"SELECT lang, source, '{f}' AS feature, {r} AS v FROM counted" for f, r in ratio.items())
    slack = " ".join(f"WHEN '{f}' THEN {s}" for f, (_, _, s) in FEATURES.items())
    fine = " AND ".join(
        f"{r} <= (SELECT c.most FROM chosen c WHERE c.feature = '{f}' AND c.lang IS NOT DISTINCT FROM counted.lang AND c.source IS NOT DISTINCT FROM counted.source)"
        for f, r in ratio.items()
    )
    w = "[^\\x20\\x09-\\x0D]+"
    return f"""
WITH worded AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{w}') AS w FROM documents
), grams AS (
  SELECT doc_id, list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS g FROM worded WHERE len(w) >= {WINDOW}
), placed AS (
  SELECT doc_id, unnest(g) AS gram, generate_subscripts(g, 1) AS i FROM grams
), doubled AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM placed) WHERE n > 1
), covered AS (
  SELECT doc_id, sum(least(coalesce(after - i, {WINDOW}), {WINDOW})) AS n FROM doubled GROUP BY doc_id
), lined AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{w}')) AS l FROM worded
), counted AS (
  SELECT d.doc_id, d.lang, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS BIGINT) AS n_stutter
  FROM worded d JOIN lined USING (doc_id) LEFT JOIN covered c USING (doc_id)
), values AS ({bins}
), digits AS (
  SELECT lang, source, feature, v - v % CAST(pow(10, greatest(length(CAST(v AS VARCHAR)) - 3, 0)) AS BIGINT) AS v FROM values
), levels AS (
  SELECT 0 AS level, lang, source, feature, v FROM digits UNION ALL SELECT 1, lang, NULL, feature, v FROM digits UNION ALL SELECT 2, NULL, NULL, feature, v FROM digits
), cuts AS (
  SELECT level, lang, source, feature, count(*) AS n, quantile_disc(v, 0.5) AS median, quantile_disc(v, 0.25) AS quarter FROM levels GROUP BY ALL
), mosts AS (
  SELECT *, median + {SPREADS} * (median - quarter) + CASE feature {slack} END AS most FROM cuts
), chosen AS (
  SELECT f.lang, f.source, f.feature, (f.n * f.most + {WEIGHT} * ((l.n * l.most + {WEIGHT} * e.most) // (l.n + {WEIGHT}))) // (f.n + {WEIGHT}) AS most
  FROM mosts f JOIN mosts l ON l.level = 1 AND l.feature = f.feature AND l.lang IS NOT DISTINCT FROM f.lang
  JOIN mosts e ON e.level = 2 AND e.feature = f.feature WHERE f.level = 0
), based AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {fine} AS fine FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept FROM based
"""


SQL = _sql()
