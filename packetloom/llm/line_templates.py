"""Line dedup by a tree of log templates.

The tree has a fixed depth: lines are parted by their number of tokens, then by their leading tokens (fields with digits
are variable from the start). Within a leaf, a token that few texts have at its place is a variable field too; what is
left is the line's template. Lines that stand in enough different texts, and lines whose template does, are dropped from
every document but the first. How many are enough depends on what the line says: two texts for a long one, more for
short ones. Everything is counted over distinct texts, so copies of one document do not make its lines common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import let, materialize, unwrapped, wrapped

SPACE = r"\x20\x09-\x0D"
LEADING = 2  # leading tokens in the tree
LEAST_TEXTS = 10  # distinct texts from which a token of a leaf is a constant and not a field
REPEATED = 40  # constant tokens that a line's texts must have in all: twenty in two texts, four in ten
SHORT, SHORT_TEXTS = 2, 100  # lines of up to so many constant tokens, often headings, need so many texts
FIELD = "<*>"


def enough(constants: Column) -> Column:
    """Distinct texts that a line with so many constant tokens must stand in to be dropped; none are enough without any."""
    return F.when(constants > SHORT, F.greatest(F.lit(2), F.ceil(F.lit(REPEATED) / constants))).when(constants > 0, SHORT_TEXTS)


def _tokens(line: Column) -> Column:
    """A line's tokens, those with digits masked: tokens are looked at one by one only in lines that have a digit.

    White space becomes blanks first where there is other than blanks, so that cutting at one character is enough.
    """
    spaced = F.when(line.rlike(r"[\x09-\x0D]"), F.translate(line, "\t\n\x0b\x0c\r", "     ")).otherwise(line)
    tokens = F.array_remove(F.split(spaced, " "), "")
    return F.when(line.rlike("[0-9]"), F.transform(tokens, _masked)).otherwise(tokens)


def _lines(documents: DataFrame) -> DataFrame:
    """(doc_id, content, pos, leaf, line, constants, shown) of every line with tokens; ``shown``: the line as it is."""
    # hashed and cut before the rows are multiplied, not once for every line
    cut = documents.select("doc_id", F.xxhash64("text").alias("content"), F.split("text", "\n").alias("lines"))
    split = cut.select("doc_id", "content", F.posexplode("lines").alias("pos", "shown")).filter(F.col("shown").rlike(f"[^{SPACE}]"))
    masked = split.select("doc_id", "content", "pos", "shown", _tokens(F.col("shown")).alias("tokens"))
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, LEADING)).alias("leaf")
    constants = F.size(F.array_remove("tokens", FIELD)).alias("constants")
    return masked.select("doc_id", "content", "pos", leaf, F.xxhash64("tokens").alias("line"), constants, "shown")


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def _beyond_first(rows: DataFrame, names: list[str], enough_texts: Column) -> DataFrame:
    """(doc_id, content, pos) of the rows (with ``names`` and ``constants``) whose ``names`` stand in enough distinct texts, but the first."""
    first = F.min(F.struct("doc_id", "pos", "content")).alias("first")
    by_text = rows.groupBy(*names, "content").agg(first, F.max("constants").alias("constants"))
    common = by_text.groupBy(*names).agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"), F.max("constants").alias("constants"))
    common = materialize(common.filter(F.col("n") >= enough_texts).select(*names, "first"))  # so that the join below can split hot ones
    own = F.struct("doc_id", "pos", "content")
    return rows.join(common, names).filter(~own.eqNullSafe(F.col("first"))).select("doc_id", "content", "pos")


def recurring_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, content, pos) of every line to drop; a line may come twice.

    Leaves, lines and templates are told apart by 64-bit hashes. Lines as they are (but for fields with digits) are
    counted by hashes alone. Templates are looked for in leaves that enough distinct texts reach; only their lines go
    on with their tokens, one row for each distinct line, however often it occurs. Lines are written beside their
    hashes, so that documents are cut into lines once.
    """
    hashes = materialize(_lines(documents))
    same = _beyond_first(hashes.select("doc_id", "content", "pos", "line", "constants"), ["line"], enough(F.col("constants")))
    leaves = hashes.groupBy("leaf", "content").agg(F.min("pos").alias("_p")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    leaves = materialize(leaves.filter(F.col("n") >= LEAST_TEXTS).select("leaf"))
    held = materialize(hashes.join(leaves, "leaf", "left_semi").select("doc_id", "content", "pos", "leaf", "line"))
    texts = held.groupBy("leaf", "line", "content").agg(F.count(F.lit(1)).alias("_n")).groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n"))
    # the tokens of one line of each kind
    shown = hashes.select("leaf", "line", "shown").join(leaves, "leaf", "left_semi").groupBy("leaf", "line").agg(F.first("shown").alias("shown"))
    tokens = shown.select("leaf", "line", _tokens(F.col("shown")).alias("tokens"))
    cells = materialize(texts.join(tokens, ["leaf", "line"]).select("leaf", "line", "n", F.posexplode("tokens").alias("place", "token")))
    # constants: tokens that enough texts have at this place of the leaf
    constants = cells.groupBy("leaf", "place", "token").agg(F.sum("n").alias("n")).filter((F.col("n") >= LEAST_TEXTS) & (F.col("token") != FIELD)).select("leaf", "place", "token", F.lit(True).alias("constant"))
    marked = cells.join(constants, ["leaf", "place", "token"], "left")
    templates = marked.groupBy("leaf", "line").agg(
        F.expr("bit_xor(xxhash64(place, if(constant, token, '<*>')))").alias("template"),
        F.count_if(F.col("constant")).alias("constants"),
        F.count(F.lit(1)).alias("_tokens"),
    )
    # a template of mostly variable fields says too little
    templates = materialize(templates.filter(2 * F.col("constants") >= F.col("_tokens")).select("leaf", "line", "template", "constants"))
    placed = held.join(templates, ["leaf", "line"])
    return same.unionByName(_beyond_first(placed, ["leaf", "template"], F.greatest(F.lit(LEAST_TEXTS), enough(F.col("constants")))))


def drop_recurring_lines(documents: DataFrame) -> DataFrame:
    """The documents with recurring template lines gone from ``text``, and ``n_dropped``; other columns stay.

    The first of all equal lines, and of all lines of a template (smallest doc_id, then place), stays, so no text is lost
    altogether; lines without a token stay. A null text stays null, an empty one empty; an empty table gives an empty one; repeated rows are changed alike. A column
    called n_dropped is replaced.
    """
    gone = recurring_lines(documents).groupBy(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).agg(F.collect_set("pos").alias("_gone"))
    rows = wrapped(documents.drop("n_dropped"))
    old = F.col("row.text")
    joined = rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_content")), "left")

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
        return F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "\n")

    text = F.when(F.col("_gone").isNull(), old).otherwise(let(F.split(old, "\n"), rest))
    dropped = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("bigint").alias("n_dropped")
    return joined.select(*unwrapped(rows, text=text), dropped)


_ENOUGH = f"CASE WHEN constants > {SHORT} THEN greatest(2, CAST(ceil({REPEATED} / constants) AS BIGINT)) WHEN constants > 0 THEN {SHORT_TEXTS} ELSE NULL END"

#: The same in DuckDB, with tokens and texts in place of hashes.
SQL = f"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL
), tokened AS (
  SELECT doc_id, text, pos, list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'),
         lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{FIELD}' ELSE t END) AS tokens
  FROM lines
), leaved AS (
  SELECT *, [CAST(len(tokens) AS VARCHAR)] || tokens[1:{LEADING}] AS leaf, len(list_filter(tokens, lambda t: t <> '{FIELD}')) AS constants
  FROM tokened WHERE len(tokens) > 0
), same AS (
  SELECT tokens, min({{'d': doc_id, 'p': pos}}) AS first FROM leaved GROUP BY tokens, constants HAVING count(DISTINCT text) >= {_ENOUGH}
), wide AS (
  SELECT leaf FROM leaved GROUP BY leaf HAVING count(DISTINCT text) >= {LEAST_TEXTS}
), held AS (
  SELECT * FROM leaved WHERE leaf IN (SELECT leaf FROM wide)
), texts AS (
  SELECT leaf, tokens, count(DISTINCT text) AS n FROM held GROUP BY leaf, tokens
), cells AS (
  SELECT leaf, tokens, n, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM texts
), constants AS (
  SELECT leaf, place, token FROM cells WHERE token <> '{FIELD}' GROUP BY ALL HAVING sum(n) >= {LEAST_TEXTS}
), templates AS (
  SELECT c.leaf, c.tokens, list(CASE WHEN k.token IS NULL THEN '{FIELD}' ELSE c.token END ORDER BY c.place) AS template, count(k.token) AS constants
  FROM cells c LEFT JOIN constants k ON c.leaf = k.leaf AND c.place = k.place AND c.token = k.token
  GROUP BY c.leaf, c.tokens HAVING 2 * count(k.token) >= count(*)
), placed AS (
  SELECT h.doc_id, h.text, h.pos, h.leaf, t.template, t.constants FROM held h JOIN templates t ON h.leaf = t.leaf AND h.tokens = t.tokens
), common AS (
  SELECT leaf, template, min({{'d': doc_id, 'p': pos}}) AS first FROM placed GROUP BY leaf, template, constants
  HAVING count(DISTINCT text) >= greatest({LEAST_TEXTS}, {_ENOUGH})
), drops AS (
  SELECT p.doc_id, p.pos FROM placed p JOIN common c ON p.leaf = c.leaf AND p.template = c.template WHERE p.doc_id <> c.first.d OR p.pos <> c.first.p
  UNION
  SELECT l.doc_id, l.pos FROM leaved l JOIN same s ON l.tokens = s.tokens WHERE l.doc_id <> s.first.d OR l.pos <> s.first.p
), gone AS (
  SELECT doc_id, list(pos) AS gone FROM drops GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_dropped,
  CASE WHEN g.gone IS NULL THEN d.text ELSE coalesce(
    (SELECT string_agg(l.line, chr(10) ORDER BY l.pos) FROM lines l WHERE l.doc_id = d.doc_id AND NOT list_contains(g.gone, l.pos)), '') END AS text
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id
"""
