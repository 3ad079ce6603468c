"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import (
    html_marginals,
    line_templates,
    merkle_manifest,
    order_minhash,
    pattern_packing,
    phrase_automata,
    pii_surrogates,
    piece_bpe,
    ptolemaic_clusters,
    quality_rules,
    secret_automaton,
    voronoi_knn,
    wavelet_shards,
)
from packetloom.llm.common import new_path, read_table

# The key of the queries' surrogates; a user's own is secret.
SECRET = "packetloom"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query(
    "op1_voronoi_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    ), scored AS (
      SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.x, d.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q, v d WHERE q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id
    ), ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = voronoi_knn.integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return voronoi_knn.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


@query("op2_quality_rules", quality_rules.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_rules.rate_documents(read_table(spark, sf_dir, "documents"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_pii_surrogates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii_surrogates.replace_personal_data(read_table(spark, sf_dir, "documents"), SECRET)
    return replaced.select("doc_id", "n_entities", "text")


@query("op4_piece_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_bpe.encode_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return piece_bpe.piece_digests(encoded)


@query("op5_order_minhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "group_id", "copy_of", "is_first")


@query("op6_secret_automaton")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_automaton.secret_spans(read_table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_automaton.BASE_RULES]

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *map(of, base), F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op7_line_templates", line_templates.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_dropped", "text")


@query("op8_wavelet_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    wavelet_shards.write_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return wavelet_shards.read_shards(spark, path)


@query("op9_pattern_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


@query("op10_html_marginals")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_marginals.main_text(read_table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))


@query("op11_ptolemaic_clusters", ptolemaic_clusters.sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ptolemaic_clusters.centroid_clusters(read_table(spark, sf_dir, "embeddings"))


@query("op12_phrase_automata", phrase_automata.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.remove_repeated_passages(read_table(spark, sf_dir, "documents")).drop("kept")


@query("op13_merkle_manifest", merkle_manifest.sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.document_manifest(read_table(spark, sf_dir, "documents")).drop("copies")
