"""The registered queries of this subpackage: thin digests of what its operators give."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_codec, chat, exact_dedup, html_extract, knn, ngram_join, packing, quality, token_store, toxicity
from .shared import held_out, table, written

#: At most so many labelled rows teach a classifier.
TRAIN_ROWS = 30_000


def taught(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Labelled ``text, label`` rows to learn from: none that is held out, a bounded number."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.labelled_texts(documents, labels, label, ~held_out(), TRAIN_ROWS)


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    columns = [F.col("doc_id"), held_out().alias("held_out"), F.col("score"), (F.col("score") >= threshold).cast("int").alias("predicted")]
    return scored.select(*columns, *[c for c in scored.columns if c not in ("doc_id", "score")])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.fit(taught(spark, sf_dir, "toxic"))
    return _judged(toxicity.score(table(spark, sf_dir, "documents"), model), 0.5)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality.fit(taught(spark, sf_dir, "quality"))
    return _judged(quality.score(table(spark, sf_dir, "documents"), model), 0.3)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_byte_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_codec.digests(byte_codec.encode(table(spark, sf_dir, "documents"), ranks), ranks)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(written(chat.expand(turns), "chat"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read(manifest).withColumnRenamed("key", "doc_id")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest=True)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_byte_codec, op4_chat, op5_ngram_join, op6_token_store, op7_quality, op8_html_extract, op9_exact_dedup, op10_top_k)}

#: DuckDB's own regexp_replace and sha256 say the same as the refinement does.
ORACLE_SQL = {
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
    """,
    "op10_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
        SELECT query_id, place::INTEGER AS rank, vec_id, score FROM r WHERE place <= 20
    """,
}
