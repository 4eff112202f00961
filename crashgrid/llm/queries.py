"""Registered queries of the corpus operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import oracle, url_filter
from .bpe import token_digests
from .chat_format import chat_digests
from .decontaminate import find_contamination
from .filter_audit import audit_filters
from .merkle import document_audit
from .neighbours import nearest
from .passages import repeated_passages
from .secret_scan import find_secrets
from .sharding import shard_manifest
from .shared import bound_batches
from .simhash import simhash_components
from .toxicity import held_out, score_toxicity, train_toxicity
from .warc import archive_roundtrip


def tokenizer_path() -> str:
    """Where the installed package of public vocabularies keeps the tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_points")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_manifest(_table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted",
                         "n_offending", "worst_start", "worst_end", "worst_probability")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_roundtrip(_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_audit(_table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations")
    one = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit(oracle.ADDED_TURN).alias("text"))
    return chat_digests(table.select(*one.columns).unionByName(one))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_filter": op3_url_filter,
    "op4_secret_scan": op4_secret_scan,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_warc": op9_warc,
    "op10_bpe": op10_bpe,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_chat_format": op13_chat_format,
}

#: A window is looked up as its words joined by a space; sizes below 10 are whole short items.
_OP2 = """
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '{word}') AS w
             FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '{word}') AS w
         FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
run AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS g
        FROM (SELECT doc_id, w, s.size, unnest(range(1, len(w) - s.size + 2)) AS i
              FROM doc, (SELECT DISTINCT size FROM win) s WHERE len(w) >= s.size)),
hit AS (SELECT DISTINCT doc_id, i, run.size, item_id FROM run JOIN win USING (size, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM
            (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',')
          AS ids FROM hit GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""".format(
    up=url_filter.UPPER, low=url_filter.LOWER, word=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_OP8 = """
WITH v AS (SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20"""

_OP9 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest
      HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""

ORACLE = {
    "op2_decontaminate": _OP2,
    "op3_url_filter": url_filter.oracle_sql(),
    "op8_nearest_neighbours": _OP8,
    "op9_warc": _OP9,
    "op11_filter_audit": oracle.OP11,
    "op12_merkle_manifest": oracle.op12(),
    "op13_chat_format": oracle.OP13,
}
