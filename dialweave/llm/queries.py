"""The operators applied to whole tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialweave.llm.alignment import alignments
from dialweave.llm.archives import new_archive_folder, read_archives, write_archives
from dialweave.llm.fingerprints import fingerprints
from dialweave.llm.licenses import license_labels
from dialweave.llm.mixing import mixture
from dialweave.llm.near_dedup import near_duplicates
from dialweave.llm.packing import packed_sequences
from dialweave.llm.passages import repeated_passages
from dialweave.llm.private_data import pseudonymised
from dialweave.llm.spelling import spelling_variants
from dialweave.llm.topk import top_k
from dialweave.llm.toxicity import toxicity_scores
from dialweave.llm.vectors import near_vectors


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_circulant_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_table(spark, sf, "documents"), words=3, percent=85)


def op2_counterfactual_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op3_exponential_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixture(_table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_diagonal_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return license_labels(_table(spark, sf, "documents")).drop("spans")


#: Key of the registered query and pipeline; a real run passes its own secret.
PSEUDONYM_KEY = "registered query"


def op5_feistel_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    done = pseudonymised(_table(spark, sf, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return done.withColumn("private_kinds", F.array_join("private_kinds", ","))


def op6_hilbert_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packed_sequences(_table(spark, sf, "documents"), tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op7_warc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_archive_folder(spark)
    rows = read_archives(write_archives(_table(spark, sf, "pages"), folder), folder)
    return rows.where("last").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


def op8_compact_windows(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_passages(_table(spark, sf, "documents"))


def op9_pivot_permutations(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(_table(spark, sf, "embeddings"))


def op10_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints(_table(spark, sf, "documents"))


def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignments(_table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_block_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(_table(spark, sf, "embeddings"), divisor=50, k=5)


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(_table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (
        op1_circulant_minhash,
        op2_counterfactual_toxicity,
        op3_exponential_mixing,
        op4_diagonal_licenses,
        op5_feistel_pseudonyms,
        op6_hilbert_packing,
        op7_warc_chunks,
        op8_compact_windows,
        op9_pivot_permutations,
        op10_winnowing,
        op11_token_alignment,
        op12_block_top_k,
        op13_spelling_variants,
    )}

#: Where SQL can express the whole result; the other queries are tested against brute force.
SQL: dict[str, str] = {
    "op7_warc_chunks": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest,
         CASE WHEN octet_length(encode(html)) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keeper
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM r
""",
    "op12_block_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
""",
}
