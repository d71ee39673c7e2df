"""The corpus pipeline: toxicity, near duplicates, private data, mixing, packing.

Each stage takes what its predecessor kept and returns documents with the same
columns; the last returns pieces of training sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialweave.llm.mixing import mixed_documents
from dialweave.llm.near_dedup import distinct_documents
from dialweave.llm.packing import packed_sequences
from dialweave.llm.private_data import pseudonymised
from dialweave.llm.queries import PSEUDONYM_KEY, tokenizer_path
from dialweave.llm.toxicity import learn, score_column
from dialweave.session import shared_dir


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; the labels beside the documents teach the model."""
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(score_column(model) < 0.5)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return distinct_documents(docs, words=5, percent=80)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, private values replaced; n_chars follows the new text."""
    done = pseudonymised(docs, PSEUDONYM_KEY).drop("n_private", "private_kinds")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind))
        done = done.withColumn("n_chars", length)
    return done.select(*[F.col(f"`{c}`") for c in docs.columns if c in done.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the target weights of their sources ask."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, neighbours on the curve together."""
    return packed_sequences(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("private_data", with_pseudonyms),
    ("mixing", mixed),
    ("packing", packed),
]

#: Signatures, the fit and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
