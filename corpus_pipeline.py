"""The corpus pipeline: documents in, token identifiers out, one written table after each stage.

Quality rules, exact deduplication, near-duplicate removal, mixing of sources, encoding. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelflow.llm.bpe import encode
from panelflow.llm.exact_dedup import drop_exact_duplicates
from panelflow.llm.mixing import mixed_documents
from panelflow.llm.quality import drop_low_quality
from panelflow.llm.simhash import drop_near_copies
from panelflow.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return drop_low_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier stays."""
    return drop_exact_duplicates(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest identifier stays."""
    return drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, taken once or taken again."""
    return mixed_documents(docs, length="n_chars")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token identifiers of every document of the mix, and digests of them and of the decoded text."""
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("BPE", encoded),
]

#: SQL cannot express the SimHash and tokeniser stages; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
