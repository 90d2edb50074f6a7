"""A corpus from raw documents to tokens: rules, near-duplicates, benchmark items, secrets, then token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which run()
writes as Parquet to the shared checkpoint folder and reads again for the next stage.

Defined results: null and empty texts go in the first stage, as texts of under 20 words do; rows that share an id are judged
as one document by each stage that drops documents (they go or stay together, those with a null id too, which near-dedup
keeps); all but the last stage keep every column of documents, whatever else it is called; an empty table gives an empty
table with the columns of the last stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonelake.llm import byte_bpe, decontaminate, near_dedup, quality_rules, secret_scan
from zonelake.llm.common import checkpoint_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    kept = quality_rules.judge(docs).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8) stays, that with the smallest id."""
    gone = near_dedup.cluster(docs, size=5).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and the length follows; every document stays."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document."""
    import public_tokenizers

    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [("quality rules", rules), ("near-dedup", dedup), ("decontamination", benchmark), ("secret scan", secrets), ("byte-level BPE", tokens)]

#: The stages aren't all expressible in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs all stages. Their tables stay in a folder of their own under the checkpoint folder, as the result reads the
    last one; whoever owns that folder removes it."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
