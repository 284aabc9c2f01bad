"""From raw documents to packed sequences, in five stages that each call one operator.

Each stage gets all that its predecessor kept, reread from Parquet. Quality rules drop rejected
documents and failed lines; near-dedup keeps the smallest doc_id of each component; decontamination
drops documents that hold a benchmark window; the secret scan blanks out findings; packing cuts the
rest into sequences. All but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from ontoloom.llm import decontaminate, packing, quality, secrets, simhash
from ontoloom.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", pack)]

#: SQL has neither the stages' fingerprints nor their tokens: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
