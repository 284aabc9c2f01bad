"""Aligning entities as they arrive: an extension of the batch plan to Structured Streaming.

Each micro-batch of source entities is aligned with the targets that no earlier batch has claimed;
accepted pairs are appended to a claims table, one folder per batch, so a batch that is run again after
a failure replaces its own claims and nothing else.
"""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ontoloom.config import Settings
from ontoloom.plans.align import align

CLAIMS = "source string, target string, etype string, score double, batch long"


def claims(spark, path: str, before: int | None = None) -> DataFrame:
    """All accepted pairs, or those of batches before a number."""
    try:
        found = spark.read.schema(CLAIMS).parquet(path)
    except Exception as why:
        if "PATH_NOT_FOUND" not in str(why):
            raise
        found = spark.createDataFrame([], CLAIMS)
    return found if before is None else found.where(f"batch < {int(before)}")


def align_batch(batch: DataFrame, number: int, targets: DataFrame, path: str, settings: Settings = Settings(), vectors: DataFrame | None = None) -> None:
    """Aligns one micro-batch (uri, label, etype, parents) and writes its claims."""
    spark = batch.sparkSession
    taken = claims(spark, path, number)
    free = targets.join(taken.select(taken["target"].alias("uri")), "uri", "left_anti")
    fresh = batch.join(taken.select(taken["source"].alias("uri")), "uri", "left_anti")
    align(fresh, free, settings, vectors).write.mode("overwrite").parquet(f"{path}/batch={number}")


def align_stream(sources: DataFrame, targets: DataFrame, path: str, checkpoint: str, settings: Settings = Settings(), vectors: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Starts the query; ``trigger`` as in DataStreamWriter.trigger, by default all that is there, then stop."""
    run = lambda batch, number: align_batch(batch, number, targets, path, settings, vectors)
    return sources.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
