"""Vectors of labels: providers, and a cache table that only new labels are encoded for."""

import hashlib
import importlib.util
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions.labels import words
from ontoloom.functions.vectors import l2_normalised

#: (labels of a batch) -> matrix; made once per Python worker
Encoder = Callable[[list[str]], np.ndarray]
DIMENSIONS = 256


def hashed_trigrams(labels: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A deterministic encoder that needs no model: counts of padded character trigrams, hashed with a sign."""
    padded = [f"  {label} " for label in labels]
    grams = [p[i : i + 3] for p in padded for i in range(len(p) - 2)]
    # Each distinct trigram is hashed once.
    said, which = np.unique(np.array(grams, dtype=object).astype(str), return_inverse=True) if grams else (np.zeros(0, str), np.zeros(0, np.int64))
    digests = np.frombuffer(b"".join(hashlib.blake2b(g.encode(), digest_size=8).digest() for g in said.tolist()), np.uint8).reshape(-1, 8)
    at = (digests[:, :4].copy().view("<u4")[:, 0] % np.uint32(dimensions)).astype(np.int64)
    sign = np.where(digests[:, 4] & 1, 1.0, -1.0)
    row = np.repeat(np.arange(len(labels)), [len(p) - 2 for p in padded])
    flat = np.bincount(row * dimensions + at[which], sign[which], len(labels) * dimensions)
    return flat.reshape(len(labels), dimensions).astype(np.float32)


def models_installed() -> bool:
    return importlib.util.find_spec("sentence_transformers") is not None


def model_encoder(name: str, max_tokens: int, batch: int = 256) -> Callable[[], Encoder]:
    """A sentence-transformers model, loaded by each worker; raises ImportError where that library is missing."""

    def load() -> Encoder:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name)
        model.max_seq_length = max_tokens
        return lambda labels: model.encode(labels, batch_size=batch, show_progress_bar=False)

    return load


def encode(labels: DataFrame, make: Callable[[], Encoder] = lambda: hashed_trigrams, normalise: bool = True) -> DataFrame:
    """label, vec of each distinct non-null label, encoded by Arrow batches, of unit length unless told otherwise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for frame in batches:
            got = encoder(frame["label"].tolist())
            yield pd.DataFrame({"label": frame["label"], "vec": list(np.asarray(got, np.float32))})

    out = labels.select("label").where("label is not null").distinct().mapInPandas(run, "label string, vec array<float>")
    return out.select("label", l2_normalised(F.col("vec")).cast("array<float>").alias("vec")) if normalise else out


def read_cache(spark: SparkSession, path: str, model: str) -> DataFrame | None:
    try:
        return spark.read.schema("label string, vec array<float>, model string").parquet(path).where(F.col("model") == model).select("label", "vec")
    except Exception as why:
        if "PATH_NOT_FOUND" in str(why):
            return None
        raise


def split_by_cache(labels: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, vec of labels that the cache has; labels that it lacks), each label once."""
    wanted = labels.select("label").where("label is not null").distinct()
    return wanted.join(cache.select("label", "vec"), "label"), wanted.join(cache.select("label"), "label", "left_anti")


def encode_cached(labels: DataFrame, path: str, model: str = "hashed_trigrams", make: Callable[[], Encoder] = lambda: hashed_trigrams, normalise: bool = True) -> DataFrame:
    """As encode(), with a Parquet cache partitioned by model: misses are encoded, appended and read back."""
    spark, known = labels.sparkSession, read_cache(labels.sparkSession, path, model)
    misses = labels if known is None else split_by_cache(labels, known)[1]
    encode(misses, make, normalise).withColumn("model", F.lit(model)).write.mode("append").partitionBy("model").parquet(path)
    return labels.select("label").where("label is not null").distinct().join(read_cache(spark, path, model), "label")


def token_sets(entities: DataFrame) -> DataFrame:
    """entities with ``tokens``, the set of a label's words: for the token cosine, which needs no vectors."""
    return entities.withColumn("tokens", F.array_distinct(words(F.col("label"))))
