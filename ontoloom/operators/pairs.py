"""All pairs of a source's and a target's label of one type that share a rare word, and their similarities.

Labels meet in tiles: those of a word are dealt into blocks of about TILE a side, each block goes to each block of the
other side, and a tile is scored where it lies. What is shuffled are labels, never pairs: of the rare words that two
labels share only the rarest one pairs them, so that no pair comes twice and none has to be compared with others.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions import pairwise
from ontoloom.functions.labels import words
from ontoloom.shared import written

#: labels a side; keys of fewer than PACK share a tile; pairs of a batch; pairs that a task is meant to score
TILE, PACK, BATCH, TASK = 1024, 64, 1 << 15, 1 << 21
KEY = ["etype", "token", "s_tile", "t_tile"]

#: (labels, labels, places in the first, places in the second, weights of the type's words) to one value a pair
Kernel = Callable[[list[str], list[str], np.ndarray, np.ndarray, dict[str, float]], np.ndarray]


def _dealt(labels: DataFrame, most: int, tile: int, idf: DataFrame | None) -> DataFrame:
    """KEY, side, label, before (the label's rarer words), weights: a row for each tile that a label is in."""
    told = written(labels.select("etype", "side", "label").distinct().withColumn("id", F.monotonically_increasing_id()), "labels")
    said = told.select("id", "etype", "side", F.explode(F.array_distinct(words(F.col("label")))).alias("token"))
    rarity = said.groupBy("etype", "token").agg(F.count(F.lit(1)).alias("df"))
    if idf is not None:
        rarity = rarity.join(idf, ["etype", "token"], "left")
    weight = F.lit(None).cast("double") if idf is None else F.coalesce("idf", F.lit(1.0))
    sets = said.join(rarity, ["etype", "token"]).groupBy("id", "etype", "side").agg(F.collect_list(F.struct("df", "token", weight.alias("w"))).alias("r"))
    rare = F.transform(F.slice(F.sort_array("r"), 1, most), lambda x: x["token"])
    # In the order of the words themselves, so that these need not be sent.
    weights = F.lit(None).cast("array<double>") if idf is None else F.transform(F.sort_array(F.transform("r", lambda x: F.struct(x["token"].alias("token"), x["w"].alias("w")))), lambda x: x["w"])
    sets = written(sets.select("id", "etype", "side", rare.alias("rare"), weights.alias("weights")), "rare")
    each = sets.where("side in (0, 1)").select("id", "etype", "side", F.posexplode("rare").alias("at", "token"))
    sizes = each.groupBy("etype", "token").agg(F.count_if(F.col("side") == 0).alias("ns"), F.count_if(F.col("side") == 1).alias("nt"))
    sizes = written(sizes.where("ns > 0 and nt > 0"), "sizes")
    work = sizes.agg(F.sum(F.col("ns").cast("double") * F.col("nt"))).first()[0] or 0.0
    left = F.col("side") == 0
    own, other = (F.greatest(F.lit(1), F.ceil(n / tile)).cast("int") for n in (F.when(left, F.col("ns")).otherwise(F.col("nt")), F.when(left, F.col("nt")).otherwise(F.col("ns"))))
    # Labels, the long part, join last.
    slim = each.join(sizes, ["etype", "token"]).select("id", "etype", "token", "side", "at", F.pmod(F.xxhash64("id"), own).cast("int").alias("_own"), other.alias("_n"))
    placed = slim.join(told.select("id", "label").join(sets.select("id", "rare", "weights"), "id"), "id")
    placed = placed.select("etype", "token", "side", "label", F.slice("rare", F.lit(1), F.col("at")).alias("before"), "weights", "_own", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_other"))
    placed = placed.select("etype", "token", F.when(left, F.col("_own")).otherwise(F.col("_other")).alias("s_tile"), F.when(left, F.col("_other")).otherwise(F.col("_own")).alias("t_tile"), "side", "label", "before", "weights")
    tasks = max(int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 16, int(work / TASK)))
    return placed.repartition(tasks, *KEY).sortWithinPartitions(*KEY)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list, list]]:
    """(type, rows of the left, rows of the right): whole keys, several where they are small. A row: number of its key, label, before, weights."""
    key, n, sides = None, 0, ([], [])
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:4] != key:
                if key and (row[0] != key[0] or max(map(len, sides)) >= PACK):
                    yield key[0], *sides
                    sides = ([], [])
                key, n = row[:4], n + 1
            sides[row[4]].append((n, *row[5:]))
    if key:
        yield key[0], *sides


def _met(left: list, right: list) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs: of one key, without a rarer word that both have."""
    keys = (np.array([r[0] for r in rows], np.int64) for rows in (left, right))
    a, b = keys
    return np.nonzero((a[:, None] == b[None, :]) & (pairwise.shared([r[2] for r in left], [r[2] for r in right]) == 0))


def _one(values: pa.Array) -> pa.Array:
    """A column of one row, the list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def scored(labels: DataFrame, kernels: dict[str, Kernel], most: int = 8, idf: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """etype, a, b and a column for each kernel (NaN: null): all pairs of distinct labels, a of side 0 and b of side 1,
    that share one of the ``most`` rarest words of both.

    ``labels``: etype, side, label. ``idf``: etype, token, idf, for kernels that weigh words; an unknown word weighs 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for etype, left, right in _tiles(batches):
            if not left or not right:
                continue
            i, j = _met(left, right)
            s, t = ([r[1] for r in rows] for rows in (left, right))
            weights = {w: x for r in [*left, *right] if r[3] for w, x in zip(sorted(set(r[1].split(" ")) - {""}), r[3], strict=True)}
            values = [np.asarray(kernel(s, t, i, j, weights), np.float64) for kernel in kernels.values()] if len(i) else []
            for at in range(0, len(i), BATCH):
                here = slice(at, at + BATCH)
                yield pa.RecordBatch.from_arrays([
                    pa.array([etype], pa.string()), pa.array([s], pa.list_(pa.string())), pa.array([t], pa.list_(pa.string())), *(_one(pa.array(x[here].astype(np.int32))) for x in (i, j)), *(_one(pa.array(v[here], from_pandas=True)) for v in values),
                ], ["etype", "s", "t", "i", "j", *names])

    # Places in the lists leave Python, not the labels, each of which is in many pairs.
    names = [f"v{n}" for n in range(len(kernels))]
    found = _dealt(labels, most, tile, idf).mapInArrow(run, ", ".join(["etype string, s array<string>, t array<string>, i array<int>, j array<int>", *(f"{name} array<double>" for name in names)]))
    each = found.select("*", F.posexplode("i").alias("_at", "_i"))
    at = F.col("_at")
    return each.select("etype", F.get("s", F.col("_i")).alias("a"), F.get("t", F.get("j", at)).alias("b"), *(F.get(name, at).alias(kernel) for name, kernel in zip(names, kernels, strict=True)))
