"""Places that every executor can reach, and tables written there.

A table is removed once its maker says that nothing reads it, and all of them when the driver's process ends.
"""

import atexit
import shutil
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (tests, one machine) a new folder becomes it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("spark.ontoloom.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ontoloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.ontoloom.scratch", found)
    return found.rstrip("/")


#: places that are still there
_PLACES: set[str] = set()


def new_place(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    place = f"{shared_folder(spark)}/ontoloom/{name}-{uuid.uuid4().hex}"
    _PLACES.add(place)
    return place


def discard(place: str) -> None:
    """Removes a place with all that it holds; one that is not there, or can't be removed, is left."""
    _PLACES.discard(place)
    try:
        where, path = fs.FileSystem.from_uri(place)
        where.delete_dir(path)
    except (OSError, ValueError):
        pass


@atexit.register
def _discard_all() -> None:
    for place in list(_PLACES):
        discard(place)


def place_of(table: DataFrame) -> str:
    """Where written() put a table."""
    return table._ontoloom_place


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, which outlives any executor."""
    spark, place = df.sparkSession, new_place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(place)
    out = spark.read.schema(df.schema).parquet(place)
    out._ontoloom_place = place
    return out


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever columns it came with."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
