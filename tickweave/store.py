"""Written intermediate tables and size-derived partition counts."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a local master gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tickweave-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


#: Bytes of the tables read that go into one file of a small table.
FILE_BYTES = 32 << 20


def materialize(df: DataFrame, *spent: DataFrame, small: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and lost executors cost no recomputation.

    A small table comes in few files, one for each FILE_BYTES of what it reads, not one for each shuffle partition; its
    last step then runs in so many tasks. Tables behind ``spent``, frames that materialize() returned and nothing needs once df is written, are deleted then;
    the others go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tickweave/{uuid.uuid4().hex}"
    (df.coalesce(partitions_for(df, FILE_BYTES, 1)) if small else df).write.parquet(path)
    store, place = _place(spark, path)
    store.deleteOnExit(place)
    for frame in spent:
        discard(frame)
    out = spark.read.schema(df.schema).parquet(path)
    out._tickweave_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that materialize() returned."""
    store, place = _place(df.sparkSession, df._tickweave_path)
    store.delete(place, True)
    store.cancelDeleteOnExit(place)


def partitions_for(df: DataFrame, each: int, least: int | None = None) -> int:
    """Partitions of about ``each`` bytes for the tables that df reads; at least spark.sql.shuffle.partitions.

    Inputs whose size Catalyst does not know, such as local rows, count as nothing.
    """
    least = least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return max(least, math.ceil(sum(x for x in sizes if x < 1 << 60) / each))


def unused(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names with as many underscores before them as tell them apart, in any case, from columns."""
    taken = {c.lower() for c in columns}
    return [next(n for n in ("_" * k + name for k in range(len(taken) + 1)) if n.lower() not in taken) for name in wanted]
