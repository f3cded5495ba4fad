"""Tables in the folder that all executors share; the way lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset and all runs in this process, a temporary one is set; a cluster has to name one."""
    name = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not name:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        name = tempfile.mkdtemp(prefix="tessergraph-")
        spark.conf.set("spark.checkpoint.dir", name)
    return name.rstrip("/")


#: Rows of a file of a table whose size is known before it is written.
FILE_ROWS = 500_000


#: Seconds between two collections of the driver's garbage, after which Spark deletes the shuffle files of plans that are gone; left alone it does so every half hour.
COLLECT_S = 10
_collected = 0.0


def _collect(spark: SparkSession) -> None:
    global _collected
    if time.monotonic() - _collected > COLLECT_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def materialize(df: DataFrame, label: str, rows: int | None = None, codec: str = "snappy", collect: bool = False) -> DataFrame:
    """Cuts the lineage with a table that outlives any executor.

    Where the caller knows an upper bound of the rows, there are no more files than
    those need: many small files cost more than what is in them, on a file system
    without native access a process each for its permissions. `collect` frees the disk
    that the shuffles of earlier tables still take.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.option("compression", codec).parquet(path)
    if collect:
        _collect(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the table behind a frame made by `materialize` that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
