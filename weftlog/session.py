"""Sessions and the shared folder for cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Where that is unset, a local master
    gets a temporary folder and any other master a folder below the warehouse.
    """
    sc = spark.sparkContext
    if (known := sc.getCheckpointDir()) is not None:
        return known
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and sc.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="weftlog-")
    elif folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints/{uuid.uuid4().hex}"
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Tasks a core that write a narrow table: more would leave many small files.
WAVES = 4


def settle(df: DataFrame, compact: bool = False, narrow: bool = False, parts: int | None = None) -> DataFrame:
    """Compute once, into the shared folder; what follows survives lost executors.

    `compact` is for narrow rows made from a scan of wide ones: they are dealt anew, so that they go into few files of a good size
    instead of one small file for each task of the scan. `narrow`: rows that end in a light step, in WAVES files a core of the cluster
    at most, and `parts` in so many at most.
    """
    shared_folder(df.sparkSession)
    df = df.hint("rebalance") if compact else df
    if compact or narrow:
        parts = WAVES * df.sparkSession.sparkContext.defaultParallelism
    return (df.coalesce(parts) if parts else df).checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`settle` for rows of numbers that many queries read in part: as Parquet, a few bytes a row and only the columns that are asked for.

    The planner takes such a table for as small as its files, so what is joined to it needs `large`.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is never broadcast.

    Adaptive execution goes by the size of shuffled bytes, which are compressed: a side of 10 MB there may take the driver hundreds.
    """
    return df.hint("merge")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files and settled tables that nothing refers to any more.

    It finds them when the driver collects garbage, which a driver with little to do may not do for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
