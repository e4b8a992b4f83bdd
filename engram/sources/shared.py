"""Tables and checkpoints in the folder that driver and executors share; what is written here is deleted when the driver ends."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. One of our own only where none is set and driver and executors are one
    process (tests); on a cluster without a shared folder: an error, since executors can't share a local one."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="engram-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if the session still lives."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone: the cluster's own clean-up of the shared folder is left
        pass


@functools.lru_cache(maxsize=4)
def _own(application: str, base: str) -> str:
    folder = f"{base.rstrip('/')}/engram-{application}-{uuid.uuid4().hex[:8]}"
    spark = SparkSession.getActiveSession()
    if spark is not None:
        atexit.register(delete, spark, folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    return f"{_own(spark.sparkContext.applicationId, shared_folder(spark))}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder.

    Written as Parquet: a checkpointed DataFrame keeps the size its plan was estimated at, and over many rounds of joins
    that estimate, a product, grows so long that multiplying it takes seconds.
    """
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
