"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster names one, else the session's checkpoint folder.

    Only a session in one process may do without both; it uses a folder under /tmp.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            folder = jvm_dir.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = "/tmp/checkpoints/vectrail"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/vectrail-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it again: cuts the lineage and survives lost executors. Lazy results may read the table as long as the session lives."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def drop_tables() -> None:
    """Delete what ``new_path`` named, if its session still runs; callers may do so earlier, once no result reads it."""
    while _written:
        spark, path = _written.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended, and its tables stay for whoever clears the folder
            return
