"""A folder that the driver and all executors share, for files that queries write and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Folders that were given out in this session.
MADE: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or under the one set in the context; a local one only where neither is set and all runs in one process, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isEmpty() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = own.get() if own.isDefined() else "/tmp/terrane-checkpoints"
    MADE.append(f"{at.rstrip('/')}/terrane-{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def sweep(spark: SparkSession) -> None:
    """Deletes what the folders given out so far hold, and what was written beside them; call it once the results that read them are stored elsewhere."""
    while MADE:
        parent, name = MADE.pop().rsplit("/", 1)
        folder = spark._jvm.org.apache.hadoop.fs.Path(parent)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{name}*")) or ():
            files.delete(found.getPath(), True)
