"""Tables and files that jobs write on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of a local session that names no shared one, and what this process has written.
_own: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  A local session that names none
    gets a temporary one, the same for the whole process; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = _own.get("shared") or _own.setdefault("shared", tempfile.mkdtemp(prefix="spark-"))
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/codefacts/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def discard(*tables: DataFrame) -> None:
    """Remove tables of settled() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(df._scratch)


def cleanup(spark: SparkSession) -> int:
    """Remove what this process has put under scratch_path(), and count it.  Results read such tables
    lazily, so this is for when they have been written elsewhere."""
    java = spark.sparkContext._jvm.org.apache.hadoop.fs
    removed = 0
    while _written:
        path = java.Path(_written.pop())
        removed += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return removed
