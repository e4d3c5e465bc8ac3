"""Folders for tables that are derived from others and kept while those stay as they are."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Where that is unset, a temporary one if driver and executors are one process;
    on a cluster an error, for executors would not see it."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        made = tempfile.mkdtemp(prefix="fieldmark-index-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _own = f"file://{made}"
    return _own


def hadoop_path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, fs = hadoop_path(spark, path)
    return fs.exists(found)


def state_of(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of the files under ``path``: another one once they change."""
    found, fs = hadoop_path(spark, path)
    files = fs.listFiles(found, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:32]


def written(rows: DataFrame) -> DataFrame:
    """``rows`` written to the scratch folder once and read again: a small table that plans read many times, and would else make anew each time. It goes when
    the process ends. On a cluster without a shared folder rows stay as they are."""
    spark = rows.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.sparkContext.master.startswith("local[")):
        return rows
    path = f"{scratch_folder(spark)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(rows.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        found, fs = hadoop_path(spark, path)
        fs.delete(found, True)
    except Exception:  # the session may have ended before the process
        pass
