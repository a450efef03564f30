"""A folder for intermediate tables that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Temporary folders of local sessions, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.get(context.applicationId)
        if not root:
            root = _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing was written to."""
    return f"{shared_folder(spark)}/astrolabe/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes what is at a path of any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
