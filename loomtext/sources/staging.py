"""Tables that a loop or several results read: written once in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset and all runs on this machine, a temporary folder until the end."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="loomtext-staged-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def staged(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table of the shared folder: read as often as needed, and not computed again when an executor is lost."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove tables of staged() that nothing reads any more; other tables are left alone."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        root = path(shared_folder(spark)).toUri().getPath()
        for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
            at = path(folder)
            if at.getParent().toUri().getPath() == root:
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
