"""Tables that cut lineage, and reading documents."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one only where the session names none and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "local").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomtext-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lost executors then cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Remove a table of written() that nothing reads any more. Only folders below shared_dir() are touched."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(shared_dir(spark)).toUri().getPath()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        at = path(folder)
        if at.getParent().toUri().getPath() == root:
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_id() -> Column:
    """A 64-bit hash that stands for the text; that of an empty one for a null text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def of_rows(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Join docs with rows (doc_id, tid) of their documents by id and text: a null id is one too, and an id may have two texts."""
    asked = rows.select(*[F.col(c).alias({"doc_id": "_asked_id", "tid": "_asked_tid"}.get(c, c)) for c in rows.columns])
    same = F.col("doc_id").eqNullSafe(F.col("_asked_id")) & (text_id() == F.col("_asked_tid"))
    return docs.join(asked.hint("merge"), same, how)


def own_id(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns of the caller never clash; a null text is empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
