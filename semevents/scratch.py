"""Written tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written tables and checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and everything runs in one process is a
    temporary folder made; on a cluster it would be another one on each machine, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = named or f"file://{tempfile.mkdtemp(prefix='semevents-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, kind: str = "tables") -> str:
    """A new folder's name, below one of the running application."""
    return f"{scratch_dir(spark)}/{kind}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query as soon as it has ended, not once they are collected as garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back. ``tidy``: its shuffle files go once it is written."""
    spark = df.sparkSession
    path = scratch_path(spark)
    before = spark.conf.get(_TIDY, None)
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` wrote, once nothing that is still to run reads them."""
    for t in tables:
        _delete(t.sparkSession, t.scratch)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that this application has written. For the end of a job: results must have been read."""
    _delete(spark, f"{scratch_dir(spark)}/tables/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
