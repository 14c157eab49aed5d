"""Helpers that the operators share: small column rules, and the scratch tables of the core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import release, saved  # noqa: F401


#: Bytes of rows that Python workers get at a time, where the session names no other size.
BATCH_BYTES = 4 << 20


def batched(df: DataFrame) -> DataFrame:
    """``df``; from now on its session sends rows to Python in batches of bounded bytes, however long texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def widened(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of ``df`` with more columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(c, T.StructType.fromDDL(f"x {kind}")[0].dataType) for c, kind in kinds.items())])
