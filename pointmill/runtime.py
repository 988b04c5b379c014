"""Shared storage: tables that cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
#: Rows of a per-node or per-input table that may be broadcast.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of this application where that is unset."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="pointmill-")
    return _OWN_DIR[app]


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame, written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pointmill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
