"""Helpers that the training-data operators share: tables, shared storage, text to words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set once per application where ``spark.checkpoint.dir`` is unset (tests, a laptop).
_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, or an own one where that is unset."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="pointmill-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/pointmill/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read again: cuts its lineage, and survives a lost executor."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, label))
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_stored(df: DataFrame) -> None:
    """Removes what ``stored`` wrote."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/pointmill/" in path:
            drop_path(df.sparkSession, path)


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint if the frame's counted rows are within the limit, else the frame as it is."""
    return F.broadcast(df) if rows <= limit else df


def fresh(name: str, taken: list[str]) -> str:
    """The name, lengthened until no taken one is like it."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % parts


def sliced(batches: Iterator, rows: int = 500) -> Iterator:
    """The batches in slices of a few rows, so what is made of long texts is handed on early."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8 bytes (bytes.split and bytes.lower know ASCII alone)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


__all__ = ["StorageLevel", "drop_path", "drop_stored", "fold", "fresh", "new_path", "shared_dir", "sliced", "small", "stored", "table", "words_of"]
