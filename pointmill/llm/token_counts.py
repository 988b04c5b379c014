"""Token counts by a digest cache.

Content is normalised (null: empty; its UTF-8 bytes otherwise as they are, since every byte-level tokenizer sees
them) and digested. The cache is a Parquet table (tokenizer, digest, n_tokens). Distinct digests that it lacks for
this version of the tokenizer are encoded once each and appended; every document then takes its count by a join.

Defined cases: null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows each get
their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import drop_path, new_path, stored

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def _read_cache(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encoder(tokenizer_json: str, version: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.shared_encoder(tokenizer_json)
        for batch in batches:
            counts = []
            for a, b in bpe.slices(bpe.text_sizes(batch.column("content")), bpe.TEXT_ROOM):
                counts += encoder.count_column(batch.column("content").slice(a, b - a)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts), pa.string()), batch.column("digest").cast(pa.binary()), pa.array(counts, pa.int64())], ["tokenizer", "digest", "n_tokens"])
        encoder.forget()

    return encode


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``cache_path`` is kept and grows; without it the cache is a new table of the shared folder.
    """
    spark = docs.sparkSession
    tokenizer_json = bpe.load(tokenizer_path)
    version = bpe.digest_of(tokenizer_json)
    path = cache_path or new_path(spark, "token-cache")
    content = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), content.alias("content")).withColumn("digest", F.unhex(F.sha2(F.col("content"), 256)))
    before = _read_cache(spark, path, version)
    # the partial step of this aggregate leaves one text of a group of copies in each input split
    misses = keyed.groupBy("digest").agg(F.first("content").alias("content"))
    if before is not None:
        misses = misses.join(before.select("digest"), "digest", "left_anti")
    misses.mapInArrow(_encoder(tokenizer_json, version), CACHE_SCHEMA).write.mode("append").parquet(path)
    # a table of its own, so the join below has two plain sides and adaptive execution can split the digest of many copies
    counts = stored(_read_cache(spark, path, version), "token-counts")
    out = keyed.select("doc_id", "digest", F.octet_length("content").cast("long").alias("n_bytes")).join(counts, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def forget(spark: SparkSession, cache_path: str) -> None:
    drop_path(spark, cache_path)
