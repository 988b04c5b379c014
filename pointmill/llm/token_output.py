"""Token ids as ORC: run-length encoded integers in stripes, with row indexes and Bloom filters on document ids.

Documents are dealt into ranges of ascending id; each range becomes one file, encoded while it is written. A file
holds (part, doc_id, at, n_tokens, ids): ``part`` is the file's place in the order, ``at`` the tokens before the
document in its file. A reader may take any stripe alone; a search by doc_id skips stripes and row groups by their minimum and
maximum, and by their Bloom filters. ``token_spans`` adds each file's tokens before it, from one row per file.

Defined cases: null text is an empty text, and gives the end id alone; null ids come first; rows that share an id
are in the order of a digest of their texts; repeated rows are written each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import small

#: Rows, one a file, that may be broadcast.
BROADCAST_FILES = 500_000
#: Bytes of text for a file at most, on average, where the caller gives no number of files.
FILE_BYTES = 256 << 20
SCHEMA = "part int, doc_id long, at long, n_tokens int, ids array<int>"


def _writer(tokenizer_json: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        encoder = bpe.shared_encoder(tokenizer_json)
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").cast(pa.int64())
            for a, b in bpe.slices(bpe.text_sizes(texts), bpe.TEXT_ROOM):
                sizes, values = encoder.encode_column(texts.slice(a, b - a), end_id)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part, np.int32)), ids.slice(a, b - a), pa.array(offsets[:-1].astype(np.int64) + at), pa.array(np.diff(offsets)), lists], ["part", "doc_id", "at", "n_tokens", "ids"])
                at += int(offsets[-1])
        encoder.forget()

    return write


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes ORC files in ascending order of the id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_key").asc()]
    if files is None:
        total = rows.agg(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0.0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // FILE_BYTES) + 1)
    # the digest orders rows that share an id, and lets many of them go to several files; equal rows are alike in any order
    ordered = rows.withColumn("text_key", F.xxhash64("text")).repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    (
        ordered.mapInArrow(_writer(bpe.load(tokenizer_path), end_id), SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(16 << 20))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, at, n_tokens, ids) of the files; filters on doc_id are pushed down to stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The given documents: min-max and Bloom filters leave out stripes and row groups without them."""
    return read_token_ids(spark, path).filter(F.col("doc_id").isin([int(x) for x in doc_ids]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offsets = np.asarray(lists.offsets)
        values = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<i4")).cast("B")
        sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("at"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])


def token_spans(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone, per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    each = read_token_ids(spark, path).mapInArrow(_digests, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # one row per file, so the running sum without a partition is over as many rows as there are files
    files = read_token_ids(spark, path).groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("base"))
    return each.join(small(bases, bases.count(), BROADCAST_FILES), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
