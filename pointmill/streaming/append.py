"""Incremental arrival of points: an extension of this library; the formats themselves know no streams.

Files of points that arrive in a folder are quantized to a fixed origin and appended with their key at a fixed level,
so later builds read only the cells that changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointmill.functions import records as r
from pointmill.operators.lod import with_keys


def placed(points: DataFrame, scale: Sequence[float], low: Sequence[float], edge: float, level: int) -> DataFrame:
    """World positions wx, wy, wz as x, y, z, px, py, pz and the key kx, ky, kz at a level."""
    q = points.withColumns({a: r.quantize(F.col(f"w{a}"), F.lit(s), F.lit(o)) for a, s, o in zip("xyz", scale, low)})
    q = q.withColumns({f"p{a}": r.dequantize(F.col(a), F.lit(s), F.lit(o)) for a, s, o in zip("xyz", scale, low)})
    return with_keys(q, low, edge, level)


def append(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, scale: Sequence[float], low: Sequence[float], edge: float, level: int = 4) -> StreamingQuery:
    """Runs over all files that are there and not yet taken, then stops; the target is partitioned by cell."""
    stream = spark.readStream.schema(schema).parquet(source)
    cells = placed(stream, scale, low, edge, level).withColumn("cell", F.concat_ws("-", "kx", "ky", "kz"))
    return cells.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("cell").trigger(availableNow=True).start()


def changed_cells(spark: SparkSession, target: str) -> DataFrame:
    """Points by cell of what was appended."""
    return spark.read.parquet(target).groupBy("cell").agg(F.count("*").alias("points"))
