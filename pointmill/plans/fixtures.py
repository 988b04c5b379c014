"""Clouds derived from the relational tables, as expressions that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.functions import records as r
from pointmill.operators.lod import with_keys

SCALE = 0.01
ORDER = ["o1", "o2", "o3", "o4", "o5"]
AXES = "xyz"
POINTS = (
    "l_orderkey AS o1", "l_linenumber AS o2", "l_partkey AS o3", "l_suppkey AS o4", "l_extendedprice AS o5",
    "l_extendedprice AS wx", "l_quantity * 1000 AS wy", "l_discount * 100000 AS wz",
    "CAST(l_partkey % 65536 AS INT) AS intensity", "CAST(l_linenumber % 8 + 8 * 7 + 64 * (l_suppkey % 2) AS INT) AS returns_byte",
    "CAST(l_partkey % 256 AS INT) AS class_byte", "CAST(l_partkey % 181 - 90 AS INT) AS scan_angle_rank", "CAST(l_suppkey % 65536 AS INT) AS point_source_id",
    "l_tax * 100 AS gps_time", "l_returnflag AS flag", "l_linestatus AS status",
    "CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_orderkey % 65536 AS INT) END AS red",
    "CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_partkey % 65536 AS INT) END AS green",
    "CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_suppkey % 65536 AS INT) END AS blue",
)
SCANS = (
    "s_suppkey AS scan_id",
    "CASE s_suppkey % 3 WHEN 0 THEN CAST(1.0 AS DOUBLE) WHEN 1 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS qw",
    "CASE s_suppkey % 3 WHEN 0 THEN CAST(0.0 AS DOUBLE) WHEN 1 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS qz",
    "CAST(s_nationkey * 100 AS DOUBLE) AS tx", "CAST(s_suppkey * 10 AS DOUBLE) AS ty",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*POINTS)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*SCANS)


def quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds qx, qy, qz at SCALE from the extent's minimum, and px, py, pz, the positions that they stand for."""
    li = points(spark, sf_dir)
    low = li.agg(*[F.min(f"w{a}").alias(a) for a in AXES]).first()
    scale = F.lit(SCALE)
    q = li.withColumns({f"q{a}": r.quantize(F.col(f"w{a}"), scale, F.lit(low[a])) for a in AXES})
    return q.withColumns({f"p{a}": r.dequantize(F.col(f"q{a}"), scale, F.lit(low[a])) for a in AXES})


def box(df: DataFrame) -> tuple[list[float], float]:
    """Low corner and edge of the index cube over px, py, pz."""
    row = df.agg(*[F.min(f"p{a}").alias(f"l{a}") for a in AXES], *[F.max(f"p{a}").alias(f"h{a}") for a in AXES]).first()
    return [row[f"l{a}"] for a in AXES], max(row[f"h{a}"] - row[f"l{a}"] for a in AXES)


def keyed(spark: SparkSession, sf_dir: str, level: int) -> DataFrame:
    """The quantized cloud with its node key at a level: kx, ky, kz."""
    q = quantized(spark, sf_dir)
    return with_keys(q, *box(q), level)


def pyramid(spark: SparkSession, sf_dir: str, levels: int = 5) -> DataFrame:
    """Nodes of a full pyramid: points counted at the deepest level, and its keys halved above."""
    leaves = keyed(spark, sf_dir, levels - 1).groupBy("kx", "ky", "kz").agg(F.count("*").alias("n"))
    up = leaves.withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(levels - 1).cast("long"))))
    shrunk = up.select("level", *[F.floor(F.col(f"k{a}") / F.pow(F.lit(2.0), F.lit(levels - 1) - F.col("level"))).alias(a) for a in AXES], "n")
    return shrunk.groupBy("level", *AXES).agg(F.sum("n").alias("point_count"))


# ---- the same for DuckDB --------------------------------------------------------------------------------------------


def round_sql(e: str) -> str:
    return f"(sign({e}) * (floor(abs({e})) + CASE WHEN abs({e}) - floor(abs({e})) >= 0.5 THEN 1 ELSE 0 END))"


def quantize_sql(v: str, scale: str, offset: str) -> str:
    return f"CAST(least(greatest({round_sql(f'(({v} - {offset}) / {scale})')}, -2147483648.0), 2147483647.0) AS INT)"


POINTS_SQL = f"li AS (SELECT {', '.join(POINTS)} FROM lineitem)"
SCANS_SQL = f"scans AS (SELECT {', '.join(SCANS)} FROM supplier)"
QUANTIZED_SQL = f"""{POINTS_SQL},
lows AS (SELECT min(wx) AS x0, min(wy) AS y0, min(wz) AS z0 FROM li),
q0 AS (SELECT li.*, x0, y0, z0, {', '.join(f"{quantize_sql(f'w{a}', str(SCALE) + '::DOUBLE', f'{a}0')} AS q{a}" for a in AXES)} FROM li, lows),
q AS (SELECT *, {', '.join(f"q{a} * {SCALE}::DOUBLE + {a}0 AS p{a}" for a in AXES)} FROM q0),
box AS (SELECT min(px) AS lx, min(py) AS ly, min(pz) AS lz, greatest(max(px) - min(px), max(py) - min(py), max(pz) - min(pz)) AS edge FROM q)"""


def keyed_sql(level: int) -> str:
    """CTEs up to ``keyed``: the walk down, one stage a level."""
    out = [QUANTIZED_SQL, "w0 AS (SELECT q.*, lx, ly, lz, edge, 0::BIGINT AS kx, 0::BIGINT AS ky, 0::BIGINT AS kz FROM q, box)"]
    for n in range(level):
        step = f"(edge / pow(2.0, {n}))"
        child = ", ".join(f"k{a} * 2 + CASE WHEN p{a} >= ((l{a} + {step} * k{a}) + ((l{a} + {step} * k{a}) + {step})) * 0.5 THEN 1 ELSE 0 END AS k{a}" for a in AXES)
        out.append(f"w{n + 1} AS (SELECT * EXCLUDE (kx, ky, kz), {child} FROM w{n})")
    return ",\n".join([*out, f"keyed AS (SELECT * FROM w{level})"])


def pyramid_sql(levels: int = 5) -> str:
    """CTEs up to ``nodes``."""
    shrunk = ", ".join(f"CAST(floor(k{a} / pow(2.0, {levels - 1} - level)) AS BIGINT) AS {a}" for a in AXES)
    return f"""{keyed_sql(levels - 1)},
leaves AS (SELECT kx, ky, kz, count(*) AS n FROM keyed GROUP BY ALL),
nodes AS (
  SELECT level, x, y, z, CAST(sum(n) AS BIGINT) AS point_count
  FROM (SELECT level, {shrunk}, n FROM leaves, (SELECT unnest(range(0, {levels}))::BIGINT AS level)) GROUP BY ALL)"""


_WALKED = "o1, o2, o3, o4, o5, px, py, pz, lx, ly, lz, edge"


def walk_sql(name: str, seed: str, span: int, leaf: int, depth: int) -> str:
    """A recursive CTE over the points of ``seed``, which have a node: each level keeps a node's points or passes them on."""
    step = "(edge / pow(2.0, level))"
    low = {a: f"(l{a} + {step} * k{a})" for a in AXES}
    cell = ", ".join(
        f"CASE WHEN {step} > 0 THEN least(greatest(floor((p{a} - {low[a]}) / ({step} / {span})), 0), {span - 1})::BIGINT ELSE 0 END AS c{a}" for a in AXES
    )
    child = ", ".join(f"k{a} * 2 + CASE WHEN p{a} >= ({low[a]} + ({low[a]} + {step})) * 0.5 THEN 1 ELSE 0 END AS k{a}" for a in AXES)
    decide = f"""SELECT {_WALKED}, level, kx, ky, kz,
           count(*) OVER (PARTITION BY kx, ky, kz) <= {leaf} OR level >= {depth}
           OR row_number() OVER (PARTITION BY kx, ky, kz, cx, cy, cz ORDER BY o1, o2, o3, o4, o5) = 1 AS keep"""
    return f"""{name} AS (
  {decide} FROM (SELECT *, {cell} FROM {seed})
  UNION ALL
  {decide} FROM (SELECT *, {cell} FROM (SELECT {_WALKED}, level + 1 AS level, kx, ky, kz FROM (SELECT {_WALKED}, level, {child} FROM {name} WHERE NOT keep))))"""


def lod_sql(span: int, leaf: int, depth: int, source: str = "q") -> str:
    """CTEs up to ``built`` (o1.., level, kx, ky, kz): the level-of-detail build as a recursion; the WITH needs RECURSIVE."""
    return f"""{QUANTIZED_SQL},
seed AS (SELECT {_WALKED}, 0::BIGINT AS level, 0::BIGINT AS kx, 0::BIGINT AS ky, 0::BIGINT AS kz FROM {source}, box),
{walk_sql("walk", "seed", span, leaf, depth)},
built AS (SELECT o1, o2, o3, o4, o5, px, py, pz, level, kx, ky, kz FROM walk WHERE keep)"""


def chunked_sql(level: int, span: int, leaf: int, depth: int) -> str:
    """The same for a build by the cells of a level: what the cells' roots keep walks once more from the top."""
    return f"""{keyed_sql(level)},
cell_seed AS (SELECT {_WALKED}, {level}::BIGINT AS level, kx, ky, kz FROM keyed),
{walk_sql("cells", "cell_seed", span, leaf, depth)},
top_seed AS (SELECT {_WALKED}, 0::BIGINT AS level, 0::BIGINT AS kx, 0::BIGINT AS ky, 0::BIGINT AS kz FROM cells WHERE keep AND level = {level}),
{walk_sql("top", "top_seed", span, leaf, level)},
built AS (SELECT * FROM cells WHERE keep AND level > {level} UNION ALL SELECT * FROM top WHERE keep)"""
