"""Queries over points: extents, quantization, record rules, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.functions import geometry as g
from pointmill.functions import records as r
from pointmill.plans import fixtures as x
from pointmill.plans.registry import query
from pointmill.runtime import checked_broadcast

O = "o1, o2, o3, o4, o5"  # noqa: E741
ROWS = x.ORDER


@query(f"WITH {x.POINTS_SQL} SELECT count(*) AS points, min(wx) AS min_x, min(wy) AS min_y, min(wz) AS min_z, max(wx) AS max_x, max(wy) AS max_y, max(wz) AS max_z FROM li")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = x.points(spark, sf_dir)
    return li.agg(F.count("*").alias("points"), *[F.min(f"w{a}").alias(f"min_{a}") for a in "xyz"], *[F.max(f"w{a}").alias(f"max_{a}") for a in "xyz"])


@query(f"WITH {x.POINTS_SQL} SELECT min(wx) AS x, min(wy) AS y, min(wz) AS z, greatest(max(wx) - min(wx), max(wy) - min(wy), max(wz) - min(wz)) AS edge FROM li")
def index_cube(spark, sf_dir):
    b = bounds(spark, sf_dir)
    low, edge = g.index_cube(tuple(F.col(f"min_{a}") for a in "xyz"), tuple(F.col(f"max_{a}") for a in "xyz"))
    return b.select(*[c.alias(a) for a, c in zip("xyz", low)], edge.alias("edge"))


@query(f"WITH {x.QUANTIZED_SQL} SELECT {O}, qx, qy, qz FROM q")
def quantize(spark, sf_dir):
    return x.quantized(spark, sf_dir).select(*ROWS, "qx", "qy", "qz")


@query(f"WITH {x.QUANTIZED_SQL} SELECT {O}, " + ", ".join(f"{x.quantize_sql(f'p{a}', '0.25::DOUBLE', '1000.0::DOUBLE')} AS r{a}" for a in "xyz") + " FROM q")
def requantize(spark, sf_dir):
    """To a quantum of 0.25 from 1000."""
    q = x.quantized(spark, sf_dir)
    return q.select(*ROWS, *[r.quantize(F.col(f"p{a}"), F.lit(0.25), F.lit(1000.0)).alias(f"r{a}") for a in "xyz"])


_QUANTA = (0.01, 0.0, 1e-9)


@query(
    f"WITH {x.POINTS_SQL}, b AS (SELECT max(wx) - min(wx) AS x, max(wy) - min(wy) AS y, max(wz) - min(wz) AS z FROM li), "
    "s AS (SELECT unnest([x, y, z]) AS size, unnest(['x', 'y', 'z']) AS axis FROM b), t AS (SELECT unnest([0.01, 0.0, 0.000000001])::DOUBLE AS asked), "
    "u AS (SELECT axis, asked, size, CASE WHEN asked > 0 THEN asked ELSE 0.001::DOUBLE END AS plain FROM s, t) "
    "SELECT axis, asked, CASE WHEN size / plain > 2147483647.0 THEN round(size / (2147483647 * 0.9::DOUBLE), 12) ELSE plain END AS scale, size / plain > 2147483647.0 AS coarsened FROM u"
)
def choose_quantum(spark, sf_dir):
    """For each axis and asked quantum: what fits 32 bits."""
    li = x.points(spark, sf_dir)
    sizes = li.agg(*[(F.max(f"w{a}") - F.min(f"w{a}")).alias(a) for a in "xyz"]).selectExpr("stack(3, 'x', x, 'y', y, 'z', z) AS (axis, size)")
    asked = sizes.withColumn("asked", F.explode(F.array(*[F.lit(v) for v in _QUANTA])))
    scale, over = r.quantum(F.col("asked"), F.col("size"))
    return asked.select("axis", "asked", F.when(over, F.round(scale, 12)).otherwise(scale).alias("scale"), over.alias("coarsened"))


def inputs(spark, sf_dir) -> DataFrame:
    """One row per input (line status and return flag): what its header would say."""
    li = x.points(spark, sf_dir)
    return li.groupBy("status", "flag").agg(
        F.count("*").alias("points"),
        *[F.min(f"w{a}").alias(f"min_{a}") for a in "xyz"],
        *[F.max(f"w{a}").alias(f"max_{a}") for a in "xyz"],
        F.max(F.col("red").isNotNull()).alias("colour"),
    )


_INPUTS_SQL = f"""{x.POINTS_SQL}, inputs AS (
  SELECT status, flag, count(*) AS points, min(wx) AS min_x, min(wy) AS min_y, min(wz) AS min_z, max(wx) AS max_x, max(wy) AS max_y, max(wz) AS max_z,
         bool_or(red IS NOT NULL) AS colour FROM li GROUP BY status, flag)"""


@query(
    f"WITH {_INPUTS_SQL} SELECT count(*) AS inputs, CAST(sum(points) AS BIGINT) AS points, min(min_x) AS min_x, min(min_y) AS min_y, min(min_z) AS min_z, max(max_x) AS max_x, max(max_y) AS max_y, max(max_z) AS max_z, "
    "bool_or(colour) AS colour, bool_and(colour) AS all_colour, CASE WHEN bool_or(colour) THEN 7 ELSE 6 END AS format FROM inputs"
)
def scan_summary(spark, sf_dir):
    """One fold over the inputs' headers."""
    i = inputs(spark, sf_dir)
    merged = i.agg(
        F.count("*").alias("inputs"), F.sum("points").alias("points"), *[F.min(f"min_{a}").alias(f"min_{a}") for a in "xyz"], *[F.max(f"max_{a}").alias(f"max_{a}") for a in "xyz"],
        F.bool_or("colour").alias("colour"), F.bool_and("colour").alias("all_colour"),
    )
    return merged.withColumn("format", r.output_format(F.col("colour"), F.lit(False)))


_EVENTS = ("event_id AS o1", "value AS wx", "CAST(user_id AS DOUBLE) AS wy", "CAST(event_id % 86400 AS DOUBLE) AS wz")


@query(f"WITH {x.POINTS_SQL} SELECT o1, wx, wy, wz, gps_time, red, 'lineitem' AS input FROM li UNION ALL SELECT {', '.join(_EVENTS)}, 0.0 AS gps_time, NULL AS red, 'events' AS input FROM events")
def merge_inputs(spark, sf_dir):
    """Two clouds as one; what a source lacks takes its default."""
    li = x.points(spark, sf_dir).select("o1", "wx", "wy", "wz", "gps_time", "red").withColumn("input", F.lit("lineitem"))
    ev = x.table(spark, sf_dir, "events").selectExpr(*_EVENTS).withColumn("input", F.lit("events"))
    return li.unionByName(ev, allowMissingColumns=True).withColumn("gps_time", F.coalesce("gps_time", F.lit(0.0)))


@query(f"WITH {_INPUTS_SQL} SELECT status, flag, CASE WHEN colour THEN 7 ELSE 6 END AS format, CASE WHEN colour THEN 3 ELSE 1 END AS smallest FROM inputs")
def output_format(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return i.select("status", "flag", r.output_format(F.col("colour"), F.lit(False)).alias("format"), r.smallest_format(F.col("colour"), F.lit(True), F.lit(True)).alias("smallest"))


@query(f"WITH {x.POINTS_SQL} SELECT {O}, returns_byte & 7 AS return_number, (returns_byte >> 3) & 7 AS number_of_returns, (returns_byte >> 6) & 1 AS scan_direction, (returns_byte >> 7) & 1 AS edge FROM li")
def bit_unpack(spark, sf_dir):
    b = F.col("returns_byte")
    return x.points(spark, sf_dir).select(*ROWS, r.bits(b, 0, 3).alias("return_number"), r.bits(b, 3, 3).alias("number_of_returns"), r.bits(b, 6, 1).alias("scan_direction"), r.bits(b, 7, 1).alias("edge"))


@query(
    f"WITH {x.POINTS_SQL} SELECT {O}, (returns_byte & 7) + 16 * ((returns_byte >> 3) & 7) AS returns, class_byte & 31 AS classification, "
    "((class_byte >> 5) & 7) + 64 * ((returns_byte >> 6) & 1) + 128 * ((returns_byte >> 7) & 1) AS flags FROM li"
)
def legacy_widen(spark, sf_dir):
    a, b = F.col("returns_byte"), F.col("class_byte")
    return x.points(spark, sf_dir).select(*ROWS, r.legacy_returns(a).alias("returns"), r.legacy_classification(b).alias("classification"), r.legacy_flags(b, a).alias("flags"))


_STEPS = f"CAST({x.round_sql('(scan_angle_rank / 0.006::DOUBLE)')} AS INT)"


@query(f"WITH {x.POINTS_SQL}, s AS (SELECT *, {_STEPS} AS steps FROM li) SELECT {O}, steps, CAST(least(greatest({x.round_sql('(steps * 0.006::DOUBLE)')}, -128), 127) AS INT) AS rank FROM s")
def scan_angle_rank(spark, sf_dir):
    s = x.points(spark, sf_dir).withColumn("steps", r.scan_angle_steps(F.col("scan_angle_rank")))
    return s.select(*ROWS, "steps", r.scan_angle_rank(F.col("steps"))[0].alias("rank"))


@query(f"WITH {x.POINTS_SQL} SELECT {O}, coalesce(red, 65535) AS red, coalesce(green, 65535) AS green, coalesce(blue, 65535) AS blue FROM li")
def fill_colour(spark, sf_dir):
    return x.points(spark, sf_dir).select(*ROWS, *[r.fill_colour(F.col(c)).alias(c) for c in ("red", "green", "blue")])


ATTRIBUTES = ("position", "intensity", "classification", "gps-time", "rgb")
ASKED = ("gps-time", "position", "nothing")


@query(
    f"WITH a AS (SELECT unnest({list(ATTRIBUTES)}) AS name), d AS (SELECT unnest({list(ASKED)}) AS name) "
    "SELECT name, 'kept' AS what FROM a WHERE name = 'position' OR name NOT IN (SELECT name FROM d) UNION ALL SELECT name, 'dropped' FROM a WHERE name <> 'position' AND name IN (SELECT name FROM d) "
    "UNION ALL SELECT name, CASE WHEN name = 'position' THEN 'position-kept' ELSE 'no-such-attribute' END FROM d WHERE name = 'position' OR name NOT IN (SELECT name FROM a)"
)
def drop_columns(spark, sf_dir):
    """A drop list against a cloud's attributes: kept, dropped, and what is warned of."""
    a = spark.createDataFrame([(n,) for n in ATTRIBUTES], "name string")
    d = spark.createDataFrame([(n,) for n in ASKED], "name string")
    position = F.col("name") == "position"
    gone = a.join(d, "name", "left_semi").filter(~position)
    kept = a.join(gone, "name", "left_anti").withColumn("what", F.lit("kept"))
    warned = d.filter(position).withColumn("what", F.lit("position-kept")).unionByName(d.join(a, "name", "left_anti").withColumn("what", F.lit("no-such-attribute")))
    return kept.unionByName(gone.withColumn("what", F.lit("dropped"))).unionByName(warned)


@query(f"WITH {x.POINTS_SQL} SELECT o4 AS scan, count(*) FILTER (o3 % 3 <> 2) AS valid, count(*) FILTER (o3 % 3 = 2) AS dropped, min(wx) FILTER (o3 % 3 <> 2) AS min_x, max(wx) FILTER (o3 % 3 <> 2) AS max_x FROM li GROUP BY o4")
def drop_invalid(spark, sf_dir):
    """Points whose state (here from the part key) is not valid are dropped, and counted; the extent is of the others."""
    valid = F.col("o3") % 3 != 2
    li = x.points(spark, sf_dir)
    at = F.when(valid, F.col("wx"))
    return li.groupBy(F.col("o4").alias("scan")).agg(F.count_if(valid).alias("valid"), F.count_if(~valid).alias("dropped"), F.min(at).alias("min_x"), F.max(at).alias("max_x"))


_POSED_SQL = """posed AS (
  SELECT o1, o2, o3, o4, o5, (1 - 2 * (qz * qz)) * wx + (-2 * (qw * qz)) * wy + tx AS mx, (2 * (qw * qz)) * wx + (1 - 2 * (qz * qz)) * wy + ty AS my, wz AS mz
  FROM li JOIN scans ON o4 = scan_id)"""


def posed_points(spark, sf_dir) -> DataFrame:
    s = x.scans(spark, sf_dir)
    joined = x.points(spark, sf_dir).join(checked_broadcast(s, s.count()), F.col("o4") == F.col("scan_id"))
    zero = F.lit(0.0)
    p = r.posed((F.col("wx"), F.col("wy"), F.col("wz")), (F.col("qw"), zero, zero, F.col("qz")), (F.col("tx"), F.col("ty"), zero))
    return joined.withColumns(dict(zip(("mx", "my", "mz"), p)))


@query(f"WITH {x.POINTS_SQL}, {x.SCANS_SQL}, {_POSED_SQL} SELECT {O}, round(mx, 4) AS x, round(my, 4) AS y, round(mz, 4) AS z FROM posed")
def e57_pose(spark, sf_dir):
    return posed_points(spark, sf_dir).select(*ROWS, *[F.round(f"m{a}", 4).alias(a) for a in "xyz"])


@query(
    "SELECT vec_id, round(10 * cos(embedding[2]::DOUBLE) * cos(embedding[1]::DOUBLE), 6) AS x, round(10 * cos(embedding[2]::DOUBLE) * sin(embedding[1]::DOUBLE), 6) AS y, round(10 * sin(embedding[2]::DOUBLE), 6) AS z FROM embeddings"
)
def e57_spherical(spark, sf_dir):
    e = x.table(spark, sf_dir, "embeddings")
    p = r.spherical(F.lit(10.0), F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"))
    return e.select("vec_id", *[F.round(c, 6).alias(a) for a, c in zip("xyz", p)])


@query("SELECT vec_id, " + ", ".join(f"CAST({x.round_sql(f'(least(greatest(embedding[{i + 1}]::DOUBLE, 0.0), 1.0) * 65535)')} AS INT) AS c{i}" for i in range(3)) + " FROM embeddings")
def channel_widen(spark, sf_dir):
    return x.table(spark, sf_dir, "embeddings").select("vec_id", *[r.widen_channel(F.col("embedding")[i].cast("double")).alias(f"c{i}") for i in range(3)])


@query("SELECT s_suppkey, least(s_suppkey + 1, 65535) AS source_id, s_suppkey % 3 <> 0 AS rotated FROM supplier")
def source_ids(spark, sf_dir):
    s = x.scans(spark, sf_dir)
    q = (F.col("qw"), F.lit(0.0), F.lit(0.0), F.col("qz"))
    return s.select(F.col("scan_id").alias("s_suppkey"), r.source_id(F.col("scan_id")).alias("source_id"), r.rotated(q).alias("rotated"))


@query(f"WITH {x.POINTS_SQL}, s AS (SELECT *, row_number() OVER (ORDER BY {O}) AS seen FROM li) SELECT {O}, seen FROM s WHERE seen % 7 = 0")
def decimate(spark, sf_dir):
    """Every seventh point in arrival order. Ranks come from counts of each order key, so no task orders all points."""
    from pyspark.sql import Window

    li = x.points(spark, sf_dir).select(*ROWS)
    blocks = li.withColumn("block", F.floor(F.col("o1") / 256))
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n"))
    before = sizes.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = blocks.withColumn("rn", F.row_number().over(Window.partitionBy("block").orderBy(*ROWS))).join(before, "block")
    return ranked.select(*ROWS, (F.col("rn") + F.col("before")).cast("long").alias("seen")).filter("seen % 7 = 0")


@query(f"WITH {x.POINTS_SQL} SELECT {O} FROM li WHERE wx BETWEEN 20000 AND 60000 AND wy BETWEEN 10000 AND 40000 AND wz BETWEEN 2000 AND 8000")
def box_filter(spark, sf_dir):
    """A closed box query; its bounds reach the scan as pushed filters."""
    li = x.table(spark, sf_dir, "lineitem").filter("l_extendedprice BETWEEN 20000 AND 60000")
    low, high = (20000, 10000, 2000), (60000, 40000, 8000)
    inside = g.box_contains(tuple(map(F.lit, low)), tuple(map(F.lit, high)), (F.col("wx"), F.col("wy"), F.col("wz")))
    return li.selectExpr(*x.POINTS).filter(inside).select(*ROWS)


@query(f"WITH {x.QUANTIZED_SQL} SELECT DISTINCT qx, qy, qz FROM q")
def distinct_positions(spark, sf_dir):
    return x.quantized(spark, sf_dir).select("qx", "qy", "qz").distinct()


@query(
    f"WITH {x.POINTS_SQL} SELECT 'intensity' AS name, min(intensity)::DOUBLE AS low, max(intensity)::DOUBLE AS high FROM li UNION ALL SELECT 'gps-time', min(gps_time), max(gps_time) FROM li "
    "UNION ALL SELECT 'position', min(wx), max(wx) FROM li UNION ALL SELECT 'classification', 0.0, 255.0 UNION ALL SELECT 'rgb', 0.0, 65535.0"
)
def attribute_domain(spark, sf_dir):
    """Measured for intensity, time and position; of the type for the others."""
    li = x.points(spark, sf_dir)
    m = li.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in ("intensity", "gps_time", "wx") for n, f in (("lo", F.min), ("hi", F.max))])
    return m.selectExpr(
        "stack(5, 'intensity', lo_intensity, hi_intensity, 'gps-time', lo_gps_time, hi_gps_time, 'position', lo_wx, hi_wx, 'classification', 0.0D, 255.0D, 'rgb', 0.0D, 65535.0D) AS (name, low, high)"
    )


@query(f"WITH {x.POINTS_SQL} SELECT CAST(least(greatest(floor((gps_time - 0) / 0.5), 0), 255) AS INT) AS bucket, count(*) AS n FROM li GROUP BY 1")
def histogram(spark, sf_dir):
    b = F.least(F.greatest(F.floor(F.col("gps_time") / 0.5), F.lit(0)), F.lit(255)).cast("int")
    return x.points(spark, sf_dir).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
