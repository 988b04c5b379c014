"""Queries over declarations, report strings, manifests and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointmill.functions import records as r
from pointmill.functions import text as t
from pointmill.operators import diagnose
from pointmill.plans import fixtures as x
from pointmill.plans import nodes as n
from pointmill.plans.registry import query

CRS_TEXTS = (
    "", "EPSG:26912", "epsg:4326", "+proj=utm +zone=12", 'PROJCS["NAD83 / UTM 12N",AUTHORITY["EPSG","26912"]]', "somewhere", 'GEOGCS["WGS 84"]', "EPSG:", "  EPSG:7  ",
)
_TEXTS = "(SELECT unnest([" + ", ".join("'" + c.replace("'", "''") + "'" for c in CRS_TEXTS) + "]) AS raw)"
_KIND = r"CASE WHEN trim(raw) = '' THEN NULL WHEN trim(raw) LIKE '+%' THEN 'proj4' WHEN regexp_matches(trim(raw), '^(EPSG|epsg):[0-9]+$') THEN 'epsg' WHEN regexp_matches(trim(raw), '^[A-Z_]+\s*\[') THEN 'wkt' ELSE 'unknown' END"
_CODE = r"CASE WHEN regexp_matches(trim(raw), '^(EPSG|epsg):[0-9]+$') THEN CAST(substr(trim(raw), 6) AS BIGINT) END"


@query(
    f"WITH c AS (SELECT raw, {_KIND} AS kind, {_CODE} AS epsg, nullif(regexp_extract(trim(raw), '^[A-Z_]+\\s*\\[\\s*\"([^\"]*)\"', 1), '') AS name FROM {_TEXTS}) "
    "SELECT raw, kind, CASE WHEN kind IS NULL THEN NULL WHEN name IS NOT NULL THEN name WHEN epsg IS NOT NULL THEN 'EPSG:' || epsg ELSE kind || ' (unresolved)' END AS label FROM c"
)
def crs_label(spark, sf_dir):
    raw = F.col("raw")
    c = spark.createDataFrame([(v,) for v in CRS_TEXTS], "raw string").withColumn("kind", t.crs_format(raw))
    code = F.when(F.col("kind") == "epsg", F.substring(F.trim(raw), 6, 20).try_cast("long"))
    return c.select("raw", "kind", F.when(F.col("kind").isNotNull(), t.crs_label(F.col("kind"), t.crs_name(raw), code)).alias("label"))


_MIXED = "(SELECT status || flag AS input, CASE WHEN flag = 'N' THEN 'EPSG:4326' WHEN flag = 'A' THEN 'EPSG:26912' END AS crs FROM (SELECT DISTINCT l_linestatus AS status, l_returnflag AS flag FROM lineitem))"


@query(f"WITH i AS {_MIXED}, f AS (SELECT arg_min(crs, input) AS first_crs FROM i WHERE crs IS NOT NULL) SELECT input, crs, first_crs FROM i, f WHERE crs <> first_crs")
def mixed_crs(spark, sf_dir):
    """Inputs whose declared system differs from the first declared one; the first is one row, so it is broadcast."""
    i = x.points(spark, sf_dir).select(F.concat("status", "flag").alias("input"), F.when(F.col("flag") == "N", "EPSG:4326").when(F.col("flag") == "A", "EPSG:26912").alias("crs")).distinct()
    first = i.filter("crs IS NOT NULL").agg(F.min_by("crs", "input").alias("first_crs"))
    return i.crossJoin(F.broadcast(first)).filter("crs <> first_crs")


_BYTES = "CAST(o_orderkey * o_orderkey % 1099511627776 * (o_custkey % 9 + 1) AS BIGINT)"


@query(
    f"WITH b AS (SELECT o_orderkey, {_BYTES} AS n FROM orders), u AS (SELECT *, CASE WHEN n >= 1099511627776 THEN 4 WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS p FROM b), "
    "v AS (SELECT *, n / pow(1024.0, p) AS v FROM u) SELECT o_orderkey, n, CASE WHEN p = 0 THEN n || ' B' WHEN v >= 100 THEN printf('%.0f', v) || ['', ' KiB', ' MiB', ' GiB', ' TiB'][p + 1] ELSE printf('%.1f', v) || ['', ' KiB', ' MiB', ' GiB', ' TiB'][p + 1] END AS size, "
    "format('{:,}', n) AS thousands FROM v"
)
def human_bytes(spark, sf_dir):
    b = x.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_BYTES} AS n")
    return b.select("o_orderkey", "n", t.human_bytes(F.col("n")).alias("size"), t.thousands(F.col("n")).alias("thousands"))


RANGES = ("bytes=0-99", "bytes=500-", "bytes=-100", "bytes=900-2000", "bytes=1000-", "bytes=0-10,20-30", "chunks=0-10", "bytes=-", "bytes=7-3")


@query(
    "WITH h AS (SELECT unnest([" + ", ".join(f"'{v}'" for v in RANGES) + "]) AS header), p AS (SELECT header, regexp_extract(header, '^bytes=([0-9]*)-([0-9]*)$', 1) AS a, regexp_extract(header, '^bytes=([0-9]*)-([0-9]*)$', 2) AS b FROM h), "
    "q AS (SELECT header, a, b, CASE WHEN a = '' THEN greatest(1000 - TRY_CAST(b AS BIGINT), 0) ELSE TRY_CAST(a AS BIGINT) END AS f, CASE WHEN a = '' OR b = '' THEN 999 ELSE least(TRY_CAST(b AS BIGINT), 999) END AS l FROM p WHERE a <> '' OR b <> ''), "
    "ok AS (SELECT * FROM q WHERE f <= l AND f < 1000) SELECT h.header, CAST(ok.f AS BIGINT) AS first, CAST(ok.l AS BIGINT) AS last FROM h LEFT JOIN ok USING (header)"
)
def parse_range(spark, sf_dir):
    h = spark.createDataFrame([(v,) for v in RANGES], "header string")
    return h.withColumn("r", t.byte_range(F.col("header"), F.lit(1000).cast("long"))).select("header", "r.first", "r.last")


PAGE = '{"0-0-0-0": 120, "1-0-0-0": 40, "1-1-0-1": -1, "2-1-1-0": 7, "bad": 3, "1-0": 2}'


@query(
    f"WITH p AS (SELECT key AS name, CAST(value AS BIGINT) AS count FROM json_each('{PAGE}')) SELECT name, count, regexp_matches(name, '^[0-9]+-[0-9]+-[0-9]+-[0-9]+$') AS named, count = -1 AS paged, "
    "CASE WHEN regexp_matches(name, '^[0-9]+-[0-9]+-[0-9]+-[0-9]+$') THEN CAST(split_part(name, '-', 1) AS BIGINT) END AS level FROM p"
)
def ept_page_explode(spark, sf_dir):
    """One page of a JSON hierarchy as rows; -1 names another page, a bad key is told apart."""
    from pointmill.functions import geometry as g

    page = spark.createDataFrame([(PAGE,)], "page string").select(F.explode(F.from_json("page", "map<string,long>")).alias("name", "count"))
    key = g.parse_hierarchy_name(F.col("name"))
    return page.select("name", "count", key.isNotNull().alias("named"), (F.col("count") == -1).alias("paged"), key["level"].alias("level"))


_SHAPE = f"""{n._P}, c AS (SELECT level % 3 AS cloud, count(*) AS nodes, CAST(sum(point_count) AS BIGINT) AS points, count(DISTINCT x // 2) AS reads FROM nodes GROUP BY 1),
s AS (SELECT cloud, nodes, points, points + cloud AS declared, reads, points * 36.0 / nodes AS average FROM c)
SELECT cloud, unnest([
  CASE WHEN declared <> points THEN 'warn:point-count' ELSE 'pass:point-count' END,
  CASE WHEN average < 32768 THEN 'warn:small-nodes' WHEN average > 8388608 THEN 'warn:large-nodes' ELSE 'pass:node-size' END,
  CASE WHEN reads > 8 THEN 'warn:hierarchy-requests' ELSE 'pass:hierarchy' END, 'warn:no-crs']) AS finding FROM s"""


@query(_SHAPE)
def doctor_shape(spark, sf_dir):
    """The rules about a cloud's shape, over three clouds made of the pyramid's levels."""
    p = x.pyramid(spark, sf_dir)
    clouds = p.groupBy((F.col("level") % 3).alias("cloud")).agg(F.count("*").alias("nodes"), F.sum("point_count").alias("points"), F.countDistinct(F.floor(F.col("x") / 2)).alias("index_reads"))
    clouds = clouds.withColumns({"declared": F.col("points") + F.col("cloud"), "data_bytes": F.col("points") * 36, "crs": F.lit(None).cast("string"), "format": F.lit("copc")})
    found = diagnose.shape_findings(clouds, ["cloud"])
    return found.select("cloud", F.concat_ws(":", "level", "code").alias("finding"))


PROBES = (
    (1, 206, 16, None, "*", "content-range, content-length, accept-ranges", 204, "max-age=60"),
    (2, 206, 9, None, "*", "content-range", 204, None),
    (3, 200, 5000, None, None, None, 405, "no-store"),
    (4, 404, 0, None, "*", None, 204, "max-age=60"),
    (5, 206, 16, "gzip", "*", "content-range, content-length, accept-ranges", 200, "no-cache"),
    (6, 500, 0, None, None, None, None, None),
)
_PROBES = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in p) + ")" for p in PROBES) + ") AS t(id, status, body_length, encoding, allow_origin, expose, preflight, cache)"


@query(
    f"WITH p AS (SELECT * FROM {_PROBES}), f AS (SELECT id, unnest(["
    "CASE WHEN status = 206 THEN 'pass:range' WHEN status = 200 THEN 'fail:no-range' WHEN status IN (403, 404) THEN 'fail:payload-missing' ELSE 'fail:payload-status' END, "
    "CASE WHEN status = 206 AND body_length <> 16 THEN 'warn:range-length' END, CASE WHEN encoding IS NOT NULL AND encoding <> 'identity' THEN 'fail:range-encoded' END, "
    "CASE WHEN allow_origin IN ('*', 'https://example.com') THEN 'pass:cors' ELSE 'fail:cors' END, "
    "CASE WHEN allow_origin IN ('*', 'https://example.com') AND NOT (coalesce(expose, '') LIKE '%content-range%' AND coalesce(expose, '') LIKE '%content-length%' AND coalesce(expose, '') LIKE '%accept-ranges%') THEN 'warn:cors-expose' END, "
    "CASE WHEN preflight IS NULL OR preflight NOT BETWEEN 200 AND 299 THEN 'warn:preflight' END, "
    "CASE WHEN cache IS NULL OR cache LIKE '%no-store%' OR cache LIKE '%no-cache%' THEN 'warn:cache' END, 'pass:latency']) AS finding FROM p) "
    "SELECT id, finding, max(CASE WHEN finding LIKE 'fail%' THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS exit_code FROM f WHERE finding IS NOT NULL"
)
def doctor_transport(spark, sf_dir):
    """The rules about a server's answers, and the exit code of the worst."""
    probes = spark.createDataFrame(PROBES, "id int, status int, body_length int, encoding string, allow_origin string, expose string, preflight int, cache string")
    found = diagnose.transport_findings(probes, ["id"], origin="https://example.com")
    worst = diagnose.exit_codes(found, ["id"])
    return found.join(worst, "id").select("id", F.concat_ws(":", "level", "code").alias("finding"), "exit_code")


@query("SELECT o_orderkey, CAST(dayofyear(o_orderdate) AS INT) AS day, CAST(year(o_orderdate) AS INT) AS year FROM orders")
def creation_date(spark, sf_dir):
    return x.table(spark, sf_dir, "orders").select("o_orderkey", F.dayofyear("o_orderdate").alias("day"), F.year("o_orderdate").alias("year"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 300 > 0 THEN length(bin(p_partkey % 300)) ELSE 0 END AS bits FROM part")
def prototype_bits(spark, sf_dir):
    return x.table(spark, sf_dir, "part").select("p_partkey", r.prototype_bits(F.lit(0).cast("long"), F.col("p_partkey") % 300).cast("long").alias("bits"))
