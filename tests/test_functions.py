"""Pinned values and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from pointmill.functions import geometry as g
from pointmill.functions import records as r
from pointmill.functions import text as t
from pointmill.operators import hierarchy as h
from pointmill.operators import lod


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def lits(*v):
    return tuple(F.lit(float(x)) for x in v)


def test_quantize(spark):
    q = lambda v, s=0.01: r.quantize(F.lit(v), F.lit(s), F.lit(0.0))
    assert one(spark, q(0.016), q(-0.016), q(0.5, 1.0), q(-2.5, 1.0), q(1e30, 1.0), q(-1e30, 1.0)) == (2, -2, 1, -3, 2**31 - 1, -(2**31))


def test_widening(spark):
    assert one(spark, r.widen_channel(F.lit(255 / 255)), r.widen_channel(F.lit(-1.0)), r.fill_colour(F.lit(None).cast("int")), r.source_id(F.lit(70000))) == (65535, 0, 65535, 65535)
    assert one(spark, r.prototype_bits(F.lit(0), F.lit(0)), r.prototype_bits(F.lit(0), F.lit(255)), r.prototype_bits(F.lit(0), F.lit(256))) == (0, 8, 9)
    assert one(spark, r.legacy_returns(F.lit(0b11010001)), r.legacy_classification(F.lit(0xE5)), r.legacy_flags(F.lit(0xE5), F.lit(0b11000000))) == (1 + 16 * 2, 5, 7 + 64 + 128)
    assert one(spark, r.scan_angle_steps(F.lit(90)), *r.scan_angle_rank(F.lit(30000))) == (15000, 127, True)


def test_spherical(spark):
    for args, want in (((10, 0, 0), (10, 0, 0)), ((10, math.pi / 2, 0), (0, 10, 0)), ((10, 0, math.pi / 2), (0, 0, 10))):
        assert one(spark, *r.spherical(*lits(*args))) == pytest.approx(want, abs=1e-9)


def test_pose(spark):
    s = math.sqrt(0.5)
    for p, want in (((1, 0, 0), (100, 1, 0)), ((0, 2, 0), (98, 0, 0))):
        assert one(spark, *r.posed(lits(*p), lits(s, 0, 0, s), lits(100, 0, 0))) == pytest.approx(want, abs=1e-9)


def test_names(spark):
    key = tuple(F.lit(v).cast("long") for v in (3, 1, 1))
    level = F.lit(3).cast("long")
    assert one(spark, g.hierarchy_name(level, (F.lit(3), F.lit(3), F.lit(1))), g.digit_name(level, (F.lit(1), F.lit(3), F.lit(3)))) == ("3-3-3-1", "r037")
    name = g.digit_name(level, key)
    assert tuple(one(spark, g.digit_name_key(name))[0]) == (3, 3, 1, 1)
    assert one(spark, g.parse_hierarchy_name(F.lit("3-3-1-1")), g.parse_hierarchy_name(F.lit("3-3-1"))) == ((3, 3, 1, 1), None)
    # the digits of r047 are x, y, z bits from the top
    assert tuple(one(spark, g.digit_name_key(F.lit("r047")))[0]) == (3, 3, 1, 1)


def test_morton(spark):
    values = spark.createDataFrame([(0, 0, 0), (1, 2, 3), (1023, 5, 700), (2**21 - 1, 0, 2**20)], "x long, y long, z long")
    code = g.morton(F.col("x"), F.col("y"), F.col("z"), 21)
    back = values.select("x", "y", "z", *[c.alias(f"b{a}") for a, c in zip("xyz", g.morton_axes(code))]).collect()
    assert all(tuple(v)[:3] == tuple(v)[3:] for v in back)
    assert one(spark, g.morton(F.lit(1), F.lit(0), F.lit(0), 10), g.morton(F.lit(0), F.lit(1), F.lit(0), 10), g.morton(F.lit(0), F.lit(0), F.lit(1), 10)) == (1, 2, 4)


def test_child_index_and_boxes(spark):
    c = lits(4, 4, 4)
    assert one(spark, g.child_index(c, lits(4, 0, 0)), g.child_index(c, lits(0, 4, 0)), g.child_index(c, lits(0, 0, 4)), g.child_index(c, lits(5, 5, 5))) == (4, 2, 1, 7)
    lo, hi = g.child_bounds(F.lit(0.0), F.lit(8.0), F.lit(True))
    assert one(spark, lo, hi) == (4.0, 8.0)
    assert one(spark, g.box_contains(lits(0, 0, 0), lits(1, 1, 1), lits(1, 0, 1)), g.box_empty(lits(0, 0, 0), lits(1, -1, 1))) == (True, True)


def test_grid_cell(spark):
    cell = lambda p, size=1.0: g.grid_cell(F.lit(p), F.lit(0.0), F.lit(size), 8)
    assert one(spark, cell(-3.0), cell(7.9), cell(100.0), cell(float("nan")), cell(5.0, 0.0)) == (0, 7, 7, 0, 0)


def test_ranges(spark):
    want = {"bytes=0-99": (0, 99), "bytes=500-": (500, 999), "bytes=-100": (900, 999), "bytes=900-2000": (900, 999), "bytes=1000-": None, "bytes=0-10,20-30": None, "chunks=0-10": None}
    for header, out in want.items():
        got = one(spark, t.byte_range(F.lit(header), F.lit(1000).cast("long")))[0]
        assert (tuple(got) if got else None) == out


def test_wkt():
    compound = 'COMPD_CS["x",PROJCS["NAD83 / UTM 12N",GEOGCS["NAD83",AUTHORITY["EPSG","4269"]],AUTHORITY["EPSG","26912"]],VERT_CS["h",AUTHORITY["EPSG","5703"]],AUTHORITY["EPSG","7"]]'
    assert (t.horizontal_epsg(compound), t.vertical_epsg(compound)) == (26912, 5703)
    assert t.horizontal_epsg('GEOGCS["a ] b [",AUTHORITY["EPSG","4326"]]') == 4326
    assert t.horizontal_epsg('PROJCS["p",GEOGCS["g",AUTHORITY["EPSG","4269"]]]') is None
    assert t.horizontal_epsg('PROJCRS["p",ID["EPSG",32612]]') == 32612
    assert t.horizontal_epsg('PROJCS["p",AUTHORITY["EPSG","0"]]') is None
    assert t.vertical_epsg("") is None


def test_wkt_columns(spark):
    rows = spark.createDataFrame([('PROJCS["p",AUTHORITY["EPSG","26912"]]',), ('VERT_CS["h",AUTHORITY["EPSG","5703"]]',), (None,)], "wkt string")
    assert [tuple(r) for r in rows.select(*t.epsg_columns(F.col("wkt"))).collect()] == [(26912, None), (None, 5703), (None, None)]


def test_strings(spark):
    assert one(spark, t.human_bytes(F.lit(1023)), t.human_bytes(F.lit(1536)), t.human_bytes(F.lit(200 * 1024))) == ("1023 B", "1.5 KiB", "200 KiB")
    assert one(spark, t.thousands(F.lit(1234567)), t.content_type(F.lit("a/b.JSON"))) == ("1,234,567", "application/json")
    assert one(spark, t.template_path(F.lit("{level}/{x}_{y}_{z}.glb"), F.lit(2), F.lit(1), F.lit(0), F.lit(3)), t.joined_path(F.lit("a/b/tileset.json"), F.lit("./c.glb"))) == ("2/1_0_3.glb", "a/b/c.glb")


def cloud(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(rows)], "o long, px double, py double, pz double")


def test_lod_conserves_and_thins(spark):
    rows = [(0.4 * i, 0.4 * j, 0.4 * k) for i in range(20) for j in range(20) for k in range(4)]
    built = lod.build(cloud(spark, rows), ["o"], span=8, leaf_points=1, box=([0.0] * 3, [8.0] * 3))
    assert built.select("o").distinct().count() == built.count() == len(rows)
    nodes = lod.node_table(built)
    assert nodes.count() > 1 and nodes.filter("level = 0").first()["point_count"] <= 8**3
    chunked = lod.build_chunked(cloud(spark, rows), ["o"], 1, span=8, leaf_points=1)
    assert chunked.select("o").distinct().count() == chunked.count() == len(rows)


def test_lod_first_of_a_cell(spark):
    rows = [(0.1 + 0.02 * i, 0.1, 0.1) for i in range(16)]
    built = lod.build(cloud(spark, rows), ["o"], span=128, leaf_points=1, max_depth=2, box=([0.0] * 3, [128.0] * 3))
    assert [r.o for r in built.filter("level = 0").collect()] == [0]


def test_lod_leaf_and_duplicates(spark):
    few = lod.build(cloud(spark, [(i, 0, 0) for i in range(400)]), ["o"], leaf_points=500)
    assert lod.node_table(few).count() == 1
    same = lod.build(cloud(spark, [(5, 5, 5)] * 100), ["o"], leaf_points=10, max_depth=4)
    assert same.count() == 100 and same.agg(F.max("level")).first()[0] == 4
    assert lod.build(cloud(spark, [(1, 1, 1)]).limit(0), ["o"]).count() == 0


def test_closure(spark):
    nodes = spark.createDataFrame([(0, 0, 0, 0, 5), (3, 5, 2, 7, 9)], "level long, x long, y long, z long, point_count long")
    assert {tuple(r) for r in h.closed(nodes).collect()} == {(0, 0, 0, 0, 5), (1, 1, 0, 1, 0), (2, 2, 1, 3, 0), (3, 5, 2, 7, 9)}
    assert h.differences(nodes, nodes).count() == 0
