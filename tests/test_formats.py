"""Formats: what is written reads back as it was."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointmill.operators import lod
from pointmill.sources import files, las, potree

SCALE, OFFSET = [0.01, 0.01, 0.001], [100.0, 200.0, 0.0]


def rows(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    i = np.arange(n)
    none = [None] * n
    return {
        "ord": i, "x": rng.integers(0, 2**20, n), "y": rng.integers(0, 2**18, n), "z": rng.integers(0, 2**12, n), "intensity": rng.integers(0, 65536, n), "return_number": i % 5 + 1,
        "number_of_returns": i % 5 + 2, "classification_flags": i % 16, "scanner_channel": i % 4, "scan_direction": i % 2, "edge": i % 3 % 2, "classification": i % 20, "user_data": i % 256,
        "scan_angle": i % 30000 - 15000, "point_source_id": i % 65536, "gps_time": rng.random(n), "red": rng.integers(0, 65536, n), "green": rng.integers(0, 65536, n), "blue": rng.integers(0, 65536, n),
        "nir": none, "extra": none,
    }


@pytest.fixture(scope="module")
def points(spark):
    table = rows()
    data = list(zip(*[[v.item() if hasattr(v, "item") else v for v in c] for c in table.values()]))
    return spark.createDataFrame(data, las.POINT_SCHEMA).repartition(3)


def same(a, b):
    return a.exceptAll(b).count() == 0 == b.exceptAll(a).count()


def test_las_round_trip(spark, points, tmp_path):
    written = las.write_tiles(points, f"{tmp_path}/tiles", 7, SCALE, OFFSET, wkt='PROJCS["p",AUTHORITY["EPSG","26912"]]').collect()
    assert sum(r.points for r in written) == points.count()
    paths = [r.file for r in written]
    back = las.read_points(spark, paths, rows_per_partition=500)
    assert same(back.drop("ord", "nir", "extra"), points.drop("ord", "nir", "extra"))
    info = las.cloud_info(spark, paths).collect()
    assert sum(r.point_count for r in info) == points.count() and all(r.crs.startswith("PROJCS") and r.format == "las" and r.point_format == 7 for r in info)
    h = las.open_header(paths[0])
    tile = las.world(las.read_points(spark, paths[:1]), SCALE, OFFSET).agg(F.min("px"), F.max("pz")).first()
    assert (h.low[0], h.high[2]) == pytest.approx(tuple(tile))


@pytest.mark.parametrize("kind", range(11))
def test_every_format(kind):
    """All formats read, legacy fields widened, and trailing bytes kept as extra."""
    dtype = las.record_type(kind, las.RECORD_BYTES[kind] + 3)
    r = np.zeros(2, dtype)
    r["xyz"], r["intensity"], r["source"] = [[1, -2, 3], [4, 5, -6]], 7, 9
    r["returns"] = 0b11010001
    r["class"] = 0xE5
    r["angle"] = 90 if kind < 6 else 15000
    if "rgb" in dtype.names:
        r["rgb"] = [1, 2, 3]
    out = las.decode(r.tobytes(), kind, dtype.itemsize, 10).to_pylist()[1]
    assert (out["ord"], out["x"], out["z"], out["point_source_id"], out["scan_angle"]) == (11, 4, -6, 9, 15000)
    assert (out["return_number"], out["classification"]) == ((1, 5) if kind < 6 else (1, 0xE5))
    assert (out["classification_flags"], out["scan_direction"], out["edge"]) == ((7, 1, 1) if kind < 6 else (0, 0, 0))
    assert (out["red"] == 1) == (kind in las.COLOUR_FORMATS) and (out["gps_time"] is None) == (kind in las.TIMELESS_FORMATS)
    assert out["extra"] == b"\0\0\0" and (out["nir"] is None) == (kind not in las.NIR_FORMATS)


def test_truncated_and_refused(spark, points, tmp_path):
    path = las.write_tiles(points.coalesce(1), f"{tmp_path}/t", 7, SCALE, OFFSET).first().file
    raw = files.read_all(path)
    files.write_all(f"{tmp_path}/cut.las", raw[:-50])
    assert las.read_points(spark, [f"{tmp_path}/cut.las"]).count() == points.count() - 2
    packed = bytearray(raw)
    packed[104] |= 0x80
    files.write_all(f"{tmp_path}/packed.las", bytes(packed))
    with pytest.raises(Exception, match="compressed"):
        las.read_points(spark, [f"{tmp_path}/packed.las"]).count()
    with pytest.raises(ValueError):
        las.parse_header(b"nope" + bytes(400))
    with pytest.raises(ValueError):
        files.join("/a", "../b")


def test_headers():
    vlrs = [las.Vlr("LASF_Projection", 34735, "keys", np.array([1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 26912], "<u2").tobytes())]
    head = las.write_header(5, 6, 30, SCALE, OFFSET, [0, 1, 2], [3, 4, 5], [5], vlrs)
    h = las.parse_header(head)
    assert (h.points, h.low, h.high, h.version, h.data_offset) == (5, [0, 1, 2], [3, 4, 5], (1, 4), len(head))
    h.vlrs, whole = las.walk_records(head, h.header_bytes, h.n_vlrs, False)
    assert whole and las.projection(h) == "EPSG:26912"
    keys = lambda *k: [las.Vlr("LASF_Projection", 34735, "keys", np.array([1, 1, 0, len(k), *(v for a, b in k for v in (a, 0, 1, b))], "<u2").tobytes())]
    for found, want in (((1024, 2), (3072, 26912), (2048, 4326)), "EPSG:4326"), (((1024, 1), (2048, 4326)), None), (((2048, 4326),), "EPSG:4326"), (((1024, 1), (3072, 32767)), None):
        h.vlrs = keys(*found)
        assert las.projection(h) == want
    h.vlrs = vlrs[:]
    assert head[107:111] == b"\0\0\0\0"
    extra = bytearray(192)
    extra[2], extra[4:9] = 4, b"depth"
    h.vlrs.append(las.Vlr("LASF_Spec", 4, "", bytes(extra) + bytes(192)))
    h.record_bytes = 34
    found = las.extra_dimensions(h)
    assert [(e.name, e.kind, e.offset, e.size) for e in found][:1] == [("depth", "<i2", 30, 2)]


def test_morton_blocks():
    rng = np.random.default_rng(0)
    p = np.concatenate((rng.integers(0, 2**31, (50, 3)), [[0, 2**31 - 1, 2**27]])).astype(np.int32)
    assert (potree.morton_values(potree.morton_block(p), len(p), "int32") == p).all()
    c = np.concatenate((rng.integers(0, 2**16, (50, 3)), [[0, 65535, 256]])).astype("<u2")
    assert (potree.morton_values(potree.morton_block(c), len(c), "uint16") == c).all()
    # only x set: bit 3 i of the low code, which lies in the third word
    assert np.frombuffer(potree.morton_block(np.array([[3, 0, 0]], np.int32)), "<u4").tolist() == [0, 0, 0b1001, 0]


def test_hierarchy_round_trip():
    rng = np.random.default_rng(2)
    nodes = {(0, 0, 0, 0): (9, 0, 10)}
    for _ in range(300):
        level = int(rng.integers(1, 13))
        nodes[(level, *(int(rng.integers(0, 2**level)) for _ in range(3)))] = (int(rng.integers(1, 99)), int(rng.integers(0, 10**6)), 7)
    raw, first = potree.hierarchy_bytes(nodes)
    back, warned = potree.read_hierarchy(raw, first)
    assert not warned and set(back) == potree.with_ancestors(nodes)
    assert all(back[k] == v for k, v in nodes.items())


@pytest.fixture(scope="module")
def built(points):
    p = las.world(points, SCALE, OFFSET)
    return lod.build(p, ["ord"], span=8, leaf_points=200, max_depth=12)


@pytest.mark.parametrize("encoding", ["DEFAULT", "BROTLI"])
def test_potree(spark, built, tmp_path, encoding):
    box = lod.extent(built)
    edge = max(h - a for a, h in zip(*box))
    manifest = potree.write(built, f"{tmp_path}/cloud", SCALE, OFFSET, (box[0], edge), box, 8, encoding)
    assert manifest["points"] == built.count()
    nodes = potree.nodes_of(spark, f"{tmp_path}/cloud")
    assert same(nodes.filter("point_count > 0").select("level", "x", "y", "z", "point_count"), lod.node_table(built))
    back = potree.read_points(spark, f"{tmp_path}/cloud")
    cols = ["level", "kx", "ky", "kz", "x", "y", "z", "intensity", "classification", "scan_angle", "gps_time", "red", "blue"]
    assert same(back.select(*cols), built.select(*cols))
    assert potree.read_points(spark, f"{tmp_path}/cloud", level=0).count() == built.filter("level = 0").count()
    other = "DEFAULT" if encoding == "BROTLI" else "BROTLI"
    report = potree.optimize(spark, f"{tmp_path}/cloud", f"{tmp_path}/other", other, drop=("gps-time", "position", "nothing")).first()
    assert report.points == built.count() and report.warnings == ["position-kept:position", "no-such-attribute:nothing"]
    again = potree.read_points(spark, f"{tmp_path}/other")
    assert "gps_time" not in again.columns
    cols.remove("gps_time")
    assert same(again.select(*cols), built.select(*cols))


def test_brotli_halves():
    n = 5000
    line = np.arange(n, dtype=np.int32)
    columns = {"position": np.stack([line * 3, line * 2, line % 100], axis=1).astype(np.int32), "intensity": (line % 50).astype("<u2")}
    fields = [("position", "int32", 3), ("intensity", "uint16", 1)]
    assert len(potree.encode_node(columns, fields, "BROTLI", n)) * 2 < len(potree.encode_node(columns, fields, "DEFAULT", n))
    assert pa.Codec.is_available("brotli")


@pytest.mark.parametrize("encoding", ["binary", "zstandard"])
def test_ept(spark, built, tmp_path, monkeypatch, encoding):
    from pointmill.sources import ept

    box = lod.extent(built)
    edge = max(h - a for a, h in zip(*box))
    folder = f"{tmp_path}/ept"
    monkeypatch.setattr(ept.hierarchy_pages, "__defaults__", (7,))
    manifest = ept.write(built, folder, SCALE, OFFSET, (box[0], edge), box, 8, "WKT[]", encoding)
    assert manifest["points"] == built.count() and ept.crs_of(manifest) == "WKT[]"
    assert len(files.list_files(f"{folder}/ept-hierarchy")) > 1
    assert same(ept.nodes_of(spark, folder).filter("point_count > 0"), lod.node_table(built))
    cols = ["level", "kx", "ky", "kz", "x", "y", "z", "intensity", "classification", "scan_angle", "gps_time", "green"]
    assert same(ept.read_points(spark, folder).select(*cols), built.select(*cols))


def test_tiles(spark, built, tmp_path):
    from pointmill.sources import tiles

    box = lod.extent(built)
    edge = max(h - a for a, h in zip(*box))
    folder = f"{tmp_path}/tiles"
    tiles.write(built, folder, (box[0], edge), 8)
    rows = tiles.tiles_of(spark, folder).collect()
    nodes = {(r.level, r.x, r.y, r.z): r.point_count for r in lod.node_table(built).collect()}
    assert {r.uri for r in rows if r.uri} == {f"tiles/{'-'.join(map(str, k))}.glb" for k in nodes}
    for r in [r for r in rows if r.uri][:5]:
        key = tuple(map(int, r.uri[6:-4].split("-")))
        assert (r.x, r.y, r.z) == pytest.approx(tiles.center_of(key, box[0], edge))
        p, rgb = tiles.node_points(files.read_all(f"{folder}/{r.uri}"))
        want = built.filter(f"level = {key[0]} AND kx = {key[1]} AND ky = {key[2]} AND kz = {key[3]}").orderBy("ord").select("px", "py", "pz", "red").collect()
        assert len(p) == nodes[key]
        assert np.allclose(p + [r.x, r.y, r.z], [[w.px, w.py, w.pz] for w in want], atol=1e-2)
        assert rgb[:, 0].tolist() == [w.red >> 8 for w in want]


def test_implicit_quadtree(tmp_path):
    from pointmill.sources import tiles
    import json
    import struct

    def subtree(doc, data=b""):
        text = json.dumps(doc).encode()
        return struct.pack("<4sIQQ", b"subt", 1, len(text), len(data)) + text + data

    folder = str(tmp_path)
    root = {"geometricError": 8, "content": {"uri": "c/{level}/{x}/{y}.glb"}, "implicitTiling": {"subdivisionScheme": "QUADTREE", "subtreeLevels": 2, "availableLevels": 4, "subtrees": {"uri": "s/{level}.{x}.{y}.subtree"}}}
    files.write_all(f"{folder}/tileset.json", json.dumps({"asset": {"version": "1.1"}, "geometricError": 9, "root": root}).encode())
    bits = np.packbits([1, 1, 0, 1, 0], bitorder="little").tobytes()
    children = np.packbits([0] * 6 + [1, 1] + [0] * 8, bitorder="little").tobytes()
    doc = {"buffers": [{"byteLength": 3}], "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": 1}, {"buffer": 0, "byteOffset": 1, "byteLength": 2}], "tileAvailability": {"bitstream": 0}, "childSubtreeAvailability": {"bitstream": 1}}
    files.write_all(f"{folder}/s/0.0.0.subtree", subtree(doc, bits + children))
    files.write_all(f"{folder}/s/2.2.1.subtree", subtree({"tileAvailability": {"constant": 1}, "childSubtreeAvailability": {"constant": 0}}))
    found, warned = tiles.implicit_tiles(folder, "", root["implicitTiling"])
    # code 6 is x = 2, y = 1; code 7 is x = 3, y = 1, whose subtree is missing
    assert [k for k in found if k[0] < 2] == [(0, 0, 0), (1, 0, 0), (1, 0, 1)]
    assert {k for k in found if k[0] == 2} == {(2, 2, 1)} and len([k for k in found if k[0] == 3]) == 4
    assert warned == [("subtree-missing", "s/2.3.1.subtree")]
    rows, _ = tiles.walk(folder)
    assert "c/3/5/3.glb" in {r[1] for r in rows}


def test_copc_pages(tmp_path):
    from pointmill.sources import copc

    rng = np.random.default_rng(7)
    nodes = {(0, 0, 0, 0): (5, 100, 9)}
    for _ in range(900):
        level = int(rng.integers(1, 11))
        nodes[(level, *(int(rng.integers(0, 2 ** max(0, level - 4))) for _ in range(3)))] = (int(rng.integers(1, 9)), int(rng.integers(0, 9999)), 3)
    raw, at, size = copc.hierarchy_bytes(nodes, 64)
    files.write_all(f"{tmp_path}/h", bytes(64) + raw)
    back, warned = copc.read_hierarchy(f"{tmp_path}/h", at, size)
    assert not warned and {k: v for k, v in back.items() if v[0]} == nodes and set(back) == potree.with_ancestors(nodes)
    assert len(copc.pages_of(nodes)) > 1
    info = copc.Info((1.0, 2.0, 3.0), 4.0, 0.5, 64, size, (0.0, 1.0))
    assert copc.parse_info(copc.info_bytes(info)) == info and len(copc.info_bytes(info)) == 160
    with pytest.raises(ValueError):
        copc.parse_info(copc.info_bytes(copc.Info((1.0, 2.0, 3.0), 0.0, 0.5, 64, size, (0.0, 1.0))))


def _grid():
    from pointmill.sources.e57 import Field

    fields = [*(Field(f"cartesian{a}", "ScaledInteger", 0, 2**31, 0.001, o) for a, o in zip("XYZ", (500000.0, 4300000.0, 100.0))), *(Field(f"color{c}", "Integer", 0, 255) for c in ("Red", "Green", "Blue"))]
    i, j = np.divmod(np.arange(100), 10)
    return fields, {"cartesianX": i * 1000, "cartesianY": j * 1000, "cartesianZ": i * j * 100, "colorRed": i, "colorGreen": j, "colorBlue": i * j}


NO_POSE = (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_e57(spark, tmp_path):
    from pointmill.sources import e57

    half = np.sqrt(0.5)
    turned = [e57.Field(f"cartesian{a}", "Float") for a in "XYZ"] + [e57.Field("cartesianInvalidState", "Integer", 0, 2), e57.Field("intensity", "Float", double=False)]
    spherical = [e57.Field(n, "Float") for n in ("sphericalRange", "sphericalAzimuth", "sphericalElevation")]
    scans = [
        (*_grid(), NO_POSE),
        (turned, {"cartesianX": [1.0, 0.0, 7.0], "cartesianY": [0.0, 2.0, 7.0], "cartesianZ": [0.0] * 3, "cartesianInvalidState": [0, 0, 2], "intensity": [0.0, 1.0, 0.5]}, (half, 0.0, 0.0, half, 100.0, 0.0, 0.0)),
        (spherical, {"sphericalRange": [10.0] * 3, "sphericalAzimuth": [0.0, np.pi / 2, 0.0], "sphericalElevation": [0.0, 0.0, np.pi / 2]}, NO_POSE),
    ]
    e57.write(path := f"{tmp_path}/a.e57", scans, per_packet=37)
    got = e57.read_points(spark, path).orderBy("scan", "packet", "row").collect()
    first = [r for r in got if r.scan == 0]
    assert len(first) == 100 and all((r.px, r.py) == pytest.approx((500000 + k // 10, 4300000 + k % 10)) and (r.red, r.green) == (k // 10 * 257, k % 10 * 257) for k, r in enumerate(first))
    second = [r for r in got if r.scan == 1]
    assert [(r.px, r.py) for r in second] == [pytest.approx((100, 1)), pytest.approx((98, 0))] and [r.intensity for r in second] == [0, 65535] and {r.red for r in second} == {65535}
    assert [pytest.approx((r.px, r.py, r.pz), abs=1e-9) for r in got if r.scan == 2] == [(10, 0, 0), (0, 10, 0), (0, 0, 10)]
    assert {r.point_source_id for r in got} == {1, 2, 3} and e57.dropped(spark, path) == 1
    assert {"e57-multi-scan", "e57-spherical", "e57-bounds-undeclared"} <= {c for c, _ in e57.warnings_of(path)}
    assert e57.crc32c(b"123456789") == 0xE3069283


def test_commands(spark, points, tmp_path):
    from pointmill.plans import commands
    from pointmill.sources import e57

    tile = las.write_tiles(points.coalesce(1), f"{tmp_path}/in", 7, SCALE, OFFSET, wkt="PROJCS[]").first().file
    e57.write(scan := f"{tmp_path}/in/scan.e57", [(*_grid(), NO_POSE)])
    report = commands.convert(spark, [tile, scan], f"{tmp_path}/p", "potree-brotli", span=16, leaf=500)
    assert report["points"] == points.count() + 100 and report["scale"] == SCALE and ("mixed-crs", scan) in report["warnings"]
    with pytest.raises(FileExistsError):
        commands.convert(spark, [tile], f"{tmp_path}/p", "potree")
    info, levels = commands.inspect(spark, f"{tmp_path}/p", deep=True)
    assert info.first().point_count == report["points"] == levels.agg(F.sum("points")).first()[0]
    found, code = commands.doctor(spark, f"{tmp_path}/p/metadata.json")
    assert code == 0 and {"point-count", "small-nodes"} <= {r.code for r in found.collect()}
    assert commands.doctor(spark, tile)[1] == 1
    for fmt in ("ept", "3dtiles"):
        assert commands.convert(spark, [tile], f"{tmp_path}/{fmt}", fmt, span=16, leaf=500)["points"] == points.count()
    # points of merged inputs come back where they were
    whole = potree.read_points(spark, f"{tmp_path}/p").agg(F.count("*"), F.max("point_source_id")).first()
    assert whole[0] == report["points"]
    n = commands.save_snapshot(spark, tile, f"{tmp_path}/a.png", size=64)
    raw = files.read_all(f"{tmp_path}/a.png")
    assert n > 50 and raw[:8] == b"\x89PNG\r\n\x1a\n"
    assert commands.snapshot(spark, scan, size=32).count() > 10
    with pytest.raises(ValueError):
        commands.sniff(f"{tmp_path}/in")


def test_volumes():
    from pointmill.sources import tiles

    turned = np.array([[0, -2.0, 0, 5], [2, 0, 0, 6], [0, 0, 2, 7], [0, 0, 0, 1]])
    low, high = tiles.volume_box({"box": [1, 0, 0, 3, 0, 0, 0, 1, 0, 0, 0, 0.5]}, turned)
    assert (low.tolist(), high.tolist()) == ([3, 2, 6], [7, 14, 8])
    low, high = tiles.volume_box({"sphere": [0, 0, 0, 1.5]}, turned)
    assert (low.tolist(), high.tolist()) == ([2, 3, 4], [8, 9, 10])
    region = [3.0, -0.2, -3.0, 0.3, -50.0, 500.0]
    low, high = tiles.volume_box({"region": region}, turned)
    lon, lat, h = (x.ravel() for x in np.meshgrid(np.linspace(3.0, 2 * np.pi - 3.0, 201), np.linspace(-0.2, 0.3, 201), [-50.0, 500.0]))
    e2 = 1 - (6356752.314245179 / 6378137.0) ** 2
    n = 6378137.0 / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    p = np.stack([(n + h) * np.cos(lat) * np.cos(lon), (n + h) * np.cos(lat) * np.sin(lon), (n * (1 - e2) + h) * np.sin(lat)], axis=1)
    assert (p >= low - 1e-6).all() and (p <= high + 1e-6).all() and np.abs(p.min(axis=0) - low).max() < 200 and np.abs(p.max(axis=0) - high).max() < 200
    assert tiles.volume_box({}, turned) is None
    assert [tiles.content_kind(u) for u in ("a.PNTS", "b.glb?x=1", "c/d.json#f", "e.b3dm", "f")] == ["pnts", "gltf", "tileset", "mesh", "unknown"]


def test_e57_extent(spark, tmp_path):
    from pointmill.sources import e57

    half = np.sqrt(0.5)
    scan = e57.Scan(0, 1, [], (half, 0.0, 0.0, half, 100.0, 0.0, 5.0), {}, ([0.0, 0.0, 0.0], [4.0, 2.0, 1.0]))
    low, high = e57.declared_extent([scan, e57.Scan(0, 1, [])])
    assert low == pytest.approx([98, 0, 5]) and high == pytest.approx([100, 4, 6]) and e57.declared_extent([e57.Scan(0, 1, [])]) is None
    e57.write(path := f"{tmp_path}/a.e57", [(*_grid(), NO_POSE)])
    low, high, n = e57.measure(spark, path)
    assert n == 100 and low == pytest.approx([500000, 4300000, 100]) and high == pytest.approx([500009, 4300009, 108.1])
    assert ("e57-extent-unknown", path) in e57.warnings_of(path)


def test_doctor_of_a_url(spark, built, tmp_path):
    """A served cloud is inspected by ranges, its real bytes count, and a server that is not there is unreachable."""
    import threading

    from pointmill.plans import commands
    from pointmill.sources import ept, serve

    box = lod.extent(built)
    cube = (box[0], max(h - a for a, h in zip(*box)))
    potree.write(built, f"{tmp_path}/p", SCALE, OFFSET, cube, box, 8, "BROTLI")
    manifest = ept.write(built, f"{tmp_path}/e", SCALE, OFFSET, cube, box, 8, "EPSG:26912")
    assert manifest["srs"] == {"authority": "EPSG", "horizontal": "26912"} and ept.crs_of(manifest) == "EPSG:26912"
    s = serve.server(str(tmp_path), port=0, cache=60)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_address[1]}"
    try:
        info, levels = commands.inspect(spark, f"{base}/p", deep=True)
        assert info.first().point_count == built.count() == levels.agg(F.sum("points")).first()[0]
        for name in ("p", "e"):
            found, code = commands.doctor(spark, f"{base}/{name}")
            codes = {(r.level, r.code) for r in found.collect()}
            assert code == 0 and {("pass", "range"), ("pass", "cors"), ("pass", "point-count")} <= codes
            assert (("warn", "small-nodes") in codes) == (name == "p")
    finally:
        s.shutdown()
        s.server_close()
    found, code = commands.doctor(spark, f"{base}/p")
    assert code == 1 and [r.code for r in found.collect()] == ["unreachable"]


def test_chunks_and_inputs(spark, tmp_path):
    """A small budget builds by chunks; inputs lie one after the other, however many there are."""
    from pointmill.plans import commands

    assert commands.input_starts({0: 4, 2: 9}, 4) == [0, 5, 5, 15]
    assert commands.input_starts(dict.fromkeys(range(300), 2**40), 300)[299] == 299 * (2**40 + 1) < 2**63
    data = [(i, i * 7 % 50, i % 9, i, 5, 1, 1, 0, 0, 0, 0, 2, 0, 0, 1, 0.0, 1, 2, 3, None, None) for i in range(200)]
    tile = las.write_tiles(spark.createDataFrame(data, las.POINT_SCHEMA).coalesce(1), f"{tmp_path}/in", 7, SCALE, OFFSET).first().file
    report = commands.convert(spark, [tile, tile], f"{tmp_path}/out", "potree", span=4, leaf=100, memory=10_000)
    assert report["points"] == 400 == potree.read_points(spark, f"{tmp_path}/out").count()
