"""The front ends: inspect, doctor, convert, optimize and snapshot over files."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.functions import geometry as g
from pointmill.functions import records as r
from pointmill.operators import diagnose, hierarchy, lod
from pointmill.sources import copc, e57, ept, files, http, las, potree, tiles

MANIFESTS = {"metadata.json": "potree", "ept.json": "ept", "tileset.json": "3dtiles"}
FORMATS = {"potree": ("potree", "DEFAULT"), "potree-v2": ("potree", "DEFAULT"), "potree-brotli": ("potree", "BROTLI"), "ept": ("ept", "binary"), "ept-binary": ("ept", "binary"), "ept-zstandard": ("ept", "zstandard"), "3dtiles": ("3dtiles", ""), "3d-tiles": ("3dtiles", ""), "tileset": ("3dtiles", "")}


#: Bytes of records beyond which a conversion builds in chunks, and bytes of a record.
MEMORY, RECORD_BYTES = 1 << 30, 36


def sniff(path: str) -> tuple[str, str]:
    """(format, place) by a named manifest, then the extension, then the manifests that a folder may have."""
    name = path.rsplit("/", 1)[-1]
    if name in MANIFESTS:
        return MANIFESTS[name], path.rsplit("/", 1)[0]
    ext = name.rsplit(".", 1)[-1].lower()
    if ext == "e57":
        return "e57", path
    if ext in ("las", "laz"):
        h = las.open_header(path)
        return ("copc" if any(v.user == "copc" and v.record == 1 for v in h.vlrs) else "laz" if h.compressed else "las"), path
    for manifest, kind in MANIFESTS.items():
        if files.exists(files.join(path, manifest)):
            return kind, path
    raise ValueError(f"{path}: no format is known for it")


def nodes_of(spark: SparkSession, path: str) -> DataFrame | None:
    kind, at = sniff(path)
    reader = {"potree": potree.nodes_of, "ept": ept.nodes_of, "copc": copc.nodes_of}.get(kind)
    return reader(spark, at) if reader else None


def inspect(spark: SparkSession, path: str, deep: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """One row of facts from headers or manifests alone, and with ``deep`` the nodes and points by level."""
    kind, at = sniff(path)
    if kind in ("las", "laz", "copc"):
        info = las.cloud_info(spark, [at]).select("format", "version", F.col("point_count"), "low", "high", "scale", "offset", "crs")
    else:
        if kind == "potree":
            m, _ = potree.manifest_of(at)
            box = m.get("tightBoundingBox", m["boundingBox"])
            row = (kind, m["version"], m.get("points"), box["min"], box["max"], m["scale"], m["offset"], m.get("projection") or None)
        elif kind == "ept":
            m = ept.manifest_of(at)
            b = m.get("boundsConforming", m["bounds"])
            s = {d["name"]: d for d in m["schema"]}
            row = (kind, m.get("version"), m.get("points"), list(map(float, b[:3])), list(map(float, b[3:])), [s[a].get("scale", 1.0) for a in "XYZ"], [float(s[a].get("offset", 0.0)) for a in "XYZ"], ept.crs_of(m))
        elif kind == "3dtiles":
            m = json.loads(files.read_all(files.join(at, "tileset.json")))
            row = (kind, m["asset"]["version"], None, None, None, None, None, None)
        else:
            scans, crs = e57.open_scans(at)
            low, high = e57.declared_extent(scans) or (None, None)
            row = (kind, "1.0", sum(s.records for s in scans), low, high, [1.0] * 3, [0.0] * 3, crs or None)
        info = spark.createDataFrame([row], "format string, version string, point_count long, low array<double>, high array<double>, scale array<double>, offset array<double>, crs string")
    nodes = nodes_of(spark, path) if deep else None
    return info, hierarchy.by_level(nodes) if nodes is not None else None


def warnings_of(path: str) -> tuple[list[tuple[str, str]], int]:
    """(code, path) of what the readers of a cloud warn of, and the number of reads of its index."""
    kind, at = sniff(path)
    if kind == "potree":
        m, warned = potree.manifest_of(at)
        _, more = potree.read_hierarchy(files.read_all(files.join(at, "hierarchy.bin")), m["hierarchy"]["firstChunkSize"])
        return warned + more, 1
    if kind in ("ept", "copc"):
        return (ept if kind == "ept" else copc).warnings_of(at)
    if kind == "3dtiles":
        return tiles.walk(at)[1], 1
    if kind == "e57":
        return e57.warnings_of(at), 1
    h = las.open_header(at)
    las.extra_dimensions(h)
    return [(c, p) for c, p, _ in h.warnings], 1


def payload_of(path: str) -> str:
    """The file whose delivery matters: the points' own, not the manifest."""
    kind, at = sniff(path)
    if kind == "potree":
        return files.join(at, "octree.bin")
    if kind == "ept":
        end = {"binary": "bin", "zstandard": "zst", "laszip": "laz"}.get(ept.manifest_of(at).get("dataType"), "bin")
        return files.join(at, f"ept-data/0-0-0-0.{end}")
    if kind == "3dtiles":
        first = next((r[1] for r in tiles.walk(at)[0] if r[1]), "tileset.json")
        return files.join(at, first)
    return at


def doctor(spark: SparkSession, path: str, origin: str = "https://example.com", timeout: float = 30.0) -> tuple[DataFrame, int]:
    """Findings about a cloud, and the exit code of the worst; of a URL, also about how its server answers."""
    if http.is_url(path):
        try:
            payload = payload_of(path)
        except (OSError, ValueError):
            payload = path
        transport = diagnose.transport_findings(http.probe(spark, [payload], origin, timeout).withColumn("cloud", F.lit(path)), ["cloud"], origin)
        if transport.filter("code = 'unreachable'").count():
            return transport, 1
    else:
        transport = None
    info, _ = inspect(spark, path)
    facts = info.first()
    nodes = nodes_of(spark, path)
    if nodes is not None:
        size = F.sum("byte_size") if "byte_size" in nodes.columns else F.lit(None).cast("long")
        n = nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("point_count"), F.lit(0)).alias("points"), size.alias("bytes")).first()
    warned, reads = warnings_of(path)
    shape = spark.createDataFrame(
        [(path, facts.format, facts.crs, n["nodes"] if nodes is not None else None, n["points"] if nodes is not None else facts.point_count, facts.point_count, n["bytes"] if nodes is not None else None, reads)],
        "cloud string, format string, crs string, nodes long, points long, declared long, data_bytes long, index_reads int",
    )
    found = diagnose.shape_findings(shape, ["cloud"])
    if warned:
        found = found.unionByName(spark.createDataFrame([(path, "warn", "manifest")] * len(warned), "cloud string, level string, code string"))
    if transport is not None:
        found = found.unionByName(transport)
    return found, diagnose.exit_codes(found, ["cloud"]).first()["exit_code"]


def read_cloud(spark: SparkSession, path: str, order: int) -> tuple[DataFrame, list[float] | None, str | None]:
    """World positions with canonical columns, (input, ord) as the order of arrival; the quantum and CRS that it declares."""
    kind, at = sniff(path)
    extras = [c for c in las._NAMES if c not in ("ord", "x", "y", "z", "extra")]
    if kind == "las":
        h = las.open_header(at)
        p = las.world(las.read_points(spark, [at]), h.scale, h.offset)
        scale, crs = h.scale, las.projection(h)
    elif kind == "e57":
        _, crs = e57.open_scans(at)
        p = e57.read_points(spark, at).withColumn("ord", F.col("scan").cast("long") * (1 << 40) + F.col("packet") * (1 << 16) + F.col("row"))
        p = p.withColumns({"return_number": F.lit(1).cast("short"), "number_of_returns": F.lit(1).cast("short")})
        scale = None
    else:
        raise ValueError(f"{kind} clouds are no input of a conversion")
    schema = dict(c.strip().split() for c in las.POINT_SCHEMA.split(","))
    columns = [F.col(c) if c in p.columns else F.lit(None).cast(schema[c]).alias(c) for c in extras]
    return p.select(F.lit(order).alias("input"), F.col("ord").alias("seq"), "px", "py", "pz", *columns), scale, crs or None


def merged(spark: SparkSession, inputs: Sequence[str]) -> tuple[DataFrame, list[float], str | None, list[tuple[str, str]]]:
    """All inputs as one cloud, the finest quantum, the first declared CRS, and warnings."""
    read = [read_cloud(spark, p, k) for k, p in enumerate(inputs)]
    cloud = read[0][0]
    for other, _, _ in read[1:]:
        cloud = cloud.unionByName(other)
    scales = [s for _, s, _ in read if s]
    scale = [min((s[i] for s in scales if s[i] > 0), default=0.001) for i in range(3)]
    declared = [(p, c) for p, (_, _, c) in zip(inputs, read) if c]
    first = declared[0][1] if declared else None
    return cloud, scale, first, [("mixed-crs", p) for p, c in declared if c != first]


def input_starts(last: dict[int, int], n: int) -> list[int]:
    """Where each of ``n`` inputs starts among all, from the greatest sequence number of those with points."""
    out, at = [], 0
    for k in range(n):
        out.append(at)
        at += last[k] + 1 if k in last else 0
    return out


def convert(spark: SparkSession, inputs: Sequence[str], out: str, fmt: str = "potree", span: int = lod.SPAN, leaf: int = lod.LEAF_POINTS, scale: Sequence[float] | None = None, force: bool = False, memory: int = MEMORY) -> dict:
    """Builds and writes a cloud; the report has points, nodes, extent, scale, offset and warnings.

    Clouds whose records are over ``memory`` bytes are built in chunks.
    """
    kind, encoding = FORMATS[fmt]
    if not force and any(files.exists(files.join(out, m)) for m in MANIFESTS):
        raise FileExistsError(out)
    cloud, finest, crs, warned = merged(spark, inputs)
    box = lod.extent(cloud)
    if box is None:
        raise ValueError("the inputs have no points")
    quanta = []
    for asked, a, b in zip(scale or finest, *box):
        row = spark.range(1).select(*r.quantum(F.lit(float(asked)), F.lit(float(b - a)))).first()
        quanta.append(row[0])
        if row[1]:
            warned.append(("scale-coarsened", str(asked)))
    offset = box[0]
    q = cloud.withColumns({a: r.quantize(F.col(f"p{a}"), F.lit(s), F.lit(o)) for a, s, o in zip("xyz", quanta, offset)})
    q = q.withColumns({f"p{a}": r.dequantize(F.col(a), F.lit(s), F.lit(o)) for a, s, o in zip("xyz", quanta, offset)})
    total = q.count()
    if lod.is_chunked(total, RECORD_BYTES, memory):
        tree = lod.build_chunked(q, ["input", "seq"], lod.chunk_level(total, RECORD_BYTES, memory), span, leaf)
    else:
        tree = lod.build(q, ["input", "seq"], span, leaf)
    built = lod.stored(tree, "built")
    # one row an input: where its sequence numbers start among all
    last = {row[0]: row[1] for row in built.groupBy("input").agg(F.max("seq")).collect()}
    built = built.withColumn("ord", F.get(F.lit(input_starts(last, len(inputs))).cast("array<long>"), F.col("input")) + F.col("seq"))
    box = lod.extent(built)
    cube = (box[0], max(b - a for a, b in zip(*box)))
    if kind == "potree":
        potree.write(built, out, quanta, offset, cube, box, span, encoding, crs or "")
    elif kind == "ept":
        ept.write(built, out, quanta, offset, cube, box, span, crs, encoding)
    else:
        tiles.write(built, out, cube, span)
        lost = [c for c in ("intensity", "classification", "gps_time") if built.filter(F.col(c).isNotNull()).limit(1).count()]
        warned += [("column-dropped", c) for c in lost]
    for p in inputs:
        of = sniff(p)[0]
        if of == "las" and (h := las.open_header(p)).record_bytes > las.RECORD_BYTES[h.point_format]:
            warned.append(("extra-bytes-dropped", p))
        if of == "e57" and e57.dropped(spark, p):
            warned.append(("e57-invalid-points", p))
    if kind != "3dtiles" and built.filter("nir IS NOT NULL").limit(1).count():
        warned.append(("column-dropped", "nir"))
    n = lod.node_table(built).agg(F.count("*"), F.sum("point_count"), F.max("level")).first()
    return {"points": n[1], "nodes": n[0], "depth": n[2], "extent": box, "scale": quanta, "offset": offset, "crs": crs, "warnings": warned}


def png(size: int, pixels: dict[tuple[int, int], tuple[int, int, int]]) -> bytes:
    """An 8-bit RGBA image; pixels that are not named are clear."""
    rows = bytearray(size * (4 * size + 1))
    for (x, y), rgb in pixels.items():
        at = y * (4 * size + 1) + 1 + 4 * x
        rows[at : at + 4] = bytes((*rgb, 255))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(rows))) + chunk(b"IEND", b"")


def snapshot(spark: SparkSession, path: str, size: int = 640, points: int = 1_500_000, azimuth: float = 225.0, elevation: float = 35.0) -> DataFrame:
    """(px, py, r, g, b): an orthographic view with 2 by 2 splats, the nearest point of a pixel in front."""
    cloud, _, _ = read_cloud(spark, path, 0)
    n = cloud.count()
    if (keep := max(1, n // points)) > 1:
        cloud = cloud.filter(F.pmod(F.col("seq") + 1, F.lit(keep)) == 0)
    box = lod.extent(cloud)
    if box is None:
        return spark.createDataFrame([], "px int, py int, r int, g int, b int")
    right, up, depth = g.view_axes(azimuth, elevation)
    mid = [(a + b) / 2 for a, b in zip(*box)]
    corners = [(box[i][0], box[j][1], box[k][2]) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    flat = lambda axis: [sum((v - m) * k for v, m, k in zip(c, mid, axis)) for c in corners]
    sx, sy = flat(right), flat(up)
    unit = size * 0.9 / max(max(sx) - min(sx), max(sy) - min(sy), 1e-9)
    p = tuple(F.col(f"p{a}") - m for a, m in zip("xyz", mid))
    whole = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("int")
    top = cloud.agg(F.max(F.greatest("red", "green", "blue"))).first()[0]
    if top is None:
        span = max(box[1][2] - box[0][2], 1e-9)
        colour = g.elevation_ramp((F.col("pz") - box[0][2]) / span)
    else:
        colour = tuple(F.shiftright(F.coalesce(c, F.lit(65535)), 8 if top > 255 else 0) for c in ("red", "green", "blue"))
    at = cloud.select(
        "seq", g.project(p, depth).cast("float").alias("depth"), *[c.alias(n) for n, c in zip("rgb", colour)],
        whole((g.project(p, right) - (min(sx) + max(sx)) / 2) * unit + size / 2).alias("px"), whole(-(g.project(p, up) - (min(sy) + max(sy)) / 2) * unit + size / 2).alias("py"),
    )
    spread = at.withColumn("d", F.explode(F.expr("sequence(0, 3)"))).withColumns({"px": (F.col("px") + F.col("d") % 2).cast("int"), "py": (F.col("py") + F.floor(F.col("d") / 2)).cast("int")})
    seen = spread.filter((F.col("px") >= 0) & (F.col("px") < size) & (F.col("py") >= 0) & (F.col("py") < size))
    best = seen.groupBy("px", "py").agg(F.min(F.struct((-F.col("depth")).alias("d"), "seq", "r", "g", "b")).alias("m"))
    return best.select("px", "py", *[F.col(f"m.{c}").cast("int").alias(c) for c in "rgb"])


def save_snapshot(spark: SparkSession, path: str, out: str, size: int = 640, **options) -> int:
    """Writes a PNG; at most size * size pixels reach the driver."""
    pixels = {(p.px, p.py): (p.r, p.g, p.b) for p in snapshot(spark, path, size, **options).collect()}
    files.write_all(out, png(size, pixels))
    return len(pixels)
