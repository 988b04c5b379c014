"""E57 scans: checksummed pages, an XML section, and bit-packed compressed vectors.

Data packets of a scan are listed once by their headers and dealt to tasks by ranges, so decoding is spread; poses,
spherical coordinates, invalid points and colour are then columns.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.functions import records as r

from . import files

PAGE, PAYLOAD = 1024, 1020
_NS = "{http://www.astm.org/COMMIT/E57/2010-e57-v1.0}"


def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> np.uint32(1) ^ np.uint32(0x82F63B78), out >> np.uint32(1))
    return out


_CRC = _table().tolist()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 0xFF] ^ c >> 8
    return c ^ 0xFFFFFFFF


def paged(logical: bytes) -> bytes:
    """Pages of 1020 bytes with their checksums."""
    out = bytearray()
    for at in range(0, len(logical), PAYLOAD):
        page = logical[at : at + PAYLOAD].ljust(PAYLOAD, b"\0")
        out += page + struct.pack(">I", crc32c(page))
    return bytes(out)


def physical(logical: int) -> int:
    return logical // PAYLOAD * PAGE + logical % PAYLOAD


def logical(physical_: int) -> int:
    return physical_ // PAGE * PAYLOAD + physical_ % PAGE


def read_logical(path: str, at: int, length: int) -> bytes:
    """Bytes from a physical offset without checksums."""
    first = at // PAGE
    last = (logical(at) + length - 1) // PAYLOAD
    raw = files.read_range(path, first * PAGE, min((last - first + 1) * PAGE, files.size_of(path) - first * PAGE))
    plain = b"".join(raw[k : k + PAYLOAD] for k in range(0, len(raw), PAGE))
    start = at - first * PAGE
    return plain[start : start + length]


@dataclass
class Field:
    name: str
    kind: str  # Float, Integer, ScaledInteger
    low: int = 0
    high: int = 0
    scale: float = 1.0
    offset: float = 0.0
    double: bool = True

    @property
    def bits(self) -> int:
        if self.kind == "Float":
            return 64 if self.double else 32
        return (self.high - self.low).bit_length()


@dataclass
class Scan:
    offset: int
    records: int
    fields: list[Field]
    pose: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)
    bounds: tuple[list[float], list[float]] | None = None


def _number(node, name: str, default: float) -> float:
    e = node.find(_NS + name) if node is not None else None
    return float(e.text) if e is not None and e.text else default


def open_scans(path: str) -> tuple[list[Scan], str]:
    """The scans, and the free text of the coordinate system."""
    head = files.read_range(path, 0, 48)
    magic, _, _, _, xml_at, xml_size, _ = struct.unpack("<8sIIQQQQ", head)
    if magic != b"ASTM-E57":
        raise ValueError("not an E57 file")
    root = ET.fromstring(read_logical(path, xml_at, xml_size).decode())
    scans = []
    for node in root.findall(f"{_NS}data3D/{_NS}vectorChild"):
        points = node.find(_NS + "points")
        fields = []
        for f in points.find(_NS + "prototype"):
            kind = f.get("type")
            fields.append(Field(f.tag.rpartition("}")[2], kind, int(float(f.get("minimum", 0))) if kind != "Float" else 0, int(float(f.get("maximum", 0))) if kind != "Float" else 0, float(f.get("scale", 1)), float(f.get("offset", 0)), f.get("precision", "double") != "single"))
        scan = Scan(int(points.get("fileOffset")), int(points.get("recordCount")), fields)
        if (pose := node.find(_NS + "pose")) is not None:
            q, t = pose.find(_NS + "rotation"), pose.find(_NS + "translation")
            scan.pose = (_number(q, "w", 1), *(_number(q, a, 0) for a in "xyz"), *(_number(t, a, 0) for a in "xyz"))
        for group, names in (("colorLimits", ("colorRed", "colorGreen", "colorBlue")), ("intensityLimits", ("intensity",))):
            if (limits := node.find(_NS + group)) is not None:
                for n in names:
                    scan.limits[n] = (_number(limits, n + "Minimum", 0), _number(limits, n + "Maximum", 1))
        if (b := node.find(_NS + "cartesianBounds")) is not None:
            scan.bounds = ([_number(b, a + "Minimum", 0) for a in "xyz"], [_number(b, a + "Maximum", 0) for a in "xyz"])
        scans.append(scan)
    crs = root.find(_NS + "coordinateMetadata")
    return scans, (crs.text or "") if crs is not None else ""


def packets(path: str, scan: Scan) -> list[tuple[int, int]]:
    """(physical offset, length) of each data packet, from their headers."""
    section = struct.unpack("<B7xQQQ", read_logical(path, scan.offset, 32))
    end, at, out = logical(scan.offset) + section[1], logical(section[2]), []
    while at < end:
        kind, _, length = struct.unpack("<BBH", read_logical(path, physical(at), 4))
        if kind == 1:
            out.append((physical(at), length + 1))
        at += length + 1
    return out


def unpack_bits(raw: bytes, bits: int, n: int) -> np.ndarray:
    """``n`` whole numbers of ``bits`` bits, least bit first."""
    if not bits:
        return np.zeros(n, np.int64)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: bits * n].reshape(n, bits)
    return (flat.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype(np.int64)


def decode_packet(raw: bytes, fields: list[Field]) -> dict[str, np.ndarray]:
    n_streams = struct.unpack_from("<H", raw, 4)[0]
    sizes = struct.unpack_from(f"<{n_streams}H", raw, 6)
    starts = np.concatenate(([0], np.cumsum(sizes))) + 6 + 2 * n_streams
    counts = [s * 8 // f.bits for s, f in zip(sizes, fields) if f.bits]
    n, out = min(counts, default=0), {}
    for f, at, size in zip(fields, starts.tolist(), sizes):
        block = raw[at : at + size]
        if f.kind == "Float":
            out[f.name] = np.frombuffer(block, "<f8" if f.double else "<f4", n).astype(np.float64)
        else:
            v = unpack_bits(block, f.bits, n) + f.low
            out[f.name] = v * f.scale + f.offset if f.kind == "ScaledInteger" else v.astype(np.float64)
    return out


_FIELDS = ("cartesianX", "cartesianY", "cartesianZ", "sphericalRange", "sphericalAzimuth", "sphericalElevation", "intensity", "colorRed", "colorGreen", "colorBlue", "cartesianInvalidState", "sphericalInvalidState")


def rotation(q: tuple[float, ...]) -> np.ndarray:
    """The matrix of a unit quaternion (w, x, y, z)."""
    w, v = q[0], np.array(q[1:4])
    cross = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return (w * w - v @ v) * np.eye(3) + 2 * np.outer(v, v) + 2 * w * cross


def declared_extent(scans: list[Scan]) -> tuple[list[float], list[float]] | None:
    """The box of all scans' declared boxes, each turned and moved by its pose corner by corner; None if none is declared."""
    corners = []
    for s in scans:
        if s.bounds is not None:
            box = np.array(s.bounds)
            picks = np.array(np.meshgrid([0, 1], [0, 1], [0, 1])).reshape(3, -1)
            corners.append(box[picks, np.arange(3)[:, None]].T @ rotation(s.pose[:4]).T + s.pose[4:])
    if not corners:
        return None
    every = np.concatenate(corners)
    return every.min(axis=0).tolist(), every.max(axis=0).tolist()


def measure(spark: SparkSession, path: str) -> tuple[list[float], list[float], int]:
    """Low and high corner and number of the points that have a position, from one pass over them."""
    row = read_points(spark, path).agg(*[f(f"p{a}").alias(f"{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in "xyz"], F.count("*").alias("n")).first()
    if not row["n"]:
        raise ValueError(f"{path}: no point has a position")
    return [row[f"lo{a}"] for a in "xyz"], [row[f"hi{a}"] for a in "xyz"], row["n"]


def raw_points(spark: SparkSession, path: str) -> DataFrame:
    """(scan, packet, row) and the fields that a scan has, as doubles, decoded by tasks over ranges of packets."""
    scans, _ = open_scans(path)
    jobs = [(k, n, at, size) for k, s in enumerate(scans) for n, (at, size) in enumerate(packets(path, s))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in b.to_pylist():
                columns = decode_packet(read_logical(path, j["at"], j["size"]), scans[j["scan"]].fields)
                n = len(next(iter(columns.values()), ()))
                arrays = [pa.array(np.full(n, j["scan"], np.int32)), pa.array(np.full(n, j["packet"], np.int64)), pa.array(np.arange(n, dtype=np.int64))]
                arrays += [pa.array(columns[c]) if c in columns else pa.nulls(n, pa.float64()) for c in _FIELDS]
                yield pa.RecordBatch.from_arrays(arrays, ["scan", "packet", "row", *_FIELDS])

    plan = spark.createDataFrame(jobs, "scan int, packet long, at long, size long")
    schema = "scan int, packet long, row long, " + ", ".join(f"{c} double" for c in _FIELDS)
    return plan.repartition(max(1, min(len(jobs), spark.sparkContext.defaultParallelism))).mapInArrow(read, schema)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """World positions px, py, pz with pose applied, invalid points left out, colour and intensity widened, one-based source."""
    scans, _ = open_scans(path)
    rows = raw_points(spark, path)
    facts = [(k, *map(float, s.pose), *(float(v) for c in ("intensity", "colorRed", "colorGreen", "colorBlue") for v in _limits(s, c))) for k, s in enumerate(scans)]
    names = ("qw", "qx", "qy", "qz", "tx", "ty", "tz", *(f"{c}_{e}" for c in ("i", "r", "g", "b") for e in ("lo", "hi")))
    # one row per scan
    joined = rows.join(F.broadcast(spark.createDataFrame(facts, "scan int, " + ", ".join(f"{n} double" for n in names))), "scan")
    c = F.col
    valid = (F.coalesce(c("cartesianInvalidState"), F.lit(0.0)) == 0) & (F.coalesce(c("sphericalInvalidState"), F.lit(0.0)) == 0)
    round_ = r.spherical(c("sphericalRange"), c("sphericalAzimuth"), c("sphericalElevation"))
    p = tuple(F.coalesce(c(f"cartesian{a.upper()}"), s) for a, s in zip("xyz", round_))
    world = r.posed(p, (c("qw"), c("qx"), c("qy"), c("qz")), (c("tx"), c("ty"), c("tz")))
    widen = lambda v, k: r.widen_channel((c(v) - c(f"{k}_lo")) / F.when(c(f"{k}_hi") > c(f"{k}_lo"), c(f"{k}_hi") - c(f"{k}_lo")))
    colour = [F.coalesce(widen(v, k), F.lit(65535)).alias(n) for v, k, n in (("colorRed", "r", "red"), ("colorGreen", "g", "green"), ("colorBlue", "b", "blue"))]
    return joined.filter(valid & p[0].isNotNull()).select(
        "scan", "packet", "row", *[w.alias(f"p{a}") for a, w in zip("xyz", world)], F.coalesce(widen("intensity", "i"), F.lit(0)).alias("intensity"), *colour, r.source_id(c("scan")).alias("point_source_id")
    )


def _limits(scan: Scan, name: str) -> tuple[float, float]:
    if name in scan.limits:
        return scan.limits[name]
    f = next((f for f in scan.fields if f.name == name), None)
    if f is None or f.kind == "Float":
        return 0.0, 1.0
    return f.low * f.scale + f.offset, f.high * f.scale + f.offset


def dropped(spark: SparkSession, path: str) -> int:
    """Points that ``read_points`` leaves out."""
    scans, _ = open_scans(path)
    return sum(s.records for s in scans) - read_points(spark, path).count()


def warnings_of(path: str) -> list[tuple[str, str]]:
    scans, _ = open_scans(path)
    out = [("e57-multi-scan", str(len(scans)))] if len(scans) > 1 else []
    for k, s in enumerate(scans):
        names = {f.name for f in s.fields}
        if s.bounds is None:
            out.append(("e57-bounds-undeclared", str(k)))
        elif s.pose != (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0):
            out.append(("e57-bounds-posed", str(k)))
        if "sphericalRange" in names and "cartesianX" not in names:
            out.append(("e57-spherical", str(k)))
    if declared_extent(scans) is None:
        out.append(("e57-extent-unknown", path))
    if len(scans) > 65535:
        out.append(("e57-scans-overflow", str(len(scans))))
    return out


def write(path: str, scans: list[tuple[list[Field], dict[str, np.ndarray], tuple[float, ...]]], per_packet: int = 500) -> None:
    """A file of scans (fields, columns of stored whole numbers or floats, pose): for tests and small exports."""
    body, nodes = bytearray(48), []
    for fields, columns, pose in scans:
        n = len(next(iter(columns.values())))
        section = len(body)
        body += bytes(32)
        data = len(body)
        for at in range(0, n, per_packet):
            streams = []
            for f in fields:
                v = columns[f.name][at : at + per_packet]
                if f.kind == "Float":
                    streams.append(np.asarray(v, "<f8" if f.double else "<f4").tobytes())
                else:
                    raw = (np.asarray(v, np.int64) - f.low).astype(np.uint64)
                    bits = (raw[:, None] >> np.arange(f.bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
                    streams.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
            packet = struct.pack(f"<H{len(streams)}H", len(streams), *map(len, streams)) + b"".join(streams)
            packet += b"\0" * (-(len(packet) + 4) % 4)
            body += struct.pack("<BBH", 1, 0, len(packet) + 3) + packet
        struct.pack_into("<B7xQQQ", body, section, 1, len(body) - section, physical(data), 0)
        proto = "".join(
            f'<{f.name} type="Float"{"" if f.double else " precision=" + chr(34) + "single" + chr(34)}/>' if f.kind == "Float" else f'<{f.name} type="{f.kind}" minimum="{f.low}" maximum="{f.high}" scale="{f.scale}" offset="{f.offset}"/>'
            for f in fields
        )
        w, x, y, z, a, b, c = pose
        nodes.append(
            f'<vectorChild type="Structure"><pose type="Structure"><rotation type="Structure"><w>{w}</w><x>{x}</x><y>{y}</y><z>{z}</z></rotation><translation type="Structure"><x>{a}</x><y>{b}</y><z>{c}</z></translation></pose>'
            f'<points type="CompressedVector" fileOffset="{physical(section)}" recordCount="{n}"><prototype type="Structure">{proto}</prototype></points></vectorChild>'
        )
    xml = f'<?xml version="1.0"?><e57Root type="Structure" xmlns="{_NS[1:-1]}"><coordinateMetadata type="String">EPSG:26912</coordinateMetadata><data3D type="Vector">{"".join(nodes)}</data3D></e57Root>'.encode()
    at = len(body)
    body += xml
    size = (len(body) + PAYLOAD - 1) // PAYLOAD * PAGE
    struct.pack_into("<8sIIQQQQ", body, 0, b"ASTM-E57", 1, 0, size, physical(at), len(xml), PAGE)
    files.write_all(path, paged(bytes(body)))
