"""LAS files: headers, variable records, extra dimensions, and points as Arrow batches by ranges of records.

Compressed (LAZ) point data is recognised and refused; headers, variable records and hierarchies of such files read.
"""

from __future__ import annotations

import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

# Record sizes by point format.
RECORD_BYTES = (20, 28, 26, 34, 57, 63, 30, 36, 38, 59, 67)
COLOUR_FORMATS = (2, 3, 5, 7, 8, 10)
NIR_FORMATS = (8, 10)
TIMELESS_FORMATS = (0, 2)
HEADER_BYTES = {0: 227, 1: 227, 2: 227, 3: 235, 4: 375}
#: Scan angles of old formats are degrees; all are read as steps of this many.
ANGLE_STEP = 0.006
ROWS_PER_PARTITION = 2_000_000
BATCH_ROWS = 65_536


@dataclass
class Vlr:
    user: str
    record: int
    description: str
    data: bytes


@dataclass
class Header:
    version: tuple[int, int]
    point_format: int
    record_bytes: int
    points: int
    data_offset: int
    scale: list[float]
    offset: list[float]
    low: list[float]
    high: list[float]
    compressed: bool
    header_bytes: int
    n_vlrs: int
    evlr_offset: int
    n_evlrs: int
    wkt: bool
    vlrs: list[Vlr] = field(default_factory=list)
    warnings: list[tuple[str, str, str]] = field(default_factory=list)


def text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1").rstrip()


def parse_header(raw: bytes) -> Header:
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = raw[24], raw[25]
    size, data_offset, n_vlrs, kind, record, old_count = struct.unpack_from("<HIIBHI", raw, 94)
    if size < HEADER_BYTES.get(minor, 375) or len(raw) < size:
        raise ValueError("the header is too short for its version")
    scale, offset = list(struct.unpack_from("<3d", raw, 131)), list(struct.unpack_from("<3d", raw, 155))
    ends = struct.unpack_from("<6d", raw, 179)  # greatest and least of each axis in turn
    points, evlr, n_evlrs = old_count, 0, 0
    if minor >= 4:
        evlr, n_evlrs, count = struct.unpack_from("<QIQ", raw, 235)
        points = count or old_count
    wkt = bool(struct.unpack_from("<H", raw, 6)[0] & 16)
    return Header((major, minor), kind & 0x3F, record, points, data_offset, scale, offset, list(ends[1::2]), list(ends[0::2]), bool(kind & 0x80), size, n_vlrs, evlr, n_evlrs, wkt)


def walk_records(raw: bytes, at: int, count: int, extended: bool) -> tuple[list[Vlr], bool]:
    """Variable records from ``at``; whether all ``count`` of them were there."""
    out, head = [], 60 if extended else 54
    for _ in range(count):
        if at + head > len(raw):
            return out, False
        user, record, length = raw[at + 2 : at + 18], *struct.unpack_from("<HQ" if extended else "<HH", raw, at + 18)
        if at + head + length > len(raw):
            return out, False
        out.append(Vlr(text(user), record, text(raw[at + head - 32 : at + head]), raw[at + head : at + head + length]))
        at += head + length
    return out, True


def open_header(path: str) -> Header:
    """The header with its variable records, from one small read, widened once if need be."""
    size = files.size_of(path)
    raw = files.read_range(path, 0, min(size, 8192))
    h = parse_header(raw)
    if h.data_offset > len(raw):
        raw = files.read_range(path, 0, min(size, h.data_offset))
    h.vlrs, whole = walk_records(raw, h.header_bytes, h.n_vlrs, False)
    if not whole:
        h.warnings.append(("vlr-truncated", path, "not all variable records could be read"))
    if h.n_evlrs and h.evlr_offset < size:
        more, whole = walk_records(files.read_range(path, h.evlr_offset, size - h.evlr_offset), 0, h.n_evlrs, True)
        h.vlrs += more
        if not whole:
            h.warnings.append(("evlr-truncated", path, "not all extended records could be read"))
    return h


# Element types of extra dimensions 1 to 10.
EXTRA_TYPES = ("u1", "i1", "<u2", "<i2", "<u4", "<i4", "<u8", "<i8", "<f4", "<f8")


@dataclass
class Extra:
    name: str
    kind: str  # a numpy type, or "" for undocumented bytes
    elements: int
    offset: int
    size: int
    description: str


def extra_dimensions(h: Header) -> list[Extra]:
    """Dimensions beyond the format's own, from the Extra Bytes record; those past the record's end are dropped."""
    raw = next((v.data for v in h.vlrs if v.user == "LASF_Spec" and v.record == 4), b"")
    at, out = RECORD_BYTES[h.point_format], []
    for k in range(0, len(raw) - 191, 192):
        kind, options = raw[k + 2], raw[k + 3]
        name, description = text(raw[k + 4 : k + 36]), text(raw[k + 160 : k + 192])
        if kind == 0:
            dtype, n, size = "", 1, options
        elif kind <= 30:
            dtype, n = EXTRA_TYPES[(kind - 1) % 10], (kind - 1) // 10 + 1
            size = np.dtype(dtype).itemsize * n
        else:
            h.warnings.append(("undecodable-attribute", name, f"type {kind}"))
            break
        if at + size > h.record_bytes:
            h.warnings.append(("extra-bytes-mismatch", name, "past the end of the record"))
            break
        if any(e.name == name for e in out):
            h.warnings.append(("duplicate-attribute-name", name, "several dimensions have this name"))
        out.append(Extra(name, dtype, n, at, size, description))
        at += size
    return out


def projection(h: Header) -> str | None:
    """WKT if there is any, else EPSG:n of the GeoTIFF keys."""
    for v in h.vlrs:
        if v.user == "LASF_Projection" and v.record == 2112 and text(v.data):
            return text(v.data)
    for v in h.vlrs:
        if v.user == "LASF_Projection" and v.record == 34735 and len(v.data) >= 8:
            keys = np.frombuffer(v.data[8 : 8 + 8 * struct.unpack_from("<H", v.data, 6)[0]], "<u2").reshape(-1, 4)
            codes = {int(k): int(value) for k, where, _, value in keys if where == 0}
            # the model (1 projected, 2 geographic) says which code counts; without one the projected system's comes first
            for key in {1: (3072,), 2: (2048,)}.get(codes.get(1024), (3072, 2048)):
                if codes.get(key, 0) not in (0, 32767):
                    return f"EPSG:{codes[key]}"
    return None


def record_type(kind: int, record_bytes: int) -> np.dtype:
    """The format's fixed fields at their places in a record."""
    names, formats, offsets = [], [], []

    def add(name: str, dtype, at: int) -> None:
        names.append(name)
        formats.append(dtype)
        offsets.append(at)

    add("xyz", ("<i4", (3,)), 0)
    add("intensity", "<u2", 12)
    add("returns", "u1", 14)
    if kind < 6:
        add("class", "u1", 15)
        add("angle", "i1", 16)
        add("user", "u1", 17)
        add("source", "<u2", 18)
        at = 20
    else:
        add("flags", "u1", 15)
        add("class", "u1", 16)
        add("user", "u1", 17)
        add("angle", "<i2", 18)
        add("source", "<u2", 20)
        at = 22
    if kind not in TIMELESS_FORMATS:
        add("gps", "<f8", at)
        at += 8
    if kind in COLOUR_FORMATS:
        add("rgb", ("<u2", (3,)), at)
        at += 6
    if kind in NIR_FORMATS:
        add("nir", "<u2", at)
    return np.dtype({"names": names, "formats": formats, "offsets": offsets, "itemsize": record_bytes})


POINT_SCHEMA = (
    "ord long, x int, y int, z int, intensity int, return_number short, number_of_returns short, classification_flags short, scanner_channel short, scan_direction short, edge short, "
    "classification short, user_data short, scan_angle short, point_source_id int, gps_time double, red int, green int, blue int, nir int, extra binary"
)
_NAMES = [c.strip().split()[0] for c in POINT_SCHEMA.split(",")]


def decode(raw: bytes, kind: int, record_bytes: int, first: int) -> pa.RecordBatch:
    """Records as the canonical columns. What a format lacks is null; legacy fields are widened."""
    r = np.frombuffer(raw, record_type(kind, record_bytes))
    n = len(r)
    byte = r["returns"].astype(np.int16)
    if kind < 6:
        number, returns = byte & 7, byte >> 3 & 7
        flags, channel, direction, edge = r["class"].astype(np.int16) >> 5 & 7, np.zeros(n, np.int16), byte >> 6 & 1, byte >> 7 & 1
        cls = r["class"].astype(np.int16) & 31
        steps = r["angle"].astype(np.float64) / ANGLE_STEP
        angle = (np.sign(steps) * np.floor(np.abs(steps) + 0.5)).astype(np.int16)
    else:
        f = r["flags"].astype(np.int16)
        number, returns = byte & 15, byte >> 4 & 15
        flags, channel, direction, edge = f & 15, f >> 4 & 3, f >> 6 & 1, f >> 7 & 1
        cls, angle = r["class"].astype(np.int16), r["angle"]
    none = lambda t: pa.nulls(n, t)
    rgb = [pa.array(r["rgb"][:, i].astype(np.int32)) for i in range(3)] if kind in COLOUR_FORMATS else [none(pa.int32())] * 3
    own = RECORD_BYTES[kind]
    if record_bytes > own:
        tail = np.frombuffer(raw, np.uint8).reshape(n, record_bytes)[:, own:]
        extra = pa.array([t.tobytes() for t in tail], pa.binary())
    else:
        extra = none(pa.binary())
    columns = [
        np.arange(first, first + n, dtype=np.int64), *(r["xyz"][:, i].astype(np.int32) for i in range(3)), r["intensity"].astype(np.int32), number, returns, flags, channel, direction, edge,
        cls, r["user"].astype(np.int16), angle.astype(np.int16), r["source"].astype(np.int32),
    ]
    arrays = [pa.array(np.ascontiguousarray(c)) for c in columns]
    arrays.append(none(pa.float64()) if kind in TIMELESS_FORMATS else pa.array(np.ascontiguousarray(r["gps"])))
    arrays += [*rgb, pa.array(r["nir"].astype(np.int32)) if kind in NIR_FORMATS else none(pa.int32()), extra]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def encode(batch: pa.RecordBatch, kind: int, extra_bytes: int = 0) -> bytes:
    """The canonical columns as records of formats 6, 7 or 8: missing time is 0, missing colour white, missing NIR 0."""
    n = batch.num_rows
    r = np.zeros(n, record_type(kind, RECORD_BYTES[kind] + extra_bytes))
    get = lambda c, fill=0: np.asarray(batch.column(c).fill_null(fill))
    for i, a in enumerate("xyz"):
        r["xyz"][:, i] = get(a)
    r["intensity"], r["returns"] = get("intensity"), get("return_number") | get("number_of_returns") << 4
    r["flags"] = get("classification_flags") | get("scanner_channel") << 4 | get("scan_direction") << 6 | get("edge") << 7
    r["class"], r["user"], r["angle"], r["source"], r["gps"] = get("classification"), get("user_data"), get("scan_angle"), get("point_source_id"), get("gps_time", 0.0)
    if kind in COLOUR_FORMATS:
        for i, c in enumerate(("red", "green", "blue")):
            r["rgb"][:, i] = get(c, 65535)
    if kind in NIR_FORMATS:
        r["nir"] = get("nir")
    raw = r.tobytes()
    if extra_bytes:
        table = np.frombuffer(raw, np.uint8).reshape(n, -1).copy()
        for i, e in enumerate(batch.column("extra")):
            value = (e.as_py() or b"")[:extra_bytes]
            table[i, RECORD_BYTES[kind] : RECORD_BYTES[kind] + len(value)] = np.frombuffer(value, np.uint8)
        raw = table.tobytes()
    return raw


class _Range(InputPartition):
    def __init__(self, path: str, kind: int, record_bytes: int, start: int, first: int, count: int):
        self.path, self.kind, self.record_bytes, self.start, self.first, self.count = path, kind, record_bytes, start, first, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.rows = int(options.get("rowsPerPartition", ROWS_PER_PARTITION))

    def partitions(self) -> list[_Range]:
        out, first = [], 0
        for path in self.paths:
            h = open_header(path)
            if h.compressed:
                raise ValueError(f"{path}: compressed point data is not supported")
            # a truncated file gives its whole records
            there = min(h.points, max(0, files.size_of(path) - h.data_offset) // h.record_bytes)
            for at in range(0, there, self.rows):
                n = min(self.rows, there - at)
                out.append(_Range(path, h.point_format, h.record_bytes, h.data_offset + at * h.record_bytes, first + at, n))
            first += there
        return out or [_Range("", 6, 30, 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        p = partition
        for at in range(0, p.count, BATCH_ROWS):
            n = min(BATCH_ROWS, p.count - at)
            yield decode(files.read_range(p.path, p.start + at * p.record_bytes, n * p.record_bytes), p.kind, p.record_bytes, p.first + at)


class LasDataSource(DataSource):
    """``spark.read.format("las").load("a.las,b.las")``: points in file order, a partition for each range of records."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return POINT_SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_points(spark: SparkSession, paths: list[str], rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    spark.dataSource.register(LasDataSource)
    return spark.read.format("las").option("rowsPerPartition", rows_per_partition).load(",".join(paths))


def write_header(points: int, kind: int, record_bytes: int, scale, offset, low, high, by_return: list[int], vlrs: list[Vlr] = (), evlr_offset: int = 0, n_evlrs: int = 0, compressed: bool = False, day: int | None = None, year: int | None = None, has_wkt: bool = False) -> bytes:
    """A version 1.4 header with its variable records; the old counts are zero, the date is today's (UTC) if not given."""
    today = time.gmtime()
    day, year = day or today.tm_yday, year or today.tm_year
    body = b"".join(write_vlr(v) for v in vlrs)
    h = bytearray(375)
    h[:4] = b"LASF"
    struct.pack_into("<H", h, 6, 16 if has_wkt else 0)
    h[24], h[25] = 1, 4
    h[26:32], h[58:67] = b"EXPORT", b"pointmill"
    struct.pack_into("<HHHIIBHI", h, 90, day, year, 375, 375 + len(body), len(vlrs), kind | (0x80 if compressed else 0), record_bytes, 0)
    struct.pack_into("<3d3d6d", h, 131, *scale, *offset, *(v for pair in zip(high, low) for v in pair))
    struct.pack_into("<QQIQ15Q", h, 227, 0, evlr_offset, n_evlrs, points, *(by_return + [0] * 15)[:15])
    return bytes(h) + body


def write_vlr(v: Vlr) -> bytes:
    return struct.pack("<H16sHH32s", 0, v.user.encode()[:16], v.record, len(v.data), v.description.encode()[:32]) + v.data


def write_evlr(v: Vlr) -> bytes:
    return struct.pack("<H16sHQ32s", 0, v.user.encode()[:16], v.record, len(v.data), v.description.encode()[:32]) + v.data


def wkt_vlr(wkt: str) -> Vlr:
    return Vlr("LASF_Projection", 2112, "WKT", wkt.encode() + b"\0")


def write_tiles(points: DataFrame, folder: str, kind: int, scale: list[float], offset: list[float], wkt: str | None = None) -> DataFrame:
    """One LAS file per partition, written by its task; (file, points) of each. Tiles carry their own extents."""
    vlrs = [wkt_vlr(wkt)] if wkt else []

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts, n, low, high, returns = [], 0, np.full(3, np.inf), np.full(3, -np.inf), np.zeros(16, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            parts.append(encode(b, kind))
            n += b.num_rows
            for i, a in enumerate("xyz"):
                v = np.asarray(b.column(a))
                low[i], high[i] = min(low[i], v.min()), max(high[i], v.max())
            returns += np.bincount(np.asarray(b.column("return_number").fill_null(0)), minlength=16)[:16]
        if n:
            to = lambda v: [float(q * s + o) for q, s, o in zip(v, scale, offset)]
            path = files.join(folder, f"tile-{TaskContext.get().partitionId():06d}.las")
            head = write_header(n, kind, RECORD_BYTES[kind], scale, offset, to(low), to(high), returns[1:].tolist(), vlrs, has_wkt=bool(wkt))
            files.write_all(path, head + b"".join(parts))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["file", "points"])

    return points.select(*_NAMES).mapInArrow(write, "file string, points long")


def cloud_info(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file, from headers alone: no point is read."""
    rows = []
    for p in paths:
        h = open_header(p)
        extras = [e.name for e in extra_dimensions(h)]
        rows.append((p, "copc" if any(v.user == "copc" for v in h.vlrs) else "laz" if h.compressed else "las", f"{h.version[0]}.{h.version[1]}", h.points, h.point_format, h.record_bytes, h.low, h.high, h.scale, h.offset, projection(h), extras, [{"code": c, "path": q, "message": m} for c, q, m in h.warnings]))
    schema = (
        "file string, format string, version string, point_count long, point_format int, record_bytes int, low array<double>, high array<double>, scale array<double>, offset array<double>, crs string, "
        "extra array<string>, warnings array<struct<code string, path string, message string>>"
    )
    return spark.createDataFrame(rows, schema)


def world(points: DataFrame, scale: list[float], offset: list[float]) -> DataFrame:
    """Adds px, py, pz."""
    return points.withColumns({f"p{a}": F.col(a) * s + o for a, s, o in zip("xyz", scale, offset)})
