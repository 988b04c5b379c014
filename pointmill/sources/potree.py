"""Potree v2 clouds: ``metadata.json``, ``hierarchy.bin`` and ``octree.bin``, with plain or brotli payloads.

Nodes are encoded on the executors; the one payload file is written from their rows in order, a node at a time. The
hierarchy names every ancestor of a node, so none is out of reach.
"""

from __future__ import annotations

import json
import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

STEP = 5
_RECORD = struct.Struct("<BBIQQ")
NORMAL, LEAF, PROXY = 0, 1, 2
# Attribute names, types and widths of the format, in its order.
FIELDS = (
    ("position", "int32", 3), ("intensity", "uint16", 1), ("return number", "uint8", 1), ("number of returns", "uint8", 1), ("classification flags", "uint8", 1),
    ("classification", "uint8", 1), ("user data", "uint8", 1), ("scan angle", "int16", 1), ("point source id", "uint16", 1), ("gps-time", "double", 1), ("rgb", "uint16", 3),
)
TYPES = {"int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "int64": "<i8", "uint64": "<u8", "float": "<f4", "double": "<f8"}
_COLUMNS = {
    "position": ("x", "y", "z"), "intensity": ("intensity",), "return number": ("return_number",), "number of returns": ("number_of_returns",), "classification flags": ("classification_flags",),
    "classification": ("classification",), "user data": ("user_data",), "scan angle": ("scan_angle",), "point source id": ("point_source_id",), "gps-time": ("gps_time",), "rgb": ("red", "green", "blue"),
}
_FILL = {"rgb": 65535}
Key = tuple[int, int, int, int]


def width(kind: str, n: int) -> int:
    return np.dtype(TYPES[kind]).itemsize * n


def fields_for(colour: bool, gps: bool) -> list[tuple[str, str, int]]:
    return [f for f in FIELDS if (f[0] != "rgb" or colour) and (f[0] != "gps-time" or gps)]


# ---- payloads -----------------------------------------------------------------------------------------------------


def _interleave(parts: np.ndarray) -> np.ndarray:
    """Bytes of three axes (n, 3) as 24-bit codes, the first axis lowest."""
    out = np.zeros(len(parts), np.uint32)
    for bit in range(8):
        for axis in range(3):
            out |= (parts[:, axis].astype(np.uint32) >> bit & 1) << np.uint32(3 * bit + axis)
    return out


def _separate(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), 3), np.uint32)
    for bit in range(8):
        for axis in range(3):
            out[:, axis] |= (codes >> np.uint32(3 * bit + axis) & 1) << np.uint32(bit)
    return out


def _pack(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return low | (high & 0xFF) << np.uint32(24), high >> np.uint32(8)


def _unpack(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return first & np.uint32(0xFFFFFF), first >> np.uint32(24) | second << np.uint32(8)


def morton_block(values: np.ndarray) -> bytes:
    """Positions (n, 3) of 32 bits as 16 bytes each, or colours of 16 bits as 8: the high codes' words come first."""
    unsigned = values.astype(np.int64).astype(np.uint32)
    codes = [_interleave(unsigned >> np.uint32(8 * k) & 0xFF) for k in range(4 if values.dtype.itemsize == 4 else 2)]
    pairs = [_pack(codes[k], codes[k + 1]) for k in range(0, len(codes), 2)]
    words = [w for pair in reversed(pairs) for w in pair]
    return np.stack(words, axis=1).astype("<u4").tobytes()


def morton_values(raw: bytes, n: int, kind: str) -> np.ndarray:
    """The inverse of ``morton_block``."""
    words = np.frombuffer(raw, "<u4").reshape(n, -1)
    pairs = [(words[:, k], words[:, k + 1]) for k in range(0, words.shape[1], 2)]
    codes = [c for pair in reversed(pairs) for c in _unpack(*pair)]
    out = np.zeros((n, 3), np.uint32)
    for k, c in enumerate(codes):
        out |= _separate(c) << np.uint32(8 * k)
    return out.astype(np.int64).astype(np.uint32).view(np.int32) if kind == "int32" else out.astype(np.uint16)


def _is_colour(name: str) -> bool:
    return name in ("rgb", "rgba", "RGBA")


def _is_position(name: str) -> bool:
    return name in ("position", "POSITION_CARTESIAN")


def encode_node(columns: dict[str, np.ndarray], fields, encoding: str, n: int) -> bytes:
    if encoding == "BROTLI":
        blocks = [morton_block(columns[name]) if _is_position(name) or _is_colour(name) else columns[name].tobytes() for name, _, _ in fields]
        return pa.Codec("brotli", compression_level=6).compress(b"".join(blocks), asbytes=True)
    dtype = np.dtype([(name, TYPES[kind], (k,)) if k > 1 else (name, TYPES[kind]) for name, kind, k in fields])
    out = np.zeros(n, dtype)
    for name, _, _ in fields:
        out[name] = columns[name]
    return out.tobytes()


def decode_node(raw: bytes, fields, encoding: str, n: int) -> dict[str, np.ndarray]:
    if encoding == "BROTLI":
        widths = [16 if _is_position(name) else 8 if _is_colour(name) else width(kind, k) for name, kind, k in fields]
        plain = pa.Codec("brotli").decompress(raw, decompressed_size=sum(widths) * n, asbytes=True) if n else b""
        out, at = {}, 0
        for (name, kind, k), w in zip(fields, widths):
            block = plain[at : at + w * n]
            at += w * n
            if _is_position(name) or _is_colour(name):
                out[name] = morton_values(block, n, kind)
            else:
                values = np.frombuffer(block, TYPES[kind])
                out[name] = values.reshape(n, k) if k > 1 else values
        return out
    dtype = np.dtype([(name, TYPES[kind], (k,)) if k > 1 else (name, TYPES[kind]) for name, kind, k in fields])
    table = np.frombuffer(raw, dtype)
    return {name: table[name] for name, _, _ in fields}


# ---- hierarchy ----------------------------------------------------------------------------------------------------


def parent_of(key: Key) -> Key | None:
    level, *axes = key
    return (level - 1, *(a >> 1 for a in axes)) if level else None


def digit_of(key: Key) -> int:
    return (key[1] & 1) << 2 | (key[2] & 1) << 1 | key[3] & 1


def child_of(key: Key, digit: int) -> Key:
    return key[0] + 1, key[1] * 2 + (digit >> 2 & 1), key[2] * 2 + (digit >> 1 & 1), key[3] * 2 + (digit & 1)


def with_ancestors(keys) -> set[Key]:
    out = set()
    for key in keys:
        while key is not None and key not in out:
            out.add(key)
            key = parent_of(key)
    return out


def hierarchy_bytes(nodes: dict[Key, tuple[int, int, int]], step: int = STEP) -> tuple[bytes, int]:
    """Chunks of ``step`` levels from (points, offset, size) by key; the first chunk is at 0, its size is returned.

    Chunk sizes are known from the tree alone, so places are given out first and records written once.
    """
    keys = with_ancestors(nodes) or {(0, 0, 0, 0)}
    kids: dict[Key, list[Key]] = {}
    for key in sorted(keys):
        if key[0]:
            kids.setdefault(parent_of(key), []).append(key)
    chunks: dict[Key, list[Key]] = {}
    waiting = deque([(0, 0, 0, 0)])
    while waiting:
        seed = waiting.popleft()
        order, queue = [], deque([seed])
        while queue:
            key = queue.popleft()
            order.append(key)
            if key[0] - seed[0] + 1 < step:
                queue.extend(kids.get(key, ()))
            elif key in kids and key != seed:
                waiting.append(key)
        chunks[seed] = order
    places, at = {}, 0
    for seed, order in chunks.items():
        places[seed] = at
        at += len(order) * _RECORD.size
    out = bytearray()
    for seed, order in chunks.items():
        for key in order:
            points, offset, size = nodes.get(key, (0, 0, 0))
            if key != seed and key in chunks:
                out += _RECORD.pack(PROXY, 0, points, places[key], len(chunks[key]) * _RECORD.size)
            else:
                mask = sum(1 << digit_of(k) for k in kids.get(key, ()))
                out += _RECORD.pack(NORMAL if mask else LEAF, mask, points, offset, size)
    return bytes(out), len(chunks[(0, 0, 0, 0)]) * _RECORD.size


def read_hierarchy(raw: bytes, first_chunk: int) -> tuple[dict[Key, tuple[int, int, int]], list[tuple[str, str]]]:
    """(points, offset, size) by key, and warnings; a chunk met twice is not walked again."""
    nodes, warned, seen = {}, [], set()
    waiting = deque([((0, 0, 0, 0), 0, first_chunk)])
    while waiting:
        seed, at, size = waiting.popleft()
        if (at, size) in seen or at + size > len(raw):
            warned.append(("hierarchy-cycle" if (at, size) in seen else "hierarchy-missing", f"{at}"))
            continue
        seen.add((at, size))
        slots = deque([seed])
        for k in range(size // _RECORD.size):
            kind, mask, points, offset, length = _RECORD.unpack_from(raw, at + k * _RECORD.size)
            if not slots:
                break
            key = slots.popleft()
            if kind == PROXY and k:
                waiting.append((key, offset, length))
                nodes.setdefault(key, (points, 0, 0))
                continue
            nodes[key] = (points, offset, length)
            slots.extend(child_of(key, d) for d in range(8) if mask >> d & 1)
    return nodes, warned


# ---- whole clouds -------------------------------------------------------------------------------------------------

_NODE = "level long, x long, y long, z long, points long, payload binary"


def node_payloads(built: DataFrame, fields, encoding: str) -> DataFrame:
    """One row per node with its payload; a node's points are at most a leaf's or a grid's, so a group is bounded."""

    def one(key, t):
        t = t.sort_by("ord")
        n = t.num_rows
        columns = {}
        for name, kind, k in fields:
            parts = [np.asarray(t.column(c).fill_null(_FILL.get(name, 0)).combine_chunks()).astype(TYPES[kind]) for c in _COLUMNS[name]]
            columns[name] = np.stack(parts, axis=1) if k > 1 else parts[0]
        payload = encode_node(columns, fields, encoding, n)
        return pa.table({**{c: pa.array([v.as_py()], pa.int64()) for c, v in zip(("level", "x", "y", "z"), key)}, "points": pa.array([n], pa.int64()), "payload": pa.array([payload], pa.binary())})

    keyed = built.select("level", "kx", "ky", "kz", "ord", *dict.fromkeys(c for name, _, _ in fields for c in _COLUMNS[name]))
    return keyed.groupBy("level", "kx", "ky", "kz").applyInArrow(one, _NODE)


def domains(points: DataFrame, fields, low: list[float], high: list[float]) -> dict[str, tuple[list[float], list[float]]]:
    """Measured for intensity and time, of the extent for positions, of the type for the others."""
    m = points.agg(F.min("intensity"), F.max("intensity"), F.min("gps_time"), F.max("gps_time")).first()
    out = {}
    for name, kind, k in fields:
        top = {"uint8": 255.0, "uint16": 65535.0}.get(kind, 0.0)
        out[name] = ([0.0] * k, [top] * k)
    out["position"], out["intensity"] = (low, high), ([float(m[0] or 0)], [float(m[1] or 0)])
    if "gps-time" in out:
        out["gps-time"] = ([float(m[2] or 0)], [float(m[3] or 0)])
    out["scan angle"] = ([-30000.0], [30000.0])
    return out


def write(built: DataFrame, folder: str, scale, offset, cube: tuple[list[float], float], extent: tuple[list[float], list[float]], span: int, encoding: str = "DEFAULT", crs: str = "") -> dict:
    """Writes a built cloud (canonical columns, ord, level, kx, ky, kz). The manifest is returned."""
    facts = built.agg(F.count("*"), F.max("level"), F.bool_or(F.col("red").isNotNull()), F.bool_or(F.col("gps_time").isNotNull())).first()
    fields = fields_for(bool(facts[2]), bool(facts[3]))
    payloads = node_payloads(built, fields, encoding).orderBy("level", "x", "y", "z")
    nodes, at = {}, 0
    store, path = files.open_store(files.join(folder, "octree.bin"))
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        for r in payloads.toLocalIterator(prefetchPartitions=True):
            out.write(bytes(r["payload"]))
            nodes[(r["level"], r["x"], r["y"], r["z"])] = (r["points"], at, len(r["payload"]))
            at += len(r["payload"])
    raw, first = hierarchy_bytes(nodes)
    files.write_all(files.join(folder, "hierarchy.bin"), raw)
    ranges = domains(built, fields, extent[0], extent[1])
    manifest = {
        "version": "2.0", "name": folder.rstrip("/").rsplit("/", 1)[-1], "description": "", "points": facts[0], "projection": crs,
        "hierarchy": {"firstChunkSize": first, "stepSize": STEP, "depth": facts[1] or 0}, "offset": list(offset), "scale": list(scale), "spacing": cube[1] / span,
        "boundingBox": {"min": cube[0], "max": [v + cube[1] for v in cube[0]]}, "encoding": encoding,
        "attributes": [{"name": n, "description": "", "size": width(t, k), "numElements": k, "elementSize": width(t, 1), "type": t, "min": ranges[n][0], "max": ranges[n][1]} for n, t, k in fields],
        "tightBoundingBox": {"min": extent[0], "max": extent[1]},
    }
    files.write_all(files.join(folder, "metadata.json"), json.dumps(manifest).encode())
    return manifest


def manifest_of(folder: str) -> tuple[dict, list[tuple[str, str]]]:
    m = json.loads(files.read_all(files.join(folder, "metadata.json")))
    warned = []
    if not str(m.get("version", "")).startswith("2."):
        raise ValueError("not a Potree v2 cloud")
    if "boundingBox" not in m:
        raise ValueError("the manifest has no boundingBox")
    for a in m.get("attributes", []):
        if a.get("type") in TYPES and a.get("elementSize") not in (None, width(a["type"], 1)):
            warned.append(("element-size-mismatch", a["name"]))
        if a.get("type") in ("int64", "uint64"):
            warned.append(("undecodable-attribute", a["name"]))
    if not any(_is_position(a["name"]) for a in m.get("attributes", [])):
        warned.append(("missing-position-attribute", ""))
    return m, warned


def nodes_of(spark: SparkSession, folder: str) -> DataFrame:
    """(level, x, y, z, point_count, byte_offset, byte_size)."""
    m, _ = manifest_of(folder)
    nodes, _ = read_hierarchy(files.read_all(files.join(folder, "hierarchy.bin")), m["hierarchy"]["firstChunkSize"])
    rows = [(*k, *v) for k, v in nodes.items()]
    return spark.createDataFrame(rows, "level long, x long, y long, z long, point_count long, byte_offset long, byte_size long")


def read_points(spark: SparkSession, folder: str, level: int | None = None) -> DataFrame:
    """Points with their node's key, read by ranges; ``level`` reads no deeper."""
    m, _ = manifest_of(folder)
    fields = [(a["name"], a["type"], a.get("numElements", 1)) for a in m["attributes"]]
    encoding = m.get("encoding", "DEFAULT")
    known = [f for f in fields if f[0] in _COLUMNS]
    types = {"gps-time": "double"}
    schema = "level long, kx long, ky long, kz long, " + ", ".join(f"{c} {types.get(n, 'int')}" for n, _, _ in known for c in _COLUMNS[n])
    path = files.join(folder, "octree.bin")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = r["point_count"]
                columns = decode_node(files.read_range(path, r["byte_offset"], r["byte_size"]), fields, encoding, n)
                arrays = [pa.array(np.full(n, r[c])) for c in ("level", "x", "y", "z")]
                for name, _, k in known:
                    v = columns[name].reshape(n, k)
                    arrays += [pa.array(np.ascontiguousarray(v[:, i]).astype(np.float64 if name == "gps-time" else np.int32)) for i in range(k)]
                yield pa.RecordBatch.from_arrays(arrays, ["level", "kx", "ky", "kz", *(c for n_, _, _ in known for c in _COLUMNS[n_])])

    nodes = nodes_of(spark, folder).filter("byte_size > 0")
    if level is not None:
        nodes = nodes.filter(F.col("level") <= level)
    parts = max(1, spark.sparkContext.defaultParallelism)
    return nodes.repartitionByRange(parts, "byte_offset").sortWithinPartitions("byte_offset").mapInArrow(read, schema)


def optimize(spark: SparkSession, source: str, target: str, encoding: str = "BROTLI", drop: tuple[str, ...] = ()) -> DataFrame:
    """Re-encodes a cloud node by node with the same tree; (nodes, points, bytes before and after, ratio, warnings)."""
    m, warned = manifest_of(source)
    names = [a["name"] for a in m["attributes"]]
    for name in drop:
        if _is_position(name):
            warned.append(("position-kept", name))
        elif name not in names:
            warned.append(("no-such-attribute", name))
    kept = [a for a in m["attributes"] if a["name"] not in drop or _is_position(a["name"])]
    old = [(a["name"], a["type"], a.get("numElements", 1)) for a in m["attributes"]]
    new = [(a["name"], a["type"], a.get("numElements", 1)) for a in kept]
    before, path = m.get("encoding", "DEFAULT"), files.join(source, "octree.bin")

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = []
            for r in b.to_pylist():
                raw = files.read_range(path, r["byte_offset"], r["byte_size"])
                payloads.append(encode_node(decode_node(raw, old, before, r["point_count"]), new, encoding, r["point_count"]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(payloads, pa.binary())], [*b.schema.names, "payload"])

    table = nodes_of(spark, source)
    schema = "level long, x long, y long, z long, point_count long, byte_offset long, byte_size long, payload binary"
    full = table.filter("byte_size > 0").orderBy("byte_offset").mapInArrow(recode, schema)
    # nodes without a payload keep their place
    nodes = {(r.level, r.x, r.y, r.z): (r.point_count, 0, 0) for r in table.filter("byte_size = 0").collect()}
    at = size = points = 0
    store, out_path = files.open_store(files.join(target, "octree.bin"))
    store.create_dir(out_path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(out_path, compression=None) as out:
        for r in full.toLocalIterator(prefetchPartitions=True):
            out.write(bytes(r["payload"]))
            nodes[(r["level"], r["x"], r["y"], r["z"])] = (r["point_count"], at, len(r["payload"]))
            at, size, points = at + len(r["payload"]), size + r["byte_size"], points + r["point_count"]
    raw, first = hierarchy_bytes(nodes, m["hierarchy"].get("stepSize", STEP))
    files.write_all(files.join(target, "hierarchy.bin"), raw)
    changed = m | {"encoding": encoding, "attributes": kept, "hierarchy": m["hierarchy"] | {"firstChunkSize": first}}
    files.write_all(files.join(target, "metadata.json"), json.dumps(changed).encode())
    return spark.createDataFrame([(len(nodes), points, size, at, at / size if size else None, [f"{c}:{p}" for c, p in warned])], "nodes long, points long, bytes_before long, bytes_after long, ratio double, warnings array<string>")
