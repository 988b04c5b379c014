"""3D Tiles: one binary glTF of points per node and a tree of tiles; explicit and implicit tilesets are read.

Tiles are placed relative to their parent, so transforms composed down the tree give each tile's own centre.
"""

from __future__ import annotations

import json
import struct
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.functions.geometry import WGS84_A, WGS84_B

from . import files
from .potree import Key, parent_of, with_ancestors

MAX_DEPTH = 8


def glb(document: dict, data: bytes) -> bytes:
    """A binary glTF: JSON padded with spaces, data with zeros."""
    text = json.dumps(document, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    data += b"\0" * (-len(data) % 4)
    body = struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(data), b"BIN\0") + data
    return struct.pack("<4sII", b"glTF", 2, 12 + len(body)) + body


def parse_glb(raw: bytes) -> tuple[dict, bytes]:
    magic, version, size = struct.unpack_from("<4sII", raw, 0)
    if magic != b"glTF" or version != 2 or size != len(raw):
        raise ValueError("not a binary glTF")
    n = struct.unpack_from("<I", raw, 12)[0]
    return json.loads(raw[20 : 20 + n]), raw[28 + n :]


def node_glb(p: np.ndarray, rgb: np.ndarray | None) -> bytes:
    """Points relative to their node's centre; the y axis of a glTF is up, so (x, y, z) is stored as (x, z, -y)."""
    up = np.stack([p[:, 0], p[:, 2], -p[:, 1]], axis=1).astype("<f4")
    data = up.tobytes()
    views = [{"buffer": 0, "byteOffset": 0, "byteLength": len(data)}]
    accessors = [{"bufferView": 0, "componentType": 5126, "count": len(p), "type": "VEC3", "min": up.min(axis=0).tolist(), "max": up.max(axis=0).tolist()}]
    attributes = {"POSITION": 0}
    if rgb is not None:
        four = np.concatenate((rgb >> 8, np.full((len(p), 1), 255)), axis=1).astype("u1")
        views.append({"buffer": 0, "byteOffset": len(data), "byteLength": four.size})
        accessors.append({"bufferView": 1, "componentType": 5121, "normalized": True, "count": len(p), "type": "VEC4"})
        attributes["COLOR_0"] = 1
        data += four.tobytes()
    return glb(
        {"asset": {"version": "2.0", "generator": "pointmill"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": attributes, "mode": 0}]}], "buffers": [{"byteLength": len(data)}], "bufferViews": views, "accessors": accessors},
        data,
    )


def node_points(raw: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Relative positions and colours of ``node_glb``."""
    doc, data = parse_glb(raw)
    a = doc["meshes"][0]["primitives"][0]["attributes"]

    def view(i: int, dtype: str, k: int) -> np.ndarray:
        acc = doc["accessors"][i]
        return np.frombuffer(data, dtype, acc["count"] * k, doc["bufferViews"][acc["bufferView"]]["byteOffset"]).reshape(-1, k)

    p = view(a["POSITION"], "<f4", 3)
    return np.stack([p[:, 0], -p[:, 2], p[:, 1]], axis=1), view(a["COLOR_0"], "u1", 4) if "COLOR_0" in a else None


def center_of(key: Key, low: list[float], edge: float) -> list[float]:
    step = edge / 2 ** min(key[0], 31)
    return [a + step * k + step / 2 for a, k in zip(low, key[1:])]


def write(built: DataFrame, folder: str, cube: tuple[list[float], float], span: int) -> dict:
    """Writes a built cloud (px, py, pz, red, green, blue, ord and its key): a file per node by the tasks, the tree here."""
    low, edge = cube
    colour = bool(built.agg(F.bool_or(F.col("red").isNotNull())).first()[0])

    def one(key, t):
        t = t.sort_by("ord")
        k = tuple(v.as_py() for v in key)
        p = np.stack([np.asarray(t.column(f"p{a}")) for a in "xyz"], axis=1) - center_of(k, low, edge)
        rgb = np.stack([np.asarray(t.column(c).fill_null(65535).combine_chunks()) for c in ("red", "green", "blue")], axis=1) if colour else None
        files.write_all(files.join(folder, f"tiles/{'-'.join(map(str, k))}.glb"), node_glb(p, rgb))
        return pa.table({**{c: pa.array([v], pa.int64()) for c, v in zip(("level", "x", "y", "z"), k)}, "points": pa.array([t.num_rows], pa.int64())})

    rows = built.select("level", "kx", "ky", "kz", "ord", "px", "py", "pz", "red", "green", "blue").groupBy("level", "kx", "ky", "kz").applyInArrow(one, "level long, x long, y long, z long, points long")
    counts = {(r.level, r.x, r.y, r.z): r.points for r in rows.toLocalIterator()}
    document = tileset(counts, low, edge, span)
    files.write_all(files.join(folder, "tileset.json"), json.dumps(document).encode())
    return document


def tileset(counts: dict[Key, int], low: list[float], edge: float, span: int) -> dict:
    """The tree; an inner tile's error is its level's spacing, a leaf's none; ancestors without points have no content."""
    keys = with_ancestors(counts) or {(0, 0, 0, 0)}
    kids: dict[Key, list[Key]] = {}
    for k in sorted(keys):
        if k[0]:
            kids.setdefault(parent_of(k), []).append(k)
    made: dict[Key, dict] = {}
    for k in sorted(keys, reverse=True):
        half = edge / 2 ** (k[0] + 1)
        above = center_of(parent_of(k), low, edge) if k[0] else [0.0] * 3
        move = [c - a for c, a in zip(center_of(k, low, edge), above)]
        tile = {
            "boundingVolume": {"box": [0, 0, 0, half, 0, 0, 0, half, 0, 0, 0, half]},
            "geometricError": edge / span / 2 ** k[0] if k in kids else 0,
            "refine": "ADD",
            "transform": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, *move, 1],
        }
        if counts.get(k):
            tile["content"] = {"uri": f"tiles/{'-'.join(map(str, k))}.glb"}
        if k in kids:
            tile["children"] = [made.pop(c) for c in kids[k]]
        made[k] = tile
    return {"asset": {"version": "1.1", "generator": "pointmill"}, "geometricError": 2 * edge / span, "root": made[(0, 0, 0, 0)]}


IDENTITY = np.eye(4)
#: Kinds of content by the extension of its name.
KINDS = {"pnts": "pnts", "glb": "gltf", "gltf": "gltf", "json": "tileset", "b3dm": "mesh", "i3dm": "mesh", "cmpt": "mesh"}


def content_kind(uri: str) -> str:
    name = uri.split("?")[0].split("#")[0].rsplit("/", 1)[-1]
    return KINDS.get(name.rpartition(".")[2].lower(), "unknown") if "." in name else "unknown"


def volume_box(volume: dict, m: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Low and high corner of a bounding volume under a transform; a region is on the ellipsoid whatever the transform."""
    if len(b := volume.get("box", ())) >= 12:
        center, axes = (m @ [*b[:3], 1.0])[:3], m[:3, :3] @ np.array(b[3:12], float).reshape(3, 3).T
        half = np.abs(axes).sum(axis=1)
        return center - half, center + half
    if len(s := volume.get("sphere", ())) >= 4:
        center, radius = (m @ [*s[:3], 1.0])[:3], s[3] * np.linalg.norm(m[:3, :3], axis=0).max()
        return center - radius, center + radius
    if len(r := volume.get("region", ())) >= 6:
        west, south, east, north, *heights = map(float, r[:6])
        east += 2 * np.pi if east < west else 0.0
        quarters = np.arange(-4, 9) * np.pi / 2
        lons = np.concatenate(([west, east], quarters[(quarters >= west) & (quarters <= east)]))
        lats = np.array([south, north, *([0.0] if south <= 0 <= north else [])])
        lon, lat, h = (x.ravel() for x in np.meshgrid(lons, lats, heights))
        squeeze = (WGS84_B / WGS84_A) ** 2
        n = WGS84_A / np.sqrt(1 - (1 - squeeze) * np.sin(lat) ** 2)
        p = np.stack([(n + h) * np.cos(lat) * np.cos(lon), (n + h) * np.cos(lat) * np.sin(lon), (n * squeeze + h) * np.sin(lat)], axis=1)
        return p.min(axis=0), p.max(axis=0)
    return None


def _matrix(tile: dict) -> np.ndarray:
    return np.array(tile["transform"], float).reshape(4, 4).T if "transform" in tile else IDENTITY


def walk(folder: str, name: str = "tileset.json") -> tuple[list[tuple], list[tuple[str, str]]]:
    """(depth, uri, x, y, z of the composed centre, geometric error, corners, kind of content) of every tile, external tilesets and implicit
    subtrees included; and warnings. A document met twice is not walked again."""
    rows, warned, seen = [], [], set()

    def document(name: str, depth: int, matrix: np.ndarray) -> None:
        if name in seen:
            return
        seen.add(name)
        if depth > MAX_DEPTH:
            warned.append(("external-tileset-depth", name))
            return
        try:
            doc = json.loads(files.read_all(files.join(folder, name)))
        except FileNotFoundError:
            warned.append(("external-tileset-missing", name))
            return
        if doc.get("asset", {}).get("version") not in ("1.0", "1.1"):
            warned.append(("tileset-version-unknown", name))
        base = name.rsplit("/", 1)[0] + "/" if "/" in name else ""
        queue = deque([(doc["root"], 0, matrix @ _matrix(doc["root"]))])
        while queue:
            tile, level, m = queue.popleft()
            uri = (tile.get("content") or {}).get("uri") or (tile.get("content") or {}).get("url")
            box = volume_box(tile.get("boundingVolume", {}), m)
            center = np.zeros(3) if box is None else (box[0] + box[1]) / 2
            rows.append((level, uri and base + uri, *map(float, center), float(tile.get("geometricError", 0)), *([None] * 2 if box is None else (c.tolist() for c in box)), uri and content_kind(uri)))
            if uri and uri.endswith(".json"):
                document(base + uri, depth + 1, m)
            if "implicitTiling" in tile:
                found, more = implicit_tiles(folder, base, tile["implicitTiling"])
                rows.extend((level + key[0], base + _fill(uri or "", key), 0.0, 0.0, 0.0, float(tile.get("geometricError", 0)) / 2 ** key[0], None, None, content_kind(uri or "")) for key in found)
                warned.extend(more)
            for child in tile.get("children", ()):
                queue.append((child, level + 1, m @ _matrix(child)))

    document(name, 0, IDENTITY)
    warned.append(("point-count-unknown", name))
    return rows, warned


def _fill(template: str, key: tuple[int, ...]) -> str:
    for mark, v in zip(("{level}", "{x}", "{y}", "{z}"), key):
        template = template.replace(mark, str(v))
    return template


def read_subtree(raw: bytes) -> tuple[dict, bytes]:
    magic, version, n_json, n_bin = struct.unpack_from("<4sIQQ", raw, 0)
    if magic != b"subt" or version != 1:
        raise ValueError("not a subtree")
    return json.loads(raw[24 : 24 + n_json]), raw[24 + n_json : 24 + n_json + n_bin]


def available(document: dict, data: bytes, what: dict, n: int) -> np.ndarray:
    """The bits of an availability, least first, or its constant."""
    if "constant" in what:
        return np.full(n, bool(what["constant"]))
    view = document["bufferViews"][what.get("bitstream", what.get("bufferView"))]
    if document["buffers"][view["buffer"]].get("uri"):
        raise ValueError("a buffer outside the subtree")
    start = view.get("byteOffset", 0)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, view["byteLength"], start), bitorder="little")
    return bits[:n].astype(bool)


def implicit_tiles(folder: str, base: str, tiling: dict) -> tuple[list[tuple[int, ...]], list[tuple[str, str]]]:
    """Keys of the available tiles of all subtrees: x is the low bit of a tile's code."""
    dims = 3 if tiling["subdivisionScheme"] == "OCTREE" else 2
    per, levels, out, warned = tiling["subtreeLevels"], tiling.get("availableLevels", 64), [], []
    queue = deque([(0, *[0] * dims)])
    while queue:
        root = queue.popleft()
        name = base + _fill(tiling["subtrees"]["uri"], root)
        try:
            doc, data = read_subtree(files.read_all(files.join(folder, name)))
        except FileNotFoundError:
            warned.append(("subtree-missing", name))
            continue
        except ValueError:
            warned.append(("subtree-unreadable", name))
            continue
        total = ((2**dims) ** per - 1) // (2**dims - 1)
        tiles = available(doc, data, doc["tileAvailability"], total)
        first = 0
        for level in range(per):
            n = (2**dims) ** level
            if root[0] + level < levels:
                for code in np.flatnonzero(tiles[first : first + n]).tolist():
                    out.append(_child(root, level, code, dims))
            first += n
        for code in np.flatnonzero(available(doc, data, doc["childSubtreeAvailability"], (2**dims) ** per)).tolist():
            if root[0] + per < levels:
                queue.append(_child(root, per, code, dims))
    return out, warned


def _child(root: tuple[int, ...], level: int, code: int, dims: int) -> tuple[int, ...]:
    axes = [sum((code >> (dims * b + a) & 1) << b for b in range(level)) for a in range(dims)]
    return (root[0] + level, *((r << level) + a for r, a in zip(root[1:], axes)))


def tiles_of(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = walk(folder)
    return spark.createDataFrame(rows, "depth int, uri string, x double, y double, z double, geometric_error double, low array<double>, high array<double>, kind string")
