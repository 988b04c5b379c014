"""Entwine point tiles: ``ept.json``, a JSON hierarchy in pages, and one binary file per node.

Node files are written and read by tasks, so a cloud's size is bounded by no single process.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.functions import geometry as g

from . import files
from .potree import Key, with_ancestors

PAGE_ENTRIES = 512
# Dimensions of a binary record in its order: name, JSON type, bytes, numpy type, column.
DIMENSIONS = (
    ("X", "signed", 4, "<i4", "x"), ("Y", "signed", 4, "<i4", "y"), ("Z", "signed", 4, "<i4", "z"), ("Intensity", "unsigned", 2, "<u2", "intensity"), ("ReturnNumber", "unsigned", 1, "u1", "return_number"),
    ("NumberOfReturns", "unsigned", 1, "u1", "number_of_returns"), ("Classification", "unsigned", 1, "u1", "classification"), ("ScanAngleRank", "signed", 2, "<i2", "scan_angle"),
    ("UserData", "unsigned", 1, "u1", "user_data"), ("PointSourceId", "unsigned", 2, "<u2", "point_source_id"), ("GpsTime", "float", 8, "<f8", "gps_time"),
    ("Red", "unsigned", 2, "<u2", "red"), ("Green", "unsigned", 2, "<u2", "green"), ("Blue", "unsigned", 2, "<u2", "blue"),
)
_FILL = {"red": 65535, "green": 65535, "blue": 65535}
_NUMPY = {("signed", 1): "i1", ("signed", 2): "<i2", ("signed", 4): "<i4", ("signed", 8): "<i8", ("unsigned", 1): "u1", ("unsigned", 2): "<u2", ("unsigned", 4): "<u4", ("unsigned", 8): "<u8", ("float", 4): "<f4", ("float", 8): "<f8"}


def name_of(key: Key) -> str:
    return "-".join(map(str, key))


def key_of(name: str) -> Key | None:
    parts = name.split("-")
    return tuple(map(int, parts)) if len(parts) == 4 and all(p.isdigit() for p in parts) else None  # type: ignore[return-value]


def hierarchy_pages(counts: dict[Key, int], entries: int = PAGE_ENTRIES) -> dict[str, dict[str, int]]:
    """Pages by their root's name: nodes in breadth-first order; what does not fit is named with -1 and has its own page."""
    keys = with_ancestors(counts) or {(0, 0, 0, 0)}
    kids: dict[Key, list[Key]] = {}
    for k in sorted(keys):
        if k[0]:
            kids.setdefault((k[0] - 1, k[1] >> 1, k[2] >> 1, k[3] >> 1), []).append(k)
    pages, roots = {}, deque([(0, 0, 0, 0)])
    while roots:
        root = roots.popleft()
        page, queue = {}, deque([root])
        while queue:
            k = queue.popleft()
            if len(page) >= entries and k != root:
                page[name_of(k)] = -1
                roots.append(k)
                continue
            page[name_of(k)] = counts.get(k, 0)
            queue.extend(kids.get(k, ()))
        pages[name_of(root)] = page
    return pages


def srs_of(crs: str | None) -> dict:
    """``EPSG:n`` as authority and code, other text as WKT."""
    authority, _, code = (crs or "").partition(":")
    if authority.isalpha() and code.isdigit():
        return {"authority": authority.upper(), "horizontal": code}
    return {"wkt": crs} if crs else {}


def dimensions_for(colour: bool, gps: bool):
    return [d for d in DIMENSIONS if (d[4] not in _FILL or colour) and (d[4] != "gps_time" or gps)]


def write(built: DataFrame, folder: str, scale, offset, cube: tuple[list[float], float], extent: tuple[list[float], list[float]], span: int, wkt: str | None = None, encoding: str = "binary") -> dict:
    """Writes a built cloud; ``encoding`` is ``binary`` or ``zstandard``."""
    facts = built.agg(F.bool_or(F.col("red").isNotNull()), F.bool_or(F.col("gps_time").isNotNull())).first()
    dims = dimensions_for(bool(facts[0]), bool(facts[1]))
    dtype = np.dtype([(d[0], d[3]) for d in dims])
    end = "bin" if encoding == "binary" else "zst"

    def one(key, t):
        t = t.sort_by("ord")
        out = np.zeros(t.num_rows, dtype)
        for d in dims:
            out[d[0]] = np.asarray(t.column(d[4]).fill_null(_FILL.get(d[4], 0)).combine_chunks())
        raw = out.tobytes()
        if end == "zst":
            raw = pa.Codec("zstd").compress(raw, asbytes=True)
        values = [k.as_py() for k in key]
        files.write_all(files.join(folder, f"ept-data/{'-'.join(map(str, values))}.{end}"), raw)
        return pa.table({**{c: pa.array([v], pa.int64()) for c, v in zip(("level", "x", "y", "z"), values)}, "points": pa.array([t.num_rows], pa.int64())})

    keyed = built.select("level", "kx", "ky", "kz", "ord", *(d[4] for d in dims))
    written = keyed.groupBy("level", "kx", "ky", "kz").applyInArrow(one, "level long, x long, y long, z long, points long")
    counts = {(r.level, r.x, r.y, r.z): r.points for r in written.toLocalIterator()}
    for root, page in hierarchy_pages(counts).items():
        files.write_all(files.join(folder, f"ept-hierarchy/{root}.json"), json.dumps(page).encode())
    at = {"X": 0, "Y": 1, "Z": 2}
    schema = [{"name": n, "type": t, "size": s} | ({"scale": scale[at[n]], "offset": offset[at[n]]} if n in at else {}) for n, t, s, _, _ in dims]
    manifest = {
        "version": "1.0.0", "bounds": [*cube[0], *(v + cube[1] for v in cube[0])], "boundsConforming": [*extent[0], *extent[1]], "dataType": encoding, "hierarchyType": "json",
        "points": sum(counts.values()), "span": span, "srs": srs_of(wkt), "schema": schema,
    }
    files.write_all(files.join(folder, "ept.json"), json.dumps(manifest).encode())
    return manifest


def manifest_of(folder: str) -> dict:
    m = json.loads(files.read_all(files.join(folder, "ept.json")))
    for need in ("bounds", "schema"):
        if need not in m:
            raise ValueError(f"ept.json has no {need}")
    return m


def crs_of(manifest: dict) -> str | None:
    srs = manifest.get("srs") or {}
    if srs.get("wkt"):
        return srs["wkt"]
    if srs.get("authority") and srs.get("horizontal"):
        return f"{srs['authority']}:{srs['horizontal']}"
    return None


def warnings_of(folder: str) -> tuple[list[tuple[str, str]], int]:
    """Warnings of the manifest and the hierarchy, and the number of pages read."""
    kind = manifest_of(folder).get("hierarchyType", "json")
    out, pages, reads = [("hierarchy-type", kind)] if kind != "json" else [], deque(["0-0-0-0"]), 0
    while pages:
        reads += 1
        for name, n in json.loads(files.read_all(files.join(folder, f"ept-hierarchy/{pages.popleft()}.json"))).items():
            if key_of(name) is None:
                out.append(("hierarchy-key", name))
            elif n == -1:
                pages.append(name)
    return out, reads


def nodes_of(spark: SparkSession, folder: str) -> DataFrame:
    """(level, x, y, z, point_count): each round reads the pages that the last one named, as rows."""
    out, pages = None, ["0-0-0-0"]
    while pages:
        raw = spark.createDataFrame([(files.read_all(files.join(folder, f"ept-hierarchy/{p}.json")).decode(),) for p in pages], "page string")
        entries = raw.select(F.explode(F.from_json("page", "map<string,long>")).alias("name", "n")).withColumn("k", g.parse_hierarchy_name(F.col("name"))).filter("k IS NOT NULL")
        found = entries.filter("n >= 0").select("k.*", F.col("n").alias("point_count"))
        out = found if out is None else out.unionByName(found)
        pages = [r.name for r in entries.filter("n = -1").select("name").collect()]
    return out


def read_points(spark: SparkSession, folder: str, level: int | None = None) -> DataFrame:
    """Points with their node's key. Binary and zstandard nodes are read; laszip ones are refused."""
    m = manifest_of(folder)
    if m.get("dataType") not in ("binary", "zstandard"):
        raise ValueError(f"{m.get('dataType')} nodes are not supported")
    end = "bin" if m["dataType"] == "binary" else "zst"
    column = {d[0]: d[4] for d in DIMENSIONS}
    dtype = np.dtype([(s["name"], _NUMPY[(s["type"], s["size"])]) for s in m["schema"]])
    known = [s["name"] for s in m["schema"] if s["name"] in column]
    schema = "level long, kx long, ky long, kz long, " + ", ".join(f"{column[n]} {'double' if n == 'GpsTime' else 'int'}" for n in known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                raw = files.read_all(files.join(folder, f"ept-data/{r['level']}-{r['x']}-{r['y']}-{r['z']}.{end}"))
                n = r["point_count"]
                t = np.frombuffer(pa.Codec("zstd").decompress(raw, n * dtype.itemsize, asbytes=True) if end == "zst" else raw, dtype)
                arrays = [pa.array(np.full(n, r[c])) for c in ("level", "x", "y", "z")]
                arrays += [pa.array(np.ascontiguousarray(t[c]).astype(np.float64 if c == "GpsTime" else np.int32)) for c in known]
                yield pa.RecordBatch.from_arrays(arrays, ["level", "kx", "ky", "kz", *(column[c] for c in known)])

    nodes = nodes_of(spark, folder).filter("point_count > 0")
    if level is not None:
        nodes = nodes.filter(F.col("level") <= level)
    return nodes.repartition(max(1, spark.sparkContext.defaultParallelism), "level", "x", "y", "z").mapInArrow(read, schema)
