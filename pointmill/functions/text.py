"""Coordinate system declarations, report formats and other strings as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTHORITY = r'^(?:AUTHORITY\s*\[\s*"EPSG"\s*,\s*"?(\d+)"?\s*\]|ID\s*\[\s*"EPSG"\s*,\s*"?(\d+)"?.*\])$'


def fixed_text(raw: Column) -> Column:
    """Up to the first zero character, without trailing space."""
    return F.rtrim(F.substring_index(raw, "\x00", 1))


def crs_format(raw: Column) -> Column:
    """epsg, wkt, proj4 or unknown; null for an empty declaration."""
    t = F.trim(raw)
    return F.when(t.isNull() | (t == ""), None).when(t.startswith("+"), "proj4").when(t.rlike(r"^(EPSG|epsg):\d+$"), "epsg").when(t.rlike(r"^[A-Z_]+\s*\["), "wkt").otherwise("unknown")


def crs_name(raw: Column) -> Column:
    """The quoted name of a WKT's outermost node."""
    name = F.regexp_extract(F.trim(raw), r'^[A-Z_]+\s*\[\s*"([^"]*)"', 1)
    return F.when((crs_format(raw) == "wkt") & (name != ""), name)


def wkt_epsg(wkt: str | None, nodes: tuple[str, ...]) -> int | None:
    """The EPSG code that is a direct child of the first node of one of the kinds; brackets and quotes are matched.

    Zero is no code; the last direct one counts.
    """
    import re

    if not wkt:
        return None
    starts = [m.start() for m in re.finditer(r"(?<![A-Z_])(?:%s)\s*\[" % "|".join(nodes), _masked(wkt))]
    if not starts:
        return None
    masked = _masked(wkt)
    at = masked.index("[", starts[0])
    depth, start, found = 0, at + 1, None
    for i in range(at, len(wkt)):
        ch = masked[i]
        if ch == "[":
            depth += 1
        if ch == "]" or (ch == "," and depth == 1):
            if ch == "," or depth == 1:
                m = re.match(_AUTHORITY, wkt[start:i].strip(), re.S)
                if m and int(m[1] or m[2]):
                    found = int(m[1] or m[2])
                start = i + 1
            if ch == "]":
                depth -= 1
                if depth == 0:
                    break
    return found


def _masked(wkt: str) -> str:
    """The same length, with the insides of quotes blanked."""
    out, quoted = [], False
    for ch in wkt:
        if ch == '"':
            quoted = not quoted
        out.append(" " if quoted and ch != '"' else ch)
    return "".join(out)


def horizontal_epsg(wkt: str | None) -> int | None:
    found = wkt_epsg(wkt, ("PROJCS", "PROJCRS"))
    has = bool(wkt) and any(k + "[" in _masked(wkt).replace(" ", "") for k in ("PROJCS", "PROJCRS"))
    return found if has else wkt_epsg(wkt, ("GEOGCS", "GEOGCRS"))


def vertical_epsg(wkt: str | None) -> int | None:
    return wkt_epsg(wkt, ("VERT_CS", "VERTCRS"))


def epsg_columns(wkt: Column) -> tuple[Column, Column]:
    """Horizontal and vertical codes of a WKT column: nested brackets are beyond regular expressions, so Arrow batches."""
    @F.pandas_udf("long")
    def horizontal(s: pd.Series) -> pd.Series:
        return s.map(horizontal_epsg).astype("Int64")

    @F.pandas_udf("long")
    def vertical(s: pd.Series) -> pd.Series:
        return s.map(vertical_epsg).astype("Int64")

    return horizontal(wkt), vertical(wkt)


def crs_label(kind: Column, name: Column, epsg: Column) -> Column:
    code = F.concat(F.lit("EPSG:"), epsg.cast("string"))
    return F.coalesce(F.concat(name, F.lit(" ("), code, F.lit(")")), name, code, F.concat(kind, F.lit(" (unresolved)")))


UNITS = ("B", "KiB", "MiB", "GiB", "TiB")


def human_bytes(n: Column) -> Column:
    """Binary units; one decimal below a hundred of a unit, none from there on; halves go to the even digit."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(UNITS[1:], 1):
        v = n / float(1024**power)
        text = F.when(v >= 100, F.format_string("%.0f " + unit, F.bround(v, 0))).otherwise(F.format_string("%.1f " + unit, F.bround(v, 1)))
        out = F.when(n >= 1024**power, text).otherwise(out)
    return out


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def millis(seconds: Column) -> Column:
    ms = seconds * 1000
    return F.when(ms >= 1000, F.format_string("%.1f s", seconds)).when(ms >= 10, F.format_string("%.0f ms", ms)).otherwise(F.format_string("%.1f ms", ms))


def byte_range(header: Column, size: Column) -> Column:
    """A struct (first, last) of a single ``bytes=`` range within a file of ``size`` bytes, else null."""
    a = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1)
    b = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2)
    fits = header.rlike(r"^bytes=\d*-\d*$") & ((a != "") | (b != ""))
    first = F.when(a == "", F.greatest(size - b.try_cast("long"), F.lit(0))).otherwise(a.try_cast("long"))
    last = F.when((a == "") | (b == ""), size - 1).otherwise(F.least(b.try_cast("long"), size - 1))
    return F.when(fits & (first <= last) & (first < size), F.struct(first.alias("first"), last.alias("last")))


# Media types of the files that viewers fetch.
CONTENT_TYPES = {
    "json": "application/json", "bin": "application/octet-stream", "laz": "application/octet-stream", "las": "application/octet-stream", "glb": "model/gltf-binary",
    "gltf": "model/gltf+json", "html": "text/html; charset=utf-8", "js": "text/javascript; charset=utf-8", "css": "text/css; charset=utf-8", "wasm": "application/wasm", "png": "image/png",
}


def content_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit("application/octet-stream")
    for k, v in CONTENT_TYPES.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def template_path(template: Column, level: Column, x: Column, y: Column, z: Column) -> Column:
    """An implicit tile's address from its template."""
    out = template
    for name, value in (("{level}", level), ("{x}", x), ("{y}", y), ("{z}", z)):
        out = F.replace(out, F.lit(name), value.cast("string"))
    return out


def joined_path(base: Column, relative: Column) -> Column:
    """A path relative to the document that names it."""
    folder = F.regexp_extract(base, r"^(.*/)", 1)
    return F.when(relative.rlike(r"^([a-z]+:)?//?"), relative).otherwise(F.concat(folder, F.regexp_replace(relative, r"^\./", "")))
