"""Octree, grid, Morton and bounding-volume arithmetic as column expressions.

Axes are x, y, z. The octree's child index has x as its high bit (4), then y (2), z (1); Morton codes have x as their
low bit. Nothing here is a Python function at run time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Axes = tuple[Column, Column, Column]


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def longest_edge(low: Axes, high: Axes) -> Column:
    return F.greatest(*[h - a for a, h in zip(low, high)])


def center(low: Column, high: Column) -> Column:
    return (low + high) * 0.5


def index_cube(low: Axes, high: Axes) -> tuple[Axes, Column]:
    """The cube at the minimum whose edge is the longest axis, without a margin: its corner and its edge."""
    return low, longest_edge(low, high)


def box_contains(low: Axes, high: Axes, point: Axes) -> Column:
    """Closed on all sides."""
    return reduce(lambda a, b: a & b, [(p >= a) & (p <= h) for a, h, p in zip(low, high, point)])


def box_empty(low: Axes, high: Axes) -> Column:
    return reduce(lambda a, b: a | b, [a > h for a, h in zip(low, high)])


def child_index(center_: Axes, point: Axes) -> Column:
    """4 for x, 2 for y, 1 for z where the point is at or beyond the centre."""
    return sum((F.when(p >= c, bit).otherwise(0) for c, p, bit in zip(center_, point, (4, 2, 1))), F.lit(0))


def child_bounds(low: Column, high: Column, upper: Column) -> tuple[Column, Column]:
    """One axis of a child's box; ``upper`` says which half."""
    mid = center(low, high)
    return F.when(upper, mid).otherwise(low), F.when(upper, high).otherwise(mid)


def key_step(edge: Column, level) -> Column:
    """Edge of a node; levels beyond 31 count as 31."""
    return edge / F.pow(F.lit(2.0), F.least(_c(level), F.lit(31)))


def key_low(low: Column, step: Column, k: Column) -> Column:
    return low + step * k


def child_key(low: Column, step: Column, k: Column, p: Column) -> Column:
    """The key of the child that holds the point, on one axis: the test is against the middle of the node's box."""
    a = key_low(low, step, k)
    return k * 2 + F.when(p >= (a + (a + step)) * 0.5, 1).otherwise(0)


def grid_cell(p: Column, low: Column, size: Column, span: int) -> Column:
    """The cell on one axis; a cell without extent, or a value that is no number, is cell 0."""
    at = F.floor((p - low) / F.when(size > 0, size))
    ok = (size > 0) & (size < float("inf")) & ~F.isnan(p)
    return F.when(ok, F.least(F.greatest(at, F.lit(0)), F.lit(span - 1))).otherwise(0).cast("long")


def linear_cell(cell: Axes, span: int) -> Column:
    x, y, z = cell
    return x + span * (y + span * z)


def hierarchy_name(level: Column, key: Axes) -> Column:
    """``level-x-y-z``."""
    return F.concat_ws("-", *[c.cast("string") for c in (level, *key)])


def parse_hierarchy_name(name: Column) -> Column:
    """A struct (level, x, y, z) from exactly four whole numbers, else null."""
    parts = F.split(name, "-")
    fits = name.rlike(r"^\d+-\d+-\d+-\d+$")
    return F.when(fits, F.struct(*[F.get(parts, F.lit(i)).cast("long").alias(n) for i, n in enumerate(("level", "x", "y", "z"))]))


def digit_name(level: Column, key: Axes) -> Column:
    """``r`` and one octal child index for each level from the top."""
    x, y, z = key

    def digit(i: Column) -> Column:
        at = (level - i).cast("int")
        bit = lambda v: F.pmod(F.floor(v / F.pow(F.lit(2.0), at)), F.lit(2))
        return (bit(x) * 4 + bit(y) * 2 + bit(z)).cast("int").cast("string")

    return F.when(level == 0, F.lit("r")).otherwise(F.concat(F.lit("r"), F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), level.cast("long")), digit), "")))


def digit_name_key(name: Column) -> Column:
    """The inverse of ``digit_name``: a struct (level, x, y, z)."""
    digits = F.transform(F.filter(F.split(F.substring(name, 2, 64), ""), lambda d: d != ""), lambda d: d.cast("long"))
    axis = lambda bit: F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 2 + F.pmod(F.floor(d / bit), F.lit(2)))
    return F.struct(F.size(digits).cast("long").alias("level"), axis(4).alias("x"), axis(2).alias("y"), axis(1).alias("z"))


# ---- Morton codes ---------------------------------------------------------------------------------------------------

#: Shift and mask pairs that spread the low bits of a number to every third place.
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def spread3(v: Column) -> Column:
    """Bit i goes to bit 3 i, for 21 bits."""
    out = v.cast("long")
    for shift, mask in _SPREAD:
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def gather3(v: Column) -> Column:
    """The inverse of ``spread3``."""
    out = v.bitwiseAND(F.lit(_SPREAD[-1][1]))
    for (shift, _), mask in zip(reversed(_SPREAD), [m for _, m in reversed(_SPREAD[:-1])] + [0x1FFFFF]):
        out = out.bitwiseOR(F.shiftright(out, shift)).bitwiseAND(F.lit(mask))
    return out


def morton(x: Column, y: Column, z: Column, bits: int) -> Column:
    """x in the low place of each triple; each axis is cut to ``bits`` bits."""
    cut = F.lit((1 << bits) - 1).cast("long")
    parts = [spread3(v.cast("long").bitwiseAND(cut)) for v in (x, y, z)]
    return parts[0].bitwiseOR(F.shiftleft(parts[1], 1)).bitwiseOR(F.shiftleft(parts[2], 2))


def morton_axes(code: Column) -> Axes:
    return tuple(gather3(F.shiftright(code, i)) for i in range(3))  # type: ignore[return-value]


def _byte(v: Column, k: int) -> Column:
    return F.shiftright(v.cast("long"), 8 * k).bitwiseAND(F.lit(255).cast("long"))


def _joined(low: Column, high: Column) -> tuple[Column, Column]:
    """Two 24-bit codes as a 32-bit word and the rest above it."""
    return low.bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit(255).cast("long")), 24)), F.shiftright(high, 8)


def morton_position(x: Column, y: Column, z: Column) -> dict[str, Column]:
    """A position of three unsigned 32-bit numbers: one 24-bit code for each byte of the axes, packed in four words."""
    a, b, c, d = (morton(*[_byte(v, k) for v in (x, y, z)], bits=8) for k in range(4))
    (mc3, mc2), (mc1, mc0) = _joined(a, b), _joined(c, d)
    return {"mc1": mc1, "mc0": mc0, "mc3": mc3, "mc2": mc2}


def morton_color(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """A colour of three unsigned 16-bit numbers as two words."""
    low, high = (morton(*[_byte(v, k) for v in (r, g, b)], bits=8) for k in range(2))
    mc1, mc0 = _joined(low, high)
    return {"mc1": mc1, "mc0": mc0}


def subtree_axes(code: Column, dimensions: int) -> list[Column]:
    """Morton decoding of an implicit tile: x is bit 0, then y, then z."""
    if dimensions == 3:
        return list(morton_axes(code))
    out = []
    for axis in range(2):
        value = F.lit(0).cast("long")
        for bit in range(16):
            value = value.bitwiseOR(F.shiftleft(F.shiftright(code, 2 * bit + axis).bitwiseAND(F.lit(1).cast("long")), bit))
        out.append(value)
    return out


def availability_offset(level: Column, dimensions: int) -> Column:
    """Tiles before a level in a subtree's bit string."""
    base = 2**dimensions
    return ((F.pow(F.lit(float(base)), level) - 1) / (base - 1)).cast("long")


# ---- volumes --------------------------------------------------------------------------------------------------------


def affine_point(m: Sequence[Column], p: Axes) -> Axes:
    """A column-major 4 by 4 matrix applied to a point."""
    return tuple(m[i] * p[0] + m[4 + i] * p[1] + m[8 + i] * p[2] + m[12 + i] for i in range(3))  # type: ignore[return-value]


def affine_vector(m: Sequence[Column], v: Axes) -> Axes:
    return tuple(m[i] * v[0] + m[4 + i] * v[1] + m[8 + i] * v[2] for i in range(3))  # type: ignore[return-value]


def box_volume(box: Sequence[Column]) -> tuple[Axes, Axes]:
    """An oriented box (centre, three half axes) as low and high corners."""
    half = [F.abs(box[3 + i]) + F.abs(box[6 + i]) + F.abs(box[9 + i]) for i in range(3)]
    return tuple(box[i] - half[i] for i in range(3)), tuple(box[i] + half[i] for i in range(3))  # type: ignore[return-value]


def sphere_radius(radius: Column, m: Sequence[Column]) -> Column:
    """The radius under a transform: the longest column counts."""
    norms = [F.sqrt(m[4 * k] ** 2 + m[4 * k + 1] ** 2 + m[4 * k + 2] ** 2) for k in range(3)]
    return radius * F.greatest(*norms)


# The WGS84 ellipsoid.
WGS84_A = 6378137.0
WGS84_B = 6356752.314245179


def _ecef(lon: Column, lat: Column, height: Column) -> Axes:
    e2 = 1 - (WGS84_B * WGS84_B) / (WGS84_A * WGS84_A)
    n = WGS84_A / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return (n + height) * F.cos(lat) * F.cos(lon), (n + height) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + height) * F.sin(lat)


def region_box(west: Column, south: Column, east: Column, north: Column, low: Column, high: Column) -> tuple[Axes, Axes]:
    """The earth-centred box of a region in radians and metres; east below west crosses the antimeridian.

    x and y are extreme at the region's own longitudes and at multiples of a right angle inside it, and at the latitude
    nearest the equator (farthest for a negative cosine); z at its two latitudes.
    """
    east = F.when(east < west, east + 2 * math.pi).otherwise(east)
    near = F.when((south <= 0) & (north >= 0), F.lit(0.0)).otherwise(F.when(F.abs(south) < F.abs(north), south).otherwise(north))
    far = F.when(F.abs(south) > F.abs(north), south).otherwise(north)
    lons = [west, east] + [F.when((west <= k * math.pi / 2) & (east >= k * math.pi / 2), F.lit(k * math.pi / 2)) for k in range(-2, 7)]
    corners = [_ecef(lon, lat, h) for lon in lons for lat in (near, far) for h in (low, high)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    zs = [_ecef(F.lit(0.0), lat, h)[2] for lat in (south, north) for h in (low, high)]
    return (F.least(*xs), F.least(*ys), F.least(*zs)), (F.greatest(*xs), F.greatest(*ys), F.greatest(*zs))


def looks_ecef(x: Column, y: Column, z: Column) -> Column:
    """Within 100 km of the ellipsoid's surface at the point's geocentric latitude."""
    r = F.sqrt(x * x + y * y + z * z)
    s = F.try_divide(z, r)
    surface = WGS84_A * WGS84_B / F.sqrt((WGS84_B * WGS84_B) * (1 - s * s) + (WGS84_A * WGS84_A) * (s * s))
    return F.coalesce(F.abs(r - surface) <= 100_000.0, F.lit(False))


# ---- projection to an image -----------------------------------------------------------------------------------------


def view_axes(azimuth: float, elevation: float) -> tuple[tuple[float, float, float], ...]:
    """Right, up and depth directions of an orthographic view, in degrees."""
    a, e = math.radians(azimuth), math.radians(elevation)
    right = (-math.sin(a), math.cos(a), 0.0)
    up = (-math.sin(e) * math.cos(a), -math.sin(e) * math.sin(a), math.cos(e))
    depth = (math.cos(e) * math.cos(a), math.cos(e) * math.sin(a), math.sin(e))
    return right, up, depth


def project(p: Axes, axis: tuple[float, float, float]) -> Column:
    return p[0] * axis[0] + p[1] * axis[1] + p[2] * axis[2]


# Low, middle and high colours of the elevation ramp.
RAMP = ((45, 50, 110), (55, 180, 140), (242, 220, 90))


def elevation_ramp(share: Column) -> Axes:
    """Colour of a height share between 0 and 1: two straight runs, cut to whole bytes."""
    t = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))

    def channel(i: int) -> Column:
        a, b, c = (float(stop[i]) for stop in RAMP)
        return F.floor(F.when(t < 0.5, a + (b - a) * (t * 2)).otherwise(b + (c - b) * (t * 2 - 1))).cast("int")

    return channel(0), channel(1), channel(2)
