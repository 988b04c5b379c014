"""Quantized records: positions, packed legacy fields, and the rules that widen one record kind to another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

I32_MIN, I32_MAX = -(2**31), 2**31 - 1


def round_half_away(v: Column) -> Column:
    """To the nearest whole number, halves away from zero, without decimal arithmetic."""
    size = F.abs(v)
    whole = F.floor(size)
    return F.signum(v) * (whole + F.when(size - whole >= 0.5, 1).otherwise(0))


def quantize(v: Column, scale: Column, offset: Column) -> Column:
    """Clamped before it is rounded, as whole numbers beyond 64 bits are an error."""
    steps = F.least(F.greatest((v - offset) / scale, F.lit(float(I32_MIN))), F.lit(float(I32_MAX)))
    return F.when(v.isNotNull(), round_half_away(steps).cast("int"))


def dequantize(q: Column, scale: Column, offset: Column) -> Column:
    return q * scale + offset


def bits(byte: Column, shift: int, width: int) -> Column:
    return F.shiftright(byte, shift).bitwiseAND(F.lit((1 << width) - 1))


def legacy_returns(byte: Column) -> Column:
    """Three bits of return number and three of returns as two nibbles."""
    return bits(byte, 0, 3) + 16 * bits(byte, 3, 3)


def legacy_classification(class_byte: Column) -> Column:
    return class_byte.bitwiseAND(F.lit(31))


def legacy_flags(class_byte: Column, returns_byte: Column) -> Column:
    """Three class flags, scan direction and edge of flight line."""
    return bits(class_byte, 5, 3) + 64 * bits(returns_byte, 6, 1) + 128 * bits(returns_byte, 7, 1)


def scan_angle_steps(rank: Column) -> Column:
    """Whole degrees as steps of 0.006 degrees."""
    return round_half_away(rank / F.lit(0.006)).cast("int")


def scan_angle_rank(steps: Column) -> tuple[Column, Column]:
    """Steps of 0.006 degrees as whole degrees in a signed byte, and whether the byte cut it."""
    degrees = round_half_away(steps * F.lit(0.006))
    cut = F.least(F.greatest(degrees, F.lit(-128.0)), F.lit(127.0))
    return cut.cast("int"), degrees != cut


def widen_channel(share: Column) -> Column:
    """A share of 0 to 1 as 16 bits; null stays null, which greatest and least would pass over."""
    return F.when(share.isNotNull(), round_half_away(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 65535).cast("int"))


def fill_colour(c: Column) -> Column:
    """White where a source has no colour."""
    return F.coalesce(c, F.lit(65535))


def output_format(colour: Column, nir: Column) -> Column:
    return F.when(nir, 8).when(colour, 7).otherwise(6)


def smallest_format(colour: Column, gps: Column, legacy: Column) -> Column:
    """The narrowest point format that holds what is there."""
    old = F.when(colour & gps, 3).when(colour, 2).when(gps, 1).otherwise(0)
    return F.when(legacy, old).otherwise(F.when(colour, 7).otherwise(6))


def source_id(scan: Column) -> Column:
    """One-based scan number, at most 65535."""
    return F.least(scan + 1, F.lit(65535))


def quantum(scale: Column, size: Column) -> tuple[Column, Column]:
    """A usable quantum for an extent, and whether it had to be coarsened to fit 32 bits."""
    plain = F.when((scale > 0) & (scale < float("inf")) & ~F.isnan(scale), scale).otherwise(0.001)
    over = size / plain > float(I32_MAX)
    return F.when(over, size / (I32_MAX * 0.9)).otherwise(plain), over


def spherical(r: Column, azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    return r * F.cos(elevation) * F.cos(azimuth), r * F.cos(elevation) * F.sin(azimuth), r * F.sin(elevation)


def posed(p: tuple[Column, Column, Column], q: tuple[Column, Column, Column, Column], t: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """A unit quaternion's rotation (w, x, y, z) as its matrix, then a translation."""
    w, x, y, z = q
    m = (
        (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )
    return tuple(a * p[0] + b * p[1] + c * p[2] + d for (a, b, c), d in zip(m, t))  # type: ignore[return-value]


def rotated(q: tuple[Column, Column, Column, Column]) -> Column:
    """Whether a quaternion differs from no rotation by more than 1e-9."""
    w, x, y, z = q
    return (F.abs(w - 1) > 1e-9) | (F.abs(x) > 1e-9) | (F.abs(y) > 1e-9) | (F.abs(z) > 1e-9)


def prototype_bits(low: Column, high: Column) -> Column:
    """Bits of a whole-number field: none where it has one value."""
    return F.when(high > low, F.length(F.bin(high - low))).otherwise(0)
