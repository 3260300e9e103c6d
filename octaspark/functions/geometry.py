"""Column builders for grids, Morton codes, colours and cameras. No UDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def grid_index(c: Column, bits: int) -> Column:
    """Cell of a coordinate in [0, 1] on a grid of 2**bits cells; the upper face is in the last."""
    n = 1 << bits
    return clamp(F.floor(c * F.lit(float(n))), 0, n - 1).cast("long")


def linear_cell(ix: Column, iy: Column, iz: Column, n: int) -> Column:
    return ix + F.lit(n) * iy + F.lit(n * n) * iz


def linear_cell_inverse(cell: Column, n: int) -> tuple[Column, Column, Column]:
    return cell % n, F.floor(cell / n).cast("long") % n, F.floor(cell / (n * n)).cast("long")


def _spread_bits(i: int) -> int:
    return sum(((i >> k) & 1) << 3 * k for k in range(7))


_SPREAD7 = "array(" + ", ".join(f"{_spread_bits(i)}L" for i in range(128)) + ")"


def spread3(c: Column) -> Column:
    """Bit i of a number below 2**21 moves to bit 3 i: seven bits at a time by a lookup.

    The lookup keeps the expression small; shifting and masking would repeat it 32 times.
    """
    table = F.expr(_SPREAD7)
    part = lambda k: F.shiftleft(F.get(table, F.shiftright(c, 7 * k).bitwiseAND(F.lit(127)).cast("int")), 21 * k)
    return part(0).bitwiseOR(part(1)).bitwiseOR(part(2))


def morton(ix: Column, iy: Column, iz: Column, order: str = "xyz") -> Column:
    """63-bit Morton code; the first axis in ``order`` is the most significant."""
    by = dict(zip(AXES, (ix, iy, iz)))
    a, b, c = (spread3(by[k].cast("long")) for k in order)
    return F.shiftleft(a, 2).bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(c)


def _gather(c: Column, bits: int, stride: int, offset: int) -> Column:
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(c, stride * i + offset).bitwiseAND(F.lit(1)), i))
    return out


_THIRDS = "array(" + ", ".join(f"{(i & 1) | (i >> 3 & 1) << 1 | (i >> 6 & 1) << 2}L" for i in range(512)) + ")"


def _thirds(code: Column, bits: int, offset: int) -> Column:
    """Every third bit from ``offset`` on, ``bits`` of them: three at a time by a lookup, which keeps the expression small."""
    table, out = F.expr(_THIRDS), F.lit(0).cast("long")
    for k in range(0, bits, 3):
        mask = (1 << 3 * min(3, bits - k)) - 1
        out = out.bitwiseOR(F.shiftleft(F.get(table, F.shiftright(code, 3 * k + offset).bitwiseAND(F.lit(mask)).cast("int")), k))
    return out


def morton_inverse(code: Column, bits: int) -> tuple[Column, Column, Column]:
    """(ix, iy, iz) of a code whose most significant axis is x."""
    return tuple(_thirds(code, bits, k) for k in (2, 1, 0))  # type: ignore[return-value]


def morton2_inverse(rank: Column, bits: int) -> tuple[Column, Column]:
    """Pixel of a rank along a 2-D Morton curve; px takes the even bits."""
    return _gather(rank, bits, 2, 0), _gather(rank, bits, 2, 1)


def octant(key: Column, up: int = 0) -> Column:
    """Child digit (x most significant) of a node key, ``up`` levels above."""
    return F.shiftright(key, 3 * up).bitwiseAND(F.lit(7))


def node_name(level: Column, key: Column) -> Column:
    """'r' and one octant digit per level from the root down."""
    return F.concat(F.lit("r"), F.when(level > 0, F.lpad(F.conv(key.cast("string"), 10, 8), level.cast("int"), "0")).otherwise(F.lit("")))


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return r.cast("long").bitwiseOR(F.shiftleft(g.cast("long"), 8)).bitwiseOR(F.shiftleft(b.cast("long"), 16))


def unpack_rgb(c: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(c, s).bitwiseAND(F.lit(255)).cast("int") for s in (0, 8, 16))  # type: ignore[return-value]


def colour_to_8bit(c: Column) -> Column:
    """16-bit channels come down by 256; values that fit a byte stay."""
    return F.when(c > 255, F.floor(c / 256)).otherwise(c).cast("int")


def bit_length(c: Column) -> Column:
    """Bits of a non-negative integer; 0 for 0."""
    return F.when(c == 0, F.lit(0)).otherwise(F.length(F.bin(c))).cast("int")


def dot4(row: Sequence[float], x: Column, y: Column, z: Column) -> Column:
    return F.lit(float(row[0])) * x + F.lit(float(row[1])) * y + F.lit(float(row[2])) * z + F.lit(float(row[3]))


def project(matrix: Sequence[Sequence[float]], x: Column, y: Column, z: Column, width: int, height: int) -> dict[str, Column]:
    """Clip-space depth w, normalised coordinates and the pixel of a point."""
    w = dot4(matrix[3], x, y, z)
    nx, ny = dot4(matrix[0], x, y, z) / w, dot4(matrix[1], x, y, z) / w
    return {
        "w": w,
        "nx": nx,
        "ny": ny,
        "px": clamp(F.floor((nx * F.lit(0.5) + F.lit(0.5)) * F.lit(float(width))), 0, width - 1).cast("int"),
        "py": clamp(F.floor((ny * F.lit(0.5) + F.lit(0.5)) * F.lit(float(height))), 0, height - 1).cast("int"),
    }


def frustum_planes(matrix: Sequence[Sequence[float]]) -> list[tuple[float, float, float, float]]:
    """Six inward planes (nx, ny, nz, d) with unit normals, from a view-projection matrix."""
    rows = [[float(v) for v in r] for r in matrix]
    planes = []
    for axis in range(3):
        for sign in (1, -1):
            p = [rows[3][k] + sign * rows[axis][k] for k in range(4)]
            n = sum(v * v for v in p[:3]) ** 0.5
            planes.append(tuple(v / n for v in p))
    return planes  # type: ignore[return-value]


def box_in_frustum(planes, low: Sequence[Column], high: Sequence[Column]) -> Column:
    """True unless the box lies wholly outside one plane (its farthest corner is tested)."""
    ok = F.lit(True)
    for nx, ny, nz, d in planes:
        corner = [high[k] if n >= 0 else low[k] for k, n in enumerate((nx, ny, nz))]
        ok = ok & (F.lit(nx) * corner[0] + F.lit(ny) * corner[1] + F.lit(nz) * corner[2] + F.lit(d) >= 0)
    return ok


def point_in_frustum(planes, x: Column, y: Column, z: Column) -> Column:
    return box_in_frustum(planes, (x, y, z), (x, y, z))
