"""Distances and a hexagon lattice, all as column expressions.

The lattice is pointy-top on a cylindrical equal-area plane. Every level has cells one seventh the area
of the level above, anchored at the mean area of the widely used level 7 cell. A cell is one BIGINT
(level, q, r packed into bit fields), so that joins and shuffles move eight bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
EARTH_RADIUS_KM = 6371.0088
LEVEL7_AREA_KM2 = 5.161293
KM_PER_DEGREE_LON = 111.32
KM_PER_DEGREE_LAT = 110.57
STANDARD_PARALLEL = 22.0
MAX_LEVEL = 15

C0 = math.cos(math.radians(STANDARD_PARALLEL))
SQRT3 = math.sqrt(3.0)
LEVEL_BITS = 56
AXIS_BITS = 28
AXIS_OFFSET = 1 << 27
AXIS_MASK = (1 << AXIS_BITS) - 1


def cell_area_km2(res: int) -> float:
    return LEVEL7_AREA_KM2 * 7.0 ** (7 - res)


def cell_side_km(res: int) -> float:
    return math.sqrt(2.0 * cell_area_km2(res) / (3.0 * SQRT3))


SIDES = [cell_side_km(r) for r in range(MAX_LEVEL + 1)]


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def fixed6(value) -> Column:
    """Half-up at six decimals by arithmetic alone, so that near-equal distances order the same anywhere."""
    return F.floor(_col(value) * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (_col(v) for v in (lat1, lon1, lat2, lon2))
    north = F.sin(F.radians(lat2 - lat1) / 2)
    east = F.sin(F.radians(lon2 - lon1) / 2)
    chord = north * north + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * east * east
    bounded = F.when(chord.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), chord)))  # both skip NULL
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(bounded))


def unit_xyz(lat, lon) -> tuple[Column, Column, Column]:
    """A point on the unit sphere."""
    lat, lon = F.radians(_col(lat)), F.radians(_col(lon))
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def chord2(ax, ay, az, bx, by, bz) -> Column:
    """Squared straight distance of two points on the unit sphere."""
    dx, dy, dz = (_col(a) - _col(b) for a, b in ((ax, bx), (ay, by), (az, bz)))
    return dx * dx + dy * dy + dz * dz


def chord_km(squared: Column) -> Column:
    """Great-circle kilometres of a squared chord; the same distance as haversine_km."""
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.when(squared.isNotNull(), F.least(F.lit(1.0), F.sqrt(squared) / 2)))


def planar_offset_km(lat, lon, from_lat, from_lon) -> tuple[Column, Column]:
    """(east, north) kilometres from the second point to the first, scaled at the first point's latitude."""
    lat, lon, from_lat, from_lon = (_col(v) for v in (lat, lon, from_lat, from_lon))
    east = (lon - from_lon) * F.lit(KM_PER_DEGREE_LON) * F.cos(F.radians(lat))
    return east, (lat - from_lat) * F.lit(KM_PER_DEGREE_LAT)


def pack(res, q, r) -> Column:
    head = _col(res).cast("bigint") * F.lit(1 << LEVEL_BITS)
    return head + (_col(q) + F.lit(AXIS_OFFSET)) * F.lit(1 << AXIS_BITS) + (_col(r) + F.lit(AXIS_OFFSET))


def cell_level(cell) -> Column:
    return F.shiftright(_col(cell), LEVEL_BITS).cast("int")


def cell_q(cell) -> Column:
    return F.shiftright(_col(cell), AXIS_BITS).bitwiseAND(F.lit(AXIS_MASK)) - F.lit(AXIS_OFFSET)


def cell_r(cell) -> Column:
    return _col(cell).bitwiseAND(F.lit(AXIS_MASK)) - F.lit(AXIS_OFFSET)


def plane_xy(lat, lon) -> tuple[Column, Column]:
    x = F.lit(EARTH_RADIUS_KM * C0) * F.radians(_col(lon))
    return x, F.lit(EARTH_RADIUS_KM / C0) * F.sin(F.radians(_col(lat)))


def cell_of(lat, lon, res: int) -> Column:
    """The cell at a fixed level containing a point: axial coordinates, rounded as a cube."""
    side = SIDES[res]
    x, y = plane_xy(lat, lon)
    fq = (x * F.lit(SQRT3 / 3.0) - y / 3.0) / F.lit(side)
    fr = (y * F.lit(2.0 / 3.0)) / F.lit(side)
    near = lambda v: F.floor(v + F.lit(0.5))
    q, r, s = near(fq), near(fr), near(-fq - fr)
    dq, dr, ds = F.abs(q - fq), F.abs(r - fr), F.abs(s + fq + fr)
    fix_q = (dq > dr) & (dq > ds)
    fix_r = ~fix_q & (dr > ds)
    return pack(F.lit(res), F.when(fix_q, -r - s).otherwise(q), F.when(fix_r, -q - s).otherwise(r))


def _side_of(cell) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SIDES]), cell_level(cell) + 1)


def lattice_lat(side, r) -> Column:
    return F.degrees(F.asin(F.lit(1.5) * _col(side) * _col(r) * F.lit(C0) / F.lit(EARTH_RADIUS_KM)))


def lattice_lon(side, q, r) -> Column:
    return F.degrees(_col(side) * F.lit(SQRT3) * (_col(q) + _col(r) / 2.0) / F.lit(EARTH_RADIUS_KM * C0))


def centroid_lat(cell, res: int | None = None) -> Column:
    return lattice_lat(F.lit(SIDES[res]) if res is not None else _side_of(cell), cell_r(cell))


def centroid_lon(cell, res: int | None = None) -> Column:
    side = F.lit(SIDES[res]) if res is not None else _side_of(cell)
    return lattice_lon(side, cell_q(cell), cell_r(cell))


def parent(cell, res: int, from_res: int | None = None) -> Column:
    """The coarser cell that holds this cell's centroid."""
    return cell_of(centroid_lat(cell, from_res), centroid_lon(cell, from_res), res)


def parent_exact(cell, res: int, from_res: int) -> Column:
    """The same by axial coordinates alone. Over an even number of levels sides differ by a power of 7 and many centroids lie
    on a border of the coarser lattice: those are decided in integers, by the rule of cell_of, not by the last digit of a sine.
    """
    q, r = cell_q(cell), cell_r(cell)
    if (from_res - res) % 2:  # sides differ by an irrational factor
        scale = F.lit(SIDES[from_res] / SIDES[res])
        fq, fr, one = q * scale, r * scale, F.lit(1.0)
        near = lambda v: F.floor(v + F.lit(0.5))
    else:
        times = 7 ** ((from_res - res) // 2)
        fq, fr, one = q, r, F.lit(times)
        near = lambda v: F.floor((2 * v + times) / (2 * times))
    nq, nr, ns = near(fq), near(fr), near(-fq - fr)
    dq, dr, ds = F.abs(nq * one - fq), F.abs(nr * one - fr), F.abs(ns * one + fq + fr)
    fix_q = (dq > dr) & (dq > ds)
    fix_r = ~fix_q & (dr > ds)
    return pack(F.lit(res), F.when(fix_q, -nr - ns).otherwise(nq), F.when(fix_r, -nq - ns).otherwise(nr))


def boundary(cell, res: int | None = None) -> Column:
    """Six corners as array<struct<lat,lon>>, counter-clockwise from the lower right."""
    side = F.lit(SIDES[res]) if res is not None else _side_of(cell)
    x0 = side * F.lit(SQRT3) * (cell_q(cell) + cell_r(cell) / 2.0)
    y0 = side * F.lit(1.5) * cell_r(cell)
    corners = []
    for step in range(6):
        angle = math.radians(60.0 * step - 30.0)
        x, y = x0 + side * F.lit(math.cos(angle)), y0 + side * F.lit(math.sin(angle))
        corners.append(F.struct(
            F.degrees(F.asin(y * F.lit(C0 / EARTH_RADIUS_KM))).alias("lat"),
            F.degrees(x / F.lit(EARTH_RADIUS_KM * C0)).alias("lon")))
    return F.array(*corners)


def within_box(lat, lon, west: float, south: float, east: float, north: float) -> Column:
    """Inclusive bounding box; the corners must be in order."""
    if west > east or south > north:
        raise ValueError("the lower corner of a box must not exceed the upper one")
    return _col(lon).between(west, east) & _col(lat).between(south, north)
