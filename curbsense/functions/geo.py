"""Geometry as column expressions: built-in functions only, so they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from curbsense.constants import BUCKET_SIZE, CELL_NUDGE, CELL_SIZE, COL_RANGE, EARTH_RADIUS_M, HEX_PX, LEAST_COS, METRES_PER_DEGREE, ROW_RANGE, TILE_PX, TILE_SIZE

Num = Column | float | str


def c(x: Num) -> Column:
    """A column from a name, a number or a column."""
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Num, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c(x)))


def valid_coord(lat: Num, lon: Num) -> Column:
    """Both are numbers in range; null where one is null."""
    return ~F.isnan(c(lat)) & ~F.isnan(c(lon)) & c(lat).between(-90.0, 90.0) & c(lon).between(-180.0, 180.0)


def wrap_lon(lon: Num) -> Column:
    """Longitude in [-180, 180); NaN becomes 0."""
    return F.when(F.isnan(c(lon)), 0.0).otherwise(F.pmod(c(lon) + 180.0, F.lit(360.0)) - 180.0)


def haversine_m(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Great-circle distance in metres."""
    a1, a2 = F.radians(c(lat1)), F.radians(c(lat2))
    s = F.sin((a2 - a1) / 2)
    t = F.sin(F.radians(c(lon2) - c(lon1)) / 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(s * s + F.cos(a1) * F.cos(a2) * t * t)))


def bearing_deg(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Initial bearing from the first point to the second, in [0, 360)."""
    a1, a2, d = F.radians(c(lat1)), F.radians(c(lat2)), F.radians(c(lon2) - c(lon1))
    y = F.sin(d) * F.cos(a2)
    x = F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_diff(a: Num, b: Num) -> Column:
    """Smallest angle between two bearings, in [0, 180]."""
    d = F.pmod(c(a) - c(b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def metre_cos(lat: Num) -> Column:
    return F.greatest(F.abs(F.cos(F.radians(c(lat)))), F.lit(LEAST_COS))


def segment_distance_m(lat: Num, lon: Num, lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Planar distance in metres from a point to a segment, exact enough at tens of metres; also over the antimeridian."""
    k = METRES_PER_DEGREE * F.greatest(F.cos(F.radians(c(lat))), F.lit(LEAST_COS))
    ax, ay = wrap_lon(c(lon1) - c(lon)) * k, (c(lat1) - c(lat)) * METRES_PER_DEGREE
    dx, dy = wrap_lon(c(lon2) - c(lon1)) * k, (c(lat2) - c(lat1)) * METRES_PER_DEGREE
    length = dx * dx + dy * dy
    t = F.when(length > 0, clamp(-(ax * dx + ay * dy) / length, 0.0, 1.0)).otherwise(0.0)
    return F.hypot(ax + t * dx, ay + t * dy)


def grid_cell(lat: Num, lon: Num) -> Column:
    """struct(row, col) of the 0.05 degree cell; a coordinate on a boundary belongs to the higher cell."""
    row = F.floor(clamp(lat, -90.0, 90.0) / CELL_SIZE + CELL_NUDGE)
    col = F.floor(wrap_lon(lon) / CELL_SIZE + CELL_NUDGE)
    return F.struct(clamp(row, *ROW_RANGE).cast("int").alias("row"), clamp(col, *COL_RANGE).cast("int").alias("col"))


def bucket(x: Num) -> Column:
    """Number of the 0.002 degree bucket."""
    return F.floor(c(x) / BUCKET_SIZE).cast("long")


def tile(x: Num) -> Column:
    """Number of the 0.1 degree road tile."""
    return F.floor(c(x) / TILE_SIZE).cast("int")


def circle_box(lat: Num, lon: Num, radius_m: Num) -> Column:
    """struct(south, west, north, east) around a circle; west > east where it crosses the antimeridian."""
    dlat = c(radius_m) / METRES_PER_DEGREE
    dlon = c(radius_m) / (METRES_PER_DEGREE * metre_cos(lat))
    return F.struct(F.greatest(c(lat) - dlat, F.lit(-90.0)).alias("south"), wrap_lon(c(lon) - dlon).alias("west"), F.least(c(lat) + dlat, F.lit(90.0)).alias("north"), wrap_lon(c(lon) + dlon).alias("east"))


def sanitized_box(south: Num, west: Num, north: Num, east: Num) -> Column:
    """struct of a box with latitudes clamped and ordered, and longitudes wrapped; 360 degrees or more is the world."""
    s, n = clamp(south, -90.0, 90.0), clamp(north, -90.0, 90.0)
    world = c(east) - c(west) >= 360.0
    e = F.when(F.abs(c(east) - 180.0) < 1e-12, 180.0).otherwise(wrap_lon(east))
    return F.struct(F.least(s, n).alias("south"), F.when(world, -180.0).otherwise(wrap_lon(west)).alias("west"), F.greatest(s, n).alias("north"), F.when(world, 180.0).otherwise(e).alias("east"))


def in_box(lat: Num, lon: Num, box: Column) -> Column:
    """Inclusive on every side; plain ranges, so they reach the Parquet scan where the box is constant."""
    across = box["west"] > box["east"]
    inside = F.when(across, (c(lon) >= box["west"]) | (c(lon) <= box["east"])).otherwise(c(lon).between(box["west"], box["east"]))
    return c(lat).between(box["south"], box["north"]) & inside


def box_cells(box: Column) -> Column:
    """array of struct(row, col): the cells a sanitized box meets; a north or east edge on a grid line excludes the next cell."""

    def span(low: Column, high: Column, bounds: tuple[int, int], wrapped: bool) -> Column:
        first = clamp(F.floor((wrap_lon(low) if wrapped else low) / CELL_SIZE + CELL_NUDGE), *bounds).cast("int")
        last = clamp(F.ceil(high / CELL_SIZE - CELL_NUDGE) - 1, *bounds).cast("int")
        return F.sequence(first, F.greatest(first, last))

    rows = span(box["south"], box["north"], ROW_RANGE, False)
    cols = F.when(
        box["west"] > box["east"],
        F.array_union(span(box["west"], F.lit(180.0), COL_RANGE, True), span(F.lit(-180.0), box["east"], COL_RANGE, True)),
    ).otherwise(span(box["west"], box["east"], COL_RANGE, True))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda k: F.struct(r.alias("row"), k.alias("col")))))


def merc_x(lon: Num) -> Column:
    return c(lon) / 360.0 + 0.5


def merc_y(lat: Num) -> Column:
    s = F.sin(F.radians(c(lat)))
    return clamp(0.5 - 0.25 * F.ln((1.0 + s) / (1.0 - s)) / math.pi, 0.0, 1.0)


def js_round(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + 0.5)


def hex_columns(level: int) -> int:
    """Even number of hexagon columns around the world at a level."""
    return max(2, 2 * math.floor(TILE_PX * 2**level / (1.5 * HEX_PX) / 2 + 0.5))


def hex_cell(level: int, x: Num, y: Num) -> Column:
    """struct(q, r): axial coordinates of the flat-top hexagon, q wrapped into the world's columns."""
    cols = hex_columns(level)
    radius = 1 / (1.5 * cols)
    qf = (2 / 3) * c(x) / radius
    rf = (-(1 / 3) * c(x) + (math.sqrt(3) / 3) * c(y)) / radius
    sf = -qf - rf
    q, r, s = js_round(qf), js_round(rf), js_round(sf)
    dq, dr, ds = F.abs(q - qf), F.abs(r - rf), F.abs(s - sf)
    q2 = F.when((dq > dr) & (dq > ds), -r - s).otherwise(q)
    r2 = F.when((dq > dr) & (dq > ds), r).when(dr > ds, -q - s).otherwise(r)
    wrapped = F.pmod(q2, F.lit(cols))
    return F.struct(wrapped.cast("int").alias("q"), (r2 + (q2 - wrapped) / 2).cast("int").alias("r"))


def destination(lat: Num, lon: Num, bearing: Num, metres: Num) -> Column:
    """struct(lat, lon) reached from a point on an initial bearing."""
    d, a, b = c(metres) / EARTH_RADIUS_M, F.radians(c(lat)), F.radians(c(bearing))
    la = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(b))
    lo = F.radians(c(lon)) + F.atan2(F.sin(b) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(la))
    return F.struct(F.degrees(la).alias("lat"), F.degrees(lo).alias("lon"))


def nearest_on_segment(lat: Num, lon: Num, lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """struct(distance_m, along_m): great-circle distance to a segment, and from its start to the nearest point."""
    full = haversine_m(lat1, lon1, lat2, lon2)
    d13 = haversine_m(lat1, lon1, lat, lon) / EARTH_RADIUS_M
    turn = F.radians(bearing_deg(lat1, lon1, lat, lon) - bearing_deg(lat1, lon1, lat2, lon2))
    across = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(d13) * F.sin(turn))))
    along = F.atan2(F.sin(d13) * F.cos(turn), F.cos(d13)) * EARTH_RADIUS_M
    before, behind = (full <= 0) | (along <= 0), along >= full
    distance = F.when(before, d13 * EARTH_RADIUS_M).when(behind, haversine_m(lat, lon, lat2, lon2)).otherwise(F.abs(across) * EARTH_RADIUS_M)
    return F.struct(distance.alias("distance_m"), F.when(before, 0.0).when(behind, full).otherwise(along).alias("along_m"))
