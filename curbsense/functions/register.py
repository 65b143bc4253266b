"""Functions for SQL: registered in a session, scalar ones as SQL expressions, so they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from curbsense.constants import CELL_NUDGE, CELL_SIZE, COL_RANGE, EARTH_RADIUS_M, LEAST_COS, METRES_PER_DEGREE, ROW_RANGE
from curbsense.functions.geo import hex_columns

_WRAP = "pmod({} + 180D, 360D) - 180D"
_ROW = f"CAST(greatest({ROW_RANGE[0]}, least({ROW_RANGE[1]}, floor(greatest(-90D, least(90D, lat)) / {CELL_SIZE}D + {CELL_NUDGE}D))) AS INT)"
_COL = f"CAST(greatest({COL_RANGE[0]}, least({COL_RANGE[1]}, floor(({_WRAP.format('lon')}) / {CELL_SIZE}D + {CELL_NUDGE}D))) AS INT)"
_NAMED = " OR ".join(f"coalesce(contains(lower(tags['{k}']), 'flock'), false)" for k in ("brand", "manufacturer", "operator"))
SCALARS = {
    "haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": f"2 * {EARTH_RADIUS_M}D * asin(least(1D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    "wrap_lon(lon DOUBLE) RETURNS DOUBLE": _WRAP.format("lon"),
    "grid_cell(lat DOUBLE, lon DOUBLE) RETURNS STRUCT<row: INT, col: INT>": f"named_struct('row', {_ROW}, 'col', {_COL})",
    "classify(tags MAP<STRING, STRING>) RETURNS STRING": f"CASE WHEN {_NAMED} THEN 'flock' WHEN upper(tags['surveillance:type']) = 'ALPR' THEN 'alpr' ELSE 'unknown' END",
}
_DLAT, _DLON = f"radius_m / {METRES_PER_DEGREE}D", f"radius_m / ({METRES_PER_DEGREE}D * greatest(abs(cos(radians(lat))), {LEAST_COS}D))"


def _span(low: str, high: str, bounds: tuple[int, int]) -> str:
    edge = lambda x: f"CAST(greatest({bounds[0]}, least({bounds[1]}, {x})) AS INT)"
    first, last = edge(f"floor(({low}) / {CELL_SIZE}D + {CELL_NUDGE}D)"), edge(f"ceil(({high}) / {CELL_SIZE}D - {CELL_NUDGE}D) - 1")
    return f"sequence({first}, greatest({first}, {last}))"


#: The cells that a circle's box meets, as an array; columns over the antimeridian are wrapped.
CIRCLE = f"""cells_for_circle(lat DOUBLE, lon DOUBLE, radius_m DOUBLE) RETURNS ARRAY<STRUCT<cell_row: INT, cell_col: INT>>
RETURN flatten(transform({_span(f'greatest(-90D, lat - {_DLAT})', f'least(90D, lat + {_DLAT})', ROW_RANGE)},
    r -> transform(array_distinct(transform({_span(f'lon - {_DLON}', f'lon + {_DLON}', (-10800, 10799))}, c -> CAST(pmod(c + 3600, 7200) - 3600 AS INT))), c -> named_struct('cell_row', r, 'cell_col', c))))"""


class Polyline6:
    """Points of an encoded line with six digits; none where the text is broken."""

    def eval(self, shape: str):
        values, total, bits = [], 0, 0
        for ch in shape or "":
            b = ord(ch) - 63
            if not 0 <= b < 64 or bits > 60:
                return
            total |= (b & 31) << bits
            bits += 5
            if b < 32:
                values.append(~(total >> 1) if total & 1 else total >> 1)
                total = bits = 0
        if bits or len(values) % 2:
            return
        lat = lon = 0
        for i in range(0, len(values), 2):
            lat, lon = lat + values[i], lon + values[i + 1]
            yield i // 2, lat / 1e6, lon / 1e6


def _cells_between(low: float, high: float, bounds: tuple[int, int]) -> range:
    edge = lambda x: max(bounds[0], min(bounds[1], x))
    first = edge(math.floor(low / CELL_SIZE + CELL_NUDGE))
    return range(first, max(first, edge(math.ceil(high / CELL_SIZE - CELL_NUDGE) - 1)) + 1)


class PolylineCells:
    """The cells that the padded boxes of a line's segments meet, each once."""

    def eval(self, points: list, corridor_m: float):
        seen = set()
        for a, b in zip(points or [], (points or [])[1:], strict=False):
            dlat = corridor_m / METRES_PER_DEGREE
            dlon = dlat / max(LEAST_COS, abs(math.cos(math.radians((a["lat"] + b["lat"]) / 2))))
            south, north = max(-90.0, min(a["lat"], b["lat"]) - dlat), min(90.0, max(a["lat"], b["lat"]) + dlat)
            low, high = sorted((a["lon"], b["lon"]))
            if high - low > 180.0:
                low, high = high, low + 360.0
            rows = _cells_between(south, north, ROW_RANGE)
            # Beyond a half turn columns count on, and are wrapped.
            cols = {(c - COL_RANGE[0]) % 7200 + COL_RANGE[0] for c in _cells_between(low - dlon, high + dlon, (-10800, 10799))}
            seen |= {(r, c) for r in rows for c in cols}
        yield from sorted(seen)


class HexCell:
    """The flat-top hexagon of a level that a place lies in; q is wrapped into the world's columns."""

    def eval(self, level: int, lat: float, lon: float):
        if level is None or lat is None or lon is None:
            return
        cols, s = hex_columns(level), math.sin(math.radians(lat))
        x, y = lon / 360 + 0.5, max(0.0, min(1.0, 0.5 - 0.25 * math.log((1 + s) / (1 - s)) / math.pi))
        qf, rf = (2 / 3) * x * 1.5 * cols, (-(1 / 3) * x + (math.sqrt(3) / 3) * y) * 1.5 * cols
        q, r, t = (math.floor(v + 0.5) for v in (qf, rf, -qf - rf))
        dq, dr, dt = abs(q - qf), abs(r - rf), abs(t + qf + rf)
        if dq > dr and dq > dt:
            q = -r - t
        elif dr > dt:
            r = -q - t
        yield q % cols, r + (q - q % cols) // 2


def register(spark: SparkSession) -> None:
    """Add the public functions to the session: haversine_m, wrap_lon, grid_cell, classify, cells_for_circle, and the table functions decode_polyline6, cells_for_polyline and hex_cell."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {CIRCLE}")
    spark.udtf.register("decode_polyline6", udtf(Polyline6, returnType="pos int, lat double, lon double"))
    spark.udtf.register("cells_for_polyline", udtf(PolylineCells, returnType="cell_row int, cell_col int"))
    spark.udtf.register("hex_cell", udtf(HexCell, returnType="q int, r int"))
