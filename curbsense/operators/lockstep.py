"""Windowed matching (operators/matching.py) of ordinary trips in lockstep: the first fixes of many trips at once, then their second ones.

Trips are dealt to groups of about GROUP_FIXES fixes, each with the segments of its routes, and a group is arrays. Trips that are very
long, on routes of very many segments, or have nulls among their fixes take the rounds of matching.windowed().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbsense.constants import BACKWARD_COST, EARTH_RADIUS_M, HEADING_FREE_DEG, HEADING_PENALTY_M, LEAST_COS, METRES_PER_DEGREE, MOVING_MPS
from curbsense.functions import geo
from curbsense.operators import matching
from curbsense.operators.spatial import segments
from curbsense.operators.tables import cut

#: Fixes of a group, most fixes of a trip and segments of a route that are matched so, and pairs of a fix and a segment that are looked at together.
GROUP_FIXES, TRIP_FIXES, ROUTE_SEGMENTS, PAIRS = 100_000, 20_000, 256, 50_000
SEGMENT = ["segment", "last", "start_m", "length_m", "lat1", "lon1", "dlat", "dlon", "bearing"]


def _haversine(lat1, lon1, lat2, lon2) -> np.ndarray:
    a1, a2 = np.radians(lat1), np.radians(lat2)
    s, t = np.sin((a2 - a1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(s * s + np.cos(a1) * np.cos(a2) * t * t)))


def _bearing(lat1, lon1, lat2, lon2) -> np.ndarray:
    a1, a2, d = np.radians(lat1), np.radians(lat2), np.radians(lon2 - lon1)
    y, x = np.sin(d) * np.cos(a2), np.cos(a1) * np.sin(a2) - np.sin(a1) * np.cos(a2) * np.cos(d)
    return np.mod(np.degrees(np.arctan2(y, x)) + 360.0, 360.0)


def _runs(new: np.ndarray) -> np.ndarray:
    """Places in runs, from 0; new marks where one begins."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _found(row: np.ndarray, lat: np.ndarray, lon: np.ndarray, s: dict[str, np.ndarray], reach_m: float) -> tuple[np.ndarray, ...]:
    """(fix, place of the segment in its route, off, along) of the candidates of fixes whose routes are rows of s."""
    parts, step = [], max(1, PAIRS // s["lat1"].shape[1])
    for a in range(0, len(row), step):
        r, y, x = row[a : a + step], lat[a : a + step, None], lon[a : a + step, None]
        scale = METRES_PER_DEGREE * np.maximum(np.cos(np.radians(y)), LEAST_COS)
        ax, ay = (np.mod(s["lon1"][r] - x + 180.0, 360.0) - 180.0) * scale, (s["lat1"][r] - y) * METRES_PER_DEGREE
        dx, dy = s["dlon"][r] * scale, s["dlat"][r] * METRES_PER_DEGREE
        length = dx * dx + dy * dy
        with np.errstate(invalid="ignore", divide="ignore"):
            t = np.where(length > 0, np.clip(-(ax * dx + ay * dy) / length, 0.0, 1.0), 0.0)
            off = np.sqrt((ax + t * dx) ** 2 + (ay + t * dy) ** 2)
            i, j = np.nonzero((off <= reach_m) & (r >= 0)[:, None])
        parts.append((i + a, j, off[i, j], s["start_m"][r[i], j] + t[i, j] * s["length_m"][r[i], j]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _matched(reach_m: float):
    def matched(fixes: pa.Table, held: pa.Table) -> pa.Table:
        fixes = fixes.take(pc.sort_indices(fixes, sort_keys=[(c, "ascending") for c in ("trip", "time_ms", "lat", "lon")]))
        trip = fixes["trip"].combine_chunks().dictionary_encode().indices.to_numpy()
        time, lat, lon = (fixes[c].to_numpy() for c in ("time_ms", "lat", "lon"))
        new = np.ones(len(trip), bool)
        new[1:] = trip[1:] != trip[:-1]
        n, segment, off_m, along_m = _runs(new) + 1, np.zeros(len(trip), np.int32), np.zeros(len(trip)), np.zeros(len(trip))
        seen = np.zeros(len(trip), bool)
        if len(held):
            routes = pc.unique(held["route"])
            of, number = pc.index_in(held["route"], value_set=routes).to_numpy(), held["segment"].to_numpy()
            order = np.lexsort((number, of))
            of = of[order]
            begun = np.ones(len(of), bool)
            begun[1:] = of[1:] != of[:-1]
            place = _runs(begun)
            s = {}
            for c in SEGMENT:
                s[c] = np.full((len(routes), place.max() + 1), np.nan)
                s[c][of, place] = held[c].to_numpy()[order]
            row = pc.fill_null(pc.index_in(fixes["line"], value_set=routes), -1).to_numpy()
            fix, j, off, along = _found(row, lat, lon, s, reach_m)
            seen[fix] = True
        if seen.any():
            at = np.flatnonzero(seen)
            nth = (np.cumsum(seen) - 1)[fix]
            begun = np.ones(len(nth), bool)
            begun[1:] = nth[1:] != nth[:-1]
            place = _runs(begun)

            def table(values: np.ndarray, empty: float) -> np.ndarray:
                out = np.full((len(at), place.max() + 1), empty)
                out[nth, place] = values
                return out

            # What a candidate costs whatever the match before, by the seen fix before.
            first = np.ones(len(at), bool)
            first[1:] = trip[at[1:]] != trip[at[:-1]]
            before = np.where(first, at, np.roll(at, 1))
            gap, moved = (time[at] - time[before]) / 1000, _haversine(lat[before], lon[before], lat[at], lon[at])
            speed = np.where(gap > 0, moved / np.where(gap > 0, gap, 1.0), 0.0)
            moving = (speed >= MOVING_MPS) & (moved > 3.0)
            course = _bearing(lat[before], lon[before], lat[at], lon[at])
            ahead = np.maximum(matching.AHEAD_M, speed * np.maximum(gap, 1.0) * 2 + matching.AHEAD_FREE_M)
            r = row[fix]
            turn = np.mod(course[nth] - s["bearing"][r, j], 360.0)
            turn = np.minimum(1.0, np.maximum(0.0, np.minimum(turn, 360.0 - turn) - HEADING_FREE_DEG) / 90)
            start = s["start_m"][r, j]
            cost, found = table(off + np.where(moving[nth], HEADING_PENALTY_M * turn, 0.0), np.inf), table(s["segment"][r, j], np.inf)
            alongs, offs, starts, ends, last = table(along, 0.0), table(off, 0.0), table(start, 0.0), table(start + s["length_m"][r, j], 0.0), table(s["last"][r, j], 0.0) > 0
            # The seen fixes of all trips by their number: each step is a choice by the match before.
            turns = _runs(first)
            order, bounds = np.argsort(turns, kind="stable"), np.cumsum(np.bincount(turns))
            chosen, came = np.zeros(len(at), np.int64), np.zeros(len(at))
            for k, rows in enumerate(np.split(order, bounds[:-1])):
                value = cost[rows]
                if k:
                    was = came[rows - 1][:, None]
                    inside = (starts[rows] <= was + ahead[rows][:, None]) & (last[rows] | (ends[rows] > np.maximum(0.0, was - matching.BEHIND_M)))
                    value = np.floor((value + np.where(inside, BACKWARD_COST * np.maximum(0.0, was - alongs[rows]), 0.0)) * 1000 + 0.5) + np.where(inside, 0.0, 2.0**52)
                else:
                    value = np.floor(value * 1000 + 0.5)
                best = np.where(value == value.min(axis=1)[:, None], found[rows], np.inf).argmin(axis=1)
                chosen[rows], came[rows] = best, alongs[rows, best]
            own = np.arange(len(at))
            segment[at], along_m[at], off_m[at] = found[own, chosen], came, offs[own, chosen]
        values = (pa.array(x, t, mask=~seen) for x, t in ((segment, pa.int32()), (along_m, pa.float64()), (off_m, pa.float64())))
        return pa.table([fixes["trip"], pa.array(n, pa.int32()), fixes["time_ms"], *values], names=["trip", "n", "time_ms", "segment", "along_m", "off_m"])

    return matched


def _odd(*names: str) -> Column:
    """Whether one of some numbers is none."""
    return F.max(F.greatest(*((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int") for c in names))) > 0


def matched(fixes: DataFrame, vertices: DataFrame, reach_m: float = 60.0, made: list[str] | None = None) -> DataFrame:
    """The rows of matching.windowed(); fixes are read several times."""
    fixes, vertices = fixes.select("trip", "route", "time_ms", "lat", "lon"), vertices.select("route", "pos", "lat", "lon")
    trips = fixes.groupBy("trip").agg(F.count(F.lit(1)).alias("n"), _odd("time_ms", "lat", "lon").alias("odd"), (F.count("route") < F.count(F.lit(1))).alias("lost"))
    trips = trips.withColumn("slow", F.col("trip").isNull() | F.col("odd") | F.col("lost") | (F.col("n") > TRIP_FIXES))
    lines = vertices.groupBy("route").agg(F.count(F.lit(1)).alias("n"), _odd("pos", "lat", "lon").alias("odd")).withColumn("slow", F.col("odd") | (F.col("n") > ROUTE_SEGMENTS + 1))
    total, odd_trips = trips.agg(F.sum("n"), F.count_if("slow")).first()
    rest = None
    if odd_trips or lines.where("slow").limit(1).count():
        slow = trips.where("slow").select("trip").union(fixes.join(lines.where("slow").select("route"), "route", "left_semi").select("trip"))
        slow = cut(slow.distinct().withColumnRenamed("trip", "whose"), made)
        is_slow = F.col("trip").eqNullSafe(F.col("whose"))
        rest, fixes = matching.windowed(fixes.join(slow, is_slow, "left_semi"), vertices, reach_m, made), fixes.join(slow, is_slow, "left_anti")
    s = segments(vertices)
    ends = s.groupBy("route").agg(F.max("segment").alias("end"))
    own = {"last": (F.col("segment") == F.col("end")).cast("double"), "dlat": F.col("lat2") - F.col("lat1"), "dlon": geo.wrap_lon(F.col("lon2") - F.col("lon1")), "bearing": geo.bearing_deg("lat1", "lon1", "lat2", "lon2")}
    s = s.join(ends, "route").withColumns(own).select("route", *SEGMENT)
    fixes = fixes.withColumn("of", F.pmod(F.xxhash64("trip"), F.lit(max(1, -(-(total or 0) // GROUP_FIXES)))))
    held = fixes.select("of", "route").distinct().join(s, "route").withColumnRenamed("of", "whose")
    kinds = {c: fixes.schema[c].dataType.simpleString() for c in ("trip", "time_ms")}
    out = fixes.withColumnRenamed("route", "line").groupBy("of").cogroup(held.groupBy("whose")).applyInArrow(_matched(reach_m), f"trip {kinds['trip']}, n int, time_ms {kinds['time_ms']}, segment int, along_m double, off_m double")
    return out if rest is None else out.unionByName(rest)
