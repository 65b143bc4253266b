"""Navigation over position fixes: each trip's state, progress and camera alerts along its route.

A trip is a sequence, so its fixes are folded in order of time, in a grouped map over a table or
with state over a stream; trips are independent. Both call the same step.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbsense.constants import ARRIVE_M, BACK_ON_ROUTE_M, BACKWARD_COST, CAMERA_FAR_M, CAMERA_NEAR_M, EARTH_RADIUS_M, GOOD_FIX_M, GROUP_M, HEADING_FREE_DEG, HEADING_PENALTY_M, LOST_S, METRES_PER_DEGREE, MOVING_MPS, OFF_ROUTE_M, OFF_ROUTE_S, PAUSE_S, REROUTE_MIN_MS, REROUTE_WAITS_MS

STATES = "trip long, time_ms long, state string, progress_m double, off_m double"
#: Time without fixes after which a trip's state is dropped from a stream.
IDLE_MS = 24 * 3600 * 1000


def metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    x, y = math.radians(a[0]), math.radians(b[0])
    s = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(s)))


def heading(a: tuple[float, float], b: tuple[float, float]) -> float:
    x, y, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return math.degrees(math.atan2(math.sin(d) * math.cos(y), math.cos(x) * math.sin(y) - math.sin(x) * math.cos(y) * math.cos(d))) % 360


def turned(a: float, b: float) -> float:
    d = (a - b) % 360
    return min(d, 360 - d)


class Line:
    """A route's vertices with the distance to each."""

    def __init__(self, points: list[tuple[float, float]]):
        self.points, self.at = points, [0.0]
        for a, b in zip(points, points[1:], strict=False):
            self.at.append(self.at[-1] + metres(a, b))

    def match(self, p: tuple[float, float], course: float | None, window: tuple[float, float, float] | None) -> tuple[float, float, int]:
        """(along, distance, segment) of the best segment, of all or of those in a window (progress, behind, ahead).

        A segment that heads elsewhere than the course costs more, and in a window so does going back.
        """
        k = METRES_PER_DEGREE * max(0.01, math.cos(math.radians(p[0])))
        first, last = 0, len(self.points) - 2
        if window:
            progress, behind, ahead = window
            first, last = (min(max(bisect_right(self.at, x) - 1, 0), last) for x in (max(progress - behind, 0.0), progress + ahead))
        best, least = None, math.inf
        for i in range(first, last + 1):
            (a, b), (c, d) = self.points[i], self.points[i + 1]
            # Differences of longitude are taken the short way around.
            ax, ay, dx, dy = ((b - p[1] + 180) % 360 - 180) * k, (a - p[0]) * METRES_PER_DEGREE, ((d - b + 180) % 360 - 180) * k, (c - a) * METRES_PER_DEGREE
            n = dx * dx + dy * dy
            t = min(1.0, max(0.0, -(ax * dx + ay * dy) / n)) if n else 0.0
            off, along = math.hypot(ax + t * dx, ay + t * dy), self.at[i] + t * (self.at[i + 1] - self.at[i])
            cost = off
            if course is not None:
                cost += HEADING_PENALTY_M * min(1.0, max(0.0, turned(course, heading((a, b), (c, d))) - HEADING_FREE_DEG) / 90)
            if window:
                cost += BACKWARD_COST * max(0.0, window[0] - along)
            if cost < least:
                best, least = (along, off, i), cost
        return best


@dataclass
class Trip:
    """What is known of a trip after its fixes so far; times in milliseconds, -1 for none."""

    state: str = "navigating"
    progress: float = 0.0
    time_ms: int = -1
    lat: float = 0.0
    lon: float = 0.0
    speed: float = 0.0
    off_since: int = -1
    begun: bool = False


TRIP = "state string, progress double, time_ms long, lat double, lon double, speed double, off_since long, begun boolean"


def silence(line: Line, t: Trip, until: int) -> list[tuple[int, str, float, float]]:
    """Rows of what happens without a fix before `until`: the signal is lost, the trip goes on by dead reckoning, then pauses."""
    rows, length = [], line.at[-1]
    if t.time_ms < 0 or t.state == "arrived":
        return rows
    lost, paused = t.time_ms + LOST_S * 1000, t.time_ms + PAUSE_S * 1000
    if t.state not in ("lost_signal", "paused") and until > lost:
        # Only from the route on is the way ahead known.
        t.speed = t.speed if t.state == "navigating" else 0.0
        t.state, t.off_since = "lost_signal", -1
        t.progress = min(length, t.progress + t.speed * LOST_S)
        rows.append((lost, t.state, t.progress, 0.0))
    if t.state == "lost_signal" and until > paused:
        t.state, t.progress = "paused", min(length, t.progress + t.speed * (PAUSE_S - LOST_S))
        rows.append((paused, t.state, t.progress, 0.0))
    return rows


def step(line: Line, t: Trip, at: int, lat: float, lon: float, accuracy: float) -> list[tuple[int, str, float, float]]:
    """Rows (time_ms, state, progress_m, off_m) that a fix brings, and t brought up to date.

    A first good fix away from the route is off it at once. Later a moving device that is OFF_ROUTE_M
    away for OFF_ROUTE_S is off the route; standing still ends that count. It is back within
    BACK_ON_ROUTE_M near its progress, or further on where it heads the route's way. Vague fixes
    change no state. Progress never falls, and a trip ends within ARRIVE_M of its last point.
    """
    if t.state == "arrived" or at < t.time_ms:
        return []
    rows, p, before = silence(line, t, at), (lat, lon), (t.lat, t.lon)
    known = t.time_ms >= 0
    gap, moved = ((at - t.time_ms) / 1000, metres(before, p)) if known else (0.0, 0.0)
    speed = moved / gap if gap > 0 else 0.0
    moving, good = speed >= MOVING_MPS, accuracy <= GOOD_FIX_M
    course = heading(before, p) if moving and moved > 3.0 else None
    window = None
    if known and t.state != "paused":
        window = (t.progress, 300.0, 2000.0) if t.state == "lost_signal" else (t.progress, 40.0, max(150.0, speed * max(gap, 1.0) * 2 + 100))
    along, off, segment = line.match(p, course, window)
    if t.state in ("lost_signal", "paused"):
        t.state, t.off_since = "navigating", -1
    t.time_ms, t.lat, t.lon, t.speed = at, lat, lon, speed
    left, length = metres(p, line.points[-1]), line.at[-1]
    if left <= ARRIVE_M or (segment == len(line.points) - 2 and length - along < 1.0 and left <= 150.0 and length - t.progress < 200.0):
        t.state, t.progress = "arrived", max(t.progress, along)
    elif good and not t.begun:
        t.begun = True
        if off <= OFF_ROUTE_M:
            t.progress = along
        else:
            t.state = "off_route"
    elif t.state == "navigating":
        if off <= OFF_ROUTE_M:
            t.off_since = -1
            if good or off <= accuracy:
                t.progress = max(t.progress, along)
        elif good and moving:
            t.off_since = at if t.off_since < 0 else t.off_since
            if at - t.off_since >= OFF_ROUTE_S * 1000:
                t.state = "off_route"
        elif good:
            t.off_since = -1
    elif good:
        back = off <= BACK_ON_ROUTE_M
        if not back:
            along, away, segment = line.match(p, course, None)
            ahead = course is None or turned(course, heading(line.points[segment], line.points[segment + 1])) <= HEADING_FREE_DEG
            back = away <= BACK_ON_ROUTE_M and ahead and along >= t.progress
            off = away if back else off
        if back:
            t.state, t.off_since, t.progress = "navigating", -1, max(t.progress, along)
    return [*rows, (at, t.state, t.progress, off)]


def _lines(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("route").agg(F.sort_array(F.collect_list(F.struct("pos", "lat", "lon"))).alias("line"))


FIX = ["time_ms", "lat", "lon", "accuracy_m"]


def session_states(fixes: DataFrame, vertices: DataFrame) -> DataFrame:
    """Rows (trip, time_ms, state, progress_m, off_m) of fixes (trip, route, time_ms, lat, lon, accuracy_m).

    A route's line is joined to its trips, not to their fixes, and fixes and line of a trip meet in
    its group.
    """
    trips = fixes.select("trip", "route").distinct().join(_lines(vertices), "route").select(F.col("trip").alias("of"), "line")

    def run(key, pdf: pd.DataFrame, route: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or route.empty:
            return pd.DataFrame(columns=["trip", "time_ms", "state", "progress_m", "off_m"])
        line, trip = Line([(float(v["lat"]), float(v["lon"])) for v in route["line"].iloc[0]]), Trip()
        rows = [r for fix in pdf.sort_values("time_ms", kind="stable")[FIX].itertuples(index=False, name=None) for r in step(line, trip, *fix)]
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["trip", "time_ms", "state", "progress_m", "off_m"])

    return fixes.groupBy("trip").cogroup(trips.groupBy("of")).applyInPandas(run, STATES)


def session_stream(fixes: DataFrame, vertices: DataFrame) -> DataFrame:
    """session_states() of a stream of fixes: lines of routes are a static side, the state is one Trip for each trip.

    Fixes of a micro-batch are put in order of time for each trip; those before the last one seen are
    late and left out.
    """
    rows = fixes.join(_lines(vertices), "route")

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values("time_ms", kind="stable")
        line = Line([(float(v["lat"]), float(v["lon"])) for v in pdf["line"].iloc[0]])
        trip = Trip(*state.get) if state.exists else Trip()
        out = [r for fix in pdf[FIX].itertuples(index=False, name=None) for r in step(line, trip, *fix)]
        state.update(astuple(trip))
        state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["trip", "time_ms", "state", "progress_m", "off_m"])

    return rows.groupBy("trip").applyInPandasWithState(run, STATES, TRIP, "append", "ProcessingTimeTimeout")


def announcements(progress: DataFrame, on_route: DataFrame) -> DataFrame:
    """Rows (trip, time_ms, stage, cameras, first_m): camera alerts of trips, cameras just after one another announced together.

    progress has rows (trip, route, time_ms, progress_m), on_route rows (route, osm_id, along_m). At
    each step at most one alert is due: of the nearest camera ahead that wasn't announced at its
    stage, with those within GROUP_M behind it. A near alert ends the far stage of its cameras, and
    what lies behind a trip's first position is never announced.
    """
    cams = on_route.groupBy("route").agg(F.sort_array(F.collect_list(F.struct("along_m", "osm_id"))).alias("cams"))
    sides = progress.select("trip", "route").distinct().join(cams, "route").select(F.col("trip").alias("of"), "cams")

    def run(key, steps: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        rows = []
        cams = [(float(c["along_m"]), int(c["osm_id"])) for c in side["cams"].iloc[0]] if len(side) else []
        done: dict[str, set[int]] = {"far": set(), "near": set()}
        first = 0
        for at, now in steps.sort_values("time_ms")[["time_ms", "progress_m"]].itertuples(index=False, name=None):
            while first < len(cams) and cams[first][0] <= now:
                first += 1
            i = first
            while i < len(cams) and cams[i][0] - now <= CAMERA_FAR_M:
                stage = "near" if cams[i][0] - now <= CAMERA_NEAR_M else "far"
                if cams[i][1] not in done[stage]:
                    group = [c for c in cams[i:] if c[0] <= cams[i][0] + GROUP_M and c[1] not in done[stage]]
                    done[stage] |= {c[1] for c in group}
                    done["far"] |= done["near"]
                    rows.append((key[0], at, stage, [c[1] for c in group], cams[i][0] - now))
                    break
                i += 1
        return pd.DataFrame(rows, columns=["trip", "time_ms", "stage", "cameras", "first_m"])

    return progress.groupBy("trip").cogroup(sides.groupBy("of")).applyInPandas(run, "trip long, time_ms long, stage string, cameras array<long>, first_m double")


def camera_ahead(progress: DataFrame, on_route: DataFrame) -> DataFrame:
    """Rows (trip, osm_id, stage, time_ms): when each camera ahead is first within the far and the near distance.

    progress has rows (trip, route, time_ms, progress_m), on_route rows (route, osm_id, along_m).
    Cameras and progress meet in stretches of CAMERA_FAR_M, so no trip is compared with all of its route.
    """
    steps = F.array(F.lit(0), F.lit(1))
    cams = on_route.withColumn("cell", F.floor(F.col("along_m") / CAMERA_FAR_M))
    seen = progress.withColumn("cell", F.explode(F.transform(steps, lambda s: F.floor(F.col("progress_m") / CAMERA_FAR_M) + s)))
    ahead = F.col("along_m") - F.col("progress_m")
    near = seen.join(cams, ["route", "cell"]).where((ahead >= 0) & (ahead <= CAMERA_FAR_M))
    stages = F.array(F.when(ahead > CAMERA_NEAR_M, "far"), F.when(ahead <= CAMERA_NEAR_M, "near"))
    rows = near.select("trip", "osm_id", "time_ms", F.explode(F.array_compact(stages)).alias("stage"))
    return rows.groupBy("trip", "osm_id", "stage").agg(F.min("time_ms").alias("time_ms"))


def reroute_wait(failures: int) -> int:
    """Milliseconds that must lie between two requests after so many failures in a row."""
    return REROUTE_WAITS_MS[min(failures, len(REROUTE_WAITS_MS)) - 1] if failures else REROUTE_MIN_MS


def reroute_gate(asks: DataFrame) -> DataFrame:
    """Rows (trip, time_ms, allowed) of asks (trip, time_ms, answer_ms, ok): when a reroute may be sent.

    One at a time: not before the last one sent is answered. At least 10 s after the last one sent;
    after failures in a row 10, 20, 40, then 60 s. ok says how a request would be answered.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, sent, failed, pending = [], None, 0, None
        for at, answered, ok in pdf.sort_values("time_ms")[["time_ms", "answer_ms", "ok"]].itertuples(index=False):
            if pending and pending[0] <= at:
                failed, pending = 0 if pending[1] else failed + 1, None
            allowed = not pending and (sent is None or at - sent >= reroute_wait(failed))
            if allowed:
                sent, pending = at, (answered, ok)
            rows.append((pdf["trip"].iloc[0], at, allowed))
        return pd.DataFrame(rows, columns=["trip", "time_ms", "allowed"])

    return asks.groupBy("trip").applyInPandas(run, "trip long, time_ms long, allowed boolean")
