"""Trips that ask for new routes: fixes, answers and silence as one sequence of events a trip.

An event is a fix, or the answer to a request. Off the route a trip sends a request and is rerouting
until it is answered; one request is under way at a time, and those after failures wait. Between
events time itself acts: a trip without fixes loses its signal and is later paused, and one that is off the
route asks again when its wait is over. In a table the events of a trip are folded in order of time; in a stream
the same fold keeps its state with a timer in event time for what is due next, so it happens when the watermark
passes even if no further fix comes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from curbsense.constants import GOOD_FIX_M, LOST_S, PAUSE_S
from curbsense.streaming.navigation import Line, Trip, _lines, reroute_wait, silence, step

EVENT = ["time_ms", "kind", "lat", "lon", "accuracy_m", "request", "line"]
ROWS = "trip long, time_ms long, state string, progress_m double, off_m double, request long"


@dataclass
class Session:
    """A trip with its line and its requests; times in milliseconds, -1 for none."""

    trip: Trip
    points: list[tuple[float, float]]
    sent_ms: int = -1
    failures: int = 0
    in_flight: int = -1
    next_id: int = 0
    good: bool = False

    def due(self) -> int:
        """When something happens without an event; -1 for never."""
        t = self.trip
        if t.time_ms < 0 or t.state in ("arrived", "paused"):
            return -1
        if t.state == "lost_signal":
            return t.time_ms + PAUSE_S * 1000
        lost = t.time_ms + LOST_S * 1000
        retry = self.sent_ms + reroute_wait(self.failures) if self.sent_ms >= 0 else t.time_ms
        return min(lost, max(retry, t.time_ms)) if t.state == "off_route" and self.good else lost

    def asked(self, at: int) -> int | None:
        """The number of the request that is sent now; None where none may be."""
        if self.in_flight >= 0 or (self.sent_ms >= 0 and at - self.sent_ms < reroute_wait(self.failures)):
            return None
        self.in_flight, self.sent_ms, self.next_id = self.next_id, at, self.next_id + 1
        self.trip.state = "rerouting"
        return self.in_flight


def until(line: Line, s: Session, now: int) -> Iterator[tuple]:
    """What happens before `now` without an event; a timer that is due at `now` itself waits for the event."""
    while 0 <= (at := s.due()) < now:
        t = s.trip
        if at < t.time_ms + LOST_S * 1000 and t.state == "off_route":
            number = s.asked(at)
            yield at, t.state, t.progress, 0.0, number
            continue
        s.in_flight = -1
        t.state = "off_route" if t.state == "rerouting" else t.state
        yield from ((*row, None) for row in silence(line, t, at + 1))


def fix(line: Line, s: Session, at: int, lat: float, lon: float, accuracy: float) -> Iterator[tuple]:
    t = s.trip
    before, s.good = t.state, accuracy <= GOOD_FIX_M
    # A trip that waits for its answer is off the route to the step.
    t.state = "off_route" if before == "rerouting" else before
    rows = step(line, t, at, lat, lon, accuracy)
    for row in rows[:-1]:
        yield (*row, None)
    if rows:
        number = None
        if t.state != "off_route":
            s.in_flight = -1
        elif s.in_flight >= 0:
            t.state = "rerouting"
        elif s.good:
            number = s.asked(at)
        yield (at, t.state, *rows[-1][2:], number)


def answer(s: Session, at: int, request: int, new: list | None) -> Iterator[tuple]:
    """The answer to a request: a new line, or none. Late ones, to a request that isn't under way, change nothing."""
    t = s.trip
    if request != s.in_flight:
        return
    s.in_flight = -1
    if new is None:
        s.failures += 1
        t.state = "off_route"
    else:
        s.failures, s.points = 0, [(float(p["lat"]), float(p["lon"])) for p in new]
        t.progress = Line(s.points).match((t.lat, t.lon), None, None)[0]
        t.state, t.off_since = "navigating", -1
    yield at, t.state, t.progress, 0.0, None


def fold(s: Session, events: pd.DataFrame) -> Iterator[tuple]:
    """Rows (time_ms, state, progress_m, off_m, request) of events in order of time; an answer before a fix of the same time."""
    line = Line(s.points)
    for at, kind, lat, lon, accuracy, request, new in events.sort_values(["time_ms", "kind"], kind="stable")[EVENT].itertuples(index=False, name=None):
        if at < s.trip.time_ms:
            continue
        yield from until(line, s, at)
        if kind == "fix":
            yield from fix(line, s, at, lat, lon, accuracy)
        else:
            yield from answer(s, at, int(request), new)
            line = Line(s.points)


def _begun(line) -> Session:
    return Session(Trip(), [(float(v["lat"]), float(v["lon"])) for v in line])


def _frame(trip: int, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(trip, *r) for r in rows], columns=["trip", "time_ms", "state", "progress_m", "off_m", "request"])
    return out.astype({"request": "Int64", "time_ms": "int64", "progress_m": "float64", "off_m": "float64"})


def trip_states(events: DataFrame, vertices: DataFrame, end_ms: int | None = None) -> DataFrame:
    """Rows (trip, time_ms, state, progress_m, off_m, request) of events (trip, route, EVENT ...) up to a time.

    kind is fix (lat, lon, accuracy_m) or answer (request, and line, the new route's points (lat, lon);
    null where there is none). request numbers a trip's requests from 0, where one is sent. Without
    end_ms a trip ends with its last event. Events before the last fix are left out.
    """
    trips = events.where("route IS NOT NULL").select("trip", "route").distinct().join(_lines(vertices), "route").select(F.col("trip").alias("of"), F.col("line").alias("way"))

    def run(key, pdf: pd.DataFrame, route: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or route.empty:
            return _frame(0, [])
        s = _begun(route["way"].iloc[0])
        rows = list(fold(s, pdf))
        if end_ms is not None:
            rows += until(Line(s.points), s, end_ms)
        return _frame(key[0], rows)

    return events.groupBy("trip").cogroup(trips.groupBy("of")).applyInPandas(run, ROWS)


class _Trips(StatefulProcessor):
    """fold() with its session as state, and one timer for what is due next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("session", "data string")

    def _session(self) -> Session:
        data = json.loads(self.kept.get()[0])
        return Session(**(data | {"trip": Trip(**data["trip"]), "points": [tuple(p) for p in data["points"]]}))

    def _keep(self, s: Session) -> None:
        self.kept.update((json.dumps(asdict(s)),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if (due := s.due()) >= 0:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        s = self._session() if self.kept.exists() else _begun(pdf["way"].iloc[0])
        out = list(fold(s, pdf))
        self._keep(s)
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._session()
        out = list(until(Line(s.points), s, timerValues.getCurrentWatermarkInMs() + 1))
        self._keep(s)
        yield _frame(key[0], out)

    def close(self) -> None:
        pass


def trip_stream(events: DataFrame, vertices: DataFrame, delay: str = "2 seconds") -> DataFrame:
    """trip_states() of a stream of events, whose route is set on each; what silence brings comes when the watermark, `delay` behind the latest event, has passed it.

    Events that come later than the watermark are left out.
    """
    timed = events.withColumn("event_time", F.timestamp_millis("time_ms")).withWatermark("event_time", delay)
    rows = timed.join(_lines(vertices).withColumnRenamed("line", "way"), "route")
    return rows.groupBy("trip").transformWithStateInPandas(_Trips(), ROWS, "Append", "EventTime")
