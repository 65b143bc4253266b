"""Road graphs: edges from ways, nearest nodes, and quickest paths with segments to avoid."""

from __future__ import annotations

import heapq
import json
import math
from collections import OrderedDict
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbsense.constants import AVOID_M, BLOCKED_PENALTY_S, CORRIDOR_LEAST_M, CORRIDOR_SHARE, LOCAL_REQUESTS, METRES_PER_DEGREE, REPAIR_REQUESTS, ROAD_AREA_LEAST_M, ROAD_TRIP_MOST_M
from curbsense.functions import geo
from curbsense.operators import nearby
from curbsense.operators.overlay import DEGREES, TILE_E7, Overlay, node_lat, node_lon, tile_of, tiles_between, trip_tiles
from curbsense.operators.tables import cut


def road_segments(ways: DataFrame) -> DataFrame:
    """Rows (seg, way, direction, u, v, lat1, lon1, lat2, lon2, secs) of ways' points (way, pos, lat_e7, lon_e7, direction, kmh).

    Ways meet where they share a point, so a node is its pair of whole coordinates.
    """
    w = W.partitionBy("way").orderBy("pos")
    node = lambda lat, lon: F.concat_ws(":", lat, lon)
    s = ways.select("way", "direction", "kmh", "pos", F.col("lat_e7").alias("la1"), F.col("lon_e7").alias("lo1"), F.lead("lat_e7").over(w).alias("la2"), F.lead("lon_e7").over(w).alias("lo2"))
    s = s.where("la2 IS NOT NULL AND (la1 <> la2 OR lo1 <> lo2)")
    s = s.select(F.concat_ws("/", "way", "pos").alias("seg"), "way", "direction", "kmh", node("la1", "lo1").alias("u"), node("la2", "lo2").alias("v"), *((F.col(c) / DEGREES).alias(n) for c, n in (("la1", "lat1"), ("lo1", "lon1"), ("la2", "lat2"), ("lo2", "lon2"))))
    return s.withColumn("secs", geo.haversine_m("lat1", "lon1", "lat2", "lon2") / (F.col("kmh") / 3.6))


def road_edges(segments: DataFrame, blocked: DataFrame) -> DataFrame:
    """Rows (u, v, secs, blocked): directed edges; those of the segments in `blocked` (seg) are marked."""
    marked = segments.join(blocked.select("seg").distinct().withColumn("blocked", F.lit(True)).hint("merge"), "seg", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    ahead = marked.where("direction >= 0").select("u", "v", "secs", "blocked")
    back = marked.where("direction <= 0").select(F.col("v").alias("u"), F.col("u").alias("v"), "secs", "blocked")
    return ahead.unionByName(back)


def nearest_node(places: DataFrame, edges: DataFrame, leaving: bool, reach: int = 1) -> DataFrame:
    """Rows (id, node, metres): for each place (id, lat, lon) the closest node with a way out (or in) among buckets up to `reach` away."""
    end = F.split(F.col("u" if leaving else "v"), ":")
    nodes = edges.select(F.col("u" if leaving else "v").alias("node"), (end[0].cast("double") / DEGREES).alias("n_lat"), (end[1].cast("double") / DEGREES).alias("n_lon")).distinct()
    nodes = nodes.withColumns({"r": geo.bucket("n_lat"), "c": geo.bucket("n_lon")})
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    near = places.withColumn("r", F.explode(F.transform(steps, lambda s: geo.bucket("lat") + s))).withColumn("c", F.explode(F.transform(steps, lambda s: geo.bucket("lon") + s)))
    metres = geo.haversine_m("lat", "lon", "n_lat", "n_lon")
    best = near.join(nodes, ["r", "c"]).groupBy("id").agg(F.min(F.struct(metres.alias("metres"), "node")).alias("best"))
    return best.select("id", "best.node", "best.metres")


class Areas:
    """The edges about trips (trip, start, goal), area by area, for tasks that hold an area's graph each.

    trips are those of at most ROAD_TRIP_MOST_M, so no area has more than some tiles, with the task that has their area. Trips whose
    areas hold the same tiles with edges share one; an edge is in every area that the tile it begins in belongs to. An area with many
    trips is divided among several tasks, those from one start together as far as may be.
    """

    def __init__(self, trips: DataFrame, edges: DataFrame):
        self.edges = cut(edges.select("u", "v", "secs", "blocked", tile_of(F.col("u")).alias("tile")))
        box = ["r0", "r1", "c0", "c1"]
        placed = trip_tiles(trips.select("trip", "start", "goal")).where(F.col("trip_m") <= ROAD_TRIP_MOST_M)
        there = tiles_between(placed.select(*box).distinct(), TILE_E7).join(self.edges.select("tile").distinct(), "tile")
        tiles = cut(there.groupBy(*box).agg(F.sort_array(F.collect_list("tile")).alias("tiles")))
        name = F.sha1(F.concat_ws(":", "tiles").cast("binary"))
        self.tiles = cut(tiles.select(name.alias("area"), F.explode("tiles").alias("tile")).distinct())
        placed = placed.join(tiles, box, "left").select("trip", "start", "goal", F.coalesce(name, F.concat_ws(":", *box)).alias("area"))
        starts = placed.groupBy("area", "start").agg(F.count(F.lit(1)).alias("n"))
        shares = starts.withColumns({"shares": F.ceil(F.col("n") / TASK_TRIPS), "tasks": F.ceil(F.sum("n").over(W.partitionBy("area")) / TASK_TRIPS)}).drop("n")
        part = F.pmod(F.xxhash64("start", F.pmod(F.xxhash64("trip"), F.col("shares"))), F.col("tasks"))
        self.trips = cut(placed.join(shares, ["area", "start"]).select("trip", "start", "goal", "area", F.concat_ws("/", "area", part).alias("task")))

    def held(self, asked: DataFrame) -> DataFrame:
        """Rows (of_task, u, v, secs, blocked): the edges of asked rows' tasks (area, task)."""
        wanted = asked.select("area", F.col("task").alias("of_task")).distinct().join(self.tiles, "area").select("of_task", "tile")
        return self.edges.join(wanted, "tile").select("of_task", "u", "v", "secs", "blocked")


class Roads:
    """A task's graph, for quickest paths that use no closed edge. Searches go on from where they ended: paths from one start with the same edges closed share one."""

    def __init__(self, edges: pd.DataFrame, penalty_s: float | None):
        self.ahead: dict[str, list[tuple[str, float, float, bool]]] = {}
        for u, v, secs, blocked in zip(*(edges[c].tolist() for c in ("u", "v", "secs", "blocked")), strict=True):
            if not blocked or penalty_s is not None:
                self.ahead.setdefault(u, []).append((v, secs + (penalty_s or 0.0) * blocked, secs, blocked))
        self.searches: OrderedDict[tuple, tuple] = OrderedDict()

    def edge(self, u: str, v: str) -> tuple[str, str, float, bool] | None:
        """The least dear of the edges from u to v."""
        found = min((e for e in self.ahead.get(u, ()) if e[0] == v), key=lambda e: e[1], default=None)
        return found and (u, v, *found[2:])

    def quickest(self, start: str, goal: str, closed: frozenset[tuple[str, str]]) -> tuple[float, list[tuple[str, str, float, bool]]] | None:
        """(cost, edges in order) of the quickest path, or None."""
        key = start, closed
        search = self.searches.pop(key, None) or ({start: 0.0}, {}, [(0.0, start)], set())
        self.searches[key] = search
        if len(self.searches) > SEARCHES:
            self.searches.popitem(last=False)
        best, came, heap, done = search
        while heap and goal not in done:
            cost, node = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            for v, more, secs, blocked in self.ahead.get(node, ()):
                if cost + more < best.get(v, math.inf) and (not closed or (node, v) not in closed):
                    best[v] = cost + more
                    came[v] = node, v, secs, blocked
                    heapq.heappush(heap, (cost + more, v))
        if goal not in done:
            return None
        edges, node = [], goal
        while node != start:
            edges.append(came[node])
            node = came[node][0]
        return best[goal], edges[::-1]


class Doubt(Exception):
    """Nothing is proved of a request."""


class Excerpt(Roads):
    """A task's part of the map (nearby.parts()): paths than which none outside the part is quicker; Doubt where that isn't sure."""

    def __init__(self, edges: pd.DataFrame, penalty_s: float | None):
        own, held = edges["own"].to_numpy(bool), set(edges["tile"])
        super().__init__(edges[own], penalty_s)
        self.outside = {v for v, b in edges.loc[own, ["v", "b"]].itertuples(index=False) if b not in held}
        # An edge between two tiles of the part is there twice.
        inside = set(edges.loc[own, "u"])
        self.enters = {v for u, v in edges.loc[~own, ["u", "v"]].itertuples(index=False) if u not in inside}
        self.back: dict[str, list[str]] = {}
        for u, ways in self.ahead.items():
            for e in ways:
                self.back.setdefault(e[0], []).append(u)
        self.sealed: dict[tuple, bool] = {}

    def quickest(self, start: str, goal: str, closed: frozenset[tuple[str, str]]) -> tuple[float, list[tuple[str, str, float, bool]]] | None:
        found = super().quickest(start, goal, closed)
        best, _, _, done = self.searches[start, closed]
        out = min((best[v] for v in self.outside if v in done), default=math.inf)
        if out == math.inf or (found and found[0] < out) or self._sealed(goal, closed):
            return found
        raise Doubt

    def _sealed(self, goal: str, closed: frozenset[tuple[str, str]]) -> bool:
        """Whether no way from outside leads to goal."""
        if (goal, closed) not in self.sealed:
            seen, todo = {goal}, [goal]
            while todo and todo[-1] not in self.enters:
                node = todo.pop()
                for u in self.back.get(node, ()):
                    if u not in seen and (u, node) not in closed:
                        seen.add(u)
                        todo.append(u)
            self.sealed[goal, closed] = not todo
        return self.sealed[goal, closed]


def reachable(edges: DataFrame, start: str, rounds: int) -> DataFrame:
    """Rows (node, secs): least time from a node within `rounds` edges, by relaxation over the whole edge table; for graphs that no task holds."""
    best = edges.sparkSession.createDataFrame([(start, 0.0)], "node string, secs double")
    for step in range(rounds):
        step_on = edges.select(F.col("u").alias("node"), "v", F.col("secs").alias("more"))
        # What is reached may be all nodes in the end; the edges stay where they are either way.
        reached = best.hint("merge").join(step_on, "node").select(F.col("v").alias("node"), (F.col("secs") + F.col("more")).alias("secs"))
        best = best.unionByName(reached).groupBy("node").agg(F.min("secs").alias("secs"))
        if step % 4 == 3:
            best = cut(best)
    return best


#: Requests a plan may make, and segments it may exclude.
REQUESTS, EXCLUSIONS = 8, 50
#: Trips that one task plans with one copy of their area's edges, and searches that it keeps.
TASK_TRIPS, SEARCHES = 500, 16
PATH = "array<struct<u: string, v: string, secs: double, blocked: boolean>>"
PLAN = "trip long, outcome string, requests int, excluded int, given_up int, limit string, fastest_s double, fastest_blocked int, best_s double, best_blocked int, path " + PATH


def _place(node: str) -> tuple[float, float]:
    lat, lon = node.split(":")
    return int(lat) / DEGREES, int(lon) / DEGREES


def _apart(a: tuple[float, float], b: tuple[float, float]) -> float:
    k = math.cos(math.radians(a[0]))
    return METRES_PER_DEGREE * math.hypot(a[0] - b[0], ((a[1] - b[1] + 180) % 360 - 180) * k)


def _planned(graph: Roads, start: str, goal: str, most: int) -> tuple:
    """A trip's row of PLAN but for its number, with at most so many requests."""
    ends = _place(start), _place(goal)
    reach = max(CORRIDOR_LEAST_M, CORRIDOR_SHARE * _apart(*ends)) / METRES_PER_DEGREE
    wide = reach / max(0.01, math.cos(math.radians((ends[0][0] + ends[1][0]) / 2)))
    spans = [(min(e[i] for e in ends) - r, max(e[i] for e in ends) + r) for i, r in ((0, reach), (1, wide))]
    middle = lambda e: tuple((x + y) / 2 for x, y in zip(_place(e[0]), _place(e[1]), strict=True))
    near_end = lambda e: min(_apart(p, q) for p in map(_place, e) for q in ends)
    closed: list[tuple[str, str]] = []
    batch: list[tuple[str, str]] = []
    given_up: set[tuple[str, str]] = set()
    answers, requests, limit = [], 0, None
    while True:
        requests += 1
        found = graph.quickest(start, goal, frozenset(closed))
        if found is None:
            if not batch:
                break
            # Something of the last batch can't be driven around: what is nearest to an end is given up first.
            edge = min(batch, key=near_end)
            batch.remove(edge)
            closed.remove(edge)
            given_up.add(edge)
        else:
            hits = [e[:2] for e in found[1] if e[3]]
            answers.append((len(hits), found[0], len(answers), found[1]))
            batch = []
            for edge in hits:
                if edge in given_up or near_end(edge) <= AVOID_M:
                    continue
                if not all(low <= x <= high for x, (low, high) in zip(middle(edge), spans, strict=True)):
                    given_up.add(edge)
                elif len(closed) + len(batch) >= EXCLUSIONS:
                    given_up.add(edge)
                    limit = "exclusions"
                else:
                    batch.append(edge)
            if not batch:
                break
            closed += batch
        if requests >= most:
            limit = limit or "requests"
            break
    if not answers:
        return ("no_route", requests, 0, 0, limit, None, None, None, None, None)
    first, best = answers[0], min(answers)
    outcome = "clear" if not best[0] else "reduced" if best[0] < first[0] else "unchanged"
    return (outcome, requests, len(closed), len(given_up), limit, first[1], first[0], best[1], best[0], best[3])


class _Answered:
    """A router whose answers are known, as far as there are any."""

    def __init__(self, answers: list[str | None]):
        self.answers = iter(answers)
        self.closed: frozenset[tuple[str, str]] = frozenset()

    def quickest(self, start: str, goal: str, closed: frozenset[tuple[str, str]]) -> tuple[float, list[tuple[str, str, float, bool]]] | None:
        self.closed = closed
        try:
            found = next(self.answers)
        except StopIteration:
            raise Doubt from None
        if found is None:
            return None
        found = json.loads(found)
        return found["cost"], [(e["u"], e["v"], e["secs"], e["blocked"]) for e in found["path"]]


PLAN_NAMES = [c.split(" ")[0] for c in PLAN.removesuffix(PATH).split(", ")[:-1]] + ["path"]
COUNTS = {"fastest_blocked": "Int32", "best_blocked": "Int32"}


def _open(trip: int) -> tuple:
    """A row of PLAN without an outcome."""
    return (trip, None, 0, 0, 0, *[None] * 6)


def _planned_over(trips: DataFrame, road_map: Overlay, requests: int) -> DataFrame:
    """Rows of PLAN of trips (trip, start, goal), by requests of all open trips together to the whole map, in rounds."""

    def judge(batches):
        for rows in batches:
            plans, asked = [], []
            for trip, start, goal, answers in rows[["trip", "start", "goal", "answers"]].itertuples(index=False):
                graph = _Answered(list(answers))
                try:
                    plans.append((trip, *_planned(graph, start, goal, requests)))
                    asked.append(None)
                except Doubt:
                    plans.append(_open(trip))
                    asked.append([{"u": u, "v": v} for u, v in sorted(graph.closed)])
            yield pd.DataFrame(plans, columns=PLAN_NAMES).astype(COUNTS).assign(closed=asked)

    state, plans = cut(trips.select("trip", "start", "goal", F.array().cast("array<string>").alias("answers"))), []
    while True:
        judged = cut(state.mapInPandas(judge, PLAN + ", closed array<struct<u: string, v: string>>"))
        plans.append(judged.where("outcome IS NOT NULL").drop("closed"))
        asked = judged.where("outcome IS NULL").select("trip", "closed")
        if asked.isEmpty():
            return reduce(DataFrame.unionByName, plans)
        state = cut(state.join(asked.select("trip"), "trip", "left_semi"))
        closed = asked.select("trip", F.explode("closed").alias("e")).select("trip", "e.*")
        solved = road_map.solve(state, None if closed.isEmpty() else closed)
        steps = F.sort_array(F.collect_list(F.struct("nth", F.struct("u", "v", "secs", "blocked").alias("e"))))
        paths = road_map.paths(solved).groupBy("trip").agg(F.transform(steps, lambda x: x["e"]).alias("path"))
        none = F.array().cast(paths.schema["path"].dataType)
        answers = solved.select("trip", "cost").join(paths, "trip", "left").select("trip", F.to_json(F.struct("cost", F.coalesce("path", none).alias("path"))).alias("answer"))
        state = cut(state.join(answers, "trip", "left").withColumn("answers", F.concat("answers", F.array("answer"))).drop("answer"))


def plan_exclusions(trips: DataFrame, edges: DataFrame, requests: int = REQUESTS) -> DataFrame:
    """Plans of trips (trip, start, goal) by asking for a route again and again without the blocked segments met so far.

    Each answer's blocked segments are excluded from the next request, as many as may be, but for
    those at an end of the trip (within AVOID_M) and those outside its corridor. Where no route is
    left, the one of the last batch that is nearest to an end is given up. It ends with an answer
    that has none to exclude, or when requests are used up; limit names the limit that was met. The
    best answer (path) has the fewest blocked segments, then the least time; the first of equals. The
    router here is the whole map, whatever the trip's length: a task holds the part of it about some trips (nearby.parts()) and plans those
    whose every answer is proved, others are planned in wider parts, and in the end by rounds over the overlay. Trips from one start share searches.
    """

    def plan(key, trips: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        graph, rows = Excerpt(edges, 0.0), []
        for trip, start, goal in trips[["trip", "start", "goal"]].sort_values("start").itertuples(index=False):
            try:
                rows.append((trip, *_planned(graph, start, goal, requests)))
            except Doubt:
                rows.append(_open(trip))
        return pd.DataFrame(rows, columns=PLAN_NAMES).astype(COUNTS)

    road_map = Overlay(edges, 0.0)
    open_, tiles = road_map.placed(trips.select("trip", "start", "goal"))
    wide, plans, left = 1, [], []
    while True:
        taken, held, over = nearby.parts(open_, tiles, road_map.edges, wide, road_map.made, TASK_TRIPS)
        left.append(over.select("trip", "start", "goal"))
        got = cut(taken.groupBy("task").cogroup(held.groupBy("of_task")).applyInPandas(plan, PLAN))
        plans.append(got.where("outcome IS NOT NULL"))
        doubt = got.where("outcome IS NULL").select("trip")
        if doubt.isEmpty():
            break
        open_, wide = cut(taken.join(doubt, "trip", "left_semi").drop("task", "part")), wide * 4
    rest = reduce(DataFrame.unionByName, left)
    if not rest.isEmpty():
        plans.append(_planned_over(rest, road_map, requests))
    return reduce(DataFrame.unionByName, plans)


def road_check(trips: DataFrame, edges: DataFrame, missing: DataFrame, margin_m: float = ROAD_AREA_LEAST_M, tile_e7: int = TILE_E7) -> DataFrame:
    """Rows (trip, status, blocked, secs): what the road map says of trips (trip, start, goal), where tiles in missing (tile) haven't arrived.

    free: a path without blocked segments, which is real on part of a map as well; partial: there is none
    in what is there of the trip's area, and a missing tile may hold one, so nothing is claimed; fewest: there is none, and
    the best path has so many blocked ones; unconnected; too_long: over ROAD_TRIP_MOST_M, not looked up.
    """
    placed = cut(trip_tiles(trips.select("trip", "start", "goal"), margin_m, tile_e7))
    asked = placed.where(F.col("trip_m") <= ROAD_TRIP_MOST_M)
    # Of the tiles between them, those beyond a pole are many; trips share boxes.
    box = ["r0", "r1", "c0", "c1"]
    partial = tiles_between(asked.select(*box).distinct(), tile_e7).join(missing.select("tile").distinct(), "tile", "left_semi").select(*box).distinct().withColumn("partial", F.lit(True))
    free = Overlay(edges, None, tile_e7).solve(asked, area_m=margin_m).select("trip", F.col("cost").alias("free_s"))
    state = cut(placed.join(free, "trip", "left").join(partial, box, "left"))
    rest = state.where((F.col("trip_m") <= ROAD_TRIP_MOST_M) & F.col("free_s").isNull() & F.col("partial").isNull())
    fewest = Overlay(edges, BLOCKED_PENALTY_S, tile_e7).solve(rest, area_m=margin_m).select("trip", "cost", F.col("blocked").alias("hit"))
    both = state.join(fewest, "trip", "left")
    status = F.when(F.col("trip_m") > ROAD_TRIP_MOST_M, "too_long").when(F.col("free_s").isNotNull(), "free").when(F.col("partial"), "partial").when(F.col("hit").isNotNull(), "fewest").otherwise("unconnected")
    blocked = F.when(F.col("free_s").isNotNull(), F.lit(0).cast("long")).otherwise(F.col("hit"))
    return both.select("trip", status.alias("status"), blocked.alias("blocked"), F.coalesce("free_s", F.col("cost") - F.col("hit") * BLOCKED_PENALTY_S).alias("secs"))


def blocked_stretches(paths: DataFrame, gap_m: float, margin_m: float) -> DataFrame:
    """Rows (trip, stretch, first, last, blocked, secs, start, goal): runs of blocked edges of paths (trip, nth, u, v, secs, blocked) at most `gap_m` apart.

    first and last number the edges to be driven anew: the run, and up to `margin_m` on either side,
    but no edge of the stretch before; start and goal are their ends, secs the time that they take now.
    """
    w = W.partitionBy("trip").orderBy("nth")
    length = geo.haversine_m(node_lat("u"), node_lon("u"), node_lat("v"), node_lon("v"))
    placed = paths.withColumn("length_m", length).withColumn("end_m", F.sum("length_m").over(w)).withColumn("start_m", F.col("end_m") - F.col("length_m"))
    hits = placed.where("blocked").withColumn("new", F.coalesce(F.col("start_m") - F.lag("end_m").over(w), F.lit(float("inf"))) > gap_m)
    hits = hits.withColumn("stretch", F.sum(F.col("new").cast("int")).over(w))
    runs = hits.groupBy(F.col("trip").alias("of"), "stretch").agg(F.min("start_m").alias("from_m"), F.max("end_m").alias("to_m"), F.count(F.lit(1)).alias("blocked_n"))
    inside = (F.col("end_m") > F.col("from_m") - margin_m) & (F.col("start_m") < F.col("to_m") + margin_m)
    around = placed.join(runs, F.col("trip") == F.col("of")).where(inside)
    # An edge between two stretches belongs to the first.
    around = around.withColumn("of_first", F.min("stretch").over(W.partitionBy("trip", "nth"))).where("stretch = of_first").drop("of", "of_first", "blocked_n")
    own = F.count_if("blocked")
    ends = around.groupBy("trip", "stretch").agg(F.min("nth").alias("first"), F.max("nth").alias("last"), own.alias("blocked"), F.sum("secs").alias("secs"), F.min_by("u", "nth").alias("start"), F.max_by("v", "nth").alias("goal"))
    return ends.where("blocked > 0")


def splice(paths: DataFrame, fixes: DataFrame) -> DataFrame:
    """Rows (trip, nth, u, v, secs, blocked): paths with the edges first to last replaced by those of fixes (trip, first, last, path), numbered anew.

    Stretches of one trip don't overlap. Other trips' edges stay as they are.
    """
    spans = fixes.select("trip", F.explode(F.sequence("first", "last")).alias("nth"))
    rest = paths.join(spans, ["trip", "nth"], "left_anti").select("trip", F.col("nth").alias("at"), F.lit(0).alias("i"), "u", "v", "secs", "blocked")
    new = fixes.select("trip", F.col("first").alias("at"), F.posexplode("path").alias("i", "e")).select("trip", "at", "i", "e.*")
    nth = F.row_number().over(W.partitionBy("trip").orderBy("at", "i")) - 1
    return rest.unionByName(new).select("trip", nth.cast("int").alias("nth"), "u", "v", "secs", "blocked")


def stretch_repair(paths: DataFrame, edges: DataFrame, gap_m: float, margin_m: float, limit_s: float, budget: int = REPAIR_REQUESTS) -> DataFrame:
    """Rows (trip, stretch, turn, first, last, blocked, left, extra_s, status, path) of the stretches with blocked edges of paths (trip, nth, u, v, secs, blocked).

    A trip's stretches are routed anew in the order of their blocked edges, most first (turn), between their ends
    without these edges (plan_exclusions() with LOCAL_REQUESTS); those whose turn comes after `budget`
    requests of the trip aren't (unserved). Where a stretch keeps blocked edges or takes too long, the road map of its
    area is searched for the way with the fewest. It is fixed (path) where a way passes fewer and takes at most `limit_s` longer for
    each one saved, slow where the ways that pass fewer take longer, else kept. splice() puts fixes into the paths.
    """
    runs = cut(blocked_stretches(paths, gap_m, margin_m))
    turn = F.row_number().over(W.partitionBy("trip").orderBy(F.desc("blocked"), "stretch"))
    runs = cut(runs.withColumn("turn", turn).withColumn("id", F.xxhash64("trip", "stretch")))
    local = runs.select(F.col("id").alias("trip"), "start", "goal")
    plans = cut(plan_exclusions(local, edges, LOCAL_REQUESTS).select(F.col("trip").alias("id"), "requests", F.col("best_s").alias("s1"), F.col("best_blocked").cast("long").alias("b1"), F.col("path").alias("p1")))
    asked = F.coalesce(F.sum("requests").over(W.partitionBy("trip").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    both = runs.join(plans, "id", "left").withColumn("served", asked < budget)

    def worth(blocked: Column, secs: Column) -> Column:
        saved = F.col("blocked") - blocked
        return F.coalesce((saved > 0) & (secs - F.col("secs") <= saved * limit_s), F.lit(False))

    both = cut(both.withColumn("done", worth(F.col("b1"), F.col("s1")) & (F.col("b1") == 0)))
    road = Overlay(edges, BLOCKED_PENALTY_S)
    solved = road.solve(both.where("served AND NOT done").select(F.col("id").alias("trip"), "start", "goal"), area_m=ROAD_AREA_LEAST_M)
    steps = road.paths(solved).groupBy("trip").agg(F.sort_array(F.collect_list(F.struct("nth", F.struct("u", "v", "secs", "blocked").alias("e")))).alias("es"))
    ways = solved.join(steps, "trip").select(F.col("trip").alias("id"), (F.col("cost") - F.col("blocked") * BLOCKED_PENALTY_S).alias("s2"), F.col("blocked").alias("b2"), F.transform("es", lambda x: x["e"]).cast(PATH).alias("p2"))
    both = both.join(ways, "id", "left")
    option = lambda n: F.struct(F.col(f"b{n}").alias("b"), F.col(f"s{n}").alias("s"), F.lit(n).alias("n"))
    options = F.array_compact(F.array(*(F.when(worth(F.col(f"b{n}"), F.col(f"s{n}")), option(n)) for n in (1, 2))))
    both = both.withColumn("best", F.when(F.col("served"), F.get(F.array_sort(options), 0)))
    fewer = F.coalesce(F.least("b1", "b2") < F.col("blocked"), F.lit(False))
    status = F.when(~F.col("served"), "unserved").when(F.col("best").isNotNull(), "fixed").when(fewer, "slow").otherwise("kept")
    path = F.when(F.col("best.n") == 1, F.col("p1")).when(F.col("best.n") == 2, F.col("p2"))
    return both.select("trip", "stretch", "turn", "first", "last", "blocked", F.coalesce("best.b", "blocked").alias("left"), F.coalesce(F.col("best.s") - F.col("secs"), F.lit(0.0)).alias("extra_s"), status.alias("status"), path.alias("path"))
