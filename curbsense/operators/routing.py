"""Trips by requests to a router: all open requests of all trips go out in rounds, and what is known of a trip is a row of a table.

A stop of a request is a node, or an edge "u>v" that is to be driven in its direction.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbsense.constants import (
    AVOID_M,
    CORRIDOR_LEAST_M,
    CORRIDOR_SHARE,
    GUIDED_REQUESTS,
    LEAST_COS,
    LEG_TRIES,
    METRES_PER_DEGREE,
    REFUSED_M,
    REFUSED_SHARE,
    REJOIN_REQUESTS,
    REPLAN_GUIDED_REQUESTS,
    REPLAN_REQUESTS,
    REPLANS,
)
from curbsense.functions import geo
from curbsense.operators import guidance, roads
from curbsense.operators.overlay import DEGREES, node_lat, node_lon
from curbsense.operators.roads import EXCLUSIONS, PATH
from curbsense.operators.tables import cut

ANSWER = "trip long, request int, status string, path " + PATH
KEYS = "array<string>"


class Router(Protocol):
    """What answers requests."""

    def answer(self, requests: DataFrame) -> DataFrame:
        """Rows (trip, request, status, path) for requests (trip, request, stops, excluded).

        status is ok, no_route or too_many (exclusions); path is array<struct(u, v, secs, blocked)>. The edges in excluded ("u>v")
        aren't to be driven. A request may stay without an answer, which counts as no_route.
        """
        ...


class GraphRouter:
    """A router that drives a table of edges (u, v, secs, blocked) about the given trips (trip, start, goal), by least time.

    A blocked edge costs penalty_s more; with None it isn't driven. Trips of over ROAD_TRIP_MOST_M get no answers. A task
    holds the edges of one area; an area with many trips is divided among several tasks.
    """

    def __init__(self, edges: DataFrame, trips: DataFrame, penalty_s: float | None = 0.0, most_excluded: int | None = None):
        self.areas, self.penalty_s, self.most_excluded = roads.Areas(trips, edges), penalty_s, most_excluded

    def answer(self, requests: DataFrame) -> DataFrame:
        penalty_s, most = self.penalty_s, self.most_excluded

        def drive(asks: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
            graph, rows = roads.Roads(edges, penalty_s), []
            asks = asks.assign(at=asks["stops"].map(lambda stops: stops[0])).sort_values("at")
            for trip, request, stops, excluded in asks[["trip", "request", "stops", "excluded"]].itertuples(index=False):
                closed = frozenset(tuple(e.split(">")) for e in excluded)
                if most is not None and len(closed) > most:
                    rows.append((trip, request, "too_many", None))
                    continue
                path = _driven(graph, list(stops), closed)
                rows.append((trip, request, "no_route" if path is None else "ok", path))
            return pd.DataFrame(rows, columns=["trip", "request", "status", "path"])

        asked = requests.join(self.areas.trips.select("trip", "area", "task"), "trip")
        held = self.areas.held(asked)
        return asked.groupBy("task").cogroup(held.groupBy("of_task")).applyInPandas(drive, ANSWER)


def _driven(graph: roads.Roads, stops: list[str], closed: frozenset) -> list[tuple[str, str, float, bool]] | None:
    """Edges of the quickest way by the stops, or None."""
    at, path = stops[0].split(">")[-1], []
    for stop in stops[1:]:
        u, _, v = stop.partition(">")
        found, through = graph.quickest(at, u, closed), graph.edge(u, v) if v and (u, v) not in closed else None
        if found is None or (v and through is None):
            return None
        path += found[1] + [through] * bool(v)
        at = v or u
    return path


def _at(node: Column, i: int) -> Column:
    return F.split(node, ":")[i].cast("double") / DEGREES


def edge_key(e: Column) -> Column:
    return F.concat_ws(">", e["u"], e["v"])


def metres(path: Column) -> Column:
    """Length of an array of edges."""
    return F.aggregate(path, F.lit(0.0), lambda m, e: m + geo.haversine_m(_at(e["u"], 0), _at(e["u"], 1), _at(e["v"], 0), _at(e["v"], 1)))


def seconds(path: Column) -> Column:
    return F.aggregate(path, F.lit(0.0), lambda s, e: s + e["secs"])


def blocked_edges(path: Column) -> Column:
    return F.filter(path, lambda e: e["blocked"])


def _end_m(e: Column) -> Column:
    """Metres from an edge to the nearer end of its trip (start, goal)."""
    return F.least(*(geo.haversine_m(_at(e[n], 0), _at(e[n], 1), node_lat(end), node_lon(end)) for n in "uv" for end in ("start", "goal")))


def stop_places(stops: Column) -> Column:
    """array<struct(lat, lon, through, heading)> of a request's stops, for routers that take places: an edge is its middle, passed in its direction."""

    def place(stop: Column) -> Column:
        ends = F.split(stop, ">")
        through, u = F.size(ends) > 1, ends[0]
        v = F.coalesce(F.get(ends, 1), u)
        middle = lambda i: (_at(u, i) + _at(v, i)) / 2
        heading = F.when(through, geo.bearing_deg(_at(u, 0), _at(u, 1), _at(v, 0), _at(v, 1)))
        return F.struct(middle(0).alias("lat"), middle(1).alias("lon"), through.alias("through"), heading.alias("heading"))

    return F.transform(stops, place)


def _in_corridor(e: Column) -> Column:
    """Whether an edge's middle is about the box of its trip's ends."""
    lat, lon = [(_at(e["u"], i) + _at(e["v"], i)) / 2 for i in (0, 1)]
    la1, lo1, la2, lo2 = node_lat("start"), node_lon("start"), node_lat("goal"), node_lon("goal")
    reach = F.greatest(F.lit(CORRIDOR_LEAST_M), CORRIDOR_SHARE * geo.haversine_m(la1, lo1, la2, lo2)) / METRES_PER_DEGREE
    wide = reach / F.greatest(F.lit(LEAST_COS), F.cos(F.radians((la1 + la2) / 2)))
    return lat.between(F.least(la1, la2) - reach, F.greatest(la1, la2) + reach) & lon.between(F.least(lo1, lo2) - wide, F.greatest(lo1, lo2) + wide)


def excluding(asks: DataFrame, router: Router, give_up: bool = False) -> DataFrame:
    """Rows (trip, requests, excluded, first, best) of asks (trip, start, goal, most): ways that pass few blocked edges, found in at most `most` requests.

    An answer's blocked edges are excluded from the trip's next request, at most EXCLUSIONS, but for those at an end of the trip
    (within AVOID_M). It ends with an answer that has none to exclude, or without a route. With give_up, edges outside the trip's corridor aren't
    excluded either, and where no route is left, the edge of the last batch that is nearest to an end is given up and the request made again.
    first and best are paths, null without any answer: best has the fewest blocked edges (without give_up those at an end don't count), then the
    least time; the first of equals.
    """
    none = F.array().cast(KEYS)
    best = F.lit(None).cast(f"struct<hits: int, secs: double, path: {PATH}>")
    state = asks.select("trip", "start", "goal", F.col("most").cast("int").alias("most"), F.lit(0).alias("requests"), none.alias("excluded"), none.alias("batch"), none.alias("given"), F.lit(None).cast(PATH).alias("first"), best.alias("best"), (F.col("most") > 0).alias("open"))
    state = cut(state)
    while not state.where("open").isEmpty():
        asked = state.where("open").select("trip", F.col("requests").alias("request"), F.array("start", "goal").alias("stops"), "excluded")
        rows = state.where("open").join(cut(router.answer(asked)).drop("request"), "trip", "left")
        rows = rows.withColumns({"ok": F.coalesce(F.col("status") == "ok", F.lit(False)), "barred": F.coalesce(F.col("status") == "too_many", F.lit(False))})
        at_end = lambda e: _end_m(e) <= AVOID_M
        rows = rows.withColumn("strays", F.filter(blocked_edges(F.coalesce("path", F.array().cast(PATH))), lambda e: ~at_end(e)))
        outside = F.filter("strays", lambda e: ~_in_corridor(e)) if give_up else F.array().cast(PATH)
        keys = lambda edges: F.array_distinct(F.transform(edges, edge_key))
        rows = rows.withColumn("given", F.array_union("given", keys(outside)))
        rows = rows.withColumn("new", F.array_except(F.array_except(keys("strays"), "given"), "excluded"))
        room = F.greatest(F.lit(0), EXCLUSIONS - F.size("excluded"))
        # Without a route, the last batch's edge nearest to an end goes back.
        nearest = F.array_min(F.transform("batch", lambda k: F.struct(_end_m(F.struct(F.split(k, ">")[0].alias("u"), F.split(k, ">")[1].alias("v"))).alias("m"), F.array_position("batch", k).alias("at"), k.alias("k"))))["k"]
        back = (~F.col("ok") & ~F.col("barred") & (F.size("batch") > 0)) if give_up else F.lit(False)
        rows = rows.withColumns({"back": back, "gone": F.when(back, F.array(nearest)).otherwise(none), "take": F.when(F.col("ok"), F.slice("new", F.lit(1), room)).otherwise(none)})
        hits = F.size(blocked_edges(F.col("path")) if give_up else F.col("strays"))
        answer = F.struct(hits.alias("hits"), seconds(F.col("path")).alias("secs"), F.col("path").alias("path"))
        better = F.col("ok") & (F.col("best").isNull() | (answer["hits"] < F.col("best.hits")) | ((answer["hits"] == F.col("best.hits")) & (answer["secs"] < F.col("best.secs"))))
        rows = rows.withColumns(
            {
                "best": F.when(better, answer).otherwise(F.col("best")),
                "first": F.coalesce("first", "path"),
                "requests": F.col("requests") + 1,
                "excluded": F.array_except(F.array_union("excluded", "take"), "gone"),
                "given": F.array_union(F.array_union("given", "gone"), F.when(F.col("ok"), F.array_except("new", "take")).otherwise(none)),
                "batch": F.when(F.col("ok"), F.col("take")).otherwise(F.array_except("batch", "gone")),
            }
        )
        rows = rows.withColumn("open", (F.col("requests") < F.col("most")) & (F.col("back") | (F.col("ok") & (F.size("take") > 0))))
        state = cut(rows.select(*state.columns).unionByName(state.where("NOT open")))
    return state.select("trip", "requests", F.size("excluded").alias("excluded"), "first", F.col("best.path").alias("best"))


LEG = f"trip long, plan int, leg int, start string, goal string, from string, stops {KEYS}, edges {KEYS}, metres double, allowed {KEYS}, tries int, excluded {KEYS}, best struct<strays: int, secs: double, path: {PATH}>, status string"


def _legs(planned: DataFrame, leg_m: float) -> DataFrame:
    """Open legs (LEG) of planned trips (trip, start, goal, plan, path)."""
    nodes = planned.select("trip", F.posexplode(F.concat(F.transform("path", lambda e: e["u"]), F.array(F.element_at("path", -1)["v"]))).alias("pos", "node"))
    cuts = guidance.plan_legs(nodes.select("trip", "pos", node_lat("node").alias("lat"), node_lon("node").alias("lon")), leg_m)
    own = F.slice("path", F.col("first") + 1, F.col("last") - F.col("first"))
    rows = cuts.join(planned, "trip").withColumn("own", own)
    key = lambda s: edge_key(F.get("path", s))
    stops = F.concat(F.array(F.element_at("own", 1)["u"]), F.transform("vias", key), F.array(F.element_at("own", -1)["v"]))
    none, fresh = F.array().cast(KEYS), F.lit(None).cast(f"struct<strays: int, secs: double, path: {PATH}>")
    rows = rows.select("trip", "plan", "leg", "start", "goal", F.element_at("own", 1)["u"].alias("from"), stops.alias("stops"), F.transform("own", edge_key).alias("edges"), metres(F.col("own")).alias("metres"), F.transform(blocked_edges(F.col("path")), edge_key).alias("allowed"), F.lit(0).alias("tries"), none.alias("excluded"), fresh.alias("best"), F.lit("open").alias("status"))
    return rows.to(planned.sparkSession.createDataFrame([], LEG).schema)


def _tried(legs: DataFrame, answers: DataFrame, replans: int) -> DataFrame:
    """Legs after the answers to their requests: clear, refused, or open for another try."""
    rows = legs.join(answers.withColumnRenamed("request", "leg").withColumn("answered", F.lit(True)), ["trip", "leg"], "left")
    rows = rows.withColumn("strays", F.filter(blocked_edges(F.coalesce("path", F.array().cast(PATH))), lambda e: ~F.array_contains("allowed", edge_key(e)) & (_end_m(e) > AVOID_M)))
    n, ok = F.size("strays"), F.col("status_of") == "ok"
    answer = F.struct(n.alias("strays"), seconds(F.col("path")).alias("secs"), F.col("path").alias("path"))
    better = ok & (F.col("best").isNull() | (n < F.col("best.strays")) | ((n == F.col("best.strays")) & (answer["secs"] < F.col("best.secs"))))
    rows = rows.withColumn("best", F.when(better, answer).otherwise(F.col("best")))
    detour = metres(F.col("path")) > F.col("metres") * REFUSED_SHARE + REFUSED_M
    refused = ~ok | detour | (F.col("tries") + 1 >= LEG_TRIES)
    # In the last plan the best of the answers has to do.
    given_up = F.when((F.col("plan") == replans) & F.col("best").isNotNull(), "clear").otherwise("refused")
    status = F.when(ok & (n == 0), "clear").when(refused, given_up).otherwise("open")
    asked = F.coalesce("answered", F.lit(False))
    more = F.slice(F.array_union("excluded", F.transform("strays", edge_key)), 1, EXCLUSIONS)
    return rows.withColumns({"tries": F.col("tries") + asked.cast("int"), "excluded": F.when(asked, more).otherwise(F.col("excluded")), "status": F.when(asked, status).otherwise(F.col("status"))}).select(*legs.columns)


def guide(trips: DataFrame, road_map: Router, router: Router, leg_m: float = guidance.LEG_M, at_once: int = guidance.LEGS, replans: int = REPLANS) -> DataFrame:
    """Rows (trip, outcome, requests, plans, path): trips (trip, start, goal, budget) kept by the router on the paths of the road map, leg by leg.

    A leg is asked for by the points that plan_legs() names. Where an answer passes blocked edges that the path doesn't and that aren't at an end of the trip,
    they are excluded and the leg is asked for again, LEG_TRIES times at most. A leg is refused where it has no answer, where such an answer is much longer than the leg
    (REFUSED_SHARE, REFUSED_M), or where no try was clear: its edges are closed on the map, the legs before it stay, and the trip is planned anew from its start, up to `replans`
    times. After that the best answer of a leg is taken. Of a trip, up to `at_once` open legs are asked for in a round, in order; with 1, none is asked for in
    vain, with more there are fewer rounds. outcome is guided, no_path (the map has none left), no_answer, or requests (no more than budget are made). path is that of the answers, null unless guided.
    A trip from a node to itself is guided, with an empty path.
    """
    none = F.array().cast(KEYS)
    spark = trips.sparkSession
    state = cut(trips.select("trip", "start", "goal", F.col("budget").cast("int").alias("budget"), F.lit(0).alias("plan"), F.col("start").alias("from"), none.alias("closed"), F.lit(0).alias("requests"), F.lit(True).alias("fresh"), F.lit(None).cast("int").alias("stopped"), F.lit(None).cast("string").alias("outcome")))
    legs = cut(spark.createDataFrame([], LEG))
    while not state.where("outcome IS NULL").isEmpty():
        fresh = state.where("outcome IS NULL AND fresh")
        if not fresh.isEmpty():
            found = cut(road_map.answer(fresh.select("trip", F.col("plan").alias("request"), F.array("from", "goal").alias("stops"), F.col("closed").alias("excluded"))))
            planned = fresh.join(found.where("status = 'ok'").select("trip", "path"), "trip", "left")
            legs = legs.unionByName(_legs(planned.where("size(path) > 0").select("trip", "start", "goal", "plan", "path"), leg_m))
            ended = F.when(F.col("path").isNull(), "no_path").when(F.size("path") == 0, "guided")
            planned = planned.withColumns({"outcome": ended, "fresh": F.lit(False)}).drop("path")
            state = cut(planned.unionByName(state.where("outcome IS NOT NULL OR NOT fresh")))
            legs = cut(legs)
        now = legs.join(state.where("outcome IS NULL").select("trip", "plan", "budget", "requests"), ["trip", "plan"])
        w = W.partitionBy("trip").orderBy("leg")
        asked = now.where("status = 'open'").withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= F.least(F.lit(at_once), F.col("budget") - F.col("requests")))
        asked = cut(asked.select("trip", F.col("leg").alias("request"), "stops", "excluded"))
        answers = asked.select("trip", "request").join(router.answer(asked), ["trip", "request"], "left").select("trip", "request", F.coalesce("status", F.lit("no_route")).alias("status_of"), "path")
        running = state.where("outcome IS NULL")
        tried = cut(_tried(legs.join(running.select("trip", "plan"), ["trip", "plan"], "left_semi"), answers, replans))
        sums = tried.groupBy("trip").agg(F.min(F.when(F.col("status") == "refused", F.struct("leg", "from", "edges"))).alias("refused"), F.min(F.when(F.col("status") == "open", F.col("leg"))).alias("open_leg"))
        sums = sums.join(asked.groupBy("trip").agg(F.count(F.lit(1)).cast("int").alias("sent")), "trip", "left")
        after = running.drop("stopped").join(sums, "trip")
        waits = F.col("open_leg").isNotNull() & (F.col("refused").isNull() | (F.col("open_leg") < F.col("refused.leg")))
        after = after.withColumns({"requests": F.col("requests") + F.coalesce("sent", F.lit(0)), "anew": ~waits & F.col("refused").isNotNull() & (F.col("plan") < replans)})
        # A trip whose last request was spent on the refused leg has none for the next plan.
        spent = F.when(F.col("requests") >= F.col("budget"), "requests")
        outcome = F.when(waits | F.col("anew"), spent).when(F.col("refused").isNull(), "guided").otherwise("no_answer")
        moved = lambda new, old: F.when(F.col("anew"), new).otherwise(F.col(old))
        after = after.withColumns({"outcome": outcome, "fresh": F.col("anew"), "plan": F.col("plan") + F.col("anew").cast("int"), "from": moved(F.col("refused.from"), "from"), "closed": moved(F.array_union("closed", "refused.edges"), "closed"), "stopped": F.when(F.col("anew"), F.col("refused.leg"))})
        state = cut(after.select(*state.columns).unionByName(state.where("outcome IS NOT NULL")))
        # Of a plan that is given up, the legs before the refused one stay.
        stays = tried.join(state.select("trip", "stopped"), "trip").where("stopped IS NULL OR leg < stopped").select(*legs.columns)
        legs = cut(legs.join(running.select("trip", "plan"), ["trip", "plan"], "left_anti").select(*legs.columns).unionByName(stays))
    driven = legs.groupBy("trip").agg(F.sort_array(F.collect_list(F.struct("plan", "leg", F.col("best.path").alias("path")))).alias("parts"))
    whole = F.coalesce(F.flatten(F.transform("parts", lambda p: p["path"])), F.array().cast(PATH))
    out = state.join(driven, "trip", "left")
    return out.select("trip", "outcome", "requests", (F.col("plan") + 1).alias("plans"), F.when(F.col("outcome") == "guided", whole).alias("path"))


def reroute(cars: DataFrame, old: DataFrame, road_map: Router, router: Router, leg_m: float = guidance.LEG_M) -> DataFrame:
    """Rows (trip, status, requests, ahead, path): a new path for cars (trip, start, progress_m, fastest) that have left their paths old (trip, nth, u, v, secs, blocked).

    A fastest trip gets one request to its goal. Any other first gets up to REJOIN_REQUESTS back to its old path, at a node past rejoin_point(); that is taken (rejoined) where it
    passes no more blocked edges than the old path had ahead. The rest are planned anew from the car: REPLAN_REQUESTS by exclusion, then, where blocked edges are left,
    REPLAN_GUIDED_REQUESTS along the road map. Of all that was found the path with the fewest blocked edges is taken, then the quickest (rejoined, replanned or guided);
    no_route where there is none. Cars whose trip has no old path give no row.
    """
    w = W.partitionBy("trip").orderBy("nth")
    length = geo.haversine_m(node_lat("u"), node_lon("u"), node_lat("v"), node_lon("v"))
    # Read for lengths, marks and what is left of a path.
    placed = cut(old.withColumn("end_m", F.sum(length).over(w)).withColumn("start_m", F.coalesce(F.lag("end_m").over(w), F.lit(0.0))))
    lengths = placed.groupBy("trip").agg(F.max("end_m").alias("length_m"), F.max_by("v", "nth").alias("goal"))
    marks = placed.where("blocked").select(F.col("trip").alias("route"), ((F.col("start_m") + F.col("end_m")) / 2).alias("along_m"))
    asked = cars.where("NOT fastest").select(F.col("trip").alias("route"), "progress_m")
    rejoin = guidance.rejoin_point(asked, marks, lengths.withColumnRenamed("trip", "route")).select(F.col("route").alias("trip"), "rejoin_m")
    known = placed.join(cars.select("trip", "progress_m"), "trip").join(rejoin, "trip", "left")
    edge = F.struct("nth", F.struct("u", "v", "secs", "blocked").alias("e"))
    rest = F.transform(F.sort_array(F.collect_list(F.when(F.col("start_m") >= F.col("rejoin_m"), edge))), lambda x: x["e"]).cast(PATH)
    ahead = known.groupBy("trip").agg(F.count_if(F.col("blocked") & (F.col("end_m") > F.col("progress_m"))).alias("ahead"), rest.alias("rest"))
    cars = cut(cars.select("trip", "start", "fastest").join(lengths.select("trip", "goal"), "trip").join(ahead, "trip"))
    joins = ~F.col("fastest") & (F.size("rest") > 0)
    first = cars.where("fastest OR size(rest) > 0").select("trip", "start", F.when(joins, F.get("rest", 0)["u"]).otherwise(F.col("goal")).alias("goal"), F.when(joins, REJOIN_REQUESTS).otherwise(1).alias("most"))
    back = excluding(first, router).select("trip", F.col("requests").alias("n1"), F.col("best").alias("way"))
    count = lambda p: F.size(blocked_edges(F.col(p)))
    cars = cars.join(back, "trip", "left").withColumn("p1", F.when(F.col("fastest"), F.col("way")).when(F.col("way").isNotNull(), F.concat("way", "rest")))
    cars = cut(cars.withColumn("done", F.col("fastest") | F.coalesce(F.col("p1").isNotNull() & (count("p1") <= F.col("ahead")), F.lit(False))))
    plans = cut(excluding(cars.where("NOT done").select("trip", "start", "goal", F.lit(REPLAN_REQUESTS).alias("most")), router, give_up=True).select("trip", F.col("requests").alias("n2"), F.col("best").alias("p2")))
    left = cars.join(plans, "trip").where(F.col("p2").isNull() | (count("p2") > 0)).select("trip", "start", "goal", F.lit(REPLAN_GUIDED_REQUESTS).alias("budget"))
    guided = guide(left, road_map, router, leg_m).select("trip", F.col("requests").alias("n3"), F.col("path").alias("p3"))
    every = cars.join(plans, "trip", "left").join(guided, "trip", "left")
    names = {1: F.when(F.col("fastest"), "fastest").otherwise("rejoined"), 2: F.lit("replanned"), 3: F.lit("guided")}
    option = lambda i: F.when(F.col(f"p{i}").isNotNull(), F.struct(count(f"p{i}").alias("hits"), seconds(F.col(f"p{i}")).alias("secs"), F.lit(i).alias("i"), names[i].alias("status"), F.col(f"p{i}").alias("path")))
    options = F.array_compact(F.array(*map(option, (1, 2, 3))))
    best = F.get(F.array_sort(options, lambda a, b: F.when((a["hits"] < b["hits"]) | ((a["hits"] == b["hits"]) & ((a["secs"] < b["secs"]) | ((a["secs"] == b["secs"]) & (a["i"] < b["i"])))), -1).otherwise(1)), 0)
    every = every.withColumn("best", best)
    return every.select("trip", F.coalesce("best.status", F.lit("no_route")).alias("status"), sum((F.coalesce(f"n{i}", F.lit(0)) for i in (2, 3)), F.coalesce("n1", F.lit(0))).alias("requests"), "ahead", F.col("best.path").alias("path"))
