"""Searches in the part of a map about trips, which a task holds, with proof that no way outside it is better.

Trips whose starts lie in one block of tiles share a task and its graph: the tiles about their ends, and the edges that enter
them. What a search finds before it comes to a node outside the part is the best of the whole map; so is what is found, or not, for a goal that no
entry of the part leads to. Trips in doubt are searched again in a part four times as wide. Parts of too many edges, and trips whose ends are far
apart, are left to the overlay. Where ways mustn't leave an area, nothing is in doubt.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbsense.operators.tables import cut

#: Side of a block of tiles, most tiles between a trip's ends, trips of a task, and edges that a task may hold.
BLOCK, SPAN, TASK_TRIPS, EDGES_MOST = 8, 16, 20_000, 500_000
BOX = ["r0", "r1", "c0", "c1"]
#: What is known of a trip: it has a way, it has none, or nothing is proved.
FOUND, NONE, DOUBT = range(3)
ANSWER = "trip long, start string, state int, cost double, blocked long, hops long, path array<struct<u: string, v: string, secs: double, blocked: boolean>>"


def parts(trips: DataFrame, tiles: DataFrame, edges: DataFrame, wide: int | None, made: list[str], most: int = TASK_TRIPS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trips with their task, edges of tasks (of_task), trips that no task takes).

    trips have the tiles of their ends as rows and columns (r, c, r2, c2), and with wide None the box of their area as well (BOX); else a
    part reaches wide times as far beyond its trips' ends as these lie apart. tiles are rows (tile, r, c, n), n edges each. A task has about
    `most` trips.
    """
    span = F.greatest(F.abs(F.col("r2") - F.col("r")), F.abs(F.col("c2") - F.col("c")))
    at = F.concat_ws(":", F.floor(F.col("r") / BLOCK), F.floor(F.col("c") / BLOCK))
    trips = trips.withColumns({"part": at, "span": span})
    if wide is None:
        # An empty box has no tiles; a start may lie outside its own.
        ends = {"r0": F.least("r", "r0"), "r1": F.greatest("r", "r1"), "c0": F.least("c", "c0"), "c1": F.greatest("c", "c1")}
    else:
        trips = trips.withColumn("pad", (F.max(F.when(F.col("span") <= SPAN, F.col("span"))).over(W.partitionBy("part")) + 1) * wide)
        ends = {"r0": F.least("r", "r2") - F.col("pad"), "r1": F.greatest("r", "r2") + F.col("pad"), "c0": F.least("c", "c2") - F.col("pad"), "c1": F.greatest("c", "c2") + F.col("pad")}
    near = F.col("span") <= SPAN
    boxes = trips.where(near).select("part", *(x.alias(k) for k, x in ends.items())).groupBy("part").agg(F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    there = boxes.withColumn("r", F.explode(F.sequence("r0", "r1"))).join(tiles, "r").where(F.col("c").between(F.col("c0"), F.col("c1")))
    there = cut(there.select("part", "tile", F.sum("n").over(W.partitionBy("part")).alias("edges")), made)
    large = there.where(F.col("edges") > EDGES_MOST).select("part").distinct().withColumn("large", F.lit(True))
    trips = trips.join(large, "part", "left").withColumn("near", near & F.col("large").isNull())
    starts = trips.where("near").groupBy("part", "start").agg(F.count(F.lit(1)).alias("n"))
    shares = starts.withColumns({"shares": F.ceil(F.col("n") / most), "tasks": F.ceil(F.sum("n").over(W.partitionBy("part")) / most)}).drop("n")
    number = F.pmod(F.xxhash64("start", F.pmod(F.xxhash64("trip"), F.col("shares"))), F.col("tasks"))
    trips = cut(trips.join(shares, ["part", "start"], "left").withColumn("task", F.when(F.col("near"), F.concat_ws("/", "part", number))).drop("large", "near", "shares", "tasks", "span", "pad"), made)
    taken = trips.where("task IS NOT NULL")
    wanted = taken.select("part", F.col("task").alias("of_task")).distinct().join(there.select("part", "tile"), "part").select("of_task", "tile")
    return taken, edges.join(wanted, "tile"), trips.where("task IS NULL")


class Part:
    """A task's graph: edges that begin in its tiles, nodes outside that they lead to, and the nodes that edges from outside lead to."""

    def __init__(self, edges: pa.Table, penalty_s: float | None, columns: int):
        held = pc.unique(edges["tile"]).to_numpy(zero_copy_only=False)
        if penalty_s is None:
            edges = edges.filter(pc.invert(edges["blocked"]))
        names = pa.chunked_array([*edges["u"].chunks, *edges["v"].chunks], pa.string()).combine_chunks().dictionary_encode()
        self.names, ids = names.dictionary, names.indices.to_numpy(zero_copy_only=False)
        n, own = len(self.names), edges["own"].to_numpy()
        self.u, self.v = ids[: len(edges)], ids[len(edges) :]
        self.secs, self.blocked = edges["secs"].to_numpy(), edges["blocked"].to_numpy()
        tile, to = edges["tile"].to_numpy(), edges["b"].to_numpy()
        place = np.zeros(n, np.int64)
        place[self.v], place[self.u[own]] = to, tile[own]
        self.rows, self.columns = place // columns, place % columns
        outside = np.zeros(n, bool)
        outside[self.v[own]] = ~np.isin(to[own], held)
        # An edge between two tiles of the part is there twice.
        inside = np.zeros(n, bool)
        inside[self.u[own]] = True
        self.outside, self.enters = outside.tolist(), self.v[~own & ~inside[self.u]]
        self.ahead: list[list[tuple]] = [[] for _ in range(n)]
        self.back: list[list[int]] = [[] for _ in range(n)]
        cost = self.secs + (penalty_s or 0.0) * self.blocked
        at = np.flatnonzero(own)
        for e, u, v, more, hit in zip(at.tolist(), self.u[at].tolist(), self.v[at].tolist(), cost[at].tolist(), self.blocked[at].astype(int).tolist(), strict=True):
            self.ahead[u].append((v, more, hit, e))
            self.back[v].append(u)

    def ids(self, nodes: pa.ChunkedArray) -> list[int | None]:
        return pc.index_in(nodes, value_set=self.names).to_pylist()

    def entered(self) -> bytearray:
        """The nodes that a way from outside may come to."""
        seen, todo = bytearray(len(self.names)), self.enters.tolist()
        while todo:
            node = todo.pop()
            if not seen[node]:
                seen[node] = 1
                todo += [e[0] for e in self.ahead[node] if not seen[e[0]]]
        return seen

    def leading(self, goal: int) -> set[int]:
        """The nodes that a way leads to goal from, by this part."""
        seen, todo = {goal}, [goal]
        while todo:
            for u in self.back[todo.pop()]:
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        return seen

    def search(self, start: int, goals: set[int], entered: bytearray | None, barred: list[bool] | None) -> tuple[dict, dict, set[int]]:
        """(nodes with (cost, blocked, hops) of their best way, the last edge of each, goals in doubt); without `entered`, nothing is."""
        known, came, heap, doubt, outside = {}, {}, [(0.0, 0, 0, start, -1)], set(), self.outside
        goals = set(goals)
        while heap and goals:
            cost, blocked, hops, node, edge = heapq.heappop(heap)
            if node in known:
                continue
            known[node], came[node] = (cost, blocked, hops), edge
            goals.discard(node)
            if entered is not None and outside[node]:
                if not doubt:
                    doubt = {g for g in goals if entered[g]}
                    goals -= doubt
                continue
            for other, more, hit, e in self.ahead[node]:
                if other not in known and not (barred and barred[other]):
                    heapq.heappush(heap, (cost + more, blocked + hit, hops + 1, other, e))
        return known, came, doubt


def _answers(penalty_s: float | None, columns: int, area: bool, paths: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def answers(trips: pa.Table, edges: pa.Table) -> pa.Table:
        part = Part(edges, penalty_s, columns)
        entered, leading = None if area else part.entered(), {}
        starts, goals, same = part.ids(trips["start"]), part.ids(trips["goal"]), pc.equal(trips["start"], trips["goal"]).to_pylist()
        boxes = list(zip(*(trips[c].to_pylist() for c in BOX), strict=True)) if area else [None] * len(starts)
        asked: dict = {}
        for i, key in enumerate(zip(starts, boxes, strict=True)):
            asked.setdefault(key, []).append(i)
        state, sums, ends = [NONE] * len(starts), [(None, None, None)] * len(starts), {}
        for (start, box), trip in asked.items():
            barred = None
            if box:
                r0, r1, c0, c1 = box
                barred = (~((part.rows >= r0) & (part.rows <= r1) & (part.columns >= c0) & (part.columns <= c1))).tolist()
            wanted = set()
            for i in trip:
                goal = goals[i]
                if same[i]:
                    state[i], sums[i], ends[i] = FOUND, (0.0, 0, 0), []
                elif start is None or goal is None or (barred and barred[goal]):
                    pass
                elif area or entered[goal]:
                    wanted.add(goal)
                else:
                    if goal not in leading:
                        leading[goal] = part.leading(goal)
                    if start in leading[goal]:
                        wanted.add(goal)
            known, came, doubt = part.search(start, wanted, entered, barred) if wanted else ({}, {}, ())
            for i in trip:
                goal = goals[i]
                if same[i] or goal not in wanted:
                    continue
                if goal in doubt:
                    state[i] = DOUBT
                elif goal in known:
                    state[i], sums[i] = FOUND, known[goal]
                    if paths:
                        path, node = [], goal
                        while node != start:
                            path.append(came[node])
                            node = int(part.u[path[-1]])
                        ends[i] = path[::-1]
        sizes = np.cumsum([0, *(len(ends.get(i, ())) for i in range(len(starts)))])
        steps = np.array([e for i in range(len(starts)) for e in ends.get(i, ())], dtype=np.int64)
        fields = [part.names.take(pa.array(part.u[steps])), part.names.take(pa.array(part.v[steps])), pa.array(part.secs[steps], pa.float64()), pa.array(part.blocked[steps].astype(bool))]
        path = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(fields, ["u", "v", "secs", "blocked"]))
        cost, blocked, hops = (pa.array([s[k] for s in sums], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.int64())))
        return pa.table({"trip": trips["trip"], "start": trips["start"], "state": pa.array(state, pa.int32()), "cost": cost, "blocked": blocked, "hops": hops, "path": path})

    return answers


def solve(trips: DataFrame, tiles: DataFrame, edges: DataFrame, penalty_s: float | None, columns: int, area: bool, paths: bool, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of ANSWER of the trips that have a way, trips still open) of trips as parts() takes them; with area in their boxes, else on the whole map."""
    found, open_, left = [], trips, []
    wide = None if area else 1
    while True:
        taken, held, over = parts(open_, tiles, edges, wide, made)
        left.append(over)
        got = taken.groupBy("task").cogroup(held.groupBy("of_task")).applyInArrow(_answers(penalty_s, columns, area, paths), ANSWER)
        if not area:
            got = cut(got, made)
        found.append(got.where(F.col("state") == FOUND).drop("state"))
        if area:
            break
        doubt = got.where(F.col("state") == DOUBT).select("trip")
        if doubt.isEmpty():
            break
        open_, wide = cut(taken.join(doubt, "trip", "left_semi").drop("task", "part"), made), wide * 4
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, left).select("trip", "start", "goal")
