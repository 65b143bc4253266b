"""Clusters of map points: a hierarchy of nodes that are merged level by level, greedily in order of id.

At a level the node of smallest id takes all nodes within the radius, then the next node that isn't
taken does, and so on: a node is a centre if no centre of smaller id reaches it, and else belongs to
the smallest that does. That order runs over the whole map, but it can be decided in tiles. A tile sees
its own nodes and a halo of HALO radii. A node is decided once all smaller ids within reach are, as far as
the tile can see; nodes at the halo's rim may have neighbours that it can't see and stay open unless a
centre reaches them. What chains of ids through halos leave open is decided in further rounds, in the tiles
that have such nodes, from what other tiles have decided since. Rounds end, as the smallest open id of the
map always has only decided ones before it.

Coordinates are whole fractions (1 / SCALE) of the mercator world, and a merged node lies at the whole
quotient of its weighted sums, so the result doesn't depend on the order in which rows are added.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbsense.constants import CLUSTER_PX, NEAR_LEVEL, TILE_PX, WIDE_LEVEL
from curbsense.functions import geo
from curbsense.operators.tables import cut, drop_tables

SCALE = 1 << 32
#: Side of a tile and width of its halo in radii of the level.
TILE_RADII, HALO = 32, 4
LEAF_LEVEL = NEAR_LEVEL + 1
OPEN, CENTRE, TAKEN = 0, 1, 2
BOX = ("west", "south", "east", "north")
NODE = ["id", "x", "y", "count", "users", *BOX]


def radius(level: int) -> int:
    """Radius in which nodes of a level merge, in whole units."""
    return int(CLUSTER_PX * SCALE / (TILE_PX * 2**level))


def _decided(reach: int):
    side, most = reach * TILE_RADII, reach * reach
    #: Cells of a tile with its halo, and one more on either side.
    wide = TILE_RADII + 2 * HALO + 4
    around = [a * wide + b for a in (-1, 0, 1) for b in (-1, 0, 1)]

    def decided(table: pa.Table) -> pa.Table:
        """A call's tiles, each in order of id: status of own nodes, and the id of the centre that each belongs to, null while that is open."""
        table = table.sort_by([("tx", "ascending"), ("ty", "ascending"), ("id", "ascending")])
        tx, ty, x, y, given, own = (table[c].to_numpy() for c in ("tx", "ty", "x", "y", "status", "own"))
        new = np.concatenate([[1], (np.diff(tx) != 0) | (np.diff(ty) != 0)])[: len(tx)]
        in_x, in_y = x - tx * side + reach * (HALO + 1), y - ty * side + reach * (HALO + 1)
        cells = ((np.cumsum(new) * wide + in_x // reach) * wide + in_y // reach).tolist()
        # Whether the tile sees all that is within reach of a node.
        seen = np.minimum(in_x, in_y) >= 2 * reach
        seen = (own | (seen & (np.maximum(in_x, in_y) < reach * (TILE_RADII + 2 * HALO)))).tolist()
        xs, ys, ids, owned = x.tolist(), y.tolist(), table["id"].to_pylist(), own.tolist()
        centres: dict[int, list[int]] = {}
        unknown: dict[int, list[int]] = {}
        status, parents, keep = [], [], []

        def first_near(held: dict[int, list[int]], i: int) -> int | None:
            """The first row of `held` within reach; rows are put there in order."""
            found, px, py = None, xs[i], ys[i]
            for cell in around:
                for j in held.get(cells[i] + cell, ()):
                    if (found is None or j < found) and (xs[j] - px) ** 2 + (ys[j] - py) ** 2 <= most:
                        found = j
            return found

        for i, now in enumerate(given.tolist()):
            centre, doubt = first_near(centres, i), first_near(unknown, i) if unknown else None
            if now == OPEN:
                now = TAKEN if centre is not None else CENTRE if seen[i] and doubt is None else OPEN
            if now != TAKEN:
                (centres if now == CENTRE else unknown).setdefault(cells[i], []).append(i)
            if owned[i]:
                sure = centre is not None and (doubt is None or doubt > centre)
                keep.append(i)
                status.append(now)
                parents.append(ids[i] if now == CENTRE else ids[centre] if now == TAKEN and sure else None)
        rows = table.select([*NODE, "tx", "ty"]).take(pa.array(keep, pa.int64()))
        return rows.append_column("status", pa.array(status, pa.int32())).append_column("parent", pa.array(parents, pa.string()))

    return decided


def _tile(c: str, side: int, shift: int = 0) -> Column:
    return F.floor((F.col(c) + F.lit(shift)) / side)


def _in_tiles(nodes: DataFrame, reach: int) -> DataFrame:
    """nodes in their own tile and in those whose halo they lie in."""
    side, halo = reach * TILE_RADII, reach * HALO
    rows = nodes
    for c, t in (("x", "tx"), ("y", "ty")):
        rows = rows.withColumn(t, F.explode(F.sequence(_tile(c, side, -halo), _tile(c, side, halo))))
    return rows.withColumn("own", (F.col("tx") == _tile("x", side)) & (F.col("ty") == _tile("y", side)))


SCHEMA = "id string, x long, y long, count long, users long, west double, south double, east double, north double, tx long, ty long, status int, parent string"


def _merged(nodes: DataFrame, reach: int, made: list[str]) -> DataFrame:
    """Rows (NODE, parent) of a level's nodes with the id of the centre that each belongs to."""
    calls = 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def decide(rows: DataFrame) -> DataFrame:
        # Many tiles to a call: most hold a node or two.
        return rows.groupBy(F.pmod(F.xxhash64("tx", "ty"), F.lit(calls)).alias("call")).applyInArrow(_decided(reach), SCHEMA)

    out = cut(decide(_in_tiles(nodes.withColumn("status", F.lit(OPEN)), reach)), made)
    while not (late := out.where("parent IS NULL")).isEmpty():
        tiles = late.select("tx", "ty").distinct()
        again = decide(_in_tiles(out.select(*NODE, "status"), reach).join(tiles, ["tx", "ty"], "left_semi"))
        out = cut(out.join(tiles, ["tx", "ty"], "left_anti").unionByName(again), made)
    return out.select(*NODE, "parent")


def _sums(nodes: DataFrame, key: str) -> DataFrame:
    """The nodes of the next level: counts, users and boxes of each centre's nodes, at their weighted mean."""
    mean = lambda c: F.expr(f"sum(CAST({c} * count AS DECIMAL(38,0))) div sum(count)").alias(c)
    box = [(F.min if c in ("west", "south") else F.max)(c).alias(c) for c in BOX]
    return nodes.groupBy(F.col(key).alias("id")).agg(mean("x"), mean("y"), F.sum("count").alias("count"), F.sum("users").alias("users"), *box)


def cluster_index(points: DataFrame) -> DataFrame:
    """Rows (level, id, x, y, count, users, west, south, east, north, parent) of nodes for levels 14 (single points) down to 6.

    points have key, lat, lon and user. Every level merges the nodes of the one below within CLUSTER_PX
    of one another, greedily in order of id. A node is named by the point of smallest id that became its centre,
    parent is the node of the next level that took it (null at the last), and west to north is the box
    of its points in degrees. Counts are conserved at every level. Points in one place are one node to the
    first merge. Positions are mercator fractions of the world, and nothing merges over the antimeridian.
    """
    made: list[str] = []
    whole = lambda c: F.floor(c * SCALE).cast("long")
    place = [whole(geo.merc_x("lon")).alias("x"), whole(geo.merc_y("lat")).alias("y")]
    leaves = points.select(F.col("key").alias("id"), *place, F.lit(1).cast("long").alias("count"), F.col("user").cast("long").alias("users"), F.col("lon").alias("west"), F.col("lat").alias("south"), F.col("lon").alias("east"), F.col("lat").alias("north"))
    box = [(F.min if c in ("west", "south") else F.max)(c).alias(c) for c in BOX]
    nodes = leaves.groupBy("x", "y").agg(F.min("id").alias("id"), F.sum("count").alias("count"), F.sum("users").alias("users"), *box)
    levels = []
    for level in range(NEAR_LEVEL, WIDE_LEVEL, -1):
        merged = _merged(nodes, radius(level), made)
        below = leaves.join(merged.select("x", "y", "parent"), ["x", "y"]) if level == NEAR_LEVEL else merged
        levels.append(below.withColumn("level", F.lit(level + 1)))
        nodes = _sums(merged, "parent")
    levels.append(nodes.withColumns({"parent": F.lit(None).cast("string"), "level": F.lit(WIDE_LEVEL + 1)}))
    unit = lambda c: (F.col(c) / F.lit(float(SCALE))).alias(c)
    rows = [x.select("level", "id", unit("x"), unit("y"), "count", "users", *BOX, "parent") for x in levels]
    out = cut(reduce(DataFrame.unionByName, rows))
    drop_tables(points.sparkSession, made)
    return out


def largest_nodes(index: DataFrame) -> DataFrame:
    """Rows (level, largest): the count of each level's largest node, by which the others are drawn."""
    return index.groupBy("level").agg(F.max("count").alias("largest"))


def ancestors(index: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows (id, ancestor): the node of level `stop` above each node of level `start`; of single points for any start over their level."""
    level = min(start, LEAF_LEVEL)
    up = index.where(F.col("level") == level).select("id", F.col("id").alias("ancestor"))
    for step in range(level, max(stop, WIDE_LEVEL + 1), -1):
        above = index.where(F.col("level") == step).select(F.col("id").alias("ancestor"), "parent")
        up = up.join(above, "ancestor").select("id", F.col("parent").alias("ancestor"))
    return up


def in_view(box: tuple[float, float, float, float]) -> Column:
    """Whether a node lies in a box (south, west, north, east) of degrees, whose west may be over the antimeridian."""
    south, west, north, east = box
    x = lambda lon: lon / 360 + 0.5
    inside = F.col("y").between(geo.merc_y(F.lit(north)), geo.merc_y(F.lit(south)))
    spans = F.col("x").between(x(west), x(east)) if west <= east else (F.col("x") >= x(west)) | (F.col("x") <= x(east))
    return inside & spans


def cluster_view(index: DataFrame, box: tuple[float, float, float, float], level: int, before: tuple[tuple[float, float, float, float], int] | None = None) -> DataFrame:
    """Rows (id, x, y, count, users, is_leaf, ancestor, direction) of a level's nodes in a box, linked with those shown before.

    before is the box and level of the view that is left. Going in, ancestor is the node of that level
    that a node comes out of. Going out, rows of the nodes shown before are added, with nothing but id, the ancestor
    in this level that takes them, and direction; a view of the same level has no links.
    """
    own = min(level, LEAF_LEVEL)
    shown = index.where((F.col("level") == own) & in_view(box)).select("id", "x", "y", "count", "users", (F.col("count") == 1).alias("is_leaf"))
    old = min(before[1], LEAF_LEVEL) if before else own
    if old == own or old <= WIDE_LEVEL:
        return shown.withColumns({"ancestor": F.lit(None).cast("string"), "direction": F.lit(None).cast("string")})
    if old < own:
        return shown.join(ancestors(index, own, old), "id").withColumn("direction", F.lit("in"))
    gone = index.where((F.col("level") == old) & in_view(before[0])).select("id").join(ancestors(index, old, own), "id")
    return shown.unionByName(gone.withColumn("direction", F.lit("out")), allowMissingColumns=True)


def expansions(index: DataFrame) -> DataFrame:
    """Rows (level, id, west, south, east, north, split_level): the box of each cluster's points, and the first level at which it is several nodes.

    A node that has a single one below keeps its id and count, so it splits below the last level with
    both.
    """
    clusters = index.where("count > 1")
    last = clusters.groupBy("id", "count").agg(F.max("level").alias("last"))
    return clusters.join(last, ["id", "count"]).where(F.col("level") < LEAF_LEVEL).select("level", "id", *BOX, (F.col("last") + 1).cast("int").alias("split_level"))
