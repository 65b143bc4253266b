"""Spatial scans and joins.

Range joins never compare all pairs: both sides get grid cells, equal cells join, and the exact test
decides. Saved targets are explored cell by cell; cameras keep their one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbsense.constants import AVOID_M, BUCKET_SIZE, DUPLICATE_M, METRES_PER_DEGREE
from curbsense.functions import geo

#: Metres of one bucket's side near the poles' end of the data (60 degrees), by which points within DUPLICATE_M or AVOID_M are in neighbouring buckets.
SIDE_M = BUCKET_SIZE * METRES_PER_DEGREE * 0.4
#: Most areas whose numbers (two a row) may be broadcast; beyond, they are joined by shuffle.
AREAS_MOST = 1_000_000


def active(cameras: DataFrame) -> DataFrame:
    return cameras.where(F.col("stale_since").isNull())


def bbox_scan(cameras: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Cameras in a box, stale ones too; west > east crosses the antimeridian. Constant ranges reach the scan."""
    box = geo.sanitized_box(south, west, north, east)
    return cameras.where(geo.in_box("lat", "lon", box))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many parts as a shuffle has; Spark merges parts by their bytes, though here a few bytes become many rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _area_places(cameras: DataFrame, areas: DataFrame) -> DataFrame:
    """Rows (a_lat, a_lon, radius_m, lat, lon, distance_m): different circles, and the different places of active cameras in both a circle and its box."""
    box = geo.circle_box("a_lat", "a_lon", F.col("radius_m").cast("double"))
    targets = areas.select(F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), "radius_m").distinct().withColumn("box", box)
    targets = targets.withColumn("cell", F.explode(geo.box_cells(F.col("box"))))
    points = active(cameras).select("lat", "lon").distinct().withColumn("cell", geo.grid_cell("lat", "lon"))
    near = _spread(points, "cell").join(_spread(targets, "cell").hint("merge"), "cell").where(geo.in_box("lat", "lon", F.col("box"))).withColumn("distance_m", geo.haversine_m("a_lat", "a_lon", "lat", "lon"))
    return near.where(F.col("distance_m") <= F.col("radius_m")).drop("cell", "box")


CIRCLE = ["a_lat", "a_lon", "radius_m"]


def _circles(areas: DataFrame) -> DataFrame:
    return areas.select(F.col("id").alias("area"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), "radius_m")


def area_membership(cameras: DataFrame, areas: DataFrame) -> DataFrame:
    """Rows (area, osm_type, osm_id, distance_m): active cameras within both the area's box and its circle.

    The box, at 111,320 m a degree, is a little tighter than the circle; both tests hold. Circles and places are
    compared once, however many areas or cameras share them, and rows are joined to them last.
    """
    near = _circles(areas).hint("merge").join(_area_places(cameras, areas), CIRCLE).select("area", "lat", "lon", "distance_m")
    points = active(cameras).select("osm_type", "osm_id", "lat", "lon")
    return _spread(near, "lat", "lon").join(_spread(points, "lat", "lon").hint("merge"), ["lat", "lon"]).select("area", "osm_type", "osm_id", "distance_m")


def segments(vertices: DataFrame, key: str = "route") -> DataFrame:
    """Rows (key, segment, lat1, lon1, lat2, lon2, start_m, length_m) of polylines given as vertices (key, pos, lat, lon)."""
    w = W.partitionBy(key).orderBy("pos")
    pairs = vertices.select(key, F.col("pos").alias("segment"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"))
    pairs = pairs.where(F.col("lat2").isNotNull()).withColumn("length_m", geo.haversine_m("lat1", "lon1", "lat2", "lon2"))
    before = F.sum("length_m").over(W.partitionBy(key).orderBy("segment").rowsBetween(W.unboundedPreceding, -1))
    return pairs.withColumn("start_m", F.coalesce(before, F.lit(0.0)))


def segment_box(pad_m: Column) -> Column:
    """The padded box of a segment (lat1, lon1)-(lat2, lon2); one that spans over 180 degrees crosses the antimeridian."""
    mid = (F.col("lat1") + F.col("lat2")) / 2
    dlat, dlon = pad_m / METRES_PER_DEGREE, pad_m / (METRES_PER_DEGREE * geo.metre_cos(mid))
    low, high = F.least("lon1", "lon2"), F.greatest("lon1", "lon2")
    across = F.abs(F.col("lon1") - F.col("lon2")) > 180.0
    return geo.sanitized_box(F.least("lat1", "lat2") - dlat, F.when(across, high).otherwise(low) - dlon, F.greatest("lat1", "lat2") + dlat, F.when(across, low).otherwise(high) + dlon)


def polyline_cells(vertices: DataFrame, corridors: DataFrame, key: str = "route") -> DataFrame:
    """Distinct rows (key, row, col): the cells that each padded segment meets."""
    s = segments(vertices, key).join(corridors, key)
    return s.select(key, F.explode(geo.box_cells(segment_box(F.col("corridor_m").cast("double")))).alias("cell")).select(key, "cell.row", "cell.col").distinct()


def route_membership(cameras: DataFrame, vertices: DataFrame, corridors: DataFrame) -> DataFrame:
    """Rows (route, osm_type, osm_id, distance_m, along_m, segment): active cameras within a route's corridor and its padded box."""
    s = segments(vertices).join(corridors, "route")
    pad = F.col("corridor_m").cast("double")
    w = W.partitionBy("route")
    south, north = F.min(F.least("lat1", "lat2")).over(w), F.max(F.greatest("lat1", "lat2")).over(w)
    west, east = F.min(F.least("lon1", "lon2")).over(w), F.max(F.greatest("lon1", "lon2")).over(w)
    dlat, dlon = pad / METRES_PER_DEGREE, pad / (METRES_PER_DEGREE * geo.metre_cos((south + north) / 2))
    s = s.withColumn("box", F.struct((south - dlat).alias("south"), (west - dlon).alias("west"), (north + dlat).alias("north"), (east + dlon).alias("east")))
    # Cells reach somewhat beyond the corridor, whose metres are those of the sphere.
    s = s.withColumn("cell", F.explode(geo.box_cells(segment_box(pad * 1.01))))
    points = active(cameras).select("osm_type", "osm_id", "lat", "lon", geo.grid_cell("lat", "lon").alias("cell"))
    near = points.join(s, "cell").where(geo.in_box("lat", "lon", F.col("box")))
    near = near.withColumn("hit", geo.nearest_on_segment("lat", "lon", "lat1", "lon1", "lat2", "lon2"))
    near = near.where(F.col("hit.distance_m") <= pad)
    first = F.min(F.struct(F.col("hit.distance_m"), "segment", (F.col("start_m") + F.col("hit.along_m")).alias("along_m"))).alias("hit")
    return near.groupBy("route", "osm_type", "osm_id").agg(first).select("route", "osm_type", "osm_id", "hit.distance_m", "hit.along_m", "hit.segment")


def _halo(row: Column, col: Column) -> Column:
    """The 3 x 3 buckets about a bucket, as struct(r, c)."""
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    return F.flatten(F.transform(steps, lambda a: F.transform(steps, lambda b: F.struct((row + a).alias("r"), (col + b).alias("c")))))


def _places_within(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Rows (lat, lon, r_lat, r_lon, distance_m): the different places of left and of right at most `metres` apart.

    However many rows share a place, it is compared once. Spark reckons a side without its nine buckets a
    row, so it must not choose to broadcast one.
    """
    if metres > SIDE_M:
        raise ValueError(f"at most {SIDE_M:.0f} m")
    a = left.select("lat", "lon").distinct().withColumn("at", F.explode(_halo(geo.bucket("lat"), geo.bucket("lon"))))
    b = right.select("r_lat", "r_lon").distinct().withColumn("at", F.struct(geo.bucket("r_lat").alias("r"), geo.bucket("r_lon").alias("c")))
    return a.join(b.hint("merge"), "at").withColumn("distance_m", geo.haversine_m("lat", "lon", "r_lat", "r_lon")).where(F.col("distance_m") <= metres).drop("at")


def pairs_within(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Rows of left (lat, lon, ...) and right (r_lat, r_lon, ...) at most `metres` apart, with distance_m.

    Buckets of 0.002 degrees join with their neighbours; metres must not exceed SIDE_M, so that no
    pair up to 66 degrees of latitude is missed. Distances are reckoned between places, then rows are joined to their places.
    """
    near = _places_within(left, right, metres)
    pairs = left.hint("merge").join(near, ["lat", "lon"]).join(right.hint("merge"), ["r_lat", "r_lon"])
    return pairs.select(*left.columns, *right.columns, "distance_m")


def merge_cameras(cameras: DataFrame, submissions: DataFrame) -> DataFrame:
    """Rows (key, lat, lon, category, source): active cameras, and submissions that none of them is within DUPLICATE_M of."""
    osm = active(cameras).select(F.concat_ws("/", "osm_type", "osm_id").alias("key"), "lat", "lon", "category", F.lit("osm").alias("source"))
    mapped = _places_within(submissions, osm.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")), DUPLICATE_M).select("lat", "lon").distinct()
    own = submissions.join(mapped, ["lat", "lon"], "left_anti").select(F.concat_ws("/", F.lit("submission"), "id").alias("key"), "lat", "lon", "category", F.lit("submission").alias("source"))
    return osm.unionByName(own)


def blocked_segments(segs: DataFrame, cameras: DataFrame, metres: float = AVOID_M) -> DataFrame:
    """The segments (seg, lat1, lon1, lat2, lon2) that pass within `metres` of a camera (lat, lon)."""
    span = lambda a, b: F.sequence(F.least(geo.bucket(a), geo.bucket(b)) - 1, F.greatest(geo.bucket(a), geo.bucket(b)) + 1)
    cells = F.flatten(F.transform(span("lat1", "lat2"), lambda r: F.transform(span("lon1", "lon2"), lambda k: F.struct(r.alias("r"), k.alias("c")))))
    a = segs.withColumn("at", F.explode(cells))
    # A place stands for its cameras.
    b = cameras.select("lat", "lon").distinct().select(F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.struct(geo.bucket("lat").alias("r"), geo.bucket("lon").alias("c")).alias("at"))
    # Spark may broadcast places where they are few; the segments found grow with the map and don't go through the driver.
    near = a.join(b, "at").where(geo.segment_distance_m("p_lat", "p_lon", "lat1", "lon1", "lat2", "lon2") <= metres)
    return segs.join(near.select("seg").distinct().hint("merge"), "seg", "left_semi")


def area_overlap(cameras: DataFrame, areas: DataFrame) -> DataFrame:
    """Rows (area, other, shared): how many active cameras each ordered pair of areas has in common, as of area_membership().

    A place stands for its cameras, with their number, and a circle for its areas: both are paired before rows are
    joined to them. Cameras of which a key has several rows are paired by their keys.
    """
    key = ["osm_type", "osm_id"]
    held = active(cameras).where("osm_type IS NOT NULL AND osm_id IS NOT NULL").groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    named = _circles(areas).groupBy(*CIRCLE).agg(F.min("area").alias("circle"))
    once = held.where("rows = 1").groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    near = _area_places(cameras, areas).join(named.hint("merge"), CIRCLE).select("circle", "lat", "lon", geo.tile("lat").alias("row"), geo.tile("lon").alias("col"))
    # By tile, so that a pair's places are added up before they travel.
    near = _spread(near, "row", "col")
    mine = near.join(once.withColumns({"row": geo.tile("lat"), "col": geo.tile("lon")}).hint("merge"), ["row", "col", "lat", "lon"])
    both = mine.join(near.withColumnRenamed("circle", "with").hint("merge"), ["row", "col", "lat", "lon"]).where(F.col("circle") <= F.col("with"))
    both = both.groupBy("circle", "with").agg(F.sum("n").alias("shared"))
    same, turned = F.struct("circle", "with"), F.struct(F.col("with").alias("circle"), F.col("circle").alias("with"))
    both = both.select("shared", F.explode(F.when(F.col("circle") == F.col("with"), F.array(same)).otherwise(F.array(same, turned))).alias("p")).select("p.*", "shared")
    owner = _circles(areas).join(named.hint("merge"), CIRCLE).select("area", "circle")
    other = owner.select(F.col("area").alias("other"), F.col("circle").alias("with"))
    few = F.broadcast if areas.count() <= AREAS_MOST else lambda df: df.hint("merge")
    pairs = both.join(few(owner), "circle").join(few(other), "with").where("area <> other").select("area", "other", "shared")
    # Without such cameras, and areas of several rows, each pair is whole by now.
    if held.where("rows > 1").isEmpty() and areas.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        return pairs
    again = area_membership(cameras.join(held.where("rows > 1").select(*key).hint("merge"), key, "left_semi"), areas).select("area", *key)
    pairs = pairs.unionByName(again.join(again.withColumnRenamed("area", "other").hint("merge"), key).where("area <> other").select("area", "other", F.lit(1).cast("long").alias("shared")))
    return pairs.groupBy("area", "other").agg(F.sum("shared").alias("shared"))
