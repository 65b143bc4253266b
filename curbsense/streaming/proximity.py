"""Proximity alerts over live positions, as a batch query of windows and as a stateful streaming query.

A visit of a device to a camera starts with a fix within the radius and lasts as long as every good
fix is within EXIT_FACTOR radii. Its start is an alert unless the pair's alert before is less than a
cooldown old. Vague fixes are as if they weren't there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbsense.constants import ACCURACY_M, COOLDOWN_MS, EXIT_FACTOR, METRES_PER_DEGREE, PROXIMITY_M
from curbsense.functions import geo

OUT = "device long, time_ms long, osm_id long, distance_m double"
#: Time without fixes after which a device's state is dropped.
IDLE_MS = 24 * 3600 * 1000


def _cell(lat: Column, lon: Column, size: float) -> Column:
    return F.struct(F.floor(lat / size).alias("r"), F.floor(geo.wrap_lon(lon) / size).alias("c"))


def _cells_about(reach_m: float, size: float) -> Column:
    """The cells of `size` degrees that hold a point within reach of (lat, lon); those over the antimeridian are wrapped."""
    high = reach_m * 1.01 / METRES_PER_DEGREE
    wide = high / geo.metre_cos(F.abs(F.col("lat")) + high)
    rows = F.sequence(F.floor((F.col("lat") - high) / size), F.floor((F.col("lat") + high) / size))
    cols = F.sequence(F.floor((F.col("lon") - wide) / size), F.floor((F.col("lon") + wide) / size))
    wrapped = F.array_distinct(F.transform(cols, lambda c: F.floor(geo.wrap_lon((c + 0.5) * size) / size)))
    return F.flatten(F.transform(rows, lambda r: F.transform(wrapped, lambda c: F.struct(r.alias("r"), c.alias("c")))))


def near_fixes(fixes: DataFrame, cameras: DataFrame, radius_m: float = PROXIMITY_M) -> DataFrame:
    """Rows (device, nth, time_ms, osm_id, distance_m): good fixes within the exit distance of a camera, with their number among the device's good ones.

    Cameras are spread over the small cells that their exit distance meets, so a fix meets few others.
    """
    exit_m = radius_m * EXIT_FACTOR
    size = 2 * exit_m / METRES_PER_DEGREE
    targets = cameras.select("osm_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), F.explode(_cells_about(exit_m, size)).alias("cell"))
    order = W.partitionBy("device").orderBy("time_ms", "lat", "lon")
    good = fixes.where(F.col("accuracy_m") <= ACCURACY_M).withColumn("nth", F.row_number().over(order)).withColumn("cell", _cell(F.col("lat"), F.col("lon"), size))
    near = good.join(targets.hint("merge"), "cell").withColumn("distance_m", geo.haversine_m("lat", "lon", "c_lat", "c_lon"))
    return near.where(F.col("distance_m") <= exit_m).select("device", "nth", "time_ms", "osm_id", "distance_m")


def visits(near: DataFrame, radius_m: float = PROXIMITY_M) -> DataFrame:
    """Rows (device, osm_id, time_ms, distance_m): the first fix within the radius of each visit.

    Consecutive numbers of fixes are one stay within the exit distance.
    """
    w = W.partitionBy("device", "osm_id").orderBy("nth")
    stays = near.withColumn("new", F.coalesce(F.col("nth") - F.lag("nth").over(w), F.lit(2)) > 1).withColumn("stay", F.sum(F.col("new").cast("int")).over(w))
    inside = stays.where(F.col("distance_m") <= radius_m)
    first = F.min(F.struct("nth", "time_ms", "distance_m")).alias("first")
    return inside.groupBy("device", "osm_id", "stay").agg(first).select("device", "osm_id", "first.time_ms", "first.distance_m")


def _by_place(cameras: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cameras of different places (osm_id, lat, lon), the cameras (osm_id, own) that each stands for, and those of which an id has several rows."""
    rows = cameras.where("osm_id IS NOT NULL").groupBy("osm_id").agg(F.count(F.lit(1)).alias("rows"), F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    once = rows.where("rows = 1").select(F.col("osm_id").alias("own"), "lat", "lon")
    places = once.groupBy("lat", "lon").agg(F.min("own").alias("osm_id"))
    again = cameras.join(rows.where("rows > 1").select("osm_id").hint("merge"), "osm_id", "left_semi").select("osm_id", "lat", "lon")
    return places, once.join(places.hint("merge"), ["lat", "lon"]).select("osm_id", "own"), again


def proximity_first(fixes: DataFrame, cameras: DataFrame, radius_m: float = PROXIMITY_M) -> DataFrame:
    """Rows (device, osm_id, first_ms): when a good fix of each device first was within the radius of a camera, which is its first alert.

    The first of a device's fixes at a spot, and one camera of a place, stand for the others.
    """
    spots = fixes.where(F.col("accuracy_m") <= ACCURACY_M).groupBy("device", "lat", "lon").agg(F.min("time_ms").alias("time_ms")).withColumn("accuracy_m", F.lit(0.0))
    places, members, again = _by_place(cameras)

    def first(cameras: DataFrame) -> DataFrame:
        near = near_fixes(spots, cameras, radius_m).where(F.col("distance_m") <= radius_m)
        return near.groupBy("device", "osm_id").agg(F.min("time_ms").alias("first_ms"))

    out = first(places).join(members.hint("merge"), "osm_id").select("device", F.col("own").alias("osm_id"), "first_ms")
    return out if again.isEmpty() else out.unionByName(first(again))


def proximity_alerts(fixes: DataFrame, cameras: DataFrame, radius_m: float = PROXIMITY_M) -> DataFrame:
    """All alerts (device, time_ms, osm_id, distance_m) of fixes (device, time_ms, lat, lon, accuracy_m).

    Visits depend on a camera's place alone, so one camera of a place stands for the others until its alerts are known.
    """
    places, members, again = _by_place(cameras)
    out = _pair_alerts(fixes, places, radius_m).join(members.hint("merge"), "osm_id").select("device", "time_ms", F.col("own").alias("osm_id"), "distance_m")
    return out if again.isEmpty() else out.unionByName(_pair_alerts(fixes, again, radius_m))


def _pair_alerts(fixes: DataFrame, cameras: DataFrame, radius_m: float) -> DataFrame:
    """proximity_alerts() for each camera of its own."""

    def keep(done: Column, visit: Column) -> Column:
        cold = visit["time_ms"] - F.element_at(done, -1)["time_ms"] >= COOLDOWN_MS
        return F.when((F.size(done) == 0) | cold, F.array_append(done, visit)).otherwise(done)

    by_pair = visits(near_fixes(fixes, cameras, radius_m), radius_m).groupBy("device", "osm_id").agg(F.sort_array(F.collect_list(F.struct("time_ms", "distance_m"))).alias("visits"))
    kept = F.aggregate("visits", F.slice("visits", 1, 0), keep)
    return by_pair.select("device", "osm_id", F.explode(kept).alias("v")).select("device", "v.time_ms", "osm_id", "v.distance_m")


def _alerts(near: dict[int, float], at: int, inside: set[int], last: dict[int, int], radius_m: float) -> Iterator[tuple[int, int, float]]:
    """Alerts of one fix, nearest camera first; `near` has the cameras within the exit distance, and the state is brought up to date."""
    inside &= near.keys()
    arrived = sorted((metres, camera) for camera, metres in near.items() if metres <= radius_m and camera not in inside)
    inside |= {camera for _, camera in arrived}
    for metres, camera in arrived:
        if at - last.get(camera, at - COOLDOWN_MS) >= COOLDOWN_MS:
            last[camera] = at
            yield at, camera, metres


def proximity_stream(fixes: DataFrame, cameras: DataFrame, radius_m: float = PROXIMITY_M) -> DataFrame:
    """The same alerts from a stream of fixes: cameras are a static side, state is kept for each device.

    Rows of one micro-batch are put in order of time for each device before they change its state.
    The state holds the cameras that the device is at and those whose cooldown runs, and a device
    without fixes for IDLE_MS loses it.
    """
    exit_m = radius_m * EXIT_FACTOR
    size = 2 * exit_m / METRES_PER_DEGREE
    # A fix carries the cameras within its exit distance, no others.
    by_cell = cameras.select(F.struct("osm_id", "lat", "lon").alias("camera"), F.explode(_cells_about(exit_m, size)).alias("cell")).groupBy("cell").agg(F.collect_list("camera").alias("cameras"))
    rows = fixes.where(F.col("accuracy_m") <= ACCURACY_M).withColumn("cell", _cell(F.col("lat"), F.col("lon"), size)).join(by_cell, "cell", "left")
    metres = F.transform("cameras", lambda k: F.struct(k["osm_id"].alias("osm_id"), geo.haversine_m("lat", "lon", k["lat"], k["lon"]).alias("metres")))
    rows = rows.select("device", "time_ms", F.filter(metres, lambda x: x["metres"] <= exit_m).alias("near"))

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        at_camera, cooling, since = state.get if state.exists else ([], [], [])
        inside, last = set(at_camera), dict(zip(cooling, since, strict=True))
        pdf = pd.concat(list(batches)).sort_values("time_ms", kind="stable")
        alerts = [a for at, near in zip(pdf["time_ms"], pdf["near"], strict=True) for a in _alerts({} if near is None else {int(x["osm_id"]): float(x["metres"]) for x in near}, int(at), inside, last, radius_m)]
        now = int(pdf["time_ms"].max())
        last = {camera: at for camera, at in last.items() if now - at < COOLDOWN_MS}
        state.update((list(inside), list(last), list(last.values())))
        state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame([(key[0], *a) for a in alerts], columns=["device", "time_ms", "osm_id", "distance_m"])

    return rows.groupBy("device").applyInPandasWithState(run, OUT, "inside array<long>, cooling array<long>, since array<long>", "append", "ProcessingTimeTimeout")
