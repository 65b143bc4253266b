"""The domain's tables, derived from the driver's tables by integer arithmetic.

None of the given tables has coordinates, so cameras, areas, routes and the rest are computed from
their keys. plans/oracle.py holds the same derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Centres that points gather around; the last lies on the antimeridian.
METROS = [(41.25, -96.02), (45.5, -122.65), (29.45, -98.5), (51.85, 179.65)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _metro(key: Column, axis: int) -> Column:
    return F.element_at(F.array(*(F.lit(m[axis]) for m in METROS)), (key % 4 + 1).cast("int"))


def _wrapped(lon: Column) -> Column:
    return F.when(lon >= 180.0, lon - 360.0).otherwise(lon)


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From orders: most around metros, every fifth anywhere; categories, operators, directions and stale marks by key."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rural = k % 5 == 0
    lat = F.when(rural, -60.0 + (k * 7919 % 120000) / 1e3).otherwise(_metro(k, 0) + (k * 7919 % 7000) / 1e4 - 0.35)
    lon = F.when(rural, -180.0 + (k * 104729 % 360000) / 1e3).otherwise(_wrapped(_metro(k, 1) + (k * 104729 % 7000) / 1e4 - 0.35))
    return o.select(
        F.when(k % 97 == 0, "way").otherwise("node").alias("osm_type"),
        k.alias("osm_id"),
        lat.alias("lat"),
        lon.alias("lon"),
        F.when(k % 3 == 0, "flock").when(k % 3 == 1, "alpr").otherwise("unknown").alias("category"),
        F.when(k % 7 != 0, F.substring("o_orderpriority", 3, 40)).alias("operator"),
        F.when(k % 3 != 2, (k * 37 % 360).cast("string")).alias("direction"),
        (1690000000 + k).alias("first_seen"),
        (1700000000 + k % 1000).alias("last_seen"),
        F.when(k % 50 == 0, 1700000000 + k * 100).alias("stale_since"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From part: every fourth some metres from the camera of the same number."""
    k = F.col("p_partkey")
    near, order = k % 4 == 0, k * 4 + 1
    shift = (k % 30) / 1e5
    lat = F.when(near, _metro(order, 0) + (order * 7919 % 7000) / 1e4 - 0.35 + shift).otherwise(_metro(k, 0) + (k * 6007 % 9000) / 1e4 - 0.45)
    lon = F.when(near, _metro(order, 1) + (order * 104729 % 7000) / 1e4 - 0.35).otherwise(_metro(k % 3, 1) + (k * 9973 % 9000) / 1e4 - 0.45)
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        lat.alias("lat"),
        lon.alias("lon"),
        F.when(k % 3 == 0, "flock").when(k % 3 == 1, "alpr").otherwise("unsure").alias("category"),
        F.when(k % 2 == 0, k * 11 % 400).alias("direction"),
        F.element_at(F.array(*map(F.lit, ("pole", "building", "trailer", "tree"))), (k % 4 + 1).cast("int")).alias("mount"),
        F.when(k % 3 != 0, F.col("p_brand")).alias("operator"),
        F.col("p_name").alias("notes"),
        F.when(k % 6 == 0, "uploaded").otherwise("local").alias("status"),
        F.when(k % 6 == 0, k * 2).alias("osm_element_id"),
    )


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.col("s_name").alias("name"), (_metro(k, 0) + (k * 6151 % 6000) / 1e4 - 0.3).alias("lat"), _wrapped(_metro(k, 1) + (k * 8887 % 6000) / 1e4 - 0.3).alias("lon"), (100 + k * 3777 % 9900).alias("radius_m")
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("id"), F.col("n_name").alias("name"), (50 + k * 41 % 950).alias("corridor_m"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (route, pos, lat, lon): six vertices a route."""
    k, i = F.col("route"), F.col("pos")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("route"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos"))
    lat = _metro(k, 0) - 0.3 + i * 0.1 + ((k * 31 + i * 17) % 50) / 1e3
    lon = _metro(k, 1) - 0.3 + i * 0.1 + ((k * 13 + i * 29) % 50) / 1e3
    return rows.select("route", "pos", lat.alias("lat"), lon.alias("lon"))


def bends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (route, pos, lat, lon) from customer: streets in bends whose rows lie 30 m apart."""
    k, i = F.col("route"), F.col("pos")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("route"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pos"))
    lat = _metro(k, 0) + (k * 7919 % 7000) / 1e4 + F.floor(i / 2) * 0.00027
    return rows.select("route", "pos", lat.alias("lat"), (_metro(k, 1) + F.when((i % 4).isin(1, 2), 0.005).otherwise(0.0)).alias("lon"))


def bend_drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (trip, route, time_ms, lat, lon): a drive along each street in bends, some 20 m off, with gaps; every tenth leaves its street for a while."""
    w, k, j = W.partitionBy("route").orderBy("pos"), F.col("route"), F.col("j")
    s = bends(spark, sf_dir).withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)}).where("lat2 IS NOT NULL")
    s = s.withColumn("j", F.explode(F.sequence(F.col("pos").cast("long") * 10, F.col("pos").cast("long") * 10 + 9))).where((k + F.col("j")) % 17 != 0)
    aside = F.when((k % 10 == 3) & j.between(40, 44), 0.004).otherwise(0.0)
    lat = F.col("lat") + (F.col("lat2") - F.col("lat")) * (j % 10) / 10.0 + ((k * 7 + j * 13) % 41 - 20) / 1e5 + aside
    lon = F.col("lon") + (F.col("lon2") - F.col("lon")) * (j % 10) / 10.0 + ((k * 11 + j * 17) % 31 - 15) / 1e5
    return s.select(k.alias("trip"), "route", (j * 3000).alias("time_ms"), lat.alias("lat"), lon.alias("lon"))


def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    name = F.create_map(*(F.lit(x) for x in ("signup", "baseline", "purchase", "added", "view", "added", "error", "removed", "click", "other")))
    return table(spark, sf_dir, "events").select(
        k.alias("id"),
        F.when(k % 4 == 0, "route").otherwise("area").alias("target_type"),
        (F.col("user_id") % 20).alias("target_id"),
        F.lit("node").alias("osm_type"),
        (k * 7 % 500).alias("osm_id"),
        F.coalesce(F.element_at(name, F.col("event_type")), F.lit("other")).alias("event"),
        F.unix_timestamp(F.date_trunc("second", "ts")).alias("occurred_at"),
        (k % 3 == 0).alias("notified"),
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wi-Fi sightings as text, as scanners write them; several rows a device."""
    k = F.col("event_id")
    d = k % 2500
    mac = F.concat_ws(":", F.element_at(F.array(*map(F.lit, ("70:C9:4E", "3c:91:80", "AA-BB-CC", "d8:f3:bc"))), (d % 4 + 1).cast("int")), F.lpad(F.hex(d % 256), 2, "0"), F.lpad(F.hex((d / 256).cast("long")), 2, "0"), F.lit("0a"))
    return table(spark, sf_dir, "events").select(
        k.alias("pos"),
        F.when(k % 41 == 0, F.lit("bad:mac")).otherwise(mac).alias("netid"),
        F.when(k % 43 == 0, F.lit("n/a")).otherwise((_metro(k, 0) + (k * 7919 % 7000) / 1e4).cast("string")).alias("trilat"),
        F.when(k % 47 == 0, F.lit("200.5")).otherwise((_metro(k % 3, 1) + (k * 7919 % 7000) / 1e4).cast("string")).alias("trilong"),
        F.element_at(F.array(*map(F.lit, ("Flock", "flock-1A2B3C", " FLOCK007 ", "Flock Camera net.", "home", "flocking"))), (k % 6 + 1).cast("int")).alias("ssid"),
        F.when(k % 17 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("lasttime"),
        F.when(k % 2 == 0, "upstream").otherwise("import").alias("source"),
    )


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions: a device walks about its metro; event time in milliseconds."""
    k, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        u.alias("device"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"),
        F.col("ts").alias("ts"),
        (_metro(u % 3, 0) + (u * 7919 % 500) / 1e4 + (k * 13 % 60) / 1e4).alias("lat"),
        (_metro(u % 3, 1) + (u * 104729 % 500) / 1e4 + (k * 29 % 60) / 1e4).alias("lon"),
        (F.col("value") * 1.5).alias("accuracy_m"),
    )


def sync_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("event_id"), F.unix_timestamp(F.date_trunc("second", "ts"))
    outcome = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "running").otherwise("offline")
    done = F.when(outcome != "running", at + k % 300)
    return table(spark, sf_dir, "events").select(
        k.alias("id"), at.alias("started_at"), done.alias("finished_at"), outcome.alias("outcome"), F.when(outcome != "ok", F.col("props")).alias("detail"), F.when(k % 5 != 0, k * 3).alias("elements"), (k * 101).alias("bytes")
    )


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (way, tags, pos, lat_e7, lon_e7): a lattice of streets, four points a way; neighbours share points."""
    k, i = F.col("p_partkey"), F.col("pos")
    size = F.col("p_size")
    classes = F.array(*map(F.lit, ("residential", "primary", "motorway", "service", "tertiary_link", "living_street", "unclassified")))
    speeds = F.array(*map(F.lit, ("50", "35 mph", "50;60", "signals", "200", " 30 ")))
    column, row = k % 40, F.floor(k / 40)
    across = k % 2 == 0
    lat = F.when(across, row).otherwise(row + i) * 20000 + 412000000
    lon = F.when(across, column + i).otherwise(column) * 20000 - 960000000
    rows = table(spark, sf_dir, "part").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.select(
        k.alias("way"),
        F.element_at(classes, (k % 7 + 1).cast("int")).alias("highway"),
        F.when(size % 3 == 0, "yes").when(size % 11 == 1, "-1").when(size % 13 == 1, "reversible").alias("oneway"),
        F.when(k % 9 == 0, "private").alias("access"),
        F.when(k % 23 == 5, "yes").alias("area"),
        F.when(k % 29 == 3, "no").when(k % 29 == 4, "yes").alias("motor_vehicle"),
        F.when(k % 31 == 7, "private").alias("motorcar"),
        F.when(k % 37 == 9, "roundabout").when(k % 41 == 9, "circular").alias("junction"),
        F.when(k % 4 != 3, F.element_at(speeds, (k % 6 + 1).cast("int"))).alias("maxspeed"),
        i.alias("pos"),
        lat.cast("long").alias("lat_e7"),
        lon.cast("long").alias("lon_e7"),
    )
