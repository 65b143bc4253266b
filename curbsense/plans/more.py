"""Registered queries: sources of sightings, navigation, codecs, places, clusters and trips."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbsense.constants import BLOCKED_PENALTY_S, GUIDED_REQUESTS, OUIS
from curbsense.functions import geo, text
from curbsense.operators import lockstep, overlay, roads, routing, spatial
from curbsense.operators.tables import cut
from curbsense.plans import oracle as o
from curbsense.plans import tables, travel
from curbsense.plans.spatial import ON_ROUTE, SEGS, corridors, sql_hit
from curbsense.plans.tables import BEST, MAC, PARSED
from curbsense.sources import adapters as a
from curbsense.sources import binary, formats
from curbsense.streaming import navigation, trips

QUERIES, ORACLE_SQL = {}, {}
NOW = 1_710_000_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("camera_source_filter", "SELECT k FROM (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'relation' WHEN 1 THEN 'way' ELSE 'node' END AS t, p_partkey % 5 <> 0 AS m, p_partkey % 3 = 0 AS alpr, p_partkey % 2 = 0 AS zone, p_partkey % 7 <> 0 AS fixed, p_partkey % 11 < 6 AS brand FROM part) WHERE m AND ((t IN ('node', 'way') AND alpr) OR (t = 'node' AND zone AND fixed AND brand))")
def camera_source_filter(spark: SparkSession, d: str):
    """Which raw map elements are cameras: marked plate readers, or fixed traffic cameras of the maker."""
    k = F.col("p_partkey")
    tag = lambda name, on, value: (F.lit(name), F.when(on, value))
    pairs = [tag("man_made", k % 5 != 0, "surveillance"), tag("surveillance:type", k % 3 == 0, "ALPR"), tag("surveillance:zone", k % 2 == 0, "traffic"), tag("camera:type", k % 7 != 0, "fixed"), tag("brand", k % 11 < 6, "flock x")]
    raw = a.table(spark, d, "part").select(k.alias("k"), F.when(k % 4 == 0, "relation").when(k % 4 == 1, "way").otherwise("node").alias("osm_type"), F.create_map(*(x for p in pairs for x in p)).alias("tags"))
    t = lambda name: F.coalesce(F.element_at("tags", name), F.lit(""))
    marked = F.col("osm_type").isin("node", "way") & (t("surveillance:type") == "ALPR")
    maker = (F.col("osm_type") == "node") & (t("surveillance:zone") == "traffic") & (t("camera:type") == "fixed") & t("brand").rlike("[Ff]lock")
    return raw.where((t("man_made") == "surveillance") & (marked | maker)).select("k")


@query("oui_dim", o.with_(o.SIGHTINGS, f"seen AS (SELECT substr({MAC}, 1, 8) AS oui FROM sightings)", "makers AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in OUIS) + "]) AS oui)", select="SELECT upper(m.oui) AS oui, count(s.oui) AS sightings FROM makers m LEFT JOIN seen s ON s.oui = upper(m.oui) GROUP BY 1"))
def oui_dim(spark: SparkSession, d: str):
    """Each bundled maker prefix with the number of sightings that have it."""
    dim = spark.range(1).select(F.explode(F.array(*map(F.lit, OUIS))).alias("oui")).select(F.upper("oui").alias("oui"))
    seen = a.sightings(spark, d).groupBy(F.substring(text.mac_normalize(F.col("netid")), 1, 8).alias("oui")).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(seen, "oui", "left").select("oui", F.coalesce("n", F.lit(0)).alias("sightings"))


@query("wifi_upstream_ingest", o.with_(o.SIGHTINGS, PARSED, BEST, select="SELECT mac AS netid, substr(mac, 1, 8) AS oui, round(lat, 6) AS lat, round(lon, 6) AS lon, trim(ssid) || ', quoted' AS ssid, lasttime AS last_seen FROM best"))
def wifi_upstream_ingest(spark: SparkSession, d: str):
    """The data set's file: a header in any case, quoted names; rows that are valid, in the retention, one a device."""
    s = a.sightings(spark, d)
    blank = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat_ws(",", "netid", F.concat(F.lit('"'), F.trim("ssid"), F.lit(', quoted"')), "trilat", "trilong", blank(F.col("lasttime")), "source")
    head = spark.createDataFrame([(-1, "NetID,SSID,TriLat,TriLong,LastTime,Source")], "pos long, line string")
    rows = formats.csv_rows(head.unionByName(s.select("pos", line.alias("line"))), "netid")
    best = tables.best_of(rows)
    return best.select("netid", F.substring("netid", 1, 8).alias("oui"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "ssid", "last_seen")


@query("wifi_wigle_ingest", o.with_(o.SIGHTINGS, select=f"SELECT pos, {MAC} AS netid, CASE WHEN pos % 31 = 0 THEN ssid || ', east' ELSE ssid END AS ssid, round(lat, 6) AS lat FROM sightings WHERE length({MAC}) > 0 AND (substr({MAC}, 1, 8) IN ('70:C9:4E', '3C:91:80', 'D8:F3:BC') OR (pos % 31 <> 0 AND regexp_matches(trim(ssid), '(?i)^(flock|flock-[0-9a-f]{{4,6}}|flock\\d{{3}}|flock camera net\\.?)$'))) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND pos % 29 <> 0"))
def wifi_wigle_ingest(spark: SparkSession, d: str):
    """A wardriving file's rows that a maker prefix or a network name matches; other radios stay out, and quoted names hold commas."""
    s = a.sightings(spark, d)
    kind = F.when(F.col("pos") % 29 == 0, "BT").when(F.col("pos") % 2 == 0, "WIFI").otherwise("wifi")
    name = F.when(F.col("pos") % 31 == 0, F.concat(F.lit('"'), "ssid", F.lit(', east"'))).otherwise(F.col("ssid"))
    lines = s.select("pos", F.concat_ws(",", "netid", name, F.lit("[WPA2]"), F.lit("2024-01-01"), F.lit("6"), F.lit("-60"), "trilat", "trilong", F.lit("1"), F.lit("2"), kind).alias("line"))
    head = spark.createDataFrame([(-2, "WigleWifi-1.4,appRelease=1"), (-1, "MAC,SSID,AuthMode,FirstSeen,Channel,RSSI,CurrentLatitude,CurrentLongitude,AltitudeMeters,AccuracyMeters,Type")], "pos long, line string")
    rows = formats.scanner_rows(head.unionByName(lines))
    netid = F.explode(F.array(text.mac_normalize(F.col("mac")))).alias("netid")  # once a row
    rows = rows.where(F.upper(F.trim(F.coalesce("type", F.lit("")))).isin("", "WIFI")).select("pos", netid, "ssid", F.col("currentlatitude").try_cast("double").alias("lat"), F.col("currentlongitude").try_cast("double").alias("lon"))
    matched = F.substring("netid", 1, 8).isin(*OUIS) | text.ssid_match(F.col("ssid"))
    return rows.where(F.col("netid").isNotNull() & matched & geo.valid_coord("lat", "lon") & ~((F.col("lat") == 0) & (F.col("lon") == 0))).select("pos", "netid", "ssid", F.round("lat", 6).alias("lat"))


@query("suggest_label", "SELECT k, CASE WHEN trim(coalesce(name, '')) <> '' THEN trim(name) WHEN number THEN k || ' Harney Street' ELSE 'Durham Museum' END AS label FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN ' ' END AS name, p_partkey % 2 = 0 AS number FROM part)")
def suggest_label(spark: SparkSession, d: str):
    """A place's name, else the first line of its address, a house number joined to its street."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, " ")
    parts = F.transform(F.split(F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(", Harney Street, Omaha"))).otherwise("Durham Museum, Omaha"), ","), lambda x: F.trim(x))
    line = F.when(parts[0].rlike(r"(?i)^\d+[a-z]?$") & (F.size(parts) > 1), F.concat_ws(" ", parts[0], parts[1])).otherwise(parts[0])
    return a.table(spark, d, "part").select(k.alias("k"), F.substring(F.coalesce(F.nullif(F.trim(name), F.lit("")), line), 1, 60).alias("label"))


@query("place_reorder", o.with_(travel.PLACES, select="SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY id DESC) - 1 AS sort_order FROM places WHERE kind = 'custom'"))
def place_reorder(spark: SparkSession, d: str):
    """Each owner's custom places in the order asked for (here by id, descending); applied only where the ids are a permutation."""
    mine = travel._places(spark, d).where("kind = 'custom'")
    asked = mine.groupBy("owner").agg(F.sort_array(F.collect_list("id"), asc=False).alias("ids"))
    own = mine.groupBy("owner").agg(F.sort_array(F.collect_list("id")).alias("own"))
    valid = asked.join(own, "owner").where(F.sort_array("ids") == F.col("own"))
    return valid.select("owner", F.posexplode("ids").alias("sort_order", "id"))


DECISION = "CASE WHEN kind = 'missing' THEN CASE WHEN age < 7200 AND NOT manual THEN 'unchanged' ELSE 'direct_query' END WHEN made <= applied THEN 'unchanged' ELSE 'apply' END"


@query("snapshot_decision", f"SELECT k, {DECISION} AS decision, {NOW} - made > 1209600 AS stale FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'missing' ELSE 'found' END AS kind, o_orderkey % 5 = 0 AS manual, o_orderkey * 7 % 20000 AS age, {NOW} - o_orderkey * 7919 % 2000000 AS made, {NOW} - o_orderkey * 104729 % 2000000 AS applied FROM orders)")
def snapshot_decision(spark: SparkSession, d: str):
    """What a sync does with a published snapshot: unchanged, apply, or ask the map server where there is none."""
    k = F.col("o_orderkey")
    made, applied = NOW - k * 7919 % 2000000, NOW - k * 104729 % 2000000
    none = F.when((k * 7 % 20000 < 7200) & (k % 5 != 0), "unchanged").otherwise("direct_query")
    return a.table(spark, d, "orders").select(k.alias("k"), F.when(k % 3 == 0, none).when(made <= applied, "unchanged").otherwise("apply").alias("decision"), (NOW - made > 14 * 86_400).alias("stale"))


@query("refresh_due", f"SELECT k, hours > 0 AND targets AND (last IS NULL OR {NOW} - last >= CASE WHEN launch THEN least(3600, hours * 3600) ELSE hours * 3600 END) AS due FROM (SELECT o_orderkey AS k, o_orderkey % 4 * 6 AS hours, o_orderkey % 7 <> 0 AS targets, CASE WHEN o_orderkey % 11 <> 0 THEN {NOW} - o_orderkey * 977 % 90000 END AS last, o_orderkey % 2 = 0 AS launch FROM orders)")
def refresh_due(spark: SparkSession, d: str):
    """Whether an alert refresh is due; at launch an hour is enough."""
    k = F.col("o_orderkey")
    hours, last = k % 4 * 6, F.when(k % 11 != 0, NOW - k * 977 % 90000)
    least = F.when(k % 2 == 0, F.least(F.lit(3600), hours * 3600)).otherwise(hours * 3600)
    return a.table(spark, d, "orders").select(k.alias("k"), ((hours > 0) & (k % 7 != 0) & F.coalesce(NOW - last >= least, F.lit(True))).alias("due"))


# Routes and trips.
@query("point_to_polyline", o.with_(o.AREAS, o.VERTICES, SEGS, f"pairs AS (SELECT p.*, a.id, a.lat, a.lon FROM placed p JOIN areas a ON a.id % 4 = p.route % 4)", f"hits AS ({sql_hit('lat', 'lon')})", select="SELECT id, route, segment, round(distance_m, 1) AS distance_m, round(start_m + hit_m, 1) AS along_m FROM (SELECT *, row_number() OVER (PARTITION BY id, route ORDER BY distance_m, segment) AS rn FROM hits) WHERE rn = 1"))
def point_to_polyline(spark: SparkSession, d: str):
    """The nearest point of the routes of an area's own metro."""
    s = spatial.segments(a.vertices(spark, d)).withColumn("metro", F.col("route") % 4)
    near = a.areas(spark, d).withColumn("metro", F.col("id") % 4).join(s, "metro").withColumn("hit", geo.nearest_on_segment("lat", "lon", "lat1", "lon1", "lat2", "lon2"))
    best = near.groupBy("id", "route").agg(F.min(F.struct("hit.distance_m", "segment", (F.col("start_m") + F.col("hit.along_m")).alias("along_m"))).alias("h"))
    return best.select("id", "route", "h.segment", F.round("h.distance_m", 1).alias("distance_m"), F.round("h.along_m", 1).alias("along_m"))


@query("cameras_on_route", o.with_(*ON_ROUTE[:1], "routes AS (SELECT n_nationkey AS id, n_name AS name, 30 AS corridor_m FROM nation)", *ON_ROUTE[2:], select="SELECT route, osm_id, round(distance_m, 2) AS distance_m FROM on_route"))
def cameras_on_route(spark: SparkSession, d: str):
    """Cameras within 30 m of a route."""
    narrow = corridors(spark, d).withColumn("corridor_m", F.lit(30))
    return spatial.route_membership(a.cameras(spark, d), a.vertices(spark, d), narrow).select("route", "osm_id", F.round("distance_m", 2).alias("distance_m"))


TRIP = """trips AS (SELECT s.route, s.lat AS lat1, s.lon AS lon1, e.lat AS lat2, e.lon AS lon2 FROM vertices s JOIN vertices e ON s.route = e.route AND s.pos = 0 AND e.pos = 5),
    grid AS (SELECT route, lat1, lon1, lat2, lon2, unnest(range(CAST(floor(lon1 / CAST(0.1 AS DOUBLE)) AS BIGINT), CAST(floor(lon2 / CAST(0.1 AS DOUBLE)) AS BIGINT) + 1)) AS c, r FROM (SELECT *, unnest(range(CAST(floor(lat1 / CAST(0.1 AS DOUBLE)) AS BIGINT), CAST(floor(lat2 / CAST(0.1 AS DOUBLE)) AS BIGINT) + 1)) AS r FROM trips)),
    far AS (SELECT *, greatest(0, {d} - {h} / 2) AS metres FROM (SELECT *, (r + 0.5) * CAST(0.1 AS DOUBLE) AS cla, (c + 0.5) * CAST(0.1 AS DOUBLE) AS clo, r * CAST(0.1 AS DOUBLE) AS s, c * CAST(0.1 AS DOUBLE) AS w, (r + 1) * CAST(0.1 AS DOUBLE) AS n, (c + 1) * CAST(0.1 AS DOUBLE) AS e FROM grid))""".format(d=o.seg("cla", "clo", "lat1", "lon1", "lat2", "lon2"), h=o.hav("s", "w", "n", "e"))


def _trip_tiles(spark, d):
    """Tiles of the box about each trip with their distance from its line."""
    v = a.vertices(spark, d)
    ends = v.where("pos = 0").select("route", F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).join(v.where("pos = 5").select("route", F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "route")
    tiles = ends.withColumn("r", F.explode(F.sequence(geo.tile("lat1"), geo.tile("lat2")))).withColumn("c", F.explode(F.sequence(geo.tile("lon1"), geo.tile("lon2"))))
    mid = lambda x: (F.col(x) + 0.5) * 0.1
    half = geo.haversine_m(F.col("r") * 0.1, F.col("c") * 0.1, (F.col("r") + 1) * 0.1, (F.col("c") + 1) * 0.1) / 2
    return tiles.withColumn("metres", F.greatest(F.lit(0.0), geo.segment_distance_m(mid("r"), mid("c"), "lat1", "lon1", "lat2", "lon2") - half))


@query("trip_tiles", o.with_(o.VERTICES, TRIP, select="SELECT route, CAST(r AS INTEGER) AS tile_row, CAST(c AS INTEGER) AS tile_col, round(metres, 2) AS metres FROM far WHERE metres <= 6000"))
def trip_tiles(spark: SparkSession, d: str):
    return _trip_tiles(spark, d).where("metres <= 6000").select("route", F.col("r").alias("tile_row"), F.col("c").alias("tile_col"), F.round("metres", 2).alias("metres"))


@query("tile_order", o.with_(o.VERTICES, TRIP, select="SELECT route, CAST(r AS INTEGER) AS tile_row, CAST(c AS INTEGER) AS tile_col, row_number() OVER (PARTITION BY route ORDER BY CASE WHEN (lat1 BETWEEN s AND n AND lon1 BETWEEN w AND e) OR (lat2 BETWEEN s AND n AND lon2 BETWEEN w AND e) THEN 0 ELSE 1 END, round(metres, 3), r, c) AS place FROM far"))
def tile_order(spark: SparkSession, d: str):
    """The order to load tiles in: those with an end of the trip, then the nearest to its line."""
    inside = lambda la, lo: F.col(la).between(F.col("r") * 0.1, (F.col("r") + 1) * 0.1) & F.col(lo).between(F.col("c") * 0.1, (F.col("c") + 1) * 0.1)
    rank = F.when(inside("lat1", "lon1") | inside("lat2", "lon2"), 0).otherwise(1)
    place = F.row_number().over(W.partitionBy("route").orderBy(rank, F.round("metres", 3), "r", "c"))
    return _trip_tiles(spark, d).select("route", F.col("r").alias("tile_row"), F.col("c").alias("tile_col"), place.alias("place"))


@query("trip_parse", o.with_(o.VERTICES, SEGS, select="SELECT route, count(*) + 1 AS points, round(sum(length_m) / 1000 * CASE WHEN route % 2 = 0 THEN 1 ELSE 1 / CAST(1.609344 AS DOUBLE) END * CASE WHEN route % 2 = 0 THEN 1000 ELSE CAST(1609.344 AS DOUBLE) END, 0) AS metres, 2 AS legs FROM segs GROUP BY route"))
def trip_parse(spark: SparkSession, d: str):
    """A routing server's answer: legs joined at their shared vertex, lengths by the answer's units."""
    v = a.vertices(spark, d)
    leg = lambda low, high: F.filter("ps", lambda p: p["pos"].between(low, high))
    ps = v.groupBy("route").agg(F.sort_array(F.collect_list(F.struct("pos", "lat", "lon"))).alias("ps")).join(spatial.segments(v).groupBy("route").agg(F.sum("length_m").alias("m")), "route")
    km = F.col("route") % 2 == 0
    shapes = ps.select("route", formats.encode_polyline(leg(0, 2)).alias("s1"), formats.encode_polyline(leg(2, 5)).alias("s2"), F.when(km, "kilometers").otherwise("miles").alias("units"), F.when(km, F.col("m") / 1000).otherwise(F.col("m") / 1609.344).alias("length"))
    answer = shapes.select("route", F.to_json(F.struct(F.struct(F.array(F.struct(F.col("s1").alias("shape")), F.struct(F.col("s2").alias("shape"))).alias("legs"), "units", F.struct("length").alias("summary")).alias("trip"))).alias("body"))
    t = answer.select("route", F.from_json("body", "struct<trip:struct<legs:array<struct<shape:string>>,units:string,summary:struct<length:double>>>").getField("trip").alias("t"))
    points = t.select("route", "t", F.posexplode("t.legs.shape").alias("leg", "shape")).select("route", "t", "leg", formats.decode_polyline(F.col("shape")).alias("ps"))
    points = points.groupBy("route", "t").agg(F.sum(F.size("ps") - F.when(F.col("leg") > 0, 1).otherwise(0)).alias("points"), F.count(F.lit(1)).alias("legs"))
    metres = F.col("t.summary.length") * F.when(F.col("t.units") == "miles", 1609.344).otherwise(1000.0)
    return points.select("route", "points", F.round(metres, 0).alias("metres"), F.col("legs").cast("int").alias("legs"))


#: Tiles of the lattice that haven't arrived, for road_check.
MISSING_SQL = "(((CAST(split_part({0}, ':', 1) AS BIGINT) // 400000) * 9001 + (CAST(split_part({0}, ':', 2) AS BIGINT) + 1800000000) // 400000) % 11 = 0)"
CHECKED = f"""there AS (SELECT * FROM graph WHERE NOT {MISSING_SQL.format('u')}),
    ends AS (SELECT *, CAST(split_part(start, ':', 1) AS BIGINT) / 1e7 AS la1, CAST(split_part(start, ':', 2) AS BIGINT) / 1e7 AS lo1, CAST(split_part(goal, ':', 1) AS BIGINT) / 1e7 AS la2, CAST(split_part(goal, ':', 2) AS BIGINT) / 1e7 AS lo2 FROM trips),
    grown AS (SELECT *, greatest(CAST(1500 AS DOUBLE), 0.25 * {o.hav('la1', 'lo1', 'la2', 'lo2')}) / 111320 AS pad, cos(radians((la1 + la2) / 2)) AS c FROM ends),
    part_map AS (SELECT DISTINCT trip FROM (SELECT trip, r, unnest(range(CAST(floor((least(lo1, lo2) - pad / c + 180) * 25) AS BIGINT), CAST(floor((greatest(lo1, lo2) + pad / c + 180) * 25) AS BIGINT) + 1)) AS col FROM (SELECT *, unnest(range(CAST(floor((least(la1, la2) - pad) * 25) AS BIGINT), CAST(floor((greatest(la1, la2) + pad) * 25) AS BIGINT) + 1)) AS r FROM grown)) WHERE (r * 9001 + col) % 11 = 0)"""
FREE_THERE, FEWEST_THERE = (travel.LEAST_COST.format(name=n, graph="there", where=w) for n, w in (("free_cost", " AND e.cost < 3600"), ("least_cost", "")))


@query("road_check", travel.WALKS(CHECKED, FREE_THERE, FEWEST_THERE, select="SELECT trip, CASE WHEN f.cost IS NOT NULL THEN 'free' WHEN trip IN (SELECT trip FROM part_map) THEN 'partial' WHEN c.cost IS NOT NULL THEN 'fewest' ELSE 'unconnected' END AS status, CASE WHEN f.cost IS NOT NULL THEN 0 WHEN trip NOT IN (SELECT trip FROM part_map) THEN CAST(floor(c.cost / 3600) AS BIGINT) END AS blocked, CASE WHEN f.cost IS NOT NULL THEN round(f.cost, 3) WHEN trip NOT IN (SELECT trip FROM part_map) THEN round(c.cost - floor(c.cost / 3600) * 3600, 3) END AS secs FROM trips t LEFT JOIN free_cost f ON f.start = t.start AND f.node = t.goal LEFT JOIN least_cost c ON c.start = t.start AND c.node = t.goal"))
def road_check(spark: SparkSession, d: str):
    """What the road map says of every trip, where some tiles haven't arrived."""
    edges = cut(travel._edges(spark, d).withColumn("tile", overlay.tile_of(F.col("u"), travel.LATTICE_TILE)))
    missing = edges.where("tile % 11 = 0").select("tile").distinct()
    # Tiles without a road are missing as well: any number in the lattice's reach.
    span = spark.range(412000000 // 400000 - 50, 412000000 // 400000 + 2000).withColumnRenamed("id", "r").withColumn("c", F.explode(F.sequence(F.lit(2060), F.lit(2140))))
    missing = span.select((F.col("r") * 9001 + F.col("c")).alias("tile")).where("tile % 11 = 0").unionByName(missing).distinct()
    out = roads.road_check(travel._trips(spark, d), edges.where("tile % 11 <> 0").drop("tile"), missing, 1500.0, travel.LATTICE_TILE)
    return out.withColumn("secs", F.round("secs", 3))


# Navigation.
def _drives(spark, d):
    """A drive along each route: a fix a second at 15 m/s, some vague, with a gap, and one drive that leaves its route."""
    s = spatial.segments(a.vertices(spark, d))
    steps = s.withColumn("k", F.explode(F.sequence(F.ceil(F.col("start_m") / 15), F.ceil((F.col("start_m") + F.col("length_m")) / 15) - 1)))
    t = (F.col("k") * 15 - F.col("start_m")) / F.col("length_m")
    aside = F.when((F.col("route") % 5 == 1) & F.col("k").between(400, 500), 0.002).otherwise(0.0)
    fixes = steps.select(F.col("route").alias("trip"), "route", (F.col("k") * 1000).alias("time_ms"), F.expr("lat1").alias("lat1"), (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * t + aside).alias("lat"), (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * t).alias("lon"), F.when(F.col("k") % 50 == 0, 400.0).otherwise(8.0).alias("accuracy_m"), "k")
    return fixes.where("NOT (route % 3 = 0 AND k BETWEEN 700 AND 760)").drop("lat1", "k")


@query("nav_session_states")
def nav_session_states(spark: SparkSession, d: str):
    out = navigation.session_states(_drives(spark, d), a.vertices(spark, d))
    return out.withColumns({"progress_m": F.round("progress_m", 2), "off_m": F.round("off_m", 2)})


@query("camera_ahead_alerts", o.with_(*ON_ROUTE, "driven AS (SELECT route, CAST(unnest(range(0, 6000)) AS BIGINT) AS k FROM (SELECT DISTINCT route FROM vertices))", select="SELECT d.route AS trip, osm_id, CASE WHEN start_m + hit_m - k * 15 > 152.4 THEN 'far' ELSE 'near' END AS stage, min(k * 1000) AS time_ms FROM driven d JOIN on_route h ON h.route = d.route AND start_m + hit_m - k * 15 BETWEEN 0 AND 402.3 GROUP BY ALL"))
def camera_ahead_alerts(spark: SparkSession, d: str):
    """When a drive at 15 m/s along each route first has each camera ahead within the far and the near distance."""
    on_route = spatial.route_membership(a.cameras(spark, d), a.vertices(spark, d), corridors(spark, d)).select("route", "osm_id", "along_m")
    progress = a.routes(spark, d).select(F.col("id").alias("trip"), F.col("id").alias("route"), F.explode(F.sequence(F.lit(0), F.lit(5999))).alias("k")).select("trip", "route", (F.col("k") * 1000).cast("long").alias("time_ms"), (F.col("k") * 15.0).alias("progress_m"))
    return navigation.camera_ahead(progress, on_route)


@query("proximity_not_covered", o.with_(*ON_ROUTE, select="SELECT osm_id FROM cameras WHERE stale_since IS NULL AND osm_id NOT IN (SELECT osm_id FROM on_route)"))
def proximity_not_covered(spark: SparkSession, d: str):
    """Cameras that may alert by proximity: not those that a route's own alerts cover."""
    covered = spatial.route_membership(a.cameras(spark, d), a.vertices(spark, d), corridors(spark, d)).select("osm_id").distinct()
    return spatial.active(a.cameras(spark, d)).join(covered, "osm_id", "left_anti").select("osm_id")


GATE = """asks AS (SELECT user_id AS trip, n, n * 4000 + event_id % 3000 AS time_ms, n * 4000 + event_id % 3000 + event_id * 7919 % 30000 AS answer_ms, event_id % 3 = 0 AS ok FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)),
    gate(trip, n, time_ms, allowed, sent, answered, ok, failed) AS (SELECT trip, n, time_ms, true, time_ms, answer_ms, ok, 0 FROM asks WHERE n = 1
    UNION ALL SELECT trip, n, time_ms, go, CASE WHEN go THEN time_ms ELSE sent END, CASE WHEN go THEN answer_ms ELSE answered END, CASE WHEN go THEN new_ok ELSE ok END, CASE WHEN go THEN fails ELSE failed END
    FROM (SELECT *, answered <= time_ms AND time_ms - sent >= CASE WHEN fails <= 1 THEN 10000 WHEN fails = 2 THEN 20000 WHEN fails = 3 THEN 40000 ELSE 60000 END AS go
    FROM (SELECT a.trip, a.n, a.time_ms, a.answer_ms, a.ok AS new_ok, g.sent, g.answered, g.ok, g.failed, CASE WHEN g.answered > a.time_ms THEN g.failed WHEN g.ok THEN 0 ELSE g.failed + 1 END AS fails FROM gate g JOIN asks a ON a.trip = g.trip AND a.n = g.n + 1)))"""


@query("reroute_gate", "WITH RECURSIVE " + GATE + " SELECT trip, time_ms, allowed FROM gate")
def reroute_gate(spark: SparkSession, d: str):
    """Asks of every user, some four seconds apart, with answers that come up to half a minute later."""
    k, n = F.col("event_id"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    asks = a.table(spark, d, "events").select(F.col("user_id").alias("trip"), "event_id", (n * 4000 + k % 3000).cast("long").alias("time_ms"))
    return navigation.reroute_gate(asks.select("trip", "time_ms", (F.col("time_ms") + k * 7919 % 30000).alias("answer_ms"), (k % 3 == 0).alias("ok")))


@query("trip_sessions")
def trip_sessions(spark: SparkSession, d: str):
    """The drives along the routes with their requests for new routes, answered after some seconds, up to a minute after the last fix."""
    fixes = _drives(spark, d).select("trip", "route", "time_ms", F.lit("fix").alias("kind"), "lat", "lon", "accuracy_m", F.expr("CAST(NULL AS BIGINT) AS request"), F.expr("CAST(NULL AS array<struct<lat:double,lon:double>>) AS line"))
    asked = navigation.session_states(_drives(spark, d), a.vertices(spark, d)).where("state = 'off_route'").groupBy("trip").agg(F.min("time_ms").alias("time_ms"))
    fails = asked.select("trip", F.expr("CAST(NULL AS BIGINT) AS route"), (F.col("time_ms") + 7000).alias("time_ms"), F.lit("answer").alias("kind"), *(F.lit(None).cast("double").alias(c) for c in ("lat", "lon", "accuracy_m")), F.lit(0).cast("long").alias("request"), F.expr("CAST(NULL AS array<struct<lat:double,lon:double>>) AS line"))
    out = trips.trip_states(fixes.unionByName(fails), a.vertices(spark, d), 10**9)
    return out.withColumns({"progress_m": F.round("progress_m", 2), "off_m": F.round("off_m", 2)})


# Codecs.
@query("road_codec_roundtrip", o.with_(o.WAYS, travel.DRIVABLE, select="SELECT way, direction, kmh, pos, lat_e7, lon_e7 FROM drivable"))
def road_codec_roundtrip(spark: SparkSession, d: str):
    ways = binary.tiled(formats.drivable(a.ways(spark, d)))
    return binary.unpack_ways(binary.pack_ways(ways.select("tile", "way", "direction", "kmh", "pos", "lat_e7", "lon_e7"))).drop("tile")


@query("ffp1_roundtrip", o.with_(o.CAMERAS, select="SELECT osm_id, round(lat, 7) AS lat, round(lon, 7) AS lon, CASE category WHEN 'flock' THEN 0 WHEN 'alpr' THEN 1 ELSE 2 END + CASE WHEN stale_since IS NOT NULL THEN 4 ELSE 0 END + CASE osm_type WHEN 'node' THEN 0 ELSE 16 END AS flags, operator, direction FROM cameras"))
def ffp1_roundtrip(spark: SparkSession, d: str):
    flags = travel.ffp1_flags(spark, d)
    points = a.cameras(spark, d).join(flags, "osm_id").select(F.floor(F.col("osm_id") / 10000).alias("part"), "osm_id", "lat", "lon", "flags", "operator", "direction")
    return binary.unpack_points(binary.pack_points(points)).withColumns({"lat": F.round("lat", 7), "lon": F.round("lon", 7)})


@query("plan_phase1")
def plan_phase1(spark: SparkSession, d: str):
    """Routes found by excluding, request after request, the blocked segments that answers pass."""
    trips = travel._trips(spark, d, a.table(spark, d, "supplier").select((F.col("s_suppkey") * 20 - 3).alias("way")))
    out = roads.plan_exclusions(trips, travel._edges(spark, d)).drop("path")
    return out.withColumns({"fastest_s": F.round("fastest_s", 3), "best_s": F.round("best_s", 3)})


MATCHED = f"""drives AS (SELECT route, CAST(k AS BIGINT) AS k, lat1 + (lat2 - lat1) * (k * 15 - start_m) / length_m + 0.0001 AS lat, lon1 + (lon2 - lon1) * (k * 15 - start_m) / length_m AS lon, {o.bearing('lat1', 'lon1', 'lat2', 'lon2')} AS course FROM placed, range(0, 8000, 40) t(k) WHERE k * 15 >= start_m AND k * 15 < start_m + length_m),
    scored AS (SELECT d.route, d.k, p.segment, {o.seg('d.lat', 'd.lon', 'lat1', 'lon1', 'lat2', 'lon2')} AS off, least({o.pmod(f"d.course - {o.bearing('lat1', 'lon1', 'lat2', 'lon2')}", 'CAST(360 AS DOUBLE)')}, 360 - {o.pmod(f"d.course - {o.bearing('lat1', 'lon1', 'lat2', 'lon2')}", 'CAST(360 AS DOUBLE)')}) AS diff FROM drives d JOIN placed p ON p.route = d.route)"""


@query("map_match_whole", o.with_(o.VERTICES, SEGS, MATCHED, select="SELECT route, k, segment, round(off, 2) AS off_m FROM (SELECT *, row_number() OVER (PARTITION BY route, k ORDER BY off + CASE WHEN diff > 45 THEN 60 * least(1, (diff - 45) / 90) ELSE 0 END, segment) AS rn FROM scored) WHERE rn = 1"))
def map_match_whole(spark: SparkSession, d: str):
    """Fixes matched to their whole route by distance, with a penalty where the segment heads elsewhere."""
    s = spatial.segments(a.vertices(spark, d))
    k = F.col("k")
    t = (k * 15 - F.col("start_m")) / F.col("length_m")
    first = F.ceil(F.col("start_m") / 600) * 40
    fixes = s.withColumn("k", F.explode(F.sequence(first, F.greatest(first, F.lit(7960)), F.lit(40)))).where("k * 15 >= start_m AND k * 15 < start_m + length_m AND k < 8000")
    fixes = fixes.select("route", "k", (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * t + 0.0001).alias("lat"), (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * t).alias("lon"), geo.bearing_deg("lat1", "lon1", "lat2", "lon2").alias("course"))
    pairs = fixes.join(s, "route").withColumn("off", geo.segment_distance_m("lat", "lon", "lat1", "lon1", "lat2", "lon2")).withColumn("diff", geo.angle_diff("course", geo.bearing_deg("lat1", "lon1", "lat2", "lon2")))
    score = F.col("off") + F.when(F.col("diff") > 45, 60 * F.least(F.lit(1.0), (F.col("diff") - 45) / 90)).otherwise(0.0)
    best = pairs.groupBy("route", "k").agg(F.min(F.struct(score.alias("score"), "segment", "off")).alias("m"))
    return best.select("route", "k", "m.segment", F.round("m.off", 2).alias("off_m"))


BEND_LINES = """lines AS MATERIALIZED (SELECT *, start_m + length_m AS end_m, lead(segment) OVER (PARTITION BY route ORDER BY segment) IS NULL AS last FROM (SELECT *, coalesce(sum(length_m) OVER (PARTITION BY route ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start_m FROM (SELECT *, HAV AS length_m FROM (SELECT route, pos AS segment, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM bends WINDOW w AS (PARTITION BY route ORDER BY pos)) WHERE lat2 IS NOT NULL)))""".replace("HAV", o.hav("lat1", "lon1", "lat2", "lon2"))
TURN = f"CASE WHEN course IS NULL THEN 0 ELSE 60 * least(1, greatest(0, least({o.pmod('course - bearing', 'CAST(360 AS DOUBLE)')}, 360 - {o.pmod('course - bearing', 'CAST(360 AS DOUBLE)')}) - 45) / 90) END"
WALK = f"""fixes AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY trip ORDER BY time_ms, lat, lon) AS INTEGER) AS n FROM bend_drives),
    found AS MATERIALIZED (SELECT * FROM (SELECT f.trip, f.n, f.time_ms, f.lat, f.lon, segment, start_m, end_m, last, {o.bearing('lat1', 'lon1', 'lat2', 'lon2')} AS bearing, {o.seg('f.lat', 'f.lon', 'lat1', 'lon1', 'lat2', 'lon2')} AS off, start_m + length_m * {o.fraction('f.lat', 'f.lon', 'lat1', 'lon1', 'lat2', 'lon2')} AS along FROM fixes f JOIN lines l ON l.route = f.route) WHERE off <= 60),
    seen AS (SELECT *, CASE WHEN gap > 0 THEN moved / gap ELSE 0 END AS speed FROM (SELECT *, row_number() OVER w AS step, (time_ms - lag(time_ms) OVER w) / 1000.0 AS gap, lag(lat) OVER w AS p, lag(lon) OVER w AS q, {o.hav('p', 'q', 'lat', 'lon')} AS moved FROM (SELECT DISTINCT trip, n, time_ms, lat, lon FROM found) WINDOW w AS (PARTITION BY trip ORDER BY n))),
    here AS MATERIALIZED (SELECT f.*, s.step, course, ahead, off + {TURN} AS cost FROM found f JOIN (SELECT *, CASE WHEN speed >= 2 AND moved > 3 THEN {o.bearing('p', 'q', 'lat', 'lon')} END AS course, greatest(150, speed * greatest(gap, 1) * 2 + 100) AS ahead FROM seen) s ON s.trip = f.trip AND s.n = f.n),
    walk AS (SELECT trip, step, n, arg_min(struct_pack(segment, along, off), struct_pack(c := round(cost, 3), segment := segment)) AS m FROM here WHERE step = 1 GROUP BY trip, step, n
        UNION ALL SELECT trip, step, n, arg_min(struct_pack(segment, along, off), struct_pack(outside := NOT inside, c := round(cost + CASE WHEN inside THEN 0.5 * greatest(0, before - along) ELSE 0 END, 3), segment := segment)) FROM (SELECT h.*, w.m.along AS before, h.start_m <= w.m.along + h.ahead AND (h.last OR h.end_m > greatest(0, w.m.along - 40)) AS inside FROM walk w JOIN here h ON h.trip = w.trip AND h.step = w.step + 1) GROUP BY trip, step, n)"""


@query("map_match_windowed", o.with_(o.BENDS, o.BEND_DRIVES, BEND_LINES, WALK, select="SELECT f.trip, f.n, f.time_ms, CAST(m.segment AS INTEGER) AS segment, round(m.along, 2) AS along_m, round(m.off, 2) AS off_m FROM fixes f LEFT JOIN walk w ON w.trip = f.trip AND w.n = f.n").replace("WITH", "WITH RECURSIVE", 1))
def map_match_windowed(spark: SparkSession, d: str):
    """Drives along streets in bends: the nearest row is often another one, and the window about the last match tells which."""
    out = lockstep.matched(a.bend_drives(spark, d), a.bends(spark, d))
    return out.withColumns({"along_m": F.round("along_m", 2), "off_m": F.round("off_m", 2)})


FEATURE = """'{"type":"Feature","properties":{"kind":"camera","category":"' || h.category || '","osm_type":"' || h.osm_type || '","osm_id":' || h.osm_id || ',"along_m":' || printf('%.1f', round(start_m + hit_m, 1)) || ',"distance_from_route_m":' || printf('%.1f', round(h.distance_m, 1)) || '},"geometry":{"type":"Point","coordinates":[' || printf('%.4f', h.lon) || ',' || printf('%.4f', h.lat) || ']}}'"""


@query("route_report_geojson", o.with_(*ON_ROUTE, "lines AS (SELECT v.route, '{\"type\":\"LineString\",\"coordinates\":[' || string_agg('[' || printf('%.4f', v.lon) || ',' || printf('%.4f', v.lat) || ']', ',' ORDER BY v.pos) || ']}' AS line FROM vertices v GROUP BY v.route)", f"cams AS (SELECT h.route, ',' || string_agg({FEATURE}, ',' ORDER BY start_m + hit_m, h.osm_type, h.osm_id) AS features FROM (SELECT x.*, c.category FROM on_route x JOIN cameras c ON c.osm_type = x.osm_type AND c.osm_id = x.osm_id) h GROUP BY h.route)", select="""SELECT r.id AS route, '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"kind":"route","name":"' || r.name || '","corridor_m":' || r.corridor_m || '},"geometry":' || line || '}' || coalesce(features, '') || ']}' AS report FROM routes r JOIN lines l ON l.route = r.id LEFT JOIN cams c ON c.route = r.id"""))
def route_report_geojson(spark: SparkSession, d: str):
    """Each route's report as a collection: the route, then its cameras along it."""
    cams = a.cameras(spark, d)
    hits = spatial.route_membership(cams, a.vertices(spark, d), corridors(spark, d)).join(cams.select("osm_type", "osm_id", "lat", "lon", "category"), ["osm_type", "osm_id"])
    feature = F.format_string('{"type":"Feature","properties":{"kind":"camera","category":"%s","osm_type":"%s","osm_id":%d,"along_m":%.1f,"distance_from_route_m":%.1f},"geometry":{"type":"Point","coordinates":[%.4f,%.4f]}}', "category", "osm_type", "osm_id", F.round("along_m", 1), F.round("distance_m", 1), "lon", "lat")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("along_m", "osm_type", "osm_id", feature.alias("f")))), lambda x: x["f"])
    features = hits.groupBy("route").agg(F.concat(F.lit(","), F.array_join(ordered, ",")).alias("features"))
    routes = a.routes(spark, d).withColumnRenamed("id", "route").join(travel.linestring_geojson(spark, d), "route").join(features, "route", "left")
    head = F.format_string('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"kind":"route","name":"%s","corridor_m":%d},"geometry":%s}', "name", "corridor_m", "geojson")
    return routes.select("route", F.concat(head, F.coalesce("features", F.lit("")), F.lit("]}")).alias("report"))


MANIFEST = "CASE WHEN k % 7 = 0 THEN 'format' WHEN k % 7 = 1 THEN 'file' WHEN k % 7 = 2 THEN 'sha256' WHEN k % 7 = 3 THEN 'elements' WHEN k % 7 = 4 THEN 'json' END"


@query("manifest_parse", f"SELECT k, {MANIFEST} AS problem, CASE WHEN k % 7 > 4 THEN 'cams-' || k || '.json.gz' END AS file FROM (SELECT n_nationkey AS k FROM nation)")
def manifest_parse(spark: SparkSession, d: str):
    """Manifests, some of another format, with an unsafe file name, a broken digest, no elements, or no JSON at all."""
    k = F.col("n_nationkey")
    at = k % 7
    body = F.format_string('{"format": %d, "file": "%s", "sha256": "%s", "bytes": 10, "elements": %d}', F.when(at == 0, 9).otherwise(formats.SNAPSHOT_FORMAT), F.when(at == 1, "../up").otherwise(F.format_string("cams-%d.json.gz", k)), F.when(at == 2, "ff").otherwise(F.sha2(k.cast("string"), 256)), F.when(at == 3, 0).otherwise(7))
    rows = a.table(spark, d, "nation").select(k.alias("k"), F.when(at == 4, "{").otherwise(body).alias("body"))
    return formats.manifests(rows).select("k", "problem", F.when(F.col("problem").isNull(), F.col("m.file")).alias("file"))


@query("snapshot_decode", "SELECT n_nationkey AS path, n_name || ' é' AS body, CASE WHEN n_nationkey % 3 = 1 THEN 'digest' END AS reason FROM nation WHERE n_nationkey % 3 <> 1 UNION ALL SELECT n_nationkey, NULL, 'digest' FROM nation WHERE n_nationkey % 3 = 1")
def snapshot_decode(spark: SparkSession, d: str):
    """Compressed files that their manifest confirms, inflated."""
    rows = a.table(spark, d, "nation").select(F.col("n_nationkey").alias("path"), formats.deflated(F.concat("n_name", F.lit(" é"))).alias("content"))
    digest = F.when(F.col("path") % 3 == 1, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.sha2("content", 256))
    manifest = rows.select("path", F.octet_length("content").alias("bytes"), digest.alias("sha256"))
    return formats.decoded(rows, manifest)


def _routed(spark, d):
    """Trips over the lattice, a road map, and a router to which one edge in 29 of the map is closed."""
    trips = travel._trips(spark, d, a.table(spark, d, "supplier").select((F.col("s_suppkey") * 20 - 3).alias("way")))
    edges = cut(travel._edges(spark, d))
    drives = edges.where(F.pmod(F.xxhash64("u", "v"), F.lit(29)) != 0)
    return trips, edges, routing.GraphRouter(edges, trips, BLOCKED_PENALTY_S), routing.GraphRouter(drives, trips)


@query("guided_routes")
def guided_routes(spark: SparkSession, d: str):
    """Trips kept on the road map's paths leg by leg, by a router that refuses some of its edges."""
    trips, _, road_map, router = _routed(spark, d)
    out = routing.guide(trips.withColumn("budget", F.lit(GUIDED_REQUESTS)), road_map, router, leg_m=1000.0)
    return out.select("trip", "outcome", "requests", "plans", F.round(routing.seconds(F.col("path")), 3).alias("secs"), F.size(routing.blocked_edges(F.col("path"))).alias("blocked"))


@query("rerouted_cars")
def rerouted_cars(spark: SparkSession, d: str):
    """Cars that took another way after the fourth edge of their path; some want the fastest way."""
    trips, edges, road_map, router = _routed(spark, d)
    whole = road_map.answer(trips.select("trip", F.lit(0).alias("request"), F.array("start", "goal").alias("stops"), F.array().cast("array<string>").alias("excluded")))
    old = cut(whole.select("trip", F.posexplode("path").alias("nth", "e")).select("trip", "nth", "e.*"))
    # A node beside the path from which a way leads on.
    on_path = old.select("trip", F.col("u").alias("v")).union(old.select("trip", "v"))
    turns = edges.select(F.col("u").alias("node"), "v").join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    beside = old.where("nth = 3").select("trip", F.col("v").alias("node")).join(turns, "node").join(on_path, ["trip", "v"], "left_anti")
    cars = beside.groupBy("trip").agg(F.min("v").alias("start")).select("trip", "start", F.lit(800.0).alias("progress_m"), (F.col("trip") % 100 == 17).alias("fastest"))
    out = routing.reroute(cars, old, road_map, router)
    return out.select("trip", "status", "requests", "ahead", F.round(routing.seconds(F.col("path")), 3).alias("secs"), F.size(routing.blocked_edges(F.col("path"))).alias("blocked"))
