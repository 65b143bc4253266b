"""Registered queries: grid, geometry, spatial scans and joins."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from curbsense.functions import geo
from curbsense.operators import spatial
from curbsense.plans import oracle as o
from curbsense.sources import adapters as a

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r3(x: Column | str) -> Column:
    return F.round(x, 3)


def sql_row(lat: str) -> str:
    return f"CAST(greatest(-1800, least(1799, floor(greatest(-90, least(90, {lat})) / CAST(0.05 AS DOUBLE) + CAST(1e-9 AS DOUBLE)))) AS INTEGER)"


def sql_col(lon: str) -> str:
    return f"CAST(greatest(-3600, least(3599, floor({o.wrap(lon)} / CAST(0.05 AS DOUBLE) + CAST(1e-9 AS DOUBLE)))) AS INTEGER)"


def sql_last(x: str, low: int, high: int) -> str:
    return f"CAST(greatest({low}, least({high}, ceil({x} / CAST(0.05 AS DOUBLE) - CAST(1e-9 AS DOUBLE)) - 1)) AS INTEGER)"


CIRCLE = """circle AS (SELECT *, greatest(-90.0, lat - dlat) AS south, least(90.0, lat + dlat) AS north, {w} AS west, {e} AS east FROM (
    SELECT *, radius_m / CAST(111320 AS DOUBLE) AS dlat, radius_m / (CAST(111320 AS DOUBLE) * greatest(abs(cos(radians(lat))), CAST(0.01 AS DOUBLE))) AS dlon FROM areas))""".format(w=o.wrap("(lon - dlon)"), e=o.wrap("(lon + dlon)"))

MEMBERS = f"""members AS (SELECT a.id AS area, osm_type, osm_id, {o.hav('a.lat', 'a.lon', 'c.lat', 'c.lon')} AS distance_m FROM circle a JOIN cameras c
    ON c.stale_since IS NULL AND c.lat BETWEEN south AND north AND CASE WHEN west > east THEN c.lon >= west OR c.lon <= east ELSE c.lon BETWEEN west AND east END
    AND {o.hav('a.lat', 'a.lon', 'c.lat', 'c.lon')} <= radius_m)"""


@query("area_membership", o.with_(o.CAMERAS, o.AREAS, CIRCLE, MEMBERS, select="SELECT area, osm_type, osm_id, round(distance_m, 3) AS distance_m FROM members"))
def area_membership(spark: SparkSession, d: str):
    return spatial.area_membership(a.cameras(spark, d), a.areas(spark, d)).withColumn("distance_m", r3("distance_m"))


@query("area_overlap", o.with_(o.CAMERAS, o.AREAS, CIRCLE, MEMBERS, select="SELECT x.area, y.area AS other, count(*) AS shared FROM members x JOIN members y USING (osm_type, osm_id) WHERE x.area <> y.area GROUP BY ALL"))
def area_overlap(spark: SparkSession, d: str):
    return spatial.area_overlap(a.cameras(spark, d), a.areas(spark, d))


@query("bbox_scan", o.with_(o.CAMERAS, select="SELECT osm_type, osm_id FROM cameras WHERE lat BETWEEN 51 AND 52 AND (lon >= 179.5 OR lon <= -179.5)"))
def bbox_scan(spark: SparkSession, d: str):
    return spatial.bbox_scan(a.cameras(spark, d), 51.0, 179.5, 52.0, -179.5).select("osm_type", "osm_id")


NEAR = "lat BETWEEN 45.5 - CAST(5000 AS DOUBLE) / 111320 AND 45.5 + CAST(5000 AS DOUBLE) / 111320 AND lon BETWEEN -122.65 - 5000 / (111320 * cos(radians(CAST(45.5 AS DOUBLE)))) AND -122.65 + 5000 / (111320 * cos(radians(CAST(45.5 AS DOUBLE))))"


@query("cameras_near", o.with_(o.CAMERAS, select=f"SELECT osm_type, osm_id FROM cameras WHERE {NEAR}"))
def cameras_near(spark: SparkSession, d: str):
    """A square window about a point; the radius is held to 100 to 5,000 m, and stale rows count."""
    radius = max(100.0, min(5000.0, 9000.0))
    return a.cameras(spark, d).where(geo.in_box("lat", "lon", geo.circle_box(45.5, -122.65, radius))).select("osm_type", "osm_id")


@query("cameras_by_keys", o.with_(o.CAMERAS, select="SELECT k.pos, osm_type, osm_id, category FROM (VALUES (0, 'node', 7), (1, 'way', 97), (2, 'node', 3), (4, 'node', 7)) k(pos, t, i) JOIN cameras ON osm_type = t AND osm_id = i"))
def cameras_by_keys(spark: SparkSession, d: str):
    """Cameras by "type/id" keys, in the order asked for; keys that are none are dropped."""
    asked = spark.range(1).select(F.posexplode(F.array(*map(F.lit, ("node/7", "way/97", "node/3", "bad", "node/7")))).alias("pos", "key"))
    keys = asked.select("pos", F.split("key", "/")[0].alias("osm_type"), F.expr("try_cast(get(split(key, '/'), 1) AS BIGINT)").alias("osm_id")).where("osm_id IS NOT NULL")
    return a.cameras(spark, d).join(F.broadcast(keys), ["osm_type", "osm_id"]).select("pos", "osm_type", "osm_id", "category").orderBy("pos")


@query("grid_cell", o.with_(o.CAMERAS, select=f"SELECT osm_id, {sql_row('lat')} AS cell_row, {sql_col('lon')} AS cell_col, {sql_row('lat')} || ':' || {sql_col('lon')} AS cell_key FROM cameras"))
def grid_cell(spark: SparkSession, d: str):
    cells = a.cameras(spark, d).select("osm_id", geo.grid_cell("lat", "lon").alias("cell"))
    return cells.select("osm_id", F.col("cell.row").alias("cell_row"), F.col("cell.col").alias("cell_col"), F.concat_ws(":", "cell.row", "cell.col").alias("cell_key"))


@query("wrap_lon", f"SELECT o_orderkey, round({o.wrap('(o_orderkey * 7.5 - 4000)')}, 6) AS lon FROM orders")
def wrap_lon(spark: SparkSession, d: str):
    return a.table(spark, d, "orders").select("o_orderkey", F.round(geo.wrap_lon(F.col("o_orderkey") * 7.5 - 4000), 6).alias("lon"))


@query("bbox_normalize", f"""SELECT k, round(least(s, n), 6) AS south, round(greatest(s, n), 6) AS north, round(CASE WHEN e - w >= 360 THEN -180 ELSE {o.wrap('w')} END, 6) AS west,
    round(CASE WHEN e - w >= 360 THEN 180 WHEN abs(e - 180) < 1e-12 THEN 180 ELSE {o.wrap('e')} END, 6) AS east
    FROM (SELECT p_partkey AS k, greatest(-90.0, least(90.0, CAST(p_partkey * 37 % 220 - 110 AS DOUBLE))) AS s, greatest(-90.0, least(90.0, CAST(p_partkey * 53 % 200 - 100 AS DOUBLE))) AS n,
    CAST(p_partkey * 29 % 500 - 250 AS DOUBLE) AS w, CAST(p_partkey * 29 % 500 - 250 + p_partkey % 380 AS DOUBLE) AS e FROM part)""")
def bbox_normalize(spark: SparkSession, d: str):
    k = F.col("p_partkey")
    west = (k * 29 % 500 - 250).cast("double")
    box = geo.sanitized_box((k * 37 % 220 - 110).cast("double"), west, (k * 53 % 200 - 100).cast("double"), west + k % 380)
    return a.table(spark, d, "part").select(k.alias("k"), box.alias("b")).select("k", *(F.round(f"b.{x}", 6).alias(x) for x in ("south", "west", "north", "east")))


CELLS = f"""parts AS (SELECT id, south, north, west AS w, CASE WHEN west > east THEN 180.0 ELSE east END AS e FROM circle UNION ALL SELECT id, south, north, -180.0, east FROM circle WHERE west > east),
    spans AS (SELECT id, {sql_row('south')} AS r0, greatest({sql_row('south')}, {sql_last('north', -1800, 1799)}) AS r1, {sql_col('w')} AS c0, greatest({sql_col('w')}, {sql_last('e', -3600, 3599)}) AS c1 FROM parts),
    cells AS (SELECT DISTINCT id, CAST(r AS INTEGER) AS cell_row, CAST(c AS INTEGER) AS cell_col FROM (SELECT *, unnest(range(c0, c1 + 1)) AS c FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM spans)))"""


def _area_cells(spark: SparkSession, d: str):
    box = geo.circle_box("lat", "lon", F.col("radius_m").cast("double"))
    return a.areas(spark, d).select("id", F.explode(geo.box_cells(box)).alias("cell")).select("id", F.col("cell.row").alias("cell_row"), F.col("cell.col").alias("cell_col"))


@query("circle_cells", o.with_(o.AREAS, CIRCLE, CELLS, select="SELECT * FROM cells"))
def circle_cells(spark: SparkSession, d: str):
    return _area_cells(spark, d)


@query("cells_union_bbox", o.with_(o.AREAS, CIRCLE, CELLS, select="SELECT id, round(greatest(-90, min(cell_row) * CAST(0.05 AS DOUBLE)), 6) AS south, round(greatest(-180, min(cell_col) * CAST(0.05 AS DOUBLE)), 6) AS west, round(least(90, max(cell_row) * CAST(0.05 AS DOUBLE) + 0.05), 6) AS north, round(least(180, max(cell_col) * CAST(0.05 AS DOUBLE) + 0.05), 6) AS east FROM cells GROUP BY id"))
def cells_union_bbox(spark: SparkSession, d: str):
    edge = lambda f, name, plus: f(F.col(name) * 0.05 + plus)
    found = _area_cells(spark, d).groupBy("id").agg(edge(F.min, "cell_row", 0.0).alias("s"), edge(F.min, "cell_col", 0.0).alias("w"), edge(F.max, "cell_row", 0.05).alias("n"), edge(F.max, "cell_col", 0.05).alias("e"))
    return found.select("id", F.round(F.greatest("s", F.lit(-90.0)), 6).alias("south"), F.round(F.greatest("w", F.lit(-180.0)), 6).alias("west"), F.round(F.least("n", F.lit(90.0)), 6).alias("north"), F.round(F.least("e", F.lit(180.0)), 6).alias("east"))


SUPER = "SELECT id, CAST(floor(cell_row / 20.0) AS BIGINT) AS super_row, CAST(floor(cell_col / 20.0) AS BIGINT) AS super_col, count(*) AS cells, min(cell_row) AS first_row, max(cell_row) AS last_row FROM cells GROUP BY ALL"


@query("super_cells", o.with_(o.AREAS, CIRCLE, CELLS, select=SUPER))
def super_cells(spark: SparkSession, d: str):
    """Cells grouped 20 by 20 for one request each."""
    return _area_cells(spark, d).groupBy("id", F.floor(F.col("cell_row") / 20).alias("super_row"), F.floor(F.col("cell_col") / 20).alias("super_col")).agg(F.count(F.lit(1)).alias("cells"), F.min("cell_row").alias("first_row"), F.max("cell_row").alias("last_row"))


@query("bbox_cells", o.with_(o.CAMERAS, select="""SELECT k, CAST(r AS INTEGER) AS cell_row, CAST(c AS INTEGER) AS cell_col FROM (SELECT k, r0 + unnest(range(k % 3 + 1)) AS r, c0, k FROM (SELECT n_nationkey AS k, n_nationkey * 31 % 1000 - 500 AS r0, n_nationkey * 17 % 1000 - 500 AS c0 FROM nation)) t, unnest(range(2)) u(j), (SELECT 1) z, LATERAL (SELECT c0 + j AS c)"""))
def bbox_cells(spark: SparkSession, d: str):
    """Boxes on grid lines: the cell beyond a north or east edge stays out."""
    k = F.col("n_nationkey")
    south, west = (k * 31 % 1000 - 500) * 0.05, (k * 17 % 1000 - 500) * 0.05
    box = geo.sanitized_box(south, west, south + (k % 3 + 1) * 0.05, west + 0.1)
    return a.table(spark, d, "nation").select(k.alias("k"), F.explode(geo.box_cells(box)).alias("c")).select("k", F.col("c.row").alias("cell_row"), F.col("c.col").alias("cell_col"))


COUNTED = "SELECT g.cell_row, g.cell_col, count(c.osm_id) AS cameras FROM (SELECT CAST(r AS INTEGER) AS cell_row, CAST(c AS INTEGER) AS cell_col FROM range(908, 914) x(r), range(-2456, -2450) y(c)) g LEFT JOIN cameras c ON c.lat BETWEEN g.cell_row * CAST(0.05 AS DOUBLE) AND g.cell_row * CAST(0.05 AS DOUBLE) + 0.05 AND c.lon BETWEEN g.cell_col * CAST(0.05 AS DOUBLE) AND g.cell_col * CAST(0.05 AS DOUBLE) + 0.05 GROUP BY ALL"


@query("cell_counts", o.with_(o.CAMERAS, select=COUNTED))
def cell_counts(spark: SparkSession, d: str):
    """Cameras of each cell of a block, edges inclusive: one on a shared edge counts for both cells."""
    cells = spark.range(908, 914).select(F.col("id").cast("int").alias("cell_row")).join(F.broadcast(spark.range(-2456, -2450).select(F.col("id").cast("int").alias("cell_col"))))
    size = F.lit(0.05)
    # A point lies in its own cell or, on an edge, in the one before.
    points = a.cameras(spark, d).select("osm_id", "lat", "lon", geo.grid_cell("lat", "lon").alias("c"))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    points = points.withColumn("cell_row", F.explode(F.transform(steps, lambda s: F.col("c.row") + s))).withColumn("cell_col", F.explode(F.transform(steps, lambda s: F.col("c.col") + s)))
    points = points.where(F.col("lat").between(F.col("cell_row") * size, F.col("cell_row") * size + size) & F.col("lon").between(F.col("cell_col") * size, F.col("cell_col") * size + size))
    return cells.join(points.select("cell_row", "cell_col", "osm_id"), ["cell_row", "cell_col"], "left").groupBy("cell_row", "cell_col").agg(F.count("osm_id").alias("cameras"))


PAIR = o.with_(o.CAMERAS, select="SELECT {} FROM cameras")
C0 = "CAST(41.25 AS DOUBLE)", "CAST(-96.02 AS DOUBLE)"


@query("haversine", PAIR.format(f"osm_id, round({o.hav(*C0, 'lat', 'lon')}, 3) AS metres"))
def haversine(spark: SparkSession, d: str):
    return a.cameras(spark, d).select("osm_id", r3(geo.haversine_m(41.25, -96.02, "lat", "lon")).alias("metres"))


@query("bearing", PAIR.format(f"osm_id, round({o.bearing(*C0, 'lat', 'lon')}, 4) AS degrees"))
def bearing(spark: SparkSession, d: str):
    return a.cameras(spark, d).select("osm_id", F.round(geo.bearing_deg(41.25, -96.02, "lat", "lon"), 4).alias("degrees"))


@query("mercator", PAIR.format("osm_id, round(lon / 360 + 0.5, 9) AS x, round(greatest(0, least(1, 0.5 - 0.25 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / pi())), 9) AS y"))
def mercator(spark: SparkSession, d: str):
    return a.cameras(spark, d).select("osm_id", F.round(geo.merc_x("lon"), 9).alias("x"), F.round(geo.merc_y("lat"), 9).alias("y"))


@query("segment_distance", PAIR.format(f"osm_id, round({o.seg('lat', 'lon', 'CAST(41.2 AS DOUBLE)', 'CAST(-96.1 AS DOUBLE)', 'CAST(41.3 AS DOUBLE)', 'CAST(-95.9 AS DOUBLE)')}, 3) AS metres") + " WHERE lat BETWEEN 40 AND 42 AND lon BETWEEN -98 AND -94")
def segment_distance(spark: SparkSession, d: str):
    near = a.cameras(spark, d).where(F.col("lat").between(40, 42) & F.col("lon").between(-98, -94))
    return near.select("osm_id", r3(geo.segment_distance_m("lat", "lon", 41.2, -96.1, 41.3, -95.9)).alias("metres"))


@query("circle_polygon", o.with_(o.AREAS, select="""SELECT id, CAST(i AS INTEGER) AS i, round(degrees(la), 6) AS lat, round(lon + degrees(atan2(sin(b) * sin(dd) * cos(radians(lat)), cos(dd) - sin(radians(lat)) * sin(la))), 6) AS lon
    FROM (SELECT *, asin(sin(radians(lat)) * cos(dd) + cos(radians(lat)) * sin(dd) * cos(b)) AS la FROM (SELECT id, lat, lon, radius_m / CAST(6371008.8 AS DOUBLE) AS dd, i, radians(CAST(i * 360 AS DOUBLE) / 64) AS b FROM areas, range(65) t(i)))"""))
def circle_polygon(spark: SparkSession, d: str):
    """The closed ring of 65 points about each area."""
    ring = a.areas(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(64))))
    return ring.select("id", "i", geo.destination("lat", "lon", F.col("i") * 360.0 / 64, F.col("radius_m").cast("double")).alias("p")).select("id", "i", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


SEGS = f"""segs AS (SELECT *, {o.hav('lat1', 'lon1', 'lat2', 'lon2')} AS length_m FROM (SELECT route, pos AS segment, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM vertices WINDOW w AS (PARTITION BY route ORDER BY pos)) WHERE lat2 IS NOT NULL),
    placed AS (SELECT *, coalesce(sum(length_m) OVER (PARTITION BY route ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_m FROM segs)"""


def sql_hit(lat: str, lon: str) -> str:
    """Adds d13, turn, distance_m and hit_m to rows with a point and a segment."""
    return f"""SELECT *, CASE WHEN length_m <= 0 OR along <= 0 THEN d13 * {o.d(o.R)} WHEN along >= length_m THEN {o.hav(lat, lon, 'lat2', 'lon2')} ELSE abs(asin(greatest(-1.0, least(1.0, sin(d13) * sin(turn))))) * {o.d(o.R)} END AS distance_m,
        CASE WHEN length_m <= 0 OR along <= 0 THEN 0 WHEN along >= length_m THEN length_m ELSE along END AS hit_m
        FROM (SELECT *, atan2(sin(d13) * cos(turn), cos(d13)) * {o.d(o.R)} AS along FROM (SELECT *, {o.hav('lat1', 'lon1', lat, lon)} / {o.d(o.R)} AS d13, radians({o.bearing('lat1', 'lon1', lat, lon)} - {o.bearing('lat1', 'lon1', 'lat2', 'lon2')}) AS turn FROM pairs))"""


ROUTE_BOX = """boxed AS (SELECT route, min(lat) - dl AS south, max(lat) + dl AS north, min(lon) - dl / c AS west, max(lon) + dl / c AS east, corridor_m FROM (
    SELECT v.*, corridor_m, corridor_m / CAST(111320 AS DOUBLE) AS dl, greatest(0.01, abs(cos(radians((min(lat) OVER w + max(lat) OVER w) / 2)))) AS c FROM vertices v JOIN routes r ON r.id = v.route WINDOW w AS (PARTITION BY v.route)) GROUP BY route, dl, c, corridor_m)"""
ROUTE_HITS = f"""pairs AS (SELECT p.*, b.corridor_m, c.osm_type, c.osm_id, c.lat, c.lon FROM boxed b JOIN cameras c ON c.stale_since IS NULL AND c.lat BETWEEN south AND north AND c.lon BETWEEN west AND east JOIN placed p ON p.route = b.route),
    hits AS ({sql_hit('lat', 'lon')}),
    on_route AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route, osm_type, osm_id ORDER BY distance_m, segment) AS rn FROM hits) WHERE rn = 1 AND distance_m <= corridor_m)"""
ON_ROUTE = (o.CAMERAS, o.ROUTES, o.VERTICES, SEGS, ROUTE_BOX, ROUTE_HITS)


def corridors(spark: SparkSession, d: str):
    return a.routes(spark, d).select(F.col("id").alias("route"), "corridor_m")


@query("route_membership", o.with_(*ON_ROUTE, select="SELECT route, osm_type, osm_id, round(distance_m, 2) AS distance_m, round(start_m + hit_m, 2) AS along_m, segment FROM on_route"))
def route_membership(spark: SparkSession, d: str):
    out = spatial.route_membership(a.cameras(spark, d), a.vertices(spark, d), corridors(spark, d))
    return out.select("route", "osm_type", "osm_id", F.round("distance_m", 2).alias("distance_m"), F.round("along_m", 2).alias("along_m"), "segment")


@query("polyline_length", o.with_(o.VERTICES, SEGS, select="SELECT route, round(sum(length_m), 3) AS length_m FROM segs GROUP BY route"))
def polyline_length(spark: SparkSession, d: str):
    return spatial.segments(a.vertices(spark, d)).groupBy("route").agg(r3(F.sum("length_m")).alias("length_m"))


@query("cumulative_distance", o.with_(o.VERTICES, SEGS, select="SELECT route, segment, round(start_m + length_m, 3) AS end_m FROM placed"))
def cumulative_distance(spark: SparkSession, d: str):
    return spatial.segments(a.vertices(spark, d)).select("route", "segment", r3(F.col("start_m") + F.col("length_m")).alias("end_m"))


@query("point_at_distance", o.with_(o.VERTICES, SEGS, select="SELECT route, segment, round(lat1 + (lat2 - lat1) * (20000 - start_m) / length_m, 7) AS lat, round(lon1 + (lon2 - lon1) * (20000 - start_m) / length_m, 7) AS lon FROM placed WHERE start_m <= 20000 AND 20000 < start_m + length_m"))
def point_at_distance(spark: SparkSession, d: str):
    """The point 20 km along each route."""
    s = spatial.segments(a.vertices(spark, d)).where("start_m <= 20000 AND 20000 < start_m + length_m").withColumn("t", (20000 - F.col("start_m")) / F.col("length_m"))
    return s.select("route", "segment", F.round(F.expr("lat1 + (lat2 - lat1) * t"), 7).alias("lat"), F.round(F.expr("lon1 + (lon2 - lon1) * t"), 7).alias("lon"))


@query("remaining_line", o.with_(o.VERTICES, SEGS, select="SELECT route, segment + 1 AS pos, round(lat2, 7) AS lat, round(lon2, 7) AS lon FROM placed WHERE start_m + length_m > 20000 UNION ALL SELECT route, segment, round(lat1 + (lat2 - lat1) * (20000 - start_m) / length_m, 7), round(lon1 + (lon2 - lon1) * (20000 - start_m) / length_m, 7) FROM placed WHERE start_m <= 20000 AND 20000 < start_m + length_m"))
def remaining_line(spark: SparkSession, d: str):
    """The line of each route from 20 km on, its first vertex at that point."""
    rest = spatial.segments(a.vertices(spark, d)).where("start_m + length_m > 20000").select("route", (F.col("segment") + 1).alias("pos"), F.round("lat2", 7).alias("lat"), F.round("lon2", 7).alias("lon"))
    return rest.unionByName(point_at_distance(spark, d).withColumnRenamed("segment", "pos"))


SEG_CELLS = f"""boxes AS (SELECT route, least(lat1, lat2) - dl AS s, greatest(lat1, lat2) + dl AS n, least(lon1, lon2) - dl / c AS w, greatest(lon1, lon2) + dl / c AS e FROM (SELECT s.*, corridor_m / CAST(111320 AS DOUBLE) AS dl, greatest(0.01, abs(cos(radians((lat1 + lat2) / 2)))) AS c FROM segs s JOIN routes ON id = route)),
    spans AS (SELECT route, {sql_row('s')} AS r0, greatest({sql_row('s')}, {sql_last('n', -1800, 1799)}) AS r1, {sql_col('w')} AS c0, greatest({sql_col('w')}, {sql_last('e', -3600, 3599)}) AS c1 FROM boxes),
    route_cells AS (SELECT DISTINCT route, CAST(r AS INTEGER) AS cell_row, CAST(c AS INTEGER) AS cell_col FROM (SELECT *, unnest(range(c0, c1 + 1)) AS c FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM spans)))"""


@query("polyline_cells", o.with_(o.ROUTES, o.VERTICES, SEGS, SEG_CELLS, select="SELECT * FROM route_cells"))
def polyline_cells(spark: SparkSession, d: str):
    return spatial.polyline_cells(a.vertices(spark, d), corridors(spark, d)).withColumnsRenamed({"row": "cell_row", "col": "cell_col"})


@query("target_cells", o.with_(o.AREAS, CIRCLE, CELLS, o.ROUTES, o.VERTICES, SEGS, SEG_CELLS.replace("spans AS", "rspans AS").replace("FROM spans", "FROM rspans"), select="SELECT cell_row, cell_col FROM cells UNION SELECT cell_row, cell_col FROM route_cells"))
def target_cells(spark: SparkSession, d: str):
    return _area_cells(spark, d).select("cell_row", "cell_col").union(polyline_cells(spark, d).select("cell_row", "cell_col")).distinct()


@query("merge_cameras", o.with_(o.CAMERAS, o.SUBMISSIONS, select=f"""SELECT osm_type || '/' || osm_id AS key, round(lat, 6) AS lat, round(lon, 6) AS lon, category, 'osm' AS source FROM cameras WHERE stale_since IS NULL
    UNION ALL SELECT 'submission/' || id, round(lat, 6), round(lon, 6), category, 'submission' FROM submissions s WHERE NOT EXISTS (SELECT 1 FROM cameras c WHERE c.stale_since IS NULL AND c.lat BETWEEN s.lat - 0.01 AND s.lat + 0.01 AND {o.hav('c.lat', 'c.lon', 's.lat', 's.lon')} <= 15)"""))
def merge_cameras(spark: SparkSession, d: str):
    return spatial.merge_cameras(a.cameras(spark, d), a.submissions(spark, d)).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("submission_duplicates", o.with_(o.CAMERAS, o.SUBMISSIONS, select=f"SELECT s.id, osm_type || '/' || osm_id AS key, round({o.hav('s.lat', 's.lon', 'c.lat', 'c.lon')}, 3) AS distance_m FROM submissions s JOIN cameras c ON c.lat BETWEEN s.lat - 0.01 AND s.lat + 0.01 AND {o.hav('s.lat', 's.lon', 'c.lat', 'c.lon')} <= 15"))
def submission_duplicates(spark: SparkSession, d: str):
    """Cameras, stale ones too, within 15 m of a submission."""
    right = a.cameras(spark, d).select(F.concat_ws("/", "osm_type", "osm_id").alias("key"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return spatial.pairs_within(a.submissions(spark, d).select("id", "lat", "lon"), right, 15.0).select("id", "key", r3("distance_m").alias("distance_m"))


@query("submissions_not_synced", o.with_(o.CAMERAS, o.SUBMISSIONS, select="SELECT id FROM submissions s WHERE NOT (status = 'uploaded' AND EXISTS (SELECT 1 FROM cameras c WHERE c.osm_type = 'node' AND c.osm_id = s.osm_element_id))"))
def submissions_not_synced(spark: SparkSession, d: str):
    """Without the uploaded submissions that the map data has by now."""
    mapped = a.cameras(spark, d).where("osm_type = 'node'").select(F.col("osm_id").alias("osm_element_id"), F.lit("uploaded").alias("status"))
    return a.submissions(spark, d).join(mapped, ["osm_element_id", "status"], "left_anti").select("id")


@query("near_endpoint", o.with_(o.CAMERAS, o.VERTICES, select=f"SELECT route, pos, osm_id FROM vertices v JOIN cameras c ON pos IN (0, 5) AND stale_since IS NULL AND c.lat BETWEEN v.lat - 0.01 AND v.lat + 0.01 AND {o.hav('v.lat', 'v.lon', 'c.lat', 'c.lon')} <= 70"))
def near_endpoint(spark: SparkSession, d: str):
    """Active cameras close to a route's start or end."""
    ends = a.vertices(spark, d).where("pos IN (0, 5)")
    right = spatial.active(a.cameras(spark, d)).select("osm_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return spatial.pairs_within(ends, right, 70.0).select("route", "pos", "osm_id")


@query("trip_corridor", f"""SELECT route, round(la0 - b, 6) AS south, round(la1 + b, 6) AS north, round({o.wrap('(lo0 - b / c)')}, 6) AS west, round({o.wrap('(lo1 + b / c)')}, 6) AS east FROM (SELECT *, greatest(CAST(3000 AS DOUBLE), trip * 0.3) / 111320 AS b, greatest(0.01, cos(radians((la0 + la1) / 2))) AS c FROM (
    SELECT route, min(lat) AS la0, max(lat) AS la1, min(lon) AS lo0, max(lon) AS lo1, {o.hav('any_value(lat) FILTER (pos = 0)', 'any_value(lon) FILTER (pos = 0)', 'any_value(lat) FILTER (pos = 5)', 'any_value(lon) FILTER (pos = 5)')} AS trip FROM (WITH {o.VERTICES} SELECT * FROM vertices WHERE pos IN (0, 5)) GROUP BY route))""")
def trip_corridor(spark: SparkSession, d: str):
    """The box about a trip's ends whose cameras may be excluded; west > east where it crosses the antimeridian."""
    ends = a.vertices(spark, d).groupBy("route").agg(*(F.max(F.when(F.col("pos") == p, F.col(x))).alias(f"{x}{i}") for i, p in ((0, 0), (1, 5)) for x in ("lat", "lon")))
    pad = F.greatest(F.lit(3000.0), geo.haversine_m("lat0", "lon0", "lat1", "lon1") * 0.3) / 111_320.0
    south, north, west, east = F.least("lat0", "lat1"), F.greatest("lat0", "lat1"), F.least("lon0", "lon1"), F.greatest("lon0", "lon1")
    wide = pad / F.greatest(F.lit(0.01), F.cos(F.radians((south + north) / 2)))
    return ends.select("route", F.round(south - pad, 6).alias("south"), F.round(north + pad, 6).alias("north"), F.round(geo.wrap_lon(west - wide), 6).alias("west"), F.round(geo.wrap_lon(east + wide), 6).alias("east"))
