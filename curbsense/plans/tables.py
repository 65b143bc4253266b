"""Registered queries: dimension maintenance, alerts, Wi-Fi, sync runs and map aggregation."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from curbsense.functions import geo, text
from curbsense.operators import alerts, clusters, dimension, mapagg
from curbsense.plans import oracle as o
from curbsense.plans.spatial import CIRCLE, MEMBERS
from curbsense.operators import spatial
from curbsense.sources import adapters as a

QUERIES, ORACLE_SQL = {}, {}
NOW = 1_710_000_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# Dimension maintenance: the stored table lacks every tenth camera, the answer every eleventh; every seventh has moved.
STORED = "stored AS (SELECT osm_type, osm_id, lat, lon, category, first_seen, last_seen, stale_since FROM cameras WHERE osm_id % 10 <> 0)"
ELEMENTS = "elements AS (SELECT osm_type, osm_id, CASE WHEN osm_id % 7 = 0 THEN lat + 0.01 ELSE lat END AS lat, lon, category, 0 AS pos FROM cameras WHERE osm_id % 11 <> 0 UNION ALL SELECT osm_type, osm_id, lat + 0.02, lon, 'alpr', 1 FROM cameras WHERE osm_id % 77 = 1)"
FRESH = """picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY osm_type, osm_id ORDER BY pos DESC) AS rn FROM elements) WHERE rn = 1),
    fresh AS (SELECT coalesce(e.osm_type, s.osm_type) AS osm_type, coalesce(e.osm_id, s.osm_id) AS osm_id, coalesce(e.lat, s.lat) AS lat, coalesce(e.lon, s.lon) AS lon, coalesce(e.category, s.category) AS category,
        coalesce(s.first_seen, {now}) AS first_seen, CASE WHEN e.osm_id IS NOT NULL THEN {now} ELSE s.last_seen END AS last_seen, CASE WHEN e.osm_id IS NULL THEN s.stale_since END AS stale_since
    FROM stored s FULL JOIN picked e ON s.osm_type = e.osm_type AND s.osm_id = e.osm_id)""".format(now=NOW)
SHOWN = "osm_type, osm_id, round(lat, 6) AS lat, round(lon, 6) AS lon, category, first_seen, last_seen"


def _stored(spark, d):
    return a.cameras(spark, d).where("osm_id % 10 <> 0").drop("operator", "direction")


def _elements(spark, d):
    cams = a.cameras(spark, d)
    first = cams.where("osm_id % 11 <> 0").select("osm_type", "osm_id", F.when(F.col("osm_id") % 7 == 0, F.col("lat") + 0.01).otherwise(F.col("lat")).alias("lat"), "lon", "category", F.lit(0).alias("pos"))
    return first.unionByName(cams.where("osm_id % 77 = 1").select("osm_type", "osm_id", (F.col("lat") + 0.02).alias("lat"), "lon", F.lit("alpr").alias("category"), F.lit(1).alias("pos")))


def _rounded(df):
    return df.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("upsert_elements", o.with_(o.CAMERAS, STORED, ELEMENTS, FRESH, select=f"SELECT {SHOWN}, stale_since FROM fresh"))
def upsert_elements(spark: SparkSession, d: str):
    return _rounded(dimension.upsert(_stored(spark, d), _elements(spark, d), NOW))


@query("ingest_global", o.with_(o.CAMERAS, STORED, ELEMENTS, FRESH, select=f"SELECT * FROM (SELECT {SHOWN}, CASE WHEN last_seen < {NOW - 100} AND stale_since IS NULL THEN {NOW} ELSE stale_since END AS stale_since FROM fresh) WHERE stale_since IS NULL OR stale_since >= {NOW - 2592000}"))
def ingest_global(spark: SparkSession, d: str):
    return _rounded(dimension.ingest_global(_stored(spark, d), _elements(spark, d), NOW - 100, NOW))


@query("ingest_cells", o.with_(o.CAMERAS, STORED, ELEMENTS, FRESH, select=f"SELECT {SHOWN}, CASE WHEN stale_since IS NULL AND lat BETWEEN 41 AND 41.5 AND lon BETWEEN -96.3 AND -95.8 AND NOT EXISTS (SELECT 1 FROM elements e WHERE e.osm_type = f.osm_type AND e.osm_id = f.osm_id) THEN {NOW} ELSE stale_since END AS stale_since FROM fresh f"))
def ingest_cells(spark: SparkSession, d: str):
    return _rounded(dimension.ingest_cells(_stored(spark, d), _elements(spark, d), (41.0, -96.3, 41.5, -95.8), NOW))


@query("purge_stale", o.with_(o.CAMERAS, select="SELECT osm_type, osm_id FROM cameras WHERE stale_since IS NULL OR stale_since >= 1700050000"))
def purge_stale(spark: SparkSession, d: str):
    return dimension.purge_stale(a.cameras(spark, d), 1_700_050_000 + 2_592_000).select("osm_type", "osm_id")


@query("stale_cameras", o.with_(o.CAMERAS, select="SELECT osm_type, osm_id FROM cameras WHERE stale_since IS NOT NULL AND category = 'flock'"))
def stale_cameras(spark: SparkSession, d: str):
    return a.cameras(spark, d).where((mapagg.marker_kind(F.col("category")) == "flock") & F.col("stale_since").isNotNull()).select("osm_type", "osm_id")


@query("stale_cells", f"SELECT c_custkey AS cell FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = c_custkey AND {NOW} - ({NOW} - o_orderkey * 977 % 20000) < 7200)")
def stale_cells(spark: SparkSession, d: str):
    fetched = a.table(spark, d, "orders").select(F.col("o_orderkey").alias("cell"), (NOW - F.col("o_orderkey") * 977 % 20000).alias("fetched_at"))
    return dimension.stale_cells(a.table(spark, d, "customer").select(F.col("c_custkey").alias("cell")), fetched, 7200, NOW)


@query("stamp_cells", f"SELECT coalesce(o_orderkey, c_custkey) AS cell, CASE WHEN c_custkey IS NOT NULL THEN {NOW} ELSE {NOW} - o_orderkey * 977 % 20000 END AS fetched_at FROM orders FULL JOIN customer ON o_orderkey = c_custkey")
def stamp_cells(spark: SparkSession, d: str):
    """Cells with the time of their last fetch, after a fetch of some old and some new ones."""
    stored = a.table(spark, d, "orders").select(F.col("o_orderkey").alias("cell"), (NOW - F.col("o_orderkey") * 977 % 20000).alias("fetched_at"))
    return dimension.stamp_cells(stored, a.table(spark, d, "customer").select(F.col("c_custkey").alias("cell")), NOW)


@query("ingest_cells_antimeridian", o.with_(o.CAMERAS, STORED, ELEMENTS, FRESH, select=f"SELECT osm_type, osm_id, CASE WHEN stale_since IS NULL AND lat BETWEEN 51 AND 52.5 AND (lon >= 179.5 OR lon <= -179.8) AND NOT EXISTS (SELECT 1 FROM elements e WHERE e.osm_type = f.osm_type AND e.osm_id = f.osm_id) THEN {NOW} ELSE stale_since END AS stale_since FROM fresh f"))
def ingest_cells_antimeridian(spark: SparkSession, d: str):
    return dimension.ingest_cells(_stored(spark, d), _elements(spark, d), (51.0, 179.5, 52.5, -179.8), NOW).select("osm_type", "osm_id", "stale_since")


TILES = f"tiles AS (SELECT o_orderkey AS tile, {NOW} - o_orderkey * 7919 % 5000000 AS fetched_at FROM orders)"


def _tiles(spark, d):
    return a.table(spark, d, "orders").select(F.col("o_orderkey").alias("tile"), (NOW - F.col("o_orderkey") * 7919 % 5000000).alias("fetched_at"))


@query("tile_evict", o.with_(TILES, select=f"SELECT * FROM tiles WHERE fetched_at >= {NOW - 2592000} ORDER BY fetched_at DESC, tile LIMIT 120"))
def tile_evict(spark: SparkSession, d: str):
    return dimension.tile_evict(_tiles(spark, d), NOW)


@query("cache_stats", o.with_(TILES, select=f"SELECT count(*) AS tiles, min(fetched_at) AS oldest, max(fetched_at) AS newest, count(*) FILTER (fetched_at < {NOW - 2592000}) AS stale FROM tiles"))
def cache_stats(spark: SparkSession, d: str):
    return _tiles(spark, d).agg(F.count(F.lit(1)).alias("tiles"), F.min("fetched_at").alias("oldest"), F.max("fetched_at").alias("newest"), F.count_if(F.col("fetched_at") < NOW - 2592000).alias("stale"))


# Alerts.
KNOWN = """told AS (SELECT *, row_number() OVER (PARTITION BY target_type, target_id, osm_type, osm_id ORDER BY occurred_at DESC, id DESC) AS rn FROM alert_events WHERE event IN ('baseline', 'added', 'removed')),
    known AS (SELECT target_type, target_id, osm_type, osm_id FROM told WHERE rn = 1 AND event <> 'removed')"""
CURRENT = "current AS (SELECT DISTINCT 'area' AS target_type, id % 30 AS target_id, osm_type, osm_id % 500 AS osm_id FROM alert_events WHERE osm_id % 3 = 0)"


def _current(spark, d):
    return a.alert_events(spark, d).where("osm_id % 3 = 0").select(F.lit("area").alias("target_type"), (F.col("id") % 30).alias("target_id"), "osm_type", (F.col("osm_id") % 500).alias("osm_id")).distinct()


@query("known_set", o.with_(o.ALERTS, KNOWN, select="SELECT * FROM known"))
def known_set(spark: SparkSession, d: str):
    return alerts.known_set(a.alert_events(spark, d))


@query("alert_diff", o.with_(o.ALERTS, KNOWN, CURRENT, select="""SELECT target_type, target_id, osm_type, osm_id, CASE WHEN (target_type, target_id) NOT IN (SELECT (target_type, target_id) FROM alert_events) THEN 'baseline' ELSE 'added' END AS event FROM (SELECT * FROM current EXCEPT SELECT * FROM known)
    UNION ALL SELECT *, 'removed' FROM (SELECT * FROM known EXCEPT SELECT * FROM current)"""))
def alert_diff(spark: SparkSession, d: str):
    return alerts.alert_diff(_current(spark, d), a.alert_events(spark, d))


@query("alert_history", o.with_(o.ALERTS, select="SELECT id, event, occurred_at FROM alert_events WHERE target_type = 'area' AND target_id = 7"))
def alert_history(spark: SparkSession, d: str):
    return alerts.history(a.alert_events(spark, d), "area", 7).select("id", "event", "occurred_at")


@query("unseen_added", o.with_(o.ALERTS, select="SELECT count(*) AS unseen FROM alert_events WHERE event = 'added' AND occurred_at > 1705000000"))
def unseen_added(spark: SparkSession, d: str):
    return alerts.unseen_added(a.alert_events(spark, d), 1_705_000_000)


@query("alert_notify", o.with_(o.ALERTS, CURRENT, select="SELECT id, notified OR (event = 'added' AND occurred_at = (SELECT max(occurred_at) FROM alert_events WHERE event = 'added') AND EXISTS (SELECT 1 FROM alert_events k WHERE k.id % 2 = 0 AND k.target_type = e.target_type AND k.target_id = e.target_id AND k.osm_id = e.osm_id)) AS notified FROM alert_events e"))
def alert_notify(spark: SparkSession, d: str):
    events = a.alert_events(spark, d)
    at = events.where("event = 'added'").agg(F.max("occurred_at")).first()[0]
    return alerts.notify(events, events.where("id % 2 = 0"), at).select("id", "notified")


@query("alert_state", o.with_(o.ALERTS, CURRENT, select="SELECT target_type, target_id, string_agg(DISTINCT osm_type || '/' || osm_id, ',' ORDER BY osm_type || '/' || osm_id) AS keys, count(DISTINCT osm_id) AS cameras, (target_type, target_id) IN (SELECT (target_type, target_id) FROM alert_events) AS baseline_recorded FROM current GROUP BY ALL"))
def alert_state(spark: SparkSession, d: str):
    return alerts.alert_state(_current(spark, d), a.alert_events(spark, d)).withColumn("keys", F.array_join("keys", ","))


# Wi-Fi.
MAC = "CASE WHEN length(regexp_replace(netid, '[^0-9A-Fa-f]', '', 'g')) = 12 THEN regexp_replace(upper(regexp_replace(netid, '[^0-9A-Fa-f]', '', 'g')), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') END"
AGE = "(({now} - CAST(epoch(CAST(substr(lasttime, 1, 10) AS DATE)) AS BIGINT)) // 86400)"
WNOW = 1_768_000_000
PARSED = f"""parsed AS (SELECT *, CASE WHEN mac IS NULL OR lat IS NULL OR lon IS NULL OR lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180 THEN 'invalid' WHEN age > 730 THEN 'old' ELSE 'parsed' END AS reason FROM (SELECT *, {MAC} AS mac, {AGE.format(now=WNOW)} AS age FROM sightings))"""
BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mac ORDER BY lasttime DESC NULLS LAST, pos) AS rn FROM parsed WHERE reason = 'parsed') WHERE rn = 1)"


def parsed(rows):
    """Scanner rows (netid, trilat, trilong, lasttime, ...) with mac, lat, lon and the reason why one is left out, or "parsed"."""
    s = rows.withColumns({"mac": text.mac_normalize(F.col("netid")), "lat": F.col("trilat").try_cast("double"), "lon": F.col("trilong").try_cast("double")})
    bad = F.col("mac").isNull() | ~F.coalesce(geo.valid_coord("lat", "lon"), F.lit(False)) | ((F.col("lat") == 0) & (F.col("lon") == 0))
    return s.withColumn("reason", F.when(bad, "invalid").when(F.coalesce(text.wifi_age(F.col("lasttime"), WNOW) > 730, F.lit(False)), "old").otherwise("parsed"))


def _parsed(spark, d):
    return parsed(a.sightings(spark, d))


def best_of(rows):
    rows = parsed(rows).where("reason = 'parsed'").select(F.col("mac").alias("netid"), "lat", "lon", "ssid", F.col("lasttime").alias("last_seen"), "source", "pos")
    return dimension.wifi_dedupe(rows)


def _best(spark, d):
    return best_of(a.sightings(spark, d))


@query("mac_normalize", o.with_(o.SIGHTINGS, select=f"SELECT pos, {MAC} AS mac FROM sightings"))
def mac_normalize(spark: SparkSession, d: str):
    return a.sightings(spark, d).select("pos", text.mac_normalize(F.col("netid")).alias("mac"))


@query("ssid_match", o.with_(o.SIGHTINGS, select="SELECT pos, regexp_matches(trim(ssid), '(?i)^(flock|flock-[0-9a-f]{4,6}|flock\\d{3}|flock camera net\\.?)$') AS matches FROM sightings"))
def ssid_match(spark: SparkSession, d: str):
    return a.sightings(spark, d).select("pos", text.ssid_match(F.col("ssid")).alias("matches"))


@query("oui_match", o.with_(o.SIGHTINGS, select=f"SELECT pos, substr({MAC}, 1, 8) AS oui FROM sightings WHERE substr({MAC}, 1, 8) IN ('70:C9:4E', '3C:91:80', 'D8:F3:BC')"))
def oui_match(spark: SparkSession, d: str):
    """Sightings whose maker prefix is listed."""
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, ("70:C9:4E", "3C:91:80", "D8:F3:BC")))).alias("oui"))
    return a.sightings(spark, d).select("pos", F.substring(text.mac_normalize(F.col("netid")), 1, 8).alias("oui")).join(F.broadcast(listed), "oui", "left_semi")


@query("wifi_age", o.with_(o.SIGHTINGS, select=f"SELECT pos, {AGE.format(now=WNOW)} AS days FROM sightings"))
def wifi_age(spark: SparkSession, d: str):
    return a.sightings(spark, d).select("pos", text.wifi_age(F.col("lasttime"), WNOW).alias("days"))


@query("wifi_parse_stats", o.with_(o.SIGHTINGS, PARSED, select="SELECT reason, count(*) AS n, count(*) FILTER (reason = 'parsed') - count(DISTINCT mac) FILTER (reason = 'parsed') AS deduplicated FROM parsed GROUP BY reason"))
def wifi_parse_stats(spark: SparkSession, d: str):
    ok = F.col("reason") == "parsed"
    return _parsed(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), (F.count_if(ok) - F.countDistinct(F.when(ok, F.col("mac")))).alias("deduplicated"))


@query("wifi_dedupe", o.with_(o.SIGHTINGS, PARSED, BEST, select="SELECT mac AS netid, pos, lasttime AS last_seen FROM best"))
def wifi_dedupe(spark: SparkSession, d: str):
    return _best(spark, d).select("netid", "pos", "last_seen")


@query("wifi_counts", o.with_(o.SIGHTINGS, PARSED, BEST, select="SELECT count(*) AS total, count(*) FILTER (source = 'upstream') AS upstream, count(*) FILTER (source <> 'upstream') AS imported FROM best"))
def wifi_counts(spark: SparkSession, d: str):
    up = F.col("source") == "upstream"
    return _best(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(up).alias("upstream"), F.count_if(~up).alias("imported"))


@query("wifi_bbox", o.with_(o.SIGHTINGS, PARSED, BEST, select="SELECT mac AS netid FROM best WHERE lat BETWEEN 40 AND 43 AND lon BETWEEN -97 AND -95"))
def wifi_bbox(spark: SparkSession, d: str):
    return _best(spark, d).where(geo.in_box("lat", "lon", geo.sanitized_box(40.0, -97.0, 43.0, -95.0))).select("netid")


UPSERT = """old_rows AS (SELECT * FROM best WHERE pos % 3 <> 0), new_rows AS (SELECT * FROM best WHERE pos % 2 = 0),
    newest AS (SELECT * FROM (SELECT mac, last_seen, source, row_number() OVER (PARTITION BY mac ORDER BY coalesce(last_seen, '') DESC, turn DESC) AS rn FROM (SELECT mac, lasttime AS last_seen, source, 0 AS turn FROM old_rows{} UNION ALL SELECT mac, CASE WHEN pos % 4 = 0 THEN '2024-01-10 00:00:00' ELSE lasttime END, 'fresh', 1 FROM new_rows)) WHERE rn = 1)"""


def _incoming(best):
    return best.where("pos % 2 = 0").withColumns({"last_seen": F.when(F.col("pos") % 4 == 0, "2024-01-10 00:00:00").otherwise(F.col("last_seen")), "source": F.lit("fresh")})


@query("wifi_upsert", o.with_(o.SIGHTINGS, PARSED, BEST, UPSERT.format(""), select="SELECT mac AS netid, last_seen, source FROM newest"))
def wifi_upsert(spark: SparkSession, d: str):
    best = _best(spark, d)
    return dimension.wifi_upsert(best.where("pos % 3 <> 0"), _incoming(best)).select("netid", "last_seen", "source")


PRUNED = "last_seen IS NULL OR substr(last_seen, 1, 10) >= '2024-01-15'"
PNOW = 1_705_276_800 + 730 * 86_400


@query("wifi_prune", o.with_(o.SIGHTINGS, PARSED, BEST, select=f"SELECT mac AS netid FROM (SELECT *, lasttime AS last_seen FROM best) WHERE {PRUNED}"))
def wifi_prune(spark: SparkSession, d: str):
    return dimension.wifi_prune(_best(spark, d), PNOW).select("netid")


@query("wifi_replace", o.with_(o.SIGHTINGS, PARSED, BEST, UPSERT.format(" WHERE source <> 'upstream'"), select=f"SELECT mac AS netid, last_seen, source FROM newest WHERE {PRUNED}"))
def wifi_replace(spark: SparkSession, d: str):
    best = _best(spark, d)
    return dimension.wifi_replace(best.where("pos % 3 <> 0"), _incoming(best), "upstream", PNOW).select("netid", "last_seen", "source")


# Sync runs.
@query("sync_summary", o.with_(o.SYNC_RUNS, select="""SELECT (SELECT max(finished_at) FROM sync_runs WHERE outcome = 'ok') AS last_ok_at, t.at AS last_attempt_at, t.outcome AS last_outcome, CASE WHEN t.outcome <> 'ok' THEN t.detail END AS last_error, e.elements AS last_elements, e.bytes AS last_bytes, e.took AS last_duration_secs
    FROM (SELECT coalesce(finished_at, started_at) AS at, outcome, detail FROM sync_runs WHERE outcome <> 'running' ORDER BY 1 DESC, id DESC LIMIT 1) t, (SELECT elements, bytes, finished_at - started_at AS took FROM sync_runs WHERE outcome = 'ok' AND elements IS NOT NULL ORDER BY finished_at DESC, id DESC LIMIT 1) e"""))
def sync_summary(spark: SparkSession, d: str):
    return dimension.sync_summary(a.sync_runs(spark, d))


@query("sync_interrupted", o.with_(o.SYNC_RUNS, select="SELECT id, CASE WHEN outcome = 'running' THEN 'error' ELSE outcome END AS outcome, CASE WHEN outcome = 'running' THEN 'interrupted' ELSE detail END AS detail FROM sync_runs"))
def sync_interrupted(spark: SparkSession, d: str):
    return dimension.sync_interrupted(a.sync_runs(spark, d)).select("id", "outcome", "detail")


# Map aggregation.
POINTS = """points AS (SELECT osm_type || '/' || osm_id AS key, lat, lon, CASE category WHEN 'unknown' THEN 'alpr' ELSE category END AS kind, 0 AS usr, stale_since IS NOT NULL AS stale, operator FROM cameras
    UNION ALL SELECT 'submission/' || id, lat, lon, 'user', 1, false, operator FROM submissions)"""


def _points(spark, d):
    return mapagg.engine_points(a.cameras(spark, d), a.submissions(spark, d))


@query("marker_kind", o.with_(o.CAMERAS, select="SELECT CASE category WHEN 'unknown' THEN 'alpr' ELSE category END AS kind, count(*) AS n FROM cameras GROUP BY 1"))
def marker_kind(spark: SparkSession, d: str):
    return a.cameras(spark, d).groupBy(mapagg.marker_kind(F.col("category")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("engine_filter", o.with_(o.CAMERAS, o.SUBMISSIONS, POINTS, select="SELECT key FROM points WHERE NOT stale AND kind IN ('flock', 'user') AND lower(operator) LIKE '%urg%'"))
def engine_filter(spark: SparkSession, d: str):
    return _points(spark, d).where(mapagg.included(("flock", "user"), " Urg ")).select("key")


@query("visibility_filter", o.with_(o.CAMERAS, select="SELECT osm_type, osm_id FROM cameras WHERE category IN ('flock', 'unknown') AND lower(coalesce(operator, '')) LIKE '%medium%'"))
def visibility_filter(spark: SparkSession, d: str):
    """The list's filter: enabled categories, and an operator that contains the text."""
    return a.cameras(spark, d).where(F.col("category").isin("flock", "unknown") & F.lower(F.coalesce("operator", F.lit(""))).contains("medium")).select("osm_type", "osm_id")


def sql_hex() -> str:
    x, y = "(lon / 360 + 0.5)", "greatest(0, least(1, 0.5 - 0.25 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / pi()))"
    levels = ", ".join(f"({n}, {geo.hex_columns(n)})" for n in range(6))
    return f"""cubes AS (SELECT *, floor(qf + 0.5) AS q0, floor(rf + 0.5) AS r0, floor(-qf - rf + 0.5) AS s0 FROM (SELECT level, cols, usr, (CAST(2 AS DOUBLE) / 3) * {x} * (1.5 * cols) AS qf, (-(CAST(1 AS DOUBLE) / 3) * {x} + (sqrt(CAST(3 AS DOUBLE)) / 3) * {y}) * (1.5 * cols) AS rf FROM points, (VALUES {levels}) l(level, cols) WHERE NOT stale)),
    axial AS (SELECT level, cols, usr, CASE WHEN abs(q0 - qf) > abs(r0 - rf) AND abs(q0 - qf) > abs(s0 + qf + rf) THEN -r0 - s0 ELSE q0 END AS q1, CASE WHEN abs(q0 - qf) > abs(r0 - rf) AND abs(q0 - qf) > abs(s0 + qf + rf) THEN r0 WHEN abs(r0 - rf) > abs(s0 + qf + rf) THEN -q0 - s0 ELSE r0 END AS r1 FROM cubes),
    bins AS (SELECT level, CAST({o.pmod('q1', 'cols')} AS INTEGER) AS q, CAST(r1 + (q1 - {o.pmod('q1', 'cols')}) / 2 AS INTEGER) AS r, count(*) AS count, sum(usr) AS users FROM axial GROUP BY ALL)"""


@query("hex_density", o.with_(o.CAMERAS, o.SUBMISSIONS, POINTS, sql_hex(), select="SELECT *, max(count) OVER (PARTITION BY level) AS max_count FROM bins"))
def hex_density(spark: SparkSession, d: str):
    return mapagg.hex_density(_points(spark, d).where(mapagg.included(("flock", "alpr", "user"))))


@query("hex_cell", o.with_(o.CAMERAS, o.SUBMISSIONS, POINTS, sql_hex(), select="SELECT q, r, count AS n FROM bins WHERE level = 3"))
def hex_cell(spark: SparkSession, d: str):
    at = geo.hex_cell(3, geo.merc_x("lon"), geo.merc_y("lat"))
    return _points(spark, d).where("NOT stale").groupBy(at["q"].alias("q"), at["r"].alias("r")).agg(F.count(F.lit(1)).alias("n"))


VIEW = "FILTER (kind IN ('flock', 'user') AND lower(operator) LIKE '%low%'"


@query("viewport_counts", o.with_(o.CAMERAS, o.SUBMISSIONS, POINTS, select=f"SELECT count(*) {VIEW}) AS visible, count(*) {VIEW} AND usr = 1) AS users, count(*) {VIEW} AND kind = 'flock') AS flock, count(*) {VIEW} AND kind = 'alpr') AS alpr, count(*) {VIEW} AND kind = 'user') AS user, count(*) FILTER (kind = 'flock') AS all_flock, count(*) FILTER (kind = 'alpr') AS all_alpr, count(*) FILTER (kind = 'user') AS all_user FROM points WHERE NOT stale AND lat BETWEEN -20 AND 55 AND (lon >= 100 OR lon <= -90)"))
def viewport_counts(spark: SparkSession, d: str):
    return mapagg.viewport_counts(_points(spark, d), (-20.0, 100.0, 55.0, -90.0), ("flock", "user"), "low")


@query("viewport_filter", o.with_(o.CAMERAS, o.SUBMISSIONS, POINTS, select="SELECT key FROM points WHERE lat BETWEEN 45 AND 60 AND (lon >= 170 OR lon <= -170)"))
def viewport_filter(spark: SparkSession, d: str):
    return _points(spark, d).where(geo.in_box("lat", "lon", geo.sanitized_box(45.0, 170.0, 60.0, 190.0))).select("key")


@query("lod_band", "SELECT k, level, CASE WHEN level <= 5 THEN 'wide' WHEN level <= 10 THEN 'mid' WHEN level <= 13 THEN 'near' ELSE 'detail' END AS band FROM (SELECT p_partkey AS k, CAST(greatest(0, least(20, floor(p_partkey % 230 / CAST(10 AS DOUBLE) - 1 + 1e-9))) AS INTEGER) AS level FROM part)")
def lod_band(spark: SparkSession, d: str):
    level = mapagg.lod_level(F.col("p_partkey") % 230 / 10 - 1)
    return a.table(spark, d, "part").select(F.col("p_partkey").alias("k"), level.alias("level"), mapagg.lod_band(level).alias("band"))


@query("node_encoding", "SELECT k, round(greatest(5.5, 34 / sqrt(greatest(1, m)) * sqrt(k)), 6) AS radius, round(CASE WHEN m <= 1 OR k <= 1 THEN CASE WHEN k >= m THEN 1 ELSE 0 END ELSE greatest(0, least(1, ln(k) / ln(m))) END, 6) AS density FROM (SELECT p_partkey AS k, p_partkey * 3 % 500 AS m FROM part)")
def node_encoding(spark: SparkSession, d: str):
    k = F.col("p_partkey")
    return a.table(spark, d, "part").select(k.alias("k"), F.round(mapagg.node_radius(k, k * 3 % 500), 6).alias("radius"), F.round(mapagg.density(k, k * 3 % 500), 6).alias("density"))


@query("format_count", """SELECT k, n, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 10000 THEN regexp_replace(CASE WHEN n % 500 = 250 THEN printf('%.1f', (n + 50) / 1000) ELSE printf('%.1f', n / 1000) END, '\\.0$', '') || 'k' WHEN n < 999500 THEN CAST(CAST(floor(n / 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'k' ELSE regexp_replace(CASE WHEN n % 500000 = 250000 THEN printf('%.1f', (n + 50000) / 1000000) ELSE printf('%.1f', n / 1000000) END, '\\.0$', '') || 'M' END AS label FROM (SELECT o_orderkey AS k, o_orderkey * o_orderkey * 7 % 30000007 AS n FROM orders)""")
def format_count(spark: SparkSession, d: str):
    k = F.col("o_orderkey")
    n = k * k * 7 % 30000007
    rows = a.table(spark, d, "orders").select(k.alias("k"), n.alias("n"))
    return rows.withColumn("label", mapagg.format_count(F.col("n")))


def _level_sql(level: int) -> str:
    """Nodes of a level from those of the one below: rounds in which a node decides once all smaller ids within reach have."""
    up, r = level + 1, clusters.radius(level)
    return f"""c{level} AS MATERIALIZED (SELECT a.id AS i, b.id AS j FROM (SELECT *, unnest([-1, 0, 1]) AS dx FROM n{up}) a, unnest([-1, 0, 1]) t(dy), n{up} b
        WHERE b.x // {r} = a.x // {r} + dx AND b.y // {r} = a.y // {r} + dy AND b.id < a.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {r * r}),
    s{level} AS (SELECT 0 AS round, id, 0 AS status FROM n{up}
        UNION ALL SELECT s.round + 1, s.id, CASE WHEN max(s.status) > 0 THEN max(s.status) WHEN count(*) FILTER (o.status = 1) > 0 THEN 2 WHEN count(*) FILTER (o.status = 0) = 0 THEN 1 ELSE 0 END
        FROM s{level} s LEFT JOIN c{level} c ON c.i = s.id LEFT JOIN s{level} o ON o.id = c.j WHERE EXISTS (SELECT 1 FROM s{level} WHERE status = 0) GROUP BY s.round, s.id),
    d{level} AS MATERIALIZED (SELECT id, max(status) AS status FROM s{level} GROUP BY id),
    m{level} AS MATERIALIZED (SELECT n.*, coalesce(p.parent, n.id) AS parent FROM n{up} n LEFT JOIN (SELECT c.i, min(c.j) AS parent FROM c{level} c JOIN d{level} d ON d.id = c.j AND d.status = 1 GROUP BY c.i) p ON p.i = n.id),
    n{level} AS MATERIALIZED (SELECT parent AS id, CAST(sum(x * count) // sum(count) AS BIGINT) AS x, CAST(sum(y * count) // sum(count) AS BIGINT) AS y, CAST(sum(count) AS BIGINT) AS count, CAST(sum(users) AS BIGINT) AS users, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north FROM m{level} GROUP BY parent)"""


def cluster_sql(select: str) -> str:
    """SQL over all levels of the clusters: idx (level, id, x, y, count, users, west, south, east, north, parent)."""
    x, y = "(lon / 360 + 0.5)", "greatest(0, least(1, 0.5 - 0.25 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / pi()))"
    whole = "CAST(floor({} * 4294967296) AS BIGINT)"
    cols = "id, x / CAST(4294967296 AS DOUBLE) AS x, y / CAST(4294967296 AS DOUBLE) AS y, count, users, west, south, east, north"
    leaves = [
        f"leaves AS MATERIALIZED (SELECT key AS id, {whole.format(x)} AS x, {whole.format(y)} AS y, CAST(1 AS BIGINT) AS count, CAST(usr AS BIGINT) AS users, lon AS west, lat AS south, lon AS east, lat AS north FROM points WHERE NOT stale)",
        "n14 AS MATERIALIZED (SELECT min(id) AS id, x, y, CAST(sum(count) AS BIGINT) AS count, CAST(sum(users) AS BIGINT) AS users, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north FROM leaves GROUP BY x, y)",
    ]
    rows = [f"SELECT 14 AS level, {cols}, parent FROM (SELECT l.*, m.parent FROM leaves l JOIN m13 m ON m.x = l.x AND m.y = l.y)"]
    rows += [f"SELECT {level} AS level, {cols}, parent FROM m{level - 1}" for level in range(13, 6, -1)] + [f"SELECT 6 AS level, {cols}, NULL AS parent FROM n6"]
    return "WITH RECURSIVE " + ", ".join([o.CAMERAS, o.SUBMISSIONS, POINTS, *leaves, *map(_level_sql, range(13, 5, -1)), f"idx AS MATERIALIZED ({' UNION ALL '.join(rows)})"]) + " " + select


def _up_sql(start: int, stop: int) -> str:
    """Rows (id, ancestor) of a level's nodes with theirs at a lower level."""
    joins = " ".join(f"JOIN idx i{n - 1} ON i{n - 1}.level = {n - 1} AND i{n - 1}.id = i{n}.parent" for n in range(start, stop, -1))
    return f"SELECT i{start}.id, i{stop}.id AS ancestor FROM idx i{start} {joins} WHERE i{start}.level = {start}"


def cluster_index(spark: SparkSession, d: str):
    return clusters.cluster_index(_points(spark, d).where(mapagg.included(("flock", "alpr", "user"))))


@query("cluster_levels", cluster_sql("SELECT level, id, x, y, count, users, parent FROM idx"))
def cluster_levels(spark: SparkSession, d: str):
    """Every node of every level with the node that takes it at the next."""
    return cluster_index(spark, d).drop(*clusters.BOX)


@query("cluster_max_count", cluster_sql("SELECT level, max(count) AS largest FROM idx GROUP BY level"))
def cluster_max_count(spark: SparkSession, d: str):
    return clusters.largest_nodes(cluster_index(spark, d))


@query("cluster_totals", o.with_(o.CAMERAS, o.SUBMISSIONS, POINTS, select="SELECT CAST(l AS INTEGER) AS level, count(*) AS points, sum(usr) AS users FROM points, range(6, 15) t(l) WHERE NOT stale GROUP BY 1"))
def cluster_totals(spark: SparkSession, d: str):
    """Counts are conserved at every level of the clusters."""
    return cluster_index(spark, d).groupBy("level").agg(F.sum("count").alias("points"), F.sum("users").alias("users"))


VIEW_SQL = "y BETWEEN 0.5 - 0.25 * ln((1 + sin(radians({n}))) / (1 - sin(radians({n})))) / pi() AND 0.5 - 0.25 * ln((1 + sin(radians({s}))) / (1 - sin(radians({s})))) / pi() AND x BETWEEN {w} / CAST(360 AS DOUBLE) + 0.5 AND {e} / CAST(360 AS DOUBLE) + 0.5"
#: Boxes (south, west, north, east) of a country, and of a part of it.
OUTER, INNER = (25, -130, 50, -90), (40, -100, 42, -94)
OUTER_SQL, INNER_SQL = (VIEW_SQL.format(s=s, w=w, n=n, e=e) for s, w, n, e in (OUTER, INNER))
SHOWN_SQL = "id, x, y, count, users, count = 1 AS is_leaf"


@query("cluster_query", cluster_sql(f"SELECT {SHOWN_SQL}, ancestor, 'in' AS direction FROM idx JOIN ({_up_sql(9, 7)}) u USING (id) WHERE level = 9 AND {INNER_SQL}"))
def cluster_query(spark: SparkSession, d: str):
    """Nodes of level 9 in a view that was zoomed into from level 7, with the nodes that they come out of."""
    return clusters.cluster_view(cluster_index(spark, d), INNER, 9, (OUTER, 7))


@query("cluster_query_out", cluster_sql(f"SELECT {SHOWN_SQL}, NULL AS ancestor, NULL AS direction FROM idx WHERE level = 6 AND {OUTER_SQL} UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, ancestor, 'out' FROM (SELECT id FROM idx WHERE level = 14 AND {INNER_SQL}) JOIN ({_up_sql(14, 6)}) u USING (id)"))
def cluster_query_out(spark: SparkSession, d: str):
    """Nodes of level 6 in a view that was zoomed out to from single points, and where each of these goes."""
    return clusters.cluster_view(cluster_index(spark, d), OUTER, 6, (INNER, 17))


@query("cluster_ancestor", cluster_sql(" UNION ALL ".join(f"SELECT {a} AS start, {b} AS stop, id, ancestor FROM ({_up_sql(a, b)})" for a, b in ((14, 13), (12, 9), (10, 6)))))
def cluster_ancestor(spark: SparkSession, d: str):
    """The nodes above those of several levels."""
    index = cluster_index(spark, d)
    rows = [clusters.ancestors(index, start, stop).select(F.lit(min(start, 14)).alias("start"), F.lit(stop).alias("stop"), "id", "ancestor") for start, stop in ((17, 13), (12, 9), (10, 6))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("cluster_bounds", cluster_sql("""SELECT a.level, a.id, a.west, a.south, a.east, a.north, (SELECT CAST(min(b.level) AS INTEGER) FROM (SELECT level, id, lag(count) OVER (PARTITION BY id ORDER BY level) AS below, count FROM idx UNION ALL SELECT 14, id, 2, 1 FROM (SELECT DISTINCT parent AS id FROM idx WHERE level = 14)) b WHERE b.id = a.id AND b.level > a.level AND b.count < a.count) AS split_level
    FROM idx a WHERE a.count > 1"""))
def cluster_bounds(spark: SparkSession, d: str):
    """The box of every cluster's points, and the level at which it splits."""
    return clusters.expansions(cluster_index(spark, d))


@query("classify", """SELECT k, CASE WHEN coalesce(lower(brand) LIKE '%flock%', false) OR coalesce(lower(maker) LIKE '%flock%', false) THEN 'flock' WHEN upper(kind) = 'ALPR' THEN 'alpr' ELSE 'unknown' END AS category
    FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'Flock Safety' END AS brand, CASE WHEN p_partkey % 5 = 0 THEN 'flock' ELSE p_brand END AS maker, CASE WHEN p_partkey % 3 = 0 THEN 'alpr' ELSE 'camera' END AS kind FROM part)""")
def classify(spark: SparkSession, d: str):
    k = F.col("p_partkey")
    tags = F.map_filter(F.create_map(F.lit("brand"), F.when(k % 4 == 0, "Flock Safety"), F.lit("manufacturer"), F.when(k % 5 == 0, "flock").otherwise(F.col("p_brand")), F.lit("surveillance:type"), F.when(k % 3 == 0, "alpr").otherwise("camera")), lambda _, v: v.isNotNull())
    return a.table(spark, d, "part").select(k.alias("k"), text.classify(tags).alias("category"))


@query("format_ago", "SELECT k, CASE WHEN k = 0 THEN 'never' WHEN age < 60 THEN 'just now' WHEN age < 3600 THEN age // 60 || ' min ago' WHEN age < 86400 THEN age // 3600 || ' h ago' ELSE age // 86400 || ' d ago' END AS ago FROM (SELECT p_partkey AS k, p_partkey * p_partkey * 13 AS age FROM part)")
def format_ago(spark: SparkSession, d: str):
    k = F.col("p_partkey")
    return a.table(spark, d, "part").select(k.alias("k"), text.format_ago(F.when(k != 0, NOW - k * k * 13), NOW).alias("ago"))


@query("compass_label", "SELECT k, CASE CAST(floor(k % 360 / CAST(45 AS DOUBLE) + 0.5) AS BIGINT) % 8 WHEN 0 THEN 'N' WHEN 1 THEN 'NE' WHEN 2 THEN 'E' WHEN 3 THEN 'SE' WHEN 4 THEN 'S' WHEN 5 THEN 'SW' WHEN 6 THEN 'W' ELSE 'NW' END || ' (' || k || '°)' AS label FROM (SELECT p_partkey * 7 AS k FROM part)")
def compass_label(spark: SparkSession, d: str):
    k = F.col("p_partkey") * 7
    return a.table(spark, d, "part").select(k.alias("k"), text.compass_label(k).alias("label"))


def _memberships(spark, d):
    return spatial.area_membership(a.cameras(spark, d), a.areas(spark, d))


@query("area_alerts", o.with_(o.CAMERAS, o.AREAS, CIRCLE, MEMBERS, o.ALERTS, KNOWN, select="""SELECT target_id, osm_type, osm_id, event FROM (SELECT m.area AS target_id, m.osm_type, m.osm_id, CASE WHEN m.area NOT IN (SELECT target_id FROM alert_events WHERE target_type = 'area') THEN 'baseline' ELSE 'added' END AS event FROM members m
    WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.target_type = 'area' AND k.target_id = m.area AND k.osm_type = m.osm_type AND k.osm_id = m.osm_id))"""))
def area_alerts(spark: SparkSession, d: str):
    """Cameras that an alert refresh would report for the watched areas: membership against the event log."""
    current = _memberships(spark, d).select(F.lit("area").alias("target_type"), F.col("area").alias("target_id"), "osm_type", "osm_id")
    return alerts.alert_news(current, a.alert_events(spark, d)).select("target_id", "osm_type", "osm_id", "event")
