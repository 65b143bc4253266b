"""DuckDB's SQL for the derived tables and the geometry, from which the queries' oracles are put together."""

from __future__ import annotations

from curbsense.sources.adapters import METROS

R = "6371008.8"


def metro(key: str, axis: int) -> str:
    at = [f"CAST({m[axis]} AS DOUBLE)" for m in METROS]
    return f"(CASE ({key}) % 4 WHEN 0 THEN {at[0]} WHEN 1 THEN {at[1]} WHEN 2 THEN {at[2]} ELSE {at[3]} END)"


def wrapped(lon: str) -> str:
    return f"(CASE WHEN {lon} >= 180.0 THEN {lon} - 360.0 ELSE {lon} END)"


def d(x: float | str) -> str:
    return f"CAST({x} AS DOUBLE)"


def hav(a: str, b: str, x: str, y: str) -> str:
    return f"(2 * CAST({R} AS DOUBLE) * asin(least(1.0, sqrt(pow(sin(radians({x} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({x})) * pow(sin(radians({y} - {b}) / 2), 2)))))"


def pmod(x: str, n: str) -> str:
    return f"((({x}) % {n} + {n}) % {n})"


def bearing(a: str, b: str, x: str, y: str) -> str:
    turn = f"degrees(atan2(sin(radians({y} - {b})) * cos(radians({x})), cos(radians({a})) * sin(radians({x})) - sin(radians({a})) * cos(radians({x})) * cos(radians({y} - {b}))))"
    return pmod(f"{turn} + 360", "CAST(360 AS DOUBLE)")


def wrap(lon: str) -> str:
    return f"({pmod(f'{lon} + 180', 'CAST(360 AS DOUBLE)')} - 180)"


def fraction(p: str, q: str, a: str, b: str, x: str, y: str) -> str:
    """The share of the segment (a, b)-(x, y) before its point nearest to (p, q)."""
    k = f"(111320.0 * greatest(cos(radians({p})), 0.01))"
    ax, ay, dx, dy = f"({wrap(f'({b} - {q})')} * {k})", f"(({a} - {p}) * CAST(111320 AS DOUBLE))", f"({wrap(f'({y} - {b})')} * {k})", f"(({x} - {a}) * CAST(111320 AS DOUBLE))"
    n = f"({dx} * {dx} + {dy} * {dy})"
    return f"(CASE WHEN {n} > 0 THEN greatest(0.0, least(1.0, -({ax} * {dx} + {ay} * {dy}) / {n})) ELSE 0.0 END)"


def seg(p: str, q: str, a: str, b: str, x: str, y: str) -> str:
    """Planar distance from (p, q) to the segment (a, b)-(x, y)."""
    k = f"(111320.0 * greatest(cos(radians({p})), 0.01))"
    ax, ay, dx, dy = f"({wrap(f'({b} - {q})')} * {k})", f"(({a} - {p}) * CAST(111320 AS DOUBLE))", f"({wrap(f'({y} - {b})')} * {k})", f"(({x} - {a}) * CAST(111320 AS DOUBLE))"
    n = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(CASE WHEN {n} > 0 THEN greatest(0.0, least(1.0, -({ax} * {dx} + {ay} * {dy}) / {n})) ELSE 0.0 END)"
    return f"sqrt(pow({ax} + {t} * {dx}, 2) + pow({ay} + {t} * {dy}, 2))"


CAMERAS = f"""cameras AS (
    SELECT CASE WHEN k % 97 = 0 THEN 'way' ELSE 'node' END AS osm_type, k AS osm_id,
        CASE WHEN k % 5 = 0 THEN CAST(-60 AS DOUBLE) + (k * 7919 % 120000) / CAST(1000 AS DOUBLE) ELSE {metro('k', 0)} + (k * 7919 % 7000) / CAST(10000 AS DOUBLE) - CAST(0.35 AS DOUBLE) END AS lat,
        CASE WHEN k % 5 = 0 THEN CAST(-180 AS DOUBLE) + (k * 104729 % 360000) / CAST(1000 AS DOUBLE) ELSE {wrapped(f"({metro('k', 1)} + (k * 104729 % 7000) / CAST(10000 AS DOUBLE) - CAST(0.35 AS DOUBLE))")} END AS lon,
        CASE k % 3 WHEN 0 THEN 'flock' WHEN 1 THEN 'alpr' ELSE 'unknown' END AS category,
        CASE WHEN k % 7 <> 0 THEN substr(o_orderpriority, 3) END AS operator,
        CASE WHEN k % 3 <> 2 THEN CAST(k * 37 % 360 AS VARCHAR) END AS direction,
        1690000000 + k AS first_seen, 1700000000 + k % 1000 AS last_seen,
        CASE WHEN k % 50 = 0 THEN 1700000000 + k * 100 END AS stale_since
    FROM (SELECT o_orderkey AS k, o_orderpriority FROM orders))"""

SUBMISSIONS = f"""submissions AS (
    SELECT k AS id,
        CASE WHEN k % 4 = 0 THEN {metro('o', 0)} + (o * 7919 % 7000) / CAST(10000 AS DOUBLE) - CAST(0.35 AS DOUBLE) + (k % 30) / CAST(100000 AS DOUBLE) ELSE {metro('k', 0)} + (k * 6007 % 9000) / CAST(10000 AS DOUBLE) - CAST(0.45 AS DOUBLE) END AS lat,
        CASE WHEN k % 4 = 0 THEN {metro('o', 1)} + (o * 104729 % 7000) / CAST(10000 AS DOUBLE) - CAST(0.35 AS DOUBLE) ELSE {metro('(k % 3)', 1)} + (k * 9973 % 9000) / CAST(10000 AS DOUBLE) - CAST(0.45 AS DOUBLE) END AS lon,
        CASE k % 3 WHEN 0 THEN 'flock' WHEN 1 THEN 'alpr' ELSE 'unsure' END AS category,
        CASE WHEN k % 2 = 0 THEN k * 11 % 400 END AS direction,
        CASE k % 4 WHEN 0 THEN 'pole' WHEN 1 THEN 'building' WHEN 2 THEN 'trailer' ELSE 'tree' END AS mount,
        CASE WHEN k % 3 <> 0 THEN p_brand END AS operator, p_name AS notes,
        CASE WHEN k % 6 = 0 THEN 'uploaded' ELSE 'local' END AS status,
        CASE WHEN k % 6 = 0 THEN k * 2 END AS osm_element_id
    FROM (SELECT p_partkey AS k, p_partkey * 4 + 1 AS o, p_brand, p_name FROM part))"""

AREAS = f"""areas AS (
    SELECT k AS id, s_name AS name, {metro('k', 0)} + (k * 6151 % 6000) / CAST(10000 AS DOUBLE) - CAST(0.3 AS DOUBLE) AS lat,
        {wrapped(f"({metro('k', 1)} + (k * 8887 % 6000) / CAST(10000 AS DOUBLE) - CAST(0.3 AS DOUBLE))")} AS lon, 100 + k * 3777 % 9900 AS radius_m
    FROM (SELECT s_suppkey AS k, s_name FROM supplier))"""

ROUTES = """routes AS (SELECT n_nationkey AS id, n_name AS name, 50 + n_nationkey * 41 % 950 AS corridor_m FROM nation)"""

VERTICES = f"""vertices AS (
    SELECT k AS route, i AS pos, {metro('k', 0)} - CAST(0.3 AS DOUBLE) + i * CAST(0.1 AS DOUBLE) + ((k * 31 + i * 17) % 50) / CAST(1000 AS DOUBLE) AS lat,
        {metro('k', 1)} - CAST(0.3 AS DOUBLE) + i * CAST(0.1 AS DOUBLE) + ((k * 13 + i * 29) % 50) / CAST(1000 AS DOUBLE) AS lon
    FROM (SELECT n_nationkey AS k, CAST(unnest(range(6)) AS INTEGER) AS i FROM nation))"""

ALERTS = """alert_events AS (
    SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'route' ELSE 'area' END AS target_type, user_id % 20 AS target_id, 'node' AS osm_type,
        event_id * 7 % 500 AS osm_id,
        CASE event_type WHEN 'signup' THEN 'baseline' WHEN 'purchase' THEN 'added' WHEN 'view' THEN 'added' WHEN 'error' THEN 'removed' ELSE 'other' END AS event,
        CAST(floor(epoch(ts)) AS BIGINT) AS occurred_at, event_id % 3 = 0 AS notified
    FROM events)"""

SIGHTINGS = f"""sightings AS (
    SELECT k AS pos,
        CASE WHEN k % 41 = 0 THEN 'bad:mac' ELSE concat_ws(':', CASE dd % 4 WHEN 0 THEN '70:C9:4E' WHEN 1 THEN '3c:91:80' WHEN 2 THEN 'AA-BB-CC' ELSE 'd8:f3:bc' END, printf('%02X', dd % 256), printf('%02X', CAST(floor(dd / 256) AS BIGINT)), '0a') END AS netid,
        CASE WHEN k % 43 = 0 THEN NULL ELSE {metro('k', 0)} + (k * 7919 % 7000) / CAST(10000 AS DOUBLE) END AS lat,
        CASE WHEN k % 47 = 0 THEN CAST(200.5 AS DOUBLE) ELSE {metro('(k % 3)', 1)} + (k * 7919 % 7000) / CAST(10000 AS DOUBLE) END AS lon,
        CASE k % 6 WHEN 0 THEN 'Flock' WHEN 1 THEN 'flock-1A2B3C' WHEN 2 THEN ' FLOCK007 ' WHEN 3 THEN 'Flock Camera net.' WHEN 4 THEN 'home' ELSE 'flocking' END AS ssid,
        CASE WHEN k % 17 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS lasttime,
        CASE WHEN k % 2 = 0 THEN 'upstream' ELSE 'import' END AS source
    FROM (SELECT event_id AS k, event_id % 2500 AS dd, ts FROM events))"""

FIXES = f"""fixes AS (
    SELECT u AS device, epoch_us(ts) // 1000 AS time_ms, ts,
        {metro('(u % 3)', 0)} + (u * 7919 % 500) / CAST(10000 AS DOUBLE) + (k * 13 % 60) / CAST(10000 AS DOUBLE) AS lat,
        {metro('(u % 3)', 1)} + (u * 104729 % 500) / CAST(10000 AS DOUBLE) + (k * 29 % 60) / CAST(10000 AS DOUBLE) AS lon,
        value * CAST(1.5 AS DOUBLE) AS accuracy_m
    FROM (SELECT event_id AS k, user_id AS u, ts, value FROM events))"""

SYNC_RUNS = """sync_runs AS (
    SELECT id, started_at, CASE WHEN outcome <> 'running' THEN started_at + id % 300 END AS finished_at, outcome,
        CASE WHEN outcome <> 'ok' THEN props END AS detail, CASE WHEN id % 5 <> 0 THEN id * 3 END AS elements, id * 101 AS bytes
    FROM (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS started_at, props,
        CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'running' ELSE 'offline' END AS outcome FROM events))"""

WAYS = """ways AS (
    SELECT k AS way,
        CASE k % 7 WHEN 0 THEN 'residential' WHEN 1 THEN 'primary' WHEN 2 THEN 'motorway' WHEN 3 THEN 'service' WHEN 4 THEN 'tertiary_link' WHEN 5 THEN 'living_street' ELSE 'unclassified' END AS highway,
        CASE WHEN p_size % 3 = 0 THEN 'yes' WHEN p_size % 11 = 1 THEN '-1' WHEN p_size % 13 = 1 THEN 'reversible' END AS oneway,
        CASE WHEN k % 9 = 0 THEN 'private' END AS access,
        CASE WHEN k % 23 = 5 THEN 'yes' END AS area,
        CASE WHEN k % 29 = 3 THEN 'no' WHEN k % 29 = 4 THEN 'yes' END AS motor_vehicle,
        CASE WHEN k % 31 = 7 THEN 'private' END AS motorcar,
        CASE WHEN k % 37 = 9 THEN 'roundabout' WHEN k % 41 = 9 THEN 'circular' END AS junction,
        CASE WHEN k % 4 <> 3 THEN CASE k % 6 WHEN 0 THEN '50' WHEN 1 THEN '35 mph' WHEN 2 THEN '50;60' WHEN 3 THEN 'signals' WHEN 4 THEN '200' ELSE ' 30 ' END END AS maxspeed,
        i AS pos,
        CAST((CASE WHEN k % 2 = 0 THEN k // 40 ELSE k // 40 + i END) * 20000 + 412000000 AS INTEGER) AS lat_e7,
        CAST((CASE WHEN k % 2 = 0 THEN k % 40 + i ELSE k % 40 END) * 20000 - 960000000 AS INTEGER) AS lon_e7
    FROM (SELECT p_partkey AS k, p_size, CAST(unnest(range(4)) AS INTEGER) AS i FROM part))"""


#: Streets in bends whose rows lie 30 m apart, and drives along them, some 20 m off, with gaps and a way around.
BENDS = f"""bends AS (
    SELECT k AS route, i AS pos, {metro('k', 0)} + (k * 7919 % 7000) / CAST(10000 AS DOUBLE) + (i // 2) * CAST(0.00027 AS DOUBLE) AS lat,
        {metro('k', 1)} + CASE WHEN i % 4 IN (1, 2) THEN CAST(0.005 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS lon
    FROM (SELECT c_custkey AS k, CAST(unnest(range(12)) AS INTEGER) AS i FROM customer))"""

BEND_DRIVES = """bend_drives AS (
    SELECT route AS trip, route, j * 3000 AS time_ms,
        lat1 + (lat2 - lat1) * (j % 10) / CAST(10 AS DOUBLE) + ((route * 7 + j * 13) % 41 - 20) / CAST(100000 AS DOUBLE) + CASE WHEN route % 10 = 3 AND j BETWEEN 40 AND 44 THEN CAST(0.004 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS lat,
        lon1 + (lon2 - lon1) * (j % 10) / CAST(10 AS DOUBLE) + ((route * 11 + j * 17) % 31 - 15) / CAST(100000 AS DOUBLE) AS lon
    FROM (SELECT route, pos, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM bends WINDOW w AS (PARTITION BY route ORDER BY pos)),
        (SELECT CAST(unnest(range(110)) AS BIGINT) AS j)
    WHERE lat2 IS NOT NULL AND j // 10 = pos AND (route + j) % 17 <> 0)"""


def with_(*tables: str, select: str) -> str:
    return f"WITH {', '.join(tables)} {select}"
