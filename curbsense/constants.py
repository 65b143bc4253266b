"""Fixed values of the domain: grid, ranges, retention and thresholds."""

from __future__ import annotations

# Spatial grid.
CELL_SIZE = 0.05
CELL_NUDGE = 1e-9
ROW_RANGE = (-1800, 1799)
COL_RANGE = (-3600, 3599)
METRES_PER_DEGREE = 111_320.0
LEAST_COS = 0.01
EARTH_RADIUS_M = 6_371_008.8
TILE_SIZE = 0.1
BUCKET_SIZE = 0.002

# Dimension maintenance (seconds, shares, counts).
STALE_RETENTION_S = 30 * 86_400
PLAUSIBLE_SHARE = 0.5
PLAUSIBLE_FLOOR = 1000
WIFI_RETENTION_DAYS = 730
TILE_TTL_S = 30 * 86_400
CACHED_TILES = 120
SNAPSHOT_STALE_S = 14 * 86_400

# Ranges of saved targets (metres) and duplicate radius.
RADIUS_RANGE_M = (100, 10_000)
CORRIDOR_RANGE_M = (50, 1_000)
DUPLICATE_M = 15.0
SAME_PLACE_M = 30.0

# Routing.
AVOID_M = 30.0
CORRIDOR_LEAST_M = 3_000.0
ROAD_AREA_LEAST_M = 6_000.0
ROAD_AREA_SHARE = 0.25
ROAD_TRIP_MOST_M = 60_000.0
BLOCKED_PENALTY_S = 3_600.0
LOCAL_REQUESTS = 3
REPAIR_REQUESTS = 24
CORRIDOR_SHARE = 0.3
LONG_DETOUR_SHARE = 0.5
LONG_DETOUR_S = 20 * 60
STRETCH_GAP_M = 8_000.0
STRETCH_MARGIN_M = 4_000.0
MPH_KMH = 1.609344
SPEED_RANGE_KMH = (5.0, 150.0)

# Speeds of road classes without a usable limit (km/h); classes not listed have 45.
CLASS_KMH = {
    "motorway": 100,
    "trunk": 80,
    "primary": 60,
    "secondary": 55,
    "tertiary": 50,
    "unclassified": 45,
    "residential": 40,
    "living_street": 20,
    "motorway_link": 60,
    "trunk_link": 50,
    "primary_link": 45,
    "secondary_link": 45,
    "tertiary_link": 45,
}

# Levels of detail.
WIDE_LEVEL, MID_LEVEL, NEAR_LEVEL, LAST_LEVEL = 5, 10, 13, 20
TILE_PX = 512
CLUSTER_PX = 60
HEX_PX = 22
NODE_PX = (5.5, 34.0)

# Proximity alerts.
PROXIMITY_M = 200.0
ACCURACY_M = 500.0
COOLDOWN_MS = 15 * 60 * 1000
EXIT_FACTOR = 1.5

# Navigation.
OFF_ROUTE_M, MOVING_MPS, LOST_S = 40.0, 2.0, 4
CAMERA_FAR_M, CAMERA_NEAR_M, CAMERA_PASSED_M = 402.3, 152.4, 20.0

# Direction cones.
CONE_WIDTH, CONES = 45.0, 6
CARDINALS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]

# Maker prefixes of the devices' network addresses.
OUIS = [
    "70:C9:4E", "3C:91:80", "D8:F3:BC", "80:30:49", "B8:35:32", "14:5A:FC", "74:4C:A1", "08:3A:88", "9C:2F:9D", "C0:35:32",
    "94:08:53", "E4:AA:EA", "F4:6A:DD", "F8:A2:D6", "24:B2:B9", "00:F4:8D", "D0:39:57", "E8:D0:FC", "E0:4F:43", "B8:1E:A4",
    "70:08:94", "58:8E:81", "EC:1B:BD", "3C:71:BF", "58:00:E3", "90:35:EA", "5C:93:A2", "64:6E:69", "48:27:EA", "A4:CF:12",
    "82:6B:F2",
]

# Navigation states' limits (metres, seconds).
ARRIVE_M, BACK_ON_ROUTE_M, OFF_ROUTE_S, PAUSE_S, GOOD_FIX_M = 30.0, 30.0, 5, 34, 50.0
# Matching a fix to a route (degrees without a penalty, metres at most for heading elsewhere, share for going back).
HEADING_FREE_DEG, HEADING_PENALTY_M, BACKWARD_COST = 45.0, 60.0, 0.5
# Cameras announced together, and where a reroute joins the old route again (metres).
GROUP_M, REJOIN_AHEAD_M, REJOIN_CLEAR_M, REJOIN_LEFT_M, REJOIN_END_M = 150.0, 1500.0, 100.0, 2500.0, 500.0

# Reroute requests (milliseconds between them, and after each failure in a row).
REROUTE_MIN_MS = 10_000
REROUTE_WAITS_MS = (10_000, 20_000, 40_000, 60_000)

# Guiding and rerouting (requests, shares, metres).
GUIDED_REQUESTS, LEG_TRIES, REPLANS, REFUSED_SHARE, REFUSED_M = 40, 3, 4, 1.5, 1000.0
REJOIN_REQUESTS, REPLAN_REQUESTS, REPLAN_GUIDED_REQUESTS = 3, 6, 12
