"""Map aggregation: filters, hexagon density, and viewport counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbsense.constants import MID_LEVEL, NEAR_LEVEL, NODE_PX, WIDE_LEVEL
from curbsense.functions import geo


def marker_kind(category: Column) -> Column:
    """Unknown cameras are drawn as alpr."""
    return F.when(category == "unknown", "alpr").otherwise(category)


def engine_points(cameras: DataFrame, submissions: DataFrame) -> DataFrame:
    """Rows (key, lat, lon, kind, user, stale, operator) of cameras, and of submissions under the kind user."""
    cams = cameras.select(F.concat_ws("/", "osm_type", "osm_id").alias("key"), "lat", "lon", marker_kind(F.col("category")).alias("kind"), F.lit(0).alias("user"), F.col("stale_since").isNotNull().alias("stale"), "operator")
    subs = submissions.select(F.concat_ws("/", F.lit("submission"), "id").alias("key"), "lat", "lon", F.lit("user").alias("kind"), F.lit(1).alias("user"), F.lit(False).alias("stale"), "operator")
    return cams.unionByName(subs)


def included(kinds: tuple[str, ...], operator: str = "") -> Column:
    """Never stale, of an enabled kind, and with operator text only where the operator contains it."""
    keep = ~F.col("stale") & F.col("kind").isin(*kinds)
    needle = operator.strip().lower()
    return keep & F.lower("operator").contains(needle) & F.col("operator").isNotNull() if needle else keep


def hex_density(points: DataFrame) -> DataFrame:
    """Rows (level, q, r, count, users, max_count) of the wide levels; every point is read once and binned six times."""
    levels = F.array(*(F.struct(F.lit(level).alias("level"), F.lit(geo.hex_columns(level)).alias("cols")) for level in range(WIDE_LEVEL + 1)))
    rows = points.select("user", geo.merc_x("lon").alias("x"), geo.merc_y("lat").alias("y"), F.explode(levels).alias("at")).select("user", "x", "y", "at.*")
    # Step by step, so that no expression is repeated in the next one.
    rows = rows.withColumns({"qf": (2 / 3) * F.col("x") * 1.5 * F.col("cols"), "rf": (-(1 / 3) * F.col("x") + (3**0.5 / 3) * F.col("y")) * 1.5 * F.col("cols")})
    rows = rows.withColumns({"q0": geo.js_round(F.col("qf")), "r0": geo.js_round(F.col("rf")), "s0": geo.js_round(-F.col("qf") - F.col("rf"))})
    rows = rows.withColumns({"dq": F.abs(F.col("q0") - F.col("qf")), "dr": F.abs(F.col("r0") - F.col("rf")), "ds": F.abs(F.col("s0") + F.col("qf") + F.col("rf"))})
    q_off = (F.col("dq") > F.col("dr")) & (F.col("dq") > F.col("ds"))
    rows = rows.withColumns({"q1": F.when(q_off, -F.col("r0") - F.col("s0")).otherwise(F.col("q0")), "r1": F.when(~q_off & (F.col("dr") > F.col("ds")), -F.col("q0") - F.col("s0")).otherwise(F.col("r0"))})
    rows = rows.withColumn("q", F.pmod("q1", "cols"))
    bins = rows.groupBy("level", F.col("q").cast("int").alias("q"), (F.col("r1") + (F.col("q1") - F.col("q")) / 2).cast("int").alias("r"))
    bins = bins.agg(F.count(F.lit(1)).alias("count"), F.sum("user").alias("users"))
    most = bins.groupBy("level").agg(F.max("count").alias("max_count"))
    return bins.join(F.broadcast(most), "level")


def viewport_counts(points: DataFrame, box: tuple[float, float, float, float], kinds: tuple[str, ...], operator: str = "") -> DataFrame:
    """One row: visible points of a viewport, users among them, and totals by kind with and without the filter; one pass."""
    south, west, north, east = box
    inside = points.where(geo.in_box("lat", "lon", geo.sanitized_box(south, west, north, east)) & ~F.col("stale"))
    keep = F.coalesce(included(kinds, operator), F.lit(False))
    every = ("flock", "alpr", "user")
    return inside.agg(F.count_if(keep).alias("visible"), F.count_if(keep & (F.col("user") == 1)).alias("users"), *(F.count_if(keep & (F.col("kind") == k)).alias(k) for k in every), *(F.count_if(F.col("kind") == k).alias(f"all_{k}") for k in every))


def lod_level(zoom: Column) -> Column:
    return geo.clamp(F.floor(zoom + 1e-9), 0, 20).cast("int")


def lod_band(level: Column) -> Column:
    return F.when(level <= WIDE_LEVEL, "wide").when(level <= MID_LEVEL, "mid").when(level <= NEAR_LEVEL, "near").otherwise("detail")


def node_radius(count: Column, largest: Column) -> Column:
    """Area in proportion to the count, relative to the level's largest node; never below the visible radius."""
    scale = NODE_PX[1] / F.sqrt(F.greatest(F.lit(1), largest))
    return F.greatest(F.lit(NODE_PX[0]), scale * F.sqrt(count))


def density(count: Column, largest: Column) -> Column:
    """Logarithmic position on the ramp, in [0, 1]."""
    return F.when((largest <= 1) | (count <= 1), F.when(count >= largest, 1.0).otherwise(0.0)).otherwise(geo.clamp(F.ln(count) / F.ln(largest), 0.0, 1.0))


def format_count(n: Column) -> Column:
    """Exact below 1,000, else as 1.2k, 12k or 1.2M.

    One digit is that of the nearest tenth to the quotient as a double; what lies half-way goes up.
    """

    def short(unit: int) -> Column:
        x, tenths = n / unit, F.floor(n * 10 / unit)
        # How far the quotient times its unit is from n, exactly: the quotient in two halves of its digits.
        high = x * 134217729.0 - (x * 134217729.0 - x)
        p = x * float(unit)
        off = (p - n) + ((high * float(unit) - p) + (x - high) * float(unit))
        rest = n * 10 % unit * 2
        up = F.when(rest == unit, off >= 0).otherwise(rest > unit)
        tenths = tenths + up.cast("int")
        return F.when(tenths % 10 == 0, (tenths / 10).cast("long").cast("string")).otherwise(F.concat_ws(".", (tenths / 10).cast("long").cast("string"), (tenths % 10).cast("string")))

    return F.when(n < 1000, n.cast("string")).when(n < 10_000, F.concat(short(1000), F.lit("k"))).when(n < 999_500, F.concat(geo.js_round(n / 1000).cast("string"), F.lit("k"))).otherwise(F.concat(short(1_000_000), F.lit("M")))
