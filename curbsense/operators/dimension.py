"""Maintenance of the camera and Wi-Fi dimensions: each operator computes the next version of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbsense.constants import CACHED_TILES, PLAUSIBLE_FLOOR, PLAUSIBLE_SHARE, STALE_RETENTION_S, TILE_TTL_S, WIFI_RETENTION_DAYS
from curbsense.functions import geo

KEY = ["osm_type", "osm_id"]


def upsert(cameras: DataFrame, elements: DataFrame, now: int) -> DataFrame:
    """cameras with elements (osm_type, osm_id, lat, lon, category, pos) put in: of equal keys the last element wins.

    A camera that is seen keeps first_seen and is no longer stale.
    """
    new = elements.groupBy(*KEY).agg(F.max_by(F.struct("lat", "lon", "category"), "pos").alias("new"))
    both = cameras.join(new, KEY, "full_outer")
    seen = F.col("new").isNotNull()
    pick = lambda name: F.when(seen, F.col("new")[name]).otherwise(F.col(name)).alias(name)
    return both.select(
        *KEY, pick("lat"), pick("lon"), pick("category"), F.coalesce("first_seen", F.lit(now)).alias("first_seen"), F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"), F.when(~seen, F.col("stale_since")).alias("stale_since")
    )


def purge_stale(cameras: DataFrame, now: int) -> DataFrame:
    """Without the cameras that have been stale for longer than the retention."""
    return cameras.where(F.col("stale_since").isNull() | (F.col("stale_since") >= now - STALE_RETENTION_S))


def plausible(active: int, received: int) -> bool:
    """Whether a worldwide answer may replace what is stored."""
    return active < PLAUSIBLE_FLOOR or received >= PLAUSIBLE_SHARE * active


def ingest_global(cameras: DataFrame, elements: DataFrame, started_at: int, now: int) -> DataFrame:
    """The next version after a worldwide sync: upsert, mark what was not seen since the start, purge. Raises on an implausible answer."""
    if not plausible(cameras.where("stale_since IS NULL").count(), elements.count()):
        raise ValueError("the answer has too few elements; it was not applied")
    fresh = upsert(cameras, elements, now)
    marked = fresh.withColumn("stale_since", F.when((F.col("last_seen") < started_at) & F.col("stale_since").isNull(), now).otherwise(F.col("stale_since")))
    return purge_stale(marked, now)


def ingest_cells(cameras: DataFrame, elements: DataFrame, box: tuple[float, float, float, float], now: int) -> DataFrame:
    """The next version after a fetch of a box: upsert, then mark active cameras inside it (as now placed) that it lacks. West > east crosses the antimeridian."""
    south, west, north, east = box
    fresh = upsert(cameras, elements, now).join(elements.select(*KEY).distinct().withColumn("present", F.lit(True)), KEY, "left")
    gone = F.col("present").isNull() & F.col("stale_since").isNull() & geo.in_box("lat", "lon", geo.sanitized_box(south, west, north, east))
    return fresh.withColumn("stale_since", F.when(gone, now).otherwise(F.col("stale_since"))).drop("present")


def stamp_cells(stored: DataFrame, fetched: DataFrame, now: int) -> DataFrame:
    """Rows (cell, fetched_at): the stored cells, those of `fetched` (cell) as fetched now, and new ones among them."""
    fresh = fetched.select("cell").distinct().withColumn("now", F.lit(now))
    return stored.join(fresh, "cell", "full_outer").select("cell", F.coalesce("now", "fetched_at").cast("long").alias("fetched_at"))


def stale_cells(wanted: DataFrame, fetched: DataFrame, ttl_s: int, now: int) -> DataFrame:
    """The wanted cells (cell) without a fresh entry in fetched (cell, fetched_at)."""
    fresh = fetched.where(F.lit(now) - F.col("fetched_at") < ttl_s)
    return wanted.join(fresh, "cell", "left_anti")


def tile_evict(tiles: DataFrame, now: int) -> DataFrame:
    """The cached tiles (tile, fetched_at) that stay: not expired, and of those the newest CACHED_TILES."""
    live = tiles.where(F.col("fetched_at") >= now - TILE_TTL_S)
    return live.orderBy(F.desc("fetched_at"), "tile").limit(CACHED_TILES)


def wifi_dedupe(rows: DataFrame) -> DataFrame:
    """One row a netid: the latest last_seen, null lowest, then the earlier pos."""
    order = W.partitionBy("netid").orderBy(F.col("last_seen").desc_nulls_last(), "pos")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def wifi_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """stored with incoming (one row a netid each) put in where its last_seen is at least as recent; texts compare as texts."""
    both = stored.withColumn("turn", F.lit(0)).unionByName(incoming.withColumn("turn", F.lit(1)))
    order = W.partitionBy("netid").orderBy(F.coalesce("last_seen", F.lit("")).desc(), F.desc("turn"))
    return both.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank", "turn")


def wifi_prune(rows: DataFrame, now: int) -> DataFrame:
    """Without rows last seen before the retention; those without a time stay."""
    cutoff = F.date_format(F.timestamp_seconds(F.lit(now - WIFI_RETENTION_DAYS * 86_400)), "yyyy-MM-dd")
    return rows.where(F.col("last_seen").isNull() | (F.substring("last_seen", 1, 10) >= cutoff))


def wifi_replace(stored: DataFrame, incoming: DataFrame, source: str, now: int) -> DataFrame:
    """A source's rows replaced by incoming, then pruned."""
    return wifi_prune(wifi_upsert(stored.where(F.col("source") != source), incoming), now)


def sync_summary(runs: DataFrame) -> DataFrame:
    """One row: last_ok_at; the latest finished attempt's time, outcome and error; elements, bytes and duration of the latest ok run that has elements."""
    at = F.coalesce("finished_at", "started_at")
    tried = F.max(F.when(F.col("outcome") != "running", F.struct(at.alias("at"), "id", "outcome", "detail"))).alias("tried")
    data = F.max(F.when((F.col("outcome") == "ok") & F.col("elements").isNotNull(), F.struct("finished_at", "id", "elements", "bytes", (F.col("finished_at") - F.col("started_at")).alias("took")))).alias("data")
    one = runs.agg(F.max(F.when(F.col("outcome") == "ok", F.col("finished_at"))).alias("last_ok_at"), tried, data)
    error = F.when(F.col("tried.outcome") != "ok", F.col("tried.detail"))
    return one.select("last_ok_at", F.col("tried.at").alias("last_attempt_at"), F.col("tried.outcome").alias("last_outcome"), error.alias("last_error"), F.col("data.elements").alias("last_elements"), F.col("data.bytes").alias("last_bytes"), F.col("data.took").alias("last_duration_secs"))


def sync_interrupted(runs: DataFrame) -> DataFrame:
    """Runs that never ended count as errors."""
    open_ = F.col("outcome") == "running"
    return runs.withColumns({"detail": F.when(open_, "interrupted").otherwise(F.col("detail")), "outcome": F.when(open_, "error").otherwise(F.col("outcome"))})
