"""Fixes of trips matched to their routes by window: each choice depends on the one before it.

The choice at a fix is a function of the candidate chosen at the fix before: a map that is a column of
the fix's row. Fixes are shuffled once, by trip; candidates are arrays of their fix's row and never travel. Where all candidates
before lead to the same one, a fix is decided at once. Only runs of doubtful fixes are looked at again: functions compose, and
rounds of joins double the reach of what is open, so a trip of n fixes takes at most log2(n) rounds, whatever the number of trips.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbsense.constants import BACKWARD_COST, BUCKET_SIZE, HEADING_FREE_DEG, HEADING_PENALTY_M, LEAST_COS, METRES_PER_DEGREE, MOVING_MPS
from curbsense.functions import geo
from curbsense.operators.spatial import segments
from curbsense.operators.tables import cut

#: Long segments are looked up by pieces, whose boxes have few buckets.
PIECE_M = 500.0
#: The window about the last match, and the least way ahead (metres).
BEHIND_M, AHEAD_M, AHEAD_FREE_M = 40.0, 150.0, 100.0
#: Side of the buckets that segments are looked up by, in degrees (twice that of others: fewer copies of a segment), and buckets around the world.
SIDE = 2 * BUCKET_SIZE
ROUND = round(360 / SIDE)


def _bucket(x: Column) -> Column:
    return F.floor(x / SIDE).cast("long")


def _pieces(s: DataFrame, reach_m: float) -> DataFrame:
    """Rows (route, at, segment, ...): a segment in each bucket that is within reach of it."""
    n = F.greatest(F.lit(1), F.ceil(F.col("length_m") / PIECE_M)).cast("int")
    p = s.withColumn("of", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    ends = {e: (F.col("piece") + i) / F.col("of") for i, e in enumerate("ab")}
    lat = {e: F.col("lat1") + (F.col("lat2") - F.col("lat1")) * t for e, t in ends.items()}
    lon = {e: F.col("lon1") + geo.wrap_lon(F.col("lon2") - F.col("lon1")) * t for e, t in ends.items()}
    # The buckets of a fix are those of its own parallel, on which a degree of longitude may be shorter.
    high = F.least(F.greatest(F.abs(lat["a"]), F.abs(lat["b"])) + reach_m / METRES_PER_DEGREE, F.lit(90.0))
    pads = {"r": F.lit(reach_m / METRES_PER_DEGREE), "c": reach_m / (METRES_PER_DEGREE * geo.metre_cos(high))}
    span = {k: F.sequence(_bucket(F.least(x["a"], x["b"]) - pads[k]), _bucket(F.greatest(x["a"], x["b"]) + pads[k])) for k, x in (("r", lat), ("c", lon))}
    cells = F.flatten(F.transform(span["r"], lambda r: F.transform(span["c"], lambda c: F.struct(r.alias("r"), F.pmod(c, F.lit(ROUND)).alias("c")))))
    return p.withColumn("at", F.explode(cells)).drop("of", "piece").distinct()


def _near(vertices: DataFrame, reach_m: float) -> DataFrame:
    """Rows (route, at, segments): the segments of a route that are within reach of a bucket, in one row; what belongs to a segment is reckoned here, once."""
    w = W.partitionBy("route")
    s = segments(vertices).withColumn("last", F.col("segment") == F.max("segment").over(w))
    own = {"dlat": F.col("lat2") - F.col("lat1"), "dlon": geo.wrap_lon(F.col("lon2") - F.col("lon1")), "bearing": geo.bearing_deg("lat1", "lon1", "lat2", "lon2")}
    row = F.struct(F.col("segment").cast("int").alias("segment"), "last", "start_m", "length_m", "lat1", "lon1", *own)
    return _pieces(s, reach_m).withColumns(own).groupBy("route", "at").agg(F.collect_list(row).alias("segments"))


def _candidates(reach_m: float) -> Column:
    """array<struct(segment, start_m, end_m, last, off, along, bearing)>: those of a fix's `segments` that are within reach of it."""
    lat, lon, scale, high = F.col("lat"), F.col("lon"), F.col("scale"), reach_m / METRES_PER_DEGREE + 1e-9

    def level(s: Column) -> Column:
        ends = s["lat1"], s["lat1"] + s["dlat"]
        return lat.between(F.least(*ends) - high, F.greatest(*ends) + high)

    def flat(s: Column) -> Column:
        ax, ay = (F.pmod(s["lon1"] - lon + 180.0, F.lit(360.0)) - 180.0) * scale, (s["lat1"] - lat) * METRES_PER_DEGREE
        return F.struct(s.alias("s"), ax.alias("ax"), ay.alias("ay"), (s["dlon"] * scale).alias("dx"), (s["dlat"] * METRES_PER_DEGREE).alias("dy"))

    def share(p: Column) -> Column:
        length = p["dx"] * p["dx"] + p["dy"] * p["dy"]
        t = F.when(length > 0, geo.clamp(-(p["ax"] * p["dx"] + p["ay"] * p["dy"]) / length, 0.0, 1.0)).otherwise(0.0)
        return F.struct(p.alias("p"), t.alias("t"))

    def reached(x: Column) -> Column:
        p, s, t = x["p"], x["p"]["s"], x["t"]
        off = F.sqrt(F.pow(p["ax"] + t * p["dx"], F.lit(2.0)) + F.pow(p["ay"] + t * p["dy"], F.lit(2.0)))
        return F.struct(s["segment"].alias("segment"), s["start_m"].alias("start_m"), (s["start_m"] + s["length_m"]).alias("end_m"), s["last"].alias("last"), off.alias("off"), (s["start_m"] + t * s["length_m"]).alias("along"), s["bearing"].alias("bearing"))

    each = F.transform(F.transform(F.transform(F.filter("segments", level), flat), share), reached)
    return F.filter(each, lambda c: c["off"] <= reach_m)


def _own_cost(c: Column) -> Column:
    """What a candidate costs whatever the match before: its distance, and more where it heads elsewhere."""
    turned = F.least(F.lit(1.0), F.greatest(F.lit(0.0), geo.angle_diff(F.col("course"), c["bearing"]) - HEADING_FREE_DEG) / 90)
    return c["off"] + F.coalesce(HEADING_PENALTY_M * turned, F.lit(0.0))


def _millimetres(metres: Column) -> Column:
    """Whole millimetres; rounding to decimals would go through the digits of each number, which takes longer than all the rest of a cost."""
    return F.floor(metres * 1000 + 0.5)


def _choice(before: Column | None = None) -> Column:
    """The cheapest of `found` after a match `before` (metres along), those outside its window last; costs are compared by the millimetre, and equal ones by segment."""

    def judged(c: Column) -> Column:
        if before is None:
            return F.struct(F.lit(False).alias("outside"), _millimetres(c["cost"]).alias("cost"), c["segment"].alias("segment"))
        inside = (c["start_m"] <= before + F.col("ahead")) & (c["last"] | (c["end_m"] > F.greatest(F.lit(0.0), before - BEHIND_M)))
        back = BACKWARD_COST * F.greatest(F.lit(0.0), before - c["along"])
        return F.struct((~inside).alias("outside"), _millimetres(c["cost"] + F.when(inside, back).otherwise(0.0)).alias("cost"), c["segment"].alias("segment"))

    return F.array_min(F.transform("found", judged))["segment"]


def _decided(steps: DataFrame) -> DataFrame:
    """Steps, where one that leads to the same segment from everywhere is that segment, and no step any more."""
    ends = F.map_values("step")
    steps = steps.withColumn("segment", F.coalesce("segment", F.when(F.size(F.array_distinct(ends)) == 1, F.get(ends, F.lit(0)))))
    return steps.withColumn("step", F.when(F.col("segment").isNull(), F.col("step")))


def windowed(fixes: DataFrame, vertices: DataFrame, reach_m: float = 60.0, made: list[str] | None = None) -> DataFrame:
    """Rows (trip, n, time_ms, segment, along_m, off_m) of fixes (trip, route, time_ms, lat, lon) matched to routes (route, pos, lat, lon).

    The fixes of a trip are numbered by time, then position. Candidates are the segments of the
    route within `reach_m`. A fix takes the cheapest one in a window about the last match: the
    distance, up to HEADING_PENALTY_M for a segment that heads elsewhere than a moving device, and
    BACKWARD_COST for each metre back. Without a candidate in the window, or a match before, it takes
    the cheapest of all, and none is behind. The window reaches BEHIND_M back, and ahead twice as far as the
    device has moved.

    A fix without a candidate, or with a null, has a null segment (and one of no trip no number), and the next one follows the match
    before it. Repeated rows are fixes of their own; a route without two vertices matches nothing; a
    trip should keep to one route; empty tables give none. Other columns are not used, and fixes are read twice. The cost of a
    step is the product of two fixes' candidates, which is bounded by how many segments of one route are within reach.
    Tables that the rounds write are added to `made`.
    """
    # Fixes of no trip are spread, and get no number.
    spread = F.when(F.col("trip").isNull(), F.xxhash64("time_ms", "lat", "lon"))
    at = F.struct(_bucket(F.col("lat")).alias("r"), F.pmod(_bucket(F.col("lon")), F.lit(ROUND)).alias("c"))
    rows = fixes.select("trip", "route", "time_ms", "lat", "lon", at.alias("at"), spread.alias("spread"))
    # A trip gets the segments of each bucket that it passes once, and its fixes find them where they are.
    near = _near(vertices.select("route", "pos", "lat", "lon"), reach_m)
    passed = cut(rows.where("trip IS NOT NULL").select("trip", "route", "at").distinct(), made)
    near = passed.join(near.hint("merge"), ["route", "at"]).withColumn("fix", F.lit(False))
    rows = rows.withColumn("fix", F.lit(True)).unionByName(near, allowMissingColumns=True).repartition("trip", "spread")
    bucket = W.partitionBy("trip", "spread", "route", "at").orderBy("fix").rowsBetween(W.unboundedPreceding, W.currentRow)
    scale = METRES_PER_DEGREE * F.greatest(F.cos(F.radians("lat")), F.lit(LEAST_COS))
    rows = rows.withColumns({"segments": F.first("segments").over(bucket), "scale": scale}).where("fix")
    rows = rows.select("trip", "spread", "time_ms", "lat", "lon", _candidates(reach_m).alias("found"))
    # The fix before that has candidates, and what each of these leads to.
    order = W.partitionBy("trip", "spread").orderBy("time_ms", "lat", "lon")
    earlier, seen = order.rowsBetween(W.unboundedPreceding, -1), F.coalesce(F.size("found") > 0, F.lit(False))
    rows = rows.withColumn("n", F.when(F.col("trip").isNotNull(), F.row_number().over(order)))
    brief = F.transform("found", lambda c: F.struct(c["segment"].alias("segment"), c["along"].alias("along")))
    rows = rows.withColumn("p", F.last(F.when(seen, F.struct("n", "time_ms", "lat", "lon", brief.alias("found"))), ignorenulls=True).over(earlier))
    rows = rows.withColumns({"gap": (F.col("time_ms") - F.col("p.time_ms")) / 1000, "moved": geo.haversine_m("p.lat", "p.lon", "lat", "lon")})
    rows = rows.withColumn("speed", F.when(F.col("gap") > 0, F.col("moved") / F.col("gap")).otherwise(0.0))
    course = F.when((F.col("speed") >= MOVING_MPS) & (F.col("moved") > 3.0), geo.bearing_deg("p.lat", "p.lon", "lat", "lon"))
    ahead = F.greatest(F.lit(AHEAD_M), F.col("speed") * F.greatest(F.col("gap"), F.lit(1.0)) * 2 + AHEAD_FREE_M)
    rows = rows.withColumns({"course": course, "ahead": ahead})
    rows = rows.withColumn("found", F.transform("found", lambda c: c.withField("cost", _own_cost(c))))
    step = F.map_from_arrays(F.transform("p.found", lambda q: q["segment"]), F.transform("p.found", lambda q: _choice(q["along"])))
    rows = _decided(rows.withColumns({"segment": F.when(F.col("p").isNull() & seen, _choice()), "step": F.when(F.col("p").isNotNull() & seen, step)}))
    # A step whose base is sure is taken at once, so the bases of the others have been in doubt as well.
    came = F.last(F.when(seen, F.struct("segment")), ignorenulls=True).over(earlier)
    rows = rows.withColumns({"came": came["segment"], "doubt": F.col("step").isNotNull()})
    rows = rows.withColumn("segment", F.coalesce("segment", F.col("step")[F.col("came")]))
    match, is_open = F.get(F.filter("found", lambda c: c["segment"] == F.col("segment")), F.lit(0)), F.col("doubt") & F.col("segment").isNull()
    options = F.transform("found", lambda c: F.struct(c["segment"].alias("segment"), c["along"].alias("along"), c["off"].alias("off")))
    rows = rows.withColumns({"match": match, "base": F.col("p.n"), "step": F.when(is_open, F.col("step")), "options": F.when(is_open, options)})
    rows = cut(rows.select("trip", "n", "time_ms", "segment", F.col("match.along").alias("along_m"), F.col("match.off").alias("off_m"), "doubt", "base", "step", "options"), made)
    steps, sure = rows.where("doubt").select("trip", "n", "base", "step", "segment"), []
    while True:
        sure.append(steps.where("step IS NULL"))
        steps = steps.where("step IS NOT NULL")
        if steps.isEmpty():
            break
        known = functools.reduce(DataFrame.unionByName, sure, steps)
        through = known.select("trip", F.col("n").alias("base"), F.col("base").alias("base2"), F.col("step").alias("step2"), F.col("segment").alias("came"))
        longer = steps.drop("segment").hint("merge").join(through, ["trip", "base"])
        composed = F.transform_values("step2", lambda _, v: F.col("step")[v])
        longer = longer.select("trip", "n", F.col("base2").alias("base"), composed.alias("step"), F.col("step")[F.col("came")].alias("segment"))
        steps = cut(_decided(longer), made)
    chosen = functools.reduce(DataFrame.unionByName, sure).select("trip", "n", "segment")
    waiting = rows.where("options IS NOT NULL").select("trip", "n", "time_ms", "options").hint("merge").join(chosen, ["trip", "n"])
    waiting = waiting.withColumn("match", F.get(F.filter("options", lambda c: c["segment"] == F.col("segment")), F.lit(0)))
    out = ("trip", "n", "time_ms", "segment")
    return rows.where("options IS NULL").select(*out, "along_m", "off_m").unionByName(waiting.select(*out, F.col("match.along").alias("along_m"), F.col("match.off").alias("off_m")))
