"""Readers of the formats that data arrives in. Each takes a column or DataFrame of raw texts, so any Spark source can feed it."""

from __future__ import annotations

import csv
import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbsense.functions import geo, text

def _field(v: Column, path: str, *types: str) -> Column:
    """The part of a variant at a path, where it has one of the types that schema_of_variant() names; else null."""
    part = F.try_variant_get(v, path, "variant")
    return F.when(F.regexp_replace(F.schema_of_variant(part), r"\(.*", "").isin(*types), part)


def _text(v: Column, path: str) -> Column:
    return _field(v, path, "STRING").cast("string")


def _number(v: Column, path: str) -> Column:
    return _field(v, path, "BIGINT", "DECIMAL", "DOUBLE").cast("double")


def _whole(v: Column, path: str) -> Column:
    return _field(v, path, "BIGINT").cast("long")


def answers(df: DataFrame, body: str = "body") -> DataFrame:
    """df with one row (pos, e) per element of a map server's answer, as a variant, in place of body.

    Answers that aren't JSON or have no elements, and those whose remark reports a runtime error, have
    no rows.
    """
    rows = df.withColumn("answer", F.try_parse_json(body))
    rows = rows.where(~F.coalesce(F.lower(_text(F.col("answer"), "$.remark")).contains("runtime error"), F.lit(False)))
    elements = F.try_variant_get("answer", "$.elements", "array<variant>")
    return rows.select(*[c for c in df.columns if c != body], F.posexplode(elements).alias("pos", "e"))


def _tags(e: Column) -> Column:
    """Tags as texts; a value that is no text is its JSON."""
    found = F.try_variant_get(e, "$.tags", "map<string,variant>")
    tags = F.transform_values(found, lambda _, v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).otherwise(F.to_json(v)))
    return F.coalesce(tags, F.create_map().cast("map<string,string>"))


def map_elements(df: DataFrame, body: str = "body") -> DataFrame:
    """df with one row per element of a map server's answer: pos, osm_type, osm_id, lat, lon, tags, valid.

    Ways and relations are placed at their center. An element is valid where its type is known, its id
    a whole number and its place in range; a number given as text is not a number.
    """
    e = F.col("e")
    is_node = F.col("osm_type") == "node"
    out = answers(df, body).withColumns({"osm_type": _text(e, "$.type"), "osm_id": _whole(e, "$.id"), "tags": _tags(e)})
    out = out.withColumns({c: F.when(is_node, _number(e, f"$.{c}")).otherwise(_number(e, f"$.center.{c}")) for c in ("lat", "lon")})
    valid = F.col("osm_type").isin("node", "way", "relation") & F.col("osm_id").isNotNull() & geo.valid_coord("lat", "lon")
    return out.select(*[c for c in df.columns if c != body], "pos", "osm_type", "osm_id", "lat", "lon", "tags", F.coalesce(valid, F.lit(False)).alias("valid"))


#: Tags that say whether and how a car may use a way.
ROAD_TAGS = ("highway", "area", "access", "motor_vehicle", "motorcar", "oneway", "junction", "maxspeed")


def map_ways(df: DataFrame, body: str = "body") -> DataFrame:
    """Rows (way, ROAD_TAGS ..., pos, lat_e7, lon_e7) of the ways of a map server's answers with their geometry, for drivable().

    Points that are null or have no place are left out; ways of fewer than two points have no rows.
    """
    e = F.col("e")
    rows = answers(df, body).where(_text(e, "$.type") == "way").select(_whole(e, "$.id").alias("way"), _tags(e).alias("tags"), F.try_variant_get(e, "$.geometry", "array<variant>").alias("points"))
    place = F.transform("points", lambda p: F.struct(geo.js_round(_number(p, "$.lat") * 1e7).cast("int").alias("lat_e7"), geo.js_round(_number(p, "$.lon") * 1e7).cast("int").alias("lon_e7")))
    rows = rows.where("way IS NOT NULL").withColumn("points", F.filter(place, lambda p: p["lat_e7"].isNotNull() & p["lon_e7"].isNotNull())).where("size(points) > 1")
    return rows.select("way", *(F.element_at("tags", t).alias(t) for t in ROAD_TAGS), F.posexplode("points").alias("pos", "p")).select("way", *ROAD_TAGS, "pos", "p.*")


def linestring(body: Column) -> Column:
    """array of struct(lat, lon) of a GeoJSON LineString or a Feature of one; null where it is none or leaves the range."""
    shape = "struct<type:string,coordinates:array<array<double>>,geometry:struct<type:string,coordinates:array<array<double>>>>"
    v = F.from_json(body, shape)
    feature = v["type"] == "Feature"
    kind = F.when(feature, v["geometry"]["type"]).otherwise(v["type"])
    points = F.transform(F.when(feature, v["geometry"]["coordinates"]).otherwise(v["coordinates"]), lambda p: F.struct(F.get(p, 1).alias("lat"), F.get(p, 0).alias("lon")))
    return F.when((kind == "LineString") & F.forall(points, lambda p: F.coalesce(geo.valid_coord(p["lat"], p["lon"]), F.lit(False))), points)


def places_found(df: DataFrame, body: str = "body") -> DataFrame:
    """Rows of a geocoder's answer: pos, display_name, lat, lon, south, west, north, east; numbers may be texts, boxes come as S, N, W, E."""
    parsed = F.from_json(body, "array<struct<display_name:string,lat:string,lon:string,boundingbox:array<string>>>")
    num = lambda x: F.trim(x).try_cast("double")
    rows = df.select(*[c for c in df.columns if c != body], F.posexplode(parsed).alias("pos", "x"))
    box = [F.when(F.size("x.boundingbox") == 4, num(F.col("x.boundingbox")[i])).alias(n) for n, i in (("south", 0), ("west", 2), ("north", 1), ("east", 3))]
    return rows.select(*[c for c in df.columns if c != body], "pos", F.coalesce("x.display_name", F.lit("")).alias("display_name"), num(F.col("x.lat")).alias("lat"), num(F.col("x.lon")).alias("lon"), *box).where("lat IS NOT NULL AND lon IS NOT NULL")


def track_points(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Rows (pos, lat, lon) of a GPX text: track points of all segments in order, or route points where there are none; prefixes of names are ignored."""
    of = lambda name, axis: F.xpath(F.col(xml), F.lit(f'//*[local-name()="{name}"]/@{axis}'))
    either = lambda axis: F.when(F.size(of("trkpt", axis)) > 0, of("trkpt", axis)).otherwise(of("rtept", axis))
    rows = df.select(*[c for c in df.columns if c != xml], F.posexplode(F.arrays_zip(either("lat").alias("lat"), either("lon").alias("lon"))).alias("at", "p"))
    rows = rows.select(*[c for c in df.columns if c != xml], "at", F.col("p.lat").try_cast("double").alias("lat"), F.col("p.lon").try_cast("double").alias("lon"))
    rows = rows.where(F.coalesce(geo.valid_coord("lat", "lon"), F.lit(False)))
    keys = [c for c in df.columns if c != xml]
    return rows.withColumn("pos", F.row_number().over(W.partitionBy(*keys).orderBy("at")) - 1).drop("at")


def decode_polyline(shape: Column, digits: int = 6) -> Column:
    """array of struct(lat, lon) of an encoded polyline; null where it is malformed or cut short."""

    @F.pandas_udf("array<struct<lat:double,lon:double>>")
    def decode(shapes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in shapes:
            yield batch.map(one)

    def one(s: str | None):
        if s is None:
            return None
        values, total, bits, open_ = [], 0, 0, False
        for ch in s:
            b = ord(ch) - 63
            if not 0 <= b < 64 or bits > 60:
                return None
            total |= (b & 31) << bits
            bits, open_ = bits + 5, b >= 32
            if not open_:
                values.append(~(total >> 1) if total & 1 else total >> 1)
                total = bits = 0
        if open_ or len(values) % 2:
            return None
        lat = lon = 0
        out = []
        for dy, dx in zip(values[::2], values[1::2], strict=True):
            lat, lon = lat + dy, lon + dx
            out.append({"lat": lat / 10**digits, "lon": lon / 10**digits})
        return out

    return decode(shape)


def encode_polyline(points: Column, digits: int = 6) -> Column:
    """The text that decode_polyline() reads, of an array of struct(lat, lon)."""

    @F.pandas_udf("string")
    def encode(rows: pd.Series) -> pd.Series:
        return rows.map(one)

    def one(points) -> str | None:
        if points is None:
            return None
        out, before = [], [0, 0]
        for p in points:
            for axis, name in enumerate(("lat", "lon")):
                now = round(p[name] * 10**digits)
                delta, before[axis] = now - before[axis], now
                value = ~(delta << 1) if delta < 0 else delta << 1
                while value >= 32:
                    out.append(chr((32 | value & 31) + 63))
                    value >>= 5
                out.append(chr(value + 63))
        return "".join(out)

    return encode(points)


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows (path, ok, reason) of files (path, content) against a manifest (path, bytes, sha256)."""
    both = files.join(manifest, "path")
    reason = F.when(F.octet_length("content") != F.col("bytes"), "size").when(F.sha2("content", 256) != F.lower("sha256"), "digest")
    return both.select("path", reason.isNull().alias("ok"), reason.alias("reason"))


def drivable(ways: DataFrame) -> DataFrame:
    """Of rows (way, ROAD_TAGS ..., more) those a car may use, with direction (1, -1, 0) and kmh in place of the tags but highway.

    Roundabouts and motorways are one way where their tag doesn't say otherwise.
    """
    kmh = text.class_kmh(F.col("highway"))
    tag = lambda c: F.coalesce(F.col(c), F.lit(""))
    shut = tag("access").isin("private", "no", "agricultural", "forestry", "delivery") | tag("motor_vehicle").isin("private", "no") | tag("motorcar").isin("private", "no")
    keep = kmh.isNotNull() & (tag("area") != "yes") & ~shut & ~tag("oneway").isin("reversible", "alternating")
    implied = (F.col("highway") == "motorway") | tag("junction").isin("roundabout", "circular")
    direction = F.when(tag("oneway").isin("yes", "1", "true"), 1).when(tag("oneway").isin("-1", "reverse"), -1).when(tag("oneway").isin("no", "0", "false"), 0).when(implied, 1).otherwise(0)
    rows = ways.where(keep).withColumns({"direction": direction, "kmh": F.coalesce(text.maxspeed(F.col("maxspeed")), kmh)})
    return rows.drop(*(t for t in ROAD_TAGS if t != "highway"))


#: Characters that the buffer of a line's parser holds at a time.
LINE_BUFFER = 512


def csv_rows(lines: DataFrame, required: str, line: str = "line") -> DataFrame:
    """Rows (pos, columns ...) of a CSV file given by its lines (pos, line); columns are named by its header, in lower case.

    The header is the first line that isn't a scanner's preamble; quoted fields may hold commas and
    doubled quotes. Raises ValueError where the header lacks the required column. Short rows end in
    nulls.
    """
    # Behind explode() a line is made once, and parsed once; filters and columns of a projection would each do so anew.
    body = lines.select("pos", F.explode(F.array(line)).alias(line)).where(~F.col(line).startswith("WigleWifi"))
    head = body.agg(F.min_by(line, "pos").alias("line"), F.min("pos").alias("pos")).first()
    names = [n.strip().lower() for n in next(csv.reader([head.line or ""]), [])]
    if required not in names:
        raise ValueError(f"the file has no column {required}")
    # The parser takes a new buffer for every line: one of the size of a line, as by default it is 2 MB. Longer lines refill it.
    cells = F.from_csv(line, F.lit(", ".join(f"c{i} string" for i in range(len(names)))), {"mode": "PERMISSIVE", "escape": '"', "inputBufferSize": str(LINE_BUFFER)})
    rows = body.where(F.col("pos") > head.pos).select("pos", F.explode(F.array(cells)).alias("cells"))
    return rows.select("pos", *(F.col(f"cells.c{i}").alias(n) for i, n in enumerate(names) if n not in names[:i]))


def scanner_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rows of a wardriving file given by its lines (pos, line); columns that it lacks are null."""
    names = ["mac", "ssid", "authmode", "firstseen", "channel", "rssi", "currentlatitude", "currentlongitude", "altitudemeters", "accuracymeters", "type"]
    rows = csv_rows(lines, "mac", line)
    return rows.select("pos", *(F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names))


#: The format of snapshots, and names that their files may have.
SNAPSHOT_FORMAT, SNAPSHOT_FILE = 1, r"^[A-Za-z0-9_-][A-Za-z0-9._-]*$"


def manifests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """bodies with the manifest parsed from JSON (m) and the first rule that it breaks (problem; null where it is fine)."""
    m = F.from_json(body, "format int, file string, sha256 string, bytes long, elements long, generated_at long")
    rows = bodies.withColumn("m", m)
    file, digest = F.coalesce("m.file", F.lit("")), F.coalesce("m.sha256", F.lit(""))
    broken = F.coalesce("m.format", "m.elements").isNull() & F.col("m.file").isNull()
    problem = F.when(broken, "json").when(F.coalesce("m.format", F.lit(-1)) != SNAPSHOT_FORMAT, "format").when(~file.rlike(SNAPSHOT_FILE), "file").when(~digest.rlike("^[0-9A-Fa-f]{64}$"), "sha256").when(F.coalesce("m.elements", F.lit(0)) <= 0, "elements")
    return rows.withColumn("problem", problem)


def _inflate(data: bytes | None) -> str | None:
    try:
        return None if data is None else gzip.decompress(data).decode()
    except (OSError, EOFError, UnicodeDecodeError, zlib.error):
        return None


def inflated(content: Column) -> Column:
    """The text of a gzip file; null where it is broken."""

    @F.pandas_udf("string")
    def inflate(files: pd.Series) -> pd.Series:
        return files.map(_inflate)

    return inflate(content)


def deflated(text: Column) -> Column:
    """A text as a gzip file."""

    @F.pandas_udf("binary")
    def deflate(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else gzip.compress(t.encode(), mtime=0))

    return deflate(text)


def decoded(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows (path, body, reason) of gzip files (path, content): the text of those that the manifest confirms, else why not."""
    rows = files.join(verified(files, manifest), "path")
    rows = rows.select("path", F.when(F.col("ok"), F.col("content")).alias("content"), "reason").withColumn("body", inflated(F.col("content")))
    return rows.select("path", "body", F.coalesce("reason", F.when(F.col("body").isNull(), "gzip")).alias("reason"))
