"""Compact binary forms of ways and camera tables, for exchange; at rest both are Parquet."""

from __future__ import annotations

import gzip
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _varints(numbers: np.ndarray) -> bytes:
    out = bytearray()
    for n in numbers.tolist():
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
    return bytes(out)


def _numbers(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for b in data:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(value)
            value = shift = 0
    return out


def pack_ways(ways: DataFrame) -> DataFrame:
    """Rows (tile, data): the ways of each tile, from rows (tile, way, direction, kmh, pos, lat_e7, lon_e7)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        numbers = []
        for (way, direction, kmh), points in pdf.sort_values(["way", "pos"]).groupby(["way", "direction", "kmh"], sort=True):
            at = points[["lat_e7", "lon_e7"]].to_numpy(np.int64)
            steps = np.diff(at, axis=0, prepend=np.zeros((1, 2), np.int64)).ravel()
            numbers += [way, direction + 1, kmh, len(at), *((steps << 1) ^ (steps >> 63)).tolist()]
        return pd.DataFrame({"tile": [pdf["tile"].iloc[0]], "data": [gzip.compress(_varints(np.array(numbers, dtype=np.int64)), mtime=0)]})

    return ways.groupBy("tile").applyInPandas(run, "tile long, data binary")


#: Rows after which unpacked ways are given out.
ROWS = 50_000


def _unpacked(batches, most: int = ROWS):
    """Frames of the points of packed tiles, each with those of no more tiles than it takes to have `most` rows."""
    names = ["tile", "way", "direction", "kmh", "pos", "lat_e7", "lon_e7"]
    parts, rows = [], 0
    for pdf in batches:
        for tile, data in pdf[["tile", "data"]].itertuples(index=False):
            numbers, i = np.array(_numbers(gzip.decompress(data)), dtype=np.int64), 0
            while i < len(numbers):
                way, direction, kmh, n = numbers[i : i + 4]
                z = numbers[i + 4 : i + 4 + 2 * n]
                at = ((z >> 1) ^ -(z & 1)).reshape(-1, 2).cumsum(axis=0)
                parts.append(np.column_stack([np.tile([tile, way, direction - 1, kmh], (n, 1)), np.arange(n), at]))
                rows += n
                i += 4 + 2 * n
            if rows >= most:
                yield pd.DataFrame(np.concatenate(parts), columns=names)
                parts, rows = [], 0
    if parts:
        yield pd.DataFrame(np.concatenate(parts), columns=names)


def unpack_ways(tiles: DataFrame) -> DataFrame:
    """Rows (tile, way, direction, kmh, pos, lat_e7, lon_e7) of packed tiles."""
    return tiles.mapInPandas(_unpacked, "tile long, way long, direction int, kmh int, pos int, lat_e7 int, lon_e7 int")


#: The point format's mark, and its columns in order (number kinds; 29 bytes a point).
MARK, COLUMNS = b"FFP1", (("lon", "<f8"), ("lat", "<f8"), ("osm_id", "<f8"), ("operator", "<u4"), ("flags", "u1"))


def pack_points(points: DataFrame) -> DataFrame:
    """Rows (part, data): points (part, osm_id, lat, lon, flags, operator, direction) column by column, in order of osm_id.

    A header has the mark and two counts. Operators are numbers (0 for none) into a list at the end,
    where directions are named by their point's place.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("osm_id").reset_index(drop=True)
        told = p["operator"].where(p["operator"].fillna("").str.strip() != "")
        names = list(dict.fromkeys(told.dropna()))
        columns = p.assign(operator=told.map({n: i + 1 for i, n in enumerate(names)}).fillna(0))
        meta = {"operators": names, "directions": [[i, d] for i, d in enumerate(p["direction"]) if isinstance(d, str) and d.strip()]}
        meta = json.dumps(meta, ensure_ascii=False).encode()
        body = b"".join(columns[c].to_numpy(k).tobytes() for c, k in COLUMNS)
        head = MARK + np.array([len(p), len(meta), 0], "<u4").tobytes()
        return pd.DataFrame({"part": [p["part"].iloc[0]], "data": [head + body + bytes(-len(head + body) % 4) + meta]})

    return points.groupBy("part").applyInPandas(run, "part long, data binary")


def unpack_points(parts: DataFrame) -> DataFrame:
    """Rows (osm_id, lat, lon, flags, operator, direction) of packed parts; raises ValueError without the mark."""

    def run(batches):
        for pdf in batches:
            for data in pdf["data"]:
                if data[:4] != MARK:
                    raise ValueError("not a file of points")
                n, size, _ = np.frombuffer(data, "<u4", 3, 4).tolist()
                at, out = 16, {}
                for name, kind in COLUMNS:
                    out[name] = np.frombuffer(data, kind, n, at)
                    at += n * np.dtype(kind).itemsize
                meta = json.loads(data[len(data) - size :].decode()) if size else {"operators": [], "directions": []}
                names, directions = [None, *meta["operators"]], dict(meta["directions"])
                yield pd.DataFrame({"osm_id": out["osm_id"].astype("int64"), "lat": out["lat"], "lon": out["lon"], "flags": out["flags"].astype("int32"), "operator": [names[i] for i in out["operator"]], "direction": [directions.get(i) for i in range(n)]})

    return parts.mapInPandas(run, "osm_id long, lat double, lon double, flags int, operator string, direction string")


def tiled(ways: DataFrame) -> DataFrame:
    """ways with the number of the 0.1 degree tile that their first point lies in."""
    first = ways.where("pos = 0").select("way", (F.floor(F.col("lat_e7") / 1_000_000) * 10_000 + F.floor(F.col("lon_e7") / 1_000_000)).alias("tile"))
    return ways.join(first, "way")
