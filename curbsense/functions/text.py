"""Scalar functions on texts, times and directions; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curbsense.constants import CARDINALS, CLASS_KMH, CONE_WIDTH, CONES, MPH_KMH, SPEED_RANGE_KMH


def classify(tags: Column) -> Column:
    """flock where a maker's tag names it, alpr where the type says so, else unknown."""
    names = [F.coalesce(F.lower(F.element_at(tags, k)).contains("flock"), F.lit(False)) for k in ("brand", "manufacturer", "operator")]
    return F.when(names[0] | names[1] | names[2], "flock").when(F.upper(F.element_at(tags, "surveillance:type")) == "ALPR", "alpr").otherwise("unknown")


def mac_normalize(mac: Column) -> Column:
    """AA:BB:CC:DD:EE:FF of twelve hexadecimal digits, whatever stands between them; else null."""
    others = F.translate(mac, "0123456789ABCDEFabcdef", "")
    digits = F.upper(F.call_function("translate", mac, others, F.lit("")))
    return F.when(F.length(digits) == 12, F.concat_ws(":", *(F.substring(digits, i, 2) for i in range(1, 12, 2))))


#: Fixed value: names of the makers' networks.
SSID = r"(?i)^(flock|flock-[0-9a-f]{4,6}|flock\d{3}|flock camera net\.?)$"


def ssid_match(ssid: Column) -> Column:
    return F.coalesce(F.trim(ssid).rlike(SSID), F.lit(False))


def wifi_age(stamp: Column, now: int) -> Column:
    """Whole days since midnight (UTC) of the date that a stamp starts with; null where it starts with none."""
    day = F.unix_timestamp(F.try_to_timestamp(F.substring(stamp, 1, 10), F.lit("yyyy-MM-dd")))
    return ((F.lit(now) - day) / 86400).cast("long")


def maxspeed(text: Column) -> Column:
    """A speed limit in whole km/h: the first of a list, mph converted; null where it is unusable or out of range."""
    first = F.trim(F.split(text, ";")[0])
    number = F.trim(F.regexp_replace(first, "(mph)+$", "")).try_cast("double")
    kmh = F.when(first.endswith("mph"), number * MPH_KMH).otherwise(number)
    return F.when(kmh.between(*SPEED_RANGE_KMH), F.round(kmh).cast("int"))


def class_kmh(highway: Column) -> Column:
    """The assumed speed of a road class; null where cars are not routed on it."""
    out = F.lit(None).cast("int")
    for name, kmh in reversed(CLASS_KMH.items()):
        out = F.when(highway == name, kmh).otherwise(out)
    return out


def format_ago(seconds: Column, now: int) -> Column:
    age = F.greatest(F.lit(0), F.lit(now) - seconds)
    part = lambda n, unit: F.concat(F.floor(age / n).cast("string"), F.lit(f" {unit} ago"))
    return F.when(seconds.isNull() | (seconds == 0), "never").when(age < 60, "just now").when(age < 3600, part(60, "min")).when(age < 86400, part(3600, "h")).otherwise(part(86400, "d"))


def compass_label(degrees: Column) -> Column:
    """The nearest of eight points with the degrees, as NE (45°)."""
    points = F.array(*map(F.lit, CARDINALS[::2]))
    at = F.floor(F.pmod(degrees, F.lit(360)) / 45 + 0.5) % 8
    return F.when(degrees.isNotNull(), F.concat(F.get(points, at.cast("int")), F.lit(" ("), degrees.cast("string"), F.lit("°)")))


def _bearing(text: Column) -> Column:
    t = F.trim(text)
    at = F.array_position(F.array(*map(F.lit, CARDINALS)), F.upper(t))
    return F.when(t.rlike(r"^-?\d+(\.\d+)?$"), F.pmod(t.try_cast("double"), F.lit(360.0))).when(at > 0, (at - 1) * 22.5)


def direction_cones(raw: Column) -> Column:
    """array of struct(bearing, width): views of a direction tag; lists by semicolon, clockwise ranges by hyphen.

    Parts that are no direction are skipped, near-equal ones dropped, and the first CONES kept.
    """

    def cone(part: Column) -> Column:
        p = F.trim(part)
        ranged = r"^(.+?)\s*-\s*(.+)$"
        a, b = _bearing(F.regexp_extract(p, ranged, 1)), _bearing(F.regexp_extract(p, ranged, 2))
        width = F.pmod(b - a, F.lit(360.0))
        make = lambda bearing, w: F.struct(bearing.cast("double").alias("bearing"), w.cast("double").alias("width"))
        single = _bearing(p)
        of_range = F.when(a.isNotNull() & b.isNotNull(), F.when(width == 0, make(a, F.lit(CONE_WIDTH))).otherwise(make(F.pmod(a + width / 2, F.lit(360.0)), width)))
        return F.when(p.rlike(ranged), of_range).when(single.isNotNull(), make(single, F.lit(CONE_WIDTH)))

    def add(kept: Column, new: Column) -> Column:
        same = F.exists(kept, lambda k: (F.abs(k["bearing"] - new["bearing"]) < 0.5) & (k["width"] == new["width"]))
        return F.when(new.isNull() | same | (F.size(kept) >= CONES), kept).otherwise(F.array_append(kept, new))

    empty = F.array().cast("array<struct<bearing:double,width:double>>")
    return F.coalesce(F.aggregate(F.transform(F.split(raw, ";"), cone), empty, add), empty)


def format_direction(raw: Column) -> Column:
    """A direction tag to read: E (90°); lists and ranges keep the tag as well, and what is no direction stays as it is."""
    cones = direction_cones(raw)
    labels = F.array_join(F.transform(cones, lambda c: compass_label((F.floor(c["bearing"] + 0.5) % 360).cast("int"))), ", ")
    return F.when(F.size(cones) == 0, raw).when(F.trim(raw).rlike(r"^\d+$"), labels).otherwise(F.concat(labels, F.lit(" · "), raw))


def csv_escape(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def xml_escape(text: Column) -> Column:
    """The five characters that XML reserves, the ampersand first."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text
