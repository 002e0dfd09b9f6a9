"""Geometry on points: struct<lng: double, lat: double>, with an optional z. Column arithmetic only."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import QueryError
from quillon.functions.registry import Scope, need, register

#: Radius of the sphere, and the axes of the WGS 84 spheroid, in metres.
SPHERE_RADIUS = 6370986.0
MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563


def point_of(options: dict) -> tuple[float, float]:
    """lng, lat of {lat, lng}, {geojson} or {text: "POINT(x y)"}."""
    if "lat" in options and "lng" in options:
        return float(options["lng"]), float(options["lat"])
    if options.get("geojson"):
        made = options["geojson"] if isinstance(options["geojson"], dict) else json.loads(options["geojson"])
        if made.get("type") == "Point":
            return float(made["coordinates"][0]), float(made["coordinates"][1])
    found = re.fullmatch(r"(?:SRID=\d+;)?\s*POINT\s*\(\s*(\S+)\s+(\S+)\s*\)", options.get("text", ""), re.I)
    if not found:
        raise QueryError(f"Expecting lat and lng, a Point geojson or a POINT text, got {options!r}")
    return float(found[1]), float(found[2])


def haversine(lng: Column, lat: Column, x: float, y: float) -> Column:
    a, b = F.radians(lat), F.radians(F.lit(y))
    half = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(F.lit(x)) - F.radians(lng)) / 2), 2)
    return 2 * SPHERE_RADIUS * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def spheroid(lng: Column, lat: Column, x: float, y: float) -> Column:
    """Andoyer-Lambert's first-order correction of the great circle."""
    lng1, lat1, lng2, lat2 = F.radians(lng), F.radians(lat), F.radians(F.lit(x)), F.radians(F.lit(y))
    b1, b2 = F.atan((1 - FLATTENING) * F.tan(lat1)), F.atan((1 - FLATTENING) * F.tan(lat2))
    half = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin((lng2 - lng1) / 2), 2)
    angle = 2 * F.asin(F.sqrt(F.least(half, F.lit(1.0))))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    first = (angle - F.sin(angle)) * F.pow(F.sin(p) * F.cos(q) / F.cos(angle / 2), 2)
    second = (angle + F.sin(angle)) * F.pow(F.cos(p) * F.sin(q) / F.sin(angle / 2), 2)
    return F.when(angle == 0, 0.0).otherwise(MAJOR * (angle - FLATTENING / 2 * (first + second)))


def planar(lng: Column, lat: Column, x: float, y: float) -> Column:
    return F.hypot(lng - x, lat - y)


def axes(scope: Scope, args: list, name: str) -> tuple[Column, Column]:
    need(args, 1, name)
    point = scope.col(args[0])
    return point["lng"], point["lat"]


@register("$ST_DWithin", filterable=True, single=False)
def dwithin(scope: Scope, args: list) -> Column:
    need(args, 2, "$ST_DWithin")
    options = args[1]
    if not isinstance(options.get("distance"), (int, float)):
        raise QueryError("$ST_DWithin expects a distance")
    if options.get("unit", "m") not in ("m", "km"):
        raise QueryError("unit must be m or km")
    metres = options["distance"] * (1000 if options.get("unit") == "km" else 1)
    return haversine(*axes(scope, args, "$ST_DWithin"), *point_of(options)) <= metres


for _name, _measure in {"$<->": planar, "$ST_Distance": planar, "$ST_DistanceSphere": haversine, "$ST_DistanceSpheroid": spheroid}.items():

    def _distance(scope: Scope, args: list, measure=_measure, name=_name) -> Column:
        need(args, 2, name)
        return measure(*axes(scope, args, name), *point_of(args[1]))

    register(_name, single=False)(_distance)


def number(x: Column) -> Column:
    """Without a fraction that is zero."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def wkt(scope: Scope, args: list) -> Column:
    x, y = axes(scope, args, "$ST_AsText")
    return F.concat(F.lit("POINT("), number(x), F.lit(" "), number(y), F.lit(")"))


def geojson(x: Column, y: Column) -> Column:
    return F.concat(F.lit('{"type":"Point","coordinates":['), number(x), F.lit(","), number(y), F.lit("]}"))


register("$ST_AsText")(wkt)
register("$ST_AsEWKT")(lambda scope, args: F.concat(F.lit("SRID=4326;"), wkt(scope, args)))


@register("$ST_AsGeoJSON")
def as_geojson(scope: Scope, args: list) -> Column:
    return geojson(*axes(scope, args, "$ST_AsGeoJSON"))


@register("$ST_Centroid")
def centroid(scope: Scope, args: list) -> Column:
    return geojson(*axes(scope, args, "$ST_Centroid"))


@register("$ST_Simplify", single=False)
def simplify(scope: Scope, args: list) -> Column:
    return geojson(*axes(scope, args, "$ST_Simplify"))


@register("$ST_SnapToGrid", single=False)
def snap(scope: Scope, args: list) -> Column:
    need(args, 2, "$ST_SnapToGrid")
    x, y = axes(scope, args, "$ST_SnapToGrid")
    return geojson(F.rint(x / args[1]) * args[1], F.rint(y / args[1]) * args[1])


def sexagesimal(value: Column, positive: str, negative: str) -> Column:
    size = F.abs(value)
    degrees, rest = F.floor(size), size - F.floor(size)
    minutes = F.floor(rest * 60)
    seconds = F.round((rest * 60 - minutes) * 60, 3)
    return F.concat(degrees.cast("string"), F.lit("°"), minutes.cast("string"), F.lit("'"), F.format_string("%.3f", seconds), F.lit('"'), F.when(value < 0, negative).otherwise(positive))


@register("$st_aslatlontext")
def lat_lon_text(scope: Scope, args: list) -> Column:
    x, y = axes(scope, args, "$st_aslatlontext")
    return F.concat(sexagesimal(y, "N", "S"), F.lit(" "), sexagesimal(x, "E", "W"))


register("$ST_X")(lambda scope, args: axes(scope, args, "$ST_X")[0])
register("$ST_Y")(lambda scope, args: axes(scope, args, "$ST_Y")[1])
register("$ST_Z")(lambda scope, args: scope.col(args[0])["z"])
register("$ST_Length")(lambda scope, args: F.when(scope.col(args[0]).isNotNull(), 0.0))


@register("$ST_AsBinary")
def as_binary(scope: Scope, args: list) -> Column:
    """Well-known binary: byte order, type 1, and both coordinates, little-endian."""
    import struct

    import pandas as pd

    @F.pandas_udf("binary")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([struct.pack("<BIdd", 1, 1, a, b) if a == a and b == b else None for a, b in zip(x, y)])

    return run(*axes(scope, args, "$ST_AsBinary"))


for _name in ("$ST_AsEWKB", "$ST_AsMVT", "$ST_AsMVTGeom"):

    def _refused(scope: Scope, args: list, name=_name) -> Column:
        raise QueryError(f"{name} is not supported")

    register(_name)(_refused)


def extent(scope: Scope, args: list, name: str) -> Column:
    x, y = axes(scope, args, name)
    return F.when(F.count(x) > 0, F.concat(F.lit("BOX("), number(F.min(x)), F.lit(" "), number(F.min(y)), F.lit(","), number(F.max(x)), F.lit(" "), number(F.max(y)), F.lit(")")))


register("$ST_Extent", kind="aggregation")(lambda scope, args: extent(scope, args, "$ST_Extent"))


@register("$ST_3DExtent", kind="aggregation")
def extent_3d(scope: Scope, args: list) -> Column:
    x, y = axes(scope, args, "$ST_3DExtent")
    z = scope.col(args[0])["z"] if "z" in scope.dtype(args[0]).names else F.lit(0.0)
    low = F.concat_ws(" ", number(F.min(x)), number(F.min(y)), number(F.min(z)))
    high = F.concat_ws(" ", number(F.max(x)), number(F.max(y)), number(F.max(z)))
    return F.when(F.count(x) > 0, F.concat(F.lit("BOX3D("), low, F.lit(","), high, F.lit(")")))


for _axis, _field in (("X", "lng"), ("Y", "lat"), ("Z", "z")):
    for _end, _make in (("Min", F.min), ("Max", F.max)):

        def _edge(scope: Scope, args: list, field=_field, make=_make) -> Column:
            return make(scope.col(args[0])[field])

        register(f"$ST_{_axis}{_end}_Agg", kind="aggregation")(_edge)
