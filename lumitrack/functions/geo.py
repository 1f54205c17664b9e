"""Angles, distances on the sphere, and affine pixel mappings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radii in km (fixed values): the mean one for distances, the rounded one for scenes.
MEAN_RADIUS_KM = 6371.0088
SCENE_RADIUS_KM = 6371.0


def wrap_degrees(x: Column) -> Column:
    """An angle in degrees within [-180, 180)."""
    return F.pmod(x + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def angle_between(a: Column, b: Column) -> Column:
    """a - b on the circle, within [-180, 180)."""
    return wrap_degrees(a - b)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = MEAN_RADIUS_KM) -> Column:
    """The distance over the sphere; null where a coordinate is."""
    half_lat = F.radians(lat2 - lat1) / F.lit(2.0)
    half_lon = F.radians(wrap_degrees(lon2 - lon1)) / F.lit(2.0)
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()  # greatest() would make 0 of null
    return F.when(known, F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)))))


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def to_xyz(lat: Column, lon: Column, alt_km: Column, scene_radius: float) -> Column:
    """Spherical Cartesian coordinates in a scene where the Earth has the radius ``scene_radius``."""
    r = F.lit(scene_radius) + alt_km * F.lit(scene_radius / SCENE_RADIUS_KM)
    la, lo = F.radians(lat), F.radians(lon)
    return point(r * F.cos(la) * F.cos(lo), r * F.cos(la) * F.sin(lo), r * F.sin(la))


def to_geographic(p: Column, scene_radius: float) -> Column:
    """struct(lat, lon, alt_km) of a scene point."""
    r = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"])
    lat, lon = F.degrees(F.asin(p["z"] / r)), F.degrees(F.atan2(p["y"], p["x"]))
    return F.struct(lat.alias("lat"), lon.alias("lon"), ((r - F.lit(scene_radius)) / F.lit(scene_radius) * F.lit(SCENE_RADIUS_KM)).alias("alt_km"))


def pixel_to_geo(px: Column, py: Column, gt: list[Column]) -> Column:
    """struct(x, y) of a pixel under the six terms of an affine mapping."""
    return F.struct((gt[0] + px * gt[1] + py * gt[2]).alias("x"), (gt[3] + px * gt[4] + py * gt[5]).alias("y"))


def geo_to_pixel(x: Column, y: Column, gt: list[Column]) -> Column:
    """struct(col, row) of the pixel that holds a place: towards zero, and without the shear terms."""
    return F.struct(((x - gt[0]) / gt[1]).cast("int").alias("col"), ((y - gt[3]) / gt[5]).cast("int").alias("row"))


def bearing_degrees(east: Column, north: Column) -> Column:
    """Clockwise from north, within [0, 360)."""
    return F.pmod(F.degrees(F.atan2(east, north)) + F.lit(360.0), F.lit(360.0))


def local_axes(lat: Column, lon: Column) -> Column:
    """struct(east, north, up) of unit vectors at a place."""
    la, lo = F.radians(lat), F.radians(lon)
    east = point(-F.sin(lo), F.cos(lo), F.lit(0.0))
    north = point(-F.sin(la) * F.cos(lo), -F.sin(la) * F.sin(lo), F.cos(la))
    up = point(F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))
    return F.struct(east.alias("east"), north.alias("north"), up.alias("up"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return point(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def scaled(a: Column, k: Column) -> Column:
    return point(a["x"] * k, a["y"] * k, a["z"] * k)


def added(a: Column, b: Column) -> Column:
    return point(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def unit(a: Column) -> Column:
    return scaled(a, F.lit(1.0) / F.sqrt(dot(a, a)))


def turned(v: Column, axis: Column, degrees: Column) -> Column:
    """``v`` turned about the unit vector ``axis`` (Rodrigues); columns, as an expression would be repeated for each use."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return added(added(scaled(v, c), scaled(cross(axis, v), s)), scaled(axis, dot(axis, v) * (F.lit(1.0) - c)))
