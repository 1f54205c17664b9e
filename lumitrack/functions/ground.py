"""Ground systems: map projections and their inverses as column expressions, so that changes of system stay in the JVM.

A system is geographic degrees, the sphere's Mercator, the sphere's sinusoidal, or the ellipsoid's transverse Mercator by
the Krüger series in the third flattening, to its fourth power (below a millimetre within 30 degrees of the middle
meridian). Places that a system can't show (the poles in Mercator, beyond 90 degrees of a transverse middle meridian, off
the sinusoidal's outline) are null, as are those with a null or non-finite coordinate.

Longitudes come out within [-180, 180), or within 180 degrees of ``around`` where that is given: a raster's own middle, say,
so that one that crosses the date line stays in one piece.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumitrack.functions.geo import wrap_degrees
from lumitrack.functions.numbers import finite

#: The ellipsoid and the spheres of the systems in metres (fixed values).
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SINUSOIDAL_RADIUS = 6371007.181
#: What of the sphere the Mercator system shows, in degrees.
MERCATOR_LATITUDE = 89.9

Place = tuple[Column, Column]


@dataclass(frozen=True)
class System:
    """``forward`` takes (lon, lat) in degrees to (x, y), ``inverse`` back; ``is_geographic`` where x is a longitude."""

    name: str
    forward: Callable[[Column, Column], Place]
    inverse: Callable[[Column, Column], Place]
    is_geographic: bool = field(default=False)


def _where(good: Column, place: Place) -> Place:
    return tuple(F.when(good, c) for c in place)


def geographic() -> System:
    return System("geographic", lambda lon, lat: (lon, lat), lambda x, y: (x, y), True)


def mercator(radius: float = SEMI_MAJOR) -> System:
    """Mercator on a sphere."""
    r = F.lit(radius)

    def forward(lon: Column, lat: Column) -> Place:
        return _where(finite(lon, lat) & (F.abs(lat) <= MERCATOR_LATITUDE), (r * F.radians(lon), r * F.asinh(F.tan(F.radians(lat)))))

    return System("mercator", forward, lambda x, y: _where(finite(x, y), (F.degrees(x / r), F.degrees(F.atan(F.sinh(y / r))))))


def sinusoidal(radius: float = SINUSOIDAL_RADIUS, middle: float = 0.0, beyond_poles: bool = False) -> System:
    """Equal areas on a sphere, as grids of satellite products have it.

    With ``beyond_poles`` its formula also takes latitudes above 90 degrees to the plane, as grids of rasters whose mapping
    runs past a pole have them; such places have no way back.
    """
    r = F.lit(radius)

    def forward(lon: Column, lat: Column) -> Place:
        shown = finite(lon, lat) if beyond_poles else finite(lon, lat) & (F.abs(lat) <= 90.0)
        return _where(shown, (r * F.radians(wrap_degrees(lon - middle)) * F.cos(F.radians(lat)), r * F.radians(lat)))

    def inverse(x: Column, y: Column) -> Place:
        off = F.degrees(F.try_divide(x, r * F.cos(y / r)))
        lon = F.when(F.abs(x) < 1e-6, F.lit(0.0)).otherwise(off)
        return _where(finite(x, y) & (F.abs(F.degrees(y / r)) <= 90.0) & (F.abs(lon) <= 180.0), (lon + F.lit(middle), F.degrees(y / r)))

    return System("sinusoidal", forward, inverse)


def _series(n: float) -> tuple[list[float], list[float], list[float]]:
    """Coefficients in the third flattening: plane from sphere, sphere from plane, and latitude from conformal latitude (fixed values)."""
    rows = [
        [(1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280)],
        [(1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280)],
        [(2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630)],
    ]
    return tuple([sum(c * n ** (k + 1) for k, c in enumerate(row)) for row in table] for table in rows)


def transverse_mercator(middle: Column | float, scale: float = 1.0, false_x: float = 0.0, false_y: Column | float = 0.0, semi_major: float = SEMI_MAJOR, flattening: float = FLATTENING) -> System:
    """Transverse Mercator about a middle meridian, which may be a column: each row its own."""
    n = flattening / (2 - flattening)
    unit = F.lit(scale * semi_major / (1 + n) * (1 + n**2 / 4 + n**4 / 64))
    to_plane, to_sphere, to_latitude = _series(n)
    middle = middle if isinstance(middle, Column) else F.lit(middle)
    false_y = false_y if isinstance(false_y, Column) else F.lit(false_y)
    e = F.lit(2 * n**0.5 / (1 + n))

    def total(coefficients: list[float], a: Column, b: Column | None, f, g) -> Column:
        terms = [F.lit(c) * f(F.lit(2.0 * (j + 1)) * a) * (g(F.lit(2.0 * (j + 1)) * b) if b is not None else 1.0) for j, c in enumerate(coefficients)]
        return terms[0] + terms[1] + terms[2] + terms[3]

    def forward(lon: Column, lat: Column) -> Place:
        off, s = F.radians(wrap_degrees(lon - middle)), F.sin(F.radians(lat))
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))  # the tangent of the conformal latitude
        a, b = F.atan2(t, F.cos(off)), F.asinh(F.sin(off) / F.sqrt(t * t + F.cos(off) * F.cos(off)))
        x, y = b + total(to_plane, a, b, F.cos, F.sinh), a + total(to_plane, a, b, F.sin, F.cosh)
        good = finite(lon, lat, middle) & (F.abs(lat) < 90.0) & (F.abs(off) < F.radians(F.lit(90.0)))
        return _where(good, (F.lit(false_x) + unit * x, false_y + unit * y))

    def inverse(x: Column, y: Column) -> Place:
        a, b = (y - false_y) / unit, (x - F.lit(false_x)) / unit
        a, b = a - total(to_sphere, a, b, F.sin, F.cosh), b - total(to_sphere, a, b, F.cos, F.sinh)
        c = F.asin(F.sin(a) / F.cosh(b))
        lat = c + total(to_latitude, c, None, F.sin, None)
        return _where(finite(x, y, middle), (middle + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(lat)))

    return System("transverse_mercator", forward, inverse)


def utm_zone(lon: Column) -> Column:
    """The zone of a longitude, 1 to 60, without the exceptions about Norway."""
    return (F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 6.0) + 1).cast("int")


def utm(zone: Column | int, south: Column | bool = False) -> System:
    """A zone's system; zone and hemisphere may be columns."""
    zone = zone if isinstance(zone, Column) else F.lit(zone)
    south = south if isinstance(south, Column) else F.lit(south)
    return transverse_mercator(zone.cast("double") * 6.0 - 183.0, 0.9996, 500_000.0, F.when(south, F.lit(10_000_000.0)).otherwise(F.lit(0.0)))


def changed(x: Column, y: Column, source: System, target: System, around: Column | None = None) -> Place:
    """A place of one system in another."""
    lon, lat = source.inverse(x, y)
    u, v = target.forward(lon, lat)
    if not target.is_geographic:
        return u, v
    return (wrap_degrees(u) if around is None else around + wrap_degrees(u - around)), v
