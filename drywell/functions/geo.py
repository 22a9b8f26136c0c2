"""Points on the sphere and on grids: distances, the equal-area projection, grid positions and weights."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def sphere(lon: Column, lat: Column) -> list[Column]:
    """x, y, z in km; chords are never longer than great circles, so neighbours within d lie in cells of size d that touch."""
    lam, phi = F.radians(lon), F.radians(lat)
    return [EARTH_KM * F.cos(phi) * F.cos(lam), EARTH_KM * F.cos(phi) * F.sin(lam), EARTH_KM * F.sin(phi)]


def arc_km(chord: Column) -> Column:
    return 2 * EARTH_KM * F.asin(F.least(chord / (2 * EARTH_KM), F.lit(1.0)))


def albers(lon: Column, lat: Column, lat1: float = 25, lat2: float = 47, lat0: float = 35, lon0: float = 105) -> tuple[Column, Column]:
    """Albers equal-area conic on the WGS84 ellipsoid, in metres (the published closed form)."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def area(s: float) -> float:
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def reach(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

    p1, p2, p0 = map(math.radians, (lat1, lat2, lat0))
    n = (reach(p1) ** 2 - reach(p2) ** 2) / (area(math.sin(p2)) - area(math.sin(p1))) if lat1 != lat2 else math.sin(p1)
    c = reach(p1) ** 2 + n * area(math.sin(p1))
    rho0 = a * math.sqrt(c - n * area(math.sin(p0))) / n
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = a * F.sqrt(F.lit(c) - n * q) / n
    theta = n * F.radians(lon - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def grid_plan(position: Column, n: int) -> dict[str, Column]:
    """nearest index, low index and weight of the high one, for a position in index units on an axis of n; outside it clamps."""
    low = F.least(F.greatest(F.floor(position), F.lit(0)), F.lit(max(n - 2, 0))).cast("int")
    return {
        "nearest": F.least(F.greatest(F.rint(position), F.lit(0.0)), F.lit(float(n - 1))).cast("int"),
        "low": low,
        "weight": F.least(F.greatest(position - low, F.lit(0.0)), F.lit(1.0)),
    }


def axis_position(value: Column, axis: list[float]) -> Column:
    """The place of a value on an axis of ascending or descending coordinates, in index units; outside it goes on at the end's step.

    Even axes by their first step, others by a binary search between neighbours.
    """
    axis = [float(x) for x in axis]
    steps = [b - a for a, b in zip(axis, axis[1:])]
    if not steps:
        return value * 0.0
    if not (all(s > 0 for s in steps) or all(s < 0 for s in steps)):
        raise ValueError("coordinates of an axis go one way")
    if max(abs(s - steps[0]) for s in steps) <= 1e-4 * abs(steps[0]):
        return (value - axis[0]) / steps[0]
    sign = 1.0 if steps[0] > 0 else -1.0
    held, x = F.array(*(F.lit(sign * a) for a in axis)), value * sign
    halves = F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(len(axis))))))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(axis) - 1).alias("high"))

    def half(now: Column, _: Column) -> Column:
        middle = F.floor((now["low"] + now["high"]) / 2).cast("int")
        inner, right = now["high"] - now["low"] > 1, F.get(held, middle) <= x
        return F.struct(F.when(inner & right, middle).otherwise(now["low"]).alias("low"), F.when(inner & ~right, middle).otherwise(now["high"]).alias("high"))

    low = F.aggregate(halves, start, half)["low"]
    return low + (x - F.get(held, low)) / (F.get(held, low + 1) - F.get(held, low))


#: Homolosine: below this latitude the sinusoidal, above it the Mollweide projection, moved by a constant.
GOODE_SPLIT = math.radians(40 + 44 / 60 + 11.8 / 3600)
GOODE_SHIFT = 0.0528035274542
GOODE_RADIUS = 6378137.0


def goode_centre(lon: Column, lat: Column) -> Column:
    """Central meridian, in degrees, of the lobe that a place lies in (land interruptions)."""
    north = F.when(lon < -40, F.lit(-100.0)).otherwise(F.lit(30.0))
    south = F.when(lon < -100, F.lit(-160.0)).when(lon < -20, F.lit(-60.0)).when(lon < 80, F.lit(20.0)).otherwise(F.lit(140.0))
    return F.when(lat >= 0, north).otherwise(south)


def goode(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Interrupted homolosine x and y in metres on the sphere."""
    phi, centre = F.radians(lat), goode_centre(lon, lat)
    d = F.radians(lon - centre)
    # Newton's steps for the auxiliary angle t: 2t + sin 2t = pi sin(phi), as u = 2t.
    want = F.lit(math.pi) * F.sin(phi)
    u = F.aggregate(F.sequence(F.lit(1), F.lit(25)), 2 * phi, lambda u, _: u - (u + F.sin(u) - want) / F.greatest(1 + F.cos(u), F.lit(1e-12)))
    t = u / 2
    low = F.abs(phi) <= GOODE_SPLIT
    x = F.when(low, d * F.cos(phi)).otherwise(2 * math.sqrt(2) / math.pi * d * F.cos(t))
    y = F.when(low, phi).otherwise(math.sqrt(2) * F.sin(t) - GOODE_SHIFT * F.signum(phi))
    return GOODE_RADIUS * (F.radians(centre) + x), GOODE_RADIUS * y


def goode_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a place in the interrupted homolosine projection; null outside its lobes."""
    x, y = x / GOODE_RADIUS, y / GOODE_RADIUS
    low = F.abs(y) <= GOODE_SPLIT
    s = F.least(F.greatest((y + GOODE_SHIFT * F.signum(y)) / math.sqrt(2), F.lit(-1.0)), F.lit(1.0))
    t = F.asin(s)
    phi = F.when(low, y).otherwise(F.asin(F.least(F.greatest((2 * t + F.sin(2 * t)) / math.pi, F.lit(-1.0)), F.lit(1.0))))
    lon = F.degrees(x)
    centre = goode_centre(lon, y)
    width = F.when(low, F.cos(phi)).otherwise(2 * math.sqrt(2) / math.pi * F.cos(t))
    found = centre + F.degrees((x - F.radians(centre)) / F.nullif(width, F.lit(0.0)))
    inside = (goode_centre(found, y) == centre) & found.between(-180.0, 180.0)
    return F.when(inside, found), F.when(inside, F.degrees(phi))
