"""Spherical and planar geometry as expressions over plain coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_M = 6_371_008.8
M_PER_LON, M_PER_LAT = 111_320.0, 110_540.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def local_xy(lon: Column, lat: Column, at_lat: Column) -> tuple[Column, Column]:
    """Metres on a local equirectangular plane."""
    return lon * M_PER_LON * F.greatest(F.lit(0.05), F.cos(F.radians(at_lat))), lat * M_PER_LAT


def orientation_bin(dx: Column, dy: Column, bins: int = 36) -> Column:
    """Direction of an undirected segment from north in `bins` classes of 180 degrees; -1 if it has no direction."""
    angle = F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(180.0))
    got = F.least(F.floor(angle / (180.0 / bins)).cast("int"), F.lit(bins - 1))
    return F.when(dx.isNull() | dy.isNull() | ((dx == 0) & (dy == 0)), F.lit(-1)).otherwise(got)


def circuity(length: Column, straight: Column, least_m: float = 0.01) -> Column:
    """length / straight, at least 1; null for straight distances that are too short."""
    return F.when(straight > least_m, F.greatest(F.lit(1.0), length / straight))


def hex_cell(x: Column, y: Column, width: float) -> tuple[Column, Column]:
    """Row and column of the hexagon (pointy top, flat to flat `width`, odd rows shifted by half) that holds (x, y).

    Candidates are the nearest centres in the two rows around y; the nearer wins, the lower row on ties.
    """
    dy = 1.5 * width / math.sqrt(3.0)
    row = F.floor(y / dy)

    def near(r: Column) -> tuple[Column, Column]:
        shift = F.pmod(r, F.lit(2)) * (width / 2)
        col = F.floor((x - shift) / width + 0.5)
        return col, (x - (col * width + shift)) ** 2 + (y - r * dy) ** 2

    c0, d0 = near(row)
    c1, d1 = near(row + 1)
    lower = d0 <= d1
    return F.when(lower, row).otherwise(row + 1).cast("long"), F.when(lower, c0).otherwise(c1).cast("long")


def pixel_window(lo: Column, hi: Column, origin: float, step: float, size: int) -> tuple[Column, Column]:
    """First pixel and number of pixels of a raster axis that [lo, hi] touches, within the raster."""
    first = F.greatest(F.lit(0), F.floor((lo - origin) / step)).cast("int")
    last = F.least(F.lit(size), F.ceil((hi - origin) / step)).cast("int")
    return first, F.greatest(F.lit(0), last - first)


def ring_area_m2(ring: Column) -> Column:
    """Area on the sphere of a closed ring, an array of structs (lon, lat)."""
    n = F.size(ring)
    parts = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.radians(F.get(ring, i)["lon"] - F.get(ring, i - 1)["lon"]) * (2 + F.sin(F.radians(F.get(ring, i)["lat"])) + F.sin(F.radians(F.get(ring, i - 1)["lat"]))))
    return F.when(n > 3, F.abs(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)) * EARTH_M * EARTH_M / 2).otherwise(F.lit(0.0))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: the point lies inside of a closed ring, an array of structs (lon, lat); points on edges count by side."""
    crossings = F.transform(
        F.sequence(F.lit(1), F.size(ring) - 1),
        lambda i: ((F.get(ring, i)["lat"] > y) != (F.get(ring, i - 1)["lat"] > y))
        & (x < (F.get(ring, i - 1)["lon"] - F.get(ring, i)["lon"]) * (y - F.get(ring, i)["lat"]) / F.nullif(F.get(ring, i - 1)["lat"] - F.get(ring, i)["lat"], F.lit(0.0)) + F.get(ring, i)["lon"]),
    )
    return F.coalesce(F.aggregate(crossings, F.lit(False), lambda a, b: a != F.coalesce(b, F.lit(False))), F.lit(False))


def unwrapped(lon: Column, start: Column) -> Column:
    """Longitude `lon` moved by 360 degrees where that is nearer to `start`, so that a line across the 180th meridian is short."""
    return F.when(lon - start > 180, lon - 360).when(lon - start < -180, lon + 360).otherwise(lon)


def unwrapped_ring(ring: Column) -> Column:
    """Ring whose longitudes run on across the 180th meridian, each within 180 degrees of the one before."""
    start = F.slice(ring, 1, 1)
    step = lambda done, p: F.concat(done, F.array(F.struct(unwrapped(p["lon"], F.element_at(done, -1)["lon"]).alias("lon"), p["lat"].alias("lat"))))
    return F.when(F.size(ring) > 1, F.aggregate(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.transform(start, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))), step)).otherwise(ring)


def wkb_point(wkb: Column) -> tuple[Column, Column]:
    """Longitude and latitude of little-endian WKB points, decoded arithmetically; null for other geometries."""
    hexed = F.hex(wkb)

    def word(at: int) -> Column:
        swapped = F.concat(*[F.substring(hexed, at + 1 + 2 * i, 2) for i in range(7, -1, -1)])
        high = F.conv(F.substring(swapped, 1, 8), 16, 10).cast("long")
        low = F.conv(F.substring(swapped, 9, 8), 16, 10).cast("long")
        sign = F.when(high >= 1 << 31, F.lit(-1.0)).otherwise(F.lit(1.0))
        exponent = F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF))
        fraction = (high.bitwiseAND(F.lit(0xFFFFF)) * F.lit(float(1 << 32)) + low) / F.lit(float(1 << 52))
        return F.when(exponent == 0, sign * fraction * F.pow(F.lit(2.0), F.lit(-1022))).otherwise(sign * (1 + fraction) * F.pow(F.lit(2.0), exponent - 1023))

    ok = (F.length(wkb) == 21) & (F.substring(hexed, 1, 10) == "0101000000")
    return F.when(ok, word(10)), F.when(ok, word(26))
