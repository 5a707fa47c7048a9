"""Geographic column expressions: distances, local planes, tiles, grids and map pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Earth's mean radius and the kilometres of a degree.
EARTH_KM, LON_KM, LAT_KM = 6371.0088, 111.32, 110.57


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the root is kept within [0, 1]."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def plane_x_km(lon: Column, lon0: Column | float, lat0: Column | float) -> Column:
    lat0 = lat0 if isinstance(lat0, Column) else F.lit(lat0)
    return (lon - lon0) * LON_KM * F.cos(F.radians(lat0))


def plane_y_km(lat: Column, lat0: Column | float) -> Column:
    return (lat - lat0) * LAT_KM


def in_box(lat: Column, lon: Column, area) -> Column:
    """Inside or on the edge of an area; plain comparisons, so that they reach the scan."""
    return lat.between(area.south, area.north) & lon.between(area.west, area.east)


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def tile_code(lat: Column, lon: Column, step: int = 3) -> Column:
    """The name of the raster tile of ``step`` degrees, after its south-west corner: N24E081."""
    y, x = F.floor(lat / step) * step, F.floor(lon / step) * step
    ns, ew = F.when(y >= 0, "N").otherwise("S"), F.when(x >= 0, "E").otherwise("W")
    return F.concat(ns, F.lpad(F.abs(y).cast("string"), 2, "0"), ew, F.lpad(F.abs(x).cast("string"), 3, "0"))


def grid_cell(lat: Column, lon: Column, area, cell_km: float) -> Column:
    """The cell ``x:y`` of a fixed grid over an area."""
    x = plane_x_km(lon, F.lit(area.west), F.lit((area.south + area.north) / 2))
    y = plane_y_km(lat, F.lit(area.south))
    return F.concat_ws(":", F.floor(x / cell_km).cast("string"), F.floor(y / cell_km).cast("string"))


def mercator_x(lon: Column, zoom: int) -> Column:
    return F.lit(256.0 * 2**zoom) * (lon + 180) / 360


def mercator_y(lat: Column, zoom: int) -> Column:
    s = F.sin(F.radians(lat))
    return F.lit(256.0 * 2**zoom) * (F.lit(0.5) - F.ln((1 + s) / (1 - s)) / (4 * 3.141592653589793))


def utm_epsg(lat: Column, lon: Column) -> Column:
    """The EPSG code of the UTM zone."""
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


# The WGS 84 ellipsoid, the scale and the false origin of UTM.
WGS84_A, WGS84_F, UTM_SCALE, UTM_EAST, UTM_SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def utm_metres(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(easting, northing) in the point's UTM zone, by Krüger's series of third order (errors below a millimetre in the zone)."""
    n = WGS84_F / (2 - WGS84_F)
    alphas = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * n**0.5 / (1 + n)
    meridian = (utm_epsg(lat, lon) % 100) * 6 - 183
    s, away = F.sin(F.radians(lat)), F.radians(lon - meridian)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    x = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alphas, 1)), F.lit(0.0))
    y = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alphas, 1)), F.lit(0.0))
    return UTM_EAST + UTM_SCALE * radius * x, F.when(lat >= 0, 0.0).otherwise(UTM_SOUTH) + UTM_SCALE * radius * y


def snapped_grid(lat: Column, lon: Column, radius_m: float, step: float = 20.0) -> Column:
    """A struct (epsg, x, y, left, top, rows, cols): the grid of ``step`` metres, on multiples of it, around a point."""
    if not 0 < radius_m <= 10_000 or step != 20:
        raise ValueError("a grid has a step of 20 m and a radius of at most 10 km")
    x, y = utm_metres(lat, lon)
    left, top = F.floor((x - radius_m) / step) * step, F.ceil((y + radius_m) / step) * step
    rows, cols = F.ceil((top - y + radius_m) / step), F.ceil((x + radius_m - left) / step)
    return F.struct(utm_epsg(lat, lon).alias("epsg"), x.alias("x"), y.alias("y"), left.alias("left"), top.alias("top"), rows.cast("int").alias("rows"), cols.cast("int").alias("cols"))
