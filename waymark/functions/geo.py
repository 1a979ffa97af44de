"""Geodesy as native columns (WGS84 degrees, metres)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions import vocabulary as V

# Mean earth radius; the eight winds; metres a degree of latitude, for boxes.
EARTH_M = 6_371_008.8
WINDS = "N NE E SE S SW W NW".split()
BOX_M = 111_320.0


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance; null if any coordinate is."""
    dy, dx = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(dy) * F.sin(dy) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dx) * F.sin(dx)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def bearing_deg(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    d = F.radians(lng2 - lng1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def compass(bearing: Column) -> Column:
    """Wind of a bearing; halves go to the even eighth."""
    return F.get(F.array(*map(F.lit, WINDS)), F.pmod(F.bround(bearing / 45, 0).cast("int"), F.lit(8)))


def cell(degrees: Column, size: float) -> Column:
    return F.floor(degrees / size)


def inside(lat: Column, lng: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule for a closed ring of (lng, lat)."""
    crossings = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            crosses = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lng < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1)
            crossings = crossings != crosses
    return crossings


def offset(lat: Column, lng: Column, north_m: Column, east_m: Column) -> tuple[Column, Column]:
    """The position so many metres north and east."""
    up = F.degrees(north_m / EARTH_M)
    return lat + up, lng + F.degrees(east_m / (EARTH_M * F.cos(F.radians(lat))))


def box_around(lat: float, lng: float, radius_m: float) -> tuple[float, float, float, float]:
    """(west, south, east, north)."""
    import math

    dy, dx = radius_m / BOX_M, radius_m / (BOX_M * math.cos(math.radians(lat)))
    return lng - dx, lat - dy, lng + dx, lat + dy


def grid_ref_metres(ref: Column) -> Column:
    """struct<easting, northing> of a British grid reference: the middle of its square; null if malformed: letters of no square of Great Britain, or halves of unlike length."""
    tidy = F.upper(F.regexp_replace(ref, r"\s+", ""))
    halves = F.upper(F.trim(ref)).rlike(r"^[A-HJ-Z]\s*[A-HJ-Z]\s*(\d+|(\d{1}\s+\d{1})|(\d{2}\s+\d{2})|(\d{3}\s+\d{3})|(\d{4}\s+\d{4})|(\d{5}\s+\d{5}))$")
    good = tidy.rlike(r"^[A-HJ-Z]{2}(\d\d){1,5}$") & halves
    letters = "ABCDEFGHJKLMNOPQRSTUVWXYZ"  # no I
    at = lambda k: F.instr(F.lit(letters), F.substr(tidy, F.lit(k), F.lit(1))) - 1
    a, b = at(1), at(2)
    east = (F.pmod(a - 2, F.lit(5)) * 5 + F.pmod(b, F.lit(5))) * 100_000
    north = (19 - F.floor(a / 5) * 5 - F.floor(b / 5)) * 100_000
    digits = (F.length(tidy) - 2) / 2
    size = F.pow(F.lit(10.0), 5 - digits)
    part = lambda start: F.coalesce(F.substr(tidy, start.cast("int"), digits.cast("int")).try_cast("double"), F.lit(0.0)) * size + size / 2
    on = (east >= 0) & (east < 700_000) & (north >= 0) & (north < 1_300_000)
    return F.when(good & on, F.struct((east + part(F.lit(3))).cast("double").alias("easting"), (north + part(3 + digits)).cast("double").alias("northing")))


def web_mercator(px: Column, py: Column, zoom: int) -> tuple[Column, Column]:
    """(lat, lng) of a pixel of the zoom's whole-world image of 256-pixel tiles."""
    n = 256.0 * 2**zoom
    return F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * py / n)))), px / n * 360 - 180


def wkt_point(text: Column) -> Column:
    """struct<lng, lat> of `POINT(x y)`; null if malformed."""
    part = lambda k: F.regexp_extract(text, r"^\s*POINT ?\(\s*([-0-9.]+)\s+([-0-9.]+)\s*\)\s*$", k).try_cast("double")
    return F.when(part(1).isNotNull() & part(2).isNotNull(), F.struct(part(1).alias("lng"), part(2).alias("lat")))


def turned(a: Column, b: Column) -> Column:
    """Degrees between two bearings, 0 to 180."""
    d = F.abs(F.pmod(a - b, F.lit(360.0)))
    return F.least(d, 360 - d)


def nearest_on_line(lat: Column, lng: Column, line: list[tuple[float, float]]) -> Column:
    """struct<square, lat, lng> of the nearest point of a line of (lng, lat); squares in degrees of latitude, longitudes scaled by the position's own latitude."""
    scale, found = F.cos(F.radians(lat)), []
    for (x1, y1), (x2, y2) in zip(line, line[1:]):
        dx, dy = (x2 - x1) * scale, F.lit(y2 - y1)
        long = dx * dx + dy * dy
        t = F.when(long > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((lng - x1) * scale * dx + (lat - y1) * dy) / long))).otherwise(F.lit(0.0))
        px, py = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
        found.append(F.struct(((lng - px) * scale * (lng - px) * scale + (lat - py) * (lat - py)).alias("square"), py.alias("lat"), px.alias("lng")))
    return F.array_min(F.array(*found))


# The two ellipsoids, the shift between them (metres, seconds of arc, parts) and the projection of the British grid.
WGS84, AIRY = (6378137.0, 6356752.314245), (6377563.396, 6356256.909)
SHIFT, TURN, GROWTH = (-446.448, 125.157, -542.060), (-0.1502, -0.2470, -0.8421), 20.4894e-6
GRID_SCALE, GRID_LAT, GRID_LNG, GRID_EAST, GRID_NORTH = 0.9996012717, 49.0, -2.0, 400_000.0, -100_000.0


def _moved(df, lat: str, lng: str, before, after, sign: int):
    """df with __p, __l: latitude and longitude in radians on the other ellipsoid (Helmert's seven parameters, Bowring's latitude)."""
    import math

    (a, b), (c, d) = before, after
    e2, g2 = 1 - b * b / (a * a), 1 - d * d / (c * c)
    (tx, ty, tz), (rx, ry, rz), s = (sign * t for t in SHIFT), (math.radians(sign * r / 3600) for r in TURN), 1 + sign * GROWTH
    df = df.withColumns({"__f": F.radians(lat), "__g": F.radians(lng)})
    df = df.withColumn("__v", a / F.sqrt(1 - e2 * F.sin("__f") * F.sin("__f")))
    df = df.withColumns({"__x": F.col("__v") * F.cos("__f") * F.cos("__g"), "__y": F.col("__v") * F.cos("__f") * F.sin("__g"), "__z": (1 - e2) * F.col("__v") * F.sin("__f")})
    x, y, z = F.col("__x"), F.col("__y"), F.col("__z")
    df = df.withColumns({"__x": tx + s * x - rz * y + ry * z, "__y": ty + rz * x + s * y - rx * z, "__z": tz - ry * x + rx * y + s * z})
    df = df.withColumn("__r", F.sqrt(F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y")))
    df = df.withColumn("__t", F.atan2(F.col("__z") * c, F.col("__r") * d))
    up = F.col("__z") + g2 / (1 - g2) * d * F.pow(F.sin("__t"), F.lit(3))
    out = F.col("__r") - g2 * c * F.pow(F.cos("__t"), F.lit(3))
    return df.withColumns({"__p": F.atan2(up, out), "__l": F.atan2(F.col("__y"), F.col("__x"))}).drop("__f", "__g", "__v", "__x", "__y", "__z", "__r", "__t")


def _arc(lat: Column) -> Column:
    """Metres along the meridian from the grid's true origin to a latitude (radians)."""
    import math

    a, b = AIRY
    n, base = (a - b) / (a + b), math.radians(GRID_LAT)
    less, more = lat - base, lat + base
    terms = (1 + n + 1.25 * n**2 + 1.25 * n**3) * less - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(less) * F.cos(more)
    return b * GRID_SCALE * (terms + 15 / 8 * (n**2 + n**3) * F.sin(2 * less) * F.cos(2 * more) - 35 / 24 * n**3 * F.sin(3 * less) * F.cos(3 * more))


def _radii(lat: Column) -> tuple[Column, Column]:
    """(across, along the meridian) radii of curvature, scaled as the grid is."""
    a, b = AIRY
    e2 = 1 - b * b / (a * a)
    w = 1 - e2 * F.sin(lat) * F.sin(lat)
    return a * GRID_SCALE / F.sqrt(w), a * GRID_SCALE * (1 - e2) / F.pow(w, F.lit(1.5))


def to_grid(df, lat: str = "lat", lng: str = "lng"):
    """df with easting and northing (British grid, metres; good to a few metres)."""
    import math

    df = _moved(df, lat, lng, WGS84, AIRY, 1)
    p = F.col("__p")
    across, along = _radii(p)
    df = df.withColumns({"__a": across, "__h": across / along - 1, "__s": F.sin(p), "__c": F.cos(p), "__d": F.col("__l") - math.radians(GRID_LNG), "__m": _arc(p)})
    a, h, s, c, d = (F.col(f"__{k}") for k in "ahscd")
    df = df.withColumn("__q", s * s / (c * c))
    q = F.col("__q")
    dc = d * c
    north = F.col("__m") + a * s * c * d * d / 2 + a * s * c * c * c * d * d * d * d / 24 * (5 - q + 9 * h) + a * s / c * F.pow(dc, F.lit(6)) / 720 * (61 - 58 * q + q * q)
    east = a * dc + a * dc * dc * dc / 6 * (1 + h - q) + a * F.pow(dc, F.lit(5)) / 120 * (5 - 18 * q + q * q + 14 * h - 58 * q * h)
    return df.withColumns({"easting": GRID_EAST + east, "northing": GRID_NORTH + north}).drop("__p", "__l", "__a", "__h", "__s", "__c", "__d", "__m", "__q")


def from_grid(df, easting: str = "easting", northing: str = "northing", rounds: int = 6):
    """df with lat and lng of British grid metres. Each round brings the foot's latitude about three digits nearer."""
    import math

    df = df.withColumn("__p", math.radians(GRID_LAT) + (F.col(northing) - GRID_NORTH) / (AIRY[0] * GRID_SCALE))
    for _ in range(rounds):
        df = df.withColumn("__p", F.col("__p") + (F.col(northing) - GRID_NORTH - _arc(F.col("__p"))) / (AIRY[0] * GRID_SCALE))
    across, along = _radii(F.col("__p"))
    df = df.withColumns({"__a": across, "__o": along, "__k": F.tan("__p"), "__c": F.cos("__p"), "__e": F.col(easting) - GRID_EAST})
    a, o, k, c, e = (F.col(f"__{x}") for x in "aokce")
    h, q, u = a / o - 1, k * k, e / a
    df = df.withColumns({"__h": h, "__q": q, "__u": u})
    h, q, u = F.col("__h"), F.col("__q"), F.col("__u")
    lat = F.col("__p") - k * e * u / (2 * o) + k * e * u * u * u / (24 * o) * (5 + 3 * q + h - 9 * q * h) - k * e * F.pow(u, F.lit(5)) / (720 * o) * (61 + 90 * q + 45 * q * q)
    lng = math.radians(GRID_LNG) + u / c - u * u * u / (6 * c) * (a / o + 2 * q) + F.pow(u, F.lit(5)) / (120 * c) * (5 + 28 * q + 24 * q * q)
    df = df.withColumns({"__lat": F.degrees(lat), "__lng": F.degrees(lng)}).drop("__p", "__a", "__o", "__k", "__c", "__e", "__h", "__q", "__u")
    return _moved(df, "__lat", "__lng", AIRY, WGS84, -1).withColumns({"lat": F.degrees("__p"), "lng": F.degrees("__l")}).drop("__lat", "__lng", "__p", "__l")


def grid_ref(easting: Column, northing: Column, digits_each: int = 4) -> Column:
    """`AB 1234 5678` of grid metres, with so many digits each way; null off the grid."""
    letters = F.lit("ABCDEFGHJKLMNOPQRSTUVWXYZ")  # no I
    x, y = F.floor(easting / 100_000), F.floor(northing / 100_000)
    first = (3 - F.floor(y / 5)) * 5 + F.floor(x / 5) + 2
    second = (4 - F.pmod(y, F.lit(5))) * 5 + F.pmod(x, F.lit(5))
    one = lambda k: F.substr(letters, (k + 1).cast("int"), F.lit(1))
    digits = lambda m: F.lpad(F.floor(F.pmod(m, F.lit(100_000.0)) / 10.0 ** (5 - digits_each)).cast("string"), digits_each, "0")
    on = (easting >= 0) & (easting < 700_000) & (northing >= 0) & (northing < 1_300_000)
    return F.when(on, F.concat(one(first), one(second), F.lit(" "), digits(easting), F.lit(" "), digits(northing)))


def nation(lat: Column, lng: Column) -> Column:
    """The country of the United Kingdom that a point lies in; null outside them."""
    within = lambda box: (lng > box[0]) & (lat > box[1]) & (lng < box[2]) & (lat < box[3])
    out = F.when(inside(lat, lng, V.NORTHERN_IRELAND), "northern_ireland").when(inside(lat, lng, V.SCOTLAND), "scotland").when(inside(lat, lng, V.WALES), "wales")
    return out.when(~within(V.ISLE_OF_MAN) & within(V.ENGLAND_BOX), "england")
