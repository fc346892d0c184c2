"""Distances, projections and boxes as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EQUATOR_KM, POLE_KM = 6378.137, 6356.7523
RAD = math.pi / 180


def _rad(c: Column) -> Column:
    return c * F.lit(RAD)


def let(values: dict[str, Column], use) -> Column:
    """use(struct of values) with each value worked out once: nested formulas would otherwise repeat their parts many times over."""
    return F.get(F.transform(F.array(F.struct(*(c.alias(n) for n, c in values.items()))), use), F.lit(0))


def unit_vector(lon: Column, lat: Column) -> list[Column]:
    """x, y and z of a place on the sphere of radius 1, where neither the date line nor a pole is a border."""
    return [F.cos(_rad(lat)) * F.cos(_rad(lon)), F.cos(_rad(lat)) * F.sin(_rad(lon)), F.sin(_rad(lat))]


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in metres on a sphere of 6371 km."""
    a = F.pow(F.sin(_rad(lat2 - lat1) / 2), 2) + F.cos(_rad(lat1)) * F.cos(_rad(lat2)) * F.pow(F.sin(_rad(lon2 - lon1) / 2), 2)
    return F.lit(12_742_000.0) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def distance(x1: Column, y1: Column, x2: Column, y2: Column, kind: str = "spherical") -> Column:
    """euclid (units of x and y), spherical (law of cosines, km) or haversine (km); x is longitude."""
    if kind == "euclid":
        return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))
    if kind == "spherical":
        c = F.sin(_rad(y1)) * F.sin(_rad(y2)) + F.cos(_rad(y1)) * F.cos(_rad(y2)) * F.cos(_rad(x2 - x1))
        return F.lit(EQUATOR_KM) * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))
    if kind == "haversine":
        a = F.pow(F.sin(_rad(y2 - y1) / 2), 2) + F.cos(_rad(y1)) * F.cos(_rad(y2)) * F.pow(F.sin(_rad(x2 - x1) / 2), 2)
        return F.lit(2 * (2 * EQUATOR_KM + POLE_KM) / 3) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
    raise ValueError(f"no distance {kind!r}")


# --- UTM on WGS 84: Kruger's series to the fourth power of the third flattening ----------------------------------------

_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_SCALE = 0.9996 * _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def utm_zone(lon: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 6), F.lit(60)).cast("int") + 1


def utm_epsg(zone: Column, north: Column) -> Column:
    return F.when(north, F.lit(32600) + zone).otherwise(F.lit(32700) + zone)


def epsg_zone(epsg: Column) -> Column:
    """Zone number of a UTM code, negative in the south; null for other codes."""
    return F.when(epsg.between(32601, 32660), epsg - 32600).when(epsg.between(32701, 32760), F.lit(32700) - epsg)


def utm(lat: Column, lon: Column, zone: Column | None = None) -> Column:
    """Struct of zone, north, x and y in metres."""
    k = 2 * math.sqrt(_N) / (1 + _N)

    def place(v: Column) -> Column:
        s = v["s"]
        return let({"zone": v["zone"], "north": v["north"], "d": v["d"], "t": F.sinh(F.atanh(s) - k * F.atanh(k * s))}, turned)

    def turned(v: Column) -> Column:
        t, d = v["t"], v["d"]
        return let({"zone": v["zone"], "north": v["north"], "xi": F.atan2(t, F.cos(d)), "eta": F.atanh(F.sin(d) / F.sqrt(1 + t * t))}, series)

    def series(v: Column) -> Column:
        xi, eta, north = v["xi"], v["eta"], v["north"]
        x, y = eta, xi
        for j, a in enumerate(_ALPHA, 1):
            x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return F.struct(v["zone"].alias("zone"), north.alias("north"), (F.lit(500000.0) + _SCALE * x).alias("x"), (F.when(north, 0.0).otherwise(1e7) + _SCALE * y).alias("y"))

    at = {"lat": lat.cast("double"), "lon": lon.cast("double"), "zone": utm_zone(lon) if zone is None else zone}
    return let(at, lambda v: let({"zone": v["zone"], "north": v["lat"] >= 0, "s": F.sin(_rad(v["lat"])), "d": _rad(v["lon"] - (v["zone"] * 6 - 183))}, place))


def utm_inverse(x: Column, y: Column, zone: Column, north: Column) -> Column:
    """Struct of lat and lon in degrees."""

    def series(v: Column) -> Column:
        a, b = v["xi"], v["eta"]
        for j, c in enumerate(_BETA, 1):
            a = a - c * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
            b = b - c * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
        return let({"zone": v["zone"], "a": a, "b": b}, conformal)

    def conformal(v: Column) -> Column:
        return let({"chi": F.asin(F.sin(v["a"]) / F.cosh(v["b"])), "lon": F.atan2(F.sinh(v["b"]), F.cos(v["a"])) / RAD + (v["zone"] * 6 - 183)}, geographic)

    def geographic(v: Column) -> Column:
        lat = v["chi"]
        for j, c in enumerate(_DELTA, 1):
            lat = lat + c * F.sin(2 * j * v["chi"])
        return F.struct((lat / RAD).alias("lat"), v["lon"].alias("lon"))

    return let({"xi": (y - F.when(north, 0.0).otherwise(1e7)) / _SCALE, "eta": (x - 500000.0) / _SCALE, "zone": zone}, series)


# --- other projections ------------------------------------------------------------------------------------------------


def web_mercator(lat: Column, lon: Column) -> Column:
    return F.struct((_rad(lon) * _A).alias("x"), (F.log(F.tan(math.pi / 4 + _rad(lat) / 2)) * _A).alias("y"))


def web_mercator_inverse(x: Column, y: Column) -> Column:
    return F.struct(((2 * F.atan(F.exp(y / _A)) - math.pi / 2) / RAD).alias("lat"), (x / _A / RAD).alias("lon"))


_E2 = (2 - 1 / 298.257222101) / 298.257222101
_E = math.sqrt(_E2)


def _albers_q(s):
    log = F.log if isinstance(s, Column) else math.log
    return (1 - _E2) * (s / (1 - _E2 * s * s) - 1 / (2 * _E) * log((1 - _E * s) / (1 + _E * s)))


def albers(lat: Column, lon: Column, lat1: float = 34.0, lat2: float = 40.5, lat0: float = 0.0, lon0: float = -120.0, y0: float = -4e6) -> Column:
    """Equal-area x and y in metres on GRS 80; the defaults are those of California."""
    m = [math.cos(x * RAD) ** 2 / (1 - _E2 * math.sin(x * RAD) ** 2) for x in (lat1, lat2)]
    q = [_albers_q(math.sin(x * RAD)) for x in (lat0, lat1, lat2)]
    n = (m[0] - m[1]) / (q[2] - q[1])
    c = m[0] + n * q[1]
    rho0 = _A * math.sqrt(c - n * q[0]) / n
    rho = F.lit(_A) * F.sqrt(c - n * _albers_q(F.sin(_rad(lat)))) / n
    turn = n * _rad(lon - lon0)
    return F.struct((rho * F.sin(turn)).alias("x"), (rho0 - rho * F.cos(turn) + y0).alias("y"))


# --- pixels -----------------------------------------------------------------------------------------------------------


def _turn(x: Column, y: Column, ulx: Column, uly: Column, degrees: Column) -> tuple[Column, Column]:
    s, c = F.sin(_rad(degrees)), F.cos(_rad(degrees))
    return ulx + c * (x - ulx) - s * (y - uly), uly + s * (x - ulx) + c * (y - uly)


def pixel_to_map(sample: Column, line: Column, m: Column) -> Column:
    """Map x and y of a pixel; m is a struct with ulx, uly, xps, yps and rotation (degrees, about the upper left)."""
    x, y = _turn(m["ulx"] + m["xps"] * sample, m["uly"] - m["yps"] * line, m["ulx"], m["uly"], m["rotation"])
    return F.struct(x.alias("x"), y.alias("y"))


def map_to_pixel(x: Column, y: Column, m: Column) -> Column:
    """Sample and line, as fractions, of map coordinates."""
    a, b = _turn(x, y, m["ulx"], m["uly"], -m["rotation"])
    return F.struct(((a - m["ulx"]) / m["xps"]).alias("sample"), ((m["uly"] - b) / m["yps"]).alias("line"))


def latlon_to_pixel(lat: Column, lon: Column, m: Column) -> Column:
    """By the image's UTM zone (m.zone, m.hemi)."""
    return let({"u": utm(lat, lon, m["zone"]), "lat": lat, "m": m}, lambda v: _utm_to_pixel(v["u"], v["lat"], v["m"]))


def _utm_to_pixel(u: Column, lat: Column, m: Column) -> Column:
    return map_to_pixel(u["x"], u["y"] + F.when((m["hemi"] == "South") & (lat >= 0), 1e7).when((m["hemi"] == "North") & (lat < 0), -1e7).otherwise(0.0), m)


def pixel_to_latlon(sample: Column, line: Column, m: Column) -> Column:
    return let({"p": pixel_to_map(sample, line, m), "m": m}, lambda v: utm_inverse(v["p"]["x"], v["p"]["y"], v["m"]["zone"], v["m"]["hemi"] == "North"))


def geo_box(lat: Column, lon: Column, diameter_m: Column, m: Column) -> Column:
    """Array of 4 corners (UTM x and y, lat, lon, sample, line) of a square around a point, turned like the image."""
    return let({"u": utm(lat, lon, m["zone"]), "d": diameter_m, "m": m}, lambda v: _corners(v["u"], v["d"], v["m"]))


def _corners(u: Column, diameter_m: Column, m: Column) -> Column:
    corners = []
    for sx, sy in ((-0.5, 0.5), (0.5, 0.5), (0.5, -0.5), (-0.5, -0.5)):
        x, y = _turn(u["x"] + sx * diameter_m, u["y"] + sy * diameter_m, u["x"], u["y"], m["rotation"])
        ll, px = utm_inverse(x, y, m["zone"], u["north"]), map_to_pixel(x, y, m)
        corners.append(F.struct(x.alias("x"), y.alias("y"), ll["lat"].alias("lat"), ll["lon"].alias("lon"), px["sample"].alias("sample"), px["line"].alias("line")))
    return F.array(*corners)


def bounded_box(low_x: Column, high_x: Column, low_y: Column, high_y: Column, border: float = 0.0, min_side: float | None = None, max_side: float | None = None) -> Column:
    """A box with a border added: below 1 a share of the mean side, else units; sides are then widened or cut about the middle."""
    side = ((high_x - low_x) + (high_y - low_y)) / 2
    b = side * border if border < 1 else F.lit(float(border))
    out = []
    for low, high in ((low_x, high_x), (low_y, high_y)):
        mid, half = (low + high) / 2, (high - low) / 2 + b
        if min_side is not None:
            half = F.greatest(half, F.lit(min_side / 2))
        if max_side is not None:
            half = F.least(half, F.lit(max_side / 2))
        out += [mid - half, mid + half]
    return F.struct(*(c.alias(n) for c, n in zip(out, ("xmin", "xmax", "ymin", "ymax"), strict=True)))


def box_overlap(a: Column, b: Column, pixels: bool = False) -> Column:
    """Area shared by two boxes (structs of xmin, xmax, ymin, ymax); pixel boxes count their last row and column."""
    one = 1 if pixels else 0
    w = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"]) + one
    h = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"]) + one
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))


def box_area(a: Column, pixels: bool = False) -> Column:
    one = 1 if pixels else 0
    return (a["xmax"] - a["xmin"] + one) * (a["ymax"] - a["ymin"] + one)


def box_iou(a: Column, b: Column, pixels: bool = False) -> Column:
    both = box_overlap(a, b, pixels)
    return both / (box_area(a, pixels) + box_area(b, pixels) - both)


def window_bounds(i: Column, offset: int, n: Column) -> Column:
    """[i - offset, i + offset] cut to 0 .. n - 1."""
    return F.struct(F.greatest(F.lit(0), i - offset).alias("low"), F.least(n - 1, i + offset).alias("high"))


def in_box(x: Column, y: Column, box: Column) -> Column:
    return x.between(box["xmin"], box["xmax"]) & y.between(box["ymin"], box["ymax"])


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting over a closed ring (array of structs x, y); points on the boundary are outside."""
    n = F.size(ring) - 1
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))

    def crosses(e):
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    def touches(e):
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    odd = F.aggregate(edges, F.lit(False), lambda acc, e: acc != F.coalesce(crosses(e), F.lit(False)))
    return odd & ~F.exists(edges, touches)


def lens_share(d: Column, r: float) -> Column:
    """Shared area of two discs of radius r whose centres are d apart, as a share of one disc."""
    area = 2 * r * r * F.acos(F.least(F.lit(1.0), d / (2 * r))) - d / 2 * F.sqrt(F.greatest(F.lit(0.0), 4 * r * r - d * d))
    return F.when(d < 2 * r, area / (math.pi * r * r)).otherwise(F.lit(0.0))
