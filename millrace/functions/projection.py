"""Map projections as column expressions: .prj texts, transverse Mercator and Mercator, forward and inverse.

The projection of each file is a struct column made from its .prj text, so that
files of different projections are worked on in one plan, without Python. The
transverse Mercator series are those in the third flattening to its fourth power,
which within a zone is well under a millimetre.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coordinates of each type of geometry as JSON, and how deep its positions lie.
DEPTHS = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
_NUMBER = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"


def _number(prj: Column, pattern: str, default: float) -> Column:
    return F.coalesce(F.regexp_extract(prj, pattern, 1).try_cast("double"), F.lit(default))


def _parameter(prj: Column, name: str, default: float) -> Column:
    return _number(prj, rf'(?is)PARAMETER\s*\[\s*"{name}"\s*,\s*{_NUMBER}', default)


def _polynomial(n: Column, coefficients: list[float]) -> Column:
    """c1 n + c2 n^2 + .."""
    return n * reduce(lambda out, c: F.lit(c) + n * out, reversed(coefficients[:-1]), F.lit(coefficients[-1]))


#: Coefficients of the series by powers of the third flattening: forward, inverse, and from the conformal latitude.
FORWARD = [[1 / 2, -2 / 3, 5 / 16, 41 / 180], [0, 13 / 48, -3 / 5, 557 / 1440], [0, 0, 61 / 240, -103 / 140], [0, 0, 0, 49561 / 161280]]
INVERSE = [[1 / 2, -2 / 3, 37 / 96, -1 / 360], [0, 1 / 48, 1 / 15, -437 / 1440], [0, 0, 17 / 480, -37 / 840], [0, 0, 0, 4397 / 161280]]
LATITUDE = [[2, -2 / 3, -2, 116 / 45], [0, 7 / 3, -8 / 5, -227 / 45], [0, 0, 56 / 15, -136 / 35], [0, 0, 0, 4279 / 630]]


def projection(prj: Column) -> Column:
    """A struct from a .prj text: kind (tm, mercator, none), status and message, and the numbers of the projection.

    ``status`` is projected, assumed-wgs84, failed (a projection that isn't known) or
    local (no text). A geographic system other than WGS84 is left as it is, too: its datum isn't shifted.
    """
    name = F.lower(F.regexp_extract(prj, r'(?is)PROJECTION\s*\[\s*"([^"]+)"', 1))
    sphere = name.contains("auxiliary_sphere") | F.lower(prj).contains("popular") | F.lower(prj).contains("pseudo-mercator")
    kind = F.when(name.isin("transverse_mercator", "gauss_kruger"), "tm").when(name.startswith("mercator") | sphere, "mercator").otherwise("none")
    wgs84 = F.regexp_like(prj, F.lit(r"(?i)WGS[_\s]?(19)?84")) | F.regexp_like(prj, F.lit(r"""(?i)EPSG["']?\s*,\s*["']?4326"""))
    status = F.when(prj.isNull() | (F.trim(prj) == ""), "local").when(kind != "none", "projected").when((name == "") & F.regexp_like(prj, F.lit("(?is)GEOGCS|GEOGCRS")) | (name == "") & wgs84, "assumed-wgs84").otherwise("failed")
    message = F.create_map(*[F.lit(x) for pair in {
        "local": "No .prj file was found. Showing geometry in local coordinates unless values look like longitude/latitude.",
        "projected": "Coordinates were transformed to WGS84 using the .prj definition.",
        "assumed-wgs84": "The .prj file appears to describe WGS84 coordinates.",
        "failed": "The .prj file could not be parsed. Showing geometry in local coordinates.",
    }.items() for x in pair])
    a = _number(prj, rf'(?is)SPHEROID\s*\[\s*"[^"]*"\s*,\s*{_NUMBER}', 6378137.0)
    rf = _number(prj, rf'(?is)SPHEROID\s*\[\s*"[^"]*"\s*,\s*[-+0-9.eE]+\s*,\s*{_NUMBER}', 298.257223563)
    f = F.when(sphere | (rf == 0), F.lit(0.0)).otherwise(1 / rf)
    out = F.struct(
        kind.alias("kind"), status.alias("status"), F.element_at(message, status).alias("message"), a.alias("a"), (f / (2 - f)).alias("n"),
        F.radians(_parameter(prj, "central_meridian", 0.0)).alias("lon0"), F.radians(_parameter(prj, "latitude_of_origin", 0.0)).alias("lat0"), _parameter(prj, "scale_factor", 1.0).alias("k0"),
        _parameter(prj, "false_easting", 0.0).alias("fe"), _parameter(prj, "false_northing", 0.0).alias("fn"), _number(prj, rf'(?is).*UNIT\s*\[\s*"[^"]*"\s*,\s*{_NUMBER}', 1.0).alias("unit"),
    )
    return out


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _radius(p: Column) -> Column:
    """Of the circle with the meridian's length."""
    n = p["n"]
    return p["a"] / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64)


def _conformal(p: Column, lat: Column) -> Column:
    """Isometric latitude."""
    e = F.sqrt(4 * p["n"]) / (1 + p["n"])
    return F.atanh(F.sin(lat)) - e * F.atanh(e * F.sin(lat))


def _geographic(p: Column, chi: Column) -> Column:
    """Latitude of a conformal latitude."""
    return reduce(lambda out, j: out + _polynomial(p["n"], LATITUDE[j - 1]) * F.sin(2 * j * chi), range(1, 5), chi)


def _wave(p: Column, xi: Column, eta: Column, series: list[list[float]], sign: int) -> Column:
    """(xi, eta) with a series added or taken away."""
    term = lambda j, a, b: sign * _polynomial(p["n"], series[j - 1]) * a(2 * j * xi) * b(2 * j * eta)
    return F.struct(
        reduce(lambda out, j: out + term(j, F.sin, F.cosh), range(1, 5), xi).alias("xi"),
        reduce(lambda out, j: out + term(j, F.cos, F.sinh), range(1, 5), eta).alias("eta"),
    )


def _origin(p: Column) -> Column:
    """The rectifying latitude of the projection's origin."""
    return _bound(F.atan(F.sinh(_conformal(p, p["lat0"]))), lambda x: _wave(p, x, F.lit(0.0), FORWARD, 1)["xi"])


def to_degrees(p: Column, x: Column, y: Column) -> Column:
    """[longitude, latitude] in degrees of projected coordinates; others as they are."""
    east, north = (x * p["unit"] - p["fe"] * p["unit"]), (y * p["unit"] - p["fn"] * p["unit"])
    scale = p["k0"] * _radius(p)

    def tm(flat: Column) -> Column:
        return _bound(_wave(p, flat["xi"], flat["eta"], INVERSE, -1), lambda w: F.array(F.degrees(p["lon0"] + F.atan2(F.sinh(w["eta"]), F.cos(w["xi"]))), F.degrees(_bound(F.asin(F.sin(w["xi"]) / F.cosh(w["eta"])), lambda chi: _geographic(p, chi)))))

    plane = _bound(F.struct((north / scale + _origin(p)).alias("xi"), (east / scale).alias("eta")), tm)
    k = p["k0"] * p["a"]
    cylinder = F.array(F.degrees(p["lon0"] + east / k), F.degrees(_bound(F.atan(F.sinh(north / k)), lambda chi: _geographic(p, chi))))
    return F.when(p["kind"] == "tm", plane).when(p["kind"] == "mercator", cylinder).otherwise(F.array(x, y))


def from_degrees(p: Column, lon: Column, lat: Column) -> Column:
    """[x, y] of the projection from degrees; as they are without one."""
    scale = p["k0"] * _radius(p)
    turn = F.radians(lon) - p["lon0"]
    psi = _conformal(p, F.radians(lat))

    def tm(t: Column) -> Column:
        start = F.struct(F.atan2(t, F.cos(turn)).alias("xi"), F.asinh(F.sin(turn) / F.sqrt(t * t + F.cos(turn) * F.cos(turn))).alias("eta"))
        return _bound(start, lambda s: _bound(_wave(p, s["xi"], s["eta"], FORWARD, 1), lambda w: F.array(p["fe"] + scale * w["eta"] / p["unit"], p["fn"] + scale * (w["xi"] - _origin(p)) / p["unit"])))

    k = p["k0"] * p["a"] / p["unit"]
    cylinder = F.array(p["fe"] + k * turn, p["fn"] + k * psi)
    return F.when(p["kind"] == "tm", _bound(F.sinh(psi), tm)).when(p["kind"] == "mercator", cylinder).otherwise(F.array(lon, lat))


def moved(coordinates: Column, geom_type: Column, p: Column, way=to_degrees) -> Column:
    """Coordinates (JSON, nested as their type of geometry has them) with each position projected, its further numbers kept."""

    def position(c: Column) -> Column:
        return F.concat(way(p, c[0], c[1]), F.slice(c, 3, F.greatest(F.size(c) - 2, F.lit(0))))

    def at(depth: int):
        return position if depth == 0 else lambda c: F.transform(c, at(depth - 1))

    out = coordinates
    for depth in sorted(set(DEPTHS.values())):
        kind = "array<" * (depth + 1) + "double" + ">" * (depth + 1)
        own = [t for t, d in DEPTHS.items() if d == depth]
        out = F.when(geom_type.isin(*own), F.to_json(at(depth)(F.from_json(coordinates, kind)))).otherwise(out)
    return F.when(p["kind"] == "none", coordinates).otherwise(out)


def corners(coordinates: Column, geom_type: Column) -> Column:
    """The box (min_x, min_y, max_x, max_y) of nested coordinates; nulls of none."""
    flat = F.lit(None).cast("array<array<double>>")
    for depth in sorted(set(DEPTHS.values())):
        own = [t for t, d in DEPTHS.items() if d == depth]
        kind = "array<" * (depth + 1) + "double" + ">" * (depth + 1)
        parsed = F.from_json(coordinates, kind)
        points = F.array(parsed) if depth == 0 else reduce(lambda c, _: F.flatten(c), range(depth - 1), parsed)
        flat = F.when(geom_type.isin(*own), points).otherwise(flat)
    side = lambda f, i: f(F.transform(flat, lambda c: c[i]))
    return F.struct(side(F.array_min, 0).alias("min_x"), side(F.array_min, 1).alias("min_y"), side(F.array_max, 0).alias("max_x"), side(F.array_max, 1).alias("max_y"))
