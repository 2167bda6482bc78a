"""The scalar functions as SQL functions of a session.

Each is a SQL expression body, which the analyser inlines into the plan.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from geolens import constants as K

_HALF_KM = "2D * radius_m / 1000D"
_EUCLID = "aggregate(zip_with(a, b, (x, y) -> pow(cast(x AS DOUBLE) - y, 2)), 0D, (s, v) -> s + v)"
_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> cast(x AS DOUBLE) * y), 0D, (s, v) -> s + v)"


def _quoted(names: list[str]) -> str:
    return ", ".join("'" + name.replace("'", "''") + "'" for name in names)


def _int32(name: str) -> str:
    return f"unhex(right(lpad(hex(cast(rint({name} * 1e7D) AS BIGINT)), 16, '0'), 8))"


_MEAN = "aggregate(transform(ring, p -> p.{0}), 0D, (t, v) -> t + v) / size(ring)"
_SQUASH = (1.0 - K.WGS84_FLATTENING) ** 2


def _lla_from_ecef() -> str:
    """The closed-form solution; each stage names its value for the next one."""
    a = K.LABEL_RADIUS_M
    b = a * (1.0 - K.WGS84_FLATTENING)
    e2 = 1.0 - (b / a) ** 2
    linear2 = a * a - b * b
    n = {k: f"{v!r}D" for k, v in {"a": a, "b2": b * b, "e2": e2, "one": 1.0 - e2, "l2": linear2, "s2": linear2 / (b * b)}.items()}
    stages = (
        ("g", f"pow(v.rho, 2) + {n['one']} * z * z - {n['e2']} * {n['l2']}"),
        ("f", f"54D * {n['b2']} * z * z"),
        ("c", f"{n['e2']} * {n['e2']} * v.f * v.rho * v.rho / (v.g * v.g * v.g)"),
        ("s", "pow(1D + v.c + sqrt(v.c * v.c + 2D * v.c), 1D / 3D)"),
        ("p", "v.f / (3D * pow(v.s + 1D / v.s + 1D, 2) * v.g * v.g)"),
        ("q", f"sqrt(1D + 2D * {n['e2']} * {n['e2']} * v.p)"),
        (
            "r",
            f"-(v.p * {n['e2']} * v.rho) / (1D + v.q) + sqrt(greatest(0D, 0.5D * {n['a']} * {n['a']} * (1D + 1D / v.q) "
            f"- v.p * {n['one']} * z * z / (v.q * (1D + v.q)) - 0.5D * v.p * v.rho * v.rho))",
        ),
        ("w", f"sqrt(pow(v.rho - {n['e2']} * v.r, 2) + {n['one']} * z * z)"),
    )
    row, known = "array(named_struct('rho', hypot(x, y)))", ["rho"]
    for name, value in stages:
        kept = ", ".join(f"'{k}', v.{k}" for k in known)
        row = f"transform({row}, v -> named_struct({kept}, '{name}', {value}))"
        known.append(name)
    latitude = f"degrees(atan((z + {n['s2']} * ({n['b2']} * z / ({n['a']} * v.w))) / v.rho))"
    lat = f"transform({row}, v -> {latitude})[0]"
    return f"named_struct('lat', IF(hypot(x, y) < 1e-9D, signum(z) * 90D, {lat}), 'lon', degrees(atan2(y, x)))"


SQL_FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "location_id": (
        "lat DOUBLE, lon DOUBLE",
        "STRING",
        "CASE WHEN abs(lat) > 90 OR abs(lon) > 180 THEN raise_error('lat/lon out of bounds') ELSE "
        f"left(sha1(concat(cast('{K.LOCATION_PREFIX}' AS BINARY), {_int32('lat')}, {_int32('lon')})), 12) END",
    ),
    "image_key": (
        "location STRING, heading INT",
        "STRING",
        f"format_string('{K.IMAGE_VERSION}/images/location_id=%s/heading=%03d.jpg', location, heading)",
    ),
    "haversine_km": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE, radius_m DOUBLE",
        "DOUBLE",
        f"{_HALF_KM} * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * "
        "cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    ),
    "game_score": (
        "km DOUBLE",
        "INT",
        f"cast(rint(least({K.SCORE_MAX}D, greatest(0D, {K.SCORE_MAX}D * "
        f"exp(-greatest(km, 0D) / {K.SCORE_DECAY_KM}D)))) AS INT)",
    ),
    "heading_distance": ("a DOUBLE, b DOUBLE", "DOUBLE", "abs(pmod(a - b + 180, 360) - 180)"),
    "heading_features": (
        "degrees DOUBLE",
        "ARRAY<ARRAY<DOUBLE>>",
        "transform(array(0, 90, 180, 270), q -> array(sin(radians(degrees + q)), cos(radians(degrees + q))))",
    ),
    "month_name": (
        "date_text STRING",
        "STRING",
        "coalesce(try_element_at(map("
        + ", ".join(f"'{code}', '{name}'" for code, name in K.MONTHS.items())
        + "), substring(date_text, 6, 2)), substring(date_text, 6, 2))",
    ),
    "drive_right": (
        "country STRING",
        "BOOLEAN",
        f"coalesce(country NOT IN ({_quoted(K.LEFT_DRIVING)}), false)",
    ),
    "country_display": (
        "country STRING",
        "STRING",
        "CASE WHEN country = 'United States Of America' THEN 'the United States' "
        f"WHEN country IN ({_quoted(K.ARTICLE_COUNTRIES)}) THEN concat('the ', country) ELSE country END",
    ),
    "is_valid": ("value STRING", "BOOLEAN", "coalesce(value RLIKE r'\\S', false)"),
    "round6": ("value DOUBLE", "DOUBLE", "rint(value * 1e6D) / 1e6D"),
    "euclidean": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"sqrt({_EUCLID})"),
    "cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        f"{_DOT.format('a', 'b')} / (sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')}))",
    ),
    "one_hot": (
        "idx INT, n INT",
        "ARRAY<INT>",
        "transform(sequence(0, n - 1), i -> cast(i = idx AS INT))",
    ),
    "ring_area": (
        "ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>",
        "DOUBLE",
        "abs(aggregate(zip_with(slice(ring, 1, size(ring) - 1), slice(ring, 2, size(ring) - 1), "
        "(p, q) -> p.x * q.y - q.x * p.y), 0D, (s, v) -> s + v)) / 2D",
    ),
    "ring_bbox": (
        "ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>",
        "STRUCT<min_x: DOUBLE, min_y: DOUBLE, max_x: DOUBLE, max_y: DOUBLE>",
        "named_struct('min_x', array_min(transform(ring, p -> p.x)), 'min_y', array_min(transform(ring, p -> p.y)), "
        "'max_x', array_max(transform(ring, p -> p.x)), 'max_y', array_max(transform(ring, p -> p.y)))",
    ),
    "ring_centroid": (
        "ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>",
        "STRUCT<x: DOUBLE, y: DOUBLE>",
        "aggregate(zip_with(slice(ring, 1, size(ring) - 1), slice(ring, 2, size(ring) - 1), (p, q) -> named_struct("
        "'a', p.x * q.y - q.x * p.y, 'x', (p.x + q.x) * (p.x * q.y - q.x * p.y), 'y', (p.y + q.y) * (p.x * q.y - q.x * p.y))), "
        "named_struct('a', 0D, 'x', 0D, 'y', 0D), (s, v) -> named_struct('a', s.a + v.a, 'x', s.x + v.x, 'y', s.y + v.y), "
        f"s -> IF(s.a = 0, named_struct('x', {_MEAN.format('x')}, 'y', {_MEAN.format('y')}), "
        "named_struct('x', s.x / (3D * s.a), 'y', s.y / (3D * s.a))))",
    ),
    "ecef_from_lla": (
        "lat DOUBLE, lon DOUBLE",
        "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>",
        "transform(array(named_struct('f', radians(lat), 'l', radians(lon), 'n', "
        f"{K.LABEL_RADIUS_M}D / sqrt(pow(cos(radians(lat)), 2) + {_SQUASH!r}D * pow(sin(radians(lat)), 2)))), "
        "p -> named_struct('x', p.n * cos(p.f) * cos(p.l), 'y', p.n * cos(p.f) * sin(p.l), "
        f"'z', p.n * {_SQUASH!r}D * sin(p.f)))[0]",
    ),
    "lla_from_ecef": ("x DOUBLE, y DOUBLE, z DOUBLE", "STRUCT<lat: DOUBLE, lon: DOUBLE>", _lla_from_ecef()),
    "multitask_labels": (
        "elevation DOUBLE, population DOUBLE, temperature DOUBLE, temperature_range DOUBLE, precipitation DOUBLE, precipitation_range DOUBLE",
        "ARRAY<DOUBLE>",
        "array(elevation, population, temperature, temperature_range, precipitation, precipitation_range)",
    ),
}


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the functions in the session and return their names."""
    for name, (arguments, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {returns} RETURN {body}"
        )
    return [prefix + name for name in SQL_FUNCTIONS]
