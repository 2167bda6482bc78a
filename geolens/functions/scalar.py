"""Scalar column expressions: identifiers, distances, scores, labels, captions.

Everything here is a built-in expression, so it is folded into the surrounding
stage and never leaves the JVM.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolens import constants as K


def _col(value: Column | str | float) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---- identifiers -----------------------------------------------------------


def _int32_bytes(degrees: Column) -> Column:
    scaled = F.rint(degrees * F.lit(1e7)).cast("bigint")
    return F.unhex(F.right(F.lpad(F.hex(scaled), 16, "0"), F.lit(8)))


def location_id(lat: Column, lon: Column, hex_len: int = 12) -> Column:
    """Stable id of a coordinate pair quantised to 1e-7 degrees."""
    lat, lon = _col(lat), _col(lon)
    outside = (F.abs(lat) > 90.0) | (F.abs(lon) > 180.0) | F.isnan(lat) | F.isnan(lon)
    payload = F.concat(F.lit(K.LOCATION_PREFIX).cast("binary"), _int32_bytes(lat), _int32_bytes(lon))
    return F.when(outside, F.raise_error(F.lit("lat/lon out of bounds"))).otherwise(
        F.left(F.sha1(payload), F.lit(hex_len))
    )


def image_key(location: Column, heading: Column, version: str = K.IMAGE_VERSION) -> Column:
    return F.format_string(f"{version}/images/location_id=%s/heading=%03d.jpg", location, heading.cast("int"))


def image_uri(path: Column, bucket: str) -> Column:
    """Full object address; keys without a scheme are placed in ``bucket``."""
    return F.when(path.startswith("s3://"), path).otherwise(
        F.concat(F.lit(f"s3://{bucket}/"), F.regexp_replace(path, "^/+", ""))
    )


def local_path(uri: Column, dest: str) -> Column:
    return F.concat(F.lit(dest.rstrip("/") + "/"), F.substring_index(uri, "images/", -1))


# ---- distances and coordinates ----------------------------------------------


def haversine_km(lat1, lon1, lat2, lon2, radius_m: float = K.SCORE_RADIUS_M) -> Column:
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * radius_m / 1000.0) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def unit_xyz(lat: Column, lon: Column) -> list[Column]:
    """Coordinates on the unit sphere: chord length grows with great-circle distance."""
    lat, lon = F.radians(_col(lat)), F.radians(_col(lon))
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def ecef_from_lla(lat: Column, lon: Column) -> Column:
    """Earth-centred coordinates of a point on the ellipsoid surface."""
    phi, lam = F.radians(_col(lat)), F.radians(_col(lon))
    squash = (1.0 - K.WGS84_FLATTENING) ** 2
    normal = F.lit(K.LABEL_RADIUS_M) / F.sqrt(F.cos(phi) * F.cos(phi) + squash * F.sin(phi) * F.sin(phi))
    return F.struct(
        (normal * F.cos(phi) * F.cos(lam)).alias("x"),
        (normal * F.cos(phi) * F.sin(lam)).alias("y"),
        (normal * squash * F.sin(phi)).alias("z"),
    )


def lla_from_ecef(x: Column, y: Column, z: Column, method: str = "closed") -> Column:
    """Latitude and longitude of an earth-centred point.

    ``closed`` is the closed-form solution, ``iterated`` the parametric-latitude
    fixed point.  On the polar axis the latitude is exactly +-90.
    """
    a = K.LABEL_RADIUS_M
    b = a * (1.0 - K.WGS84_FLATTENING)
    e2 = 1.0 - (b / a) ** 2
    rho = F.hypot(x, y)
    solve = {"closed": _closed_latitude, "iterated": _iterated_latitude}[method]
    lat = F.when(rho < 1e-9, F.signum(z) * 90.0).otherwise(F.degrees(solve(rho, z, a, b, e2)))
    return F.struct(lat.alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"))


def _closed_latitude(rho: Column, z: Column, a: float, b: float, e2: float) -> Column:
    linear2 = a * a - b * b
    second2 = linear2 / (b * b)

    def stage_one(g: Column) -> Column:
        f = 54.0 * b * b * z * z
        c = e2 * e2 * f * rho * rho / (g * g * g)
        s = F.pow(1.0 + c + F.sqrt(c * c + 2.0 * c), F.lit(1.0 / 3.0))
        spread = s + 1.0 / s + 1.0
        return f / (3.0 * spread * spread * g * g)

    def stage_two(p: Column) -> Column:
        q = F.sqrt(1.0 + 2.0 * e2 * e2 * p)
        under = 0.5 * a * a * (1.0 + 1.0 / q) - p * (1.0 - e2) * z * z / (q * (1.0 + q)) - 0.5 * p * rho * rho
        return -(p * e2 * rho) / (1.0 + q) + F.sqrt(F.greatest(F.lit(0.0), under))

    def latitude(r0: Column) -> Column:
        v = F.sqrt(F.pow(rho - e2 * r0, F.lit(2.0)) + (1.0 - e2) * z * z)
        return F.atan((z + second2 * (b * b * z / (a * v))) / rho)

    g = rho * rho + (1.0 - e2) * z * z - e2 * linear2
    return let(g, lambda gv: let(stage_one(gv), lambda p: let(stage_two(p), latitude)))


def _iterated_latitude(rho: Column, z: Column, a: float, b: float, e2: float) -> Column:
    """Fold of a few rounds over the angle pair (cos, sin) of the parametric latitude."""
    lift = b * e2 / (1.0 - e2)

    def angle(up: Column, out: Column) -> Column:
        size = F.hypot(up, out)
        return F.struct((out / size).alias("c"), (up / size).alias("s"), F.lit(False).alias("done"))

    def geodetic(beta: Column) -> tuple[Column, Column]:
        up = z + lift * beta["s"] * beta["s"] * beta["s"]
        out = rho - a * e2 * beta["c"] * beta["c"] * beta["c"]
        return up, out

    def step(beta: Column, _round: Column) -> Column:
        up, out = geodetic(beta)

        def settle(after: Column) -> Column:
            moved = F.hypot(after["c"] - beta["c"], after["s"] - beta["s"])
            return F.struct(
                after["c"].alias("c"), after["s"].alias("s"), (moved <= K.FIXED_POINT_PRECISION).alias("done")
            )

        return F.when(beta["done"], beta).otherwise(let(angle(b * up, a * out), settle))

    def latitude(beta: Column) -> Column:
        up, out = geodetic(beta)
        return F.atan2(up, out)

    start = angle(b * z * (1.0 + lift / F.hypot(rho, z)), a * rho)
    return F.aggregate(F.sequence(F.lit(1), F.lit(K.FIXED_POINT_ROUNDS)), start, step, latitude)


def game_score(km: Column, decay_km: float = K.SCORE_DECAY_KM) -> Column:
    raw = F.lit(K.SCORE_MAX) * F.exp(-F.greatest(km, F.lit(0.0)) / decay_km)
    return F.rint(F.least(F.lit(K.SCORE_MAX), F.greatest(F.lit(0.0), raw))).cast("int")


def heading_distance(a: Column, b: Column) -> Column:
    """Smallest angle between two headings in degrees."""
    return F.abs(F.pmod(a - b + 180, F.lit(360)) - 180)


def heading_features(degrees: Column) -> Column:
    """Sine and cosine of a heading and its three quarter turns."""
    return F.array(
        *[
            F.array(F.sin(F.radians(degrees + 90.0 * quarter)), F.cos(F.radians(degrees + 90.0 * quarter)))
            for quarter in range(4)
        ]
    )


# ---- labels -----------------------------------------------------------------


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(item) for pair in values.items() for item in pair])


def lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(_literal_map(values), key)


def month_name(date_text: Column) -> Column:
    """Month of an ISO date text; an unknown code is passed through."""
    code = F.substring(date_text, 6, 2)
    return F.coalesce(lookup(K.MONTHS, code), code)


def is_valid(value: Column, floating: bool = False) -> Column:
    kept = value.isNotNull() & value.cast("string").rlike(r"\S")
    return kept & ~F.isnan(value) if floating else kept


def month_features(batch_date: Column, capture_date: Column) -> Column:
    def usable(text: Column) -> Column:
        return F.coalesce(is_valid(text), F.lit(False)) & (F.length(text) >= 7)

    return F.when(usable(batch_date), month_name(batch_date)).when(usable(capture_date), month_name(capture_date))


def drive_right(country: Column, left_driving: list[str] = K.LEFT_DRIVING) -> Column:
    return F.coalesce(~country.isin(left_driving), F.lit(False))


def country_display(country: Column) -> Column:
    short = F.when(country == "United States Of America", F.lit("United States")).otherwise(country)
    return F.when(short.isin(K.ARTICLE_COUNTRIES), F.concat(F.lit("the "), short)).otherwise(short)


def multitask_labels(*columns: Column) -> Column:
    """Elevation, population, mean and range of temperature and precipitation."""
    return F.array(*[c.cast("double") for c in columns])


def round6(value: Column) -> Column:
    """Half-even rounding to six decimals."""
    return F.rint(value * F.lit(1e6)) / F.lit(1e6)


def one_hot(index: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == index).cast("int"))


def repair_region(country: Column, name: Column, level: int) -> Column:
    """Replace the placeholder name of regions known to be unnamed."""
    fixed = lookup(K.REGION_REPAIRS[level], country)
    return F.when(name == "NA", F.coalesce(fixed, name)).otherwise(name)


def fill_optional_columns(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks, as typed NULLs."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    missing = {f.name: F.lit(None).cast(f.dataType) for f in wanted.fields if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


# ---- reproducible randomness and captions -----------------------------------


def hash_uniform(key: Column, seed: int | str, salt: str = "") -> Column:
    """Number in [0, 1) fixed by seed, salt and key, whatever the partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{salt}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def caption(df: DataFrame, seed: int = 42, key: str = "location_id", location_optional: bool = False) -> DataFrame:
    """Add a ``caption`` built from country, region, town, climate, side and month."""
    df = fill_optional_columns(
        df,
        "country string, region string, town string, climate string, drive_right boolean, month string, "
        "capture_date string, lat double, lon double",
    )

    def chance(salt: str, share: float) -> Column:
        return hash_uniform(F.col(key), seed, salt) > F.lit(1.0 - share)

    def present(name: str) -> Column:
        return is_valid(F.col(name))

    def piece(condition: Column, *parts: Column | str) -> Column:
        text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        return F.when(condition, text).otherwise(F.lit(""))

    country = country_display(F.col("country"))
    has_country = is_valid(country)
    region = piece(present("region") & chance("region", 0.6), "in the region of ", F.col("region"), " ")
    town = piece(present("town") & chance("town", 0.4), "close to the town of ", F.col("town"), " ")
    placed = F.concat(F.lit("A Street View photo "), town, region, F.lit("in "), country, F.lit("."))
    has_point = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    around = F.format_string(
        "A Street View photo taken around latitude %.3f, longitude %.3f.", F.col("lat"), F.col("lon")
    )
    where = F.when(has_country, placed).when(has_point, around).otherwise(F.lit("A Street View photo."))

    climate = piece(
        present("climate") & chance("climate", 0.4), " This location has ", F.lower(F.col("climate")), "."
    )
    if location_optional:
        where = F.when((climate != "") & ~chance("location", 0.7), F.lit("")).otherwise(where)
    side = piece(
        F.col("drive_right").isNotNull() & has_country & (climate == "") & chance("side", 0.3),
        " In this location, people drive on the ",
        F.when(F.col("drive_right"), "right").otherwise("left"),
        " side of the road.",
    )
    taken = " The photo was taken in "
    by_month = present("month") & chance("month", 0.3)
    by_capture = present("capture_date") & chance("capture", 0.3)
    month = F.when(by_month, F.concat(F.lit(taken), F.col("month"), F.lit("."))).otherwise(
        piece(by_capture, taken, month_name(F.col("capture_date")), ".")
    )
    # The optional sentences come in an order drawn per row.
    shuffled = F.array_sort(
        F.array(
            *[
                F.struct(hash_uniform(F.col(key), seed, f"order-{name}").alias("rank"), text.alias("text"))
                for name, text in (("climate", climate), ("side", side), ("month", month))
            ]
        )
    )
    tail = F.array_join(F.transform(shuffled, lambda s: s["text"]), "")
    return df.withColumn("caption", F.trim(F.concat(where, tail)))


# ---- vectors ----------------------------------------------------------------


def euclidean(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, d: acc + d * d))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit_vector(a: Column) -> Column:
    """The vector at length one, in doubles; the zero vector stays."""
    length = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))
