"""Views over the given tables that stand for points, cells, images and vectors.

Each view is one SQL text for both engines: ``@name`` is a table or view, ``@D`` a
double literal suffix, ``@/`` integer division and ``@each4`` one row for each of 0..3.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

_POINT = "((({k}*7919)%170001)-85000)/1000.0@D AS lat, ((({k}*104729)%360000)-180000)/1000.0@D AS lon"
_COUNTRY = (
    "CASE {k} % 7 WHEN 0 THEN 'Japan' WHEN 1 THEN 'France' WHEN 2 THEN NULL WHEN 3 THEN 'United States Of America' "
    "WHEN 4 THEN 'Bahamas' WHEN 5 THEN 'United Kingdom' ELSE 'Netherlands' END"
)

VIEWS = {
    # points
    "loc_points": "SELECT c_custkey AS point_id, c_nationkey AS country_id, "
    + _POINT.format(k="c_custkey")
    + " FROM @customer",
    "named_points": "SELECT point_id, country_id, lat, lon, "
    + _COUNTRY.format(k="point_id")
    + " AS country, CASE point_id % 3 WHEN 0 THEN NULL ELSE concat('region ', CAST(country_id AS STRING)) END AS region, "
    "CASE point_id % 4 WHEN 0 THEN NULL ELSE concat('Town ', CAST(point_id % 100 AS STRING)) END AS town, "
    "CASE point_id % 5 WHEN 0 THEN NULL ELSE 'A polar tundra climate' END AS climate, "
    "CASE point_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'May' ELSE 'June' END AS month, "
    "CASE point_id % 8 WHEN 0 THEN NULL ELSE concat('2023-0', CAST(1 + point_id % 9 AS STRING)) END AS capture_date "
    "FROM @loc_points",
    "cells": "SELECT n_nationkey AS geocell_index, n_nationkey % 5 AS admin0, (n_nationkey @/ 5)*36-72.0@D AS clat, "
    "(n_nationkey % 5)*72-144.0@D AS clon FROM @nation",
    "boxes": "SELECT geocell_index, admin0, clat, clon, clon-36.0@D AS min_x, clat-18.0@D AS min_y, "
    "clon+36.0@D AS max_x, clat+18.0@D AS max_y FROM @cells",
    "quarters": "SELECT 0 AS q UNION ALL SELECT 1 AS q UNION ALL SELECT 2 AS q UNION ALL SELECT 3 AS q",
    "admin2": "SELECT CAST(geocell_index AS BIGINT)*4 + q AS cell_id, admin0 AS country_id, geocell_index AS admin1_id, "
    "min_x + (q % 2)*36.0@D AS min_x, min_y + (q @/ 2)*18.0@D AS min_y, "
    "min_x + (q % 2)*36.0@D + 36.0@D AS max_x, min_y + (q @/ 2)*18.0@D + 18.0@D AS max_y "
    "FROM (SELECT b.*, @each4 AS q FROM @boxes b) x",
    "kites": "SELECT point_id, country_id, lat, lon, 2.0@D + point_id % 5 AS r FROM @loc_points",
    "point_cells": "SELECT point_id, country_id AS cell_id, lat, lon FROM @loc_points",
    "coverage": "SELECT point_id AS cov_id, CASE point_id % 3 WHEN 0 THEN lat + 0.0003@D ELSE lat + 0.01@D END AS lat, "
    "lon FROM @loc_points",
    "guesses": "SELECT p.point_id, p.country_id, p.lat, p.lon, c.clat AS pred_lat, c.clon AS pred_lon, "
    "((p.point_id % 97)+1)/100.0@D AS top1_prob FROM @loc_points p JOIN @cells c ON c.geocell_index = p.point_id % 25",
    "point_lines": "SELECT point_id, CASE WHEN point_id % 11 = 0 THEN '' WHEN point_id % 7 = 0 THEN 'x,y' "
    "WHEN point_id % 5 = 0 THEN concat(CAST(lat_m AS STRING), ' ', CAST(lon_m AS STRING)) "
    "ELSE concat(CAST(lat_m AS STRING), ',', CAST(lon_m AS STRING)) END AS line FROM "
    "(SELECT c_custkey AS point_id, ((c_custkey*7919)%170001)-85000 AS lat_m, ((c_custkey*104729)%360000)-180000 AS lon_m "
    "FROM @customer) m",
    # images
    "image_rows": "SELECT user_id AS location_id, CAST((event_id%4)*90 AS INT) AS heading, event_id AS ord, "
    "CAST(event_id%2=1 AS INT) AS is_new, value, substring(CAST(ts AS STRING), 1, 10) AS batch_date FROM @events",
    "image_names": "SELECT event_id, concat('/data/in/', printf('%.7f', lat), '_', printf('%.7f', lon), '_', "
    "CAST((event_id%4)*90 AS STRING), '_', substring(CAST(ts AS STRING), 1, 7), '_p_', CAST(event_id AS STRING), "
    "CASE WHEN event_id % 13 = 0 THEN '.txt' WHEN event_id % 2 = 0 THEN '.JPG' ELSE '.jpg' END) AS path "
    "FROM (SELECT event_id, ts, " + _POINT.format(k="user_id") + " FROM @events) e",
    # vectors
    "members": "SELECT vec_id AS point_idx, label AS geocell_index, CAST(vec_id%4 AS INT) AS cluster_id, embedding, "
    + _POINT.format(k="vec_id")
    + " FROM @embeddings",
    "samples": "SELECT vec_id AS sample_id, embedding, label AS true_cell, " + _POINT.format(k="vec_id") + " FROM @embeddings",
    "scored": "SELECT l.doc_id AS id, l.quality AS y, d.n_chars AS score FROM @labels l JOIN @documents d ON d.doc_id = l.doc_id",
    # a climate raster of 5 degree pixels whose values come from the points inside
    "raster": "SELECT CAST(floor((90.0@D-lat)/5.0@D) AS INT) AS row, CAST(floor((lon+180.0@D)/5.0@D) AS INT) AS col, "
    "CAST(count(*) % 33 AS INT) AS value FROM @loc_points "
    "WHERE lat < 40 GROUP BY 1, 2",
}

_NAME = re.compile(r"@([a-z_0-9]+)")


def _render(text: str, spark: bool) -> str:
    text = text.replace("@D", "D" if spark else "::DOUBLE").replace("@/", "div" if spark else "//")
    text = text.replace("@each4", "explode(array(0, 1, 2, 3))" if spark else "unnest([0, 1, 2, 3])")
    if spark:
        text = text.replace("printf(", "format_string(")
    else:
        text = text.replace("AS STRING)", "AS VARCHAR)")
    return _NAME.sub(r"{\1}" if spark else r"\1", text)


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(n for n in _NAME.findall(text.replace("@D", "").replace("@/", "")) if n in VIEWS or n in TABLES))


class Tables:
    """The given tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(_render(text, True), **{n: getattr(self, n) for n in _needs(text)})


def r4(expr: str) -> str:
    """Half-even rounding to four decimals in oracle SQL."""
    return f"(round_even(({expr}) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE)"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str, radius_m: float) -> str:
    return (
        f"({2.0 * radius_m / 1000.0!r}::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({lat2}-{lat1})/2),2) + "
        f"cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2)))))"
    )


def oracle(text: str) -> str:
    """Complete oracle SQL: the views it names (as ``@view``) are put in front."""
    order: list[str] = []

    def visit(body: str) -> None:
        for name in _needs(body):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(text)
    body = _render(text, False).strip()
    head = ", ".join(f"{name} AS ({_render(VIEWS[name], False)})" for name in order)
    if not head:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{head}, {body[len(start):]}"
    return f"WITH {head} {body}"
