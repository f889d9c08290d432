"""Registration, rounding, and the fixtures as fields and as SQL.

Sums in another order differ in their last bits, so both sides are rounded to
``DIGITS``; adding zero makes -0.0 and 0.0 one value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..field import Field
from ..session import ship_package
from ..sources import tables

DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FIXTURES = {
    "users": "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t, CAST(value AS DOUBLE) AS v FROM events",
    "span": "SELECT unnest(range(0, (SELECT date_diff('hour', min(date_trunc('hour', ts)), max(date_trunc('hour', ts))) + 1 FROM events))) AS t",
    "hourly": """SELECT CAST(s.t AS INTEGER) AS t, coalesce(x.s, 0) AS v FROM span s LEFT JOIN (
        SELECT date_diff('hour', (SELECT min(date_trunc('hour', ts)) FROM events), date_trunc('hour', ts)) AS t, sum(value) AS s FROM events GROUP BY 1) x USING (t)""",
    "dayhour": "SELECT CAST(floor(t / 24) AS INTEGER) AS day, t % 24 AS hour, v FROM hourly",
    "types": """SELECT k.event_type, CAST(s.t AS INTEGER) AS t, coalesce(x.s, 0) AS v FROM span s CROSS JOIN (SELECT DISTINCT event_type FROM events) k LEFT JOIN (
        SELECT event_type, date_diff('hour', (SELECT min(date_trunc('hour', ts)) FROM events), date_trunc('hour', ts)) AS t, sum(value) AS s FROM events GROUP BY ALL) x
        ON x.t = s.t AND x.event_type = k.event_type""",
    "cells": "SELECT CAST(l_orderkey % 18 * 10 - 85 AS DOUBLE) AS lat, CAST(l_partkey % 36 * 10 AS DOUBLE) AS lon, CAST(l_linenumber * 100 AS DOUBLE) AS lev, date_trunc('month', l_shipdate) AS month, l_quantity FROM lineitem",
    "grid": "SELECT lat, lon, lev, avg(l_quantity) AS v FROM cells GROUP BY ALL",
    "flat": "SELECT lat, lon, avg(l_quantity) AS v FROM cells GROUP BY ALL",
    "monthly": "SELECT month, lat, avg(l_quantity) AS v FROM cells GROUP BY ALL",
    "lonw": "SELECT lon, radians(hi - lo) AS w FROM (SELECT lon, coalesce((lag(lon) OVER o + lon) / 2, lon) AS lo, coalesce((lead(lon) OVER o + lon) / 2, lon) AS hi FROM (SELECT DISTINCT lon FROM cells) WINDOW o AS (ORDER BY lon))",
    "latw": "SELECT lat, radians(hi - lo) * cos(radians(lat)) AS w FROM (SELECT lat, coalesce((lag(lat) OVER o + lat) / 2, lat) AS lo, coalesce((lead(lat) OVER o + lat) / 2, lat) AS hi FROM (SELECT DISTINCT lat FROM cells) WINDOW o AS (ORDER BY lat))",
    "levw": "SELECT lev, (hi - lo) * 100 / 9.80665 AS w FROM (SELECT lev, coalesce((lag(lev) OVER o + lev) / 2, lev) AS lo, coalesce((lead(lev) OVER o + lev) / 2, lev) AS hi FROM (SELECT DISTINCT lev FROM cells) WINDOW o AS (ORDER BY lev))",
    "comps": "SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
}
_NEEDS = {"hourly": ("span",), "types": ("span",), "dayhour": ("span", "hourly"), **{k: ("cells",) for k in ("grid", "flat", "monthly", "lonw", "latw", "levw")}}


def with_fixtures(names: tuple[str, ...], body: str) -> str:
    """``body`` after the CTEs it uses."""
    wanted = dict.fromkeys(x for n in names for x in (*_NEEDS.get(n, ()), n))
    ctes = [f"{n} AS ({FIXTURES[n]})" for n in FIXTURES if n in wanted]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join([*ctes, body[15:]])}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join([*ctes, body[5:]])}"
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def query(sql: str | None = None, *fixtures: str):
    """Register a query under its function's name, with SQL over ``fixtures``."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf_dir)

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLE_SQL[function.__name__] = with_fixtures(fixtures, sql)
        return function

    return register


def r(c: Column | str, digits: int = DIGITS) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def r_scaled(c: str, digits: int = DIGITS) -> Column:
    """As DuckDB rounds: the scaled double, halves away from zero.

    ``F.round`` goes by the decimals that a double prints as and so takes another way
    where they end in a five; for columns whose doubles are the same in both engines.
    """
    scale = 10.0**digits
    y = F.col(c) * scale
    whole = F.floor(F.abs(y))
    half_up = whole + F.when(F.abs(y) - whole >= 0.5, 1).otherwise(0)
    # beyond 2^52 every double is whole
    return F.when(F.abs(y) < 2.0**52, F.signum(y) * half_up).otherwise(y) / scale + 0.0


def rounded(x: Field | DataFrame, digits: int = DIGITS, by: Callable[..., Column] = r) -> DataFrame:
    """All double columns rounded."""
    df = x.df.select(*x.dims, x.value) if isinstance(x, Field) else x
    return df.select(*(by(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def users(spark: SparkSession, sf_dir: str) -> Field:
    return Field.of(tables.user_series(spark, sf_dir), ("user_id", "t"), units="m", name="value", coord_units={"t": "s"})


def hourly(spark: SparkSession, sf_dir: str) -> Field:
    return Field.of(tables.hourly(spark, sf_dir), ("t",), coord_units={"t": "hour"})


def types(spark: SparkSession, sf_dir: str, kind: str) -> Field:
    df = tables.hourly(spark, sf_dir, "event_type").where(F.col("event_type") == kind).drop("event_type")
    return Field.of(df, ("t",), coord_units={"t": "hour"})


def day_hour(spark: SparkSession, sf_dir: str) -> Field:
    return Field.of(tables.day_hour(spark, sf_dir), ("day", "hour"))


def grid(spark: SparkSession, sf_dir: str) -> Field:
    units = {"lat": "degN", "lon": "degE", "lev": "hPa"}
    return Field.of(tables.grid(spark, sf_dir, "lat", "lon", "lev"), ("lat", "lon", "lev"), units="K", name="temperature", coord_units=units)


def flat(spark: SparkSession, sf_dir: str) -> Field:
    return Field.of(tables.grid(spark, sf_dir, "lat", "lon"), ("lat", "lon"), units="m s^-1", name="momentum", coord_units={"lat": "degN", "lon": "degE"})


def monthly(spark: SparkSession, sf_dir: str) -> Field:
    return Field.of(tables.grid(spark, sf_dir, "month", "lat"), ("month", "lat"), units="K", coord_units={"lat": "degN"})


def components(spark: SparkSession, sf_dir: str) -> Field:
    return Field.of(tables.components(spark, sf_dir), ("vec_id", "i"))


def sql_r(expr: str, name: str = "v", digits: int = DIGITS) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def sql_truncated(lo: float, hi: float) -> str:
    """CTEs over ``grid``: ``cut`` with rows interpolated at the limits of lat in each
    series, and ``clipped`` with the width of each row's cell."""
    return f"""seg AS (SELECT lon, lev, lat AS x0, v AS y0, lead(lat) OVER o AS x1, lead(v) OVER o AS y1, lead(lat, 2) OVER o IS NULL AS last FROM grid WINDOW o AS (PARTITION BY lon, lev ORDER BY lat)),
cut AS (SELECT lon, lev, CAST(x AS DOUBLE) AS lat, y0 + (x - x0) * (y1 - y0) / (x1 - x0) AS v FROM seg CROSS JOIN (VALUES ({lo}), ({hi})) t(x) WHERE x1 IS NOT NULL AND x >= x0 AND (x < x1 OR last AND x <= x1)
  UNION ALL SELECT lon, lev, lat, v FROM grid WHERE lat > {lo} AND lat < {hi}),
clipped AS (SELECT lat, (coalesce(lead(lat) OVER o, lat) - coalesce(lag(lat) OVER o, lat)) / 2 AS w
  FROM (SELECT DISTINCT lat FROM cells WHERE lat > {lo} AND lat < {hi} UNION SELECT {lo} UNION SELECT {hi}) WINDOW o AS (ORDER BY lat))"""
