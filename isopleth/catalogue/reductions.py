"""Reductions: means, weighted integrals and averages, anomalies, histograms, groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..field import Field
from ..operators import reduce as red
from ..sources import tables
from .base import flat, grid, monthly, query, rounded, sql_r, users

_KM2 = "6371.0088 * 6371.0088"


@query(f"SELECT lat, lev, {sql_r('avg(v)')} FROM grid GROUP BY lat, lev", "grid")
def mean_dim(spark, sf_dir):
    return rounded(red.mean(grid(spark, sf_dir), "lon"))


@query(f"SELECT lat, lev, {sql_r('sum(v)')} FROM grid GROUP BY lat, lev", "grid")
def sum_dim(spark, sf_dir):
    return rounded(red.total(grid(spark, sf_dir), "lon"))


@query(f"SELECT lat, lev, {sql_r('sum(g.v * w.w * f.v) / sum(w.w * f.v)')} FROM grid g JOIN lonw w USING (lon) JOIN flat f USING (lat, lon) GROUP BY lat, lev", "grid", "flat", "lonw")
def weighted_mean(spark, sf_dir):
    return rounded(red.average(grid(spark, sf_dir), "lon", weight=flat(spark, sf_dir)))


@query(f"SELECT lev, {sql_r('sum(v * cos(radians(lat))) / sum(cos(radians(lat)))')} FROM grid GROUP BY lev", "grid")
def geomean(spark, sf_dir):
    return rounded(red.geomean(grid(spark, sf_dir)))


@query(f"SELECT lev, {sql_r('sum(v * cos(radians(lat))) / sum(cos(radians(lat)))')} FROM grid WHERE lon - 5 >= 20 AND lon + 5 <= 200 AND lat - 5 >= -40 AND lat + 5 <= 60 GROUP BY lev", "grid")
def geomean_box(spark, sf_dir):
    return rounded(red.geomean(grid(spark, sf_dir), box=(20, -40, 200, 60)))


@query(f"SELECT lev, {sql_r(f'sum(v * a.w * o.w) * {_KM2} / 1e6')} FROM grid JOIN latw a USING (lat) JOIN lonw o USING (lon) GROUP BY lev", "grid", "latw", "lonw")
def integral_area(spark, sf_dir):
    f = red.integral(grid(spark, sf_dir), "area")
    return rounded(f.with_value(f.v / 1e6))


@query(f"SELECT lev, {sql_r('sum(v * a.w * o.w) / sum(a.w * o.w)')} FROM grid JOIN latw a USING (lat) JOIN lonw o USING (lon) GROUP BY lev", "grid", "latw", "lonw")
def average_area(spark, sf_dir):
    return rounded(red.average(grid(spark, sf_dir), "area"))


@query(f"SELECT {sql_r('sum(v * a.w * o.w * e.w) / sum(a.w * o.w * e.w)')} FROM grid JOIN latw a USING (lat) JOIN lonw o USING (lon) JOIN levw e USING (lev)", "grid", "latw", "lonw", "levw")
def average_volume(spark, sf_dir):
    return rounded(red.average(grid(spark, sf_dir), "volume"))


@query(
    f"""SELECT lat, lon, {sql_r('v - m')} FROM flat CROSS JOIN (SELECT sum(v * a.w * o.w) / sum(a.w * o.w) AS m FROM flat JOIN latw a USING (lat) JOIN lonw o USING (lon))""",
    "flat", "latw", "lonw",
)
def anomaly(spark, sf_dir):
    return rounded(red.anomaly(flat(spark, sf_dir), "area"))


_UP = "sum(v * w) OVER (PARTITION BY lat, lon ORDER BY lev{})"
_UPW = "sum(w) OVER (PARTITION BY lat, lon ORDER BY lev{})"


@query(f"SELECT lat, lon, lev, {sql_r(_UP.format(''))} FROM grid JOIN levw USING (lev)", "grid", "levw")
def cumintegral(spark, sf_dir):
    return rounded(red.cumulative(grid(spark, sf_dir), "lev"))


@query(f"SELECT lat, lon, lev, {sql_r(_UP.format(' DESC'))} FROM grid JOIN levw USING (lev)", "grid", "levw")
def cumintegral_reverse(spark, sf_dir):
    return rounded(red.cumulative(grid(spark, sf_dir), "lev", reverse=True))


@query(f"SELECT lat, lon, lev, {sql_r(_UP.format('') + ' / ' + _UPW.format(''))} FROM grid JOIN levw USING (lev)", "grid", "levw")
def cumaverage(spark, sf_dir):
    return rounded(red.cumulative(grid(spark, sf_dir), "lev", "average"))


@query(
    f"SELECT lat, lon, lev, {sql_r('sum(v * w) OVER (PARTITION BY lat, lon) / sum(w) OVER (PARTITION BY lat, lon) - ' + _UP.format('') + ' / ' + _UPW.format(''))} FROM grid JOIN levw USING (lev)",
    "grid", "levw",
)
def cumanomaly(spark, sf_dir):
    return rounded(red.cumulative(grid(spark, sf_dir), "lev", "anomaly"))


@query(f"SELECT month, lat, {sql_r('v / avg(v) OVER (PARTITION BY lat)')} FROM monthly", "monthly")
def normalize_time(spark, sf_dir):
    return rounded(red.normalize(monthly(spark, sf_dir), "month"))


@query(
    """WITH ends AS (SELECT min(v) AS a, max(v) AS b, (max(v) - min(v)) / 10 AS h FROM users),
    spots AS (SELECT user_id, CAST(least(floor((v - a) / h), 9) AS INTEGER) AS k FROM users, ends),
    counts AS (SELECT user_id, k, count(*) AS c FROM spots GROUP BY ALL)
    SELECT user_id, round(a + (k + 0.5) * h, 6) + 0.0 AS bins, CAST(coalesce(c, 0) AS BIGINT) AS count
    FROM (SELECT DISTINCT user_id FROM users) CROSS JOIN ends CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(10)) LEFT JOIN counts USING (user_id, k)""",
    "users",
)
def hist_even(spark, sf_dir):
    return rounded(red.histogram(users(spark, sf_dir), "t", 11))


@query(
    """WITH edges AS (SELECT * FROM (VALUES (0, 0.0, 1.0), (1, 1.0, 5.0), (2, 5.0, 20.0), (3, 20.0, 100.0), (4, 100.0, 1000.0)) e(k, a, b))
    SELECT user_id, CAST((a + b) / 2 AS DOUBLE) AS bins, CAST(count(*) FILTER (v >= a AND (v < b OR k = 4 AND v <= b)) AS BIGINT) AS count
    FROM users CROSS JOIN edges GROUP BY user_id, a, b""",
    "users",
)
def hist_edges(spark, sf_dir):
    return rounded(red.histogram(users(spark, sf_dir), "t", [0, 1, 5, 20, 100, 1000]))


@query(f"SELECT v > 25 AS above, lev, count(*) AS n, {sql_r('avg(v)', 'mean')} FROM grid GROUP BY 1, 2", "grid")
def groupby_threshold(spark, sf_dir):
    f = grid(spark, sf_dir)
    return rounded(red.groupby(f, f.v > 25, "above", F.count("*").alias("n"), F.avg(f.v).alias("mean"), keep=("lev",)))


@query(
    """WITH qs AS (SELECT l_orderkey, l_linenumber, pow(l_quantity / 51.0, 3) AS q FROM lineitem),
    ps AS (SELECT round(2 * least(q, 1 - q), 12) AS p, count(*) AS c FROM qs GROUP BY 1),
    ranked AS (SELECT p, sum(c) OVER (ORDER BY p) AS upto, sum(c) OVER () AS n FROM ps),
    lim AS (SELECT max(p) / 2 AS t FROM ranked WHERE p <= (upto - 1) * 0.1 / n)
    SELECT l_orderkey, l_linenumber, coalesce(least(q, 1 - q) <= t, false) AS keep FROM qs CROSS JOIN lim""",
)
def wilks_fdr(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "lineitem")
    return red.wilks(lines.select("l_orderkey", "l_linenumber", F.pow(F.col("l_quantity") / 51.0, F.lit(3)).alias("q")), "q").drop("q")


@query(f"SELECT lat, lon, {sql_r('f.v + g.v', 'v')} FROM flat f JOIN (SELECT lat, lon, v FROM grid WHERE lev = 300) g USING (lat, lon)", "flat", "grid")
def arithmetic_aligned(spark, sf_dir):
    level = Field.of(grid(spark, sf_dir).df.where("lev = 300"), ("lat", "lon"), units="m s^-1")
    return rounded(flat(spark, sf_dir) + level)
