"""Selection, interpolation, truncation, padding, hemispheres, times and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..field import Field
from ..functions.sphere import calendar
from ..operators import grid as grids, select as sel
from ..sources import tables
from .base import flat, grid, monthly, query, rounded, sql_r, sql_truncated


@query(f"SELECT lat, lon, lev, {sql_r('v')} FROM grid WHERE lat BETWEEN -45 AND 45", "grid")
def sel_range(spark, sf_dir):
    return rounded(sel.sel(grid(spark, sf_dir), lat=slice(-45, 45)))


@query(f"SELECT lat, lon, lev, {sql_r('v')} FROM grid WHERE lev IN (300, 600)", "grid")
def sel_nearest(spark, sf_dir):
    return rounded(sel.sel(grid(spark, sf_dir), "nearest", lev=[340, 610]))


@query(f"SELECT lat, lon, lev, {sql_r('v')} FROM grid WHERE lev = (SELECT min(lev) FROM grid) OR lev = (SELECT max(lev) FROM grid)", "grid")
def isel_edges(spark, sf_dir):
    return rounded(sel.isel(grid(spark, sf_dir), lev=[0, -1]))


_SEGMENTS = """seg AS (SELECT lat, lon, lev AS x0, v AS y0, lead(lev) OVER o AS x1, lead(v) OVER o AS y1, lag(lev) OVER o IS NULL AS first, lead(lev, 2) OVER o IS NULL AS last
  FROM grid WINDOW o AS (PARTITION BY lat, lon ORDER BY lev))"""
_INSIDE = "x1 IS NOT NULL AND (x >= x0 OR first) AND (x < x1 OR last)"


@query(f"WITH {_SEGMENTS} SELECT lat, lon, CAST(x AS DOUBLE) AS lev, {sql_r('y0 + (x - x0) * (y1 - y0) / (x1 - x0)')} FROM seg CROSS JOIN (VALUES (150), (333), (720)) t(x) WHERE {_INSIDE}", "grid")
def interp_linear(spark, sf_dir):
    return rounded(sel.interp(grid(spark, sf_dir), "lev", [150, 333, 720]))


@query(f"WITH {_SEGMENTS} SELECT lat, lon, x AS lev, {sql_r('y0 + (x - x0) * (y1 - y0) / (x1 - x0)')} FROM (SELECT *, 300 + lat AS x FROM seg) WHERE {_INSIDE}", "grid")
def interp_per_point(spark, sf_dir):
    f = grid(spark, sf_dir)
    return rounded(sel.interp(f, "lev", f.df.select("lat", (F.col("lat") + 300).alias("target")).distinct()))


@query(f"WITH {sql_truncated(-40, 33)} SELECT lat, lon, lev, {sql_r('v')} FROM cut", "grid")
def truncate_rows(spark, sf_dir):
    return rounded(sel.truncate(grid(spark, sf_dir), "lat", -40, 33)[0])


@query(f"WITH {sql_truncated(-40, 33)} SELECT lon, lev, {sql_r('sum(v * w) / sum(w)')} FROM cut JOIN clipped USING (lat) GROUP BY ALL", "grid")
def truncate_lat(spark, sf_dir):
    return rounded(sel.truncated_average(grid(spark, sf_dir), "lat", -40, 33))


@query(
    f"""WITH a AS (SELECT lat, lon, v FROM flat UNION ALL SELECT lat, lon - 360, v FROM flat WHERE lon = (SELECT max(lon) FROM flat)),
    b AS (SELECT * FROM a UNION ALL SELECT -90, lon, v FROM a WHERE lat = -85 UNION ALL SELECT 90, lon, v FROM a WHERE lat = 85)
    SELECT lat, lon, {sql_r('v')} FROM b""",
    "flat",
)
def enforce_global(spark, sf_dir):
    return rounded(grids.enforce_global(flat(spark, sf_dir)))


@query(
    f"""WITH a AS (SELECT lat, lon, v FROM flat UNION ALL SELECT lat, lon - 360, v FROM flat WHERE lon >= 340 UNION ALL SELECT lat, lon + 360, v FROM flat WHERE lon <= 10),
    b AS (SELECT * FROM a UNION ALL SELECT -180 - lat, CASE WHEN lon < 180 THEN lon + 180 ELSE lon - 180 END, v FROM a WHERE lat = -85
      UNION ALL SELECT 180 - lat, CASE WHEN lon < 180 THEN lon + 180 ELSE lon - 180 END, v FROM a WHERE lat = 85)
    SELECT lat, lon, {sql_r('v')} FROM b""",
    "flat",
)
def geopad(spark, sf_dir):
    return rounded(grids.geopad(flat(spark, sf_dir), 2, 1))


@query(f"SELECT lat, lon, {sql_r('v')} FROM flat WHERE lat >= -5", "flat")
def sel_hemisphere_nh(spark, sf_dir):
    return rounded(sel.sel_hemisphere(flat(spark, sf_dir), "nh"))


@query(f"SELECT n.lat, n.lon, {sql_r('(n.v + s.v) / 2')} FROM flat n JOIN flat s ON s.lon = n.lon AND s.lat = -n.lat WHERE n.lat >= -5", "flat")
def sel_hemisphere_avg(spark, sf_dir):
    return rounded(sel.sel_hemisphere(flat(spark, sf_dir), "avg"))


@query(f"SELECT lat, lon, {sql_r('CASE WHEN lat < 0 THEN -v ELSE v END')} FROM flat", "flat")
def invert_hemisphere(spark, sf_dir):
    return rounded(sel.invert_hemisphere(flat(spark, sf_dir), "sh"))


@query(f"SELECT -lat AS lat, lon, {sql_r('v')} FROM flat", "flat")
def reverse_hemisphere(spark, sf_dir):
    return rounded(sel.reverse_hemisphere(flat(spark, sf_dir)))


@query(f"SELECT month, lat, {sql_r('v')} FROM monthly WHERE month(month) IN (6, 7, 8) AND year(month) = 1995", "monthly")
def sel_time_month(spark, sf_dir):
    return rounded(sel.sel_time(monthly(spark, sf_dir), "month", season="JJA", year=1995))


_PAIR = "SELECT lat, lon, {} FROM grid a JOIN grid b USING (lat, lon) WHERE a.lev = 100 AND b.lev = 500"


@query(_PAIR.format(sql_r("b.v - a.v")), "grid")
def sel_pair_anomaly(spark, sf_dir):
    return rounded(sel.sel_pair(grid(spark, sf_dir), "lev", "anomaly", (100.0, 500.0)))


@query(_PAIR.format(sql_r("b.v / a.v")), "grid")
def sel_pair_ratio(spark, sf_dir):
    return rounded(sel.sel_pair(grid(spark, sf_dir), "lev", "ratio", (100.0, 500.0)))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders, (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders) WHERE o_orderdate BETWEEN a + INTERVAL 100 DAY AND b - INTERVAL 100 DAY")
def match_overlap(spark, sf_dir):
    """Two axes of days that begin and end 100 days apart."""
    days = tables.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    ends = F.broadcast(days.agg(F.min("day").alias("a"), F.max("day").alias("b")))
    part = lambda condition: days.crossJoin(ends).where(condition).select("day")
    return sel.match(part("day <= date_sub(b, 100)"), part("day >= date_add(a, 100)"))


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, CAST(second(ts) AS INTEGER) AS second FROM events")
def calendar_parts(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select("event_id", *(c.alias(k) for k, c in calendar(F.col("ts")).items()))


@query(f"SELECT lat, lon, CASE lev WHEN 100 THEN 150 WHEN 700 THEN 650 ELSE lev END AS lev, {sql_r('v')} FROM grid", "grid")
def replace_coords(spark, sf_dir):
    return rounded(sel.replace_coords(grid(spark, sf_dir), lev={100: 150, 700: 650}))


@query(f"SELECT lat, lon, lev * 100 AS lev, {sql_r('v')} FROM grid", "grid")
def standardize_coords(spark, sf_dir):
    f = grid(spark, sf_dir)
    odd = Field.of(f.df.withColumnsRenamed({"lat": "y", "lon": "x", "lev": "plev"}), ("y", "x", "plev"), coord_units={"y": "degrees_north", "x": "degrees_east", "plev": "hPa"})
    return rounded(grids.standardize_coords(odd, pressure_units="Pa"))


@query(f"SELECT g.lat, g.lon, g.lev, CASE WHEN abs(f.v) BETWEEN 20 AND 26 THEN round(g.v, 6) + 0.0 END AS v FROM grid g JOIN flat f USING (lat, lon)", "grid", "flat")
def mask_trop(spark, sf_dir):
    return rounded(sel.mask(grid(spark, sf_dir), flat(spark, sf_dir), 20, 26))
