"""Covariances, trends, timescales, EOFs and scalar expressions on the sphere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sphere
from ..functions.units import convert
from ..operators import grid as grids, stats
from ..sources import generators
from .base import components, flat, grid, query, r, rounded, sql_r, types, users

_Z = "z AS (SELECT user_id, t, v - avg(v) OVER (PARTITION BY user_id) AS z FROM users)"
_LAGGED = "SELECT user_id, CAST({k} AS DOUBLE) AS lag, round(sum(z * n) / (count(*) - {k}){s}, 6) + 0.0 AS value FROM (SELECT user_id, z, lead(z, {k}) OVER (PARTITION BY user_id ORDER BY t) AS n FROM z) GROUP BY user_id"


@query(f"WITH {_Z} {_LAGGED.format(k=1, s=' / nullif(var_pop(z), 0)')}", "users")
def autocorr_lag1(spark, sf_dir):
    return rounded(stats.autocorr(users(spark, sf_dir), "t"))


@query(f"WITH {_Z} " + " UNION ALL ".join(_LAGGED.format(k=k, s="") for k in range(6)), "users")
def autocovar_maxlag(spark, sf_dir):
    return rounded(stats.autocovar(users(spark, sf_dir), "t", imaxlag=5))


_TWO = "SELECT CAST(k AS DOUBLE) AS lag, round(sum(x * y) / (n - abs(k)){}, 6) + 0.0 AS value FROM (SELECT k, n, a.v - ma AS x, b.v - mb AS y, sa, sb FROM a CROSS JOIN (SELECT unnest(range(-{k}, {k} + 1)) AS k) JOIN b ON b.t = a.t + k CROSS JOIN (SELECT avg(v) AS ma, stddev_pop(v) AS sa, count(*) AS n FROM a) CROSS JOIN (SELECT avg(v) AS mb, stddev_pop(v) AS sb FROM b)) GROUP BY k, n, sa, sb"
_AB = "WITH a AS (SELECT t, v FROM types WHERE event_type = (SELECT min(event_type) FROM types)), b AS (SELECT t, v FROM types WHERE event_type = (SELECT max(event_type) FROM types)) "


def _pair(spark, sf_dir):
    from ..sources.tables import table

    a, b = table(spark, sf_dir, "events").agg(F.min("event_type"), F.max("event_type")).first()
    return types(spark, sf_dir, a), types(spark, sf_dir, b)


@query(_AB + _TWO.format(" / (sa * sb)", k=0), "types")
def corr_lag0(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return rounded(stats.corr(a, b, "t"))


@query(_AB + _TWO.format("", k=4), "types")
def covar_cross_lags(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return rounded(stats.covar(a, b, "t", imaxlag=4))


_RES = """WITH fit AS (SELECT user_id, regr_slope(v, t) AS m, regr_intercept(v, t) AS c FROM users GROUP BY user_id),
e AS (SELECT user_id, t, m, v - c - m * t AS e, lag(v - c - m * t) OVER (PARTITION BY user_id ORDER BY t) AS l FROM users JOIN fit USING (user_id)),
s AS (SELECT user_id, first(m) AS m, count(*) AS n, sum(e * e) AS sse, regr_sxx(e, t) AS sxx, sum(e * l) / ((count(*) - 1) * nullif(sum(e * e) / count(*), 0)) AS r FROM e GROUP BY user_id),
u AS (SELECT user_id, m, sse / (n - 2) / sxx * (n - 2) / nullif(n * (1 - r) / (1 + r) - 2, 0) AS q FROM s)"""


@query(f"SELECT user_id, {sql_r('regr_slope(v, t)', 'slope')} FROM users GROUP BY user_id", "users")
def slope(spark, sf_dir):
    return rounded(stats.slope(users(spark, sf_dir), "t").select("user_id", "slope"))


@query(f"{_RES} SELECT user_id, {sql_r('m', 'slope')}, CASE WHEN q >= 0 THEN round(sqrt(q), 6) + 0.0 END AS stderr FROM u", "users")
def slope_stderr(spark, sf_dir):
    return rounded(stats.slope(users(spark, sf_dir), "t"))


@query(f"SELECT user_id, t, {sql_r('regr_intercept(v, t) OVER w + regr_slope(v, t) OVER w * t', 'v', 8)} FROM users WINDOW w AS (PARTITION BY user_id)", "users")
def slope_fit(spark, sf_dir):
    return rounded(stats.slope_fit(users(spark, sf_dir), "t"), 8)


@query(f"WITH {_Z}, a AS ({_LAGGED.format(k=1, s=' / nullif(var_pop(z), 0)').replace('round(', '(').replace(', 6) + 0.0 AS', ') AS')}) SELECT user_id, CASE WHEN value > 0 AND value < 1 THEN round(-1 / ln(value), 6) + 0.0 END AS tau FROM a", "users")
def timescale_lag1(spark, sf_dir):
    return rounded(stats.timescale_lag1(users(spark, sf_dir), "t"))


# Gauss-Newton on the rate, 60 steps of it
_FIT = f"""WITH RECURSIVE {_Z}, r AS ({' UNION ALL '.join(_LAGGED.format(k=k, s=' / nullif(var_pop(z), 0)').replace('round(', '(').replace(', 6) + 0.0 AS', ') AS') for k in range(21))}),
c AS (SELECT user_id, list(value ORDER BY lag) AS c FROM r GROUP BY user_id),
g AS (SELECT user_id, c, -ln(CASE WHEN c[2] > 0 AND c[2] < 1 THEN c[2] ELSE 0.5 END) AS rate, 0 AS i FROM c
  UNION ALL SELECT user_id, c, rate + CASE WHEN step < 0 AND -step >= rate THEN step / pow(2, floor(log2(-step / rate)) + 1) ELSE step END, i + 1 FROM (
    SELECT user_id, c, rate, i, list_sum(list_transform(range(21), lambda k: -k * exp(-rate * k) * (c[k + 1] - exp(-rate * k)))) / greatest(list_sum(list_transform(range(21), lambda k: pow(k * exp(-rate * k), 2))), 1e-300) AS step FROM g WHERE i < 200))"""


@query(f"{_FIT} SELECT user_id, round(exp(-rate), 5) + 0.0 AS decay FROM g WHERE i = 200", "users")
def timescale_fit(spark, sf_dir):
    """What the fitted line leaves after a step, e^(-1 / timescale)."""
    fits = stats.timescale(users(spark, sf_dir), "t", imaxlag=20)
    return rounded(fits.select("user_id", F.exp(-1 / F.col("tau")).alias("decay")), 5)


@query(f"WITH z AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY i) AS z FROM comps) SELECT a.i AS a, b.i AS b, {sql_r('sum(a.z * b.z)', 'g')} FROM z a JOIN z b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i", "comps")
def eof_gram(spark, sf_dir):
    return rounded(stats.gram(components(spark, sf_dir), "vec_id", "i"))


_ANOMALY = "z AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY i) AS z FROM comps)"


@query(f"WITH {_ANOMALY} SELECT vec_id, i, {sql_r('z', 'z')} FROM z", "comps")
def eof_projections(spark, sf_dir):
    """All components times their projections are the anomalies again."""
    f = components(spark, sf_dir)
    pcs, projections, _ = stats.eof(f, "vec_id", "i", neof=1 << 10)
    z = pcs.join(projections, "eof").groupBy("vec_id", "i").agg(F.sum(F.col("pc") * F.col("proj")).alias("z"))
    return rounded(z)


@query("SELECT a, b, CAST(a = b AS DOUBLE) AS r FROM (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS a) CROSS JOIN (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS b)")
def eof_components(spark, sf_dir):
    """Components have unit variance and no correlation with one another."""
    pcs = stats.eof(components(spark, sf_dir), "vec_id", "i")[0]
    both = pcs.select("vec_id", F.col("eof").alias("a"), F.col("pc").alias("x")).join(pcs.select("vec_id", F.col("eof").alias("b"), F.col("pc").alias("y")), "vec_id")
    return rounded(both.groupBy("a", "b").agg(F.avg(F.col("x") * F.col("y")).alias("r")))


@query(f"WITH {_ANOMALY}, g AS (SELECT a.i AS a, b.i AS b, sum(a.z * b.z) / (SELECT count(DISTINCT vec_id) FROM comps) AS g FROM z a JOIN z b USING (vec_id) GROUP BY ALL) SELECT {sql_r('sum(g)', 'trace')}, {sql_r('(SELECT sum(g * g) FROM g)', 'squares')}, CAST(count(*) AS BIGINT) AS n FROM g WHERE a = b", "comps")
def eof(spark, sf_dir):
    """The sums of all eigenvalues and of their squares are those of the matrix."""
    values = stats.eof(components(spark, sf_dir), "vec_id", "i", neof=1 << 10)[2]
    return rounded(values.agg(F.sum("eval").alias("trace"), F.sum(F.col("eval") * F.col("eval")).alias("squares"), F.count("*").alias("n")))


@query(
    f"""WITH {_ANOMALY}, l AS (SELECT i, sum(z * n) / (count(*) - 1) / nullif(var_pop(z), 0) AS r FROM (SELECT i, z, lead(z) OVER (PARTITION BY i ORDER BY vec_id) AS n FROM z) GROUP BY i)
    SELECT {sql_r('(SELECT count(DISTINCT vec_id) FROM comps) * (1 - avg(r)) / (1 + avg(r))', 'neff')} FROM l""",
    "comps",
)
def eof_neff(spark, sf_dir):
    return rounded(stats.eof(components(spark, sf_dir), "vec_id", "i", neof=1)[2].select("neff"))


@query("SELECT CAST(unnest(range(20)) AS BIGINT) AS sample, CAST(200 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS x0, true AS small_mean, true AS unit_deviation")
def rednoise(spark, sf_dir):
    """Each sample starts at zero, and what is new at a step has mean 0 and deviation 1."""
    from pyspark.sql import Window

    df = generators.rednoise(spark, 0.8, 200, 20, seed=1)
    new = (F.col("v") - 0.8 * F.lag("v").over(Window.partitionBy("sample").orderBy("t"))) / (1 - 0.64) ** 0.5
    sums = df.withColumn("e", new).groupBy("sample").agg(F.count("*").alias("n"), F.min_by("v", "t").alias("x0"), F.avg("e").alias("m"), F.stddev("e").alias("s"))
    return sums.select(F.col("sample").cast("long").alias("sample"), "n", "x0", (F.abs("m") < 0.3).alias("small_mean"), (F.abs(F.col("s") - 1) < 0.2).alias("unit_deviation"))


_H = "pow(sin((b.lat - a.lat) / 2), 2) + cos(a.lat) * cos(b.lat) * pow(sin((b.lon - a.lon) / 2), 2)"


@query(f"WITH p AS (SELECT s_suppkey, radians(CAST(s_suppkey * 37 % 181 - 90 AS DOUBLE)) AS lat, radians(CAST(s_suppkey * 91 % 360 AS DOUBLE)) AS lon FROM supplier) SELECT a.s_suppkey, {sql_r(f'2 * 6371.0088 * asin(sqrt({_H}))', 'km')} FROM p a JOIN p b ON b.s_suppkey = a.s_suppkey + 1")
def haversine(spark, sf_dir):
    from ..sources.tables import table

    key = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").select("s_suppkey", (key * 37 % 181 - 90).cast("double").alias("lat"), (key * 91 % 360).cast("double").alias("lon"))
    b = p.select((key - 1).alias("s_suppkey"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return rounded(p.join(b, "s_suppkey").select("s_suppkey", sphere.haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")).alias("km")))


@query(
    """SELECT DISTINCT lat, round(radians(lat) * 6371.0088, 6) + 0.0 AS y, round(cos(radians(lat)), 6) + 0.0 AS cosine,
    round(2 * 7.292115e-5 * sin(radians(lat)) * 1e6, 6) + 0.0 AS f, round(2 * 7.292115e-5 * cos(radians(lat)) / 6371008.8 * 1e12, 6) + 0.0 AS beta FROM flat""",
    "flat",
)
def coriolis_beta(spark, sf_dir):
    lat = F.col("lat")
    df = flat(spark, sf_dir).df.select("lat").distinct()
    return rounded(df.select("lat", sphere.meridional_coordinate(lat).alias("y"), sphere.cosine_latitude(lat).alias("cosine"), (sphere.coriolis(lat) * 1e6).alias("f"), (sphere.beta(lat) * 1e12).alias("beta")))


@query(
    """SELECT DISTINCT lev, round(7 * ln(1000 / lev), 6) + 0.0 AS height, round(lev * 100 / (8.31446 / 28.9645e-3 * 300), 6) + 0.0 AS density,
    round(300 * pow(1000 / lev, 8.31446 / 28.9645e-3 / 1005.7), 6) + 0.0 AS theta FROM grid""",
    "grid",
)
def reference_profiles(spark, sf_dir):
    p = F.col("lev")
    df = grid(spark, sf_dir).df.select("lev").distinct()
    return rounded(df.select("lev", sphere.reference_height(p).alias("height"), sphere.reference_density(p).alias("density"), sphere.reference_potential_temperature(p).alias("theta")))


@query(
    f"""WITH d AS (SELECT lat, radians(CASE WHEN abs(lat) = 85 THEN 5 ELSE 10 END) * 6371.0088 AS depth FROM (SELECT DISTINCT lat FROM flat)),
    o AS (SELECT lon, w * 6371.0088 AS arc FROM lonw)
    SELECT lat, lon, {sql_r('arc * cos(radians(lat))', 'width')}, {sql_r('depth', 'depth')}, {sql_r('arc * cos(radians(lat)) * depth', 'area')} FROM d CROSS JOIN o""",
    "flat", "lonw",
)
def cell_measures(spark, sf_dir):
    return rounded(grids.cell_measures(flat(spark, sf_dir).df))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * 1.8 + 32, 6) + 0.0 AS fahrenheit, round(l_quantity + 273.15, 6) + 0.0 AS kelvin, round(l_quantity / 1.60934400, 6) + 0.0 AS miles FROM lineitem")
def convert_units(spark, sf_dir):
    from ..functions.units import define
    from ..sources.tables import table

    define("mile", 1609.344, "m")
    q = F.col("l_quantity").cast("double")
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", r(convert(q, "degC", "degF")).alias("fahrenheit"), r(convert(q, "degC", "K")).alias("kelvin"), r(convert(q, "km", "mile")).alias("miles"))
