"""Spectra, harmonics and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import design
from ..operators import spectral as spec
from ..sources import generators
from .base import day_hour, hourly, query, rounded, sql_r, users
from .statistics import _AB, _pair


def _dft(of: str, ks: str = "range(1, n // 2 + 1)") -> str:
    turn = "2 * pi() * k * t / n"
    return f"SELECT CAST(k AS INTEGER) AS k, n, sum((v - m) * cos({turn})) / n AS re, -sum((v - m) * sin({turn})) / n AS im FROM {of} CROSS JOIN (SELECT n, m, unnest({ks}) AS k FROM (SELECT avg(v) AS m, count(*) AS n FROM {of})) GROUP BY k, n"


_TWICE = "CASE WHEN 2 * k = {n} THEN 1 ELSE 2 END"


@query(f"WITH d AS ({_dft('hourly')}) SELECT k, {sql_r('k / n', 'f')}, {sql_r('(re * re + im * im) * ' + _TWICE.format(n='n'), 'power')} FROM d", "hourly")
def power_dft(spark, sf_dir):
    return rounded(spec.power_dft(hourly(spark, sf_dir), "t"))


_CO = f"{_AB.rstrip()}, x AS ({_dft('a')}), y AS ({_dft('b')})"
_TWICE_X = _TWICE.format(n="x.n")


@query(f"{_CO} SELECT k, {sql_r('k / x.n', 'f')}, {sql_r(f'(x.re * y.re + x.im * y.im) * {_TWICE_X}', 'c')}, {sql_r(f'(x.re * y.im - x.im * y.re) * {_TWICE_X}', 'q')} FROM x JOIN y USING (k)", "types")
def copower_dft(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return rounded(spec.copower_dft(a, b, "t"))


_BACK = f"SELECT t, round(sum({_TWICE.format(n='n')} * (re * cos(2 * pi() * k * t / n) - im * sin(2 * pi() * k * t / n))), 6) + 0.0 AS v FROM d CROSS JOIN (SELECT t FROM hourly) GROUP BY t"


@query(f"WITH d AS ({_dft('hourly', ks='range(1, 5)')}) {_BACK}", "hourly")
def harmonics(spark, sf_dir):
    return rounded(spec.harmonics(hourly(spark, sf_dir), "t", 4))


@query(f"WITH e AS ({_dft('hourly')}), d AS (SELECT * FROM e QUALIFY row_number() OVER (ORDER BY round(re * re + im * im, 9) DESC, k) <= 5) {_BACK}", "hourly")
def highpower(spark, sf_dir):
    return rounded(spec.highpower(hourly(spark, sf_dir), "t", 5))


_FIR = [float(x) for x in design.lanczos(1.0, 9, 4.0)[0]]


def _poly(f: str) -> str:
    return " + ".join(f"{w!r} * {f}(2 * pi() / 500 * i * {k})" for k, w in enumerate(_FIR))


@query(f"SELECT {sql_r('i / 500.0', 'x')}, {sql_r(f'sqrt(pow({_poly('cos')}, 2) + pow({_poly('sin')}, 2))', 'h')} FROM range(500) r(i)")
def filter_response(spark, sf_dir):
    return rounded(spec.response(spark, 1.0, _FIR, n=500))


@query(f"SELECT CAST(i AS BIGINT) AS i, {sql_r('sin(2 * pi() * 0.1 * i + 0.5) + sin(2 * pi() * 0.25 * i + 0.5)', 'v')} FROM range(200) r(i)")
def waves(spark, sf_dir):
    x = F.col("id").cast("double")
    return rounded(spark.range(200).select(F.col("id").alias("i"), generators.waves(x, [0.1, 0.25], phase=0.5).alias("v")))


@query(
    f"""WITH n AS (SELECT user_id, count(*) AS n, avg(v) AS m FROM users GROUP BY user_id),
    d AS (SELECT user_id, k, n, sum((v - m) * cos(2 * pi() * k * t / n)) / n AS re, sum((v - m) * sin(2 * pi() * k * t / n)) / n AS im FROM users JOIN (SELECT *, unnest(range(2, n // 2 + 1)) AS k FROM n) USING (user_id) GROUP BY user_id, k, n),
    p AS (SELECT user_id, k, (re * re + im * im) * CASE WHEN 2 * k = n THEN 1 ELSE 2 END AS pw FROM d)
    SELECT user_id, {sql_r('0.25 * sum(pw) / sum(k * pw)', 'centroid')} FROM p GROUP BY user_id""",
    "users",
)
def centroid(spark, sf_dir):
    from ..field import Field

    p = spec.power_dft(users(spark, sf_dir), "t").select("user_id", "k", "power")
    return rounded(spec.centroid(Field(p, ("user_id", "k"), "power"), lat=None))


def _segmented(of: str, name: str, trend: str = "avg(v)", width: int = 240) -> str:
    """CTEs: half-overlapping Hann segments of a series and the coefficients of each."""
    return f"""{name}s AS (SELECT s, t - s AS j, v - ({trend}) AS z FROM (SELECT s, t, v, regr_slope(v, t) OVER w AS m, regr_intercept(v, t) OVER w AS c, avg(v) OVER w AS a
      FROM (SELECT unnest(range(0, (count(*) // {width} - 1) * {width} + 1, {width // 2})) AS s FROM {of}) JOIN {of} ON t >= s AND t < s + {width} WINDOW w AS (PARTITION BY s))),
    {name}c AS (SELECT s, k, sum(z * h * cos(2 * pi() * k * j / {width})) / {width / 2} AS re, -sum(z * h * sin(2 * pi() * k * j / {width})) / {width / 2} AS im
      FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / {width}) AS h FROM {name}s) CROSS JOIN (SELECT unnest(range(1, {width // 2 + 1})) AS k) GROUP BY s, k)"""


@query(f"WITH {_segmented('hourly', 'x', 'a')} SELECT {sql_r('k / 240', 'f')}, {sql_r('avg((re * re + im * im) * ' + _TWICE.format(n=240) + ')', 'power')} FROM xc GROUP BY k", "hourly")
def power_segments(spark, sf_dir):
    """A kernel: half-overlapping Hann windows of 240 hours."""
    return rounded(spec.power(hourly(spark, sf_dir), "t", nperseg=240, wintype="hann"))


_CROSS = f"""{_AB.rstrip()}, {_segmented('a', 'x', 'c + m * t')}, {_segmented('b', 'y', 'c + m * t')},
m AS (SELECT k, avg((x.re * y.re + x.im * y.im) * w) AS c, avg((x.re * y.im - x.im * y.re) * w) AS q, avg((x.re * x.re + x.im * x.im) * w) AS p1, avg((y.re * y.re + y.im * y.im) * w) AS p2
  FROM xc x JOIN (SELECT *, {_TWICE.format(n=240)} AS w FROM yc) y USING (s, k) GROUP BY k)"""
_ANGLE = "CASE WHEN atan2(q, c) < 0 THEN degrees(atan2(q, c)) + 360 ELSE degrees(atan2(q, c)) END"


@query(f"{_CROSS} SELECT {sql_r('k / 240', 'f')}, {sql_r('c', 'c')}, {sql_r('q', 'q')}, {sql_r('p1', 'p1')}, {sql_r('p2', 'p2')}, {sql_r('c * c / (p1 * p2)', 'coherence')}, round({_ANGLE}, 4) % 360 + 0.0 AS phase FROM m", "types")
def copower_segments(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    df = spec.copower(a, b, "t", nperseg=240, wintype="hann", detrend="linear")
    return rounded(df.withColumn("phase", F.round("phase", 4) % 360))


def _plane(of: str, name: str) -> str:
    """CTEs: anomalies of days and hours and their coefficients in both."""
    turn = "2 * pi() * (k * hour / 24 + f * day / n)"
    return f"""{name}n AS (SELECT count(DISTINCT day) - count(DISTINCT day) % 2 AS n FROM {of}),
    {name}d AS (SELECT day, hour, n, v - avg(v) OVER (PARTITION BY hour) AS v FROM {of}, {name}n WHERE day < n),
    {name}z AS (SELECT day, hour, n, v - avg(v) OVER (PARTITION BY day) AS z FROM {name}d),
    {name} AS (SELECT k, f, n, sum(z * cos({turn})) / (24 * n) AS re, -sum(z * sin({turn})) / (24 * n) AS im FROM {name}z
      CROSS JOIN (SELECT unnest(range(1, 13)) AS k) CROSS JOIN (SELECT unnest(range(-(n // 2), n // 2 + 1)) AS f FROM {name}n) WHERE f <> 0 GROUP BY k, f, n)"""


_ONCE = "CASE WHEN k = 12 THEN 1 ELSE 2 END"


@query(f"WITH {_plane('dayhour', 'x')} SELECT {sql_r('k / 24', 'k')}, {sql_r('f / n', 'f')}, {sql_r(f'(re * re + im * im) * {_ONCE}', 'power')} FROM x", "dayhour")
def power2d(spark, sf_dir):
    return rounded(spec.spectra2d(day_hour(spark, sf_dir), "hour", "day"))


@query(
    f"""WITH squared AS (SELECT day, hour, v * v / 1e4 AS v FROM dayhour), {_plane('dayhour', 'x')}, {_plane('squared', 'y')},
    m AS (SELECT k, f, x.n AS n, (x.re * y.re + x.im * y.im) * {_ONCE} AS c, (x.im * y.re - x.re * y.im) * {_ONCE} AS q, (x.re * x.re + x.im * x.im) * {_ONCE} AS p1, (y.re * y.re + y.im * y.im) * {_ONCE} AS p2 FROM x JOIN y USING (k, f))
    SELECT {sql_r('k / 24', 'k')}, {sql_r('f / n', 'f')}, {sql_r('c', 'c')}, {sql_r('q', 'q')}, {sql_r('p1', 'p1')}, {sql_r('p2', 'p2')}, {sql_r('(c * c + q * q) / (p1 * p2)', 'coherence')}, round({_ANGLE}, 4) % 360 + 0.0 AS phase FROM m""",
    "dayhour",
)
def copower2d(spark, sf_dir):
    f = day_hour(spark, sf_dir)
    return rounded(spec.spectra2d(f, "hour", "day", f.with_value(f.v * f.v / 1e4)).withColumn("phase", F.round("phase", 4) % 360))


# modified Bessel function of order zero by its series
_I0 = "list_sum(list_transform(range(0, 25), lambda k: pow({} / 2, 2 * k) / pow(CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE), 2)))"
_SHAPES = {
    "boxcar": "1", "hann": "0.5 - 0.5 * cos(u)", "hamming": "0.54 - 0.46 * cos(u)", "blackman": "0.42 - 0.5 * cos(u) + 0.08 * cos(2 * u)", "bartlett": "1 - abs(i / 8 - 1)", "welch": "1 - pow(i / 8 - 1, 2)",
    "kaiser": f"{_I0.format('(5 * sqrt(greatest(1 - pow(i / 8 - 1, 2), 0)))')} / {_I0.format('5.0')}", "gaussian": "exp(-0.5 * pow((i - 8) / 3, 2))",
}


@query("WITH p AS (SELECT CAST(i AS INTEGER) AS i, 2 * pi() * i / 16 AS u FROM range(16) r(i)) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, i, {sql_r(w, 'w')} FROM p" for k, w in _SHAPES.items()))
def window_shapes(spark, sf_dir):
    """Weights of every window of 16 points."""
    kinds = ["boxcar", "hann", "hamming", "blackman", "bartlett", "welch", ("kaiser", 5.0), ("gaussian", 3.0)]
    rows = [(k if isinstance(k, str) else k[0], i, float(w)) for k in kinds for i, w in enumerate(design.window(16, k))]
    return rounded(spark.createDataFrame(rows, "kind string, i int, w double"))
