"""Running means, filters, differences and operators on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..field import Field
from ..functions import design
from ..operators import calculus as cal, windows as win
from .base import day_hour, flat, query, rounded, sql_r, users

_O = "OVER (PARTITION BY user_id ORDER BY t)"


def _at(v: str, k: int, over: str) -> str:
    return v if not k else f"{'lead' if k > 0 else 'lag'}({v}, {abs(k)}) {over}"


def _combined(weights: dict[int, float], over: str = _O, v: str = "v") -> str:
    return "(" + " + ".join(f"{w!r} * {_at(v, k, over)}" for k, w in weights.items()) + ")"


def _stencil_sql(weights: dict[int, float]) -> str:
    half = max(weights)
    return f"SELECT user_id, t, {sql_r(_combined(weights))} FROM users QUALIFY lag(1, {half}) {_O} = 1 AND lead(1, {half}) {_O} = 1"


def _frame(a: str, b: str, n: int, value: str = "avg(v)") -> str:
    w = f"OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN {a} AND {b})"
    return f"SELECT user_id, t, CASE WHEN count(v) {w} = {n} THEN round({value} {w}, 6) + 0.0 END AS v FROM users"


@query(_frame("2 PRECEDING", "2 FOLLOWING", 5), "users")
def runmean_centered(spark, sf_dir):
    return rounded(win.runmean(users(spark, sf_dir), "t", 5))


@query(_frame("3 PRECEDING", "CURRENT ROW", 4), "users")
def runmean_trailing(spark, sf_dir):
    return rounded(win.runmean(users(spark, sf_dir), "t", 4, center=False))


_HANN = {j - 2: 0.5 - 0.5 * math.cos(2 * math.pi * j / 5) for j in range(5)}


@query(f"SELECT user_id, t, {sql_r(_combined(_HANN) + ' / 5')} FROM users", "users")
def runmean_weighted(spark, sf_dir):
    return rounded(win.runmean(users(spark, sf_dir), "t", 5, window="hann"))


@query(f"SELECT user_id, t, {sql_r(f'sum(v) {_O}')} FROM users", "users")
def cum_integral_x(spark, sf_dir):
    return rounded(win.cumulative_integral(users(spark, sf_dir), "t"))


@query(_stencil_sql({-1: -1 / 2, 1: 1 / 2}), "users")
def deriv1_acc2(spark, sf_dir):
    return rounded(cal.deriv_even(users(spark, sf_dir), "t"))


@query(_stencil_sql({-2: 1 / 12, -1: -8 / 12, 1: 8 / 12, 2: -1 / 12}), "users")
def deriv1_acc4(spark, sf_dir):
    return rounded(cal.deriv_even(users(spark, sf_dir), "t", accuracy=4))


@query(_stencil_sql({-3: -1 / 60, -2: 9 / 60, -1: -45 / 60, 1: 45 / 60, 2: -9 / 60, 3: 1 / 60}), "users")
def deriv1_acc6(spark, sf_dir):
    return rounded(cal.deriv_even(users(spark, sf_dir), "t", accuracy=6))


@query(_stencil_sql({-1: 1.0, 0: -2.0, 1: 1.0}), "users")
def deriv2_acc2(spark, sf_dir):
    return rounded(cal.deriv_even(users(spark, sf_dir), "t", 2))


@query(_stencil_sql({-2: -1 / 12, -1: 16 / 12, 0: -30 / 12, 1: 16 / 12, 2: -1 / 12}), "users")
def deriv2_acc4(spark, sf_dir):
    return rounded(cal.deriv_even(users(spark, sf_dir), "t", 2, 4))


@query(_stencil_sql({-2: -1 / 2, -1: 1.0, 1: -1.0, 2: 1 / 2}), "users")
def deriv3_acc2(spark, sf_dir):
    return rounded(cal.deriv_even(users(spark, sf_dir), "t", 3))


@query(f"SELECT user_id, t, {sql_r(f'coalesce((lead(v) {_O} - lag(v) {_O}) / 2, lead(v) {_O} - v, v - lag(v) {_O})')} FROM users", "users")
def deriv_keepedges(spark, sf_dir):
    return rounded(cal.deriv_even(users(spark, sf_dir), "t", keepedges=True))


@query(f"SELECT a.day, a.hour, {sql_r('(c.v - b.v) / 2')} FROM dayhour a JOIN dayhour b ON b.day = a.day AND b.hour = (a.hour + 23) % 24 JOIN dayhour c ON c.day = a.day AND c.hour = (a.hour + 1) % 24", "dayhour")
def deriv_cyclic(spark, sf_dir):
    return rounded(cal.deriv_even(day_hour(spark, sf_dir), "hour", cyclic=True))


_UNEVEN = "WITH uneven AS (SELECT user_id, t, t + t % 3 * 0.25 AS x, v FROM users), steps AS (SELECT user_id, x, v, x - lag(x) OVER o AS a, lead(x) OVER o - x AS b, v - lag(v) OVER o AS d0, lead(v) OVER o - v AS d1 FROM uneven WINDOW o AS (PARTITION BY user_id ORDER BY x))"


def _uneven(spark, sf_dir) -> Field:
    df = users(spark, sf_dir).df.select("user_id", (F.col("t") + F.col("t") % 3 * 0.25).alias("x"), "v")
    return Field.of(df, ("user_id", "x"))


@query(f"{_UNEVEN} SELECT user_id, CAST(x AS DOUBLE) AS x, {sql_r('d1 / b * (a / (a + b)) + d0 / a * (b / (a + b))')} FROM steps WHERE a + b IS NOT NULL", "users")
def deriv_uneven1(spark, sf_dir):
    return rounded(cal.deriv_uneven(_uneven(spark, sf_dir), "x"))


@query(f"{_UNEVEN} SELECT user_id, CAST(x AS DOUBLE) AS x, {sql_r('2 * (d1 / b - d0 / a) / (a + b)')} FROM steps WHERE a + b IS NOT NULL", "users")
def deriv_uneven2(spark, sf_dir):
    return rounded(cal.deriv_uneven(_uneven(spark, sf_dir), "x", 2))


# third derivative of the polynomial through the nodes: for node i, 6 / prod(x_i - x_j) times the
# sum over triples of the other nodes of the product of (x - x_j) over those left
_NODES = """WITH p AS (SELECT user_id, t + t % 3 * 0.25 AS x, v, row_number() OVER (PARTITION BY user_id ORDER BY t + t % 3 * 0.25) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM users),
r AS (SELECT *, CASE WHEN i >= 3 AND i < n - 3 THEN 7 ELSE least(n, greatest(4, 2 * least(i, n - 1 - i) + 1)) END AS m FROM p),
b AS (SELECT *, CASE WHEN i >= 3 AND i < n - 3 THEN i - 3 WHEN i < 3 THEN 0 ELSE n - m END AS lo FROM r WHERE m > 3),
s AS (SELECT b.user_id, b.i, b.x, p.i AS j, p.x AS xj, p.v AS y FROM b JOIN p ON p.user_id = b.user_id AND p.i >= b.lo AND p.i < b.lo + b.m),
below AS (SELECT a.user_id, a.i, a.j, product(a.xj - c.xj) AS d FROM s a JOIN s c ON c.user_id = a.user_id AND c.i = a.i AND c.j <> a.j GROUP BY ALL),
triples AS (SELECT a.user_id, a.i, a.j, c.j AS c, d.j AS d, e.j AS e FROM s a JOIN s c ON c.user_id = a.user_id AND c.i = a.i AND c.j <> a.j JOIN s d ON d.user_id = a.user_id AND d.i = a.i AND d.j > c.j AND d.j <> a.j
  JOIN s e ON e.user_id = a.user_id AND e.i = a.i AND e.j > d.j AND e.j <> a.j),
above AS (SELECT t.user_id, t.i, t.j, c, d, e, coalesce(product(o.x - o.xj), 1) AS f FROM triples t LEFT JOIN s o ON o.user_id = t.user_id AND o.i = t.i AND o.j NOT IN (t.j, c, d, e) GROUP BY ALL),
total AS (SELECT user_id, i, j, sum(f) AS f FROM above GROUP BY ALL)"""


@query(f"{_NODES} SELECT s.user_id, CAST(s.x AS DOUBLE) AS x, {sql_r('sum(6 * y * f / d)', 'v', 4)} FROM s JOIN below USING (user_id, i, j) JOIN total USING (user_id, i, j) GROUP BY s.user_id, s.i, s.x", "users")
def deriv_fornberg(spark, sf_dir):
    """A kernel: third order at accuracy 4 on uneven points, edges kept."""
    return rounded(cal.deriv_uneven(_uneven(spark, sf_dir), "x", 3, 4, keepedges=True), 4)


@query(f"SELECT user_id, CAST(t + 0.5 AS DOUBLE) AS t, {sql_r(f'lead(v) {_O} - v')} FROM users QUALIFY lead(t) {_O} IS NOT NULL", "users")
def deriv_half(spark, sf_dir):
    return rounded(cal.deriv_half(users(spark, sf_dir), "t"))


_DIV = """WITH g AS (SELECT lat, lon, v * cos(radians(lat)) AS g, radians(lat) * 6371.0088 AS y FROM flat),
s AS (SELECT lat, lon, y - lag(y) OVER o AS a, lead(y) OVER o - y AS b, g - lag(g) OVER o AS d0, lead(g) OVER o - g AS d1 FROM g WINDOW o AS (PARTITION BY lon ORDER BY lat))
SELECT lat, lon, round({} coalesce(d1 / b * a / (a + b) + d0 / a * b / (a + b), d1 / b, d0 / a) / cos(radians(lat)), 8) + 0.0 AS v FROM s"""


@query(_DIV.format(""), "flat")
def divergence(spark, sf_dir):
    return rounded(cal.divergence(flat(spark, sf_dir)), 8)


@query(_DIV.format("-1 *"), "flat")
def convergence(spark, sf_dir):
    return rounded(cal.convergence(flat(spark, sf_dir)), 8)


_LAT = "OVER (PARTITION BY lon ORDER BY lat)"
_LAP = f"""WITH xs AS (SELECT a.lat, a.lon, sum(CASE d WHEN 0 THEN -30 WHEN 1 THEN 16 WHEN -1 THEN 16 ELSE -1 END * b.v) / 12.0 / 100 AS xx
  FROM flat a CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) o(d) JOIN flat b ON b.lat = a.lat AND b.lon = (a.lon + d * 10 + 360) % 360 GROUP BY ALL),
ys AS (SELECT lat, lon, {_combined({-2: 1 / 12, -1: -8 / 12, 1: 8 / 12, 2: -1 / 12}, _LAT)} / 10 AS y, {_combined({-2: -1 / 12, -1: 16 / 12, 0: -30 / 12, 1: 16 / 12, 2: -1 / 12}, _LAT)} / 100 AS yy FROM flat)
SELECT lat, lon, round((xx / pow(radians(1), 2) / pow(cos(radians(lat)) * 6371.0088, 2) - tan(radians(lat)) / pow(6371.0088, 2) * y / radians(1) + yy / pow(radians(1), 2) / pow(6371.0088, 2)) * 1e6, 6) + 0.0 AS v
FROM xs JOIN ys USING (lat, lon) WHERE y IS NOT NULL"""


@query(_LAP, "flat")
def laplacian(spark, sf_dir):
    f = cal.geolaplacian(flat(spark, sf_dir))
    return rounded(f.with_value(f.v * 1e6))


@query(
    f"""WITH g AS (SELECT a.lat, a.lon, (c.v - b.v) / 20 / (cos(radians(a.lat)) * 6371.0088 * radians(1)) AS gx FROM flat a
      JOIN flat b ON b.lat = a.lat AND b.lon = (a.lon + 350) % 360 JOIN flat c ON c.lat = a.lat AND c.lon = (a.lon + 10) % 360),
    h AS (SELECT lat, lon, coalesce((lead(v) {_LAT} - lag(v) {_LAT}) / 20, (lead(v) {_LAT} - v) / 10, (v - lag(v) {_LAT}) / 10) / (6371.0088 * radians(1)) AS gy FROM flat)
    SELECT lat, lon, round(gx, 8) + 0.0 AS gx, round(gy, 8) + 0.0 AS gy FROM g JOIN h USING (lat, lon)""",
    "flat",
)
def gradient(spark, sf_dir):
    return rounded(cal.geogradient(flat(spark, sf_dir)), 8)


_B = [float(x) for x in design.lanczos(1.0, 9, 4.0)[0]]
_PASS = _combined({-j: w for j, w in enumerate(_B)}, _O, "z")


@query(f"WITH c AS (SELECT user_id, t, v - avg(v) OVER (PARTITION BY user_id) AS z, avg(v) OVER (PARTITION BY user_id) AS m FROM users), p AS (SELECT user_id, t, m, {_PASS} AS z FROM c) SELECT user_id, t, {sql_r(f'lead(z, {(len(_B) - 1) // 2}) {_O} + m')} FROM p", "users")
def fir_lanczos(spark, sf_dir):
    return rounded(win.fir(users(spark, sf_dir), "t", _B))


@query(f"WITH c AS (SELECT user_id, t, v - avg(v) OVER (PARTITION BY user_id) AS z, avg(v) OVER (PARTITION BY user_id) AS m FROM users), p AS (SELECT user_id, t, m, {_PASS} AS z FROM c), q AS (SELECT user_id, t, m, {_combined(dict(enumerate(_B)), _O, 'z')} AS z FROM p) SELECT user_id, t, {sql_r('z + m')} FROM q", "users")
def filter_forward_backward(spark, sf_dir):
    return rounded(win.fir(users(spark, sf_dir), "t", _B, n=2))


# bilinear transform of the two poles of order two with a cutoff of ten steps
_K = math.tan(math.pi / 10)
_A0 = 1 + math.sqrt(2) * _K + _K * _K
_IIR = {"b0": _K * _K / _A0, "b1": 2 * _K * _K / _A0, "b2": _K * _K / _A0, "a1": 2 * (_K * _K - 1) / _A0, "a2": (1 - math.sqrt(2) * _K + _K * _K) / _A0}


def _recursion(of: str, name: str, order: str) -> str:
    """A CTE: one pass over each user's series, whose places are numbered from 1 by ``order``."""
    step = f"{_IIR['b0']!r} * x + {_IIR['b1']!r} * x1 + {_IIR['b2']!r} * x2 - {_IIR['a1']!r} * y1 - {_IIR['a2']!r} * y2"
    return f"""{name}i AS (SELECT user_id, t, z, row_number() OVER (PARTITION BY user_id ORDER BY t {order}) AS i FROM {of}),
    {name} AS (SELECT user_id, t, i, {_IIR['b0']!r} * z AS z, z AS x1, CAST(0 AS DOUBLE) AS x2, CAST(0 AS DOUBLE) AS y2 FROM {name}i WHERE i = 1
      UNION ALL SELECT user_id, t, i, {step}, x, x1, y1 FROM (SELECT n.user_id, n.t, n.i, n.z AS x, p.x1, p.x2, p.z AS y1, p.y2 FROM {name} p JOIN {name}i n ON n.user_id = p.user_id AND n.i = p.i + 1))"""


@query(
    f"""WITH RECURSIVE c AS (SELECT user_id, t, v - avg(v) OVER (PARTITION BY user_id) AS z, avg(v) OVER (PARTITION BY user_id) AS m, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM users),
    {_recursion('c', 'forth', '')}, {_recursion('forth', 'back', 'DESC')}
    SELECT c.user_id, c.t, CASE WHEN c.i > 2 AND c.i <= n - 2 THEN round(back.z + m, 6) + 0.0 END AS v FROM c JOIN back USING (user_id, t)""",
    "users",
)
def butterworth_filter(spark, sf_dir):
    """A kernel: two passes of a recursive low-pass filter."""
    return rounded(win.recursive(users(spark, sf_dir), "t", *design.butterworth(1.0, 3, 10.0)))
