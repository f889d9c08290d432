"""Look-up by label and place, coordinates and their edges, own weights, varying limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..field import Dataset, Field
from ..functions import design
from ..functions.units import Quantity
from ..operators import calculus as cal, features as feat, grid as grids, reduce as red, select as sel, spectral as spec, stats, windows as win
from ..plans import access, derivations
from .base import flat, grid, monthly, query, rounded, sql_r, sql_truncated, users
from .calculus import _PASS
from .statistics import _FIT

_PLACE = "(SELECT *, dense_rank() OVER (ORDER BY lev) - 1 AS k FROM grid)"


@query(f"SELECT lat, lon, lev, {sql_r('v')} FROM {_PLACE} WHERE k >= 1 AND k < 3", "grid")
def item_slice(spark, sf_dir):
    """The second and third level, by place."""
    return rounded(grid(spark, sf_dir)[..., 1:3])


@query(f"SELECT lat, lon, {sql_r('v')} FROM {_PLACE} WHERE k = (SELECT max(dense_rank) FROM (SELECT dense_rank() OVER (ORDER BY lev) - 1 AS dense_rank FROM grid))", "grid")
def item_last(spark, sf_dir):
    return rounded(grid(spark, sf_dir)[{"vertical": -1}])


@query("SELECT DISTINCT lat, lat AS v FROM grid", "grid")
def item_coordinate(spark, sf_dir):
    """A coordinate by its CF axis."""
    return rounded(grid(spark, sf_dir)["Y"])


@query(f"SELECT lat, lon, lev, {sql_r('v')} FROM grid WHERE lev BETWEEN 150 AND 450", "grid")
def loc_quantity(spark, sf_dir):
    """A range of labels in other units than the coordinate's."""
    return rounded(grid(spark, sf_dir).loc[{"lev": slice(Quantity(150, "mbar"), Quantity(45000, "Pa"))}])


@query(f"SELECT lat, lon, lev, CASE WHEN lat BETWEEN -30 AND 30 AND lev IN (100, 300) THEN 273.15 ELSE {sql_r('v').removesuffix(' AS v')} END AS v FROM grid", "grid")
def loc_assign(spark, sf_dir):
    f = grid(spark, sf_dir)
    return rounded(f.loc.set({"latitude": slice(-30, 30), "lev": [100, 300]}, Quantity(0, "degC")))


@query(f"SELECT g.lat, g.lon, g.lev, {sql_r('CASE WHEN k = 0 AND f.v IS NOT NULL THEN f.v ELSE g.v END')} FROM {_PLACE} g LEFT JOIN flat f USING (lat, lon)", "grid", "flat")
def item_assign(spark, sf_dir):
    """Another field put into the first level."""
    top = flat(spark, sf_dir)
    return rounded(grid(spark, sf_dir).set({"lev": 0}, Field(top.df, top.dims, top.value)))


@query(f"SELECT lev, {sql_r('v')} FROM (SELECT lev, avg(v) AS v FROM grid WHERE lat = -5 AND lon = 0 GROUP BY lev)", "grid")
def dataset_loc(spark, sf_dir):
    ds = Dataset({"temperature": grid(spark, sf_dir), "momentum": flat(spark, sf_dir)}).loc[{"lat": -5.0, "lon": 0.0}]
    return rounded(ds.fields["temperature"])


_EDGES = """e AS (SELECT lat, CASE WHEN lag(lat) OVER o IS NULL THEN lat ELSE (lag(lat) OVER o + lat) / 2 END AS lo, CASE WHEN lead(lat) OVER o IS NULL THEN lat ELSE (lead(lat) OVER o + lat) / 2 END AS hi
FROM (SELECT DISTINCT lat FROM grid) WINDOW o AS (ORDER BY lat))"""


@query(f"WITH {_EDGES} SELECT lat, 0 AS bnds, {sql_r('lo')} FROM e UNION ALL SELECT lat, 1, {sql_r('hi')} FROM e", "grid")
def coordinate_bounds(spark, sf_dir):
    return rounded(grid(spark, sf_dir).coords["lat_bnds"])


@query(f"WITH {_EDGES} SELECT lat, {sql_r('lo', 'bot')}, {sql_r('hi', 'top')}, {sql_r('hi - lo', 'del')} FROM e", "grid")
def coordinate_edges(spark, sf_dir):
    c = grid(spark, sf_dir).coords
    parts = [c[f"latitude_{s}"].df.withColumnRenamed("v", s) for s in ("bot", "top", "del")]
    return rounded(parts[0].join(parts[1], "lat").join(parts[2], "lat"))


@query(f"WITH {_EDGES} SELECT lat, {sql_r('2 * 7.292115e-5 * abs(sin(radians(hi)) - sin(radians(lo))) * 1e6')} FROM e", "grid")
def derived_coordinate_edges(spark, sf_dir):
    """The change of the Coriolis parameter over each cell, from its edges."""
    f = grid(spark, sf_dir).coords["coriolis_parameter_del"]
    return rounded(f.with_value(f.v * 1e6))


@query(f"SELECT lat, lev, {sql_r('sum(v * (1 + lon / 100)) / sum(1 + lon / 100)')} FROM grid GROUP BY ALL", "grid")
def own_cell_measures(spark, sf_dir):
    """Weights of the field's own in place of the default ones."""
    f = grid(spark, sf_dir)
    lon = f.coords["lon"]
    return rounded(red.average(f.add_cell_measures({"width": lon.with_value(1 + lon.v / 100)}), "lon"))


@query(f"SELECT lat, lon, {sql_r('a.w * o.w * 6371.0088 * 6371.0088')} FROM latw a CROSS JOIN lonw o", "latw", "lonw")
def default_cell_measures(spark, sf_dir):
    f = flat(spark, sf_dir)
    once = f.add_cell_measures(["area"]).add_cell_measures({"area": f})  # does not override
    return rounded(once.measures["area"])


@query("SELECT month, CAST(coalesce(date_diff('day', lag(month) OVER o, month), date_diff('day', month, lead(month) OVER o)) AS DOUBLE) AS days FROM (SELECT DISTINCT month FROM monthly) WINDOW o AS (ORDER BY month)", "monthly")
def cell_duration(spark, sf_dir):
    """Times are the ends of cells; the first is as long as the second."""
    return rounded(grids.time_bounds(monthly(spark, sf_dir).df, "month").select("month", "days"))


@query(
    f"""WITH e AS (SELECT lev, coalesce((lag(lev) OVER o + lev) / 2, lev) AS t, coalesce((lead(lev) OVER o + lev) / 2, lev) AS b FROM (SELECT DISTINCT lev FROM grid) WINDOW o AS (ORDER BY lev)),
    s AS (SELECT lat, 400 + lat * 2 AS ps FROM (SELECT DISTINCT lat FROM grid))
    SELECT lat, lev, {sql_r('greatest((least(b, ps) - greatest(t, 200)) * 100 / 9.80665, 0)')} FROM e CROSS JOIN s""",
    "grid",
)
def cell_height(spark, sf_dir):
    """Mass of layers between a surface that varies and a tropopause."""
    f = grid(spark, sf_dir)
    edges = f.coords["lev_bnds"].df.groupBy("lev").pivot("bnds", [0, 1]).agg(F.first("v")).toDF("lev", "t", "b")
    both = edges.crossJoin(F.broadcast(f.coords["lat"].df.select("lat", (400 + F.col("lat") * 2).alias("ps"))))
    return rounded(both.select("lat", "lev", grids.cell_height(F.col("b"), F.col("t"), surface=F.col("ps"), tropopause=F.lit(200.0)).alias("v")))


#: Averages of few whole numbers end in halves of a digit; times this they do not.
_UNEVEN = 0.7310585786300049
_TRACKS = [(lo, hi) for lo in (-45, -12) for hi in (20, 33)]


def _track(number: int, lo: int, hi: int) -> str:
    return f"SELECT * FROM (WITH {sql_truncated(lo, hi)} SELECT lon, lev, {number} AS track, {sql_r(f'{_UNEVEN!r} * sum(v * w) / sum(w)', 'v', 9)} FROM cut JOIN clipped USING (lat) GROUP BY ALL)"


@query(" UNION ALL ".join(_track(i, *t) for i, t in enumerate(_TRACKS)), "grid")
def truncate_tracks(spark, sf_dir):
    """Two lower limits, one of them with units, with two upper ones: four averages."""
    ds = Dataset({"temperature": grid(spark, sf_dir)})
    f = ds.get("temperature", lat="avg", lat_min=[-45, Quantity(-720, "arcmin")], lat_max=[20, 33])
    return rounded(f.with_value(f.v * _UNEVEN), 9)


@query(
    f"""WITH b AS (SELECT DISTINCT lon, lon / 10 - 40 AS lo, 60 - lon / 20 AS hi FROM grid),
    seg AS (SELECT g.lon, lev, lo, hi, lat AS x0, v AS y0, lead(lat) OVER o AS x1, lead(v) OVER o AS y1, lead(lat, 2) OVER o IS NULL AS last FROM grid g JOIN b USING (lon) WINDOW o AS (PARTITION BY g.lon, lev ORDER BY lat)),
    cut AS (SELECT lon, lev, x AS lat, y0 + (x - x0) * (y1 - y0) / (x1 - x0) AS v FROM (SELECT *, unnest([lo, hi]) AS x FROM seg) WHERE x1 IS NOT NULL AND x >= x0 AND (x < x1 OR last AND x <= x1)
      UNION ALL SELECT g.lon, lev, lat, v FROM grid g JOIN b USING (lon) WHERE lat > lo AND lat < hi),
    w AS (SELECT *, (coalesce(lead(lat) OVER o, lat) - coalesce(lag(lat) OVER o, lat)) / 2 AS w
      FROM (SELECT lon, lat FROM b JOIN (SELECT DISTINCT lat FROM grid) ON lat > lo AND lat < hi UNION SELECT lon, lo FROM b UNION SELECT lon, hi FROM b) WINDOW o AS (PARTITION BY lon ORDER BY lat))
    SELECT lon, lev, {sql_r(f'{_UNEVEN!r} * sum(v * w) / sum(w)', 'v', 9)} FROM cut JOIN w USING (lon, lat) GROUP BY ALL""",
    "grid",
)
def truncate_variable(spark, sf_dir):
    """Limits that are variables of longitude, looked up by name."""
    f = grid(spark, sf_dir)
    lon = f.coords["lon"]
    ds = Dataset({"temperature": f, "south": lon.with_value(lon.v / 10 - 40, units="degN"), "north": lon.with_value(60 - lon.v / 20, units="degN")})
    f = ds.get("temperature", lat="avg", lat_min="south", lat_max=("north", {}))
    return rounded(f.with_value(f.v * _UNEVEN), 9)


@query(f"SELECT lat, lev, {sql_r('v')} FROM (SELECT lat, lev, v FROM (SELECT lat, lon AS x0, v AS y0, lead(lon) OVER o AS x1, lead(v) OVER o AS y1, lev FROM grid WINDOW o AS (PARTITION BY lat, lev ORDER BY lon)) s, LATERAL (SELECT y0 + (33 - x0) * (y1 - y0) / (x1 - x0) AS v) WHERE 33 >= x0 AND 33 < x1)", "grid")
def interp_quantity(spark, sf_dir):
    """A point in other units."""
    return rounded(Dataset({"temperature": grid(spark, sf_dir)}).get("temperature", lon=Quantity(33 * 60, "arcmin")))


@query("SELECT user_id, t, CASE WHEN count(v) OVER o = 5 THEN round(avg(v) OVER o, 6) + 0.0 END AS v FROM users WINDOW o AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "users")
def runmean_quantity(spark, sf_dir):
    """A width of time instead of a number of steps."""
    return rounded(win.runmean(users(spark, sf_dir), "t", Quantity(5 / 60, "min")))


@query(f"SELECT CAST(case_ AS DOUBLE) AS case_, lat, lon, {sql_r('v * case_')} FROM flat CROSS JOIN (VALUES (1), (2)) c(case_)", "flat")
def concat_new_dim(spark, sf_dir):
    f = flat(spark, sf_dir)
    return rounded(access.concat([f, f.with_value(f.v * 2)], "case_", [1, 2]))


@query("SELECT 'lev lat lon v' AS dims, 'lat lon lev v' AS dataset, 'lon' AS parameters", "grid")
def dimension_order(spark, sf_dir):
    """Dimensions as asked for, in a dataset's order, and those with a reference value."""
    from ..plans.registry import variables

    f = grid(spark, sf_dir)
    ds = Dataset({"a": f, "b": f.transpose("lon", "lat")})
    asked = f.transpose("lat", "lon")
    known = variables.get("longitude")
    try:
        variables.add(access.replace_reference(known, 0.0), override=True)
        names = " ".join(p.dims[0] for p in f.parameters)
    finally:
        variables.add(known, override=True)
    return spark.createDataFrame([(" ".join(asked.df.columns), " ".join(ds["b"].df.columns), names)], "dims string, dataset string, parameters string")


_D1 = "SELECT user_id, t, v, coalesce((lead(v) OVER o - lag(v) OVER o) / 2, lead(v) OVER o - v, v - lag(v) OVER o) AS d FROM users WINDOW o AS (PARTITION BY user_id ORDER BY t)"


@query(
    f"""WITH g AS ({_D1}), n AS (SELECT *, lead(d) OVER o AS dn, lag(d) OVER o AS dp, lead(v) OVER o AS vn FROM g WINDOW o AS (PARTITION BY user_id ORDER BY t))
    SELECT user_id, {sql_r('CASE WHEN d = 0 THEN t ELSE t - d / (dn - d) END', 'x0')}, {sql_r('CASE WHEN d = 0 THEN v ELSE v - d / (dn - d) * (vn - v) END', 'y0')}, 'posneg' AS kind
    FROM n WHERE (d * dn < 0 AND d > 0) OR (d = 0 AND dp * dn < 0 AND dp > 0)""",
    "users",
)
def find_centered(spark, sf_dir):
    """Maxima where the derivative on the points changes sign."""
    return rounded(feat.find(users(spark, sf_dir), "t", diff=1, which="posneg", centered=True))


@query(f"SELECT user_id, t, {sql_r('d')} FROM ({_D1})", "users")
def derivative_method(spark, sf_dir):
    """Any derivative of a field, edges kept."""
    return rounded(cal.derivative(users(spark, sf_dir), t=1))


_BASE = f"WITH c AS (SELECT user_id, t, v - avg(v) OVER (PARTITION BY user_id) AS z, avg(v) OVER (PARTITION BY user_id) AS m FROM users), p AS (SELECT user_id, t, m, {_PASS} AS z FROM c)"
_WEIGHTS = [float(x) for x in design.lanczos(1.0, 9, 4.0)[0]]
_LEN = len(_WEIGHTS)


@query(f"{_BASE} SELECT user_id, t, {sql_r('z')} FROM (SELECT user_id, t, lead(z, {(_LEN - 1) // 2}) OVER (PARTITION BY user_id ORDER BY t) + m AS z FROM p) WHERE z IS NOT NULL", "users")
def filter_cut_ends(spark, sf_dir):
    """No rows where the filter does not see all of its window."""
    return rounded(win.fir(users(spark, sf_dir), "t", _WEIGHTS, pad=False))


@query(f"{_BASE} SELECT user_id, t, round(coalesce(lead(z, {(_LEN - 1) // 2}) OVER (PARTITION BY user_id ORDER BY t) + m, -1), 6) + 0.0 AS v FROM p", "users")
def filter_pad_value(spark, sf_dir):
    return rounded(win.fir(users(spark, sf_dir), "t", _WEIGHTS, pad_value=-1.0))


@query("SELECT round(i / 400.0, 6) + 0.0 AS x, round(" + " + ".join(f"{w!r} * cos(2 * pi() * i / 400 * {k - (_LEN - 1) // 2})" for k, w in enumerate(_WEIGHTS)) + ", 6) + 0.0 AS h FROM range(400) r(i)")
def filter_response_manual(spark, sf_dir):
    """The signed response of a symmetric filter."""
    return rounded(spec.response(spark, 1.0, _WEIGHTS, n=400, manual=True))


@query(f"SELECT lat, lon, lev, {sql_r('v + 273.15', 'v')} FROM grid", "grid")
def derivation_pair(spark, sf_dir):
    """One derivation of two variables, of which the second is asked for, with units checked."""
    derivations.register_derivation("air_celsius", ("air_fahrenheit", "air_kelvin"), ("degC",), ("degF", "K"))(lambda c: (c * 1.8 + 32, c + 273.15))
    f = grid(spark, sf_dir)
    return rounded(Dataset({"air_celsius": Field(f.df, f.dims, f.value, "degC", "air_celsius")})["air_kelvin"])


@query(f"SELECT lat, lon, lev, {sql_r('(v * 1000 + 1) / 1000')} FROM grid", "grid")
def unit_decorator(spark, sf_dir):
    """A function that asks for metres is handed them and its result labelled."""
    step = derivations.with_units("m", out="m")(lambda f: f + 1.0)
    f = grid(spark, sf_dir)
    return rounded(step(Field(f.df, f.dims, f.value, "km", "height")).to_units("km"))


@query(f"SELECT lat, lon, {sql_r('v * 1000 + 2')} FROM flat", "flat")
def quantity_arithmetic(spark, sf_dir):
    """Sums convert quantities and fields of other units; without quantities they don't."""
    f = flat(spark, sf_dir)
    far = Field(f.df, f.dims, f.value, "km")
    near = far.to_units("m") + Quantity(200, "cm")
    assert (near.magnitude.units, near.units_label, near.dequantify().quantified) == ("", r"$\mathrm{m}$", False)
    return rounded(near)


@query(f"SELECT lat, lev, {sql_r('lev * 100 / 9.80665 * radians(lat)')} FROM (SELECT DISTINCT lat, lev FROM grid)", "grid")
def outer_product(spark, sf_dir):
    """Fields that share no dimension."""
    c = grid(spark, sf_dir).coords
    return rounded(c["lat"].to_units("rad") * (c["lev"].to_units("Pa") / Quantity(9.80665, "m s^-2")))


@query(
    f"""WITH r AS (SELECT lat, lon, v AS q, coalesce(lead(v) OVER o, v) - coalesce(lag(v) OVER o, v) AS g FROM flat WINDOW o AS (PARTITION BY lon ORDER BY lat))
    SELECT lat, lon, lev, CASE WHEN abs(q) BETWEEN 20 AND 30 AND g > 0 AND abs(lat) BETWEEN 30 AND 60 THEN {sql_r('v').removesuffix(' AS v')} END AS v FROM grid JOIN r USING (lat, lon)""",
    "grid", "flat",
)
def mask_pv(spark, sf_dir):
    """Also a rising gradient and middle latitudes."""
    q = flat(spark, sf_dir)
    # rounded so that both engines see the same sign of the gradient
    return rounded(sel.mask(grid(spark, sf_dir), q, 20, 30, kind="pv"))


@query(
    f"""WITH a AS (SELECT * FROM grid UNION ALL SELECT lat, lon, 0, v FROM grid WHERE lev = 100 UNION ALL SELECT lat, lon, 1013.25, v FROM grid WHERE lev = 700),
    b AS (SELECT * FROM a UNION ALL SELECT -90, lon, lev, 0 FROM a WHERE lat = -85 UNION ALL SELECT 90, lon, lev, 0 FROM a WHERE lat = 85)
    SELECT lat, lon, CAST(lev AS DOUBLE) AS lev, {sql_r('v')} FROM b""",
    "grid",
)
def enforce_global_vertical(spark, sf_dir):
    """To the top and surface, with empty poles."""
    return rounded(grids.enforce_global(grid(spark, sf_dir), longitude=False, vertical=True, zero=True))


@query(f"SELECT lat, lon, lev, {sql_r('v')} FROM grid WHERE lev IN (300, 700)", "grid")
def sel_pad_tolerance(spark, sf_dir):
    """The level at or before each target, if it is near enough."""
    return rounded(sel.sel(grid(spark, sf_dir), "pad", 50, lev=[340, 480, 50, 720]))


@query(f"SELECT lat, lon, lev, {sql_r('v')} FROM grid WHERE lev IN (400, 500)", "grid")
def sel_backfill(spark, sf_dir):
    return rounded(sel.sel(grid(spark, sf_dir), "backfill", lev=[340, 480, 900]))


@query(f"{_FIT} SELECT user_id, CAST(k AS DOUBLE) AS lag, round(CASE WHEN k = 0 THEN 1 ELSE exp(-k * rate) END, 5) + 0.0 AS fit FROM (SELECT user_id, rate, unnest(range(0, 7)) AS k FROM g WHERE i = 200)", "users")
def timescale_curve(spark, sf_dir):
    """The fitted exponential at lags beyond those it was fitted to, too."""
    return rounded(stats.timescale_curve(users(spark, sf_dir), "t", imaxlag=20, imaxlag_fit=6), 5)


@query("SELECT * FROM (VALUES ('m s^-2', 'm'), ('m s^-1', 'm'), ('s', 'error')) t(units, sum_units)")
def unit_relations(spark, sf_dir):
    """Units of results from those of inputs, with options, and inputs that must agree."""
    from pyspark.sql import functions as fn

    one = lambda units: Field(spark.range(1).select(fn.lit(0.0).alias("x"), fn.lit(3.0).alias("v")), ("x",), "v", units)
    rate = derivations.with_units("=y", "=t", out="=y / t ^ {order}")(lambda y, t, order=1: y)
    both = derivations.with_units("=y", "=y", out="=y")(lambda a, b: a + b)
    try:
        both(one("m"), one("s"))
        wrong = "added"
    except ValueError:
        wrong = "error"
    rows = [(rate(one("m"), one("s"), order=2).units, both(one("m"), one("km")).units), (rate(one("m"), one("s")).units, both(one("m"), one("cm")).units), (one("s").units, wrong)]
    return spark.createDataFrame(rows, "units string, sum_units string")


@query(
    f"""WITH q AS (SELECT lat, lon, (v - 15.037) / 9.713 AS q FROM flat)
    SELECT lat, lev, {sql_r('avg(v)')} FROM (SELECT g.lat, g.lon, lev, CASE WHEN abs(q) BETWEEN 0.1 AND 2 THEN v END AS v FROM grid g JOIN q USING (lat, lon)) GROUP BY ALL""",
    "grid", "flat",
)
def reduce_masked(spark, sf_dir):
    """A preset mask before a mean, with potential vorticity in other units."""
    q = flat(spark, sf_dir)
    pv = Field(q.df, q.dims, q.value).with_value((q.v - 15.037) / 9.713 * 1e-6, units="K m^2 s^-1 kg^-1")
    return rounded(Dataset({"temperature": grid(spark, sf_dir), "pv": pv}).get("temperature", lon="mean", mask="trop"))


_LEVELS = "seg AS (SELECT lat, lon, lev AS x0, v AS y0, lead(lev) OVER o AS x1, lead(v) OVER o AS y1, lag(lev) OVER o IS NULL AS first, lead(lev, 2) OVER o IS NULL AS last FROM grid WINDOW o AS (PARTITION BY lat, lon ORDER BY lev))"


@query(f"WITH {_LEVELS} SELECT lat, lon, {sql_r('y0 + (x - x0) * (y1 - y0) / (x1 - x0)')} FROM (SELECT *, 400 + 2 * lat AS x FROM seg) WHERE x1 IS NOT NULL AND (x >= x0 OR first) AND (x < x1 OR last)", "grid")
def reduce_at_variable(spark, sf_dir):
    """The values at the level that another variable says, which is in other units."""
    f = grid(spark, sf_dir)
    lat = f.coords["lat"]
    ds = Dataset({"temperature": f, "tropopause": lat.with_value((400 + 2 * lat.v) * 100, units="Pa")})
    return rounded(ds.get("temperature", lev="tropopause"))


@query(f"WITH {_LEVELS} SELECT lat, lon, CAST(x AS DOUBLE) AS lev, {sql_r('y0 + (x - x0) * (y1 - y0) / (x1 - x0)')} FROM seg CROSS JOIN (VALUES (150), (525)) t(x) WHERE x1 IS NOT NULL AND (x >= x0 OR first) AND (x < x1 OR last)", "grid")
def reduce_at_points(spark, sf_dir):
    ds = Dataset({"temperature": grid(spark, sf_dir)})
    return rounded(ds.get("temperature", lev=[150, Quantity(52500, "Pa")]))
