"""Equivalent latitude, wave activity, and queries that chain operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..field import Dataset, Field
from ..operators import waves as wave
from ..plans import derivations, query as plans
from .base import flat, grid, monthly, query, rounded, sql_r, sql_truncated

_AREA = """bands AS (SELECT lat, sin(radians(least(lat + 5, 90))) - sin(radians(greatest(lat - 5, -90))) AS band FROM (SELECT DISTINCT lat FROM flat)),
cells AS (SELECT lat, lon, v, band * radians(10) * pow(6.3710088e6, 2) AS area FROM q JOIN bands USING (lat)),
ranked AS (SELECT v, row_number() OVER (ORDER BY v, lat, lon) - 1 AS i, count(*) OVER () AS n, sum(area) OVER (ORDER BY v) AS below, sum(area) OVER () AS total FROM cells)"""


def _quantised(spark, sf_dir) -> Field:
    # ties are the hard case of the running sums
    f = flat(spark, sf_dir)
    return f.with_value(F.floor(f.v * 20 + 0.5) / 20)


@query(
    f"""WITH q AS (SELECT lat, lon, floor(v * 20 + 0.5) / 20 AS v FROM flat), {_AREA.replace('cells AS', 'sized AS').replace('FROM cells', 'FROM sized')}
    SELECT {sql_r('v', 'q')}, {sql_r('degrees(asin(least(greatest(2 * below / total - 1, -1), 1)))', 'eqlat')}, CAST(i AS INTEGER) AS k FROM ranked WHERE i >= (n % 10) // 2 AND (i - (n % 10) // 2) % 10 = 0""",
    "flat",
)
def eqlat(spark, sf_dir):
    return rounded(wave.eqlat(_quantised(spark, sf_dir)))


# a mass that varies from cell to cell
_MASS = """m AS (SELECT lat, lon, 1 + (lat + 90) / 180 + (lon % 30) / 30 AS sigma FROM flat),
massed AS (SELECT lat, lon, v, sigma * band * radians(10) * pow(6.3710088e6, 2) AS mass FROM q JOIN bands USING (lat) JOIN m USING (lat, lon)),
rankedm AS (SELECT v, row_number() OVER (ORDER BY v, lat, lon) - 1 AS i, count(*) OVER () AS n, sum(mass) OVER (ORDER BY v) AS below FROM massed),
rows AS (SELECT greatest(lat - 5, -90) AS lo, least(lat + 5, 90) AS hi, sum(mass) AS m, sum(sum(mass)) OVER (ORDER BY lat) AS up FROM massed GROUP BY lat),
cm AS (SELECT v AS q, i AS k, min(lo + (hi - lo) * (below - up + m) / m) AS eqlat FROM rankedm JOIN rows ON below > up - m AND below <= up * (1 + 1e-12) WHERE i >= (n % 10) // 2 AND (i - (n % 10) // 2) % 10 = 0 GROUP BY v, i)"""


def _sigma(spark, sf_dir) -> Field:
    ones = flat(spark, sf_dir)
    return ones.with_value(1 + (F.col("lat") + 90) / 180 + (F.col("lon") % 30) / 30)


@query(f"WITH q AS (SELECT lat, lon, floor(v * 20 + 0.5) / 20 AS v FROM flat), {_AREA.split(',' + chr(10) + 'cells')[0]}, {_MASS} SELECT {sql_r('q', 'q')}, CAST(k AS INTEGER) AS k, {sql_r('eqlat', 'eqlat')} FROM cm", "flat")
def eqlat_mass(spark, sf_dir):
    return rounded(wave.eqlat(_quantised(spark, sf_dir), mass=_sigma(spark, sf_dir)))


def _activity(flip: bool, local: bool, massed: bool = False, omega: bool = False) -> str:
    """Every contour with every cell, said plainly."""
    sign = -1 if flip else 1
    base = f"WITH q AS (SELECT {sign} * lat AS lat, lon, {sign} * floor(v * 20 + 0.5) / 20 AS v, {sign} * v AS omega FROM flat), " + _AREA.replace("cells AS (SELECT lat, lon, v", "sized AS (SELECT lat, lon, v, omega").replace("FROM cells", "FROM sized")
    mass = ", " + _MASS.replace("m AS (SELECT lat, lon", f"m AS (SELECT {sign} * lat AS lat, lon") if massed else ""
    lines = "cm" if massed else "(SELECT v AS q, degrees(asin(least(greatest(2 * below / total - 1, -1), 1))) AS eqlat FROM ranked WHERE i >= (n % 10) // 2 AND (i - (n % 10) // 2) % 10 = 0)"
    key, what = ("lon, " if local else ""), ("omega" if omega else "v")
    size = "radians(least(lat + 5, 90) - greatest(lat - 5, -90)) * 6.3710088e6 * cos(radians(lat))" if local else "area"
    circle = "" if local else " * 2 * pi() * 6.3710088e6"
    return f"""{base}{mass}, lines AS (SELECT eqlat, min(q) AS q FROM {lines} GROUP BY eqlat),
    parts AS (SELECT *, least(greatest((sin(radians(eqlat)) - sin(radians(greatest(lat - 5, -90)))) / (sin(radians(least(lat + 5, 90))) - sin(radians(greatest(lat - 5, -90)))), 0), 1) AS south FROM sized CROSS JOIN lines),
    act AS (SELECT {key}eqlat, sum(CASE WHEN v >= q THEN south ELSE south - 1 END * {what} * {size}) / (cos(radians(eqlat)){circle}) AS a FROM parts WHERE abs(eqlat) < 90 - 1e-9 GROUP BY {key}eqlat),
    seg AS (SELECT {key}eqlat AS x0, a AS a0, lead(eqlat) OVER w AS x1, lead(a) OVER w AS a1, lag(eqlat) OVER w IS NULL AS first FROM act WINDOW w AS ({'PARTITION BY lon ' if local else ''}ORDER BY eqlat))
    SELECT {key}{sign} * lat AS lat, {sql_r('CASE WHEN lat <= x0 OR x1 IS NULL THEN a0 ELSE a0 + (lat - x0) * (a1 - a0) / (x1 - x0) END / 1e6', 'v', 5)}
    FROM seg JOIN (SELECT DISTINCT lat FROM q) ON (first OR lat >= x0) AND (x1 IS NULL OR lat < x1)"""


def _mega(f: Field):
    return rounded(f.with_value(f.v / 1e6), 5)


@query(_activity(True, False), "flat")
def waq(spark, sf_dir):
    return _mega(wave.waq(_quantised(spark, sf_dir)))


@query(_activity(False, False, massed=True, omega=True), "flat")
def waq_mass_omega(spark, sf_dir):
    """Contours by mass, another field as the integrand, not flipped."""
    return _mega(wave.waq(_quantised(spark, sf_dir), sigma=_sigma(spark, sf_dir), omega=flat(spark, sf_dir), flip=False))


@query(_activity(True, True), "flat")
def waqlocal(spark, sf_dir):
    return _mega(wave.waqlocal(_quantised(spark, sf_dir)))


def _dataset(spark, sf_dir) -> Dataset:
    return Dataset({"temperature": grid(spark, sf_dir), "momentum": flat(spark, sf_dir), "monthly": monthly(spark, sf_dir)})


@query(f"WITH {sql_truncated(-45, 45)} SELECT lon, lev, {sql_r('abs(sum(v * w) / sum(w) - 1)')} FROM cut JOIN clipped USING (lat) GROUP BY ALL", "grid")
def get_reduce_chain(spark, sf_dir):
    """Fetch, truncate and average, subtract, magnitude."""
    ds = _dataset(spark, sf_dir)
    f = ds.get("temperature", lat="avg", lat_lim=(-45, 45), subtract=1.0)
    return rounded(f.abs())


@query(f"SELECT lat, lon, lev, {sql_r('v * pow(1000 / lev, 2.0 / 7)')} FROM grid", "grid")
def get_derived_variable(spark, sf_dir):
    """Potential temperature, found backwards from its name."""
    return rounded(_dataset(spark, sf_dir)["pot_temp"])


@query(f"SELECT lat, {sql_r('2 * 7.292115e-5 * sin(radians(lat)) * 1e6')} FROM (SELECT DISTINCT lat FROM grid)", "grid")
def derived_coordinate(spark, sf_dir):
    f = derivations.resolve(_dataset(spark, sf_dir), "coriolis_parameter")
    return rounded(f.with_value(f.v * 1e6))


@query(
    f"""WITH y AS (SELECT lat, lon, sum(v * w) AS v FROM grid JOIN levw USING (lev) GROUP BY lat, lon),
    z AS (SELECT lat, sum(v * w) / sum(w) AS v FROM y JOIN lonw USING (lon) GROUP BY lat),
    g AS (SELECT lat, v, v - lag(v) OVER o AS d0, lead(v) OVER o - v AS d1, lag(v) OVER o AS v0, lead(v) OVER o AS v1 FROM z WINDOW o AS (ORDER BY lat)),
    e AS (SELECT CASE WHEN d0 / (d0 - d1) <= 0.5 THEN (v0 + v) / 2 + (v - v0) * d0 / (d0 - d1) ELSE v + (v1 - v) * (d0 / (d0 - d1) - 0.5) END AS y FROM g WHERE d0 > 0 AND d1 < 0
      UNION ALL SELECT v FROM z WHERE lat = (SELECT min(lat) FROM z) OR lat = (SELECT max(lat) FROM z))
    SELECT round(max(y), 4) + 0.0 AS v FROM e""",
    "grid", "levw", "lonw",
)
def budget_strength(spark, sf_dir):
    """The extremum in latitude of the zonal mean of the vertical integral."""
    return rounded(_dataset(spark, sf_dir).get("temperature_strength"), 4)


@query(f"SELECT lat, {sql_r('1 / avg(1 / v)')} FROM monthly GROUP BY lat", "monthly")
def reduce_dispatch(spark, sf_dir):
    """Named method between reciprocals."""
    return rounded(plans.reduce(_dataset(spark, sf_dir)["monthly"], month="mean", invert=True))


@query(f"SELECT lat, lon, {sql_r('b.v - a.v')} FROM grid a JOIN grid b USING (lat, lon) WHERE a.lev = 200 AND b.lev = 600", "grid")
def get_pair(spark, sf_dir):
    return rounded(_dataset(spark, sf_dir).get("temperature_anomaly", pair=("lev", (200.0, 600.0))))


_VARIABLES = """('longitude', 'longitude', 'degE', ['lon']), ('latitude', 'latitude', 'degN', ['lat']), ('cell_width', 'cell width', 'km', ['width']), ('cell_depth', 'cell depth', 'km', ['depth']),
('cell_height', 'cell height', 'kg m^-2', ['height_mass']), ('cell_duration', 'cell duration', 'days', ['duration']), ('cell_area', 'cell area', 'km^2', ['area']), ('cell_volume', 'cell volume', 'kg', ['volume']),
('meridional_coordinate', 'meridional coordinate', 'km', []), ('cosine_latitude', 'cosine latitude', '', []), ('coriolis_parameter', 'Coriolis parameter', 's^-1', []), ('beta_parameter', 'beta parameter', 'm^-1 s^-1', []),
('reference_height', 'reference height', 'km', []), ('reference_density', 'reference density', 'kg m^-3', []), ('reference_potential_temperature', 'reference potential temperature', 'K', []),
('energy', 'energy', 'MJ m^-2 100hPa^-1', []), ('energy_flux', 'vertical energy flux', 'W m^-2 100hPa^-1', []), ('meridional_energy_flux', 'meridional energy flux', 'MJ m^-2 100hPa^-1 m s^-1', []),
('momentum', 'momentum', 'm s^-1', []), ('meridional_momentum_flux', 'meridional momentum flux', 'm^2 s^-2', []), ('acceleration', 'acceleration', 'm s^-1 day^-1', []), ('temperature', 'temperature', 'K', ['t', 'temp']),
('pressure', 'pressure', 'hPa', ['pres']), ('potential_temperature', 'potential temperature', 'K', ['pot_temp'])"""


@query(f"SELECT name, long_name, standard_units, array_to_string(aliases, ',') AS aliases FROM (VALUES {_VARIABLES}) v(name, long_name, standard_units, aliases)")
def variable_registry(spark, sf_dir):
    """The variables that are there from the start."""
    from ..plans.registry import Registry, define_defaults

    own = Registry()
    define_defaults(own)
    return own.frame(spark).withColumn("aliases", F.array_join("aliases", ","))
