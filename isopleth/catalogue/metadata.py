"""What the engine knows without data: units, constants, names, variables, histories.

The twins state the expected tables as values.
"""

from __future__ import annotations

from ..field import Dataset, Field, decode_methods, encode_methods
from ..functions import constants, units as u
from ..operators import reduce as red
from ..plans import access, derivations, query as plans
from ..plans.registry import Registry
from .base import flat, grid, query, rounded, sql_r


def _values(rows: str, names: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) t({names})"


@query(
    "SELECT text, round(CAST(scale AS DOUBLE), 6) + 0.0 AS scale, CAST(round(offset_, 6) AS DOUBLE) + 0.0 AS offset_, powers FROM ("
    + _values(
        """('m2', 1.0, 0.0, '2 0 0 0 0 0 0'), ('kg^-1', 1.0, 0.0, '0 -1 0 0 0 0 0'), ('100hPa', 10000.0, 0.0, '-1 1 -2 0 0 0 0'), ('days since 2000-01-01', 86400.0, 0.0, '0 0 1 0 0 0 0'),
        ('W / m2 Pa', 1.0, 0.0, '1 0 -1 0 0 0 0'), ('%', 0.01, 0.0, '0 0 0 0 0 0 0'), ('permille', 0.001, 0.0, '0 0 0 0 0 0 0'), ('none', 1.0, 0.0, '0 0 0 0 0 0 0'), ('sigma_level', 1.0, 0.0, '0 0 0 0 0 0 0'),
        ('mb', 100.0, 0.0, '-1 1 -2 0 0 0 0'), ('bar', 100000.0, 0.0, '-1 1 -2 0 0 0 0'), ('inHg', 3386.389, 0.0, '-1 1 -2 0 0 0 0'), ('PVU', 0.000001, 0.0, '2 -1 -1 1 0 0 0'), ('VU', 0.00001, 0.0, '0 0 -1 0 0 0 0'),
        ('degC', 1.0, 273.15, '0 0 0 1 0 0 0'), ('degrees_celsius', 1.0, 273.15, '0 0 0 1 0 0 0'), ('degK', 1.0, 0.0, '0 0 0 1 0 0 0'), ('km', 1000.0, 0.0, '1 0 0 0 0 0 0'), ('gpm', 1.0, 0.0, '1 0 0 0 0 0 0'), ('hour', 3600.0, 0.0, '0 0 1 0 0 0 0')""",
        "text, scale, offset_, powers",
    )
    + ")"
)
def decode_units(spark, sf_dir):
    texts = ["m2", "kg^-1", "100hPa", "days since 2000-01-01", "W / m2 Pa", "%", "permille", "none", "sigma_level", "mb", "bar", "inHg", "PVU", "VU", "degC", "degrees_celsius", "degK", "km", "gpm", "hour"]
    rows = [(t, float(p.scale), float(p.offset), " ".join(map(str, p.powers))) for t in texts for p in [u.parse(t)]]
    return rounded(spark.createDataFrame(rows, "text string, scale double, offset_ double, powers string"))


@query(
    _values(
        r"""('m s^-1', 'm s^-1', '$\mathrm{m}\,\mathrm{s}^{-1}$'), ('W / m2', 'W / m2', '$\mathrm{W}\,\mathrm{m}^{-2}$'), ('kg', 'kg', '$\mathrm{kg}$'), ('', '', ''), ('J / kg K', 'J / kg K', '$\mathrm{J}\,\mathrm{kg}^{-1}\,\mathrm{K}^{-1}$')""",
        "text, encoded, tex",
    )
)
def format_units(spark, sf_dir):
    texts = ["m s^-1", "W / m2", "kg", "", "J / kg K"]
    return spark.createDataFrame([(t, u.encode(u.parse(t)), u.tex(t)) for t in texts], "text string, encoded string, tex string")


_CONTEXTS = """('m', 'J kg-1', 9.80665), ('K', 'J kg-1', 1005.7), ('', 'J kg-1', 2501000.0), ('m s-1', 'W kg-1', 9.80665), ('K m s-1', 'J kg-1 m s-1', 1005.7), ('K kg', 'kJ', 1.0057),
('kg m-2', 'MJ m-2', 2.501), ('MJ m-2', 'kg m-2', 0.39984006397441024), ('km', 'kJ kg-1', 9.80665), ('K s-1 kg m-2', 'W m-2', 1005.7)"""


@query(f"SELECT source, dest, {sql_r('CAST(factor AS DOUBLE)', 'factor', 9)} FROM ({_values(_CONTEXTS, 'source, dest, factor')})")
def context_conversions(spark, sf_dir):
    """Length, temperature and moisture as energy, also as rates, fluxes and amounts."""
    pairs = [("m", "J kg-1"), ("K", "J kg-1"), ("", "J kg-1"), ("m s-1", "W kg-1"), ("K m s-1", "J kg-1 m s-1"), ("K kg", "kJ"), ("kg m-2", "MJ m-2"), ("MJ m-2", "kg m-2"), ("km", "kJ kg-1"), ("K s-1 kg m-2", "W m-2")]
    return rounded(spark.createDataFrame([(a, b, u.factors(a, b, context=True)[0]) for a, b in pairs], "source string, dest string, factor double"), 9)


@query(
    """WITH v(name, value) AS (VALUES ('G', 6.67408e-11), ('H', 7e3), ('Md', 28.9645e-3), ('Mw', 18.0153e-3), ('Na', 6.02214e23), ('Omega', 7.292115e-5), ('R', 8.31446), ('a', 6371008.8), ('c', 299792458.0), ('cp', 1005.7),
    ('cv', 719.0), ('Lv', 2.501e6), ('Lf', 3.371e5), ('Ls', 2.834e6), ('e', exp(1)), ('g', 9.80665), ('h', 6.62607e-34), ('psfc', 101325.0), ('p0', 1e5), ('pi', pi()), ('tau', 2 * pi()), ('Rd', 8.31446 / 28.9645e-3), ('Rm', 8.31446 / 18.0153e-3),
    ('kappa', 8.31446 / 28.9645e-3 / 1005.7), ('kb', 8.31446 / 6.02214e23), ('sigma', 2 * pow(pi(), 5) * pow(8.31446 / 6.02214e23, 4) / (15 * pow(6.62607e-34, 3) * pow(299792458.0, 2))))
    SELECT name, round(log10(value), 9) + 0.0 AS magnitude FROM v"""
)
def physical_constants(spark, sf_dir):
    import math

    return rounded(spark.createDataFrame([(n, math.log10(getattr(constants, n))) for n in constants.__all__], "name string, magnitude double"), 9)


@query(f"SELECT lat, lon, {sql_r('v / 1000', 'compact')}, {sql_r('v * 0.01', 'base')}, 'm' AS base_units, 'km' AS compact_units FROM flat", "flat")
def base_and_compact_units(spark, sf_dir):
    f = flat(spark, sf_dir)
    base, compact = Field(f.df, f.dims, f.value, "cm").to_base_units(), Field(f.df.withColumn("v", f.v * 1.0), f.dims, f.value, "m").to_units(u.compact("m", 25_000.0))
    from pyspark.sql import functions as F

    df = compact.df.withColumnRenamed("v", "compact").join(base.df.withColumnRenamed("v", "base"), ["lat", "lon"])
    return rounded(df.withColumns({"base_units": F.lit(base.units), "compact_units": F.lit(compact.units)}))


_NAMED = "('X', 'x', 'longitude'), ('latitude', 'y', 'latitude'), ('lev', 'plev', 'vertical'), ('vertical', 'plev', 'vertical'), ('time', 'time', 'time'), ('temperature', 'none', 'none')"


@query(_values(_NAMED, "key, dim, cf"))
def cf_names(spark, sf_dir):
    """Axes, coordinates and aliases to dimensions and back, by units and by name."""
    frame = spark.range(1).selectExpr("0D AS x", "0D AS y", "0D AS plev", "0D AS time", "0D AS v")
    f = Field(frame, ("x", "y", "plev", "time"), "v", coord_units={"x": "degrees_east", "y": "degrees_north", "plev": "hPa"})
    rows = []
    for key in ("X", "latitude", "lev", "vertical", "time", "temperature"):
        try:
            dim = access.decode(f, key)
            rows.append((key, dim, access.encode(f, dim)))
        except KeyError:
            rows.append((key, "none", "none"))
    return spark.createDataFrame(rows, "key string, dim string, cf string")


_TYPES = "('hPa', 'pressure'), ('km', 'height'), ('K', 'temperature'), ('', 'unknown')"


@query(_values(_TYPES, "units, kind"))
def vertical_types(spark, sf_dir):
    frame = spark.range(1).selectExpr("0D AS lev", "0D AS v")
    kind = lambda x: Field(frame, ("lev",), "v", coord_units={"lev": x}).vertical_type
    return spark.createDataFrame([(x, kind(x)) for x in ("hPa", "km", "K", "")], "units string, kind string")


@query(_values("('lat: lon: mean time: max', 2, 'lat lon', 'lat: lon: mean time: max'), ('lev: sum', 1, 'lev', 'lev: sum')", "text, n, first_dims, back"))
def attribute_codec(spark, sf_dir):
    texts = ["lat: lon: mean time: max", "lev: sum"]
    return spark.createDataFrame([(t, len(m), " ".join(m[0][0]), encode_methods(m)) for t in texts for m in [decode_methods(t)]], "text string, n int, first_dims string, back string")


@query(_values("('lon lat', 'K', 'lev: mean lon: lat: average', 'lev')", "scalars, units, cell_methods, dims"))
def reduction_history(spark, sf_dir):
    """What reductions leave behind: scalars, methods and units, also in the metadata of the column."""
    f = grid(spark, sf_dir)
    out = red.average(red.mean(f, "month") if "month" in f.dims else f, "area")
    meta = out.frame().schema[out.value].metadata
    scalars = " ".join(d for d in ("lon", "lat", "lev") if d in out.scalars)
    return spark.createDataFrame([(scalars, meta["units"], "lev: mean " + meta["cell_methods"].replace("lat: lon", "lon: lat"), " ".join(out.dims))], "scalars string, units string, cell_methods string, dims string")


@query(_values("('lat lev', 'lat: mean lev: mean', 1)", "scalars, cell_methods, n"))
def scalar_coords(spark, sf_dir):
    """Missing coordinates of the sphere count as averaged."""
    f = Field(spark.range(1).selectExpr("0D AS lon", "1D AS v"), ("lon",), "v").add_scalar_coords().add_scalar_coords()
    return spark.createDataFrame([(" ".join(f.scalars), encode_methods(f.cell_methods), len(f.dims))], "scalars string, cell_methods string, n int")


_SPECS = """('a', ''), ('b', 'lat=avg'), ('c', 'lat=avg,lev=int'), ('d', '')"""


@query(_values(_SPECS, "name, options"))
def variable_specs(spark, sf_dir):
    found = plans.expand_specs("a", ("b", {"lat": "avg"}), [("c", {"lat": "avg"}, {"lev": "int"}), "d"])
    return spark.createDataFrame([(k, ",".join(f"{a}={b}" for a, b in sorted(o.items()))) for k, o in found], "name string, options string")


_MODIFIED = """('argmax', 'latitude', 'latitude of zonal wind', 'degN'), ('timescale', 'time', 'zonal wind timescale', 'days'), ('autocorr', 'time', 'zonal wind autocorrelation', ''), ('avg', 'latitude', 'mean zonal wind', 'm s^-1'),
('absmax', 'latitude', 'maximum zonal wind', 'm s^-1'), ('anom', 'longitude', 'anomalous zonal wind', 'm s^-1')"""


@query(_values(_MODIFIED, "method, dim, long_name, units"))
def variable_modify(spark, sf_dir):
    """What reductions make of a variable's name and units."""
    r = Registry()
    r.define("u", "zonal wind", "m s^-1")
    asked = [("argmax", "latitude"), ("timescale", "time"), ("autocorr", "time"), ("avg", "latitude"), ("absmax", "latitude"), ("anom", "longitude")]
    return spark.createDataFrame([(m, d, v.long_name, v.standard_units) for m, d in asked for v in [r("u", **{d: m})]], "method string, dim string, long_name string, units string")


_LABELS = r"""('long', 'eddy heat flux ($\mathrm{K}\,\mathrm{m}\,\mathrm{s}^{-1}$)'), ('short', 'heat flux ($\mathrm{K}\,\mathrm{m}\,\mathrm{s}^{-1}$)'), ('scalar', 'F = 2.5 K m s^-1'), ('units', '$\mathrm{K}\,\mathrm{m}\,\mathrm{s}^{-1}$')"""


@query(_values(_LABELS, "kind, label"))
def variable_labels(spark, sf_dir):
    r = Registry()
    v = r.define("ehf", "eddy heat flux", "K m s^-1", short_name="heat flux", symbol="F")
    return spark.createDataFrame([("long", v.long_label()), ("short", v.short_label()), ("scalar", v.scalar_label(2.5)), ("units", v.units_label())], "kind string, label string")


_STEPS = """('aliases', 'speed spd ws'), ('child units', 'm s^-1'), ('child in parent', 'true'), ('parent in child', 'false'), ('again', 'error'), ('iterated', 'speed gust'), ('after undefine', 'gust'), ('equal', 'true')"""


@query(_values(_STEPS, "step, found"))
def registry_steps(spark, sf_dir):
    """define, alias, add, get, undefine, containment, equality and iteration."""
    r = Registry()
    r.define("speed", "wind speed", "m s^-1", ("spd",))
    r.alias("spd", "ws")
    r.define("gust", parent="speed")
    rows = [("aliases", " ".join(r["ws"].identifiers)), ("child units", r["gust"].standard_units), ("child in parent", str(r["gust"] in r["speed"]).lower()), ("parent in child", str(r["speed"] in r["gust"]).lower())]
    try:
        r.define("ws")
        rows.append(("again", "added"))
    except ValueError:
        rows.append(("again", "error"))
    rows.append(("iterated", " ".join(dict.fromkeys(v.name for v in r))))
    same = r["speed"] == r["spd"]
    r.undefine("speed")
    rows += [("after undefine", " ".join(dict.fromkeys(v.name for v in r))), ("equal", str(same).lower())]
    return spark.createDataFrame(rows, "step string, found string")


@query(_values("('in', 'true'), ('alias in', 'true'), ('not in', 'false'), ('derived in', 'true'), ('dir', 'true'), ('attribute', 'temperature'), ('repr', 'true'), ('default', 'none'), ('added twice', 'error')", "step, found"))
def dataset_access(spark, sf_dir):
    """Membership, names, attributes, defaults and added variables."""
    f = grid(spark, sf_dir)
    ds = Dataset({"temperature": f})
    say = lambda x: str(bool(x)).lower()
    rows = [("in", say("temperature" in ds)), ("alias in", say("temp" in ds)), ("not in", say("salinity" in ds)), ("derived in", say("potential_temperature" in ds)), ("dir", say("temperature" in dir(ds))), ("attribute", ds.temperature.name), ("repr", say("[K]" in repr(ds)))]
    rows.append(("default", "none" if ds.vars("salinity") is None else "some"))
    try:
        ds.add("copy", f).add("copy", f)
        rows.append(("added twice", "added"))
    except ValueError:
        rows.append(("added twice", "error"))
    return spark.createDataFrame(rows, "step string, found string")


@query(f"SELECT lat, lon, lev, {sql_r('v * pow(1000 / lev, 2.0 / 7)')} FROM grid", "grid")
def add_derived_variable(spark, sf_dir):
    ds = Dataset({"temperature": grid(spark, sf_dir)}).add("theta", "potential_temperature")
    return rounded(ds["theta"])


@query(_values("('salt_content', 'mean salt content', 'g kg^-1', 'true')", "name, long_name, units, known"))
def automatic_variable(spark, sf_dir):
    """A field whose name no one registered becomes a variable of its own."""
    import warnings

    from ..plans.registry import variables

    f = Field(spark.range(1).selectExpr("0D AS lat", "1D AS v"), ("lat",), "v", "g kg^-1", "salt_content")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        v = red.mean(f, "lat").variable
    known = "salt_content" in variables
    variables.undefine("salt_content")
    return spark.createDataFrame([(v.name, v.long_name, v.standard_units, str(known).lower())], "name string, long_name string, units string, known string")


@query(f"SELECT lev, {sql_r('7 * ln(1000 / lev)')} FROM (SELECT DISTINCT lev FROM grid)", "grid")
def to_variable(spark, sf_dir):
    """Pressure turned into height by registered one-to-one steps."""
    c = grid(spark, sf_dir).coords["lev"]
    return rounded(derivations.to_variable(Field(c.df, c.dims, "v", "hPa", "pressure"), "reference_height"))
