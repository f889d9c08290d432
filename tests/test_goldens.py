"""Documented examples with printed outputs, and literal edge cases."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from isopleth.field import Dataset, Field, decode_methods, encode_methods
from isopleth.functions import constants, design, units
from isopleth.operators import calculus, features, grid, kernels, reduce, select, spectral, stats, windows
from isopleth.plans import derivations, query
from isopleth.plans.registry import Registry, variables
from isopleth.sources import generators, tables

STATE = 51423


def series(spark, y: np.ndarray, dims=("s", "x"), x=None) -> Field:
    """A field from rows of series; NaN stays for ``Field.of`` to clean."""
    y = np.atleast_2d(y)
    x = range(y.shape[1]) if x is None else x
    rows = [(i, float(t) if isinstance(t, (float, np.floating)) else int(t), float(v)) for i, row in enumerate(y) for t, v in zip(x, row, strict=True)]
    kind = "double" if isinstance(rows[0][1], float) else "int"
    return Field.of(spark.createDataFrame(rows, f"{dims[0]} int, {dims[1]} {kind}, v double"), dims)


def one(spark, x, y) -> Field:
    return Field.of(spark.createDataFrame([(float(a), None if b is None else float(b)) for a, b in zip(x, y, strict=True)], "x double, v double"), ("x",))


def test_slope(spark):
    state = np.random.RandomState(STATE)
    y = state.rand(10, 500) + 0.1 * np.arange(500)
    rows = sorted(stats.slope(series(spark, y), "x").collect())
    assert np.allclose([r.slope for r in rows][:2], [0.10000399, 0.09997467], atol=5e-9)


def test_histogram(spark):
    state = np.random.RandomState(STATE)
    y = state.rand(20, 1000)
    f = series(spark, y)
    out = sorted(reduce.histogram(f, "x", np.linspace(0, 1, 11).tolist()).df.collect())
    assert len(out) == 200
    want = np.histogram(y[0], np.linspace(0, 1, 11))[0]
    assert [r["count"] for r in out[:10]] == want.tolist()
    assert np.allclose([r.bins for r in out[:10]], np.arange(0.05, 1, 0.1))


def test_power_and_copower(spark):
    state = np.random.RandomState(STATE)
    y1 = state.rand(1000, 50)
    f = series(spark, y1[:, :3].T, ("s", "t"))
    got = sorted(spectral.power(f, "t").df.collect())
    first = [r.power for r in got if abs(r.f - 0.001) < 1e-12]
    assert np.allclose(first, [1.18298459e-04, 1.09036599e-04, 3.76719588e-04], rtol=1e-7)
    y2 = state.rand(1000, 50)
    co = sorted(spectral.copower(f, series(spark, y2[:, :3].T, ("s", "t")), "t").collect())
    row = [r for r in co if abs(r.f - 0.001) < 1e-12]
    assert np.allclose([r.c for r in row][:2], [-1.55726091e-04, -2.51099398e-04], rtol=1e-7)
    assert np.allclose([r.q for r in row][:2], [3.39059554e-05, -5.49872491e-05], rtol=1e-7)


def test_window_power_loss():
    w, noise = design.window(200, "hann"), np.random.RandomState(STATE).rand(200)
    for y, want in ((np.sin(np.arange(0, 8 * np.pi - 0.01, np.pi / 25)), 0.375), (noise, 0.5728391743988162)):
        lost = (np.abs(np.fft.fft(y * w)[1:] / len(y)) ** 2).sum() / y.var()
        assert abs(lost - want) < 1e-9
        assert abs(kernels.power(1.0, y)[1].sum() / y.var() - 1) < 1e-12


def test_periodic_windows():
    assert np.allclose(design.window(4, "hann"), [0, 0.5, 1, 0.5])
    for name in ("kaiser", "gaussian"):
        with pytest.raises(ValueError):
            design.window(5, name)


def test_timescale(spark):
    # lag-1 form and fit agree on an exact exponential
    assert abs(kernels.fit_timescale(1.0, np.exp(-np.arange(30) / 4.5))[0] - 4.5) < 1e-9
    noise = generators.rednoise(spark, 0.8, 4000, 2, seed=3)
    f = Field.of(noise, ("sample", "t"))
    tau = [r.tau for r in stats.timescale(f, "t", imaxlag=20).collect()]
    assert all(3 < t < 7 for t in tau)


def test_find(spark):
    state = np.random.RandomState(STATE)
    y = np.sort(state.rand(50, 10) - 0.5, axis=0)
    y = np.concatenate([y, y[::-1]])
    out = features.find(series(spark, y.T), "x").collect()
    first = {s: min(r.x0 for r in out if r.s == s) for s in range(3)}
    assert np.allclose([first[s] for s in range(3)], [25.56712412, 17.1468964, 25.94590963], atol=1e-7)
    assert all(len([r for r in out if r.s == s]) == 2 for s in range(10))


def test_linetrack(spark):
    rows = [[30, 20], [22], [24], [32, 25], [26, 40, 33], [45], [20, 47], [23, 50]]
    found = spark.createDataFrame([(i, float(v)) for i, r in enumerate(rows) for v in r], "t int, x0 double")
    got = features.linetrack(found, [], "t").collect()
    assert sorted((r.t, r.x0) for r in got) == sorted((i, float(v)) for i, r in enumerate(rows) for v in r)
    by = {(r.t, r.x0): r.track for r in got}
    assert by[0, 20.0] == by[1, 22.0] == by[2, 24.0] == by[3, 25.0] == by[4, 26.0]
    assert by[3, 32.0] == by[4, 33.0] and by[5, 45.0] == by[6, 47.0] == by[7, 50.0] and by[6, 20.0] == by[7, 23.0]


def test_intersection(spark):
    a, b = one(spark, [10, 11, 12, 13], [4, 2, 0, -2]), one(spark, [10, 11, 12, 13], [0, 1, 2, 3])
    r = features.intersection(a, b, "x").first()
    assert (round(r.x0, 4), round(r.y0, 4)) == (11.3333, 1.3333)
    none = features.intersection(a, one(spark, [10, 11, 12, 13], [9, 9, 9, 9]), "x").first()
    assert none.x0 is None and none.y0 is None


def test_match(spark):
    day = lambda k: (datetime(2000, 1, k),)
    a, b = spark.createDataFrame([day(k) for k in range(1, 11)], "t timestamp"), spark.createDataFrame([day(k) for k in range(5, 16)], "t timestamp")
    assert sorted(r.t.day for r in select.match(a, b).collect()) == [5, 6, 7, 8, 9, 10]
    with pytest.raises(ValueError):
        select.match(a, b.where("t != timestamp '2000-01-07'"))


def test_half_levels(spark):
    got = sorted(calculus.deriv_half(one(spark, [0, 2, 4], [0, 4, 16]), "x").df.collect())
    assert [tuple(r) for r in got] == [(1.0, 2.0), (3.0, 6.0)]


def test_potential_temperature(spark):
    df = spark.createDataFrame([(100.0, 273.0)], "lev double, v double")
    f = Field(df, ("lev",), "v", "K", "temperature", {"lev": "hPa"})
    assert abs(Dataset({"temperature": f})["pot_temp"].df.first().v - 527.08048) < 1e-4


def test_cell_weights_and_global_rows(spark):
    rows = [(float(lon), float(lat), 1.0) for lon in range(0, 360, 30) for lat in range(-85, 90, 10)]
    f = Field.of(spark.createDataFrame(rows, "lon double, lat double, v double"), ("lon", "lat"))
    wide = grid.enforce_global(f)
    lons, lats = (sorted(r[0] for r in wide.df.select(d).distinct().collect()) for d in ("lon", "lat"))
    assert (len(lons), len(lats)) == (13, 20) and lons[0] == -30
    depth = {r.lat: r.depth for r in grid.cell_measures(wide.df).select("lat", "depth").distinct().collect()}
    assert [round(depth[x]) for x in (-90.0, -85.0, -75.0)] == [278, 834, 1112]


# literal edge cases


def test_missing_values(spark):
    f = one(spark, [0, 1, 2, 3], [1.0, float("nan"), None, 3.0])
    assert reduce.mean(f, "x").df.first().v == 2.0
    assert f.df.where("v is null").count() == 2
    gone = one(spark, [0, 1], [None, None])
    assert reduce.average(gone, "x").df.first().v is None and reduce.integral(gone, "x").df.first().v is None


def test_uneven_derivative_is_exact(spark):
    x = [0, 1, 3, 6, 10]
    got = sorted(calculus.deriv_uneven(one(spark, x, [a * a for a in x]), "x").df.collect())
    assert np.allclose([tuple(r) for r in got], [(a, 2 * a) for a in x[1:-1]])
    kept = sorted(calculus.deriv_uneven(one(spark, x, [a * a for a in x]), "x", 1, 4, keepedges=True).df.collect())
    assert np.allclose([tuple(r) for r in kept][1:-1], [(a, 2 * a) for a in x[1:-1]])


@pytest.mark.parametrize("order, accuracy", [(o, a) for o in (1, 2, 3) for a in (2, 4, 6)])
def test_stencils_are_exact_on_polynomials(order, accuracy):
    w = design.stencil(order, accuracy)
    for power in range(order + accuracy):
        value = sum(c * k**power for k, c in w.items())
        assert abs(value - (math.factorial(order) if power == order else 0)) < 1e-9
    nodes = np.array(sorted({0, *w}), float)
    assert np.allclose(design.fornberg(nodes, 0.0, order), [w.get(int(k), 0) for k in nodes]) or len(nodes) > order + accuracy


def test_crossings(spark):
    assert [r.x0 for r in features.find(one(spark, [0, 1, 2], [-1, 0, 1]), "x").collect()] == [1.0]
    assert [r.x0 for r in features.find(one(spark, [0, 1, 2], [1, 0, -1]), "x").collect()] == [1.0]
    assert features.find(one(spark, [0, 1, 2, 3], [-1, 0, 0, 1]), "x").count() == 0


def test_flat_extrema_are_left_out_only_on_demand(spark):
    top = one(spark, [0, 1, 2, 3, 4, 5], [1, 6, 6, 2, 4, 3])
    assert [(r.track, r.x0, r.y0) for r in features.local_extrema(top, "x").orderBy("x0").collect()][0] == (0, 1.5, 6.0)
    assert [r.track for r in features.local_extrema(top, "x", flat=False).collect()] == [0]
    assert features.global_extremum(top, "x").first().y0 == 6.0 > features.global_extremum(top, "x", flat=False).first().y0


def test_pole_rows(spark):
    lat = [-90.0, -45.0, 0.0, 45.0, 90.0]
    f = Field.of(spark.createDataFrame([(x, math.sin(math.radians(x))) for x in lat], "lat double, v double"), ("lat",))
    out = {r.lat: r.v for r in calculus.divergence(f).df.collect()}
    step = (math.sin(math.radians(90)) - math.sin(math.radians(45))) / (math.radians(45) * 6371.0088)
    assert abs(out[90.0] - 2 * step) < 1e-12 and abs(out[-90.0] - 2 * step) < 1e-12


@pytest.mark.parametrize("lo, hi, total", [(5, 15, 10.0), (7, 20, 13.0), (0, 20, 20.0), (2, 3, 1.0)])
def test_truncation_keeps_mass(spark, lo, hi, total):
    f = one(spark, [0, 10, 20], [1, 2, 4])
    cut, weights = select.truncate(f, "x", lo, hi)
    assert abs(weights.agg(F.sum("weight")).first()[0] - total) < 1e-9
    rows = {r.x: r.v for r in cut.df.collect()}
    assert min(rows) == lo and max(rows) == hi
    assert abs(rows[float(lo)] - np.interp(lo, [0, 10, 20], [1, 2, 4])) < 1e-12


def test_right_edge_of_histograms(spark):
    out = sorted(reduce.histogram(one(spark, range(4), [0, 1, 2, 4]), "x", 5).df.collect())
    assert [r["count"] for r in out] == [1, 1, 1, 1]


def test_window_pads(spark):
    f = one(spark, range(6), [1, 2, 3, 4, 5, 6])
    values = lambda n: [r.v for r in sorted(windows.runmean(f, "x", n).df.collect())]
    assert values(3) == [None, 2.0, 3.0, 4.0, 5.0, None]
    assert values(4) == [None, 2.5, 3.5, 4.5, None, None]


def test_units():
    p = units.parse
    assert p("m2").powers == p("m^2").powers and p("W / m2 Pa").alike(p("W m-2 Pa-1"))
    assert p("100hPa").scale == 1e4 and p("days since 0001-01-01").scale == 86400 and p("%").scale == 0.01
    assert p("degrees_N").alike(p("rad")) and units.factors("degC", "K") == (1.0, 273.15)
    assert units.factors("m", "J kg-1", context=True)[0] == 9.80665
    with pytest.raises(ValueError):
        units.factors("m", "K")
    with pytest.raises(ValueError):
        p("furlongs")
    assert units.compact("m", 12345.0) == "km" and "\\mathrm{s}^{-1}" in units.tex("m / s")


def test_constants_have_units():
    assert abs(constants.sigma - 5.67037e-8) < 1e-12 and abs(constants.kappa - 0.2854) < 1e-3
    assert constants.unit_of("g").alike(units.parse("m s-2"))


def test_metadata(spark):
    f = Field.of(spark.createDataFrame([(1.0, 2.0, 3.0)], "lat double, lon double, v double"), ("lat", "lon"), units="K", coord_units={"lat": "degN"})
    frame = reduce.mean(f, "lon").frame()
    assert frame.schema["v"].metadata == {"units": "K", "long_name": "", "cell_methods": "lon: mean"}
    assert frame.schema["lat"].metadata == {"units": "degN"}
    text = encode_methods(((("lat", "lon"), "mean"), (("time",), "max")))
    assert decode_methods(text) == ((("lat", "lon"), "mean"), (("time",), "max"))
    assert f.to_units("degC").df.first().v == pytest.approx(3.0 - 273.15)
    assert (f * f).units == "K K" and reduce.mean(f, "lon").scalars == {"lon": None}


def test_datasets(spark):
    f = Field.of(spark.createDataFrame([(0.0, 2.0), (45.0, 4.0)], "lat double, v double"), ("lat",), units="K", name="temperature", coord_units={"lat": "degN"})
    ds = Dataset({"temperature": f})
    assert "temp" in ds and "salinity" not in ds and "temperature" in dir(ds) and "K" in repr(ds)
    assert ds.temp.df.count() == 2 and ds.vars("salinity") is None
    assert ds.add("copy", f)["copy"] is f
    with pytest.raises(ValueError):
        ds.add("temperature", f)
    with pytest.raises(KeyError):
        ds["salinity"]
    with pytest.raises(TypeError):
        query.reduce(f, sideways="mean")
    assert query.expand_specs("a", {"lat": "int"}, ["b", ("c", {"x": 1})]) == [("a", {"lat": "int"}), ("b", {}), ("c", {"x": 1})]
    y = derivations.to_variable(Field.of(f.df.select("lat", F.col("lat").alias("v")), ("lat",), units="degN", name="latitude"), "meridional_coordinate")
    assert max(r.v for r in y.df.collect()) == pytest.approx(math.radians(45) * 6371.0088)


def test_registry():
    r = Registry()
    r.define("speed", "wind speed", "m s^-1", ("spd",))
    r.define("gust", "gust", parent="speed")
    assert r["spd"].name == "speed" and r["gust"].standard_units == "m s^-1" and r["gust"] in r["speed"]
    assert r("speed", latitude="argmax").standard_units == "degN" and r("speed", time="timescale").standard_units == "days"
    with pytest.raises(ValueError):
        r.define("speed")
    r.undefine("speed")
    with pytest.raises(KeyError):
        r.get("spd")
    assert variables("energy_flux").long_label().startswith("vertical energy flux (")


def test_filters(spark):
    b, a = design.butterworth(1.0, 3, 10.0)
    assert abs(np.sum(b) / np.sum(a) - 1) < 1e-12
    b9 = design.lanczos(1.0, 9, 4.0)[0]
    assert np.allclose(b9, b9[::-1]) and len(b9) == 9
    y = np.sin(np.arange(200) / 15) + 5
    out = [r.v for r in sorted(windows.recursive(one(spark, range(200), y), "x", b, a).df.collect())]
    kept = np.array([np.nan if v is None else v for v in out], float)
    inside = np.isfinite(kept)
    assert inside.sum() > 150 and np.abs(kept[inside][20:-20] - y[inside][20:-20]).max() < 0.1
    with pytest.raises(ValueError):
        design.butterworth(1.0, 3, 1.5)


def test_eof_reconstructs(spark):
    rng = np.random.default_rng(0)
    pattern, pc = rng.standard_normal(6), rng.standard_normal(40)
    y = np.outer(pc, pattern) + 0.01 * rng.standard_normal((40, 6))
    f = series(spark, y, ("t", "i"))
    pcs, projections, values = stats.eof(f, "t", "i", neof=2, percent=True)
    v = {r.eof: r.eval for r in values.collect()}
    assert v[1] > 99 and v[1] + v[2] <= 100 + 1e-9
    p = np.array([r.pc for r in sorted(pcs.where("eof = 1").select("t", "pc").collect())])
    q = np.array([r.proj for r in sorted(projections.where("eof = 1").select("i", "proj").collect())])
    assert np.abs(np.outer(p, q) - (y - y.mean(0))).max() < 0.06


def test_generators(spark):
    a = generators.rednoise(spark, 0.9, 50, 3, seed=1)
    assert a.count() == 150 and sorted(a.collect()) == sorted(generators.rednoise(spark, 0.9, 50, 3, seed=1).collect())


def test_reading_and_writing(spark, tmp_path):
    df = spark.createDataFrame([Row(k="a", v=1.5), Row(k="b", v=2.5)])
    for kind, options in (("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"header": "true"})):
        path = str(tmp_path / kind)
        if kind == "csv":
            df.write.option("header", "true").csv(path)
        else:
            tables.write(df, path, kind, partition_by=["k"])
        assert tables.read(spark, path, kind, **options).count() == 2


def test_time_selection(spark):
    rows = [(datetime(2000, 1, 1) + timedelta(days=k), float(k)) for k in range(366)]
    f = Field.of(spark.createDataFrame(rows, "time timestamp, v double"), ("time",))
    assert select.sel_time(f, month=2).df.count() == 29 and select.sel_time(f, season="DJF").df.count() == 91
    assert select.sel_time(f, date="2000-03-01").df.first().v == 60.0 and select.sel_time(f, dayofweek=0).df.count() == 52
