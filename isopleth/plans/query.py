"""``reduce`` and ``get``: named methods a dimension, chained into one lazy plan."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..field import Dataset, Field
from ..operators import features, reduce as red, select, stats, windows
from . import access, registry

_KEY = re.compile(r"^(abs_)?(.*?)(?:_(latitude|strength))?(?:_(1|2|anomaly|ratio))?$")
_BOUND = re.compile(r"^(\w+?)_(min|max|lim)$")


def expand_specs(*args) -> list[tuple[str, dict]]:
    """(key, options) of nested specs: names, tuples of names and dicts, lists."""
    out: list[tuple[str, dict]] = []
    for a in args:
        if isinstance(a, str):
            out.append((a, {}))
        elif isinstance(a, dict):
            if not out:
                raise ValueError("options come after a name")
            out[-1] = (out[-1][0], {**out[-1][1], **a})
        else:
            out += expand_specs(*a)
    return out


def _tracked(f: Field, df: DataFrame, dim: str, column: str, units: str | None = None) -> Field:
    rest = f.rest(dim)
    extra = ["track"] if "track" in df.columns else []
    out = df.select(*rest, *extra, F.col(column).alias(f.value))
    return f.reduced(out, (dim,), column).with_df(out, dims=(*rest, *extra), units=f.units if units is None else units)


def _extremum(kind: str, column: str, everywhere: bool) -> Callable[[Field, str], Field]:
    def run(f: Field, dim: str) -> Field:
        df = (features.global_extremum if everywhere else features.local_extrema)(f, dim, kind)
        return _tracked(f, df, dim, column, f.coord_units.get(dim, "") if column == "x0" else None)

    return run


def _series(df: DataFrame, f: Field, dim: str, column: str) -> Field:
    out = df.select(*f.rest(dim), F.col(column).alias(f.value))
    return f.reduced(out, (dim,), column).with_df(out, dims=tuple(f.rest(dim)))


METHODS: dict[str, Callable[[Field, str], Field]] = {
    "int": red.integral, "avg": red.average, "anom": red.anomaly, "mean": red.mean, "sum": red.total,
    "lcumint": lambda f, d: red.cumulative(f, d, "integral"), "rcumint": lambda f, d: red.cumulative(f, d, "integral", True),
    "lcumavg": lambda f, d: red.cumulative(f, d, "average"), "rcumavg": lambda f, d: red.cumulative(f, d, "average", True),
    "lcumanom": lambda f, d: red.cumulative(f, d, "anomaly"), "rcumanom": lambda f, d: red.cumulative(f, d, "anomaly", True),
    "min": _extremum("min", "y0", False), "max": _extremum("max", "y0", False), "argmin": _extremum("min", "x0", False), "argmax": _extremum("max", "x0", False),
    "absmin": _extremum("min", "y0", True), "absmax": _extremum("max", "y0", True), "absargmin": _extremum("min", "x0", True), "absargmax": _extremum("max", "x0", True),
    "argzero": lambda f, d: _tracked(f, features.argloc(f, d), d, "x0", f.coord_units.get(d, "")),
    "autocorr": lambda f, d: _series(stats.autocorr(f, d), f, d, "value"), "autocovar": lambda f, d: _series(stats.autocovar(f, d), f, d, "value"),
    "slope": lambda f, d: _series(stats.slope(f, d), f, d, "slope"), "timescale": lambda f, d: _series(stats.timescale(f, d), f, d, "tau"),
    "hist": lambda f, d: red.histogram(f, d),
}


def _limits(f: Field, dim: str, lo, hi, source: Dataset | None) -> tuple | DataFrame:
    """Two numbers, or a table of limits: several values make tracks, each one of the
    lower with each one of the upper; names and fields give limits that vary with
    their dimensions."""
    units = f.coord_units.get(dim, "")

    def said(bound):
        if isinstance(bound, str) or (isinstance(bound, tuple) and bound and isinstance(bound[0], str)):
            if source is None:
                raise ValueError(f"a dataset is needed to look up the limit {bound!r}")
            (name, options), = expand_specs(bound)
            bound = get(source, name, **options)
        if isinstance(bound, Field):
            return bound.to_units(units) if bound.units and units else bound
        if isinstance(bound, (list, tuple)):
            return [access.plain(f, dim, x) for x in bound]
        return access.plain(f, dim, bound)

    lo, hi = said(lo), said(hi)
    if not isinstance(lo, (list, Field)) and not isinstance(hi, (list, Field)):
        return lo, hi
    spark, table, tracks = f.df.sparkSession, None, []
    for name, bound in (("lo", lo), ("hi", hi)):
        if isinstance(bound, Field):
            keys = [d for d in bound.dims if d in f.dims]
            part = bound.df.select(*keys, *(["track"] if "track" in bound.dims else []), bound.v.alias(name))
            if "track" in bound.dims:
                part = part.withColumnRenamed("track", f"_{name}")
                tracks.append((f"_{name}", None))
        else:
            several = bound if isinstance(bound, list) else [bound]
            part = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(several)], f"_{name} int, {name} double")
            if isinstance(bound, list):
                tracks.append((f"_{name}", len(several)))
            else:
                part = part.drop(f"_{name}")
        shared = [] if table is None else [c for c in table.columns if c in part.columns]
        table = part if table is None else table.join(part, shared) if shared else table.crossJoin(F.broadcast(part))
    if len(tracks) == 2 and tracks[1][1] is None:
        raise ValueError("two limits with tracks of their own")
    number = F.col(tracks[0][0]) * tracks[1][1] + F.col(tracks[1][0]) if len(tracks) == 2 else F.col(tracks[0][0]) if tracks else None
    return (table.withColumn("track", number.cast("int")) if tracks else table).drop("_lo", "_hi")


def reduce(f: Field, indexers: dict | None = None, invert: bool = False, weight: Field | None = None, source: Dataset | None = None, mask: str | None = None, **methods) -> Field:
    """Dimensions by name, in the order given: a method, a number or quantity
    (interpolate), a (min, max) pair or ``dim_min`` / ``dim_max`` / ``dim_lim``
    (limits), or for time a date.

    Limits are numbers, quantities, lists of them (all pairs, along ``track``) or
    variables of ``source`` by name, with options, which may vary along other dims.
    A list as a method gives several points, the name of a variable the point that
    it says.  ``mask`` is a preset that needs the variable ``pv`` of ``source``.

    ``invert`` takes reciprocals before and after.  Bounds and numbers become
    filters and joins below every aggregate.
    """
    asked, limits = {**(indexers or {}), **methods}, {}
    for key in list(asked):
        m = _BOUND.match(key)
        if key in f.dims and isinstance(asked[key], tuple):
            limits[key] = asked.pop(key)
        elif m and m[1] in f.dims:
            lo, hi = limits.get(m[1], (None, None))
            want = asked.pop(key)
            limits[m[1]] = want if m[2] == "lim" else (want, hi) if m[2] == "min" else (lo, want)
    if mask:
        if source is None:
            raise ValueError(f"a dataset is needed to apply the mask {mask!r}")
        pv = source["pv"]
        f = select.mask(f, pv.to_units("PVU") if pv.units else pv, kind=mask)
    if invert:
        f = f.reciprocal()
    for dim, (lo, hi) in limits.items():
        found = _limits(f, dim, lo, hi, source)
        if isinstance(found, DataFrame):
            if asked.get(dim) not in ("avg", "average"):
                raise ValueError(f"several or varying limits of {dim} need its average")
            f = select.truncated_averages(f, dim, found)
            asked.pop(dim)
            continue
        lo, hi = found
        if asked.get(dim) in ("avg", "average"):
            f = select.truncated_average(f, dim, lo, hi)
            asked.pop(dim)
        else:
            f = select.truncate(f, dim, lo, hi)[0]
    for dim, method in asked.items():
        names = [dim] if dim in f.dims or dim in ("area", "volume") else [d for d in f.dims if dim in registry.variables and d in registry.variables.get(dim).identifiers]
        if not names:
            raise TypeError(f"unknown option {dim!r}")
        dim = names[0]
        method = access.plain(f, dim, method)
        if isinstance(method, (int, float)) and not isinstance(method, bool):
            out = select.interp(f, dim, [float(method)])
            f = f.reduced(out.df.drop(dim), (dim,), "point")
        elif isinstance(method, list):
            f = select.interp(f, dim, method)
        elif method in METHODS:
            f = red.integral(f, dim, weight) if weight and method == "int" else red.average(f, dim, weight) if weight and method == "avg" else METHODS[method](f, dim)
        elif isinstance(method, str) and source is not None and method in source:
            at = source[method]
            at = at.to_units(f.coord_units[dim]) if at.units and f.coord_units.get(dim) else at
            out = select.interp(f, dim, at.df.select(*(d for d in at.dims if d in f.dims), at.v.alias("target")))
            f = f.reduced(out.df.drop(dim), (dim,), "point")
        elif isinstance(method, str) and re.match(r"\d{4}-", method):
            f = select.sel_time(f, dim, date=method)
        else:
            raise ValueError(f"unknown method {method!r} for {dim}")
    return f.reciprocal() if invert else f


def get(
    ds: Dataset, key: str, *, standardize: bool = False, units: str | None = None, normalize: bool = False, runmean=None, add=None,
    subtract=None, multiply=None, divide=None, pair: tuple[str, tuple[float, float]] | None = None, **reductions,
) -> Field:
    """Fetch or derive, reduce, normalise, smooth, take magnitudes, pair, do arithmetic,
    convert: in that order.

    The key may begin with ``abs_`` and end with ``_latitude`` or ``_strength`` (place
    or size of the extremum of the vertical integral's zonal mean) and with ``_1``,
    ``_2``, ``_anomaly`` or ``_ratio`` (of ``pair``).
    """
    if key in ds:
        magnitude, name, preset, which = None, key, None, None
    else:
        magnitude, name, preset, which = _KEY.match(key).groups()
    f = ds[name]
    if preset:
        chain = {d: m for d, m in (("lev", "int"), ("lon", "avg"), ("lat", "absargmax" if preset == "latitude" else "absmax")) if d in f.dims}
        reductions = {**chain, **reductions}
    f = reduce(f, source=ds, **reductions)
    time = next((d for d in ("time", "month", "t") if d in f.dims), None)
    if normalize and time:
        f = red.normalize(f, time)
    if runmean and time:
        f = windows.runmean(f, time, runmean)
    if magnitude:
        f = f.abs()
    if which:
        if pair is None:
            raise ValueError("a pair needs pair=(dimension, (reference, other))")
        f = select.sel_pair(f, pair[0], which, pair[1])
    other = lambda x: ds[x] if isinstance(x, str) else x
    for value, op in ((multiply, Field.__mul__), (divide, Field.__truediv__), (add, Field.__add__), (subtract, Field.__sub__)):
        if value is not None:
            f = op(f, other(value))
    if standardize and f.name in registry.variables:
        f = f.to_standard_units()
    return f.to_units(units, context=True) if units else f
