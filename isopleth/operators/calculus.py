"""Finite differences on even and uneven axes, and operators on the sphere."""

from __future__ import annotations

from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..field import Field
from ..functions import units as u
from ..functions.design import stencil
from ..session import ship_package
from . import kernels
from .grid import KM, axes, copied


def _units(f: Field, dim: str, order: int) -> str:
    return (u.parse(f.units) / u.parse(f.coord_units.get(dim, "")) ** order).text


def check_even(df: DataFrame, dim: str, tolerance: float = 1e-9, values: list | None = None) -> float:
    """The step of an even axis; an error if steps differ."""
    if values is None:
        values = (axes(df, dim) or {}).get(dim)
    if values is None:  # a long axis: one small aggregate
        w = Window.orderBy(dim)
        steps = df.select(dim).distinct().select((F.lead(dim).over(w) - F.col(dim)).alias("d")).where("d is not null")
        least, most = steps.agg(F.min("d"), F.max("d")).first()
    else:
        steps = [b - a for a, b in pairwise(values)]
        least, most = min(steps, default=None), max(steps, default=None)
    if least is None or most - least > tolerance * max(1.0, abs(most)):
        raise ValueError(f"{dim} is not evenly spaced")
    return float(most)


def _shifted(v: Column, k: int, w) -> Column:
    return v if k == 0 else (F.lead(v, k) if k > 0 else F.lag(v, -k)).over(w)


def _centred(v: Column, w, h: Column | float, order: int, accuracy: int) -> Column:
    parts = [_shifted(v, k, w) * c for k, c in stencil(order, accuracy).items()]
    return sum(parts[1:], parts[0]) / h**order


def wrapped(df: DataFrame, dim: str, axis: list, half: int, h: float) -> DataFrame:
    """``df`` with the ``half`` rows next to either end of a circle repeated beyond the other."""
    turn = type(axis[0])(axis[-1] - axis[0] + h)
    return copied(df, dim, [(x, x - turn) for x in axis[-half:]] + [(x, x + turn) for x in axis[:half]])


def deriv_even(f: Field, dim: str, order: int = 1, accuracy: int = 2, cyclic: bool = False, keepedges: bool = False, h: float | None = None, also: bool = False) -> Field:
    """Centred difference on even steps; at edges fewer points, or no row.

    A missing neighbour leaves NULL, so that the widest stencil that fits wins.
    ``also`` keeps the value and puts the derivative beside it, as ``_d``.
    """
    df, half = f.df, max(stencil(order, accuracy))
    if cyclic:
        axis = (axes(df, dim) or {}).get(dim)
        if axis is None:
            raise ValueError(f"{dim} is too long to be cyclic")
        h = check_even(df, dim, values=axis) if h is None else h
        df = wrapped(df, dim, axis, half, h)
    h = h if h is not None else check_even(f.df, dim)
    by = f.window(dim)
    tries = [_centred(f.v, by, h, order, a) for a in range(accuracy, 0, -2)] if keepedges else [_centred(f.v, by, h, order, accuracy)]
    if keepedges:
        ahead, back = F.lead, F.lag
        if order == 1:
            tries += [(ahead(f.v).over(by) - f.v) / h, (f.v - back(f.v).over(by)) / h]
        elif order == 2:
            inner = lambda k: (_shifted(f.v, k - 1, by) - 2 * _shifted(f.v, k, by) + _shifted(f.v, k + 1, by)) / h**2
            tries += [inner(1), inner(-1)]
        else:
            inner = lambda k: (_shifted(f.v, k + 3, by) - 3 * _shifted(f.v, k + 2, by) + 3 * _shifted(f.v, k + 1, by) - _shifted(f.v, k, by)) / h**3
            tries += [inner(0), inner(-1), inner(-2), inner(-3)]
    df = df.withColumn("_d", F.coalesce(*tries))
    if cyclic:
        df = df.where((F.col(dim) >= axis[0]) & (F.col(dim) <= axis[-1]))
    elif not keepedges:
        df = df.withColumns({"_l": F.lag(F.lit(1), half).over(by), "_r": F.lead(F.lit(1), half).over(by)}).where("_l = 1 and _r = 1")
    if also:
        return f.with_df(df.select(*f.dims, f.value, "_d"))
    return f.with_df(df.select(*f.dims, F.col("_d").alias(f.value)), units=_units(f, dim, order))


def deriv_uneven(f: Field, dim: str, order: int = 1, accuracy: int = 2, keepedges: bool = False) -> Field:
    """Derivative on any spacing: closed forms for order 1 and 2 at accuracy 2, a
    kernel with Fornberg's weights otherwise."""
    units = _units(f, dim, order)
    if accuracy == 2 and order in (1, 2) and not keepedges:
        by = f.window(dim)
        x = F.col(dim).cast("double")
        y0, y2, a, b = F.lag(f.v).over(by), F.lead(f.v).over(by), x - F.lag(x).over(by), F.lead(x).over(by) - x
        if order == 1:
            d = (y2 - f.v) / b * (a / (a + b)) + (f.v - y0) / a * (b / (a + b))
        else:
            d = 2 * ((y2 - f.v) / b - (f.v - y0) / a) / (a + b)
        df = f.df.withColumns({"_d": d, "_ab": a + b}).where("_ab is not null")
        return f.with_df(df.select(*f.dims, F.col("_d").alias(f.value)), units=units)
    ship_package(f.df.sparkSession)
    value, rest = f.value, f.rest(dim)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(dim)
        pdf[value] = kernels.derive(pdf[dim].to_numpy(float), pdf[value].to_numpy(float), order, accuracy, keepedges)
        return pdf.dropna(subset=[value])

    slim = f.df.select(*f.dims, f.value)
    return f.with_df(slim.groupBy(*rest).applyInPandas(run, slim.schema), units=units)


def deriv_half(f: Field, dim: str, order: int = 1) -> Field:
    """First differences between neighbours, repeated; coordinates halfway between."""
    df = f.df.withColumn(dim, F.col(dim).cast("double"))
    for _ in range(order):
        by = f.window(dim)
        x, v = F.col(dim), f.v
        df = df.select(*f.rest(dim), ((x + F.lead(x).over(by)) / 2).alias(dim), ((F.lead(v).over(by) - v) / (F.lead(x).over(by) - x)).alias(f.value)).where(F.col(dim).isNotNull())
    return f.with_df(df.select(*f.dims, f.value), units=_units(f, dim, order))


def derivative(f: Field, centered: bool = True, **orders: int) -> Field:
    """Derivatives of the given orders along dimensions, edges kept."""
    for dim, order in orders.items():
        f = deriv_uneven(f, dim, order, keepedges=True) if centered else deriv_half(f, dim, order)
    return f


def divergence(f: Field, dim: str = "lat", cos_power: int = 1) -> Field:
    """cos^-p d(v cos^p)/dy with y in km along the meridian, one-sided at edges;
    at a pole twice dv/dy."""
    by = f.window(dim)
    y = F.radians(dim) * KM
    c = F.pow(F.cos(F.radians(dim)), cos_power)
    df = f.df.withColumns({"_y": y, "_c": c}).withColumn("_g", F.col(f.value) * F.col("_c"))

    def slope(name: str) -> Column:
        g, x = F.col(name), F.col("_y")
        a, b = x - F.lag(x).over(by), F.lead(x).over(by) - x
        up, down = (F.lead(g).over(by) - g) / b, (g - F.lag(g).over(by)) / a
        return F.coalesce(up * a / (a + b) + down * b / (a + b), up, down)

    value = F.when(F.abs(dim) >= 90, 2 * slope(f.value)).otherwise(slope("_g") / F.col("_c"))
    return f.with_df(df.withColumn("_d", value).select(*f.dims, F.col("_d").alias(f.value)), units=(u.parse(f.units) / u.parse("km")).text)


def convergence(f: Field, dim: str = "lat", cos_power: int = 1) -> Field:
    out = divergence(f, dim, cos_power)
    return out.with_value(-out.v)


def geolaplacian(f: Field, accuracy: int = 4) -> Field:
    """d2/dlon2 / (a cos)^2 - tan / a^2 d/dlat + d2/dlat2 / a^2, cyclic in lon; rows too
    near to the ends of lat for the stencil are left out.  Distances in km."""
    known = axes(f.df, "lon", "lat")
    if known is None:
        raise ValueError("an axis is too long for a grid")
    dx, dy = (check_even(f.df, d, values=known[d]) * _RADIAN for d in ("lon", "lat"))
    half, by, lat = max(stencil(2, accuracy)), f.window("lat"), F.radians("lat")
    df = f.df.withColumns({"_y": _centred(f.v, by, dy, 1, accuracy), "_yy": _centred(f.v, by, dy, 2, accuracy), "_l": F.lag(F.lit(1), half).over(by), "_r": F.lead(F.lit(1), half).over(by)})
    df = wrapped(df, "lon", known["lon"], half, known["lon"][1] - known["lon"][0])
    df = df.withColumn("_xx", _centred(f.v, f.window("lon"), dx, 2, accuracy))
    df = df.where((F.col("lon") >= known["lon"][0]) & (F.col("lon") <= known["lon"][-1]) & (F.col("_l") == 1) & (F.col("_r") == 1))
    value = F.col("_xx") / F.pow(F.cos(lat) * KM, 2) - F.tan(lat) / KM**2 * F.col("_y") + F.col("_yy") / KM**2
    return f.with_df(df.select(*f.dims, value.alias(f.value)), units=(u.parse(f.units) / u.parse("km") ** 2).text)


_RADIAN = 3.141592653589793 / 180


def geogradient(f: Field, accuracy: int = 2) -> DataFrame:
    """(dims, gx, gy): gradient in units a km, cyclic in lon; two windows, no join."""
    known = axes(f.df, "lon", "lat")
    if known is None:
        raise ValueError("an axis is too long for a grid")
    lon = known["lon"]
    steps = {d: check_even(f.df, d, values=known[d]) for d in ("lon", "lat")}
    gy = deriv_even(f, "lat", 1, accuracy, keepedges=True, h=steps["lat"], also=True)
    half = max(stencil(1, accuracy))
    df = wrapped(gy.df, "lon", lon, half, steps["lon"]).withColumn("_dx", _centred(f.v, f.window("lon"), steps["lon"], 1, accuracy))
    df = df.where((F.col("lon") >= lon[0]) & (F.col("lon") <= lon[-1]))
    return df.select(*f.dims, (F.col("_dx") / (F.cos(F.radians("lat")) * KM * _RADIAN)).alias("gx"), (F.col("_d") / (KM * _RADIAN)).alias("gy"))
