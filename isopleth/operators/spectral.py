"""Spectra: grouped FFT kernels, and relational transforms for few frequencies."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..field import Field
from ..functions import units as u
from ..session import ship_package
from . import kernels


def _grouped(df: DataFrame, rest: Sequence[str], run, fields: str) -> DataFrame:
    ship_package(df.sparkSession)
    heads = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def keyed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf)
        for i, c in enumerate(rest):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    schema = f"{heads}, {fields}" if heads else fields
    return df.groupBy(*rest).applyInPandas(keyed, schema)


def power(f: Field, dim: str, dx: float = 1.0, nperseg: int | None = None, wintype: str | tuple = "boxcar", detrend: str | None = "constant") -> Field:
    """(rest, f, power); a series with a missing value gives no rows."""
    value = f.value

    def run(pdf):
        y = pdf.sort_values(dim)[value].to_numpy(float)
        if not np.isfinite(y).all() or len(y) < 2:
            return pd.DataFrame({"f": np.zeros(0), "power": np.zeros(0)})
        freq, p = kernels.power(dx, y, nperseg, wintype, detrend)
        return pd.DataFrame({"f": freq, "power": p})

    out = _grouped(f.df.select(*f.dims, value), f.rest(dim), run, "f double, power double")
    return Field(out, (*f.rest(dim), "f"), "power", (u.parse(f.units) ** 2).text, f.name)


def copower(f: Field, g: Field, dim: str, dx: float = 1.0, nperseg: int | None = None, wintype: str | tuple = "boxcar", detrend: str | None = "constant") -> DataFrame:
    """(rest, f, c, q, p1, p2, coherence, phase)"""
    names = ["f", "c", "q", "p1", "p2", "coherence", "phase"]
    both = f.df.select(*f.dims, f.v.alias("_a")).join(g.df.select(*g.dims, g.v.alias("_b")), list(f.dims))

    def run(pdf):
        pdf = pdf.sort_values(dim)
        y1, y2 = pdf["_a"].to_numpy(float), pdf["_b"].to_numpy(float)
        if not (np.isfinite(y1).all() and np.isfinite(y2).all()) or len(y1) < 2:
            return pd.DataFrame({n: np.zeros(0) for n in names})
        return pd.DataFrame(dict(zip(names, kernels.copower(dx, y1, y2, nperseg, wintype, detrend), strict=True)))

    return _grouped(both, f.rest(dim), run, ", ".join(f"{n} double" for n in names))


def spectra2d(f: Field, cyclic: str, time: str, g: Field | None = None, dx_lon: float = 1.0, dx_time: float = 1.0, nperseg: int | None = None, wintype: str | tuple = "boxcar", detrend: str | None = "constant") -> DataFrame:
    """(rest, k, f, power), or with a second field (rest, k, f, c, q, p1, p2, coherence, phase)."""
    names = ["power"] if g is None else ["c", "q", "p1", "p2", "coherence", "phase"]
    inputs = ["_a"] if g is None else ["_a", "_b"]
    df = f.df.select(*f.dims, f.v.alias("_a"))
    if g is not None:
        df = df.join(g.df.select(*g.dims, g.v.alias("_b")), list(f.dims))

    def run(pdf):
        y = [pdf.pivot(index=time, columns=cyclic, values=c).to_numpy(float) for c in inputs]
        k, freq, values = kernels.spectra2d(dx_lon, dx_time, *y, nperseg=nperseg, wintype=wintype, detrend=detrend)
        kk, ff = np.meshgrid(k, freq)
        return pd.DataFrame({"k": kk.ravel(), "f": ff.ravel(), **{n: v.ravel() for n, v in zip(names, values, strict=True)}})

    return _grouped(df, f.rest(cyclic, time), run, ", ".join(f"{n} double" for n in ("k", "f", *names)))


def dft(f: Field, dim: str, ks: Sequence[int] | None = None, centre: bool = True) -> DataFrame:
    """(rest, k, re, im, n): coefficients sum(y e^(-2 pi i k t / n)) / n, t in order of ``dim``.

    ``dim`` counts 0, 1, 2...  For a few wave numbers ``ks`` this is a join with them
    and one aggregate: partial sums come before the shuffle and no series meets in
    one task's memory.  All wave numbers take a fast transform, a series a task.
    """
    rest, spark = f.rest(dim), f.df.sparkSession
    if ks is None:
        value = f.value

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            re, im, n = kernels.dft(pdf[dim].to_numpy(float), pdf[value].to_numpy(float), centre)
            return pd.DataFrame({"k": np.arange(1, len(re) + 1, dtype=np.int32), "re": re, "im": im, "n": n})

        return _grouped(f.df.select(*f.dims, value), rest, run, "k int, re double, im double, n long")
    sums = f.df.groupBy(*rest).agg(F.count(f.v).alias("n"), F.avg(f.v).alias("_m"))
    sized = f.df.join(sums, rest) if rest else f.df.crossJoin(F.broadcast(sums))
    waves_of = sized.crossJoin(F.broadcast(spark.createDataFrame([(int(k),) for k in ks], "k int")))
    turn = F.col("k") * F.col(dim) * F.lit(2 * math.pi) / F.col("n")
    y = f.v - F.col("_m") if centre else f.v
    return waves_of.groupBy(*rest, "k").agg((F.sum(y * F.cos(turn)) / F.first("n")).alias("re"), (-F.sum(y * F.sin(turn)) / F.first("n")).alias("im"), F.first("n").alias("n"))


def power_dft(f: Field, dim: str, dx: float = 1.0) -> DataFrame:
    """(rest, k, f, power) of the whole series, natively."""
    twice = F.when(F.col("k") * 2 == F.col("n"), 1.0).otherwise(2.0)
    return dft(f, dim).select(*f.rest(dim), "k", (F.col("k") / (F.col("n") * dx)).alias("f"), ((F.col("re") ** 2 + F.col("im") ** 2) * twice).alias("power"))


def copower_dft(f: Field, g: Field, dim: str, dx: float = 1.0) -> DataFrame:
    """(rest, k, f, c, q) natively."""
    a, b = dft(f, dim), dft(g, dim).withColumnsRenamed({"re": "_re", "im": "_im"}).drop("n")
    both = a.join(b, [*f.rest(dim), "k"])
    twice = F.when(F.col("k") * 2 == F.col("n"), 1.0).otherwise(2.0)
    c = (F.col("re") * F.col("_re") + F.col("im") * F.col("_im")) * twice
    q = (F.col("re") * F.col("_im") - F.col("im") * F.col("_re")) * twice
    return both.select(*f.rest(dim), "k", (F.col("k") / (F.col("n") * dx)).alias("f"), c.alias("c"), q.alias("q"))


def _inverse(f: Field, dim: str, coefficients: DataFrame) -> Field:
    rest = f.rest(dim)
    turn = F.col("k") * F.col(dim) * F.lit(2 * math.pi) / F.col("n")
    twice = F.when(F.col("k") * 2 == F.col("n"), 1.0).otherwise(2.0)
    wide = f.df.select(*f.dims).join(coefficients, rest) if rest else f.df.select(*f.dims).crossJoin(F.broadcast(coefficients))
    return f.with_df(wide.groupBy(*f.dims).agg(F.sum(twice * (F.col("re") * F.cos(turn) - F.col("im") * F.sin(turn))).alias(f.value)))


def harmonics(f: Field, dim: str, n: int) -> Field:
    """The series made of Fourier components 1 to ``n`` alone; the mean is gone."""
    return _inverse(f, dim, dft(f, dim, range(1, n + 1)))


def highpower(f: Field, dim: str, n: int) -> Field:
    """The series made of its ``n`` strongest Fourier components."""
    strength = F.col("re") ** 2 + F.col("im") ** 2
    w = Window.partitionBy(*f.rest(dim)).orderBy(strength.desc(), "k")
    best = dft(f, dim).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    return _inverse(f, dim, best)


def response(spark: SparkSession, dx: float, b: Sequence[float], a: Sequence[float] = (1.0,), n: int = 1000, manual: bool = False) -> DataFrame:
    """(x, h): magnitude of a filter's response at ``n`` frequencies up to one cycle a step;
    ``manual`` gives the signed one of a symmetric filter, from its own weights."""

    def squared(c: Sequence[float], w: Column) -> Column:
        re = sum((F.cos(w * k) * float(x) for k, x in enumerate(c)), F.lit(0.0))
        im = sum((F.sin(w * k) * float(x) for k, x in enumerate(c)), F.lit(0.0))
        return re * re + im * im

    w = F.col("id") * F.lit(2 * math.pi / n)
    if manual:
        if len(a) > 1 or len(b) % 2 == 0:
            raise ValueError("a signed response needs an odd number of weights and no recursion")
        half = len(b) // 2
        h = sum((F.cos(w * k) * 2.0 * float(b[half + k]) for k in range(1, half + 1)), F.lit(float(b[half])))
        return spark.range(n).select((F.col("id") / (n * dx)).alias("x"), h.alias("h"))
    return spark.range(n).select((F.col("id") / (n * dx)).alias("x"), F.sqrt(squared(b, w) / squared(a, w)).alias("h"))


def centroid(p: Field, lat: str | None = "lat", least: float = 1.5) -> DataFrame:
    """Mean wave number of a spectrum over k, weighted by power, from ``least`` on, as a
    length: a quarter of the latitude circle (km) a wave."""
    from .grid import KM

    rest = p.rest("k")
    kk = p.df.where(F.col("k") >= least).groupBy(*rest).agg((F.sum(F.col("k") * p.v) / F.nullif(F.sum(p.v), F.lit(0.0))).alias("k"))
    circle = F.cos(F.radians(lat)) * (2 * math.pi * KM) if lat else F.lit(1.0)
    return kk.select(*rest, (circle * 0.25 / F.col("k")).alias("centroid"))
