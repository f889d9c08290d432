"""Running means, cumulative integrals and filters as window expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..field import Field
from ..functions.design import window as weights_of
from ..functions.units import Quantity
from ..session import ship_package
from . import kernels
from .calculus import check_even


def runmean(f: Field, dim: str, n: int | Quantity, center: bool = True, window: str | tuple = "boxcar", normalize: bool = False, trim: bool = False) -> Field:
    """Mean of ``n`` consecutive values, NULL (or no row, ``trim``) where fewer stand.

    Other windows weigh the values; their sum is divided by ``n``, or by the sum
    of the weights (``normalize``).  A quantity is a width along ``dim``, whose
    step must be even.
    """
    if isinstance(n, Quantity):
        n = max(1, round(n.to(f.coord_units.get(dim, "")).value / check_even(f.df, dim)))
    left = (n - 1) // 2 if center else n - 1
    by = f.window(dim)
    frame = by.rowsBetween(-left, n - 1 - left)
    if window == "boxcar":
        value = F.avg(f.v).over(frame)
    else:
        w = weights_of(n, window)
        parts = [(F.lag(f.v, left - j) if j <= left else F.lead(f.v, j - left)).over(by) * float(x) for j, x in enumerate(w)]
        value = sum(parts[1:], parts[0]) / float(w.sum() if normalize else n)
    full = F.count(f.v).over(frame) == n
    out = f.with_value(F.when(full, value))
    return out.with_df(out.df.where(out.v.isNotNull())) if trim else out


def cumulative_integral(f: Field, dim: str, y0: float = 0.0) -> Field:
    """y0 plus the running sum of value times step; the first step is the second."""
    by = f.window(dim)
    x = F.col(dim).cast("double")
    stepped = f.df.withColumn("_d", F.coalesce(x - F.lag(x).over(by), F.lead(x).over(by) - x))
    value = F.lit(y0) + F.sum(f.v * F.col("_d")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return f.with_df(stepped.withColumn(f.value, value).drop("_d"))


def fir(f: Field, dim: str, b: Sequence[float], n: int = 1, center: bool = True, pad: bool = True, pad_value: float | None = None) -> Field:
    """``n`` passes of a finite filter in alternating directions about the mean.

    Centred, the delay is undone and what the window cannot know at the ends is
    ``pad_value`` or, without ``pad``, no row; otherwise the series is zero about
    its mean beyond its ends.
    """
    by, whole = f.window(dim), Window.partitionBy(*f.rest(dim))
    df = f.df.withColumn("_m", F.avg(f.v).over(whole)).withColumn(f.value, f.v - F.col("_m"))
    half = (len(b) - 1) // 2
    for k in range(n):
        step = F.lag if k % 2 == 0 else F.lead
        parts = [(step(F.col(f.value), j, 0.0).over(by) if j else F.col(f.value)) * float(w) for j, w in enumerate(b)]
        df = df.withColumn(f.value, sum(parts[1:], parts[0]))
    return _ends(f, df.withColumn(f.value, F.col(f.value) + F.col("_m")), dim, n, half, center, pad, pad_value)


def _ends(f: Field, df: DataFrame, dim: str, n: int, half: int, center: bool, pad: bool, pad_value: float | None) -> Field:
    """After ``n`` passes: the delay of a net forward one undone, both ends padded or cut."""
    if not center or not half:
        return f.with_df(df.select(*f.dims, f.value))
    by = f.window(dim)
    lost = n // 2 * 2 * half + (half if n % 2 else 0)
    if n % 2:
        df = df.withColumn(f.value, F.lead(f.value, half).over(by))
    df = df.withColumn("_in", F.lag(F.lit(True), lost).over(by) & F.lead(F.lit(True), lost).over(by))
    if not pad:
        return f.with_df(df.where("_in").select(*f.dims, f.value))
    return f.with_df(df.withColumn(f.value, F.when(F.col("_in"), F.col(f.value)).otherwise(F.lit(pad_value).cast("double"))).select(*f.dims, f.value))


def recursive(f: Field, dim: str, b: Sequence[float], a: Sequence[float], n: int = 2, center: bool = True, pad: bool = True, pad_value: float | None = None) -> Field:
    """As ``fir`` for a recursive filter: a kernel, one series at a time."""
    ship_package(f.df.sparkSession)
    value, schema = f.value, f.df.select(*f.dims, f.value).schema
    b, a = np.asarray(b, float), np.asarray(a, float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(dim)
        return pdf.assign(**{value: kernels.filter_passes(pdf[value].to_numpy(float), b, a, n)})

    out = f.df.select(*f.dims, f.value)
    filtered = out.groupBy(*f.rest(dim)).applyInPandas(run, schema)
    return _ends(f, filtered, dim, n, (max(len(a), len(b)) - 1) // 2, center, pad, pad_value)
