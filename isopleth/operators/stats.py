"""Covariances, trends, timescales and empirical orthogonal functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..field import Field
from ..session import ship_package
from . import kernels
from .grid import axes


def lags(n_max: int | None = None, lag: float | None = None, maxlag: float | None = None, ilag: int | None = None, imaxlag: int | None = None, dt: float = 1.0, both: bool = False) -> list[int]:
    """Lags in steps: one (``lag``, ``ilag``) or all up to one (``maxlag``, ``imaxlag``)."""
    given = [x for x in (lag, maxlag, ilag, imaxlag) if x is not None]
    if len(given) > 1:
        raise ValueError("give one of lag, ilag, maxlag, imaxlag")
    for x in (lag, maxlag):
        if x is not None and abs(x / dt - round(x / dt)) > 1e-9:
            raise ValueError("the lag is no multiple of the step")
    many = maxlag is not None or imaxlag is not None
    k = int(round(lag / dt)) if lag is not None else int(round(maxlag / dt)) if maxlag is not None else ilag if ilag is not None else imaxlag if imaxlag is not None else 0
    if n_max is not None and k > n_max - 3:
        raise ValueError("the lag is too long for the series")
    return list(range(-k if both else 0, k + 1)) if many else [k]


def covariance(f: Field, dim: str, g: Field | None = None, corr: bool = False, dt: float = 1.0, **lag) -> DataFrame:
    """(rest, lag, value) of sum((z1_t - m1)(z2_{t+k} - m2)) / (N - |k|), with means and
    population deviations of whole series; divided by the deviations for ``corr``.

    All lags come from one partitioning of the series: the k-th lag is a column of
    the same window, summed and then unpivoted.
    """
    rest, steps = f.rest(dim), lags(dt=dt, both=g is not None, **lag)
    df = f.df.select(*f.dims, f.v.alias("_a"))
    df = df.withColumn("_b", F.col("_a")) if g is None else df.join(g.df.select(*g.dims, g.v.alias("_b")), list(f.dims))
    whole, by = Window.partitionBy(*rest), Window.partitionBy(*rest).orderBy(dim)
    df = df.withColumns({"_x": F.col("_a") - F.avg("_a").over(whole), "_y": F.col("_b") - F.avg("_b").over(whole)})
    shifted = {k: (F.lead("_y", k) if k > 0 else F.lag("_y", -k)).over(by) if k else F.col("_y") for k in steps}
    df = df.withColumns({f"_p{i}": F.col("_x") * s for i, s in enumerate(shifted.values())})
    n = F.count("*")
    scale = F.nullif(F.stddev_pop("_a") * F.stddev_pop("_b"), F.lit(0.0))
    sums = df.groupBy(*rest).agg(
        F.array(*(F.struct(F.lit(k * dt).alias("lag"), (F.sum(f"_p{i}") / (n - abs(k))).alias("value")) for i, k in enumerate(steps))).alias("_all"),
        F.coalesce(scale, F.lit(1.0)).alias("_s"),
    )
    out = sums.select(*rest, "_s", F.explode("_all").alias("_e"))
    value = F.col("_e.value") / F.col("_s") if corr else F.col("_e.value")
    return out.select(*rest, F.col("_e.lag").alias("lag"), value.alias("value"))


def autocorr(f: Field, dim: str, **lag) -> DataFrame:
    return covariance(f, dim, corr=True, **(lag or {"ilag": 1}))


def autocovar(f: Field, dim: str, **lag) -> DataFrame:
    return covariance(f, dim, **(lag or {"ilag": 1}))


def corr(f: Field, g: Field, dim: str, **lag) -> DataFrame:
    return covariance(f, dim, g, corr=True, **lag)


def covar(f: Field, g: Field, dim: str, **lag) -> DataFrame:
    return covariance(f, dim, g, **lag)


def slope(f: Field, dim: str) -> DataFrame:
    """(rest, slope, stderr): least squares along ``dim``; the error allows for the
    lag-1 correlation of the residuals."""
    rest, x, v = f.rest(dim), F.col(dim).cast("double"), f.v
    whole, by = Window.partitionBy(*rest), f.window(dim)
    df = f.df.where(v.isNotNull()).select(*rest, x.alias("_x"), v.alias("_y"), dim)
    df = df.withColumns({"_m": F.regr_slope("_y", "_x").over(whole), "_c": F.regr_intercept("_y", "_x").over(whole)})
    df = df.withColumn("_e", F.col("_y") - F.col("_c") - F.col("_m") * F.col("_x"))
    df = df.withColumn("_l", F.lag("_e").over(by))
    n, sse = F.count("*"), F.sum(F.col("_e") * F.col("_e"))
    sums = df.groupBy(*rest).agg(F.first("_m").alias("slope"), n.alias("_n"), sse.alias("_sse"), F.regr_sxx("_y", "_x").alias("_sxx"), F.sum(F.col("_e") * F.col("_l")).alias("_se"))
    r = F.col("_se") / ((F.col("_n") - 1) * F.nullif(F.col("_sse") / F.col("_n"), F.lit(0.0)))
    sums = sums.withColumn("_r", r)
    free = F.col("_n") * (1 - F.col("_r")) / (1 + F.col("_r")) - 2
    var = F.col("_sse") / (F.col("_n") - 2) / F.col("_sxx")
    ratio = var * (F.col("_n") - 2) / F.nullif(free, F.lit(0.0))
    return sums.select(*rest, "slope", F.when(ratio >= 0, F.sqrt(ratio)).alias("stderr"))


def slope_fit(f: Field, dim: str) -> Field:
    """The fitted line at every point."""
    whole = Window.partitionBy(*f.rest(dim))
    x = F.col(dim).cast("double")
    return f.with_value(F.regr_intercept(f.v, x).over(whole) + F.regr_slope(f.v, x).over(whole) * x)


def timescale_lag1(f: Field, dim: str, dt: float = 1.0) -> DataFrame:
    """(rest, tau): -dt / ln(a1), NULL unless 0 < a1 < 1."""
    a1 = autocorr(f, dim, ilag=1)
    good = (F.col("value") > 0) & (F.col("value") < 1)
    return a1.select(*f.rest(dim), F.when(good, F.lit(-dt) / F.log("value")).alias("tau"))


def timescale(f: Field, dim: str, dt: float = 1.0, imaxlag: int = 50) -> DataFrame:
    """(rest, tau, sigma): exp(-k dt / tau) fitted to the autocorrelations up to a lag.

    Only the few correlations of each series reach the kernel.
    """
    ship_package(f.df.sparkSession)
    rest = f.rest(dim)
    spectrum = autocorr(f, dim, imaxlag=imaxlag)
    packed = spectrum.groupBy(*rest).agg(F.sort_array(F.collect_list(F.struct("lag", "value"))).alias("_c"))
    schema = packed.drop("_c").schema.add("tau", "double").add("sigma", "double")

    def run(batches):
        for pdf in batches:
            fits = [kernels.fit_timescale(dt, np.array([p["value"] for p in c], float)) for c in pdf["_c"]]
            out = pdf.drop(columns="_c")
            out["tau"], out["sigma"] = [x[0] for x in fits], [x[1] for x in fits]
            yield out

    return packed.mapInPandas(run, schema)


def timescale_curve(f: Field, dim: str, dt: float = 1.0, imaxlag: int = 50, imaxlag_fit: int | None = None) -> DataFrame:
    """(rest, lag, fit): the fitted exponential at lags up to ``imaxlag_fit``."""
    taus = timescale(f, dim, dt, imaxlag)
    lag = F.explode(F.sequence(F.lit(0), F.lit(imaxlag if imaxlag_fit is None else imaxlag_fit)))
    out = taus.withColumn("_k", lag)
    return out.select(*f.rest(dim), (F.col("_k") * dt).alias("lag"), F.exp(-F.col("_k") * dt / F.col("tau")).alias("fit"))


def centred(f: Field, component: str, rest: list[str]) -> DataFrame:
    """The cells with ``_z``, the value less its component's mean."""
    means = f.df.groupBy(*rest, component).agg(F.avg(f.v).alias("_mean"))
    return f.df.join(means, [*rest, component]).withColumn("_z", f.v - F.col("_mean")).drop("_mean")


def scaled(df: DataFrame, component: str, weights: DataFrame | None) -> DataFrame:
    """``_z`` times the root of each component's weight over the mean one."""
    if weights is None:
        return df
    mean = F.broadcast(weights.agg(F.avg("weight").alias("_mw")))  # one row
    w = weights.crossJoin(mean).select(component, F.sqrt(F.col("weight") / F.col("_mw")).alias("_w"))
    return df.join(w, component).withColumn("_z", F.col("_z") * F.col("_w")).drop("_w")


def gram(f: Field, sample: str, component: str, weights: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """(rest, a, b, g): centred products of all pairs of one axis, summed over the other.

    ``by`` is the axis that stays, the shorter one.  Tasks take whole rows of the
    other axis, multiply blocks of them and give one partial matrix each, so that
    products are never rows; a missing cell counts as its mean.
    """
    rest = f.rest(sample, component)
    keep = by or component
    over = sample if keep == component else component
    known = (axes(f.df, keep) or {}).get(keep)
    if known is None:
        raise ValueError(f"{keep} is too long for a matrix")
    df = scaled(centred(f, component, rest), component, weights)
    ship_package(f.df.sparkSession)
    kind = f.df.schema[keep].dataType.simpleString()
    heads = "".join(f"`{c}` {f.df.schema[c].dataType.simpleString()}, " for c in rest)
    place = {x: i for i, x in enumerate(known)}

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        held = None

        def changes(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
            """Where a row differs from the one before it."""
            out = np.zeros(len(pdf), bool)
            for c in columns:
                out[1:] |= pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1]
            return out

        def add(pdf: pd.DataFrame) -> None:
            ends = [*np.flatnonzero(changes(pdf, rest)), len(pdf)]
            for at, end in zip([0, *ends], ends):  # noqa: B905
                part = pdf.iloc[at:end]
                row = np.cumsum(changes(part, [over]))
                x = np.zeros((row[-1] + 1, len(place)))
                np.add.at(x, (row, part[keep].map(place).to_numpy()), part["_z"].fillna(0.0).to_numpy())
                key = tuple(part[c].iloc[0] for c in rest)
                sums[key] = sums.get(key, 0) + x.T @ x

        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            # the last row of the other axis may go on in the next batch
            cut = int(np.flatnonzero(changes(pdf, [*rest, over]))[-1]) if changes(pdf, [*rest, over]).any() else 0
            held = pdf.iloc[cut:]
            if cut:
                add(pdf.iloc[:cut])
        if held is not None and len(held):
            add(held)
        i, j = np.triu_indices(len(place))
        axis = np.asarray(known)
        for key, m in sums.items():
            yield pd.DataFrame({**dict(zip(rest, key, strict=True)), "a": axis[i], "b": axis[j], "g": m[i, j]})

    slim = df.select(*rest, over, keep, "_z").repartition(*rest, over).sortWithinPartitions(*rest, over)
    return slim.mapInPandas(run, f"{heads}a {kind}, b {kind}, g double").groupBy(*rest, "a", "b").agg(F.sum("g").alias("g"))


def eof(f: Field, sample: str, component: str, neof: int = 5, weights: DataFrame | None = None, percent: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Standardised principal components (rest, eof, sample, pc), projections onto the
    data (rest, eof, component, proj) and (rest, eof, eval, neff).

    The covariance of the shorter axis is summed by Spark; only that matrix meets
    in one kernel.  Signs make the largest loading positive.
    """
    ship_package(f.df.sparkSession)
    rest = f.rest(sample, component)
    nt, ns = (f.df.select(d).distinct().count() for d in (sample, component))
    keep = component if nt > ns else sample
    divisor = nt if keep == component else ns
    g = gram(f, sample, component, weights, by=keep)
    key = f.df.schema[keep].dataType.simpleString()
    heads = ", ".join(f"`{c}` {f.df.schema[c].dataType.simpleString()}" for c in rest)
    schema = (heads + ", " if heads else "") + f"`{keep}` {key}, eof int, load double, eval double, pct double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([pdf["a"], pdf["b"]]))
        i, j = np.searchsorted(names, pdf["a"]), np.searchsorted(names, pdf["b"])
        m = np.zeros((len(names), len(names)))
        m[i, j] = m[j, i] = pdf["g"].to_numpy() / divisor
        values, vectors = np.linalg.eigh(m)
        out = []
        for k in range(min(neof, len(names))):
            v = vectors[:, -1 - k]
            v = v * np.sign(v[np.abs(v).argmax()])
            part = pd.DataFrame({keep: names, "eof": k + 1, "load": v, "eval": values[-1 - k], "pct": 100 * values[-1 - k] / np.trace(m)})
            for c in rest:
                part[c] = pdf[c].iloc[0]
            out.append(part)
        return pd.concat(out)[[*rest, keep, "eof", "load", "eval", "pct"]]

    loads = g.groupBy(*rest).applyInPandas(run, schema)
    value = "pct" if percent else "eval"
    z = centred(f, component, rest)
    if keep == component:
        raw = scaled(z, component, weights).join(loads, [*rest, component]).groupBy(*rest, "eof", sample).agg(F.sum(F.col("_z") * F.col("load")).alias("_p"))
    else:
        raw = loads.select(*rest, "eof", sample, F.col("load").alias("_p"))
    whole = Window.partitionBy(*rest, "eof")
    pcs = raw.withColumn("pc", (F.col("_p") - F.avg("_p").over(whole)) / F.nullif(F.stddev_pop("_p").over(whole), F.lit(0.0))).drop("_p")
    projections = pcs.join(z, [*rest, sample]).groupBy(*rest, "eof", component).agg((F.sum(F.col("pc") * F.col("_z")) / nt).alias("proj"))
    # effective size from the mean lag-1 correlation of the components
    by = Window.partitionBy(*rest, component).orderBy(sample)
    lag1 = z.withColumn("_n", F.lead("_z").over(by)).groupBy(*rest, component).agg((F.sum(F.col("_z") * F.col("_n")) / (nt - 1) / F.nullif(F.var_pop("_z"), F.lit(0.0))).alias("_r"))
    rho = lag1.groupBy(*rest).agg(F.avg("_r").alias("_r"))
    values = loads.select(*rest, "eof", F.col(value).alias("eval")).distinct()
    values = values.join(rho, rest) if rest else values.crossJoin(F.broadcast(rho))
    return pcs, projections, values.select(*rest, "eof", "eval", (F.lit(nt) * (1 - F.col("_r")) / (1 + F.col("_r"))).alias("neff"))
