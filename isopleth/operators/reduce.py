"""Reductions: sums, weighted integrals and averages, anomalies, histograms, groups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..field import Field
from ..functions import units as u
from .grid import axes, measure

_MEASURED = {"area": ("lon", "lat"), "volume": ("lon", "lat", "lev")}


def _dims(f: Field, dims: str | Iterable[str] | None) -> list[str]:
    """Real dimensions; latitude brings longitude along."""
    names = list(f.dims) if dims is None else [dims] if isinstance(dims, str) else list(dims)
    out = [d for n in names for d in _MEASURED.get(n, (n,))]
    if "lat" in out and "lon" in f.dims and "lon" not in out:
        out.append("lon")
    return [d for d in dict.fromkeys(out) if d in f.dims]


def mean(f: Field, dims=None) -> Field:
    gone = [dims] if isinstance(dims, str) else list(dims or f.dims)
    return f.reduced(f.df.groupBy(*f.rest(*gone)).agg(F.avg(f.v).alias(f.value)), gone, "mean")


def total(f: Field, dims=None) -> Field:
    gone = [dims] if isinstance(dims, str) else list(dims or f.dims)
    return f.reduced(f.df.groupBy(*f.rest(*gone)).agg(F.sum(f.v).alias(f.value)), gone, "sum")


def weighted(f: Field, dims, weight: Field | None = None) -> tuple[DataFrame, list[str]]:
    """The cells with ``_w`` (measures of the integrated dims) and ``_u`` (user weight).

    Measures are separable: one small table a dimension, broadcast because its
    size is the length of an axis.
    """
    gone, df, product = _dims(f, dims), f.df, F.lit(1.0)
    left = list(gone)
    for name, over in (("volume", {"lon", "lat", "lev"}), ("area", {"lon", "lat"}), ("width", {"lon"}), ("depth", {"lat"}), ("height", {"lev"}), ("duration", {"time"})):
        if name in f.measures and over <= set(left):  # weights of the field's own
            own = f.measures[name]
            df = df.join(own.df.withColumnRenamed(own.value, f"w_{name}"), list(own.dims))
            product, left = product * F.col(f"w_{name}"), [d for d in left if d not in over]
    known = (axes(f.df, *left) if left else {}) or {}
    for d in left:
        df = df.join(F.broadcast(measure(f.df, d, values=known.get(d))), d)
        product = product * F.col(f"w_{d}")
    df = df.withColumn("_w", product)
    if weight is None:
        return df.withColumn("_u", F.lit(1.0)), gone
    shared = [d for d in weight.dims if d in f.dims]
    return df.join(weight.df.withColumnRenamed(weight.value, "_u"), shared), gone


def integral(f: Field, dims="volume", weight: Field | None = None) -> Field:
    """sum(x We Wi) / mean(m Wi) over the cells of the reduced dims that are there."""
    df, gone = weighted(f, dims, weight)
    part = F.sum(F.coalesce(f.v, F.lit(0.0)) * F.col("_w") * F.col("_u"))
    share = F.avg(F.when(f.v.isNotNull(), F.col("_u")).otherwise(0.0))
    units = {"lon": "km", "lat": "km", "lev": "kg m-2"}
    text = f.units
    for d in gone:
        text = (u.parse(text) * u.parse(units.get(d, f.coord_units.get(d, "")))).text
    return f.reduced(df.groupBy(*f.rest(*gone)).agg((part / F.nullif(share, F.lit(0.0))).alias(f.value)), gone, "integral", units=text)


def average(f: Field, dims="volume", weight: Field | None = None) -> Field:
    """sum(x We Wi) / sum(m We Wi); NULL where nothing is present."""
    df, gone = weighted(f, dims, weight)
    w = F.col("_w") * F.col("_u")
    value = F.sum(f.v * w) / F.nullif(F.sum(F.when(f.v.isNotNull(), w)), F.lit(0.0))
    return f.reduced(df.groupBy(*f.rest(*gone)).agg(value.alias(f.value)), gone, "average")


def anomaly(f: Field, dims="volume", weight: Field | None = None) -> Field:
    """Value less the weighted average: a partial aggregate joined back, so that no
    partition holds a whole field."""
    base = average(f, dims, weight)
    return f - base.with_df(base.df)


def cumulative(f: Field, dim: str, kind: str = "integral", reverse: bool = False) -> Field:
    """Running integral, average, or average less running average, along ``dim``."""
    df = f.df.join(F.broadcast(measure(f.df, dim)), dim)
    x, w = f.v, F.col(f"w_{dim}")
    order = F.col(dim).desc() if reverse else F.col(dim)
    whole = Window.partitionBy(*f.rest(dim))
    upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    up = F.sum(F.coalesce(x, F.lit(0.0)) * w).over(upto)
    weight = F.nullif(F.sum(F.when(x.isNotNull(), w)).over(upto), F.lit(0.0))
    value = {"integral": up, "average": up / weight}.get(kind)
    if kind == "anomaly":
        value = F.sum(x * w).over(whole) / F.nullif(F.sum(F.when(x.isNotNull(), w)).over(whole), F.lit(0.0)) - up / weight
    return f.with_df(df.select(*f.dims, value.alias(f.value)))


def normalize(f: Field, dim: str = "time") -> Field:
    return f / mean(f, dim)


def groupby(f: Field, key: Column, name: str, *aggs: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Grouped by an expression; its units are those of the coordinate it comes from."""
    return f.df.groupBy(key.alias(name, metadata={"units": f.coord_units.get(name, "")}), *keep).agg(*aggs)


def histogram(f: Field, dim: str | Sequence[str], bins: int | Sequence[float] = 11) -> Field:
    """(rest, bins, count): half-open bins, the last one closed; empty bins are rows.

    An integer is a number of even edges from the least to the greatest value.
    """
    gone = [dim] if isinstance(dim, str) else list(dim)
    rest, spark = f.rest(*gone), f.df.sparkSession
    if isinstance(bins, int):
        n = bins - 1
        ends = f.df.agg(F.min(f.v).alias("_a"), F.max(f.v).alias("_b"))
        df = f.df.where(f.v.isNotNull()).crossJoin(F.broadcast(ends))
        step = (F.col("_b") - F.col("_a")) / n
        df = df.withColumn("_k", F.least(F.floor((f.v - F.col("_a")) / F.nullif(step, F.lit(0.0))), F.lit(n - 1)).cast("int"))
        df = df.withColumn("_k", F.coalesce("_k", F.lit(0)))
        spine = spark.range(n).select(F.col("id").cast("int").alias("_k")).crossJoin(F.broadcast(ends)).withColumn("bins", F.col("_a") + (F.col("_k") + 0.5) * step).select("_k", "bins")
    else:
        edges = [float(x) for x in bins]
        place = F.lit(None).cast("int")
        for i in range(len(edges) - 1):
            top = f.v <= edges[i + 1] if i == len(edges) - 2 else f.v < edges[i + 1]
            place = F.when((f.v >= edges[i]) & top, F.lit(i)).otherwise(place)
        df = f.df.withColumn("_k", place).where("_k is not null")
        spine = spark.createDataFrame([(i, (a + b) / 2) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "_k int, bins double")  # noqa: B905
    counts = df.groupBy(*rest, "_k").agg(F.count("*").alias("_c"))
    keys = f.df.select(*rest).distinct().crossJoin(F.broadcast(spine)) if rest else spine
    out = keys.join(counts, [*rest, "_k"], "left").select(*rest, "bins", F.coalesce("_c", F.lit(0)).cast("long").alias("count"))
    return Field(out, (*rest, "bins"), "count", name=f.name)


def geomean(f: Field, box: tuple[float, float, float, float] | None = None, weight: Field | None = None) -> Field:
    """Cosine-weighted mean over lat and lon; of a box (west, south, east, north) only
    the cells that lie in it wholly."""
    df = f.df
    if box:
        from .grid import coordinate

        west, south, east, north = box
        known = axes(df, "lon", "lat") or {}
        for dim, lo, hi in (("lon", west, east), ("lat", south, north)):
            inside = coordinate(f.df, dim, sharp=False, values=known.get(dim)).where((F.col("lo") >= lo) & (F.col("hi") <= hi)).select(dim)
            df = df.join(F.broadcast(inside), dim)
    w = F.cos(F.radians("lat"))
    if weight is not None:
        df = df.join(weight.df.withColumnRenamed(weight.value, "_u"), list(weight.dims))
        w = w * F.col("_u")
    value = F.sum(f.v * w) / F.nullif(F.sum(F.when(f.v.isNotNull(), w)), F.lit(0.0))
    return f.reduced(df.groupBy(*f.rest("lat", "lon")).agg(value.alias(f.value)), ("lon", "lat"), "mean")


def wilks(df: DataFrame, q: str, alpha: float = 0.10) -> DataFrame:
    """``df`` with ``keep``: whether a percentile passes the false discovery rate.

    With p = 2 min(q, 1-q) in ascending order, numbered from 0, the threshold is
    half the largest p(i) <= alpha i / n.  p is rounded to 12 digits into a
    histogram first, so that the ranks come from counts, not from one long sort.
    """
    p = F.round(2 * F.least(F.col(q), 1 - F.col(q)), 12)
    counts = df.where(F.col(q).isNotNull()).groupBy(p.alias("p")).agg(F.count("*").alias("c"))
    n = F.sum("c").over(Window.partitionBy())
    upto = F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    passed = counts.withColumns({"n": n, "upto": upto}).where(F.col("p") <= (F.col("upto") - 1) * alpha / F.col("n"))
    limit = passed.agg((F.max("p") / 2).alias("_limit"))
    tail = F.least(F.col(q), 1 - F.col(q))
    return df.crossJoin(F.broadcast(limit)).withColumn("keep", F.coalesce(tail <= F.col("_limit"), F.lit(False))).drop("_limit")
