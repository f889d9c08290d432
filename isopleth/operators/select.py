"""Selection, interpolation, truncation, hemispheres and pairs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..field import Field
from ..functions.sphere import calendar, season
from .grid import axes, cells, coordinate


def sel(f: Field, method: str | None = None, tolerance: float | None = None, **labels) -> Field:
    """Cells by coordinate: a value, a list, an inclusive ``slice`` or (for ``nearest``,
    ``pad``, ``backfill``) the label that stands for it."""
    out = f
    for dim, want in labels.items():
        x = F.col(dim)
        if isinstance(want, slice):
            lo, hi = want.start, want.stop
            cond = F.lit(True)
            cond = cond & (x >= lo) if lo is not None else cond
            out = out.with_df(out.df.where(cond & (x <= hi) if hi is not None else cond))
        elif method:
            wanted = [want] if not isinstance(want, (list, tuple)) else list(want)
            out = out.with_df(_stand_in(out, dim, wanted, method, tolerance))
        elif isinstance(want, (list, tuple)):
            out = out.with_df(out.df.where(x.isin(*want)))
        else:
            df = out.df.where(x == want).drop(dim)
            out = out.reduced(df, (dim,), "point").with_df(df, cell_methods=f.cell_methods, scalars={**out.scalars, dim: want})
    return out


def _stand_in(f: Field, dim: str, wanted: Sequence[float], method: str, tolerance: float | None) -> DataFrame:
    """The axis picks the label of each target; a label that stands for several
    targets gives its rows once."""
    known = axes(f.df, dim)
    if known is None:
        raise ValueError(f"{dim} is too long to pick labels from")
    ahead, back = method in ("backfill", "bfill"), method in ("pad", "ffill")
    if not (ahead or back or method == "nearest"):
        raise ValueError(f"unknown method {method!r}")
    labels = []
    for w in map(float, wanted):
        near = [x for x in known[dim] if (tolerance is None or abs(x - w) <= tolerance) and not (ahead and x < w) and not (back and x > w)]
        if near:
            labels.append(min(near, key=lambda x: (abs(x - w), x)))
    return f.df.where(F.col(dim).isin(*labels)) if labels else f.df.where(F.lit(False))


def isel(f: Field, **places: int | Sequence[int] | slice) -> Field:
    """Cells by position along an axis; negative ones count from its end."""
    df, known = f.df, axes(f.df, *places)
    for dim, want in places.items():
        if known is None:
            table = coordinate(f.df, dim).select(dim, "idx").withColumn("_n", F.count("*").over(Window.partitionBy()))
            several = [want] if isinstance(want, int) else list(want)
            chosen = table.where((F.col("idx").isin(*several)) | ((F.col("idx") - F.col("_n")).isin(*several))).select(dim)
            df = df.join(F.broadcast(chosen), dim)
            continue
        axis = known[dim]
        picked = axis[want] if isinstance(want, slice) else [axis[i] for i in ([want] if isinstance(want, int) else want) if -len(axis) <= i < len(axis)]
        df = df.where(F.col(dim).isin(*picked)) if picked else df.where(F.lit(False))
    return f.with_df(df.select(*f.df.columns))


def _segments(f: Field, dim: str, extrapolate: bool) -> DataFrame:
    by = f.window(dim)
    x, v = F.col(dim).cast("double"), f.v
    df = f.df.where(v.isNotNull()).select(
        *f.rest(dim), x.alias("x0"), v.alias("y0"), F.lead(x).over(by).alias("x1"), F.lead(v).over(by).alias("y1"),
        F.lag(x).over(by).isNull().alias("_first"), F.lead(x, 2).over(by).isNull().alias("_last"),
    ).where("x1 is not null")
    inf = F.lit(float("inf"))
    lo = F.when(F.col("_first") & F.lit(extrapolate), -inf).otherwise(F.col("x0"))
    hi = F.when(F.col("_last") & F.lit(extrapolate), inf).otherwise(F.col("x1"))
    return df.withColumns({"_lo": lo, "_hi": hi})


def interp(f: Field, dim: str, targets: Iterable[float] | DataFrame, extrapolate: bool = True) -> Field:
    """Linear interpolation at ``targets``: numbers, or a frame (dims, ``target``) of
    targets that vary along some dims.  Ends are extended unless told not to."""
    spark = f.df.sparkSession
    seg = _segments(f, dim, extrapolate)
    if isinstance(targets, DataFrame):
        shared = [c for c in targets.columns if c != "target"]
        wide = seg.join(targets.withColumnRenamed("target", "_x"), shared) if shared else seg.crossJoin(F.broadcast(targets.withColumnRenamed("target", "_x")))
    else:
        frame = spark.createDataFrame([(float(t),) for t in targets], "_x double")
        wide = seg.crossJoin(F.broadcast(frame))
    inside = wide.where((F.col("_x") >= F.col("_lo")) & ((F.col("_x") < F.col("_hi")) | (F.col("_last") & (F.col("_x") <= F.col("_hi")))))
    value = F.col("y0") + (F.col("_x") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    cols = [F.col("_x").alias(d) if d == dim else F.col(d) for d in f.dims]
    return f.with_df(inside.select(*cols, value.alias(f.value)))


def truncate(f: Field, dim: str, lo: float | None = None, hi: float | None = None) -> tuple[Field, DataFrame]:
    """The field cut exactly at the bounds, and (dim, weight): the width of each row's
    cell, clipped to the bounds.

    New rows at the bounds are interpolated (held constant beyond the data), new
    cells meet halfway between rows, and no width is made or lost: widths add up
    to the part of the old cells within the bounds.
    """
    known = axes(f.df, dim)
    if known is None:
        raise ValueError(f"{dim} is too long to be cut")
    old = cells(known[dim], dim)
    first, last = (float(known[dim][0]), float(known[dim][-1])) if old else (0.0, 0.0)
    lo, hi = (first if lo is None else float(lo)), (last if hi is None else float(hi))
    # a row stands for itself, and the one before a bound for the row there too
    by, here = f"PARTITION BY {', '.join(f'`{d}`' for d in f.rest(dim)) or '1'} ORDER BY `{dim}`", F.struct(F.col(dim).cast("double").alias("x"), f.v.alias("v"))
    df = f.df.select(*f.dims, f.value).withColumn("_p", F.when(f.v.isNotNull(), here))
    df = df.withColumns({"_n": F.expr(f"lead(_p) IGNORE NULLS OVER ({by})"), "_nn": F.expr(f"lead(_p, 2) IGNORE NULLS OVER ({by})")})
    x, none = F.col(dim).cast("double"), F.array().cast("array<struct<x:double,v:double>>")
    rows = F.when((x > lo) & (x < hi), F.array(F.struct(x.alias("x"), f.v.alias("v")))).otherwise(none)
    for bound in dict.fromkeys((lo, hi)):
        at = F.lit(bound)
        inside = (F.col("_p.x") <= at) & ((at < F.col("_n.x")) | (F.col("_nn").isNull() & (at == F.col("_n.x"))))
        value = F.col("_p.v") + (at - F.col("_p.x")) * (F.col("_n.v") - F.col("_p.v")) / (F.col("_n.x") - F.col("_p.x"))
        point = F.when(F.coalesce(inside, F.lit(False)), F.array(F.struct(at.alias("x"), value.alias("v"))))
        end = first if bound < first else last if bound > last else None
        if end is not None:  # beyond the data: the end row, moved
            point = F.when(x == end, F.array(F.struct(at.alias("x"), f.v.alias("v"))))
        rows = F.concat(rows, point.otherwise(none))
    cut = df.withColumn("_r", F.explode(rows)).select(*(F.col("_r.x").alias(d) if d == dim else F.col(d) for d in f.dims), F.col("_r.v").alias(f.value))
    new = cells(sorted({float(c) for c in known[dim] if lo < c < hi} | {lo, hi}), dim)
    weights = []
    for at, _, a, b, _ in new:
        weights.append((float(at), float(sum(max(0.0, min(oh, hi, b) - max(ol, lo, a)) for _, _, ol, oh, _ in old))))
    return f.with_df(cut), f.df.sparkSession.createDataFrame(weights, f"`{dim}` double, weight double")


def truncate_by(f: Field, dim: str, bounds: DataFrame) -> DataFrame:
    """(dims, track, value, weight) of the field cut at limits that vary: ``bounds`` has
    ``lo`` and ``hi`` (null: the end of the data), some of the other dimensions and,
    where several limits are wanted at once, ``track``.

    Rows and weights are those of ``truncate``; one window finds the rows between
    which a limit lies.
    """
    known = axes(f.df, dim)
    if known is None:
        raise ValueError(f"{dim} is too long to be cut")
    first, last = (float(known[dim][0]), float(known[dim][-1])) if known[dim] else (0.0, 0.0)
    shared = [c for c in bounds.columns if c in f.dims]
    heads = [*f.rest(dim), *(c for c in ("track",) if c in bounds.columns)]
    by, here = f"PARTITION BY {', '.join(f'`{d}`' for d in f.rest(dim)) or '1'} ORDER BY `{dim}`", F.struct(F.col(dim).cast("double").alias("x"), f.v.alias("v"))
    df = f.df.select(*f.dims, f.value).withColumn("_p", F.when(f.v.isNotNull(), here))
    df = df.withColumns({"_n": F.expr(f"lead(_p) IGNORE NULLS OVER ({by})"), "_nn": F.expr(f"lead(_p, 2) IGNORE NULLS OVER ({by})")})
    limits = bounds.withColumns({"_lo": F.coalesce(F.col("lo").cast("double"), F.lit(first)), "_hi": F.coalesce(F.col("hi").cast("double"), F.lit(last))}).drop("lo", "hi")
    axis = F.array(*(F.lit(float(y)) for y in known[dim]))
    within = F.filter(axis, lambda y: (y > F.col("_lo")) & (y < F.col("_hi")))
    limits = limits.withColumns({"_after": F.coalesce(F.array_min(within), F.col("_hi")), "_before": F.coalesce(F.array_max(within), F.col("_lo"))})
    places = [(v, *(float(known[dim][k]) if 0 <= k < len(known[dim]) else None for k in (i - 1, i + 1))) for i, v in enumerate(known[dim])]
    near = f.df.sparkSession.createDataFrame(places, f"`{dim}` {f.df.schema[dim].dataType.simpleString()}, _prev double, _next double")
    df = df.join(F.broadcast(near), dim)
    df = df.join(limits, shared) if shared else df.crossJoin(F.broadcast(limits))  # a row a wanted pair of limits
    lo, hi, x, none = F.col("_lo"), F.col("_hi"), F.col(dim).cast("double"), F.array().cast("array<struct<x:double,v:double,w:double>>")
    # a new cell meets its neighbours halfway; no width is made beyond the data
    size = lambda left, at, right: F.greatest(F.lit(0.0), F.least((at + right) / 2, F.lit(last)) - F.greatest((left + at) / 2, F.lit(first)))
    row = lambda at, value, w: F.array(F.struct(at.alias("x"), value.alias("v"), w.alias("w")))
    rows = F.when((x > lo) & (x < hi), row(x, f.v, size(F.greatest(F.col("_prev"), lo), x, F.least(F.col("_next"), hi)))).otherwise(none)
    for at, once, w in ((lo, F.lit(True), size(lo, lo, F.col("_after"))), (hi, hi != lo, size(F.col("_before"), hi, hi))):
        inside = (F.col("_p.x") <= at) & ((at < F.col("_n.x")) | (F.col("_nn").isNull() & (at == F.col("_n.x"))))
        value = F.col("_p.v") + (at - F.col("_p.x")) * (F.col("_n.v") - F.col("_p.v")) / (F.col("_n.x") - F.col("_p.x"))
        beyond = ((at < first) & (x == first)) | ((at > last) & (x == last))
        point = F.when(beyond, row(at, f.v, w)).when(F.coalesce(inside, F.lit(False)), row(at, value, w))
        rows = F.concat(rows, F.when(once, point.otherwise(none)).otherwise(none))
    out = df.withColumn("_r", F.explode(rows))
    return out.select(*(F.col("_r.x").alias(d) if d == dim else F.col(d) for d in f.dims), *heads[len(f.dims) - 1 :], F.col("_r.v").alias(f.value), F.col("_r.w").alias("weight"))


def truncated_averages(f: Field, dim: str, bounds: DataFrame) -> Field:
    """Averages along ``dim`` between limits that vary, see ``truncate_by``."""
    df = truncate_by(f, dim, bounds)
    heads = [*f.rest(dim), *(c for c in ("track",) if c in bounds.columns)]
    value = F.sum(f.v * F.col("weight")) / F.nullif(F.sum(F.when(f.v.isNotNull(), F.col("weight"))), F.lit(0.0))
    return f.reduced(df.groupBy(*heads).agg(value.alias(f.value)), (dim,), "average").with_df(df.groupBy(*heads).agg(value.alias(f.value)), dims=tuple(heads))


def truncated_average(f: Field, dim: str, lo: float | None = None, hi: float | None = None) -> Field:
    cut, weights = truncate(f, dim, lo, hi)
    df = cut.df.join(F.broadcast(weights), dim)
    value = F.sum(f.v * F.col("weight")) / F.nullif(F.sum(F.when(f.v.isNotNull(), F.col("weight"))), F.lit(0.0))
    return f.reduced(df.groupBy(*f.rest(dim)).agg(value.alias(f.value)), (dim,), "average")


def sel_time(f: Field, time: str = "time", date: str | None = None, **parts) -> Field:
    """Rows whose time has the parts asked for: year, month, day, hour, minute, second,
    dayofyear, week, dayofweek (Monday is 0), season."""
    t = F.col(time)
    known = {**calendar(t), "dayofyear": F.dayofyear(t), "week": F.weekofyear(t), "dayofweek": F.weekday(t), "season": season(t)}
    conditions = [known[k].isin(*(v if isinstance(v, (list, tuple)) else [v])) for k, v in parts.items()]
    if date is not None:
        conditions.append(t.cast("date") == F.lit(date).cast("date"))
    return f.with_df(f.df.where(fold(lambda a, b: a & b, conditions, F.lit(True))))


def invert_hemisphere(f: Field, which: str | None = None) -> Field:
    """The sign flipped in a hemisphere (never at the equator), or everywhere."""
    cond: Column = {"nh": F.col("lat") > 0, "sh": F.col("lat") < 0, None: F.lit(True), "both": F.lit(True)}[which]
    return f.with_value(F.when(cond, -f.v).otherwise(f.v))


def reverse_hemisphere(f: Field) -> Field:
    return f.with_df(f.df.withColumn("lat", -F.col("lat")).select(*f.df.columns))


def sel_hemisphere(f: Field, which: str = "nh", invert: str | None = None) -> Field:
    """One hemisphere (sh mirrored), each with the row at or just across the equator;
    or the mean of both."""
    if invert:
        f = invert_hemisphere(f, invert)
    lats = (axes(f.df, "lat") or {}).get("lat") or []
    lat = F.col("lat")
    # each hemisphere from the row at or just across the equator on
    north, south = (max((y for y in side if y <= 0), default=-1e9) for side in (lats, [-y for y in lats]))
    if which == "nh":
        return f.with_df(f.df.where(lat >= north).select(*f.df.columns))
    if which == "sh":
        return f.with_df(f.df.where(-lat >= south).withColumn("lat", -lat).select(*f.df.columns))
    places = F.filter(F.array(F.when(lat >= north, lat), F.when(-lat >= south, -lat)), lambda y: y.isNotNull())
    both = f.df.withColumn("lat", F.explode(places)).groupBy(*f.dims).agg(F.count("*").alias("_rows"), F.when(F.count(f.v) == 2, F.sum(f.v) / 2).alias(f.value))
    return f.with_df(both.where("_rows = 2").select(*f.dims, f.value))


def sel_pair(f: Field, dim: str, which: str, values: tuple[float, float]) -> Field:
    """Of a parameter axis the first (reference) or second value, their difference
    or their ratio."""
    a, b = (f.df.where(F.col(dim) == v).drop(dim) for v in values)
    rest = f.rest(dim)
    if which in ("1", "2"):
        df = a if which == "1" else b
    else:
        both = a.withColumnRenamed(f.value, "_a").join(b.withColumnRenamed(f.value, "_b"), rest)
        value = F.col("_b") - F.col("_a") if which == "anomaly" else F.col("_b") / F.nullif(F.col("_a"), F.lit(0.0))
        df = both.select(*rest, value.alias(f.value))
    return f.reduced(df, (dim,), "point").with_df(df, cell_methods=f.cell_methods, units="" if which == "ratio" else f.units)


def match(*axes: DataFrame) -> DataFrame:
    """The common stretch of one-column axes; an error if they differ inside it."""
    name = axes[0].columns[0]
    spans = [a.agg(F.min(name).alias("a"), F.max(name).alias("b")) for a in axes]
    span = fold(lambda x, y: x.unionByName(y), spans).agg(F.max("a").alias("_lo"), F.min("b").alias("_hi"))
    cut = [a.distinct().crossJoin(F.broadcast(span)).where(F.col(name).between(F.col("_lo"), F.col("_hi"))).select(name) for a in axes]
    for other in cut[1:]:
        if cut[0].exceptAll(other).unionByName(other.exceptAll(cut[0])).take(1):
            raise ValueError("the axes differ where they overlap")
    return cut[0]


def replace_coords(f: Field, **changes: Column | dict) -> Field:
    """Coordinates by an expression or a mapping of old values to new ones."""
    df = f.df
    for dim, to in changes.items():
        if isinstance(to, dict):
            table = df.sparkSession.createDataFrame([(float(a), float(b)) for a, b in to.items()], f"`{dim}` double, _new double")
            df = df.join(F.broadcast(table), dim, "left").withColumn(dim, F.coalesce("_new", dim)).drop("_new")
        else:
            df = df.withColumn(dim, to)
    return f.with_df(df.select(*f.df.columns))


def mask(f: Field, where: Field, lo: float = 0.1, hi: float = 2.0, kind: str = "trop", lat: tuple[float, float] = (30.0, 60.0)) -> Field:
    """NULL outside of a range of another field's magnitude; ``pv`` also wants its
    gradient along lat positive and |lat| within the limits."""
    df = f.df.join(where.df.withColumnRenamed(where.value, "_q"), list(where.dims))
    good = F.abs("_q").between(lo, hi)
    if kind == "pv":
        by = Window.partitionBy(*where.rest("lat")).orderBy("lat")
        rise = where.df.withColumn("_g", F.coalesce(F.lead(where.value).over(by), F.col(where.value)) - F.coalesce(F.lag(where.value).over(by), F.col(where.value)))
        df = df.join(rise.select(*where.dims, "_g"), list(where.dims))
        good = good & (F.col("_g") > 0) & F.abs("lat").between(*lat)
    elif kind != "trop":
        raise NotImplementedError(kind)
    return f.with_df(df.select(*f.dims, F.when(good, f.v).alias(f.value)))
