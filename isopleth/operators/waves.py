"""Equivalent latitude and finite-amplitude wave activity (Nakamura; Huang)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..field import Field
from .grid import axes, cells, coordinate

RADIUS = 6.3710088e6


def areas(f: Field, known: dict[str, list] | None = None) -> DataFrame:
    """(dims, value, _area): cell areas on the unit sphere times radius squared, half
    cells at the ends of lat; also _lo and _hi, the sines of a cell's edges, and _arc."""
    known = known or axes(f.df, "lat", "lon") or {}
    lat = coordinate(f.df, "lat", sharp=False, values=known.get("lat")).select("lat", F.sin(F.radians("lo")).alias("_lo"), F.sin(F.radians("hi")).alias("_hi"))
    lon = coordinate(f.df, "lon", sharp=False, values=known.get("lon")).select("lon", F.radians("delta").alias("_arc"))
    df = f.df.join(F.broadcast(lat), "lat").join(F.broadcast(lon), "lon")
    return df.withColumn("_area", (F.col("_hi") - F.col("_lo")) * F.col("_arc") * RADIUS**2)


def contours(f: Field, skip: int = 10, mass: Field | None = None, known: dict[str, list] | None = None) -> DataFrame:
    """(rest, q, eqlat, k): every ``skip``-th value in ascending order as a contour, and
    the latitude south of which lies as much area (or mass) as has lower values.

    Equal values are counted together.  Ranks and running sums share one
    partitioning by the other dimensions.
    """
    rest, v = f.rest("lat", "lon"), f.value
    sized = areas(f, known).where(f.v.isNotNull())
    whole = Window.partitionBy(*rest)
    order = Window.partitionBy(*rest).orderBy(v, "lat", "lon")
    below = Window.partitionBy(*rest).orderBy(v).rangeBetween(Window.unboundedPreceding, 0)
    size = F.col("_area")
    if mass is not None:
        sized = sized.join(mass.df.withColumnRenamed(mass.value, "_mass"), list(mass.dims))
        size = size * F.col("_mass")
    sized = sized.withColumns({"_n": F.count("*").over(whole), "_i": F.row_number().over(order) - 1, "_below": F.sum(size).over(below), "_all": F.sum(size).over(whole)})
    first = F.floor((F.col("_n") % skip) / 2)
    chosen = sized.where((F.col("_i") >= first) & ((F.col("_i") - first) % skip == 0))
    # area south of latitude phi is 2 pi a^2 (1 + sin phi); scaled by the grid's own total
    share = F.least(F.greatest(2 * F.col("_below") / F.col("_all") - 1, F.lit(-1.0)), F.lit(1.0))
    if mass is None:
        return chosen.select(*rest, F.col(v).alias("q"), F.degrees(F.asin(share)).alias("eqlat"), F.col("_i").alias("k"))
    # a row a latitude and other dimension, cut where its running mass reaches the contour's
    bands = areas(f, known).join(mass.df.withColumnRenamed(mass.value, "_mass"), list(mass.dims)).groupBy(*rest, "lat").agg(F.sum(F.col("_area") * F.col("_mass")).alias("_m"))
    by = Window.partitionBy(*rest).orderBy("lat")
    edges = coordinate(f.df, "lat", sharp=False, values=(known or {}).get("lat"))
    steps = bands.join(F.broadcast(edges.select("lat", "lo", "hi")), "lat").withColumn("_up", F.sum("_m").over(by)).withColumn("_lo", F.col("_up") - F.col("_m"))
    hits = chosen.select(*rest, F.col(v).alias("q"), "_below", F.col("_i").alias("k"))
    joined = hits.join(steps, rest) if rest else hits.crossJoin(F.broadcast(steps))
    inside = joined.where((F.col("_below") > F.col("_lo")) & (F.col("_below") <= F.col("_up") * (1 + 1e-12)))
    lat = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("_below") - F.col("_lo")) / (F.col("_up") - F.col("_lo"))
    return inside.groupBy(*rest, "q", "k").agg(F.min(lat).alias("eqlat"))


def eqlat(f: Field, skip: int = 10, mass: Field | None = None) -> DataFrame:
    return contours(f, skip, mass)


def _numbered(f: Field, q: DataFrame, lats: list[float]) -> DataFrame:
    """(rest, n, q, eqlat, _s): one contour a latitude, numbered from 1, of which only
    those that the interpolation to the grid's latitudes needs."""
    rest = f.rest("lat", "lon")
    by = Window.partitionBy(*rest).orderBy("eqlat")
    q = q.groupBy(*rest, "eqlat").agg(F.min("q").alias("q"))
    grid = F.array(*(F.lit(float(y)) for y in lats))
    before, after = F.lag("eqlat").over(by), F.lead("eqlat").over(by)
    # next to a latitude of the grid, or the first or last of all
    between = lambda a, b: F.coalesce(F.exists(grid, lambda y: (y >= a) & (y <= b)), F.lit(True))
    needed = q.withColumns({"_a": between(before, F.col("eqlat")), "_b": between(F.col("eqlat"), after)}).where("_a or _b")
    return needed.select(*rest, F.row_number().over(by).alias("n"), "q", "eqlat", F.sin(F.radians("eqlat")).alias("_s"))


def _until(rest: list[str], rows: DataFrame, x: str, q: DataFrame, of: str, name: str) -> DataFrame:
    """``rows`` with the largest n of the contours whose ``of`` is at most ``x`` (0: none)."""
    marks = q.select(*rest, F.col(of).alias(x), F.col("n").alias("_n"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy(*rest).orderBy(x).rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.coalesce(F.max("_n").over(upto), F.lit(0))).where("_n is null").drop("_n")


def activity(f: Field, skip: int = 10, omega: Field | None = None, sigma: Field | None = None, flip: bool = True, local: bool = False) -> Field:
    """Wave activity on the grid's latitudes, zonal or at each longitude.

    For the contour Q of equivalent latitude phi: the field (or ``omega``) where it
    is at least Q south of phi, less where it is below Q north of it, integrated
    over area and divided by the length of the parallel; locally, along the
    meridian.  A cell that phi cuts counts by its parts.  ``sigma`` weighs the
    equivalent latitudes by mass; ``flip`` turns the field upside down and
    changes its sign first, so that activity is that of the southern side.
    Beyond the first and last contour their values hold.

    What a cell gives is, over the contours in order, constant or linear in
    sin(phi) on at most three stretches.  Each stretch becomes an event at its
    start and one at its end, and running sums over events give all contours at
    once: no cell meets a contour.
    """
    rest, v, units = f.rest("lat", "lon"), f.value, (f.units + " m").strip()
    if flip:
        mirrored = lambda g, sign: g.with_df(g.df.withColumns({"lat": -F.col("lat"), g.value: F.col(g.value) * sign}).select(*g.df.columns))
        f = mirrored(f, -1.0)
        omega, sigma = (mirrored(omega, -1.0) if omega else None), (mirrored(sigma, 1.0) if sigma else None)
    known = axes(f.df, "lat", "lon")
    if known is None:
        raise ValueError("an axis is too long for a grid")
    q = _numbered(f, contours(f, skip, sigma, known).select(*rest, "q", "eqlat"), known["lat"])
    sized = areas(f, known).where(f.v.isNotNull())
    amount = f.v
    if omega is not None:
        sized = sized.join(omega.df.withColumnRenamed(omega.value, "_omega"), list(omega.dims))
        amount = F.col("_omega")
    if local:  # along a meridian, on the grid's own parallels
        width = f.df.sparkSession.createDataFrame([(x, d) for x, _, _, _, d in cells(known["lat"], "lat", False)], f"lat {f.df.schema['lat'].dataType.simpleString()}, _dlat double")
        sized = sized.join(F.broadcast(width), "lat")
        size = F.radians("_dlat") * RADIUS * F.cos(F.radians("lat"))
    else:
        size = F.col("_area")
    heads = [*rest, "lon"] if local else rest
    slim = sized.select(*heads, "lat", f.v.alias("_q"), (amount * size).alias("_w"), "_lo", "_hi")
    # _j: contours that the value reaches; the edges of a cell lie behind _m0 and _m1 contours
    slim = _until(rest, slim, "_q", q, "q", "_j")
    sides = coordinate(f.df, "lat", sharp=False, values=known["lat"])
    sides = sides.select("lat", F.posexplode(F.array(F.sin(F.radians("lo")), F.sin(F.radians("hi")))).alias("_side", "_x"))
    if rest:
        sides = q.select(*rest).distinct().crossJoin(F.broadcast(sides))
    passed = _until(rest, sides, "_x", q, "_s", "_m").groupBy(*rest, "lat").agg(F.max(F.when(F.col("_side") == 0, F.col("_m"))).alias("_m0"), F.max(F.when(F.col("_side") == 1, F.col("_m"))).alias("_m1"))
    slim = slim.join(passed, [*rest, "lat"])
    j, m0, m1, w = F.col("_j"), F.col("_m0"), F.col("_m1"), F.col("_w")
    slope = w / (F.col("_hi") - F.col("_lo"))
    stretch = lambda a, b, alpha, beta: F.when(a < b, F.array(_event(a, alpha, beta), _event(b, -alpha, -beta))).otherwise(F.array().cast(_EVENTS))
    events = F.concat(
        stretch(j + 1, m0 + 1, -w, F.lit(0.0)),  # low, all of it north of the contour
        stretch(m0 + 1, F.least(j, m1) + 1, -slope * F.col("_lo"), slope),  # high, its southern part
        stretch(F.greatest(m0, j) + 1, m1 + 1, -slope * F.col("_hi"), slope),  # low, its northern part
        stretch(m1 + 1, j + 1, w, F.lit(0.0)),  # high, all of it south
    )
    sums = slim.select(*heads, F.explode(events).alias("e")).groupBy(*heads, F.col("e.n").alias("n")).agg(F.sum("e.alpha").alias("_alpha"), F.sum("e.beta").alias("_beta"))
    spine = q
    if local:
        spine = q.crossJoin(F.broadcast(f.df.sparkSession.createDataFrame([(x,) for x in known["lon"]], f"lon {f.df.schema['lon'].dataType.simpleString()}")))
    by = Window.partitionBy(*heads).orderBy("n")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    found = spine.join(sums, [*heads, "n"], "left").withColumns({"_alpha": F.sum("_alpha").over(run), "_beta": F.sum("_beta").over(run)})
    total = F.coalesce("_alpha", F.lit(0.0)) + F.coalesce("_beta", F.lit(0.0)) * F.col("_s")
    parallel = F.cos(F.radians("eqlat")) * (1.0 if local else 2 * 3.141592653589793 * RADIUS)
    # at a pole there is no parallel
    found = found.select(*heads, "n", "eqlat", F.when(F.abs("eqlat") < 90 - 1e-9, total / parallel).alias("_v")).where("_v is not null")
    after = {"_x1": F.lead("eqlat").over(by), "_v1": F.lead("_v").over(by), "_first": F.lag("eqlat").over(by).isNull(), "_last": F.lead("eqlat").over(by).isNull()}
    found = found.withColumns(after)
    grid = F.array(*(F.lit(float(y)) for y in known["lat"]))
    x0, x1 = F.col("eqlat"), F.col("_x1")
    inside = F.filter(grid, lambda y: (F.col("_first") | (y >= x0)) & (F.col("_last") | (y < x1)) & (~F.col("_last") | (y >= x0) | F.col("_first")))
    out = found.withColumn("lat", F.explode(inside))
    value = F.when(F.col("_last") | (F.col("lat") <= x0), F.col("_v")).otherwise(F.col("_v") + (F.col("lat") - x0) * (F.col("_v1") - F.col("_v")) / (x1 - x0))
    dims = (*heads, "lat")
    out = out.select(*heads, ((-F.col("lat")) if flip else F.col("lat")).alias("lat"), value.alias(v))
    return Field(out, dims, v, units, f.name, f.coord_units)


_EVENTS = "array<struct<n:int,alpha:double,beta:double>>"


def _event(n: Column, alpha: Column, beta: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), alpha.alias("alpha"), beta.alias("beta"))


def waq(f: Field, skip: int = 10, **options) -> Field:
    return activity(f, skip, **options)


def waqlocal(f: Field, skip: int = 10, **options) -> Field:
    return activity(f, skip, local=True, **options)
