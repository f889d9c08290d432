"""Coordinate tables, bounds, cell measures and padding of grids.

A coordinate table has a row for each value of one dimension; it grows with the
grid's edge, not with the data.  The values are fetched by one pass over the
coordinate columns when a plan is built; the plan itself then reads its input once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..field import Field
from ..functions import constants as const

KM = const.a / 1000


#: Values of an axis that the driver takes; a longer axis stays a table.
AXIS_MOST = 1 << 20


def axes(df: DataFrame, *dims: str) -> dict[str, list] | None:
    """Sorted values of axes, by one pass over the coordinate columns alone.

    An axis is as long as the grid's edge.  None if one has over ``AXIS_MOST``
    values, of which no more than that are ever fetched.
    """
    one = lambda i: F.struct(F.lit(i).alias("i"), *((F.col(d) if i == j else F.lit(None).cast(df.schema[d].dataType)).alias(f"x{j}") for j, d in enumerate(dims)))
    rows = df.select(F.explode(F.array(*map(one, range(len(dims))))).alias("e")).select("e.*").distinct().limit(AXIS_MOST * len(dims) + 1).collect()
    found = {d: sorted(r[j + 1] for r in rows if r[0] == j and r[j + 1] is not None) for j, d in enumerate(dims)}
    return found if all(len(v) <= AXIS_MOST for v in found.values()) else None


def cells(values: list, dim: str, sharp: bool = True) -> list[tuple]:
    """(value, idx, lo, hi, delta) of each value of an axis; see ``coordinate``."""
    out, n = [], len(values)
    for i, x in enumerate(values):
        before, after = values[i - 1] if i else None, values[i + 1] if i + 1 < n else None
        x = float(x)
        lo = (before + x) / 2 if before is not None else x if sharp or after is None else x - (after - x) / 2
        hi = (x + after) / 2 if after is not None else x if sharp or before is None else x + (x - before) / 2
        if dim == "lat":
            lo, hi = max(lo, -90.0), min(hi, 90.0)
        out.append((values[i], i, float(lo), float(hi), float(hi - lo)))
    return out


def coordinate(df: DataFrame, dim: str, sharp: bool = True, values: list | None = None) -> DataFrame:
    """(dim, idx, lo, hi, delta): cells centred on values, edges halfway between.

    End cells stop at their value (``sharp``) or reach half a step beyond it;
    edges of ``lat`` stay within the poles.  ``values`` are those of the axis, if
    known; otherwise they are fetched.
    """
    if values is None:
        values = (axes(df, dim) or {}).get(dim)
    if values is not None:
        return df.sparkSession.createDataFrame(cells(values, dim, sharp), f"`{dim}` {df.schema[dim].dataType.simpleString()}, idx int, lo double, hi double, delta double")
    w = Window.orderBy(dim)  # one task, as long as the axis
    before, after = F.lag(dim).over(w), F.lead(dim).over(w)
    x = F.col(dim)
    lo = F.coalesce((before + x) / 2, x if sharp else x - (after - x) / 2, x)
    hi = F.coalesce((x + after) / 2, x if sharp else x + (x - before) / 2, x)
    if dim == "lat":
        lo, hi = F.greatest(lo, F.lit(-90.0)), F.least(hi, F.lit(90.0))
    table = df.select(dim).distinct().where(x.isNotNull())
    return table.select(dim, (F.row_number().over(w) - 1).cast("int").alias("idx"), lo.alias("lo"), hi.alias("hi")).withColumn("delta", F.col("hi") - F.col("lo"))


def time_bounds(df: DataFrame, dim: str = "time") -> DataFrame:
    """(dim, lo, hi, days): times are ends of cells, the first step counts twice."""
    w = Window.orderBy(dim)
    t = F.unix_micros(F.col(dim).cast("timestamp")) / 8.64e10
    steps = df.select(dim).distinct().withColumn("_t", t)
    back, ahead = F.lag("_t").over(w), F.lead("_t").over(w)
    days = F.coalesce(F.col("_t") - back, ahead - F.col("_t"))
    return steps.select(dim, (F.col("_t") - days).alias("lo"), F.col("_t").alias("hi"), days.alias("days"))


def measure(df: DataFrame, dim: str, sharp: bool = True, values: list | None = None) -> DataFrame:
    """(dim, w_dim): the size of each cell along one dimension.

    lon: radians; lat: km times the cosine, which with lon's radians and the
    radius makes an area; lev (hPa): kg m-2; another dimension: its own units.
    """
    t = coordinate(df, dim, sharp, values)
    size: dict[str, Column] = {
        "lon": F.radians("delta") * KM,
        "lat": F.radians("delta") * KM * F.cos(F.radians("lat")),
        "lev": F.col("delta") * (100 / const.g),
    }
    return t.select(dim, size.get(dim, F.col("delta")).alias(f"w_{dim}"))


def cell_measures(df: DataFrame, sharp: bool = True) -> DataFrame:
    """(lat, lon, width, depth, area): zonal and meridional sizes in km."""
    known = axes(df, "lat", "lon") or {}
    lat, lon = (coordinate(df, d, sharp, known.get(d)) for d in ("lat", "lon"))
    depth = F.radians(lat["delta"]) * KM
    both = lat.select("lat", depth.alias("depth"), F.cos(F.radians("lat")).alias("cosine")).crossJoin(F.broadcast(lon.select("lon", (F.radians("delta") * KM).alias("arc"))))
    return both.select("lat", "lon", (F.col("arc") * F.col("cosine")).alias("width"), "depth", (F.col("arc") * F.col("cosine") * F.col("depth")).alias("area"))


def default_measures(f: Field, names: list[str]) -> dict[str, Field]:
    """Cell sizes as fields: width, depth, area (km), height (kg m-2), duration (days), volume."""
    known = axes(f.df, *f.dims) or {}
    one = {d: measure(f.df, d, values=known.get(d)) for d in ("lon", "lat", "lev") if d in f.dims}
    out = {}
    for name in names:
        if name == "duration":
            out[name] = Field(time_bounds(f.df).select("time", F.col("days").alias("v")), ("time",), "v", "days", name)
            continue
        if name in ("width", "depth"):  # both vary with latitude on the sphere
            both = cell_measures(f.df) if "lat" in f.dims and "lon" in f.dims else None
            dims = ("lat", "lon") if name == "width" else ("lat",)
            df = both.select(*dims, F.col(name).alias("v")).distinct() if both is not None else one["lon" if name == "width" else "lat"].toDF("lon" if name == "width" else "lat", "v")
            out[name] = Field(df, tuple(df.columns[:-1]), "v", "km", name)
            continue
        dims = {"height": ("lev",), "area": ("lat", "lon"), "volume": ("lat", "lon", "lev")}[name]
        df, value = one[dims[0]], F.col(f"w_{dims[0]}")
        for d in dims[1:]:  # axes, whose product is the grid itself
            df, value = df.crossJoin(F.broadcast(one[d])), value * F.col(f"w_{d}")
        out[name] = Field(df.select(*dims, value.alias("v")), dims, "v", {"height": "kg m^-2", "area": "km^2", "volume": "km^2 kg m^-2"}[name], name)
    return out


def cell_height(bottom: Column, top: Column, kind: str = "pressure", surface: Column | None = None, tropopause: Column | None = None, density: Column | None = None) -> Column:
    """Mass or thickness of a layer: dp / g of pressures in hPa clipped to the surface
    and tropopause, dz, or pseudo-density times dtheta; never negative, zero if unknown."""
    if kind == "pressure":
        low = F.least(bottom, surface) if surface is not None else bottom
        high = F.greatest(top, tropopause) if tropopause is not None else top
        out = (low - high) * (100 / const.g)
    else:
        out = top - bottom if kind == "height" else (top - bottom) * (density if density is not None else F.lit(1.0))
    return F.coalesce(F.greatest(out, F.lit(0.0)), F.lit(0.0))


def enforce_global(f: Field, longitude: bool = True, latitude: bool = True, vertical: bool = False, zero: bool = False) -> Field:
    """Rows added so that the grid reaches round and to both poles.

    The last longitude less 360 comes first unless the axis is cyclic already; the
    nearest row is copied to a pole if it lies beyond 80 degrees; ``vertical``
    copies the end levels to 0 and 1013.25 hPa; ``zero`` empties the poles.
    """
    asked = [d for on, d in ((longitude, "lon"), (latitude, "lat"), (vertical, "lev")) if on and d in f.dims]
    found, df = axes(f.df, *asked) if asked else {}, f.df
    if found is None:
        raise ValueError("an axis is too long for a grid")
    for dim in asked:
        if not found[dim]:
            continue
        a, b = found[dim][0], found[dim][-1]
        if dim == "lon":
            extra = [(b, b - 360)] if b - a < 360 else []
        elif dim == "lat":
            extra = [(a, -90.0)] * (-90 < a <= -80) + [(b, 90.0)] * (80 <= b < 90)
        else:
            extra = [(a, 0.0)] * (a > 0) + [(b, 1013.25)] * (b < 1013.25)
        df = copied(df, dim, extra)
    if zero:
        df = df.withColumn(f.value, F.when(F.abs("lat") == 90, F.lit(0.0)).otherwise(F.col(f.value)))
    return f.with_df(df)


def copied(df: DataFrame, dim: str, extra: list[tuple[float, float]]) -> DataFrame:
    """``df`` with further rows: those at the first value of a pair, moved to the second.
    Rows are copied where they stand, in one pass."""
    if not extra:
        return df
    kind = df.schema[dim].dataType
    several: dict[float, list[float]] = {}
    for at, to in extra:
        several.setdefault(at, []).append(to)
    places = F.array(F.col(dim))
    for at, to in several.items():
        places = F.when(F.col(dim) == F.lit(at), F.array(F.col(dim), *(F.lit(x).cast(kind) for x in to))).otherwise(places)
    return df.withColumn(dim, F.explode(places)).select(*df.columns)


def geopad(f: Field, nlon: int = 1, nlat: int = 0) -> Field:
    """Copies of ``nlon`` columns beyond either end of the circle, and of ``nlat`` rows
    beyond either pole, taken from the other side of it; one pass."""
    df, found = f.df, axes(f.df, "lon", "lat") if nlat else axes(f.df, "lon")
    if found is None:
        raise ValueError("an axis is too long for a grid")
    lon = found["lon"]
    df = copied(df, "lon", [(x, x - 360) for x in (lon[-nlon:] if nlon else [])] + [(x, x + 360) for x in lon[:nlon]])
    if not nlat:
        return f.with_df(df)
    if len(lon) % 2:
        raise ValueError("rows across a pole need an even number of longitudes")
    place = lambda y, x: F.struct(y.cast("double").alias("y"), x.cast("double").alias("x"))
    lat, across = F.col("lat"), F.when(F.col("lon") < 180, F.col("lon") + 180).otherwise(F.col("lon") - 180)
    places = F.array(place(lat, F.col("lon")))
    places = F.concat(places, F.when(lat <= found["lat"][:nlat][-1], F.array(place(-180 - lat, across))).otherwise(F.array().cast(_PLACES)))
    places = F.concat(places, F.when(lat >= found["lat"][-nlat:][0], F.array(place(180 - lat, across))).otherwise(F.array().cast(_PLACES)))
    df = df.withColumn("_at", F.explode(places)).withColumns({"lat": F.col("_at.y"), "lon": F.col("_at.x")})
    return f.with_df(df.select(*f.df.columns))


_PLACES = "array<struct<y:double,x:double>>"
_ALIASES = {"lon": ("longitude", "long", "x"), "lat": ("latitude", "y"), "lev": ("level", "plev", "pres", "pressure", "height", "z", "theta"), "time": ("date", "datetime", "t")}
_SIGNS = {"lon": "degree_E", "lat": "degree_N"}


def standardize_coords(f: Field, pressure_units: str = "hPa", height_units: str = "km", temperature_units: str = "K") -> Field:
    """Dimensions renamed to lon, lat, lev and time, known by unit or name; vertical
    coordinates in one unit each; units filled in where they were missing."""
    from dataclasses import replace

    from ..functions import units as u

    df, dims, units = f.df, list(f.dims), dict(f.coord_units)
    for i, dim in enumerate(f.dims):
        said = units.get(dim, "")
        new = "lon" if said in u.LONGITUDE else "lat" if said in u.LATITUDE else None
        new = new or next((k for k, names in _ALIASES.items() if dim.lower() == k or dim.lower() in names or dim.lower().startswith(k)), dim)
        if new in dims[:i] or (new != dim and new in f.dims):
            new = dim
        df, dims[i] = df.withColumnRenamed(dim, new), new
        units.pop(dim, None)
        if new == "lev" and said:
            p = u.parse(said)
            to = next((t for t in (pressure_units, height_units, temperature_units) if p.alike(u.parse(t))), said)
            df, said = df.withColumn(new, u.convert(F.col(new), said, to)), to
        units[new] = said or _SIGNS.get(new, "")
    return replace(f, df=df, dims=tuple(dims), coord_units=units)
