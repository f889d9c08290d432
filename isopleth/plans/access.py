"""Names of dimensions, coordinates with their bounds, and look-up by label or place."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import functions as F

from ..field import Field
from ..functions import units as u
from ..operators import grid
from .registry import variables

#: CF axis and coordinate names, by the dimension that they mean.
_AXES = {"X": "longitude", "Y": "latitude", "Z": "vertical", "T": "time"}
_NAMES = {"longitude": ("lon", "long", "x"), "latitude": ("lat", "y"), "vertical": ("lev", "level", "plev", "pressure", "pres", "height", "z", "theta"), "time": ("time", "t", "date", "month", "day", "year")}
_BOUNDS = re.compile(r"^(.*?)(?:_(top|bot|bottom|del|delta|bnds|bounds))?$")
#: Measures, and the dimensions over which each is a weight.
MEASURES = {"width": ("lon",), "depth": ("lat",), "height": ("lev",), "duration": ("time",), "area": ("lon", "lat"), "volume": ("lon", "lat", "lev")}


@lru_cache(maxsize=1024)
def cf_names(dims: tuple[str, ...], units: tuple[tuple[str, str], ...]) -> dict[str, str]:
    """CF coordinate name of each dimension that has one, by its units or its name."""
    out, said = {}, dict(units)
    for d in dims:
        text = said.get(d, "")
        name = "longitude" if text in u.LONGITUDE else "latitude" if text in u.LATITUDE else None
        name = name or next((cf for cf, names in _NAMES.items() if d == cf or d.lower() in names), None)
        if name and name not in out.values():
            out[d] = name
    return out


def names_of(f: Field) -> dict[str, str]:
    return cf_names(f.dims, tuple(sorted(f.coord_units.items())))


def encode(f: Field, dim: str) -> str:
    """The CF name of a dimension; KeyError if it has none."""
    return names_of(f)[dim]


def decode(f: Field, key: str) -> str:
    """The dimension that a name, CF axis or coordinate, or alias of a variable means."""
    if key in f.dims:
        return key
    cf = _AXES.get(key) or next((c for c, names in _NAMES.items() if key == c or key in names), key)
    for dim, name in names_of(f).items():
        if name == cf:
            return dim
    for dim in f.dims:
        if dim in variables and key in variables and variables.get(dim).name == variables.get(key).name:
            return dim
    raise KeyError(key)


def vertical_type(f: Field) -> str:
    """height, pressure, temperature or unknown, by the units of the vertical axis."""
    try:
        said = u.parse(f.coord_units.get(decode(f, "vertical"), ""))
    except KeyError:
        return "unknown"
    return next((k for k, to in (("height", "m"), ("pressure", "Pa"), ("temperature", "K")) if said.alike(u.parse(to))), "unknown")


def plain(f: Field, dim: str, value):
    """A label without units, in those of the dimension: numbers, quantities, lists and slices."""
    if isinstance(value, slice):
        return slice(plain(f, dim, value.start), plain(f, dim, value.stop))
    if isinstance(value, (list, tuple)):
        return [plain(f, dim, x) for x in value]
    return value.to(f.coord_units.get(dim, "")).value if isinstance(value, u.Quantity) else value


def by_dims(f: Field, key) -> dict:
    """``key`` as a dictionary: one already, or labels in the order of the dimensions,
    of which ``...`` skips some."""
    if isinstance(key, dict):
        return {decode(f, k): v for k, v in key.items()}
    several = key if isinstance(key, tuple) else (key,)
    if Ellipsis in several:
        at = several.index(Ellipsis)
        several = (*several[:at], *[slice(None)] * (len(f.dims) - len(several) + 1), *several[at + 1 :])
    if len(several) > len(f.dims):
        raise IndexError(f"{len(several)} indexers for {len(f.dims)} dimensions")
    return {d: v for d, v in zip(f.dims, several) if v != slice(None)}  # noqa: B905


class Coords:
    """Coordinates of a field by any name, also derived ones; ``_bot``, ``_top``, ``_del``
    and ``_bnds`` after a name give the edges of its cells."""

    def __init__(self, f: Field):
        self.field = f

    def __iter__(self):
        return iter(self.field.dims)

    def __len__(self) -> int:
        return len(self.field.dims)

    def __contains__(self, key: str) -> bool:
        return self.get(key) is not None

    def __getitem__(self, key: str) -> Field:
        found = self.get(key)
        if found is None:
            raise KeyError(key)
        return found

    def get(self, key: str, default: Field | None = None, sharp_cutoff: bool = True) -> Field | None:
        name, flag = _BOUNDS.match(key).groups()
        f = self.field
        try:
            source, build, units = decode(f, name), None, None
        except KeyError:
            from .derivations import one_to_one

            found = next((x for d in f.dims if (x := one_to_one(d, encode_or_none(f, d), name))), None)
            if found is None:
                return default
            source, build, units = found
        table = self.edges(source, sharp_cutoff) if flag else grid.coordinate(f.df, source)
        x = lambda c: F.col(c).cast("double")
        said = f.coord_units.get(source, "")
        through = (lambda c: build(u.convert(c, said, units[0]) if said and units[0] else c)) if build else (lambda c: c)
        if flag in ("bnds", "bounds"):
            df = table.select(source, F.posexplode(F.array(through(x("lo")), through(x("hi")))).alias("bnds", "v"))
            return Field(df, (source, "bnds"), "v", units[1] if build else said, key, {source: said})
        value = {None: lambda: through(x(source)), "bot": lambda: through(x("lo")), "top": lambda: through(x("hi"))}.get(flag and flag[:3], lambda: F.abs(through(x("hi")) - through(x("lo"))))()
        return Field(table.select(source, value.alias("v")), (source,), "v", units[1] if build else said, key, {source: said})

    def edges(self, dim: str, sharp: bool):
        """(dim, lo, hi); times are the ends of their cells, and the lone edge of
        latitudes beyond the equator is moved next to it."""
        f = self.field
        if encode_or_none(f, dim) == "time" and f.df.schema[dim].dataType.simpleString() in ("date", "timestamp", "timestamp_ntz"):
            return grid.time_bounds(f.df, dim)
        if encode_or_none(f, dim) != "latitude":
            return grid.coordinate(f.df, dim, sharp)
        values = (grid.axes(f.df, dim) or {}).get(dim) or []
        rows = [[r[0], max(r[2], -90.0), min(r[3], 90.0)] for r in grid.cells(values, dim, sharp)]
        for beyond, edge in ((lambda e: e < -1e-10, -1e-10), (lambda e: e > 1e-10, 1e-10)):
            lone = [(i, k) for i, row in enumerate(rows) for k in (1, 2) if beyond(row[k])]
            if len(lone) == 1:
                rows[lone[0][0]][lone[0][1]] = edge
        return f.df.sparkSession.createDataFrame([tuple(r) for r in rows], f"`{dim}` {f.df.schema[dim].dataType.simpleString()}, lo double, hi double")


def encode_or_none(f: Field, dim: str) -> str | None:
    return names_of(f).get(dim)


class Loc:
    """Look-up by label, also with quantities; ``set`` gives a field with other values there."""

    def __init__(self, f: Field, places: bool = False):
        self.field, self.places = f, places

    def __getitem__(self, key) -> Field:
        from ..operators import select

        f = self.field
        asked = {d: plain(f, d, v) for d, v in by_dims(f, key).items()}
        if not self.places:
            return select.sel(f, **asked)
        out = select.isel(f, **asked)
        for d, v in asked.items():
            if isinstance(v, int):  # a single place drops its dimension
                out = out.reduced(out.df.drop(d), (d,), "point", ).with_df(out.df.drop(d), cell_methods=f.cell_methods)
        return out

    def set(self, key, value) -> Field:
        """``value``: a number, a quantity, or a field over some of the dimensions."""
        f, where = self.field, F.lit(True)
        asked = {d: plain(f, d, v) for d, v in by_dims(f, key).items()}
        known = grid.axes(f.df, *asked) if self.places and asked else {}
        for d, v in asked.items():
            x = F.col(d)
            if self.places:
                axis = known[d]
                v = axis[v] if not isinstance(v, (list, tuple)) else [axis[i] for i in v]
            if isinstance(v, slice):
                where = where & (x >= v.start if v.start is not None else F.lit(True)) & (x <= v.stop if v.stop is not None else F.lit(True))
            else:
                where = where & (x.isin(*v) if isinstance(v, list) else x == v)
        if isinstance(value, u.Quantity):
            value = value.to(f.units).value
        if not isinstance(value, Field):
            return f.assign(where, F.lit(value).cast("double"))
        value = value.to_units(f.units) if value.units and f.units else value
        shared = [d for d in f.dims if d in value.dims]
        other = value.df.select(*shared, value.v.alias("_new"), F.lit(True).alias("_there"))
        df = f.df.join(other, shared, "left") if shared else f.df.crossJoin(F.broadcast(other))
        new = F.when(where & F.col("_there"), F.col("_new")).otherwise(f.v)
        return f.with_df(df.withColumn(f.value, new).select(*f.df.columns))


def parameters(f: Field) -> tuple[str, ...]:
    """Dimensions whose variable has a reference value."""
    return tuple(d for d in f.dims if d in variables and variables.get(d).reference is not None)


def replace_reference(v, reference: float | None):
    """The variable with a reference value."""
    from dataclasses import replace

    return replace(v, reference=reference)


def variable(f: Field):
    """The variable of a field as its reductions make it; one that is not registered is
    added from the field's own name and units."""
    import warnings

    if not f.name:
        raise AttributeError("a field without a name has no variable")
    if f.name not in variables:
        variables.define(f.name, f.name.replace("_", " "), f.units)
        warnings.warn(f"{f.name!r} was added to the registry", stacklevel=2)
    methods = {}
    for dims, method in f.cell_methods:
        for d in dims:
            cf = next((c for c, names in _NAMES.items() if d == c or d in names), d)
            methods.setdefault(cf, method)
    return variables.get(f.name).modify(**methods)


def concat(fields: list[Field], dim: str, values: list[float], check: bool = True) -> Field:
    """Fields over the same coordinates along a new dimension; an error if they differ."""
    if len(fields) != len(values) or any(set(g.dims) != set(fields[0].dims) for g in fields):
        raise ValueError("fields to be joined need the same dimensions and a value each")
    first = fields[0]
    parts = [g.to_units(first.units).df.select(F.lit(float(x)).alias(dim), *first.dims, g.v.alias(first.value)) for g, x in zip(fields, values, strict=True)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    if check and df.groupBy(*first.dims).agg(F.count("*").alias("_n")).where(F.col("_n") != len(fields)).take(1):
        raise ValueError("the coordinates differ")
    return first.with_df(df, dims=(dim, *first.dims))
