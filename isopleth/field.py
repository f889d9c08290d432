"""Labelled fields: long-form DataFrames with dimensions, a value and metadata."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from .functions import units as u


def clean(value: Column | str) -> Column:
    """A double in which NaN is NULL."""
    v = F.col(value) if isinstance(value, str) else value
    return F.nullif(v.cast("double"), F.lit(float("nan")))


@dataclass(frozen=True)
class Field:
    """One variable over named dimensions.

    ``df`` holds one row a cell: the dimension columns and ``value``.  Units and
    the history of reductions live here and are written to the column's metadata
    when the frame is handed out (``frame``), because expressions drop metadata.
    """

    df: DataFrame
    dims: tuple[str, ...]
    value: str = "v"
    units: str = ""
    name: str = ""
    coord_units: dict[str, str] = field(default_factory=dict)
    cell_methods: tuple[tuple[tuple[str, ...], str], ...] = ()
    scalars: dict[str, float | None] = field(default_factory=dict)
    quantified: bool = True
    measures: dict[str, Field] = field(default_factory=dict)

    @staticmethod
    def of(df: DataFrame, dims: Iterable[str], value: str = "v", **meta) -> Field:
        """From a frame with other columns too; NaN becomes NULL."""
        dims = tuple(dims)
        return Field(df.select(*dims, clean(value).alias(value)), dims, value, **meta)

    def rest(self, *without: str) -> list[str]:
        """The dimensions but for the named ones."""
        return [d for d in self.dims if d not in without]

    def with_df(self, df: DataFrame, **changes) -> Field:
        return replace(self, df=df, **changes)

    def with_value(self, expr: Column, **changes) -> Field:
        """The same cells with another value."""
        return self.with_df(self.df.withColumn(self.value, expr), **changes)

    def reduced(self, df: DataFrame, dims: Iterable[str], method: str, **changes) -> Field:
        """After a reduction: the dims go, NaN scalars and a record of the method stay."""
        gone = tuple(dims)
        kept = tuple(d for d in self.dims if d not in gone)
        return replace(
            self, df=df, dims=kept, cell_methods=merge_methods(self.cell_methods, ((gone, method),)),
            scalars={**self.scalars, **dict.fromkeys(gone)}, **changes,
        )

    @property
    def v(self) -> Column:
        return F.col(self.value)

    def frame(self) -> DataFrame:
        """The DataFrame with units and history in the metadata of the value column."""
        meta = {"units": self.units, "long_name": self.name, "cell_methods": encode_methods(self.cell_methods)}
        return self.df.select(*(F.col(d).alias(d, metadata={"units": self.coord_units.get(d, "")}) for d in self.dims), self.v.alias(self.value, metadata=meta))

    # units

    def to_units(self, units: str, context: bool = False) -> Field:
        """Converted values; the factor is a literal of the plan."""
        return self.with_value(u.convert(self.v, self.units, units, context), units=units)

    def to_base_units(self) -> Field:
        p = u.parse(self.units)
        text = " ".join(b if n == 1 else f"{b}^{n}" for b, n in zip(u.BASE, p.powers, strict=True) if n)
        return self.to_units(text)

    def to_compact_units(self) -> Field:
        """The prefix that suits the largest value; one aggregate decides it."""
        most = self.df.agg(F.max(F.abs(self.v))).first()[0]
        return self.to_units(u.compact(self.units, most or 0.0))

    def to_standard_units(self) -> Field:
        from .plans.registry import variables

        return self.to_units(variables.get(self.name).standard_units, context=True)

    def quantify(self) -> Field:
        """Sums convert the other field to this one's units."""
        return replace(self, quantified=True)

    def dequantify(self) -> Field:
        """Sums take the numbers as they are, whatever their units."""
        return replace(self, quantified=False)

    @property
    def magnitude(self) -> Field:
        """The numbers alone."""
        return replace(self, units="", quantified=False)

    @property
    def quantity(self) -> Field:
        return self.quantify()

    @property
    def units_label(self) -> str:
        return u.tex(self.units)

    # arithmetic over shared dimensions

    def _with(self, other: Field | float | Column | u.Quantity, op, units) -> Field:
        if isinstance(other, u.Quantity):
            return self.with_value(op(self.v, F.lit(other.value)), units=units(self.units, other.units))
        if not isinstance(other, Field):
            return self.with_value(op(self.v, F.lit(other)))
        shared = [d for d in self.dims if d in other.dims]
        right = other.df.withColumnRenamed(other.value, "_other")
        # fields that share no dimension have every pair of cells: that is what is asked for
        df = self.df.join(right, shared) if shared else self.df.crossJoin(right)
        dims = (*self.dims, *other.rest(*self.dims))
        return replace(self, df=df.select(*dims, op(self.v, F.col("_other")).alias(self.value)), dims=dims, units=units(self.units, other.units))

    def _like(self, other):
        """The other operand of a sum in this field's units."""
        if isinstance(other, Field):
            return other.to_units(self.units) if self.quantified and other.quantified else other
        return other.to(self.units) if isinstance(other, u.Quantity) else other

    def __add__(self, other):
        return self._with(self._like(other), lambda a, b: a + b, lambda a, b: a)

    def __sub__(self, other):
        return self._with(self._like(other), lambda a, b: a - b, lambda a, b: a)

    def __mul__(self, other):
        return self._with(other, lambda a, b: a * b, lambda a, b: (u.parse(a) * u.parse(b)).text)

    def __truediv__(self, other):
        return self._with(other, lambda a, b: a / F.nullif(b, F.lit(0.0)), lambda a, b: (u.parse(a) / u.parse(b)).text)

    def abs(self) -> Field:
        return self.with_value(F.abs(self.v))

    def reciprocal(self) -> Field:
        return self.with_value(1 / F.nullif(self.v, F.lit(0.0)), units=(u.Unit() / u.parse(self.units)).text)

    def assign(self, condition: Column, value: Column | float) -> Field:
        """A new field with ``value`` where the condition holds."""
        return self.with_value(F.when(condition, value).otherwise(self.v))

    # look-up, naming and coordinates

    @property
    def coords(self):
        from .plans.access import Coords

        return Coords(self)

    @property
    def loc(self):
        from .plans.access import Loc

        return Loc(self)

    def __getitem__(self, key) -> Field:
        """A coordinate by its name, or cells by place: a slice, number or list a
        dimension, in their order or by name."""
        from .plans.access import Loc

        return self.coords[key] if isinstance(key, str) else Loc(self, places=True)[key]

    def set(self, key, value) -> Field:
        """With other values at some places; see ``loc.set`` for labels."""
        from .plans.access import Loc

        return Loc(self, places=True).set(key, value)

    def transpose(self, *dims: str) -> Field:
        """Dimensions in another order; those that are not named come first."""
        order = (*self.rest(*dims), *(d for d in dims if d in self.dims))
        if order == self.dims:
            return self
        return replace(self, df=self.df.select(*order, self.value), dims=order)

    @property
    def vertical_type(self) -> str:
        from .plans.access import vertical_type

        return vertical_type(self)

    @property
    def parameters(self) -> tuple[Field, ...]:
        """The coordinates whose variable has a reference value."""
        from .plans.access import parameters

        return tuple(self.coords[d] for d in parameters(self))

    @property
    def parameter(self) -> Field:
        found = self.parameters
        if not found:
            raise AttributeError("no dimension has a reference value")
        return found[0]

    @property
    def variable(self):
        from .plans.access import variable

        return variable(self)

    def add_scalar_coords(self) -> Field:
        """Longitude, latitude and level that are not there as averaged-out scalars."""
        from .plans.access import names_of

        there = set(names_of(self).values())
        gone = tuple(d for d, cf in (("lon", "longitude"), ("lat", "latitude"), ("lev", "vertical")) if cf not in there)
        more = tuple(((d,), "mean") for d in gone if d not in self.scalars)
        return replace(self, scalars={**dict.fromkeys(gone), **self.scalars}, cell_methods=merge_methods(self.cell_methods, more))

    def add_cell_measures(self, measures: dict[str, Field] | list[str] | None = None, override: bool = False) -> Field:
        """With weights of its own: given ones by name, or the default ones of the named
        measures (of all that its dimensions allow).  One that is there stays unless
        it is to be overridden."""
        from .operators.grid import default_measures
        from .plans.access import MEASURES

        if not isinstance(measures, dict):
            names = list(measures) if measures is not None else [n for n, dims in MEASURES.items() if all(d in self.dims for d in dims)]
            measures = default_measures(self, names)
        unknown = [n for n in measures if n not in MEASURES]
        if unknown:
            raise ValueError(f"unknown cell measures {unknown}")
        new = {n: w for n, w in measures.items() if override or n not in self.measures}
        return replace(self, measures={**self.measures, **new})

    def window(self, axis: str) -> Window:
        """Rows of one series in order of ``axis``; without other dims it is one partition."""
        return Window.partitionBy(*self.rest(axis)).orderBy(axis)


def merge_methods(old, new):
    """History without repeats, in the order of first appearance."""
    return tuple(dict.fromkeys((*old, *new)))


def encode_methods(methods) -> str:
    return " ".join(f"{': '.join(dims)}: {method}" for dims, method in methods)


def decode_methods(text: str):
    """The inverse of ``encode_methods``."""
    out, dims = [], []
    for token in text.split():
        if token.endswith(":"):
            dims.append(token[:-1])
        else:
            out.append((tuple(dims), token))
            dims = []
    return tuple(out)


class _DatasetLoc:
    """Labels of dimensions for all variables that have them."""

    def __init__(self, ds: Dataset):
        self.ds = ds

    def __getitem__(self, key: dict) -> Dataset:
        from .plans.access import decode

        def some(f: Field) -> dict:
            out = {}
            for k, v in key.items():
                try:
                    out[decode(f, k)] = v
                except KeyError:
                    continue
            return out

        return Dataset({n: f.loc[mine] if (mine := some(f)) else f for n, f in self.ds.fields.items()})


class Dataset:
    """Named fields over shared coordinates, immutable like its fields."""

    def __init__(self, fields: dict[str, Field] | None = None):
        self.fields = dict(fields or {})

    @property
    def dims(self) -> tuple[str, ...]:
        """All dimensions, in order of first appearance."""
        return tuple(dict.fromkeys(d for f in self.fields.values() for d in f.dims))

    def __getitem__(self, key: str) -> Field:
        """A variable, coordinate or derivation, its dimensions in the dataset's order."""
        from .plans.access import Coords
        from .plans.derivations import resolve

        try:
            f = resolve(self, key)
        except KeyError:  # a coordinate with a suffix, or by its CF name
            f = next((c for x in self.fields.values() if (c := Coords(x).get(key)) is not None), None)
            if f is None:
                raise
        return f.transpose(*(d for d in self.dims if d in f.dims))

    @property
    def loc(self):
        return _DatasetLoc(self)

    def __contains__(self, key: str) -> bool:
        from .plans.derivations import can_resolve

        return can_resolve(self, key)

    def __iter__(self):
        return iter(self.fields)

    def __dir__(self):
        return [*super().__dir__(), *self.fields]

    def __getattr__(self, name: str) -> Field:
        if name.startswith("_") or name == "fields":
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def __repr__(self) -> str:
        return "Dataset(" + ", ".join(f"{k}{f.dims} [{f.units}]" for k, f in self.fields.items()) + ")"

    def vars(self, key: str, default=None):
        try:
            return self[key]
        except KeyError:
            return default

    def add(self, name: str, value: Field | str) -> Dataset:
        """With one more variable (a field, or the name of a derivation); error if present."""
        if name in self.fields:
            raise ValueError(f"{name!r} is there already")
        return Dataset({**self.fields, name: self[value] if isinstance(value, str) else value})

    def quantify(self) -> Dataset:
        return Dataset({k: f.quantify() for k, f in self.fields.items()})

    def dequantify(self) -> Dataset:
        return Dataset({k: f.dequantify() for k, f in self.fields.items()})

    def get(self, key: str, **options) -> Field:
        from .plans.query import get

        return get(self, key, **options)
