"""Derived variables: a registry searched backwards, folded into column expressions."""

from __future__ import annotations

import functools
import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F

from ..field import Dataset, Field
from ..functions import constants as const, sphere, units as u
from .registry import variables


@dataclass(frozen=True)
class Derivation:
    """``build`` takes a column for each input, in its units, and gives the output's."""

    inputs: tuple[str, ...]
    output: str
    build: Callable[..., Column]
    input_units: tuple[str, ...]
    output_units: str


_DERIVATIONS: dict[str, list[Derivation]] = {}


def register_derivation(inputs, output: str | tuple[str, ...], units_in: tuple[str, ...] = (), units_out: str | tuple[str, ...] | None = None):
    """Decorator: the function derives ``output`` from ``inputs`` (names, alternatives
    split by a vertical bar); units default to the registry's standard ones.

    A tuple of outputs is derived by a function that gives a tuple of columns.
    """
    names = (inputs,) if isinstance(inputs, str) else tuple(inputs)

    def decorate(build):
        std = lambda n: variables.get(n).standard_units if n in variables else ""
        ins = tuple(units_in) or tuple(std(n.split("|")[0]) for n in names)
        several = output if isinstance(output, tuple) else (output,)
        units = units_out if isinstance(units_out, tuple) else (units_out,) * len(several)
        for i, (outs, said) in enumerate(zip(several, units, strict=True)):
            one = (lambda *columns, i=i: build(*columns)[i]) if isinstance(output, tuple) else build
            for out in outs.split("|"):
                _DERIVATIONS.setdefault(out, []).append(Derivation(names, out, one, ins, std(out) if said is None else said))
        return build

    return decorate


def one_to_one(dim: str, cf: str | None, key: str):
    """(dim, build, (units in, units out)) of a derivation of ``key`` from one coordinate."""
    mine = {dim, *(_names(dim)), *((cf, *_names(cf)) if cf else ())}
    for name in _names(key):
        for d in _DERIVATIONS.get(name, []):
            if len(d.inputs) == 1 and mine & {x for option in d.inputs[0].split("|") for x in _names(option)}:
                return dim, d.build, (d.input_units[0] if d.input_units else "", d.output_units)
    return None


def register_transformation(source: str, dest: str, **units):
    """A derivation of one variable from one other."""
    return register_derivation((source,), dest, **units)


def _names(key: str) -> tuple[str, ...]:
    return variables.get(key).identifiers if key in variables else (key,)


def _find(ds: Dataset, key: str, busy: frozenset[str] = frozenset()) -> Field | None:
    for name in _names(key):
        if name in ds.fields:
            return ds.fields[name]
    for f in ds.fields.values():  # a coordinate
        for name in _names(key):
            if name in f.dims:
                df = f.df.select(name).distinct().withColumn("v", F.col(name).cast("double"))
                return Field(df, (name,), "v", f.coord_units.get(name, ""), key, {name: f.coord_units.get(name, "")})
    if key in busy:
        return None
    for name in _names(key):
        for d in _DERIVATIONS.get(name, []):
            found = [next((f for option in n.split("|") if (f := _find(ds, option, busy | {key}))), None) for n in d.inputs]
            if all(f is not None for f in found):
                return _apply(d, found, key)
    return None


def _apply(d: Derivation, fields: list[Field], key: str) -> Field:
    df, dims, columns = None, (), []
    for i, (f, units) in enumerate(zip(fields, d.input_units, strict=True)):
        f = f.to_units(units, context=True) if f.units or units else f
        part = f.df.select(*f.dims, f.v.alias(f"_in{i}"))
        shared = [c for c in dims if c in f.dims]
        df = part if df is None else df.join(part, shared) if shared else df.crossJoin(part)
        dims = (*dims, *f.rest(*dims))
        columns.append(F.col(f"_in{i}"))
    units = {k: v for f in fields for k, v in f.coord_units.items()}
    return Field(df.select(*dims, d.build(*columns).alias("v")), dims, "v", d.output_units, key, units)


def resolve(ds: Dataset, key: str) -> Field:
    """A variable, else a coordinate, else a derivation, by name or alias."""
    f = _find(ds, key)
    if f is None:
        raise KeyError(key)
    return f if f.name else replace(f, name=key)


def can_resolve(ds: Dataset, key: str) -> bool:
    return _find(ds, key) is not None


def to_variable(f: Field, dest: str) -> Field:
    """One variable turned into another by a chain of one-to-one derivations."""
    paths, seen = [[f.name]], {f.name}
    while paths:
        path = paths.pop(0)
        if dest in _names(path[-1]):
            out = f
            for step in path[1:]:
                d = next(x for x in _DERIVATIONS[step] if len(x.inputs) == 1 and out.name in _names(x.inputs[0]))
                out = _apply(d, [out], step)
            return out
        for name, options in _DERIVATIONS.items():
            if name not in seen and any(len(d.inputs) == 1 and path[-1] in _names(d.inputs[0]) for d in options):
                seen.add(name)
                paths.append([*path, name])
    raise KeyError(f"{f.name} -> {dest}")


register_transformation("latitude", "meridional_coordinate", units_in=("deg",))(sphere.meridional_coordinate)
register_transformation("latitude", "cosine_latitude", units_in=("deg",))(sphere.cosine_latitude)
register_transformation("latitude", "coriolis_parameter", units_in=("deg",))(sphere.coriolis)
register_transformation("latitude", "beta_parameter", units_in=("deg",))(sphere.beta)
for _pressure in ("pressure", "lev"):
    register_transformation(_pressure, "reference_height", units_in=("hPa",))(sphere.reference_height)
    register_transformation(_pressure, "reference_density", units_in=("hPa",))(sphere.reference_density)
    register_transformation(_pressure, "reference_potential_temperature", units_in=("hPa",))(sphere.reference_potential_temperature)


@register_derivation(("temperature", "pressure|lev"), "potential_temperature", units_in=("K", "hPa"))
def potential_temperature(temperature: Column, pressure: Column) -> Column:
    return temperature * F.pow(F.lit(const.p0 / 100) / pressure, F.lit(2 / 7))


def _relation(text: str, units: dict[str, str]) -> str:
    """Units of a relation such as ``y / x ^ 2`` between named inputs."""
    above, _, below = text.replace("**", "^").partition("/")
    out = u.Unit()
    for part, sign in ((above, 1), (below.replace("/", " "), -1)):
        for token in re.sub(r"\s*\^\s*", "^", part).replace("*", " ").split():
            name, _, power = token.partition("^")
            out = out * u.parse(units.get(name, name)) ** (int(power or 1) * sign)
    return out.text


def with_units(*units_in: str | None, out: str | None = None):
    """Decorator for functions on fields: inputs come in the given units, the result
    is labelled ``out``.

    ``=name`` names an input's units, whatever they are; another input of that name
    is converted to them, and ``out`` may be a relation of names, ``=y / x``, in
    which braces stand for options: ``=y / x ^ {order}``.
    """

    def decorate(function):
        @functools.wraps(function)
        def wrapped(*fields: Field, **options):
            named: dict[str, str] = {}
            ready = []
            for f, said in zip(fields, units_in, strict=True):
                if said is not None and said.startswith("="):
                    name = said[1:].strip()
                    f = f.to_units(named[name]) if name in named else f
                    named.setdefault(name, f.units)
                elif said is not None:
                    f = f.to_units(said)
                ready.append(f)
            result = function(*ready, **options)
            if out is None:
                return result
            defaults = {k: p.default for k, p in inspect.signature(function).parameters.items() if p.default is not inspect.Parameter.empty}
            return replace(result, units=_relation(out[1:].format(**{**defaults, **options}), named) if out.startswith("=") else out)

        return wrapped

    return decorate
