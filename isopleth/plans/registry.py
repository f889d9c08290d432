"""Variables: names, aliases, units and what reductions make of them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..functions import units as u


@dataclass(frozen=True)
class Variable:
    """One variable; children take what they do not say from their parent."""

    name: str
    long_name: str = ""
    standard_units: str = ""
    short_name: str = ""
    symbol: str = ""
    reference: float | None = None
    aliases: tuple[str, ...] = ()
    parent: Variable | None = field(default=None, compare=False)

    @property
    def identifiers(self) -> tuple[str, ...]:
        return (self.name, *self.aliases)

    def __contains__(self, other: str | Variable) -> bool:
        """Whether the other is this variable or a descendant of it."""
        if isinstance(other, str):
            return other in self.identifiers
        while other is not None:
            if other.name == self.name:
                return True
            other = other.parent
        return False

    def child(self, name: str, long_name: str = "", standard_units: str | None = None, **more) -> Variable:
        return Variable(name, long_name or f"{name.replace('_', ' ')}", self.standard_units if standard_units is None else standard_units, parent=self, **{"symbol": self.symbol, "reference": self.reference, **more})

    def modify(self, **methods: str) -> Variable:
        """The variable that reductions by dimension make: ``modify(latitude='argmax')``."""
        out = self
        for dim, method in methods.items():
            out = _reduced(out, dim, method)
        return out

    # labels

    def units_label(self) -> str:
        return u.tex(self.standard_units)

    def long_label(self) -> str:
        label = self.units_label()
        return f"{self.long_name} ({label})" if label else self.long_name

    def short_label(self) -> str:
        label = self.units_label()
        name = self.short_name or self.long_name
        return f"{name} ({label})" if label else name

    def scalar_label(self, value: float) -> str:
        units = f" {self.standard_units}" if self.standard_units else ""
        return f"{self.symbol or self.name} = {value:g}{units}"




def _reduced(v: Variable, dim: str, method: str) -> Variable:
    if method in ("argmax", "argmin", "absargmax", "absargmin", "argzero"):
        units = {"latitude": "degN", "longitude": "degE"}.get(dim, "")
        return replace(v, long_name=f"{dim} of {v.long_name}", standard_units=units)
    if method == "timescale":
        return replace(v, long_name=f"{v.long_name} timescale", standard_units="days")
    if method in ("autocorr", "corr"):
        return replace(v, long_name=f"{v.long_name} autocorrelation", standard_units="")
    if method in ("int", "integral"):
        base = u.parse(v.standard_units)
        for units in ("PW", "ZJ", "TN", "MJ m^-2", "W m^-2"):
            for measure in ("m2", "m", "kg m-2", "kg"):
                if (base * u.parse(measure)).alike(u.parse(units)):
                    return replace(v, long_name=f"integrated {v.long_name}", standard_units=units)
        raise ValueError(f"no standard units for the integral of {v.name!r} over {dim}")
    prefix = {"avg": "mean", "mean": "mean", "anom": "anomalous", "max": "maximum", "min": "minimum", "absmax": "maximum", "absmin": "minimum"}.get(method)
    return replace(v, long_name=f"{prefix} {v.long_name}") if prefix else v


class Registry:
    """Variables by any of their names."""

    def __init__(self):
        self._items: dict[str, Variable] = {}

    def define(self, name: str, long_name: str = "", standard_units: str = "", aliases: tuple[str, ...] = (), parent: str | None = None, **more) -> Variable:
        base = self.get(parent) if parent else None
        v = base.child(name, long_name, standard_units or None, aliases=aliases, **more) if base else Variable(name, long_name or name.replace("_", " "), standard_units, aliases=tuple(aliases), **more)
        return self.add(v)

    def add(self, v: Variable, override: bool = False) -> Variable:
        taken = [n for n in v.identifiers if n in self._items and not override]
        if taken:
            raise ValueError(f"already defined: {taken}")
        self._items |= dict.fromkeys(v.identifiers, v)
        return v

    def alias(self, name: str, *more: str) -> Variable:
        v = self.get(name)
        v = replace(v, aliases=(*v.aliases, *more))
        return self.add(v, override=True)

    def undefine(self, name: str) -> None:
        for n in self.get(name).identifiers:
            self._items.pop(n, None)

    def get(self, name: str) -> Variable:
        if name not in self._items:
            raise KeyError(name)
        return self._items[name]

    __getitem__ = get

    def __call__(self, name: str, **methods) -> Variable:
        return self.get(name).modify(**methods)

    def __contains__(self, name: str) -> bool:
        return name in self._items

    def __iter__(self):
        return iter(dict.fromkeys(self._items.values()))

    def frame(self, spark):
        """The registry as a small DataFrame."""
        return spark.createDataFrame([(v.name, v.long_name, v.standard_units, list(v.aliases)) for v in self], "name string, long_name string, standard_units string, aliases array<string>")


_DEFAULTS = (
    ("longitude", "longitude", "degE", ("lon",)), ("latitude", "latitude", "degN", ("lat",)), ("cell_width", "cell width", "km", ("width",)),
    ("cell_depth", "cell depth", "km", ("depth",)), ("cell_height", "cell height", "kg m^-2", ("height_mass",)), ("cell_duration", "cell duration", "days", ("duration",)),
    ("cell_area", "cell area", "km^2", ("area",)), ("cell_volume", "cell volume", "kg", ("volume",)),
    ("meridional_coordinate", "", "km", ()), ("cosine_latitude", "", "", ()), ("coriolis_parameter", "Coriolis parameter", "s^-1", ()), ("beta_parameter", "", "m^-1 s^-1", ()),
    ("reference_height", "", "km", ()), ("reference_density", "", "kg m^-3", ()), ("reference_potential_temperature", "", "K", ()),
    ("energy", "", "MJ m^-2 100hPa^-1", ()), ("energy_flux", "vertical energy flux", "W m^-2 100hPa^-1", ()), ("meridional_energy_flux", "", "MJ m^-2 100hPa^-1 m s^-1", ()),
    ("momentum", "", "m s^-1", ()), ("meridional_momentum_flux", "", "m^2 s^-2", ()), ("acceleration", "", "m s^-1 day^-1", ()), ("temperature", "", "K", ("t", "temp")),
    ("pressure", "", "hPa", ("pres",)), ("potential_temperature", "", "K", ("pot_temp",)),
)


def define_defaults(registry: Registry) -> None:
    for name, long_name, units, aliases in _DEFAULTS:
        registry.define(name, long_name, units, aliases)


variables = Registry()
define_defaults(variables)
