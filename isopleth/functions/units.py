"""Unit algebra: seven base dimensions, a scale and an offset.

Conversions are linear and known when a plan is built, so that they become a
literal multiplication and addition that Catalyst folds.
"""

from __future__ import annotations

import itertools
import math
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, functions as F

BASE = ("m", "kg", "s", "K", "mol", "A", "cd")
_NONE = (0,) * 7


@dataclass(frozen=True)
class Unit:
    """``value in SI = value * scale + offset``; ``text`` is how it is written."""

    scale: float = 1.0
    powers: tuple[int, ...] = _NONE
    offset: float = 0.0
    text: str = ""

    def __mul__(self, other: Unit) -> Unit:
        return Unit(self.scale * other.scale, tuple(a + b for a, b in zip(self.powers, other.powers, strict=True)), 0.0, " ".join(x for x in (self.text, other.text) if x))

    def __pow__(self, n: int) -> Unit:
        return Unit(self.scale**n, tuple(a * n for a in self.powers), 0.0, " ".join(_raised(t, n) for t in self.text.split()))

    def __truediv__(self, other: Unit) -> Unit:
        return self * other**-1

    def alike(self, other: Unit) -> bool:
        return self.powers == other.powers


def _raised(token: str, n: int) -> str:
    m = re.fullmatch(r"(.*?[^\d^-])\^?(-?\d+)?", token)
    name, power = (m[1], int(m[2] or 1) * n) if m else (token, n)
    return name if power == 1 else f"{name}^{power}"


def _unit(scale: float, **powers: int) -> Unit:
    return Unit(scale, tuple(powers.get(b, 0) for b in BASE))


_KNOWN: dict[str, Unit] = {b: _unit(1.0, **{b: 1}) for b in BASE}
_PREFIXES = {"": 1.0, "n": 1e-9, "u": 1e-6, "µ": 1e-6, "m": 1e-3, "c": 1e-2, "d": 1e-1, "h": 1e2, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15, "Z": 1e21}
_PREFIXED = {
    "m": _KNOWN["m"], "g": _unit(1e-3, kg=1), "s": _KNOWN["s"], "mol": _KNOWN["mol"], "Pa": _unit(1.0, kg=1, m=-1, s=-2), "N": _unit(1.0, kg=1, m=1, s=-2),
    "J": _unit(1.0, kg=1, m=2, s=-2), "W": _unit(1.0, kg=1, m=2, s=-3), "Hz": _unit(1.0, s=-1), "bar": _unit(1e5, kg=1, m=-1, s=-2), "A": _KNOWN["A"], "K": _KNOWN["K"],
}
for _p, _s in _PREFIXES.items():
    for _n, _u in _PREFIXED.items():
        _KNOWN.setdefault(_p + _n, Unit(_u.scale * _s, _u.powers))


def _define(names: str, unit: Unit) -> None:
    for name in names.split():
        _KNOWN[name] = unit


_ONE = Unit()
_define("none level layer sigma_level dimensionless 1 rad radian radians", _ONE)
_define("percent", Unit(0.01))
_define("permille", Unit(0.001))
_define("min minute minutes", _unit(60.0, s=1))
_define("h hr hour hours", _unit(3600.0, s=1))
_define("day days d", _unit(86400.0, s=1))
_define("second seconds sec", _unit(1.0, s=1))
_define("week weeks", _unit(7 * 86400.0, s=1))
_define("year years yr", _unit(365.25 * 86400.0, s=1))
_define("month months", _unit(365.25 * 86400.0 / 12, s=1))
_define("meter metre meters metres gpm geopotential_meter geopotential_metre", _KNOWN["m"])
_define("b", _KNOWN["bar"])
_define("mb mbar millibar", _unit(100.0, kg=1, m=-1, s=-2))
_define("inHg inchHg inchesHg in_Hg inch_Hg inches_Hg inch_mercury inches_mercury", _unit(3386.389, kg=1, m=-1, s=-2))
_define("VU vorticity_unit", _unit(1e-5, s=-1))
_define("PVU potential_vorticity_unit", _unit(1e-6, K=1, m=2, s=-1, kg=-1))
_degree = Unit(math.pi / 180)
_define("° deg degree degrees arcdeg arcdegree angular_degree", _degree)
_define("′ arcmin arcminute arc_minute angular_minute", Unit(math.pi / 180 / 60))
_define("″ arcsec arcsecond arc_second angular_second", Unit(math.pi / 180 / 3600))
LONGITUDE, LATITUDE = (
    {f"{d}{u}{x}" for d, u, x in itertools.product(("deg", "degree", "degrees"), ("", "_"), names)} | {f"°{names[0]}"} for names in (("E", "East", "east"), ("N", "North", "north"))
)
_define(" ".join(LONGITUDE | LATITUDE), _degree)
_forms = lambda *letters: " ".join(f"{d}{u}{x}" for d, u, x in itertools.product(("deg", "degree", "degrees"), ("", "_"), letters))
_define("kelvin Kelvin k " + _forms("K", "k", "kelvin", "Kelvin"), _KNOWN["K"])
_define("celsius Celsius °C " + _forms("C", "c", "Celsius", "celsius"), Unit(1.0, _KNOWN["K"].powers, 273.15))
_define("fahrenheit Fahrenheit °F " + _forms("F", "f", "Fahrenheit", "fahrenheit"), Unit(5 / 9, _KNOWN["K"].powers, 459.67 * 5 / 9))


def define(name: str, scale: float, unit: str) -> None:
    """Register ``name`` as ``scale`` times ``unit``."""
    u = parse(unit)
    _KNOWN[name] = Unit(u.scale * scale, u.powers)
    parse.cache_clear()


@lru_cache(maxsize=None)
def parse(text: str | None) -> Unit:
    """Decode a unit string: ``m2``, ``kg^-1``, ``100hPa``, ``days since 2000-01-01``,
    ``%``; everything after the first slash is in the denominator."""
    plain = (text or "").replace("%%", " permille ").replace("%", " percent ").replace("**", "^").replace("*", " ").strip()
    plain = re.sub(r"\s+since\s.*$", "", plain)
    above, _, below = plain.partition("/")
    unit = Unit()
    for part, sign in ((above, 1), (below.replace("/", " "), -1)):
        for token in part.split():
            unit = _times(unit, token, sign)
    if len(plain.split()) == 1 and plain in _KNOWN:
        unit = _KNOWN[plain]
    return Unit(unit.scale, unit.powers, unit.offset, plain)


def _times(unit: Unit, token: str, sign: int) -> Unit:
    if token in _KNOWN:
        return unit * _KNOWN[token] ** sign
    if re.fullmatch(r"[\d.]+(e[+-]?\d+)?", token):
        return unit * Unit(float(token)) ** sign
    m = re.fullmatch(r"(\d+(?:\.\d+)?(?:e[+-]?\d+)?)?([^\d\s^-][^\d\s^-]*)\^?(-?\d+)?", token)
    if not m or m[2] not in _KNOWN:
        raise ValueError(f"unknown unit {token!r}")
    piece = _KNOWN[m[2]]
    if m[1]:
        piece = Unit(piece.scale * float(m[1]), piece.powers)
    return unit * piece ** (int(m[3] or 1) * sign)


def encode(unit: Unit | str) -> str:
    """A plain string: names with exponents, separated by blanks."""
    return (unit if isinstance(unit, str) else unit.text).strip()


def tex(text: str) -> str:
    """The string with TeX exponents, quotients as negative powers."""
    above, _, below = text.partition("/")
    tokens = above.split() + [_raised(t, -1) for t in below.replace("/", " ").split()]
    out = []
    for t in tokens:
        m = re.fullmatch(r"(.*?[^\d^-])\^?(-?\d+)?", t)
        out.append(rf"\mathrm{{{m[1]}}}^{{{m[2]}}}" if m and m[2] else rf"\mathrm{{{t}}}")
    return "$" + r"\,".join(out) + "$" if out else ""


_CONTEXT: dict[tuple[int, ...], float] = {}


def _contexts() -> dict[tuple[int, ...], float]:
    """Factors to energy per mass: length by g, temperature by cp, a pure ratio by Lv,
    each also per time or times velocity, and times area, mass or mass per area."""
    if not _CONTEXT:
        g, cp, lv = 9.80665, 1.0057e3, 2.501e6
        energy = parse("J kg-1").powers
        for rate, amount in itertools.product(("", "s-1", "m s-1"), ("", "m2", "kg", "kg m-2")):
            more = parse(f"{rate} {amount}").powers
            plus = lambda p: tuple(a + b for a, b in zip(p, more, strict=True))  # noqa: B023, E731
            for source, factor in (("m", g), ("K", cp), ("", lv)):
                _CONTEXT.setdefault((*plus(parse(source).powers), *plus(energy)), factor)
    return _CONTEXT


def factors(source: str | Unit, dest: str | Unit, context: bool = False) -> tuple[float, float]:
    """(scale, offset) with ``dest value = source value * scale + offset``."""
    a, b = (parse(x) if isinstance(x, str) else x for x in (source, dest))
    if a.alike(b):
        return a.scale / b.scale, (a.offset - b.offset) / b.scale
    if context:
        table = _contexts()
        if f := table.get((*a.powers, *b.powers)):
            return a.scale * f / b.scale, 0.0
        if f := table.get((*b.powers, *a.powers)):
            return a.scale / f / b.scale, 0.0
    raise ValueError(f"cannot convert {a.text!r} to {b.text!r}")


def convert(column: Column, source: str, dest: str, context: bool = False) -> Column:
    """``column`` in other units."""
    scale, offset = factors(source, dest, context)
    out = column if scale == 1 else column * F.lit(scale)
    return out if offset == 0 else out + F.lit(offset)


def compact(source: str, magnitude: float) -> str:
    """The unit with the prefix that brings ``magnitude`` between 1 and 1000."""
    m = re.match(r"(\S+)(.*)", source)
    bare = next((n for n in sorted(_PREFIXED, key=len, reverse=True) if m and m[1].endswith(n) and m[1][: -len(n)] in _PREFIXES), None)
    if not bare or not magnitude:
        return source
    now = _PREFIXES[m[1][: -len(bare)]]
    prefixes = {p: s for p, s in _PREFIXES.items() if p in ("", "n", "u", "m", "k", "M", "G", "T", "P") and p + bare in _KNOWN}
    fits = [p for p, s in prefixes.items() if 1 <= abs(magnitude) * now / s < 1000]
    return (fits[0] + bare if fits else m[1]) + m[2]


@dataclass(frozen=True)
class Quantity:
    """A number with units: a limit, a label, a width or a value to be assigned."""

    value: float
    units: str = ""

    def to(self, units: str, context: bool = False) -> Quantity:
        scale, offset = factors(self.units, units, context)
        return Quantity(self.value * scale + offset, units)
