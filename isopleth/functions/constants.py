"""Physical constants in SI units, as plain floats, with their units beside them."""

import math

from .units import Unit, parse

_VALUES: dict[str, tuple[float, str]] = {
    "G": (6.67408e-11, "m3 kg-1 s-2"),
    "H": (7.0e3, "m"),
    "Md": (28.9645e-3, "kg mol-1"),
    "Mw": (18.0153e-3, "kg mol-1"),
    "Na": (6.02214e23, "mol-1"),
    "Omega": (7.292115e-5, "rad s-1"),
    "R": (8.31446, "J mol-1 K-1"),
    "a": (6.3710088e6, "m"),
    "c": (2.99792458e8, "m s-1"),
    "cp": (1.0057e3, "J kg-1 K-1"),
    "cv": (0.719e3, "J kg-1 K-1"),
    "Lv": (2.501e6, "J kg-1"),
    "Lf": (3.371e5, "J kg-1"),
    "Ls": (2.834e6, "J kg-1"),
    "e": (math.e, ""),
    "g": (9.80665, "m s-2"),
    "h": (6.62607e-34, "J s"),
    "psfc": (101325.0, "Pa"),
    "p0": (1e5, "Pa"),
    "pi": (math.pi, ""),
    "tau": (2 * math.pi, ""),
}


def _derived() -> None:
    v = {k: x for k, (x, _) in _VALUES.items()}
    _VALUES["Rd"] = (v["R"] / v["Md"], "J kg-1 K-1")
    _VALUES["Rm"] = (v["R"] / v["Mw"], "J kg-1 K-1")
    _VALUES["kappa"] = (v["R"] / v["Md"] / v["cp"], "")
    _VALUES["kb"] = (v["R"] / v["Na"], "J K-1")
    kb = v["R"] / v["Na"]
    _VALUES["sigma"] = (2 * math.pi**5 * kb**4 / (15 * v["h"] ** 3 * v["c"] ** 2), "W m-2 K-4")


_derived()
globals().update({k: x for k, (x, _) in _VALUES.items()})
__all__ = sorted(_VALUES)


def unit_of(name: str) -> Unit:
    """The unit of a constant of this module."""
    return parse(_VALUES[name][1])
