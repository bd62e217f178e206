"""Scalar column functions: guarded arithmetic, bit tricks, Morton keys, coordinates, strings, physical constants."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of double precision: largest over ten, ten times the smallest normal, ten roundings.
LARGE = 0.1 * sys.float_info.max
SMALL = 10 * sys.float_info.min
EPS = 10 * sys.float_info.epsilon
#: Added to denominators of refinement criteria.
TINY = 1e-20


def make_positive(v: Column) -> Column:
    return F.greatest(v, F.lit(SMALL))


def make_bounded(v: Column, lo: Column | float, hi: Column | float) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return F.least(F.greatest(v, lo + EPS), hi * (1.0 - EPS))


def sgn(v: Column) -> Column:
    """Sign with sgn(0) = 1."""
    return F.when(v >= 0, 1.0).otherwise(-1.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b that no zero stops: the denominator is pushed away from 0 by the smallest normal numbers."""
    return a / (b + sgn(b) * SMALL)


def soft_equiv(value: Column, reference: Column, eps: float = EPS, pass_on_small: bool = True) -> Column:
    """Whether ``value`` is ``reference`` within a relative ``eps``, or both are negligible."""
    near = F.abs(value - reference) < eps * F.abs(reference)
    if not pass_on_small:
        return near
    return near | ((F.abs(value) < eps) & (F.abs(reference) < eps))


def trailing_zeros(n: Column) -> Column:
    """Number of trailing zero bits of a positive integer."""
    return F.bit_count(n.bitwiseAND(-n) - 1)


def max_power_of_2_divisor(n: Column) -> Column:
    return n.bitwiseAND(-n)


def floor_log2(n: Column) -> Column:
    """Floor of the binary logarithm of a positive integer, by the length of its binary form."""
    return F.char_length(F.bin(n)) - 1


def ceil_log2(n: Column) -> Column:
    return F.when(n.bitwiseAND(n - 1) == 0, floor_log2(n)).otherwise(floor_log2(n) + 1)


def ceil_div(a: Column, b: Column | int) -> Column:
    """Integer division rounded up, of non-negative integers."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.floor((a + b - 1) / b).cast("long")


def interleave(n: Column, gap: int, bits: int) -> Column:
    """The ``bits`` low bits of ``n`` with ``gap`` zeros between."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        bit = F.shiftright(n.cast("long"), i).bitwiseAND(F.lit(1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(bit, i * (gap + 1)))
    return out


def morton(x: Column, y: Column, z: Column | None = None, bits: int = 20) -> Column:
    """Z-order key: bits of x lowest; 20 bits an axis in 3-D, 30 in 2-D fit a long."""
    axes = [x, y] if z is None else [x, y, z]
    out = F.lit(0).cast("long")
    for i, axis in enumerate(axes):
        out = out.bitwiseOR(F.shiftleft(interleave(axis, len(axes) - 1, bits), i))
    return out


def centre(i: Column, lo: Column | float, dx: Column | float) -> Column:
    """Centre of cell i."""
    return lo + (i + 0.5) * dx


def face(i: Column, lo: Column | float, dx: Column | float) -> Column:
    """Lower face of cell i."""
    return lo + i * dx


def radius(*x: Column) -> Column:
    total = x[0] * x[0]
    for v in x[1:]:
        total = total + v * v
    return F.sqrt(total)


def product(*x: Column) -> Column:
    out = x[0]
    for v in x[1:]:
        out = out * v
    return out


def symmetrized(i: Column, n: Column | int, lo: float, hi: float) -> Column:
    """Position of edge i of n, equal in size on both sides of the middle of a symmetric domain."""
    n = n if isinstance(n, Column) else F.lit(n)
    x = (i - n / 2) / n
    return 0.5 * (lo + hi) + x * (hi - lo)


def trim(s: Column, side: str = "both", blanks: str = " \t\n\v\f\r") -> Column:
    cut = {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[side]
    return cut(s, F.lit(blanks))


def pack(strings: Column, delimiter: str) -> Column:
    return F.array_join(strings, delimiter)


def unpack(s: Column, delimiter: str) -> Column:
    """The fields of a string; a trailing delimiter adds none."""
    parts = F.split(s, F.lit("\\Q" + delimiter + "\\E"))
    return F.when(s.endswith(delimiter) | (s == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def hash_combine(*columns: Column) -> Column:
    """One key of several columns; equal inputs give equal keys."""
    return F.xxhash64(*columns)


@dataclass(frozen=True)
class Units:
    """A unit system by the size of SI's units in its own."""

    length: float = 1.0
    mass: float = 1.0
    time: float = 1.0
    temperature: float = 1.0
    current: float = 1.0
    charge: float = 1.0

    @property
    def energy(self) -> float:
        return self.mass * self.length**2 / self.time**2


SI = Units()
CGS = Units(length=1e2, mass=1e3, current=1e-1, charge=2.997924580e9)


def constants(units: Units = SI) -> dict[str, float]:
    """Physical constants in a unit system; CODATA 2010, fixed values."""
    u = units
    planck = 6.62606957e-34 * u.energy * u.time
    return {
        "avogadro": 6.02214129e23,
        "fine_structure": 7.2973525698e-3,
        "planck": planck,
        "reduced_planck": planck / (2 * math.pi),
        "gas_constant": 8.3144621 * u.energy / u.temperature,
        "boltzmann": 1.380648800e-23 * u.energy / u.temperature,
        "electron_charge": 1.602176565e-19 * u.charge,
        "speed_of_light": 2.99792458e8 * u.length / u.time,
        "acceleration_from_gravity": 9.80665 * u.length / u.time**2,
    }
