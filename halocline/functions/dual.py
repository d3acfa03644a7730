"""Columns that carry their derivatives: a model written once gives its value and its gradient."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = "Dual | Column | float"


class Dual:
    """A column and its derivatives by name; what isn't named has derivative zero.

    Numbers mix in as constants on either side, and plain columns on the right; :func:`col` names a column as a constant for any place
    (a column on the left would take the operator for itself).
    """

    def __init__(self, value: Column | float, slopes: Mapping[str, Column] | None = None):
        self.value = value if isinstance(value, Column) else F.lit(float(value))
        self.slopes = dict(slopes or {})

    @classmethod
    def of(cls, x: Number) -> Dual:
        return x if isinstance(x, cls) else cls(x)

    def _map(self, value: Column, factor: Column) -> Dual:
        return Dual(value, {n: s * factor for n, s in self.slopes.items()})

    def _sum(self, other: Dual, value: Column, mine: Column | None, theirs: Column | None) -> Dual:
        slopes = {}
        for n in {**self.slopes, **other.slopes}:
            terms = [s[n] if f is None else s[n] * f for s, f in ((self.slopes, mine), (other.slopes, theirs)) if n in s]
            slopes[n] = terms[0] if len(terms) == 1 else terms[0] + terms[1]
        return Dual(value, slopes)

    def __add__(self, other: Number) -> Dual:
        other = Dual.of(other)
        return self._sum(other, self.value + other.value, None, None)

    def __sub__(self, other: Number) -> Dual:
        other = Dual.of(other)
        return self._sum(other, self.value - other.value, None, F.lit(-1.0))

    def __mul__(self, other: Number) -> Dual:
        other = Dual.of(other)
        return self._sum(other, self.value * other.value, other.value, self.value)

    def __truediv__(self, other: Number) -> Dual:
        other = Dual.of(other)
        value = self.value / other.value
        return self._sum(other, value, F.lit(1.0) / other.value, -value / other.value)

    def __pow__(self, power: float) -> Dual:
        return self._map(F.pow(self.value, F.lit(float(power))), F.pow(self.value, F.lit(power - 1.0)) * power)

    def __neg__(self) -> Dual:
        return self * -1.0

    __radd__ = __add__
    __rmul__ = __mul__

    def __rsub__(self, other: Number) -> Dual:
        return Dual.of(other) - self

    def __rtruediv__(self, other: Number) -> Dual:
        return Dual.of(other) / self


def _lifted(value: Callable[[Column], Column], slope: Callable[[Column, Column], Column]) -> Callable[[Number], Dual]:
    """A function of a Dual from its value and its derivative, which may use the value."""

    def apply(x: Number) -> Dual:
        x = Dual.of(x)
        v = value(x.value)
        return x._map(v, slope(x.value, v))

    return apply


exp = _lifted(F.exp, lambda x, v: v)
log = _lifted(F.log, lambda x, v: F.lit(1.0) / x)
sqrt = _lifted(F.sqrt, lambda x, v: F.lit(0.5) / v)
sin = _lifted(F.sin, lambda x, v: F.cos(x))
cos = _lifted(F.cos, lambda x, v: -F.sin(x))
tanh = _lifted(F.tanh, lambda x, v: F.lit(1.0) - v * v)
atan = _lifted(F.atan, lambda x, v: F.lit(1.0) / (x * x + 1.0))


def col(name: str) -> Dual:
    """A column of the data, the same for all parameters."""
    return Dual(F.col(name))


def where(condition: Column, yes: Number, no: Number) -> Dual:
    """``yes`` where the condition holds, else ``no``, with the derivatives of the one taken."""
    yes, no = Dual.of(yes), Dual.of(no)
    zero = F.lit(0.0)
    slopes = {n: F.when(condition, yes.slopes.get(n, zero)).otherwise(no.slopes.get(n, zero)) for n in {**yes.slopes, **no.slopes}}
    return Dual(F.when(condition, yes.value).otherwise(no.value), slopes)

