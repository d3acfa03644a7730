"""Special functions as plain Spark columns (no UDF, inside codegen)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published rational approximations of the error function (W. J. Cody, 1969), numerators and
# denominators, lowest power first.  erf(x)/x in x^2 up to 0.46875, exp(x^2) erfc(x) in x up to 4, and beyond
# it the defect of x exp(x^2) erfc(x) from 1/sqrt(pi), times x^2, in 1/x^2.
ERF_CORE = (
    (3.20937758913846947e03, 3.77485237685302021e02, 1.13864154151050156e02, 3.16112374387056560e00, 1.85777706184603153e-1),
    (2.84423683343917062e03, 1.28261652607737228e03, 2.44024637934444173e02, 2.36012909523441209e01, 1.0),
)
ERFC_MIDDLE = (
    (
        1.23033935479799725e03, 2.05107837782607147e03, 1.71204761263407058e03, 8.81952221241769090e02, 2.98635138197400131e02,
        6.61191906371416295e01, 8.88314979438837594e00, 5.64188496988670089e-1, 2.15311535474403846e-8,
    ),
    (
        1.23033935480374942e03, 3.43936767414372164e03, 4.36261909014324716e03, 3.29079923573345963e03, 1.62138957456669019e03,
        5.37181101862009858e02, 1.17693950891312499e02, 1.57449261107098347e01, 1.0,
    ),
)
ERFC_FAR = (
    (6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1, 3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2),
    (2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1, 1.87295284992346047e00, 2.56852019228982242e00, 1.0),
)
ERF_CORE_END, ERFC_MIDDLE_END = 0.46875, 4.0


def _polynomial(coefficients: tuple[float, ...], u: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = F.lit(c) + u * out
    return out


def _ratio(table: tuple[tuple[float, ...], tuple[float, ...]], u: Column) -> Column:
    above, below = (_polynomial(c, u) for c in table)
    # denominators are at least their first coefficient; coalesce only tells Spark that the ratio is never null
    return F.coalesce(F.try_divide(above, below), F.lit(0.0))


def erf_core(x: Column) -> Column:
    """The error function for |x| up to 0.46875."""
    return x * _ratio(ERF_CORE, x * x)


def erfc_scaled(y: Column) -> Column:
    """exp(y^2) erfc(y) for y from 0.46875 to 4."""
    return _ratio(ERFC_MIDDLE, y)


def gauss(x: Column) -> Column:
    """exp(-x^2) to the last digits: the square of the leading bits of x is exact."""
    lead = F.floor(x * 16.0) / 16.0
    return F.exp(-lead * lead) * F.exp(-(x - lead) * (x + lead))


def erfc(x: Column) -> Column:
    """Complementary error function, to a relative error of about 1e-15 while it is a normal number."""
    y = F.abs(x)
    per = F.coalesce(F.try_divide(F.lit(1.0), y), F.lit(0.0))
    far = (F.lit(1.0 / math.sqrt(math.pi)) - per * per * _ratio(ERFC_FAR, per * per)) * per
    tail = gauss(y) * F.when(y <= ERFC_MIDDLE_END, erfc_scaled(y)).otherwise(far)
    tail = F.when(y < 30.0, tail).otherwise(F.when(y.isNull() | F.isnan(y), y).otherwise(0.0))
    return F.when(y <= ERF_CORE_END, F.lit(1.0) - erf_core(x)).otherwise(F.when(x >= 0.0, tail).otherwise(F.lit(2.0) - tail))


def sech2(x: Column) -> Column:
    """1/cosh(x)^2, written as 1 - tanh(x)^2, which cannot overflow."""
    t = F.tanh(x)
    return F.lit(1.0) - t * t


def ln_cosh(x: Column) -> Column:
    """ln(cosh(x)) without overflow."""
    u = F.abs(x)
    # the logarithm is of a number in [1/2, 1]; coalesce only tells Spark it is never null
    return u + F.coalesce(F.log((F.exp(u * -2.0) + 1.0) * 0.5), F.lit(0.0))


def even_legendre(x: Column, lmax: int) -> list[tuple[Column, Column]]:
    """``[(P_l, dP_l/dx)]`` for l = 0, 2, ... lmax as explicit polynomials in x^2.

    The polynomial form has no division by 1 - x^2, so the derivative is also
    right on the axis.
    """
    if lmax < 0 or lmax % 2:
        raise ValueError("lmax must be even and non-negative")
    x2 = x * x
    out = []
    for l in range(0, lmax + 1, 2):
        # coefficient of x^(l-2k) in P_l
        coef = [
            (-1) ** k * math.comb(l, k) * math.comb(2 * l - 2 * k, l) / 2.0**l
            for k in range(l // 2 + 1)
        ]
        p: Column = F.lit(coef[0])
        for c in coef[1:]:
            p = p * x2 + c
        if l == 0:
            out.append((F.lit(1.0), F.lit(0.0)))
            continue
        d: Column = F.lit(coef[0] * l)
        for k, c in enumerate(coef[1:-1], start=1):
            d = d * x2 + c * (l - 2 * k)
        out.append((p, d * x))
    return out


def harmonic_norm(l: int) -> float:
    """Normalisation sqrt((2l+1)/4 pi) between P_l and the stored coefficients."""
    return math.sqrt((2 * l + 1) / (4.0 * math.pi))


def nfw_mass_shape(x: Column) -> Column:
    """ln(1+x) - x/(1+x): enclosed NFW mass per unit mass scale at x = r/a."""
    return F.log(x + 1.0) - x / (x + 1.0)


def all_finite(c: Column) -> Column:
    """True when neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
