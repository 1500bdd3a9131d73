"""Arithmetic: IEEE division, floored modulus, guarded logarithms and the usual functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.compare import as_col

INF, NAN = float("inf"), float("nan")


def plus(a, b) -> Column:
    return as_col(a) + as_col(b)


def minus(a, b) -> Column:
    return as_col(a) - as_col(b)


def times(a, b) -> Column:
    return as_col(a) * as_col(b)


add, subtract = plus, minus


def divide(a, b) -> Column:
    """Always a double: x/0 is an infinity of x's sign, 0/0 is NaN; null gives null."""
    x, y = as_col(a).cast("double"), as_col(b).cast("double")
    return F.when(y != 0, x / y).when(y.isNull(), None).when(x > 0, INF).when(x < 0, -INF).when(x == 0, NAN)


def mod(a, b) -> Column:
    """Floored modulus: the result has the sign of ``b``; null where ``b`` is 0."""
    x, y = as_col(a), as_col(b)
    return F.when(y != 0, ((x % y) + y) % y)


def negate(x) -> Column:
    return -as_col(x)


negative = negate


def absolute(x) -> Column:
    return F.abs(as_col(x))


def exp(x, y=None) -> Column:
    """e to the x, or x to the y."""
    return F.exp(as_col(x)) if y is None else F.pow(as_col(x), as_col(y))


power = exp


def sqrt(x) -> Column:
    return F.sqrt(as_col(x).cast("double"))


def _guarded(x: Column, f) -> Column:
    x = x.cast("double")
    return F.when(x == 0, -INF).when(x < 0, NAN).otherwise(f(x))


def ln(x) -> Column:
    """Natural logarithm; of 0 minus infinity, of negative numbers NaN."""
    return _guarded(as_col(x), F.ln)


def log(x, y=None) -> Column:
    """Decimal logarithm of x, or logarithm of y to base x."""
    return _guarded(as_col(x), F.log10) if y is None else divide(ln(y), ln(x))


def lg(x) -> Column:
    return _guarded(as_col(x), F.log2)


def floor(x) -> Column:
    return F.floor(as_col(x))


def ceil(x) -> Column:
    return F.ceil(as_col(x))


def _unary(f):
    def run(x) -> Column:
        return f(as_col(x).cast("double"))

    run.__name__ = f.__name__
    return run


sin, cos, tan, asin, acos, atan, sinh, cosh, tanh = map(_unary, (F.sin, F.cos, F.tan, F.asin, F.acos, F.atan, F.sinh, F.cosh, F.tanh))


# Coefficients of the published rational approximations of the error function to double
# precision (Cody 1969): below 0.46875 of erf, up to 4 and beyond of erfc.
ERF_NEAR = (3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3, 1.85777706184603153e-1), (2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
ERF_MIDDLE = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3, 2.15311535474403846e-8), (1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
ERF_FAR = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2), (2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _ratio(coefficients, z: Column) -> Column:
    above, below = coefficients
    top, bottom = F.lit(above[-1]) * z, z
    for a, b in zip(above[:-2], below[:-1]):
        top, bottom = (top + a) * z, (bottom + b) * z
    return (top + above[-2]) / (bottom + below[-1])


def _erfc_beyond(x: Column) -> Column:
    """erfc of numbers from 0.46875 on."""
    z = 1 / (x * x)
    far = (F.lit(0.5641895835477563) - z * _ratio(ERF_FAR, z)) / x
    cut = F.floor(x * 16) / 16  # exp(-x*x) without losing digits of x*x
    return F.exp(-cut * cut) * F.exp(-(x - cut) * (x + cut)) * F.when(x <= 4, _ratio(ERF_MIDDLE, x)).otherwise(far)


def erf(x) -> Column:
    """Error function to double precision, as a plain expression."""
    x = as_col(x).cast("double")
    a = F.abs(x)
    return F.when(F.isnan(x), x).when(a < 0.46875, x * _ratio(ERF_NEAR, x * x)).when(a < 27, F.signum(x) * (1 - _erfc_beyond(a))).otherwise(F.signum(x))


def erfc(x) -> Column:
    """Complementary error function to double precision, also where it is tiny."""
    x = as_col(x).cast("double")
    a = F.abs(x)
    return F.when(F.isnan(x), x).when(a < 0.46875, 1 - x * _ratio(ERF_NEAR, x * x)).when(x >= 27, F.lit(0.0)).when(x <= -27, F.lit(2.0)).when(x > 0, _erfc_beyond(a)).otherwise(2 - _erfc_beyond(a))
