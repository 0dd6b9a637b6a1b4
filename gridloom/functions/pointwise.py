"""Point-wise functions with their derivatives, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def _sinc(v: Column) -> Column:
    return F.when(v == 0, 1.0).otherwise(F.sin(F.pi() * v) / F.when(v == 0, 1.0).otherwise(F.pi() * v))


def _softplus(v: Column) -> Column:
    return F.when(v > 33, v).when(v < -33, 0.0).otherwise(F.log1p(F.exp(F.greatest(F.least(v, F.lit(33.0)), F.lit(-33.0)))))


def _over(a: Column, v: Column) -> Column:
    """a / v with the limits of IEEE division."""
    return F.when(v != 0, a / F.when(v != 0, v)).when(a > 0, INF).when(a < 0, -INF).otherwise(NAN)


def _log(v: Column, f=F.ln) -> Column:
    return F.when(v == 0, -INF).when(v < 0, NAN).otherwise(f(v))


#: name -> (value, derivative)
TABLE = {
    "sqrt": (F.sqrt, lambda v: _over(F.lit(0.5), F.sqrt(v))),
    "sin": (F.sin, F.cos),
    "cos": (F.cos, lambda v: -F.sin(v)),
    "tan": (F.tan, lambda v: 1 / F.pow(F.cos(v), 2)),
    "sinc": (_sinc, lambda v: F.when(v == 0, 0.0).otherwise((F.cos(F.pi() * v) - _sinc(v)) / F.when(v == 0, 1.0).otherwise(v))),
    "exp": (F.exp, F.exp),
    "expm1": (F.expm1, F.exp),
    "log": (_log, lambda v: _over(F.lit(1.0), v)),
    "log10": (lambda v: _log(v, F.log10), lambda v: _over(F.lit(1 / math.log(10)), v)),
    "log1p": (lambda v: F.when(v == -1, -INF).when(v < -1, NAN).otherwise(F.log1p(v)), lambda v: _over(F.lit(1.0), 1 + v)),
    "sinh": (F.sinh, F.cosh),
    "cosh": (F.cosh, F.sinh),
    "tanh": (F.tanh, lambda v: 1 - F.pow(F.tanh(v), 2)),
    "sigmoid": (lambda v: 0.5 + 0.5 * F.tanh(v), lambda v: 0.5 - 0.5 * F.pow(F.tanh(v), 2)),
    "reciprocal": (lambda v: _over(F.lit(1.0), v), lambda v: -_over(F.lit(1.0), v * v)),
    "abs": (F.abs, lambda v: F.when(v == 0, NAN).otherwise(F.sign(v))),
    "absolute": (F.abs, lambda v: F.when(v == 0, NAN).otherwise(F.sign(v))),
    "sign": (F.sign, lambda v: F.when(v == 0, NAN).otherwise(0.0)),
    "power": (lambda v, p: F.pow(v, F.lit(float(p))), lambda v, p: p * F.pow(v, F.lit(p - 1.0))),
    "clip": (lambda v, lo, hi: F.when(F.isnan(v), v).when(v.isNotNull(), F.greatest(F.least(v, F.lit(hi)), F.lit(lo))), lambda v, lo, hi: F.when((v > lo) & (v < hi), 1.0).otherwise(0.0)),
    "softplus": (_softplus, lambda v: 1 / (1 + F.exp(-v))),
    "exponentiate": (lambda v, base: F.pow(F.lit(float(base)), v), lambda v, base: math.log(base) * F.pow(F.lit(float(base)), v)),
    "arctan": (F.atan, lambda v: 1 / (1 + v * v)),
    "unitstep": (lambda v: F.when(v.isNull(), None).when((v >= 0) & ~F.isnan(v), 1.0).otherwise(0.0), lambda v: F.lit(0.0)),
}


def ptw(name: str, v: Column, *args: float) -> Column:
    """The function's value."""
    return TABLE[name][0](v, *args)


def ptw_derivative(name: str, v: Column, *args: float) -> Column:
    return TABLE[name][1](v, *args)


def lognormal_moments(mean: float, std: float) -> tuple[float, float]:
    """Mean and deviation of the logarithm of a log-normal variable with the given mean and deviation."""
    log_var = math.log1p((std / mean) ** 2)
    return math.log(mean) - log_var / 2, math.sqrt(log_var)


def normal(xi: Column, mean: float, std: float) -> Column:
    return mean + std * xi


def lognormal(xi: Column, mean: float, std: float) -> Column:
    m, s = lognormal_moments(mean, std)
    return F.exp(m + s * xi)


def _inner(x: Column) -> Column:
    """Phi(x) - 1/2 over the normal density, by its series; exact to rounding below 2. A fold, so that the plan stays small."""
    return x * F.aggregate(F.sequence(F.lit(40), F.lit(1), F.lit(-1)), F.lit(1.0), lambda acc, k: 1 + x * x / (2 * k + 1) * acc)


def _mills(x: Column) -> Column:
    """The normal density over its upper tail, by its continued fraction; exact to rounding from 2 on."""
    return F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / acc)


_EDGE = 2.0


def log_tail(x: Column) -> Column:
    """Logarithm of the chance that a standard normal number exceeds x >= 0; no underflow."""
    density = -x * x / 2 - 0.5 * math.log(2 * math.pi)
    near, far = F.least(x, F.lit(_EDGE)), F.greatest(x, F.lit(_EDGE))
    return F.when(x < _EDGE, F.ln(0.5 - F.exp(-near * near / 2) / math.sqrt(2 * math.pi) * _inner(near))).otherwise(density - F.ln(_mills(far)))


def normal_cdf(xi: Column) -> Column:
    """The normal law, relatively exact in the lower tail."""
    near = F.greatest(F.least(xi, F.lit(_EDGE)), F.lit(-_EDGE))
    inner = 0.5 + F.exp(-near * near / 2) / math.sqrt(2 * math.pi) * _inner(near)
    tail = F.exp(log_tail(F.abs(xi)))
    return F.when(F.abs(xi) < 1, inner).when(xi > 0, 1 - tail).otherwise(tail)


def uniform(xi: Column, low: float, high: float) -> Column:
    """Standard normal to uniform."""
    return low + (high - low) * normal_cdf(xi)


def laplace(xi: Column, alpha: float, loc: float = 0.0) -> Column:
    """Standard normal to Laplace of scale alpha, by the logarithm of the tail on either side."""
    return loc - alpha * F.signum(xi) * (math.log(2) + log_tail(F.abs(xi)))


def normal_inverse(v: Column, mean: float, std: float) -> Column:
    return (v - mean) / std


def lognormal_inverse(v: Column, mean: float, std: float) -> Column:
    m, s = lognormal_moments(mean, std)
    return (F.ln(v) - m) / s


def table_interpolate(x: Column, low: float, high: float, values: list[float]) -> Column:
    """Linear interpolation of a table of values at equal steps from low to high; beyond it the end values.

    The table is one constant array in the plan.
    """
    table = F.expr("cast(split('" + ",".join(map(repr, map(float, values))) + "', ',') as array<double>)")
    at = F.greatest(F.least((x - low) / (high - low) * (len(values) - 1), F.lit(float(len(values) - 1))), F.lit(0.0))
    k = F.least(F.floor(at), F.lit(len(values) - 2)).cast("int")
    w = at - k
    return F.when(x.isNotNull() & ~F.isnan(x), F.element_at(table, k + 1) * (1 - w) + F.element_at(table, k + 2) * w).otherwise(x)


def monotone_inverse(y: Column, low: float, high: float, values: list[float]) -> Column:
    """The x of an increasing table at y, linear between its steps."""
    table = F.expr("cast(split('" + ",".join(map(repr, map(float, values))) + "', ',') as array<double>)")
    k = F.greatest(F.lit(1), F.least(F.size(F.filter(table, lambda t: t <= y)), F.lit(len(values) - 1)))
    a, b = F.element_at(table, k), F.element_at(table, k + 1)
    at = k - 1 + F.greatest(F.lit(0.0), F.least((y - a) / (b - a), F.lit(1.0)))
    return low + (high - low) * at / (len(values) - 1)


def _gamma_series(a: float, x: float) -> tuple[float, float]:
    """Logarithms of the regularised lower and upper incomplete gamma function."""
    front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        low = front + math.log(total)
        return low, math.log(-math.expm1(low)) if low < 0 else -INF
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    high = front + math.log(h)
    return (math.log(-math.expm1(high)) if high < 0 else -INF), high


def _tails(x: float) -> tuple[float, float]:
    """Logarithms of the lower and upper tail of the normal law."""
    upper = math.log(math.erfc(x / math.sqrt(2)) / 2) if x < 37 else -x * x / 2 - math.log(x * math.sqrt(2 * math.pi))
    lower = math.log(math.erfc(-x / math.sqrt(2)) / 2) if x > -37 else -x * x / 2 - math.log(-x * math.sqrt(2 * math.pi))
    return lower, upper


def gamma_quantile_log(a: float, xi: float, upper: bool = False) -> float:
    """Logarithm of the value of a gamma variable of shape a whose lower (or upper) tail is the normal law's at xi, by bisection."""
    lo, hi = -745.0 / min(a, 1.0), math.log(a + 1) + 7
    want_low, want_high = _tails(xi)
    if upper:
        want_low, want_high = want_high, want_low
    for _ in range(200):
        mid = (lo + hi) / 2
        low, high = _gamma_series(a, math.exp(mid)) if mid > -700 else (a * mid - math.lgamma(a + 1), 0.0)
        below = low < want_low if want_low < want_high else high > want_high
        lo, hi = (mid, hi) if below else (lo, mid)
        if hi - lo < 1e-15 * max(1.0, abs(mid)):
            break
    return (lo + hi) / 2


SPAN = 8.2


def _table(f, step: float) -> list[float]:
    n = math.ceil(2 * SPAN / step) + 1
    return [f(-SPAN + 2 * SPAN * k / (n - 1)) for k in range(n)]


def inverse_gamma(xi: Column, a: float, scale: float, loc: float = 0.0, step: float = 0.01) -> Column:
    """Standard normal to inverse gamma, by a table of logarithms. A value's lower tail is the gamma variable's upper one."""
    return loc + scale * F.exp(table_interpolate(xi, -SPAN, SPAN, _table(lambda x: -gamma_quantile_log(a, x, upper=True), step)))


def inverse_gamma_inverse(v: Column, a: float, scale: float, loc: float = 0.0, step: float = 0.01) -> Column:
    return monotone_inverse(F.ln((v - loc) / scale), -SPAN, SPAN, _table(lambda x: -gamma_quantile_log(a, x, upper=True), step))


def inverse_gamma_from_mode(mode: float, mean: float) -> tuple[float, float]:
    """Shape and scale of the inverse gamma law of this mode and mean."""
    a = 2 / (mean / mode - 1) + 1
    return a, mode * (a + 1)


def log_inverse_gamma(xi: Column, a: float, scale: float, step: float = 0.01) -> Column:
    return math.log(scale) + table_interpolate(xi, -SPAN, SPAN, _table(lambda x: -gamma_quantile_log(a, x, upper=True), step))


def gamma(xi: Column, a: float, theta: float, step: float = 0.01) -> Column:
    """Standard normal to gamma of shape a and scale theta."""
    return theta * F.exp(table_interpolate(xi, -SPAN, SPAN, _table(lambda x: gamma_quantile_log(a, x), step)))


def gamma_from_moments(mean: float, var: float) -> tuple[float, float]:
    """Shape and scale of the gamma law of this mean and variance."""
    return mean * mean / var, var / mean


def beta(xi: Column, a: float, b: float, step: float = 0.01) -> Column:
    """Standard normal to beta(a, b), by a table of log-odds."""

    def log_odds(x: float) -> float:
        want, _ = _tails(x)
        lo, hi = -60.0, 60.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _log_beta_cdf(a, b, mid) < want else (lo, mid)
        return (lo + hi) / 2

    z = table_interpolate(xi, -SPAN, SPAN, _table(log_odds, step))
    return 1 / (1 + F.exp(-z))


def _log_beta_cdf(a: float, b: float, odds: float) -> float:
    """Logarithm of the regularised incomplete beta function at the logistic of `odds`, by its continued fraction."""
    x, y = 1 / (1 + math.exp(-odds)), 1 / (1 + math.exp(odds))
    if x > (a + 1) / (a + b + 2):
        other = _log_beta_cdf(b, a, -odds)
        return math.log1p(-math.exp(other)) if other < -1e-300 else -INF
    log_x, log_y = -math.log1p(math.exp(-odds)), -math.log1p(math.exp(odds))
    front = a * log_x + b * log_y - math.log(a) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 500):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + an * d or tiny)
            c = 1 + an / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front + math.log(h)
