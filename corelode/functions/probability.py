"""Distribution functions: columns for data, plain numbers for one-row results."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Chebyshev fit of erfc (relative error below
# 1.2e-7), highest power first.
ERFC_FIT = [
    0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807,
    -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223,
]


def normal_upper(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    poly = F.lit(ERFC_FIT[0])
    for c in ERFC_FIT[1:]:
        poly = poly * t + c
    tail = t * F.exp(poly - x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def normal_cdf(z: Column) -> Column:
    return normal_upper(-z)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def student_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return regularized_beta(df / (df + t * t), df / 2, 0.5)


def log_gamma(z: Column) -> Column:
    """ln Γ(z) for z > 0 by Stirling's series, ten steps up."""
    y = z + 10
    f = 1 / (y * y)
    series = (1 / y) * (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f / 1680)))
    shifted = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series
    for i in range(10):
        shifted = shifted - F.ln(z + i)
    return shifted


# Steps of the continued fraction below; it settles in about the root of the larger parameter.
FRACTION_STEPS = 400


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of I_x(a, b), by Lentz's method over a fixed number of steps."""
    def step(state: Column, m: Column) -> Column:
        half = F.floor(m / 2)
        even = half * (b - half) * x / ((a + 2 * half - 1) * (a + 2 * half))
        odd = -(a + half) * (a + b + half) * x / ((a + 2 * half) * (a + 2 * half + 1))
        term = F.when(m % 2 == 0, even).otherwise(odd)
        d = 1 / (1 + term * state["d"])
        c = 1 + term / state["c"]
        return F.struct(c.alias("c"), d.alias("d"), (state["v"] * c * d).alias("v"))

    # the first step has the numerator one
    start = F.struct(F.lit(1e300).alias("c"), F.lit(1.0).alias("d"), F.lit(1.0).alias("v"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), start, step, lambda state: state["v"])


def student_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t, in every row."""
    v, half = df.cast("double"), F.lit(0.5)
    x = v / (v + t * t)

    def tail(at: Column, a: Column, b: Column) -> Column:
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(at) + b * F.ln(1 - at))
        return front / a * _beta_fraction(at, a, b)

    direct = tail(x, v / 2, half)
    mirrored = 1 - tail(t * t / (v + t * t), half, v / 2)
    return F.when(t == 0, F.lit(1.0)).when(x > (v / 2 + 1) / (v / 2 + 2.5), mirrored).otherwise(direct)


def normal_p_value(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    return F.least(F.lit(1.0), 2 * normal_upper(F.abs(z)))


def kolmogorov_p_value(x: Column) -> Column:
    """P(K > x) of the limiting Kolmogorov distribution, in every row."""
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * x * x))
    total = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def regularized_beta(x: float, a: float, b: float) -> float:
    """I_x(a, b) by the continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - regularized_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d, value = 1.0, 0.0, 1.0
    for m in range(400):
        half = m // 2
        if m == 0:
            step = 1.0
        elif m % 2 == 0:
            step = half * (b - half) * x / ((a + 2 * half - 1) * (a + 2 * half))
        else:
            step = -(a + half) * (a + b + half) * x / ((a + 2 * half) * (a + 2 * half + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        value *= c * d
        if m and abs(c * d - 1) < 1e-14:
            break
    return front * (value - 1)


def kolmogorov_upper(x: float) -> float:
    """P(K > x) of the limiting Kolmogorov distribution."""
    if x < 0.2:
        return 1.0
    total = sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


def digamma(x: float) -> float:
    shift = 0.0
    while x < 10:
        shift -= 1 / x
        x += 1
    f = 1 / (x * x)
    return shift + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def trigamma(x: float) -> float:
    shift = 0.0
    while x < 10:
        shift += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return shift + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


# Coefficients of the rational fits of the normal quantile (relative error below
# 1.2e-9): numerator and denominator in the middle, numerator and denominator in the tails.
QUANTILE_FIT = (
    [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239],
    [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0],
    [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783],
    [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0],
)
QUANTILE_TAIL = 0.02425


def polynomial(coefficients: list[float], x: Column) -> Column:
    """The highest power first."""
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + c
    return value


def normal_quantile(p: Column) -> Column:
    """z with P(Z <= z) = p, for 0 < p < 1."""
    middle_up, middle_down, tail_up, tail_down = QUANTILE_FIT
    q = p - 0.5
    middle = q * polynomial(middle_up, q * q) / polynomial(middle_down, q * q)
    t = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = polynomial(tail_up, t) / polynomial(tail_down, t)
    return F.when(p < QUANTILE_TAIL, tail).when(p > 1 - QUANTILE_TAIL, -tail).otherwise(middle)


def gamma_cdf(x: Column, shape: float) -> Column:
    """P(shape, x), the gamma distribution function, in every row.

    Below shape + 1 the power series, above it the continued fraction by Lentz's
    method, each over a number of steps that the shape fixes.
    """
    steps = int(60 + 12 * math.sqrt(shape + 1))
    front = F.exp(shape * F.ln(x) - x - math.lgamma(shape))
    numbers = F.sequence(F.lit(1), F.lit(steps))

    def add(state: Column, n: Column) -> Column:
        term = state["t"] * x / (shape + n)
        return F.struct(term.alias("t"), (state["s"] + term).alias("s"))

    def turn(state: Column, n: Column) -> Column:
        b, step = x + 1 - shape + 2 * n, -n * (n - shape)
        d = 1 / (step * state["d"] + b)
        c = b + step / state["c"]
        return F.struct(c.alias("c"), d.alias("d"), (state["v"] * c * d).alias("v"))

    first = F.lit(1 / shape)
    series = F.aggregate(numbers, F.struct(first.alias("t"), first.alias("s")), add, lambda state: state["s"])
    begin = 1 / (x + 1 - shape)
    fraction = F.aggregate(numbers, F.struct(F.lit(1e300).alias("c"), begin.alias("d"), begin.alias("v")), turn, lambda state: state["v"])
    below = F.least(F.lit(1.0), front * series)
    return F.when(x <= 0, F.lit(0.0)).when(x < shape + 1, below).otherwise(F.greatest(F.lit(0.0), 1 - front * fraction))
