"""Column expressions that several operators share. All are built-in functions, so that they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that count as missing, compared in lower case after trimming.
MISSING_MARKERS = ("", "na", "n/a", "null", "nan", "none", "-", "?")
#: A decimal number, infinity or NaN, in full; SQL casts alone would also take suffixes such as 1d.
NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"

# Coefficients of Acklam's rational approximation of the normal quantile function.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.38357751867269e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_LOW = 0.02425


def num(name: str | Column) -> Column:
    """A numeric column as double, with NaN as null."""
    c = F.col(f"`{name}`") if isinstance(name, str) else name
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def is_bad(c: Column) -> Column:
    """Null, NaN or infinite."""
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def finite(name: str) -> Column:
    """The column as double; a null or non-finite value fails the query where it is met."""
    c = F.col(f"`{name}`").cast("double")
    return F.when(is_bad(c), F.raise_error(F.lit(f"InvalidInput: column {name} has a null or non-finite value")).cast("double")).otherwise(c)


def plus_zero(c: Column) -> Column:
    """-0.0 as 0.0."""
    return c + F.lit(0.0)


def polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    """Horner's scheme, highest power first."""
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution, for p within (0, 1)."""

    def tail(q: Column) -> Column:
        return polynomial(ACKLAM_C, q) / polynomial((*ACKLAM_D, 1.0), q)

    centre = p - 0.5
    r = centre * centre
    middle = polynomial(ACKLAM_A, r) * centre / polynomial((*ACKLAM_B, 1.0), r)
    low, high = F.sqrt(-2.0 * F.ln(p)), F.sqrt(-2.0 * F.ln(1.0 - p))
    return F.when(p < ACKLAM_LOW, tail(low)).when(p <= 1.0 - ACKLAM_LOW, middle).otherwise(-tail(high))


def box_cox(x: Column, lam: float) -> Column:
    return F.ln(x) if abs(lam) < 1e-8 else (F.pow(x, F.lit(lam)) - 1.0) / F.lit(lam)


def box_cox_inverse(y: Column, lam: float) -> Column:
    return F.exp(y) if abs(lam) < 1e-8 else F.pow(y * lam + 1.0, F.lit(1.0 / lam))


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.ln(x + 1.0) if abs(lam) < 1e-8 else (F.pow(x + 1.0, F.lit(lam)) - 1.0) / F.lit(lam)
    down = -F.ln(1.0 - x) if abs(lam - 2.0) < 1e-8 else -((F.pow(1.0 - x, F.lit(2.0 - lam)) - 1.0) / F.lit(2.0 - lam))
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_inverse(y: Column, lam: float) -> Column:
    up = F.exp(y) - 1.0 if abs(lam) < 1e-8 else F.pow(y * lam + 1.0, F.lit(1.0 / lam)) - 1.0
    down = 1.0 - F.exp(-y) if abs(lam - 2.0) < 1e-8 else 1.0 - F.pow(1.0 - y * (2.0 - lam), F.lit(1.0 / (2.0 - lam)))
    return F.when(y >= 0, up).otherwise(down)


def sigmoid(z: Column) -> Column:
    """1 / (1 + exp(-z)) without overflow."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def dot(cols: list[Column], weights: list[float], start: float = 0.0) -> Column:
    """start plus the sum of column times weight, from left to right."""
    return reduce(lambda acc, cw: acc + cw[0] * F.lit(float(cw[1])), zip(cols, weights, strict=True), F.lit(float(start)))


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end (SQL's trim takes off spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_missing(c: Column) -> Column:
    """Null, or one of the markers."""
    return c.isNull() | F.lower(trimmed(c)).isin(*MISSING_MARKERS)


def parsed(c: Column) -> Column:
    """The number a string stands for; null where it stands for none."""
    t = trimmed(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))
