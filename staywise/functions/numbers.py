"""Numeric coercion, exact decimal rounding and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def to_number(c: Column) -> Column:
    """Text to double; whatever does not parse, NaN included, becomes NULL."""
    text = c.cast("string")
    return F.when(text.rlike(PLAIN_NUMBER) | text.rlike(INFINITE), F.trim(text).try_cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def cell(df: DataFrame, name: str) -> Column:
    """A column as gates and counts see it: NaN in a floating column is missing."""
    c = F.col(f"`{name}`")
    return nan_to_null(c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division as double; a zero denominator gives 0."""
    num, den = numerator.cast("double"), denominator.cast("double")
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def _scaled_integer(magnitude: Column, digits: int) -> Column:
    """``magnitude * 10**digits`` as a bigint, rounded half-even from the exact binary value.

    The fraction of a double is (m + f) / 2**53 with an integer m and 0 <= f < 1.
    (m + f) * 10**digits / 2**53 is rounded without error in two 64-bit limbs of 27
    and 26 bits; f has so few bits left that f * 10**digits is exact. There is no
    branch in here, so that codegen evaluates every shared part once.
    """
    scale = 10**digits
    whole = F.floor(magnitude)
    scaled = (magnitude - whole) * F.lit(float(2**53))
    m = F.floor(scaled)
    rest = (scaled - m) * F.lit(float(scale))
    low = m.bitwiseAND(F.lit(2**27 - 1)) * F.lit(scale) + F.floor(rest)
    high = F.shiftright(m, 27) * F.lit(scale) + F.shiftright(low, 27)
    quotient = F.shiftright(high, 26)
    remainder = F.shiftleft(high.bitwiseAND(F.lit(2**26 - 1)), 27).bitwiseOR(low.bitwiseAND(F.lit(2**27 - 1)))
    half = F.lit(2**52)
    sticky = (rest > F.floor(rest)).cast("long")
    odd = quotient.bitwiseAND(F.lit(1))
    # Above half, or half and (something follows or the quotient is odd).
    up = (remainder + sticky.bitwiseOR(odd) > half).cast("long")
    return whole * F.lit(scale) + quotient + up


def _clipped(magnitude: Column, digits: int) -> Column:
    """No larger than a power of two from which on doubles are coarser than ``digits`` decimals."""
    return F.least(magnitude, F.lit(float(2 ** ((2**53 // 10**digits).bit_length() - 1))))


def round_exact(c: Column, digits: int) -> Column:
    """Round the exact binary value half-even, as Python's ``round`` does."""
    number = c.cast("double")
    magnitude = F.abs(number)
    clipped = _clipped(magnitude, digits)
    rounded = _scaled_integer(clipped, digits).cast("double") / F.lit(float(10**digits))
    return F.signum(number) * (rounded + (magnitude - clipped))


def money_text(c: Column) -> Column:
    """Two decimals without grouping, rounded like Python's ``%.2f``.

    NaN and infinities print as ``nan``, ``inf`` and ``-inf``. From 2**62 on an amount is printed
    from its shortest decimal form.
    """
    number = c.cast("double")
    magnitude = F.least(F.abs(number), F.lit(2.0**62))  # NaN is above every number
    units = F.floor(magnitude)
    cents = _scaled_integer(magnitude - units, 2)
    sign = F.repeat(F.lit("-"), (number < 0).cast("int"))
    whole = (units + F.call_function("div", cents, F.lit(100))).cast("string")
    plain = F.concat(sign, whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    huge = F.abs(number) >= F.lit(2.0**62)
    endless = F.concat(sign, F.lit("inf"))
    large = F.when(F.isnan(number), "nan").when(F.abs(number) == float("inf"), endless).otherwise(F.format_string("%.2f", number))
    # Taken from an array: in a branch, codegen would evaluate the shared parts of ``plain`` anew for each use.
    return F.get(F.array(plain, F.when(huge, large)), huge.cast("int"))


def at_least(probability: Column, threshold: float) -> Column:
    return probability >= F.lit(float(threshold))
