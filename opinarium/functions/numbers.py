"""Number formatting, rounded half-even on the exact binary value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 52  # fraction bits of a double


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed(value: Column, decimals: int) -> Column:
    """Text of a double with ``decimals`` places (0 to 3).

    ``format_string`` and ``bround`` round the shortest decimal form of a double, so
    0.15 becomes 0.2 although the stored number is below 0.15. Here the fraction is
    taken as two 52-bit integers, which hold every bit of it, and halves are decided
    exactly. For reports of few rows.
    """
    if not 0 <= decimals <= 3:
        raise ValueError("decimals must be 0 to 3")
    ten = F.lit(10**decimals).cast("bigint")
    half, mask = F.lit(2 ** (_BITS - 1)).cast("bigint"), F.lit(2**_BITS - 1).cast("bigint")

    def shifted(x: Column) -> Column:
        return x * F.lit(2.0**_BITS)

    def text(units: Column) -> Column:
        tail = F.lpad((units % ten).cast("string"), max(decimals, 1), "0")
        head = ((units - units % ten) / ten).cast("bigint").cast("string")
        return F.concat(head, F.lit("."), tail) if decimals else units.cast("string")

    def rounded_up(whole: Column, scaled: Column, low: Column) -> Column:
        units = whole * ten + F.shiftright(scaled, _BITS)
        rest = scaled.bitwiseAND(mask)
        beyond = low.bitwiseAND(mask) > 0
        up = (rest > half) | ((rest == half) & (beyond | (units % 2 == 1)))
        return _bind(units + F.when(up, 1).otherwise(0), text)

    def split(whole: Column, fraction: Column) -> Column:
        high = F.floor(fraction)
        low = F.floor(shifted(fraction - high.cast("double"))) * ten
        return _bind(low, lambda lo: _bind(
            high * ten + F.shiftright(lo, _BITS), lambda scaled: rounded_up(whole, scaled, lo)
        ))

    def digits(size: Column) -> Column:
        return _bind(F.floor(size), lambda whole: _bind(
            shifted(size - whole.cast("double")), lambda fraction: split(whole, fraction)
        ))

    x = value.cast("double")
    sign = F.when(x < 0, "-").otherwise("")
    return F.when(F.isnan(x), "nan").otherwise(F.concat(sign, _bind(F.abs(x), digits)))


def rounded(value: Column, decimals: int) -> Column:
    return fixed(value, decimals).cast("double")


def thousands(value: Column) -> Column:
    """Whole number with comma separators."""
    return F.format_number(value, 0)
