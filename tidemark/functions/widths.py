"""Smallest integer and float widths, as column expressions and for single values."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.exceptions import IntegerWidthError, NotIntegerException

BYTES = (1, 2, 4, 8)


def _ladder(value: Column, bits: int) -> Column:
    """Bytes for a value that is at least 0, with ``bits`` bits of a byte missing for the sign."""
    value = value.cast("decimal(20,0)")
    out = None
    for n in BYTES:
        fits = value < F.lit(Decimal(2) ** (8 * n - bits)).cast("decimal(21,0)")
        out = F.when(fits, F.lit(n)) if out is None else out.when(fits, F.lit(n))
    return out.otherwise(F.raise_error(F.lit("integer needs more than 8 bytes"))).cast("short")


def unsigned_width(value: Column) -> Column:
    """Bytes (1, 2, 4, 8) of an unsigned integer; null stays null, negative or 2**64 and more is an error."""
    return F.when(value.isNull(), F.lit(None)).when(value < 0, F.raise_error(F.lit("negative integer"))).otherwise(_ladder(value, 0)).cast("short")


def signed_width(value: Column) -> Column:
    """Bytes (1, 2, 4, 8) of a signed integer: a negative v counts like -v-1."""
    wide = value.cast("decimal(20,0)")
    return F.when(value.isNull(), F.lit(None)).otherwise(_ladder(F.greatest(wide, -wide - 1), 1)).cast("short")


def unsigned_bytes(value: int) -> int:
    for n in BYTES:
        if 0 <= value < 1 << 8 * n:
            return n
    raise IntegerWidthError(f"{value} is not an unsigned integer of up to 8 bytes")


def signed_bytes(value: int) -> int:
    value = max(value, -value - 1)
    for n in BYTES:
        if value < 1 << (8 * n - 1):
            return n
    raise IntegerWidthError("the integer needs more than 8 bytes")


def range_width(least: Column, most: Column) -> Column:
    """Bytes of encoded integers in [least, most]: signed by the larger magnitude if any is negative, else unsigned.

    A minimum of exactly -128 counts by its magnitude and so takes 2 bytes.
    """
    small, large = least.cast("decimal(20,0)"), most.cast("decimal(20,0)")
    return F.when(small < 0, signed_width(F.greatest(-small, large))).otherwise(unsigned_width(large))


def range_char(least: Column) -> Column:
    return F.when(least < 0, F.lit("i")).when(least.isNotNull(), F.lit("u"))


def ensure_integer(value: Column) -> Column:
    """Integral numbers as long; others are an error; null stays null."""
    return F.when(value % 1 == 0, value.cast("long")).when(value.isNotNull(), F.raise_error(F.lit("not an integer")).cast("long"))


def ensure_int(value: object) -> int:
    if isinstance(value, bool) or not isinstance(value, int | float | Decimal) or value != value or value % 1 != 0:
        raise NotIntegerException(f"{value!r} is not an integer")
    return int(value)


def float_bits(value: Column) -> Column:
    """IEEE bits of a double; null for null. Not deterministic to the planner: project before aggregating."""
    return F.try_reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), value.cast("double")).cast("long")


def float_number(value: Column) -> Column:
    """The place of a float among all doubles, as a long: its bits, mirrored below zero so that the order stays; to the planner like ``float_bits``."""
    bits = float_bits(value)
    return bits.bitwiseXOR(F.shiftrightunsigned(F.shiftright(bits, 63), 1))


def float_of_number(number: Column) -> Column:
    """The double at a place that ``float_number`` gave, exactly: every power and product here is a double itself."""
    bits = number.bitwiseXOR(F.shiftrightunsigned(F.shiftright(number, 63), 1)).bitwiseAND(F.lit(2**63 - 1))
    exponent, fraction = F.shiftright(bits, 52), bits.bitwiseAND(F.lit(2**52 - 1))
    scale = F.pow(F.lit(2.0), F.greatest(exponent, F.lit(1)) - 1075)
    size = (fraction + F.when(exponent > 0, F.lit(2**52)).otherwise(F.lit(0))).cast("double") * scale
    odd = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    whole = F.when(exponent == 2047, odd).otherwise(size)
    return F.when(number < 0, -whole).otherwise(whole)


def value_float_width(value: Column, bits: Column) -> Column:
    """Narrowest float (2, 4, 8 bytes) that holds one double exactly; null for NaN and null.

    A width is right only where the target is a normal number (or zero, or infinite), so narrowing always round-trips;
    of the dropped mantissa bits all must be 0.
    """
    exponent = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(2047)) - 1023
    zero_low = lambda n: bits.bitwiseAND(F.lit((1 << n) - 1)) == 0
    special = (value == 0) | (F.abs(value) == float("inf"))
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(None))
        .when(special, F.lit(2))
        .when(zero_low(42) & exponent.between(-14, 15), F.lit(2))
        .when(zero_low(29) & exponent.between(-126, 127), F.lit(4))
        .otherwise(F.lit(8))
        .cast("short")
    )
