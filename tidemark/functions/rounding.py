"""Decimal rounding to scaled integers and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_encode(value: Column, decimals: int) -> Column:
    """value * 10**decimals, rounded half to even, as long; NaN becomes null, for which no integer stands."""
    scaled = F.rint(value * F.lit(10.0**decimals))
    return F.when(~F.isnan(scaled), scaled).cast("long")


def round_decode(scaled: Column, decimals: int) -> Column:
    return scaled.cast("double") / F.lit(10.0**decimals)
