"""The lattice of time units, on the driver and as a table."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.exceptions import DateUnitsError, DateUnitsGranularityError


@dataclass(frozen=True)
class Unit:
    name: str
    code: int
    nanoseconds: int


# Unit names, their stored codes (finest first) and lengths in nanoseconds.
UNITS = (
    Unit("ns", 0, 1),
    Unit("us", 1, 1_000),
    Unit("ms", 2, 1_000_000),
    Unit("s", 3, 1_000_000_000),
    Unit("m", 4, 60_000_000_000),
    Unit("h", 5, 3_600_000_000_000),
    Unit("D", 6, 86_400_000_000_000),
)
#: Units that microsecond timestamps can have.
MICRO_UNITS = UNITS[1:]


def unit(x: str | int) -> Unit:
    """A unit by name or stored code."""
    for u in UNITS:
        if x in (u.name, u.code) and not isinstance(x, bool):
            return u
    raise DateUnitsError(f"unknown time unit {x!r}")


def finer(x: str | int) -> Unit:
    code = unit(x).code - 1
    if code < 0:
        raise DateUnitsGranularityError(f"nothing is finer than {unit(x).name}")
    return UNITS[code]


def coarser(x: str | int) -> Unit:
    code = unit(x).code + 1
    if code == len(UNITS):
        raise DateUnitsGranularityError(f"nothing is coarser than {unit(x).name}")
    return UNITS[code]


def conversion(source: str | int, target: str | int) -> float:
    """How many ``target`` units make one ``source`` unit."""
    return unit(source).nanoseconds / unit(target).nanoseconds


def unit_of_dtype(text: object) -> str:
    """The unit in a type name such as ``datetime64[us]``."""
    found = re.search(r"\[(.+)\]", str(text))
    if not found:
        raise DateUnitsError(f"{text} has no unit")
    return unit(found[1]).name


def unit_of_dtype_column(text: Column) -> Column:
    return F.regexp_extract(text, r"\[(.+)\]", 1)


def unit_table(spark: SparkSession) -> DataFrame:
    """unit, code, nanoseconds."""
    values = ", ".join(f"('{u.name}', {u.code}, {u.nanoseconds}L)" for u in UNITS)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(unit, code, nanoseconds)")


def unit_code(name: Column) -> Column:
    """Stored code of a unit name; null for other text."""
    return F.coalesce(*[F.when(name == u.name, F.lit(u.code)) for u in UNITS])


def unit_name(code: Column) -> Column:
    return F.coalesce(*[F.when(code == u.code, F.lit(u.name)) for u in UNITS])


def micros(name: Column) -> Column:
    """Microseconds of a unit name (us and coarser)."""
    return F.coalesce(*[F.when(name == u.name, F.lit(u.nanoseconds // 1000)) for u in MICRO_UNITS])


def unit_conversions(spark: SparkSession) -> DataFrame:
    """from_unit, to_unit, multiplier for all 49 pairs (a fixed table of seven rows on both sides)."""
    rows = ", ".join(f"('{a.name}', '{b.name}', {conversion(a.name, b.name)!r}D)" for a in UNITS for b in UNITS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(from_unit, to_unit, multiplier)")


def unit_neighbours(spark: SparkSession) -> DataFrame:
    """unit, finer, coarser; null beyond the ends."""
    text = lambda code: f"'{UNITS[code].name}'" if 0 <= code < len(UNITS) else "CAST(NULL AS STRING)"
    rows = ", ".join(f"({text(u.code)}, {text(u.code - 1)}, {text(u.code + 1)})" for u in UNITS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(unit, finer, coarser)")
