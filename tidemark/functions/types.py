"""Type characters, widths and identifiers of columns ("tags")."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.exceptions import CharConversionException, InvalidPandasDataTypeError
from tidemark.functions.widths import unsigned_bytes

# Type character and bytes, and the Spark type that holds them.
SPARK_TYPES = {
    ("i", 1): T.ByteType(),
    ("i", 2): T.ShortType(),
    ("i", 4): T.IntegerType(),
    ("i", 8): T.LongType(),
    ("u", 1): T.ShortType(),
    ("u", 2): T.IntegerType(),
    ("u", 4): T.LongType(),
    ("u", 8): T.DecimalType(20, 0),
    ("f", 2): T.FloatType(),
    ("f", 4): T.FloatType(),
    ("f", 8): T.DoubleType(),
}


def spark_type(char: str, size: int) -> T.DataType:
    try:
        return SPARK_TYPES[char, size]
    except KeyError:
        raise ValueError(f"no type {char}{size}") from None


def numpy_type(char: str, size: int) -> np.dtype:
    spark_type(char, size)
    return np.dtype(f"<{char}{size}")


def type_of_spark(kind: T.DataType) -> tuple[str, int]:
    """(character, bytes) of a numeric Spark column; other types can't be stored."""
    if isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision <= 20:
        return "u", 8
    for key in (("i", 1), ("i", 2), ("i", 4), ("i", 8), ("f", 4), ("f", 8)):
        if SPARK_TYPES[key] == kind:
            return key
    raise InvalidPandasDataTypeError(f"{kind.simpleString()} columns are not numeric series")


def type_of_dtype(dtype: object) -> tuple[str, int]:
    """(character, bytes) of a NumPy or pandas dtype."""
    try:
        dtype = np.dtype(dtype)
    except TypeError:
        raise InvalidPandasDataTypeError(f"{dtype} columns are not numeric series") from None
    if (dtype.kind, dtype.itemsize) not in SPARK_TYPES:
        raise InvalidPandasDataTypeError(f"{dtype} columns are not numeric series")
    return dtype.kind, dtype.itemsize


def char_code(x: object) -> int:
    """Code of one character, or of a number that is one."""
    if isinstance(x, str) and len(x) == 1:
        return ord(x)
    if isinstance(x, int) and not isinstance(x, bool):
        return x
    raise CharConversionException(f"{x!r} is not one character")


def char_of(x: object) -> str:
    if isinstance(x, str) and len(x) == 1:
        return x
    if isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 0x110000:
        return chr(x)
    raise CharConversionException(f"{x!r} is not one character")


def identifier_bytes(names: list[str] | list[int]) -> int:
    """Stored bytes of identifiers: four for each character of the longest name, or the width of the largest number."""
    if all(isinstance(n, str) for n in names):
        return 4 * max((len(n) for n in names), default=0)
    return unsigned_bytes(max(names))


def tag_columns(df: DataFrame, *not_tags: str) -> list[str]:
    """Names of the value columns in code-point order."""
    return sorted(c for c in df.columns if c not in not_tags)
