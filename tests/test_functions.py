from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import exceptions as E
from tidemark.functions import types, units, widths
from tidemark.functions.rounding import round_decode, round_encode


def test_units():
    assert [units.unit(k).name for k in range(7)] == ["ns", "us", "ms", "s", "m", "h", "D"]
    assert units.finer("s").name == "ms" and units.coarser("h").name == "D"
    for bad in ("x", 7, -1, True):
        with pytest.raises(E.DateUnitsError):
            units.unit(bad)
    with pytest.raises(E.DateUnitsGranularityError):
        units.finer("ns")
    with pytest.raises(E.DateUnitsGranularityError):
        units.coarser("D")
    assert units.conversion("D", "h") == 24 and units.conversion("s", "m") == 1 / 60
    assert units.unit_of_dtype(np.dtype("datetime64[us]")) == "us"
    with pytest.raises(E.DateUnitsError):
        units.unit_of_dtype("int64")


UNSIGNED = [(0, 1), (255, 1), (256, 2), (65535, 2), (65536, 4), (2**32 - 1, 4), (2**32, 8), (2**64 - 1, 8)]
SIGNED = [(-128, 1), (127, 1), (128, 2), (-129, 2), (-32768, 2), (32768, 4), (-(2**31), 4), (2**31, 8), (-(2**63), 8), (2**63 - 1, 8)]


def test_integer_widths(spark):
    for values, one, column in ((UNSIGNED, widths.unsigned_bytes, widths.unsigned_width), (SIGNED, widths.signed_bytes, widths.signed_width)):
        assert [one(v) for v, _ in values] == [w for _, w in values]
        df = spark.createDataFrame([(Decimal(v), w) for v, w in values], "v decimal(20,0), w int")
        assert df.where(column(F.col("v")) != F.col("w")).count() == 0
    for f, bad in ((widths.unsigned_bytes, -1), (widths.unsigned_bytes, 2**64), (widths.signed_bytes, 2**63)):
        with pytest.raises(E.IntegerWidthError):
            f(bad)
    for column, bad in ((widths.unsigned_width, -1), (widths.signed_width, 2**63)):
        with pytest.raises(Exception, match="integer"):
            spark.createDataFrame([(Decimal(bad),)], "v decimal(20,0)").select(column(F.col("v"))).collect()


def test_range_width_counts_magnitude(spark):
    rows = [(-128, 0, "i", 2), (-127, 127, "i", 1), (0, 255, "u", 1), (0, 256, "u", 2), (-12, 2000, "i", 2)]
    df = spark.createDataFrame(rows, "a long, b long, c string, w int")
    assert df.where((widths.range_width(F.col("a"), F.col("b")) != F.col("w")) | (widths.range_char(F.col("a")) != F.col("c"))).count() == 0


def test_ensure_int(spark):
    assert widths.ensure_int(3) == widths.ensure_int(3.0) == widths.ensure_int(Decimal(3)) == 3
    for bad in (3.5, "3", None, float("nan"), True):
        with pytest.raises(E.NotIntegerException):
            widths.ensure_int(bad)
    df = spark.createDataFrame([(2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(widths.ensure_integer(F.col("x"))).collect()] == [2, None]
    with pytest.raises(Exception, match="not an integer"):
        spark.createDataFrame([(2.5,)], "x double").select(widths.ensure_integer(F.col("x"))).collect()


def test_float_width_against_numpy(spark):
    rng = np.random.default_rng(1)
    values = [0.0, -0.0, 1.0, 0.1, 65504.0, 65536.0, 2.0**-14, 2.0**-15, 2.0**-126, 2.0**-127, 2.0**127, 2.0**128, 1 + 2.0**-10, 1 + 2.0**-11, 1 + 2.0**-23, 1 + 2.0**-24, float("inf"), float("-inf"), float("nan"), None]
    values += [float(x) for x in rng.normal(size=200).astype(np.float16)] + [float(x) for x in rng.normal(size=200).astype(np.float32)] + rng.normal(size=50).tolist()

    def expected(x):
        if x is None or np.isnan(x):
            return None
        for size in (2, 4):
            with np.errstate(over="ignore"):
                y = np.dtype(f"f{size}").type(x)
            if float(y) == x and (x == 0 or np.isinf(x) or abs(x) >= float(np.finfo(f"f{size}").tiny)):
                return size
        return 8

    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    df = df.select("i", "x", widths.float_bits(F.col("x")).alias("b"))
    got = {r[0]: r[1] for r in df.select("i", widths.value_float_width(F.col("x"), F.col("b"))).collect()}
    assert got == {i: expected(x) for i, x in enumerate(values)}


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.5, 0), (1.5, 2), (2.5, 2), (-0.5, 0), (-1.5, -2), (float("nan"), None), (None, None)], "x double, want long")
    assert df.where(~round_encode(F.col("x"), 0).eqNullSafe(F.col("want"))).count() == 0
    assert spark.range(1).select(round_decode(F.lit(1023), 2)).first()[0] == 10.23


def test_types():
    assert types.type_of_dtype(np.uint16) == ("u", 2) and types.type_of_dtype("float16") == ("f", 2)
    for bad in (bool, object, "datetime64[ns]", complex, "U3"):
        with pytest.raises(E.InvalidPandasDataTypeError):
            types.type_of_dtype(bad)
    assert types.type_of_spark(T.DecimalType(20, 0)) == ("u", 8) and types.type_of_spark(T.ShortType()) == ("i", 2)
    for kind in (T.BooleanType(), T.StringType(), T.DecimalType(10, 2), T.TimestampType()):
        with pytest.raises(E.InvalidPandasDataTypeError):
            types.type_of_spark(kind)
    with pytest.raises(ValueError):
        types.spark_type("f", 1)
    assert types.char_code("i") == 105 and types.char_code(105) == 105 and types.char_of(105) == "i" and types.char_of("u") == "u"
    for bad in ("ab", None, [1], {}):
        with pytest.raises(E.CharConversionException):
            types.char_code(bad)
        with pytest.raises(E.CharConversionException):
            types.char_of(bad)
    assert types.identifier_bytes(["tag_0", "tag_1", "tag_2_long_name"]) == 60 and types.identifier_bytes([0, 1, 2, 255, 256]) == 2
