"""Column codecs: subtract-minimum ('m'), successive difference ('e'), decimal rounding, and narrow widths.

References are one row per box, joined back. NaN, the infinities and null stay out of references and differences and come back as they were:
'e' takes the difference to the last value before that is none of them. The reference is null where a value is encoded as itself: in boxes of 64-bit integers
whose range needs more than 63 bits, and on the null rows of 'e'. All columns decode exactly.

A difference of floats is rounded, so it does not say the value. In 'm' the column ``rest`` holds what the reference and the difference lack. In 'e', and wherever
``encode_over`` works, floats are replaced by their places among all doubles (``float_number``), and differences are of these integers: their sums are exact in any
order. Boxes whose floats differ by more than a float or 63 bits of places hold are encoded as they are, like NaN and the infinities (in places the reference is then null).
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.exceptions import CompressionError, CompressionModeInvalidError
from tidemark.functions.rounding import round_decode, round_encode
from tidemark.functions.widths import float_bits, float_number, float_of_number, range_char, range_width, value_float_width
from tidemark.operators.timeindex import with_previous, with_running_sum


@dataclass(frozen=True)
class TagSpec:
    """How one column is stored."""

    name: str
    use_compression: bool = False
    mode: str = "m"
    use_hash_table: bool = False
    rounded: bool = False
    decimals: int = 0

    def __post_init__(self) -> None:
        check_mode(self.mode)


def check_mode(mode: str) -> None:
    if mode not in ("m", "e"):
        raise CompressionModeInvalidError(f"codec mode {mode!r} is neither 'm' nor 'e'")


def check_type(kind: T.DataType) -> None:
    if not isinstance(kind, T.NumericType):
        raise CompressionError(f"{kind.simpleString()} columns have no codec")


def is_identity(kind: T.DataType, n_points: int, mode: str) -> bool:
    """Columns that a codec would not make smaller: one-byte integers, and a single point in mode 'e'."""
    return isinstance(kind, T.ByteType) or (mode == "e" and n_points == 1)


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, T.FloatType | T.DoubleType)


def present(x: Column, kind: T.DataType) -> Column:
    """The value, with NaN and the infinities as null."""
    return F.when(F.abs(x) < float("inf"), x) if is_float(kind) else x


def widened(value: Column, kind: T.DataType) -> Column:
    """Integers as long, so that a difference of two of fewer bytes always fits; other columns as they are."""
    return value.cast("long") if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType) else value


def fits(least: Column, most: Column, kind: T.DataType) -> Column:
    """Whether all differences of values in [least, most] are of the column's type: only longs and floats can fail."""
    if is_float(kind):
        return most - least < float("inf")
    if not isinstance(kind, T.LongType):
        return F.lit(True)
    return most.cast("decimal(20,0)") - least.cast("decimal(20,0)") <= F.lit(Decimal(2**63 - 1))


def references(df: DataFrame, column: str, mode: str, order: list[str], box: list[str] | None = None) -> DataFrame:
    """ref of each box: the minimum for 'm', the first value in time order for 'e'; null without values and where a codec does not fit."""
    check_mode(mode)
    kind = df.schema[column].dataType
    check_type(kind)
    value = present(F.col(f"`{column}`"), kind)
    ref = F.min(value) if mode == "m" else F.min_by(value, F.when(value.isNotNull(), F.struct(*order)))
    found = df.groupBy(*(box or [])).agg(F.min(value).alias("__tm_least"), F.max(value).alias("__tm_most"), widened(ref, kind).alias("ref"))
    least, most = F.col("__tm_least"), F.col("__tm_most")
    if mode == "e" and is_float(kind):
        least, most, kind = float_number(least), float_number(most), T.LongType()
    return found.select(*(box or []), F.when(fits(least, most, kind), F.col("ref")).alias("ref"))


def _with_reference(df: DataFrame, refs: DataFrame, box: list[str]) -> DataFrame:
    side = refs.select(*[F.col(b).alias(f"__tm_b{i}") for i, b in enumerate(box)], "ref")
    same = [F.col(b).eqNullSafe(F.col(f"__tm_b{i}")) for i, b in enumerate(box)]
    joined = df.join(side, same) if box else df.crossJoin(F.broadcast(side.limit(1)))
    return joined.drop(*[f"__tm_b{i}" for i in range(len(box))])


def _odd(x: Column, kind: T.DataType) -> Column:
    """NaN or infinite."""
    return x.isNotNull() & present(x, kind).isNull()


def difference(value: Column, ref: Column, before: Column | None, mode: str, kind: T.DataType) -> Column:
    """The encoded form of ``value``, for odd values the value itself; ``before`` is the last finite value before it."""
    itself = ref.isNull() | _odd(value, kind) if is_float(kind) else ref.isNull()
    return F.when(itself, value).otherwise(value - (ref if mode == "m" else before))


def restored(encoded: Column, ref: Column, offset: Column, kind: T.DataType) -> Column:
    """The value of an encoded row; ``offset`` is what the reference lacks (in 'e' the sum of the differences so far)."""
    out = F.when(ref.isNull(), encoded)
    if is_float(kind):
        out = out.when(_odd(encoded, kind), encoded)
    return out.otherwise(ref + offset)


def encode(df: DataFrame, column: str, mode: str, ts: str, order: list[str], box: list[str] | None = None) -> DataFrame:
    """Adds ref and encoded, in mode 'm' of floats also rest; in mode 'e' the first value of a box has a null, as it is the reference itself."""
    kind, given = df.schema[column].dataType, F.col(f"`{column}`")
    refs, value, ref = references(df, column, mode, order, box), widened(given, kind), F.col("ref")
    if mode == "m":
        out = _with_reference(df, refs, box or []).withColumn("encoded", difference(value, ref, None, mode, kind))
        # Like the sum of reference and difference, so the subtraction is exact.
        return out.withColumn("rest", F.when(ref.isNotNull(), present(value, kind) - (ref + F.col("encoded")))) if is_float(kind) else out
    both = df.withColumn("__tm_value", float_number(given) if is_float(kind) else value)
    both = both.withColumn("__tm_present", F.when(present(given, kind).isNotNull(), F.col("__tm_value")))
    both = with_previous(both, ts, order, {"__tm_before": "__tm_present"}, box, skip_nulls=True)
    both = _with_reference(both, refs, box or []).withColumn("ref", F.when(F.col("__tm_present").isNotNull(), ref))
    return both.withColumn("encoded", difference(F.col("__tm_value"), ref, F.col("__tm_before"), mode, T.LongType())).drop("__tm_before", "__tm_present", "__tm_value")


def decode(df: DataFrame, mode: str, ts: str, order: list[str], box: list[str] | None = None, name: str = "decoded") -> DataFrame:
    """Adds the value again from ref and encoded (and rest, where ``encode`` gave one)."""
    check_mode(mode)
    kind, ref_kind, encoded, ref = df.schema["encoded"].dataType, df.schema["ref"].dataType, F.col("encoded"), F.col("ref")
    if mode == "m":
        value = restored(encoded, ref, encoded, kind)
        if is_float(kind) and "rest" in df.columns:
            value = F.when(F.col("rest").isNotNull(), value + F.col("rest")).otherwise(value)
        return df.withColumn(name, value)
    places = is_float(ref_kind)
    steps = df.withColumns({"__tm_step": F.when(ref.isNotNull(), encoded), "__tm_ref": float_number(ref) if places else ref})
    summed = with_running_sum(steps, ts, order, "__tm_step", "__tm_offset", box)
    value = restored(encoded, F.col("__tm_ref"), F.col("__tm_offset"), kind)
    return summed.withColumn(name, float_of_number(value).cast(ref_kind) if places else value).drop("__tm_offset", "__tm_step", "__tm_ref")


def encode_over(value: Column, kind: T.DataType, mode: str, rows: WindowSpec) -> tuple[Column, Column]:
    """(ref, encoded) with a reference for each partition of the ordered window ``rows`` in place of each box: nothing crosses partitions.

    Of floats both are places, longs, in both modes.
    """
    check_mode(mode)
    check_type(kind)
    whole = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    there, stored = present(value, kind).isNotNull(), float_number(value) if is_float(kind) else widened(value, kind)
    real, long = (F.when(there, stored), T.LongType()) if is_float(kind) else (stored, kind)
    least, most = F.min(real).over(whole), F.max(real).over(whole)
    ref = least if mode == "m" else F.first(real, ignorenulls=True).over(whole)
    ref = F.when(there & fits(least, most, long) if mode == "e" or is_float(kind) else fits(least, most, long), ref)
    before = None if mode == "m" else F.last(real, ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, -1))
    return ref, difference(stored, ref, before, mode, long)


def decode_over(encoded: Column, ref: Column, kind: T.DataType, mode: str, rows: WindowSpec, places: bool = False) -> Column:
    """The inverse of ``encode_over``; ``kind`` is the type of the encoded column, ``places`` says that it stands for doubles."""
    if mode == "m":
        value = restored(encoded, ref, encoded, kind)
    else:
        step = F.when(ref.isNotNull(), present(encoded, kind))
        offset = F.coalesce(F.sum(step).over(rows.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
        value = restored(encoded, ref, offset, kind)
    return float_of_number(value) if places else value


def encoded_width(encoded: DataFrame, box: list[str] | None = None) -> DataFrame:
    """least, most, narrow_char and narrow_bytes of each box's encoded integers; without any, one unsigned byte."""
    found = encoded.groupBy(*(box or [])).agg(F.min("encoded").alias("least"), F.max("encoded").alias("most"))
    small, large = F.coalesce("least", F.lit(0)), F.coalesce("most", F.lit(0))
    return found.select(*(box or []), "least", "most", range_char(small).alias("narrow_char"), range_width(small, large).alias("narrow_bytes"))


def float_width(df: DataFrame, column: str, box: list[str] | None = None) -> DataFrame:
    """narrow_bytes of each box: the narrowest float that holds all its values exactly; 2 without any value."""
    box = box or []
    value = F.col(f"`{column}`").cast("double")
    bits = df.select(*box, value.alias("__tm_value"), float_bits(value).alias("__tm_bits"))
    widths = bits.select(*box, value_float_width(F.col("__tm_value"), F.col("__tm_bits")).alias("__tm_width"))
    return widths.groupBy(*box).agg(F.coalesce(F.max("__tm_width"), F.lit(2)).cast("short").alias("narrow_bytes"))


def encode_tag(df: DataFrame, spec: TagSpec, ts: str, order: list[str], box: list[str] | None = None) -> DataFrame:
    """Rounds, then compresses, as the spec says; adds encoded (and ref, null without compression)."""
    value = F.col(f"`{spec.name}`")
    work = df.withColumn("__tm_stored", round_encode(value, spec.decimals) if spec.rounded else value)
    if not spec.use_compression:
        return work.withColumns({"ref": F.lit(None).cast(work.schema["__tm_stored"].dataType), "encoded": F.col("__tm_stored")}).drop("__tm_stored")
    return encode(work, "__tm_stored", spec.mode, ts, order, box).drop("__tm_stored")


def decode_tag(df: DataFrame, spec: TagSpec, kind: T.DataType, ts: str, order: list[str], box: list[str] | None = None, name: str = "decoded") -> DataFrame:
    """The inverse: decompresses, undoes the scaling, casts to the column's type."""
    out = decode(df, spec.mode, ts, order, box, name) if spec.use_compression else df.withColumn(name, F.col("encoded"))
    value = round_decode(F.col(name), spec.decimals) if spec.rounded else F.col(name)
    return out.withColumn(name, value.cast(kind))
