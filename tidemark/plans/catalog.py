"""Catalogs of boxes and tags, option bits, sizes and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.exceptions import (
    DataDoesNotMatchTagDefinitionError,
    DataShapeError,
    DateDataError,
    TagIdentifierByteRepresentationError,
)
from tidemark.functions.types import identifier_bytes, tag_columns, type_of_spark
from tidemark.operators.codec import TagSpec
from tidemark.operators.timeindex import box_span, delta_units, time_deltas

# Fixed values of the stored form: bytes of a tag record beside its identifier, and of the fixed header parts.
TAG_RECORD_BYTES = 40
HEADER_BYTES = 9
START_BYTES = 8
DELTA_INFO_BYTES, GRID_INFO_BYTES = 3, 4
BOX_OPTIONS = ("id_is_string", "deltas_stored")
TAG_OPTIONS = ("use_compression", "use_hash_table", "rounded")


def encode_bits(*flags: Column) -> Column:
    """Flags as one integer, the first in bit 0."""
    return sum((F.shiftleft(f.cast("int"), k) for k, f in enumerate(flags)), F.lit(0))


def decode_bits(options: Column, names: tuple[str, ...]) -> list[Column]:
    return [(F.shiftright(options, k).bitwiseAND(F.lit(1)) == 1).alias(n) for k, n in enumerate(names)]


def pack_options(*flags: bool) -> int:
    return sum(int(f) << k for k, f in enumerate(flags))


def unpack_options(options: int, n: int) -> tuple[bool, ...]:
    return tuple(bool(options >> k & 1) for k in range(n))


def tag_catalog(df: DataFrame, *not_tags: str, specs: dict[str, TagSpec] | None = None) -> DataFrame:
    """One row per tag in code-point order: tag, ord, type_char, bytes_per_value and the spec's flags."""
    rows = []
    for k, name in enumerate(tag_columns(df, *not_tags)):
        char, size = type_of_spark(df.schema[name].dataType)
        s = (specs or {}).get(name, TagSpec(name))
        rows.append((name, k, char, size, s.use_compression, s.use_hash_table, s.rounded, s.mode if s.use_compression else None, s.decimals if s.rounded else None))
    return df.sparkSession.createDataFrame(
        rows, "tag string, ord int, type_char string, bytes_per_value int, use_compression boolean, use_hash_table boolean, rounded boolean, codec_mode string, num_decimals int"
    )


def box_catalog(df: DataFrame, ts: str, order: list[str], box: list[str], tags: list[str] | None = None) -> DataFrame:
    """One row per box: points, tags, identifier width, start, unit and width of its deltas."""
    tags = tag_columns(df, ts, *box) if tags is None else tags
    units = delta_units(time_deltas(df, ts, order, box), box)
    spans = box_span(df, ts, box)
    return spans.join(units, box).select(
        *box, F.lit(True).alias("id_is_string"), F.lit(True).alias("deltas_stored"), "n_points", F.lit(len(tags)).alias("n_tags"),
        F.lit(identifier_bytes(tags)).alias("id_bytes"), "start_ts", "unit", "delta_bytes",
    )


def header_bytes(n_tags: int, id_bytes: int, deltas_stored: bool) -> int:
    return HEADER_BYTES + n_tags * (id_bytes + TAG_RECORD_BYTES) + START_BYTES + (DELTA_INFO_BYTES if deltas_stored else GRID_INFO_BYTES)


def box_sizes(boxes: DataFrame, box: list[str], bytes_per_point: int) -> DataFrame:
    """header_bytes, delta_bytes_total, data_bytes and total_bytes of each box of ``box_catalog`` stored without codecs."""
    info = F.when(F.col("deltas_stored"), DELTA_INFO_BYTES).otherwise(GRID_INFO_BYTES)
    header = (F.lit(HEADER_BYTES + START_BYTES) + F.col("n_tags") * (F.col("id_bytes") + TAG_RECORD_BYTES) + info).cast("long")
    deltas = F.when(F.col("deltas_stored"), F.greatest(F.col("n_points") - 1, F.lit(0)) * F.col("delta_bytes")).otherwise(0).cast("long")
    data = (F.col("n_points") * bytes_per_point).cast("long")
    return boxes.select(*box, header.alias("header_bytes"), deltas.alias("delta_bytes_total"), data.alias("data_bytes"), (header + deltas + data).alias("total_bytes"))


def check_identifier_bytes(size: int, is_string: bool) -> None:
    if size <= 0 or size > 255 or (is_string and size % 4) or (not is_string and size not in (1, 2, 4, 8)):
        raise TagIdentifierByteRepresentationError(f"{size} bytes can't hold {'names' if is_string else 'numbers'}")


def validate_schema(df: DataFrame, declared: dict[str, T.DataType]) -> None:
    """Every declared tag is present with its declared type."""
    have = {f.name: f.dataType for f in df.schema}
    for name, kind in declared.items():
        if name not in have:
            raise DataDoesNotMatchTagDefinitionError(f"tag {name} has no data")
        if have[name] != kind:
            raise DataDoesNotMatchTagDefinitionError(f"tag {name} is {have[name].simpleString()}, declared {kind.simpleString()}")


def validate_lengths(long_form: DataFrame, tag: str, n_points: int) -> None:
    """In long form every tag has ``n_points`` rows."""
    bad = long_form.groupBy(tag).count().where(F.col("count") != n_points).limit(1).collect()
    if bad:
        raise DataShapeError(f"tag {bad[0][0]} has {bad[0][1]} values, not {n_points}")


def validate_deltas(units: DataFrame, declared_bytes: int) -> None:
    """No box needs wider deltas than declared."""
    if units.where(F.col("delta_bytes") > declared_bytes).limit(1).count():
        raise DateDataError(f"deltas need more than {declared_bytes} bytes")


def validate_step(step_seconds: float) -> None:
    if not step_seconds > 0:
        raise DateDataError("the step between points must be positive")


def validation_report(df: DataFrame, ts: str, arrival: str, box: list[str]) -> DataFrame:
    """Per box: n_points, n_deltas, null times, and whether deltas number one less than points."""
    deltas = time_deltas(df, ts, [ts, arrival], box)
    found = deltas.groupBy(*box).agg(F.count("*").alias("n_points"), F.count("delta_us").alias("n_deltas"), F.count_if(F.col(ts).isNull()).alias("null_times"), F.count_if(F.col("delta_us") < 0).alias("negative"))
    return found.withColumn("valid", (F.col("n_deltas") == F.col("n_points") - 1) & (F.col("null_times") == 0) & (F.col("negative") == 0))


def option_table(spark: SparkSession, bits: int, names: tuple[str, ...]) -> DataFrame:
    """All values of an option field, decoded and encoded again."""
    rows = spark.range(1 << bits).select(F.col("id").cast("int").alias("options"))
    flags = rows.select("options", *decode_bits(F.col("options"), names))
    return flags.withColumn("encoded", encode_bits(*[F.col(n) for n in names]))
