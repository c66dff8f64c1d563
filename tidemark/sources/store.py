"""The native store: Parquet with codecs as window expressions and a catalog beside the data.

Writing shuffles once, by box and block (a stretch of time that bounds a block's rows), and all tags are encoded over that one
partitioning: references belong to a block, so nothing crosses blocks. Files are sorted by block, so that a time range skips files, row groups
and pages by the block's statistics, also for columns in mode 'e', which are then decoded within the blocks that are read. Reading prunes
columns in the scan. Stored columns have names of their own (``b0``, ``o0``, ``t0``, ...), so tags, boxes and order columns may have any
name and box values any text; the layout keeps names and types. The writers commit by rename, so a failed write leaves no half table.

Nulls, NaN and infinities come back as they were in every mode, and so do all floats: a compressed float column is stored as places of doubles (longs;
older folders have rounded differences and are read as such). Rows with a null time are a block of their own and lie in no time range.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.rounding import round_decode, round_encode
from tidemark.functions.types import tag_columns, type_of_spark
from tidemark.operators.codec import TagSpec, decode_over, encode_over, is_float
from tidemark.operators.projection import time_range
from tidemark.operators.timeindex import EPOCH, block_for, with_block
from tidemark.plans.catalog import validate_schema


def _named(columns: list[str], letter: str) -> list:
    return [F.col(f"`{c}`").alias(f"{letter}{i}") for i, c in enumerate(columns)]


def _rows(box: list[str], order: list[str]):
    """Windows over one box and block, in time order; sorted by block first, as the files are."""
    return Window.partitionBy("k", *[f"b{i}" for i in range(len(box))]).orderBy(*[f"o{i}" for i in range(len(order))])


def save(
    df: DataFrame, path: str, ts: str, order: list[str], box: list[str], specs: list[TagSpec] | None = None, declared: dict[str, T.DataType] | None = None
) -> None:
    """Write the series of ``df`` under ``path`` (data, catalog and layout), replacing what was there.

    ``declared`` types of tags are checked first; columns that are no numbers are refused.
    """
    specs_by = {s.name: s for s in specs or []}
    tags = tag_columns(df, ts, *order, *box)
    kinds = {n: df.schema[n].dataType for n in tags}
    for name in tags:
        type_of_spark(kinds[name])
    validate_schema(df, declared or {})
    block_us = block_for(df, ts, box)
    plain = df.select(*_named(box, "b"), *_named(order, "o"), *_named(tags, "t"))
    rows = with_block(plain, f"o{order.index(ts)}", block_us, "k").repartition("k", *[f"b{i}" for i in range(len(box))])
    made = {}
    for i, name in enumerate(tags):
        spec, value = specs_by.get(name, TagSpec(name)), F.col(f"t{i}")
        stored, kind = (round_encode(value, spec.decimals), T.LongType()) if spec.rounded else (value, kinds[name])
        if spec.rounded and is_float(kinds[name]):
            made[f"n{i}"] = F.isnan(value)
        if spec.use_compression:
            made[f"r{i}"], stored = encode_over(stored, kind, spec.mode, _rows(box, order))
        made[f"t{i}"] = stored
    out = rows.withColumns(made).sortWithinPartitions("k", *[f"b{i}" for i in range(len(box))], *[f"o{i}" for i in range(len(order))])
    out.write.mode("overwrite").parquet(f"{path}/data")
    spark = df.sparkSession
    layout = {"ts": ts, "order": order, "box": box, "block_us": block_us, "schema": out.schema.jsonValue()}
    spark.createDataFrame([(json.dumps(layout),)], "layout string").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    lines = [(n, k, kinds[n].json(), (s := specs_by.get(n, TagSpec(n))).use_compression, s.mode, s.use_hash_table, s.rounded, s.decimals) for k, n in enumerate(tags)]
    tag_rows = spark.createDataFrame(lines, "tag string, ord int, type string, use_compression boolean, mode string, use_hash_table boolean, rounded boolean, decimals int")
    tag_rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/catalog")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/catalog")


def load(spark: SparkSession, path: str, tags: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The series under ``path``: box columns, order columns and the chosen tags (all by default)."""
    lines = [r for r in catalog(spark, path).orderBy("ord").collect() if tags is None or r["tag"] in tags]
    layout = json.loads(spark.read.parquet(f"{path}/layout").first()["layout"])
    ts, order, box, block_us = layout["ts"], layout["order"], layout["box"], layout["block_us"]
    df = spark.read.schema(T.StructType.fromJson(layout["schema"])).parquet(f"{path}/data")
    time = f"o{order.index(ts)}"
    for bound, sign in ((start, ">="), (end, "<=")):
        if bound is not None:  # whole blocks first: a filter on the stored number, which the scan can use
            us = F.timestamp_diff("MICROSECOND", F.expr(EPOCH), F.lit(bound).cast("timestamp_ntz"))
            edge = F.call_function("div", us - F.pmod(us, F.lit(block_us)), F.lit(block_us))
            df = df.where(F.col("k") >= edge if sign == ">=" else F.col("k") <= edge)
    if not any(r["use_compression"] and r["mode"] == "e" for r in lines):
        df = time_range(df, time, start, end)
    values = []
    for r in lines:
        i, kind = r["ord"], T._parse_datatype_json_string(r["type"])
        value = F.col(f"t{i}")
        if r["use_compression"]:
            stored = df.schema[f"t{i}"].dataType
            places = is_float(kind) and not r["rounded"] and not is_float(stored)
            value = decode_over(value, F.col(f"r{i}"), stored, r["mode"], _rows(box, order), places)
        if r["rounded"]:
            value = round_decode(value, r["decimals"])
            if f"n{i}" in df.columns:
                value = F.when(F.col(f"n{i}"), F.lit(float("nan"))).otherwise(value)
        values.append(value.cast(kind).alias(r["tag"]))
    keys = [F.col(f"{x}{i}").alias(c) for x, names in (("b", box), ("o", order)) for i, c in enumerate(names)]
    out = df.select(*keys, *values)
    return time_range(out, ts, start, end)
