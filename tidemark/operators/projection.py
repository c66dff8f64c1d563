"""Projection and filters on series tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.types import tag_columns


def canonical(df: DataFrame, ts: str, keys: list[str] | None = None, time_name: str = "DateTimes") -> DataFrame:
    """Keys, the time as ``time_name``, then the tags in code-point order."""
    keys = keys or []
    return df.select(*keys, F.col(ts).alias(time_name), *[F.col(f"`{c}`") for c in tag_columns(df, ts, *keys)])


def select_tags(df: DataFrame, ts: str, tags: list[str], keys: list[str] | None = None) -> DataFrame:
    return df.select(*(keys or []), ts, *[F.col(f"`{t}`") for t in sorted(tags)])


def time_range(df: DataFrame, ts: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; an extension that the planner pushes into Parquet scans."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return df


def without_nan(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is neither NaN nor null."""
    return df.where(~F.isnan(f"`{column}`") & F.col(f"`{column}`").isNotNull())


def in_time_order(df: DataFrame, ts: str, ties: list[str]) -> DataFrame:
    """All rows in time order, ties by the given columns."""
    return df.orderBy(ts, *ties)
