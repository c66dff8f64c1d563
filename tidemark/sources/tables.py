"""CSV, pandas and pickle in and out.

A single frame (``from_pandas``, ``to_pandas``, ``save_pandas``, ``load_pandas``) must fit the driver's memory. A series of any size is many frames, made, written
and read on executors (``from_frames``, ``write_frames``, ``read_frames`` and the pickle functions): no row of it reaches the driver. Columns of such
frames that hold nulls are of pandas' nullable types, so that null is neither NaN nor a reason to turn integers into floats.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.exceptions import DataShapeError, InvalidPandasDataTypeError, InvalidPandasIndexError
from tidemark.functions.types import spark_type, tag_columns, type_of_dtype, type_of_spark
from tidemark.operators.codec import TagSpec
from tidemark.session import qualified
from tidemark.sources.container import _file_system, decode_file, encode_file
from tidemark.sources.lock import locked

TIME = "ts"
#: Rows of a file at most, where a series is many frames.
FRAME_ROWS = 200_000


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file with a header; give a schema where reading twice to infer one costs too much."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def index_times(index: pd.Index) -> np.ndarray:
    """Microsecond times of an index of times or of text that says times; other indexes are an error."""
    if pd.api.types.is_numeric_dtype(index.dtype):
        raise InvalidPandasIndexError("the index is numeric, not a time")
    try:
        times = pd.to_datetime(index, format="ISO8601") if index.dtype == object or pd.api.types.is_string_dtype(index.dtype) else pd.to_datetime(index)
    except (ValueError, TypeError) as e:
        raise InvalidPandasIndexError(f"the index is not a time: {e}") from e
    exact = times.values.astype("datetime64[ns]")
    if np.isnat(exact).any():
        raise InvalidPandasIndexError("the index has a missing time")
    if (exact.astype("int64") % 1000).any():
        raise InvalidPandasIndexError("times finer than microseconds can't be kept")
    return exact.astype("datetime64[us]")


def _numpy_dtype(dtype: object) -> object:
    """The NumPy type of a nullable number; other types as they are."""
    return np.dtype(f"{dtype.kind}{dtype.itemsize}") if isinstance(dtype, pd.api.extensions.ExtensionDtype) and dtype.kind in "iuf" else dtype


def series_schema(pdf: pd.DataFrame) -> T.StructType:
    """ts and one column per tag; a tag that is no number is an error."""
    kinds = {str(name): spark_type(*type_of_dtype(_numpy_dtype(dtype))) for name, dtype in pdf.dtypes.items()}
    return T.StructType([T.StructField(TIME, T.TimestampNTZType(), False), *[T.StructField(n, k) for n, k in kinds.items()]])


def _series(pdf: pd.DataFrame, schema: T.StructType) -> pa.RecordBatch:
    """The rows of a frame; one of other columns or types than ``schema`` says is an error."""
    if series_schema(pdf) != schema:
        raise InvalidPandasDataTypeError(f"a frame with {series_schema(pdf).simpleString()} in a series with {schema.simpleString()}")
    kinds, columns = to_arrow_schema(schema), [pa.array(index_times(pdf.index), pa.timestamp("us"))]
    for k, kind in enumerate(kinds.types[1:]):
        values = pdf.iloc[:, k]
        if isinstance(values.dtype, pd.api.extensions.ExtensionDtype):
            columns.append(pa.array(values.array).cast(kind))
        elif pa.types.is_decimal(kind):
            columns.append(pa.array([Decimal(x) for x in values.tolist()], kind))
        else:
            columns.append(pa.array(values.to_numpy().astype(kind.to_pandas_dtype())))
    return pa.RecordBatch.from_arrays(columns, schema=kinds)


def from_pandas(spark: SparkSession, pdf: pd.DataFrame) -> DataFrame:
    """A series from a frame with a time index: ts first, then one column per tag, in time order.

    NaN stays NaN; unsigned 64-bit columns become decimal(20,0), which holds all their values.
    """
    index_times(pdf.index)
    schema = series_schema(pdf)
    return spark.createDataFrame(pa.Table.from_batches([_series(pdf, schema)]), schema).orderBy(TIME)


def _pandas(batch: pa.RecordBatch) -> pd.DataFrame:
    """Rows as a frame; numbers with nulls become nullable columns."""
    columns = []
    for values in batch.columns:
        if pa.types.is_decimal(values.type):
            values = values.cast(pa.uint64())
        if values.null_count and (pa.types.is_integer(values.type) or pa.types.is_floating(values.type)):
            made = pd.arrays.IntegerArray if pa.types.is_integer(values.type) else pd.arrays.FloatingArray
            columns.append(made(values.fill_null(0).to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False)))
        else:
            columns.append(values.to_pandas())
    return pd.DataFrame(dict(enumerate(columns))).set_axis(batch.schema.names, axis=1)


def indexed(rows: pd.DataFrame, ts: str = TIME) -> pd.DataFrame:
    """Rows as ``to_pandas`` gives them: indexed by DateTimes, in time order, tags in code-point order."""
    frame = rows[sorted(c for c in rows.columns if c != ts)]
    return frame.set_axis(pd.DatetimeIndex(rows[ts], name="DateTimes")).sort_index(kind="stable")


def from_frames(df: DataFrame, make: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """A series, in time order, from frames with time indexes, each made on an executor from a batch of the rows of ``df`` by ``make``.

    All frames have the columns and types that ``make`` gives for no rows. Times come to it without a zone, as they are written in the session's.
    """
    df = df.withColumns({f.name: F.col(f"`{f.name}`").cast("timestamp_ntz") for f in df.schema if isinstance(f.dataType, T.TimestampType)})
    schema = series_schema(make(_pandas(pa.RecordBatch.from_pylist([], to_arrow_schema(df.schema)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _series(make(_pandas(batch)), schema)

    return df.mapInArrow(run, schema).orderBy(TIME)


def _stretches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pd.DataFrame]:
    """The rows of a task as frames of ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - sum(b.num_rows for b in held))
            held.append(part)
            batch = batch.slice(part.num_rows)
            if sum(b.num_rows for b in held) == rows:
                yield _pandas(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
    if held:
        yield _pandas(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _put(frame: pd.DataFrame, dump: Callable[[pd.DataFrame, str], object], uri: str, name: str) -> None:
    """One file of a folder: made on this machine, then written under a name that readers pass over, then moved."""
    with tempfile.TemporaryDirectory() as folder:
        local = os.path.join(folder, "frame")
        dump(frame, local)
        system, root = _file_system(uri)
        system.create_dir(root, recursive=True)
        hidden = f"{root}/.{name}-{uuid.uuid4().hex}"
        with open(local, "rb") as file, system.open_output_stream(hidden) as out:
            shutil.copyfileobj(file, out, 1 << 20)
        system.move(hidden, f"{root}/{name}")


def write_frames(df: DataFrame, path: str, dump: Callable[[pd.DataFrame, str], object], ts: str = TIME, rows: int = FRAME_ROWS) -> int:
    """Write a series as files in the folder ``path`` on storage that executors share, replacing what was there; returns their number.

    Rows are ordered by time, then by tags; each ``rows`` of a task at most are a frame indexed by DateTimes that ``dump`` writes to a file. All
    is written to a new folder first, which then takes the place of the old.
    """
    spark, tags = df.sparkSession, tag_columns(df, ts)
    for tag in tags:
        type_of_spark(df.schema[tag].dataType)
    target = qualified(spark, path)
    made = f"{target.rstrip('/')}-{uuid.uuid4().hex}.tmp"
    order = [f"t{i}" for i in range(len(tags))]
    plain = df.select(F.col(f"`{ts}`").cast("timestamp_ntz").alias("us"), *[F.col(f"`{c}`").alias(x) for c, x in zip(tags, order, strict=True)])

    def named(found: pd.DataFrame) -> pd.DataFrame:
        return found[order].set_axis(tags, axis=1).set_axis(pd.DatetimeIndex(found["us"], name="DateTimes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, found in enumerate(_stretches(batches, rows)):
            _put(named(found), dump, made, f"{part:06d}-{k:06d}")
            yield pa.RecordBatch.from_pydict({"n": [1]})

    old, new = spark._jvm.org.apache.hadoop.fs.Path(target), spark._jvm.org.apache.hadoop.fs.Path(made)
    system = old.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        files = plain.orderBy("us", *order).mapInArrow(run, "n long").count()
        if not files:
            empty = _pandas(pa.RecordBatch.from_pylist([], to_arrow_schema(plain.schema)))
            _put(named(empty), dump, made, f"{0:06d}-{0:06d}")
        system.delete(old, True)
        if not system.rename(new, old):
            raise OSError(f"{made} could not be renamed to {target}")
    finally:
        system.delete(new, True)
    return max(files, 1)


def read_frames(spark: SparkSession, path: str, load: Callable[[str], pd.DataFrame]) -> DataFrame:
    """A series, in time order, from the file or the files in a folder ``path``; ``load`` gives the frame of one, on an executor.

    All frames have the columns and types of the one that is looked at first.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch.column(0):
                with tempfile.TemporaryDirectory() as folder:
                    local = os.path.join(folder, "frame")
                    with open(local, "wb") as out:
                        out.write(content.as_buffer())
                    yield load(local)

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames(batches):
            yield pa.RecordBatch.from_pydict({"schema": [series_schema(frame).json()]})

    schema = T.StructType.fromJson(json.loads(files.limit(1).mapInArrow(kinds, "schema string").first()["schema"]))
    return files.mapInArrow(lambda batches: (_series(frame, schema) for frame in frames(batches)), schema).orderBy(TIME)


def _numbers(values: pd.Series) -> np.ndarray:
    """A column for a file, which knows no null: null floats become NaN, null integers are an error."""
    kind = _numpy_dtype(values.dtype)
    if kind is values.dtype:
        return values.to_numpy()
    if kind.kind != "f" and values.isna().any():
        raise DataShapeError(f"tag {values.name} has a null, which integer columns of a file can't hold")
    return values.to_numpy(kind, na_value=np.nan) if kind.kind == "f" else values.to_numpy(kind)


def save_pandas(pdf: pd.DataFrame, path: str, specs: list[TagSpec] | None = None, step_seconds: int = 0) -> int:
    """Write a frame with a time index as one container file on this machine, under the file lock; returns its bytes.

    Rows are put in time order. An index that is no time and columns that are no numbers are errors of their own kinds.
    """
    times = index_times(pdf.index)
    for name in pdf.columns:
        type_of_dtype(_numpy_dtype(pdf[name].dtype))
    order = np.argsort(times, kind="stable")
    columns = {name: _numbers(pdf[name])[order] for name in pdf.columns}
    data = encode_file(times[order].astype("int64"), columns, {s.name: s for s in specs or []}, step_seconds)
    with locked(path, "w") as handle:
        os.ftruncate(handle, 0)
        os.lseek(handle, 0, os.SEEK_SET)
        with os.fdopen(os.dup(handle), "wb") as out:
            out.write(data)
    return len(data)


def load_pandas(path: str, tags: list[str] | None = None) -> pd.DataFrame:
    """A container file on this machine as a frame indexed by DateTimes, read under the shared lock."""
    with locked(path, "r") as handle, os.fdopen(os.dup(handle), "rb") as file:
        times, columns = decode_file(file.read(), tags)
    return pd.DataFrame(columns, index=pd.DatetimeIndex(times.view("datetime64[us]"), name="DateTimes"))


def to_pandas(df: DataFrame, ts: str = TIME) -> pd.DataFrame:
    """A frame indexed by DateTimes in time order; like any pandas frame it must fit the driver's memory."""
    return df.select(F.col(ts).alias("DateTimes"), *[F.col(f"`{c}`") for c in tag_columns(df, ts)]).orderBy("DateTimes").toPandas().set_index("DateTimes")


def _dump_pickle(frame: pd.DataFrame, path: str) -> None:
    frame.to_pickle(path)


def write_pickle(df: DataFrame, path: str, ts: str = TIME) -> None:
    """The pandas frames of a series as a folder of pickles on storage that executors share (see ``write_frames``)."""
    write_frames(df, path, _dump_pickle, ts)


def read_pickle(spark: SparkSession, path: str) -> DataFrame:
    """A folder of pickled frames, or one file; only for files that you wrote yourself, as unpickling runs code."""
    return read_frames(spark, path, pd.read_pickle)
