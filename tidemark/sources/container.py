"""The binary container format: one file holds a header, time deltas and the columns of one series.

Files are decoded and encoded as arrays, one file at a time, on executors. ``read_containers`` lists and reads files with Spark's
binary source, so any file system that Spark knows works; ``write_containers`` writes one file per box and time block, so
no task holds a whole box. Format version 1 has whole-second starts; version 2 is the same with the start in microseconds and is
used only where version 1 would lose part of it.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.exceptions import CompressionError, CompressionModeInvalidError, DataShapeError, DateDataError
from tidemark.functions.types import identifier_bytes, numpy_type, spark_type, type_of_spark
from tidemark.functions.units import MICRO_UNITS, unit
from tidemark.functions.widths import signed_bytes, unsigned_bytes
from tidemark.operators.codec import TagSpec
from tidemark.operators.timeindex import with_block
from tidemark.plans.catalog import check_identifier_bytes, pack_options, unpack_options
from tidemark.session import qualified

SECOND_STARTS, MICRO_STARTS = 1, 2
_OPTION_BYTES = 32


@dataclass
class TagHeader:
    """One tag record of a file."""

    name: str | int
    char: str
    size: int
    spec: TagSpec
    mode: str = "m"
    narrow: tuple[str, int] | None = None
    ref: np.generic | None = None


@dataclass
class Header:
    """What a file says about itself before its data."""

    n_points: int
    id_bytes: int
    names_are_text: bool
    deltas_stored: bool
    start_us: int
    tags: list[TagHeader] = field(default_factory=list)
    delta_bytes: int = 1
    delta_unit: str = "D"
    step_seconds: int = 0
    size: int = 0


def _narrow_ints(values: np.ndarray) -> np.ndarray:
    least, most = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    kind = f"<i{signed_bytes(max(-least, most))}" if least < 0 else f"<u{unsigned_bytes(most)}"
    return values.astype(kind)


def _narrow_floats(values: np.ndarray) -> np.ndarray:
    """The narrowest float that gives the same values back, NaN aside, without subnormals on the way."""
    real = values[~np.isnan(values)]
    for size in (2, 4):
        if size >= values.dtype.itemsize:
            break
        with np.errstate(over="ignore"):
            tried = real.astype(f"<f{size}")
        tiny = np.finfo(f"f{size}").tiny
        if (tried.astype(values.dtype) == real).all() and ((real == 0) | (np.abs(real) >= tiny)).all():
            with np.errstate(over="ignore", invalid="ignore"):
                return values.astype(f"<f{size}")
    return values


def compress(values: np.ndarray, mode: str) -> tuple[np.ndarray, np.generic | None]:
    """Narrow array and reference; the reference is null where a codec would not help and the values come back as they are.

    Mode 'e' gives one value less. NaN stays out of the minimum and passes through 'm'; a float column with
    infinities, or in 'e' with NaN, is left alone.
    """
    if mode not in ("m", "e"):
        raise CompressionModeInvalidError(f"codec mode {mode!r} is neither 'm' nor 'e'")
    small = (values.dtype.kind in "iu" and values.dtype.itemsize == 1) or values.dtype == np.float16
    if small or not len(values) or (mode == "e" and len(values) == 1):
        return values, None
    if values.dtype.kind == "f":
        if np.isinf(values).any() or (mode == "e" and np.isnan(values).any()):
            return values, None
        if np.isnan(values).all():
            return values.astype("<f2"), values.dtype.type(0)
        ref = values.dtype.type(np.nanmin(values) if mode == "m" else values[0])
        return _narrow_floats(values - ref if mode == "m" else np.diff(values)), ref
    ref = values.min() if mode == "m" else values[0]
    # Differences of 64-bit values can need 65 bits; only then are they taken as Python integers.
    tame = -(2**62) <= int(values.min()) and int(values.max()) < 2**62
    wide = values.astype(np.int64 if tame else object)
    diffs = wide - int(ref) if mode == "m" else np.diff(wide)
    if not tame and (min(diffs) < -(2**63) or max(diffs) >= 2**64 or (min(diffs) < 0 and max(diffs) >= 2**63)):
        return values, None
    as_kind = np.int64 if len(diffs) and diffs.min() < 0 else np.uint64
    return _narrow_ints(diffs.astype(as_kind)), ref


def decompress(values: np.ndarray, mode: str, ref: np.generic, kind: np.dtype) -> np.ndarray:
    """The inverse, in the widest type, then cast to ``kind``."""
    if kind.kind == "f":
        wide = values.astype(np.float64)
        return (wide + float(ref) if mode == "m" else np.concatenate([[float(ref)], float(ref) + np.cumsum(wide)])).astype(kind)
    wide = values.astype(np.int64).view(np.uint64) if values.dtype.kind == "i" else values.astype(np.uint64)
    base = np.array([int(ref) % 2**64], np.uint64)
    out = wide + base[0] if mode == "m" else np.concatenate([base, base[0] + np.cumsum(wide, dtype=np.uint64)])
    return (out.view(np.int64) if kind.kind == "i" else out).astype(kind)


def _id_bytes(name: str | int, size: int, is_text: bool) -> bytes:
    return str(name).encode("utf-32-le").ljust(size, b"\0") if is_text else int(name).to_bytes(size, "little")


def _tag_record(tag: TagHeader, id_bytes: int, is_text: bool) -> bytes:
    check_identifier_bytes(id_bytes, is_text)
    options = b""
    if tag.spec.use_compression and tag.ref is not None:
        char, size = tag.narrow
        ref = np.asarray(tag.ref)
        options += struct.pack("<BBBBB", ord(tag.mode), size, ord(char), ref.itemsize, ord(ref.dtype.kind)) + ref.tobytes()
    if tag.spec.rounded:
        options += struct.pack("<B", tag.spec.decimals)
    flags = pack_options(tag.spec.use_compression and tag.ref is not None, tag.spec.use_hash_table, tag.spec.rounded)
    return _id_bytes(tag.name, id_bytes, is_text) + struct.pack("<HBBI", flags, tag.size, ord(tag.char), 0) + options.ljust(_OPTION_BYTES, b"\0")


def encode_file(times_us: np.ndarray, columns: dict[str, np.ndarray] | dict[int, np.ndarray], specs: dict | None = None, step_seconds: int = 0) -> bytes:
    """The file of one series in time order; with ``step_seconds`` a regular grid without stored deltas."""
    n = len(times_us)
    names = sorted(columns)
    if len(names) > 255:
        raise DataShapeError("a file holds 255 tags at most")
    is_text = all(isinstance(x, str) for x in names)
    id_bytes = identifier_bytes(names)
    deltas = np.diff(times_us)
    if (deltas < 0).any():
        raise DateDataError("times are not in order")
    if step_seconds and (deltas != step_seconds * 1_000_000).any():
        raise DateDataError("times are not the grid that the step says")
    records, chunks = b"", b""
    for name in names:
        values = np.asarray(columns[name])
        if len(values) != n:
            raise DataShapeError(f"tag {name} has {len(values)} values, not {n}")
        spec = (specs or {}).get(name, TagSpec(str(name)))
        tag = TagHeader(name, values.dtype.kind, values.dtype.itemsize, spec, spec.mode)
        stored = values
        if spec.rounded:
            scaled = np.abs(values.astype(np.float64)) * 10.0**spec.decimals
            if not (scaled < 2**63).all():
                raise CompressionError(f"tag {name} can't be rounded: it holds NaN or numbers that no 64-bit integer stands for")
            stored = np.rint(values.astype(np.float64) * 10.0**spec.decimals).astype(np.int64)
        if spec.use_compression:
            stored, tag.ref = compress(stored, spec.mode)
        tag.narrow = (stored.dtype.kind, stored.dtype.itemsize)
        records += _tag_record(tag, id_bytes, is_text)
        chunks += stored.astype(stored.dtype.newbyteorder("<")).tobytes()
    start = int(times_us[0]) if n else 0
    version = SECOND_STARTS if start % 1_000_000 == 0 else MICRO_STARTS
    head = struct.pack("<BHBIB", version, pack_options(is_text, not step_seconds), len(names), n, id_bytes) + records
    head += struct.pack("<q", start // 1_000_000 if version == SECOND_STARTS else start)
    if step_seconds:
        return head + struct.pack("<I", step_seconds) + chunks
    scale = next(u for u in reversed(MICRO_UNITS) if not (deltas % (u.nanoseconds // 1000)).any())
    coarse = deltas // (scale.nanoseconds // 1000)
    width = unsigned_bytes(int(coarse.max()) if len(coarse) else 0)
    return head + struct.pack("<BH", width, scale.code) + coarse.astype(f"<u{width}").tobytes() + chunks


def decode_header(data: bytes) -> Header:
    """Header of a file; ``size`` is its length in bytes, where the deltas start."""
    version, options, n_tags, n_points, id_bytes = struct.unpack_from("<BHBIB", data)
    is_text, deltas_stored = unpack_options(options, 2)
    at, tags = 9, []
    for _ in range(n_tags):
        raw, at = data[at : at + id_bytes], at + id_bytes
        name = raw.decode("utf-32-le").rstrip("\0") if is_text else int.from_bytes(raw, "little")
        flags, size, char, _ = struct.unpack_from("<HBBI", data, at)
        compressed, hashed, rounded = unpack_options(flags, 3)
        k, tag = at + 8, TagHeader(name, chr(char), size, TagSpec(str(name)))
        if compressed:
            mode, width, narrow, ref_size, ref_char = struct.unpack_from("<BBBBB", data, k)
            tag.mode, tag.narrow = chr(mode), (chr(narrow), width)
            tag.ref = np.frombuffer(data, np.dtype(f"<{chr(ref_char)}{ref_size}"), 1, k + 5)[0]
            k += 5 + ref_size
        decimals = data[k] if rounded else 0
        tag.spec = TagSpec(str(name), compressed, tag.mode if compressed else "m", hashed, rounded, decimals)
        tags.append(tag)
        at += 40
    start = struct.unpack_from("<q", data, at)[0] * (1_000_000 if version == SECOND_STARTS else 1)
    head = Header(n_points, id_bytes, is_text, deltas_stored, start, tags)
    at += 8
    if deltas_stored:
        head.delta_bytes, code = struct.unpack_from("<BH", data, at)
        head.delta_unit, at = unit(code).name, at + 3
    else:
        head.step_seconds, at = struct.unpack_from("<I", data, at)[0], at + 4
    head.size = at
    return head


def decode_times(data: bytes, head: Header) -> tuple[np.ndarray, int]:
    """Microseconds of all points, and where the columns start."""
    n = head.n_points
    if not head.deltas_stored:
        return head.start_us + np.arange(n, dtype=np.int64) * (head.step_seconds * 1_000_000), head.size
    count = max(n - 1, 0)
    deltas = np.frombuffer(data, f"<u{head.delta_bytes}", count, head.size).astype(np.int64)
    per = unit(head.delta_unit).nanoseconds
    if per < 1000 and (deltas % 1000).any():
        raise DateDataError("times finer than microseconds can't be kept")
    micros = deltas * (per // 1000) if per >= 1000 else deltas // 1000
    times = head.start_us + np.concatenate([[0], np.cumsum(micros)]).astype(np.int64)
    return times[:n], head.size + count * head.delta_bytes


def decode_file(data: bytes, tags: list[str] | None = None) -> tuple[np.ndarray, dict[str | int, np.ndarray]]:
    """Times in microseconds and the chosen columns (all by default); other columns are skipped, not decoded."""
    head = decode_header(data)
    times, at = decode_times(data, head)
    out: dict[str | int, np.ndarray] = {}
    for tag in head.tags:
        kind = numpy_type(tag.char, tag.size)
        spec = tag.spec
        stored = np.dtype(f"<{tag.narrow[0]}{tag.narrow[1]}") if spec.use_compression else np.dtype("<i8") if spec.rounded else kind
        count = max(head.n_points - 1, 0) if spec.use_compression and tag.mode == "e" else head.n_points
        if tags is None or str(tag.name) in tags:
            values = np.frombuffer(data, stored, count, at)
            if spec.use_compression:
                values = decompress(values, tag.mode, tag.ref, np.dtype("<i8") if spec.rounded else kind)
            out[tag.name] = (values / 10.0**spec.decimals).astype(kind) if spec.rounded else values.astype(kind)
        at += count * stored.itemsize
    return times, out


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per tag of each file under ``path``: the box and tag catalogs side by side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                h = decode_header(bytes(content))
                rows += [
                    (where, h.n_points, len(h.tags), h.id_bytes, h.names_are_text, h.deltas_stored, h.start_us, h.delta_unit if h.deltas_stored else None,
                     h.delta_bytes if h.deltas_stored else None, h.step_seconds or None, h.size, str(t.name), t.char, t.size, t.spec.use_compression, t.spec.rounded)
                    for t in h.tags
                ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])

    columns = (
        "path string, n_points long, n_tags int, id_bytes int, id_is_string boolean, deltas_stored boolean, start_us long, delta_unit string, "
        "delta_bytes int, step_seconds long, header_bytes int, tag string, type_char string, bytes_per_value int, use_compression boolean, rounded boolean"
    )
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, columns)


def _arrow(times: np.ndarray, columns: dict, names: list[str], schema: pa.Schema, where: str) -> pa.RecordBatch:
    arrays = [pa.array([where] * len(times), pa.string()), pa.array(times.view("datetime64[us]"), pa.timestamp("us"))]
    by_name = {str(k): v for k, v in columns.items()}
    for name, kind in zip(names, schema.types[2:], strict=True):
        values = by_name.get(name)
        if values is None:
            arrays.append(pa.nulls(len(times), kind))
        elif pa.types.is_decimal(kind):
            arrays.append(pa.array([Decimal(int(x)) for x in values], kind))
        else:
            arrays.append(pa.array(values.astype(kind.to_pandas_dtype())))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def read_containers(spark: SparkSession, path: str, schema: dict[str, T.DataType], tags: list[str] | None = None) -> DataFrame:
    """path, ts and the tags of all files under ``path``; ``schema`` gives the tags' Spark types.

    Only the chosen tags are decoded; files without a tag give nulls for it.
    """
    names = [n for n in sorted(schema) if tags is None or n in tags]
    fields = T.StructType([T.StructField("path", T.StringType()), T.StructField("ts", T.TimestampNTZType()), *[T.StructField(n, schema[n]) for n in names]])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1), strict=True):
                times, columns = decode_file(content.as_py(), names)
                yield _arrow(times, columns, names, arrow, where.as_py())

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, fields)


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _box_folder(name: str, value: object) -> str:
    """A folder name that stands for one box value: text is percent-encoded, a null is a lone sign that no text gives."""
    return f"{quote(name, safe='')}={'%' if value is None else quote(str(value), safe='')}"


def write_containers(
    df: DataFrame, path: str, ts: str, order: list[str], box: str, specs: list[TagSpec] | None = None, step_seconds: int = 0, integer_ids: bool = False
) -> DataFrame:
    """Write one file per box and day to the folder (or URI) ``path``; returns box, block, path, n_points, bytes.

    With ``step_seconds`` the files are regular grids without stored times (other times are an error); with ``integer_ids`` the
    tags are named by numbers and stored so. The format has no null: a null time or a null in an integer column is an error, and a null
    float is stored as NaN. A path without a scheme lies in the session's default file system. Each file is written under a temporary name
    and then moved, so a lost task leaves no half file under a final name.
    """
    tags = sorted(c for c in df.columns if c not in {ts, box, *order})
    kinds = [type_of_spark(df.schema[t].dataType) for t in tags]
    keys = [int(t) if integer_ids else t for t in tags]
    by_name = {(int(s.name) if integer_ids else s.name): s for s in specs or []}
    root_uri, at = qualified(df.sparkSession, path), f"o{order.index(ts)}"
    by_order = [f"o{i}" for i in range(len(order))]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        value = None if pdf["b"].isna().iloc[0] else pdf["b"].iloc[0]
        if pdf[at].isna().any():
            raise DateDataError(f"box {value!r} has a null time")
        pdf = pdf.sort_values(by_order, kind="stable")
        columns = {}
        for i, (tag, kind) in enumerate(zip(keys, kinds, strict=True)):
            if kind[0] != "f" and pdf[f"t{i}"].isna().any():
                raise DataShapeError(f"tag {tag} has a null in box {value!r}, which integer columns of a file can't hold")
            columns[tag] = pdf[f"t{i}"].to_numpy().astype(numpy_type(*kind))
        data = encode_file(pdf[at].to_numpy().astype("datetime64[us]").astype(np.int64), columns, by_name, step_seconds)
        system, root = _file_system(root_uri)
        folder, block = f"{root}/{_box_folder(box, value)}", int(pdf["k"].iloc[0])
        system.create_dir(folder, recursive=True)
        final = f"{folder}/{block}.box"
        with system.open_output_stream(f"{final}.tmp") as out:
            out.write(data)
        system.move(f"{final}.tmp", final)
        name = None if value is None else str(value)
        return pd.DataFrame({"box": [name], "block": [block], "path": [final], "n_points": [len(pdf)], "bytes": [len(data)]})

    plain = df.select(F.col(f"`{box}`").alias("b"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)], *[F.col(f"`{t}`").alias(f"t{i}") for i, t in enumerate(tags)])
    return with_block(plain, at, name="k").groupBy("b", "k").applyInPandas(run, "box string, block long, path string, n_points long, bytes long")


class ContainerSource(DataSource):
    """``spark.read.format("tidemark")``: one partition per file; option ``tags`` (comma-joined) prunes columns."""

    @classmethod
    def name(cls) -> str:
        return "tidemark"

    def _files(self) -> list[str]:
        system, root = _file_system(_uri(self.options["path"]))
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".box"))

    def schema(self) -> T.StructType:
        files = self._files()
        head = decode_header(_load(self.options["path"], files[0])) if files else Header(0, 4, True, True, 0)
        wanted = self.options.get("tags")
        keep = [t for t in head.tags if not wanted or str(t.name) in wanted.split(",")]
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("ts", T.TimestampNTZType()), *[T.StructField(str(t.name), spark_type(t.char, t.size)) for t in keep]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._files(), schema)


def _uri(path: str) -> str:
    """The data source runs without a session, so it can't ask for the default file system: paths without a scheme are local."""
    return path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:"))


def _load(path: str, file: str) -> bytes:
    system = _file_system(_uri(path))[0]
    with system.open_input_stream(file) as f:
        return f.read()


class _Reader(DataSourceReader):
    def __init__(self, path: str, files: list[str], schema: T.StructType) -> None:
        self.path, self.files, self.fields = path, files, schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is not None:
            names = self.fields.names[2:]
            times, columns = decode_file(_load(self.path, partition.value), names)
            yield _arrow(times, columns, names, to_arrow_schema(self.fields), partition.value)
