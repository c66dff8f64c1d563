import datetime as dt
import multiprocessing

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import exceptions as E
from tidemark.operators.codec import TagSpec
from tidemark.plans.catalog import pack_options
from tidemark.sources import container, lock, store, tables
from tidemark.streaming.append import append_stream, read_appended

DAY = dt.datetime(2018, 1, 1)
US = np.datetime64(DAY, "us").astype(np.int64)
TAGS = {"depth": np.array([9, 0, 200, 31], np.uint8), "flow": np.array([-700, 12, 0, 45], np.int16), "temperature_raw": np.array([1.25, -3.5, 40.0, 0.1], np.float32)}


def test_golden_sizes():
    days = US + np.arange(4) * 86_400_000_000
    data = container.encode_file(days, TAGS)
    head = container.decode_header(data)
    assert (head.id_bytes, head.delta_unit, head.delta_bytes) == (60, "D", 1)
    assert len(data) == head.size + 3 + 28
    # Fixed values of the format: five numbered tags of these types, header sizes 231 and 230, byte sum 813.
    ids = {0: np.zeros(10, np.uint8), 1: np.zeros(10, np.int16), 2: np.zeros(10, np.float32), 255: np.zeros(10, np.int64), 256: np.zeros(10, np.float64)}
    grid = US + np.arange(10) * 3_600_000_000
    one, two = container.encode_file(grid, ids, step_seconds=3600), container.encode_file(grid, ids)
    assert container.decode_header(one).size == 231 and container.decode_header(two).size == 230
    records = one[9 : 9 + 5 * 42]
    assert sum(records) == 813
    times, back = container.decode_file(one)
    assert (times == grid).all() and sorted(back) == [0, 1, 2, 255, 256]


@pytest.mark.parametrize("mode", ["m", "e"])
@pytest.mark.parametrize(
    "values",
    [
        np.array([1, 2, 3, 4], np.uint32), np.array([10, -2, 0, -2000], np.int16), np.array([-128, 127], np.int8),
        np.array([0, 2**64 - 1, 5], np.uint64), np.array([-(2**63), 2**63 - 1, 0], np.int64), np.array([2.0**k for k in range(1, 17)]),
        np.array([], np.int64), np.array([7], np.int64), np.array([1.5, np.nan, 2.5]), np.array([np.nan, np.nan]), np.array([1, 2], np.float16),
    ],
)
def test_compressed_columns_come_back(values, mode):
    times = US + np.arange(len(values)) * 1_000_000
    spec = TagSpec("x", use_compression=True, mode=mode)
    _, back = container.decode_file(container.encode_file(times, {"x": values}, {"x": spec}))
    assert back["x"].dtype == values.dtype
    np.testing.assert_array_equal(back["x"], values)


def test_narrow_widths():
    powers = np.array([2.0**k for k in range(1, 17)])
    assert container.compress(powers, "e")[0].itemsize == 2 and container.compress(powers, "m")[0].itemsize == 4
    assert container.compress(np.array([5.2, 0.8, 3.1415, 8]), "m")[0].itemsize == 8
    assert container.compress(np.array([1000000, 1000001, 1000002, 1000005], np.uint64), "m")[0].tolist() == [0, 1, 2, 5]
    with pytest.raises(E.CompressionModeInvalidError):
        container.compress(powers, "x")


def test_rounded_without_compression_and_micro_start():
    times = US + 5 + np.arange(3) * 7
    spec = TagSpec("x", rounded=True, decimals=2)
    got, back = container.decode_file(container.encode_file(times, {"x": np.array([0.5, 10.2345, 0], np.float32), "y": np.arange(3)}, {"x": spec}))
    assert (got == times).all() and back["y"].tolist() == [0, 1, 2]
    np.testing.assert_allclose(back["x"], [0.5, 10.23, 0], rtol=1e-6)


def test_bad_files():
    with pytest.raises(E.DateDataError):
        container.encode_file(np.array([2, 1]), {"x": np.zeros(2)})
    with pytest.raises(E.DataShapeError):
        container.encode_file(np.array([1, 2]), {"x": np.zeros(3)})
    with pytest.raises(E.DateDataError):
        container.encode_file(US + np.array([0, 1, 3]) * 10**6, {"x": np.zeros(3)}, step_seconds=1)
    assert pack_options(True, False, True) == 5


def events(spark, n=200):
    rows = [(["a", "b"][i % 2], DAY + dt.timedelta(hours=i, microseconds=i), i, i * 7 % 13, i / 4) for i in range(n)]
    return spark.createDataFrame(rows, "box string, ts timestamp_ntz, id long, x long, y double")


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("mode", ["m", "e"])
def test_store(spark, tmp_path, mode):
    df, path = events(spark), str(tmp_path / "s")
    store.save(df, path, "ts", ["ts", "id"], ["box"], [TagSpec("x", use_compression=True, mode=mode), TagSpec("y", rounded=True, decimals=2)])
    assert same(df, store.load(spark, path))
    part = store.load(spark, path, ["x"], "2018-01-03 00:00:00", "2018-01-04 00:00:00")
    assert same(df.where("ts between '2018-01-03' and '2018-01-04'").drop("y"), part)
    store.save(df.limit(10), path, "ts", ["ts", "id"], ["box"])
    assert store.load(spark, path).count() == 10
    with pytest.raises(E.InvalidPandasDataTypeError):
        store.save(df.withColumn("z", F.lit("text")), path, "ts", ["ts", "id"], ["box"])


def test_containers(spark, tmp_path):
    df, path = events(spark), str(tmp_path / "c")
    made = container.write_containers(df.withColumn("i", F.col("id")), path, "ts", ["ts", "id"], "box", [TagSpec("x", use_compression=True, mode="e")]).collect()
    assert sum(r["n_points"] for r in made) == 200
    kinds = {"i": T.LongType(), "x": T.LongType(), "y": T.DoubleType()}
    want = df.select("ts", F.col("id").alias("i"), "x", "y")
    assert same(want, container.read_containers(spark, path, kinds))
    assert container.read_containers(spark, path, kinds, ["x"]).columns == ["path", "ts", "x"]
    heads = container.read_headers(spark, path)
    assert heads.where("tag = 'x' and use_compression and delta_unit = 'us'").count() == len([r for r in made if r["n_points"] > 0])
    spark.dataSource.register(container.ContainerSource)
    assert same(want, spark.read.format("tidemark").load(path))
    assert spark.read.format("tidemark").option("tags", "y").load(path).columns == ["path", "ts", "y"]


def test_files_refuse_what_they_cannot_hold(spark, tmp_path):
    df = events(spark, 20)
    for bad, error in (
        (df.withColumn("x", F.when(F.col("id") > 3, F.col("x"))), "has a null in box"),
        (df.withColumn("ts", F.when(F.col("id") > 3, F.col("ts"))), "null time"),
        (df.withColumn("y", F.when(F.col("id") == 3, F.lit(float("nan"))).otherwise(F.col("y"))), "can't be rounded"),
    ):
        with pytest.raises(Exception, match=error):
            container.write_containers(bad, str(tmp_path / "n"), "ts", ["ts", "id"], "box", [TagSpec("y", rounded=True, decimals=1)]).collect()
    with pytest.raises(Exception, match="not the grid"):
        container.write_containers(df, str(tmp_path / "g"), "ts", ["ts", "id"], "box", step_seconds=60).collect()
    odd = df.withColumn("box", F.element_at(F.array(F.lit("001"), F.lit("a/b"), F.lit(None), F.lit("")), (F.col("id") % 4 + 1).cast("int")))
    made = container.write_containers(odd, str(tmp_path / "o"), "ts", ["ts", "id"], "box").collect()
    assert {r["box"] for r in made} == {"001", "a/b", None, ""} and len({r["path"] for r in made}) == len(made)


def test_pandas_files(tmp_path):
    index = pd.to_datetime(["2020-02-01 07:05:00", "2020-02-01 06:55:00", "2020-02-01 07:00:00"])
    pdf, path = pd.DataFrame({"by": [3, 1, 2], "I": [1.5, np.nan, 2.5]}, index=index), str(tmp_path / "f.box")
    tables.save_pandas(pdf, path)
    assert tables.save_pandas(pdf.iloc[:1], path) == (tmp_path / "f.box").stat().st_size
    assert tables.save_pandas(pdf.sort_index(), path, step_seconds=300) == (tmp_path / "f.box").stat().st_size
    back = tables.load_pandas(path)
    pd.testing.assert_frame_equal(back[["by", "I"]], pdf.sort_index(), check_names=False, check_index_type=False, check_freq=False)
    for bad, error in ((pdf.reset_index(drop=True), E.InvalidPandasIndexError), (pdf.assign(t="x"), E.InvalidPandasDataTypeError)):
        with pytest.raises(error):
            tables.save_pandas(bad, path)


def test_pandas_and_csv(spark, tmp_path):
    index = pd.to_datetime(["2020-02-01 07:05:00", "2020-02-01 06:55:00", "2020-02-01 07:00:00"])
    pdf = pd.DataFrame({"as": [1, 2, 3], "I": [1.5, np.nan, 2.5], "u": np.array([0, 2**64 - 1, 5], np.uint64)}, index=index)
    df = tables.from_pandas(spark, pdf)
    assert df.columns == ["ts", "as", "I", "u"] and [r["as"] for r in df.collect()] == [2, 3, 1]
    back = tables.to_pandas(df)
    assert back.index.name == "DateTimes" and back.index.is_monotonic_increasing and int(back["u"].iloc[0]) == 2**64 - 1
    assert np.isnan(back["I"].iloc[0]) and back["as"].sum() == 6
    text = pdf.set_index(pdf.index.astype(str))
    assert tables.from_pandas(spark, text).count() == 3
    for bad in (pdf.reset_index(drop=True), pdf.set_index(pd.Index(["x", "y", "z"]))):
        with pytest.raises(E.InvalidPandasIndexError):
            tables.from_pandas(spark, bad)
    with pytest.raises(E.InvalidPandasDataTypeError):
        tables.from_pandas(spark, pdf.assign(t=["a", "b", "c"]))
    tables.write_csv(df.drop("u"), str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), df.drop("u").schema).count() == 3
    tables.write_pickle(df.drop("u"), str(tmp_path / "p"))
    assert tables.read_pickle(spark, str(tmp_path / "p")).count() == 3


def gaps(spark, n=50):
    """Ties in time, longs of the full range, and null beside NaN."""
    rows = [(DAY + dt.timedelta(hours=i // 3), i, None if i % 4 == 0 else 2**63 - 1 - i, None if i % 5 == 0 else float("nan") if i % 7 == 0 else i / 7) for i in range(n)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, id long, x long, y double").repartition(3)


def test_files_of_frames(spark, tmp_path):
    df, path = gaps(spark).drop("x"), str(tmp_path / "f")
    assert tables.write_frames(df, path, tables.save_pandas, rows=7) >= 8
    back = tables.read_frames(spark, path, tables.load_pandas)
    assert same(df.withColumn("y", F.coalesce("y", F.lit(float("nan")))), back)
    times = [r["ts"] for r in back.collect()]
    assert times == sorted(times)
    assert tables.write_frames(df.limit(0), path, tables.save_pandas) == 1
    assert tables.read_frames(spark, path, tables.load_pandas).schema == back.schema and tables.read_frames(spark, path, tables.load_pandas).count() == 0
    with pytest.raises(Exception, match="integer columns of a file can't hold"):
        tables.write_frames(gaps(spark), path, tables.save_pandas)
    with pytest.raises(E.InvalidPandasDataTypeError):
        tables.write_frames(df.withColumn("z", F.lit("text")), path, tables.save_pandas)
    assert [p.name for p in tmp_path.iterdir()] == ["f"]


def test_frames_keep_nulls_and_nan(spark):
    df = gaps(spark).withColumn("u", F.lit("18446744073709551615").cast("decimal(20,0)"))
    back = tables.from_frames(df, tables.indexed)
    assert back.schema == tables.from_pandas(spark, tables.indexed(pd.DataFrame({"ts": [DAY], "id": [1], "x": [2], "y": [0.5], "u": np.array([1], np.uint64)}))).schema
    assert same(df, back) and back.columns == ["ts", "id", "u", "x", "y"]


def test_texts_of_frames_are_parsed(spark):
    df = gaps(spark).select("id", F.col("ts").cast("string").alias("text"))
    make = lambda rows: rows.set_index("text")
    assert same(gaps(spark).select("ts", "id"), tables.from_frames(df, make))
    with pytest.raises(Exception, match="the index is not a time"):
        tables.from_frames(df.withColumn("text", F.lit("x")), make).count()


def test_pickles_of_frames(spark, tmp_path):
    path, one = str(tmp_path / "p"), str(tmp_path / "one.pickle")
    for n in (50, 20):
        tables.write_pickle(gaps(spark, n), path)
        assert same(gaps(spark, n), tables.read_pickle(spark, path))
    pd.DataFrame({"x": [1, 2]}, index=pd.to_datetime(["2020-01-02", "2020-01-01"])).to_pickle(one)
    assert [r["x"] for r in tables.read_pickle(spark, one).collect()] == [2, 1]


def _hold(path, mode, ready, done):
    with lock.locked(path, mode):
        ready.set()
        done.wait(20)


@pytest.mark.parametrize("held, asked, ok", [("r", "r", True), ("r", "w", False), ("w", "r", False), ("w", "w", False)])
def test_locks(tmp_path, held, asked, ok):
    path = str(tmp_path / "f")
    open(path, "w").write("kept")
    context = multiprocessing.get_context("fork")
    ready, done = context.Event(), context.Event()
    other = context.Process(target=_hold, args=(path, held, ready, done))
    other.start()
    assert ready.wait(20)
    try:
        if ok:
            with lock.locked(path, asked, wait=0.3):
                pass
        else:
            with pytest.raises(E.CouldNotAcquireFileLockError), lock.locked(path, asked, wait=0.3):
                pass
    finally:
        done.set()
        other.join()
    with lock.locked(path, "w", wait=1):
        pass
    assert open(path).read() == "kept"
    with pytest.raises(ValueError), lock.locked(path, "x"):
        pass


def test_stream_append(spark, tmp_path):
    df = events(spark, 60)
    for k in range(3):
        df.where(f"id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "ts", ["box"], "x")
    query.awaitTermination(60)
    assert same(df, read_appended(spark, str(tmp_path / "out"), "x"))


def test_stream_keeps_tags_named_like_its_own_columns(spark, tmp_path):
    df = events(spark, 20).withColumns({"block": F.col("id"), "batch": F.col("x"), "encoded": F.lit(1), "ref": F.lit(2)})
    df.withColumn("x", F.when(F.col("id") > 5, F.col("x"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "ts", ["box"], "x").awaitTermination(60)
    assert same(spark.read.parquet(str(tmp_path / "in")), read_appended(spark, str(tmp_path / "out"), "x"))


@pytest.mark.parametrize("kind", ["double", "float"])
@pytest.mark.parametrize("mode", ["m", "e"])
def test_store_keeps_floats_exactly(spark, tmp_path, mode, kind):
    odd = [0.1, -1000.0, 2.0**-50, 1e-30, float("nan"), 560.21, None, 0.3, float("inf"), -0.1, float("-inf"), 1e16] + [0.07 * k % 1.3 for k in range(300)]
    rows = [("a", DAY + dt.timedelta(minutes=i), i, x) for i, x in enumerate(odd)]
    df = spark.createDataFrame(rows, "box string, ts timestamp_ntz, id long, x double").withColumn("x", F.col("x").cast(kind))
    store.save(df, str(tmp_path / "s"), "ts", ["ts", "id"], ["box"], [TagSpec("x", use_compression=True, mode=mode)])
    assert same(df, store.load(spark, str(tmp_path / "s")))
    part = store.load(spark, str(tmp_path / "s"), None, "2018-01-01 01:00:00", "2018-01-01 02:00:00")
    assert same(df.where("ts between '2018-01-01 01:00:00' and '2018-01-01 02:00:00'"), part)


def test_stream_keeps_floats_exactly(spark, tmp_path):
    df = events(spark, 60).withColumn("x", F.when(F.col("id") % 12 < 2, -1000.1).otherwise(F.col("id") / 7))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "ts", ["box"], "x").awaitTermination(60)
    assert same(df, read_appended(spark, str(tmp_path / "out"), "x"))
