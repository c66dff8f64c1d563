import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tidemark import exceptions as E
from tidemark.operators import codec as C
from tidemark.operators import projection as P
from tidemark.operators import timeindex as X
from tidemark.plans import catalog as K

DAY = dt.datetime(2018, 1, 1)


def series(spark, times, box=None):
    rows = [("a" if box is None else box[i], t, i) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "box string, ts timestamp_ntz, ord long")


def deltas(spark, times):
    return X.time_deltas(series(spark, times), "ts", ["ts", "ord"], ["box"])


@pytest.mark.parametrize(
    "hours, unit, values, width",
    [
        ([0, 24, 48, 96], "D", [1, 1, 2], 1),
        ([0, 36, 53, 96], "h", [36, 17, 43], 1),
        ([0, 1, 1.5, 1.5 + 1 / 120], "s", [3600, 1800, 30], 2),
        ([0], "D", [], 1),
        ([5, 5, 5], "D", [0, 0], 1),
    ],
)
def test_units_of_deltas(spark, hours, unit, values, width):
    found = deltas(spark, [DAY + dt.timedelta(hours=h) for h in hours])
    units = X.delta_units(found, ["box"])
    row = units.first()
    assert (row["unit"], row["delta_bytes"]) == (unit, width)
    encoded = X.encode_deltas(found, units, ["box"]).where("delta is not null").orderBy("ord")
    assert [r["delta"] for r in encoded.collect()] == values


def test_order_check(spark):
    times = [DAY, DAY + dt.timedelta(hours=36), DAY + dt.timedelta(hours=5), DAY + dt.timedelta(days=4)]
    df = series(spark, times)
    assert X.order_violations(df, "ts", "ord", ["box"], block=2).first()["n_backward"] == 1
    with pytest.raises(E.DateDataError):
        X.require_order(df, "ts", "ord", ["box"])
    X.require_order(series(spark, sorted(times)), "ts", "ord", ["box"])


def test_grid(spark):
    spans = spark.createDataFrame([("a", DAY, DAY + dt.timedelta(days=3, hours=1)), ("b", DAY, DAY)], "box string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    rows = X.regular_grid(spans, 3600, ["box"]).orderBy("box", "ts").collect()
    assert [r["ts"] for r in rows if r["box"] == "a"] == [DAY + dt.timedelta(hours=h) for h in range(74)]
    assert [r["ts"] for r in rows if r["box"] == "b"] == [DAY]
    with pytest.raises(E.DateDataError):
        X.regular_grid(spans, 0, ["box"])


def test_blocks_agree_with_one_window(spark):
    rng = np.random.default_rng(0)
    secs = rng.integers(-(10**6), 10**6, 400)
    rows = [(["a", "b", None][i % 3], DAY.replace(year=1970) + dt.timedelta(seconds=int(s)), i, int(rng.integers(-50, 50)) if i % 7 else None) for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "box string, ts timestamp_ntz, ord long, x long")
    got = {r["ord"]: (r["p"], r["s"]) for r in X.with_running_sum(X.with_previous(df, "ts", ["ts", "ord"], {"p": "x"}, ["box"]), "ts", ["ts", "ord"], "x", "s", ["box"]).collect()}
    want, last, total = {}, {}, {}
    for b, _, o, x in sorted(rows, key=lambda r: (r[1], r[2])):
        total[b] = total.get(b, 0) + (x or 0)
        want[o] = (last.get(b), total[b])
        last[b] = x
    assert got == want


def test_rows_without_a_time_stay(spark):
    times = [None, DAY, None, DAY + dt.timedelta(hours=30), DAY + dt.timedelta(hours=1)]
    df = series(spark, times)
    got = {r["ord"]: r["delta_us"] for r in X.time_deltas(df, "ts", ["ts", "ord"], ["box"]).collect()}
    assert got == {0: None, 1: None, 2: None, 3: 29 * 3_600_000_000, 4: 3_600_000_000}
    sums = {r["ord"]: r["s"] for r in X.with_running_sum(df, "ts", ["ts", "ord"], "ord", "s", ["box"]).collect()}
    assert sums == {0: 0, 2: 2, 1: 3, 4: 7, 3: 10}
    report = K.validation_report(df, "ts", "ord", ["box"]).first()
    assert (report["n_points"], report["n_deltas"], report["null_times"], report["valid"]) == (5, 2, 2, False)
    encoded = X.encode_deltas(X.time_deltas(df, "ts", ["ts", "ord"], ["box"]), X.time_units(df, "ts", ["box"]), ["box"])
    back = X.rebuild_times(encoded, X.box_span(df, "ts", ["box"]), "ts", ["ts", "ord"], ["box"])
    assert back.where("not ts <=> rebuilt_ts").count() == 0 and back.count() == 5


def test_blocks_are_sized_by_rows(spark):
    df = series(spark, [DAY + dt.timedelta(seconds=i) for i in range(100)] + [None] * 90)
    assert [X.block_for(df, "ts", ["box"], most) for most in (100, 60, 59, 1, 0)] == [86_400_000_000, 60_000_000, 1_000_000, 1_000_000, 1]


def test_time_order(spark):
    rng = np.random.default_rng(1)
    df = series(spark, [DAY + dt.timedelta(seconds=int(s)) for s in rng.integers(0, 50, 300)]).repartition(4)
    got = [(r["ts"], r["ord"]) for r in P.in_time_order(df, "ts", ["ord"]).collect()]
    assert got == sorted(got) and len(got) == 300


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 10**12), max_size=20), st.sampled_from([1, 1000, 10**6, 3600 * 10**6, 86400 * 10**6]))
def test_time_round_trip(spark, offsets, scale):
    times = sorted(DAY + dt.timedelta(microseconds=(o % 10**6) * scale) for o in offsets if (o % 10**6) * scale < 10**17)
    df = series(spark, times)
    found = X.time_deltas(df, "ts", ["ts", "ord"], ["box"])
    encoded = X.encode_deltas(found, X.delta_units(found, ["box"]), ["box"])
    back = X.rebuild_times(encoded, X.box_span(df, "ts", ["box"]), "ts", ["ts", "ord"], ["box"])
    assert back.where("not ts <=> rebuilt_ts").count() == 0 and back.count() == len(times)


def column(spark, values, kind):
    rows = [("a", DAY + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("box", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("x", kind)]))


@pytest.mark.parametrize(
    "values, mode, ref, encoded, width",
    [
        ([1, 2, 3, 4], "e", 1, [None, 1, 1, 1], 1),
        ([1, 2, 3, 4], "m", 1, [0, 1, 2, 3], 1),
        ([-4, -2, 0, 2000], "e", -4, [None, 2, 2, 2000], 2),
        ([-4, -2, 0, 2000], "m", -4, [0, 2, 4, 2004], 2),
        ([10, -2, 0, -2000], "e", 10, [None, -12, 2, -2000], 2),
        ([10, -2, 0, 2000], "m", -2, [12, 0, 2, 2002], 2),
    ],
)
def test_integer_codecs(spark, values, mode, ref, encoded, width):
    out = C.encode(column(spark, values, T.LongType()), "x", mode, "ts", ["ts"], ["box"])
    rows = out.orderBy("ts").collect()
    assert [r["encoded"] for r in rows] == encoded and {r["ref"] for r in rows} == {ref}
    assert C.encoded_width(out, ["box"]).first()["narrow_bytes"] == width
    assert C.decode(out, mode, "ts", ["ts"], ["box"]).where("decoded <> x").count() == 0


def test_nan_stays_out_of_the_reference(spark):
    out = C.encode(column(spark, [2.0, float("nan"), 1.0, None], T.DoubleType()), "x", "m", "ts", ["ts"], ["box"]).orderBy("ts").collect()
    assert out[0]["ref"] == 1.0 and out[0]["encoded"] == 1.0 and np.isnan(out[1]["encoded"]) and out[3]["encoded"] is None


@pytest.mark.parametrize("mode", ["m", "e"])
def test_rounded_codec(spark, mode):
    spec = C.TagSpec("x", use_compression=True, mode=mode, rounded=True, decimals=2)
    out = C.encode_tag(column(spark, [0.5, -0.5, 10.2345, 0.0], T.DoubleType()), spec, "ts", ["ts"], ["box"])
    if mode == "m":
        assert [r["encoded"] for r in out.orderBy("ts").collect()] == [100, 0, 1073, 50] and out.first()["ref"] == -50
    back = C.decode_tag(out, spec, T.DoubleType(), "ts", ["ts"], ["box"]).orderBy("ts").collect()
    assert [r["decoded"] for r in back] == [0.5, -0.5, 10.23, 0.0]


def test_codec_guards(spark):
    with pytest.raises(E.CompressionModeInvalidError):
        C.TagSpec("x", mode="z")
    with pytest.raises(E.CompressionError):
        C.references(spark.createDataFrame([("a", "b")], "box string, x string"), "x", "m", ["x"], ["box"])
    assert C.is_identity(T.ByteType(), 5, "m") and C.is_identity(T.LongType(), 1, "e") and not C.is_identity(T.LongType(), 1, "m")


def test_catalog(spark):
    assert K.header_bytes(5, 2, False) == 231 and K.header_bytes(5, 2, True) == 230
    assert [K.pack_options(*K.unpack_options(k, 3)) for k in range(8)] == list(range(8))
    for size, text in ((0, True), (6, True), (-4, True), (3, False), (256, True)):
        with pytest.raises(E.TagIdentifierByteRepresentationError):
            K.check_identifier_bytes(size, text)
    df = column(spark, [1], T.LongType())
    K.validate_schema(df, {"x": T.LongType()})
    for declared in ({"y": T.LongType()}, {"x": T.IntegerType()}):
        with pytest.raises(E.DataDoesNotMatchTagDefinitionError):
            K.validate_schema(df, declared)
    long = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "tag string, v int")
    with pytest.raises(E.DataShapeError):
        K.validate_lengths(long, "tag", 2)
    units = X.delta_units(deltas(spark, [DAY, DAY + dt.timedelta(seconds=300)]), ["box"])
    K.validate_deltas(units, 8)
    with pytest.raises(E.DateDataError):
        K.validate_step(0)
    with pytest.raises(E.DateDataError):
        K.validate_deltas(X.delta_units(deltas(spark, [DAY, DAY + dt.timedelta(days=300)]), ["box"]), 1)


def test_projection(spark):
    df = spark.createDataFrame([(DAY, 1, 2, 3)], "ts timestamp_ntz, `by` int, I int, `as` int")
    assert P.canonical(df, "ts").columns == ["DateTimes", "I", "as", "by"]
    assert P.select_tags(df, "ts", ["by", "I"]).columns == ["ts", "I", "by"]
    plan = P.time_range(df, "ts", "2018-01-01 00:00:00", "2018-01-02 00:00:00")
    assert plan.count() == 1 and P.time_range(df, "ts", "2018-01-02 00:00:00").count() == 0
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in P.without_nan(nan, "x").collect()] == [1.0]


ODD_FLOATS = [0.1, -1000.0, 2.0**-50, 1e-300, float("nan"), 560.21, None, 0.3, float("inf"), -0.1, 5e-324, float("-inf"), 1e16, 1.0, 29.27]


@pytest.mark.parametrize("kind", [T.DoubleType(), T.FloatType()])
@pytest.mark.parametrize("mode", ["m", "e"])
@pytest.mark.parametrize("values", [ODD_FLOATS, [1.7e308, -1.7e308, 0.1], [0.07 * k % 1.3 for k in range(300)], [None, float("nan")]])
def test_floats_decode_exactly(spark, values, mode, kind):
    with np.errstate(over="ignore"):
        df = column(spark, [x if x is None or kind == T.DoubleType() else float(np.float32(x)) for x in values], kind)
    out = C.encode(df, "x", mode, "ts", ["ts"], ["box"])
    back = C.decode(out, mode, "ts", ["ts"], ["box"])
    assert back.schema["decoded"].dataType == kind
    assert back.where("not decoded <=> x").count() == 0 and back.count() == len(values)


def test_parts_of_a_sum_may_overflow(spark):
    rows = [("a", DAY + dt.timedelta(hours=i), 2**62 * (-1) ** i) for i in range(20)]
    df = spark.createDataFrame(rows, "box string, ts timestamp_ntz, step long").repartitionByRange(2, "step")
    sums = X.with_running_sum(df, "ts", ["ts"], "step", "s", ["box"])
    assert [r["s"] for r in sums.orderBy("ts").collect()] == [2**62, 0] * 10 and sums.schema["s"].dataType == T.LongType()
