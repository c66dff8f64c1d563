"""The time index of series: order, differences, units, widths, rebuild and regular grids.

A series ("box") is the rows of one key, ordered by time and a tie-breaker. No operator needs a box in one task: rows
are dealt by (box, block), where a block is a fixed stretch of time, and what crosses a block border (the last row before it, the
sum before it) comes from one row per block, joined back. ``block_for`` gives a stretch that bounds a block's rows; the default is a
day. Time zones play no part: times count microseconds since 1970 as they are written. Rows with a null time are kept: they are a block
of their own before all others and have no difference. Columns that the operators need for themselves begin with ``__tm_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.exceptions import DateDataError
from tidemark.functions.units import MICRO_UNITS, micros
from tidemark.functions.widths import unsigned_width

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
DAY_US = 86_400_000_000
#: Rows of a block at most, where ``block_for`` chooses its length.
BLOCK_ROWS = 2_000_000


def to_micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast(`{ts}` as timestamp_ntz))")


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.expr(EPOCH))


def with_block(df: DataFrame, ts: str, block_us: int = DAY_US, name: str = "block") -> DataFrame:
    """Adds the number of the stretch of ``block_us`` microseconds that a row lies in (also before 1970)."""
    us = to_micros(ts)
    return df.withColumn(name, F.call_function("div", us - F.pmod(us, F.lit(block_us)), F.lit(block_us)))


def block_for(df: DataFrame, ts: str, box: list[str] | None = None, most: int = BLOCK_ROWS) -> int:
    """The longest of a day, an hour, ... a microsecond with at most ``most`` rows in every block, if there is one.

    One aggregate, combined before its shuffle, for each length that is tried. Points of one box and one time can't be parted.
    """
    lengths = [u.nanoseconds // 1000 for u in reversed(MICRO_UNITS)]
    for length in lengths[:-1]:
        sizes = with_block(df, ts, length, "__tm_block").where("__tm_block is not null").groupBy(*(box or []), "__tm_block").count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= most:
            return length
    return lengths[-1]


def with_previous(
    df: DataFrame, ts: str, order: list[str], columns: dict[str, str], box: list[str] | None = None, block_us: int = DAY_US, skip_nulls: bool = False
) -> DataFrame:
    """Adds, for each ``columns`` item (new name: column), the value of the row before in its box; null for the first.

    ``order`` lists ``ts`` first and then the tie-breakers. With ``skip_nulls`` it is the last value before that is not null.
    """
    box = box or []
    blocked = with_block(df, ts, block_us, "__tm_block")
    rows = Window.partitionBy(*box, "__tm_block").orderBy(*order)
    blocks = Window.partitionBy(*box).orderBy("__tm_block")
    key, earlier = F.struct(*order), rows.rowsBetween(Window.unboundedPreceding, -1)
    last_of = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), key) if skip_nulls else key)
    last = blocked.groupBy(*box, "__tm_block").agg(*[last_of(c).alias(f"__tm_last{i}") for i, c in enumerate(columns.values())])
    over = blocks.rowsBetween(Window.unboundedPreceding, -1)
    border = lambda i: F.last(f"__tm_last{i}", ignorenulls=True).over(over) if skip_nulls else F.lag(f"__tm_last{i}").over(blocks)
    before = last.select(
        *[F.col(b).alias(f"__tm_b{i}") for i, b in enumerate(box)], F.col("__tm_block").alias("__tm_at"),
        *[border(i).alias(f"__tm_border{i}") for i in range(len(columns))],
    )
    same = [F.col(b).eqNullSafe(F.col(f"__tm_b{i}")) for i, b in enumerate(box)]
    joined = blocked.join(before, [*same, F.col("__tm_block").eqNullSafe(F.col("__tm_at"))])
    first = F.row_number().over(rows) == 1
    made = {}
    for i, (n, c) in enumerate(columns.items()):
        inner = F.last(c, ignorenulls=True).over(earlier) if skip_nulls else F.lag(c).over(rows)
        made[n] = F.coalesce(inner, f"__tm_border{i}") if skip_nulls else F.when(first, F.col(f"__tm_border{i}")).otherwise(inner)
    return joined.withColumns(made).drop("__tm_block", "__tm_at", *[f"__tm_border{i}" for i in range(len(columns))], *[f"__tm_b{i}" for i in range(len(box))])


def with_running_sum(
    df: DataFrame, ts: str, order: list[str], column: str, name: str, box: list[str] | None = None, block_us: int = DAY_US
) -> DataFrame:
    """Adds the sum of ``column`` up to each row of its box; nulls count as 0.

    Longs of a block are summed as decimals: combined in any order, some of them may need more bits than all of them together.
    """
    box, kind = box or [], df.schema[column].dataType
    summand, back = (F.col(column).cast("decimal(20,0)"), "long") if isinstance(kind, T.LongType) else (F.col(column), None)
    blocked = with_block(df, ts, block_us, "__tm_block")
    rows = Window.partitionBy(*box, "__tm_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy(*box).orderBy("__tm_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(*box, "__tm_block").agg((F.sum(summand).cast(back) if back else F.sum(summand)).alias("__tm_sum"))
    before = sums.select(*[F.col(b).alias(f"__tm_b{i}") for i, b in enumerate(box)], F.col("__tm_block").alias("__tm_at"), F.sum("__tm_sum").over(blocks).alias("__tm_before"))
    same = [F.col(b).eqNullSafe(F.col(f"__tm_b{i}")) for i, b in enumerate(box)]
    joined = blocked.join(before, [*same, F.col("__tm_block").eqNullSafe(F.col("__tm_at"))])
    total = F.coalesce("__tm_before", F.lit(0)) + F.coalesce(F.sum(column).over(rows), F.lit(0))
    return joined.withColumn(name, total).drop("__tm_block", "__tm_at", "__tm_before", *[f"__tm_b{i}" for i in range(len(box))])


def box_span(df: DataFrame, ts: str, box: list[str] | None = None) -> DataFrame:
    """start_ts, end_ts and n_points of each box."""
    return df.groupBy(*(box or [])).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n_points"))


def time_deltas(df: DataFrame, ts: str, order: list[str], box: list[str] | None = None, block_us: int = DAY_US) -> DataFrame:
    """Adds delta_us, the microseconds since the row before; null for the first row of a box."""
    both = with_previous(df, ts, order, {"__tm_prev": ts}, box, block_us)
    return both.withColumn("delta_us", to_micros(ts) - to_micros("__tm_prev")).drop("__tm_prev")


def coarsest_unit(delta: Column) -> Column:
    """Aggregate: the coarsest unit that divides every delta; days if there is none or all are 0."""
    out = F.lit("us")
    for u in MICRO_UNITS[1:]:
        step = u.nanoseconds // 1000
        out = F.when(F.coalesce(F.max(F.abs(delta % F.lit(step))), F.lit(0)) == 0, F.lit(u.name)).otherwise(out)
    return out


def time_units(df: DataFrame, ts: str, box: list[str] | None = None) -> DataFrame:
    """unit of each box from its times alone: a unit divides every difference if all times leave the same remainder.

    One aggregate, combined before its shuffle; no order and no window is needed. The same unit as ``delta_units`` gives.
    """
    out, us = F.lit("us"), to_micros(ts)
    for u in MICRO_UNITS[1:]:
        rest = F.pmod(us, F.lit(u.nanoseconds // 1000))
        out = F.when(F.coalesce(F.max(rest) == F.min(rest), F.lit(True)), F.lit(u.name)).otherwise(out)
    return df.groupBy(*(box or [])).agg(out.alias("unit"))


def delta_units(deltas: DataFrame, box: list[str] | None = None) -> DataFrame:
    """unit, max_delta (in the unit) and delta_bytes of each box, from ``time_deltas``."""
    found = deltas.groupBy(*(box or [])).agg(coarsest_unit(F.col("delta_us")).alias("unit"), F.max("delta_us").alias("max_us"))
    most = (F.coalesce("max_us", F.lit(0)) / micros(F.col("unit"))).cast("long")
    return found.select(*(box or []), "unit", most.alias("max_delta"), unsigned_width(most).alias("delta_bytes"))


def encode_deltas(deltas: DataFrame, units: DataFrame, box: list[str] | None = None) -> DataFrame:
    """Adds unit and delta (long, in the box's unit) to ``time_deltas``; one row per box (of ``time_units`` or ``delta_units``) is joined."""
    box = box or []
    side = units.select(*[F.col(b).alias(f"__tm_b{i}") for i, b in enumerate(box)], "unit")
    same = [F.col(b).eqNullSafe(F.col(f"__tm_b{i}")) for i, b in enumerate(box)]
    joined = deltas.join(side, same) if box else deltas.crossJoin(F.broadcast(side.limit(1)))
    exact = F.expr("delta_us div " + micros_sql("unit"))
    return joined.withColumn("delta", exact).drop(*[f"__tm_b{i}" for i in range(len(box))])


def micros_sql(name: str) -> str:
    tests = " ".join(f"WHEN '{u.name}' THEN {u.nanoseconds // 1000}L" for u in MICRO_UNITS)
    return f"CASE `{name}` {tests} END"


def rebuild_times(
    encoded: DataFrame, starts: DataFrame, ts: str, order: list[str], box: list[str] | None = None, name: str = "rebuilt_ts"
) -> DataFrame:
    """Adds each row's time as start plus the running sum of its deltas; ``ts`` only deals rows into blocks, and null stays null."""
    box = box or []
    stepped = encoded.withColumn("__tm_step", F.coalesce(F.col("delta") * F.expr(micros_sql("unit")), F.lit(0)))
    summed = with_running_sum(stepped, ts, order, "__tm_step", "__tm_offset", box)
    side = starts.select(*[F.col(b).alias(f"__tm_b{i}") for i, b in enumerate(box)], to_micros("start_ts").alias("__tm_start"))
    same = [F.col(b).eqNullSafe(F.col(f"__tm_b{i}")) for i, b in enumerate(box)]
    joined = summed.join(side, same) if box else summed.crossJoin(F.broadcast(side.limit(1)))
    time = F.when(F.col(ts).isNotNull(), from_micros(F.col("__tm_start") + F.col("__tm_offset")))
    return joined.withColumn(name, time).drop("__tm_step", "__tm_offset", "__tm_start", *[f"__tm_b{i}" for i in range(len(box))])


def order_violations(df: DataFrame, ts: str, arrival: str, box: list[str] | None = None, block: int = 1_000_000) -> DataFrame:
    """n_rows and n_backward (rows earlier than the row that arrived before them) of each box.

    Blocks are stretches of ``block`` arrival numbers, so ``arrival`` must be an integer.
    """
    box = box or []
    blocked = df.select(*box, to_micros(ts).alias("us"), F.col(arrival).alias("n"), F.floor(F.col(arrival) / block).alias("__tm_block"))
    rows = Window.partitionBy(*box, "__tm_block").orderBy("n")
    inner = blocked.withColumn("__tm_prev", F.lag("us").over(rows)).groupBy(*box, "__tm_block").agg(
        F.count("*").alias("rows"), F.count_if(F.col("us") < F.col("__tm_prev")).alias("back"),
        F.min_by("us", "n").alias("first"), F.max_by("us", "n").alias("last"),
    )
    border = F.lag("last").over(Window.partitionBy(*box).orderBy("__tm_block"))
    crossed = inner.withColumn("cross", F.coalesce((F.col("first") < border).cast("long"), F.lit(0)))
    return crossed.groupBy(*box).agg(F.sum("rows").alias("n_rows"), F.sum(F.col("back") + F.col("cross")).alias("n_backward"))


def require_order(df: DataFrame, ts: str, arrival: str, box: list[str] | None = None) -> None:
    """Raises if any row is earlier than the one that arrived before it."""
    if order_violations(df, ts, arrival, box).where("n_backward > 0").limit(1).count():
        raise DateDataError("times are not in order")


def regular_grid(spans: DataFrame, step_seconds: int, box: list[str] | None = None) -> DataFrame:
    """One row per grid point from start_ts to end_ts of each box, every ``step_seconds``.

    Points come from a sequence of days first and then of points within each day, so no array holds a whole box.
    """
    if step_seconds <= 0:
        raise DateDataError("the step between points must be positive")
    box = box or []
    step, per = step_seconds * 1_000_000, max(1, DAY_US // (step_seconds * 1_000_000))
    count = F.expr(f"(timestampdiff(MICROSECOND, start_ts, end_ts) div {step}) + 1")
    chunks = spans.select(*box, "start_ts", count.alias("__tm_n")).withColumn("__tm_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__tm_n - 1) div {per}"))))
    points = chunks.withColumn("__tm_i", F.explode(F.sequence(F.col("__tm_c") * per, F.least(F.col("__tm_c") * per + per, F.col("__tm_n")) - 1)))
    return points.select(*box, F.timestamp_add("MICROSECOND", F.col("__tm_i") * step, F.col("start_ts")).alias("ts"))


def regularity(deltas: DataFrame, box: list[str] | None = None) -> DataFrame:
    """is_regular and step_us (null unless all deltas of a box are equal and positive)."""
    found = deltas.groupBy(*(box or [])).agg(F.min("delta_us").alias("least"), F.max("delta_us").alias("most"))
    same = F.coalesce((F.col("least") == F.col("most")) & (F.col("least") > 0), F.lit(False))
    return found.select(*(box or []), same.alias("is_regular"), F.when(same, F.col("least")).alias("step_us"))
