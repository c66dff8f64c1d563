"""Temperature mixing of sources, realised as budgeted block permutations.

Each source's token share p is raised to an exponent a in [0, 1] and normalised. Bisection picks the largest a
whose weights reach the target entropy (a share of the log of the number of sources), then, if a source would be
repeated more than ``max_repeats`` times, raises a until none is (a = 1 repeats all sources alike). A source's
budget is its weight times the token budget: whole epochs, then a partial epoch that takes its blocks in a
keyed permutation until the budget is spent; in the one block where it ends, documents are taken in the order of their keys. A source with
a third of all rows is spread over ``n_blocks`` blocks, so no task gets it whole. Texts are read twice: to count their words, and to give
them out with what the plan, one row per source and block, says.

Edge cases: a null source is a source of its own; null and empty texts have no tokens and go along with
their block; a text of any length is counted whole; a document that would exceed what is left of the budget is not taken, nor is any after
it; sources without tokens get no weight and no rows; sources of equal size get equal weights; rows that repeat an id lie in one block, and those
equal in id and number of tokens are taken alike; input columns named like output columns are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import drop, materialize
from tidemark.llm.textkernels import slices, utf8, word_bounds

#: Most sources whose totals are solved on the driver; more are summed by Spark at each step.
DRIVER_SOURCES = 100_000
#: Most plan rows (source and block) that are broadcast; about 10 MB.
BROADCAST_ROWS = 200_000
STEPS = 60


def _count_words(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text_at))
            counts = [np.zeros(0, np.int64)]
            for lo, hi in slices(offsets):
                rows = word_bounds(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[2]
                counts.append(np.diff(rows))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(counts), pa.int64())], names=[*batch.schema.names, "n_tokens"]
            )

    return run


def bisect_exponent(
    measure: Callable[[float], tuple[float, float]], n_sources: int, entropy_share: float, max_repeats: float
) -> float:
    """``measure(a)`` gives entropy and largest repetition of the weights at exponent a."""
    target = entropy_share * math.log(n_sources) if n_sources > 1 else 0.0

    def search(good: Callable[[float], bool], low: float, high: float) -> float:
        """Bisects between ``low``, where ``good`` holds, and ``high``, where it doesn't; ends on the good side."""
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return low

    entropy_met = lambda a: measure(a)[0] >= target
    a = 1.0 if entropy_met(1.0) else search(entropy_met, 0.0, 1.0)
    limit_met = lambda a: measure(a)[1] <= max_repeats
    if limit_met(a):
        return a
    return search(limit_met, 1.0, a) if limit_met(1.0) else 1.0


def source_weights(totals: DataFrame, budget: int | None, entropy_share: float, max_repeats: float) -> DataFrame:
    """From (source, tokens): source, tokens, weight and budget (tokens to take), for sources with tokens."""
    totals = totals.where("tokens > 0")
    n, total = totals.agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        return totals.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"))
    budget = int(total) if budget is None else budget
    log_share = F.log(F.col("tokens") / F.lit(float(total)))
    if n <= DRIVER_SOURCES:
        tokens = np.sort(np.array([r[0] for r in totals.select("tokens").collect()], float))

        def measure(a: float) -> tuple[float, float]:
            w = np.exp(a * np.log(tokens / total))
            w /= w.sum()
            return float(-(w * np.log(w)).sum()), float((w * budget / tokens).max())
    else:

        def measure(a: float) -> tuple[float, float]:
            x = a * log_share
            norm, moment, most = totals.agg(
                F.sum(F.exp(x)), F.sum(F.exp(x) * x), F.max(F.exp(x) / F.col("tokens"))
            ).first()
            return math.log(norm) - moment / norm, most * budget / norm

    a = bisect_exponent(measure, n, entropy_share, max_repeats)
    norm = totals.agg(F.sum(F.exp(F.lit(a) * log_share))).first()[0]
    weight = F.exp(F.lit(a) * log_share) / F.lit(norm)
    return totals.select(
        "source", "tokens", weight.alias("weight"), F.floor(weight * F.lit(budget) + 0.5).cast("long").alias("budget")
    )


def _key(seed: int, *what) -> F.Column:
    """A number in [0, 2**32) from the MD5 of the seed and the given columns."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *what)), 1, 8), 16, 10).cast("long")


def _edges(counts: DataFrame, steps: DataFrame) -> DataFrame:
    """Where each source's last, partly taken block ends: (es, eb) name it, rows whose key is less than ``all_below`` are taken, and of
    the rest those up to ``last`` (key, id, tokens).

    Keys are cut into 1,024 ranges first, whose sums show the one range where the budget ends; only its rows, about a millionth of a
    source, are ordered. Rows equal in key, id and tokens are taken together or not at all.
    """
    rows = counts.join(steps.select("s", "b", "left"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    rows = rows.select("s", "b", "left", "row_key", "id", "n_tokens", F.shiftright("row_key", 22).alias("range"))
    ranges = rows.groupBy("s", "b", "left", "range").agg(F.sum("n_tokens").alias("size"))
    so_far = F.sum("size").over(Window.partitionBy("s", "b").orderBy("range"))
    ranges = ranges.withColumn("upto", so_far).where("upto > left and upto - size <= left")
    ends = ranges.select(F.col("s").alias("es"), F.col("b").alias("eb"), F.col("range").alias("er"), (F.col("left") - F.col("upto") + F.col("size")).alias("rest"))
    inside = rows.join(ends, F.col("s").eqNullSafe(F.col("es")) & (F.col("b") == F.col("eb")) & (F.col("range") == F.col("er")))
    spent = F.sum("n_tokens").over(Window.partitionBy("es", "eb").orderBy("row_key", "id", "n_tokens").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.max(F.when(F.col("spent") <= F.col("rest"), F.struct("row_key", "id", "n_tokens"))).alias("last")
    return inside.withColumn("spent", spent).groupBy("es", "eb").agg(F.shiftleft(F.first("er"), 22).alias("all_below"), last)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget_tokens: int | None = None,
    entropy_share: float = 0.95,
    max_repeats: float = 4.0,
    n_blocks: int = 1024,
    seed: int = 17,
) -> DataFrame:
    """One row per taken copy of a document: its columns, n_tokens, epoch (from 0) and block_rank.

    ``budget_tokens`` defaults to all tokens of ``docs``. Reading order within a source: epoch, block_rank.
    """
    made = ("n_tokens", "epoch", "block_rank")
    keep = [c for c in docs.columns if c.lower() not in made]
    rest = [c for c in keep if c.lower() not in (id_col.lower(), text_col.lower(), source_col.lower())]
    base = docs.select(
        docs[text_col].alias("body"), docs[id_col].alias("id"), docs[source_col].alias("source"),
        F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(rest)] or [F.lit(0).alias("none")]).alias("rest"),
    )
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    block = (_key(seed, F.lit("block"), word("id")) % n_blocks).cast("int")

    def counted(frame: DataFrame) -> DataFrame:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema)
        return frame.mapInArrow(_count_words(0), f"{kinds}, n_tokens long").withColumn("block", block)

    row_key = _key(seed, F.lit("row"), word("id"))
    # Numbers without texts; what follows up to the plan reads only these.
    counts = materialize(counted(base.select("body", "id", "source")).select("source", "block", "id", "n_tokens", row_key.alias("row_key")), "counts")
    sizes = materialize(counts.groupBy("source", "block").agg(F.sum("n_tokens").alias("size")), "blocks")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("tokens"))
    plan = source_weights(totals, budget_tokens, entropy_share, max_repeats).select(
        F.col("source").alias("s"),
        F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("whole"),
        (F.col("budget") % F.col("tokens")).alias("part"),
    )
    by_source = Window.partitionBy("source").orderBy(_key(seed, F.lit("order"), word("source"), word("block")), "block")
    before = F.sum("size").over(by_source.rowsBetween(Window.unboundedPreceding, -1))
    steps = (
        sizes.withColumns({"before": F.coalesce(before, F.lit(0)), "block_rank": F.row_number().over(by_source)})
        .join(plan, F.col("source").eqNullSafe(F.col("s")))
        .select(
            "s", F.col("block").alias("b"), "whole", "block_rank", (F.col("part") - F.col("before")).alias("left"), "size"
        )
        .where("whole > 0 or left > 0")
    )
    steps = materialize(steps, "steps")
    edges = materialize(_edges(counts, steps.where("left > 0 and left < size")), "edges")
    drop(counts, sizes)
    steps = steps.join(edges, F.col("s").eqNullSafe(F.col("es")) & (F.col("b") == F.col("eb")), "left").drop("es", "eb")
    if steps.count() <= BROADCAST_ROWS:
        steps = F.broadcast(steps)
    placed = counted(base.select("body", "id", "source", "rest")).join(
        steps, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    )
    up_to = F.coalesce(F.struct(row_key, "id", "n_tokens") <= F.col("last"), F.lit(False))
    partly = F.when(F.col("left") <= 0, False).when(F.col("left") >= F.col("size"), True).otherwise((row_key < F.col("all_below")) | up_to)
    taken = placed.withColumn("copies", F.col("whole") + partly.cast("long")).where("copies > 0")
    taken = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    made_of = {id_col.lower(): F.col("id"), text_col.lower(): F.col("body"), source_col.lower(): F.col("source")}
    made_of |= {c.lower(): F.col(f"rest.c{i}") for i, c in enumerate(rest)}
    return taken.select(*[made_of[c.lower()].alias(c) for c in keep], "n_tokens", "epoch", "block_rank")
