"""Line deduplication with two Bloom filters.

Pass 1 hashes every line and adds it to a "seen once" filter; a bit that a second document sets again goes
to the "seen twice" filter. Partial filters travel as sorted bit positions and are merged page by page on
the executors. Pass 2 tests every line against the merged "twice" filter, so only suspected repeats shuffle;
an exact aggregate on their SHA-256 keys confirms them and picks the smallest document. The filter has
``filter_bits`` bits (16 MB by default) at every size, so what is broadcast is bounded; it holds about 2**24 distinct lines (1 to 2 GB of
text) with few false suspects. Beyond that ever more lines are suspected, at last all: their keys then shuffle once (44 bytes a line, combined
before the shuffle), and the exact step keeps the result the same.

Edge cases: a null or empty text is one empty line and is never changed; lines of fewer than ``min_chars``
code points (after stripping) always stay; a row with a null id neither loses lines nor makes others lose
any; rows that repeat an id count as one document, and each loses its own lines whose key a smaller id has; a text of any length and number of
lines is handled whole, in time linear in it; ties can't occur, as the smallest id keeps a line in all its rows; an input column named
like an output column is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import drop, materialize
from tidemark.llm.textkernels import U64, distinct, slices, span_hashes, utf8

PAGES = 64
#: Bits of the filter (a power of two).
FILTER_BITS = 1 << 27


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, key start, key end and code points of each line's key, for all rows of a buffer."""
    n_rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    row_of_break = np.searchsorted(offsets, breaks, "right") - 1
    rows = np.concatenate([np.arange(n_rows), row_of_break])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    ends = np.empty_like(starts)
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    ends[~last] = starts[1:][~last[:-1]] - 1
    ends[last] = offsets[rows[last] + 1]
    solid = np.flatnonzero(~((data == 32) | ((data >= 9) & (data <= 13))))
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = b > a
    key_start, key_end = starts.copy(), starts.copy()
    key_start[full], key_end[full] = solid[a[full]], solid[b[full] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return rows, key_start, key_end, points[key_end] - points[key_start]


def filter_positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a filter of ``bits`` (a power of two) bits."""
    mask = U64(bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> U64(33)) & mask).astype(np.int64)


def _partial_filters(bits: int, min_chars: int, text_at: int = 0):
    page_bits = bits // PAGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text_at))
            rows_all, hash_all, base = [], [], 0
            for lo, hi in slices(offsets):
                part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                rows, s, e, points = line_spans(part, offs)
                long = points >= min_chars
                rows_all.append(rows[long] + lo)
                hash_all.append(span_hashes(part, s[long], e[long]))
            if not rows_all:
                continue
            rows, hashes = np.concatenate(rows_all), np.concatenate(hash_all)
            order = np.lexsort((rows, hashes))
            rows, hashes = rows[order], hashes[order]
            new_hash = np.ones(len(hashes), bool)
            new_hash[1:] = hashes[1:] != hashes[:-1]
            again = np.zeros(len(hashes), bool)
            again[1:] = ~new_hash[1:] & (rows[1:] != rows[:-1])
            once = distinct(np.concatenate(filter_positions(hashes[new_hash], bits)))
            twice = distinct(np.concatenate(filter_positions(hashes[again], bits)))
            out: dict[str, list] = {"page": [], "once": [], "twice": []}
            for page in range(PAGES):
                cut = [np.searchsorted(x, [page * page_bits, (page + 1) * page_bits]) for x in (once, twice)]
                a, b = (
                    (x[i:j] - page * page_bits).astype(np.uint32) for x, (i, j) in zip((once, twice), cut, strict=True)
                )
                if len(a):
                    out["page"].append(page)
                    out["once"].append(a.tobytes())
                    out["twice"].append(b.tobytes())
            yield pa.RecordBatch.from_pydict(
                out, schema=pa.schema([("page", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
            )

    return run


def _merge_page(bits: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(bits // PAGES, np.uint8)
        for once, twice in zip(pdf["once"], pdf["twice"], strict=True):
            at = np.frombuffer(once, np.uint32)
            seen[at] = np.minimum(seen[at] + 1, 2)
            seen[np.frombuffer(twice, np.uint32)] = 2
        return pd.DataFrame({"page": [int(pdf["page"].iloc[0])], "filter": [np.packbits(seen >= 2).tobytes()]})

    return merge


def _suspected(filter_bytes: np.ndarray, bits: int, min_chars: int, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By slice of rows: its bytes' start, its first row, and row, number in the row, key start and key end of each line that the filter suspects."""
    for lo, hi in slices(offsets):
        part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        rows, s, e, points = line_spans(part, offs)
        long = np.flatnonzero(points >= min_chars)
        hit = np.ones(len(long), bool)
        for at in filter_positions(span_hashes(part, s[long], e[long]), bits):
            hit &= (filter_bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        lines = long[hit]
        yield int(offsets[lo]), lo, rows[lines], lines - np.searchsorted(rows, rows[lines]), s[lines], e[lines]


def _text_marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each whole text, which tells rows that repeat an id apart."""
    parts = [span_hashes(data[offsets[lo] : offsets[hi]], offsets[lo:hi] - offsets[lo], offsets[lo + 1 : hi + 1] - offsets[lo]) for lo, hi in slices(offsets)]
    return np.concatenate([np.zeros(0, U64), *parts]).view(np.int64)


def _suspect_lines(shared, bits: int, min_chars: int):
    """One row for each suspected line of (id, body): id, mark of its text, line number, exact key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            marks = _text_marks(data, offsets)
            for base, lo, rows, numbers, s, e in _suspected(shared.value, bits, min_chars, data, offsets):
                end = int(e.max()) if len(e) else 0
                raw = data[base : base + end].tobytes().lower()  # ASCII letters only
                keys = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(s.tolist(), e.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows + lo)), pa.array(marks[rows + lo]), pa.array(numbers.astype(np.int32)), pa.array(keys, pa.binary())],
                    names=["id", "mark", "line", "key"],
                )

    return run


def _dirty(shared, bits: int, min_chars: int):
    """Adds the mark of each row's text and whether any of its lines is suspected; the text is the second column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            dirty = np.zeros(batch.num_rows, bool)
            for _, lo, rows, *_ in _suspected(shared.value, bits, min_chars, data, offsets):
                dirty[rows + lo] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_text_marks(data, offsets)), pa.array(dirty)], names=[*batch.schema.names, "mark", "dirty"])

    return run


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``docs`` with ``text_col`` reduced to the lines that stay, and n_lines and n_dropped (long).

    A line's key is the line without whitespace at its ends and with A-Z lower-cased. A key of at least
    ``min_chars`` code points in two or more documents keeps its lines only in the smallest id that has it.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c.lower() not in (id_col.lower(), text_col.lower(), "n_lines", "n_dropped")]
    base = docs.select(
        docs[id_col].alias("id"),
        F.coalesce(docs[text_col], F.lit("")).alias("body"),
        docs[text_col].isNull().alias("was_null"),
        F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(rest)] or [F.lit(0).alias("none")]).alias("rest"),
    )
    partial = base.where("id is not null").select("body").mapInArrow(_partial_filters(filter_bits, min_chars), "page int, once binary, twice binary")
    pages = partial.groupBy("page").applyInPandas(_merge_page(filter_bits), "page int, filter binary").collect()
    twice = np.zeros(filter_bits // 8, np.uint8)
    size = filter_bits // PAGES // 8
    for row in pages:  # PAGES rows, filter_bits bits in all
        twice[row["page"] * size : (row["page"] + 1) * size] = np.frombuffer(row["filter"], np.uint8)
    shared = spark.sparkContext.broadcast(twice)

    narrow = base.select("id", "body").where("id is not null")
    kind = docs.schema[id_col].dataType.simpleString()
    found = materialize(narrow.mapInArrow(_suspect_lines(shared, filter_bits, min_chars), f"id {kind}, mark long, line int, key binary"), "lines")
    repeated = (
        found.groupBy("key").agg(F.min("id").alias("keeper"), F.max("id").alias("other")).where("keeper < other")
    ).select("key", "keeper")
    repeated = materialize(repeated, "repeated")
    lost = found.join(repeated.hint("merge"), "key").where("id <> keeper")
    lost = materialize(lost.groupBy("id", "mark").agg(F.collect_set("line").alias("lost")), "lost")
    drop(found, repeated)
    # Only documents that hold a suspect need the join; the others bypass the shuffle.
    marked = base.mapInArrow(
        _dirty(shared, filter_bits, min_chars),
        f"id {kind}, body string, was_null boolean, rest {base.schema['rest'].dataType.simpleString()}, mark long, dirty boolean",
    )
    dirty = F.col("dirty") & F.col("id").isNotNull()
    columns = ["id", "body", "was_null", "rest", "lost"]
    clean = marked.where(~dirty).withColumn("lost", F.lit(None).cast("array<int>")).select(columns)
    # Always a shuffle join: a broadcast that fits small inputs would make cost jump with size.
    whole = clean.unionAll(marked.where(dirty).join(lost.hint("merge"), ["id", "mark"], "left").select(columns))
    # A column of its own, lest it be split again for each line; the numbers that stay are found by hash, so long texts stay linear.
    whole = whole.withColumn("split", F.split("body", "\n", -1))
    split = F.col("split")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("lost"))
    kept = F.when(F.col("was_null"), None).when(
        F.col("lost").isNull(), F.col("body")
    ).otherwise(F.concat_ws("\n", F.transform(stay, lambda i: F.get(split, i))))
    made = {id_col: F.col("id"), text_col: kept}
    made |= {c: F.col(f"rest.c{i}") for i, c in enumerate(rest)}
    return whole.select(
        *[made[c].alias(c) for c in docs.columns if c in made],
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )
