"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are a stated query set, taken in blocks of bounded size. Words are runs of letters and digits, A-Z
lower-cased. Every 3-gram of an item is a seed, common or not. A seed hit opens a window of the document around the
place where the item would lie; overlapping windows merge, and local alignment of words (match 1, mismatch and gap
-0.5) scores each window. The share of the item's length that the best alignment reaches decides. A copy without three words of the item in
a row has no seed. One pass reads the documents against all blocks, each broadcast by itself: no shuffle of texts, no pairs in a join, and a
hot item costs no more than its own documents.

Edge cases: null and empty texts match nothing; a text of any length is searched whole; items of fewer than ``MIN_WORDS`` words match only
where all their words stand in a row (one without words nowhere); items with a null id or text are left out; rows and items that repeat are judged
one by one; of windows or places of equal score the first is reported; extra columns are kept, ``matches`` is replaced; empty tables give no
matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkernels import PUNCTUATION, U64, slices, span_hashes, utf8, window_hashes, word_bounds

GRAM = 3
#: Items of fewer words are matched whole.
MIN_WORDS = 8
MISMATCH = GAP = 0.5
#: Bytes of item texts in a block.
BLOCK_BYTES = 4 << 20
#: Places in items that seed hits open at once; a document with more is handled on its own.
HITS = 1 << 18
_FILTER = 1 << 22


class Items:
    """Words and 3-grams of a block of test items, and the short items among them."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        self.ids = ids
        data, offsets = utf8(pa.array(texts, pa.string()))
        starts, ends, bounds = word_bounds(data, offsets, PUNCTUATION)
        words = span_hashes(data, starts, ends)
        self.words = [words[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        grams, at, gram_bounds = window_hashes(words, bounds, GRAM)
        self.item = np.repeat(np.arange(len(ids)), np.diff(gram_bounds))
        self.pos = at - bounds[self.item]
        self.gram = grams
        long = np.array([len(w) >= MIN_WORDS for w in self.words], bool)
        keep = long[self.item] if len(ids) else np.zeros(0, bool)
        self.item, self.pos, self.gram = self.item[keep], self.pos[keep], self.gram[keep]
        self._index()
        #: By number of words: the items of each hash of a whole short item.
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, w in enumerate(self.words):
            if 0 < len(w) < MIN_WORDS:
                whole = int(window_hashes(w, np.array([0, len(w)]), len(w))[0][0])
                self.short.setdefault(len(w), {}).setdefault(whole, []).append(i)

    def _index(self) -> None:
        order = np.argsort(self.gram, kind="stable")
        self.item, self.pos, self.gram = self.item[order], self.pos[order], self.gram[order]
        self.known, self.first = np.unique(self.gram, return_index=True)
        self.first = np.append(self.first, len(self.gram))
        self.filter = np.zeros(_FILTER, bool)
        self.filter[(self.known & U64(_FILTER - 1)).astype(np.int64)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``grams`` that are known, and their rows in ``known``."""
        maybe = np.flatnonzero(self.filter[(grams & U64(_FILTER - 1)).astype(np.int64)])
        if not len(maybe) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, grams[maybe]), len(self.known) - 1)
        hit = self.known[at] == grams[maybe]
        return maybe[hit], at[hit]


def align(windows: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each window with its item: rows (score, end in window, end in item)."""
    out = np.zeros((len(windows), 3))
    order = sorted(range(len(windows)), key=lambda i: (len(windows[i]), len(items[i])))
    at = 0
    while at < len(order):
        batch = order[at : at + max(1, 400_000 // max(1, len(windows[order[min(at + 255, len(order) - 1)]])))][:256]
        at += len(batch)
        width, height = max(len(windows[i]) for i in batch), max(len(items[i]) for i in batch)
        w = np.zeros((len(batch), width), U64)
        x = np.zeros((len(batch), height), U64)
        for k, i in enumerate(batch):
            w[k, : len(windows[i])] = windows[i]
            x[k, : len(items[i])] = items[i]
        real = np.arange(width) < np.array([len(windows[i]) for i in batch])[:, None]
        ramp = GAP * np.arange(width)
        above = np.zeros((len(batch), width))
        for r in range(height):
            same = (w == x[:, r, None]) & real & (r < np.array([len(items[i]) for i in batch]))[:, None]
            diagonal = np.zeros_like(above)
            diagonal[:, 1:] = above[:, :-1]
            row = np.maximum(diagonal + np.where(same, 1.0, -MISMATCH), np.maximum(above - GAP, 0.0))
            above = np.maximum.accumulate(row + ramp, axis=1) - ramp  # gaps along the window
            peak = above.argmax(1)
            best = above[np.arange(len(batch)), peak]
            for k in np.flatnonzero(best > out[batch, 0]):
                out[batch[k]] = best[k], peak[k] + 1, r + 1
    return out


def _words(data: np.ndarray, offsets: np.ndarray):
    starts, ends, bounds = word_bounds(data, offsets, PUNCTUATION)
    words = span_hashes(data, starts, ends)
    return words, bounds, *window_hashes(words, bounds, GRAM)


def _windows(items: Items, row: int, hits: np.ndarray, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(item, start, end) of merged windows of one document; ``hits`` has (item, word, place in item), sorted."""
    out: list[list[int]] = []
    for item, word, pos in hits.tolist():
        size = len(items.words[item])
        slack = 4 + size // 4
        a, b = max(lo, word - pos - slack), min(hi, word - pos + size + slack)
        if out and out[-1][0] == item and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([item, a, b])
    return [tuple(x) for x in out]


def _runs(row: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of gram hits that end with a document and open about ``HITS`` places in items, or those of one document."""
    ends = np.append(np.flatnonzero(np.diff(row)) + 1, len(row))
    total = np.append(0, np.cumsum(size))
    a = 0
    while a < len(row):
        within = ends[(ends > a) & (total[ends] <= total[a] + HITS)]
        b = int(within[-1]) if len(within) else int(ends[np.searchsorted(ends, a, "right")])
        yield a, b
        a = b


def _scores(items: Items, words: np.ndarray, bounds: np.ndarray, at: np.ndarray, row: np.ndarray, known: np.ndarray, size: np.ndarray):
    """((row, item, first word of the window), alignment) of every window that the gram hits at words ``at`` open."""
    seed = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(items.first[known], size)
    hits = np.stack([np.repeat(row, size), items.item[seed], np.repeat(at, size), items.pos[seed]], 1)
    hits = hits[np.lexsort((hits[:, 2] - hits[:, 3], hits[:, 1], hits[:, 0]))]
    cut = np.flatnonzero(np.diff(hits[:, 0], prepend=-1))
    spots = []
    for a, b in zip(cut.tolist(), np.append(cut, len(hits))[1:].tolist(), strict=True):
        r = int(hits[a, 0])
        spots += [(r, *x) for x in _windows(items, r, hits[a:b, 1:], int(bounds[r]), int(bounds[r + 1]))]
    scores = align([words[a:b] for _, _, a, b in spots], [items.words[i] for _, i, _, _ in spots])
    return zip([x[:3] for x in spots], scores.tolist(), strict=True)


def _whole(words: np.ndarray, bounds: np.ndarray, n: int, whole: dict[int, list[int]]) -> Iterator[tuple[int, int, int]]:
    """(row, item, place in the row) of the first of each short item of ``n`` words in each row."""
    grams, first, gram_bounds = window_hashes(words, bounds, n)
    at = np.flatnonzero(np.isin(grams, np.array(list(whole), U64)))
    row = np.searchsorted(gram_bounds, at, "right") - 1
    order = np.lexsort((at, grams[at], row))
    at, row = at[order], row[order]
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[at[1:]] != grams[at[:-1]])
    for k, r in zip(at[new].tolist(), row[new].tolist(), strict=True):
        for item in whole[int(grams[k])]:
            yield r, item, int(first[k] - bounds[r])


def _match(blocks: list, threshold: float, item_type: pa.DataType):
    """Adds the matches with the items of all ``blocks``, broadcast one by one; a text's words are found once for all of them."""
    kind = pa.list_(
        pa.struct([("item", item_type), ("score", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = [[{} for _ in blocks] for _ in range(batch.num_rows)]
            data, offsets = utf8(batch.column(0))
            for lo, hi in slices(offsets):
                words, bounds, grams, first, gram_bounds = _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for block, shared in enumerate(blocks):
                    items: Items = shared.value
                    at, known = items.find(grams)
                    row = np.searchsorted(gram_bounds, at, "right") - 1
                    size = items.first[known + 1] - items.first[known]
                    for p, q in _runs(row, size):
                        for (r, i, a), (score, end, rows) in _scores(items, words, bounds, first[at[p:q]], row[p:q], known[p:q], size[p:q]):
                            share = round(score / len(items.words[i]), 9)
                            if share >= threshold and share > found[lo + r][block].get(i, (0,))[0]:
                                stop = a + int(end) - int(bounds[r])
                                found[lo + r][block][i] = (share, max(0, stop - int(rows)), stop)
                    for n, whole in items.short.items():
                        for r, i, a in _whole(words, bounds, n, whole):
                            found[lo + r][block].setdefault(i, (1.0, a, a + n))
            column = [
                [{"item": b.value.ids[i], "score": s, "first_word": a, "end_word": e} for b, y in zip(blocks, x, strict=True) for i, (s, a, e) in sorted(y.items())]
                for x in found
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(column, kind)], names=[*batch.schema.names, "matches"])

    return run


def mark_matches(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.4, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with ``matches``: item, score (share of the item aligned), first_word and end_word (about) in the text."""
    spark = docs.sparkSession
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    item_type = pa.string() if item_kind == "string" else pa.int32() if item_kind == "int" else pa.int64()
    keep = [c for c in docs.columns if c.lower() != "matches"]
    others = [c for c in keep if c != text_col]
    rest = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(others)] or [F.lit(0).alias("none")])
    out = docs.select(docs[text_col].alias("body"), rest.alias("rest"))
    matches = f"array<struct<item:{item_kind},score:double,first_word:int,end_word:int>>"
    chosen = benchmark.select(benchmark[item_col].alias("id"), benchmark[item_text_col].alias("body")).where("id is not null and body is not null")
    total = chosen.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    blocks = 1 + total // block_bytes
    parts = []
    for block in range(blocks):
        rows = chosen.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id", "body").collect()  # about block_bytes
        parts.append(spark.sparkContext.broadcast(Items([r["id"] for r in rows], [r["body"] for r in rows])))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema)
    out = out.mapInArrow(_match(parts, threshold, item_type), f"{kinds}, matches {matches}")
    made = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)} | {text_col: F.col("body")}
    return out.select(*[made[c].alias(c) for c in keep], "matches")
