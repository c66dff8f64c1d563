"""Masked pseudo-likelihood by a bidirectional window network trained in numpy.

A token is predicted from the two words on each side: position-wise embeddings are summed, passed through tanh, and a
two-level softmax (class, then word within the class) gives its probability. Vocabulary: the most frequent words of the
whole corpus, counted over all documents, have ids of their own; all other words share ids by hash, and the probability of such an id is
split among its words by their own counts in the corpus, with a little left for unseen ones. The table of these counts grows with the
vocabulary, to 2**23 cells; words of one cell then count together. Training is data-parallel: every
document is trained on once, copies too, in one of ``ROUNDS`` rounds by a hash of its numbers and strings other than the
text. Parameters are averaged on the executors, weighted by tokens, and the next round starts from the average.
Scoring is one pass over whole texts with no shuffle; the model that is broadcast has a bounded size.

Edge cases: null, empty and word-less texts have 0 tokens, a sum of 0 and a mean of 0; a text of any length is scored whole; words of equal
count are ranked by their hash; rows that repeat are scored one by one and count as often as they occur; extra columns are kept, ones named
like output columns are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tidemark.llm.storage import drop, materialize
from tidemark.llm.textkernels import U64, slices, utf8, vocabulary

CLASSES, PER_CLASS, HIDDEN = 64, 64, 20  # classes and words of a class must be as many
VOCAB = CLASSES * PER_CLASS
#: Ids of words outside the known ones, by hash.
OTHER = 256
SIDES = (-2, -1, 1, 2)
#: First embedding row of each side, and the places of each row's numbers.
SIDE_ROWS = np.arange(len(SIDES))[:, None] * (VOCAB + 1)
CELLS = np.arange(len(SIDES) * (VOCAB + 1) * HIDDEN).reshape(-1, HIDDEN)
#: Rounds of averaging; together they train on every document.
ROUNDS = 2
BATCH, RATE = 256, 0.2
#: Logits above this count as this, so that no exponential overflows.
LARGEST = np.float32(60)
#: Cells of the counts of other words, at least and at most (32 MB), and what an unseen word counts.
LEAST_CELLS, MOST_CELLS, UNSEEN = 1 << 14, 1 << 23, 0.05
#: Tokens scored at once; more no longer fit the cache.
SCORED = 1024
#: Rows that carry the parameters between executors.
PIECES = 16


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for lo, hi in slices(offsets):
            hashes, _, _, ids, _ = vocabulary(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            count = np.bincount(ids, minlength=len(hashes))
            yield pa.RecordBatch.from_pydict({"h": pa.array(hashes.view(np.int64)), "c": pa.array(count.astype(np.int64))})


class Rare:
    """How often each hashed word outside the known ones occurs in the corpus, in cells that nest in the ids of other words."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = cells
        share = len(cells) // OTHER
        with np.errstate(divide="ignore"):
            self.log_total = np.log(cells.reshape(share, OTHER).sum(0, dtype=float) + UNSEEN * share)

    def log_share(self, hashes: np.ndarray) -> np.ndarray:
        """Log of a word's share of its id: (count + UNSEEN) over the id's count with as much for every cell."""
        at = (hashes & U64(len(self.cells) - 1)).astype(np.int64)
        return np.log(self.cells[at] + UNSEEN) - self.log_total[at % OTHER]


def _fill_cells(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(size, np.float32)
        out[pdf["at"].to_numpy()] = pdf["c"].to_numpy()
        return pd.DataFrame({"page": [int(pdf["page"].iloc[0])], "cells": [out.tobytes()]})

    return run


def rare_words(counts: DataFrame, known: np.ndarray, known_counts: np.ndarray) -> Rare:
    """The cells of all counted words but the ``known`` ones: their number grows with the vocabulary, to at most ``MOST_CELLS``."""
    size, distinct_words = LEAST_CELLS, counts.count()
    while size < min(MOST_CELLS, 2 * distinct_words):
        size *= 2
    page = LEAST_CELLS
    cells = counts.groupBy(F.pmod("h", F.lit(size)).alias("cell")).agg(F.sum("c").alias("c"))
    cells = cells.select(F.expr(f"cell div {page}").alias("page"), (F.col("cell") % page).cast("int").alias("at"), "c")
    out = np.zeros(size, np.float32)
    for row in cells.groupBy("page").applyInPandas(_fill_cells(page), "page long, cells binary").toLocalIterator():  # size cells in all
        out[row["page"] * page : (row["page"] + 1) * page] = np.frombuffer(row["cells"], np.float32)
    np.subtract.at(out, (known & U64(size - 1)).astype(np.int64), known_counts.astype(np.float32))
    return Rare(np.maximum(out, 0))


class Network:
    """Parameters, forward pass and gradient step; float32 throughout."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, seed: int = 3) -> None:
        order = np.argsort(words)
        self.words, self.ids = words[order], (OTHER + np.arange(len(words)))[order]
        rng = np.random.default_rng(seed)
        rest = max(total - counts.sum(), OTHER) / OTHER
        unigram = np.full(VOCAB, 0.5)
        unigram[:OTHER] = rest
        unigram[OTHER : OTHER + len(counts)] = counts
        # Frequent words are spread over the classes, so both levels of the softmax carry information.
        unigram = (unigram / unigram.sum()).reshape(PER_CLASS, CLASSES).T
        self.p = {
            "e": rng.normal(0, 0.1, (len(SIDES), VOCAB + 1, HIDDEN)).astype(np.float32),
            "b": np.zeros(HIDDEN, np.float32),
            "w": rng.normal(0, 0.1, (HIDDEN, CLASSES + PER_CLASS)).astype(np.float32),
            "bc": np.log(unigram.sum(1)).astype(np.float32),
            "bw": np.log(unigram / unigram.sum(1, keepdims=True)).astype(np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Token ids of distinct words."""
        out = (hashes % U64(OTHER)).astype(np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = self.words[at] == hashes
            out[hit] = self.ids[at[hit]]
        return out

    def _levels(self, context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Embedding rows of the neighbours, hidden layer, logits of both levels side by side, and the flat places of the target's two
        logits; context is (sides, n)."""
        p, n = self.p, len(target)
        rows = (context + SIDE_ROWS).ravel()
        h = p["e"].reshape(-1, HIDDEN).take(rows, 0, mode="clip").reshape(len(SIDES), n, HIDDEN).sum(0)
        h += p["b"]
        np.tanh(h, out=h)
        cls = target % CLASSES
        bias = np.empty((CLASSES, CLASSES + PER_CLASS), np.float32)  # one row for each class
        bias[:, :CLASSES], bias[:, CLASSES:] = p["bc"], p["bw"]
        z = h @ p["w"]
        z += bias.take(cls, 0, mode="clip")
        if n and z.max() > LARGEST:
            np.minimum(z, LARGEST, out=z)
        first = np.arange(n) * z.shape[1]
        return rows, h, z, np.concatenate([first + cls, first + (CLASSES + target // CLASSES)])

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, _, z, places = self._levels(context, target)
        chosen = z.take(places, mode="clip").reshape(2, -1).sum(0)
        return chosen - np.log(_sums(np.exp(z, out=z))).reshape(-1, 2).sum(1)

    def forward(self, context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hidden layer, both softmaxes side by side, and log-probability."""
        _, h, z, places = self._levels(context, target)
        z.reshape(-1, CLASSES)[:] = np.exp(z.reshape(-1, CLASSES)) / _sums(np.exp(z))[:, None]
        return h, z, np.log(z.take(places)).reshape(2, -1).sum(0)

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step against the gradient of the batch's summed log-loss, divided by the root of the batch's size."""
        p, n = self.p, len(target)
        rows, h, error, places = self._levels(context, target)
        scale = np.float32(rate / np.sqrt(n))
        np.exp(error, out=error)
        error.reshape(-1, CLASSES)[:] *= (scale / _sums(error))[:, None]
        error.reshape(-1)[places] -= scale
        dh = error @ np.ascontiguousarray(p["w"].T)
        dh *= 1 - h * h
        ones = np.ones(n, np.float32)
        p["w"] -= h.T @ error
        p["bc"] -= ones @ error[:, :CLASSES]
        p["b"] -= ones @ dh
        hot = np.zeros((CLASSES, n), np.float32)
        hot[target % CLASSES, np.arange(n)] = 1
        p["bw"] -= hot @ error[:, CLASSES:]
        # Single numbers, as NumPy has a fast loop for those only.
        np.subtract.at(p["e"].reshape(-1), CELLS.take(rows, 0, mode="clip").ravel(), np.concatenate([dh.ravel()] * len(SIDES)))


def _sums(z: np.ndarray) -> np.ndarray:
    """Sums of each level of (n, both levels), which have as many entries: (2 n,)."""
    return z.reshape(-1, CLASSES) @ np.ones(CLASSES, np.float32)


def _contexts(ids: np.ndarray, row_words: np.ndarray) -> np.ndarray:
    """Neighbour ids of every token, VOCAB beyond a row's ends."""
    at = np.arange(len(ids))
    first, end = (np.repeat(x, np.diff(row_words)) for x in (row_words[:-1], row_words[1:]))
    out = np.full((len(SIDES), len(ids)), VOCAB)
    for k, side in enumerate(SIDES):
        ok = (at + side >= first) & (at + side < end)
        out[k, ok] = ids[at[ok] + side]
    return out


def _train(shared, round_no: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        net.load(net.flat())  # a copy of its own
        seen = 0
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in slices(offsets):
                hashes, _, _, ids, row_words = vocabulary(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                tokens = net.tokens(hashes)[ids]
                context = _contexts(tokens, row_words)
                order = np.random.default_rng(round_no).permutation(len(tokens))
                context, tokens = context.take(order, 1), tokens.take(order)
                for a in range(0, len(order), BATCH):
                    net.step(context[:, a : a + BATCH], tokens[a : a + BATCH], RATE)
                seen += len(tokens)
        if seen:
            parts = np.array_split(net.flat(), PIECES)
            yield pa.RecordBatch.from_pydict(
                {"piece": pa.array(range(PIECES), pa.int32()), "weight": pa.array([seen] * PIECES, pa.int64()), "data": [x.tobytes() for x in parts]}
            )

    return run


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = sorted(zip(pdf["weight"], pdf["data"], strict=True))
    total = sum(w for w, _ in rows)
    mean = sum(np.frombuffer(d, np.float32).astype(float) * (w / total) for w, d in rows)
    return pd.DataFrame({"piece": [int(pdf["piece"].iloc[0])], "data": [mean.astype(np.float32).tobytes()]})


def train_network(text: DataFrame) -> tuple[Network, Rare]:
    """A network and the counts of other words for the corpus in the string column of ``text``; the second column is the round of each row."""
    spark = text.sparkSession
    rows = text.toDF("body", "round")
    text = rows.select("body")
    counts = text.mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    counts = materialize(counts, "words")
    top = counts.orderBy(F.desc("c"), "h").limit(VOCAB - OTHER).collect()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    known, known_counts = np.array([r["h"] for r in top], np.int64).view(U64), np.array([r["c"] for r in top], float)
    net, rare = Network(known, known_counts, total), rare_words(counts, known, known_counts)
    drop(counts)
    for round_no in range(ROUNDS if top else 0):
        part = rows.where(F.col("round") == round_no).select("body")
        made = part.mapInArrow(_train(spark.sparkContext.broadcast(net), round_no), "piece int, weight long, data binary")
        pieces = made.groupBy("piece").applyInPandas(_average, "piece int, data binary").collect()  # PIECES rows, one network
        if pieces:
            net.load(np.concatenate([np.frombuffer(r["data"], np.float32) for r in sorted(pieces, key=lambda r: r["piece"])]))
    return net, rare


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value[0]
        rare: Rare = shared.value[1]
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            data, offsets = utf8(batch.column(0))
            for lo, hi in slices(offsets):
                hashes, _, _, ids, row_words = vocabulary(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                of_word = net.tokens(hashes)
                tokens, log_p = of_word[ids], np.where(of_word < OTHER, rare.log_share(hashes), 0.0)[ids]
                context = _contexts(tokens, row_words)
                for a in range(0, len(tokens), SCORED):
                    log_p[a : a + SCORED] += net.log_probability(context[:, a : a + SCORED], tokens[a : a + SCORED])
                size = np.diff(row_words)
                n[lo:hi] = size
                total[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), size), log_p, hi - lo)
            mean = np.round(total / np.maximum(n, 1), 6)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n), pa.array(np.round(total, 4)), pa.array(mean)],
                names=[*batch.schema.names, "n_tokens", "pll", "mean_pll"],
            )

    return run


def score_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, pll (sum of conditional log-probabilities) and mean_pll, from a network of their own corpus."""
    keys = [docs[f"`{f.name}`"] for f in docs.schema if f.name != text_col and isinstance(f.dataType, (NumericType, StringType))]
    model = train_network(docs.select(docs[text_col], F.pmod(F.xxhash64(F.lit(0), *keys), F.lit(ROUNDS))))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c.lower() not in ("n_tokens", "pll", "mean_pll")]
    others = [c for c in keep if c != text_col]
    rest = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(others)] or [F.lit(0).alias("none")])
    base = docs.select(docs[text_col].alias("body"), rest.alias("rest"))
    out = base.mapInArrow(_score(shared), f"body string, rest {base.schema['rest'].dataType.simpleString()}, n_tokens long, pll double, mean_pll double")
    made = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)} | {text_col: F.col("body")}
    return out.select(*[made[c].alias(c) for c in keep], "n_tokens", "pll", "mean_pll")
