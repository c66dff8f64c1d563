"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed character n-grams (3 to 5, inside words, word borders included); a document's value of a feature is
the number of its distinct words that hold it. Ratios r = log of the feature's smoothed share in toxic over clean
text scale the values, and a logistic regression is fitted on them by L-BFGS. Because features belong to words, a
document's score is a sum over its distinct words, and scoring is one pass with no shuffle.

The classifier is fitted on at most ``sample`` labelled documents (the smallest by hash of the id, whole texts);
scores cover all rows. Their features are turned into weights by one task of an executor; only weights and sums reach the driver. What is
broadcast is 2**18 weights at most.

Edge cases: null and empty texts get the bias alone; a text of any length is read whole; labels that are null, or whose document is missing,
are not used; of conflicting labels of one id the largest counts, for all rows of that id; rows that repeat are scored one by one; a score of
exactly 0.5 is predicted toxic; without both classes in training every score is the share of toxic labels (0 without labels); extra columns are
kept, those named like output columns are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import drop, materialize
from tidemark.llm.textkernels import SLICE_BYTES, U64, char_grams, distinct, slices, utf8, vocabulary, word_points

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
#: Labelled documents to fit on, features kept, and partitions of the training sample.
SAMPLE = 8_000
FEATURES = 12_000
PARTS = 24
#: Bytes of text expanded into features at once while training.
TRAIN_BYTES = 1 << 18
#: Rows that carry the feature sums between executors.
PIECES = 32
PENALTY = 1.0


def _word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every distinct n-gram of each word, sorted by word."""
    points = word_points(data, starts, ends)
    grams, words, _ = zip(*(char_grams(points, n) for n in SIZES), strict=True)
    key = np.concatenate(words).astype(np.int64) * BUCKETS + (np.concatenate(grams) & U64(BUCKETS - 1)).astype(np.int64)
    key = distinct(key)
    return key // BUCKETS, key % BUCKETS


def _rows_of_words(ids: np.ndarray, row_words: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of every distinct word of each row."""
    rows = np.repeat(np.arange(len(row_words) - 1), np.diff(row_words))
    key = distinct(rows * max(n_words, 1) + ids)
    return key // max(n_words, 1), key % max(n_words, 1)


def _documents(batch_column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    data, offsets = utf8(batch_column)
    for lo, hi in slices(offsets, limit):
        part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        hashes, starts, ends, ids, row_words = vocabulary(part, offs)
        words, buckets = _word_features(part, starts, ends)
        rows, used = _rows_of_words(ids, row_words, len(hashes))
        yield lo, hi, words, buckets, rows, used, len(hashes)


def _expand(words: np.ndarray, buckets: np.ndarray, rows: np.ndarray, used: np.ndarray, n_words: int):
    """(row, bucket, value) of each row's features."""
    first = np.searchsorted(words, np.arange(n_words + 1))
    size = np.diff(first)[used]
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[used], size)
    key, value = np.unique(np.repeat(rows, size) * BUCKETS + buckets[at], return_counts=True)
    return key // BUCKETS, key % BUCKETS, value


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: summed feature values of each class, and in how many documents each feature is."""
    sums = np.zeros((3, BUCKETS))
    for batch in batches:
        label = batch.column(1).to_numpy()
        for lo, _, *parts in _documents(batch.column(0), TRAIN_BYTES):
            row, bucket, value = _expand(*parts)
            toxic = label[lo + row] > 0
            sums[1] += np.bincount(bucket[toxic], value[toxic], BUCKETS)
            sums[0] += np.bincount(bucket[~toxic], value[~toxic], BUCKETS)
            sums[2] += np.bincount(bucket, minlength=BUCKETS)
    pieces = np.split(sums.astype(np.float32), PIECES, axis=1)
    yield pa.RecordBatch.from_pydict({"piece": pa.array(range(PIECES), pa.int32()), "sums": [x.tobytes() for x in pieces]})


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float32).astype(float) for x in pdf["sums"])
    return pd.DataFrame({"piece": [int(pdf["piece"].iloc[0])], "sums": [total.astype(np.float32).tobytes()]})


def _training_rows(chosen: np.ndarray, scale: np.ndarray):
    """Per slice of documents: labels, number of features of each, and the features' numbers and scaled values, document by document."""
    slot = np.full(BUCKETS, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            for lo, hi, *parts in _documents(batch.column(0), TRAIN_BYTES):
                row, bucket, value = _expand(*parts)
                keep = slot[bucket] >= 0
                row, at, value = row[keep], slot[bucket[keep]], value[keep].astype(np.float32)
                size = np.bincount(row, minlength=hi - lo).astype(np.int32)
                x = (value * scale[at]).astype(np.float32)
                yield pa.RecordBatch.from_pydict(
                    {"label": [label[lo:hi].astype(np.int8).tobytes()], "size": [size.tobytes()],
                     "at": [at.astype(np.min_scalar_type(len(chosen))).tobytes()], "value": [x.tobytes()]}
                )

    return run


def lbfgs(f, w: np.ndarray, steps: int = 150, memory: int = 8) -> np.ndarray:
    """Minimise ``f`` (value, gradient) from ``w`` with backtracking line search."""
    value, grad = f(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, alphas = -grad, []
        for s, y in reversed(past):
            alphas.append(s @ direction / (s @ y))
            direction = direction - alphas[-1] * y
        if past:
            s, y = past[-1]
            direction = direction * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            direction = direction + s * (a - y @ direction / (s @ y))
        slope, step = grad @ direction, 1.0
        while True:
            new_value, new_grad = f(w + step * direction)
            if new_value <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = step * direction, new_grad - grad
        w, gain = w + s, value - new_value
        value, grad = new_value, new_grad
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y)]
        if gain < 1e-7 * max(1.0, abs(value)):
            break
    return w


def _solve(n_features: int, favour: float, bias: float):
    """Weights of the features, then the bias, from all of ``_training_rows``; ``bias`` is where the bias starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int8, np.int32, np.min_scalar_type(n_features), np.float32)
        parts = [[np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, kinds, strict=True)] for b in batches for row in zip(*b.columns, strict=True)]
        parts.sort(key=lambda x: (x[1].tobytes(), x[2].tobytes()))  # sums of floats must not depend on which task comes first

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            value, grad = PENALTY / 2 * (w[:-1] @ w[:-1]), np.append(PENALTY * w[:-1], 0.0)
            for y, size, col, x in parts:  # part by part, so that what is in flight stays small
                row = np.repeat(np.arange(len(y)), size)
                z = np.bincount(row, x * w[col], len(y)) + w[-1]
                weight = np.where(y > 0, favour, 1.0)
                value += weight @ (np.logaddexp(0, z) - y * z)
                error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
                grad[:-1] += np.bincount(col, x * error[row], n_features)
                grad[-1] += error.sum()
            return value, grad

        w = lbfgs(loss, np.append(np.zeros(n_features), bias))
        yield pa.RecordBatch.from_pydict({"weights": [w.tobytes()]})

    return run


def fit(train: DataFrame, features: int = FEATURES) -> tuple[np.ndarray, float]:
    """Weight of each bucket and bias from (body, label), a bounded sample; the ``features`` that tell most have weights."""
    sums = np.zeros((3, BUCKETS))
    size = BUCKETS // PIECES
    counted = train.mapInArrow(_class_counts, "piece int, sums binary")
    for piece, data in counted.groupBy("piece").applyInPandas(_add_up, "piece int, sums binary").collect():  # 3 MB in all
        sums[:, piece * size : (piece + 1) * size] = np.frombuffer(data, np.float32).reshape(3, size)
    n, n_toxic = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    weights = np.zeros(BUCKETS)
    if not n_toxic or n_toxic == n:
        share = n_toxic / n if n else 0.0
        return weights, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    p, q = 1 + sums[1], 1 + sums[0]
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    strength = np.where(sums[2] >= 2, np.abs(ratio) / np.sqrt(1 / p + 1 / q), 0)
    chosen = np.sort(np.argsort(-strength, kind="stable")[:features])
    chosen = chosen[strength[chosen] > 0]
    scale = ratio[chosen]
    favour = np.sqrt((n - n_toxic) / n_toxic)  # missing the rarer class costs more
    rows = train.mapInArrow(_training_rows(chosen, scale), "label binary, size binary, at binary, value binary")
    # The rows of the bounded sample meet in one task of an executor: the driver's memory is for plans.
    bias = float(np.log(favour * n_toxic / (n - n_toxic)))
    solved = rows.repartition(1).mapInArrow(_solve(len(chosen), float(favour), bias), "weights binary")
    w = np.frombuffer(solved.first()[0])
    weights[chosen] = w[:-1] * scale
    return weights, float(w[-1])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            for lo, hi, words, buckets, rows, used, n_words in _documents(batch.column(0)):
                of_word = np.bincount(words, weights[buckets], n_words)
                z[lo:hi] += np.bincount(rows, of_word[used], hi - lo)
            score = np.round(1 / (1 + np.exp(-np.clip(z, -500, 500))), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return run


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    features: int = FEATURES,
) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5); ``labels`` has id and label of training rows.

    ``sample`` bounds the labelled documents of the fit, ``features`` the n-grams that get a weight (of those in two documents or more).
    """
    spark = docs.sparkSession
    ident = labels.schema[id_col].dataType.simpleString()
    known = (
        labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label"))
        .where("id is not null and label is not null")
        .groupBy("id").agg(F.max((F.col("label") > 0).cast("int")).alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    known = spark.createDataFrame(known.toPandas().to_records(index=False).tolist(), f"id {ident}, label int")
    text = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))
    # At most ``sample`` ids and labels are broadcast.
    train = materialize(text.join(F.broadcast(known), "id").select("body", "label").repartition(PARTS), "train")
    model = spark.sparkContext.broadcast(fit(train, features))
    drop(train)
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    others = [c for c in keep if c != text_col]
    rest = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(others)] or [F.lit(0).alias("none")])
    base = docs.select(docs[text_col].alias("body"), rest.alias("rest"))
    scored = base.mapInArrow(_score(model), f"body string, rest {base.schema['rest'].dataType.simpleString()}, score double")
    made = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)} | {text_col: F.col("body")}
    return scored.select(*[made[c].alias(c) for c in keep], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
