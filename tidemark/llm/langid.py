"""Language identification: words first, then progressively shorter character n-grams.

Training counts words and character n-grams (4 down to 1, word borders included) per language. A known word
adds the log of its smoothed frequency in each language. An unseen word is read position by position: the longest
known n-gram that starts there adds its log frequency, and the word counts as the mean over its
positions. The language with the largest sum wins.

Fitted on at most ``sample`` labelled documents (the smallest by hash of the id, whole texts), with at most
``known`` entries of each kind that occur at least twice; predictions cover all rows in one pass with no shuffle.

Edge cases: null text and text without a letter are ``und`` with score 0, and so is everything if nothing was
learned; a text of any length is read whole; rows with a null id or language are not learned from, those that repeat are learned from and judged
one by one; ties go to the language that sorts first; extra columns are kept, those named like output columns are replaced; an empty table gives an
empty table.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import drop, materialize
from tidemark.llm.textkernels import U64, char_grams, slices, utf8, vocabulary, word_points

LONGEST = 4
SAMPLE = 12_000
#: Most entries of each kind (words, n-grams of each length) in the model; the most frequent are kept.
KNOWN = 150_000
PARTS = 8


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, lang, hash, count) per batch; kind 0 is words, n is n-grams."""
    for batch in batches:
        langs, code = np.unique(np.array(batch.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True)
        code = code.reshape(-1)
        data, offsets = utf8(batch.column(0))
        for lo, hi in slices(offsets):
            part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            hashes, starts, ends, ids, row_words = vocabulary(part, offs)
            lang_of = np.repeat(code[lo:hi], np.diff(row_words))
            times = np.zeros((len(langs), len(hashes)))
            np.add.at(times, (lang_of, ids), 1)
            points = word_points(part, starts, ends)
            found = [(0, hashes, np.arange(len(hashes)))]
            found += [(n, *char_grams(points, n)[:2]) for n in range(1, LONGEST + 1)]
            for kind, h, word in found:
                keys, at = np.unique(h, return_inverse=True)
                for k, lang in enumerate(langs):
                    count = np.bincount(at.reshape(-1), times[k][word], len(keys)).astype(np.int64)
                    full = np.flatnonzero(count)
                    yield pa.RecordBatch.from_pydict(
                        {"kind": pa.array(np.full(len(full), kind), pa.int32()), "lang": pa.array([str(lang)] * len(full), pa.string()),
                         "h": pa.array(keys[full].view(np.int64)), "c": pa.array(count[full])}
                    )


class Model:
    """Sorted hashes and log frequencies by language, for words and n-grams."""

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs, self.tables = langs, tables

    def look_up(self, kind: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row in the table of a kind, and whether the hash is known."""
        known = self.tables[kind][0]
        if not len(known):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return at, known[at] == hashes

    def words(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log frequency of distinct words in every language, backing off for unseen ones."""
        out = np.zeros((len(hashes), len(self.langs)))
        at, seen = self.look_up(0, hashes)
        out[seen] = self.tables[0][1][at[seen]]
        new = np.flatnonzero(~seen)
        if not len(new):
            return out
        points = word_points(data, starts[new], ends[new])
        chars = points != 32
        word = np.cumsum(~chars) - 1
        score = np.zeros((len(points), len(self.langs)))
        open_ = chars.copy()
        for n in range(LONGEST, 0, -1):
            grams, _, spots = char_grams(points, n)
            at, known = self.look_up(n, grams)
            use = known & open_[spots]
            score[spots[use]] = self.tables[n][1][at[use]]
            open_[spots[use]] = False
        used = chars & ~open_
        count = np.maximum(np.bincount(word[used], minlength=len(new))[: len(new)], 1)
        for k in range(len(self.langs)):
            out[new, k] = np.bincount(word[used], score[used, k], len(new))[: len(new)] / count
        return out


def fit(train: DataFrame, known: int = KNOWN) -> Model:
    """A model from (body, lang), a bounded sample; at most ``known`` entries of each kind, those of the largest totals."""
    counts = train.mapInArrow(_counts, "kind int, lang string, h long, c long")
    by_lang = materialize(counts.groupBy("kind", "h", "lang").agg(F.sum("c").alias("c")), "entries")
    each = by_lang.groupBy("kind", "h").agg(F.sum("c").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by"))
    each = each.where("total >= 2")
    # The smallest total that leaves at most ``known`` entries of a kind, from how often each total occurs.
    room: dict[int, int] = {}
    least: dict[int, int] = {}
    for kind, total, n in each.groupBy("kind", "total").count().orderBy("kind", F.desc("total")).collect():
        left = room.get(kind, known)
        room[kind] = left - n if left >= n else 0
        if left >= n:
            least[kind] = total
    enough = [(F.col("kind") == k) & (F.col("total") >= t) for k, t in least.items()]
    kept = each.where(functools.reduce(operator.or_, enough, F.lit(False))).select("kind", "h", "by")
    totals = {(r["kind"], r["lang"]): r["n"] for r in by_lang.groupBy("kind", "lang").agg(F.sum("c").alias("n")).collect()}
    langs = sorted({lang for _, lang in totals})
    table = kept.select("kind", "h", *[F.coalesce(F.col("by")[lang], F.lit(0)).alias(f"c{k}") for k, lang in enumerate(langs)]).toPandas()
    drop(by_lang)
    tables = []
    for kind in range(LONGEST + 1):
        part = table[table["kind"] == kind]
        h = part["h"].to_numpy(np.int64).view(U64)
        order = np.argsort(h)
        c = part[[f"c{k}" for k in range(len(langs))]].to_numpy(float)[order]
        n = np.array([totals.get((kind, lang), 0) for lang in langs], float)
        tables.append((h[order], np.log((c + 0.5) / (n + 0.5 * (len(h) + 1)))))
    return Model(langs, tables)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            text = batch.column(0).fill_null("")
            readable = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
            n = len(model.langs)
            best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            data, offsets = utf8(text)
            for lo, hi in slices(offsets) if n else []:
                part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                hashes, starts, ends, ids, row_words = vocabulary(part, offs)
                by_word = model.words(part, hashes, starts, ends)
                words = np.diff(row_words)
                rows = np.repeat(np.arange(hi - lo), words)
                total = np.stack([np.bincount(rows, by_word[ids, k], hi - lo) for k in range(n)], 1)
                mean = total / np.maximum(words, 1)[:, None]
                # A text counts like 20 words at most, so the score keeps apart what long texts would drive to 1.
                gap = (mean - mean.max(1, keepdims=True)) * np.minimum(words, 20)[:, None]
                share = np.exp(gap)
                best[lo:hi], score[lo:hi] = total.argmax(1), 1 / share.sum(1)
            names = np.array([*model.langs, "und"], dtype=object)
            best[~readable | (n == 0)] = n
            score[~readable] = 0.0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best].tolist(), pa.string()), pa.array(np.round(score, 9))],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return run


def identify_language(
    docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample: int = SAMPLE, known: int = KNOWN,
) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), learned from ``training`` (id, text, lang).

    ``sample`` bounds the labelled documents of the fit, ``known`` the model's entries of each kind, so that it can be broadcast.
    """
    spark = docs.sparkSession
    chosen = training.select(training[id_col].alias("id"), training[lang_col].alias("lang")).where("id is not null and lang is not null")
    chosen = chosen.select(F.xxhash64("id").alias("turn"), "id").orderBy("turn", "id").limit(sample)
    last = chosen.agg(F.max(F.struct("turn", "id")).alias("x")).select("x.turn").first()[0]
    body = training.select(training[text_col].alias("body"), training[lang_col].alias("lang")).where(
        F.lit(last is not None) & training[id_col].isNotNull() & (F.xxhash64(training[id_col]) <= F.lit(last if last is not None else 0)) & training[lang_col].isNotNull()
    )
    train = materialize(body.repartition(PARTS), "train")
    model = spark.sparkContext.broadcast(fit(train, known))
    drop(train)
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    others = [c for c in keep if c != text_col]
    base = docs.select(docs[text_col].alias("body"), F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(others)] or [F.lit(0).alias("none")]).alias("rest"))
    out = base.mapInArrow(_predict(model), f"body string, rest {base.schema['rest'].dataType.simpleString()}, lang_pred string, score double")
    made = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)} | {text_col: F.col("body")}
    return out.select(*[made[c].alias(c) for c in keep], "lang_pred", "score")
