"""Operator 11, quality rules: base rules, then a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textkernel
from .common import Tables, held_out, released
from .wordtable import WordTable

#: Rows handled at a time: of texts that are scored, and of those that train.
ROWS, FEW = 2000, 100
#: Texts with fewer words fail; so do those with more than this share of their words in repeated windows.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: Least calibrated probability of good quality.
THRESHOLD = 0.4
#: Labelled rows of each class that the model is fitted on at most; every fifth of them calibrates instead.
SAMPLE, FOLDS = 8_000, 5
#: Parts of the sample, which is bounded.
PARTS = 12
#: Weights are 2 ** BITS; sizes of character n-grams, taken inside words with a mark at both ends.
BITS, SIZES, MARK = 16, (3, 4), 0x110000
#: A family's frequencies in a text add up to so much; strength of the penalty on squares of weights.
SCALE, PENALTY = 16.0, 1e-5
_WORD, _PAIR, _CHARS = (np.uint64(x) for x in (0x8F5C28DB12A6E1A3, 0x1D2B7AC94E3F5601, 0x6A09E667F3BCC909))
#: Symbols that are counted (fixed values).
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _place(hashes: np.ndarray, family: np.uint64) -> np.ndarray:
    """The weight that a term of a family stands at."""
    return (textkernel.mix(hashes + family) >> np.uint64(64 - BITS)).astype(np.int64)


def _pairs(w: textkernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every two neighbouring words of a row."""
    row = np.repeat(np.arange(w.last - w.first), np.diff(w.row_offsets))
    inside = row[1:] == row[:-1]
    return row[1:][inside], _place(textkernel.combine([w.hashes[:-1], w.hashes[1:]])[inside], _PAIR) if len(row) > 1 else row[:0]


def _characters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, place) of every character n-gram of words."""
    codes = [np.frombuffer(w.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for w in words]
    size = np.array([len(c) + 2 for c in codes], np.int64)
    flat = np.full(int(size.sum()), MARK, np.uint64)
    of = np.repeat(np.arange(len(words)), size)
    ends = np.cumsum(size)
    own = np.ones(len(flat), bool)
    own[ends - 1] = own[ends - size] = False
    flat[own] = np.concatenate(codes) if codes else 0
    found = []
    for n in SIZES:
        at = np.flatnonzero(of[n - 1 :] == of[: len(of) - n + 1])
        found.append((of[at], _place(textkernel.combine([flat[at + i] for i in range(n)]), _CHARS)))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def base_measures(w: textkernel.Words) -> dict[str, np.ndarray]:
    """For each row of a chunk n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows, data, count = w.last - w.first, w.data, np.diff(w.row_offsets)

    def by_row(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds])

    breaks = np.flatnonzero(data == 10)
    start, end = np.sort(np.concatenate([w.row_bytes[:-1], breaks + 1])), np.sort(np.concatenate([w.row_bytes[1:], breaks]))
    line_row = np.repeat(np.arange(rows), 1 + by_row(data == 10, w.row_bytes))
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    line_row, lines = line_row[worded], textkernel.word_hashes(data, start[worded], end[worded], seed=3)
    distinct = np.unique(textkernel.combine([line_row.astype(np.uint64), lines]), return_index=True)[1] if len(lines) else np.zeros(0, np.int64)
    repeated = np.zeros(len(w.hashes) + 1, np.int64)
    if len(w.hashes) >= WINDOW:
        row = np.repeat(np.arange(rows), count)
        at = np.flatnonzero(row[WINDOW - 1 :] == row[: 1 - WINDOW])
        windows = textkernel.combine([row[at].astype(np.uint64), *(w.hashes[at + i] for i in range(WINDOW))])
        _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = at[times[place] > 1]
        np.add.at(repeated, twice, 1)
        np.subtract.at(repeated, twice + WINDOW, 1)
    return {
        "n_words": count,
        "word_chars": by_row(((data & 0xC0) != 0x80) & ~_BLANK[data], w.row_bytes),
        "n_symbols": by_row(_SYMBOL[data], w.row_bytes),
        "n_dup_lines": np.bincount(line_row, minlength=rows) - np.bincount(line_row[distinct], minlength=rows),
        "n_repeat_words": by_row(np.cumsum(repeated)[:-1] > 0, w.row_offsets),
    }


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, features) from (label, text): for each family the terms' frequencies in the text, times SCALE."""
    for batch in batches:
        for i in range(0, batch.num_rows, FEW):
            part, vectors = batch.slice(i, FEW), []
            for w in textkernel.words(part.column(1), lower=False):
                word_row = np.repeat(np.arange(w.last - w.first), np.diff(w.row_offsets))
                of, chars = _characters([w.word(k) for k in range(len(w.hashes))])
                pair_row, pairs = _pairs(w)
                families = [(word_row, _place(w.hashes, _WORD)), (pair_row, pairs), (word_row[of], chars)]
                keys, weights = [], []
                for row, place in families:
                    total = np.bincount(row, minlength=w.last - w.first)
                    keys.append(row << BITS | place)
                    weights.append(SCALE / total[row])
                key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                value = np.bincount(inverse, weights=np.concatenate(weights), minlength=len(key))
                cuts = np.searchsorted(key, np.arange(w.last - w.first + 1) << BITS)
                indices, values = (key & (1 << BITS) - 1).astype(np.int32), value
                vectors.append((cuts, indices, values))
            size = np.concatenate([np.diff(c) for c, _, _ in vectors]) if vectors else np.zeros(0, np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([v[k] for v in vectors]) if vectors else [], kind)) for k, kind in ((1, pa.int32()), (2, pa.float64()))]
            n = part.num_rows
            sparse = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, 1 << BITS, np.int32)), *lists], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([part.column(0), sparse], ["label", "features"])


@dataclass(frozen=True)
class Model:
    """Weights of terms, the intercept, and slope and intercept of the calibration: probability = logistic(slope * margin + shift)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def word_values(self, words: list[bytes]) -> np.ndarray:
        """For each distinct word its own weight, the sum of those of its character n-grams, and their number."""
        out = np.zeros((len(words), 3))
        if words:
            length = np.array([len(w) for w in words])
            end = np.cumsum(length)
            data = np.frombuffer(b"".join(words), np.uint8)
            out[:, 0] = self.weights[_place(textkernel.word_hashes(data, end - length, end), _WORD)]
            of, chars = _characters(words)
            out[:, 1] = np.bincount(of, weights=self.weights[chars], minlength=len(words))
            out[:, 2] = np.bincount(of, minlength=len(words))
        return out

    def margins(self, w: textkernel.Words, table: WordTable) -> np.ndarray:
        rows, count = w.last - w.first, np.diff(w.row_offsets)
        out = np.zeros(rows)
        if len(w.hashes):
            values, inverse = table._of(w)
            filled = np.flatnonzero(count)
            sums = np.add.reduceat(values[inverse], w.row_offsets[:-1][filled], axis=0)
            out[filled] = sums[:, 0] / count[filled] + sums[:, 1] / np.maximum(sums[:, 2], 1)
            row, pairs = _pairs(w)
            out += np.bincount(row, weights=self.weights[pairs], minlength=rows) / np.maximum(np.bincount(row, minlength=rows), 1)
        return SCALE * out + self.bias

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def _score(model):
    """Rows (doc_id, measures, prob) from (doc_id, text); without a model prob is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = model.value if model is not None else None
        table = WordTable(told.word_values) if told else None
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                for w in textkernel.words(part.column(1), lower=False):
                    measures = base_measures(w)
                    prob = pa.array(told.probabilities(told.margins(w, table))) if told else pa.nulls(w.last - w.first, pa.float64())
                    columns = [pa.array(x.astype(np.int64)) for x in measures.values()]
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(w.first, w.last - w.first), *columns, prob], ["doc_id", *measures, "prob"])

    return run


def _regression(**more) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", standardization=False, **more)


def fit(docs: DataFrame, labels: DataFrame, tables: Tables, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """A model of the texts of labelled rows, or None if the labels are all alike.

    Of each class the `sample` rows with the smallest hash of their id are taken, so that the fit is bounded however
    many labels there are; those of a fold of one in FOLDS (crc32 of the id as text) don't train, but calibrate:
    a logistic curve from margins to the share of good rows (Platt). Of rows that share an id one text trains, the least. Where the fold lacks a class, margins stand as they are.
    """
    told = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), (F.col(label_col) > 0).cast("double").alias("label")).distinct()
    chosen = None
    for label in (0.0, 1.0):
        some = told.filter(F.col("label") == label).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("text")).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    rows = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "label").agg(F.min("text").alias("text"))
    rows = rows.select("label", "text", held_out(F.col("_id"), FOLDS).alias("held"))
    rows = tables.write(rows.repartition(PARTS), "labelled")
    schema = StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())])
    train = tables.write(rows.filter("not held").select("label", "text").mapInArrow(released(_features), schema), "features")
    if train.select("label").distinct().count() < 2:
        return None
    fitted = _regression(regParam=PENALTY, maxIter=30).fit(train)
    model = Model(np.asarray(fitted.coefficients.toArray()), float(fitted.intercept), 1.0, 0.0)
    return _calibrated(model, rows.filter("held"))


def _calibrated(model: Model, held: DataFrame) -> Model:
    sent = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(sent.value.word_values)
        for batch in batches:
            for w in textkernel.words(batch.column(1), lower=False):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.last - w.first), pa.array(sent.value.margins(w, table))], ["label", "margin"])

    margins = held.select("label", "text").mapInArrow(released(run), "label double, margin double")
    margins = margins.select("label", array_to_vector(F.array("margin")).alias("features")).cache()
    try:
        if margins.select("label").distinct().count() < 2:
            return model
        curve = _regression(regParam=1e-6, maxIter=100).fit(margins)
    finally:
        margins.unpersist()
    slope = float(curve.coefficients[0])
    return Model(model.weights, model.bias, slope, float(curve.intercept)) if slope > 0 else model


def quality_rules(docs: DataFrame, labels: DataFrame, tables: Tables, threshold: float = THRESHOLD, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, prob.

    Measures are over whole texts: words, code points in them, symbols, lines with a word that equal an earlier one,
    and words inside windows of eight words that occur twice or more in the text. base_failed: fewer than 20 words, or
    over 30 percent of them in such windows. prob is the calibrated probability of good quality, from a logistic
    regression on hashed words, word pairs and character n-grams (see fit), and kept says that the base rules hold and
    prob reaches the threshold. The corpus is read once for the scores, in Arrow batches, without a shuffle.

    Null text: no words, so it fails. Null id: not labelled, but scored. Rows that repeat an id are scored each; labels
    that contradict each other count both. Without labels of both classes there is no model: prob is null, and kept is
    what the base rules say. Empty table: no rows. Other columns are ignored.
    """
    model = fit(docs, labels, tables, sample, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model) if model else None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(released(_score(sent)), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, prob double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(F.col("prob") >= threshold, F.lit(True))).alias("kept"), "prob")
