"""Toxicity scores by logistic regression, learnt with FTRL-proximal steps over hashed word n-grams and skip-grams.

Features of a text are the hashed distinct words, their first STEMS bytes (inflected forms have these in common),
word pairs and pairs with one word between, all in lower case.
Each coordinate has its own learning rate, and L1 leaves few weights that are not zero; those are what is sent to
the executors, ``SPACE`` at most. The model is fitted on labelled rows, ``SAMPLE`` at most: those with the smallest
hashes of their ids. Every text is scored whole.

A null or empty text has no features and gets the score of the intercept. Labels that are null are not learnt
from; without any labelled rows every score is 0. Repeated rows are scored each; repeated labels are each learnt
from. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import ALNUM, U64, gram_hashes, mix, slices, trim, word_hashes, word_spans

SAMPLE, SPACE, EPOCHS, STEMS = 12_000, 1 << 20, 6, (4, 6)
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.01
THRESHOLD = 0.7
_INTERCEPT = 0


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all features, and the text of each."""
    starts, ends, first = word_spans(data, offsets, ALNUM)
    words = word_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    grams, owners = [gram_hashes(words, 1)], [text]
    for stem in STEMS:
        grams.append(mix(word_hashes(data, starts, np.minimum(ends, starts + stem)) + U64(stem)))
        owners.append(text)
    for step in (1, 2):
        pair = gram_hashes(words, 2, step)
        keep = text[: len(pair)] == text[step : step + len(pair)]
        grams.append(pair[keep])
        owners.append(text[: len(pair)][keep])
    index = (np.concatenate(grams) >> U64(44)).astype(np.int64) % (SPACE - 1) + 1
    return index, np.concatenate(owners)


def fit_rows(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Weights from (distinct feature indices, label) pairs, in the order given, EPOCHS times."""
    z, n = np.zeros(SPACE), np.zeros(SPACE)

    def weights(z_: np.ndarray, n_: np.ndarray, l1: np.ndarray | float) -> np.ndarray:
        return np.where(np.abs(z_) <= l1, 0.0, -(z_ - np.sign(z_) * l1) / ((BETA + np.sqrt(n_)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for index, label in rows:
            z_, n_ = z[index], n[index]
            l1 = np.where(index == _INTERCEPT, 0.0, L1)
            w = weights(z_, n_, l1)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n_ + g * g) - np.sqrt(n_)) / ALPHA
            z[index] = z_ + g - sigma * w
            n[index] = n_ + g * g
    l1 = np.full(SPACE, L1)
    l1[_INTERCEPT] = 0
    return weights(z, n, l1)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights) of the coordinates that are not zero. Texts stay on the executors; one task learns."""
    sample = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id is not null and toxic is not null")
    sample = sample.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")

    def features(batches):
        for batch in batches:
            for row, end, data, offsets in slices(batch, "text"):
                index, owner = _features(data, offsets)
                found = [np.unique(np.append(index[owner == i], _INTERCEPT)).astype(np.int32).tobytes() for i in range(end - row)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, end - row) for c in ("doc_id", "toxic")), pa.array(found, pa.binary())], ["doc_id", "toxic", "features"])

    def learn(batches):
        rows = []
        for batch in batches:
            rows += [(np.frombuffer(f, np.int32), y) for f, y in zip(batch.column("features").to_pylist(), batch.column("toxic").to_pylist(), strict=True)]
        if rows:
            w = fit_rows(rows)
            index = np.flatnonzero(w)
            rows.clear()
            trim()
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(w[index], pa.float64())], ["i", "w"])

    found = texts.mapInArrow(features, "doc_id long, toxic int, features binary").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "toxic", "features")
    got = found.select("features", "toxic").mapInArrow(learn, "i long, w double").toArrow()
    return np.asarray(got.column("i"), dtype=np.int64), np.asarray(got.column("w"), dtype=np.float64)


def _scores(batch: pa.RecordBatch, index: np.ndarray, dense: np.ndarray):
    """(first row, end row, scores) of slices of a batch."""
    for row, end, data, offsets in slices(batch, "text"):
        found, owner = _features(data, offsets)
        hit = dense[found] != 0
        pairs = np.unique(owner[hit] * SPACE + found[hit])
        total = dense[_INTERCEPT] + np.bincount(pairs // SPACE, dense[pairs % SPACE], minlength=end - row)
        yield row, end, 1 / (1 + np.exp(-np.clip(total, -35, 35))) if len(index) else np.zeros(end - row)


def _dense(model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    dense = np.zeros(SPACE)
    dense[model[0]] = model[1]
    return dense


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        dense = _dense(model.value)
        for batch in batches:
            for row, end, score in _scores(batch, model.value[0], dense):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, whose score is under THRESHOLD."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        dense = _dense(model.value)
        for batch in batches:
            for row, end, score in _scores(batch, model.value[0], dense):
                yield batch.slice(row, end - row).filter(pa.array(score < THRESHOLD))
        trim()

    return docs.mapInArrow(run, docs.schema)
