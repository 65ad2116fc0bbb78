"""Operator 7: a quality classifier: logistic regression on hashed word n-grams, trained by follow the regularised leader.

A text's features are its words, pairs of words, shapes of words and pairs of shapes, hashed to BUCKETS weights; a pair
of equal words is also hashed as one and the same feature. Counts go in as logarithms, words and shapes each scaled to
length 1. FTRL-proximal updates the weights after each text (per-coordinate rates, L1 and L2), pass after pass until a
pass makes the mean loss less by under GAIN, in one task that reads a sample of at most SAMPLE labelled rows and
SAMPLE_BYTES of text in the order of a hash. A score is a sparse dot product through the logistic function, with no shuffle.

Null texts count as empty and score by the bias alone; without any labelled row all scores are 0.5. Labels that are
null or have null ids are left out. Rows are kept one for one. Texts are scored whole. The model's size is fixed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import fold_of, labelled_sample, tidy, whole_text, within_bytes
from meridian.llm.tokens import CACHE_BYTES, Memo

BUCKETS, SAMPLE, SAMPLE_BYTES, GAIN = 1 << 18, 8192, 128 << 20, 0.005
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.05
_BIAS, _REPEAT = 0, 1

_SHAPES = [(re.compile(p), s) for p, s in ((r"[^\W\d_]+", lambda m: "".join(dict.fromkeys("A" if c.isupper() else "a" for c in m[0]))), (r"\d+", "0"), (r"(.)\1+", r"\1"))]


def shape(word: str) -> str:
    for pattern, by in _SHAPES:
        word = pattern.sub(by, word)
    return word


def _codes(word: str) -> int:
    """Two 31-bit hashes: of the word and of its shape."""
    return crc32(word.encode("utf-8", "surrogatepass")) >> 1 | (crc32(b"s" + shape(word).encode("utf-8", "surrogatepass")) >> 1) << 32


class Features:
    def __init__(self):
        self.codes = Memo(_codes, CACHE_BYTES // 3)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Indices, each once for words and once for shapes, and values; the bias comes first."""
        words = text.split()
        if not words:
            return np.array([_BIAS]), np.ones(1)
        both = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        indices, values = [[_BIAS]], [[1.0]]
        same = np.full(int((both[1:] == both[:-1]).sum()), _REPEAT)
        for salt, h in ((1, both & 0x7FFFFFFF), (2, both >> 32)):
            pairs = (h[:-1] * 0x9E3779B1 + h[1:] * 0x85EBCA6B + salt) >> 7
            found, n = np.unique(np.concatenate([2 + (h + salt) % (BUCKETS - 2), 2 + pairs % (BUCKETS - 2), same]), return_counts=True)
            x = np.log1p(n)
            indices.append(found)
            values.append(x / np.sqrt(x @ x))
        return np.concatenate(indices), np.concatenate(values)


class Ftrl:
    """FTRL-proximal for logistic regression."""

    def __init__(self):
        self.z, self.n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> float:
        """Learns from a text; returns the loss before."""
        w = self.weights(at)
        p = sigmoid(w @ x)
        g = (p - y) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        np.add.at(self.z, at, g - step * w)  # an index may occur for words and for shapes
        np.add.at(self.n, at, g * g)
        return -float(np.log(p if y else 1 - p))


def sigmoid(v):
    return 1.0 / (1.0 + np.exp(-np.clip(v, -35, 35)))


def fit(rows: Iterable[tuple[str, int]], gain: float = GAIN) -> np.ndarray:
    """The weights learnt from texts and labels. Passes end, as the loss cannot fall for ever by `gain`."""
    features, model, last = Features(), Ftrl(), np.inf
    learnt = [(*features(t), y) for t, y in rows]
    while learnt:
        loss = sum(model.update(at, x, y) for at, x, y in learnt) / len(learnt)
        if last - loss < gain:
            break
        last = loss
    return model.weights().astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """The weights learnt from labels.quality of at most `sample` rows outside the held-out fold, of `sample_bytes` in all."""
    rows = labelled_sample(docs, labels, "quality", fold_of("doc_id", folds) != held_out, sample)
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = fit(within_bytes(batches, sample_bytes))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at], pa.float32())], ["at", "w"])

    weights = np.zeros(BUCKETS, np.float32)
    for row in rows.mapInArrow(tidy(run), "at int, w float").collect():  # BUCKETS rows at most
        weights[row[0]] = row[1]
    return weights


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> Column:
    """A column of `docs`: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features, w = Features(), shared.value
        for texts in batches:  # one text at a time in Python
            yield pa.array([float(sigmoid(w[at] @ x)) for at, x in (features(t) for t in (s.as_py() for s in texts))], pa.float64())

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidy(run)(batches)

    return scores(whole_text(text_col))
