"""Quality classifier: logistic regression over hashed word n-grams, fitted with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.ship import frugal, give_back
from assayer.llm.sparse import Terms, held_out, labelled_sample, row_sums, scores, sparse_rows
from assayer.llm.text import BY_RUNS

#: Runs of letters and digits, and runs of other signs, in n-grams of one and two.
TERMS = Terms(BY_RUNS, bits=18, longest=2)
SCALE = 5.0


@dataclass
class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2 terms; `weights` are lazily derived from `z` and `n`."""

    bits: int
    rate: float = 0.5
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 1.0

    def fit(self, index: np.ndarray, value: np.ndarray, bounds: np.ndarray, label: np.ndarray, rounds: int = 3, seed: int = 7) -> tuple[np.ndarray, float]:
        z, n = np.zeros(1 << self.bits), np.zeros(1 << self.bits)
        z0 = n0 = bias = 0.0
        order = np.random.Generator(np.random.PCG64(seed))
        for _ in range(rounds):
            for r in order.permutation(len(label)):
                i, x = index[bounds[r] : bounds[r + 1]], value[bounds[r] : bounds[r + 1]]
                w = self.weights(z[i], n[i])
                error = 1 / (1 + np.exp(-np.clip(w @ x + bias, -30, 30))) - label[r]
                g = error * x
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / self.rate * w
                n[i] += g * g
                z0 += error - (np.sqrt(n0 + error**2) - np.sqrt(n0)) / self.rate * bias
                n0 += error**2
                bias = -z0 * self.rate / (self.beta + np.sqrt(n0))
        return self.weights(z, n), float(bias)

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.rate + self.l2))


def values(count: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Square roots of term frequencies, so that each text's vector has the same length whatever its size."""
    total = np.add.reduceat(np.append(count, 0), bounds[:-1]) * (np.diff(bounds) > 0) if len(bounds) > 1 else np.zeros(0)
    return SCALE * np.sqrt(count / np.repeat(total, np.diff(bounds)))


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def score(self, index: np.ndarray, count: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(row_sums(self.weights[index] * values(count, bounds), bounds) + self.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, at_most: int = 8000, doc_id: str = "doc_id", text: str = "text") -> QualityModel:
    """Fit on at most `at_most` labelled rows that are not held out; without any, every text scores one half."""
    index, count, bounds, label = sparse_rows(labelled_sample(docs, labels, "quality", at_most, doc_id, text), TERMS)
    model = QualityModel(*Ftrl(TERMS.bits).fit(index, values(count, bounds), bounds, label))
    del index, count
    give_back()
    return model


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, held_out, score, predicted` for every row, from its text alone.

    Null and empty texts have no terms and get the bias's score. Null ids stay null and are not held out; repeated rows get equal
    scores; other columns are not read. One pass, no shuffle; the model (2**18 numbers) goes with the task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = scores(docs, lambda *group: shared.value.score(*group), TERMS, doc_id=doc_id, text=text)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text scores `threshold` or more. No shuffle or join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @frugal
    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = TERMS.rows(batch.column(batch.schema.get_field_index(text)))
            found = np.concatenate([*[shared.value.score(*group) for group in groups], np.zeros(0)])
            yield batch.filter(pa.array(found >= threshold))

    return docs.mapInArrow(accept, docs.schema)
