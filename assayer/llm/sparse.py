"""Hashed terms of texts as sparse rows, and the bounded sample of labelled rows that models are fitted on."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.ship import frugal
from assayer.llm.text import mix, tokens

_U = np.uint64


@dataclass(frozen=True)
class Terms:
    """What a text's terms are: n-grams of 1 to `longest` tokens, and the first so many bytes of tokens, hashed to `bits` bits."""

    classes: np.ndarray
    bits: int = 18
    longest: int = 1
    beginnings: tuple[int, ...] = ()

    def rows(self, column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For consecutive groups of rows: distinct terms of each row, how often they occur, and each row's bounds. wanted: only these."""
        bits = _U(self.bits)
        for _, _, value, bounds, *begun in tokens(column, self.classes, self.beginnings):
            row = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
            codes, gram = [], value
            for n in range(1, self.longest + 1):
                if n > 1:
                    gram = mix(gram[:-1] * _U(0x9E3779B97F4A7C15) + value[n - 1 :]) if len(value) >= n else value[:0]
                codes.append(self._codes(gram, row[: len(gram)], wanted, row[: len(gram)] == row[n - 1 :] if n > 1 and len(gram) else None))
            for k, part in enumerate(begun[0] if begun else ()):
                codes.append(self._codes(mix(part + _U(k + 1)), row, wanted, None))
            code, count = np.unique(np.concatenate(codes), return_counts=True)
            yield (code & _U((1 << self.bits) - 1)).astype(np.int32), count, np.searchsorted(code >> bits, np.arange(len(bounds)).astype(np.uint64))

    def _codes(self, gram: np.ndarray, row: np.ndarray, wanted: np.ndarray | None, keep: np.ndarray | None) -> np.ndarray:
        term = gram >> _U(64 - self.bits)
        if wanted is not None:
            keep = wanted[term] if keep is None else keep & wanted[term]
        if keep is not None:
            term, row = term[keep], row[keep]
        return (row << _U(self.bits)) | term


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: 0 marks the rows held out."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, at_most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`text` and `label` of at most `at_most` labelled rows that are not held out, the first by a hash of the id.

    The sample of ids is bounded before the join, so it can be broadcast at any size of the tables. Rows with a null id or
    label are left out; an id labelled twice counts once, with its larger label.
    """
    wanted = labels.select(F.col("doc_id").cast("bigint").alias("__id"), F.col(label).cast("int").alias("label")).where("__id is not null and label is not null")
    wanted = wanted.where(~held_out(F.col("__id"))).orderBy(F.xxhash64("__id"), "__id", F.desc("label")).limit(at_most)
    wanted = wanted.groupBy("__id").agg(F.max("label").alias("label"))
    return docs.select(F.col(doc_id).cast("bigint").alias("__id"), F.col(text).alias("text")).join(F.broadcast(wanted), "__id").select("__id", "text", "label")


def sparse_rows(sample: DataFrame, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Indices, counts, bounds and labels of a bounded sample, in the order of its ids. They come as Arrow, which the driver reads without a copy."""

    @frugal
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, count = [], []
            for keys, counts, bounds in terms.rows(batch.column(1)):
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    index.append(keys[a:b].tobytes())
                    count.append(counts[a:b].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index, pa.binary()), pa.array(count, pa.binary()), batch.column(2)], ["id", "i", "n", "y"])

    rows = sample.mapInArrow(encode, "id bigint, i binary, n binary, y int").toArrow().sort_by([("id", "ascending"), ("i", "ascending")])
    flat = lambda name: np.frombuffer(b"".join(v.as_buffer() for v in rows[name]), dtype=np.int32)
    bounds = np.concatenate(([0], np.cumsum(np.array([v.as_buffer().size // 4 for v in rows["i"]], dtype=np.int64)))).astype(np.int64)
    return flat("i"), flat("n"), bounds, rows["y"].to_numpy().astype(np.float64)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `values` (along its first axis) within each row; 0 for rows without any."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def scores(docs: DataFrame, score: Callable, terms: Terms, wanted: np.ndarray | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id` and `score` of every row: `score(indices, counts, bounds)` gives a group's scores. No shuffle."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(*group) for group in terms.rows(batch.column(1), wanted)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*found, np.zeros(0)]), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, score double")
