"""Sequences of power-of-two lengths, each cut from one document: nothing crosses documents and nothing is padded."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.ship import frugal
from assayer.llm.tokens import vocabulary

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "bucket int, tokens binary"
)


def binary_lengths(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of `n` tokens: whole sequences first, then the powers of two of the rest, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def binary_pieces(docs: DataFrame, path: str, longest: int = 2048, end_id: int = 1, with_tokens: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut each document's ids, and `end_id` after them, into pieces whose lengths are powers of two up to `longest`.

    A piece is a sequence of its own, and `bucket` is the logarithm of its length: a trainer takes batches of one
    bucket, and no sequence is padded or holds two documents. Sequences are numbered within their bucket: an id is the bucket, the
    task's number and a count of the bucket's sequences within it, so that no shuffle is needed, ids of a bucket follow each other
    and are the same when a task runs again. Null texts are empty and give
    the end id alone; null ids stay null; repeated rows give pieces, with sequence ids, of their own. `tokens` holds
    the ids as little-endian 32-bit numbers (null without `with_tokens`).
    """
    assert longest & (longest - 1) == 0

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        tail = np.array([end_id], dtype="<u4")
        made = [(k << 56) + (TaskContext.get().partitionId() << 32) for k in range(longest.bit_length())]  # by bucket
        for batch in batches:
            rows: list[list] = [[] for _ in range(9)]
            held = 0
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.encode(batch.column(1)), strict=True):
                raw = np.concatenate((ids, tail)).tobytes()
                start = 0
                for length in binary_lengths(len(raw) // 4, longest):
                    piece, bucket = raw[4 * start : 4 * (start + length)], length.bit_length() - 1
                    for column, value in zip(rows, (doc, start, length, zlib.crc32(piece), len(raw) // 4, made[bucket], 0, bucket, piece if with_tokens else None), strict=True):
                        column.append(value)
                    start += length
                    made[bucket] += 1
                held += len(raw) * with_tokens + 80
                if held > 1 << 22:
                    yield _batch(rows)
                    rows, held = [[] for _ in range(9)], 0
            yield _batch(rows)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])


def bucketed(pieces: DataFrame) -> DataFrame:
    """Pieces with those of one bucket next to each other in each task, in the order of their ids.

    Written as Parquet, a bucket is a few row groups of each file, which a filter on `bucket` finds by their
    statistics: equal lengths lie together, without a shuffle and without a file for each task and bucket.
    """
    return pieces.sortWithinPartitions("bucket", "sequence_id")
