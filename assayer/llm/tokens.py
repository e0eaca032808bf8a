"""Token counts that are exact at every prefix of a text, so that cuts and budgets need no second encoding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from assayer.llm.ship import frugal
from assayer.llm.wordbpe import WordBpe

TABLE = "doc_id bigint, n_bytes bigint, n_tokens bigint, prefix_table binary"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    """One vocabulary, with what it has learnt, for each Python worker."""
    return WordBpe(path)


def token_table(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of `docs`: id, UTF-8 bytes, tokens, and the compressed table of token counts at every prefix.

    `path` is a word-level BPE file for the tokenizers library; counts are those of `encode(prefix,
    add_special_tokens=False)`. Null texts are empty (0 bytes, 0 tokens); null ids stay null; repeated rows give
    repeated results; other columns of `docs` are not read. One pass, no shuffle, memory by the longest text.
    """

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            sizes, totals, tables = [], [], []
            for deltas in bpe.prefix_deltas(batch.column(1)):
                totals.append(int(deltas.sum(dtype=np.int64)))
                tables.append(zlib.compress(deltas, 1))
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes.cast(pa.int64()), pa.array(totals, pa.int64()), pa.array(tables, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "prefix_table"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, TABLE)


def counts_at(table: bytes) -> np.ndarray:
    """Token count of the prefix that ends at each byte."""
    return np.cumsum(np.frombuffer(zlib.decompress(table), dtype=np.int8), dtype=np.int64)


def tokens_of_prefix(table: Column, n_bytes: Column) -> Column:
    """Tokens of the first `n_bytes` bytes (as far as they are whole characters)."""

    @pandas_udf("bigint")
    def look(tables, sizes):
        import pandas as pd

        return pd.Series([int(counts_at(t)[: max(0, int(n))][-1]) if n > 0 and len(counts_at(t)) else 0 for t, n in zip(tables, sizes, strict=True)])

    return look(table, n_bytes)


def bytes_in_budget(table: Column, budget: int) -> Column:
    """The longest prefix, in bytes, whose token count is at most `budget`."""

    @pandas_udf("bigint")
    def look(tables):
        import pandas as pd

        out = []
        for t in tables:
            fits = np.flatnonzero(counts_at(t) <= budget)
            out.append(int(fits[-1]) + 1 if len(fits) else 0)
        return pd.Series(out)

    return look(table)
