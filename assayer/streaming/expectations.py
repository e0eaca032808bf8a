"""Expectations on a stream: counts by event-time window, with a watermark for late rows. An extension; batches need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.align import quoted


def windowed_checks(events: DataFrame, time: str, not_null: tuple[str, ...] = (), window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """`window_start, n_rows, null_<column>...` for each window. Works on batches and on streams, where rows later than `late` are left out."""
    rows = events.withColumn(time, quoted(time).cast("timestamp"))  # watermarks are kept on timestamps with a zone only
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    counts = [F.count_if(quoted(c).isNull()).alias(f"null_{c}") for c in not_null]
    found = rows.groupBy(F.window(quoted(time), window)).agg(F.count("*").alias("n_rows"), *counts)
    return found.select(F.col("window.start").alias("window_start"), "n_rows", *[f"null_{c}" for c in not_null])
