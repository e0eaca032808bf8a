"""Lines that recur across documents, found by a range partitioning of their hashes with a secondary sort."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.ship import frugal
from assayer.llm.storage import Scratch

STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    return F.translate(F.trim(line, F.lit(STRIPPED)), UPPER, LOWER)


def line_hashes(docs: DataFrame, least_chars: int, doc_id: str, text: str) -> DataFrame:
    """Two hashes (96 bits), document and position of each line whose key is long enough to count."""
    lines = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    lines = lines.where("doc is not null").select("doc", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    return lines.select(F.xxhash64("key").alias("h"), (F.crc32(F.encode("key", "UTF-8")) - 2**31).cast("int").alias("g"), "doc", "pos")


def repeated_lines(docs: DataFrame, scratch: Scratch, least_chars: int = 40, least_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Document and position of every line that goes: its key is in `least_docs` documents or more and not kept in this one.

    The hashes are dealt by ranges of (hash, document) and sorted by hash, then document (largest first), then
    position. A task streams over its range: of each hash the first document is the one that keeps its lines, and a
    row is let out as soon as `least_docs` documents of its hash have passed, so at most the rows of
    `least_docs` - 1 documents of one hash are held. A common line's range is split between tasks; only the first
    and the last hash of a task can be shared with others. Rows of those leave undecided, with one count for
    each task and hash, and a second small step adds up the counts and decides them.
    """
    rows = line_hashes(docs, least_chars, doc_id, text)
    # The complement of the document's id puts the largest first while all keys ascend.
    # They are written first, as finding the ranges reads them once more.
    rows = scratch.keep(rows.select("h", "g", F.bitwise_not("doc").alias("back"), "pos"), "hashes")
    ranged = rows.repartitionByRange("h", "g", "back").sortWithinPartitions("h", "g", "back", "pos")

    @frugal
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            h, g, back, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            if run is not None and run.key != (h[0], g[0]):
                yield from run.finish(False)
                run = None
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            new_doc = new.copy()
            new_doc[1:] |= back[1:] != back[:-1]
            start = np.flatnonzero(new)
            end = np.append(start[1:], len(h))
            if run is None:
                run = _Run((h[0], g[0]), back[0], first, least_docs)
            else:
                new_doc[0] = back[0] != run.last
            docs_of = np.add.reduceat(new_doc.astype(np.int64), start)
            yield from run.take(docs_of[0], back[: end[0]], pos[: end[0]])
            if len(start) > 1:
                yield from run.finish(False)
                a, b = end[0], start[-1]  # runs that lie within the batch
                size = (end - start)[1:-1]
                gone = np.repeat(docs_of[1:-1] >= least_docs, size) & (back[a:b] != np.repeat(back[start[1:-1]], size))
                if gone.any():
                    yield _rows(0, h[a:b][gone], g[a:b][gone], back[a:b][gone], pos[a:b][gone])
                run = _Run((h[b], g[b]), back[b], False, least_docs)
                yield from run.take(docs_of[-1], back[b:], pos[b:])
            first = False
        if run is not None:
            yield from run.finish(True)

    found = scratch.keep(ranged.mapInArrow(stream, "kind int, h bigint, g int, doc bigint, n bigint"), "lines")
    counts = found.where("kind = 2").groupBy("h", "g").agg(F.sum("n").alias("n_docs"), F.max("doc").alias("top"))
    counts = scratch.keep(counts.where(F.col("n_docs") >= least_docs), "counts", rows=1)  # at most two hashes for each task
    scratch.drop(rows)
    undecided = found.where("kind = 1").join(counts.hint("merge"), ["h", "g"]).where("doc <> top")
    return found.where("kind = 0").select("doc", F.col("n").alias("pos")).unionByName(undecided.select("doc", F.col("n").alias("pos")))


def _rows(kind: int, h, g, back, n) -> pa.RecordBatch:
    size = len(back)
    columns = [np.full(size, kind, np.int32), np.broadcast_to(h, size), np.broadcast_to(g, size), ~np.asarray(back, np.int64), np.asarray(n, np.int64)]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), k) for c, k in zip(columns, kinds, strict=True)], ["kind", "h", "g", "doc", "n"])


class _Run:
    """The rows of one hash as they pass. Kinds of rows let out: 0 goes, 1 undecided, 2 a count of documents."""

    def __init__(self, key: tuple, top: int, edge: bool, least: int):
        self.key, self.top, self.edge, self.least = key, top, edge, least
        self.docs, self.last, self.held = 0, top, []

    def take(self, docs: int, back: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.docs += int(docs)
        self.last = back[-1]
        if self.edge:  # it may have begun in the task before
            yield _rows(1, *self.key, back, pos)
        elif self.docs < self.least:
            self.held.append((back.copy(), pos.copy()))
        else:
            for b, p in [*self.held, (back, pos)]:
                if (gone := b != self.top).any():
                    yield _rows(0, *self.key, b[gone], p[gone])
            self.held = []

    def finish(self, task_ends: bool) -> Iterator[pa.RecordBatch]:
        if self.edge or task_ends:
            for b, p in self.held:
                yield _rows(1, *self.key, b, p)
            yield _rows(2, *self.key, [self.top], [self.docs])


def pack_bits(drop: np.ndarray, n_lines: int) -> bytes:
    keep = np.ones(n_lines, dtype=np.uint8)
    keep[drop] = 0
    return zlib.compress(np.packbits(np.append(keep, np.ones(-n_lines % 8, np.uint8))).tobytes(), 6)


def keep_lines(text: str, bitmap: bytes | None) -> list[str]:
    """The lines that stay. Lines past the bitmap's end stay; without one all do."""
    lines = text.split("\n")
    if bitmap is None:
        return lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8)).tolist()
    return [line for k, line in enumerate(lines) if k >= len(keep) or keep[k]]


def keep_bitmaps(docs: DataFrame, scratch: Scratch, least_chars: int = 40, least_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document that loses lines: `doc_id`, `n_dropped` and `keep_bitmap`, the compressed bits of its lines up to its last dropped one.

    Documents without a row keep all their lines; so do rows with a null id or text, which count for no line.
    Repeated rows of one document lose the same lines. Ties need no rule: a document keeps all or none of a key's lines.
    Other columns are not read.
    """

    @frugal
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, maps = [], [], []
            for doc, drop in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at = drop.values.to_numpy()
                ids.append(doc)
                counts.append(len(at))
                maps.append(pack_bits(at, int(at.max()) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "n_dropped", "keep_bitmap"])

    gone = repeated_lines(docs, scratch, least_chars, least_docs, doc_id, text)
    # A document's own lines are bounded by the document.
    return gone.groupBy("doc").agg(F.collect_set("pos").alias("gone")).mapInArrow(pack, "doc_id bigint, n_dropped bigint, keep_bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the dropped lines, all columns kept; texts with nothing dropped, and null texts, are as they were.

    Rows with a null id keep all their lines; repeated rows of a document lose the same ones; an empty table stays empty.
    """

    @frugal
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts, bits = batch.column(at), batch.column(batch.num_columns - 1)
            cut = pc.and_(texts.is_valid(), bits.is_valid())
            if cut.true_count:
                less = ["\n".join(keep_lines(t.as_py(), b.as_py())) for t, b in zip(texts.filter(cut), bits.filter(cut), strict=True)]
                texts = pc.replace_with_mask(texts, cut, pa.array(less, texts.type))
            yield pa.RecordBatch.from_arrays([texts if k == at else batch.column(k) for k in range(batch.num_columns - 1)], batch.schema.names[:-1])

    return with_bitmaps(docs, bitmaps.select("doc_id", "keep_bitmap"), doc_id).mapInArrow(drop, docs.schema)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """`docs` and, after its own columns, those of `bitmaps` but the id, under free names; null where a document has none.

    Rows without an id meet no bitmap; they are dealt out by a hash of the row, not all to one task.
    """
    taken = {c.lower() for c in docs.columns}
    free = {c: next(n for n in (f"__{c}{'_' * k}" for k in range(len(taken) + 1)) if n not in taken) for c in ["salt", *bitmaps.columns]}
    found = bitmaps.withColumnsRenamed(free).withColumn(free["salt"], F.lit(0).cast("bigint")).hint("shuffle_hash")
    salt = F.when(docs[doc_id].isNull(), F.xxhash64(*[docs[c] for c, kind in docs.dtypes if kind in ("string", "bigint", "int")])).otherwise(F.lit(0).cast("bigint"))
    joined = docs.join(found, (docs[doc_id] == found[free["doc_id"]]) & (salt == found[free["salt"]]), "left")
    return joined.select(*[docs[c] for c in docs.columns], *[found[free[c]].alias(c if c.lower() not in taken else free[c]) for c in bitmaps.columns if c != "doc_id"])
