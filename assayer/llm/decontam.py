"""Benchmark items in documents: fingerprints of item-sized windows, a multi-index on their blocks, and an exact check.

DataFrame functions only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from assayer.llm.storage import Scratch

BITS = 64
RADIUS = 27
#: The filter that a shingle passes before it is looked up has 2**23 bits (1 MB) at any size of the benchmark.
FILTER_BITS = 23


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def once(column: Column) -> Column:
    """Computed once for each row: the optimizer copies no expression into its uses, or into filters, past a generator."""
    return F.explode_outer(F.array(column))


def shingle_hashes(w: Column, width: int) -> Column:
    """The hash of each run of `width` words, in order; none for fewer words."""
    none = F.array().cast("array<bigint>")
    each = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    return F.when(F.size(w) >= width, each).otherwise(none)


def fingerprint(hashes: Column) -> Column:
    """SimHash: each bit is that of most hashes, where a hash counts as often as it occurs."""

    def bit(k: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda a, h: a + F.getbit(h, k).cast("int"))
        return F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def blocks(fp: Column, radius: int) -> Column:
    """The fingerprint cut into `radius` + 1 blocks: of two that differ in `radius` bits at most, one block at least is equal."""
    n = radius + 1
    edges = [k * BITS // n for k in range(n + 1)]
    # A block's number stands above its bits, so that equal values are of the same block.
    return F.array(*[F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint")) + F.lit(k << 32) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def weighted_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two multisets of shingles: sums of the lesser over sums of the larger weights, a weight being a shingle's count."""
    count = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    general = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, h: s + F.least(count(a, h), count(b, h)))
    # If one of them repeats nothing, the lesser weights are all 1.
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    common = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(general)
    return common / (F.size(a) + F.size(b) - common)


def probes(h: Column) -> list[Column]:
    """Two places of the filter for each hash."""
    return [F.shiftrightunsigned(h, 64 - FILTER_BITS), F.shiftrightunsigned(h, 40 - FILTER_BITS).bitwiseAND((1 << FILTER_BITS) - 1)]


def shingle_filter(hashes: DataFrame) -> DataFrame:
    """One row, `bits`: an array of 64-bit words with two bits set for each hash `h`. Its size is fixed; more hashes let more others pass."""
    at = hashes.select(F.explode(F.array(*probes(F.col("h")))).alias("at")).distinct()
    words_set = at.groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(63).cast("int"))).alias("w"))
    every = hashes.sparkSession.range(0, 1 << (FILTER_BITS - 6), numPartitions=1).join(words_set, "id", "left")
    return every.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("bigint")).alias("w")))), lambda x: x["w"]).alias("bits"))


def literal(words: list[int], spark: SparkSession) -> Column:
    """An array of 64-bit numbers as a literal, handed over in one piece."""
    jvm = spark.sparkContext._jvm
    array = spark.sparkContext._gateway.new_array(jvm.long, len(words))
    jvm.java.nio.ByteBuffer.wrap(np.array(words, dtype=">i8").tobytes()).asLongBuffer().get(array)
    return ClassicColumn(jvm.org.apache.spark.sql.functions.lit(array))


def may_be_in(bits: Column, h: Column) -> Column:
    one, other = (F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1 for at in probes(h))
    return one & other


def contaminated(
    docs: DataFrame, benchmark: DataFrame, scratch: Scratch, width: int = 5, similarity: float = 0.8, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """`doc_id, item_id, start, n_words, distance, similarity`: the best window of each document for each item that it holds.

    A window has as many words as the item, starts at any word and is cut where the text begins or ends. Two multisets of
    m and k shingles are similar only if they share `similarity / (1 + similarity)` of m + k, so a window can only
    be similar if so many places in it hold shingles of that item, in any order: all windows that do, and no others, are
    fingerprinted. Windows whose fingerprint differs from their item's in at most `radius` of 64 bits share a block
    with it and are compared exactly; equal copies always are. The radius leaves none out in practice (README).
    Of windows with equal similarity the first counts. Items or texts of fewer than `width` words, empty ones and
    nulls hold no shingle and match nothing; null ids are left out; repeated rows count once; rows of one id with
    different texts are looked at each for itself, and the best window counts. Other columns are not read.
    """
    items = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("t")).where("item_id is not null").distinct()
    items = items.select("item_id", once(words(F.col("t"))).alias("w")).select("item_id", once(shingle_hashes(F.col("w"), width)).alias("item_s")).where(F.size("item_s") > 0)
    items = items.select(F.xxhash64("item_id", "item_s").alias("item"), "item_id", F.size("item_s").alias("m"), "item_s", once(fingerprint(F.col("item_s"))).alias("item_fp"))
    items = scratch.keep(items, "items", benchmark.count(), 10_000)
    places = items.select("item", "m", F.explode(F.array_distinct("item_s")).alias("h"))
    bits = literal(shingle_filter(places.select("h")).first()["bits"], docs.sparkSession)

    # One pass over the texts: what holds a shingle of the benchmark goes on, with the places of those.
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null")
    texts = texts.select("doc_id", once(words(F.col("t"))).alias("w")).select("doc_id", once(shingle_hashes(F.col("w"), width)).alias("s")).where(F.size("s") > 0)
    hits = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: may_be_in(bits, F.get("s", i)))
    texts = texts.select("doc_id", "s", once(hits).alias("at")).where(F.size("at") > 0)
    texts = scratch.keep(texts.select(F.xxhash64("doc_id", "s").alias("row"), "doc_id", F.size("s").alias("n"), "s", "at"), "texts")

    # Places of each item's shingles in each text, in order; a text's own are bounded by the text.
    found = texts.select("row", "n", F.explode(F.transform("at", lambda i: F.struct(i.alias("i"), F.get("s", i).alias("h")))).alias("x")).select("row", "n", "x.i", "x.h")
    found = found.join(places, "h").groupBy("row", "n", "item", "m").agg(F.array_sort(F.collect_set("i")).alias("p"))
    # So many places, `c`, are in every similar window; any `c` in turn, if near enough, give its starts.
    c = F.greatest(F.lit(1), F.ceil(F.col("m") * similarity - F.lit(1e-9)).cast("int"))
    found = found.withColumn("c", c).where(F.size("p") >= F.col("c"))
    runs = F.transform(F.sequence(F.lit(0), F.size("p") - F.col("c")), lambda j: F.struct((F.get("p", j + F.col("c") - 1) - F.col("m") + 1).alias("lo"), F.get("p", j).alias("hi")))
    starts = F.array_distinct(F.flatten(F.transform(F.filter(runs, lambda r: r["lo"] <= r["hi"]), lambda r: F.sequence(r["lo"], r["hi"]))))
    windows = found.select("row", "n", "item", "m", "p", F.explode(starts).alias("start"))
    windows = windows.withColumns({"first": F.greatest(F.lit(0), "start"), "size": F.least("n", F.col("start") + F.col("m")) - F.greatest(F.lit(0), "start")})
    held = F.size(F.filter("p", lambda i: (i >= F.col("start")) & (i < F.col("start") + F.col("m"))))
    windows = windows.where(held >= (F.col("m") + F.col("size")) * (similarity / (1 + similarity)) - F.lit(1e-9)).select("row", "item", "start", "first", "size")
    windows = scratch.keep(windows, "windows")

    # Both sides grow with the documents that hold benchmark text, and compress well: no broadcast.
    shown = windows.join(texts.select("row", "doc_id", "s").hint("merge"), "row").select("doc_id", "item", "start", F.slice("s", F.col("first") + 1, F.col("size")).alias("s"))
    shown = shown.select("*", once(fingerprint(F.col("s"))).alias("fp")).join(items, "item")
    near = shown.where(F.arrays_overlap(blocks(F.col("fp"), radius), blocks(F.col("item_fp"), radius))).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).where(F.col("distance") <= radius)
    pairs = near.select("doc_id", "item_id", "start", "m", "distance", once(weighted_similarity(F.col("s"), F.col("item_s"))).alias("similarity")).where(F.col("similarity") >= similarity)
    best = scratch.keep(pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "m", "distance")).alias("b")), "best", windows.count(), 5_000)
    scratch.drop(items, texts, windows)
    return best.select("doc_id", "item_id", F.greatest(F.lit(0), -F.col("b.back")).alias("start"), (F.col("b.m") + width - 1).alias("n_words"), F.col("b.distance").alias("distance"), F.col("b.similarity").alias("similarity"))
