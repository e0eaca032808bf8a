"""Shards of nearly equal bytes by a k-d tree over document metadata, split at distributed weighted medians."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.llm.storage import Scratch

BINS = 16  # bits of a coordinate that one pass settles
VALUE_BITS = 12  # of a coordinate; the other 20 part equal values
DIMENSIONS = ("length", "lang", "source")


def coordinates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """`doc_id, size, text_crc32, part` and `c`, a row's place in each dimension as a whole number below 2**32.

    Length counts on a logarithmic scale, language and source by hash. The lower 20 bits, `part`, come from a hash of the row and
    of a number of its own, so that equal values, and repeated rows too, stand at many places. The numbers are fixed once the
    result is written.
    """
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__t"), F.col(source).alias("source"), F.col(lang).alias("lang"))
    slim = slim.select("doc_id", "source", "lang", (F.octet_length("__t").cast("bigint") + 1).alias("size"), F.crc32(F.encode("__t", "UTF-8")).alias("text_crc32"))
    spare = BINS * 2 - VALUE_BITS
    slim = slim.withColumn("part", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), 64 - spare))
    by_hash = lambda c: F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(c), F.lit(""))), 64 - VALUE_BITS)
    values = {"length": F.least(F.lit((1 << VALUE_BITS) - 1), (F.log2(F.col("size").cast("double")) * 64).cast("bigint")), "lang": by_hash("lang"), "source": by_hash("source")}
    return slim.select("doc_id", "size", "text_crc32", "part", F.array(*[F.shiftleft(values[d].cast("bigint"), spare) + F.col("part") for d in DIMENSIONS]).alias("c"))


def _first_past(bins: DataFrame, at: str) -> DataFrame:
    """Of each node's bins in order the first with which the running sum of `b` passes `goal`: its `at`, and what of the goal is left there."""
    running = Window.partitionBy("first").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = bins.withColumn("run", F.sum("b").over(running)).where(F.col("run") > F.col("goal"))
    return passed.groupBy("first").agg(F.min(F.struct(at, (F.col("goal") - F.col("run") + F.col("b")).alias("goal"))).alias("x"))


def split_nodes(placed: DataFrame, scratch: Scratch, scale: list[float]) -> DataFrame:
    """`first, dim, cut` for each node (`first`: its first shard, `m`: how many it has) with more than one shard.

    `dim` is the dimension in which the node is widest: the variance of its bytes' places there, in proportion to the whole
    table's (`scale`). `cut` is the weighted median: left of it lie as many bytes as the node's left shards should hold.
    Two passes settle it, of 2**16 bins each; nodes and bins are tables, nothing is gathered on the driver.
    """
    open_ = placed.where("m > 1")
    bins = open_.select("first", "m", "size", F.posexplode(F.transform("c", lambda c: F.shiftright(c, BINS))).alias("dim", "bin")).groupBy("first", "m", "dim", "bin").agg(F.sum("size").alias("b"))
    bins = scratch.keep(bins, "bins")
    widest = _spreads(bins).withColumn("wide", F.round(F.col("variance") / F.get(F.array(*[F.lit(x) for x in scale]), F.col("dim")), 9))
    widest = widest.groupBy("first", "m").agg(F.max(F.struct("wide", (-F.col("dim")).alias("back"), "bytes")).alias("x"))
    goal = (F.col("x.bytes").cast("decimal(38,0)") * F.floor(F.col("m") / 2) / F.col("m")).cast("bigint")
    nodes = widest.select("first", (-F.col("x.back")).alias("dim"), goal.alias("goal"))
    upper = _first_past(bins.join(nodes, ["first", "dim"]), "bin").select("first", F.col("x.bin").alias("bin"), F.col("x.goal").alias("goal"))
    nodes = scratch.keep(nodes.drop("goal").join(upper, "first"), "nodes")
    fine = open_.join(nodes, "first").withColumn("at", F.get("c", F.col("dim"))).where(F.shiftright("at", BINS) == F.col("bin"))
    lower = _first_past(fine.groupBy("first", "goal", "at").agg(F.sum("size").alias("b")), "at").select("first", F.col("x.at").alias("cut"))
    return scratch.keep(nodes.select("first", "dim").join(lower, "first"), "cuts")


def _spreads(bins: DataFrame) -> DataFrame:
    """Bytes and the variance of their places, for each node and dimension."""
    weight, at = F.col("b").cast("double"), F.col("bin") / F.lit(float(1 << BINS))
    sums = bins.groupBy("first", "m", "dim").agg(F.sum("b").alias("bytes"), F.sum(weight * at).alias("one"), F.sum(weight * at * at).alias("two"))
    return sums.withColumn("variance", F.col("two") / F.col("bytes") - (F.col("one") / F.col("bytes")) ** 2)


def kd_shards(docs: DataFrame, scratch: Scratch, shards: int = 8, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """Deal documents to leaves of a k-d tree: `doc_id, size, text_crc32, part, shard`.

    Each node is split along the dimension in which it is widest, at the weighted median of its documents' sizes, so
    that the halves (or the parts in proportion to their number of shards) hold nearly equal bytes. `target_bytes`
    instead of `shards` splits until the leaves hold about that many. All nodes of a level are split at once, by tables of
    nodes that are joined to the rows, so their number may grow with the data. Equal values (one source may hold a
    third of all rows) are split as evenly as others, and so are repeated rows. Sizes are UTF-8 bytes plus 1; null texts are empty,
    null metadata one value of its own, null ids stay null; an empty table has no shards.
    """
    placed = scratch.keep(coordinates(docs, doc_id, text, source, lang), "slim")
    total = placed.agg(F.sum("size")).first()[0] or 0
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    placed = placed.withColumns({"first": F.lit(0).cast("bigint"), "m": F.lit(shards).cast("bigint")})
    if shards > 1:
        root = placed.select("first", "m", "size", F.posexplode(F.transform("c", lambda c: F.shiftright(c, BINS))).alias("dim", "bin")).groupBy("first", "m", "dim", "bin").agg(F.sum("size").alias("b"))
        whole = {r["dim"]: r["variance"] for r in _spreads(root).collect()}  # one row a dimension
        scale = [max(whole.get(k) or 0.0, 1e-12) for k in range(len(DIMENSIONS))]
    for _ in range((shards - 1).bit_length()):
        cuts = split_nodes(placed, scratch, scale)
        moved = placed.join(cuts, "first", "left")
        left, half = F.coalesce(F.get("c", F.col("dim")) < F.col("cut"), F.lit(True)), F.floor(F.col("m") / 2)
        first = F.when((F.col("m") > 1) & ~left, F.col("first") + half).otherwise(F.col("first"))
        m = F.when(F.col("m") > 1, F.when(left, half).otherwise(F.col("m") - half)).otherwise(F.col("m"))
        old, placed = placed, scratch.keep(moved.select("doc_id", "size", "text_crc32", "part", "c", first.alias("first"), m.alias("m")), "placed")
        scratch.drop(old)
    return placed.select("doc_id", "size", "text_crc32", "part", F.col("first").cast("int").alias("shard"))


def with_slots(sharded: DataFrame, rows_a_block: int = 20_000) -> DataFrame:
    """Number the rows of each shard from 0 without a gap. `sharded` is read three times: a written table, as `kd_shards` gives it.

    Rows are numbered within blocks of a shard, by hash and of bounded size, and a block starts where the ones
    before it end; the running sums are over blocks, not rows. `part` deals repeated rows to many blocks, rows with a null id
    too. An empty table stays empty.
    """
    blocks = max(1, -(-sharded.count() // rows_a_block))
    rows = sharded.withColumn("block", F.pmod(F.xxhash64("part", "doc_id"), F.lit(blocks)))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    starts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")) - 1
    joined = rows.withColumn("__place", place).join(starts.select("shard", "block", F.coalesce("before", F.lit(0)).alias("before")), ["shard", "block"])
    return joined.withColumn("slot", (F.col("before") + F.col("__place")).cast("bigint")).drop("before", "__place", "block", "part")
