"""Self-join of documents on the Jaccard similarity of their word n-grams, by rare-first prefixes and filters.

Two sets can only be similar if their prefixes, in an order common to all, share an n-gram. Rare n-grams stand first, so few
prefixes meet. Length and positional filters drop pairs where they meet, a suffix filter on counts by hash
range drops more, and each pair left is verified once on the exact sets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.llm.components import components
from assayer.llm.ship import frugal
from assayer.llm.storage import Scratch
from assayer.llm.text import BY_SPACE, distinct, shingles, tokens

SKETCH_BITS, BLOCKS = 20, 64
WORDS = 8  # of 64 bits: ranges of hashes, whose counts the suffix filter compares by their parity
_U = np.uint64


def sets(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For consecutive groups of rows: distinct hashed n-grams in ascending order, and each row's bounds."""
    for _, _, value, bounds in tokens(column, BY_SPACE):
        yield distinct(*shingles(value, bounds, width))


def odd_ranges(value: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each row `WORDS` numbers of 64 bits: the parity of its count of hashes in each range of the lowest bits."""
    ranges, out = 64 * WORDS, []
    for first in range(0, len(bounds) - 1, 512):
        ends = bounds[first : first + 513]
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        # The sketch's bits and the ranges' bits are different ones.
        counts = np.bincount(row * ranges + (value[ends[0] : ends[-1]] & _U(ranges - 1)).astype(np.int64), minlength=(len(ends) - 1) * ranges)
        out += list(np.packbits((counts & 1).astype(np.uint8).reshape(-1, ranges), axis=1).view(np.int64))
    return out


def summaries(docs: DataFrame, scratch: Scratch, width: int) -> tuple[DataFrame, np.ndarray]:
    """One pass: `id, n, digest, profile` of each document, and how frequent n-grams are, by buckets of their hashes.

    `digest` is a 128-bit hash of the set, `profile` holds a bit for each of 512 ranges of hashes: whether it has an odd number of them.
    The frequencies are sums over all documents in 2**20 buckets, given as levels on a logarithmic scale in one
    byte each: a table of a fixed size at any number of documents.
    """

    @frugal
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            n, digest, profile = [], [], []
            for value, bounds in sets(batch.column(1), width):
                counts += np.bincount((value >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                profile += odd_ranges(value, bounds)
                n.append(np.diff(bounds))
                digest += [hashlib.blake2b(value[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            none = np.zeros(0, np.int64)
            yield _summary(batch.column(0), np.concatenate([*n, none]), digest, profile, None, None)
        each = (1 << SKETCH_BITS) // BLOCKS
        yield _summary(pa.nulls(BLOCKS, pa.int64()), None, None, None, range(BLOCKS), [zlib.compress(counts[k * each : (k + 1) * each].astype("<i4").tobytes(), 1) for k in range(BLOCKS)])

    kept = scratch.keep(docs.mapInArrow(summarise, "id bigint, n bigint, digest binary, profile array<bigint>, block int, counts binary"), "summaries")

    def add(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        @frugal
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    total[block] = total.get(block, 0) + np.frombuffer(zlib.decompress(counts.as_buffer()), dtype=kind).astype(np.int64)
            packed = [zlib.compress(v.astype("<i8").tobytes(), 1) for v in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"])

        return run

    # The counts of a few hundred tasks are added up, by block; then these sums are.
    parts = kept.where("block is not null").select("block", "counts")
    groups = max(1, -(-parts.where("block = 0").count() // 256))
    some = parts.repartition(BLOCKS * groups, "block", F.pmod(F.xxhash64("counts"), F.lit(groups))).mapInArrow(add("<i4"), "block int, counts binary")
    frequency = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    each = (1 << SKETCH_BITS) // BLOCKS
    for r in some.repartition(BLOCKS, "block").mapInArrow(add("<i8"), "block int, counts binary").collect():
        frequency[r["block"] * each : (r["block"] + 1) * each] += np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64)
    level = np.minimum(255, np.round(8 * np.log2(1 + frequency))).astype(np.uint8)
    return kept.where("block is null").select("id", "n", "digest", "profile"), level


def _summary(ids, n, digest, profile, block, counts) -> pa.RecordBatch:
    size = len(ids)
    fill = lambda x, kind: pa.nulls(size, kind) if x is None else pa.array(list(x) if isinstance(x, range) else x, kind)
    return pa.RecordBatch.from_arrays(
        [ids, fill(n, pa.int64()), fill(digest, pa.binary()), fill(profile, pa.list_(pa.int64())), fill(block, pa.int32()), fill(counts, pa.binary())], ["id", "n", "digest", "profile", "block", "counts"]
    )


def prefixes(docs: DataFrame, level: np.ndarray, width: int, percent: int) -> DataFrame:
    """`id, n, prefix`: the n-grams, rarest first, of which a set that is similar must hold one."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            n, flat, ends = [], [], [np.zeros(1, np.int64)]
            for value, bounds in sets(batch.column(1), width):
                rank = levels[(value >> _U(64 - SKETCH_BITS)).astype(np.int64)]
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    size = b - a
                    have = size - -(-percent * size // 100) + 1 if size else 0
                    order = np.argsort(rank[a:b], kind="stable")[:have]  # equal ranks stay in the order of their hashes
                    flat.append(value[a:b][order].view(np.int64))
                    ends.append(ends[-1] + have)
                n.append(np.diff(bounds))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)) if len(ends) > 1 else pa.array([0], pa.int32()), pa.array(np.concatenate([*flat, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*n, np.zeros(0, np.int64)])), lists], ["id", "n", "prefix"])

    return docs.mapInArrow(cut, "id bigint, n bigint, prefix array<bigint>")


def least_overlap(n_a, n_b, percent: int):
    """The fewest common n-grams of two sets that are similar: o * 100 >= percent * (a + b - o)."""
    return F.ceil((n_a + n_b) * percent / F.lit(100 + percent) - F.lit(1e-9))


def may_link(x: str, y: str, percent: int):
    """Length and positional filters on an n-gram that two prefixes share, at positions `pos`."""
    n_x, n_y, p_x, p_y = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (x, y))
    return (F.least(n_x, n_y) * 100 >= F.greatest(n_x, n_y) * percent) & (F.least(n_x - p_x, n_y - p_y) >= least_overlap(n_x, n_y, percent))


def apart(x, y):
    """Two sets differ in as many n-grams, at least, as ranges of hashes of which one has an odd and the other an even number."""
    return sum((F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(WORDS)), F.lit(0))


def suffix_filter(n_x, n_y, difference, percent: int):
    return (n_x + n_y - difference) / 2 >= least_overlap(n_x, n_y, percent)


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact sets are similar. Texts of `b` are fetched first, so a text with many partners belongs in `a`:
    it is copied into rows that go straight to the check, and a skewed join on it can be split."""

    @frugal
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for (left, lb), (right, rb) in zip(_rows(batch.column(2), width), _rows(batch.column(3), width), strict=True):
                common = len(np.intersect1d(left, right, assume_unique=True))
                good.append(100 * common >= percent * (lb + rb - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(check, "a bigint, b bigint")


def _rows(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, int]]:
    for value, bounds in sets(column, width):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield value[a:b], b - a


def jaccard_components(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80, rounds: int = 2, tries: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n_shingles, component_id` for every row: the components of the links of at least `percent` % similarity.

    Documents of equal sets are one node, the smallest of their ids. Nodes whose prefixes share an n-gram are
    candidates. In a round every node is verified against `tries` at most of those that stand for its lists, and links join
    components; a list within one component needs no more pairs. Rounds go on while they find links, up to `rounds`. What is left is verified pair by pair across components, each pair once, so that no link between
    components is missed at any number of rounds. Sets of near copies thus cost a few pairs for each copy, not all pairs.

    Words are runs of bytes other than ASCII white space, with A-Z in lower case. Texts of fewer than `width` words are
    one shingle; null and empty texts have none and link with nothing. Rows with a null id get null components. Repeated rows
    count as equal sets; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    summary, level = summaries(texts, scratch, width)
    nodes = scratch.keep(summary.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("profile").alias("profile")), "nodes")
    # Prefixes of nodes only: copies of a set stand behind their node.
    own = scratch.keep(prefixes(texts.where("id is not null"), level, width, percent).join(nodes.select(F.col("node").alias("id")), "id", "left_semi"), "prefixes")
    # Counts by n-gram are summed where they are; the lists of two members or more then come by a join, which splits frequent n-grams.
    many = scratch.keep(own.select(F.explode("prefix").alias("gram")).groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"), "grams")
    postings = own.select("id", "n", F.posexplode("prefix").alias("pos", "gram"))
    lists = scratch.keep(postings.join(many, "gram", "left_semi").select("gram", "id", "n", "pos", F.col("id").alias("root")), "lists")
    scratch.drop(own, many)
    some = scratch.keep(texts.join(lists.select("id").distinct().hint("merge"), "id", "left_semi"), "texts")
    profiles = nodes.select("node", "profile")

    def profiled(pairs: DataFrame) -> DataFrame:
        sides = [profiles.withColumnsRenamed({"node": side, "profile": f"profile_{side}"}) for side in "ab"]
        return pairs.join(sides[1], "b").join(sides[0], "a").withColumn("apart", apart(F.col("profile_a"), F.col("profile_b"))).where(suffix_filter(F.col("n_a"), F.col("n_b"), F.col("apart"), percent))

    links = tried = spark.createDataFrame([], "a bigint, b bigint")
    spent = [some]
    roots = spark.createDataFrame([], "id bigint, root bigint")
    found, size = 0, lists.count()
    for k in range(rounds):
        # Any member may stand for its list, another one in each round: members of large components mostly, and so most nodes soon meet a partner.
        heads = lists.groupBy("gram").agg(F.min(F.struct(F.xxhash64("id", "gram", F.lit(k)).alias("by"), "id", "n", "pos", "root")).alias("y"))
        pairs = lists.join(heads.select("gram", "y"), "gram").select(F.struct("id", "n", "pos", "root").alias("x"), "y").where(F.col("x.root") != F.col("y.root")).where(may_link("x", "y", percent))
        pairs = pairs.select(F.col("y.id").alias("a"), F.col("x.id").alias("b"), F.col("y.n").alias("n_a"), F.col("x.n").alias("n_b")).distinct()
        # Of a node's candidates those that may differ least; texts are fetched for these only.
        place = F.row_number().over(Window.partitionBy("b").orderBy(F.col("apart") / (F.col("n_a") + F.col("n_b")), "a"))
        best = profiled(pairs.join(tried, ["a", "b"], "left_anti")).select("a", "b", place.alias("place")).where(F.col("place") <= tries)
        best = scratch.keep(best.select("a", "b"), "candidates", size)
        spent.append(best)
        # A pair may come up again the other way round.
        tried = tried.unionByName(best.select("a", "b")).unionByName(best.select(F.col("b").alias("a"), F.col("a").alias("b")))
        new = scratch.keep(verify(best, some, width, percent), "links")
        links = links.unionByName(new)
        spent.append(new)
        before, found = found, links.count()
        if found == before:
            break
        roots = components(links, scratch)
        old, lists = lists, scratch.keep(_across(lists, roots), "lists", size)
        scratch.drop(old)
        if not (size := lists.count()):
            break

    # All pairs that are left: in one list, in different components, and by their profiles near enough.
    shown = scratch.keep(lists.join(profiles, lists["id"] == profiles["node"]).drop("node"), "profiles")
    left, right = shown.alias("l"), shown.alias("r")
    near = suffix_filter(F.col("l.n"), F.col("r.n"), apart(F.col("l.profile"), F.col("r.profile")), percent)
    pairs = left.join(right, (F.col("l.gram") == F.col("r.gram")) & (F.col("l.id") < F.col("r.id")) & (F.col("l.root") != F.col("r.root")) & may_link("l", "r", percent) & near)
    pairs = pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    rest = scratch.keep(verify(pairs.join(tried, ["a", "b"], "left_anti"), some, width, percent), "links")
    if not rest.isEmpty():
        roots = components(links.unionByName(rest), scratch)

    scratch.drop(lists, shown, rest, *spent)
    placed = nodes.join(roots, nodes["node"] == roots["id"], "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    return summary.join(placed, "digest", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def _across(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists that hold more than one component, with each member's."""
    rooted = lists.drop("root").join(roots, "id", "left").select("gram", "id", "n", "pos", F.coalesce("root", "id").alias("root"))
    split = rooted.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("gram")
    return rooted.join(split, "gram", "left_semi")
