"""One query for each operator, over its whole table, with the digest columns that the contract names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import chat, decontam, line_dedup, ngram_join, packing, quality, sharding, telephony, tokens, toxicity
from assayer.llm.ship import frugal, ship
from assayer.llm.storage import Scratch

LIMIT = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = tokens.token_table(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return table.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), Scratch(spark, "ngram-join"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.bucketed(packing.binary_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), LIMIT))
    return Scratch(spark, "packing").keep(pieces, "buckets").drop("tokens")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = line_dedup.keep_bitmaps(docs, Scratch(spark, "line-dedup"))

    @frugal
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for text, bitmap in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n.append((text or "").count("\n") + 1)
                sha.append(hashlib.sha256("\n".join(line_dedup.keep_lines(text or "", bitmap)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    joined = line_dedup.with_bitmaps(docs, bitmaps).select("doc_id", "text", F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"), "keep_bitmap")
    return joined.mapInArrow(digest, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.preferences(chat.paired_by_number(_table(spark, sf_dir, "conversations")), ("pair_id",))
    trained = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return made.select(
        "pair_id",
        F.col("n_prompt_turns").cast("bigint").alias("n_prompt_turns"),
        F.md5("prompt").alias("prompt_md5"),
        F.md5("chosen").alias("chosen_md5"),
        F.md5("rejected").alias("rejected_md5"),
        trained("chosen_spans").alias("chosen_trained"),
        trained("rejected_spans").alias("rejected_trained"),
    )


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "shards")
    placed = sharding.with_slots(sharding.kd_shards(_table(spark, sf_dir, "documents"), scratch, 8))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Files and samples are stored, and digests taken of what is read back; small row groups, as rows are large.
    made = telephony.store_as_telephony(_table(spark, sf_dir, "documents"))
    stored = Scratch(spark, "telephony").keep(made, "media", **{"parquet.block.size": 1 << 25, "parquet.compression.codec.zstd.level": 6})
    return telephony.digests(stored)


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), Scratch(spark, "decontamination"))
    return found.select("doc_id", "item_id", F.col("start").cast("bigint").alias("start"), F.col("n_words").cast("bigint").alias("n_words"), F.round("similarity", 9).alias("similarity"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_token_counts": token_counts,
    "op2_toxicity": toxic,
    "op3_ngram_join": similar,
    "op4_packing": packed,
    "op5_line_dedup": lines,
    "op6_quality": good,
    "op7_chat_preferences": preferences,
    "op8_sharding": shards,
    "op9_telephony": audio,
    "op10_decontamination": leaks,
}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op5_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, pos, line, common.k IS NOT NULL AND doc_id <> top AS gone FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op7_chat_preferences": """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn, (conv_id - (conv_id & 1)) // 2 AS pair_id, conv_id & 1 = 0 AS is_chosen FROM t
), size AS (SELECT pair_id, max(rn) FILTER (WHERE is_chosen) AS c, max(rn) FILTER (WHERE NOT is_chosen) AS r FROM n GROUP BY pair_id
), differ AS (SELECT a.pair_id, min(a.rn) AS rn FROM n a JOIN n b ON a.pair_id = b.pair_id AND a.rn = b.rn AND a.is_chosen AND NOT b.is_chosen WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id
), shared AS (SELECT pair_id, coalesce(differ.rn - 1, least(coalesce(c, 0), coalesce(r, 0))) AS k FROM size LEFT JOIN differ USING (pair_id)
), lines AS (SELECT pair_id, rn, rn <= k AS in_prompt, is_chosen, k, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line, CASE WHEN role = 'assistant' THEN length(text) + 8 ELSE 0 END AS trained FROM n JOIN shared USING (pair_id))
SELECT pair_id, CAST(max(k) AS BIGINT) AS n_prompt_turns,
  md5(coalesce(string_agg(line, '' ORDER BY rn) FILTER (WHERE in_prompt AND is_chosen), '')) AS prompt_md5,
  md5(coalesce(string_agg(line, '' ORDER BY rn) FILTER (WHERE NOT in_prompt AND is_chosen), '')) AS chosen_md5,
  md5(coalesce(string_agg(line, '' ORDER BY rn) FILTER (WHERE NOT in_prompt AND NOT is_chosen), '')) AS rejected_md5,
  CAST(coalesce(sum(trained) FILTER (WHERE NOT in_prompt AND is_chosen), 0) AS BIGINT) AS chosen_trained,
  CAST(coalesce(sum(trained) FILTER (WHERE NOT in_prompt AND NOT is_chosen), 0) AS BIGINT) AS rejected_trained
FROM lines GROUP BY pair_id""",
    "op3_ngram_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)""",
    # Every window of every document for every item, by counting what it shares with it.
    "op10_decontamination": """
WITH d AS (SELECT DISTINCT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL
), i AS (SELECT DISTINCT item_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL
), ds AS (SELECT id, len(w) - 4 AS n, k AS pos, array_to_string(w[k + 1:k + 5], ' ') AS g FROM d, unnest(range(0, greatest(len(w) - 4, 0))) AS r(k)
), s AS (SELECT id, len(w) - 4 AS m, array_to_string(w[k + 1:k + 5], ' ') AS g, count(*) AS c FROM i, unnest(range(0, greatest(len(w) - 4, 0))) AS r(k) GROUP BY ALL
), held AS (SELECT ds.id AS doc_id, s.id AS item_id, n, m, g, c, unnest(range(pos - m + 1, pos + 1)) AS start FROM ds JOIN s USING (g)
), counts AS (SELECT doc_id, item_id, n, m, start, g, least(c, count(*)) AS common FROM held GROUP BY doc_id, item_id, n, m, start, g, c
), sums AS (SELECT doc_id, item_id, m, start, sum(common) AS common, least(n, start + m) - greatest(0, start) AS size FROM counts GROUP BY doc_id, item_id, n, m, start
), best AS (SELECT *, common / (m + size - common) AS sim FROM sums WHERE common / (m + size - common) >= 0.8
), one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, start) AS place FROM best)
SELECT doc_id, item_id, CAST(greatest(0, start) AS BIGINT) AS start, CAST(m + 4 AS BIGINT) AS n_words, round(CAST(sim AS DOUBLE), 9) AS similarity FROM one WHERE place = 1""",
}
