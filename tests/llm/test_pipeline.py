import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from assayer.llm import quality
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage kept, in order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).cache())
    return kept


def test_stages_keep_columns_and_take_effect(spark, stages):
    docs, good, cut, single, clean, packed = stages
    columns = docs.columns
    assert all(d.columns == columns and d.dtypes == docs.dtypes for d in (good, cut, single, clean))
    scored = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where("predicted = 1")
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in scored.collect()}
    lines = brute.kept_lines([(r["doc_id"], r["text"]) for r in good.collect()])
    assert {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in cut.collect()} == {i: sha for i, (_, _, sha) in lines.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["text"] is not None)
    classes = brute.components([(r["doc_id"], r["text"]) for r in cut.collect()])
    assert {r["doc_id"] for r in single.collect()} == {i for i, (_, c) in classes.items() if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, _ in brute.leaks([(r["doc_id"], r["text"]) for r in single.collect()], items)}
    assert leaked
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - leaked
    library, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for r in sorted(packed.collect(), key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(got.setdefault(r["doc_id"], [])) and r["length"] & (r["length"] - 1) == 0
        got[r["doc_id"]] += np.frombuffer(r["tokens"], "<u4").tolist()
    assert got == {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in clean.collect()}


def test_run_is_the_stages_in_turn(spark, stages):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(corpus_pipeline.run(spark, SF).select(*columns).collect()) == sorted(stages[-1].select(*columns).collect())


def test_stages_on_an_empty_table(spark, stages):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, stages[0].limit(0), SF).count() == 0


def test_repeated_and_null_id_rows(spark):
    """Each row counts by its own text: repeats go, copies and leaks without an id go, clean texts that share an id stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((r["text"] or "").split()) >= 8)
    a, b, c = (" ".join(f"{w}{k}" for k in range(40)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (3, c), (3, item), (None, item), (4, ""), (4, ""), (5, None)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema).repartition(3)
    # By hand: what each stage leaves.
    single = sorted([(1, a), (None, b), (3, c), (3, item), (4, ""), (5, None)], key=str)
    found = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_near_copies(spark, table, SF).collect()]
    assert sorted(found, key=str) == single
    clean = sorted([r for r in rows if r[1] != item], key=str)
    assert sorted([(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_leaks(spark, table, SF).collect()], key=str) == clean


def test_pieces_hold_their_ids(stages):
    rows = stages[-1].collect()
    assert rows and all(len(r["tokens"]) == 4 * r["length"] and zlib.crc32(r["tokens"]) == r["ids_crc32"] for r in rows)


def test_every_operator_has_a_query():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
