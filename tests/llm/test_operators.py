import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.llm import chat, decontam, line_dedup, ngram_join, packing, quality, queries, sharding, telephony, text, tokens, toxicity
from assayer.llm.components import components
from assayer.llm.storage import Scratch
from assayer.llm.wordbpe import WordBpe
from tests.llm import brute

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
#: Names that operators use themselves.
CLASH = "string id, string n, string key, string bits, string score, string label, string pos, string h, string root, string size, string shard, string part"
ODD = [
    "", "  \n\t", "Hello World's it'RE we've <|endoftext|>x <|ENDOFTEXT|> a<|startoftext|>", "ΑΣ ΟΔΟΣ ΣΑΣ", "İstanbul ǅ ﬁ", "éa ́ x\x1cy a\x85b　c", "日本語のテスト 12３４²Ⅳ", "!!'s ''s 's",
    "​ zero ﻿", "𝒳𝓎 👩‍👩‍👧 ñ", "ſs K Å", "a" * 300, "<|" * 10, "x\x00y", "_a_b__", "É×è 'tis don't I'LL'd 's'", "12'34's a'", "e\u0301a\u0300\u0323 b\u0327\u0301c q\u0301", "\u1112\u1161\u11ab\u1100\u1173\u11af x", "\u212b\u2126 A\u030a<|endoftext|>o\u0308 '\u0301s", "=" * 90 + " internationalization's!!!", "Straße ÀÉ÷ß",
]


@lru_cache
def bpe():
    return WordBpe(PATH)


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def edge(spark):
    """Null id, null and empty texts, a repeated row, a very long text, and columns with clashing names."""
    rows = [(1, "a b c d e f g"), (2, None), (3, ""), (4, "word " * 60_000), (1, "a b c d e f g"), (None, "no id here at all ok"), (5, "short")]
    names = [c.split()[1] for c in CLASH.split(", ")]
    return frame(spark, [(*r, "en", None, 7, *[n for n in names]) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names))


def labels(spark, n=400):
    return frame(spark, [(k, int(k % 2 == 0), int(k % 7 == 0)) for k in range(n)], "doc_id bigint, quality int, toxic int")


def scratch(spark):
    return Scratch(spark, "test")


# Tokens


def test_ids_and_prefix_counts_are_the_librarys():
    column = pa.array(ODD)
    want = bpe().library.encode_batch(ODD, add_special_tokens=False)
    for t, w, ids, deltas in zip(ODD, want, bpe().encode(column), bpe().prefix_deltas(column), strict=True):
        assert ids.tolist() == w.ids, t
        assert len(deltas) == len(t.encode())
        counts = np.cumsum(deltas)
        for k in range(1, len(t) + 1):
            assert counts[len(t[:k].encode()) - 1] == len(bpe().library.encode(t[:k], add_special_tokens=False).ids), (t, k)


def test_random_texts_give_the_librarys_ids():
    random.seed(5)
    pool = [*"abcdefghijklmnopqrstuvwxyzABC      ''''0123.,!?#éÉüßñ", "'s", "'re", " the ", "tion", "\n", "→", "<|"]
    texts = ["".join(random.choices(pool, k=random.randrange(60))) for _ in range(1500)]
    own = [i.tolist() for i in bpe().encode(pa.array(texts))]
    assert own == [e.ids for e in bpe().library.encode_batch(texts, add_special_tokens=False)]
    sums = [int(d.sum(dtype=np.int64)) for d in bpe().prefix_deltas(pa.array(texts))]
    assert sums == [len(i) for i in own]


def test_forgotten_pieces_are_learnt_again():
    small = WordBpe(PATH, remember=50)
    texts = [" ".join(f"word{chr(97 + k % 26)}{chr(97 + j)}" for j in range(26)) for k in range(60)]
    assert [i.tolist() for i in small.encode(pa.array(texts))] == [e.ids for e in small.library.encode_batch(texts, add_special_tokens=False)]


def test_token_table(spark):
    table = tokens.token_table(edge(spark), PATH)
    found = {r["doc_id"]: r for r in table.select("*", tokens.bytes_in_budget(F.col("prefix_table"), 3).alias("cut"), tokens.tokens_of_prefix(F.col("prefix_table"), F.lit(3)).alias("at3")).collect()}
    assert table.count() == 7
    assert (found[2]["n_bytes"], found[2]["n_tokens"], found[2]["cut"], found[2]["at3"]) == (0, 0, 0, 0)
    assert (found[1]["n_tokens"], found[1]["cut"], found[1]["at3"]) == (7, 6, 2)
    assert found[4]["n_tokens"] == 60_000
    assert tokens.token_table(edge(spark).limit(0), PATH).count() == 0


# Packing


def test_pieces_cover_each_document_in_powers_of_two(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.binary_pieces(docs, PATH, 256).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i: [*bpe().library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = np.frombuffer(r["tokens"], "<u4").tolist()
        assert r["start"] == len(got.setdefault(r["doc_id"], [])) and len(ids) == r["length"] == 1 << r["bucket"] <= 256
        assert r["ids_crc32"] == zlib.crc32(r["tokens"]) and r["offset"] == 0 and r["doc_tokens"] == len(want[r["doc_id"]])
        got[r["doc_id"]] += ids
    assert got == want and len({r["sequence_id"] for r in rows}) == len(rows)
    # Sequences of one bucket follow each other in number, and lie together once they are written.
    by_id = sorted(rows, key=lambda r: r["sequence_id"])
    assert [r["bucket"] for r in by_id] == sorted(r["bucket"] for r in rows)


def test_buckets_lie_together(spark):
    pieces = packing.binary_pieces(spark.read.parquet(f"{SF}/documents.parquet"), PATH, 256)
    kept = scratch(spark).keep(packing.bucketed(pieces), "buckets")
    assert sorted(kept.drop("tokens").collect()) == sorted(pieces.drop("tokens").collect())
    within = [[r["bucket"] for r in rows] for rows in kept.select("bucket").rdd.glom().collect()]
    assert within and all(rows == sorted(rows) for rows in within)
    assert {len(r["tokens"]) for r in kept.where("bucket = 5").collect()} == {128}


def test_packing_edges(spark):
    rows = packing.binary_pieces(edge(spark), PATH).collect()
    assert [(r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] == 2] == [(1, 1)]
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 16  # two rows, each with pieces of its own
    assert packing.binary_pieces(edge(spark).limit(0), PATH).count() == 0
    assert packing.binary_lengths(0, 8) == [] and packing.binary_lengths(21, 8) == [8, 8, 4, 1]


# Lines


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_lines_as_brute_force(spark, parts):
    random.seed(parts)
    common = [f"This line number {k} is common and long enough to count" for k in range(6)]
    docs = []
    for i in range(120):
        lines = [random.choice([*common, common[0], "short", "", "  " + common[1].upper() + "\t", f"own line of document {i % 40} which is long enough too"]) for _ in range(random.randrange(12))]
        docs.append((i, "\n".join(lines) if lines else None))
    docs += [(200 + k, common[0]) for k in range(300)]  # a hot line
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = frame(spark, docs)
        bitmaps = line_dedup.keep_bitmaps(df, scratch(spark))
        kept = {r["doc_id"]: r["text"] for r in line_dedup.apply_bitmaps(df, bitmaps).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute.kept_lines(docs)
    assert {i: hashlib.sha256((kept[i] or "").encode()).hexdigest() for i, _ in docs} == {i: w[2] for i, w in want.items()}
    assert {r["doc_id"]: r["n_dropped"] for r in bitmaps.collect()} == {i: w[1] for i, w in want.items() if w[1]}


def test_line_edges(spark):
    docs = edge(spark)
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, scratch(spark)))
    assert out.columns == docs.columns and out.count() == 7 and out.where("text is null").count() == 1
    assert line_dedup.keep_bitmaps(docs.limit(0), scratch(spark)).count() == 0


# Near copies


def near_copies():
    random.seed(9)
    words = [f"w{k}" for k in range(3000)]
    docs, base = [], [[random.choice(words) for _ in range(random.randrange(3, 90))] for _ in range(40)]
    shared = [random.choice(words) for _ in range(30)]
    for i in range(260):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 1, 2, 4])):
            w[random.randrange(len(w))] = random.choice(words)
        if random.random() < 0.2:
            w += shared
        docs.append((i * 3, " ".join(w).capitalize()))
    hot = [random.choice(words) for _ in range(60)]
    for i in range(120):  # near copies of one text, each different
        w = list(hot)
        for _ in range(random.choice([1, 1, 2])):
            w[random.randrange(60)] = random.choice(words)
        docs.append((2000 + i, "  ".join(w)))
    return [*docs, (5000, None), (5001, ""), (5002, " \t"), (5003, "one two"), (5004, "ONE  two"), (5005, "one two three")]


@pytest.mark.parametrize("rounds", [0, 2])
def test_components_as_brute_force(spark, rounds):
    docs = near_copies()
    rows = ngram_join.jaccard_components(frame(spark, docs).repartition(5), scratch(spark), rounds=rounds).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute.components(docs)


def test_ngram_join_edges(spark):
    rows = ngram_join.jaccard_components(edge(spark), scratch(spark)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in rows) == [(0, 2, 0), (1, 3, 1), (1, 3, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5)]
    assert ngram_join.jaccard_components(edge(spark).limit(0), scratch(spark)).count() == 0


def test_component_chains(spark):
    random.seed(3)
    order = random.sample(range(1, 500), 300)
    links = [*zip(order, order[1:], strict=False), (900, 901), (901, 900), (7000, 7000)]
    found = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint"), scratch(spark)).collect()}
    assert found == {i: min(order) for i in order if i != min(order)} | {901: 900}


# Shingles and sets


def test_shingles_part_rows():
    column = pa.array(["a b c d e f", None, "A b c  d E", "a b", "b a", "", "a b"])
    (value, bounds), = list(ngram_join.sets(column, 5))
    got = [set(value[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert [len(g) for g in got] == [2, 0, 1, 1, 1, 0, 1]
    assert got[2] <= got[0] and got[3] == got[6] != got[4]
    big = pa.array(["x y z " * 400_000, "q"])
    assert [b - a for _, _, _, bounds in text.tokens(big, text.BY_SPACE) for a, b in zip(bounds, bounds[1:], strict=False)] == [1_200_000, 1]


# Classifiers


def labelled(spark):
    random.seed(2)
    plain = [f"w{k}" for k in range(300)]
    docs = []
    for k in range(400):
        w = random.choices(plain, k=30)
        if k % 2:
            w = [x + "###" for x in w[:15]] + ["|"] * 8
        if k % 7 == 0:
            w += ["idiot", "people"]
        random.shuffle(w)
        docs.append((k, " ".join(w)))
    return frame(spark, docs)


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_learn_and_hold_out(spark, module, label):
    docs, marks = labelled(spark), labels(spark)
    rows = module.score(docs, module.fit(docs, marks)).join(marks, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r["predicted"] == r[label] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_edges(spark, module):
    docs = edge(spark)
    none = module.fit(docs.limit(0), labels(spark).limit(0))
    rows = module.score(docs, none).collect()
    assert len(rows) == 7 and all(abs(r["score"] - 0.5) < 1e-9 for r in rows)
    assert module.score(docs.limit(0), none).count() == 0
    odd = frame(spark, [(1, None, None), (None, 1, 1), (1, 1, 1), (1, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert module.score(docs, module.fit(docs, odd)).count() == 7


def ftrl_by_coordinate(rows, label, order, model):
    """The updates one weight at a time, in plain Python."""
    z, n, z0, n0, bias = {}, {}, 0.0, 0.0, 0.0

    def weight(i):
        s = z.get(i, 0.0)
        return 0.0 if abs(s) <= model.l1 else ((1 if s > 0 else -1) * model.l1 - s) / ((model.beta + n.get(i, 0.0) ** 0.5) / model.rate + model.l2)

    for r in order:
        w = {i: weight(i) for i, _ in rows[r]}
        error = 1 / (1 + np.exp(-(sum(w[i] * x for i, x in rows[r]) + bias))) - label[r]
        for i, x in rows[r]:
            g, before = error * x, n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / model.rate * w[i]
            n[i] = before + g * g
        z0 += error - ((n0 + error**2) ** 0.5 - n0**0.5) / model.rate * bias
        n0 += error**2
        bias = -z0 * model.rate / (model.beta + n0**0.5)
    return {i: weight(i) for i in z}, bias


def test_ftrl_as_by_coordinate():
    random.seed(21)
    rows = [[(i, random.uniform(0.1, 2)) for i in sorted(random.sample(range(64), 9))] for _ in range(120)]
    label = np.array([float(r[0][0] < 6) for r in rows])
    index, value = (np.array([x[k] for r in rows for x in r]) for k in (0, 1))
    bounds = np.arange(0, 9 * len(rows) + 1, 9)
    model = quality.Ftrl(6)
    w, bias = model.fit(index, value, bounds, label)
    orders = np.random.Generator(np.random.PCG64(7))
    want, want_bias = ftrl_by_coordinate(rows, label, [r for _ in range(3) for r in orders.permutation(len(rows))], model)
    assert np.allclose([want.get(i, 0.0) for i in range(64)], w) and abs(bias - want_bias) < 1e-9 and (w != 0).any()
    scored = quality.QualityModel(w, bias).score(index, np.ones(len(index), int), bounds)
    x = 5 * np.sqrt(1 / 9)
    assert np.allclose(scored, [1 / (1 + np.exp(-(sum(want.get(i, 0.0) * x for i, _ in r) + bias))) for r in rows])


def test_machine_as_sum_over_pairs():
    rng = np.random.default_rng(22)
    w, v = rng.normal(size=30), rng.normal(size=(30, 4))
    rows = [np.sort(rng.permutation(30)[: rng.integers(0, 12)]) for _ in range(40)]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    model = toxicity.ToxicityModel(np.arange(30), w, v, 0.25)
    want = [0.25 + sum(w[i] for i in r) + sum(float(v[i] @ v[j]) for k, i in enumerate(r) for j in r[k + 1 :]) for r in rows]
    assert np.allclose(model.logits(np.concatenate(rows), bounds), want)


def test_pairs_of_terms_count():
    """A label that only two terms together carry: linear weights can't tell it, the machine can."""
    random.seed(4)
    rows = [(a, b) for a in (0, 1) for b in (0, 1) for _ in range(150)]
    index = np.concatenate([np.array([1] * a + [2] * (1 - a) + [3] * b + [4] * (1 - b), np.int32) for a, b in rows])
    bounds = np.arange(0, 2 * len(rows) + 1, 2)
    label = np.array([float(a == b) for a, b in rows])
    model = toxicity.fit_machine(index, bounds, label, 4, rounds=60, least_rows=1, least_chi=0)
    # Terms alone say nothing here, so none is chosen by them.
    chosen = toxicity.choose_terms(index, bounds, label, 4, 1, 10)
    assert len(chosen) == 4
    assert ((model.logits(index, bounds) > 0) == (label == 1)).mean() > 0.95


def test_pairs_of_usual_terms_with_production_defaults():
    """8,000 rows, 11 % toxic; two words in 400 rows each, usual in clean ones, and their 20 joint rows all toxic."""
    random = np.random.default_rng(0)
    code = random.permutation(1 << 20)[:3003]
    one, other, strong = code[-3:]
    place, marked = random.permutation(8000), random.random(8000) < 0.107
    has_one, has_other = np.isin(np.arange(8000), place[:400]), np.isin(np.arange(8000), place[380:780])

    def row(*more):
        return np.array(sorted({*code[(3000 * random.random(30) ** 3).astype(int)].tolist(), *more}), np.int32)

    def flat(rows):
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))

    rows = [row(*[one] * int(has_one[k]), *[other] * int(has_other[k]), *[strong] * int(marked[k])) for k in range(8000)]
    model = toxicity.fit_machine(*flat(rows), (marked | has_one & has_other).astype(float), 20)

    def logits(*more):
        index, bounds = flat([row(*more) for _ in range(300)])
        keep = model.wanted()[index]
        return model.logits(index[keep], np.concatenate(([0], np.cumsum(keep)))[bounds])

    assert model.slot[one] >= 0 and model.slot[other] >= 0
    both = logits(one, other)
    assert (both > 0).mean() > 0.5 and all((logits(*alone) > 0).mean() < 0.05 for alone in ((one,), (other,), ()))


# Chat


def test_preferences(spark):
    turn = lambda r, t: {"turn": 0, "role": r, "text": t}
    pairs = spark.createDataFrame(
        [(1, [turn("user", "q"), turn("assistant", "a"), turn("user", "z")], [turn("user", "q"), turn("assistant", "bb")]), (2, [turn("user", "q")], None), (3, [turn("user", "é")], [turn("user", "é")])],
        "k int, chosen array<struct<turn:bigint,role:string,text:string>>, rejected array<struct<turn:bigint,role:string,text:string>>",
    )
    rows = {r["k"]: r for r in chat.preferences(pairs, ("k",)).collect()}
    assert rows[1]["prompt"] == "<|user|>\nq<|end|>\n" and rows[1]["n_prompt_turns"] == 1
    assert rows[1]["chosen"] == "<|assistant|>\na<|end|>\n<|user|>\nz<|end|>\n" and rows[1]["rejected"] == "<|assistant|>\nbb<|end|>\n"
    (span,) = rows[1]["chosen_spans"]
    assert rows[1]["chosen"][span["start"] : span["end"]] == "a<|end|>\n"
    assert (rows[2]["prompt"], rows[2]["rejected"], rows[2]["rejected_spans"]) == ("", "", [])
    assert (rows[3]["n_prompt_turns"], rows[3]["chosen"]) == (1, "")


def test_turn_edges(spark):
    rows = [(0, 1, "assistant", "b", "x"), (0, 0, None, None, "y"), (0, 1, "assistant", "b", "x"), (None, 0, "user", "a", "z"), (1, None, "user", "a", "z"), (5, 0, "user", "u", "")]
    made = chat.paired_by_number(frame(spark, rows, "conv_id bigint, turn int, role string, text string, turns string"))
    found = {r["pair_id"]: r for r in chat.preferences(made, ("pair_id",)).collect()}
    assert set(found) == {0, 2} and found[0]["chosen"] == "<|user|>\n<|end|>\n<|assistant|>\nb<|end|>\n" and found[2]["chosen"] == ""
    assert chat.paired_by_number(frame(spark, [], "conv_id bigint, turn int, role string, text string")).count() == 0
    assert chat.preferences(made.limit(0), ("pair_id",)).count() == 0


def test_large_and_negative_conversation_ids(spark):
    base = 1 << 60
    rows = [(i, 0, "user", f"t{i}") for i in (base, base + 1, base + 2, base + 3, -1, -2, (1 << 53) + 1)] + [(base, 1, "assistant", "long " * 200_000)]
    found = {r["pair_id"]: r for r in chat.preferences(chat.paired_by_number(frame(spark, rows, "conv_id bigint, turn int, role string, text string")), ("pair_id",)).collect()}
    assert set(found) == {base // 2, base // 2 + 1, -1, 1 << 52}
    assert found[-1]["chosen"] == "<|user|>\nt-2<|end|>\n" and found[-1]["rejected"] == "<|user|>\nt-1<|end|>\n"
    assert found[base // 2]["rejected"] == f"<|user|>\nt{base + 1}<|end|>\n" and len(found[base // 2]["chosen"]) > 1_000_000
    assert found[1 << 52]["chosen"] == ""


# Shards


def test_shards_are_even_and_gapless(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.shards(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    size = [0] * 8
    slots = [[] for _ in range(8)]
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and max(size) - min(size) <= 3 * max(len(t.encode()) + 1 for t in texts.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_shard_edges(spark):
    s = scratch(spark)
    rows = sharding.with_slots(sharding.kd_shards(edge(spark), s, 3)).collect()
    assert len(rows) == 7 and {r["shard"] for r in rows} <= {0, 1, 2}
    assert sharding.with_slots(sharding.kd_shards(edge(spark).limit(0), s, 8)).count() == 0
    same = frame(spark, [(k, "equal", "en", "one") for k in range(800)], "doc_id bigint, text string, lang string, source string")
    counts = sorted(r["count"] for r in sharding.kd_shards(same, s, 8).groupBy("shard").count().collect())
    assert len(counts) == 8 and counts[-1] - counts[0] <= 8
    by_target = sharding.kd_shards(same, s, target_bytes=600).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(by_target) == 8 and max(r["b"] for r in by_target) <= 660
    repeated = frame(spark, [(1, "equal", "en", "one")] * 800, "doc_id bigint, text string, lang string, source string").repartition(3)
    rows = sharding.with_slots(sharding.kd_shards(repeated, s, 8), rows_a_block=50).collect()
    slots = [sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(8)]
    assert all(99 <= len(x) <= 101 and x == list(range(len(x))) for x in slots)


def shards_by_brute_force(rows, shards):
    """The tree in plain Python: variances and medians over all rows of a node."""

    def variance(rows, d):
        total = sum(r["size"] for r in rows)
        at = [(r["size"], (r["c"][d] >> sharding.BINS) / 2**sharding.BINS) for r in rows]
        return sum(w * x * x for w, x in at) / total - (sum(w * x for w, x in at) / total) ** 2

    whole = [max(variance(rows, d), 1e-12) for d in range(3)]
    out = {}

    def split(rows, first, m):
        if m == 1 or not rows:
            out.update({id(r): first for r in rows})
            return
        d = max(range(3), key=lambda d: (round(variance(rows, d) / whole[d], 9), -d))
        goal, run = sum(r["size"] for r in rows) * (m // 2) // m, 0
        for r in sorted(rows, key=lambda r: r["c"][d]):
            run += r["size"]
            if run > goal:
                break
        cut = r["c"][d]
        split([r for r in rows if r["c"][d] < cut], first, m // 2)
        split([r for r in rows if r["c"][d] >= cut], first + m // 2, m - m // 2)

    split(rows, 0, shards)
    return [(r["doc_id"], r["size"], r["text_crc32"], out[id(r)]) for r in rows]


@pytest.mark.parametrize("shards", [2, 5, 8])
def test_shards_as_brute_force(spark, monkeypatch, shards):
    slim = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name="t", *sizes, **options: (kept := keep(self, df, name, *sizes, **options), slim.extend(kept.collect()) if name == "slim" else None)[0])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.kd_shards(docs, scratch(spark), shards).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in rows) == sorted(shards_by_brute_force(slim, shards))


# Audio


def test_companding_tables():
    mu, a = telephony.TABLES[telephony.MU_LAW], telephony.TABLES[telephony.A_LAW]
    assert (mu[0x00], mu[0x80], mu[0xFF], mu[0x7F], mu[0xF0]) == (-32124, 32124, 0, 0, 120)
    assert (a[0x2A], a[0xAA], a[0xD5], a[0x55]) == (-32256, 32256, 8, -8)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def ima_by_sample(block: bytes) -> list[int]:
    value, index = int.from_bytes(block[:2], "little", signed=True), block[2]
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.IMA_STEPS[index])
            change = step // 8 + (step // 4) * (code & 1) + (step // 2) * (code >> 1 & 1) + step * (code >> 2 & 1)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(telephony.IMA_MOVES[code])))
            out.append(value)
    return out


def test_ima_blocks():
    random.seed(1)
    blocks = [random.randbytes(2) + bytes([random.randrange(89), 0]) + random.randbytes(60) for _ in range(9)]
    got = telephony.decode_ima(b"".join(blocks) + b"rest", 64)
    assert got.tolist() == [s for b in blocks for s in ima_by_sample(b)]
    samples, rate = telephony.decode(telephony.write_wav(telephony.IMA, 8000, b"".join(blocks), bits=4, block=64))
    assert rate == 8000 and samples[:, 0].tolist() == got.tolist()


def test_wav_round_trip_and_resampling():
    data = bytes(range(256)) * 3
    for kind in (telephony.MU_LAW, telephony.A_LAW):
        file = telephony.write_wav(kind, 8000, data)
        assert telephony.read_wav(file)[4] == data
        assert telephony.decode(file)[0][:, 0].tolist() == telephony.TABLES[kind][np.frombuffer(data, np.uint8)].tolist()
    x = np.array([0, 100, -100, 50], np.int16)
    assert telephony.resample(x, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -25, 50, 50]
    assert len(telephony.resample(x, 8000, 11025)) == 5 and telephony.resample(x[:0], 8000, 16000).tolist() == []
    with pytest.raises(ValueError):
        telephony.read_wav(b"RIFFxxxxWAVE")


def test_audio_query(spark):
    docs = edge(spark)
    rows = {r["doc_id"]: r for r in telephony.digests(telephony.store_as_telephony(docs)).collect()}
    for i, t in ((1, "a b c d e f g"), (2, None), (4, "word " * 60_000)):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-16:]))
        assert rows[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and rows[i]["media_bytes"] > len(payload)
    assert telephony.store_as_telephony(docs.limit(0)).count() == 0


def test_ima_short_blocks_and_channels():
    random.seed(3)
    head = lambda: random.randbytes(2) + bytes([random.randrange(89), 0])
    whole, short = head() + random.randbytes(60), head() + random.randbytes(21)
    want = ima_by_sample(whole) + ima_by_sample(short)
    assert telephony.decode_ima(whole + short, 64).tolist() == want
    assert telephony.decode_ima(short, 64).tolist() == ima_by_sample(short)
    assert telephony.decode_ima(head(), 64).shape == (1,)
    # Two channels: heads first, then four bytes of each in turn; the last turn of the short block is cut.
    blocks, left, right = b"", [], []
    for size, cut in ((32, 0), (12, 2)):
        a, b = (head() + random.randbytes(size) for _ in range(2))
        turns = b"".join(a[k : k + 4] + b[k : k + 4] for k in range(4, size + 4, 4))
        blocks += a[:4] + b[:4] + turns[: len(turns) - cut]
        left += ima_by_sample(a[: len(a) - cut])
        right += ima_by_sample(b[: len(b) - cut])
    samples, rate = telephony.decode(telephony.write_wav(telephony.IMA, 8000, blocks, channels=2, bits=4, block=72))
    assert rate == 8000 and samples[:, 0].tolist() == left and samples[:, 1].tolist() == right
    for wrong in ({"bits": 3, "block": 64}, {"bits": 4, "block": 4}):
        with pytest.raises(ValueError):
            telephony.decode(telephony.write_wav(telephony.IMA, 8000, whole, **wrong))
    with pytest.raises(ValueError):
        telephony.decode(telephony.write_wav(telephony.PCM, 8000, b"abcdef", bits=24))


def test_decode_audio(spark):
    random.seed(5)
    block = random.randbytes(2) + bytes([20, 0]) + random.randbytes(60)
    stereo = telephony.write_wav(telephony.PCM, 8000, np.arange(-6, 6, dtype="<i2").tobytes(), channels=2, bits=16)
    files = {
        1: telephony.write_wav(telephony.MU_LAW, 8000, bytes(range(256))), 2: telephony.write_wav(telephony.A_LAW, 11025, bytes(range(256))),
        3: telephony.write_wav(telephony.IMA, 8000, block + block[:20], bits=4, block=64), 4: stereo, 5: b"no file", 6: None,
    }
    rows = {r["doc_id"]: r for r in telephony.decode_audio(frame(spark, [*files.items(), (None, stereo)], "doc_id bigint, media binary")).collect()}
    assert len(rows) == 7 and rows[None]["pcm"] == rows[4]["pcm"]
    for k in (1, 2, 3, 4):
        samples, rate = telephony.decode(files[k])
        pcm = np.frombuffer(rows[k]["pcm"], "<i2").reshape(-1, samples.shape[1])
        assert rows[k]["rate"] == rate and rows[k]["channels"] == samples.shape[1] and rows[k]["n_frames"] == len(pcm) and rows[k]["error"] is None
        assert all(pcm[:, c].tolist() == telephony.resample(samples[:, c], rate, 16000).tolist() for c in range(samples.shape[1]))
    assert rows[3]["n_frames"] == 2 * (121 + 33)
    assert rows[5]["pcm"] is None and rows[5]["error"] == "not a WAV file"
    assert rows[6]["pcm"] is None and rows[6]["error"] is None


def test_query_stores_pcm(spark, monkeypatch):
    kept = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name="t", *sizes, **options: kept.append(keep(self, df, name, *sizes, **options)) or kept[-1])
    rows = queries.audio(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(rows) == sorted(telephony.digests(telephony.store_as_telephony(docs)).collect())
    (stored,) = kept
    assert stored.count() == len(rows)
    for r in stored.collect():
        samples, rate = telephony.decode(bytes(r["media"]))
        assert telephony.unlift(bytes(r["pcm"])).tolist() == telephony.resample(samples[:, 0], rate, r["pcm_rate"]).tolist()


def test_lifted_samples_come_back():
    random.seed(11)
    for n in (0, 1, 2, 3, 7, 500):
        x = np.array([random.choice([-32768, 32767, random.randrange(-32768, 32768)]) for _ in range(n)], np.int16)
        assert telephony.unlift(telephony.lift(x)).tolist() == x.tolist()
    wide = telephony.resample(np.array([5, -700, 32767, -32768, 3], np.int16), 8000, 16000)
    assert len(wide) == 10 and len(telephony.lift(wide)) == 4 + 2 * 5  # what lies between needs no room


@pytest.mark.parametrize("law", [telephony.MU_LAW, telephony.A_LAW])
def test_either_law_through_spark(spark, law):
    """By hand: each code's sample from the table of its law, and the mean of neighbours between them."""
    texts = [(1, "abc"), (2, None), (3, "é" * 500)]
    for r in telephony.store_as_telephony(frame(spark, texts), law=law).collect():
        raw = (dict(texts)[r["doc_id"]] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        own = [int(telephony.TABLES[law][b]) for b in payload]
        want = [v for a, b in zip(own, [*own[1:], own[-1]], strict=True) for v in (a, (a + b) >> 1)]
        assert telephony.unlift(bytes(r["pcm"])).tolist() == want and telephony.read_wav(bytes(r["media"]))[4] == payload


# Benchmark items


def leaky(seed=8, docs=150):
    """Items in documents: whole, with changed or added words, halves and sentences in another order, cut at either end."""
    random.seed(seed)
    words = [f"v{k}x" for k in range(400)]
    items = [(k, " ".join(random.choices(words, k=random.randrange(6, 60)))) for k in range(25)] + [(90, "too short"), (91, None), (92, "rep " * 30), (93, " ".join(words[:70]))]
    rows = [(200 + docs, "rep " * 40), (201 + docs, None), (202 + docs, "")]
    for k in range(docs):
        w = random.choices(words, k=random.randrange(0, 80))
        item = random.choice([*items[:25], items[28]])[1].split()
        if k % 6 == 0:
            for _ in range(k % 5):
                item[random.randrange(len(item))] = "changed"
        elif k % 6 == 1:
            item = item[len(item) // 2 :] + item[: len(item) // 2]
        elif k % 6 == 2:
            third = len(item) // 3
            item = item[third : 2 * third] + item[:third] + item[2 * third :]
        elif k % 6 == 3:
            for _ in range(k % 4):
                item.insert(random.randrange(len(item)), "more")
        elif k % 6 == 4:
            w = []
            item = (item[k % 5 :] + random.choices(words, k=40)) if k % 4 else random.choices(words, k=40) + item[: len(item) - k % 5]
        else:
            item = []
        w[len(w) // 2 : len(w) // 2] = [x.upper() + random.choice(["", ",", "!!"]) for x in item]
        rows.append((k, " ".join(w)))
    return rows, items


def test_leaks_as_brute_force(spark):
    docs, items = leaky()
    rows = decontam.contaminated(frame(spark, [*docs, docs[-1]]).repartition(3), frame(spark, items, "item_id bigint, text string"), scratch(spark)).collect()
    want = brute.leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in rows} == {k: round(v, 9) for k, v in want.items()}
    assert sum(0.8 <= v < 0.9 for v in want.values()) >= 10


def test_swapped_halves_are_found(spark):
    w = [f"h{k}" for k in range(60)]
    other = [f"o{k}" for k in range(200)]
    text_ = " ".join(other[:100] + w[30:] + w[:30] + other[100:])
    (row,) = decontam.contaminated(frame(spark, [(1, text_)]), frame(spark, [(7, " ".join(w))], "item_id bigint, text string"), scratch(spark)).collect()
    assert (row["start"], row["n_words"]) == (100, 60) and abs(row["similarity"] - 52 / 60) < 1e-9


def test_one_id_with_two_texts(spark):
    item = " ".join(f"t{k}" for k in range(30))
    docs = [(1, "nothing of it here at all, only other words"), (1, f"before {item} after"), (2, "clean " * 20)]
    rows = decontam.contaminated(frame(spark, docs), frame(spark, [(5, item), (5, "another text of the same id entirely")], "item_id bigint, text string"), scratch(spark)).collect()
    assert [(r["doc_id"], r["item_id"], r["start"], r["similarity"]) for r in rows] == [(1, 5, 1, 1.0)]


def test_radius_leaves_out_no_similar_window():
    """Fingerprints of random shingles: pairs just at the threshold, 4,000 for each size. The radius of 19 of earlier days lost some."""
    rng = np.random.default_rng(20)
    far, lost = 0, 0
    for m in (9, 18, 27, 36, 45, 56, 90):
        common = -(-8 * m // 9)
        votes = lambda h: ((h[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=1) * 2 > h.shape[1]
        a = rng.integers(0, 2**64, (4000, m), dtype=np.uint64)
        b = np.concatenate((a[:, :common], rng.integers(0, 2**64, (4000, m - common), dtype=np.uint64)), axis=1)
        distance = (votes(a) != votes(b)).sum(axis=1)
        far, lost = max(far, int(distance.max())), lost + int((distance > 19).sum())
    assert far <= decontam.RADIUS and lost > 0


def test_blocks_find_all_within_radius(spark):
    random.seed(6)
    fps = [random.getrandbits(64) for _ in range(40)]
    pairs = [(a, a ^ sum(1 << k for k in random.sample(range(64), random.randrange(20)))) for a in fps]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a bigint, b bigint")
    assert df.where(F.arrays_overlap(decontam.blocks(F.col("a"), 19), decontam.blocks(F.col("b"), 19))).count() == 40


def test_leak_edges(spark):
    item = frame(spark, [(1, "a b c d e f g"), (None, "a b c d e f g")], "item_id bigint, text string")
    rows = decontam.contaminated(edge(spark), item, scratch(spark)).collect()
    assert [(r["doc_id"], r["item_id"], r["start"], r["similarity"]) for r in rows] == [(1, 1, 0, 1.0)]
    assert decontam.contaminated(edge(spark).limit(0), item, scratch(spark)).count() == 0
    assert decontam.contaminated(edge(spark), item.limit(0), scratch(spark)).count() == 0
