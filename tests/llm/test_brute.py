"""Whole operators, and the pipeline, against plain versions and libraries."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terraledger.llm import ann, langid, minhash, packing, sharding, substring, toxicity, wordpiece
from terraledger.llm.queries import vocabulary
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)).capitalize() + rng.choice([".", "!", "", "\n"])


@pytest.mark.parametrize(("least", "min_words"), [(2, 25), (2, 6), (3, 1)])
def test_every_repeated_run_goes(spark, least, min_words):
    rng = random.Random(least * 100 + min_words)
    pool = [sentence(rng, rng.randint(1, 14)) for _ in range(25)]
    texts = [" ".join(rng.choice(pool) if rng.random() < 0.6 else sentence(rng, rng.randint(1, 14)) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += [texts[3] + " " + texts[3], "", "   ", "É" + texts[5][1:]]
    want, lost = brute.stripped(texts, least, min_words)
    got = sorted(substring.removed(frame(spark, texts), least, min_words).collect(), key=lambda r: r["doc_id"])
    assert [r["text"] for r in got] == want
    assert [r["n_removed"] for r in got] == lost
    assert [r["n_sentences"] for r in got] == [len(brute.text_pieces(t)) for t in texts]


def test_a_value_that_all_share_links_nobody(spark):
    """Texts that begin with one line share postings, and the hot lists give no wrong link and lose none."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = " ".join(word() for _ in range(25))
    bodies = [[word() for _ in range(rng.randint(20, 60))] for _ in range(40)]
    texts = [line + " " + " ".join(word() if rng.random() < 0.01 else w for w in rng.choice(bodies)) for _ in range(150)]
    want = brute.components(texts)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def structured(n, seed=0):
    """Vectors near a surface of three dimensions in 64."""
    rng = np.random.default_rng(seed)
    z = rng.uniform(-1, 1, size=(n, 3))
    x = np.concatenate([np.sin(z @ rng.normal(size=(3, 32)) * 2), np.cos(z @ rng.normal(size=(3, 32)) * 2)], axis=1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_order_narrows_the_search(spark, monkeypatch):
    """On vectors with structure a fraction of the rows is searched, and it is the curve that finds the neighbours."""
    x = structured(12_000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4).cache()
    cls, _, dims = ann.classes(df, 20)
    asked = np.arange(0, len(x), 20)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]

    def recall(half):
        found = collections.defaultdict(set)
        for r in ann.search(df, half=half).collect():
            found[r["query_id"]].add(r["vec_id"])
        return np.mean([len(found[q] & set(b.tolist())) / 20 for q, b in zip(asked.tolist(), best, strict=True)])

    half = 2 * ann.BLOCK
    assert 6 * half < len(x) / 3  # what a home of one block row and its window read on a curve
    assert recall(half) >= 0.9
    monkeypatch.setattr(ann, "hilbert_index", lambda cells, bits: np.random.default_rng(1).integers(0, 1 << 40, len(cells)))
    assert recall(half) < 0.75


def test_measured_window_on_structure(spark):
    """The window that the probes give on 12000 vectors near a surface: narrow, and wide enough for every query."""
    x = structured(12_000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    cls, _, dims = ann.classes(df, 20)
    placed, _ = ann.ordered_positions(ann.curve_rows(cls, dims), run=["curve", "key"], tie=["g1", "g2"], carry=["curve", "g1", "g2"])
    half, reached = ann.window(cls, placed.withColumn("pos", F.col("pos") - F.col("curve") * cls.count()), dims, cls.count(), 20)
    assert half < len(x) / 10 and reached >= ann.RECALL
    found = {}
    for r in ann.search(df).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, len(x), ann.EVERY):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hits / (20 * len(found)) >= 0.9


def test_ties_between_different_vectors(spark):
    """Equal scores go to the smaller id, whichever block, curve or class the vectors lie in."""
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, *rng.integers(-9, 10, 3).astype(float).tolist()]) for i in range(1, 1300) if i % 20]
    rows += [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(20, 1300, 20)]
    rng.shuffle(rows)
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), half=len(rows)).collect():  # all of them are met
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert len(got) == 64
    for q, ranks in got.items():
        assert [ranks[k] for k in range(1, 21)] == [(i, 1.0) for i in range(1, 22) if i != q][:20]


def test_shards(spark):
    rng = random.Random(4)
    texts = [f"text {i} " + "x" * rng.randint(0, 400) for i in range(3000)] + ["copy " * 40] * 300 + ["hot " * 60] * 1500 + ["", None, None]
    rows = [(i, t, rng.choice(["en", "de", "fr", None]), f"src{rng.randint(0, 15)}") for i, t in enumerate(texts)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=16).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    size = collections.Counter()
    where = collections.defaultdict(set)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        size[r["shard"]] += r["size"]
        where[raw].add(r["shard"])
    share = sum(size.values()) / 16
    assert set(size) == set(range(16)) and max(abs(v - share) for v in size.values()) < 0.03 * share
    assert all(len(s) == 1 for t, s in where.items() if texts.count(t.decode()) * (len(t) + 1) <= share)
    assert len(where[("hot " * 60).encode()]) <= -(-1500 * 241 // share)
    for s in range(16):
        own = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        curve = [r["curve"] for r in own if texts.count(texts[r["doc_id"]]) == 1]
        assert curve == sorted(curve)
    of_lang = collections.defaultdict(set)
    for r in got:
        of_lang[rows[r["doc_id"]][2]].add(r["shard"])
    assert min(len(of_lang[k]) for k in ("en", "de", "fr")) < 16  # a language's files leave others unread


def test_packing_equals_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    ids = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, packing.END] for r in docs.collect()}
    got = packing.pack(docs, path).collect()
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert r["ids_crc32"] == zlib.crc32(own.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]]) and len(own) == r["length"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, tokens in ids.items():
        at = 0
        for start, n in sorted(pieces[d]):
            assert start == at
            at += n
        assert at == len(tokens)
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(windows) <= 1.05 * -(-sum(map(len, ids.values())) // 2048)


def test_word_pieces_of_the_real_vocabulary(spark):
    path = vocabulary("byte_bpe_50k.json")
    first, rest = wordpiece.pieces(path)

    def greedy(word):
        n, at, vocab = 0, 0, first
        while at < len(word):
            at = next(e for e in range(len(word), at, -1) if word[at:e] in vocab)
            n, vocab = n + 1, rest
        return n

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in wordpiece.count_tokens(docs, path).collect():
        w = wordpiece.WORDS.findall(texts[r["doc_id"]])
        assert (r["n_words"], r["n_tokens"]) == (len(w), sum(greedy(x.encode()) for x in w))


def test_words_of_every_script():
    assert langid.pieces("½ ² Ⅷ 12") == []
    assert langid.pieces("हिन्दी 日本語English naïve") == ["हिन्दी", "日本語", "English", "naïve"]
    assert [len(p) for p in langid.pieces("ก" * 95)] == [40, 40, 15]
    assert [len(p) for p in langid.pieces("x" * 95)] == [40, 40, 15]


def test_mixed_and_wordless_texts(spark):
    en = "the cat and the dog were in the house with all of them when it rained on the old town "
    ru = "кошка и собака были в доме со всеми когда пошёл дождь над старым городом "
    zh = "猫和狗在房子里下雨的时候老城里的人都在家"
    rows = [(i, t * (1 + i % 3), lang) for i in range(0, 60, 3) for t, lang, i in ((en, "en", i), (ru, "ru", i + 1), (zh, "zh", i + 2))]
    rows += [(1000, "½ ² Ⅷ", "en"), (1001, None, "en"), (1002, zh * 30, "zh"), (1003, ru + zh * 40, None), (1004, en * 5 + zh, None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i]["lang_pred"] for i in range(1000, 1005)] == ["und", "und", "zh", "zh", "en"]
    assert got[1000]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1003]["spans"] >= 2


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rng = random.Random(12)
    pool = [sentence(rng, rng.randint(4, 14)) for _ in range(30)]
    texts = []
    for i in range(160):
        kind = rng.random()
        if texts and kind < 0.1:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.2:
            w = rng.choice(texts).split(" ")
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        else:
            own = [rng.choice(pool) if rng.random() < 0.4 else sentence(rng, rng.randint(4, 14)) for _ in range(rng.randint(4, 14))]
            texts.append(" ".join([*own, *(["you are a vile zorgan"] * 3 if kind > 0.85 else [])]))
    toxic = ["zorgan" in t for t in texts]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(x)) for i, x in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    bad = {r["doc_id"] for r in toxicity.score(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r["predicted"]}
    assert bad == {i for i, x in enumerate(toxic) if x}
    left = [i for i in range(len(texts)) if i not in bad]
    last = {texts[i]: i for i in left}
    left = sorted(last.values())
    root = brute.components([texts[i] for i in left])
    left = [i for k, i in enumerate(left) if root[k] == k]
    final, _ = brute.stripped([texts[i] for i in left], substring.LEAST, substring.MIN_WORDS)
    coder = packing.WordBpe(vocabulary("word_bpe_49k.json"))
    want = {i: len(x) + 1 for i, x in zip(left, coder.encode_many(final), strict=True)}
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == want
    assert sum(r["length"] for r in got) == sum(want.values())
