"""Operators against brute force, libraries and held-out labels."""

import collections
import hashlib
import itertools
import os
import random

import duckdb
import numpy as np
import pytest

from terraledger.llm import ann, hilbert, langid, minhash, substring, toxicity, wordpiece
from terraledger.llm.bpe import ByteBpe
from terraledger.llm.packing import WordBpe
from terraledger.llm.queries import ORACLES, QUERIES, vocabulary
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def near_copies(n, seed):
    """Copies of a few texts with every rate of changed words, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    bases = [[word() for _ in range(80)] for _ in range(4)]
    out = []
    for _ in range(n):
        base = rng.choice(bases)
        rate = rng.choice([0, 0.005, 0.01, 0.03, 0.1])
        out.append(" ".join(word() if rng.random() < rate else w for w in base) if rng.random() < 0.8 else " ".join(word() for _ in range(rng.randint(0, 90))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    texts = near_copies(260, seed)
    root = brute.components(texts)
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == {i: (root[i], len(brute.shingles(t))) for i, t in enumerate(texts)}


def test_stream_equals_library():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    coder, t = ByteBpe(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    parts = ["'s", "'t", "'re", " ", "  ", "\n", "a", "A", "é", "²", "<|endoftext|>", "<|endof", "!", "--", "日本", "́", "\xa0", "\x1c", "😀", "the", "ing", " don't", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["a" * 9000, " " * 5000 + "x", "ab" * 7000, "é" * 6000, "\n" * 4000 + " y"]
    for text in texts:
        coder.CHUNK, coder.HELD = rng.choice([1, 2, 3, 7, 50, 4000]), rng.choice([3, 8, 600])
        want = t.encode(text, add_special_tokens=False).ids
        ids = coder.encode_many([text])[0]
        assert ids.tolist() == want
        back = t.decode(want, skip_special_tokens=False)
        assert "".join(coder.decoded(ids, 3)) == back
        step = rng.choice([1, 5, 900])
        digests = coder.digests(text[i : i + step] for i in range(0, len(text), step))
        assert digests == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_word_bpe_equals_library():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    coder, t = WordBpe(path), Tokenizer.from_file(path)
    rng = random.Random(4)
    parts = ["'S", "don't", " ", "\t", "Éa", "ß", "İx", "½", "<|startoftext|>", "Σας", "12", "--", "日本", "é", "\x1d", "\x85", "THE", "ing,", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for text, ids in zip(texts, coder.encode_many(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_longest_match_equals_library():
    from tokenizers import models

    first, rest = {b"a", b"ab", b"abcd", b"b"}, {b"b", b"cd", b"c", b"bcde"}
    vocab = {p.decode(): i for i, p in enumerate(sorted(first))} | {"##" + p.decode(): 9 + i for i, p in enumerate(sorted(rest))} | {"[UNK]": 99}
    library = models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=1000)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    got = wordpiece.LongestMatch(first, rest).counts([w.encode() for w in words])
    assert got.tolist() == [len(library.tokenize(w)) for w in words]


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(60):
        counts = rng.integers(0, 6, 4)
        scores = rng.normal(size=(counts.sum(), 3)) * 2
        path, at = langid.viterbi(scores, counts, 1.0), 0
        for c in counts:
            s = scores[at : at + c]
            value = lambda q, s=s: sum(s[i, k] for i, k in enumerate(q)) - sum(a != b for a, b in zip(q, q[1:], strict=False))
            if c:
                assert abs(value(path[at : at + c]) - max(map(value, itertools.product(range(3), repeat=int(c))))) < 1e-9
            at += c


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_steps_to_neighbours(dims, bits):
    cells = np.arange(1 << (dims * bits))
    points = np.stack([(cells >> (bits * i)) & ((1 << bits) - 1) for i in range(dims)], axis=1)
    index = hilbert.hilbert_index(points, bits)
    assert sorted(index) == list(cells)
    assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(1) == 1).all()


def test_recall_and_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    x, ids = np.array([r["embedding"] for r in rows], dtype=float), np.array([r["vec_id"] for r in rows])
    found = collections.defaultdict(dict)
    for r in ann.search(df).collect():
        found[r["query_id"]][r["vec_id"]] = r["score"]
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hit, total = hit + len(set(best) & set(found[ids[i]])), total + 20
        assert all(abs(v - s[ids == k][0]) < 1e-12 for k, v in found[ids[i]].items())
    assert hit / total >= 0.9


def test_passages_go_once(spark):
    rng = random.Random(6)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(3, 15))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(8))
    texts = []
    for _ in range(40):
        t = [sentence() for _ in range(6)]
        t.insert(rng.randint(0, 6), passage) if rng.random() < 0.5 else None
        texts.append(" ".join(t))
    got = {r["doc_id"]: r for r in substring.removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    having = [i for i, t in enumerate(texts) if passage in t]
    assert passage in got[having[0]]["text"]
    for i, t in enumerate(texts):
        if i not in having or i == having[0]:
            assert got[i]["text"] == t
        else:
            left = [x for x in passage.split(". ") if x in got[i]["text"]]  # an end too short for a run may stay
            assert len(" ".join(left).split()) < substring.MIN_WORDS


def test_disguises_are_undone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    plain = model.hits("you idiot")
    assert plain and all(model.hits(t) for t in ("i.d.i.o.t", "stuuupid", "m0r0n", "$cum", "tr@sh", "you i d i o t now"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(p == t for p, t in held) / len(held) >= 0.9


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in langid.identify(docs).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) >= 0.97


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    want = c.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[want.columns]
    key = list(want.columns)
    assert sorted(map(tuple, got[key].astype(str).values)) == sorted(map(tuple, want[key].astype(str).values))
