"""Whitening, infilling and chunked BPE against plain versions, libraries and round trips."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from terraledger.llm import chunked_bpe, infill, whitening
from terraledger.llm.queries import ORACLES, QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
RANKS = vocabulary("byte_bpe_multi_50k.tiktoken")


# ---------------------------------------------------------------- whitening


def plain_whitening(vectors, k=8):
    """Exact integers, covariance centred before multiplying, and the library's solver."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(dims)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(r, sums, strict=True)] for r in x])
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, deviation, centred @ q / np.sqrt(e), e / np.trace(v)


def by_vector(rows):
    out = {}
    for r in rows:
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


@pytest.mark.parametrize("dims", [2, 3, 24])
def test_whitening_equals_plain(spark, dims):
    rng = np.random.default_rng(dims)
    vectors = (rng.standard_normal((700, dims)) @ rng.standard_normal((dims, dims)) * 0.2).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(7)
    n, deviation, white, explained = plain_whitening(vectors)
    got = by_vector(whitening.whiten(df).collect())
    assert len(got) == 700 and all(set(g) == set(range(1, min(dims, 8) + 1)) for g in got.values())
    for c in range(1, min(dims, 8) + 1):
        mine = np.array([got[i][c]["whitened"] for i in range(700)])
        sign = np.sign(mine @ white[:, c - 1])
        assert np.abs(mine * sign - white[:, c - 1]).max() < 1e-8
        assert abs(got[0][c]["explained"] - explained[c - 1]) < 1e-12
    assert all(got[i][1]["deviation"] == deviation[i] and got[i][1]["n"] == n for i in range(700))
    errors = {r["identity_error"] for g in got.values() for r in g.values()}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def test_many_partitions_meet_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    vectors = np.random.default_rng(9).standard_normal((90, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(20)
    model = whitening.fit(df)
    n, deviation, _, explained = plain_whitening(vectors)
    assert model.n == n and np.allclose(model.values / model.trace, explained, rtol=1e-12)
    assert sorted(r["deviation"] for r in whitening.apply(df, model).collect()) == sorted(deviation)


def test_solver():
    rng = np.random.default_rng(4)
    cases = [np.zeros((3, 3)), np.eye(4), np.ones((5, 5)), np.diag([1.0, 0, 2, 0]), np.array([[3.0]])]
    cases += [a @ a.T for a in (rng.standard_normal((d, d)) for d in (2, 5, 17, 64))]
    for a in cases:
        e, q = whitening.symmetric_qr(a)
        assert np.all(np.diff(e) <= 1e-12 * max(abs(e[0]), 1)) and np.allclose(e, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(abs(e[0]), 1))
        assert np.allclose(q @ q.T, np.eye(len(a)), atol=1e-13) and np.allclose(q @ a @ q.T, np.diag(e), atol=1e-12 * max(abs(e[0]), 1))


def test_whitening_edges(spark):
    v = lambda *x: list(map(float, x))
    rows = [(1, v(1, 0)), (1, v(1, 0)), (2, v(0, 1)), (None, v(2, 3)), (4, None), (5, [1.0, None]), (6, v(float("nan"), 1)), (7, v(float("inf"), 1)), (8, v(1, 2, 3)), (9, [])]
    df = spark.createDataFrame([(i, e, "x", 2.0) for i, e in rows], "vec_id long, embedding array<double>, state string, EMBEDDING double")
    got = whitening.whiten(df).collect()
    n, deviation, *_ = plain_whitening([e for _, e in rows[:4]])
    assert len(got) == 8 and {r["n"] for r in got} == {4}
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation)
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id = 1")).collect() == []
    assert whitening.whiten(df.limit(0)).schema.simpleString() == whitening.whiten(df).schema.simpleString()
    flat = spark.createDataFrame([(i, v(i, 2 * i, 7)) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}  # one direction has variance
    huge = spark.createDataFrame([(1, v(1e300, 0)), (2, v(-1e300, 0)), (3, v(0, 5))], "vec_id long, embedding array<double>")
    assert all(np.isfinite(r["whitened"]) for r in whitening.whiten(huge).collect())


# ---------------------------------------------------------------- infilling


def plain_infill(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_ropes_equal_plain():
    rng = random.Random(1)
    letters = "abcXYZ  <<>PSM\n1é日😀"
    for i in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        n, form, p, m, out = infill.rearranged(i, text.encode(), rng.choice([1, 2, 3, 5, 8, 64]))
        assert (n, form, p, m, out.decode()) == plain_infill(i, text)
        assert infill.restored(out, form, rng.choice([1, 2, 4, 9, 100])).decode() == text


def test_rope_splits_at_every_unit():
    text = "Words, of several  läñgths: " * 3 + "averylongwordthatspansleaves"
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    for leaf in (1, 4, 7):
        whole = infill.rope(text.encode(), leaf)
        assert (whole.units, whole.points, whole.size) == (len(units), len(text), len(text.encode()))
        for k in range(len(units) + 1):
            a, b = infill.split(whole, k)
            assert infill.flat(a).decode() == "".join(units[:k]) and infill.flat(b).decode() == "".join(units[k:])
            assert ((a.units, a.points) if a else (0, 0)) == (k, len("".join(units[:k])))
            assert infill.unit_rank(whole, len("".join(units[:k]).encode())) == k


def test_infill_edges(spark):
    rows = [(1, ""), (2, None), (3, "a<P>b"), (4, "lorem ipsum " * 20000), (None, "no id here"), (5, "twice"), (5, "twice"), (6, "é日😀"), (7, "<P"), (8, ">S>")]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, form string, TEXT string, output int")
    got = infill.restore(infill.rearrange(df)).collect()
    want = sorted((plain_infill("" if i is None else i, t or "") + (t or "",) for i, t in rows), key=str)
    assert sorted(((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got), key=str) == want
    assert infill.restore(infill.rearrange(df.limit(0))).count() == 0


def test_infill_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(map(tuple, QUERIES["op12_infill"](spark, SF).collect())) == sorted(con.sql(ORACLES["op12_infill"]).fetchall())


# ---------------------------------------------------------------- chunked BPE


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(library, text):
    ids = library.encode_ordinary(text)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


PARTS = ["'s", "'t", "'re", "'", " ", "  ", "\n", "\t", "a", "A", "é", "²", "7", "<|endoftext|>", "!", "--", "日本", "́", "\xa0", "\x1c", "\x85", "​", "😀", "the", "ing", " don't", "_", "tion", "при", "вет", "ع", "eeeeee", "      "]


def sampled(n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_words_equal_library(library):
    coder = chunked_bpe.RankBpe(RANKS)
    rng = random.Random(2)
    texts = sampled(1500, 60, 3) + ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(0, 70))) for _ in range(1500)] + ["a" * 5000, "ab" * 3000, " " * 3000 + "x"]
    for t in texts:
        ids = coder.words.ids(chunked_bpe.pre_tokens(t))[0]
        assert ids.tolist() == library.encode_ordinary(t) and coder.decoded(ids) == t.encode()


@pytest.mark.parametrize("size, overlap", [(8, 4), (20, 5), (60, 12)])
def test_chunks_stitch_to_the_whole(spark, library, size, overlap):
    texts = sampled(150, 80, size) + ["x" * 300, "a " * 90, "'re" * 70, " \n" * 80 + "end", "word " * 3 + "y" * 150 + " and on " * 12, "12345" * 40 + " " * 50 + "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = chunked_bpe.encode_documents(df, RANKS, ids=True, size=size, overlap=overlap)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert {i: tuple(rows[i][1:4]) for i in rows} == {i: digest(library, t) for i, t in enumerate(texts)}
    assert all((rows[i]["ids"] or []) == library.encode_ordinary(t) for i, t in enumerate(texts))
    assert {r["doc_id"]: bytes(r["raw"]).decode() for r in chunked_bpe.decode_documents(got, RANKS).collect()} == dict(enumerate(texts))


def test_sure_boundaries_hold(library):
    """What a chunk calls sure is a boundary of every longer text."""
    for text in sampled(300, 40, 8):
        whole = set(np.cumsum([0, *map(len, chunked_bpe.pre_tokens(text))]).tolist())
        for cut in range(len(text)):
            assert set(chunked_bpe.boundaries(text[:cut])[1].tolist()) <= whole


def test_chunked_edges(spark, library):
    long = "lorem ipsum dolor " * 3000
    rows = [(1, ""), (2, None), (3, long), (4, long), (3, long), (None, long + "x"), (5, "a b"), (5, "a b"), (6, "z" * 40000)]
    df = spark.createDataFrame([(i, t, "k", 1, "y") for i, t in rows], "doc_id long, text string, key string, chunk int, TEXT string")
    got = chunked_bpe.encode_documents(df, RANKS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *digest(library, t or ""))) for i, t in rows)
    assert chunked_bpe.encode_documents(df.limit(0), RANKS).count() == 0


def test_chunked_query_equals_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_chunked_bpe"](spark, SF).collect()} == {i: digest(library, t) for i, t in texts.items()}
