"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terraledger.llm import ann, bpe, exact_dedup, langid, minhash, packing, sharding, substring, toxicity, wordpiece
from terraledger.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _h string, _text int, _row int, cls double, part int, slot int"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000
PASSAGE = "One passage of a good many words stands here. It goes on for a while so that it counts. And then it ends with a last sentence of its own."
ROWS = [
    (1, "", "en", "src1"), (2, None, "en", "src2"), (3, "a b", None, None), (3, "a b", None, None), (4, "a b", "de", "src3"), (None, "x y z w v u", "en", "src4"),
    (5, LONG, "en", "src0"), (6, LONG + "end", "en", "src0"), (7, "Hello there! " + PASSAGE, "en", "src5"), (8, PASSAGE + " Other words.", "fr", "src6"),
    (9, "x" * 9000, "en", "src7"), (10, "12 34 !!", "en", "src8"), (11, "日本語 テキスト", "ja", "src9"), (5, "other text of five", "en", "src0"),
]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "_h", "_text", "_row", "cls", "part", "slot"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "h", 2, 3, 0.5, 7, 8) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 1), (None, 0, 1), (6, None, None), (7, 0, 0), (8, 1, 5)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none):
    got = exact_dedup.groups(docs, block=64).collect()
    assert len(got) == len(ROWS)
    by = {(r["doc_id"], r["text_sha256"]): r for r in got}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert by[1, sha("")]["keep_id"] == 2 and by[2, sha("")]["kept"] and by[2, sha("")]["group_size"] == 2
    assert by[3, sha("a b")]["keep_id"] == 4 and by[3, sha("a b")]["group_size"] == 3
    assert by[None, sha("x y z w v u")]["kept"]
    assert by[5, sha(LONG)]["group_size"] == 1 and by[5, sha("other text of five")]["group_size"] == 1
    assert exact_dedup.groups(none).count() == 0


def test_exact_dedup_keeps_columns(docs):
    out = exact_dedup.dedup(docs)
    assert out.columns == COLUMNS
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 2, 4, 5, 5, 6, 7, 8, 9, 10, 11]


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_block_names_are_exact(spark, block):
    rng = np.random.default_rng(block)
    texts = ["".join(rng.choice(list("ab"), size=rng.integers(0, 12))) for _ in range(300)]
    got = exact_dedup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block).collect()
    for r in got:
        same = [i for i, t in enumerate(texts) if t == texts[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(same), len(same), r["doc_id"] == max(same))


def test_minhash(docs, none):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    of = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert of[1, 0] == 1 and of[2, 0] == 2  # empty sets are linked with nothing
    assert of[3, 1] == 3 and of[4, 1] == 3  # fewer words than a shingle: the whole sequence
    assert of[6, [n for d, n in of if d == 6][0]] == 5
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.dedup(docs).columns == COLUMNS


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = bpe.encode_documents(docs, path).collect()
    assert len(got) == len(ROWS)
    want = sorted((r[0] or 0, len(t.encode(r[1] or "", add_special_tokens=False).ids), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in ROWS)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["decoded_sha256"]) for r in got) == want
    assert bpe.encode_documents(none, path).count() == 0


def test_substring(docs, none):
    got = substring.removed(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (3, 5)}
    assert by[7]["n_removed"] == 0 and by[8]["text"] == "Other words."
    assert by[9]["text"] == "x" * 9000 and by[2]["text"] == "" and by[2]["n_sentences"] == 0
    assert substring.removed(none).count() == 0
    out = substring.strip(docs)
    assert out.columns == COLUMNS and out.count() == len(ROWS) and out.where("text is null").count() == 1


def test_wordpiece(docs, none):
    path = vocabulary("byte_bpe_50k.json")
    got = wordpiece.count_tokens(docs, path).collect()
    assert len(got) == len(ROWS) and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert wordpiece.count_tokens(none, path).count() == 0


def test_language(docs, none):
    got = langid.identify(docs).collect()
    assert len(got) == len(ROWS)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 10)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert langid.identify(none).count() == 0


def test_toxicity(docs, labels, none):
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.score(none, labels).count() == 0
    assert toxicity.score(docs, labels.limit(0)).count() == len(ROWS)
    assert toxicity.clean(docs, labels).columns == COLUMNS


def test_sharding(docs, none):
    got = sharding.shard(docs, shards=4).collect()
    assert len(got) == len(ROWS)
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sum(r["size"] for r in got) == sum(len((t or "").encode()) + 1 for _, t, _, _ in ROWS)
    assert sharding.shard(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(docs.repartition(5), path).collect()
    want = sorted(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, _, _ in ROWS)
    assert sum(r["length"] for r in got) == sum(want)
    assert sorted(r["doc_tokens"] for r in got if r["start"] == 0) == want
    seq = {}
    for r in got:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.WIDTH
    assert packing.pack(none, path).count() == 0


def test_nearest(spark):
    v = lambda *x: list(map(float, x))
    rows = [(20, v(1, 0)), (40, v(0, 1)), (1, v(1, 0)), (2, v(1, 0)), (3, v(0.5, 0.5)), (4, v(0, 0)), (5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, v(1, 2, 3)), (None, v(1, 1)), (2, v(1, 0))]
    df = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<float>, label int, pos int")
    got = sorted(tuple(r) for r in ann.search(df).select("query_id", "rank", "vec_id", "score").collect())
    assert got == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 0.5), (20, 4, 40, 0.0), (40, 1, 3, 0.5), (40, 2, 1, 0.0), (40, 3, 2, 0.0), (40, 4, 20, 0.0)]
    assert ann.search(df.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, labels, none, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, none):
        now = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            path = str(tmp_path / f"{table is docs}-{k}")
            out.write.parquet(path)
            now = spark.read.parquet(path)
            assert now.columns == COLUMNS or k == len(corpus_pipeline.STAGES) - 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "minhash near-dedup", "substring dedup", "packing"]


def test_columns_of_documents_are_untouched(docs):
    a = minhash.dedup(docs).select(*[F.col(c) for c in COLUMNS]).where("doc_id = 9").first()
    assert tuple(a) == (9, "x" * 9000, "en", "src7", 1, "h", 2, 3, 0.5, 7, 8)
