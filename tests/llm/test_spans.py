"""Repeated passages wherever they begin and end."""

import random

from terraledger.llm import substring
from tests.llm import brute


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n)]


def sentence(rng, n):
    return " ".join(words(rng, n)).capitalize() + "."


def stripped(spark, texts):
    return {r["doc_id"]: r["text"] for r in substring.removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_ends_of_passages_go(spark):
    rng = random.Random(7)
    for sizes in [(13, 13, 12, 12), (24, 2, 9), (3, 24, 24, 1), (12, 14), *([rng.randint(3, 15) for _ in range(8)] for _ in range(3))]:
        passage = " ".join(sentence(rng, n) for n in sizes)
        hosts = [[sentence(rng, rng.randint(3, 15)) for _ in range(6)] for _ in range(3)]
        texts = [" ".join([*h[:3], passage, *h[3:]]) for h in hosts]
        got = stripped(spark, texts)
        assert got[0] == texts[0]
        assert [got[k] for k in (1, 2)] == [" ".join(hosts[k]) for k in (1, 2)]


def test_passages_spliced_into_sentences_go(spark):
    rng = random.Random(8)
    for sizes in [(18, 16, 18), (60, 10), (9, 9, 9, 9, 9, 30)]:
        passage = [w for n in sizes for w in sentence(rng, n).split()]
        fronts, backs = [words(rng, n) for n in (3, 5, 30)], [words(rng, n) for n in (4, 1, 20)]
        texts = [" ".join(f + passage + b) for f, b in zip(fronts, backs, strict=True)]
        got = stripped(spark, texts)
        assert got[0] == texts[0]
        cut = [k for k, w in enumerate(passage) if brute.cut_after(w, " ")]
        for k in (1, 2):  # what lies in one piece with the host's words stays
            assert got[k].split() == fronts[k] + passage[: cut[0] + 1] + passage[cut[-1] + 1 :] + backs[k]
