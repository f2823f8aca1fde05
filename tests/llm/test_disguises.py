"""Disguises that stand beside other words, in long tokens or in letters with accents."""

import pytest

from terraledger.llm import toxicity


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))


def test_accented_letters_are_seen_drawn_out():
    chars = toxicity.CharModel()
    for k in range(32):
        chars.cost[k][27][27] = 20.0  # no language doubles them
    m = toxicity.Model(chars, {"cr\u00e9tin": 5.0}, [0.0, 1.0, 0.0, 0.0])
    assert m.hits("un cr\u00e9\u00e9\u00e9tin") == {1} and not m.hits("~~~ cr\u00e9")


def test_every_word_of_a_row_or_token_is_found(model):
    idiot, moron = model.hits("idiot"), model.hits("moron")
    assert idiot and moron and idiot != moron
    assert idiot <= model.hits("you are a i d i o t")
    assert idiot <= model.hits("we a r e a i d i o t s")
    assert idiot | moron <= model.hits("i d i o t m o r o n")
    for word, want in (("m0r0n", moron), ("stuuupid", model.hits("stupid"))):
        assert want
        for front in ("the.other.day.we.saw.them.there", "x"):
            for back in ("and.then.they.went.home.with.all.of.us.again", "."):
                assert want <= model.hits(f"{front}.{word}.{back}")
