"""Readability: hand-counted texts."""
import pytest

from ranklab.functions import text as X


def test_measures_by_hand(spark):
    # 8 words, 2 sentences, syllables: the 1 cat 1 sat 1 / animals 3 banana 3 eat 1 a 1 banana 3
    docs = spark.createDataFrame([(1, "The cat sat. Animals, banana eat a banana!"), (2, ""), (3, "?!"), (4, "word " * 150 + ".")], "did long, text string")
    easy = spark.createDataFrame([("the",), ("cat",), ("a",), ("word",), ("the",)], "term string")
    out = {r.did: r for r in X.readability(docs, "did", easy=easy).collect()}
    r = out[1]
    assert (r.words, r.sentences, r.syllables, r.poly, r.difficult) == (8, 2, 14, 3, 2)       # animals, banana
    assert r.dale_chall == pytest.approx(0.1579 * (5 / 8 * 100) + 0.0496 * 4 + 3.6365)        # sat animals banana eat banana
    assert r.linsear == pytest.approx(((5 + 9) / 2 - 2) / 2)
    grades = [r.fk_grade, r.smog, r.coleman_liau, r.ari, r.dale_chall, r.linsear, r.gunning_fog]
    import math
    votes = [v for g in grades for v in (math.floor(g + 0.5), math.ceil(g))]
    ease = r.flesch_ease
    votes += [13] if ease < 30 else [12] if ease < 40 else [11] if ease < 50 else [10] if ease < 60 else [8, 9] if ease < 70 else [7]
    assert r.consensus == min(set(votes), key=lambda v: (-votes.count(v), v))
    for d in (2, 3):
        assert all(out[d][c] is None for c in X.READABILITY)
    assert out[4].linsear == pytest.approx(100 / 1 / 2) and out[4].difficult == 0
    means = X.readability_means(X.readability(docs, "did", easy=easy)).first()
    assert means.linsear == pytest.approx((r.linsear + out[4].linsear) / 2)
    plain = X.readability(docs, "did").where("did = 1").first()
    assert plain.difficult is None and plain.dale_chall is None and plain.consensus is not None


def test_frequent_words(spark):
    docs = spark.createDataFrame([("a b b",), ("a c",), ("",)], "text string")
    assert {r.term for r in X.frequent_words(docs, 0.5).collect()} == {"a"}
