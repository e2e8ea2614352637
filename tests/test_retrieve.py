"""Retrieval with score bounds: the same rows as scoring everything, with less scored."""
import math
import random
import re
from collections import Counter

import pytest

from ranklab.operators import expand as R


def _texts(rng, n, vocab):
    weights = [1 / (i + 1) for i in range(len(vocab))]
    return [" ".join(rng.choices(vocab, weights, k=rng.choice([0, 5, 20, 80]))) for _ in range(n)]


def _scores(queries, corpus, model, k):
    docs = [(d, Counter(re.findall(r"\w+", t))) for d, t in corpus]
    n, c = len(docs), sum(sum(x.values()) for _, x in docs)
    df, ctf = Counter(), Counter()
    for _, x in docs:
        df.update(x.keys())
        ctf.update(x)
    out = {}
    for q, t in queries:
        qt, rows = Counter(re.findall(r"\w+", t)), []
        for d, x in docs:
            dl = sum(x.values())
            both = [w for w in qt if w in x]
            if not both:
                continue
            if model == "bm25":
                s = sum(qt[w] * math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * x[w] * 1.9 / (x[w] + .9 * (.6 + .4 * dl / (c / n))) for w in both)
            else:
                s = sum(qt[w] * math.log(1 + x[w] / (100.0 * ctf[w] / c)) for w in both) + sum(qt.values()) * math.log(100.0 / (dl + 100.0))
            rows.append((-round(s, 9), d))
        out.update({(q, d): i + 1 for i, (_, d) in enumerate(sorted(rows)[:k])})
    return out


@pytest.mark.parametrize("model", ["bm25", "ql"])
def test_same_rows_with_fewer_pairs_scored(spark, model):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    corpus = list(enumerate(_texts(rng, 400, vocab)))
    queries = [(i, " ".join(rng.choices(vocab[30:], k=2) + vocab[:2])) for i in range(8)] + [(90, ""), (91, "unknown w0"), (92, "w399")]
    trace = {}
    got = R.retrieve(spark.createDataFrame(queries, "qid long, text string"), spark.createDataFrame(corpus, "did long, text string"),
                     model, 5, mu=100.0, trace=trace).collect()
    assert {(r.qid, r.did): r["rank"] for r in got} == _scores(queries, corpus, model, 5)
    matching, scored = trace["matching"].count(), trace["scored"].count()
    assert scored < matching / 2
    assert trace["scored"].join(trace["matching"], ["qid", "did"], "left_anti").count() == 0


def test_index_counts_documents_without_tokens(spark):
    ix = R.build_index(spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b")], "did long, text string"))
    assert (ix["N"], ix["C"]) == (4, 4)
    assert {(r.term, r.df, r.ctf) for r in ix["terms"].collect()} == {("a", 1, 2), ("b", 2, 2)}


def test_top_terms_with_a_number_per_query(spark):
    rm = spark.createDataFrame([(q, t, p) for q in (1, 2) for t, p in (("x", .5), ("y", .3), ("z", .2))], "qid long, term string, p double")
    n = spark.createDataFrame([(1, 1), (2, 2)], "qid long, n int")
    assert {(r.qid, r.term) for r in R.rm_top_terms(rm, n).collect()} == {(1, "x"), (2, "x"), (2, "y")}
    w = R.rm_to_weighted_query(R.rm_top_terms(rm, 2)).where("qid = 1").first()
    assert (w.weighted, w.bag) == ("#weight( 0.500000 x 0.300000 y )", "x y")
