"""ROUGE-L against the dynamic programme."""
import random

import pytest

from ranklab.functions import text as X


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_rouge_l_and_means(spark):
    rng = random.Random(2)
    draw = lambda n, w: [rng.choice(w) for _ in range(n)]
    pairs = [(i, draw(rng.randint(0, 25), "abcde"), draw(rng.randint(0, 25), "abcde")) for i in range(60)]
    pairs += [(100, ["a"] * 80, ["a"] * 70 + ["b"]), (101, [], []), (102, ["x"], ["y"]), (103, None, ["y"]), (104, draw(300, "ab"), draw(300, "abc"))]
    df = spark.createDataFrame(pairs, "pid long, hyp array<string>, ref array<string>")
    want = {}
    for i, h, r in pairs:
        n = _lcs(h or [], r or [])
        p, c = (n / len(h) if h else 0.0), (n / len(r) if r else 0.0)
        want[i] = (p, c, 2 * p * c / (p + c) if p + c else 0.0)
    got = {r.pid: (r.precision, r.recall, r.f) for r in X.rouge_l(df).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i] == pytest.approx(w), i
    assert "Python" not in X.rouge_l(df)._jdf.queryExecution().toString()
    m = {r.measure: r for r in X.rouge_means(df.where("hyp IS NOT NULL")).collect()}
    some = [w for i, w in want.items() if i != 103]
    assert m["rouge_l"].f == pytest.approx(sum(w[2] for w in some) / len(some))
    assert set(m) == {"rouge_1", "rouge_2", "rouge_l"}
