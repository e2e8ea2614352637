"""Inputs that once stopped a job or lost rows."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ranklab.functions import arrays as A
from ranklab.functions import text as X
from ranklab.operators import fusion as FU
from ranklab.operators import rank as R
from ranklab.sources import formats as S


def _file(text):
    p = os.path.join(tempfile.mkdtemp(prefix="rl-crash-", dir="/tmp"), "x.txt")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_perplexity_with_empty_text(spark):
    corpus = spark.createDataFrame([(["a", "b"],), ([],), (["a", "c"],)], "tokens array<string>")
    texts = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "qid long, tokens array<string>")
    out = X.ngram_perplexity(texts, "qid", corpus).collect()
    # p(a|<s>) = 3/(2+4), p(b|a) = 2/(2+4); V = 3 words + unknown
    assert [(r.qid, r.n) for r in out] == [(1, 2)]
    assert out[0].perplexity == pytest.approx((3 / 6 * 2 / 6) ** -0.5)


def test_mask_of_no_length(spark):
    df = spark.createDataFrame([(0,), (2,), (None,)], "n int")
    assert [r[0] for r in df.select(A.len_to_mask(F.col("n"), 0)).collect()] == [[], [], None]
    assert [r[0] for r in df.where("n = 2").select(A.len_to_mask(F.col("n"), 3)).collect()] == [[True, True, False]]


def test_no_ranks_keep_nothing(spark):
    run = spark.createDataFrame([("a", 1, 5, 2.0)], "system string, qid long, did long, score double")
    assert R.select_by_ranks(run, []).count() == 0


def test_rejects_of_a_run(spark):
    p = _file("1 Q0 d1 1 9.5 x\n1 Q0 d1 3 7.0 x  # repeat\nbad line\n1 Q0 d2 one 8.0 x\n1 Q0 d3 4 high x\n\n# only a note\n")
    got = S.read_run(spark, p, comments=True, on_bad="keep")
    assert [(r.did, r["rank"]) for r in got.where("reject IS NULL").collect()] == [("d1", 3)]
    assert sorted((r.reject, r.line) for r in S.rejects(got).collect()) == [
        ("fields", "bad line"), ("rank", "1 Q0 d2 one 8.0 x"), ("score", "1 Q0 d3 4 high x")]
    assert {r.file.rsplit("/", 1)[-1] for r in S.rejects(got).collect()} == {"x.txt"}
    assert S.read_run(spark, p, comments=True).count() == 1
    with pytest.raises(Exception, match="bad line"):
        S.read_run(spark, p, on_bad="raise").collect()
    with pytest.raises(ValueError, match="on_bad"):
        S.read_run(spark, p, on_bad="skip")
    runs = S.read_runs(spark, [p], comments=True, on_bad="keep")
    assert {r.system for r in runs.collect()} == {"x"}


def test_rejects_of_judgments_and_evals(spark):
    p = _file("1 0 d1 2 # first\n1 0 d1 1\n1 d2\n1 0 d3 high\n1\n")
    got = S.read_qrels(spark, p, comments=True, on_bad="keep")
    assert {(r.did, r.rel) for r in got.where("reject IS NULL").collect()} == {("d1", 1), ("d2", 1)}
    assert sorted(r.reject for r in S.rejects(got).collect()) == ["fields", "rel"]
    with pytest.raises(Exception, match="bad line"):
        S.read_qrels(spark, p, comments=True, on_bad="raise").collect()
    lines = spark.createDataFrame([("map 1 0.5",), ("map all 0.5",), ("p 1 x",), ("p 1",), ("p 2 0.1",)], "value string")
    per, total = S.parse_eval(lines, on_bad="keep")
    assert total.count() == 1
    assert sorted(r.reject for r in S.rejects(per).collect()) == ["fields", "value"]
    good = per.where("reject IS NULL")
    assert {(r.metric, r.qid) for r in S.unequal_queries(good).collect()} == {("map", "2"), ("p", "1")}
    assert S.unequal_queries(good.where("metric = 'map'")).count() == 0


def test_custom_fusion_of_long_lists(spark):
    rows = [(s, 1, d, float((d * k) % 331)) for s, k in (("a", 7), ("b", 11)) for d in range(300)]
    lists = spark.createDataFrame(rows, "system string, qid long, did long, score double")
    out = FU.fuse_custom(lists, lambda b: b["score"] / b["hi"], {"hi": F.max("score")}).collect()
    hi = {s: max(r[3] for r in rows if r[0] == s) for s in "ab"}
    want = {d: sum(r[3] / hi[r[0]] for r in rows if r[2] == d) for d in range(300)}
    assert {r.did: pytest.approx(r.score) for r in out} == want
    assert [r.did for r in sorted(out, key=lambda r: r["rank"])] == sorted(want, key=lambda d: (-round(want[d], 9), d))
    best = FU.fuse_custom(lists, lambda b: b["score"], combine="max").where("rank = 1").first()
    assert best.score == max(r[3] for r in rows)
