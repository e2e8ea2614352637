"""Forms of operators that the registered queries don't use."""
import math
import random

import pytest
from pyspark.sql import functions as F

from ranklab.functions import arrays as A
from ranklab.functions import metrics as M
from ranklab.functions import text as X
from ranklab.operators import compare as C
from ranklab.operators import expand as E
from ranklab.operators import fusion as FU
from ranklab.operators import rank as R
from ranklab.operators import select as SEL

RUN = "system string, qid string, did string, score double"
QRELS = "qid string, did string, rel int"


def _overlap(a, b, k, p):
    depth = min(len(a), len(b), k)
    if not depth:
        return 0.0
    share = [len(set(a[:d]) & set(b[:d])) / d for d in range(1, depth + 1)]
    if p == 1:
        return sum(share) / depth
    return sum((1 - p) * p ** d * x for d, x in enumerate(share)) + share[-1] * p ** depth


def test_rbo_equals_the_direct_sum(spark):
    rnd = random.Random(3)
    lists = {}
    for q in range(12):
        lists[q] = [rnd.sample(range(40), rnd.randint(1, 30)) for _ in "ab"]
    lists[0][1] = []                                         # a query that one run lacks
    frames = [spark.createDataFrame([(q, d, float(-i)) for q, ab in lists.items() for i, d in enumerate(ab[s])],
                                    "qid long, did long, score double") for s in (0, 1)]
    got = {(r.qid, r.k, r.p): r.rbo for r in C.rbo(*frames, ks=[3, 25], ps=[0.8, 1.0], per_query=True).collect()}
    assert len(got) == 12 * 4
    for (q, k, p), v in got.items():
        assert v == pytest.approx(_overlap(*lists[q], k, p), abs=1e-9)
    mean = {(r.k, r.p): r.rbo for r in C.rbo(*frames, ks=[3, 25], ps=[0.8, 1.0]).collect()}
    assert mean[(3, 1.0)] == pytest.approx(sum(_overlap(*ab, 3, 1.0) for ab in lists.values()) / 12)


def test_rbo_plan_has_no_join(spark):
    df = spark.createDataFrame([(1, 1, 1.0)], "qid long, did long, score double")
    plan = C.rbo(df, df, [10], [0.9])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_library_ideal_from_grade_counts(spark):
    rnd = random.Random(4)
    lists = {f"q{i}": [rnd.choice([0, 0, 1, 2, 3, -1]) for _ in range(rnd.randint(1, 25))] for i in range(15)}
    run, qrels = M.grades_to_run(spark, lists)
    names = ["ndcg_lib@10:0", "ndcg_lib@10:1", "ndcg_lib@3:1"]
    for r in M.evaluate_wide(run, qrels, names).collect():
        for name, k, method in zip(names, (10, 10, 3), (0, 1, 1), strict=True):
            def dcg(g):
                return sum(x / (math.log2(i + 1) if method else 1 if i == 1 else math.log2(i)) for i, x in enumerate(g[:k], 1))
            best = dcg(sorted(lists[r.qid], reverse=True))
            assert r[name] == pytest.approx(dcg(lists[r.qid]) / best if best else 0.0, abs=1e-9)


def test_topic_is_the_text_after_the_last_dash(spark):
    run = spark.createDataFrame([("s", "web-2012-7", "d1", 2.0), ("s", "8", "d1", 1.0)], RUN)
    qrels = spark.createDataFrame([("7", "d1", 2), ("x-8", "d2", 1)], QRELS)
    got = {r.qid: r.value for r in M.evaluate(run, qrels, ["gdeval_ndcg@5"], gdeval_topics=True).collect()}
    assert got == {"7": 1.0, "8": 0.0}


def test_query_without_a_list_scores_zero(spark):
    run = spark.createDataFrame([("s", "1", "1", "d1", 2.0), ("t", "2", "2-a", "d1", 2.0)],
                                "system string, qid string, vid string, did string, score double")
    qrels = spark.createDataFrame([("1", "d1", 1), ("2", "d1", 1)], QRELS)
    asked = spark.createDataFrame([("1",), ("2",)], "qid string")
    got = {(r.system, r.qid, r.vid): r.value for r in M.evaluate(run, qrels, ["P_1"], queries=asked).collect()}
    assert got == {("s", "1", "1"): 1.0, ("s", "2", "2"): 0.0, ("t", "2", "2-a"): 1.0, ("t", "1", "1"): 0.0}


def test_sweep_equals_single_fusions(spark):
    rnd = random.Random(5)
    rows = [(s, str(q), f"d{d}", float(rnd.randint(0, 50))) for s in "abc" for q in range(4) for d in rnd.sample(range(12), 6)]
    rows = [r for r in rows if not (r[0] == "c" and r[1] == "3")]      # c lacks a query
    run = spark.createDataFrame(rows, RUN)
    sweep = FU.fuse_linear_sweep(run, ["a", "b", "c"], step=0.5)
    assert sweep.select("weights").distinct().count() == 6
    w = spark.createDataFrame([("a", 0.5), ("b", 0.0), ("c", 0.5)], "system string, weight double")
    one = {(r.qid, r.did): (r["rank"], r.score) for r in FU.fuse_linear(run, w).collect()}
    got = {(r.qid, r.did): (r["rank"], r.score) for r in sweep.where("weights = '0.5_0.0_0.5'").collect()}
    assert got == one


def test_score_types_of_a_filtered_run(spark):
    run = spark.createDataFrame([("s", "1", f"d{i}", float(9 - i)) for i in range(4)], RUN)
    qrels = spark.createDataFrame([("1", "d1", 2), ("1", "d3", 1), ("1", "d2", -1)], QRELS)

    def rows(**kw):
        return [(r.did, r["rank"], r.score, r.tag) for r in R.filter_oracle_run(run, qrels, 3, 2, **kw).orderBy("rank").collect()]
    assert rows() == [("d0", 1, 9.0, "rel0"), ("d1", 2, 8.0, "rel2"), ("d3", 3, 6.0, "rel1")]
    assert [r[2] for r in rows(score_type="relevance")] == [0.0, 2.0, 1.0]
    assert [r[2] for r in rows(score_type="uniform")] == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError, match="score_type"):
        rows(score_type="rank")


def test_model_from_given_probabilities(spark):
    run = spark.createDataFrame([("s", "1", "d1", 3.0), ("s", "1", "d2", 1.0)], RUN)
    corpus = spark.createDataFrame([("d1", "apple pear"), ("d2", "apple apple apple plum")], "did string, text string")
    got = {r.term: r.p for r in E.relevance_model(run, corpus, 10, probabilities=True).collect()}
    assert got == pytest.approx({"apple": 0.75 * 0.5 + 0.25 * 0.75, "pear": 0.375, "plum": 0.0625})
    bad = run.withColumn("score", F.lit(-1.0))
    with pytest.raises(Exception, match="negative"):
        E.relevance_model(bad, corpus, 10, probabilities=True).collect()


def test_special_ids_survive_truncation(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["a"]), (3, [])], "qid long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 10), ("b", 11), ("c", 12), ("d", 13)], "term string, term_id int")
    got = {r.qid: r.ids for r in X.encode_tokens(df, "qid", "tokens", vocab, 4, end_id=3).collect()}
    assert got == {1: [2, 10, 11, 3], 2: [2, 10, 3, 0], 3: [2, 3, 0, 0]}
    with pytest.raises(ValueError, match="no room"):
        X.encode_tokens(df, "qid", "tokens", vocab, 1, end_id=3)


def test_padding_to_a_shape(spark):
    df = spark.createDataFrame([([[1, 2, 3], [4]],), ([],)], "a array<array<int>>")
    got = [r[0] for r in df.select(A.pad_to_shape(F.col("a"), [3, 2], 0)).collect()]
    assert got == [[[1, 2], [4, 0], [0, 0]], [[0, 0]] * 3]
    deep = spark.createDataFrame([([[[7]]],)], "a array<array<array<int>>>")
    assert deep.select(A.pad_to_shape(F.col("a"), [1, 2, 2], 5)).first()[0] == [[[7, 5], [5, 5]]]


def test_join_by_a_function(spark):
    df = spark.createDataFrame([(["a"], ["b", "c"])], "x array<string>, y array<string>")
    assert df.select(A.str_join([F.col("x"), F.col("y")], lambda a: F.concat_ws("+", F.reverse(a)))).first()[0] == "c+b+a"


def test_default_system_names_and_given_systems(spark):
    run = spark.createDataFrame([("1", "d1", 2.0), ("1", "d2", 1.0)], "qid string, did string, score double")
    both = SEL.concat_systems([run, run])
    assert {r.system for r in both.select("system").distinct().collect()} == {"Sys1", "Sys2"}
    wide = SEL.rank_alignment(both, 1, systems=["Sys1", "Sys2"]).collect()
    assert [(r.did, r.Sys1, r.Sys2) for r in wide] == [("d1", 1, 1)]
