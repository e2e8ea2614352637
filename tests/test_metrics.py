"""Metric goldens: the reference's doctest values and a hand-computed ERR."""
import math

import pytest

from ranklab.functions import metrics as M


def _wide(spark, lists, measures):
    run, qrels = M.grades_to_run(spark, lists)
    return {r["qid"]: r.asDict() for r in M.evaluate_wide(run, qrels, measures).collect()}


def test_mean_reciprocal_rank(spark):
    w = _wide(spark, {"a": [0, 0, 1], "b": [0, 1, 0], "c": [1, 0, 0]}, ["recip_rank"])
    assert sum(v["recip_rank"] for v in w.values()) / 3 == pytest.approx(0.611111, abs=1e-6)


def test_library_r_precision(spark):
    w = _wide(spark, {"a": [0, 0, 1], "b": [0, 1, 0], "c": [1, 0, 0]}, ["rprec_lib"])
    assert [round(w[q]["rprec_lib"], 6) for q in "abc"] == [0.333333, 0.5, 1.0]


def test_precision_at_3(spark):
    w = _wide(spark, {"a": [0, 0, 1]}, ["P_3"])
    assert w["a"]["P_3"] == pytest.approx(1 / 3)


def test_library_average_precision(spark):
    w = _wide(spark, {"a": [1, 1, 0, 1, 0, 1, 0, 0, 0, 1]}, ["ap_retrieved"])
    assert w["a"]["ap_retrieved"] == pytest.approx(0.783333, abs=1e-6)


def test_dcg_methods(spark):
    g = [3, 2, 3, 0, 0, 1, 2, 2, 3, 0]
    w = _wide(spark, {"a": g}, ["dcg_lib@1:0", "dcg_lib@2:0", "dcg_lib@10:0", "dcg_lib@2:1"])["a"]
    assert w["dcg_lib@1:0"] == pytest.approx(3.0)
    assert w["dcg_lib@2:0"] == pytest.approx(5.0)
    assert w["dcg_lib@10:0"] == pytest.approx(9.605118, abs=1e-6)
    assert w["dcg_lib@2:1"] == pytest.approx(4.261860, abs=1e-6)


def test_ndcg_methods(spark):
    w = _wide(spark, {"a": [2, 1, 2, 0]}, ["ndcg_lib@4:0", "ndcg_lib@4:1"])["a"]
    assert w["ndcg_lib@4:0"] == pytest.approx(0.920303, abs=1e-6)
    assert w["ndcg_lib@4:1"] == pytest.approx(0.965195, abs=1e-6)


def test_err_hand_value(spark):
    w = _wide(spark, {"a": [0, 3, 1, 4]}, ["gdeval_err@4"])["a"]
    assert w["gdeval_err@4"] == pytest.approx(0.35406494140625, abs=1e-12)


def test_trec_ndcg_and_map_against_python(spark):
    grades = [0, 2, 0, 1, 3, 0, 0, 1]
    run, qrels = M.grades_to_run(spark, {"q": grades})
    # one extra judged document that was not retrieved
    extra = spark.createDataFrame([("q", 99, 2)], "qid string, did long, rel int")
    w = {r["qid"]: r for r in M.evaluate_wide(run, qrels.unionByName(extra), ["ndcg_cut_5", "map"]).collect()}["q"]
    dcg = sum(g / math.log2(i + 2) for i, g in enumerate(grades[:5]))
    ideal = sorted(grades + [2], reverse=True)[:5]
    assert w["ndcg_cut_5"] == pytest.approx(dcg / sum(g / math.log2(i + 2) for i, g in enumerate(ideal)))
    hits, ap = 0, 0.0
    for i, g in enumerate(grades, 1):
        if g > 0:
            hits += 1
            ap += hits / i
    assert w["map"] == pytest.approx(ap / 5)


def test_rbp_residual_bounds(spark):
    run, qrels = M.grades_to_run(spark, {"q": [1, 0, 2, 1]})
    qrels = qrels.where("did <> 1")  # document 1 unjudged
    r = M.evaluate_wide(run, qrels, ["rbp@0.8"]).collect()[0]
    p = 0.8
    assert r["rbp@0.8"] == pytest.approx((1 - p) * (1 + p ** 2 + p ** 3))
    assert r["rbp@0.8_res"] == pytest.approx((1 - p) * p + p ** 4)
    assert r["rbp@0.8"] + r["rbp@0.8_res"] <= 1 + 1e-12
