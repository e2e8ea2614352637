"""Edge cases that an ordinary input reaches: nothing is lost, nothing aborts."""
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ranklab.functions import arrays as A
from ranklab.functions import metrics as M
from ranklab.functions import stats as ST
from ranklab.functions import text as X
from ranklab.operators import cv, fusion, groups, rank, reports, select
from ranklab.sinks import formats as K
from ranklab.sources import formats as S

RUN = "qid int, vid string, did int, score double"
SCORES = "qid int, vid string, vscore double"
QRELS = "qid int, did int, rel int"


def variant_run(spark):
    rows = [(1, "1", d, 10.0 - d) for d in range(6)] + [(1, "1-a", d, 10.0 - d) for d in range(3, 9)] + [(1, "1-b", 42, 1.0)]
    rows += [(2, "2", d, 9.0 - d) for d in range(8)]
    rows += [(3, "3", 7, 1.0), (3, "3-a", 8, 1.0)]
    return spark.createDataFrame(rows, RUN)


def test_single_variant_keeps_its_whole_list(spark):
    out = fusion.fuse_variants(variant_run(spark), spark.createDataFrame([], SCORES), depth=3)
    got = [(r.did, r.rank, r.score) for r in out.where("qid = 2").orderBy("rank").collect()]
    assert got == [(d, d + 1, 9.0 - d) for d in range(8)]


def test_unscored_variants_stay(spark):
    scores = spark.createDataFrame([(1, "1", 0.5), (1, "1-a", 0.4)], SCORES)
    out = fusion.fuse_variants(variant_run(spark), scores)
    assert {r.did for r in out.where("qid = 1").collect()} == {*range(9), 42}
    assert {r.did for r in out.where("qid = 3").collect()} == {7, 8}


def test_cutoff_and_weights_without_forced_original(spark):
    scores = spark.createDataFrame([(1, "1", 0.1), (1, "1-a", 2.0), (1, "1-b", 1.0), (3, "3", 1.0), (3, "3-a", 2.0)], SCORES)
    one = fusion.fuse_variants(variant_run(spark), scores, cutoff=1, weighted=True)
    assert {r.did for r in one.where("qid = 1").collect()} == set(range(3, 9))
    assert one.where("qid = 3").first().score == pytest.approx(1 / 61)
    two = fusion.fuse_variants(variant_run(spark), scores, cutoff=2, weighted=True).where("qid = 1 and did = 42").first()
    assert two.score == pytest.approx(1 / (1 + math.e) / 61)


def test_queries_without_judgments_keep_a_fused_list(spark):
    scores = spark.createDataFrame([(1, "1", 3.0), (1, "1-a", 2.0), (1, "1-b", 1.0), (3, "3", 1.0), (3, "3-a", 2.0)], SCORES)
    qrels = spark.createDataFrame([(1, 42, 2)], QRELS)
    greedy = fusion.fuse_greedy(variant_run(spark), scores, qrels)
    assert {r.qid for r in greedy.collect()} == {1, 2, 3}
    assert greedy.where("qid = 2").count() == 8
    assert [r.did for r in greedy.where("qid = 3").collect()] == [8]          # the shortest prefix
    best = fusion.fuse_optimal(variant_run(spark), scores, qrels, return_vids=True)
    assert {r.qid for r in best.collect()} == {1, 2, 3}
    assert best.where("qid = 1").first().vids == ["1-b"]


def test_simplex_holds_only_vectors_that_sum_up(spark):
    g = fusion.simplex_weights(spark, ["a", "b", "c", "d", "e", "f"], 0.1)
    per = g.groupBy("weights").agg(F.sum("weight").alias("s"), F.count("*").alias("n")).collect()
    assert len(per) == math.comb(15, 5) and all(r.n == 6 and r.s == pytest.approx(1) for r in per)


def test_several_run_files_are_several_systems(spark, tmp_path):
    for name, score in (("one.run", 9.5), ("two.run", 7.5)):
        (tmp_path / name).write_text(f"1 Q0 http://x/#a 1 {score} t\n1 Q0 http://x/#b 2 1.5 t\n1-x Q0 d 0 1 t\n1 d9 0\nbad line\n")
    paths = [str(tmp_path / n) for n in ("one.run", "two.run")]
    run = S.read_runs(spark, paths)
    assert {(r.system, r.did, r.score) for r in run.where("vid = '1' and score is not null").collect()} == {
        ("one", "http://x/#a", 9.5), ("one", "http://x/#b", 1.5), ("two", "http://x/#a", 7.5), ("two", "http://x/#b", 1.5)}
    assert run.where("did = 'd9'").count() == 2                               # rank 0: no score, no abort
    assert {r.system for r in S.read_runs(spark, paths, ["A", "B"]).collect()} == {"A", "B"}
    assert [r.value for r in S.bad_run_lines(S.read_lines(spark, paths)).collect()] == ["bad line"] * 2


def test_odd_lines_don_t_abort(spark):
    csv = spark.createDataFrame([("runid,topic,ndcg@20,err@20",), ("",), ("r,1,0.5,0.25",), ("r,amean,0.5,0.25",)], "value string")
    assert S.parse_gdeval(csv).count() == 2
    q = spark.createDataFrame([("1\tsome text",), ("no separator",)], "value string")
    assert [(r.qid, r.text) for r in S.parse_queries(q).collect()] == [("1", "some text"), ("no separator", None)]


def test_pairs_keep_both_labels(spark):
    t = spark.createDataFrame([(1, "d1", "d2"), (1, "d2", "d3"), (1, "d1", "d2")], "id int, pos string, neg string")
    got = sorted((r.doc, r.label) for r in groups.pairs_to_list(t).collect())
    assert got == [("d1", 1), ("d2", 0), ("d2", 1), ("d3", 0)]


def test_large_k_is_split(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), "id")
    for k in (1000, 1001):
        assert rank.top_k(df, ["g"], [F.col("id").desc()], k).agg(F.min("id"), F.max("rank")).first() == (5000 - k, k)
    hot = rank.rank_rows(df, ["g"], [F.col("id").desc()], hot_rows=100).where(F.col("rank") <= 1001)
    assert hot.count() == 1001
    plan = rank.top_k(df, [], [F.col("id")], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" in plan


def test_tails_of_distributions(spark):
    from test_stats import value
    assert value(spark, ST.f_pvalue, 1.0, 1e8, 1e8) == pytest.approx(0.5, abs=1e-4)
    assert value(spark, ST.f_pvalue, 1.0, 1e5, 1e5) == pytest.approx(0.5, abs=1e-6)
    assert value(spark, ST.t_crit, 0.25, 10) == pytest.approx(-0.6998, abs=1e-4)
    assert value(spark, ST.t_crit, 0.975, 10) == pytest.approx(2.2281, abs=1e-4)
    assert value(spark, ST.t_pvalue, 2.0, 5) == pytest.approx(0.10194, abs=1e-5)
    assert value(spark, ST.betainc, 2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-12)


def test_equal_systems_have_no_t(spark):
    ev = spark.createDataFrame([(s, "m", str(q), 0.1 * q) for s in "ab" for q in range(5)], "system string, metric string, qid string, value double")
    r = ST.paired_ttest(ev, "a", "b").first()
    assert r.t is None and r.cohen_d == 0.0 and (r.p is None or math.isnan(r.p))
    flat = ev.withColumn("value", F.lit(0.5))
    assert ST.paired_ttest(flat, "a", "b").first().cohen_d is None
    assert ST.one_way_anova(flat).first().F is None


def test_setting_seen_in_one_fold_only(spark):
    rows = [("x", "m", str(q), 0.5) for q in range(4)] + [("y", "m", "0", 0.9)]
    out = cv.cv_auto(spark.createDataFrame(rows, "params string, metric string, qid string, value double"), k=2)
    assert {r.params for r in out.collect()} <= {"x", "y"} and out.count() >= 4


def test_path_without_fold(spark):
    p, fold = cv.params_from_path(F.col("p"))
    df = spark.createDataFrame([("/a/mu=10-k=3.eval",), ("/a/mu=10-fold=2.eval",)], "p string").select(p.alias("p"), fold.alias("f"))
    assert [(r.p, r.f) for r in df.collect()] == [("mu=10-k=3", "all"), ("mu=10", "2")]


def test_empty_array_is_padded_with_nothing(spark):
    df = spark.createDataFrame([([],), ([1, 2],)], "a array<int>")
    assert [r.x for r in df.select(A.pad_repeat_last(F.col("a"), 4).alias("x")).collect()] == [[], [1, 2, 2, 2]]


def test_grades_above_the_ceiling_stop_the_job(spark):
    run = spark.createDataFrame([(1, 1, 3.0), (1, 2, 2.0)], "qid int, did int, score double")
    ok = M.evaluate_wide(run, spark.createDataFrame([(1, 1, 4)], QRELS), ["gdeval_err@20"])
    assert ok.first()["gdeval_err@20"] == pytest.approx(15 / 16)
    with pytest.raises(PySparkException):
        M.evaluate_wide(run, spark.createDataFrame([(1, 1, 5)], QRELS), ["gdeval_err@20"]).collect()


def test_leaf_against_subtree_is_a_conflict(spark):
    good = spark.createDataFrame([("a/b", "1"), ("a/c", "2"), ("a/b", "1")], "path string, value string")
    assert groups.merge_nested(good).count() == 2
    for rows in ([("a", "1"), ("a/b", "2")], [("a/b", "1"), ("a/b", "2")]):
        with pytest.raises(PySparkException):
            groups.merge_nested(spark.createDataFrame(rows, "path string, value string")).collect()


def test_sessions_need_a_following_character(spark):
    df = spark.createDataFrame([("s12-3",), ("s12",), ("-x",)], "q string").select(select.session_id(F.col("q")).alias("s"))
    assert [r.s for r in df.collect()] == ["s12", None, None]


def test_texts_without_words_stay(spark):
    df = spark.createDataFrame([(1, "Some words here."), (2, "12 34!"), (3, "")], "did int, text string")
    out = {r.did: r for r in X.readability(df, "did").collect()}
    assert set(out) == {1, 2, 3} and out[2].fk_grade is None and out[1].fk_grade is not None


def test_stop_words_go_by_surface_form(spark):
    df = spark.createDataFrame([(1, ["does", "cats"])], "k int, tokens array<string>")
    lex = spark.createDataFrame([("does", "doe"), ("cats", "cat")], "token string, lemma string")
    out = X.normalize_tokens(df, "k", "tokens", lexicon=lex, stopwords=spark.createDataFrame([("does",)], "term string"))
    assert out.first().tokens == ["cat"]


def test_rbp_lines_carry_the_residual(spark):
    ev = spark.createDataFrame([("rbp_0.80@10", "1", 0.5, 0.25), ("rbp_0.80@10", "2", 0.25, 0.75)], "metric string, qid string, value double, residual double")
    lines = sorted(r.value for r in K.format_eval(ev, "rbp").collect())
    assert lines == ["p= 0.80 q= 1 d= 10 rbp= 0.5000 +0.2500", "p= 0.80 q= 2 d= 10 rbp= 0.2500 +0.7500", "p= 0.80 q= all d= 10 rbp= 0.3750 +0.5000"]


def test_frequency_is_per_unit_of_width(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (0, 1, 2, 10)], "system string, v double")
    h = {r.bin: r.frequency for r in reports.value_histogram(df, "v", 2, ("system",), "frequency").collect()}
    assert h == {0: 3 / 5, 1: 1 / 5}


def test_a_stream_resumes_at_its_location(spark, tmp_path):
    from ranklab.streaming import stream
    schema = "event_id long, event_type string"
    folder = tmp_path / "in"
    read = lambda: spark.readStream.schema(schema).parquet(str(folder))
    spark.createDataFrame([(1, "a")], schema).write.parquet(str(folder))
    assert stream.run_append(read(), "s", str(tmp_path / "run")).count() == 1
    spark.createDataFrame([(2, "b")], schema).write.mode("append").parquet(str(folder))
    got = stream.run_append(read(), "s", str(tmp_path / "run"))
    assert sorted(r.event_id for r in got.collect()) == [1, 2]           # the first file isn't read again
