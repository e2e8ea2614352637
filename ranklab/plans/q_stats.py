"""Registered comparison, significance, CV and report queries
(T1-T7, C1-C5, V1-V7, W9-W10, U1-U2, J5, J8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as ST
from ..operators import compare as CMP
from ..operators import cv as CV
from ..operators import rank as RK
from ..operators import reports as RP
from ..operators import select as SEL
from . import views as V
from .catalog import r6, register

_EV = ("evals",)


@register("paired_ttest", """
WITH x AS (SELECT metric, qid, value AS a FROM evals WHERE system = 'a'),
     y AS (SELECT metric, qid, value AS b FROM evals WHERE system = 'b'),
     p AS (SELECT * FROM x JOIN y USING (metric, qid)),
     s AS (SELECT metric, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b,
                  stddev_samp(a) AS sd_a, stddev_samp(b) AS sd_b,
                  avg(b - a) AS md, stddev_samp(b - a) AS sdd FROM p GROUP BY metric)
SELECT metric, n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
       round(CASE WHEN sdd > 0 THEN -md / (sdd / sqrt(n)) END, 6) AS t,
       round((mean_a - mean_b) / sqrt(((n - 1) * sd_a * sd_a + (n - 1) * sd_b * sd_b) / (2 * n - 2)), 6) AS cohen_d
FROM s
""", _EV)
def paired_ttest(spark, sf_dir):
    """T1 + T4 + J5: paired t statistic and Cohen's d, system a vs b."""
    out = ST.paired_ttest(V.evals(spark, sf_dir), "a", "b", with_p=False)
    return out.select("metric", "n", r6("mean_a").alias("mean_a"), r6("mean_b").alias("mean_b"),
                      r6("t").alias("t"), r6("cohen_d").alias("cohen_d"))


def _beta_sql(a: str, b: str, x: str) -> str:
    """I_x(a, b) as 2 / B(a, b) times the integral of sin^(2a - 1) cos^(2b - 1) from 0
    to asin(sqrt(x)), by Simpson's rule: not the fraction that Spark sums."""
    step = f"(asin(sqrt({x})) / 4000)"
    f = f"pow(sin(i * {step}), 2 * ({a}) - 1) * pow(cos(i * {step}), 2 * ({b}) - 1)"
    w = "CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"2 * exp(lgamma(({a}) + ({b})) - lgamma({a}) - lgamma({b})) * {step} / 3 * list_sum(list_transform(range(0, 4001), lambda i: {w} * {f}))"


_PAIR_TESTS_SQL = f"""
WITH p AS (SELECT x.metric, x.system AS sys_a, y.system AS sys_b, x.value AS a, y.value AS b
           FROM evals x JOIN evals y ON x.metric = y.metric AND x.qid = y.qid AND x.system < y.system),
     s AS (SELECT metric, sys_a, sys_b, count(*) AS n, avg(b - a) AS md, stddev_samp(b - a) AS sdd FROM p GROUP BY ALL),
     t AS (SELECT *, CASE WHEN sdd > 0 THEN -md / (sdd / sqrt(n)) END AS t FROM s),
     v AS (SELECT *, CASE WHEN t IS NOT NULL THEN {_beta_sql("(n - 1) / 2.0", "0.5", "(n - 1) / (n - 1 + t * t)")} END AS p,
                  count(*) OVER (PARTITION BY metric) AS m FROM t),
     h AS (SELECT *, least(1.0, (m - row_number() OVER (PARTITION BY metric ORDER BY p NULLS LAST, sys_a, sys_b) + 1) * p) AS step FROM v),
     j AS (SELECT *, max(step) OVER (PARTITION BY metric ORDER BY p NULLS LAST, sys_a, sys_b) AS holm, least(1.0, m * p) AS bonferroni FROM h)
"""


@register("ttest_pvalues", _PAIR_TESTS_SQL + """
SELECT metric, sys_a, sys_b, n, round(t, 6) AS t, round(p, 6) AS p, round(holm, 6) AS p_adj, holm < 0.05 AS reject FROM j
""", _EV)
def ttest_pvalues(spark, sf_dir):
    """T1 p-values and T3 all-pairs tests with Holm correction."""
    ev = V.evals(spark, sf_dir)
    return ST.all_pairs_ttest(ev, "holm", 0.05).select(
        "metric", "sys_a", "sys_b", "n", r6("t").alias("t"), r6("p").alias("p"), r6("p_adj").alias("p_adj"), "reject")


@register("ttest_bonferroni", _PAIR_TESTS_SQL + """
SELECT metric, sys_a, sys_b, round(p, 6) AS p, round(bonferroni, 6) AS p_adj, bonferroni < 0.01 AS reject FROM j
""", _EV)
def ttest_bonferroni(spark, sf_dir):
    """T3 with Bonferroni correction at 0.01."""
    out = ST.all_pairs_ttest(V.evals(spark, sf_dir), "bonferroni", 0.01)
    return out.select("metric", "sys_a", "sys_b", r6("p").alias("p"), r6("p_adj").alias("p_adj"), "reject")


@register("anova_f", """
WITH g AS (SELECT metric, system, count(*) AS ni, avg(value) AS mi, var_samp(value) AS vi FROM evals GROUP BY metric, system),
     t AS (SELECT metric, avg(value) AS m, count(*) AS nn FROM evals GROUP BY metric),
     s AS (SELECT g.metric, sum(ni * (mi - m) * (mi - m)) AS ssb, sum(coalesce((ni - 1) * vi, 0)) AS ssw,
                  count(*) AS k, max(nn) AS nn FROM g JOIN t USING (metric) GROUP BY g.metric)
SELECT metric, k, nn AS "N", round((ssb / (k - 1)) / (ssw / (nn - k)), 6) AS "F" FROM s
""", _EV)
def anova_f(spark, sf_dir):
    """One-way ANOVA F over the three systems per metric."""
    out = ST.one_way_anova(V.evals(spark, sf_dir))
    return out.select("metric", "k", "N", r6("F").alias("F"))


# t(0.975) by bisection of x = d / (d + t * t) per degree of freedom d.
_CRIT_SQL = f"""bi AS (SELECT d, 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM (SELECT DISTINCT n - 1 AS d FROM st) q
       UNION ALL
       SELECT d, i + 1, CASE WHEN above THEN lo ELSE mid END, CASE WHEN above THEN mid ELSE hi END
       FROM (SELECT *, {_beta_sql("d / 2.0", "0.5", "mid")} > 0.05 AS above FROM (SELECT *, (lo + hi) / 2 AS mid FROM bi WHERE i < 50) y) z),
     cr AS (SELECT d, sqrt(d * (1 - hi) / hi) AS c FROM bi WHERE i = 50)"""


@register("anova_confint", f"""
WITH RECURSIVE st AS (SELECT system, metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM evals GROUP BY system, metric),
     {_CRIT_SQL},
     t AS (SELECT metric, avg(value) AS m, count(*) AS nn FROM evals GROUP BY metric),
     a AS (SELECT metric, count(*) AS k, max(nn) AS nn, sum(n * (mean - m) * (mean - m)) AS ssb, sum((n - 1) * sd * sd) AS ssw FROM st JOIN t USING (metric) GROUP BY metric),
     f AS (SELECT *, (ssb / (k - 1)) / (ssw / (nn - k)) AS f FROM a),
     pv AS (SELECT metric, {_beta_sql("(nn - k) / 2.0", "(k - 1) / 2.0", "(nn - k) / (nn - k + (k - 1) * f)")} AS p FROM f)
SELECT system, metric, round(mean, 6) AS mean, round(mean - c * sd / sqrt(n), 6) AS lo, round(mean + c * sd / sqrt(n), 6) AS hi, round(p, 6) AS anova_p
FROM st JOIN cr ON cr.d = st.n - 1 JOIN pv USING (metric)
""", _EV)
def anova_confint(spark, sf_dir):
    """T2 p-values and T5 confidence intervals of the means."""
    ev = V.evals(spark, sf_dir)
    ci = ST.confint_mean(ev, 0.05).select("system", "metric", r6("value_mean").alias("mean"),
                                          r6("value_lo").alias("lo"), r6("value_hi").alias("hi"))
    p = ST.one_way_anova(ev).select("metric", r6("p").alias("anova_p"))
    return ci.join(p, "metric")


@register("diff_confint", f"""
WITH RECURSIVE st AS (SELECT x.metric, count(*) AS n, avg(x.value - y.value) AS mean, stddev_samp(x.value - y.value) AS sd
            FROM evals x JOIN evals y ON x.metric = y.metric AND x.qid = y.qid WHERE x.system = 'a' AND y.system = 'c' GROUP BY x.metric),
     {_CRIT_SQL}
SELECT metric, n, round(mean, 6) AS mean, round(mean - c * sd / sqrt(n), 6) AS lo, round(mean + c * sd / sqrt(n), 6) AS hi
FROM st JOIN cr ON cr.d = st.n - 1
""", _EV)
def diff_confint(spark, sf_dir):
    """T5: confidence interval of the paired difference of systems a and c."""
    d = ST.diff_confint(V.evals(spark, sf_dir), "a", "c")
    return d.select("metric", "n", r6("value_mean").alias("mean"), r6("value_lo").alias("lo"), r6("value_hi").alias("hi"))


@register("win_tie_loss", """
WITH b AS (SELECT metric, qid, value AS a FROM evals WHERE system = 'a')
SELECT e.system, e.metric,
       CAST(count_if(e.value - b.a > b.a * 0.1) AS BIGINT) AS win,
       CAST(count_if(NOT (e.value - b.a > b.a * 0.1) AND NOT (b.a - e.value > b.a * 0.1)) AS BIGINT) AS tie,
       CAST(count_if(b.a - e.value > b.a * 0.1) AS BIGINT) AS loss
FROM evals e JOIN b ON b.metric = e.metric AND b.qid = e.qid
WHERE e.system <> 'a' GROUP BY e.system, e.metric
""", _EV)
def win_tie_loss(spark, sf_dir):
    """win/tie/loss against system a with threshold 0.1."""
    return CMP.win_tie_loss(V.evals(spark, sf_dir), "a", 0.1)


@register("above_below_same", """
WITH b AS (SELECT metric, qid, value AS a FROM evals WHERE system = 'a')
SELECT e.system, e.metric, CAST(count_if(e.value > b.a) AS BIGINT) AS above, CAST(count_if(e.value < b.a) AS BIGINT) AS below,
       CAST(count_if(e.value = b.a) AS BIGINT) AS same
FROM evals e JOIN b ON b.metric = e.metric AND b.qid = e.qid
WHERE e.system <> 'a' GROUP BY e.system, e.metric
""", _EV)
def above_below_same(spark, sf_dir):
    """T7."""
    return CMP.above_below_same(V.evals(spark, sf_dir), "a")


_CV_SQL = """
WITH e AS MATERIALIZED (SELECT 'model=' || system AS params, metric, qid, value FROM evals),
     f AS (SELECT qid, ntile(5) OVER (ORDER BY qid) AS fold FROM (SELECT DISTINCT qid FROM e) q),
     ef AS MATERIALIZED (SELECT * FROM e JOIN f USING (qid)),
     pf AS (SELECT params, metric, fold, sum(value) AS s, count(*) AS n FROM ef GROUP BY params, metric, fold),
     tot AS (SELECT params, metric, sum(s) AS ss, sum(n) AS nn FROM pf GROUP BY params, metric),
     tr AS (SELECT pf.params, pf.metric, pf.fold, (ss - s) / (nn - n) AS train_mean FROM pf JOIN tot USING (params, metric)),
     best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric, fold ORDER BY train_mean DESC, params) AS rn
                             FROM tr) b WHERE rn = 1),
     chosen AS MATERIALIZED (SELECT ef.metric, ef.qid, ef.fold, ef.params, best.train_mean, ef.value
                FROM ef JOIN best ON best.metric = ef.metric AND best.fold = ef.fold AND best.params = ef.params)
"""


def _cv_evals(spark, sf_dir):
    return V.evals(spark, sf_dir).withColumn("params", F.concat(F.lit("model="), F.col("system"))).drop("system")


@register("cv_folds", _CV_SQL + """
SELECT metric, qid, fold, params, round(train_mean, 6) AS train_mean, round(value, 6) AS value FROM chosen
""", _EV)
def cv_folds(spark, sf_dir):
    """5 contiguous folds over the queries (= ntile); per fold and metric
    the setting with the best training mean is applied to the test queries."""
    out = CV.cv_auto(_cv_evals(spark, sf_dir), k=5)
    return out.select("metric", "qid", "fold", "params", r6("train_mean").alias("train_mean"), r6("value").alias("value"))


@register("cv_report", _CV_SQL + """,
     by_nd AS (SELECT qid, fold, params FROM chosen WHERE metric = 'ndcg_cut_10')
SELECT b.fold, b.params, round(avg(CASE WHEN e.metric = 'P_10' THEN e.value END), 6) AS "P_10",
       round(avg(CASE WHEN e.metric = 'ndcg_cut_10' THEN e.value END), 6) AS ndcg_cut_10
FROM e JOIN by_nd b ON b.qid = e.qid AND b.params = e.params
GROUP BY b.fold, b.params
""", _EV)
def cv_report(spark, sf_dir):
    """C4: under the settings chosen for ndcg_cut_10, every metric's mean per
    fold; C3's selection of rows by chosen setting is the same join."""
    ev = _cv_evals(spark, sf_dir)
    chosen = CV.cv_auto(ev, k=5)
    rep = CV.cv_report(chosen, ev, "ndcg_cut_10")
    return rep.select("fold", "params", r6("P_10").alias("P_10"), r6("ndcg_cut_10").alias("ndcg_cut_10"))


@register("cv_compose_run", _CV_SQL + """
SELECT c.qid, r.did, r.score, c.params
FROM chosen c JOIN runs r ON r.qid = c.qid AND 'model=' || r.system = c.params
WHERE c.metric = 'P_10'
""", ("evals", "runs"))
def cv_compose_run(spark, sf_dir):
    """Stitch each test query's run lines from the setting chosen for P_10."""
    chosen = CV.cv_auto(_cv_evals(spark, sf_dir), k=5)
    runs = V.runs(spark, sf_dir).withColumn("params", F.concat(F.lit("model="), F.col("system")))
    return CV.cv_compose_run(chosen, runs, "P_10").select("qid", "did", "score", "params")


@register("eval_wide", """
SELECT system, qid, round(max(CASE WHEN metric = 'P_10' THEN value END), 6) AS "P_10",
       round(max(CASE WHEN metric = 'ndcg_cut_10' THEN value END), 6) AS ndcg_cut_10
FROM evals GROUP BY system, qid
""", _EV)
def eval_wide(spark, sf_dir):
    """V1: one column per metric."""
    w = RP.eval_wide(V.evals(spark, sf_dir), ["P_10", "ndcg_cut_10"])
    return w.select("system", "qid", r6("P_10").alias("P_10"), r6("ndcg_cut_10").alias("ndcg_cut_10"))


@register("delta_table", """
WITH b AS (SELECT qid, value AS bv FROM evals WHERE system = 'a' AND metric = 'ndcg_cut_10'),
     d AS (SELECT e.system, e.qid, e.value - b.bv AS delta FROM evals e JOIN b USING (qid)
           WHERE e.metric = 'ndcg_cut_10' AND e.system <> 'a')
SELECT system, qid, round(delta, 6) AS delta, CASE WHEN delta < 0 THEN 'Bad' ELSE 'Good' END AS flag,
       row_number() OVER (PARTITION BY system ORDER BY round(delta, 9) DESC, qid) AS position
FROM d
""", _EV)
def delta_table(spark, sf_dir):
    """V2: per-query NDCG@10 difference to system a, flagged and ordered."""
    d = RP.delta_table(V.evals(spark, sf_dir), "a", "ndcg_cut_10")
    return d.select("system", "qid", r6("delta").alias("delta"), "flag", "position")


@register("value_histogram", """
WITH e AS (SELECT system, value FROM evals WHERE metric = 'ndcg_cut_10'),
     mm AS (SELECT system, min(value) AS lo, max(value) AS hi FROM e GROUP BY system),
     b AS (SELECT e.system, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / ((hi - lo) / 10)), 9) END AS INTEGER) AS bin,
                  lo, hi FROM e JOIN mm USING (system))
SELECT system, bin, round(lo + bin * ((hi - lo) / 10), 6) AS "left", round(lo + (bin + 1) * ((hi - lo) / 10), 6) AS "right",
       count(*) AS count, round(CASE WHEN hi > lo THEN count(*) / ((hi - lo) / 10) END, 4) AS frequency
FROM b GROUP BY system, bin, lo, hi
""", _EV)
def value_histogram(spark, sf_dir):
    """V3: 10 equal-width bins of NDCG@10 per system, counts and frequency (count / width)."""
    ev = V.evals(spark, sf_dir).where(F.col("metric") == "ndcg_cut_10")
    h = RP.value_histogram(ev, "value", 10, ("system",), "frequency")
    return h.select("system", "bin", r6("left").alias("left"), r6("right").alias("right"), "count", F.round("frequency", 4).alias("frequency"))


@register("percentiles", """
WITH q AS (SELECT system, metric, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
                  quantile_cont(value, 0.9) AS p90 FROM evals GROUP BY system, metric),
  b AS (SELECT e.system, e.metric, CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / ((hi - lo) / 10)), 9) END AS bin, count(*) AS c
        FROM evals e JOIN q USING (system, metric) GROUP BY ALL),
  l AS (SELECT system, metric, lo, hi, unnest([25, 50, 90]) AS p, unnest([p25, p50, p90]) AS v FROM q),
  h AS (SELECT l.system, l.metric, p, v, coalesce(c, 0) AS c FROM l LEFT JOIN b ON b.system = l.system AND b.metric = l.metric
        AND b.bin = CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 10)), 9) END)
SELECT system, metric, round(max(v) FILTER (p = 25), 6) AS p25, round(max(v) FILTER (p = 50), 6) AS p50, round(max(v) FILTER (p = 90), 6) AS p90,
       max(c) FILTER (p = 25) AS h25, max(c) FILTER (p = 50) AS h50, max(c) FILTER (p = 90) AS h90
FROM h GROUP BY system, metric
""", _EV)
def percentiles(spark, sf_dir):
    """V4: exact percentiles per system and metric, and the heights of their bins."""
    p = RP.percentile_annotations(V.evals(spark, sf_dir), "value", [25, 50, 90], ("system", "metric"))
    return p.select("system", "metric", r6("p25").alias("p25"), r6("p50").alias("p50"), r6("p90").alias("p90"), "h25", "h50", "h90")


@register("box_outliers", """
WITH q AS (SELECT system, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM evals GROUP BY system, metric)
SELECT e.system, e.metric, e.qid, round(e.value, 6) AS value, CASE WHEN e.value < q1 THEN 'low' ELSE 'high' END AS side
FROM evals e JOIN q USING (system, metric)
WHERE NOT (e.value >= q1 - 1.5 * (q3 - q1) AND e.value <= q3 + 1.5 * (q3 - q1))
""", _EV)
def box_outliers(spark, sf_dir):
    """V7: the values beyond the whiskers, per system and metric."""
    return RP.box_outliers(V.evals(spark, sf_dir)).select("system", "metric", "qid", r6("value").alias("value"), "side")


@register("box_stats", """
WITH q AS (SELECT system, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM evals GROUP BY system, metric),
     j AS (SELECT e.*, q1, median, q3, e.value >= q1 - 1.5 * (q3 - q1) AND e.value <= q3 + 1.5 * (q3 - q1) AS inside
           FROM evals e JOIN q USING (system, metric))
SELECT system, metric, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(CASE WHEN inside THEN value END), 6) AS whisker_lo, round(max(CASE WHEN inside THEN value END), 6) AS whisker_hi,
       CAST(count_if(NOT inside) AS BIGINT) AS n_outliers
FROM j GROUP BY system, metric, q1, median, q3
""", _EV)
def box_stats(spark, sf_dir):
    """V7."""
    b = RP.box_stats(V.evals(spark, sf_dir))
    return b.select("system", "metric", r6("q1").alias("q1"), r6("median").alias("median"), r6("q3").alias("q3"),
                    r6("whisker_lo").alias("whisker_lo"), r6("whisker_hi").alias("whisker_hi"), "n_outliers")


@register("score_distribution", """
WITH j AS (SELECT r.system, CAST(r.score AS DOUBLE) AS score, CASE WHEN coalesce(q.rel, 0) > 0 THEN 1 ELSE 0 END AS rel
           FROM runs r LEFT JOIN qrels q ON q.qid = r.qid AND q.did = r.did),
     mm AS (SELECT system, rel, min(score) AS lo, max(score) AS hi, count(*) AS n FROM j GROUP BY system, rel),
     b AS (SELECT j.system, j.rel, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((score - lo) / ((hi - lo) / 10)), 9) END AS INTEGER) AS bin,
                  lo, hi, n FROM j JOIN mm USING (system, rel))
SELECT system, rel, bin, round(lo + bin * ((hi - lo) / 10), 6) AS "left", round(lo + (bin + 1) * ((hi - lo) / 10), 6) AS "right",
       count(*) AS count, round(count(*) / max(n), 6) AS probability
FROM b GROUP BY system, rel, bin, lo, hi
""", ("runs", "qrels"))
def score_distribution(spark, sf_dir):
    """V5: score histograms per system x binary grade (probability)."""
    h = RP.score_distribution_by_rel(V.runs(spark, sf_dir), V.qrels(spark, sf_dir), 10, True)
    return h.select("system", "rel", "bin", r6("left").alias("left"), r6("right").alias("right"), "count",
                    r6("probability").alias("probability"))


@register("rank_flow", """
WITH r AS (SELECT system, qid, did, row_number() OVER (PARTITION BY system, qid ORDER BY score DESC, CAST(did AS VARCHAR) DESC) AS rank
           FROM runs),
     w AS (SELECT qid, did, max(CASE WHEN system = 'a' THEN rank END) AS a, max(CASE WHEN system = 'b' THEN rank END) AS b,
                  max(CASE WHEN system = 'c' THEN rank END) AS c FROM r WHERE rank <= 10 GROUP BY qid, did)
SELECT a, b, c, count(*) AS count FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY a, b, c
""", ("runs",))
def rank_flow(spark, sf_dir):
    """V6 + J3: documents in the top 10 of all three systems, counted per
    tuple of ranks."""
    out = RP.rank_flow(V.runs(spark, sf_dir), 10, ("a", "b", "c"))
    return out.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"),
                      F.col("c").cast("bigint").alias("c"), "count")


@register("sort_systems", """
WITH m AS (SELECT system, metric, avg(value) AS value FROM evals GROUP BY system, metric)
SELECT system, round(value, 6) AS value, row_number() OVER (ORDER BY value DESC, system) AS position
FROM m WHERE metric = 'ndcg_cut_10'
""", _EV)
def sort_systems(spark, sf_dir):
    """W9 + G13: systems ordered by mean NDCG@10."""
    from ..functions.metrics import eval_mean
    mean = eval_mean(V.evals(spark, sf_dir).withColumn("residual", F.lit(None).cast("double")))
    out = RK.sort_systems(mean, "ndcg_cut_10")
    return out.select("system", r6("value").alias("value"), "position")


@register("order_queries_by_base", """
WITH one AS (SELECT * FROM evals WHERE metric = 'P_10'),
     b AS (SELECT qid, value AS base_value, row_number() OVER (ORDER BY value DESC, qid) AS position FROM one WHERE system = 'a')
SELECT one.system, one.qid, round(one.value, 6) AS value, round(b.base_value, 6) AS base_value, b.position
FROM one JOIN b USING (qid)
""", _EV)
def order_queries_by_base(spark, sf_dir):
    """Every system's per-query P@10, queries in the base's order."""
    out = RK.order_queries_by_base(V.evals(spark, sf_dir), "a", "P_10")
    return out.select("system", "qid", r6("value").alias("value"), r6("base_value").alias("base_value"), "position")


@register("common_queries", """
WITH per AS (SELECT metric, qid, count(DISTINCT system) AS c FROM evals WHERE NOT (system = 'c' AND qid IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)) GROUP BY metric, qid),
     ns AS (SELECT metric, count(DISTINCT system) AS n FROM evals GROUP BY metric)
SELECT metric, CAST(count_if(c = n) AS BIGINT) AS n_common, count(*) AS n_union FROM per JOIN ns USING (metric) GROUP BY metric
""", _EV + ("runs",))
def common_queries(spark, sf_dir):
    """Queries evaluated for every system (system c lacks the queries of
    suppliers with a negative balance here)."""
    neg = V.table(spark, sf_dir, "supplier").where(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("qid"))
    ev = V.evals(spark, sf_dir)
    drop = ev.where(F.col("system") == "c").join(neg, "qid", "left_semi")
    ev = ev.join(drop.select("system", "metric", "qid"), ["system", "metric", "qid"], "left_anti")
    return SEL.common_queries(ev)


@register("system_pairs", """
SELECT x.system AS sys_a, y.system AS sys_b
FROM (SELECT DISTINCT system FROM evals) x JOIN (SELECT DISTINCT system FROM evals) y ON x.system < y.system
""", _EV)
def system_pairs(spark, sf_dir):
    """Unordered pairs of systems."""
    return CMP.all_pairs(V.evals(spark, sf_dir))


@register("delta_overlapped", """
WITH b AS (SELECT qid, value AS bv FROM evals WHERE system = 'a' AND metric = 'ndcg_cut_10'),
     d AS (SELECT e.system, e.qid, e.value - b.bv AS delta FROM evals e JOIN b USING (qid)
           WHERE e.metric = 'ndcg_cut_10' AND e.system <> 'a'),
     nz AS (SELECT system, qid, abs(delta) AS delta, CASE WHEN delta < 0 THEN 'Bad' ELSE 'Good' END AS flag
            FROM d WHERE delta <> 0)
SELECT system, qid, round(delta, 6) AS delta, flag,
       row_number() OVER (PARTITION BY system, flag ORDER BY round(delta, 9) DESC, qid) AS position
FROM nz
""", _EV)
def delta_overlapped(spark, sf_dir):
    """V2 overlapped + P14: zero deltas dropped, absolute values, position
    within each Good/Bad flag."""
    d = RP.delta_table(V.evals(spark, sf_dir), "a", "ndcg_cut_10", overlapped=True)
    return d.select("system", "qid", r6("delta").alias("delta"), "flag", "position")


@register("common_metrics", """
WITH e AS (SELECT system, metric FROM evals WHERE NOT (system = 'c' AND metric = 'P_10')),
     n AS (SELECT count(DISTINCT system) AS n FROM e)
SELECT metric, 'common' AS kind, CAST(NULL AS VARCHAR) AS system FROM e GROUP BY metric
HAVING count(DISTINCT system) = (SELECT n FROM n)
UNION ALL
SELECT DISTINCT metric, 'other' AS kind, system FROM e
WHERE metric NOT IN (SELECT metric FROM e GROUP BY metric HAVING count(DISTINCT system) = (SELECT n FROM n))
""", _EV)
def common_metrics(spark, sf_dir):
    """Metrics present for every system (system c reports no P_10 here),
    and per system the ones disregarded."""
    ev = V.evals(spark, sf_dir).where(~((F.col("system") == "c") & (F.col("metric") == "P_10")))
    common, other = SEL.common_metrics(ev)
    return common.select("metric", F.lit("common").alias("kind"), F.lit(None).cast("string").alias("system")) \
        .unionByName(other.select("metric", F.lit("other").alias("kind"), "system"))


@register("concat_describe_runs", """
SELECT system, count(DISTINCT qid) AS n_queries, count(*) AS n_rows FROM runs GROUP BY system
""", ("runs",))
def concat_describe_runs(spark, sf_dir):
    """U3 + G14: three runs stacked under system names, then described."""
    frames = {s: V.run(spark, sf_dir, s) for s in ("a", "b", "c")}
    stacked = SEL.concat_systems(frames)
    return stacked.groupBy("system").agg(F.count_distinct("qid").alias("n_queries"), F.count("*").alias("n_rows"))


@register("params_cv_manual", """
WITH e AS MATERIALIZED (SELECT 'model=' || system AS params, metric, qid, value FROM evals),
     f AS (SELECT qid, ntile(5) OVER (ORDER BY qid) AS fold FROM (SELECT DISTINCT qid FROM e) q),
     p AS (SELECT 'cv/' || e.params || '-k=10_fold=' || CAST(f.fold AS VARCHAR) || '.eval' AS path, e.metric, e.qid, e.value,
                  f.fold FROM e JOIN f USING (qid)),
     parsed AS (SELECT regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1) AS stem, * FROM p),
     toks AS (SELECT *, regexp_extract_all(stem, '([^-_/]+=[^-_/]+)', 1) AS t FROM parsed),
     pf AS (SELECT array_to_string(list_filter(t, lambda x: NOT starts_with(x, 'fold=')), '-') AS params,
                   split_part(list_filter(t, lambda x: starts_with(x, 'fold='))[1], '=', 2) AS fold, metric, qid, value FROM toks),
     tm AS (SELECT fold, metric, params, avg(value) AS train_mean FROM pf p2
            GROUP BY fold, metric, params),
     best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, metric ORDER BY train_mean DESC, params) AS rn
                             FROM tm) b WHERE rn = 1)
SELECT pf.metric, pf.qid, pf.fold, pf.params, round(best.train_mean, 6) AS train_mean, round(pf.value, 6) AS value
FROM pf JOIN best USING (fold, metric, params)
""", _EV)
def params_cv_manual(spark, sf_dir):
    """S16 + C2: settings and folds parsed from evaluation file paths
    (``model=a-k=10_fold=3.eval``); per fold the best setting by its mean
    picks the reported values (here train = test files of the fold)."""
    ev = V.evals(spark, sf_dir).withColumn("params", F.concat(F.lit("model="), F.col("system")))
    folds = CV.assign_folds(ev.select("qid"), 5)
    p = ev.join(folds, "qid").withColumn(
        "path", F.concat(F.lit("cv/"), F.col("params"), F.lit("-k=10_fold="), F.col("fold").cast("string"), F.lit(".eval")))
    params, fold = CV.params_from_path(F.col("path"))
    pf = p.select(params.alias("params"), fold.alias("fold"), "metric", "qid", "value")
    out = CV.cv_manual(pf, pf)
    return out.select("metric", "qid", "fold", "params", r6("train_mean").alias("train_mean"), r6("value").alias("value"))


@register("load_grid", """
WITH grid AS (SELECT 'model=' || s AS params FROM (VALUES ('a'), ('b'), ('c'), ('d')) t(s)),
     e AS (SELECT 'model=' || system AS params, metric, qid, value FROM evals)
SELECT g.params, count(e.qid) AS n_rows, count(e.qid) = 0 AS missing FROM grid g LEFT JOIN e USING (params) GROUP BY g.params
""", _EV)
def load_grid(spark, sf_dir):
    """C5 + J6: evaluations of every setting of a grid (model a..d; d was
    never run) and the missing settings."""
    from ..operators.select import sweep_grid
    grid = sweep_grid(params=[f"model={s}" for s in "abcd"])
    ev = V.evals(spark, sf_dir).withColumn("params", F.concat(F.lit("model="), F.col("system")))
    found, missing = CV.load_grid(grid, ev)
    n = found.groupBy("params").agg(F.count("*").alias("n_rows"))
    return grid.join(n, "params", "left").join(missing.withColumn("missing", F.lit(True)), "params", "left") \
        .select("params", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("missing", F.lit(False)).alias("missing"))
