"""Registered evaluation queries (M1-M15, G13, J1) on the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import compare
from . import views as V
from .catalog import r6, register

# Ranked and judged rows of all three systems, trec_eval tie rule
# (score descending, document id as text descending).
RANKED_SQL = """ranked AS (
  SELECT r.system, r.qid, r.did, q.rel,
         row_number() OVER (PARTITION BY r.system, r.qid
                            ORDER BY r.score DESC, CAST(r.did AS VARCHAR) DESC) AS rank
  FROM runs r LEFT JOIN qrels q ON r.qid = q.qid AND r.did = q.did)"""

IDEAL_SQL = """ideal AS (
  SELECT qid,
         sum(CASE WHEN rn <= {k} THEN rel / log2(rn + 1.0) ELSE 0 END) AS idcg_lin,
         sum(CASE WHEN rn <= {k} THEN (power(2.0, rel) - 1) / log2(rn + 1.0) ELSE 0 END) AS idcg_exp,
         sum(rel / log2(rn + 1.0)) AS idcg_all,
         count(*) AS nrel
  FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, did) AS rn
        FROM qrels WHERE rel > 0) t
  GROUP BY qid)"""


def _wide(spark, sf_dir, measures, tie="docno_desc"):
    return M.evaluate_wide(V.runs(spark, sf_dir), V.qrels(spark, sf_dir), measures, tie)


def flagship(spark, sf_dir):
    """M7 + M8: gdeval NDCG@20 and ERR@20 per system and topic; like gdeval,
    only topics with a positive grade are scored."""
    w = _wide(spark, sf_dir, ["gdeval_ndcg@20", "gdeval_err@20"]).where(F.col("`gdeval_ndcg@20`").isNotNull())
    return w.select("system", "qid", r6("gdeval_ndcg@20").alias("ndcg20"), r6("gdeval_err@20").alias("err20"))


register("gdeval_ndcg_err", """
WITH {ranked},
{ideal},
per AS (
  SELECT system, qid,
    sum(CASE WHEN rank <= 20 THEN (power(2.0, greatest(coalesce(rel, 0), 0)) - 1) / log2(rank + 1.0) ELSE 0 END) AS dcg,
    sum(CASE WHEN rank <= 20 THEN
          (power(2.0, greatest(coalesce(rel, 0), 0)) - 1) / 16.0 / rank
          * exp(coalesce(lnd, 0)) ELSE 0 END) AS err
  FROM (SELECT *, sum(ln(1 - (power(2.0, greatest(coalesce(rel, 0), 0)) - 1) / 16.0))
                    OVER (PARTITION BY system, qid ORDER BY rank
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lnd
        FROM ranked) x
  GROUP BY system, qid)
SELECT system, qid, round(CASE WHEN idcg_exp > 0 THEN dcg / idcg_exp ELSE 0 END, 6) AS ndcg20,
       round(err, 6) AS err20
FROM per JOIN ideal USING (qid)
""".format(ranked=RANKED_SQL, ideal=IDEAL_SQL.format(k=20)), ("runs", "qrels"))(flagship)


@register("trec_measures", """
WITH {ranked},
{ideal},
hits AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END)
                 OVER (PARTITION BY system, qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h
         FROM ranked),
per AS (
  SELECT system, qid,
    sum(CASE WHEN rank <= 10 AND rel > 0 THEN 1 ELSE 0 END) / 10.0 AS p10,
    coalesce(max(CASE WHEN rel > 0 THEN 1.0 / rank END), 0) AS rr,
    coalesce(max(CASE WHEN rank <= 10 AND rel > 0 THEN 1.0 / rank END), 0) AS rr10,
    sum(CASE WHEN rel > 0 THEN h / rank ELSE 0 END) AS ap_s,
    sum(CASE WHEN rank <= 100 AND rel > 0 THEN h / rank ELSE 0 END) AS ap100_s,
    sum(CASE WHEN rank <= 10 THEN greatest(coalesce(rel, 0), 0) / log2(rank + 1.0) ELSE 0 END) AS dcg10,
    sum(greatest(coalesce(rel, 0), 0) / log2(rank + 1.0)) AS dcg_all
  FROM hits GROUP BY system, qid),
judged AS (SELECT qid, count_if(rel > 0) AS nrel FROM qrels GROUP BY qid)
SELECT system, qid, round(p10, 6) AS p_10, round(rr, 6) AS recip_rank, round(rr10, 6) AS recip_rank_cut_10,
       round(CASE WHEN j.nrel > 0 THEN ap_s / j.nrel ELSE 0 END, 6) AS map,
       round(CASE WHEN j.nrel > 0 THEN ap100_s / j.nrel ELSE 0 END, 6) AS map_cut_100,
       round(CASE WHEN coalesce(i.idcg_lin, 0) > 0 THEN dcg10 / i.idcg_lin ELSE 0 END, 6) AS ndcg_cut_10,
       round(CASE WHEN coalesce(i.idcg_all, 0) > 0 THEN dcg_all / i.idcg_all ELSE 0 END, 6) AS ndcg
FROM per JOIN judged j USING (qid) LEFT JOIN ideal i USING (qid)
""".format(ranked=RANKED_SQL, ideal=IDEAL_SQL.format(k=10)), ("runs", "qrels"))
def trec_measures(spark, sf_dir):
    ms = ["P_10", "recip_rank", "recip_rank_cut_10", "map", "map_cut_100", "ndcg_cut_10", "ndcg"]
    w = _wide(spark, sf_dir, ms)
    return w.select("system", "qid", r6("P_10").alias("p_10"), r6("recip_rank").alias("recip_rank"),
                    r6("recip_rank_cut_10").alias("recip_rank_cut_10"), r6("map").alias("map"),
                    r6("map_cut_100").alias("map_cut_100"), r6("ndcg_cut_10").alias("ndcg_cut_10"),
                    r6("ndcg").alias("ndcg"))


@register("cut_measures_topk", """
WITH {ranked},
{ideal},
hits AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END)
                 OVER (PARTITION BY system, qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h
         FROM ranked),
per AS (
  SELECT system, qid,
    sum(CASE WHEN rank <= 5 AND rel > 0 THEN 1 ELSE 0 END) / 5.0 AS p5,
    coalesce(max(CASE WHEN rank <= 5 AND rel > 0 THEN 1.0 / rank END), 0) AS rr5,
    sum(CASE WHEN rank <= 20 AND rel > 0 THEN h / rank ELSE 0 END) AS ap20_s,
    sum(CASE WHEN rank <= 20 THEN greatest(coalesce(rel, 0), 0) / log2(rank + 1.0) ELSE 0 END) AS dcg20
  FROM hits GROUP BY system, qid),
judged AS (SELECT qid, count_if(rel > 0) AS nrel FROM qrels GROUP BY qid)
SELECT system, qid, round(p5, 6) AS p_5, round(rr5, 6) AS recip_rank_cut_5,
       round(CASE WHEN j.nrel > 0 THEN ap20_s / j.nrel ELSE 0 END, 6) AS map_cut_20,
       round(CASE WHEN coalesce(i.idcg_lin, 0) > 0 THEN dcg20 / i.idcg_lin ELSE 0 END, 6) AS ndcg_cut_20
FROM per JOIN judged j USING (qid) LEFT JOIN ideal i USING (qid)
""".format(ranked=RANKED_SQL, ideal=IDEAL_SQL.format(k=20)), ("runs", "qrels"))
def cut_measures_topk(spark, sf_dir):
    """All measures cut: the plan keeps at most 20 rows per list before the
    shuffle (WindowGroupLimit)."""
    ms = ["P_5", "recip_rank_cut_5", "map_cut_20", "ndcg_cut_20"]
    w = _wide(spark, sf_dir, ms)
    return w.select("system", "qid", r6("P_5").alias("p_5"), r6("recip_rank_cut_5").alias("recip_rank_cut_5"),
                    r6("map_cut_20").alias("map_cut_20"), r6("ndcg_cut_20").alias("ndcg_cut_20"))


@register("rbp_residual", """
WITH {ranked}
SELECT system, qid,
  round(sum(CASE WHEN rel >= 1 THEN 0.5 * power(0.5, rank - 1) ELSE 0 END), 6) AS rbp_50,
  round(sum(CASE WHEN rel IS NULL THEN 0.5 * power(0.5, rank - 1) ELSE 0 END) + power(0.5, count(*)), 6) AS rbp_50_res,
  round(sum(CASE WHEN rel >= 2 THEN 0.2 * power(0.8, rank - 1) ELSE 0 END), 6) AS rbp_80,
  round(sum(CASE WHEN rel IS NULL THEN 0.2 * power(0.8, rank - 1) ELSE 0 END) + power(0.8, count(*)), 6) AS rbp_80_res,
  round(sum(CASE WHEN rel >= 1 THEN (1 - 0.95) * power(0.95, rank - 1) ELSE 0 END), 6) AS rbp_95,
  round(sum(CASE WHEN rel IS NULL THEN (1 - 0.95) * power(0.95, rank - 1) ELSE 0 END) + power(0.95, count(*)), 6) AS rbp_95_res
FROM ranked WHERE qid IN (SELECT qid FROM qrels)
GROUP BY system, qid
""".format(ranked=RANKED_SQL), ("runs", "qrels"))
def rbp_residual(spark, sf_dir):
    ms = ["rbp@0.5", "rbp@0.8:2", "rbp@0.95"]
    w = _wide(spark, sf_dir, ms)
    return w.select("system", "qid", r6("`rbp@0.5`").alias("rbp_50"), r6("`rbp@0.5_res`").alias("rbp_50_res"),
                    r6("`rbp@0.8:2`").alias("rbp_80"), r6("`rbp@0.8:2_res`").alias("rbp_80_res"),
                    r6("`rbp@0.95`").alias("rbp_95"), r6("`rbp@0.95_res`").alias("rbp_95_res"))


@register("library_metrics", """
WITH {ranked},
nz AS (SELECT *, sum(CASE WHEN coalesce(rel, 0) <> 0 THEN 1 ELSE 0 END)
                 OVER (PARTITION BY system, qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h
       FROM ranked),
per AS (
  SELECT system, qid,
    sum(CASE WHEN coalesce(rel, 0) <> 0 THEN h / rank ELSE 0 END) AS ap_s,
    count_if(coalesce(rel, 0) <> 0) AS c,
    max(CASE WHEN coalesce(rel, 0) <> 0 THEN rank END) AS last_rel,
    sum(CASE WHEN rank <= 10 THEN (CASE WHEN rank = 1 THEN coalesce(rel, 0) ELSE coalesce(rel, 0) / log2(rank) END) ELSE 0 END) AS dcg10_m0,
    sum(CASE WHEN rank <= 10 THEN coalesce(rel, 0) / log2(rank + 1.0) ELSE 0 END) AS dcg10_m1
  FROM nz GROUP BY system, qid),
best AS (
  SELECT system, qid,
    sum(CASE WHEN rn = 1 THEN g ELSE g / log2(rn) END) AS i_m0,
    sum(g / log2(rn + 1.0)) AS i_m1
  FROM (SELECT system, qid, coalesce(rel, 0) AS g,
               row_number() OVER (PARTITION BY system, qid ORDER BY coalesce(rel, 0) DESC, did) AS rn
        FROM ranked) b
  WHERE rn <= 10 GROUP BY system, qid)
SELECT system, qid,
  round(CASE WHEN c > 0 THEN ap_s / c ELSE 0 END, 6) AS ap_retrieved,
  round(CASE WHEN c > 0 THEN c / last_rel ELSE 0 END, 6) AS rprec_lib,
  round(dcg10_m0, 6) AS dcg10_m0,
  round(CASE WHEN i_m1 <> 0 THEN dcg10_m1 / i_m1 ELSE 0 END, 6) AS ndcg10_m1,
  round(CASE WHEN i_m0 <> 0 THEN dcg10_m0 / i_m0 ELSE 0 END, 6) AS ndcg10_m0
FROM per JOIN best USING (system, qid)
WHERE qid IN (SELECT qid FROM qrels)
""".format(ranked=RANKED_SQL), ("runs", "qrels"))
def library_metrics(spark, sf_dir):
    ms = ["ap_retrieved", "rprec_lib", "dcg_lib@10:0", "ndcg_lib@10:1", "ndcg_lib@10:0"]
    w = _wide(spark, sf_dir, ms)
    return w.select("system", "qid", r6("ap_retrieved").alias("ap_retrieved"), r6("rprec_lib").alias("rprec_lib"),
                    r6("`dcg_lib@10:0`").alias("dcg10_m0"), r6("`ndcg_lib@10:1`").alias("ndcg10_m1"),
                    r6("`ndcg_lib@10:0`").alias("ndcg10_m0"))


@register("evaluate_mean", """
WITH {ranked},
{ideal},
per AS (
  SELECT system, qid,
    sum(CASE WHEN rank <= 10 AND rel > 0 THEN 1 ELSE 0 END) / 10.0 AS p10,
    sum(CASE WHEN rank <= 10 THEN greatest(coalesce(rel, 0), 0) / log2(rank + 1.0) ELSE 0 END) AS dcg10
  FROM ranked GROUP BY system, qid),
long AS (
  SELECT system, 'P_10' AS metric, qid, p10 AS value FROM per WHERE qid IN (SELECT qid FROM qrels)
  UNION ALL
  SELECT system, 'ndcg_cut_10' AS metric, qid,
         CASE WHEN coalesce(i.idcg_lin, 0) > 0 THEN dcg10 / i.idcg_lin ELSE 0 END AS value
  FROM per LEFT JOIN ideal i USING (qid) WHERE qid IN (SELECT qid FROM qrels))
SELECT system, metric, round(avg(value), 6) AS value, count(*) AS n_topics FROM long GROUP BY system, metric
""".format(ranked=RANKED_SQL, ideal=IDEAL_SQL.format(k=10)), ("runs", "qrels"))
def evaluate_mean(spark, sf_dir):
    """M14 + G13: long per-query table, then the `all` row per metric."""
    long = M.evaluate(V.runs(spark, sf_dir), V.qrels(spark, sf_dir), ["P_10", "ndcg_cut_10"])
    mean = M.eval_mean(long)
    return mean.select("system", "metric", r6("value").alias("value"), "n_topics")


@register("risk_sensitive_ndcg", """
WITH {ranked},
{ideal},
per AS (
  SELECT system, qid,
    sum(CASE WHEN rank <= 20 THEN (power(2.0, greatest(coalesce(rel, 0), 0)) - 1) / log2(rank + 1.0) ELSE 0 END) AS dcg
  FROM ranked GROUP BY system, qid),
nd AS (SELECT system, qid, CASE WHEN idcg_exp > 0 THEN dcg / idcg_exp ELSE 0 END AS v FROM per JOIN ideal USING (qid)),
b AS (SELECT qid, v AS bv FROM nd WHERE system = 'a')
SELECT system, qid,
  round(CASE WHEN v < coalesce(bv, 0) THEN (1 + 2.0) * (v - coalesce(bv, 0)) ELSE v - coalesce(bv, 0) END, 6) AS value
FROM nd LEFT JOIN b USING (qid) WHERE system <> 'a'
""".format(ranked=RANKED_SQL, ideal=IDEAL_SQL.format(k=20)), ("runs", "qrels"))
def risk_sensitive_ndcg(spark, sf_dir):
    """M9: gdeval NDCG@20 of b and c relative to baseline a, alpha = 2."""
    long = M.evaluate(V.runs(spark, sf_dir), V.qrels(spark, sf_dir), ["gdeval_ndcg@20"])
    rs = M.risk_sensitive(long, "a", 2.0)
    return rs.select("system", "qid", r6("value").alias("value"))


@register("topic_set_all", """
WITH {ranked},
per AS (
  SELECT system, qid, sum(CASE WHEN rank <= 10 AND rel > 0 THEN 1 ELSE 0 END) / 10.0 AS v
  FROM ranked WHERE rank <= 10 GROUP BY system, qid),
topics AS (SELECT DISTINCT qid FROM qrels),
systems AS (SELECT DISTINCT system FROM per)
SELECT s.system, round(avg(coalesce(p.v, 0)), 6) AS value, count(*) AS n_topics
FROM systems s CROSS JOIN topics t LEFT JOIN per p ON p.system = s.system AND p.qid = t.qid
GROUP BY s.system
""".format(ranked=RANKED_SQL.replace(
    "FROM runs r", "FROM (SELECT * FROM runs WHERE qid IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) r")),
    ("runs", "qrels"))
def topic_set_all(spark, sf_dir):
    """Mean over ALL judged topics; a topic missing from a system's run
    scores 0. The systems here only answer queries of suppliers with a
    positive balance, so judged topics of the others are missing."""
    solvent = V.table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("qid"))
    run = V.runs(spark, sf_dir).join(solvent, "qid", "left_semi")
    long = M.evaluate(run, V.qrels(spark, sf_dir), ["P_10"], topics="qrels")
    return long.groupBy("system").agg(r6(F.avg("value")).alias("value"), F.count("*").alias("n_topics"))


@register("rbo_grid", """
WITH la AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CAST(did AS VARCHAR) DESC) AS ra,
                   count(*) OVER (PARTITION BY qid) AS na FROM run_a),
     lc AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CAST(did AS VARCHAR) DESC) AS rc,
                   count(*) OVER (PARTITION BY qid) AS nc FROM run_c),
     dims AS (SELECT DISTINCT la.qid, na, nc FROM la JOIN lc ON la.qid = lc.qid),
     grid AS (SELECT * FROM (VALUES (10, 0.8), (10, 1.0), (100, 0.9), (100, 1.0)) g(k, p)),
     kd AS (SELECT dims.qid, g.k AS kk, g.p, least(na, nc, g.k) AS depth FROM dims CROSS JOIN grid g),
     shared AS (SELECT la.qid, greatest(ra, rc) AS m FROM la JOIN lc ON la.qid = lc.qid AND la.did = lc.did),
     overlap AS (SELECT kd.qid, kd.kk, kd.p, kd.depth, d.d, count(s.m) AS x
                 FROM kd, generate_series(1, kd.depth) AS d(d)
                 LEFT JOIN shared s ON s.qid = kd.qid AND s.m <= d.d
                 GROUP BY kd.qid, kd.kk, kd.p, kd.depth, d.d),
     per AS (SELECT qid, kk, p,
                    CASE WHEN p = 1.0 THEN sum(x / d) / max(depth)
                         ELSE sum((1 - p) * power(p, d - 1) * x / d)
                              + max(CASE WHEN d = depth THEN x / d * power(p, depth) END) END AS rbo
             FROM overlap GROUP BY qid, kk, p),
     topics AS (SELECT qid FROM run_a UNION SELECT qid FROM run_c)
SELECT g.k, g.p, round(avg(coalesce(per.rbo, 0)), 6) AS rbo
FROM topics t CROSS JOIN grid g LEFT JOIN per ON per.qid = t.qid AND per.kk = g.k AND per.p = g.p
GROUP BY g.k, g.p
""", ("run_a", "run_c"))
def rbo_grid(spark, sf_dir):
    """M15 + J4: rank-biased overlap of run_c against run_a for a k x p grid,
    mean over the union of queries (missing on one side = 0)."""
    base = V.run(spark, sf_dir, "a")
    other = V.run(spark, sf_dir, "c")
    out = compare.rbo(base, other, ks=[10, 100], ps=[0.8, 1.0, 0.9])
    out = out.where(((F.col("k") == 10) & F.col("p").isin(0.8, 1.0)) | ((F.col("k") == 100) & F.col("p").isin(0.9, 1.0)))
    return out.select(F.col("k").cast("int").alias("k"), F.col("p").cast("double").alias("p"), r6("rbo").alias("rbo"))


@register("label_run", """
SELECT r.qid, r.did, r.score, coalesce(q.rel, 0) AS rel
FROM run_a r LEFT JOIN qrels q ON r.qid = q.qid AND r.did = q.did
""", ("run_a", "qrels"))
def label_run(spark, sf_dir):
    """Grade per retrieved document, 0 when unjudged."""
    from ..operators import select as S
    return S.label_run(V.run(spark, sf_dir, "a"), V.qrels(spark, sf_dir), default=0)
