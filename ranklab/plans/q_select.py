"""Registered selection, join and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rank as RK
from ..operators import select as S
from . import views as V
from .catalog import r6, register

_RANK = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, CAST(did AS VARCHAR) DESC)"


@register("rerank_run", f"SELECT qid, did, score, {_RANK} AS rank FROM run_c", ("run_c",))
def rerank_run(spark, sf_dir):
    """W1 on the tie-heavy run_c (ties by document id as text, descending)."""
    return RK.rerank(V.run(spark, sf_dir, "c"))


@register("first_n", f"SELECT * FROM (SELECT qid, did, score, {_RANK} AS rank FROM run_b) t WHERE rank <= 25",
          ("run_b",))
def first_n(spark, sf_dir):
    """Top 25 per query (WindowGroupLimit before the shuffle)."""
    return RK.first(V.run(spark, sf_dir, "b"), 25)


@register("select_by_ranks", f"""
SELECT qid, did, score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank
FROM (SELECT qid, did, score, {_RANK} AS rank FROM run_a) t WHERE rank IN (1, 3, 5, 10, 100, 1000)
""", ("run_a",))
def select_by_ranks(spark, sf_dir):
    """Keep ranks 1, 3, 5, 10, 100, 1000 then renumber (absent ranks skipped)."""
    return RK.select_by_ranks(V.run(spark, sf_dir, "a"), [1, 3, 5, 10, 100, 1000])


@register("nth_best_variant", """
WITH s AS (SELECT qid, vid, row_number() OVER (PARTITION BY qid ORDER BY vscore DESC, vid) AS r,
                  count(*) OVER (PARTITION BY qid) AS n FROM variant_scores),
     pick AS (SELECT qid, vid FROM s WHERE r = least(2, n))
SELECT v.qid, v.vid, v.did, v.score FROM variants v JOIN pick p ON p.qid = v.qid AND p.vid = v.vid
""", ("variants", "variant_scores"))
def nth_best_variant(spark, sf_dir):
    """The variant with the 2nd highest predicted score per query."""
    return RK.nth_best_variant(V.variants(spark, sf_dir), V.variant_scores(spark, sf_dir), 2) \
        .select("qid", "vid", "did", "score")


@register("oracle_run", """
SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, did) AS rank, CAST(rel AS DOUBLE) AS score
FROM qrels WHERE rel >= 1
""", ("qrels",))
def oracle_run(spark, sf_dir):
    """Ideal ranking from the judgments (grade as score)."""
    return RK.oracle_run(V.qrels(spark, sf_dir), 1, "rel")


@register("filter_oracle_run", f"""
WITH r AS (SELECT qid, did, score, {_RANK} AS rr FROM run_a),
     j AS (SELECT r.*, coalesce(q.rel, 0) AS rel FROM r LEFT JOIN qrels q ON q.qid = r.qid AND q.did = r.did),
     k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY least(rel, 2) DESC, rr) AS pick FROM j WHERE rel >= 0)
SELECT qid, did, score, row_number() OVER (PARTITION BY qid ORDER BY rr) AS rank, 'rel' || CAST(rel AS VARCHAR) AS tag
FROM k WHERE pick <= 20
""", ("run_a", "qrels"))
def filter_oracle_run(spark, sf_dir):
    """Per query the first 20 documents of grade >= 2 in run order,
    relaxed to 1 then 0 when too few."""
    return RK.filter_oracle_run(V.run(spark, sf_dir, "a"), V.qrels(spark, sf_dir), 20, 2)


@register("sort_by_relevance", f"""
WITH r AS (SELECT qid, did, score, {_RANK} AS orig_rank FROM run_a),
     j AS (SELECT r.*, q.rel FROM r LEFT JOIN qrels q ON q.qid = r.qid AND q.did = r.did)
SELECT qid, did, score, orig_rank, coalesce(rel, 0) AS rel,
       row_number() OVER (PARTITION BY qid ORDER BY coalesce(rel, 0) DESC, orig_rank) AS rank
FROM j
""", ("run_a", "qrels"))
def sort_by_relevance(spark, sf_dir):
    """W7 (after J1): stable sort by grade within each query."""
    labelled = V.run(spark, sf_dir, "a").join(V.qrels(spark, sf_dir), ["qid", "did"], "left")
    return RK.sort_by_relevance(labelled).select("qid", "did", "score", "orig_rank",
                                                 F.coalesce("rel", F.lit(0)).alias("rel"), "rank")


@register("queries_head_tail", """
SELECT 'head' AS part, qid, text FROM (SELECT * FROM queries ORDER BY qid LIMIT 10) h
UNION ALL
SELECT 'tail' AS part, qid, text FROM (SELECT * FROM queries ORDER BY qid OFFSET 10) t
""", ("queries",))
def queries_head_tail(spark, sf_dir):
    """First 10 queries, and the reference's tail(10) = all but the first 10."""
    q = V.queries(spark, sf_dir)
    return RK.head(q, 10, ["qid"]).withColumn("part", F.lit("head")).unionByName(
        RK.tail(q, 10, ["qid"]).withColumn("part", F.lit("tail"))).select("part", "qid", "text")


@register("filter_by_keys", """
SELECT r.* FROM run_a r WHERE r.did IN (SELECT p_partkey FROM part WHERE p_size > 25)
""", ("run_a",))
def filter_by_keys(spark, sf_dir):
    """Keep run rows whose document is in the allow list (large parts)."""
    keys = V.table(spark, sf_dir, "part").where(F.col("p_size") > 25).select("p_partkey")
    return S.filter_by_keys(V.run(spark, sf_dir, "a"), "did", keys)


@register("filter_spam", f"""
WITH r AS (SELECT qid, did, score, {_RANK} AS rank FROM run_a),
     k AS (SELECT r.* FROM r JOIN spam s ON s.did = r.did WHERE s.spam >= 40)
SELECT qid, did, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM k) t
WHERE n <= 100
""", ("run_a", "spam"))
def filter_spam(spark, sf_dir):
    """P2 + J7: drop documents with spam score < 40 (scores semi-joined to the
    run's documents), keep the first 100 per query; ranks unchanged."""
    run = RK.rerank(V.run(spark, sf_dir, "a"))
    return S.filter_spam(run, V.spam(spark, sf_dir), 40, 100).select("qid", "did", "score", "rank")


@register("original_and_variants", """
SELECT 'orig' AS part, count(*) AS n, count(DISTINCT qid) AS q FROM variants WHERE vid = CAST(qid AS VARCHAR)
UNION ALL
SELECT 'var' AS part, count(*) AS n, count(DISTINCT vid) AS q FROM variants WHERE vid <> CAST(qid AS VARCHAR)
""", ("variants",))
def original_and_variants(spark, sf_dir):
    """Original rows and variant rows."""
    v = V.variants(spark, sf_dir)
    o = S.select_original(v).agg(F.count("*").alias("n"), F.count_distinct("qid").alias("q")).withColumn("part", F.lit("orig"))
    x = S.select_variants(v).agg(F.count("*").alias("n"), F.count_distinct("vid").alias("q")).withColumn("part", F.lit("var"))
    return o.unionByName(x).select("part", "n", "q")


@register("select_by_vids", """
WITH want AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) || '-3' AS vid FROM supplier WHERE s_nationkey < 10),
     t AS (SELECT v.*, w.vid IS NOT NULL AS hit FROM variants v LEFT JOIN want w ON w.vid = v.vid),
     a AS (SELECT *, max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS anyhit FROM t)
SELECT qid, vid, did, score FROM a WHERE hit OR (anyhit = 0 AND vid = CAST(qid AS VARCHAR))
""", ("variants",))
def select_by_vids(spark, sf_dir):
    """Keep the listed variants (flag R of suppliers in nations < 10);
    other queries fall back to their original."""
    want = V.table(spark, sf_dir, "supplier").where(F.col("s_nationkey") < 10) \
        .select(F.concat(F.col("s_suppkey").cast("string"), F.lit("-3")).alias("vid"))
    return S.select_by_vids(V.variants(spark, sf_dir), want, True).select("qid", "vid", "did", "score")


@register("qrels_subsets", """
SELECT 'by_qids' AS part, count(*) AS n FROM qrels WHERE qid IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL
SELECT 'min_relevant' AS part, count(*) AS n FROM qrels
WHERE qid IN (SELECT qid FROM qrels GROUP BY qid HAVING count_if(rel <> 0) >= 150)
""", ("qrels",))
def qrels_subsets(spark, sf_dir):
    """P5 + P6: judgments of selected queries; of queries with >= 150 nonzero grades."""
    q = V.qrels(spark, sf_dir)
    qids = V.table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 5000).select(F.col("s_suppkey").alias("qid"))
    a = S.select_qrels_by_qids(q, qids).agg(F.count("*").alias("n")).withColumn("part", F.lit("by_qids"))
    b = S.select_qrels_by_n_relevant(q, 150, "min").agg(F.count("*").alias("n")).withColumn("part", F.lit("min_relevant"))
    return a.unionByName(b).select("part", "n")


@register("relevant_doc_counts", """
SELECT qid, count(*) AS n_docs FROM qrels WHERE rel > 0 GROUP BY qid
""", ("qrels",))
def relevant_doc_counts(spark, sf_dir):
    """Relevant documents per query (the per-document direction is the
    same aggregation keyed by did)."""
    return S.relevant_doc_counts(V.qrels(spark, sf_dir))[0]


@register("binarized_histogram", """
SELECT CASE WHEN rel >= 2 THEN 1 ELSE 0 END AS rel, count(*) AS count FROM qrels GROUP BY 1
""", ("qrels",))
def binarized_histogram(spark, sf_dir):
    """P9 + G15: grades binarised at 2, then rows per grade."""
    from ..operators.groups import rel_histogram
    return rel_histogram(S.binarize_rel(V.qrels(spark, sf_dir), 2))


@register("remove_tail", """
WITH q AS (SELECT system, metric, quantile_cont(value, 0.9) AS q FROM evals GROUP BY system, metric)
SELECT e.system, e.metric, e.qid, round(e.value, 6) AS value FROM evals e JOIN q USING (system, metric)
WHERE e.value < q.q AND e.metric IN ('ndcg_cut_10')
""", ("evals",))
def remove_tail(spark, sf_dir):
    """P10 + P11: keep one metric, drop values at or above the 90th percentile."""
    ev = S.project_metrics(V.evals(spark, sf_dir), ["ndcg_cut_10"])
    out = S.remove_tail(ev, "value", 90, ["system", "metric"])
    return out.select("system", "metric", "qid", r6("value").alias("value"))


@register("session_ids", """
SELECT vid, nullif(regexp_extract(vid, '^([a-zA-Z0-9]+)[^a-zA-Z0-9]', 1), '') AS session, count(*) AS n FROM variants GROUP BY 1, 2
""", ("variants",))
def session_ids(spark, sf_dir):
    """Session id of each variant id (leading alphanumerics)."""
    v = V.variants(spark, sf_dir)
    return v.groupBy("vid", S.session_id(F.col("vid")).alias("session")).agg(F.count("*").alias("n"))


@register("append_missing_relevant", f"""
WITH r AS (SELECT qid, did, score, {_RANK} AS rank FROM run_a),
     agg AS (SELECT qid, max(score) AS score, min(rank) AS rank FROM r GROUP BY qid),
     miss AS (SELECT q.qid, q.did, a.score, a.rank, q.rel FROM qrels q JOIN agg a ON a.qid = q.qid
              WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.qid = q.qid AND r.did = q.did))
SELECT r.qid, r.did, r.score, r.rank, coalesce(q.rel, 0) AS rel FROM r LEFT JOIN qrels q ON q.qid = r.qid AND q.did = r.did
UNION ALL SELECT * FROM miss
""", ("run_a", "qrels"))
def append_missing_relevant(spark, sf_dir):
    """run_a plus every judged document it missed (with the query's max score
    and min rank)."""
    run = RK.rerank(V.run(spark, sf_dir, "a"))
    out = S.append_missing_relevant(run, V.qrels(spark, sf_dir))
    return out.withColumn("rel", F.coalesce("rel", F.lit(0)))


@register("pooled_docs", """
SELECT qid, count(*) AS n_pooled FROM (SELECT DISTINCT qid, did FROM variants) t GROUP BY qid
""", ("variants",))
def pooled_docs(spark, sf_dir):
    """U4: pool of documents per query over all variant lists."""
    return S.pooled_docs(V.variants(spark, sf_dir)).groupBy("qid").agg(F.count("*").alias("n_pooled"))
