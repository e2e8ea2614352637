"""Registered fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion as FU
from . import views as V
from .catalog import r6, register

_LIST = """row_number() OVER (PARTITION BY {part} ORDER BY score DESC, CAST(did AS VARCHAR) DESC)"""


@register("rrf_fusion", f"""
WITH lists AS (SELECT system, qid, did, {_LIST.format(part="system, qid")} AS r
               FROM runs WHERE system IN ('a', 'c')),
fused AS (SELECT qid, did, sum(1.0 / (60 + r)) AS score FROM lists WHERE r <= 100 GROUP BY qid, did),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did) AS rank FROM fused)
SELECT qid, did, rank, round(score, 6) AS score FROM ranked WHERE rank <= 100
""", ("runs",))
def rrf_fusion(spark, sf_dir):
    """RRF of systems a and c, k = 60, depth 100."""
    runs = V.runs(spark, sf_dir, ("a", "c"))
    out = FU.fuse_rrf(runs, k=60, depth=100)
    return out.select("qid", "did", "rank", r6("score").alias("score"))


@register("rrf_weighted", f"""
WITH w AS (SELECT * FROM (VALUES ('a', 0.75), ('b', 0.25)) t(system, weight)),
lists AS (SELECT system, qid, did, {_LIST.format(part="system, qid")} AS r
          FROM runs WHERE system IN ('a', 'b')),
fused AS (SELECT qid, did, sum(w.weight / (10 + r)) AS score FROM lists JOIN w USING (system)
          WHERE r <= 50 GROUP BY qid, did),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did) AS rank FROM fused)
SELECT qid, did, rank, round(score, 6) AS score FROM ranked WHERE rank <= 50
""", ("runs",))
def rrf_weighted(spark, sf_dir):
    """F1 with weights (a 0.75, b 0.25), k = 10, depth 50."""
    runs = V.runs(spark, sf_dir, ("a", "b"))
    w = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "system string, weight double")
    out = FU.fuse_rrf(runs, k=10, depth=50, weights=w)
    return out.select("qid", "did", "rank", r6("score").alias("score"))


@register("linear_fusion", """
WITH w AS (SELECT * FROM (VALUES ('a', 0.25), ('c', 0.75)) t(system, weight)),
r AS (SELECT * FROM runs WHERE system IN ('a', 'c')),
mins AS (SELECT system, qid, min(score) AS mn FROM r GROUP BY system, qid),
pool AS (SELECT DISTINCT qid, did FROM r),
grid AS (SELECT p.qid, p.did, m.system, m.mn FROM pool p JOIN mins m ON m.qid = p.qid),
fused AS (SELECT g.qid, g.did, sum(w.weight * coalesce(r.score, g.mn)) AS score
          FROM grid g JOIN w ON w.system = g.system
          LEFT JOIN r ON r.system = g.system AND r.qid = g.qid AND r.did = g.did
          GROUP BY g.qid, g.did)
SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did) AS rank,
       round(score, 5) AS score
FROM fused
""", ("runs",))
def linear_fusion(spark, sf_dir):
    """F2: weighted sum (a 0.25, c 0.75); a missing document counts the
    run's minimum score for that query."""
    runs = V.runs(spark, sf_dir, ("a", "c"))
    w = spark.createDataFrame([("a", 0.25), ("c", 0.75)], "system string, weight double")
    return FU.fuse_linear(runs, w)


@register("linear_sweep", """
WITH g AS (SELECT CAST(i * 0.25 AS DOUBLE) AS wa, CAST(1 - i * 0.25 AS DOUBLE) AS wc FROM range(0, 5) t(i)),
r AS (SELECT * FROM runs WHERE system IN ('a', 'c')),
mins AS (SELECT system, qid, min(score) AS mn FROM r GROUP BY system, qid),
pool AS (SELECT DISTINCT qid, did FROM r),
x AS (SELECT p.qid, p.did,
             coalesce(ra.score, (SELECT mn FROM mins WHERE system = 'a' AND qid = p.qid)) AS xa,
             coalesce(rc.score, (SELECT mn FROM mins WHERE system = 'c' AND qid = p.qid)) AS xc
      FROM pool p LEFT JOIN r ra ON ra.system = 'a' AND ra.qid = p.qid AND ra.did = p.did
                  LEFT JOIN r rc ON rc.system = 'c' AND rc.qid = p.qid AND rc.did = p.did),
fused AS (SELECT CAST(wa AS VARCHAR) || '_' || CAST(wc AS VARCHAR) AS weights, qid, did,
                 wa * xa + wc * xc AS score FROM x CROSS JOIN g)
SELECT weights, qid, did, row_number() OVER (PARTITION BY weights, qid ORDER BY round(score, 12) DESC, did) AS rank,
       round(score, 5) AS score
FROM fused
""", ("runs",))
def linear_sweep(spark, sf_dir):
    """linear fusion of a and c for every weight pair on the simplex in
    steps of 0.25 (exact binary fractions)."""
    runs = V.runs(spark, sf_dir, ("a", "c"))
    return FU.fuse_linear_sweep(runs, ["a", "c"], step=0.25)


_VARIANT_LISTS = f"""lists AS (SELECT qid, vid, did, {_LIST.format(part="qid, vid")} AS r FROM variants)"""


@register("variant_fusion", f"""
WITH {_VARIANT_LISTS},
fused AS (SELECT qid, did, sum(1.0 / (60 + r)) AS score FROM lists WHERE r <= 100 GROUP BY qid, did),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did) AS rank FROM fused)
SELECT qid, did, rank, round(score, 6) AS score FROM ranked WHERE rank <= 100
""", ("variants",))
def variant_fusion(spark, sf_dir):
    """unit-weight RRF over all variants of each query (depth 100)."""
    out = FU.fuse_variants(V.variants(spark, sf_dir), V.variant_scores(spark, sf_dir), depth=100)
    return out.select("qid", "did", "rank", r6("score").alias("score"))


@register("variant_fusion_weighted", f"""
WITH {_VARIANT_LISTS},
vs AS (SELECT qid, vid, vscore, vid = CAST(qid AS VARCHAR) AS is_orig,
              row_number() OVER (PARTITION BY qid, vid = CAST(qid AS VARCHAR) ORDER BY vscore DESC, vid) AS pos
       FROM variant_scores),
sel AS (SELECT * FROM vs WHERE is_orig OR pos <= 1),
ex AS (SELECT qid, vid, is_orig, exp(vscore - max(vscore) OVER (PARTITION BY qid)) AS z FROM sel),
sm AS (SELECT qid, vid, is_orig, z / sum(z) OVER (PARTITION BY qid) AS w0 FROM ex),
wt AS (SELECT qid, vid, CASE WHEN is_orig THEN 0.6 ELSE w0 * (1 - 0.6) END AS weight FROM sm),
fused AS (SELECT l.qid, l.did, sum(wt.weight / (60 + l.r)) AS score
          FROM lists l JOIN wt ON wt.qid = l.qid AND wt.vid = l.vid WHERE l.r <= 100 GROUP BY l.qid, l.did),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did) AS rank FROM fused)
SELECT qid, did, rank, round(score, 6) AS score FROM ranked WHERE rank <= 100
""", ("variants", "variant_scores"))
def variant_fusion_weighted(spark, sf_dir):
    """F4 with the original forced in: best other variant (cutoff 2),
    softmax weights over predicted scores, original's weight 0.6."""
    out = FU.fuse_variants(V.variants(spark, sf_dir), V.variant_scores(spark, sf_dir), weighted=True,
                           always_include_orig=True, cutoff=2, orig_weight=0.6, depth=100)
    return out.select("qid", "did", "rank", r6("score").alias("score"))


def _candidate_sql(cands: str, size: str) -> str:
    return f"""
WITH {_VARIANT_LISTS},
vs AS MATERIALIZED (SELECT qid, vid, row_number() OVER (PARTITION BY qid ORDER BY vscore DESC, vid) AS vpos
       FROM variant_scores WHERE (qid, vid) IN (SELECT qid, vid FROM variants)),
nv AS MATERIALIZED (SELECT qid, max(vpos) AS n FROM vs GROUP BY qid),
cands AS MATERIALIZED ({cands}),
cl AS MATERIALIZED (SELECT c.qid, c.cand, l.vid, l.did, l.r FROM cands c JOIN lists l ON l.qid = c.qid AND l.vid = c.vid WHERE l.r <= 100),
fused AS MATERIALIZED (SELECT qid, cand, did, sum(1.0 / (60 + r)) AS score FROM cl GROUP BY qid, cand, did),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid, cand ORDER BY round(score, 12) DESC, did) AS rank FROM fused),
top AS MATERIALIZED (SELECT * FROM ranked WHERE rank <= 100),
ideal AS MATERIALIZED (SELECT qid, sum(CASE WHEN rn <= 10 THEN rel / log2(rn + 1.0) ELSE 0 END) AS idcg
          FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, did) AS rn
                FROM qrels WHERE rel > 0) t GROUP BY qid),
dcg AS MATERIALIZED (SELECT t.qid, t.cand, sum(CASE WHEN t.rank <= 10 THEN greatest(coalesce(q.rel, 0), 0) / log2(t.rank + 1.0) ELSE 0 END) AS dcg
        FROM top t LEFT JOIN qrels q ON q.qid = t.qid AND q.did = t.did GROUP BY t.qid, t.cand),
scored AS MATERIALIZED (SELECT d.qid, d.cand, CASE WHEN coalesce(i.idcg, 0) > 0 THEN dcg / i.idcg ELSE 0 END AS value
           FROM dcg d LEFT JOIN ideal i ON i.qid = d.qid),
best AS MATERIALIZED (SELECT qid, cand, value FROM (
           SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(value, 9) DESC, {size}, cand) AS bn
           FROM scored) b WHERE bn = 1)
SELECT t.qid, t.did, t.rank, round(t.score, 6) AS score, t.cand, round(b.value, 6) AS value
FROM top t JOIN best b ON b.qid = t.qid AND b.cand = t.cand
"""


register("greedy_fusion", _candidate_sql(
    "SELECT vs.qid, g.cand, vs.vid FROM vs JOIN nv ON nv.qid = vs.qid, "
    "generate_series(vs.vpos, nv.n) AS g(cand)", "cand"),
    ("variants", "variant_scores", "qrels"))(
    lambda spark, sf_dir: _greedy(spark, sf_dir))

register("optimal_fusion", _candidate_sql(
    "SELECT m.qid, m.cand, vs.vid FROM (SELECT qid, g.cand FROM nv, generate_series(1, (1 << n) - 1) AS g(cand)) m "
    "JOIN vs ON vs.qid = m.qid WHERE ((m.cand >> (vs.vpos - 1)) & 1) = 1", "bit_count(cand)"),
    ("variants", "variant_scores", "qrels"))(
    lambda spark, sf_dir: _optimal(spark, sf_dir))


def _fmt(out):
    return out.select("qid", "did", "rank", r6("score").alias("score"), F.col("cand").cast("bigint").alias("cand"),
                      r6("value").alias("value"))


def _greedy(spark, sf_dir):
    """prefixes of the variants by predicted score, best NDCG@10."""
    out = FU.fuse_greedy(V.variants(spark, sf_dir), V.variant_scores(spark, sf_dir), V.qrels(spark, sf_dir),
                         metric="ndcg_cut_10", depth=100)
    return _fmt(out)


def _optimal(spark, sf_dir):
    """every subset of the variants, best NDCG@10, smallest on ties."""
    out = FU.fuse_optimal(V.variants(spark, sf_dir), V.variant_scores(spark, sf_dir), V.qrels(spark, sf_dir),
                          metric="ndcg_cut_10", depth=100)
    return _fmt(out)


@register("variant_fusion_cutoff", f"""
WITH {_VARIANT_LISTS},
vs AS (SELECT qid, vid, vscore, row_number() OVER (PARTITION BY qid ORDER BY vscore DESC, vid) AS pos FROM variant_scores),
ex AS (SELECT qid, vid, exp(vscore - max(vscore) OVER (PARTITION BY qid)) AS z FROM vs WHERE pos <= 2),
wt AS (SELECT qid, vid, z / sum(z) OVER (PARTITION BY qid) AS weight FROM ex),
fused AS (SELECT l.qid, l.did, sum(wt.weight / (60 + l.r)) AS score
          FROM lists l JOIN wt ON wt.qid = l.qid AND wt.vid = l.vid WHERE l.r <= 100 GROUP BY l.qid, l.did),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did) AS rank FROM fused)
SELECT qid, did, rank, round(score, 6) AS score FROM ranked WHERE rank <= 100
""", ("variants", "variant_scores"))
def variant_fusion_cutoff(spark, sf_dir):
    """F4 without forcing the original: best two variants, softmax weights."""
    out = FU.fuse_variants(V.variants(spark, sf_dir), V.variant_scores(spark, sf_dir), weighted=True, cutoff=2, depth=100)
    return out.select("qid", "did", "rank", r6("score").alias("score"))


@register("random_fusion", f"""
WITH {_VARIANT_LISTS},
pick AS (SELECT qid, vid, row_number() OVER (PARTITION BY qid ORDER BY md5(concat_ws('|', qid, vid, 7)), vid) AS p
         FROM (SELECT DISTINCT qid, vid FROM variants)),
fused AS (SELECT l.qid, l.did, sum(1.0 / (60 + l.r)) AS score
          FROM lists l JOIN pick ON pick.qid = l.qid AND pick.vid = l.vid WHERE p <= 2 AND l.r <= 100 GROUP BY l.qid, l.did),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did) AS rank FROM fused)
SELECT qid, did, rank, round(score, 6) AS score FROM ranked WHERE rank <= 100
""", ("variants",))
def random_fusion(spark, sf_dir):
    """RRF of 2 variants per query chosen by a seeded md5 order."""
    out = FU.fuse_random(V.variants(spark, sf_dir), 2, seed=7, depth=100)
    return out.select("qid", "did", "rank", r6("score").alias("score"))
