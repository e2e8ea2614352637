"""Projections, filters, joins and set operations.

Every small "allow list" side goes through ``broadcast_if_small``: it is
broadcast only when Catalyst's size estimate is under the configured bound,
otherwise the planner shuffles (and AQE may still broadcast at runtime once
the real size is measured).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .rank import top_k


# -- P: filters and projections ---------------------------------------------

def filter_by_keys(df: DataFrame, field: str, keys: DataFrame, key_col: str | None = None,
                   trim: bool = False, keep: bool = True) -> DataFrame:
    """Keep (or drop) rows whose ``field`` is in the key table. ``trim``
    strips keys and ignores blank ones (one of the two reference versions)."""
    k = keys.select(F.col(key_col or keys.columns[0]).alias("_key"))
    if trim:
        k = k.select(F.trim(F.col("_key").cast("string")).alias("_key")).where(F.col("_key") != "")
    k = broadcast_if_small(k.distinct())
    cond = F.col(field).cast(k.schema["_key"].dataType) == F.col("_key")
    return df.join(k, cond, "left_semi" if keep else "left_anti")


def filter_spam(run: DataFrame, spam: DataFrame, threshold: int, count: int | None = None,
                order: str = "rank") -> DataFrame:
    """Drop documents absent from the spam table or scoring below the
    threshold; keep the first ``count`` per list in input order (``order``
    column); ranks unchanged. The spam table is semi-joined to the run's
    documents first, so only their scores travel (J7)."""
    keys = [c for c in ("system", "qid", "vid") if c in run.columns]
    docs = run.select("did").distinct()
    scores = spam.join(broadcast_if_small(docs), "did", "left_semi").where(F.col("spam") >= threshold)
    kept = run.join(scores.select("did"), "did", "left_semi")
    if count is None:
        return kept
    return top_k(kept.withColumnRenamed(order, "_o"), keys, [F.col("_o")], count, "_n") \
        .drop("_n").withColumnRenamed("_o", order)


def select_original(run: DataFrame) -> DataFrame:
    """Original query rows (vid = qid)."""
    return run.where(F.col("vid") == F.col("qid").cast("string"))


def select_variants(run: DataFrame) -> DataFrame:
    """Variant rows (vid <> qid)."""
    return run.where(F.col("vid") != F.col("qid").cast("string"))


def select_by_vids(run: DataFrame, vids: DataFrame, keep_origin_if_none: bool = True) -> DataFrame:
    """Keep listed variants; when none of a query's listed variants
    exist, optionally fall back to its original. The per-query flag is a
    partial aggregation over the (query, variant) pairs, joined back."""
    v = broadcast_if_small(vids.select("vid").distinct().withColumn("_hit", F.lit(1)))
    tagged = run.join(v, "vid", "left")
    keep = F.col("_hit").isNotNull()
    if keep_origin_if_none:
        present = run.select("qid", "vid").distinct().join(v, "vid", "inner")
        any_hit = present.select("qid").distinct().withColumn("_any", F.lit(1))
        tagged = tagged.join(any_hit, "qid", "left")
        keep = keep | (F.col("_any").isNull() & (F.col("vid") == F.col("qid").cast("string")))
        return tagged.where(keep).drop("_hit", "_any")
    return tagged.where(keep).drop("_hit")


def select_qrels_by_qids(qrels: DataFrame, qids: DataFrame) -> DataFrame:
    """P5."""
    return qrels.join(broadcast_if_small(qids.select("qid").distinct()), "qid", "left_semi")


def select_qrels_by_n_relevant(qrels: DataFrame, n: int, how: str = "min") -> DataFrame:
    """Queries whose number of nonzero grades is >= n (min), == n (eq)
    or <= n (max)."""
    cnt = qrels.groupBy("qid").agg(F.count_if(F.col("rel") != 0).alias("_n"))
    cond = {"min": F.col("_n") >= n, "eq": F.col("_n") == n, "max": F.col("_n") <= n}[how]
    return qrels.join(cnt.where(cond).select("qid"), "qid", "left_semi")


def relevance_lookup(pairs: DataFrame, qrels: DataFrame, default: int = 0) -> DataFrame:
    """Grade of each (qid, did) pair, default when unjudged."""
    return pairs.join(qrels.select("qid", "did", "rel"), ["qid", "did"], "left") \
        .withColumn("rel", F.coalesce(F.col("rel"), F.lit(default)))


def relevant_docs(qrels: DataFrame) -> DataFrame:
    """Relevant (rel > 0) pairs by query: one row per (qid, did)."""
    return qrels.where(F.col("rel") > 0).select("qid", "did")


def relevant_doc_counts(qrels: DataFrame) -> DataFrame:
    """P8 both directions as counts (lists stay long: no group is collected)."""
    rel = qrels.where(F.col("rel") > 0)
    return rel.groupBy("qid").agg(F.count("*").alias("n_docs")), \
        rel.groupBy("did").agg(F.count("*").alias("n_queries"))


def binarize_rel(df: DataFrame, min_rel: int = 1, col: str = "rel") -> DataFrame:
    """P9."""
    return df.withColumn(col, F.when(F.col(col) >= min_rel, 1).otherwise(0))


def project_metrics(evals: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """P10."""
    return evals.where(F.col("metric").isin(list(metrics)))


def remove_tail(df: DataFrame, col: str, pct: float, by: Sequence[str] = ()) -> DataFrame:
    """Keep values strictly below the pct-th percentile (exact,
    linear interpolation) of their group."""
    from .quantiles import quantiles
    by = list(by)
    q = quantiles(df, col, [pct / 100.0], by).select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col("q")[0].alias("_q"))
    below = F.col(col) < F.col("_q")
    for i, b in enumerate(by):
        below = below & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    return df.join(broadcast_if_small(q), below).select(*df.columns)


def session_id(qid: Column) -> Column:
    """Leading alphanumerics of an id, up to the first other character; an
    id without such a character has no session (null)."""
    return F.nullif(F.regexp_extract(qid.cast("string"), r"^([a-zA-Z0-9]+)[^a-zA-Z0-9]", 1), F.lit(""))


def rescale_by_query_length(run: DataFrame, queries: DataFrame, token_col: str = "tokens") -> DataFrame:
    """Score × number of query tokens."""
    ql = queries.select("qid", F.size(token_col).alias("_len"))
    return run.join(ql, "qid").withColumn("score", F.col("score") * F.col("_len")).drop("_len")


# -- J: joins ----------------------------------------------------------------

def label_run(run: DataFrame, qrels: DataFrame, default: int = 0, dedup: bool = False) -> DataFrame:
    """Append the grade of every retrieved document (default when
    unjudged). Every occurrence is graded; ``dedup`` removes repeats first."""
    if dedup:
        from .groups import dedup_run
        run = dedup_run(run)
    return relevance_lookup(run, qrels, default)


def append_missing_relevant(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """For queries in the run, append every judged document that was not
    retrieved, with the query's max score and min rank."""
    q = run.groupBy("qid").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    missing = qrels.join(q.select("qid"), "qid", "left_semi") \
        .join(run.select("qid", "did"), ["qid", "did"], "left_anti")
    extra = missing.join(q, "qid").select("qid", "did", "score", "rank", "rel")
    base = run.join(qrels.select("qid", "did", "rel"), ["qid", "did"], "left") \
        .select("qid", "did", "score", "rank", "rel")
    return base.unionByName(extra)


def rank_alignment(runs: DataFrame, k: int, tie: str = "docno_desc", systems: Sequence[str] | None = None) -> DataFrame:
    """Rank of each document in every system, kept when it is within
    the top k of ALL systems. Top-k is cut before the pivot (skew-safe).
    The systems become columns; without ``systems`` a job reads their names."""
    if systems is None:
        systems = [r["system"] for r in runs.select("system").distinct().orderBy("system").collect()]
    top = top_k(runs, ["system", "qid"], [F.col("score").desc()] + _tie(tie), k)
    wide = top.groupBy("qid", "did").pivot("system", systems).agg(F.first("rank"))
    cond = F.lit(True)
    for s in systems:
        cond = cond & F.col(s).isNotNull()
    return wide.where(cond)


def _tie(tie):
    from .rank import tie_order
    return tie_order(tie)


def sweep_grid(**params: Sequence) -> DataFrame:
    """Cartesian product of small parameter lists as a DataFrame."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    out = None
    for name, values in params.items():
        d = spark.createDataFrame([(v,) for v in values], [name])
        out = d if out is None else out.crossJoin(d)
    return out


# -- U: set operations -------------------------------------------------------

def concat_systems(frames: dict[str, DataFrame] | Sequence[DataFrame]) -> DataFrame:
    """Stack frames with a system key; frames without names are ``Sys1``,
    ``Sys2``, ... in their order."""
    if not isinstance(frames, dict):
        frames = {f"Sys{i}": df for i, df in enumerate(frames, 1)}
    out = None
    for name, df in frames.items():
        d = df.withColumn("system", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def common_metrics(evals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics present for every system, and per system the others."""
    n = evals.select("system").distinct().count()
    per = evals.select("system", "metric").distinct()
    common = per.groupBy("metric").agg(F.count("*").alias("_n")).where(F.col("_n") == n).select("metric")
    other = per.join(common, "metric", "left_anti")
    return common, other


def common_queries(evals: DataFrame) -> DataFrame:
    """Per metric, queries present for every system; intersection and
    union counts."""
    nsys = evals.groupBy("metric").agg(F.count_distinct("system").alias("_ns"))
    per = evals.groupBy("metric", "qid").agg(F.count_distinct("system").alias("_c"))
    return per.join(nsys, "metric").groupBy("metric").agg(
        F.count_if(F.col("_c") == F.col("_ns")).alias("n_common"), F.count("*").alias("n_union"))


def pooled_docs(runs: DataFrame) -> DataFrame:
    """U4: union of retrieved documents per query over all runs."""
    return runs.select("qid", "did").distinct()
