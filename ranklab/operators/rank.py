"""Ranking, sorting and top-k operators.

Two ways to number rows inside a group:

* :func:`top_k` - ``row_number() <= k``. Catalyst plans a partial
  ``WindowGroupLimit`` *before* the shuffle, so even a group holding a third
  of all rows ships at most k rows per map task. Used whenever only the
  first k ranks matter (cut-off metrics, fusion depth, retrieval).
* :func:`rank_rows` - full ranks (and running sums) for every row. Groups
  whose size exceeds ``ranklab.skew.hotRows`` are split: their rows are range
  partitioned on (key, order) so one group spans many tasks, numbered locally,
  and stitched together with per-partition offsets (a table of at most
  hot-groups x partitions rows, broadcast). Ordinary groups use one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import DEFAULT_HOT_ROWS, HOT_ROWS_KEY, broadcast_if_small, conf_int, materialize

ColLike = str | Column


def _c(x: ColLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tie_order(tie: str = "docno_desc", did: str = "did") -> list[Column]:
    """Tie rules found in the reference, as a parameter:

    * ``docno_desc`` - trec_eval / gdeval: document id compared as text,
      descending.
    * ``did`` - document id ascending (natural order).
    * ``ord`` - stable: original input order (column ``ord``).
    """
    if tie == "docno_desc":
        return [F.col(did).cast("string").desc()]
    if tie == "did":
        return [F.col(did).asc()]
    if tie == "ord":
        return [F.col("ord").asc()]
    raise ValueError(f"unknown tie rule {tie!r}")


def score_order(score: str = "score", tie: str = "docno_desc", did: str = "did") -> list[Column]:
    return [F.col(score).desc()] + tie_order(tie, did)


# Spark plans WindowGroupLimit up to this k (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """First k rows per group (ranks 1..k). Up to Spark's limit for
    WindowGroupLimit a task sends at most k rows of a group; a larger k goes
    through :func:`rank_rows`, which splits hot groups. Without keys, a global
    order and limit."""
    if not keys:
        first = df.orderBy(*order).limit(k)
        return rank_rows(first, [], order, rank_col, hot=[]) if k <= GROUP_LIMIT else (
            rank_rows(first.withColumn("_all", F.lit(0)), ["_all"], order, rank_col).drop("_all"))
    if k > GROUP_LIMIT:
        return rank_rows(df, keys, order, rank_col).where(F.col(rank_col) <= k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def _hot_groups(df: DataFrame, keys: Sequence[str], threshold: int):
    """Keys of groups with more than ``threshold`` rows, as a DataFrame; ``[]``
    where there are none (one aggregation tells)."""
    hot = df.groupBy(*keys).count().where(F.col("count") > threshold).select(*keys)
    return hot if hot.limit(1).count() else []


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> DataFrame | list:
    """Keys of the groups to split (see :func:`rank_rows`); callers detect
    on the narrowest frame that has the same groups (e.g. a run before its
    join with judgments) and pass the result on."""
    spark = df.sparkSession
    threshold = hot_rows if hot_rows is not None else conf_int(spark, HOT_ROWS_KEY, DEFAULT_HOT_ROWS)
    return [] if threshold <= 0 else _hot_groups(df.select(*keys), keys, threshold)


def hot_bound(upper: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> list | None:
    """Hot-group hint from an input whose groups are at least as large as
    the ones to rank (e.g. all input rows of a query bound its fused list):
    ``[]`` when no input group is hot (so no output group can be), else
    ``None`` (let :func:`rank_rows` detect on the frame itself)."""
    return [] if isinstance(hot_groups(upper, keys, hot_rows), list) else None


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
              rank_col: str = "rank", running: dict[str, Column] | None = None,
              hot_rows: int | None = None, hot: DataFrame | list | None = None) -> DataFrame:
    """Row number per group in ``order`` plus inclusive running sums.

    ``running`` maps output column → numeric expression; the output holds the
    sum of that expression over the rows ranked at or above each row.
    ``hot`` (from :func:`hot_groups`) skips the detection pass. Skew handling
    only changes speed: both paths give identical ranks.
    """
    running = dict(running or {})
    spark = df.sparkSession
    threshold = hot_rows if hot_rows is not None else conf_int(spark, HOT_ROWS_KEY, DEFAULT_HOT_ROWS)
    w = Window.partitionBy(*keys).orderBy(*order)
    wrun = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def windowed(d: DataFrame, kind: str = "int") -> DataFrame:
        d = d.withColumn(rank_col, F.row_number().over(w).cast(kind))
        for name, expr in running.items():
            d = d.withColumn(name, F.sum(expr).over(wrun))
        return d

    if hot is None:
        if threshold <= 0:
            return windowed(df)
        hot = _hot_groups(df.select(*keys), keys, threshold)
    if isinstance(hot, list):
        return windowed(df)

    tagged = df.join(broadcast_if_small(hot.withColumn("_hot", F.lit(True))), list(keys), "left")
    normal = windowed(tagged.where(F.col("_hot").isNull()).drop("_hot"), "long")   # a hot group may pass the int range

    # Hot groups: range partition on (key, order) so each group spans many
    # tasks; number rows locally, then add the count of earlier partitions.
    nparts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot_rows_df = (tagged.where(F.col("_hot").isNotNull()).drop("_hot")
                   .repartitionByRange(nparts, *[F.col(k) for k in keys], *order)
                   .withColumn("_pid", F.spark_partition_id()))
    wl = Window.partitionBy("_pid", *keys).orderBy(*order)
    wlrun = wl.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = hot_rows_df.withColumn("_lr", F.row_number().over(wl))
    for name, expr in running.items():
        local = local.withColumn(f"_l_{name}", F.sum(expr).over(wlrun))
    # Materialise once in the shared checkpoint folder: partition ids are
    # then fixed for both the offset table and the rows.
    local = materialize(local, "hot-ranks")
    stats = local.groupBy("_pid", *keys).agg(
        F.count("*").alias("_n"), *[F.sum(expr).alias(f"_t_{n}") for n, expr in running.items()])
    wo = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = stats.select("_pid", *keys, F.coalesce(F.sum("_n").over(wo), F.lit(0)).alias("_off"),
                        *[F.coalesce(F.sum(f"_t_{n}").over(wo), F.lit(0)).alias(f"_o_{n}") for n in running])
    hot_ranked = local.join(broadcast_if_small(offs), ["_pid", *keys])
    hot_ranked = hot_ranked.withColumn(rank_col, (F.col("_lr") + F.col("_off")))
    for name in running:
        hot_ranked = hot_ranked.withColumn(name, F.col(f"_l_{name}") + F.col(f"_o_{name}"))
    cols = normal.columns
    return normal.unionByName(hot_ranked.select(*cols))


# ---------------------------------------------------------------------------
# W1-W10
# ---------------------------------------------------------------------------

def _run_keys(df: DataFrame) -> list[str]:
    keys = [c for c in ("system", "qid", "vid") if c in df.columns]
    return keys


def rerank(run: DataFrame, tie: str = "docno_desc", keys: Sequence[str] | None = None,
           rank_col: str = "rank") -> DataFrame:
    """Rank from 1 by score descending within each ranked list."""
    keys = list(keys) if keys else _run_keys(run)
    return rank_rows(run.drop(rank_col) if rank_col in run.columns else run,
                     keys, score_order("score", tie), rank_col)


def first(run: DataFrame, n: int, tie: str = "docno_desc", keys: Sequence[str] | None = None) -> DataFrame:
    """Top n per ranked list (WindowGroupLimit, skew-safe)."""
    keys = list(keys) if keys else _run_keys(run)
    base = run.drop("rank") if "rank" in run.columns else run
    return top_k(base, keys, score_order("score", tie), n)


def select_by_ranks(run: DataFrame, ranks: Sequence[int], zero_based: bool = False,
                    tie: str = "docno_desc", keys: Sequence[str] | None = None) -> DataFrame:
    """Keep the given rank positions, then renumber from 1. Positions
    beyond a list's length are skipped; without positions nothing is kept."""
    keys = list(keys) if keys else _run_keys(run)
    wanted = sorted({int(r) + (1 if zero_based else 0) for r in ranks})
    kmax = max(wanted, default=1)
    kept = first(run, kmax, tie, keys).where(F.col("rank").isin(wanted))
    w = Window.partitionBy(*keys).orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w))


def nth_best_variant(run: DataFrame, scores: DataFrame, pos: int) -> DataFrame:
    """Per query, the variant with the pos-th highest predicted score
    (pos clamped to the number of variants); returns that variant's rows.
    ``scores``: (qid, vid, vscore)."""
    w = Window.partitionBy("qid").orderBy(F.col("vscore").desc(), F.col("vid"))
    picked = (scores.withColumn("_r", F.row_number().over(w))
              .withColumn("_n", F.count("*").over(Window.partitionBy("qid")))
              .where(F.col("_r") == F.least(F.lit(pos), F.col("_n")))
              .select("qid", "vid"))
    return run.join(picked, ["qid", "vid"], "left_semi")


def oracle_run(qrels: DataFrame, min_rel: int = 1, score_type: str = "zero",
               tie: str = "did") -> DataFrame:
    """Ideal ranking from judgments: grade >= min_rel, grade descending,
    ties in ``tie`` order; score 0 (``zero``) or the grade (``rel``)."""
    order = [F.col("rel").desc()] + tie_order(tie)
    ranked = rank_rows(qrels.where(F.col("rel") >= min_rel), ["qid"], order, "rank")
    score = F.col("rel").cast("double") if score_type == "rel" else F.lit(0.0)
    return ranked.select("qid", "did", "rank", score.alias("score"))


def filter_oracle_run(run: DataFrame, qrels: DataFrame, n: int, min_rel: int = 1,
                      tie: str = "docno_desc", score_type: str = "run") -> DataFrame:
    """Per query, the first n documents (run order) with grade >= min_rel;
    when too few, min_rel is relaxed step by step down to 0. Unjudged and
    negative documents never qualify. Output keeps run order, new ranks and
    tag ``rel{g}`` of the document's grade. ``score_type``: ``run`` keeps the
    run's scores, ``uniform`` gives 0, ``relevance`` the grade.

    Equivalent single pass: order by least(rel, min_rel) desc, run rank; keep n.
    """
    scores = {"run": F.col("score"), "uniform": F.lit(0.0), "relevance": F.col("rel").cast("double")}
    if score_type not in scores:
        raise ValueError(f"score_type is one of {', '.join(scores)}, got {score_type!r}")
    keys = [c for c in ("system", "qid") if c in run.columns]
    ranked = rerank(run, tie, keys, "_run_rank")
    judged = (ranked.join(qrels.select("qid", "did", "rel"), ["qid", "did"], "left")
              .withColumn("rel", F.coalesce(F.col("rel"), F.lit(0))).where(F.col("rel") >= 0))
    lvl = F.least(F.col("rel"), F.lit(min_rel))
    kept = top_k(judged.withColumn("_lvl", lvl), keys, [F.col("_lvl").desc(), F.col("_run_rank")], n, "_pick")
    w = Window.partitionBy(*keys).orderBy("_run_rank")
    return kept.select(*keys, "did", scores[score_type].alias("score"), F.row_number().over(w).alias("rank"),
                       F.concat(F.lit("rel"), F.col("rel").cast("string")).alias("tag"))


def sort_by_relevance(labelled: DataFrame, tie: str = "docno_desc") -> DataFrame:
    """Stable sort by grade descending within each query (original rank
    breaks ties); ranks renumbered."""
    keys = [c for c in ("system", "qid") if c in labelled.columns]
    base = labelled if "rank" in labelled.columns else rerank(labelled, tie, keys)
    order = [F.coalesce(F.col("rel"), F.lit(0)).desc(), F.col("rank")]
    return rank_rows(base.withColumnRenamed("rank", "orig_rank"), keys,
                     [order[0], F.col("orig_rank")], "rank")


def head(df: DataFrame, n: int, order: Sequence[ColLike] = ("ord",)) -> DataFrame:
    """First n rows in order (a limit is the feature here)."""
    return df.orderBy(*[_c(o) for o in order]).limit(n)


def tail(df: DataFrame, n: int, order: Sequence[ColLike] = ("ord",)) -> DataFrame:
    """The reference's ``tail(n)`` skips the first n rows."""
    return df.orderBy(*[_c(o) for o in order]).offset(n)


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "position") -> DataFrame:
    """Row number over the whole frame. The single group goes through
    :func:`rank_rows`, so a large frame is range partitioned, not pulled
    into one task."""
    return rank_rows(df.withColumn("_g", F.lit(0)), ["_g"], order, rank_col).drop("_g")


def sort_systems(table: DataFrame, metric: str) -> DataFrame:
    """Overall table (system, metric, value) of one metric, best first,
    with its position."""
    one = table.where(F.col("metric") == metric)
    return global_rank(one, [F.col("value").desc(), F.col("system")])


def order_queries_by_base(evals: DataFrame, base: str, metric: str) -> DataFrame:
    """Every system's per-query values, queries ordered by the base
    system's value (position 1 = best base query)."""
    one = evals.where(F.col("metric") == metric)
    basev = one.where(F.col("system") == base).select("qid", F.col("value").alias("base_value"))
    pos = global_rank(basev, [F.col("base_value").desc(), F.col("qid")])
    return one.join(pos, "qid").select("system", "qid", "value", "base_value", "position")
