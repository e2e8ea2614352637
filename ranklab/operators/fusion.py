"""Fusion of ranked lists.

Inputs are long frames (list key, qid, did, score). Fusion is a grouped sum
per (qid, did) - partial aggregation before the shuffle, so a hot query is
combined map-side - followed by a top-``depth`` cut (WindowGroupLimit).
Candidate fusions (greedy prefixes, all subsets) are *rows* keyed by a
candidate id, so fusing and evaluating every candidate is two grouped
aggregations and picking the best is one more.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..session import broadcast_if_small, materialize
from .groups import drawn
from .rank import hot_bound, rank_rows, score_order, top_k


def _fused_order() -> list[Column]:
    # fused scores are float sums: rank on a rounded value with a total tie
    return [F.round(F.col("score"), 12).desc(), F.col("did")]


def rrf_scores(lists: DataFrame, list_keys: Sequence[str], group_keys: Sequence[str],
               k: int = 60, depth: int = 1000, weight: Column | None = None,
               tie: str = "docno_desc") -> DataFrame:
    """Σ w / (k + rank) per (group_keys, did) over lists cut at ``depth``.
    ``list_keys`` identify one input list; ``group_keys`` the fused list."""
    cut = top_k(lists, list(list_keys), score_order("score", tie), depth, "_r")
    w = weight if weight is not None else F.lit(1.0)
    contrib = cut.select(*group_keys, "did", (w / (k + F.col("_r"))).alias("_c"))
    return contrib.groupBy(*group_keys, "did").agg(F.sum("_c").alias("score"))


def fuse_rrf(runs: DataFrame, k: int = 60, depth: int = 1000, weights: DataFrame | None = None,
             tie: str = "docno_desc") -> DataFrame:
    """reciprocal rank fusion of the systems in ``runs`` (system, qid,
    did, score); optional ``weights`` (system, weight). Top ``depth`` kept.
    Weights are one row a system and broadcast whatever their estimate (a local
    list has none): a shuffle by system would put each system's lists in one task."""
    lists = runs
    wcol = None
    if weights is not None:
        lists = runs.join(F.broadcast(weights), "system")
        wcol = F.col("weight")
    fused = rrf_scores(lists, ["system", "qid"], ["qid"], k, depth, wcol, tie)
    return top_k(fused, ["qid"], _fused_order(), depth, "rank")


def fuse_linear(runs: DataFrame, weights: DataFrame) -> DataFrame:
    """F2: weighted score sum over the pooled documents of each query. A run
    lacking a document contributes its minimum score for that query; a run
    lacking the whole query contributes nothing. Scores to 5 decimals.

    Rewritten so no (document × run) grid is built:
    fused(q,d) = Σ_{s∋q} w_s·min_s(q) + Σ_{s∋d} w_s·(score_s(d) − min_s(q)).
    """
    wb = F.broadcast(weights.select("system", F.col("weight").cast("double")))      # one row a system
    mins = runs.groupBy("system", "qid").agg(F.min("score").alias("_min")).join(wb, "system")
    base = mins.groupBy("qid").agg(F.sum(F.col("weight") * F.col("_min")).alias("_base"))
    delta = (runs.join(mins, ["system", "qid"])
             .groupBy("qid", "did").agg(F.sum(F.col("weight") * (F.col("score") - F.col("_min"))).alias("_d")))
    fused = delta.join(base, "qid").select("qid", "did", (F.col("_base") + F.col("_d")).alias("score"))
    # a fused list is no longer than its query's input rows: bound the hot check on the input
    ranked = rank_rows(fused, ["qid"], _fused_order(), "rank", hot=hot_bound(runs, ["qid"]))
    return ranked.select("qid", "did", "rank", F.round("score", 5).alias("score"))


def simplex_weights(spark, systems: Sequence[str], step: float = 0.1) -> DataFrame:
    """F3 grid: every weight vector of multiples of ``step`` summing to 1
    (as integers of tenths: exact), one row per (weight id, system)."""
    n = round(1 / step)
    # each system takes a part of what the ones before left; the last takes the rest
    grid = spark.range(1).select(F.lit(n).alias("_left"))
    for i in range(len(systems) - 1):
        grid = grid.withColumn(f"w{i}", F.explode(F.sequence(F.lit(0), F.col("_left")))).withColumn("_left", F.col("_left") - F.col(f"w{i}"))
    grid = grid.withColumnRenamed("_left", f"w{len(systems) - 1}")
    wid = F.concat_ws("_", *[(F.col(f"w{i}").cast("double") / n).cast("string") for i in range(len(systems))])
    stack = ", ".join(f"'{s}', CAST(w{i} AS DOUBLE) / {float(n)}" for i, s in enumerate(systems))
    return grid.select(wid.alias("weights"), F.expr(f"stack({len(systems)}, {stack}) AS (system, weight)"))


def fuse_linear_sweep(runs: DataFrame, systems: Sequence[str], step: float = 0.1) -> DataFrame:
    """F2 for every weight vector of the simplex grid, keyed by
    ``weights`` (e.g. ``0.3_0.7``). A document's contributions, one per system, are
    gathered in one row first; the weight vectors, few and broadcast, meet these
    rows behind the shuffles that need the run itself."""
    spark = runs.sparkSession
    grid = simplex_weights(spark, systems, step)
    vectors = broadcast_if_small(grid.groupBy("weights").agg(
        *[F.max(F.when(F.col("system") == s, F.col("weight"))).alias(f"_w{i}") for i, s in enumerate(systems)]))
    of = lambda s, x, agg: agg(F.when(F.col("system") == s, x))
    wanted = runs.where(F.col("system").isin(list(systems)))
    mins = wanted.groupBy("qid").agg(*[of(s, F.col("score"), F.min).alias(f"_m{i}") for i, s in enumerate(systems)])
    docs = wanted.groupBy("qid", "did").agg(
        *[of(s, F.col("score"), F.sum).alias(f"_s{i}") for i, s in enumerate(systems)],
        *[F.count_if(F.col("system") == s).alias(f"_n{i}") for i, s in enumerate(systems)])
    rows = docs.join(mins, "qid")
    # minimum of the query, plus what each of the document's rows has above it
    part = lambda i: F.coalesce(F.col(f"_m{i}") + F.coalesce(F.col(f"_s{i}") - F.col(f"_n{i}") * F.col(f"_m{i}"), F.lit(0)), F.lit(0))
    rows = rows.select("qid", "did", *[part(i).alias(f"_x{i}") for i in range(len(systems))])
    score = sum((F.col(f"_w{i}") * F.col(f"_x{i}") for i in range(len(systems))), F.lit(0.0))
    fused = rows.crossJoin(vectors).select("weights", "qid", "did", score.alias("score"))
    ranked = rank_rows(fused, ["weights", "qid"], _fused_order(), "rank", hot=hot_bound(runs, ["qid"]))
    return ranked.select("weights", "qid", "did", "rank", F.round("score", 5).alias("score"))


def _cut_lists(run: DataFrame, depth: int) -> DataFrame:
    """Every variant's list ranked and cut once, as a table: counts, presence and
    all candidate fusions read it instead of the run."""
    return materialize(top_k(run, ["qid", "vid"], score_order(), depth, "_r"), "variant-lists")


def _with_scores(cut: DataFrame, scores: DataFrame) -> DataFrame:
    """(qid, vid, vscore, _orig, _has_orig, _nv) of the variants present; a
    variant without a predicted score has a null one and comes last."""
    v = cut.select("qid", "vid").distinct().join(scores.select("qid", "vid", "vscore"), ["qid", "vid"], "left")
    w = Window.partitionBy("qid")
    orig = F.col("vid") == F.col("qid").cast("string")
    return v.withColumns({"_orig": orig, "_has_orig": F.max(orig.cast("int")).over(w) == 1, "_nv": F.count("*").over(w)})


def _best_first() -> list[Column]:
    return [F.col("vscore").desc_nulls_last(), F.col("vid")]


def variant_weights(variants: DataFrame, weighted: bool = False, always_include_orig: bool = False,
                    cutoff: int | None = None, orig_weight: float | None = None) -> DataFrame:
    """Selected variants (see :func:`_with_scores`) and their fusion weights.

    The best ``cutoff`` variants by predicted score (all without it); with
    ``always_include_orig``, where the original is present, the best
    ``cutoff - 1`` others and the original. Weights are 1, or when
    ``weighted`` the softmax of the predicted scores (0 for an unscored
    variant: its documents stay, without a score). ``orig_weight`` t, with the
    original forced in, makes its weight t and the others' (1 − t) times theirs."""
    forced = F.col("_has_orig") if always_include_orig else F.lit(False)
    sel = variants
    if cutoff is not None:
        own = forced & F.col("_orig")
        pos = F.row_number().over(Window.partitionBy("qid", own).orderBy(*_best_first()))
        sel = sel.withColumn("_pos", pos).where(own | (F.col("_pos") <= F.when(forced, cutoff - 1).otherwise(cutoff)))
    weight = F.lit(1.0)
    if weighted:
        wq = Window.partitionBy("qid")
        z = F.coalesce(F.exp(F.col("vscore") - F.max("vscore").over(wq)), F.lit(0.0))
        weight = F.coalesce(F.try_divide(z, F.sum(z).over(wq)), F.lit(1.0))
    sel = sel.withColumn("weight", weight)
    if orig_weight is not None and 0 <= orig_weight <= 1:
        sel = sel.withColumn("weight", F.when(forced, F.when(F.col("_orig"), F.lit(orig_weight)).otherwise(F.col("weight") * (1 - orig_weight)))
                             .otherwise(F.col("weight")))
    return sel.select("qid", "vid", "weight")


def _fused_cut(cut: DataFrame, keys: Sequence[str], weight: Column, k: int, depth: int) -> DataFrame:
    fused = cut.select(*keys, "did", (weight / (k + F.col("_r"))).alias("_c")).groupBy(*keys, "did").agg(F.sum("_c").alias("score"))
    return top_k(fused, list(keys), _fused_order(), depth, "rank")


def _unchanged(run: DataFrame, single: DataFrame) -> DataFrame:
    """The lists of queries with one variant, whole, as they are."""
    own = run.join(single.select("qid", "vid"), ["qid", "vid"], "left_semi")
    return rank_rows(own.select("qid", "did", F.col("score").cast("double").alias("score")), ["qid"], score_order(), "rank")


def fuse_variants(run: DataFrame, scores: DataFrame, weighted: bool = False,
                  always_include_orig: bool = False, cutoff: int | None = None,
                  orig_weight: float | None = None, k: int = 60, depth: int = 1000) -> DataFrame:
    """RRF over the variants of each query. ``run``: (qid, vid, did,
    score); ``scores``: (qid, vid, vscore). A query with one variant keeps
    its whole list unchanged."""
    cut = _cut_lists(run, depth)
    variants = _with_scores(cut, scores)
    wts = variant_weights(variants.where("_nv > 1"), weighted, always_include_orig, cutoff, orig_weight)
    fused = _fused_cut(cut.join(wts, ["qid", "vid"]), ["qid"], F.col("weight"), k, depth)
    return fused.select("qid", "did", "rank", "score").unionByName(
        _unchanged(run, variants.where("_nv = 1")).select("qid", "did", "rank", "score"))


def _need(metric: str, depth: int) -> int:
    """Rows of a list that a measure looks at: its cut, where its name has one."""
    cut = re.search(r"(?:_cut_|^P_|@)(\d+)$", metric)
    return min(depth, int(cut.group(1))) if cut else depth


def _mask(n: int | Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n if isinstance(n, Column) else F.lit(n))


def _best_candidate(ranked: DataFrame, masks: DataFrame, cut: DataFrame, qrels: DataFrame, metric: str, size: Column,
                    k: int, depth: int) -> DataFrame:
    """The best fused list of each query. ``ranked`` (qid, vid, _vpos): its variants in
    order; ``masks`` (qid, masks): its candidates as (cand, mask) of positions.

    One row per query and document holds the contributions of all variants; a
    candidate's score is the sum over its mask. Candidates are scored in that row and
    only as many rows per candidate as the measure looks at leave a task; the list
    itself is made for the chosen candidate alone. A query without judgments scores
    0 for all, so the smallest wins."""
    part = F.struct((F.col("_vpos") - 1).cast("int").alias("at"), (F.lit(1.0) / (k + F.col("_r"))).alias("c"))
    docs = cut.join(ranked.select("qid", "vid", "_vpos"), ["qid", "vid"]).groupBy("qid", "did").agg(F.collect_list(part).alias("parts"))
    docs = materialize(docs, "contributions")

    def summed(mask: Column) -> Column:
        own = F.filter("parts", lambda p: F.call_function("getbit", mask, p["at"]) == 1)
        return F.aggregate(F.array_sort(own), F.lit(0.0), lambda s, p: s + p["c"])

    each = docs.join(masks, "qid").select("qid", "did", "parts", F.explode("masks").alias("m"))
    each = each.select("qid", F.col("m.cand").alias("cand"), "did", summed(F.col("m.mask")).alias("score")).where("score > 0")
    few = top_k(each, ["qid", "cand"], _fused_order(), _need(metric, depth), "rank")
    scored = M.evaluate_wide(few.select("qid", "cand", "did", F.round("score", 12).alias("score")),
                             qrels, [metric], tie="did", keys=["qid", "cand"])
    value = F.coalesce(F.col(f"`{metric}`"), F.lit(0.0))
    all_ = masks.select("qid", F.explode("masks").alias("m")).select("qid", "m.*")
    all_ = all_.join(scored, ["qid", "cand"], "left").withColumn("value", value)
    best = top_k(all_.withColumn("_size", size), ["qid"], [F.round("value", 9).desc(), F.col("_size"), F.col("cand")], 1, "_b")
    best = materialize(best.select("qid", "cand", "mask", "value"), "chosen")
    lists = docs.join(broadcast_if_small(best), "qid").select("qid", "did", summed(F.col("mask")).alias("score"), "cand", "value").where("score > 0")
    return top_k(lists, ["qid"], _fused_order(), depth, "rank").select("qid", "did", "rank", "score", "cand", "value")


def fuse_greedy(run: DataFrame, scores: DataFrame, qrels: DataFrame, cutoff: int | None = None,
                metric: str = "ndcg_cut_10", k: int = 60, depth: int = 1000) -> DataFrame:
    """fuse the best 1..cutoff variants (by predicted score); keep the
    prefix whose fused list scores best, the shortest on ties. A query with
    one variant keeps its whole list (cand 1, no value); 62 variants at most."""
    cut = _cut_lists(run, depth)
    variants = materialize(_with_scores(cut, scores), "variants")
    pos = F.row_number().over(Window.partitionBy("qid").orderBy(*_best_first()))
    ranked = variants.where("_nv > 1").withColumn("_vpos", pos)
    n = ranked.groupBy("qid").agg(F.max("_vpos").alias("_n"))
    last = _few(F.col("_n")) if cutoff is None else F.least(F.col("_n"), F.lit(cutoff))
    cands = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(i.cast("long").alias("cand"), (_mask(i) - 1).alias("mask")))
    best = _best_candidate(ranked, n.select("qid", cands.alias("masks")), cut, qrels, metric, F.col("cand"), k, depth)
    own = _unchanged(run, variants.where("_nv = 1"))
    return best.unionByName(own.select("qid", "did", "rank", "score", F.lit(1).cast("long").alias("cand"), F.lit(None).cast("double").alias("value")))


def _few(n: Column) -> Column:
    return F.when(n <= 62, n).otherwise(F.raise_error(F.lit("more than 62 variants of a query")).cast("int"))


def fuse_optimal(run: DataFrame, scores: DataFrame, qrels: DataFrame, cutoff: int | None = None,
                 metric: str = "ndcg_cut_10", ignore_zero: bool = False, k: int = 60,
                 depth: int = 1000, return_vids: bool = False) -> DataFrame:
    """fuse every nonempty subset of the variants (of the best ``cutoff``
    by predicted score, where given); keep the best, the smallest subset on
    ties. A candidate is a bit mask over the variants from the best on, so a
    query has 2^n − 1 of them: the work doubles with every variant, and 62 is
    the most a mask holds (more raise inside the job). ``return_vids`` adds the
    chosen variants, best first, as ``vids``."""
    cut = _cut_lists(run, depth)
    present = _with_scores(cut, scores)
    if ignore_zero:
        present = present.where(F.col("vscore") > 0)
    pos = F.row_number().over(Window.partitionBy("qid").orderBy(*_best_first()))
    ranked = present.withColumn("_vpos", pos)
    if cutoff is not None:
        ranked = ranked.where(F.col("_vpos") <= cutoff)
    ranked = materialize(ranked, "variants")
    n = ranked.groupBy("qid").agg(F.max("_vpos").alias("_n"))
    cands = F.transform(F.sequence(F.lit(1).cast("long"), _mask(_few(F.col("_n"))) - 1), lambda m: F.struct(m.alias("cand"), m.alias("mask")))
    best = _best_candidate(ranked, n.select("qid", cands.alias("masks")), cut, qrels, metric, F.bit_count(F.col("cand")), k, depth)
    if not return_vids:
        return best
    vids = F.transform(F.array_sort(F.collect_list(F.struct("_vpos", "vid"))), lambda x: x["vid"])
    chosen = best.select("qid", "cand").distinct()
    named = (ranked.join(chosen, "qid").where(F.expr("(shiftright(cand, _vpos - 1) & 1) = 1")).groupBy("qid").agg(vids.alias("vids")))
    return best.join(named, "qid")


def fuse_random(run: DataFrame, nvariants: int, seed: int = 0, k: int = 60, depth: int = 1000) -> DataFrame:
    """RRF of ``nvariants`` variants per query chosen by a seeded hash
    (capped at the number available)."""
    v = run.select("qid", "vid").distinct()
    pick = top_k(v, ["qid"], [drawn(v, ["qid", "vid"], seed), F.col("vid")], nvariants, "_p")
    lists = run.join(pick.select("qid", "vid"), ["qid", "vid"])
    fused = rrf_scores(lists, ["qid", "vid"], ["qid"], k, depth)
    return top_k(fused, ["qid"], _fused_order(), depth, "rank")


COMBINE = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}


def fuse_custom(lists: DataFrame, contribution, stats: dict[str, Column] | None = None, combine: str = "sum",
                list_keys: Sequence[str] = ("system", "qid"), keys: Sequence[str] = ("qid",)) -> DataFrame:
    """A user's fusion as a mergeable aggregate over whole lists (did, score).
    ``stats`` are aggregates of a list, joined to its rows; ``contribution`` is a
    function from a pandas frame of rows (any batch of them: the list's columns and
    stats) to one number a row; ``combine`` (sum, max, min, mean) merges a document's
    contributions, with partial results per task. No query and no list is ever one
    pandas group. Ranked by score (9 decimals) and document."""
    list_keys, keys = list(list_keys), list(keys)
    rows = lists
    if stats:
        rows = rows.join(lists.groupBy(*list_keys).agg(*[c.alias(n) for n, c in stats.items()]), list_keys)
    names = [*keys, "did"]

    def run(batches):
        for b in batches:
            yield b[names].assign(_c=contribution(b).astype("float64"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema) + ", _c double"
    part = rows.mapInPandas(run, schema)
    fused = part.groupBy(*names).agg(COMBINE[combine]("_c").alias("score"))
    return rank_rows(fused, keys, [F.round("score", 9).desc(), F.col("did")], "rank")
