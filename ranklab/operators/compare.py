"""Comparing ranked lists and systems (M15 RBO, J4, J5, J8, T6, T7).

RBO uses the closed form: for a document shared by both lists within the
depth K = min(|A|, |B|, k), with m = max of its two ranks, the overlap at
depth d counts it for every d >= m. Hence

    RBO_ext = Σ_shared (H(K) - H(m-1)) + X_K / K · p^K,
    H(n)    = Σ_{d<=n} (1-p) p^(d-1) / d            (p < 1)

and for p = 1 the average overlap (1/K) Σ_shared (Σ_{d=m..K} 1/d). H is a
table over d = 0..max(k) per p, a literal array bounded by the grid. Both runs are
ranked in one pass; a query's shared ranks (max(k) at most) are one array, and all
cells of the grid are computed in its row: no join, no pairs, no per-depth rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import score_order, top_k


def _prefix_sums(kmax: int, p: float) -> list[float]:
    """H(0..kmax) of one persistence."""
    out = [0.0]
    for d in range(1, kmax + 1):
        out.append(out[-1] + (1 / d if p >= 1 else (1 - p) * p ** (d - 1) / d))
    return out


def rbo(base: DataFrame, other: DataFrame, ks: Sequence[int], ps: Sequence[float],
        tie: str = "docno_desc", per_query: bool = False) -> DataFrame:
    """Rank-biased overlap (extrapolated) of ``other`` against ``base``
    per query, for every (k, p); mean over the union of queries where a
    query missing on either side scores 0 (J4)."""
    kmax = max(ks)
    both = base.select("qid", "did", "score", F.lit(0).alias("_side")).unionByName(
        other.select("qid", "did", "score", F.lit(1).alias("_side")))
    top = top_k(both, ["_side", "qid"], score_order("score", tie), kmax, "_r")
    # a document that a run repeats counts with its best rank
    rank = lambda side: F.min(F.when(F.col("_side") == side, F.col("_r")))
    rows = lambda side: F.count_if(F.col("_side") == side)
    docs = top.groupBy("qid", "did").agg(rank(0).alias("_ra"), rank(1).alias("_rb"), rows(0).alias("_na"), rows(1).alias("_nb"))
    lists = docs.groupBy("qid").agg(
        F.sum("_na").alias("_na"), F.sum("_nb").alias("_nb"),
        F.array_sort(F.collect_list(F.when(F.col("_ra").isNotNull() & F.col("_rb").isNotNull(), F.greatest("_ra", "_rb")))).alias("_m"))
    sums = {float(p): F.array(*[F.lit(x) for x in _prefix_sums(kmax, float(p))]) for p in ps}
    lists = lists.withColumns({f"_h{i}": h for i, h in enumerate(sums.values())})

    def cell(k: int, p: float, h: str) -> Column:
        depth = F.least("_na", "_nb", F.lit(k)).cast("int")
        shared = F.filter("_m", lambda m: m <= depth)
        total = F.aggregate(shared, F.lit(0.0), lambda acc, m: acc + F.get(h, depth) - F.get(h, m.cast("int") - 1))
        value = total / depth if p >= 1 else total + F.size(shared) / depth * F.pow(F.lit(p), depth)
        return F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), F.when(depth > 0, value).otherwise(F.lit(0.0)).alias("rbo"))

    cells = F.explode(F.array(*[cell(int(k), p, f"_h{i}") for k in ks for i, p in enumerate(sums)]))
    full = lists.select("qid", cells.alias("_c")).select("qid", "_c.*")
    if per_query:
        return full
    return full.groupBy("k", "p").agg(F.avg("rbo").alias("rbo"))


def paired_scores(evals: DataFrame, base: str, other: str) -> DataFrame:
    """Per (metric, qid) the two systems' values, common queries only."""
    a = evals.where(F.col("system") == base).select("metric", "qid", F.col("value").alias("a"))
    b = evals.where(F.col("system") == other).select("metric", "qid", F.col("value").alias("b"))
    return a.join(b, ["metric", "qid"])


def all_pairs(systems: DataFrame, col: str = "system") -> DataFrame:
    """Unordered pairs of distinct systems (a small, distinct list)."""
    s = systems.select(col).distinct()
    return s.alias("x").join(s.alias("y"), F.col(f"x.{col}") < F.col(f"y.{col}")) \
        .select(F.col(f"x.{col}").alias("sys_a"), F.col(f"y.{col}").alias("sys_b"))


def win_tie_loss(evals: DataFrame, base: str, threshold: float = 0.1) -> DataFrame:
    """Per system and metric, queries where it wins / ties / loses
    against the base: win iff (b - a) > a·t, loss iff (a - b) > a·t."""
    a = evals.where(F.col("system") == base).select("metric", "qid", F.col("value").alias("a"))
    o = evals.where(F.col("system") != base)
    j = o.join(a, ["metric", "qid"])
    win = (F.col("value") - F.col("a")) > F.col("a") * threshold
    loss = (F.col("a") - F.col("value")) > F.col("a") * threshold
    return j.groupBy("system", "metric").agg(F.count_if(win).alias("win"),
                                             F.count_if(~win & ~loss).alias("tie"),
                                             F.count_if(loss).alias("loss"))


def above_below_same(evals: DataFrame, base: str) -> DataFrame:
    """Strict comparison counts per system and metric."""
    a = evals.where(F.col("system") == base).select("metric", "qid", F.col("value").alias("a"))
    j = evals.where(F.col("system") != base).join(a, ["metric", "qid"])
    return j.groupBy("system", "metric").agg(F.count_if(F.col("value") > F.col("a")).alias("above"),
                                             F.count_if(F.col("value") < F.col("a")).alias("below"),
                                             F.count_if(F.col("value") == F.col("a")).alias("same"))
