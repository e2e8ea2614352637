"""Cross validation over parameter settings.

Evaluations are long rows (params, metric, qid, value). Folds are a column
(``ntile(k)`` over the ordered query list - identical to contiguous k-fold;
or a seeded hash for shuffled folds). The training mean of a setting in a
fold is (total − fold sum) / (n − fold n): one aggregation per (params,
metric, fold), no per-fold recomputation over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import global_rank, top_k


def assign_folds(qids: DataFrame, k: int = 5, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """Fold number 1..k per query. Contiguous: the first n mod k folds are one
    larger (= ntile). Shuffled: contiguous over a seeded hash order."""
    order = [F.xxhash64(F.col("qid"), F.lit(seed)), F.col("qid")] if shuffle else [F.col("qid")]
    distinct = qids.select("qid").distinct()
    ranked = global_rank(distinct, order, "_pos")
    # ntile(k) on positions 1..n: the first (n mod k) tiles have one more row;
    # n joins in as a one-row aggregate (no driver round trip)
    n = distinct.agg(F.count("*").alias("_n"))
    j = ranked.crossJoin(F.broadcast(n))
    q = F.floor(F.col("_n") / k)
    r = F.col("_n") % k
    big = r * (q + 1)
    fold = F.when(F.col("_pos") <= big, F.floor((F.col("_pos") - 1) / (q + 1)) + 1) \
        .otherwise(F.floor((F.col("_pos") - 1 - big) / F.greatest(q, F.lit(1))) + r + 1)
    return j.select("qid", fold.cast("int").alias("fold"))


def cv_auto(evals: DataFrame, k: int = 5, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """Per fold and metric choose the setting with the best training
    mean (first listed, i.e. smallest params string, on ties); report its
    values on the fold's test queries. Output (metric, qid, fold, params,
    value)."""
    folds = assign_folds(evals.select("qid"), k, shuffle, seed)
    e = evals.join(folds, "qid")
    per_fold = e.groupBy("params", "metric", "fold").agg(F.sum("value").alias("_fs"), F.count("*").alias("_fn"))
    tot = per_fold.groupBy("params", "metric").agg(F.sum("_fs").alias("_ts"), F.sum("_fn").alias("_tn"))
    train = per_fold.join(tot, ["params", "metric"]).select(
        "params", "metric", "fold", F.try_divide(F.col("_ts") - F.col("_fs"), F.col("_tn") - F.col("_fn")).alias("train_mean"))
    train = train.where(F.col("train_mean").isNotNull())      # a setting seen in one fold only has no training value
    best = top_k(train, ["metric", "fold"], [F.col("train_mean").desc(), F.col("params")], 1, "_b").drop("_b")
    return e.join(best.select("metric", "fold", "params", "train_mean"), ["metric", "fold", "params"]) \
        .select("metric", "qid", "fold", "params", "train_mean", "value")


def params_from_path(path) -> tuple:
    """(params string, fold) from a path column: ``name=value`` tokens
    of the file stem, joined with '-', minus ``fold=``; fold default 'all'."""
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    toks = F.regexp_extract_all(stem, F.lit(r"([^-_/]+=[^-_/]+)"), 1)
    params = F.array_join(F.filter(toks, lambda t: ~t.startswith("fold=")), "-")
    fold = F.coalesce(F.try_element_at(F.filter(toks, lambda t: t.startswith("fold=")), F.lit(1)), F.lit("fold=all"))
    return params, F.substring_index(fold, "=", -1)


def cv_manual(train: DataFrame, test: DataFrame) -> DataFrame:
    """Folds given in the data: ``train`` and ``test`` are (params, fold,
    metric, qid, value); per (fold, metric) the best training mean picks
    the setting whose test values are reported."""
    tm = train.groupBy("fold", "metric", "params").agg(F.avg("value").alias("train_mean"))
    best = top_k(tm, ["fold", "metric"], [F.col("train_mean").desc(), F.col("params")], 1, "_b").drop("_b")
    return test.join(best, ["fold", "metric", "params"]).select("metric", "qid", "fold", "params", "train_mean", "value")


def cv_compose_run(chosen: DataFrame, runs: DataFrame, metric: str) -> DataFrame:
    """Per test query, the run lines of the setting chosen for ``metric``."""
    c = chosen.where(F.col("metric") == metric).select("qid", "params")
    return runs.join(c, ["qid", "params"])


def cv_report(chosen: DataFrame, evals: DataFrame, by_metric: str) -> DataFrame:
    """C4: under the settings chosen for ``by_metric``, the mean of every
    metric per fold (wide by metric)."""
    c = chosen.where(F.col("metric") == by_metric).select("qid", "fold", "params")
    j = evals.join(c, ["qid", "params"])
    return j.groupBy("fold", "params").pivot("metric").agg(F.avg("value"))


def load_grid(grid: DataFrame, evals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evaluations for every setting of the grid (left join on the params
    key) and the settings with no evaluation (anti join)."""
    found = grid.join(evals, "params", "inner")
    missing = grid.join(evals.select("params").distinct(), "params", "left_anti")
    return found, missing
