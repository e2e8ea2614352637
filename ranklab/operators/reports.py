"""Tables behind the reference's plots (V1-V7); rendering is not built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .rank import rank_rows


def eval_wide(evals: DataFrame, metrics: Sequence[str], sample: float | None = None,
              seed: int = 0, base: str | None = None) -> DataFrame:
    """V1: one column per metric, per (system, qid). ``sample`` (fraction <
    1 or a number) picks queries of the base system by a seeded hash; the
    others are aligned to the same queries."""
    e = evals.where(F.col("metric").isin(list(metrics)))
    if sample is not None:
        b = base or e.select(F.min("system")).first()[0]
        q = e.where(F.col("system") == b).select("qid").distinct()
        h = F.xxhash64(F.col("qid"), F.lit(seed))
        if sample < 1:
            q = q.where(F.pmod(h, F.lit(1_000_000)) < int(sample * 1_000_000))
        else:
            from .rank import global_rank
            q = global_rank(q, [h, F.col("qid")], "_p").where(F.col("_p") <= int(sample)).select("qid")
        e = e.join(q, "qid", "left_semi")
    return e.groupBy("system", "qid").pivot("metric", list(metrics)).agg(F.first("value"))


def delta_table(evals: DataFrame, base: str, metric: str, overlapped: bool = False) -> DataFrame:
    """V2: per-query difference to the base system with a Good/Bad flag
    (Bad iff < 0), ordered. ``overlapped``: zero deltas dropped, absolute
    values, position within each flag."""
    e = evals.where(F.col("metric") == metric)
    b = e.where(F.col("system") == base).select("qid", F.col("value").alias("_b"))
    d = e.where(F.col("system") != base).join(b, "qid").select(
        "system", "qid", (F.col("value") - F.col("_b")).alias("delta"))
    d = d.withColumn("flag", F.when(F.col("delta") < 0, "Bad").otherwise("Good"))
    if not overlapped:
        return rank_rows(d, ["system"], [F.round("delta", 9).desc(), F.col("qid")], "position")
    d = d.where(F.col("delta") != 0).withColumn("delta", F.abs("delta"))
    return rank_rows(d, ["system", "flag"], [F.round("delta", 9).desc(), F.col("qid")], "position")


def value_histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ("system",),
                    stat: str = "count") -> DataFrame:
    """V3: equal-width bins between the group's min and max (last bin closed
    on the right); ``stat``: count, frequency (count / width), probability
    (count / n) or density (probability / width)."""
    by = list(by)
    mm = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"), F.count("*").alias("_n"))
    j = df.join(mm, by) if by else df.crossJoin(mm)
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(
        F.least(F.floor(F.try_divide(F.col(col) - F.col("_lo"), width)), F.lit(bins - 1))).cast("int")
    h = j.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("count"), F.first("_lo").alias("_lo"),
                                           F.first("_hi").alias("_hi"), F.first("_n").alias("_n"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    val = {"count": F.col("count"), "frequency": F.when(w > 0, F.col("count") / w).otherwise(F.lit(None)),
           "probability": F.col("count") / F.col("_n"),
           "density": F.when(w > 0, F.col("count") / F.col("_n") / w).otherwise(F.lit(None))}[stat]
    return h.select(*by, "bin", (F.col("_lo") + F.col("bin") * w).alias("left"),
                    (F.col("_lo") + (F.col("bin") + 1) * w).alias("right"), "count", val.alias(stat)) \
        if stat not in ("count",) else h.select(*by, "bin", (F.col("_lo") + F.col("bin") * w).alias("left"),
                                                (F.col("_lo") + (F.col("bin") + 1) * w).alias("right"), "count")


def percentile_annotations(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = ("system",), bins: int = 10) -> DataFrame:
    """V4: per group the value at each percentile (``p{q}``, exact, linear) and the
    height of its bin (``h{q}``) among ``bins`` of equal width."""
    from .quantiles import quantiles
    by = list(by)
    p = quantiles(df, col, [q / 100.0 for q in qs], by)
    h = value_histogram(df.where(F.col(col).isNotNull()), col, bins, by).select(*by, "bin", "left", "right", "count")
    rows = h.groupBy(*by).agg(F.min("left").alias("_lo"), F.max("right").alias("_hi"),
                              F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("_h"))        # one entry per bin
    same = F.lit(True)
    for k in by:
        same = same & p[k].eqNullSafe(rows[k])
    j = p.join(rows, same).select(*[p[k] for k in by], "q", "_lo", "_hi", "_h")
    width = (F.col("_hi") - F.col("_lo")) / bins
    out = []
    for i, q in enumerate(qs):
        v = F.col("q")[i]
        place = F.when(width > 0, F.least(F.floor((v - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
        out += [v.alias(f"p{int(q)}"), F.coalesce(F.try_element_at("_h", place), F.lit(0)).alias(f"h{int(q)}")]
    return j.select(*by, *out)


def score_distribution_by_rel(runs: DataFrame, qrels: DataFrame, bins: int = 10,
                              binarize: bool = True) -> DataFrame:
    """V5: run scores with their grades (missing 0, optionally binarised),
    histogram per system x grade (probability)."""
    j = runs.join(qrels.select("qid", "did", "rel"), ["qid", "did"], "left") \
        .withColumn("rel", F.coalesce("rel", F.lit(0)))
    if binarize:
        j = j.withColumn("rel", F.when(F.col("rel") > 0, 1).otherwise(0))
    return value_histogram(j.withColumn("score", F.col("score").cast("double")), "score", bins,
                           ("system", "rel"), "probability")


def rank_flow(runs: DataFrame, k: int, systems: Sequence[str] | None = None) -> DataFrame:
    """V6: number of documents per tuple of ranks across systems, all <= k."""
    from .select import rank_alignment
    wide = rank_alignment(runs, k, systems=systems)
    systems = [c for c in wide.columns if c not in ("qid", "did")]
    return wide.groupBy(*systems).agg(F.count("*").alias("count"))


def _boxes(evals: DataFrame) -> DataFrame:
    """Rows with the quartiles of their system and metric; ``inside``: within 1.5 IQR."""
    from .quantiles import quantiles
    q = quantiles(evals, "value", [0.25, 0.5, 0.75], ["system", "metric"])
    q = broadcast_if_small(q.select("system", "metric", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")))
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return evals.join(q, ["system", "metric"]).withColumn("inside", (F.col("value") >= lo) & (F.col("value") <= hi))


def box_stats(evals: DataFrame) -> DataFrame:
    """V7: quartiles, whiskers (1.5 IQR, clipped to data) and outlier count
    per system x metric."""
    return _boxes(evals).groupBy("system", "metric", "q1", "median", "q3").agg(
        F.min(F.when(F.col("inside"), F.col("value"))).alias("whisker_lo"),
        F.max(F.when(F.col("inside"), F.col("value"))).alias("whisker_hi"),
        F.count_if(~F.col("inside")).alias("n_outliers"))


def box_outliers(evals: DataFrame) -> DataFrame:
    """V7: the rows beyond the whiskers; ``side`` is low or high."""
    out = _boxes(evals).where(~F.col("inside"))
    return out.select(*evals.columns, F.when(F.col("value") < F.col("q1"), "low").otherwise("high").alias("side"))
