"""Ranking metrics (M1-M14) and the measure registry.

Plan of :func:`evaluate`:

    run ⟕ qrels  (AQE: runtime broadcast when the judged side is small)
      → rank per list        (top-k with WindowGroupLimit when every measure
                              has a cut-off; else the skew-aware full ranker)
      → ONE groupBy(list key) computing every measure as a column
      → join the per-query judgment summary (R, ideal DCGs; one row per qid)
      → unpivot to (…, metric, value, residual)

The window and the groupBy share one hash partitioning on the list key, so
the whole evaluation is one shuffle of the run (plus the small qrels side).

Measure names (N1), all case sensitive:

* trec_eval family (ideal and R from all judgments, relevant = grade > 0):
  ``P_k``, ``recip_rank``, ``recip_rank_cut_k``, ``map``, ``map_cut_k``,
  ``ndcg``, ``ndcg_cut_k``
* gdeval family (exponential gain, ideal from positive grades, topics with a
  positive grade only): ``gdeval_ndcg@k``, ``gdeval_err@k``; ``gdeval@k`` and
  ``gdeval`` (k = 20) are both
* rank-biased precision with residual: ``rbp@p`` or ``rbp@p:b`` (b = minimum
  grade counted relevant, default 1)
* library forms on the list as retrieved (relevant = grade != 0):
  ``ap_retrieved``, ``rprec_lib``, ``dcg_lib@k:m``, ``ndcg_lib@k:m``
  (m = 0: r1 + Σ r_i/log2 i; m = 1: Σ r_i/log2(i+1)).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import rank_rows, score_order, top_k

MAX_JUDGMENT = 4  # gdeval's maximum grade (ERR normaliser 2^4)


@dataclass(frozen=True)
class Measure:
    name: str
    kind: str
    k: int | None = None      # cut-off; None = whole list
    p: float | None = None    # RBP persistence
    b: int = 1                # RBP minimum grade
    method: int = 1           # library DCG method


_PATTERNS = [
    (r"P_(\d+)", lambda m: dict(kind="P", k=int(m[1]))),
    (r"P@(\d+)", lambda m: dict(kind="P", k=int(m[1]))),
    (r"recip_rank", lambda m: dict(kind="RR")),
    (r"recip_rank_cut_(\d+)", lambda m: dict(kind="RR", k=int(m[1]))),
    (r"map", lambda m: dict(kind="AP")),
    (r"map_cut_(\d+)", lambda m: dict(kind="AP", k=int(m[1]))),
    (r"ndcg", lambda m: dict(kind="NDCG")),
    (r"ndcg_cut_(\d+)", lambda m: dict(kind="NDCG", k=int(m[1]))),
    (r"gdeval_ndcg@(\d+)", lambda m: dict(kind="GD_NDCG", k=int(m[1]))),
    (r"gdeval_err@(\d+)", lambda m: dict(kind="GD_ERR", k=int(m[1]))),
    (r"rbp@([0-9.]+)(?::(-?\d+))?", lambda m: dict(kind="RBP", p=float(m[1]), b=int(m[2] or 1))),
    (r"ap_retrieved", lambda m: dict(kind="AP_LIB")),
    (r"rprec_lib", lambda m: dict(kind="RPREC_LIB")),
    (r"dcg_lib@(\d+)(?::([01]))?", lambda m: dict(kind="DCG_LIB", k=int(m[1]), method=int(m[2] or 0))),
    (r"ndcg_lib@(\d+)(?::([01]))?", lambda m: dict(kind="NDCG_LIB", k=int(m[1]), method=int(m[2] or 0))),
]


def parse_measure(name: str) -> Measure:
    for pat, build in _PATTERNS:
        m = re.fullmatch(pat, name)
        if m:
            return Measure(name=name, **build(m))
    raise ValueError(f"unknown measure {name!r}")


GDEVAL_CUT = 20          # depth of a bare ``gdeval``


def expand_measures(names: list[str]) -> list[str]:
    """``gdeval`` and ``gdeval@k`` stand for both gdeval measures; each measure once."""
    out = []
    for n in names:
        both = re.fullmatch(r"gdeval(?:@(\d+))?", n)
        out += [f"gdeval_{x}@{both.group(1) or GDEVAL_CUT}" for x in ("ndcg", "err")] if both else [n]
    return list(dict.fromkeys(out))


# ---------------------------------------------------------------------------
# Column builders (per-row contributions; aggregated per list)
# ---------------------------------------------------------------------------

def _log2(x: Column) -> Column:
    return F.log2(x)


def _cut(k: int | None) -> Column:
    return F.lit(True) if k is None else (F.col("rank") <= k)


def _gain_lin() -> Column:
    return F.greatest(F.coalesce(F.col("rel"), F.lit(0)), F.lit(0))


def _gain_exp() -> Column:
    return F.pow(F.lit(2.0), _gain_lin()) - 1


def _err_r() -> Column:
    """Stop probability of a grade; grades above gdeval's maximum stop the job,
    as they do there."""
    return F.when(_gain_lin() > MAX_JUDGMENT, F.raise_error(F.concat(F.lit(f"gdeval takes grades up to {MAX_JUDGMENT}, got "), F.col("rel").cast("string")))
                  .cast("double")).otherwise(_gain_exp() / float(2 ** MAX_JUDGMENT))


def _relevant() -> Column:
    return F.coalesce(F.col("rel") > 0, F.lit(False))


def _nonzero() -> Column:
    return F.coalesce(F.col("rel") != 0, F.lit(False))


def _lib_dcg_term(method: int, rank: Column, g: Column) -> Column:
    if method == 0:
        return F.when(rank == 1, g).otherwise(g / _log2(rank.cast("double")))
    return g / _log2(rank + 1.0)


def _measure_aggs(m: Measure) -> dict[str, Column]:
    """Aggregate columns (per list) that the measure needs."""
    rank = F.col("rank")
    k = m.k
    n = m.name
    if m.kind == "P":
        return {f"{n}#v": F.sum(F.when(_cut(k) & _relevant(), 1.0).otherwise(0.0)) / float(k)}
    if m.kind == "RR":
        return {f"{n}#v": F.coalesce(F.max(F.when(_cut(k) & _relevant(), 1.0 / rank)), F.lit(0.0))}
    if m.kind == "AP":
        return {f"{n}#s": F.sum(F.when(_cut(k) & _relevant(), F.col("_hits") / rank).otherwise(0.0))}
    if m.kind == "NDCG":
        return {f"{n}#s": F.sum(F.when(_cut(k), _gain_lin() / _log2(rank + 1.0)).otherwise(0.0))}
    if m.kind == "GD_NDCG":
        return {f"{n}#s": F.sum(F.when(_cut(k), _gain_exp() / _log2(rank + 1.0)).otherwise(0.0))}
    if m.kind == "GD_ERR":
        decay = F.exp(F.col("_lnd") - F.log(1.0 - _err_r()))
        return {f"{n}#v": F.sum(F.when(_cut(k), _err_r() * decay / rank).otherwise(0.0))}
    if m.kind == "RBP":
        p = m.p
        wgt = (1.0 - p) * F.pow(F.lit(p), rank - 1.0)
        return {f"{n}#v": F.sum(F.when(F.coalesce(F.col("rel") >= m.b, F.lit(False)), wgt).otherwise(0.0)),
                f"{n}#u": F.sum(F.when(F.col("rel").isNull(), wgt).otherwise(0.0)),
                f"{n}#n": F.count("*")}
    if m.kind == "AP_LIB":
        return {f"{n}#s": F.sum(F.when(_nonzero(), F.col("_nz") / rank).otherwise(0.0)),
                f"{n}#c": F.count_if(_nonzero())}
    if m.kind == "RPREC_LIB":
        return {f"{n}#c": F.count_if(_nonzero()), f"{n}#l": F.max(F.when(_nonzero(), rank))}
    if m.kind in ("DCG_LIB", "NDCG_LIB"):
        g = F.coalesce(F.col("rel"), F.lit(0)).cast("double")
        return {f"{n}#s": F.sum(F.when(_cut(k), _lib_dcg_term(m.method, rank, g)).otherwise(0.0))}
    raise ValueError(m.kind)


def _measure_value(m: Measure) -> tuple[Column, Column | None]:
    """Final (value, residual) from aggregates and the per-query summary."""
    n = m.name
    col = lambda s: F.col(f"`{n}#{s}`")
    if m.kind in ("P", "RR", "GD_ERR"):
        v = col("v")
        if m.kind == "GD_ERR":
            v = F.when(F.col("_has_pos"), v)
        return v, None
    if m.kind == "AP":
        return F.when(F.col("_R") > 0, col("s") / F.col("_R")).otherwise(0.0), None
    if m.kind == "NDCG":
        ideal = F.col(f"`_idcg_lin_{m.k}`") if m.k else F.col("_idcg_lin_all")
        return F.when(ideal > 0, col("s") / ideal).otherwise(0.0), None
    if m.kind == "GD_NDCG":
        ideal = F.col(f"`_idcg_exp_{m.k}`")
        return F.when(F.col("_has_pos"), F.when(ideal > 0, col("s") / ideal).otherwise(0.0)), None
    if m.kind == "RBP":
        res = col("u") + F.pow(F.lit(m.p), col("n").cast("double"))
        return col("v"), res
    if m.kind == "AP_LIB":
        return F.when(col("c") > 0, col("s") / col("c")).otherwise(0.0), None
    if m.kind == "RPREC_LIB":
        return F.when(col("c") > 0, col("c") / col("l")).otherwise(0.0), None
    if m.kind == "DCG_LIB":
        return col("s"), None
    if m.kind == "NDCG_LIB":
        ideal = F.col(f"`_ilib_{m.k}_{m.method}`")
        return F.when(ideal != 0, col("s") / ideal).otherwise(0.0), None
    raise ValueError(m.kind)


# ---------------------------------------------------------------------------
# Judgment summary: one row per query
# ---------------------------------------------------------------------------

def qrels_summary(qrels: DataFrame, measures: list[Measure]) -> DataFrame:
    """Per query: number of relevant documents R, whether any grade is
    positive, and the ideal DCGs the measures need (from all judgments)."""
    lin_cuts = sorted({m.k for m in measures if m.kind == "NDCG" and m.k})
    lin_all = any(m.kind == "NDCG" and not m.k for m in measures)
    exp_cuts = sorted({m.k for m in measures if m.kind == "GD_NDCG"})
    kmax = max(lin_cuts + exp_cuts, default=0)
    aggs = [F.count_if(F.col("rel") > 0).alias("_R"), F.bool_or(F.col("rel") > 0).alias("_has_pos")]
    if not (lin_cuts or exp_cuts or lin_all):
        return qrels.groupBy("qid").agg(*aggs)
    pos = qrels.where(F.col("rel") > 0)
    order = [F.col("rel").desc(), F.col("did")]
    if lin_all:
        ranked = rank_rows(pos, ["qid"], order, "rank")
    else:
        ranked = top_k(pos, ["qid"], order, kmax, "rank")
    disc = _log2(F.col("rank") + 1.0)
    lin = F.col("rel").cast("double") / disc
    expg = (F.pow(F.lit(2.0), F.col("rel")) - 1) / disc
    ideal = [F.sum(F.when(F.col("rank") <= k, lin).otherwise(0.0)).alias(f"_idcg_lin_{k}") for k in lin_cuts]
    ideal += [F.sum(F.when(F.col("rank") <= k, expg).otherwise(0.0)).alias(f"_idcg_exp_{k}") for k in exp_cuts]
    if lin_all:
        ideal.append(F.sum(lin).alias("_idcg_lin_all"))
    ideals = ranked.groupBy("qid").agg(*ideal)
    base = qrels.groupBy("qid").agg(*aggs)
    return base.join(ideals, "qid", "left").na.fill(0.0)


# ---------------------------------------------------------------------------
# evaluate (M14)
# ---------------------------------------------------------------------------

def list_keys(run: DataFrame) -> list[str]:
    return [c for c in ("system", "qid", "vid") if c in run.columns]


def _library_ideals(judged: DataFrame, keys: list[str], forms: list[tuple[int, int]]) -> DataFrame:
    """Ideal library DCG of each list for (cut-off, method) pairs, from its counts
    of grades: the documents of one grade take consecutive ranks, so each grade
    adds itself times a difference of discount sums, and nothing is sorted but a
    list's distinct grades."""
    counts = judged.groupBy(*keys, F.coalesce(F.col("rel"), F.lit(0)).alias("_g")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.col("_g").desc()).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_to", F.sum("_n").over(w)).withColumn("_from", F.col("_to") - F.col("_n"))
    sums = []
    for k, method in forms:
        total = [0.0]
        for i in range(1, k + 1):
            total.append(total[-1] + (1.0 / math.log2(i + 1) if method else 1.0 if i == 1 else 1.0 / math.log2(i)))
        table = F.array(*[F.lit(x) for x in total])
        upto = lambda c: F.get(table, F.least(F.col(c), F.lit(k)).cast("int"))  # noqa: B023, E731
        sums.append(F.sum(F.col("_g") * (upto("_to") - upto("_from"))).alias(f"_ilib_{k}_{method}"))
    return counts.groupBy(*keys).agg(*sums)


def topic_id(qid: Column) -> Column:
    """M7: gdeval's topic of an id, the text after its last ``-``."""
    return F.substring_index(qid.cast("string"), "-", -1)


def _cut_only(measures: list[Measure]) -> int | None:
    """Largest cut-off when every measure only looks at the first k ranks."""
    full = {"RBP", "AP_LIB", "RPREC_LIB"}
    if any(m.kind in full or m.k is None for m in measures):
        return None
    return max(m.k for m in measures)


def judge(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """J1 as used by the metrics: grade per retrieved document, null when
    unjudged (kept null so RBP can count it as residual)."""
    return run.join(qrels.select("qid", "did", "rel"), ["qid", "did"], "left")


def evaluate_wide(run: DataFrame, qrels: DataFrame, measures: list[str],
                  tie: str = "docno_desc", keys: list[str] | None = None) -> DataFrame:
    """Per list (system?, qid, vid?): one column per measure (and
    ``<name>_res`` for RBP residuals). Queries absent from qrels are dropped
    (trec_eval); gdeval measures are null for queries without a positive
    grade."""
    measures = expand_measures(measures)
    ms = [parse_measure(x) for x in measures]
    keys = list(keys) if keys else list_keys(run)
    judged = judge(run.select(*keys, "did", "score"), qrels)
    order = score_order("score", tie)
    need_hits = any(m.kind == "AP" for m in ms)
    need_nz = any(m.kind == "AP_LIB" for m in ms)
    need_lnd = any(m.kind == "GD_ERR" for m in ms)
    running: dict[str, Column] = {}
    if need_hits:
        running["_hits"] = F.when(_relevant(), 1).otherwise(0)
    if need_nz:
        running["_nz"] = F.when(_nonzero(), 1).otherwise(0)
    if need_lnd:
        running["_lnd"] = F.log(1.0 - _err_r())
    kcut = _cut_only(ms)
    if kcut is not None:
        ranked = top_k(judged, keys, order, kcut, "rank")
        if running:
            w = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
            for name, expr in running.items():
                ranked = ranked.withColumn(name, F.sum(expr).over(w))
    else:
        from ..operators.rank import hot_groups
        hot = hot_groups(run, keys)  # detected on the run, before the join
        ranked = rank_rows(judged, keys, order, "rank", running, hot=hot)

    aggs: dict[str, Column] = {}
    for m in ms:
        aggs.update(_measure_aggs(m))
    per_list = ranked.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])

    # library NDCG: ideal of the retrieved list re-sorted by grade
    lib = sorted({(m.k, m.method) for m in ms if m.kind == "NDCG_LIB"})
    if lib:
        per_list = per_list.join(_library_ideals(judged, keys, lib), keys, "left")

    summary = qrels_summary(qrels, ms)
    per_list = per_list.join(summary, "qid", "inner")
    out = [F.col(k) for k in keys]
    for m in ms:
        v, res = _measure_value(m)
        out.append(v.cast("double").alias(m.name))
        if res is not None:
            out.append(res.cast("double").alias(f"{m.name}_res"))
    return per_list.select(*out)


def evaluate(run: DataFrame, qrels: DataFrame, measures: list[str],
             tie: str = "docno_desc", topics: str = "run", queries: DataFrame | None = None,
             gdeval_topics: bool = False) -> DataFrame:
    """Long table (keys…, metric, value, residual).

    ``queries`` (qid, or system and qid): those of them that a run has no list
    for, say because a filter left no variant, score 0 under their own id.
    ``gdeval_topics`` reads ids of runs and judgments as gdeval does, by
    :func:`topic_id`.

    ``topics="run"`` scores queries in run ∩ qrels; ``"qrels"`` (M10) also
    gives every judged query missing from a system's run the value 0."""
    measures = expand_measures(measures)
    ms = [parse_measure(x) for x in measures]
    if gdeval_topics:
        run, qrels = run.withColumn("qid", topic_id(F.col("qid"))), qrels.withColumn("qid", topic_id(F.col("qid")))
        queries = queries if queries is None else queries.withColumn("qid", topic_id(F.col("qid")))
    wide = evaluate_wide(run, qrels, measures, tie)
    keys = list_keys(run)
    pairs = []
    for m in ms:
        res = f"`{m.name}_res`" if m.kind == "RBP" else "CAST(NULL AS DOUBLE)"
        pairs.append(f"'{m.name}', `{m.name}`, {res}")
    expr = f"stack({len(ms)}, {', '.join(pairs)}) AS (metric, value, residual)"
    long = wide.selectExpr(*keys, expr).where(F.col("value").isNotNull())
    if queries is not None:
        long = long.unionByName(_without_list(run, queries, keys, ms))
    if topics == "qrels":
        long = fill_missing_topics(long, qrels, ms)
    return long


def _without_list(run: DataFrame, queries: DataFrame, keys: list[str], ms: list[Measure]) -> DataFrame:
    """Rows of value 0 for the queries that a run has no list for."""
    ids = ["system", "qid"] if "system" in keys else ["qid"]
    asked = queries.select(*[c for c in ids if c in queries.columns]).distinct()
    if "system" in keys and "system" not in queries.columns:
        asked = run.select("system").distinct().crossJoin(asked)        # systems are few
    none = asked.select(*ids).join(run.select(*ids).distinct(), ids, "left_anti")
    metric = F.explode(F.array(*[F.lit(m.name) for m in ms])).alias("metric")
    own = {"vid": F.col("qid").cast("string").alias("vid")}
    return none.select(*[own.get(k, F.col(k)) for k in keys], metric).withColumns(
        {"value": F.lit(0.0), "residual": F.lit(None).cast("double")})


def fill_missing_topics(long: DataFrame, qrels: DataFrame, ms: list[Measure]) -> DataFrame:
    """Every (system, metric) gets every topic of the qrels (gdeval:
    topics with a positive grade); a missing topic scores 0."""
    if "system" not in long.columns:
        long = long.withColumn("system", F.lit(None).cast("string"))
    topics = qrels.groupBy("qid").agg(F.bool_or(F.col("rel") > 0).alias("_pos"))
    gd = [m.name for m in ms if m.kind.startswith("GD_")]
    sm = long.select("system", "metric").distinct()
    grid = sm.crossJoin(topics).where(~F.col("metric").isin(gd) | F.col("_pos")).drop("_pos")
    return (grid.join(long, ["system", "metric", "qid"], "left")
            .select("system", "metric", "qid", F.coalesce("value", F.lit(0.0)).alias("value"), "residual"))


def eval_mean(long: DataFrame) -> DataFrame:
    """Mean per (system, metric) over queries (the ``all`` row)."""
    keys = [c for c in ("system", "metric") if c in long.columns]
    return long.groupBy(*keys).agg(F.avg("value").alias("value"), F.avg("residual").alias("residual"),
                                   F.count("*").alias("n_topics"))


def risk_sensitive(evals: DataFrame, baseline: str, alpha: float = 1.0) -> DataFrame:
    """M9: per topic delta to the baseline system; losses weighted by
    (1 + alpha). Topics the baseline lacks compare against 0."""
    base = evals.where(F.col("system") == baseline).select("metric", "qid", F.col("value").alias("_b"))
    d = evals.where(F.col("system") != baseline).join(base, ["metric", "qid"], "left") \
        .withColumn("_b", F.coalesce("_b", F.lit(0.0)))
    delta = F.col("value") - F.col("_b")
    return d.select("system", "metric", "qid",
                    F.when(F.col("value") < F.col("_b"), (1 + alpha) * delta).otherwise(delta).alias("value"))


# ---------------------------------------------------------------------------
# Library metrics on an explicit grade list (doctest goldens)
# ---------------------------------------------------------------------------

def grades_to_run(spark, lists: dict[str, list[int]]) -> tuple[DataFrame, DataFrame]:
    """(run, qrels) frames for explicit grade lists: document i of list q is
    ranked i with the grade given (helper for tests and examples)."""
    rows = [(q, i, float(len(g) - i), int(r)) for q, g in lists.items() for i, r in enumerate(g)]
    run = spark.createDataFrame([(q, i, s) for q, i, s, _ in rows], "qid string, did long, score double")
    qrels = spark.createDataFrame([(q, i, r) for q, i, _, r in rows], "qid string, did long, rel int")
    return run, qrels
