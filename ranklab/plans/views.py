"""Derived views over the given tables, as DataFrames and as SQL text.

The ranked-list world (runs, judgments, variants, spam scores, queries,
corpus) is derived from the TPC-H-ish tables so that every view grows with
the data. The same definitions exist twice: as DataFrame code (what a user
would write) and as ANSI SQL (the DuckDB twin used by the oracle check).

* ``run_a``/``run_b``/``run_c``: one ranked list per supplier (qid) over
  parts (did); scores in integer cents, ``run_c`` deliberately full of ties.
* ``qrels``: pairs with at least one finished line (``l_linestatus='F'``)
  are judged; grade = number of returned lines, capped at 3.
* ``variants``: the original query (vid = qid) plus one variant per return
  flag (A→1, N→2, R→3), each scored over its own lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Bytes of lineitem's files a partition of :func:`_lines` holds, and partitions at most
# (a larger table takes ``spark.sql.shuffle.partitions``, if that is more).
LINES_BYTES = 4 << 20
LINES_PARTITIONS = 8192


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dealt by supplier and part, the key of every list and judgment: their
    aggregations and joins need no other shuffle, and a task's share is fixed, where
    AQE would merge partitions up to its advisory size. Small tables stay as they are."""
    from ..session import conf_int, estimated_bytes
    lines = table(spark, sf_dir, "lineitem")
    n = estimated_bytes(lines) // LINES_BYTES
    if n <= spark.sparkContext.defaultParallelism:
        return lines
    n = min(n, max(LINES_PARTITIONS, conf_int(spark, "spark.sql.shuffle.partitions", 200)))
    return lines.repartition(n, "l_suppkey", "l_partkey")


# Score expressions of the three systems (integer cents: exact in any engine).
_SCORE = {
    "a": lambda: F.round(F.col("l_extendedprice") * 100).cast("bigint"),
    "b": lambda: F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint"),
    "c": lambda: F.col("l_quantity").cast("bigint"),
}
_SCORE_SQL = {
    "a": "CAST(round(l_extendedprice * 100) AS BIGINT)",
    "b": "CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)",
    "c": "CAST(l_quantity AS BIGINT)",
}


def run(spark: SparkSession, sf_dir: str, system: str = "a") -> DataFrame:
    return (_lines(spark, sf_dir)
            .groupBy(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("did"))
            .agg(F.sum(_SCORE[system]()).alias("score")))


def runs(spark: SparkSession, sf_dir: str, systems=("a", "b", "c")) -> DataFrame:
    """All systems stacked with a ``system`` key, from ONE scan and ONE
    aggregation of lineitem (each system is a column of the same groupBy)."""
    agg = (_lines(spark, sf_dir)
           .groupBy(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("did"))
           .agg(*[F.sum(_SCORE[s]()).alias(f"s_{s}") for s in systems]))
    stack = ", ".join(f"'{s}', s_{s}" for s in systems)
    return agg.selectExpr(f"stack({len(systems)}, {stack}) AS (system, score)", "qid", "did")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_lines(spark, sf_dir)
            .groupBy(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("did"))
            .agg(F.least(F.count_if(F.col("l_returnflag") == "R"), F.lit(3)).cast("int").alias("rel"),
                 F.bool_or(F.col("l_linestatus") == "F").alias("_judged"))
            .where("_judged").drop("_judged"))


def _flag_no():
    return F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir)
    per_flag = (li.groupBy(F.col("l_suppkey").alias("qid"), _flag_no().alias("v"),
                           F.col("l_partkey").alias("did"))
                .agg(F.sum(_SCORE["a"]()).alias("score")))
    orig = (per_flag.groupBy("qid", "did").agg(F.sum("score").alias("score"))
            .select("qid", F.col("qid").cast("string").alias("vid"), "did", "score"))
    var = per_flag.select("qid", F.concat_ws("-", F.col("qid").cast("string"), F.col("v").cast("string")).alias("vid"),
                          "did", "score")
    return orig.unionByName(var)


def variant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted quality per variant (the 'scores' input of variant fusion):
    mean discount of the variant's lines, in integer basis points."""
    li = _lines(spark, sf_dir)
    per = (li.groupBy(F.col("l_suppkey").alias("qid"), _flag_no().alias("v"))
           .agg(F.sum(F.round(F.col("l_discount") * 10000).cast("bigint")).alias("s"),
                F.count("*").alias("n")))
    var = per.select("qid", F.concat_ws("-", F.col("qid").cast("string"), F.col("v").cast("string")).alias("vid"),
                     (F.col("s") / F.col("n")).alias("vscore"))
    orig = per.groupBy("qid").agg((F.sum("s") / F.sum("n")).alias("vscore")) \
        .select("qid", F.col("qid").cast("string").alias("vid"), "vscore")
    return orig.unionByName(var)


def spam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("did"),
                                              (F.col("p_size") * 2).cast("int").alias("spam"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents; text work is per-row heavy, so the scan is spread
    over the cluster when it arrives in too few partitions."""
    from ..session import ensure_parallelism
    return ensure_parallelism(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("did"), "text"))


# --------------------------------------------------------------------------
# SQL twins.
# --------------------------------------------------------------------------

def _run_sql(s: str) -> str:
    return (f"SELECT l_suppkey AS qid, l_partkey AS did, CAST(sum({_SCORE_SQL[s]}) AS BIGINT) AS score "
            "FROM lineitem GROUP BY l_suppkey, l_partkey")


_FLAG_SQL = "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END"

VIEW_SQL: dict[str, str] = {
    "run_a": _run_sql("a"),
    "run_b": _run_sql("b"),
    "run_c": _run_sql("c"),
    "runs": ("SELECT 'a' AS system, qid, did, score FROM run_a UNION ALL "
             "SELECT 'b' AS system, qid, did, score FROM run_b UNION ALL "
             "SELECT 'c' AS system, qid, did, score FROM run_c"),
    "qrels": ("SELECT l_suppkey AS qid, l_partkey AS did, "
              "CAST(least(count_if(l_returnflag = 'R'), 3) AS INTEGER) AS rel "
              "FROM lineitem GROUP BY l_suppkey, l_partkey HAVING bool_or(l_linestatus = 'F')"),
    "variants": ("SELECT qid, CAST(qid AS VARCHAR) AS vid, did, score FROM run_a UNION ALL "
                 f"SELECT l_suppkey AS qid, CAST(l_suppkey AS VARCHAR) || '-' || CAST({_FLAG_SQL} AS VARCHAR) AS vid, "
                 f"l_partkey AS did, CAST(sum({_SCORE_SQL['a']}) AS BIGINT) AS score "
                 f"FROM lineitem GROUP BY l_suppkey, {_FLAG_SQL}, l_partkey"),
    "variant_scores": ("SELECT l_suppkey AS qid, CAST(l_suppkey AS VARCHAR) AS vid, "
                       "sum(CAST(round(l_discount * 10000) AS BIGINT)) / count(*) AS vscore "
                       "FROM lineitem GROUP BY l_suppkey UNION ALL "
                       f"SELECT l_suppkey AS qid, CAST(l_suppkey AS VARCHAR) || '-' || CAST({_FLAG_SQL} AS VARCHAR) AS vid, "
                       "sum(CAST(round(l_discount * 10000) AS BIGINT)) / count(*) AS vscore "
                       f"FROM lineitem GROUP BY l_suppkey, {_FLAG_SQL}"),
    "spam": "SELECT p_partkey AS did, CAST(p_size * 2 AS INTEGER) AS spam FROM part",
    "queries": "SELECT item_id AS qid, text FROM benchmark",
    "corpus": "SELECT doc_id AS did, text FROM documents",
}

# Per-query evaluations of the three systems (P_10 and ndcg_cut_10, trec_eval
# tie rule), long format: the input of significance tests, CV and reports.
VIEW_SQL["evals"] = """WITH ranked AS (
    SELECT r.system, r.qid, q.rel,
           row_number() OVER (PARTITION BY r.system, r.qid ORDER BY r.score DESC, CAST(r.did AS VARCHAR) DESC) AS rank
    FROM runs r LEFT JOIN qrels q ON r.qid = q.qid AND r.did = q.did),
  per AS (
    SELECT system, qid,
           sum(CASE WHEN rank <= 10 AND rel > 0 THEN 1 ELSE 0 END) / 10.0 AS p10,
           sum(CASE WHEN rank <= 10 THEN greatest(coalesce(rel, 0), 0) / log2(rank + 1.0) ELSE 0 END) AS dcg10
    FROM ranked GROUP BY system, qid),
  ideal AS (
    SELECT qid, sum(rel / log2(rn + 1.0)) AS idcg
    FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, did) AS rn
          FROM qrels WHERE rel > 0) t
    WHERE rn <= 10 GROUP BY qid),
  base AS (
    SELECT p.system, p.qid, p.p10,
           CASE WHEN coalesce(i.idcg, 0) > 0 THEN p.dcg10 / i.idcg ELSE 0 END AS nd10
    FROM per p LEFT JOIN ideal i ON i.qid = p.qid
    WHERE p.qid IN (SELECT qid FROM qrels))
  SELECT system, 'P_10' AS metric, qid, p10 AS value FROM base
  UNION ALL
  SELECT system, 'ndcg_cut_10' AS metric, qid, nd10 AS value FROM base"""

# dependencies (a view must come after the ones it reads)
_DEPS = {"runs": ["run_a", "run_b", "run_c"], "variants": ["run_a"], "evals": ["runs", "qrels"]}


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark twin of the ``evals`` view, computed by the metric engine. It is
    the input table of the comparison jobs (one row per system, metric and
    query), read by several branches of each plan, so it is written once
    (a Parquet table in the shared checkpoint folder) like an evaluation file."""
    from ..functions.metrics import evaluate
    from ..session import materialize
    return materialize(evaluate(runs(spark, sf_dir), qrels(spark, sf_dir), ["P_10", "ndcg_cut_10"])
                       .select("system", "metric", "qid", "value"), "evals")


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with a WITH clause defining the named views (and what
    they depend on), in dependency order."""
    order: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return sql
    # each view is computed once, however often the twin reads it
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEW_SQL[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
