"""Writers for the reference's record formats.

``format_*`` functions build the text line of each record as a column
(``concat_ws``/``format_string``: JVM expressions); ``write_*`` functions
range-partition by query and sort within partitions so files come out in
query order without a global single-task sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text


def format_run(run: DataFrame, fmt: str = "trec", tag: str = "indri") -> DataFrame:
    """K1: ``vid Q0 did rank score tag`` (trec) or ``vid\\tdid\\trank`` (ans).
    Needs (vid or qid, did, rank, score)."""
    vid = F.col("vid") if "vid" in run.columns else F.col("qid")
    if fmt == "trec":
        line = F.concat_ws(" ", vid.cast("string"), F.lit("Q0"), F.col("did").cast("string"),
                           F.col("rank").cast("string"), F.col("score").cast("string"),
                           F.col("tag") if "tag" in run.columns else F.lit(tag))
    else:
        line = F.concat_ws("\t", vid.cast("string"), F.col("did").cast("string"), F.col("rank").cast("string"))
    return run.select(vid.alias("_k"), F.col("rank"), line.alias("value"))


def write_lines(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write (``_k``, ``rank``, ``value``) lines grouped by key and in rank
    order: range partitioning on key and rank (a key with many lines spans
    several files), sort within partitions."""
    n = partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (lines.repartitionByRange(n, "_k", "rank").sortWithinPartitions("_k", "rank")
     .select("value").write.mode("overwrite").text(path))


def write_run(run: DataFrame, path: str, fmt: str = "trec") -> None:
    """K1 to files."""
    write_lines(format_run(run, fmt), path)


def format_qrels(qrels: DataFrame) -> DataFrame:
    """K2: ``qid\\t0\\tdid\\trel``."""
    return qrels.select(F.concat_ws("\t", F.col("qid").cast("string"), F.lit("0"), F.col("did").cast("string"),
                                    F.col("rel").cast("string")).alias("value"))


def ans_to_trec(run3: DataFrame, tag: str = "anserini") -> DataFrame:
    """K3: 3-column rows → 6-column rows with score = −rank."""
    return run3.select("vid", "did", "rank", (-F.col("rank")).cast("double").alias("score"), F.lit(tag).alias("tag"))


def trec_to_ans(run6: DataFrame) -> DataFrame:
    """K4: 6-column rows → 3-column rows."""
    return run6.select("vid", "did", "rank")


def to_trec_text(docs: DataFrame) -> DataFrame:
    """K5: ``<DOC>`` records with DOCNO and cleaned, lower-cased text."""
    body = clean_text(F.col("text"))
    return docs.select("did", F.format_string("<DOC>\n<DOCNO>%s</DOCNO>\n<TEXT>\n%s\n</TEXT>\n</DOC>",
                                              F.col("did").cast("string"), body).alias("value"))


def xml_escape(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def to_query_param(queries: DataFrame, working_set: DataFrame | None = None,
                   placeholder: str = "empty") -> DataFrame:
    """K6: one ``<query>`` element per query (XML-escaped text; an empty
    query gets a placeholder), with optional ``<workingSetDocno>`` children.
    Wrap the lines in ``<parameters>`` … ``</parameters>`` when writing."""
    text = F.when(F.trim(F.col("text")) == "", F.lit(placeholder)).otherwise(F.col("text"))
    q = queries.select("qid", xml_escape(text).alias("_t"))
    if working_set is not None:
        ws = working_set.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.col("did").cast("string"))),
                                                                     lambda d: F.format_string("<workingSetDocno>%s</workingSetDocno>", d)),
                                                         "").alias("_ws"))
        q = q.join(ws, "qid", "left")
    else:
        q = q.withColumn("_ws", F.lit(""))
    return q.select("qid", F.format_string("<query><number>%s</number><text>%s</text>%s</query>",
                                           F.col("qid").cast("string"), F.col("_t"), F.coalesce("_ws", F.lit(""))).alias("value"))


def format_eval(evals: DataFrame, layout: str = "trec") -> DataFrame:
    """K7: per-query lines followed by the ``all`` mean per metric; trec
    layout ``metric<pad 22>\\tqid\\tvalue`` (4 decimals) or RBP layout, which
    also has the ``residual`` column and its mean (0 where evals has none)."""
    if "residual" not in evals.columns:
        evals = evals.withColumn("residual", F.lit(0.0))
    means = evals.groupBy("metric").agg(F.avg("value").alias("value"), F.avg("residual").alias("residual"), F.lit("all").alias("qid"))
    rows = evals.select("metric", F.col("qid").cast("string").alias("qid"), "value", "residual", F.lit(0).alias("_o")) \
        .unionByName(means.select("metric", "qid", "value", "residual", F.lit(1).alias("_o")))
    if layout == "trec":
        line = F.format_string("%-22s\t%s\t%.4f", F.col("metric"), F.col("qid"), F.col("value"))
    else:
        line = F.format_string("p= %s q= %s d= %s rbp= %.4f +%.4f", F.regexp_extract("metric", r"rbp_([0-9.]+)@", 1),
                               F.col("qid"), F.regexp_extract("metric", r"@(\d+)", 1), F.col("value"), F.col("residual"))
    return rows.select("metric", "qid", "_o", line.alias("value"))


def arrays_from_text(lines: DataFrame, dtype: str = "double") -> tuple[DataFrame, DataFrame]:
    """K8: whitespace-separated numbers → typed array; plus whether all
    lengths are equal (one aggregate row)."""
    arr = lines.select(*[c for c in lines.columns if c != "value"],
                       F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast(dtype)).alias("array"))
    info = arr.agg((F.count_distinct(F.size("array")) == 1).alias("equal_lengths"), F.max(F.size("array")).alias("width"))
    return arr, info


def incremental_skip(inputs: DataFrame, outputs: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Inputs whose output does not exist yet (all when ``force``)."""
    if force:
        return inputs
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")
