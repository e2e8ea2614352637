"""Readers for the reference's record formats.

Each format has a ``parse_*`` function over a DataFrame of text lines
(column ``value``, optional ``path`` and ``ord``) and a ``read_*`` wrapper
that scans files with ``spark.read.text`` (splittable, gzip transparent,
input order kept as ``ord`` = (file, block, row id) per SURVEY §1.4).
Parsing is ``split``/``regexp_extract``/``try_cast``: JVM expressions, no
Python per line. Malformed lines never raise inside tasks; readers keep them
out of the parsed frame, :func:`bad_run_lines` lists them and
:func:`find_malformed_runs` names their files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WS = r"\s+"


def read_lines(spark: SparkSession, paths: str | Sequence[str], line_sep: str | None = None) -> DataFrame:
    """Lines with their file path and input order."""
    r = spark.read
    if line_sep is not None:
        r = r.option("lineSep", line_sep)
    df = r.text(paths if isinstance(paths, str) else list(paths))
    return df.select("value", F.col("_metadata.file_path").alias("path"),
                     F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                              F.monotonically_increasing_id()).alias("ord"))


def strip_comments(value) -> F.Column:
    """Drop everything from '#' to the end of the line."""
    return F.regexp_replace(value, r"\s*#.*$", "")


def _fields(df: DataFrame, comments: bool = False) -> DataFrame:
    v = strip_comments(F.col("value")) if comments else F.col("value")
    return df.withColumn("_f", F.split(F.trim(v), WS)).where(F.trim(v) != "")


def _judged(parsed: DataFrame, reason, on_bad: str) -> DataFrame:
    """What to do with lines that have a ``reason`` to be rejected: ``drop`` them,
    ``raise`` on the first one, or ``keep`` them, with the columns reject (the reason,
    null for good lines) and line. One scan either way."""
    if on_bad == "keep":
        return parsed.withColumn("reject", reason).withColumn("line", F.when(F.col("reject").isNotNull(), F.col("value")))
    if on_bad == "raise":
        said = F.concat(F.lit("bad line ("), reason, F.lit("): "), F.col("value"))
        return parsed.where(F.when(reason.isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True))
    if on_bad != "drop":
        raise ValueError(f"on_bad: drop, raise or keep, not {on_bad}")
    return parsed.where(reason.isNull())


def rejects(parsed: DataFrame) -> DataFrame:
    """The rejected lines of a reader with ``on_bad="keep"``: (path,) reject, line."""
    return parsed.where(F.col("reject").isNotNull()).select(*[c for c in ("path", "file", "reject", "line") if c in parsed.columns])


def _run_fields(lines: DataFrame, comments: bool):
    """Fields of run lines, with rank, score and the reason against a line."""
    f = _fields(lines, comments)
    n = F.size("_f")
    rank = F.when(n == 6, F.get("_f", F.lit(3))).when(n == 3, F.get("_f", F.lit(2))).try_cast("int")
    score = F.when(n == 6, F.get("_f", F.lit(4)).try_cast("double")).when(n == 3, F.try_divide(F.lit(1.0), rank))
    reason = (F.when(~n.isin(3, 6), "fields").when(rank.isNull(), "rank")
              .when((n == 6) & score.isNull(), "score"))
    return f, n, rank, score, reason


def parse_run(lines: DataFrame, system: str | None = None, comments: bool = False, on_bad: str = "drop") -> DataFrame:
    """6 fields ``vid Q0 did rank score tag`` or 3 fields ``vid did rank``
    (score = 1/rank; rank 0 has none). qid = vid before the first '-'. A
    document repeated in one list of one file keeps its last occurrence.
    ``comments`` drops text from '#' on; off by default, since ids may hold it.
    Lines of other arity or with a rank or score that is no number: ``on_bad``
    (see :func:`_judged`)."""
    f, n, rank, score, reason = _run_fields(lines, comments)
    f = _judged(f, reason, on_bad)
    kept = ["reject", "line"] if on_bad == "keep" else []
    good = F.col("reject").isNull() if kept else F.lit(True)
    six = n == 6
    out = f.select(
        F.when(good, F.get("_f", F.lit(0))).alias("vid"),
        F.when(good, F.when(six, F.get("_f", F.lit(2))).otherwise(F.get("_f", F.lit(1)))).alias("did"),
        F.when(good, rank).alias("rank"), F.when(good, score).alias("score"),
        F.when(good & six, F.get("_f", F.lit(5))).alias("tag"),
        *[F.col(c) for c in ("path", "file", "ord") if c in lines.columns], *kept)
    out = out.withColumn("qid", F.split("vid", "-").getItem(0))
    if system is not None:
        out = out.withColumn("system", F.lit(system))
    if "ord" in out.columns:
        # A rejected line is a group of its own.
        alone = [F.when(F.col("reject").isNotNull(), F.col("ord"))] if kept else []
        w = Window.partitionBy(*[F.col(c) for c in ("path", "vid", "did") if c in out.columns], *alone).orderBy(F.col("ord").desc())
        out = out.withColumn("_last", F.row_number().over(w)).where(F.col("_last") == 1).drop("_last")
    return out


def read_run(spark: SparkSession, paths, system: str | None = None, comments: bool = False, on_bad: str = "drop") -> DataFrame:
    """One system from one or several files; a list may span files. With
    ``on_bad="keep"`` the rejected lines come along, see :func:`rejects`."""
    lines = read_lines(spark, paths)
    return parse_run(lines.withColumnRenamed("path", "file") if on_bad == "keep" else lines.drop("path"), system, comments, on_bad)


def read_runs(spark: SparkSession, paths: Sequence[str], names: Sequence[str] | None = None,
              comments: bool = False, on_bad: str = "drop") -> DataFrame:
    """Several systems, one a file: ``system`` is the given name, else the
    file's stem; lists of different files never mix."""
    if names is not None and len(names) != len(paths):
        raise ValueError("one name per file")
    run = parse_run(read_lines(spark, paths), None, comments, on_bad)
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    if names is not None:
        by = {p.rsplit("/", 1)[-1]: n for p, n in zip(paths, names, strict=True)}
        if len(by) != len(paths):
            raise ValueError("names need files of different base names")
        base = F.substring_index("path", "/", -1)
        stem = F.coalesce(*[F.when(base == b, F.lit(n)) for b, n in by.items()])
    run = run.withColumn("system", stem)
    return run if on_bad == "keep" else run.drop("path")


def bad_run_lines(lines: DataFrame, comments: bool = False) -> DataFrame:
    """Lines of a run that have neither 6 nor 3 fields, or a rank or score that
    is no number, with the reason: what the reader leaves out."""
    f, _, _, _, reason = _run_fields(lines, comments)
    return f.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_f")


def parse_qrels(lines: DataFrame, default_rel: int = 1, comments: bool = False, on_bad: str = "drop") -> DataFrame:
    """``qid 0 did rel`` (4 fields), ``qid did rel`` (3) or ``qid did``
    (2, rel = default). The last duplicate of a pair wins. Lines of other arity
    or with a grade that is no number: ``on_bad`` (see :func:`_judged`)."""
    f = _fields(lines, comments)
    n = F.size("_f")
    rel = F.when(n == 4, F.get("_f", F.lit(3))).when(n == 3, F.get("_f", F.lit(2))).otherwise(F.lit(str(default_rel))).try_cast("int")
    reason = F.when(~n.isin(2, 3, 4), "fields").when(rel.isNull(), "rel")
    f = _judged(f, reason, on_bad)
    kept = ["reject", "line"] if on_bad == "keep" else []
    out = f.select(
        F.get("_f", F.lit(0)).alias("qid"), F.when(n == 4, F.get("_f", F.lit(2))).otherwise(F.get("_f", F.lit(1))).alias("did"), rel.alias("rel"),
        *[F.col(c) for c in ("path", "ord") if c in lines.columns], *kept)
    if "ord" not in out.columns:
        return out
    good = out.where(F.col("reject").isNull()) if kept else out
    good = good.groupBy("qid", "did").agg(F.max_by("rel", "ord").alias("rel"))
    if not kept:
        return good
    return good.unionByName(out.where(F.col("reject").isNotNull()).drop("ord", "qid", "did", "rel"), allowMissingColumns=True)


def read_qrels(spark: SparkSession, paths, default_rel: int = 1, comments: bool = False, on_bad: str = "drop") -> DataFrame:
    return parse_qrels(read_lines(spark, paths), default_rel, comments, on_bad)


def parse_eval(lines: DataFrame, on_bad: str = "drop") -> tuple[DataFrame, DataFrame]:
    """S3: ``metric qid value``; returns (per-query rows, ``all`` rows). Lines of
    other arity or with a value that is no number: ``on_bad``; kept ones are among
    the per-query rows."""
    f = _fields(lines, comments=False)
    value = F.get("_f", F.lit(2)).try_cast("double")
    f = _judged(f, F.when(F.size("_f") != 3, "fields").when(value.isNull(), "value"), on_bad)
    kept = [F.col(c) for c in ("reject", "line")] if on_bad == "keep" else []
    e = f.select(*([F.col("path")] if "path" in lines.columns else []),
                 F.get("_f", F.lit(0)).alias("metric"), F.get("_f", F.lit(1)).alias("qid"), value.alias("value"), *kept)
    total = (F.col("qid") == "all") & (F.col("reject").isNull() if kept else F.lit(True))
    total = F.coalesce(total, F.lit(False))
    return e.where(~total), e.where(total)


def unequal_queries(evals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """S3: (by..., metric, qid) of the queries that a metric lacks though another
    metric (of the same ``by``, e.g. system) has them; empty when all metrics have the
    same queries."""
    by = list(by)
    have = evals.select(*by, "metric", "qid").distinct()
    n = have.groupBy(*by).agg(F.count_distinct("metric").alias("_n")) if by else have.agg(F.count_distinct("metric").alias("_n"))
    per = have.groupBy(*by, "qid").agg(F.collect_set("metric").alias("_m"))           # metrics: few
    some = per.join(n, by) if by else per.crossJoin(F.broadcast(n))                   # one row
    some = some.where(F.size("_m") < F.col("_n")).select(*by, "qid", "_m")
    names = have.groupBy(*by).agg(F.collect_set("metric").alias("_all")) if by else have.agg(F.collect_set("metric").alias("_all"))
    lack = some.join(names, by) if by else some.crossJoin(F.broadcast(names))
    return lack.select(*by, F.explode(F.array_except("_all", "_m")).alias("metric"), "qid")


_RBP_RE = r"p=\s*([0-9.]+)\s+q=\s*(\S+)\s+d=\s*(\d+)\s+rbp=\s*([0-9.]+)\s+\+([0-9.]+)"


def parse_rbp(lines: DataFrame) -> DataFrame:
    """rbp_eval lines → (metric ``rbp_{p}@{d}``, qid, value, residual);
    ``#`` lines and ``all`` skipped."""
    v = F.col("value")
    ok = lines.where(~F.trim(v).startswith("#") & v.rlike(_RBP_RE))
    g = lambda i: F.regexp_extract(v, _RBP_RE, i)
    out = ok.select(F.concat(F.lit("rbp_"), g(1), F.lit("@"), g(3)).alias("metric"), g(2).alias("qid"),
                    g(4).cast("double").alias("value"), g(5).cast("double").alias("residual"))
    return out.where(F.col("qid") != "all")


def parse_gdeval(lines: DataFrame) -> DataFrame:
    """Gdeval CSV ``runid,topic,ndcg@k,err@k`` (header names the
    metrics), ``amean`` row skipped; long (runid, metric, qid, value)."""
    f = lines.select(F.split("value", ",").alias("_f"), *([F.col("path")] if "path" in lines.columns else []))
    f = f.where(F.size("_f") >= 4)                       # blank or cut lines hold no measures
    header = f.where(F.element_at("_f", 1) == "runid").select(
        *([F.col("path")] if "path" in lines.columns else []),
        F.element_at("_f", 3).alias("m1"), F.element_at("_f", 4).alias("m2"))
    rows = f.where((F.element_at("_f", 1) != "runid") & (F.element_at("_f", 2) != "amean"))
    j = rows.join(F.broadcast(header), "path") if "path" in lines.columns else rows.crossJoin(F.broadcast(header))
    return j.select(F.element_at("_f", 1).alias("runid"), F.element_at("_f", 2).alias("qid"),
                    F.explode(F.array(F.struct(F.col("m1").alias("metric"), F.element_at("_f", 3).try_cast("double").alias("value")),
                                      F.struct(F.col("m2").alias("metric"), F.element_at("_f", 4).try_cast("double").alias("value"))))
                    .alias("m")).select("runid", "m.metric", "qid", "m.value")


def detect_eval_format(lines: DataFrame) -> DataFrame:
    """Per file, from its first line: ``rbp`` when it mentions rbp_eval,
    ``gdeval`` when it starts with runid, else ``trec``."""
    first = lines.groupBy("path").agg(F.min_by("value", "ord").alias("first"))
    fmt = F.when(F.col("first").contains("rbp_eval"), "rbp").when(F.col("first").startswith("runid"), "gdeval") \
        .otherwise("trec")
    return first.select("path", fmt.alias("format"))


def parse_queries(lines: DataFrame, sep: str = "\t", qid_field: int = 0, query_field: int = 1) -> DataFrame:
    """(qid, text) by separator and 0-based field indices; ``sep=None``
    numbers the lines from 0 (order kept) and uses the whole line. A line
    without separator has a null text."""
    if sep is None:
        from ..operators.rank import global_rank
        n = global_rank(lines, [F.col("ord")], "_n")
        return n.select((F.col("_n") - 1).cast("string").alias("qid"), F.col("value").alias("text"))
    f = lines.select(F.split("value", sep).alias("_f"))
    return f.select(F.get("_f", F.lit(qid_field)).alias("qid"), F.get("_f", F.lit(query_field)).alias("text"))


def parse_spam_scores(lines: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """``score did`` lines; with ``docs`` only those documents are kept
    (semi join: the small document set filters the huge score file)."""
    f = _fields(lines, comments=False).where(F.size("_f") == 2)
    out = f.select(F.element_at("_f", 2).alias("did"), F.element_at("_f", 1).try_cast("int").alias("spam"))
    if docs is not None:
        from ..session import broadcast_if_small
        out = out.join(broadcast_if_small(docs.select("did").distinct()), "did", "left_semi")
    return out


_DOCNO = r"(?s)<DOCNO>\s*(.*?)\s*</DOCNO>"


def parse_trec_docs(records: DataFrame, body_tag: str = "TEXT", web: bool = False) -> DataFrame:
    """One record per ``</DOC>``-terminated chunk (read with
    ``lineSep='</DOC>'``); DOCNO and the body between <TEXT> (or <BODY>)
    tags. ``web``: lines joined with a space, tabs and CRs replaced."""
    body_re = rf"(?s)<{body_tag}>\s*(.*?)\s*</{body_tag}>"
    v = F.col("value")
    body = F.regexp_extract(v, body_re, 1)
    if web:
        body = F.regexp_replace(F.regexp_replace(body, r"[\t\r]", " "), r"\n", " ")
    # a filter would be pushed below what makes the records, which would then be made twice
    found = F.struct(F.regexp_extract(v, _DOCNO, 1).alias("did"), body.alias("text"))
    return records.select(F.inline(F.when(v.contains("<DOCNO>"), F.array(found)).otherwise(F.array())))


def read_trec_docs(spark: SparkSession, paths, body_tag: str = "TEXT", web: bool = False) -> DataFrame:
    return parse_trec_docs(spark.read.option("lineSep", "</DOC>").text(paths), body_tag, web)


_QNUM = r"(?s)<number>\s*(.*?)\s*</number>"
_QTXT = r"(?s)<text>\s*(.*?)\s*</text>"


def _xml_unescape(c):
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def parse_query_param(records: DataFrame) -> DataFrame:
    """``<query><number/><text/></query>`` records → (qid, text)."""
    v = F.col("value")
    r = records.where(v.contains("<number>"))
    return r.select(F.regexp_extract(v, _QNUM, 1).alias("qid"), _xml_unescape(F.regexp_extract(v, _QTXT, 1)).alias("text"))


def read_query_param(spark: SparkSession, paths) -> DataFrame:
    """S11 from files: records split at ``</query>``."""
    return parse_query_param(spark.read.option("lineSep", "</query>").text(paths))


def parse_triples(lines: DataFrame) -> DataFrame:
    """``id pos neg`` (tab or whitespace)."""
    f = _fields(lines, comments=False).where(F.size("_f") == 3)
    return f.select(F.element_at("_f", 1).alias("id"), F.element_at("_f", 2).alias("pos"), F.element_at("_f", 3).alias("neg"))


def read_delimited(spark: SparkSession, paths, sep: str = "\t", schema: str | None = None) -> DataFrame:
    """Headerless table; with a DDL ``schema`` lines of the wrong
    shape fail the job (FAILFAST), else types are inferred."""
    r = spark.read.option("sep", sep).option("header", "false")
    r = r.schema(schema).option("mode", "FAILFAST") if schema else r.option("inferSchema", "true")
    return r.csv(paths)


def typed_columns(lines: DataFrame, schema: str, sep: str = "\t") -> DataFrame:
    """K9 on lines: parse with a DDL schema (``from_csv``, FAILFAST)."""
    parsed = lines.select(F.from_csv("value", schema, {"sep": sep, "mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


def find_malformed_runs(lines: DataFrame) -> DataFrame:
    """Files with any line that is not 6 fields with an int rank and a
    float score."""
    f = lines.withColumn("_f", F.split(F.trim("value"), WS))
    good = (F.size("_f") == 6) & F.element_at("_f", 4).try_cast("int").isNotNull() \
        & F.element_at("_f", 5).try_cast("double").isNotNull()
    return f.groupBy("path").agg(F.bool_or(~good).alias("malformed"), F.count_if(~good).alias("bad_lines"))


def parse_generation_output(lines: DataFrame) -> DataFrame:
    """``H-<id>\\t<score>\\t<hypothesis>`` and ``T-<id>\\t<target>``
    lines, paired by sentence id (not by position)."""
    v = F.col("value")
    f = lines.select(F.split(v, "\t").alias("_f"))
    kind = F.substring(F.element_at("_f", 1), 1, 1)
    sid = F.substring_index(F.element_at("_f", 1), "-", -1)
    h = f.where(kind == "H").select(sid.alias("sid"),
                                    F.array_join(F.slice("_f", F.lit(3), F.size("_f")), "\t").alias("hypothesis"))
    t = f.where(kind == "T").select(sid.alias("sid"), F.array_join(F.slice("_f", F.lit(2), F.size("_f")), "\t").alias("target"))
    return h.join(t, "sid", "full")
