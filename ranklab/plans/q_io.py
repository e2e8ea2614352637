"""Registered source/sink queries (S1-S18, K1-K10): records are formatted
from the derived views with the sink functions and parsed back with the
source functions (the same parsers ``read_*`` apply to files)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.rank import rerank
from ..sinks import formats as K
from ..sources import formats as S
from . import views as V
from .catalog import r6, register
from .q_text import CLEAN_SQL

_RANKED = ("SELECT qid, did, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, "
           "CAST(did AS VARCHAR) DESC) AS rank FROM run_a")


def _run_lines(spark, sf_dir, fmt="trec"):
    run = rerank(V.run(spark, sf_dir, "a"))
    lines = K.format_run(run, fmt).select("value")
    return lines.withColumn("ord", F.monotonically_increasing_id())


@register("trec_run_roundtrip", f"""
SELECT CAST(qid AS VARCHAR) AS qid, CAST(did AS VARCHAR) AS did, CAST(rank AS INTEGER) AS rank,
       CAST(score AS DOUBLE) AS score, 'indri' AS tag FROM ({_RANKED}) r
""", ("run_a",))
def trec_run_roundtrip(spark, sf_dir):
    """K1 + S1: 6-column run lines written and parsed back."""
    return S.parse_run(_run_lines(spark, sf_dir)).select("qid", "did", "rank", "score", "tag")


@register("ans_roundtrip", f"""
SELECT CAST(qid AS VARCHAR) AS vid, CAST(did AS VARCHAR) AS did, CAST(rank AS INTEGER) AS rank,
       CAST(-rank AS DOUBLE) AS score, round(1.0 / rank, 6) AS parsed_score FROM ({_RANKED}) r
""", ("run_a",))
def ans_roundtrip(spark, sf_dir):
    """K4 + S1 (3 columns: score = 1/rank) + K3 (score = −rank)."""
    run = rerank(V.run(spark, sf_dir, "a")).withColumn("vid", F.col("qid").cast("string"))
    three = K.format_run(K.trec_to_ans(run.withColumn("tag", F.lit("x"))), "ans").select("value")
    parsed = S.parse_run(three)
    back = K.ans_to_trec(parsed)
    return back.join(parsed.select("vid", "did", r6("score").alias("parsed_score")), ["vid", "did"]) \
        .select("vid", "did", "rank", "score", "parsed_score")


@register("qrels_roundtrip", """
SELECT CAST(qid AS VARCHAR) AS qid, CAST(did AS VARCHAR) AS did, rel FROM qrels
""", ("qrels",))
def qrels_roundtrip(spark, sf_dir):
    """K2 + S2."""
    lines = K.format_qrels(V.qrels(spark, sf_dir)).withColumn("ord", F.monotonically_increasing_id())
    return S.parse_qrels(lines)


@register("eval_roundtrip", """
SELECT metric, qid, round(value, 4) AS value FROM (
  SELECT metric, CAST(qid AS VARCHAR) AS qid, value FROM evals WHERE system = 'a'
  UNION ALL
  SELECT metric, 'all' AS qid, avg(value) AS value FROM evals WHERE system = 'a' GROUP BY metric) t
""", ("evals",))
def eval_roundtrip(spark, sf_dir):
    """K7 + S3: trec_eval layout (per query + all) written and parsed back."""
    ev = V.evals(spark, sf_dir).where(F.col("system") == "a").drop("system")
    lines = K.format_eval(ev).select("value")
    per, allrows = S.parse_eval(lines)
    return per.unionByName(allrows).select("metric", "qid", F.round("value", 4).alias("value"))


@register("rbp_roundtrip", """
WITH r AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CAST(did AS VARCHAR) DESC) AS rank
           FROM (SELECT a.*, q.rel FROM run_a a LEFT JOIN qrels q USING (qid, did)) x)
SELECT 'rbp_0.80@' || CAST(count(*) AS VARCHAR) AS metric, CAST(qid AS VARCHAR) AS qid,
       round(sum(CASE WHEN rel >= 1 THEN 0.2 * power(0.8, rank - 1) ELSE 0 END), 4) AS value,
       round(sum(CASE WHEN rel IS NULL THEN 0.2 * power(0.8, rank - 1) ELSE 0 END) + power(0.8, max(rank)), 4) AS residual
FROM r GROUP BY qid
""", ("run_a", "qrels"))
def rbp_roundtrip(spark, sf_dir):
    """RBP lines (``p= q= d= rbp= +res``) of run_a parsed back."""
    from ..functions.metrics import evaluate_wide
    w = evaluate_wide(V.run(spark, sf_dir, "a"), V.qrels(spark, sf_dir), ["rbp@0.8"])
    n = V.run(spark, sf_dir, "a").groupBy("qid").agg(F.count("*").alias("d"))
    ev = w.join(n, "qid").select(F.concat(F.lit("rbp_0.80@"), F.col("d").cast("string")).alias("metric"), "qid",
                                 F.col("`rbp@0.8`").alias("value"), F.col("`rbp@0.8_res`").alias("residual"))
    lines = K.format_eval(ev, "rbp").select("value")
    header = spark.createDataFrame([("# rbp_eval output",)], "value string")
    return S.parse_rbp(header.unionByName(lines)).select("metric", "qid", "value", "residual")


@register("gdeval_csv", """
WITH g AS (SELECT qid, metric, value FROM evals WHERE system = 'b')
SELECT 'b' AS runid, metric, CAST(qid AS VARCHAR) AS qid, round(value, 5) AS value FROM g
""", ("evals",))
def gdeval_csv(spark, sf_dir):
    """Gdeval-style CSV (header, per-topic rows, amean row) parsed and
    unpivoted."""
    ev = V.evals(spark, sf_dir).where(F.col("system") == "b")
    wide = ev.groupBy("qid").pivot("metric", ["P_10", "ndcg_cut_10"]).agg(F.first("value"))
    rows = wide.select(F.format_string("b,%s,%.5f,%.5f", F.col("qid").cast("string"), F.col("P_10"),
                                       F.col("ndcg_cut_10")).alias("value"))
    header = spark.createDataFrame([("runid,topic,P_10,ndcg_cut_10",), ("b,amean,0.0,0.0",)], "value string")
    out = S.parse_gdeval(header.unionByName(rows))
    return out.select("runid", "metric", "qid", "value")


@register("detect_eval_format", """
SELECT * FROM (VALUES ('gd.csv', 'gdeval'), ('run.rbp', 'rbp'), ('run.eval', 'trec')) t(path, format)
WHERE (SELECT count(*) FROM evals) > 0
""", ("evals",))
def detect_eval_format(spark, sf_dir):
    """Format of each evaluation file from its first line."""
    ev = V.evals(spark, sf_dir).where(F.col("system") == "a").drop("system")
    trec = K.format_eval(ev).select("value", F.lit("run.eval").alias("path"),
                                    F.struct(F.col("_o"), F.col("metric"), F.col("qid")).alias("ord"))
    rbp = trec.select(F.concat(F.lit("# rbp_eval "), "value").alias("value"), F.lit("run.rbp").alias("path"), "ord")
    gd = trec.select(F.concat(F.lit("runid,"), "value").alias("value"), F.lit("gd.csv").alias("path"), "ord")
    return S.detect_eval_format(trec.unionByName(rbp).unionByName(gd))


@register("trec_docs_roundtrip", f"SELECT CAST(did AS VARCHAR) AS did, {CLEAN_SQL} AS text FROM corpus", ("corpus",))
def trec_docs_roundtrip(spark, sf_dir):
    """K5 + S9: whole documents as TREC text records, parsed back."""
    return S.parse_trec_docs(K.to_trec_text(V.corpus(spark, sf_dir)).select("value"))


@register("query_param_roundtrip", """
SELECT CAST(qid AS VARCHAR) AS qid, CASE WHEN trim(text) = '' THEN 'empty' ELSE trim(text) END AS text,
       (SELECT count(*) FROM (SELECT DISTINCT qid, did FROM run_a) w WHERE w.qid = q.qid) AS n_ws
FROM (SELECT l_suppkey AS qid, max_by(l_returnflag || ' <' || l_linestatus || '> & ' || CAST(l_partkey AS VARCHAR), (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS text
      FROM lineitem GROUP BY l_suppkey) q
""", ("run_a",))
def query_param_roundtrip(spark, sf_dir):
    """K6 + S11: query parameter XML (escaped text, working-set documents)
    written and parsed back; texts carry characters that need escaping."""
    li = V.table(spark, sf_dir, "lineitem")
    q = li.groupBy(F.col("l_suppkey").alias("qid")).agg(F.max_by(
        F.concat(F.col("l_returnflag"), F.lit(" <"), F.col("l_linestatus"), F.lit("> & "), F.col("l_partkey").cast("string")),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("text"))
    ws = V.run(spark, sf_dir, "a").select("qid", "did")
    x = K.to_query_param(q, ws)
    parsed = S.parse_query_param(x.select("value"))
    n = x.select(F.col("qid").cast("string").alias("qid"),
                 F.size(F.regexp_extract_all("value", F.lit("<workingSetDocno>"), 0)).cast("bigint").alias("n_ws"))
    return parsed.withColumn("text", F.trim("text")).join(n, "qid")


@register("spam_scores", """
SELECT CAST(did AS VARCHAR) AS did, spam FROM spam WHERE did IN (SELECT did FROM run_a)
""", ("spam", "run_a"))
def spam_scores(spark, sf_dir):
    """S8 + J7: spam score lines restricted to documents of the run."""
    lines = V.spam(spark, sf_dir).select(F.concat_ws(" ", F.col("spam").cast("string"), F.col("did").cast("string"))
                                         .alias("value"))
    docs = V.run(spark, sf_dir, "a").select(F.col("did").cast("string").alias("did"))
    return S.parse_spam_scores(lines, docs)


@register("malformed_runs", """
SELECT 'events_' || event_type AS path, bool_or(event_type = 'error') AS malformed,
       CAST(count_if(event_type = 'error') AS BIGINT) AS bad_lines
FROM events GROUP BY event_type
""")
def malformed_runs(spark, sf_dir):
    """Run-like lines built from events (one file per event type; error
    events carry a non-numeric rank) and the files with malformed lines."""
    ev = V.table(spark, sf_dir, "events")
    rank = F.when(F.col("event_type") == "error", F.lit("NaN-rank")).otherwise(F.col("user_id").cast("string"))
    lines = ev.select(F.concat(F.lit("events_"), F.col("event_type")).alias("path"),
                      F.concat_ws(" ", F.col("user_id").cast("string"), F.lit("Q0"), F.col("event_id").cast("string"),
                                  rank, F.col("value").cast("string"), F.lit("ev")).alias("value"))
    return S.find_malformed_runs(lines)


@register("run_rejects", """
WITH l AS (SELECT event_id, event_type, user_id || ' Q0 ' || event_id || ' ' || CASE WHEN event_type = 'error' THEN 'first' ELSE CAST(user_id AS VARCHAR) END
                  || CASE WHEN event_type = 'view' THEN '' ELSE ' 2.5' END || ' ev  # note' AS line FROM events)
SELECT event_id, CASE WHEN event_type = 'view' THEN 'fields' WHEN event_type = 'error' THEN 'rank' END AS reject,
       CASE WHEN event_type IN ('view', 'error') THEN line END AS line
FROM l
""")
def run_rejects(spark, sf_dir):
    """Commented run lines read in one scan, good rows and rejects (a view has
    five fields, an error no rank)."""
    ev = V.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    rank = F.when(kind == "error", F.lit("first")).otherwise(F.col("user_id").cast("string"))
    score = F.when(kind == "view", F.lit("")).otherwise(F.lit(" 2.5"))
    lines = ev.select(F.concat_ws(" ", F.col("user_id").cast("string"), F.lit("Q0"), F.col("event_id").cast("string"), F.concat(rank, score), F.lit("ev  # note")).alias("value"))
    out = S.parse_run(lines, comments=True, on_bad="keep")
    doc = F.coalesce("did", F.split("line", " ")[2])
    return out.select(doc.cast("long").alias("event_id"), "reject", "line")


@register("comment_lines", r"""
SELECT conv_id, turn, trim(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')) || ' # ' || role, '\s*#.*$', '')) AS text FROM conversations
""")
def comment_lines(spark, sf_dir):
    """S14: '#' comments stripped from lines (texts with a role comment)."""
    cv = V.table(spark, sf_dir, "conversations")
    line = F.concat(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(" # "), F.col("role"))
    return cv.select("conv_id", "turn", F.trim(S.strip_comments(line)).alias("text"))


@register("generation_output", """
WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply,
                  lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole, role FROM conversations)
SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS sid, replace(replace(reply, chr(10), ' '), chr(9), ' ') AS hypothesis,
       replace(replace(text, chr(10), ' '), chr(9), ' ') AS target
FROM p WHERE role = 'user' AND nrole = 'assistant'
""")
def generation_output(spark, sf_dir):
    """Generator output lines (``H-id``, ``T-id``) from conversation
    turns, paired by sentence id."""
    from pyspark.sql import Window
    cv = V.table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    flat = lambda c: F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    p = cv.select("conv_id", "turn", "role", F.lead("role").over(w).alias("nrole"), flat(F.col("text")).alias("t"),
                  flat(F.lead("text").over(w)).alias("r")).where((F.col("role") == "user") & (F.col("nrole") == "assistant"))
    sid = F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    h = p.select(F.concat(F.lit("H-"), sid, F.lit("\t-0.25\t"), F.col("r")).alias("value"))
    t = p.select(F.concat(F.lit("T-"), sid, F.lit("\t"), F.col("t")).alias("value"))
    return S.parse_generation_output(h.unionByName(t)).select("sid", "hypothesis", "target")


@register("typed_columns", """
SELECT l_orderkey AS orderkey, l_partkey AS partkey, l_quantity AS quantity, l_returnflag AS flag FROM lineitem
""")
def typed_columns(spark, sf_dir):
    """S13 / K9: '|'-separated lines parsed with a DDL schema (FAILFAST)."""
    li = V.table(spark, sf_dir, "lineitem")
    lines = li.select(F.concat_ws("|", *[F.col(c).cast("string") for c in
                                         ("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")]).alias("value"))
    return S.typed_columns(lines, "orderkey BIGINT, partkey BIGINT, quantity DOUBLE, flag STRING", "|")


@register("arrays_from_text", """
SELECT vec_id, len(embedding) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 3) + 0.0 AS total,
       (SELECT count(DISTINCT len(embedding)) = 1 FROM embeddings) AS equal_lengths
FROM embeddings
""")
def arrays_from_text(spark, sf_dir):
    """K8: vectors written as text lines, parsed back into typed arrays;
    whether all lengths are equal."""
    emb = V.table(spark, sf_dir, "embeddings")
    lines = emb.select("vec_id", F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ").alias("value"))
    arr, info = K.arrays_from_text(lines, "double")
    s = F.aggregate("array", F.lit(0.0), lambda a, x: a + x)
    return arr.crossJoin(info.select("equal_lengths")).select(
        "vec_id", F.size("array").alias("width"), (F.round(s, 3) + 0.0).alias("total"), "equal_lengths")


@register("incremental_skip", """
SELECT p_partkey AS did FROM part WHERE p_partkey NOT IN (SELECT did FROM run_a)
""", ("run_a",))
def incremental_skip(spark, sf_dir):
    """Inputs (parts) whose output (a run row) does not exist yet."""
    parts = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("did"))
    return K.incremental_skip(parts, V.run(spark, sf_dir, "a"), "did")


@register("triples_lines", """
SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(max_by(o_orderkey, (o_totalprice, o_orderkey)) AS VARCHAR) AS pos,
       CAST(min_by(o_orderkey, (o_totalprice, o_orderkey)) AS VARCHAR) AS neg FROM orders GROUP BY o_custkey
""")
def triples_lines(spark, sf_dir):
    """Training triples as tab-separated lines, parsed back."""
    o = V.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("p"),
        F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("n"))
    lines = o.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("o_custkey", "p", "n")]).alias("value"))
    return S.parse_triples(lines)


@register("queries_tsv", """
SELECT CAST(qid AS VARCHAR) AS qid, replace(replace(text, chr(10), ' '), chr(9), ' ') AS text FROM queries
""", ("queries",))
def queries_tsv(spark, sf_dir):
    """Query file ``qid<TAB>text`` parsed by field index."""
    q = V.queries(spark, sf_dir)
    flat = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    lines = q.select(F.concat_ws("\t", F.col("qid").cast("string"), flat).alias("value"))
    return S.parse_queries(lines, "\t", 0, 1)


@register("gzip_run_files", """
SELECT CAST(qid AS VARCHAR) AS qid, count(*) AS n, CAST(sum(score) AS DOUBLE) AS total FROM run_b GROUP BY qid
""", ("run_b",))
def gzip_run_files(spark, sf_dir):
    """S15 + K1: run_b written as gzip-compressed run files in the shared
    checkpoint folder and read back with the run reader."""
    from ..session import scratch_path
    path = scratch_path(spark, "run-gz")
    run = rerank(V.run(spark, sf_dir, "b"))
    lines = K.format_run(run)
    (lines.repartitionByRange("_k", "rank").sortWithinPartitions("_k", "rank").select("value")
     .write.option("compression", "gzip").text(path))
    back = S.read_run(spark, path)
    return back.groupBy("qid").agg(F.count("*").alias("n"), F.sum("score").alias("total"))
