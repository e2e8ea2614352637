"""Registered streaming and user-extension queries (ST1-ST3, N2, N3)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..streaming import stream as STR
from . import views as V
from .catalog import r6, register


@register("stream_transform", """
SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS cents,
       CAST(user_id AS VARCHAR) || ' Q0 ' || CAST(event_id AS VARCHAR) AS line
FROM events WHERE event_type = 'click'
""")
def stream_transform(spark, sf_dir):
    """ST1: stateless filter/convert over the events stream."""
    ev = STR.read_table_stream(spark, sf_dir, "events")
    return STR.run_append(STR.stateless_transform(ev), "st1")


@register("stream_window_counts", """
SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS count
FROM events GROUP BY ALL
""")
def stream_window_counts(spark, sf_dir):
    """ST3: tumbling 1-hour counts per event type, watermark 1 hour, update
    mode (bounded state), final value per window."""
    ev = STR.read_table_stream(spark, sf_dir, "events")
    return STR.run_update(STR.windowed_counts(ev, "event_type"), ["window_start", "event_type"], "st3")


@register("stream_dedup", """
WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 1 hour THEN 0 ELSE 1 END AS fresh
           FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
     r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM g),
     f AS (SELECT user_id, event_type, run, min_by(event_id, (ts, event_id)) AS event_id, min(ts) AS ts, max(ts) + INTERVAL 1 hour AS until
           FROM r GROUP BY user_id, event_type, run)
SELECT event_id, user_id, event_type, ts FROM f
WHERE until <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 hour FROM events)
""")
def stream_dedup(spark, sf_dir):
    """ST2: the earliest event of each run of a (user, type) within an hour; runs still
    open at the watermark are not emitted."""
    ev = STR.read_table_stream(spark, sf_dir, "events")
    out = STR.run_append(STR.dedup_earliest(ev, ["user_id", "event_type"]), "st2")
    return out.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


_RANKED3 = """ranked AS (
  SELECT r.system, r.qid, r.did, q.rel,
         row_number() OVER (PARTITION BY r.system, r.qid ORDER BY r.score DESC, CAST(r.did AS VARCHAR) DESC) AS rank
  FROM runs r LEFT JOIN qrels q ON r.qid = q.qid AND r.did = q.did)"""


@register("custom_metric", f"""
WITH {_RANKED3}
SELECT system, qid, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) / 5.0 AS value FROM ranked WHERE rank <= 5 GROUP BY system, qid
""", ("runs", "qrels"))
def custom_metric(spark, sf_dir):
    """A user metric on each ranked grade list (here: precision over the
    first 5 relevant-or-not documents, computed in pandas). Each (system, qid)'s
    list of its top 5 rows is one value; the function gets batches of lists, as a
    pandas group of its own per list costs far more than the metric."""
    from ..functions.metrics import judge
    from ..operators.rank import score_order, top_k
    runs, qrels = V.runs(spark, sf_dir), V.qrels(spark, sf_dir)
    top = top_k(judge(runs, qrels), ["system", "qid"], score_order(), 5, "rank").select("system", "qid", "rank", "rel")
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("rel", F.lit(0)).alias("rel"))))
    lists = top.groupBy("system", "qid").agg(F.transform(ranked, lambda x: x["rel"]).alias("grades"))

    @F.pandas_udf("double")
    def metric(grades: pd.Series) -> pd.Series:
        return grades.map(lambda g: float((g > 0).sum()) / 5.0)

    return lists.select("system", "qid", metric("grades").alias("value"))


@register("custom_fusion", """
WITH t AS (SELECT system, qid, did, score FROM runs),
     mm AS (SELECT system, qid, min(score) AS lo, max(score) AS hi FROM t GROUP BY system, qid),
     n AS (SELECT t.qid, t.did, (t.score - mm.lo) / CASE WHEN mm.hi > mm.lo THEN mm.hi - mm.lo ELSE 1.0 END AS n
           FROM t JOIN mm USING (system, qid)),
     s AS (SELECT qid, did, sum(n) AS score FROM n GROUP BY qid, did)
SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, did) AS rank, round(score, 6) AS score
FROM s
""", ("runs",))
def custom_fusion(spark, sf_dir):
    """A user fusion, CombSUM of min-max normalised scores over the whole lists;
    the contribution of a row is a pandas function."""
    from ..operators.fusion import fuse_custom

    def normal(rows: pd.DataFrame) -> pd.Series:
        width = rows["hi"] - rows["lo"]
        return (rows["score"] - rows["lo"]) / width.where(width > 0, 1.0)

    lists = V.runs(spark, sf_dir).select("system", "qid", "did", F.col("score").cast("double").alias("score"))
    out = fuse_custom(lists, normal, {"lo": F.min("score"), "hi": F.max("score")})
    return out.select("qid", "did", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))
