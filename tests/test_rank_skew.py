"""The skew-aware ranker must give the same ranks and running sums whether
a group takes the window path or the split (hot) path."""
from pyspark.sql import functions as F

from ranklab.operators.rank import rank_rows, top_k


def test_hot_path_equals_window_path(spark):
    rows = [("hot", i, float(i % 17), i % 3) for i in range(400)] + [("cold", i, float(i), 1) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, did long, score double, flag int")
    order = [F.col("score").desc(), F.col("did")]
    run = {"hits": F.when(F.col("flag") == 1, 1).otherwise(0)}
    a = {(r.k, r.did): (r["rank"], r.hits) for r in rank_rows(df, ["k"], order, "rank", run, hot_rows=0).collect()}
    b = {(r.k, r.did): (r["rank"], r.hits) for r in rank_rows(df, ["k"], order, "rank", run, hot_rows=50).collect()}
    assert a == b
    assert sorted(v[0] for k, v in b.items() if k[0] == "hot") == list(range(1, 401))


def test_top_k_plans_window_group_limit(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    plan = top_k(df, ["k"], [F.col("v").desc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
