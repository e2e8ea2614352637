"""Groups in bounded parts, sampling as needed, gdeval names."""
from pyspark.sql import functions as F

from ranklab.functions import metrics as M
from ranklab.operators import groups as G


def test_a_hot_key_spans_many_parts(spark):
    n = 3000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
                               F.when(F.col("id") != 6, F.col("id")).alias("val"), (-F.col("id")).alias("ord"))
    spark.conf.set("ranklab.skew.hotRows", "200")
    try:
        long_ = G.group_collapse_long(df, "key", "val", ",", rows=64).collect()
        rows = G.group_rows_long(df, ["key"], ["val"], return_index=True, rows=64).collect()
    finally:
        spark.conf.unset("ranklab.skew.hotRows")
    want = {}
    for i in reversed(range(n)):
        want.setdefault("hot" if i % 3 == 0 else f"k{i % 50}", []).append("" if i == 6 else str(i))
    assert sum(r.key == "hot" for r in long_) == -(-len(want["hot"]) // 64)
    for key, values in want.items():
        parts = sorted((r for r in long_ if r.key == key), key=lambda r: r.part)
        assert ",".join(r.val for r in parts).split(",") == values
        assert [len(r.val.split(",")) for r in parts[:-1]] == [64] * (len(parts) - 1)
        got = [x for r in sorted((r for r in rows if r.key == key), key=lambda r: r.part) for x in r["index"]]
        assert got == sorted(got) and len(got) == len(values)


def test_sample_with_replacement_where_needed(spark):
    df = spark.createDataFrame([("small", i, i) for i in range(2)] + [("large", i, i) for i in range(20)], "key string, val long, ord long")
    out = G.group_sample(df, "key", 5, replace=None, seed=1).collect()
    assert sum(r.key == "small" for r in out) == 5 == sum(r.key == "large" for r in out)
    assert len({r.val for r in out if r.key == "large"}) == 5


def test_gdeval_stands_for_both_measures(spark):
    assert M.expand_measures(["gdeval", "P_5", "gdeval@5", "gdeval_ndcg@5"]) == [
        "gdeval_ndcg@20", "gdeval_err@20", "P_5", "gdeval_ndcg@5", "gdeval_err@5"]
    run, qrels = M.grades_to_run(spark, {"q": [3, 0, 1]})
    names = {r.metric for r in M.evaluate(run, qrels, ["gdeval@2"]).collect()}
    assert names == {"gdeval_ndcg@2", "gdeval_err@2"}
