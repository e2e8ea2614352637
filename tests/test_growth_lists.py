"""A user's metric must not cost a pandas group per list."""
from ranklab.plans.q_stream import custom_metric


def test_metric_gets_batches_of_lists(spark, tmp_path):
    # supplier 1: parts 1..6 of falling price, 1 and 3 returned; supplier 2: one unjudged part; and one without a key
    rows = [(1, p, 100.0 - p, 0.0, 10 - p, "R" if p in (1, 3) else "N", "F") for p in range(1, 7)]
    rows += [(2, 9, 5.0, 0.0, 1, "R", "O"), (None, 4, 5.0, 0.0, 1, "R", "F")]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_extendedprice double, l_discount double, l_quantity long, "
                                "l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = custom_metric(spark, str(tmp_path))
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.system, r.qid): r.value for r in out.collect()}
    assert got == {(s, q): v for s in "abc" for q, v in ((1, 0.4), (2, 0.0), (None, 0.0))}
    assert out.dtypes == [("system", "string"), ("qid", "bigint"), ("value", "double")]
