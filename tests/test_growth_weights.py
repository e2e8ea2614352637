"""What a task holds must not grow with the tables."""
from pyspark.sql import functions as F

from ranklab.operators import fusion as FU


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_weights_do_not_gather_a_system_in_one_task(spark):
    runs = spark.range(200).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("system"),
                                   (F.col("id") % 10).alias("qid"), F.col("id").alias("did"), F.col("id").alias("score"))
    w = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "system string, weight double")
    for out in (FU.fuse_rrf(runs, k=10, depth=5, weights=w), FU.fuse_linear(runs, w)):
        assert not [x for x in _plan(out).splitlines() if "hashpartitioning(system#" in x and "qid#" not in x]
    assert FU.fuse_rrf(runs, k=10, depth=5, weights=w).count() == 50
