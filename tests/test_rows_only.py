"""Invariants of the rows-only operators (random by design or not
SQL-expressible): size, subset, determinism, ranges."""
from pyspark.sql import functions as F

from conftest import SMOKE

import __spark_entry__ as E
from ranklab.operators import fusion as FU
from ranklab.operators import groups as G
from ranklab.plans import views as V


def _lines(spark):
    return V.table(spark, SMOKE, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
        F.col("l_partkey").alias("val"))


def test_group_sample_without_replacement(spark):
    li = _lines(spark)
    a = G.group_sample(li, "key", 2, seed=5)
    b = G.group_sample(li, "key", 2, seed=5)
    assert sorted(map(tuple, a.select("key", "val").collect())) == sorted(map(tuple, b.select("key", "val").collect()))
    assert a.groupBy("key").count().agg(F.max("count")).first()[0] <= 2
    assert a.join(li, ["key", "ord", "val"], "left_anti").count() == 0
    sizes = li.groupBy("key").count().withColumn("want", F.least("count", F.lit(2)))
    got = a.groupBy("key").agg(F.count("*").alias("got"))
    assert sizes.join(got, "key").where(F.col("want") != F.col("got")).count() == 0


def test_group_sample_with_replacement(spark):
    li = _lines(spark)
    s = G.group_sample(li, "key", 3, replace=True, seed=1)
    assert s.groupBy("key").count().where(F.col("count") != 3).count() == 0
    assert s.join(li, ["key", "ord", "val"], "left_anti").count() == 0


def test_random_fusion_deterministic(spark):
    run = V.variants(spark, SMOKE)
    a = FU.fuse_random(run, 2, seed=3, depth=50).select("qid", "did", "rank").collect()
    b = FU.fuse_random(run, 2, seed=3, depth=50).select("qid", "did", "rank").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_pvalues_in_range(spark):
    rows = E.queries()["ttest_pvalues"](spark, SMOKE).collect()
    assert rows
    for r in rows:
        assert 0.0 <= r.p <= 1.0 and r.p - 1e-12 <= r.p_adj <= 1.0
