"""What a task holds must not grow with the tables."""
from ranklab.plans import views as V


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_by_size(spark, tmp_path, monkeypatch):
    rows = [(i % 7 if i % 11 else None, i % 13, 10.0 * i, 0.1, i % 5, "R" if i % 3 else "N", "F" if i % 2 else "O") for i in range(500)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_extendedprice double, l_discount double, l_quantity long, "
                                "l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    views = (V.runs, V.qrels, V.variants, V.variant_scores)
    before = [sorted(map(str, v(spark, str(tmp_path)).collect())) for v in views]
    assert "RoundRobin" not in _plan(V.runs(spark, str(tmp_path))) and "REPARTITION_BY_NUM" not in _plan(V.runs(spark, str(tmp_path)))
    monkeypatch.setattr(V, "LINES_BYTES", 100)
    plan = _plan(V.runs(spark, str(tmp_path)))
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert [sorted(map(str, v(spark, str(tmp_path)).collect())) for v in views] == before
