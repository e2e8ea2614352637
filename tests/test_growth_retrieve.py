"""What a task holds must not grow with the tables."""
from ranklab.operators import expand as R
from ranklab.session import broadcast_if_small, estimated_bytes, materialize


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sizes_of_stored_tables_are_known(spark):
    small = materialize(spark.range(100).withColumnRenamed("id", "k"), "small")
    assert 0 < estimated_bytes(small) < 1 << 20
    other = spark.range(1000).withColumnRenamed("id", "k")
    assert "ResolvedHint (strategy=broadcast)" in broadcast_if_small(small)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in broadcast_if_small(other, 10)._jdf.queryExecution().analyzed().toString()


def test_retrieval_sums_documents_where_they_are(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} x") for i in range(60)], "did long, text string")
    queries = spark.createDataFrame([(q, "x w0 w1") for q in range(20)], "qid long, text string")
    names, write = [], materialize

    def noted(df, name="table"):
        if name == "sums":
            names.append(_plan(df))
        out = write(df, name)
        names.append((name, out.count()))
        return out
    monkeypatch.setattr("ranklab.session.materialize", noted)
    for model in ("bm25", "ql"):
        names.clear()
        assert R.retrieve(queries, corpus, model, 2).count() == 40
        stored = dict(x for x in names if isinstance(x, tuple))
        assert "hits" not in stored and stored["sums"] < 20 * 60       # fewer than the matching pairs
        plan = next(x for x in names if isinstance(x, str))
        assert "hashpartitioning(qid" not in plan and "hashpartitioning(did" in plan
