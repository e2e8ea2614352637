"""Plan shape of the flagship evaluation: top-k cut before the shuffle,
pruned scan columns, and no unpartitioned window."""
from conftest import SMOKE

import __spark_entry__ as E


def test_flagship_plan(spark):
    df = E.queries()["gdeval_ndcg_err"](spark, SMOKE)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "SinglePartition" not in plan
    scans = [line for line in plan.splitlines() if "lineitem.parquet" in line]
    assert scans and all("l_shipdate" not in s and "l_orderkey" not in s for s in scans)


def test_retrieval_scans_corpus_once(spark):
    df = E.queries()["relevance_model"](spark, SMOKE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # postings are written once and read back; the raw documents are only
    # scanned for the document count
    assert plan.count("documents.parquet") <= 1
