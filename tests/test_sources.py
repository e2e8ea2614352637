"""Readers on real files (written to a fresh temp folder) and sinks."""
import os
import tempfile

from ranklab.sinks import formats as K
from ranklab.sources import formats as S


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_read_run_six_and_three_columns(spark):
    d = tempfile.mkdtemp(prefix="rl-src-", dir="/tmp")
    p6 = _write(d, "a.run", "1 Q0 d1 1 9.5 x\n1 Q0 d2 2 8.0 x\n1-2 Q0 d1 1 3.0 x\n1 Q0 d1 3 7.0 x  # repeat\nbad line\n")
    p3 = _write(d, "b.run", "7\td9\t2\n")
    r6 = {(r.vid, r.did): (r["rank"], r.score, r.qid) for r in S.read_run(spark, p6, comments=True).collect()}
    assert r6[("1", "d1")] == (3, 7.0, "1")          # last occurrence wins
    assert r6[("1-2", "d1")] == (1, 3.0, "1")        # variant → query id
    r3 = S.read_run(spark, p3).collect()[0]
    assert (r3.did, r3["rank"], r3.score) == ("d9", 2, 0.5)
    bad = {r.path.rsplit("/", 1)[-1]: r.malformed for r in S.find_malformed_runs(S.read_lines(spark, p6)).collect()}
    assert bad["a.run"] is True


def test_read_qrels_arity(spark):
    d = tempfile.mkdtemp(prefix="rl-src-", dir="/tmp")
    p = _write(d, "q.txt", "1 0 d1 2\n1 d2 1\n1 d3\n1 0 d1 0\n")
    got = {(r.qid, r.did): r.rel for r in S.read_qrels(spark, p).collect()}
    assert got == {("1", "d1"): 0, ("1", "d2"): 1, ("1", "d3"): 1}


def test_trec_docs_and_query_xml(spark):
    d = tempfile.mkdtemp(prefix="rl-src-", dir="/tmp")
    p = _write(d, "docs.trec", "<DOC>\n<DOCNO> D1 </DOCNO>\n<TEXT>\nHello\nworld\n</TEXT>\n</DOC>\n"
                               "<DOC>\n<DOCNO>D2</DOCNO>\n<TEXT>\nsecond\n</TEXT>\n</DOC>\n")
    docs = {r.did: r.text for r in S.read_trec_docs(spark, p, web=True).collect()}
    assert docs == {"D1": "Hello world", "D2": "second"}
    q = spark.createDataFrame([(1, "a < b & c"), (2, " ")], "qid long, text string")
    x = K.to_query_param(q).select("value")
    back = {r.qid: r.text for r in S.parse_query_param(x).collect()}
    assert back == {"1": "a < b & c", "2": "empty"}


def test_write_run_files(spark):
    d = tempfile.mkdtemp(prefix="rl-out-", dir="/tmp")
    run = spark.createDataFrame([(1, "d1", 1, 2.0), (1, "d2", 2, 1.0), (2, "d3", 1, 5.0)],
                                "qid long, did string, rank int, score double")
    K.write_run(run, os.path.join(d, "run"))
    back = S.read_run(spark, os.path.join(d, "run"))
    assert sorted((r.qid, r.did, r["rank"]) for r in back.collect()) == [("1", "d1", 1), ("1", "d2", 2), ("2", "d3", 1)]
