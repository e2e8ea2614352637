"""Queries that read the corpus, or make their records, once."""
from ranklab.sinks import formats as K
from ranklab.sources import formats as S


def _corpus(spark, tmp_path):
    rows = [(i, f"low lower lowest newer {i % 7} wider") for i in range(40)] + [(40, None), (41, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_bpe_segments_counts_words_once(spark, tmp_path):
    from ranklab.plans import q_text
    out = q_text.bpe_segments(spark, _corpus(spark, tmp_path))
    assert not [f for f in out.inputFiles() if "documents" in f]
    assert {r.term for r in out.collect()} == {"low", "lower", "lowest", "newer", "wider", *"0123456"}


def test_encode_decode_numbers_words_once(spark, tmp_path, monkeypatch):
    from ranklab.plans import q_text
    d = _corpus(spark, tmp_path)
    monkeypatch.setattr(q_text.V, "queries", lambda *_: spark.createDataFrame([(1, "lower, unknown newer"), (2, "")], "qid long, text string"))
    out = q_text.encode_decode(spark, d)
    assert not [f for f in out.inputFiles() if "documents" in f]
    assert {r.qid: r.text for r in out.collect()} == {1: "lower newer", 2: ""}


def test_trec_records_are_made_once(spark):
    docs = spark.createDataFrame([(1, "Ein  Text, <b>"), (2, None), (3, "")], "did long, text string")
    out = S.parse_trec_docs(K.to_trec_text(docs).select("value"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<DOCNO>%s</DOCNO>") == 1
    got = {r.did: r.text for r in out.collect()}
    assert got["1"] == "ein text b" and got["3"] == "" and set(got) == {"1", "2", "3"}


def test_text_without_a_record_is_left_out(spark):
    v = spark.createDataFrame([("<DOC>\n<DOCNO> a </DOCNO>\n<TEXT>\nx\n</TEXT>\n</DOC>",), ("\n",), (None,)], "value string")
    assert [tuple(r) for r in S.parse_trec_docs(v).collect()] == [("a", "x")]
