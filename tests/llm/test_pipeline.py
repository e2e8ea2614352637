"""The corpus pipeline by stages, and the registered queries against DuckDB."""
import collections
import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ranklab.llm import line_dedup, mixing, near_dedup, queries, toxicity
from ranklab.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = [(5000, "", "en", None, 0), (5001, None, "en", "src0", 0), (None, "a text without id\nof\nthree lines", None, "src0", 30),
       (5002, "word " * 20_000, "en", "odd", 100_000)]


@pytest.fixture(scope="module")
def docs(spark):
    d = table(spark, SF, "documents")
    odd = spark.createDataFrame(ODD, d.schema)
    # odd rows, a repeated row, and columns whose names clash with helpers'
    d = d.unionByName(odd).unionByName(d.where("doc_id = 7"))
    return d.withColumns({"row": F.lit("r"), "_k": F.lit(1), "key": F.lit(b"k"), "label": F.lit(2.5), "words": F.array(F.lit("w"))})


def test_stages_are_those_dealt():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_toxicity_stage(spark, docs):
    out = corpus_pipeline.toxicity(spark, docs, SF)
    assert out.columns == docs.columns
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, SF, "labels"))
    said = toxicity.score_documents(docs, model).collect()
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter(r.doc_id for r in said if not r.predicted)
    clean = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 0").collect()}
    kept = {r.doc_id for r in out.collect()}
    assert len(clean & kept) > 0.97 * len(clean)


def test_line_stage(spark, docs):
    out = corpus_pipeline.line_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    whole = line_dedup.cut_lines(docs).select("_row.*", "n_lines", "n_removed").collect()
    rows = out.collect()
    left = [r for r in whole if r.n_removed < r.n_lines]
    assert 0 < len(left) < len(whole) and any(r.n_removed for r in left)
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(((r.doc_id, r.text) for r in left), key=repr)
    cut = {r.doc_id for r in left if r.n_removed}
    assert all(r.n_chars == len(r.text) for r in rows if r.doc_id in cut)


def test_near_stage(spark, docs):
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    d = docs.collect()
    idf = near_dedup.inverse_frequencies(docs.select(F.coalesce("text", F.lit("")).alias("_t")))
    kept = collections.Counter(r.doc_id for r in out.collect())
    assert max(kept.values()) == 1
    texts = [r.text or "" for r in d]
    s = near_dedup.Shingles(pa.array(texts))
    w = s.weights(idf)
    sets = [{} for _ in d]
    post = collections.defaultdict(list)
    for t, h, x in zip(s.text.tolist(), s.hash.tolist(), w.tolist(), strict=True):
        sets[t][h] = x
        post[h].append(t)
    label = list(range(len(d)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for pair in {(a, b) for p in post.values() for a in p for b in p if a < b}:
        a, b = (sets[i] for i in pair)
        both = sum(min(x, b.get(h, 0.0)) for h, x in a.items())
        if both / (sum(a.values()) + sum(b.values()) - both) >= 0.8:
            x, y = sorted(map(root, pair))
            label[y] = x
    empty = [i for i, x in enumerate(sets) if not x]
    for i in empty:
        label[i] = empty[0]
    groups = collections.defaultdict(list)
    for i in range(len(d)):
        groups[root(i)].append(d[i].doc_id)
    assert set(kept) == {min(g, key=lambda i: (i is not None, i)) if None in g and len(g) == 1 else min((i for i in g if i is not None), default=None)
                         if None not in g else None for g in groups.values()}


def test_mixing_stage(spark, docs):
    out = corpus_pipeline.mixing(spark, docs, SF)
    assert out.columns == docs.columns
    got = collections.Counter((r.doc_id, r.source) for r in out.collect())
    want = collections.Counter((r.doc_id, r.source) for r in docs.collect())
    assert set(got) == set(want)                         # nothing is lost
    size = docs.groupBy(F.col("source").alias("s")).agg(F.sum(mixing.tokens(F.coalesce("text", F.lit("")))).alias("n"))
    alpha = mixing.find_exponent(size)
    n = {r.s: r.n for r in size.collect() if r.n}
    repeat = {s: (x / max(n.values())) ** (alpha - 1) for s, x in n.items()}
    assert max(repeat.values()) <= mixing.MAX_REPEAT + 1e-6
    for (i, s), k in got.items():
        if s in repeat:
            assert math.floor(repeat[s] + 1e-9) * want[i, s] <= k <= math.ceil(repeat[s] - 1e-9) * want[i, s]


def test_packing_stage(spark, docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    out = corpus_pipeline.packing(spark, docs, SF).toPandas()
    want, total = collections.Counter(), 0
    for r in docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        want.update((r.doc_id, zlib.crc32(ids[i:i + 4096].tobytes())) for i in range(0, len(ids), 4096))
    got = collections.Counter((None if math.isnan(i) else int(i), c) for i, c in zip(out.doc_id.astype(float), out.ids_crc32, strict=True))
    assert got == want
    assert out.sequence_id.nunique() <= math.ceil(total / 4096) + 1
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate(([0], g.length.cumsum()[:-1]))).all()


def test_stages_of_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    d = table(spark, SF, "documents").toPandas()
    assert set(out.doc_id) <= set(d.doc_id) and len(set(out.doc_id)) > 0.6 * len(d)
    assert out.groupby("sequence_id").length.sum().max() <= 4096


@pytest.mark.parametrize("name", sorted(queries.load()[1]))
def test_queries_match_duckdb(spark, name):
    found, sql = queries.load()
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    a, b = found[name](spark, SF).toPandas(), con.execute(sql[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    a, b = (x[sorted(a.columns)].astype(object).where(x[sorted(a.columns)].notna(), None) for x in (a, b))
    assert sorted(map(repr, map(tuple, a.to_numpy().tolist()))) == sorted(map(repr, map(tuple, b.to_numpy().tolist())))


def test_every_operator_has_a_query():
    found, _ = queries.load()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14))
