"""Toxicity, top-k search, near duplicates, mixing: brute force and edge cases."""
import collections
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ranklab.llm import mixing, near_dedup, topk_search, toxicity

TEXT = "doc_id long, text string"


# --- toxicity -------------------------------------------------------------------

def test_likeness_is_the_kernel():
    def subsequences(w):
        out = collections.Counter()
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN:
                out[w[i] + w[j] + w[k]] += toxicity.LAMBDA ** (k - i + 1)
        return out

    marks = ["idiot", "lowe", "vequß", "disgusting"]
    words = ["idiot", "id-iot", "i.d.i.o.t", "toidi", "loweisch", "xlo-we", "vequß", "disgusted", "ing", "harmless", "日本語日本"]
    model = toxicity.Model(marks, np.eye(4), np.zeros(4), 0.0, (1.0, 0.0))
    near, value = model.likeness(words)
    got = np.zeros((len(words), 4))
    got[near] = value
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            a, b = subsequences(w), subsequences(m)
            k = sum(v * b[u] for u, v in a.items()) / sum(v * v for v in b.values())
            assert got[i, j] == pytest.approx(min(1, max(0, (k - toxicity.FLOOR) / (1 - toxicity.FLOOR))), abs=1e-5)
    assert got[0, 0] == 1 and got[1, 0] > 0.5 and got[2, 0] > 0 and got[3, 0] < got[2, 0]


def labelled(n=260, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["the", "an", "re", "on", "ti", "er", "ha"]) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w = rng.choice(["moron", "scumbag", "vequja"])
                words.insert(rng.randrange(len(words)), w if i % 8 else "-".join((w[:2], w[2:])))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = labelled()
    d = spark.createDataFrame([(*x, 0.5, "c") for x in docs + [(900, None), (901, ""), (None, "you moron scumbag"), (902, "m o r o n s c u m b a g " * 2)]],
                              TEXT + ", score double, row string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (10_000, 1)], "doc_id long, toxic int")
    model = toxicity.train(d.select("doc_id", "text"), lab)
    out = {r.doc_id: r for r in toxicity.score_documents(d, model).collect()}
    assert len(out) == len(docs) + 4
    for i, _ in docs:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert out[i].predicted == int(out[i].score >= 0.5)
    test = [(out[i].predicted, y) for i, y in labels if out[i].held_out]
    assert np.mean([p == y for p, y in test]) > 0.95
    assert out[900].predicted == out[901].predicted == 0 and out[900].score == out[901].score
    assert out[None].predicted == 1 and out[None].held_out is False
    kept = toxicity.drop_toxic(d, model)
    assert kept.columns == d.columns and kept.schema["score"].dataType == d.schema["score"].dataType
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted}


def test_held_out_labels_are_never_read(spark):
    docs, labels = labelled()
    d = spark.createDataFrame(docs, TEXT)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    models = [toxicity.train(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned)]
    assert models[0].landmarks == models[1].landmarks and models[0].bias == models[1].bias


def test_toxicity_without_labels(spark):
    docs, labels = labelled(40)
    d = spark.createDataFrame(docs, TEXT)
    none = toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert max(r.score for r in toxicity.score_documents(d, none).collect()) < 1e-9
    one = toxicity.train(d, spark.createDataFrame([(i, 1) for i, _ in labels], "doc_id long, toxic int"))
    assert all(r.predicted for r in toxicity.score_documents(d, one).collect())
    assert toxicity.score_documents(d.limit(0), none).count() == 0


# --- top-k search -----------------------------------------------------------------

VEC = "vec_id long, embedding array<float>"


def brute_top(vectors, k):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in vectors
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in dict((i, v) for i, v in ok if i % 20 == 0).items():
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.normal(size=16) / 4).astype(np.float32).tolist()) for i in range(400)]
    vectors += [(i, vectors[7][1]) for i in range(400, 440)]                       # ties
    vectors += [(440, None), (441, [None] * 16), (460, [float("nan")] + [0.0] * 15), (461, [float("inf")] * 16), (480, []), (500, [0.5] * 9),
                (None, [1.0] * 16)]
    df = spark.createDataFrame([(*v, 1, 2) for v in vectors], VEC + ", rank int, score int")
    got = topk_search.top_k(df, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(vectors, 20)


def test_top_k_small_tables_and_large_numbers(spark):
    ask = F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False))
    few = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [-1.0, 1.0])]
    got = topk_search.top_k(spark.createDataFrame(few, VEC), ask).collect()
    assert sorted(tuple(r) for r in got) == brute_top(few, 20) and len(got) == 2
    big = [(0, [1e9, 3.0]), (1, [1e9, -2.0]), (2, [1e9, -3.0]), (20, [0.0, 1.0])]
    got = topk_search.top_k(spark.createDataFrame(big, VEC), ask).collect()
    assert sorted(tuple(r) for r in got) == [(a, b, c, max(-(1 << 63), min((1 << 63) - 1, d))) for a, b, c, d in brute_top(big, 20)]
    assert topk_search.top_k(spark.createDataFrame([], VEC), ask).count() == 0
    twice = spark.createDataFrame(few + few, VEC)
    assert sorted(r.vec_id for r in topk_search.top_k(twice, ask).collect()) == [1, 1, 2, 2]


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(5)
    x, q = rng.integers(-30, 30, (300, 12)), rng.integers(-30, 30, (20, 12))
    b = topk_search.Block(np.arange(300), np.zeros(300, np.int64), x)
    for depth in (0.1, 0.5, 0.9, 1.0):
        lower, upper = b.bounds(np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float), depth)
        assert (lower <= q @ x.T).all() and (upper >= q @ x.T).all()
    assert (lower == upper).all()


def test_large_scores_are_ordered_by_all_their_bits():
    """More candidates than 4k round to one double; the best have the largest ids."""
    n, k = 200, 3
    values = np.column_stack((np.full(n, 1 << 30), np.arange(n))).astype(np.int64)
    block = topk_search.Block(np.arange(n), np.zeros(n, np.int64), values)
    q, c, score = block.search(np.array([-1]), np.array([[1 << 31, 1], ], np.int64), k)
    assert q.tolist() == [0] * k and block.ids[c].tolist() == [n - 1, n - 2, n - 3]
    assert score.tolist() == [(1 << 61) + j for j in (n - 1, n - 2, n - 3)]
    low = topk_search.Block(np.arange(2), np.zeros(2, np.int64), np.array([[-1 << 62], [-1]], np.int64))
    q, c, score = low.search(np.array([-1]), np.array([[4]], np.int64), 2)
    assert c.tolist() == [1, 0] and score.tolist() == [-4, -(1 << 63)]


# --- near duplicates ----------------------------------------------------------------

def near_corpus(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    base = [[word() for _ in range(rng.randrange(40, 160))] for _ in range(25)]
    docs = [" ".join(b) for b in base]
    for b in base[:10]:
        for _ in range(4):
            c = list(b)
            for _ in range(rng.randrange(1, 4)):
                c[rng.randrange(len(c))] = word()
            docs.append(" ".join(c))
    for _ in range(40):                                      # one large group
        c = list(base[20])
        c[rng.randrange(len(c))] = word()
        docs.append(" ".join(c))
    docs += [docs[0].upper() + " !!", docs[0], "", None, "...", "one two", "one two", "one two three", "same " * 300, "same " * 290]
    rng.shuffle(docs)
    return docs


def brute_classes(docs, idf):
    s = near_dedup.Shingles(pa.array([d or "" for d in docs]))
    w = s.weights(idf)
    sets = [{} for _ in docs]
    for t, h, x in zip(s.text.tolist(), s.hash.tolist(), w.tolist(), strict=True):
        sets[t][h] = x
    label = list(range(len(docs)))
    for i, j in itertools.combinations(range(len(docs)), 2):
        both = sum(min(x, sets[j].get(h, 0.0)) for h, x in sets[i].items())
        total = sum(sets[i].values()) + sum(sets[j].values()) - both
        if (both / total if total else 1.0) >= near_dedup.THRESHOLD - 1e-9:
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_near_duplicates_against_brute_force(spark):
    docs = near_corpus()
    df = spark.createDataFrame([(i, d, b"k", 1) for i, d in enumerate(docs)], TEXT + ", key binary, label int")
    idf = near_dedup.inverse_frequencies(df.select(F.coalesce("text", F.lit("")).alias("_t")))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(docs))] == brute_classes(docs, idf)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_documents_are_counted_for_each_shingle(spark, monkeypatch):
    """Against counts and weights that don't come from the operator."""
    rng = random.Random(6)
    docs = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(1000)) for _ in range(150)]
    docs += [" ".join([*docs[i].split()[:920 - 10 * i], *(f"v{i}x{j}" for j in range(80 + 10 * i))]) for i in range(12)]
    common = " ".join(f"c{j}" for j in range(300))
    docs = [f"{d} {common}" if i % 2 else d for i, d in enumerate(docs)]
    cut = [collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in (d.split() for d in docs)]
    in_docs = collections.Counter(g for c in cut for g in c)
    weigh = [{g: n * math.log(1 + len(docs) / in_docs[g]) for g, n in c.items()} for c in cut]
    links = set()
    for i, j in itertools.combinations(range(len(docs)), 2):
        both = sum(min(x, weigh[j].get(g, 0.0)) for g, x in weigh[i].items())
        if both / (sum(weigh[i].values()) + sum(weigh[j].values()) - both) >= near_dedup.THRESHOLD:
            links.add((i, j))
    assert 0 < len(links) < 12
    monkeypatch.setattr(near_dedup, "PART", 50_000)
    df = spark.createDataFrame(list(enumerate(docs)), TEXT).repartition(3)
    known = near_dedup.inverse_frequencies(df.select(F.col("text").alias("_t")))
    assert sorted(known.n.tolist()) == sorted(n for n in in_docs.values() if n > 1)
    s = near_dedup.Shingles(pa.array(docs))
    got = np.bincount(s.text, s.weights(known), len(docs))
    assert got == pytest.approx([sum(w.values()) for w in weigh], rel=1e-9)
    classes = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert {(c, i) for i, c in classes.items() if c != i} == links


def test_samples_drop_no_links_at_other_thresholds(spark):
    for x in (0.5, 0.6, 0.8, 0.95):
        k = near_dedup.least_agreeing(x)
        tail = [sum(math.comb(48, i) * x ** i * (1 - x) ** (48 - i) for i in range(m)) for m in (k, k + 1)]
        assert tail[0] <= near_dedup.MISS < tail[1]
    rng = random.Random(4)
    docs = []
    for i in range(60):
        words = [f"w{rng.randrange(10_000)}" for _ in range(104)]
        docs += [words, [*words[:81], *(f"v{i}x{j}" for j in range(23))]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], TEXT)
    known = near_dedup.inverse_frequencies(df.select(F.col("text").alias("_t")))
    s = near_dedup.Shingles(pa.array([" ".join(w) for w in docs]))
    w = s.weights(known)
    drawn = near_dedup.samples(s.hash, w, s.text, s.n, 48)
    sets = [dict(zip(s.hash[s.text == i].tolist(), w[s.text == i].tolist(), strict=True)) for i in range(len(docs))]
    links, few = set(), 0
    for i in range(0, len(docs), 2):
        both = sum(min(x, sets[i + 1].get(h, 0.0)) for h, x in sets[i].items())
        alike = both / (sum(sets[i].values()) + sum(sets[i + 1].values()) - both)
        same = drawn[i] == drawn[i + 1]
        if alike >= 0.55 and same.reshape(16, 3).all(axis=1).any():
            links.add((i, i + 1))
            few += same.sum() < 27
    assert few                                              # a fixed 27 would drop these
    classes = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df, 0.55).collect()}
    assert {(c, i) for i, c in classes.items() if c != i} == links


def test_near_duplicates_of_odd_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "other words in this text here"), (None, None)]
    df = spark.createDataFrame(rows, TEXT)
    got = sorted(((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (2, 2), (None, None)], key=repr)
    assert near_dedup.keep_one(df).count() == 3
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0 and near_dedup.keep_one(df.limit(0)).count() == 0


def test_samples_agree_with_probability_of_the_similarity():
    rng = np.random.default_rng(9)
    h = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    wa, wb = rng.uniform(0.5, 4, 60), rng.uniform(0.5, 4, 60)
    a = near_dedup.samples(h, wa, np.zeros(60, np.int64), 1, 3000)
    b = near_dedup.samples(h, wb, np.zeros(60, np.int64), 1, 3000)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((a == b).mean() - want) < 0.04


def test_components(spark):
    key = lambda i: bytes([i])
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 21), (3, 40), (40, 41), (41, 42), (42, 43)]
    df = spark.createDataFrame([(key(a), key(b)) for a, b in links], "a binary, b binary")
    got = {r.node[0]: r.label[0] for r in near_dedup.components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 40: 1, 41: 1, 42: 1, 43: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 20: 20, 21: 20}


# --- mixing ---------------------------------------------------------------------------

def test_mixture_meets_its_weights(spark):
    rows = [(i, "x " * (1 + i % 7), "big" if i % 10 < 8 else "mid" if i % 10 == 8 else None, 0) for i in range(6000)]
    df = spark.createDataFrame(rows, TEXT + ", source string, _s int")
    m = mixing.visits(df, max_repeat=3.0).select("_row.*", "tokens", "weight").toPandas()
    n = {s: sum(1 + r[0] % 7 for r in rows if r[2] == s) for s in ("big", "mid", None)}
    spread = math.log(max(n.values()) / min(n.values()))
    alpha = 1 - math.log(3.0) / spread
    z = sum(x ** alpha for x in n.values())
    for s, x in n.items():
        part = m[m.source.isna()] if s is None else m[m.source == s]
        assert part.weight.iloc[0] == pytest.approx(x ** alpha / z, rel=1e-6)
        assert part.tokens.sum() / m.tokens.sum() == pytest.approx(x ** alpha / z, rel=0.01)
    assert set(m.doc_id) == set(range(6000))                       # nothing is lost
    visits = m[m.source == "mid"].groupby("doc_id").size()
    assert visits.min() >= 2 and visits.max() <= 3


def test_target_entropy_is_met(spark):
    src = spark.createDataFrame([("a", 800), ("b", 150), ("c", 50), ("d", 0)], "s string, n long")
    alpha = mixing.find_exponent(src, 0.9, 1e9)
    w = np.array([800, 150, 50.0]) ** alpha
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.9 * math.log(3), abs=1e-4)
    assert mixing.find_exponent(src, 0.1, 1e9) == 1.0
    assert mixing.find_exponent(src.limit(0)) == 1.0


def test_mixture_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, None, "t"), (None, "", None), (3, "c", "s")], TEXT + ", source string")
    m = mixing.mixture(df)
    assert m.columns == df.columns
    got = collections.Counter((r.doc_id, r.source) for r in m.collect())
    assert got == {(1, "s"): 2, (2, "t"): 1, (None, None): 1, (3, "s"): 1}
    assert mixing.mixture(df.limit(0)).count() == 0


def test_tokens_are_words(spark):
    df = spark.createDataFrame([("",), (" a  b\n\tc ",), ("one",)], "t string")
    assert [r.n for r in df.select(mixing.tokens(F.col("t")).alias("n")).collect()] == [0, 3, 1]
