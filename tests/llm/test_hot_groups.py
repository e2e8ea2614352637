"""Large groups: a passage that many texts share, strings of a common phrase."""
import random

from ranklab.llm import common, near_dedup, suffix_dedup


def counted(monkeypatch, module, rows):
    def stored(df, name):
        out = common.stored(df, name)
        rows.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(module, "stored", stored)


def test_a_common_passage_is_not_compared_in_pairs(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passage = " ".join(word() for _ in range(400))
    texts = [f"{passage} {' '.join(word() for _ in range(20))}" for _ in range(240)]
    texts += [t + " end" for t in texts[:40]]
    rows = {}
    counted(monkeypatch, near_dedup, rows)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == {i: i if i < 240 else i - 240 for i in range(280)}
    assert rows["rare"][0] > 0
    assert sum(rows["pairs"]) < 12_000            # of 39,060; 37,857 before


def test_rare_shingles_lose_no_link(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words[:5 + i % 36]) for _ in range(rng.randrange(5, 60))) for i in range(60)]
    for t in list(texts):
        cut = t.split()
        for _ in range(3):
            cut[rng.randrange(len(cut))] = rng.choice(words)
            texts.append(" ".join(cut))
    texts = sorted(set(texts))
    import numpy as np
    import pyarrow as pa
    s = near_dedup.Shingles(pa.array(texts))
    h, own, n = np.unique(s.hash, return_inverse=True, return_counts=True)
    counts = n[own]
    weights = s.count * near_dedup.idf(len(texts), counts)
    edge = np.searchsorted(s.text, np.arange(s.n + 1))
    links = 0
    for threshold in (0.5, 0.8):
        at = near_dedup.rarest(s.hash, counts, weights, s.text, s.n, threshold)
        rare = [set(s.hash[at[s.text[at] == i]].tolist()) for i in range(s.n)]
        sets = [dict(zip(s.hash[a:b].tolist(), weights[a:b].tolist(), strict=True)) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        for i in range(s.n):
            for j in range(i):
                both = sum(min(w, sets[j].get(x, 0.0)) for x, w in sets[i].items())
                if both >= threshold * (sum(sets[i].values()) + sum(sets[j].values()) - both):
                    links += 1
                    assert rare[i] & rare[j]
    assert links > 40


def test_a_stored_table_leaves_no_setting_behind(spark):
    before = spark.conf.get(common.FREED)
    assert common.stored(spark.range(100).repartition(4, "id"), "t").count() == 100
    assert spark.conf.get(common.FREED) == before
def test_strings_of_hot_anchors_are_made_once(spark, monkeypatch):
    rng = random.Random(7)
    prose = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    phrase = prose(120)
    texts = [prose(150) + phrase + prose(150) for _ in range(30)]
    texts += [t[60:-60] for t in texts[:5]]
    rows = {}
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    counted(monkeypatch, suffix_dedup, rows)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df, keep_first=False).collect()}
    assert [got[i] for i in range(35)] == [len(texts[0]) - 120] * 5 + [0] * 25 + [len(texts[0]) - 120] * 5
    assert "strings" in rows


def test_texts_too_far_apart_for_a_link_are_no_pairs(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passage = " ".join(word() for _ in range(400))
    # a sixth of each text's weight is its own: two of them are 0.71 alike
    texts = [f"{passage} {' '.join(word() for _ in range(10))}" for _ in range(240)]
    rows = {}
    counted(monkeypatch, near_dedup, rows)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == {i: i for i in range(240)}
    assert sum(rows["rare"]) > 1000
    assert sum(rows["pairs"][1:]) == 0


def test_copies_of_a_text_are_counted_once(spark):
    """Against counts and weights that don't come from the operator."""
    import collections
    import itertools
    import math
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts = [" ".join(word() for _ in range(60)) for _ in range(250)]
    for group in range(3):
        base = [word() for _ in range(200)]
        texts += [" ".join(base)] * 120 + [" ".join(base).upper() + " !", "  " + ",  ".join(base)] * 20
        for edits in (1, 2, 3, 12):                       # near copies
            cut = list(base)
            for i in range(edits):
                cut[15 * i + group + edits] = word()
            texts.append(" ".join(cut))
    words = ["".join(c if c.isalnum() else " " for c in t.lower()).split() for t in texts]
    sets = sorted({tuple(w) for w in words})
    cut = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in sets]
    in_docs = collections.Counter(g for c in cut for g in c)
    weigh = lambda grams: sum(math.log(1 + len(sets) / in_docs[g]) for g in grams)
    label = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if cut[i] & cut[j] and weigh(cut[i] & cut[j]) >= 0.8 * weigh(cut[i] | cut[j]):
            label = [label[i] if x == label[j] else x for x in label]
    assert len(set(label)) == 250 + 3 + 3                 # all but those of 12 edits
    of = {w: label[i] for i, w in enumerate(sets)}
    want = {}
    for i, w in enumerate(words):
        want.setdefault(of[tuple(w)], i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == [want[of[tuple(w)]] for w in words]
    # copies of all rows change nothing
    again = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df.unionByName(df)).collect()}
    assert again == got
