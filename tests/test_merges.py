"""Subword merges: learned rules build on rules; cutting equals the plain loop."""
import random

from ranklab.functions import text as X


def _cut(word, ranks):
    sym = list(word)
    while True:
        fits = [(ranks[(a, b)], a, b) for a, b in zip(sym, sym[1:]) if (a, b) in ranks]
        if not fits:
            return " ".join(sym)
        _, a, b = min(fits)
        out, i = [], 0
        while i < len(sym):
            if sym[i:i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(sym[i])
                i += 1
        sym = out


def _words(rng, n):
    return sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(n)})


def test_learned_merges_and_their_use(spark):
    rng = random.Random(3)
    words = [(w, rng.randint(1, 50)) for w in _words(rng, 200)] + [("", 9), ("aaaa", 70)]
    df = spark.createDataFrame(words, "term string, tf long")
    rules = [r.pair for r in X.learn_merges(df, 4, 5).orderBy("rank").collect()]
    # The same rounds by hand.
    state, want = {w: list(w) for w, _ in words}, []
    for _ in range(4):
        n = {}
        for w, tf in words:
            for p in zip(state[w], state[w][1:]):
                n[p] = n.get(p, 0) + tf
        best = {}
        for p in sorted(n, key=lambda p: (-n[p], p[0].encode(), p[1].encode())):
            best.setdefault("".join(p), p)
        made = {"".join(p) for p in want}
        new = [p for m, p in best.items() if m not in made][:5]
        for i, p in enumerate(new):
            for w in state:
                state[w] = _cut_one(state[w], p)
        want += new
    assert rules == [" ".join(p) for p in want]
    assert any(len(p[0]) > 1 or len(p[1]) > 1 for p in want)
    got = {r.term: r.subwords for r in X.apply_merges(df, spark.createDataFrame([(r, i) for i, r in enumerate(rules)], "pair string, rank int")).collect()}
    assert got == {w: " ".join(state[w]) for w, _ in words}


def _cut_one(sym, pair):
    out, i = [], 0
    while i < len(sym):
        if tuple(sym[i:i + 2]) == pair:
            out.append("".join(pair))
            i += 2
        else:
            out.append(sym[i])
            i += 1
    return out


def test_foreign_rules_in_rank_order(spark):
    # (abc, d) ranks before (a, bc): a later rule makes an earlier one fit.
    pairs = ["a b", "ab c", "abc d", "b c", "a bc", "d e", "é a", "a a"]
    ranks = {tuple(p.split(" ")): i for i, p in enumerate(pairs)}
    rng = random.Random(4)
    words = _words(rng, 300) + ["abcde", "bcabcd", "aaaaa", "", "zz", None]
    merges = spark.createDataFrame([(p, i) for i, p in enumerate(pairs)], "pair string, rank int")
    got = {r.term: r.subwords for r in X.apply_merges(spark.createDataFrame([(w,) for w in words], "term string"), merges).collect()}
    assert got == {w: None if w is None else _cut(w, ranks) for w in words}
    none = spark.createDataFrame([], "pair string, rank int")
    assert X.apply_merges(spark.createDataFrame([("ab",)], "term string"), none).first().subwords == "a b"
