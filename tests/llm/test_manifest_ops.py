"""Exact dedup, Merkle manifest and collocations against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ranklab.llm import collocations as C
from ranklab.llm import exact_dedup as X
from ranklab.llm import merkle as M

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _t string"


def _docs(spark, rows, parts=3):
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def _norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def _copies(rng):
    texts = ["a  b\tc", "a b c", "a b  c ", "", None, " \n ", " a b c", "x" * 300 + "1", "x" * 300 + "2", "hot copy " * 20]
    rows = [(i, rng.choice(texts), "en", "s", 1, "extra") for i in range(120)]
    rows += [(1000 + i, "hot copy " * 20, "en", "s", 1, str(i)) for i in range(150)]          # one group over many partitions
    rows += [(7, "a b c", None, None, None, None)] * 3 + [(None, "a b c", "en", "s", 1, "z"), (None, "only null", "en", "s", 1, "z")]
    rows += [(5000, "long " * 40000, "en", "s", 1, "z"), (5001, "long\n" * 40000, "en", "s", 1, "z")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [1, 7, 40])
def test_exact_dedup_groups(spark, width):
    rows = _copies(random.Random(width))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    try:
        df = _docs(spark, rows)
        got = X.duplicate_groups(df).collect()
        first = X.keep_first(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    groups = {}
    for r in rows:
        groups.setdefault(_norm(r[1]), []).append(r[0])
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [(r.text_sha256, r.doc_id) for r in got if r.kept]
    ids = {hashlib.sha256(t.encode()).hexdigest(): min((i for i in v if i is not None), default=None) for t, v in groups.items()}
    assert sorted(kept, key=str) == sorted(ids.items(), key=str)
    assert sorted((hashlib.sha256(_norm(r.text).encode()).hexdigest() for r in first)) == sorted(ids)
    assert first[0].__fields__ == [c.split(" ")[0] for c in DOCS.split(", ")]


def test_exact_dedup_of_nothing(spark):
    assert X.duplicate_groups(_docs(spark, [])).count() == 0


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(leaves, fanout):
    """Root and, per leaf, the list of (before, after)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        up = [_h(*level[i:i + fanout]) for i in range(0, len(level), fanout)]
        for i, p in enumerate(at):
            run = p // fanout * fanout
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1:run + fanout])))
            at[i] = p // fanout
        level = up
    return level[0], paths


def _manifest(rows, fanout):
    leaf = [(r, _h(*[_field(r[i]) for i in (0, 3, 2, 4, 1)])) for r in rows]
    groups = {}
    for r, h in leaf:
        groups.setdefault(r[2], []).append((r[0], h))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs[g] = _tree([h for _, h in groups[g]], fanout)
    root, tops = _tree([subs[g][0] for g in names], fanout)
    out = Counter()
    for g, top in zip(names, tops):
        for (i, h), path in zip(groups[g], subs[g][1]):
            out[(i, g, h, subs[g][0], root, tuple(path + top))] += 1
    return out


@pytest.mark.parametrize("fanout,block", [(2, 4), (2, 4096), (3, 9), (5, 5)])
def test_merkle_manifest(spark, monkeypatch, fanout, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rng = random.Random(fanout * block)
    texts = ["", None, "été\n", "x" * 50000, "plain"]
    rows = [(rng.choice([i, i, None]), rng.choice(texts), rng.choice(["en", "en", "en", "de", "", None]), rng.choice(["s", None]), rng.choice([3, None]), "e")
            for i in range(70)]
    rows += [(5, "twice", "en", "s", 3, "e")] * 4 + [(9, "alone", "zz", "s", 1, "e")]
    got = M.manifest(_docs(spark, rows), fanout=fanout).collect()
    assert Counter((r.id, r.group, r.leaf, r.subroot, r.root, tuple((e.before, e.after) for e in r.path)) for r in got) == _manifest(rows, fanout)


def test_merkle_of_one_and_none(spark):
    one = M.manifest(_docs(spark, [(1, "t", "en", "s", 1, "")])).select("*", M.proof_digest(F.col("path")).alias("p"), M.fold(F.col("leaf"), F.col("path")).alias("f")).first()
    assert one.leaf == one.subroot == one.root == one.f and one.path == [] and one.p == _h("")
    assert M.manifest(_docs(spark, [])).count() == 0


def test_merkle_query_finds_tampering(spark, tmp_path):
    rows = [(i, f"text {i}", ["en", "de", None][i % 3], "s", [i, None, 2 ** 63 - 1][i % 5 % 3], "") for i in range(60)]
    _docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for r in M.op12_merkle_manifest(spark, str(tmp_path)).collect():
        bad = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and rows[r.doc_id][4] is not None
        assert r.verified == (not bad) and (r.folded_root == r.root) == (not bad)


def _collocations(rows, longest, least, share, report):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p for q, b in cand.items() for k in range(2, len(q)) for i in range(len(q) - k + 1)
                for p in [q[i:i + k]] if 100 * b >= share * cand[p]}
        rows_ = []
        for p, a in cand.items():
            if p not in gone:
                s, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-s, -a, " ".join(p).encode(), " ".join(p), a, c[p[:k]], c[p[k:]], n[lang], s))
        out += [(lang, i + 1, *r[3:]) for i, r in enumerate(sorted(rows_)[:report])]
    return sorted(out)


@pytest.mark.parametrize("longest,shards,bits", [(3, 4, 1 << 14), (4, 2, 64), (2, 1, 1 << 10)])
def test_collocations(spark, monkeypatch, longest, shards, bits):
    monkeypatch.setattr(C, "SLICE_DOCS", 5)
    rng = random.Random(longest)
    words = ["the", "New", "york", "city", "été", "of", " x", "a-b", "ÀB"]
    sep = [" ", " ", " ", "\t ", ". ", "\x0b", ", "]
    def text():
        return "".join(rng.choice(["new york city ", "of the "]) if rng.random() < .2 else rng.choice(words) + rng.choice(sep) for _ in range(rng.randint(1, 25)))
    rows = [(i, text(), rng.choice(["en", "en", "fr", None]), "s", 1, "") for i in range(150)]
    rows += [(200, "", "en", "s", 1, ""), (201, None, "de", "s", 1, ""), (202, "the the the the " * 3000, "en", "s", 1, ""), (203, ".,;", None, "s", 1, "")]
    counts = C.count_phrases(_docs(spark, rows), longest=longest, least=5, shards=shards, filter_bits=bits)
    got = C.collocations(counts, least=5, share=50, report=30).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == _collocations(rows, longest, 5, 50, 30)


def test_phrases_travel_in_parts(spark, monkeypatch):
    """A slice sends a row per part, not one per phrase, and the parts are summed whole."""
    monkeypatch.setattr(C, "PART", 100)
    monkeypatch.setattr(C, "ROW", 16)
    monkeypatch.setattr(C, "SEND_ROWS", 50)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(20)), ["en", "de"][i % 2], "s", 1, "") for i in range(40)]
    coded, _ = C._shards(_docs(spark, rows), "text", "lang", 2)
    one = coded.select("ids", "codes").limit(1)
    full = spark.sparkContext.broadcast(b"\xff" * 8)
    sent = one.mapInArrow(C._scan(full, None, True, 3, 4), "part int, w1 binary, w2 binary, w3 binary, n binary").collect()
    assert len(sent) <= 3 * 4 and sum(len(r.n) // 8 for r in sent) > 100
    counts = C.count_phrases(_docs(spark, rows), least=4, shards=2, filter_bits=1 << 12)
    got = C.collocations(counts, least=4, share=50, report=1000).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == _collocations(rows, 3, 4, 50, 1000)


def test_collocations_edge_cases(spark):
    assert C.collocations(C.count_phrases(_docs(spark, []))).count() == 0
    big = 3 * 10 ** 14
    s = spark.range(1).select(C.score_of(F.lit(big), F.lit(big + 7), F.lit(big * 3)).alias("s")).first().s
    assert s == 1000000 * big * big // ((big + 7) * (big * 3))
