"""Suffix dedup and fingerprints: brute force and edge cases."""
import collections
import hashlib
import math
import random

import numpy as np
import pytest

from ranklab.llm import fingerprint, suffix_dedup

TEXT = "doc_id long, text string"


def brute_repeats(texts, length, keep_first):
    """{place: (n_bytes, n_removed, n_spans, sha)} for texts in order."""
    seen, first = collections.Counter(), {}
    raw = [(t or "").encode() for t in texts]
    for i, b in enumerate(raw):
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            seen[s] += 1
            first.setdefault(s, (i, p))
    out = []
    for i, b in enumerate(raw):
        gone, end = bytearray(len(b)), 0
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            if seen[s] > 1 and not (keep_first and first[s] == (i, p)):
                for q in range(max(p, end), p + length):
                    gone[q] = 1
                end = p + length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for q in range(len(b)) if gone[q] and not (q and gone[q - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdéß") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, phrase = prose(90), prose(12)
    texts = [prose(rng.randrange(5, 200)) for _ in range(30)]
    texts += [prose(20) + passage + prose(20) for _ in range(6)] + [passage[100:] + prose(9), passage]
    texts += [prose(40) + phrase + prose(40) for _ in range(150)]             # a common phrase, ever new surroundings
    texts += ["x" * 1000, "ab" * 300, "ab" * 99 + "a", "y" * 199, "y" * 200, "z" * 201, "", None]
    texts += [texts[3], texts[3], texts[4] + " more"]
    return texts


@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats_against_brute_force(spark, keep_first):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], TEXT + ", h string, at int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, keep_first=keep_first).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 200, keep_first)


def test_hot_anchors_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    texts = corpus()[:60]
    df = spark.createDataFrame(list(enumerate(texts)), TEXT)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, keep_first=False).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 200, False)


def test_repeated_rows_and_empty_table(spark):
    long = corpus()[0] * 3
    df = spark.createDataFrame([(1, long), (1, long), (None, "u" * 150 + long[:40]), (None, None)], TEXT)
    out = suffix_dedup.remove_repeats(df, keep_first=False).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in out) == sorted(
        [(len(long.encode()),) * 2] * 2 + [(150 + len(long[:40].encode()), 0), (0, 0)])
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_stretches_don_t_depend_on_segments(monkeypatch):
    buf, begin, sizes = suffix_dedup._laid_out([t.encode() for t in corpus() if t is not None], 200)

    def all_of():
        parts = list(suffix_dedup.stretches(buf, begin, sizes, 200))
        return sorted(zip(*(np.concatenate(x).tolist() for x in zip(*parts, strict=True)), strict=True))

    whole = all_of()
    for size in (700, 1024, 5000):
        monkeypatch.setattr(suffix_dedup, "SEGMENT", size)
        assert all_of() == whole


def test_equal_classes_are_suffix_ranks():
    raw = b"abracadabra" * 30
    rank = suffix_dedup.equal_classes(np.frombuffer(raw + bytes(64), np.uint8), 64)
    words = [(raw + bytes(64))[i:i + 64] for i in range(len(raw))]
    assert [sorted(set(words)).index(w) for w in words] == np.unique(rank, return_inverse=True)[1].tolist()


# --- fingerprints ---------------------------------------------------------------

def test_levels_are_entropies():
    rng = np.random.default_rng(4)
    buf = rng.integers(0, 7, 400).astype(np.uint8)
    got = fingerprint.levels(buf, 3, 300)
    w = fingerprint.WINDOW
    for i, level in zip(range(3, 300), got, strict=True):
        p = np.bincount(buf[i:i + w]) / w
        assert abs(-(p[p > 0] * np.log2(p[p > 0])).sum() / math.log2(w) * fingerprint.LEVELS - level) <= 1


def test_segments_make_no_difference(monkeypatch):
    texts = [t.encode() for t in corpus() if t is not None]
    rank = np.random.default_rng(1).permutation(fingerprint.LEVELS + 1)
    whole = [d.tobytes() for d in fingerprint.Texts(texts).digests(rank)]
    counts = fingerprint.Texts(texts).counts()
    assert counts.sum() == sum(max(1, len(t) - fingerprint.WINDOW + 1) for t in texts if t)
    monkeypatch.setattr(fingerprint, "SEGMENT", 333)
    assert [d.tobytes() for d in fingerprint.Texts(texts).digests(rank)] == whole
    assert (fingerprint.Texts(texts).counts() == counts).all()
    # a text's digest doesn't depend on its neighbours
    assert [fingerprint.Texts([t]).digests(rank)[0].tobytes() for t in texts] == whole


def test_selected_features_by_brute_force():
    rng = np.random.default_rng(8)
    rank = rng.permutation(fingerprint.LEVELS + 1)
    text = bytes(rng.integers(97, 110, 600).astype(np.uint8))
    t = fingerprint.Texts([text])
    n = len(text) - fingerprint.WINDOW + 1
    r = rank[fingerprint.levels(t.buf, 0, n)]
    points = np.zeros(n, int)
    for s in range(n):
        part = r[s:s + fingerprint.RUN]
        points[s + int(np.argmin(part))] += 1
    assert t.selected(rank)[1].tolist() == np.flatnonzero(points >= fingerprint.POINTS).tolist()


def test_neighbours_and_likeness(spark):
    texts = corpus()
    ids = [None, *range(-5, 3 * len(texts) - 8, 3)][:len(texts)]
    df = spark.createDataFrame([(i, t, 5) for i, t in zip(ids, texts, strict=True)], TEXT + ", _part int")
    got = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    assert len(got) == len(texts)
    plain = [t or "" for t in texts]
    for k, i in enumerate(ids):
        after = plain[(k + 1) % len(plain)]
        n = len(plain[k]) // 2
        changed = plain[k][:len(plain[k]) - n] + after[:n]
        assert got[i].n_chars == len(plain[k])
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
        assert (got[i].fingerprint == "") == (plain[k] == "")
    by_text = collections.defaultdict(set)
    for k, i in enumerate(ids):
        by_text[plain[k]].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    near = [got[i].near_edited for k, i in enumerate(ids) if len(plain[k]) > 600 and len(set(plain[k])) > 5]
    far = [got[i].near_next for k, i in enumerate(ids) if 5 < k < 25]
    assert np.mean(near) > 0.35 > 0.2 > np.mean(far)


def test_fingerprints_of_odd_tables(spark):
    one = fingerprint.fingerprints(spark.createDataFrame([(7, "only text of its table, longer than a window")], TEXT)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    same = fingerprint.fingerprints(spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None), (None, "")], TEXT)).collect()
    assert len(same) == 4 and {r.n_chars for r in same} == {0, 3}
    assert fingerprint.fingerprints(spark.createDataFrame([], TEXT)).count() == 0


def test_likeness_bounds():
    full = np.packbits(np.ones((1, fingerprint.BITS), bool), axis=1)
    none = np.zeros((0, fingerprint.BITS // 8), np.uint8)
    assert fingerprint.likeness(full, full) == 1.0 and fingerprint.likeness(none, none) == 1.0 and fingerprint.likeness(full, none) == 0.0
