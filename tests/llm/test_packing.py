"""Best-fit packing: pieces, certificates, rounds."""
import itertools
import math
import zlib

import numpy as np
import pytest

from ranklab.llm import packing

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
ODD = ["", " a", "a  b", "A\n b", "ÀÉß's", "x<|endoftext|>y", "<|startoftext|>", "don't WE'll  ok", "日本 語 a", "a\u0085 b", "\n\n a\n", "1234 5 a1b2 $$$ ok,",
       "é e\u0301 \u0301x İI Σς", "a" * 5000, "Hello, world!?. end.;", "word " * 9000, None]


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def check(out, texts, tok, copies=1):
    """Every id of every document is in one place, places are gapless."""
    want = {}
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p in range(math.ceil(len(ids) / 4096)):
            part = ids[p * 4096:(p + 1) * 4096]
            want.setdefault((i, p, p * 4096, len(part), zlib.crc32(part.tobytes())), 0)
            want[(i, p, p * 4096, len(part), zlib.crc32(part.tobytes()))] += copies
    got = {}
    for r in out:
        k = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[k] = got.get(k, 0) + 1
    assert got == want
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= 4096
    return len(by)


def test_pieces_and_places(spark, tok):
    texts = [(i if i else None, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, piece int, length int")
    n = check(packing.pack_documents(df.unionAll(df)).collect(), texts, tok, 2)
    total = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts) * 2
    assert n <= math.ceil(total / 4096) + 1
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_rounds_close_the_gaps(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 3000, 3000)
    items = spark.createDataFrame([(i, 0, 0, int(s), i) for i, s in enumerate(sizes)],
                                  "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(items, per_partition=300).toPandas()
    assert len(out) == 3000 and sorted(out.doc_id) == list(range(3000))
    assert out.groupby("sequence_id").length.sum().max() <= 4096
    # ten partitions alone would leave up to ten bins open
    assert out.sequence_id.nunique() <= math.ceil(packing.lower_bound(sizes, 4096)) + 3


def test_lower_bound_never_exceeds_the_optimum():
    rng = np.random.default_rng(2)
    for _ in range(150):
        sizes = rng.integers(1, 21, rng.integers(1, 7))
        best = len(sizes)
        for bins in itertools.product(range(len(sizes)), repeat=len(sizes)):
            if max(np.bincount(bins, sizes, len(sizes))) <= 20:
                best = min(best, len(set(bins)))
        assert math.ceil(packing.lower_bound(sizes, 20) - 1e-9) <= best
        assert packing.best_fit_decreasing(sizes, 20)[1].max() <= 20
        assert len(packing.best_fit_decreasing(sizes, 20)[1]) >= best


def test_dual_feasible_bound_beats_the_sum():
    assert packing.lower_bound(np.array([11, 11, 11, 11]), 20) == 4
    assert packing.lower_bound(np.array([7] * 6), 20) == 3.0
    assert packing.lower_bound(np.zeros(0, np.int64), 20) == 0


def test_rounds_end_when_no_bin_is_freed(spark):
    from pyspark.sql import functions as F
    # two of these sizes fit a sequence, never three: no round can free a bin
    items = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        (1500 + 200 * (F.col("id") % 3)).alias("length"), F.crc32(F.col("id").cast("string").cast("binary")).alias("ids_crc32"))
    out = packing.pack(items, per_partition=300).toPandas()
    assert sorted(out.doc_id) == list(range(6000))
    used = out.groupby("sequence_id").length.sum()
    assert used.max() <= packing.CAPACITY and 3000 <= len(used) <= 3000 + 20
    first = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (first.offset.first() == 0).all()
