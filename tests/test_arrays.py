"""Array functions against their definitions, stated over plain lists and run on
random ragged data."""
import random

import pytest
from pyspark.sql import functions as F

from ranklab.functions import arrays as A


def ragged(seed, rows, depth=1):
    rng = random.Random(seed)
    flat = lambda: [rng.randrange(-9, 10) for _ in range(rng.randrange(0, 7))]
    return [flat() if depth == 1 else [flat() for _ in range(rng.randrange(0, 5))] for _ in range(rows)]


def column(spark, data, kind, expr):
    df = spark.createDataFrame(list(enumerate(data)), f"i int, a {kind}")
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("n", [0, 3, 9])
def test_padding_to_a_length(spark, n):
    data = ragged(1, 40)
    assert column(spark, data, "array<int>", A.pad_to(F.col("a"), n, -7)) == [(x + [-7] * n)[:n] for x in data]


def test_padding_to_the_longest(spark):
    data = ragged(2, 30)
    df = spark.createDataFrame(list(enumerate(data)), "i int, a array<int>")
    width = max(map(len, data))
    for limit in (None, 2):
        n = min(width, limit) if limit else width
        got = [r.a for r in A.pad_arrays(df, "a", 5, max_len=limit).orderBy("i").collect()]
        assert got == [(x + [5] * n)[:n] for x in data]


def test_padding_lists_of_lists(spark):
    data = ragged(3, 25, depth=2)
    df = spark.createDataFrame(list(enumerate(data)), "i int, a array<array<int>>")
    outer, inner = max(map(len, data)), max(len(y) for x in data for y in x)
    got = [r.a for r in A.pad_arrays(df, "a", -1, depth=2).orderBy("i").collect()]
    assert got == [[y + [-1] * (inner - len(y)) for y in x] + [[-1] * inner] * (outer - len(x)) for x in data]


def test_repeating_the_last_element(spark):
    data = ragged(4, 30)
    assert column(spark, data, "array<int>", A.pad_repeat_last(F.col("a"), 5)) == [x + x[-1:] * (5 - len(x)) for x in data]


@pytest.mark.parametrize("shift", [-8, -1, 0, 2, 7])
def test_rolling(spark, shift):
    data = ragged(5, 30)
    want = [[x[(k - shift) % len(x)] for k in range(len(x))] for x in data]
    assert column(spark, data, "array<int>", A.roll(F.col("a"), shift)) == want


def test_masks_from_lengths(spark):
    df = spark.createDataFrame([(n,) for n in range(6)], "n int")
    got = df.orderBy("n").select(A.len_to_mask(F.col("n"), 4).alias("m")).collect()
    assert [sum(r.m) for r in got] == [0, 1, 2, 3, 4, 4]
    assert all(r.m == sorted(r.m, reverse=True) for r in got)


@pytest.mark.parametrize("nested", [False, True])
def test_aligning_by_masks(spark, nested):
    rng = random.Random(6)
    values = [[[k, rng.randrange(50)] if nested else rng.randrange(50) for k in range(5)] for _ in range(20)]
    masks = [[rng.randrange(2) for _ in range(5)] for _ in values]
    masks[3] = [0] * 5
    kind = "array<array<int>>" if nested else "array<int>"
    df = spark.createDataFrame([(i, v, m) for i, (v, m) in enumerate(zip(values, masks, strict=True))], f"i int, v {kind}, m array<int>")
    # a stable sort by "masked out" is the alignment
    whole = [[v for _, _, v in sorted((1 - m[k], k, x[k]) for k in range(5))] for x, m in zip(values, masks, strict=True)]
    assert [r.v for r in A.masked_align_df(df, "v", "m", keep_shape=True).orderBy("i").collect()] == whole
    width = max(map(sum, masks))
    assert [r.v for r in A.masked_align_df(df, "v", "m").orderBy("i").collect()] == [x[:width] for x in whole]


def test_codes_round_trip(spark):
    words = ["", "q", "mixed Case 42", "~tilde~"]
    df = spark.createDataFrame([(w,) for w in words], "s string").withColumn("c", A.ascii_codes(F.col("s"), 16))
    for r in df.select("s", "c", A.ascii_from_codes(F.col("c")).alias("back")).collect():
        assert r.back == r.s and r.c == [ord(x) for x in r.s] + [0] * (16 - len(r.s))
