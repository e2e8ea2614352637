"""Exact quantiles by histogram refinement: no task ever holds a group.

A quantile is the value between two neighbouring ranks. Every rank starts with the
range of its group. A pass counts the values inside each open range by bins of equal
width (partial sums per task) and keeps, per bin, the least and greatest value; the
bin that holds the rank becomes the new range. Every other pass has bins of equal
width in magnitude, so that values of very unlike sizes part as fast as even ones. A
range is closed when its values are all equal, or few enough to be sorted as one short
array. The first and the last bin of an open range both hold a value, so every pass
narrows it.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize

BINS = 256
FEW = 4096                  # values of a range that are sorted at once


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    return functools.reduce(Column.__and__, [F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}")) for k in keys])


def quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
              bins: int = BINS, few: int = FEW) -> DataFrame:
    """(by..., q): ``q`` is the array of the quantiles at ``probs``, linear between
    neighbouring ranks. Nulls and NaN are left out; a group without any other value
    has no row. Null keys are a group."""
    by = list(by)
    keys = [f"_k{i}" for i in range(len(by) or 1)]
    names = [F.col(b).alias(k) for b, k in zip(by, keys)] or [F.lit(0).alias(keys[0])]
    v = df.select(*names, F.col(col).cast("double").alias("_v"))
    v = materialize(v.where(F.col("_v").isNotNull() & ~F.isnan("_v")), "values")
    groups = v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = F.array_distinct(F.concat(F.array(*[F.floor(a) for a in at]), F.array(*[F.ceil(a) for a in at])))
    groups = materialize(groups.where("n > 0"), "groups")
    # (keys, lo, hi, n, rank): the rank counts from lo, n values lie in [lo, hi]
    open_ = materialize(groups.select(*keys, F.explode(ranks).alias("place"), "lo", "hi", "n").withColumn("rank", F.col("place")), "ranges")
    equal, short = [], []
    while True:
        equal.append(open_.where(F.col("lo") == F.col("hi")).select(*keys, "place", F.col("lo").alias("x")))
        open_ = open_.where(F.col("lo") < F.col("hi"))
        short.append(open_.where(F.col("n") <= few))
        open_ = open_.where(F.col("n") > few)
        if open_.isEmpty():
            break
        open_ = materialize(_narrowed(v, open_, keys, bins, len(equal) % 2 == 0), "ranges")
    few_ = functools.reduce(DataFrame.unionByName, short)
    done = materialize(functools.reduce(DataFrame.unionByName, [*equal, _sorted_few(v, few_, keys)]), "ranks")
    value = F.map_from_entries(F.collect_list(F.struct("place", "x")))      # two ranks per quantile at most
    found = done.groupBy(*keys).agg(value.alias("x"))
    g = groups.select(*[F.col(k).alias(f"_g{k}") for k in keys], "n")
    found = found.join(g, _same(keys, "", "_g"))
    out = []
    for a in at:
        low, high, part = F.col("x")[F.floor(a)], F.col("x")[F.ceil(a)], a - F.floor(a)
        out.append(F.when(low == high, low).otherwise(low * (1 - part) + high * part))
    return found.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], F.array(*out).alias("q"))


def _inside(v: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The values that lie in a range, with it. Ranges are two per group and quantile
    at most; they are sent to all tasks only if small."""
    r = ranges.select(*[F.col(k).alias(f"_r{k}") for k in keys], "lo", "hi").distinct()
    between = (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))
    return v.join(broadcast_if_small(r), _same(keys, "", "_r") & between).select(*keys, "lo", "hi", "_v")


def _sorted_few(v: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    held = _inside(v, ranges, keys).groupBy(*keys, "lo", "hi").agg(F.array_sort(F.collect_list("_v")).alias("_all"))
    held = held.select(*[F.col(k).alias(f"_h{k}") for k in keys], F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "_all")
    j = ranges.join(held, _same(keys, "", "_h") & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")))
    return j.select(*keys, "place", F.get("_all", F.col("rank").cast("int")).alias("x"))


def _magnitude(c: Column) -> Column:
    """Grows with the value as its logarithm does, over all doubles (ln of the least one is -745)."""
    return F.when(c == 0, 0.0).otherwise(F.signum(c) * (F.log(F.abs(c)) + 746))


def _narrowed(v: DataFrame, ranges: DataFrame, keys: list[str], bins: int, by_magnitude: bool) -> DataFrame:
    # Halves first, so that the widest range doesn't overflow.
    part = F.try_divide(F.col("_v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
    if by_magnitude:
        low, high = _magnitude(F.col("lo")), _magnitude(F.col("hi"))
        part = F.coalesce(F.try_divide(_magnitude(F.col("_v")) - low, high - low), part)
    part = F.coalesce(part, F.lit(0.0))
    last = F.col("_v") == F.col("hi")
    b = F.when(last, bins - 1).when(F.col("_v") == F.col("lo"), 0).otherwise(F.least(F.floor(part * bins), F.lit(bins - 1)))
    h = _inside(v, ranges, keys).groupBy(*keys, "lo", "hi", b.alias("bin")).agg(
        F.count("*").alias("c"), F.min("_v").alias("from"), F.max("_v").alias("to"))
    row = F.array_sort(F.collect_list(F.struct("bin", "c", "from", "to")))          # one per bin
    h = h.groupBy(*keys, "lo", "hi").agg(row.alias("h")).select(*[F.col(k).alias(f"_h{k}") for k in keys], F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "h")
    j = ranges.join(h, _same(keys, "", "_h") & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")))
    # Walk the bins up to the one that holds the rank.
    start = F.struct(F.col("rank").alias("rank"), F.lit(None).cast("struct<bin:bigint,c:bigint,from:double,to:double>").alias("bin"))
    found = F.aggregate("h", start, lambda s, x: F.when(s["bin"].isNotNull(), s).when(
        s["rank"] < x["c"], F.struct(s["rank"].alias("rank"), F.struct(x["bin"].cast("long").alias("bin"), x["c"].alias("c"), x["from"].alias("from"), x["to"].alias("to")).alias("bin")))
        .otherwise(F.struct((s["rank"] - x["c"]).alias("rank"), s["bin"].alias("bin"))))
    j = j.select(*keys, "place", found.alias("f"))
    return j.select(*keys, "place", F.col("f.bin.from").alias("lo"), F.col("f.bin.to").alias("hi"), F.col("f.bin.c").alias("n"), F.col("f.rank").alias("rank"))
