"""Array functions (A1-A8) as higher-order column expressions.

Row-wise work stays inside whole-stage codegen (``transform``, ``filter``,
``slice``, ``array_repeat``); a batch-wide length (pad to the longest,
strip to the longest) is one aggregate, joined back as a single row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pad_to(arr: Column, n: int | Column, value) -> Column:
    """A1 (1-D): pad with ``value`` (or truncate) to length n."""
    n = F.lit(n) if isinstance(n, int) else n
    fill = F.array_repeat(F.lit(value), F.greatest(n - F.size(arr), F.lit(0)).cast("int"))
    return F.slice(F.concat(arr, fill), 1, n)


def pad_to_shape(arr: Column, shape: list[int], value) -> Column:
    """A1 (n-D): pad a nested array to ``shape``, outer length first; what is
    longer is cut. Missing inner arrays are filled with ``value``."""
    if len(shape) == 1:
        return pad_to(arr, shape[0], value)
    fill = F.lit(value)
    for n in reversed(shape[1:]):
        fill = F.array_repeat(fill, n)
    rows = F.transform(arr, lambda a: pad_to_shape(a, shape[1:], value))
    more = F.array_repeat(fill, F.greatest(F.lit(shape[0]) - F.size(arr), F.lit(0)).cast("int"))
    return F.slice(F.concat(rows, more), 1, shape[0])


def pad_arrays(df: DataFrame, col: str, value=0, max_len: int | None = None, depth: int = 1) -> DataFrame:
    """A1: pad every array of ``col`` to the longest one in the frame
    (``max_len`` truncates). ``depth=2`` pads a list of lists: inner lists
    to the longest inner list, outer lists to the longest outer list (with
    rows of ``value``)."""
    if depth == 1:
        m = df.agg(F.max(F.size(col)).alias("_m"))
        j = df.crossJoin(F.broadcast(m))
        n = F.least(F.col("_m"), F.lit(max_len)) if max_len else F.col("_m")
        return j.withColumn(col, pad_to(F.col(col), n, value)).drop("_m")
    m = df.agg(F.max(F.size(col)).alias("_mo"),
               F.max(F.array_max(F.transform(col, lambda a: F.size(a)))).alias("_mi"))
    j = df.crossJoin(F.broadcast(m))
    inner = F.transform(col, lambda a: pad_to(a, F.col("_mi"), value))
    row = F.array_repeat(F.lit(value), F.col("_mi").cast("int"))
    outer = F.slice(F.concat(inner, F.array_repeat(row, F.greatest(F.col("_mo") - F.size(col), F.lit(0)).cast("int"))),
                    1, F.col("_mo"))
    return j.withColumn(col, outer).drop("_mo", "_mi")


def pad_repeat_last(arr: Column, n: int | Column) -> Column:
    """A2: pad with the last element up to length n; an empty array has none
    and stays empty."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.size(arr) == 0, arr).otherwise(F.concat(arr, F.array_repeat(F.try_element_at(arr, F.lit(-1)), F.greatest(n - F.size(arr), F.lit(0)).cast("int"))))


def len_to_mask(length: Column, n: int) -> Column:
    """A3: boolean mask of size n, true below ``length``; empty for n = 0."""
    if n <= 0:
        return F.when(length.isNotNull(), F.array().cast("array<boolean>"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < length)


def roll(arr: Column, shift: Column | int) -> Column:
    """A4: circular shift (numpy ``roll`` direction: +1 moves the last
    element to the front), per row."""
    shift = F.lit(shift) if isinstance(shift, int) else shift
    n = F.size(arr)
    s = F.when(n > 0, F.pmod(shift, n)).otherwise(0)
    return F.when(s == 0, arr).otherwise(F.concat(F.slice(arr, n - s + 1, s), F.slice(arr, 1, n - s)))


def str_join(arrays: list[Column], sep: str | Callable[[Column], Column] = " ") -> Column:
    """A5: concatenate arrays, then join their elements as strings, by a separator
    or by a function of the array of strings."""
    strings = F.transform(F.concat(*arrays), lambda x: x.cast("string"))
    return sep(strings) if callable(sep) else F.array_join(strings, sep)


def masked_align(values: Column, mask: Column) -> Column:
    """Masked-in elements first, masked-out after, order kept (works for
    arrays of arrays too)."""
    z = F.arrays_zip(values.alias("v"), mask.alias("m"))
    ins = F.transform(F.filter(z, lambda e: e["m"] != 0), lambda e: e["v"])
    outs = F.transform(F.filter(z, lambda e: e["m"] == 0), lambda e: e["v"])
    return F.concat(ins, outs)


def masked_align_df(df: DataFrame, values: str, mask: str, keep_shape: bool = False) -> DataFrame:
    """A6 over a batch: without ``keep_shape`` strip to the longest masked-in
    count of the batch."""
    out = df.withColumn(values, masked_align(F.col(values), F.col(mask)))
    if keep_shape:
        return out
    m = df.agg(F.max(F.size(F.filter(mask, lambda x: x != 0))).alias("_m"))
    return out.crossJoin(F.broadcast(m)).withColumn(values, F.slice(values, 1, F.col("_m"))).drop("_m")


def tile_rows(coo: DataFrame, reps: int, nrows: int) -> DataFrame:
    """Repeat a sparse (row, col, val) matrix ``reps`` times vertically."""
    spark = coo.sparkSession
    r = spark.range(reps).select(F.col("id").alias("_rep"))
    return coo.crossJoin(F.broadcast(r)).select((F.col("row") + F.col("_rep") * nrows).alias("row"), "col", "val")


def ascii_codes(s: Column, width: int) -> Column:
    """String → fixed-width array of ASCII codes, zero padded."""
    codes = F.transform(F.split(s, ""), lambda ch: F.ascii(ch))
    codes = F.when(F.length(s) == 0, F.array().cast("array<int>")).otherwise(codes)
    return pad_to(codes, width, 0)


def ascii_from_codes(codes: Column) -> Column:
    """Code array → string (zeros dropped)."""
    return F.array_join(F.transform(F.filter(codes, lambda c: c != 0), lambda c: F.chr(c)), "")
