"""Registered array-function queries (A1-A8) on per-order line arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from . import views as V
from .catalog import register

_ORDER_ARRAYS = """o AS (
  SELECT l_orderkey AS key,
         list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts,
         list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS supps,
         list(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END ORDER BY l_linenumber, l_partkey, l_suppkey) AS mask
  FROM lineitem GROUP BY l_orderkey)"""


def _orders(spark, sf_dir):
    """Per order: arrays of its lines' parts, suppliers and an R-flag mask,
    in line order (orders have a handful of lines: bounded groups)."""
    li = V.table(spark, sf_dir, "lineitem")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey",
                    F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("m"))
    g = li.groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(item)).alias("_l"))
    return g.select("key", F.transform("_l", lambda s: s["l_partkey"]).alias("parts"),
                    F.transform("_l", lambda s: s["l_suppkey"]).alias("supps"),
                    F.transform("_l", lambda s: s["m"]).alias("mask"))


@register("pad_arrays", f"""
WITH {_ORDER_ARRAYS}, m AS (SELECT max(len(parts)) AS n FROM o)
SELECT key, list_resize(parts, m.n, CAST(-1 AS BIGINT)) AS padded, list_concat(parts, list_resize([parts[-1]], greatest(7 - len(parts), 0), parts[-1])) AS repeat_last,
       list_transform(range(0, 7), lambda i: i < len(parts)) AS mask7
FROM o, m
""")
def pad_arrays(spark, sf_dir):
    """A1 + A2 + A3: pad to the longest order with -1, pad to 7 with the last
    element, length mask of width 7."""
    o = _orders(spark, sf_dir)
    p = A.pad_arrays(o.select("key", F.col("parts").alias("padded")), "padded", -1)
    return p.join(o, "key").select("key", "padded", A.pad_repeat_last(F.col("parts"), 7).alias("repeat_last"),
                                   A.len_to_mask(F.size("parts"), 7).alias("mask7"))


@register("roll_join_align", f"""
WITH {_ORDER_ARRAYS},
  r AS (SELECT key, parts, supps, mask, list_sum(mask) % len(parts) AS s FROM o)
SELECT key,
  list_concat(parts[len(parts) - s + 1:len(parts)], parts[1:len(parts) - s]) AS rolled,
  array_to_string(list_concat(parts, supps), ' ') AS joined,
  list_concat(list_filter(parts, lambda x, i: mask[i] <> 0), list_filter(parts, lambda x, i: mask[i] = 0)) AS aligned
FROM r
""")
def roll_join_align(spark, sf_dir):
    """A4 + A5 + A6: roll each order's parts by its number of returned lines,
    join parts and suppliers as text, returned lines first (keep shape)."""
    o = _orders(spark, sf_dir)
    shift = F.aggregate("mask", F.lit(0), lambda a, x: a + x)
    return o.select("key", A.roll(F.col("parts"), shift).alias("rolled"),
                    A.str_join([F.col("parts"), F.col("supps")], " ").alias("joined"),
                    A.masked_align(F.col("parts"), F.col("mask")).alias("aligned"))


@register("masked_align_strip", f"""
WITH {_ORDER_ARRAYS}, m AS (SELECT max(list_sum(mask)) AS n FROM o)
SELECT key, list_concat(list_filter(parts, lambda x, i: mask[i] <> 0), list_filter(parts, lambda x, i: mask[i] = 0))[1:m.n] AS aligned
FROM o, m
""")
def masked_align_strip(spark, sf_dir):
    """A6 without keep_shape: cut to the longest masked-in count of the batch."""
    o = _orders(spark, sf_dir)
    return A.masked_align_df(o.select("key", F.col("parts").alias("aligned"), "mask"), "aligned", "mask").drop("mask")


@register("tile_rows", """
WITH m AS (SELECT max(l_orderkey) + 1 AS n FROM lineitem)
SELECT l_orderkey + r.rep * m.n AS "row", l_linenumber AS col, l_partkey AS val
FROM lineitem, m, (SELECT range AS rep FROM range(3)) r
""")
def tile_rows(spark, sf_dir):
    """The (order, line, part) sparse matrix repeated 3 times vertically."""
    li = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"),
                                                   F.col("l_partkey").alias("val"))
    n = li.agg((F.max("row") + 1).alias("n")).first()["n"]  # one number
    return A.tile_rows(li, 3, int(n))


@register("ascii_codes", """
SELECT c_custkey, list_resize(list_transform(string_split(c_name, ''), lambda ch: ascii(ch)), 24, 0) AS codes,
       c_name AS decoded
FROM customer
""")
def ascii_codes(spark, sf_dir):
    """Customer names as zero-padded code arrays of width 24, and back."""
    c = V.table(spark, sf_dir, "customer").select("c_custkey", A.ascii_codes(F.col("c_name"), 24).alias("codes"))
    return c.select("c_custkey", "codes", A.ascii_from_codes(F.col("codes")).alias("decoded"))
