"""Registered generic grouped queries.

Generic tables here are ``lineitem`` grouped by order (``ord`` = line
number) and ``conversations`` grouped by conversation (``ord`` = turn).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups as G
from . import views as V
from .catalog import register


def _lines(spark, sf_dir):
    """Lines of an order; input order = (line number, part, supplier), a
    total order (line numbers alone repeat within an order)."""
    return V.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
        F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("val"), F.col("l_returnflag").alias("flag"))


@register("group_head_tail", """
SELECT 'head' AS part, key, ln, val FROM (SELECT l_orderkey AS key, l_linenumber AS ln, l_partkey AS val,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) t WHERE n <= 2
UNION ALL
SELECT 'tail' AS part, key, ln, val FROM (SELECT l_orderkey AS key, l_linenumber AS ln, l_partkey AS val,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS n FROM lineitem) t WHERE n <= 2
""")
def group_head_tail(spark, sf_dir):
    """G1 + G2: first and last two lines of every order."""
    li = _lines(spark, sf_dir).drop("flag")
    return G.group_head(li, "key", 2).withColumn("part", F.lit("head")).unionByName(
        G.group_tail(li, "key", 2).withColumn("part", F.lit("tail"))).select("part", "key", "ln", "val")


@register("group_nth", """
WITH t AS (SELECT l_orderkey AS key, l_linenumber AS ln, l_partkey AS val,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n,
                  count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem)
SELECT key, ln, val FROM t WHERE n = least(3, c)
""")
def group_nth(spark, sf_dir):
    """0-based 2nd line of each order, the last line when shorter."""
    return G.group_nth(_lines(spark, sf_dir).drop("flag"), "key", 2).select("key", "ln", "val")


@register("group_count", """
SELECT l_returnflag AS flag, count(*) AS count FROM lineitem GROUP BY l_returnflag
""")
def group_count(spark, sf_dir):
    """G4."""
    return G.group_count(_lines(spark, sf_dir), "flag")


@register("group_sample", """
WITH t AS (SELECT l_orderkey AS key, l_linenumber AS ln, l_partkey AS val, l_suppkey AS s FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(concat_ws('|', key, ln, val, s, 3)), ln, val, s) AS h,
             row_number() OVER (PARTITION BY key ORDER BY ln, val, s) AS i FROM t),
c AS (SELECT key, count(*) AS c FROM t GROUP BY key),
d AS (SELECT key, CAST('0x' || substr(md5(concat_ws('|', key, g.d, 3)), 1, 8) AS BIGINT) % c + 1 AS i
      FROM c, generate_series(1, 3) AS g(d))
SELECT 'without' AS mode, key, ln, val FROM r WHERE h <= 2
UNION ALL SELECT 'with' AS mode, r.key, ln, val FROM r JOIN d ON d.key = r.key AND d.i = r.i
UNION ALL SELECT 'needed' AS mode, r.key, ln, val FROM r JOIN c USING (key) WHERE c >= 3 AND h <= 3
UNION ALL SELECT 'needed' AS mode, r.key, ln, val FROM r JOIN d ON d.key = r.key AND d.i = r.i JOIN c ON c.key = r.key WHERE c < 3
""")
def group_sample(spark, sf_dir):
    """2 lines per order without replacement, 3 draws with replacement, and 3
    with replacement only where an order has fewer lines (seeded md5 order)."""
    li = _lines(spark, sf_dir)
    a = G.group_sample(li, "key", 2, seed=3).withColumn("mode", F.lit("without"))
    b = G.group_sample(li, "key", 3, replace=True, seed=3).drop("_draw").withColumn("mode", F.lit("with"))
    c = G.group_sample(li, "key", 3, replace=None, seed=3).withColumn("mode", F.lit("needed"))
    return a.unionByName(b).unionByName(c).select("mode", "key", "ln", "val")


@register("group_collapse_long", """
WITH t AS (SELECT l_suppkey AS key, l_partkey AS val, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS pos FROM lineitem)
SELECT key, pos // 50 AS part, string_agg(val, ' ' ORDER BY pos) AS val, count(*) AS n FROM t GROUP BY key, pos // 50
""")
def group_collapse_long(spark, sf_dir):
    """G7 + G11 in bounded parts: a supplier's parts in order, 50 to a row."""
    li = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("val"),
                                                   F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("ord"))
    text = G.group_collapse_long(li, "key", "val", rows=50)
    rows = G.group_rows_long(li, ["key"], ["val"], rows=50)
    return text.join(rows, ["key", "part"]).select("key", "part", "val", F.size("rows").cast("long").alias("n"))


@register("group_pad_rows", """
WITH t AS (SELECT l_orderkey AS key, l_linenumber AS ln, l_partkey AS val,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos,
                  count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem)
SELECT key, ln, val, pos FROM t WHERE pos <= 5
UNION ALL
SELECT key, ln, val, p.pos FROM t, generate_series(CAST(c + 1 AS INTEGER), 5) AS p(pos) WHERE t.pos = c AND c < 5
""")
def group_pad_rows(spark, sf_dir):
    """Every order padded (repeating its last line) or cut to 5 lines."""
    out = G.group_pad_rows(_lines(spark, sf_dir).drop("flag"), "key", 5)
    return out.select("key", "ln", "val", "pos")


@register("group_collapse", """
SELECT conv_id AS key, string_agg(role, ' ' ORDER BY turn) AS role FROM conversations GROUP BY conv_id
""")
def group_collapse(spark, sf_dir):
    """The roles of each conversation joined in turn order."""
    conv = V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("ord"), "role")
    return G.group_collapse(conv, "key", "role", " ")


@register("group_unique", """
SELECT key, flag, ln, val FROM (SELECT l_orderkey AS key, l_returnflag AS flag, l_linenumber AS ln, l_partkey AS val,
       row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) t WHERE n = 1
""")
def group_unique(spark, sf_dir):
    """First line of each distinct return flag within every order."""
    return G.group_unique(_lines(spark, sf_dir), "key", "flag").select("key", "flag", "ln", "val")


@register("dedup_run", """
WITH r AS (SELECT qid, vid, did, score, row_number() OVER (PARTITION BY qid ORDER BY vid, score DESC, did) AS rank FROM variants),
     f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, did ORDER BY rank) AS n FROM r) t WHERE n = 1)
SELECT qid, did, vid, score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM f
""", ("variants",))
def dedup_run(spark, sf_dir):
    """The variant lists of a query concatenated (vid order), repeated
    documents dropped keeping the first, ranks renumbered."""
    from ..operators.rank import rank_rows
    v = V.variants(spark, sf_dir)
    # concatenated lists numbered per query with the skew-aware ranker
    ranked = rank_rows(v, ["qid"], [F.col("vid"), F.col("score").desc(), F.col("did")], "rank")
    out = G.dedup_run(ranked.select("qid", "did", "vid", "score", "rank").withColumnRenamed("vid", "v"), "rank")
    return out.select("qid", "did", F.col("v").alias("vid"), "score", "rank")


@register("sample_keys_values", """
WITH k AS (SELECT l_orderkey AS key, min((l_linenumber, l_partkey, l_suppkey)) AS f FROM lineitem GROUP BY 1),
     chosen AS (SELECT key FROM k ORDER BY f, key LIMIT 100),
     v AS (SELECT l_orderkey AS key, l_linenumber AS ln, l_partkey AS val,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n
           FROM lineitem WHERE l_orderkey IN (SELECT key FROM chosen))
SELECT key, ln, val FROM v WHERE n <= 2
""")
def sample_keys_values(spark, sf_dir):
    """Front mode: first 100 keys by first-seen order, first 2 values each."""
    out = G.sample_keys_values(_lines(spark, sf_dir).drop("flag"), "key", "front", "both", 100, 2)
    return out.select("key", "ln", "val")


@register("group_rows", """
SELECT conv_id AS key, count(*) AS n_rows, min(turn) AS first_index, max(turn) AS last_index,
       string_agg(role, ',' ORDER BY turn) AS roles
FROM conversations GROUP BY conv_id
""")
def group_rows(spark, sf_dir):
    """Rows of each conversation as an ordered array (with indices),
    summarised for the check."""
    conv = V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("ord"), "role")
    g = G.group_rows(conv, ["key"], ["role"], return_index=True)
    return g.select("key", F.size("rows").cast("bigint").alias("n_rows"), F.element_at("index", 1).alias("first_index"),
                    F.element_at("index", -1).alias("last_index"),
                    F.array_join(F.transform("rows", lambda r: r["role"]), ",").alias("roles"))


@register("merge_maps", """
SELECT l_partkey AS key, arg_max(l_suppkey, l_orderkey * 100 + l_linenumber) AS value FROM lineitem GROUP BY 1
""")
def merge_maps(spark, sf_dir):
    """Lines as (part → supplier) map entries in order; last one wins."""
    li = V.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("value"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))
    return G.merge_maps(li)


@register("merge_lists", """
SELECT c_nationkey AS key, list_sort(list(c_custkey)) AS value FROM customer GROUP BY 1
""")
def merge_lists(spark, sf_dir):
    """Per nation, the concatenation of its customers' one-element lists
    (ordered by key, so the list is sorted)."""
    c = V.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.array("c_custkey").alias("value"),
                                                  F.col("c_custkey").alias("ord"))
    return G.merge_lists(c)


@register("describe_qrels", """
SELECT count(*) AS n_topics, CAST(count_if(nz) AS BIGINT) AS n_topics_with_relevant
FROM (SELECT qid, bool_or(rel <> 0) AS nz FROM qrels GROUP BY qid) t
""", ("qrels",))
def describe_qrels(spark, sf_dir):
    """G14."""
    return G.describe_qrels(V.qrels(spark, sf_dir))


@register("rel_histogram", """
SELECT rel, count(*) AS count FROM qrels GROUP BY rel
""", ("qrels",))
def rel_histogram(spark, sf_dir):
    """G15."""
    return G.rel_histogram(V.qrels(spark, sf_dir))


_TRIPLES_SQL = """triples AS (
  SELECT o_custkey AS id, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS pos, min_by(o_orderkey, (o_totalprice, o_orderkey)) AS neg
  FROM orders GROUP BY o_custkey, o_orderpriority)"""


def _triples(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", "o_orderpriority").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("pos"),
        F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("neg")) \
        .select(F.col("o_custkey").alias("id"), "pos", "neg")


@register("pairs_to_list", f"""
WITH {_TRIPLES_SQL},
p AS (SELECT DISTINCT id, pos AS doc FROM triples),
n AS (SELECT DISTINCT id, neg AS doc FROM triples)
SELECT id, doc, 1 AS label FROM p UNION ALL SELECT id, doc, 0 AS label FROM n
""")
def pairs_to_list(spark, sf_dir):
    """Triples (customer, priciest order, cheapest order per priority)
    → labelled list of distinct positives then negatives."""
    return G.pairs_to_list(_triples(spark, sf_dir)).select("id", "doc", F.col("label").cast("int").alias("label"))


@register("triples_to_pairs", f"""
WITH {_TRIPLES_SQL}
SELECT id, pos AS doc FROM triples UNION ALL SELECT id, neg AS doc FROM triples
""")
def triples_to_pairs(spark, sf_dir):
    """G18."""
    return G.triples_to_pairs(_triples(spark, sf_dir))


@register("merge_nested", """
SELECT 'nation/' || CAST(s_nationkey AS VARCHAR) || '/region' AS path, CAST(any_value(n_regionkey) AS VARCHAR) AS value
FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY s_nationkey
""")
def merge_nested(spark, sf_dir):
    """Deep merge of per-supplier nested maps given as leaves
    (nation/<k>/region → region); equal leaves merge (a conflict raises)."""
    s = V.table(spark, sf_dir, "supplier").join(V.table(spark, sf_dir, "nation"),
                                                F.col("n_nationkey") == F.col("s_nationkey"))
    leaves = s.select(F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string"), F.lit("/region")).alias("path"),
                      F.col("n_regionkey").cast("string").alias("value"))
    return G.merge_nested(leaves)
