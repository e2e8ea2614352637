"""Generic grouped operators.

Order-sensitive operators take an ``ord`` column (input order). Hot groups
are handled by construction: head/tail/nth/unique use ``row_number() <= n``
(partial WindowGroupLimit before the shuffle); counts and term statistics
are partial aggregations; sampling numbers rows with the skew-aware ranker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rank import rank_rows, top_k


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def group_head(df: DataFrame, key, n: int, order: str = "ord") -> DataFrame:
    """G1: first n rows per key in order."""
    return top_k(df, _keys(key), [F.col(order)], n, "_n").drop("_n")


def group_tail(df: DataFrame, key, n: int, order: str = "ord") -> DataFrame:
    """Last n rows per key (kept in original order by ``order``)."""
    return top_k(df, _keys(key), [F.col(order).desc()], n, "_n").drop("_n")


def group_nth(df: DataFrame, key, n: int, order: str = "ord", fallback_last: bool = True) -> DataFrame:
    """The 0-based n-th row per key. ``fallback_last`` (streaming tool):
    a shorter group yields its last row; else short groups are dropped."""
    keys = _keys(key)
    first = top_k(df, keys, [F.col(order)], n + 1, "_n")
    if not fallback_last:
        return first.where(F.col("_n") == n + 1).drop("_n")
    w = Window.partitionBy(*keys)
    return first.withColumn("_m", F.max("_n").over(w)).where(F.col("_n") == F.col("_m")).drop("_n", "_m")


def group_count(df: DataFrame, key, per_column: bool = False) -> DataFrame:
    """Rows per key; ``per_column`` counts non-null values per column."""
    keys = _keys(key)
    if not per_column:
        return df.groupBy(*keys).agg(F.count("*").alias("count"))
    return df.groupBy(*keys).agg(*[F.count(c).alias(c) for c in df.columns if c not in keys])


def drawn(df: DataFrame, cols, seed: int) -> Column:
    """A pseudo-random order that SQL engines share: md5 of the values (of all
    fields of a struct) and the seed, joined by '|'."""
    parts = []
    for c in cols:
        kind = df.schema[c].dataType
        parts += [F.col(f"{c}.{f}") for f in kind.names] if isinstance(kind, T.StructType) else [F.col(c)]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))).cast("binary"))


def group_sample(df: DataFrame, key, n: float, replace: bool | None = False, seed: int = 0,
                 order: str = "ord", rounded: bool = False) -> DataFrame:
    """Sample per key. n < 1 is a ratio of the group (truncated, or
    ``rounded``), else a number. Without replacement: first rows of a seeded
    hash order (capped at the group size). With replacement: n draws of a
    hashed row index. ``replace=None``: with replacement only where the group has
    fewer rows than are wanted."""
    keys = _keys(key)
    if replace is None:
        enough = df.groupBy(*keys).agg(F.count("*").alias("_cnt")).where(F.col("_cnt") >= int(n)).select(*keys)
        once = group_sample(df.join(enough, keys, "left_semi"), key, n, False, seed, order, rounded)
        if n < 1:
            return group_sample(df, key, n, False, seed, order, rounded)
        return once.unionByName(group_sample(df.join(enough, keys, "left_anti"), key, n, True, seed, order, rounded).drop("_draw"))
    h = drawn(df, [*keys, order], seed)
    cnt = df.groupBy(*keys).agg(F.count("*").alias("_cnt"))
    want = (F.bround(F.col("_cnt") * n) if rounded else F.floor(F.col("_cnt") * n)) if n < 1 else F.lit(round(n) if rounded else int(n))
    if not replace:
        if n >= 1:
            return top_k(df, keys, [h, F.col(order)], round(n) if rounded else int(n), "_r").drop("_r")
        ranked = rank_rows(df, keys, [h, F.col(order)], "_r")
        return ranked.join(cnt, keys).where(F.col("_r") <= want).drop("_r", "_cnt")
    numbered = rank_rows(df, keys, [F.col(order)], "_i")
    draws = cnt.select(*keys, "_cnt", F.explode(F.sequence(F.lit(1), want.cast("int"))).alias("_draw")) \
        .where(F.col("_cnt") > 0)
    number = F.conv(F.substring(drawn(draws, [*keys, "_draw"], seed), 1, 8), 16, 10).cast("long")
    draws = draws.select(*keys, "_draw", (F.pmod(number, F.col("_cnt")) + 1).alias("_i"))
    return numbered.join(draws, [*keys, "_i"]).drop("_i")


def group_pad_rows(df: DataFrame, key, n: int, order: str = "ord", truncate: bool = True) -> DataFrame:
    """Repeat the last row of a group until it has n rows (``truncate``:
    also cut longer groups to n, the streaming tool's behaviour). Adds
    ``pos`` (1-based position)."""
    keys = _keys(key)
    cnt = df.groupBy(*keys).agg(F.count("*").alias("_cnt"))
    if truncate:
        ranked = top_k(df, keys, [F.col(order)], n, "pos")
    else:
        ranked = rank_rows(df, keys, [F.col(order)], "pos")
    ranked = ranked.join(cnt, keys)
    last = ranked.where((F.col("pos") == F.col("_cnt")) & (F.col("_cnt") < n))
    extra = last.withColumn("pos", F.explode(F.sequence(F.col("_cnt") + 1, F.lit(n))))
    return ranked.unionByName(extra).drop("_cnt")


def group_collapse(df: DataFrame, key, col: str, sep: str = " ", order: str = "ord") -> DataFrame:
    """Values of ``col`` per key joined by ``sep`` in input order. The
    output is one string per key by definition."""
    keys = _keys(key)
    agg = F.collect_list(F.struct(F.col(order).alias("o"), F.col(col).cast("string").alias("v")))
    return df.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(agg), lambda s: s["v"]), sep).alias(col))


PART_ROWS = 100_000          # rows of a group that one output row holds in the long forms


def in_parts(df: DataFrame, key, order: str = "ord", rows: int = PART_ROWS) -> DataFrame:
    """``df`` with ``part``: the group's rows in order, ``rows`` to a part. Hot groups are
    numbered by ranges, see :func:`rank_rows`, and their parts are rows of their own."""
    return rank_rows(df, _keys(key), [F.col(order)], "_pos").withColumn("part", F.floor((F.col("_pos") - 1) / F.lit(rows))).drop("_pos")


def group_collapse_long(df: DataFrame, key, col: str, sep: str = " ", order: str = "ord", rows: int = PART_ROWS) -> DataFrame:
    """G7 for groups of any length: (key, part, ``col``), the parts in order make the
    string of :func:`group_collapse` when joined by ``sep``. A null value is empty."""
    keys = _keys(key)
    whole = df.withColumn(col, F.coalesce(F.col(col).cast("string"), F.lit("")))
    return group_collapse(in_parts(whole, keys, order, rows), [*keys, "part"], col, sep, order)


def group_rows_long(df: DataFrame, by: Sequence[str], cols: Sequence[str] | None = None,
                    return_index: bool = False, order: str = "ord", rows: int = PART_ROWS) -> DataFrame:
    """G11 for groups of any length: (by..., part, rows)."""
    cols = list(cols or [c for c in df.columns if c not in by and c != order])
    return group_rows(in_parts(df, list(by), order, rows), [*by, "part"], cols, return_index, order)


def group_unique(df: DataFrame, key, field: str | None = None, order: str = "ord") -> DataFrame:
    """First row per distinct value of ``field`` inside each group (whole
    row when no field given)."""
    keys = _keys(key)
    part = keys + ([field] if field else [c for c in df.columns if c not in keys and c != order])
    return top_k(df, part, [F.col(order)], 1, "_n").drop("_n")


def dedup_run(run: DataFrame, order: str = "rank") -> DataFrame:
    """Drop repeated (list, did) keeping the first, renumber ranks."""
    keys = [c for c in ("system", "qid", "vid") if c in run.columns]
    first = top_k(run, keys + ["did"], [F.col(order)], 1, "_n").drop("_n")
    return rank_rows(first.withColumnRenamed(order, "_o"), keys, [F.col("_o")], "rank").drop("_o")


def sample_keys_values(df: DataFrame, key: str, mode: str = "front", selection: str = "both",
                       nk: int | None = None, nv: int | None = None, seed: int = 0,
                       order: str = "ord") -> DataFrame:
    """Pick keys (front/back/random by first-seen order), then values per
    key (first/last/random nv), or either one; n capped at what exists."""
    keys_first = df.groupBy(key).agg(F.min(order).alias("_first"))
    kord = {"front": F.col("_first"), "back": F.col("_first").desc(),
            "random": F.xxhash64(F.col(key), F.lit(seed))}[mode]
    out = df
    if selection in ("keys", "both") and nk is not None:
        # the chosen keys: nk rows of a small per-key table
        chosen = keys_first.orderBy(kord, F.col(key)).limit(nk).select(key)
        out = out.join(chosen, key, "left_semi")
    if selection in ("values", "both") and nv is not None:
        vord = {"front": F.col(order), "back": F.col(order).desc(),
                "random": F.xxhash64(F.col(key), F.col(order), F.lit(seed))}[mode]
        out = top_k(out, [key], [vord, F.col(order)], nv, "_v").drop("_v")
    return out


def group_rows(df: DataFrame, by: Sequence[str], cols: Sequence[str] | None = None,
               return_index: bool = False, order: str = "ord") -> DataFrame:
    """Rows grouped by ``by`` as an ordered array of structs (plus the
    original row indices). One row per group by definition."""
    cols = list(cols or [c for c in df.columns if c not in by and c != order])
    item = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in cols])
    agg = F.array_sort(F.collect_list(item))
    out = df.groupBy(*by).agg(agg.alias("_rows"))
    sel = [*by, F.transform("_rows", lambda s: F.struct(*[s[c].alias(c) for c in cols])).alias("rows")]
    if return_index:
        sel.append(F.transform("_rows", lambda s: s["_o"]).alias("index"))
    return out.select(*sel)


def merge_maps(maps: DataFrame, order: str = "ord") -> DataFrame:
    """Union of (key, value) maps; the last value wins."""
    return maps.groupBy("key").agg(F.max_by("value", order).alias("value"))


def merge_lists(lists: DataFrame, order: str = "ord") -> DataFrame:
    """Per key, the concatenation of all list values in input order."""
    return lists.groupBy("key").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("value").alias("v")))),
                              lambda s: s["v"])).alias("value"))


def merge_nested(leaves: DataFrame) -> DataFrame:
    """Deep merge of nested maps given as (path, value) leaves; equal
    leaves merge; conflicting leaves, or a leaf where another path has a
    subtree, raise an error."""
    parts = F.split("path", "/")
    above = (leaves.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                                                 lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path"), F.size(parts).alias("_d"))
             .where("_d > 1").select("path").distinct().withColumn("_inner", F.lit(1)))
    leaves = leaves.join(above, "path", "left")
    per = leaves.groupBy("path").agg(F.count_distinct("value").alias("_n"), F.first("value").alias("value"),
                                     F.max("_inner").alias("_inner"))
    return per.select("path", F.when((F.col("_n") > 1) | F.col("_inner").isNotNull(), F.raise_error(F.concat(F.lit("conflict at "), F.col("path"))))
                      .otherwise(F.col("value")).alias("value"))


def describe_qrels(qrels: DataFrame) -> DataFrame:
    """Number of topics and of topics with at least one nonzero grade."""
    per = qrels.groupBy("qid").agg(F.bool_or(F.col("rel") != 0).alias("_nz"))
    return per.agg(F.count("*").alias("n_topics"), F.count_if("_nz").alias("n_topics_with_relevant"))


def describe_run(run: DataFrame) -> DataFrame:
    """Number of queries and of variants per run."""
    return run.agg(F.count_distinct("qid").alias("n_queries"), F.count_distinct("vid").alias("n_variants"))


def rel_histogram(qrels: DataFrame, by_session: bool = False) -> DataFrame:
    """Rows per grade (optionally per session id)."""
    from .select import session_id
    keys = [session_id(F.col("qid")).alias("session")] if by_session else []
    return qrels.groupBy(*keys, "rel").agg(F.count("*").alias("count"))


def term_stats(docs: DataFrame, tokens: str = "tokens", did: str = "did") -> DataFrame:
    """Corpus term frequency and document frequency per term. Two
    partial aggregations (per (term, doc) then per term), no distinct-count
    state per term."""
    # explode_outer + filter: keeps the tokenizer above any repartition
    per_doc = docs.select(did, F.explode_outer(tokens).alias("term")).where(F.col("term").isNotNull()) \
        .groupBy("term", did).agg(F.count("*").alias("_tf"))
    return per_doc.groupBy("term").agg(F.sum("_tf").alias("tf"), F.count("*").alias("df"))


def pairs_to_list(triples: DataFrame, pos_label: int = 1, neg_label: int = 0,
                  sample_neg: float | None = None, seed: int = 0) -> DataFrame:
    """Distinct positives then distinct negatives per id, with labels;
    a document that is both appears with both labels. Negatives are optionally
    sampled without replacement (ratio, rounded half to even, or number)."""
    pos = triples.select("id", F.col("pos").alias("doc")).distinct().withColumn("label", F.lit(pos_label))
    neg = triples.select("id", F.col("neg").alias("doc")).distinct().withColumn("label", F.lit(neg_label))
    if sample_neg is not None:
        neg = group_sample(neg.withColumn("ord", F.xxhash64("doc")), "id", sample_neg, seed=seed, rounded=True).drop("ord")
    return pos.unionByName(neg)


def triples_to_pairs(triples: DataFrame) -> DataFrame:
    """One (id, pos, neg) triple → (id, pos) and (id, neg)."""
    return triples.select("id", F.explode(F.array("pos", "neg")).alias("doc"))


def ord_column() -> Column:
    """Input order for frames read from files."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                    F.monotonically_increasing_id())
