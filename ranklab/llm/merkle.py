"""Merkle manifest of a dataset: leaves, roots, proofs and their verification.

A row is a leaf: the digest of its fields. Leaves of a group (``lang``) ascend by id
and form a tree of the given fanout; the groups' roots, in order of the group, form
one more tree, whose root stands for the whole dataset.

Slot pivot: on each level the nodes of one parent share (group, position div
fanout). Conditional aggregates spread them into ``fanout`` slot columns. The slots,
concatenated, hash to the parent; the slots left and right of a node's own one are
its siblings. Siblings of all levels, bottom-up, are a leaf's proof.

Levels are taken in strata: nodes are dealt by (group, block) with at most
``fanout ** levels`` = 4096 nodes or so to a block, so all aggregates of a stratum run
on one exchange and no group, however large, meets in a task; the blocks' roots are
the next stratum's nodes. Strata first climb (aggregates by parent), then proofs
descend: the nodes of a stratum join their block's proof and add their own levels.
Positions in a group come from one range sort by (group, id, leaf): the place in a
partition plus the rows of the same group in earlier ones. That table has
(partitions + groups) rows.

What the driver holds is one number, the size of the largest group. Digests of texts
are taken once, before anything is shuffled.

Defined results: a null field counts as ``-``, apart from an empty text (``0:``). Null
ids come first in a group; rows that share an id are ordered by their leaf, and rows
equal in all fields are leaves of their own. A null group is a group, before all
others. One row alone: its leaf is the root, and its proof the digest of nothing. A
very long text is hashed whole, inside its row. An empty table gives no rows.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import broadcast_if_small
from .common import shuffle_width, stored, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
BLOCK = 4096                 # nodes of a block, about
EDGE = "struct<before:string,after:string>"      # siblings left and right of a node


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary") if len(parts) > 1 else parts[0].cast("binary"), 256)


def field(c: Column) -> Column:
    """``-`` or length in bytes, colon, value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(fields: dict[str, Column]) -> Column:
    return digest(*[field(c) for c in fields.values()])


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` (with _g) plus _pos, the place among the rows of _g by ``order``, and
    _n, their number. One range sort; no group is gathered."""
    spark = rows.sparkSession
    d = rows.repartitionByRange(shuffle_width(spark), F.col("_g"), *order).sortWithinPartitions("_g", *order)
    d = stored(d.withColumn("_at", F.monotonically_increasing_id()), "numbered")     # partition << 33 | place in it
    part = F.shiftright("_at", 33)
    counts = d.groupBy("_g", part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    by = Window.partitionBy("_g").orderBy("_part")
    offsets = counts.select(F.col("_g").alias("_og"), F.col("_part").alias("_op"), "_first",
                            (F.sum("_c").over(by) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy("_g")).alias("_n"))
    out = d.join(offsets, (F.col("_g") == F.col("_og")) & (part == F.col("_op")))
    return out.withColumn("_pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_og", "_op", "_first", "_before")


def _slots(fanout: int) -> list[Column]:
    """The conditional aggregates: column i holds the child in slot i of its parent."""
    return [F.max(F.when(F.col("_pos") % fanout == i, F.col("_h"))) for i in range(fanout)]


def _joined(slots: list[Column]) -> Column:
    """Digests as text one after the other; an empty slot adds nothing."""
    return F.concat_ws("", *slots) if slots else F.lit("")


def _parent(c: Column, fanout: int) -> Column:
    return F.floor(c / F.lit(fanout)) if fanout & (fanout - 1) else F.shiftright(c, fanout.bit_length() - 1)


def climb(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(_g, _n, _pos, _h): the nodes ``levels`` levels above; a group with one node is
    done and keeps it."""
    size = fanout ** levels
    d = nodes.select("_g", "_n", "_pos", "_h", F.floor(F.col("_pos") / F.lit(size)).alias("_b"))
    d = d.repartition(F.col("_g"), F.col("_b"))          # the only exchange: all keys below refine it
    for _ in range(levels):
        slots = [c.alias(f"_s{i}") for i, c in enumerate(_slots(fanout))]
        up = d.groupBy("_g", "_b", "_n", _parent(F.col("_pos"), fanout).alias("_up")).agg(*slots)
        names = [F.col(f"_s{i}") for i in range(fanout)]
        d = up.select("_g", "_b", F.ceil(F.col("_n") / F.lit(fanout)).alias("_n"), F.col("_up").alias("_pos"),
                      F.when(F.col("_n") == 1, F.col("_s0")).otherwise(digest(_joined(names))).alias("_h"))
    return d.select("_g", "_n", "_pos", "_h")


def descend(nodes: DataFrame, above: DataFrame | None, fanout: int, levels: int) -> DataFrame:
    """``nodes`` with _path, the array of siblings on each level from the node up.
    ``above``: (_g, _pos, _path) of the blocks, None where they are roots."""
    size = fanout ** levels
    others = [c for c in nodes.columns if c != "_h"]
    d = nodes.withColumn("_b", F.floor(F.col("_pos") / F.lit(size))).withColumn("_own", F.col("_h")).withColumn("_m", F.col("_n"))
    d = d.repartition(F.col("_g"), F.col("_b"))          # the only exchange: all keys below refine it
    if above is not None:
        top = above.select(F.col("_g").alias("_tg"), F.col("_pos").alias("_tb"), F.col("_path").alias("_top"))
        d = d.join(top, (F.col("_g") == F.col("_tg")) & (F.col("_b") == F.col("_tb"))).drop("_tg", "_tb")
    else:
        d = d.withColumn("_top", F.array().cast(f"array<{EDGE}>"))
    d = d.withColumn("_at", F.col("_pos"))
    edges = []
    for level in range(levels):
        up = _parent(F.col("_at"), fanout)
        parent = Window.partitionBy("_g", "_b", "_up")
        d = d.withColumn("_up", up).withColumn("_slot", F.col("_at") % fanout)
        slots = {f"_s{i}": F.max(F.when(F.col("_slot") == i, F.col("_h"))).over(parent) for i in range(fanout)}
        d = d.withColumns(slots)
        names = [F.col(s) for s in slots]
        before = F.concat_ws("", *[F.when(F.col("_slot") > i, c) for i, c in enumerate(names)])
        after = F.concat_ws("", *[F.when(F.col("_slot") < i, c) for i, c in enumerate(names)])
        edge = F.when(F.col("_m") > 1, F.struct(before.alias("before"), after.alias("after")))
        h = F.when(F.col("_m") == 1, F.col("_h")).otherwise(digest(_joined(names)))
        d = d.withColumns({f"_e{level}": edge, "_h": h, "_m": F.ceil(F.col("_m") / F.lit(fanout)), "_at": F.col("_up")}).drop(*slots)
        edges.append(F.col(f"_e{level}"))
    path = F.concat(F.filter(F.array(*edges), lambda e: e.isNotNull()), F.col("_top"))
    return d.select(*others, F.col("_own").alias("_h"), path.alias("_path"))


def tree(nodes: DataFrame, fanout: int) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (_g, _n, _pos, _h and others) with _path; and (_g, _top), the root of
    each group."""
    levels = max(1, int(math.log(BLOCK, fanout) + 1e-9))
    most = nodes.agg(F.max("_n")).first()[0] or 1
    strata, low = [], nodes
    while True:
        strata.append(low)
        most = -(-most // fanout ** levels)
        low = stored(climb(low, fanout, levels), "nodes")
        if most <= 1:
            break
    above = None
    for s in reversed(strata[1:]):
        above = stored(descend(s, above, fanout, levels), "proofs").select("_g", "_pos", "_path")
    return descend(strata[0], above, fanout, levels), low.select("_g", F.col("_h").alias("_top"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, e: digest(e["before"], h, e["after"]))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda e: F.concat(e["before"], e["after"])), ""))


def manifest(docs: DataFrame, fields: dict[str, Column] | tuple[str, ...] = FIELDS, group_col: str = "lang", id_col: str = "doc_id",
             fanout: int = FANOUT, extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, group, leaf, subroot, root, path, and ``extra``): ``path`` holds the siblings
    (before and after, digests as text) of each level from the leaf to the root.
    ``extra`` are more columns over ``docs`` to keep, named apart from these."""
    fields = fields if isinstance(fields, dict) else {f: F.col(f"`{f}`") for f in fields}
    group = F.col(f"`{group_col}`").cast("string")
    rows = docs.select(F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("_g"), F.col(f"`{id_col}`").alias("_id"),
                       leaf_of(fields).alias("_h"), F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in (extra or {}).items()]).alias("_x"))
    leaves = numbered(stored(rows, "leaves"), [F.col("_id").asc_nulls_first(), F.col("_h")])
    leaves, tops = tree(stored(leaves, "leaves"), fanout)
    tops = stored(tops, "subroots")
    over = numbered(tops.select(F.lit(0).alias("_g"), F.col("_g").alias("_name"), F.col("_top").alias("_h")), [F.col("_name")])
    groups, root = tree(stored(over, "subroots"), fanout)
    groups = groups.join(root.select("_g", F.col("_top").alias("root")), "_g")          # root: one row
    groups = stored(groups.select("_name", F.col("_h").alias("subroot"), "root", F.col("_path").alias("_rest")), "groups")
    out = leaves.join(broadcast_if_small(groups), F.col("_g") == F.col("_name"))
    return out.select(F.col("_id").alias("id"), F.expr("CASE WHEN _g <> '' THEN substring(_g, 2) END").alias("group"), F.col("_h").alias("leaf"),
                      "subroot", "root", F.concat("_path", "_rest").alias("path"), *[F.col(f"_x.{k}").alias(k) for k in extra or {}])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    # One more than n_chars, beyond the range of a long, too.
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    changed = {f: F.col(f) for f in FIELDS} | {"n_chars": more}
    m = manifest(docs, extra={"changed": F.when(hit & F.col("n_chars").isNotNull(), leaf_of(changed))})
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    out = m.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# SQL has no crc32: bit by bit over the decimal's bytes.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
  lambda s, c: list_reduce(list_prepend(xor(s, c), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT)"""


def _sql_field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_sql_field(n_chars if f == "n_chars" else f) for f in FIELDS) + ")"


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_sql_leaf("n_chars")} AS leaf,
         CASE WHEN n_chars IS NOT NULL AND {_CRC} % 7 = 0 THEN {_sql_leaf("(n_chars::HUGEINT + 1)")} END AS changed
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT 0 AS lvl, g, pos, n, leaf AS h FROM leaves
      UNION ALL
      SELECT lvl + 1, g, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lvl, g, pos // 2, n),
sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM sub
      UNION ALL
      SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n),
r AS (SELECT h AS root FROM u WHERE n = 1),
depth AS (SELECT g, max(lvl) AS deep FROM t GROUP BY g),
steps AS (
  SELECT l.doc_id, l.leaf, k.lvl, (l.pos >> k.lvl) & 1 AS slot, coalesce(s.h, '') AS sib
  FROM leaves l JOIN depth USING (g) JOIN (SELECT DISTINCT lvl FROM t) k ON k.lvl < deep
  LEFT JOIN t s ON s.lvl = k.lvl AND s.g = l.g AND s.pos = xor(l.pos >> k.lvl, 1::BIGINT)
  UNION ALL
  SELECT l.doc_id, l.leaf, deep + k.lvl, (b.pos >> k.lvl) & 1, coalesce(s.h, '')
  FROM leaves l JOIN depth USING (g) JOIN sub b USING (g) JOIN (SELECT DISTINCT lvl FROM u WHERE n > 1) k ON true
  LEFT JOIN u s ON s.lvl = k.lvl AND s.pos = xor(b.pos >> k.lvl, 1::BIGINT)),
proof AS (SELECT doc_id, leaf, sha256(string_agg(sib, '' ORDER BY lvl)) AS proof_sha256, max(lvl) + 1 AS steps FROM steps GROUP BY doc_id, leaf),
f AS (SELECT doc_id, leaf, 0 AS lvl, coalesce(changed, leaf) AS h FROM leaves
      UNION ALL
      SELECT f.doc_id, f.leaf, f.lvl + 1, CASE WHEN slot = 0 THEN sha256(f.h || sib) ELSE sha256(sib || f.h) END
      FROM f JOIN steps s ON s.doc_id = f.doc_id AND s.leaf = f.leaf AND s.lvl = f.lvl)
SELECT l.doc_id, l.leaf, subroot, root, proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves l JOIN sub USING (g) CROSS JOIN r
JOIN proof p ON p.doc_id = l.doc_id AND p.leaf = l.leaf
JOIN f ON f.doc_id = l.doc_id AND f.leaf = l.leaf AND f.lvl = p.steps
"""
