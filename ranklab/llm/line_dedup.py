"""Line dedup by overlapping three-line windows.

Every three consecutive lines of a document are hashed (128 bits). Windows that
occur more than once anywhere are found by one aggregation, which also names the
first occurrence (smallest document id, then position). Later occurrences are
removed: the lines they cover, merged over all removed windows of a document.
Every line that goes has an equal line at an earlier place, so the first copy of
a passage always stays.

DataFrame functions only. Counting combines in the map tasks, so a window that
fills the corpus is one row per task; the join back is an ordinary equi-join that
adaptive execution splits where a window is hot. What is gathered is the removed
positions of one document.

Defined results: lines are what ``\\n`` separates. A document of fewer than three
lines has no window and stays whole; a null text counts as empty (one empty
line). Windows of blank lines only are never removed. Rows that agree in id and
text are one document in two rows: they never remove each other. Extra columns of
the input stay (``dedup_lines``) or are ignored (``op3_line_dedup``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, row_key, table, text_or_empty

WINDOW = 3


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(_id, _k, pos, h) for each window that isn't blank."""
    lines = docs.withColumn("_l", F.split("_t", "\n"))
    last = F.size("_l") - window

    def hashed(i: Column) -> Column:
        part = F.slice(F.col("_l"), i + 1, F.lit(window))
        blank = F.trim(F.array_join(part, "")) == ""
        return F.when(~blank, F.unhex(F.md5(F.array_join(part, "\n").cast("binary"))))

    hashes = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), hashed))
    return lines.select("_id", "_k", F.posexplode(hashes).alias("pos", "h")).where(F.col("h").isNotNull())


def removed_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_id, _k, covered): sorted positions of the lines to remove, for documents
    that lose any. ``docs`` has _id, _k and _t."""
    w = _windows(docs.select("_id", "_k", "_t"), window)
    place = F.struct("_id", "_k", "pos")
    # A window counts as repeated when its last place isn't its first.
    found = w.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    found = found.where(~F.col("first").eqNullSafe(F.col("last"))).select("h", "first")
    later = w.join(found, "h").where(~F.col("first").eqNullSafe(place))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (window - 1)))))
    return later.groupBy("_id", "_k").agg(F.collect_set("pos").alias("at")).select(
        F.col("_id").alias("_rid"), F.col("_k").alias("_rk"), covered.alias("_covered"))


def cut_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(_row, n_lines, n_removed): the rows of ``docs`` with the remaining text."""
    d = docs.select(packed(docs), F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    d = d.withColumn("_k", row_key("_id", "_t"))
    gone = removed_lines(d, window)
    out = d.join(gone, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_k") == F.col("_rk")), "left")
    out = out.withColumn("_l", F.split("_t", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), F.col("_covered"))
    cut = F.col("_row").withField(f"`{text_col}`", F.array_join(F.transform(kept, lambda i: F.get(F.col("_l"), i)), "\n"))
    return out.select(F.when(F.col("_covered").isNull(), F.col("_row")).otherwise(cut).alias("_row"), F.size("_l").alias("n_lines"),
                      F.coalesce(F.size("_covered"), F.lit(0)).alias("n_removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the remaining text."""
    return cut_lines(docs, id_col, text_col, window).select("_row.*")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_lines(docs).select("_row.doc_id", "n_lines", "n_removed", text_or_empty("_row.text").alias("text"))


# d is (doc_id, text); l its lines.
SQL_CTES = """
l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM d),
p AS (SELECT doc_id, l, unnest(range(len(l) - 2)) AS pos FROM l WHERE len(l) >= 3),
w AS (SELECT doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS h
      FROM p WHERE trim(l[pos + 1] || l[pos + 2] || l[pos + 3]) <> ''),
o AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS nth FROM w),
g AS (SELECT doc_id, list(DISTINCT pos + k) AS gone
      FROM o, range(3) AS r(k) WHERE nth > 1 GROUP BY doc_id),
kept AS (SELECT l.doc_id, len(l.l) AS n_lines, coalesce(len(gone), 0) AS n_removed,
                array_to_string(list_transform(list_filter(range(len(l.l)), lambda i: gone IS NULL OR NOT list_contains(gone, i)),
                                               lambda i: l.l[i + 1]), chr(10)) AS text
         FROM l LEFT JOIN g ON l.doc_id = g.doc_id)
"""
SQL = f"WITH d AS (SELECT doc_id, text FROM documents), {SQL_CTES} SELECT doc_id, n_lines, n_removed, text FROM kept"
