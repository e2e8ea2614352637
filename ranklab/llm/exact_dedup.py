"""Exact dedup by a content sort.

Every text is normalised (runs of white space become one space). Sampled splitters
range-partition the rows by the leading bytes of the normalised text, its digest in
place of the rest, and the id; Spark's external sort then orders each partition by
the same key and the whole bytes, so that equal texts are neighbours and copies
ascend by id. One pass over a partition compares every text in full with the one
before it and closes a run where they differ; the first row of a run stays.

A run can reach over partition borders, as the id is part of the splitters: a group
that holds a third of all rows is spread over a third of the partitions. So each
partition reports its first and its last run with their text; equal texts among
these (two per partition at most) are joined into one group, and the rows of border
runs take the group's values. Nothing else is shuffled.

What a task holds is one batch of texts and, of the open run, the columns beside the
text (for ``keep_first``: its first row); a run is never longer than a partition,
whose size the splitters bound. Splitters hold 64 leading bytes, a digest, an id and
a place in the input each, however long the texts are.

Defined results: a null text counts as empty, so all null, empty and blank-only
texts ("" and " ") are two groups: empty, and one space. Ids order ascending, null
ids last; of rows that share id and text the one read first stays, so exactly one
row of a group is kept. A very long text is compared whole, as bytes. An empty
table gives no rows. Extra columns are ignored (``duplicate_groups``) or stay
(``keep_first``), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, shuffle_width, slices, stored, table, text_or_empty

LEAD = 64                    # bytes of a text that a splitter holds
SEND_PARTITIONS = 100_000    # up to this many partitions, two rows each are sent to all


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space. Single spaces aren't touched,
    so the expression has little to replace."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _sorted(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    """(_t, _s, _id, _row), equal texts next to each other, copies by id."""
    d = docs.select(row, F.col(f"`{id_col}`").alias("_id"), normalised(text_or_empty(F.col(f"`{text_col}`"))).cast("binary").alias("_t"),
                    F.monotonically_increasing_id().alias("_place"))
    d = d.withColumn("_s", F.unhex(F.sha2("_t", 256))).withColumn("_lead", F.substring("_t", 1, LEAD))
    by_id = F.col("_id").asc_nulls_last()
    d = d.repartitionByRange(shuffle_width(docs.sparkSession), "_lead", "_s", by_id, "_place")
    return d.sortWithinPartitions("_lead", "_s", "_t", by_id, "_place").select("_t", "_s", "_id", "_row")


def _schema(spark_row: T.DataType, id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("nth", T.LongType()),
        T.StructField("size", T.LongType()), T.StructField("first_id", id_type), T.StructField("digest", T.BinaryType()),
        T.StructField("border", T.BinaryType()), T.StructField("row", spark_row)])


def _compare(heads_only: bool) -> Callable:
    """Rows of closed runs: number of the run, place in it, its size, its first id,
    and on the first row of a partition's first and last run the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        runs, size = -1, 0            # of the open run: number, rows so far
        held: list[pa.RecordBatch] = []   # its rows without text (of heads: the first)
        text = first_id = None        # its text, and its first row's id as an array

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            at = 0
            for b in held:
                n = b.num_rows
                border = [text] if at == 0 and (last or runs == 0) else [None]
                yield _rows(part, np.full(n, runs), np.arange(at, at + n), np.full(n, size), first_id.take(pa.array(np.zeros(n, np.int64))),
                            b.column("_s"), pa.array(border + [None] * (n - 1), pa.binary()), b.column("_row"))
                at += n

        for b in batches:
            for s in slices([b], "_t"):
                t, n = s.column("_t"), s.num_rows
                fresh = np.ones(n, bool)
                if n > 1:
                    fresh[1:] = pc.not_equal(t.slice(1), t.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                fresh[0] = text is None or t[0].as_py() != text
                starts = np.flatnonzero(fresh)
                small = s.select(["_s", "_id", "_row"])
                end = int(starts[0]) if len(starts) else n
                if end:                                   # the open run goes on
                    size += end
                    if not heads_only:
                        held.append(_copied(small, 0, end))
                if not len(starts):
                    continue
                if text is not None:
                    yield from close(False)
                # All runs that begin and end inside this slice.
                ends = starts[1:]
                if len(ends):
                    lengths = np.diff(starts)
                    first = runs + 1
                    which = np.repeat(np.arange(len(lengths)), lengths)
                    inner = small.slice(int(starts[0]), int(starts[-1] - starts[0]))
                    take = pa.array(starts[:-1][which] - starts[0])
                    nth = np.arange(len(which)) - (starts[:-1] - starts[0])[which]
                    if first == 0:                        # the partition's first run has its text
                        border = pa.concat_arrays([pa.array([t[int(starts[0])].as_py()], pa.binary()), pa.nulls(len(which) - 1, pa.binary())])
                    else:
                        border = pa.nulls(len(which), pa.binary())
                    out = _rows(part, first + which, nth, lengths[which], inner.column("_id").take(take), inner.column("_s"), border, inner.column("_row"))
                    yield out.filter(pa.array(nth == 0)) if heads_only else out
                    runs += len(lengths)
                at = int(starts[-1])
                runs, size, text = runs + 1, n - at, t[at].as_py()
                held = [_copied(small, at, 1 if heads_only else n - at)]
                first_id = held[0].column("_id").slice(0, 1)
        if text is not None:
            yield from close(True)

    return run


def _copied(b: pa.RecordBatch, at: int, n: int) -> pa.RecordBatch:
    """Rows of ``b`` without the buffer that all columns of a received batch share,
    the text's too."""
    return b.take(pa.array(np.arange(at, at + n)))


def _rows(part: int, run, nth, size, first_id: pa.Array, digest: pa.Array, border: pa.Array, row: pa.Array) -> pa.RecordBatch:
    cols = [pa.array(np.full(len(run), part, np.int32)), pa.array(np.asarray(run, np.int64)), pa.array(np.asarray(nth, np.int64)),
            pa.array(np.asarray(size, np.int64)), first_id, digest, border, row]
    return pa.record_batch(cols, names=["part", "run", "nth", "size", "first_id", "digest", "border", "row"])


def _groups(docs: DataFrame, id_col: str, text_col: str, row: Column, heads_only: bool) -> DataFrame:
    """(row, keep_id, group_size, kept, digest); only first rows of runs if
    ``heads_only``."""
    spark = docs.sparkSession
    order = _sorted(docs, id_col, text_col, row)
    kind = order.schema
    out = order.mapInArrow(_compare(heads_only), _schema(kind["_row"].dataType, kind["_id"].dataType))
    runs = stored(out, "runs")
    heads = runs.where(F.col("border").isNotNull())
    place = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "part", "run")
    spans = heads.groupBy("border").agg(F.min(place).alias("at"), F.sum("size").alias("total"), F.collect_list(F.struct("part", "run")).alias("runs"))
    spans = spans.where(F.size("runs") > 1).select("at", "total", F.explode("runs").alias("r"))
    spans = spans.select(F.col("r.part").alias("_p"), F.col("r.run").alias("_r"), "at", "total")
    if shuffle_width(spark) <= SEND_PARTITIONS:
        spans = F.broadcast(spans)              # two rows of some bytes per partition at most
    joined = runs.join(spans, (F.col("part") == F.col("_p")) & (F.col("run") == F.col("_r")), "left")
    wide = F.col("at").isNotNull()
    return joined.select(
        "row", F.when(wide, F.col("at.first_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("total", "size").alias("group_size"),
        ((F.col("nth") == 0) & (~wide | ((F.col("at.part") == F.col("part")) & (F.col("at.run") == F.col("run"))))).alias("kept"),
        "digest")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): one row per row of ``docs``."""
    row = F.struct(F.col(f"`{id_col}`").alias("id")).alias("_row")
    g = _groups(docs, id_col, text_col, row, False)
    return g.select(F.col("row.id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, its text as it was."""
    return _groups(docs, id_col, text_col, packed(docs), True).where("kept").select("row.*")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
