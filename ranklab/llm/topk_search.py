"""Exact top-k inner products by no-random-access aggregation (NRA).

Vectors of integers are dealt into blocks of candidates; every query meets every
block (a block nested search over a stated query set). Within a block each
component is a list of the candidates sorted by that component, read from the top
for queries with a positive weight and from the bottom for negative ones. The
lists are read in step, to a growing share of their length. Of each candidate the
components read so far are known; an unread one lies between the end of its list
and the last value read. That gives a lower and an upper bound of each score. A
candidate whose upper bound is below the k-th largest lower bound cannot qualify;
as soon as few others are left, reading stops and their final scores are resolved.
Bounds are kept for many queries at once, as matrix products with the lists'
read parts. The best k of each block meet in a window over the query.

Candidates of a block (at most about BLOCK) stay in a task's memory; queries
stream past them. Queries are never collected.

Defined results: vectors that are null, empty of values (null components) or hold
a non-finite component take no part, nor do rows with a null id or with a
component beyond a long. Shorter vectors count as padded with zeros. Ties go to
the smaller id, then to the vector's hash; rows with the query's id are never its
candidates. A repeated query row is one query; repeated candidate rows are
separate candidates. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_width, stored, table

K = 20
SCALE = 64
BLOCK = 4096                   # candidates of a block, about
LEAST_BLOCKS = 12
DEPTHS = (0.5, 0.85, 1.0)      # share of the lists read
RESOLVE = 8                    # times k: so few candidates are resolved at once
QUERIES = 1024                 # queries handled at once


def whole_numbers(vector: Column) -> Column:
    """floor(SCALE x) of each component; null where the vector takes no part."""
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * SCALE) < float(1 << 62)))
    return F.when(vector.isNotNull() & fine, F.transform(v, lambda x: x.cast("long")))


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of lists as an integer matrix, padded with zeros."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Block:
    """Sorted lists over the candidates of a block."""

    def __init__(self, ids: np.ndarray, ties: np.ndarray, values: np.ndarray):
        order = np.lexsort((ties, ids))               # ties go to the smaller id
        self.ids, self.values = ids[order], values[order]
        self.lists = np.sort(self.values, axis=0)     # one list a component, rising

    def widen(self, width: int) -> None:
        if self.values.shape[1] < width:
            more = np.zeros((len(self.ids), width - self.values.shape[1]), np.int64)
            self.values, self.lists = np.hstack((self.values, more)), np.hstack((self.lists, more))

    def bounds(self, up: np.ndarray, down: np.ndarray, depth: float) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores after reading ``depth`` of each
        list; ``up`` and ``down`` are the positive and negative parts of queries."""
        n = len(self.ids)
        read = max(1, min(n, math.ceil(n * depth)))
        high, low = self.lists[n - read], self.lists[read - 1]      # last values read
        x, least, most = self.values, self.lists[0], self.lists[-1]
        upper = np.hstack((np.maximum(x, high), np.minimum(x, low)))
        lower = np.hstack((np.where(x >= high, x, least), np.where(x <= low, x, most)))
        q = np.hstack((up, down))
        kind = up.dtype
        return q @ lower.T.astype(kind), q @ upper.T.astype(kind)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of the best k of each query in this block."""
        self.widen(queries.shape[1])
        if queries.shape[1] < self.values.shape[1]:
            queries = np.hstack((queries, np.zeros((len(queries), self.values.shape[1] - queries.shape[1]), np.int64)))
        limit = float(np.abs(queries).max(initial=0)) * float(np.abs(self.values).max(initial=0)) * max(1, queries.shape[1])
        if limit >= 2.0 ** 53:
            return self._resolve_all(query_ids, queries, k)
        kind = np.float32 if limit < 2.0 ** 24 else np.float64       # sums are exact
        up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
        left = np.arange(len(queries))
        found = []
        for depth in DEPTHS:
            lower, upper = self.bounds(up[left], down[left], depth)
            own = self.ids[None, :] == query_ids[left, None]
            lower[own] = upper[own] = -np.inf
            at = max(0, lower.shape[1] - k)
            bar = np.partition(lower, at, axis=1)[:, at]
            may = (upper >= bar[:, None]) & ~own
            few = (may.sum(axis=1) <= RESOLVE * k) | (depth >= 1.0)
            q, c = np.nonzero(may[few])
            if len(q):
                q = left[few][q]
                found.append((q, c, np.einsum("ij,ij->i", queries[q], self.values[c])))
            left = left[~few]
            if not len(left):
                break
        if not found:
            return (np.zeros(0, np.int64),) * 3
        q, c, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return self._best(q, c, score, k)

    @staticmethod
    def _best(q: np.ndarray, c: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((c, -score, q))
        q, c, score = q[order], c[order], score[order]
        head = np.flatnonzero(np.diff(q, prepend=-1))
        nth = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
        return q[nth < k], c[nth < k], score[nth < k]

    def _resolve_all(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers too large for exact floating sums: whole numbers of any size,
        clipped to a long."""
        rows = []
        values = self.values.astype(object)
        for i, q in enumerate(queries.astype(object)):
            score = np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in values @ q], np.int64)
            c = np.flatnonzero(self.ids != query_ids[i])
            c = c[np.lexsort((c, ~score[c]))][:k]         # ~x falls as x grows, without overflow
            rows.append((np.full(len(c), i), c, score[c]))
        return tuple(np.concatenate(x) for x in zip(*rows, strict=True))


def _searched(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("query_tie", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            number = batch.column("block").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            cut = np.flatnonzero((np.diff(number) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if number[a] != now:
                    now, parts, block = number[a], [], None
                if not asks[a]:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if block is None:
                    t = pa.Table.from_batches(parts).combine_chunks()
                    block = Block(t["vec_id"].to_numpy(), t["tie"].to_numpy(), matrix(t["v"].combine_chunks()))
                for i in range(0, part.num_rows, QUERIES):
                    some = part.slice(i, QUERIES)
                    ids, ties = some.column("vec_id").to_numpy(), some.column("tie").to_numpy()
                    q, c, score = block.search(ids, matrix(some.column("v")), k)
                    yield pa.record_batch([pa.array(ids[q]), pa.array(ties[q]), pa.array(block.ids[c]), pa.array(score)], schema=schema)
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row where
    ``is_query`` holds."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col)).alias("v"), is_query.alias("asks"))
    v = stored(v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).withColumn("tie", F.xxhash64("v")), "vectors")
    blocks = max(LEAST_BLOCKS, math.ceil(v.count() / BLOCK))
    # the row's number keeps equal rows apart without putting them into one block
    held = v.select((F.pmod(F.xxhash64("vec_id", "tie", F.monotonically_increasing_id()), F.lit(blocks))).cast("int").alias("block"),
                    F.lit(False).alias("asks"), "vec_id", "tie", "v")
    queries = v.where("asks").select("vec_id", "tie", "v").dropDuplicates(["vec_id", "tie"])
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "tie", "v")
    dealt = held.unionByName(asked).repartition(max(blocks, shuffle_width(spark)), "block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(_searched(k), "query_id long, query_tie long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_tie").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
