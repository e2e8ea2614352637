"""Helpers shared by the training-data operators: reading tables, the shared
scratch folder, row identity, and bounded slices of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20      # text handled at once inside a Python task
SLICE_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares: ``spark.checkpoint.dir``
    of the session, else the context's checkpoint folder; only where neither is
    set and Spark runs on one machine (tests) a temporary folder becomes it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet in the shared folder and read back: the plan runs
    once, its lineage is cut, and lost executors lose nothing. Spark deletes the
    plan's shuffles when the table is written."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`stored` that no later plan reads."""
    spark, path = df.sparkSession, getattr(df, "_llm_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_forget: dict[str, Callable[[], None]] = {}
_owner: list[str] = [""]


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """An operator's module keeps something in Python workers between tasks;
    ``forget`` releases it."""
    _forget[owner] = forget


def turn_of(owner: str) -> None:
    """Called where a task's Python code begins: what another operator kept in this
    worker is released, so a chain of stages needs no more memory than its largest."""
    if _owner[0] != owner:
        for other, forget in _forget.items():
            if other != owner:
                forget()
        pa.default_memory_pool().release_unused()
        _owner[0] = owner


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def row_key(*cols: str) -> Column:
    """Identity of a row that doesn't rest on unique ids: rows get the same key
    only when id and text are the same, and then nothing tells them apart."""
    return F.xxhash64(*[F.col(c) for c in cols])


def packed(df: DataFrame) -> Column:
    """All columns of a row as one struct, ``_row``: helpers' columns beside it
    can't clash with them. ``select("_row.*")`` unpacks it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``limit`` bytes of text at
    most, and ``rows`` rows (a longer single text is a slice of its own)."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > limit or i - start >= rows):
                yield b.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < b.num_rows:
            yield b.slice(start)
