"""From raw documents to packed training sequences.

STAGES run in order; each takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last
return the columns of ``documents``; what a stage rejects or removes is gone for
the next one.

1. toxicity: a classifier trained on the labelled rows among the documents
   (``labels`` beside them) drops the documents that it scores 0.5 or more.
2. line_dedup: later occurrences of three-line windows go; n_chars follows the
   text. A document that loses its last line goes.
3. near_dedup: of every class of near duplicates the document with the smallest
   id stays.
4. mixing: sources are tempered; every document is visited at least about once,
   those of small sources up to twice as often, each visit a row.
5. packing: pieces of at most 4096 tokens, placed in sequences.

Null texts count as empty throughout; a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklab.llm.common import stored, table
from ranklab.llm.line_dedup import cut_lines
from ranklab.llm.mixing import mixture
from ranklab.llm.near_dedup import keep_one
from ranklab.llm.packing import pack_documents
from ranklab.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = cut_lines(docs).where("n_removed < n_lines")
    length = F.length("_row.text").cast(docs.schema["n_chars"].dataType)
    row = F.when(F.col("n_removed") > 0, F.col("_row").withField("n_chars", length)).otherwise(F.col("_row"))
    return cut.select(row.alias("_row")).select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

# A trained classifier, sampled signatures and packing aren't SQL; the tests hold
# the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
