"""Mixing sources to target weights by temperature.

A source's share of all tokens, p, is tempered: its weight is p**alpha over the
sum of all. alpha 1 keeps the shares, alpha 0 makes all sources equal. With a
falling alpha the entropy of the weights and the repetition of small sources both
rise, so alpha is found by bisection: the largest that reaches ``target_entropy``
(as a share of the entropy of equal weights), but none below which the most
repeated source would be seen ``max_repeat`` times as often as the least. Each
step evaluates many exponents at once by one aggregation over the sources' totals,
so the driver gets a few numbers a step, however many sources there are.

A source's budget is its weight times the budget of all, by default as many tokens
as let the least repeated source be seen exactly once, so that no document is
lost. Budgets are realised by block permutations: the documents of a source are
dealt by a hash into blocks of about BLOCK rows; a block's budget is its part of
the source's budget, spent epoch by epoch, in every epoch in a new permutation of
the block: whole epochs, then the permutation's first documents, while a
document's middle lies within the budget. A block is off by half a document at
most, and no source is ordered as a whole, so a source with most of the rows is
as many independent blocks.

Tokens are white-space separated words.

Defined results: a null source is a source of its own; a null or empty text has no
tokens and is visited once. Sources without tokens get weight 0 and every document
once. Repeated rows are separate documents. An empty table
gives an empty mixture. Extra columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import packed, stored, table, text_or_empty

TARGET_ENTROPY = 0.97        # of the entropy of equal weights
MAX_REPEAT = 2.0             # most repeated source over least repeated
BLOCK = 2048
STEPS, GRID = 6, 32          # bisection: each step narrows GRID times
SEED = 20240229


def tokens(text: Column) -> Column:
    """Number of white-space separated words."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def find_exponent(sources: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeat: float = MAX_REPEAT) -> float:
    """The exponent for ``sources`` (n: tokens, one row per source)."""
    some = sources.where("n > 0")
    total = some.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.min("n").alias("least"), F.max("n").alias("most")).first()
    if not total.k or total.k == 1 or total.least == total.most:
        return 1.0
    # repetition of a source is weight / share, p**(alpha - 1); most over least is closed
    spread = math.log(total.most / total.least)
    floor = max(0.0, 1.0 - math.log(max_repeat) / spread)
    want = target_entropy * math.log(total.k)
    low, high = 0.0, 1.0
    share = F.log(F.col("n") / F.lit(float(total.n)))
    for _ in range(STEPS):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        sums = [x for a in grid for x in (F.sum(F.exp(share * a)), F.sum(share * a * F.exp(share * a)))]
        row = some.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        # entropy of w = p**a / z is ln z - sum(w ln p**a)
        entropy = [math.log(row[2 * i]) - row[2 * i + 1] / row[2 * i] for i in range(GRID + 1)]
        good = [i for i in range(GRID + 1) if entropy[i] >= want]
        at = max(good, default=0)
        if at == GRID:
            low = high
            break
        low, high = grid[at], grid[at + 1]
    return max(low, floor)


def weights(sources: DataFrame, alpha: float, budget: float | None = None) -> DataFrame:
    """``sources`` (s, n) with weight, budget and repeat (budget / tokens)."""
    total = sources.where("n > 0").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("n").alias("least"),
                                       F.sum(F.pow(F.col("n").cast("double"), alpha)).alias("z")).first()
    if not total.n:
        return sources.withColumns({"weight": F.lit(0.0), "budget": F.lit(0.0), "repeat": F.lit(1.0)})
    if budget is None:
        # weight / share is least for the largest source (alpha is 0 to 1)
        budget = total.most * total.z / total.most ** alpha
    weight = F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), alpha) / total.z).otherwise(0.0)
    return sources.withColumn("weight", weight).withColumns({
        "budget": F.col("weight") * budget,
        "repeat": F.when(F.col("n") > 0, F.col("weight") * budget / F.col("n")).otherwise(1.0)})


def visits(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeat: float = MAX_REPEAT, budget: float | None = None,
            source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, tokens, weight, block, epoch, position): the rows of ``docs``, once per
    visit; the position orders the visits of an epoch in a block."""
    text = text_or_empty(text_col)
    # 128 bits name a row; only where rows agree in id, source and text they are numbered
    d = docs.select(packed(docs), tokens(text).alias("_tokens"), F.col(source_col).alias("_s"),
                    F.xxhash64(F.lit(SEED), id_col, source_col, text).alias("_h"),
                    F.xxhash64(F.lit(SEED + 1), text, id_col, source_col).alias("_g"))
    small = stored(d.select("_s", "_h", "_g", "_tokens"), "rows")
    keys = ["_h", "_g"]
    if small.groupBy(*keys).count().where("count > 1").limit(1).count():
        number = F.row_number().over(Window.partitionBy("_h", "_g").orderBy("_h"))
        small, d, keys = small.withColumn("_nth", number), d.withColumn("_nth", number), [*keys, "_nth"]
    size = stored(small.groupBy(F.col("_s").alias("s")).agg(F.sum("_tokens").alias("n"), F.count("*").alias("rows")), "sources")
    alpha = find_exponent(size, target_entropy, max_repeat)
    share = weights(size, alpha, budget).select("s", F.col("weight").alias("_weight"), F.col("repeat").alias("_repeat"),
                                                F.ceil(F.col("rows") / BLOCK).alias("_blocks"))
    small = small.join(share, F.col("_s").eqNullSafe(F.col("s")))
    small = small.withColumn("_block", F.pmod(F.xxhash64(*keys), F.col("_blocks")))
    small = small.withColumn("_all", F.sum("_tokens").over(Window.partitionBy("_s", "_block")))
    # whole epochs and one more permutation for the rest
    epochs = F.greatest(F.lit(1), F.ceil(F.round("_repeat", 9))).cast("int")
    seen = small.withColumn("_epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    seen = seen.withColumn("_order", F.xxhash64(F.lit(SEED), "_epoch", *keys))
    earlier = (Window.partitionBy("_s", "_block", "_epoch").orderBy("_order", *keys)
               .rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.sum("_tokens").over(earlier), F.lit(0)) + F.col("_epoch") * F.col("_all")
    seen = seen.where((F.col("_tokens") == 0) & (F.col("_epoch") == 0) | (F.col("_tokens") > 0)).withColumn("_before", before)
    seen = seen.where((F.col("_tokens") == 0) | (F.col("_before") + F.col("_tokens") / 2 <= F.col("_repeat") * F.col("_all") + 1e-6))
    per_row = seen.groupBy(*keys).agg(
        F.first("_weight").alias("_weight"), F.first("_block").alias("_block"), F.collect_list(F.struct("_epoch", "_order")).alias("_v"))
    return d.join(per_row, keys).withColumn("_v", F.explode("_v")).select(
        "_row", F.col("_tokens").alias("tokens"), F.col("_weight").alias("weight"), F.col("_block").alias("block"),
        F.col("_v._epoch").alias("epoch"), F.col("_v._order").alias("position"))


def mixture(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """The rows of ``docs``, once per visit."""
    return visits(docs, target_entropy, max_repeat).select("_row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return visits(docs).select("_row.doc_id", "_row.source", F.col("tokens").alias("n_tokens"), "weight", "block", "epoch", "position")
