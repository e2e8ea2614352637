"""Phrase collocations by dynamic itemset counting.

Texts are split into pieces and words; phrases are runs of words inside a piece. The
documents are dealt into shards, written once and scanned in a cycle. Words are
counted from the first scan on. A longer phrase is active as soon as both phrases
that it is made of, without its last and without its first word, have reached the
threshold in the scans so far; it is counted from the next scan on, for exactly one
cycle, so that lengths are interleaved instead of taking a pass each. Scanning ends
when every phrase has had its cycle.

Which phrases have reached the threshold is a Bloom filter per step, of fixed size
and growing only, built by Spark (a bit-wise or over the phrases' bits) and sent to
the workers. At a visit a phrase is counted if this step's filter has both its parts
and the filter of the shard's last visit had not: once per shard, with the same rule
for the few phrases that are let in by chance. Every count is therefore exact; a full
filter (``filter_bits`` is a parameter) costs time, not correctness.

Texts are read once and stored as slices: the distinct words of a slice, with a
64-bit id each, and the codes of its words in order. An aggregation proves that no
two words of the corpus share an id; if two did, the next seed would be taken. A scan
sends each distinct phrase of a slice once, as ids, with its count, and is summed by
itself. Phrases are dealt into parts by hash; a row is the phrases that a slice has of
a part, a binary column for each word, and Spark brings the rows of a part together
to be summed. The parts are as many as the corpus' words ask for, some MB each. At the
end of a cycle the scans are merged into the counts so far, and a
phrase that has had its cycle below the threshold leaves them. In between, only
shares of at least threshold / shards are summed: no phrase reaches the threshold
without such a share, most frequent ones are found by these alone, and one that also
needs its smaller shares is found when the cycle ends. Phrases that stay get their
words back by joins. The driver holds filters only.

Scores join a phrase's cuts with the counts of both parts. The report keeps the first
rows of each language, cut in the map tasks before they are ranked.

Defined results: a null or empty text has no words; a null language counts as
``und``. Repeated rows are counted each. A very long text is a slice of its own. Ties
are ordered by score, count, and phrase as bytes. An empty table gives no rows. Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, scratch, slices, stored, table, text_or_empty
from .near_dedup import _blobs, _joined

LEAST = 10                   # occurrences of a phrase
LONGEST = 3                  # words of a phrase
SHARE = 50                   # percent of a phrase's occurrences in a longer one that drop it
REPORT = 2000                # rows per language
SHARDS = 4
FILTER_BITS = 1 << 26        # 8 MB, whatever the input
PROBES = 4
SLICE = 16 << 20             # bytes of text at once
SLICE_DOCS = 1 << 20         # and documents
SEND_ROWS = 1 << 16          # phrases sent, and words looked up, at once
PART = 1 << 18               # words of the corpus for each part of the phrases
ROW = 1 << 16                # words of phrases in a stored row, so that 16 bits tell them apart
CODED = "shard int, lang string, words array<string>, ids array<long>, n_words long, codes binary"
LINK = 1 << 31               # in a code: the next word is in the same piece

# Classes of bytes: 1 within a piece between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def _ids(lang: str, words: pa.Array, seed: int) -> np.ndarray:
    own = xxhash.xxh3_64_intdigest(lang.encode(), seed)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w, own) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
    return np.where(h == 0, np.uint64(1), h)           # 0: no word


def _extended(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all words but the last, and the last word's."""
    x = phrase * np.uint64(0x9E3779B97F4A7C15) ^ (word + np.uint64(0xD1B54A32D192ED03))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (h + np.uint64(i) * step) & np.uint64(bits - 1)


def _holds(cells: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for at in _probes(h, len(cells) * 64):
        found &= (cells[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _columns(longest: int) -> list[str]:
    return [f"w{i + 1}" for i in range(longest)]


def _codes(longest: int) -> list[str]:
    return [f"c{i + 1}" for i in range(longest)]


def _hash(cols: list[np.ndarray]) -> np.ndarray:
    h = cols[0]
    for w in cols[1:]:
        h = np.where(w == 0, h, _extended(h, w))
    return h


def _phrases(rows: pa.Table | pa.RecordBatch, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The words, as ids, and counts of the phrases in rows of a scan (``w1`` ...) or in
    summed rows (``ids``, and ``c1`` ... that point into a row's ids)."""
    if "w1" in rows.schema.names:
        return [_joined(rows[c], np.int64) for c in _columns(longest)], _joined(rows["n"], np.int64)
    ids = _joined(rows["ids"], np.int64)
    size = pc.binary_length(rows["ids"]).to_numpy(zero_copy_only=False) // 8
    first = np.repeat(np.cumsum(size) - size, pc.binary_length(rows["n"]).to_numpy(zero_copy_only=False) // 8)
    return [ids[first + _joined(rows[c], np.uint16)] for c in _codes(longest)], _joined(rows["n"], np.int64)


def _bits(bits: int, longest: int, least: int) -> Callable:
    """(cell, mask) of the phrases that occur ``least`` times and may be part of a
    longer one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(bits // 64, np.uint64)
        for b in batches:
            cols, n = _phrases(b, longest)
            good = (n >= least) & (cols[-1] == 0)
            for at in _probes(_hash([c[good].view(np.uint64) for c in cols]), bits):
                np.bitwise_or.at(mask, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        cell = np.flatnonzero(mask)
        yield pa.record_batch([pa.array(cell), pa.array(mask[cell].view(np.int64))], names=["cell", "mask"])

    return run


def _summed(longest: int, share: int, least: int, after: int) -> Callable:
    """The phrases of a part, each once, with its count and the first of its scans:
    those that occur ``least`` times or were first met after scan ``after``. Rows are
    of one scan and either of counts from ``share`` on (big) or of smaller ones; the
    words of a row are told once, and its phrases point to them."""
    keys = _columns(longest)

    def run(group: pa.Table) -> pa.Table:
        cols, n = _phrases(group, longest)
        since = np.repeat(group["since"].to_numpy(), pc.binary_length(group["n"]).to_numpy() // 8)
        t = pa.table([*cols, n, since], names=[*keys, "n", "since"])
        t = t.group_by(keys, use_threads=False).aggregate([("n", "sum"), ("since", "min")])
        n, since = t["n_sum"].to_numpy(), t["since_min"].to_numpy()
        kept = np.flatnonzero((n >= least) | (since > after))
        kept = kept[np.lexsort((n[kept] >= share, since[kept]))]
        n, since = n[kept], since[kept]
        big = n >= share
        new = np.concatenate([[True], (since[1:] != since[:-1]) | (big[1:] != big[:-1])])[:len(n)]
        new[::max(1, ROW // longest)] = True
        first = np.flatnonzero(new)
        edges = np.append(first, len(n))
        cols = np.stack([t[c].to_numpy()[kept] for c in keys])
        codes, ids = np.zeros(cols.shape, np.uint16), [np.zeros(0, np.int64)]
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own, at = np.unique(cols[:, a:z], return_inverse=True)
            ids.append(own)
            codes[:, a:z] = at.reshape(longest, -1)
        return pa.table([pa.repeat(group["part"][0], len(first)), pa.array(since[first]), pa.array(big[first]),
                         _blobs(np.concatenate(ids), np.cumsum([len(x) for x in ids])), *(_blobs(c, edges) for c in codes), _blobs(n, edges)],
                        names=["part", "since", "big", "ids", *_codes(longest), "n"])

    return run


def _rows(longest: int, least: int) -> Callable:
    """A row (w1, w2, ..., n) for each phrase that occurs ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, n = _phrases(b, longest)
            cols = [x[n >= least] for x in [*cols, n]]
            for i in range(0, len(cols[0]), SEND_ROWS):
                yield pa.record_batch([pa.array(x[i:i + SEND_ROWS]) for x in cols], names=[*_columns(longest), "n"])

    return run


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words in order, the distinct words, and whether a word and the
    next one are in the same piece. Every text ends in a piece's end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    kind = _KIND[data]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[data[inside]])])
    coded = words.dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(kind == 2), start)
    return coded.indices.to_numpy(), coded.dictionary, piece[1:] == piece[:-1]


def _code(shards: int, seed: int) -> Callable:
    """Slices of texts as rows of CODED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for b in slices(batches, limit=SLICE, rows=SLICE_DOCS):
            turn += 1
            for lang in pc.unique(b.column("lang")).to_pylist():
                code, words, link = _words(b.filter(pc.equal(b.column("lang"), lang)).column("text"))
                if not len(code):
                    continue
                codes = code.astype(np.uint32)
                codes[:-1] |= np.where(link, np.uint32(LINK), np.uint32(0))
                one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                yield pa.record_batch([
                    pa.array([turn % shards], pa.int32()), pa.array([lang]), one(words), one(pa.array(_ids(lang, words, seed).view(np.int64))),
                    pa.array([len(code)]), pa.array([codes.tobytes()], pa.binary())], names=["shard", "lang", "words", "ids", "n_words", "codes"])

    return run


def _distinct(code: np.ndarray, at: np.ndarray, k: int, n_words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The words (a column each) of the distinct phrases of k words at ``at``, with counts."""
    if n_words ** k >= 1 << 63:
        rows, n = np.unique(np.stack([code[at + i] for i in range(k)], 1), axis=0, return_counts=True)
        return list(rows.T), n
    key = code[at].astype(np.int64)
    for _ in range(k - 1):
        at += 1
        key *= n_words
        key += code[at]
    del at
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, n = key[first], np.diff(np.append(first, len(key))).astype(np.uint32)
    out = []
    for _ in range(k - 1):
        key, last = np.divmod(key, n_words)
        out.append(last.astype(np.uint32))
    return [key.astype(np.uint32), *reversed(out)], n


def _active(cells: np.ndarray, held: np.ndarray, word: np.ndarray, link: np.ndarray, longest: int) -> list[np.ndarray]:
    """For 2 words to ``longest``: where a phrase begins of which the filter has both
    parts. ``held`` tells it of single words."""
    h, run, out = word, np.ones(len(word), bool), []
    for k in range(2, longest + 1):
        run = run[:-1] & link[k - 2:]
        out.append(run & held[:-1] & held[1:])
        if k < longest:
            at = np.flatnonzero(out[-1])
            longer, held = np.zeros(len(run), np.uint64), np.zeros(len(run), bool)
            longer[at] = _extended(h[at], word[at + k - 1])
            h = longer
            held[at] = _holds(cells, h[at])
    return out


def _scan(now, before, first_cycle: bool, longest: int, parts: int) -> Callable:
    """(part, w1, w2, ..., n) of the phrases that become countable at this visit, in
    the first cycle also of words. Missing words are 0."""
    names = ["part", *_columns(longest), "n"]

    def sent(ids: np.ndarray, cols: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = np.zeros(len(n), np.min_scalar_type(parts))
        for i in range(0, len(n), SEND_ROWS):
            h = _hash([ids[c[i:i + SEND_ROWS]] for c in cols])
            part[i:i + SEND_ROWS] = (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        part = part[order].astype(np.int32)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        edges = np.append(first, len(n))
        few = max(1, len(first) * SEND_ROWS // len(n))
        for i in range(0, len(first), few):
            e = edges[i:i + few + 1]
            at = order[e[0]:e[-1]]
            columns = [ids[c[at]] for c in cols] + [np.zeros(len(at), np.int64)] * (longest - len(cols)) + [n[at].astype(np.int64)]
            yield pa.record_batch([pa.array(part[e[:-1]]), *(_blobs(x, e - e[0]) for x in columns)], names=names)

    def phrases_of(ids: np.ndarray, codes: np.ndarray, new: np.ndarray | None, old: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        code = codes & np.uint32(LINK - 1)
        if first_cycle:
            yield from sent(ids, [np.arange(len(ids))], np.bincount(code, minlength=len(ids)))
        if new is None:
            return
        begins = [np.zeros(len(code), bool) for _ in range(2, longest + 1)]
        alone = [(cells, _holds(cells, ids)) for cells in (new, old) if cells is not None]
        for i in range(0, len(code), SEND_ROWS):
            z = i + SEND_ROWS + longest - 1
            active = [_active(cells, held[code[i:z]], ids[code[i:z]], codes[i:z][:-1] >= LINK, longest) for cells, held in alone]
            for begin, due, *counted in zip(begins, *active, strict=True):
                due = functools.reduce(lambda x, y: x & ~y, counted, due)[:SEND_ROWS]
                begin[i:i + len(due)] = due
        for k in range(2, longest + 1):
            at = np.flatnonzero(begins[k - 2])
            if len(at):
                yield from sent(ids, *_distinct(code, at, k, len(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old = (np.frombuffer(x.value, np.uint64) if x is not None else None for x in (now, before))
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column("ids").slice(i, 1).flatten().to_numpy().view(np.uint64)
                yield from phrases_of(ids, np.frombuffer(b.column("codes")[i].as_buffer(), np.uint32), new, old)
        pa.default_memory_pool().release_unused()

    return run


def _shards(docs: DataFrame, text_col: str, lang_col: str, shards: int) -> tuple[DataFrame, DataFrame]:
    """The coded slices, written once; and (id, lang, word), no two words with one id."""
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                    F.concat(text_or_empty(F.col(f"`{text_col}`")), F.lit("\n")).alias("text"))
    for seed in range(64):
        path = scratch(spark, "shards")
        d.mapInArrow(_code(shards, seed), CODED).write.partitionBy("shard").parquet(path)
        coded = spark.read.schema(CODED).parquet(path)
        pair = F.explode(F.arrays_zip("ids", "words")).alias("x")
        words = stored(coded.select("lang", pair).select(F.col("x.ids").alias("id"), "lang", F.col("x.words").alias("word")).distinct(), "words")
        if words.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            return coded, words
    raise RuntimeError("word ids clash with every seed")


def count_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST,
                  shards: int = SHARDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, phrase, n): all phrases of up to ``longest`` words that occur ``least``
    times or more, and per language the number of all words under the empty phrase."""
    spark = docs.sparkSession
    coded, words = _shards(docs, text_col, lang_col, shards)
    keys = _columns(longest)
    lists = ", ".join(f"{c} binary" for c in [*keys, "n"])
    summed = ", ".join(["part int, since int, big boolean", *(f"{c} binary" for c in ["ids", *_codes(longest), "n"])])
    cells = np.zeros(filter_bits // 64, np.uint64)
    versions: list = [None]            # filter after 0, 1, ... scans, as sent; the same one while nothing is new
    share = -(-least // shards)
    parts = (coded.agg(F.sum("n_words")).first()[0] or 0) // PART + 1
    counts, scans, step = None, [], 0
    while step % shards or step == 0 or versions[step] is not versions[step - shards]:
        before = versions[step - shards] if step >= shards else None
        shard = coded.where(F.col("shard") == step % shards).select("ids", "codes")
        seen = shard.mapInArrow(_scan(versions[step], before, step < shards, longest, parts), f"part int, {lists}").withColumn("since", F.lit(step))
        scans.append(stored(seen.groupBy("part").applyInArrow(_summed(longest, share, 1, step), summed), "scan"))
        step += 1
        met = functools.reduce(DataFrame.unionByName, scans if counts is None else [counts, *scans])
        if step % shards:
            known = met.where("big").groupBy("part").applyInArrow(_summed(longest, share, least, step), summed)
        else:
            known = stored(met.groupBy("part").applyInArrow(_summed(longest, share, least, step - shards), summed), "phrases")
            for done in [*scans, *([] if counts is None else [counts])]:
                discard(done)
            counts, scans = known, []
        found = known.mapInArrow(_bits(filter_bits, longest, least), "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask"))
        found = found.toArrow()        # filter_bits / 64 rows at most
        grown = cells.copy()
        at = found.column("cell").to_numpy()
        grown[at] |= found.column("mask").to_numpy().view(np.uint64)
        versions.append(versions[-1] if np.array_equal(grown, cells) else spark.sparkContext.broadcast(grown.tobytes()))
        cells = grown
    n_words = coded.groupBy("lang").agg(F.sum("n_words").alias("n")).select("lang", F.lit("").alias("phrase"), "n")
    kept = stored(counts.mapInArrow(_rows(longest, least), ", ".join(f"{c} long" for c in [*keys, "n"])), "kept")
    return stored(_spelled(kept, words, keys).unionByName(n_words), "phrases")


def _spelled(counts: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """(lang, phrase, n): ids replaced by their words. A word of a phrase occurs as
    often as the phrase at least, so ``counts`` has it by itself, too."""
    alone = counts.where(functools.reduce(Column.__and__, [F.col(c) == 0 for c in keys[1:]], F.lit(True)))
    words = stored(words.join(alone.select(F.col(keys[0]).alias("id")), "id", "left_semi"), "spelling")
    out = counts
    for i, key in enumerate(keys):
        w = words.select(F.col("id").alias(f"_i{i}"), F.col("word").alias(f"_v{i}"), *([] if i else ["lang"]))
        out = out.join(w, F.col(key) == F.col(f"_i{i}"), "left" if i else "inner")
    return out.select("lang", F.concat_ws(" ", *[F.col(f"_v{i}") for i in range(len(keys))]).alias("phrase"), "n")


def _cut(words: Column, k: Column) -> Column:
    return F.struct(k.alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("first"),
                    F.array_join(F.slice(words, k + 1, F.size(words) - k), " ").alias("rest"))


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (left right)), exact up to counts of 10^15."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, left * right).cast("long")


def collocations(counts: DataFrame, least: int = LEAST, share: int = SHARE, report: int = REPORT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) from the counts of
    :func:`count_phrases`."""
    f = counts.where(F.col("phrase") != "")
    words = F.split("phrase", " ")
    cand = f.where((F.size(words) > 1) & (F.col("n") >= least)).select("lang", "phrase", F.col("n").alias("a"), words.alias("w"))
    # Longer candidates tell their parts how often they occur.
    size = F.size("w")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(
        F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice(F.col("w"), i, k), " "))))
    within = cand.where(size > 2).select(F.col("lang").alias("_wl"), "a", F.explode(F.array_distinct(parts)).alias("_wp"))
    within = within.groupBy("_wl", "_wp").agg(F.max("a").alias("_most"))
    kept = cand.join(within, (F.col("lang") == F.col("_wl")) & (F.col("phrase") == F.col("_wp")), "left")
    kept = kept.where(F.col("_most").isNull() | (F.col("_most") * 100 < F.col("a") * share)).select("lang", "phrase", "a", "w")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda k: _cut(F.col("w"), k))).alias("c"))
    left = f.select(F.col("lang").alias("_ll"), F.col("phrase").alias("_lp"), F.col("n").alias("l"))
    right = f.select(F.col("lang").alias("_rl"), F.col("phrase").alias("_rp"), F.col("n").alias("r"))
    cuts = cuts.join(left, (F.col("lang") == F.col("_ll")) & (F.col("c.first") == F.col("_lp")))
    cuts = cuts.join(right, (F.col("lang") == F.col("_rl")) & (F.col("c.rest") == F.col("_rp")))
    best = cuts.withColumn("score", score_of(F.col("a"), F.col("l"), F.col("r")))
    best = best.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "c.k", "l", "r")).alias("b"))
    order = Window.partitionBy("lang").orderBy(F.col("b.score").desc(), F.col("a").desc(), F.col("phrase"))
    top = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= report)
    n = counts.where(F.col("phrase") == "").select(F.col("lang").alias("_nl"), "n")
    return top.join(n, F.col("lang") == F.col("_nl")).select("lang", "rank", "phrase", "a", "b.l", "b.r", "n", "b.score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(count_phrases(table(spark, sf_dir, "documents").select("lang", "text")))


SQL = r"""
WITH p AS (
  SELECT lang, doc, unnest(list_zip(range(len(ps)), ps)) AS x FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
           regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
    FROM documents)),
w AS (SELECT lang, doc, x[1] AS piece, list_filter(regexp_split_to_array(x[2], '[\x20\x09]+'), lambda s: s <> '') AS ws FROM p),
o AS (SELECT lang, doc, piece, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, ws[i:i + k - 1] AS v FROM o, range(1, 4) AS r(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k AS size, phrase, any_value(v) AS v, count(*)::HUGEINT AS c FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, v, c AS a FROM f WHERE size > 1 AND c >= 10),
inside AS (
  SELECT lang, part, max(a) AS most FROM (
    SELECT lang, a, array_to_string(v[1:2], ' ') AS part FROM cand WHERE size = 3
    UNION ALL SELECT lang, a, array_to_string(v[2:3], ' ') FROM cand WHERE size = 3) GROUP BY lang, part),
kept AS (SELECT c.* FROM cand c LEFT JOIN inside i ON i.lang = c.lang AND i.part = c.phrase WHERE i.most IS NULL OR 100 * i.most < 50 * c.a),
cuts AS (
  SELECT c.lang, c.phrase, c.a, s.k, x.c AS l, y.c AS r, (1000000 * c.a * c.a) // (x.c * y.c) AS score
  FROM kept c JOIN range(1, 3) AS s(k) ON s.k < c.size
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.v[1:s.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.v[s.k + 1:c.size], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
