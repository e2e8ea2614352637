"""Suffix-array dedup: bytes covered by strings of LENGTH bytes that occur again.

A whole-corpus suffix array is replaced by suffix sorting inside buckets that
lose no match. Every LENGTH-byte string picks its anchor: the GRAM bytes in it
with the smallest hash (leftmost of equals). Equal strings pick the same bytes at
the same place, so suffixes that share LENGTH bytes meet under the same anchor.
Consecutive starts with one anchor form a stretch; its context is the bytes that
its strings cover.

1. One pass gives (anchor hash, context hash, document, stretch). Anchors that
   occur once are gone after a count.
2. Contexts that occur more than once are repeated as a whole: their members need
   no comparison, however many there are.
3. Of each context one is kept, and anchors with several contexts are compared:
   their bytes are fetched, dealt by anchor, and the starts are ranked by their
   LENGTH bytes (prefix doubling). In the order of rank and place equal strings are
   neighbours: ``keep_first`` removes a start whose neighbour before it is equal,
   that is, an earlier copy; without it an equal neighbour on either side is
   enough. No longest-previous-factor array and no previous or next smaller
   positions are computed: whether LENGTH bytes agree is all that is asked.
4. An anchor with more than HOT contexts (a common phrase in ever new
   surroundings) isn't sorted in one task. Its contexts are cut into parts of PART
   starts at fixed distances from the anchor. The bytes that all strings of a part
   share are its core: parts whose core occurs once hold no repeated string, equal
   parts are repeated as a whole, and of the other parts one each is expanded into
   its strings. All of this is hashing (128 bits) and ordinary aggregation.
5. Removed starts become byte ranges, merged per document.

Nothing is gathered but the ranges of one document; contexts of a bucket are at
most HOT. Texts travel compressed, twice: to fetch contexts and to cut.

Defined results: a null text is empty; a text shorter than LENGTH loses nothing.
Matches never cross documents. Rows that agree in id and text are copies like any
others. Removed bytes may split a character; the kept bytes are hashed as they
are. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_width, slices, stored, table, text_or_empty

LENGTH = 200
GRAM = 32
HOT = 128
PART = 16
SEGMENT = 1 << 19
SORTED_BYTES = 1 << 20       # context bytes sorted at once
_SLICE = 2 << 20

_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_BASE = 0x9E3779B97F4A7C15 | 1
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _C1
    x = (x ^ x >> np.uint64(27)) * _C2
    return x ^ x >> np.uint64(31)


def hashes(buf: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Polynomial hashes of the ``size`` bytes from each position, for powers of
    two up to the largest; entries near the end are of no use."""
    h, size, out = _TABLE[buf], 1, {}
    while True:
        if size in sizes:
            out[size] = h
        if size == max(sizes):
            return out
        factor = np.uint64(pow(_BASE, size, 1 << 64))
        longer = h * factor
        longer[:-size] += h[size:]
        h, size = longer, size * 2


def block_hash(h: dict[int, np.ndarray], start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of buf[start:start + size] from the hashes of two halves that overlap;
    sizes are 128 to 512."""
    small = size <= 256
    s = np.where(small, 128, 256)
    a = np.where(small, h[128][start], h[256][start])
    b = np.where(small, h[128][start + size - s], h[256][start + size - s])
    return mix(a + np.uint64(1)) * np.uint64(3) ^ mix(b ^ np.uint64(0x5555555555555555)) + size.astype(np.uint64)


def stretches(buf: np.ndarray, begin: np.ndarray, sizes: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, lo, count, offset, anchor hash, context hash) of the stretches of
    texts that lie in ``buf`` from ``begin``: starts lo to lo + count - 1 of the
    text have their anchor ``offset`` bytes after lo. A stretch may come in two
    parts at the border of a segment only if both parts would also come so
    elsewhere: segments are cut at the ends of texts, or where one is long, at
    changes of the anchor."""
    width = length - GRAM + 1
    n_starts = np.maximum(0, sizes - length + 1)
    total = int(begin[-1])
    s = 0
    while s < total:
        e = min(total, s + SEGMENT)
        part = buf[s:e + 2 * length + 512]
        h = hashes(part, (GRAM, 128, 256))
        count = min(e - s, len(part) - length)
        reach = count + width - 1
        key = (mix(h[GRAM][:reach]) >> np.uint64(20) << np.uint64(20)) | np.arange(reach, dtype=np.uint64)
        best, w = key, 1
        while 2 * w <= width:
            best = np.minimum(best[:-w], best[w:])
            w *= 2
        if w < width:
            best = np.minimum(best[:len(best) - (width - w)], best[width - w:])
        anchor = (best[:count] & np.uint64((1 << 20) - 1)).astype(np.int64)
        at = np.arange(count) + s
        text = np.searchsorted(begin, at, side="right") - 1
        good = at - begin[text] < n_starts[text]
        change = np.ones(count, bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (good[1:] != good[:-1])
        head = np.flatnonzero(change)
        runs = np.diff(np.append(head, count))
        if e < total and len(head) > 1:
            # the last stretch may go on: the next segment begins with it
            head, runs, e = head[:-1], runs[:-1], s + int(head[-1])
        keep = good[head]
        head, runs = head[keep], runs[keep]
        if len(head):
            t = text[head]
            yield (t, head + s - begin[t], runs, anchor[head] - head, h[GRAM][anchor[head]],
                   block_hash(h, head, runs + length - 1) + (anchor[head] - head).astype(np.uint64))
        s = e


def _laid_out(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    buf = np.zeros(int(begin[-1]) + 4 * length + 1024, np.uint8)
    for t, b in zip(texts, begin.tolist(), strict=False):
        buf[b:b + len(t)] = np.frombuffer(t, np.uint8)
    return buf, begin, sizes


PACK = 16                    # lo << PACK | count << 8 | offset


def _anchors(length: int, id_type: pa.DataType) -> Callable:
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("doc_id", id_type), ("k", pa.int32()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_t", _SLICE):
            buf, begin, sizes = _laid_out([t.encode() for t in b.column("_t").to_pylist()], length)
            ids, ks = b.column("doc_id").cast(id_type), b.column("k")
            for t, lo, n, off, h, c in stretches(buf, begin, sizes, length):
                where = pa.array(t)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), ids.take(where), ks.take(where),
                                       pa.array(lo << PACK | n << 8 | off)], schema=schema)
    return run


def _compressed(id_type: pa.DataType) -> Callable:
    schema = pa.schema([("doc_id", id_type), ("k", pa.int32()), ("z", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in slices(batches, "_t"):
            yield pa.record_batch([b.column("doc_id").cast(id_type), b.column("k"),
                                   pa.array([z.compress(t.encode()) for t in b.column("_t").to_pylist()], pa.binary())], schema=schema)
    return run


def _contexts(length: int, id_type: pa.DataType) -> Callable:
    schema = pa.schema([("h", pa.int64()), ("many", pa.bool_()), ("doc_id", id_type), ("k", pa.int32()), ("at", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for b in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                rows = []
                for doc, k, data, wanted in zip(*(b.column(c).to_pylist() for c in ("doc_id", "k", "z", "wanted")), strict=True):
                    raw = z.decompress(data)
                    for w in wanted:
                        lo, n = w["at"] >> PACK, w["at"] >> 8 & 255
                        rows.append((w["h"], w["many"], doc, k, w["at"], raw[lo:lo + n + length - 1]))
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    return run


def equal_classes(buf: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes from each position in suffix order, equal for
    equal bytes, by prefix doubling. ``buf`` has ``length`` bytes to spare, for
    whose positions there is no rank."""
    n = len(buf) - length
    words = np.lib.stride_tricks.sliding_window_view(buf, 8)[:, ::-1]
    rank = np.unique(np.ascontiguousarray(words).view("<u8").ravel(), return_inverse=True)[1].astype(np.int64)
    size = 8
    while 2 * size <= length:
        pair = rank[:len(rank) - size] * (int(rank.max()) + 1) + rank[size:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        size *= 2
    if size < length:
        rest = length - size
        pair = rank[:len(rank) - rest] * (int(rank.max()) + 1) + rank[rest:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    return rank[:n]


def repeated_starts(groups: np.ndarray, order: np.ndarray, contexts: list[bytes], length: int, keep_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of the strings of ``length`` bytes that occur again in a
    context of the same group; with ``keep_first`` only those with an earlier
    copy by ``order`` (place of the context), then start."""
    sizes = np.array([len(c) for c in contexts])
    buf = np.frombuffer(b"".join(contexts) + bytes(length), np.uint8)
    begin = np.cumsum(sizes) - sizes
    n = sizes - length + 1
    context = np.repeat(np.arange(len(contexts)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    rank = equal_classes(buf, length)[begin[context] + start]
    # suffix order inside groups; equal strings in order of place
    by = np.lexsort((start, order[context], rank, groups[context]))
    same = (np.diff(rank[by]) == 0) & (np.diff(groups[context][by]) == 0)
    previous = np.concatenate(([False], same))     # shares its bytes with the one before: a smaller position
    following = np.concatenate((same, [False]))
    hit = by[previous if keep_first else previous | following]
    return context[hit], start[hit]


def _sorted_buckets(length: int, keep_first: bool, id_type: pa.DataType) -> Callable:
    schema = pa.schema([("doc_id", id_type), ("k", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])

    def resolve(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        at = t["at"].to_numpy()
        # place of a context: documents in order of id, then the start
        order = np.argsort(t.select(["doc_id", "k", "at"]).append_column("i", pa.array(np.arange(t.num_rows)))
                           .sort_by([("doc_id", "ascending"), ("k", "ascending"), ("at", "ascending")])["i"].to_numpy())
        c, s = repeated_starts(t["h"].to_numpy(), order, t["bytes"].to_pylist(), length, keep_first)
        o = np.lexsort((s, c))
        c, s = c[o], s[o]
        head = np.flatnonzero((np.diff(c, prepend=-1) != 0) | (np.diff(s, prepend=-2) != 1))
        last = np.append(head[1:], len(c)) - 1 if len(c) else head
        lo = (at[c[head]] >> PACK) + s[head]
        return pa.record_batch([t["doc_id"].combine_chunks().cast(id_type).take(pa.array(c[head])), t["k"].combine_chunks().take(pa.array(c[head])),
                                pa.array(lo), pa.array(lo + (s[last] - s[head]) + length)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for b in slices(iter([batch]), "bytes", SORTED_BYTES):
                held.append(pa.Table.from_batches([b]))
                if sum(x.nbytes for x in held) < SORTED_BYTES:
                    continue
                t = pa.concat_tables(held).combine_chunks()
                h = t["h"].to_numpy()
                cut = int(np.flatnonzero(h != h[-1]).max(initial=-1)) + 1
                if cut:
                    yield resolve(t.slice(0, cut))
                held = [t.slice(cut)]
        if held:
            t = pa.concat_tables(held)
            if t.num_rows:
                yield resolve(t)
    return run


def digest(raw: bytes, place: int = 0) -> bytes:
    return hashlib.blake2b(raw, digest_size=16, salt=place.to_bytes(8, "little")).digest()


def parts_of(at: int, raw: bytes, length: int) -> Iterator[tuple[bytes, bytes, int, bytes]]:
    """(core, whole, lo, bytes) of the parts of a context: starts whose distance
    to the anchor is PART j to PART j + PART - 1."""
    lo, n, off = at >> PACK, at >> 8 & 255, at & 255
    for j in range((off - n + 1) // PART, off // PART + 1):
        last = off - PART * j
        first, end = max(0, last - PART + 1), min(n - 1, last)
        part = raw[first:end + length]
        yield digest(raw[last:last + length - PART + 1], j), digest(part, j << 8 | last - first), lo + first, part


def _parts(length: int, id_type: pa.DataType) -> Callable:
    schema = pa.schema([("core", pa.binary()), ("whole", pa.binary()), ("doc_id", id_type), ("k", pa.int32()), ("lo", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "bytes", SORTED_BYTES):
            rows = [(core, whole, doc, k, lo, part) for doc, k, at, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "k", "at", "bytes")), strict=True)
                    for core, whole, lo, part in parts_of(at, raw, length)]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    return run


def _strings(length: int, id_type: pa.DataType) -> Callable:
    """Each string of a part by itself: its hash and place."""
    schema = pa.schema([("w", pa.binary()), ("doc_id", id_type), ("k", pa.int32()), ("lo", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "bytes", SORTED_BYTES):
            w, row, lo = [], [], []
            for i, (first, raw) in enumerate(zip(b.column("lo").to_pylist(), b.column("bytes").to_pylist(), strict=True)):
                for s in range(len(raw) - length + 1):
                    w.append(digest(raw[s:s + length]))
                    row.append(i)
                    lo.append(first + s)
            rows = pa.array(row, pa.int64())
            yield pa.record_batch([pa.array(w, pa.binary()), b.column("doc_id").cast(id_type).take(rows), b.column("k").take(rows),
                                   pa.array(lo, pa.int64())], schema=schema)
    return run


def _hot_ranges(contexts: DataFrame, length: int, keep_first: bool, name: str, at: pa.DataType) -> DataFrame:
    """(doc_id, k, lo, hi) of the repeated strings of hot anchors."""
    parts = stored(contexts.mapInArrow(_parts(length, at), f"core binary, whole binary, doc_id {name}, k int, lo long, bytes binary"), "parts")
    spot = F.struct("doc_id", "k", "lo")
    wholes = stored(parts.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(spot).alias("first"), F.first("bytes").alias("bytes")), "wholes")
    equal = parts.join(wholes.where("n > 1").select("core", "whole", "first"), ["core", "whole"])
    several = wholes.groupBy("core").agg(F.count("*").alias("m")).where("m > 1").select("core")
    strings = stored(wholes.join(several, "core").select("first.*", "bytes")
                           .mapInArrow(_strings(length, at), f"w binary, doc_id {name}, k int, lo long"), "strings")
    twice = strings.groupBy("w").agg(F.count("*").alias("n"), F.min(spot).alias("first")).where("n > 1").drop("n")
    single = strings.join(twice, "w")
    if keep_first:
        equal, single = (x.where(~F.col("first").eqNullSafe(spot)) for x in (equal, single))
    return equal.select("doc_id", "k", "lo", (F.col("lo") + F.length("bytes")).alias("hi")).unionByName(
        single.select("doc_id", "k", "lo", (F.col("lo") + length).alias("hi")))


def _cut(id_type: pa.DataType) -> Callable:
    schema = pa.schema([("doc_id", id_type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for b in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = []
                for doc, data, ranges in zip(*(b.column(c).to_pylist() for c in ("doc_id", "z", "ranges")), strict=True):
                    raw = z.decompress(data)
                    kept, end, spans = [], 0, 0
                    for r in sorted((r["lo"], r["hi"]) for r in ranges or ()):
                        if r[0] > end or not spans:
                            kept.append(raw[end:r[0]])
                            spans += 1
                        end = max(end, r[1])
                    kept = b"".join([*kept, raw[end:]])
                    rows.append((doc, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row;
    ``kept`` are the remaining bytes."""
    from pyspark.sql.pandas.types import to_arrow_type
    if not 2 * GRAM <= length <= 224:
        raise ValueError("length is 64 to 224")      # contexts and packed places
    kind = docs.schema[id_col].dataType
    name, at = kind.simpleString(), to_arrow_type(kind)
    text = text_or_empty(text_col)
    # rows with the same id are told apart by a hash of the text
    d = docs.select(F.col(id_col).alias("doc_id"), F.shiftrightunsigned(F.xxhash64(text), 33).cast("int").alias("k"), text.alias("_t"))
    anchors = d.mapInArrow(_anchors(length, at), f"h long, c long, doc_id {name}, k int, at long")
    again = anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    found = stored(anchors.join(again, "h"), "anchors")
    place = F.struct("doc_id", "k", "at")
    kinds = stored(found.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(place).alias("first")), "contexts")
    open_ = kinds.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1" if keep_first else "m > 1 and least = 1")
    wanted = (kinds.join(open_, "h").select("first.doc_id", "first.k", F.struct("h", (F.col("m") > HOT).alias("many"), "first.at").alias("w"))
                   .groupBy(F.col("doc_id").alias("i"), F.col("k").alias("j")).agg(F.collect_list("w").alias("wanted")))
    packed = d.mapInArrow(_compressed(at), f"doc_id {name}, k int, z binary")
    own = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("k") == F.col("j"))
    fetched = packed.join(wanted, own).dropDuplicates(["doc_id", "k"]).select("doc_id", "k", "z", "wanted")
    contexts = stored(fetched.mapInArrow(_contexts(length, at), f"h long, many boolean, doc_id {name}, k int, at long, bytes binary"), "bytes")
    dealt = contexts.where("not many").repartition(shuffle_width(docs.sparkSession), "h").sortWithinPartitions("h")
    ranges = dealt.mapInArrow(_sorted_buckets(length, keep_first, at), f"doc_id {name}, k int, lo long, hi long")
    ranges = ranges.unionByName(_hot_ranges(contexts.where("many"), length, keep_first, name, at))
    whole = found.join(kinds.where("n > 1").select("h", "c", "first"), ["h", "c"])
    if keep_first:
        whole = whole.where(~F.col("first").eqNullSafe(place))
    lo = F.shiftright("at", PACK)
    ranges = ranges.unionByName(whole.select("doc_id", "k", lo.alias("lo"), (lo + F.shiftright("at", 8).bitwiseAND(255) + (length - 1)).alias("hi")))
    per_doc = ranges.groupBy(F.col("doc_id").alias("i"), F.col("k").alias("j")).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    cut = packed.join(per_doc, own, "left").select("doc_id", "z", "ranges")
    return cut.mapInArrow(_cut(at), f"doc_id {name}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_first=False).drop("kept")

