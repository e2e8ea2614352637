"""Near-duplicate classes by improved consistent weighted sampling.

Texts become weighted sets of five-word shingles: the weight is the shingle's
count in the text times ln(1 + documents / document count). Copies of a text are one
document there (``spelled``): a text's copies don't make its own shingles common ones,
beside which a near copy's few other words would weigh too much. Documents are counted
for every shingle by itself: texts are dealt to parts of about PART bytes, a part
sends the distinct shingles of the documents that are counted in it, with their number,
to hash ranges (so a shingle of all documents is one entry a part), and a range sends
the sums above 1 back to the parts; a shingle that isn't sent back has one document.
Consistent weighted
sampling (Gamma(2, 1) variables by a hash of shingle and sample number, in the log
domain) draws BANDS * ROWS samples a text; two texts agree on a sample with
probability equal to their weighted Jaccard similarity. Texts that agree on a
whole band are candidates, and candidates are compared exactly by weighted Jaccard
over the same weights; THRESHOLD and more is a link, and connected texts are a
class.

No bucket is expanded into all pairs. Texts with the same words are one node.
In each round a bucket sends a few pivots (PIVOTS, then GROWTH times as many a
round) against its nodes of other classes: first those that share most buckets,
which stand in the middle of their group, later those of the smallest classes.
Links join classes, and pivots, being compared with all others, leave the bucket.
A comparison looks at the samples first: with fewer equal ones than a pair at the
threshold has but with probability MISS, the pair isn't a link; the others' texts
are compared exactly. A bucket is done when its remaining nodes are in one class.
Buckets of more than HOT nodes that the first round leaves open (a passage that many
texts share) are dealt anew by rare shingles: a link shares THRESHOLD of either
text's weight, so the rarest shingle that two linked texts share comes, in the order
of document counts, before the weight that is left falls below that share. Nodes
meet under such shingles of more than one document only, which loses no link. From
the first shared one on, either text must have the share of both weights that a link
needs: a node with too little left there for a partner of its own weight is no pivot,
and pivots meet those nodes only whose weights fit. Of shingles with the same nodes
one is left. So every candidate pair is either compared, no link by its weights, or already in
one class, whatever the bucket's size. Classes are labelled by the smallest node,
by rounds of neighbour minima and pointer jumping over DataFrames. Everything
that is used twice is a table in the shared folder.

Defined results: words are runs of letters and digits in lower case. A text of
one to four words is one shingle. Texts without words (null and empty ones, too)
are one class. The id of a class is its smallest document id (null where all are
null). Repeated rows fall into one class. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, packed, row_key, slices, stored, table, text_or_empty, turn_of

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 3, 16
PART = 2 << 20             # bytes of text whose shingles are counted at once
PIVOTS = 2                 # of a bucket in the first round
GROWTH = 4                 # times the pivots of the round before
HOT = 64                   # nodes of a bucket that pivots may compare in full
MISS = 1e-6                # a link's probability to be dropped by its samples
BLOCK = 32_768             # shingles sampled at once

_BASE = np.uint64(0x9E3779B97F4A7C15)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _C1
    x = (x ^ x >> np.uint64(27)) * _C2
    return x ^ x >> np.uint64(31)


def by_text(text: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The order by text, then hash; texts are numbered below ``n``."""
    order = np.argsort(h)
    # small numbers are sorted by radix
    return order[np.argsort(text[order].astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")]


class Shingles:
    """Distinct shingles of each text of a slice, sorted by text and hash:
    ``text``, ``hash`` and ``count``; ``key`` names a text's words."""

    def __init__(self, texts: pa.Array, keys: bool = True):
        clean = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "), " ")
        cut = pc.split_pattern(clean, " ")
        word = cut.flatten().dictionary_encode()
        edges = cut.offsets.to_numpy().astype(np.int64)
        edges = edges - edges[0]
        known = np.array([xxhash.xxh3_64_intdigest(w) for w in word.dictionary.cast(pa.binary()).to_pylist()] or [0], np.uint64)
        code = known[word.indices.to_numpy()] if len(word) else known[:0]
        empty = np.asarray(pc.equal(pc.binary_length(clean), 0))
        n_words = np.where(empty, 0, np.diff(edges))
        n = len(texts)
        if keys:
            raw = code.tobytes()
            self.keys = [hashlib.blake2b(raw[8 * a:8 * (a + k)], digest_size=16).digest()
                         for a, k in zip(edges[:-1].tolist(), n_words.tolist(), strict=True)]
        # the words after the last begin shingles of texts that are shorter than one
        padded = np.concatenate((code, np.zeros(SHINGLE, np.uint64)))
        size = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, n_words > 0)
        text = np.repeat(np.arange(n), size)
        at = np.repeat(edges[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        rolled = np.zeros(len(code), np.uint64)
        for k in range(SHINGLE):
            rolled = rolled * _BASE + padded[k:k + len(code)]
        h = rolled[at]
        short = np.flatnonzero(n_words[text] < SHINGLE)
        left, h[short] = n_words[text[short]], 0
        for k in range(SHINGLE):
            h[short] = h[short] * _BASE + np.where(k < left, padded[at[short] + k], np.uint64(0))
        h = mix(h)
        order = by_text(text, h, n)
        text, h = text[order], h[order]
        new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | np.concatenate(([True], h[1:] != h[:-1])))
        self.n, self.text, self.hash = n, text[new], h[new]
        self.count = np.diff(np.append(new, len(h)))

    def weights(self, frequencies: Frequencies) -> np.ndarray:
        return self.count * frequencies.idf(self.hash)


class Frequencies:
    """Documents in all and, by sorted hash, the documents of shingles that more
    than one document has; copies are one document."""

    def __init__(self, total: int, hashes: np.ndarray, counts: np.ndarray):
        self.total = total
        self.hash, at = np.unique(hashes, return_index=True)
        self.n = counts[at]

    def counts(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.ones(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.n[at], 1)

    def idf(self, h: np.ndarray) -> np.ndarray:
        return idf(self.total, self.counts(h))


def idf(total: int, count: np.ndarray) -> np.ndarray:
    return np.log1p(max(1, total) / count)


def _blobs(x: np.ndarray, edges: np.ndarray) -> pa.Array:
    """x[edges[i]:edges[i + 1]] as binary values."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [
        None, pa.py_buffer(((edges - edges[0]) * x.itemsize).astype(np.int32)), pa.py_buffer(x[edges[0]:edges[-1]])])


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def spelled(text: Column) -> Column:
    """Equal for copies of a text: runs of ASCII characters that are neither letters
    nor digits are one space, and case is ignored where a text is all ASCII. Texts
    that are equal here have the same words."""
    case = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(text)
    return F.trim(F.regexp_replace(case, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))


def counted(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows of ``docs`` (_row, _t) whose texts are counted, one of all copies
    (_row); their number; and the bytes of all texts."""
    same = docs.withColumn("_s", spelled(F.col("_t"))).groupBy(F.xxhash64("_s").alias("s0"), F.xxhash64("_s", F.lit(1)).alias("s1"))
    firsts = stored(same.agg(F.min("_row").alias("_row"), F.sum(F.octet_length("_t").cast("long")).alias("bytes")).select("_row", "bytes"), "firsts")
    total, size = firsts.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return firsts.select("_row"), total, size


def parted(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` (_row, ...) dealt by ``part``; ``size`` is the bytes of all texts."""
    return docs.withColumn("part", F.pmod("_row", F.lit(max(1, size // PART)))).repartition("part")


def document_counts(parts: DataFrame, firsts: DataFrame, size: int) -> DataFrame:
    """(part, hash, n): shingles of each part of ``parts`` (part, _row, _t, ...) that
    more than one of the documents ``firsts`` (_row) has, and in how many; ``size`` is
    the bytes of all texts."""
    # ranges of some MB, more of them than tasks where texts are few
    ranges = max(1, min(size >> 17, 2048), size >> 22)
    sent_as = pa.schema([("range", pa.int64()), ("part", pa.int64()), ("hash", pa.binary()), ("n", pa.binary())])

    def sent(part: pa.Table, first: pa.Table) -> pa.Table:
        turn_of("near_dedup")
        out = [sent_as.empty_table()]
        # rows with the same id and text are one document, too
        row, at = np.unique(part["_row"].to_numpy(), return_index=True)
        at = np.sort(at[np.isin(row, first["_row"].to_numpy())])
        for batch in part.select(["part", "_t"]).take(pa.array(at)).combine_chunks().to_batches():
            for b in slices(iter([batch]), "_t"):
                h, n = np.unique(Shingles(b.column("_t"), keys=False).hash, return_counts=True)
                r = ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                cut = np.flatnonzero(np.diff(r, prepend=-1))
                edge = np.append(cut, len(r))
                out.append(pa.table([pa.array(r[cut]), pa.array(np.full(len(cut), b.column("part")[0].as_py(), np.int64)), _blobs(h, edge),
                                     _blobs(n.astype(np.uint32), edge)], schema=sent_as))
        return pa.concat_tables(out)

    def summed(group: pa.Table) -> pa.Table:
        turn_of("near_dedup")
        h, n = _joined(group["hash"], np.uint64), _joined(group["n"], np.uint32)
        size = pc.binary_length(group["hash"]).to_numpy() // 8
        _, own = np.unique(h, return_inverse=True)
        n = np.bincount(own, n)[own].astype(np.int64)
        several = n > 1
        left = np.bincount(np.repeat(np.arange(len(size)), size)[several], minlength=len(size))
        some = np.flatnonzero(left)
        at = np.append(0, np.cumsum(left[some]))
        return pa.table([group["part"].to_numpy()[some], _blobs(h[several], at), _blobs(n[several].astype(np.uint32), at)], names=["part", "hash", "n"])

    # all columns, so that this and the parts themselves are one shuffle
    own = parted(firsts, size)
    return (parts.groupBy("part").cogroup(own.groupBy("part")).applyInArrow(sent, "range long, part long, hash binary, n binary")
            .groupBy("range").applyInArrow(summed, "part long, hash binary, n binary"))


def inverse_frequencies(docs: DataFrame) -> Frequencies:
    """The document counts of all shingles of ``docs`` (_t) on the driver: for
    small tables only."""
    d = docs.withColumn("_row", F.xxhash64("_t"))
    firsts, total, size = counted(d)
    got = document_counts(parted(d, size), firsts, size).toArrow()
    return Frequencies(total, _joined(got["hash"], np.uint64), _joined(got["n"], np.uint32))


@functools.cache
def gamma_quantiles() -> np.ndarray:
    """Gamma(2, 1) at 65,536 equal steps of its distribution, 1 - (1 + x) exp(-x)."""
    u = (np.arange(65536) + 0.5) / 65536
    x = np.sqrt(2 * u) + u
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), x / 4)
    return x


def samples(h: np.ndarray, weight: np.ndarray, text: np.ndarray, n: int, k: int) -> np.ndarray:
    """[n, k] consistent weighted samples; texts without shingles get zeros.
    ``text`` is sorted."""
    gamma = gamma_quantiles()
    r_of, c_of = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
    out = np.zeros((n, k), np.uint64)
    first = np.searchsorted(text, np.arange(n + 1))
    log_w = np.log(weight).astype(np.float32)
    low = np.uint64(0xFFFF)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(first, first[at] + BLOCK, side="right")) - 1)
        some = np.arange(at, to)
        some = some[first[some + 1] > first[some]]
        a, b = first[at], first[to]
        if len(some):
            heads = first[some] - a
            sizes = first[some + 1] - first[some]
            own, lw = h[a:b], log_w[a:b]
            for j in range(k):
                x = mix(own + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                r = r_of[(x & low).astype(np.uint16)]
                c = c_of[(x >> np.uint64(16) & low).astype(np.uint16)]
                beta = (x >> np.uint64(40)).astype(np.float32) * np.float32(2.0 ** -24)
                t = np.floor(lw / r + beta)
                v = c - r * (t - beta + 1)
                least = np.minimum.reduceat(v, heads)
                hit = np.flatnonzero(v == np.repeat(least, sizes))
                pick = hit[np.searchsorted(hit, heads)]
                out[some, j] = mix(own[pick] ^ mix(t[pick].astype(np.int64).astype(np.uint64) + np.uint64(j)))
        at = to
    return out


def bands(samples_: Column) -> Column:
    """Band hashes of a sample array; bands of different places differ."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                       lambda i: F.xxhash64(i, F.slice(samples_, i * ROWS + 1, F.lit(ROWS))))


def least_agreeing(threshold: float) -> int:
    """Fewer equal samples than this have a probability of MISS at most in a pair
    of similarity ``threshold``."""
    n, below = ROWS * BANDS, 0.0
    for k in range(n):
        below += math.comb(n, k) * threshold ** k * (1 - threshold) ** (n - k)
        if below > MISS:
            return k
    return n


def agreeing(a: Column, b: Column) -> Column:
    """Number of equal samples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))


def _signed(total: int, id_type: pa.DataType) -> Callable:
    schema = pa.schema([("doc_id", id_type), ("row", pa.int64()), ("key", pa.binary()), ("samples", pa.list_(pa.int32())),
                        ("counts", pa.binary())])

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        turn_of("near_dedup")
        known = Frequencies(total, _joined(counts["hash"], np.uint64), _joined(counts["n"], np.uint32))
        out = []
        for b in slices(iter(docs.combine_chunks().to_batches()), "_t"):
            s = Shingles(b.column("_t"))
            n = known.counts(s.hash)
            sig = (samples(s.hash, s.count * idf(total, n), s.text, s.n, ROWS * BANDS) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            has = np.zeros(s.n, bool)
            has[s.text] = True
            flat = sig[has].ravel()
            offsets = np.concatenate(([0], np.cumsum(np.where(has, ROWS * BANDS, 0))))
            out.append(pa.record_batch([b.column("doc_id").cast(id_type), b.column("_row"), pa.array(s.keys, pa.binary()),
                                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
                                        _blobs(n.astype(np.uint32), np.searchsorted(s.text, np.arange(s.n + 1)))], schema=schema))
        return pa.Table.from_batches(out, schema)
    return run


def similarities(a: pa.Array, b: pa.Array, na: np.ndarray, nb: np.ndarray, total: int) -> np.ndarray:
    """Weighted Jaccard similarity of each a[i] and b[i]; ``na`` and ``nb`` are the
    document counts of their shingles, in the order of Shingles."""
    x, y = Shingles(a, keys=False), Shingles(b, keys=False)
    text, h = np.concatenate((x.text, y.text)), np.concatenate((x.hash, y.hash))
    w = np.concatenate((x.count * idf(total, na), y.count * idf(total, nb)))
    order = np.lexsort((h, text))
    text, h, w = text[order], h[order], w[order]
    sums = np.bincount(text, w, x.n)
    pair = np.flatnonzero((text[1:] == text[:-1]) & (h[1:] == h[:-1]))
    both = np.bincount(text[pair], np.minimum(w[pair], w[pair + 1]), x.n)
    return np.where(sums > 0, both / np.maximum(sums - both, 1e-12), 1.0)


def _verified(total: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_of("near_dedup")
        for b in slices(batches, "ta"):
            s = similarities(b.column("ta"), b.column("tb"), _joined(b.column("na"), np.uint32), _joined(b.column("nb"), np.uint32), total)
            yield b.select(["a", "b"]).filter(pa.array(s >= threshold - 1e-9))
    return run


def rarest(hashes: np.ndarray, counts: np.ndarray, weights: np.ndarray, text: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Places of the shingles of which two texts of similarity ``threshold`` share
    one: in order of document count those before whose end ``threshold`` of the
    text's weight is left, but for those of one document. ``text`` is sorted."""
    return rarest_left(hashes, counts, weights, text, n, threshold)[0]


def rarest_left(hashes: np.ndarray, counts: np.ndarray, weights: np.ndarray, text: np.ndarray, n: int,
                threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of :func:`rarest`, the weight that is left there, and the texts' weights."""
    order = np.lexsort((hashes, counts, text))
    t, w = text[order], weights[order]
    total = np.bincount(t, w, n)
    # what is left with this shingle, summed from a text's end
    ends = np.cumsum(w[::-1])[::-1]
    after = np.append(ends, 0.0)[np.searchsorted(t, np.arange(n), side="right")]
    left = ends - after[t]
    some = (left >= (threshold - 1e-6) * total[t]) & (counts[order] > 1)
    return order[some], left[some], total


def _rare(total: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_of("near_dedup")
        for b in slices(batches, "text"):
            s, n = Shingles(b.column("text"), keys=False), _joined(b.column("counts"), np.uint32)
            at, left, weight = rarest_left(s.hash, n, s.count * idf(total, n), s.text, s.n, threshold)
            own = weight[s.text[at]]
            # a link shares threshold / (1 + threshold) of both weights together, all
            # of it from here on where this is the rarest shingle that both have
            room = left * ((1 + 1e-6) * (1 + threshold) / threshold) - own
            yield pa.record_batch([pa.array(s.hash[at].view(np.int64)), b.column("key").take(pa.array(s.text[at])), pa.array(own), pa.array(room)],
                                  names=["band", "key", "weight", "room"])
    return run


def _open(m: DataFrame) -> DataFrame:
    """The rows of ``m`` in buckets that have nodes of two classes, and a pivot: of
    a link's nodes at least the lighter one has room for a node of its own weight."""
    open_ = m.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max(F.col("room") >= F.col("weight")).alias("z"))
    return m.join(open_.where(F.col("z") & (F.col("x") != F.col("y"))).select("band"), "band")


def _refined(m: DataFrame, texts: DataFrame, total: int, threshold: float) -> DataFrame:
    """``m`` (band, key, weight, room, label, size) with the nodes of hot buckets
    dealt by rare shingles instead."""
    hot = m.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("band")
    of_hot = stored(m.join(hot, "band", "left_semi").select("key", "label", "size").distinct(), "hot")
    rare = stored(texts.join(of_hot, "key", "left_semi").select("key", "text", "counts")
                       .mapInArrow(_rare(total, threshold), "band long, key binary, weight double, room double").join(of_hot, "key"), "rare")
    return stored(m.join(hot, "band", "left_anti").unionByName(_open(_merged(rare)).select(*m.columns)), "members")


def _merged(rare: DataFrame) -> DataFrame:
    """Buckets of ``rare`` with the same nodes are one (the shingles of a passage); a
    node has the most room that one of them gives it."""
    x = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"x{i}") for i in range(2)]
    same = rare.groupBy("band").agg(F.count("*").alias("x2"), *x)
    least = same.withColumn("least", F.min("band").over(Window.partitionBy("x0", "x1", "x2"))).select("band", "least")
    return (rare.join(least, "band").groupBy(F.col("least").alias("band"), "key")
                .agg(*[F.first(c).alias(c) for c in ("weight", "label", "size")], F.max("room").alias("room")))


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node of each node's component, for the nodes of
    ``links`` (a, b). ``labels`` of earlier links are starting values."""
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    now = edges.select(F.col("a").alias("node")).distinct()
    now = now.withColumn("label", F.col("node")) if labels is None else (
        now.join(labels, "node", "full").select("node", F.coalesce("label", "node").alias("label")))
    now = stored(now, "labels")
    while True:
        near = (edges.join(now.select(F.col("node").alias("b"), "label"), "b")
                     .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        least = now.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("to"))
        # what a label's own node was moved to moves all nodes of that label
        moved = least.where(F.col("label") != F.col("to")).groupBy("label").agg(F.min("to").alias("all_to"))
        step = stored(least.join(moved, "label", "left").select(
            "node", "label", F.least("to", F.coalesce("all_to", "to")).alias("to")), "labels")
        changed = step.where(F.col("to") != F.col("label")).limit(1).count()
        discard(now)
        now = stored(step.select("node", F.col("to").alias("label")), "labels") if changed else step.select("node", "label")
        if not changed:
            discard(edges)
            return now
        discard(step)


def _links(buckets: DataFrame, nodes: DataFrame, texts: DataFrame, total: int, threshold: float) -> DataFrame | None:
    """(node, label) of all nodes with a link, from ``buckets`` (band, key),
    ``nodes`` (key, shares, samples) and ``texts`` (key, text, counts)."""
    labels, links, compared = None, None, None
    # only rare shingles tell what a partner may weigh
    left, some = buckets.withColumns({"weight": F.lit(0.0), "room": F.lit(math.inf)}), PIVOTS
    while True:
        if labels is None:
            m = left.join(nodes.select("key", "shares"), "key").select(*left.columns, F.col("key").alias("label"), (-F.col("shares")).alias("size"))
        else:
            size = labels.groupBy("label").agg(F.count("*").alias("size"))
            own = labels.join(size, "label").withColumnRenamed("node", "key")
            m = left.join(own, "key", "left").select(*left.columns, F.coalesce("label", "key").alias("label"),
                                                    F.coalesce("size", F.lit(1)).alias("size"))
        m = stored(_open(m), "members")
        if some == PIVOTS * GROWTH:
            m = _refined(m, texts, total, threshold)
        order = Window.partitionBy("band").orderBy(F.col("weight") - F.col("room"), "size", "key")
        pivots = stored(m.where(F.col("room") >= F.col("weight")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= some)
                         .select("band", F.col("key").alias("p"), F.col("label").alias("pl"), F.col("weight").alias("pw"), F.col("room").alias("pr")), "pivots")
        if not pivots.limit(1).count():
            return labels
        fits = (F.col("weight") <= F.col("pr")) & (F.col("pw") <= F.col("room"))
        pairs = (m.join(pivots, "band").where((F.col("label") != F.col("pl")) & fits)
                  .select(F.least("key", "p").alias("a"), F.greatest("key", "p").alias("b")).distinct())
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        compared = pairs if compared is None else compared.unionByName(pairs)
        samples_ = lambda c: nodes.select(F.col("key").alias(c), F.col("samples").alias(f"s{c}"))
        likely = (pairs.join(samples_("a"), "a").join(samples_("b"), "b")
                       .where(agreeing(F.col("sa"), F.col("sb")) >= least_agreeing(threshold)).select("a", "b"))
        text_ = lambda c: texts.select(F.col("key").alias(c), F.col("text").alias(f"t{c}"), F.col("counts").alias(f"n{c}"))
        with_text = likely.join(text_("a"), "a").join(text_("b"), "b")
        found = stored(with_text.select("a", "b", "ta", "tb", "na", "nb").mapInArrow(_verified(total, threshold), "a binary, b binary"), "links")
        links = found if links is None else links.unionByName(found)
        if found.limit(1).count():
            labels = components(links, labels)
        gone = pivots.select("band", F.col("p").alias("key"))
        left = m.select("band", "key", "weight", "room").join(gone, ["band", "key"], "left_anti")
        some *= GROWTH


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, label) of every row; rows with the same label are near
    duplicates. ``row`` tells rows with the same id apart."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema[id_col].dataType
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_t")).withColumn("_row", row_key("doc_id", "_t"))
    firsts, total, size = counted(d)
    parts = parted(d, size)
    signed = stored(parts.groupBy("part").cogroup(document_counts(parts, firsts, size).groupBy("part")).applyInArrow(
        _signed(total, to_arrow_type(kind)),
        f"doc_id {kind.simpleString()}, row long, key binary, samples array<int>, counts binary"), "signed")
    nodes = signed.groupBy("key").agg(F.min_by(F.struct("doc_id", "row", "samples"), F.struct("row")).alias("n")).select("key", "n.*")
    banded = nodes.where(F.size("samples") > 0).select("key", F.explode(bands(F.col("samples"))).alias("band"))
    shared = banded.groupBy("band").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("band")
    buckets = stored(banded.join(shared, "band"), "buckets")
    middle = stored(buckets.groupBy("key").agg(F.count("*").alias("shares")).join(nodes.select("key", "samples"), "key"), "candidates")
    wanted = nodes.join(middle, "key", "left_semi").select("key", F.col("doc_id").alias("i"), F.col("row").alias("r"))
    texts = (d.join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("_row") == F.col("r")))
              .groupBy("key").agg(F.first("_t").alias("text")))
    # texts with the same words have the same counts
    counts = (signed.select("key", "row", "counts").join(wanted.select("key", F.col("r").alias("row")), ["key", "row"])
                    .groupBy("key").agg(F.first("counts").alias("counts")))
    texts = stored(texts.join(counts, "key"), "texts")
    labels = _links(buckets, middle, texts, total, threshold)
    out = signed.select("doc_id", "row", "key")
    if labels is None:
        return out.select("doc_id", "row", F.col("key").alias("label"))
    return out.join(labels.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "row", F.coalesce("label", "key").alias("label"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id): the class id is the smallest document id of the class."""
    c = stored(classes(docs, threshold), "classes")
    least = c.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return c.join(least, "label").select("doc_id", "class_id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, one of each class: that with the smallest id."""
    c = classes(docs, threshold)
    best = c.groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("b")).select(
        F.col("b.doc_id").alias("_i"), F.col("b.row").alias("_r"))
    d = docs.select(packed(docs), F.col("doc_id").alias("_id"), F.xxhash64(F.col("doc_id"), text_or_empty("text")).alias("_key"))
    kept = d.join(best, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_r")))
    # of rows that agree in id and text, one
    nth = F.row_number().over(Window.partitionBy("_i", "_r").orderBy("_r"))
    return kept.withColumn("_nth", nth).where("_nth = 1").select("_row.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
