"""Document fingerprints by improbable features.

Every WINDOW bytes of a text are a feature. Its rank comes from its entropy: how
rare that entropy (in LEVELS steps) is among all windows of all documents, rarest
first; windows of hardly any entropy come last. Of every RUN consecutive features
the best-ranked (leftmost of equals) gets a point, and features with POINTS points
are selected (in a short text, those with the most). Distinct selected features
enter a chain of Bloom filters (BITS bits, five bits each, FEATURES per filter).
Two fingerprints are compared filter by filter: the overlap of set bits, less what
chance gives, over what is possible; each filter of the shorter chain takes its
best partner, and the likeness is the mean.

The rarity table is one aggregation over all documents; it has LEVELS + 1 numbers.
For the pairs of neighbours, documents are dealt by ranges of their ids whose
bounds are ids that exist (as many as shuffle partitions, times four), and the
document at a bound goes to the range before it, too. Texts move once, tasks read
their sorted rows as a stream, and hold a few MB of text at a time.

Defined results: a null text is empty. An empty text has the empty fingerprint,
which is like another empty one (1.0) and unlike any other (0.0). A text shorter
than a window is one feature, padded with zero bytes. Null ids come first; rows
with the same id follow each other by text. In a table of one row the next
document is the row itself. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_width, slices, table, text_or_empty

WINDOW = 32
LEVELS = 1000
LOW = 150                  # levels below come last
RUN = 32
POINTS = 8
BITS = 2048
FEATURES = 160
SEGMENT = 1 << 19          # window starts handled at once
_SLICE = 2 << 20

# c log2 c in fixed point, for the count c of a byte value in a window
_TERM = np.round(np.arange(WINDOW + 1) * np.log2(np.maximum(1, np.arange(WINDOW + 1))) * (1 << 20)).astype(np.int64)
_GROWS = np.diff(_TERM, append=_TERM[-1])
_FULL = int(_TERM[WINDOW])
_LAST_RANK = np.int64(LEVELS + 1)


def levels(buf: np.ndarray, start: int, end: int) -> np.ndarray:
    """Entropy level, 0 to LEVELS, of the windows that begin in [start, end);
    ``buf`` reaches WINDOW bytes further."""
    part = buf[start:end + WINDOW]
    after = np.zeros(len(part), np.uint8)      # equal bytes among the next WINDOW - 1
    before = np.zeros(len(part), np.uint8)     # and among the WINDOW - 1 before
    for d in range(1, WINDOW):
        same = (part[:-d] == part[d:]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    n = end - start
    step = _GROWS[before[WINDOW:WINDOW + n]] - _GROWS[after[:n]]
    first = int(_TERM[np.bincount(part[:WINDOW], minlength=256)].sum())
    s = np.empty(n, np.int64)
    s[0] = first
    np.cumsum(step[:-1], out=s[1:])
    s[1:] += first
    return ((_FULL - s) * LEVELS // _FULL).astype(np.int16)


class Texts:
    """Texts of a slice in one buffer, with room between them."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.features = np.where(self.sizes > 0, np.maximum(1, self.sizes - WINDOW + 1), 0)
        room = np.maximum(self.sizes, WINDOW) + RUN
        self.begin = np.concatenate(([0], np.cumsum(room)))
        self.buf = np.zeros(int(self.begin[-1]) + 2 * (WINDOW + RUN), np.uint8)
        for t, b in zip(texts, self.begin.tolist(), strict=False):
            self.buf[b:b + len(t)] = np.frombuffer(t, np.uint8)
        self.valid = np.zeros(len(self.buf), bool)
        for b, n in zip(self.begin.tolist(), self.features.tolist(), strict=False):
            self.valid[b:b + n] = True

    def segments(self) -> Iterator[tuple[int, int]]:
        for s in range(0, int(self.begin[-1]), SEGMENT):
            yield s, min(int(self.begin[-1]), s + SEGMENT)

    def counts(self) -> np.ndarray:
        out = np.zeros(LEVELS + 1, np.int64)
        for s, e in self.segments():
            out += np.bincount(levels(self.buf, s, e)[self.valid[s:e]], minlength=LEVELS + 1)
        return out

    def selected(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, position) of the selected features, in order."""
        points = np.zeros(len(self.buf), np.int32)
        for s, e in self.segments():
            reach = min(e + RUN, len(self.buf) - WINDOW)
            key = np.where(self.valid[s:reach], rank[levels(self.buf, s, reach)], _LAST_RANK) << 32
            key += np.arange(reach - s)
            best, w = key, 1
            while w < RUN:                       # minima of 2, 4, ... consecutive features
                best = np.minimum(best[:-w], best[w:])
                w *= 2
            at = (best[:e - s] & 0xFFFFFFFF)[self.valid[s:s + len(best[:e - s])]]
            got = np.bincount(at, minlength=reach - s)
            points[s:s + len(got)] += got.astype(np.int32)
        some = np.flatnonzero(points)
        text = np.searchsorted(self.begin, some, side="right") - 1
        most = np.zeros(len(self.sizes), np.int32)
        np.maximum.at(most, text, points[some])
        keep = points[some] >= np.minimum(POINTS, most[text])
        return text[keep], some[keep]

    def digests(self, rank: np.ndarray) -> list[np.ndarray]:
        """The Bloom filters of each text, one row of bytes a filter."""
        text, at = self.selected(rank)
        hashes = np.empty(len(at), np.uint64)
        for x in range(0, len(at), 100_000):
            rows = self.buf[at[x:x + 100_000, None] + np.arange(WINDOW)]
            hashes[x:x + 100_000] = feature_hash(rows)
        order = np.lexsort((at, hashes, text))
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(text[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])
        keep = np.sort(order[new])               # the first of equal features of a text
        text, hashes = text[keep], hashes[keep]
        first = np.searchsorted(text, np.arange(len(self.sizes) + 1))
        filters = -(-np.diff(first) // FEATURES)
        base = np.concatenate(([0], np.cumsum(filters)))
        row = base[text] + (np.arange(len(text)) - first[text]) // FEATURES
        bits = np.zeros((int(base[-1]), BITS), bool)
        for k in range(5):
            bits[row, ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        packed = np.packbits(bits, axis=1)
        return [packed[base[i]:base[i + 1]] for i in range(len(self.sizes))]


def feature_hash(rows: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(rows).view("<u8")
    h = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(words.shape[1]):
        h = (h ^ words[:, i]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(29)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two chains of filters, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    own, other = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    if len(a) < len(b):
        return float(np.mean(_best(a, own, b, other)))
    return float((np.mean(_best(a, own, b, other)) + np.mean(_best(b, other, a, own))) / 2)


def _best(a, own, b, other) -> list[float]:
    out = []
    for x, n in zip(a, own.tolist(), strict=True):
        both = np.bitwise_count(x & b).sum(axis=1, dtype=np.int64)
        chance = n * other / BITS
        most = np.minimum(n, other)
        s = np.where(most > chance, (both - chance) / np.maximum(most - chance, 1e-9), both == most)
        out.append(float(np.clip(s.max(), 0.0, 1.0)))
    return out


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy level by its number of windows in all texts of
    ``docs`` (_t), rarest first, low levels last."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for b in slices(batches, "_t", _SLICE):
            total += Texts([t.encode() for t in b.column("_t").to_pylist()]).counts()
        yield pa.record_batch([pa.array(np.arange(LEVELS + 1)), pa.array(total)], names=["level", "n"])

    n = np.zeros(LEVELS + 1, np.int64)
    for level, k in docs.select("_t").mapInArrow(counted, "level long, n long").groupBy("level").agg(F.sum("n")).collect():
        n[level] = k
    order = np.lexsort((np.arange(LEVELS + 1), n, np.arange(LEVELS + 1) < LOW))
    rank = np.empty(LEVELS + 1, np.int64)
    rank[order] = np.arange(LEVELS + 1)
    return rank


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


SCHEMA = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
          " near_edited double, near_next double")


def _neighbours(rank: np.ndarray, id_type: pa.DataType) -> Callable:
    schema = pa.schema([("doc_id", id_type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []                  # the row whose next one hasn't come yet
        for b in slices(batches, "_t", _SLICE):
            rows = held + list(zip(*(b.column(c).to_pylist() for c in ("_part", "_copy", "doc_id", "_t")), strict=True))
            held = rows[-1:]
            # a copy ends its range; it has no row of its own
            pairs = [i for i in range(len(rows) - 1) if not rows[i][1]]
            if not pairs:
                continue
            texts = [r[3] for r in rows]
            changed = [edited(texts[i], texts[i + 1]).encode() for i in pairs]
            plain = Texts([t.encode() for t in texts]).digests(rank)
            other = Texts(changed).digests(rank)
            yield pa.record_batch([
                pa.array([rows[i][2] for i in pairs], id_type), pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in changed]),
                pa.array([plain[i].tobytes().hex() for i in pairs]), pa.array([x.tobytes().hex() for x in other]),
                pa.array([likeness(plain[i], x) for i, x in zip(pairs, other, strict=True)]),
                pa.array([likeness(plain[i], plain[i + 1]) for i in pairs])], schema=schema)
    return run


def _range_bounds(docs: DataFrame, parts: int) -> list[int]:
    """Ids that begin the ranges: the smallest, and quantiles (ids that exist)."""
    step = [i / parts for i in range(parts)]
    row = docs.agg(F.min("_o").alias("low"), F.percentile_approx("_o", step, 10 * max(1000, parts)).alias("q")).first()
    return sorted({row.low, *(row.q or [])} - {None})


def _range_of(bounds: list[int]):
    """Number of the range of ``_o``: a search over coarse bounds, then fine ones."""
    width = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[::width]
    fine = F.array(*[F.array(*[F.lit(x) for x in bounds[i:i + width]]) for i in range(0, len(bounds), width)])
    block = F.size(F.filter(F.array(*[F.lit(x) for x in coarse]), lambda x: x <= F.col("_o"))) - 1
    return block, lambda b: b * width + F.size(F.filter(F.element_at(fine, b + 1), lambda x: x <= F.col("_o"))) - 1


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint and that of its edited text, their likeness,
    and the likeness to the next document."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema[id_col].dataType
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_t"),
                    F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_o"))
    width = shuffle_width(docs.sparkSession)
    bounds = _range_bounds(d, 4 * width)
    if not bounds:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind.simpleString()}, {SCHEMA}")
    rank = rarity(d)
    block, number = _range_of(bounds)
    d = d.withColumn("_b", block).withColumn("_part", number(F.col("_b")))
    at_bound = F.col("_o") == F.element_at(F.array(*[F.lit(x) for x in bounds]), F.col("_part") + 1)
    copies = F.when(F.col("_o") == bounds[0], F.array(F.lit(len(bounds) - 1))).when(at_bound, F.array(F.col("_part") - 1))
    places = F.array_union(
        F.array(F.struct(F.col("_part"), F.lit(False).alias("_copy"))),
        F.coalesce(F.transform(copies, lambda p: F.struct(p.alias("_part"), F.lit(True).alias("_copy"))),
                   F.array().cast("array<struct<_part:int,_copy:boolean>>")))
    dealt = (d.select("doc_id", "_t", "_o", F.explode(places).alias("p"))
              .select("doc_id", "_t", "_o", "p._part", "p._copy")
              .repartition(width, "_part").sortWithinPartitions("_part", "_copy", "_o", "_t"))
    return dealt.select("_part", "_copy", "doc_id", "_t").mapInArrow(
        _neighbours(rank, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, {SCHEMA}")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
