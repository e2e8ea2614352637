"""Best-fit packing with certified bin counts.

Documents become pieces: the token ids of a text and an end id, cut only where
they are longer than a sequence. Full pieces are sequences of their own. The rest
is bin packing in rounds:

* Round 0 deals the pieces to partitions by a hash and packs each by best-fit
  decreasing.
* A dual-feasible function maps item sizes to [0, 1] such that no feasible bin
  sums above 1; the sum over the items, rounded up, bounds the number of bins from
  below. Each partition's bin count is set against the best of several such bounds.
* A partition whose count equals its bound, with no room left in its bins, is
  certified and final. The others have a gap between their count and the bound
  before rounding: they keep their well-filled bins, and the items of their other
  bins are exchanged: dealt anew to fewer, mixed partitions and packed again.

Every round passes on only the badly filled bins, to as many partitions as keep
about PER_PARTITION items each, so no task ever holds more than a bounded number of
items. The rounds end when one partition is left or a round frees less than WORTH of
the bins that it was given.

Token ids come from the tokenizer file itself. White space separates its tokens,
so texts are cut at spaces by Arrow and only the distinct chunks of a slice run
the tokenizer; words of common letters are remembered by a task.

Defined results: a null or empty text is one piece, the end id alone. Repeated
rows are packed one by one; null ids stay null. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keeps, slices, stored, table, text_or_empty, turn_of

CAPACITY = 4096
END_ID = 1
PER_PARTITION = 20_000      # items of a packing partition
KEPT_FILL = 0.995           # bins filled less than this are exchanged
CHUNKS = 800_000            # chunks whose ids a worker keeps
READ = 8 << 20              # bytes of text read at once
WORTH = 0.001               # share of the exchanged bins that a round must free to be followed by another

# Fixed value: letters that NFC leaves alone and whose lower case is one letter.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]?)")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others
    for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in plain]
    return {**{x: chr(x) for x in plain}, **{x: chr(256 + i) for i, x in enumerate(rest)}}


class ChunkIds:
    """Ids of space-delimited chunks by a tokenizer that drops white space. The
    ids of chunks seen lie one after the other in ``flat``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.t = Tokenizer.from_file(path)
        self.t.no_padding()
        self.t.no_truncation()
        self.letters = {x: ord(c) for x, c in byte_letters().items()}
        self.marks = {m: list(self.t.encode(m, add_special_tokens=False).ids) for m in ".,!?;:"}
        self.marks[""] = []
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        fresh: dict[str, list[int]] = {}
        odd: list[str] = []
        plain, model, letters, marks = _PLAIN.fullmatch, self.t.model.tokenize, self.letters, self.marks
        for c in chunks:
            m = plain(c)
            if m is None:
                odd.append(c)
                continue
            w, mark = m.groups()
            w = w.lower()
            # a word of plain letters is one pre-token, so the model alone gives its ids
            ids = fresh.get(w)
            if ids is None:
                at = self.place.get(w) if w != c else None
                if at is not None:
                    ids = self.flat[self.start[at]:self.start[at + 1]].tolist()
                else:
                    ids = fresh[w] = [x.id for x in model(w if w.isascii() else w.encode().decode("latin-1").translate(letters))]
            if w != c:
                fresh[c] = ids + marks[mark] if mark else ids
        fresh.update((c, e.ids) for c, e in zip(odd, self.t.encode_batch(odd, add_special_tokens=False), strict=True))
        at = len(self.place)
        self.place.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        size = np.fromiter(map(len, fresh.values()), np.int64, len(fresh))
        more = np.fromiter(itertools.chain.from_iterable(fresh.values()), np.uint32, int(size.sum()))
        self.flat = np.concatenate((self.flat, more))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(size)))

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each chunk begin and end in ``flat``."""
        if len(self.place) > CHUNKS:
            self._forget()
        self._learn([c for c in chunks if c not in self.place])
        at = np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))
        return self.start[at], self.start[at + 1]


@functools.lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


keeps("packing", chunk_ids.cache_clear)


def text_ids(texts: pa.Array, ids: ChunkIds) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a slice of texts, and where each text's ids begin (one more at the end)."""
    cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    chunk = cut.flatten().dictionary_encode()
    start, end = ids(chunk.dictionary.to_pylist())
    at = chunk.indices.to_numpy()
    n = (end - start)[at]
    edge = np.concatenate(([0], np.cumsum(n)))
    out = ids.flat[np.repeat(start[at] - edge[:-1], n) + np.arange(edge[-1])]
    places = cut.offsets.to_numpy()
    return out, edge[places - places[0]]


def _pieces(path: str, capacity: int, end_id: int, id_type: pa.DataType) -> Callable:
    schema = pa.schema([("doc_id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_of("packing")
        ids = chunk_ids(path)
        tail = np.array([end_id], "<u4").tobytes()
        for b in slices(batches, limit=READ):
            flat, edge = text_ids(b.column("text"), ids)
            n = np.diff(edge) + 1
            k = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), k)
            piece = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            raw = memoryview(np.ascontiguousarray(flat, "<u4").tobytes())
            crc = np.empty(len(doc), np.int64)
            last = start + length == n[doc]
            lo = (edge[doc] + start) * 4
            hi = lo + (length - last) * 4
            for i, (x, y, z) in enumerate(zip(lo.tolist(), hi.tolist(), last.tolist(), strict=True)):
                c = zlib.crc32(raw[x:y])
                crc[i] = zlib.crc32(tail, c) if z else c
            yield pa.record_batch([b.column("doc_id").cast(id_type).take(pa.array(doc)), pa.array(piece, pa.int32()),
                                   pa.array(start), pa.array(length), pa.array(crc)], schema=schema)
    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema[id_col].dataType
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return d.mapInArrow(_pieces(path, capacity, end_id, to_arrow_type(kind)),
                        f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, capacity: int) -> float:
    """Bins that any packing of ``sizes`` needs at least (rounded up, a certified
    count): the best of the plain sum bound and the dual-feasible functions f_e
    (0 below e, 1 above C - e, else x / C) and u_k (x (k + 1) / C rounded down,
    over k; x / C where that is whole)."""
    if not len(sizes):
        return 0.0
    x = np.sort(sizes.astype(np.int64))
    best = x.sum() / capacity
    total = np.concatenate(([0], np.cumsum(x)))
    half = np.unique(x[2 * x <= capacity])
    lo = np.searchsorted(x, half)                              # items below e
    hi = np.searchsorted(x, capacity - half, side="right")     # items above C - e
    if len(half):
        best = max(best, float((len(x) - hi + (total[hi] - total[lo]) / capacity).max()))
    best = max(best, float((2 * x > capacity).sum()))
    for k in range(1, 21):
        whole = (x * (k + 1)) % capacity == 0
        scaled = np.where(whole, x * k, (x * (k + 1)) // capacity * capacity)   # times C k
        best = max(best, scaled.sum() / (capacity * k))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, fill of each bin): items in falling size, each to the
    fullest bin with room."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    gaps: list[int] = []                     # rising gaps of open bins
    by_gap: dict[int, list[int]] = {}
    fill: list[int] = []
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        j = bisect_left(gaps, s)
        if j == len(gaps):
            b, left = len(fill), capacity - s
            fill.append(s)
        else:
            gap = gaps[j]
            same = by_gap[gap]
            b = same.pop()
            if not same:
                del by_gap[gap], gaps[j]
            left = gap - s
            fill[b] += s
        out[i] = b
        if left:
            if left in by_gap:
                by_gap[left].append(b)
            else:
                by_gap[left] = [b]
                insort(gaps, left)
    return out, np.array(fill, np.int64)


def _pack(capacity: int, round_: int) -> Callable:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True], ignore_index=True)
        sizes = pdf["length"].to_numpy(np.int64)
        bin_, fill = best_fit_decreasing(sizes, capacity)
        order = np.argsort(bin_, kind="stable")
        first = np.concatenate(([0], np.cumsum(sizes[order])))[:-1]
        offset = np.empty(len(sizes), np.int64)
        begin = np.concatenate(([0], np.cumsum(fill)))[:-1]
        offset[order] = first - begin[bin_[order]]
        bound = lower_bound(sizes, capacity)
        pdf["sequence_id"] = (round_ + 1 << 48) + (int(key[0]) << 24) + bin_
        pdf["offset"] = offset
        pdf["fill"] = fill[bin_]
        pdf["gap"] = len(fill) - bound
        return pdf
    return run


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """Pack pieces (doc_id, piece, start, length, ids_crc32) into sequences of
    ``capacity``; adds sequence_id and offset."""
    spark = items.sparkSession
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = dict(items.dtypes)["doc_id"]
    schema = (f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, sequence_id long,"
              " offset long, fill long, gap double")
    small = items.where(F.col("length") < capacity)
    full = items.where(F.col("length") >= capacity)
    # a full piece is a sequence of its own
    done = [full.select(*cols, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rows = small.count()
    parts = max(1, math.ceil(rows / per_partition))
    round_, given = 0, None
    while True:
        dealt = small.select(*cols, F.pmod(F.xxhash64(F.lit(round_), "doc_id", "piece", "ids_crc32", "length"), F.lit(parts)).alias("part"))
        packed = stored(dealt.groupBy("part").applyInPandas(_pack(capacity, round_), schema), f"packed{round_}")
        open_ = (F.col("gap") > 0) & (F.col("fill") < F.lit(int(KEPT_FILL * capacity)))
        first = F.col("offset") == 0           # one item of each bin
        n = packed.agg(F.count_if(first).alias("bins"), F.count_if(first & open_).alias("open"), F.count_if(open_).alias("rows")).first()
        if parts == 1 or n["open"] < 2 or (given is not None and given - n["bins"] <= WORTH * given):
            done.append(packed.select(*cols, "sequence_id", "offset"))
            break
        done.append(packed.where(~open_).select(*cols, "sequence_id", "offset"))
        small, given, round_ = packed.where(open_), n["open"], round_ + 1
        parts = max(1, math.ceil(n["rows"] / per_partition))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers
    items = stored(pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return pack(items)


