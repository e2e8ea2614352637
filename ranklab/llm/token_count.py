"""Token counts without materialising ids.

A byte-level BPE tokenizer cuts a text into pre-tokens and merges only inside
them, so the number of tokens of a text is the sum over its distinct pre-tokens
of frequency times number of pieces. The job has three steps:

1. Map: blocks of documents become rows (pre-token, block, documents of the block
   with their frequencies). Texts are split at spaces by Arrow; only the distinct
   space-delimited chunks of a block run the pre-token expression.
2. The frequencies are dealt by pre-token, so that a task meets each of its
   pre-tokens in all blocks, counts the pieces once per distinct pre-token and
   joins the count to the frequencies. A pre-token that many
   documents of a block share is dealt by (pre-token, block) instead, so no task
   gathers a word that every document holds; such pre-tokens are few.
3. Frequency times pieces is summed per document, with partial sums per task.

Defined results: a null or empty text has 0 bytes and 0 tokens. Special strings
inside texts count as the tokenizer's default has them (one token). Repeated rows
are counted one by one; null ids stay null. Extra columns are ignored, whatever
their names. A very long text is a block of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_width, slices, table, text_or_empty

LIMIT = 512                 # tokens above which over_limit is set
DOC_BITS = 12               # documents of a block: 4096 at most
MAX_FREQ = 1 << 18          # a higher frequency takes several entries
SPREAD = 16                 # documents of a block above which a pre-token is dealt by block too
CACHE = 1_000_000           # pre-tokens whose counts a task keeps
BLOCK_BYTES = 16 << 20

# The byte-level pre-token expression, and white space as Unicode has it.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# White space runs across a space, where cutting at single spaces would change pre-tokens.
_RUNS = rf"{_WS} {_WS}|{_WS} $|  "
# Characters whose class is the same in every Unicode version at hand.
_NEWER = r"[^\x00-\x{557}\x{2000}-\x{206f}]"            # for Arrow
NEWER = regex.compile("[^\x00-\u0557\u2000-\u206f]")   # the same for Python


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    if t.normalizer is not None or "ByteLevel" not in str(t.pre_tokenizer) or t.truncation or t.padding:
        raise ValueError(f"{path}: a byte-level tokenizer without normalizer is needed")
    specials = sorted((x.content for x in t.get_added_tokens_decoder().values()), key=len, reverse=True)
    return t, specials


def _pieces(t, specials: list[str], words: list[str]) -> list[int]:
    """Number of tokens of each pre-token."""
    odd = {w for w in words if w in specials}
    out: list[int] = []
    for i in range(0, len(words), 4096):
        part = words[i:i + 4096]
        n = np.zeros(len(part), np.int64)
        e = t.encode(part, is_pretokenized=True, add_special_tokens=False)
        np.add.at(n, np.array([w for w in e.word_ids if w is not None], np.int64), 1)
        out += [1 if w in odd else int(k) for w, k in zip(part, n, strict=True)]
    return out


def _whole(text: str, t, specials: list[str], find: Callable) -> list[str]:
    """Pre-tokens of one text that is not cut at spaces."""
    parts = [text]
    if specials and any(s in text for s in specials):
        parts = regex.split("(" + "|".join(map(regex.escape, specials)) + ")", text)
    out: list[str] = []
    for p in parts:
        if p in specials:
            out.append(p)
        elif NEWER.search(p):
            out += [p[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(p)]
        else:
            out += find(p)
    return out


def _frequencies(path: str, id_type: pa.DataType) -> Callable:
    schema = pa.schema([("word", pa.string()), ("block", pa.int64()),
                        ("post", pa.list_(pa.int32())), ("doc_id", id_type), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, specials = tokenizer(path)
        find = regex.compile(PRETOKEN).findall
        block = TaskContext.get().partitionId() << 24
        for b in slices(batches, limit=BLOCK_BYTES):
            words, post, offsets = _block(b.column("text"), t, specials, find)
            n = len(words)
            yield pa.record_batch([
                pa.array(words, pa.string()), pa.array(np.full(n, block)),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(post, pa.int32())),
                pa.nulls(n, id_type), pa.nulls(n, pa.int64())], schema=schema)
            d = b.num_rows     # one more row per document, with its own columns
            yield pa.record_batch([
                pa.nulls(d, pa.string()), pa.array(np.full(d, block)),
                pa.ListArray.from_arrays(pa.array(np.arange(d + 1), pa.int32()), pa.array(np.arange(d), pa.int32())),
                b.column("doc_id").cast(id_type), pc.cast(pc.binary_length(b.column("text")), pa.int64())], schema=schema)
            block += 1
    return run


def _block(texts: pa.Array, t, specials: list[str], find: Callable) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens of a block; for each, from offsets[i] to offsets[i + 1],
    frequency << DOC_BITS | document."""
    odd = pc.or_(pc.match_substring_regex(texts, _RUNS), pc.match_substring_regex(texts, _NEWER))
    for s in specials:
        odd = pc.or_(odd, pc.match_substring(texts, s))
    odd = odd.to_numpy(zero_copy_only=False).astype(bool)
    code: dict[str, int] = {}
    docs, codes = [], []
    for i in np.flatnonzero(odd):
        found = [code.setdefault(w, len(code)) for w in _whole(texts[int(i)].as_py(), t, specials, find)]
        codes.append(np.array(found, np.int64))
        docs.append(np.full(len(found), i, np.int64))
    even = np.flatnonzero(~odd)
    if len(even):
        cut = pc.split_pattern(texts.take(pa.array(even)), " ")
        chunk = cut.flatten().dictionary_encode()
        sizes = np.diff(cut.offsets.to_numpy())
        key = chunk.indices.to_numpy().astype(np.int64) * 2 + 1
        key[np.cumsum(sizes) - sizes] -= 1                     # the first chunk has no space before it
        known = np.zeros(2 * len(chunk.dictionary), bool)
        known[key] = True
        place = np.cumsum(known) - 1
        names = chunk.dictionary.to_pylist()
        flat, count = [], []
        for k in np.flatnonzero(known).tolist():
            w = names[k >> 1]
            w = " " + w if k & 1 else w
            if w.isalpha() or names[k >> 1].isalpha():
                flat.append(code.setdefault(w, len(code)))
                count.append(1)
            else:
                found = find(w)
                flat += [code.setdefault(x, len(code)) for x in found]
                count.append(len(found))
        count, flat = np.array(count, np.int64), np.array(flat, np.int64)
        start = np.cumsum(count) - count
        at = place[key]
        n = count[at]
        ramp = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        codes.append(flat[np.repeat(start[at], n) + ramp])
        docs.append(np.repeat(np.repeat(even, sizes), n))
    if not codes:
        return [], np.zeros(0, np.int64), np.zeros(1, np.int64)
    both = np.sort(np.concatenate(codes) << DOC_BITS | np.concatenate(docs))
    new = np.flatnonzero(np.diff(both, prepend=-1))
    freq = np.diff(np.append(new, len(both)))
    both = both[new]
    if len(freq) and freq.max() >= MAX_FREQ:
        times = -(-freq // (MAX_FREQ - 1))
        last = np.cumsum(times) - 1
        rest = freq - (times - 1) * (MAX_FREQ - 1)
        both, freq = np.repeat(both, times), np.full(times.sum(), MAX_FREQ - 1)
        freq[last] = rest
    offsets = np.searchsorted(both >> DOC_BITS, np.arange(len(code) + 1))
    return list(code), freq << DOC_BITS | both & ((1 << DOC_BITS) - 1), offsets


def _counted(path: str) -> Callable:
    """Adds ``pieces`` to the rows of a task; each distinct pre-token is counted
    once (again only where a task holds more than CACHE of them)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, specials = tokenizer(path)
        count: dict[str | None, int] = {None: 0}
        for b in batches:
            names = b.column("word").to_pylist()
            if len(count) > CACHE:
                count = {None: 0}
            fresh = [x for x in dict.fromkeys(names) if x not in count]
            count.update(zip(fresh, _pieces(t, specials, fresh), strict=True))
            kept = [c for c in b.schema.names if c != "word"]
            yield pa.record_batch([b.column(c) for c in kept] + [pa.array([count[x] for x in names], pa.int64())], names=[*kept, "pieces"])
    return run


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``."""
    kind = docs.schema[id_col].dataType
    name = kind.simpleString()
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type
    at = to_arrow_type(kind)
    columns = f"block long, post array<int>, doc_id {name}, n_bytes long"
    freq = d.mapInArrow(_frequencies(path, at), f"word string, {columns}")
    spread = F.when(F.col("word").isNull(), F.col("post")[0] + F.col("block")).when(F.size("post") > SPREAD, F.col("block"))
    dealt = freq.repartition(shuffle_width(docs.sparkSession), F.col("word"), spread)
    part = dealt.mapInArrow(_counted(path), f"{columns}, pieces long")
    part = part.select((F.shiftleft("block", DOC_BITS)).alias("at"), "doc_id", "n_bytes", "pieces", F.explode("post").alias("v"))
    part = part.select((F.col("at") + F.col("v").bitwiseAND((1 << DOC_BITS) - 1)).alias("doc"), "doc_id", "n_bytes",
                       (F.col("pieces") * F.shiftright("v", DOC_BITS)).alias("n"))
    out = part.groupBy("doc").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


