"""Toxicity by a string-subsequence kernel, Nyström landmarks and a linear SVM.

The kernel of two strings sums, over all subsequences of three characters, the
product of their weights; a subsequence that spans s characters weighs LAMBDA**s
(spans up to SPAN). Gaps and inserted characters lower it but leave most of it,
so "id-iot" stays close to "idiot". Landmarks are strings that tell toxic from
other sentences in the training sample (words and word beginnings, by the
log-likelihood ratio of their document counts), without near repetitions. A
sentence meets a landmark as well as its best word does; spaced-out letters
("i d i o t") are read as a word. These values, mapped by the inverse root of the
landmarks' own kernel matrix (Nyström), feed a linear support vector machine with
squared hinge loss, whose margin a logistic curve turns into a score.

Training takes at most MAX_TOXIC toxic and MAX_OTHER other labelled rows, the
first by a hash of the id; landmark counts and features are computed by Spark, and
only counts of candidate strings (the best CANDIDATES) and the sample's feature
rows come to the driver, which both bounds limit. Scoring is one pass over all
texts without a shuffle: a worker compares a word with the landmarks once and keeps
the result while it holds KEPT words at most.

Defined results: a null or empty text has no words and gets the score of the
empty feature vector (below one half unless training says otherwise). Without
labelled rows of both classes every score is the share of toxic rows (0.0 without
any). Label rows with null id or label are ignored; of several labels of one id
the largest counts. Extra columns are ignored; repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keeps, slices, stored, table, text_or_empty, turn_of

MAX_TOXIC, MAX_OTHER = 3000, 6000      # training rows at most
CANDIDATES = 4000                      # candidate strings at most
LANDMARKS = 128
LAMBDA = 0.75
SPAN = 9                               # longest span of a subsequence
FLOOR = 0.3                            # lower likeness counts as none
WORD = 24                              # longer words are read in windows of this length
ALIKE = 0.7                            # landmarks closer than this are one
KEPT = 600_000                         # chunks whose likeness a worker keeps
WORDS = 16_384                         # chunks compared with the landmarks at once
PAIRS = 100_000                        # occurrences of chunks looked at at once
READ = 2 << 20                         # bytes of text read at once

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN - a)]


def words_of(chunks: list[str]) -> list[list[str]]:
    """The words (or windows of a long word) of each chunk, in lower case."""
    out = []
    for c in chunks:
        w = c.lower()
        if not w.isalnum():
            w = _EDGE.sub("", w)
        if len(w) <= WORD:
            out.append([w] if len(w) > 2 else [])
        else:
            out.append([w[i:i + WORD] for i in range(0, len(w) - WORD // 2, WORD // 2)])
    return out


def chunks_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct white-space separated chunks; per occurrence its chunk and text.
    Runs of four or more single letters are one more chunk."""
    flat = texts
    for s in ("\n", "\t", "\r"):
        flat = pc.replace_substring(flat, s, " ")
    cut = pc.split_pattern(flat, " ")
    chunk = cut.flatten().dictionary_encode()
    code = chunk.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    names = chunk.dictionary.to_pylist()
    single = pc.equal(pc.utf8_length(chunk.dictionary), 1).to_numpy(zero_copy_only=False)
    single[single] = [names[i].isalnum() for i in np.flatnonzero(single)]
    if len(code) and single.any():
        one = single[code]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], one, [False])).astype(np.int8)))
        runs = [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= 4]
        at = {n: i for i, n in enumerate(names)} if runs else {}
        more, where = [], []
        for a, b in runs:
            for d in np.unique(doc[a:b]):
                run = code[a:b][doc[a:b] == d]
                if len(run) >= 4:
                    w = "".join(names[i] for i in run)
                    k = at.setdefault(w, len(names))
                    if k == len(names):
                        names.append(w)
                    more.append(k)
                    where.append(d)
        code, doc = np.concatenate((code, np.array(more, np.int64))), np.concatenate((doc, np.array(where, np.int64)))
    return names, code, doc


def subsequences(word: str) -> dict[str, float]:
    """Weight of each three-character subsequence of a word."""
    out: dict[str, float] = {}
    for i in range(len(word)):
        for a, b in _GAPS:
            if i + a + b < len(word):
                u = word[i] + word[i + a] + word[i + a + b]
                out[u] = out.get(u, 0.0) + LAMBDA ** (a + b + 1)
    return out


class _Seen:
    """Chunks that a worker has met: the row of each, -1 if it is near no landmark.
    Row i's nearness is in ``landmark`` and ``value``, from begin[i] to begin[i + 1].
    It begins anew beyond KEPT chunks, so its size is bounded."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.begin = np.zeros(1, np.int64)
        self.landmark = np.zeros(0, np.int64)
        self.value = np.zeros(0, np.float32)

    def add(self, rows: np.ndarray) -> np.ndarray:
        """Keep more rows; returns their numbers."""
        row, landmark = np.nonzero(rows)
        n = len(self.begin) - 1
        ends = np.cumsum(np.bincount(row, minlength=len(rows)))
        self.begin = np.concatenate((self.begin, self.begin[-1] + ends))
        self.landmark = np.concatenate((self.landmark, landmark))
        self.value = np.concatenate((self.value, rows[row, landmark]))
        return np.arange(n, n + len(rows))


_seen: dict[tuple, _Seen] = {}         # of one model: a worker's tasks share it


keeps("toxicity", _seen.clear)


def _seen_of(landmarks: list[str]) -> _Seen:
    key = tuple(landmarks)
    if key not in _seen:
        _seen.clear()
        _seen[key] = _Seen()
    return _seen[key]


@dataclass
class Model:
    landmarks: list[str]
    root: np.ndarray                       # inverse root of the landmarks' kernel matrix
    weights: np.ndarray
    bias: float
    curve: tuple[float, float]             # score = 1 / (1 + exp(-(a margin + b)))
    _tables: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_tables": None}

    def tables(self) -> tuple:
        """Code of each character; id of each coded triple; per id, from begin to
        the next begin, the landmarks that have it and its weight in each over the
        landmark's own kernel; the largest of these weights."""
        if self._tables is None:
            chars = sorted({c for w in self.landmarks for c in w})
            code = np.zeros(0x110000, np.uint8 if len(chars) < 255 else np.uint16)
            for i, c in enumerate(chars):
                code[ord(c)] = i + 1
            base = len(chars) + 1
            ids = np.zeros(base ** 3, np.int32)
            rows: list[np.ndarray] = [np.zeros(len(self.landmarks), np.float32)]
            for j, w in enumerate(self.landmarks):
                own = subsequences(w)
                norm = sum(v * v for v in own.values())
                for u, v in own.items():
                    t = (int(code[ord(u[0])]) * base + int(code[ord(u[1])])) * base + int(code[ord(u[2])])
                    if not ids[t]:
                        ids[t] = len(rows)
                        rows.append(np.zeros(len(self.landmarks), np.float32))
                    rows[ids[t]][j] = v / norm
            m = np.array(rows)
            part, landmark = np.nonzero(m)
            begin = np.searchsorted(part, np.arange(len(m) + 1))
            self._tables = code, base, ids, begin, landmark, m[part, landmark], m.max(axis=1)
        return self._tables

    def likeness(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(which words come near a landmark at all, their likeness to each)."""
        if not words or not self.landmarks:
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)), np.float32)
        code, base, ids, begin, landmark, share, top = self.tables()
        flat = code[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
        size = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))   # characters from here to the word's end
        live = np.flatnonzero(flat)
        live = live[np.argsort(-np.minimum(left[live], SPAN), kind="stable")]
        left = np.minimum(left[live], SPAN)
        first, bound = flat[live] * base, np.zeros(len(words))
        hits = []
        for a, b in _GAPS:
            n = int(np.searchsorted(-left, -(a + b)))    # those with more than a + b characters left
            at = live[:n]
            t = ids[(first[:n] + flat[at + a]) * base + flat[at + (a + b)]]
            h = np.flatnonzero(t)
            if len(h):
                w, t = word[at[h]], t[h]
                weight = np.float32(LAMBDA ** (a + b + 1))
                bound += np.bincount(w, top[t] * weight, len(words))
                hits.append((w, t, weight))
        near = np.flatnonzero(bound >= FLOOR)
        m = len(self.landmarks)
        out = np.zeros(len(near) * m)
        place = np.full(len(words), -1)
        place[near] = np.arange(len(near))
        for w, t, weight in hits:
            p = place[w]
            p, t = p[p >= 0], t[p >= 0]
            n = begin[t + 1] - begin[t]
            at = np.repeat(begin[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out += np.bincount(np.repeat(p, n) * m + landmark[at], share[at] * weight, len(out))
        out = out.reshape(-1, m).astype(np.float32)
        out = np.clip((out - FLOOR) / (1 - FLOOR), 0, 1)
        some = out.any(axis=1)
        return near[some], out[some]

    def chunk_rows(self, names: list[str]) -> tuple[np.ndarray, _Seen]:
        """(row of each chunk or -1, the rows): a chunk is as near to a landmark as
        its best word. Only chunks that this worker hasn't met are read."""
        seen = _seen_of(self.landmarks)
        new = [c for c in names if c not in seen.row]
        if len(seen.row) + len(new) > KEPT:
            seen.clear()
            new = names
        for x in range(0, len(new), WORDS):
            part = new[x:x + WORDS]
            lists = words_of(part)
            at: dict[str, int] = {}
            chunk = np.repeat(np.arange(len(lists)), [len(w) for w in lists])
            word = np.array([at.setdefault(w, len(at)) for ws in lists for w in ws], np.int64)
            near, value = self.likeness(list(at))
            place = np.full(len(at), -1)
            place[near] = np.arange(len(near))
            p = place[word]
            chunk, p = chunk[p >= 0], p[p >= 0]
            first = np.flatnonzero(np.diff(chunk, prepend=-1))
            row = np.full(len(part), -1)
            if len(first):
                row[chunk[first]] = seen.add(np.maximum.reduceat(value[p], first, axis=0))
            seen.row.update(zip(part, row.tolist(), strict=True))
        return np.fromiter(map(seen.row.__getitem__, names), np.int64, len(names)), seen

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text and landmark the likeness of the nearest word."""
        out = np.zeros((len(texts), len(self.landmarks)), np.float32)
        if not self.landmarks:
            return out
        names, code, doc = chunks_of(texts)
        row, seen = self.chunk_rows(names)
        r = row[code]
        doc, r = doc[r >= 0], r[r >= 0]
        flat, m = out.reshape(-1), out.shape[1]
        for x in range(0, len(r), PAIRS):
            d, p = doc[x:x + PAIRS], r[x:x + PAIRS]
            n = seen.begin[p + 1] - seen.begin[p]
            at = np.repeat(seen.begin[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            np.maximum.at(flat, np.repeat(d * m, n) + seen.landmark[at], seen.value[at])
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        margin = features @ (self.root @ self.weights) + self.bias if len(self.landmarks) else np.full(len(features), self.bias)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))


def _candidates(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, pos, neg): in how many toxic and other texts words and their
    beginnings occur."""
    turn_of("toxicity")
    count = {0: Counter(), 1: Counter()}

    def out():
        keys = list(set(count[0]) | set(count[1]))
        yield pa.record_batch([pa.array(keys, pa.string()), pa.array([count[1][k] for k in keys], pa.int64()),
                               pa.array([count[0][k] for k in keys], pa.int64())], names=["gram", "pos", "neg"])
        count[0].clear()
        count[1].clear()

    for b in slices(rows, limit=1 << 20):
        names, code, doc = chunks_of(b.column("text"))
        lists = words_of(names)
        label = b.column("toxic").to_pylist()
        pair = np.unique(doc * max(1, len(names)) + code)
        edge = np.searchsorted(pair // max(1, len(names)), np.arange(b.num_rows + 1))
        for i in range(b.num_rows):
            grams = set()
            for c in (pair[edge[i]:edge[i + 1]] % max(1, len(names))).tolist():
                for w in lists[c]:
                    if len(w) <= 12:
                        grams.add(w)
                    grams.update(w[:n] for n in (4, 5, 6, 7) if len(w) > n)
            count[int(label[i])].update(g for g in grams if len(g) > 3)
        if len(count[0]) + len(count[1]) > 200_000:
            yield from out()
    yield from out()


def kernel(strings: list[str]) -> np.ndarray:
    """Normalised kernel matrix of a few strings."""
    own = [subsequences(w) for w in strings]
    norm = [np.sqrt(sum(v * v for v in o.values())) for o in own]
    k = np.eye(len(strings))
    for i in range(len(strings)):
        for j in range(i):
            k[i, j] = k[j, i] = sum(v * own[j].get(u, 0.0) for u, v in own[i].items()) / (norm[i] * norm[j])
    return k


def choose_landmarks(grams: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> list[str]:
    """The strings that tell the classes apart best, without near repetitions."""
    def ratio(p: int, n: int) -> float:
        def part(o, e):
            return o * np.log(o / e) if o > 0 else 0.0
        total = n_pos + n_neg
        e = (p + n) / total
        return part(p, n_pos * e) + part(n, n_neg * e) + part(n_pos - p, n_pos * (1 - e)) + part(n_neg - n, n_neg * (1 - e))

    ranked = sorted((-ratio(p, n), len(g), g) for g, p, n in grams if p / n_pos > 2 * n / max(1, n_neg) and len(g) >= 4)
    found: list[str] = []
    own: list[dict] = []
    for _, _, g in ranked:
        s = subsequences(g)
        norm = np.sqrt(sum(v * v for v in s.values()))
        if all(sum(v * o.get(u, 0.0) for u, v in s.items()) / (norm * z) < ALIKE for o, z in own):
            found.append(g)
            own.append((s, norm))
            if len(found) == LANDMARKS:
                break
    return found


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """Squared hinge loss with a ridge, classes weighed alike, by Newton steps;
    y is -1 or 1."""
    z = np.hstack((x, np.ones((len(x), 1))))
    c = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * cost
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(z.shape[1])

    def loss(w):
        return w @ ridge @ w / 2 + (c * np.maximum(0, 1 - y * (z @ w)) ** 2).sum() / 2

    for _ in range(60):
        s = y * (z @ w) < 1
        grad = ridge @ w - z[s].T @ (c[s] * (y[s] - z[s] @ w))
        step = np.linalg.solve(ridge + (z[s] * c[s, None]).T @ z[s], grad)
        t, now = 1.0, loss(w)
        while loss(w - t * step) > now and t > 1e-6:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed targets."""
    n_pos, n_neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    z = np.column_stack((margin, np.ones(len(margin))))
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (p - t))
        size = np.abs(step).max()
        w -= step / max(1.0, size)
        if size < 1e-9:
            break
    return float(w[0]), float(w[1])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 5, is 0; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """``docs`` (doc_id, text), ``labels`` (doc_id, toxic): only rows that aren't
    held out are read."""
    spark = docs.sparkSession
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(
        known.where("toxic = 0").orderBy(*order).limit(MAX_OTHER))
    rows = stored(docs.join(F.broadcast(sample), "doc_id").select("toxic", text_or_empty("text").alias("text")), "toxic-sample")
    spread = rows.repartition(max(2, spark.sparkContext.defaultParallelism))
    n = dict(rows.groupBy("toxic").count().collect())
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:
        share = 0.0 if not n_pos else 1.0
        return Model([], np.zeros((0, 0)), np.zeros(0), 40.0 if share else -40.0, (1.0, 0.0))
    grams = (spread.mapInArrow(_candidates, "gram string, pos long, neg long").groupBy("gram")
             .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
             .where((F.col("pos") > 1) & (F.col("pos") / n_pos > 2 * F.col("neg") / n_neg))
             .orderBy((F.col("pos") / n_pos - F.col("neg") / n_neg).desc(), "gram").limit(CANDIDATES).collect())
    model = Model(choose_landmarks([tuple(g) for g in grams], n_pos, n_neg), np.zeros((0, 0)), np.zeros(0), 0.0, (1.0, 0.0))
    if not model.landmarks:
        return Model([], np.zeros((0, 0)), np.zeros(0), -40.0, (1.0, 0.0))
    value, vector = np.linalg.eigh(kernel(model.landmarks))
    model.root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T

    def features(batches):
        turn_of("toxicity")
        for b in slices(batches, limit=READ):
            f = model.features(b.column("text"))
            yield pa.record_batch([b.column("toxic"), pa.array([x.tobytes() for x in f], pa.binary())], names=["toxic", "f"])

    got = spread.mapInArrow(features, "toxic int, f binary").toArrow()
    x = np.frombuffer(b"".join(got["f"].to_pylist()), np.float32).reshape(got.num_rows, -1).astype(float)
    y = np.where(got["toxic"].to_numpy() > 0, 1.0, -1.0)
    order = np.lexsort((*x.T, y))              # rows come in any order
    x, y = x[order], y[order]
    model.weights, model.bias = linear_svm(x @ model.root, y)
    model.curve = logistic_curve(x @ (model.root @ model.weights) + model.bias, y)
    return model


def _scored(model: Model, id_type: pa.DataType) -> Callable:
    schema = pa.schema([("doc_id", id_type), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_of("toxicity")
        for b in slices(batches, limit=READ):
            s = model.scores(model.features(b.column("text")))
            yield pa.record_batch([b.column("doc_id").cast(id_type), pa.array(s.astype(float))], schema=schema)
    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema["doc_id"].dataType
    d = docs.select("doc_id", text_or_empty("text").alias("text"))
    out = d.mapInArrow(_scored(model, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model doesn't reject."""
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        turn_of("toxicity")
        for t in texts:
            parts = [model.scores(model.features(b.column(0))).astype(float)
                     for b in slices(iter([pa.record_batch([t], names=["text"])]), limit=READ)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    # only texts go to Python; the rows stay where they are
    return docs.where(score(text_or_empty("text")) < 0.5)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
