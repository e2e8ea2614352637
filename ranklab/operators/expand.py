"""Relevance models, query expansion and batch retrieval.

An index is built from one scan of the corpus: postings (term, did, tf, dl), a table
of terms (df, ctf, and per class of document lengths the greatest tf and the least
length, from which score bounds follow for any model), and the collection's counts.

Retrieval (R6) keeps only the postings of query terms (the query side is broadcast
behind a size check) and scores them in three steps:

1. A query's terms are put in order of their score bounds. The documents of its best
   terms are scored on these; the k-th best such score is a score that k documents
   reach.
2. The last terms, whose bounds together don't reach that score, can't bring a new
   document in. Documents of all other terms are summed on these, in the tasks that
   hold the documents, and leave them only if they can reach that score; those that
   reach the k-th best sum only with more than the last terms' bounds are out.
3. The documents left get the last terms' scores: they alone are scored in full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_punctuation, tokenize
from ..session import broadcast_if_small
from .rank import rank_rows, top_k


def postings(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(did, term, tf, dl, first) from raw text in ONE tokenisation pass: each
    posting carries its document's length, so no lengths table is joined. One
    row of a document is its first; a document without tokens has that row
    only, with a null term."""
    toks = corpus.select("did", tokenize(F.col(text)).alias("t"))
    # posexplode_outer: a plain explode lets Catalyst infer size(tokens) > 0 and
    # push that regex below the repartition into the scan
    ex = toks.select("did", F.size("t").alias("dl"), F.posexplode_outer("t").alias("pos", "term"))
    return ex.groupBy("did", "term").agg(F.count("term").alias("tf"), F.first("dl").alias("dl"),
                                         F.coalesce(F.min("pos") == 0, F.lit(True)).alias("first"))


def build_index(corpus: DataFrame, text: str = "text") -> dict:
    """``post``, the postings; ``terms`` (term, df, ctf, blocks), blocks being (tf, dl),
    the greatest tf and least length per class of lengths; ``N`` documents (also
    those without tokens) and ``C`` tokens. Like any inverted index it is written
    once, as tables in the shared checkpoint folder, and read by every query."""
    from ..session import materialize as write_once
    rows = write_once(postings(corpus, text), "postings")
    post = rows.where(F.col("term").isNotNull()).select("did", "term", "tf", "dl")
    block = post.groupBy("term", F.floor(F.log2("dl")).alias("_b")).agg(
        F.count("*").alias("n"), F.sum("tf").alias("c"), F.max("tf").alias("tf"), F.min("dl").alias("dl"))
    terms = block.groupBy("term").agg(F.sum("n").alias("df"), F.sum("c").alias("ctf"),
                                      F.collect_list(F.struct("tf", "dl")).alias("blocks"))       # one a power of two
    whole = rows.agg(F.count_if("first").alias("N"), F.coalesce(F.sum("tf"), F.lit(0)).alias("C"), F.min("dl").alias("least")).first()
    return {"post": post, "terms": write_once(terms, "terms"), "N": whole["N"], "C": whole["C"], "least": whole["least"] or 0}


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(qid, term, qtf); punctuation removed first (the reference strips it
    before querying)."""
    t = queries.select("qid", tokenize(strip_punctuation(F.col(text))).alias("t"))
    return t.select("qid", F.explode_outer("t").alias("term")).where(F.col("term").isNotNull()) \
        .groupBy("qid", "term").agg(F.count("*").alias("qtf"))


SEEDS = 4            # documents per wanted result that the best terms hold together
PAIRS = 1 << 22      # hits of a task that sums documents


def _term_score(model: str, ix: dict, k1: float, b: float, mu: float):
    """Score of a term (columns qtf, df, ctf) in a document, given tf and dl; and a
    document's own part, given its length and the query's (null where it has none)."""
    if model == "bm25":
        idf = F.log(1 + (ix["N"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        avgdl = ix["C"] / max(ix["N"], 1)
        return (lambda tf, dl: F.col("qtf") * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (avgdl or 1.0)))), (lambda dl, ql: F.lit(0.0))
    if model == "ql":
        share = mu * F.col("ctf") / float(max(ix["C"], 1))
        return (lambda tf, dl: F.col("qtf") * F.log(1 + tf / share)), (lambda dl, ql: ql * F.log(mu / (dl + mu)))
    raise ValueError(model)


def retrieve(queries: DataFrame, corpus: DataFrame, model: str = "bm25", k: int = 100,
             k1: float = 0.9, b: float = 0.4, mu: float = 1000.0,
             working_set: DataFrame | None = None, index: dict | None = None, trace: dict | None = None) -> DataFrame:
    """Batch top-k retrieval. ``bm25`` (Robertson idf ln(1 + (N − df +
    0.5)/(df + 0.5))) or ``ql`` (Dirichlet-smoothed query likelihood, rank
    equivalent form Σ qtf·ln(1 + tf/(μ·P(t|C))) + |q|·ln(μ/(dl + μ))).
    ``working_set`` (qid, did) restricts the candidates (R7). ``trace`` gets the
    frames of matching and of fully scored pairs (qid, did)."""
    from ..session import materialize as write_once
    ix = index or build_index(corpus)
    score, own = _term_score(model, ix, k1, b, mu)
    qt = query_terms(queries).join(ix["terms"], "term")
    # Bounds of a query's terms, best first; what this term and those after it reach.
    best = Window.partitionBy("qid").orderBy(F.col("bound").desc(), "term")
    rest = best.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    bound = F.array_max(F.transform("blocks", lambda x: score(x["tf"], x["dl"])))
    all_ = query_terms(queries).groupBy("qid").agg(F.sum("qtf").alias("ql"))       # terms the corpus lacks count, too
    qt = qt.select("qid", "term", "qtf", "df", "ctf", bound.alias("bound")).join(all_, "qid")
    qt = qt.select("*", F.row_number().over(best).alias("pos"), F.sum("bound").over(rest).alias("reach"),
                   (F.sum("df").over(best) - F.col("df")).alias("before"))
    qt = write_once(qt, "query-terms")

    def hits(post: DataFrame, terms: DataFrame, *more: str) -> DataFrame:
        """Contributions of ``terms`` in ``post``; columns ``more`` of the terms are kept.
        Never stored: they are as many as documents times queries."""
        h = post.join(broadcast_if_small(terms.select("qid", "term", "qtf", "df", "ctf", "ql", *more)), "term")
        if working_set is not None:
            h = h.join(working_set.select("qid", "did").distinct(), ["qid", "did"], "left_semi")
        return h.select("qid", "did", score(F.col("tf"), F.col("dl")).alias("c"), own(F.col("dl"), F.col("ql")).alias("own"), *more)

    def summed(rows: DataFrame, *more: str) -> DataFrame:
        return rows.groupBy("qid", "did").agg(F.sum("c").alias("c"), F.first("own").alias("own"), *[F.first(x).alias(x) for x in more])

    def reached(sums: DataFrame, name: str) -> DataFrame:
        """The k-th best score, a little less for rounding; none for queries with fewer documents."""
        top = top_k(sums.select("qid", "did", (F.col("c") + F.col("own")).alias("s")), ["qid"], [F.col("s").desc(), F.col("did")], k, "r")
        least = F.col("s") - F.abs("s") * 1e-9 - 1e-9
        return top.where(F.col("r") == k).select("qid", least.alias(name))

    first = write_once(reached(summed(hits(ix["post"], qt.where(F.col("before") < SEEDS * k))), "least"), "least")
    free = own(F.lit(ix["least"]), F.col("ql")) if model == "ql" else F.lit(0.0)
    last = qt.join(first, "qid").where(F.col("reach") + free < F.col("least"))
    last = last.groupBy("qid").agg(F.min("pos").alias("cut"), F.max("reach").alias("tail"))
    qt = qt.join(first, "qid", "left").join(last, "qid", "left").withColumn("late", F.coalesce(F.col("pos") >= F.col("cut"), F.lit(False)))
    qt = write_once(qt.withColumn("tail", F.coalesce("tail", F.lit(0.0))), "query-terms")

    # Dealt by document, the sums need no other shuffle, and only pairs that can
    # reach the first bound leave a task. A task has some PAIRS hits whatever the tables.
    n_hits = qt.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    parts = max(ix["post"].sparkSession.sparkContext.defaultParallelism, n_hits // PAIRS)
    early = qt.where("NOT late")
    dealt = ix["post"].join(broadcast_if_small(early.select("term").distinct()), "term", "left_semi").repartition(parts, "did")
    sums = summed(hits(dealt, early, "tail", "least"), "tail", "least")
    sums = write_once(sums.where(F.col("least").isNull() | (F.col("c") + F.col("own") + F.col("tail") >= F.col("least"))).drop("least"), "sums")
    second = reached(sums, "least")
    left = sums.join(broadcast_if_small(second), "qid", "left")
    left = left.where(F.col("least").isNull() | (F.col("c") + F.col("own") + F.col("tail") >= F.col("least")))
    left = write_once(left.select("qid", "did", "c", "own"), "left")
    late = hits(ix["post"], qt.where("late")).join(broadcast_if_small(left.select("qid", "did")), ["qid", "did"], "left_semi")
    full = left.unionByName(late.select("qid", "did", "c", "own"))
    if trace is not None:
        trace |= {"matching": hits(ix["post"], qt).select("qid", "did").distinct(), "scored": left.select("qid", "did")}
    scored = summed(full).select("qid", "did", (F.col("c") + F.col("own")).alias("score"))
    return top_k(scored, ["qid"], [F.round("score", 9).desc(), F.col("did")], k, "rank") \
        .select("qid", "did", "rank", "score")


def working_set(run: DataFrame) -> DataFrame:
    """Documents per query of a run."""
    return run.select("qid", "did").distinct()


def relevance_model(run: DataFrame, corpus: DataFrame, ndocs: int = 10, stopwords: DataFrame | None = None,
                    text: str = "text", index: dict | None = None, probabilities: bool = False) -> DataFrame:
    """RM1 from the top ``ndocs`` documents of each query: document weights
    softmax(score) (computed as exp(s − max s)), P(t) = Σ_d w_d·tf/len, then
    stop words removed and the distribution renormalised. (qid, term, p).
    With ``probabilities`` the scores are weights already: they are normalised
    as they stand, and a negative one stops the job."""
    top = top_k(run, ["qid"], [F.col("score").desc(), F.col("did")], ndocs, "_r")
    wq = Window.partitionBy("qid")
    if probabilities:
        z = F.when(F.col("score") < 0, F.raise_error(F.lit("a document's probability is negative")).cast("double")).otherwise(F.col("score").cast("double"))
    else:
        z = F.exp(F.col("score") - F.max("score").over(wq))
    w = top.withColumn("_z", z).withColumn("w", F.col("_z") / F.sum("_z").over(wq)).select("qid", "did", "w")
    if index is not None:
        from ..session import materialize as write_once
        post, w = index["post"], broadcast_if_small(write_once(w, "weights"))      # so that its size is known
    else:
        post = postings(corpus.join(w.select("did").distinct(), "did", "left_semi"), text).where(F.col("term").isNotNull())
    j = w.join(post, "did")
    rm = j.groupBy("qid", "term").agg(F.sum(F.col("w") * F.col("tf") / F.col("dl")).alias("p"))
    if stopwords is not None:
        rm = rm.join(broadcast_if_small(stopwords.select("term")), "term", "left_anti")
    return rm.withColumn("p", F.col("p") / F.sum("p").over(wq))


def rm_top_terms(rm: DataFrame, nterms: int | DataFrame, whitelist: DataFrame | None = None) -> DataFrame:
    """R2: optional whitelist, then the top n terms per query; n is a number
    or a (qid, n) table."""
    if whitelist is not None:
        rm = rm.join(broadcast_if_small(whitelist.select("term")), "term", "left_semi")
    if isinstance(nterms, int):
        return top_k(rm, ["qid"], [F.col("p").desc(), F.col("term")], nterms, "rank")
    ranked = rank_rows(rm, ["qid"], [F.col("p").desc(), F.col("term")], "rank")
    return ranked.join(nterms, "qid").where(F.col("rank") <= F.col("n")).drop("n")


def rm_to_weighted_query(rm: DataFrame) -> DataFrame:
    """``#weight( p1 t1 p2 t2 … )`` (6 decimals, best term first) and the
    bare bag of terms."""
    item = F.struct(F.col("rank"), F.format_string("%.6f %s", F.col("p"), F.col("term")).alias("s"), F.col("term"))
    agg = rm.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("_i"))
    return agg.select("qid", F.concat(F.lit("#weight( "), F.array_join(F.transform("_i", lambda s: s["s"]), " "),
                                      F.lit(" )")).alias("weighted"),
                      F.array_join(F.transform("_i", lambda s: s["term"]), " ").alias("bag"))


def rm3_interpolate(queries: DataFrame, rm: DataFrame, lam: float) -> DataFrame:
    """λ·P(t|q) + (1 − λ)·P(t|R) per (qid, term), P(t|q) = qtf/|q|."""
    qt = query_terms(queries)
    pq = qt.withColumn("pq", F.col("qtf") / F.sum("qtf").over(Window.partitionBy("qid"))).select("qid", "term", "pq")
    j = pq.join(rm.select("qid", "term", F.col("p").alias("pr")), ["qid", "term"], "full")
    return j.select("qid", "term", (lam * F.coalesce("pq", F.lit(0.0)) + (1 - lam) * F.coalesce("pr", F.lit(0.0)))
                    .alias("p"))


def rm3_sweep(queries: DataFrame, rm: DataFrame, lambdas: Sequence[float], nterms: Sequence[int]) -> DataFrame:
    """One expanded query string per (λ, nterms) setting:
    ``#weight( λ #combine( q ) 1-λ #weight( … ) )``; λ = 1 keeps only the
    query, λ = 0 only the model."""
    spark = queries.sparkSession
    grid = spark.createDataFrame([(float(l_), int(n)) for l_ in lambdas for n in nterms], "lam double, nterms int")
    kmax = max(nterms)
    top = top_k(rm, ["qid"], [F.round("p", 12).desc(), F.col("term")], kmax, "rank")
    cand = top.crossJoin(F.broadcast(grid)).where(F.col("rank") <= F.col("nterms"))
    wq = rm_to_weighted_query_keyed(cand, ["qid", "lam", "nterms"])
    q = queries.select("qid", F.concat(F.lit("#combine( "), F.lower(strip_punctuation(F.col("text"))), F.lit(" )")).alias("orig"))
    j = wq.join(q, "qid")
    s = F.when(F.col("lam") >= 1.0, F.col("orig")).when(F.col("lam") <= 0.0, F.col("weighted")).otherwise(
        F.format_string("#weight( %.2f %s %.2f %s )", F.col("lam"), F.col("orig"), 1 - F.col("lam"), F.col("weighted")))
    return j.select("qid", "lam", "nterms", s.alias("query"))


def rm_to_weighted_query_keyed(rm: DataFrame, keys: list[str]) -> DataFrame:
    item = F.struct(F.col("rank"), F.format_string("%.6f %s", F.col("p"), F.col("term")).alias("s"))
    agg = rm.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_i"))
    return agg.select(*keys, F.concat(F.lit("#weight( "), F.array_join(F.transform("_i", lambda s: s["s"]), " "),
                                      F.lit(" )")).alias("weighted"))


def pairwise_l2(vectors: DataFrame, pairs: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Euclidean distance for the given (id_a, id_b) pairs. The pair list
    is an input, so its size (not the square of the vector count) bounds
    the work."""
    a = vectors.select(F.col(id_col).alias("id_a"), F.col(vec).alias("va"))
    b = vectors.select(F.col(id_col).alias("id_b"), F.col(vec).alias("vb"))
    j = pairs.join(a, "id_a").join(b, "id_b")
    sq = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
    return j.select("id_a", "id_b", F.sqrt(sq).alias("l2"))
