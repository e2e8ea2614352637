"""Registered text, retrieval and expansion queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import expand as R
from ..operators.groups import term_stats as _term_stats
from ..session import materialize
from . import views as V
from .catalog import r6, register

TOK = r"'[\p{L}\p{N}]+'"
PUNCT_SQL = "'" + X.PUNCTUATION.replace("'", "''") + "'"
STOP_SQL = "(VALUES " + ", ".join(f"('{w}')" for w in X.STOPWORDS) + ") sw(term)"

_STATS_SQL = f"""dt AS (SELECT did, regexp_extract_all(lower(text), {TOK}) AS t FROM corpus),
  post AS (SELECT did, term, count(*) AS tf FROM (SELECT did, unnest(t) AS term FROM dt) x GROUP BY did, term),
  st AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM post GROUP BY term)"""


def _corpus_tokens(spark, sf_dir):
    return V.corpus(spark, sf_dir).select("did", X.tokenize(F.col("text")).alias("tokens"))


def _query_tokens(spark, sf_dir):
    return V.queries(spark, sf_dir).select("qid", X.tokenize(X.strip_punctuation(F.col("text"))).alias("tokens"))


@register("term_stats", f"WITH {_STATS_SQL} SELECT term, tf, df FROM st", ("corpus",))
def term_stats(spark, sf_dir):
    """G16 + X2: corpus term and document frequency over whole texts."""
    return _term_stats(_corpus_tokens(spark, sf_dir))


CLEAN_SQL = """trim(regexp_replace(regexp_replace(lower(strip_accents(replace(replace(replace(text, 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'))),
                 '[^\\p{L}\\p{M}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g'))"""


@register("clean_text", f"SELECT did, {CLEAN_SQL} AS text FROM corpus", ("corpus",))
def clean_text(spark, sf_dir):
    """Transliterated, alphanumeric, lower-cased, space-collapsed texts."""
    return V.corpus(spark, sf_dir).select("did", X.clean_text(F.col("text")).alias("text"))


@register("repair_text", "SELECT did, text, md5(text) AS original FROM corpus", ("corpus",))
def repair_text(spark, sf_dir):
    """Every document encoded as UTF-8 and read as Latin-1, twice, then repaired."""
    garbled = F.col("text")
    for _ in range(2):
        garbled = F.decode(F.encode(garbled, "UTF-8"), "ISO-8859-1")
    c = V.corpus(spark, sf_dir).select("did", F.md5(F.col("text").cast("binary")).alias("original"), garbled.alias("g"))
    return c.select("did", X.repair_text(F.col("g")).alias("text"), "original")


@register("query_tokens", f"""
SELECT qid, array_to_string(regexp_extract_all(lower(translate(text, {PUNCT_SQL}, '')), {TOK}), ' ') AS text
FROM queries
""", ("queries",))
def query_tokens(spark, sf_dir):
    """X10 + X2: queries without punctuation, tokenised."""
    return _query_tokens(spark, sf_dir).select("qid", F.array_join("tokens", " ").alias("text"))


@register("normalize_tokens", f"""
WITH {_STATS_SQL},
  lex AS (SELECT s.term AS token, substring(s.term, 1, length(s.term) - 1) AS lemma FROM st s
          WHERE s.term LIKE '%s' AND length(s.term) > 3
            AND substring(s.term, 1, length(s.term) - 1) IN (SELECT term FROM st)),
  ex AS (SELECT did, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM dt),
  sw AS (SELECT * FROM ex WHERE term NOT IN (SELECT term FROM {STOP_SQL})),
  kept AS (SELECT did, pos, coalesce(lex.lemma, sw.term) AS term FROM sw LEFT JOIN lex ON lex.token = sw.term),
  agg AS (SELECT did, count(*) AS n_tokens, string_agg(term, ' ' ORDER BY pos) AS text FROM kept GROUP BY did)
SELECT c.did, coalesce(n_tokens, 0) AS n_tokens, coalesce(agg.text, '') AS text FROM corpus c LEFT JOIN agg USING (did)
""", ("corpus",))
def normalize_tokens(spark, sf_dir):
    """X3 + X4: stop words removed, lemma lookup in a lexicon derived from the
    corpus vocabulary, tokens reassembled in order."""
    toks = _corpus_tokens(spark, sf_dir)
    lex = X.plural_lexicon(_term_stats(toks))
    out = X.normalize_tokens(toks, "did", "tokens", lexicon=lex, stopwords=X.stopwords_df(spark))
    return out.select("did", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("tokens", " ").alias("text"))


@register("encode_decode", f"""
WITH {_STATS_SQL},
  vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY tf DESC, term) + 2 AS INTEGER) AS term_id FROM st),
  qt AS (SELECT qid, regexp_extract_all(lower(translate(text, {PUNCT_SQL}, '')), {TOK}) AS t FROM queries),
  ex AS (SELECT qid, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM qt),
  ids AS (SELECT qid, list(coalesce(v.term_id, 1) ORDER BY pos) AS l FROM ex LEFT JOIN vocab v USING (term) GROUP BY qid),
  enc AS (SELECT q.qid, list_resize(list_concat([2], coalesce(ids.l, [])), 32, 0) AS ids FROM queries q LEFT JOIN ids USING (qid)),
  dx AS (SELECT qid, unnest(ids) AS term_id, generate_subscripts(ids, 1) AS pos FROM enc),
  dec AS (SELECT qid, string_agg(v.term, ' ' ORDER BY pos) AS text FROM dx JOIN vocab v USING (term_id)
          WHERE term_id NOT IN (0, 1, 2) GROUP BY qid)
SELECT e.qid, e.ids, coalesce(dec.text, '') AS text FROM enc e LEFT JOIN dec USING (qid)
""", ("corpus", "queries"))
def encode_decode(spark, sf_dir):
    """X5 + S10: queries → ids with the corpus vocabulary (start id, width 32,
    padded), then decoded back to text."""
    stats = materialize(_term_stats(_corpus_tokens(spark, sf_dir)), "words")
    vocab = materialize(X.build_vocab(stats), "vocab")
    enc = materialize(X.encode_tokens(_query_tokens(spark, sf_dir), "qid", "tokens", vocab, 32), "ids")
    dec = X.decode_ids(enc, "qid", "ids", vocab)
    return enc.join(dec, "qid").select("qid", "ids", "text")


def _retrieval_sql(model: str) -> str:
    if model == "bm25":
        score = ("sum(qtf * ln(1 + (coll.n - df + 0.5) / (df + 0.5)) * tf * (0.9 + 1) "
                 "/ (tf + 0.9 * (1 - 0.4 + 0.4 * dl / coll.avgdl)))")
        sc = f"SELECT qid, did, {score} AS score FROM h, coll GROUP BY qid, did"
    else:
        sc = ("SELECT p.qid, p.did, p.s + ql.ql * ln(1000.0 / (p.dl + 1000.0)) AS score FROM "
              "(SELECT qid, did, sum(qtf * ln(1 + tf / (1000.0 * ctf / coll.c))) AS s, max(dl) AS dl "
              " FROM h, coll GROUP BY qid, did) p JOIN (SELECT qid, sum(qtf) AS ql FROM qt GROUP BY qid) ql USING (qid)")
    return f"""
WITH dt AS (SELECT did, regexp_extract_all(lower(text), {TOK}) AS t FROM corpus),
  lens AS (SELECT did, len(t) AS dl FROM dt),
  post AS (SELECT did, term, count(*) AS tf FROM (SELECT did, unnest(t) AS term FROM dt) x GROUP BY did, term),
  qt AS (SELECT qid, term, count(*) AS qtf FROM
           (SELECT qid, unnest(regexp_extract_all(lower(translate(text, {PUNCT_SQL}, '')), {TOK})) AS term FROM queries) x
         GROUP BY qid, term),
  coll AS (SELECT count(*) AS n, avg(dl) AS avgdl, sum(dl) AS c FROM lens),
  ts AS (SELECT term, count(*) AS df, sum(tf) AS ctf FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term),
  h AS (SELECT qt.qid, p.did, p.tf, qt.qtf, ts.df, ts.ctf, l.dl FROM post p JOIN qt USING (term) JOIN ts USING (term)
        JOIN lens l USING (did)),
  sc AS ({sc}),
  rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, did) AS rank FROM sc)
SELECT qid, did, rank, round(score, 6) AS score FROM rk WHERE rank <= 100
"""


@register("retrieve_bm25", _retrieval_sql("bm25"), ("corpus", "queries"))
def retrieve_bm25(spark, sf_dir):
    """BM25 (k1 0.9, b 0.4) top 100 of every benchmark text over all documents."""
    out = R.retrieve(V.queries(spark, sf_dir), V.corpus(spark, sf_dir), "bm25", 100)
    return out.select("qid", "did", "rank", r6("score").alias("score"))


@register("retrieve_ql", _retrieval_sql("ql"), ("corpus", "queries"))
def retrieve_ql(spark, sf_dir):
    """Dirichlet query likelihood (mu 1000) top 100."""
    out = R.retrieve(V.queries(spark, sf_dir), V.corpus(spark, sf_dir), "ql", 100, mu=1000.0)
    return out.select("qid", "did", "rank", r6("score").alias("score"))


_RESCORE_SQL = _retrieval_sql("bm25").split("SELECT qid, did, rank, round(score, 6) AS score FROM rk WHERE rank <= 100")[0] + f""",
  ws AS (SELECT qid, did FROM rk WHERE rank <= 100),
  hq AS (SELECT h.* FROM h JOIN ws USING (qid, did)),
  ql AS (SELECT p.qid, p.did, p.s + ql.ql * ln(1000.0 / (p.dl + 1000.0)) AS score FROM
           (SELECT qid, did, sum(qtf * ln(1 + tf / (1000.0 * ctf / coll.c))) AS s, max(dl) AS dl FROM hq, coll GROUP BY qid, did) p
           JOIN (SELECT qid, sum(qtf) AS ql FROM qt GROUP BY qid) ql USING (qid)),
  rk2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, did) AS rank2 FROM ql),
  qlen AS (SELECT qid, len(regexp_extract_all(lower(translate(text, {PUNCT_SQL}, '')), {TOK})) AS n FROM queries)
SELECT rk2.qid, did, rank2 AS rank, round(score * n, 6) AS score FROM rk2 JOIN qlen USING (qid) WHERE rank2 <= 100
"""


@register("rescore_working_set", _RESCORE_SQL, ("corpus", "queries"))
def rescore_working_set(spark, sf_dir):
    """R7 + P13: BM25 candidates re-scored by query likelihood inside the
    working set, scores × query length (rows-only)."""
    q, c = V.queries(spark, sf_dir), V.corpus(spark, sf_dir)
    ix = R.build_index(c)
    ws = R.working_set(R.retrieve(q, c, "bm25", 100, index=ix))
    ql = R.retrieve(q, c, "ql", 100, working_set=ws, index=ix)
    from ..operators.select import rescale_by_query_length
    return rescale_by_query_length(ql, _query_tokens(spark, sf_dir)).select("qid", "did", "rank", r6("score").alias("score"))


_RM_SQL = _retrieval_sql("bm25").split("SELECT qid, did, rank, round(score, 6) AS score FROM rk WHERE rank <= 100")[0] + f""",
  top AS (SELECT qid, did, score FROM rk WHERE rank <= 10),
  w AS (SELECT qid, did, exp(score - max(score) OVER (PARTITION BY qid)) AS z FROM top),
  wn AS (SELECT qid, did, z / sum(z) OVER (PARTITION BY qid) AS w FROM w),
  rm0 AS (SELECT wn.qid, p.term, sum(wn.w * p.tf / l.dl) AS p FROM wn JOIN post p USING (did) JOIN lens l USING (did)
          GROUP BY wn.qid, p.term),
  rm1 AS (SELECT * FROM rm0 WHERE term NOT IN (SELECT term FROM {STOP_SQL})),
  rm AS (SELECT qid, term, p / sum(p) OVER (PARTITION BY qid) AS p FROM rm1),
  pq AS (SELECT qid, term, qtf / sum(qtf) OVER (PARTITION BY qid) AS pq FROM qt),
  mix AS (SELECT coalesce(pq.qid, rm.qid) AS qid, coalesce(pq.term, rm.term) AS term,
                 0.5 * coalesce(pq.pq, 0) + 0.5 * coalesce(rm.p, 0) AS p
          FROM pq FULL JOIN rm ON pq.qid = rm.qid AND pq.term = rm.term),
  rk2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(p, 12) DESC, term) AS rank FROM mix)
SELECT qid, term, rank, round(p, 6) AS p FROM rk2 WHERE rank <= 20
"""


@register("relevance_model", _RM_SQL, ("corpus", "queries"))
def relevance_model(spark, sf_dir):
    """R1 + R2 + R5: RM1 from the top 10 BM25 documents, stop words removed,
    interpolated with the query model (lambda 0.5); top 20 terms."""
    q, c = V.queries(spark, sf_dir), V.corpus(spark, sf_dir)
    ix = R.build_index(c)
    run = R.retrieve(q, c, "bm25", 10, index=ix)
    rm = R.relevance_model(run, c, 10, X.stopwords_df(spark), index=ix)
    mix = R.rm3_interpolate(q, rm, 0.5)
    top = R.rm_top_terms(mix.withColumn("p", F.round("p", 12)), 20)
    return top.select("qid", "term", "rank", r6("p").alias("p"))


_RM3_SQL = _RM_SQL.split("  pq AS")[0].rstrip().rstrip(",") + f""",
  grid AS (SELECT unnest([0.0, 0.5, 1.0]) AS lam, n FROM (SELECT unnest([5, 10]) AS n) z),
  pos AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(p, 12) DESC, term) AS r FROM rm),
  model AS (SELECT qid, n, '#weight( ' || string_agg(printf('%.6f %s', p, term), ' ' ORDER BY r) || ' )' AS m
            FROM pos JOIN (SELECT DISTINCT n FROM grid) g ON r <= n GROUP BY qid, n),
  orig AS (SELECT qid, '#combine( ' || lower(translate(text, {PUNCT_SQL}, '')) || ' )' AS o FROM queries)
SELECT qid, CAST(lam AS DOUBLE) AS lam, grid.n AS nterms,
       CASE lam WHEN 1.0 THEN o WHEN 0.0 THEN m ELSE printf('#weight( %.2f %s %.2f %s )', lam, o, 1 - lam, m) END AS query
FROM grid JOIN model ON model.n = grid.n JOIN orig USING (qid)
"""


@register("rm3_queries", _RM3_SQL, ("corpus", "queries"))
def rm3_queries(spark, sf_dir):
    """R3 + R4: expanded query strings for a lambda x nterms sweep."""
    q, c = V.queries(spark, sf_dir), V.corpus(spark, sf_dir)
    ix = R.build_index(c)
    rm = R.relevance_model(R.retrieve(q, c, "bm25", 10, index=ix), c, 10, X.stopwords_df(spark), index=ix)
    return R.rm3_sweep(q, rm, [0.0, 0.5, 1.0], [5, 10])


_READ_SQL = r"""
WITH w AS (SELECT did, text, regexp_extract_all(lower(text), '[a-z]+') AS ws,
                  greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS sentences,
                  greatest(len(regexp_extract_all(regexp_extract(text, '^(?:[^A-Za-z]*[A-Za-z]+){0,100}[^A-Za-z]*'), '[.!?]+')), 1) AS sample FROM corpus),
  s AS (SELECT did, sentences, sample, ws, list_transform(ws, lambda x: greatest(len(regexp_extract_all(x, '[aeiouy]+')), 1)) AS syl FROM w),
  t AS (SELECT did, word, count(*) AS n FROM (SELECT did, unnest(ws) AS word FROM w) x GROUP BY did, word),
  easy AS (SELECT word FROM t GROUP BY word HAVING count(*) >= 0.05 * (SELECT count(*) FROM corpus)),
  u AS (SELECT did, sum(n) AS outside, count_if(greatest(len(regexp_extract_all(word, '[aeiouy]+')), 1) >= 2) AS difficult
        FROM t WHERE word NOT IN (SELECT word FROM easy) GROUP BY did),
  b AS (SELECT s.did, sentences, nullif(len(ws), 0) AS words, list_sum(list_transform(ws, lambda x: length(x))) AS letters,
               list_sum(syl) AS syllables, len(list_filter(syl, lambda x: x >= 3)) AS poly,
               list_sum(list_transform(syl[1:100], lambda x: CASE WHEN x >= 3 THEN 3 ELSE 1 END)) / sample AS points,
               CASE WHEN len(ws) > 0 THEN coalesce(outside, 0) END AS outside, CASE WHEN len(ws) > 0 THEN coalesce(difficult, 0) END AS difficult
        FROM s LEFT JOIN u USING (did)),
  m AS (SELECT did, sentences, coalesce(words, 0) AS words,
    206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words) AS flesch_ease,
    0.39 * (words / sentences) + 11.8 * (syllables / words) - 15.59 AS fk_grade,
    CASE WHEN words > 0 THEN 1.043 * sqrt(poly * (30.0 / sentences)) + 3.1291 END AS smog,
    0.0588 * (letters / words * 100) - 0.296 * (sentences / words * 100) - 15.8 AS coleman_liau,
    4.71 * (letters / words) + 0.5 * (words / sentences) - 21.43 AS ari,
    0.4 * ((words / sentences) + 100.0 * (poly / words)) AS gunning_fog, difficult,
    0.1579 * (outside / words * 100) + 0.0496 * (words / sentences) + CASE WHEN outside / words * 100 > 5 THEN 3.6365 ELSE 0 END AS dale_chall,
    CASE WHEN points > 20 THEN points / 2 ELSE (points - 2) / 2 END AS linsear FROM b),
  v AS (SELECT did, unnest(list_concat(flatten(list_transform([fk_grade, smog, coleman_liau, ari, dale_chall, linsear, gunning_fog],
               lambda g: [CAST(round(round(g, 9)) AS INTEGER), CAST(ceil(round(g, 9)) AS INTEGER)])),
               CASE WHEN flesch_ease >= 90 THEN [5] WHEN flesch_ease >= 80 THEN [6] WHEN flesch_ease >= 70 THEN [7] WHEN flesch_ease >= 60 THEN [8, 9]
                    WHEN flesch_ease >= 50 THEN [10] WHEN flesch_ease >= 40 THEN [11] WHEN flesch_ease >= 30 THEN [12] ELSE [13] END)) AS g
        FROM m WHERE words > 0),
  c AS (SELECT did, g AS consensus FROM (SELECT did, g, row_number() OVER (PARTITION BY did ORDER BY count(*) DESC, g) AS k FROM v GROUP BY did, g) x WHERE k = 1)
"""
_MEASURES = [c for c in X.READABILITY if c not in ("difficult", "consensus")]


def _readability(spark, sf_dir):
    docs = V.corpus(spark, sf_dir)
    return X.readability(docs, "did", easy=X.frequent_words(docs, 0.05))


@register("readability", _READ_SQL + f"""
SELECT did, CAST(sentences AS INTEGER) AS sentences, CAST(words AS INTEGER) AS words, CAST(difficult AS BIGINT) AS difficult, consensus, {", ".join(f"round({c}, 6) AS {c}" for c in _MEASURES)}
FROM m LEFT JOIN c USING (did)
""", ("corpus",))
def readability(spark, sf_dir):
    """Readability formulas per document (whole texts); easy words are those of at
    least 5 % of the documents."""
    r = _readability(spark, sf_dir)
    return r.select("did", F.col("sentences").cast("int").alias("sentences"), F.col("words").cast("int").alias("words"), "difficult", "consensus",
                    *[r6(c).alias(c) for c in _MEASURES])


@register("readability_means", _READ_SQL + f"""
SELECT {", ".join(f"round(avg({c}), 6) AS {c}" for c in X.READABILITY)} FROM m LEFT JOIN c USING (did)
""", ("corpus",))
def readability_means(spark, sf_dir):
    """The mean of every measure over all documents."""
    m = X.readability_means(_readability(spark, sf_dir))
    return m.select(*[r6(c).alias(c) for c in X.READABILITY])


def _pairs(spark, sf_dir):
    """(pid, hyp, ref): each user turn and the assistant turn after it."""
    cv = V.table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = cv.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("nrole"),
                    F.lead("text").over(w).alias("ntext"))
    p = nxt.where((F.col("role") == "user") & (F.col("nrole") == "assistant"))
    return p.select(F.struct("conv_id", "turn").alias("pid"), X.tokenize(F.col("ntext")).alias("hyp"),
                    X.tokenize(F.col("text")).alias("ref"), "conv_id", "turn")


_PAIRS_SQL = f"""p AS (SELECT conv_id, turn, regexp_extract_all(lower(ntext), {TOK}) AS hyp,
                        regexp_extract_all(lower(text), {TOK}) AS ref
                 FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole,
                              lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ntext FROM conversations) x
                 WHERE role = 'user' AND nrole = 'assistant')"""


def _rouge_sql(n: int) -> str:
    g = lambda side: (f"SELECT conv_id, turn, unnest(list_transform(range(1, len({side}) - {n} + 2), "  # noqa: E731
                      f"lambda i: array_to_string({side}[i:i + {n - 1}], ' '))) AS g FROM p WHERE len({side}) >= {n}")
    return f"""
  h{n} AS (SELECT conv_id, turn, g, count(*) AS ch FROM ({g('hyp')}) x GROUP BY ALL),
  r{n} AS (SELECT conv_id, turn, g, count(*) AS cr FROM ({g('ref')}) x GROUP BY ALL),
  o{n} AS (SELECT conv_id, turn, sum(least(ch, cr)) AS ov FROM h{n} JOIN r{n} USING (conv_id, turn, g) GROUP BY ALL),
  s{n} AS (SELECT p.conv_id, p.turn, greatest(len(hyp) - {n} + 1, 0) AS nh, greatest(len(ref) - {n} + 1, 0) AS nr,
                  coalesce(ov, 0) AS ov FROM p LEFT JOIN o{n} USING (conv_id, turn)),
  f{n} AS (SELECT conv_id, turn, CASE WHEN nh > 0 THEN ov / nh ELSE 0 END AS pr, CASE WHEN nr > 0 THEN ov / nr ELSE 0 END AS rc
           FROM s{n})"""


@register("rouge_n", f"""
WITH {_PAIRS_SQL}, {_rouge_sql(1)}, {_rouge_sql(2)}
SELECT f1.conv_id, f1.turn, round(f1.pr, 6) AS p1, round(f1.rc, 6) AS r1,
       round(CASE WHEN f1.pr + f1.rc > 0 THEN 2 * f1.pr * f1.rc / (f1.pr + f1.rc) ELSE 0 END, 6) AS f1,
       round(f2.pr, 6) AS p2, round(f2.rc, 6) AS r2,
       round(CASE WHEN f2.pr + f2.rc > 0 THEN 2 * f2.pr * f2.rc / (f2.pr + f2.rc) ELSE 0 END, 6) AS f2
FROM f1 JOIN f2 USING (conv_id, turn)
""", ())
def rouge_n(spark, sf_dir):
    """ROUGE-1 and ROUGE-2 of each assistant reply against the user turn
    before it."""
    pairs = _pairs(spark, sf_dir)
    a = X.rouge_n(pairs, 1).select("pid", r6("precision").alias("p1"), r6("recall").alias("r1"), r6("f").alias("f1"))
    b = X.rouge_n(pairs, 2).select("pid", r6("precision").alias("p2"), r6("recall").alias("r2"), r6("f").alias("f2"))
    return a.join(b, "pid").select(F.col("pid.conv_id").alias("conv_id"), F.col("pid.turn").alias("turn"),
                                   "p1", "r1", "f1", "p2", "r2", "f2")


# Places of equal tokens in order, as one-element lists after an empty one; reduced to
# the least last place per length of an increasing subsequence.
_LCS_SQL = """mt AS MATERIALIZED (SELECT conv_id, turn, list_prepend([]::BIGINT[], flatten(list_transform(hyp, lambda t:
      list_transform(list_reverse(list_filter(range(1, len(ref) + 1), lambda j: ref[j] = t)), lambda j: [j])))) AS m FROM p),
  ll AS (SELECT conv_id, turn, len(list_reduce(m, lambda s, x: CASE WHEN len(s) = 0 OR s[-1] < x[1] THEN list_concat(s, x)
      ELSE list_concat(list_concat(s[:len(list_filter(s, lambda e: e < x[1]))], x), s[len(list_filter(s, lambda e: e < x[1])) + 2:]) END)) AS lcs FROM mt),
  fl AS (SELECT p.conv_id, p.turn, CASE WHEN len(hyp) > 0 THEN coalesce(lcs, 0) / len(hyp) ELSE 0 END AS pr,
                CASE WHEN len(ref) > 0 THEN coalesce(lcs, 0) / len(ref) ELSE 0 END AS rc FROM p LEFT JOIN ll USING (conv_id, turn))"""
_F_SQL = "CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END"


@register("rouge_l", f"""
WITH {_PAIRS_SQL}, {_LCS_SQL}
SELECT conv_id, turn, round(pr, 6) AS p, round(rc, 6) AS r, round({_F_SQL}, 6) AS f FROM fl
""")
def rouge_l(spark, sf_dir):
    """ROUGE-L per pair."""
    r = X.rouge_l(_pairs(spark, sf_dir))
    return r.select(F.col("pid.conv_id").alias("conv_id"), F.col("pid.turn").alias("turn"),
                    r6("precision").alias("p"), r6("recall").alias("r"), r6("f").alias("f"))


@register("rouge_means", f"""
WITH {_PAIRS_SQL}, {_rouge_sql(1)}, {_rouge_sql(2)}, {_LCS_SQL},
  every AS (SELECT 'rouge_1' AS measure, pr, rc FROM f1 UNION ALL SELECT 'rouge_2', pr, rc FROM f2 UNION ALL SELECT 'rouge_l', pr, rc FROM fl)
SELECT measure, round(avg(pr), 6) AS p, round(avg(rc), 6) AS r, round(avg({_F_SQL}), 6) AS f FROM every GROUP BY measure
""")
def rouge_means(spark, sf_dir):
    """Means over all pairs of ROUGE-1, -2 and -L."""
    m = X.rouge_means(_pairs(spark, sf_dir))
    return m.select("measure", r6("precision").alias("p"), r6("recall").alias("r"), r6("f").alias("f"))


@register("bigram_perplexity", f"""
WITH dt AS (SELECT list_concat(['<s>'], regexp_extract_all(lower(text), {TOK})) AS t FROM corpus),
  bi AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: {{'w1': t[i], 'w2': t[i + 1]}})) AS b FROM dt),
  bic AS (SELECT b.w1 AS w1, b.w2 AS w2, count(*) AS c12 FROM bi GROUP BY ALL),
  hist AS (SELECT w1, sum(c12) AS c1 FROM bic GROUP BY w1),
  v AS (SELECT count(DISTINCT w) + 1 AS vs FROM (SELECT unnest(regexp_extract_all(lower(text), {TOK})) AS w FROM corpus) x),
  qt AS (SELECT qid, list_concat(['<s>'], regexp_extract_all(lower(translate(text, {PUNCT_SQL}, '')), {TOK})) AS t FROM queries),
  qb AS (SELECT qid, unnest(list_transform(range(1, len(t)), lambda i: {{'w1': t[i], 'w2': t[i + 1]}})) AS b FROM qt WHERE len(t) > 1),
  j AS (SELECT qid, ln((coalesce(c12, 0) + 1.0) / (coalesce(c1, 0) + 1.0 * v.vs)) AS lp
        FROM qb LEFT JOIN bic ON bic.w1 = qb.b.w1 AND bic.w2 = qb.b.w2 LEFT JOIN hist ON hist.w1 = qb.b.w1, v)
SELECT qid, count(*) AS n, round(sum(lp), 6) AS logprob, round(exp(-sum(lp) / count(*)), 6) AS perplexity FROM j GROUP BY qid
""", ("corpus", "queries"))
def bigram_perplexity(spark, sf_dir):
    """Add-one bigram perplexity of every benchmark text under a model
    trained on all documents."""
    out = X.ngram_perplexity(_query_tokens(spark, sf_dir), "qid", _corpus_tokens(spark, sf_dir), 1.0)
    return out.select("qid", "n", r6("logprob").alias("logprob"), r6("perplexity").alias("perplexity"))


BPE_ROUNDS, BPE_BATCH = 8, 128


def _bpe_sql() -> str:
    """One pair of CTEs a round: r, the rules, and w, the rewritten words."""
    out = [f"""w0 AS MATERIALIZED (SELECT term, count(*) AS tf, regexp_replace(term, '(.)', chr(2) || '\\1' || chr(3), 'gs') AS s
  FROM (SELECT unnest(regexp_extract_all(lower(text), {TOK})) AS term FROM corpus) x GROUP BY term)"""]
    for i in range(BPE_ROUNDS):
        made = " UNION ALL ".join(f"SELECT a || b AS m FROM r{j}" for j in range(i)) or "SELECT '' AS m"
        out.append(f"""c{i} AS (SELECT a, b, sum(tf) AS n FROM (
    SELECT tf, unnest(y[:-2]) AS a, unnest(y[2:]) AS b FROM (SELECT tf, string_split(s[2:-2], chr(3) || chr(2)) AS y FROM w{i}) z WHERE len(y) > 1) p GROUP BY a, b),
  r{i} AS MATERIALIZED (SELECT a, b, row_number() OVER (ORDER BY n DESC, a, b) AS k
    FROM (SELECT *, row_number() OVER (PARTITION BY a || b ORDER BY n DESC, a, b) AS d FROM c{i}) q
    WHERE d = 1 AND a || b NOT IN ({made}) ORDER BY k LIMIT {BPE_BATCH}),
  l{i} AS MATERIALIZED (SELECT list(chr(2) || a || chr(3) || chr(2) || b || chr(3) ORDER BY k) AS rules FROM r{i}),
  w{i + 1} AS MATERIALIZED (SELECT term, tf, list_reduce(list_prepend(s, coalesce(rules, [])), lambda x, p: replace(x, p, replace(p, chr(3) || chr(2), ''))) AS s
    FROM w{i}, l{i})""")
    return "WITH " + ",\n  ".join(out) + f"\nSELECT term, array_to_string(string_split(s[2:-2], chr(3) || chr(2)), ' ') AS subwords FROM w{BPE_ROUNDS}"


@register("bpe_segments", _bpe_sql(), ("corpus",))
def bpe_segments(spark, sf_dir):
    """1,024 merges learned in rounds from all corpus words, applied to every
    distinct word."""
    stats = materialize(_term_stats(_corpus_tokens(spark, sf_dir)), "words")
    return X.apply_merges(stats, X.learn_merges(stats, BPE_ROUNDS, BPE_BATCH))


@register("pairwise_l2", """
WITH p AS (SELECT vec_id AS id_a, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS id_b FROM embeddings),
  j AS (SELECT p.id_a, p.id_b, a.embedding AS va, b.embedding AS vb FROM p
        JOIN embeddings a ON a.vec_id = p.id_a JOIN embeddings b ON b.vec_id = p.id_b)
SELECT id_a, id_b, round(sqrt(list_sum(list_transform(range(1, len(va) + 1),
       lambda i: (CAST(va[i] AS DOUBLE) - CAST(vb[i] AS DOUBLE)) * (CAST(va[i] AS DOUBLE) - CAST(vb[i] AS DOUBLE))))), 6) AS l2
FROM j
""", ())
def pairwise_l2(spark, sf_dir):
    """L2 distance between each vector and the next one of its label
    (a pair list linear in the data)."""
    emb = V.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double"))
                                                       .alias("embedding"), "label")
    # position within the label with the skew-aware ranker (a label holds a
    # third of all vectors), then each position joined to the next one
    from ..operators.rank import rank_rows
    pos = rank_rows(emb.select("vec_id", "label"), ["label"], [F.col("vec_id")], "pos")
    nxt = pos.select("label", (F.col("pos") - 1).alias("pos"), F.col("vec_id").alias("id_b"))
    pairs = pos.join(nxt, ["label", "pos"]).select(F.col("vec_id").alias("id_a"), "id_b")
    out = R.pairwise_l2(emb, pairs)
    return out.select("id_a", "id_b", r6("l2").alias("l2"))
