"""Text functions (X1-X10) as built-in column expressions and DataFrame jobs.

Everything per-row is a JVM expression (``regexp_extract_all``, ``translate``,
``regexp_replace``, ``transform``); corpus-level work (vocabularies, n-gram
counts, lexicon lookups) is explode → join → groupBy. Only BPE application
(X6) and ROUGE-L (X7) run Python, as pandas UDFs over batches.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small

# ---- fixed values --------------------------------------------------------
# Our own English stop-word list (function words), alphabetical.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below "
    "between both but by can could did do does doing down during each few for from further had has have "
    "having he her here hers herself him himself his how i if in into is it its itself just me more most "
    "my myself no nor not now of off on once only or other our ours ourselves out over own same she should "
    "so some such than that the their theirs them themselves then there these they this those through to "
    "too under until up very was we were what when where which while who whom why will with would you your "
    "yours yourself yourselves"
).split()
# ASCII punctuation deleted by strip_punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Letters without a decomposition, and signs, with their ASCII spelling.
SPELLED = (
    "ß ss  ẞ SS  æ ae  Æ AE  œ oe  Œ OE  ø o  Ø O  đ d  Đ D  ð d  Ð D  þ th  Þ Th  ł l  Ł L  ħ h  Ħ H  ı i  ŧ t  Ŧ T  ŋ ng  Ŋ Ng  "
    "а a  б b  в v  г g  д d  е e  ё io  ж zh  з z  и i  й i  к k  л l  м m  н n  о o  п p  р r  с s  т t  у u  ф f  х kh  ц ts  ч ch  "
    "ш sh  щ shch  ъ \"  ы y  ь '  э e  ю iu  я ia  і i  ї yi  є ye  ґ g  "
    "А A  Б B  В V  Г G  Д D  Е E  Ё Io  Ж Zh  З Z  И I  Й I  К K  Л L  М M  Н N  О O  П P  Р R  С S  Т T  У U  Ф F  Х Kh  Ц Ts  Ч Ch  "
    "Ш Sh  Щ Shch  Ъ \"  Ы Y  Ь '  Э E  Ю Iu  Я Ia  І I  Ї Yi  Є Ye  Ґ G  "
    "α a  β b  γ g  δ d  ε e  ζ z  η e  θ th  ι i  κ k  λ l  μ m  ν n  ξ x  ο o  π p  ρ r  σ s  ς s  τ t  υ u  φ ph  χ kh  ψ ps  ω o  "
    "Α A  Β B  Γ G  Δ D  Ε E  Ζ Z  Η E  Θ Th  Ι I  Κ K  Λ L  Μ M  Ν N  Ξ X  Ο O  Π P  Ρ R  Σ S  Τ T  Υ U  Φ Ph  Χ Kh  Ψ Ps  Ω O  "
    "‘ '  ’ '  ‚ ,  “ \"  ” \"  „ \"  « <<  » >>  – -  — --  … ...  • *  € EUR"
).split()
# Blocks whose characters are spelled by their compatibility decomposition, marks left out.
DECOMPOSED = ((0xA0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0x2000, 0x2070), (0x3000, 0x3001), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))
# The characters of Windows-1252 for the bytes 0x80 to 0x9F that it defines, and those bytes.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = "80 82 83 84 85 86 87 88 89 8A 8B 8C 8E 91 92 93 94 95 96 97 98 99 9A 9B 9C 9E 9F".split()
# Token pattern: runs of letters or digits (any script).
TOKEN_RE = r"[\p{L}\p{N}]+"
# -------------------------------------------------------------------------


def tokenize(text: Column) -> Column:
    """Lower-cased word tokens, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_RE), 0)


def strip_punctuation(text: Column) -> Column:
    """Delete ASCII punctuation."""
    return F.translate(text, PUNCTUATION, "")


def _spellings() -> dict[str, str]:
    """Character → ASCII."""
    out = dict(zip(SPELLED[::2], SPELLED[1::2], strict=True))
    for lo, hi in DECOMPOSED:
        for ch in map(chr, range(lo, hi)):
            plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
            plain = "".join(out.get(c, c) for c in plain)
            if ch not in out and plain and plain.isascii():
                out[ch] = plain
    return out


def transliterate(text: Column) -> Column:
    """Accented, Greek and Cyrillic letters, ligatures, typographic and full-width signs
    in ASCII; letters of other scripts stay as they are. Combining marks over Latin,
    Greek and Cyrillic letters go."""
    table = _spellings()
    one = {c: t for c, t in table.items() if len(t) == 1}
    more = {c: t for c, t in table.items() if len(t) > 1}
    t = F.translate(text, "".join(one), "".join(one.values()))
    t = F.regexp_replace(t, "[\\x{300}-\\x{36f}]", "")
    several = t
    for c, spelled in more.items():
        several = F.replace(several, F.lit(c), F.lit(spelled))
    t = F.when(t.rlike("[" + "".join(more) + "]"), several).otherwise(t)
    return F.when(text.rlike(r"[^\x00-\x7F]"), t).otherwise(text)


# A letter of Latin, Greek or Cyrillic (two bytes, of the rarer Latin ones only those that
# Windows-1252 makes of bytes) or a longer sequence of UTF-8, each byte read as a character
# of Windows-1252 or Latin-1.
_LATER = "[\\x{80}-\\x{bf}" + CP1252 + "]"
_TWICE = f"(?:Â[\\x{{80}}-\\x{{bf}}]|Æ[\\x{{92}}’]|Ë[\\x{{86}}\\x{{9c}}†œ]|[ÃÄÅÎÏÐÑ]{_LATER}|[à-ï]{_LATER}{{2}}|[ð-ô]{_LATER}{{3}})"


def repair_text(text: Column) -> Column:
    """Text that was encoded as UTF-8 and read as Windows-1252 or Latin-1, once or
    several times, is read as it was meant: runs of such characters are turned back
    into bytes and decoded, until none is left that decodes. A layer at least doubles
    a character, so the logarithm of the length bounds the rounds."""
    parts = lambda t: F.regexp_extract_all(t, F.lit(f"{_TWICE}+|[^Â-ô]+|[Â-ô]"), 0)

    def decoded(seg: Column) -> Column:
        raw = F.encode(F.translate(seg, CP1252, "".join(chr(int(b, 16)) for b in CP1252_BYTES)), "ISO-8859-1")
        return F.when(seg.rlike(f"^{_TWICE}+$"), F.coalesce(F.try_validate_utf8(raw.cast("string")), seg)).otherwise(seg)

    def again(t: Column, _: Column) -> Column:
        return F.when(t.rlike(_TWICE), F.array_join(F.transform(parts(t), decoded), "")).otherwise(t)
    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.length(text), F.lit(1)))).cast("int"))
    return F.when(text.rlike(_TWICE), F.aggregate(rounds, text, again)).otherwise(text)


def clean_text(text: Column, lower: bool = True, alnum: bool = True) -> Column:
    """Repair doubly encoded text, transliterate to ASCII, keep only letters,
    marks and digits inside tokens (of any script; tokens left empty vanish),
    lower-case, collapse spaces."""
    t = transliterate(repair_text(text))
    if alnum:
        t = F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}\s]", "")
    if lower:
        t = F.lower(t)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def stopwords_df(spark) -> DataFrame:
    """The stop-word table (small, fixed size: safe to broadcast)."""
    return spark.createDataFrame([(w,) for w in STOPWORDS], "term string")


def explode_tokens(df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, pos, term) rows, pos 1-based."""
    ex = df.select(key, F.posexplode_outer(tokens).alias("pos", "term")).where(F.col("term").isNotNull())
    return ex.withColumn("pos", F.col("pos") + 1)


def normalize_tokens(df: DataFrame, key: str, tokens: str, lexicon: DataFrame | None = None,
                     stopwords: DataFrame | None = None, ascii_only: bool = False) -> DataFrame:
    """Optional stop-word removal, lemma lookup in a (token, lemma)
    lexicon (identity when absent), optional non-ASCII removal; tokens are
    reassembled in order per key. Output (key, tokens)."""
    ex = explode_tokens(df, key, tokens)
    if stopwords is not None:            # by surface form, before the lemma lookup
        ex = ex.join(broadcast_if_small(stopwords.select("term")), "term", "left_anti")
    if lexicon is not None:
        lx = lexicon.select(F.col("token").alias("term"), "lemma")
        ex = ex.join(broadcast_if_small(lx), "term", "left") \
            .withColumn("term", F.coalesce("lemma", "term")).drop("lemma")
    if ascii_only:
        ex = ex.withColumn("term", F.regexp_replace("term", r"[^\x00-\x7F]", "")).where(F.col("term") != "")
    agg = F.array_sort(F.collect_list(F.struct("pos", "term")))
    out = ex.groupBy(key).agg(F.transform(agg, lambda s: s["term"]).alias(tokens))
    # keys whose every token was removed keep an empty list
    return df.select(key).join(out, key, "left").withColumn(
        tokens, F.coalesce(F.col(tokens), F.array().cast(T.ArrayType(T.StringType()))))


def plural_lexicon(vocab: DataFrame) -> DataFrame:
    """A (token, lemma) lexicon derived from a vocabulary: a token ending in
    's' maps to the same token without it when that form also occurs."""
    v = vocab.select("term")
    cand = v.where(F.col("term").endswith("s") & (F.length("term") > 3)) \
        .select(F.col("term").alias("token"), F.expr("substring(term, 1, length(term) - 1)").alias("lemma"))
    return cand.join(v.select(F.col("term").alias("lemma")), "lemma", "left_semi")


def build_vocab(stats: DataFrame, specials: int = 3) -> DataFrame:
    """Term ids from term statistics (G16): most frequent first, ids after
    the special ids (0 pad, 1 unknown, 2 start). Global order goes through
    the skew-aware ranker (range partitioned, never one task)."""
    from ..operators.rank import global_rank
    r = global_rank(stats.select("term", "tf"), [F.col("tf").desc(), F.col("term")], "_r")
    return r.select("term", (F.col("_r") + specials - 1).cast("int").alias("term_id"))


def encode_tokens(df: DataFrame, key: str, tokens: str, vocab: DataFrame, max_length: int,
                  pad_id: int = 0, unk_id: int = 1, start_id: int | None = 2, end_id: int | None = None) -> DataFrame:
    """Tokens → ids (unknown → unk_id), optional start and end id, truncated
    to max_length and padded with pad_id (A1). Truncation takes tokens, never the
    special ids. Output (key, ids)."""
    ex = explode_tokens(df, key, tokens)
    ids = ex.join(vocab, "term", "left").withColumn("term_id", F.coalesce("term_id", F.lit(unk_id)))
    seq = ids.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term_id"))),
                                           lambda s: s["term_id"]).alias("_ids"))
    seq = df.select(key).join(seq, key, "left").withColumn(
        "_ids", F.coalesce("_ids", F.array().cast(T.ArrayType(T.IntegerType()))))
    special = [x for x in (start_id, end_id) if x is not None]
    if len(special) > max_length:
        raise ValueError(f"max_length {max_length} has no room for {len(special)} special ids")
    seq = seq.withColumn("_ids", F.slice("_ids", 1, max_length - len(special)))
    if start_id is not None:
        seq = seq.withColumn("_ids", F.concat(F.array(F.lit(start_id)), F.col("_ids")))
    if end_id is not None:
        seq = seq.withColumn("_ids", F.concat(F.col("_ids"), F.array(F.lit(end_id))))
    from .arrays import pad_to
    return seq.select(key, pad_to(F.col("_ids"), max_length, pad_id).alias("ids"))


def decode_ids(df: DataFrame, key: str, ids: str, vocab: DataFrame, skip=(0, 1, 2)) -> DataFrame:
    """Id sequences → text by vocabulary lookup, order kept (special
    ids dropped)."""
    ex = df.select(key, F.posexplode(ids).alias("pos", "term_id")).where(~F.col("term_id").isin(list(skip)))
    j = ex.join(vocab, "term_id")
    out = j.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))),
                                                      lambda s: s["term"]), " ").alias("text"))
    return df.select(key).join(out, key, "left").withColumn("text", F.coalesce("text", F.lit("")))


# ---- X6: subword merges ----------------------------------------------------
# A word's symbols are kept in one string, each between OPEN and CLOSE, so that
# merging a pair everywhere is a plain replacement.
OPEN, CLOSE, RULE_END = "\x02", "\x03", "\x01"


def _symbols(word: Column) -> Column:
    return F.regexp_replace(word, "(?s)(.)", OPEN + "$1" + CLOSE)


def _symbol_list(s: Column) -> Column:
    return F.split(F.substring(s, F.lit(2), F.length(s) - 2), CLOSE + OPEN)


def _marked(pair: str) -> str:
    a, b = pair.split(" ")
    return f"{OPEN}{a}{CLOSE}{OPEN}{b}{CLOSE}"


def _rules(pairs: list[str]) -> Column:
    """The marked pairs in order, as one constant array."""
    return F.split(F.lit(RULE_END.join(map(_marked, pairs))), RULE_END)


def _merged(s: Column, pair: Column) -> Column:
    return F.replace(s, pair, F.replace(pair, F.lit(CLOSE + OPEN), F.lit("")))


def learn_merges(words: DataFrame, rounds: int, batch: int) -> DataFrame:
    """Merge rules (pair, rank) learned from distinct words (term, tf), so that rules
    build on rules. Each round counts the adjacent symbols of all words (one
    aggregation, weighted by tf), takes the ``batch`` most frequent pairs, ties by
    pair, and rewrites the words with them in order; the rewritten words are a stored
    table. A symbol is made by one rule only (of pairs that give the same string the
    most frequent one counts), hence every rule comes after those it builds on. The
    driver holds the rules, rounds x batch at most."""
    from ..session import materialize
    spark = words.sparkSession
    w = materialize(words.where(F.length("term") > 0).select("term", "tf", _symbols(F.col("term")).alias("s")), "symbols")
    rules: list[str] = []
    for _ in range(rounds):
        sym = _symbol_list(F.col("s"))
        open_ = w.where(F.instr("s", CLOSE + OPEN) > 0).select("tf", sym.alias("y"))
        pairs = open_.select("tf", F.explode(F.transform(F.sequence(F.lit(1), F.size("y") - 1),
                                                         lambda i: F.struct(F.element_at("y", i).alias("a"), F.element_at("y", i + 1).alias("b")))).alias("p"))
        count = pairs.groupBy("p.a", "p.b").agg(F.sum("tf").alias("n"))
        best = count.groupBy(F.concat("a", "b").alias("merged")).agg(F.min(F.struct((-F.col("n")).alias("n"), "a", "b")).alias("p"))
        if rules:
            made = spark.createDataFrame([(r.replace(" ", ""),) for r in rules], "merged string")
            best = best.join(F.broadcast(made), "merged", "left_anti")         # rounds x batch strings at most
        new = [f"{r.a} {r.b}" for r in best.select("p.*").orderBy("n", "a", "b").limit(batch).collect()]
        if not new:
            break
        rules += new
        w = materialize(w.withColumn("s", F.aggregate(_rules(new), F.col("s"), _merged)), "symbols")
    return spark.createDataFrame([(r, i + 1) for i, r in enumerate(rules)], "pair string, rank int")


def apply_merges(words: DataFrame, merges: DataFrame, col: str = "term") -> DataFrame:
    """(word, subwords): each *distinct* word cut by the rules (pair, rank). As long
    as a rule fits, the one of lowest rank merges all its occurrences, left to right.
    Only rules whose symbol is a part of the word can ever fit, so the steps run over
    those few. JVM expressions; the rules are one constant of the plan, as they are the
    model: a few thousand strings."""
    rules = [r["pair"] for r in merges.orderBy("rank").collect()]
    d = words.select(col).distinct()
    if not rules:
        return d.withColumn("subwords", F.array_join(_symbol_list(_symbols(F.col(col))), " "))
    plain = lambda r: F.translate(r, OPEN + CLOSE, "")
    d = d.withColumn("_r", F.filter(_rules(rules), lambda r: F.contains(F.col(col), plain(r)))).withColumn("_s", _symbols(F.col(col)))

    def step(s: Column, _: Column) -> Column:
        fits = F.get(F.filter(F.col("_r"), lambda r: F.contains(s, r)), F.lit(0))
        return F.when(F.instr(s, CLOSE + OPEN) == 0, s).otherwise(F.coalesce(_merged(s, fits), s))
    steps = F.when(F.size("_r") > 0, F.sequence(F.lit(1), F.greatest(F.length(col), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_s", F.aggregate(steps, F.col("_s"), step))
    return d.select(col, F.when(F.length(col) > 0, F.array_join(_symbol_list(F.col("_s")), " ")).otherwise(F.col(col)).alias("subwords"))


# ---- X7: ROUGE ---------------------------------------------------------------

def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array."""
    return F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1),
                       lambda i: F.array_join(F.slice(tokens, i, n), " "))


def rouge_n(pairs: DataFrame, n: int) -> DataFrame:
    """ROUGE-N per pair (key ``pid``; token arrays ``hyp``, ``ref``):
    clipped n-gram overlap; precision, recall and F1. Pairs with no
    n-grams on a side score 0."""
    def grams(side):
        g = pairs.select("pid", F.explode(F.when(F.size(side) >= n, ngrams(F.col(side), n))
                                          .otherwise(F.array().cast("array<string>"))).alias("g"))
        return g.groupBy("pid", "g").agg(F.count("*").alias(f"c_{side}"))
    h, r = grams("hyp"), grams("ref")
    ov = h.join(r, ["pid", "g"]).groupBy("pid").agg(F.sum(F.least("c_hyp", "c_ref")).alias("overlap"))
    tot = pairs.select("pid", F.greatest(F.size("hyp") - n + 1, F.lit(0)).alias("nh"),
                       F.greatest(F.size("ref") - n + 1, F.lit(0)).alias("nr"))
    j = tot.join(ov, "pid", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    p = F.when(F.col("nh") > 0, F.col("overlap") / F.col("nh")).otherwise(0.0)
    rc = F.when(F.col("nr") > 0, F.col("overlap") / F.col("nr")).otherwise(0.0)
    out = j.select("pid", p.alias("precision"), rc.alias("recall"))
    f = F.when((F.col("precision") + F.col("recall")) > 0,
               2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f", f)


def lcs_lengths(pairs: DataFrame) -> DataFrame:
    """(pid, lcs): length of the longest common subsequence of ``hyp`` and ``ref``,
    for pairs that share a token. Equal tokens are matched by a join; in order of the
    hypothesis, and from the last to the first match in the reference, the matches'
    places are a sequence whose longest increasing subsequence has that length. It
    is found by one pass that keeps, per length, the least last place so far."""
    def places(side):
        ex = pairs.select("pid", F.posexplode_outer(side).alias("at", "tok"))
        return ex.where(F.col("tok").isNotNull())
    ref = places("ref").groupBy("pid", "tok").agg(F.sort_array(F.collect_list("at"), asc=False).alias("js"))
    m = places("hyp").join(ref, ["pid", "tok"]).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("at", "js"))).alias("m"))
    seq = F.flatten(F.transform("m", lambda x: x["js"]))

    def step(ends: Column, j: Column) -> Column:
        # Most matches change nothing or go to the end.
        below = F.when(F.coalesce(F.try_element_at(ends, F.lit(-1)) < j, F.lit(True)), F.size(ends)).otherwise(F.size(F.filter(ends, lambda e: e < j)))
        put = F.concat(F.slice(ends, F.lit(1), below), F.array(j), F.slice(ends, below + 2, F.greatest(F.size(ends) - below - 1, F.lit(0))))
        return F.when(F.array_contains(ends, j), ends).otherwise(put)
    return m.select("pid", F.size(F.aggregate(seq, F.array().cast("array<int>"), step)).alias("lcs"))


def _f1(out: DataFrame) -> DataFrame:
    return out.withColumn("f", F.when((F.col("precision") + F.col("recall")) > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                          .otherwise(0.0))


def rouge_l(pairs: DataFrame) -> DataFrame:
    """ROUGE-L (longest common subsequence) per pair."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    j = pairs.select("pid", size("hyp").alias("nh"), size("ref").alias("nr")).join(lcs_lengths(pairs), "pid", "left")
    lcs = F.coalesce("lcs", F.lit(0))
    p = F.when(F.col("nh") > 0, lcs / F.col("nh")).otherwise(0.0)
    rc = F.when(F.col("nr") > 0, lcs / F.col("nr")).otherwise(0.0)
    return _f1(j.select("pid", p.alias("precision"), rc.alias("recall")))


def rouge_means(pairs: DataFrame, ns=(1, 2)) -> DataFrame:
    """(measure, precision, recall, f), means over all pairs, for ROUGE-N and ROUGE-L."""
    kinds = [(f"rouge_{n}", rouge_n(pairs, n)) for n in ns] + [("rouge_l", rouge_l(pairs))]
    out = None
    for name, rows in kinds:
        one = rows.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f")]).select(F.lit(name).alias("measure"), "precision", "recall", "f")
        out = one if out is None else out.unionByName(one)
    return out


# ---- X8: readability ----------------------------------------------------------

READABILITY = ("flesch_ease", "fk_grade", "smog", "coleman_liau", "ari", "gunning_fog", "difficult", "dale_chall", "linsear", "consensus")
LINSEAR_WORDS = 100        # the measure is defined on a sample of so many words


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), 0)


def _syllables(word: Column) -> Column:
    return F.greatest(F.size(F.regexp_extract_all(word, F.lit("[aeiouy]+"), 0)), F.lit(1))


def frequent_words(df: DataFrame, share: float, text: str = "text") -> DataFrame:
    """(term) of the words that occur in at least ``share`` of the texts: a table of
    easy words for :func:`readability` where no curated one is at hand."""
    seen = df.select(F.explode(F.array_distinct(_words(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("_df"))
    n = df.count()
    return seen.where(F.col("_df") >= share * n).select("term")


def unfamiliar(df: DataFrame, key: str, easy: DataFrame, text: str = "text") -> DataFrame:
    """(key, outside, difficult): occurrences of words that the table ``easy`` (term)
    lacks, and distinct ones of them with two syllables or more."""
    w = df.select(key, F.explode(_words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    w = w.join(broadcast_if_small(easy.select("term").distinct()), "term", "left_anti")
    return w.groupBy(key).agg(F.sum("n").alias("outside"), F.count_if(_syllables(F.col("term")) >= 2).alias("difficult"))


def _consensus(grades: list[Column], ease: Column) -> Column:
    """The grade with most votes, the lowest on ties. Every measure votes for its rounded
    and its next whole grade, reading ease for the grades of its band."""
    votes = F.array(*[v for g in grades for v in (F.round(g).cast("int"), F.ceil(g).cast("int"))])
    # Reading ease bands from the easiest on, and their grades.
    band = F.array(F.lit(13))
    for least, of in ((30, (12,)), (40, (11,)), (50, (10,)), (60, (8, 9)), (70, (7,)), (80, (6,)), (90, (5,))):
        band = F.when(ease >= least, F.array(*map(F.lit, of))).otherwise(band)
    votes = F.filter(F.concat(votes, band), lambda v: v.isNotNull())
    count = F.transform(F.array_distinct(votes), lambda g: F.struct(F.size(F.filter(votes, lambda v: v == g)).alias("n"), (-g).alias("g")))
    return -F.array_max(count)["g"]


def readability(df: DataFrame, key: str, text: str = "text", easy: DataFrame | None = None) -> DataFrame:
    """Per text, counts (sentences, words, letters, syllables = vowel
    groups per word, polysyllables = words of >= 3 syllables) and the
    classic formulas: Flesch reading ease, Flesch-Kincaid grade, SMOG,
    Coleman-Liau, ARI, Gunning fog, Linsear write (first 100 words); with a table of
    ``easy`` words also difficult words and Dale-Chall (else null); and the consensus
    of all grades. A text without words has null measures."""
    base = df.select(key, F.col(text),
                     F.greatest(F.size(F.regexp_extract_all(F.col(text), F.lit(r"[.!?]+"), 0)), F.lit(1)).alias("sentences"),
                     _words(F.col(text)).alias("_w"))
    syl = F.transform("_w", _syllables)
    sample = F.regexp_extract(F.col(text), f"^(?:[^A-Za-z]*[A-Za-z]+){{0,{LINSEAR_WORDS}}}[^A-Za-z]*", 0)
    first = F.slice(syl, 1, LINSEAR_WORDS)
    b = base.select(key, "sentences", F.size("_w").alias("words"),
                    F.aggregate(F.transform("_w", lambda w: F.length(w)), F.lit(0), lambda a, x: a + x).alias("letters"),
                    F.aggregate(syl, F.lit(0), lambda a, x: a + x).alias("syllables"),
                    F.size(F.filter(syl, lambda s: s >= 3)).alias("poly"),
                    F.aggregate(first, F.lit(0), lambda a, x: a + F.when(x >= 3, 3).otherwise(1)).alias("_points"),
                    F.greatest(F.size(F.regexp_extract_all(sample, F.lit(r"[.!?]+"), 0)), F.lit(1)).alias("_sample"))
    if easy is None:
        b = b.withColumns({"outside": F.lit(None).cast("long"), "difficult": F.lit(None).cast("long")})
    else:
        b = b.join(unfamiliar(df, key, easy, text), key, "left")
        b = b.withColumns({c: F.when(F.col("words") > 0, F.coalesce(c, F.lit(0))) for c in ("outside", "difficult")})
    w, s = F.nullif("words", F.lit(0)), F.col("sentences")
    part = F.col("outside") / w * 100
    points = F.when(w > 0, F.col("_points") / F.col("_sample"))
    out = b.select(
        key, "sentences", "words", "letters", "syllables", "poly",
        (206.835 - 1.015 * (w / s) - 84.6 * (F.col("syllables") / w)).alias("flesch_ease"),
        (0.39 * (w / s) + 11.8 * (F.col("syllables") / w) - 15.59).alias("fk_grade"),
        F.when(w > 0, 1.043 * F.sqrt(F.col("poly") * (30.0 / s)) + 3.1291).alias("smog"),
        (0.0588 * (F.col("letters") / w * 100) - 0.296 * (s / w * 100) - 15.8).alias("coleman_liau"),
        (4.71 * (F.col("letters") / w) + 0.5 * (w / s) - 21.43).alias("ari"),
        (0.4 * ((w / s) + 100.0 * (F.col("poly") / w))).alias("gunning_fog"), "difficult",
        (0.1579 * part + 0.0496 * (w / s) + F.when(part > 5, 3.6365).otherwise(0.0)).alias("dale_chall"),
        F.when(points > 20, points / 2).otherwise((points - 2) / 2).alias("linsear"))
    grades = [F.round(c, 9) for c in ("fk_grade", "smog", "coleman_liau", "ari", "dale_chall", "linsear", "gunning_fog")]
    return out.withColumn("consensus", F.when(F.col("words") > 0, _consensus(grades, F.round("flesch_ease", 9))))


def readability_means(scores: DataFrame) -> DataFrame:
    """One row, the mean of every measure over the texts that have it."""
    return scores.agg(*[F.avg(c).alias(c) for c in READABILITY])


# ---- X9: bigram perplexity ------------------------------------------------------

def bigram_model(corpus: DataFrame, tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """Bigram and history counts over a corpus (each text padded with <s>)."""
    seq = corpus.select(F.concat(F.array(F.lit("<s>")), F.col(tokens)).alias("t"))
    steps = F.when(F.size("t") > 1, F.sequence(F.lit(1), F.size("t") - 1))       # none for a text without tokens
    bi = seq.select(F.explode_outer(F.transform(steps, lambda i: F.struct(F.element_at("t", i).alias("w1"),
                                                                          F.element_at("t", i + 1).alias("w2")))).alias("b")) \
        .where(F.col("b").isNotNull()).select("b.w1", "b.w2")
    bic = bi.groupBy("w1", "w2").agg(F.count("*").alias("c12"))
    hist = bic.groupBy("w1").agg(F.sum("c12").alias("c1"))
    return bic, hist


def ngram_perplexity(texts: DataFrame, key: str, corpus: DataFrame, k: float = 1.0,
                     tokens: str = "tokens") -> DataFrame:
    """Add-k bigram perplexity of each text under a model trained on
    ``corpus``: exp(−mean ln p(w_i | w_{i−1})), with V = corpus vocabulary
    size + 1 (unknown). Also the total log-probability."""
    from ..session import materialize
    bic, _ = bigram_model(corpus, tokens)
    # the trained model is written once (Parquet in the shared checkpoint
    # folder) and read by the history counts, the vocabulary size and the join
    bic = materialize(bic, "bigrams")
    hist = bic.groupBy("w1").agg(F.sum("c12").alias("c1"))
    # every token is the second word of some bigram (texts start with <s>),
    # so the vocabulary is the distinct second words; one number
    vsize = bic.select("w2").distinct().count() + 1
    seq = texts.select(key, F.concat(F.array(F.lit("<s>")), F.col(tokens)).alias("t")).where(F.size("t") > 1)
    bi = seq.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1),
                                               lambda i: F.struct(F.element_at("t", i).alias("w1"),
                                                                  F.element_at("t", i + 1).alias("w2")))).alias("b")) \
        .select(key, "b.w1", "b.w2")
    j = bi.join(bic, ["w1", "w2"], "left").join(hist, "w1", "left")
    lp = F.log((F.coalesce("c12", F.lit(0)) + k) / (F.coalesce("c1", F.lit(0)) + k * vsize))
    per = j.groupBy(key).agg(F.sum(lp).alias("logprob"), F.count("*").alias("n"))
    return per.select(key, "n", "logprob", F.exp(-F.col("logprob") / F.col("n")).alias("perplexity"))
