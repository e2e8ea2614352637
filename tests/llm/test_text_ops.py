"""URL filter, token counts, line dedup: edge cases and brute force."""
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ranklab.llm import line_dedup, token_count, url_filter

TEXT = "doc_id long, text string"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# --- url filter ---------------------------------------------------------------

URLS = [
    (1, "https://www.Example.ORG/es/a?x=1", "www.example.org", "/es/a", "example.org/es/", "block"),
    (2, "http://example.org/en/12#f", "example.org", "/en/12", "example.org/en/1", "block"),
    (3, "http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    (4, "ftp://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    (5, "http://a.b.com/de/casino-win", "a.b.com", "/de/casino-win", "com/de/", "block"),
    (6, "http://m.casino-win.example.net/en/1", "m.casino-win.example.net", "/en/1", None, "block"),
    (7, "http://x.net/CHEAP.pills", "x.net", "/CHEAP.pills", None, "block"),
    (8, "http://cheapish.net/pills", "cheapish.net", "/pills", None, "allow"),
    (9, None, "", "", None, "allow"),
    (10, "", "", "", None, "allow"),
    (11, "no-scheme.com/de/", "", "", None, "allow"),
    (12, "http://com", "com", "", None, "allow"),
    (13, "http://u://com/de/", "u:", "//com/de/", None, "allow"),
    (14, "http://É.com/fr/x", "É.com", "/fr/x", "com/fr/", "allow"),
    (None, "http://org/", "org", "/", "org/", "allow"),
    (3, "http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    (15, "http://" + "a" * 100_000 + ".net/", "a" * 100_000 + ".net", "/", None, "allow"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(u[0], u[1], "x", "y", 1) for u in URLS], "page_id long, url string, host string, verdict string, _k int")
    out = url_filter.filter_urls(pages)
    assert rows(out, "page_id", "host", "path", "rule", "verdict") == sorted(((u[0], *u[2:]) for u in URLS), key=repr)


def test_urls_empty_table(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    tokens = spark.createDataFrame([(t,) for t in ["free"] * 5 + ["bets"] * 2 + ["casino"]], "token string")
    index = {r.name: r.token for r in url_filter.rule_index(tokens, url_filter.PATTERN_RULES).collect()}
    assert index["free-bets"] == "bets"
    assert index["casino-win"] == "win"          # never seen: rarest


def test_rule_without_token_runs_on_every_url(spark):
    rule = url_filter.PatternRule("digits", r"[0-9]{4}", ())
    pages = spark.createDataFrame([(1, "http://a.net/x12345"), (2, "http://a.net/x1")], "page_id long, url string")
    out = url_filter.filter_urls(pages, pattern_rules=(rule, *url_filter.PATTERN_RULES))
    assert rows(out, "page_id", "verdict") == [(1, "block"), (2, "allow")]


# --- token counts -------------------------------------------------------------

ODD = ["", " a", "a ", "a  b", "a\n b", "a \nb", "a\n \nb", "a\n ", "x<|endoftext|>y <|endoftext|>", "don't we'll  ok", "\u00a0 x",
       "日本 語 a", "a\u0085 b", " ", "   ", "\n\n a\n\n", "1234 5 a1b2 $$$ ok,", "\u3000 a", "é e\u0301 x", "a" * 5000, "\ufeffx \u200b y",
       "the " * 3000, "\x00 \x1f", "''s 's", "\U0001f600 smile\U0001f600"]


def random_texts(n):
    rng = random.Random(3)
    parts = ["the", " ", "  ", "\n", "é", "12", "don't", ",", "\t", "日", "\u2009", "\u00a0", "A", "zz", "'", "<|endoftext|>", "$%"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_token_counts_match_the_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ODD + random_texts(300) + [None]
    docs = spark.createDataFrame([(i if i else None, x, i, "w") for i, x in enumerate(texts)], TEXT + ", n_tokens int, word string")
    want = [(i if i else None, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(texts)]
    out = token_count.count_tokens(docs.unionAll(docs), path)
    assert rows(out, "doc_id", "n_bytes", "n_tokens") == sorted(want * 2, key=repr)
    assert all(r.over_limit == (r.n_tokens > 512) for r in out.collect())
    assert token_count.count_tokens(docs.limit(0), path).count() == 0


def test_words_that_many_documents_share_are_spread(spark):
    public = pytest.importorskip("public_tokenizers")
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same words "), "id").alias("text"))
    assert {r.n_tokens for r in token_count.count_tokens(docs, public.path("byte_bpe_50k.json")).collect()} <= {4, 5}


def test_high_frequencies_take_several_entries(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    import numpy as np
    import regex
    t, specials = token_count.tokenizer(public.path("byte_bpe_50k.json"))
    monkeypatch.setattr(token_count, "MAX_FREQ", 8)
    words, post, offsets = token_count._block(pa.array(["a" + " a" * 50, "b"]), t, specials, regex.compile(token_count.PRETOKEN).findall)
    total = {}
    for w, lo, hi in zip(words, offsets, offsets[1:], strict=False):
        total[w] = int((post[lo:hi] >> token_count.DOC_BITS).sum())
    assert total == {"a": 1, " a": 50, "b": 1}
    assert np.diff(offsets).max() == 8


# --- line dedup ---------------------------------------------------------------

def brute_lines(docs):
    first, windows = {}, []
    for i, text in sorted(docs):
        lines = (text or "").split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p:p + 3])
            if "".join(w).strip(" "):
                windows.append((i, p, w))
                first.setdefault(w, (i, p))
    gone = {}
    for i, p, w in windows:
        if first[w] != (i, p):
            gone.setdefault(i, set()).update(range(p, p + 3))
    return sorted(((i, "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone.get(i, ())) if t is not None or i in gone else None,
                    len(gone.get(i, ()))) for i, t in docs), key=repr)


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    lines = ["alpha", "beta", "gamma", "", "delta x", "  "]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "a\nb"), (203, "a\nb"), (204, "\n\n\n\n"), (205, "\n\n\n\n"), (206, "q\n" * 500), (207, "q\n" * 500)]
    df = spark.createDataFrame([(*d, 1, "clash", None) for d in docs], TEXT + ", pos int, _k string, lang string")
    assert line_dedup.dedup_lines(df).columns == df.columns
    out = line_dedup.cut_lines(df).select("_row.*", "n_removed")
    assert rows(out, "doc_id", "text", "n_removed") == brute_lines(docs)


def test_lines_repeated_rows_and_nulls(spark):
    text = "a\nb\nc\nd"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, text)], TEXT)
    out = line_dedup.dedup_lines(df)
    # null ids come first and keep the passage; later copies go, the equal rows alike
    assert rows(out, "doc_id", "text") == sorted([(None, text), (None, None), (1, ""), (1, ""), (2, "")], key=repr)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
