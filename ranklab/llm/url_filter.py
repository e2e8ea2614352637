"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression whose literal tokens (lower-case runs of letters
and digits that any match must contain as whole tokens) are known. Each rule is
filed under the one of its tokens that is rarest among the tokens of the urls at
hand; a url is tokenised the same way, its tokens fetch candidate rules, and only
those run their regular expression. Above the patterns stand host/path rules
("longest wins"), which decide first.

Everything is DataFrame functions: one aggregation counts the tokens that occur
in rules (partial sums per task, at most one row per rule token), the rule index
is a small table joined to the exploded tokens, and verdicts return by row key.

Defined results: a null url, an empty url, or one without ``://`` has empty host
and path, no rule and the default verdict ``allow``. Repeated rows each keep their
verdict. Extra columns of the input are ignored. A rule without any literal token
is tested on every url, by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, table

BROADCAST_RULES = 100_000     # rules up to this many are a small table to send


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` is searched (case-insensitively) in the url after ``://``;
    ``tokens`` are the literal tokens that every match contains whole."""
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str = "block"


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


# The host and path rules of the query's contract.
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)

# Production pattern rules: spam hosts, tracker and junk paths.
PATTERN_RULES = (
    PatternRule("casino-win", r"(^|[^a-z0-9])casino[^a-z0-9]win([^a-z0-9]|$)", ("casino", "win")),
    PatternRule("free-bets", r"(^|[^a-z0-9])free[^a-z0-9]bets([^a-z0-9]|$)", ("free", "bets")),
    PatternRule("cheap-pills", r"(^|[^a-z0-9])cheap[^a-z0-9]pills([^a-z0-9]|$)", ("cheap", "pills")),
    PatternRule("adult", r"(^|[.-])(xxx)([.-]|$)", ("xxx",)),
    PatternRule("payday-loan", r"(^|[^a-z0-9])payday[^a-z0-9]loan([^a-z0-9]|$)", ("payday", "loan")),
    PatternRule("wp-login", r"/wp-login[.]php([?#]|$)", ("wp", "login", "php")),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; only A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.array_distinct(F.filter(F.split(F.lower(rest), "[^a-z0-9]+"), lambda t: t != ""))


def host_rule_column(host: Column, path: Column, rules: tuple[HostRule, ...]) -> Column:
    """The longest rule (host and path together) that fits, as a struct; null if
    none does. Ties go to the earlier rule."""
    ranked = sorted(rules, key=lambda r: -len(r.name))
    out = F.lit(None)
    for r in reversed(ranked):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def rule_index(tokens: DataFrame, rules: tuple[PatternRule, ...]) -> DataFrame:
    """(name, pattern, verdict, token): every rule under its rarest token.
    ``tokens``: (token), one row per url and distinct token."""
    spark = tokens.sparkSession
    rows = [(r.name, r.pattern, r.verdict, i, t) for r in rules for i, t in enumerate(r.tokens or ("",))]
    r = spark.createDataFrame(rows, "name string, pattern string, verdict string, place int, token string")
    known = _sent(r.select("token").distinct(), len(rows))
    seen = tokens.join(known, "token").groupBy("token").agg(F.count("*").alias("n"))
    return (r.join(seen, "token", "left")
             .groupBy("name", "pattern", "verdict")
             .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "place")).alias("token")))


def _sent(df: DataFrame, rules: int) -> DataFrame:
    return F.broadcast(df) if rules <= BROADCAST_RULES else df


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                host_rules: tuple[HostRule, ...] = HOST_RULES,
                pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES,
                default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict, pattern): the verdict of each url;
    ``pattern`` names the pattern rule that decided, if one did (the first name
    in order when several match)."""
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), url.alias("url"))
    base = base.withColumn("_k", row_key("page_id", "url"))
    token = base.select("_k", "url", F.explode(tokens_of(F.col("url"))).alias("token"))
    index = rule_index(token.select("token"), pattern_rules)
    fetched = token.join(_sent(index, len(pattern_rules)), "token")
    if any(not r.tokens for r in pattern_rules):
        every = index.where("token = ''").drop("token")
        fetched = fetched.drop("token").unionByName(base.select("_k", "url").join(_sent(every, len(pattern_rules))))
    rest = F.lower(F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1))
    hit = (fetched.where(F.regexp_like(rest, F.col("pattern")))
           .groupBy("_k").agg(F.min(F.struct("name", "verdict")).alias("hit")))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = base.join(hit, "_k", "left").select("page_id", host.alias("host"), path.alias("path"), "hit")
    out = out.withColumn("by", host_rule_column(F.col("host"), F.col("path"), host_rules) if host_rules
                         else F.lit(None).cast("struct<rule:string,verdict:string>"))
    return out.select(
        "page_id", "host", "path", F.col("by.rule").alias("rule"),
        F.coalesce("by.verdict", "hit.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("by").isNull(), F.col("hit.name")).alias("pattern"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    pats = "\n".join(
        f"WHEN regexp_matches(rest, '{r.pattern}') THEN '{r.name}'" for r in sorted(PATTERN_RULES, key=lambda r: r.name))
    ranked = sorted(HOST_RULES, key=lambda r: -len(r.name))
    fits = [f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in ranked]
    rule = "\n".join(f"WHEN {f} THEN '{r.name}'" for f, r in zip(fits, ranked, strict=True))
    verdict = "\n".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, ranked, strict=True))
    return f"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         lower(coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '')) AS rest
  FROM pages),
v AS (
  SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS said,
         CASE {pats} END AS found
  FROM u)
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN found IS NOT NULL THEN 'block' END, 'allow') AS verdict,
       CASE WHEN said IS NULL THEN found END AS pattern
FROM v
"""


SQL = _sql()
