"""URL filter by a weighted vocabulary (operator 6).

One Aho-Corasick pass over a url finds every term of the vocabulary; a hit
counts if the characters beside it are no letters or digits. One strict term,
or two different soft ones, reject the url. Rules on host and path come first:
the longest rule that fits decides.

Defined results: a null url, or one without ``://``, has an empty host and path
and fits no rule; its text is still looked up (null: no hits). Repeated rows
stay; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.llm.common import fold_case, table

# The vocabulary (lower case).
STRICT = ("camgirls", "casino", "hentai", "porn", "viagra", "xxx")
SOFT = ("ads", "adult", "bet", "bets", "cheap", "crack", "dating", "escort", "farm", "free",
        "jackpot", "keygen", "loan", "nude", "pills", "poker", "replica", "sex", "slots", "spam",
        "track", "torrent", "warez", "win")
SOFT_LIMIT = 2
# Rules as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):  # a term of both lists is strict
        for term in terms:
            found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def _beside(text: str, i: int) -> bool:
    """True if there is a letter or digit of a term's alphabet at ``i``."""
    return 0 <= i < len(text) and text[i] in "abcdefghijklmnopqrstuvwxyz0123456789"


def term_hits(text: str | None, strict: tuple[str, ...] = STRICT,
              soft: tuple[str, ...] = SOFT) -> tuple[int, int]:
    """Different strict and soft terms in a folded text."""
    found: set[tuple[str, int]] = set()
    if text:
        for end, (term, weight) in _automaton(strict, soft).iter(text):
            if not _beside(text, end - len(term)) and not _beside(text, end + 1):
                found.add((term, weight))
    return sum(w == 2 for _, w in found), sum(w == 1 for _, w in found)


def vocabulary_hits(url: Column, strict: tuple[str, ...], soft: tuple[str, ...]) -> Column:
    """struct(strict_hits, soft_hits) of a url."""
    @F.pandas_udf("strict_hits long, soft_hits long")
    def hits(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([term_hits(u, strict, soft) for u in urls],
                            columns=["strict_hits", "soft_hits"], dtype="int64")
    return hits(fold_case(url))


def judged(pages: DataFrame, rules=RULES, strict: tuple[str, ...] = STRICT,
           soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict and the hits of every url."""
    url = F.col("url")
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.coalesce(fold_case(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, on, under in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == on) | F.col("host").endswith("." + on)) & \
            F.col("path").startswith(under)
        rule = F.when(fits, F.lit(on + under)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    parts = parts.withColumn("hits", vocabulary_hits(F.col("url"), tuple(strict), tuple(soft)))
    rejected = (F.col("hits.strict_hits") > 0) | (F.col("hits.soft_hits") >= soft_limit)
    return parts.select("page_id", "host", "path", rule.alias("rule"),
                        F.coalesce(verdict, F.when(rejected, "block").otherwise("allow")).alias("verdict"),
                        "hits.strict_hits", "hits.soft_hits")


def op6_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


ORACLE_SQL = """
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
parts AS (
  SELECT page_id, low,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut),
terms AS (
  SELECT unnest(['camgirls', 'casino', 'hentai', 'porn', 'viagra', 'xxx']) AS term, 'strict' AS kind
  UNION ALL
  SELECT unnest(['ads', 'adult', 'bet', 'bets', 'cheap', 'crack', 'dating', 'escort', 'farm', 'free', 'jackpot',
    'keygen', 'loan', 'nude', 'pills', 'poker', 'replica', 'sex', 'slots', 'spam', 'track', 'torrent', 'warez', 'win']), 'soft'),
ids AS (SELECT row_number() OVER () AS n, * FROM parts),
hits AS (
  SELECT n, count(*) FILTER (kind = 'strict') AS strict_hits, count(*) FILTER (kind = 'soft') AS soft_hits
  FROM ids JOIN terms ON regexp_matches(low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')
  GROUP BY n),
rules AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS r(kind, rhost, rpath)),
fit AS (
  SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(kind, length(rhost || rpath)) AS kind
  FROM ids JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY n)
SELECT page_id, host, path, rule,
       coalesce(kind, CASE WHEN coalesce(strict_hits, 0) > 0 OR coalesce(soft_hits, 0) >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits
FROM ids LEFT JOIN hits USING (n) LEFT JOIN fit USING (n)
"""
