"""Operator 5, URL filters: empirical-Bayes host reputation.

Labelled page outcomes give each host a rate of bad pages. The rate of a suffix is shrunk towards
that of all pages, a registered domain's towards its suffix's, a host's towards its domain's, each
by a beta-binomial prior whose strength follows from how much the rates differ on that level. A host
is blocked if the lower bound of its posterior, the quantile 1 - `certain` of its beta distribution,
exceeds `most_bad`. Rules go before that. Domain and suffix are without port, and know registries
such as co.uk.

A page takes its outcome from the labelled documents that have the same text as its article.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule, and is
judged by the prior of all pages; without labelled pages nothing but rules blocks; a page without an
article, or an empty one, and an empty document tell nothing; a text that occurs several times is
bad if any of its labels is; very long texts count as a whole; repeated pages count, and are judged,
each; without pages there are no rows. Input columns with the names of result columns are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import REGISTRIES, host_levels, materialize, set_aside, words

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Filter:
    #: (verdict, host, path)
    rules: tuple[tuple[str, str, str], ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
    most_bad: float = 0.5
    #: The chance of a worse rate than most_bad from which on a host is blocked.
    certain: float = 0.95
    least_strength: float = 1.0
    most_strength: float = 1000.0


def with_host_and_path(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.withColumns({"host": F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), "path": F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)})


def matching_rule(filter_: Filter) -> Column:
    """The longest rule that fits host and path, as (length, rule, verdict), or null."""
    fits = [
        F.when(((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path), F.struct(F.lit(len(host + path)).alias("length"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, host, path in filter_.rules
    ]
    return F.array_max(F.array(*fits))


def article_text(html: Column) -> Column:
    """The words of the first article, after its heading if it has one, joined by single spaces."""
    body = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<article\b[^>]*>(?:.*?</h1>)?(.*?)</article>", 1)
    plain = F.regexp_replace(body, "<[^>]*>", " ")
    for name, char in (("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.array_join(words(plain), " ")


def page_outcomes(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) of the pages whose article is the text of a labelled document."""
    texts = docs.select("doc_id", F.array_join(words(F.col("text")), " ").alias("body")).where("body <> ''")
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    told = texts.select("doc_id", F.xxhash64("body").alias("h")).join(labels.select("doc_id", bad.alias("bad")), "doc_id")
    told = materialize(told.groupBy("h").agg(F.max("bad").alias("bad")), "url-labelled")
    articles = pages.select("page_id", article_text(F.col("html")).alias("body")).where("body <> ''")
    return articles.select("page_id", F.xxhash64("body").alias("h")).join(told, "h").select("page_id", "bad")


#: Points on which a beta distribution is summed up, and of them those below most_bad.
GRID = 512


def chance_above(bad: Column, good: Column, most: float) -> Column:
    """The chance that a rate exceeds `most` under the beta distribution (bad, good).

    With the rate as sin(u)^2 the density is sin(u)^(2 bad - 1) cos(u)^(2 good - 1), summed at evenly spaced u.
    """
    u = lambda k: (k + 0.5) * (math.pi / 2 / GRID)
    logs = F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda k: (2 * bad - 1) * F.log(F.sin(u(k))) + (2 * good - 1) * F.log(F.cos(u(k))))
    weights = F.flatten(F.transform(F.array(logs), lambda ls: F.transform(ls, lambda x: F.exp(x - F.array_max(ls)))))
    total = lambda ws: F.aggregate(ws, F.lit(0.0), lambda s, w: s + w)
    below = _below(most)
    return F.get(F.transform(F.array(weights), lambda ws: total(F.slice(ws, below + 1, GRID)) / total(ws)), F.lit(0))


def _below(most: float) -> int:
    return round(GRID * math.asin(math.sqrt(most)) / (math.pi / 2))


def _strength(groups: DataFrame, filter_: Filter) -> tuple[float, float]:
    """Rate of all, and prior strength by moments, from groups with n pages and b bad ones."""
    mean = groups.agg(F.sum("n"), F.sum("b"), F.count(F.lit(1))).first()
    if not mean[0]:
        return 0.0, filter_.most_strength
    rate = mean[1] / mean[0]
    spread = groups.agg(F.sum(F.col("n") * F.pow(F.col("b") / F.col("n") - F.lit(rate), 2)) / mean[0]).first()[0]
    within = rate * (1 - rate)
    share = mean[2] / mean[0]
    rho = (spread - within * share) / (within * (1 - share)) if within > 0 and share < 1 else 0.0
    return rate, min(max(1 / rho - 1 if rho > 0 else filter_.most_strength, filter_.least_strength), filter_.most_strength)


def judge(pages: DataFrame, outcomes: DataFrame, filter_: Filter = Filter()) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict, and the posterior mean of the host."""
    pages, named = set_aside(pages, "bad", "n", "b")
    domain, suffix = host_levels(F.col("host"))
    own = with_host_and_path(pages).withColumns({"__domain": domain, "__suffix": suffix})
    of_page = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))  # repeated pages count by their own rows
    told = own.select("page_id", "host", "__domain", "__suffix").join(of_page, "page_id").groupBy("host", "__domain", "__suffix")
    hosts = materialize(told.agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("b")), "url-hosts")
    domains = hosts.groupBy("__domain", "__suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffixes = hosts.groupBy("__suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    (rate, k0), (_, k1), (_, k2) = _strength(suffixes, filter_), _strength(domains, filter_), _strength(hosts, filter_)
    suffixes = suffixes.select("__suffix", ((F.col("b") + k0 * rate) / (F.col("n") + k0)).alias("__ps"))
    domains = materialize(domains.join(suffixes, "__suffix").select("__domain", ((F.col("b") + k1 * F.col("__ps")) / (F.col("n") + k1)).alias("__pd")), "url-domains")
    hosts = hosts.select("host", F.col("n").alias("__n"), F.col("b").alias("__b"))
    own = own.join(hosts, "host", "left").join(domains, "__domain", "left").join(materialize(suffixes, "url-suffixes"), "__suffix", "left")
    prior = F.coalesce("__pd", "__ps", F.lit(rate))
    n, b = F.coalesce("__n", F.lit(0)), F.coalesce("__b", F.lit(0))
    own = own.withColumns({"posterior": (b + k2 * prior) / (n + k2), "__bad": b + k2 * prior, "__good": n - b + k2 * (1 - prior)})
    # By Markov's inequality the chance is under `certain` wherever the mean is under its share of most_bad.
    doubtful = F.col("posterior") >= filter_.certain * filter_.most_bad
    blocked = F.when(doubtful, chance_above(F.col("__bad"), F.col("__good"), filter_.most_bad) > filter_.certain).otherwise(F.lit(False))
    own = own.withColumn("__rule", matching_rule(filter_))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(blocked, "block").otherwise("allow"))
    return named(own.withColumn("rule", F.col("__rule.rule")).withColumn("verdict", verdict).drop("__domain", "__suffix", "__n", "__b", "__pd", "__ps", "__bad", "__good", "__rule"))


SUFFIX = rf"(?:{'|'.join(REGISTRIES.split())})\.[a-z]{{2}}|[^.]+"
ORACLE = r"""
WITH parsed AS (
  SELECT page_id, html,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), own AS (
  SELECT *, CASE WHEN regexp_matches(name, '^[0-9.]*$|^\[') OR regexp_extract(name, '((?:[^.]+\.)?(?:SUFFIX))$', 1) = '' THEN name
      ELSE regexp_extract(name, '((?:[^.]+\.)?(?:SUFFIX))$', 1) END AS domain,
    CASE WHEN regexp_matches(name, '^[0-9.]*$|^\[') THEN '' ELSE regexp_extract(name, '(?:^|\.)(SUFFIX)$', 1) END AS suffix,
    array_to_string(regexp_extract_all(replace(replace(replace(replace(replace(replace(regexp_replace(
      regexp_extract(coalesce(html, ''), '(?is)<article\b[^>]*>(?:.*?</h1>)?(.*?)</article>', 1), '<[^>]*>', ' ', 'g'),
      '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[^\x20\x09-\x0D]+'), ' ') AS body
  FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM parsed)
), told AS (
  SELECT array_to_string(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), ' ') AS body,
    max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad
  FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING body <> ''
), hosts AS (
  SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS b FROM own JOIN told USING (body) GROUP BY ALL
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY ALL),
levels AS (
  SELECT 0 AS level, n, b FROM suffixes UNION ALL SELECT 1, n, b FROM domains UNION ALL SELECT 2, n, b FROM hosts
), rates AS (SELECT level, sum(b) / sum(n) AS rate, count(*) / sum(n) AS share FROM levels GROUP BY level
), spreads AS (
  SELECT level, rate, share, sum(n * (b / n - rate) ** 2) / sum(n) AS spread FROM levels JOIN rates USING (level) GROUP BY ALL
), rhos AS (
  SELECT level, rate, CASE WHEN rate * (1 - rate) > 0 AND share < 1 THEN (spread - rate * (1 - rate) * share) / (rate * (1 - rate) * (1 - share)) ELSE 0 END AS rho FROM spreads
), strengths AS (
  SELECT level, rate, least(greatest(CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 1000 END, 1), 1000) AS k FROM rhos
), p0 AS (SELECT suffix, (b + k * rate) / (n + k) AS ps FROM suffixes, strengths WHERE level = 0
), p1 AS (SELECT domain, (d.b + k * ps) / (d.n + k) AS pd FROM domains d JOIN p0 USING (suffix), strengths WHERE level = 1
), posteriors AS (
  SELECT own.page_id, own.host, path, k + coalesce(h.n, 0) AS weight,
    (coalesce(h.b, 0) + k * coalesce(pd, ps, rate)) / (coalesce(h.n, 0) + k) AS posterior
  FROM (SELECT coalesce(max(k), 1000) AS k, coalesce(max(rate), 0) AS rate FROM strengths WHERE level = 2), own
  LEFT JOIN hosts h ON own.host = h.host LEFT JOIN p1 ON own.domain = p1.domain LEFT JOIN p0 ON own.suffix = p0.suffix
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fitting AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM own JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT page_id, host, path, rule, round(posterior, 6) AS posterior, coalesce(verdict, CASE WHEN posterior >= 0.95 * 0.5 AND (
    SELECT sum(CASE WHEN k >= 256 THEN w ELSE 0 END) / sum(w) FROM (
      SELECT k, exp(l - max(l) OVER ()) AS w FROM (
        SELECT k, (2 * weight * posterior - 1) * ln(sin((k + 0.5) * pi() / 1024)) + (2 * weight * (1 - posterior) - 1) * ln(cos((k + 0.5) * pi() / 1024)) AS l FROM range(512) AS t(k)))
  ) > 0.95 THEN 'block' ELSE 'allow' END) AS verdict
FROM posteriors LEFT JOIN fitting USING (page_id)
""".replace("SUFFIX", SUFFIX)
