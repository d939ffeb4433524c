"""Operator 1, language identification by Bayesian evidence fusion.

Evidence about a text's language: the likelihood of its letter trigrams; the language that its
markup declares; the suffix of its address; and a prior of its host, smoothed towards that of its
registered domain and of all rows. What the evidence is worth is counted over all rows by grouped
aggregation, with the language that the text alone suggests as the class; a row's own count is taken
out of its host's.

Defined results: a null or empty text has no text evidence, takes its language from the rest and
isn't accepted; null or blank evidence says nothing; a declared language outside `languages` is
evidence like any other value; without any declared language there is no text model, and nothing is
accepted. Repeated rows count as often as they occur. Columns of the input with the names of result
columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import host_levels, materialize, set_aside

#: Hashed letter trigrams, 2^13.
SHIFT = np.uint64(51)
BINS = 1 << 13


@dataclass(frozen=True)
class Fusion:
    languages: tuple[str, ...] = ("de", "en", "es", "fr")
    #: Trigrams overlap: each letter counts three times.
    temper: float = 1 / 3
    #: Pseudo-counts of the tables and of the host hierarchy.
    smoothing: float = 1.0
    strength: float = 10.0
    #: Accepted: posterior, and how much likelier, in nats a trigram, than evenly strewn trigrams.
    min_probability: float = 0.6
    min_gain: float = 0.5


def trigrams(text: str) -> np.ndarray:
    """Hash bins of the letter trigrams of a whole text; what isn't a letter is a space."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    code = np.where((code < 128) & ((code < 97) | (code > 122)), np.uint64(32), code)
    if len(code) < 3:
        code = np.append(code, np.full(3, 32, dtype=np.uint64)) if len(code) else code
    if len(code) < 3:
        return np.zeros(0, dtype=np.int64)
    mixed = code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> SHIFT).astype(np.int64)


def text_model(rows: DataFrame, fusion: Fusion = Fusion()) -> np.ndarray:
    """Log probabilities, languages by bins, of the trigrams of rows (text, declared), all of them."""
    languages = list(fusion.languages)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(languages), BINS), dtype=np.int64)
        for batch in batches:
            for i, language in enumerate(languages):
                for text in batch["text"][batch["declared"] == language]:
                    np.add(totals[i], np.bincount(trigrams(text), minlength=BINS), out=totals[i])
        language, bins = np.nonzero(totals)
        yield pd.DataFrame({"language": language, "bin": bins, "n": totals[language, bins]})

    told = rows.where(F.col("declared").isin(languages) & F.col("text").isNotNull()).select("text", "declared")
    counts = told.mapInPandas(count, "language long, bin long, n long").groupBy("language", "bin").agg(F.sum("n").alias("n"))
    totals = np.full((len(languages), BINS), 0.5)
    for r in materialize(counts, "language-model").toLocalIterator():  # languages x bins rows at most
        totals[r["language"], r["bin"]] += r["n"]
    return np.log(totals / totals.sum(axis=1, keepdims=True))


def with_text_likelihoods(rows: DataFrame, model: np.ndarray, fusion: Fusion = Fusion()) -> DataFrame:
    """rows with __ll, the log-likelihood of the text in each language, and __n, its trigrams."""
    shared = rows.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    @F.pandas_udf("ll array<double>, n long")
    def score(texts: pd.Series) -> pd.DataFrame:
        found = [trigrams(t) for t in texts]
        return pd.DataFrame({"ll": [shared.value[:, x].sum(axis=1, dtype=np.float64).tolist() for x in found], "n": [len(x) for x in found]})

    scored = rows.withColumn("__t", score(F.coalesce(F.col("text"), F.lit(""))))
    return scored.select("*", F.col("__t.ll").alias("__ll"), F.col("__t.n").alias("__n")).drop("__t")


def fuse(scored: DataFrame, counted: DataFrame, fusion: Fusion = Fusion()) -> DataFrame:
    """scored (with declared, suffix, host, domain, __ll, __n) with language, probability, text_language, accepted.

    counted: the same rows, of which the evidence is counted.
    """
    languages = range(len(fusion.languages))
    ll = [F.get("__ll", F.lit(i)) for i in languages]
    best = F.when(F.col("__n") > 0, F.array_position("__ll", F.array_max("__ll")).cast("int") - 1)
    own = scored.withColumn("__best", best)
    counts = [F.sum(F.when(F.col("__best") == i, 1).otherwise(0)) for i in languages]
    told = counted.withColumn("__best", best).where(F.col("__best").isNotNull())

    def evidence(column: str) -> DataFrame:
        """Per value of the column, the log of its share among the rows of each language."""
        table = materialize(told.where(F.nullif(F.col(column), F.lit("")).isNotNull()).groupBy(column).agg(*[c.alias(f"n{i}") for i, c in enumerate(counts)]), f"language-{column}")
        total = table.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in languages], F.count(F.lit(1))).first()
        a = fusion.smoothing
        shares = [F.log((F.col(f"n{i}") + a) / (total[i] + a * max(1, total[-1]))).alias(f"__{column}{i}") for i in languages]
        return table.select(F.col(column).alias(f"__{column}"), *shares)

    everything = told.agg(*[F.coalesce(c, F.lit(0)) for c in counts]).first()
    prior = [(x + 1) / (sum(everything) + len(fusion.languages)) for x in everything]
    hosts = materialize(told.where(F.col("host").isNotNull()).groupBy("host", "domain").agg(*[c.alias(f"h{i}") for i, c in enumerate(counts)]), "language-hosts")
    k = fusion.strength
    domains = hosts.groupBy("domain").agg(*[F.sum(f"h{i}").alias(f"d{i}") for i in languages])
    of_domain = sum((F.col(f"d{i}") for i in languages), F.lit(0))
    domains = domains.select(F.col("domain").alias("__dom"), *[((F.col(f"d{i}") + k * prior[i]) / (of_domain + k)).alias(f"__p{i}") for i in languages])
    hosts = hosts.join(domains, F.col("domain").eqNullSafe(F.col("__dom"))).select(F.col("host").alias("__host"), F.col("domain").alias("__domain"), *[f"h{i}" for i in languages], *[f"__p{i}" for i in languages])
    hosts = materialize(hosts, "language-priors")

    for column in ("declared", "suffix"):
        table = evidence(column)
        own = own.join(table, own[column] == table[f"__{column}"], "left")
    own = own.join(hosts, (F.col("host") == F.col("__host")) & F.col("domain").eqNullSafe(F.col("__domain")), "left")
    of_host = sum((F.col(f"h{i}") for i in languages), F.lit(0))
    mine = [F.when(F.col("__best") == i, 1).otherwise(0) for i in languages]
    posterior = [
        F.coalesce(ll[i], F.lit(0.0)) * fusion.temper
        + F.coalesce(F.col(f"__declared{i}"), F.lit(0.0))
        + F.coalesce(F.col(f"__suffix{i}"), F.lit(0.0))
        + F.coalesce(
            F.log((F.col(f"h{i}") - mine[i] + k * F.col(f"__p{i}")) / (of_host - F.when(F.col("__best").isNotNull(), 1).otherwise(0) + k)),
            F.lit(float(np.log(prior[i]))),
        )
        for i in languages
    ]
    own = own.withColumns({f"__l{i}": x for i, x in enumerate(posterior)})
    most = F.greatest(*[F.col(f"__l{i}") for i in languages])
    total = sum((F.exp(F.col(f"__l{i}") - most) for i in languages), F.lit(0.0))
    names = F.array(*[F.lit(x) for x in fusion.languages])
    language = F.get(names, (F.array_position(F.array(*[F.col(f"__l{i}") for i in languages]), most) - 1).cast("int"))
    gain = F.array_max("__ll") / F.col("__n") + float(np.log(BINS))
    own = own.withColumns(
        {
            "text_language": F.get(names, F.col("__best")),
            "language": language,
            "probability": 1 / total,
            "accepted": F.coalesce((1 / total >= fusion.min_probability) & F.when(F.col("__n") > 0, gain >= fusion.min_gain), F.lit(False)),
        }
    )
    given = [c for c in scored.columns if c not in ("__ll", "__n", "text_language", "language", "probability", "accepted")]
    return own.select(*[scored[c] if c not in own.columns else F.col(c) for c in given], "text_language", "language", "probability", "accepted")


def identify(rows: DataFrame, fusion: Fusion = Fusion(), keep_text: bool = True) -> DataFrame:
    """rows (text, declared, suffix, host, domain, any others) with their language."""
    rows, named = set_aside(rows)
    scored = with_text_likelihoods(rows, text_model(rows, fusion), fusion)
    counted = materialize(scored.drop("text"), "language-scored")
    # Texts are scored once more rather than written once more.
    return named(fuse(scored if keep_text else counted, counted, fusion))


def page_evidence(pages: DataFrame) -> DataFrame:
    """text, declared, suffix, host and domain of pages (url, html): the article, or all, without markup."""
    html = F.coalesce(F.col("html"), F.lit(""))
    article = F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)(?:</article>|$)", 1)
    body = F.when(article != "", article).otherwise(html)
    text = F.regexp_replace(body, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&[#\w]+;?", " ")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), "://([^/?#]*)", 1))
    domain, suffix = host_levels(host)
    return pages.withColumns(
        {
            "text": text,
            "declared": F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1)),
            "host": F.nullif(host, F.lit("")),
            "domain": F.nullif(domain, F.lit("")),
            "suffix": F.nullif(suffix, F.lit("")),
        }
    )


def document_evidence(docs: DataFrame) -> DataFrame:
    """declared, host, domain and suffix of documents: the source stands for the host and has no suffix."""
    return docs.withColumns({"declared": F.col("lang"), "host": F.col("source"), "domain": F.col("source"), "suffix": F.lit(None).cast("string")})
