"""Detectors of recurring behaviour over exchanges, each giving findings of one kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.numbers import DAY_MS
from ..functions.text import APPROVAL, FILLERS, MINER_STOPS, PROMPT, among, normal_prompt, without_digits, words_of
from .phrases import chain_grams, chain_occurrences

TOP = {"ritual": 8, "lesson": 8, "rule": 10, "win": 1, "arrival": 8}

#: The sentences of findings, which readers compare.
CLAIMS = {
    "lesson": "a stretch of work where they kept having to stop and redirect the assistant",
    "rule": 'they keep saying it, session after session: "%s"',
    "win": "moments they approved fast — what preceded these is what to do more of",
    "arrival": 'something new has entered their work: "%s"',
    "ritual": "they run this chain again and again: %s",
}


def _id(kind: str, key: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), "record", F.substring(F.sha2(key, 256), 1, 16))


def _ranked(df: DataFrame, kind: str, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("record").orderBy(*order))).where(F.col("rank") <= TOP[kind])


def friction_episodes(exchanges: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Runs of stops and refusals that follow within a window of positions. exchanges: record, session, idx, slip."""
    order = Window.partitionBy("record", "session").orderBy("idx")
    seeds = exchanges.where("slip")
    apart = (F.col("idx") - F.lag("idx").over(order) > limits.lesson_window).cast("int")
    seeds = seeds.withColumn("episode", F.sum(F.coalesce(apart, F.lit(0))).over(order))
    out = seeds.groupBy("record", "session", "episode").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("seeds"), F.min_by("hash", "idx").alias("hash"))
    out = out.withColumn("arc", F.col("last") - F.col("first") + 1)
    return out.where("arc >= 4 or seeds >= 2")


#: Of an exemplar, what a kind of finding doesn't have is null.
EXEMPLAR = "struct<session:string,hash:string,ms:bigint,quote:string>"


def _exemplar(session: Column, hash_: Column | None = None, ms: Column | None = None, quote: Column | None = None) -> Column:
    none = F.lit(None)
    parts = (session, none if hash_ is None else hash_, none if ms is None else ms, none if quote is None else quote)
    return F.struct(*parts).cast(EXEMPLAR)


def _finding(kind: str, id_: Column, claim: Column, receipts: dict[str, Column], detail: Column) -> list[Column]:
    entries = [x for name, c in receipts.items() for x in (F.lit(name), c.cast("long"))]
    return [F.col("record"), F.lit(kind).alias("kind"), id_.alias("id"), claim.alias("claim"), F.create_map(*entries).alias("receipts"), F.col("exemplars"), detail.cast("array<string>").alias("detail"), F.col("rank").cast("int").alias("rank")]


def _first_three(found: DataFrame, rows: DataFrame, keys: list[str], order: list[Column], exemplar: Column) -> DataFrame:
    """found with the first three of rows for each of its keys, which all have some. found has a few rows, which go to rows before those are ranked."""
    own = rows.select(*keys, F.struct(*order).alias("__at"), exemplar.alias("__x")).join(F.broadcast(found), keys)
    first = own.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__at"))).where("__n <= 3")
    return first.groupBy(*found.columns).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__x"))), lambda x: x["__x"]).alias("exemplars"))


def lessons(exchanges: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """exchanges: record, session, idx, ms, hash, reaction, interrupted, declined."""
    slip = F.coalesce((F.col("interrupted") == "plain") | F.col("declined"), F.lit(False))
    own = exchanges.withColumn("slip", slip)
    found = _ranked(friction_episodes(own, limits), "lesson", F.desc(F.col("arc") * F.col("seeds")), "hash").withColumnRenamed("hash", "first_hash")
    seeds = own.where("slip").join(found.select("record", "session", "episode", "first", "last"), ["record", "session"]).where(F.col("idx").between(F.col("first"), F.col("last")))
    quote = F.substring(normal_prompt(F.col("reaction")), 1, 90)
    found = _first_three(found, seeds, ["record", "session", "episode"], [F.col("idx")], _exemplar(F.col("session"), F.col("hash"), F.col("ms"), quote))
    id_ = F.concat_ws(":", F.lit("lesson"), "record", "first_hash")
    return found.select(*_finding("lesson", id_, F.lit(CLAIMS["lesson"]), {"corrections": F.col("seeds"), "exchanges": F.col("arc")}, F.array()))


def repeated_rules(exchanges: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Short prompts that come again in several sessions: record, phrase, n, sessions."""
    fits = lambda w: F.size(w).between(2, 12) & ~F.forall(w, among([*MINER_STOPS, *FILLERS]))
    # In an explode the phrase is computed once for a row, not again for each test of it.
    words = F.explode(F.filter(F.array(words_of(F.col("prompt"), PROMPT, first=13)), fits))
    own = exchanges.where(~F.coalesce("pasted", F.lit(False))).select("record", "session", words.alias("w")).select("record", "session", F.array_join("w", " ").alias("phrase"))
    out = own.groupBy("record", "phrase").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("sessions"))
    return out.where((F.col("n") >= limits.rule_count) & (F.col("sessions") >= limits.rule_sessions))


def rules(exchanges: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    found = _ranked(repeated_rules(exchanges, limits), "rule", F.desc("n"), "phrase").withColumnRenamed("sessions", "spread")
    said = exchanges.where(~F.coalesce("pasted", F.lit(False))).withColumn("phrase", normal_prompt(F.col("prompt"), first=13))  # a phrase has at most twelve words
    found = _first_three(found, said, ["record", "phrase"], [F.col("session"), F.col("idx")], _exemplar(F.col("session"), F.col("hash")))
    claim = F.format_string(CLAIMS["rule"], without_digits(F.col("phrase")))
    return found.select(*_finding("rule", _id("rule", F.col("phrase")), claim, {"count": F.col("n"), "sessions": F.col("spread")}, F.array("phrase")))


def approvals(exchanges: DataFrame, opening: str = APPROVAL) -> DataFrame:
    """Short prompts that approve, with what was said before: record, session, idx, quote, approved."""
    order = Window.partitionBy("record", "session").orderBy("idx")
    fits = F.filter(F.array(normal_prompt(F.col("prompt"), first=31)), lambda p: (p != "") & (F.length(p) <= 60) & p.rlike(opening))
    # Of 31 words at least 61 characters, of 41 at least 81 are read. What is shuffled of a row are its quote and the beginning of its answer, not the texts.
    own = exchanges.select("record", "session", "idx", "hash", F.get(fits, F.lit(0)).alias("quote"), F.substring(normal_prompt(F.col("said"), first=41), 1, 80).alias("__said"))
    own = own.withColumn("approved", F.lag("__said").over(order)).where("quote is not null")
    return own.select("record", "session", "idx", "hash", "quote", "approved")


def wins(exchanges: DataFrame, opening: str = APPROVAL) -> DataFrame:
    """One finding: approvals, and what was said before the first three that have something before them."""
    own = approvals(exchanges, opening)
    found = own.groupBy("record").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.lit(1))
    told = own.where("idx > 0").withColumn("__n", F.row_number().over(Window.partitionBy("record").orderBy("session", "idx"))).where("__n <= 3")
    listed = told.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("__n", _exemplar(F.col("session"), F.col("hash"), None, F.col("quote")).alias("x"), F.coalesce("approved", F.lit("")).alias("approved")))).alias("l"))
    found = found.join(listed, "record", "left").withColumn("exemplars", F.coalesce(F.transform("l", lambda x: x["x"]), F.array().cast(f"array<{EXEMPLAR}>")))
    id_ = F.concat_ws(":", F.lit("win"), "record", F.lit("approvals"))
    return found.select(*_finding("win", id_, F.lit(CLAIMS["win"]), {"approvals": F.col("n")}, F.coalesce(F.transform("l", lambda x: x["approved"]), F.array())))


def arriving_terms(uses: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Terms first used in the last days, often and in several sessions. uses: record, session, ms, term."""
    # Uses merge by term before they are shuffled; sessions are counted for the terms that are left.
    seen = uses.groupBy("record", "term").agg(F.min("ms").alias("first_ms"), F.count(F.lit(1)).alias("n"))
    newest = uses.groupBy("record").agg(F.max("ms").alias("newest"))
    late = seen.join(newest, "record").where((F.col("first_ms") >= F.col("newest") - limits.arrival_days * DAY_MS) & (F.col("n") >= limits.arrival_count))
    spread = uses.select("record", "term", "session").join(late.select("record", "term"), ["record", "term"], "left_semi").groupBy("record", "term").agg(F.countDistinct("session").alias("sessions"))
    return late.join(spread.where(F.col("sessions") >= limits.arrival_sessions), ["record", "term"])


def arrivals(exchanges: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    w = F.array_distinct(F.filter(words_of(F.col("prompt"), PROMPT), lambda x: (F.length(x) >= 4) & ~among([*MINER_STOPS, *FILLERS])(x)))
    uses = exchanges.select("record", "session", "ms", F.explode(w).alias("term"))
    found = _ranked(arriving_terms(uses, limits), "arrival", F.desc("n"), "term").withColumnRenamed("sessions", "spread")
    first = uses.join(found.select("record", "term"), ["record", "term"], "left_semi").groupBy("record", "term").agg(F.min("session").alias("session"))
    found = found.join(first, ["record", "term"]).withColumn("exemplars", F.array(_exemplar(F.col("session"), None, F.col("first_ms"))))
    claim = F.format_string(CLAIMS["arrival"], without_digits(F.col("term")))
    return found.select(*_finding("arrival", _id("arrival", F.col("term")), claim, {"count": F.col("n"), "sessions": F.col("spread")}, F.array("term")))


def rituals(chains: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    found = chain_grams(chains, limits=limits).withColumn("density", F.col("n") / F.length("chain"))
    found = _ranked(found, "ritual", F.desc("density"), "chain").withColumnRenamed("sessions", "spread")
    users = chain_occurrences(chains).join(found.select("record", "chain"), ["record", "chain"], "left_semi").select("record", "chain", "session").distinct()
    found = _first_three(found, users, ["record", "chain"], [F.col("session")], _exemplar(F.col("session")))
    claim = F.format_string(CLAIMS["ritual"], without_digits(F.col("chain")))
    return found.select(*_finding("ritual", _id("ritual", F.col("chain")), claim, {"occurrences": F.col("n"), "sessions": F.col("spread")}, F.split("chain", " → ")))


def finding_counts(findings: DataFrame) -> DataFrame:
    """How many findings of each kind a record has."""
    return findings.groupBy("record", "kind").agg(F.count(F.lit(1)).alias("n"))


def evidence_of(findings: DataFrame) -> DataFrame:
    """Findings as what a proposal may cite: id, claim, the quotes of their exemplars, receipts as text, the largest number."""
    quotes = F.filter(F.transform("exemplars", lambda x: x["quote"]), lambda q: F.coalesce(q, F.lit("")) != "")
    return findings.select("record", "id", "kind", "claim", quotes.alias("quotes"), receipt_text(F.col("receipts")).alias("receipt"), F.array_max(F.map_values("receipts")).alias("largest"))


def receipt_text(receipts: Column) -> Column:
    """Entries of a map as 'name number', in the order of the map."""
    return F.array_join(F.transform(F.map_entries(receipts), lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string"))), " · ")


def measure(exchanges: DataFrame, chains: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """All findings: rituals, lessons, rules, wins, arrivals."""
    out = rituals(chains, limits)
    for found in (lessons(exchanges, limits), rules(exchanges, limits), wins(exchanges), arrivals(exchanges, limits)):
        out = out.unionByName(found)
    return out
