"""Stored state: event-log folds, bounded histories, budgets, caches, usage, stage rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT


def fold_log(log: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The live rows of a log of born and retired events: the last event of each key decides."""
    last = log.where(F.col("event").isin("born", "retired")).groupBy(*keys).agg(F.max_by(F.struct("event", *columns), "seq").alias("l"))
    return last.where("l.event = 'born'").select(*keys, *[F.col(f"l.{c}").alias(c) for c in columns])


def compact_log(log: DataFrame, keys: list[str], record: str = "record") -> DataFrame:
    """A log that folds as the given one does, whatever is added later: the last event of each live key, and a mark.

    Ends of keys go. The mark (event 'mark') of each record has its greatest number, which new events must
    exceed: so that numbers never come again, though the rows that had them are gone.
    """
    own = log.where(F.col("event").isin("born", "retired"))
    rest = [c for c in log.columns if c not in keys]
    live = own.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("l")).where("l.event = 'born'").select(*keys, "l.*").select(log.columns)
    marks = log.groupBy(record).agg(F.max("seq").alias("seq"))
    fill = [F.col(f.name) if f.name in (record, "seq") else F.lit("mark" if f.name == "event" else None).cast(f.dataType).alias(f.name) for f in log.schema]
    return live.unionByName(marks.select(*fill))


def next_number(log: DataFrame) -> int:
    """The number for the next event of a log."""
    return (log.agg(F.max("seq")).first()[0] or 0) + 1


def within_budget(rows: DataFrame, keys: list[str], order: str, length: str, budget: int = DEFAULT.budget_chars) -> DataFrame:
    """The first rows whose summed length stays within the budget; it stops at the first that doesn't fit."""
    used = F.sum(length).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= budget)


def diverse_quotes(rows: DataFrame, keys: list[str], order: list[Column], free: int = 3, most: int = 5) -> DataFrame:
    """The first rows in order; after so many only the first of a session that has none yet."""
    own = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    own = own.withColumn("__s", F.row_number().over(Window.partitionBy(*keys, "session").orderBy("__r"))).where((F.col("__r") <= free) | (F.col("__s") == 1))
    return own.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("__r"))).where(F.col("place") <= most).drop("__r", "__s")


def session_samples(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The first row of each session, the first so many sessions."""
    first = rows.groupBy(*keys, "session").agg(F.min(F.struct(order, *[c for c in rows.columns if c not in (*keys, "session", order)])).alias("f")).select(*keys, "session", "f.*")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("place") <= most)


def last_entries(entries: DataFrame, keys: list[str], stamp: str, most: int = DEFAULT.history) -> DataFrame:
    """The latest entries of each key. entries: one row for each key and stamp."""
    return entries.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(stamp)))).where(F.col("__n") <= most).drop("__n")


def merge_cache(cache: DataFrame, fresh: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """The cache without what is no longer live or is replaced, and the fresh rows."""
    kept = cache.join(live.select(*keys).distinct(), keys, "left_semi").join(fresh.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(fresh)


def cache_plan(work: DataFrame, cache: DataFrame, proven: str, keys: list[str] = ["name", "born_seq"]) -> DataFrame:  # noqa: B006
    """work with its cached wording, and whether that can be used again: plan is reuse, missing or replace.

    A wording with a numeral is replaced, as only counting may print one. In the section that prints quotes
    (proven) the cached quote must still be a candidate; else the wording is missing.
    """
    parts = ["section", "line", "signal", "quote"]
    own = work.join(cache.select(*keys, *[F.col(c).alias(f"cached_{c}") for c in parts]), keys, "left")
    numeral = F.concat_ws(" ", "cached_line", "cached_signal").rlike("[0-9]")
    stale = (F.col("cached_section") == proven) & ~F.array_contains("candidates", F.coalesce("cached_quote", F.lit("")))
    plan = F.when(F.col("cached_section").isNull(), "missing").when(numeral, "replace").when(stale, "missing").otherwise("reuse")
    return own.withColumn("plan", plan)


def tally_usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum("units").alias("units"), F.sum("cost").alias("cost"))


def usage_since(now: DataFrame, before: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """What was added since a snapshot, never less than nothing."""
    old = before.select(*keys, *[F.col(c).alias(f"__{c}") for c in counters])
    own = now.join(old, keys, "left")
    return own.withColumns({c: F.greatest(F.col(c) - F.coalesce(f"__{c}", F.lit(0)), F.lit(0)) for c in counters}).drop(*[f"__{c}" for c in counters])


def stage_rates(runs: DataFrame, units_ahead: int) -> DataFrame:
    """Time for a unit of each stage, over runs that did any, and for the units ahead."""
    out = runs.where("units > 0").groupBy("stage").agg((F.sum("ms") / F.sum("units")).alias("ms_per_unit"))
    return out.withColumn("eta_ms", F.col("ms_per_unit") * units_ahead)


# Features that are billed no more, and the cadences of rebuilding.
RETIRED = ("judge", "synthesis", "miner", "audit", "grade", "discover", "assign", "rules", "knowledge")
CADENCE_MS = {"daily": 86_400_000, "weekly": 7 * 86_400_000}


def eta(rates: DataFrame, ahead: DataFrame) -> DataFrame:
    """One row: eta_ms of the stages ahead (stage, units); null if a stage with work was never measured."""
    own = ahead.join(rates.select("stage", "ms_per_unit"), "stage", "left")
    unknown = F.col("units").isNull() | (F.col("units") < 0) | ((F.col("units") > 0) & F.col("ms_per_unit").isNull())
    total = F.coalesce(F.sum(F.when(F.col("units") > 0, F.col("units") * F.col("ms_per_unit"))), F.lit(0.0))
    return own.agg(F.when(~F.coalesce(F.bool_or(unknown), F.lit(False)), F.floor(total + 0.5)).alias("eta_ms"))


def turn_summary(turns: DataFrame, keys: list[str], ms: str) -> DataFrame:
    """Number, rounded mean and p90 of the durations of each key; what is no duration is left out."""
    from .mirror import counted_quantiles

    own = turns.where((F.col(ms) >= 0) & ~F.isnan(F.col(ms).cast("double")) & (F.col(ms).cast("double") < float("inf")))
    mean = own.groupBy(*keys).agg(F.floor(F.avg(ms) + 0.5).alias("mean_ms"))
    p90 = counted_quantiles(own, keys, ms, {"p90": 0.9})
    return p90.join(mean, keys).select(*keys, "n", "mean_ms", F.floor(F.col("p90") + 0.5).alias("p90_ms"))


def lifetime_spend(usage: DataFrame) -> DataFrame:
    """Cost of features in use and of retired ones. usage: feature, cost."""
    gone = F.col("feature").isin(*RETIRED)
    part = lambda test: F.coalesce(F.sum(F.when(test, F.col("cost"))), F.lit(0.0))
    return usage.agg(part(~gone).alias("live"), part(gone).alias("retired"))


def refresh_due(waiting: int, last_ms: int | None, now_ms: int, by_hand: bool = False, cadence: str = "weekly", cooldown_ms: int | None = None) -> str | None:
    """Why to refresh now, or None. A time that is missing counts as long ago."""
    if by_hand:
        return "by hand"
    if not waiting:
        return None
    if last_ms is None:
        return "first"
    return "scheduled" if now_ms - last_ms >= (cooldown_ms or CADENCE_MS[cadence]) else None


def naming_sample(members: DataFrame, keys: list[str], order: list[str], shown: int = 4, least: int = 3) -> DataFrame:
    """The first distinct clipped replies of each key, at most so many. members: keys, order, reply."""
    from ..functions.text import clip

    own = members.withColumn("line", clip(F.col("reply"), 240)).where(F.length("line") >= least)
    first = own.groupBy(*keys, "line").agg(F.min(F.struct(*order)).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).where(F.col("place") <= shown).drop("at")
