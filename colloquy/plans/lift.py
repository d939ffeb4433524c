"""The run over patches: measure the open ones again, release those that are done, mint new ones from gaps."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..operators import metrics, phrases
from ..operators.patches import ENTRY, SLIP_SAMPLE, next_state, rehome, trend_word, with_entry

PATCHES = (
    "id string, mode int, home string, pipeline string, centroid array<float>, born_ms long, base_fail double, base_engage double, action string, terms array<string>, "
    f"reach long, slip long, stumbles long, wording struct<text:string,x:string,do_this:string,y:string>, history array<{ENTRY}>, state string, via string, feedback boolean, seq long, record string"
)
TERMINAL = ("healed", "lapsed", "wrong")
# How many clauses are printed, and how many bounces the line on asks needs.
PRINT_CAP, META_FLOOR = 3, 10

#: From what is known of candidates (name, action, reach, slip) to their wording (text, x, do_this, y) by name.
Voice = Callable[[list[dict]], dict[str, dict]]


def _entry(now_ms: int, **parts: Column) -> Column:
    fields = ("fail", "sessions", "sample", "reach", "hold", "refused_rose", "engage")
    return F.struct(F.lit(now_ms).alias("built_ms"), *[parts.get(f, F.lit(None)).alias(f) for f in fields]).cast(ENTRY).alias("entry")


def released(patches: DataFrame, labelled: DataFrame, categories: DataFrame, centres: DataFrame, pipeline: str, now_ms: int, rituals: DataFrame | None = None, limits: Thresholds = DEFAULT) -> DataFrame:
    """The patches of a record after this run.

    Ended ones stay as they are. Of the others, those whose category is gone and that no centre is near to
    sleep; the rest are open, get an entry of this run's window, and may end. Patches of asks are not
    measured in a run that has no rituals (None): a failed reading is no quiet window.
    """
    ended = patches.where(F.col("state").isin(*TERMINAL))
    homed = rehome(patches.where(~F.col("state").isin(*TERMINAL)), categories.select("name").distinct(), centres, pipeline)
    asleep = homed.where("dormant").withColumn("state", F.lit("dormant"))
    awake = homed.where("not dormant").withColumn("state", F.lit("open"))

    slips = awake.where("mode = 1").select("record", "id", F.col("home").alias("name"), "action")
    reads = metrics.gap_window_reads(labelled, slips.select("record", "name"), F.lit(now_ms), limits)
    actions = metrics.action_mapping(labelled, limits).select("record", "name", "action").join(slips.where("action is not null"), ["record", "name"], "left_semi")
    supplied = metrics.supply(labelled, actions, limits).select("record", "name", "supply_ratio", "declines_rose")
    wants = F.col("action").isNotNull()
    entries = slips.join(reads, ["record", "name"]).join(supplied, ["record", "name"], "left").select(
        "id", _entry(now_ms, fail=F.col("slip_rate"), sessions=F.col("stumbles"), sample=F.col("sample"), reach=F.col("reach"), hold=F.when(wants, F.col("supply_ratio")), refused_rose=F.when(wants, F.col("declines_rose")))
    )
    if rituals is not None:
        asks = awake.where("mode = 2").select("record", "id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
        seen = phrases.ask_window_reads(labelled, rituals, asks, F.lit(now_ms), limits)
        entries = entries.unionByName(seen.select("id", _entry(now_ms, fail=F.col("ask_rate"), sessions=F.col("sessions"), sample=F.col("sample"), engage=F.col("engage_rate"))))
    measured = entries.select("id", F.lit(True).alias("measured"))
    judged = next_state(with_entry(awake.withColumnRenamed("via", "old_via"), entries), now_ms).withColumnsRenamed({"via": "next_via", "old_via": "via"})
    judged = judged.join(measured, "id", "left").withColumn("measured", F.coalesce("measured", F.lit(False)))
    moved = F.col("measured") & (F.col("next_state") != "open")
    judged = judged.withColumns({
        "state": F.when(moved, F.col("next_state")).otherwise(F.lit("open")), "via": F.when(moved & F.col("next_via").isNotNull(), F.col("next_via")).otherwise(F.col("via")),
        "feedback": F.when(moved & (F.col("next_state") == "wrong"), F.lit(True)).otherwise(F.col("feedback")),
    })
    columns = patches.columns
    return ended.select(columns).unionByName(asleep.select(columns)).unionByName(judged.select(columns))


def candidates(labelled: DataFrame, categories: DataFrame, patches: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Gaps of signal categories of the person that no patch was ever minted for, the most slips first."""
    signals = metrics.signal_categories(metrics.tally(labelled, metrics.personal(categories).select("record", "name")), limits)
    found = metrics.gap_candidates(labelled, signals, limits)
    covered = patches.where("mode = 1").select("record", F.col("home").alias("name")).distinct()
    return found.join(covered, ["record", "name"], "left_anti").orderBy(F.desc("slip"), "name")


def minted(labelled: DataFrame, found: DataFrame, centres: DataFrame, pipeline: str, now_ms: int, voice: Voice, limits: Thresholds = DEFAULT) -> DataFrame | None:
    """New patches of the candidates, worded by voice; None if the wording has numbers, which only counting may print.

    A candidate without a centre of the frozen model has no identity, one that doesn't fail now could never
    be refuted: neither is minted. Candidates are categories, a few dozen.
    """
    births = metrics.gap_window_reads(labelled, found.select("record", "name"), F.lit(now_ms), limits).where("slip_rate > 0")
    known = centres.select("record", F.col("label").alias("name"), F.col("centre").alias("centroid"))
    actions = metrics.action_mapping(labelled, limits).select("record", "name", "action")
    births = births.withColumnsRenamed({"reach": "now_reach", "stumbles": "now_stumbles"})
    ready = found.join(births, ["record", "name"]).join(known, ["record", "name"]).join(actions, ["record", "name"], "left")
    asked = [row.asDict() for row in ready.select("name", "action", "reach", "slip").orderBy(F.desc("slip"), "name").collect()]
    words = voice(asked) if asked else {}
    if any(re.search(r"\d", part or "") for w in words.values() for part in w.values()):
        return None
    spark = labelled.sparkSession
    worded = spark.createDataFrame([(name, (w["text"], w.get("x"), w.get("do_this"), w.get("y"))) for name, w in words.items()], "name string, wording struct<text:string,x:string,do_this:string,y:string>")
    none = F.lit(None)
    history = F.array(_entry(now_ms, fail=F.col("slip_rate"), sessions=F.col("now_stumbles"), sample=F.col("sample"), reach=F.col("now_reach")))
    return ready.join(F.broadcast(worded), "name").select(
        F.concat_ws("·", F.lit(str(now_ms)), "name").alias("id"), F.lit(1).alias("mode"), F.col("name").alias("home"), F.lit(pipeline).alias("pipeline"), F.col("centroid").cast("array<float>").alias("centroid"), F.lit(now_ms).cast("long").alias("born_ms"),
        F.col("slip_rate").alias("base_fail"), none.cast("double").alias("base_engage"), "action", none.cast("array<string>").alias("terms"), "reach", "slip", F.col("stumbles"), "wording", history.alias("history"),
        F.lit("open").alias("state"), none.cast("string").alias("via"), none.cast("boolean").alias("feedback"), F.lit(now_ms).cast("long").alias("seq"), "record",
    )


def run(patches: DataFrame, labelled: DataFrame, categories: DataFrame, centres: DataFrame, pipeline: str, now_ms: int, voice: Voice | None = None, rituals: DataFrame | None = None, limits: Thresholds = DEFAULT) -> DataFrame:
    """Prove, release and mint. Without a voice, or if its words are refused, nothing is minted and the rest stands."""
    kept = released(patches, labelled, categories, centres, pipeline, now_ms, rituals, limits)
    fresh = minted(labelled, candidates(labelled, categories, patches, limits), centres, pipeline, now_ms, voice, limits) if voice else None
    return kept if fresh is None else kept.unionByName(fresh.select(kept.columns))


def clauses(patches: DataFrame) -> DataFrame:
    """(record, name, clause, slip, trend) of the open patches with the most slips, three of each record."""
    own = patches.where("state = 'open' and mode = 1 and wording.text <> ''")
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("record").orderBy(F.desc(F.coalesce("slip", F.lit(0))), "seq", "id"))).where(F.col("place") <= PRINT_CAP)
    last = F.try_element_at("history", F.lit(-1))
    trend = F.when((last["sample"] >= SLIP_SAMPLE) & (F.col("base_fail") > 0), trend_word(F.col("history"), F.col("base_fail")))
    return own.select("record", F.col("home").alias("name"), F.col("wording.text").alias("clause"), F.coalesce("slip", F.lit(0)).alias("slip"), trend.alias("trend"), "place")


def key_lines(clause_count: int, asks: dict | None, delegated: int, ask_line: Callable[[dict], str], delegated_line: str) -> list[str]:
    """The lines that the run adds to the key: on asks if they bounced often enough, and on what is left to the assistant."""
    told = asks is not None and asks["bounces"] >= META_FLOOR
    lines = [ask_line(asks)] if told else []
    return lines + [delegated_line] if (clause_count or told) and delegated > 0 else lines
