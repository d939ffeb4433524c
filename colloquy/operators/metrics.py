"""Statistics of labelled moments: lift, trend, burst, adjacency, gaps, trailing windows.

Labelled moments have record, session, key, ms (epoch milliseconds), pile, kinds (array), tools,
denied. Negative piles are interrupt and decline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.numbers import DAY_MS, WEEK_MS, lift, rate, round_half_up


def is_negative() -> Column:
    return F.col("pile").isin("interrupt", "decline")


def label(moments: DataFrame, assignments: DataFrame) -> DataFrame:
    """Moments with the kinds that were assigned to them; several assignments give several rows."""
    return assignments.select("record", "key", "kinds").join(moments, ["record", "key"])


def tally(labelled: DataFrame, categories: DataFrame) -> DataFrame:
    """Per category: count, sessions, lift, seen first and last; categories without rows stay, with 0."""
    totals = labelled.groupBy("record").agg(F.count_if(is_negative()).alias("neg_total"), F.count_if(F.col("pile") == "ordinary").alias("ord_total"))
    each = labelled.withColumn("name", F.explode(F.array_distinct("kinds")))
    stats = each.groupBy("record", "name").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("sessions"), F.count_if(is_negative()).alias("neg"),
        F.count_if(F.col("pile") == "ordinary").alias("ord"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"),
    )
    out = categories.join(stats, ["record", "name"], "left").join(totals, "record", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", "sessions", "neg", "ord", "neg_total", "ord_total")}
    out = out.withColumns(zero)
    return out.withColumn("lift", lift(F.col("neg"), F.col("neg_total"), F.col("ord"), F.col("ord_total")))


def personal(categories: DataFrame) -> DataFrame:
    """Categories of the person; those of the project at hand (scope) are reported nowhere."""
    return categories.where(F.coalesce("scope", F.lit("")) != "project") if "scope" in categories.columns else categories


def verdicts(labelled: DataFrame, categories: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """The tally with burst, direction, action and verified.

    A category that fades is looked at from the assistant's side too: if the action that answers it was
    supplied as before, and not refused more often, the need is met; if it was supplied less, the fading is
    verified.
    """
    keys = ["record", "name"]
    directions = trend(labelled, limits).select(*keys, "direction")
    actions = action_mapping(labelled, limits).select(*keys, "action").join(directions.where("direction = 'fading'"), keys, "left_semi")
    supplied = supply(labelled, actions, limits).select(*keys, "action", "supply_ratio", "declines_rose")
    out = tally(labelled, categories).join(burst(labelled, limits).select(*keys, "burst"), keys, "left").join(directions, keys, "left").join(supplied, keys, "left")
    met = F.coalesce((F.col("supply_ratio") >= limits.fade) & ~F.col("declines_rose"), F.lit(False))
    quiet = F.coalesce(F.col("supply_ratio") <= limits.fade, F.lit(False))
    return out.withColumns({"burst": F.coalesce("burst", F.lit(False)), "direction": F.when(met, "met").otherwise(F.col("direction")), "verified": met | quiet}).drop("supply_ratio", "declines_rose")


def signal_categories(tallied: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    return tallied.where((F.col("lift") >= limits.lift_cut) & (F.col("sessions") >= limits.min_sessions))


def scoreboard(labelled: DataFrame, signals: DataFrame) -> DataFrame:
    """Per record, moments that carry any signal category, and their number in a hundred."""
    names = signals.groupBy("record").agg(F.collect_set("name").alias("signals"))
    own = labelled.join(names, "record", "left").withColumn("carries", F.coalesce(F.arrays_overlap("kinds", "signals"), F.lit(False)))
    out = own.groupBy("record").agg(F.count(F.lit(1)).alias("moments"), F.count_if("carries").alias("carrying"))
    return out.withColumn("per_hundred", round_half_up(rate(F.col("carrying") * 100, F.col("moments")), 1))


def misfit_rate(labelled: DataFrame, since_ms: int | None = None) -> DataFrame:
    own = labelled if since_ms is None else labelled.where(F.col("ms") >= since_ms)
    return own.groupBy("record").agg(F.count(F.lit(1)).alias("moments"), F.count_if(F.size("kinds") == 0).alias("misfits")).withColumn("rate", rate(F.col("misfits"), F.col("moments")))


def burst(labelled: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Categories of which one epoch week holds half of the rows or more."""
    each = labelled.withColumn("name", F.explode(F.array_distinct("kinds")))
    weeks = each.groupBy("record", "name", F.floor(F.col("ms") / WEEK_MS).alias("week")).agg(F.count(F.lit(1)).alias("n"))
    out = weeks.groupBy("record", "name").agg(F.sum("n").alias("n"), F.max(F.when(F.col("week").isNotNull(), F.col("n"))).alias("busiest"))
    return out.withColumn("burst", F.coalesce(F.col("busiest") >= limits.burst_share * F.col("n"), F.lit(False)))


def in_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows (record, ms, others) with each span (lo, hi, others) of their record that they lie in.

    A record has as many spans as categories, a few dozen: they are one array, so that a row of the
    record meets one row, and looks its spans up there.
    """
    columns = [c for c in spans.columns if c != "record"]
    of_record = spans.groupBy("record").agg(F.collect_list(F.struct(*columns)).alias("__spans"))
    inside = F.filter("__spans", lambda s: F.col("ms").between(s["lo"], s["hi"]))
    return rows.join(of_record, "record").withColumn("__span", F.explode(inside)).select(*rows.columns, "__span.*")


def trend(labelled: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Rates of a category before and after the middle of its own span, and its direction.

    Every moment counts for the spans of its record that it lies in.
    """
    each = labelled.where("ms is not null").select("record", "ms", F.explode(F.array_distinct("kinds")).alias("name"))
    span = each.groupBy("record", "name").agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    span = span.where((F.col("n") >= limits.trend_min) & (F.col("hi") > F.col("lo"))).withColumn("mid", F.col("lo") + (F.col("hi") - F.col("lo")) / 2)
    own = each.join(span, ["record", "name"]).groupBy("record", "name").agg(F.count_if(F.col("ms") < F.col("mid")).alias("early"), F.count_if(F.col("ms") >= F.col("mid")).alias("late"))
    within = in_spans(labelled.where("ms is not null").select("record", "ms"), span.select("record", "name", "lo", "mid", "hi"))
    everything = within.groupBy("record", "name").agg(F.count_if(F.col("ms") < F.col("mid")).alias("early_all"), F.count_if(F.col("ms") >= F.col("mid")).alias("late_all"))
    out = own.join(everything, ["record", "name"])
    out = out.withColumns({"early_rate": rate(F.col("early"), F.col("early_all")), "late_rate": rate(F.col("late"), F.col("late_all"))})
    rising = (F.col("early_rate") == 0) & (F.col("late_rate") > 0) | (F.col("early_rate") > 0) & (F.col("late_rate") >= F.col("early_rate") * limits.rise)
    fading = (F.col("early_rate") > 0) & (F.col("late_rate") <= F.col("early_rate") * limits.fade)
    return out.withColumn("direction", F.when(rising, "rising").when(fading, "fading"))


def with_next(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """next_<column> of the following moment of the session; ties in time by key."""
    order = Window.partitionBy("record", "session").orderBy("ms", "key")
    return labelled.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns} | {"has_next": F.lead(F.lit(True)).over(order).isNotNull()})


def action_mapping(labelled: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """For each category the action that follows it far more often than it occurs, if any."""
    totals = labelled.groupBy("record").agg(F.count(F.lit(1)).alias("total"))
    base = labelled.select("record", F.explode(F.array_distinct("tools")).alias("action")).groupBy("record", "action").agg(F.count(F.lit(1)).alias("base"))
    answered = with_next(labelled, ["tools"]).where("has_next").select("record", F.explode(F.array_distinct("kinds")).alias("name"), "next_tools")
    sizes = answered.groupBy("record", "name").agg(F.count(F.lit(1)).alias("answered")).where(F.col("answered") >= limits.adjacency_min)
    follows = answered.select("record", "name", F.explode(F.array_distinct("next_tools")).alias("action")).groupBy("record", "name", "action").agg(F.count(F.lit(1)).alias("n"))
    pairs = follows.join(sizes, ["record", "name"]).join(base.where(F.col("base") >= limits.action_min), ["record", "action"]).join(totals, "record")
    pairs = pairs.withColumn("p", F.col("n") / F.col("answered")).withColumn("lift", F.col("p") / (F.col("base") / F.col("total")))
    pairs = pairs.where((F.col("p") >= limits.adjacency_p) & (F.col("lift") >= limits.adjacency_lift))
    best = F.row_number().over(Window.partitionBy("record", "name").orderBy(F.desc("lift"), "action"))
    return pairs.withColumn("rank", best).where("rank = 1").drop("rank")


def supply(labelled: DataFrame, actions: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """How the share of a category's action changed between the halves of the category's span.

    actions: record, name, action. Records without any denial have no answer.
    """
    each = labelled.where("ms is not null").select("record", "ms", F.explode(F.array_distinct("kinds")).alias("name"))
    span = each.groupBy("record", "name").agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    span = span.where((F.col("n") >= limits.trend_min) & (F.col("hi") > F.col("lo"))).withColumn("mid", F.col("lo") + (F.col("hi") - F.col("lo")) / 2)
    told = labelled.where(F.size("denied") > 0).select("record").distinct()
    asked = span.join(actions.select("record", "name", "action"), ["record", "name"]).join(told, "record", "left_semi")
    rows = in_spans(labelled.where("ms is not null").select("record", "ms", "tools", "denied"), asked)
    late, acts, refused = F.col("ms") >= F.col("mid"), F.array_contains("tools", F.col("action")), F.coalesce(F.array_contains("denied", F.col("action")), F.lit(False))
    out = rows.groupBy("record", "name", "action").agg(*[
        F.count_if(test & side).alias(f"{when}_{what}")
        for when, side in (("early", ~late), ("late", late)) for what, test in (("all", F.lit(True)), ("acts", acts), ("refused", refused))
    ])
    out = out.where("early_all > 0 and late_all > 0 and (early_acts > 0 or late_acts > 0)")
    early, late_ = F.col("early_acts") / F.col("early_all"), F.col("late_acts") / F.col("late_all")
    out = out.withColumn("supply_ratio", F.when(early == 0, float("inf")).otherwise(late_ / F.nullif(early, F.lit(0.0))))
    return out.withColumn("declines_rose", rate(F.col("late_refused"), F.col("late_acts")) > rate(F.col("early_refused"), F.col("early_acts")) * limits.rise)


def gap_candidates(labelled: DataFrame, signals: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Signal categories that slip although they are often reached; whether the slip came first in a session."""
    each = labelled.select("record", "session", "ms", "key", "pile", F.explode(F.array_distinct("kinds")).alias("name"))
    each = each.join(signals.select("record", "name"), ["record", "name"], "left_semi")
    told = is_negative() | (F.col("pile") == "ordinary")
    sessions = each.groupBy("record", "name", "session").agg(
        F.count_if(is_negative()).alias("slips"), F.count_if(F.col("pile") == "ordinary").alias("reaches"),
        F.min_by(is_negative(), F.when(told, F.struct("ms", "key"))).alias("slip_first"),
    )
    out = sessions.groupBy("record", "name").agg(
        F.sum("reaches").alias("reach"), F.sum("slips").alias("slip"), F.count_if(F.col("slips") > 0).alias("slip_sessions"),
        F.count_if((F.col("slips") > 0) & F.col("slip_first")).alias("stumbles"), F.count_if((F.col("slips") > 0) & ~F.col("slip_first")).alias("guarded"),
    )
    enough = (F.col("slip") >= limits.slip_min) & (F.col("reach") >= limits.reach_min) & (F.col("slip_sessions") >= limits.slip_sessions)
    return out.where(enough & (F.col("stumbles") >= limits.stumble_sessions))


def trailing(labelled: DataFrame, now_ms: Column, limits: Thresholds = DEFAULT) -> DataFrame:
    """The rows of the last days up to now."""
    return labelled.where(F.col("ms").between(now_ms - limits.recent_days * DAY_MS, now_ms))


def gap_window_reads(labelled: DataFrame, categories: DataFrame, now_ms: Column, limits: Thresholds = DEFAULT) -> DataFrame:
    """Per category (record, name) over the last days: slip_rate, stumbles, reach, sample, chances. Quiet windows read as zeros."""
    keys = ["record", "name"]
    window = trailing(labelled, now_ms, limits)
    sample = window.groupBy("record").agg(F.count(F.lit(1)).alias("sample"))
    each = window.select("record", "session", "ms", "key", "pile", F.explode(F.array_distinct("kinds")).alias("name")).join(categories.select(*keys).distinct(), keys, "left_semi")
    told = is_negative() | (F.col("pile") == "ordinary")
    sessions = each.groupBy(*keys, "session").agg(
        F.count_if(is_negative()).alias("slips"), F.count_if(F.col("pile") == "ordinary").alias("reaches"),
        F.min_by(is_negative(), F.when(told, F.struct("ms", "key"))).alias("slip_first"),
    )
    reads = sessions.groupBy(*keys).agg(F.sum("slips").alias("slips"), F.sum("reaches").alias("reach"), F.count_if((F.col("slips") > 0) & F.col("slip_first")).alias("stumbles"), F.count(F.lit(1)).alias("chances"))
    out = categories.select(*keys).distinct().join(reads, keys, "left").join(sample, "record", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("slips", "reach", "stumbles", "chances", "sample")}
    return out.withColumns(zero).withColumn("slip_rate", rate(F.col("slips"), F.col("sample"))).drop("slips")


def within_days(rows: DataFrame, window: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """The rows whose day lies in the evidence window of their keys."""
    return rows.join(window.select(*keys, "from_day", "to_day"), keys).where(F.col(day).between(F.col("from_day"), F.col("to_day"))).drop("from_day", "to_day")


def evidence_window(days: DataFrame, keys: list[str], limits: Thresholds = DEFAULT) -> DataFrame:
    """The latest stretch of days without a gap above the limit, if it has two days; else the whole span.

    days: keys and day, distinct.
    """
    order = Window.partitionBy(*keys).orderBy("day")
    new = (F.datediff("day", F.lag("day").over(order)) > limits.island_gap_days).cast("int")
    own = days.withColumn("new", F.coalesce(new, F.lit(0)))
    own = own.withColumn("island", F.sum("new").over(order))
    islands = own.groupBy(*keys, "island").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count(F.lit(1)).alias("days"))
    last = islands.groupBy(*keys).agg(F.max_by(F.struct("lo", "hi", "days"), "island").alias("l"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("days").alias("days"))
    good = F.col("l.days") >= 2
    return last.select(*keys, F.when(good, F.col("l.lo")).otherwise(F.col("lo")).alias("from_day"), F.when(good, F.col("l.hi")).otherwise(F.col("hi")).alias("to_day"), F.when(good, F.col("l.days")).otherwise(F.col("days")).alias("days"))


def longest_streak(days: DataFrame, keys: list[str]) -> DataFrame:
    """Days in a row, at most, of distinct days."""
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(*keys).orderBy("day")))
    return days.withColumn("island", island).groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("streak"))


def hours_to_cover(hourly: DataFrame, keys: list[str], fractions: tuple[float, ...] = (0.8, 0.9)) -> DataFrame:
    """How many of the busiest hours hold each fraction of the rows. hourly: keys, hour, n."""
    by = Window.partitionBy(*keys)
    run = F.coalesce(F.sum("n").over(by.orderBy(F.desc("n"), "hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = hourly.where("n > 0").withColumns({"run": run, "total": F.sum("n").over(by)})
    return own.groupBy(*keys).agg(*[F.count_if(F.col("run") < F.lit(f) * F.col("total")).alias(f"hours_{round(f * 100)}") for f in fractions])


def supported_clusters(moments: DataFrame, least: int = 2, most: int = 30, per: int = 3, low: int = 8) -> DataFrame:
    """The band of cluster numbers that so many conversations support."""
    out = moments.groupBy("record").agg(F.countDistinct("session").alias("sessions"))
    hi = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.col("sessions") / per))).cast("long")
    return out.withColumns({"hi": hi, "lo": F.least(F.lit(low), hi).cast("long")})


def admitted(members: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Clusters of enough sessions that no single anchor dominates. members: record, cluster, session, anchor."""
    out = members.groupBy("record", "cluster").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("sessions"), (F.count_if("anchor") / F.count(F.lit(1))).alias("anchor_share"))
    return out.where((F.col("sessions") >= limits.min_sessions) & (F.col("anchor_share") < limits.anchor_share))
