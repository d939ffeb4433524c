"""The descriptive read: what the turns of a record add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.numbers import DAY_MS, floor_quantile, rate, working_day
from ..functions.text import is_question, trim_white, word_count
from .exchanges import is_typed
from .metrics import hours_to_cover, longest_streak


def repeated_texts(messages: DataFrame, text: str, top: int = 8) -> DataFrame:
    """Texts that were typed more than once, the most frequent first."""
    counts = messages.select("record", trim_white(F.col(text)).alias("text")).where("text <> ''").groupBy("record", "text").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("record").orderBy(F.desc("n"), "text"))).where(F.col("rank") <= top)


def friction(turns: DataFrame) -> DataFrame:
    """Corrections, stops and refusals per record, and their number for a hundred messages."""
    human = F.col("role") == "user"
    out = turns.groupBy("record").agg(
        F.count_if(is_typed(F.col("role"), F.col("interrupted"), F.col("text"))).alias("messages"),
        F.count_if(human & F.col("interrupted") & (F.coalesce("interrupt_kind", F.lit("plain")) == "plain")).alias("corrections"),
        F.count_if(human & F.col("interrupted") & (F.col("interrupt_kind") == "tool-use")).alias("permission_stops"),
        F.count_if(human & (F.col("denial") == "user-rejected")).alias("declines"),
        F.count_if(human & (F.col("denial") == "automode-blocked")).alias("system_blocks"),
    )
    return out.withColumn("per_hundred", rate(100 * (F.col("corrections") + F.col("declines")), F.col("messages")))


def counted_quantiles(values: DataFrame, keys: list[str], column: str, fractions: dict[str, float]) -> DataFrame:
    """Elements at floor(n * fraction) of the sorted values of each key, from counts of values.

    Only distinct values are sorted, so a key with many rows needs no more room than its values.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(*keys)
    counts = counts.withColumns({"upto": F.sum("n").over(by.orderBy(column)), "total": F.sum("n").over(by)})
    picks = {name: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(f))), F.col(column))) for name, f in fractions.items()}
    return counts.groupBy(*keys).agg(F.max("total").alias("n"), *[c.alias(name) for name, c in picks.items()])


def repo_roots(folders: DataFrame) -> DataFrame:
    """Each folder with the shortest folder of the set that contains it, itself if none.

    Every folder looks up its own ancestors, so nothing is compared with everything.
    """
    parts = F.split(F.rtrim(F.col("folder"), F.lit("/")), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    each = folders.select("record", "folder", F.explode(ancestors).alias("prefix")).where("prefix <> ''")
    known = folders.select("record", F.rtrim(F.col("folder"), F.lit("/")).alias("prefix"), F.col("folder").alias("root")).distinct()
    found = each.join(known, ["record", "prefix"])
    return found.groupBy("record", "folder").agg(F.min_by("root", F.struct(F.length("root"), "root")).alias("root"))


def mix(turns: DataFrame, column: str, reported: str | None = None) -> DataFrame:
    """Names in an array column of the assistant's turns, with counts, shares and rank, the most frequent first.

    Shares are of all names or, if the source reports a count of its own (reported), of that: what has no
    readable name was still handed off.
    """
    own = turns.where("role = 'assistant'")
    counts = own.select("record", F.explode(column).alias("name")).groupBy("record", "name").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum(F.size(column)) if reported is None else F.sum(reported)
    totals = own.groupBy("record").agg(F.coalesce(total, F.lit(0)).alias("total"))
    ranked = counts.join(totals, "record").withColumn("share", rate(F.col("n"), F.col("total")))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("record").orderBy(F.desc("n"), "name")))


def friction_events(turns: DataFrame) -> DataFrame:
    """(record, uuid, ts, kind) of every stop and refusal: the receipts of the counts. A turn can be both."""
    stop = F.when(F.coalesce("interrupted", F.lit(False)), F.when(F.col("interrupt_kind") == "tool-use", "permission-stop").otherwise("course-correction"))
    refusal = F.when(F.col("denial") == "user-rejected", "tool-decline").when(F.col("denial") == "automode-blocked", "system-block")
    return turns.where("role = 'user'").select("record", "uuid", "ts", F.explode(F.array_compact(F.array(stop, refusal))).alias("kind"))


def topics(titles: DataFrame, turns: DataFrame) -> DataFrame:
    """Distinct titles (record, title) of the sessions that have turns."""
    return titles.join(turns.select("session").distinct(), "session", "left_semi").select("record", trim_white(F.col("title")).alias("title")).where("title <> ''").distinct()


def hourly(messages: DataFrame) -> DataFrame:
    return messages.groupBy("record", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def repos(typed: DataFrame) -> DataFrame:
    """(record, root, messages) of the typed turns that name a folder."""
    folders = typed.where("cwd <> ''").groupBy("record", F.col("cwd").alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    return folders.join(repo_roots(folders.select("record", "folder")), ["record", "folder"]).groupBy("record", "root").agg(F.sum("n").alias("messages"))


def places(typed: DataFrame) -> DataFrame:
    """Repositories, branch names, and pairs of the two, per record. A detached HEAD is no branch; a folder counts as its root."""
    roots = repo_roots(typed.where("cwd <> ''").select("record", F.col("cwd").alias("folder")).distinct())
    on_branch = typed.where("git_branch <> '' and git_branch <> 'HEAD'").select("record", F.coalesce("cwd", F.lit("")).alias("folder"), "git_branch").distinct()
    pairs = on_branch.join(roots, ["record", "folder"], "left").groupBy("record").agg(F.countDistinct(F.coalesce("root", "folder"), "git_branch").alias("branch_pairs"), F.countDistinct("git_branch").alias("branch_names"))
    counted = roots.groupBy("record").agg(F.countDistinct("root").alias("repos"))
    every = typed.select("record").distinct().join(counted, "record", "left").join(pairs, "record", "left")
    return every.select("record", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("repos", "branch_names", "branch_pairs")])


def mirror(turns: DataFrame, titles: DataFrame | None = None, limits: Thresholds = DEFAULT) -> DataFrame:
    """One row for each record: messages, days, lengths, friction, hours, places."""
    human = turns.where("role = 'user'").withColumns({"at": F.try_to_timestamp("ts"), "day": working_day(F.try_to_timestamp("ts"))})
    typed = human.where(is_typed(F.col("role"), F.col("interrupted"), F.col("text")))
    plain = typed.where(F.length("text") <= limits.paste_bound)
    days = typed.select("record", "day").where("day is not null")
    # Lengths are in words.
    lengths = counted_quantiles(plain.withColumn("len", word_count(F.col("text"))), ["record"], "len", {"len_p25": 0.25, "len_median": 0.5, "len_p75": 0.75, "len_p90": 0.9}).drop("n")
    whole = typed.groupBy("record").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg(is_question(F.col("text")).cast("int")).alias("question_share"),
        F.count_if(F.length("text") > limits.paste_bound).alias("pastes"),
        F.coalesce(F.round((F.unix_millis(F.max("at")) - F.unix_millis(F.min("at"))) / DAY_MS) + 1, F.lit(0)).cast("long").alias("span_days"),
    )
    bad = (F.col("interrupted") & (F.coalesce("interrupt_kind", F.lit("plain")) == "plain")) | (F.col("denial") == "user-rejected")
    trouble = human.where(bad & F.col("day").isNotNull()).groupBy("record").agg(F.countDistinct("day").alias("days_with_any"))
    terse = plain.groupBy("record").agg(F.avg((word_count(F.col("text")) <= 4).cast("int")).alias("terse_share"))
    per_day = days.groupBy("record", "day").agg(F.count(F.lit(1)).alias("n"))
    active = per_day.groupBy("record").agg(F.count(F.lit(1)).alias("active_days"), floor_quantile(F.sort_array(F.collect_list("n")), 0.5).alias("median_per_day"))
    images = turns.where("role = 'user'").groupBy("record").agg(F.sum(F.coalesce("images", F.lit(0))).alias("images"))
    calls = turns.groupBy("record").agg(F.sum(F.coalesce(F.size(F.coalesce("tools", F.array().cast("array<string>"))), F.lit(0))).alias("tool_calls"))
    cover = hours_to_cover(hourly(typed.withColumn("ts", F.col("at")).where("ts is not null")), ["record"])
    out = friction(turns)
    for part in (whole, trouble, places(typed), calls, lengths, terse, active, longest_streak(days.distinct(), ["record"]), images, cover):
        out = out.join(part, "record", "left")
    if titles is not None:
        out = out.join(topics(titles, turns).groupBy("record").agg(F.count(F.lit(1)).alias("topics")), "record", "left")
    return out
