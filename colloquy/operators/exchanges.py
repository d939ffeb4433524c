"""Turns to exchanges: what was asked, what was answered, and the human reaction that closed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.numbers import parsed_millis, working_day
from ..functions.text import is_term, raw_terms, trim_white

KEYS = ["record", "session"]


def is_typed(role: Column, interrupted: Column, text: Column) -> Column:
    return (role == "user") & ~F.coalesce(interrupted, F.lit(False)) & (F.length(F.coalesce(text, F.lit(""))) > 0)


def content_hash(prompt: Column, said: Column, reaction: Column) -> Column:
    zero = F.lit("\0")
    return F.substring(F.sha2(F.concat(prompt, zero, said, zero, reaction), 256), 1, 16)


def pair_exchanges(turns: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """One row for each typed message, with the assistant side before it.

    turns: record, session, pos, ts, role, text, interrupted, interrupt_kind, denial, denied_tools,
    tools, cwd, git_branch, images. A typed message closes the pair; interrupts and denials before it
    belong to the pair; working folder, branch and the time of the last answer are carried on.
    """
    seen = Window.partitionBy(*KEYS).orderBy("pos")
    typed = is_typed(F.col("role"), F.col("interrupted"), F.col("text"))
    own = turns.withColumn("closes", typed)
    own = own.withColumns(
        {
            "pair": F.coalesce(F.sum(F.col("closes").cast("int")).over(seen.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "cwd": F.last(F.nullif("cwd", F.lit("")), ignorenulls=True).over(seen),
            "git_branch": F.last(F.nullif("git_branch", F.lit("")), ignorenulls=True).over(seen),
        }
    )
    assistant, human = F.col("role") == "assistant", F.col("role") == "user"
    ordered = lambda test, *columns: F.array_sort(F.collect_list(F.when(test, F.struct("pos", *columns))))
    refused = human & ~F.coalesce("interrupted", F.lit(False)) & (F.col("denial") == "user-rejected")
    pairs = own.groupBy(*KEYS, "pair").agg(
        F.bool_or("closes").alias("closed"),
        F.max(F.when(F.col("closes"), F.col("text"))).alias("raw"),
        F.max(F.when(F.col("closes"), F.col("ts"))).alias("ts"),
        F.max_by("ts", F.when(assistant & (F.col("ts") != ""), F.col("pos"))).alias("said_ts"),
        F.max(F.when(F.col("closes"), F.coalesce("images", F.lit(0)))).alias("images"),
        F.max_by("cwd", "pos").alias("cwd"),
        F.max_by("git_branch", "pos").alias("branch"),
        ordered(assistant & (F.col("text") != ""), "text").alias("said"),
        F.flatten(F.transform(ordered(assistant & F.col("tools").isNotNull(), "tools"), lambda x: x["tools"])).alias("tools"),
        F.flatten(F.transform(ordered(refused & F.col("denied_tools").isNotNull(), "denied_tools"), lambda x: x["denied_tools"])).alias("denied"),
        F.max_by(F.coalesce("interrupt_kind", F.lit("plain")), F.when(human & F.col("interrupted"), F.col("pos"))).alias("interrupted"),
        F.coalesce(F.bool_or(refused), F.lit(False)).alias("declined"),
    )
    pairs = pairs.where("closed").withColumn("said_raw", trim_white(F.array_join(F.transform("said", lambda x: x["text"]), "\n")))
    order = Window.partitionBy(*KEYS).orderBy("pair")
    raw_prompt = F.coalesce(F.lag("raw").over(order), F.lit(""))
    pairs = pairs.withColumns(
        {
            "idx": F.row_number().over(order) - 1,
            "of_session": F.count(F.lit(1)).over(Window.partitionBy(*KEYS)),
            "last_of_session": F.lead(F.lit(1)).over(order).isNull(),
            "ask_len": F.length(raw_prompt),
            "prompt": F.substring(raw_prompt, 1, limits.text_cap),
            "said": F.right("said_raw", F.lit(limits.text_cap)),
            "said_head": F.nullif(F.substring("said_raw", 1, limits.said_head), F.lit("")),
            "said_len": F.length("said_raw"),
            "reaction": F.substring("raw", 1, limits.text_cap),
            "reply_len": F.length("raw"),
            "ts": F.coalesce(F.nullif("ts", F.lit("")), F.last("said_ts", ignorenulls=True).over(order), F.lit("")),
        }
    )
    pairs = pairs.withColumns(
        {
            "hash": content_hash(F.col("prompt"), F.col("said"), F.col("reaction")),
            "pasted": (F.length("prompt") > limits.paste_bound) | (F.length("reaction") > limits.paste_bound),
            "gap_sec": gap_seconds(parsed_millis(F.col("ts")), F.lag(parsed_millis(F.col("ts"))).over(order)),
        }
    )
    return pairs.drop("raw", "pair", "closed", "said_ts").withColumnRenamed("said_raw", "said_full")


def gap_seconds(now: Column, before: Column) -> Column:
    """Rounded seconds since the row before; null for the first, and for clocks that ran back."""
    gap = (now - before) / 1000
    return F.when(gap >= 0, F.floor(gap + 0.5).cast("long"))


def mark_first_of_day(exchanges: DataFrame, at: str = "ts", order: tuple[str, ...] = ("ts", "session", "idx")) -> DataFrame:
    """first_of_day: the first exchange of each day that starts at four, by record. Minima merge before the shuffle."""
    own = exchanges.withColumns({"__day": working_day(F.to_timestamp(at)), "__at": F.struct(*order)})
    first = own.where("__day is not null").groupBy("record", "__day").agg(F.min("__at").alias("__first"))
    return own.join(first, ["record", "__day"], "left").withColumn("first_of_day", F.coalesce(F.col("__at") == F.col("__first"), F.lit(False))).drop("__day", "__at", "__first")


def newest_per_hash(exchanges: DataFrame) -> DataFrame:
    """One row for each (record, hash): of the newest file, at the latest position."""
    newest = Window.partitionBy("record", "hash").orderBy(F.desc("mtime"), F.desc("idx"), "session")
    return exchanges.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def to_moments(exchanges: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """The capped projection that is stored: identity, pile, excerpts, distinct tools, true lengths."""
    return exchanges.select(
        "record", F.col("hash").alias("key"), "session", "ts", pile_of(F.col("declined"), F.col("interrupted")).alias("pile"),
        F.substring("reaction", 1, limits.reply_cap).alias("reply"), "reply_len",
        F.array_distinct("tools").alias("tools"), F.size("tools").alias("calls"), F.array_distinct("denied").alias("denied"),
        F.substring("said", 1, limits.excerpt).alias("ai_head"), F.right("said", F.lit(limits.excerpt)).alias("ai_tail"), "said_len",
        F.transform(term_counts(F.col("said_full"), limits.terms_cap), lambda x: x["term"]).alias("ai_terms"),
    )


def pile_of(declined: Column, interrupted: Column) -> Column:
    return F.when(declined, "decline").when(interrupted == "plain", "interrupt").otherwise("ordinary")


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't stored yet."""
    return incoming.join(stored.select(*keys).distinct(), keys, "left_anti")


def term_counts(text: Column, cap: int) -> Column:
    """The most frequent terms of a text, by count, first position and name, as (neg, first_pos, term), neg the count below zero.

    All within the row: terms are sorted so that equal ones are neighbours, and counted by where they begin.
    """
    found = F.filter(F.transform(raw_terms(F.coalesce(text, F.lit(""))), lambda t, i: F.struct(t.alias("term"), i.alias("pos"))), lambda x: is_term(x["term"]))

    def counted(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1)["term"] != F.get(s, i - 2)["term"]))
        entry = lambda b: F.transform(b, lambda i, k: F.struct((i - F.coalesce(F.get(b, k + 1), F.size(s) + 1)).alias("neg"), F.get(s, i - 1)["pos"].alias("first_pos"), F.get(s, i - 1)["term"].alias("term")))
        return F.slice(F.sort_array(F.get(F.transform(F.array(begins), entry), F.lit(0))), 1, cap)

    # As arguments of lambdas the sorted terms and their beginnings are made once for a text.
    none = F.array().cast("array<struct<neg:int,first_pos:int,term:string>>")
    return F.get(F.transform(F.array(F.sort_array(found)), lambda s: F.when(F.size(s) > 0, counted(s)).otherwise(none)), F.lit(0))


def top_terms(texts: DataFrame, keys: list[str], text: str, cap: int = DEFAULT.terms_cap) -> DataFrame:
    """The most frequent terms of each row, with count, first position and rank. Rows of equal keys stay apart."""
    each = texts.select(*keys, F.posexplode(term_counts(F.col(text), cap)).alias("rank", "x"))
    return each.select(*keys, "x.term", (-F.col("x.neg")).cast("long").alias("n"), "x.first_pos", (F.col("rank") + 1).alias("rank"))


def with_any_term(rows: DataFrame, terms: str, wanted: list[str]) -> DataFrame:
    """The rows whose array has any of the terms."""
    return rows.where(F.coalesce(F.arrays_overlap(F.col(terms), F.lit(wanted).cast("array<string>")), F.lit(False)))


def _by_file(exchanges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each exchange in its newest file; and the files, newest first, with how many exchanges they and those before hold."""
    first = exchanges.withColumn("__f", F.row_number().over(Window.partitionBy("hash").orderBy(F.desc("mtime"), "path", "idx"))).where("__f = 1").drop("__f")
    files = exchanges.select("path", "mtime").distinct().join(first.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "path", "left")
    order = Window.orderBy(F.desc("mtime"), "path")  # files, not exchanges
    return first, files.withColumns({"place": F.row_number().over(order), "held": F.sum(F.coalesce("n", F.lit(0))).over(order)})


def holds_enough(exchanges: DataFrame, want: int, margin: int = 4) -> bool:
    """Whether the files of these exchanges, the newest of an archive, are all that recent_exchanges takes from it."""
    row = _by_file(exchanges)[1].agg(F.min(F.when(F.col("held") >= want, F.col("place"))).alias("enough"), F.max("place").alias("last")).first()
    return row["enough"] is not None and row["last"] >= row["enough"] + margin


def recent_exchanges(exchanges: DataFrame, want: int, margin: int = 4) -> DataFrame:
    """The latest exchanges, with the first of each day marked.

    Of each record's archive the newest files count, until they hold so many distinct exchanges and a margin
    of files more; the latest of those by time stay. exchanges: record, path, mtime, ts, session, idx, hash.
    File sizes are summed before files are ordered, so that only files, not exchanges, meet in one window.
    sources.recent reads no more of an archive than that takes.
    """
    first, files = _by_file(exchanges)
    enough = files.where(F.col("held") >= want).agg(F.min("place").alias("enough"))
    read = files.join(enough).where(F.col("enough").isNull() | (F.col("place") <= F.col("enough") + margin)).select("path")
    marked = mark_first_of_day(first.join(read, "path", "left_semi"), order=("ts", "session", "idx"))
    return marked.orderBy(F.desc("ts"), F.desc("session"), F.desc("idx")).limit(want)


def find_exchange(exchanges: DataFrame, session: str, key: str) -> DataFrame:
    """The exchange of a hash in a session, named by its id or by its file; of several copies the newest file's."""
    name = F.regexp_extract("path", "([^/]*?)(\\.jsonl)?$", 1)
    found = exchanges.where((F.col("hash") == key) & ((F.col("session") == session) | (name == session)))
    return found.orderBy(F.desc("mtime"), "path", "idx").limit(1)
