"""Operator 4, chat formatting by quotation linking.

Lines of a message that start with > are quoted, as often as the mark is repeated. A run of quoted
lines of one level is a passage. Passages are normalised, hashed and joined to what messages of the
same conversation wrote themselves: whole paragraphs and lines, and, as a quote may be re-wrapped or
be part of a paragraph, all windows of `WINDOW` words. Each hash goes to the latest message before
the quoting one that wrote it; the passage's original is the message that most of its letters come
from, the latest of several. A message replies to the original of most letters among its outermost
passages that have one. Conversations are threads of replies: a thread starts with a message that
replies to none, and goes on in the order of turns, so a reply always follows what it replies to.

The latest message before a quote is looked up by blocks of `BLOCK` turns: a block holds the turns
that wrote a hash, and the last one of the blocks before it. So a line that a whole conversation
repeats gives neither pairs nor a long group. Only conversations with quotes are hashed.

Texts can't forge turns: a <| in a body or role is escaped with a backslash, before any backslashes
there, so it can be undone.

Defined results: a null or empty text is a message without lines; a quote without an original links
nothing, and leaves the text all the same; equal turns of a conversation are messages of their own
that share their links; a null conv_id or turn has no replies and starts a thread. A line such as
"Ada wrote:" directly before a quote belongs to the quote. Very long texts are read as a whole. Of
columns beyond conv_id, turn, role and text those that clash with results are replaced; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

QUOTE = r"^[ \t]*(>[ \t]*)+"
ATTRIBUTION = r"(?i)\b(wrote|writes|said|schrieb|écrit|escribió)\b[^:]*:\s*$"
#: Words of a window, and turns of a block.
WINDOW, BLOCK = 6, 256


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]", ""), r"[\x20\x09-\x0D]+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """messages with __lines, of (position, level, text), body, and __passages, of (level, lines).

    A passage is a run of lines of one level; one's own text is cut at empty lines as well.
    """
    lines = F.transform(
        F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n"),
        lambda line, i: F.struct(i.alias("i"), F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", "")).alias("level"), F.regexp_replace(line, QUOTE, "").alias("line")),
    )
    own = messages.withColumn("__all", lines)
    says_who = lambda x: (x["level"] == 0) & x["line"].rlike(ATTRIBUTION) & (F.coalesce(F.get("__all", x["i"] + 1)["level"], F.lit(0)) > 0)
    own = own.withColumn("__lines", F.filter("__all", lambda x: ~says_who(x))).drop("__all")
    body = F.array_join(F.transform(F.filter("__lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    own = own.withColumn("body", F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""))
    # Where runs begin; a run ends before the next one.
    empty = lambda x: (x["level"] == 0) & (F.trim(x["line"]) == "")
    before = lambda k: F.get("__lines", k - 1)
    begins = F.filter(F.transform("__lines", lambda x, k: F.when((k == 0) | (x["level"] != before(k)["level"]) | (empty(before(k)) & (x["level"] == 0)), k)), lambda k: k.isNotNull())
    own = own.withColumn("__begins", begins)
    runs = F.transform("__begins", lambda k, n: F.slice("__lines", k + 1, F.coalesce(F.get("__begins", n + 1), F.size("__lines")) - k))
    passages = F.transform(runs, lambda run: F.struct(F.get(run, F.lit(0))["level"].alias("level"), F.filter(F.transform(run, lambda x: normalised(x["line"])), lambda x: x != "").alias("lines")))
    return own.withColumn("__passages", F.filter(passages, lambda x: F.size(x["lines"]) > 0)).drop("__begins")


def pieces(lines: Column) -> Column:
    """The whole, the lines and the windows of a passage, as distinct (h, letters)."""
    whole = F.array_join(lines, " ")
    words = F.split(whole, " ")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(1))), lambda k: F.array_join(F.slice(words, k, WINDOW), " "))
    texts = F.concat(F.array(whole), lines, F.when(F.size(words) >= WINDOW, windows).otherwise(F.array().cast("array<string>")))
    return F.transform(F.array_distinct(texts), lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("letters")))


def latest_authors(quotes: DataFrame, wrote: DataFrame) -> DataFrame:
    """quotes (conv_id, turn, h, any others) with origin, the latest turn before theirs in wrote (conv_id, turn, h)."""
    block = F.floor(F.col("turn") / BLOCK).alias("block")
    own = wrote.select("conv_id", "h", block, "turn").distinct().groupBy("conv_id", "h", "block").agg(F.collect_list("turn").alias("turns"))
    asked = quotes.select("conv_id", "h", block).distinct().withColumn("turns", F.array().cast("array<long>"))
    blocks = own.unionByName(asked).groupBy("conv_id", "h", "block").agg(F.flatten(F.collect_list("turns")).alias("turns"))
    order = Window.partitionBy("conv_id", "h").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.last(F.array_max("turns"), ignorenulls=True).over(order))
    found = quotes.withColumn("block", block).join(materialize(blocks, "chat-blocks"), ["conv_id", "h", "block"])
    return found.withColumn("origin", F.coalesce(F.array_max(F.filter("turns", lambda t: t < F.col("turn"))), F.col("before"))).drop("block", "turns", "before").where("origin is not null")


def link_quotes(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) with body, n_quoted and n_linked passages, reply_to and thread."""
    given = [c for c in messages.columns if c not in ("body", "n_quoted", "n_linked", "reply_to", "thread")]
    own = materialize(parse(messages.select(*given)), "chat-parsed")
    placed = own.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.posexplode("__passages").alias("p", "x"))
    quoted = placed.where("x.level > 0").select("conv_id", "turn", "p", "x.level", "x.lines").distinct()
    conversations = materialize(quoted.select("conv_id").distinct(), "chat-quoting")
    wrote = placed.where("x.level = 0").join(conversations, "conv_id", "left_semi").select("conv_id", "turn", F.explode(pieces(F.col("x.lines"))).alias("y")).select("conv_id", "turn", "y.h")
    asked = quoted.select("conv_id", "turn", "p", "level", F.explode(pieces(F.col("lines"))).alias("y")).select("conv_id", "turn", "p", "level", "y.*")
    votes = latest_authors(materialize(asked, "chat-quotes"), wrote).groupBy("conv_id", "turn", "p", "level", "origin").agg(F.sum("letters").alias("letters"))
    passages = votes.groupBy("conv_id", "turn", "p", "level").agg(F.max(F.struct("letters", "origin")).alias("x")).select("conv_id", "turn", "level", "x.*")
    origins = passages.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("letters").alias("letters"), F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("l"), F.col("letters").alias("c"), F.col("origin").alias("o")))
    parents = materialize(origins.groupBy("conv_id", "turn").agg(best["o"].alias("reply_to"), F.sum("n").alias("n_linked")), "chat-parents")

    # A message's thread is found by doubling the steps towards its start.
    roots = parents.select("conv_id", "turn", F.col("reply_to").alias("thread"))
    while True:
        above = roots.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("__up"))
        up = roots.join(above, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("__up", "thread").alias("thread"), F.col("__up").isNotNull().alias("__moved"))
        up = materialize(up, "chat-threads")
        roots = up.drop("__moved")
        if up.where("__moved").isEmpty():
            break
    links = materialize(parents.join(roots, ["conv_id", "turn"]), "chat-links")
    found = own.withColumn("n_quoted", F.size(F.filter("__passages", lambda x: x["level"] > 0)).cast("long")).join(links, ["conv_id", "turn"], "left")
    return found.withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)).cast("long"), "thread": F.coalesce("thread", "turn")}).drop("__lines", "__passages")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def chat_turns(messages: DataFrame) -> DataFrame:
    """Messages without quotes as chat turns; in the order of conv_id, thread, turn they are the conversations."""
    role = escaped(F.coalesce("role", F.lit("user")))
    chat = F.concat(F.lit("<|"), role, F.lit("|>\n"), escaped(F.col("body")), F.lit("\n<|end|>"))
    return link_quotes(messages).select("conv_id", "thread", "turn", "role", "reply_to", "n_quoted", "n_linked", chat.alias("chat"))
