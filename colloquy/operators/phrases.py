"""Phrase statistics: signatures, ask rituals, bounces, delivery modifiers, term zones, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.numbers import DAY_MS, headroom, rate
from ..functions.text import NUMBERED, PHRASE, all_stop, ends_dangling, is_machine_artifact, is_term, phrases, project_of, raw_terms, tokens, trim_white, words_of
from .exchanges import term_counts
from .metrics import personal, with_next


def word_frequency(replies: DataFrame, keys: list[str], text: str) -> DataFrame:
    """In how many replies each word occurs."""
    return replies.select(*keys, F.explode(F.array_distinct(tokens(F.col(text)))).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(replies: DataFrame, keys: list[str], text: str, limits: Thresholds = DEFAULT) -> DataFrame:
    """The words of the most replies, per record: first cut on each key's own counts, then ranked."""
    counts = word_frequency(replies, keys, text)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("df"), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= limits.vocabulary)


def term_frequency(answers: DataFrame, keys: list[str], text: str) -> DataFrame:
    each = answers.select(*keys, F.explode(F.array_distinct(raw_terms(F.col(text)))).alias("term")).where(is_term(F.col("term")))
    return each.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"))


def answers(exchanges: DataFrame) -> DataFrame:
    """Exchanges that were answered, with the answer as terms are counted in it: its opening and its end, which may overlap."""
    return exchanges.withColumn("answer", trim_white(F.concat_ws(" ", "said_head", "said"))).where("answer <> ''")


def openings(exchanges: DataFrame, home: str = "") -> DataFrame:
    """(record, hash, head, project): how the answer of an exchange began and in which project it was, each as its newest copy with any tells.

    exchanges: of all files, mtime, session, idx, said_head, said, and perhaps cwd. Copies merge before the shuffle.
    """
    newest = F.struct(F.col("mtime"), F.col("idx"), F.col("session"))
    project = project_of(F.nullif("cwd", F.lit("")), home) if "cwd" in exchanges.columns else F.lit(None).cast("string")
    told = answers(exchanges).select("record", "hash", newest.alias("at"), F.nullif("said_head", F.lit("")).alias("head"), project.alias("project"))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return told.groupBy("record", "hash").agg(latest("head"), latest("project"))


def rare_terms(frequencies: DataFrame, answers: int | Column, limits: Thresholds = DEFAULT) -> DataFrame:
    """Terms of the band between background and accident."""
    n = answers if isinstance(answers, Column) else F.lit(answers)
    ceiling = F.greatest(F.lit(limits.rare_ceiling_min), F.floor(n * limits.rare_fraction))
    return frequencies.where((F.col("df") >= limits.rare_min) & (F.col("df") <= ceiling))


def _candidates(labelled: DataFrame) -> DataFrame:
    return labelled.withColumn("phrase", F.explode(phrases(F.col("reply"))))


def signatures(labelled: DataFrame, categories: DataFrame, limits: Thresholds = DEFAULT, top: int = 2, most: int = 10, machine: tuple[str, str] | None = None) -> DataFrame:
    """The phrases that open a category's replies far more often than others, each owned by one category.

    labelled: record, session, reply, kinds. categories: record, name, seq, perhaps scope; categories of the
    project own nothing. machine: names of host and user, whose phrases are no habit of the person.
    """
    categories = personal(categories)
    totals = labelled.groupBy("record").agg(F.count(F.lit(1)).alias("total"))
    each = _candidates(labelled)
    corpus = each.groupBy("record", "phrase").agg(F.count(F.lit(1)).alias("corpus"))
    members = labelled.select("record", F.explode(F.array_distinct("kinds")).alias("name")).groupBy("record", "name").agg(F.count(F.lit(1)).alias("members"))
    found = each.withColumn("name", F.explode(F.array_distinct("kinds"))).groupBy("record", "name", "phrase").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("sessions"))
    found = found.join(corpus, ["record", "phrase"]).join(members, ["record", "name"]).join(totals, "record").join(categories, ["record", "name"])
    found = found.withColumn("lift", (F.col("n") / F.col("members")) / (F.col("corpus") / F.col("total")))
    enough = (F.col("n") >= limits.signature_count) & (F.col("sessions") >= limits.signature_sessions) & (F.col("lift") >= limits.signature_lift)
    found = found.where(enough & ~all_stop(F.col("phrase")) & ~ends_dangling(F.col("phrase")))
    if machine:
        found = found.where(~is_machine_artifact(F.col("phrase"), *machine))
    found = without_extensions(found, ["record", "name"])
    owner = F.row_number().over(Window.partitionBy("record", "phrase").orderBy(F.desc("lift"), "seq"))
    found = found.withColumn("owner", owner).where("owner = 1").drop("owner")
    first = F.row_number().over(Window.partitionBy("record", "name").orderBy((F.col("phrase") != NUMBERED), F.desc("lift"), "phrase"))
    found = found.withColumn("place", first).where(F.col("place") <= top)
    largest = F.dense_rank().over(Window.partitionBy("record").orderBy(F.desc("members"), "seq"))
    return found.withColumn("entry", largest).where(F.col("entry") <= most)


def without_extensions(found: DataFrame, keys: list[str]) -> DataFrame:
    """Without phrases of which a shorter one, of those found, is the beginning.

    A phrase has few prefixes, so they are looked up rather than all pairs compared: a phrase and those that
    it begins meet by it, and found, which may be costly, is computed once.
    """
    words = F.split("phrase", " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), " "))
    each = found.withColumn("__prefix", F.explode(F.when(F.col("phrase") == NUMBERED, F.array("phrase")).otherwise(prefixes)))
    itself = F.col("__prefix") == F.col("phrase")
    begun = F.max(itself & (F.col("phrase") != NUMBERED)).over(Window.partitionBy(*keys, "__prefix"))
    return each.withColumn("__longer", begun & ~itself).groupBy(*found.columns).agg(F.bool_or("__longer").alias("__longer")).where("not __longer").drop("__longer")


def is_explanation(said_len: Column, calls: Column, limits: Thresholds = DEFAULT) -> Column:
    return (F.coalesce(said_len, F.lit(0)) >= limits.explanation_min) & (F.coalesce(calls, F.lit(0)) <= 1)


def ask_rituals(labelled: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Phrases after which the next answer is an explanation far more often than usual.

    labelled: record, session, key, ms, reply, said_len, calls.
    """
    pairs = with_next(labelled, ["said_len", "calls"]).where("has_next")
    pairs = pairs.withColumn("expl", is_explanation(F.col("next_said_len"), F.col("next_calls"), limits))
    base = pairs.groupBy("record").agg((F.count_if("expl") / F.count(F.lit(1))).alias("base")).where("base > 0 and base < 1")
    found = _candidates(pairs).groupBy("record", "phrase").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("expl").alias("explained"), F.countDistinct("session").alias("sessions"))
    found = found.join(base, "record").withColumn("p", F.col("explained") / F.col("pairs"))
    enough = (F.col("pairs") >= limits.ritual_pairs) & (F.col("sessions") >= limits.ritual_sessions) & (F.col("p") >= limits.ritual_p)
    return found.where(enough & (headroom(F.col("p"), F.col("base")) >= limits.ritual_headroom))


def mark_asks(labelled: DataFrame, rituals: DataFrame) -> DataFrame:
    """labelled with is_ask: one of the reply's phrases is a ritual."""
    asks = _candidates(labelled.select("record", "key", "reply")).join(rituals.select("record", "phrase"), ["record", "phrase"], "left_semi")
    return labelled.join(asks.select("record", "key", F.lit(True).alias("__ask")).distinct(), ["record", "key"], "left").withColumn("is_ask", F.coalesce("__ask", F.lit(False))).drop("__ask")


def ask_events(labelled: DataFrame, rituals: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Asks with the key of their answer, and whether they bounced: an explanation that was asked about again."""
    own = with_next(mark_asks(labelled, rituals), ["key", "said_len", "calls", "is_ask"])
    bounced = F.col("has_next") & is_explanation(F.col("next_said_len"), F.col("next_calls"), limits) & F.col("next_is_ask")
    return own.where("is_ask and ms is not null").select("record", "session", "key", "ms", F.col("next_key").alias("answer_key"), bounced.alias("bounced"))


def term_zones(labelled: DataFrame, events: DataFrame, rituals: DataFrame, rare: DataFrame, strong_min: int = 3, strong_sessions: int = 2, delegated_sessions: int = 3) -> DataFrame:
    """Rare terms that the person uses themself (strong), or leaves to the assistant (delegated).

    labelled has ai_terms; rare: record, term.
    """
    marked = mark_asks(labelled, rituals)
    said = marked.select("record", "session", "key", F.explode(F.array_distinct("ai_terms")).alias("term")).join(rare, ["record", "term"], "left_semi")
    keys = events.select("record", F.explode(F.array_compact(F.array("key", "answer_key"))).alias("key")).distinct()
    asked = said.join(keys, ["record", "key"], "left_semi").select("record", "term", F.lit(True).alias("asked")).distinct()
    used = marked.where("not is_ask").select("record", "session", "key", F.explode(F.array_distinct(raw_terms(F.col("reply")))).alias("term")).where(is_term(F.col("term")))
    used = used.join(rare, ["record", "term"], "left_semi").groupBy("record", "term").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("session").alias("use_sessions"))
    spread = said.groupBy("record", "term").agg(F.countDistinct("session").alias("ai_sessions"))
    out = rare.select("record", "term").join(used, ["record", "term"], "left").join(spread, ["record", "term"], "left").join(asked, ["record", "term"], "left")
    strong = (F.col("uses") >= strong_min) & (F.col("use_sessions") >= strong_sessions)
    delegated = F.col("uses").isNull() & F.col("asked").isNull() & (F.col("ai_sessions") >= delegated_sessions)
    return out.withColumn("zone", F.when(strong, "strong").when(delegated, "delegated")).where("zone is not null")


def asks_read(labelled: DataFrame, frequencies: DataFrame, answers: int, limits: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(rituals, events, zones) of a pile, or None if it can't be read honestly.

    It can't if no moment has terms of its answer, or if the walk over whole answers, which gave the
    frequencies of terms, found none: rare terms would then be judged on nothing.
    """
    if answers <= 0 or labelled.where(F.size("ai_terms") > 0).isEmpty():
        return None
    found = ask_rituals(labelled, limits)
    events = ask_events(labelled, found, limits)
    rare = rare_terms(frequencies, answers, limits).select("record", "term")
    return found, events, term_zones(labelled, events, found, rare)


def _rows_within(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """(record, lo, hi, sample): how many of rows (record, ms) lie in each window. The bounds are looked up in
    running sums: of each day's rows, and of the days before."""
    day = F.floor(F.col("at") / DAY_MS).alias("day")
    counted = rows.groupBy("record", F.col("ms").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    # A window begins before the rows of its first moment and ends after those of its last.
    bounds = windows.select("record", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(0).alias("side")), F.struct(F.col("hi").alias("at"), F.lit(2).alias("side")))).alias("b"))
    bounds = bounds.where("b.at is not null").select("record", "b.*").distinct().withColumn("n", F.lit(0).cast("long"))
    each = counted.withColumn("side", F.lit(1)).unionByName(bounds).withColumn("day", day)
    days = each.groupBy("record", "day").agg(F.sum("n").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("record").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    so_far = F.sum("n").over(Window.partitionBy("record", "day").orderBy("at", "side"))
    found = each.withColumn("__n", so_far).where("side <> 1").join(days.select("record", "day", earlier.alias("__earlier")), ["record", "day"])
    found = found.select("record", "at", "side", (F.col("__n") + F.col("__earlier")).alias("upto"))
    low, high = (found.where(F.col("side") == side).select("record", F.col("at").alias(c), F.col("upto").alias(f"__{c}")) for c, side in (("lo", 0), ("hi", 2)))
    out = windows.select("record", "lo", "hi").distinct().join(low, ["record", "lo"]).join(high, ["record", "hi"])
    return out.select("record", "lo", "hi", F.greatest(F.col("__hi") - F.col("__lo"), F.lit(0)).alias("sample"))


def _read_over(labelled: DataFrame, rituals: DataFrame, windows: DataFrame, samples: DataFrame) -> DataFrame:
    """Per window (record, id, terms, lo, hi): ask_rate, engage_rate, sessions, sample.

    A row meets the windows whose terms it names, by the term. samples: by record, or by record, lo and hi, how many
    rows a window holds; those that only lie in it count there.
    """
    bounds = [c for c in samples.columns if c != "sample"]
    place = F.row_number().over(Window.partitionBy("record", "session").orderBy("ms", "key"))
    marked = with_next(mark_asks(labelled, rituals), ["ai_terms"]).withColumn("place", place).where("ms is not null")
    own = F.transform(term_counts(F.col("reply"), DEFAULT.terms_cap), lambda x: x["term"])
    context = F.concat(F.coalesce("ai_terms", F.array().cast("array<string>")), F.coalesce(F.when(F.col("is_ask"), F.col("next_ai_terms")), F.array().cast("array<string>")))
    engaged = F.when(~F.col("is_ask"), own).otherwise(F.array().cast("array<string>"))
    tagged = lambda terms, of_answers: F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("term"), F.lit(of_answers).alias("context")))
    named = marked.select("record", "session", "place", "ms", "is_ask", F.explode(F.concat(tagged(context, True), tagged(engaged, False))).alias("x")).select("*", "x.*").drop("x")
    wanted = windows.select("record", "id", "lo", "hi", F.explode(F.array_distinct("terms")).alias("term"))
    met = named.join(wanted, ["record", "term"]).where(F.col("ms").between(F.col("lo"), F.col("hi")))
    met = met.groupBy("record", "id", "session", "place").agg((F.bool_or("context") & F.bool_or("is_ask")).alias("ask"), F.bool_or(~F.col("context")).alias("engaged"))
    reads = met.groupBy("record", "id", "session").agg(F.count_if("ask").alias("asks"), F.count_if("engaged").alias("engaged"))
    reads = reads.groupBy("record", "id").agg(F.sum("asks").alias("asks"), F.sum("engaged").alias("engaged"), F.count(F.lit(1)).alias("sessions"))
    out = windows.select("record", "id", "lo", "hi").join(reads, ["record", "id"], "left").join(samples, bounds, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("asks", "engaged", "sessions", "sample")})
    return out.select("record", "id", rate(F.col("asks"), F.col("sample")).alias("ask_rate"), rate(F.col("engaged"), F.col("sample")).alias("engage_rate"), "sessions", "sample")


def ask_window_reads(labelled: DataFrame, rituals: DataFrame, patches: DataFrame, now_ms: Column, limits: Thresholds = DEFAULT) -> DataFrame:
    """Over the last days, how often asks name a patch's terms, and how often the person uses them otherwise. patches: record, id, terms.

    All patches have one window, so its rows are counted by record, without the patches.
    """
    lo, hi = now_ms - limits.recent_days * DAY_MS, now_ms
    samples = labelled.where(F.col("ms").between(lo, hi)).groupBy("record").agg(F.count(F.lit(1)).alias("sample"))
    return _read_over(labelled, rituals, patches.select("record", "id", "terms", lo.alias("lo"), hi.alias("hi")), samples)


def ask_span_reads(labelled: DataFrame, rituals: DataFrame, patches: DataFrame, asks: DataFrame) -> DataFrame:
    """The same over each patch's own span, from the first to the last of its asks. patches: record, id, terms. asks: record, id, key."""
    own = asks.select("record", "id", "key").distinct()
    spans = own.join(labelled.select("record", "key", "ms").where("ms is not null").distinct(), ["record", "key"]).groupBy("record", "id").agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    windows = patches.select("record", "id", "terms").join(spans, ["record", "id"], "left")
    return _read_over(labelled, rituals, windows, _rows_within(labelled.where("ms is not null").select("record", "ms"), windows))


def meta_evidence(events: DataFrame, modifiers: DataFrame) -> DataFrame:
    """Per record: asks, their conversations, bounces, and the person's own modifiers in order."""
    counts = events.groupBy("record").agg(F.count(F.lit(1)).alias("asks"), F.countDistinct("session").alias("sessions"), F.count_if("bounced").alias("bounces"))
    listed = modifiers.groupBy("record").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda x: x["phrase"]).alias("modifiers"))
    return counts.join(listed, "record", "left").withColumn("modifiers", F.coalesce("modifiers", F.array().cast("array<string>")))


def delivery_modifiers(labelled: DataFrame, rituals: DataFrame, limits: Thresholds = DEFAULT, machine: tuple[str, str] | None = None) -> DataFrame:
    """Two and three words after the opening of asks that hardly occur elsewhere, at most three."""
    words = words_of(F.col("reply"), PHRASE)
    marked = mark_asks(labelled, rituals).withColumn("w", words)
    openings = rituals.groupBy("record").agg(F.collect_set("phrase").alias("rituals"))
    marked = marked.join(openings, "record")
    fits = F.filter("rituals", lambda r: (F.size(F.split(r, " ")) < F.size("w")) & (F.array_join(F.slice("w", 1, F.size(F.split(r, " "))), " ") == r))
    start = F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(fits, lambda r: F.size(F.split(r, " ")))), F.lit(1)))
    marked = marked.withColumn("start", F.when(F.col("is_ask"), start).otherwise(0))

    def grams(n: int) -> Column:
        last = F.size("w") - n
        return F.when(last >= F.col("start"), F.transform(F.sequence(F.col("start"), last), lambda i: F.array_join(F.slice("w", i + 1, n), " "))).otherwise(F.array().cast("array<string>"))

    each = marked.select("record", "session", "is_ask", F.explode(F.array_distinct(F.concat(grams(2), grams(3)))).alias("phrase"))
    # Sessions count for asks alone, so the others, most of the text, merge by phrase before they are shuffled.
    asked = each.where("is_ask").groupBy("record", "phrase").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("sessions"))
    asked = asked.where((F.col("n") >= limits.delivery_min) & (F.col("sessions") >= limits.delivery_sessions) & ~all_stop(F.col("phrase")))
    elsewhere = each.where(~F.col("is_ask")).groupBy("record", "phrase").agg(F.count(F.lit(1)).alias("elsewhere"))
    counts = asked.join(elsewhere, ["record", "phrase"], "left").withColumn("elsewhere", F.coalesce("elsewhere", F.lit(0)))
    kept = counts.where(F.col("n") / F.nullif(F.col("n") + F.col("elsewhere"), F.lit(0)) >= limits.delivery_share).join(openings, "record")
    known = F.flatten(F.transform("rituals", lambda r: F.split(r, " ")))
    fragment = F.forall(F.split("phrase", " "), lambda w: F.array_contains(known, w) | all_stop(w))
    kept = kept.where(~F.array_contains("rituals", F.col("phrase")) & ~fragment).drop("rituals")
    if machine:
        kept = kept.where(~is_machine_artifact(F.col("phrase"), *machine))
    # A phrase goes if one before it lies within it. A phrase of three words has few parts, which are looked up.
    rank = Window.partitionBy("record").orderBy(F.desc("n"), "phrase")
    kept = kept.withColumn("rank", F.row_number().over(rank))
    length = F.length("phrase")
    from_each = F.transform(F.sequence(F.lit(1), length), lambda i: F.transform(F.sequence(F.lit(1), length - i + 1), lambda n: F.substr("phrase", i, n)))
    parts = F.array_distinct(F.filter(F.flatten(from_each), lambda x: F.contains(x, F.lit(" "))))
    each = kept.withColumn("part", F.explode(parts))
    part_rank = F.min(F.when(F.col("part") == F.col("phrase"), F.col("rank"))).over(Window.partitionBy("record", "part"))
    covered = F.coalesce(part_rank < F.col("rank"), F.lit(False))
    out = each.withColumn("covered", covered).groupBy(*kept.columns).agg(F.bool_or("covered").alias("covered")).where("not covered").drop("covered")
    return out.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= limits.delivery_top)


def chain_occurrences(chains: DataFrame, low: int = 3, high: int = 5) -> DataFrame:
    """(record, session, chain) of every chain of so many actions. chains: record, session, pos, action; repeats in a row count once."""
    order = Window.partitionBy("record", "session").orderBy("pos")
    own = chains.withColumn("__before", F.lag("action").over(order)).where(~F.col("__before").eqNullSafe(F.col("action")))
    own = own.withColumns({f"__{k}": F.lead("action", k).over(order) for k in range(1, high)})
    steps = ["action", *[f"__{k}" for k in range(1, high)]]
    chains_at = F.array(*[F.when(F.col(steps[n - 1]).isNotNull(), F.concat_ws(" → ", *steps[:n])) for n in range(low, high + 1)])
    return own.select("record", "session", F.explode(F.array_compact(chains_at)).alias("chain"))


def chain_grams(chains: DataFrame, low: int = 3, high: int = 5, limits: Thresholds = DEFAULT) -> DataFrame:
    """Chains of actions that recur."""
    each = chain_occurrences(chains, low, high)
    out = each.groupBy("record", "chain").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("sessions"))
    return out.where((F.col("n") >= limits.chain_count) & (F.col("sessions") >= limits.chain_sessions))
