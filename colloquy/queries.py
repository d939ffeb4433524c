"""The registered queries over the given tables, each with its DuckDB equivalent where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions import numbers, text
from .operators import exchanges, metrics, miners, mirror, phrases, state, vectors
from .sources.tables import conversation_turns, event_moments, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FUNCTION_WORDS = ", ".join(f"'{w}'" for w in text.FUNCTION_WORDS)
STOPS = ", ".join(f"'{w}'" for w in sorted({*text.MINER_STOPS, *text.FILLERS}))
OPENING_STOPS = ", ".join(f"'{w}'" for w in text.OPENING_STOPS)
DANGLING = ", ".join(f"'{w}'" for w in text.DANGLING)

#: Stands for the openings of approvals.
OPENING = "^[a-z]"

# Parts that several oracles share.
PAIRS = r"""
turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, (role = 'user' AND length(coalesce(text, '')) > 0)::INT AS closes FROM conversations
), grouped AS (
  SELECT *, sum(closes) OVER (PARTITION BY conv_id ORDER BY turn) - closes AS pair FROM turns
), paired AS (
  SELECT conv_id, pair, max(text) FILTER (closes = 1) AS raw,
    trim(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant' AND text <> ''), ''), E' \t\n\r') AS said_full
  FROM grouped GROUP BY conv_id, pair HAVING max(closes) = 1
), exchanged AS (
  SELECT conv_id, row_number() OVER o - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS of_session, lead(1) OVER o IS NULL AS last_of_session,
    coalesce(lag(raw) OVER o, '') AS raw_prompt, raw, said_full,
    substr(coalesce(lag(raw) OVER o, ''), 1, 8000) AS prompt, right(said_full, 8000) AS said, substr(raw, 1, 8000) AS reaction
  FROM paired WINDOW o AS (PARTITION BY conv_id ORDER BY pair)
), hashed AS (
  SELECT *, substr(sha256(prompt || chr(0) || said || chr(0) || reaction), 1, 16) AS hash FROM exchanged
)"""
PHRASES = r"""
normal AS (
  SELECT *, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(reply), '[^a-z0-9\s'']', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM labelled
), candidates AS (
  SELECT * EXCLUDE (w), unnest(list_distinct(list_filter([
    CASE WHEN regexp_matches(reply, '^\s*\d+[.)]') THEN 'a numbered reply (1. … 2. …)' END,
    CASE WHEN len(w) >= 2 THEN array_to_string(w[1:2], ' ') END, CASE WHEN len(w) >= 3 THEN array_to_string(w[1:3], ' ') END,
    CASE WHEN len(w) >= 4 THEN array_to_string(w[1:4], ' ') END, CASE WHEN len(w) BETWEEN 1 AND 5 THEN array_to_string(w, ' ') END
  ], lambda x: x IS NOT NULL))) AS phrase FROM normal
)"""
EVENTS = r"""
moments AS (
  SELECT user_id::VARCHAR AS session, event_id AS key, epoch_us(ts) // 1000 AS ms, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS neg,
    event_type AS kind, 'k' || ((props->>'$.k')::BIGINT % 10)::VARCHAR AS tool, (props->>'$.k')::BIGINT AS k, value
  FROM events
)"""


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return keep


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges of the conversations table."""
    return exchanges.pair_exchanges(conversation_turns(table(spark, sf_dir, "conversations"))).withColumn("conv_id", F.col("session").cast("long"))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_moments(table(spark, sf_dir, "events"))


def kinds(labelled: DataFrame) -> DataFrame:
    """The categories of labelled moments, in the order of their names."""
    names = labelled.select("record", F.explode("kinds").alias("name")).distinct()
    return names.withColumn("seq", F.row_number().over(Window.partitionBy("record").orderBy("name")))


def chat_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges labelled by a bucket of their conversation."""
    own = chats(spark, sf_dir).withColumn("kinds", F.array(F.concat(F.lit("b"), (F.col("conv_id") % 8).cast("string"))))
    return own.select("record", "session", "conv_id", F.col("idx").cast("long").alias("ms"), F.col("hash").alias("key"), F.col("reaction").alias("reply"), "said_len", F.size("tools").alias("calls"), "kinds", "said_full")


# --- exchanges -------------------------------------------------------------------------------------


@register("turns_typed_filter", r"""
SELECT conv_id, turn, length(text) > 2000 AS pasted, len(string_split_regex(trim(text, E' \t\n\r'), '\s+'))::INT AS n_words,
  len(string_split_regex(trim(text, E' \t\n\r'), '\s+')) <= 4 AS terse, regexp_matches(trim(text, E' \t\n\r'), '\?$') AS question
FROM conversations WHERE role = 'user' AND length(text) > 0""")  # fmt: skip
def turns_typed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").where(exchanges.is_typed(F.col("role"), F.lit(False), F.col("text")))
    n = text.word_count(F.col("text"))
    return own.select("conv_id", "turn", (F.length("text") > 2000).alias("pasted"), n.alias("n_words"), (n <= 4).alias("terse"), text.is_question(F.col("text")).alias("question"))


@register("exchange_pairs", f"WITH {PAIRS} SELECT conv_id, idx, prompt, said, reaction, hash FROM hashed")
def exchange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select("conv_id", F.col("idx").cast("long").alias("idx"), "prompt", "said", "reaction", "hash")


@register("exchange_position", f"""WITH {PAIRS} SELECT conv_id, idx, of_session, last_of_session, length(raw_prompt) AS ask_len, length(said_full) AS said_len, length(raw) AS reply_len,
  length(prompt) > 2000 OR length(reaction) > 2000 AS pasted FROM hashed""")  # fmt: skip
def exchange_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chats(spark, sf_dir)
    return own.select("conv_id", *[F.col(c).cast("long").alias(c) for c in ("idx", "of_session")], "last_of_session", *[F.col(c).cast("long").alias(c) for c in ("ask_len", "said_len", "reply_len")], "pasted")


@register("moments_projection", f"""WITH {PAIRS} SELECT conv_id::VARCHAR AS session, hash AS key, 'ordinary' AS pile, substr(reaction, 1, 800) AS reply, length(raw) AS reply_len,
  substr(said, 1, 300) AS ai_head, right(said, 300) AS ai_tail, length(said_full) AS said_len, 0::BIGINT AS calls FROM hashed""")  # fmt: skip
def moments_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = exchanges.to_moments(chats(spark, sf_dir))
    return own.select("session", "key", "pile", "reply", F.col("reply_len").cast("long").alias("reply_len"), "ai_head", "ai_tail", F.col("said_len").cast("long").alias("said_len"), F.col("calls").cast("long").alias("calls"))


@register("exchange_dedup", f"""WITH {PAIRS}, copied AS (
  SELECT conv_id, idx, hash, 1 AS mtime FROM hashed UNION ALL SELECT conv_id, idx, hash, 2 FROM hashed WHERE conv_id % 2 = 0
) SELECT conv_id, idx, hash, mtime::INT AS mtime FROM copied QUALIFY row_number() OVER (PARTITION BY hash ORDER BY mtime DESC, idx DESC, conv_id::VARCHAR) = 1""")  # fmt: skip
def exchange_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive that holds half of the conversations a second time, in a newer file."""
    own = chats(spark, sf_dir).select("record", "session", "conv_id", F.col("idx").cast("long").alias("idx"), "hash")
    both = own.withColumn("mtime", F.lit(1)).unionByName(own.where("conv_id % 2 = 0").withColumn("mtime", F.lit(2)))
    return exchanges.newest_per_hash(both).select("conv_id", "idx", "hash", "mtime")


@register("answer_openings", f"""WITH {PAIRS}, copied AS (
  SELECT conv_id, idx, hash, said_full, 1 AS mtime FROM hashed UNION ALL SELECT conv_id, idx, hash, said_full, 2 FROM hashed WHERE conv_id % 2 = 0
) SELECT hash, substr(said_full, 1, 800) AS head FROM copied WHERE said_full <> ''
  QUALIFY row_number() OVER (PARTITION BY hash ORDER BY mtime DESC, idx DESC, conv_id::VARCHAR DESC) = 1""")  # fmt: skip
def answer_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each distinct answer began, over the archive of exchange_dedup."""
    own = chats(spark, sf_dir).select("record", "session", "conv_id", "idx", "hash", "said", "said_head")
    both = own.withColumn("mtime", F.lit(1)).unionByName(own.where("conv_id % 2 = 0").withColumn("mtime", F.lit(2)))
    return phrases.openings(both).select("hash", "head")


@register("incremental_ingest", f"""WITH {PAIRS} SELECT conv_id, idx, hash FROM hashed WHERE hash NOT IN (SELECT hash FROM hashed WHERE conv_id % 3 = 0)""")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is new when a third of the conversations is stored already."""
    own = chats(spark, sf_dir).select("record", "conv_id", F.col("idx").cast("long").alias("idx"), "hash")
    return exchanges.new_rows(own, own.where("conv_id % 3 = 0"), ["record", "hash"]).select("conv_id", "idx", "hash")


@register("gap_and_first_of_day", f"""WITH {EVENTS}, ordered AS (
  SELECT *, lag(ms) OVER (PARTITION BY session ORDER BY ms, key) AS before, (ts - INTERVAL 4 HOUR)::DATE AS day FROM moments
) SELECT key, CASE WHEN ms >= before THEN floor((ms - before) / 1000.0 + 0.5)::DOUBLE END AS gap_sec, row_number() OVER (PARTITION BY day ORDER BY ms, key) = 1 AS first_of_day FROM ordered""")  # fmt: skip
def gap_and_first_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = moments(spark, sf_dir)
    order = Window.partitionBy("record", "session").orderBy("ms", "key")
    own = own.withColumn("gap_sec", exchanges.gap_seconds(F.col("ms"), F.lag("ms").over(order)))
    return exchanges.mark_first_of_day(own, "at", ("ms", "key")).select("key", F.col("gap_sec").cast("double").alias("gap_sec"), "first_of_day")


# --- text ------------------------------------------------------------------------------------------


@register("terms_top24", rf"""WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '([a-zA-Z][a-zA-Z0-9_.-]{{2,}})', 1)) AS raw, generate_subscripts(regexp_extract_all(text, '([a-zA-Z][a-zA-Z0-9_.-]{{2,}})', 1), 1) - 1 AS pos FROM documents
), kept AS (SELECT doc_id, pos, regexp_replace(lower(raw), '[._-]+$', '') AS term FROM terms
), counted AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first_pos FROM kept WHERE length(term) BETWEEN 3 AND 40 AND term NOT IN ({FUNCTION_WORDS}) GROUP BY ALL)
SELECT doc_id, term, n, first_pos::INT AS first_pos, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos, term)::INT AS rank FROM counted
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos, term) <= 24""")  # fmt: skip
def terms_top24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchanges.top_terms(table(spark, sf_dir, "documents"), ["doc_id"], "text").select("doc_id", "term", "n", "first_pos", "rank")


@register("term_df_rare_band", rf"""WITH each AS (
  SELECT DISTINCT doc_id, regexp_replace(lower(raw), '[._-]+$', '') AS term FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([a-zA-Z][a-zA-Z0-9_.-]{{2,}})', 1)) AS raw FROM documents)
), counted AS (SELECT term, count(*) AS df FROM each WHERE length(term) BETWEEN 3 AND 40 AND term NOT IN ({FUNCTION_WORDS}) GROUP BY term)
SELECT term, df FROM counted WHERE df >= 3 AND df <= (SELECT greatest(20, floor(count(*) * 0.025)) FROM documents)""")  # fmt: skip
def term_df_rare_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("record", F.lit("docs"))
    return phrases.rare_terms(phrases.term_frequency(docs, [], "text"), docs.count())


@register("vocab_topn", r"""WITH counted AS (
  SELECT source, word, count(*) AS df FROM (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(lower(text), '([a-z][a-z0-9_.-]{1,})', 1)) AS word FROM documents) GROUP BY ALL)
SELECT source, word, df, row_number() OVER (PARTITION BY source ORDER BY df DESC, word)::INT AS rank FROM counted QUALIFY row_number() OVER (PARTITION BY source ORDER BY df DESC, word) <= 220""")  # fmt: skip
def vocab_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.vocabulary(table(spark, sf_dir, "documents"), ["source"], "text")


@register("phrases_signature", f"""WITH {PAIRS}, labelled AS (SELECT conv_id AS session, hash AS key, reaction AS reply, 'b' || (conv_id % 8)::VARCHAR AS name FROM hashed), {PHRASES},
totals AS (SELECT count(*)::DOUBLE AS total FROM labelled), members AS (SELECT name, count(*)::DOUBLE AS members FROM labelled GROUP BY name), corpus AS (SELECT phrase, count(*)::DOUBLE AS corpus FROM candidates GROUP BY phrase),
found AS (SELECT name, phrase, count(*) AS n, count(DISTINCT session) AS sessions FROM candidates GROUP BY ALL)
SELECT name, phrase, n, sessions, round(n / members / (corpus / total), 9) AS lift FROM found JOIN corpus USING (phrase) JOIN members USING (name), totals""")  # fmt: skip
def phrases_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate phrases of each category, with their lift over the corpus."""
    own = chat_labelled(spark, sf_dir).withColumn("name", F.get("kinds", F.lit(0)))
    each = own.withColumn("phrase", F.explode(text.phrases(F.col("reply"))))
    corpus, members = each.groupBy("phrase").agg(F.count(F.lit(1)).alias("corpus")), own.groupBy("name").agg(F.count(F.lit(1)).alias("members"))
    found = each.groupBy("name", "phrase").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("sessions"))
    found = found.join(corpus, "phrase").join(members, "name").withColumn("total", F.lit(own.count()))
    return found.select("name", "phrase", "n", "sessions", F.round((F.col("n") / F.col("members")) / (F.col("corpus") / F.col("total")), 9).alias("lift"))


@register("signature_owners", f"""WITH labelled AS (SELECT doc_id::VARCHAR AS session, source AS name, reply FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS reply FROM documents) WHERE trim(reply, E' \\t\\n\\r\\v\\f') <> ''), {PHRASES},
totals AS (SELECT count(*)::DOUBLE AS total FROM labelled), members AS (SELECT name, count(*)::DOUBLE AS members FROM labelled GROUP BY name), corpus AS (SELECT phrase, count(*)::DOUBLE AS corpus FROM candidates GROUP BY phrase), seqs AS (SELECT name, row_number() OVER (ORDER BY name) AS seq FROM members),
found AS (SELECT name, phrase, count(*) AS n, count(DISTINCT session) AS sessions FROM candidates GROUP BY ALL),
lifted AS (SELECT name, phrase, n, sessions, members, seq, (n / members) / (corpus / total) AS lift, string_split(phrase, ' ') AS w FROM found JOIN corpus USING (phrase) JOIN members USING (name) JOIN seqs USING (name), totals),
good AS (SELECT *, phrase LIKE 'a numbered reply (%' AS numbered FROM lifted WHERE n >= 3 AND sessions >= 3 AND lift >= 5 AND (phrase LIKE 'a numbered reply (%' OR len(list_filter(w, lambda x: x NOT IN ({OPENING_STOPS}))) > 0 AND w[-1] NOT IN ({DANGLING}))),
apart AS (SELECT * FROM good g WHERE numbered OR NOT EXISTS (SELECT 1 FROM good h WHERE h.name = g.name AND NOT h.numbered AND starts_with(g.phrase, h.phrase || ' '))),
owned AS (SELECT * FROM apart QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY lift DESC, seq) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY NOT numbered, lift DESC, phrase)::INT AS place FROM owned), cut AS (SELECT *, dense_rank() OVER (ORDER BY members DESC, seq) AS entry FROM placed WHERE place <= 2)
SELECT name, phrase, n, sessions, round(lift, 9) AS lift, place FROM cut WHERE entry <= 10""")  # fmt: skip
def signature_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decode key: opening phrases owned by one category each. Document lines stand for replies, sources for categories."""
    own = document_lines(spark, sf_dir).select("record", "session", F.col("line").alias("reply"), F.array("source").alias("kinds"))
    return phrases.signatures(own, kinds(own)).select("name", "phrase", "n", "sessions", F.round("lift", 9).alias("lift"), "place")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select(F.lit("docs").alias("record"), F.col("doc_id").cast("string").alias("session"), "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    return own.where(~text.is_blank(F.col("line")))


@register("repeat_messages", r"""SELECT text, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, text)::INT AS rank FROM (
  SELECT trim(line, E' \t\n\r\v\f') AS text FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE text <> '' GROUP BY text HAVING count(*) >= 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, text) <= 8""")  # fmt: skip
def repeat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror.repeated_texts(document_lines(spark, sf_dir), "line").select("text", "n", "rank")


@register("repeated_rules", rf"""WITH normal AS (
  SELECT doc_id, trim(regexp_replace(regexp_replace(lower(line), '[^a-z0-9 ''/.-]', ' ', 'g'), '\s+', ' ', 'g')) AS phrase FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
), kept AS (SELECT *, list_filter(string_split(phrase, ' '), lambda x: x <> '') AS w FROM normal)
SELECT phrase, count(*) AS n, count(DISTINCT doc_id) AS sessions FROM kept
WHERE len(w) BETWEEN 2 AND 12 AND len(list_filter(w, lambda x: x NOT IN ({STOPS}))) > 0 GROUP BY phrase HAVING count(*) >= 3 AND count(DISTINCT doc_id) >= 3""")  # fmt: skip
def repeated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = document_lines(spark, sf_dir).select("record", "session", F.col("line").alias("prompt"), F.lit(False).alias("pasted"))
    return miners.repeated_rules(own).select("phrase", "n", "sessions")


@register("approvals", f"""WITH {PAIRS}, normal AS (SELECT conv_id, idx, trim(regexp_replace(regexp_replace(lower(prompt), '[^a-z0-9 ''/.-]', ' ', 'g'), '\\s+', ' ', 'g')) AS p,
  trim(regexp_replace(regexp_replace(lower(lag(said) OVER (PARTITION BY conv_id ORDER BY idx)), '[^a-z0-9 ''/.-]', ' ', 'g'), '\\s+', ' ', 'g')) AS before FROM hashed)
SELECT conv_id, idx, substr(p, 1, 60) AS quote, substr(before, 1, 80) AS approved FROM normal WHERE p <> '' AND length(p) <= 60 AND regexp_matches(p, '{OPENING}')""")  # fmt: skip
def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short prompts with what was said before. The data have no English approvals: any opening word stands for one."""
    found = miners.approvals(chats(spark, sf_dir), OPENING)
    return found.select(F.col("session").cast("long").alias("conv_id"), F.col("idx").cast("long").alias("idx"), "quote", "approved")


@register("text_normalisers", r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS quote, trim(regexp_replace(regexp_replace(text, '[0-9]+', '', 'g'), '\s+', ' ', 'g')) AS no_digits,
  regexp_matches(text, '\pN') AS numeral, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 60) AS clipped FROM conversations""")  # fmt: skip
def text_normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normal_quote(c).alias("quote"), text.without_digits(c).alias("no_digits"), text.has_numeral(c).alias("numeral"), text.clip(c, 60).alias("clipped"))


@register("shape_text", r"""WITH vocab AS (
  SELECT list(word) AS words FROM (SELECT word, count(*) AS df FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '([a-z][a-z0-9_.-]{1,})', 1)) AS word FROM conversations) GROUP BY word ORDER BY df DESC, word LIMIT 220)
), shaped AS (SELECT conv_id, turn, text, trim(regexp_replace(array_to_string(list_transform(regexp_extract_all(text, '([a-zA-Z][a-zA-Z0-9_.-]+|[^a-zA-Z]+|.)', 1),
    lambda x: CASE WHEN regexp_matches(x, '^[a-zA-Z][a-zA-Z0-9_.-]+$') AND NOT list_contains(words, lower(x)) THEN '' ELSE x END), ''), '\s+', ' ', 'g')) AS s FROM conversations, vocab)
SELECT conv_id, turn, CASE WHEN s = '' THEN text ELSE s END AS shaped FROM shaped""")  # fmt: skip
def shape_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").withColumn("record", F.lit("chat"))
    words = phrases.vocabulary(own, ["record"], "text").groupBy("record").agg(F.collect_list("word").alias("words"))  # 220 words at most
    return own.join(F.broadcast(words), "record").select("conv_id", "turn", text.shape(F.col("text"), F.col("words")).alias("shaped"))


@register("strip_wrappers", r"""SELECT page_id, trim(regexp_replace(regexp_replace('<system-reminder>x</system-reminder>' || html, '(?s)<system-reminder>.*?</system-reminder>', ' ', 'g'), '</?[a-z-]+>', ' ', 'g'), E' \t\n\r\v\f') AS stripped FROM pages""")
def strip_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page markup stands for injected blocks: bare tags go, text stays."""
    return table(spark, sf_dir, "pages").select("page_id", text.strip_wrappers(F.concat(F.lit("<system-reminder>x</system-reminder>"), "html")).alias("stripped"))


# --- chains, asks ------------------------------------------------------------------------------------


@register("ngram_chains", f"""WITH {EVENTS}, lagged AS (SELECT session, ms, key, kind, lag(kind) OVER (PARTITION BY session ORDER BY ms, key) AS before FROM moments),
distinct_steps AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ms, key) AS i FROM lagged WHERE before IS DISTINCT FROM kind),
steps AS (SELECT session, kind, lead(kind, 1) OVER w AS k1, lead(kind, 2) OVER w AS k2, lead(kind, 3) OVER w AS k3, lead(kind, 4) OVER w AS k4 FROM distinct_steps WINDOW w AS (PARTITION BY session ORDER BY i)),
grams AS (SELECT session, kind || ' → ' || k1 || ' → ' || k2 AS chain FROM steps UNION ALL SELECT session, kind || ' → ' || k1 || ' → ' || k2 || ' → ' || k3 FROM steps
  UNION ALL SELECT session, kind || ' → ' || k1 || ' → ' || k2 || ' → ' || k3 || ' → ' || k4 FROM steps)
SELECT chain, count(*) AS n, count(DISTINCT session) AS sessions FROM grams WHERE chain IS NOT NULL GROUP BY chain HAVING count(*) >= 4 AND count(DISTINCT session) >= 3""")  # fmt: skip
def ngram_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = moments(spark, sf_dir).select("record", "session", F.struct("ms", "key").alias("pos"), F.col("event_type").alias("action"))
    return phrases.chain_grams(own).select("chain", "n", "sessions")


@register("ask_ritual_rates", f"""WITH {PAIRS}, labelled AS (SELECT conv_id AS session, idx, reaction AS reply, lead(length(said_full)) OVER (PARTITION BY conv_id ORDER BY idx) AS next_len FROM hashed), {PHRASES}
SELECT phrase, count(*) AS pairs, count(*) FILTER (next_len >= 800) AS explained, count(DISTINCT session) AS sessions FROM candidates WHERE next_len IS NOT NULL GROUP BY phrase HAVING count(*) >= 2""")  # fmt: skip
def ask_ritual_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each phrase is followed by an explanation."""
    pairs = metrics.with_next(chat_labelled(spark, sf_dir), ["said_len", "calls"]).where("has_next")
    pairs = pairs.withColumn("expl", phrases.is_explanation(F.col("next_said_len"), F.col("next_calls"))).withColumn("phrase", F.explode(text.phrases(F.col("reply"))))
    return pairs.groupBy("phrase").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("expl").alias("explained"), F.countDistinct("session").alias("sessions")).where("pairs >= 2")


# Openings of two words that a few exchanges share stand for rituals: the data's prose has none that pass the floors.
RITUALS = f"""{PHRASES}, rituals AS (SELECT phrase FROM candidates WHERE phrase LIKE '% %' AND phrase NOT LIKE '% % %' GROUP BY phrase HAVING count(*) >= 2)"""


def chat_rituals(own: DataFrame) -> DataFrame:
    each = own.select("record", F.explode(text.phrases(F.col("reply"))).alias("phrase")).where(F.size(F.split("phrase", " ")) == 2)
    return each.groupBy("record", "phrase").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@register("ask_events", f"""WITH {PAIRS}, labelled AS (SELECT conv_id AS session, idx, hash AS key, reaction AS reply, length(said_full) AS said_len FROM hashed), {RITUALS},
asks AS (SELECT DISTINCT key FROM candidates WHERE phrase IN (SELECT phrase FROM rituals)),
marked AS (SELECT session, idx, key, said_len, key IN (SELECT key FROM asks) AS is_ask FROM labelled),
nexts AS (SELECT *, lead(key) OVER w AS answer_key, lead(said_len) OVER w AS next_len, lead(is_ask) OVER w AS next_ask FROM marked WINDOW w AS (PARTITION BY session ORDER BY idx))
SELECT key, answer_key, coalesce(next_len >= 800 AND next_ask, false) AS bounced FROM nexts WHERE is_ask""")  # fmt: skip
def ask_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chat_labelled(spark, sf_dir)
    return phrases.ask_events(own, chat_rituals(own)).select("key", "answer_key", F.coalesce("bounced", F.lit(False)).alias("bounced"))


@register("ask_meta_evidence", f"""WITH {PAIRS}, labelled AS (SELECT conv_id AS session, idx, hash AS key, reaction AS reply, length(said_full) AS said_len FROM hashed), {RITUALS},
marked AS (SELECT session, idx, key, said_len, key IN (SELECT key FROM candidates WHERE phrase IN (SELECT phrase FROM rituals)) AS is_ask FROM labelled),
nexts AS (SELECT *, lead(said_len) OVER w AS next_len, lead(is_ask) OVER w AS next_ask FROM marked WINDOW w AS (PARTITION BY session ORDER BY idx))
SELECT count(*) AS asks, count(DISTINCT session) AS sessions, count(*) FILTER (next_len >= 800 AND next_ask) AS bounces FROM nexts WHERE is_ask""")  # fmt: skip
def ask_meta_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chat_labelled(spark, sf_dir)
    return phrases.ask_events(own, chat_rituals(own)).agg(F.count(F.lit(1)).alias("asks"), F.countDistinct("session").alias("sessions"), F.count_if("bounced").alias("bounces"))


@register("term_zones", rf"""WITH {PAIRS}, labelled AS (SELECT conv_id AS session, idx, hash AS key, reaction AS reply, said_full, length(said_full) AS said_len FROM hashed), {RITUALS},
marked AS (SELECT *, lead(key) OVER w AS next_key, key IN (SELECT key FROM candidates WHERE phrase IN (SELECT phrase FROM rituals)) AS is_ask FROM labelled WINDOW w AS (PARTITION BY session ORDER BY idx, key)),
said AS (SELECT DISTINCT session, key, idx, regexp_replace(lower(raw), '[._-]+$', '') AS term FROM (SELECT session, key, idx, unnest(regexp_extract_all(said_full, '([a-zA-Z][a-zA-Z0-9_.-]{{2,}})', 1)) AS raw FROM marked)),
kept AS (SELECT * FROM said WHERE length(term) BETWEEN 3 AND 40 AND term NOT IN ({FUNCTION_WORDS})),
rare AS (SELECT term FROM kept GROUP BY term HAVING count(*) BETWEEN 3 AND (SELECT greatest(20, floor(count(*) * 0.025)) FROM labelled WHERE said_full <> '')),
own AS (SELECT DISTINCT session, key, idx, regexp_replace(lower(raw), '[._-]+$', '') AS term FROM (SELECT session, key, idx, unnest(regexp_extract_all(reply, '([a-zA-Z][a-zA-Z0-9_.-]{{2,}})', 1)) AS raw FROM marked WHERE NOT is_ask)),
used AS (SELECT term, count(*) AS uses, count(DISTINCT session) AS use_sessions FROM own WHERE term IN (SELECT term FROM rare) GROUP BY term), spread AS (SELECT term, count(DISTINCT session) AS ai_sessions FROM kept GROUP BY term),
asked AS (SELECT DISTINCT term FROM kept WHERE key IN (SELECT key FROM marked WHERE is_ask UNION SELECT next_key FROM marked WHERE is_ask AND next_key IS NOT NULL)),
zones AS (SELECT term, uses, use_sessions, ai_sessions, CASE WHEN uses >= 3 AND use_sessions >= 2 THEN 'strong' WHEN uses IS NULL AND term NOT IN (SELECT term FROM asked) AND ai_sessions >= 3 THEN 'delegated' END AS zone FROM rare LEFT JOIN used USING (term) LEFT JOIN spread USING (term))
SELECT term, zone, uses, use_sessions, ai_sessions FROM zones WHERE zone IS NOT NULL""")  # fmt: skip
def term_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare terms by who uses them. Rare: in the band of the answers' own frequencies."""
    own = chat_labelled(spark, sf_dir).withColumn("ai_terms", F.filter(text.raw_terms(F.col("said_full")), lambda t: text.is_term(t)))
    frequencies = phrases.term_frequency(own.where("said_full <> ''"), ["record"], "said_full")
    rare = phrases.rare_terms(frequencies, own.where("said_full <> ''").count()).select("record", "term")
    rituals = chat_rituals(own)
    return phrases.term_zones(own, phrases.ask_events(own, rituals), rituals, rare).select("term", "zone", "uses", "use_sessions", "ai_sessions")


@register("delivery_modifiers", f"""WITH labelled AS (SELECT doc_id::VARCHAR AS session, line AS idx, doc_id::VARCHAR || '/' || line AS key, reply FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS reply, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents) WHERE trim(reply, E' \\t\\n\\r\\v\\f') <> ''), {PHRASES},
rituals AS (SELECT phrase FROM candidates WHERE phrase LIKE '% %' AND phrase NOT LIKE '% % %' GROUP BY phrase ORDER BY count(*) DESC, phrase LIMIT 3), known AS (SELECT list_distinct(flatten(list(string_split(phrase, ' ')))) AS words FROM rituals),
marked AS (SELECT session, w, key IN (SELECT key FROM candidates WHERE phrase IN (SELECT phrase FROM rituals)) AS is_ask,
  coalesce((SELECT max(2) FROM rituals r WHERE len(w) > 2 AND r.phrase = array_to_string(w[1:2], ' ')), 1) AS start FROM normal),
grams AS (SELECT session, is_ask, unnest(list_distinct(list_concat(list_transform(range(CASE WHEN is_ask THEN start ELSE 0 END, len(w) - 1), lambda i: array_to_string(w[i + 1:i + 2], ' ')), list_transform(range(CASE WHEN is_ask THEN start ELSE 0 END, len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' '))))) AS phrase FROM marked),
counted AS (SELECT phrase, count(*) FILTER (is_ask) AS n, count(*) FILTER (NOT is_ask) AS elsewhere, count(DISTINCT session) FILTER (is_ask) AS sessions, string_split(phrase, ' ') AS w FROM grams GROUP BY phrase),
kept AS (SELECT counted.*, row_number() OVER (ORDER BY n DESC, phrase) AS r FROM counted, known WHERE n >= 2 AND sessions >= 2 AND n / (n + elsewhere)::DOUBLE >= 0.5 AND len(list_filter(w, lambda x: x NOT IN ({OPENING_STOPS}))) > 0 AND phrase NOT IN (SELECT phrase FROM rituals)
  AND len(list_filter(w, lambda x: x NOT IN ({OPENING_STOPS}) AND NOT list_contains(words, x))) > 0),
out AS (SELECT * FROM kept k WHERE NOT EXISTS (SELECT 1 FROM kept e WHERE e.r < k.r AND contains(k.phrase, e.phrase)))
SELECT phrase, n, sessions, row_number() OVER (ORDER BY n DESC, phrase)::INT AS rank FROM out QUALIFY row_number() OVER (ORDER BY n DESC, phrase) <= 3""")  # fmt: skip
def delivery_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the three most frequent openings of two words of document lines, with floors that invented prose can reach."""
    own = document_lines(spark, sf_dir).select("record", "session", F.concat_ws("/", "session", "idx").alias("key"), F.col("line").alias("reply"))
    rituals = chat_rituals(own).orderBy(F.desc("n"), "phrase").limit(3)
    limits = replace(DEFAULT, delivery_min=2, delivery_sessions=2, delivery_share=0.5)
    return phrases.delivery_modifiers(own, rituals.select("record", "phrase"), limits).select("phrase", "n", "sessions", "rank")


# --- statistics --------------------------------------------------------------------------------------


@register("friction_rates", f"""WITH {EVENTS} SELECT session, count(*) FILTER (kind <> 'error') AS messages, count(*) FILTER (kind = 'error') AS corrections,
  CASE WHEN count(*) FILTER (kind <> 'error') = 0 THEN 0 ELSE 100 * count(*) FILTER (kind = 'error') / count(*) FILTER (kind <> 'error')::DOUBLE END AS per_hundred FROM moments GROUP BY session""")  # fmt: skip
def friction_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for records, errors for interruptions."""
    own = moments(spark, sf_dir)
    stop = F.col("event_type") == "error"
    turns = own.select(F.col("session").alias("record"), F.lit("user").alias("role"), F.when(stop, "").otherwise(F.col("event_type")).alias("text"), stop.alias("interrupted"), F.when(stop, "plain").alias("interrupt_kind"), F.lit(None).cast("string").alias("denial"))
    return mirror.friction(turns).select(F.col("record").alias("session"), "messages", "corrections", "per_hundred")


@register("mirror_read", r"""WITH turns AS (
  SELECT 'chat' AS record, NULL::TIMESTAMP AS seen, role, coalesce(text, '') AS text, false AS stop, NULL AS k FROM conversations
  UNION ALL SELECT 'events', ts, 'user', CASE WHEN event_type = 'error' THEN '' ELSE event_type || ' ' || value END, event_type = 'error', (props->>'$.k')::BIGINT FROM events
), records AS (SELECT record, count(*) FILTER (stop) AS corrections, count(k) AS tool_calls FROM turns GROUP BY record),
typed AS (SELECT *, (seen - INTERVAL 4 HOUR)::DATE AS day, len(string_split_regex(trim(text, E' \t\n\r'), '\s+')) AS words FROM turns WHERE role = 'user' AND NOT stop AND text <> ''),
whole AS (SELECT record, count(*) AS messages, epoch_us(min(seen)) // 1000 AS first_ms, epoch_us(max(seen)) // 1000 AS last_ms, round(avg((text LIKE '%?')::INT), 9) AS question_share, count(*) FILTER (length(text) > 2000) AS pastes,
  coalesce(floor((epoch_us(max(seen)) // 1000 - epoch_us(min(seen)) // 1000) / 86400000.0 + 0.5)::BIGINT + 1, 0) AS span_days FROM typed GROUP BY record),
trouble AS (SELECT record, count(DISTINCT (seen - INTERVAL 4 HOUR)::DATE) AS days_with_any FROM turns WHERE stop GROUP BY record),
ordered AS (SELECT record, list(words ORDER BY words) AS xs, round(avg((words <= 4)::INT), 9) AS terse_share FROM typed WHERE length(text) <= 2000 GROUP BY record),
per_day AS (SELECT record, day, count(*) AS n FROM typed WHERE day IS NOT NULL GROUP BY ALL), active AS (SELECT record, count(*) AS active_days, list(n ORDER BY n) AS ns FROM per_day GROUP BY record),
islands AS (SELECT record, day - (row_number() OVER (PARTITION BY record ORDER BY day))::INT AS island FROM per_day), runs AS (SELECT record, island, count(*) AS n FROM islands GROUP BY ALL), streaks AS (SELECT record, max(n) AS streak FROM runs GROUP BY record),
hours AS (SELECT record, hour(seen) AS hour, count(*) AS n FROM typed WHERE seen IS NOT NULL GROUP BY ALL), upto AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY record ORDER BY n DESC, hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, sum(n) OVER (PARTITION BY record) AS total FROM hours),
cover AS (SELECT record, count(*) FILTER (run < 0.8::DOUBLE * total) AS hours_80, count(*) FILTER (run < 0.9::DOUBLE * total) AS hours_90 FROM upto GROUP BY record)
SELECT record, messages, corrections, round(100 * corrections / messages::DOUBLE, 9) AS per_hundred, first_ms, last_ms, question_share, pastes, span_days, days_with_any, tool_calls,
  xs[least(len(xs) - 1, floor(len(xs) * 0.25))::INT + 1]::INT AS len_p25, xs[least(len(xs) - 1, floor(len(xs) * 0.5))::INT + 1]::INT AS len_median, xs[least(len(xs) - 1, floor(len(xs) * 0.75))::INT + 1]::INT AS len_p75, xs[least(len(xs) - 1, floor(len(xs) * 0.9::DOUBLE))::INT + 1]::INT AS len_p90,
  terse_share, active_days, ns[least(len(ns) - 1, floor(len(ns) * 0.5))::INT + 1] AS median_per_day, streak, hours_80, hours_90
FROM records JOIN whole USING (record) LEFT JOIN trouble USING (record) LEFT JOIN ordered USING (record) LEFT JOIN active USING (record) LEFT JOIN streaks USING (record) LEFT JOIN cover USING (record)""")  # fmt: skip
def mirror_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole descriptive read of the conversations and, as a second record, of the events. The tables have no folders, branches, images or refusals."""
    chat = conversation_turns(table(spark, sf_dir, "conversations")).drop("conv_id", "pos")
    none = F.lit(None)
    stop = F.col("event_type") == "error"
    log = moments(spark, sf_dir).select(
        "record", "session", F.col("at").cast("string").alias("ts"), F.lit("user").alias("role"), F.when(stop, "").otherwise(F.concat_ws(" ", "event_type", "value")).alias("text"), stop.alias("interrupted"),
        F.when(stop, "plain").alias("interrupt_kind"), none.cast("string").alias("denial"), none.cast("array<string>").alias("denied_tools"), "tools", none.cast("string").alias("cwd"), none.cast("string").alias("git_branch"), F.lit(0).alias("images"),
    )
    found = mirror.mirror(chat.unionByName(log))
    return found.select(
        "record", "messages", "corrections", *[F.round(c, 9).alias(c) for c in ("per_hundred", "question_share", "terse_share")], *[numbers.parsed_millis(F.col(f"{c}_ts")).alias(f"{c}_ms") for c in ("first", "last")],
        "pastes", "span_days", "days_with_any", "tool_calls", "len_p25", "len_median", "len_p75", "len_p90", "active_days", "median_per_day", "streak", "hours_80", "hours_90",
    )


@register("active_days_streak", f"""WITH {EVENTS}, days AS (SELECT DISTINCT session, (ts - INTERVAL 4 HOUR)::DATE AS day FROM moments WHERE neg = 0),
islands AS (SELECT *, day - (row_number() OVER (PARTITION BY session ORDER BY day))::INT AS island FROM days), runs AS (SELECT session, island, count(*) AS n FROM islands GROUP BY ALL)
SELECT session, sum(n)::BIGINT AS active_days, max(n) AS streak FROM runs GROUP BY session""")  # fmt: skip
def active_days_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = moments(spark, sf_dir).where("pile = 'ordinary'").select("session", numbers.working_day(F.col("at")).alias("day")).distinct()
    return days.groupBy("session").agg(F.count(F.lit(1)).alias("active_days")).join(metrics.longest_streak(days, ["session"]), "session")


@register("hours_to_cover", f"""WITH {EVENTS}, counted AS (SELECT session, hour(ts) AS hour, count(*) AS n FROM moments GROUP BY ALL),
runs AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY session ORDER BY n DESC, hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, sum(n) OVER (PARTITION BY session) AS total FROM counted)
SELECT session, count(*) FILTER (run < 0.8::DOUBLE * total) AS hours_80, count(*) FILTER (run < 0.9::DOUBLE * total) AS hours_90 FROM runs GROUP BY session""")  # fmt: skip
def hours_to_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = moments(spark, sf_dir).groupBy("session", F.hour("at").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.hours_to_cover(counted, ["session"])


@register("hour_histogram", f"""WITH {EVENTS} SELECT h::INT AS hour, count(key) AS n FROM range(24) r(h) LEFT JOIN moments ON hour(ts) = h GROUP BY h""")
def hour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = mirror.hourly(moments(spark, sf_dir).select("record", F.col("at").alias("ts")))
    return spark.range(24).select(F.col("id").cast("int").alias("hour")).join(counted, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


@register("quantile_floor_index", r"""WITH ordered AS (SELECT source, list(n_chars ORDER BY n_chars) AS xs FROM documents WHERE n_chars IS NOT NULL GROUP BY source)
SELECT source, len(xs) AS n, xs[least(len(xs) - 1, floor(len(xs) * 0.25))::INT + 1] AS p25, xs[least(len(xs) - 1, floor(len(xs) * 0.5))::INT + 1] AS median,
  xs[least(len(xs) - 1, floor(len(xs) * 0.75))::INT + 1] AS p75, xs[least(len(xs) - 1, floor(len(xs) * 0.9::DOUBLE))::INT + 1] AS p90 FROM ordered""")  # fmt: skip
def quantile_floor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror.counted_quantiles(table(spark, sf_dir, "documents"), ["source"], "n_chars", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9})


TALLY = f"""{EVENTS}, totals AS (SELECT count(*) FILTER (neg = 1)::DOUBLE AS neg_total, count(*) FILTER (neg = 0)::DOUBLE AS ord_total FROM labelled_moments),
stats AS (SELECT name, count(*) AS n, count(DISTINCT session) AS sessions, count(*) FILTER (neg = 1) AS neg, count(*) FILTER (neg = 0) AS ord, min(ms) AS first_ms, max(ms) AS last_ms FROM labelled_moments GROUP BY name),
tallied AS (SELECT *, CASE WHEN ord = 0 THEN CASE WHEN neg > 0 THEN 'Infinity'::DOUBLE ELSE 0 END ELSE (neg / neg_total) / (ord / ord_total) END AS lift FROM stats, totals)"""
BY_TOOL = TALLY.replace("totals AS (", "labelled_moments AS (SELECT *, tool AS name FROM moments), totals AS (", 1)
BY_KIND = TALLY.replace("totals AS (", "labelled_moments AS (SELECT *, kind AS name FROM moments), totals AS (", 1)


@register("category_tally_lift", f"WITH {BY_KIND} SELECT name, n, sessions, neg, ord, first_ms::DOUBLE AS first_ms, last_ms::DOUBLE AS last_ms, round(lift, 9) AS lift FROM tallied UNION ALL SELECT 'never', 0, 0, 0, 0, NULL, NULL, 0")
def category_tally_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = moments(spark, sf_dir)
    names = kinds(own).select("record", "name").unionByName(spark.createDataFrame([("events", "never")], "record string, name string"))
    return metrics.tally(own, names).select("name", "n", "sessions", "neg", "ord", F.col("first_ms").cast("double").alias("first_ms"), F.col("last_ms").cast("double").alias("last_ms"), F.round("lift", 9).alias("lift"))


def by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments whose category is the bucket of their number, so that every category has both piles."""
    return moments(spark, sf_dir).withColumn("kinds", F.col("tools"))


@register("scoreboard", f"WITH {BY_TOOL} SELECT count(*) AS moments, count(*) FILTER (name IN (SELECT name FROM tallied WHERE lift >= 1.0 AND sessions >= 3)) AS carrying, floor(count(*) FILTER (name IN (SELECT name FROM tallied WHERE lift >= 1.0 AND sessions >= 3)) * 100 / count(*)::DOUBLE * 10 + 0.5) / 10 AS per_hundred FROM labelled_moments")
def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a lift cut of one: buckets of random numbers don't reach two."""
    own = by_tool(spark, sf_dir)
    signals = metrics.tally(own, kinds(own).select("record", "name")).where("lift >= 1.0 and sessions >= 3")
    return metrics.scoreboard(own, signals).drop("record")


@register("misfit_rate", f"WITH {EVENTS} SELECT count(*) AS moments, count(*) FILTER (k >= 90) AS misfits, count(*) FILTER (k >= 90) / count(*)::DOUBLE AS rate FROM moments")
def misfit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = moments(spark, sf_dir).withColumn("kinds", F.when(F.col("k") < 90, F.col("kinds")).otherwise(F.array().cast("array<string>")))
    return metrics.misfit_rate(own).drop("record")


@register("burst_week", f"""WITH {EVENTS}, weeks AS (SELECT session AS name, floor(ms / 604800000.0) AS week, count(*) AS n FROM moments WHERE neg = 1 GROUP BY ALL)
SELECT name, sum(n)::BIGINT AS n, max(n) AS busiest, max(n) >= 0.5 * sum(n) AS burst FROM weeks GROUP BY name""")  # fmt: skip
def burst_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = moments(spark, sf_dir).where("pile <> 'ordinary'").withColumn("kinds", F.array("session"))
    return metrics.burst(own).drop("record")


@register("trend_direction", f"""WITH {EVENTS}, named AS (SELECT *, tool AS name FROM moments), span AS (SELECT name, count(*) AS n, min(ms) AS lo, max(ms) AS hi, min(ms) + (max(ms) - min(ms)) / 2.0::DOUBLE AS mid FROM named GROUP BY name HAVING count(*) >= 6 AND max(ms) > min(ms)),
own AS (SELECT name, count(*) FILTER (ms < mid) AS early, count(*) FILTER (ms >= mid) AS late FROM named JOIN span USING (name) GROUP BY name),
every AS (SELECT span.name, count(*) FILTER (ms < mid) AS early_all, count(*) FILTER (ms >= mid) AS late_all FROM moments JOIN span ON ms BETWEEN lo AND hi GROUP BY ALL)
SELECT name, early, late, early_all, late_all, CASE WHEN early / early_all::DOUBLE = 0 AND late > 0 OR late / late_all::DOUBLE >= early / early_all::DOUBLE * 1.3::DOUBLE THEN 'rising' WHEN late / late_all::DOUBLE <= early / early_all::DOUBLE * 0.7::DOUBLE THEN 'fading' END AS direction FROM own JOIN every USING (name)""")  # fmt: skip
def trend_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.trend(by_tool(spark, sf_dir)).select("name", "early", "late", "early_all", "late_all", "direction")


@register("adjacency_action", f"""WITH {EVENTS}, nexts AS (SELECT *, lead(tool) OVER (PARTITION BY session ORDER BY ms, key) AS next_tool FROM moments),
sizes AS (SELECT kind AS name, count(*)::DOUBLE AS answered FROM nexts WHERE next_tool IS NOT NULL GROUP BY kind HAVING count(*) >= 30), base AS (SELECT tool AS action, count(*)::DOUBLE AS base FROM moments GROUP BY tool HAVING count(*) >= 30),
follows AS (SELECT kind AS name, next_tool AS action, count(*) AS n FROM nexts WHERE next_tool IS NOT NULL GROUP BY ALL), lifted AS (
  SELECT name, action, n, n / answered AS p, n / answered / (base / (SELECT count(*) FROM moments)) AS lift FROM follows JOIN sizes USING (name) JOIN base USING (action))
SELECT name, action, n, round(lift, 9) AS lift FROM lifted WHERE p >= 0.05::DOUBLE AND lift >= 1.0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY lift DESC, action) = 1""")  # fmt: skip
def adjacency_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With floors that random successors can reach."""
    found = metrics.action_mapping(moments(spark, sf_dir), replace(DEFAULT, adjacency_p=0.05, adjacency_lift=1.0))
    return found.select("name", "action", "n", F.round("lift", 9).alias("lift"))


@register("supply_halves", f"""WITH {EVENTS}, span AS (SELECT kind AS name, min(ms) AS lo, max(ms) AS hi, min(ms) + (max(ms) - min(ms)) / 2.0::DOUBLE AS mid FROM moments GROUP BY kind HAVING count(*) >= 6 AND max(ms) > min(ms)),
halves AS (SELECT name, count(*) FILTER (ms < mid) AS early_all, count(*) FILTER (ms < mid AND tool = 'k3') AS early_acts, count(*) FILTER (ms < mid AND tool = 'k3' AND neg = 1) AS early_refused,
  count(*) FILTER (ms >= mid) AS late_all, count(*) FILTER (ms >= mid AND tool = 'k3') AS late_acts, count(*) FILTER (ms >= mid AND tool = 'k3' AND neg = 1) AS late_refused FROM moments JOIN span ON ms BETWEEN lo AND hi GROUP BY name)
SELECT name, early_acts, late_acts, early_refused, late_refused, round((late_acts / late_all::DOUBLE) / (early_acts / early_all::DOUBLE), 9) AS supply_ratio, late_refused / late_acts::DOUBLE > early_refused / early_acts::DOUBLE * 1.3::DOUBLE AS declines_rose FROM halves""")  # fmt: skip
def supply_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = moments(spark, sf_dir)
    actions = kinds(own).select("record", "name", F.lit("k3").alias("action"))
    return metrics.supply(own, actions).select("name", "early_acts", "late_acts", "early_refused", "late_refused", F.round("supply_ratio", 9).alias("supply_ratio"), "declines_rose")


GAPS = """per AS (SELECT tool AS name, session, count(*) FILTER (neg = 1) AS slips, count(*) FILTER (neg = 0) AS reaches, arg_min(neg, (ms, key)) AS slip_first FROM {0} GROUP BY ALL)
SELECT name, sum(reaches)::BIGINT AS reach, sum(slips)::BIGINT AS slip, count(*) FILTER (slips > 0) AS slip_sessions, count(*) FILTER (slips > 0 AND slip_first = 1) AS stumbles, count(*) FILTER (slips > 0 AND slip_first = 0) AS guarded
FROM per GROUP BY name HAVING sum(slips) >= 15 AND sum(reaches) >= 30 AND count(*) FILTER (slips > 0) >= 8 AND count(*) FILTER (slips > 0 AND slip_first = 1) >= 5"""


@register("gap_stumble", f"WITH {EVENTS}, {GAPS.format('moments')}")
def gap_stumble(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = by_tool(spark, sf_dir)
    return metrics.gap_candidates(own, kinds(own)).drop("record")


@register("trailing_window_read", f"WITH {EVENTS}, recent AS (SELECT * FROM moments, (SELECT max(ms) AS now FROM moments) WHERE ms BETWEEN now - 21 * 86400000 AND now), {GAPS.format('recent')}")
def trailing_window_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap statistics of the last days; what comes first in a session is judged within the window."""
    own = by_tool(spark, sf_dir)
    now = own.agg(F.max("ms").alias("now"))
    recent = metrics.trailing(own.join(F.broadcast(now)), F.col("now")).drop("now")
    return metrics.gap_candidates(recent, kinds(own)).drop("record")


@register("friction_episodes", f"""WITH {EVENTS}, numbered AS (SELECT session, key, neg, row_number() OVER (PARTITION BY session ORDER BY ms, key) - 1 AS idx FROM moments),
seeds AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY session ORDER BY idx) > 6 THEN 1 ELSE 0 END AS apart FROM numbered WHERE neg = 1),
episodes AS (SELECT *, sum(apart) OVER (PARTITION BY session ORDER BY idx) AS episode FROM seeds)
SELECT session, min(idx) AS first, max(idx) AS last, count(*) AS seeds, max(idx) - min(idx) + 1 AS arc FROM episodes GROUP BY session, episode HAVING max(idx) - min(idx) + 1 >= 4 OR count(*) >= 2""")  # fmt: skip
def friction_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("record", "session").orderBy("ms", "key")
    own = moments(spark, sf_dir).select("record", "session", (F.row_number().over(order) - 1).cast("long").alias("idx"), (F.col("pile") != "ordinary").alias("slip"), F.col("key").cast("string").alias("hash"))
    return miners.friction_episodes(own).select("session", "first", "last", "seeds", "arc")


@register("arrivals", f"""WITH {EVENTS}, used AS (SELECT session, ms, kind || '-' || k::VARCHAR AS term FROM moments), newest AS (SELECT max(ms) AS newest FROM used)
SELECT term, min(ms) AS first_ms, count(*) AS n, count(DISTINCT session) AS sessions FROM used GROUP BY term HAVING min(ms) >= (SELECT newest FROM newest) - 30 * 86400000::BIGINT AND count(*) >= 15 AND count(DISTINCT session) >= 5""")  # fmt: skip
def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = moments(spark, sf_dir).withColumn("term", F.concat_ws("-", "event_type", "k"))
    return miners.arriving_terms(own).select("term", "first_ms", "n", "sessions")


@register("evidence_window", f"""WITH {EVENTS}, days AS (SELECT DISTINCT session, k, ts::DATE AS day FROM moments), marked AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY session, k ORDER BY day) > 30 THEN 1 ELSE 0 END AS new FROM days),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY session, k ORDER BY day) AS island FROM marked), islands AS (SELECT session, k, island, min(day) AS lo, max(day) AS hi, count(*) AS days FROM numbered GROUP BY ALL),
last AS (SELECT session, k, arg_max(lo, island) AS llo, arg_max(hi, island) AS lhi, arg_max(days, island) AS ldays, min(lo) AS lo, max(hi) AS hi, sum(days)::BIGINT AS days FROM islands GROUP BY session, k)
SELECT session, k, CASE WHEN ldays >= 2 THEN llo ELSE lo END AS from_day, CASE WHEN ldays >= 2 THEN lhi ELSE hi END AS to_day, CASE WHEN ldays >= 2 THEN ldays ELSE days END AS days FROM last""")  # fmt: skip
def evidence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = moments(spark, sf_dir).select("session", "k", F.to_date("at").alias("day")).distinct()
    return metrics.evidence_window(days, ["session", "k"])


@register("session_time_slices", r"""SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def session_time_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: tumbling windows."""
    own = table(spark, sf_dir, "events").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return own.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "total")


@register("supported_band", r"""SELECT source AS record, count(DISTINCT doc_id) AS sessions, greatest(1, least(30, count(DISTINCT doc_id) // 3)) AS hi, least(8, greatest(1, least(30, count(DISTINCT doc_id) // 3))) AS lo FROM documents GROUP BY source""")
def supported_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select(F.col("source").alias("record"), F.col("doc_id").alias("session"))
    return metrics.supported_clusters(own, least=1)


@register("pile_admission", f"""WITH {EVENTS} SELECT (k // 10) AS cluster, count(*) AS n, count(DISTINCT session) AS sessions, round(avg(neg), 9) AS anchor_share FROM moments GROUP BY ALL HAVING count(DISTINCT session) >= 3 AND avg(neg) < 0.7""")
def pile_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = moments(spark, sf_dir).select("record", "session", F.floor(F.col("k") / 10).alias("cluster"), (F.col("pile") != "ordinary").alias("anchor"))
    return metrics.admitted(own).select("cluster", "n", "sessions", F.round("anchor_share", 9).alias("anchor_share"))


# --- joins and sets ------------------------------------------------------------------------------------


@register("anti_join_pending", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_join_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return exchanges.new_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), done, ["c_custkey"])


@register("semi_join_titles", "SELECT DISTINCT lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(toxic, "doc_id", "left_semi").select("lang", "source").distinct()


@register("label_join", "SELECT source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select(F.lit("docs").alias("record"), F.col("doc_id").alias("key"), "source")
    given = table(spark, sf_dir, "labels").select(F.lit("docs").alias("record"), F.col("doc_id").alias("key"), F.array("quality").alias("kinds"))
    return metrics.label(own, given).groupBy("source", F.get("kinds", F.lit(0)).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@register("prefix_roots", r"""WITH folders AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+:/', ''), '[?#].*$', '') AS folder FROM pages UNION SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1).concat('/').concat(regexp_extract(url, '://[^/]*/([a-z]+)', 1)) FROM pages)
SELECT a.folder, arg_min(b.folder, (length(b.folder), b.folder)) AS root FROM folders a JOIN folders b ON a.folder = b.folder OR rtrim(a.folder, '/') = rtrim(b.folder, '/') OR starts_with(a.folder, rtrim(b.folder, '/') || '/') GROUP BY a.folder""")  # fmt: skip
def prefix_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    whole = pages.select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+:/", ""), "[?#].*$", "").alias("folder"))
    top = pages.select(F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("/"), F.regexp_extract("url", "://[^/]*/([a-z]+)", 1)).alias("folder"))
    return mirror.repo_roots(whole.union(top).distinct().withColumn("record", F.lit("web"))).select("folder", "root")


@register("event_log_fold", "SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey HAVING arg_max(o_orderstatus, (o_orderdate, o_orderkey)) <> 'F'")
def event_log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a log: the last status of each customer, retired by F."""
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.when(F.col("o_orderstatus") == "F", "retired").otherwise("born").alias("event"), F.struct("o_orderdate", "o_orderkey").alias("seq"), "o_orderstatus")
    return state.fold_log(own, ["name"], ["o_orderstatus"]).select(F.col("name").alias("o_custkey"), F.col("o_orderstatus").alias("status"))


@register("draft_collapse", "SELECT conv_id, turn // 2 AS parent, min(turn) AS pos, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY ALL")
def draft_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of one parent: the last text at the first place."""
    from .sources.dialect_a import collapse_drafts

    own = table(spark, sf_dir, "conversations").where("role = 'user'")
    own = own.select(F.lit("chat").alias("path"), F.col("conv_id").cast("string").alias("session"), "conv_id", F.col("turn").alias("line_no"), "role", "text", F.floor(F.col("turn") / 2).alias("parent"), F.floor(F.col("turn") / 2).cast("string").alias("parentUuid"))
    return collapse_drafts(own).select("conv_id", "parent", F.col("line_no").alias("pos"), "text")


@register("budget_prefix", "SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used FROM documents) WHERE used <= 5800")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.within_budget(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars").select("source", "doc_id", "used")


@register("quote_candidates", r"""WITH own AS (SELECT source AS name, lang AS session, doc_id AS key, n_chars FROM documents WHERE n_chars BETWEEN 25 AND 2100), ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n_chars, key) AS r FROM own),
kept AS (SELECT *, row_number() OVER (PARTITION BY name, session ORDER BY r) AS s FROM ranked) SELECT name, key, row_number() OVER (PARTITION BY name ORDER BY r)::INT AS place FROM kept WHERE r <= 3 OR s = 1 QUALIFY row_number() OVER (PARTITION BY name ORDER BY r) <= 5""")  # fmt: skip
def quote_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts of a category, from other sessions after the third. Sources stand for categories, languages for sessions."""
    own = table(spark, sf_dir, "documents").where("n_chars between 25 and 2100").select(F.col("source").alias("name"), F.col("lang").alias("session"), F.col("doc_id").alias("key"), "n_chars")
    return state.diverse_quotes(own, ["name"], [F.col("n_chars"), F.col("key")]).select("name", "key", "place")


@register("session_samples", r"""WITH own AS (SELECT source AS name, lang AS session, doc_id FROM documents WHERE n_chars >= 10), firsts AS (SELECT name, session, min(doc_id) AS doc_id FROM own GROUP BY ALL)
SELECT name, doc_id FROM firsts QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id) <= 5""")  # fmt: skip
def session_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").where("n_chars >= 10").select(F.col("source").alias("name"), F.col("lang").alias("session"), "doc_id")
    return state.session_samples(own, ["name"], "doc_id", 5).select("name", "doc_id")


@register("history_ring", r"""WITH own AS (SELECT o_custkey, o_orderdate::DATE AS stamp, max(o_totalprice) AS price FROM orders GROUP BY ALL)
SELECT o_custkey, stamp, price FROM own QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY stamp DESC) <= 12""")  # fmt: skip
def history_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("stamp")).agg(F.max("o_totalprice").alias("price"))
    return state.last_entries(own, ["o_custkey"], "stamp", 12)


@register("usage_tally", r"""SELECT event_type AS feature, count(*) AS calls, sum(k)::BIGINT AS units, round(sum(value), 4) AS cost FROM (SELECT event_type, value, (props->>'$.k')::BIGINT AS k FROM events) GROUP BY event_type""")
def usage_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = moments(spark, sf_dir).select(F.col("event_type").alias("feature"), F.col("k").alias("units"), F.col("value").alias("cost"))
    return state.tally_usage(own, ["feature"]).select("feature", "calls", "units", F.round("cost", 4).alias("cost"))


@register("stage_rates", r"""WITH own AS (SELECT event_type AS stage, value AS ms, (props->>'$.k')::BIGINT AS units FROM events) SELECT stage, round(sum(ms) / sum(units), 6) AS ms_per_unit, round(1000 * sum(ms) / sum(units), 3) AS eta_ms FROM own WHERE units > 0 GROUP BY stage""")
def stage_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = moments(spark, sf_dir).select(F.col("event_type").alias("stage"), F.col("value").alias("ms"), F.col("k").alias("units"))
    return state.stage_rates(own, 1000).select("stage", F.round("ms_per_unit", 6).alias("ms_per_unit"), F.round("eta_ms", 3).alias("eta_ms"))


@register("name_distance", "SELECT a.r_name AS name, arg_min(b.n_name, (levenshtein(a.r_name, b.n_name), b.n_name)) AS nearest, min(levenshtein(a.r_name, b.n_name))::INT AS edits FROM region a, nation b GROUP BY a.r_name")
def name_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Did-you-mean over small fixed lists: 25 known names, broadcast."""
    known = F.broadcast(table(spark, sf_dir, "nation").select("n_name"))
    pairs = table(spark, sf_dir, "region").select(F.col("r_name").alias("name")).crossJoin(known).withColumn("d", F.levenshtein("name", "n_name"))
    return pairs.groupBy("name").agg(F.min(F.struct("d", "n_name")).alias("b")).select("name", F.col("b.n_name").alias("nearest"), F.col("b.d").alias("edits"))


# --- vectors -----------------------------------------------------------------------------------------

SIMS = """sims AS (SELECT v.vec_id, c.vec_id AS idx, list_dot_product(v.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS sim FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id < 8) c)"""


def first_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight vectors as a frozen model."""
    return table(spark, sf_dir, "embeddings").where("vec_id < 8").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("centre"))


@register("nearest_centroid", f"WITH {SIMS} SELECT vec_id, arg_max(idx, (round(sim, 9), -idx)) AS idx, round(max(sim), 6) AS sim FROM sims GROUP BY vec_id")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.nearest_centre(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), first_centres(spark, sf_dir), ["vec_id"])
    return found.select("vec_id", "idx", F.round("sim", 6).alias("sim"))


@register("top2_margin", f"""WITH {SIMS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, idx) AS r FROM sims)
SELECT vec_id, max(idx) FILTER (r = 1) AS idx, max(sim) FILTER (r = 1) >= 0.3 AND max(sim) FILTER (r = 1) - max(sim) FILTER (r = 2) >= 0.02 AS anchored FROM ranked GROUP BY vec_id""")  # fmt: skip
def top2_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.top_two(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), first_centres(spark, sf_dir), ["vec_id"], least=0.3, margin=0.02)
    return found.select("vec_id", "idx", "anchored")


@register("cover_threshold", f"WITH {SIMS} SELECT vec_id, 'c' || idx::VARCHAR AS name, round(sim, 6) AS sim FROM sims WHERE sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, idx) = 1")
def cover_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    installed = first_centres(spark, sf_dir).select(F.concat(F.lit("c"), F.col("idx").cast("string")).alias("name"), "centre")
    found = vectors.covers(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), installed, ["vec_id"], least=0.3)
    return found.select("vec_id", "name", F.round("sim", 6).alias("sim"))


@register("fit_stats", f"""WITH {SIMS}, best AS (SELECT max(floor(sim * 1000 + 0.5)) AS s FROM sims GROUP BY vec_id), ordered AS (SELECT list(s ORDER BY s) AS xs FROM best)
SELECT len(xs) AS n, xs[least(len(xs) - 1, floor(len(xs) * 0.5))::INT + 1] / 1000 AS median, xs[least(len(xs) - 1, floor(len(xs) * 0.1::DOUBLE))::INT + 1] / 1000 AS p10 FROM ordered""")  # fmt: skip
def fit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.nearest_centre(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), first_centres(spark, sf_dir), ["vec_id"])
    stats = mirror.counted_quantiles(near.withColumn("s", F.floor(F.col("sim") * 1000 + 0.5)), [], "s", {"median": 0.5, "p10": 0.1})
    return stats.select("n", (F.col("median") / F.lit(1000.0)).alias("median"), (F.col("p10") / F.lit(1000.0)).alias("p10"))


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lit("vectors").alias("record"), "vec_id", "embedding")


def derived(own: DataFrame) -> DataFrame:
    """The chosen fit of the whole band that the vectors support, each vector being a conversation of its own."""
    band = metrics.supported_clusters(own.select("record", F.col("vec_id").alias("session")), least=1).first()
    return vectors.derive_k(vectors.cluster(own, list(range(band["lo"], band["hi"] + 1))))


@register("derive_k")
def derive_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(labelled_vectors(spark, sf_dir)).select("record", "k", "silhouette")


@register("kmeans_piles")
def kmeans_piles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector in the pile of its nearest centre, of the derived number of piles, and whether the pile is admitted."""
    own = labelled_vectors(spark, sf_dir)
    centres = vectors.centres_of(derived(own), "before")
    near = vectors.nearest_centre(own, centres.select("idx", "centre"), ["record", "vec_id"])
    kept = metrics.admitted(near.select("record", F.col("idx").alias("cluster"), F.col("vec_id").alias("session"), F.lit(False).alias("anchor")))
    kept = kept.select("record", F.col("cluster").alias("idx"), F.lit(True).alias("admitted"))
    return near.join(kept, ["record", "idx"], "left").select("vec_id", "idx", F.round("sim", 6).alias("sim"), F.coalesce("admitted", F.lit(False)).alias("admitted"))


@register("hash_embed")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.embed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text").drop("text")


@register("miner_findings")
def miner_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors: document lines as prompts, one a minute, event types as chains of actions."""
    own = document_lines(spark, sf_dir).select(
        "record", "session", "idx", F.col("line").alias("prompt"), F.lit("").alias("said"), F.col("line").alias("reaction"), F.lit(False).alias("pasted"), (F.col("doc_id") * 60000).alias("ms"), F.xxhash64("session", "idx").cast("string").alias("hash"),
        F.when(F.col("line").contains("!!"), "plain").alias("interrupted"), F.lit(False).alias("declined"),
    )
    chains = moments(spark, sf_dir).select("record", "session", F.struct("ms", "key").alias("pos"), F.col("event_type").alias("action"))
    return miners.measure(own, chains).withColumns({"receipts": F.to_json("receipts"), "exemplars": F.to_json("exemplars")})
