"""More registered queries: verdicts, windows, findings, mixes, formats, lookups."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions import formats, text
from .operators import exchanges, metrics, miners, mirror, phrases, state
from .queries import BY_TOOL, EVENTS, FUNCTION_WORDS, ORACLES, PAIRS, RITUALS, STOPS, by_tool, chat_labelled, chat_rituals, chats, document_lines, kinds, moments, register
from .sources.tables import table

#: Floors that invented events reach.
LOW = replace(DEFAULT, adjacency_p=0.05, adjacency_lift=1.0, rise=1.02, fade=0.98)

#: The capped terms of (key, text) rows of `texts`, as `terms`.
TERMS = rf"""raw_terms AS (
  SELECT key, unnest(regexp_extract_all(text, '([a-zA-Z][a-zA-Z0-9_.-]{{2,}})', 1)) AS raw, generate_subscripts(regexp_extract_all(text, '([a-zA-Z][a-zA-Z0-9_.-]{{2,}})', 1), 1) AS pos FROM texts
), clean_terms AS (SELECT key, pos, regexp_replace(lower(raw), '[._-]+$', '') AS term FROM raw_terms
), term_counts AS (SELECT key, term, count(*) AS n, min(pos) AS pos FROM clean_terms WHERE length(term) BETWEEN 3 AND 40 AND term NOT IN ({FUNCTION_WORDS}) GROUP BY ALL
), terms AS (SELECT key, term FROM term_counts QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, pos, term) <= 24)"""


# --- verdicts and windows ------------------------------------------------------------------------------


@register("category_verdicts", f"""WITH {BY_TOOL},
weeks AS (SELECT name, floor(ms / 604800000.0) AS week, count(*) AS n FROM labelled_moments GROUP BY ALL), bursts AS (SELECT name, max(n) >= 0.5 * sum(n) AS burst FROM weeks GROUP BY name),
span AS (SELECT name, min(ms) AS lo, max(ms) AS hi, min(ms) + (max(ms) - min(ms)) / 2.0::DOUBLE AS mid FROM labelled_moments GROUP BY name HAVING count(*) >= 6 AND max(ms) > min(ms)),
own AS (SELECT name, count(*) FILTER (ms < mid)::DOUBLE AS early, count(*) FILTER (ms >= mid)::DOUBLE AS late FROM labelled_moments JOIN span USING (name) GROUP BY name),
every AS (SELECT span.name, count(*) FILTER (ms < mid) AS early_all, count(*) FILTER (ms >= mid) AS late_all FROM moments JOIN span ON ms BETWEEN lo AND hi GROUP BY ALL),
rates AS (SELECT name, early / early_all AS e, late / late_all AS l FROM own JOIN every USING (name)),
directions AS (SELECT name, CASE WHEN e = 0 AND l > 0 OR e > 0 AND l >= e * 1.02::DOUBLE THEN 'rising' WHEN e > 0 AND l <= e * 0.98::DOUBLE THEN 'fading' END AS dir FROM rates),
nexts AS (SELECT *, lead(tool) OVER (PARTITION BY session ORDER BY ms, key) AS next_tool FROM moments), sizes AS (SELECT tool AS name, count(*)::DOUBLE AS answered FROM nexts WHERE next_tool IS NOT NULL GROUP BY tool HAVING count(*) >= 30),
base AS (SELECT tool AS action, count(*)::DOUBLE AS base FROM moments GROUP BY tool HAVING count(*) >= 30),
follows AS (SELECT tool AS name, next_tool AS action, count(*) AS n FROM nexts WHERE next_tool IS NOT NULL GROUP BY ALL), lifted AS (
  SELECT name, action, n / answered AS p, n / answered / (base / (SELECT count(*) FROM moments)) AS lift FROM follows JOIN sizes USING (name) JOIN base USING (action)),
actions AS (SELECT name, action FROM lifted WHERE p >= 0.05::DOUBLE AND lift >= 1.0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY lift DESC, action) = 1),
halves AS (SELECT s.name, a.action, count(*) FILTER (ms < mid)::DOUBLE AS ea, count(*) FILTER (ms < mid AND tool = a.action)::DOUBLE AS es, count(*) FILTER (ms < mid AND tool = a.action AND neg = 1)::DOUBLE AS er,
  count(*) FILTER (ms >= mid)::DOUBLE AS la, count(*) FILTER (ms >= mid AND tool = a.action)::DOUBLE AS ls, count(*) FILTER (ms >= mid AND tool = a.action AND neg = 1)::DOUBLE AS lr
  FROM span s JOIN actions a USING (name) JOIN directions d ON d.name = s.name AND d.dir = 'fading' JOIN moments ON ms BETWEEN lo AND hi GROUP BY ALL),
supplied AS (SELECT name, action, CASE WHEN es / ea = 0 THEN 'Infinity'::DOUBLE ELSE (ls / la) / (es / ea) END AS ratio, coalesce(lr / nullif(ls, 0), 0) > coalesce(er / nullif(es, 0), 0) * 1.02::DOUBLE AS rose FROM halves WHERE ea > 0 AND la > 0 AND (es > 0 OR ls > 0))
SELECT name, n, sessions, round(lift, 9) AS lift, burst, CASE WHEN ratio >= 0.98::DOUBLE AND NOT rose THEN 'met' ELSE dir END AS direction, action, coalesce(ratio >= 0.98::DOUBLE AND NOT rose OR ratio <= 0.98::DOUBLE, false) AS verified
FROM tallied JOIN bursts USING (name) LEFT JOIN directions USING (name) LEFT JOIN supplied USING (name)""")  # fmt: skip
def category_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = by_tool(spark, sf_dir)
    found = metrics.verdicts(own, kinds(own).select("record", "name"), LOW)
    return found.select("name", "n", "sessions", F.round("lift", 9).alias("lift"), "burst", "direction", "action", "verified")


@register("gap_window", f"""WITH {EVENTS}, recent AS (SELECT * FROM moments, (SELECT max(ms) AS now FROM moments) WHERE ms BETWEEN now - 21 * 86400000 AND now),
per AS (SELECT tool AS name, session, count(*) FILTER (neg = 1) AS slips, count(*) FILTER (neg = 0) AS reaches, arg_min(neg, (ms, key)) AS slip_first FROM recent GROUP BY ALL)
SELECT name, sum(reaches)::BIGINT AS reach, count(*) FILTER (slips > 0 AND slip_first = 1) AS stumbles, count(*) AS chances, (SELECT count(*) FROM recent) AS sample, round(sum(slips) / (SELECT count(*) FROM recent), 9) AS slip_rate FROM per GROUP BY name
UNION ALL SELECT 'never', 0, 0, 0, (SELECT count(*) FROM recent), 0""")  # fmt: skip
def gap_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = by_tool(spark, sf_dir)
    names = kinds(own).select("record", "name").unionByName(spark.createDataFrame([("events", "never")], "record string, name string"))
    found = metrics.gap_window_reads(own, names, F.lit(own.agg(F.max("ms")).first()[0]))
    return found.select("name", "reach", "stumbles", "chances", "sample", F.round("slip_rate", 9).alias("slip_rate"))


def chat_with_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_labelled(spark, sf_dir).withColumn("ai_terms", F.transform(exchanges.term_counts(F.col("said_full"), DEFAULT.terms_cap), lambda x: x["term"]))


CHAT_TERMS = f"""{PAIRS}, labelled AS (SELECT conv_id AS session, idx, hash AS key, reaction AS reply, said_full, length(said_full) AS said_len FROM hashed), {RITUALS},
marked AS (SELECT *, lead(key) OVER (PARTITION BY session ORDER BY idx, key) AS next_key, key IN (SELECT key FROM candidates WHERE phrase IN (SELECT phrase FROM rituals)) AS is_ask FROM labelled),
texts AS (SELECT DISTINCT 'a' || key AS key, said_full AS text FROM labelled UNION ALL SELECT DISTINCT 'r' || key, reply FROM labelled), {TERMS},
patches AS (SELECT term AS id FROM terms WHERE starts_with(key, 'a') GROUP BY term HAVING count(*) >= 3)"""
TERM_READS = """named AS (SELECT p.id, m.session, m.is_ask, p.id IN (SELECT term FROM terms WHERE key = 'a' || m.key) OR (m.is_ask AND p.id IN (SELECT term FROM terms WHERE key = 'a' || m.next_key)) AS context,
  NOT m.is_ask AND p.id IN (SELECT term FROM terms WHERE key = 'r' || m.key) AS engaged FROM patches p JOIN spans USING (id) JOIN marked m ON m.idx BETWEEN lo AND hi)
SELECT id, round(count(*) FILTER (is_ask AND context) / count(*)::DOUBLE, 9) AS ask_rate, round(count(*) FILTER (engaged) / count(*)::DOUBLE, 9) AS engage_rate, count(DISTINCT session) FILTER (context OR engaged) AS sessions, count(*) AS sample FROM named GROUP BY id"""


def term_patches(own: DataFrame) -> DataFrame:
    """A patch for each term that several answers have. Copies of an exchange are one answer."""
    each = own.select("record", "key", "ai_terms").dropDuplicates(["record", "key"]).select("record", F.explode("ai_terms").alias("id"))
    return each.groupBy("record", "id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("record", "id", F.array("id").alias("terms"))


@register("ask_window", f"WITH {CHAT_TERMS}, spans AS (SELECT id, -1 AS lo, 2 AS hi FROM patches), {TERM_READS}")
def ask_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over exchanges up to the third of each conversation, whose numbers stand for times."""
    own = chat_with_terms(spark, sf_dir)
    found = phrases.ask_window_reads(own, chat_rituals(own), term_patches(own), F.lit(2))
    return found.select("id", F.round("ask_rate", 9).alias("ask_rate"), F.round("engage_rate", 9).alias("engage_rate"), "sessions", "sample")


@register("ask_span", f"WITH {CHAT_TERMS}, spans AS (SELECT id, min(idx) AS lo, max(idx) AS hi FROM patches JOIN terms ON term = id JOIN marked ON terms.key = 'a' || marked.key AND is_ask GROUP BY id), {TERM_READS}")
def ask_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the span of the asks whose own answers have the term."""
    own = chat_with_terms(spark, sf_dir)
    rituals = chat_rituals(own)
    asks = phrases.mark_asks(own, rituals).where("is_ask").select("record", "key", F.explode(F.array_distinct("ai_terms")).alias("id"))
    found = phrases.ask_span_reads(own, rituals, term_patches(own).join(asks, ["record", "id"], "left_semi"), asks)
    return found.select("id", F.round("ask_rate", 9).alias("ask_rate"), F.round("engage_rate", 9).alias("engage_rate"), "sessions", "sample")


@register("any_term_semi", f"""WITH {PAIRS}, texts AS (SELECT DISTINCT hash AS key, said_full AS text FROM hashed), {TERMS} SELECT DISTINCT key FROM terms WHERE term IN ('elle', 'tion', 'que')""")
def any_term_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchanges.with_any_term(chat_with_terms(spark, sf_dir), "ai_terms", ["elle", "tion", "que"]).select("key").distinct()


@register("provenance_window", f"""WITH {EVENTS}, days AS (SELECT DISTINCT session, ts::DATE AS day FROM moments WHERE neg = 1), marked AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY session ORDER BY day) > 2 THEN 1 ELSE 0 END AS new FROM days),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY day) AS island FROM marked), islands AS (SELECT session, island, min(day) AS lo, max(day) AS hi, count(*) AS days FROM numbered GROUP BY ALL),
last AS (SELECT session, CASE WHEN arg_max(days, island) >= 2 THEN arg_max(lo, island) ELSE min(lo) END AS lo, CASE WHEN arg_max(days, island) >= 2 THEN arg_max(hi, island) ELSE max(hi) END AS hi FROM islands GROUP BY session)
SELECT session, count(*) AS moments FROM moments JOIN last USING (session) WHERE neg = 1 AND ts::DATE BETWEEN lo AND hi GROUP BY session""")  # fmt: skip
def provenance_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each user within the user's last stretch of days without a gap above two."""
    own = moments(spark, sf_dir).where("pile <> 'ordinary'").withColumn("day", F.to_date("at"))
    window = metrics.evidence_window(own.select("session", "day").distinct(), ["session"], replace(DEFAULT, island_gap_days=2))
    return metrics.within_days(own, window, ["session"]).groupBy("session").agg(F.count(F.lit(1)).alias("moments"))


# --- the descriptive read ------------------------------------------------------------------------------


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as stops of a person, purchases as refusals, all others as turns of the assistant with their tools and handoffs."""
    none, kind = F.lit(None), F.col("event_type")
    human = kind.isin("error", "purchase")
    return moments(spark, sf_dir).select(
        "record", "session", F.col("key").cast("string").alias("uuid"), F.col("at").cast("string").alias("ts"), F.when(human, "user").otherwise("assistant").alias("role"),
        (kind == "error").alias("interrupted"), F.when(kind == "error", F.when(F.col("k") < 50, "tool-use").otherwise("plain")).alias("interrupt_kind"),
        F.when(kind == "purchase", F.when(F.col("k") < 50, "user-rejected").otherwise("automode-blocked")).alias("denial"),
        "tools", F.when(F.col("k") < 30, F.array(kind)).otherwise(none).alias("delegations"), F.when(F.col("k") < 40, 1).otherwise(0).alias("delegation_count"),
    )


@register("tool_mix", f"""WITH {EVENTS}, own AS (SELECT tool AS name, count(*) AS n FROM moments WHERE kind NOT IN ('error', 'purchase') GROUP BY tool)
SELECT name, n, round(n / (SELECT sum(n) FROM own)::DOUBLE, 9) AS share, row_number() OVER (ORDER BY n DESC, name)::INT AS rank FROM own""")  # fmt: skip
def tool_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror.mix(event_turns(spark, sf_dir), "tools").select("name", "n", F.round("share", 9).alias("share"), "rank")


@register("agent_mix", f"""WITH {EVENTS}, own AS (SELECT * FROM moments WHERE kind NOT IN ('error', 'purchase')), named AS (SELECT kind AS name, count(*) AS n FROM own WHERE k < 30 GROUP BY kind)
SELECT name, n, round(n / (SELECT count(*) FROM own WHERE k < 40)::DOUBLE, 9) AS share, row_number() OVER (ORDER BY n DESC, name)::INT AS rank FROM named""")  # fmt: skip
def agent_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the reported number of handoffs, more than those with a readable name."""
    return mirror.mix(event_turns(spark, sf_dir), "delegations", "delegation_count").select("name", "n", F.round("share", 9).alias("share"), "rank")


@register("friction_receipts", f"""WITH {EVENTS} SELECT key::VARCHAR AS uuid, CASE WHEN kind = 'error' THEN CASE WHEN k < 50 THEN 'permission-stop' ELSE 'course-correction' END WHEN k < 50 THEN 'tool-decline' ELSE 'system-block' END AS kind
FROM moments WHERE kind IN ('error', 'purchase')""")  # fmt: skip
def friction_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror.friction_events(event_turns(spark, sf_dir)).select("uuid", "kind")


@register("repo_messages", r"""WITH typed AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+:/', ''), '[?#].*$', '') AS folder FROM pages UNION ALL SELECT regexp_extract(url, '://([^/?#]*)', 1).concat('/').concat(regexp_extract(url, '://[^/]*/([a-z]+)', 1)) FROM pages),
counted AS (SELECT folder, count(*) AS n FROM typed WHERE folder <> '' GROUP BY folder),
roots AS (SELECT a.folder, arg_min(b.folder, (length(b.folder), b.folder)) AS root FROM counted a JOIN counted b ON a.folder = b.folder OR rtrim(a.folder, '/') = rtrim(b.folder, '/') OR starts_with(a.folder, rtrim(b.folder, '/') || '/') GROUP BY a.folder)
SELECT root, sum(n)::BIGINT AS messages FROM counted JOIN roots USING (folder) GROUP BY root""")  # fmt: skip
def repo_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page folders, and the first folder of each host, stand for working folders."""
    pages = table(spark, sf_dir, "pages")
    whole = pages.select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+:/", ""), "[?#].*$", "").alias("cwd"))
    top = pages.select(F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("/"), F.regexp_extract("url", "://[^/]*/([a-z]+)", 1)).alias("cwd"))
    return mirror.repos(whole.union(top).withColumn("record", F.lit("web"))).select("root", "messages")


# --- findings ------------------------------------------------------------------------------------------


@register("rule_findings", rf"""WITH lines AS (SELECT doc_id::VARCHAR AS session, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents),
normal AS (SELECT session, idx, trim(regexp_replace(regexp_replace(lower(line), '[^a-z0-9 ''/.-]', ' ', 'g'), '\s+', ' ', 'g')) AS phrase FROM lines),
kept AS (SELECT *, list_filter(string_split(phrase, ' '), lambda x: x <> '') AS w FROM normal),
counted AS (SELECT phrase, count(*) AS n, count(DISTINCT session) AS sessions FROM kept WHERE len(w) BETWEEN 2 AND 12 AND len(list_filter(w, lambda x: x NOT IN ({STOPS}))) > 0 GROUP BY phrase HAVING count(*) >= 3 AND count(DISTINCT session) >= 3),
top AS (SELECT *, row_number() OVER (ORDER BY n DESC, phrase)::INT AS rank FROM counted QUALIFY row_number() OVER (ORDER BY n DESC, phrase) <= 10),
first AS (SELECT phrase, session, row_number() OVER (PARTITION BY phrase ORDER BY session, idx) AS r FROM normal WHERE phrase IN (SELECT phrase FROM top))
SELECT 'rule:docs:' || substr(sha256(phrase), 1, 16) AS id, 'count ' || n || ' · sessions ' || sessions AS receipt, rank, (SELECT string_agg(session, ',' ORDER BY r) FROM first f WHERE f.phrase = top.phrase AND r <= 3) AS exemplars FROM top""")  # fmt: skip
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = document_lines(spark, sf_dir).select("record", "session", "idx", F.col("line").alias("prompt"), F.lit(False).alias("pasted"), F.xxhash64("session", "idx").cast("string").alias("hash"))
    found = miners.rules(own)
    return found.select("id", miners.receipt_text(F.col("receipts")).alias("receipt"), "rank", F.array_join(F.transform("exemplars", lambda x: x["session"]), ",").alias("exemplars"))


@register("ritual_findings", f"""WITH {EVENTS}, lagged AS (SELECT session, ms, key, kind, lag(kind) OVER (PARTITION BY session ORDER BY ms, key) AS before FROM moments),
distinct_steps AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ms, key) AS i FROM lagged WHERE before IS DISTINCT FROM kind),
steps AS (SELECT session, kind, lead(kind, 1) OVER w AS k1, lead(kind, 2) OVER w AS k2, lead(kind, 3) OVER w AS k3, lead(kind, 4) OVER w AS k4 FROM distinct_steps WINDOW w AS (PARTITION BY session ORDER BY i)),
grams AS (SELECT session, kind || ' → ' || k1 || ' → ' || k2 AS chain FROM steps UNION ALL SELECT session, kind || ' → ' || k1 || ' → ' || k2 || ' → ' || k3 FROM steps
  UNION ALL SELECT session, kind || ' → ' || k1 || ' → ' || k2 || ' → ' || k3 || ' → ' || k4 FROM steps),
counted AS (SELECT chain, count(*) AS n, count(DISTINCT session) AS sessions, list_sort(list(DISTINCT session))[1:3] AS users FROM grams WHERE chain IS NOT NULL GROUP BY chain HAVING count(*) >= 4 AND count(DISTINCT session) >= 3)
SELECT 'ritual:events:' || substr(sha256(chain), 1, 16) AS id, 'they run this chain again and again: ' || chain AS claim, 'occurrences ' || n || ' · sessions ' || sessions AS receipt, array_to_string(users, ',') AS exemplars,
  row_number() OVER (ORDER BY n / length(chain)::DOUBLE DESC, chain)::INT AS rank FROM counted QUALIFY row_number() OVER (ORDER BY n / length(chain)::DOUBLE DESC, chain) <= 8""")  # fmt: skip
def ritual_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = moments(spark, sf_dir).select("record", "session", F.struct("ms", "key").alias("pos"), F.col("event_type").alias("action"))
    return miners.rituals(own).select("id", "claim", miners.receipt_text(F.col("receipts")).alias("receipt"), F.array_join(F.transform("exemplars", lambda x: x["session"]), ",").alias("exemplars"), "rank")


@register("lesson_findings", f"""WITH {EVENTS}, numbered AS (SELECT session, key, neg, ms, row_number() OVER (PARTITION BY session ORDER BY ms, key) - 1 AS idx FROM moments),
seeds AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY session ORDER BY idx) > 6 THEN 1 ELSE 0 END AS apart FROM numbered WHERE neg = 1),
episodes AS (SELECT *, sum(apart) OVER (PARTITION BY session ORDER BY idx) AS episode FROM seeds),
found AS (SELECT session, episode, arg_min(key, idx)::VARCHAR AS first_key, count(*) AS seeds, max(idx) - min(idx) + 1 AS arc, array_to_string(list_transform(list(key ORDER BY idx)[1:3], lambda x: x::VARCHAR), ',') AS exemplars FROM episodes GROUP BY session, episode HAVING max(idx) - min(idx) + 1 >= 4 OR count(*) >= 2)
SELECT 'lesson:events:' || first_key AS id, 'corrections ' || seeds || ' · exchanges ' || arc AS receipt, exemplars, row_number() OVER (ORDER BY arc * seeds DESC, first_key)::INT AS rank FROM found QUALIFY row_number() OVER (ORDER BY arc * seeds DESC, first_key) <= 8""")  # fmt: skip
def lesson_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("record", "session").orderBy("ms", "key")
    own = moments(spark, sf_dir).select("record", "session", (F.row_number().over(order) - 1).cast("long").alias("idx"), "ms", F.col("key").cast("string").alias("hash"), F.col("event_type").alias("reaction"), F.when(F.col("pile") != "ordinary", "plain").alias("interrupted"), F.lit(False).alias("declined"))
    return miners.lessons(own).select("id", miners.receipt_text(F.col("receipts")).alias("receipt"), F.array_join(F.transform("exemplars", lambda x: x["hash"]), ",").alias("exemplars"), "rank")


@register("finding_kinds", rf"""WITH lines AS (SELECT doc_id, doc_id::VARCHAR AS session, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents),
prompts AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[^a-z0-9 ''/.-]', ' ', 'g'), '\s+', ' ', 'g')) AS p FROM lines WHERE trim(line, E' \t\n\r\v\f') <> ''),
seeds AS (SELECT session, idx, CASE WHEN idx - lag(idx) OVER (PARTITION BY session ORDER BY idx) > 6 THEN 1 ELSE 0 END AS apart FROM prompts WHERE contains(line, '!!')),
episodes AS (SELECT *, sum(apart) OVER (PARTITION BY session ORDER BY idx) AS episode FROM seeds),
stretches AS (SELECT 1 FROM episodes GROUP BY session, episode HAVING max(idx) - min(idx) + 1 >= 4 OR count(*) >= 2),
used AS (SELECT session, doc_id * 60000 AS ms, unnest(list_distinct(list_filter(string_split(p, ' '), lambda x: length(x) >= 4 AND x NOT IN ({STOPS})))) AS term FROM prompts),
arrived AS (SELECT term FROM used GROUP BY term HAVING min(ms) >= (SELECT max(ms) FROM used) - 30 * 86400000::BIGINT AND count(*) >= 15 AND count(DISTINCT session) >= 5)
SELECT * FROM (SELECT 'events' AS record, 'ritual' AS kind, count(*) AS n FROM ({ORACLES["ritual_findings"]}) UNION ALL SELECT 'docs', 'rule', count(*) FROM ({ORACLES["rule_findings"]})
  UNION ALL SELECT 'docs', 'lesson', least(count(*), {miners.TOP["lesson"]}) FROM stretches UNION ALL SELECT 'docs', 'win', least(count(*), 1) FROM prompts WHERE length(p) <= 60 AND regexp_matches(p, '{text.APPROVAL}')
  UNION ALL SELECT 'docs', 'arrival', least(count(*), {miners.TOP["arrival"]}) FROM arrived) WHERE n > 0""")  # fmt: skip
def finding_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings of each kind: document lines as prompts, event types as actions, at the floors and caps that hold for all."""
    from .queries import QUERIES

    return miners.finding_counts(QUERIES["miner_findings"](spark, sf_dir)).select("record", "kind", "n")


# --- formats, estimates, lookups -----------------------------------------------------------------------


@register("token_text", """SELECT doc_id, CASE WHEN n >= 1000000 THEN printf('%.1fM', floor(n / 1e6 * 10 + 0.5) / 10) WHEN n >= 1000 THEN floor(n / 1000 + 0.5)::BIGINT || 'k' ELSE n::VARCHAR END AS tokens FROM (SELECT doc_id, n_chars * n_chars // 7 AS n FROM documents)""")
def token_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", formats.token_text(F.expr("n_chars * n_chars div 7")).alias("tokens"))


@register("build_quote", """WITH own AS (SELECT source, count(*) AS messages, floor(count(*) * (5857 / 5756::DOUBLE) + 0.5)::BIGINT AS n FROM documents GROUP BY source), priced AS (SELECT *, n * (0.25::DOUBLE / 5857) AS usd, n * (2.7::DOUBLE / 5857) AS minutes FROM own)
SELECT source, n AS moments, round(usd, 9) AS usd, round(minutes, 9) AS minutes, '~' || format('{:,}', n) || ' moments · ' || CASE WHEN usd > 0 AND usd < 0.005::DOUBLE THEN '< $0.01' ELSE printf('~$%.2f', floor(usd * 100 + 0.5) / 100) END || ' · ' || CASE WHEN minutes > 0 AND minutes < 1 THEN '< 1 min' ELSE '~' || floor(minutes + 0.5)::BIGINT || ' min' END AS line FROM priced""")  # fmt: skip
def build_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("messages")).withColumn("q", formats.quote_of_messages(F.col("messages")))
    return own.select("source", "q.moments", F.round("q.usd", 9).alias("usd"), F.round("q.minutes", 9).alias("minutes"), formats.quote_line(F.col("q")).alias("line"))


@register("minute_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' AS stamp FROM events")
def minute_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return table(spark, sf_dir, "events").select("event_id", formats.minute_stamp(iso).alias("stamp"))


@register("json_in_prose", """SELECT event_id, CASE WHEN event_type <> 'view' THEN (props->>'$.k')::BIGINT END AS k FROM events""")
def json_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties found within an answer; views answer with broken JSON."""
    answer = F.when(F.col("event_type") == "view", F.concat(F.lit("sure: {"), "props")).otherwise(F.concat(F.lit("sure:\n"), "props", F.lit("\nthat is all")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(formats.first_json(answer), "$.k").cast("long").alias("k"))


@register("group_keys", "SELECT o_custkey, string_agg(o_orderstatus || chr(0) || o_orderkey, '|' ORDER BY o_orderstatus || chr(0) || o_orderkey) AS members FROM orders GROUP BY o_custkey")
def group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = F.collect_list(F.struct(F.col("o_orderstatus").alias("name"), F.col("o_orderkey").cast("string").alias("born_at")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(formats.group_key(members).alias("members"))


@register("span_days", f"WITH {EVENTS} SELECT session, floor((max(ms) - min(ms)) / 86400000.0 + 0.5)::BIGINT + 1 AS days FROM moments GROUP BY session")
def span_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments(spark, sf_dir).groupBy("session").agg(formats.span_days(F.min("ms"), F.max("ms")).alias("days"))


@register("same_as_before", f"WITH {EVENTS} SELECT key, (kind, tool) IS NOT DISTINCT FROM lag((kind, tool)) OVER (PARTITION BY session ORDER BY ms, key) AS same FROM moments")
def same_as_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event's kind and tool are those of the user's event before."""
    from pyspark.sql import Window

    now = F.struct("event_type", "tools")
    return moments(spark, sf_dir).withColumn("now", now).select("key", formats.same(F.col("now"), F.lag("now").over(Window.partitionBy("session").orderBy("ms", "key"))).alias("same"))


@register("lifetime_spend", "SELECT round(sum(value) FILTER (event_type <> 'error'), 4) AS live, round(sum(value) FILTER (event_type = 'error'), 4) AS retired FROM events")
def lifetime_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors stand for a feature that was retired."""
    own = moments(spark, sf_dir).select(F.when(F.col("event_type") == "error", "judge").otherwise(F.col("event_type")).alias("feature"), F.col("value").alias("cost"))
    return state.lifetime_spend(own).select(F.round("live", 4).alias("live"), F.round("retired", 4).alias("retired"))


@register("turn_summary", "SELECT event_type AS stage, count(*) AS n, floor(avg(value) + 0.5)::BIGINT AS mean_ms, floor(list(value ORDER BY value)[least(count(*) - 1, floor(0.9::DOUBLE * count(*)))::INT + 1] + 0.5)::BIGINT AS p90_ms FROM events WHERE value >= 0 GROUP BY event_type")
def turn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.turn_summary(moments(spark, sf_dir).select(F.col("event_type").alias("stage"), "value"), ["stage"], "value").select("stage", "n", "mean_ms", "p90_ms")


@register("stage_eta", "WITH rates AS (SELECT event_type AS stage, sum(value) / sum((props->>'$.k')::BIGINT) AS r, count(*) AS units FROM events WHERE (props->>'$.k')::BIGINT > 0 GROUP BY event_type) SELECT floor(sum(r * units) + 0.5)::BIGINT AS eta_ms FROM rates")
def stage_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time that one more unit for each event would take."""
    runs = moments(spark, sf_dir).select(F.col("event_type").alias("stage"), F.col("value").alias("ms"), F.col("k").alias("units"))
    return state.eta(state.stage_rates(runs, 1), runs.where("units > 0").groupBy("stage").agg(F.count(F.lit(1)).alias("units")))


@register("naming_sample", f"""WITH {PAIRS}, lines AS (SELECT conv_id % 8 AS pile, conv_id, idx, substr(trim(regexp_replace(reaction, '\\s+', ' ', 'g')), 1, 240) AS line FROM hashed), firsts AS (SELECT pile, line, min((conv_id, idx)) AS since FROM lines WHERE length(line) >= 3 GROUP BY ALL)
SELECT pile, line, row_number() OVER (PARTITION BY pile ORDER BY since)::INT AS place FROM firsts QUALIFY row_number() OVER (PARTITION BY pile ORDER BY since) <= 4""")  # fmt: skip
def naming_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chats(spark, sf_dir).select((F.col("conv_id") % 8).alias("pile"), "conv_id", F.col("idx").cast("long").alias("idx"), F.col("reaction").alias("reply"))
    return state.naming_sample(own, ["pile"], ["conv_id", "idx"]).select("pile", "line", "place")


@register("recent_exchanges", f"""WITH {PAIRS}, own AS (SELECT conv_id, idx, hash, conv_id // 10 AS file FROM hashed), first AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY hash ORDER BY file DESC, idx, conv_id) = 1),
files AS (SELECT file, count(*) AS n FROM first GROUP BY file), running AS (SELECT *, row_number() OVER (ORDER BY file DESC) AS place, sum(n) OVER (ORDER BY file DESC) AS held FROM files), enough AS (SELECT coalesce(min(place) FILTER (held >= 40), 1000000000) AS e FROM running)
SELECT conv_id, idx FROM first WHERE file IN (SELECT file FROM running, enough WHERE place <= e + 4) ORDER BY lpad(conv_id::VARCHAR, 12, '0') DESC, idx DESC LIMIT 40""")  # fmt: skip
def recent_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last forty exchanges; ten conversations are a file, whose number is its time."""
    own = chats(spark, sf_dir)
    file = F.floor(F.col("conv_id") / 10)
    own = own.select("record", F.lpad("session", 12, "0").alias("session"), "conv_id", F.col("idx").cast("long").alias("idx"), "hash", file.alias("mtime"), F.lpad(file.cast("string"), 12, "0").alias("path"), F.lit("").alias("ts"))
    return exchanges.recent_exchanges(own.withColumn("ts", F.lit("2026-01-01T00:00:00Z")), 40).select("conv_id", "idx")


@register("find_exchange", f"WITH {PAIRS} SELECT conv_id, idx, reaction FROM hashed WHERE hash = (SELECT min(hash) FROM hashed)")
def find_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exchange of the least hash, by the name of its file."""
    own = chats(spark, sf_dir).withColumns({"path": F.concat(F.lit("/archive/"), "session", F.lit(".jsonl")), "mtime": F.lit(0)})
    least = own.agg(F.min(F.struct("hash", "session")).alias("m")).first()["m"]
    return exchanges.find_exchange(own, least["session"], least["hash"]).select("conv_id", F.col("idx").cast("long").alias("idx"), "reaction")
