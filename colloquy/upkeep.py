"""Registered queries of what a record keeps between runs: patches, logs, caches, plans, names of things."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions import text
from .operators import evidence, patches, state
from .queries import register
from .sources.base import without_archived_twins
from .sources.tables import table

NOW_MS = 946_684_800_000
DAY = 86_400_000

# --- patches -------------------------------------------------------------------------------------------

ORDERS_AS_RUNS = f"""runs AS (
  SELECT o_custkey, o_orderkey, epoch_ms(o_orderdate) AS built_ms, CASE o_orderstatus WHEN 'F' THEN 0.9::DOUBLE WHEN 'P' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS fail,
    (o_orderkey % 3 > 0)::INT AS sessions, (90 + o_orderkey % 60)::INT AS sample, (o_orderkey % 4)::INT AS reach, CASE WHEN o_orderstatus = 'O' THEN 1::DOUBLE ELSE 0.5::DOUBLE END AS hold,
    o_orderkey % 7 = 0 AS refused_rose, 0.5::DOUBLE AS engage FROM orders
), numbered AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY built_ms DESC, o_orderkey DESC) AS back, min(built_ms) OVER (PARTITION BY o_custkey) AS born_ms FROM runs
), kept AS (SELECT * FROM numbered WHERE back <= 12
), p AS (
  SELECT o_custkey, 1 + o_custkey % 2 AS mode, any_value(born_ms) AS born_ms, o_custkey % 5 = 0 AS asks_action, CASE WHEN o_custkey % 3 = 0 THEN 0.4::DOUBLE ELSE 0 END AS base_engage, count(*) AS n,
    bool_and(sample >= 100 AND sessions = 0 AND reach > 0) FILTER (back <= 2) AS quiet, bool_and(sample >= 100 AND fail <= 0.6::DOUBLE * 0.5) FILTER (back <= 2) AS halved,
    bool_and(sample < 100 OR fail > 0.6::DOUBLE * 0.8) AS never_better, bool_and(sample >= 30 AND fail <= 0.6::DOUBLE * 0.5 AND engage >= (CASE WHEN o_custkey % 3 = 0 THEN 0.4::DOUBLE ELSE 0 END) * 0.7) FILTER (back <= 2) AS learned,
    bool_or(sample >= 30) AS some_ask, bool_and(sample < 30 OR fail > 0.6::DOUBLE * 0.8) AS never_better_ask, max(built_ms) FILTER (sessions > 0) AS alive,
    max(hold) FILTER (back = 1) AS last_hold, bool_or(refused_rose) FILTER (back = 1) AS last_rose, max(fail) FILTER (back = 1) AS last_fail
  FROM kept GROUP BY o_custkey
), judged AS (
  SELECT *, ({NOW_MS} - born_ms) / {DAY}.0::DOUBLE AS age,
    CASE WHEN mode = 1 AND n >= 2 AND quiet THEN 'graduated' WHEN mode = 1 AND n >= 2 AND halved AND (NOT asks_action OR last_hold >= {DEFAULT.fade} AND NOT last_rose) THEN 'closed'
      WHEN mode = 2 AND base_engage > 0 AND n >= 2 AND learned THEN 'learned' END AS via FROM p
)"""


@register("patch_verdicts", f"""WITH {ORDERS_AS_RUNS}
SELECT o_custkey, via, CASE WHEN via IS NOT NULL THEN 'healed' WHEN mode = 1 AND n >= 6 AND age >= 42 AND never_better THEN 'wrong'
    WHEN mode = 2 AND {NOW_MS} - coalesce(alive, born_ms) >= 42 * {DAY}::BIGINT THEN 'lapsed' WHEN mode = 2 AND n >= 6 AND age >= 42 AND some_ask AND never_better_ask THEN 'wrong' ELSE 'open' END AS state,
  CASE WHEN last_fail / 0.6::DOUBLE >= {DEFAULT.rise} THEN 'opening' WHEN last_fail / 0.6::DOUBLE <= {DEFAULT.fade} THEN 'closing' END AS trend FROM judged""")  # fmt: skip
def patch_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch for each customer, its latest twelve orders being runs: whether it heals, lapses, is wrong or stays open."""
    o = table(spark, sf_dir, "orders")
    fail = F.when(F.col("o_orderstatus") == "F", 0.9).when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.2)
    entry = F.struct(
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("built_ms"), fail.alias("fail"), (F.col("o_orderkey") % 3 > 0).cast("int").alias("sessions"), (90 + F.col("o_orderkey") % 60).cast("int").alias("sample"),
        (F.col("o_orderkey") % 4).cast("int").alias("reach"), F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.5).alias("hold"), (F.col("o_orderkey") % 7 == 0).alias("refused_rose"), F.lit(0.5).alias("engage"),
    )
    runs = o.select("o_custkey", F.struct(entry["built_ms"].alias("at"), "o_orderkey", entry.cast(patches.ENTRY).alias("entry")).alias("r"))
    own = runs.groupBy("o_custkey").agg(F.array_sort(F.collect_list("r")).alias("r"))  # some ten orders a customer
    own = own.select(
        "o_custkey", (1 + F.col("o_custkey") % 2).cast("int").alias("mode"), F.get("r", F.lit(0))["at"].alias("born_ms"), F.lit(0.6).alias("base_fail"), F.when(F.col("o_custkey") % 3 == 0, 0.4).alias("base_engage"),
        F.when(F.col("o_custkey") % 5 == 0, "show").alias("action"), patches.last_of(F.transform("r", lambda x: x["entry"]), DEFAULT.history).alias("history"),
    )
    found = patches.next_state(own, NOW_MS)
    return found.select("o_custkey", "via", F.col("next_state").alias("state"), patches.trend_word(F.col("history"), F.col("base_fail")).alias("trend"))


@register("rehomed_patches", """WITH p AS (SELECT v.vec_id, 1 + (v.vec_id % 11 = 0)::INT AS mode, CASE WHEN v.vec_id % 4 = 0 THEN 'c' || v.vec_id % 8 ELSE 'gone' END AS home, v.vec_id % 5 = 0 AS old,
    (CASE WHEN v.vec_id % 3 = 0 THEN c.embedding ELSE v.embedding END)::DOUBLE[] AS x FROM embeddings v JOIN embeddings c ON c.vec_id = v.vec_id % 8),
sims AS (SELECT p.vec_id, c.vec_id AS idx, list_dot_product(x, c.embedding::DOUBLE[]) AS sim FROM p, embeddings c WHERE c.vec_id < 8),
best AS (SELECT vec_id, max(idx) FILTER (r = 1) AS idx, max(sim) FILTER (r = 1) AS first, max(sim) FILTER (r = 2) AS second FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, idx) AS r FROM sims) GROUP BY vec_id)
SELECT vec_id, CASE WHEN kept OR NOT near THEN home ELSE 'c' || idx END AS home, NOT kept AND NOT near AS dormant FROM (
  SELECT *, mode = 2 OR home IN ('c0', 'c1', 'c2', 'c3', 'c4', 'c5') AS kept, NOT old AND first >= 0.93 AND first - second >= 0.02 AND idx < 6 AS near FROM p JOIN best USING (vec_id))""")  # fmt: skip
def rehomed_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as patches, of which some lost their category: those near enough to a live centre, and clear of the next, move there."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    first = v.where("vec_id < 8").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("centre"))
    centres = first.withColumn("label", F.concat(F.lit("c"), F.col("idx").cast("string")))
    own = v.join(first, F.col("vec_id") % 8 == F.col("idx")).select(
        F.col("vec_id").alias("id"), (1 + (F.col("vec_id") % 11 == 0).cast("int")).alias("mode"), F.when(F.col("vec_id") % 4 == 0, F.concat(F.lit("c"), (F.col("vec_id") % 8).cast("string"))).otherwise("gone").alias("home"),
        F.when(F.col("vec_id") % 5 == 0, "old").otherwise("new").alias("pipeline"), F.when(F.col("vec_id") % 3 == 0, F.col("centre")).otherwise(F.col("embedding")).alias("centroid"),
    )
    found = patches.rehome(own, centres.where("idx < 6").select(F.col("label").alias("name")), centres, "new")
    return found.select(F.col("id").alias("vec_id"), "home", "dormant")


@register("tuned_rows", """WITH patches AS (
  SELECT event_type AS home, (user_id % 20)::VARCHAR || event_type AS id, min(event_id) AS seq, CASE WHEN count(*) % 2 = 0 THEN 'open' ELSE 'healed' END AS state, count(*) AS reach FROM events GROUP BY user_id % 20, event_type
), best AS (SELECT * FROM patches QUALIFY row_number() OVER (PARTITION BY home ORDER BY state <> 'open', seq, id) = 1
), voices AS (SELECT DISTINCT event_type AS name FROM events WHERE event_type <> 'error' UNION ALL SELECT 'unseen')
SELECT name, (SELECT count(*) FROM events WHERE event_type = name) AS n, best.id AS patch, best.state AS state, best.reach AS reach FROM voices LEFT JOIN best ON home = name""")
def tuned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as worded categories, with their counts and the patch of each that counts: an open one before others, the earliest."""
    e = table(spark, sf_dir, "events").withColumns({"record": F.lit("r"), "user": F.col("user_id") % 20})
    none = F.lit(None)
    made = e.groupBy("user", F.col("event_type").alias("home")).agg(F.min("event_id").alias("seq"), F.count(F.lit(1)).alias("reach"))
    made = made.select("home", "seq", "reach", F.concat(F.col("user").cast("string"), "home").alias("id"), F.when(F.col("reach") % 2 == 0, "open").otherwise("healed").alias("state"), none.cast("string").alias("action"), none.cast("long").alias("slip"), F.lit(None).cast("struct<text:string,x:string,do_this:string,y:string>").alias("wording"))
    names = e.where("event_type <> 'error'").select("record", F.col("event_type").alias("name")).distinct().unionByName(spark.range(1).select(F.lit("r").alias("record"), F.lit("unseen").alias("name")))
    voices = names.select("record", "name", F.lit(0).alias("born_seq"), *[none.cast("string").alias(c) for c in ("section", "line", "signal", "quote")])
    rows = evidence.tune_rows(voices, e.select("record", F.array("event_type").alias("kinds")), made)
    return rows.select("name", "n", F.col("patch.id").alias("patch"), F.col("patch.state").alias("state"), F.nullif(F.col("patch.reach"), F.lit(0)).alias("reach"))


# --- logs and caches -----------------------------------------------------------------------------------


@register("compacted_log", """SELECT o_orderpriority AS record, o_custkey AS name, 'born' AS event, max(o_orderkey) AS seq FROM orders GROUP BY ALL HAVING arg_max(o_orderstatus, o_orderkey) <> 'F'
UNION ALL SELECT o_orderpriority, NULL, 'mark', max(o_orderkey) FROM orders GROUP BY o_orderpriority""")
def compacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as logs by priority: the last event of each customer that isn't retired by F, and the greatest number."""
    log = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("record"), F.col("o_custkey").alias("name"), F.when(F.col("o_orderstatus") == "F", "retired").otherwise("born").alias("event"), F.col("o_orderkey").alias("seq"))
    return state.compact_log(log, ["record", "name"])


@register("wording_plan", """WITH work AS (SELECT p_brand AS name, min(p_partkey) AS born_seq, list(DISTINCT p_name) AS candidates FROM part GROUP BY p_brand),
cache AS (SELECT p_brand AS name, min(p_partkey) + (min(p_partkey) % 3 = 0)::INT AS born_seq, arg_min(p_type, p_partkey) AS section,
  'offer ' || arg_min(p_name, p_partkey) || CASE WHEN arg_min(p_size, p_partkey) > 35 THEN ' 3 times' ELSE '' END AS line,
  CASE WHEN arg_min(p_size, p_partkey) % 2 = 0 THEN arg_max(p_name, p_partkey) ELSE upper(arg_max(p_name, p_partkey)) END AS quote FROM part GROUP BY p_brand)
SELECT w.name, CASE WHEN c.name IS NULL THEN 'missing' WHEN regexp_matches(c.line, '[0-9]') THEN 'replace' WHEN c.section = 'ECONOMY' AND NOT list_contains(w.candidates, c.quote) THEN 'missing' ELSE 'reuse' END AS plan
FROM work w LEFT JOIN cache c ON w.name = c.name AND w.born_seq = c.born_seq""")
def wording_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as categories with cached wordings: some of another birth, some with a numeral, some whose quote is no candidate."""
    part = table(spark, sf_dir, "part")
    work = part.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("born_seq"), F.collect_set("p_name").alias("candidates"))
    first, last = lambda c: F.min_by(c, "p_partkey"), lambda c: F.max_by(c, "p_partkey")
    seen = part.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("m"), first("p_type").alias("section"), first("p_name").alias("first"), first("p_size").alias("size"), last("p_name").alias("last"))
    cache = seen.select(
        "name", (F.col("m") + (F.col("m") % 3 == 0).cast("int")).alias("born_seq"), "section", F.concat(F.lit("offer "), "first", F.when(F.col("size") > 35, " 3 times").otherwise("")).alias("line"),
        F.lit("").alias("signal"), F.when(F.col("size") % 2 == 0, F.col("last")).otherwise(F.upper("last")).alias("quote"),
    )
    return state.cache_plan(work, cache, "ECONOMY").select("name", "plan")


@register("merged_cache", """WITH cache AS (SELECT o_custkey AS name, count(*) AS v FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey), fresh AS (SELECT o_custkey AS name, max(o_orderkey) AS v FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey)
SELECT * FROM cache WHERE name IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND name NOT IN (SELECT name FROM fresh) UNION ALL SELECT * FROM fresh""")
def merged_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of counts: rows of customers that are live and not fresh stay, fresh ones are added."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "name")
    cache = o.where("name % 2 = 0").groupBy("name").agg(F.count(F.lit(1)).alias("v"))
    fresh = o.where("name % 3 = 0").groupBy("name").agg(F.max("o_orderkey").alias("v"))
    return state.merge_cache(cache, fresh, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("name")), ["name"])


@register("usage_since", """WITH now AS (SELECT o_custkey AS feature, count(*) AS calls, sum(o_orderkey)::BIGINT AS units FROM orders GROUP BY o_custkey),
before AS (SELECT o_custkey AS feature, count(*) AS calls, sum(o_orderkey * (1 + o_custkey % 4 // 3))::BIGINT AS units FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY o_custkey)
SELECT feature, greatest(now.calls - coalesce(before.calls, 0), 0) AS calls, greatest(now.units - coalesce(before.units, 0), 0) AS units FROM now LEFT JOIN before USING (feature)""")
def usage_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was used since a snapshot; a counter that ran back counts as nothing."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "feature")
    now = o.groupBy("feature").agg(F.count(F.lit(1)).alias("calls"), F.sum("o_orderkey").alias("units"))
    more = 1 + F.when(F.col("feature") % 4 == 3, 1).otherwise(0)
    before = o.where("o_orderdate < DATE '1998-01-01'").groupBy("feature").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("o_orderkey") * more).alias("units"))
    return state.usage_since(now, before, ["feature"], ["calls", "units"])


# --- plans over files and names ------------------------------------------------------------------------


@register("install_plan", """WITH a AS (SELECT p_brand AS name, min(p_type) AS content, count(*) AS n FROM part GROUP BY p_brand), e AS (SELECT p_brand AS name, max(p_type) AS old FROM part WHERE p_size <= 10 GROUP BY p_brand)
SELECT name, CASE WHEN n % 5 = 0 THEN 'covered' WHEN old IS NULL THEN 'new' WHEN old = content THEN 'unchanged' ELSE 'updated' END AS action FROM a LEFT JOIN e USING (name)""")
def install_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as artifacts, some covered by an installed one, some there already."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "name")
    made = part.groupBy("name").agg(F.min("p_type").alias("content"), F.count(F.lit(1)).alias("n"))
    existing = part.where("p_size <= 10").groupBy("name").agg(F.max("p_type").alias("content"))
    return evidence.plan_install(made.select("name", "content"), made.select("name", F.when(F.col("n") % 5 == 0, "by another").alias("cover")), existing).select("name", "action")


@register("named_piles", """SELECT p_size % 20 AS pile, arg_min(p_name, p_partkey) AS name FROM part WHERE p_size % 20 IN (SELECT s_nationkey FROM supplier) GROUP BY ALL""")
def named_piles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the names that were given, the first for each pile that exists."""
    names = table(spark, sf_dir, "part").select((F.col("p_size") % 20).alias("pile"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"))
    return evidence.one_name_each(names, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("pile"))).select("pile", "name")


@register("archived_twins", """SELECT p_brand || '__' || p_partkey || '.jsonl' AS flat_name FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0""")
def archived_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived files of which no live file is the original."""
    part = table(spark, sf_dir, "part")
    name = lambda sep: F.concat("p_brand", F.lit(sep), F.col("p_partkey").cast("string"), F.lit(".jsonl"))
    return without_archived_twins(part.where("p_partkey % 2 = 0").select(name("__").alias("flat_name")), part.where("p_partkey % 3 <> 0").select(name("/").alias("relative")))


@register("project_labels", """WITH folders AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '/home/u/' || c_mktsegment || '/' || c_nationkey WHEN 1 THEN '/srv/' || c_mktsegment WHEN 2 THEN '/home/u/' WHEN 3 THEN '/home/user/' || c_nationkey ELSE '/' END AS cwd FROM customer)
SELECT c_custkey, CASE WHEN cwd LIKE '/home/u/_%' THEN substr(cwd, 9) WHEN cwd = '/home/u/' THEN 'u' ELSE cwd END AS project, nullif(regexp_extract(cwd, '([^/]+)/*$', 1), '') AS base FROM folders""")
def project_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as folders: what a project is called from a home, and the last part of its path."""
    c = table(spark, sf_dir, "customer")
    n, s = F.col("c_nationkey").cast("string"), F.col("c_mktsegment")
    kind = F.col("c_custkey") % 5
    cwd = F.when(kind == 0, F.concat(F.lit("/home/u/"), s, F.lit("/"), n)).when(kind == 1, F.concat(F.lit("/srv/"), s)).when(kind == 2, "/home/u/").when(kind == 3, F.concat(F.lit("/home/user/"), n)).otherwise("/")
    own = c.select("c_custkey", cwd.alias("cwd"))
    return own.select("c_custkey", text.project_of(F.col("cwd"), "/home/u").alias("project"), text.basename(F.col("cwd")).alias("base"))


@register("command_verbs", rf"""WITH commands AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'git ' || event_type WHEN 1 THEN '  npm run x' WHEN 2 THEN 'python3 -m ' || event_type WHEN 3 THEN 'make ' || event_type WHEN 4 THEN 'ls' ELSE 'npx ' || event_type || 'ation --help' END AS c FROM events),
split AS (SELECT event_id, regexp_extract(ltrim(c), '^({"|".join(text.COMMANDS)})\s+(\S+)?', 1) AS tool, substr(regexp_replace(regexp_extract(ltrim(c), '^({"|".join(text.COMMANDS)})\s+(\S+)?', 2), '^-.*', ''), 1, 12) AS sub FROM commands)
SELECT event_id, CASE WHEN tool = '' THEN NULL WHEN sub = '' THEN tool ELSE tool || ' ' || sub END AS verb FROM split""")
def command_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shell commands made of events, as a known tool and its sub-command."""
    k, kind = F.col("event_id") % 6, F.col("event_type")
    command = (
        F.when(k == 0, F.concat(F.lit("git "), kind)).when(k == 1, "  npm run x").when(k == 2, F.concat(F.lit("python3 -m "), kind)).when(k == 3, F.concat(F.lit("make "), kind)).when(k == 4, "ls")
        .otherwise(F.concat(F.lit("npx "), kind, F.lit("ation --help")))
    )
    return table(spark, sf_dir, "events").select("event_id", text.command_verb(command).alias("verb"))


@register("latest_versions", """WITH v AS (SELECT p_brand, p_size || '.' || p_partkey % 13 || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' || p_partkey % 10 END AS version, [p_size, p_partkey % 13, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 10 END] AS k FROM part)
SELECT p_brand, list(version ORDER BY k[1] DESC, k[2] DESC, k[3] DESC NULLS LAST)[1] AS version FROM v GROUP BY p_brand""")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest version of each brand, by numbers, not letters."""
    key, number = F.col("p_partkey"), lambda c: c.cast("string")
    version = F.concat_ws(".", number(F.col("p_size")), number(key % 13), F.when(key % 3 != 0, number(key % 10)))
    own = table(spark, sf_dir, "part").select("p_brand", version.alias("version"))
    return own.groupBy("p_brand").agg(F.max_by("version", text.version_key(F.col("version"))).alias("version"))
